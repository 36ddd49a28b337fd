"""Texts and notices of well-known licences, as their publishers give them, without the lines that name a holder."""

from __future__ import annotations

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>. This work is licensed under the GNU {name} version {version}."


def _commons(name: str, code: str) -> str:
    return f"This work is licensed under a Creative Commons {name} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{code}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA. Licensed under CC {code.upper()} 4.0."


#: Label: text, and phrases of which one has to be found where the text's position puts it.
TEMPLATES = {
    "agpl-3.0": (_gnu("Affero General Public License", "3"), ["gnu affero general public license"]),
    "apache-2.0": ("Apache License, Version 2.0, January 2004. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ["apache license version 2 0"]),
    "bsd-2-clause": (f"{_BSD} {_BSD_END}", ["redistribution and use in source and binary forms", "bsd 2 clause"]),
    "bsd-3-clause": (f"{_BSD} {_BSD_3} {_BSD_END}", ["nor the names of its contributors", "bsd 3 clause"]),
    "bsl-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.", ["boost software license", "any person or organization obtaining a copy of the software"]),
    "cc-by-4.0": (_commons("Attribution", "by"), ["creative commons attribution 4 0", "cc by 4 0"]),
    "cc-by-nc-4.0": (_commons("Attribution-NonCommercial", "by-nc"), ["creative commons attribution noncommercial 4 0", "cc by nc 4 0"]),
    "cc-by-sa-4.0": (_commons("Attribution-ShareAlike", "by-sa"), ["creative commons attribution sharealike 4 0", "cc by sa 4 0"]),
    "cc0-1.0": ("CC0 1.0 Universal. To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.", ["cc0 1 0", "waived all copyright and related or neighboring rights"]),
    "gpl-2.0": (_gnu("General Public License", "2"), ["gnu general public license version 2", "either version 2 of the license"]),
    "gpl-3.0": (_gnu("General Public License", "3"), ["gnu general public license version 3", "either version 3 of the license"]),
    "isc": ("ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", ["distribute this software for any purpose with or without fee", "isc license"]),
    "lgpl-3.0": (_gnu("Lesser General Public License", "3"), ["gnu lesser general public license"]),
    "mit": (f"Released under the MIT License. {_GRANT} {_AS_IS}", ["mit license", "permission is hereby granted free of charge"]),
    "mpl-2.0": ("Mozilla Public License Version 2.0. This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["mozilla public license v 2 0", "mozilla public license version 2 0"]),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["free and unencumbered software released into the public domain"]),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", ["the origin of this software must not be misrepresented", "zlib license"]),
}
