"""Main text of web pages by equivalence classes of template tokens.

A page's tokens are its structural elements, named by their path of tags and classes, and its
blocks of text, named by path and wording.  Tokens of one host that occur equally often in each
page, their occurrence vectors being equal, make up an equivalence class; pages of equal html
count once, and vectors are compared by sums of hashes of their pages, so that a host of any
number of pages is summed before it's shuffled.  Only tokens of at least half of a host's pages
go on, of which there are no more than twice as many as on its average page.

A class is valid if its elements stand once in each of its pages and if all its tokens that lie in
none of its own elements lie within one and the same element of the classes around it, which are
those of more pages.  The valid classes, nested, are the host's template.  Its slots are its
elements; what its blocks of text cover is no content.  The content slot is the article, or else
main, or else the innermost element with most of the text that the template leaves.  What remains
of a page's slot, less the template's text, is its text.

Within a slot, elements go by kind too: menus, footers, asides, forms, scripts and styles by tag,
adverts, notices and comments by class.  Text is taken as the template's only where all pages of a host
have it, `pages` of them at least, and where it's less than half of the slot's: pages that are
copies of one another but for their ids share their article too.

Cases: a null or empty page gives an empty text; a page without a host or of a host with one page is its own
template; a page that lacks its host's slot falls back on its own; unclosed elements end with
their parent or the page; repeated rows are extracted one by one; an empty table gives an empty
result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tables import bounded_batches, stage

# Elements by kind, and words of a class or id that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside button canvas footer form head iframe nav noscript object option select svg template textarea title".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
STRUCTURE = frozenset("html body div section article main header footer nav aside form ul ol table h1".split())
# Of these words in a class, the first kind says boilerplate by itself; the second does unless another word speaks of content.
PLAIN = frozenset("advert advertisement advertising breadcrumb breadcrumbs comments consent cookie cookies disqus footer masthead navbar navigation newsletter popup promo sidebar sponsored subscribe toolbar".split())
BOILERPLATE = PLAIN | frozenset("ad ads adv banner comment menu nav notice notices promotion related reply respond share sharing social sponsor widget".split())
PART = frozenset("area bar block bottom box button buttons container form inline inner item items label left link links list mid outer panel posts reader readers right section site slot stories text top unit user users wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
STYLED = re.compile(r"display\s*:\s*none", re.I)


def attributes(rest: str) -> dict[str, str]:
    """An element's attributes by name in lower case, the first of a name."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _names(found: dict[str, str], tag: str) -> list[str]:
    """The names in an element's class and role, and its id, unless that is a heading's anchor."""
    return f"{found.get('class', '')} {found.get('role', '')} {'' if tag in HEADINGS else found.get('id', '')}".lower().split()


def _marked(found: dict[str, str], tag: str, inside: bool) -> bool:
    """Whether a name says boilerplate.

    Outside an article any of its words does.  Within one, a plain word in a class or role does, and
    other such words, or an id, only if nothing else in the name speaks of content.
    """
    own = f"{found.get('class', '')} {found.get('role', '')}".lower().split()
    for name in _names(found, tag):
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not BOILERPLATE.isdisjoint(words) and (not inside or (name in own and not PLAIN.isdisjoint(words)) or all(w in BOILERPLATE or w in PART for w in words)):
            return True
    return False


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes): text, open or close, in page order; comments, scripts and styles are gone."""
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m[3]:
            yield ("close" if m[2] else "open"), m[3].lower(), m[4]
    if at < len(page):
        yield "text", page[at:], ""


def walk(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, tag or text, path, dropped): paths name the structural elements around; each opening has its close."""
    stack: list[tuple[str, str, bool]] = [("", "", False)]
    for kind, value, rest in events(page):
        if kind == "text":
            yield kind, value, stack[-1][1], stack[-1][2]
        elif kind == "open":
            _, path, dropped = stack[-1]
            if value in ("article", "main") and dropped and not any(t in ("article", "main") for t, _, _ in stack):
                # a menu or notice that was never closed ends before the article
                while stack[-1][2]:
                    tag, path, dropped = stack.pop()
                    yield "close", tag, path, dropped
                _, path, dropped = stack[-1]
            found = attributes(rest) if rest else {}
            names = _names(found, value) if found else []
            if value in STRUCTURE:
                path = f"{path}/{value}" + (f".{'.'.join(names).replace('/', '')}" if names else "")
            inside = any(t in ("article", "main") for t, _, _ in stack)
            gone = dropped or value in DROPPED or (value == "header" and not inside) or bool(found) and (value not in ("html", "body", "article", "main") or inside) and (_marked(found, value, inside) or "hidden" in found or bool(STYLED.search(found.get("style", ""))))
            yield "open", value, path, gone
            if value in VOID or rest.endswith("/"):
                yield "close", value, path, gone
            else:
                stack.append((value, path, gone))
        elif any(t == value for t, _, _ in stack[1:]):
            while True:
                tag, path, dropped = stack.pop()
                yield "close", tag, path, dropped
                if tag == value:
                    break
    while len(stack) > 1:
        tag, path, dropped = stack.pop()
        yield "close", tag, path, dropped


def _tag(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def wording(path: str, words: list[str]) -> int:
    """The token of a block of text."""
    return xxhash.xxh64_intdigest(f"{path}|{' '.join(words)}") - (1 << 63)


def pieces(page: str) -> Iterator[tuple[str, str, str, bool, list[str]]]:
    """As walk, but kept text comes by block, as words, and other text not at all."""
    parts: list[str] = []
    around = ""
    for kind, value, path, dropped in walk(page):
        if kind == "text":
            if not dropped:
                parts.append(value)
                around = path
            continue
        if value in BLOCKS or value in STRUCTURE:
            if parts and (words := references.unescape("".join(parts)).split()):
                yield "text", "", around, False, words
            parts = []
        yield kind, value, path, dropped, []
    if parts and (words := references.unescape("".join(parts)).split()):
        yield "text", "", around, False, words


def tokens(page: str) -> dict[int, list]:
    """Each token of the page: its path, whether it is text, its occurrences, and the characters of text within."""
    out: dict[int, list] = {}
    paths: dict[str, int] = {}
    for kind, value, path, dropped, words in pieces(page):
        if kind == "open" and value in STRUCTURE and not dropped:
            at = paths.setdefault(path, wording(path, []))
            out.setdefault(at, [path, False, 0, 0])[2] += 1
        elif kind == "text":
            n = len(words) - 1 + sum(map(len, words))
            token = out.setdefault(wording(path, words), [path, True, 0, 0])
            token[2] += 1
            token[3] += n
            while path:
                if path in paths:
                    out[paths[path]][3] += n
                path = path.rpartition("/")[0]
    return out


def choose(elements: dict[str, int]) -> str:
    """The content slot among elements and their characters of text: the article, else main, else the innermost with most of the text."""
    for tag in ("article", "main"):
        if found := [k for k in elements if _tag(k) == tag]:
            return max(found, key=lambda k: (elements[k], -len(k), k))
    full = max(elements.values(), default=0)
    return max((k for k, v in elements.items() if 2 * v > full), key=lambda k: (k.count("/"), elements[k], k), default="")


def within(path: str, slot: str) -> bool:
    return path == slot or path.startswith(slot + "/")


def template(classes: list[dict], host_pages: int, pages: int) -> tuple[str, list[int]]:
    """The content slot and the text tokens in it, of a host's equivalence classes.

    Each class has its tokens (token, path, text, n, chars) and the number of its pages.
    """
    valid: list[dict] = []
    elements: dict[str, int] = {}
    for c in sorted(classes, key=lambda c: (-c["pages"], -len(c["tokens"]), c["tokens"][0]["token"])):
        own = {t["path"] for t in c["tokens"] if not t["text"]}
        if not c["tokens"] or any(t["n"] != c["pages"] for t in c["tokens"] if not t["text"]):
            continue
        # the paths around the class's tokens that it does not hold itself must be those of one element of a class outside it
        around = set()
        for t in c["tokens"]:
            up = t["path"] if t["text"] else t["path"].rpartition("/")[0]
            while up and up not in own and up not in elements:
                up = up.rpartition("/")[0]
            if up not in own:
                around.add(up)
        if len(around) > 1 and valid:
            continue
        valid.append(c)
        elements |= {t["path"]: t["chars"] for t in c["tokens"] if not t["text"]}
    text = [t for c in valid for t in c["tokens"] if t["text"] and c["pages"] == host_pages >= pages]
    if 2 * sum(t["chars"] for t in text) >= max(elements.values(), default=0):
        text = []
    left = {k: v - sum(t["chars"] for t in text if within(t["path"], k)) for k, v in elements.items()}
    slot = choose(left)
    inner = [t for t in text if within(t["path"], slot)]
    if 2 * (elements.get(slot, 0) - left.get(slot, 0)) >= elements.get(slot, 0):
        inner = []
    return slot, sorted(t["token"] for t in inner)


def extract(page: str, slot: str | None = None, covered: frozenset[int] = frozenset()) -> str:
    """The text of the page's slot, less the blocks that the template covers; without a slot, that of its articles, else its main, else what it would choose."""
    events = list(pieces(page))
    opened = {p for k, v, p, d, _ in events if k == "open" and v in STRUCTURE}
    if slot not in opened:
        slot, covered = None, frozenset()
        kinds = {v for k, v, _, d, _ in events if k == "open" and not d}
        names = ("article",) if "article" in kinds else ("main",)
        if not kinds & {"article", "main"}:
            slot = choose({p: n for p, text, _, n in tokens(page).values() if not text})
    parts: list[str] = []
    depth, open_ = 0, []
    for kind, value, path, dropped, words in events:
        if kind == "text":
            if depth or slot == "":
                if not (covered and wording(path, words) in covered):
                    parts.extend(words)
        elif kind == "open":
            root = (path == slot and value == _tag(slot)) if slot is not None else value in names and not dropped
            open_.append(root)
            depth += root
        else:
            depth -= open_.pop()
    return " ".join(parts)


def host(url):
    """The host part of a url column, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, least: int = 4) -> DataFrame:
    """host, slot and covered (tokens of template text in the slot) of hosts with several pages of different html.

    least: different pages that a host must have for its common text to be the template's.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slabs(batch, "html"):
                rows = [(h, k, t, *v) for h, k, p in zip(part.column("host").to_pylist(), part.column("page").to_pylist(), part.column("html").to_pylist(), strict=True) for t, v in tokens(p).items()]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["host", "page", "token", "path", "text", "n", "chars"])

    some = pages.filter("host <> '' AND html <> ''").select("host", F.xxhash64("html").alias("page"), "html")
    found = some.mapInArrow(listed, "host string, page long, token long, path string, text boolean, n long, chars long")
    # pages of equal html are one
    once = found.groupBy("host", "page", "token").agg(*[F.min(c).alias(c) for c in ("path", "text", "n", "chars")])
    weigh = lambda seed: F.sum(F.pmod(F.xxhash64("page", F.lit(seed)), F.lit(1 << 30)) * F.col("n"))
    vectors = once.groupBy("host", "token").agg(F.min("path").alias("path"), F.min("text").alias("text"), weigh(1).alias("v1"), weigh(2).alias("v2"), F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("chars").alias("chars")).filter("pages > 1")
    vectors = stage(vectors, "vectors")
    hosts = vectors.groupBy("host").agg(F.max("pages").alias("host_pages"))
    common = vectors.join(hosts, "host").filter("2 * pages >= host_pages")
    classes = common.groupBy("host", "host_pages", "v1", "v2", "pages").agg(F.sort_array(F.collect_list(F.struct("token", "path", "text", "n", "chars"))).alias("tokens"))
    whole = classes.groupBy("host", "host_pages").agg(F.collect_list(F.struct("pages", "tokens")).alias("classes"))

    def nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["host"], *template(r["classes"], r["host_pages"], least)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["host", "slot", "covered"])

    return whole.mapInArrow(nested, "host string, slot string, covered array<long>").filter("slot <> ''")


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars, its code points.

    The templates are staged; Spark broadcasts them if their files are small, and else deals the pages by host.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host(F.col("url")))
    found = stage(templates(rows), "templates")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[tuple, frozenset[int]] = {}
            for part in tx.slabs(batch, "html"):
                columns = [part.column(c).to_pylist() for c in ("html", "slot", "covered")]
                texts = [extract(p, s, sets.setdefault(tuple(c or ()), frozenset(c or ()))) if p else "" for p, s, c in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.join(found, "host", "left").select("page_id", "url", "html", "slot", "covered").mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
