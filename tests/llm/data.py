"""Small documents with every kind of trouble, and brute-force versions."""

import hashlib
import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, band string, seg string, twin int, rep int, words int, _entities int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def documents(n=60, seed=3, long=3000):
    """Null, empty, blank, short and very long texts, copies, near copies, shared passages and periodic texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, base = prose(40), prose(120)
    texts = [None, "", " \t\n ", "one", "one", "One two", "x " * 300, "y " * 301, prose(long), "end\n" + prose(60) + "\n" + passage]
    for i in range(n - len(texts)):
        kind = i % 6
        if kind == 0:
            texts.append(base)
        elif kind == 1:
            words = base.split()
            words[rng.randrange(len(words))] = "changed"
            texts.append("\n".join([" ".join(words[:50]), " ".join(words[50:])]))
        elif kind == 2:
            texts.append(prose(30) + "\r\n" + passage + "  " + prose(20))
        else:
            texts.append(prose(rng.randrange(1, 200)))
    rows = [(3 * i + 1, t, ("en", "de", None, "xx")[i % 4], None if i % 9 == 0 else f"s{i % 3}", len(t or ""), "b", "g", 1, 2, 3, 4) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def words(text):
    return WORD.findall((text or "").encode())


def cut_words(rows, window):
    first, out = {}, {}
    split = {r[0]: words(r[1]) for r in rows}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - window + 1):
            first.setdefault(b" ".join(w[i : i + window]), d)
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[b" ".join(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def cut_bytes(rows, window):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    times = Counter(b[i : i + window] for _, b in texts for i in range(len(b) - window + 1))
    out = {}
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if times[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def near(rows, k, percent=80):
    sets = {}
    for r in rows:
        w = words(re.sub(r"[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets[r[0]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}
