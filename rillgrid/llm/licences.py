"""License scans by a positional index of rare licence words.

The index holds every word of the licence templates with its places in them.  A word's inverse
document frequency comes from the scanned corpus, by one count of how many documents hold each
template word, on top of a background of `prior` documents in which function words are common
and all others rare, so that a small corpus is judged alike.

Of each file the `rare` different licence words of the highest frequency weight are looked up, and
none that is below `least_idf`.  Hits of one template that agree on the relative position (the
file's place less the template's) in at least `least` different words form a candidate.  A candidate stands if one of the
template's mandatory key phrases is found where that position puts the template, give or take
`slack` words.  score is the largest share of a candidate template's words found at their places.

Cases: a null or empty text has no words, null places, empty labels and score 0; ties between
templates are all reported; repeated rows are scanned one by one, and count one by one for frequencies; an empty table gives an empty
result; columns other than doc_id and text are ignored.  Lines keep no order: a text is one run of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .licence_texts import TEMPLATES
from .quality import COMMON
from .tables import bounded_batches

# Phrases that are looked for as they stand, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
def _hashes(names: list[str]) -> np.ndarray:
    buf, offs = tx.buffers(pa.array(names, pa.string()))
    return tx.hash_spans(buf, offs[:-1], offs[1:])


def _split(text: str) -> list[str]:
    buf, offs = tx.buffers(pa.array([text], pa.string()))
    starts, ends, _ = tx.words(tx.LOWER[buf], offs, tx.NOT_ALNUM)
    raw = tx.LOWER[buf].tobytes()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def vocabulary(templates: dict[str, tuple[str, list[str]]]) -> np.ndarray:
    """Hashes of all words of the templates, sorted."""
    return np.unique(_hashes(sorted({w for text, _ in templates.values() for w in _split(text)})))


def build_index(templates: dict[str, tuple[str, list[str]]], n: int = 0, held: dict[int, int] | None = None, prior: int = 1000) -> dict:
    """Postings (word, template, place) sorted by the word's hash, and each word's inverse document frequency.

    n: documents of the corpus.  held: by a word's hash, how many of them hold it.
    """
    names = sorted(templates)
    split = {k: _split(templates[k][0]) for k in names}
    words = vocabulary(templates)
    common = np.isin(words, _hashes(sorted({w for ws in COMMON.values() for w in ws})))
    seen = np.array([(held or {}).get(int(w), 0) for w in words.view(np.int64)], float)
    idf = np.log((n + prior) / (seen + prior * np.where(common, 0.6, 0.002)))
    postings = [(w, t, i) for t, name in enumerate(names) for i, w in enumerate(_hashes(split[name]))]
    word = np.array([p[0] for p in postings], np.uint64)
    order = np.argsort(word, kind="stable")
    return {
        "names": names, "vocabulary": words, "idf": idf, "word": word[order], "template": np.array([p[1] for p in postings])[order], "place": np.array([p[2] for p in postings])[order],
        "words": [_hashes(split[x]) for x in names], "keys": [[_hashes(_split(p)) for p in templates[x][1]] for x in names],
    }


def places(h: np.ndarray, own: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after another in one document."""
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[h[at + k] == phrase[k]]
    return at[own[at] == own[at + len(phrase) - 1]]


def document_words(h: np.ndarray, own: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of the vocabulary stand, and which they are."""
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = np.flatnonzero(words[at] == h)
    return hit, at[hit]


def rarest(hit: np.ndarray, which: np.ndarray, own: np.ndarray, idf: np.ndarray, rare: int, least_idf: float) -> np.ndarray:
    """Which of these places hold one of their document's `rare` different words of the highest weight."""
    size = len(idf)
    pairs, back = np.unique(own[hit] * size + which, return_inverse=True)
    doc, word = pairs // size, pairs % size
    order = np.lexsort((word, -idf[word], doc))
    new = np.concatenate([[True], doc[order][1:] != doc[order][:-1]]) if len(order) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    kept = np.zeros(len(pairs), bool)
    kept[order[rank < rare]] = True
    return np.flatnonzero((kept & (idf[word] >= least_idf))[back])


def candidates(h: np.ndarray, own: np.ndarray, index: dict, rare: int, least_idf: float, least: int, slack: int) -> Iterator[tuple[int, str, float]]:
    """(document, label, score) of each verified relative position."""
    hit, which = document_words(h, own, index["vocabulary"])
    pick = rarest(hit, which, own, index["idf"], rare, least_idf)
    hit, which = hit[pick], which[pick]
    left, right = (np.searchsorted(index["word"], index["vocabulary"][which], side) for side in ("left", "right"))
    n = right - left
    posting = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, word = np.repeat(hit, n), np.repeat(which, n)
    if not len(at):
        return
    diagonal, t = at - index["place"][posting], index["template"][posting]
    # different words that agree on (document, template, relative position)
    order = np.lexsort((word, diagonal, t, own[at]))
    doc, t, diagonal, word = own[at][order], t[order], diagonal[order], word[order]
    same = (doc[1:] == doc[:-1]) & (t[1:] == t[:-1]) & (diagonal[1:] == diagonal[:-1])
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    votes = np.add.reduceat(np.concatenate([[True], ~(same & (word[1:] == word[:-1]))]).astype(int), begin)
    for b in begin[votes >= least].tolist():
        d, template, start = int(doc[b]), int(t[b]), int(diagonal[b])
        words = index["words"][template]
        low, high = max(start - slack, 0), min(start + len(words) + slack, len(h))
        if any(((found := places(h[low:high], own[low:high], key)).size and (own[found + low] == d).any()) for key in index["keys"][template]):
            span = np.arange(max(start, 0), min(start + len(words), len(h)))
            yield d, index["names"][template], float(((own[span] == d) & (h[span] == words[span - start])).sum() / len(words))


def frequencies(rows: DataFrame, templates: dict[str, tuple[str, list[str]]]) -> tuple[int, dict[int, int]]:
    """How many documents there are, and how many hold each word of the templates: as many numbers as words."""
    words = vocabulary(templates)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(words), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in tx.slabs(batch, "text"):
                buf, offs = tx.buffers(part.column("text"))
                buf = tx.LOWER[buf]
                starts, ends, firsts = tx.words(buf, offs, tx.NOT_ALNUM)
                own = tx.owners(firsts)
                hit, which = document_words(tx.hash_spans(buf, starts, ends), own, words)
                total += np.bincount(np.unique(own[hit] * len(words) + which) % len(words), minlength=len(words))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(words[at].view(np.int64), 0)), pa.array(np.append(total[at], n)), pa.array(np.append(np.zeros(len(at), bool), True))], ["word", "n", "whole"])

    found = rows.select("text").mapInArrow(counted, "word long, n long, whole boolean").groupBy("word", "whole").agg(F.sum("n").alias("n")).collect()
    return sum(r.n for r in found if r.whole), {r.word: r.n for r in found if not r.whole}


def scan(docs: DataFrame, templates: dict[str, tuple[str, list[str]]] | None = None, rare: int = 64, least_idf: float = 1.0, least: int = 2, slack: int = 3) -> DataFrame:
    """One row per document: base phrases' places and labels, all labels, and the score."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    templates = templates or TEMPLATES
    index = build_index(templates, *frequencies(rows, templates))
    base = [(_hashes(p.split()), label) for p, label in BASE.items()]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slabs(batch, "text"):
                buf, offs = tx.buffers(part.column("text"))
                buf = tx.LOWER[buf]
                starts, ends, firsts = tx.words(buf, offs, tx.NOT_ALNUM)
                h, own, n = tx.hash_spans(buf, starts, ends), tx.owners(firsts), len(offs) - 1
                total, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels: list[set[str]] = [set() for _ in range(n)]
                for phrase, label in base:
                    at = places(h, own, phrase)
                    d = own[at]
                    np.add.at(total, d, 1)
                    np.minimum.at(first, d, at - firsts[d])
                    np.maximum.at(last, d, at - firsts[d])
                    for i in set(d.tolist()):
                        labels[i].add(label)
                plain = [",".join(sorted(x)) for x in labels]
                score = np.zeros(n)
                for i, label, s in candidates(h, own, index, rare, least_idf, least, slack):
                    labels[i].add(label)
                    score[i] = max(score[i], s)
                none = total == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(firsts)), pa.array(total), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(plain, pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return rows.mapInArrow(scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
