"""Quality rules: counts per document, and its distance from a reference of its language.

A document's histogram of character classes and one of common words are compared with those of
its language by Jensen-Shannon distance (base 2, 0 to 1).  A language's are the mean over distinct
contents of the corpus that pass the base rules and lie near the medians, so that neither copies
nor a minority of junk move them.
Documents under `min_words` or `min_chars` are too short for a histogram and are judged by the
counts alone, and so are languages with fewer than `min_reference` words.

Cases: a null or empty text has no words, counts of 0 and fails on length; a null or unknown
language is compared with the pool of all such documents; repeated rows are judged one by one;
an empty table gives an empty result; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tables import bounded_batches, stage

# Frequent function words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "en": "the of and to in a is that it for on was be with as by this at are from or an have not".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce".split(),
}
#: Character classes: other ASCII symbol, lower case or digit, upper case, sentence mark, white space, non-ASCII, bar,
#: markup symbol.  Digits have no class of their own: a number in a short text doesn't make it a bad one.
N_CLASSES = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

_CLASS = np.zeros(256, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x41:0x5B] = 1, 1, 2
_CLASS[np.frombuffer(b".,;:'\"?()-+=@", np.uint8)] = 3
_CLASS[tx.SPACE] = 4
_CLASS[0x80:] = 5
_CLASS[ord("|")] = 6
_CLASS[np.frombuffer(b"#*$%&<>", np.uint8)] = 7
_STRIP = np.zeros(256, bool)
_STRIP[np.frombuffer(b".,;:'\"?()", np.uint8)] = True


def _vocabulary() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all common words, and their columns in the word histogram."""
    names = sorted({w for ws in COMMON.values() for w in ws})
    buf, offs = tx.buffers(pa.array(names))
    h = tx.hash_spans(buf, offs[:-1], offs[1:], tx.LOWER)
    order = np.argsort(h)
    return h[order], order


def histograms(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: counts of character classes, and of each common word with all others last."""
    n = len(offs) - 1
    lead = (buf & 0xC0) != 0x80
    doc = tx.owners(offs)[lead]
    chars = np.bincount(doc * N_CLASSES + _CLASS[buf[lead]], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    hashes, columns = _vocabulary()
    last = ends.copy()  # without sentence marks at the end
    cut = np.flatnonzero(ends > starts)
    while len(cut := cut[(last[cut] > starts[cut]) & _STRIP[buf[np.maximum(last[cut] - 1, 0)]]]):
        last[cut] -= 1
    h = tx.hash_spans(buf, starts, last, tx.LOWER)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    column = np.where(hashes[at] == h, columns[at], len(hashes))
    width = len(hashes) + 1
    common = np.bincount(tx.owners(firsts) * width + column, minlength=n * width).reshape(n, width)
    return chars, common


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of counts; 0 where either is empty."""
    ps, qs = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    a, b = p / np.maximum(ps, 1), q / np.maximum(qs, 1)
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(a > 0, a * np.log2(a / m), 0).sum(1) + np.where(b > 0, b * np.log2(b / m), 0).sum(1)
    return np.where((ps * qs)[:, 0] > 0, np.sqrt(np.clip(d / 2, 0, 1)), 0.0)


def counts(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
    """The rules' counts of each document."""
    n = len(offs) - 1
    space = tx.SPACE[buf]
    out = {"n_words": np.diff(firsts), "word_chars": tx.per_group(((buf & 0xC0) != 0x80) & ~space, offs), "n_symbols": tx.per_group(SYMBOLS[buf], offs)}
    edge = np.zeros(len(buf) + 1, bool)
    edge[np.flatnonzero(buf == 10) + 1] = True
    edge[offs] = True
    begin = np.flatnonzero(edge[:-1]) if len(buf) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(buf))[: len(begin)]
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[full], end[full]
    doc = np.searchsorted(offs, begin, "right") - 1
    end = end - (buf[end - 1] == 10) if len(end) else end
    _, first = np.unique(tx.mix(doc.astype(np.uint64), 7) ^ tx.hash_spans(buf, begin, end), return_index=True)
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)
    h = tx.hash_spans(buf, starts, ends)
    own = tx.owners(firsts)
    three = tx.rolling(h, 3)
    inside = own[: len(three)] == own[2:] if len(three) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    key = three[at] ^ tx.mix(own[at].astype(np.uint64), 9)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(h), bool)
    for k in range(3):
        hit[at[twice] + k] = True
    out["n_repeat_words"] = tx.per_group(hit, firsts)
    return out


def _language(df: DataFrame):
    lang = F.lower(F.col("lang").cast("string")) if "lang" in df.columns else F.lit(None).cast("string")
    return F.when(lang.isin(*COMMON), lang).otherwise(F.lit("")).alias("lang")


def _near(p: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    return distance(p, np.broadcast_to(q, p.shape)) <= most


def _shares(p: np.ndarray, unit: int) -> np.ndarray:
    """Rows of counts as shares of their sums, in whole units, so that sums don't depend on their order."""
    return np.rint(p / np.maximum(p.sum(1, keepdims=True), 1) * unit).astype(np.int64)


#: Steps of the square root of a share in the search for medians, and units of a share in means.
STEPS, UNIT = 1 << 10, 1 << 30


def references(docs: DataFrame, least_words: int, most_repeats: int, min_words: int, min_chars: int, most_chars: float, most_common: float) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each known language, and of "" for all others: mean shares, times the words they come from.

    They come from distinct contents, each counted once however often it's repeated, that pass the
    base rules and are long enough for a histogram.  Each bin's median over these is what most
    texts look like, whatever a minority of junk does to a sum; the reference is the mean of those
    within the limits of the medians.

    Histograms are shuffled once, a row for each distinct content of a language; of each language
    and bin at most STEPS counts reach the driver.
    """
    width = len(_vocabulary()[0]) + 1

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slabs(batch, "text"):
                buf, offs = tx.buffers(part.column("text"))
                found = tx.words(buf, offs)
                c = counts(buf, offs, *found)
                at = np.flatnonzero(~_fails(c, least_words, most_repeats) & (c["n_words"] >= min_words) & (c["word_chars"] >= min_chars))
                bins = np.concatenate(histograms(buf, offs, *found), 1)[at].astype(np.int32)
                content = [tx.hash_spans(buf, offs[:-1], offs[1:], None, k)[at].view(np.int64) for k in (1, 2)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * bins.shape[1], pa.int32()), pa.array(bins.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(at)), *map(pa.array, content), lists], ["lang", "c1", "c2", "bins"])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            bins = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, N_CLASSES + width)
            for lang in set(langs.tolist()):
                of = bins[langs == lang]
                yield lang, of[:, :N_CLASSES], of[:, N_CLASSES:]

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for lang, chars, common in rows_of(batches):
            share = np.concatenate([_shares(x, UNIT) for x in (chars, common)], 1) / UNIT
            step = np.minimum((np.sqrt(share) * STEPS).astype(np.int64), STEPS - 1) + np.arange(N_CLASSES + width) * STEPS
            total[lang] = total.get(lang, 0) + np.bincount(step.ravel(), minlength=(N_CLASSES + width) * STEPS)
        yield from sums(total)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for lang, chars, common in rows_of(batches):
            near = _near(chars, middle[lang][:N_CLASSES], most_chars) & _near(common, middle[lang][N_CLASSES:], most_common)
            chars, common = chars[near], common[near]
            total[lang] = total.get(lang, 0) + np.concatenate([_shares(chars, UNIT).sum(0), _shares(common, UNIT).sum(0), [common.sum()]])
        yield from sums(total)

    def sums(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(t[at])], ["lang", "bin", "n"])

    def gathered(function, size: int) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for lang, i, n in distinct.mapInArrow(function, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
            out.setdefault(lang, np.zeros(size))[i] = n
        return out

    rows = docs.select(F.col("text").cast("string").alias("text"), _language(docs)).mapInArrow(listed, "lang string, c1 long, c2 long, bins array<int>")
    distinct = stage(rows.groupBy("lang", "c1", "c2").agg(F.first("bins").alias("bins")).select("lang", "bins"), "histograms")
    steps = gathered(stepped, (N_CLASSES + width) * STEPS)
    middle = {}
    for lang, n in steps.items():
        below = n.reshape(-1, STEPS).cumsum(1)
        step = (2 * below < below[:, -1:]).sum(1)
        middle[lang] = np.where(step > 0, ((step + 0.5) / STEPS) ** 2, 0)
    out = {}
    for lang, x in gathered(summed, N_CLASSES + width + 1).items():
        chars, common = x[:N_CLASSES], x[N_CLASSES:-1]
        out[lang] = (chars / chars.sum(), common / common.sum() * x[-1])
    return out


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: What _judge and references() take where a caller gives nothing else.
LIMITS = {"least_words": 50, "most_repeats": 50, "min_words": 50, "min_chars": 200, "min_reference": 2000, "most_chars": 0.175, "most_common": 0.5}


def _fails(c: dict[str, np.ndarray], least_words: int, most_repeats: int) -> np.ndarray:
    return (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeats * c["n_words"])


def _judge(docs: DataFrame, **limits):
    """From a batch's texts and languages to counts, distances and verdicts.

    base_failed: under least_words words, or more than most_repeats percent of the words in
    repeated 3-word windows.  kept: not base_failed, and neither distance above its limit.
    """
    least_words, most_repeats, min_words, min_chars, min_reference, most_chars, most_common = {k: limits.pop(k, v) for k, v in LIMITS.items()}.values()
    if limits:
        raise TypeError(f"unknown limits: {', '.join(limits)}")
    known = references(docs, least_words, most_repeats, min_words, min_chars, most_chars, most_common)
    zero = (np.zeros(N_CLASSES), np.zeros(len(_vocabulary()[0]) + 1))

    def verdict(texts: pa.Array, langs: list[str]) -> dict[str, np.ndarray]:
        buf, offs = tx.buffers(texts)
        found = tx.words(buf, offs)
        c = counts(buf, offs, *found)
        chars, common = histograms(buf, offs, *found)
        refs = [known.get(x, zero) for x in langs]
        c["char_distance"] = distance(chars, np.array([r[0] for r in refs]))
        c["word_distance"] = distance(common, np.array([r[1] for r in refs]))
        c["base_failed"] = _fails(c, least_words, most_repeats)
        enough = (c["n_words"] >= min_words) & (c["word_chars"] >= min_chars) & np.array([r[1].sum() >= min_reference for r in refs], bool)
        c["kept"] = ~c["base_failed"] & ~(enough & ((c["char_distance"] > most_chars) | (c["word_distance"] > most_common)))
        return c

    return verdict


def judge(docs: DataFrame, **limits) -> DataFrame:
    """Each document's counts, base_failed, kept and both distances; limits: those of _judge."""
    bounded_batches(docs.sparkSession)
    verdict = _judge(docs, **limits)
    names = [*NAMES, "base_failed", "kept", "char_distance", "word_distance"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slabs(batch, "text"):
                c = verdict(part.column("text"), part.column("lang").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c[k]) for k in names)], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _language(docs))
    return rows.mapInArrow(judged, "doc_id long, " + ", ".join(f"{k} long" for k in NAMES) + ", base_failed boolean, kept boolean, char_distance double, word_distance double")


def keep(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that judge() keeps, all columns, in one more scan and no shuffle."""
    bounded_batches(docs.sparkSession)
    verdict = _judge(docs, **limits)
    lang = "_lang"
    while lang in docs.columns:
        lang += "_"

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slabs(batch, "text"):
                yield part.filter(pa.array(verdict(part.column("text"), part.column(lang).to_pylist())["kept"])).drop_columns([lang])

    return docs.select("*", _language(docs).alias(lang)).mapInArrow(kept, docs.schema)
