"""Equality of mathematical answers written in TeX or plain text: a canonical text, then values.

Canonical form and values are functions of one text; batches go through Arrow.  Symbolic equality
needs a computer algebra system and is out: such pairs are unequal unless their texts or values agree.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import evaluate, last_boxed

# Commands that only change the look, and words that name a unit.
LOOKS = (r"\left", r"\right", r"\!", r"\,", r"\;", r"\:", r"\displaystyle", r"\$", "$", r"\%", "%", r"^\circ", r"^{\circ}", "°")
UNITS = ("cm", "degree", "degrees", "dollars", "feet", "foot", "hours", "inches", "km", "m", "meters", "miles", "minutes", "points", "square", "units")

_WRAP = re.compile(r"\\(?:text|mathrm|mathbf|mbox|textbf|operatorname)\s*\{([^{}]*)\}")


def _argument(text: str, at: int) -> tuple[str, int]:
    """The TeX argument that starts at `at`, a braced group or one symbol, and where it ends."""
    if at < len(text) and text[at] == "{":
        depth = 0
        for i in range(at, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if depth == 0:
                return text[at + 1 : i], i + 1
        return text[at + 1 :], len(text)
    return text[at : at + 1], at + 1


def _braced(text: str, command: str, arguments: int) -> str:
    """text with all arguments of a command in braces."""
    out, at = [], 0
    while (found := text.find(command, at)) >= 0:
        out.append(text[at:found] + command)
        at = found + len(command)
        if arguments == 1 and text[at : at + 1] == "[":
            end = text.find("]", at) + 1 or at
            out.append(text[at:end])
            at = end
        for _ in range(arguments):
            if at >= len(text):
                break
            inner, at = _argument(text, at)
            out.append("{" + inner + "}")
    return "".join(out) + text[at:]


def canonical(text: str | None) -> str | None:
    """One way to write an answer: no looks, units, spaces or leading `x =`; fractions and roots in braces."""
    if text is None:
        return None
    x = text.strip().rstrip(".").replace("\n", "").replace("tfrac", "frac").replace("dfrac", "frac")
    for look in LOOKS:
        x = x.replace(look, "")
    x = re.sub(rf"\s*(?:\\text\s*\{{\s*|\s)(?:{'|'.join(UNITS)})\s*\}}?(?:\^\{{?\d\}}?)?\s*$", "", x)
    x = _WRAP.sub(r"\1", x)
    head, sign, tail = x.partition("=")
    if sign and len(head.strip()) <= 2:
        x = tail
    x = re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", x)
    x = re.sub(r"\s+", "", x)
    x = re.sub(r"(^|[^\d])\.(\d)", r"\g<1>0.\2", x)
    x = re.sub(r"(\d)\.0+(?!\d)", r"\1", x)
    x = _braced(_braced(x, r"\frac", 2), r"\sqrt", 1)
    if m := re.fullmatch(r"(-?\d+)/(-?\d+)", x):
        x = rf"\frac{{{m[1]}}}{{{m[2]}}}"
    return r"\frac{1}{2}" if x == "0.5" else x


def value(text: str | None) -> float | None:
    """The number that an answer stands for, if it is one."""
    x = canonical(text)
    if not x:
        return None
    while True:  # from the innermost fraction outwards
        y = re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", x)
        y = re.sub(r"(\d)?\\sqrt\{(\d+)\}", lambda m: f"{m[1] or ''}{'*' if m[1] else ''}{math.sqrt(int(m[2])):.12f}", y)
        if y == x:
            break
        x = y
    x = re.sub(r"(\d)\\pi", rf"\1*{math.pi:.12f}", x).replace(r"\pi", f"{math.pi:.12f}").replace(r"\cdot", "*").replace(r"\times", "*")
    x = re.sub(r"\^\{?(-?\d+)\}?", r"**\1", x)
    x = re.sub(r"^(-?\d+)(?=\(\(\d)", r"\1+", x)
    found = evaluate(x)
    return None if found is None else float(found)


def _parts(x: str) -> list[str] | None:
    """The elements of a tuple, list or interval, and its brackets as the first."""
    if len(x) < 2 or x[0] not in "([{" or x[-1] not in ")]}":
        return None
    out, depth, at = [], 0, 1
    for i, c in enumerate(x[1:-1], 1):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append(x[at:i])
            at = i + 1
    return [x[0] + x[-1], *out, x[at:-1]] if out else None


def equal(answer: str | None, gold: str | None, tolerance: float = 1e-4, percent: bool = True) -> bool:
    """Whether two answers are the same text, value (or 100 times, or a hundredth), or tuple of equals."""
    a, g = canonical(answer), canonical(gold)
    if a is None or g is None:
        return a is None and g is None
    if a == g:
        return True
    x, y = value(answer), value(gold)
    if x is not None and y is not None:
        return any(math.isclose(x, z, rel_tol=tolerance, abs_tol=1e-12) for z in ((y, y / 100, y * 100) if percent else (y,)))
    p, q = _parts(a), _parts(g)
    return p is not None and q is not None and len(p) == len(q) and p[0] == q[0] and all(equal(s, t, tolerance, False) for s, t in zip(p[1:], q[1:], strict=True))


def math_equal(answer: Column, gold: Column) -> Column:
    @F.pandas_udf("boolean")
    def same(answers: pd.Series, golds: pd.Series) -> pd.Series:
        return pd.Series([equal(a, g) for a, g in zip(answers, golds, strict=True)])

    return same(answer, gold)


def boxed_score(text: Column, gold: Column, tail: int | None = None) -> Column:
    """1.0 if the last box (of the last `tail` characters) equals gold, else 0.0."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series, golds: pd.Series) -> pd.Series:
        found = [last_boxed(t[-tail:] if t and tail else t) for t in texts]
        return pd.Series([float(f is not None and equal(f, g)) for f, g in zip(found, golds, strict=True)])

    return scored(text, gold)


def repetition(text: str) -> float:
    """The share of neighbouring suffixes' common prefixes in all suffix length: near 1 for a text that repeats itself.

    Suffixes are ranked by doubling, and Kasai's walk gives the prefixes.
    """
    n = len(text)
    if n < 2:
        return 0.0
    s = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    rank, step = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        step *= 2
        if rank[order[-1]] == n - 1 or step >= 2 * n:
            break
    place, order = rank.tolist(), order.tolist()
    shared = h = 0
    for i in range(n):
        if place[i]:
            j = order[place[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            shared += h
            h = max(0, h - 1)
        else:
            h = 0
    return 2 * shared / (n * (n + 1))
