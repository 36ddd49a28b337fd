"""Extraction, normalisation and scoring of answers, as column expressions unless recursion is needed."""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of question answers when they're compared.
ARTICLES = ("a", "an", "the")


def first_tag(text: Column, tag: str = "answer") -> Column:
    """What stands in the first pair of tags, in any case and over lines; null without one."""
    pattern = rf"(?is)<{tag}>(.*?)</{tag}>"
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_replace(F.regexp_extract(text, pattern, 1), r"^\s+|\s+$", ""))


def tag_or_line(text: Column, line: str = r"Answer:\s*(.+?)(?:\n|$)") -> Column:
    """What stands in the first pair of answer tags, or else after `Answer:` up to the line's end; null without either."""
    found = first_tag(text)
    after = F.when(F.regexp_like(text, F.lit(line)), F.trim(F.regexp_extract(text, line, 1)))
    return F.coalesce(found, after)


def tag_or_braces(text: Column) -> Column:
    """What stands in the first pair of answer tags, or else the braces after `Answer:`, with them."""
    return tag_or_line(text, r"(?is)Answer:\s*(\{.*?\})")


def cleaned_thought(text: Column, mark: str = "<|endoftext|>") -> Column:
    """A generated text up to a model's end mark, and no further than its first answer."""
    x = F.substring_index(text, mark, 1)
    first = F.regexp_extract(x, r"(?is)^(.*?</answer>)", 1)
    return F.regexp_replace(F.when(first != "", first).otherwise(x), r"^\s+|\s+$", "")


def last_tag(text: Column, tag: str = "answer") -> Column:
    """What stands in the last pair of tags on one line; null without one."""
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(rf"<{tag}>(.*?)</{tag}>"), F.lit(1)), F.lit(-1)))


def hash_answer(text: Column, strict: bool = True) -> Column:
    """The number after the last `####` (strict) or else the last number; thousands separators go."""
    if strict:
        found = F.try_element_at(F.regexp_extract_all(text, F.lit(r"#### (-?[0-9.,]+)"), F.lit(1)), F.lit(-1))
    else:
        numbers = F.filter(F.regexp_extract_all(text, F.lit(r"(-?[0-9.,]+)"), F.lit(1)), lambda x: ~x.isin("", "."))
        found = F.try_element_at(numbers, F.lit(-1))
    return F.regexp_replace(F.regexp_replace(found, ",", ""), r"\$", "")


def qa_normalise(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    x = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    x = F.regexp_replace(x, rf"\b({'|'.join(ARTICLES)})\b", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def exact_match(answer: Column, golds: Column) -> Column:
    """1 if the normalised answer is one of the normalised golds."""
    return F.exists(golds, lambda g: qa_normalise(g) == qa_normalise(answer)).cast("int")


def sub_exact_match(answer: Column, golds: Column) -> Column:
    """1 if one of the normalised golds stands in the normalised answer."""
    return F.exists(golds, lambda g: F.contains(qa_normalise(answer), qa_normalise(g))).cast("int")


def token_f1(answer: Column, gold: Column) -> Column:
    """The F1 of two normalised answers as bags of words."""
    a, g = F.split(qa_normalise(answer), " "), F.split(qa_normalise(gold), " ")
    size = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    same = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(size(a, w), size(g, w)))
    p, r = same / F.size(a), same / F.size(g)
    return F.when(same > 0, 2 * p * r / (p + r)).otherwise(0.0)


def gsm8k_score(text: Column, gold: Column, format_score: float = 0.0, score: float = 1.0, strict: bool = True) -> Column:
    found = hash_answer(text, strict)
    return F.when(found.isNull(), 0.0).when(found == gold, score).otherwise(format_score)


def ascii_normalise(text: Column) -> Column:
    """Typographic quotes, dashes and spaces as ASCII; white space as one space; trimmed."""
    x = F.translate(text, "‘’“”–—− ", "''\"\"--- ")
    return F.trim(F.regexp_replace(F.replace(x, F.lit("…"), F.lit("...")), r"\s+", " "))


def longest_common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: F.when((s == i - 1) & (a.substr(i, F.lit(1)) == b.substr(i, F.lit(1))), i).otherwise(s))).otherwise(0)


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    """0 up to longest - buffer, then falling to -factor at longest."""
    return F.least(-(length - (longest - buffer)) / buffer * factor, F.lit(0.0))


# Arithmetic isn't regular: a small parser, by batches.

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|(\*\*|//|[-+*/()]))")


def tokenize_expression(text: str) -> list[str] | None:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        out.append(m[1] or m[2])
        at = m.end()
    return out


def evaluate(text: str | None, most_bits: int = 1 << 20) -> Fraction | None:
    """The exact value of an expression of + - * / // ** and parentheses; None if it's none or has no value.

    A power of more than `most_bits` bits has no value here: no table needs one, and it would fill memory.
    """
    tokens = tokenize_expression(text) if text else None
    if not tokens:
        return None
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def total():
        x = product()
        while peek() in ("+", "-"):
            x = x + product() if take() == "+" else x - product()
        return x

    def product():
        x = signed()
        while peek() in ("*", "/", "//"):
            op, y = take(), signed()
            x = x * y if op == "*" else x / y if op == "/" else Fraction(x // y)
        return x

    def signed():
        if peek() in ("+", "-"):
            return -signed() if take() == "-" else signed()
        return power()

    def power():
        x = atom()
        if peek() == "**":
            take()
            y = signed()
            bits = max(abs(x.numerator).bit_length(), x.denominator.bit_length())
            if y.denominator != 1 or (abs(x) not in (0, 1) and abs(y) * bits > most_bits):
                raise ValueError
            return x ** int(y)
        return x

    def atom():
        t = peek()
        if t == "(":
            take()
            x = total()
            if peek() != ")":
                raise ValueError
            take()
            return x
        if t is None or not (t[0].isdigit() or t[0] == "."):
            raise ValueError
        return Fraction(take())

    try:
        x = total()
        return x if at == len(tokens) else None
    except (ValueError, ZeroDivisionError, RecursionError, OverflowError):
        return None


def countdown(text: str | None, target: int, numbers: list[int], score: float = 1.0, format_score: float = 0.1) -> float:
    """0 without an answer, format_score for a wrong one, score if the last answer uses exactly the numbers and equals target."""
    found = re.findall(r"<answer>(.*?)</answer>", text or "")
    if not found:
        return 0.0
    expression = found[-1].strip().partition("=")[0]
    used = sorted(int(x) for x in re.findall(r"\d+", expression))
    value = evaluate(expression)
    right = used == sorted(int(n) for n in numbers) and value is not None and abs(value - target) < Fraction(1, 100000)
    return score if right else format_score


def countdown_score(text: Column, target: Column, numbers: Column) -> Column:
    @F.pandas_udf("double")
    def scored(texts: pd.Series, targets: pd.Series, all_numbers: pd.Series) -> pd.Series:
        return pd.Series([countdown(t, x, list(n)) for t, x, n in zip(texts, targets, all_numbers, strict=True)])

    return scored(text, target, numbers)


def last_boxed(text: str | None) -> str | None:
    """The content of the last \\boxed{...} or \\fbox{...}, braces balanced; None without one."""
    at = max((text or "").rfind("\\boxed{"), (text or "").rfind("\\fbox{"))
    if at < 0:
        return None
    start = text.index("{", at)
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[start + 1 : i]
    return None


def boxed_answer(text: Column) -> Column:
    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(last_boxed)

    return found(text)
