"""Answers made of word groups, name-role pairs and tool calls: extraction and scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_groups(text: Column) -> Column:
    """`[A, b], [C]` as sorted groups of sorted upper-case words; null without a bracket."""
    found = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    words = F.transform(found, lambda g: F.array_sort(F.filter(F.transform(F.split(g, ","), lambda w: F.upper(F.trim(w))), lambda w: w != "")))
    return F.when(F.size(found) > 0, F.array_sort(F.filter(words, lambda g: F.size(g) > 0)))


def parse_all_groups(text: Column) -> Column:
    """As parse_groups, with empty words kept: `[a,]` is a group of two."""
    found = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    return F.when(F.size(found) > 0, F.array_sort(F.transform(found, lambda g: F.array_sort(F.transform(F.split(g, ","), lambda w: F.upper(F.trim(w)))))))


def same_groups(answer: Column, gold: Column) -> Column:
    return F.coalesce(parse_groups(answer) == parse_groups(gold), F.lit(False))


def group_score(answer: Column, gold: Column, score: float = 1.0, format_score: float = 0.1, abstain_score: float = 0.3) -> Column:
    """0 without an answer, abstain_score for an abstention, score for the same groups or text, else format_score.

    An answer that holds the gold text, or stands in it, counts as the same text.
    """
    plain = lambda c: F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")
    a, g = plain(answer), plain(gold)
    return (
        F.when(answer.isNull(), 0.0)
        .when(F.contains(F.lower(answer), F.lit("abstain")), abstain_score)
        .when(same_groups(answer, gold) | F.coalesce((a != "") & (g != "") & (F.contains(a, g) | F.contains(g, a)), F.lit(False)), score)
        .otherwise(format_score)
    )


def hint_count(text: Column, hint: str = "<hint>") -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(hint)))) / len(hint)).cast("int")


def hint_penalty(score: Column, hints: Column, each: float = 0.1) -> Column:
    """A score less a share for each hint, 0 at least."""
    return F.greatest(score * (1 - each * hints), F.lit(0.0))


def roles(text: Column) -> Column:
    """The last `Answer: {Name = Role, ...}` as a map of lower-case names and roles; null without one."""
    inner = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?is)Answer:\s*\{([^{}]*)\}"), F.lit(1)), F.lit(-1))
    pairs = F.filter(F.transform(F.split(F.lower(inner), ","), lambda p: F.split(p, "=")), lambda p: F.size(p) == 2)
    return F.when(inner.isNotNull(), F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(p[0]), F.trim(p[1])))))


def tool_calls(text: Column) -> Column:
    """The JSON objects in <tool_call> tags: name and arguments as text; those that don't parse are skipped."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    parsed = F.transform(found, lambda j: F.struct(F.get_json_object(j, "$.name").alias("name"), F.get_json_object(j, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda p: p["name"].isNotNull())


def code_block(text: Column) -> Column:
    """The last fenced Python block, else the whole text."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)```python\n(.*?)```"), F.lit(1)), F.lit(-1)), text)


def first_choice(text: Column) -> Column:
    """The first letter A to D named as the answer."""
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)answer[ \t]*:?[ \t]*\$?\(?([A-D])\b", 1)), F.lit(""))


def truncate(text: Column, longest: int, side: str = "middle", mark: str = "...(truncated)...") -> Column:
    """text cut to `longest` characters at its left, right or middle, with a mark at the cut."""
    n = F.length(text)
    half = longest // 2
    cut = {
        "left": F.concat(F.substring(text, 1, longest), F.lit(mark)),
        "right": F.concat(F.lit(mark), text.substr(n - longest + 1, F.lit(longest))),
        "middle": F.concat(F.substring(text, 1, half), F.lit(mark), text.substr(n - half + 1, F.lit(half))),
    }[side]
    return F.when(n <= longest, text).otherwise(cut)


def pad_tokens(ids: Column, length: int, pad: int, left: bool = True, side: str = "right") -> Column:
    """An array of exactly `length`: padded on the left or right, or cut on a side."""
    n = F.size(ids)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - n, F.lit(0)))
    cut = F.slice(ids, 1, length) if side == "right" else F.slice(ids, F.greatest(n - length, F.lit(0)) + 1, F.lit(length))
    return F.when(n >= length, cut).otherwise(F.concat(fill, ids) if left else F.concat(ids, fill))


def messages_with_masks(turns: Column, trained: str = "assistant") -> Column:
    """Tokens (white-space words) of all turns with a loss mask of 1 on the trained role."""
    return F.flatten(F.transform(turns, lambda t: F.transform(F.split(F.trim(t["content"]), r"\s+"), lambda w: F.struct(w.alias("token"), (t["role"] == trained).cast("int").alias("mask")))))
