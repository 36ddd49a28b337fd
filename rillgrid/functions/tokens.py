"""Token arrays of training rows: tokenising, padding, masks, places of rewards, log-probabilities.

A tokenizer is any function from a text column to an array column; the default takes characters'
code points, `words` takes words of white space by a 31-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def characters(text: Column) -> Column:
    """A text's characters as code points."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def words(text: Column) -> Column:
    """A text's white-space words as positive numbers."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.hash(w).bitwiseAND(F.lit(0x7FFFFFFF)))


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"characters": characters, "words": words}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it's used."""
    return F.transform(F.array(value), then)[0]


def _zero(n: Column | int) -> Column:
    return F.greatest(n if isinstance(n, Column) else F.lit(n), F.lit(0))


def _empty() -> Column:
    return F.array().cast("array<int>")


def total(mask: Column) -> Column:
    return F.aggregate(mask.cast("array<int>"), F.lit(0), lambda s, x: s + x)


def ones(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.lit(1))


def pad(ids: Column, length: Column | int, value: int, left: bool = False) -> Column:
    """ids with `value` on one side up to `length`; longer ones stay."""
    n = length if isinstance(length, Column) else F.lit(length)
    filled = lambda x: F.array_repeat(F.lit(value), _zero(n - F.size(x)).cast("int"))
    return let(ids, lambda x: F.concat(filled(x), x) if left else F.concat(x, filled(x)))


def cut(ids: Column, length: int, side: str = "error") -> Column:
    """ids of at most `length`: the first are kept (right), the last (left), half of each (middle), or it is an error."""
    half = length // 2
    kept = {
        "error": lambda x: F.raise_error(F.concat(F.lit("more tokens than the limit: "), F.size(x).cast("string"))).cast("array<int>"),
        "right": lambda x: F.slice(x, 1, length),
        "left": lambda x: F.slice(x, _zero(F.size(x) - length) + 1, F.lit(length)),
        "middle": lambda x: F.concat(F.slice(x, 1, half), F.slice(x, _zero(F.size(x) - (length - half)) + 1, F.lit(length - half))),
    }[side]
    return let(ids, lambda x: F.when(F.size(x) > length, kept(x)).otherwise(x))


def padded(ids: Column, length: int, value: int, left: bool = True, side: str = "error") -> Column:
    """A struct of input_ids and attention_mask of exactly `length`."""
    return let(cut(ids, length, side), lambda x: F.struct(pad(x, length, value, left).alias("input_ids"), pad(ones(x), length, 0, left).alias("attention_mask")))


def without_padding(ids: Column, mask: Column) -> Column:
    """The last ids, as many as the mask has ones."""
    return let(ids, lambda x: let(total(mask), lambda n: F.slice(x, F.size(x) - n + 1, n)))


def without_left_padding(ids: Column, value: int) -> Column:
    """ids from the first that isn't the padding on; none if all are."""
    first = lambda x: F.array_position(F.transform(x, lambda v: v != value), True).cast("int")
    return let(ids, lambda x: let(first(x), lambda at: F.when(at > 0, F.slice(x, F.greatest(at, F.lit(1)), F.size(x))).otherwise(F.slice(x, 1, 0))))


def not_padding(ids: Column, value: int) -> Column:
    return F.transform(ids, lambda x: (x != value).cast("int"))


def positions(mask: Column) -> Column:
    """max(running sum of the mask - 1, 0) of each place, for masks whose ones stand together, which is what padding leaves."""
    first = lambda m: F.array_position(m, 1).cast("int")
    at = lambda i, a, n: F.when(a == 0, 0).otherwise(F.greatest(F.least(i + 1 - a, n - 1), F.lit(0)))
    return let(mask, lambda m: let(first(m), lambda a: let(total(m), lambda n: F.transform(m, lambda x, i: at(i, a, n)))))


def running(mask: Column) -> Column:
    """The same for any mask: each place looks at all before it."""
    return let(mask, lambda m: F.transform(m, lambda x, i: _zero(total(F.slice(m, F.lit(1), i + 1)) - 1)))


def last_places(mask: Column, response: int) -> Column:
    """The mask's last `response` places: the response's mask."""
    return let(mask, lambda m: F.slice(m, F.size(m) - response + 1, F.lit(response)))


def at_last(mask: Column, value: Column) -> Column:
    """Zeros, and value at the last place where a response's mask is 1; a response of padding alone has it nowhere."""
    return let(mask, lambda m: let(total(m), lambda n: let(value.cast("double"), lambda v: F.transform(m, lambda x, i: F.when(i == n - 1, v).otherwise(0.0)))))


def prompt_row(text: Column, longest: int, value: int = 0, tokenize: Callable = characters, side: str = "error") -> Column:
    """A struct of a prompt's left-padded input_ids, attention_mask and position_ids, and raw_prompt_ids without padding, cut alike."""

    def made(x: Column) -> Column:
        mask = pad(ones(x), longest, 0, True)
        return let(mask, lambda m: F.struct(pad(x, longest, value, True).alias("input_ids"), m.alias("attention_mask"), positions(m).alias("position_ids"), x.alias("raw_prompt_ids")))

    return let(cut(tokenize(text), longest, side), made)


def lifted(extra: Column | None, fields: dict[str, Column]) -> dict[str, Column]:
    """Fields of a struct column with their defaults, as columns of their own."""
    return {k: default if extra is None else F.coalesce(extra[k], default) for k, default in fields.items()}


def supervised_row(prompt: Column, response: Column, longest: int, value: int = 0, end: int = 2, tokenize: Callable = characters, side: str = "error") -> Column:
    """A struct of one right-padded row of prompt, response and an end token: input_ids, attention_mask, position_ids, loss_mask.

    The loss counts what predicts a response token or the end: it is 0 on all of the prompt but its
    last token, and on the last token.
    """

    def made(ids: Column, n: Column) -> Column:
        m = F.size(ids)
        row = padded(ids, longest, value, False, side)
        loss = lambda mask: F.transform(mask, lambda x, i: F.when((i >= n - 1) & (i < F.least(m, F.lit(longest)) - 1), x).otherwise(0))
        return let(row, lambda r: F.struct(r["input_ids"].alias("input_ids"), r["attention_mask"].alias("attention_mask"), positions(r["attention_mask"]).alias("position_ids"), loss(r["attention_mask"]).alias("loss_mask")))

    return let(tokenize(prompt), lambda p: let(F.concat(p, tokenize(response), F.array(F.lit(end))), lambda ids: let(F.size(p), lambda n: made(ids, n))))


def preference_row(prompt: Column, chosen: Column, rejected: Column, longest: int, value: int = 0, end: int | None = None, tokenize: Callable = characters) -> Column:
    """A struct of input_ids and attention_mask, arrays of two rows: prompt + chosen and prompt + rejected, right-padded or cut."""
    tail = _empty() if end is None else F.array(F.lit(end))
    row = lambda p, c: padded(F.concat(p, tokenize(c), tail), longest, value, False, "right")
    part = lambda rows, k: F.transform(rows, lambda r: r[k]).alias(k)
    return let(tokenize(prompt), lambda p: let(F.array(row(p, chosen), row(p, rejected)), lambda rs: F.struct(part(rs, "input_ids"), part(rs, "attention_mask"))))


def turn_tokens(turns: Column, tokenize: Callable = characters, trained: str = "assistant", tool: str = "tool") -> Column:
    """Turns (role, content) as (token, loss, turn): the loss counts the trained role's; neighbouring tool turns are one turn."""
    starts = lambda ts: F.transform(ts, lambda t, i: F.when((i > 0) & (t["role"] == tool) & (F.get(ts, i - 1)["role"] == tool), 0).otherwise(1))
    of = lambda t, n: F.transform(tokenize(t["content"]), lambda x: F.struct(x.alias("token"), (t["role"] == trained).cast("int").alias("loss"), n.alias("turn")))
    return let(turns, lambda ts: let(starts(ts), lambda s: F.flatten(F.transform(ts, lambda t, i: let(total(F.slice(s, F.lit(1), i + 1)) - 1, lambda n: of(t, n))))))


def preferred_tokens(whole: Column, joined: Column) -> tuple[Column, Column]:
    """(the tokens to take, whether both agree): those joined from turns count, whatever the whole text's are."""
    return joined, whole == joined


def joined_parts(parts: Column, masks: Column, longest: int, value: int) -> Column:
    """A struct of a response from partial ids and masks: responses and response_mask, cut on the right and padded, and whether it was cut."""
    return let(F.flatten(parts), lambda ids: F.struct(pad(F.slice(ids, 1, longest), longest, value).alias("responses"), pad(F.slice(F.flatten(masks), 1, longest), longest, 0).alias("response_mask"), (F.size(ids) > longest).alias("truncated")))


def too_long(parts: Column, longest_prompt: int, longest_response: int) -> Column:
    return F.size(F.flatten(parts)) >= longest_prompt + longest_response


def rollout_row(prompt_ids: Column, response_ids: Column, response_mask: Column, longest_prompt: int, longest_response: int, value: int = 0) -> Column:
    """A struct of a left-padded prompt and right-padded response in one row: ids, masks, and positions that go on through the padding."""

    def made(p: Column, r: Column) -> Column:
        own = F.zip_with(pad(F.slice(response_mask, 1, longest_response), longest_response, 0), r["attention_mask"], lambda a, b: a * b)
        mask = F.concat(p["attention_mask"], r["attention_mask"])
        return let(mask, lambda m: F.struct(p["input_ids"].alias("prompts"), r["input_ids"].alias("responses"), own.alias("response_mask"), F.concat(p["input_ids"], r["input_ids"]).alias("input_ids"), m.alias("attention_mask"), positions(m).alias("position_ids")))

    return let(padded(prompt_ids, longest_prompt, value, True, "left"), lambda p: let(padded(response_ids, longest_response, value, False, "right"), lambda r: made(p, r)))


def split_at_prompt(ids: Column, prompt: Column) -> tuple[Column, Column]:
    """(the prompt's part, the rest) of a whole sequence."""
    n = F.size(prompt)
    return F.slice(ids, F.lit(1), n), F.slice(ids, n + 1, F.size(ids))


def appended(row: Column, ids: Column, attention: int = 1, loss: int = 0) -> Column:
    """A struct of input_ids, attention_mask, loss_mask and position_ids with more tokens at its end."""
    last = F.coalesce(F.try_element_at(row["position_ids"], F.lit(-1)), F.lit(-1))

    def made(new: Column, at: Column) -> Column:
        more = lambda v: F.transform(new, lambda x: F.lit(v))
        return F.struct(
            F.concat(row["input_ids"], new).alias("input_ids"), F.concat(row["attention_mask"], more(attention)).alias("attention_mask"), F.concat(row["loss_mask"], more(loss)).alias("loss_mask"),
            F.concat(row["position_ids"], F.transform(new, lambda x, i: (at + i + 1).cast("int"))).alias("position_ids"),
        )

    return let(ids, lambda new: let(last, lambda at: made(new, at)))


#: The record that a loop of turns gives for one conversation.
LOOP_OUTPUT = "prompt_ids array<int>, response_ids array<int>, response_mask array<int>, num_turns int, metrics map<string,double>"


def log_sum_exp(logits: Column) -> Column:
    return let(logits, lambda v: let(F.array_max(v), lambda top: top + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))))


def label_log_prob(logits: Column, label: Column) -> Column:
    """A label's logit less the log of the sum of exponents."""
    return gathered(logits, label) - log_sum_exp(logits)


def chunked(function: Callable[[Column], Column], rows: Column, size: int = 2048) -> Column:
    """function of each logits array of a sequence, `size` arrays at a time: the same numbers as at once."""
    n = F.size(rows)
    starts = F.sequence(F.lit(0), _zero((n - 1) / size).cast("int"))
    return F.flatten(F.transform(starts, lambda k: F.transform(F.slice(rows, k * size + 1, F.lit(size)), function)))


def entropy(logits: Column) -> Column:
    """log of the sum of exponents less the expected logit."""
    return let(logits, lambda v: let(log_sum_exp(v), lambda z: z - F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - z) * x)))


def gathered(values: Column, index: Column) -> Column:
    """The value at an index that counts from 0."""
    return F.get(values, index)


def clamped(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def response_log_probs(logits: Column, ids: Column, response: int) -> Column:
    """Log-probabilities of a sequence's last `response` tokens: each from the logits one place before it."""
    one = lambda x, i: label_log_prob(F.get(logits, F.size(x) - response + i - 1), F.get(x, F.size(x) - response + i))
    return let(ids, lambda x: F.transform(F.sequence(F.lit(0), F.lit(response - 1)), lambda i: one(x, i)))


def longest(ids: Column, over) -> Column:
    """The largest size in a window: what rows of one batch are padded to."""
    return F.max(F.size(ids)).over(over)
