"""Recurrences, masks and losses over tokens, a row for each token of a sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .advantages import whiten


def _after(seq: list[str], order: list[str]):
    return Window.partitionBy(*seq).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)


def _before(seq: list[str], order: list[str]):
    return Window.partitionBy(*seq).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def suffix_sum(df: DataFrame, seq: list[str], order: list[str], value: str, out: str = "return_") -> DataFrame:
    """The sum of a token's value and all after it."""
    return df.withColumn(out, F.sum(value).over(_after(seq, order)))


def backward(inputs: np.ndarray, offs: np.ndarray, decay: float, keep: np.ndarray | None = None) -> np.ndarray:
    """x_t + decay * keep_(t+1) * y_(t+1) for all sequences at once, from their ends.

    inputs: the sequences one after another, sequence i from offs[i] to offs[i + 1].
    """
    out = np.empty(len(inputs))
    n = np.diff(offs)
    order = np.argsort(-n, kind="stable")
    ends, lengths, last = offs[1:][order] - 1, n[order], np.zeros(len(n))
    for back in range(int(lengths[0]) if len(n) else 0):
        live = int(np.searchsorted(-lengths, -back, "left"))
        at = ends[:live] - back
        out[at] = inputs[at] + decay * last[:live]
        last[:live] = out[at] if keep is None else out[at] * keep[at]
    return out


def _recurrence(df: DataFrame, seq: list[str], order: list[str], columns: list[str], out: str, step) -> DataFrame:
    """A recurrence from the end of each sequence: rows are packed by one shuffle, and an Arrow batch of sequences is one call of `step`.

    A null input counts as 0.
    """
    row = F.array_sort(F.collect_list(F.struct(*order, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_in_{c}") for c in columns], F.struct(*df.columns).alias("_row"))))
    packed = df.groupBy(*seq).agg(row.alias("_t"))

    @F.pandas_udf("array<double>")
    def solve(*series: pd.Series) -> pd.Series:
        offs = np.concatenate([[0], np.cumsum(series[0].map(len))]).astype(np.int64)
        flat = [np.concatenate([np.asarray(v, float) for v in s]) if len(s) else np.zeros(0) for s in series]
        return pd.Series(np.split(step(offs, *flat), offs[1:-1]))

    packed = packed.withColumn("_x", solve(*[F.col(f"_t._in_{c}") for c in columns]))
    one = packed.select(F.explode(F.arrays_zip(F.col("_t._row").alias("row"), F.col("_x").alias("x"))).alias("_z"))
    return one.select("_z.row.*", F.col("_z.x").alias(out))


def discounted_return(df: DataFrame, seq: list[str], order: list[str], value: str, gamma: float, mask: str | None = None, out: str = "return_") -> DataFrame:
    """r_t + gamma * R_(t+1); with a mask, what comes after a token whose mask is 0 counts nothing before it."""
    if mask is None:
        return _recurrence(df, seq, order, [value], out, lambda offs, r: backward(r, offs, gamma))
    return _recurrence(df, seq, order, [value, mask], out, lambda offs, r, m: backward(r, offs, gamma, m))


def discounted_advantage(df: DataFrame, seq: list[str], order: list[str], value: str, mask: str, gamma: float) -> DataFrame:
    """return_ as above, reset by the mask, and `advantage`: whitened over masked tokens, 0 on the others."""
    rows = discounted_return(df, seq, order, value, gamma, mask)
    return whiten(rows, "return_", mask, out="advantage").withColumn("advantage", F.col("advantage") * F.col(mask))


def gae(df: DataFrame, seq: list[str], order: list[str], reward: str, value: str, gamma: float, lam: float, out: str = "advantage") -> DataFrame:
    """Generalised advantage: delta_t + gamma * lam * A_(t+1), delta_t = r_t + gamma * V_(t+1) - V_t."""

    def step(offs, r, v):
        after = np.append(v[1:], 0.0)
        after[offs[1:][np.diff(offs) > 0] - 1] = 0.0
        return backward(r + gamma * after - v, offs, gamma * lam)

    return _recurrence(df, seq, order, [reward, value], out, step)


def gae_returns(df: DataFrame, seq: list[str], order: list[str], reward: str, value: str, mask: str, gamma: float, lam: float) -> DataFrame:
    """`return_` = A + V, and `advantage`: A whitened over masked tokens."""
    rows = gae(df, seq, order, reward, value, gamma, lam, "_a").withColumn("return_", F.col("_a") + F.col(value))
    return whiten(rows, "_a", mask, out="advantage").drop("_a")


def process_rewards(df: DataFrame, seq: list[str], order: list[str], q: str, beta: float, lam: float = 0.0, outcome: str | None = None, granularity: str = "token", out: str = "score") -> DataFrame:
    """Token scores of a process reward: beta * q, or their recurrence x_t + lam * y_(t+1).

    outcome: a column whose value takes the place of the last token, less the sum of those before
    it.  granularity "token" leaves the last token 0, "whole" puts the sum of all on it.
    """
    if granularity not in ("token", "whole"):
        raise ValueError(granularity)

    def step(offs, q, outcome):
        x = q * beta
        ends = offs[1:][np.diff(offs) > 0] - 1
        if lam and use:
            # added one by one from each sequence's start, as SQL's sum does: another order ends in other last digits
            total = np.bincount(np.repeat(np.arange(len(offs) - 1), np.diff(offs)), x, len(offs) - 1)[np.diff(offs) > 0]
            x[ends] = outcome[ends] - (total - x[ends])
        r = backward(x, offs, lam) if lam else x
        y = np.zeros(len(r)) if granularity == "whole" else r.copy()
        if len(r):
            y[ends] = np.add.reduceat(r, offs[:-1][np.diff(offs) > 0]) if granularity == "whole" else 0.0
        return y

    use = outcome is not None
    rows = df if use else df.withColumn("_none", F.lit(0.0))
    made = _recurrence(rows, seq, order, [q, outcome or "_none"], out, step)
    return made if use else made.drop("_none")


def suffix_norm(df: DataFrame, seq: list[str], order: list[str], score: str, out: str = "score") -> DataFrame:
    """Scores over the largest absolute suffix sum of all sequences (+ 1e-6)."""
    rows = suffix_sum(df, seq, order, score, "_s")
    top = rows.agg(F.max(F.abs("_s")).alias("_top"))
    return rows.join(F.broadcast(top)).withColumn(out, F.col(score) / (F.col("_top") + 1e-6)).drop("_s", "_top")


def leave_one_out_tokens(df: DataFrame, seq: list[str], group: list[str], value: str, mask: str, out: str) -> DataFrame:
    """On masked tokens value * n / (n - 1) less the sum of the group's sequence means / (n - 1), n its sequences; 0 on others."""
    m = F.col(mask) > 0
    means = df.filter(m).groupBy(*group, *seq).agg(F.avg(value).alias("_m")).groupBy(*group).agg(F.sum("_m").alias("_s"))
    sizes = df.groupBy(*group).agg(F.count_distinct(*seq).alias("_n"))
    rows = df.join(means.join(sizes, group), group, "left")
    n = F.col("_n")
    return rows.withColumn(out, F.when(m & (n > 1), F.col(value) * n / (n - 1) - F.col("_s") / (n - 1)).otherwise(0.0)).drop("_s", "_n")


def weighted_leave_one_out(df: DataFrame, seq: list[str], group: list[str], order: list[str], mask: str, sources: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Several reward sources, each name: (value, its mask, weight), summed after their leave-one-out: `return_` is the suffix sum, `advantage` its whitening."""
    rows = df
    for name, (value, own, _) in sources.items():
        rows = leave_one_out_tokens(rows, seq, group, value, own, f"_x_{name}")
    total = sum((F.col(f"_x_{name}") * w for name, (_, _, w) in sources.items()), F.lit(0.0))
    rows = suffix_sum(rows.withColumn("_r", total * F.col(mask)), seq, order, "_r").drop("_r", *[f"_x_{n}" for n in sources])
    return whiten(rows, "return_", mask, out="advantage")


def kl_shaped(score: Column, old: Column, reference: Column, ratio: float) -> Column:
    """score less ratio times the log-probabilities' difference."""
    return score - (old - reference) * ratio


def remax(df: DataFrame, seq: list[str], order: list[str], reward: str, baseline: str, mask: str) -> DataFrame:
    """`return_`: the suffix sum of masked rewards; `advantage`: less the sequence's baseline on masked tokens."""
    rows = suffix_sum(df.withColumn("_r", F.col(reward) * F.col(mask)), seq, order, "_r").drop("_r")
    return rows.withColumn("advantage", F.col("return_") - F.col(baseline) * F.col(mask))


def response_mask(df: DataFrame, seq: list[str], order: list[str], is_end: Column, out: str = "mask") -> DataFrame:
    """1 up to and including the first end, 0 after it."""
    ended = F.sum(is_end.cast("int")).over(Window.partitionBy(*seq).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(out, (F.coalesce(ended, F.lit(0)) == 0).cast("int"))


def position_ids(df: DataFrame, seq: list[str], order: list[str], mask: Column, out: str = "position") -> DataFrame:
    """max(running sum of the mask - 1, 0)."""
    return df.withColumn(out, F.greatest(F.sum(mask.cast("long")).over(_before(seq, order)) - 1, F.lit(0)))


def collapse_runs(df: DataFrame, seq: list[str], order: str, value: str, of: list[str]) -> DataFrame:
    """Of neighbouring rows of a sequence whose value is one of `of` and the same, only the first."""
    before = F.lag(value).over(Window.partitionBy(*seq).orderBy(order))
    return df.withColumn("_b", before).filter(~(F.col(value).isin(of) & F.col(value).eqNullSafe(F.col("_b")))).drop("_b")


def mask_tool_turns(df: DataFrame, seq: list[str], order: list[str], is_end: Column, roles: str, mask: str, out: str = "loss_mask", tool: str = "tool") -> DataFrame:
    """Token rows with the mask, 0 on the tokens of tool turns.

    roles: an array of the response's roles; neighbouring tool turns are one.  A token's turn is the
    number of ends before it, and what follows the last turn keeps its mask.
    """
    merged = F.transform(F.filter(F.transform(roles, lambda r, i: F.struct(r.alias("r"), ((i > 0) & (r == tool) & (F.get(F.col(roles), i - 1) == tool)).alias("same"))), lambda x: ~x["same"]), lambda x: x["r"])
    before = F.coalesce(F.sum(is_end.cast("int")).over(Window.partitionBy(*seq).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("_turn", before.cast("int")).withColumn("_merged", merged)
    return rows.withColumn(out, F.when(F.get("_merged", F.col("_turn")) == tool, 0).otherwise(F.col(mask))).drop("_turn", "_merged")


def kl(log_prob: Column, reference: Column, mode: str) -> Column:
    """Penalties on a log-probability's distance from the reference: kl, abs, mse or low_var_kl."""
    d = log_prob - reference
    if mode in ("kl", "k1"):
        return d
    if mode == "abs":
        return F.abs(d)
    if mode in ("mse", "k2"):
        return d * d * 0.5
    if mode in ("low_var_kl", "k3"):
        x = F.least(F.greatest(-d, F.lit(-20.0)), F.lit(20.0))
        return F.least(F.greatest(F.exp(x) - x - 1, F.lit(-10.0)), F.lit(10.0))
    raise ValueError(mode)


def aggregate_loss(df: DataFrame, seq: list[str], loss: str, mask: str, horizon: int | None = None) -> DataFrame:
    """One row for each way to average a loss over tokens and sequences: mode, loss."""
    x = F.col(loss) * F.col(mask)
    per = df.groupBy(*seq).agg(F.sum(x).alias("s"), F.sum(mask).alias("m"), F.count(F.lit(1)).alias("n"))
    a = per.agg(
        (F.sum("s") / (F.sum("m") + 1e-8)).alias("token-mean"),
        F.avg("s").alias("seq-mean-token-sum"),
        F.avg(F.col("s") / (F.col("m") + 1e-8)).alias("seq-mean-token-mean"),
        (F.sum("s") / (F.lit(horizon) if horizon else F.max("n"))).alias("seq-mean-token-sum-norm"),
    )
    return a.unpivot([], a.columns, "mode", "loss")


def clipped_policy_loss(df: DataFrame, old: str, new: str, advantage: str, mask: str, clip_low: float = 0.2, clip_high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """One row: loss, clip_fraction, kl and lower_clip_fraction, means over masked tokens."""
    d = F.least(F.greatest(F.col(new) - F.col(old), F.lit(-20.0)), F.lit(20.0))
    ratio, a, m = F.exp(d), F.col(advantage), F.col(mask)
    first, second = -a * ratio, -a * F.least(F.greatest(ratio, F.lit(1 - clip_low)), F.lit(1 + clip_high))
    high = F.greatest(first, second)
    low = F.least(-a * dual, high)
    mean = lambda x: F.sum(x * m) / (F.sum(m) + 1e-8)
    return df.agg(mean(F.when(a < 0, low).otherwise(high)).alias("loss"), mean((second > first).cast("double")).alias("clip_fraction"), mean(-d).alias("kl"), mean(((high > -a * dual) & (a < 0)).cast("double")).alias("lower_clip_fraction"))
