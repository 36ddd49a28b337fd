"""Losses and controllers over token or sequence rows: aggregates of column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import first_rows
from .stored import stored


def _mean(x: Column, mask: str) -> Column:
    return F.sum(x * F.col(mask)) / (F.sum(mask) + 1e-8)


def value_loss(df: DataFrame, predicted: str, returns: str, old: str, mask: str, clip: float) -> DataFrame:
    """Half the larger of the plain and the clipped squared error, and how often the clip counts."""
    p, r, v = F.col(predicted), F.col(returns), F.col(old)
    held = F.least(F.greatest(p, v - clip), v + clip)
    plain, clipped = (p - r) * (p - r), (held - r) * (held - r)
    return df.agg((0.5 * _mean(F.greatest(plain, clipped), mask)).alias("loss"), _mean((clipped > plain).cast("double"), mask).alias("clip_fraction"))


def covariance(df: DataFrame, advantage: str, log_prob: str, mask: str, out: str = "covariance") -> DataFrame:
    """(advantage - mean) * (log_prob - mean) of each token, means over masked tokens."""
    means = df.agg(_mean(F.col(advantage), mask).alias("_ma"), _mean(F.col(log_prob), mask).alias("_ml"))
    return df.join(F.broadcast(means)).withColumn(out, (F.col(advantage) - F.col("_ma")) * (F.col(log_prob) - F.col("_ml"))).drop("_ma", "_ml")


def clip_by_covariance(df: DataFrame, value: str, mask: str, low: float, high: float, share: float, seed: object, key: list[str]) -> DataFrame:
    """df with `clipped` on a seeded share of all masked tokens, drawn from those whose covariance lies in (low, high)."""
    n = int(df.agg(F.sum(mask)).first()[0] or 0)
    band = (F.col(value) > low) & (F.col(value) < high) & (F.col(mask) == 1)
    hashed = df.filter(band).select(*key, F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])).alias("_h"))
    drawn = first_rows(hashed, max(1, int(n * share)), "_h", *key).drop("_h")
    return df.join(drawn.withColumn("_c", F.lit(True)), key, "left").withColumn("clipped", F.coalesce("_c", F.lit(False))).drop("_c")


def top_covariance(df: DataFrame, value: str, mask: str, share: float, key: list[str]) -> DataFrame:
    """Keys of the masked tokens with the largest covariance: a share of all, one at least."""
    n = int(df.agg(F.sum(mask)).first()[0] or 0)
    return first_rows(df.filter(F.col(mask) == 1).select(*key, (-F.col(value)).alias("_v")), max(1, int(n * share)), "_v", *key).select(*key)


def covariance_clipped_loss(df: DataFrame, old: str, new: str, advantage: str, mask: str, key: list[str], clip_low: float = 0.2, clip_high: float = 0.2, share: float = 0.0002, low: float = 1.0, high: float = 5.0, seed: object = 0) -> DataFrame:
    """One row: loss, clip_fraction and kl of the clipped surrogate in which a seeded share of tokens with a covariance in (low, high) counts nothing.

    Tokens that the surrogate clips anyway aren't drawn.
    """
    a, m = F.col(advantage), F.col(mask)
    ratio = F.exp(F.col(new) - F.col(old))
    rows = covariance(df, advantage, new, mask, "_cov").withColumn("_one", -a * ratio).withColumn("_two", -a * F.least(F.greatest(ratio, F.lit(1 - clip_low)), F.lit(1 + clip_high)))
    rows = rows.withColumn("_cov", F.when((F.col("_two") > F.col("_one")) & (m > 0), F.lit(float("-inf"))).otherwise(F.col("_cov")))
    rows = stored(rows, "covariances")
    rows = clip_by_covariance(rows, "_cov", mask, low, high, share, seed, key)
    kept = F.when(F.col("clipped"), 0.0).otherwise(1.0)
    return rows.agg(_mean(F.greatest("_one", "_two") * kept, mask).alias("loss"), _mean(1 - kept, mask).alias("clip_fraction"), _mean(F.col(old) - F.col(new), mask).alias("kl"))


def covariance_penalty_loss(df: DataFrame, old: str, new: str, advantage: str, mask: str, key: list[str], share: float = 0.0002, weight: float = 1.0) -> DataFrame:
    """One row: loss and absolute kl of the plain surrogate, in which the share of tokens with the largest covariance pays weight * |log ratio|.

    Means are over masked tokens without an epsilon, as the covariances are of these alone.
    """
    m = F.when(F.col(mask) > 0, 1)
    means = df.agg(F.avg(F.when(m == 1, F.col(advantage))).alias("_ma"), F.avg(F.when(m == 1, F.col(new))).alias("_ml"))
    rows = df.join(F.broadcast(means)).withColumn("_cov", (F.col(advantage) - F.col("_ma")) * (F.col(new) - F.col("_ml"))).drop("_ma", "_ml")
    rows = stored(rows, "covariances")
    top = top_covariance(rows, "_cov", mask, share, key).withColumn("_pays", F.lit(True))
    d = F.col(new) - F.col(old)
    loss = -F.col(advantage) * F.exp(d) + F.when(F.col("_pays"), weight * F.abs(d)).otherwise(0.0)
    return rows.join(top, key, "left").agg(_mean(loss, mask).alias("loss"), _mean(F.abs(d), mask).alias("kl"))


def sppo_loss(df: DataFrame, seq: list[str], old: str, new: str, reward: str, mask: str, eta: float = 1.0) -> DataFrame:
    """Mean of (sum of log ratios - eta * reward) squared over sequences."""
    per = df.groupBy(*seq).agg(F.sum((F.col(new) - F.col(old)) * F.col(mask)).alias("d"), F.max(reward).alias("r"))
    return per.agg(F.avg(F.pow(F.col("d") - eta * F.col("r"), 2)).alias("loss"))


def preference_loss(df: DataFrame, chosen: str, rejected: str, chosen_ref: str, rejected_ref: str, beta: float, smoothing: float = 0.0, kind: str = "sigmoid") -> DataFrame:
    """Mean preference loss over pairs: logistic with label smoothing, or the squared form (ipo)."""
    d = (F.col(chosen) - F.col(rejected)) - (F.col(chosen_ref) - F.col(rejected_ref))
    soft = lambda x: F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))  # noqa: E731  -log sigmoid
    x = {"sigmoid": soft(beta * d) * (1 - smoothing) + soft(-beta * d) * smoothing, "ipo": F.pow(d - 1 / (2 * beta), 2)}[kind]
    return df.agg(F.avg(x).alias("loss"), F.avg((d > 0).cast("double")).alias("accuracy"), F.avg(beta * d).alias("margin"))


def cross_entropy_reward_loss(df: DataFrame, seq: list[str], score: str, label: str, mask: str, beta: float) -> DataFrame:
    """Mean binary cross-entropy of sigmoid(beta * masked sum) with each sequence's label."""
    per = df.groupBy(*seq).agg((F.sum(F.col(score) * F.col(mask)) * beta).alias("z"), F.max(label).cast("double").alias("y"))
    return per.agg(F.avg(F.greatest(F.col("z"), F.lit(0.0)) - F.col("z") * F.col("y") + F.log1p(F.exp(-F.abs("z")))).alias("loss"))


def kl_rewards(df: DataFrame, seq: list[str], score: str, kl: Column, mask: str, beta: float) -> tuple[DataFrame, DataFrame]:
    """(df with `reward` = score - beta * KL on masked tokens, one row with the mean of sequences' mean KL)."""
    d = df.withColumn("_kl", kl * F.col(mask))
    per = d.groupBy(*seq).agg((F.sum("_kl") / (F.sum(mask) + 1e-8)).alias("k"))
    return d.withColumn("reward", F.col(score) - beta * F.col("_kl")).drop("_kl"), per.agg(F.avg("k").alias("kl"))


def next_beta(beta: float, kl: float, target: float, horizon: float, steps: int) -> float:
    """The adaptive controller's next weight: an error of at most a fifth, times steps / horizon."""
    return beta * (1 + max(-0.2, min(kl / target - 1, 0.2)) * steps / horizon)


def masked_stats(df: DataFrame, value: str, mask: str) -> DataFrame:
    """mean, sum, variance (Bessel) of masked values; null where there's no variance."""
    x = F.when(F.col(mask) > 0, F.col(value))
    return df.agg(F.avg(x).alias("mean"), F.sum(x).alias("sum"), F.var_samp(x).alias("variance"), F.count(x).alias("n"))


def sequence_log_prob(df: DataFrame, seq: list[str], log_prob: str, label: str, average: bool = False) -> DataFrame:
    """Sum or mean of log-probabilities over tokens whose label isn't -100."""
    x = F.when(F.col(label) != -100, F.col(log_prob))
    return df.groupBy(*seq).agg((F.avg(x) if average else F.coalesce(F.sum(x), F.lit(0.0))).alias("log_prob"))


def length_balance(df: DataFrame, part: str, length: str) -> DataFrame:
    """Smallest, largest and mean sum of lengths over partitions, and their difference."""
    s = df.groupBy(part).agg(F.sum(length).alias("s"))
    return s.agg(F.min("s").alias("least"), F.max("s").alias("most"), F.avg("s").alias("mean"), (F.max("s") - F.min("s")).alias("difference"))


def slowest(df: DataFrame, seconds: str, order: str, columns: list[str]) -> DataFrame:
    """min, max and mean of a timing with the columns of its slowest row, the first of equals."""
    top = F.max_by(F.struct(*columns), F.struct(F.col(seconds), -F.col(order)))
    return df.agg(F.min(seconds).alias("min"), F.max(seconds).alias("max"), F.avg(seconds).alias("mean"), top.alias("_t")).select("min", "max", "mean", *[F.col(f"_t.{c}").alias(f"slowest_{c}") for c in columns])


def pass_rate(df: DataFrame, key: list[str], order: str, ok: Column, first: int = 10) -> DataFrame:
    """1.0 where all tests pass, else the share of the first ten that do."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    g = df.withColumn("_ok", ok.cast("double")).withColumn("_at", at).groupBy(*key)
    return g.agg(F.when(F.min("_ok") == 1, 1.0).otherwise(F.avg(F.when(F.col("_at") <= first, F.col("_ok")))).alias("score"))


def dense_flops(hidden: int, layers: int, heads: int, kv_heads: int, intermediate: int, vocabulary: int, tokens: int, squares: int, seconds: float) -> float:
    """Achieved teraflops of a dense decoder step: 6 per parameter and token, 12 per head, layer and squared length."""
    size = hidden // heads
    attention = hidden * (2 * heads + 2 * kv_heads) * size
    parameters = layers * (attention + 3 * hidden * intermediate) + 2 * vocabulary * hidden
    return (6 * parameters * tokens + 12 * squares * size * heads * layers) / seconds / 1e12


def cosine_schedule(step: int, warmup: int, total: int, least: float = 0.0, cycles: float = 0.5) -> float:
    if step < warmup:
        return least + (1 - least) * step / max(1, warmup)
    x = (step - warmup) / max(1, total - warmup)
    return max(least, (1 + least) / 2 + (1 - least) / 2 * math.cos(math.pi * cycles * 2 * x))


def constant_schedule(step: int, warmup: int) -> float:
    return step / max(1.0, warmup) if step < warmup else 1.0


def stable_schedule(step: int, warmup: int, total: int, least: float = 0.0, cycles: float = 0.5, stable: float = 0.9) -> float:
    """Linear warm-up, a stable phase for a share of what remains, and a cosine down to `least`."""
    rest = max(0, total - warmup)
    flat = int(rest * stable)
    if step < warmup:
        return step / max(1, warmup)
    if step < warmup + flat:
        return 1.0
    if step >= total:
        return least
    x = (step - warmup - flat) / max(1, rest - flat)
    return (1 - least) * max(0.0, 0.5 * (1 + math.cos(2 * math.pi * cycles * x))) + least


def exponential_schedule(fraction: float, scale: float = 0.9, rate: float = 12.43) -> float:
    return scale * math.exp(-rate * fraction)


def bell_schedule(fraction: float) -> float:
    return 2 * fraction * math.exp(-4 * fraction) + 0.2


def entropy_loss(df: DataFrame, seq: list[str], entropy: str, mask: str) -> DataFrame:
    """A token's entropy averaged in each of the ways that losses are: mode, loss."""
    from .sequences import aggregate_loss

    return aggregate_loss(df, seq, entropy, mask)


# Peak floating-point operations a second by a part of the device's name, the first that fits.
PEAK = (("MI300X", 1336e12), ("H100", 989e12), ("H800", 989e12), ("H200", 989e12), ("A100", 312e12), ("A800", 312e12), ("L40", 181.05e12), ("L20", 119.5e12), ("H20", 148e12), ("910B", 354e12), ("RTX 3070 Ti", 21.75e12))
PREFIXES = "BKMGTP"


def peak_flops(device: str, prefix: str = "T") -> float:
    """A device's peak in the given unit; infinite for one that isn't known."""
    return next((n for name, n in PEAK if name in device), math.inf) / 1000 ** PREFIXES.index(prefix)


def expert_flops(hidden: int, layers: int, heads: int, kv_heads: int, expert: int, active: int, experts: int, vocabulary: int, tokens: int, squares: int, seconds: float, size: int | None = None) -> float:
    """Achieved teraflops of a decoder with experts, `active` of which see a token, and a gate over all."""
    size = size or hidden // heads
    layer = 3 * hidden * expert * active + hidden * experts + hidden * size * (2 * heads + 2 * kv_heads)
    return (6 * (layers * layer + 2 * vocabulary * hidden) * tokens + 12 * squares * size * heads * layers) / seconds / 1e12


def latent_flops(hidden: int, layers: int, heads: int, expert: int, active: int, shared: int, experts: int, dense_layers: int, intermediate: int, vocabulary: int, nope: int, rope: int, value: int, kv_rank: int, tokens: int, squares: int, seconds: float, q_rank: int | None = None) -> float:
    """The same with attention through low-rank projections, and `dense_layers` without experts."""
    q = nope + rope
    attention = hidden * heads * q if q_rank is None else q_rank * (hidden + heads * q)
    attention += hidden * (kv_rank + rope) + heads * (nope + value) * kv_rank + heads * value * hidden
    sparse = hidden * experts + 3 * hidden * expert * (active + shared) + attention
    parameters = sparse * (layers - dense_layers) + (3 * hidden * intermediate + attention) * dense_layers + 2 * vocabulary * hidden
    return (6 * parameters * tokens + 12 * squares * layers * q * heads) / seconds / 1e12


def achieved(lengths: DataFrame, length: str) -> tuple[int, int]:
    """(tokens, sum of squared lengths) of a batch, in one aggregation: what the estimates above take."""
    row = lengths.agg(F.sum(F.col(length).cast("long")), F.sum(F.col(length).cast("long") * F.col(length))).first()
    return int(row[0] or 0), int(row[1] or 0)
