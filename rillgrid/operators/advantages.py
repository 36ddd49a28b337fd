"""Group-relative statistics and advantages of scored rows, as aggregations that meet their rows again by a join or window.

Sums are taken by partial aggregation before a group's rows are shuffled; only what needs the
order within a group is a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import first_rows, number_rows
from .stored import stored


def _group(df: DataFrame, group: list[str], **stats: Column) -> DataFrame:
    """df with statistics of each group, summed apart and joined back; null keys are a group too."""
    found = df.groupBy(*group).agg(*[c.alias(k) for k, c in stats.items()])
    keys = {g: f"_k_{g}" for g in group}
    right = found.withColumnsRenamed(keys)
    on = None
    for g, k in keys.items():
        on = df[g].eqNullSafe(right[k]) if on is None else on & df[g].eqNullSafe(right[k])
    return df.join(right, on).drop(*keys.values())


def group_zscore(df: DataFrame, group: list[str], score: str, eps: float = 1e-6, by_std: bool = True, out: str = "advantage") -> DataFrame:
    """(score - mean) / (sample deviation + eps); a group of one row has mean 0 and deviation 1."""
    g = _group(df, group, _n=F.count(F.lit(1)), _m=F.avg(score), _s=F.stddev_samp(score))
    one = F.col("_n") == 1
    centred = F.col(score) - F.when(one, 0.0).otherwise(F.col("_m"))
    scale = F.when(one, 1.0).otherwise(F.col("_s")) + eps
    return g.withColumn(out, centred / scale if by_std else centred).drop("_n", "_m", "_s")


def best_minus_second(df: DataFrame, group: list[str], score: str, tie: str, eps: float = 1e-6, by_std: bool = False, out: str = "advantage") -> DataFrame:
    """The best row of a group gets its lead over the second, all others 0; groups of one are left out."""
    g = _group(df, group, _n=F.count(F.lit(1)), _s=F.stddev_samp(score), _top=F.max_by(F.struct(score, tie), F.struct(F.col(score), -F.col(tie))))
    g = g.filter("_n > 1")
    best = F.col(tie) == F.col(f"_top.{tie}")
    # the second is the best of the others, again a sum by group
    second = g.filter(~best).groupBy(*group).agg(F.max(score).alias("_second"))
    g = g.join(second.withColumnsRenamed({c: f"_k_{c}" for c in group}), [g[c].eqNullSafe(F.col(f"_k_{c}")) for c in group]).drop(*[f"_k_{c}" for c in group])
    lead = F.col(f"_top.{score}") - F.col("_second")
    return g.withColumn(out, F.when(best, lead / (F.col("_s") + eps) if by_std else lead).otherwise(0.0)).drop("_n", "_s", "_top", "_second")


def leave_one_out(df: DataFrame, group: list[str], score: str, out: str = "advantage") -> DataFrame:
    """score less the mean of the group's other rows; a group of one keeps its score."""
    g = _group(df, group, _n=F.count(F.lit(1)), _m=F.avg(score))
    n = F.col("_n")
    return g.withColumn(out, F.when(n > 1, (F.col(score) - F.col("_m")) * n / (n - 1)).otherwise(F.col(score))).drop("_n", "_m")


def length_weighted(df: DataFrame, group: list[str], score: str, length: str, out: str = "advantage") -> DataFrame:
    """score less the group's mean weighted by length; a group of one has baseline 0."""
    g = _group(df, group, _n=F.count(F.lit(1)), _w=F.sum(F.col(score) * F.col(length)), _l=F.sum(length))
    return g.withColumn(out, F.col(score) - F.when(F.col("_n") > 1, F.col("_w") / F.col("_l")).otherwise(0.0)).drop("_n", "_w", "_l")


def whiten(df: DataFrame, value: str, mask: str | None = None, shift_mean: bool = True, out: str = "whitened", eps: float = 1e-8) -> DataFrame:
    """(value - mean) / sqrt(variance + eps) over rows with mask 1, Bessel-corrected; one pass for the sums.

    Rows outside the mask are scaled alike.  With one masked row or none there is no variance: null.
    """
    m = F.lit(1.0) if mask is None else F.col(mask).cast("double")
    x = F.when(m > 0, F.col(value))
    stats = df.agg(F.avg(x).alias("_white_m"), F.var_samp(x).alias("_white_v"))
    w = (F.col(value) - F.col("_white_m")) / F.sqrt(F.col("_white_v") + eps)
    return df.join(F.broadcast(stats)).withColumn(out, w if shift_mean else w + F.col("_white_m")).drop("_white_m", "_white_v")


def group_mean_baseline(df: DataFrame, group: list[str], score: str, out: str = "advantage") -> DataFrame:
    """score less the group's mean (0 for a group of one), then whitened over all rows."""
    g = _group(df, group, _n=F.count(F.lit(1)), _m=F.avg(score))
    g = g.withColumn("_x", F.col(score) - F.when(F.col("_n") > 1, F.col("_m")).otherwise(0.0))
    return whiten(g, "_x", out=out).drop("_n", "_m", "_x")


def softmean(value: Column, beta: float, top: Column) -> Column:
    """(1 / beta) * log(mean(exp(beta * value))), an aggregate; top: the largest value of its rows, which keeps exponents small."""
    return F.avg(value) if beta == 0 else (F.max(top) * beta + F.log(F.avg(F.exp(beta * (value - top))))) / beta


def softmean_baseline(df: DataFrame, score: str, beta: float = 1.0, group: list[str] | None = None, out: str = "advantage") -> DataFrame:
    """score less the softmean of all rows, or of the row's group: the mean if beta is 0.

    Two aggregations and no window, so that no task gathers all rows.
    """
    if group:
        top = _group(df, group, _t=F.max(F.col(score)) if beta >= 0 else F.min(F.col(score)))
        g = _group(top, group, _b=softmean(F.col(score), beta, F.col("_t")))
    else:
        top = df.join(F.broadcast(df.agg((F.max(score) if beta >= 0 else F.min(score)).alias("_t"))))
        g = top.join(F.broadcast(top.agg(softmean(F.col(score), beta, F.col("_t")).alias("_b"))))
    return g.withColumn(out, F.col(score) - F.col("_b")).drop("_t", "_b")


def keep_varied_groups(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """Rows of groups whose scores differ (population deviation above 0) or that have one row."""
    return _group(df, group, _n=F.count(F.lit(1)), _low=F.min(score), _high=F.max(score)).filter("_n = 1 OR _low < _high").drop("_n", "_low", "_high")


def filter_downsample(df: DataFrame, group: list[str], score: str, length: str, low: float, high: float, longest: int, oversample: float) -> DataFrame:
    """Of all groups, one in `oversample`: first those with a mean score in [low, high] and no row over `longest`, by key."""
    stats = df.groupBy(*group).agg(F.avg(score).alias("_m"), F.max(length).alias("_l"))
    stats = stats.withColumn("_bad", (~(F.col("_m").between(low, high) & (F.col("_l") <= longest))).cast("int"))
    kept = first_rows(stats, int(stats.count() / oversample), "_bad", *group).select(*group)
    return df.join(kept, group, "left_semi")


def opposite_mean(df: DataFrame, group: list[str], q: str, accuracy: str, out: str = "other") -> DataFrame:
    """The mean q of the group's rows on the other side: of a lower accuracy where the row's own is above 0, else of a higher; 0 without any.

    Sums by (group, accuracy) and running sums over them stand in for a join of all pairs; a
    group's accuracies are as few as its scores' kinds.
    """
    per = df.groupBy(*group, accuracy).agg(F.sum(q).alias("_s"), F.count(q).alias("_n"))
    lower = Window.partitionBy(*group).orderBy(accuracy).rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy(*group).orderBy(accuracy).rowsBetween(1, Window.unboundedFollowing)
    pick = lambda c: F.when(F.col(accuracy) > 0, F.sum(c).over(lower)).otherwise(F.sum(c).over(higher))
    mean = per.select(*group, accuracy, F.coalesce(pick("_s") / pick("_n"), F.lit(0.0)).alias(out))
    return df.join(mean, [*group, accuracy])


def detached_preference_loss(df: DataFrame, group: list[str], q: str, accuracy: str, beta: float, best_of: str | None = None) -> DataFrame:
    """One row, `loss`: mean of -log sigmoid(+-(beta * q - beta * other)), with other from opposite_mean.

    best_of "rm" or "acc" weighs rows by n * share ** (n - 1), share the part of the group's n rows
    with no higher q or accuracy, and sums.
    """
    rows = opposite_mean(df, group, q, accuracy)
    x = beta * (F.col(q) - F.col("other")) * F.when(F.col(accuracy) > 0, 1.0).otherwise(-1.0)
    rows = rows.withColumn("_x", F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))
    if best_of is None:
        return rows.agg(F.avg("_x").alias("loss"))
    by = {"rm": q, "acc": accuracy}[best_of]
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    share = F.cume_dist().over(Window.partitionBy(*group).orderBy(by))
    return rows.withColumn("_w", n * F.pow(share, n - 1)).agg(F.sum(F.col("_x") * F.col("_w")).alias("loss"))


def sign_accuracy(df: DataFrame, score: str, accuracy: str) -> DataFrame:
    """One row: how often the score's sign is that of 2 * accuracy - 1."""
    return df.agg(F.avg((F.signum(score) == F.signum(2 * F.col(accuracy) - 1)).cast("double")).alias("accuracy"))


def pairwise_differences(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """value_i - value_j of all pairs i < j of a group: for groups of a bounded size, as the samples of one prompt."""
    a = df.select(*group, F.col(order).alias("i"), F.col(value).alias("_a"))
    b = df.select(*group, F.col(order).alias("j"), F.col(value).alias("_b"))
    return a.join(b, group).filter("i < j").select(*group, "i", "j", (F.col("_a") - F.col("_b")).alias("difference"))


def weighted_pair_accuracy(df: DataFrame, group: list[str], order: str, score: str, accuracy: str) -> DataFrame:
    """Per group: how far the order of scores agrees with that of accuracies, pairs weighted by the accuracies' difference; 0.5 without one."""
    s = pairwise_differences(df, group, order, score).withColumnRenamed("difference", "_s")
    a = pairwise_differences(df, group, order, accuracy).withColumnRenamed("difference", "_a")
    w = F.abs("_a")
    agree = ((F.col("_s") > 0) == (F.col("_a") > 0)).cast("double")
    return s.join(a, [*group, "i", "j"]).groupBy(*group).agg(F.when(F.sum(w) > 0, F.sum(agree * w) / F.sum(w)).otherwise(0.5).alias("accuracy"))


def resampling_weight(df: DataFrame, score: str, method: str = "pow", power: float = 2.0, out: str = "weight") -> DataFrame:
    """Weights for drawing rows anew: |score| ** power, 1 for the largest and smallest score, or 0.4 for the largest and 0.1 else; 1e-8 at least."""
    s = F.col(score)
    if method == "pow":
        rows, w = df, F.pow(F.abs(s), power)
    elif method in ("max_min", "max_random"):
        rows = df.join(F.broadcast(df.agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"))))
        w = F.when((s == F.col("_hi")) | (s == F.col("_lo")), 1.0).otherwise(0.0) if method == "max_min" else F.when(s == F.col("_hi"), 0.4).otherwise(0.1)
    else:
        raise ValueError(method)
    return rows.withColumn(out, F.greatest(w + 1e-8, F.lit(1e-8))).drop("_hi", "_lo")


def resample(df: DataFrame, weight: str, key: list[str], seed: object, draws: int | None = None) -> DataFrame:
    """`draws` rows (as many as there are) drawn with replacement in proportion to their weight.

    A row of weight w covers w / total of the draws' unit interval, at its place in key order, and
    comes once for each draw (i + u_i) / draws that falls in it, u_i being hashed from the seed: systematic sampling,
    with the expected number of each row and no gathering of all rows.  Draws are dealt out by the
    range that a row covers, so a heavy row of any share is exploded where it stands.
    """
    numbered = number_rows(df.select(*key, F.col(weight).cast("double").alias("_w")), *key, name="_at")
    ranged = stored(numbered.withColumn("_part", F.floor(F.col("_at") / 4096)), "weights")
    sums = ranged.groupBy("_part").agg(F.sum("_w").alias("_s"))
    # blocks of 4096 rows: their running sums are a thousandth part of the rows, and sorted in ranges too
    blocks = stored(sums, "blocks")
    before = blocks.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    total, n = blocks.agg(F.sum("_s")).first()[0] or 0.0, df.count() if draws is None else draws
    inner = F.sum("_w").over(Window.partitionBy("_part").orderBy("_at"))
    placed = ranged.join(before, "_part").withColumn("_end", (F.col("_before") + inner) / total * n).withColumn("_start", F.col("_end") - F.col("_w") / total * n)
    u = lambda i: F.pmod(F.xxhash64(F.lit(str(seed)), i), F.lit(1 << 30)) / F.lit(float(1 << 30))
    hits = F.filter(F.sequence(F.greatest(F.floor("_start"), F.lit(0)), F.floor("_end")), lambda i: (i < n) & (i + u(i) >= F.col("_start")) & (i + u(i) < F.col("_end")))
    drawn = placed.select(*key, F.explode(hits).alias("draw"))
    return df.join(drawn, key)


def until_full(df: DataFrame, group: list[str], order: str, prompts: int, score: str) -> DataFrame:
    """Rows of the first `prompts` groups, by their first row, whose scores vary or that have one row: a generation batch filled from varied groups."""
    kept = keep_varied_groups(df, group, score)
    first = kept.groupBy(*group).agg(F.min(order).alias("_o"))
    return kept.join(first_rows(first, prompts, "_o").select(*group), group, "left_semi")


def pair_preferences(df: DataFrame, pair: Column, order: str, score: str) -> DataFrame:
    """Rows with chosen: of each pair of neighbours the one with the higher score, the first of equals."""
    d = df.withColumn("_pair", pair)
    keys = Window.partitionBy("_pair").orderBy(F.col(score).desc(), order)
    return d.withColumn("chosen", F.row_number().over(keys) == 1).withColumnRenamed("_pair", "pair")


def ordered_pair_accuracy(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Per group: pairs of rows of different label, and the share in which the better one scores higher (ties half).

    A rank sum gives it without forming the pairs.
    """
    ranked = df.withColumn("_r", F.rank().over(Window.partitionBy(*group).orderBy(score)))
    ties = Window.partitionBy(*group, score)
    ranked = ranked.withColumn("_r", F.col("_r") + (F.count("*").over(ties) - 1) / 2)
    s = ranked.groupBy(*group).agg(F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("_ranks"), F.count(F.when(F.col(label) == 1, 1)).alias("_pos"), F.count(F.when(F.col(label) == 0, 1)).alias("_neg"))
    pairs = F.col("_pos") * F.col("_neg")
    return s.select(*group, pairs.alias("pairs"), F.when(pairs > 0, (F.col("_ranks") - F.col("_pos") * (F.col("_pos") + 1) / 2) / pairs).alias("accuracy"))
