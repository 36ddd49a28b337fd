"""Evaluation summaries: accuracy roll-ups, validation metrics, votes and bootstrap."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import number_rows
from .stored import stored


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def accuracy_rollup(df: DataFrame, variant: str, correct: str, too_long: str) -> DataFrame:
    """Per variant and in total: accuracies, the share of errors that length explains, and six counts."""
    n = lambda c: F.sum(c.cast("long"))
    ok, cut = F.col(correct), F.col(too_long)
    g = df.rollup(variant).agg(
        F.grouping_id().alias("_g"), n(ok).alias("correct"), F.count(F.lit(1)).alias("total"), n(ok & ~cut).alias("correct_excl_length"), n(~cut).alias("total_excl_length"), n(~ok & cut).alias("incorrect_due_to_length"), n(~ok).alias("total_incorrect")
    )
    c = F.col
    return g.select(
        F.when(c("_g") == 1, F.lit("total")).otherwise(c(variant)).alias("variant"),
        _ratio(c("correct"), c("total")).alias("accuracy"), _ratio(c("correct_excl_length"), c("total_excl_length")).alias("accuracy_excl_length"), _ratio(c("incorrect_due_to_length"), c("total_incorrect")).alias("prop_incorrect_due_to_length"),
        "correct", "total", "correct_excl_length", "total_excl_length", "incorrect_due_to_length", "total_incorrect",
    )


def mean_std_by_prompt(df: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """Means over prompts of each prompt's mean and population deviation, per source."""
    per = df.groupBy(source, prompt).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(source).agg(F.avg("m").alias("mean"), F.avg("s").alias("std"), F.max("n").alias("n_max"), F.count(F.lit(1)).alias("prompts"))


def majority_vote(df: DataFrame, group: list[str], vote: str, value: str, order: str) -> DataFrame:
    """Per group the most frequent vote, ties to the one seen first, and the value at its first row."""
    votes = df.groupBy(*group, vote).agg(F.count(F.lit(1)).alias("votes"), F.min_by(F.struct(F.col(order).alias("o"), F.col(value).alias("v")), order).alias("f"))
    best = votes.groupBy(*group).agg(F.max_by(F.struct(F.col(vote).alias("vote"), "votes", "f"), F.struct(F.col("votes"), -F.col("f.o"))).alias("b"))
    return best.select(*group, F.col("b.vote").alias("vote"), F.col("b.votes").alias("votes"), F.col("b.f.v").alias("value"))


def expected_best(df: DataFrame, group: list[str], value: str, n: int) -> DataFrame:
    """Expected largest and smallest of n draws with replacement, from the order statistics."""
    w = Window.partitionBy(*group).orderBy(value)
    size = F.count(F.lit(1)).over(Window.partitionBy(*group))
    r = F.row_number().over(w)
    ranked = df.withColumn("_hi", F.pow(r / size, F.lit(n)) - F.pow((r - 1) / size, F.lit(n))).withColumn("_lo", F.pow(1 - (r - 1) / size, F.lit(n)) - F.pow(1 - r / size, F.lit(n)))
    return ranked.groupBy(*group).agg(F.sum(F.col(value) * F.col("_hi")).alias(f"best_{n}"), F.sum(F.col(value) * F.col("_lo")).alias(f"worst_{n}"))


def bootstrap(values: list | np.ndarray, size: int, reduce: Callable, draws: int = 1000, seed: int = 42) -> tuple[float, float]:
    """Mean and population deviation of `reduce` over `draws` samples with replacement."""
    if len(values) == 0:
        raise ValueError("no values to draw from")
    x = [reduce([values[i] for i in drawn]) for drawn in _draws(len(values), size, draws, seed)]
    return float(np.mean(x)), float(np.std(x))


def _draws(n: int, size: int, draws: int, seed: int) -> np.ndarray:
    """The places that `draws` samples of `size` take, a row each: the stream of RandomState(seed).choice, drawn at once."""
    return np.random.RandomState(seed).choice(n, size=(draws, size), replace=True)


def _majority(values: np.ndarray, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each sample the value of the first draw of its most frequent code, of equals the one drawn first."""
    drawn = codes[at]
    counts = np.zeros((len(at), int(codes.max()) + 1), np.int64)
    np.add.at(counts, (np.arange(len(at))[:, None], drawn), 1)
    best = np.take_along_axis(counts, drawn, 1).argmax(1)
    return values[at[np.arange(len(at)), best]]


def bootstrap_by_prompt(df: DataFrame, source: str, prompt: str, value: str, vote: str | None = None, draws: int = 1000, seed: int = 42, order: str | None = None) -> DataFrame:
    """Per source and n = 2, 4, 8, ... up to a prompt's rows: bootstrap best, worst and majority, averaged over prompts."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_o")
        n, out, size = len(rows), [], 2
        sizes = []
        while size < n:
            sizes.append(size)
            size *= 2
        values, codes = rows["v"].to_numpy(), pd.factorize(rows["k"])[0]
        for size in [*sizes, n] if n > 1 else []:
            at = _draws(n, size, draws, seed)
            kinds = {"best": values[at].max(1), "worst": values[at].min(1)} | ({"maj": _majority(values, codes, at)} if vote else {})
            out += [(rows["source"].iloc[0], size, name, float(x.mean()), float(x.std())) for name, x in kinds.items()]
        return pd.DataFrame(out, columns=["source", "n", "metric", "mean", "std"])

    place = F.col(order) if order else F.monotonically_increasing_id()
    slim = df.select(F.col(source).alias("source"), F.col(prompt).cast("string").alias("p"), F.col(value).cast("double").alias("v"), (F.col(vote).cast("string") if vote else F.lit("")).alias("k"), place.alias("_o"))
    per = slim.groupBy("source", "p").applyInPandas(one, "source string, n int, metric string, mean double, std double")
    return per.groupBy("source", "n", "metric").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def metric_section(variable: str, core: str, metric: Column, n: Column, n_max: Column) -> Column:
    """val-core for the core variable's mean, majority and best at the largest n; val-aux for all others."""
    main = (F.lit(variable == core)) & (n == n_max) & metric.rlike("^(mean|maj|best)")
    return F.when(main, F.lit("val-core")).otherwise(F.lit("val-aux"))


def data_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean, max and min of each column."""
    return df.agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])


def explained_variance(df: DataFrame, returns: str, values: str) -> DataFrame:
    return df.agg((1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"))


def timing_metrics(df: DataFrame, stage: str, seconds: str, tokens: dict[str, int], default: int) -> DataFrame:
    """Seconds and milliseconds for each token of a stage; stages without a token count of their own use `default`."""
    n = F.coalesce(F.create_map(*[F.lit(x) for kv in tokens.items() for x in kv])[F.col(stage)], F.lit(default)) if tokens else F.lit(default)
    return df.groupBy(stage).agg(F.sum(seconds).alias("seconds")).withColumn("ms_per_token", F.col("seconds") * 1000 / n)


def throughput(tokens: int, seconds: float, devices: int) -> float:
    return tokens / (seconds * devices)


def reduce_by_name(df: DataFrame, name: str, value: str) -> DataFrame:
    """Per metric: its largest value if its name holds `max`, its smallest if it holds `min`, else the mean."""
    c = F.col(name)
    return df.groupBy(name).agg(F.avg(value).alias("a"), F.max(value).alias("b"), F.min(value).alias("c")).select(name, F.when(c.contains("max"), F.col("b")).when(c.contains("min"), F.col("c")).otherwise(F.col("a")).alias("value"))


def mean_of_means(df: DataFrame, row: list[str], source: str, value: Column) -> DataFrame:
    per = df.groupBy(*row, source).agg(F.avg(value).alias("m"))
    return per.groupBy(source).agg(F.avg("m").alias("score"), F.count(F.lit(1)).alias("n"))


def masked_mean(df: DataFrame, value: str, mask: str) -> DataFrame:
    return df.agg((F.sum(F.col(value) * F.col(mask)) / (F.sum(mask) + 1e-8)).alias("masked_mean"))


def response_info(df: DataFrame, mask: str, response: int) -> DataFrame:
    """df with prompt_length, response_length and response_mask of an attention mask whose last `response` places are the response's."""
    n = F.size(mask)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    rows = df.withColumn("response_mask", F.slice(mask, n - response + 1, F.lit(response)))
    return rows.withColumn("response_length", total(F.col("response_mask"))).withColumn("prompt_length", total(F.col(mask)) - F.col("response_length"))


def length_metrics(df: DataFrame, length: str, longest: int, name: str) -> DataFrame:
    """metric, value: mean, max, min of a length, and how often it is the longest possible."""
    x = F.col(length).cast("double")
    one = df.agg(F.avg(x).alias("mean"), F.max(x).alias("max"), F.min(x).alias("min"), F.avg((x == longest).cast("double")).alias("clip_ratio"))
    return one.unpivot([], one.columns, "metric", "value").withColumn("metric", F.concat(F.lit(f"{name}/"), "metric"))


def training_metrics(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """metric, value: mean, max and min of each column that the table has; name: the column, an array being summed up first."""
    there = {name: c for name, c in columns.items() if c in df.columns}
    kinds = dict(df.dtypes)
    x = {n: F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda s, v: s + v) if kinds[c].startswith("array") else F.col(c).cast("double") for n, c in there.items()}
    if not x:
        return df.sparkSession.createDataFrame([], "metric string, value double")
    one = df.agg(*[f(c).alias(f"{n}/{k}") for n, c in x.items() for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])
    return one.unpivot([], one.columns, "metric", "value")


def preference_metrics(df: DataFrame, longest_prompt: int, longest_response: int) -> DataFrame:
    """metric, value of preference training: scores, rewards and lengths as above, means of log-probabilities; absent columns are left out."""
    out = training_metrics(df, {"reward/score": "token_level_scores", "reward/rewards": "token_level_rewards"})
    means = {f"actor/{c}": c for c in ("dpo_logits", "chosen_logps", "rejected_logps") if c in df.columns}
    if means:
        one = df.agg(*[F.avg(c).alias(n) for n, c in means.items()])
        out = out.unionByName(one.unpivot([], one.columns, "metric", "value"))
    for name, longest in (("response_length", longest_response), ("prompt_length", longest_prompt)):
        if name in df.columns:
            out = out.unionByName(length_metrics(df, name, longest, name))
    return out


def appended(metrics: DataFrame, step: int) -> DataFrame:
    """metric, value rows of one step, for a table of all steps' values."""
    return metrics.select(F.lit(step).alias("step"), "metric", F.col("value").cast("double").alias("value"))


def mean_by_name(df: DataFrame, name: str, value: str) -> DataFrame:
    """Each name's mean over micro-batches or processes."""
    return df.groupBy(name).agg(F.avg(value).alias(value))


def spread(df: DataFrame, value: str) -> DataFrame:
    """One row over all ranks' rows: mean, max, min and sample deviation."""
    return df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"))


def exact_masked_mean(df: DataFrame, value: str, mask: str) -> DataFrame:
    """Sum of masked values over the sum of the mask, null where that is 0."""
    return df.agg(F.try_divide(F.sum(F.col(value) * F.col(mask)), F.sum(mask)).alias("masked_mean"))


def masked_variance(df: DataFrame, value: str, mask: str, unbiased: bool = True) -> DataFrame:
    """The variance of masked values; an error without one, or with a single one where Bessel's correction is asked for."""
    x = F.when(F.col(mask) > 0, F.col(value))
    n = F.count(x)
    bad = F.when(n == 0, F.raise_error(F.lit("the mask is empty"))).when(F.lit(unbiased) & (n == 1), F.raise_error(F.lit("the mask has one element")))
    return df.agg(F.coalesce(bad.cast("double"), F.var_samp(x) if unbiased else F.var_pop(x)).alias("variance"))


def squares(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sum(F.col(value) * F.col(value)).alias("sum_of_squares"))


def probability_difference(df: DataFrame, one: str, other: str, mask: str) -> DataFrame:
    """max, mean and sample deviation of two log-probabilities' difference as probabilities, over masked tokens."""
    d = F.when(F.col(mask) > 0, F.abs(F.exp(one) - F.exp(other)))
    return df.agg(F.max(d).alias("max"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"))


def retry_counts(before: DataFrame, after: DataFrame, correct: str, length: str, longest: int) -> DataFrame:
    """One row: correct rows, and those within `longest`, before and after a retry."""

    def one(df, name):
        ok = F.coalesce(F.col(correct), F.lit(False))
        return df.agg(F.count_if(ok).alias(f"correct_{name}"), F.count_if(ok & F.coalesce(F.col(length) <= longest, F.lit(False))).alias(f"short_{name}"))

    return one(before, "before").join(one(after, "after"))


def largest_index(df: DataFrame, index: str = "index") -> int | None:
    """The largest whole number in a column of any type, None without one."""
    return df.agg(F.max(F.expr(f"try_cast(`{index}` AS bigint)"))).first()[0]


def metric_in_line(line: Column, name: str) -> Column:
    """The number after `name:` in a line of a log."""
    return F.regexp_extract(line, rf"{name}:\s*(?:np\.float64\()?(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")


def token_lengths(df: DataFrame, mask: str, order: str) -> tuple[DataFrame, int]:
    """df with `length` and `offset`, the tokens of all rows before it, from masks; and the largest length."""
    rows = df.withColumn("length", F.aggregate(F.col(mask).cast("array<long>"), F.lit(0).cast("long"), lambda s, x: s + x))
    numbered = stored(number_rows(rows, order, name="_at").withColumn("_part", F.floor(F.col("_at") / 4096)), "lengths")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = numbered.groupBy("_part").agg(F.sum("length").alias("_s")).select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inner = F.sum("length").over(Window.partitionBy("_part").orderBy("_at")) - F.col("length")
    out = numbered.join(blocks, "_part").withColumn("offset", F.col("_before") + inner).drop("_at", "_part", "_before")
    return out, int(numbered.agg(F.max("length")).first()[0] or 0)


def validate(df: DataFrame, samples: int, answer: Callable[[DataFrame], DataFrame], scorer: Callable[[DataFrame], Column], source: str, prompt: str, vote: str | None = None, draws: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(rows with their score, name and value of all validation metrics): each row is answered `samples` times, scored and summed up.

    answer: rows with a `sample` number to the same with a response.  Core metrics are those of the
    most samples.
    """
    rows = df.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    scored = stored(_scored(answer(rows), scorer), "scored")
    means = mean_std_by_prompt(scored, source, prompt, "score")
    named = means.select(source, F.explode(F.array(F.struct(F.lit("mean").alias("metric"), F.col("n_max").cast("int").alias("n"), F.col("mean").alias("value")), F.struct(F.lit("std").alias("metric"), F.col("n_max").cast("int").alias("n"), F.col("std").alias("value")))).alias("m")).select(source, "m.*")
    if samples > 1:
        boot = bootstrap_by_prompt(scored, source, prompt, "score", vote, draws, order="sample").withColumnRenamed("source", source)
        parts = [boot.select(source, F.concat("metric", F.lit(f"/{k}")).alias("metric"), "n", F.col(k).alias("value")) for k in ("mean", "std")]
        named = named.unionByName(parts[0]).unionByName(parts[1])
    section = metric_section("score", "score", F.col("metric"), F.col("n"), F.lit(samples))
    return scored, named.select(F.concat(section, F.lit("/"), F.col(source), F.lit("/score/"), F.col("metric"), F.lit("@"), F.col("n").cast("string")).alias("name"), "value")


def _scored(rows: DataFrame, scorer: Callable[[DataFrame], Column]) -> DataFrame:
    return rows.withColumn("score", scorer(rows).cast("double"))
