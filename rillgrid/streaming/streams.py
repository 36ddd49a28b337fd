"""Structured Streaming forms of the engine's stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillgrid.operators.batch import first_rows, number_rows
from rillgrid.operators.sampling import unprocessed, upsert
from rillgrid.operators.stored import stored
from rillgrid.sources.readers import read_checkpoint, write_checkpoint


def windowed_totals(events: DataFrame, time: str, value: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums for each window, final once the watermark passes it."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def session_totals(events: DataFrame, time: str, value: str, keys: list[str], gap: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("session_window.start").alias("start"), *keys, "n", "total")


def deduplicate(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def turn_loop(turns: DataFrame, most_turns: int, most_tokens: int, stop: str = "<answer>") -> DataFrame:
    """(conv_id, turns, tokens, reason) of each conversation as it ends: at `stop`, at its turns or at its tokens.

    State is three numbers for each conversation; turns after the end are ignored.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, tokens, done = state.get if state.exists else (0, 0, False)
        out = []
        rows = pd.concat(list(batches)).sort_values("turn")
        for text in rows["text"].fillna(""):
            if done:
                break
            n, tokens = n + 1, tokens + len(text.split())
            reason = "answer" if stop in text else "turns" if n >= most_turns else "tokens" if tokens >= most_tokens else None
            if reason:
                done = True
                out.append((key[0], n, tokens, reason))
        state.update((n, tokens, done))
        yield pd.DataFrame(out, columns=["conv_id", "turns", "tokens", "reason"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turns long, tokens long, reason string", "turns long, tokens long, done boolean", "append", GroupStateTimeout.NoTimeout)


def resumed(rows: DataFrame, key: str, size: int, work: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Rows that `path` doesn't hold yet, through `work` in batches of `size` by key order, each written before the next begins; all results.

    Started again, it goes on after the last batch written.
    """
    spark = rows.sparkSession
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(here)
    left = unprocessed(rows, spark.read.parquet(path), key) if there else rows
    numbered = number_rows(left, key, name="_n").withColumn("_b", F.floor(F.col("_n") / size))
    n = numbered.agg(F.max("_b")).first()[0]
    for b in range(-1 if n is None else int(n) + 1):
        work(numbered.filter(F.col("_b") == b).drop("_n", "_b")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def retried(rows: DataFrame, key: str, failed: Column, work: Callable[[DataFrame, int], DataFrame], passes: int) -> tuple[DataFrame, int]:
    """rows with the failed ones done again, up to `passes` times; it ends early when none is left.  And the passes made."""
    made = 0
    for k in range(passes):
        again = rows.filter(failed)
        if again.isEmpty():
            break
        rows = stored(upsert(rows, work(again, k), key), f"pass{k}")
        made += 1
    return rows, made


def failed_generation(text: Column, correct: Column, length: Column, longest: int | None) -> Column:
    """A row without text, without a verdict, with a wrong one, or longer than allowed."""
    bad = (F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0) | ~F.coalesce(correct, F.lit(False))
    return bad if longest is None else bad | F.coalesce(length > longest, F.lit(True))


def processed_generation(text: Column, metadata: Column) -> Column:
    return (F.coalesce(F.length(text), F.lit(0)) > 0) & metadata.isNotNull()


def learnable(text: Column, correct: Column, length: Column) -> Column:
    """A right answer of known length with a text that isn't blank."""
    return F.coalesce(correct & length.isNotNull() & (F.length(F.trim(text)) > 0), F.lit(False))


def run_now(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Everything that a stream's source has, in micro-batches, each to a folder of its own; the batch that is done again replaces its folder.

    In complete mode the last batch holds all.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows/batch=*")


def running_means(rows: DataFrame, source: str, score: Column) -> DataFrame:
    """Each source's mean score so far: complete after each micro-batch."""
    return rows.groupBy(source).agg(F.avg(score).alias("score"), F.count(F.lit(1)).alias("n"))


def filled(batches: Iterator[DataFrame], keep: Callable[[DataFrame], DataFrame], group: list[str], order: str, prompts: int, rows_each: int, most_batches: int = 10) -> DataFrame:
    """Batches, filtered, until they hold `prompts` groups; then the first so many groups' rows.

    An error if that takes over `most_batches` batches.
    """
    kept = None
    for k, batch in enumerate(batches):
        one = stored(keep(batch), f"kept{k}")
        kept = one if kept is None else kept.unionByName(one)
        if kept.select(*group).distinct().count() >= prompts:
            first = first_rows(kept.groupBy(*group).agg(F.min(order).alias("_o")), prompts, "_o").select(*group)
            cut = kept.join(first, group, "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(order)))
            return cut.filter(F.col("_k") <= rows_each).drop("_k")
        if k + 1 >= most_batches:
            break
    raise ValueError("the batches don't fill")


def train(spark: SparkSession, batches: Callable[[int], DataFrame], step: Callable[[DataFrame, int], dict], epochs: int, steps: int, path: str, refresh: Callable[[int], None] | None = None, every: int = 0) -> list[dict]:
    """The outer loop: `steps` batches an epoch through `step`, the place written after each; started again it goes on there.

    refresh is called every so many steps, as for a reference model.
    """
    done, position = read_checkpoint(spark, path)
    out = []
    for n in range(done, epochs * steps):
        metrics = step(batches(n % steps), n)
        out.append(metrics)
        write_checkpoint(spark, path, n + 1, {"epoch": n // steps, "batch": n % steps + 1})
        if refresh and every and (n + 1) % every == 0:
            refresh(n + 1)
    return out
