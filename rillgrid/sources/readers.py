"""Readers and writers of the engine's tables: JSON Lines, CSV and Parquet through Spark's own sources."""

from __future__ import annotations

import dataclasses
import json
import time
from collections.abc import Callable
from enum import Enum
from functools import reduce
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgrid.functions.batched import batched
from rillgrid.operators.batch import number_rows
from rillgrid.operators.metrics import accuracy_rollup

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
RL_RECORD = T.StructType([T.StructField("prompt", MESSAGES), T.StructField("reward_model", T.StringType()), T.StructField("metadata", T.StringType()), T.StructField("index", T.LongType())])
GROUP = T.StructType([T.StructField("description", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("contest", T.StringType())])


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of one schema, or of several that are merged by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def combined_configs(spark: SparkSession, configs: dict[str, list[str]], *order: str) -> dict[str, DataFrame]:
    """For each config all of its splits' files as one table with a running index."""
    return {name: indexed(parquet(spark, *paths).withColumn("_o", F.monotonically_increasing_id()) if not order else parquet(spark, *paths), *(order or ("_o",))).drop("_o") for name, paths in configs.items()}


def short_enough(df: DataFrame, tokens: Column, longest: int | None) -> DataFrame:
    """Rows of at most `longest` tokens; without a limit, all."""
    return df if longest is None else df.filter(F.size(tokens) <= longest)


def preference_triples(spark: SparkSession, *paths: str) -> DataFrame:
    return parquet(spark, *paths).select("prompt", "chosen", "rejected")


def mapped(sources: dict[str, DataFrame], mappers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Several sources, each through its own mapper, as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [mappers[name](df) for name, df in sources.items()])


def existing_results(spark: SparkSession, path: str, variant: str = "variant") -> tuple[DataFrame, DataFrame]:
    """Results written before, and their summary computed anew."""
    rows = json_lines(spark, path, f"index long, {variant} string, correct boolean, exceeded_length boolean, prediction string")
    return rows, accuracy_rollup(rows, variant, "correct", "exceeded_length")


def append_json_lines(df: DataFrame, path: str) -> None:
    """More lines in files of their own beside those there: none is touched, so a missing newline at an end does no harm."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def batch_source(df: DataFrame, size: int, key: list[str], epochs: int = 1, seed: object | None = None, drop_last: bool = True, oversample: int = 1) -> tuple[DataFrame, int]:
    """df with epoch and batch numbers, and the batches of all epochs; a batch has size * oversample rows.

    With a seed each epoch has an order of its own; without one rows keep key order.
    """
    n, each = df.count(), size * oversample
    steps = n // each if drop_last else -(-n // each)
    parts = []
    for e in range(epochs):
        rows = df.withColumn("epoch", F.lit(e)).withColumn("_h", F.md5(F.concat_ws(":", F.lit(f"{seed}:{e}"), *[F.col(k).cast("string") for k in key])) if seed is not None else F.lit(""))
        rows = number_rows(rows, "_h", *key, name="_rn").withColumn("batch", F.floor(F.col("_rn") / each).cast("long"))
        parts.append(rows.filter(F.col("batch") < steps).drop("_h", "_rn"))
    return reduce(DataFrame.unionByName, parts), steps * epochs


def retrying(call: Callable[[], tuple[int, dict]], attempts: int = 10, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[dict | None, str | None]:
    """(a service's answer, None) or (None, what went wrong): codes 500, 502, 503, 504 and lost connections are tried again, each time after a longer pause.

    call gives a status code and a body; the transport is the caller's.
    """
    problem = "no attempt"
    for attempt in range(attempts):
        try:
            code, body = call()
        except ConnectionError as e:
            problem = f"connection: {e}"
        except TimeoutError as e:
            problem = f"time limit: {e}"
        except ValueError as e:
            return None, f"answer can't be read: {e}"
        else:
            if code == 200:
                return body, None
            problem = f"status {code}"
            if code not in (500, 502, 503, 504):
                return None, problem
        if attempt < attempts - 1:
            sleep(wait * (attempt + 1))
    return None, problem


SEARCHED = "result string, query_count int, total_results int, status string, error string"


def search_batch(queries: list[str], call: Callable[[list[str]], tuple[int, dict]], **how) -> dict:
    """One batch of queries through a search service: its results as text, and how it went."""
    body, problem = retrying(lambda: call(queries), **how)
    out = {"query_count": len(queries), "total_results": 0, "status": "success", "error": problem}
    if problem:
        return {"result": json.dumps({"result": f"Search error: {problem}"}), **out, "status": "api_error"}
    raw = (body or {}).get("result") or []
    if not raw:
        return {"result": json.dumps({"result": "No search results found."}), **out, "status": "no_results"}
    blocks = ["\n\n".join(_passage(i, hit["document"]["contents"]) for i, hit in enumerate(hits)) for hits in raw]
    return {"result": json.dumps({"result": "\n---\n".join(blocks)}), **out, "total_results": sum(map(len, raw))}


def _passage(i: int, contents: str) -> str:
    title, _, text = contents.partition("\n")
    return f"Doc {i + 1} (Title: {title})\n{text}"


def searched(df: DataFrame, queries: str, call: Callable[[list[str]], tuple[int, dict]], **how) -> DataFrame:
    """df with `search`: each row's queries sent to a service from the executors, a batch for each row."""

    def run(batches):
        for b in batches:
            yield b.assign(search=[search_batch(list(q), call, **how) for q in b[queries]])

    return df.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, search struct<{', '.join(c.replace(' ', ':', 1) for c in SEARCHED.split(', '))}>")


READERS: dict[str, Callable] = {}


def reader(name: str):
    """Registers a reader of training tables under a name; another one under the same name is an error."""

    def put(f):
        if READERS.get(name, f) is not f:
            raise ValueError(f"a reader named {name} is there")
        READERS[name] = f
        return f

    return put


def supervised_source(custom: str | None = None, multi_turn: bool = False) -> Callable:
    """The reader of supervised rows: a registered one, or that of conversations, or that of single turns."""
    return READERS[custom] if custom else READERS["multi_turn" if multi_turn else "single_turn"]


@reader("single_turn")
def single_turns(spark: SparkSession, paths: list[str], prompt: list[str], response: list[str]) -> DataFrame:
    """prompt and response, each reached by a path of field names."""
    df = parquet(spark, *paths)
    return df.select(nested(df, prompt[0], prompt[1:]).alias("prompt"), nested(df, response[0], response[1:]).alias("response"))


@reader("multi_turn")
def multi_turns(spark: SparkSession, paths: list[str]) -> DataFrame:
    return conversations(parquet(spark, *paths))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path (below the given one) and length of all files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    root = path.removeprefix("file://").rstrip("/")
    return files.select(F.substring_index("path", root + "/", -1).alias("path"), "length")


def copy_problems(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, problem: files of two listings that are missing on a side or differ in size."""
    both = a.join(b.withColumnRenamed("length", "_b"), "path", "full_outer")
    problem = F.when(F.col("length").isNull(), "missing in the first").when(F.col("_b").isNull(), "missing in the second").when(F.col("length") != F.col("_b"), "sizes differ")
    return both.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def write_listing(spark: SparkSession, path: str, to: str) -> None:
    """A tree's listing, for a later comparison."""
    listing(spark, path).coalesce(1).write.mode("overwrite").json(to)


def same_listing(spark: SparkSession, path: str, recorded: str) -> bool:
    now, then = listing(spark, path), spark.read.schema("path string, length long").json(recorded)
    return now.exceptAll(then).isEmpty() and then.exceptAll(now).isEmpty()


def is_remote(path: str) -> bool:
    return path.startswith("hdfs://")


def path_key(path: Column) -> Column:
    """The name that a path's copy goes by."""
    return F.md5(path)


def image_header(content: Column) -> Column:
    """An image's format, width and height from its bytes; null for a format that isn't known here."""

    def read(data: bytes | None) -> dict:
        if data is None:
            return {"format": None, "width": None, "height": None}
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return {"format": "png", "width": int.from_bytes(data[16:20], "big"), "height": int.from_bytes(data[20:24], "big")}
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return {"format": "gif", "width": int.from_bytes(data[6:8], "little"), "height": int.from_bytes(data[8:10], "little")}
        if data[:2] == b"BM":
            return {"format": "bmp", "width": int.from_bytes(data[18:22], "little"), "height": abs(int.from_bytes(data[22:26], "little", signed=True))}
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data) and data[at] == 0xFF:
                if data[at + 1] in (0xC0, 0xC1, 0xC2, 0xC3):
                    return {"format": "jpeg", "width": int.from_bytes(data[at + 7 : at + 9], "big"), "height": int.from_bytes(data[at + 5 : at + 7], "big")}
                at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return {"format": None, "width": None, "height": None}

    return batched(read, "struct<format:string,width:int,height:int>")(content)


def from_columns(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A table from columns of equal length, with `_pos`."""
    sizes = {len(v) for v in columns.values()}
    if len(sizes) > 1:
        raise ValueError("columns differ in length")
    names = list(columns)
    rows = [(i, *r) for i, r in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, f"_pos long, {schema}").select("_pos", *names)


def metric_line(metrics: DataFrame, step: str = "step") -> DataFrame:
    """One line for each step: `step:k - name:value - ...`, names in order."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("metric", "value"))), lambda m: F.concat(m["metric"], F.lit(":"), F.round(m["value"], 3).cast("string")))
    return metrics.groupBy(step).agg(F.concat(F.lit("step:"), F.col(step).cast("string"), F.lit(" - "), F.array_join(each, " - ")).alias("line"))


def backend_name(metric: Column) -> Column:
    """A metric's name for a backend that knows no @."""
    return F.replace(metric, F.lit("@"), F.lit("_at_"))


def plain_values(x: object, lists_as_maps: bool = False) -> object:
    """Data classes, enumerations, paths and containers as values that JSON knows."""
    more = lambda v: plain_values(v, lists_as_maps)
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return more(dataclasses.asdict(x))
    if isinstance(x, dict):
        return {str(k): more(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return {"list_len": len(x), **{str(i): more(v) for i, v in enumerate(x)}} if lists_as_maps else [more(v) for v in x]
    if isinstance(x, PurePath):
        return str(x)
    return x.value if isinstance(x, Enum) else x


def flat_parameters(x: dict, sep: str = "/") -> dict[str, str]:
    """A nested configuration as names and texts."""
    out: dict[str, str] = {}
    for k, v in plain_values(x, True).items():
        inner = flat_parameters(v, sep) if isinstance(v, dict) else None
        out |= {f"{k}{sep}{n}": t for n, t in inner.items()} if inner else {str(k): str(v)}
    return out


class Tracker:
    """Sends a step's metrics to each of several backends, functions of (metrics, step)."""

    def __init__(self, **backends: Callable[[dict, int], None]):
        self.backends = backends

    def log(self, metrics: dict, step: int, backends: list[str] | None = None) -> None:
        for name, send in self.backends.items():
            if backends is None or name in backends:
                send(metrics, step)


def console(metrics: dict, step: int) -> None:
    print(" - ".join([f"step:{step}", *(f"{k}:{v:.3f}" if isinstance(v, float) else f"{k}:{v}" for k, v in metrics.items())]), flush=True)


def sample_table(samples: DataFrame, path: str, step: int) -> None:
    """Validation samples of one step beside those of other steps."""
    samples.withColumn("step", F.lit(step)).write.mode("append").partitionBy("step").parquet(path)


def write_checkpoint(spark: SparkSession, path: str, step: int, position: dict) -> None:
    """How far a loop got: the position of one step, and which step is the latest."""
    rows = lambda v: spark.createDataFrame([v], "step long, position string").coalesce(1)
    rows((step, json.dumps(position))).write.mode("overwrite").json(f"{path}/global_step_{step}")
    rows((step, json.dumps(position))).write.mode("overwrite").json(f"{path}/latest")


def read_checkpoint(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(the latest step, its position); (0, {}) where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/latest")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return 0, {}
    row = spark.read.schema("step long, position string").json(f"{path}/latest").first()
    return row["step"], json.loads(row["position"])


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None, skip_malformed: bool = True) -> DataFrame:
    reader = spark.read.option("mode", "DROPMALFORMED" if skip_malformed else "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def word_groups(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Groups of two words and more, trimmed and in upper case; malformed lines are skipped."""
    words = F.filter(F.transform("words", lambda w: F.upper(F.trim(w))), lambda w: w != "")
    return json_lines(spark, path, GROUP).filter("description IS NOT NULL").withColumn("words", words).filter(F.size("words") >= 2).withColumn("source", F.lit(source))


def csv_groups(spark: SparkSession, path: str) -> DataFrame:
    """Board rows as one record per group: games by date, groups by name, words in board order, a running index."""
    rows = spark.read.option("header", True).csv(path)
    word = F.struct(F.col("Starting Row").cast("int").alias("r"), F.col("Starting Column").cast("int").alias("c"), F.upper(F.trim("Word")).alias("w"))
    g = rows.groupBy(F.col("Game ID").cast("int").alias("game"), F.col("Group Name").alias("description")).agg(F.min(epoch_ms(F.col("Puzzle Date"))).alias("date_ms"), F.array_sort(F.collect_list(word)).alias("ws"), F.min("Puzzle Date").alias("contest"))
    g = g.select("game", "date_ms", "description", F.col("ws.w").alias("words"), "contest")
    return number_rows(g, "date_ms", "game", "description", name="index").select("index", "description", "words", "contest")


def epoch_ms(text: Column) -> Column:
    """ISO dates as milliseconds; those without a zone are UTC."""
    return F.unix_millis(F.to_timestamp(text))


def indexed(df: DataFrame, *order: str, length_of: str | None = None) -> DataFrame:
    """df with a running `index` and, if that column is there, the `length` of an array."""
    out = number_rows(df, *order, name="index")
    return out.withColumn("length", F.size(length_of)) if length_of and length_of in df.columns else out


def nth(df: DataFrame, n: int, index: str = "index") -> dict:
    row = df.filter(F.col(index) == n).first()
    if row is None:
        raise IndexError(n)
    return row.asDict(True)


def nested(df: DataFrame, column: str, keys: list[str]) -> Column:
    """A field reached through structs or maps; arrays of one element are entered."""
    c, kind = F.col(column), df.schema[column].dataType
    for k in keys:
        while isinstance(kind, T.ArrayType):
            c, kind = c[0], kind.elementType
        c, kind = (c[k], kind[k].dataType) if isinstance(kind, T.StructType) else (c[k], kind.valueType)
    return c


def conversations(df: DataFrame) -> DataFrame:
    """messages with tools and enable_thinking, null where the input lacks them."""
    more = {c: F.col(c) if c in df.columns else F.lit(None).cast(t) for c, t in (("tools", "string"), ("enable_thinking", "boolean"))}
    return df.select("messages", *[c.alias(k) for k, c in more.items()])


def rl_records(df: DataFrame, prompt: Column, reward: Column, metadata: Column, index: str) -> DataFrame:
    """Rows in the training layout: messages, and reward and metadata as JSON text."""
    chat = F.when(
        F.regexp_like(prompt, F.lit(r"(?s)^System:.*\n\nUser:.*\n\nAssistant:")),
        F.transform(F.split(prompt, r"\n\n(?=(?:User|Assistant):)"), lambda p: F.struct(F.lower(F.substring_index(p, ":", 1)).alias("role"), F.trim(F.regexp_replace(p, r"^\w+:", "")).alias("content"))),
    ).otherwise(F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))))
    return df.select(chat.alias("prompt"), F.to_json(reward).alias("reward_model"), F.to_json(metadata).alias("metadata"), F.col(index).cast("long").alias("index"))


def problems(df: DataFrame) -> list[str]:
    """What keeps a table from the training layout: columns, shapes, JSON text that doesn't parse, null indexes."""
    out = [f"no column {f.name}" for f in RL_RECORD if f.name not in df.columns]
    if out:
        return out
    if not isinstance(df.schema["prompt"].dataType, T.ArrayType):
        out.append("prompt is no array")
    bad = df.agg(*[F.count(F.when(F.col(c).isNotNull() & F.try_parse_json(c).isNull(), 1)).alias(c) for c in ("reward_model", "metadata")], F.count(F.when(F.col("index").isNull(), 1)).alias("index")).first()
    return out + [f"{n} bad values in {c}" for c, n in bad.asDict().items() if n]


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_summary(df: DataFrame, path: str, variant: str = "variant", order: list[str] | None = None) -> None:
    """A small table as one CSV file, rows in the given order of variants."""
    key = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(variant)) if order else F.col(variant)
    df.orderBy(key).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_generations(df: DataFrame, path: str, step: str = "step") -> None:
    df.write.mode("append").partitionBy(step).json(path)


def gather_responses(df: DataFrame, key: str, sample: str, text: str) -> DataFrame:
    """One row per key with its responses in sample order."""
    r = F.array_sort(F.collect_list(F.struct(sample, text)))
    return df.groupBy(key).agg(r.alias("_r")).select(key, F.col(f"_r.{text}").alias("responses"))


def preference_splits(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The first three quarters and the last quarter in key order."""
    n = df.count()
    numbered = number_rows(df, key, name="_rn")
    return numbered.filter(F.col("_rn") < int(n * 0.75)).drop("_rn"), numbered.filter(F.col("_rn") >= int(n * 0.75)).drop("_rn")


def ranked_shards(df: DataFrame, world: int, seed: object, key: str) -> DataFrame:
    """df with `shard`: the seeded order dealt over `world` ranks, equal sizes, the rest left out."""
    n = df.count() // world * world
    w = number_rows(df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)))), "_h", key, name="_rn")
    return w.filter(F.col("_rn") < n).withColumn("shard", F.col("_rn") % world).drop("_h", "_rn")


def dedupe_descriptions(new: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """New groups whose description, in any case, isn't known and stands first among the new."""
    key = F.upper(F.trim("description"))
    fresh = new.withColumn("_k", key).join(known.select(key.alias("_k")).distinct(), "_k", "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(order))).filter("_r = 1").drop("_k", "_r")
