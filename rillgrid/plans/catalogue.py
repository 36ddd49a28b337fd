"""Queries over batches, advantages, losses, metrics, joins and windows, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgrid.functions import answers, groups, maths
from rillgrid.operators import advantages, joins, losses, metrics, partitioning, relational, retrieval, sampling, sequences
from rillgrid.operators.batch import Batch
from rillgrid.sources import readers
from rillgrid.streaming import streams

from .queries import FLAGSHIP, QUERIES, SQL, query, r6, table  # noqa: F401  the register is known by this module too

LIMIT_CHARS = 2000


def _evaluated(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("correct"), (F.col("n_chars") > LIMIT_CHARS).alias("exceeded_length"))


_EVALUATED = f"SELECT doc_id, lang, source, n_chars, quality = 1 AS correct, n_chars > {LIMIT_CHARS} AS exceeded_length FROM documents JOIN labels USING (doc_id)"


@query(f"""
WITH e AS ({_EVALUATED}), g AS (
 SELECT CASE WHEN grouping(lang) = 1 THEN 'total' ELSE lang END AS variant,
  cast(count(*) FILTER (WHERE correct) AS BIGINT) AS correct, count(*) AS total,
  count(*) FILTER (WHERE correct AND NOT exceeded_length) AS correct_excl_length, count(*) FILTER (WHERE NOT exceeded_length) AS total_excl_length,
  count(*) FILTER (WHERE NOT correct AND exceeded_length) AS incorrect_due_to_length, count(*) FILTER (WHERE NOT correct) AS total_incorrect
 FROM e GROUP BY ROLLUP (lang))
SELECT variant, round(CASE WHEN total > 0 THEN correct / total ELSE 0.0 END, 6) AS accuracy,
 round(CASE WHEN total_excl_length > 0 THEN correct_excl_length / total_excl_length ELSE 0.0 END, 6) AS accuracy_excl_length,
 round(CASE WHEN total_incorrect > 0 THEN incorrect_due_to_length / total_incorrect ELSE 0.0 END, 6) AS prop_incorrect_due_to_length,
 correct, total, correct_excl_length, total_excl_length, incorrect_due_to_length, total_incorrect FROM g""")
def eval_accuracy_rollup(spark, d):
    out = metrics.accuracy_rollup(_evaluated(spark, d), "lang", "correct", "exceeded_length")
    for c in ("accuracy", "accuracy_excl_length", "prop_incorrect_due_to_length"):
        out = out.withColumn(c, r6(c))
    return out


@query(_EVALUATED)
def eval_results_rows(spark, d):
    return _evaluated(spark, d)


@query("""
WITH m AS (SELECT conv_id, role, avg(length(text)) AS m FROM conversations GROUP BY ALL)
SELECT role, round(avg(m), 6) AS score, count(*) AS n FROM m GROUP BY role""")
def source_mean_of_means(spark, d):
    return metrics.mean_of_means(table(spark, d, "conversations"), ["conv_id"], "role", F.length("text")).withColumn("score", r6("score"))


@query("""
WITH p AS (SELECT event_type, user_id, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, round(avg(m), 6) AS mean, round(avg(s), 6) AS std, max(n) AS n_max, count(*) AS prompts FROM p GROUP BY event_type""")
def val_mean_std(spark, d):
    return metrics.mean_std_by_prompt(table(spark, d, "events"), "event_type", "user_id", "value").withColumns({"mean": r6("mean"), "std": r6("std")})


@query("""
WITH v AS (SELECT user_id, event_type AS vote, count(*) AS votes, min(event_id) AS f FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) AS k FROM v)
SELECT r.user_id, r.vote, r.votes, round(e.value, 6) AS value FROM r JOIN events e ON e.event_id = r.f WHERE k = 1""")
def val_majority_vote(spark, d):
    return metrics.majority_vote(table(spark, d, "events"), ["user_id"], "event_type", "value", "event_id").withColumn("value", r6("value"))


@query("""
WITH p AS (SELECT event_type, user_id, avg(value) AS mean, max(value) AS best, min(value) AS worst, count(*) AS n FROM events GROUP BY ALL),
u AS (SELECT event_type, metric, n, value FROM p UNPIVOT (value FOR metric IN (mean, best, worst))),
m AS (SELECT event_type, metric, max(n) AS n, avg(value) AS value FROM u GROUP BY ALL),
x AS (SELECT max(n) AS n FROM m)
SELECT CASE WHEN m.n = x.n AND m.metric IN ('mean', 'best') THEN 'val-core' ELSE 'val-aux' END || '/' || event_type || '/value/' || metric || '@' || m.n AS name, round(value, 6) AS value FROM m, x""")
def val_core_aux_names(spark, d):
    per = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("mean"), F.max("value").alias("best"), F.min("value").alias("worst"), F.count(F.lit(1)).alias("n"))
    m = per.unpivot(["event_type", "n"], ["mean", "best", "worst"], "metric", "value").groupBy("event_type", "metric").agg(F.max("n").alias("n"), F.avg("value").alias("value"))
    m = m.withColumn("most", F.max("n").over(Window.partitionBy()))
    section = metrics.metric_section("value", "value", F.col("metric"), F.col("n"), F.col("most"))
    return m.select(F.concat(section, F.lit("/"), "event_type", F.lit("/value/"), "metric", F.lit("@"), F.col("n").cast("string")).alias("name"), r6("value").alias("value"))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * (power(k / n, 4) - power((k - 1) / n, 4))), 6) AS best_4, round(sum(value * (power(1 - (k - 1) / n, 4) - power(1 - k / n, 4))), 6) AS worst_4 FROM r GROUP BY user_id""")
def val_expected_best(spark, d):
    return metrics.expected_best(table(spark, d, "events"), ["user_id"], "value", 4).withColumns({"best_4": r6("best_4"), "worst_4": r6("worst_4")})


@query()
def val_bootstrap(spark, d):
    return metrics.bootstrap_by_prompt(table(spark, d, "events"), "event_type", "user_id", "value", "event_type", order="event_id")


def _groups(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.hour("ts").alias("h"), "value")


_GROUPS = "SELECT event_id, user_id, event_type, hour(ts) AS h, value FROM events"
_KEY = ["user_id", "event_type", "h"]
_W = "OVER (PARTITION BY user_id, event_type, h)"


def _advantage(df: DataFrame) -> DataFrame:
    return df.select("event_id", r6("advantage").alias("advantage"))


@query(f"""WITH e AS ({_GROUPS}), s AS (SELECT *, count(*) {_W} AS n, avg(value) {_W} AS m, stddev_samp(value) {_W} AS s FROM e)
SELECT event_id, round(CASE WHEN n = 1 THEN value / (1 + 1e-6) ELSE (value - m) / (s + 1e-6) END, 6) + 0.0 AS advantage FROM s""")
def grpo_advantage(spark, d):
    return _advantage(advantages.group_zscore(_groups(spark, d), _KEY, "value"))


@query(f"""WITH e AS ({_GROUPS}), s AS (SELECT *, count(*) {_W} AS n, avg(value) {_W} AS m FROM e)
SELECT event_id, round(CASE WHEN n = 1 THEN value ELSE value - m END, 6) + 0.0 AS advantage FROM s""")
def grpo_no_std(spark, d):
    return _advantage(advantages.group_zscore(_groups(spark, d), _KEY, "value", by_std=False))


@query(f"""WITH e AS ({_GROUPS}), s AS (SELECT *, count(*) {_W} AS n, row_number() OVER (PARTITION BY user_id, event_type, h ORDER BY value DESC, event_id) AS k FROM e),
t AS (SELECT *, lead(value) OVER (PARTITION BY user_id, event_type, h ORDER BY k) AS second FROM s)
SELECT event_id, round(CASE WHEN k = 1 THEN value - second ELSE 0.0 END, 6) + 0.0 AS advantage FROM t WHERE n > 1""")
def grpo_passk(spark, d):
    return _advantage(advantages.best_minus_second(_groups(spark, d), _KEY, "value", "event_id"))


@query(f"""WITH e AS ({_GROUPS}), s AS (SELECT *, count(*) {_W} AS n, avg(value) {_W} AS m FROM e)
SELECT event_id, round(CASE WHEN n > 1 THEN value * n / (n - 1) - m * n / (n - 1) ELSE value END, 6) + 0.0 AS advantage FROM s""")
def rloo_advantage(spark, d):
    return _advantage(advantages.leave_one_out(_groups(spark, d), _KEY, "value"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, count(*) OVER w AS n, sum(l_discount * l_quantity) OVER w / sum(l_quantity) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount - CASE WHEN n > 1 THEN b ELSE 0.0 END, 9) + 0.0 AS advantage FROM s""")
def opo_advantage(spark, d):
    out = advantages.length_weighted(table(spark, d, "lineitem"), ["l_orderkey"], "l_discount", "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round("advantage", 9) + F.lit(0.0)).alias("advantage"))


@query(f"""WITH e AS ({_GROUPS}), s AS (SELECT event_id, value - CASE WHEN count(*) {_W} > 1 THEN avg(value) {_W} ELSE 0.0 END AS x FROM e), a AS (SELECT avg(x) AS m, var_samp(x) AS v FROM s)
SELECT event_id, round((x - m) / sqrt(v + 1e-8), 6) + 0.0 AS advantage FROM s, a""")
def rfpp_baseline(spark, d):
    return _advantage(advantages.group_mean_baseline(_groups(spark, d), _KEY, "value"))


_TOK = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate"


def _tokens(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", *_TOK, "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag")


@query(f"""SELECT l_orderkey, {_ORDER}, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS return_ FROM lineitem""")
def remax_suffix_sum(spark, d):
    return sequences.suffix_sum(_tokens(spark, d), ["l_orderkey"], _TOK, "l_quantity").select("l_orderkey", *_TOK, r6("return_").alias("return_"))


_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS t FROM lineitem"


@query(f"""WITH n AS ({_NUMBERED})
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_shipdate, round(sum(b.l_quantity * power(0.9, b.t - a.t)), 9) AS return_
FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND b.t >= a.t GROUP BY a.l_orderkey, a.t, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_shipdate""")
def reinforce_discounted(spark, d):
    return sequences.discounted_return(_tokens(spark, d), ["l_orderkey"], _TOK, "l_quantity", 0.9).select("l_orderkey", *_TOK, F.round("return_", 9).alias("return_"))


@query(f"""WITH n AS ({_NUMBERED}), x AS (SELECT *, l_discount + 0.99 * coalesce(lead(l_tax) OVER (PARTITION BY l_orderkey ORDER BY t), 0) - l_tax AS delta FROM n)
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_shipdate, round(sum(b.delta * power(0.99 * 0.95, b.t - a.t)), 6) + 0.0 AS advantage
FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND b.t >= a.t GROUP BY a.l_orderkey, a.t, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_shipdate""")
def gae_recurrence(spark, d):
    return sequences.gae(_tokens(spark, d), ["l_orderkey"], _TOK, "l_discount", "l_tax", 0.99, 0.95).select("l_orderkey", *_TOK, r6("advantage").alias("advantage"))


@query(f"""SELECT l_orderkey, {_ORDER}, CASE WHEN coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS mask FROM lineitem""")
def response_mask(spark, d):
    return sequences.response_mask(_tokens(spark, d), ["l_orderkey"], _TOK, F.col("l_returnflag") == "R").select("l_orderkey", *_TOK, "mask")


@query(f"""SELECT l_orderkey, {_ORDER}, cast(greatest(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 0) AS BIGINT) AS position FROM lineitem""")
def position_ids(spark, d):
    return sequences.position_ids(_tokens(spark, d), ["l_orderkey"], _TOK, F.col("l_returnflag") != "R").select("l_orderkey", *_TOK, "position")


@query(f"""SELECT l_orderkey, {_ORDER}, round(l_discount - l_tax, 6) + 0.0 AS kl, round(abs(l_discount - l_tax), 6) AS abs_, round((l_discount - l_tax) * (l_discount - l_tax) * 0.5, 6) AS mse,
round(least(greatest(exp(l_tax - l_discount) - (l_tax - l_discount) - 1, -10), 10), 6) + 0.0 AS low_var FROM lineitem""")
def kl_penalty_modes(spark, d):
    a, b = F.col("l_discount"), F.col("l_tax")
    return _tokens(spark, d).select("l_orderkey", *_TOK, *[r6(sequences.kl(a, b, m)).alias(n) for m, n in (("kl", "kl"), ("abs", "abs_"), ("mse", "mse"), ("low_var_kl", "low_var"))])


@query("""WITH t AS (SELECT l_orderkey, l_discount AS x, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS m FROM lineitem), p AS (SELECT l_orderkey, sum(x * m) AS s, sum(m) AS m, count(*) AS n FROM t GROUP BY l_orderkey)
SELECT 'token-mean' AS mode, round(sum(s) / (sum(m) + 1e-8), 6) AS loss FROM p UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 6) FROM p
UNION ALL SELECT 'seq-mean-token-mean', round(avg(s / (m + 1e-8)), 6) FROM p UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / max(n), 6) FROM p""")
def agg_loss_modes(spark, d):
    t = _tokens(spark, d).withColumn("m", (F.col("l_returnflag") != "R").cast("int"))
    return sequences.aggregate_loss(t, ["l_orderkey"], "l_discount", "m").withColumn("loss", r6("loss"))


@query("""WITH t AS (SELECT exp(l_tax - l_discount) AS r, (l_quantity - 25) / 10 AS a, l_discount - l_tax AS kl, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS m FROM lineitem),
x AS (SELECT *, -a * r AS f, -a * least(greatest(r, 0.98), 1.02) AS s FROM t), y AS (SELECT *, greatest(f, s) AS h FROM x)
SELECT round(sum(CASE WHEN a < 0 THEN least(-a * 3, h) ELSE h END * m) / (sum(m) + 1e-8), 6) + 0.0 AS loss, round(sum(CASE WHEN s > f THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) AS clip_fraction,
round(sum(kl * m) / (sum(m) + 1e-8), 6) + 0.0 AS kl, round(sum(CASE WHEN h > -a * 3 AND a < 0 THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) AS lower_clip_fraction FROM y""")
def ppo_clip_loss(spark, d):
    t = _tokens(spark, d).withColumn("m", (F.col("l_returnflag") != "R").cast("int")).withColumn("a", (F.col("l_quantity") - 25) / 10)
    out = sequences.clipped_policy_loss(t, "l_discount", "l_tax", "a", "m", 0.02, 0.02)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"""WITH a AS (SELECT avg(l_discount) AS m, var_samp(l_discount) AS v FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_orderkey, {_ORDER}, round((l_discount - m) / sqrt(v + 1e-8), 6) + 0.0 AS whitened FROM lineitem, a""")
def masked_whiten(spark, d):
    t = _tokens(spark, d).withColumn("m", (F.col("l_returnflag") != "R").cast("int"))
    return advantages.whiten(t, "l_discount", "m").select("l_orderkey", *_TOK, r6("whitened").alias("whitened"))


@query(f"""WITH e AS ({_GROUPS}), t AS (SELECT *, max(value) {_W} AS top FROM e), s AS (SELECT *, top + ln(avg(exp(value - top)) {_W}) AS b FROM t)
SELECT event_id, round(value - b, 6) + 0.0 AS advantage FROM s""")
def softmean_group_baseline(spark, d):
    return _advantage(advantages.softmean_baseline(_groups(spark, d), "value", group=_KEY))


@query("""WITH t AS (SELECT event_id, value, max(value) OVER () AS top FROM events), s AS (SELECT *, top + ln(avg(exp(0.5 * (value - top))) OVER ()) / 0.5 AS b FROM t)
SELECT event_id, round(value - b, 6) + 0.0 AS advantage FROM s""")
def softmean_baseline(spark, d):
    return _advantage(advantages.softmean_baseline(_groups(spark, d), "value", 0.5))


@query("""WITH e AS (SELECT event_id, user_id, event_type, cast(value > 50 AS INT) AS ok, date_trunc('hour', ts) AS h FROM events), s AS (SELECT *, count(*) OVER w AS n, min(ok) OVER w AS a, max(ok) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id, event_type, h))
SELECT event_id, user_id, event_type, ok FROM s WHERE n = 1 OR a < b""")
def dynamic_group_filter(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.col("value") > 50).cast("int").alias("ok"), F.date_trunc("hour", "ts").alias("h"))
    return advantages.keep_varied_groups(e, _KEY, "ok").select("event_id", "user_id", "event_type", "ok")


@query("""WITH g AS (SELECT user_id, CASE WHEN avg(value) BETWEEN 20 AND 60 AND max(length(props)) <= 200 THEN 0 ELSE 1 END AS bad FROM events GROUP BY user_id), r AS (SELECT user_id, row_number() OVER (ORDER BY bad, user_id) AS k, count(*) OVER () AS n FROM g)
SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE user_id IN (SELECT user_id FROM r WHERE k <= floor(n / 4))""")
def filter_downsample(spark, d):
    e = table(spark, d, "events").withColumn("len", F.length("props"))
    return advantages.filter_downsample(e, ["user_id"], "value", "len", 20, 60, 200, 4).select("event_id", "user_id", r6("value").alias("value"))


@query("""WITH r AS (SELECT conv_id, turn, length(text) AS score, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY length(text) DESC, turn) AS k FROM conversations)
SELECT conv_id, turn, turn // 2 AS pair, cast(score AS INT) AS score, k = 1 AS chosen FROM r""")
def pref_pairs(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("score"))
    out = advantages.pair_preferences(c, F.struct("conv_id", F.floor(F.col("turn") / 2).alias("p")), "turn", "score")
    return out.select("conv_id", "turn", F.col("pair.p").alias("pair"), "score", "chosen")


@query("""WITH e AS (SELECT user_id, value, cast(event_type = 'purchase' AS INT) AS ok FROM events)
SELECT a.user_id, count(*) AS pairs, round(avg(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END), 6) AS accuracy FROM e a JOIN e b ON a.user_id = b.user_id AND a.ok = 1 AND b.ok = 0 GROUP BY a.user_id""")
def dpo_pair_accuracy(spark, d):
    e = table(spark, d, "events").select("user_id", "value", (F.col("event_type") == "purchase").cast("int").alias("ok"))
    return advantages.ordered_pair_accuracy(e, ["user_id"], "value", "ok").filter("pairs > 0").withColumn("accuracy", r6("accuracy"))


@query("""SELECT round(avg(l_quantity), 6) AS l_quantity_mean, max(l_quantity) AS l_quantity_max, min(l_quantity) AS l_quantity_min, round(avg(l_extendedprice), 6) AS l_extendedprice_mean, max(l_extendedprice) AS l_extendedprice_max, min(l_extendedprice) AS l_extendedprice_min FROM lineitem""")
def data_metrics(spark, d):
    out = metrics.data_metrics(_tokens(spark, d), ["l_quantity", "l_extendedprice"])
    return out.withColumns({c: r6(c) for c in out.columns if c.endswith("_mean")})


@query("SELECT round(1 - var_samp(l_discount - l_tax) / (var_samp(l_discount) + 1e-5), 6) AS explained_variance FROM lineitem")
def explained_variance(spark, d):
    return metrics.explained_variance(_tokens(spark, d), "l_discount", "l_tax").select(r6("explained_variance").alias("explained_variance"))


@query("""SELECT event_type, round(sum(value), 4) AS seconds, round(sum(value) * 1000 / CASE event_type WHEN 'view' THEN 100 ELSE 1000 END, 4) AS ms_per_token FROM events GROUP BY event_type""")
def timing_metrics(spark, d):
    return metrics.timing_metrics(table(spark, d, "events"), "event_type", "value", {"view": 100}, 1000).withColumns({"seconds": F.round("seconds", 4), "ms_per_token": F.round("ms_per_token", 4)})


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def retry_anti_join(spark, d):
    return sampling.unprocessed(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, cast(0 AS INT) AS quality, cast(0 AS INT) AS toxic FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, quality, toxic FROM labels")
def upsert_merge(spark, d):
    blank = table(spark, d, "documents").select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    return sampling.upsert(blank, table(spark, d, "labels"), "doc_id")


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def semi_join_kept(spark, d):
    kept = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return relational.with_keys(table(spark, d, "orders"), kept, ["o_custkey"]).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, round(c_acctbal, 2) AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2), NULL FROM supplier")
def union_by_name(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_nationkey AS nation", "round(c_acctbal, 2) AS balance", "c_mktsegment AS segment")
    s = table(spark, d, "supplier").selectExpr("round(s_acctbal, 2) AS balance", "s_suppkey AS key", "s_name AS name", "s_nationkey AS nation")
    return relational.union_all([c, s])


def _nation(spark, d) -> Batch:
    return Batch.of(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("SELECT cast(p * 3 + k AS BIGINT) AS pos, n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation), (SELECT unnest([0, 1, 2]) AS k)")
def repeat_interleave(spark, d):
    return _nation(spark, d).repeat(3).df.selectExpr("_pos AS pos", "n_nationkey", "n_name")


@query("SELECT cast(k * (SELECT count(*) FROM nation) + p AS BIGINT) AS pos, n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation), (SELECT unnest([0, 1, 2]) AS k)")
def repeat_tile(spark, d):
    return _nation(spark, d).repeat(3, interleave=False).df.selectExpr("_pos AS pos", "n_nationkey", "n_name")


@query("SELECT row_number() OVER (ORDER BY n_nationkey, k) - 1 AS pos, n_nationkey, n_name FROM (SELECT n_nationkey, n_name, unnest(range(n_nationkey % 4)) AS k FROM nation)")
def sample_level_repeat(spark, d):
    b = _nation(spark, d)
    out = Batch(b.df.withColumn("times", F.col("n_nationkey") % 4)).sample_level_repeat("times")
    return out.df.selectExpr("_pos AS pos", "n_nationkey", "n_name")


@query("SELECT o_orderkey, cast(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / ((SELECT count(*) FROM orders) / 5)) AS BIGINT) AS chunk FROM orders")
def chunk_contiguous(spark, d):
    parts = Batch.of(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").chunk(5)
    return Batch.concat([Batch(p.df.withColumn("chunk", F.lit(k).cast("long"))) for k, p in enumerate(parts)]).df.select("o_orderkey", "chunk")


@query("SELECT p AS pos, n_nationkey FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation) UNION ALL SELECT p + (SELECT count(*) FROM nation), n_nationkey FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation) WHERE p < (8 - (SELECT count(*) FROM nation) % 8) % 8")
def pad_unpad(spark, d):
    padded, _ = _nation(spark, d).pad_to_divisor(8)
    return padded.df.selectExpr("_pos AS pos", "n_nationkey")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_nationkey, n_name FROM nation")
def scatter_gather(spark, d):
    """Dealt to eight workers with padding and put together again."""
    parts, pad = _nation(spark, d).scatter(8)
    return Batch.gather(parts, pad).df.selectExpr("_pos AS pos", "n_nationkey", "n_name")


@query("SELECT row_number() OVER (ORDER BY r_regionkey, n_nationkey) - 1 AS pos, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey")
def fold_unfold(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "n_nationkey")
    return Batch.of(n, "r_regionkey", "n_nationkey").fold(5).unfold().df.selectExpr("_pos AS pos", "n_nationkey")


@query("""WITH h AS (SELECT doc_id, lang, text, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, lang, md5(text) AS digest, CASE WHEN k < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM h""")
def seeded_split(spark, d):
    """Whole rows go through the split, so that it is tried with wide ones."""
    return sampling.split(table(spark, d, "documents").select("doc_id", "lang", "text"), 42, ["doc_id"], 0.8).select("doc_id", "lang", F.md5("text").alias("digest"), "split")


@query("""WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, lang FROM h WHERE k <= 10""")
def sample_per_group(spark, d):
    return sampling.sample_per_group(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], 10, 7, ["doc_id"])


@query("SELECT o_orderkey, 'status' AS kind, o_orderstatus AS text FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders")
def unpivot_preferences(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return relational.unpivoted(o, ["o_orderkey"], ["status", "priority"], "kind", "text")


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id AS key, round(list_inner_product(x, embedding::DOUBLE[]), 5) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM s) SELECT query, key, score, cast(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def knn_inner_product(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.knn(e, e.filter(F.col("vec_id") % 50 == 0), "vec_id", "embedding", 10)


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\W+'), lambda w: w <> '')"


@query(f"""WITH t AS (SELECT DISTINCT item_id AS query, unnest({_WORDS}) AS w FROM benchmark), s AS (SELECT doc_id AS key, {_WORDS} AS ws FROM documents),
a AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM s), x AS (SELECT key, len(ws) AS len, unnest(ws) AS w FROM s),
f AS (SELECT w, key, len, count(*) AS tf FROM x WHERE w IN (SELECT w FROM t) GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM f GROUP BY w),
g AS (SELECT query, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * len / mean))), 6) AS score FROM f JOIN df USING (w) JOIN t USING (w), a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM g) SELECT query, key, score, cast(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def bm25_search(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", 10)


_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(%s), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT conv_id, turn, text FROM conversations), f AS (SELECT conv_id, text AS gold FROM conversations WHERE turn = 0)
SELECT conv_id, turn, cast({_NORMAL % 'c.text'} = {_NORMAL % 'f.gold'} AS INT) AS em, cast(contains({_NORMAL % 'c.text'}, {_NORMAL % 'f.gold'}) AS INT) AS subem FROM c JOIN f USING (conv_id)""")
def qa_em(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    gold = c.filter("turn = 0").groupBy("conv_id").agg(F.collect_list("text").alias("golds"))
    return c.join(gold, "conv_id").select("conv_id", "turn", answers.exact_match(F.col("text"), F.col("golds")).alias("em"), answers.sub_exact_match(F.col("text"), F.col("golds")).alias("subem"))


@query("SELECT doc_id, cast(doc_id * 1234 AS VARCHAR) AS found, 1.0::DOUBLE AS score FROM documents")
def gsm8k_extract(spark, d):
    text = F.concat(F.lit("first #### 7 then #### "), F.format_number(F.col("doc_id") * 1234, 0))
    return table(spark, d, "documents").select("doc_id", answers.hash_answer(text).alias("found"), answers.gsm8k_score(text, (F.col("doc_id") * 1234).cast("string")).alias("score"))


@query("SELECT doc_id, 'a' || doc_id AS first, 'b' || doc_id AS last FROM documents")
def answer_tag_extract(spark, d):
    text = F.concat(F.lit("x <ANSWER> a"), "doc_id", F.lit("\n</answer> y <answer>b"), "doc_id", F.lit("</answer>"))
    return table(spark, d, "documents").select("doc_id", answers.first_tag(text).alias("first"), answers.last_tag(text).alias("last"))


@query("""WITH l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, role FROM l WHERE b IS NULL OR role <> 'assistant' OR b <> role""")
def tool_turn_collapse(spark, d):
    return sequences.collapse_runs(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role", ["assistant"])


@query(r"""SELECT doc_id, md5(trim(regexp_replace(translate(replace(text, '…', '...'), '‘’“”–—− ', '''''""--- '), '\s+', ' ', 'g'))) AS digest FROM documents""")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(answers.ascii_normalise(F.col("text"))).alias("digest"))


@query("""WITH p AS (SELECT p_partkey, p_size + (p_partkey % 7 + 1) * 3 AS value, p_size + (p_partkey % 7 + 1) * 3 + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS target FROM part)
SELECT p_partkey, CASE WHEN value = target THEN 1.0 ELSE 0.1 END::DOUBLE AS score FROM p""")
def countdown_score(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    n = F.array(F.col("p_size"), F.col("p_partkey") % 7 + 1, F.lit(3))
    text = F.concat(F.lit("<answer>"), n[0].cast("string"), F.lit(" + "), n[1].cast("string"), F.lit(" * 3</answer>"))
    target = n[0] + n[1] * 3 + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(1)
    return p.select("p_partkey", answers.countdown_score(text, target, n).alias("score"))


@query()
def balanced_partitions(spark, d):
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 200).alias("batch"), "doc_id", "n_chars")
    return partitioning.balance(docs, "batch", "doc_id", "n_chars", 4)


def _timed(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain_time(df: DataFrame) -> DataFrame:
    return df.withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return _plain_time(streams.windowed_totals(_timed(spark, d), "ts", "value", ["event_type"], "1 hour", "1 hour"))


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def events_sliding(spark, d):
    return _plain_time(streams.windowed_totals(_timed(spark, d), "ts", "value", [], "1 hour", "1 hour", "30 minutes"))


@query("""WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g""")
def events_session(spark, d):
    return _plain_time(streams.session_totals(_timed(spark, d), "ts", "value", ["user_id"], "10 minutes", "1 hour")).select("user_id", "start", "n")


@query("""WITH p AS (SELECT event_id AS asof_event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT e.event_id, p.asof_event_id, row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts DESC, p.asof_event_id DESC) AS k FROM events e LEFT JOIN p ON p.user_id = e.user_id AND p.ts <= e.ts WHERE e.event_type = 'view')
SELECT event_id, coalesce(asof_event_id, -1) AS asof_event_id FROM r WHERE k = 1""")
def asof_join(spark, d):
    e = table(spark, d, "events")
    views = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof(views, bought, ["user_id"], "ts", "event_id", ["event_id"]).select("event_id", F.coalesce("asof_event_id", F.lit(-1)).alias("asof_event_id"))


@query("""WITH r AS (SELECT s_suppkey AS k, floor(s_acctbal) AS low, floor(s_acctbal) + 50 AS high FROM supplier) SELECT k, count(*) AS n FROM r JOIN customer ON c_acctbal >= low AND c_acctbal < high GROUP BY k""")
def range_join(spark, d):
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.floor("s_acctbal").alias("low"), (F.floor("s_acctbal") + 50).alias("high"))
    return joins.in_ranges(table(spark, d, "customer").select("c_acctbal"), r, "c_acctbal", "low", "high", 50).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, source, count(*) AS n, cast(sum(n_chars) AS BIGINT) AS chars, cast(grouping(lang) * 2 + grouping(source) AS BIGINT) AS g FROM documents GROUP BY CUBE (lang, source)")
def cube_counts(spark, d):
    return relational.cube(table(spark, d, "documents"), ["lang", "source"], n=F.count(F.lit(1)), chars=F.sum("n_chars"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def except_keys(spark, d):
    return relational.distinct_difference(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def percentiles(spark, d):
    out = relational.quantiles(table(spark, d, "events"), ["event_type"], "value", median=0.5, p90=0.9)
    return out.select("event_type", r6("median").alias("median"), r6("p90").alias("p90"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 150) || '...(truncated)...' || right(text, 150) END) AS digest, cast((length(text) - length(replace(text, 'the', ''))) / 3 AS INT) AS hints FROM documents""")
def truncate_and_count(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(groups.truncate(t, 300)).alias("digest"), groups.hint_count(t, "the").alias("hints"))


@query(r"""WITH t AS (SELECT conv_id, role, len(regexp_split_to_array(trim(text), '\s+')) AS n FROM conversations) SELECT conv_id, cast(sum(n) AS BIGINT) AS tokens, cast(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS trained FROM t GROUP BY conv_id""")
def loss_masks(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("ts"))
    m = turns.select("conv_id", groups.messages_with_masks(F.col("ts")).alias("m"))
    return m.select("conv_id", F.size("m").cast("long").alias("tokens"), F.aggregate("m", F.lit(0), lambda s, x: s + x["mask"]).cast("long").alias("trained"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1.0 WHEN p_partkey % 3 = 1 THEN 0.1 ELSE 0.3 END::DOUBLE AS score FROM part")
def group_scores(spark, d):
    k = F.col("p_partkey")
    gold = F.concat(F.lit("{[A, B], [C, w"), k, F.lit("]}"))
    given = F.when(k % 3 == 0, F.concat(F.lit("[W"), k, F.lit(", c] [b,a]"))).when(k % 3 == 1, F.lit("[a, c]")).otherwise(F.lit("I abstain"))
    return table(spark, d, "part").select("p_partkey", groups.group_score(given, gold).alias("score"))


@query("SELECT p_partkey, p_size % 2 = 0 AS same FROM part")
def math_equality(spark, d):
    s = F.col("p_size")
    given = F.when(s % 2 == 0, F.concat(F.lit("\\dfrac{"), s, F.lit("}{2}"))).otherwise(F.concat(s, F.lit(".25")))
    gold = F.when(s % 2 == 0, (s / 2).cast("int").cast("string")).otherwise(s.cast("string"))
    return table(spark, d, "part").select("p_partkey", maths.math_equal(given, gold).alias("same"))


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS responses FROM nation GROUP BY n_regionkey")
def gather_responses(spark, d):
    return readers.gather_responses(table(spark, d, "nation"), "n_regionkey", "n_nationkey", "n_name").withColumn("responses", F.array_join("responses", "|"))


@query("SELECT o_orderkey, cast((row_number() OVER (ORDER BY o_orderkey) - 1) AS BIGINT) AS index FROM orders")
def indexed_rows(spark, d):
    return readers.indexed(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


def _masked(spark, d) -> DataFrame:
    return _tokens(spark, d).withColumn("m", (F.col("l_returnflag") != "R").cast("int"))


_MASKED = "SELECT *, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS m FROM lineitem"


@query(f"""WITH t AS ({_MASKED}), x AS (SELECT m, power(l_discount - 0.05, 2) AS p, power(least(greatest(l_discount, l_tax - 0.02), l_tax + 0.02) - 0.05, 2) AS c FROM t)
SELECT round(0.5 * sum(greatest(p, c) * m) / (sum(m) + 1e-8), 9) AS loss, round(sum(CASE WHEN c > p THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) AS clip_fraction FROM x""")
def value_loss(spark, d):
    out = losses.value_loss(_masked(spark, d).withColumn("r", F.lit(0.05)), "l_discount", "r", "l_tax", "m", 0.02)
    return out.select(F.round("loss", 9).alias("loss"), r6("clip_fraction").alias("clip_fraction"))


@query(f"""WITH t AS ({_MASKED}), p AS (SELECT l_orderkey, sum((l_tax - l_discount) * m) AS d, max(l_quantity) / 50 AS r FROM t GROUP BY l_orderkey) SELECT round(avg(power(d - r, 2)), 6) AS loss FROM p""")
def sppo_loss(spark, d):
    t = _masked(spark, d).withColumn("r", F.col("l_quantity") / 50)
    return losses.sppo_loss(t, ["l_orderkey"], "l_discount", "l_tax", "r", "m").select(r6("loss").alias("loss"))


@query("""WITH t AS (SELECT (l_discount - l_tax) - (l_quantity / 1000 - 0.025) AS d FROM lineitem)
SELECT round(avg(ln(1 + exp(-0.5 * d)) * 0.9 + ln(1 + exp(0.5 * d)) * 0.1), 6) AS loss, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(0.5 * d), 6) + 0.0 AS margin FROM t""")
def preference_loss(spark, d):
    t = _tokens(spark, d).withColumn("cr", F.col("l_quantity") / 1000).withColumn("rr", F.lit(0.025))
    out = losses.preference_loss(t, "l_discount", "l_tax", "cr", "rr", 0.5, 0.1)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"""WITH t AS ({_MASKED}), p AS (SELECT l_orderkey, sum(l_discount * m) AS z, max(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) AS y FROM t GROUP BY l_orderkey)
SELECT round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS loss FROM p""")
def reward_cross_entropy(spark, d):
    t = table(spark, d, "lineitem").withColumn("m", (F.col("l_returnflag") != "R").cast("int")).withColumn("y", (F.col("l_linestatus") == "O").cast("int"))
    return losses.cross_entropy_reward_loss(t, ["l_orderkey"], "l_discount", "y", "m", 1.0).select(r6("loss").alias("loss"))


@query(f"""WITH t AS ({_MASKED}), p AS (SELECT l_orderkey, sum((l_discount - l_tax) * m) / (sum(m) + 1e-8) AS k FROM t GROUP BY l_orderkey) SELECT round(avg(k), 6) + 0.0 AS kl FROM p""")
def batch_kl(spark, d):
    kl = sequences.kl(F.col("l_discount"), F.col("l_tax"), "kl")
    return losses.kl_rewards(_masked(spark, d), ["l_orderkey"], "l_quantity", kl, "m", 0.1)[1].select(r6("kl").alias("kl"))


@query(f"""WITH t AS ({_MASKED}), a AS (SELECT sum(l_quantity * m) / (sum(m) + 1e-8) AS x, sum(l_discount * m) / (sum(m) + 1e-8) AS y FROM t)
SELECT l_orderkey, {_ORDER}, round((l_quantity - x) * (l_discount - y), 6) + 0.0 AS covariance FROM t, a""")
def token_covariance(spark, d):
    return losses.covariance(_masked(spark, d), "l_quantity", "l_discount", "m").select("l_orderkey", *_TOK, r6("covariance").alias("covariance"))


@query("""WITH r AS (SELECT user_id, cast(value > 20 AS INT) AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT user_id, round(CASE WHEN min(ok) = 1 THEN 1.0 ELSE avg(ok) FILTER (WHERE k <= 10) END, 6) AS score FROM r GROUP BY user_id""")
def test_pass_rate(spark, d):
    return losses.pass_rate(table(spark, d, "events"), ["user_id"], "event_id", F.col("value") > 20).withColumn("score", r6("score"))


@query("""WITH s AS (SELECT source, sum(n_chars) AS s FROM documents GROUP BY source) SELECT cast(min(s) AS BIGINT) AS least, cast(max(s) AS BIGINT) AS most, round(avg(s), 6) AS mean, cast(max(s) - min(s) AS BIGINT) AS difference FROM s""")
def length_balance(spark, d):
    return losses.length_balance(table(spark, d, "documents"), "source", "n_chars").withColumn("mean", r6("mean"))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS k FROM events) SELECT round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, max(event_id) FILTER (WHERE k = 1) AS slowest_event_id, max(user_id) FILTER (WHERE k = 1) AS slowest_user_id FROM r""")
def slowest_event(spark, d):
    out = losses.slowest(table(spark, d, "events"), "value", "event_id", ["event_id", "user_id"])
    return out.withColumns({c: r6(c) for c in ("min", "max", "mean")})
