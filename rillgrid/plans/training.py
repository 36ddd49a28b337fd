"""Queries over estimators, recurrences, resampling, dispatch, metrics and streams, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgrid.operators import advantages, losses, metrics, sequences
from rillgrid.operators.batch import Batch
from rillgrid.operators.stored import shared_dir
from rillgrid.streaming import streams

from . import extensions
from .catalogue import _GROUPS, _KEY, _MASKED, _NUMBERED, _ORDER, _TOK, _groups, _masked
from .queries import query, r6, scaled6, table

_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"


@query(f"""WITH n AS ({_NUMBERED}), m AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS m, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY t) AS z FROM n),
r AS (SELECT a.l_orderkey, a.t, a.m, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_shipdate, sum(b.l_discount * power(0.9, b.t - a.t)) AS r FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND b.t >= a.t AND a.z = b.z GROUP BY ALL),
s AS (SELECT avg(r) AS mean, var_samp(r) AS v FROM r WHERE m = 1)
SELECT {_ID}, round(r, 9) AS return_, round((r - mean) / sqrt(v + 1e-8) * m, 4) + 0.0 AS advantage FROM r, s""")
def discounted_with_reset(spark, d):
    """What comes after a masked token counts nothing before it; advantages are whitened over the mask."""
    out = sequences.discounted_advantage(_masked(spark, d), ["l_orderkey"], _TOK, "l_discount", "m", 0.9)
    return out.select("l_orderkey", *_TOK, F.round("return_", 9).alias("return_"), (F.round("advantage", 4) + F.lit(0.0)).alias("advantage"))


@query(f"""WITH n AS ({_NUMBERED}), x AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS m, l_discount + 0.99 * coalesce(lead(l_tax) OVER (PARTITION BY l_orderkey ORDER BY t), 0) - l_tax AS delta FROM n),
a AS (SELECT a.l_orderkey, a.t, a.m, a.l_tax, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_shipdate, sum(b.delta * power(0.99 * 0.95, b.t - a.t)) AS a FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND b.t >= a.t GROUP BY ALL),
s AS (SELECT avg(a) AS mean, var_samp(a) AS v FROM a WHERE m = 1)
SELECT {_ID}, round(a + l_tax, 6) + 0.0 AS return_, round((a - mean) / sqrt(v + 1e-8), 4) + 0.0 AS advantage FROM a, s""")
def gae_with_returns(spark, d):
    out = extensions.compute_advantage(_masked(spark, d), "gae", ["l_orderkey"], _TOK, "l_discount", "m", value="l_tax", gamma=0.99, lam=0.95)
    return out.select("l_orderkey", *_TOK, r6("return_").alias("return_"), (F.round("advantage", 4) + F.lit(0.0)).alias("advantage"))


@query(f"""WITH t AS ({_MASKED}), s AS (SELECT l_partkey % 50 AS g, l_orderkey, sum(l_discount) AS s FROM t GROUP BY ALL), z AS (SELECT *, count(*) OVER w AS n, avg(s) OVER w AS a, stddev_samp(s) OVER w AS d FROM s WINDOW w AS (PARTITION BY g))
SELECT {_ID}, round(CASE WHEN n = 1 THEN s / (1 + 1e-6) ELSE (s - a) / (d + 1e-6) END * m, 6) + 0.0 AS advantage FROM (SELECT *, l_partkey % 50 AS g FROM t) JOIN z USING (g, l_orderkey)""")
def grpo_tokens(spark, d):
    """A sequence's z-score in its group on each of its masked tokens, by the registered estimator."""
    rows = _masked(spark, d).withColumn("g", F.col("l_partkey") % 50)
    out = extensions.compute_advantage(rows, extensions.Estimator.GRPO, ["l_orderkey"], _TOK, "l_discount", "m", ["g"])
    return out.select("l_orderkey", *_TOK, r6("advantage").alias("advantage"))


@query(f"""WITH n AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS m FROM ({_NUMBERED}))
SELECT {_ID}, round(sum(l_discount * m) OVER (PARTITION BY l_orderkey ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 0.1 * m, 6) + 0.0 AS advantage FROM n""")
def remax_advantage(spark, d):
    rows = _masked(spark, d).withColumn("baseline", F.lit(0.1))
    out = extensions.compute_advantage(rows, "remax", ["l_orderkey"], _TOK, "l_discount", "m")
    return out.select("l_orderkey", *_TOK, r6("advantage").alias("advantage"))


_RLOO = f"""n AS ({_NUMBERED}), t AS (SELECT *, l_orderkey % 40 AS g, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS m, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS o FROM n),
c AS (SELECT g, count(DISTINCT l_orderkey) AS n FROM t GROUP BY g),
a AS (SELECT g, sum(x) AS s FROM (SELECT g, l_orderkey, avg(l_discount) AS x FROM t WHERE m = 1 GROUP BY ALL) GROUP BY g), b AS (SELECT g, sum(x) AS s FROM (SELECT g, l_orderkey, avg(l_tax) AS x FROM t WHERE o = 1 GROUP BY ALL) GROUP BY g),
r AS (SELECT t.*, (2 * CASE WHEN m = 1 AND c.n > 1 THEN l_discount * c.n / (c.n - 1) - a.s / (c.n - 1) ELSE 0 END + 5 * CASE WHEN o = 1 AND c.n > 1 THEN l_tax * c.n / (c.n - 1) - b.s / (c.n - 1) ELSE 0 END) * m AS r FROM t JOIN c USING (g) LEFT JOIN a USING (g) LEFT JOIN b USING (g))"""


@query(f"""WITH {_RLOO} SELECT {_ID}, round(sum(r) OVER (PARTITION BY l_orderkey ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS return_ FROM r""")
def weighted_rloo_tokens(spark, d):
    """Leave-one-out on tokens for two reward sources with masks of their own, weighted and summed to returns."""
    rows = _masked(spark, d).withColumn("g", F.col("l_orderkey") % 40).withColumn("o", (F.col("l_linenumber") == 1).cast("int"))
    out = extensions.prime_advantage(rows, "rloo", seq=["l_orderkey"], group=["g"], order=_TOK, mask="m", sources={"rm": ("l_discount", "m", 2.0), "gt": ("l_tax", "o", 5.0)})
    return out.select("l_orderkey", *_TOK, r6("return_").alias("return_"))


@query(f"""WITH n AS ({_NUMBERED}), q AS (SELECT *, max(t) OVER (PARTITION BY l_orderkey) AS last, l_discount * 0.05 AS x, max(l_quantity) OVER (PARTITION BY l_orderkey) AS mq FROM n),
f AS (SELECT *, CASE WHEN t = last THEN (l_quantity / 50) - (sum(x) OVER (PARTITION BY l_orderkey) - x) ELSE x END AS y FROM q)
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_shipdate, round(CASE WHEN a.t = a.last THEN 0 ELSE sum(b.y * power(0.5, b.t - a.t)) END, 6) + 0.0 AS score
FROM f a JOIN f b ON a.l_orderkey = b.l_orderkey AND b.t >= a.t GROUP BY a.l_orderkey, a.t, a.last, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_shipdate""")
def process_reward_tokens(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", *_TOK, "l_discount", (F.col("l_quantity") / 50).alias("acc"))
    out = sequences.process_rewards(rows, ["l_orderkey"], _TOK, "l_discount", 0.05, 0.5, "acc")
    # halves of multiples of 0.0005 are often ties at the sixth digit
    return out.select("l_orderkey", *_TOK, scaled6("score").alias("score"))


@query(f"""WITH n AS ({_NUMBERED}), s AS (SELECT *, sum(l_discount) OVER (PARTITION BY l_orderkey ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM n), m AS (SELECT max(abs(s)) AS m FROM s)
SELECT {_ID}, round(l_discount / (m + 1e-6), 6) AS score, round(l_quantity - (l_discount - l_tax) * 0.2, 6) AS shaped FROM s, m""")
def normed_scores(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", *_TOK, "l_discount", "l_tax", "l_quantity")
    out = sequences.suffix_norm(rows, ["l_orderkey"], _TOK, "l_discount")
    return out.select("l_orderkey", *_TOK, r6("score").alias("score"), r6(sequences.kl_shaped(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), 0.2)).alias("shaped"))


_SAMPLES = "SELECT event_id, user_id AS g, value / 100 AS q, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS acc FROM events"


def _samples(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("g"), (F.col("value") / 100).alias("q"), (F.col("event_type") == "purchase").cast("double").alias("acc"))


@query(f"""WITH e AS ({_SAMPLES}), o AS (SELECT g, avg(q) FILTER (WHERE acc < 1) AS low, avg(q) FILTER (WHERE acc > 0) AS high FROM e GROUP BY g),
x AS (SELECT CASE WHEN acc > 0 THEN 1 ELSE -1 END * 0.5 * (q - coalesce(CASE WHEN acc > 0 THEN low ELSE high END, 0)) AS x FROM e JOIN o USING (g))
SELECT round(avg(ln(1 + exp(-x))), 6) AS loss FROM x""")
def detached_loss(spark, d):
    return advantages.detached_preference_loss(_samples(spark, d), ["g"], "q", "acc", 0.5).select(r6("loss").alias("loss"))


@query(f"""WITH e AS ({_SAMPLES}), p AS (SELECT a.g, a.q - b.q AS s, a.acc - b.acc AS c FROM e a JOIN e b ON a.g = b.g AND a.event_id < b.event_id)
SELECT g, round(CASE WHEN sum(abs(c)) > 0 THEN sum(CASE WHEN (s > 0) = (c > 0) THEN abs(c) ELSE 0 END) / sum(abs(c)) ELSE 0.5 END, 6) AS accuracy FROM p GROUP BY g""")
def weighted_pair_accuracy(spark, d):
    return advantages.weighted_pair_accuracy(_samples(spark, d), ["g"], "event_id", "q", "acc").withColumn("accuracy", r6("accuracy"))


@query(f"""WITH e AS ({_SAMPLES}), m AS (SELECT max(q) AS hi, min(q) AS lo FROM e)
SELECT event_id, round(greatest(q * q + 1e-8, 1e-8), 8) AS pow, round(CASE WHEN q = hi OR q = lo THEN 1.0 ELSE 0.0 END + 1e-8, 8) AS max_min, round(CASE WHEN q = hi THEN 0.4 ELSE 0.1 END + 1e-8, 8) AS max_random, CASE WHEN sign(q - 0.3) = sign(2 * acc - 1) THEN 1 ELSE 0 END AS agrees FROM e, m""")
def resampling_weights(spark, d):
    rows = _samples(spark, d)
    for method in ("pow", "max_min", "max_random"):
        rows = advantages.resampling_weight(rows, "q", method, out=method)
    agrees = (F.signum(F.col("q") - 0.3) == F.signum(2 * F.col("acc") - 1)).cast("int")
    return rows.select("event_id", *[F.round(m, 8).alias(m) for m in ("pow", "max_min", "max_random")], agrees.alias("agrees"))


@query("SELECT count(*) AS n, count(*) AS draws FROM events")
def resampled_rows(spark, d):
    """As many rows as there are, drawn in proportion to weights; each draw is made once."""
    rows = advantages.resampling_weight(_samples(spark, d), "q")
    return advantages.resample(rows, "weight", ["event_id"], 5).agg(F.count("*").alias("n"), F.count_distinct("draw").alias("draws"))


@query(f"""WITH e AS ({_GROUPS}), s AS (SELECT *, count(*) OVER w AS n, min(cast(value > 50 AS INT)) OVER w AS a, max(cast(value > 50 AS INT)) OVER w AS b, min(event_id) OVER w AS f FROM e WINDOW w AS (PARTITION BY user_id, event_type, h)),
k AS (SELECT *, dense_rank() OVER (ORDER BY f) AS r FROM s WHERE n = 1 OR a < b) SELECT event_id FROM k WHERE r <= 30""")
def filled_batch(spark, d):
    e = _groups(spark, d).withColumn("ok", (F.col("value") > 50).cast("int"))
    return advantages.until_full(e, _KEY, "event_id", 30, "ok").select("event_id")


@query("SELECT lang, round(avg(n_chars), 6) AS mean, max(n_chars)::DOUBLE AS max, min(n_chars)::DOUBLE AS min, round(stddev_samp(n_chars), 6) AS std FROM documents WHERE lang = 'en' GROUP BY lang")
def rank_spread(spark, d):
    out = metrics.spread(table(spark, d, "documents").filter("lang = 'en'").withColumn("n", F.col("n_chars").cast("double")), "n")
    return out.select(F.lit("en").alias("lang"), r6("mean").alias("mean"), "max", "min", r6("std").alias("std"))


@query(f"""WITH t AS ({_MASKED}) SELECT round(sum(l_quantity * m) / sum(m), 6) AS masked_mean, round(var_samp(CASE WHEN m = 1 THEN l_quantity END), 6) AS variance, round(sum(l_discount * l_discount), 6) AS sum_of_squares, round(max(CASE WHEN m = 1 THEN abs(exp(l_discount) - exp(l_tax)) END), 6) AS max, round(avg(CASE WHEN m = 1 THEN abs(exp(l_discount) - exp(l_tax)) END), 6) AS mean FROM t""")
def masked_statistics(spark, d):
    t = _masked(spark, d)
    one = metrics.exact_masked_mean(t, "l_quantity", "m").join(metrics.masked_variance(t, "l_quantity", "m")).join(metrics.squares(t, "l_discount")).join(metrics.probability_difference(t, "l_discount", "l_tax", "m").drop("std"))
    return one.select(*[r6(c).alias(c) for c in one.columns])


@query("""WITH x AS (SELECT 'correct' AS k, count(*) FILTER (WHERE quality = 1) AS before, count(*) FILTER (WHERE quality = 1 OR toxic = 1) AS after FROM labels),
y AS (SELECT count(*) FILTER (WHERE quality = 1 AND n_chars <= 1500) AS before, count(*) FILTER (WHERE (quality = 1 OR toxic = 1) AND n_chars <= 1500) AS after FROM labels JOIN documents USING (doc_id))
SELECT x.before AS correct_before, y.before AS short_before, x.after AS correct_after, y.after AS short_after FROM x, y""")
def retry_counters(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    before = rows.withColumn("ok", F.col("quality") == 1)
    after = rows.withColumn("ok", (F.col("quality") == 1) | (F.col("toxic") == 1))
    return metrics.retry_counts(before, after, "ok", "n_chars", 1500)


@query("SELECT conv_id, turn, cast(length(coalesce(text, '')) AS BIGINT) AS length, coalesce(sum(cast(length(coalesce(text, '')) AS BIGINT)) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM conversations")
def token_offsets(spark, d):
    """Where each row's tokens begin when all rows stand one after another."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.format_string("%012d-%06d", "conv_id", "turn").alias("o"), F.array_repeat(F.lit(1), F.length(F.coalesce("text", F.lit("")))).alias("mask"))
    rows, _ = metrics.token_lengths(c, "mask", "o")
    return rows.select("conv_id", "turn", "length", F.col("offset").alias("offset_"))


@query("SELECT doc_id, (doc_id / 8)::DOUBLE AS found FROM documents")
def logged_metrics(spark, d):
    line = F.concat(F.lit("step:3 - val/x:0.1 - val/acc:np.float64("), (F.col("doc_id") / 8).cast("string"), F.lit(") - z:2"))
    return table(spark, d, "documents").select("doc_id", metrics.metric_in_line(line, "val/acc").alias("found"))


@query("""WITH e AS (SELECT value, event_type, length(props) AS n FROM events) SELECT 'actor/chosen_logps' AS metric, round(avg(value), 6) AS value FROM e UNION ALL
SELECT 'reward/score/mean', round(avg(value), 6) FROM e UNION ALL SELECT 'reward/score/max', round(max(value), 6) FROM e UNION ALL SELECT 'reward/score/min', round(min(value), 6) FROM e UNION ALL
SELECT 'response_length/mean', round(avg(n), 6) FROM e UNION ALL SELECT 'response_length/max', max(n) FROM e UNION ALL SELECT 'response_length/min', min(n) FROM e UNION ALL SELECT 'response_length/clip_ratio', round(avg(CASE WHEN n = 20 THEN 1.0 ELSE 0.0 END), 6) FROM e""")
def preference_metrics(spark, d):
    """Metrics of the columns that are there; those of absent ones are left out."""
    e = table(spark, d, "events").select(F.col("value").alias("token_level_scores"), F.col("value").alias("chosen_logps"), F.length("props").alias("response_length"))
    return metrics.preference_metrics(e, 100, 20).withColumn("value", r6("value"))


@query("""WITH t AS (SELECT l_linestatus AS name, l_quantity AS v FROM lineitem) SELECT name, round(avg(v), 6) AS v FROM t GROUP BY name""")
def micro_batch_means(spark, d):
    return metrics.mean_by_name(table(spark, d, "lineitem").select(F.col("l_linestatus").alias("name"), F.col("l_quantity").alias("v")), "name", "v").withColumn("v", r6("v"))


@query(f"""WITH t AS (SELECT *, (l_quantity - 25) / 10 AS a FROM ({_MASKED})), x AS (SELECT *, exp(l_tax - l_discount) AS r FROM t), m AS (SELECT avg(a) AS ma, avg(l_tax) AS ml FROM x WHERE m = 1),
c AS (SELECT x.*, row_number() OVER (ORDER BY CASE WHEN m = 1 THEN 0 ELSE 1 END, (a - ma) * (l_tax - ml) DESC, l_orderkey, {_ORDER}) AS k, (SELECT greatest(1, floor(sum(m) * 0.01)) FROM x) AS n FROM x, m)
SELECT round(sum((-a * r + CASE WHEN m = 1 AND k <= n THEN 2 * abs(l_tax - l_discount) ELSE 0 END) * m) / (sum(m) + 1e-8), 6) AS loss, round(sum(abs(l_tax - l_discount) * m) / (sum(m) + 1e-8), 6) AS kl FROM c""")
def covariance_penalty(spark, d):
    """The hundredth part of all tokens with the largest covariance pays for its distance from the old policy."""
    t = _masked(spark, d).withColumn("a", (F.col("l_quantity") - 25) / 10)
    out = losses.covariance_penalty_loss(t, "l_discount", "l_tax", "a", "m", ["l_orderkey", *_TOK], 0.01, 2.0)
    return out.select(r6("loss").alias("loss"), r6("kl").alias("kl"))


@query(f"""WITH t AS (SELECT *, (l_quantity - 25) / 10 AS a FROM ({_MASKED})), x AS (SELECT *, -a * exp(l_tax - l_discount) AS f, -a * least(greatest(exp(l_tax - l_discount), 0.98), 1.02) AS s FROM t),
m AS (SELECT sum(a * m) / (sum(m) + 1e-8) AS ma, sum(l_tax * m) / (sum(m) + 1e-8) AS ml, sum(m) AS n FROM x),
c AS (SELECT x.*, n, m = 1 AND NOT s > f AND (a - ma) * (l_tax - ml) > 0.01 AND (a - ma) * (l_tax - ml) < 0.02 AS band FROM x, m), b AS (SELECT least(count(*) FILTER (WHERE band), greatest(1, floor(max(n) * 0.001))) AS k FROM c)
SELECT round(k / ((SELECT n FROM m) + 1e-8), 6) AS clip_fraction, round((SELECT sum((l_discount - l_tax) * m) / (sum(m) + 1e-8) FROM x), 6) + 0.0 AS kl FROM b""")
def covariance_clipping(spark, d):
    """A thousandth of all tokens, drawn from those in a band of covariance, counts nothing."""
    t = _masked(spark, d).withColumn("a", (F.col("l_quantity") - 25) / 10)
    out = losses.covariance_clipped_loss(t, "l_discount", "l_tax", "a", "m", ["l_orderkey", *_TOK], 0.02, 0.02, 0.001, 0.01, 0.02)
    return out.select(r6("clip_fraction").alias("clip_fraction"), r6("kl").alias("kl"))


@query(f"""WITH n AS ({_NUMBERED}), e AS (SELECT *, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM n)
SELECT {_ID}, CASE WHEN turn = 1 THEN 0 ELSE 1 END AS loss_mask FROM e""")
def tool_turn_masks(spark, d):
    """Roles assistant, tool, tool, assistant are three turns, of which the second counts nothing."""
    t = table(spark, d, "lineitem").select("l_orderkey", *_TOK, "l_returnflag").withColumn("roles", F.array(*map(F.lit, ("assistant", "tool", "tool", "assistant")))).withColumn("one", F.lit(1))
    out = sequences.mask_tool_turns(t, ["l_orderkey"], _TOK, F.col("l_returnflag") == "R", "roles", "one")
    return out.select("l_orderkey", *_TOK, "loss_mask")


@query("""SELECT index, text, p_size % 2 = 0 AS correct FROM (SELECT p_partkey AS index, p_size, 'Answer: ' || p_size || ' + 2' AS text FROM part)""")
def checked_generations(spark, d):
    from rillgrid.functions import scoring

    p = table(spark, d, "part")
    said = p.select(F.col("p_partkey").alias("index"), F.concat(F.lit("Answer: "), "p_size", F.lit(" + 2")).alias("text"))
    n = F.col("p_size").cast("long")
    raw = p.select(F.col("p_partkey").alias("index"), (n + 2 + n % 2).alias("target"), F.array(n, F.lit(2).cast("long"), F.lit(9).cast("long")).alias("numbers"))
    return scoring.checked_generations(said, raw, "text")


@query("""WITH r AS (SELECT event_type, user_id, avg(value) AS m, stddev_pop(value) AS s FROM (SELECT user_id, event_type, value + k AS value FROM events, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY ALL)
SELECT 'val-core/' || event_type || '/score/mean@' || (SELECT max(n) FROM (SELECT count(*) * 3 AS n FROM events e WHERE e.event_type = r.event_type GROUP BY user_id)) AS name, round(avg(m), 6) AS value FROM r GROUP BY event_type""")
def validated_means(spark, d):
    """Rows answered three times, scored, and summed up over prompts."""
    e = table(spark, d, "events").select("event_type", "user_id", "value")
    _, named = metrics.validate(e, 3, lambda rows: rows, lambda rows: F.col("value") + F.col("sample"), "event_type", "user_id", draws=2)
    named = named.filter("name LIKE '%/score/mean@%'").withColumn("name", F.regexp_replace("name", "^val-aux", "val-core"))
    return named.withColumn("value", r6("value"))


# how rows are dealt to workers

@query("""WITH n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation WHERE n_nationkey < 24), r AS (SELECT unnest(range(0, 12)) AS rank), g AS (SELECT rank, rank // 2 % 3 AS data, rank % 2 AS tensor, rank // 6 AS pipe FROM r)
SELECT 'model' AS mode, n_nationkey, rank::INT AS rank FROM n JOIN g ON data = p // 8 UNION ALL SELECT 'pipeline', n_nationkey, rank::INT FROM n JOIN g ON data * 2 + pipe = p // 4
UNION ALL SELECT 'data', n_nationkey, (p // 2)::INT FROM n UNION ALL SELECT 'all', n_nationkey, rank::INT FROM n, r""")
def dispatched_rows(spark, d):
    """To data groups whose ranks are copies, to pipeline ranks as data ranks, to all ranks in parts, and whole to all."""
    b = Batch.of(table(spark, d, "nation").filter("n_nationkey < 24").select("n_nationkey"), "n_nationkey")
    ranks, out = extensions.Ranks(3, 2, 2), None
    for name, mode in (("model", "MODEL_COMPUTE"), ("pipeline", "PIPELINE_AS_DATA"), ("data", "DP_COMPUTE_PROTO"), ("all", "ONE_TO_ALL")):
        one = extensions.scattered(b.df, ranks, mode).select(F.lit(name).alias("mode"), "n_nationkey", "rank")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'model' AS mode, n_nationkey FROM nation WHERE n_nationkey < 24 UNION ALL SELECT 'pipeline', n_nationkey FROM nation WHERE n_nationkey < 24""")
def gathered_rows(spark, d):
    """Of the copies one comes back."""
    b = Batch.of(table(spark, d, "nation").filter("n_nationkey < 24").select("n_nationkey"), "n_nationkey")
    ranks, out = extensions.Ranks(3, 2, 2), None
    for name, mode in (("model", "MODEL_COMPUTE"), ("pipeline", "PIPELINE_AS_DATA")):
        one = extensions.gathered(extensions.scattered(b.df, ranks, mode), ranks, mode).select(F.lit(name).alias("mode"), "n_nationkey")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT step, round(CASE WHEN step < 10 THEN step / 10 ELSE 1 END, 6) AS constant, round(0.9 * exp(-12.43 * step / 100), 6) AS decayed, round(2 * step / 100 * exp(-4 * step / 100) + 0.2, 6) AS bell,
round(CASE WHEN step < 10 THEN step / 10 WHEN step < 55 THEN 1 WHEN step < 100 THEN 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (step - 55) / 45)) ELSE 0.1 END, 6) AS stable FROM (SELECT unnest(range(0, 120)) AS step)""")
def schedules(spark, d):
    rows = [(s, losses.constant_schedule(s, 10), losses.exponential_schedule(s / 100), losses.bell_schedule(s / 100), losses.stable_schedule(s, 10, 100, 0.1, stable=0.5)) for s in range(120)]
    out = spark.createDataFrame(rows, "step long, constant double, decayed double, bell double, stable double")
    return out.select("step", *[r6(c).alias(c) for c in out.columns[1:]])


@query("""SELECT round((6 * (2 * (3 * 64 * 32 * 2 + 64 * 8 + 64 * 16 * (2 * 4 + 2 * 2)) + 2 * 1000 * 64) * sum(n_chars) + 12 * sum(n_chars * n_chars) * 16 * 4 * 2) / 2.0 / 1e12, 6) AS tera FROM documents""")
def achieved_flops(spark, d):
    tokens, squares = losses.achieved(table(spark, d, "documents"), "n_chars")
    x = losses.expert_flops(64, 2, 4, 2, 32, 2, 8, 1000, tokens, squares, 2.0)
    return spark.createDataFrame([(round(x, 6),)], "tera double")


# streams, run until their source is empty

def _stream(spark, d, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _folder(spark) -> str:
    import uuid

    return f"{shared_dir(spark)}/rillgrid-{uuid.uuid4().hex}"


@query("SELECT event_type, round(avg(value), 6) AS score, count(*) AS n FROM events GROUP BY event_type")
def streamed_means(spark, d):
    """Means so far, complete after each micro-batch; the last is that of all rows."""
    out = streams.run_now(streams.running_means(_stream(spark, d, "events"), "event_type", F.col("value")), _folder(spark), "complete")
    return out.withColumn("score", r6("score"))


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, contains(coalesce(text, ''), 'the') AS hit FROM conversations),
e AS (SELECT conv_id, min(k) AS k FROM t WHERE hit OR k >= 4 GROUP BY conv_id)
SELECT e.conv_id, k AS turns, CASE WHEN hit THEN 'answer' ELSE 'turns' END AS reason FROM e JOIN t USING (conv_id, k)""")
def streamed_turns(spark, d):
    """Conversations end at a word or after four turns, by state kept for each."""
    out = streams.run_now(streams.turn_loop(_stream(spark, d, "conversations"), 4, 1 << 40, "the"), _folder(spark))
    return out.select("conv_id", "turns", "reason")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streamed_windows(spark, d):
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.run_now(streams.windowed_totals(events, "ts", "value", ["event_type"], "1 hour", "1 hour"), _folder(spark), "complete")
    return out.withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz")})


@query("SELECT doc_id, n_chars * 2 AS doubled FROM documents WHERE lang = 'en'")
def resumed_batches(spark, d):
    """Batches written one after another; a second start finds nothing left to do."""
    rows = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "n_chars")
    path = f"{_folder(spark)}/done"
    work = lambda df: df.select("doc_id", (F.col("n_chars") * 2).alias("doubled"))
    streams.resumed(rows, "doc_id", 20_000, work, path)
    return streams.resumed(rows, "doc_id", 20_000, work, path)


@query("SELECT doc_id, (CASE WHEN n_chars % 4 = 0 THEN 0 WHEN n_chars % 4 = 1 THEN 1 WHEN n_chars % 4 = 2 THEN 2 ELSE 2 END)::INT AS passes, n_chars % 4 <> 3 AS ok FROM documents")
def retried_rows(spark, d):
    """Rows that fail are done again, twice at most."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.lit(0).alias("passes"), (F.col("n_chars") % 4 == 0).alias("ok"))
    again = lambda df, k: df.withColumn("passes", F.lit(k + 1)).withColumn("ok", F.col("n_chars") % 4 <= k + 1)
    out, _ = streams.retried(rows, "doc_id", ~F.col("ok"), again, 2)
    return out.select("doc_id", "passes", "ok")


@query("""WITH r AS (SELECT event_id, user_id, value, lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT event_id, CASE WHEN value > b THEN 0.0 ELSE -0.05 END::DOUBLE AS tool_reward FROM r""")
def submission_rewards(spark, d):
    from rillgrid.functions import scoring

    return scoring.submission_rewards(table(spark, d, "events"), ["user_id"], "event_id", "value").select("event_id", "tool_reward")


@query("""WITH u AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT u.conv_id, CASE WHEN u.turn % 4 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score, u.turn % 4 = 0 AS finished FROM u""")
def last_user_scores(spark, d):
    from rillgrid.functions import scoring

    c = table(spark, d, "conversations").withColumn("said", F.when(F.col("turn") % 4 == 0, "I say 7").otherwise("I say 8"))
    return scoring.last_user_score(c, ["conv_id"], "turn", "role", "said", lambda t: scoring.flexible_number(t, F.lit("7")))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def dated_rows(spark, d):
    """Dates compared as ISO text, half open."""
    from rillgrid.sources import records

    o = table(spark, d, "orders").withColumn("date", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return records.dated(o, "date", "1995-01-01T00:00:00", "1996-01-00T00:00:00").select("o_orderkey", F.round("o_totalprice", 2).alias("price"), "o_orderdate")


@query("""WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9:0:' || doc_id), doc_id) - 1 AS a, row_number() OVER (ORDER BY md5('9:1:' || doc_id), doc_id) - 1 AS c, count(*) OVER () AS n FROM documents)
SELECT doc_id, 0 AS epoch, (a // 16)::BIGINT AS batch FROM b WHERE a // 16 < n // 16 UNION ALL SELECT doc_id, 1, (c // 16)::BIGINT FROM b WHERE c // 16 < n // 16""")
def epoch_batches(spark, d):
    from rillgrid.sources import readers

    rows, _ = readers.batch_source(table(spark, d, "documents").select("doc_id"), 8, ["doc_id"], epochs=2, seed=9, oversample=2)
    return rows.select("doc_id", "epoch", "batch")


@query("""SELECT n_nationkey, n_name, (CASE WHEN n_nationkey = 24 THEN 24 ELSE n_nationkey END)::BIGINT AS pos FROM nation UNION ALL SELECT n_nationkey, n_name, 25 + k FROM nation, (SELECT unnest([0, 1]) AS k) WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation)""")
def padded_with_last(spark, d):
    b = Batch.of(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").padding(2)
    return b.df.select("n_nationkey", "n_name", F.col("_pos").alias("pos"))

