"""Queries over scorers, notations, token rows and records, with their SQL for DuckDB.

Answers are made from the tables' numbers in several spellings; the SQL works the verdicts out
from the numbers alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgrid.functions import answers, groups, notation, scoring, tokens
from rillgrid.operators import metrics, retrieval
from rillgrid.sources import generators, records

from .queries import query, r6, table


def _part(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 7).alias("k"))


def _text(*parts: object) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


@query("""WITH p AS (SELECT p_partkey, p_size AS a, p_partkey % 7 + 1 AS b, p_partkey % 3 AS hints, p_partkey % 5 AS kind FROM part),
s AS (SELECT *, CASE WHEN kind = 4 THEN 0.0 WHEN kind IN (0, 1) AND a + b * 3 = a + b * 3 THEN 1.0 ELSE 0.1 END AS x FROM p)
SELECT p_partkey, x::DOUBLE AS plain, round(CASE WHEN x = 1.0 THEN 1 - 0.1 * hints ELSE x END, 6)::DOUBLE AS paid, cast(hints AS INT) AS hints FROM s""")
def countdown_with_hints(spark, d):
    """Right in two spellings, wrong by its value, with a number too many, without an answer."""
    p, k = table(spark, d, "part"), F.col("p_partkey") % 5
    a, b = F.col("p_size"), F.col("p_partkey") % 7 + 1
    right = F.when(k == 1, _text("3*", b, "+(", a, ") = ", a + b * 3)).otherwise(_text(a, " + ", b, " * 3"))
    equation = F.when(k == 2, _text(a, " * 3 + ", b, " + 0 ")).when(k == 3, _text(a, " + ", b, " * 3 + 1")).otherwise(right)
    numbers = F.when(k == 1, F.array(F.lit(3), b, a, a + b * 3)).otherwise(F.array(a, F.lit(3), b)).cast("array<bigint>")
    text = F.concat(F.repeat(F.lit("<hint>x</hint>"), (F.col("p_partkey") % 3).cast("int")), F.when(k == 4, F.lit("no answer")).otherwise(_text("<answer>0</answer> so <answer>", equation, "</answer>")))
    s = scoring.countdown_hinted(text, a + b * 3, numbers)
    return p.select("p_partkey", s["score_wo_hint_penalty"].alias("plain"), r6(s["score"]).alias("paid"), s["num_hints"].alias("hints"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN (p_size * 2) % 3 = 0 WHEN 2 THEN false ELSE false END AS ok FROM part""")
def evaluator_verdicts(spark, d):
    """The evaluator allows numbers to be left out, and wants a whole value that equals the target."""
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("bigint")
    given = F.when(k == 0, _text(n, " + 2")).when(k == 1, _text("(", n, " * 2) / 3")).when(k == 2, _text(n, " + ", n)).otherwise(_text(n, " + x"))
    target = F.when(k == 0, n + 2).when(k == 1, F.floor(n * 2 / 3)).otherwise(n + n)
    numbers = F.array(n, F.lit(2).cast("bigint"), F.lit(3).cast("bigint"), F.lit(7000).cast("bigint"))
    return table(spark, d, "part").select("p_partkey", (scoring.evaluated_answer(given, target, numbers) & (k != 2)).alias("ok"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.1 WHEN 3 THEN 1.0 WHEN 4 THEN 0.0 ELSE 1.0 END::DOUBLE AS score, CASE WHEN p_partkey % 6 IN (0, 5) THEN round(1 - 0.1 * (p_partkey % 2), 6) WHEN p_partkey % 6 = 3 THEN 0.9 WHEN p_partkey % 6 = 2 THEN 0.1 ELSE 0.0 END::DOUBLE AS paid FROM part""")
def connections_scores(spark, d):
    """Groups in another order, an abstention, wrong groups, a part of the gold text, no answer, the last line."""
    k, n = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    answer = (
        F.when(k == 0, F.concat(F.lit("<answer>{[b"), n, F.lit(", A], [d, c]}</answer>")))
        .when(k == 1, F.lit("<answer>I abstain</answer>"))
        .when(k == 2, F.lit("<answer>[A, C], [B, D]</answer>"))
        .when(k == 3, F.concat(F.lit("<answer>[a, b"), n, F.lit("]</answer>")))
        .when(k == 4, F.lit("  \n "))
        .otherwise(F.concat(F.lit("thinking\n{[A, B"), n, F.lit("], [C, D]}\n")))
    )
    text = F.concat(F.repeat(F.lit("<hint>"), (F.col("p_partkey") % 2).cast("int")), F.when((k == 4) & (F.col("p_partkey") % 2 == 1), F.lit("")).otherwise(F.lit("\n")), answer)
    text = F.when(k == 4, F.lit(" \n ")).otherwise(text)
    words = F.array(F.array(F.lit("a"), F.concat(F.lit("b"), n)), F.array(F.lit("c"), F.lit("d")))
    solution = F.concat(F.lit("{[A, B"), n, F.lit("], [C, D]}"))
    free, paid = scoring.connections_abstaining(text, solution, words), scoring.connections_hinted(text, solution, words)
    return table(spark, d, "part").select("p_partkey", free["score"].alias("score"), r6(paid["score"]).alias("paid"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'openai/gsm8k' WHEN 1 THEN 'lighteval/MATH' WHEN 2 THEN 'aime24' WHEN 3 THEN 'numina_cn_k12' WHEN 4 THEN 'hiyouga/geometry3k' WHEN 5 THEN 'searchR1_nq' ELSE 'taco' END AS source,
CASE p_partkey % 7 WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE -1.0 END WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.1 END WHEN 6 THEN CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.5 END ELSE CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS score FROM part""")
def scores_by_source(spark, d):
    """Each source's own spelling of the number, right on even sizes and one too high on odd ones."""
    p = _part(spark, d)
    n = F.col("p_size")
    said = (n + n % 2).cast("string")
    names = F.array(*[F.lit(x) for x in ("openai/gsm8k", "lighteval/MATH", "aime24", "numina_cn_k12", "hiyouga/geometry3k", "searchR1_nq", "taco")])
    texts = F.array(
        _text("so #### ", said), _text("so $\\boxed{", said, "}$"), _text("x\nAnswer: $", said, "$ dollars"), _text("Step 2: so the answer is ", said), _text("<think>t</think> \\boxed{", said, "}"), _text("<answer> The ", said, "! </answer>"), F.lit("code"),
    )
    source = F.get(names, F.col("k").cast("int"))
    results = F.array(F.lit(True), n % 2 == 0)
    gold = n.cast("string")
    return p.select("p_partkey", source.alias("source"), scoring.by_source(source, F.get(texts, F.col("k").cast("int")), gold, F.array(gold), results).alias("score"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 ELSE 1.0 END::DOUBLE AS score, CASE p_partkey % 5 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 ELSE 1.0 END::DOUBLE AS part FROM part""")
def search_scores(spark, d):
    k, n = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("<answer>x</answer><answer>\n The City "), n, F.lit(". </answer>")))
        .when(k == 1, F.concat(F.repeat(F.lit("<answer>"), 11), F.lit("city "), n, F.lit("</answer>")))
        .when(k == 2, F.concat(F.lit("<answer>in city "), n, F.lit(" today</answer>")))
        .when(k == 3, F.concat(F.lit("city "), n))
        .otherwise(F.concat(F.lit("<answer>a "), n, F.lit(" second</answer>")))
    )
    text = F.when(k == 1, F.concat(F.lit("<answer>city "), n, F.lit("</answer>"), F.repeat(F.lit("</answer>"), 11))).otherwise(text)
    golds = F.array(F.concat(F.lit("CITY "), n), F.concat(n, F.lit(", SECOND")))
    return table(spark, d, "part").select("p_partkey", scoring.search_exact(text, golds).alias("score"), scoring.search_exact(text, golds, substring=True).alias("part"))


@query(r"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '\frac{' || p_size || '}{7}' WHEN 1 THEN '\sqrt{' || p_size % 10 || '}' WHEN 2 THEN CASE WHEN p_size = 5 THEN '\frac{1}{2}' ELSE '0.' || p_size END WHEN 3 THEN p_size::VARCHAR WHEN 4 THEN '\frac{1}{2}' WHEN 5 THEN p_size::VARCHAR ELSE '\frac{' || p_size % 10 || '}{3}' END AS form, CASE WHEN p_partkey % 7 = 3 THEN p_size::VARCHAR WHEN p_partkey % 7 = 5 THEN p_size || '000' ELSE '3' END AS final_ FROM part""")
def answer_forms(spark, d):
    """TeX and final forms of one number in many spellings."""
    k, n = F.col("k"), F.col("p_size")
    one = F.when(k == 0, _text(n, "/7")).when(k == 1, _text("x = \\sqrt", n % 10)).when(k == 2, _text(".", n)).when(k == 3, _text("\\$", n, "\\%\\text{ cents}")).when(k == 4, F.lit("0.5")).when(k == 5, _text("\\left", n, "^\\circ")).otherwise(_text("\\dfrac", n % 10, "3"))
    last = F.when(k == 3, _text("x = \\text{", n, "} dollars")).when(k == 5, _text(n, ",000 points")).otherwise(F.lit("an $3$ cm"))
    return _part(spark, d).select("p_partkey", notation.tex_forms(one).alias("form"), notation.final_forms(last).alias("final_"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '+3/4' WHEN 2 THEN (p_size * 1000)::VARCHAR ELSE p_size || '*10^6' END AS form FROM part""")
def value_forms(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    text = F.when(k == 0, _text("\\text{", n, "}")).when(k == 1, _text(n, "  3/4")).when(k == 2, _text("$", n, ",000")).otherwise(_text(n, "million"))
    return table(spark, d, "part").select("p_partkey", notation.value_forms(text).alias("form"))


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, p_size + (p_partkey % 4) * 0.00008 * p_size AS b FROM part)
SELECT p_partkey, abs(a - b) <= 1e-4 * greatest(abs(a), abs(b)) AS close, abs(a - b) <= 1e-4 * greatest(abs(a), abs(b)) AS percent, p_partkey % 2 = 0 AS expression FROM p""")
def numeric_grades(spark, d):
    """Numbers within a tolerance, percentages, and expressions that are the same function or not."""
    n, k = F.col("p_size"), F.col("p_partkey") % 4
    other = n + k * 0.00008 * n
    grade = F.when(F.col("p_partkey") % 2 == 0, _text(n, "(x+1)")).otherwise(_text(n, "x+", n + 1))
    return table(spark, d, "part").select(
        "p_partkey", notation.math_equals(n.cast("string"), other.cast("string")).alias("close"), notation.math_equals(_text(n, "%"), (other / 100).cast("string")).alias("percent"), notation.grades(grade, _text(n, "x + ", n)).alias("expression"),
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score, CASE WHEN p_partkey % 3 < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS format_score, p_partkey % 3 = 0 AS prime, CASE WHEN p_partkey % 3 = 0 THEN 1.0 WHEN p_partkey % 3 = 1 THEN least(0, -1 + (p_partkey % 50 - 2) / 2 * 0.1) ELSE least(0, -1 + (p_partkey % 50 - 2) / 2 * 0.1) END::DOUBLE AS strict FROM part""")
def boxed_scores(spark, d):
    """A right box, a wrong one, none."""
    k, n = F.col("p_partkey") % 3, F.col("p_size")
    text = F.when(k == 0, _text("Step 2: so \\boxed{", n, "}")).when(k == 1, _text("so \\boxed{", n + 1, "}")).otherwise(F.lit("so nothing"))
    gold = n.cast("string")
    e, p = notation.entropy_scores(text, gold), notation.prime_scores(text, gold)
    strict = scoring.strict_box_with_calls(text, gold, F.col("p_partkey") % 50)
    return table(spark, d, "part").select("p_partkey", e["score"].alias("score"), e["format_score"].alias("format_score"), p["correct"].alias("prime"), strict["score"].alias("strict")).withColumn("strict", r6("strict"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = p_partkey % 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM part""")
def choice_scores(spark, d):
    letter = lambda c: F.char(65 + c % 4)
    return table(spark, d, "part").select("p_partkey", scoring.choice(F.concat(F.lit("I say\nAnswer: $"), letter(F.col("p_size")), F.lit("$ or so")), letter(F.col("p_partkey"))).alias("score"))


@query("""SELECT doc_id, n_chars % 3 = 0 AS processed, n_chars % 3 = 0 AND n_chars % 2 = 0 AS learnable, NOT (n_chars % 3 = 0 AND n_chars % 2 = 0 AND n_chars <= 2000) AS failed FROM documents""")
def generation_filters(spark, d):
    from rillgrid.streaming import streams

    n = F.col("n_chars")
    text, right, length = F.when(n % 3 == 0, F.col("text")), F.when(n % 3 == 0, n % 2 == 0), F.when(n % 3 == 0, n)
    return table(spark, d, "documents").filter("length(trim(text)) > 0").select("doc_id", F.coalesce(streams.processed_generation(text, right), F.lit(False)).alias("processed"), streams.learnable(text, right, length).alias("learnable"), streams.failed_generation(text, right, length, 2000).alias("failed"))


@query("""SELECT doc_id, 'a' || doc_id AS found, '{[a, b' || doc_id || ']}' AS braces, 'think <answer>x</answer>' AS cleaned, 'last ' || doc_id AS line FROM documents""")
def answer_fallbacks(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id", answers.tag_or_line(_text("so\nAnswer:  a", i, " \nmore")).alias("found"), answers.tag_or_braces(_text("Answer: {[a, b", i, "]} end}")).alias("braces"),
        answers.cleaned_thought(_text(" think <answer>x</answer> more ", i, "<|endoftext|> x")).alias("cleaned"), scoring.last_line(_text("x\n\n last ", i, " \n \n")).alias("line"),
    )


# token rows

def _pairs(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    first = c.filter("turn = 0").select("conv_id", F.coalesce("text", F.lit("")).alias("prompt"))
    return first.join(c.filter("turn = 1").select("conv_id", F.coalesce("text", F.lit("")).alias("response")), "conv_id")


_PAIRS = "SELECT a.conv_id, length(coalesce(a.text, '')) AS p, length(coalesce(b.text, '')) AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1"


def _sum(c: Column) -> Column:
    return F.aggregate(c.cast("array<bigint>"), F.lit(0).cast("long"), lambda s, x: s + x)


@query(f"""WITH c AS ({_PAIRS}), n AS (SELECT conv_id, p, r + 1 AS r, least(p + r + 1, 400) AS n FROM c)
SELECT conv_id, 400 AS size, n::BIGINT AS attention, greatest(least(p + r, 400) - 1 - greatest(p - 1, 0), 0)::BIGINT AS loss, (n * (n - 1) / 2 + (400 - n) * (n - 1))::BIGINT AS positions FROM n""")
def supervised_rows(spark, d):
    """Prompt, response and end in 400 places: the loss stands on what predicts a response token or the end."""
    made = tokens.supervised_row(F.col("prompt"), F.col("response"), 400, side="right")
    rows = _pairs(spark, d).select("conv_id", made.alias("r")).select("conv_id", "r.*")
    return rows.select("conv_id", F.size("input_ids").alias("size"), _sum(F.col("attention_mask")).alias("attention"), _sum(F.col("loss_mask")).alias("loss"), _sum(F.col("position_ids")).alias("positions"))


@query(f"""WITH c AS ({_PAIRS}), n AS (SELECT *, least(p, 200) AS n FROM c) SELECT conv_id, n::BIGINT AS attention, (200 - n)::BIGINT AS padding, (n * (n - 1) / 2)::BIGINT AS positions, n AS raw FROM n""")
def prompt_rows(spark, d):
    """Prompts in 200 places, cut on the left and padded there."""
    made = tokens.prompt_row(F.col("prompt"), 200, -1, side="left")
    rows = _pairs(spark, d).select("conv_id", made.alias("r")).select("conv_id", "r.*")
    padding = F.size(F.filter("input_ids", lambda x: x == -1)).cast("long")
    return rows.select("conv_id", _sum(F.col("attention_mask")).alias("attention"), padding.alias("padding"), _sum(F.col("position_ids")).alias("positions"), F.size("raw_prompt_ids").cast("long").alias("raw"))


@query(f"""WITH c AS ({_PAIRS}), n AS (SELECT *, least(p, 100) AS a, least(r, 150) AS b FROM c) SELECT conv_id, 250 AS size, a + b AS attention, b AS answered, ((a + b) * (a + b - 1) / 2 + (150 - b) * (a + b - 1))::BIGINT AS positions FROM n WHERE p > 0""")
def rollout_rows(spark, d):
    """Prompts of 100 places and responses of 150 in one row."""
    answer = tokens.characters(F.col("response"))
    made = tokens.let(answer, lambda a: tokens.rollout_row(tokens.characters(F.col("prompt")), a, tokens.ones(a), 100, 150))
    rows = _pairs(spark, d).filter("prompt <> ''").select("conv_id", made.alias("r")).select("conv_id", "r.*")
    return rows.select("conv_id", F.size("input_ids").alias("size"), _sum(F.col("attention_mask")).alias("attention"), _sum(F.col("response_mask")).alias("answered"), _sum(F.col("position_ids")).alias("positions"))


@query(f"""WITH c AS ({_PAIRS}) SELECT conv_id, least(r, 120) - 1 AS at, round(p / 1000, 6) AS reward, round(p / 1000 + least(-(least(r, 120) - 70) / 50 * 0.5, 0), 6) AS with_penalty FROM c WHERE r > 0""")
def placed_rewards(spark, d):
    """A response's score stands at its last token, with the penalty on long ones beside."""
    mask = tokens.pad(tokens.ones(F.slice(tokens.characters(F.col("response")), 1, 120)), 120, 0)
    rows = _pairs(spark, d).filter("response <> ''").select("conv_id", (F.length("prompt") / 1000).alias("s"), mask.alias("response_mask"))
    one = scoring.batch_manager(rows, lambda df: F.col("s"))
    two = scoring.dapo_manager(rows, lambda df: F.col("s"), longest=120, buffer=50, factor=0.5).select("conv_id", F.col("reward").alias("more"))
    at = F.array_position(F.transform("reward", lambda x: x != 0), True) - 1
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return one.join(two, "conv_id").select("conv_id", at.alias("at"), r6(total("reward")).alias("reward"), r6(total("more")).alias("with_penalty"))


@query(r"""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'tool' ELSE role END AS role, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS n FROM conversations),
l AS (SELECT *, CASE WHEN role = 'tool' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'tool' THEN 0 ELSE 1 END AS s FROM t)
SELECT conv_id, sum(n)::BIGINT AS n, sum(CASE WHEN role = 'user' THEN n ELSE 0 END)::BIGINT AS loss, (sum(s) - 1)::BIGINT AS last_turn FROM l GROUP BY conv_id""")
def turn_token_rows(spark, d):
    """Words of all turns with the loss on one role; neighbouring tool turns are one."""
    role = F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("content")))).alias("turns"))
    rows = turns.select("conv_id", "turns", tokens.turn_tokens(F.col("turns"), tokens.words, trained="user").alias("t"))
    starts = F.size(F.filter(F.transform("turns", lambda t, i: (i == 0) | (t["role"] != "tool") | (F.get(F.col("turns"), i - 1)["role"] != "tool")), lambda x: x))
    last = F.coalesce(F.try_element_at(F.transform("t", lambda x: x["turn"]), F.lit(-1)).cast("long"), (starts - 1).cast("long"))
    return rows.select("conv_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["loss"]).alias("loss"), last.alias("last_turn"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 4) AS v, label FROM embeddings), z AS (SELECT *, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS z FROM e)
SELECT vec_id, round(v[vec_id % 64 + 1] - z, 6) + 0.0 AS log_prob, round(z - list_sum(list_transform(v, lambda x: exp(x - z) * x)), 6) + 0.0 AS entropy FROM z""")
def logit_statistics(spark, d):
    """Log-probabilities of labels and entropies, with vectors as logits."""
    v = F.transform("embedding", lambda x: x.cast("double") * 4)
    e = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", r6(tokens.label_log_prob(F.col("v"), (F.col("vec_id") % 64).cast("int"))).alias("log_prob"), r6(tokens.entropy(F.col("v"))).alias("entropy"))


@query("""WITH e AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)
SELECT label, round(sum(x), 6) + 0.0 AS total, round(sum(x * x), 6) AS squares FROM e GROUP BY label""")
def pooled_vectors(spark, d):
    out = retrieval.pooled(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding")
    s = lambda f: F.aggregate("vector", F.lit(0.0), lambda s, x: s + f(x))
    return out.select("label", r6(s(lambda x: x)).alias("total"), r6(s(lambda x: x * x)).alias("squares"))


# records and generators

@query("""SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS index, 'q' || doc_id || ' Let''s think step by step and output the final answer after `####`.' AS content, (doc_id * 7)::VARCHAR AS truth FROM documents""")
def word_problem_records(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("q"), "doc_id").alias("question"), F.concat(F.lit("so\n#### "), F.format_number(F.col("doc_id") * 7, 0)).alias("answer"))
    out = records.gsm8k(docs, "train", ["doc_id"], tool="calc")
    return out.select(F.regexp_extract("extra_info.question", r"(\d+)", 1).cast("long").alias("doc_id"), "extra_info.index", F.col("prompt")[1]["content"].alias("content"), "reward_model.ground_truth").withColumnRenamed("ground_truth", "truth")


@query("""SELECT doc_id, 'Make: It is. Then ' || doc_id AS query, 'end. ' || doc_id || ' x' AS ending, (doc_id % 4)::INT AS gold FROM documents""")
def ending_records(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.lit("Make").alias("activity_label"), F.lit("It is [title]").alias("ctx_a"), _text("tHEN ", i).alias("ctx_b"), F.array(_text(" end [title]", i, "[step]  x "), F.lit("y")).alias("endings"), (i % 4).cast("string").alias("label"))
    rows = rows.withColumn("ctx_a", F.lit("It is.")).withColumn("endings", F.array(_text(" end [title]", i, "[step]  x "), F.lit("y")))
    out = records.endings(rows, "test", ["doc_id"])
    return out.select(F.regexp_extract(F.col("prompt")[0]["content"], r"(\d+)", 1).cast("long").alias("doc_id"), F.col("prompt")[0]["content"].alias("query"), F.col("reward_model.choices")[0].alias("ending"), "reward_model.ground_truth").withColumnRenamed("ground_truth", "gold")


@query("""SELECT doc_id, 4 AS turns, 'q' || doc_id AS question, 'first ' || doc_id AS said, 'x = ' || doc_id AS code, 'out' AS shown, 'so ' || doc_id AS last_ FROM documents""")
def transcript_messages(spark, d):
    i = F.col("doc_id")
    first = _text("intro *user question:* q", i, " <answer></answer>")
    second = _text("first ", i, " <code>\n```python\nx = ", i, "\n```\n</code>\n<interpreter> out </interpreter>so <answer>", i, "</answer> rest")
    m = table(spark, d, "documents").select("doc_id", records.transcript(first, second).alias("m"))
    return m.select("doc_id", F.size("m").alias("turns"), F.col("m")[0]["content"].alias("question"), F.col("m")[1]["content"].alias("said"), F.col("m")[1]["code"].alias("code"), F.col("m")[2]["content"].alias("shown"), F.col("m")[3]["content"].alias("last_"))


@query("""WITH n AS (SELECT unnest(range(1, 61)) AS a) SELECT op, count(*) AS n, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM (
SELECT '+' AS op, a, 24 - a AS b FROM n WHERE 24 - a BETWEEN 1 AND 60 UNION ALL SELECT '-', a, a - 24 FROM n WHERE a - 24 BETWEEN 1 AND 60
UNION ALL SELECT '*', a, 24 // a FROM n WHERE 24 % a = 0 AND 24 // a BETWEEN 1 AND 60 UNION ALL SELECT '/', x.a, y.a FROM n x, n y WHERE x.a = 24 * y.a) GROUP BY op""")
def operand_pairs(spark, d):
    out = None
    for op in "+-*/":
        one = generators.operands(spark, 24, op, 1, 60).withColumn("op", F.lit(op))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("op").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


@query("""WITH g AS (SELECT a, s, n FROM (SELECT unnest(range(0, 6)) AS a), (SELECT unnest(range(0, 4)) AS s), (SELECT unnest(range(0, 4)) AS n))
SELECT a || ',' || (a + s) % 5 || ':5,' || n AS prompt, coalesce((SELECT string_agg((((a + s) % 5 + ((((a + s) % 5 - a) % 5 + 5) % 5) * i) % 5)::VARCHAR, ',' ORDER BY i) FROM (SELECT unnest(range(1, n + 1)) AS i)), '') AS response FROM g""")
def digit_texts(spark, d):
    p = generators.digit_prompts(spark, 5, 3, 3)
    return p.select("prompt", generators.digit_answer(F.col("prompt")).alias("response"))


@query("""SELECT p_partkey, 'x' || p_partkey AS response, round(CASE WHEN p_partkey % 3 = 0 THEN length('x' || p_partkey) ELSE 1 END / (length('x' || p_partkey) + 1), 6) AS reward FROM part""")
def prefix_rewards(spark, d):
    k = F.col("p_partkey")
    truth, given = _text("x", k), F.when(k % 3 == 0, _text("x", k, "9")).otherwise(_text("xy", k))
    reward = F.aggregate(generators.prefix_rewards(given, truth), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "part").select("p_partkey", truth.alias("response"), r6(reward).alias("reward"))


@query("""SELECT conv_id, turn, CASE WHEN length(t) <= 40 THEN t ELSE substr(t, 1, 20) || substr(t, length(t) - 19) END AS middle FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)""")
def cut_in_the_middle(spark, d):
    ids = tokens.cut(tokens.characters(F.coalesce("text", F.lit(""))), 40, "middle")
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(ids, lambda x: F.chr(x)), "").alias("middle"))


@query("""WITH m AS (SELECT l_orderkey, count(*) AS prompt, sum(CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END) AS response FROM lineitem GROUP BY l_orderkey),
x AS (SELECT response::DOUBLE AS v FROM m)
SELECT 'response/' || metric AS metric, round(value, 6) AS value FROM (SELECT avg(v) AS mean, max(v) AS max, min(v) AS min, avg(CASE WHEN v = 3 THEN 1.0 ELSE 0.0 END) AS clip_ratio FROM x) UNPIVOT (value FOR metric IN (mean, max, min, clip_ratio))""")
def length_metrics(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_linenumber") > 2).cast("int")).alias("n"))
    return metrics.length_metrics(per, "n", 3, "response").withColumn("value", r6("value"))


@query("""SELECT doc_id, cast(length(text) AS INT) AS given, list_count(list_filter(regexp_split_to_array(text, ''), lambda c: c = 'e'))::INT AS hits FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def character_tokens(spark, d):
    ids = tokens.characters(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.size(ids).alias("given"), F.size(F.filter(ids, lambda x: x == ord("e"))).alias("hits"))


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id AS key, round(list_inner_product(x, embedding::DOUBLE[]), 5) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS k FROM s)
SELECT query, string_agg('Doc ' || k || ' (Title: d' || key || ')' || chr(10) || 'text ' || key, chr(10) || chr(10) ORDER BY k) AS shown FROM r WHERE k <= 3 GROUP BY query""")
def retrieved_passages(spark, d):
    """Hits of a dense search with their documents, as the text that a model is shown."""
    from rillgrid.functions.prompts import passages

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    corpus = e.select("vec_id", F.concat(F.lit("d"), "vec_id", F.lit("\ntext "), "vec_id").alias("contents"))
    found = retrieval.retriever("dense", e.withColumnRenamed("embedding", "vector"), "vec_id", 3).batch_search(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")))
    hits = retrieval.documents(found, corpus, "vec_id", "contents")
    lists = hits.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "contents"))), lambda h: h["contents"]).alias("h"))
    return lists.select("query", passages(F.col("h")).alias("shown"))


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS ok FROM part""")
def role_answers(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.lit("Answer: {x = y}\nAnswer: { Ann = Knight, BOB"), k, F.lit(" = "), F.when(k % 2 == 0, F.lit("knave")).otherwise(F.lit("knight")), F.lit(" }"))
    return table(spark, d, "part").select("p_partkey", scoring.roles_right(text, F.array(F.lit("ann"), F.concat(F.lit("Bob"), k)), F.array(F.lit(True), F.lit(False))).alias("ok"))


@query("""WITH p AS (SELECT p_partkey, p_size % 3 AS g, p_size % 5 AS w FROM part) SELECT p_partkey, CASE WHEN g > 0 THEN g ELSE 2 END AS group_count, CASE WHEN w > 0 THEN w ELSE 1 END AS words_per_group, 3 AS total_words FROM p""")
def word_puzzle_counts(spark, d):
    p = table(spark, d, "part").withColumn("g", (F.col("p_size") % 3)).withColumn("w", (F.col("p_size") % 5))
    one = lambda *ws: F.struct(F.array(*map(F.lit, ws)).alias("words"))
    n = records.group_counts(F.array(one("a"), one("b")), F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("g"), F.col("w"), F.lit(None).cast("int"))
    return p.select("p_partkey", *[c.cast("int").alias(k) for k, c in n.items()])


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1.0 WHEN p_size % 4 = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score, '[' || CASE WHEN p_size % 4 = 3 THEN '1, -4, -4' ELSE '1, 0, 1' END || ']' AS codes FROM part""")
def program_results(spark, d):
    k = F.col("p_size") % 4
    results = F.when(k == 0, F.array(F.lit(True), F.lit(True))).when(k == 1, F.array(F.lit(True), F.lit(False))).when(k == 2, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    codes = scoring.after_compile_error(F.when(k == 3, F.array(F.lit(1), F.lit(-4), F.lit(0))).otherwise(F.array(F.lit(1), F.lit(0), F.lit(1))))
    return table(spark, d, "part").select("p_partkey", scoring.passed_share(results).alias("score"), F.concat(F.lit("["), F.array_join(codes.cast("array<string>"), ", "), F.lit("]")).alias("codes"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'a' || turn || ';c' ELSE 'b' END AS kinds FROM conversations""")
def tool_call_names(spark, d):
    t = F.col("turn")
    text = F.when(t % 2 == 0, _text('x <tool_call>{"name": "a', t, '", "arguments": {"q": 1}}</tool_call><tool_call>{"name": "c", "arguments": {}}</tool_call>')).otherwise(F.lit('<tool_call>not json</tool_call><tool_call>{"name": "b", "arguments": {}}</tool_call>'))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(groups.tool_calls(text), lambda c: c["name"]), ";").alias("kinds"))
