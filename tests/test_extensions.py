"""Registries, loops, readers, notations and token rows against golden values and brute force."""

import json
import math
import random
import time
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillgrid.functions import notation, scoring, tokens
from rillgrid.operators import advantages, losses, metrics, sequences
from rillgrid.operators.batch import Batch
from rillgrid.plans import extensions
from rillgrid.sources import generators, readers, records
from rillgrid.streaming import agents, streams


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


# notations

@pytest.mark.parametrize(("given", "form"), [
    (r"\frac12", r"\frac{1}{2}"), (r"\frac1{72}", r"\frac{1}{72}"), (r"\frac{3}4", r"\frac{3}4"), ("1/2", r"\frac{1}{2}"), ("01/2", "01/2"), (r"\sqrt3", r"\sqrt{3}"), (r"\dfrac{a}{b}", r"\frac{a}{b}"), ("k = 5", "5"), ("abc = 5", "abc=5"), (".5", r"\frac{1}{2}"),
    (r"5\text{ cm}", "5"), (r"\left(1,2\right)", "(1,2)"), (r"90^\circ", "90"), (r"\$5", "5"), (r"10\%", "10"), ("", ""), ("a b", "ab"), (r"{.5}", "{0.5}"),
])
def test_tex_form(given, form):
    assert notation.tex_form(given) == form


def test_tex_forms_compare():
    assert notation.same_tex(r"\dfrac{1}{2}", "0.5") and notation.same_tex(None, None) and not notation.same_tex("a", None)
    assert not notation.same_tex(r"\text{ a} \text{ b}", "a") and notation.same_tex(r"\text{ a} \text{ b}", r"\text{ a} \text{ b}")


@pytest.mark.parametrize(("given", "form"), [("x = 1,234", "1234"), (r"$\text{5 cm}$", "5"), (r"\boxed{7}", "7"), (r"$\frac34$ hours", r"\frac{3}{4}"), (r"\sqrt2", r"\sqrt{2}"), ("an apple", "apple"), ("10 dollars", "10"), ("(1,2)", "(1,2)")])
def test_final_form(given, form):
    assert notation.final_form(given) == form


@pytest.mark.parametrize(("given", "form"), [("7 3/4", "7+3/4"), (r"\text{Yes}", "yes"), ("$1,000", "1000"), ("5 miles", "5"), (r"\frac{3}{4}", "3/4"), ("3.0", "3"), ("2 million", "2 *10^6"), (None, None), (r"{5}", "5"), ("- 3", "-3"), (r"90^\circ", "90")])
def test_value_form(given, form):
    assert notation.value_form(given) == form


def test_grades():
    assert notation.grade("1/2", r"\frac{1}{2}") and notation.grade("(1, 2)", "(1,2)") and notation.grade("2x + 2", "2(x+1)") and notation.grade("x^2-1", "(x-1)(x+1)")
    assert not notation.grade("2/4", "1/2") and not notation.grade("[1,2]", "(1,2)") and not notation.grade("4.0001", "4") and not notation.grade("x+y+z", "z+y+x+1") and not notation.grade(None, "1")
    assert notation.grade(r"\frac{1}{2}", "0.5", "entropy") and notation.grade_form("12 apples", "12")
    assert notation.same_value_or_form("3.0", "3") and not notation.same_value_or_form("a", "b")


def test_math_equal():
    for a, b in (("0.5", "50"), ("1,000", "1000"), ("50%", "0.5"), ("(1,2)", "(1.00001, 2)"), (r"2\pi", "6.28318"), ("Interval.open(1, 2)", "(1, 2)"), ("101_2", "101"), ("[1,2,3,4]", r"\begin{pmatrix}1&2\\3&4\end{pmatrix}"), ("Yes", " yes"), ("x+1", "1+x")):
        assert notation.math_equal(a, b), (a, b)
    for a, b in (("1", "2"), ("(1,2)", "(2,1)"), ("x", "y"), ("", "1"), ("[1,2]", "(1,2,3)")):
        assert not notation.math_equal(a, b), (a, b)
    assert notation.interval("Interval.Ropen(0, 1)") == "[0, 1)" and notation.interval("x") == "x"


def test_expressions_against_python():
    """Values at points are those of Python's own arithmetic on fractions."""
    from fractions import Fraction

    rng = random.Random(3)

    def made(depth):
        if depth == 0:
            return rng.choice(["x", "y", str(rng.randrange(1, 9))])
        return f"({made(depth - 1)}{rng.choice('+-*/')}{made(depth - 1)})"

    for _ in range(200):
        text = made(3)
        at = {"x": Fraction(3, 7), "y": Fraction(5, 11)}
        try:
            want = eval("".join(f"Fraction({c})" if c.isdigit() else c for c in text), {"Fraction": Fraction}, dict(at))  # noqa: S307  text made above
        except ZeroDivisionError:
            want = None
        assert notation.value_at(text, at) == want
    assert notation.value_at("2x(x+1)", {"x": Fraction(3)}) == 24 and notation.value_at("sqrt(16)2", {}) == 8
    assert notation.value_at("(", {}) is None and notation.value_at("1/0", {}) is None and notation.value_at("a", {}) is None


def test_marked_answers():
    assert notation.marked_answer("So the answer is 42. Thanks") == (True, "42")
    assert notation.marked_answer("x \\boxed{ 7 } y") == (True, "7") and notation.marked_answer("none")[0] is False
    assert notation.prime_score("Step 2: \\box the answer is 3.14", "\\pi")["correct"]
    assert notation.strict_box("a" * 200 + r"\boxed{5}", "5") == (True, "5") and notation.strict_box(r"\boxed{5}" + "a" * 100, "5") == (False, None)
    assert notation.dapo_score("Answer: 5" + " " * 400, "5")["score"] == -1.0
    assert notation.box_content(r"\boxed 5$ x", True) == "5" and notation.box_in_braces(r"\fbox{3}") is None


# token rows

def test_token_rows_against_brute_force(spark):
    rng = random.Random(5)
    for _ in range(6):
        p, r, most = [rng.randrange(1, 9) for _ in range(rng.randrange(0, 8))], [rng.randrange(1, 9) for _ in range(rng.randrange(0, 8))], rng.randrange(4, 14)
        as_text = lambda xs: F.lit("".join(chr(96 + x) for x in xs))
        row = one(spark, tokens.supervised_row(as_text(p), as_text(r), most, 0, 2, side="right"))[0]
        ids = ([96 + x for x in p + r] + [2])[:most]
        n, m = len(p), len(p) + len(r) + 1
        loss = [1] * len(ids) + [0] * (most - len(ids))
        if n > 1:
            loss[: min(n, most) - 1] = [0] * (min(n, most) - 1)
        loss[min(m, most) - 1] = 0
        assert row.input_ids == ids + [0] * (most - len(ids)) and row.loss_mask == loss
        assert row.position_ids == [min(i, len(ids) - 1) for i in range(most)]
        if p and r:
            ro = one(spark, tokens.rollout_row(F.lit(p), F.lit(r), F.lit([1] * len(r)), 8, 10))[0]
            mask = [0] * (8 - len(p)) + [1] * (len(p) + len(r)) + [0] * (10 - len(r))
            assert ro.attention_mask == mask and ro.input_ids == [0] * (8 - len(p)) + p + r + [0] * (10 - len(r))
            assert ro.position_ids == [max(sum(mask[: i + 1]) - 1, 0) for i in range(18)]


def test_token_helpers(spark):
    a = F.lit([0, 0, 5, 6])
    got = one(spark, tokens.without_left_padding(a, 0), tokens.not_padding(a, 0), tokens.running(F.lit([1, 0, 1, 1])), tokens.last_places(a, 2), tokens.at_last(F.lit([1, 1, 0]), F.lit(2.5)), tokens.without_padding(a, F.lit([0, 0, 1, 1])), tokens.cut(F.lit([1, 2, 3, 4, 5]), 3, "middle"))
    assert [list(x) for x in got] == [[5, 6], [0, 0, 1, 1], [0, 0, 1, 2], [5, 6], [0.0, 2.5, 0.0], [5, 6], [1, 4, 5]]
    with pytest.raises(Exception, match="more tokens"):
        one(spark, tokens.cut(a, 2))
    pair = one(spark, tokens.preference_row(F.lit("ab"), F.lit("c"), F.lit("defgh"), 5, 0, 2))[0]
    assert pair.input_ids == [[97, 98, 99, 2, 0], [97, 98, 100, 101, 102]]
    grown = one(spark, tokens.appended(F.struct(F.lit([7]).alias("input_ids"), F.lit([1]).alias("attention_mask"), F.lit([0]).alias("loss_mask"), F.lit([0]).alias("position_ids")), F.lit([8, 9]), 1, 1))[0]
    assert (grown.input_ids, grown.loss_mask, grown.position_ids) == ([7, 8, 9], [0, 1, 1], [0, 1, 2])
    parts = one(spark, tokens.joined_parts(F.lit([[1, 2], [3]]), F.lit([[1, 1], [0]]), 2, 0), tokens.too_long(F.lit([[1, 2], [3]]), 1, 2))
    assert parts[0].responses == [1, 2] and parts[0].truncated and parts[1]
    logits = [[0.1, 2.0, -1.0], [1.0, 1.0, 1.0], [0.0, 3.0, 0.0]]
    lp = one(spark, tokens.response_log_probs(F.lit(logits), F.lit([0, 1, 2]), 2), tokens.chunked(tokens.entropy, F.lit(logits), 2))
    want = [logits[i - 1][i] - math.log(sum(map(math.exp, logits[i - 1]))) for i in (1, 2)]
    assert lp[0] == pytest.approx(want) and len(lp[1]) == 3


def test_recurrences_against_loops():
    rng = np.random.default_rng(1)
    lengths = [0, 5, 1, 9, 0, 3]
    offs = np.concatenate([[0], np.cumsum(lengths)])
    x, keep = rng.normal(size=offs[-1]), rng.integers(0, 2, offs[-1]).astype(float)
    want = np.zeros(offs[-1])
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        run = 0.0
        for t in range(b - 1, a - 1, -1):
            run = x[t] + 0.8 * run
            want[t] = run
            run *= keep[t]
    assert sequences.backward(x, offs, 0.8, keep) == pytest.approx(want)


# registries

def test_registries():
    r = extensions.Registry("thing")
    f = r.register("a")(lambda: 1)
    assert r.register("a")(f) is f and r.get("a")() == 1
    with pytest.raises(ValueError, match="taken"):
        r.register("a")(lambda: 2)
    with pytest.raises(ValueError, match="no thing"):
        r.get("b")
    assert {e.value for e in extensions.Estimator} == set(extensions.ESTIMATORS.known)
    k = extensions.kl_controller("adaptive", 0.1, 6.0, 100)
    k.update(60.0, 10)
    assert k.value == pytest.approx(0.1 * (1 + 0.2 * 0.1)) and extensions.kl_controller("fixed", 0.3).value == 0.3
    for bad in (lambda: extensions.kl_controller("x", 1), lambda: extensions.kl_controller("adaptive", 1, 1, 0)):
        with pytest.raises((NotImplementedError, ValueError)):
            bad()


def test_code_from_files(spark, tmp_path):
    (tmp_path / "s.py").write_text("def f(text, gold, bonus=0.0):\n    return float(text == gold) + bonus\n")
    scorer = extensions.custom_scorer(str(tmp_path / "s.py"), "f", bonus=0.5)
    assert one(spark, scorer(F.lit("a"), F.lit("a")))[0] == 1.5
    with pytest.raises(AttributeError):
        extensions.from_file(str(tmp_path / "s.py"), "g")
    assert extensions.by_path("math.sqrt") is math.sqrt
    rows = spark.createDataFrame([("openai/gsm8k", "#### 4", "4", [1, 1, 0])], "data_source string, text string, ground_truth string, response_mask array<int>")
    assert extensions.reward_manager()(rows).first().reward == [0.0, 1.0, 0.0]
    out, more = scoring.compute_reward(rows, scoring.naive_manager, lambda df: notation.entropy_scores(F.col("text"), F.col("ground_truth")))
    assert out.first().score == 0.0 and set(more) == {"format_score", "acc"}
    unknown = rows.withColumn("data_source", F.lit("?"))
    with pytest.raises(Exception, match="no scorer"):
        extensions.reward_manager()(unknown).collect()


@pytest.mark.parametrize("processes", [False, True])
def test_time_limits(processes):
    quick = extensions.within(5, processes)(lambda x: x + 1)
    assert quick(1) == 2
    with pytest.raises(TimeoutError):
        extensions.within(0.2, processes)(lambda: time.sleep(5))()
    with pytest.raises(KeyError):
        extensions.within(5, processes)(lambda: {}["x"])()


def test_settings_and_checks():
    s = extensions.Settings(a=1, b={"c": (1, 2)})
    assert s.b.c == (1, 2) and extensions.regular(s) == {"a": 1, "b": {"c": [1, 2]}}
    extensions.checked_settings({"train_batch_size": 8, "workers": 4, "micro_batch_size": 2})
    for bad in ({"train_batch_size": 6, "workers": 4}, {"train_batch_size": 4}, {"train_batch_size": 4, "micro_batch_size": 1, "micro_batch_size_total": 2}, {"train_batch_size": 4, "mini_batch_size": 8, "micro_batch_size": 1}, {"train_batch_size": 4, "micro_batch_size": 1, "sample": True, "temperature": 0}):
        with pytest.raises(ValueError):
            extensions.checked_settings(bad)
    assert extensions.fitted_pools({"a": [2, 2], "b": [1]}, {"x": 2, "y": 3}) == {"a": ["x", "y"], "b": ["y"]}
    with pytest.raises(ValueError):
        extensions.fitted_pools({"a": [3, 3]}, {"x": 2, "y": 9})
    seconds = {}
    with extensions.timed("s", seconds), extensions.timed("s", seconds):
        pass
    assert seconds["s"] >= 0
    with pytest.warns(FutureWarning, match="use new"):
        extensions.deprecated("new")(lambda: 1)()
    e = extensions.OpenEnum("A")
    assert e.register("b") == "B" and e.B == "B" and "b" in e and list(e) == ["A", "B"]
    e.remove("b")
    with pytest.raises(AttributeError):
        e.B  # noqa: B018


class Doubler:
    def __init__(self, by):
        self.by = by

    @extensions.dealt("DP_COMPUTE_PROTO")
    def double(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(x=rows["x"] * self.by)

    @extensions.dealt("MODEL_COMPUTE")
    def copies(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(x=rows["x"] + self.by)


def test_workers(spark):
    b = Batch.of(spark.range(7).select("id", (F.col("id") * 10).alias("x")), "id", meta={"k": 1})
    w = extensions.Workers(extensions.Ranks(2, 2), Doubler, 3)
    out = w.double(b, schema="id long, x long")
    assert [r["x"] for r in out.collect()] == [30 * i for i in range(7)] and out.meta == {"k": 1}
    assert [r["x"] for r in w.copies(b, schema="id long, x long").collect()] == [10 * i + 3 for i in range(7)]
    mode = extensions.register_dispatch("odd_first", lambda df, r: df.withColumn("rank", (F.col("_pos") % 2).cast("int")), lambda df, r: df.filter("rank = 1"))
    assert extensions.gathered(extensions.scattered(b.df, extensions.Ranks(2), mode), extensions.Ranks(2), mode).count() == 3
    with pytest.raises(ValueError):
        extensions.scattered(b.df, extensions.Ranks(2), "DP_COMPUTE_PROTO")
    assert [r["rank"] for r in map(lambda x: {"rank": x["_rank"]}, Batch(b.df.limit(6)).rank(3).df.orderBy("_pos").collect())] == [0, 0, 1, 1, 2, 2]


class Echo(extensions.Interaction):
    def respond(self, instance, messages):
        return True, messages[-1]["content"], 1.0, {}


def test_tools():
    assert extensions.call_arguments('{"a": 1}') == ({"a": 1}, False) and extensions.call_arguments("[1]") == ({}, True) and extensions.call_arguments("x") == ({}, True)
    schema = extensions.tool_schema("t", "d", {"q": {"type": "string"}}, ["q"])
    tools = extensions.tools_from({"tools": [{"class_name": "rillgrid.plans.extensions.Tool", "tool_schema": schema}]})
    t = tools[0]
    assert t.name == "t" and t.create("i", truth=1) == "i" and t.execute("i", {}) == ("", 0.0, {}) and t.reward("i") == 0.0
    t.release("i")
    assert not t.instances
    made = extensions.interactions_from({"interaction": [{"class_name": f"{__name__}.Echo"}, {"class_name": f"{__name__}.Echo", "name": "b"}]})
    assert set(made) == {"echo", "b"} and made["b"].respond("i", [{"content": "x"}])[1] == "x"
    with pytest.raises(ValueError):
        extensions.interactions_from({"interaction": [{"class_name": f"{__name__}.Echo"}, {"class_name": f"{__name__}.Echo"}]})
    assert extensions.PARSERS.get("hermes")().calls('<tool_call>{"name": "a", "arguments": {"x": 1}}</tool_call><tool_call>bad</tool_call>') == [("a", {"x": 1})]


# loops

def test_requests():
    r = agents.Request([{"role": "user", "content": "hi"}], start="<a>", most_tokens=40, most_response=20)
    n = r.prompt_length
    assert r.generation_ids()[-3:] == agents.by_character("<a>") and len(r.generation_ids()) == n + 3
    r.add_assistant("yes", [{"name": "t"}])
    r.add_tool(["ok"])
    r.add_user("more")
    r.add_metric("t", 1)
    r.generation_ids()
    r.finalize({"t": [1.0]})
    assert len(r.input_ids) == len(r.loss_mask) == len(r.position_ids) <= 40 and sum(r.loss_mask) == 3
    assert r.position_ids == list(range(len(r.input_ids))) and len(r.response()) == 20 and r.state is agents.RequestState.COMPLETED
    assert r.input_ids[-3:] != agents.by_character("<a>")
    with pytest.raises(ValueError):
        r.finalize({}, agents.FinishReason.TOOL_CALL)
    with pytest.raises(ValueError):
        agents.Request([{"role": "user", "content": "long"}], most_prompt=2)
    d = agents.token_differences([1, 2, 3, 4], [1, 2, 9, 4], lambda x: str(x), 1)
    assert d == [{"whole": "[2, 3, 4]", "joined": "[2, 9, 4]", "places": (1, 4, 1, 4)}]


def test_loops(spark):
    model = lambda ids: [9] if len(ids) < 6 else [8]
    out = agents.tool_loop([1, 2], model, lambda a: [1] if a == [9] else [], lambda c: [5], 100)
    assert out == {"prompt_ids": [1, 2], "response_ids": [9, 5, 9, 5, 8], "response_mask": [1, 0, 1, 0, 1], "num_turns": 6}
    assert agents.tool_loop([1], model, lambda a: [1], lambda c: [5], 3)["response_ids"] == [9, 5, 9]
    assert agents.tool_loop([1], model, lambda a: [1], lambda c: 1 / 0, 9)["response_ids"] == [9]
    assert agents.tool_loop([1], model, lambda a: [1], lambda c: [5], 99, most_answers=2)["num_turns"] == 4
    rows = spark.createDataFrame([(1, [1], "a"), (2, [1, 2], "b")], "k long, p array<long>, agent string")
    got = agents.by_agent(rows, "agent", "k", "p", {"a": lambda p: agents.single_turn(p, model, 1), "b": lambda p: agents.tool_loop(p, model, lambda a: [], lambda c: [], 9)}, samples=2)
    assert got.count() == 4
    with pytest.raises(ValueError, match="no loop"):
        agents.by_agent(rows, "agent", "k", "p", {"a": lambda p: {}})


def test_hint_loop():
    said = iter(["let me see <hint>", "no idea", "<answer>1</answer>"])
    out = agents.hint_loop("p", ["one", "two", "all"], lambda text, may: next(said), 3, lambda t: False)
    assert out["hints"] == 1 and "Correct solution uses one" in out["parts"][1] and out["parts"][3] == agents.AGAIN and not out["truncated"]
    assert out["masks"] == [1, 0, 1, 0, 1]
    wrong = iter(["<answer>1</answer>", "<answer>2</answer>"])
    out = agents.hint_loop("p", ["one", "two"], lambda text, may: next(wrong), 1, lambda t: "1" in t, lambda: True)
    assert out["hints"] == 1 and out["parts"][0] == "" and out["parts"][-1] == "<answer>2</answer>"
    assert agents.hint_loop("p", ["x"], lambda text, may: "z" * 50, 0, lambda t: False, longest=40)["truncated"]
    asked = agents.hint_loop("p", ["a", "b", "c"], lambda text, may: "<hint>", 9, lambda t: False)
    assert asked["hints"] == 4 and agents.NO_HINTS in "".join(asked["parts"]) and agents.HINT_LIMIT in asked["parts"]


def test_servers_and_schedulers():
    s = agents.Servers(["a", "b"], remember=2)
    assert [s.choose(r) for r in ("1", "2", "1", "3", "4", "2")] == ["a", "b", "a", "a", "b", "a"]
    answers = iter([{"role": "assistant", "content": "", "tool_calls": [{"name": "t", "arguments": {}}, {"name": "?", "arguments": {}}]}, {"role": "assistant", "content": "done"}])
    out = agents.Scheduler(s, lambda server, ms: next(answers), {"t": lambda a: "ok"}, 5).run("1", [{"role": "user", "content": "x"}])
    assert [m["content"] for m in out] == ["x", "", "ok", "no tool ?", "done"]
    tool = agents.SearchTool(lambda q: {"result": "r", "query_count": len(q), "status": "success", "total_results": 1})
    assert tool.execute("i", {"query_list": ["a"]})[0] == "r" and tool.found == {"i": ["r"]} and "Error" in tool.execute("i", {})[0]
    seconds = []
    assert agents.timed_calls(lambda x: x + 1, [1, 2], seconds) == [2, 3] and len(seconds) == 2


def test_training_loop_resumes(spark, tmp_path):
    path, seen = f"file://{tmp_path}/ck", []

    def step(batch, n):
        if n == 2 and len(seen) == 2:
            raise RuntimeError("lost")
        seen.append(n)
        return {"n": n}

    with pytest.raises(RuntimeError):
        streams.train(spark, lambda k: None, step, 2, 2, path)
    seen.append("again")
    refreshed = []
    assert [m["n"] for m in streams.train(spark, lambda k: None, step, 2, 2, path, refreshed.append, 2)] == [2, 3] and refreshed == [4]
    batches = (spark.range(10).select("id", (F.col("id") % 5 + 10 * k).alias("g"), (F.col("id") % 2).alias("s")) for k in range(4))
    out = streams.filled(batches, lambda b: b.filter("g % 5 < 2"), ["g"], "id", 3, 1)
    assert out.count() == 3 and len({r.g for r in out.collect()}) == 3
    with pytest.raises(ValueError):
        streams.filled(iter([spark.range(2).select("id", F.col("id").alias("g"))]), lambda b: b, ["g"], "id", 3, 1)


# sources

@dataclass
class Inner:
    path: PurePosixPath


def test_sources(spark, tmp_path):
    tries = iter([(503, {}), (200, {"result": [[{"document": {"contents": "T\nbody"}}]]})])
    waits = []
    found = readers.search_batch(["q"], lambda q: next(tries), sleep=waits.append)
    assert json.loads(found["result"])["result"] == "Doc 1 (Title: T)\nbody" and found["total_results"] == 1 and waits == [1.0]
    assert readers.search_batch(["q"], lambda q: (404, {}), sleep=waits.append)["status"] == "api_error"
    assert readers.search_batch(["q"], lambda q: (200, {}))["status"] == "no_results"

    def lost():
        raise ConnectionError("x")

    assert readers.retrying(lost, 3, sleep=waits.append) == (None, "connection: x")
    rows = spark.createDataFrame([(1, ["a", "b"])], "k long, qs array<string>")
    assert readers.searched(rows, "qs", lambda q: (200, {})).first().search.query_count == 2
    with pytest.raises(ValueError):
        readers.reader("single_turn")(lambda: 1)
    assert readers.supervised_source(multi_turn=True) is readers.multi_turns and readers.supervised_source("single_turn") is readers.single_turns
    d = f"file://{tmp_path}"
    for name in ("x", "y"):
        spark.createDataFrame([(name,)], "v string").coalesce(1).write.text(f"{d}/{name}")
    a = readers.listing(spark, f"{d}/x")
    assert a.count() == 1 and readers.copy_problems(a, a).isEmpty() and readers.copy_problems(a, readers.listing(spark, f"{d}/y")).count() == 2
    readers.write_listing(spark, f"{d}/x", f"{d}/record")
    assert readers.same_listing(spark, f"{d}/x", f"{d}/record") and not readers.same_listing(spark, f"{d}/y", f"{d}/record")
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (4).to_bytes(4, "big")
    shown = spark.createDataFrame([(bytearray(png),), (bytearray(b"x"),)], "c binary").select(readers.image_header(F.col("c")).alias("h")).collect()
    assert (shown[0].h.format, shown[0].h.width, shown[0].h.height) == ("png", 3, 4) and shown[1].h.format is None
    with pytest.raises(ValueError):
        readers.from_columns(spark, {"a": [1], "b": [1, 2]}, "a long, b long")
    assert readers.from_columns(spark, {"a": [1, 2]}, "a long").count() == 2
    line = readers.metric_line(spark.createDataFrame([(3, "b", 0.5), (3, "a", 1.0)], "step long, metric string, value double")).first().line
    assert line == "step:3 - a:1.0 - b:0.5" and one(spark, readers.backend_name(F.lit("x@4")))[0] == "x_at_4"
    assert readers.flat_parameters({"a": Inner(PurePosixPath("/p")), "b": [1, 2]}) == {"a/path": "/p", "b/list_len": "2", "b/0": "1", "b/1": "2"}
    logged = []
    readers.Tracker(one=lambda m, s: logged.append((s, m)), two=lambda m, s: logged.append(s)).log({"x": 1}, 4, ["one"])
    assert logged == [(4, {"x": 1})]
    readers.append_json_lines(rows, f"{d}/j")
    readers.append_json_lines(rows, f"{d}/j")
    assert spark.read.json(f"{d}/j").count() == 2
    assert readers.is_remote("hdfs://x") and not readers.is_remote("/x")


def test_word_puzzles():
    rng = random.Random(1)
    pool = lambda tag, n: [{"idx": i, "description": f"{tag}{i}", "words": [f"{tag}{i}w{k}" for k in range(rng.randrange(2, 6))]} for i in range(n)]
    made = generators.word_puzzles(pool("a", 30), pool("b", 30), {(2, 3): 4, (3, 2): 5}, 7)
    assert len(made) == 9
    used = [a["answerDescription"] for p in made for a in p["question"]["answers"]]
    assert len(used) == len(set(used)) and [p["index"] for p in made] == list(range(9))
    for p in made:
        answers, m = p["question"]["answers"], p["metadata"]
        assert {a["answerDescription"][0] for a in answers} == {"a", "b"} and len(answers) == m["group_count"]
        words = [w for a in answers for w in a["words"]]
        assert sorted(words) == sorted(p["question"]["words"]) and len(set(words)) == m["total_words"] == m["group_count"] * m["words_per_group"]
        assert p["answer"].startswith("{[") and p["answer"].count("[") == m["group_count"]
    assert generators.word_puzzles([], pool("b", 3), {(2, 2): 1}) == []


def test_generated_rows(spark):
    u = generators.uniform_numbers(spark, 20, 3, 10, 1, 5).collect()
    assert all(1 <= r.target <= 10 and len(r.nums) == 3 and all(1 <= n <= 5 for n in r.nums) for r in u)
    assert [r.prompt for r in generators.sampled_prompts(spark, 3, 5, 2, 4).orderBy("index").collect()] == [r.prompt for r in generators.sampled_prompts(spark, 3, 5, 2, 4).orderBy("index").collect()]
    c = generators.counting_texts(generators.character_counts(spark, 5)).collect()
    assert all(r.response.endswith(f"\\boxed{{{r['count']}}} {r.letter} in {r.word}.") and r.response.count(" = ") == r["count"] for r in c)
    v = generators.variants({"x": u and generators.uniform_numbers(spark, 3), "y": generators.uniform_numbers(spark, 2)})
    assert [(r["index"], r.variant) for r in v.orderBy("index").collect()] == [(0, "x"), (1, "x"), (2, "x"), (3, "y"), (4, "y")]
    assert one(spark, F.length(generators.random_letter(3, F.lit(1))))[0] == 1


def test_records(spark):
    got = spark.createDataFrame([('[{"description": "d", "words": ["a", "b", "c", " d "]}, {"description": "", "words": []}]',), ("{'groups': [{'description': 'e', 'words': ['a', 'b', 'c', 'd']}]}",), ("nonsense",), (None,)], "t string").select(records.parse_groups_response(F.col("t")).alias("g")).collect()
    assert [[(g.description, g.words) for g in r.g] if r.g else None for r in got] == [[("d", ["A", "B", "C", "D"])], [("e", ["A", "B", "C", "D"])], None, None]
    packed = one(spark, records.packed_cases(F.lit('[{"input": "1", "output": "2"}]'), F.lit("[]"), F.lit('{"func_name": "f"}')), records.packed_cases(F.lit("x"), F.lit(None).cast("string"), F.lit("{}")))
    import base64
    import zlib

    assert json.loads(zlib.decompress(base64.b64decode(packed[0]))) == {"inputs": ["1"], "outputs": ["2"], "fn_name": "f"} and packed[1] is None
    again = one(spark, records.packed_cases(F.lit("[]"), F.lit(base64.b64encode(zlib.compress(b'[{"input": "3", "output": "4"}]')).decode()), F.lit("{}")))[0]
    assert json.loads(zlib.decompress(base64.b64decode(again)))["inputs"] == ["3"]
    assert one(spark, records.shown_last_line(F.lit("x = 1\nx\n\n")), records.shown_last_line(F.lit("print(1)"))) == ("x = 1\nprint(x)\n\n", "print(1)")
    df = spark.createDataFrame([("p", "s \\boxed{4}")], "problem string, solution string")
    assert records.mathematics(df, "train", ["problem"]).first().reward_model.ground_truth == "4"
    q = spark.createDataFrame([("who", ["x"], "nq", "fact")], "question string, golden_answers array<string>, data_source string, ability string")
    r = records.search_questions(q, "test", ["question"], "sys", "ask: \n").first()
    assert r.data_source == "searchR1_nq" and r.extra_info.tools_kwargs.search.create_kwargs.ground_truth == ["x"] and r.prompt[1].content == "ask: who"
    c = spark.createDataFrame([(5, [1, 2])], "target long, nums array<long>")
    made = records.countdown(c, "train", ["target"], abstention=True, hint=True).first()
    assert [m.role for m in made.prompt] == ["system", "user", "assistant"] and "[1, 2]" in made.prompt[1].content and "<hint>" in made.prompt[1].content and "abstain" in made.prompt[1].content
    assert len(records.groups_request(3)) == 2 and "3 distinct" in records.groups_request(3)[1]["content"]
    t = records.with_tool(records.problem_and_answer(spark.createDataFrame([("p", "7")], "Problem string, Answer string"), "x", ["Problem"]), "code").first()
    assert t.extra_info.tools_kwargs.code.create_kwargs.ground_truth == "7"
    text = records.first_message_asks(records.benchmark_layouts(spark.createDataFrame([("p", "7")], "problem string, answer string"), "a/B_2"), " more").first()
    assert text.data_source == "b_2" and text.prompt[0].content.endswith(" more") and text.agent_name == "tool_agent"
    two = records.two_languages(*[spark.createDataFrame([("q", "1")], "question string, answer string")] * 2, order=["question"])
    assert [r.data_source for r in two.collect()] == ["opencompass/cnmo2024_en", "opencompass/cnmo2024_zh"]


def test_metrics(spark):
    df = spark.createDataFrame([([1, 1, 0, 1, 1, 0],)], "mask array<int>")
    r = metrics.response_info(df, "mask", 3).first()
    assert (r.prompt_length, r.response_length, r.response_mask) == (2.0, 2.0, [1, 1, 0])
    empty = spark.createDataFrame([(1.0, 0)], "x double, m int")
    with pytest.raises(Exception, match="mask is empty"):
        metrics.masked_variance(empty, "x", "m").collect()
    with pytest.raises(Exception, match="one element"):
        metrics.masked_variance(empty.withColumn("m", F.lit(1)), "x", "m").collect()
    assert metrics.exact_masked_mean(empty, "x", "m").first()[0] is None
    assert metrics.largest_index(spark.createDataFrame([("3",), ("x",), (None,)], "index string")) == 3
    assert metrics.training_metrics(spark.range(1), {"a": "none"}).count() == 0
    assert losses.peak_flops("NVIDIA H100 PCIe") == 989 and losses.peak_flops("?") == math.inf and losses.peak_flops("NVIDIA L40S", "G") == 181050
    assert losses.latent_flops(8, 3, 2, 4, 2, 1, 6, 1, 16, 10, 3, 2, 4, 5, 100, 1000, 2.0) > 0


def test_resampling(spark):
    """Draws follow the weights: each row comes as often as expected, give or take one."""
    df = spark.range(50).select("id", (F.col("id") % 5 + 1.0).alias("w"))
    got = {r.id: r.n for r in advantages.resample(df, "w", ["id"], 3, 600).groupBy("id").agg(F.count("*").alias("n")).collect()}
    total = sum(i % 5 + 1 for i in range(50))
    assert sum(got.values()) == 600 and all(abs(got.get(i, 0) - 600 * (i % 5 + 1) / total) <= 2 for i in range(50))


def test_more_of_batches(spark):
    b = Batch.of(spark.range(7).select("id", (F.col("id") % 4 + 1).alias("n")), "id")
    assert [[r["id"] for r in p.collect()] for p in b.chunk(3, uneven=True)] == [[0, 1, 2], [3, 4, 5], [6]]
    assert len(b.chunk(5, uneven=True)) == 4
    out = b.map_batches(3, lambda d: d.assign(k=d["n"].cumsum()), "n long, k long", ["n"])
    assert [r["k"] for r in out.collect()] == [1, 3, 6, 4, 5, 7, 3]
    nested = Batch(b.df.limit(6)).nested_batches(4, 2).collect()
    assert sorted((r["batch"], r["micro"]) for r in nested) == [(0, 0), (0, 0), (0, 1), (0, 1)]
    with pytest.raises(ValueError):
        b.nested_batches(4, 3)
    even = Batch(b.df.filter("_pos < 6")).balanced("n", 2)
    ns = [r["n"] for r in even.collect()]
    assert abs(sum(ns[:3]) - sum(ns[3:])) <= 1


def test_more_of_samples(spark):
    from rillgrid.operators import sampling

    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, t string")
    a = sampling.first_samples(df, 5, 42, ["t"]).collect()
    assert a == sampling.first_samples(df.repartition(3), 5, 42, ["t"]).collect() and len(a) == 5
    known = spark.createDataFrame([(3,), (7,)], "index long")
    assert [r["index"] for r in sampling.continued(df.limit(3), known, ["id"]).orderBy("index").collect()] == [8, 9, 10]
    assert sampling.continued(df.limit(1), known.limit(0), ["id"]).first()["index"] == 0
    raw = df.select(F.col("id").alias("index"), F.col("t").alias("answer"))
    train, test = sampling.rl_data(df.select(F.col("id").alias("index"), F.concat(F.lit("System: s\n\nUser: "), "t", F.lit("\n\nAssistant: a")).alias("p")), raw, F.col("p"), F.struct("answer"), F.struct("index"), 0.8, 1)
    assert (train.count(), test.count()) == (16, 4) and readers.problems(train) == []
    assert [m.role for m in train.first().prompt] == ["system", "user", "assistant"]


def test_small_predicates(spark):
    got = one(spark, scoring.whole_text(F.lit("12")), scoring.whole_text(F.lit("1.2")), scoring.plain(F.lit("  A  b\n")), scoring.tight(F.lit("A b\n")), scoring.same_trimmed(F.lit(" a"), F.lit("a ")), scoring.same_lines(F.lit(["a", "b"]), F.lit("a\nb\n")), scoring.distinct_numbers(F.lit([1, 2]), F.lit(2)), scoring.case_status(F.struct(F.lit("Success").alias("status"), F.lit(None).cast("string").alias("compile_status"), F.lit("Finished").alias("run_status"), F.lit(0).alias("return_code"), F.lit("7\n").alias("stdout")), F.lit("7")))
    assert tuple(got) == (True, False, "a b", "ab", True, True, False, 1)
    df = spark.createDataFrame([(1, "2", 0.5)], "a long, b string, c double")
    assert tuple(df.select(*[scoring.whole_column(df, c) for c in "abc"]).first()) == (True, True, False)
    assert notation.same_latex("x+1", "1+x") and not notation.same_latex("ab" * 100, "ab" * 100)
    from rillgrid.functions import groups

    assert one(spark, groups.parse_all_groups(F.lit("[a,], [B]")))[0] == [["", "A"], ["B"]]


def test_judges(spark):
    calls = {"n": 0}

    def ask(text):
        if text == "bad":
            raise ConnectionError
        return f"\\boxed{{{text}}}"

    rows = spark.createDataFrame([("True",), ("bad",), (None,), ("False",)], "p string")
    out = scoring.judged(rows, "p", ask, 2, 0.0).select("p", scoring.boxed_true(F.col("judgement")).alias("s"), scoring.rule_or_judge(F.lit(0.5), scoring.boxed_true(F.col("judgement")), F.lit("train")).alias("r")).collect()
    assert [(r.s, r.r) for r in out] == [(1.0, 1.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)] and calls["n"] == 0


def test_calls_without_rows():
    class Adder:
        def __init__(self, by):
            self.by = by

        def add(self, x, y=0):
            return x + self.by + y

    w = extensions.Workers(extensions.Ranks(3), Adder, 10)
    assert w.execute_all("add", [1, 2, 3], y=5) == [16, 17, 18] and w.execute_all("add", 1) == [11] * 3 and w.execute_rank_zero("add", 2) == 12

    class Callback(extensions.CompletionCallback):
        def completed(self, messages, answer, info):
            return False

    got = Callback({}).gathered([[{"role": "user"}, {"role": "assistant"}, {"role": "tool"}], [{"role": "user"}]])
    assert [(len(r["prompt"]), len(r["response"])) for r in got] == [(1, 2), (1, 0)]
    assert extensions.LOOPS.get("tool_agent") is agents.tool_loop
    with pytest.raises(ValueError):
        extensions.LOOPS.get("none")
