"""Scores of answers by task, the choice of a scorer by data source, and reward managers over rows.

A scorer is a function of (text, gold) columns.  Where a number is asked for, a struct gives its
`score` field; a truth value is 1.0 or 0.0.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import answers, groups, notation, tokens
from .batched import batched

# Data sources by the scorer they go to.
GSM8K = ("openai/gsm8k",)
TEX = ("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval")
PRIME = ("numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads")
CODE = ("codecontests", "apps", "codeforces", "taco")
GEOMETRY = ("hiyouga/geometry3k",)
SEARCH = ("searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa", "searchR1_2wikimultihopqa", "searchR1_musique", "searchR1_bamboogle")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# countdown

def reached(equation: str | None, target) -> bool:
    """Whether an equation of plain arithmetic, with or without `= n` at its end, comes within 1e-5 of the target."""
    if equation is None or target is None or not set(equation) <= set("0123456789+-*/().= \t\n\r\f\v"):
        return False
    value = answers.evaluate(equation.strip().rpartition("=")[0] if _ends_in_result(equation) else equation)
    return value is not None and abs(value - Fraction(str(target))) < Fraction(1, 100_000)


def _ends_in_result(equation: str) -> bool:
    head, sign, tail = equation.rpartition("=")
    return bool(sign) and tail.strip().isdigit()


reaches = batched(reached, "boolean")


def without_result(equation: Column) -> Column:
    """An equation without `= n` at its end."""
    return F.regexp_replace(equation, r"\s*=\s*\d+\s*$", "")


def numbers_in(equation: Column) -> Column:
    return F.transform(F.regexp_extract_all(equation, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("long"))


def uses_exactly(equation: Column, numbers: Column) -> Column:
    """Whether an equation uses each number given, as often as it is given, and no other."""
    return F.array_sort(numbers_in(equation)) == F.array_sort(numbers.cast("array<bigint>"))


def uses_some_of(equation: Column, numbers: Column) -> Column:
    """Whether an equation uses only numbers given, none more often than it is given."""
    used, given = numbers_in(equation), numbers.cast("array<bigint>")
    count = lambda xs, n: F.size(F.filter(xs, lambda x: x == n))
    return F.forall(F.array_distinct(used), lambda n: count(used, n) <= count(given, n))


def _whole_target(expression: str | None, target) -> bool:
    value = answers.evaluate(expression) if expression else None
    return value is not None and value.denominator == 1 and target is not None and value == Fraction(str(target))


whole_target = batched(_whole_target, "boolean")


def evaluated_answer(answer: Column, target: Column, numbers: Column) -> Column:
    """The evaluator's verdict: numbers given, and a whole value that equals the target; anything else is wrong."""
    return F.coalesce(uses_some_of(answer, numbers) & whole_target(answer, target), F.lit(False))


def abstains(equation: Column) -> Column:
    return F.lower(F.trim(equation)) == "i abstain"


def _with_hints(text: Column, wrong: Column, right: Column | float, correct: Column, each: float | None) -> Column:
    """score, score_wo_hint_penalty and num_hints."""
    hints = groups.hint_count(text, "<hint>")
    full = right if isinstance(right, Column) else F.lit(float(right))
    paid = full if each is None else full * (1 - each * hints)
    return F.struct(F.when(correct, paid).otherwise(wrong).alias("score"), F.when(correct, full).otherwise(wrong).alias("score_wo_hint_penalty"), hints.alias("num_hints"))


def countdown(text: Column, target: Column, numbers: Column, score: float = 1.0, format_score: float = 0.1, hint_penalty: float | None = None) -> Column:
    """0 without a last answer; format_score if it's wrong; score, less a share for each hint on request, if it uses all numbers and reaches the target."""
    equation = answers.last_tag(text)
    ok = F.coalesce(uses_exactly(equation, numbers) & reaches(equation, target), F.lit(False))
    return _with_hints(text, F.when(equation.isNull(), 0.0).otherwise(format_score), score, ok, hint_penalty)


def countdown_abstaining(text: Column, target: Column, numbers: Column, abstain_score: float = 0.1) -> Column:
    """As countdown; an abstention is a wrong answer with abstain_score on top of the format's."""
    made = countdown(text, target, numbers)
    gives_up = F.coalesce(abstains(answers.last_tag(text)), F.lit(False))
    return made.withField("abstained", gives_up).withField("score_with_abstention", F.when(gives_up, made["score"] + abstain_score).otherwise(made["score"]))


def countdown_hinted(text: Column, target: Column, numbers: Column) -> Column:
    return countdown(text, target, numbers, hint_penalty=0.1)


# connections

def last_line(text: Column) -> Column:
    """The last line with more than white space, trimmed; null without one."""
    return F.try_element_at(F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), trimmed), lambda x: x != ""), F.lit(-1))


def tagged_or_last_line(text: Column) -> Column:
    found = answers.first_tag(text)
    return F.coalesce(found, last_line(text))


def connections(text: Column, solution: Column, words: Column, score: float = 1.0, format_score: float = 0.1, wrong: float = 0.0, abstain_score: float = 0.0, hint_penalty: float | None = None) -> Column:
    """The groups of the first answer, or last line, against those of the gold: words is an array of arrays.

    Abstaining gives abstain_score; the same groups in any order, or a text that holds the gold one
    or stands in it, is right.
    """
    answer = tagged_or_last_line(text)
    plain = lambda c: F.regexp_replace(F.lower(trimmed(c)), r"\s+", " ")
    a = plain(answer)
    rendered = F.concat(F.lit("{"), F.array_join(F.transform(words, lambda g: F.concat(F.lit("["), F.array_join(F.transform(g, F.upper), ", "), F.lit("]"))), ", "), F.lit("}"))
    near = lambda c: (c == a) | F.contains(c, a) | F.contains(a, c)
    gold = F.array_sort(F.transform(words, lambda g: F.array_sort(F.transform(g, F.upper))))
    ok = F.coalesce(groups.parse_groups(answer) == gold, F.lit(False)) | F.coalesce(near(plain(solution)), F.lit(False)) | F.coalesce(near(plain(rendered)), F.lit(False))
    none = answer.isNull() | (answer == "")
    gives_up = ~none & F.contains(a, F.lit("abstain"))
    return _with_hints(text, F.when(none, wrong).when(gives_up, abstain_score).otherwise(format_score), score, ~none & ~gives_up & ok, hint_penalty)


def connections_abstaining(text: Column, solution: Column, words: Column) -> Column:
    return connections(text, solution, words, abstain_score=0.3)


def connections_hinted(text: Column, solution: Column, words: Column) -> Column:
    return connections(text, solution, words, hint_penalty=0.1)


def roles_right(text: Column, names: Column, solution: Column) -> Column:
    """Whether the last `Answer: {Name = Role}` names everyone with the right role, in any case; solution: a boolean for each name, true for a knight."""
    found = groups.roles(text)
    wanted = F.map_from_arrays(F.transform(names, F.lower), F.transform(solution, lambda k: F.when(k, "knight").otherwise("knave")))
    entries = lambda m: F.array_sort(F.map_entries(m))
    return F.coalesce(entries(found) == entries(wanted), F.lit(False))


# mathematics, questions, programs

def flexible_number(text: Column, gold: Column) -> Column:
    """1.0 if the last number of the text is gold."""
    return answers.gsm8k_score(text, gold, strict=False)


def boxed_tex(text: Column, gold: Column) -> Column:
    """1.0 if the last box and gold have one TeX form."""
    return batched(lambda t, g: float(t is not None and (b := notation.box_content(t, True)) is not None and notation.same_tex(b, g)), "double")(text, gold)


def boxed_text(text: Column, gold: Column) -> Column:
    """1.0 if the last box holds gold to the letter."""
    return F.coalesce((notation.box_contents(text) == gold).cast("double"), F.lit(0.0))


def boxed_true(text: Column) -> Column:
    """1.0 if the last box says True: a judge's verdict."""
    return boxed_text(text, F.lit("True"))


def thinks_and_boxes(text: Column) -> Column:
    """1.0 if the whole text is a thought followed by a box."""
    return F.coalesce(F.regexp_like(text, F.lit(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z")).cast("double"), F.lit(0.0))


def geometry(text: Column, gold: Column, boxed: bool = True, format_score: float = 0.1) -> Column:
    """(1 - format_score) for a right answer, and format_score for the format."""
    answer = notation.box_contents(text) if boxed else text
    right = F.coalesce(notation.grades(answer, gold), F.lit(False)).cast("double")
    return (1 - format_score) * right + format_score * thinks_and_boxes(text)


def last_block(text: Column) -> Column:
    """What stands in the last pair of answer tags, over lines; null without one."""
    return trimmed(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)))


def tag_counts(text: Column) -> tuple[Column, Column]:
    return tuple(F.coalesce(F.regexp_count(text, F.lit(t)), F.lit(0)) for t in ("<answer>", "</answer>"))


def search_exact(text: Column, golds: Column, format_score: float = 0.0, score: float = 1.0, substring: bool = False) -> Column:
    """0 without an answer; score if it's one of the golds, a quarter with more than ten tags; else format_score.

    substring: a gold within the answer is enough, and tags don't count.
    """
    answer = last_block(text)
    opened, closed = tag_counts(text)
    hit = (answers.sub_exact_match if substring else answers.exact_match)(answer, golds) == 1
    full = F.lit(float(score)) if substring else F.when((opened > 10) | (closed > 10), score / 4).otherwise(float(score))
    return F.when(answer.isNull(), 0.0).when(F.coalesce(hit, F.lit(False)), full).otherwise(float(format_score))


def passed_share(results: Column, continuous: bool = True, first: int = 10) -> Column:
    """From results of a program's tests: 1.0 if all pass; else the share among the first ten, or 0.0 where parts don't count."""
    all_ = F.forall(results, lambda r: r)
    some = F.slice(results, 1, first)
    share = F.aggregate(some, F.lit(0.0), lambda s, r: s + r.cast("double")) / F.size(some)
    return F.when(results.isNull() | (F.size(results) == 0), 0.0).when(all_, 1.0).otherwise(share if continuous else F.lit(0.0))


def after_compile_error(codes: Column, error: int = -4) -> Column:
    """Status codes of tests in order: from the first compile error on, all are one."""
    at = F.array_position(codes, error).cast("int")
    return F.transform(codes, lambda c, i: F.when((at > 0) & (i + 1 >= at), error).otherwise(c))


def case_status(response: Column, expected: Column) -> Column:
    """A sandbox's answer as a code: 1 right, 0 wrong output, -1 service error, -2 run error, -3 time limit, -4 compile error.

    response: struct of status, compile_status, run_status, return_code and stdout.
    """
    out = lambda c: F.rtrim(F.regexp_replace(c, r"\s+$", ""))
    finished = response["status"] == "Success"
    return (
        F.when(response.isNull() | response["status"].isNull(), -1)
        .when(response["compile_status"].isin("Error") | ((response["compile_status"] == "TimeLimitExceeded")), -4)
        .when(response["run_status"] == "TimeLimitExceeded", -3)
        .when(finished & (out(response["stdout"]) == out(expected)), 1)
        .when(finished, 0)
        .when((response["run_status"] == "Error") | (response["return_code"] != 0), -2)
        .otherwise(-1)
    )


def choice(text: Column, gold: Column) -> Column:
    """1.0 if the first letter named as the answer is gold."""
    return F.coalesce((groups.first_choice(text) == gold).cast("double"), F.lit(0.0))


def strict_box_with_calls(text: Column, gold: Column, turns: Column) -> Column:
    """score, acc and pred of the strict box; a wrong answer earns a twentieth for each turn beyond two, up to 0 in all."""
    made = notation.strict_dapo_scores(text, gold)
    bonus = (turns - 2) / 2 * 0.1
    return made.withField("score", F.when(made["score"] < 0, F.least(F.lit(0.0), made["score"] + bonus)).otherwise(made["score"])).withField("pred", F.coalesce(made["pred"], F.lit("")))


def rule_or_judge(rule: Column, judge: Column, split: Column) -> Column:
    """A judge's score on rows of training, the rule's on those of a test."""
    return F.when(split == "test", rule).otherwise(F.coalesce(judge, F.lit(0.0)))


# the choice of a scorer

def as_number(score: Column, kind: str) -> Column:
    """A scorer's result as a double: a struct's score or first field, a truth value, or the number itself."""
    return (score["score"] if kind == "struct" else score).cast("double")


def by_source(source: Column, text: Column, gold: Column, golds: Column | None = None, results: Column | None = None) -> Column:
    """The score of each row by its data source; an unknown source is an error.

    golds: gold answers of search questions, an array (gold alone where left out).  results: truth
    values of a program's tests, which are run elsewhere.  Arrow scorers see null texts for rows
    of other sources.
    """
    mine = lambda *names: source.isin(*names)
    aime = (source == "math_dapo") | source.startswith("aime")
    only = lambda test: F.when(test, text)
    prime = notation.prime_scores(only(mine(*PRIME)), gold)
    return (
        F.when(mine(*GSM8K), answers.gsm8k_score(text, gold))
        .when(mine(*TEX), boxed_tex(only(mine(*TEX)), gold))
        .when(aime, notation.dapo_scores(only(aime), gold)["score"])
        .when(mine(*PRIME), prime["correct"].cast("double"))
        .when(mine(*CODE), passed_share(results) if results is not None else F.raise_error(F.lit("results of the tests are needed")).cast("double"))
        .when(mine(*GEOMETRY), geometry(only(mine(*GEOMETRY)), gold))
        .when(mine(*SEARCH), search_exact(text, golds if golds is not None else F.array(gold)))
        .otherwise(F.raise_error(F.concat(F.lit("no scorer for data source "), F.coalesce(source, F.lit("null")))).cast("double"))
    )


def first_recipe(source: Column, text: Column, gold: Column, results: Column | None = None) -> Column:
    """The reasoning recipe's choice: mathematics by the value graders, one question set by letters, one by program tests."""
    maths = source.isin("Maxwell-Jia/AIME_2024", "opencompass/cnmo2024_en", "opencompass/cnmo2024_zh")
    graded = notation.grades(F.when(maths, notation.box_contents(text)), gold).cast("double")
    code = passed_share(results, False) if results is not None else F.lit(None).cast("double")
    return F.when(maths, F.coalesce(graded, F.lit(0.0))).when(source == "Idavidrein/gpqa", choice(text, gold)).when(source.isin("livecodebench/code_generation_lite", "livecodebench/code_generation"), code).otherwise(
        F.raise_error(F.concat(F.lit("no scorer for data source "), F.coalesce(source, F.lit("null")))).cast("double")
    )


def one_scorer(scorer: Callable[[Column, Column], Column], text: Column, gold: Column, field: str | None = None) -> Column:
    """One scorer for every source, as a double."""
    made = scorer(text, gold)
    return (made[field] if field else made).cast("double")


# reward managers: rows with a response mask get token rewards and what the scorer gives beside

def rewarded(df: DataFrame, score: Column, mask: str = "response_mask", **extra: Column) -> DataFrame:
    """df with `score`, `reward` (zeros and the score at the last valid token) and more columns of the scorer."""
    scored = df.withColumns({"score": score.cast("double"), **extra})
    return scored.withColumn("reward", tokens.at_last(F.col(mask), F.col("score")))


def naive_manager(df: DataFrame, scorer: Callable[[DataFrame], Column], mask: str = "response_mask") -> DataFrame:
    """The scorer's number, or its struct with all fields as columns."""
    made = df.withColumn("_made", scorer(df))
    kind = dict(made.dtypes)["_made"]
    fields = [f for f in made.schema["_made"].dataType.names if f != "score"] if kind.startswith("struct") else []
    score = F.col("_made.score") if kind.startswith("struct") else F.col("_made")
    return rewarded(made, score, mask, **{f: F.col(f"_made.{f}") for f in fields}).drop("_made")


def dapo_manager(df: DataFrame, scorer: Callable[[DataFrame], Column], mask: str = "response_mask", longest: int = 0, buffer: int = 0, factor: float = 1.0) -> DataFrame:
    """The naive manager's rewards with the penalty on long responses, which is 0 where buffer is 0."""
    out = naive_manager(df, scorer, mask)
    if not buffer:
        return out
    penalty = answers.overlong_penalty(tokens.total(F.col(mask)), longest, buffer, factor)
    out = out.withColumn("overlong_reward", penalty).withColumn("overlong", penalty < 0)
    return out.withColumn("reward", tokens.at_last(F.col(mask), F.col("score") + F.col("overlong_reward")))


def batch_manager(df: DataFrame, scorer: Callable[[DataFrame], Column], mask: str = "response_mask") -> DataFrame:
    """The naive manager's rewards, with the score as `acc` too."""
    return naive_manager(df, scorer, mask).withColumn("acc", F.col("score"))


def tolerant_manager(df: DataFrame, scorer: Callable[[DataFrame], Column], mask: str = "response_mask") -> DataFrame:
    """Rewards where a row without a score gets 0."""
    return batch_manager(df, lambda d: F.coalesce(scorer(d).cast("double"), F.lit(0.0)), mask)


def compute_reward(df: DataFrame, manager: Callable[..., DataFrame], scorer: Callable[[DataFrame], Column], **how) -> tuple[DataFrame, list[str]]:
    """A manager's rows, and the names of the columns that it adds beside reward and score."""
    out = manager(df, scorer, **how)
    return out, [c for c in out.columns if c not in df.columns and c not in ("reward", "score")]


# tools and interactions

def submission_rewards(df: DataFrame, instance: list[str], order: str, score: str, penalty: float = -0.05) -> DataFrame:
    """df with `tool_reward`: 0 where a submission beats the instance's last, else the penalty; before the first it is 0."""
    last = F.lag(score, 1, 0.0).over(Window.partitionBy(*instance).orderBy(order))
    return df.withColumn("tool_reward", F.when(F.col(score) > last, 0.0).otherwise(penalty))


def last_user_score(df: DataFrame, conversation: list[str], order: str, role: str, content: str, scorer: Callable[[Column], Column], user: str = "user") -> DataFrame:
    """Per conversation: the last user message's score, and whether it ends the conversation, being right."""
    last = df.filter(F.col(role) == user).groupBy(*conversation).agg(F.max_by(content, order).alias("_c"))
    text = F.when(F.col("_c").startswith("#### "), F.col("_c")).otherwise(F.concat(F.lit("#### "), F.col("_c")))
    return last.select(*conversation, scorer(text).cast("double").alias("score")).withColumn("finished", F.col("score") == 1.0)


# verdicts over tables, judges, and small predicates

def checked_generations(generations: DataFrame, raw: DataFrame, text: str, target: str = "target", numbers: str = "numbers", key: str = "index") -> DataFrame:
    """generations with `correct`, by the raw row of their index: one join in place of a scan for each row."""
    rows = generations.join(raw.select(key, F.col(target).alias("_target"), F.col(numbers).alias("_numbers")), key, "left")
    verdict = evaluated_answer(answers.tag_or_line(F.col(text)), F.col("_target"), F.col("_numbers"))
    return rows.withColumn("correct", F.coalesce(verdict, F.lit(False))).drop("_target", "_numbers")


def judged(df: DataFrame, prompt: str, ask: Callable[[str], str], attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """df with `judgement`, a model's answer to each prompt, asked from the executors; null where all attempts failed.

    Pauses double from one attempt to the next.
    """

    def one(text: str | None) -> str | None:
        for k in range(attempts if text is not None else 0):
            try:
                return ask(text)
            except Exception:  # noqa: BLE001  whatever a service raises is a failed attempt
                if k < attempts - 1:
                    sleep(wait * 2**k)
        return None

    return df.withColumn("judgement", batched(one, "string")(F.col(prompt)))


def whole_text(x: Column) -> Column:
    """Whether a text is digits alone."""
    return F.coalesce(x.cast("string").rlike(r"^\d+$"), F.lit(False))


def whole_type(kind: str) -> bool:
    """Whether a column's type is one of whole numbers."""
    return kind in ("tinyint", "smallint", "int", "bigint")


def whole_column(df: DataFrame, column: str) -> Column:
    """Either: a column of whole numbers, or a text of digits."""
    return F.col(column).isNotNull() if whole_type(dict(df.dtypes)[column]) else whole_text(F.col(column))


def plain(text: Column) -> Column:
    """Trimmed, lower case, white space as one space."""
    return F.regexp_replace(F.lower(trimmed(text)), r"\s+", " ")


def tight(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def same_trimmed(a: Column, b: Column) -> Column:
    return trimmed(a) == trimmed(b)


def same_lines(output: Column, truth: Column) -> Column:
    """An array of lines, or one text, against a truth, both trimmed."""
    return trimmed(F.array_join(output, "\n")) == trimmed(truth)


def distinct_numbers(numbers: Column, target: Column) -> Column:
    """Whether all numbers differ, from one another and from the target."""
    return (F.size(F.array_distinct(numbers)) == F.size(numbers)) & ~F.array_contains(numbers, target)
