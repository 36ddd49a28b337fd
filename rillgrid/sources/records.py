"""Training records of the benchmarks and puzzles: plain columns over a row's fields, no Python on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgrid.functions import answers, notation, prompts
from rillgrid.functions.batched import batched
from rillgrid.operators.batch import number_rows
from rillgrid.operators.sampling import split

# Sentences that the prompts consist of.
GSM8K_ASK = "Let's think step by step and output the final answer after `####`."
MATH_ASK = "Let's think step by step and output the final answer within \\boxed{}."
GEOMETRY_ASK = "You FIRST think about the reasoning process as an internal monologue and then provide the final answer. The reasoning process MUST BE enclosed within <think> </think> tags. The final answer MUST BE put in \\boxed{}."
SOLVER = "You are a math expert. You are given a question and you need to solve it step by step. "
COUNTDOWN_SYSTEM = "A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant first thinks about the reasoning process and then provides the user with the answer."
COUNTDOWN_TASK = "Using the numbers {numbers}, create an equation that equals {target}. You can use basic arithmetic operations (+, -, *, /) and each number can only be used once."
COUNTDOWN_SHOW = " You should show your work and how you try different options within the <think> </think> tags. You should return the final equation with these numbers within <answer> </answer> tags, for example <answer> (1 + 2) / 3 </answer>."
COUNTDOWN_ABSTAIN = " If you believe you will not be able to solve the problem at any point of your thinking or reasoning process, you can return <answer> I abstain </answer>"
COUNTDOWN_HINT = " If you believe you will not be able to solve the problem, you can ask for a hint by printing the <hint> tag."
COUNTDOWN_START = "<think> Let me solve this step by step."
GROUPS_SYSTEM = "You are a data generator for NYT Connections-style puzzles. Return only strict JSON, no commentary."
QUESTION_MARK = "*user question:*"


def message(role: str, content: Column | str, **more: Column) -> Column:
    c = content if isinstance(content, Column) else F.lit(content)
    return F.struct(F.lit(role).alias("role"), c.alias("content"), *[v.alias(k) for k, v in more.items()])


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    return number_rows(df, *order, name="index")


# word problems and mathematics

def gsm8k(df: DataFrame, split_name: str, order: list[str], tool: str | None = None, interaction: str | None = None) -> DataFrame:
    """question, answer: a record with the number after `####` as its truth.

    tool: the name of a tool that is given the truth.  interaction: the name of a partner that is
    given question and truth.
    """
    rows = numbered(df, order)
    truth = answers.hash_answer(F.col("answer"))
    question = F.concat(F.col("question"), F.lit(" " + GSM8K_ASK))
    chat = [message("user", question)]
    extra = {"answer": F.col("answer"), "question": F.col("question")}
    if tool:
        chat.insert(0, message("system", f"{SOLVER}Reasoning step by step before any tool call. You should use the `{tool}` tool after step by step solving the question, before generate final answer at least once and refine your answer if necessary. Put your final answer in the format of `#### <answer>`."))
        extra |= {"need_tools_kwargs": F.lit(True), "tools_kwargs": tool_arguments(tool, ground_truth=truth)}
    if interaction:
        chat.insert(0, message("system", f"{SOLVER}You should rethinking carefully if user point out your answer is wrong. Put your final answer in the format of `#### <answer>`."))
        extra |= {"interaction_kwargs": F.struct(F.lit(interaction).alias("name"), F.col("question").alias("query"), truth.alias("ground_truth"))}
    return rows.select(*prompts.record("openai/gsm8k", "math", split_name, F.array(*chat), truth, F.col("index"), **extra))


def tool_arguments(tool: str, **create: Column) -> Column:
    """The arguments that a tool is created with, under its name."""
    return F.struct(F.struct(F.struct(*[c.alias(k) for k, c in create.items()]).alias("create_kwargs")).alias(tool))


def mathematics(df: DataFrame, split_name: str, order: list[str], source: str = "DigitalLearningGmbH/MATH-lighteval") -> DataFrame:
    """problem, solution: the last box of the solution is the truth."""
    ask = F.concat(F.col("problem"), F.lit(" " + MATH_ASK))
    return numbered(df, order).select(*prompts.record(source, "math", split_name, F.array(message("user", ask)), notation.box_contents(F.col("solution")), F.col("index")))


def problem_and_answer(df: DataFrame, source: str, order: list[str], problem: str = "Problem", answer: str = "Answer", ask: str = MATH_ASK, ability: str = "Math", split_name: str = "test") -> DataFrame:
    """Benchmarks that are a problem and an answer."""
    chat = F.array(message("user", F.concat(F.col(problem), F.lit(" " + ask))))
    return numbered(df, order).select(*prompts.record(source, ability, split_name, chat, F.col(answer).cast("string"), F.col("index")))


def two_languages(english: DataFrame, chinese: DataFrame, order: list[str], source: str = "opencompass/cnmo2024", chinese_ask: str = "请通过逐步推理来解答问题，并把最终答案放置于\\boxed{}中。") -> DataFrame:
    """The same benchmark in two languages, one after the other, each with its own wording."""
    parts = [problem_and_answer(english, f"{source}_en", order, "question", "answer"), problem_and_answer(chinese, f"{source}_zh", order, "question", "answer", chinese_ask)]
    return reduce(DataFrame.unionByName, parts)


def benchmark_layouts(df: DataFrame, source: str, answer_format: str = "\nThe answer format must be: \\boxed{'The final answer goes here.'}") -> DataFrame:
    """Either of two layouts, Problem/Answer or problem/answer, as one record for an agent with tools."""
    p, a = ("Problem", "Answer") if "Problem" in df.columns else ("problem", "answer")
    return df.select(
        F.lit(source.split("/")[-1].lower()).alias("data_source"), F.array(message("user", F.concat(F.col(p), F.lit(answer_format)))).alias("prompt"), F.lit("MATH").alias("ability"),
        F.struct(F.col(a).cast("string").alias("ground_truth")).alias("reward_model"), F.lit("tool_agent").alias("agent_name"),
    )


def first_message_asks(df: DataFrame, ask: str, prompt: str = "prompt") -> DataFrame:
    """df with a sentence at the end of each prompt's first message, for an agent with tools."""
    longer = F.transform(prompt, lambda m, i: F.when(i == 0, m.withField("content", F.concat(m["content"], F.lit(ask)))).otherwise(m))
    return df.withColumn(prompt, longer).withColumn("agent_name", F.lit("tool_agent"))


def with_tool(df: DataFrame, tool: str = "code_interpreter", truth: Column | None = None) -> DataFrame:
    """df with a tool's arguments in its extra_info."""
    given = truth if truth is not None else F.col("reward_model.ground_truth")
    extra = F.col("extra_info").withField("need_tools_kwargs", F.lit(True)).withField("tools_kwargs", tool_arguments(tool, ground_truth=given))
    return df.withColumn("extra_info", extra)


def with_images(df: DataFrame, split_name: str, order: list[str], tool: str | None = None, source: str = "hiyouga/geometry3k") -> DataFrame:
    """problem, answer, images: a record with the images in a column of their own."""
    rows = numbered(df, order)
    chat = [message("user", F.concat(F.col("problem"), F.lit(" " + GEOMETRY_ASK)))]
    extra = {"answer": F.col("answer"), "question": F.col("problem")}
    if tool:
        chat.insert(0, message("system", f"{SOLVER}Reasoning step by step before any tool call. You should use the `{tool}` tool after step by step solving the question, before generate final answer at least once and refine your answer if necessary."))
        extra |= {"need_tools_kwargs": F.lit(True), "tools_kwargs": tool_arguments(tool, ground_truth=F.col("answer"))}
    return rows.select(*prompts.record(source, "math", split_name, F.array(*chat), F.col("answer"), F.col("index"), **extra), "images")


# questions

def tidy_ending(text: Column) -> Column:
    """Trimmed, without bracketed marks and doubled spaces; ` [title]` is the end of a sentence."""
    x = F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(x, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def endings(df: DataFrame, split_name: str, order: list[str], source: str = "Rowan/hellaswag") -> DataFrame:
    """activity_label, ctx_a, ctx_b, endings, label: a record of choices with the right one's number; rows without a label go."""
    rows = numbered(df.filter(F.length("label") > 0), order)
    query = tidy_ending(F.concat(F.col("activity_label"), F.lit(": "), F.col("ctx_a"), F.lit(" "), capital(F.col("ctx_b"))))
    model = F.struct(F.lit("model").alias("style"), F.lit("multiple_choice").alias("eval"), F.col("label").cast("int").alias("ground_truth"), F.transform("endings", tidy_ending).alias("choices"))
    return rows.select(F.lit(source).alias("data_source"), F.array(message("user", query)).alias("prompt"), F.lit("nlp").alias("ability"), model.alias("reward_model"), F.struct(F.lit(split_name).alias("split"), F.col("index")).alias("extra_info"))


def search_questions(df: DataFrame, split_name: str, order: list[str], system: str, prefix: str) -> DataFrame:
    """question, golden_answers, data_source, ability and maybe reward_model: a record whose tool is given the truth.

    The truth is reward_model's where it has one, and else the golden answers.
    """
    rows = numbered(df, order)
    golden = F.col("golden_answers") if "golden_answers" in df.columns else F.array().cast("array<string>")
    truth = F.coalesce(F.col("reward_model.ground_truth"), golden) if "reward_model" in df.columns else golden
    tagged = F.concat(F.lit("searchR1_"), F.coalesce("data_source", F.lit("")))
    extra = F.struct("index", F.lit(True).alias("need_tools_kwargs"), "question", F.lit(split_name).alias("split"), tool_arguments("search", ground_truth=truth, question=F.col("question"), data_source=tagged).alias("tools_kwargs"))
    return rows.select(tagged.alias("data_source"), F.array(message("system", system), message("user", F.concat(F.lit(prefix.rstrip("\n")), "question"))).alias("prompt"), "ability", F.struct(truth.alias("ground_truth")).alias("reward_model"), extra.alias("extra_info"))


def dated(df: DataFrame, date: str, since: str, until: str) -> DataFrame:
    """Rows whose ISO date, compared as text, is in [since, until)."""
    return df.filter((F.col(date) >= since) & (F.col(date) < until))


def program_prompt(question: Column, starter: Column) -> Column:
    """A programming task, with starter code or to be read from standard input."""
    head = F.concat(F.lit("You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests.\n\nQuestion: "), question, F.lit("\n\n"))
    with_code = F.concat(F.lit("You will use the following starter code to write the solution to the problem and enclose your code within delimiters.\n```python\n"), starter, F.lit("\n```"))
    without = F.lit("Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within delimiters as follows. Ensure that when the python program runs, it reads the inputs, runs the algorithm and writes output to STDOUT.```python\n# YOUR CODE HERE\n```")
    return F.concat(head, F.when(F.coalesce(starter, F.lit("")) != "", with_code).otherwise(without))


def _packed(public: str | None, private: str | None, metadata: str | None) -> str | None:
    import base64
    import json
    import zlib

    def cases(text):
        if not text:
            return []
        try:
            return json.loads(text)
        except ValueError:
            # compressed JSON is read; a pickle in it is refused, as loading one runs code
            return json.loads(zlib.decompress(base64.b64decode(text)).decode())

    try:
        both = cases(public) + cases(private)
        made = {"inputs": [c["input"] for c in both], "outputs": [c["output"] for c in both], "fn_name": json.loads(metadata or "{}").get("func_name")}
    except (ValueError, KeyError, TypeError, UnicodeDecodeError, zlib.error):
        return None
    return base64.b64encode(zlib.compress(json.dumps(made).encode())).decode()


#: Public and private test cases and metadata, JSON or compressed JSON, as one compressed JSON text; null where they can't be read.
packed_cases = batched(_packed, "string")


# puzzles

def countdown_messages(numbers: Column, target: Column, abstention: bool = False, hint: bool = False) -> Column:
    """System, user and assistant messages, with sentences on abstaining and hints on request."""
    text = COUNTDOWN_TASK + COUNTDOWN_SHOW + COUNTDOWN_ABSTAIN * abstention + COUNTDOWN_HINT * hint
    return F.array(message("system", COUNTDOWN_SYSTEM), message("user", prompts.render(text, numbers=prompts.list_text(numbers), target=target)), message("assistant", COUNTDOWN_START))


def countdown_text(numbers: Column, target: Column, kind: str = "base") -> Column:
    """The same task as one text, for a plain model or one of chat marks."""
    task = COUNTDOWN_TASK + " Show your work in <think> </think> tags. And return the final answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 </answer>."
    frames = {
        "base": f"A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer.\nUser: {task}\nAssistant: Let me solve this step by step.\n<think>",
        "chat": f"<|im_start|>system\nYou are a helpful assistant. You first thinks about the reasoning process in the mind and then provides the user with the answer.<|im_end|>\n<|im_start|>user\n {task}<|im_end|>\n<|im_start|>assistant\nLet me solve this step by step.\n<think>",
    }
    return prompts.render(frames[kind], numbers=prompts.list_text(numbers), target=target)


def countdown(df: DataFrame, split_name: str, order: list[str], abstention: bool = False, hint: bool = False, source: str = "countdown") -> DataFrame:
    """target, numbers (or nums): a record with three messages."""
    n = F.coalesce(*[F.col(c) for c in ("numbers", "nums") if c in df.columns])
    truth = F.struct(F.col("target").alias("target"), n.alias("numbers"))
    return numbered(df, order).select(*prompts.record(source, "math", split_name, countdown_messages(n, F.col("target"), abstention, hint), truth, F.col("index")))


def preference(df: DataFrame, split_name: str, order: list[str], source: str = "Dahoas/full-hh-rlhf") -> DataFrame:
    """prompt, response: a record that a model judges."""
    rows = numbered(df, order)
    model = F.struct(F.lit("model").alias("style"), F.col("response").alias("ground_truth"))
    return rows.select(F.lit(source).alias("data_source"), F.array(message("user", F.col("prompt"))).alias("prompt"), F.lit("alignment").alias("ability"), model.alias("reward_model"), F.struct(F.lit(split_name).alias("split"), "index").alias("extra_info"))


def group_counts(answers_: Column, words: Column, group_count: Column, words_per_group: Column, total_words: Column) -> dict[str, Column]:
    """group_count, words_per_group and total_words of a word puzzle: as given, or from its answers and words."""
    n, g = F.coalesce(F.size(words), F.lit(0)), F.greatest(F.coalesce(F.size(answers_), F.lit(0)), F.lit(0))
    n = F.greatest(n, F.lit(0))
    count = F.coalesce(F.nullif(group_count, F.lit(0)), g)
    first = F.size(F.get(answers_, F.lit(0))["words"])
    each = F.coalesce(F.nullif(words_per_group, F.lit(0)), F.when((g > 0) & (first > 0), first).when(count > 0, F.floor(n / count)).otherwise(n)).cast("int")
    return {"group_count": count, "words_per_group": each, "total_words": F.when(n > 0, n).otherwise(F.coalesce(F.nullif(total_words, F.lit(0)), count * each))}


def connections_prompt(template: str, counts: dict[str, Column], words: Column, contest: Column, date: Column) -> Column:
    """A template with contest, date, words, the three counts and example_answer filled in."""
    one = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("<word>"), counts["words_per_group"].cast("int")), ", "), F.lit("]"))
    example = F.concat(F.lit("{"), F.array_join(F.array_repeat(one, counts["group_count"].cast("int")), ", "), F.lit("}"))
    return prompts.render(template, contest=contest, date=date, words=F.array_join(words, ", "), **counts, example_answer=example)


def knights_prompt(template: str, puzzle: Column, names: Column) -> Column:
    """A template with the puzzle's text and its people filled in."""
    return prompts.render(template, puzzle=puzzle, names=F.array_join(names, ", "))


_TEMPLATES: dict[str, str] = {}


def template(spark, path: str) -> str:
    """The text of a template's file, read once."""
    if path not in _TEMPLATES:
        _TEMPLATES[path] = spark.read.option("wholetext", True).text(path).first()[0]
    return _TEMPLATES[path]


def split_rows(df: DataFrame, prompt: Column, cot: Column, metadata: Column) -> DataFrame:
    """prompt, cot, cot_metadata and index: what the splits hold of a raw row."""
    return df.select(prompt.alias("prompt"), cot.alias("cot"), metadata.alias("cot_metadata"), F.col("index").cast("long").alias("index"))


def groups_request(count: int) -> list[dict[str, str]]:
    """Chat messages that ask a model for word groups."""
    rules = (
        'Each group must have a short description (e.g., "PALINDROMES", "NBA TEAMS"). Do not make the group too basic; should be somewhat specific.', "Each group must have exactly 4 related words.",
        "Each word should be UPPERCASE ASCII, single tokens (no phrases), no duplicates within a group.", "No copyrighted or offensive content.", "Do not use previous NYT connections puzzle themes.",
    )
    lines = "\n".join(f"- {r}" for r in rules)
    return [{"role": "system", "content": GROUPS_SYSTEM}, {"role": "user", "content": f"\nGenerate {count} distinct New York Times Connections-style groups.\n\nRules:\n{lines}\n"}]


def _groups(text: str | None) -> list[dict] | None:
    import ast
    import json

    try:
        found = json.loads(text or "")
    except ValueError:
        try:
            found = ast.literal_eval(text or "")
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
    found = found.get("groups") if isinstance(found, dict) else found
    if not isinstance(found, list):
        return None
    out = []
    for g in found:
        if isinstance(g, dict) and isinstance(g.get("words") or [], list):
            description = str(g.get("description", "")).strip()
            words = [str(w).strip().upper() for w in g.get("words") or [] if str(w).strip()]
            if description and len(words) == 4:
                out.append({"description": description, "words": words})
    return out or None


#: A model's answer, JSON or a Python literal, a list or an object of `groups`, as its groups of four words; null without any.
parse_groups_response = batched(_groups, "array<struct<description:string,words:array<string>>>")


# transcripts

def transcript_turns(content: Column) -> Column:
    """A transcript of <code>, <interpreter> and <answer> blocks as messages: what stands before a code block speaks, tool output answers."""
    cut = F.split(F.regexp_replace(content, r"(</(?:code|interpreter|answer)>)", "$1\u0001"), "\u0001")
    body = lambda c, tag: F.regexp_extract(c, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    fenced = lambda c: F.regexp_extract(c, r"(?s)```python\n?(.*?)```", 1)

    def turn(c: Column) -> Column:
        code, tool = c.contains("<code>"), c.contains("<interpreter>")
        inner = body(c, "code")
        said = F.when(code, strip(F.substring_index(c, "<code>", 1))).when(tool, strip(body(c, "interpreter"))).otherwise(strip(F.regexp_replace(c, "</?answer>", "")))
        return F.struct(F.when(tool, "tool").otherwise("assistant").alias("role"), said.alias("content"), F.when(code, F.when(fenced(inner) != "", strip(fenced(inner))).otherwise(inner)).alias("code"))

    return F.transform(F.filter(cut, lambda c: c.rlike(r"</(code|interpreter|answer)>")), turn)


def transcript(first: Column, second: Column) -> Column:
    """The question after its mark, and the turns of the answer, as one conversation."""
    at = F.locate(QUESTION_MARK, first)
    question = F.regexp_replace(F.regexp_replace(first.substr(at + len(QUESTION_MARK), F.length(first)), "</?answer>", ""), r"^\s+|\s+$", "")
    user = F.struct(F.lit("user").alias("role"), question.alias("content"), F.lit(None).cast("string").alias("code"))
    return F.concat(F.array(user), transcript_turns(second))


def shown_last_line(code: Column) -> Column:
    """A program whose last line that isn't blank is printed, unless it prints already."""
    lines = F.split(code, "\n")
    at = F.array_max(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i).otherwise(-1)))
    return F.array_join(F.transform(lines, lambda x, i: F.when((i == at) & (at >= 0) & ~x.contains("print"), F.concat(F.lit("print("), x, F.lit(")"))).otherwise(x)), "\n")


def conversations_split(df: DataFrame, key: list[str], seed: object, ratio: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of conversations, by a seeded order."""
    dealt = split(df, seed, key, ratio)
    return dealt.filter("split = 'train'").drop("split"), dealt.filter("split = 'test'").drop("split")
