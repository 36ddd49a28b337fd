"""What users extend: registries of estimators, losses, managers and readers, functions from files, tools, and how work is dealt to workers."""

from __future__ import annotations

import dataclasses
import functools
import importlib
import importlib.util
import json
import multiprocessing
import signal
import time
import warnings
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from enum import Enum

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgrid.functions import scoring
from rillgrid.operators import advantages, losses, sequences
from rillgrid.operators.batch import POS, Batch
from rillgrid.streaming import agents


class Registry:
    """Named functions of one kind.  A name taken by another function is an error, as is an unknown name."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def register(self, name: str | Enum):
        key = name.value if isinstance(name, Enum) else name

        def put(f):
            if self.known.get(key, f) is not f:
                raise ValueError(f"{self.kind} {key} is taken")
            self.known[key] = f
            return f

        return put

    def get(self, name: str | Enum):
        key = name.value if isinstance(name, Enum) else name
        if key not in self.known:
            raise ValueError(f"no {self.kind} {key}; known: {sorted(self.known)}")
        return self.known[key]


ESTIMATORS, POLICY_LOSSES, MANAGERS, LOOPS, PARSERS = (Registry(k) for k in ("estimator", "policy loss", "reward manager", "loop", "tool parser"))


class Estimator(Enum):
    GAE = "gae"
    GRPO = "grpo"
    REINFORCE_PLUS_PLUS = "reinforce_plus_plus"
    REINFORCE_PLUS_PLUS_BASELINE = "reinforce_plus_plus_baseline"
    REMAX = "remax"
    RLOO = "rloo"
    OPO = "opo"
    GRPO_PASSK = "grpo_passk"


# Estimators take token rows: sequence key, order, reward, mask, and what the kind needs beside.
# Outcome estimators sum a sequence's rewards, work on sequences, and give each token the result times its mask.

def _outcome(df: DataFrame, c: dict, advantage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    per = df.groupBy(*c["group"], *c["seq"]).agg(F.sum(c["reward"]).alias("_score"), F.sum(c["mask"]).alias("_length"))
    got = advantage(per.withColumn("_id", F.xxhash64(*c["seq"]))).select(*c["group"], *c["seq"], F.col("advantage").alias("_a"))
    out = df.join(got, [*c["group"], *c["seq"]]).withColumn("advantage", F.col("_a") * F.col(c["mask"])).drop("_a")
    return out.withColumn("return_", F.col("advantage"))


@ESTIMATORS.register(Estimator.GRPO)
def _grpo(df: DataFrame, by_std: bool = True, **c) -> DataFrame:
    return _outcome(df, c, lambda d: advantages.group_zscore(d, c["group"], "_score", by_std=by_std))


@ESTIMATORS.register(Estimator.GRPO_PASSK)
def _grpo_passk(df: DataFrame, by_std: bool = True, **c) -> DataFrame:
    return _outcome(df, c, lambda d: advantages.best_minus_second(d, c["group"], "_score", "_id", by_std=by_std))


@ESTIMATORS.register(Estimator.RLOO)
def _rloo(df: DataFrame, **c) -> DataFrame:
    return _outcome(df, c, lambda d: advantages.leave_one_out(d, c["group"], "_score"))


@ESTIMATORS.register(Estimator.OPO)
def _opo(df: DataFrame, **c) -> DataFrame:
    return _outcome(df, c, lambda d: advantages.length_weighted(d, c["group"], "_score", "_length"))


@ESTIMATORS.register(Estimator.REINFORCE_PLUS_PLUS_BASELINE)
def _reinforce_baseline(df: DataFrame, **c) -> DataFrame:
    """The group's mean taken off, then whitened over all masked tokens."""
    per = _outcome(df, c, lambda d: advantages.group_zscore(d, c["group"], "_score", by_std=False).withColumn("advantage", F.col("advantage")))
    return advantages.whiten(per.drop("advantage"), "return_", c["mask"], out="advantage").withColumn("advantage", F.col("advantage") * F.col(c["mask"]))


@ESTIMATORS.register(Estimator.REINFORCE_PLUS_PLUS)
def _reinforce(df: DataFrame, gamma: float = 1.0, **c) -> DataFrame:
    return sequences.discounted_advantage(df, c["seq"], c["order"], c["reward"], c["mask"], gamma)


@ESTIMATORS.register(Estimator.GAE)
def _gae(df: DataFrame, value: str = "value", gamma: float = 1.0, lam: float = 1.0, **c) -> DataFrame:
    return sequences.gae_returns(df, c["seq"], c["order"], c["reward"], value, c["mask"], gamma, lam)


@ESTIMATORS.register(Estimator.REMAX)
def _remax(df: DataFrame, baseline: str = "baseline", **c) -> DataFrame:
    return sequences.remax(df, c["seq"], c["order"], c["reward"], baseline, c["mask"])


def compute_advantage(df: DataFrame, estimator: str | Enum, seq: list[str], order: list[str], reward: str, mask: str, group: list[str] | None = None, **how) -> DataFrame:
    """Token rows with `advantage` and `return_` by the estimator of that name; how: what its kind takes beside."""
    return ESTIMATORS.get(estimator)(df, seq=seq, order=order, reward=reward, mask=mask, group=group or [], **how)


def prime_advantage(df: DataFrame, estimator: str, **how) -> DataFrame:
    """Leave-one-out over several reward sources; no other estimator."""
    if estimator != "rloo":
        raise NotImplementedError(estimator)
    return sequences.weighted_leave_one_out(df, **how)


POLICY_LOSSES.register("vanilla")(sequences.clipped_policy_loss)
POLICY_LOSSES.register("clip_cov")(losses.covariance_clipped_loss)
POLICY_LOSSES.register("kl_cov")(losses.covariance_penalty_loss)
LOOPS.register("single_turn_agent")(agents.single_turn)
LOOPS.register("tool_agent")(agents.tool_loop)
LOOPS.register("hint_agent")(agents.hint_loop)
for _name, _manager in (("naive", scoring.naive_manager), ("dapo", scoring.dapo_manager), ("batch", scoring.batch_manager), ("prime", scoring.tolerant_manager)):
    MANAGERS.register(_name)(_manager)


@dataclasses.dataclass
class FixedKL:
    """A weight that never changes."""

    value: float

    def update(self, kl: float, steps: int) -> None:
        pass


@dataclasses.dataclass
class AdaptiveKL:
    """A weight that follows the measured KL to its target."""

    value: float
    target: float
    horizon: float

    def update(self, kl: float, steps: int) -> None:
        self.value = losses.next_beta(self.value, kl, self.target, self.horizon, steps)


def kl_controller(kind: str, value: float, target: float = 0.1, horizon: float = 10_000) -> FixedKL | AdaptiveKL:
    if kind == "fixed":
        return FixedKL(value)
    if kind != "adaptive":
        raise NotImplementedError(kind)
    if horizon <= 0:
        raise ValueError("the horizon has to be above 0")
    return AdaptiveKL(value, target, horizon)


# code from elsewhere

def from_file(path: str, name: str):
    """What a Python file defines under a name."""
    spec = importlib.util.spec_from_file_location("rillgrid_extension", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} defines no {name}")
    return getattr(module, name)


def by_path(dotted: str):
    """What an importable module holds, by `module.name`."""
    module, _, name = dotted.rpartition(".")
    return getattr(importlib.import_module(module), name)


def custom_scorer(path: str, name: str, kind: str = "double", **bound) -> Callable:
    """A scorer of (text, gold) columns from a function in a file, with some of its arguments bound."""
    from rillgrid.functions.batched import batched

    return batched(functools.partial(from_file(path, name), **bound) if bound else from_file(path, name), kind)


def reward_manager(name: str = "naive", scorer: Callable[[DataFrame], object] | None = None, **how) -> Callable[[DataFrame], DataFrame]:
    """A manager with its scorer, ready for tables; without one, rows are scored by their data source."""
    use = scorer or (lambda df: scoring.by_source(F.col("data_source"), F.col("text"), F.col("ground_truth")))
    return lambda df: MANAGERS.get(name)(df, use, **how)


def within(seconds: float, processes: bool = False):
    """A function that raises TimeoutError after so many seconds: by an alarm of the main thread, or in a process of its own."""

    def wrap(f):
        @functools.wraps(f)
        def by_alarm(*args, **kwargs):
            def ring(*_):
                raise TimeoutError(f"{f.__name__} took over {seconds} s")

            before = signal.signal(signal.SIGALRM, ring)
            signal.setitimer(signal.ITIMER_REAL, seconds)
            try:
                return f(*args, **kwargs)
            finally:
                signal.setitimer(signal.ITIMER_REAL, 0)
                signal.signal(signal.SIGALRM, before)

        @functools.wraps(f)
        def by_process(*args, **kwargs):
            fork = multiprocessing.get_context("fork")
            here, there = fork.Pipe(False)

            def run():
                try:
                    there.send((True, f(*args, **kwargs)))
                except BaseException as e:  # noqa: BLE001  handed on to the caller
                    there.send((False, e))

            p = fork.Process(target=run, daemon=True)
            p.start()
            try:
                if not here.poll(seconds):
                    raise TimeoutError(f"{f.__name__} took over {seconds} s")
                ok, value = here.recv()
            finally:
                p.terminate()
                p.join()
            if not ok:
                raise value
            return value

        return by_process if processes else by_alarm

    return wrap


def deprecated(replacement: str = ""):
    """Warns at each call, and names what to use instead."""

    def wrap(f):
        @functools.wraps(f)
        def old(*args, **kwargs):
            warnings.warn(f"{f.__name__} is deprecated" + (f"; use {replacement}" if replacement else ""), FutureWarning, stacklevel=2)
            return f(*args, **kwargs)

        return old

    return wrap


@contextmanager
def timed(name: str, seconds: dict[str, float]) -> Iterator[None]:
    """Adds a block's wall time to seconds[name]."""
    began = time.perf_counter()
    try:
        yield
    finally:
        seconds[name] = seconds.get(name, 0.0) + time.perf_counter() - began


class Settings:
    """A nested configuration whose keys are attributes."""

    def __init__(self, **values):
        for k, v in values.items():
            setattr(self, k, Settings(**v) if isinstance(v, dict) else v)

    def plain(self) -> dict:
        return {k: v.plain() if isinstance(v, Settings) else v for k, v in vars(self).items()}


def regular(x):
    """Containers of any kind as lists and dicts."""
    if isinstance(x, Settings):
        x = x.plain()
    if isinstance(x, dict):
        return {k: regular(v) for k, v in x.items()}
    return [regular(v) for v in x] if isinstance(x, (list, tuple, set)) else x


def checked_settings(c: dict) -> None:
    """Errors on sizes that don't divide one another, and on options that exclude or need others.

    train_batch_size, rollout_n, workers, mini_batch_size, micro_batch_size (a worker's), and
    micro_batch_size_total (its former form), adaptive_kl_horizon, temperature and sample.
    """
    whole = c["train_batch_size"] * c.get("rollout_n", 1)
    if whole % c.get("workers", 1):
        raise ValueError(f"a batch of {whole} can't be dealt to {c['workers']} workers")
    if c.get("micro_batch_size") is not None and c.get("micro_batch_size_total") is not None:
        raise ValueError("micro_batch_size and micro_batch_size_total exclude one another")
    if not c.get("dynamic_batches"):
        if c.get("micro_batch_size") is None and c.get("micro_batch_size_total") is None:
            raise ValueError("a micro-batch size is needed")
        mini = c.get("mini_batch_size", c["train_batch_size"])
        if c["train_batch_size"] < mini:
            raise ValueError("a mini-batch is larger than the batch")
        if c.get("micro_batch_size_total") and (mini % c["micro_batch_size_total"] or c["micro_batch_size_total"] < c.get("parallel", 1)):
            raise ValueError("micro-batches don't fill a mini-batch")
    if c.get("adaptive_kl_horizon") is not None and c["adaptive_kl_horizon"] <= 0:
        raise ValueError("the horizon has to be above 0")
    if c.get("sample") and c.get("temperature", 1.0) <= 0:
        raise ValueError("sampling needs a temperature above 0")


def fitted_pools(pools: dict[str, list[int]], free: dict[str, int]) -> dict[str, list[str]]:
    """Nodes for each pool of so many devices on so many nodes, first fit; an error where there are too few."""
    left = dict(free)
    if sum(left.values()) < sum(map(sum, pools.values())):
        raise ValueError(f"{sum(map(sum, pools.values()))} devices are needed, {sum(left.values())} are there")
    out: dict[str, list[str]] = {}
    for name, sizes in pools.items():
        taken = [n for n in left if left[n] >= sizes[0]][: len(sizes)]
        if len(taken) < len(sizes):
            raise ValueError(f"pool {name} doesn't fit")
        for n in taken:
            left[n] -= sizes[0]
        out[name] = taken
    return out


# how work is dealt

class OpenEnum:
    """Names that can be added to while the program runs."""

    def __init__(self, *names: str):
        self._members: dict[str, int] = {}
        for n in names:
            self.register(n)

    def register(self, name: str) -> str:
        name = name.upper()
        if name in self._members:
            raise ValueError(f"{name} is taken")
        self._members[name] = max(self._members.values(), default=-1) + 1
        return name

    def remove(self, name: str) -> None:
        del self._members[name.upper()]

    def __contains__(self, name: str) -> bool:
        return name.upper() in self._members

    def __iter__(self) -> Iterator[str]:
        return iter(self._members)

    def __getattr__(self, name: str) -> str:
        if name.startswith("_") or name not in self._members:
            raise AttributeError(name)
        return name


Dispatch = OpenEnum("ONE_TO_ALL", "ALL_TO_ALL", "DP_COMPUTE", "DP_COMPUTE_PROTO", "MODEL_COMPUTE", "PIPELINE_AS_DATA", "PIPELINE_ONLY", "RANK_ZERO")
Execute = OpenEnum("ALL", "RANK_ZERO")


@dataclasses.dataclass(frozen=True)
class Ranks:
    """A grid of workers: data-parallel groups of tensor x pipeline ranks, tensor ranks next to one another."""

    data: int
    tensor: int = 1
    pipeline: int = 1

    @property
    def world(self) -> int:
        return self.data * self.tensor * self.pipeline

    def of(self, rank: int) -> tuple[int, int, int]:
        """(data, tensor, pipeline) of a rank."""
        return rank // self.tensor % self.data, rank % self.tensor, rank // (self.tensor * self.data)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, *self.of(r)) for r in range(self.world)], "rank int, data int, tensor int, pipeline int")


def scattered(df: DataFrame, ranks: Ranks, mode: str) -> DataFrame:
    """df (with positions) with `rank`: the worker, or workers, that each row goes to.

    ONE_TO_ALL sends all rows to all; DP_COMPUTE_PROTO deals equal parts to all; MODEL_COMPUTE deals
    them to data groups, whose ranks all get them; PIPELINE_AS_DATA counts pipeline ranks as data ranks.
    The join with the grid is with as many rows as there are workers.
    """
    grid = F.broadcast(ranks.table(df.sparkSession))
    n = df.count()

    def part(parts: int):
        if n % parts:
            raise ValueError(f"{n} rows can't be dealt to {parts}")
        return F.floor(F.col(POS) / max(1, n // parts)).cast("int")

    if mode in (Dispatch.ONE_TO_ALL, Dispatch.ALL_TO_ALL):
        return df.join(grid.select("rank"))
    if mode == Dispatch.RANK_ZERO:
        return df.withColumn("rank", F.lit(0))
    if mode in (Dispatch.DP_COMPUTE, Dispatch.DP_COMPUTE_PROTO):
        return df.withColumn("rank", part(ranks.world))
    if mode == Dispatch.MODEL_COMPUTE:
        return df.withColumn("data", part(ranks.data)).join(grid, "data").drop("data", "tensor", "pipeline")
    if mode == Dispatch.PIPELINE_AS_DATA:
        slot = grid.withColumn("slot", F.col("data") * ranks.pipeline + F.col("pipeline"))
        return df.withColumn("slot", part(ranks.data * ranks.pipeline)).join(slot, "slot").drop("slot", "data", "tensor", "pipeline")
    if mode in _CUSTOM:
        return _CUSTOM[mode][0](df, ranks)
    raise ValueError(mode)


def gathered(df: DataFrame, ranks: Ranks, mode: str) -> DataFrame:
    """The rows of the ranks whose output counts: all, or of each group of copies one."""
    if mode in _CUSTOM:
        return _CUSTOM[mode][1](df, ranks)
    grid = F.broadcast(ranks.table(df.sparkSession))
    keep = {
        Dispatch.MODEL_COMPUTE: (F.col("tensor") == 0) & (F.col("pipeline") == ranks.pipeline - 1),
        Dispatch.PIPELINE_AS_DATA: F.col("tensor") == 0,
        Dispatch.PIPELINE_ONLY: (F.col("tensor") == 0) & (F.col("data") == 0),
        Dispatch.RANK_ZERO: F.col("rank") == 0,
    }.get(mode, F.lit(True))
    return df.join(grid.filter(keep).select("rank"), "rank")


_CUSTOM: dict[str, tuple[Callable, Callable]] = {}


def register_dispatch(name: str, scatter: Callable[[DataFrame, Ranks], DataFrame], gather: Callable[[DataFrame, Ranks], DataFrame]) -> str:
    """A mode of one's own: how rows get their `rank`, and whose rows count."""
    mode = Dispatch.register(name)
    _CUSTOM[mode] = (scatter, gather)
    return mode


def update_dispatch(name: str, scatter: Callable, gather: Callable) -> None:
    """Another way for a mode that is there."""
    if name not in Dispatch:
        raise ValueError(name)
    _CUSTOM[name] = (scatter, gather)


def dealt(dispatch: str = "DP_COMPUTE_PROTO", execute: str = "ALL", blocking: bool = True):
    """Says of a worker's method, a function from one rank's rows to rows, how its input is dealt."""
    if dispatch not in Dispatch or execute not in Execute:
        raise ValueError(f"{dispatch}, {execute}")

    def mark(f):
        f.dealt = (dispatch, execute, blocking)
        return f

    return mark


class Workers:
    """Runs the marked methods of a worker's class over batches, a task for each rank; calls without rows run on the driver for one rank or all."""

    def execute_all(self, name: str, *args, **kwargs) -> list:
        """The method's value on each rank; a list argument as long as the ranks gives each its own item."""
        own = lambda x, r: x[r] if isinstance(x, list) and len(x) == self.ranks.world else x
        return [getattr(self._made(), name)(*[own(a, r) for a in args], **{k: own(v, r) for k, v in kwargs.items()}) for r in range(self.ranks.world)]

    def execute_rank_zero(self, name: str, *args, **kwargs):
        return getattr(self._made(), name)(*args, **kwargs)

    def __init__(self, ranks: Ranks, worker: type, *args, **kwargs):
        self.ranks, self._made = ranks, functools.partial(worker, *args, **kwargs)
        for name in dir(worker):
            method = getattr(worker, name)
            if hasattr(method, "dealt"):
                setattr(self, name, functools.partial(self._run, name, method.dealt, worker, args, kwargs))

    def _run(self, name: str, how: tuple, worker: type, args: tuple, kwargs: dict, batch: Batch, schema: str) -> Batch:
        mode, execute, _ = how
        padded, pad = (batch, 0) if mode in (Dispatch.ONE_TO_ALL, Dispatch.ALL_TO_ALL, Dispatch.RANK_ZERO) else batch.pad_to_divisor(self.ranks.data * (self.ranks.pipeline if mode == Dispatch.PIPELINE_AS_DATA else self.ranks.tensor * self.ranks.pipeline if mode.startswith("DP") else 1))
        rows = scattered(padded.df, self.ranks, mode)
        if execute == Execute.RANK_ZERO:
            rows = rows.filter("rank = 0")

        def one(part: pd.DataFrame) -> pd.DataFrame:
            rank = int(part["rank"].iloc[0])
            made = getattr(worker(*args, **kwargs), name)(part.drop(columns="rank").sort_values(POS))
            return made.assign(rank=rank)

        out = gathered(rows.groupBy("rank").applyInPandas(one, f"{schema}, {POS} long, rank int"), self.ranks, mode).drop("rank")
        return Batch(out, batch.meta).unpad(pad) if pad else Batch(out, batch.meta)


# tools

def call_arguments(arguments: str) -> tuple[dict, bool]:
    """(a call's arguments, whether they couldn't be read): what isn't a JSON object is none."""
    try:
        found = json.loads(arguments)
    except (ValueError, TypeError):
        return {}, True
    return (found, False) if isinstance(found, dict) else ({}, True)


def tool_schema(name: str, description: str, parameters: dict[str, dict], required: list[str] | None = None) -> dict:
    """A tool's signature as models are told it."""
    return {"type": "function", "function": {"name": name, "description": description, "parameters": {"type": "object", "properties": parameters, "required": required or []}, "strict": False}}


class Tool:
    """A tool's life: created for an instance, executed with arguments, rewarded, released."""

    def __init__(self, config: dict, schema: dict):
        self.config, self.schema, self.instances = config, schema, {}

    @property
    def name(self) -> str:
        return self.schema["function"]["name"]

    def create(self, instance: str, **given) -> str:
        self.instances[instance] = dict(given)
        return instance

    def execute(self, instance: str, arguments: dict) -> tuple[str, float, dict]:
        """(the answer, a reward, metrics)."""
        return "", 0.0, {}

    def reward(self, instance: str) -> float:
        return 0.0

    def release(self, instance: str) -> None:
        self.instances.pop(instance, None)


class Interaction(ABC):
    """A partner in a conversation: started, answering, scored, finished."""

    def __init__(self, config: dict):
        self.config, self.instances = config, {}

    def start(self, instance: str, **given) -> str:
        self.instances[instance] = dict(given)
        return instance

    @abstractmethod
    def respond(self, instance: str, messages: list[dict]) -> tuple[bool, str, float, dict]:
        """(whether the conversation ends, the answer, a score, metrics)."""

    def score(self, instance: str) -> float:
        return 0.0

    def finish(self, instance: str) -> None:
        self.instances.pop(instance, None)


def tools_from(config: dict) -> list[Tool]:
    """Tools of a configuration: {"tools": [{"class_name", "config", "tool_schema"}]}; with "type": "mcp", one for each schema that `list_tools` of its client gives."""
    out = []
    for entry in config.get("tools", []):
        kind, settings = by_path(entry["class_name"]), entry.get("config", {})
        if settings.get("type", "native") == "mcp":
            listed = by_path(settings["client"])().list_tools()
            out += [kind(settings, s) for s in listed if s["function"]["name"] in settings.get("tool_selected_list", [s["function"]["name"]])]
        elif settings.get("type", "native") == "native":
            out.append(kind(settings, entry.get("tool_schema", {})))
        else:
            raise NotImplementedError(settings["type"])
    return out


def interactions_from(config: dict) -> dict[str, Interaction]:
    """Partners of a configuration by their names, which may not repeat: {"interaction": [{"class_name", "config", "name"}]}."""
    out: dict[str, Interaction] = {}
    for entry in config.get("interaction", []):
        kind = by_path(entry["class_name"])
        name = entry.get("name") or kind.__name__.lower().removesuffix("interaction")
        if name in out:
            raise ValueError(f"two interactions named {name}")
        out[name] = kind({**entry.get("config", {}), "name": name})
    return out


class CompletionCallback(ABC):
    """What a user has done when a model's answer is there: the messages grow, tools run, and the conversation goes on or ends."""

    def __init__(self, tools: dict[str, Tool]):
        self.tools = tools

    @abstractmethod
    def completed(self, messages: list[dict], answer: dict, info: dict) -> bool:
        """Whether the conversation goes on."""

    def gathered(self, conversations: list[list[dict]]) -> list[dict]:
        """One record for each conversation: prompt and response messages."""
        out = []
        for messages in conversations:
            at = next((i for i, m in enumerate(messages) if m["role"] == "assistant"), len(messages))
            out.append({"prompt": messages[:at], "response": messages[at:]})
        return out


class AgentLoop(ABC):
    """A loop of one's own, run for each row by its registered name."""

    @abstractmethod
    def run(self, prompt: list[int]) -> dict: ...


class ToolParser(ABC):
    """Finds the calls of tools in a model's answer."""

    @abstractmethod
    def calls(self, text: str) -> list[tuple[str, dict]]: ...


@PARSERS.register("hermes")
class TaggedCalls(ToolParser):
    """JSON objects between <tool_call> tags; those that can't be read are skipped."""

    def calls(self, text: str) -> list[tuple[str, dict]]:
        out = []
        for part in text.split("<tool_call>")[1:]:
            found, bad = call_arguments(part.partition("</tool_call>")[0])
            if not bad and "name" in found and "arguments" in found:
                out.append((found["name"], found["arguments"]))
        return out


class DatasetPipeline(ABC):
    """The steps of a puzzle's data, each over tables."""

    @abstractmethod
    def create_dataset(self) -> DataFrame: ...

    @abstractmethod
    def create_split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]: ...

    @abstractmethod
    def create_generations(self, rows: DataFrame) -> DataFrame: ...

    @abstractmethod
    def supervised_rows(self, rows: DataFrame) -> DataFrame: ...

    @abstractmethod
    def training_records(self, rows: DataFrame) -> DataFrame: ...

    def run(self) -> dict[str, DataFrame]:
        """All steps: train and test records, and the rows to learn from."""
        train, test = self.create_split(self.create_dataset())
        return {"train": self.training_records(train), "test": self.training_records(test), "supervised": self.supervised_rows(self.create_generations(train))}
