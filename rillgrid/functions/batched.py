"""Plain functions of one row as Arrow-batched column functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def batched(function: Callable, kind: str) -> Callable[..., Column]:
    """function over values as a function over columns that gives `kind`; dicts become a struct's fields."""
    fields = kind.startswith("struct<")

    def over(*columns: Column) -> Column:
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([function(*row) for row in zip(*series, strict=True)], dtype=object)

        def run_fields(*series: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([function(*row) for row in zip(*series, strict=True)], columns=names)

        if not fields:
            return F.pandas_udf(run, kind)(*columns)
        names = [f.split(":")[0].strip() for f in _split(kind[7:-1])]
        return F.pandas_udf(run_fields, kind)(*columns)

    over.__doc__ = function.__doc__
    return over


def _split(fields: str) -> list[str]:
    """Fields of a struct's type text, cut at the commas that are in no angle brackets."""
    out, depth = [""], 0
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
