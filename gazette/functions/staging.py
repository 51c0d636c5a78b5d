"""Columns that build on each other, each computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """For each wanted name one that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_steps(df: DataFrame, out: str, *steps: Callable[..., Column]) -> DataFrame:
    """df with the column `out`. Each step gets the columns of the steps before it; only the last one's is kept.

    A Column that an expression uses in many places is computed in each of them; a step's is computed once.
    """
    names = free_names([*df.columns, out], *(f"_step{i}" for i in range(1, len(steps))))
    cols: list[Column] = []
    for name, step in zip(names, steps, strict=False):
        df = df.withColumn(name, step(*cols))
        cols.append(F.col(name))
    return df.withColumn(out, steps[-1](*cols)).drop(*names)
