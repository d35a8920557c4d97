"""Row selection by column values and grouping with functions of the caller's own."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def where_all(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows in which every named column has its value; null is a value."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()], F.lit(True)))


def where_any(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows in which any named column has its value; null is a value."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()], F.lit(False)))


def collapse(df: DataFrame, keys: Sequence[str], functions: Mapping[str, tuple[str, Callable[[pd.Series], float]]]) -> DataFrame:
    """keys and, for each name, the caller's function of a column's values in the group (a number; null for NaN).

    A function sees all values of a group at once, so groups must fit a task; where a sum, an extreme or
    another built-in aggregate will do, use that, as it is combined before the shuffle.
    """

    def made(f: Callable[[pd.Series], float]):
        def work(v: pd.Series) -> float:
            return float(f(v))

        work.__annotations__ = {"v": pd.Series, "return": float}
        return F.pandas_udf(work, "double")

    return df.groupBy(*keys).agg(*[F.nanvl(made(f)(F.col(c)), F.lit(None)).alias(name) for name, (c, f) in functions.items()])
