"""Unnesting of computed arrays, and naming of computed values."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def compute_once(df: DataFrame, keep: list, value: Column, out: str) -> DataFrame:
    """``keep`` columns and ``out``, an expensive ``value`` that is not to be evaluated again.

    A filter on a plain computed column is moved below it and repeats the whole expression there. A
    filter on what a generator gives stays above it.
    """
    return df.select(*keep, F.explode_outer(F.array(value)).alias(out))


def unnest(df: DataFrame, keep: list, array: Column, value: str, pos: str | None = None) -> DataFrame:
    """``keep`` columns and one row per element of ``array``, which has no null elements.

    The outer form is used on purpose: for the inner one the optimizer infers a filter on the size
    of the array and pushes it to the scan, where the whole array expression would run again.
    """
    if pos is None:
        return df.select(*keep, F.explode_outer(array).alias(value)).filter(F.col(value).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())
