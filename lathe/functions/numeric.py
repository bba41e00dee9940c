"""Aggregates that do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(value: Column) -> Column:
    """Sum through DECIMAL(18,4), so that any order of addition gives the same double."""
    return F.sum(value.cast("decimal(18,4)")).cast("double")


def exact_mean(value: Column, where: Column | None = None) -> Column:
    """Mean of the non-null values (of rows with ``where``); null if there is none."""
    if where is not None:
        value = F.when(where, value)
    return exact_sum(value) / F.nullif(F.count(value), F.lit(0))


def mean_or_zero(value: Column, where: Column | None = None) -> Column:
    return F.coalesce(exact_mean(value, where), F.lit(0.0))


def n_where(where: Column) -> Column:
    return F.count(F.when(where, 1))
