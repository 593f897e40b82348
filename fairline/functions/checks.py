"""Fail-closed checks.  ``require_columns`` looks at the schema only and runs no job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "input") -> DataFrame:
    missing = sorted(set(columns).difference(df.columns))
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "input") -> DataFrame:
    """Run one job and fail when a key repeats."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{what}: duplicate keys on {list(keys)}")
    return df


def assert_no_rows(df: DataFrame, message: str) -> None:
    if not df.isEmpty():
        raise ValueError(message)


def join_checked(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", validate: str = "one_to_one"
) -> DataFrame:
    """Join that fails when a side declared unique repeats a key (``one_to_one``/``many_to_one``)."""
    if validate not in {"one_to_one", "many_to_one"}:
        raise ValueError("validate must be one_to_one or many_to_one")
    assert_unique(right, keys, "right side")
    if validate == "one_to_one":
        assert_unique(left, keys, "left side")
    return left.join(right, list(keys), how)
