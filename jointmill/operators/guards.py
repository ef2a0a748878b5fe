"""Checks that raise when the data break a contract, and checks of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that df lacks, in the order required."""
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str], what: str = "table") -> DataFrame:
    gone = missing_columns(df, required)
    if gone:
        raise ValueError(f"{what} lacks the columns {', '.join(gone)}")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str], what: str = "key") -> DataFrame:
    """df, after an action that looks for a repeated key."""
    bad = duplicates(df, keys).first()
    if bad:
        raise ValueError(f"{what} occurs {bad['n']} times: {', '.join(str(bad[k]) for k in keys)}")
    return df


def outside_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Values that aren't allowed, with their number; null is one of them."""
    ok = F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return df.where(~ok).groupBy(column).agg(F.count("*").alias("n"))


def require_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """df, whose rows raise when read if the column isn't in the domain."""
    ok = F.coalesce(F.col(column).isin(allowed), F.lit(False))
    fail = F.raise_error(F.concat(F.lit(f"{column} not allowed: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("boolean")
    return df.where(F.when(ok, True).otherwise(fail))


def require_rows(df: DataFrame, what: str = "result") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df
