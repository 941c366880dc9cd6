"""Comparing two versions of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of several tables in one job; each scan reads no column."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    return reduce(DataFrame.union, parts)


def diff_summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of (table, n) on both sides: added, removed, changed or same, with the difference."""
    both = left.withColumnRenamed("n", "left_n").join(right.withColumnRenamed("n", "right_n"), "table", "full_outer")
    status = F.when(F.col("left_n").isNull(), "added").when(F.col("right_n").isNull(), "removed").when(F.col("left_n") != F.col("right_n"), "changed").otherwise("same")
    return both.select("table", "left_n", "right_n", status.alias("status"), (F.coalesce("right_n", F.lit(0)) - F.coalesce("left_n", F.lit(0))).alias("delta"))


def diff_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("same", "changed", "added", "removed")])


def diff_rows(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """insert, delete or update for each key whose rows differ, null-safe; the values are the right side's, a delete's the left's."""
    rest = [c for c in left.columns if c not in keys]
    l_, r_ = (df.select(*keys, F.struct(*rest).alias(side)) for df, side in ((left, "_l"), (right, "_r")))
    both = l_.join(r_, list(keys), "full_outer").where(~F.col("_l").eqNullSafe(F.col("_r")))
    op = F.when(F.col("_l").isNull(), "insert").when(F.col("_r").isNull(), "delete").otherwise("update")
    return both.select(*keys, op.alias("op"), F.coalesce("_r", "_l").alias("_v")).select(*keys, "op", "_v.*")
