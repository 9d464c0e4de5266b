"""Reproducible splits: stratified holdout, stratified / plain / group folds, seeded sample.

All orders are ``(md5(cast(id as string)), id)``, the same in every engine, and
ranks come from the skew-safe ``group_rank`` (no whole-group sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomcast.operators.stats import group_rank, order_hash


def stratified_holdout(df: DataFrame, id_col: str, strat_col: str, test_frac: float = 0.2) -> DataFrame:
    """Add boolean ``is_test``: the first ``round(n * test_frac)`` rows of each class."""
    ranked = group_rank(df, [strat_col], id_col, "_rn", "_n")
    return ranked.withColumn("is_test", F.col("_rn") <= F.round(F.col("_n") * F.lit(test_frac))).drop("_rn", "_n")


def fold_count(df: DataFrame, label_col: str, max_folds: int = 5) -> int:
    """min(max_folds, smallest class count); fewer than 2 folds is an error."""
    smallest = df.groupBy(label_col).count().agg(F.min("count")).first()[0]
    k = min(max_folds, int(smallest or 0))
    if k < 2:
        raise ValueError(f"cross-validation needs two scans in every class; the smallest has {smallest or 0}")
    return k


def stratified_folds(df: DataFrame, id_col: str, label_col: str, k: int) -> DataFrame:
    """Add ``fold`` = (rank within class - 1) mod k: every class spread evenly over folds."""
    ranked = group_rank(df, [label_col], id_col, "_rn", None)
    return ranked.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_rn")


def plain_folds(df: DataFrame, id_col: str, k: int) -> DataFrame:
    """Add ``fold`` from the global rank (unstratified)."""
    ranked = group_rank(df, [], id_col, "_rn", None)
    return ranked.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_rn")


def group_folds(df: DataFrame, group_col: str, k: int) -> DataFrame:
    """Add ``fold`` so that all rows of a group (device, user) share one fold.

    Distinct groups are ranked (not rows), then joined back on the group key.
    """
    groups = df.select(group_col).distinct()
    ranked = group_rank(groups, [], group_col, "_rn", None).select(
        group_col, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int").alias("fold")
    )
    return df.join(ranked, group_col, "inner")


def seeded_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows first in ``(md5(id), id)`` order: each task keeps its own first n, no shuffle of the table."""
    return df.orderBy(order_hash(id_col), id_col).limit(n)
