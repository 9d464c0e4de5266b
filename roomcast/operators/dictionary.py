"""Stable integer ids of names (P28) and category covariates.

Ids are dense numbers along an order.  No task sees more than a range of it: ranges are
sorted on their own, counted, and begin where the counts of the ranges before them end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomcast.session import materialize, scalar

UNKNOWN = "?"


def dense_numbers(df: DataFrame, order: list[Column], into: str, start: int = 0) -> DataFrame:
    """``df`` with ``into`` = start, start + 1, ... along a total order."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    # written: a row's place in its range and the range's size then stay as they are
    cut = materialize(spread.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND((1 << 33) - 1)))
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))  # one row a range
    return cut.join(F.broadcast(begins), "_part").withColumn(into, F.col("_begin") + F.col("_at") + start).drop("_part", "_at", "_begin")


def extend_ids(known: DataFrame | None, names: DataFrame, version: int) -> DataFrame:
    """``(name, id, version)`` after a load of ``names (name)``.

    Known names keep id and version.  New ones get the next ids in the order of their names and
    this load's version.  Null names are left out.
    """
    new = names.select("name").where(F.col("name").isNotNull()).distinct()
    if known is None:
        return dense_numbers(new, [F.col("name")], "id").withColumn("version", F.lit(version))
    new = new.join(known.select("name"), "name", "left_anti")
    start = scalar(known.agg(F.max("id")))
    numbered = dense_numbers(new, [F.col("name")], "id", 0 if start is None else start + 1)
    return known.select("name", "id", "version").unionByName(numbered.withColumn("version", F.lit(version)))


def fit_categories(df: DataFrame, col: str) -> DataFrame:
    """``(category, idx)``: the categories of the training rows, most frequent first, equal ones by name; null is none."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return dense_numbers(counts, [F.desc("n"), F.col("category")], "idx").select("category", "idx")


def category_features(rows: DataFrame, col: str, categories: DataFrame, first_pos: int, prefix: str, id_col: str = "scan_id") -> DataFrame:
    """One-hot vectors as sparse feature rows ``(scan_id, feature, pos, value, fill)`` behind the other features.

    A category that the fit did not see, and null, take the slot behind the last one.
    """
    n = categories.count()
    found = rows.select(F.col(id_col).alias("scan_id"), F.col(col).alias("_c")).join(categories, F.col("_c") == F.col("category"), "left")
    name = F.concat(F.lit(f"{prefix}="), F.coalesce("category", F.lit(UNKNOWN)))
    pos = (F.coalesce("idx", F.lit(n)) + first_pos).cast("int")
    return found.select("scan_id", name.alias("feature"), pos.alias("pos"), F.lit(1.0).alias("value"), F.lit(0.0).alias("fill"))
