"""Skew-safe exact order statistics: ranks within groups and quantiles.

Both operators avoid sorting a whole group inside one task.  A group (a
room, a feature, or the whole table) may hold a third of all rows, so they
work on a histogram first:

* ``group_rank`` orders rows by ``(md5(id), id)``.  The first hex digits of the
  md5 form buckets; per-(group, bucket) counts are a partial aggregate, a
  running sum over at most ``16**bucket_chars`` buckets per group gives each
  bucket's offset, and only rows of one bucket are sorted together.
* ``exact_quantiles`` counts distinct values per group (partial aggregate) and
  range-partitions them by sampled bounds, so ranges hold about equally many
  distinct values however far outliers lie.  Range totals locate the ranges that
  hold the wanted order positions; only those are sorted.  Results equal
  ``percentile`` / ``quantile_cont`` (linear interpolation).
* ``leave_one_out_quantiles`` gives the quantiles of all rows but one fold's, for every fold,
  from one such pass: a value carries its count without each fold, so no row is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomcast.session import materialize


def order_hash(id_col: str) -> Column:
    return F.md5(F.col(id_col).cast("string"))


def group_rank(
    df: DataFrame,
    group_cols: list[str],
    id_col: str,
    rank_col: str = "rn",
    count_col: str | None = "n",
    bucket_chars: int = 4,
) -> DataFrame:
    """Add ``rank_col`` = ``row_number() over (partition by group order by md5(id), id)``.

    ``count_col`` (optional) receives the group size.  Group keys must not be null.
    """
    if not group_cols:
        out = group_rank(df.withColumn("_g0", F.lit(0)), ["_g0"], id_col, rank_col, count_col, bucket_chars)
        return out.drop("_g0")
    h = "_h"
    b = "_b"
    keyed = df.withColumn(h, order_hash(id_col)).withColumn(b, F.substring(h, 1, bucket_chars))
    hist = keyed.groupBy(*group_cols, b).agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*group_cols).orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_off", F.sum("_c").over(run) - F.col("_c"))
    if count_col:
        hist = hist.withColumn(count_col, F.sum("_c").over(Window.partitionBy(*group_cols)))
    hist = hist.drop("_c")
    local = Window.partitionBy(*group_cols, b).orderBy(h, id_col)
    ranked = keyed.withColumn("_lrn", F.row_number().over(local))
    out = ranked.join(hist, on=[*group_cols, b], how="inner")
    out = out.withColumn(rank_col, (F.col("_off") + F.col("_lrn")).cast("long"))
    return out.drop(h, b, "_off", "_lrn")


def exact_quantiles(
    df: DataFrame,
    group_cols: list[str],
    value_col: str,
    probs: list[float],
    prefix: str = "q",
    count_col: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group.

    Returns ``group..., n, <prefix>_<i>`` (one column per entry of ``probs``, in
    order).  Null and NaN values are ignored; a group with no value is absent; null
    keys form a group.  ``count_col`` names a multiplicity column when rows are
    pre-aggregated; ``partitions`` sets the number of ranges (default: the session's).
    """
    v = F.nanvl(F.col(value_col).cast("double"), F.lit(None).cast("double"))
    mult = F.col(count_col).cast("long") if count_col else F.lit(1).cast("long")
    keys = [F.col(c) for c in group_cols] or [F.lit(0).alias("_g0")]
    # a struct key compares null-safely in the joins below
    vc = (
        df.select(F.struct(*keys).alias("_g"), v.alias("_v"), mult.alias("_m"))
        .where(F.col("_v").isNotNull() & (F.col("_m") > 0))
        .groupBy("_g", "_v")
        .agg(F.sum("_m").alias("_c"))
    )
    by_range = vc.repartitionByRange(partitions, "_g", "_v") if partitions else vc.repartitionByRange("_g", "_v")
    # written once: the range number is then fixed for every later read
    cut = materialize(by_range.withColumn("_p", F.spark_partition_id()))

    totals = cut.groupBy("_g", "_p").agg(F.sum("_c").alias("_pc"))
    run = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.select(
        "_g", "_p", (F.sum("_pc").over(run) - F.col("_pc")).alias("_from"), F.sum("_pc").over(run).alias("_to"),
        F.sum("_pc").over(Window.partitionBy("_g")).alias("n"),
    )
    # Wanted 0-based positions: floor and ceil of (n-1)*p for every p; each range keeps those inside it.
    wanted = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        for side, pos in ((0, F.floor(h)), (1, F.ceil(h))):
            wanted.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), pos.cast("long").alias("pos"), (h - F.floor(h)).alias("frac")))
    targets = (
        totals.select("_g", "_p", "_from", "_to", "n", F.explode(F.array(*wanted)).alias("t"))
        .where((F.col("t.pos") >= F.col("_from")) & (F.col("t.pos") < F.col("_to")))
        .groupBy("_g", "_p", "_from", "n")
        .agg(F.collect_list("t").alias("ts"))  # at most two entries per quantile
    )
    inside = Window.partitionBy("_g", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        cut.join(targets, ["_g", "_p"])
        .withColumn("_end", F.col("_from") + F.sum("_c").over(inside))
        .withColumn("_hit", F.filter("ts", lambda t: (t["pos"] >= F.col("_end") - F.col("_c")) & (t["pos"] < F.col("_end"))))
        .where(F.size("_hit") > 0)
        .select("_g", "n", "_v", F.explode("_hit").alias("t"))
    )
    aggs = []
    for i in range(len(probs)):
        this = F.col("t.i") == i
        lo = F.max(F.when(this & (F.col("t.side") == 0), F.col("_v")))
        hi = F.max(F.when(this & (F.col("t.side") == 1), F.col("_v")))
        aggs.append((lo + (hi - lo) * F.max(F.when(this, F.col("t.frac")))).alias(f"{prefix}_{i}"))
    out = rows.groupBy("_g", "n").agg(*aggs)
    return out.select(*[F.col("_g")[c].alias(c) for c in group_cols], "n", *[f"{prefix}_{i}" for i in range(len(probs))])


def leave_one_out_quantiles(
    df: DataFrame,
    group_cols: list[str],
    value_col: str,
    fold_col: str,
    n_folds: int,
    probs: list[float],
    prefix: str = "q",
) -> DataFrame:
    """Exact quantiles per group of the rows outside each fold: ``group..., fold, n, <prefix>_<i>``.

    Folds are 0 .. ``n_folds`` - 1.  Values are counted once, with one count per left-out fold; the
    counts are summed along one order for all folds.  Null and NaN values are ignored; a group
    without a value outside a fold is absent for that fold.
    """
    v = F.nanvl(F.col(value_col).cast("double"), F.lit(None).cast("double"))
    folds = range(n_folds)
    outside = [F.sum((F.col("_f") != j).cast("long")).alias(f"_c{j}") for j in folds]
    vc = (
        df.select(F.struct(*group_cols).alias("_g"), v.alias("_v"), F.col(fold_col).alias("_f"))
        .where(F.col("_v").isNotNull())
        .groupBy("_g", "_v")
        .agg(*outside)
    )
    cut = materialize(vc.repartitionByRange("_g", "_v").withColumn("_p", F.spark_partition_id()))

    totals = cut.groupBy("_g", "_p").agg(*(F.sum(f"_c{j}").alias(f"_t{j}") for j in folds))
    run = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("_g")
    totals = totals.select(
        "_g", "_p",
        *((F.sum(f"_t{j}").over(run) - F.col(f"_t{j}")).alias(f"_from{j}") for j in folds),
        *(F.sum(f"_t{j}").over(run).alias(f"_to{j}") for j in folds),
        *(F.sum(f"_t{j}").over(whole).alias(f"_n{j}") for j in folds),
    )
    wanted = []
    for j in folds:
        n = F.col(f"_n{j}")
        for i, p in enumerate(probs):
            h = (n - 1) * F.lit(float(p))
            for side, pos in ((0, F.floor(h)), (1, F.ceil(h))):
                here = (n > 0) & (pos >= F.col(f"_from{j}")) & (pos < F.col(f"_to{j}"))
                target = F.struct(
                    F.lit(j).alias("fold"), n.alias("n"), F.lit(i).alias("i"), F.lit(side).alias("side"),
                    pos.cast("long").alias("pos"), (h - F.floor(h)).alias("frac"),
                )
                wanted.append(F.when(here, target))
    targets = totals.select("_g", "_p", *(f"_from{j}" for j in folds), F.array_compact(F.array(*wanted)).alias("ts")).where(F.size("ts") > 0)
    inside = Window.partitionBy("_g", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.array(*(F.col(f"_from{j}") + F.sum(f"_c{j}").over(inside) for j in folds))
    rows = cut.join(targets, ["_g", "_p"]).withColumn("_ends", ends).withColumn("_cs", F.array(*(F.col(f"_c{j}") for j in folds)))

    def hit(t):
        end = F.element_at("_ends", t["fold"] + 1)
        return (t["pos"] < end) & (t["pos"] >= end - F.element_at("_cs", t["fold"] + 1))

    found = rows.select("_g", "_v", F.explode(F.filter("ts", hit)).alias("t"))
    aggs = []
    for i in range(len(probs)):
        this = F.col("t.i") == i
        lo = F.max(F.when(this & (F.col("t.side") == 0), F.col("_v")))
        hi = F.max(F.when(this & (F.col("t.side") == 1), F.col("_v")))
        aggs.append((lo + (hi - lo) * F.max(F.when(this, F.col("t.frac")))).alias(f"{prefix}_{i}"))
    out = found.groupBy("_g", F.col("t.fold").alias("fold"), F.col("t.n").alias("n")).agg(*aggs)
    return out.select(*[F.col("_g")[c].alias(c) for c in group_cols], "fold", "n", *[f"{prefix}_{i}" for i in range(len(probs))])
