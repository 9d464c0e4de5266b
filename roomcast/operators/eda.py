"""Exploratory-analysis operators (grouped aggregates; quantiles via the skew-safe operator)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomcast.operators.stats import exact_quantiles


def center_on_median(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """X = lon - median(lon), Y = lat - median(lat); centre columns ``lat0``, ``lon0`` attached.

    The centre is a two-number aggregate, fetched to the driver and applied as literals.
    """
    la = exact_quantiles(df, [], lat, [0.5]).first()
    lo = exact_quantiles(df, [], lon, [0.5]).first()
    lat0, lon0 = la["q_0"], lo["q_0"]
    return df.withColumn("x_m", F.col(lon) - F.lit(lon0)).withColumn("y_m", F.col(lat) - F.lit(lat0)).withColumn(
        "lat0", F.lit(lat0)
    ).withColumn("lon0", F.lit(lon0))


def _bin(v, lo, hi, n):
    return F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * F.lit(n)) + 1, F.lit(n))).otherwise(F.lit(1)).cast("int")


def histogram(df: DataFrame, value: str, n_bins: int, group_cols: list[str] = ()) -> DataFrame:
    """Equal-width histogram over each group's [min, max]; the max falls in the last bin.

    ``(group..., bin, edge_lo, edge_hi, count, density)``; empty bins are absent.
    """
    g = list(group_cols)
    bounds = df.groupBy(*g).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    if g:
        v = df.join(bounds, g)
    else:
        b = bounds.first()
        v = df.withColumn("_lo", F.lit(b["_lo"])).withColumn("_hi", F.lit(b["_hi"])).withColumn("_n", F.lit(b["_n"]))
    v = v.withColumn("bin", _bin(F.col(value), F.col("_lo"), F.col("_hi"), n_bins))
    h = v.groupBy(*g, "bin").agg(F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"), F.min("_n").alias("_n"),
                                 F.count(F.lit(1)).alias("count"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(n_bins)
    return h.select(
        *g, "bin",
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin") - 1) / F.lit(n_bins)).alias("edge_lo"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / F.lit(n_bins)).alias("edge_hi"),
        "count",
        (F.col("count") / (F.col("_n") * width)).alias("density"),
    )


def histogram_2d(df: DataFrame, x: str, y: str, n_bins: int) -> DataFrame:
    b = df.agg(F.min(x).alias("xlo"), F.max(x).alias("xhi"), F.min(y).alias("ylo"), F.max(y).alias("yhi")).first()
    bx = _bin(F.col(x), F.lit(b["xlo"]), F.lit(b["xhi"]), n_bins)
    by = _bin(F.col(y), F.lit(b["ylo"]), F.lit(b["yhi"]), n_bins)
    return df.groupBy(bx.alias("bx"), by.alias("by")).agg(F.count(F.lit(1)).alias("count"))


def box_stats(df: DataFrame, group_cols: list[str], value: str) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers (most extreme values inside the fences) and outlier count."""
    q = exact_quantiles(df, group_cols, value, [0.25, 0.5, 0.75]).select(
        *group_cols, F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3")
    )
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    v = F.col(value)
    w = df.join(q, group_cols).groupBy(*group_cols).agg(
        F.min(F.when(v >= lo_f, v)).alias("whisker_lo"),
        F.max(F.when(v <= hi_f, v)).alias("whisker_hi"),
        F.count(F.when((v < lo_f) | (v > hi_f), 1)).alias("outliers"),
    )
    return q.join(w, group_cols)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long describe: ``(variable, count, mean, std, min, q25, q50, q75, max)``, exact quartiles."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns]))
    lng = df.select(stack.alias("_s")).select("_s.*")
    mom = lng.groupBy("variable").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    q = exact_quantiles(lng, ["variable"], "v", [0.25, 0.5, 0.75]).select(
        "variable", F.col("q_0").alias("q25"), F.col("q_1").alias("q50"), F.col("q_2").alias("q75")
    )
    return mom.join(q, "variable")


def coverage_drift(cells: DataFrame, windows: DataFrame, fill: float) -> DataFrame:
    """Per AP: coverage and mean RSSI in the 'reference' and 'current' windows and their drift.

    ``cells``: cleaned long cells ``(scan_id, ap_id, rssi)``; ``windows``:
    ``(scan_id, window)``.  Implicit (unheard) cells count at ``fill``.
    """
    n = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    hw = cells.join(windows, "scan_id").groupBy("window", "ap_id").agg(
        F.count(F.when(F.col("rssi") > fill, 1)).alias("heard"), F.sum("rssi").alias("s"), F.count(F.lit(1)).alias("k")
    )
    cw = hw.join(F.broadcast(n), "window").select(
        "window", "ap_id", (F.col("heard") / F.col("n")).alias("coverage"),
        ((F.col("s") + (F.col("n") - F.col("k")) * F.lit(fill)) / F.col("n")).alias("mean_rssi"),
    )
    piv = cw.groupBy("ap_id").pivot("window", ["reference", "current"]).agg(
        F.first("coverage").alias("cov"), F.first("mean_rssi").alias("rssi")
    )
    aps = cells.select("ap_id").distinct()
    p = aps.join(piv, "ap_id", "left")
    cr, cc = F.coalesce(F.col("reference_cov"), F.lit(0.0)), F.coalesce(F.col("current_cov"), F.lit(0.0))
    rr, rc = F.coalesce(F.col("reference_rssi"), F.lit(fill)), F.coalesce(F.col("current_rssi"), F.lit(fill))
    return p.select("ap_id", cr.alias("cov_reference"), cc.alias("cov_current"), (cc - cr).alias("coverage_drift"),
                    (rc - rr).alias("rssi_drift"))
