"""Fingerprint ETL queries: cleaning, imputation, dense features, scaling, AP statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roomcast.functions.exprs import RSSI_FILL, r6
from roomcast.operators import features as feat
from roomcast.operators.stats import exact_quantiles
from roomcast.plans import common as C
from roomcast.plans.registry import register
from roomcast.plans.sqlparts import CELLS, FEATURES, IMU


@register("rssi_clean", sql=f"""
WITH {CELLS}
SELECT scan_id, ap_id, rssi_raw, rssi FROM clean
""")
def rssi_clean(spark, sf):
    return C.clean_cells(spark, sf).select("scan_id", "ap_id", "rssi_raw", "rssi")


@register("imu_impute_median", sql=f"""
WITH {IMU}
SELECT scan_id, imu_name, round(value, 6) AS value FROM imu_filled
""")
def imu_impute_median(spark, sf):
    return C.imu_filled(spark, sf).select("scan_id", "imu_name", r6(F.col("value")).alias("value"))


@register("feature_dense", sql=f"""
WITH {CELLS}
SELECT scan_id, ap_pos, ap_id, rssi FROM dense
""")
def feature_dense(spark, sf):
    return feat.dense_long(C.scans(spark, sf), C.clean_cells(spark, sf), C.apdim(spark, sf))


@register("alias_resolve", sql=f"""
WITH {CELLS},
req AS (
  SELECT l_orderkey AS scan_id,
         CASE WHEN l_linenumber IN (2, 4) THEN printf('WAP%03d', CAST(l_suppkey % 40 + 1 AS INTEGER))
              ELSE 'AP' || CAST(CAST(l_suppkey % 40 + 1 AS INTEGER) AS VARCHAR) END AS rkey,
         -30.0 - 2.0 * l_quantity AS value
  FROM lineitem),
req1 AS (SELECT scan_id, rkey, max(value) AS value FROM req GROUP BY 1, 2),
norm AS (
  SELECT scan_id,
         CASE WHEN starts_with(rkey, 'WAP') THEN 'AP' || CAST(CAST(substr(rkey, 4) AS INTEGER) AS VARCHAR) ELSE rkey END AS ap_id,
         CASE WHEN starts_with(rkey, 'WAP') THEN 1 ELSE 0 END AS prio, value
  FROM req1),
best AS (SELECT scan_id, ap_id, arg_min(value, prio) AS value FROM norm GROUP BY 1, 2)
SELECT s.scan_id, a.ap_id, coalesce(b.value, -100.0) AS rssi
FROM scans s CROSS JOIN apdim a LEFT JOIN best b ON b.scan_id = s.scan_id AND b.ap_id = a.ap_id
""")
def alias_resolve(spark, sf):
    """Sparse request maps keyed ``APn`` or ``WAP%03d`` resolved onto the model's AP list.

    ``APn`` beats its ``WAP`` alias; APs absent from the request get -100.
    Long form: the key is normalised and the duplicate resolved by priority
    with ``min_by`` (a partial aggregate), then densified against the AP list.
    """
    li = C.lineitem(spark, sf)
    ap_ord = (F.col("l_suppkey") % 40 + 1).cast("int")
    req = li.select(
        F.col("l_orderkey").alias("scan_id"),
        F.when(F.col("l_linenumber").isin(2, 4), F.format_string("WAP%03d", ap_ord))
        .otherwise(F.concat(F.lit("AP"), ap_ord.cast("string"))).alias("rkey"),
        (-30.0 - 2.0 * F.col("l_quantity")).alias("value"),
    ).groupBy("scan_id", "rkey").agg(F.max("value").alias("value"))
    is_wap = F.col("rkey").startswith("WAP")
    norm = req.select(
        "scan_id",
        F.when(is_wap, F.concat(F.lit("AP"), F.substring("rkey", 4, 16).cast("int").cast("string")))
        .otherwise(F.col("rkey")).alias("ap_id"),
        F.when(is_wap, 1).otherwise(0).alias("prio"),
        "value",
    )
    best = norm.groupBy("scan_id", "ap_id").agg(F.min_by("value", "prio").alias("rssi"))
    dense = feat.dense_long(C.scans(spark, sf), best, C.apdim(spark, sf), value_col="rssi", fill=-100.0)
    return dense.select("scan_id", "ap_id", "rssi")


@register("robust_scale", sql=f"""
WITH {CELLS}, {IMU}, {FEATURES}
SELECT feature, pos, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75,
       round(iqr, 6) AS iqr, round(scale, 6) AS scale
FROM scaler2
""")
def robust_scale(spark, sf):
    params = feat.robust_fit(C.feature_table(spark, sf), C.n_scans(spark, sf))
    return params.select(
        "feature", "pos", *[r6(F.col(c)).alias(c) for c in ("q25", "median", "q75", "iqr", "scale")]
    )


def _coverage(spark, sf):
    cells = C.clean_cells(spark, sf)
    heard = cells.groupBy("ap_id").agg(F.count(F.when(F.col("rssi") > RSSI_FILL, 1)).alias("heard"))
    return heard.select("ap_id", (F.col("heard") / F.lit(C.n_scans(spark, sf))).alias("coverage"))


@register("ap_coverage", sql=f"""
WITH {CELLS}
SELECT ap_id, round(avg(CASE WHEN rssi > -110.0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM dense GROUP BY 1
""")
def ap_coverage(spark, sf):
    """Share of scans hearing each AP (cleaned value above the fill), implicit cells included."""
    return _coverage(spark, sf).select("ap_id", r6(F.col("coverage")).alias("coverage"))


@register("ap_select", sql=f"""
WITH {CELLS},
cov AS (SELECT d.ap_id, a.ap_pos, avg(CASE WHEN rssi > -110.0 THEN 1.0 ELSE 0.0 END) AS coverage
        FROM dense d JOIN apdim a USING (ap_id) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (ORDER BY coverage DESC, ap_pos) AS rnk FROM cov WHERE coverage >= 0.02)
SELECT ap_id, round(coverage, 6) AS coverage, CAST(rnk AS INTEGER) AS rank FROM ranked WHERE rnk <= 200
""")
def ap_select(spark, sf):
    """Coverage >= 0.02, then the 200 best-covered APs (ties to the AP order)."""
    cov = _coverage(spark, sf).join(F.broadcast(C.apdim(spark, sf)), "ap_id").where(F.col("coverage") >= 0.02)
    # The AP dimension is small (one row per AP): a global top-k is a bounded sort.
    w = Window.orderBy(F.col("coverage").desc(), "ap_pos")
    return cov.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 200).select(
        "ap_id", r6(F.col("coverage")).alias("coverage"), "rank"
    )


def _scan_stats(spark, sf):
    """Per-scan statistics over the dense row without building it.

    Unheard cells sit at the fill, which is also the clip minimum, so the sorted
    dense row is ``m`` fills followed by the sorted observed values; a scan's
    observed values are bounded by the AP dimension.
    """
    n_ap = C.apdim(spark, sf).count()
    cells = C.clean_cells(spark, sf)
    per = cells.groupBy("scan_id").agg(
        F.count(F.when(F.col("rssi") > -85.0, 1)).alias("ap_count"),
        F.sum("rssi").alias("_s"), F.count(F.lit(1)).alias("_k"), F.max("rssi").alias("_max"),
        F.sort_array(F.collect_list("rssi")).alias("_obs"),
    )
    per = C.scans(spark, sf).join(per, "scan_id", "left")
    k = F.coalesce(F.col("_k"), F.lit(0))
    m = F.lit(n_ap) - k
    dense = F.concat(F.array_repeat(F.lit(RSSI_FILL), m.cast("int")), F.coalesce(F.col("_obs"), F.array().cast("array<double>")))
    lo = F.element_at(F.col("_d"), F.lit((n_ap - 1) // 2 + 1))
    hi = F.element_at(F.col("_d"), F.lit(n_ap // 2 + 1))
    return per.withColumn("_d", dense).select(
        "scan_id", F.coalesce("ap_count", F.lit(0)).alias("ap_count"),
        ((F.coalesce(F.col("_s"), F.lit(0.0)) + m * F.lit(RSSI_FILL)) / F.lit(n_ap)).alias("rssi_mean"),
        ((lo + hi) / 2.0).alias("rssi_median"),
        F.when(m > 0, F.greatest(F.coalesce(F.col("_max"), F.lit(RSSI_FILL)), F.lit(RSSI_FILL))).otherwise(F.col("_max")).alias("rssi_max"),
    )


@register("scan_stats", sql=f"""
WITH {CELLS}
SELECT scan_id, count(CASE WHEN rssi > -85.0 THEN 1 END) AS ap_count, round(avg(rssi), 6) AS rssi_mean,
       round(median(rssi), 6) AS rssi_median, max(rssi) AS rssi_max
FROM dense GROUP BY 1
""")
def scan_stats(spark, sf):
    s = _scan_stats(spark, sf)
    return s.select("scan_id", "ap_count", r6(F.col("rssi_mean")).alias("rssi_mean"),
                    r6(F.col("rssi_median")).alias("rssi_median"), "rssi_max")


@register("scan_quality", sql=f"""
WITH {CELLS},
st AS (SELECT scan_id, count(CASE WHEN rssi > -85.0 THEN 1 END) AS ap_count, max(rssi) AS rssi_max FROM dense GROUP BY 1)
SELECT scan_id, ap_count, rssi_max, (ap_count < 8 OR rssi_max < -85.0) AS needs_rescan FROM st
""")
def scan_quality(spark, sf):
    s = _scan_stats(spark, sf)
    return s.select("scan_id", "ap_count", "rssi_max",
                    ((F.col("ap_count") < 8) | (F.col("rssi_max") < -85.0)).alias("needs_rescan"))


@register("scan_center", sql=f"""
WITH {CELLS}
SELECT scan_id, ap_id, round(rssi - avg(rssi) OVER (PARTITION BY scan_id), 6) AS rssi_centered FROM dense
""")
def scan_center(spark, sf):
    dense = feat.dense_long(C.scans(spark, sf), C.clean_cells(spark, sf), C.apdim(spark, sf))
    w = Window.partitionBy("scan_id")  # bounded: one row per AP
    return dense.select("scan_id", "ap_id", r6(F.col("rssi") - F.avg("rssi").over(w)).alias("rssi_centered"))


@register("ap_signal_stats", sql=f"""
WITH {CELLS}
SELECT ap_id, count(*) AS n, round(avg(rssi), 6) AS mean, round(stddev_samp(rssi), 6) AS std,
       min(rssi) AS min, max(rssi) AS max, round(quantile_cont(rssi, 0.25), 6) AS q25,
       round(quantile_cont(rssi, 0.5), 6) AS q50, round(quantile_cont(rssi, 0.75), 6) AS q75,
       max(rssi) - min(rssi) AS range, round(stddev_samp(rssi) / nullif(abs(avg(rssi)), 0), 6) AS cv
FROM dense GROUP BY 1
""")
def ap_signal_stats(spark, sf):
    """Per-AP signal statistics over all scans (implicit cells at the fill value).

    Moments come from observed cells plus the implicit count; quantiles use the
    skew-safe histogram operator on value counts.
    """
    cells = C.clean_cells(spark, sf)
    ns = C.n_scans(spark, sf)
    obs = cells.groupBy("ap_id").agg(
        F.count(F.lit(1)).alias("_k"), F.sum("rssi").alias("_s"), F.sum(F.col("rssi") * F.col("rssi")).alias("_ss"),
        F.min("rssi").alias("_min"), F.max("rssi").alias("_max"),
    ).withColumn("n_scans", F.lit(ns))
    fill = F.lit(RSSI_FILL)
    m = F.col("n_scans") - F.col("_k")
    n = F.col("n_scans")
    s = F.col("_s") + m * fill
    ss = F.col("_ss") + m * fill * fill
    mean = s / n
    var = (ss - s * s / n) / (n - 1)
    mom = obs.select(
        "ap_id", n.cast("long").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"),
        F.when(m > 0, F.least(F.col("_min"), fill)).otherwise(F.col("_min")).alias("min"),
        F.when(m > 0, F.greatest(F.col("_max"), fill)).otherwise(F.col("_max")).alias("max"),
    )
    counted = cells.groupBy("ap_id", "rssi").agg(F.count(F.lit(1)).alias("_m"))
    implicit = cells.groupBy("ap_id").agg(F.count(F.lit(1)).alias("_k")).select(
        "ap_id", fill.alias("rssi"), (F.lit(ns) - F.col("_k")).alias("_m")
    )
    q = exact_quantiles(counted.unionByName(implicit), ["ap_id"], "rssi", [0.25, 0.5, 0.75], count_col="_m").drop("n")
    out = mom.join(q, "ap_id")
    return out.select(
        "ap_id", "n", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "min", "max",
        r6(F.col("q_0")).alias("q25"), r6(F.col("q_1")).alias("q50"), r6(F.col("q_2")).alias("q75"),
        (F.col("max") - F.col("min")).alias("range"),
        r6(F.col("std") / F.nullif(F.abs(F.col("mean")), F.lit(0.0))).alias("cv"),
    )
