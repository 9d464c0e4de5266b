"""Exploratory aggregates: centring, histograms, box statistics, describe, rollups, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomcast.functions.exprs import RSSI_FILL, r6
from roomcast.operators import eda
from roomcast.operators.stats import exact_quantiles
from roomcast.plans import common as C
from roomcast.plans.q_metrics import POS_SQL, position_errors
from roomcast.plans.registry import register
from roomcast.plans.sqlparts import CELLS
from roomcast.sources.tables import table

GEO_SQL = """
geo AS (SELECT c_custkey, c_nationkey % 3 AS building, c_acctbal AS latitude, CAST(c_custkey AS DOUBLE) * 0.5 AS longitude
        FROM customer)
"""


def _geo(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey", (F.col("c_nationkey") % 3).alias("building"),
        F.col("c_acctbal").alias("latitude"), (F.col("c_custkey").cast("double") * 0.5).alias("longitude"),
    )


@register("center_xy", sql=f"""
WITH {GEO_SQL},
ctr AS (SELECT median(latitude) AS lat0, median(longitude) AS lon0 FROM geo)
SELECT c_custkey, round(longitude - lon0, 6) AS x_m, round(latitude - lat0, 6) AS y_m,
       round(lat0, 6) AS lat0, round(lon0, 6) AS lon0 FROM geo, ctr
""")
def center_xy(spark, sf):
    """Local metres relative to the median point (X from longitude, Y from latitude)."""
    g = _geo(spark, sf)
    out = eda.center_on_median(g, "latitude", "longitude")
    return out.select(
        "c_custkey", r6(F.col("x_m")).alias("x_m"), r6(F.col("y_m")).alias("y_m"),
        r6(F.col("lat0")).alias("lat0"), r6(F.col("lon0")).alias("lon0"),
    )


def hist_sql(src: str, value: str, n: int, group: str | None) -> str:
    gsel = f"{group}, " if group else ""
    gpart = f"PARTITION BY {group}" if group else ""
    gjoin = f"USING ({group})" if group else "ON TRUE"
    return f"""
hb AS (SELECT {gsel}min({value}) AS lo, max({value}) AS hi, count(*) AS n FROM {src} {'GROUP BY ' + group if group else ''}),
hv AS (SELECT s.*, b.lo, b.hi, b.n,
              CAST(CASE WHEN b.hi > b.lo THEN least(floor((s.{value} - b.lo) / (b.hi - b.lo) * {n}) + 1, {n}) ELSE 1 END AS INTEGER) AS bin
       FROM {src} s JOIN hb b {gjoin}),
hc AS (SELECT {gsel}bin, min(lo) AS lo, min(hi) AS hi, min(n) AS n, count(*) AS count FROM hv GROUP BY ALL)
"""


@register("hist_1d", sql=f"""
WITH {GEO_SQL}, {hist_sql('geo', 'latitude', 30, None)}
SELECT bin, round(lo + (hi - lo) * (bin - 1) / 30, 6) AS edge_lo, round(lo + (hi - lo) * bin / 30, 6) AS edge_hi, count,
       round(count / (n * ((hi - lo) / 30)), 6) AS density
FROM hc
""")
def hist_1d(spark, sf):
    """30 equal-width bins over [min, max]; the last bin includes its right edge."""
    h = eda.histogram(_geo(spark, sf), "latitude", 30)
    return h.select("bin", r6(F.col("edge_lo")).alias("edge_lo"), r6(F.col("edge_hi")).alias("edge_hi"), "count",
                    r6(F.col("density")).alias("density"))


@register("hist_by_group", sql=f"""
WITH {GEO_SQL}, {hist_sql('geo', 'longitude', 50, 'building')}
SELECT building, bin, count, round(count / (n * ((hi - lo) / 50)), 6) AS density FROM hc
""")
def hist_by_group(spark, sf):
    """Per-building density histogram (50 bins over each building's range)."""
    h = eda.histogram(_geo(spark, sf), "longitude", 50, group_cols=["building"])
    return h.select("building", "bin", "count", r6(F.col("density")).alias("density"))


@register("hist_2d", sql=f"""
WITH {POS_SQL},
b AS (SELECT min(x_true) AS xlo, max(x_true) AS xhi, min(y_true) AS ylo, max(y_true) AS yhi FROM err),
v AS (SELECT CAST(CASE WHEN xhi > xlo THEN least(floor((x_true - xlo) / (xhi - xlo) * 50) + 1, 50) ELSE 1 END AS INTEGER) AS bx,
             CAST(CASE WHEN yhi > ylo THEN least(floor((y_true - ylo) / (yhi - ylo) * 50) + 1, 50) ELSE 1 END AS INTEGER) AS by_
      FROM err, b)
SELECT bx, by_ AS "by", count(*) AS count FROM v GROUP BY 1, 2
""")
def hist_2d(spark, sf):
    """50 x 50 point-density grid of the true positions."""
    e = position_errors(spark, sf)
    return eda.histogram_2d(e, "x_true", "y_true", 50)


@register("box_by_group", sql=f"""
WITH {POS_SQL},
g AS (SELECT b_true AS building, err FROM err),
q AS (SELECT building, quantile_cont(err, 0.25) AS q1, quantile_cont(err, 0.5) AS med, quantile_cont(err, 0.75) AS q3
      FROM g GROUP BY 1),
w AS (SELECT g.building, min(CASE WHEN g.err >= q.q1 - 1.5 * (q.q3 - q.q1) THEN g.err END) AS whisker_lo,
             max(CASE WHEN g.err <= q.q3 + 1.5 * (q.q3 - q.q1) THEN g.err END) AS whisker_hi,
             count(CASE WHEN g.err < q.q1 - 1.5 * (q.q3 - q.q1) OR g.err > q.q3 + 1.5 * (q.q3 - q.q1) THEN 1 END) AS outliers
      FROM g JOIN q USING (building) GROUP BY 1)
SELECT building, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(whisker_lo, 6) AS whisker_lo, round(whisker_hi, 6) AS whisker_hi, outliers
FROM q JOIN w USING (building)
""")
def box_by_group(spark, sf):
    """Box-plot statistics (quartiles, 1.5 IQR whiskers, outlier count) per building."""
    e = position_errors(spark, sf).select(F.col("b_true").alias("building"), "err")
    b = eda.box_stats(e, ["building"], "err")
    return b.select("building", *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")], "outliers")


@register("describe_exact", sql=f"""
WITH {POS_SQL},
lng AS (SELECT 'x_true' AS variable, x_true AS v FROM err UNION ALL SELECT 'y_true', y_true FROM err)
SELECT variable, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
       round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
       round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max
FROM lng GROUP BY 1
""")
def describe_exact(spark, sf):
    """Pandas-style describe with exact (interpolated) quartiles."""
    e = position_errors(spark, sf)
    d = eda.describe(e, ["x_true", "y_true"])
    return d.select("variable", "count", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@register("value_counts_rollup", sql=f"""
WITH {POS_SQL}
SELECT b_true AS building, f_true AS floor, count(*) AS count FROM err GROUP BY ROLLUP (b_true, f_true)
""")
def value_counts_rollup(spark, sf):
    """Counts per building, per building x floor, and the total (ROLLUP)."""
    e = position_errors(spark, sf)
    return e.rollup(F.col("b_true").alias("building"), F.col("f_true").alias("floor")).agg(F.count(F.lit(1)).alias("count"))


@register("coverage_drift", sql=f"""
WITH {CELLS},
win AS (SELECT o_orderkey AS scan_id, CASE WHEN year(o_orderdate) <= 1997 THEN 'reference' ELSE 'current' END AS wnd FROM orders),
sw AS (SELECT w.* FROM win w WHERE w.scan_id IN (SELECT scan_id FROM scans)),
nw AS (SELECT wnd, count(*) AS n FROM sw GROUP BY 1),
hw AS (SELECT sw.wnd, c.ap_id, count(CASE WHEN c.rssi > -110.0 THEN 1 END) AS heard, sum(c.rssi) AS s, count(*) AS k
       FROM clean c JOIN sw USING (scan_id) GROUP BY 1, 2),
cw AS (SELECT hw.wnd, hw.ap_id, hw.heard / nw.n AS coverage, (hw.s + (nw.n - hw.k) * -110.0) / nw.n AS mean_rssi
       FROM hw JOIN nw USING (wnd)),
aps AS (SELECT DISTINCT ap_id FROM clean)
SELECT a.ap_id, round(coalesce(r.coverage, 0.0), 6) AS cov_reference, round(coalesce(c.coverage, 0.0), 6) AS cov_current,
       round(coalesce(c.coverage, 0.0) - coalesce(r.coverage, 0.0), 6) AS coverage_drift,
       round(coalesce(c.mean_rssi, -110.0) - coalesce(r.mean_rssi, -110.0), 6) AS rssi_drift
FROM aps a LEFT JOIN cw r ON r.ap_id = a.ap_id AND r.wnd = 'reference'
           LEFT JOIN cw c ON c.ap_id = a.ap_id AND c.wnd = 'current'
""")
def coverage_drift(spark, sf):
    """AP coverage and mean RSSI of a current window against the reference window."""
    orders = table(spark, sf, "orders")
    win = orders.select(
        F.col("o_orderkey").alias("scan_id"),
        F.when(F.year("o_orderdate") <= 1997, F.lit("reference")).otherwise(F.lit("current")).alias("window"),
    ).join(C.scans(spark, sf), "scan_id", "left_semi")
    d = eda.coverage_drift(C.clean_cells(spark, sf), win, RSSI_FILL)
    return d.select("ap_id", *[r6(F.col(c)).alias(c) for c in ("cov_reference", "cov_current", "coverage_drift", "rssi_drift")])


@register("error_by_time", sql=f"""
WITH {POS_SQL},
t AS (SELECT e.err, e.ok, o.o_orderdate FROM err e JOIN orders o ON o.o_custkey = e.c_custkey)
SELECT CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS period, round(avg(err), 6) AS mean_err,
       round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS correct_share, count(*) AS n
FROM t GROUP BY 1
""")
def error_by_time(spark, sf):
    """Error breakdown per time window (order year of the device's scans)."""
    e = position_errors(spark, sf)
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    t = e.join(o, e.c_custkey == o.o_custkey)
    return t.groupBy(F.date_trunc("year", "o_orderdate").alias("period")).agg(
        r6(F.avg("err")).alias("mean_err"), r6(F.avg(F.col("ok").cast("double"))).alias("correct_share"),
        F.count(F.lit(1)).alias("n"),
    )
