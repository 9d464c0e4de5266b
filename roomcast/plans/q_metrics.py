"""Evaluation queries: classification metrics, confusion, position error, splits, dataset summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomcast.functions.exprs import IMU_COLUMNS, r6
from roomcast.operators import metrics as M
from roomcast.operators import split as S
from roomcast.operators.stats import exact_quantiles
from roomcast.plans import common as C
from roomcast.plans.registry import register
from roomcast.plans.sqlmetrics import acc_sql, macro_sql, per_class_sql
from roomcast.plans.sqlparts import CELLS, LABELS
from roomcast.session import scalar
from roomcast.sources.tables import table

# Class pairs: true = quality, predicted = 1 - toxic (all four cells occupied).
PAIRS_SQL = "pairs AS (SELECT doc_id, quality AS y_true, 1 - toxic AS y_pred FROM labels)"


def _pairs(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.select("doc_id", F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred"))


@register("accuracy", sql=f"""
WITH {PAIRS_SQL}, {acc_sql('pairs', 'y_true', 'y_pred', [])}
SELECT round(accuracy, 6) AS accuracy, n FROM acc
""")
def accuracy(spark, sf):
    a = M.accuracy(_pairs(spark, sf), "y_true", "y_pred")
    return a.select(r6(F.col("accuracy")).alias("accuracy"), "n")


@register("per_class_prf", sql=f"""
WITH {PAIRS_SQL}, {per_class_sql('pairs', 'y_true', 'y_pred', [])}
SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, support,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc
""")
def per_class_prf(spark, sf):
    pc = M.per_class(_pairs(spark, sf), "y_true", "y_pred")
    return pc.select("label", "tp", "fp", "fn", "support", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@register("macro_prf", sql=f"""
WITH {PAIRS_SQL}, {per_class_sql('pairs', 'y_true', 'y_pred', [])}, {macro_sql('pc', [])}
SELECT round(precision_macro, 6) AS precision_macro, round(recall_macro, 6) AS recall_macro,
       round(f1_macro, 6) AS f1_macro FROM macro
""")
def macro_prf(spark, sf):
    m = M.prf(_pairs(spark, sf), "y_true", "y_pred", average="macro")
    return m.select(*[r6(F.col(c)).alias(c) for c in ("precision_macro", "recall_macro", "f1_macro")])


@register("weighted_prf", sql=f"""
WITH {PAIRS_SQL}, {per_class_sql('pairs', 'y_true', 'y_pred', [])}
SELECT round(sum(precision * support) / sum(support), 6) AS precision_weighted,
       round(sum(recall * support) / sum(support), 6) AS recall_weighted,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM pc
""")
def weighted_prf(spark, sf):
    m = M.prf(_pairs(spark, sf), "y_true", "y_pred", average="weighted")
    return m.select(*[r6(F.col(c)).alias(c) for c in ("precision_weighted", "recall_weighted", "f1_weighted")])


@register("confusion_norm", sql=f"""
WITH {PAIRS_SQL},
labs AS (SELECT y_true AS l FROM pairs UNION SELECT y_pred FROM pairs),
grid AS (SELECT a.l AS true_label, b.l AS pred_label FROM labs a CROSS JOIN labs b),
cnt AS (SELECT y_true AS true_label, y_pred AS pred_label, count(*) AS c FROM pairs GROUP BY 1, 2),
full_ AS (SELECT g.true_label, g.pred_label, coalesce(c.c, 0) AS count FROM grid g
          LEFT JOIN cnt c ON c.true_label = g.true_label AND c.pred_label = g.pred_label)
SELECT true_label, pred_label, count,
       round(CASE WHEN sum(count) OVER (PARTITION BY true_label) > 0
                  THEN count / sum(count) OVER (PARTITION BY true_label) ELSE 0.0 END, 6) AS share
FROM full_
""")
def confusion_norm(spark, sf):
    """Row-normalised confusion over the labels that are true or predicted."""
    cm = M.confusion_dense(_pairs(spark, sf), "y_true", "y_pred")
    return cm.select("true_label", "pred_label", "count", r6(F.col("share")).alias("share"))


# --- fingerprint label summaries ------------------------------------------------


@register("class_counts", sql=f"""
WITH {LABELS}
SELECT room_id, count(*) AS count, min(count(*)) OVER () AS min_count,
       CAST(least(5, min(count(*)) OVER ()) AS INTEGER) AS cv_folds
FROM scan_labels WHERE scan_id IN (SELECT l_orderkey FROM lineitem) GROUP BY 1
""")
def class_counts(spark, sf):
    """A4: scans per room, the smallest room and the fold count it allows."""
    labels = C.scan_labels(spark, sf)
    counts = labels.groupBy("room_id").count()
    smallest = scalar(counts.agg(F.min("count")))
    return counts.select(
        "room_id", "count", F.lit(smallest).cast("long").alias("min_count"),
        F.lit(min(5, int(smallest))).cast("int").alias("cv_folds"),
    )


@register("top_classes", sql=f"""
WITH {LABELS}
SELECT room_id, count(*) AS count FROM scan_labels WHERE scan_id IN (SELECT l_orderkey FROM lineitem)
GROUP BY 1 ORDER BY count DESC, room_id LIMIT 30
""")
def top_classes(spark, sf):
    """The 30 most frequent classes (a top-k report; the limit is the feature)."""
    counts = C.scan_labels(spark, sf).groupBy("room_id").count()
    return counts.orderBy(F.col("count").desc(), "room_id").limit(30)


@register("dataset_summary", sql=f"""
WITH {CELLS}, {LABELS}
SELECT (SELECT count(*) FROM scans) AS samples,
       (SELECT CAST(count(*) AS INTEGER) FROM apdim) AS ap_features,
       CAST({len(IMU_COLUMNS)} AS INTEGER) AS imu_features,
       (SELECT CAST(count(*) AS INTEGER) FROM apdim) + {len(IMU_COLUMNS)} AS total_features,
       (SELECT count(DISTINCT room_id) FROM scan_labels WHERE scan_id IN (SELECT scan_id FROM scans)) AS room_classes,
       (SELECT count(DISTINCT floor) FROM scan_labels WHERE scan_id IN (SELECT scan_id FROM scans)) AS floor_classes
""")
def dataset_summary(spark, sf):
    """A5: samples, feature counts, distinct rooms and floors."""
    labels = C.scan_labels(spark, sf)
    agg = labels.agg(
        F.count(F.lit(1)).alias("samples"),
        F.countDistinct("room_id").alias("room_classes"),
        F.countDistinct("floor").alias("floor_classes"),
    )
    n_ap = C.apdim(spark, sf).count()
    return agg.select(
        "samples", F.lit(n_ap).cast("int").alias("ap_features"), F.lit(len(IMU_COLUMNS)).cast("int").alias("imu_features"),
        F.lit(n_ap + len(IMU_COLUMNS)).cast("int").alias("total_features"), "room_classes", "floor_classes",
    )


# --- splits ---------------------------------------------------------------------


@register("stratified_holdout", sql=f"""
WITH {LABELS},
s AS (SELECT * FROM scan_labels WHERE scan_id IN (SELECT l_orderkey FROM lineitem)),
r AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY md5(CAST(scan_id AS VARCHAR)), scan_id) AS rn,
             count(*) OVER (PARTITION BY room_id) AS n FROM s)
SELECT scan_id, room_id, rn <= round(n * 0.2) AS is_test FROM r
""")
def stratified_holdout(spark, sf):
    """20 % of every room, by md5 order of the scan id."""
    s = S.stratified_holdout(C.scan_labels(spark, sf), "scan_id", "room_id", 0.2)
    return s.select("scan_id", "room_id", "is_test")


@register("stratified_folds", sql=f"""
WITH {LABELS},
s AS (SELECT * FROM scan_labels WHERE scan_id IN (SELECT l_orderkey FROM lineitem)),
k AS (SELECT least(5, min(c)) AS kf FROM (SELECT room_id, count(*) AS c FROM s GROUP BY 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY md5(CAST(scan_id AS VARCHAR)), scan_id) AS rn FROM s)
SELECT scan_id, room_id, CAST((rn - 1) % (SELECT kf FROM k) AS INTEGER) AS fold FROM r
""")
def stratified_folds(spark, sf):
    """Stratified folds, k = min(5, smallest room)."""
    labels = C.scan_labels(spark, sf)
    k = S.fold_count(labels, "room_id")
    return S.stratified_folds(labels, "scan_id", "room_id", k).select("scan_id", "room_id", "fold")


@register("plain_folds", sql="""
SELECT o_orderkey, CAST((row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) % 3 AS INTEGER) AS fold
FROM orders
""")
def plain_folds(spark, sf):
    """Unstratified 3 folds (regressors) over all orders."""
    o = table(spark, sf, "orders").select("o_orderkey")
    return S.plain_folds(o, "o_orderkey", 3)


@register("group_folds", sql="""
WITH g AS (SELECT o_custkey, CAST((row_number() OVER (ORDER BY md5(CAST(o_custkey AS VARCHAR)), o_custkey) - 1) % 5 AS INTEGER) AS fold
           FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o.o_orderkey, o.o_custkey, g.fold FROM orders o JOIN g USING (o_custkey)
""")
def group_folds(spark, sf):
    """Group-by-device folds (customer = device): a device never spans two folds."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return S.group_folds(o, "o_custkey", 5).select("o_orderkey", "o_custkey", "fold")


@register("sample_n", sql="""
SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000
""")
def sample_n(spark, sf):
    """Seeded sample of 1,000 orders (md5 order; the limit is the sampling operator)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return S.seeded_sample(o, "o_orderkey", 1000)


# --- position error ---------------------------------------------------------------

POS_SQL = """
pos AS (
  SELECT c_custkey,
         c_acctbal / 100.0 AS x_true, CAST(c_custkey % 100 AS DOUBLE) AS y_true,
         c_acctbal / 100.0 + CAST(c_custkey % 7 - 3 AS DOUBLE) AS x_pred,
         CAST(c_custkey % 100 AS DOUBLE) + CAST(c_nationkey % 5 - 2 AS DOUBLE) AS y_pred,
         c_nationkey % 3 AS b_true, (c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END) % 3 AS b_pred,
         c_nationkey % 5 AS f_true,
         CASE WHEN c_custkey % 7 = 0 THEN (c_nationkey + 1) % 5 ELSE c_nationkey % 5 END AS f_pred
  FROM customer),
err AS (
  SELECT *, sqrt((x_true - x_pred) * (x_true - x_pred) + (y_true - y_pred) * (y_true - y_pred)) AS err,
         (b_true = b_pred AND f_true = f_pred) AS ok
  FROM pos)
"""


def positions(spark, sf):
    """True and predicted building, floor and (x, y) per customer (fixture rules as in POS_SQL)."""
    c = table(spark, sf, "customer")
    key, nat = F.col("c_custkey"), F.col("c_nationkey")
    return c.select(
        "c_custkey",
        (F.col("c_acctbal") / 100.0).alias("x_true"),
        (key % 100).cast("double").alias("y_true"),
        (F.col("c_acctbal") / 100.0 + (key % 7 - 3).cast("double")).alias("x_pred"),
        ((key % 100).cast("double") + (nat % 5 - 2).cast("double")).alias("y_pred"),
        (nat % 3).alias("b_true"),
        ((nat + F.when(key % 10 == 0, 1).otherwise(0)) % 3).alias("b_pred"),
        (nat % 5).alias("f_true"),
        F.when(key % 7 == 0, (nat + 1) % 5).otherwise(nat % 5).alias("f_pred"),
    )


def position_errors(spark, sf):
    p = positions(spark, sf)
    dx = F.col("x_true") - F.col("x_pred")
    dy = F.col("y_true") - F.col("y_pred")
    return p.withColumn("err", F.sqrt(dx * dx + dy * dy)).withColumn(
        "ok", (F.col("b_true") == F.col("b_pred")) & (F.col("f_true") == F.col("f_pred"))
    )


@register("position_error", sql=f"""
WITH {POS_SQL}
SELECT c_custkey, round(err, 6) AS err, ok FROM err
""")
def position_error(spark, sf):
    """Euclidean error per row and the building+floor correctness flag."""
    e = position_errors(spark, sf)
    return e.select("c_custkey", r6(F.col("err")).alias("err"), "ok")


@register("position_summary", sql=f"""
WITH {POS_SQL}
SELECT round(avg(CASE WHEN ok THEN err END), 6) AS strict_mean,
       round(avg(CASE WHEN ok THEN err ELSE 100.0 END), 6) AS overall_mean,
       round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS correct_pct,
       round(quantile_cont(err, 0.5), 6) AS median_err, round(quantile_cont(err, 0.95), 6) AS p95_err,
       round(max(err), 6) AS max_err
FROM err
""")
def position_summary(spark, sf):
    """A10 + A11: strict / penalised mean error, share correct, median, p95, max."""
    e = position_errors(spark, sf)
    means = e.agg(
        F.avg(F.when(F.col("ok"), F.col("err"))).alias("strict_mean"),
        F.avg(F.when(F.col("ok"), F.col("err")).otherwise(F.lit(100.0))).alias("overall_mean"),
        (F.avg(F.col("ok").cast("double")) * 100.0).alias("correct_pct"),
        F.max("err").alias("max_err"),
    )
    q = exact_quantiles(e, [], "err", [0.5, 0.95])
    out = M._single_row_merge(means, q)
    return out.select(
        r6(F.col("strict_mean")).alias("strict_mean"), r6(F.col("overall_mean")).alias("overall_mean"),
        r6(F.col("correct_pct")).alias("correct_pct"), r6(F.col("q_0")).alias("median_err"),
        r6(F.col("q_1")).alias("p95_err"), r6(F.col("max_err")).alias("max_err"),
    )


@register("mae_rmse", sql=f"""
WITH {POS_SQL}
SELECT round(avg(abs(x_true - x_pred)), 6) AS mae_x, round(avg(abs(y_true - y_pred)), 6) AS mae_y,
       round(avg(err), 6) AS mae_2d, round(sqrt(avg(err * err)), 6) AS rmse_2d FROM err
""")
def mae_rmse(spark, sf):
    """Mean absolute and root-mean-square position error."""
    e = position_errors(spark, sf)
    return e.agg(
        r6(F.avg(F.abs(F.col("x_true") - F.col("x_pred")))).alias("mae_x"),
        r6(F.avg(F.abs(F.col("y_true") - F.col("y_pred")))).alias("mae_y"),
        r6(F.avg("err")).alias("mae_2d"),
        r6(F.sqrt(F.avg(F.col("err") * F.col("err")))).alias("rmse_2d"),
    )


@register("error_by_correctness", sql=f"""
WITH {POS_SQL}
SELECT ok AS correct_both, round(avg(err), 6) AS mean, round(median(err), 6) AS median,
       round(stddev_samp(err), 6) AS std, count(*) AS count FROM err GROUP BY 1
""")
def error_by_correctness(spark, sf):
    """Error statistics split by building+floor correctness (sample std)."""
    e = position_errors(spark, sf).withColumnRenamed("ok", "correct_both")
    mom = e.groupBy("correct_both").agg(F.avg("err").alias("mean"), F.stddev_samp("err").alias("std"), F.count(F.lit(1)).alias("count"))
    med = exact_quantiles(e, ["correct_both"], "err", [0.5]).select("correct_both", F.col("q_0").alias("median"))
    return mom.join(med, "correct_both").select(
        "correct_both", r6(F.col("mean")).alias("mean"), r6(F.col("median")).alias("median"),
        r6(F.col("std")).alias("std"), "count",
    )


@register("error_by_device", sql=f"""
WITH {POS_SQL}
SELECT c.c_nationkey AS device_id, round(avg(e.err), 6) AS mean_err,
       round(avg(CASE WHEN e.ok THEN 1.0 ELSE 0.0 END), 6) AS correct_share, count(*) AS n
FROM err e JOIN customer c USING (c_custkey) GROUP BY 1
""")
def error_by_device(spark, sf):
    """Error breakdown per device (nation key stands for the phone id)."""
    e = position_errors(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return e.groupBy(F.col("c_nationkey").alias("device_id")).agg(
        r6(F.avg("err")).alias("mean_err"), r6(F.avg(F.col("ok").cast("double"))).alias("correct_share"),
        F.count(F.lit(1)).alias("n"),
    )
