"""Model evaluation queries: k-fold CV, k grid, ensembles, model choice, MLlib models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roomcast.functions.exprs import r6
from roomcast.operators import knn
from roomcast.operators import metrics as M
from roomcast.operators import split as S
from roomcast.plans import common as C
from roomcast.plans.q_knn import EMB_SPLIT, cos_sql, emb_split
from roomcast.plans.registry import register
from roomcast.operators.stats import leave_one_out_quantiles
from roomcast.plans.sqlmetrics import acc_sql, macro_sql, per_class_sql
from roomcast.plans.sqlparts import IMU
from roomcast.session import materialize
from roomcast.sources import fingerprints as fp

K_GRID = [3, 5, 7, 9, 11]
MODEL_KS = [3, 5, 7]  # the compared kNN "models", in registry order
ENSEMBLE_WEIGHTS = [0.5, 0.3, 0.2]

# --- CV neighbours (Spark) ----------------------------------------------------------


def cv_neighbours(spark, sf, kmax):
    """Neighbours of every vector among the other folds: one partitioned kNN join.

    Each reference row is replicated to the k-1 folds it serves as training
    data; the fold is the equi key, so the join never compares across keys.
    """
    e = C.embeddings(spark, sf)
    kf = S.fold_count(e, "label")
    f = S.stratified_folds(e, "vec_id", "label", kf)
    queries = f.select(F.col("vec_id").alias("query_id"), F.col("label").alias("true_label"), "fold", "vec")
    refs = f.select(
        F.col("vec_id").alias("ref_id"), "label", "vec",
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(kf - 1)), lambda x: x != F.col("fold"))).alias("fold"),
    )
    nn = knn.knn_join(queries, refs, kmax, "cosine", payload=("label",), key="fold")
    return nn.join(queries.select("query_id", "true_label"), "query_id")


def grid_predictions(nn, ks, weightings, extra_group):
    """Predictions for every (k, weighting) from one neighbour list (rank <= max k)."""
    base = nn.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    base = base.withColumn("weights", F.explode(F.array(*[F.lit(w) for w in weightings])))
    q = [*extra_group, "k", "weights", "query_id", "true_label"]
    w = Window.partitionBy(*q)
    zero = F.max((F.col("dist") == 0).cast("int")).over(w)
    wt = F.when(F.col("weights") == "uniform", F.lit(1.0)).otherwise(
        F.when(zero == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    )
    votes = base.withColumn("_w", wt).groupBy(*q, "label").agg(F.sum("_w").alias("weight"))
    votes = votes.withColumn("probability", F.col("weight") / F.sum("weight").over(Window.partitionBy(*q)))
    best = votes.groupBy(*q).agg(F.max(F.struct(F.col("probability"), (-F.col("label")).alias("neg"))).alias("_b"))
    return best.select(*q, (-F.col("_b.neg")).alias("pred_label"), F.col("_b.probability").alias("confidence"))


# --- CV neighbours (SQL) ------------------------------------------------------------

EMB_FOLDS_SQL = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
kf AS (SELECT least(5, min(c)) AS k FROM (SELECT label, count(*) AS c FROM e GROUP BY 1)),
f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1) % (SELECT k FROM kf) AS fold FROM e)"""

CV_SQL = f"""{EMB_FOLDS_SQL},
d AS (SELECT q.fold, q.vec_id AS query_id, q.label AS true_label, t.vec_id AS ref_id, t.label, {cos_sql('q.v', 't.v')} AS dist
      FROM f q JOIN f t ON q.fold <> t.fold),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rank FROM d QUALIFY rank <= 11)
"""


def grid_sql(ks, weightings, extra_group: list[str]) -> str:
    g = ", ".join(extra_group + ["k", "weights", "query_id", "true_label"])
    klist = "[" + ", ".join(str(k) for k in ks) + "]"
    wlist = "[" + ", ".join(f"'{w}'" for w in weightings) + "]"
    return f"""
gb AS (SELECT nn.*, kk.k, ww.weights FROM nn, (SELECT unnest({klist}) AS k) kk, (SELECT unnest({wlist}) AS weights) ww
       WHERE nn.rank <= kk.k),
gz AS (SELECT *, max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {g}) AS has_zero FROM gb),
gw AS (SELECT {g}, label,
              sum(CASE WHEN weights = 'uniform' THEN 1.0
                       WHEN has_zero = 1 THEN (CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END)
                       ELSE 1.0 / dist END) AS weight
       FROM gz GROUP BY ALL),
gp AS (SELECT *, weight / sum(weight) OVER (PARTITION BY {g}) AS probability FROM gw),
gpred AS (SELECT {g}, label AS pred_label, probability AS confidence FROM
          (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY probability DESC, label) AS pr FROM gp) WHERE pr = 1)
"""


@register("knn_cv", sql=f"""
WITH {CV_SQL}, {grid_sql([7], ['distance'], ['fold'])},
{acc_sql('gpred', 'true_label', 'pred_label', ['fold'])},
{per_class_sql('gpred', 'true_label', 'pred_label', ['fold'])},
{macro_sql('pc', ['fold'])}
SELECT CAST(a.fold AS INTEGER) AS fold, round(a.accuracy, 6) AS accuracy, round(m.precision_macro, 6) AS precision_macro,
       round(m.recall_macro, 6) AS recall_macro, round(m.f1_macro, 6) AS f1_macro
FROM acc a JOIN macro m USING (fold)
""")
def knn_cv(spark, sf):
    """M7 + W3: stratified k-fold CV of the kNN classifier (k=7, 1/d), per-fold metrics."""
    nn = cv_neighbours(spark, sf, 7)
    pred = grid_predictions(nn, [7], ["distance"], ["fold"])
    rep = M.classification_report(pred, "true_label", "pred_label", ["fold"])
    return rep.select("fold", *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro")])


# --- CV with everything fitted per fold (M7) ---------------------------------------------

SCALED_CV_SQL = f"""
{EMB_FOLDS_SQL},
el AS (SELECT vec_id, label, fold, unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS value FROM f),
folds AS (SELECT DISTINCT fold FROM f),
fit AS (SELECT k.fold, e.pos, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75
        FROM folds k JOIN el e ON e.fold <> k.fold GROUP BY 1, 2),
par AS (SELECT fold, pos, median, coalesce(nullif(q75 - q25, 0.0), 1.0) AS scale FROM fit)
"""


def emb_folds(spark, sf):
    """Embeddings with stratified folds (W3), written once, and the number of folds."""
    e = C.embeddings(spark, sf)
    kf = S.fold_count(e, "label")
    return materialize(S.stratified_folds(e, "vec_id", "label", kf).select("vec_id", "label", "fold", "vec")), kf


def fold_params(folds, kf):
    """Median and robust scale of every component over the rows outside each fold: ``(pos, fold, median, scale)``."""
    cells = folds.select("fold", F.posexplode("vec").alias("pos", "value"))
    q = leave_one_out_quantiles(cells, ["pos"], "value", "fold", kf, [0.25, 0.5, 0.75])
    iqr = F.nullif(F.col("q_2") - F.col("q_0"), F.lit(0.0))
    return q.select((F.col("pos") + 1).alias("pos"), "fold", F.col("q_1").alias("median"), F.coalesce(iqr, F.lit(1.0)).alias("scale"))


@register("fold_scaler", sql=f"""
WITH {SCALED_CV_SQL}
SELECT CAST(pos AS INTEGER) AS pos, CAST(fold AS INTEGER) AS fold, round(median, 6) AS median, round(scale, 6) AS scale FROM par
""")
def fold_scaler(spark, sf):
    """M7: the robust scaler of each cross-validation fold, fitted on the other folds from one pass over the values."""
    p = fold_params(*emb_folds(spark, sf))
    return p.select("pos", "fold", r6(F.col("median")).alias("median"), r6(F.col("scale")).alias("scale"))


#: Readings that one task joins with their folds.
READINGS_PER_TASK = 500_000


@register("fold_imu_medians", sql=f"""
WITH {IMU},
scans AS (SELECT DISTINCT scan_id FROM imu),
sf AS (SELECT scan_id, (row_number() OVER (PARTITION BY room_id ORDER BY md5(CAST(scan_id AS VARCHAR)), scan_id) - 1) % 5 AS fold
       FROM (SELECT o_orderkey AS scan_id, o_orderpriority AS room_id FROM orders) JOIN scans USING (scan_id)),
folds AS (SELECT DISTINCT fold FROM sf)
SELECT i.imu_name, CAST(k.fold AS INTEGER) AS fold, count(i.value) AS n, round(median(i.value), 6) AS median
FROM folds k JOIN sf s ON s.fold <> k.fold JOIN imu i ON i.scan_id = s.scan_id
WHERE i.imu_name IS NOT NULL AND i.value IS NOT NULL GROUP BY 1, 2
""")
def fold_imu_medians(spark, sf):
    """M7 + P6: the IMU medians that each of five stratified folds of scans imputes with, from the other folds."""
    folds = S.stratified_folds(C.scan_labels(spark, sf), "scan_id", "room_id", 5).select("scan_id", "fold")
    readings = fp.imu_readings(C.lineitem(spark, sf)).where(F.col("imu_name").isNotNull())
    # as many tasks as the readings need: one sorts and counts so many of them, whatever their number
    n = max(spark.sparkContext.defaultParallelism, -(-readings.count() // READINGS_PER_TASK))
    readings = readings.repartition(n, "scan_id").join(folds.repartition(n, "scan_id"), "scan_id")
    q = leave_one_out_quantiles(readings, ["imu_name"], "value", "fold", 5, [0.5])
    return q.select("imu_name", "fold", "n", r6(F.col("q_0")).alias("median"))


def scaled_cv_neighbours(spark, sf, k):
    """Neighbours of every vector among the other folds, both scaled with what the other folds fit."""
    folds, kf = emb_folds(spark, sf)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "median", "scale")))
    params = fold_params(folds, kf).groupBy("fold").agg(ordered.alias("p"))
    params = params.select("fold", F.col("p.median").alias("centre"), F.col("p.scale").alias("scale"))
    nn = knn.knn_join_by_fold(folds, params, k, "vec_id", payload=("label",))
    return nn.join(folds.select(F.col("vec_id").alias("query_id"), F.col("label").alias("true_label")), "query_id")


@register("knn_cv_scaled", sql=f"""
WITH {SCALED_CV_SQL},
z AS (SELECT e.vec_id, e.label, e.fold AS own, p.fold, list((e.value - p.median) / p.scale ORDER BY e.pos) AS v
      FROM el e JOIN par p USING (pos) GROUP BY 1, 2, 3, 4),
d AS (SELECT q.fold, q.vec_id AS query_id, q.label AS true_label, t.vec_id AS ref_id, t.label, {cos_sql('q.v', 't.v')} AS dist
      FROM z q JOIN z t ON q.own = q.fold AND t.fold = q.fold AND t.own <> q.fold),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rank FROM d QUALIFY rank <= 7),
{grid_sql([7], ['distance'], ['fold'])},
{acc_sql('gpred', 'true_label', 'pred_label', ['fold'])},
{per_class_sql('gpred', 'true_label', 'pred_label', ['fold'])},
{macro_sql('pc', ['fold'])}
SELECT CAST(a.fold AS INTEGER) AS fold, round(a.accuracy, 6) AS accuracy, round(m.precision_macro, 6) AS precision_macro,
       round(m.recall_macro, 6) AS recall_macro, round(m.f1_macro, 6) AS f1_macro
FROM acc a JOIN macro m USING (fold)
""")
def knn_cv_scaled(spark, sf):
    """M7: stratified CV of the whole kNN pipeline: scaler fitted per fold on the other folds, then k=7, 1/d votes."""
    pred = grid_predictions(scaled_cv_neighbours(spark, sf, 7), [7], ["distance"], ["fold"])
    rep = M.classification_report(pred, "true_label", "pred_label", ["fold"])
    return rep.select("fold", *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro")])


@register("fold_mean_std", sql=f"""
WITH {CV_SQL}, {grid_sql([7], ['distance'], ['fold'])},
{acc_sql('gpred', 'true_label', 'pred_label', ['fold'])},
{per_class_sql('gpred', 'true_label', 'pred_label', ['fold'])},
{macro_sql('pc', ['fold'])}
SELECT round(avg(a.accuracy), 6) AS accuracy_mean, round(stddev_pop(a.accuracy), 6) AS accuracy_std,
       round(avg(m.f1_macro), 6) AS f1_macro_mean, round(stddev_pop(m.f1_macro), 6) AS f1_macro_std
FROM acc a JOIN macro m USING (fold)
""")
def fold_mean_std(spark, sf):
    """Mean and population std of the per-fold metrics."""
    nn = cv_neighbours(spark, sf, 7)
    pred = grid_predictions(nn, [7], ["distance"], ["fold"])
    rep = M.classification_report(pred, "true_label", "pred_label", ["fold"])
    return rep.agg(
        r6(F.avg("accuracy")).alias("accuracy_mean"), r6(F.stddev_pop("accuracy")).alias("accuracy_std"),
        r6(F.avg("f1_macro")).alias("f1_macro_mean"), r6(F.stddev_pop("f1_macro")).alias("f1_macro_std"),
    )


@register("knn_grid", sql=f"""
WITH {CV_SQL}, {grid_sql(K_GRID, ['uniform', 'distance'], ['fold'])},
{acc_sql('gpred', 'true_label', 'pred_label', ['k', 'weights', 'fold'])},
{per_class_sql('gpred', 'true_label', 'pred_label', ['k', 'weights', 'fold'])},
{macro_sql('pc', ['k', 'weights', 'fold'])}
SELECT CAST(a.k AS INTEGER) AS k, a.weights, round(avg(a.accuracy), 6) AS accuracy_mean, round(avg(m.f1_macro), 6) AS f1_macro_mean
FROM acc a JOIN macro m USING (k, weights, fold) GROUP BY 1, 2
""")
def knn_grid(spark, sf):
    """M8: k in {3..11} x {uniform, distance}, CV-scored from ONE top-11 neighbour pass."""
    nn = cv_neighbours(spark, sf, max(K_GRID))
    pred = grid_predictions(nn, K_GRID, ["uniform", "distance"], ["fold"])
    rep = M.classification_report(pred, "true_label", "pred_label", ["k", "weights", "fold"])
    return rep.groupBy(F.col("k").cast("int").alias("k"), "weights").agg(
        r6(F.avg("accuracy")).alias("accuracy_mean"), r6(F.avg("f1_macro")).alias("f1_macro_mean")
    )


# --- holdout model comparison ---------------------------------------------------------

HOLDOUT_NN_SQL = f"""
{EMB_SPLIT},
d AS (SELECT q.query_id, q.true_label, t.ref_id, t.label, {cos_sql('q.v', 't.v')} AS dist FROM q CROSS JOIN t),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rank FROM d QUALIFY rank <= 7)
"""

MODELS_SQL = "models AS (SELECT * FROM (VALUES " + ", ".join(
    f"('knn{k}', {k}, {i})" for i, k in enumerate(MODEL_KS)
) + ") AS m(model, k, ord))"


def holdout_neighbours(spark, sf):
    queries, refs = emb_split(spark, sf)
    nn = knn.knn_join(queries, refs, max(MODEL_KS), "cosine", payload=("label",))
    return nn.join(queries.select("query_id", "true_label"), "query_id")


def _models_frame(spark):
    return spark.createDataFrame([(f"knn{k}", k, i) for i, k in enumerate(MODEL_KS)], "model string, k int, ord int")


def holdout_model_metrics(spark, sf):
    pred = grid_predictions(holdout_neighbours(spark, sf), MODEL_KS, ["distance"], [])
    rep = M.classification_report(pred, "true_label", "pred_label", ["k"])
    return rep.join(F.broadcast(_models_frame(spark)), "k")


@register("model_compare", sql=f"""
WITH {HOLDOUT_NN_SQL}, {grid_sql(MODEL_KS, ['distance'], [])},
{acc_sql('gpred', 'true_label', 'pred_label', ['k'])},
{per_class_sql('gpred', 'true_label', 'pred_label', ['k'])},
{macro_sql('pc', ['k'])}, {MODELS_SQL}
SELECT mo.model, round(a.accuracy, 6) AS accuracy, round(m.precision_macro, 6) AS precision_macro,
       round(m.recall_macro, 6) AS recall_macro, round(m.f1_macro, 6) AS f1_macro
FROM acc a JOIN macro m USING (k) JOIN models mo USING (k)
""")
def model_compare(spark, sf):
    """The registered models scored on the same holdout."""
    m = holdout_model_metrics(spark, sf)
    return m.select("model", *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro")])


@register("best_model", sql=f"""
WITH {HOLDOUT_NN_SQL}, {grid_sql(MODEL_KS, ['distance'], [])},
{per_class_sql('gpred', 'true_label', 'pred_label', ['k'])},
{macro_sql('pc', ['k'])}, {MODELS_SQL}
SELECT arg_max(mo.model, (m.f1_macro, -mo.ord)) AS best_model, round(max(m.f1_macro), 6) AS f1_macro
FROM macro m JOIN models mo USING (k)
""")
def best_model(spark, sf):
    """T4: arg max macro F1, the first registered model wins ties."""
    m = holdout_model_metrics(spark, sf)
    key = F.struct(F.col("f1_macro"), (-F.col("ord")).alias("neg_ord"))
    return m.agg(F.max_by("model", key).alias("best_model"), r6(F.max("f1_macro")).alias("f1_macro"))


def _model_probs(spark, sf):
    """Class probabilities of every holdout query under each compared model."""
    nn = holdout_neighbours(spark, sf)
    base = nn.withColumn("k", F.explode(F.array(*[F.lit(k) for k in MODEL_KS]))).where(F.col("rank") <= F.col("k"))
    votes = knn.distance_vote(base, ["k", "query_id", "true_label"], "label")
    return votes.join(F.broadcast(_models_frame(spark)), "k")


def _soft_vote(spark, sf, weights):
    probs = _model_probs(spark, sf)
    wt = F.array(*[F.lit(float(w)) for w in weights])
    scored = probs.withColumn("_w", F.element_at(wt, F.col("ord") + 1))
    per_label = scored.groupBy("query_id", "true_label", "label").agg(
        (F.sum(F.col("_w") * F.col("probability")) / F.lit(float(sum(weights)))).alias("probability")
    )
    key = F.struct(F.col("probability"), (-F.col("label")).alias("neg"))
    return per_label.groupBy("query_id", "true_label").agg(F.max_by("label", key).alias("label"), F.max("probability").alias("probability"))


def soft_vote_sql(weights) -> str:
    wl = "[" + ", ".join(str(float(w)) for w in weights) + "]"
    return f"""
mb AS (SELECT nn.*, mo.model, mo.ord, mo.k FROM nn JOIN models mo ON nn.rank <= mo.k),
mz AS (SELECT *, max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k, query_id) AS has_zero FROM mb),
mw AS (SELECT k, ord, query_id, true_label, label,
              sum(CASE WHEN has_zero = 1 THEN (CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 / dist END) AS weight
       FROM mz GROUP BY ALL),
mp AS (SELECT *, weight / sum(weight) OVER (PARTITION BY k, query_id) AS probability FROM mw),
sv AS (SELECT query_id, true_label, label, sum(({wl})[ord + 1] * probability) / {float(sum(weights))} AS probability
       FROM mp GROUP BY 1, 2, 3),
svp AS (SELECT query_id, true_label, arg_max(label, (probability, -label)) AS label, max(probability) AS probability
        FROM sv GROUP BY 1, 2)
"""


@register("soft_vote", sql=f"""
WITH {HOLDOUT_NN_SQL}, {MODELS_SQL}, {soft_vote_sql([1, 1, 1])}
SELECT query_id, label, round(probability, 6) AS probability FROM svp
""")
def soft_vote(spark, sf):
    """Equal-weight average of the models' class probabilities, arg max (ties: smaller label)."""
    v = _soft_vote(spark, sf, [1, 1, 1])
    return v.select("query_id", "label", r6(F.col("probability")).alias("probability"))


@register("weighted_vote", sql=f"""
WITH {HOLDOUT_NN_SQL}, {MODELS_SQL}, {soft_vote_sql(ENSEMBLE_WEIGHTS)}
SELECT query_id, label, round(probability, 6) AS probability FROM svp
""")
def weighted_vote(spark, sf):
    """Weighted soft vote with weights 0.5 / 0.3 / 0.2."""
    v = _soft_vote(spark, sf, ENSEMBLE_WEIGHTS)
    return v.select("query_id", "label", r6(F.col("probability")).alias("probability"))


@register("recommend", sql=f"""
WITH {HOLDOUT_NN_SQL}, {MODELS_SQL}, {soft_vote_sql([1, 1, 1])},
{grid_sql(MODEL_KS, ['distance'], [])},
{acc_sql('gpred', 'true_label', 'pred_label', ['k'])},
best AS (SELECT arg_max(mo.model, (a.accuracy, -mo.ord)) AS best_model, max(a.accuracy) AS best_accuracy
         FROM acc a JOIN models mo USING (k)),
ens AS (SELECT avg(CASE WHEN label = true_label THEN 1.0 ELSE 0.0 END) AS ensemble_accuracy FROM svp)
SELECT best_model, round(best_accuracy, 6) AS best_accuracy, round(ensemble_accuracy, 6) AS ensemble_accuracy,
       CASE WHEN ensemble_accuracy > best_accuracy THEN 'ensemble' ELSE best_model END AS recommendation
FROM best, ens
""")
def recommend(spark, sf):
    """Use the ensemble only when strictly better than the best single model."""
    m = holdout_model_metrics(spark, sf)
    key = F.struct(F.col("accuracy"), (-F.col("ord")).alias("neg_ord"))
    best = m.agg(F.max_by("model", key).alias("best_model"), F.max("accuracy").alias("best_accuracy"))
    ens = _soft_vote(spark, sf, [1, 1, 1]).agg(
        F.avg((F.col("label") == F.col("true_label")).cast("double")).alias("ensemble_accuracy")
    )
    out = M._single_row_merge(best, ens)
    return out.select(
        "best_model", r6(F.col("best_accuracy")).alias("best_accuracy"), r6(F.col("ensemble_accuracy")).alias("ensemble_accuracy"),
        F.when(F.col("ensemble_accuracy") > F.col("best_accuracy"), F.lit("ensemble")).otherwise(F.col("best_model")).alias("recommendation"),
    )


@register("avg_regress", sql=f"""
WITH {EMB_SPLIT}, {MODELS_SQL},
t2 AS (SELECT t.*, CAST(t.label AS DOUBLE) * 10.0 + CAST(t.ref_id % 7 AS DOUBLE) AS x, CAST(t.ref_id % 13 AS DOUBLE) AS y FROM t),
d AS (SELECT q.query_id, t2.ref_id, t2.x, t2.y,
             round(sqrt(list_sum(list_transform(list_zip(q.v, t2.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 10) AS dist
      FROM q CROSS JOIN t2),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rank FROM d QUALIFY rank <= 7),
mb AS (SELECT nn.*, mo.ord, mo.k FROM nn JOIN models mo ON nn.rank <= mo.k),
mz AS (SELECT *, max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k, query_id) AS has_zero FROM mb),
mw AS (SELECT *, CASE WHEN has_zero = 1 THEN (CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 / dist END AS wt FROM mz),
reg AS (SELECT query_id, ord, sum(wt * x) / sum(wt) AS x, sum(wt * y) / sum(wt) AS y FROM mw GROUP BY 1, 2)
SELECT query_id, round(avg(x), 6) AS x_equal, round(avg(y), 6) AS y_equal,
       round(sum(([{', '.join(str(w) for w in ENSEMBLE_WEIGHTS)}])[ord + 1] * x) / {float(sum(ENSEMBLE_WEIGHTS))}, 6) AS x_weighted,
       round(sum(([{', '.join(str(w) for w in ENSEMBLE_WEIGHTS)}])[ord + 1] * y) / {float(sum(ENSEMBLE_WEIGHTS))}, 6) AS y_weighted
FROM reg GROUP BY 1
""")
def avg_regress(spark, sf):
    """Equal and weighted averages of the position regressors (Euclidean kNN, k = 3/5/7)."""
    queries, refs = emb_split(spark, sf)
    refs = refs.withColumn("x", F.col("label").cast("double") * 10.0 + (F.col("ref_id") % 7)).withColumn(
        "y", (F.col("ref_id") % 13).cast("double")
    )
    nn = knn.knn_join(queries, refs, max(MODEL_KS), "euclidean", payload=("x", "y"))
    base = nn.withColumn("k", F.explode(F.array(*[F.lit(k) for k in MODEL_KS]))).where(F.col("rank") <= F.col("k"))
    reg = knn.weighted_mean_regress(base, ["k", "query_id"], ["x", "y"]).join(F.broadcast(_models_frame(spark)), "k")
    wt = F.element_at(F.array(*[F.lit(float(w)) for w in ENSEMBLE_WEIGHTS]), F.col("ord") + 1)
    tot = float(sum(ENSEMBLE_WEIGHTS))
    return reg.groupBy("query_id").agg(
        r6(F.avg("x")).alias("x_equal"), r6(F.avg("y")).alias("y_equal"),
        r6(F.sum(wt * F.col("x")) / tot).alias("x_weighted"), r6(F.sum(wt * F.col("y")) / tot).alias("y_weighted"),
    )


@register("report_rows", sql=f"""
WITH {CV_SQL}, {grid_sql(MODEL_KS, ['distance'], ['fold'])},
{acc_sql('gpred', 'true_label', 'pred_label', ['k', 'fold'])},
{per_class_sql('gpred', 'true_label', 'pred_label', ['k', 'fold'])},
{macro_sql('pc', ['k', 'fold'])}, {MODELS_SQL},
agg AS (SELECT a.k, avg(a.accuracy) AS am, stddev_pop(a.accuracy) AS asd, avg(m.f1_macro) AS fm, stddev_pop(m.f1_macro) AS fsd
        FROM acc a JOIN macro m USING (k, fold) GROUP BY 1)
SELECT upper(mo.model) AS model, printf('%.4f +/- %.4f', am, asd) AS accuracy_cell, printf('%.4f +/- %.4f', fm, fsd) AS f1_cell
FROM agg JOIN models mo USING (k)
""")
def report_rows(spark, sf):
    """Report table rows, ``mean +/- std`` to 4 places per model."""
    nn = cv_neighbours(spark, sf, max(MODEL_KS))
    pred = grid_predictions(nn, MODEL_KS, ["distance"], ["fold"])
    rep = M.classification_report(pred, "true_label", "pred_label", ["k", "fold"])
    agg = rep.groupBy("k").agg(
        F.avg("accuracy").alias("am"), F.stddev_pop("accuracy").alias("asd"),
        F.avg("f1_macro").alias("fm"), F.stddev_pop("f1_macro").alias("fsd"),
    ).join(F.broadcast(_models_frame(spark)), "k")
    return agg.select(
        F.upper("model").alias("model"),
        F.format_string("%.4f +/- %.4f", "am", "asd").alias("accuracy_cell"),
        F.format_string("%.4f +/- %.4f", "fm", "fsd").alias("f1_cell"),
    )


# --- MLlib models (rows-only checks: no SQL equivalent) --------------------------------


def _ml_frame(spark, sf):
    from pyspark.ml.functions import array_to_vector

    e = C.embeddings(spark, sf)
    s = S.stratified_holdout(e, "vec_id", "label", 0.2)
    return s.select("vec_id", "label", "is_test", array_to_vector("vec").alias("features"))


@register("mlp_holdout")
def mlp_holdout(spark, sf):
    """M3: multilayer perceptron (hidden 64, 32; seed 42; max 400 iterations) on the holdout split.

    Spark's MLP uses sigmoid hidden units with L-BFGS (the reference's library
    default is ReLU with Adam), so only the shape of the output is compared.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    df = materialize(_ml_frame(spark, sf))
    n_classes = int(df.agg(F.max("label")).first()[0]) + 1
    dim = len(df.select("features").first()[0])
    mlp = MultilayerPerceptronClassifier(layers=[dim, 64, 32, n_classes], maxIter=400, seed=42, labelCol="label")
    model = mlp.fit(df.where(~F.col("is_test")).withColumn("label", F.col("label").cast("double")))
    pred = model.transform(df.where("is_test"))
    return pred.select(F.col("vec_id").alias("query_id"), F.col("label").alias("true_label"),
                       F.col("prediction").cast("int").alias("pred_label"))


@register("gbt_regress")
def gbt_regress(spark, sf):
    """Boosted-tree regressors for x and y (one per coordinate), holdout predictions."""
    from pyspark.ml.regression import GBTRegressor

    df = _ml_frame(spark, sf).withColumn("x", F.col("label").cast("double") * 10.0 + (F.col("vec_id") % 7)).withColumn(
        "y", (F.col("vec_id") % 13).cast("double"))
    train, test = df.where(~F.col("is_test")), df.where("is_test")
    out = test.select("vec_id", "x", "y")
    for target in ("x", "y"):
        m = GBTRegressor(labelCol=target, maxIter=50, maxDepth=4, stepSize=0.1, seed=42).fit(train)
        out = out.join(m.transform(test).select("vec_id", F.col("prediction").alias(f"{target}_pred")), "vec_id")
    dx, dy = F.col("x") - F.col("x_pred"), F.col("y") - F.col("y_pred")
    return out.select(F.col("vec_id").alias("query_id"), "x_pred", "y_pred", F.sqrt(dx * dx + dy * dy).alias("err"))


@register("kmeans_patterns")
def kmeans_patterns(spark, sf):
    """Signal-pattern clusters (k-means, k=8, seed 42) of the robust-scaled fingerprints."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from roomcast.operators import features as feat

    features, scans = materialize(C.feature_table(spark, sf)), materialize(C.scans(spark, sf))
    params = materialize(feat.robust_fit(features, scans.count()))
    vecs = materialize(feat.scaled_vectors(scans, features, params))
    df = vecs.select("scan_id", array_to_vector("vec").alias("features"))
    model = KMeans(k=8, seed=42, maxIter=20).fit(df)
    return model.transform(df).select("scan_id", F.col("prediction").alias("cluster"))


# --- grids (M9, M10, M11, X3): rows only, quality is bounded in tests -------------------------

#: The grids' axes; trees are fewer in the registered query than the 50 and 100 of the grid itself.
TREE_DEPTHS, TREE_RATES, MLP_HIDDEN = [3, 4, 5], [0.1, 0.2], [(50,), (100,), (50, 50)]


def _grid_frame(spark, sf, n_folds=3):
    df = S.stratified_folds(_ml_frame(spark, sf), "vec_id", "label", n_folds)
    return df.withColumn("x", F.col("label") * 10.0 + (F.col("vec_id") % 7)).withColumn("y", (F.col("vec_id") % 13).cast("double"))


def _grid_rows(spark, kind, rows):
    named = [(kind, ", ".join(f"{k}={v}" for k, v in r.items() if k not in ("score_mean", "score_std", "best")), r["score_mean"], r["score_std"], r["best"]) for r in rows]
    return spark.createDataFrame(named, "model string, setting string, score_mean double, score_std double, best boolean")


@register("tree_grid")
def tree_grid(spark, sf, trees=(10,)):
    """M9 + X3: boosted trees for (x, y) over depth and rate, scored by the negative mean position error in 3 stratified folds."""
    from roomcast.operators import tuning

    estimator, maps, settings = tuning.tree_grid(list(trees), TREE_DEPTHS, TREE_RATES)
    df = materialize(_grid_frame(spark, sf))
    return _grid_rows(spark, "gbt", tuning.cross_validated(df, estimator, maps, settings, tuning.NegativePositionError(), 3))


@register("mlp_grid")
def mlp_grid(spark, sf, iterations=60):
    """Hidden layers of the perceptron, scored by accuracy in 3 stratified folds."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    from roomcast.operators import tuning

    df = materialize(_grid_frame(spark, sf).withColumn("label", F.col("label").cast("double")))
    n_classes, dim = int(df.agg(F.max("label")).first()[0]) + 1, len(df.select("features").first()[0])
    estimator, maps, settings = tuning.mlp_grid(MLP_HIDDEN, dim, n_classes, iterations)
    # all settings at once: the many short jobs of one fit do not occupy the cluster
    scored = tuning.cross_validated(df, estimator, maps, settings, MulticlassClassificationEvaluator(metricName="accuracy"), 3, parallelism=len(maps))
    return _grid_rows(spark, "mlp", scored)


@register("tree_classifiers")
def tree_classifiers(spark, sf, trees=20, depth=8):
    """Building (here: parity of the class) and floor (here: class) classifiers: random forests, holdout predictions."""
    from pyspark.ml.classification import RandomForestClassifier

    df = materialize(_ml_frame(spark, sf).withColumn("building", (F.col("label") % 2).cast("double")).withColumn("floor", F.col("label").cast("double")))
    train, test = df.where(~F.col("is_test")), df.where("is_test")
    parts = []
    for target in ("building", "floor"):
        model = RandomForestClassifier(labelCol=target, numTrees=trees, maxDepth=depth, seed=42).fit(train)
        pred = model.transform(test)
        parts.append(pred.select(F.lit(target).alias("target"), F.col("vec_id").alias("query_id"), F.col(target).cast("int").alias("true_label"), F.col("prediction").cast("int").alias("pred_label")))
    return parts[0].unionByName(parts[1])
