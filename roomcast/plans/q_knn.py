"""kNN classification / regression queries on ``embeddings`` (the vector fixture)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomcast.functions.exprs import r6
from roomcast.operators import knn
from roomcast.operators.split import stratified_holdout
from roomcast.plans import common as C
from roomcast.plans.registry import register

# --- shared SQL ---------------------------------------------------------------

EMB_SPLIT = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS rn,
              count(*) OVER (PARTITION BY label) AS n FROM e),
q AS (SELECT vec_id AS query_id, label AS true_label, v FROM rk WHERE rn <= round(n * 0.2)),
t AS (SELECT vec_id AS ref_id, label, v FROM rk WHERE rn > round(n * 0.2))
"""


def cos_sql(a: str, b: str) -> str:
    return (
        f"round(greatest(0.0, least(2.0, 1.0 - list_dot_product({a}, {b}) / "
        f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))), 10)"
    )


def nn_sql(k: int) -> str:
    return f"""
d AS (SELECT q.query_id, q.true_label, t.ref_id, t.label, {cos_sql('q.v', 't.v')} AS dist FROM q CROSS JOIN t),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rank FROM d QUALIFY rank <= {k})
"""


VOTE_SQL = """
z AS (SELECT *, max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS has_zero FROM nn),
w AS (SELECT query_id, true_label, label,
             sum(CASE WHEN has_zero = 1 THEN (CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 / dist END) AS weight
      FROM z GROUP BY 1, 2, 3),
p AS (SELECT query_id, true_label, label, weight / sum(weight) OVER (PARTITION BY query_id) AS probability FROM w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY probability DESC, label) AS prank FROM p)
"""

# --- shared Spark -------------------------------------------------------------


def emb_split(spark, sf):
    e = C.embeddings(spark, sf)
    s = stratified_holdout(e, "vec_id", "label", 0.2)
    queries = s.where("is_test").select(F.col("vec_id").alias("query_id"), F.col("label").alias("true_label"), "vec")
    refs = s.where(~F.col("is_test")).select(F.col("vec_id").alias("ref_id"), "label", "vec")
    return queries, refs


def emb_neighbours(spark, sf, k):
    queries, refs = emb_split(spark, sf)
    nn = knn.knn_join(queries, refs, k, "cosine", payload=("label",))
    return nn.join(queries.select("query_id", "true_label"), "query_id")


def emb_votes(spark, sf, k=7):
    nn = emb_neighbours(spark, sf, k)
    return knn.distance_vote(nn, ["query_id", "true_label"], "label")


def emb_predictions(spark, sf, k=7, top_k=3):
    votes = emb_votes(spark, sf, k)
    ranked = knn.vote_topk(votes, ["query_id", "true_label"], top_k)
    return ranked.groupBy("query_id", "true_label").agg(
        F.min_by("label", "rank").alias("pred_label"),
        F.max("probability").alias("confidence"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "label", "probability"))),
            lambda s: F.struct(s["label"].alias("label"), s["probability"].alias("probability")),
        ).alias("candidates"),
    )


# --- queries ------------------------------------------------------------------


@register("knn_cosine", sql=f"""
WITH {EMB_SPLIT}, {nn_sql(7)}
SELECT query_id, ref_id, label, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM nn
""")
def knn_cosine(spark, sf):
    """J1 + W1: the 7 nearest training vectors of each holdout vector."""
    nn = emb_neighbours(spark, sf, 7)
    return nn.select("query_id", "ref_id", "label", r6(F.col("dist")).alias("dist"), "rank")


@register("knn_vote", sql=f"""
WITH {EMB_SPLIT}, {nn_sql(7)}, {VOTE_SQL}
SELECT query_id, label, round(probability, 6) AS probability FROM p
""")
def knn_vote(spark, sf):
    """1/d-weighted class probabilities per query."""
    v = emb_votes(spark, sf, 7)
    return v.select("query_id", "label", r6(F.col("probability")).alias("probability"))


@register("knn_topk_candidates", sql=f"""
WITH {EMB_SPLIT}, {nn_sql(7)}, {VOTE_SQL}
SELECT query_id, CAST(prank AS INTEGER) AS rank, label, round(probability, 6) AS probability FROM ranked WHERE prank <= 3
""")
def knn_topk_candidates(spark, sf):
    """Top-3 room candidates, probability desc, ties to the smaller label."""
    v = knn.vote_topk(emb_votes(spark, sf, 7), ["query_id"], 3)
    return v.select("query_id", "rank", "label", r6(F.col("probability")).alias("probability"))


@register("knn_predict", sql=f"""
WITH {EMB_SPLIT}, {nn_sql(7)}, {VOTE_SQL}
SELECT query_id, true_label, label AS pred_label, round(probability, 6) AS confidence FROM ranked WHERE prank = 1
""")
def knn_predict(spark, sf):
    """M1/M6: predicted class and its confidence per holdout vector."""
    p = emb_predictions(spark, sf, 7, 3)
    return p.select("query_id", "true_label", "pred_label", r6(F.col("confidence")).alias("confidence"))


@register("vote_entropy", sql=f"""
WITH {EMB_SPLIT}, {nn_sql(7)}, {VOTE_SQL}
SELECT query_id, round(-sum(probability * ln(probability)), 6) AS entropy, CAST(count(*) AS BIGINT) AS n_classes
FROM p GROUP BY 1
""")
def vote_entropy(spark, sf):
    """Entropy of the vote distribution (high = uncertain, rescan or grow k)."""
    v = emb_votes(spark, sf, 7)
    return v.groupBy("query_id").agg(
        r6(-F.sum(F.col("probability") * F.log(F.col("probability")))).alias("entropy"),
        F.count(F.lit(1)).alias("n_classes"),
    )


@register("pseudo_labels", sql=f"""
WITH {EMB_SPLIT}, {nn_sql(7)}, {VOTE_SQL},
conf AS (SELECT query_id, label FROM ranked WHERE prank = 1 AND probability >= 0.5)
SELECT ref_id AS vec_id, label, 'train' AS origin FROM t
UNION ALL
SELECT query_id, label, 'pseudo' FROM conf
""")
def pseudo_labels(spark, sf):
    """Confident holdout predictions (p >= 0.5) join the reference set."""
    _, refs = emb_split(spark, sf)
    p = emb_predictions(spark, sf, 7, 1).where(F.col("confidence") >= 0.5)
    return refs.select(F.col("ref_id").alias("vec_id"), "label", F.lit("train").alias("origin")).unionByName(
        p.select(F.col("query_id").alias("vec_id"), F.col("pred_label").alias("label"), F.lit("pseudo").alias("origin"))
    )


@register("knn_regress", sql=f"""
WITH {EMB_SPLIT},
t2 AS (SELECT t.*, CAST(t.label AS DOUBLE) * 10.0 + CAST(t.ref_id % 7 AS DOUBLE) AS x, CAST(t.ref_id % 13 AS DOUBLE) AS y FROM t),
d AS (SELECT q.query_id, t2.ref_id, t2.x, t2.y,
             round(sqrt(list_sum(list_transform(list_zip(q.v, t2.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 10) AS dist
      FROM q CROSS JOIN t2),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rank FROM d QUALIFY rank <= 5),
z AS (SELECT *, max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS has_zero FROM nn),
w AS (SELECT *, CASE WHEN has_zero = 1 THEN (CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 / dist END AS wt FROM z)
SELECT query_id, round(sum(wt * x) / sum(wt), 6) AS x, round(sum(wt * y) / sum(wt), 6) AS y FROM w GROUP BY 1
""")
def knn_regress(spark, sf):
    """J2 + M12: Euclidean k=5, 1/d-weighted mean of the (x, y) position targets.

    Targets derive from the reference rows: x = label*10 + id%7, y = id%13.
    """
    queries, refs = emb_split(spark, sf)
    refs = refs.withColumn("x", F.col("label").cast("double") * 10.0 + (F.col("ref_id") % 7)).withColumn(
        "y", (F.col("ref_id") % 13).cast("double")
    )
    nn = knn.knn_join(queries, refs, 5, "euclidean", payload=("x", "y"))
    reg = knn.weighted_mean_regress(nn, ["query_id"], ["x", "y"])
    return reg.select("query_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@register("knn_by_partition", sql=f"""
WITH {EMB_SPLIT},
qg AS (SELECT *, true_label % 2 AS grp FROM q),
tg AS (SELECT *, label % 2 AS grp FROM t),
d AS (SELECT qg.query_id, tg.ref_id, tg.label, qg.grp, {cos_sql('qg.v', 'tg.v')} AS dist FROM qg JOIN tg ON qg.grp = tg.grp),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rank FROM d QUALIFY rank <= 7)
SELECT query_id, grp, ref_id, label, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM nn
""")
def knn_by_partition(spark, sf):
    """J1 within an equi key: neighbours restricted to the query's own group.

    The group is the parity of the class (a two-'building' hierarchy); the
    equi key keeps the join partitioned instead of comparing across groups.
    """
    queries, refs = emb_split(spark, sf)
    qg = queries.withColumn("grp", F.col("true_label") % 2)
    rg = refs.withColumn("grp", F.col("label") % 2)
    nn = knn.knn_join(qg, rg, 7, "cosine", payload=("label",), key="grp")
    return nn.select("query_id", "grp", "ref_id", "label", r6(F.col("dist")).alias("dist"), "rank")


@register("knn_hierarchical", sql=f"""
WITH {EMB_SPLIT}, {nn_sql(5)},
nz AS (SELECT *, max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS has_zero FROM nn),
gw AS (SELECT query_id, true_label, label % 2 AS grp,
              sum(CASE WHEN has_zero = 1 THEN (CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 / dist END) AS w FROM nz GROUP BY ALL),
qg AS (SELECT query_id, true_label, arg_min(grp, (-floor(w / t * 1e6 + 0.5), grp)) AS grp
       FROM (SELECT *, sum(w) OVER (PARTITION BY query_id) AS t FROM gw) GROUP BY 1, 2),
d2 AS (SELECT q.query_id, q.true_label, t.ref_id, t.label, qg.grp, {cos_sql('q.v', 't.v')} AS dist
       FROM q JOIN qg USING (query_id) JOIN t ON t.label % 2 = qg.grp),
n2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rank FROM d2 QUALIFY rank <= 7),
z2 AS (SELECT *, max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS has_zero FROM n2),
w2 AS (SELECT query_id, true_label, grp, label,
              sum(CASE WHEN has_zero = 1 THEN (CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 / dist END) AS w FROM z2 GROUP BY ALL),
p2 AS (SELECT *, floor(w / sum(w) OVER (PARTITION BY query_id) * 1e6 + 0.5) / 1e6 AS p FROM w2)
SELECT query_id, CAST(true_label % 2 AS INTEGER) AS true_grp, CAST(grp AS INTEGER) AS pred_grp, true_label, arg_min(label, (-p, label)) AS pred_label, max(p) AS confidence
FROM p2 GROUP BY 1, 2, 3, 4
""")
def knn_hierarchical(spark, sf):
    """First the building (here: parity of the class) by k=5, then the class by k=7 among that building's references only.

    The building is the predicted one; a query sent to the wrong building is wrong.
    """
    queries, refs = emb_split(spark, sf)
    refs = refs.withColumn("grp", (F.col("label") % 2).cast("int"))
    first = knn.knn_join(queries, refs, 5, "cosine", payload=("grp",))
    votes = knn.distance_vote(first, ["query_id"], "grp").withColumn("probability", r6(F.col("probability")))
    chosen = knn.vote_topk(votes, ["query_id"], 1, "grp").select("query_id", "grp")
    second = knn.knn_join(queries.join(chosen, "query_id"), refs, 7, "cosine", payload=("label",), key="grp")
    votes = knn.distance_vote(second, ["query_id", "grp"], "label").withColumn("probability", r6(F.col("probability")))
    best = knn.vote_topk(votes, ["query_id", "grp"], 1)
    return best.join(queries.select("query_id", "true_label"), "query_id").select(
        "query_id", (F.col("true_label") % 2).cast("int").alias("true_grp"), F.col("grp").alias("pred_grp"), "true_label",
        F.col("label").alias("pred_label"), F.col("probability").alias("confidence"),
    )


# --- the fingerprint pipeline end to end (M5: L1 training + holdout scoring) -----------

from roomcast.functions.exprs import IMU_COLUMNS  # noqa: E402
from roomcast.session import materialize  # noqa: E402
from roomcast.operators import features as feat  # noqa: E402
from roomcast.operators.knn_pruned import knn_join_pruned  # noqa: E402
from roomcast.plans.sqlparts import CELLS, FEATURES, IMU, LABELS  # noqa: E402
from roomcast.sources import fingerprints as fp  # noqa: E402

_TRAIN = "scan_id IN (SELECT scan_id FROM split WHERE NOT is_test)"
FP_VECTORS_SQL = (
    "WITH " + CELLS + ", " + LABELS + """,
sp AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY md5(CAST(scan_id AS VARCHAR)), scan_id) AS rn,
              count(*) OVER (PARTITION BY room_id) AS n
       FROM scan_labels WHERE scan_id IN (SELECT scan_id FROM scans)),
split AS (SELECT scan_id, room_id, rn <= round(n * 0.2) AS is_test FROM sp),
""" + IMU.replace("FROM imu WHERE imu_name IS NOT NULL GROUP BY 1", f"FROM imu WHERE imu_name IS NOT NULL AND {_TRAIN} GROUP BY 1")
    + ", " + FEATURES.replace("FROM feat GROUP BY 1, 2, 3", f"FROM feat WHERE {_TRAIN} GROUP BY 1, 2, 3") + """,
zz AS (SELECT f.scan_id, f.pos, (f.value - coalesce(s.median, f.fill)) / coalesce(s.scale, 1.0) AS z FROM feat f LEFT JOIN scaler2 s USING (feature, pos, fill)),
vec AS (SELECT scan_id, list(z ORDER BY pos) AS v FROM zz GROUP BY 1),
q AS (SELECT v.scan_id AS query_id, s.room_id AS true_label, v.v FROM vec v JOIN split s USING (scan_id) WHERE s.is_test),
t AS (SELECT v.scan_id AS ref_id, s.room_id AS label, v.v FROM vec v JOIN split s USING (scan_id) WHERE NOT s.is_test)"""
)
_FP_SQL = (
    FP_VECTORS_SQL + ", " + nn_sql(7) + ", " + VOTE_SQL + """
SELECT query_id, true_label, label AS pred_label, round(probability, 6) AS confidence FROM ranked WHERE prank = 1
""")


@dataclass
class FingerprintModel:
    """What a fit leaves: the AP schema, scaler table, scaled reference rows, and the scaled holdout rows."""

    apdim: DataFrame
    params: DataFrame
    refs: DataFrame
    test: DataFrame


def fit_fingerprints(spark, sf) -> FingerprintModel:
    """M5: 80 % of the scans (stratified by room) give medians, scaler and references; every table is written once."""
    split = materialize(stratified_holdout(C.scan_labels(spark, sf), "scan_id", "room_id", 0.2))
    train_ids = split.where(~F.col("is_test")).select("scan_id")
    readings = fp.imu_readings(C.lineitem(spark, sf))
    med = feat.imu_medians(readings.join(train_ids, "scan_id", "left_semi"))
    apdim = materialize(C.apdim(spark, sf))
    scans = split.select("scan_id")
    imu_vals = feat.imu_impute(scans, readings, med, IMU_COLUMNS)
    features = materialize(feat.feature_long(C.clean_cells(spark, sf).join(scans, "scan_id", "left_semi"), apdim, imu_vals, IMU_COLUMNS))
    params = materialize(feat.robust_fit(features.join(train_ids, "scan_id", "left_semi"), train_ids.count()))
    vecs = materialize(feat.scaled_vectors(scans, features, params).join(split, "scan_id"))
    return FingerprintModel(apdim, params, vecs.where(~F.col("is_test")), vecs.where("is_test"))


def fingerprint_predictions(spark, sf, k=7):
    """Train on 80 % of the scans (stratified by room), score the rest: clean -> IMU medians
    (train) -> robust scaling (train, exact quantiles) -> cosine kNN -> 1/d vote."""
    model = fit_fingerprints(spark, sf)
    queries = model.test.select(F.col("scan_id").alias("query_id"), F.col("room_id").alias("true_label"), "vec")
    refs = model.refs.select(F.col("scan_id").alias("ref_id"), F.col("room_id").alias("label"), "vec")
    nn = knn_join_pruned(queries, refs, k, payload=("label",)).join(queries.select("query_id", "true_label"), "query_id")
    votes = knn.distance_vote(nn, ["query_id", "true_label"], "label")
    best = knn.vote_topk(votes, ["query_id", "true_label"], 1)
    return best.select("query_id", "true_label", F.col("label").alias("pred_label"), F.col("probability").alias("confidence"))


@register("fingerprint_knn_room", sql=_FP_SQL)
def fingerprint_knn_room(spark, sf):
    """M1 + M5 on the fingerprint fixture: holdout room predictions of the full pipeline."""
    p = fingerprint_predictions(spark, sf, 7)
    return p.select("query_id", "true_label", "pred_label", r6(F.col("confidence")).alias("confidence"))
