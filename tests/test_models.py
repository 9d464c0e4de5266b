"""Per-fold fits, dictionaries and device covariates against plain Python."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from roomcast.operators import dictionary as D
from roomcast.operators.knn import knn_join_by_fold
from roomcast.operators.stats import leave_one_out_quantiles


def test_leave_one_out_quantiles(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "f": rng.integers(0, 4, 400), "v": rng.integers(0, 40, 400) / 4})
    pdf.loc[3, "v"], pdf.loc[9, "v"] = np.nan, 1e9
    pdf = pd.concat([pdf, pd.DataFrame({"g": [9, 9], "f": [2, 2], "v": [1.0, 3.0]})])  # outside fold 2 this group has nothing
    got = leave_one_out_quantiles(spark.createDataFrame(pdf), ["g"], "v", "f", 4, [0.25, 0.5, 1.0]).toPandas()
    want = {(g, f) for g in (0, 1, 2) for f in range(4)} | {(9, f) for f in (0, 1, 3)}
    assert set(zip(got.g, got.fold)) == want and len(got) == len(want)
    for r in got.itertuples():
        rest = pdf[(pdf.g == r.g) & (pdf.f != r.fold)].v.dropna()
        assert r.n == len(rest) and np.allclose([r.q_0, r.q_1, r.q_2], np.percentile(rest, [25, 50, 100]))


@pytest.mark.parametrize("kw", [{}, {"ref_block_rows": 13, "query_block_rows": 9}])
def test_neighbours_across_folds(spark, kw, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    rng = np.random.default_rng(6)
    x, fold = rng.normal(size=(60, 5)), rng.integers(0, 3, 60)
    rows = [(i, int(fold[i]), x[i].tolist(), f"l{i % 4}") for i in range(60)]
    rows[7] = (7, rows[7][1], [None, *rows[7][2][1:]], "l3")
    centre, scale = rng.normal(size=(3, 5)), rng.uniform(0.5, 3, (3, 5))
    params = spark.createDataFrame([(f, centre[f].tolist(), scale[f].tolist()) for f in range(3)], "fold int, centre array<double>, scale array<double>")
    df = spark.createDataFrame(rows, "id long, fold int, vec array<double>, label string")
    got = {}
    for r in knn_join_by_fold(df, params, 4, "id", payload=("label",), **kw).collect():
        assert r.fold == fold[r.query_id] and r.label == rows[r.ref_id][3]
        got.setdefault(r.query_id, []).append((r["rank"], r.ref_id, r.dist))
    x[7, 0] = np.nan
    for i in range(60):
        f = fold[i]
        z = np.nan_to_num((x - centre[f]) / scale[f])
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        near = sorted((round(float(np.clip(1 - z[i] @ z[j], 0, 2)), 10), j) for j in range(60) if fold[j] != f)[:4]
        assert [(k + 1, j) for k, (_, j) in enumerate(near)] == [g[:2] for g in sorted(got[i])]


def test_ids_stay(spark):
    loads = [["b", "d", "b", None], ["a", "d", "c"], [], ["e", "a", "Z"]]
    known, before = None, {}
    for version, names in enumerate(loads, 1):
        known = D.extend_ids(known, spark.createDataFrame([(n,) for n in names], "name string"), version).cache()
        now = {r.name: (r.id, r.version) for r in known.collect()}
        assert before.items() <= now.items() and sorted(i for i, _ in now.values()) == list(range(len(now)))
        before = now
    assert before == {"b": (0, 1), "d": (1, 1), "a": (2, 2), "c": (3, 2), "Z": (4, 4), "e": (5, 4)}


def test_dense_numbers_over_many_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as v").repartition(7)
    got = D.dense_numbers(df, [df.v], "n", 5).collect()
    assert all(r.n == r.v + 5 for r in got) and len(got) == 1000


def test_unseen_devices_share_a_slot(spark):
    train = spark.createDataFrame([(d,) for d in ["x", "y", "y", None, "z", "z"]], "device string")
    categories = D.fit_categories(train, "device")
    assert {r.category: r.idx for r in categories.collect()} == {"y": 0, "z": 1, "x": 2}
    rows = spark.createDataFrame([(1, "x"), (2, "new"), (3, None), (4, "z")], "scan_id int, device string")
    got = {r.scan_id: (r.feature, r.pos, r.value) for r in D.category_features(rows, "device", categories, 10, "dev").collect()}
    assert got == {1: ("dev=x", 12, 1.0), 2: ("dev=?", 13, 1.0), 3: ("dev=?", 13, 1.0), 4: ("dev=z", 11, 1.0)}
    assert Counter(v[1] for v in got.values())[13] == 2


def test_grids_find_what_can_be_learned(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    from roomcast.operators import tuning

    rng = np.random.default_rng(9)
    rows = [(rng.normal(c, 0.3, 2).tolist(), float(c % 3), 10.0 * c, 5.0 * (c % 2), i // 3 % 3) for i in range(90) for c in (i % 3,)]
    df = spark.createDataFrame(rows, "v array<double>, label double, x double, y double, fold int").withColumn("features", array_to_vector("v")).cache()
    est, maps, settings = tuning.mlp_grid([(4,), (5, 4)], 2, 3, 60)
    mlp = tuning.cross_validated(df, est, maps, settings, MulticlassClassificationEvaluator(metricName="accuracy"), 3)
    assert [r["hidden"] for r in mlp] == ["4", "5-4"] and sum(r["best"] for r in mlp) == 1 and max(r["score_mean"] for r in mlp) > 0.8
    est, maps, settings = tuning.tree_grid([1, 6], [3], [0.2])
    trees = tuning.cross_validated(df, est, maps, settings, tuning.NegativePositionError(), 3)
    assert -1.5 < trees[1]["score_mean"] < 0 and all(r["score_std"] >= 0 for r in trees)


def test_grid_queries(spark):
    """The vectors of the tables know nothing of their labels: only the shape is checked."""
    from roomcast.plans import q_models as Q
    from tests.conftest import SF_SMALL

    trees = Q.tree_grid(spark, SF_SMALL, trees=(1, 2)).collect()
    assert len(trees) == 12 and sum(r.best for r in trees) == 1 and all(r.score_mean < 0 <= r.score_std for r in trees)
    mlp = Q.mlp_grid(spark, SF_SMALL, iterations=3).collect()
    assert [r.setting for r in mlp] == ["hidden=50", "hidden=100", "hidden=50-50"]
    rows = Q.tree_classifiers(spark, SF_SMALL, trees=3, depth=3).collect()
    assert Counter(r.target for r in rows) == {"building": 100, "floor": 100}


REPLIES = {
    '{"floor": 1.7, "room_id": {}, "candidates": [], "building": false}': "ok",
    '{"floor": "+2", "room_id": null, "candidates": [{"room_id": 1, "probability": " 1E-2 "}], "confidence_floor": "nan"}': "ok",
    '{"floor": [1], "room_id": "x", "candidates": []}': "bad_floor",
    '{"floor": "1.0", "room_id": "x", "candidates": []}': "bad_floor",
    '{"floor": 1, "room_id": "\\u00a0\\n", "candidates": []}': "empty_room",
    '{"floor": 1, "room_id": "x", "candidates": null}': "candidates_not_list",
    '{"floor": 1, "room_id": "x", "candidates": [{"room_id": "y", "probability": 1}, 5, {"room_id": " "}]}': "candidate_not_object",
    '{"floor": 1, "room_id": "x", "candidates": [{"room_id": " ", "probability": 1}]}': "candidate_empty_room",
    '{"floor": 1, "room_id": "x", "candidates": [{"room_id": "y", "probability": "1.0d"}]}': "candidate_bad_probability",
    '{"floor": 1, "room_id": "x", "candidates": [], "building": "1.5"}': "bad_building",
    '{"floor": 1, "room_id": "x", "candidates": [], "confidence_room": []}': "bad_confidence",
    '{"floor": 1, "room_id": "x"}': "missing_keys",
    '"floor"': "not_object", "{broken": "not_object", None: "not_object",
}


def test_reply_types(spark):
    from roomcast.operators.validate import payload_error

    df = spark.createDataFrame([(p,) for p in REPLIES], "p string")
    assert [r[0] for r in df.select(payload_error(df.p)).collect()] == list(REPLIES.values())
