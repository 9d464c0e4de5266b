"""Findings of round 3: what is written, met or held once, on rows built here."""

import json
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomcast.operators import features as feat
from roomcast.operators import grid as G
from roomcast.operators import knn, knn_pruned, scoring
from roomcast.plans import q_models, q_serving


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_train_report_searches_once(spark):
    """the neighbours are searched once, whatever reads the predictions."""
    rows = [(i, "r%d" % (i % 2), "FOP"[i % 3], [1.0, float(i % 2), float(i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "scan_id long, room_id string, floor string, vec array<double>")
    out = q_serving._predictions(SimpleNamespace(test=df.where("scan_id % 4 = 0"), refs=df.where("scan_id % 4 > 0")))
    assert out.count() == 6 and "CoGroup" not in _plan(out)


def test_score_searches_once(spark):
    """Room and floor votes read one written search."""
    features = spark.createDataFrame([("AP1", 1, -110.0, -110.0, 1.0), ("AP2", 2, -110.0, -110.0, 1.0)], "feature string, pos int, fill double, median double, scale double")
    refs = spark.createDataFrame([(1, "a", 1, [50.0, 0.0]), (2, "b", 2, [0.0, 50.0])], "ref_id long, room_id string, floor int, vec array<double>")
    asked = [(1, json.dumps({"rssi": {"AP1": -60.0}, "imu": {}, "top_k": 1})), (2, json.dumps({"rssi": {"WAP002": -50.0}, "imu": {}, "top_k": 2}))]
    out = scoring.score(spark.createDataFrame(asked, "req_id long, request string"), scoring.ScoringModel(features, refs))
    assert {r.req_id: json.loads(r.reply)["room_id"] for r in out.collect()} == {1: "a", 2: "b"}
    assert "CoGroup" not in _plan(out)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_topk_block_memory(metric):
    """The scratch of a block stays small and the neighbours exact, ties included."""
    rng = np.random.default_rng(3)
    refs = rng.integers(-3, 4, (3001, 3)).astype(float)
    refs[0] = 1.0
    queries = rng.integers(-3, 4, (3000, 3)) + 0.5
    if metric == "cosine":
        queries, refs = knn._unit(queries), knn._unit(refs)
    ids = rng.permutation(len(refs))
    tracemalloc.start()
    qi, ri, dist, rank = knn.topk_block(np.arange(3000), queries, ids, refs, 5, metric, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    for q in range(0, 3000, 97):
        d = 1 - refs @ queries[q] if metric == "cosine" else np.sqrt(((refs - queries[q]) ** 2).sum(1))
        want = sorted(zip(np.round(d, 8), ids))[:5]
        assert [r for _, r in sorted(zip(rank[qi == q], ids[ri[qi == q]]))] == [r for _, r in want]


ROOMS = "ord long, room_id string, floor int, type string, accessible boolean"


def test_connector_pairs_shuffle_no_pairs(spark, monkeypatch):
    """by key where a combination of floors has one, else by type; settled before any pair is formed."""
    monkeypatch.setattr(G, "PAIR_ROWS", 3, raising=False)
    kinds = ["elevator", "stairway"]
    rooms = [(i, f"{kinds[i % 2]}{i if i < 9 else i - 4}", i % 3, kinds[i % 2], i % 4 != 1) for i in range(14)] + [(99, "10.1.9", 1, "room", True)]
    out = G.connector_pairs(spark.createDataFrame(rooms, ROOMS))
    conn = [(o, r, f, t, a, f"{t}:{''.join(c for c in r if c.isdigit())}") for o, r, f, t, acc in rooms[:-1] for a in ([False, True] if t == "elevator" and acc else [False])]
    pairs = [(a, b) for a in conn for b in conn if a[4] == b[4] and a[2] != b[2]]
    keyed = {(a[2], b[2], a[4]) for a, b in pairs if a[5] == b[5]}
    want = sorted((a[2], b[2], a[4], a[0], b[0], "key" if a[5] == b[5] else "type") for a, b in pairs
                  if a[5] == b[5] or (a[3] == b[3] and (a[2], b[2], a[4]) not in keyed))
    got = sorted((r.start_floor, r.goal_floor, r.accessible, r.a_ord, r.b_ord, r.matched_by) for r in out.collect())
    assert got == want and {w[-1] for w in want} == {"key", "type"}
    assert "LeftAnti" not in _plan(out)


def test_nearest_free_meets_buckets(spark):
    """a start meets one row per bucket of cells, not one per cell."""
    cells = spark.createDataFrame([(1, y, x, True) for y in range(24) for x in range(24)], "floor int, y int, x int, walkable boolean")
    starts = spark.createDataFrame([("a", 1, 5, 5), ("b", 1, 30, 30)], "k string, floor int, sy int, sx int")
    out = G.nearest_free(starts, cells, 80, "k")
    assert {r.k: (r.cy, r.cx) for r in out.collect()} == {"a": (5, 5), "b": (23, 23)}
    assert "collect_set" in _plan(out)


def test_kmeans_builds_features_once(spark, monkeypatch):
    """the feature table is built once and written."""
    calls = []
    li = [(s, n, s * 3 + n, float(1 + (s * n) % 40), 100.0 * n + s, "ANR"[s % 3], "OF"[n % 2]) for s in range(30) for n in range(1, 5)]
    li = spark.createDataFrame(li, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string")
    monkeypatch.setattr(q_models.C, "lineitem", lambda *_: li)
    table = q_models.C.feature_table
    monkeypatch.setattr(q_models.C, "feature_table", lambda *a: calls.append(a) or table(*a))
    assert q_models.kmeans_patterns(spark, "").select("scan_id").distinct().count() == 30
    assert len(calls) == 1


def test_imu_impute_without_grid(spark):
    """one shuffle by scan; a missing or lost reading takes the median, an unknown channel is ignored."""
    scans = spark.createDataFrame([(1,), (2,), (3,)], "scan_id long")
    long = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "b", None), (2, "z", 9.0), (2, None, 8.0), (7, "a", 5.0)], "scan_id long, imu_name string, value double")
    out = feat.imu_impute(scans, long, spark.createDataFrame([("a", 2.5)], "imu_name string, median double"), ["a", "b"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 3.0), (1, "b", 0.0), (2, "a", 2.5), (2, "b", 0.0), (3, "a", 2.5), (3, "b", 0.0)]
    assert "hashpartitioning(scan_id#" not in _plan(out) or "imu_name#" not in " ".join(x for x in _plan(out).split("\n") if "hashpartitioning" in x)


def test_fold_medians_tasks_grow_with_readings(spark, monkeypatch):
    """readings meet their folds in tasks of a bounded number of readings."""
    seen = []
    monkeypatch.setattr(q_models, "READINGS_PER_TASK", 5, raising=False)
    li = spark.createDataFrame([(s, n, 1.0, 1000.0 * n, "N", "F") for s in range(40) for n in (1, 2)], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string")
    monkeypatch.setattr(q_models.C, "lineitem", lambda *_: li)
    monkeypatch.setattr(q_models.C, "scan_labels", lambda *_: li.select(F.col("l_orderkey").alias("scan_id"), F.lit("r").alias("room_id")).distinct())
    loo = q_models.leave_one_out_quantiles
    monkeypatch.setattr(q_models, "leave_one_out_quantiles", lambda df, *a: seen.append(_plan(df)) or loo(df, *a))
    got = {(r.fold, r.n, r.median) for r in q_models.fold_imu_medians(spark, "").collect()}
    assert got == {(f, 32, m) for f in range(5) for m in (1.0, 2.0)}
    assert ", 16)" in seen[0]


def _heard(n, first, seed):
    """Vectors of a few strong components out of 12, some zero, some with a gap."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = np.zeros(12)
        v[rng.choice(12, i % 5, replace=False)] = rng.integers(-3, 9, i % 5)
        v[3] = None if i % 97 == 1 else v[3]
        rows.append((first + i, [None if np.isnan(x) else float(x) for x in v], f"p{i % 5}" if i % 7 else None))
    return rows


def test_pruned_search_is_exact(spark):
    """the same neighbours as of one block that is compared in full, ties and equal rows included."""
    q = spark.createDataFrame(_heard(300, 0, 1), "query_id long, vec array<double>, label string").drop("label")
    r = spark.createDataFrame(_heard(1200, 5000, 2), "ref_id long, vec array<double>, label string")
    want = sorted(map(str, knn.knn_join(q, r, 7, "cosine", payload=("label",)).collect()))
    assert len(want) > 2000
    for sizes in ((100, 70), (700, 1000)):
        got = knn_pruned.knn_join_pruned(q, r, 7, payload=("label",), ref_block_rows=sizes[0], query_block_rows=sizes[1])
        assert sorted(map(str, got.collect())) == want


def test_pruned_search_meets_few_blocks(spark, monkeypatch):
    """queries are copied to the blocks that can hold a neighbour, not to all."""
    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(20)[i % 20] * 50 + rng.normal(size=20)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    met = []
    real = knn_pruned._routed
    monkeypatch.setattr(knn_pruned, "_routed", lambda *a: met.append(real(*a)) or met[-1])
    monkeypatch.setattr(knn, "knn_join", None)
    got = knn_pruned.knn_join_pruned(df.where("id % 8 = 0").withColumnRenamed("id", "query_id"), df.where("id % 8 > 0").withColumnRenamed("id", "ref_id"), 3, ref_block_rows=175)
    assert got.count() == 1500
    # 20 blocks at least: all of them would be met 10,000 times
    assert sum(x.agg(F.sum(F.size("_bs"))).first()[0] for x in met) < 3000


def test_fingerprints_are_searched_with_pruning(spark, monkeypatch):
    """room predictions and the report leave out what cannot be near."""
    from roomcast.plans import q_knn

    asked = []
    for module in (q_knn, q_serving):
        real = module.knn_join_pruned
        monkeypatch.setattr(module, "knn_join_pruned", lambda *a, real=real, **kw: asked.append(1) or real(*a, **kw, ref_block_rows=3))
    rows = [(i, "r%d" % (i % 2), "FOP"[i % 3], [1.0, float(i % 2), float(i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "scan_id long, room_id string, floor string, vec array<double>")
    model = SimpleNamespace(test=df.where("scan_id % 4 = 0"), refs=df.where("scan_id % 4 > 0"))
    monkeypatch.setattr(q_knn, "fit_fingerprints", lambda *a: model)
    assert q_knn.fingerprint_predictions(spark, None, 3).count() == 3 and q_serving._predictions(model).count() == 6 and len(asked) == 2


def test_settings_of_a_fold_are_fitted_at_once(spark, monkeypatch):
    """no perceptron of the grid waits for another one of its fold."""
    import threading

    from pyspark.ml.classification import MultilayerPerceptronClassifier

    from tests.conftest import SF_SMALL

    together, folds, fit = threading.Barrier(3), [], MultilayerPerceptronClassifier._fit

    def fit_together(self, dataset):
        if len(folds) < 9:  # the tenth fit is that of the best setting on all rows
            folds.append(1)
            together.wait(60)
        return fit(self, dataset)

    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", fit_together)
    rows = q_models.mlp_grid(spark, SF_SMALL, iterations=2).collect()
    assert len(rows) == 3 and len(folds) == 9
