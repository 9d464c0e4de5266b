"""Operators against brute force: kNN, quantiles, ranks, BFS, nearest free cell."""

from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roomcast.operators import grid as G
from roomcast.operators import metrics as M
from roomcast.operators.features import scaled_vectors
from roomcast.operators.knn import knn_join
from roomcast.operators.stats import exact_quantiles, group_rank
from roomcast.plans import q_routes as R
from roomcast.sources.maps import read_floor_records
from tests.conftest import SF_SMALL


def _brute_knn(q, r, k, metric):
    out = []
    for qid, qv in q:
        rows = []
        for rid, rv in r:
            a, b = np.asarray(qv), np.asarray(rv)
            if metric == "cosine":
                d = 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
                d = min(2.0, max(0.0, d))
            else:
                d = float(np.sqrt(((a - b) ** 2).sum()))
            rows.append((round(d, 10), rid))
        rows.sort()
        out += [(qid, rid, i + 1) for i, (_, rid) in enumerate(rows[:k])]
    return sorted(out)


def test_knn_strategies_match_brute_force(spark):
    rng = np.random.default_rng(7)
    q = [(i, rng.normal(size=6).tolist()) for i in range(20)]
    r = [(100 + i, rng.normal(size=6).tolist()) for i in range(60)]
    qdf = spark.createDataFrame(q, "query_id long, vec array<double>")
    rdf = spark.createDataFrame(r, "ref_id long, vec array<double>")
    for metric in ("cosine", "euclidean"):
        want = _brute_knn(q, r, 5, metric)
        for kw in ({}, {"ref_block_rows": 17, "query_block_rows": 7}):
            got = sorted(tuple(x) for x in knn_join(qdf, rdf, 5, metric, **kw).select("query_id", "ref_id", "rank").collect())
            assert got == want, (metric, kw)
    # groups over many partitions, as larger data has them
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = knn_join(qdf, rdf, 5, "cosine", ref_block_rows=17, query_block_rows=3).select("query_id", "ref_id", "rank").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(tuple(x) for x in got) == _brute_knn(q, r, 5, "cosine")


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "v": rng.normal(size=500).round(3)})
    pdf.loc[7, "v"] = 1e12  # an outlier must not gather the rest in one range
    df = spark.createDataFrame(pdf)
    for parts in (1, 7, None):
        got = exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.95, 1.0], partitions=parts).toPandas().sort_values("g")
        assert len(got) == 3
        for _, row in got.iterrows():
            vals = pdf.loc[pdf.g == row.g, "v"].to_numpy()
            assert row.n == len(vals)
            for i, p in enumerate([0.25, 0.5, 0.95, 1.0]):
                assert abs(row[f"q_{i}"] - np.percentile(vals, p * 100)) < 1e-9


def test_exact_quantiles_null_key_and_counts(spark):
    df = spark.createDataFrame([(None, 1.0, 3), (None, 9.0, 1), ("a", float("nan"), 2), ("a", 4.0, 2), ("b", None, 1)], "g string, v double, c int")
    got = {r.g: (r.n, r.q_0) for r in exact_quantiles(df, ["g"], "v", [0.5], count_col="c").collect()}
    assert got == {None: (4, 1.0), "a": (2, 4.0)}
    assert [r.q_0 for r in exact_quantiles(df, [], "v", [0.5], count_col="c").collect()] == [2.5]


def test_confusion_keeps_predicted_only_label(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "b")], "t string, p string")
    got = {(r.true_label, r.pred_label): (r["count"], r.share) for r in M.confusion_dense(df, "t", "p").collect()}
    assert len(got) == 9 and got["a", "z"] == (1, 0.5) and got["z", "z"] == (0, 0.0) and got["b", "b"] == (1, 1.0)


def test_scaled_vectors_with_a_feature_first_heard_after_the_fit(spark):
    feats = spark.createDataFrame(
        [(1, "AP1", 1, -50.0, -110.0), (1, "AP2", 2, -60.0, -110.0), (2, "AP3", 3, -70.0, -110.0), (1, "acc", 4, 2.0, 0.0), (2, "acc", 4, 4.0, 0.0)],
        "scan_id int, feature string, pos int, value double, fill double",
    )
    params = spark.createDataFrame(
        [("AP1", 1, -110.0, -100.0, 10.0), ("AP3", 3, -110.0, -90.0, 20.0), ("acc", 4, 0.0, 2.0, 2.0)],
        "feature string, pos int, fill double, median double, scale double",
    )
    scans = spark.createDataFrame([(1,), (2,)], "scan_id int")
    got = {r.scan_id: list(r.vec) for r in scaled_vectors(scans, feats, params).collect()}
    assert got == {1: [5.0, 50.0, -1.0, 0.0], 2: [-1.0, 0.0, 1.0, 1.0]}


def test_read_floor_records(spark, tmp_path):
    good, bad = tmp_path / "f1.json", tmp_path / "f2.json"
    good.write_text(' \n[5, {"room_id": " r1 ", "floor": "1", "type": "Room", "x": 2}, null, {"room_id": "r2"}]')
    bad.write_text('{"room_id": "r1"}')
    rows = read_floor_records(spark, {1: str(good)}).orderBy("pos").collect()
    assert [(r.pos, r.room_id, r.floor, r.type) for r in rows] == [(1, "r1", 1, "room"), (3, "r2", None, None)]
    with pytest.raises(Exception, match="not a JSON array"):
        read_floor_records(spark, {1: str(bad)}).collect()


def test_best_routes_prefers_key_pairs_and_keeps_every_request(spark):
    """Floors 1 and 2 are free 1 x 12 corridors; elevator 7 stands on both, elevators 1 and 2 are nearer."""
    cells = spark.createDataFrame([(f, 0, x, True) for f in (1, 2) for x in range(12)], "floor int, y int, x int, walkable boolean")
    at = [(0, "r.a", 1, "room", 0), (1, "r.b", 2, "room", 0), (2, "elevator7", 1, "elevator", 10), (3, "Elevator-7", 2, "elevator", 9),
          (4, "elevator1", 1, "elevator", 1), (5, "elevator2", 2, "elevator", 1), (6, "stair1", 1, "stairway", 0), (7, "walled", 1, "room", None)]
    rooms = spark.createDataFrame([(o, i, f, t, t != "stairway", 0, 0) for o, i, f, t, _ in at], "ord int, room_id string, floor int, type string, accessible boolean, y int, x int")
    snapped = spark.createDataFrame([(i, f, 0, x) for _, i, f, _, x in at if x is not None], "room_id string, floor int, cy int, cx int")
    dist = G.bfs(cells, snapped.select(F.col("room_id").alias("src"), "floor", F.col("cy").alias("y"), F.col("cx").alias("x")), hops=3)
    req = spark.createDataFrame([(1, 0, 1, True), (2, 0, 99, True), (3, 99, 0, False), (4, 0, 2, False), (5, 0, 7, False)], "req int, start_ord int, goal_ord int, accessible boolean")
    got = {r.req: (r.status, r.steps, r.connector_start, r.connector_goal) for r in G.best_routes(req, rooms, snapped, dist).collect()}
    assert got == {
        1: ("ok", 19, "elevator7", "Elevator-7"), 2: ("unknown_room", None, None, None), 3: ("unknown_room", None, None, None),
        4: ("ok", 10, None, None), 5: ("blocked", None, None, None),
    }
    no_key = rooms.where("room_id <> 'Elevator-7'")
    r = G.best_routes(req.where("req = 1"), no_key, snapped, dist).first()
    assert (r.steps, r.connector_start, r.connector_goal) == (2, "elevator1", "elevator2")


def test_group_rank_matches_sort(spark):
    import hashlib

    pdf = pd.DataFrame({"id": range(300), "g": [i % 4 for i in range(300)]})
    got = group_rank(spark.createDataFrame(pdf), ["g"], "id", bucket_chars=1).toPandas()
    pdf["h"] = [hashlib.md5(str(i).encode()).hexdigest() for i in pdf.id]
    pdf["want"] = pdf.sort_values(["h", "id"]).groupby("g").cumcount() + 1
    m = got.merge(pdf, on=["id", "g"])
    assert (m.rn == m.want).all() and (m.n == 75).all()


def _grid(spark):
    w, cells = R._cells(spark, SF_SMALL)
    pc = cells.toPandas()
    free = {(r.floor, r.y, r.x) for r in pc.itertuples() if r.walkable}
    return w, cells, free


def test_bfs_matches_python(spark):
    w, cells, free = _grid(spark)
    starts = sorted(free)[:3]
    src = spark.createDataFrame([(f"s{i}", f, y, x) for i, (f, y, x) in enumerate(starts)], "src string, floor int, y int, x int")
    got = {(r.src, r.floor, r.y, r.x): r.dist for r in G.bfs(cells, src).collect()}
    want = {}
    for i, s in enumerate(starts):
        seen = {s: 0}
        dq = deque([s])
        while dq:
            f, y, x = dq.popleft()
            for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
                n = (f, y + dy, x + dx)
                if n in free and n not in seen:
                    seen[n] = seen[(f, y, x)] + 1
                    dq.append(n)
        want.update({(f"s{i}",) + c: d for c, d in seen.items()})
    assert got == want


def test_nearest_free_matches_ring_scan(spark):
    w, cells, free = _grid(spark)
    pts = [(i, 1 + i % 2, (i * 5) % w, (i * 3) % w) for i in range(12)]
    st = spark.createDataFrame(pts, "k int, floor int, sy int, sx int")
    got = {r.k: (r.cy, r.cx) for r in G.nearest_free(st, cells, 60, "k", first_radius=2).collect()}
    for k, f, y, x in pts:
        want = None
        if (f, y, x) in free:
            want = (y, x)
        else:
            for rad in range(1, 61):
                hits = [(yy, xx) for yy in range(y - rad, y + rad + 1) for xx in range(x - rad, x + rad + 1) if (f, yy, xx) in free]
                if hits:
                    want = min(hits)
                    break
        assert got.get(k) == want
