"""Exact k-nearest-neighbour join (cosine or Euclidean) and distance voting.

Plan shape
----------
Exact kNN needs every query compared with every reference of its partition,
but it must not *emit* those pairs.  References are cut into ``B`` hash blocks and
queries into ``Q`` hash chunks; block ``b`` of the references meets chunk ``q`` of the
queries in one ``cogroup`` group, as two matrices.  Every group is bounded by
``ref_block_rows`` x ``query_block_rows`` whatever the skew of the keys, each task
emits only its k best per query, and a ``row_number() <= k`` over ``B * k`` candidates
per query merges the blocks (Spark plans it with a partial ``WindowGroupLimit``).  This is
the one path at every size; nothing passes through the driver.  References are copied once
per chunk, so chunks are as large as memory allows once there are enough of them to
occupy the session's tasks.

An equi ``key`` (building, floor, ...) restricts neighbours to the same key.
``knn_join_by_fold`` is the cross-validation form: every query meets the references of the
other folds, both scaled with the parameters fitted without its fold, from one copy of the rows.

Ordering contract: distance rounded to 10 places, then ``ref_id``.  Cosine
distance of a zero vector is 1 (its unit vector is zero), clipped to [0, 2].
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIST_DECIMALS = 10
# Kernel scratch: at most this many distance cells per sub-chunk (~8 MiB).
_CELLS_PER_CHUNK = 1 << 20


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    n = len(column)
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if n else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1 if n else 0)


def _unit(m: np.ndarray) -> np.ndarray:
    if m.size == 0:
        return m
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    safe = np.where(norms > 0, norms, 1.0)
    unit = m / safe[:, None]
    unit[~(norms > 0)] = 0.0
    return unit


def _distances(qm: np.ndarray, rm: np.ndarray, metric: str, r_sq: np.ndarray | None) -> np.ndarray:
    """Distances in an order-preserving form: cosine as it is, Euclidean squared."""
    d = qm @ rm.T
    if metric == "cosine":
        np.subtract(1.0, d, out=d)
        return d
    d *= -2.0
    d += np.einsum("ij,ij->i", qm, qm)[:, None]
    d += r_sq[None, :]
    return np.maximum(d, 0, out=d)


def _finished(d: np.ndarray, metric: str) -> np.ndarray:
    return np.round(np.clip(d, 0.0, 2.0) if metric == "cosine" else np.sqrt(d), DIST_DECIMALS)


def _at_least_kth(d: np.ndarray, k: int) -> np.ndarray:
    """Per row a bound that ``k`` of its values do not exceed: the kth least of the minima of some 16 columns each."""
    groups = d.shape[1] // 16
    least = d[:, : 16 * groups].reshape(len(d), 16, groups).min(axis=1) if groups >= k else d
    return np.partition(least, k - 1, axis=1)[:, k - 1]


def topk_block(
    q_ids: np.ndarray,
    qm: np.ndarray,
    r_ids: np.ndarray,
    rm: np.ndarray,
    k: int,
    metric: str,
    exclude_self: bool,
):
    """k smallest (distance, ref id) per query of one block.

    Returns parallel arrays (query index, ref index, distance, rank).  ``qm`` and
    ``rm`` are already unit vectors for cosine.  Ties on the rounded distance are
    broken by the reference id, exactly as ``ORDER BY dist, ref_id``.
    """
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    nq, nr = len(q_ids), len(r_ids)
    if nq == 0 or nr == 0:
        return empty
    r_sq = np.einsum("ij,ij->i", rm, rm) if metric == "euclidean" else None
    step = max(1, _CELLS_PER_CHUNK // nr)
    out_q, out_r, out_d, out_k = [], [], [], []
    for start in range(0, nq, step):
        stop = min(nq, start + step)
        d = _distances(qm[start:stop], rm, metric, r_sq)
        if exclude_self:
            d[q_ids[start:stop, None] == r_ids[None, :]] = np.inf
        kk = min(k, nr)
        kth = _at_least_kth(d, kk)
        # all that rounds to that distance or less: only these few are finished and sorted
        edge = kth + 2e-10 if metric == "cosine" else np.square(np.sqrt(kth) + 2e-10)
        rows, cols = np.nonzero(d <= np.maximum(edge, kth)[:, None])
        dist = _finished(d[rows, cols], metric)
        order = np.lexsort((r_ids[cols], dist, rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") + 1
        keep = (rank <= k) & np.isfinite(dist)
        out_q.append(rows[keep] + start)
        out_r.append(cols[keep])
        out_d.append(dist[keep])
        out_k.append(rank[keep])
    return (np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_d), np.concatenate(out_k))


def _output_schema(refs: DataFrame, ref_id: str, payload: list[str], key: str | None, query_id: str):
    fields = [T.StructField(query_id, T.LongType(), False)]
    if key:
        fields.append(refs.schema[key])
    fields.append(T.StructField(ref_id, T.LongType(), False))
    for name in payload:
        fields.append(refs.schema[name])
    fields.append(T.StructField("dist", T.DoubleType(), False))
    fields.append(T.StructField("rank", T.IntegerType(), False))
    return T.StructType(fields)


def _chunk_count(n_queries: int, tasks: int, query_block_rows: int) -> int:
    """Chunks of at most ``query_block_rows`` queries, but enough of them for the session's tasks."""
    return max(1, math.ceil(n_queries / query_block_rows), min(tasks, n_queries // 256))


def _merged(cand: DataFrame, n_blocks: int, by: list[str], ref_id: str, k: int) -> DataFrame:
    if n_blocks == 1:
        return cand
    w = Window.partitionBy(*by).orderBy("dist", ref_id)
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _dealt(df: DataFrame, id_col: str, own: str, n: int, other: str, m: int) -> DataFrame:
    """Rows in their own group of ``n``, each copied to the ``m`` groups of the other side."""
    # cogroup deals both sides by the hash of the group's numbers: they must be of one type
    return df.withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    )


def knn_join(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    metric: str = "cosine",
    query_id: str = "query_id",
    ref_id: str = "ref_id",
    vec: str = "vec",
    payload: tuple[str, ...] = (),
    key: str | None = None,
    exclude_self: bool = False,
    ref_block_rows: int = 20_000,
    query_block_rows: int = 20_000,
) -> DataFrame:
    """k nearest references per query: ``(query_id, [key], ref_id, payload..., dist, rank)``.

    ``queries`` needs ``query_id`` and ``vec`` (ARRAY<DOUBLE>) and ``key`` if
    given; ``refs`` needs ``ref_id``, ``vec``, the payload columns and ``key``.  Without
    references the result is empty.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unsupported metric {metric!r}")
    if k < 1:
        raise ValueError("k must be at least 1")
    payload = list(payload)
    keycols = [key] if key else []
    schema = _output_schema(refs.select(*keycols, *payload), ref_id, payload, key, query_id)
    # fresh columns on either side: both may come from one table
    q = queries.select(F.col(query_id).cast("long").alias("_id"), F.col(vec).alias("_v"), *(F.col(c).alias("_k") for c in keycols))
    r = refs.select(
        F.col(ref_id).cast("long").alias("_id"), F.col(vec).alias("_v"), *(F.col(c).alias("_k") for c in keycols),
        *(F.col(c).alias(f"_p_{c}") for c in payload),
    )
    tasks = int(q.sparkSession.sparkContext.defaultParallelism)
    n_blocks = max(1, math.ceil(r.count() / ref_block_rows))
    n_chunks = _chunk_count(q.count(), tasks, query_block_rows)
    qx = _dealt(q, "_id", "_qc", n_chunks, "_rb", n_blocks)
    rx = _dealt(r, "_id", "_rb", n_blocks, "_qc", n_chunks)
    gkeys = ["_k"] * bool(key) + ["_qc", "_rb"]

    def kernel(qt: pa.Table, rt: pa.Table) -> pa.Table:
        q_ids, r_ids = qt.column("_id").to_numpy(), rt.column("_id").to_numpy()
        qm, rm = _matrix(qt.column("_v")), _matrix(rt.column("_v"))
        # one copy of the vectors at a time
        qt, rt = qt.drop_columns("_v"), rt.drop_columns("_v")
        if metric == "cosine":
            qm = _unit(qm)
            rm = _unit(rm)
        pa.default_memory_pool().release_unused()
        qi, ri, dist, rank = topk_block(q_ids, qm, r_ids, rm, k, metric, exclude_self)
        columns = {query_id: pa.array(q_ids[qi], pa.int64())}
        if key:
            columns[key] = qt.column("_k").take(pa.array(qi))
        columns[ref_id] = pa.array(r_ids[ri], pa.int64())
        columns.update((name, rt.column(f"_p_{name}").take(pa.array(ri))) for name in payload)
        columns["dist"], columns["rank"] = pa.array(dist, pa.float64()), pa.array(rank, pa.int32())
        return pa.table(columns)

    cand = qx.groupBy(*gkeys).cogroup(rx.groupBy(*gkeys)).applyInArrow(kernel, schema)
    return _merged(cand, n_blocks, [query_id, *keycols], ref_id, k)


def knn_join_by_fold(
    rows: DataFrame,
    params: DataFrame,
    k: int,
    id_col: str,
    fold_col: str = "fold",
    vec: str = "vec",
    payload: tuple[str, ...] = (),
    ref_block_rows: int = 20_000,
    query_block_rows: int = 20_000,
) -> DataFrame:
    """Cosine neighbours of every row among the rows of other folds: ``(query_id, fold, ref_id, payload..., dist, rank)``.

    ``params``: (fold, centre ARRAY<DOUBLE>, scale ARRAY<DOUBLE>), fitted without that fold; a null
    component counts as the centre.  A reference row travels once per chunk of queries, not once per
    fold; a task scales its block anew for each fold that its queries have.  The parameters are as wide
    as a row and travel as rows of every group.
    """
    payload = list(payload)
    def fresh(*more):  # fresh columns on either side: both come from one table
        return rows.select(F.col(id_col).cast("long").alias("_id"), F.col(fold_col).cast("int").alias("_f"), F.col(vec).alias("_v"), *more)

    none = F.lit(None).cast("array<double>")
    tasks = int(rows.sparkSession.sparkContext.defaultParallelism)
    n = rows.count()
    n_blocks, n_chunks = max(1, math.ceil(n / ref_block_rows)), _chunk_count(n, tasks, query_block_rows)
    groups = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    fitted = params.select(F.lit(None).cast("long").alias("_id"), F.col("fold").cast("int").alias("_f"), F.col("centre").alias("_v"), F.col("scale").alias("_s"))
    fitted = fitted.withColumn("_qc", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).withColumn("_rb", groups)
    asked = _dealt(fresh(none.alias("_s")), "_id", "_qc", n_chunks, "_rb", n_blocks)
    asked = asked.unionByName(fitted.select(asked.columns), allowMissingColumns=False)
    refs = _dealt(fresh(*(F.col(c).alias(f"_p_{c}") for c in payload)), "_id", "_rb", n_blocks, "_qc", n_chunks)
    fields = [T.StructField("query_id", T.LongType()), T.StructField("fold", T.IntegerType()), T.StructField("ref_id", T.LongType())]
    fields += [rows.schema[c] for c in payload] + [T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType())]

    def kernel(qt: pa.Table, rt: pa.Table) -> pa.Table:
        is_param = qt.column("_id").is_null().to_numpy()
        scale_of = {}
        for fold, centre, scale in zip(*(qt.filter(pa.array(is_param)).column(c).to_pylist() for c in ("_f", "_v", "_s"))):
            scale_of[fold] = np.array(centre, np.float64), np.array(scale, np.float64)
        qt = qt.filter(pa.array(~is_param))
        q_ids, r_ids = (t.column("_id").to_numpy().astype(np.int64) for t in (qt, rt))
        q_fold, r_fold = (t.column("_f").to_numpy() for t in (qt, rt))
        qm, rm = _matrix(qt.column("_v")), _matrix(rt.column("_v"))
        parts = []
        for fold in np.unique(q_fold):
            centre, scale = scale_of[int(fold)]
            qs, rs = np.flatnonzero(q_fold == fold), np.flatnonzero(r_fold != fold)
            mine, others = (_unit(np.nan_to_num((m - centre) / scale, nan=0.0)) for m in (qm[qs], rm[rs]))
            qi, ri, dist, rank = topk_block(q_ids[qs], mine, r_ids[rs], others, k, "cosine", False)
            parts.append((qs[qi], rs[ri], dist, rank))
        qi, ri, dist, rank = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
        columns = {"query_id": pa.array(q_ids[qi], pa.int64()), "fold": pa.array(q_fold[qi], pa.int32()), "ref_id": pa.array(r_ids[ri], pa.int64())}
        columns.update((name, rt.column(f"_p_{name}").take(pa.array(ri, pa.int64()))) for name in payload)
        columns["dist"], columns["rank"] = pa.array(dist, pa.float64()), pa.array(rank, pa.int32())
        return pa.table(columns)

    cand = asked.groupBy("_qc", "_rb").cogroup(refs.groupBy("_qc", "_rb")).applyInArrow(kernel, T.StructType(fields))
    return _merged(cand, n_blocks, ["query_id"], "ref_id", k)


def distance_vote(
    neighbours: DataFrame,
    group_cols: list[str],
    label: str = "label",
    dist: str = "dist",
) -> DataFrame:
    """Distance-weighted class vote: ``(group..., label, weight, probability)``.

    Weight is ``1/dist``; when any neighbour of a query sits at distance 0, only
    the zero-distance neighbours vote, with weight 1 each.
    """
    w = Window.partitionBy(*group_cols)
    with_w = neighbours.withColumn("_zero", F.max((F.col(dist) == 0).cast("int")).over(w)).withColumn(
        "_w",
        F.when(F.col("_zero") == 1, (F.col(dist) == 0).cast("double")).otherwise(1.0 / F.col(dist)),
    )
    per_label = with_w.groupBy(*group_cols, label).agg(F.sum("_w").alias("weight"))
    return per_label.withColumn("probability", F.col("weight") / F.sum("weight").over(w))


def vote_topk(votes: DataFrame, group_cols: list[str], top_k: int, label: str = "label") -> DataFrame:
    """Rank classes by probability desc, ties to the smaller label; keep ``top_k``."""
    w = Window.partitionBy(*group_cols).orderBy(F.col("probability").desc(), F.col(label))
    return votes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def weighted_mean_regress(neighbours: DataFrame, group_cols: list[str], targets: list[str], dist: str = "dist"):
    """kNN regression: distance-weighted mean of each target (zero distance wins)."""
    w = Window.partitionBy(*group_cols)
    with_w = neighbours.withColumn("_zero", F.max((F.col(dist) == 0).cast("int")).over(w)).withColumn(
        "_w",
        F.when(F.col("_zero") == 1, (F.col(dist) == 0).cast("double")).otherwise(1.0 / F.col(dist)),
    )
    aggs = [(F.sum(F.col("_w") * F.col(t)) / F.sum("_w")).alias(t) for t in targets]
    return with_w.groupBy(*group_cols).agg(*aggs)
