"""Exact k best inner products by dual-tree search over cover trees.

Vectors are cut into blocks, queries into chunks, both of bounded size by a hash of
their ids, and every chunk meets every block (the query set is a stated part of the
rows).  Inside a pair of groups, a cover tree indexes the block and another one the
chunk: a node has a centre, which is one of its points, and the radius that covers
its points; its children's centres are chosen farthest first, so they lie further apart than
any point lies from its own.  The search walks both trees together.  A query node q and a data
node x can reach a score of at most  <q, x> + Rq |x| + Rx |q| + Rq Rx;  if that is below the
worst kth score of q's queries, the pair is pruned.  Equal scores are kept for the tie rule
(smaller id).  Leaves hold some hundred points: what is left of a query leaf and of the
data leaves that it still needs is one matrix product.  Only each query's k best per
block leave a task, and a window over them (with Spark's limit before the shuffle) gives the result.

Scores are exact.  Products are 64-bit floats; where the norms say that one may not be
exact (2**53 or more), the error bound keeps it a candidate, and the candidates that matter, and no others,
are computed again in Python integers.  A few large vectors cost no more than themselves.

Edge cases: vectors that are null, or hold a null or a non-finite component, take no
part, nor do rows with a null id; only vectors of equal length meet; rows that repeat
id and vector count once, rows that repeat only the id are candidates of their own and
share the id's result as queries; a score beyond 64 bits counts as the nearest 64-bit
number (ties by id, as always); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from itertools import starmap
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Children of a node, and points of a leaf of the data tree and of the query tree.
FANOUT = 8
DATA_LEAF, QUERY_LEAF = 512, 256
#: Data leaves that one product takes.
FRONT = 4
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1
RESULT = "query_id long, vec_id long, score long"
_RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class CoverTree:
    """Cover tree of the rows of ``points``; nodes are numbered from the root, children after their parent."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.points, self.leaf = points, leaf
        with np.errstate(over="ignore", invalid="ignore"):
            squares = np.einsum("ij,ij->i", points, points)
            self.norms = np.sqrt(squares)
            self.centre: list[int] = []
            self.radius: list[float] = []
            self.members: list[np.ndarray] = []
            self.children: list[list[int]] = []
            if len(points):
                self._grow(squares)
        self.centre_norm = self.norms[self.centre] if self.centre else np.zeros(0)
        self.centres = points[self.centre] if self.centre else points[:0]
        self.radii = np.array(self.radius)

    def _add(self, centre: int, members: np.ndarray, far: np.ndarray) -> int:
        self.centre.append(centre)
        self.members.append(members)
        # a hair more than the rounded distance, so that the ball holds its points
        self.radius.append(float(far.max()) * (1 + 1e-9) if len(far) else 0.0)
        self.children.append([])
        return len(self.centre) - 1

    def _grow(self, squares: np.ndarray) -> None:
        def distances(centre: int, rows: np.ndarray) -> np.ndarray:
            d2 = squares[rows] + squares[centre] - 2 * (self.points[rows] @ self.points[centre])
            # the difference of large squares is known to their rounding only
            slack = 1e-14 * (squares[rows] + squares[centre])
            return np.sqrt(np.nan_to_num(np.maximum(d2, 0) + slack, nan=np.inf, posinf=np.inf))

        rows = np.arange(len(self.points))
        todo = [self._add(0, rows, distances(0, rows))]
        while todo:
            node = todo.pop()
            rows = self.members[node]
            if len(rows) <= self.leaf:
                continue
            nearest = distances(self.centre[node], rows)
            owner = np.zeros(len(rows), np.int64)
            centres = [self.centre[node]]
            while len(centres) < FANOUT:
                far = int(nearest.argmax())
                d = distances(int(rows[far]), rows)
                closer = d < nearest
                closer[far] = True
                owner[closer], nearest[closer] = len(centres), d[closer]
                centres.append(int(rows[far]))
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
            sizes = np.diff(cuts)
            if sizes.max() == len(rows):  # copies of one point: no child is smaller
                continue
            for j in np.flatnonzero(sizes):
                mine = order[cuts[j] : cuts[j + 1]]
                child = self._add(centres[j], rows[mine], nearest[mine])
                self.children[node].append(child)
                todo.append(child)


class DualSearch:
    """k best data rows of every query row; own ids do not count."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> None:
        self.q, self.x = CoverTree(queries, QUERY_LEAF), CoverTree(data, DATA_LEAF)
        self.query_ids, self.data_ids, self.k = query_ids, data_ids, k
        self.scores = np.full((len(queries), k), LEAST, np.int64)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.found = np.zeros(len(queries), np.int64)
        self.error = 4 * (queries.shape[1] + 2) * 2.0**-53
        if len(queries) and len(data):
            with np.errstate(over="ignore", invalid="ignore"):
                self._visit(0, np.zeros(1, np.int64))

    def _bounds(self, q: int, xs: np.ndarray) -> np.ndarray:
        """Greatest score that a point below q can have with one below each of xs, rounded up."""
        rq, nq = self.q.radii[q], self.q.centre_norm[q]
        rx, nx = self.x.radii[xs], self.x.centre_norm[xs]
        most = self.x.centres[xs] @ self.q.centres[q] + rq * nx + rx * nq + rq * rx
        most = most + 1e-9 * (np.abs(most) + 1) + self.error * nq * nx
        return np.nan_to_num(most, nan=np.inf, posinf=np.inf)

    def _worst(self, rows: np.ndarray) -> np.ndarray:
        """What a score must reach to be among the k best of each query, rounded down."""
        kth = np.nextafter(self.scores[rows, -1].astype(np.float64), -np.inf)
        return np.where(self.found[rows] == self.k, kth, -np.inf)

    def _kept(self, q: int, xs: np.ndarray) -> np.ndarray:
        return xs[self._bounds(q, xs) >= self._worst(self.q.members[q]).min()]

    def _inner(self, xs: np.ndarray) -> np.ndarray:
        return np.array([bool(self.x.children[x]) for x in xs], bool)

    def _below(self, xs: np.ndarray) -> np.ndarray:
        return np.array([c for x in xs for c in self.x.children[x]], np.int64)

    def _visit(self, q: int, xs: np.ndarray) -> None:
        if self.q.children[q]:
            big = self._inner(xs) & (self.x.radii[xs] >= self.q.radii[q])
            while big.any():  # the data side goes down first, to the size of the query node
                xs = self._kept(q, np.concatenate([xs[~big], self._below(xs[big])]))
                big = self._inner(xs) & (self.x.radii[xs] >= self.q.radii[q])
            for child in self.q.children[q]:
                kept = self._kept(child, xs)
                if len(kept):
                    self._visit(child, kept)
            return
        while len(xs):  # a query leaf: the most promising data nodes first
            bounds = self._bounds(q, xs)
            order = np.argsort(-bounds, kind="stable")
            xs = xs[order][bounds[order] >= self._worst(self.q.members[q]).min()]
            front, xs = xs[:FRONT], xs[FRONT:]
            inner = self._inner(front)
            if (~inner).any():
                self._compare(self.q.members[q], np.concatenate([self.x.members[x] for x in front[~inner]]))
            if inner.any():
                xs = np.concatenate([self._below(front[inner]), xs])

    def _exact(self, q: int, x: int) -> int:
        score = sum(starmap(mul, zip(map(int, self.q.points[q].tolist()), map(int, self.x.points[x].tolist()))))
        return min(max(score, LEAST), MOST)

    def _compare(self, mine: np.ndarray, rows: np.ndarray) -> None:
        """Scores of some queries with some data rows, merged into the k best."""
        product = self.q.points[mine] @ self.x.points[rows].T
        size_q, size_x = self.q.norms[mine], self.x.norms[rows]
        wide = not size_q.max() * size_x.max() < EXACT
        reach = product
        if wide:
            sizes = size_q[:, None] * size_x[None, :]
            unsure = ~(sizes < EXACT)
            reach = np.where(unsure, np.nan_to_num(product + self.error * sizes, nan=np.inf, posinf=np.inf), product)
        hit = (reach >= self._worst(mine)[:, None]) & (self.query_ids[mine][:, None] != self.data_ids[rows][None, :])
        i, j = np.nonzero(hit)
        if not len(i):
            return
        if wide:
            sure = ~unsure[i, j]
            new = np.zeros(len(i), np.int64)
            new[sure] = product[i[sure], j[sure]].astype(np.int64)
            for at in np.flatnonzero(~sure):
                new[at] = self._exact(mine[i[at]], rows[j[at]])
        else:
            new = product[i, j].astype(np.int64)
        touched = np.unique(i)
        old = np.arange(self.k)[None, :] < self.found[mine[touched]][:, None]
        at = np.concatenate([np.broadcast_to(touched[:, None], old.shape)[old], i])
        scores = np.concatenate([self.scores[mine[touched]][old], new])
        ids = np.concatenate([self.ids[mine[touched]][old], self.data_ids[rows[j]]])
        order = np.lexsort((ids, ~scores, at))  # ~s falls as s grows, and does not overflow
        at, scores, ids = at[order], scores[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        best = rank < self.k
        self.scores[mine[at[best]], rank[best]] = scores[best]
        self.ids[mine[at[best]], rank[best]] = ids[best]
        self.found[mine[touched]] = np.minimum(self.k, np.bincount(at, minlength=len(mine))[touched])


def _matrix(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = group.column("id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.astype(np.float64).reshape(len(ids), -1)


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(id, v, dim): floor(scale * component) of every usable vector as whole doubles, repeated rows once."""
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    raw = F.transform(F.col(vector_col), lambda x: x.cast("double"))

    def whole(x):
        # from 2**52 on a double is whole; beyond its range the largest one stands in, whose scores are at the 64-bit limits
        y = F.least(F.lit(1.7e308), F.greatest(F.lit(-1.7e308), scale * x))
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return (
        df.select(F.col(id_col).cast("long").alias("id"), raw.alias("raw"))
        .filter(F.col("id").isNotNull() & F.col("raw").isNotNull() & finite)
        .select("id", F.transform("raw", whole).alias("v"), F.size("raw").alias("dim"))
        .distinct()
    )


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = 8192, chunk_rows: int = 8192
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best ``vectors`` for each of ``queries`` (both as ``whole_vectors``)."""
    n_blocks = max(1, -(-vectors.count() // block_rows))
    n_chunks = max(1, -(-queries.count() // chunk_rows))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        )

    data = dealt(vectors, "block", n_blocks, "chunk", n_chunks)
    asked = dealt(queries, "chunk", n_chunks, "block", n_blocks)

    def search(asked_here: pa.Table, data_here: pa.Table) -> pa.Table:
        if not asked_here.num_rows or not data_here.num_rows:
            return _RESULT.empty_table()
        query_ids, q = _matrix(asked_here)
        data_ids, x = _matrix(data_here)
        best = DualSearch(q, query_ids, x, data_ids, k)
        hit = np.arange(k)[None, :] < best.found[:, None]
        return pa.Table.from_arrays(
            [
                pa.array(np.broadcast_to(query_ids[:, None], hit.shape)[hit]),
                pa.array(best.ids[hit]),
                pa.array(best.scores[hit]),
            ],
            schema=_RESULT,
        )

    keys = ["dim", "chunk", "block"]
    partial = asked.groupBy(keys).cogroup(data.groupBy(keys)).applyInArrow(search, RESULT)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
