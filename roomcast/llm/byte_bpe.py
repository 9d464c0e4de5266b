"""Byte-level BPE with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by the tokenizer's pattern.  Inside a pre-token the
lowest-ranked adjacent pair merges first, leftmost first among equals.  Candidate
pairs wait in buckets, one per merge rank, that hold positions of a doubly linked
list of pieces; a two-level bitmap over the ranks answers "which is the lowest
non-empty bucket" with two find-first-set steps.  A position whose pair has
changed since it was queued is stale and skipped.  A pre-token of n bytes costs
O(n log n) (the sort inside a bucket), so very long ones are no special case.

Documents are encoded where they lie (``mapInArrow``, no shuffle).  Equal short
pre-tokens of a task are merged once and kept in a memo of bounded size.

Nulls count as empty texts, empty texts have no tokens, equal rows give equal
results, empty tables give empty tables; other columns are never looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomcast.llm.frames import bounded_rows, rows_out

#: Pre-tokens in each of the two generations of a worker's memo (some 60 MB each), and the longest one kept (characters).
MEMO_ENTRIES = 300_000
MEMO_CHARS = 64
#: Text that is encoded at once (bytes).
SLICE = 2 << 20


class RankQueue:
    """Buckets of positions, one per merge rank, under a two-level bitmap.

    ``leaf[b]`` has a bit for every non-empty bucket of block ``b`` (2**SHIFT ranks),
    ``top`` a bit for every non-empty block.  An instance is empty again when ``merge``
    is done with it, and is used anew.
    """

    __slots__ = ("buckets", "leaf", "top")
    SHIFT = 8

    def __init__(self, n_ranks: int) -> None:
        self.leaf = [0] * ((n_ranks >> self.SHIFT) + 1)
        self.buckets: list[list[int] | None] = [None] * n_ranks
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets[rank]
        if bucket:
            bucket.append(at)
            return
        self.buckets[rank] = [at]
        block = rank >> 8
        self.leaf[block] |= 1 << (rank & 255)
        self.top |= 1 << block

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank with waiting positions, and those positions; only while ``top`` is not 0."""
        top = self.top
        block = (top & -top).bit_length() - 1
        word = self.leaf[block]
        rank = (block << 8) + (word & -word).bit_length() - 1
        word &= word - 1
        self.leaf[block] = word
        if not word:
            self.top = top & (top - 1)
        places, self.buckets[rank] = self.buckets[rank], None
        return rank, places


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Ids of one pre-token.

    The list of pieces is linked by ``end`` (where the piece that starts here stops) and ``before`` (start of the piece to
    the left); ``rank_at`` is the rank of the pair that starts here, so that a queued
    position whose pair has changed since is seen to be stale.
    """
    rank_of, push, pop = ranks.get, queue.push, queue.pop
    whole = rank_of(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank_at = [rank_of(piece[i : i + 2]) for i in range(n - 1)]
    rank_at.append(None)
    for i, rank in enumerate(rank_at):
        if rank is not None:
            push(rank, i)
    while queue.top:
        rank, places = pop()
        if len(places) > 1:
            places.sort()
        for i in places:
            if rank_at[i] != rank:
                continue
            j = end[i]
            stop = end[i] = end[j]
            rank_at[j] = None
            if stop < n:
                before[stop] = i
                grown = rank_at[i] = rank_of(piece[i : end[stop]])
                if grown is not None:
                    push(grown, i)
            else:
                rank_at[i] = None
            left = before[i]
            if left >= 0:
                grown = rank_at[left] = rank_of(piece[left:stop])
                if grown is not None:
                    push(grown, left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder over one rank file; ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(self.pieces, default=0) + 1)
        self.memo: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}

    def _merged(self, token: str) -> bytes:
        packed = self.aged.get(token)
        if packed is None:
            ids = merge(token.encode("utf-8"), self.ranks, self.queue)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo, self.aged = {}, self.memo
            self.memo[token] = packed
        return packed

    def encode(self, text: str) -> bytes:
        known, merged = self.memo.get, self._merged
        return b"".join([known(t) or merged(t) for t in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the text; an id that is not in the vocabulary raises KeyError."""
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id column, n_tokens, and ids (little-endian uint32, packed)."""
    kept = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    out = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in bounded_rows(batch, "text", SLICE):
                ids = [own.encode(t or "") for t in part.column("text").to_pylist()]
                yield rows_out(out, [part.column("key"), [len(x) // 4 for x in ids], ids])

    return kept.mapInArrow(run, "key long, n_tokens long, ids binary").withColumnRenamed("key", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (bytes) to the id, n_tokens and ids columns; null ids decode to empty."""
    kept = df.select(F.col(id_col).alias("key"), "n_tokens", F.col(ids_col).alias("ids"))
    out = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            texts = [own.decode(x or b"") for x in b.column("ids").to_pylist()]
            yield rows_out(out, [b.column("key"), b.column("n_tokens"), b.column("ids"), texts])

    schema = "key long, n_tokens long, ids binary, decoded binary"
    return kept.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def round_trip(
    df: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encodes and decodes every row: id column, n_tokens, lower-case hex digests of ids and decoded bytes.

    Ids go from the encoder to the decoder inside one task; they leave it only with
    ``with_ids``, as a last column of packed little-endian uint32.
    """
    kept = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    fields = [("key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)

        def digests(text: str | None) -> tuple:
            ids = own.encode(text or "")
            found = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest())
            return (*found, ids) if with_ids else found

        for batch in batches:
            for part in bounded_rows(batch, "text", SLICE):
                found = [digests(t) for t in part.column("text").to_pylist()]
                yield rows_out(out, [part.column("key"), *zip(*found)])
        pa.default_memory_pool().release_unused()

    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return kept.mapInArrow(run, schema).withColumnRenamed("key", id_col)
