"""Packing of tokenized documents into fixed windows by best-fit decreasing.

A document's ids end with an end id.  A document longer than a window is first cut
into full windows; what is left of it, and every shorter document, is one piece that is
never cut again.  Pieces of a block come longest first; each goes to the open window
whose remaining capacity is the least that still holds it.  A segment tree indexed by
remaining capacity finds that window: a leaf is a capacity, a node tells whether any
window below it is open, and the search goes to the leftmost open leaf at or right of
the piece's length.  Without such a leaf the piece opens a window.

Scale: documents are tokenized where they lie.  Only piece lengths are shuffled, dealt
by a hash of a key that is unique to every piece, so copies of one text spread
like all others; a block holds about ``block_pieces`` pieces whatever the table's size, is
sorted by Spark and streamed through one tree.  A task's memory is the open windows of a block.
More blocks cost little padding: each leaves one window that is far from full.

The tokenizer sees each distinct stretch between spaces and line feeds once per task
(a memo of bounded size): its pre-tokens never span those characters.  Strings that look
like special tokens count as ordinary text.

Edge cases: null and empty texts are the end id alone; null ids, repeated ids and
repeated rows are documents of their own; ties go by the piece's key; a sequence is padded
to the window unless its length is a power of two; an empty table gives no pieces;
other columns are never looked at.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roomcast.llm.frames import bounded_rows, rows_out

#: Entries after which a task's memo starts anew, and the longest stretch it keeps (characters).
MEMO_ENTRIES = 400_000
MEMO_CHARS = 48
#: Text that is tokenized at once (bytes).
SLICE = 4 << 20

#: Letters that are one code point and one pre-token with their neighbours, and marks that end a stretch behind them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = ".,"
_PLAIN = re.compile(f"[{_LETTERS}]+[{_MARKS}]?").fullmatch


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return own


class Stretches:
    """Token ids of texts, stretch by stretch; ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        own = self.tokenizer = _tokenizer(path)
        # what the library's normalizer and pre-tokenizer make of a letter that stands among plain letters
        letters = [c for c in map(chr, range(256)) if _PLAIN(c)]
        self.spelled = {ord(c): own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(c))[0][0] for c in letters}
        self.marks = {m: self._packed(own.encode(m, add_special_tokens=False).ids) for m in _MARKS}
        self.memo: dict[str, bytes] = {"": b""}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, parts: set[str]) -> None:
        """Notes the ids of new stretches.  Words of plain letters go to the library's merges, others through all of it."""
        memo, spelled, merges, rest = self.memo, self.spelled, self.tokenizer.model.tokenize, []
        for p in parts:
            if _PLAIN(p):
                mark = self.marks.get(p[-1])
                word = p if mark is None else p[:-1]
                ids = memo.get(word)
                if ids is None:
                    ids = memo[word] = self._packed([t.id for t in merges(word.translate(spelled))])
                if mark is not None:
                    memo[p] = ids + mark
            else:
                rest.append(p)
        for p, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            memo[p] = self._packed(found.ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        memo = self.memo
        new = set().union(*cut).difference(memo)
        self._learn(new)
        out = [b"".join([memo[p] for p in parts]) for parts in cut]
        if len(memo) > MEMO_ENTRIES:
            self.memo = {"": b""}
        else:
            for p in new:
                if len(p) > MEMO_CHARS:
                    del memo[p]
        return out


def cut(
    df: DataFrame,
    tokenizer: str,
    window: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids (packed little-endian uint32)."""
    kept = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long = pa.int64()
    out = pa.schema([("doc_id", long), ("start", long), ("length", long), ("doc_tokens", long), ("ids", pa.binary())])
    end, step = int(end_id).to_bytes(4, "little"), 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Stretches(tokenizer)
        for batch in batches:
            for part in bounded_rows(batch, "text", SLICE):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), own.encode(part.column("text").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, len(ids), step):
                        piece = ids[at : at + step]
                        rows.append((doc, at // 4, len(piece) // 4, n, piece))
                yield rows_out(out, zip(*rows))

    return kept.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


class CapacityTree:
    """Segment tree over remaining capacities 0 .. most; a leaf holds the open windows of its capacity."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.open = bytearray(2 * self.size)
        self.windows: list[list] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node, seen = capacity + self.size, self.open
        while node and not seen[node]:
            seen[node] = 1
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that an open window has."""
        seen, node = self.open, need + self.size
        while not seen[node]:
            # up to the first ancestor with a right neighbour, which covers the next larger capacities
            while node & 1:
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.size:
            node = 2 * node + (not seen[2 * node])
        return node - self.size

    def take(self, capacity: int) -> int:
        """One open window of this capacity, removed from the tree."""
        windows = self.windows[capacity]
        window = windows.pop()
        if not windows:
            node, seen = capacity + self.size, self.open
            seen[node] = 0
            node >>= 1
            while node and not (seen[2 * node] or seen[2 * node + 1]):
                seen[node] = 0
                node >>= 1
        return window


class BestFit:
    """Best-fit packer of one block; pieces must come longest first."""

    def __init__(self, window: int) -> None:
        self.window, self.tree, self.opened = window, CapacityTree(window), 0

    def place(self, length: int) -> tuple[int, int]:
        """(number of the window, offset in it) for a piece."""
        capacity = self.tree.tightest(length)
        if capacity is None:
            number, capacity = self.opened, self.window
            self.opened += 1
        else:
            number = self.tree.take(capacity)
        if capacity > length:  # a full window is closed
            self.tree.put(capacity - length, number)
        return number, self.window - capacity


def pack(
    pieces: DataFrame, window: int = 2048, block_pieces: int = 8192, length_col: str = "length", key_col: str = "piece_key"
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``window`` tokens.

    ``key_col`` must be unique and the same whenever the rows are read (write them first).
    """
    n = pieces.count()
    blocks = max(1, -(-n // block_pieces))
    block = F.pmod(F.xxhash64(F.lit("block"), key_col), F.lit(blocks))
    rows = (
        pieces.select(key_col, F.col(length_col).alias("pk_length"), block.alias("pk_block"))
        .repartition("pk_block")
        .sortWithinPartitions("pk_block", F.desc("pk_length"), key_col)
    )
    out = pa.schema([("key", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, current = None, None
        for batch in batches:
            placed = []
            for length, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if own != current:
                    packer, current = BestFit(window), own
                number, offset = packer.place(length)
                placed.append(((own << 32) + number, offset))
            if placed:
                yield rows_out(out, [batch.column(0), *zip(*placed)])

    found = rows.mapInArrow(run, "key long, sequence_id long, offset long")
    return pieces.join(found.withColumnRenamed("key", key_col), key_col)


def sequences(packed: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """The token sequences: sequence_id, tokens (array of int, padded), n_tokens, starts (offsets of the pieces).

    ``packed`` holds sequence_id, offset and ids; a sequence whose length is a power of two is not padded.
    """
    rows = packed.select("sequence_id", "offset", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    out = pa.schema(
        [("sequence_id", pa.int64()), ("tokens", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("starts", pa.list_(pa.int64()))]
    )

    def built(sequence: int, parts: list[bytes], starts: list[int]) -> tuple:
        ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
        n = len(ids)
        whole = ids if n & (n - 1) == 0 else np.pad(ids, (0, window - n), constant_values=pad_id)
        return sequence, whole, n, starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, starts = None, [], []
        for batch in batches:
            ready = []
            for sequence, offset, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if sequence != current:
                    if parts:
                        ready.append(built(current, parts, starts))
                    current, parts, starts = sequence, [], []
                parts.append(ids)
                starts.append(offset)
            if ready:
                yield rows_out(out, zip(*ready))
        if parts:
            yield rows_out(out, zip(built(current, parts, starts)))

    return rows.mapInArrow(run, "sequence_id long, tokens array<int>, n_tokens long, starts array<long>")
