"""Substring deduplication with FM-indexes: repeated 20-word passages of the whole corpus.

A window is ``window`` consecutive words of one document.  It is a repeat if the same
words also start earlier: in a document of smaller id, or before in the same document.

Routing.  Equal windows must meet without comparing everything with everything.  Each
window has an anchor: the k-word gram of smallest hash in it, the leftmost among equals.
Equal windows have equal anchors, and consecutive windows mostly share theirs; the
windows of one anchor are a segment (``window`` to ``2 * window - k`` words).  Anchors that
occur once in the corpus cannot hold a repeat and are left out.  The remaining segments
go to shards by their anchor's hash.  Segments of equal words collapse on the way, in
each task and again in the shard, where they are known by a 64-bit hash: only the earliest
is indexed, the others are repeats as a whole and leave the shard as they stream in, so whole
copies of texts never see the index.  An anchor with more than ``HOT`` occurrences (a very common phrase in many
contexts) is routed window by window, by the hash of the whole window, so no shard gets
more than a bounded number of different segments for one key.

Index.  A shard streams its segments in blocks of whole keys.  A block is one text in
order of document and position; its suffix array, Burrows-Wheeler transform and a wavelet
matrix of packed bits with block counts make an FM-index; the text and a table of range minima
stay beside it, bounded by the block.  Each segment is then streamed
against it: backward search extends a match to the left as long as the suffix range holds
an occurrence that starts earlier (range minimum over the suffix array), which is the
matching statistic of its end; ends move left until all windows are decided.  Matches of
``window`` words or more are reported as word intervals.

Words are compared by 64-bit hashes (48 bits of them travel to the shards, together with
the 64-bit hash of the whole segment).

Edge cases: null and blank texts have no words and lose none; texts shorter than a window
lose none; rows that repeat id and text are one document and share its result; rows
that repeat only the id are ordered by a hash of their text; a null id comes first; an
empty table gives an empty result; other columns are carried or ignored as the function says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomcast.llm.frames import bounded_rows, fresh, rows_out, utf8
from roomcast.llm.wordhash import U, gram_hashes, mix, span_hashes, word_hashes

WINDOW = 20
GRAM = 6
#: Occurrences of an anchor beyond which its windows are routed one by one.
HOT = 8192
#: Segments that one index holds at least, keys permitting.
BLOCK_SEGMENTS = 16384
GROUP_BYTES = 2 << 20
WORD_BYTES = 6


# -- anchors -----------------------------------------------------------------------------------


def segments(words: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor offset, anchor hash) of all segments; start counts words of the row."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, none, np.zeros(0, U)
    grams = gram_hashes(words, k)
    spread = window - k + 1
    starts = np.arange(len(words) - window + 1)
    row = np.searchsorted(first, starts, "right") - 1
    inside = starts + window <= first[row + 1]
    least = np.lib.stride_tricks.sliding_window_view(grams, spread).argmin(axis=1)
    starts, row, anchor = starts[inside], row[inside], (starts + least)[inside]
    if not len(starts):
        return none, none, none, none, np.zeros(0, U)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    return row[at], starts[at] - first[row[at]], count, anchor[at] - starts[at], grams[anchor[at]]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), _fp(text).alias("fp"), text.alias("text"))


def _fp(text: Column) -> Column:
    """Tells rows that share an id, or have none, apart: all 64 bits, as any number of rows may."""
    return F.xxhash64(text)


_PLACES = "h long, id long, fp long, place long"


def _places(keyed: DataFrame, window: int, k: int, full: bool) -> DataFrame:
    """Anchor hashes of all segments; ``full`` adds the document and the place, packed (see _unpack)."""
    names = ("h", "id", "fp", "place") if full else ("h",)
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_rows(batch, "text", GROUP_BYTES):
                words, first = word_hashes(*utf8(part.column("text")))
                row, start, count, offset, h = segments(words, first, window, k)
                out = [pa.array(h.view(np.int64))]
                if full:
                    take = pa.array(row)
                    out += [part.column("id").take(take), part.column("fp").take(take)]
                    out.append(pa.array(start << 13 | offset << 7 | count << 1))
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    return keyed.mapInArrow(run, _PLACES if full else "h long")


def _unpack(place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, anchor offset, windows, hot)."""
    return place >> 13, place >> 7 & 63, place >> 1 & 63, (place & 1).astype(bool)


# -- segments on their way to a shard ------------------------------------------------------------

_SENT = "key long, same long, id long, fp long, span long, words binary"
_SENT_SCHEMA = pa.schema([(n, pa.int64()) for n in ("key", "same", "id", "fp", "span")] + [("words", pa.binary())])


def _packed_words(words: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()
    return [raw[WORD_BYTES * a : WORD_BYTES * b] for a, b in zip(starts.tolist(), stops.tolist())]


def _unpacked_words(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words in a row and the number of words of each segment."""
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, WORD_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :WORD_BYTES] = raw
    return wide.view(U).ravel(), np.array([len(p) // WORD_BYTES for p in packed], np.int64)


def _send(part: pa.RecordBatch, window: int, k: int) -> pa.RecordBatch:
    """Rows for the shards from documents with their places; copies inside the batch become bare removals.

    Removals that touch in a document are one row.  It has no words; its key only spreads such rows over the shards, which pass them on.
    """
    words, first = word_hashes(*utf8(part.column("text")))
    places = part.column("places")
    row = np.repeat(np.arange(part.num_rows), np.diff(places.offsets.to_numpy()))
    start, offset, count, hot = _unpack(places.flatten().to_numpy(zero_copy_only=False))
    begin = first[row] + start
    grams = gram_hashes(words, k)
    key = grams[begin + offset]
    if hot.any():  # one row per window, keyed by the whole window
        each = np.repeat(np.flatnonzero(hot), count[hot])
        step = np.arange(len(each)) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
        row = np.concatenate([row[~hot], row[each]])
        begin = np.concatenate([begin[~hot], begin[each] + step])
        count = np.concatenate([count[~hot], np.ones(len(each), np.int64)])
        whole = mix(span_hashes(words, begin[len(begin) - len(each) :], begin[len(begin) - len(each) :] + window))
        key = np.concatenate([key[~hot], whole])
    end = begin + count + window - 1
    same = span_hashes(words, begin, end) ^ key
    start = begin - first[row]
    ids = part.column("id").to_numpy(zero_copy_only=False)
    null = pc.is_null(part.column("id")).to_numpy(zero_copy_only=False)
    ids = np.where(null, np.iinfo(np.int64).min, ids).astype(np.int64)
    fps = part.column("fp").to_numpy(zero_copy_only=False)
    order = np.lexsort((start, fps[row], ids[row], ~null[row], same, key))
    row, begin, end, start, key, same = (x[order] for x in (row, begin, end, start, key, same))
    again = np.zeros(len(row), bool)
    again[1:] = (key[1:] == key[:-1]) & (same[1:] == same[:-1])
    twin = again.copy()  # a repeated row of the same document: neither is earlier
    twin[1:] &= (row[1:] != row[:-1]) & (start[1:] == start[:-1]) & (ids[row[1:]] == ids[row[:-1]]) & (fps[row[1:]] == fps[row[:-1]])
    row, begin, end, start, key, same, again = (x[~twin] for x in (row, begin, end, start, key, same, again))
    stop = start + end - begin
    bare = _merged(row[again], start[again], stop[again])
    row, begin, end, start, stop, key, same = (x[~again] for x in (row, begin, end, start, stop, key, same))
    bare_key = mix(fps[bare[0]].view(U) + bare[1].astype(U))
    take = pa.array(np.concatenate([row, bare[0]]))
    span = np.concatenate([start << 31 | stop, bare[1] << 31 | bare[2]])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([key, bare_key]).view(np.int64)),
            pa.array(np.concatenate([same, bare_key]).view(np.int64)),
            part.column("id").take(take),
            part.column("fp").take(take),
            pa.array(span),
            pa.array([*_packed_words(words, begin, end), *[None] * len(bare[0])], pa.binary()),
        ],
        schema=_SENT_SCHEMA,
    )


def _merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, stop) of the unions of intervals that touch in one row."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    reach = np.maximum.accumulate((row << 32) + stop)  # rows do not touch: a place is below 2**31
    new = np.ones(len(row), bool)
    new[1:] = (row << 32)[1:] + start[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(row))[: int(new.sum())] - 1
    return row[new], start[new], reach[last] & 2**32 - 1


# -- the index -----------------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; separators are distinct and sort before words, in text order."""
    n = len(symbols)
    m = int(separators.sum())
    start = symbols + m
    start[separators] = np.arange(m)
    # rank of a suffix: first place of its group in the order so far
    order = np.argsort(start, kind="stable")
    ranked = start[order]
    head = np.ones(n, bool)
    head[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    sizes = np.diff(np.append(np.flatnonzero(head), n))
    open_ = np.repeat(sizes > 1, sizes)
    places = np.flatnonzero(open_)  # places of the order whose group is not resolved
    while len(places):
        at = order[places]
        # a group that is open never reaches over the end: separators differ
        then = rank[at + step]
        group = rank[at]
        by = np.argsort(group * (n + 1) + then, kind="stable")
        at, group, then = at[by], group[by], then[by]
        order[places] = at
        head = np.ones(len(at), bool)
        head[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        rank[at] = places[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        sizes = np.diff(np.append(np.flatnonzero(head), len(at)))
        places = places[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order


class WaveletMatrix:
    """Rank queries over a sequence: one packed bit vector per bit of a symbol, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels = max(1, int(n_symbols - 1).bit_length())
        n = len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view(U)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))[:-1]]).astype(np.int64))
            self.zeros.append(int(n - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        # where each symbol's run starts after the last level, so that rank is a difference
        self.base = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for j in range(self.levels):
            block = at >> 6
            below = (U(1) << (at & 63).astype(U)) - U(1)
            ones = self.counts[j][block] + np.bitwise_count(self.words[j][block] & below)
            high = (symbols >> (self.levels - 1 - j) & 1).astype(bool)
            at = np.where(high, self.zeros[j] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbols[i] stands before place at[i]."""
        return self._down(symbols, at) - self.base[symbols]


class FMIndex:
    """FM-index of word segments; ``words`` holds them in a row, ``lengths`` their sizes."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray) -> None:
        alphabet, ids = np.unique(words, return_inverse=True)
        m = len(lengths)
        n = len(words) + m
        self.stops = np.cumsum(lengths + 1) - 1  # place of the separator behind each segment
        self.starts = self.stops - lengths
        separators = np.zeros(n, bool)
        separators[self.stops] = True
        self.text = np.zeros(n, np.int64)
        self.text[~separators] = ids + 1
        self.n = n
        order = suffix_array(self.text, separators)
        self.bwt = WaveletMatrix(np.where(order == 0, 0, self.text[order - 1]), len(alphabet) + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=len(alphabet) + 1))])
        # range minima over the suffix array: table[j][i] covers 2**j places from i
        self.minima = [order.astype(np.int32)]
        while 2 ** len(self.minima) <= n:
            last, half = self.minima[-1], 2 ** (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))
        offsets = np.cumsum([0] + [len(t) for t in self.minima[:-1]])
        self.minima_at, self.minima = offsets, np.concatenate(self.minima)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after one more symbol to the left."""
        both = self.bwt.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        return self.first[symbols] + both[: len(lo)], self.first[symbols] + both[len(lo) :]

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least text place in each (non-empty) suffix range."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        base = self.minima_at[level]
        return np.minimum(self.minima[base + lo], self.minima[base + hi - (1 << level)])

    def repeats(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, from, to): maximal parts of ``least`` words or more that also start earlier in the text."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        which = np.flatnonzero(self.stops - self.starts >= least)
        end = self.stops[which].copy()
        at, lo, hi = end.copy(), np.zeros(len(which), np.int64), np.full(len(which), self.n)
        while len(which):
            before = at - 1
            new_lo, new_hi = self.extend(self.text[before], lo, hi)
            on = self.earliest(new_lo, new_hi) < before
            at, lo, hi = np.where(on, before, at), np.where(on, new_lo, lo), np.where(on, new_hi, hi)
            begin = self.starts[which]
            halt = ~on | (at == begin)
            long = halt & (end - at >= least)
            if long.any():
                found.append((which[long], (at - begin)[long], (end - begin)[long]))
            # the next end: windows that start at the match are decided, else one word to the left
            end = np.where(halt, np.where(long, at + least - 1, end - 1), end)
            done = halt & (end < begin + least)
            at, lo, hi = np.where(halt, end, at), np.where(halt, 0, lo), np.where(halt, self.n, hi)
            keep = ~done
            which, end, at, lo, hi = which[keep], end[keep], at[keep], lo[keep], hi[keep]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))


# -- shards --------------------------------------------------------------------------------------

_SPANS = "id long, fp long, span long"
_SPANS_SCHEMA = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("span", pa.int64())])


def _spans(table: pa.Table, at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Table:
    """Word intervals of rows of ``table``, packed as start * 2**31 + stop."""
    take = pa.array(at)
    return pa.Table.from_arrays(
        [table.column("id").take(take), table.column("fp").take(take), pa.array(start << 31 | stop)], schema=_SPANS_SCHEMA
    )


class _Leaders:
    """Takes rows sorted by key, same, id, fp, span; keeps the first of equal segments, lets go of all others at once."""

    def __init__(self) -> None:
        self.last: tuple | None = None  # key, same, id, null id, fp and begin of the leader that the stream is at

    def take(self, table: pa.Table) -> tuple[list[pa.Table], pa.Table]:
        """(spans of bare removals and of copies, the leaders among the rows)."""
        key, same, span, fp = (table.column(c).to_numpy() for c in ("key", "same", "span", "fp"))
        start, stop = span >> 31, span & 2**31 - 1
        bare = pc.is_null(table.column("words")).to_numpy()
        rest = np.flatnonzero(~bare)
        out = [_spans(table, np.flatnonzero(bare), start[bare], stop[bare])]
        if not len(rest):
            return out, table.slice(0, 0)
        ids = table.column("id").take(pa.array(rest))
        own = [key[rest], same[rest], ids.fill_null(0).to_numpy(), pc.is_null(ids).to_numpy(), fp[rest], start[rest]]
        new = np.ones(len(rest), bool)
        new[1:] = (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])
        new[0] = self.last is None or (own[0][0], own[1][0]) != self.last[:2]
        lead = np.cumsum(new)
        # what each row's leader has; number 0 is the one from before
        leaders = [np.concatenate([x[:1] if self.last is None else np.array([self.last[i]], x.dtype), x[new]]) for i, x in enumerate(own)]
        # copies of the leader are repeats as a whole, but not the same place of a repeated row
        twin = np.logical_and.reduce([x == led[lead] for x, led in zip(own[2:], leaders[2:])])
        copy = ~new & ~twin
        out.append(_spans(table, rest[copy], start[rest[copy]], stop[rest[copy]]))
        self.last = tuple(x[-1] for x in leaders)
        return out, table.take(pa.array(rest[new]))


def _solve(table: pa.Table, window: int) -> pa.Table | None:
    """Repeats among different segments of whole keys."""
    key, span, fp = (table.column(c).to_numpy() for c in ("key", "span", "fp"))
    ids = table.column("id")
    id_, null, begin = ids.fill_null(0).to_numpy(), pc.is_null(ids).to_numpy(), span >> 31
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    # a key with one segment has no other place for its windows
    group = np.cumsum(new_key) - 1
    heads = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(heads):
        return None
    heads = heads[np.lexsort((begin[heads], fp[heads], id_[heads], ~null[heads]))]
    words, lengths = _unpacked_words(table.column("words").take(pa.array(heads)).to_pylist())
    which, a, b = FMIndex(words, lengths).repeats(window)
    hit = heads[which]
    return _spans(table, hit, begin[hit] + a, begin[hit] + b)


def _shard(batches: Iterator[pa.RecordBatch], window: int, block: int) -> Iterator[pa.RecordBatch]:
    """Streams sorted rows; holds one batch and the different segments of some whole keys."""
    leaders, held, rows = _Leaders(), [], 0

    def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = _solve(table.combine_chunks(), window)
        if found is not None:
            yield from found.to_batches()

    for batch in batches:
        done, led = leaders.take(pa.Table.from_batches([batch]))
        for spans in done:
            yield from spans.to_batches()
        held.append(led)
        rows += led.num_rows
        if rows < block:
            continue
        table = pa.concat_tables(held).combine_chunks()
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield from solved(table.slice(0, cut))
            table = table.slice(cut)
        held, rows = [table], table.num_rows
    if rows:
        yield from solved(pa.concat_tables(held))


def repeats(
    docs: DataFrame, window: int = WINDOW, k: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, spans): for documents with repeats, the packed word intervals to remove (they may overlap)."""
    if not 0 <= window - k < 63 or k < 1:
        raise ValueError("window must be k to k + 62 words, k at least 1")  # a place has six bits for either
    keyed = _keyed(docs, id_col, text_col)
    often = _places(keyed, window, k, False).groupBy("h").count().filter("count > 1")
    # both sides are dealt by another key than the counts were, so that AQE can split a frequent anchor
    often = often.select(F.bitwise_not("h").alias("x"), (F.col("count") > hot).cast("long").alias("is_hot"))
    places = (
        _places(keyed, window, k, True)
        .join(often, F.bitwise_not("h") == F.col("x"))
        .groupBy("id", "fp")
        .agg(F.collect_set(F.col("place") + F.col("is_hot")).alias("places"))
    )
    found = places.select(F.col("id").alias("i"), F.col("fp").alias("f"), "places")
    with_text = keyed.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("fp") == F.col("f"))).select(
        "id", "fp", "text", "places"
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_rows(batch, "text", GROUP_BYTES):
                yield _send(part, window, k)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shard(batches, window, BLOCK_SEGMENTS)

    sent = with_text.mapInArrow(send, _SENT).repartition("key")
    spans = sent.sortWithinPartitions("key", "same", "id", "fp", "span").mapInArrow(solve, _SPANS)
    return spans.groupBy("id", "fp").agg(F.collect_list("span").alias("spans"))


# -- results -------------------------------------------------------------------------------------


def _kept_words(text: bytes, spans: np.ndarray | None) -> tuple[int, list[bytes]]:
    """Number of words, and the words outside the spans."""
    words = text.split()  # bytes split on 0x20 and 0x09-0x0D alone
    if spans is None or not len(spans):
        return len(words), words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, spans >> 31, 1)
    np.add.at(edges, spans & (2**31 - 1), -1)
    return len(words), list(compress(words, np.cumsum(edges[:-1]) == 0))


def digests(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row, given what ``repeats`` found."""
    found = spans.select(F.col("id").alias("i"), F.col("fp").alias("f"), "spans")
    joined = _keyed(docs, id_col, text_col).join(
        found, F.col("id").eqNullSafe(F.col("i")) & (F.col("fp") == F.col("f")), "left"
    )
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_rows(batch, "text", GROUP_BYTES):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                out = []
                for text, own in zip(texts, part.column("spans")):
                    n, kept = _kept_words(text or b"", own.values.to_numpy() if own.is_valid else None)
                    out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                yield rows_out(schema, [part.column("id"), *zip(*out)])

    ddl = "id long, n_words long, n_removed long, kept_sha256 string"
    return joined.select("id", "text", "spans").mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def strip(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeats cut out: texts with any are rejoined by single spaces, others stay as they are."""
    i, f, own = fresh(docs, "i", "f", "spans")
    found = spans.select(F.col("id").alias(i), F.col("fp").alias(f), F.col("spans").alias(own))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(text: str | None, own: np.ndarray | None) -> str | None:
            return text if own is None else b" ".join(_kept_words(text.encode(), own)[1]).decode()

        return pd.Series([one(t, s) for t, s in zip(texts, found)], dtype=object)

    key, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    joined = docs.join(found, key.eqNullSafe(F.col(i)) & (_fp(text) == F.col(f)), "left")
    return joined.withColumn(text_col, cut(F.col(text_col), F.col(own))).select(*docs.columns)
