"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its five-word shingles (a text of one to four words is one
shingle).  Weights are counts, discretised to whole levels and grouped in dyadic blocks
[0, 1), [1, 2), [2, 4), ...  Each (shingle, block) drives a Poisson process of points
(time, signature slot, level); a point counts if its level lies below the shingle's count.
A slot's signature is its earliest counting point, so two texts agree in a slot with a
probability equal to their weighted Jaccard similarity.  Points of a process come in
order of time, and a process stops as soon as it is later than every slot's minimum,
so a text costs about  shingles + slots * log(slots)  points.

``bands`` bands of ``slots / bands`` slots make candidates: with 32 bands of 4 slots a
pair of similarity 0.8 is missed with a probability of 5e-8.  Candidates are verified
exactly on the whole texts.

Large groups.  Texts of equal words collapse to one numbered node before banding, known
by a 128-bit hash of the words, whatever ids their rows have; the first row (least id, null
last, then a hash of the text) lends its text.  In a bucket all members are first compared with one leader, the text that
shares most with others; a group of copies of one text costs one comparison per member.
Buckets whose members are then still in different classes are compared member by
member, in pairs of blocks of bounded size, by one matrix product each, so no link
between classes is lost and no pair is ever a row.  Classes are connected components of
verified links.

Edge cases: null, empty and blank texts are alone in their class; equal rows are in one
class; ties cannot occur (classes are named by their least id that is not null); rows that
share an id are classed each by its own text, so an id with several texts may name several
classes; rows with a null id are compared like all others, and a class without any id is
named null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomcast.llm.components import components
from roomcast.llm.frames import bounded_rows, rows_out, utf8
from roomcast.llm.wordhash import U, gram_hashes, mix, span_hashes, word_hashes
from roomcast.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
SLOTS, BANDS = 128, 32
#: Bytes of text whose signatures are computed together; texts in a block of the exact rest, units per product.
GROUP_BYTES = 1 << 20
BLOCK_ROWS = 384
UNITS_AT_ONCE = 4096
_ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(words: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one text, sorted, and their counts."""
    if not len(words):
        return np.zeros(0, U), np.zeros(0, np.int64)
    if len(words) < k:
        return span_hashes(words, np.zeros(1, np.int64), np.array([len(words)])), np.ones(1, np.int64)
    return np.unique(gram_hashes(words, k), return_counts=True)


def _unit(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from 64-bit hashes."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` earliest times per (hashes, counts); inf for an empty set."""
    out = np.full(len(sets) * slots, np.inf)
    if not sets:
        return out.reshape(0, slots)
    doc = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    element = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    # one process per (element, dyadic block of levels that starts below the weight)
    parts, block = [], 0
    while len(element):
        begin, length = (0, 1) if block == 0 else (1 << (block - 1), 1 << (block - 1))
        seed = mix(element + U(block) * _ODD[0])
        parts.append((doc, seed, weight, np.full(len(doc), begin), np.full(len(doc), length)))
        block += 1
        more = weight > (1 << (block - 1))
        doc, element, weight = doc[more], element[more], weight[more]
    if not parts:
        return out.reshape(len(sets), slots)
    doc, seed, weight, begin, length = (np.concatenate(x) for x in zip(*parts))
    time, drawn = np.zeros(len(doc)), 0
    while len(doc):
        g = int(np.clip(16384 // len(doc), 1, 64))  # points per process in this round
        numbers = (np.arange(drawn, drawn + g, dtype=U) + U(1)) * _ODD[1]
        first = mix(seed[:, None] + numbers[None, :])
        second = mix(first + _ODD[2])
        steps = -np.log(_unit(first)) / length[:, None]
        steps[:, 0] += time
        times = np.cumsum(steps, axis=1) if g > 1 else steps
        slot = (second & U(0xFFFFFFFF)) % U(slots)
        level = begin[:, None] + ((second >> U(32)).astype(np.float64) * 2.0**-32 * length[:, None]).astype(np.int64)
        counts = level < weight[:, None]
        at = (doc[:, None] * slots + slot.astype(np.int64))[counts]
        np.minimum.at(out, at, times[counts])
        latest = out.reshape(len(sets), slots).max(axis=1)
        time, drawn = times[:, -1], drawn + g
        on = time < latest[doc]
        if not on.all():
            doc, seed, weight, begin, length, time = (x[on] for x in (doc, seed, weight, begin, length, time))
    return out.reshape(len(sets), slots)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(texts, bands) hashes; bands of different numbers never share a key by construction of the seed."""
    n, slots = signature.shape
    bits = signature.view(U).reshape(n, bands, slots // bands)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U) * _ODD[0])[None, :], (n, bands)).copy()
    for j in range(slots // bands):
        key = mix(key * _ODD[1] + bits[:, :, j])
    return key


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that, with the id, tell rows apart."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    t1, t2 = text_key(text)
    return docs.select(F.col(id_col).cast("long").alias("id"), t1.alias("t1"), t2.alias("t2"), text.alias("text"))


def _sketches(docs: DataFrame, id_col: str, text_col: str, slots: int, bands: int) -> DataFrame:
    """(id, t1, t2, w1, w2, keys): text key, 128-bit hash of the words, band keys; null w1, w2 and no keys without words."""
    schema = pa.schema([(n, pa.int64()) for n in ("id", "t1", "t2", "w1", "w2")] + [("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_rows(batch, "text", GROUP_BYTES):
                words, first = word_hashes(*utf8(part.column("text")))
                sets = [shingles(words[a:b]) for a, b in zip(first[:-1], first[1:])]
                keys = band_keys(signatures(sets, slots), bands).view(np.int64)
                some = first[1:] > first[:-1]
                w1 = span_hashes(words, first[:-1], first[1:]) if len(words) else np.zeros(len(sets), U)
                w2 = span_hashes(mix(words + _ODD[2]), first[:-1], first[1:]) if len(words) else w1
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("id", "t1", "t2")),
                        pa.array(w1.view(np.int64), mask=~some),
                        pa.array(w2.view(np.int64), mask=~some),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)),
                            pa.array(keys[some].ravel()),
                        ),
                    ],
                    schema=schema,
                )

    ddl = "id long, t1 long, t2 long, w1 long, w2 long, keys array<long>"
    return _keyed(docs, id_col, text_col).mapInArrow(run, ddl)


def overlap(pairs: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Those of the pairs (a, b) whose texts' shingle multisets overlap by ``threshold`` or more."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    least = Fraction(str(threshold))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for outer in bounded_rows(batch, "text_a", GROUP_BYTES):
                for part in bounded_rows(outer, "text_b", GROUP_BYTES):
                    sides = [word_hashes(*utf8(part.column(c))) for c in ("text_a", "text_b")]
                    close = np.zeros(part.num_rows, bool)
                    for i in range(part.num_rows):
                        (ha, ca), (hb, cb) = (shingles(w[f[i] : f[i + 1]]) for w, f in sides)
                        _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                        shared = int(np.minimum(ca[ia], cb[ib]).sum())
                        union = int(ca.sum() + cb.sum()) - shared
                        close[i] = union > 0 and shared * least.denominator >= least.numerator * union
                    yield rows_out(schema, [part.column(c).filter(pa.array(close)) for c in ("a", "b")])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _units(words: np.ndarray) -> np.ndarray:
    """The shingle multiset as a set: one hash per (shingle, occurrence)."""
    hashes, counts = shingles(words)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(hashes, counts) + nth.astype(U) * _ODD[0])


def block_links(ids: np.ndarray, group: np.ndarray, units: list[np.ndarray], least: Fraction) -> list[tuple[int, int]]:
    """Links between texts of different groups, as many as it takes to join the groups that any link joins.

    All pairs of the block are compared at once: overlaps are products of the incidence
    of those units that two texts or more have, a slice of units at a time.
    """
    n = len(ids)
    owner = np.repeat(np.arange(n), [len(u) for u in units])
    if not len(owner):
        return []
    _, unit, often = np.unique(np.concatenate(units), return_inverse=True, return_counts=True)
    shared = often[unit] > 1
    owner, (_, unit) = owner[shared], np.unique(unit[shared], return_inverse=True)
    order = np.argsort(unit, kind="stable")
    owner, unit = owner[order], unit[order]
    overlap_of = np.zeros((n, n))
    for lo in range(0, int(unit[-1]) + 1 if len(unit) else 0, UNITS_AT_ONCE):
        i, j = np.searchsorted(unit, (lo, lo + UNITS_AT_ONCE))
        present = np.zeros((n, UNITS_AT_ONCE), np.float32)
        present[owner[i:j], unit[i:j] - lo] = 1
        overlap_of += present @ present.T
    size = np.array([len(u) for u in units], np.float64)
    union = size[:, None] + size[None, :] - overlap_of
    close = (overlap_of * least.denominator >= least.numerator * union) & (union > 0)
    close &= group[:, None] != group[None, :]
    root = {int(g): int(g) for g in group}

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    found = []
    for i, j in zip(*np.nonzero(np.triu(close))):
        x, y = find(int(group[i])), find(int(group[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return found


def _rest_links(
    members: DataFrame, roots: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str
) -> DataFrame:
    """Links (a, b) between members of one bucket that are still in different classes.

    Buckets with more than one class are joined to families (buckets that share a member
    overlap a lot); a family is cut into blocks of about ``BLOCK_ROWS`` texts, and each pair
    of blocks is one group.
    """
    classed = members.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("class"))
    several = classed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("id").alias("a"))
    rest = materialize(
        classed.join(several.filter("lo < hi").select(F.col("key").alias("k"), "a"), F.col("key") == F.col("k"))
        .select("id", "class", "a")
        .distinct()
    )
    families = components(rest.filter("a < id").select("a", F.col("id").alias("b")))
    placed = (
        rest.select("id", "class")
        .distinct()
        .join(families.select(F.col("id").alias("i"), F.col("root").alias("of")), F.col("id") == F.col("i"), "left")
        .select("id", "class", F.coalesce("of", "id").alias("family"))
    )
    sizes = placed.groupBy(F.col("family").alias("f")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (
        placed.join(sizes, F.col("family") == F.col("f"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", "class", "family", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    )
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text"))
    least = Fraction(str(threshold))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        units = []
        for batch in group.select(["text"]).to_batches():
            for part in bounded_rows(batch, "text", GROUP_BYTES):
                words, first = word_hashes(*utf8(part.column("text")))
                units += [_units(words[a:b]) for a, b in zip(first[:-1], first[1:])]
        found = block_links(group.column("id").to_numpy(), group.column("class").to_numpy(), units, least)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 2, schema=schema)

    grouped = dealt.join(texts, F.col("id") == F.col("i")).select("id", "class", "family", "p", "q", "text")
    return grouped.groupBy("family", "p", "q").applyInArrow(compare, "a long, b long").filter("a < b").distinct()


def _same_words() -> Column:
    return (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2"))


def _rooted(
    docs: DataFrame, threshold: float, slots: int, bands: int, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """The sketches, and (x1, x2, first, root) of every node: hash of its words, its first row and its class."""
    sketches = materialize(_sketches(docs, id_col, text_col, slots, bands))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "t1", "t2")).alias("first")
    copies = sketches.filter("w1 is not null").groupBy(F.col("w1").alias("x1"), F.col("w2").alias("x2")).agg(first)
    nodes = materialize(copies.withColumn("node", F.monotonically_increasing_id()))  # written: the numbers stay
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    # band rows of the text that stands for its copies; rows that repeat it do not repeat them
    rows = sketches.join(nodes, _same_words() & is_first).select(F.col("node").alias("id"), F.explode("keys").alias("key")).distinct()
    buckets = rows.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"))
    buckets = buckets.filter("least < most").select(F.col("key").alias("k"), "n")
    members = materialize(rows.join(buckets, F.col("key") == F.col("k")).select("key", "id", "n"))
    # the text that copies were made from shares more buckets with them than they do with each other
    known = members.groupBy("id").agg(F.sum("n").alias("known"))
    texts = materialize(
        _keyed(docs, id_col, text_col)
        .join(nodes.join(known.select(F.col("id").alias("node")), "node"), is_first)
        .select(F.col("node").alias("id"), "text")
        .dropDuplicates(["id"])
    )
    known = known.select(F.col("id").alias("i"), "known")
    leads = (
        members.join(known, F.col("id") == F.col("i"))
        .groupBy("key")
        .agg(F.min(F.struct((-F.col("known")).alias("o"), "id")).alias("lead"))
        .select(F.col("key").alias("k"), F.col("lead.id").alias("lead"))
    )
    pairs = materialize(
        members.join(leads, (F.col("key") == F.col("k")) & (F.col("id") != F.col("lead")))
        .select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
        .distinct()
    )
    links = materialize(overlap(pairs, texts, threshold, "id", "text"))
    rest = _rest_links(members.select("key", "id"), components(links), texts, threshold, "id", "text")
    roots = components(links.unionByName(rest))
    joined = nodes.join(roots, F.col("node") == F.col("id"), "left")
    return sketches, joined.select("x1", "x2", "first", F.coalesce("root", "node").alias("root"))


def classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    slots: int = SLOTS,
    bands: int = BANDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, class_id) of every row; class_id is the least id of the class."""
    sketches, rooted = _rooted(docs, threshold, slots, bands, id_col, text_col)
    names = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first.id").alias("name"))
    named = rooted.join(names, F.col("root") == F.col("r")).select("x1", "x2", "name")
    return sketches.select("id", "w1", "w2").join(named, _same_words(), "left").select(
        F.col("id").alias(id_col), F.when(F.col("w1").isNull(), F.col("id")).otherwise(F.col("name")).alias("class_id")
    )


def firsts(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    slots: int = SLOTS,
    bands: int = BANDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, t1, t2, n): id and text key of the first row of each class (least id, null last, then text key), and how many rows have both.

    A text without words is a class for each id.
    """
    sketches, rooted = _rooted(docs, threshold, slots, bands, id_col, text_col)
    rows = sketches.groupBy("id", "t1", "t2").agg(F.count("*").alias("n"), F.bool_or(F.col("w1").isNull()).alias("blank"))
    best = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    kept = rows.join(best, is_first, "left").filter(F.col("blank") | F.col("first").isNotNull())
    return materialize(kept.select("id", "t1", "t2", "n"))
