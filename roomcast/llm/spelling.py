"""Grouping of spelling variants: words one edit apart, joined by asymmetric q-chunks.

Words are counted over all texts.  Two words are near if one inserted, deleted or
replaced code point makes them equal.  Of a pair the shorter word (of equal ones, either)
is cut into two disjoint chunks, its halves; the other word contributes its positional
grams of the chunk's length.  One edit leaves one half whole, and moves it by one place at
most: not at all if the edit lies behind it, by one if a code point is missing before
it.  So a gram is looked up only where a chunk can stand: at the chunk's place for words of
equal length; for a word longer by one, the first half at its own place and the second half
shifted by one.  The edit then lies in the other half, to which the same rule is
applied again (``LEVELS`` times in all), and the chunks found make one join key.  What
the key leaves open is a quarter of the word, so few words share a key, and common prefixes
or suffixes do not bring pairs of their own.  Candidates are verified by edit distance inside
the join.  Where both halves fit (a repeated letter is missing), only the first counts, so
every pair comes out once.

A word's form is its near word with the largest count, if that is ``ratio`` times its own
or more; its root is the last word that following forms leads to.

Scale: counts are pre-aggregated where the texts lie, so frequent words cost one row a task.
Words get ids in the order of counts (ties: by code points), so that "the best near word" is
the least id and pairs travel as two integers, counted before the shuffle.  Forms have
larger counts by the factor ``ratio``, so chains are short; they are followed by pointer
doubling over tables, never on the driver.

Edge cases: null and empty texts have no words; a null id counts as an empty one in the
damage key; repeated rows count as often as they occur; an empty table gives no words;
other columns are never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomcast.llm.frames import bounded_rows, rows_out
from roomcast.session import materialize

#: Code points of the shortest word, and how often a word's remainder is cut into two chunks.
LEAST_CHARS = 6
LEVELS = 2
#: Distinct words that a task holds before it hands on their counts, and text bytes looked at together.
HELD_WORDS = 200_000
SLICE = 4 << 20
#: Letters of a word, and the share of runs (one in so many) that lose a letter.
LETTERS = "A-Za-zÀ-ÿ"
DAMAGED = 199


def damage(run: str, key: int) -> str:
    """The run without one code point if its key is a multiple of ``DAMAGED``; else the run."""
    if key % DAMAGED:
        return run
    at = key % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    df: DataFrame,
    least_count: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = LEAST_CHARS,
    held_words: int = HELD_WORDS,
) -> DataFrame:
    """(word, n): lower-cased runs of letters after the damage, of ``least_chars`` or more, seen ``least_count`` times or more."""
    kept = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])
    # a run of the least length can only get shorter, so shorter ones need no look
    runs = re.compile(f"[{LETTERS}]{{{least_chars},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            done = rows_out(out, [list(held.keys()), list(held.values())])
            held.clear()
            return done

        for batch in batches:
            for part in bounded_rows(batch, "text", SLICE):
                texts = pc.ascii_lower(part.column("text")).to_pylist()
                for own, text in zip(part.column("id").to_pylist(), texts):
                    if not text:
                        continue
                    prefix = zlib.crc32(f"{own}:".encode())
                    for word, n in Counter(runs(text)).items():
                        key = zlib.crc32(word.encode(), prefix)
                        if key % DAMAGED == 0:
                            word = damage(word, key)
                            if len(word) < least_chars:
                                continue
                        held[word] += n
                    if len(held) >= held_words:
                        yield hand_on()
        if held:
            yield hand_on()

    counts = kept.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def ranked(words: DataFrame) -> DataFrame:
    """Adds ``id``: increasing with falling count, then by code points.  Written, so that ids stay as they are."""
    order = [F.desc("n"), F.asc("word")]
    # each range is numbered on its own behind the one before: no task sees more than its range
    spread = materialize(words).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(spread.select(F.monotonically_increasing_id().alias("id"), "word", "n"))


def _sub(word: Column, at: Column, n: Column) -> Column:
    return F.substring(word, at + 1, n)


def _chunk_keys(word: Column, length: Column, longer: int, levels: int) -> list[Column]:
    """One struct (path, key) for each way to choose a preserved half ``levels`` times.

    ``length`` is that of the word cut into chunks; ``longer`` is by how much ``word`` is longer than that (0 or 1).  A path
    has a bit for each level, set where the second half is the preserved one.
    """
    ways = [(0, [], F.lit(0), length)]
    for _ in range(levels):
        further = []
        for path, chunks, at, n in ways:
            half = (n / 2).cast("int")
            further.append((2 * path, [*chunks, _sub(word, at, half)], at + half, n - half))
            further.append((2 * path + 1, [*chunks, _sub(word, at + half + longer, n - half)], at, half))
        ways = further
    return [
        F.struct(F.lit(path).alias("path"), F.xxhash64(length, F.lit(path), *chunks).alias("key")) for path, chunks, _, _ in ways
    ]


def _first_fit(x: Column, y: Column, path: Column, levels: int) -> Column:
    """True unless a second half was chosen although the first halves agree too."""
    fits, at, n = F.lit(True), F.lit(0), F.length(x)
    for level in reversed(range(levels)):
        second = path.bitwiseAND(1 << level) != 0
        half = (n / 2).cast("int")
        fits = fits & (~second | (_sub(x, at, half) != _sub(y, at, half)))
        at, n = F.when(second, at).otherwise(at + half), F.when(second, half).otherwise(n - half)
    return fits


def near_pairs(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(a, b): ids of all pairs of words that are exactly one edit apart, each pair once."""
    word, n = F.col("word"), F.length("word")
    chunks = words.select("id", "word", F.explode(F.array(*_chunk_keys(word, n, 0, levels))).alias("c"))
    equal = F.transform(F.array(*_chunk_keys(word, n, 0, levels)), lambda c: F.struct(c["key"].alias("key"), F.lit(False).alias("longer")))
    above = F.transform(F.array(*_chunk_keys(word, n - 1, 1, levels)), lambda c: F.struct(c["key"].alias("key"), F.lit(True).alias("longer")))
    grams = words.select("id", "word", F.explode(F.concat(equal, above)).alias("g"))
    x = chunks.select(F.col("c.key").alias("key"), F.col("c.path").cast("byte").alias("path"), F.col("id").alias("a"), F.col("word").alias("x"))
    y = grams.select(F.col("g.key").alias("key"), F.col("g.longer").alias("longer"), F.col("id").alias("b"), F.col("word").alias("y"))
    one = (
        (x["key"] == y["key"])
        & (y["longer"] | (F.col("a") < F.col("b")))
        & (F.levenshtein("x", "y", 1) == 1)
        & _first_fit(F.col("x"), F.col("y"), F.col("path").cast("int"), levels)
    )
    return x.join(y, one).select("a", "b")


def last_of_chains(steps: DataFrame) -> DataFrame:
    """(id, root) from (id, next) without cycles: pointer doubling until no pointer moves."""
    ways = materialize(steps.select("id", F.col("next").alias("root")))
    while True:
        then = ways.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        doubled = ways.join(then, "root", "left").select(
            "id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
        )
        doubled = materialize(doubled)
        ways = doubled.select("id", "root")
        if doubled.filter("moved").isEmpty():
            return ways


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n)."""
    own = ranked(words)
    pairs = near_pairs(own)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near")), F.struct(F.col("b").alias("id"), F.col("a").alias("near")))).alias("e"))
    near = ends.select("e.*").groupBy("id").agg(F.count("near").alias("n_near"), F.min("near").alias("best"))
    best = own.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    taken = F.col("form_n") >= ratio * F.col("n")
    formed = materialize(
        own.join(near, "id", "left").join(best, "best", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            *(F.when(taken, F.col(c)).alias(c) for c in ("best", "form", "form_n")),
        )
    )
    roots = last_of_chains(formed.filter("best is not null").select("id", F.col("best").alias("next")))
    named = roots.join(own.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return formed.join(named, "id", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
