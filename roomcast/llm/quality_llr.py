"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio with a fixed threshold.

Words are the runs of characters other than 0x20 and 0x09-0x0D.  A text's unigrams and
bigrams are hashed into ``buckets`` buckets.  Two multinomials over the buckets are
counted: raw, over the n-grams of all documents, and target, over those of trusted
documents.  A document's score is the mean over its n-grams of
log p_target(bucket) - log p_raw(bucket); it is kept if the base rules pass and the
score is at least ``threshold``.  Nothing is drawn at random: equal texts are judged alike.

Only DataFrame functions run on the executors.  Counting explodes bucket numbers into a
partial aggregate of at most ``buckets`` groups, so a frequent word is one row per task,
and nothing else is shuffled.  The weights - ``buckets`` numbers, whatever the size of
the corpus - pass through the driver into a literal array.  Trusted documents are a
documented, bounded sample: the ``trusted_rows`` labelled documents of smallest hash;
its ids are broadcast (8 bytes each).  Repeated three-word windows are found inside the
row by sorting 64-bit window hashes.

Edge cases: null and empty texts have no words and fail the base rules (fewer than 50
words); their score is null.  Without any trusted document the method has no verdict
and keeps what the base rules pass.  A label that is null, or rows that disagree about a
document, do not make it trusted; repeated rows count and are judged as often as they
occur; other columns are carried or ignored as the caller asks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomcast.llm.frames import SPACE, fresh

#: Fixed values of the base rules.
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

BUCKETS = 10_000
#: Mean log ratio per n-gram below which a document is rejected.
THRESHOLD = -0.1
TRUSTED_ROWS = 20_000
SMOOTHING = 1.0


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_hashes(own: Column) -> Column:
    return F.transform(own, lambda w: F.xxhash64(w))


def _joined(hashes: Column, k: int) -> Column:
    """Hash of every k consecutive word hashes."""
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)]))


def gram_buckets(hashes: Column, buckets: int) -> Column:
    """Bucket numbers of all unigrams and bigrams, from the word hashes."""
    grams = F.concat(hashes, _joined(hashes, 2))
    return F.transform(grams, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` ids that every label calls good and not toxic, by smallest hash."""
    good = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t")
    )
    return good.filter("id is not null and q = 1 and t = 0").orderBy(F.xxhash64("id"), "id").limit(rows).select("id")


def fit(
    docs: DataFrame,
    trusted: DataFrame,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[float] | None:
    """Log ratio of every bucket; None if no trusted document has a word."""
    flagged = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(
        F.broadcast(trusted.withColumn("is_target", F.lit(1))), F.col("key") == F.col("id"), "left"
    )  # trusted has at most TRUSTED_ROWS rows
    grams = flagged.select("is_target", word_hashes(words(F.col("text"))).alias("h")).select(
        "is_target", F.explode(gram_buckets(F.col("h"), buckets)).alias("bucket")
    )
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("is_target").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:  # one row per bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return None
    of_raw, of_target = sum(raw) + smoothing * buckets, sum(target) + smoothing * buckets
    return [
        math.log((t + smoothing) / of_target) - math.log((r + smoothing) / of_raw) for r, t in zip(raw, target)
    ]


def judge(
    docs: DataFrame,
    weights: list[float] | None,
    threshold: float = THRESHOLD,
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns of ``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept.
    """
    w, h, win, order = fresh(docs, "q_words", "q_hashes", "q_windows", "q_sorted")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # positions of windows whose hash stands twice in a row once they are sorted
    placed = F.sort_array(F.transform(F.col(win), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    in_order = F.col(order)
    twice = F.filter(
        F.transform(
            in_order,
            lambda p, i: F.when(
                (p["x"] == F.get(in_order, i - 1)["x"]) | (p["x"] == F.get(in_order, i + 1)["x"]), p["i"]
            ),
        ),
        lambda x: x.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    if weights is None:
        score, passed = F.lit(None).cast("double"), F.lit(True)
    else:
        table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
        total = F.aggregate(gram_buckets(F.col(h), len(weights)), F.lit(0.0), lambda a, b: a + F.get(table, b))
        score = total / F.nullif(2 * F.size(h) - 1, F.lit(-1))
        passed = F.coalesce(F.col("score") >= threshold, F.lit(False))
    rows = (
        docs.withColumn(w, words(F.col(text_col)))
        .withColumn(h, word_hashes(F.col(w)))
        .withColumn("n_words", F.size(h).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", lines)
        .withColumn("n_dup_lines", (F.size("n_dup_lines") - F.size(F.array_distinct("n_dup_lines"))).cast("long"))
        .withColumn(win, _joined(F.col(h), 3))
        .withColumn("score", score)
        .withColumn(order, F.when(F.size(F.array_distinct(win)) < F.size(win), placed))
        .withColumn("n_repeat_words", F.coalesce(F.when(in_order.isNotNull(), covered), F.lit(0)).cast("long"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
        )
        .withColumn("kept", ~F.col("base_failed") & passed)
    )
    return rows.select(*[c for c in docs.columns if c not in names], *names)


def keep(
    docs: DataFrame, weights: list[float] | None, threshold: float = THRESHOLD, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns."""
    (row,) = fresh(docs, "q_row")
    judged = judge(docs, weights, threshold, text_col).select(
        *docs.columns, F.col("kept").alias(row), F.monotonically_increasing_id().alias(row + "_id")
    )
    # the row number keeps the optimizer from copying the verdict's nested expressions into a filter below them
    return judged.filter(F.col(row) & (F.col(row + "_id") >= 0)).select(*docs.columns)
