"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of all words by its weight, at most ``max_epochs`` times its
own words; what a source cannot take is shared among the others by weight (water
filling).  A source's target is then a number of complete epochs and a remainder.
Complete epochs come first.  For the remainder each document draws the exponential
key ``-ln(u) / quality`` (u is a fixed hash of its id, so reruns agree);
documents are taken in key order while the running sum of their sizes stays within
the remainder, and the one that crosses it is taken in part, so that the source's
words meet its target to the word.

Scale: keys are strictly increasing in ``1 - exp(-key)``, which is cut into ``bins``
equal steps.  Words per (source, bin) are a partial aggregate, their running sum
finds the bin in which a source's remainder ends, and only the rows of that one bin
are sorted.  That bin may hold 1/bins of a source or, where most keys are alike (texts of
least quality, null ids), nearly all of it: its rows are dealt by ranges of
(source, key, id, text), sums of the ranges tell where each begins, and a task sorts one range.
Tables of sources and of (source, bin) and (source, range) sums are the only ones that meet
in one place; their size follows the number of sources.

Edge cases: null text or text without words has size 0 and is taken 0 times; null
sources form one source, ordered last; a null or non-positive quality counts as the
smallest quality; rows that repeat an id share one key and are ordered by a
hash of their text, rows that repeat both are interchangeable; an empty table gives an
empty result; other columns stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roomcast.llm.frames import SPACE, WORD, fresh
from roomcast.session import materialize

#: Least quality weight of a document.
LEAST_QUALITY = 1e-3
#: Copies of a source's plan row that its rows are dealt over.
SALTS = 64


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: str) -> Column:
    """Share of letters among the characters of words, from LEAST_QUALITY to 1; null without any."""
    solid = F.regexp_replace(F.col(text), SPACE, "")
    letters = F.length(F.regexp_replace(solid, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(LEAST_QUALITY), letters / F.nullif(F.length(solid), F.lit(0)))


def _targets(sizes: DataFrame, weights: list[float], max_epochs: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size); a table of sources only."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn(
        "weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * float(max_epochs))
    # Sources fill up in the order of cap / weight.  The water level is where what the full
    # ones hold, and the level times the weight of the others, add up to all words.
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    rest = filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    return (
        weighed.withColumn("level", level)
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        # levels fall after the first source that is not full: its level is the one that holds
        .withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
        .select(
            "source",
            "source_size",
            F.when(F.col("full"), F.col("cap")).otherwise(F.col("water") * F.col("weight")).alias("target"),
        )
    )


def draw(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality: Column | None = None,
    seed: str = "mix",
    into: tuple[str, str, str] = ("size", "es_key", "es_tie"),
) -> DataFrame:
    """``df`` with the size in words, the exponential key and a tie breaker of every row (names ``into``).

    ``quality`` weighs documents within their source (default: ``text_quality``).
    """
    size, key, tie = into
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    weight = text_quality(text_col) if quality is None else quality
    q = F.greatest(F.lit(LEAST_QUALITY), F.coalesce(weight, F.lit(LEAST_QUALITY)))
    return df.withColumn(size, n_words(text_col)).withColumn(key, -F.log(u) / q).withColumn(tie, F.xxhash64(F.col(text_col)))


def _running(df: DataFrame, group: Column, order: list[Column], value: str, into: str) -> DataFrame:
    """``df`` with the running sum of ``value`` in each group; no task sorts more than a range of rows."""
    part, of, begin, at = fresh(df, "rs_part", "rs_of", "rs_begin", "rs_at")
    # written, so that rows and their sums agree on the ranges
    cut = materialize(df.withColumn(of, F.struct(group.alias("g"))).repartitionByRange(of, *order).withColumn(part, F.spark_partition_id()))
    sums = cut.groupBy(of, part).agg(F.sum(value).alias(begin))
    before = W.partitionBy(of).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    begins = sums.select(F.struct(of, part).alias(at), F.coalesce(F.sum(begin).over(before), F.lit(0)).alias(begin))
    own = W.partitionBy(of, part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = cut.withColumn(into, F.sum(value).over(own)).withColumn(of, F.struct(of, part))
    return summed.join(begins, F.col(of) == F.col(at)).withColumn(into, F.col(into) + F.col(begin)).drop(part, of, begin, at)


def mix(
    df: DataFrame,
    weights: list[float],
    max_epochs: int = 3,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
    key_col: str = "es_key",
    tie_col: str = "es_tie",
    bins: int = 4096,
) -> DataFrame:
    """Rows of ``draw`` plus source_size, target and taken (words of the row in the mix)."""
    s_size, target, taken = fresh(df, "source_size", "target", "taken")
    bin_, mine, cum, salt, row_salt = fresh(df, "es_bin", "es_source", "es_cum", "es_salt", "es_row_salt")
    step = F.least(F.lit(bins - 1), F.floor((1 - F.exp(-F.col(key_col))) * bins)).cast("int")
    rows = df.withColumn(bin_, step)
    sums = materialize(
        rows.groupBy(F.col(source_col).alias("source"), F.col(bin_).alias("bin")).agg(F.sum(size_col).alias("words"))
    )
    targets = _targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "left_over", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    )
    # Where each source's remainder ends: the first bin whose running sum goes beyond it.
    running = sums.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("bin")))
    ends = (
        running.join(plan.select(F.col("source").alias("s"), "left_over"), F.col("source").eqNullSafe(F.col("s")))
        .filter(F.col("upto") > F.col("left_over"))
        .groupBy("source")
        .agg(F.min(F.struct("bin", (F.col("left_over") - F.col("upto") + F.col("words")).alias("room"))).alias("end"))
        .select(F.col("source").alias("s"), "end.bin", "end.room")
    )
    # written, so that the planner knows its size: one row per source, broadcast below Spark's own threshold
    plan = materialize(
        plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
            F.struct("source", "source_size", "target", "epochs", F.coalesce("bin", F.lit(bins)).alias("bin"), "room").alias(mine)
        )
    )
    # a third of all rows may have one source: its rows meet SALTS copies of its plan row
    salted = plan.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn(row_salt, F.pmod(F.xxhash64(id_col, tie_col), F.lit(SALTS)).cast("int")).join(
        salted, F.col(source_col).eqNullSafe(F.col(f"{mine}.source")) & (F.col(row_salt) == F.col(salt))
    )
    at_end = F.col(bin_) == F.col(f"{mine}.bin")
    order = [F.col(c).asc_nulls_first() for c in (key_col, id_col, tie_col)]
    partial = (
        _running(joined.filter(at_end), F.col(f"{mine}.source"), order, size_col, cum)
        .withColumn(
            cum, F.greatest(F.lit(0), F.least(F.col(size_col), F.col(f"{mine}.room") - F.col(cum) + F.col(size_col)))
        )
    )
    whole = joined.filter(~at_end).withColumn(
        cum, F.when(F.col(bin_) < F.col(f"{mine}.bin"), F.col(size_col)).otherwise(0).cast("long")
    )
    return (
        whole.unionByName(partial)
        .withColumn(taken, F.col(f"{mine}.epochs") * F.col(size_col) + F.col(cum))
        .withColumn(s_size, F.col(f"{mine}.source_size"))
        .withColumn(target, F.col(f"{mine}.target"))
        .drop(bin_, mine, cum, salt, row_salt)
    )


def expand(mixed: DataFrame, text_col: str = "text", size_col: str = "size", taken_col: str = "taken") -> DataFrame:
    """The mix itself: every row once per epoch, and once more, cut after its last taken word, for a part of one.

    Rows without words are in no epoch.
    """
    epoch, left = fresh(mixed, "es_epoch", "es_left")
    size, taken = F.col(size_col), F.col(taken_col)
    words = F.filter(F.split(F.col(text_col), SPACE), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col(left), F.lit(1)).cast("int")), " ")
    return (
        mixed.filter(taken > 0)
        .withColumn(epoch, F.explode(F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))))
        .withColumn(left, F.least(size, taken - (F.col(epoch) - 1) * size))
        .withColumn(text_col, F.when(F.col(left) < size, cut).otherwise(F.col(text_col)))
        .drop(epoch, left)
    )
