"""Corpus pipeline: filter, deduplicate, cut repeated passages, mix sources, tokenize.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's result as Parquet under the shared checkpoint folder and hands what it reads
back to the next.  All stages but the last return the columns of ``documents``.

Edge cases: each stage inherits those of its operator.  Documents without a single word
fail the quality rules, so later stages see texts with words; a document whose words
are all cut keeps its row, with an empty text, until the mix, which takes no words of it;
an empty table passes through as an empty table; extra columns are carried to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomcast.llm import bagminhash, byte_bpe, fm_dedup, quality_llr, source_mix
from roomcast.llm.frames import fresh, table
from roomcast.llm.queries import MAX_EPOCHS, PATTERN, SOURCE_WEIGHTS, VOCABULARY
from roomcast.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold."""
    weights = quality_llr.fit(docs, quality_llr.trusted_ids(table(spark, sf_dir, "labels")))
    return quality_llr.keep(docs, weights)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one with the least id, a null id last, then by a hash of the text.

    Of rows that repeat both, one stays.
    """
    node, t1, t2, n = fresh(docs, "nd_doc", "nd_t1", "nd_t2", "nd_n")
    firsts = bagminhash.firsts(docs).toDF(node, t1, t2, n)
    own1, own2 = bagminhash.text_key(F.col("text").cast("string"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(node)) & (own1 == F.col(t1)) & (own2 == F.col(t2))
    kept = docs.join(firsts, same)
    once = kept.filter(F.col(n) == 1).select(*docs.columns)
    # rows that repeat id and text are few as a rule: only they are dealt by their key; what else differs in them decides
    rest = F.to_json(F.struct(*(c for c in docs.columns if c != "text")))
    one = F.min_by(F.struct(*docs.columns), rest).alias(n)
    again = kept.filter(F.col(n) > 1).groupBy(node, t1, t2).agg(one).select(f"{n}.*")
    return once.unionByName(again)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word passages that start earlier in the corpus."""
    return fm_dedup.strip(docs, fm_dedup.repeats(docs))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: rows once per epoch, the last one of a source cut at its target."""
    size, key, tie = fresh(docs, "size", "es_key", "es_tie")
    drawn = materialize(source_mix.draw(docs, into=(size, key, tie)))  # sums and both parts of the mix read it
    taken = fresh(drawn, "source_size", "target", "taken")[2]
    mixed = source_mix.mix(drawn, SOURCE_WEIGHTS, MAX_EPOCHS, size_col=size, key_col=key, tie_col=tie)
    return source_mix.expand(mixed, size_col=size, taken_col=taken).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, with digests of the ids and of the decoded bytes."""
    return byte_bpe.round_trip(docs, VOCABULARY, PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_weights", source_weights),
    ("tokens", tokens),
]

#: No SQL: the likelihood ratio hashes n-grams and the tokenizer merges by rank; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
