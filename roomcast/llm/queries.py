"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomcast.llm import (
    bagminhash,
    byte_bpe,
    chat_windows,
    cover_tree,
    fm_dedup,
    hd_langid,
    host_trust,
    packing,
    quality_llr,
    source_mix,
    spelling,
    turn_repair,
    warc_zst,
)
from roomcast.llm.frames import table
from roomcast.session import materialize

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: Url rules (verdict, host, path) and the weights that sources get in turn.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SOURCE_WEIGHTS = [5.0, 2.0, 1.0]
MAX_EPOCHS = 3
#: Fixed value: the conversation that the formatting query adds.
TRICKY_CONVERSATION = -7
TRICKY_TEXT = "\\### Assistant: </turn> ok"


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base rules and the likelihood-ratio verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_llr.fit(docs, quality_llr.trusted_ids(table(spark, sf_dir, "labels")))
    return quality_llr.judge(docs, weights).drop("text")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of ids and bytes."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


def op3_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    judged = host_trust.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_warc_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    manifest = warc_zst.write_archives(table(spark, sf_dir, "pages"))
    return warc_zst.read_archives(manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_hd_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the ones that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", hd_langid.held_out("doc_id"))
    prototypes = hd_langid.train(docs.filter("not held_out"))
    return hd_langid.predict(docs, prototypes, carry=("held_out",))


def op6_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat an earlier 20-word passage, removed."""
    docs = table(spark, sf_dir, "documents")
    return fm_dedup.digests(docs, fm_dedup.repeats(docs))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights takes from every document."""
    docs = table(spark, sf_dir, "documents")
    drawn = materialize(source_mix.draw(docs).select("doc_id", "source", "size", "es_key", "es_tie"))
    return source_mix.mix(drawn, SOURCE_WEIGHTS, MAX_EPOCHS).select("doc_id", "size", "source_size", "target", "taken")


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: five-word shingles, multiset overlap of 0.8 or more."""
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 best inner products of every query vector."""
    vectors = materialize(cover_tree.whole_vectors(table(spark, sf_dir, "embeddings")))
    return cover_tree.top_k(vectors, vectors.filter("id % 20 = 0"), k=20)


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one with control strings in its texts, formatted and read back."""
    schema = T.StructType(
        [
            T.StructField("conv_id", T.LongType()),
            T.StructField("turn", T.LongType()),
            T.StructField("role", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )
    added = spark.createDataFrame(
        [(TRICKY_CONVERSATION, i, role, TRICKY_TEXT) for i, role in enumerate(("user", "assistant"))], schema
    )
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_windows.read_back(chat_windows.format_chats(chats, VOCABULARY, PATTERN))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word that is frequent enough."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), least_count=5), ratio=5)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired rows of every conversation after the damage."""
    chats = turn_repair.conversations(table(spark, sf_dir, "conversations"))
    damaged = turn_repair.damage(chats)
    return turn_repair.reports(chats, damaged, materialize(turn_repair.audits(damaged)))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenized, cut and packed into sequences of at most 2048 tokens."""
    pieces = packing.cut(table(spark, sf_dir, "documents"), WORD_VOCABULARY)
    narrow = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    keyed = materialize(narrow.withColumn("piece_key", F.monotonically_increasing_id()))
    return packing.pack(keyed).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_llr,
        op2_byte_bpe,
        op3_host_trust,
        op4_warc_zst,
        op5_hd_langid,
        op6_fm_dedup,
        op7_source_mix,
        op8_bagminhash,
        op9_cover_tree,
        op10_chat_windows,
        op11_spelling,
        op12_turn_repair,
        op13_packing,
    )
}
