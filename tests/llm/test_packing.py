"""Packing against a plain best-fit decreasing and the tokenizer library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roomcast.llm import packing
from roomcast.llm.queries import QUERIES, WORD_VOCABULARY
from tests.llm.helpers import SF, awkward_documents, folder_with

LIBRARY = Tokenizer.from_file(WORD_VOCABULARY)
LIBRARY.encode_special_tokens = True
OWN = packing.Stretches(WORD_VOCABULARY)


def _ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("aΣσ' é́  \n\t1.<|endoftext|>\x1c\x85İ", max_size=120))
def test_stretches_equal_library(text):
    assert np.frombuffer(OWN.encode([text])[0], "<u4").tolist() == _ids(text)[:-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_decreasing(lengths):
    tree, open_windows = packing.BestFit(16), []
    for n in sorted(lengths, reverse=True):
        number, offset = tree.place(n)
        fits = [c for c in open_windows if c >= n]
        if fits:
            assert open_windows[number] == min(fits)
        else:
            assert number == len(open_windows)
            open_windows.append(16)
        assert offset == 16 - open_windows[number]
        open_windows[number] -= n


def _check(rows, docs):
    """Every id in one piece, windows gapless and at most full; returns the tokens of each sequence."""
    want = Counter()
    for i, text in docs:
        ids = _ids(text)
        for at in range(0, len(ids), 2048):
            part = np.array(ids[at : at + 2048], "<u4")
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return windows


def test_query_packs_everything(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op13_packing"](spark, SF).collect()
    windows = _check(rows, docs)
    total = sum(r["length"] for r in rows)
    assert len(windows) <= total / 2048 * 1.01 + 1


def test_awkward_documents(spark, tmp_path):
    folder = folder_with(spark, tmp_path, documents=awkward_documents(spark))
    docs = [(r["doc_id"], r["text"]) for r in awkward_documents(spark).collect()]
    _check(QUERIES["op13_packing"](spark, folder).collect(), docs)


def test_sequences_hold_the_ids(spark):
    docs = awkward_documents(spark)
    pieces = packing.cut(docs, WORD_VOCABULARY, window=64).withColumn("piece_key", F.monotonically_increasing_id()).cache()
    packed = packing.pack(pieces, window=64, block_pieces=50).cache()
    assert packed.select("sequence_id").distinct().count() > 100 and packed.count() == pieces.count()
    built = {r["sequence_id"]: r for r in packing.sequences(packed, window=64, pad_id=7).collect()}
    for r in packed.collect():
        tokens = built[r["sequence_id"]]["tokens"][r["offset"] : r["offset"] + r["length"]]
        assert tokens == np.frombuffer(r["ids"], "<u4").tolist() and r["offset"] in built[r["sequence_id"]]["starts"]
    for r in built.values():
        n, size = r["n_tokens"], len(r["tokens"])
        assert size == (n if n & (n - 1) == 0 else 64) and r["tokens"][n:] == [7] * (size - n)
