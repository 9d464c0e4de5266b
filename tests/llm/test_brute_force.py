"""Queries without SQL against plain Python; parts of operators against their definitions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from roomcast.llm import bagminhash, byte_bpe, chat_windows, cover_tree, fm_dedup, hd_langid, quality_llr, warc_zst
from roomcast.llm.queries import PATTERN, QUERIES, TRICKY_TEXT, VOCABULARY
from roomcast.llm.wordhash import word_hashes
from tests.llm.helpers import SF, awkward_documents, folder_with

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CODEC = byte_bpe.codec(VOCABULARY, PATTERN)
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


# -- quality rules -------------------------------------------------------------------------------


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def _hash_words(words):
    return [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]


def _join_hashes(hashes):
    """The engine's hash of several longs: each one seeds the next."""
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=seed)
    return seed


def _grams(words, buckets):
    h = _hash_words(words)
    both = h + [_join_hashes(p) for p in zip(h, h[1:])]
    return [_signed(x) % buckets for x in both]


def quality_rows(docs, trusted, buckets=quality_llr.BUCKETS):
    """{id: (counts ..., base_failed, score, kept)} in plain Python; docs are (id, text) with distinct ids."""
    grams = {i: _grams(WORD.findall(t or ""), buckets) for i, t in docs}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in trusted:
            target.update(g)
    nr, nt = sum(raw.values()) + buckets, sum(target.values()) + buckets
    weight = lambda b: math.log((target[b] + 1) / nt) - math.log((raw[b] + 1) / nr)
    out = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        often = Counter(windows)
        covered = {j + d for j, x in enumerate(windows) if often[x] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        score = sum(map(weight, grams[i])) / len(grams[i]) if grams[i] else None
        passed = score is not None and score >= quality_llr.THRESHOLD
        counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        out[i] = (*counts, failed, score, not failed and (passed if target else True))
    return out


def _check_quality(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    labels = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        labels[r["doc_id"]].append((r["quality"], r["toxic"]))
    trusted = {i for i, x in labels.items() if all(q == 1 and t == 0 for q, t in x)}
    want = quality_rows(docs, trusted)
    got = QUERIES["op1_quality_llr"](spark, folder).collect()
    assert len(got) == len(want)
    for r in got:
        *counts, score, kept = want[r["doc_id"]]
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")] == counts
        assert r["score"] == (None if score is None else pytest.approx(score, abs=1e-9)) and r["kept"] == kept
    return got


def test_quality(spark):
    got = _check_quality(spark, SF)
    assert 0.5 < sum(r["kept"] for r in got) / len(got) < 1


def test_quality_awkward(spark, tmp_path):
    docs = awkward_documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (9, 1, None), (10, 1, 1), (11, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    _check_quality(spark, folder_with(spark, tmp_path, documents=docs, labels=labels))


def test_quality_without_trusted_documents(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet").limit(0)
    rows = QUERIES["op1_quality_llr"](spark, folder_with(spark, tmp_path, labels=labels)).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)


# -- byte-level BPE ------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text("ab \n'tsé☃😀1", max_size=200))
def test_bpe_equals_library(text):
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == ENCODING.encode_ordinary(text)
    assert CODEC.decode(ids).decode() == text


def test_bpe_long_pretoken():
    text = "abcab" * 40000 + "z" * 30000
    assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == ENCODING.encode_ordinary(text)


def test_bpe_query(spark, tmp_path):
    folder = folder_with(spark, tmp_path, documents=awkward_documents(spark))
    texts = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = np.array(ENCODING.encode_ordinary(r["text"] or ""), "<u4")
        texts[r["doc_id"]].append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = defaultdict(list)
    for r in QUERIES["op2_byte_bpe"](spark, folder).collect():
        got[r["doc_id"]].append((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    back = byte_bpe.decode(byte_bpe.encode(docs, VOCABULARY, PATTERN), VOCABULARY, PATTERN).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in back) == sorted(r["text"] or "" for r in docs.collect())


# -- WARC ----------------------------------------------------------------------------------------


def test_warc_keeps_payloads_and_rejects_damage(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages = pages.unionByName(pages.limit(3).selectExpr("page_id + 100000 as page_id", "url", "html"))
    manifest = warc_zst.write_archives(pages, archive_bytes=200_000)
    assert manifest.count() > 1
    back = {r["page_id"]: r for r in warc_zst.read_archives(manifest).collect()}
    for r in pages.collect():
        own = back[r["page_id"]]
        whole = back[own["refers_to"]] if own["record_type"] == "revisit" else own
        assert bytes(whole["payload"]).decode() == r["html"] and own["url"] == r["url"]
    assert sum(r["record_type"] == "revisit" for r in back.values()) >= 3
    good = warc_zst.record(1, "http://a/ b", b"text", None, "2024-01-01T00:00:00Z")
    assert warc_zst.parse_record(good, "x")["payload"] == b"text"
    for bad in (good[:-1], good.replace(b"text", b"tex_"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Dat")):
        with pytest.raises(warc_zst.WarcError):
            warc_zst.parse_record(bad, "x")


# -- language ------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op5_hd_langid"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count() and got.count() > 100


def test_language_pieces_and_edges(spark, tmp_path, monkeypatch):
    texts = ["Der Übergang, ohne Zahl 12 — und so", "abc " * 500, None, "", "12 ++", "é"]
    whole = hd_langid.bundle(texts, 64, 3)
    monkeypatch.setattr(hd_langid, "PIECE", 7)
    assert (hd_langid.bundle(texts, 64, 3) == whole).all() and not whole[2:5].any()
    folder = folder_with(spark, tmp_path, documents=awkward_documents(spark))
    got = QUERIES["op5_hd_langid"](spark, folder).collect()
    assert len(got) == 17 and all((r["lang_pred"] == "und") == (r["doc_id"] in (4, 5, 6)) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)


# -- substring dedup -----------------------------------------------------------------------------


def _removed(docs, window):
    """{(id, text): kept words} by definition."""
    seen, kept = {}, {}
    order = sorted(set(docs), key=lambda d: d[0])
    for i, text in order:
        w = WORD.findall(text or "")
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.setdefault(key, i)
        kept[i] = [x for j, x in enumerate(w) if j not in gone]
    return kept


@pytest.mark.parametrize("hot", [fm_dedup.HOT, 2])
def test_substring_dedup_on_repetitive_texts(spark, hot):
    rng = np.random.default_rng(hot)
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(list("abcdefgh"), 12)) for _ in range(2)] + ["p q r s t u v w x y " * int(rng.integers(1, 4))]
        docs.append((i, " ".join(rng.permutation(parts))))
    docs += [(100 + i, docs[i][1]) for i in range(20)]
    df = spark.createDataFrame([*docs, docs[3]], "doc_id long, text string")  # one row twice
    got = {r["doc_id"]: r for r in fm_dedup.digests(df, fm_dedup.repeats(df, window=8, k=3, hot=hot)).collect()}
    for i, words in _removed(docs, 8).items():
        assert got[i]["kept_sha256"] == hashlib.sha256(" ".join(words).encode()).hexdigest(), i
    stripped = {r["doc_id"]: r["text"] for r in fm_dedup.strip(df, fm_dedup.repeats(df, window=8, k=3, hot=hot)).collect()}
    assert all(WORD.findall(stripped[i]) == words for i, words in _removed(docs, 8).items())


def test_substring_dedup_of_many_texts_without_id(spark):
    rng = np.random.default_rng(11)
    passage = " ".join(f"p{i}" for i in range(25))
    own = [" ".join(f"t{i}_{j}" for j in range(int(rng.integers(1, 30)))) for i in range(3000)]
    texts = [f"{t} {passage}" if i % 2 else f"{passage} {t}" for i, t in enumerate(own)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(5, f"{t} x{i}") for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    spans = fm_dedup.repeats(df).cache()
    want = Counter()
    for i, t in enumerate(own):
        want[None, t] += 1
        # the text with an id comes after the same one without: all but its last word is cut
        want[5, f"x{i}"] += 1
    got = Counter((r["doc_id"], r["text"]) for r in fm_dedup.strip(df, spans).collect())
    assert sum(got.values()) == 6000
    left = got - want
    assert len(left) == 1 and passage in next(iter(left))[1]  # the first of the texts keeps the passage
    hashes = Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in got.elements())
    assert Counter((r["doc_id"], r["kept_sha256"]) for r in fm_dedup.digests(df, spans).collect()) == hashes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=4, max_size=14), min_size=1, max_size=8))
def test_fm_index_counts_and_repeats(segments):
    lengths = np.array([len(s) for s in segments])
    words = np.concatenate([np.array(s, np.uint64) for s in segments])
    index = fm_dedup.FMIndex(words, lengths)
    covered = {(int(i), p) for i, a, b in zip(*index.repeats(4)) for p in range(a, b)}
    seen, want = set(), set()
    for i, s in enumerate(segments):
        for p in range(len(s) - 3):
            if tuple(s[p : p + 4]) in seen:
                want |= {(i, q) for q in range(p, p + 4)}
            seen.add(tuple(s[p : p + 4]))
    assert covered == want


def test_shard_holds_different_segments_only():
    """Many copies under one key: spans leave with their batch, and no batch is looked at twice."""
    rng = np.random.default_rng(3)
    segments = [rng.integers(0, 5, 8).astype(np.uint64) for _ in range(3)]
    segments[1][2:7] = segments[0][1:6]
    rows = sorted(((1 if s < 3 else 2, s % 3, d, s) for d in range(400) for s in range(6)), key=lambda r: r[:3])
    table = pa.Table.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
         pa.array([0] * len(rows), pa.int64()), pa.array([(100 * r[3]) << 31 | 100 * r[3] + 8 for r in rows], pa.int64()),
         pa.array([fm_dedup._packed_words(segments[r[1]], np.array([0]), np.array([8]))[0] for r in rows], pa.binary())],
        schema=fm_dedup._SENT_SCHEMA)
    want = None
    for size in (7, 100, 5000):
        spans = pa.Table.from_batches(fm_dedup._shard(iter(table.to_batches(max_chunksize=size)), 5, 4), schema=fm_dedup._SPANS_SCHEMA)
        got = Counter(zip(*(c.to_pylist() for c in spans.columns)))
        want = want or got
        assert got == want
    assert len(want) >= 399 * 6 and all((d, 0, 100 * s << 31 | 100 * s + 8) in want for d in range(1, 400) for s in range(6))
    with pytest.raises(ValueError):
        fm_dedup.repeats(None, window=90, k=6)


def test_word_hashes_follow_words():
    texts = ["a b  a\tab", "", "b", "ab a"]
    raw = "".join(texts).encode()
    hashes, first = word_hashes(np.frombuffer(raw, np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    words = [w for t in texts for w in WORD.findall(t)]
    assert len(hashes) == len(words) and first.tolist() == [0, 4, 4, 5, 7]
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))


# -- near duplicates -----------------------------------------------------------------------------


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = rng.integers(1, 12, 300), rng.integers(1, 12, 300)
    rows = bagminhash.signatures([(keys, a), (keys, b), (keys[:1], a[:1]), (keys[:0], a[:0])], slots=4096)
    assert abs((rows[0] == rows[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    assert np.isfinite(rows[:3]).all() and np.isinf(rows[3]).all()


def test_near_duplicates_of_rows_that_share_ids(spark):
    rows = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(awkward_documents(spark)).collect()}
    assert rows[1] == rows[2] == rows[3] == 1 and rows[None] == 1 and rows[7] == rows[8] == 7
    assert all(rows[i] == i for i in (4, 5, 6, 9, 10, 11, 12, 13, 14, 15))


def test_near_duplicates_without_ids(spark):
    rng = np.random.default_rng(3)
    texts = [[f"{g}_{x}" for x in rng.integers(0, 900, 100)] for g in range(4)]

    def near(g, at):
        return " ".join([*texts[g][:at], "changed", *texts[g][at + 1 :]])

    # 0: near copies of a text that occurs under null ids alone; 1: no ids at all; 2: an id with two texts
    rows = [(None, near(0, 10)), (None, near(0, 10)), (21, near(0, 12)), (20, near(0, 14))]
    rows += [(None, near(1, 10)), (None, near(1, 12)), (9, near(2, 10)), (8, near(2, 12)), (9, near(3, 10)), (None, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"]) for r in bagminhash.classes(df).collect())
    want = [(None, 20), (None, 20), (21, 20), (20, 20), (None, None), (None, None), (9, 8), (8, 8), (9, 9), (None, None), (7, 7)]
    assert got == Counter(want)


# -- search --------------------------------------------------------------------------------------


def _best(query, own, data, ids, k):
    """k best by definition, in Python integers, at the 64-bit limits."""
    scores = [min(max(sum(int(a) * int(b) for a, b in zip(query, v)), -(2**63)), 2**63 - 1) for v in data]
    return sorted((-s, int(i)) for s, i in zip(scores, ids) if i != own)[:k]


@pytest.mark.parametrize("large", [0, 3, 900])
def test_cover_tree_prunes_and_is_exact(monkeypatch, large):
    monkeypatch.setattr(cover_tree, "DATA_LEAF", 30)
    monkeypatch.setattr(cover_tree, "QUERY_LEAF", 20)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 60, (12, 8))
    data = np.floor(centres[rng.integers(0, 12, 900)] + rng.normal(0, 4, (900, 8)))
    data[:large] *= 2.0 ** rng.integers(20, 40, (900, 8))[:large]
    data[5] = data[6] = data[7]
    if large == 3:
        data[1] = 1.7e308
    ids = rng.permutation(900)
    found = cover_tree.DualSearch(data[:90], ids[:90], data, ids, 5)
    for r in range(90):
        got = [(-int(s), int(i)) for s, i in zip(found.scores[r], found.ids[r])]
        assert got == _best(data[r], ids[r], data, ids, 5) and found.found[r] == 5
    tree = found.x
    for node, rows in enumerate(tree.members):
        with np.errstate(over="ignore"):
            far = np.linalg.norm(data[rows] - tree.centres[node], axis=1).max()
        assert far <= tree.radii[node] + 1e-6


def test_cover_tree_skips_what_cannot_win(monkeypatch):
    monkeypatch.setattr(cover_tree, "DATA_LEAF", 64)
    monkeypatch.setattr(cover_tree, "QUERY_LEAF", 64)
    seen = []
    plain = cover_tree.DualSearch._compare
    monkeypatch.setattr(cover_tree.DualSearch, "_compare", lambda self, m, r: (seen.append(len(m) * len(r)), plain(self, m, r)))
    rng = np.random.default_rng(2)
    far = rng.normal(0, 1, (16, 8)) * 500
    data = np.floor(far[np.repeat(np.arange(16), 250)] + rng.normal(0, 3, (4000, 8)))
    cover_tree.DualSearch(data[::10], np.arange(0, 4000, 10), data, np.arange(4000), 5)
    assert sum(seen) < 0.5 * 400 * 4000


def test_top_k_of_few_and_wild_vectors(spark, tmp_path):
    wild = [(20, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 2.0]), (3, [3e307, 0.0]), (40, [0.5, 0.25]), (5, [-0.5, 8.0]), (60, [2.0**50, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in wild], "vec_id long, embedding array<double>, label int")
    rows = QUERIES["op9_cover_tree"](spark, folder_with(spark, tmp_path, embeddings=df)).collect()
    whole = {i: [math.floor(64 * x) if abs(64 * x) < 2.0**52 else max(-1.7e308, min(1.7e308, 64 * x)) for x in v] for i, v in wild}
    for q in (20, 40, 60):
        got = [(-r["score"], r["vec_id"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert got == _best(whole[q], q, list(whole.values()), list(whole), 20)
    assert len(rows) == 18


# -- chat ----------------------------------------------------------------------------------------


@given(st.text(), st.text("\\<|>end again turn", max_size=30))
def test_chat_escapes(role, text):
    formatted = chat_windows._opened("turn", role, text) + chat_windows._opened("again", text, role)
    assert [x[:3] for x in chat_windows.read_window(formatted)] == [(False, role, text), (True, text, role)]


def test_chat_query_and_windows(spark, tmp_path):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", None), (1, 2, "assistant", "a <|end|> b \\"), (1, None, None, "x")]
    rows += [(2, i, ("user", "assistant")[i % 2], "word " * 150 + str(i)) for i in range(12)] + [(None, 0, "user", "?")]
    rows += [(3, 0, "system", "rules")] + [(3, i, ("assistant", "user")[i % 2], f"turn {i} " * 30) for i in range(1, 20)]
    chats = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r["conv_id"]: r for r in QUERIES["op10_chat_windows"](spark, folder_with(spark, tmp_path, conversations=chats)).collect()}
    for r in (-7, "user", TRICKY_TEXT), (-7, "assistant", TRICKY_TEXT):
        rows.append((r[0], len(rows), *r[1:]))
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    windows = chat_windows.format_chats(chats, VOCABULARY, PATTERN, budget=200, history_tokens=80).filter("conv_id = 3").collect()
    assert len(windows) > 2
    for w in windows:
        turns = list(chat_windows.read_window(w["formatted"]))
        assert turns[0][1:3] == ("system", "rules") and turns[0][0] == (w["window_no"] > 0)
        assert w["n_tokens"] <= 200 or sum(not t[0] for t in turns) == 1


# -- pipeline ------------------------------------------------------------------------------------


def _jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_pipeline_keeps_unique_texts_without_id(spark):
    docs = awkward_documents(spark)
    unique = " ".join(f"u{i}" for i in range(80))
    near = " ".join(f"v{i}" for i in range(80))
    more = [(None, unique), (None, near + " x"), (None, near + " y"), (None, near + " y")]
    added = spark.createDataFrame([(i, t, "en", "a", "clash") for i, t in more], docs.schema)
    kept = corpus_pipeline.near_duplicates(spark, docs.unionByName(added), SF)
    assert kept.columns == docs.columns
    rows = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert (None, unique) in rows and len({t for i, t in rows if i is None} & {near + " x", near + " y"}) == 1
    assert {i for i, _ in rows if i is not None} == {1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15}
    assert len(rows) == 14  # the text of id 1 stays under that id alone


def test_pipeline_keeps_one_row_of_each_class(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(3, a, "s"), (3, a, "s"), (3, a, "r"), (None, b, "s"), (None, b, "s")]  # repeated rows
    rows += [(5, c, "s"), (5, d + " x", "s"), (4, d + " y", "s")]  # an id with a unique text and a near copy
    rows += [(7, e, "s"), (7, d + " y", "s"), (7, f"{a} z", "s")]  # with an exact copy, and a near copy of a larger class
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    want = [(3, a, "r"), (None, b, "s"), (5, c, "s"), (4, d + " y", "s"), (7, e, "s")]
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(want)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    want = quality_rows([(i, r["text"]) for i, r in rows.items()], {i for i, x in labels.items() if x == (1, 0)})
    one = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, x in want.items() if x[-1])
    two = corpus_pipeline.near_duplicates(spark, one, SF).cache()
    sets = {r["doc_id"]: Counter(zip(*[WORD.findall(r["text"])[j:] for j in range(5)])) for r in one.collect()}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and group[i] != group[j] and _jaccard(sets[i], sets[j]) >= 0.8:
                lo, hi = sorted((group[i], group[j]))
                group = {x: lo if g == hi else g for x, g in group.items()}
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(set(group.values()))
    three = corpus_pipeline.repeated_passages(spark, two, SF).cache()
    cut = _removed([(r["doc_id"], r["text"]) for r in two.collect()], 20)
    assert {r["doc_id"]: WORD.findall(r["text"]) for r in three.collect()} == cut
    four = corpus_pipeline.source_weights(spark, three, SF).cache()
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    taken = defaultdict(int)
    for r in four.collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
    size = defaultdict(int)
    for r in three.collect():
        size[r["source"]] += len(WORD.findall(r["text"]))
    target, open_ = {}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    left = sum(size.values())
    while True:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] >= 3 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * size[s]
            left -= target[s]
            del open_[s]
    target |= {s: level * w for s, w in open_.items()}
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    last = corpus_pipeline.tokens(spark, four, SF).collect()
    mixed = Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in four.collect())
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in last) == mixed
    by_text = {hashlib.sha256(r["text"].encode()).hexdigest(): r["text"] for r in four.collect()}
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == ENCODING.encode_ordinary(by_text[r["decoded_sha256"]]) for r in last[:40])


def test_chat_budget_counts_control_strings(spark):
    rows = [(1, i, "user", "") for i in range(2000)]
    windows = chat_windows.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), VOCABULARY, PATTERN).collect()
    assert len(windows) > 10 and all(w["n_tokens"] <= 512 and len(w["formatted"]) < 6000 for w in windows)
