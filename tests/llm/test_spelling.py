"""Spelling variants against all pairs in plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from roomcast.llm import spelling
from roomcast.llm.queries import QUERIES
from tests.llm.helpers import awkward_documents, folder_with

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _counts(docs):
    counts = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def _rows(counts):
    out, form = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if _near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v)) if near else None
        form[w] = best if best is not None and counts[best] >= 5 * n else None
        out[w] = (n, len(near), counts[form[w]] if form[w] else None)
    rows = set()
    for w, (n, near, form_n) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, near, form_n))
    return rows


def _got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_pairs_of_dense_words(spark, levels):
    rng = np.random.default_rng(levels)
    words = sorted({"".join(rng.choice(list("aé"), int(n))) for n in rng.integers(6, 11, 250)})
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, word string")
    got = Counter(tuple(sorted(r)) for r in spelling.near_pairs(df, levels).collect())
    want = Counter((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and _near(a, b))
    assert got == want and len(want) > 300


def test_variants_and_chains(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "zzzzzz": 7, "zzzzzy": 35, "zzzzzx": 35, "zzzzzzw": 34, "qqqqqqq": 9}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = _got(spelling.variants(df))
    assert got == _rows(counts)
    assert ("aaaaaa", "aaaaab", "aabbbb", 5, 1, 25) in got and ("zzzzzz", "zzzzzx", "zzzzzx", 7, 3, 35) in got


def test_query_on_awkward_documents(spark, tmp_path):
    rng = np.random.default_rng(4)
    stems = ["".join(rng.choice(list("abcdeÉéß×"), 7)) for _ in range(40)]
    texts = []
    for i in range(120):
        words = [stems[int(x)] for x in rng.zipf(1.3, 60) % 40]
        words = [w[:j] + w[j + 1 :] if rng.random() < 0.2 and (j := int(rng.integers(0, 7))) >= 0 else w for w in words]
        texts.append((i if i % 9 else None, " ".join(words).replace("a", "A") + ", 12-abcdef_ABCDEF", "x", "y", "clash"))
    docs = awkward_documents(spark)
    docs = docs.unionByName(spark.createDataFrame([*texts, texts[1]], docs.schema))
    folder = folder_with(spark, tmp_path, documents=docs)
    counts = _counts([(r["doc_id"], r["text"]) for r in docs.collect()])
    want = _rows(counts)
    assert _got(QUERIES["op11_spelling"](spark, folder)) == want
    assert len(want) > 60 and any(form for _, form, *_ in want)


def test_counts_are_handed_on(spark):
    docs = awkward_documents(spark)
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, 5, held_words=3).collect()}
    assert got == _counts([(r["doc_id"], r["text"]) for r in docs.collect()])
