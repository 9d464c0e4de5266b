"""Queries with SQL equal DuckDB, on the driver's tables and on awkward ones."""

import pytest

from roomcast.llm.oracles import ORACLES
from roomcast.llm.queries import QUERIES
from tests.llm.helpers import SF, awkward_documents, duck, folder_with
from tools.check_oracle import _rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(duck(SF).execute(ORACLES[name]).df())


def _distinct_ids(spark):
    """The awkward documents that SQL by doc_id can tell apart."""
    return awkward_documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])


@pytest.mark.parametrize("name", ["op6_fm_dedup", "op7_source_mix", "op8_bagminhash"])
def test_awkward_documents(spark, tmp_path, name):
    folder = folder_with(spark, tmp_path, documents=_distinct_ids(spark))
    assert _rows(QUERIES[name](spark, folder).toPandas()) == _rows(duck(folder).execute(ORACLES[name]).df())


def test_awkward_pages(spark, tmp_path):
    rows = [
        (1, None, None), (2, "no scheme", ""), (3, "HTTP://A.Org", "x"), (4, "http://EXAMPLE.org/en/19?q", "x"),
        (5, "http://b.example.org/es/1#y", "<a href='http://bad.net/1'>"), (6, "ftp://c.com/de/", '<a HREF="//b.example.org/x">'),
        (7, "http://bad.net/", '<a href="http://c.com/fr/">'), (8, "x://y://z/fr/", "x"), (9, "http://good.net/a b\r\n", '<a href=http://bad.net>'),
        (10, "http://org/", "é" * 100000),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, rule string")
    folder = folder_with(spark, tmp_path, pages=pages)
    for name in ("op3_host_trust", "op4_warc_zst"):
        assert _rows(QUERIES[name](spark, folder).toPandas()) == _rows(duck(folder).execute(ORACLES[name]).df()), name


def test_awkward_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, -0.5 * (i % 3)]) for i in range(300)]
    rows += [(20, None), (21, [1.0, None, 0.0]), (22, [nan, 0.0, 0.0]), (40, [inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (60, [1.0]), (400, [])]
    rows += [(i, [1.0, 1.0, 1.0]) for i in range(500, 700)] + [(0, [0.0, 1.0, -0.0])] * 3
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id long, embedding array<float>, label int, id string")
    folder = folder_with(spark, tmp_path, embeddings=df)
    got = QUERIES["op9_cover_tree"](spark, folder).toPandas()
    assert _rows(got) == _rows(duck(folder).execute(ORACLES["op9_cover_tree"]).df())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    names = ("documents", "embeddings", "pages", "labels", "conversations")
    folder = folder_with(spark, tmp_path, **{t: spark.read.parquet(f"{SF}/{t}.parquet").limit(0) for t in names})
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == (1 if name.startswith("op10_") else 0)


def _linked_pages(spark, links, own=()):
    """One page for each (url, linked urls)."""
    rows = [(i, url, " ".join(f'<a href="{to}">' for to in tos)) for i, (url, tos) in enumerate([*links, *own])]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_distrust_reaches_the_end_of_a_chain(spark, tmp_path):
    chain = [(f"http://h{i}.net/", [f"http://h{i + 1}.net/"]) for i in range(18)] + [("http://h18.net/", ["http://x.com/de/1"])]
    ring = [("http://a.net/", ["http://b.net/", "http://x.com/de/1"]), ("http://b.net/", ["http://a.net/", "http://a.net/2"])]
    pages = _linked_pages(spark, [*chain, *ring], [("http://x.com/de/1", []), ("http://x.org/", ["http://b.net/"]), (None, ["http://a.net/"])])
    pages = pages.unionByName(pages.filter("page_id in (3, 20)"))  # repeated rows
    pages = pages.unionByName(pages.filter("page_id = 5").selectExpr("cast(null as long) as page_id", "url", "html"))
    folder = folder_with(spark, tmp_path, pages=pages)
    got = QUERIES["op3_host_trust"](spark, folder).toPandas()
    assert _rows(got) == _rows(duck(folder).execute(ORACLES["op3_host_trust"]).df())
    assert set(got[got.host.str.match(r"h\d")].verdict) == {"block"} and len(got) == 27


def test_mix_of_rows_with_equal_keys(spark, tmp_path):
    rows = [(None if i % 3 else i, f"{i} 1 2 3", "en", "a" if i % 4 else "b") for i in range(400)] + [(7, "w w", "en", "a")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = QUERIES["op7_source_mix"](spark, folder_with(spark, tmp_path, documents=docs)).collect()
    for s in ("a", "b"):
        own = [r for r in got if r["source_size"] == sum((4 if t != "w w" else 2) for _, t, _, x in rows if x == s)]
        assert len(own) == sum(x == s for *_, x in rows)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        # complete epochs for all, one row in part
        assert len({r["taken"] / r["size"] for r in own}) <= 3
