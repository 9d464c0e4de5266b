"""Small documents with the awkward cases that every operator must handle."""

import os
import shutil

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels", "conversations", "benchmark")


def prose(rng, n, words=400):
    return " ".join(f"w{int(x)}" for x in rng.integers(0, words, n))


def awkward_documents(spark):
    """Nulls, empty and blank texts, a long one, copies, repeated rows, shared passages, an odd extra column."""
    rng = np.random.default_rng(7)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(rng, 30, 5000)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, " ".join(near), "en", None),
        (4, None, None, None),
        (5, "", "en", "b"),
        (6, " \n\t ", "de", "b"),
        (7, "one two", "de", "b"),
        (8, "one  two", "de", "c"),
        (9, prose(rng, 60) + " " + passage + " " + prose(rng, 60), "en", "c"),
        (10, prose(rng, 60) + "\n" + passage + " " + prose(rng, 5), "en", "c"),
        (11, prose(rng, 30000, 9000), "fr", "d"),
        (12, "same " * 300, "fr", "d"),
        (12, "same " * 300, "fr", "d"),
        (13, "x" * 70000, "fr", "d"),
        (14, passage + " " + passage, "fr", "e"),
        (None, base, "en", "e"),
        (15, "é\u2028ñ <|x|> ### | & " * 40, "es", "e"),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, size string")


def folder_with(spark, tmp_path, **frames):
    """A folder like the driver's, with some tables replaced."""
    for name in TABLES:
        target = os.path.join(tmp_path, f"{name}.parquet")
        if name in frames:
            frames[name].coalesce(2).write.mode("overwrite").parquet(target)
        else:
            shutil.copy(f"{SF}/{name}.parquet", target)
    return str(tmp_path)


def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con
