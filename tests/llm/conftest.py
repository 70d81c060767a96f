"""Small tables with nulls, empty texts, ties, repeated rows and clashing column names."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = (
    "doc_id long, text string, source string, lang string, n_chars long, id long, at string, fp long, "
    "row string, digest string, toxicity double, size int, `place` int"
)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(1.1)) % vocabulary}" for _ in range(n))


def make_rows():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append((i, words(rng, rng.randrange(1, 60)), f"s{i % 4}"))
    base = words(rng, 400)
    for i in range(60, 70):  # near copies
        parts = base.split()
        parts[i * 5] = f"changed{i}"
        rows.append((i, " ".join(parts), "s0"))
    rows += [(70, rows[5][1].upper(), "s1"), (71, rows[5][1], "s1"), (72, rows[5][1], None)]
    rows += [(73, None, "s2"), (74, "", "s2"), (75, " \t\n ", "s3"), (76, "one two", None)]
    rows += [(None, "no id here", "s1"), (None, None, None), (77, "twice", "s1"), (77, "twice", "s1")]
    rows += [(78, "été Ünïcode 中文 𝄞   nbsp", "s0"), (79, words(rng, 30_000), "s0")]
    rows += [(80, 'a password = "Abcdefgh12345" b AKIA' + "Z9" * 8 + " " + "0af3" * 5, "s1")]
    return [(i, t, s, "en", len(t or ""), 1, "x", 2, "r", "d", 0.5, 3, 4) for i, t, s in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark, rows):
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())]
    )
    data = [(i, i % 2, i % 3 // 2) for i in range(60)] + [(3, 1, 0), (None, 1, 1), (4, None, None), (10**9, 0, 1)]
    return spark.createDataFrame(data, schema)
