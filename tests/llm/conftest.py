import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs, or (id, text, lang, source)."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark, docs_of):
    """Nulls, empty and very long texts, repeated rows, a null id, and columns with clashing names."""
    from pyspark.sql import functions as F

    long = "The quick brown fox jumps over the lazy dog and runs. " * 4000
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, long), (5, long), (6, long[:-5]), (None, "nobody knows this id"), (7, "été à la plage ñandú größe 日本語 😀")]
    extra = {c: F.lit("mine") for c in ("score", "rejected", "node", "size", "n", "offset", "rank", "shard", "bucket", "__x")}
    return docs_of(rows).withColumns(extra)
