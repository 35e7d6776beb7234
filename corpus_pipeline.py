"""The corpus pipeline: five stages, each over all that the one before kept.

``STAGES`` lists (name, function).  A function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet to the shared folder and read
again as the next one's docs.  All but the last return the columns of documents.

Defined cases, for every stage: an empty table gives an empty one; texts of any length
count whole; columns beside those of documents come through as they are, whatever
their names, but for the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shared import drop_path, materialize, scratch
from tessera.llm import decontaminate, jaccard, language, mix, shard
from tessera.llm._text import held_out
from tessera.llm.queries import SHARDS, WINDOW_WORDS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go: without letters, or unlike all languages learned.

    A null or empty text has no letters and goes; a row with a null id or language
    teaches nothing but is judged; repeated rows are judged alike.  Without any text to
    learn from, all go.
    """
    model = language.learn(docs.where(~held_out("doc_id", 4, 2)))
    return language.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles at similarity 0.8 connect, the document with the smallest id stays.

    Of rows alike in id and text one stays; of one id's unlike texts each is a document;
    texts without words are alike only where id and text are; rows with a null id stay.
    """
    return jaccard.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go.

    A null or empty text has no words and stays; repeated rows and rows with a null id
    are judged each by itself; an empty benchmark contaminates nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_contamination(docs, items, mode="documents", width=WINDOW_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix uses them; each at least once, none more often than the limit.

    A null source is a source; a null or empty text counts as one token; rows with a
    null id and repeated rows are rows like others, in an order that ties leave open.
    """
    return mix.mixed(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and place in it.

    Null ids sort first, a null text has no bytes, and rows alike in id and text stand
    in any order beside each other.
    """
    found = shard.assign_shards(docs, SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: Language models are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's tables go when it is written, its result when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            docs = materialize(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        if before is not None:
            drop_path(before._tessera_path)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
