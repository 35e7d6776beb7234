"""Registered queries against their SQL, and the pipeline against brute force, stage by stage."""

import pytest
from pyspark.sql import functions as F
from compare import same_rows
from test_operators import brute_classes, brute_hits, brute_shards

import corpus_pipeline
from tessera.llm import mix, queries
from tessera.llm._state import materialize


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_oracle(spark, duck, sf_dir, key):
    assert same_rows(spark, duck, sf_dir, queries.QUERIES[key], queries.ORACLE[key]) == 200


def test_all_ten_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir), name)
        before = {r["doc_id"]: r for r in docs.collect()}
        rows = out.collect()
        after = {r["doc_id"] for r in rows}
        assert after <= set(before)
        if name == "language_id":
            assert len(rows) >= 0.99 * n and out.columns == docs.columns
        elif name == "near_duplicates":
            classes = brute_classes([(i, r["text"]) for i, r in before.items()])
            assert after == {c for c, _ in classes.values()} and len(rows) == len(after)
        elif name == "decontamination":
            assert after == {i for i, r in before.items() if not brute_hits(r["text"], items)[4]}
        elif name == "mixing":
            assert after == set(before) and len(rows) == mix.mix(docs)[0].count() and out.columns == docs.columns
            assert all(r == before[r["doc_id"]] for r in rows)
        else:
            assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows) == brute_shards([(r["doc_id"], r["text"]) for r in docs.collect()], 24)
        docs = out


AWKWARD_TEXTS = [None, "", "...", "one two", " " * 1_000_000, "\n" * 300_000, "a" * 400_000, "é " * 100_000, "The quick brown fox jumps over the lazy dog and runs. " * 4000, "été à la plage ñandú größe 日本語 😀"]
PLAIN_TEXTS = [f"In year {k} the quiet river {a} past the old mill and the {b} people of the village walked home by its bank in the evening" for k, (a, b) in enumerate((a, b) for a in ("ran", "flowed", "went", "rolled", "moved") for b in ("young", "tired", "happy", "poor"))]
CLASHES = ("score", "predicted", "held_out", "rejected", "node", "label", "size", "n", "offset", "rank", "shard", "bucket", "hash", "spans", "text_crc32", "key", "epoch", "__id", "__hash", "__text", "__n_hit", "__rejected", "__k0", "___id")


@pytest.fixture(scope="module")
def awkward_dir(spark, tmp_path_factory):
    """Tables with nulls in every column, very long texts, repeated rows, null ids and names that clash."""
    top = str(tmp_path_factory.mktemp("awkward"))
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 4 else None, len(t or "")) for i, t in enumerate(AWKWARD_TEXTS)]
    rows += [rows[8], (None, "nobody knows this id at all, so it says", None, None, None), (None, "nobody knows this id at all, so it says", None, None, None), (77, None, None, None, None)]
    rows += [(100 + k, t, "en", "s", len(t)) for k, t in enumerate(PLAIN_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit("mine") for c in CLASHES}).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, None, 1), (None, 1, 1), (8, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs"), (1, None), (None, "one two"), (2, ""), (3, "one two")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


@pytest.fixture(scope="module")
def empty_dir(spark, awkward_dir, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{awkward_dir}/{t}.parquet").limit(0).write.parquet(f"{top}/{t}.parquet")
    return top


@pytest.fixture(scope="module")
def unlabelled_dir(spark, awkward_dir, tmp_path_factory):
    """No language and no label to learn from."""
    top = str(tmp_path_factory.mktemp("unlabelled"))
    spark.read.parquet(f"{awkward_dir}/documents.parquet").withColumn("lang", F.lit(None).cast("string")).write.parquet(f"{top}/documents.parquet")
    spark.read.parquet(f"{awkward_dir}/labels.parquet").limit(0).write.parquet(f"{top}/labels.parquet")
    spark.read.parquet(f"{awkward_dir}/benchmark.parquet").write.parquet(f"{top}/benchmark.parquet")
    return top


@pytest.mark.parametrize("key", sorted(queries.QUERIES))
def test_queries_on_awkward_tables(spark, awkward_dir, empty_dir, unlabelled_dir, key):
    n = len(AWKWARD_TEXTS) + 4 + len(PLAIN_TEXTS)
    for top in (awkward_dir, unlabelled_dir) if key.startswith(("op1_", "op2_", "op7_")) else (awkward_dir,):
        rows = queries.QUERIES[key](spark, top).collect()
        assert len(rows) >= n if key.startswith(("op5", "op10")) else len(rows) == n
        assert {r["doc_id"] for r in rows} == {*range(len(AWKWARD_TEXTS)), 77, None, *range(100, 100 + len(PLAIN_TEXTS))}
    if key.startswith("op7"):
        assert {r["lang_pred"] for r in rows} == {"und"}
    assert queries.QUERIES[key](spark, empty_dir).count() == 0


def test_stages_on_awkward_tables(spark, awkward_dir, empty_dir, unlabelled_dir):
    for top, some in ((awkward_dir, True), (empty_dir, False), (unlabelled_dir, False)):
        docs = spark.read.parquet(f"{top}/documents.parquet")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, top), name)
            assert name == "sharding" or docs.columns == columns
            assert (docs.count() > 0) == some, (top, name)
            if name != "sharding":
                assert docs.where("key <> 'mine' OR __id <> 'mine' OR size <> 'mine'").count() == 0
        if some:  # gone: without letters, or with an item's window; kept: all of the plain ones
            ids = {r["doc_id"] for r in docs.collect()}
            assert not ids & {0, 1, 2, 3, 4, 5, 8} and ids >= set(range(100, 100 + len(PLAIN_TEXTS)))


def test_run_is_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["shard"] for r in rows} <= set(range(24)) and len(rows) > 100
