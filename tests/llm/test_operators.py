"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import base64
import hashlib
import io
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, jaccard, language, media, mix, quality, queries, shard, substrings, tokens, toxicity
from tessera.llm._text import Block, Words, run_hashes, slices
from tessera.llm.suffix_array import suffix_array

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    raw = (text or "").encode()
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in raw))


# -- plumbing


def test_words_of_blocks():
    texts = ["Hello wörld X1", "", None, "tail", "a-b c"]
    block = Block(pa.array(texts))
    w = Words(block)
    for i, t in enumerate(texts):
        own = [w.data[s:e].tobytes() for s, e in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)]
        assert own == words_of(t)


def test_equal_runs_have_equal_hashes():
    v = np.frombuffer(b"abcXabcYab", np.uint8)
    h = run_hashes(v, np.array([0, 4, 0, 8]), np.array([3, 7, 2, 10]))
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (10, 50, 200, 0, 5)] + [None])], names=["t"])
    parts = list(slices(batch, 0, 60))
    assert sum(p.num_rows for p in parts) == 6 and len(parts) == 3


# -- 1 and 2: classifiers


def _accuracy(spark, sf, key, label):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    rows = queries.QUERIES[key](spark, sf).join(labels, "doc_id").where("held_out").collect()
    good = [r["score"] for r in rows if r[label] == 1]
    bad = [r["score"] for r in rows if r[label] == 0]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)), rows


def test_quality_on_held_out(spark):
    area, rows = _accuracy(spark, "/root/testdata/sf0.1", "op1_quality_compression", "quality")
    assert area > 0.97
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_toxicity_on_held_out(spark):
    # Some 300 toxic texts to learn from; with a full sample the area is above 0.999.
    area, rows = _accuracy(spark, "/root/testdata/sf0.1", "op2_toxicity_gru", "toxic")
    assert area > 0.9
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.93


def test_classifiers_take_anything(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.learn(awkward, labels, label)
        rows = module.score(awkward, model).collect()
        assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["node"] == "mine" for r in rows)
        empty = module.learn(awkward.limit(0), labels.limit(0), label)
        assert module.score(awkward.limit(0), empty).count() == 0
        assert module.score(awkward, empty).count() == 9


def test_network_gradient():
    net = toxicity.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = toxicity.Input(Block(pa.array(["some words here and there to be scored", "", "stupid idiot " * 30])))
    logit, held = net.forward(x, keep=True)
    weight = np.linspace(0.5, 1.5, len(logit))
    g = net.gradient(x, weight, held)
    r = np.random.default_rng(0)
    for name in ("wx", "uf", "ub", "wa", "va", "out", "bias", "bx", "ba", "word", "tri"):
        at = tuple(r.integers(0, s) for s in net.p[name].shape) if name not in ("word", "tri") else (int((x.words if name == "word" else x.tri)[0]), 1)
        keep = net.p[name][at]
        values = []
        for step in (1e-3, -1e-3):
            net.p[name][at] = keep + step
            values.append(float((net.forward(x)[0] * weight).sum()))
        net.p[name][at] = keep
        assert (values[0] - values[1]) / 2e-3 == pytest.approx(float(g[name][at]), rel=2e-2, abs=2e-3), name


def test_awkward_scores(spark, awkward):
    """Null, empty and wordless texts have the score that the docstrings name; equal texts have equal ones."""
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 4 == 0)) for i in range(2, 60)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(i, f"{'fine words of text' if i % 4 else 'stupid hateful idiots'} number {i} " * 9) for i in range(2, 60)], "doc_id long, text string")
    held = spark.range(60).where(queries.held_out(F.col("id"), 5, 0)).count()
    assert held
    q, t = quality.learn(texts, labels), toxicity.learn(texts, labels)
    assert q.good and t.weights
    for module, model, empty in ((quality, q, q.prior), (toxicity, t, 0.0)):
        rows = module.score(awkward, model).collect()
        assert [r["score"] for r in rows if not r["text"]] == [empty] * 2
        assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    assert {r["score"] for r in toxicity.score(awkward, t).where("doc_id = 3").collect()} == {0.0}


def test_quality_is_the_difference_of_sizes(spark):
    """The score again by compressing plainly."""
    import zstandard

    good, bad = b"the quiet river runs by the old mill " * 30, b"BUY NOW!!! cheap cheap $$$ click " * 30
    model = quality.QualityModel(good, bad, -25.0, 0.5, 0.7)
    text = "the old mill by the quiet river, cheap " * 20

    def size(raw, dictionary):
        to = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False, write_checksum=False)
        return sum(len(to.compress(raw[k : k + quality.PIECE_BYTES])) for k in range(0, len(raw), quality.PIECE_BYTES))

    raw = text.encode()
    want = 1 / (1 + np.exp(-(0.5 - 25.0 * (size(raw, good) - size(raw, bad)) / len(raw))))
    assert model.scorer()(raw) == pytest.approx(want)
    rows = quality.score(spark.createDataFrame([(text,)], "text string"), model).collect()
    assert rows[0]["score"] == pytest.approx(want) and rows[0]["predicted"] == int(want >= 0.3)


def test_network_forward_step_by_step():
    """Scores of whole texts by plain loops over windows, words and units."""
    net = toxicity.Network(9)
    p = {k: v.astype(float) for k, v in net.p.items()}
    texts = ["one two three", "Some Words été " * 25, "x"]
    model = toxicity.ToxicityModel(net.p, 1.3, 0.2, 0.1)
    found = model.scorer()(Block(pa.array(texts)))
    sig = lambda v: 1 / (1 + np.exp(-v))
    u, w = toxicity.UNITS, toxicity.WINDOW

    def vector(word):
        h = Words(Block(pa.array([word.decode()]))).hashes()[0]
        raw = [1, *word, 2]
        rows = [int(toxicity.mix64(np.array([(raw[k - 1] << 16) | (raw[k] << 8) | raw[k + 1]], np.uint64))[0] % np.uint64(toxicity.TRIGRAM_ROWS)) for k in range(1, len(raw) - 1)]
        return p["word"][int(h % np.uint64(toxicity.WORD_ROWS))] + p["tri"][rows].mean(axis=0)

    def run(vectors, which, cells):
        h, out = np.zeros(u), []
        for e in vectors:
            g = (e @ p["wx"] + p["bx"])[which * 3 * u : (which + 1) * 3 * u]
            z, r = sig(g[:u] + h @ cells[:, :u]), sig(g[u : 2 * u] + h @ cells[:, u : 2 * u])
            c = np.tanh(g[2 * u :] + (r * h) @ cells[:, 2 * u :])
            h = (1 - z) * h + z * c
            out.append(h)
        return out

    for text, got in zip(texts, found, strict=True):
        words, logits, at = words_of(text), [], 0
        while True:
            vectors = [vector(x) for x in words[at : at + w]]
            hs = [np.concatenate(x) for x in zip(run(vectors, 0, p["uf"]), run(vectors[::-1], 1, p["ub"])[::-1], strict=True)]
            weight = np.array([np.exp(np.tanh(h @ p["wa"] + p["ba"]) @ p["va"]) for h in hs])
            logits.append(sum(x * h for x, h in zip(weight / weight.sum(), hs, strict=True)) @ p["out"] + p["bias"][0])
            if at + w >= len(words):
                break
            at += toxicity.STRIDE
        assert got == pytest.approx(sig(1.3 * np.log(np.exp(logits).sum()) + 0.2), abs=1e-4)


def test_many_windows_at_a_time(monkeypatch):
    net = toxicity.Network(2)
    x = toxicity.Input(Block(pa.array(["some words to be scored " * 200, "", "few"])))
    whole = net.forward(x)[0]
    monkeypatch.setattr(toxicity, "WINDOWS_AT_ONCE", 7)
    assert len(whole) > 20 and np.allclose(net.logits(x), whole, atol=1e-5)


def test_windows_cover_every_word():
    text = " ".join(f"w{i}" for i in range(203))
    x = toxicity.Input(Block(pa.array([text, "a", ""])))
    assert x.bounds.tolist() == [0, x.bounds[1], x.bounds[1] + 1, x.bounds[1] + 1]
    assert set(x.index[x.mask > 0].tolist()) == set(range(len(x.words)))


# -- 3: Jaccard join


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both * 9 >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (root(i), links[i]) for i in ids}


def _near_texts(n, seed=1):
    r = random.Random(seed)
    base = [f"word{r.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_jaccard_against_brute_force(spark, documents):
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(documents).collect()}
    assert got == brute_classes(rows)


def test_jaccard_of_a_crowd_in_blocks(spark, docs_of):
    rows = _near_texts(90) + [(1000 + i, " ".join(f"x{i}y{k}" for k in range(40))) for i in range(20)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(docs_of(rows), block=16).collect()}
    assert got == brute_classes(rows)


def test_jaccard_awkward(spark, awkward):
    rows = jaccard.jaccard_classes(awkward).collect()
    assert len(rows) == 9
    by = {(r["doc_id"], r["class_id"]): r["n_links"] for r in rows}
    assert by[(1, 1)] == 0 and by[(2, 2)] == 0 and by[(3, 3)] == 0
    assert by[(5, 5)] == 2 and by[(6, 5)] == 2  # both copies, or the copy and the near one
    assert by[(None, None)] == 0
    kept = jaccard.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "None"])
    assert jaccard.jaccard_classes(awkward.limit(0)).count() == 0


def test_hot_sets_are_not_dealt_by_node(spark, docs_of):
    """Most rows are copies of one text: they keep their links and classes, and null ids theirs."""
    docs = docs_of([(i, "the same words in each of these many rows") for i in range(500)] + [(None, "the same words in each of these many rows")] * 3 + [(1000 + i, f"text {i} of its own with words of number {i} only") for i in range(40)])
    got = jaccard.jaccard_classes(docs).groupBy("class_id", "n_links").count().collect()
    assert sorted((str(r["class_id"]), r["n_links"], r["count"]) for r in got) == sorted([("0", 499, 500), ("None", 0, 3), *((str(1000 + i), 0, 1) for i in range(40))])


def test_classes_of_other_ids(spark, docs_of):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = docs_of([(2, text), (1, text + " thirteen"), (3, "quite another text than the others of this table")]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == {"d1": ("d1", 1), "d2": ("d1", 1), "d3": ("d3", 0)}
    mine = docs.withColumn("__id", F.lit("mine")).withColumn("__hash", F.lit("mine")).withColumn("node", F.lit("mine"))
    kept = jaccard.keep_first(mine)
    assert kept.columns == mine.columns and {(r["doc_id"], r["__id"], r["__hash"]) for r in kept.collect()} == {("d1", "mine", "mine"), ("d3", "mine", "mine")}


def test_sets_of_one_number_stay_apart(spark, docs_of, monkeypatch):
    """All sets share the first number: the second tells them apart."""
    docs = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, "p q r s t u"), (4, "z")])
    rows = jaccard._describe(docs, "doc_id", "text")
    rows = rows.withColumn("node", F.lit(5).cast("long"))
    monkeypatch.setattr(jaccard, "_describe", lambda *a: rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}


def test_unlike_texts_of_one_id_both_stay(spark, docs_of):
    a, b = "one two three four five six seven eight nine ten " * 3, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3
    kept = jaccard.keep_first(docs_of([(1, a), (1, b), (2, a), (3, b), (4, ""), (4, "..."), (4, "...")]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b), (4, ""), (4, "...")])


def test_pruning_keeps_the_threshold():
    """After n values, pairs at the threshold fall below the least number of matches next to never, unlike ones nearly always."""
    r = np.random.default_rng(8)
    for n, least in jaccard.least_matches():
        assert (r.binomial(n, 0.8, 200_000) < least).mean() < 1e-4
    n, least = jaccard.least_matches()[-1]
    assert (r.binomial(n, 0.4, 10_000) >= least).mean() < 0.01


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == root(x) for x in got)
    assert all(x in got for a, b in edges if a != b for x in (a, b))


# -- 4: suffix arrays


def test_suffix_array():
    r = random.Random(4)
    for _ in range(600):
        s = [r.randrange(r.choice([1, 2, 4, 30]) + 1) for _ in range(r.randrange(40))]
        s = s[: len(s) // 3] * 3 if r.random() < 0.3 else s
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_array([5] * 50) == list(range(49, -1, -1))


def brute_spans(rows, length=50):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each (id, text), in order of id; rows of one id see each other not."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out)


def _found(df, **options):
    return sorted(tuple(r)[:5] for r in substrings.repeated_spans(df, **options).collect())


def test_spans_against_brute_force(spark, documents):
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    assert _found(documents) == brute_spans(rows)


def test_spans_of_patched_texts(spark, docs_of):
    r = random.Random(9)
    parts = ["".join(r.choice("ab é") for _ in range(r.randrange(20, 130))) for _ in range(12)]
    rows = [(i, "".join(r.choice(parts) + r.choice(["", "x", "yz"]) for _ in range(r.randrange(0, 9)))) for i in range(60)]
    rows += [(100, "a" * 300), (101, "a" * 49), (102, "a" * 50), (103, "a" * 500), (103, "a" * 60), (104, "ab" * 100), (105, "ba" * 100)]
    assert _found(docs_of(rows)) == brute_spans(rows)
    assert _found(docs_of(rows), length=30) == brute_spans(rows, 30)


@pytest.mark.parametrize("length", [16, 17, 30, 50, 78])
def test_spans_of_hot_anchors(spark, docs_of, length):
    """Every anchor hot, in packs of a few texts: contexts are split by what stands beside the anchor."""
    r = random.Random(length)
    parts = ["".join(r.choice("ab é") for _ in range(r.randrange(10, 90))) for _ in range(9)]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(0, 7)))) for i in range(80)]
    assert _found(docs_of(rows).repartition(6), length=length, hot_packs=1, buckets=7) == brute_spans(rows, length)


def test_spans_when_hashes_collide(spark, docs_of, monkeypatch):
    """Contexts of one hash are told apart by their bytes."""
    r = random.Random(5)
    parts = ["".join(r.choice("abc") for _ in range(r.randrange(20, 90))) for _ in range(6)]
    rows = [(i, "".join(r.choice(parts) for _ in range(5))) for i in range(30)]
    found = []
    monkeypatch.setattr(substrings, "context_keys", lambda data, at, left, right: np.zeros(len(at), np.uint64))
    pack = substrings._pack(docs_of(rows).coalesce(1), "doc_id", "text").collect()[0]["blob"]
    whole = substrings.Pack(bytes(pack), 50)
    every = {k: (substrings._to_bytes(np.sort(np.unique(substrings._six(whole.h, 4)[whole.h % np.uint64(4) == k]))), b"") for k in range(4)}
    d = substrings.Distinct(whole, 4, every)
    for at, rank in zip(d.at, d.rank, strict=True):
        one = d.at[d.first[rank]]
        b = lambda k: (int(min(whole.at[k] - whole.block.starts[whole.doc[k]], 34)), whole.block.data[max(whole.block.starts[whole.doc[k]], whole.at[k] - 34) : min(whole.block.ends[whole.doc[k]], whole.at[k] + 50)].tobytes())
        found.append(b(at) == b(one))
    assert all(found) and len(found) > 50


def test_removal_keeps_columns(spark, docs_of):
    long = "a passage of more than fifty bytes that two documents share word for word"
    docs = docs_of([(1, "first " + long), (2, long + " second"), (3, None)]).withColumn("spans", F.lit("mine")).withColumn("text_crc32", F.lit("mine")).withColumn("__id", F.lit("mine"))
    cut = substrings.remove_spans(docs, substrings.repeated_spans(docs))
    assert cut.columns == docs.columns
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert bytes(rows[2]["text"]) == b" second" and bytes(rows[1]["text"]).startswith(b"first a passage") and bytes(rows[3]["text"]) == b""
    assert all((r["spans"], r["text_crc32"], r["__id"]) == ("mine",) * 3 for r in rows.values())


def test_spans_of_other_ids(spark, docs_of):
    strings = docs_of([(1, "x" * 60)]).selectExpr("cast(doc_id as string) as doc_id", "text")
    with pytest.raises(TypeError, match="whole number"):
        substrings.repeated_spans(strings)
    small = docs_of([(1, "x" * 60), (2, "y" + "x" * 60)]).selectExpr("cast(doc_id as int) as doc_id", "text")
    assert [r[2] for r in _found(small)] == [0, 60]


def test_spans_awkward(spark, awkward):
    found = substrings.repeated_spans(awkward)
    rows = found.collect()
    assert len(rows) == 9
    assert [r["n_removed"] for r in rows if r["doc_id"] is None] == [0]
    assert {r["n_removed"] for r in rows if r["doc_id"] == 5} == {0}
    assert [r["n_removed"] == r["n_bytes"] for r in rows if r["doc_id"] == 6] == [True]
    left = substrings.remove_spans(awkward, found)
    assert left.columns == awkward.columns and left.count() == 9
    kept = {r["doc_id"]: r["kept_sha256"] for r in rows}
    assert all(hashlib.sha256(bytes(r["text"])).hexdigest() == kept[r["doc_id"]] for r in left.collect())
    assert substrings.repeated_spans(awkward.limit(0)).count() == 0


# -- 5: tokens


def test_tokens_add_up_and_match(spark, documents):
    rows = tokens.count_tokens(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    encoder = tokens.Encoder(tokens.read_vocabulary(spark, tokens.VOCABULARY))
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for i, own in by.items():
        ids = encoder.encoding.encode_ordinary(texts[i])
        assert sum(r["n_tokens"] for r in own) == len(ids) == own[0]["doc_tokens"]
        pieces = [encoder.encoding.decode_single_token_bytes(x) for x in ids]
        raw = texts[i].encode()
        assert b"".join(pieces) == raw
        # By brute force: the section that holds most bytes, the earlier of equals.
        own.sort(key=lambda r: r["section"])
        count, at = [0] * len(own), 0
        for p in pieces:
            held = [min(at + len(p), r["end_byte"]) - max(at, r["start_byte"]) for r in own]
            count[held.index(max(held))] += 1
            at += len(p)
        assert count == [r["n_tokens"] for r in own]


def test_tokens_of_given_sections(spark, docs_of):
    df = docs_of([(1, "héllo wörld again"), (2, "abc"), (3, ""), (4, None)]).withColumn("sections", F.expr("case when doc_id = 2 then array() else array(named_struct('start', 0, 'end', 6), named_struct('start', 6, 'end', 11)) end"))
    rows = {(r["doc_id"], r["section"]): r for r in tokens.count_tokens(df, sections="sections").collect()}
    assert sum(r["n_tokens"] for (i, _), r in rows.items() if i == 1) == rows[(1, 0)]["doc_tokens"]
    assert rows[(1, 0)]["end_byte"] == 7 and (1, -1) in rows
    assert rows[(2, -1)]["n_tokens"] == rows[(2, -1)]["doc_tokens"] > 0
    assert rows[(3, 0)]["n_tokens"] == 0 and rows[(4, 0)]["n_tokens"] == 0


def test_border_goes_to_the_larger_half():
    ends = np.array([4, 10, 12])
    count, crossing, outside = tokens.attribute(ends, np.array([0, 6, 7]), np.array([6, 7, 12]))
    assert count.tolist() == [1, 0, 2] and crossing.tolist() == [0, 0, 1] and outside == 0
    count, crossing, outside = tokens.attribute(np.array([4]), np.array([0, 2]), np.array([2, 4]))
    assert count.tolist() == [1, 0] and crossing.tolist() == [1, 0]


def test_tokens_of_long_runs(spark, docs_of):
    """A million characters of one kind; where short, cut or not gives the same tokens."""
    encoder = tokens.Encoder(tokens.read_vocabulary(spark, tokens.VOCABULARY))
    texts = [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "é!" * 400_000, " x" * 300_000, " " * 100_000 + "end"]
    rows = tokens.count_tokens(docs_of(list(enumerate(texts)))).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("m"), F.max("end_byte").alias("e")).collect()
    assert {r["doc_id"] for r in rows} == set(range(6)) and all(r["n"] == r["m"] for r in rows)
    assert {r["doc_id"]: r["e"] for r in rows} == {i: len(t.encode()) for i, t in enumerate(texts)}
    r = random.Random(4)
    for _ in range(30):
        t = "".join(r.choice(" \n\t\r  \x1c\x85 aZé日1२½!'’sdt") * r.choice((1, 1, 1, 7)) for _ in range(400))
        whole = encoder.ids(t)
        tokens.LONG_TEXT, before = 0, tokens.LONG_TEXT
        try:
            assert encoder.ids(t).tolist() == whole.tolist()
        finally:
            tokens.LONG_TEXT = before


def test_tokens_awkward(spark, awkward):
    assert {r["doc_id"] for r in tokens.count_tokens(awkward).collect()} == {1, 2, 3, 4, 5, 6, 7, None}
    assert tokens.count_tokens(awkward.limit(0)).count() == 0


# -- 6: media


def _images():
    r = np.random.default_rng(6)
    return r.integers(0, 256, (7, 13), dtype=np.uint8), r.integers(0, 256, (5, 6, 3), dtype=np.uint8)


def test_netpbm_and_bmp():
    grey, colour = _images()
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    assert (media.decode(b"P6\n# a comment\n6 5\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2 13 7 255\n" + b" ".join(b"%d" % v for v in grey.ravel())) == grey).all()
    bits = (grey > 127).astype(np.uint8)
    black = (1 - bits) * 255
    assert (media.decode(b"P4\n13 7\n" + np.packbits(bits, axis=1).tobytes()) == black).all()
    assert (media.decode(b"P1\n13 7\n" + b"".join(b"%d" % v for v in bits.ravel())) == black).all()
    deep = (grey.astype(np.uint16) * 200).astype(">u2")
    assert (media.decode(b"P5 13 7 65535\n" + deep.tobytes()) == deep).all()
    for bad in (b"", b"P5\n3 3\n255\nab", b"BM", b"GIF89a", b"P5\n3", b"P5 3 3 70000\n" + b"x" * 9):
        with pytest.raises((ValueError, IndexError, __import__("struct").error)):
            media.decode(bad)


def test_area_resize_is_the_mean_of_areas():
    grey, colour = _images()
    for image in (grey, colour):
        # By brute force: every pixel split into equal cells first.
        for rows, columns in ((3, 4), (8, 9), (1, 1), (7, 13)):
            fine = np.repeat(np.repeat(image.astype(float), rows, axis=0), columns, axis=1)
            want = fine.reshape((rows, image.shape[0], columns, image.shape[1]) + image.shape[2:]).mean(axis=(1, 3))
            assert np.allclose(media.area_resize(image, rows, columns), want)


def test_tiles_and_hashes(spark):
    import io

    grey, colour = _images()
    raw = [media.encode_pgm(grey), media.encode_bmp(grey), b"P6 6 5 255\n" + colour.tobytes(), b"junk", None]
    rows = media.media_tiles(spark.createDataFrame(list(enumerate(raw)), "id long, content binary")).orderBy("id").collect()
    assert rows[0]["dhash"] == rows[1]["dhash"] and rows[0]["tile"] == rows[1]["tile"]
    assert np.load(io.BytesIO(rows[2]["tile"])).shape == (32, 32, 3)
    assert rows[3]["error"] and rows[3]["tile"] is None and rows[4]["dhash"] is None
    flat = media.difference_hash(np.tile(np.arange(90, dtype=np.uint8), (8, 1)))
    assert flat == "f" * 16


def test_text_media_round_trip(spark, documents, awkward):
    for df in (documents, awkward):
        texts = df.select("doc_id", "text").collect()
        rows = media.text_media(df, keep=["doc_id"]).collect()
        assert len(rows) == len(texts)
        want = []
        for i, t in texts:
            raw = (t or "").encode()
            want.append((str(i), len(raw), raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))))
        assert sorted((str(r["doc_id"]), r["n_bytes"], bytes(r["payload"])) for r in rows) == sorted(want)
        assert all(media.decode(bytes(r["media"])).tobytes() == bytes(r["payload"]) for r in rows)
        assert all(np.load(io.BytesIO(r["tile"])).shape == (32, 32) for r in rows)
    assert media.text_media(awkward.limit(0)).count() == 0 and media.media_tiles(awkward.limit(0), "text").count() == 0


def test_maxval_and_masks():
    for top in (1, 3, 100, 255, 256, 1023, 65535):
        samples = np.array([[0, top // 2, top]])
        raw = b"P5 3 1 %d\n" % top + samples.astype(">u2" if top > 255 else np.uint8).tobytes()
        got, white = media.decode(raw), 65535 if top > 255 else 255
        assert got[0, 0] == 0 and got[0, 2] == white and abs(int(got[0, 1]) - white * (top // 2) / top) <= 0.5
        assert np.load(io.BytesIO(media.npy_tile(got, 3)))[0].tolist()[::2] == [0, 255]
        assert media.decode(b"P2 3 1 %d\n0 %d %d" % (top, top // 2, top)).tolist() == got.tolist()
    with pytest.raises(ValueError, match="maxval"):
        media.decode(b"P5 1 1 100\n\xff")

    def bmp(bits, packing, masks, body, width=2):
        head = struct.pack("<IiiHHIIiiII", 40, width, 1, 1, bits, packing, len(body), 0, 0, 0, 0) + masks
        return struct.pack("<2sIHHI", b"BM", 14 + len(head) + len(body), 0, 0, 14 + len(head)) + head + body

    rgb = [[[255, 0, 0], [0, 0, 255]]]
    assert media.decode(bmp(16, 0, b"", struct.pack("<HH", 0x7C00, 0x001F))).tolist() == rgb
    assert media.decode(bmp(16, 3, struct.pack("<III", 0xF800, 0x07E0, 0x001F), struct.pack("<HH", 0xF800, 0x001F))).tolist() == rgb
    assert media.decode(bmp(32, 3, struct.pack("<III", 0xFF, 0xFF00, 0xFF0000), struct.pack("<II", 0xFF, 0xFF0000))).tolist() == rgb
    assert media.decode(bmp(32, 0, b"", bytes([0, 0, 255, 0, 255, 0, 0, 0]))).tolist() == rgb
    with pytest.raises(ValueError, match="kind"):
        media.decode(bmp(24, 3, b"\0" * 12, bytes(8)))
    with pytest.raises(ValueError, match="gaps"):
        media.decode(bmp(16, 3, struct.pack("<III", 0xF0F0, 0, 0), bytes(4)))


def _plain_cells(image, rows, columns):
    """Means of areas by spreading every sample, one after the other."""
    h, w = image.shape
    out = np.zeros((rows, columns))
    for y in range(rows):
        for x in range(columns):
            y0, y1, x0, x1 = y * h / rows, (y + 1) * h / rows, x * w / columns, (x + 1) * w / columns
            wy = np.clip(np.minimum(np.arange(h) + 1, y1) - np.maximum(np.arange(h), y0), 0, None)
            wx = np.clip(np.minimum(np.arange(w) + 1, x1) - np.maximum(np.arange(w), x0), 0, None)
            out[y, x] = wy @ image @ wx / (wy.sum() * wx.sum())
    return out


def test_media_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op6_media_columns(spark, sf).collect()
    assert len(rows) == len(texts) and {r["media_format"] for r in rows} == {"bmp", "pgm"}
    for r in rows[::7]:
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        image = np.frombuffer(padded, np.uint8).reshape(-1, 64).astype(float)
        cells = np.round(_plain_cells(image, 8, 9), 6)
        bits = "".join("1" if cells[y, x + 1] > cells[y, x] else "0" for y in range(8) for x in range(8))
        tile = io.BytesIO()
        np.save(tile, np.floor(np.round(_plain_cells(image, 32, 32), 6) + 0.5).astype(np.uint8))
        assert r["feature"] == f"{int(bits, 2):016x}-{zlib.crc32(tile.getvalue()):08x}"
        stored = b"P5\n64 %d\n255\n" % len(image) + padded
        if r["media_format"] == "pgm":
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        else:
            assert r["media_bytes"] == 14 + 40 + 1024 + len(padded)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


# -- 7: languages


def test_kneser_ney_by_the_book():
    """Cross-entropies against a plain dictionary version over the same classes."""
    texts = {"a": ["the cat sat on the mat", "a hat"], "b": ["la casa de la mesa", "el gato"]}
    encoder = language.Encoder()
    table = lambda t: encoder.classes(np.array([ord(c) for c in t], np.uint32)).tolist()

    def line(text):
        out = [0] * 3
        for c in table(text):
            if c or out[-1] or len(out) < 3:
                out.append(c)
        return out

    def plain(corpus):
        levels = [dict() for _ in range(5)]
        for text in corpus:
            own = line(text)
            for k in range(3, len(own)):
                g = tuple(own[k - 3 : k + 1])
                levels[4][g] = levels[4].get(g, 0) + 1
        for n in (3, 2, 1):
            for g in levels[n + 1]:
                levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1

        def p(g):
            if not g:
                return 1 / language.CLASSES
            counts = levels[len(g)]
            ones, twos = (sum(1 for c in counts.values() if c == k) for k in (1, 2))
            d = ones / (ones + 2 * twos) if ones and twos else 0.75
            after = [c for x, c in counts.items() if x[:-1] == g[:-1]]
            if not after:
                return p(g[1:])
            return max(counts.get(g, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * p(g[1:])

        return p

    models = {}
    for name, corpus in texts.items():
        grams, _, _ = encoder.grams(Block(pa.array(corpus)))
        models[name] = language.KneserNey(*np.unique(grams.astype(np.int64), return_counts=True))
    bits, sizes, _ = language.Model(models).scorer()(Block(pa.array(["the casa", "zzz"])))
    for row, text in zip(bits, ["the casa", "zzz"], strict=True):
        own = line(text)
        for k, name in enumerate(sorted(texts)):
            p = plain(texts[name])
            assert row[k] == pytest.approx(-sum(np.log2(p(tuple(own[i - 3 : i + 1]))) for i in range(3, len(own))), rel=1e-4)


def test_language_on_held_out(spark, sf_dir):
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert sum(r["rejected"] for r in rows) <= 0.005 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_kneser_ney_sums_to_one():
    encoder = language.Encoder()
    grams, _, _ = encoder.grams(Block(pa.array(["the cat sat on the mat", "that hat is what it is"])))
    model = language.KneserNey(*np.unique(grams.astype(np.int64), return_counts=True))
    for context in (0, int(grams[5]) >> language.BITS, 12345):
        p = np.exp2(model.log2(np.arange(language.CLASSES) | (context << language.BITS)).astype(float))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_encoder_collapses_blanks():
    e = language.Encoder()
    a, _, _ = e.grams(Block(pa.array(["Ab,  c!"])))
    b, _, _ = e.grams(Block(pa.array(["  ab c."])))
    assert a.tolist() == b.tolist()
    texts = ["x y", "", None, "größe", "日本 😀 z"]
    joint, bounds, letters = e.grams(Block(pa.array(texts)))
    for i, t in enumerate(texts):
        alone, _, n = e.grams(Block(pa.array([t], pa.string())))
        assert joint[bounds[i] : bounds[i + 1]].tolist() == alone.tolist() and letters[i] == n[0]


def test_language_awkward(spark, documents, awkward):
    model = language.learn(documents)
    rows = {r["doc_id"]: r for r in language.identify(awkward, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(rows[i]["rejected"] for i in (1, 2, 3))
    assert rows[5]["lang_pred"] in model.langs
    kept = language.keep_identified(awkward, model)
    assert kept.columns == awkward.columns and kept.where("rejected <> 'mine'").count() == 0
    marked = documents.withColumn("rejected", F.lit("mine"))
    assert language.keep_identified(marked, model).where("rejected = 'mine'").count() >= 0.995 * documents.count()
    nothing = language.learn(awkward.limit(0))
    assert {r["lang_pred"] for r in language.identify(awkward, nothing).collect()} == {"und"}
    assert language.identify(awkward.limit(0), model).count() == 0


def test_foreign_text_is_rejected(spark, documents, docs_of):
    model = language.learn(documents)
    strange = docs_of([(1, "qxzkvw jjqxzz wvkqqz zzxqj " * 40), (2, "это русский текст о погоде и природе " * 20)])
    assert all(r["rejected"] for r in language.identify(strange, model).collect())


def test_rare_language_has_a_limit(spark, documents, docs_of):
    # 2,200 texts of the common languages; the rare one's id has the highest hash of all.
    common = documents.crossJoin(spark.range(11).withColumnRenamed("id", "k")).withColumn("doc_id", F.expr("doc_id * 11 + k")).drop("k").where("text IS NOT NULL")
    rare = spark.range(100000, 200000).orderBy(F.xxhash64("id", F.lit(7)).desc()).first()["id"]
    text = "Ala ma kota, a kot ma Ale."
    learned = common.unionByName(docs_of([(rare, text, "pl")]).select(*common.columns))
    model = language.learn(learned)
    assert "pl" in model.langs and np.isfinite(model.limits).all()
    r = random.Random(5)
    junk = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(2000)), base64.b64encode(r.randbytes(1500)).decode()]
    rows = {x["doc_id"]: x for x in language.identify(docs_of([(0, junk[0]), (1, junk[1]), (2, text)]), model).collect()}
    assert rows[0]["rejected"] and rows[1]["rejected"] and not rows[2]["rejected"]


def test_limits_count_every_text(spark, docs_of):
    plain = "the cat sat on the mat and the dog lay on the rug by the door of the house. "
    r = random.Random(3)
    ids = [x["id"] for x in spark.range(3000).orderBy(F.xxhash64("id", F.lit(7)).desc()).collect()]
    # The odd texts, one in a hundred, have the highest hashes.
    odd = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600)) for _ in range(30)]
    model = language.learn(docs_of([(i, odd[k] if k < 30 else plain * 8) for k, i in enumerate(ids)]))
    rows = language.identify(docs_of(list(enumerate(odd))), model).select("cross_entropy", "rejected").collect()
    assert not any(x["rejected"] for x in rows)
    assert model.limits[0] > min(x["cross_entropy"] for x in rows) - 1 > 2


# -- 8: shards


def brute_shards(rows, n):
    rows = sorted((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    total, at, out, slots = sum(r[2] for r in rows), 0, [], [0] * n
    for i, c, s in rows:
        k = min(n - 1, (2 * at + s) * n // (2 * total))
        out.append((i, s, c, k, slots[k]))
        slots[k] += 1
        at += s
    return sorted(out)


def test_shards_against_brute_force(spark, documents):
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    for parts in (1, 7):
        got = sorted(tuple(r) for r in shard.assign_shards(documents, 24, parts=parts).collect())
        assert got == brute_shards(rows, 24)


def test_shards_of_a_hundred_terabytes(spark):
    total = 10**14
    rows = spark.createDataFrame([(0, 8), (total // 2, 100), (total - 50, 50)], "offset long, size long")
    assert [r[0] for r in rows.select(shard.shard_of(total, 24)).collect()] == [0, 12, 23]


def test_shards_keep_columns(spark, awkward):
    rows = shard.assign_shards(awkward, 3, keep=["doc_id", "size", "rank", "__x", "text"]).collect()
    assert len(rows) == 9 and rows[0].asDict().keys() == {"doc_id", "rank", "__x", "text", "size", "text_crc32", "shard", "slot"}
    assert all(r["rank"] == "mine" and r["size"] == len((r["text"] or "").encode()) + 8 for r in rows)
    assert len(shard.assign_shards(awkward, 3, keep=[]).columns) == 4


def test_many_rows_alike_are_shards_apart(spark, docs_of):
    docs = docs_of([(None, "the same")] * 90 + [(5, "x")])
    rows = shard.assign_shards(docs, 9, parts=4).groupBy("shard").count().collect()
    assert len(rows) == 9 and max(r["count"] for r in rows) <= 12


def test_shards_awkward(spark, awkward):
    rows = shard.assign_shards(awkward, 3).collect()
    assert len(rows) == 9
    for k in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))
    assert shard.assign_shards(awkward.limit(0), 3).count() == 0


# -- 9: decontamination


def brute_hits(text, items, width=10):
    w, hit, found = words_of(text), set(), set()
    for name, t in items:
        v = words_of(t)
        k = min(width, len(v))
        grams = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)} if k else set()
        for p in range(len(w) - k + 1) if k else ():
            if tuple(w[p : p + k]) in grams:
                hit.update(range(p, p + k))
                found.add(name)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


def test_hits_against_brute_force(spark, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    want = {r["doc_id"]: brute_hits(r["text"], items) for r in documents.collect()}
    for most in (1_000_000, 200):  # at once, and in blocks
        rows = decontaminate.find_contamination(documents, bench, max_broadcast_windows=most).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows} == want
    assert any(v[4] for v in want.values())


def test_blocks_leave_the_executors(spark, documents, sf_dir, monkeypatch):
    """With more windows than the bound, each block is taken back before the next is sent."""
    live, most = set(), []
    context = spark.sparkContext
    send = type(context).broadcast

    def broadcast(self, value):
        sent = send(self, value)
        if isinstance(value, decontaminate.WindowSet):
            live.add(id(sent))
            most.append((len(live), sum(map(len, value.hashes.values()))))
            gone = sent.destroy
            sent.destroy = lambda *a: (live.discard(id(sent)), gone(*a))
        return sent

    monkeypatch.setattr(type(context), "broadcast", broadcast)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    decontaminate.find_contamination(documents, bench, max_broadcast_windows=300).count()
    assert len(most) > 2 and {n for n, _ in most} == {1} and not live and max(w for _, w in most) <= 300


def test_passes_keep_awkward_rows(spark, docs_of, awkward):
    bench = spark.createDataFrame([(k, f"item {k} the quick brown fox jumps over the lazy dog") for k in range(30)] + [(99, "quick brown fox jumps")], "item_id long, text string")
    once, passes = (sorted(map(str, decontaminate.find_contamination(awkward, bench, max_broadcast_windows=m).collect())) for m in (10**6, 12))
    assert once == passes and len(once) == 9
    cut, again = (sorted(map(str, decontaminate.remove_contamination(awkward, bench, mode="spans", max_broadcast_windows=m).collect())) for m in (10**6, 12))
    assert cut == again and any("quick brown" not in x and "lazy" in x for x in cut)


def test_hits_of_short_items_and_ties(spark, docs_of):
    docs = docs_of([(1, "A b C d e f g h i j k l m"), (2, "x A-B y"), (3, "b a"), (4, None), (5, "")])
    bench = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a B"), (2, "zzz"), (3, ""), (4, None), (None, "x"), (5, "c d e f g h i j k l m n o")], "item_id long, text string")
    items = [(1, "a b"), (2, "a B"), (2, "zzz"), (5, "c d e f g h i j k l m n o")]
    rows = decontaminate.find_contamination(docs, bench).collect()
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute_hits(r["text"], items)
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_removal_modes(spark, docs_of, awkward):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = docs_of([(1, f"Before é. {passage.upper()}! After."), (2, "clean text stays as it is"), (3, None)])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.remove_contamination(docs, bench).collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_contamination(docs, bench, mode="spans").collect()}
    assert cut[1] == "Before é. ! After." and cut[2] == "clean text stays as it is" and cut[3] is None
    kept = decontaminate.remove_contamination(awkward, bench)
    assert kept.count() == 9 and kept.columns == awkward.columns


# -- 10: mixing


def test_plan_meets_its_targets():
    totals = [("a", 900_000), ("b", 60_000), ("c", 40_000)]
    free = mix.plan(totals, 0.9, 1e9)
    assert mix.normal_entropy([w / 1e6 for _, _, w, _ in free.sources]) == pytest.approx(0.9, abs=1e-3)
    held = mix.plan(totals, 0.99, 2.0)
    rates = [q / t for _, t, _, q in held.sources]
    assert min(rates) >= 1 and max(rates) <= 2.001 and held.exponent > free.exponent
    budget = mix.plan(totals, 1.0, 1.5, budget=500_000)
    assert sum(q for *_, q in budget.sources) == pytest.approx(500_000, rel=1e-3)
    assert max(q / t for _, t, _, q in budget.sources) <= 1.5 + 1e-3
    assert mix.plan([], 0.9, 2.0).sources == [] and mix.plan([("a", 5)], 0.9, 2.0).exponent == 1.0


def brute_uses(rows, plan, seed=0, block=1 << 20):
    out = []
    tokens_of = lambda t: max(1, (len((t or "").encode()) + 3) // 4)
    for s, total, w, quota in plan.sources:
        own = [(i, t) for i, t, src in rows if src == s]
        in_block, offset0 = max(1, w * block // 1_000_000), 0
        for epoch in range(quota // total + (quota % total > 0)):
            key = lambda r: hashlib.md5(f"{seed}|{epoch}|{r[0]}".encode()).hexdigest()  # noqa: B023, E731
            at = 0
            for r in sorted(own, key=lambda r: (key(r), zlib.crc32((r[1] or "").encode()))):  # noqa: B023
                if epoch == quota // total and at >= quota % total:
                    break
                b = (epoch * total + at) // in_block
                out.append((r[0], s, tokens_of(r[1]), epoch, b, hashlib.md5(f"{seed}:block|{b}|{key(r)}".encode()).hexdigest()))
                at += tokens_of(r[1])
    return sorted(out, key=str)


def test_mix_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    for options in ({}, {"budget": 60_000, "block_tokens": 5000}):
        uses, plan = mix.mix(documents, **options)
        got = sorted((tuple(r)[:6] for r in uses.collect()), key=str)
        assert got == brute_uses(rows, plan, block=options.get("block_tokens", 1 << 20))
    again, _ = mix.mix(documents.repartition(5))
    assert sorted(map(str, again.collect())) == sorted(map(str, mix.mix(documents)[0].collect()))


def test_mixed_rows_keep_their_columns(spark, docs_of):
    docs = docs_of([(1, "same text"), (1, "same text"), (None, "x"), (None, "y")]).withColumn("url", F.monotonically_increasing_id().cast("string")).withColumn("__id", F.lit("mine")).withColumn("__k0", F.lit(7)).withColumn("tags", F.create_map(F.lit("a"), F.col("url")))
    want = sorted(map(str, docs.collect()))
    assert sorted(map(str, mix.mixed(docs).collect())) == want
    same = docs_of([(1, "same"), (1, "same"), (1, "same")])
    assert mix.mixed(same).count() == mix.mix(same)[0].count() == 3


def test_plan_limits(spark, docs_of):
    with pytest.raises(ValueError, match="repeats"):
        mix.plan([("a", 100), ("b", 50)], max_epochs=2.0, budget=1500)
    held = mix.plan([("a", 1000), ("b", 10)], 1.0, 2.0, budget=1500)
    assert all(q <= 2 * t for _, t, _, q in held.sources)
    assert mix.plan([("a", 0), ("b", 10)]).sources == [("b", 10, 1_000_000, 10), ("a", 0, 0, 0)]
    docs = docs_of([(1, "t", "en", "a"), (2, "t", "en", "a"), (3, "u", "en", "b")])
    counts = F.when(F.col("source") == "b", F.lit(5))
    uses, _ = mix.mix(docs, tokens=counts)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in uses.collect()) == [(1, 0), (2, 0), (3, 5)]
    assert [r["doc_id"] for r in mix.mix(docs, tokens=counts, budget=5)[0].collect()] == [3]
    assert mix.mixed(docs, tokens=counts).count() == 3


def test_mixed_rows(spark, docs_of, awkward):
    docs = docs_of([(i, "text " * 50, "en", "big" if i < 60 else "small") for i in range(70)] + [(70, None, "en", None)])
    uses, plan = mix.mix(docs)
    out = mix.mixed(docs)
    assert out.columns == docs.columns and out.count() == uses.count()
    assert {r["doc_id"] for r in out.collect()} == set(range(71))
    assert max(q / t for _, t, _, q in plan.sources) <= mix.MAX_EPOCHS + 0.01
    assert mix.mixed(awkward).columns == awkward.columns and mix.mixed(awkward).count() == 9
    assert mix.mixed(awkward.limit(0)).count() == 0
