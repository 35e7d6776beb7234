"""The greedy scan over whole documents against a plain version of it."""

from pyspark.sql import functions as F

from tessera.operators import dedup as D


def _shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def plain_scan(objects, node_of, call_bytes):
    """(node, id, call, idx, offset, size, stored) by looking at every body that a node has."""
    bodies, out, turn = {}, [], 0
    for i, data in objects:
        for call, begin in enumerate(range(0, len(data), call_bytes)):
            node = node_of(turn)
            turn += 1
            known = bodies.setdefault(node, [])
            piece = data[begin : begin + call_bytes]
            at, found = 0, []
            while at < len(piece):
                rest = piece[at : at + 2 * D.MAX_FRAGMENT]
                above, below = min((b for b in known if b >= rest), default=None), max((b for b in known if b < rest), default=None)
                n = max(_shared(b, rest) if b is not None else 0 for b in (above, below))
                stored = n > D.MIN_MATCH
                n = n if stored else min(D.MAX_FRAGMENT, len(piece) - at)
                found.append((at, n, stored))
                at += n
            out += [(node, i, call, k, begin + at, n, stored) for k, (at, n, stored) in enumerate(found)]
            for at, n, stored in found:
                body = piece[at : at + n]
                above, below = min((b for b in known if b >= body), default=None), max((b for b in known if b < body), default=None)
                alike = any(b is not None and b[: D.PREFIX] == body[: D.PREFIX] and (b.startswith(body) or body.startswith(b)) for b in (above, below))
                if not stored and not alike:
                    known.append(body)
    return sorted(out)


def test_calls_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    objects = sorted((r["id"], (r["text"] or "").encode()) for r in docs.collect())
    for nodes, call_bytes in ((1, 1 << 20), (3, 1000)):
        got = sorted(map(tuple, D.greedy_dedup(docs, nodes=nodes, call_bytes=call_bytes).collect()))
        want = plain_scan(objects, lambda turn: turn % nodes, call_bytes)  # noqa: B023
        assert got == want
        assert any(x[-1] for x in want) and any(not x[-1] for x in want)


def test_a_bounded_dictionary_still_covers_all(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    found = D.greedy_dedup(docs, nodes=2, capacity=5)
    raw, new = found.agg(F.sum("size"), F.sum(F.when(~F.col("stored"), F.col("size")))).first()
    free = D.greedy_dedup(docs, nodes=2).where("not stored").agg(F.sum("size")).first()[0]
    assert raw == docs.agg(F.sum(F.octet_length("text"))).first()[0] and free < new <= raw


def test_shared_bytes(spark):
    rows = spark.createDataFrame([(b"abc", b"abd"), (b"", b"a"), ("ñ".encode(), "ò".encode()), (None, b"")], "a binary, b binary")
    assert [r[0] for r in rows.select(D.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 1, None]


def test_order_by_prefix(spark):
    bodies = [b"x" * 16 + bytes([k]) for k in range(50)] + [b"y", b""]
    rows = spark.createDataFrame([(b,) for b in bodies], "body binary")
    got = {bytes(r["body"]): r["rank"] for r in D.prefix_order(rows).collect()}
    assert got == {b: k for k, b in enumerate(bodies[:50])} | {b"y": 0, b"": 0}
