"""Cross-origin rules (CO-*): XML documents to rule rows, requests to the first rule that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SCHEMA = "CORSRule array<struct<AllowedOrigin array<string>, AllowedMethod array<string>, AllowedHeader array<string>, ExposeHeader array<string>, MaxAgeSeconds bigint>>"


def parse_rules(documents: DataFrame, bucket: str = "bucket", xml: str = "cors") -> DataFrame:
    """CO-1: a row for each rule and origin, in order: bucket, rule, origin, methods, headers."""
    parsed = documents.select(bucket, F.from_xml(xml, F.lit(_SCHEMA)).alias("c"))
    rules = parsed.select(bucket, F.posexplode("c.CORSRule").alias("rule_no", "r"))
    origins = rules.select(bucket, "rule_no", F.posexplode("r.AllowedOrigin").alias("origin_no", "origin"), F.coalesce("r.AllowedMethod", F.array()).alias("methods"), F.coalesce("r.AllowedHeader", F.array()).alias("headers"))
    return origins.select(bucket, (F.col("rule_no") * 1000 + F.col("origin_no")).cast("long").alias("rule"), "origin", "methods", "headers")


def first_rule(requests: DataFrame, rules: DataFrame, id: str = "id") -> DataFrame:
    """CO-2: each request (id, bucket, origin, method) with the first rule for its origin (or any) and method, or nulls."""
    r = F.broadcast(rules.select(F.col("bucket").alias("__bucket"), "rule", F.col("origin").alias("allowed"), "methods", "headers"))  # rules are written by hand: some for each bucket
    fits = (F.col("bucket") == F.col("__bucket")) & ((F.col("allowed") == F.col("origin")) | (F.col("allowed") == "*")) & F.array_contains("methods", F.col("method"))
    both = requests.join(r, fits, "left")
    w = Window.partitionBy(id).orderBy(F.col("rule").asc_nulls_last())
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__bucket")


def header_matches(pattern: Column, header: Column, compat: str = "s3") -> Column:
    """One ``*`` stands for anything; ``compat="reference"`` looks at one character less before it."""
    at = F.instr(pattern, "*")
    before = F.substring(pattern, F.lit(1), F.greatest(F.lit(0), at - (2 if compat == "reference" else 1)))
    after = F.substring(pattern, at + 1, F.length(pattern))
    return F.when(at == 0, header == pattern).otherwise(F.startswith(header, before) & F.endswith(header, after))


def allowed_headers(asked: Column, patterns: Column, compat: str = "s3") -> Column:
    """CO-3: of the headers asked for, those that some pattern allows, sorted."""
    return F.array_sort(F.array_distinct(F.filter(asked, lambda h: F.exists(patterns, lambda p: header_matches(p, h, compat)))))
