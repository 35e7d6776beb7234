"""Queries of policies, cross-origin rules and request commands."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import cors as X
from ..operators import policy as P
from . import views as V
from .registry import query


def _document(*statements: dict) -> str:
    return json.dumps({"Version": P.VERSION, "Statement": list(statements)})


def _requests(spark, d):
    r = V.requests(spark, d)
    from ..functions.scalars import format_iso8601

    at = format_iso8601(F.col("at"))
    columns = P.Requests(
        action=F.col("action"),
        resource=F.col("resource"),
        principal=F.col("principal"),
        variables={"aws:username": F.col("username"), "aws:CurrentTime": at, "s3:max-keys": F.col("number").cast("string"), "aws:referer": F.when(F.col("id") % 3 == 0, F.concat(F.lit("Site"), F.col("number") % 4)), "s3:prefix": F.col("key")},
    )
    return r, columns


def _matched(spark, d, statement: dict):
    r, c = _requests(spark, d)
    return r.where(P.matches(P.parse(_document(statement))[0], c)).select("id")


_ALL = {"Effect": "Allow", "Action": "*", "Resource": "*"}


def _register(key: str, statement: dict, where: str) -> None:
    query(key, V.with_(V.V_REQUESTS) + f"SELECT id FROM v_requests WHERE {where}")(lambda spark, d: _matched(spark, d, statement))


_register("pl01_action", _ALL | {"Action": ["s3:Get*", "s3:ListObject?"]}, "action LIKE 's3:Get%' OR action LIKE 's3:ListObject_'")
_register("pl01_not_action", {"Effect": "Allow", "NotAction": "s3:*", "Resource": "*"}, "action NOT LIKE 's3:%'")
_register("pl02_resource", _ALL | {"Resource": ["arn:aws:s3:::b1/*", "arn:aws:s3:::b2/u1?/7"]}, "resource LIKE 'arn:aws:s3:::b1/%' OR resource LIKE 'arn:aws:s3:::b2/u1_/7'")
_register("pl02_not_resource", {"Effect": "Allow", "Action": "*", "NotResource": "arn:aws:s3:::b1/*"}, "resource NOT LIKE 'arn:aws:s3:::b1/%'")
_register("pl03_principal", _ALL | {"Principal": "arn:aws:iam::2:user/*"}, "principal LIKE 'arn:aws:iam::2:user/%'")
_register("pl03_not_principal", _ALL | {"NotPrincipal": ["arn:aws:iam::2:*", "arn:aws:iam::3:*"]}, "principal NOT LIKE 'arn:aws:iam::2:%' AND principal NOT LIKE 'arn:aws:iam::3:%'")
_register("pl04_undefined", _ALL | {"Condition": {"StringEquals": {"aws:referer": ["Site0", "Site1"]}}}, "id % 3 = 0 AND number % 4 IN (0, 1)")
_register("pl04_if_exists", _ALL | {"Condition": {"StringEqualsIfExists": {"aws:referer": ["Site0", "Site1"]}}}, "id % 3 <> 0 OR number % 4 IN (0, 1)")
_register("pl05_string_equals", _ALL | {"Condition": {"StringEquals": {"aws:username": ["u1", "u22"]}}}, "username IN ('u1', 'u22')")
_register("pl05_string_not_equals", _ALL | {"Condition": {"StringNotEquals": {"AWS:UserName": "u1"}}}, "username <> 'u1'")
_register("pl06_ignore_case", _ALL | {"Condition": {"StringEqualsIgnoreCase": {"aws:referer": "SITE2"}}}, "id % 3 = 0 AND number % 4 = 2")
_register("pl07_like", _ALL | {"Condition": {"StringLike": {"s3:prefix": "u1*/?"}}}, "key LIKE 'u1%/_'")
_register("pl07_not_like", _ALL | {"Condition": {"StringNotLike": {"s3:prefix": "u1*"}}}, "key NOT LIKE 'u1%'")
_register("pl08_numeric", _ALL | {"Condition": {"NumericGreaterThanEquals": {"s3:max-keys": "5"}, "NumericLessThan": {"s3:max-keys": "20"}}}, "number >= 5 AND number < 20")
_register("pl08_numeric_equals", _ALL | {"Condition": {"NumericNotEquals": {"s3:max-keys": "5"}}}, "number <> 5")
_register("pl09_date", _ALL | {"Condition": {"DateGreaterThan": {"aws:CurrentTime": "2024-01-10T00:00:00Z"}, "DateLessThanEquals": {"aws:CurrentTime": "2024-01-20T12:00:00Z"}}}, '"at" > 1704844800 AND "at" <= 1705752000')
_register("pl14_variables", _ALL | {"Resource": "arn:aws:s3:::b?/${aws:username}/*"}, "resource LIKE 'arn:aws:s3:::b_/%' AND split_part(key, '/', 1) = username")


@query("pl11_unknown", V.with_(V.V_REQUESTS) + "SELECT id, FALSE AS unknown, username = 'u1' AS known FROM v_requests")
def _(spark, d):
    """An operator that there is not matches no request; the same condition with one that there is matches some."""
    r, c = _requests(spark, d)
    unknown, known = (P.parse(_document(_ALL | {"Condition": {how: {"aws:username": "u1"}}}))[0] for how in ("StringSounds", "StringEquals"))
    return r.select("id", P.matches(unknown, c).alias("unknown"), P.matches(known, c).alias("known"))


@query("pl07_like_quirk", V.with_(V.V_REQUESTS) + "SELECT id FROM v_requests WHERE key = 'u8/69'")
def _(spark, d):
    """With value and pattern changed places, a value without wildcards is compared as it is."""
    r, c = _requests(spark, d)
    s = P.parse(_document(_ALL | {"Condition": {"StringLike": {"s3:prefix": "u8/69"}}}))[0]
    return r.where(P.matches(s, c, compat="reference")).select("id")


_DOCS = [
    ("ok", _document(_ALL)),
    ("bool", _document(_ALL | {"Condition": {"Bool": {"aws:x": "true"}}})),
    ("version", json.dumps({"Statement": _ALL})),
    ("both", _document(_ALL | {"NotAction": "x"})),
    ("none", _document({"Effect": "Allow", "Resource": "*"})),
    ("effect", _document(_ALL | {"Effect": "Maybe"})),
    ("long", _document(_ALL | {"Resource": "x" * 201})),
    ("json", "{"),
]


@query("pl10_pl12_parse", "SELECT * FROM (VALUES ('ok', TRUE), ('bool', FALSE), ('version', FALSE), ('both', FALSE), ('none', FALSE), ('effect', FALSE), ('long', FALSE), ('json', FALSE)) t(name, valid)")
def _(spark, d):
    """Which documents are policies."""
    rows = []
    for name, text in _DOCS:
        try:
            P.parse(text)
            rows.append((name, True))
        except P.PolicyError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "name string, valid boolean")


@query("pl13_context", V.with_(V.V_REQUESTS) + "SELECT id, action AS a, resource AS r, principal AS p, username AS u FROM v_requests")
def _(spark, d):
    """Context variables by name, without regard to case."""
    r, c = _requests(spark, d)
    return r.select("id", c.variable("UH:actionid").alias("a"), c.variable("uh:ResourceARN").alias("r"), c.variable("aws:principalarn").alias("p"), c.variable("AWS:USERNAME").alias("u"))


@query("pl15_glob", "SELECT p_partkey, p_name LIKE '%widget' AS a, p_name LIKE '___ %' AS b, p_name LIKE '%e%t' AS c FROM part")
def _(spark, d):
    n = F.col("p_name")
    return V.table(spark, d, "part").select("p_partkey", P.glob(n, "*widget").alias("a"), P.glob(n, "??? *").alias("b"), P.glob(n, "*e*t").alias("c"))


@query("pl16_resource_arn", V.with_(V.V_REQUESTS) + "SELECT id, 'arn:aws:s3:::' || bucket || CASE WHEN id % 4 = 0 THEN '' ELSE '/' || key END AS arn FROM v_requests")
def _(spark, d):
    return V.requests(spark, d).selectExpr("id", "concat('arn:aws:s3:::', bucket, if(id % 4 = 0, '', concat('/', key))) as arn")


_RULES = [
    _ALL | {"Action": ["s3:GetObject", "s3:ListObjects"]},
    _ALL | {"Action": "s3:*", "Resource": "arn:aws:s3:::b1/*", "Principal": "arn:aws:iam::1:*"},
    {"Effect": "Deny", "Action": "s3:DeleteObject", "Resource": "*"},
    {"Effect": "Deny", "Action": "*", "Resource": "arn:aws:s3:::b3/*", "Condition": {"NumericLessThan": {"s3:max-keys": "3"}}},
]


@query(
    "pl_eval",
    V.with_(V.V_REQUESTS)
    + """SELECT id, CASE WHEN username = 'u7' THEN 'Allow' WHEN action = 's3:DeleteObject' OR (bucket = 'b3' AND number < 3) THEN 'Deny'
    WHEN action IN ('s3:GetObject', 's3:ListObjects') OR (action LIKE 's3:%' AND bucket = 'b1' AND principal LIKE 'arn:aws:iam::1:%') THEN 'Allow' ELSE 'Deny' END AS decision FROM v_requests""",
)
def _(spark, d):
    r, c = _requests(spark, d)
    return r.select("id", P.decide(P.parse(_document(*_RULES)), c, F.col("username") == "u7").alias("decision"))


@query("pl_eval_by_bucket", V.with_(V.V_REQUESTS) + "SELECT id, CASE WHEN bucket = 'b2' AND number >= 10 THEN 'Deny' WHEN action = 's3:GetObject' OR bucket = 'b0' THEN 'Allow' ELSE 'Deny' END AS decision FROM v_requests")
def _(spark, d):
    r, c = _requests(spark, d)
    common = P.parse(_document(_ALL | {"Action": "s3:GetObject"}))
    own = {"b0": P.parse(_document(_ALL)), "b2": P.parse(_document({"Effect": "Deny", "Action": "*", "Resource": "*", "Condition": {"NumericGreaterThanEquals": {"s3:max-keys": "10"}}}))}
    return r.select("id", P.decide_by_bucket(r, own, common, c).alias("decision"))


_XML = """<CORSConfiguration><CORSRule><AllowedOrigin>https://app.example.net</AllowedOrigin><AllowedMethod>DELETE</AllowedMethod><AllowedMethod>PUT</AllowedMethod><AllowedHeader>x-*</AllowedHeader><AllowedHeader>content-type</AllowedHeader></CORSRule><CORSRule><AllowedOrigin>*</AllowedOrigin><AllowedMethod>GET</AllowedMethod></CORSRule></CORSConfiguration>"""


def _rules(spark, d):
    buckets = V.buckets(spark, d).where("id < 3").select(F.col("name").alias("bucket"), F.lit(_XML).alias("cors"))
    return X.parse_rules(buckets)


@query("co01_rules", "SELECT 'b' || n_nationkey AS bucket, rule, origin, methods, headers FROM nation, (VALUES (0::BIGINT, 'https://app.example.net', 'DELETE,PUT', 'x-*,content-type'), (1000, '*', 'GET', '')) r(rule, origin, methods, headers) WHERE n_nationkey < 3")
def _(spark, d):
    return _rules(spark, d).select("bucket", "rule", "origin", F.array_join("methods", ",").alias("methods"), F.array_join("headers", ",").alias("headers"))


def _asked(spark, d):
    return V.requests(spark, d).selectExpr("id", "bucket", "if(id % 2 = 0, 'https://app.example.net', 'https://other.example.org') as origin", "case when action like '%Put%' then 'PUT' when action like '%Delete%' then 'DELETE' else 'GET' end as method", "split('x-a,content-type,y-b', ',') as asked")


_FIRST = """q AS (SELECT id, bucket, id % 2 = 0 AS own, CASE WHEN action LIKE '%Put%' THEN 'PUT' WHEN action LIKE '%Delete%' THEN 'DELETE' ELSE 'GET' END AS method FROM v_requests),
    f AS (SELECT id, CASE WHEN bucket = 'b3' THEN NULL WHEN own AND method <> 'GET' THEN 0 WHEN method = 'GET' THEN 1000 END AS rule FROM q)"""


@query("co02_match", V.with_(V.V_REQUESTS, _FIRST) + "SELECT id, rule::BIGINT AS rule FROM f")
def _(spark, d):
    return X.first_rule(_asked(spark, d), _rules(spark, d)).select("id", "rule")


@query("co03_headers", V.with_(V.V_REQUESTS, _FIRST) + "SELECT id, CASE WHEN rule = 0 THEN 'content-type,x-a' WHEN rule = 1000 THEN '' END AS allowed, CASE WHEN rule = 0 THEN 'content-type,x-a' WHEN rule = 1000 THEN '' END AS quirk FROM f")
def _(spark, d):
    m = X.first_rule(_asked(spark, d), _rules(spark, d))
    listed = lambda compat: F.when(F.col("rule").isNotNull(), F.array_join(X.allowed_headers(F.col("asked"), F.col("headers"), compat), ","))
    return m.select("id", listed("s3").alias("allowed"), listed("reference").alias("quirk"))


@query("co04_simple", V.with_(V.V_REQUESTS, _FIRST) + "SELECT id, CASE WHEN rule IS NULL THEN 403 ELSE 200 END AS status FROM f")
def _(spark, d):
    m = X.first_rule(_asked(spark, d), _rules(spark, d))
    return m.select("id", F.when(F.col("rule").isNull(), 403).otherwise(200).alias("status"))


_DISPATCH = """SELECT event_id AS id, CASE
    WHEN m = 'GET' AND NOT k THEN CASE q WHEN 'versions' THEN 's3:ListBucketVersions' WHEN 'uploads' THEN 's3:ListMultipartUploads' WHEN 'policy' THEN 's3:GetBucketPolicy' ELSE 's3:ListObjects' END
    WHEN m = 'GET' THEN 's3:GetObject'
    WHEN m = 'PUT' AND k THEN 's3:PutObject'
    WHEN m = 'PUT' THEN CASE q WHEN 'policy' THEN 's3:PutBucketPolicy' ELSE 's3:CreateBucket' END
    WHEN m = 'POST' AND k THEN CASE q WHEN 'uploads' THEN 's3:CreateMultipartUpload' WHEN 'uploadId' THEN 's3:CompleteMultipartUpload' END
    WHEN m = 'POST' THEN NULL
    WHEN m = 'DELETE' AND k THEN CASE q WHEN 'uploadId' THEN 's3:AbortMultipartUpload' ELSE 's3:DeleteObject' END
    WHEN m = 'DELETE' THEN CASE q WHEN 'policy' THEN 's3:DeleteBucketPolicy' ELSE 's3:DeleteBucket' END
    WHEN m = 'HEAD' THEN CASE WHEN k THEN 's3:HeadObject' ELSE 's3:HeadBucket' END END AS action
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'PUT' WHEN 'purchase' THEN 'POST' WHEN 'error' THEN 'DELETE' ELSE 'HEAD' END AS m,
        user_id % 2 = 0 AS k, CASE event_id % 5 WHEN 0 THEN 'versions' WHEN 1 THEN 'uploads' WHEN 2 THEN 'policy' WHEN 3 THEN 'uploadId' ELSE 'x' END AS q FROM events)"""


@query("s3_dispatch", _DISPATCH)
def _(spark, d):
    """Which command each request means."""
    e = V.table(spark, d, "events").selectExpr(
        "event_id as id",
        "case event_type when 'view' then 'GET' when 'click' then 'PUT' when 'purchase' then 'POST' when 'error' then 'DELETE' else 'HEAD' end as m",
        "user_id % 2 = 0 as k",
        "map(case event_id % 5 when 0 then 'versions' when 1 then 'uploads' when 2 then 'policy' when 3 then 'uploadId' else 'x' end, '') as q",
    )
    return e.select("id", P.action_id(F.col("m"), F.col("k"), F.col("q")).alias("action"))
