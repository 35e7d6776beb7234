"""Access policies: documents parsed into statement rows, requests matched against all of them at once (PL-*).

Parsing happens on the driver, as documents are few; matching is one Column
expression for each statement, so requests are scanned once and never shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_iso8601

# The only version of documents, the longest value, and the names of context variables.
VERSION = "2012-10-17"
MAX_VALUE = 200
VARIABLES = (
    "uh:ActionId",
    "uh:ResourceArn",
    "aws:PrincipalArn",
    "aws:username",
    "aws:userid",
    "aws:SourceIp",
    "aws:referer",
    "aws:UserAgent",
    "s3:x-amz-content-sha256",
    "s3:x-amz-copy-source",
    "s3:delimiter",
    "s3:prefix",
    "aws:CurrentTime",
)
NOT_SUPPORTED = ("Bool", "BinaryEquals", "IpAddress", "NotIpAddress", "ArnEquals", "ArnLike", "ArnNotEquals", "ArnNotLike", "Null")


class PolicyError(ValueError):
    """A document that cannot be a policy."""


class Statement(NamedTuple):
    sid: str
    effect: str
    action: tuple[bool, list[str]]
    resource: tuple[bool, list[str]]
    principal: tuple[bool, list[str]] | None
    conditions: dict[str, dict[str, list[str]]]


def _values(x) -> list[str]:
    out = x if isinstance(x, list) else [x]
    if any(not isinstance(v, str) or len(v) > MAX_VALUE for v in out):
        raise PolicyError(f"values are strings of up to {MAX_VALUE} characters")
    return out


def _either(statement: dict, name: str, required: bool) -> tuple[bool, list[str]] | None:
    """(whether it holds for what is listed, the list) from ``Name`` or ``NotName``."""
    yes, no = name in statement, f"Not{name}" in statement
    if yes and no and required:
        raise PolicyError(f"{name} and Not{name} are both there")
    if not yes and not no:
        if required:
            raise PolicyError(f"{name} or Not{name} is required")
        return None
    return (True, _values(statement[name])) if yes else (False, _values(statement[f"Not{name}"]))


def parse(document: str) -> list[Statement]:
    """PL-12: the statements of a document; PolicyError where it is none."""
    try:
        whole = json.loads(document)
    except ValueError as why:
        raise PolicyError(str(why)) from why
    if not isinstance(whole, dict) or whole.get("Version") != VERSION:
        raise PolicyError("no version, or another one")
    if "Statement" not in whole:
        raise PolicyError("no statement")
    out = []
    for s in whole["Statement"] if isinstance(whole["Statement"], list) else [whole["Statement"]]:
        if s.get("Effect") not in ("Allow", "Deny"):
            raise PolicyError("the effect is Allow or Deny")
        conditions = {k: {n: _values(v) for n, v in c.items()} for k, c in s.get("Condition", {}).items()}
        for k in conditions:
            if k.removesuffix("IfExists") in NOT_SUPPORTED:
                raise PolicyError(f"{k} is not implemented")
        out.append(Statement(s.get("Sid", ""), s["Effect"], _either(s, "Action", True), _either(s, "Resource", True), _either(s, "Principal", False), conditions))
    return out


def glob_regex(pattern: str) -> str:
    """PL-15: ``*`` and ``?`` as a regular expression over the whole text."""
    return "^(?s)" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def glob(value: Column, pattern: str) -> Column:
    if "*" not in pattern and "?" not in pattern:
        return value == pattern
    if pattern.endswith("*") and not re.search(r"[*?]", pattern[:-1]):
        return value.startswith(pattern[:-1])  # this reaches a scan
    return value.rlike(glob_regex(pattern))


def replace_variables(text: str, value: Callable[[str], str | None]) -> str:
    """PL-14: ``${name}`` by its value, an unknown one by nothing; ``${*}``, ``${?}``, ``${$}`` by the character; ``\\`` takes the next as it is."""
    out, at = [], 0
    while at < len(text):
        if text[at] == "\\" and at + 1 < len(text):
            out.append(text[at + 1])
            at += 2
        elif text.startswith("${", at) and (end := text.find("}", at)) >= 0:
            name = text[at + 2 : end]
            out.append(name if name in ("*", "?", "$") else value(name) or "")
            at = end + 1
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


class Requests:
    """Where a request's context is: columns of a DataFrame by variable, names without regard to case."""

    def __init__(self, **columns: Column):
        self.action, self.resource, self.principal = columns["action"], columns["resource"], columns["principal"]
        own = {"uh:actionid": self.action, "uh:resourcearn": self.resource, "aws:principalarn": self.principal}
        self.variables = own | {k.lower(): v for k, v in columns.get("variables", {}).items()}

    def variable(self, name: str) -> Column:
        return self.variables.get(name.lower(), F.lit(None).cast("string"))

    def matches(self, value: Column, pattern: str) -> Column:
        """A pattern that may hold variables."""
        if "${" not in pattern:
            return glob(value, pattern)
        parts: list[Column] = [F.lit("^(?s)")]
        for piece in re.split(r"(\$\{[^}]*\})", pattern):
            if piece.startswith("${"):
                name = piece[2:-1]
                parts.append(F.lit(re.escape(name)) if name in ("*", "?", "$") else F.concat(F.lit("\\Q"), F.coalesce(self.variable(name), F.lit("")), F.lit("\\E")))
            elif piece:
                parts.append(F.lit(glob_regex(piece)[5:-1]))
        return F.regexp_like(value, F.concat(*parts, F.lit("$")))


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


_NUMERIC = {"Equals": "==", "NotEquals": "!=", "LessThan": "<", "LessThanEquals": "<=", "GreaterThan": ">", "GreaterThanEquals": ">="}


def _compare(a: Column, how: str, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[_NUMERIC[how]]


def condition(operator: str, name: str, values: list[str], requests: Requests, compat: str = "s3") -> Column:
    """PL-4 … PL-11: one key of one condition; never null."""
    ignore = operator.endswith("IfExists")
    operator = operator.removesuffix("IfExists")
    have = requests.variable(name)
    if operator in ("StringEquals", "StringNotEquals"):
        found = _any([have == v for v in values])
    elif operator in ("StringEqualsIgnoreCase", "StringNotEqualsIgnoreCase"):
        found = _any([F.lower(have) == v.lower() for v in values])
    elif operator in ("StringLike", "StringNotLike"):
        if compat == "reference":  # the value asked about is taken for the pattern
            pattern = F.concat(F.lit("^(?s)\\Q"), F.replace(F.replace(have, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("?"), F.lit("\\E.\\Q")), F.lit("\\E$"))
            found = _any([F.regexp_like(F.lit(v), pattern) for v in values])
        else:
            found = _any([requests.matches(have, v) for v in values])
    elif operator.startswith("Numeric") and operator[7:] in _NUMERIC:
        if len(values) != 1:
            raise PolicyError(f"{operator} takes one value")
        found = _compare(have.try_cast("bigint"), operator[7:], F.lit(int(values[0])))
    elif operator.startswith("Date") and operator[4:] in _NUMERIC:
        if len(values) != 1:
            raise PolicyError(f"{operator} takes one value")
        found = _compare(parse_iso8601(have), operator[4:], parse_iso8601(F.lit(values[0])))
    else:
        return F.lit(False)  # an unknown operator matches nothing
    if operator.startswith("StringNot"):
        found = ~found
    return F.when(have.isNull(), F.lit(ignore)).otherwise(F.coalesce(found, F.lit(False)))


def matches(statement: Statement, requests: Requests, compat: str = "s3") -> Column:
    """Whether a statement applies to a request: all its elements do."""

    def listed(value: Column, element: tuple[bool, list[str]]) -> Column:
        yes, patterns = element
        found = F.coalesce(_any([requests.matches(value, p) for p in patterns]), F.lit(False))
        return found if yes else ~found

    out = listed(requests.action, statement.action) & listed(requests.resource, statement.resource)
    if statement.principal is not None:
        out = out & listed(requests.principal, statement.principal)
    for operator, keys in statement.conditions.items():
        for name, values in keys.items():
            out = out & condition(operator, name, values, requests, compat)
    return out


def decide(statements: list[Statement], requests: Requests, super_user: Column | None = None, compat: str = "s3") -> Column:
    """PL evaluation: a matching Deny wins; else a matching Allow; else Deny. Super-users are always allowed."""
    deny = _any([matches(s, requests, compat) for s in statements if s.effect == "Deny"])
    allow = _any([matches(s, requests, compat) for s in statements if s.effect == "Allow"])
    decision = F.when(deny, "Deny").when(allow, "Allow").otherwise("Deny")
    return decision if super_user is None else F.when(super_user, "Allow").otherwise(decision)


def decide_by_bucket(requests: DataFrame, by_bucket: dict[str, list[Statement]], common: list[Statement], columns: Requests) -> Column:
    """Global statements for all, and each bucket's own for its requests."""
    out = decide(common, columns)
    for bucket, own in by_bucket.items():
        out = F.when(requests["bucket"] == bucket, decide([*common, *own], columns)).otherwise(out)
    return out


def action_id(method: Column, has_key: Column, query: Column) -> Column:
    """The command that a request means: the first that fits, in a fixed order."""
    has = lambda name: F.coalesce(F.array_contains(F.map_keys(query), name), F.lit(False))
    rules = [
        ("GET", False, "versions", "s3:ListBucketVersions"),
        ("GET", False, "uploads", "s3:ListMultipartUploads"),
        ("GET", False, "policy", "s3:GetBucketPolicy"),
        ("GET", False, "cors", "s3:GetBucketCORS"),
        ("GET", False, "versioning", "s3:GetBucketVersioning"),
        ("GET", False, "list-type", "s3:ListObjectsV2"),
        ("GET", False, None, "s3:ListObjects"),
        ("GET", True, None, "s3:GetObject"),
        ("HEAD", True, None, "s3:HeadObject"),
        ("HEAD", False, None, "s3:HeadBucket"),
        ("PUT", True, "partNumber", "s3:UploadPart"),
        ("PUT", True, "copy-source", "s3:CopyObject"),
        ("PUT", True, None, "s3:PutObject"),
        ("PUT", False, "policy", "s3:PutBucketPolicy"),
        ("PUT", False, "cors", "s3:PutBucketCORS"),
        ("PUT", False, "versioning", "s3:PutBucketVersioning"),
        ("PUT", False, None, "s3:CreateBucket"),
        ("POST", True, "uploads", "s3:CreateMultipartUpload"),
        ("POST", True, "uploadId", "s3:CompleteMultipartUpload"),
        ("POST", False, "delete", "s3:DeleteObjects"),
        ("DELETE", True, "uploadId", "s3:AbortMultipartUpload"),
        ("DELETE", True, None, "s3:DeleteObject"),
        ("DELETE", False, "policy", "s3:DeleteBucketPolicy"),
        ("DELETE", False, "cors", "s3:DeleteBucketCORS"),
        ("DELETE", False, None, "s3:DeleteBucket"),
    ]
    out = None
    for m, key, name, action in rules:
        fits = (method == m) & (has_key if key else ~has_key)
        fits = fits & has(name) if name else fits
        out = F.when(fits, action) if out is None else out.when(fits, action)
    return out
