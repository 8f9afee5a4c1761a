"""Canonical JSON, digests and fingerprints."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import normalized, session_text


def js_number(x: float | int) -> str:
    """A number as ECMAScript writes it."""
    if isinstance(x, int) and abs(x) < 2**53:
        return str(x)
    try:
        x = float(x)
    except OverflowError:
        return "null"
    if math.isnan(x) or math.isinf(x):
        return "null"
    if x == 0:
        return "0"
    digits = repr(abs(x))
    mantissa, _, exp = digits.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exp or 0)
    figures = (whole + part).lstrip("0")
    point -= len(whole + part) - len(figures) if whole.strip("0") == "" else 0
    figures = figures.rstrip("0") or "0"
    n, k = point, len(figures)
    if k <= n <= 21:
        out = figures + "0" * (n - k)
    elif 0 < n <= 21:
        out = figures[:n] + "." + figures[n:]
    elif -6 < n <= 0:
        out = "0." + "0" * -n + figures
    else:
        e = n - 1
        out = figures[0] + ("." + figures[1:] if k > 1 else "") + "e" + ("+" if e >= 0 else "-") + str(abs(e))
    return ("-" if x < 0 else "") + out


def canonical(value) -> str:
    """JSON with keys in the order of their UTF-16 units and numbers as ECMAScript writes them."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return js_number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode("utf-8", "surrogatepass")).hexdigest()[:12]


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical form of JSON text; null where it isn't JSON, and for null."""

    def one(t):
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(StringType())
def args_digest(text: pd.Series) -> pd.Series:
    """Digest of an argument given as JSON text; none is digested as null."""

    def one(t):
        try:
            return digest(None if t is None else json.loads(t))
        except ValueError:
            return "digest-error"

    return text.map(one)


def short_sha(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def fingerprint_text(text: Column) -> Column:
    """Fingerprint of a document: 12 hex digits of the hash of its normalized text."""
    return short_sha(normalized(text))


def cluster_fingerprint(prompts: Column, seq: Column) -> Column:
    """Fingerprint of a medoid: session text, a bar, and its sorted symbols."""
    symbols = F.array_join(F.array_sort(F.coalesce(seq, F.array().cast("array<string>"))), ",")
    return short_sha(F.concat(session_text(prompts), F.lit("|"), symbols))


def push_checksum(title: Column, steps: Column, fields: Column) -> Column:
    """Full hash over title, each step's title and description, each field's label and type, one a line."""
    parts = F.concat(F.array(title), F.flatten(F.transform(steps, lambda s: F.array(s["title"], s["description"]))), F.flatten(F.transform(fields, lambda f: F.array(f["label"], f["type"]))))
    return F.sha2(F.array_join(parts, "\n"), 256)
