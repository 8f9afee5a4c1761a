"""Secrets: redaction and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import java_pattern, let, with_space

HOLE = "[REDACTED]"

# Patterns p0 to p15 in order.
PATTERNS = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?s:.*?)-----END [A-Z0-9 ]*PRIVATE KEY-----",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\b",
    r"\beyJ[A-Za-z0-9_-]{20,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"(?i)\b(?:aws_secret_access_key|aws_session_token)\s*[=:]\s*[A-Za-z0-9+/=]{20,}",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bglpat-[A-Za-z0-9_-]{15,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"\bsk-[A-Za-z0-9_-]{20,}\b",
    r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}\b",
    r"\bnpm_[A-Za-z0-9]{30,}\b",
    r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\b",
    r"\b[Bb]earer\s+[A-Za-z0-9._~+/=-]{16,}",
    r"(?i)\b(?:api[_-]?key|apikey|secret|token|password|passwd|client[_-]?secret)\s*[=:]\s*[\"']?[A-Za-z0-9._~+/-]{12,}[\"']?",
)
ENTROPY_TOKEN = r"[A-Za-z0-9+/=_-]{32,}"
ENTROPY_BITS = 4.2
FINDINGS_CAP = 50
# End of fixed values.


JAVA_PATTERNS = tuple(map(java_pattern, PATTERNS))
RE2_PATTERNS = tuple(map(with_space, PATTERNS))
#: The net's tokens begin where no character of theirs is in front, so that a run is read once.
JAVA_TOKEN = r"[A-Za-z0-9+/=_-](?<![A-Za-z0-9+/=_-].)[A-Za-z0-9+/=_-]{31,}+"


def shannon_entropy(s: Column) -> Column:
    """Bits a character; 0 for the empty string. Sums in the order of first sight of each character."""
    n = F.length(s).cast("double")
    chars = F.array_distinct(F.split(s, ""))

    def add(acc, ch):
        p = (F.length(s) - F.length(F.replace(s, ch, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.when(F.length(s) == 0, 0.0).otherwise(F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), add))


def is_random(token: Column) -> Column:
    """A token that the entropy net takes: not all hexadecimal, two kinds of characters at least, enough bits."""
    kinds = sum((token.rlike(p).cast("int") for p in ("[A-Z]", "[a-z]", "[0-9]")), F.lit(0))
    return F.when(token.rlike("(?i)^[0-9a-f-]+$"), False).when(kinds < 2, False).otherwise(shannon_entropy(token) >= ENTROPY_BITS)


def entropy_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(JAVA_TOKEN), F.lit(0)), is_random)


def redacted(text: Column) -> Column:
    """``text`` with a hole for each secret. Tokens of the entropy net are replaced where they stand, not by value."""
    out = text
    for p in JAVA_PATTERNS:
        out = F.regexp_replace(out, p, HOLE.replace("[", r"\[").replace("]", r"\]"))

    def net(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit(JAVA_TOKEN), F.lit(0))
        pieces = F.zip_with(F.split(t, JAVA_TOKEN, -1), tokens, lambda gap, x: F.concat(gap, F.when(x.isNull(), "").when(is_random(x), HOLE).otherwise(x)))
        return F.when(t.rlike(JAVA_TOKEN), F.array_join(pieces, "")).otherwise(t)

    return let(out, net)


def findings(text: Column, cap: int = FINDINGS_CAP) -> Column:
    """array<struct<pattern, sample>>: each pattern by itself on the original text, so overlaps count more than once.

    Once more than ``cap`` are found each later pattern adds one at most.
    """
    none = F.array().cast("array<struct<pattern:string,sample:string>>")
    capped = F.aggregate(F.array(*_by_pattern(text)), none, lambda out, f: F.concat(out, F.slice(f, F.lit(1), F.greatest(F.lit(1), F.lit(cap + 1) - F.size(out)))))
    return F.when(text.isNull() | (text == ""), none).otherwise(capped)


def find_secrets(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row for each finding of each row of ``df``: keys, pattern, sample.

    Patterns are tested row by row in one pass; rows in which none matches go no further.
    """
    quick = F.lit(False)
    for p in (*JAVA_PATTERNS, JAVA_TOKEN):
        quick = quick | F.col(column).rlike(p)
    found = df.where(quick).select(*keys, F.explode(F.concat(*_by_pattern(F.col(column)))).alias("f"))
    return found.select(*keys, "f.pattern", "f.sample")


def _by_pattern(text: Column) -> list[Column]:
    parts = [(f"p{i}", F.regexp_extract_all(text, F.lit(p), F.lit(0))) for i, p in enumerate(JAVA_PATTERNS)]
    parts.append(("entropy", entropy_tokens(text)))
    return [F.transform(m, lambda t: F.struct(F.lit(name).alias("pattern"), F.concat(F.substring(t, 1, 8), F.lit("...")).alias("sample"))) for name, m in parts]
