"""Text normalization, Arrow-batched, and word shingles as column expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as ECMAScript's \s has it, as the body of a character class. Java and RE2 read it alike, their own \s differ.
JS_SPACE = r"\x09-\x0D\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# What is replaced, in this order, after lower-casing.
REPLACEMENTS = (
    (r"\[redacted\]", " SECRET "),
    (r"https?://[^\s\"'<>)]+", " URL "),
    (r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", " EMAIL "),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", " ID "),
    (r"\b[0-9a-f]{8,}\b", " ID "),
    (r"\b[a-z]:\\[^\s\"'<>|]+", " PATH "),
    (r"(?:~|\.{1,2})?/[\w.@%+-]+(?:/[\w.@%+-]+)+/?", " PATH "),
    (r"\b[\w-]+\.(?:md|txt|json|jsonl|csv|tsv|pdf|docx?|xlsx?|png|jpe?g|gif|svg|ts|js|mjs|cjs|py|rb|go|rs|java|php|html?|css|ya?ml|toml|sh|sql|log|zip|tar|gz)\b", " FILE "),
    (r"\b\d{4}-\d{2}-\d{2}\b", " DATE "),
    (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", " DATE "),
    (r"\b\d+\b", " NUM "),
    (r"[^A-Za-z0-9]+", " "),
)
# End of fixed values.

#: ASCII word boundaries for Java, whose \b knows letters beyond ASCII; its \w and \d are ASCII.
BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
_LEAD = re.compile(r"\\b(?:([A-Za-z]\w*)(?![*+?{])|(\[[^\]]+\]|\\d)(?:\{(\d+)(,(\d*))?\}|(\+))?)")


def with_space(p: str) -> str:
    r"""The pattern with ECMAScript's \s."""
    p = p.replace(r"[^\s", f"[^{JS_SPACE}")
    return p.replace(r"\s", f"[{JS_SPACE}]")


def java_pattern(p: str) -> str:
    r"""The pattern for Java, with the same matches where \b begins and ends it.

    The boundary in front is tested after the first characters, which most places fail at once; a run of one class that
    another character must end is possessive, as giving characters back can't help there.
    """
    flag, p = ("(?i)", p[4:]) if p.startswith("(?i)") else ("", p)
    p = with_space(p)
    if p.endswith(r"\b"):
        p = p[:-2] + BOUNDARY
    m = _LEAD.match(p)
    if m:
        word, atom, low, comma, high, plus = m.groups()
        rest = p[m.end() :]
        if word:
            p = rf"{word}(?<!\w.{{{len(word)}}}){rest}"
        else:
            n = int(low or 1)
            more = "" if not (comma or plus) else f"{atom}{{0,{int(high) - n}}}" if high else f"{atom}*+"
            p = rf"{atom}{{{n}}}(?<!\w.{{{n}}}){more}{rest}"
    elif p.startswith(r"\b(?:"):
        first = "".join(sorted(set(re.findall(r"(?:\(\?:|\|)(\w)", p[2 : p.index(")")]))))
        p = rf"(?=[{first}])(?<!\w){p[2:]}"
    return flag + p


RE2_REPLACEMENTS = tuple((with_space(p), to) for p, to in REPLACEMENTS[:-1])
#: The last replacement and the trim: other bytes than letters and digits are spaces, runs of which are one.
_KEPT = bytes(b if chr(b).isascii() and chr(b).isalnum() else 32 for b in range(256))


def replaced(lower: pa.Array) -> pa.Array:
    """All replacements over lower-cased strings without nulls, by RE2: its time is linear in the text whatever the pattern."""
    for p, to in RE2_REPLACEMENTS:
        lower = pc.replace_substring_regex(lower, p, to)
    return pa.array([b" ".join(t.translate(_KEPT).split()) for t in lower.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())


@F.arrow_udf(StringType())
def _replaced(lower: pa.Array) -> pa.Array:
    return replaced(lower)


@F.arrow_udf(StringType())
def _joined(lower: pa.Array) -> pa.Array:
    """Of arrays of lower-cased strings."""
    norm = replaced(lower.flatten())
    sizes = pc.fill_null(pc.list_value_length(lower), 0).to_numpy(zero_copy_only=False)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), norm)
    return pc.if_else(lower.is_valid(), pc.binary_join(lists, " | "), pa.scalar(None, pa.string()))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def js_ltrim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{JS_SPACE}]+", "")


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def normalized(text: Column) -> Column:
    """Text in which runs of one process on different inputs look alike; null gives an empty string. Time is linear. Arrow-batched."""
    return _replaced(_lower(text))


def normalized_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    out = f"lower(coalesce({text}, ''))"
    for p, to in REPLACEMENTS:
        out = f"regexp_replace({out}, '{with_space(p).replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return f"trim({out}, ' ')"


def session_text(prompts: Column) -> Column:
    """Prompts are normalized first and joined after, so the bar between them is a word of its own."""
    return _joined(F.transform(prompts, _lower))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: plans inline expressions, into lambdas too, wherever they are named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: w != "")


def word_shingles(norm: Column, k: int = 3) -> Column:
    """Distinct shingles of k words, in order of first sight; fewer words are one shingle, none give an empty array."""

    def of(w: Column) -> Column:
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " ")))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(many)

    return let(words(norm), of)


def title_hint(prompt: Column) -> Column:
    """The first prompt on one line, at most 80 characters."""
    return F.substring(js_trim(F.regexp_replace(prompt, f"[{JS_SPACE}]+", " ")), 1, 80)


# Texts with these openings are not prompts of a person.
WRAPPERS = ("<command-name>", "<local-command-stdout>", "<local-command-stderr>", "<system-reminder>", "<command-message>")


def is_wrapper(text: Column) -> Column:
    t = js_ltrim(text)
    out = F.lit(False)
    for w in WRAPPERS:
        out = out | t.startswith(w)
    return out
