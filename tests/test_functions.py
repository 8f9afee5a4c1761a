"""Text, sketches, sequences, digests and redaction, by golden values and by example."""

import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.functions import digests, redact, sequences, sketch, text


def values(spark, expr, *rows, schema="x STRING"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expr).collect()]


NORMAL = {
    "Draft the weekly release notes for v2.14.1 using CHANGELOG.md": "draft the weekly release notes for v2 NUM NUM using FILE",
    "Publish the notes to the stable channel and tag version 2.14.1": "publish the notes to the stable channel and tag version NUM NUM NUM",
    "a/b and src/x/y.js ~/d/e ./q": "a b and src PATH PATH q",
    "id 20260722 or 2026-07-22 or 7/22/26 deadbeef": "id ID or DATE or NUM PATH ID",
    "See https://a.b/c?d and me@x.org [REDACTED]": "see URL and EMAIL SECRET",
    r"open C:\temp\x now": "open PATH now",
    "123e4567-e89b-12d3-a456-426614174000": "ID",
    "": "",
    " \t\n": "",
}


def test_normalized(spark):
    assert values(spark, text.normalized(F.col("x")), *NORMAL) == list(NORMAL.values())
    assert values(spark, text.normalized(F.col("x")), None) == [""]


def test_boundary_is_ascii(spark):
    assert values(spark, text.normalized(F.col("x")), "é2 2é") == ["NUM NUM"]


def test_non_ascii_white_space_ends_urls(spark):
    assert values(spark, text.normalized(F.col("x")), "http://a.b/c d") == ["URL d"]


def test_title_hint_and_wrappers(spark):
    assert values(spark, text.title_hint(F.col("x")), "  a  b\n" + "c" * 100) == ["a b " + "c" * 76]
    assert values(spark, text.is_wrapper(F.col("x")), "\u00a0<system-reminder>x", "x <system-reminder>", "<command-name>") == [True, False, True]


def test_session_text_joins_after_normalizing(spark):
    df = spark.createDataFrame([(["A-b", "C"],), (["", ""],)], "p ARRAY<STRING>")
    assert [r[0] for r in df.select(text.session_text(F.col("p"))).collect()] == ["a b | c", " | "]


def test_word_shingles(spark):
    s = text.word_shingles(F.col("x"))
    assert values(spark, s, "a b c d", "a b", "", "a b c a b c a") == [["a b c", "b c d"], ["a b"], [], ["a b c", "b c a", "c a b"]]


def test_golden_hashes(spark):
    assert sketch.seeds()[:3] == [1120982980, 3911581779, 1066994070] and sketch.seeds()[127] == 11312697
    assert values(spark, sketch.fnv1a(F.col("x")), "", "a b c", "draft the weekly") == [2166136261, 1995710639, 898690526]
    assert values(spark, sketch.mix32(F.col("x")), 0, 1, 123456789, schema="x BIGINT") == [0, 824515495, 1952335732]


def test_golden_signature(spark):
    joined = " | ".join(list(NORMAL.values())[:2])
    sig, one, none = values(spark, sketch.signature("x"), joined, "draft the weekly", "")
    assert sig[:4] == [181556074, 141814371, 74687681, 43617701] and sig[127] == 274683412
    assert one[:3] == [2072464535, 865261328, 2516837117] and none is None
    df = spark.createDataFrame([(sig,)], "s ARRAY<BIGINT>")
    assert df.select(sketch.bands("s")).first()[0][0] == 1685887335
    assert df.select(sketch.band_hashes(F.col("s")) == sketch.bands("s")).first()[0]


def test_signature_equals_its_definition(spark):
    rows = ["a b c d e", "x", "one two | three", ""]
    fast = values(spark, sketch.signature("x"), *rows)
    slow = values(spark, sketch.signature_expr(text.word_shingles(F.col("x"))), *rows)
    assert fast == slow


def test_estimate(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 0, 0]), ([1], None), ([1], [1, 2])], "a ARRAY<BIGINT>, b ARRAY<BIGINT>")
    assert [r[0] for r in df.select(sketch.est_jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (list(rng.integers(0, 4, rng.integers(0, 12))) for _ in range(2))
        assert sequences.edit_distance(a, b) == slow_distance(a, b)


def test_sequence_similarity(spark):
    df = spark.createDataFrame([([], []), (["A"], []), (["Read", "Bash"], ["Read", "Edit"]), (["A"] * 500, ["A"] * 400)], "a ARRAY<STRING>, b ARRAY<STRING>")
    assert [r[0] for r in df.select(sequences.sequence_similarity("a", "b")).collect()] == [1.0, 0.0, 0.5, 1.0]


@pytest.mark.parametrize(
    "value, out",
    [(1e3, "1000"), (1.5, "1.5"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-7, "1e-7"), (0.00001, "0.00001"), (-0.0, "0"), (123.456, "123.456"), (5e-324, "5e-324"), (-2.5e-9, "-2.5e-9"), (12345678901234567890, "12345678901234567000")],
)
def test_js_numbers(value, out):
    assert digests.js_number(value) == out


def test_digests():
    assert digests.digest({"k": 87}) == "252103d07575" and digests.digest(None) == "74234e98afe7"
    assert digests.canonical(json.loads('{"b":[1,{"d":null,"c":true}],"a":"é"}')) == '{"a":"é","b":[1,{"c":true,"d":null}]}'


def test_push_checksum(spark):
    import hashlib

    df = spark.createDataFrame([("T", [("s", "d")], [("l", "date")])], "t STRING, s ARRAY<STRUCT<title:STRING,description:STRING>>, f ARRAY<STRUCT<label:STRING,type:STRING>>")
    assert df.select(digests.push_checksum(F.col("t"), F.col("s"), F.col("f"))).first()[0] == hashlib.sha256(b"T\ns\nd\nl\ndate").hexdigest()


def shapes():
    """Built from pieces, so that no secret stands in this file."""
    n = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {
        "p0": "-----BEGIN RSA " + "PRIVATE KEY-----\nabc\n-----END RSA " + "PRIVATE KEY-----",
        "p1": "ey" + "J" + n[:12] + "." + n[:8] + "." + n[:8],
        "p2": "ey" + "J" + n[:30],
        "p3": "AK" + "IA" + "ABCDEFGH12345678",
        "p4": "aws_secret_" + "access_key = " + n[:24],
        "p5": "gh" + "p_" + n[:24],
        "p6": "github_" + "pat_" + n[:24],
        "p7": "glp" + "at-" + n[:20],
        "p8": "xo" + "xb-" + n[:12],
        "p9": "AI" + "za" + n[:35],
        "p10": "s" + "k-" + n[:24],
        "p11": "s" + "k_live_" + n[:20],
        "p12": "np" + "m_" + n[:32],
        "p13": "S" + "G." + n[:20] + "." + n[:20],
        "p14": "Bea" + "rer " + n[:20],
        "p15": "api_" + "key: '" + n[:16] + "'",
        "entropy": "Zq3" + n[5:45],
    }


def test_every_shape_is_found_and_redacted(spark):
    s = shapes()
    texts = [f"use {v} here" for v in s.values()]
    found = values(spark, redact.findings(F.col("x")), *texts)
    assert all(name in {f["pattern"] for f in fs} for name, fs in zip(s, found))
    clean = values(spark, redact.redacted(F.col("x")), *texts)
    assert all("[REDACTED]" in c for c in clean)
    assert values(spark, redact.redacted(F.col("x")), *clean) == clean
    assert all(not f for f in values(spark, redact.findings(F.col("x")), *clean))


def test_clean_texts_stay(spark):
    texts = ["Plain prose, with a sha 3f786850e387550fdab836ed7e6dc881de23001b3f786850e387550fdab836ed", "123e4567-e89b-12d3-a456-426614174000", "a" * 60, ""]
    assert values(spark, redact.redacted(F.col("x")), *texts) == texts


def test_tokens_are_replaced_where_they_stand(spark):
    """A token within a longer one that stays must not be touched there."""
    secret = "Zq3" + "56789abcdefghijklmnopqrstuvwxyzABCDEFGHI"
    keep = "f" * 40
    assert values(spark, redact.redacted(F.col("x")), f"{keep} {secret}. {secret}") == [f"{keep} [REDACTED]. [REDACTED]"]


def test_findings_cap(spark):
    found = values(spark, redact.findings(F.col("x")), " ".join(["AK" + "IA" + "ABCDEFGH12345678"] * 80 + ["gh" + "p_" + "a1B2" * 6] * 5))[0]
    assert [f["pattern"] for f in found].count("p3") == 51 and [f["pattern"] for f in found].count("p5") == 1


def _python(pattern):
    """A fixed pattern for Python's re, by its plain reading."""
    space = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", text.JS_SPACE)
    p = pattern.replace(r"[^\s", f"[^{space}").replace(r"\s", f"[{space}]")
    return re.compile(p, re.ASCII)


def _plain_normalized(t):
    out = t.lower()
    for p, to in text.REPLACEMENTS:
        out = _python(p).sub(to, out)
    return out.strip(" ")


def test_patterns_match_their_plain_reading(spark):
    rng = random.Random(11)
    bits = ["a", "f0", "-", "_", ".", "@", "/", "~", "..", "md", ".md", "x.py", " ", "12", "2024-01-02", "1/2/24", "c:\\", "deadbeef", "é", "A", "sk-", "eyJ", "token=", "bearer ", "AKIA", "0123456789abcdef", "\u00a0", "http://", "'"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["a.md-b.md", "-a.md", "--a.md", "a@b.cc_d@e.ff", "..../a/b", "~/x/y/", "x" * 50 + "@", "12345678-", "-12345678", "a1.md1", "é.md"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, t STRING")
    cols = [F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"p{i}") for i, p in enumerate(redact.JAVA_PATTERNS)]
    got = df.select("id", text.normalized(F.col("t")).alias("norm"), F.regexp_extract_all("t", F.lit(redact.JAVA_TOKEN), F.lit(0)).alias("tokens"), *cols).collect()
    plain = [_python(p) for p in redact.PATTERNS]
    for r in got:
        t = texts[r["id"]]
        assert r["norm"] == _plain_normalized(t), t
        assert r["tokens"] == re.findall(redact.ENTROPY_TOKEN, t)
        for i, p in enumerate(plain):
            assert r[f"p{i}"] == [m.group() for m in p.finditer(t)], (t, i)


def test_long_runs_take_linear_time(spark):
    n = 1 << 20
    runs = ["a", "-", "/", "a-", "a/", "0", "f", "a.", "@", "a@", "=", "_-", "~", "..", "Ab1"]
    df = spark.createDataFrame([((r * n)[:n],) for r in runs], "t STRING").repartition(1).cache()
    df.count()
    for c in (text.normalized(F.col("t")), redact.redacted(F.col("t")), F.size(redact.findings(F.col("t"))).cast("string")):
        began = time.perf_counter()
        df.select(F.length(c)).collect()
        assert time.perf_counter() - began < len(runs)  # seconds: one for each text
    df.unpersist()
