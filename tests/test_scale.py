"""Steps that must not make more rows, or read their input more often, than their work needs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recurra.functions import sketch, text
from recurra.operators import groups, tables
from recurra.plans import queries
from recurra.sources.scratch import Scratch


def test_first_choices_are_the_winners_of_all_overlaps(spark, monkeypatch):
    """Small arrays and a large group too; members twice in a table count twice, as in the join."""
    r = random.Random(7)
    groups = [(f"g{r.randrange(40)}", f"s{r.randrange(60)}") for _ in range(300)] + [("large", f"s{i}") for i in range(60)] + [("alone", "none")]
    members = [(r.randrange(50), f"s{r.randrange(60)}") for _ in range(900)] + [(99, "s1"), (1, None)]
    clusters = [(i, ("forming", "candidate", "dismissed", "proposed", "pushed", "other")[i % 6]) for i in range(50)]
    g = spark.createDataFrame(groups, "root string, session_id string")
    m = spark.createDataFrame(members, "cluster_id bigint, session_id string")
    c = spark.createDataFrame(clusters, "cluster_id bigint, status string")
    want = tables.winners(tables.overlaps(g, c, m), c).where("rank = 1").select("root", "cluster_id", "status", "overlap")
    want = sorted(map(tuple, want.collect()))
    for block, share in ((1024, 10_000), (2, 10)):
        monkeypatch.setattr(tables, "BLOCK", block)
        monkeypatch.setattr(tables, "HOT_SHARE", share)
        got = tables.first_choices(g, c, m, Scratch(spark))
        assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 30


@pytest.fixture
def documents(spark, tmp_path):
    r = random.Random(3)
    body = [" ".join(r.choice(("see", "Report-2.pdf", "a@b.de", "42", "Ünder", "the", "x")) for _ in range(r.randrange(40))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*body, None, "", "...", "one", *body[:20], *body[:20]])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_normalization_runs_no_pattern_in_java(spark, documents):
    for q in (queries.normalize_documents, queries.fingerprint_text):
        assert "regexp_replace" not in plan(q(spark, documents))


def test_replacements_are_those_of_the_definition():
    cases = ["[redacted] x", "see https://a.b/c?d=e, f", "c:\\a\\b ../a/b/ ~/x/y", "2026-01-02 1/2/26 0123456789ab", "\u00e9a@b.de\u00a0\u3000z", "a\x00b", "", "-a.md--b.pdf.txt"]
    want = pa.array(cases)
    for p, to in text.REPLACEMENTS:
        want = pa.compute.replace_substring_regex(want, text.with_space(p), to)
    assert text.replaced(pa.array(cases)).to_pylist() == [t.strip(" ") for t in want.to_pylist()]


def test_session_text_of_nulls_and_slices(spark):
    df = spark.createDataFrame([(None,), ([],), (["A", None, "7"],), (["b"],)], "p array<string>")
    assert [r[0] for r in df.select(text.session_text(F.col("p"))).collect()] == [None, "", "a |  | NUM", "b"]


def test_sketches_are_computed_once(spark, documents):
    """A filter on a sketch was pushed below it, so that text was normalized and sketched twice."""
    for q in (queries.lsh_band_keys, queries.minhash_signature):
        p = plan(q(spark, documents))
        assert p.count("signature(") == 1 and p.count("lower(coalesce(") == 1, p
    assert queries.lsh_band_keys(spark, documents).count() == queries.minhash_signature(spark, documents).where("signature IS NOT NULL").count() == len([t for t in queries.normalize_documents(spark, documents).collect() if t.norm])


def test_shingles_are_hashed_where_they_are(spark, documents):
    p = plan(queries.fnv_shingle_hash(spark, documents))
    assert "Generate" not in p and "HashAggregate" not in p and p.count("lower(coalesce(") == 1
    h = queries._norm(spark, documents).select("doc_id", F.explode(text.word_shingles(F.col("norm"))).alias("s")).select("doc_id", sketch.fnv1a(F.col("s")).alias("h"))
    want = h.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum(sketch.mix32(F.col("h"))).alias("mixed"))
    got = queries.fnv_shingle_hash(spark, documents)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_shingles_of_one_hash_count_apart():
    r = random.Random(1)
    words = list({"".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=12)) for _ in range(200_000)})
    h = sketch.distinct_hashes(" ".join(words + words[:1000]), 1)
    assert len(h) == len(words) > len(np.unique(h))


def test_texts_hashed_together_keep_their_hashes(monkeypatch):
    r = random.Random(2)
    norms = [" ".join(r.choices(("a", "bc", "def", "ghijklmnop"), k=r.randrange(12))) for _ in range(50)] + [None, "", "one", "a" * 300]
    for n in (1, 40, 1 << 18):
        monkeypatch.setattr(sketch, "TOGETHER", n)
        got = list(sketch.batch_hashes(norms))
        assert [h.tolist() for h in got] == [sketch.shingle_hashes(t or "").tolist() for t in norms]


def test_pairs_of_copies_are_spelt_out_of_pairs_of_kinds(spark, documents, monkeypatch):
    """The join made each pair of copies once for each band; it makes pairs of kinds now."""
    seen, plain = [], groups.candidate_pairs
    monkeypatch.setattr(groups, "candidate_pairs", lambda items: seen.append(items.count()) or plain(items))
    items = queries._items(spark, documents)
    want = plain(items)
    got = queries.lsh_candidate_pairs(spark, documents)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    want = groups.accepted_pairs(items, want, queries.DOC_RULES).select("a", "b", "similarity")
    got = queries.near_dup_pairs(spark, documents)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(seen) == 2 and max(seen) <= items.where("sig IS NOT NULL").count() - 30
