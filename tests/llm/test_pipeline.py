"""The stages of the pipeline, each against a brute-force version on its own input."""

from __future__ import annotations

import random
from fractions import Fraction

from test_operators import _W, brute2, brute9, brute10, frame, words

import corpus_pipeline
from recurra.llm import bpe


def make(tmp_path, spark):
    rng = random.Random(21)
    item = words(rng, 30)
    texts, labels = [], []
    for i in range(400):
        t = words(rng, rng.randrange(30, 80))
        if i % 6 == 0:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "rotter"]))
            t = " ".join(w)
        if i % 7 == 0:
            t += "\nthe very same line in many documents\nend " + str(i)
        if i % 11 == 1:
            t += " " + item.upper()
        if i % 13 == 2:
            t = texts[-1] + " tail"
        texts.append(t)
        labels.append((i, int("vilest" in t or "rotter" in t)))
    texts += [None, "", texts[1]]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id BIGINT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    return [(0, item)]


def test_stages(spark, tmp_path):
    items = make(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    schema = docs.schema.simpleString()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        rows = {r["doc_id"]: r for r in out.collect()}
        assert name == "bpe" or out.schema.simpleString() == schema
        if name == "toxicity":
            toxic = {i for i, t in before.items() if t and ("vilest" in t or "rotter" in t)}
            wrong = toxic & set(rows) | (set(before) - toxic) - set(rows)
            assert len(wrong) <= 0.02 * len(before) and {400, 401} <= set(rows)
        elif name == "line_dedup":
            want = brute9(list(before.items()))
            assert {i: r["text"] for i, r in rows.items()} == {i: t for i, _, _, t in want}
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        elif name == "near_dedup":
            ids = sorted(before)
            want = brute10([before[i] for i in ids], 5, Fraction(4, 5))
            assert set(rows) == {ids[i] for i, _, _, kept in want if kept}
        elif name == "decontamination":
            ids = sorted(before)
            hits = brute2([before[i] for i in ids], items)
            assert set(rows) == set(ids) and any(h[1] for h in hits)
            for i, h in zip(ids, hits):
                assert len(_W.findall(rows[i]["text"])) == h[0] - h[1]
        else:
            tok = bpe.codec(bpe.TOKENIZER).tok
            for i, t in before.items():
                assert rows[i]["n_tokens"] == len(tok.encode(t or "", add_special_tokens=False).ids)
        docs = out
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in docs.collect())
