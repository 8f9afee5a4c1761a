"""The registered queries, from tables to digests, each against a brute-force version; and the guard of the entry file."""

from __future__ import annotations

import hashlib
import importlib.util
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute2, brute7, brute9, brute10, corpus, frame, words

import __spark_entry__ as entry
from recurra.llm import bpe, substring_dedup, toxicity


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(77)
    folder = str(tmp_path_factory.mktemp("tables"))
    item = words(rng, 25)
    texts = corpus(21, 60) + [
        "before " + item.upper() + " after", words(rng, 5) + " " + " ".join(item.split()[3:15]),
        "call +1 (509) 555-6973 190.137.223.204 or a.b@c-d.example.org 1.2.3.4 4111 1111 1111 1111", "4111111111111111 6011000990139424",
        "漢字 𐍈 " * 40, "x\n" * 40, "Same line in many documents here\nz", "same line in many documents here \ny", "SAME LINE IN MANY DOCUMENTS HERE", "w " * 20_000 + "end",
    ]
    bad, labels = ["vilest", "rotter", "cretinous"], []
    for i in range(len(texts), len(texts) + 260):
        t = words(rng, rng.randrange(20, 60)).split()
        if i % 4 == 0:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        labels.append((i, int(i % 4 == 0)))
        texts.append(" ".join(t))
    frame(spark, texts).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id BIGINT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    items = [(0, item), (1, "one two"), (2, None), (3, words(rng, 4))]
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    vec = []
    base = np.random.default_rng(5).standard_normal((12, 16))
    for i in range(60):
        v = base[i % 12] + (0 if i % 5 == 0 else 0.05 * (i % 9)) * np.random.default_rng(i).standard_normal(16)
        vec.append((i, [float(x) for x in v]))
    vec += [(60, None), (61, [0.0] * 16), (62, [math.nan] + [1.0] * 15)]
    spark.createDataFrame(vec, "vec_id BIGINT, embedding ARRAY<DOUBLE>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, texts, labels, items, vec


def rows(spark, tables, name, key="doc_id"):
    out = {r[key]: r.asDict() for r in entry.queries()[name](spark, tables[0]).collect()}
    assert len(out) == (len(tables[1]) if key == "doc_id" else len(tables[4]))
    return out


def test_op1(spark, tables):
    got = rows(spark, tables, "op1_suffix_array_dedup")
    want = substring_dedup.brute_force([(t or "").encode() for t in tables[1]])
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(want))] == want
    assert any(w[1] for w in want)


def test_op2(spark, tables):
    got = rows(spark, tables, "op2_decontamination")
    for i, (n, hit, items) in enumerate(brute2(tables[1], tables[3])):
        g = got[i]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == (n, hit, len(items), sha(",".join(items)), hit > 0)


def test_op3(spark, tables):
    tok = bpe.codec(bpe.TOKENIZER).tok
    got = rows(spark, tables, "op3_bpe")
    for i, t in enumerate(tables[1]):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        g = got[i]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False)))


def test_op4(spark, tables):
    got = rows(spark, tables, "op4_embedding_near_dedup", "vec_id")
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in tables[4] if i < 60}
    links = {i: {j for j in ok if j != i and ok[i] @ ok[j] >= 0.95} for i in ok} | {i: set() for i in (60, 61, 62)}
    for i in links:
        reach, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links[i]), min(reach), min(reach) == i)
    assert sum(map(len, links.values())) > 100


def test_op5(spark, tables):
    from recurra.llm.token_counts import Encoder

    e = Encoder("byte_bpe_50k.tiktoken").encoding
    for i, g in rows(spark, tables, "op5_token_counts").items():
        t = tables[1][i]
        assert g["n_tokens"] == len(e.encode_ordinary(t or "")) == sum(g["section_tokens"])
        assert g["n_sections"] == (0 if t is None else t.count("\n") + 1) == len(g["section_tokens"])


def test_op6(spark, tables):
    got = rows(spark, tables, "op6_kd_sharding")
    size, slots, shard_of = [0] * 8, {}, {}
    for i, t in enumerate(tables[1]):
        g, data = got[i], (t or "").encode()
        assert (g["size"], g["text_crc32"], g["law"], g["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        size[g["shard"]] += g["size"]
        slots.setdefault(g["shard"], []).append(g["slot"])
        assert shard_of.setdefault(t or "", g["shard"]) == g["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(size) == sum(len((t or "").encode()) + 1 for t in tables[1])


def test_op7_and_its_base(spark, tables):
    got, base = rows(spark, tables, "op7_pii"), rows(spark, tables, "pii_base")
    kinds = ("email", "ip", "card", "phone")
    for i, t in enumerate(tables[1]):
        want = brute7(t)
        told = [f"{k}:{a}:{b}" for k in kinds for a, b in want[k]]
        for g in (got[i], base[i]):
            assert [g[f"n_{k}"] for k in kinds] == [len(want[k]) for k in kinds] and g["base_sha256"] == sha(",".join(told))
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(told) <= set(spans) and len(spans) == got[i]["n_spans"] == len(set(spans))
        assert spans == sorted(spans, key=lambda s: (kinds.index(s.split(":")[0]), int(s.split(":")[1]), int(s.split(":")[2])))
    assert got[tables[1].index("4111111111111111 6011000990139424")]["n_spans"] == 2


def slow_score(model, text: str) -> float:
    """A text's score by plain loops over the model's words, stems, trees and steps of calibration."""
    raw = text.encode()
    lower = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in raw)
    leet = bytes(toxicity._LEET.get(b, lower[k]) for k, b in enumerate(raw))
    w = lower.split()
    n = max(1, len(w))
    hits = sum(x in model.strong for x in w)
    hidden = max(0, sum(x in model.strong for x in leet.split()) - hits)
    near = sum(x in model.strong and any(y in toxicity._SECOND for y in w[max(0, k - 5) : k + 6]) for k, x in enumerate(w))
    spaced = sum(re.sub(rb"[^a-z]", b"", m) in model.strong for m in re.findall(rb"(?<![a-z])(?:[a-z][ ._*-]){3,}[a-z](?![a-z])", raw.lower()))
    fold = toxicity.folded(raw)
    begun = sum(x.startswith(s) for x in fold for s in model.stems)
    different = len({x for x in fold if x.startswith(model.stems)}) if model.stems else 0
    size = max(1, len(raw))
    x = [hits + hidden, (hits + hidden) / n, len(set(w) & set(model.strong)), sum(x in model.weak for x in w) / n, near, sum(65 <= b <= 90 for b in raw) / size, sum(b in b"!?#$%&*@" for b in raw) / size, hidden, spaced, sum(48 <= b <= 57 for b in raw) / size, math.log1p(len(raw)), 1 - len(set(w)) / n, begun / n, different]
    if not raw:
        x = [0] * 14
    score = model.trees.base
    for tree in model.trees.trees:
        i = 0
        while 2 * i + 1 < len(tree):
            f, edge, _ = tree[i]
            i = 2 * i + 1 + (f >= 0 and x[f] > edge)
        score += tree[i][2]
    p = 1 / (1 + math.exp(-score))
    at, to = model.calibrate.x, model.calibrate.y
    if p <= at[0]:
        c = to[0]
    elif p >= at[-1]:
        c = to[-1]
    else:
        k = max(j for j in range(len(at)) if at[j] <= p)
        c = to[k] + (to[k + 1] - to[k]) * (p - at[k]) / (at[k + 1] - at[k])
    return 0.99 * min(max(c, 0), 1) + 0.01 * p


def test_op8(spark, tables):
    got = rows(spark, tables, "op8_toxicity")
    model = toxicity.fit(spark.read.parquet(f"{tables[0]}/documents.parquet"), spark.read.parquet(f"{tables[0]}/labels.parquet"))
    for i, t in enumerate(tables[1]):
        g = got[i]
        assert abs(g["score"] - slow_score(model, t or "")) < 1e-9, i
        assert g["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and g["predicted"] == int(g["score"] >= 0.3)
    held = [(i, y) for i, y in tables[2] if got[i]["held_out"]]
    toxic = [got[i]["predicted"] for i, y in held if y]
    assert len(toxic) >= 8 and np.mean(toxic) >= 0.9 and np.mean([got[i]["predicted"] for i, y in held if not y]) <= 0.05


def test_op8_repeated_and_long_documents(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id BIGINT, toxic INT")
    texts = [("vile rotter " if i % 2 else "kind person ") * 5 for i in range(80)]
    df = frame(spark, texts + texts[:5] + ["vile " * 300_000, "kind " * 300_000], [*range(80), *range(5), 100, None])
    out = [(r["doc_id"], r["predicted"]) for r in toxicity.score_toxicity(df, labels).collect()]
    assert sorted(out, key=repr) == sorted([(i, i % 2) for i in [*range(80), *range(5)]] + [(100, 1), (None, 0)], key=repr)


def test_op8_sample_is_bounded_in_bytes(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id BIGINT, toxic INT")
    df = frame(spark, [("vile " if i % 2 else "kind ") * 50 for i in range(400)])
    model = toxicity.fit(df, labels, fit_bytes=20_000)
    assert model is not None and model.score(["vile " * 50])[0] > 0.5 > model.score(["kind " * 50])[0]


def test_op9(spark, tables):
    got = rows(spark, tables, "op9_line_dedup")
    for i, n, dropped, kept in brute9(list(enumerate(tables[1]))):
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (n, dropped, sha(kept))
    assert sum(g["n_dropped"] for g in got.values()) > 5


def test_op10(spark, tables):
    got = rows(spark, tables, "op10_minhash_near_dedup")
    want = brute10(tables[1], 3, Fraction(85, 100))
    assert [(i, got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(want))] == want


def test_only_an_absent_subpackage_is_let_pass(monkeypatch):
    assert "op1_suffix_array_dedup" in entry.queries() and "pipeline" in entry.queries()
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda m, *a: None if m in ("recurra.llm", "corpus_pipeline") else real(m, *a))
    assert not [q for q in entry.queries() if q.startswith("op") or q in ("pipeline", "pii_base")] and entry.queries()
    monkeypatch.undo()
    monkeypatch.setitem(__import__("sys").modules, "recurra.llm.registry", None)
    monkeypatch.delattr("recurra.llm.registry", raising=False)
    with pytest.raises(ImportError):
        entry.queries()


def test_near_dedup_work_of_a_hot_group(spark, monkeypatch):
    """Near copies of one text: the classes compared after the leaders' round don't grow with the group."""
    from recurra.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    seen = []
    real = near_dedup._block_units
    monkeypatch.setattr(near_dedup, "_block_units", lambda met, scratch: (lambda u: (seen.append(u.count()), u)[1])(real(met, scratch)))
    rng = random.Random(61)
    base = words(rng, 200)
    others = [words(rng, 60) for _ in range(20)]
    for n in (40, 160):
        texts = [f"{base} tail{i}" for i in range(n)] + others
        out = near_dedup.near_duplicates(frame(spark, texts), 3, Fraction(85, 100)).collect()
        assert {r["component_id"] for r in out if r["doc_id"] < n} == {0} and sum(r["kept"] for r in out) == 21
    assert seen[1] <= seen[0] + 20
