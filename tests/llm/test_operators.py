"""Every operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.llm import bpe, decontamination, embedding_dedup, line_dedup, near_dedup, pii, sharding, substring_dedup, toxicity

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 5 == 0 else f"s{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    shared = [words(rng, 120), words(rng, 90)]
    line = "a line that many of the documents hold"
    out: list[str | None] = [None, "", " \n ", "x", "é" * 30, "a" * 3000]
    for i in range(n):
        t = words(rng, rng.randrange(5, 200))
        if i % 3 == 0:
            t = t[: len(t) // 2] + " " + shared[i % 2] + " " + t[len(t) // 2 :]
        if i % 4 == 0:
            t += f"\n{line}\n  {line.upper()} \t\nlast"
        out.append(t)
        if i % 5 == 0:
            w = t.split(" ")
            w[len(w) // 2] = "changed"
            out += [t, " ".join(w)]
    return out


#: Names that columns of ours have had, or could be taken for.
CLASHES = ("_d", "_t", "_t1", "_t2", "_gone", "_d_0", "_GONE_0", "_t1_0", "_spans", "_items", "_spans_0", "cands", "_text", "_text_0", "_g0", "_c0", "key", "h1", "pos", "n")


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def keeps_clashing(out):
    row = out.first()
    return all(row[c] == f"own {c}" for c in CLASHES)


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# 1

def digest1(df):
    return sorted(((r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()))


@pytest.mark.parametrize("threshold", [40, 400])
def test_substrings(spark, threshold):
    texts = corpus(2)
    want = substring_dedup.brute_force([(t or "").encode() for t in texts], threshold)
    df = frame(spark, texts).withColumn("kept", F.lit("clash")).withColumn("n_bytes", F.lit(1))
    assert digest1(substring_dedup.dedup_substrings(df, threshold)) == sorted(want)


def test_substrings_null_and_repeated_ids(spark):
    texts = ["b" * 50 + "c" * 450, "b" * 50 + "c" * 450, "zz" + "c" * 430, words(random.Random(1), 150)]
    want = substring_dedup.brute_force([t.encode() for t in texts])
    assert digest1(substring_dedup.dedup_substrings(frame(spark, texts, [None, None, 3, 3]))) == sorted(want)
    assert substring_dedup.dedup_substrings(frame(spark, [])).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 64, 300])
def test_substrings_in_pieces(spark, piece):
    rng = random.Random(piece)
    shared = words(rng, 30)
    texts = [words(rng, 20) + shared + words(rng, 20), shared, "a" * 500, words(rng, 5) + "a" * 120, None]
    want = substring_dedup.brute_force([(t or "").encode() for t in texts], 40)
    assert digest1(substring_dedup.dedup_substrings(frame(spark, texts), 40, piece)) == sorted(want)


def test_substrings_clashing_columns(spark):
    assert keeps_clashing(substring_dedup.dedup_substrings(clashing(frame(spark, corpus(5, 6)))))


# 2

_W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UP = {c: c + 32 for c in range(65, 91)}


def brute2(texts, items):
    bench = [(str(i), _W.findall(t.translate(_UP))) for i, t in items if i is not None and t is not None]
    out = []
    for t in texts:
        w = _W.findall((t or "").translate(_UP))
        hit, found = set(), set()
        for item, b in bench:
            n = min(10, len(b))
            wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found.add(item)
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 200])
def test_decontamination(spark, block):
    rng = random.Random(5)
    items = [(i, words(rng, n, "abc")) for i, n in enumerate((3, 1, 15, 30, 12))] + [(None, "x"), (7, None), (8, ""), (2, "Été ÄB 9"), (9, "the the")]
    texts = corpus(3, 12)
    for i, t in items:
        if t:
            texts.append("Before, " + t.upper().replace(" ", " - ") + " after " + words(rng, 10))
            texts.append(words(rng, 5, "abc") + " " + " ".join(t.split()[-11:]) + "\n" + t)
    df = frame(spark, texts).withColumn("n_hit", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(df, b, block_bytes=block).collect()}
    want = brute2(texts, items)
    for i, (t, w) in enumerate(zip(texts, want)):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["item_ids"]) == w
        if w[1] == 0:
            assert got[i]["clean_text"] == t
        else:
            assert len(_W.findall(got[i]["clean_text"])) <= w[0] - w[1]
    empty = decontamination.decontaminate(frame(spark, ["a b"]), spark.createDataFrame([], "item_id BIGINT, text STRING"))
    assert empty.first()["n_hit"] == 0


def test_decontamination_clashing_columns_and_long_items(spark):
    rng = random.Random(6)
    items = [(1, words(rng, 400, "abc")), (2, words(rng, 35, "abc")), (3, "one two")]
    texts = [words(rng, 30, "abc"), items[0][1], "x " + " ".join(items[0][1].split()[150:190]) + " y", "say one, two", None]
    b = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    out = decontamination.decontaminate(clashing(frame(spark, texts)), b, block_bytes=300)
    assert keeps_clashing(out)
    got = {r["doc_id"]: r for r in out.collect()}
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["item_ids"]) for i in range(len(texts))] == brute2(texts, items)


def test_fm_index():
    from recurra.llm.fm_index import FMIndex

    rng = np.random.default_rng(1)
    seq = np.concatenate(([0], rng.integers(1, 4, 300), [0], rng.integers(1, 4, 200), [0]))
    index = FMIndex(seq, 3)
    for n in (1, 2, 5):
        p = rng.integers(1, 4, (20, n))
        lo, hi = index.search(np.concatenate((np.full((20, 6 - n), -1), p), axis=1))
        for row, a, b in zip(p, lo, hi):
            at = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == row).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == at


# 3

def test_bpe(spark):
    codec = bpe.codec(bpe.TOKENIZER)
    rng = random.Random(7)
    texts = corpus(4, 10) + ["<|endoftext|> a<|endoftext|>b", "café ́x", "I'll don't 123 漢字 𐍈  y z", words(rng, 9000)]
    texts += [texts[-1] + " end", "start " + texts[-1]]
    rows = bpe.encode_documents(frame(spark, texts).withColumn("decoded", F.lit(1))).collect()
    for r in rows:
        e = codec.tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() == e and r["n_tokens"] == len(e)
        assert r["decoded"] == codec.tok.decode(e, skip_special_tokens=False)
    assert bpe.encode_documents(frame(spark, [])).count() == 0


def test_bpe_joins_and_reuse(monkeypatch):
    for k, v in {"LEAST": 8, "MASK_BITS": 4, "MOST": 64}.items():
        monkeypatch.setattr(bpe, k, v)
    rng = random.Random(9)
    parts = ["a", "B", " ", "\n", "é", "́", "'s", "12", "<|endoftext|>", "<|startof", "text|>", "漢", "𐍈", "ß", "İ", "...", "ᄒ", "ᅡ", " the ", " and "]
    for name in (bpe.TOKENIZER, "byte_bpe_50k.json"):
        codec = bpe.Codec(name, store_tokens=500)
        for _ in range(300):
            s = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 200)))
            assert codec.encode([s])[0].tolist() == codec.tok.encode(s, add_special_tokens=False).ids
        t = words(rng, 300)
        codec.encode([t])
        made = codec.made
        codec.store_tokens = 10**6
        codec.encode([t])
        again = codec.made
        codec.encode([t + " more", t])
        assert codec.made - again <= 3 and again >= made


def test_bpe_windows_grow(spark):
    """Chunks at bad joins: texts without safe places, and joins that disagree."""
    c = bpe.Codec()
    rng = random.Random(41)
    texts = ["漢字" * 3000, "x" * 40_000, words(rng, 4000) + "漢" * 5000 + words(rng, 4000), "1.2,3" * 4000]
    want = [c.tok.encode(t, add_special_tokens=False).ids for t in texts]
    for t, w in zip(texts, want):
        ends = bpe.cuts(t)
        assert c._repaired(t, [t[a:b] for a, b in zip([0, *ends], ends)]).tolist() == w
        assert c.encode([t])[0].tolist() == w
    real, calls = bpe._ends, []

    def disagree(ids, tail):
        calls.append(1)
        return len(calls) % 3 > 0 and real(ids, tail)

    bpe._ends = disagree
    try:
        t = words(rng, 9000)
        assert c.encode([t])[0].tolist() == c.tok.encode(t, add_special_tokens=False).ids and c.repairs
    finally:
        bpe._ends = real


# 4

def brute4(vectors, cosine=0.95):
    unit = [embedding_dedup.unit_vector(v) for v in vectors]
    n, parent = len(vectors), list(range(len(vectors)))
    links = [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, links[i], find(i), find(i) == i) for i in range(n)]


@pytest.mark.parametrize("part", [512, 5])
def test_embeddings(spark, monkeypatch, part):
    monkeypatch.setattr(embedding_dedup, "PART_ROWS", part)
    rng = np.random.default_rng(11)
    base = rng.standard_normal((12, 16))
    vectors = [(b + 0.25 * rng.uniform(0, 1.2) * rng.standard_normal(16)).tolist() for b in base for _ in range(9)]
    vectors += [vectors[0], [2 * x for x in vectors[0]], vectors[5], None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 0.0], [2.0, 0.0]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, n_links STRING")
    got = by_id(embedding_dedup.near_duplicate_vectors(df), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted(brute4(vectors), key=repr)


def test_embedding_edges(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = by_id(embedding_dedup.near_duplicate_vectors(df), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted([(None, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=repr)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_embeddings_of_repeated_ids(spark):
    """A vec_id with two vectors is one component, linked by either, and each row counts its own vector's links."""
    rows = [(0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 0.0]), (5, [1.0, 0.01]), (6, [0.01, 1.0]), (7, [-1.0, 0.0])]
    for order in (1, -1):
        df = spark.createDataFrame(rows[::order], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
        got = by_id(embedding_dedup.near_duplicate_vectors(df), "vec_id", "n_links", "component_id", "kept")
        assert got == sorted([(0, 2, 0, True), (1, 1, 0, False), (1, 2, 0, False), (1, 0, 0, False), (5, 1, 0, False), (6, 2, 0, False), (7, 0, 7, True)], key=repr)


def test_embeddings_of_two_lengths_in_a_bucket(spark):
    raw = [np.array(v, np.float64).tobytes() for v in ([1.0, 0.0], [1.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.0])]
    rows = [(5, 0, 0, 0, 10 + i, i, 1, v, bytes(4)) for i, v in enumerate(raw)]
    units = spark.createDataFrame(rows, "bucket BIGINT, p INT, q INT, side INT, id BIGINT, vec_id BIGINT, times BIGINT, vec BINARY, keys BINARY").coalesce(1)
    got = {(r["a"], r["b"], r["n"]) for r in embedding_dedup._links(units, 0.95).collect()}
    assert got == {(0, 1, 0), (2, 3, 0)} | {(10 + i, None, 1) for i in range(4)}


# 6

@pytest.mark.parametrize("heavy", [0, 100])
def test_sharding(spark, heavy):
    texts = corpus(6, 150) + ["the same text in a great many copies " * 30] * heavy
    out = sharding.shard_documents(frame(spark, texts).withColumn("shard", F.lit("clash"))).collect()
    assert len(out) == len(texts)
    for r in out:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    total = [0] * 8
    slots: dict[int, list[int]] = {}
    for r in out:
        total[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    shard_of = {}
    assert all(shard_of.setdefault(r["text_crc32"], r["shard"]) == r["shard"] for r in out)
    group = max(sum(r["size"] for r in out if r["text_crc32"] == c) for c in shard_of)
    rest = [t for t in total if t < group] if heavy else total
    assert max(rest) <= 1.25 * sum(rest) / len(rest)


def test_sharding_edges(spark):
    got = by_id(sharding.shard_documents(frame(spark, [None, "", "a", "a"], [None, 1, 2, 2])), "doc_id", "size", "slot")
    assert sorted((i is None, i or 0, s) for i, s, _ in got) == [(False, 1, 1), (False, 2, 2), (False, 2, 2), (True, 0, 1)]
    assert sharding.shard_documents(frame(spark, [])).count() == 0


# 7

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    g = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(g))))
        return 16 <= len(g) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(g) <= 15


def brute7(t):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if passes(k, m.group())] for k, p in PATTERNS.items()}


PII = [
    None, "", "a@b.c_d@e.f x@y z a.b@c-d.e.f, é𐍈 m@n.o", "@a.b a@ a@.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.000004 00000000000000000000000000001.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111x 6011000990139424 6011000990139424", "5" * 70_000, "a" * 70_000 + " b@c.d", "1 " * 9000,
    "+1 (509) 555-6973 190.137.223.204 call +44 20 7946 0958 +1 +12345678 + 1 +1234567", "x" * 100_000 + "@", "4" * 16 + "." + "1.1.1", "me [at] here [dot] org",
]


def test_pii(spark):
    out = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, PII).withColumn("base_ip", F.lit(1))).collect()}
    for i, t in enumerate(PII):
        want = brute7(t)
        assert {k: [(x["start"], x["end"]) for x in out[i][f"base_{k}"]] for k in pii.KINDS} == want
        for a in out[i]["added"]:
            assert not any(s < a["end"] and a["start"] < e for s, e in want[a["kind"]])
    assert (0, 17) in [(a["start"], a["end"]) for a in out[9]["added"]]  # a phone that runs into an address
    assert pii.find_personal_data(frame(spark, [])).count() == 0
    assert keeps_clashing(pii.find_personal_data(clashing(frame(spark, ["a b", None]))))


def test_pii_scores_as_its_trees_do(spark):
    """Every candidate's choice by the SQL expression against the trees walked in Python; held-out recall and precision."""
    rng = random.Random(31)
    texts = [t for t, *_ in rng.sample(pii.examples([], 40, 99), 400)]
    model = pii.fit(frame(spark, texts).select("text"))
    found = pii.candidates(pii.base_spans(frame(spark, texts))).select("doc_id", F.explode("cands").alias("c")).select("doc_id", "c.*", model.chosen(F.col("c")).alias("chosen")).collect()
    x = np.array([[r[f] for f in pii.FEATURES] for r in found], float)

    def walk(row):
        score = model.trees.base
        for tree in model.trees.trees:
            i = 0
            while 2 * i + 1 < len(tree):
                f, edge, _ = tree[i]
                i = 2 * i + 1 + (f >= 0 and row[f] > edge)
            score += tree[i][2]
        return 1 / (1 + math.exp(-score)) >= model.cut - 1e-9

    assert len(found) > 150 and [r["chosen"] for r in found] == [walk(r) for r in x] == model.takes(x).tolist()
    assert 0.05 < np.mean([r["chosen"] for r in found]) < 0.9
    for kind, (recall, precision, n) in model.report.items():
        assert n > 10 and recall >= 0.6 and precision >= 0.9, (kind, recall, precision, n)


def test_pii_adds_what_the_base_loses_and_leaves_the_rest(spark):
    good = ["pay 4111.1111.1111.1111 now", "4111111111111111 6011000990139424", "call (509) 555-6973 soon", "write joe.doe [at] mail.example.com today"]
    bad = ["pay 4111.1111.1111.1112 now", "4111111111111112 6011000990139425", "order 509-555-6973 soon", "version 1.2.3.999", "we met at noon dot two", "x4111111111111112y", "room 12 at 10.30"]
    rows = {r["doc_id"]: r["added"] for r in pii.find_personal_data(frame(spark, good + bad)).collect()}
    assert all(rows[i] for i in range(len(good))) and len(rows[1]) == 2
    assert not any(rows[i] for i in range(len(good), len(good + bad)))


def test_pii_random(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["1", "23", "255", ".", ".", "-", " ", "+", "(", ")", "@", "a", "é", "4111111111111111", "\n"]) for _ in range(80)) for _ in range(150)]
    for r in pii.find_personal_data(frame(spark, texts)).collect():
        assert {k: [(x["start"], x["end"]) for x in r[f"base_{k}"]] for k in pii.KINDS} == brute7(texts[r["doc_id"]])


# 8

def test_toxicity(spark):
    rng = random.Random(8)
    bad = ["vilest", "rotter", "cretinous"]
    texts, labels = [], []
    for i in range(600):
        t = words(rng, rng.randrange(20, 60)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        texts.append(" ".join(t))
        labels.append((i, None if i % 50 == 7 else int(toxic)))
    texts += ["", None, "you v1lest r0tter cr3tinous", "VILEST rotter! vilest you"]
    df = frame(spark, texts).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels + labels[:10], "doc_id BIGINT, toxic INT")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(df, lab).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and sum(out[i]["predicted"] == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[600]["predicted"] == out[601]["predicted"] == 0
    assert out[602]["predicted"] == out[603]["predicted"] == 1
    none = toxicity.score_toxicity(df, lab.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.score_toxicity(frame(spark, []), lab).count() == 0


def test_toxicity_of_rare_inflected_words():
    """Toxic rows of a second, rarer language: each has other forms of one stem, none in 5 % of the toxic rows."""
    rng = random.Random(88)
    forms = list(dict.fromkeys(words(rng, 400).split()))
    texts, toxic, second = [], [], []
    for i in range(900):
        own = rng.random() < 0.3
        t = words(rng, rng.randrange(40, 90), "ijklmnop" if own else "abcdefgh").split()
        y = i % 6 == 0
        if y:
            for _ in range(4):
                t.insert(rng.randrange(len(t)), rng.choice(("réeux", "reeux", "RÉEUX")) + rng.choice(forms) if own else rng.choice(("vilest", "rotter")))
        texts.append(" ".join(t))
        toxic.append(y)
        second.append(own)
    y, second, k = np.array(toxic, float), np.array(second), np.arange(900)
    fit = k < 700
    model = toxicity.Model(texts[:700], y[fit], k[fit] % 5 == 1)
    found = model.score(texts[700:]) >= toxicity.THRESHOLD
    marked = (y[~fit] == 1) & second[~fit]
    assert marked.sum() >= 5 and found[marked].all() and found[y[~fit] == 0].mean() < 0.03


def test_held_out_is_the_contract(spark):
    got = {r[0]: r[1] for r in spark.range(200).select("id", toxicity.held_out(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_isotonic():
    from recurra.llm.boosting import Isotonic

    p = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    f = Isotonic().fit(p, np.array([0, 1, 0, 1, 1, 1.0]))
    out = f.predict(p)
    assert (np.diff(out) >= 0).all() and out[0] == 0 and out[-1] == 1


# 9

def brute9(rows, least=20, docs=3):
    keys: dict[str, set] = {}
    ids = [i for i, _ in rows if i is not None]

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(_UP)

    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                keys.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(keys.get(key(x), ())) < docs or i == max(keys[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert ids or not rows
    return out


@pytest.mark.parametrize("batches, fanout", [(1, 2), (3, 2), (5, 3)])
def test_lines(spark, batches, fanout):
    texts = corpus(10) + ["É" * 25 + "\n" + "é" * 25, "É" * 25, "É" * 25 + "\n\n", "x\n" * 50 + "a line that many of the documents hold\n" * 3]
    ids = [*range(len(texts) - 2), None, 3]
    got = by_id(line_dedup.dedup_lines(frame(spark, texts, ids).withColumn("kept_text", F.lit(0)), batches=batches, fanout=fanout), "doc_id", "n_lines", "n_dropped", "kept_text")
    assert got == sorted(brute9(list(zip(ids, texts))), key=repr)


def test_lines_runs_hold_each_key_once(spark):
    from recurra.llm.common import Scratch

    texts = corpus(11, 60)
    lines = Scratch(spark).save(line_dedup.keyed_lines(frame(spark, texts), 3), "lines")
    runs = line_dedup.LineRuns(Scratch(spark), fanout=2)
    for b in range(5):
        runs.add(lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == b))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    keys = [(r["h1"], r["h2"]) for run in runs.runs for r in run.read().collect()]
    assert len(keys) == len(set(keys)) == lines.select("h1", "h2").distinct().count()
    known = {(r["h1"], r["h2"]): r["n_docs"] for r in runs.updates.read().collect()}
    assert known and set(known) <= set(keys)


def test_lines_clashing_columns(spark):
    assert keeps_clashing(line_dedup.dedup_lines(clashing(frame(spark, corpus(12, 8)))))


def test_lines_empty(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


# 10

def brute10(texts, width, similarity):
    sets = []
    for t in texts:
        w = (t or "").translate(_UP).encode().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * similarity.denominator >= similarity.numerator * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


@pytest.mark.parametrize("width, similarity, rows", [(3, Fraction(85, 100), 512), (5, Fraction(4, 5), 512), (3, Fraction(85, 100), 6)])
def test_near_duplicates(spark, monkeypatch, width, similarity, rows):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows)
    rng = random.Random(12)
    texts = corpus(12, 25)
    base = words(rng, 80).split()
    for i in range(40):  # a group in which many pairs lie on either side of the threshold
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"w{i}"
        texts.append(" ".join(w))
    df = frame(spark, texts).withColumn("component_id", F.lit("clash"))
    got = by_id(near_dedup.near_duplicates(df, width, similarity), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute10(texts, width, similarity), key=repr)


def test_near_duplicate_edges(spark):
    got = by_id(near_dedup.near_duplicates(frame(spark, ["a b c", "A b\tc", "a b c", None, " "], [5, 4, None, 1, 2])), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([(5, 1, 4, False), (4, 1, 4, True), (None, 1, None, True), (1, 0, 1, True), (2, 0, 2, True)], key=repr)
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_repeated_ids(spark, monkeypatch):
    """A doc_id with several texts is one document, linked by any of them."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    rng = random.Random(10)
    base = [words(rng, 120) for _ in range(12)]
    near = [t + " more" for t in base]
    b, a, c = base[:3]
    texts, ids = [b, a, b, near[1], near[2], c, "", near[0], ""], [0, 1, 1, 5, 6, 9, 5, 9, 4]
    # one doc_id with many texts, each near another document's
    texts += base[3:] + near[3:]
    ids += [20] * 9 + list(range(21, 30))
    root = {i: 0 for i in (0, 1, 5, 6, 9)} | {4: 4} | {i: 20 for i in range(20, 30)}
    for order in (1, -1):
        got = near_dedup.near_duplicates(frame(spark, texts[::order], ids[::order]), 3, Fraction(4, 5)).collect()
        assert len(got) == len(ids)
        assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(i, z, i == z) for i, z in root.items()}


def test_radius_keeps_its_miss_rate():
    for similarity in (Fraction(4, 5), Fraction(85, 100), Fraction(1, 2), Fraction(95, 100), Fraction(1)):
        far, n = float(1 - similarity), near_dedup.POSITIONS
        radius = near_dedup.radius_of(similarity)
        assert sum(math.comb(n, r) * far**r * (1 - far) ** (n - r) for r in range(radius + 1, n + 1)) < 1 / 30_000
    assert near_dedup.radius_of(Fraction(85, 100)) == 22


def test_keys_are_shared_within_the_radius():
    """The pigeonhole guarantee, over random errors."""
    rng = np.random.default_rng(13)
    for radius in (10, 22, 26, 40):
        plan = near_dedup.key_plan(radius)
        a = rng.integers(0, 2**16, (300, near_dedup.POSITIONS)).astype("<u2")
        b = a.copy()
        for row in b:
            at = rng.choice(near_dedup.POSITIONS, rng.integers(0, radius + 1), replace=False)
            row[at] ^= 1
        assert (near_dedup.signature_keys(a, plan) == near_dedup.signature_keys(b, plan)).any(axis=1).all()


# 5

def test_token_counts(spark):
    from recurra.llm import token_counts

    e = token_counts.encoder(token_counts.TOKENIZER)
    texts = corpus(14, 8) + ["a\n\n\nb\n", "\n", "é漢𐍈\n\n é", "word " * 500 + "\n\n\n\n" + "x" * 3000]
    df = frame(spark, texts).withColumn("title", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T\n\n"), F.col("doc_id").cast("string")))).withColumn("sections", F.lit(1))
    for fields in (("text",), ("title", "text")):
        for r in token_counts.token_counts(df, fields).collect():
            parts = [(f, r[f]) for f in fields if r[f] is not None]
            owner, chars = [], "\n".join(v for _, v in parts)
            for k, (f, v) in enumerate(parts):
                for i, line in enumerate(v.split("\n")):
                    owner += [(f, i)] * (len(line.encode()) + 1)
            want, at, crossing = {(f, i): 0 for f, v in parts for i in range(v.count("\n") + 1)}, 0, 0
            ids = e.encoding.encode_ordinary(chars)
            for t in ids:
                n = len(e.encoding.decode_single_token_bytes(t))
                want[owner[at]] += 1
                crossing += owner[at] != owner[at + n - 1]
                at += n
            assert {(s["field"], s["section"]): s["tokens"] for s in r["sections"]} == want
            assert (r["n_tokens"], r["n_crossing"]) == (len(ids), crossing) and at == len(chars.encode())
            for s in r["sections"]:
                line = r[s["field"]].split("\n")[s["section"]]
                assert r[s["field"]][s["start"] : s["end"]].rstrip("\n") == line
    assert token_counts.token_counts(frame(spark, [])).count() == 0


def test_token_counts_of_long_texts_and_null_ids(spark):
    from recurra.llm import token_counts

    texts = ["word of a long line " * 40_000, None, "a\nb", "", "a\nb"]
    out = token_counts.token_counts(clashing(frame(spark, texts, [None, None, 1, 2, 1])))
    assert keeps_clashing(out)
    e = token_counts.encoder(token_counts.TOKENIZER).encoding
    got = sorted((r["doc_id"] or 0, r["n_tokens"], sum(s["tokens"] for s in r["sections"]), len(r["sections"])) for r in out.collect())
    n = [len(e.encode_ordinary(t or "")) for t in texts]
    assert got == sorted([(0, n[0], n[0], 1), (0, 0, 0, 0), (1, n[2], n[2], 2), (2, 0, 0, 1), (1, n[4], n[4], 2)])


def test_embeddings_at_the_threshold(spark):
    """Pairs on either side of the cosine, as near as doubles tell; ties among equal vectors."""
    up, down = math.acos(0.95) - 1e-7, math.acos(0.95) + 1e-7
    rows = [(4, [1.0, 0.0]), (2, [math.cos(up), math.sin(up)]), (9, [math.cos(down), -math.sin(down)]), (7, [2.0, 0.0]), (5, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert got == {4: (3, 2), 7: (3, 2), 5: (3, 2), 2: (3, 2), 9: (0, 9)}
