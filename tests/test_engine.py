"""Transcripts, clustering, lifecycle and the read surface, end to end."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from recurra import config
from recurra.config import Rules
from recurra.operators import groups, lifecycle, tables
from recurra.operators.components import components
from recurra.plans.engine import Engine, SecretsFound, derived_field, problems
from recurra.sources import documents, queue, transcripts
from recurra.sources.scratch import Scratch
from recurra.streaming.drain import drain_queue


def user(text, ts, cwd="/w/p", **more):
    return {"type": "user", "message": {"role": "user", "content": text}, "timestamp": ts, "cwd": cwd, **more}


def tool(name, ts, arg=None):
    return {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "1", "name": name, "input": arg or {"k": 87}}]}, "timestamp": ts}


def release(day, version, cwd="/w/p"):
    t = f"2026-07-{day:02d}T10:0"
    return [
        user(f"Draft the weekly release notes for v{version} using CHANGELOG.md", t + "0:00Z", cwd),
        tool("Read", t + "1:00Z"),
        tool("Bash", t + "2:00Z"),
        user(f"Publish the notes to the stable channel and tag version {version}", t + "3:00Z", cwd),
        tool("Write", t + "4:00Z"),
    ]


def write(path, entries):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries) + "\n", "utf-8")
    return str(path)


def test_fold():
    f = transcripts.fold("\n".join([json.dumps(e) for e in release(1, "2.1.0")] + ["", '{"type":"summary","new":1}', "not json", "[1]", '{"type":1}', '{"a":NaN,"type":"x"}', '{"a":1} x']))
    assert (f["status"], f["line_count"], f["skipped"], f["other_types"]) == ("parse_failed", 11, 5, 1)
    assert [c["name"] for c in f["tool_calls"]] == ["Read", "Bash", "Write"] and f["tool_calls"][0]["digest"] == "252103d07575"
    assert f["started_at"] == "2026-07-01T10:00:00Z" and f["ended_at"] == "2026-07-01T10:04:00Z" and f["cwd"] == "/w/p"


def test_prompts():
    def one(content, **more):
        return transcripts.fold(json.dumps({"type": "user", "message": {"role": "user", "content": content}, **more}))["prompts"]

    assert one("hi") == ["hi"] and one(" ") == [" "] and one("") == []
    assert one("  <system-reminder>x") == [] and one("hi", isMeta=True) == []
    assert one([{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]) == ["a\nb"]
    assert one([{"type": "text", "text": "a"}, {"type": "tool_result"}]) == []
    bad = transcripts.fold('{"type":"user","message":{"role":"assistant","content":"x"}}\n{"type":"assistant","message":{"role":"assistant","content":"x"}}')
    assert bad["skipped"] == 2 and bad["status"] == "ok"


def test_config(tmp_path):
    p = tmp_path / "c.json"
    assert config.load(p) == config.DEFAULTS
    assert config.put(p, "similarity.prompt_jaccard", "0.4")["similarity"] == {"prompt_jaccard": 0.4, "tool_sequence": 0.6}
    assert config.put(p, "publish.tags", '["a"]')["publish"] == {"folder": None, "tags": ["a"]}
    assert config.put(p, "x.y", "plain")["x"] == {"y": "plain"}
    p.write_text("nonsense")
    assert config.load(p) == config.DEFAULTS


def test_queue(spark, tmp_path):
    q = tmp_path / "q"
    queue.enqueue(q, {"session_id": "a/b", "cwd": "/x"})
    queue.enqueue(q, {"session_id": "a/b", "cwd": "/y"})
    assert queue.enqueue(q, "garbage").name.startswith("unknown-")
    (q / "bad.json").write_text("{")
    rows = {r["session_id"]: r["cwd"] for r in queue.queued(spark, str(q)).collect()}
    assert rows["a/b"] == "/y" and len(rows) == 2 and (q / "a-b.json").exists()


def test_documents(spark, tmp_path):
    import zipfile

    (tmp_path / "a.html").write_text("<p>x</p><script>no</script>y")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>he</w:t><w:t>llo</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "c.docx").write_text("no zip")
    out = {r["path"].rsplit("/")[-1]: r["text"] for r in documents.documents(spark, str(tmp_path)).collect()}
    assert out["b.docx"] == "hello" and out["c.docx"] is None and out["a.html"].split() == ["x", "y"]


@pytest.mark.parametrize("parts", [1, 7])
def test_components(spark, parts):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (50, 60), (7, 7)] + [(100, i) for i in range(101, 140)]
    df = spark.createDataFrame(edges, "a BIGINT, b BIGINT").repartition(parts)
    got = {r["id"]: r["root"] for r in components(df, Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 40} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a STRING, b STRING"), Scratch(spark)).count() == 0


@pytest.mark.parametrize("share", [3, 10, 10_000])
def test_join_lookup(spark, monkeypatch, share):
    """Hot keys by broadcast, the others by shuffle, or all by broadcast: the same rows as a plain join."""
    from recurra.operators import skew

    monkeypatch.setattr(skew, "HOT_SHARE", share)
    rows = [(k, i) for k, n in ((1, 40), (2, 5), (3, 1), (4, 1), (None, 9), (9, 2)) for i in range(n)]
    left = spark.createDataFrame(rows, "k INT, i INT")
    right = spark.createDataFrame([(1, "a", 40), (2, None, 5), (3, "c", 1), (9, "d", 2)], "k INT, v STRING, n BIGINT")
    got = skew.join_lookup(left, right, ["k"], "n", len(rows))
    assert got.columns == ["k", "i", "v"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, i, {1: "a", 2: None, 3: "c", 9: "d"}[k]) for k, i in rows if k in (1, 2, 3, 9)), key=repr)


def test_upsert_and_latest(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k STRING, v INT")
    new = spark.createDataFrame([("b", None), ("c", 3)], "k STRING, v INT")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", None), ("c", 3)]
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k STRING, t INT, v STRING")
    assert sorted(r["v"] for r in tables.latest(df, ["k"], [F.desc("t")]).collect()) == ["y", "z"]


def test_medoid_is_the_sum_of_pairs(spark):
    rows = [("g", f"s{i}", [(i * j) % 5 for j in range(128)]) for i in range(6)]
    got = groups.medoids(spark.createDataFrame(rows, "root STRING, id STRING, sig ARRAY<BIGINT>")).first()
    score = {a[1]: sum(sum(x == y for x, y in zip(a[2], b[2])) for b in rows if b is not a) / 128 for a in rows}
    best = min(score, key=lambda k: (-score[k], k))
    assert (got["medoid"], got["score"]) == (best, score[best])


def group(root, members, qualified=True, fp="aaaaaaaaaaaa"):
    return (root, len(members), "2026-07-01", "2026-07-02", qualified, "p", fp, "t")


GROUP = "root STRING, size INT, first_day STRING, last_day STRING, qualified BOOLEAN, project STRING, fingerprint STRING, title_hint STRING"


def test_reconcile(spark):
    from recurra.schemas import CLUSTERS, MEMBERS

    def row(i, status, fp, n=2, dismissed=0):
        return (i, fp, status, None, None, n, None, None, None, None, None, dismissed, None)

    clusters = spark.createDataFrame([row(1, "forming", "f1"), row(2, "pushed", "f2"), row(3, "candidate", "f3"), row(4, "dismissed", "f4", 3, 3), row(5, "forming", "f5")], CLUSTERS)
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "a"), (4, "x"), (5, "lone")], MEMBERS)
    new = {"a": (["a", "b", "c"],), "m": (["m", "n"], False, "f2"), "x": (["x", "y", "z", "u", "v", "w"],)}
    facts = spark.createDataFrame([group(r, *g) for r, g in new.items()], GROUP)
    fresh = spark.createDataFrame([(r, i) for r, g in new.items() for i in g[0]], "root STRING, session_id STRING")
    c, m = lifecycle.reconcile(facts, fresh, clusters, members, "now", Scratch(spark))
    c = {r["cluster_id"]: r for r in c.collect()}
    assert set(c) == {2, 4, 5, 6}  # forming and candidate taken in by the pushed one
    assert (c[2]["status"], c[2]["fingerprint"], c[2]["session_count"]) == ("pushed", "f2", 3)
    assert c[4]["status"] == "candidate" and c[5]["fingerprint"] == "f5"
    assert (c[6]["status"], c[6]["fingerprint"]) == ("forming", "f202")
    m = {(r[0], r[1]) for r in m.collect()}
    assert {x for x in m if x[0] == 2} == {(2, "a"), (2, "b"), (2, "c")} and (5, "lone") in m and not any(x[0] in (1, 3) for x in m)


def test_end_to_end(spark, tmp_path):
    root, q = tmp_path / "projects", tmp_path / "queue"
    paths = {f"s{d}": write(root / "p" / f"s{d}.jsonl", release(d, f"2.{d}.0")) for d in (1, 2, 3)}
    write(root / "p" / "noise.jsonl", [user("Plan a birthday party with balloons", "2026-07-05T00:00:00Z"), tool("Grep", "2026-07-05T00:10:00Z")])
    write(root / "p" / "short.jsonl", [user("hello", "2026-07-05T00:00:00Z")])
    e = Engine(spark, str(tmp_path / "store"), clock=lambda: datetime(2026, 7, 30, tzinfo=UTC))
    for d in (1, 2):
        queue.enqueue(q, {"session_id": f"s{d}", "transcript_path": paths[f"s{d}"], "cwd": "/w/p"})
    queue.enqueue(q, {"session_id": "lost", "transcript_path": str(tmp_path / "no.jsonl")})
    drain_queue(spark, e, str(q), str(tmp_path / "ck")).awaitTermination()
    assert e.status()["sessions"] == {"indexed": 2, "missing": 1}
    assert [r["status"] for r in e.summaries().collect()] == ["forming"]
    out = e.run(projects_root=str(root), deep=True)
    assert out["deep_remaining"] == 0
    s = e.status()
    assert s["sessions"] == {"indexed": 4, "trivial": 1, "missing": 1} and len(s["candidate"]) == 1
    fp = e.pending().first()["fingerprint"]
    members = e.cluster(fp).collect()
    assert [m["session_id"] for m in members] == ["s1", "s2", "s3"] and members[0]["tool_seq"] == ["Read", "Bash", "Write"]
    assert all(m["transcript_still_on_disk"] for m in members)
    # a fourth member doesn't change the identity; a grown file is read again
    write(root / "p" / "s4.jsonl", release(4, "2.4.0"))
    e.run(projects_root=str(root), deep=True)
    row = e.pending().first()
    assert (row["fingerprint"], row["sessions"]) == (fp, 4)
    e.mark(fp, "pushed", blueprint_id="b", checksum="c")
    assert e.pending().isEmpty() and e.store.read("clusters").where("status = 'pushed'").first()["last_pushed_checksum"] == "c"
    assert e.summaries("pushed").columns == ["fingerprint", "status", "sessions", "first_day", "last_day", "project", "title_hint", "blueprint_id"]
    e.mark("0123456789ab", "dismissed")
    assert e.status()["dismissed"] == 1
    with pytest.raises(ValueError):
        e.mark(fp, "forming")


def test_cross_project_and_ignored(spark, tmp_path):
    root = tmp_path / "projects"
    for i, cwd in enumerate(("/a", "/b/1", "/b/2"), 1):
        write(root / "p" / f"s{i}.jsonl", release(i, f"1.{i}.0", cwd))
    e = Engine(spark, str(tmp_path / "store"))
    e.config_set("ignore_projects", '["/a"]')
    e.config_set("cross_project", "true")
    e.run(projects_root=str(root), deep=True)
    assert e.status()["sessions"] == {"ignored": 1, "indexed": 2}
    assert e.summaries().first()["sessions"] == 2
    assert e.sweep(str(root)) == 0


def test_proposals(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    draft = {"proposal_version": 1, "source": "detected", "fingerprint": "0123456789ab", "title": "T", "summary": "S", "kickoff_fields": [{"label": "V", "type": "short_text", "options": []}], "steps": [{"position": 1, "title": "a", "description": "Use {{V}}", "executor_hint": "ai"}]}
    assert problems(draft) == [] and problems(draft | {"steps": [draft["steps"][0] | {"description": "{{W}}"}]}) == ["step 1"]
    e.save_proposal("0123456789ab", draft)
    e.save_proposal("0123456789ab", draft | {"title": "U"})
    assert e.proposal("0123456789ab")["draft"]["title"] == "U" and e.proposal("none") is None
    with pytest.raises(SecretsFound):
        e.save_proposal("x", draft | {"summary": "line\nAK" + "IA" + "ABCDEFGH12345678"})


def test_groups_need_project_days_and_members(spark):
    sig = [list(range(128)), list(range(128)), [*range(64), *range(500, 564)], [*range(60), *range(900, 968)]]
    rows = [(f"s{i}", p, f"2026-07-0{d}T", None, ["x"], ["A"], s) for i, (p, d, s) in enumerate(zip("ppqp", (1, 2, 3, 4), sig))]
    df = spark.createDataFrame(rows, "session_id STRING, project STRING, started_at STRING, ended_at STRING, prompts ARRAY<STRING>, tool_seq ARRAY<STRING>, minhash ARRAY<BIGINT>")
    def found(rules):
        facts, members = groups.described_groups(df, rules, Scratch(spark))
        own = sorted(r["session_id"] for r in members.collect())
        return [(own, r["qualified"], r["n_days"], r["medoid"], r["project"]) for r in facts.collect()]

    assert found(Rules()) == [(["s0", "s1"], False, 2, "s0", "p")]
    assert found(Rules(cross_project=True)) == [(["s0", "s1", "s2"], True, 3, "s0", "p")]


def slow_reconcile(groups_, clusters, members):
    """The lifecycle one group after another: clusters {id: [status, fingerprint, size, dismissed]}, members {id: set}."""
    rows, mem, used = {i: list(r) for i, r in clusters.items()}, {i: set(m) for i, m in members.items()}, set()
    priority = {"pushed": 5, "proposed": 4, "dismissed": 3, "candidate": 2, "forming": 1}
    last, placed = max(rows, default=0), {}
    for root, ids, qualified, fp in sorted(groups_):
        met = sorted((i for i in rows if i not in used and members.get(i, set()) & ids), key=lambda i: (-priority[rows[i][0]], -len(members[i] & ids), i))
        for i in met[1:]:
            if rows[i][0] in ("forming", "candidate"):
                del rows[i], mem[i]
        if met:
            at = met[0]
            r = rows[at]
            if r[0] == "forming":
                r[0] = "candidate" if qualified else "forming"
            elif r[0] == "dismissed" and r[3] and len(ids) >= 2 * r[3]:
                r[0] = "candidate"
            r[2] = len(ids)
        else:
            at = root  # named later: ids of new clusters go by root
            rows[at] = ["candidate" if qualified else "forming", None, len(ids), 0]
        used.add(at)
        placed[root], mem[at] = at, ids
    for k, root in enumerate(sorted(r for r, at in placed.items() if at == r), last + 1):
        rows[k], mem[k] = rows.pop(root), mem.pop(root)
    return {i: (r[0], r[2]) for i, r in rows.items()}, {(i, x) for i, m in mem.items() for x in m}


def test_reconcile_random(spark):
    """Chains of groups that contend for clusters, against the sequential rules; fingerprints stay unique."""
    import random

    from recurra.schemas import CLUSTERS, MEMBERS

    for seed in range(3):
        rng = random.Random(seed)
        ids = [f"s{i:03d}" for i in range(60)]
        parts: dict[str, set] = {}
        for i in ids:
            if rng.random() < 0.8:
                parts.setdefault(f"g{rng.randrange(14):02d}", set()).add(i)
        groups_ = [(r, m, rng.random() < 0.5, rng.choice(["ffffffffff01", "ffffffffff02", f"fp{r}xxxxxxx"])) for r, m in parts.items()]
        clusters = {k: (rng.choice(["forming", "candidate", "dismissed", "proposed", "pushed"]), f"own{k:09d}", 2, rng.randrange(4)) for k in range(1, 13)}
        members = {k: set(rng.sample(ids, rng.randrange(1, 7))) for k in clusters}
        facts = spark.createDataFrame([(r, len(m), "d", "d", q, "p", fp, "t") for r, m, q, fp in groups_], GROUP)
        fresh = spark.createDataFrame([(r, i) for r, m, _, _ in groups_ for i in m], "root STRING, session_id STRING")
        c = spark.createDataFrame([(k, fp, st, None, None, n, None, None, None, None, None, d, None) for k, (st, fp, n, d) in clusters.items()], CLUSTERS)
        m = spark.createDataFrame([(k, i) for k, x in members.items() for i in x], MEMBERS)
        got_c, got_m = lifecycle.reconcile(facts, fresh, c, m, "now", Scratch(spark))
        want_c, want_m = slow_reconcile(groups_, clusters, members)
        rows = got_c.collect()
        assert {r["cluster_id"]: (r["status"], r["session_count"]) for r in rows} == want_c
        assert {tuple(r) for r in got_m.collect()} == want_m
        assert len({r["fingerprint"] for r in rows}) == len(rows) and all(r["fingerprint"] for r in rows)


def test_derived_fields():
    assert [derived_field("x", v)["type"] for v in (["2026-01-02", "03/04/2026"], ["a/b.csv", "c.pdf"], ["stable", "beta", "stable"], ["one", "two"], ["a\nb"], ["y" * 101])] == ["date", "file", "dropdown", "short_text", "long_text", "long_text"]
    assert derived_field("x", ["b", "a", "b"])["options"] == ["b", "a"]


def test_queue_is_read_in_order_and_bad_entries_are_logged(spark, tmp_path):
    q = tmp_path / "queue"
    for name in ("b", "a"):
        queue.enqueue(q, {"session_id": name})
    (q / "0bad.json").write_text("{no json")
    assert [r["session_id"] for r in queue.queued(spark, str(q)).collect()] == ["a", "b"]
    e = Engine(spark, str(tmp_path / "store"), log_path=str(tmp_path / "log.txt"))
    e.run(queue_dir=str(q))
    assert not list(q.glob("*.json")) and e.status()["sessions"] == {"missing": 2}
    assert "1 entries of 3 could not be read" in (tmp_path / "log.txt").read_text()
