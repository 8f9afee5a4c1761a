"""The SQL, for DuckDB, that must give the same rows as the queries."""

from __future__ import annotations

from ..functions.redact import ENTROPY_TOKEN, RE2_PATTERNS
from ..functions.sketch import BANDS, FNV_BASE, FNV_PRIME, MASK, MIX_FACTOR, POSITIONS, ROWS, seeds
from ..functions.text import JS_SPACE, WRAPPERS, normalized_sql

SPACE = f"[{JS_SPACE}]"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def norm_of(table: str, key: str, column: str = "text") -> str:
    return f"SELECT {key} AS id, {normalized_sql(column)} AS norm FROM {table}"


def fnv(s: str) -> str:
    return f"list_reduce(list_prepend({FNV_BASE}::BIGINT, list_transform(string_split({s}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * {FNV_PRIME}) & {MASK})"


def mix(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * {MIX_FACTOR}) & {MASK})"
    return f"xor({x}, ({x}) >> 16)"


def shingles_of(name: str) -> str:
    """(id, shingles) from a CTE of (id, norm)."""
    return f"""SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END AS s
  FROM (SELECT id, list_filter(string_split(norm, ' '), lambda x: x <> '') AS w FROM {name})"""


def sketch_of(prefix: str, table: str, key: str) -> str:
    """CTEs {prefix}sig (id, sig) and {prefix}band (id, band, h)."""
    # mixing in steps keeps the expression short
    seed = ", ".join(f"({i}, {s}::BIGINT)" for i, s in enumerate(seeds()))
    byte = ", ".join(f"(sig[r + {r}] >> {s}) & 255" for r in range(ROWS) for s in (0, 8, 16, 24))
    return f"""{prefix}n AS ({norm_of(table, key)}), {prefix}s AS ({shingles_of(prefix + 'n')}),
{prefix}h AS MATERIALIZED (SELECT DISTINCT id, {fnv('g')} AS h FROM (SELECT id, unnest(s) AS g FROM {prefix}s)),
{prefix}m1 AS (SELECT id, p, xor(h, seed) AS x FROM {prefix}h, (VALUES {seed}) t(p, seed)),
{prefix}m2 AS (SELECT id, p, (xor(x, x >> 16) * {MIX_FACTOR}) & {MASK} AS x FROM {prefix}m1),
{prefix}m3 AS (SELECT id, p, (xor(x, x >> 16) * {MIX_FACTOR}) & {MASK} AS x FROM {prefix}m2),
{prefix}m4 AS (SELECT id, p, min(xor(x, x >> 16)) AS v FROM {prefix}m3 GROUP BY id, p),
{prefix}sig AS MATERIALIZED (SELECT id, list(v ORDER BY p) AS sig FROM {prefix}m4 GROUP BY id),
{prefix}band AS MATERIALIZED (SELECT id, band, list_reduce(list_prepend({FNV_BASE}::BIGINT, [{byte}]), lambda h, c: (xor(h, c) * {FNV_PRIME}) & {MASK}) AS h
  FROM (SELECT id, sig, band, band * {ROWS} + 1 AS r FROM {prefix}sig, range({BANDS}) t(band)))"""


DOCS = sketch_of("d", "documents", "doc_id")


def est(a: str, b: str) -> str:
    return f"len(list_filter(range(1, {POSITIONS + 1}), lambda i: {a}[i] = {b}[i]))::DOUBLE / {POSITIONS}"


PAIRS = f"""{DOCS}, cand AS MATERIALIZED (SELECT DISTINCT x.id AS a, y.id AS b FROM dband x JOIN dband y ON x.band = y.band AND x.h = y.h AND x.id < y.id),
acc AS MATERIALIZED (SELECT a, b, similarity FROM (SELECT a, b, {est('x.sig', 'y.sig')} AS similarity FROM cand JOIN dsig x ON x.id = a JOIN dsig y ON y.id = b) WHERE similarity >= 0.5)"""
GROUPS = f"""{PAIRS}, two AS MATERIALIZED (SELECT a, b FROM acc UNION ALL SELECT b, a FROM acc),
reach(id, z) AS (SELECT a, a FROM two UNION SELECT reach.id, two.b FROM reach JOIN two ON reach.z = two.a),
grp AS MATERIALIZED (SELECT id, min(z) AS root FROM reach GROUP BY id)"""
MEDOIDS = f"""{GROUPS}, sc AS (SELECT g.root, g.id, sum({est('x.sig', 'y.sig')}) AS score FROM grp g JOIN grp o ON o.root = g.root AND o.id <> g.id JOIN dsig x ON x.id = g.id JOIN dsig y ON y.id = o.id GROUP BY g.root, g.id),
med AS (SELECT root, id AS medoid, score FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, id) AS k FROM sc) WHERE k = 1)"""


def entropy(t: str) -> str:
    share = f"((length({t}) - length(replace({t}, c, '')))::DOUBLE / length({t}))"
    return f"-list_sum(list_transform(list_distinct(string_split({t}, '')), lambda c: {share} * log2({share})))"


def is_random(t: str) -> str:
    kinds = " + ".join(f"regexp_matches({t}, '{p}')::INT" for p in ("[A-Z]", "[a-z]", "[0-9]"))
    return f"CASE WHEN regexp_matches({t}, '(?i)^[0-9a-f-]+$') THEN false WHEN {kinds} < 2 THEN false ELSE {entropy(t)} >= 4.2 END"


def redacted(c: str) -> str:
    for p in RE2_PATTERNS:
        c = f"regexp_replace({c}, {q(p)}, '[REDACTED]', 'g')"
    return c


def title(c: str) -> str:
    return f"substr(regexp_replace(regexp_replace({c}, {q(SPACE + '+')}, ' ', 'g'), '^ +| +$', '', 'g'), 1, 80)"


_wrapper = " OR ".join(f"starts_with(regexp_replace(text, {q('^' + SPACE + '+')}, ''), '{w}')" for w in WRAPPERS)
_user = f"role = 'user' AND text <> '' AND NOT ({_wrapper})"
_keys = "array_to_string(list(band::VARCHAR || ':' || lower(to_base(h, 36)) ORDER BY band), ',')"
_seq = "SELECT user_id, list(event_type ORDER BY ts, event_id) AS seq, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id"
_code = f"""WITH s AS ({_seq}), k AS (SELECT event_type, chr((64 + row_number() OVER (ORDER BY event_type))::INT) AS c FROM (SELECT DISTINCT coalesce(event_type, chr(1)) AS event_type FROM events)),
m AS (SELECT map(list(event_type), list(c)) AS m FROM k), c AS (SELECT user_id, array_to_string(list_transform(seq[1:400], lambda x: m[coalesce(x, chr(1))]), '') AS code FROM s, m)
SELECT a.user_id, b.user_id AS next_id, round(1 - levenshtein(a.code, b.code)::DOUBLE / greatest(length(a.code), length(b.code)), 9) AS similarity FROM c a JOIN c b ON b.user_id = a.user_id + 1"""

_clean = f"""SELECT conv_id, turn, CASE WHEN len(toks) = 0 THEN r ELSE array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN toks[i] IS NULL THEN '' WHEN {is_random('toks[i]')} THEN '[REDACTED]' ELSE toks[i] END), '') END AS r
FROM (SELECT conv_id, turn, r, string_split_regex(r, {q(ENTROPY_TOKEN)}) AS gaps, regexp_extract_all(r, {q(ENTROPY_TOKEN)}) AS toks FROM (SELECT conv_id, turn, {redacted('text')} AS r FROM conversations))"""
#: CTE sess: conversations as rows of sessions, by the rules that the made transcripts follow.
_sess = f"""r AS ({_clean}), t AS (SELECT c.conv_id, turn, role, r.r, {_user} AND turn % 5 <> 4 AND c.conv_id % 10 <> 5 AS asks,
  '2026-01-0' || (c.conv_id % 9 + 1) || 'T00:0' || (turn // 2) || ':' || CASE WHEN turn % 2 = 0 THEN '00' ELSE '30' END || 'Z' AS ts FROM conversations c JOIN r USING (conv_id, turn)),
f AS (SELECT conv_id, count(*) AS n, count(*) FILTER (asks) AS p, count(*) FILTER (role = 'assistant') AS a, min(ts) AS t0, max(ts) AS t1, (max(turn) - min(turn)) * 30 AS secs,
  string_agg(r, chr(10) ORDER BY turn) FILTER (asks) AS said, string_agg('T' || (turn % 3), ',' ORDER BY turn) FILTER (role = 'assistant') AS tools,
  CASE conv_id % 13 WHEN 5 THEN '/w/p1x' WHEN 6 THEN '/w/own' END AS given, '/w/p' || (conv_id % 4) AS found, conv_id % 17 = 9 AS unset, conv_id % 11 = 7 AS lost,
  CASE conv_id % 10 WHEN 3 THEN 3 * count(*) >= 10 WHEN 4 THEN 2 * count(*) >= 10 ELSE false END AS failed FROM t GROUP BY conv_id),
w AS (SELECT *, CASE WHEN conv_id % 13 = 5 OR unset OR lost THEN given ELSE coalesce(given, found) END AS cwd FROM f),
k AS (SELECT *, CASE WHEN conv_id % 13 = 5 THEN 'ignored' WHEN unset THEN 'missing' WHEN starts_with(coalesce(cwd, ''), '/w/p1') THEN 'ignored' WHEN lost THEN 'missing' WHEN failed THEN 'parse_failed'
  WHEN p < 1 OR a = 0 AND secs < 60 THEN 'trivial' ELSE 'indexed' END AS status FROM w),
sess AS (SELECT conv_id::VARCHAR AS session_id, coalesce(cwd, 'unknown') AS project, cwd, status, CASE WHEN status <> 'ignored' AND NOT unset AND NOT lost THEN t0 END AS started_at, CASE WHEN status <> 'ignored' AND NOT unset AND NOT lost THEN t1 END AS ended_at,
  CASE WHEN status IN ('trivial', 'indexed') THEN p ELSE 0 END AS prompt_count, CASE WHEN status IN ('trivial', 'indexed') THEN a ELSE 0 END AS tool_call_count,
  CASE WHEN status IN ('trivial', 'indexed') THEN sha256(coalesce(said, '')) END AS prompts_sha256, CASE WHEN status IN ('trivial', 'indexed') THEN coalesce(tools, '') END AS tools FROM k)"""
#: CTEs of documents as sessions: (grp: id, root), facts (a row for each group), within projects and with the gate of sequences.
_docs_as_sessions = f"""{DOCS}, info AS MATERIALIZED (SELECT doc_id AS id, coalesce(nullif(lang, ''), 'unknown') AS project, 'RBW'[1 : (doc_id % 3 + 1)::INT] AS code, ['Read', 'Bash', 'Write'][1 : (doc_id % 3 + 1)::INT] AS seq, '2026-03-0' || (doc_id % 7 + 1) AS day, text FROM documents),
cand AS MATERIALIZED (SELECT DISTINCT x.id AS a, y.id AS b FROM dband x JOIN dband y ON x.band = y.band AND x.h = y.h AND x.id < y.id JOIN info i ON i.id = x.id JOIN info j ON j.id = y.id
  WHERE i.project = j.project AND 1 - levenshtein(i.code, j.code)::DOUBLE / greatest(length(i.code), length(j.code)) >= 0.6),
two AS MATERIALIZED (SELECT a, b FROM (SELECT a, b FROM cand JOIN dsig x ON x.id = a JOIN dsig y ON y.id = b WHERE {est('x.sig', 'y.sig')} >= 0.5) UNION ALL SELECT b, a FROM (SELECT a, b FROM cand JOIN dsig x ON x.id = a JOIN dsig y ON y.id = b WHERE {est('x.sig', 'y.sig')} >= 0.5)),
reach(id, z) AS (SELECT a, a FROM two UNION SELECT reach.id, two.b FROM reach JOIN two ON reach.z = two.a),
grp AS MATERIALIZED (SELECT id, min(z) AS root FROM reach GROUP BY id),
sc AS (SELECT g.root, g.id, sum({est('x.sig', 'y.sig')}) AS score FROM grp g JOIN grp o ON o.root = g.root AND o.id <> g.id JOIN dsig x ON x.id = g.id JOIN dsig y ON y.id = o.id GROUP BY g.root, g.id),
med AS (SELECT root, id AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, id) AS k FROM sc) WHERE k = 1),
facts AS MATERIALIZED (SELECT root, row_number() OVER (ORDER BY root) AS k, n, first_day, last_day, qualified, g.project, substr(sha256(dn.norm || '|' || array_to_string(list_sort(i.seq), ',')), 1, 12) AS fp, {title('i.text')} AS title_hint
  FROM (SELECT root, count(*) AS n, min(day) AS first_day, max(day) AS last_day, count(*) >= 3 AND count(DISTINCT day) >= 2 AS qualified, arg_min(project, id) AS project FROM grp JOIN info USING (id) GROUP BY root) g
  JOIN med USING (root) JOIN info i ON i.id = medoid JOIN dn ON dn.id = medoid)"""

SQL = {
    "overlap_winner": "WITH c AS (SELECT s_suppkey AS cluster_id, ['forming', 'candidate', 'dismissed', 'proposed', 'pushed'][(s_suppkey % 5 + 1)::INT] AS status, s_suppkey % 5 AS p FROM supplier), o AS (SELECT root, cluster_id, count(*) AS overlap FROM (SELECT DISTINCT l_orderkey AS root, l_partkey AS m FROM lineitem) JOIN (SELECT DISTINCT l_suppkey AS cluster_id, l_partkey AS m FROM lineitem) USING (m) GROUP BY 1, 2) SELECT root, cluster_id, status, overlap FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY p DESC, overlap DESC, cluster_id) AS k FROM o JOIN c USING (cluster_id)) WHERE k = 1",
    "user_groups": "SELECT user_id AS root, count(*)::INT AS size, min(strftime(ts, '%Y-%m-%d')) AS first_day, max(strftime(ts, '%Y-%m-%d')) AS last_day, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS n_days, arg_min(event_type, event_id) AS project, count(*) >= 3 AND count(DISTINCT strftime(ts, '%Y-%m-%d')) >= 2 AS qualified FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "session_durations": "SELECT user_id, round((epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) / 1000.0, 3)::DOUBLE AS seconds, 0.0::DOUBLE AS none FROM events GROUP BY user_id",
    "ignored_pages": "SELECT page_id, coalesce(starts_with(url, 'https://www.') OR starts_with(url, 'http://'), false) AS ignored FROM pages",
    "sweep_batch": "WITH s AS (SELECT o_custkey, min(length(o_orderpriority)) AS b FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1), t AS (SELECT o.o_custkey AS session_id, o_orderkey::VARCHAR AS transcript_path, length(o_orderpriority)::BIGINT AS size, strftime(o_orderdate, '%Y-%m-%d') AS mtime FROM orders o LEFT JOIN s ON s.o_custkey = o.o_custkey WHERE b IS NULL OR length(o_orderpriority) > b) SELECT session_id, transcript_path, size, mtime FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY mtime DESC, transcript_path) AS k FROM t) WHERE k = 1 ORDER BY mtime, session_id LIMIT 500",
    "session_index": f"WITH {_sess} SELECT * FROM sess",
    "session_status_counts": f"WITH {_sess} SELECT status, count(*) AS n FROM sess GROUP BY status",
    "member_evidence": f"WITH {_sess}, m AS (SELECT DISTINCT conv_id % 7 AS cluster_id, CASE WHEN conv_id % 3 = 0 THEN 'gone' || conv_id ELSE conv_id::VARCHAR END AS session_id FROM conversations) SELECT cluster_id, m.session_id, project, started_at, tools FROM m LEFT JOIN sess ON sess.session_id = m.session_id",
    "engine_first_run": f"""WITH RECURSIVE {_docs_as_sessions} SELECT CASE WHEN c = 1 THEN fp ELSE substr(fp, 1, 10) || lpad(c::VARCHAR, 2, '0') END AS fingerprint, CASE WHEN qualified THEN 'candidate' ELSE 'forming' END AS status, n::INT AS sessions, first_day, last_day, project, title_hint, NULL::VARCHAR AS blueprint_id
FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY root) AS c FROM facts)""",
    "engine_second_run": f"""WITH RECURSIVE {_docs_as_sessions}, st AS (SELECT k, root, 2 * k - id % 2 AS cluster_id, count(*) AS held FROM grp JOIN facts USING (root) GROUP BY ALL),
c AS (SELECT *, ['forming', 'candidate', 'dismissed', 'proposed', 'pushed'][(cluster_id % 5 + 1)::INT] AS old, [1, 2, 3, 4, 5][(cluster_id % 5 + 1)::INT] AS p, cluster_id % 3 + 1 AS dismissed, 'own' || lpad(cluster_id::VARCHAR, 9, '0') AS own FROM st),
pr AS (SELECT *, CASE old WHEN 'pushed' THEN 5 WHEN 'proposed' THEN 4 WHEN 'dismissed' THEN 3 WHEN 'candidate' THEN 2 ELSE 1 END AS rank_of FROM c),
z AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY rank_of DESC, held DESC, cluster_id) AS pos FROM pr),
u AS (SELECT z.*, f.n, f.first_day, f.last_day, f.qualified, f.project, f.fp, f.title_hint, row_number() OVER (PARTITION BY f.fp, pos = 1 AND old = 'forming' ORDER BY z.root) AS claim FROM z JOIN facts f USING (root) WHERE pos = 1 OR old NOT IN ('forming', 'candidate'))
SELECT cluster_id, CASE WHEN pos = 1 AND old = 'forming' AND claim = 1 THEN fp ELSE own END AS fingerprint,
  CASE WHEN pos > 1 THEN old WHEN old = 'forming' AND qualified THEN 'candidate' WHEN old = 'dismissed' AND n >= 2 * dismissed THEN 'candidate' ELSE old END AS status,
  CASE WHEN pos = 1 THEN first_day END AS first_day, CASE WHEN pos = 1 THEN last_day END AS last_day, CASE WHEN pos = 1 THEN n ELSE held END AS session_count, CASE WHEN pos = 1 THEN project END AS project, CASE WHEN pos = 1 THEN title_hint END AS title_hint,
  NULL::VARCHAR AS blueprint_id, NULL::VARCHAR AS last_pushed_at, dismissed AS dismissed_count, CASE WHEN pos = 1 THEN n ELSE held END AS members FROM u
UNION ALL SELECT (SELECT max(cluster_id) FROM st) + 1, '0123456789ab', 'pushed', NULL, NULL, 0, NULL, NULL, 'b', '2026-07-30T00:00:00.000Z', 0, 0""",
    "normalize_documents": f"SELECT id AS doc_id, norm FROM ({norm_of('documents', 'doc_id')})",
    "normalize_pages": f"SELECT id AS page_id, norm FROM ({norm_of('pages', 'page_id', 'html')})",
    "normalize_conversations": f"SELECT conv_id, turn, {normalized_sql('text')} AS norm FROM conversations",
    "conversation_session_text": f"SELECT conv_id, string_agg({normalized_sql('text')}, ' | ' ORDER BY turn, text) AS session_text FROM conversations WHERE {_user} GROUP BY conv_id",
    "conversation_title_hint": f"SELECT conv_id, {title('arg_min(text, turn)')} AS title_hint FROM conversations WHERE {_user} GROUP BY conv_id",
    "transcript_fold": f"""SELECT conv_id, 'ok' AS status, count(*) FILTER ({_user}) AS prompts, coalesce(string_agg('T' || (turn % 3)::VARCHAR, ',' ORDER BY turn) FILTER (role = 'assistant'), '') AS tools,
  min('2026-01-01T00:' || lpad(turn::VARCHAR, 4, '0')) AS started_at, max('2026-01-01T00:' || lpad(turn::VARCHAR, 4, '0')) AS ended_at, CASE WHEN count(*) FILTER (role NOT IN ('user', 'assistant')) > 0 THEN '/w/p' END AS cwd,
  count(*) AS line_count, 0 AS skipped, count(*) FILTER (role NOT IN ('user', 'assistant')) AS other_types FROM conversations GROUP BY conv_id""",
    "wrapper_turns": f"SELECT role, count(*) AS turns, count(*) FILTER ({_wrapper}) AS wrappers FROM conversations GROUP BY role",
    "word_shingles": f"""WITH n AS ({norm_of('documents', 'doc_id')}), s AS ({shingles_of('n')}), u AS (SELECT id, i, g FROM (SELECT id, unnest(s) AS g, unnest(range(len(s))) AS i FROM s)),
f AS (SELECT id, g, min(i) AS i FROM u GROUP BY id, g), j AS (SELECT id, count(*) AS k, string_agg(g, chr(10) ORDER BY i) AS t FROM f GROUP BY id)
SELECT n.id AS doc_id, coalesce(k, 0) AS n_shingles, sha256(coalesce(t, '')) AS shingles_sha256 FROM n LEFT JOIN j ON n.id = j.id""",
    "fnv_shingle_hash": f"""WITH n AS ({norm_of('documents', 'doc_id')}), s AS ({shingles_of('n')}), h AS (SELECT id, {fnv('g')} AS h FROM (SELECT DISTINCT id, unnest(s) AS g FROM s))
SELECT id AS doc_id, count(*) AS n, min(h) AS lo, max(h) AS hi, sum({mix('h')})::BIGINT AS mixed FROM h GROUP BY id""",
    "minhash_signature": f"WITH {DOCS} SELECT dn.id AS doc_id, array_to_string(sig, ',') AS signature FROM dn LEFT JOIN dsig ON dn.id = dsig.id",
    "lsh_band_keys": f"WITH {DOCS} SELECT id AS doc_id, {_keys} AS band_keys FROM dband GROUP BY id",
    "lsh_candidate_pairs": f"WITH {PAIRS} SELECT a, b FROM cand",
    "near_dup_pairs": f"WITH {PAIRS} SELECT a, b, similarity FROM acc",
    "near_dup_components": f"WITH RECURSIVE {GROUPS} SELECT id AS doc_id, root FROM grp",
    "component_medoids": f"WITH RECURSIVE {MEDOIDS} SELECT root, medoid, score FROM med",
    "component_fingerprints": f"""WITH RECURSIVE {MEDOIDS} SELECT root, medoid, substr(sha256({normalized_sql('text')} || '|'), 1, 12) AS fingerprint, {title('text')} AS title_hint
FROM med JOIN documents ON doc_id = medoid""",
    "benchmark_overlap_pairs": f"""WITH {DOCS}, {sketch_of('b', 'benchmark', 'item_id')}, p AS (SELECT DISTINCT x.id AS doc_id, y.id AS item_id FROM dband x JOIN bband y ON x.band = y.band AND x.h = y.h)
SELECT doc_id, item_id, {est('x.sig', 'y.sig')} AS similarity FROM p JOIN dsig x ON x.id = doc_id JOIN bsig y ON y.id = item_id""",
    "redact_documents": f"""WITH r AS (SELECT doc_id, {redacted('text')} AS r FROM documents), t AS (SELECT doc_id, r, string_split_regex(r, {q(ENTROPY_TOKEN)}) AS gaps, regexp_extract_all(r, {q(ENTROPY_TOKEN)}) AS toks FROM r),
o AS (SELECT doc_id, CASE WHEN len(toks) = 0 THEN r ELSE array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN toks[i] IS NULL THEN '' WHEN {is_random('toks[i]')} THEN '[REDACTED]' ELSE toks[i] END), '') END AS r FROM t)
SELECT doc_id, (length(r) - length(replace(r, '[REDACTED]', ''))) // 10 AS holes, sha256(r) AS redacted_sha256 FROM o""",
    "find_secrets": " UNION ALL ".join(
        [f"SELECT doc_id, 'p{i}' AS pattern, substr(unnest(regexp_extract_all(text, {q(p)})), 1, 8) || '...' AS sample FROM documents" for i, p in enumerate(RE2_PATTERNS)]
        + [f"SELECT doc_id, 'entropy' AS pattern, substr(t, 1, 8) || '...' AS sample FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(ENTROPY_TOKEN)})) AS t FROM documents) WHERE {is_random('t')}"]
    ),
    "entropy_tokens": f"""WITH d AS (SELECT page_id, html FROM pages UNION ALL SELECT doc_id, text FROM documents), t AS (SELECT page_id, unnest(regexp_extract_all(html, {q(ENTROPY_TOKEN)})) AS token FROM d),
g AS (SELECT page_id, token, count(*) AS n FROM t GROUP BY page_id, token) SELECT page_id, token, n, round({entropy('token')}, 6) AS bits, {is_random('token')} AS random FROM g""",
    "clean_documents": f"""SELECT doc_id, NOT ({" OR ".join(f"regexp_matches(text, {q(p)})" for p in RE2_PATTERNS)} OR len(list_filter(regexp_extract_all(text, {q(ENTROPY_TOKEN)}), lambda t: {is_random('t')})) > 0) AS clean FROM documents""",
    "event_sequences": f"SELECT user_id, n, array_to_string(seq, ',') AS sequence FROM ({_seq})",
    "tool_seq_similarity": _code,
    "tool_seq_similarity_arrays": _code,
    "args_digest": """WITH k AS (SELECT event_id, props, list_sort(json_keys(props)) AS ks FROM events), c AS (SELECT event_id, '{' || array_to_string(list_transform(ks, lambda k: '"' || k || '":' || json_extract(props, '$."' || k || '"')::VARCHAR), ',') || '}' AS canonical FROM k)
SELECT event_id, canonical, substr(sha256(canonical), 1, 12) AS digest FROM c""",
    "fingerprint_text": f"SELECT doc_id, substr(sha256({normalized_sql('text')}), 1, 12) AS fingerprint FROM documents",
    "latest_per_key": "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1",
    "upsert_latest_wins": "WITH o AS (SELECT o_custkey, max(o_orderkey) AS order_key, 'old' AS origin FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey), n AS (SELECT o_custkey, max(o_orderkey) AS order_key, 'new' AS origin FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) SELECT * FROM n UNION ALL SELECT * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n)",
    "incremental_anti_join": "WITH l AS (SELECT o_custkey AS session_id, count(*) AS size FROM orders GROUP BY 1), s AS (SELECT o_custkey AS session_id, count(*) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT l.session_id, l.size FROM l LEFT JOIN s ON l.session_id = s.session_id WHERE s.session_id IS NULL OR l.size > s.b",
    "surrogate_ids": "SELECT o_orderkey, 100 + row_number() OVER (ORDER BY o_custkey, o_orderkey) AS cluster_id FROM orders",
    "mark_transition": "WITH e AS (SELECT min(s_name) AS a, max(s_name) AS b FROM supplier) SELECT s_suppkey AS cluster_id, s_name AS fingerprint, CASE s_name WHEN a THEN 'pushed' WHEN b THEN 'dismissed' ELSE 'candidate' END AS status, s_nationkey AS session_count, CASE WHEN s_name = a THEN 'b1' END AS blueprint_id, CASE WHEN s_name = a THEN 't1' END AS last_pushed_at, 'old' AS last_pushed_checksum, CASE WHEN s_name = b THEN s_nationkey ELSE 0 END AS dismissed_count, CASE s_name WHEN a THEN 't1' WHEN b THEN 't2' ELSE 't0' END AS updated_at FROM supplier, e",
}
