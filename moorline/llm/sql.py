"""SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from moorline.llm.sharding import PRIME, SEED, SHARDS, round_keys
from moorline.llm.url_filter import HOST_RULES, PATTERN_RULES


def url_filter_sql() -> str:
    host_rules = ", ".join(f"({k}, '{r.verdict}', '{r.host}', '{r.path}')" for k, r in enumerate(HOST_RULES))
    patterns = " ".join(f"WHEN regexp_matches(low, '{r.pattern}') THEN '{r.verdict}'" for r in PATTERN_RULES)
    return f"""
WITH rules(number, verdict, host, path) AS (VALUES {host_rules}),
urls AS (
  SELECT page_id, url, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM urls),
fitting AS (
  SELECT p.page_id, p.host, p.path, p.low, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY (r.number IS NULL), length(r.host) + length(r.path) DESC, length(r.host) DESC, r.number) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE {patterns} ELSE 'allow' END) AS verdict
FROM fitting WHERE k = 1"""


NGRAM_JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.v) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach r ON r.u = d.doc_id GROUP BY d.doc_id"""

EMBEDDING_DEDUP_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
degree AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT e.vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(r.v) AS component_id, e.vec_id = min(r.v) AS kept
FROM embeddings e LEFT JOIN degree USING (vec_id) JOIN reach r ON r.u = e.vec_id GROUP BY e.vec_id"""

#: Texts in hex, two letters a byte; the windows of 100 bytes one by one.
SUFFIX_DEDUP_SQL = """
WITH bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM bytes)),
repeats AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1),
marked AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, -1) AS starts FROM repeats),
numbered AS (SELECT doc_id, p, sum(starts::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, span),
pieces AS (
  SELECT doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS before
  FROM spans JOIN bytes USING (doc_id)),
cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS k, max(b) AS behind, string_agg(before, '' ORDER BY a) AS kept FROM pieces GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(behind, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)"""

ORACLE_SQL = {"op4_ngram_join": NGRAM_JOIN_SQL, "op5_url_filter": url_filter_sql(), "op7_suffix_dedup": SUFFIX_DEDUP_SQL, "op8_embedding_dedup": EMBEDDING_DEDUP_SQL}


def sharding_sql(shards: int, seed: int) -> str:
    """Row numbers through the Feistel network, walked by recursion; CRC-32 by its table."""
    keys = ", ".join(f"{{'l': 0, 'r': 0, 'a': {a}, 'b': {b}}}" for a, b in round_keys(seed))
    once = f"((s.r * k.a + k.b) % {PRIME})"
    mixed = f"((({once} % 46337) * ({once} // 46337) + {once}) % {PRIME})"

    def network(x: str) -> str:
        start = f"{{'l': ({x}) // side, 'r': ({x}) % side, 'a': 0, 'b': 0}}"
        return f"list_reduce([{start}, {keys}]::STRUCT(l BIGINT, r BIGINT, a BIGINT, b BIGINT)[], lambda s, k: {{'l': s.r, 'r': (s.l + {mixed}) % side, 'a': 0, 'b': 0}})"

    return f"""
WITH RECURSIVE numbered AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size, coalesce(text, '') AS text,
    row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS x, count(*) OVER () AS n, ceil(sqrt(count(*) OVER ()))::BIGINT AS side FROM documents),
first AS (SELECT x, n, side, {network('x')} AS p FROM numbered),
walk AS (
  SELECT x, n, side, p.l * side + p.r AS y FROM first
  UNION ALL SELECT x, n, side, p.l * side + p.r FROM (SELECT x, n, side, {network('y')} AS p FROM walk WHERE y >= n)),
digits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
sums AS (
  SELECT x, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS crc FROM numbered, digits)
SELECT d.doc_id, d.size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (y % {shards})::INTEGER AS shard, y // {shards} AS slot, NULL::INTEGER AS grown_shard
FROM numbered d JOIN walk w ON w.x = d.x AND w.y < w.n JOIN sums s ON s.x = d.x"""


ORACLE_SQL["op9_sharding"] = sharding_sql(SHARDS, SEED)


def conversation_repair_sql() -> str:
    """The damage by CRC-32's table; edits by a fold that holds the cheapest, least audit of each of the
    grammar's states. An insertion costs more than deleting the turn that it would pair with, so no
    cheapest repair has one, and audits have a letter a row."""
    spaces = r"\x20\x09-\x0D"
    add = lambda s, letter, cost: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}'}}"
    never = "{'c': 1000000000, 'a': ''}"
    least = lambda *xs: "list_sort([" + ", ".join(xs) + "])[1]"

    def may(test: str, x: str) -> str:
        return f"CASE WHEN x.f < 2 AND {test} THEN {x} ELSE {never} END"

    to_user = [may("x.i = 'u'", add(f"s.{k}", "K", "5 * x.f")) for k in ("p0", "p1", "p3")] + [may("true", add(f"s.{k}", "R", "5 * x.f + 1")) for k in ("p0", "p1", "p3")]
    step = f"""{{'i': '', 'f': 0, 'p0': {add('s.p0', 'D', 2)}, 'p1': {least(add('s.p1', 'D', 2), may("x.i = 's'", add('s.p0', 'K', '5 * x.f')))},
      'p2': {least(add('s.p2', 'D', 2), *to_user)},
      'p3': {least(add('s.p3', 'D', 2), may("x.i = 'a'", add('s.p2', 'K', '5 * x.f')), may('true', add('s.p2', 'R', '5 * x.f + 1')))}}}"""
    return f"""
WITH digits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
summed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda h: ascii(h)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS m FROM keyed, digits),
hurt AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS again
  FROM summed WHERE m != 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen, role[1:1] AS i FROM hurt),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{spaces}]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][{spaces}]*\\z') THEN 'truncated' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS previous FROM ordered),
rows_of AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (previous || i NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'i': i, 'f': CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 2 END, 'p0': {never}, 'p1': {never}, 'p2': {never}, 'p3': {never}}} ORDER BY pos) AS symbols
  FROM judged GROUP BY conv_id),
folded AS (
  SELECT *, list_reduce(list_prepend({{'i': '', 'f': 0, 'p0': {{'c': 0, 'a': ''}}, 'p1': {never}, 'p2': {never}, 'p3': {never}}}, symbols), lambda s, x: {step}) AS r FROM rows_of),
chosen AS (SELECT *, {least('r.p0', 'r.p3')} AS best FROM folded),
edits AS (SELECT j.*, best.a[j.pos] AS letter FROM judged j JOIN chosen c ON j.conv_id IS NOT DISTINCT FROM c.conv_id),
kept AS (SELECT *, count(*) FILTER (NOT (letter = 'K' AND i = 's')) OVER (PARTITION BY conv_id ORDER BY pos) AS place FROM edits WHERE letter != 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS lines FROM kept GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN chosen c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id"""


ORACLE_SQL["op11_conversation_repair"] = conversation_repair_sql()
