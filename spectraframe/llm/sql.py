"""DuckDB SQL for the opN_ queries that SQL can express."""

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.other)
SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP6 = f"""
WITH n AS (SELECT doc_id, {_LOWER.format(x="coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

OP8 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
n AS (SELECT *, {_LOWER.format(x="trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM n WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT n.*, f.last IS NOT NULL AND n.doc_id <> f.last AS gone FROM n LEFT JOIN f ON n.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

CHAT = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, CASE WHEN k = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(k)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256 FROM g
"""

QUALITY = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
g AS (SELECT doc_id, k, list_aggregate(w[k : k + 4], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 5)),
d AS (SELECT doc_id, k FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM d, range(5) r(j) GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
       len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w.w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w.w) AS base_failed
FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
"""

CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))))"

LM = f"""
WITH t AS (SELECT doc_id, {CRC} % 7 = 2 AS held_out, unnest(list_append({WORDS.replace("coalesce(text, '')", _LOWER.format(x="coalesce(text, '')"))}, chr(10))) AS t FROM documents),
c AS (SELECT t, count(*) AS c FROM t WHERE NOT held_out GROUP BY t), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n.n + n.v + 1))), 3) AS base_score
FROM t LEFT JOIN c USING (t), n GROUP BY doc_id, held_out
"""

MIX = f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size) AS size, list_extract([3, 1, 2], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS w FROM d GROUP BY source),
r AS (SELECT *, 2 * size / w AS cap, coalesce(sum(2 * size) OVER b, 0) AS full_, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open_, 1.5 * sum(size) OVER () AS total FROM s WINDOW b AS (ORDER BY 2 * size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - full_) / open_, cap) FILTER (WHERE cap >= (total - full_) / open_) AS level FROM r)
SELECT doc_id, d.size, CAST(r.size AS BIGINT) AS source_size, round(least(2.0 * r.size, level * w), 3) AS target FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source, l
"""

URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_LOWER.format(x="regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(rh, rp, verdict)),
f AS (SELECT page_id, rh || rp AS rule, verdict FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) = 1)
SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN f USING (page_id)
"""

PII = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
c AS (SELECT doc_id, regexp_extract_all(x, '[0-9](?:[\\x20-]?[0-9])+') AS c, regexp_extract_all(x, '[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)') AS i, regexp_extract_all(x, '\\+[0-9][\\x20().0-9-]+[0-9]') AS p, regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+') AS e FROM t),
d AS (SELECT *, list_transform(c, lambda y: list_transform(string_split(reverse(regexp_replace(y, '[^0-9]', '', 'g')), ''), lambda z: CAST(z AS INT))) AS cd FROM c)
SELECT doc_id, len(e) AS n_email, len(list_filter(i, lambda y: list_max(list_transform(string_split(y, '.'), lambda z: CAST(z AS HUGEINT))) <= 255)) AS n_ip,
  len(list_filter(cd, lambda y: len(y) BETWEEN 13 AND 19 AND list_sum(list_transform(y, lambda z, k: CASE WHEN k % 2 = 1 THEN z WHEN z > 4 THEN 2 * z - 9 ELSE 2 * z END)) % 10 = 0)) AS n_card,
  len(list_filter(p, lambda y: length(regexp_replace(y, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone
FROM d
"""


CRC_TURN = CRC.replace("CAST(doc_id AS VARCHAR)", "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")

REPAIR = f"""
WITH RECURSIVE w AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC_TURN} % 20 AS way FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN way = 3 THEN 2 ELSE 1 END)) AS copy FROM w WHERE way > 0),
n AS (SELECT *, substr(role, 1, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '' ELSE 'truncated' END AS fault,
       coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i NOT IN ('su', 'ua', 'au'), false) AS illegal FROM n),
m AS (SELECT * FROM (VALUES (0, 0, 'D', 4, NULL, NULL, NULL), (1, 1, 'D', 4, NULL, NULL, NULL), (2, 2, 'D', 4, NULL, NULL, NULL), (3, 3, 'D', 4, NULL, NULL, NULL), (0, 1, 'K', 0, 's', NULL, NULL),
  (0, 2, 'K', 0, 'u', NULL, NULL), (1, 2, 'K', 0, 'u', NULL, NULL), (3, 2, 'K', 0, 'u', NULL, NULL), (2, 2, 'IK', 3, 'u', 'assistant:', NULL), (2, 3, 'K', 0, 'a', NULL, NULL), (0, 3, 'IK', 3, 'a', 'user:', NULL), (1, 3, 'IK', 3, 'a', 'user:', NULL), (3, 3, 'IK', 3, 'a', 'user:', NULL),
  (0, 2, 'R', 3, NULL, NULL, 'user'), (1, 2, 'R', 3, NULL, NULL, 'user'), (3, 2, 'R', 3, NULL, NULL, 'user'), (2, 3, 'R', 3, NULL, NULL, 'assistant'), (0, 3, 'IR', 6, NULL, 'user:', 'assistant'), (1, 3, 'IR', 6, NULL, 'user:', 'assistant'), (3, 3, 'IR', 6, NULL, 'user:', 'assistant'), (2, 2, 'IR', 6, NULL, 'assistant:', 'user')) t(s, e, code, cost, i, added, named)),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS s, {{'c': 0, 'a': '', 'o': []::VARCHAR[]}} AS b FROM f
  UNION ALL
  SELECT f.conv_id, f.k, m.e, min({{'c': r.b.c + m.cost + CASE WHEN f.fault = 'truncated' AND m.code <> 'D' THEN 3 ELSE 0 END, 'a': r.b.a || m.code,
    'o': r.b.o || CASE WHEN m.added IS NULL THEN [] ELSE [m.added] END || CASE WHEN m.code = 'D' THEN [] ELSE [coalesce(m.named, f.role) || ':' || f.text] END}})
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.k = r.k + 1 JOIN m ON m.s = r.s AND coalesce(m.i, f.i) = f.i AND (m.code = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY f.conv_id, f.k, m.e),
e AS (SELECT conv_id, min({{'c': b.c + CASE s WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'a': b.a || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 'o': b.o || CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END}}) AS b
  FROM r JOIN (SELECT conv_id AS id, max(k) AS last FROM f GROUP BY conv_id) l ON l.id IS NOT DISTINCT FROM r.conv_id AND l.last = r.k GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.b.c, 0) AS BIGINT) AS cost, coalesce(e.b.a, '') AS audit, sha256(coalesce(array_to_string(e.b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, p.y FROM r JOIN p ON p.x = r.other),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, coalesce(max(n), 0) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept FROM r LEFT JOIN n ON n.x = r.vec_id GROUP BY vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": OP5, "op6_exact_dedup": OP6, "op8_line_dedup": OP8, "op12_conversation_repair": REPAIR, "op13_embedding_dedup": NEAR_VECTORS, "chat_digests": CHAT, "quality_base": QUALITY, "lm_base": LM, "mix_targets": MIX, "url_rules": URLS, "pii_counts": PII}
