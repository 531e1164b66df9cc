"""DuckDB SQL for the queries of this subpackage that SQL can express, written from their contracts."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHARDING = """
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS b, row_number() OVER () AS k,
    ('0x' || substr(md5(coalesce('=' || doc_id, '-') || '|=' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), small AS (SELECT * FROM r WHERE b <= 1048576),
fits AS (
  SELECT level, h >> (60 - level) AS up, sum(b) AS bytes
  FROM small, (SELECT unnest(range(0, 61))::INT AS level) GROUP BY ALL HAVING sum(b) <= 1048576
), leaf AS (
  SELECT k, min(f.level) AS depth FROM small s JOIN fits f ON f.up = s.h >> (60 - f.level) GROUP BY k
), paged AS (
  SELECT k, (row_number() OVER (PARTITION BY h ORDER BY k) - 1) // greatest(1, 1048576 // greatest(b, 1)) AS page
  FROM r WHERE k NOT IN (SELECT k FROM leaf)
), named AS (
  SELECT r.*, coalesce(l.depth, 60) AS d,
    CASE WHEN coalesce(l.depth, 60) = 0 THEN '' ELSE lpad(bin(h >> (60 - coalesce(l.depth, 60))), coalesce(l.depth, 60), '0') END
      || coalesce('+' || p.page, '') AS shard
  FROM r LEFT JOIN leaf l USING (k) LEFT JOIN paged p USING (k)
)
SELECT doc_id, shard, d::INT AS depth, (sum(b) OVER (PARTITION BY shard))::BIGINT AS shard_bytes FROM named
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS keeper FROM p
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper IS NULL OR page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM k
"""

DECONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, list_slice(w, s, s + n - 1) AS win FROM sized, unnest(range(1, len(w) - n + 2)) AS t(s)
), spots AS (
  SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS win
  FROM d, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(s)
), found AS (
  SELECT doc_id, s, spots.n, item_id FROM spots JOIN windows ON spots.n = windows.n AND spots.win = windows.win
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE list_slice(w, i, i + 2) END AS g
  FROM d, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS t(i)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), m AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

MIX = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS shuffled
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((r - 1) % 3 + 1)::INT]::HUGEINT AS weight FROM s
), rounds AS (
  SELECT sum(source_size)::HUGEINT AS rest, sum(weight)::HUGEINT AS open FROM w
  UNION
  SELECT any_value(b.rest) - coalesce(sum(3 * source_size) FILTER (3 * source_size * o.open <= weight * o.rest), 0)::HUGEINT,
    any_value(b.open) - coalesce(sum(weight) FILTER (3 * source_size * o.open <= weight * o.rest), 0)::HUGEINT
  FROM rounds o, w, (SELECT sum(source_size)::HUGEINT AS rest, sum(weight)::HUGEINT AS open FROM w) b GROUP BY o.rest, o.open
), settled AS (SELECT rest, open FROM rounds ORDER BY open LIMIT 1),
t AS (
  SELECT source, source_size, weight, r, 3 * source_size * open <= weight * rest AS capped,
    CASE WHEN 3 * source_size * open <= weight * rest THEN (3 * source_size)::DOUBLE ELSE (weight * rest)::DOUBLE / open::DOUBLE END AS target,
    CASE WHEN 3 * source_size * open <= weight * rest THEN 3 * source_size ELSE (weight * rest + open - 1) // open END AS most
  FROM w, settled
), q AS (
  SELECT k, doc_id, size, shuffled, t.*, sum(size) OVER (PARTITION BY d.source ORDER BY shuffled, doc_id, k) - size AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, greatest(0, least(size, most - ahead - copy * source_size)) AS words,
    (ahead + copy * source_size + size) * 10 // weight AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS copy)
), m AS (
  SELECT *, sum(words) OVER (ORDER BY finish, r, copy, shuffled, doc_id, k ROWS UNBOUNDED PRECEDING) - words AS place FROM c
), v AS (
  SELECT *, greatest(0, least(words, (SELECT sum(size) FROM d) - place)) AS got FROM m
)
SELECT any_value(doc_id) AS doc_id, any_value(size)::BIGINT AS size, any_value(source_size)::BIGINT AS source_size, any_value(target) AS target,
  sum(got)::BIGINT AS taken, (min(place) FILTER (got > 0))::BIGINT AS mix_at
FROM v GROUP BY k
"""

DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS kept FROM kept GROUP BY lang),
g AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) x
), p AS (
  SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 2)) // (total + 2 * v.kept) AS p
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), l AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)::HUGEINT) // ((SELECT sum(n) FROM c x WHERE x.lang = c.lang)::HUGEINT + 2 * any_value(kept)) AS q
  FROM c JOIN v USING (lang) GROUP BY lang, term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""

TRIE = """
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS seq FROM t GROUP BY c
), h AS (
  SELECT c, seq, c - c % 5 AS b,
    (xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda a, x:
      list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 9)::INT AS h
  FROM own
), r AS (
  SELECT h.c, coalesce(list_slice(base.seq, 1, h.h), []) || list_slice(h.seq, h.h + 1, len(h.seq)) AS seq FROM h LEFT JOIN own base ON base.c = h.b
), p AS (
  SELECT c, d, list_slice(seq, 1, d) AS path, d = len(seq) AS ends FROM r, unnest(range(0, len(seq) + 1)) AS u(d)
), n AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(sha256(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends)), sha256('')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE any_value(strlen(list_extract(path, d).text)) END AS saved
  FROM p GROUP BY path, d
), k AS (
  SELECT n.*, (SELECT count(*) FROM n m WHERE m.d = n.d + 1 AND list_slice(m.path, 1, n.d) = n.path) AS n_children FROM n
), a AS (
  SELECT list_slice(path, 1, e) AS top, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM k, unnest(range(0, d + 1)) AS u(e) GROUP BY top
)
SELECT k.conv_id, k.d::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children, a.n_leaves, a.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN a ON a.top = k.path LEFT JOIN k up ON k.d > 0 AND up.d = k.d - 1 AND up.path = list_slice(k.path, 1, k.d - 1)
"""

ORACLES: dict[str, str] = {
    "op2_sharding": SHARDING,
    "op5_warc": WARC,
    "op6_decontamination": DECONTAMINATION,
    "op8_exact_top_k": TOP_K,
    "op10_jaccard_join": JACCARD,
    "op11_source_mix": MIX,
    "op12_source_divergence": DIVERGENCE,
    "op13_conversation_trie": TRIE,
}
