"""DuckDB SQL of the queries that SQL can express (constants written out)."""

WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"

SQL: dict[str, str] = {}

SQL["op1_warc_zstd"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
     g AS (SELECT h, max(page_id) AS rep, count(*) AS k FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> rep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> rep THEN rep END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM d LEFT JOIN g USING (h)
"""

SQL["op4_chat_format"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
p AS (SELECT *, '<|im_start|>' || replace(replace(replace(role, '%', '%25'), '<|', '%3C|'), chr(10), '%0A') || chr(10)
         || replace(replace(text, '%', '%25'), '<|', '%3C|') || '<|im_end|>' || chr(10) AS piece FROM t),
r AS (SELECT *, sum(length(piece)) OVER w AS upto, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
      FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, piece ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

SQL["op10_mix_curriculum"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS r
      FROM d GROUP BY source),
w AS (SELECT *, CAST(r % 3 + 1 AS DOUBLE) AS w, total * 3.0::DOUBLE AS cap, (total * 3.0::DOUBLE) / CAST(r % 3 + 1 AS DOUBLE) AS lev,
      sum(total) OVER () AS everything FROM s),
x AS (SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY lev, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY lev, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
y AS (SELECT *, (SELECT min_by(share, (lev, r)) FROM x WHERE lev > share) AS level FROM x),
g AS (SELECT source, total, r, coalesce(least(cap, level * w), cap) AS target FROM y),
c AS (SELECT d.*, total, r, target, CASE WHEN total > 0 THEN target / total ELSE 0.0::DOUBLE END AS rate,
        sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS mid
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
n AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN size > 0 AND mid < (rate - floor(rate)) * total THEN 1 ELSE 0 END AS copies,
        least(mid / nullif(target, 0), 1.0::DOUBLE) AS u FROM c),
q AS (SELECT *, CASE r % 3
        WHEN 0 THEN least(u * 2.0 / (sqrt(greatest(2.25 + u * -2.0, 0)) + 1.5), 1.0)
        WHEN 1 THEN u
        ELSE CASE WHEN u <= 0.375 THEN least(u * 2.0 / (sqrt(0.25 + u * 2.0) + 0.5), 0.5)
             ELSE least(0.5 + (u - 0.375) * 2.0 / (sqrt(1.0 + (u - 0.375) * 2.0) + 1.0), 1.0) END END AS pos FROM n)
SELECT doc_id, size, total AS source_size, target, size * copies AS taken,
       CASE WHEN copies > 0 THEN round(CAST(pos AS DOUBLE), 6) END AS first_position FROM q
"""

#: A text's lines as word lists; a line is its words.
LINES = r"""
l AS (SELECT doc_id, i - 1 AS no, ls[i] AS line,
             list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
            FROM documents WHERE text IS NOT NULL))"""

SQL["op8_line_dedup"] = f"""
WITH {LINES},
k AS (SELECT *, array_to_string(w, ' ') AS s, row_number() OVER (ORDER BY doc_id, no) AS pos FROM l WHERE len(w) > 0),
u AS (SELECT s, min(pos) AS pos, any_value(w) AS w, len(any_value(w)) AS n FROM k GROUP BY s),
v AS (SELECT s, pos, n, i, array_to_string(list_concat(w[1:i-1], w[i+1:]), ' ') AS v
      FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM u WHERE n >= 8)),
near AS (SELECT a.s FROM v a JOIN (SELECT v, i, n, min(pos) AS pos FROM v GROUP BY ALL) b USING (v, i, n) WHERE b.pos < a.pos
         UNION SELECT a.s FROM v a JOIN u b ON a.v = b.s AND b.n >= 8 WHERE b.pos < a.pos
         UNION SELECT b.s FROM v a JOIN u b ON a.v = b.s AND b.n >= 8 WHERE a.pos < b.pos),
j AS (SELECT k.doc_id, k.no, k.pos <> u.pos OR near.s IS NOT NULL AS gone
      FROM k JOIN u USING (s) LEFT JOIN near USING (s)),
d AS (SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (NOT coalesce(gone, false)), '') AS text,
             count(j.no) AS n_lines, count(*) FILTER (gone) AS n_dropped
      FROM l LEFT JOIN j ON j.doc_id = l.doc_id AND j.no = l.no GROUP BY l.doc_id)
SELECT documents.doc_id, d.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM documents LEFT JOIN d USING (doc_id)
"""

#: Distinct five-word shingles ``(id, g)`` of a table.
def _shingles(name: str, table: str, key: str) -> str:
    return rf"""
{name}_w AS (SELECT {key} AS id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM {table}),
{name} AS (SELECT DISTINCT id, array_to_string(w[i:i+4], ' ') AS g
           FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM {name}_w WHERE len(w) >= 5))"""


SQL["op9_decontaminate"] = f"""
WITH {_shingles('a', 'documents', 'doc_id')}, {_shingles('b', 'benchmark', 'item_id')},
n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
s AS (SELECT a.id AS doc_id, b.id AS item_id, count(*) AS shared FROM a JOIN b USING (g) GROUP BY ALL)
SELECT doc_id, item_id, shared, n AS item_shingles FROM s JOIN n ON n.id = item_id WHERE shared >= 0.8 * n
UNION ALL
SELECT a_w.id, b_w.id, 1, 1 FROM b_w JOIN a_w ON len(b_w.w) BETWEEN 1 AND 4 AND list_contains(
  list_transform(range(1, len(a_w.w) - len(b_w.w) + 2), lambda i: array_to_string(a_w.w[i:i + len(b_w.w) - 1], ' ')), array_to_string(b_w.w, ' '))
"""

SQL["op5_jaccard_forest"] = f"""
WITH RECURSIVE {_shingles('a5', 'documents', 'doc_id')},
a AS (SELECT * FROM a5 UNION ALL
      SELECT id, 'short ' || array_to_string(w, ' ') FROM a5_w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT id, count(*) AS n, list_sort(list(g)) AS gs FROM a GROUP BY id),
p AS (SELECT x.id AS i, y.id AS j, count(*) AS s FROM a x JOIN a y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
k AS (SELECT i, j FROM p JOIN n x ON x.id = i JOIN n y ON y.id = j WHERE s >= 0.8 * (x.n + y.n - s) - 1e-9),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT k.j, r.root FROM r JOIN k ON k.i = r.id WHERE r.root < k.j),
c AS (SELECT gs, min(id) AS copy FROM n GROUP BY gs)
SELECT d.doc_id, (SELECT min(root) FROM r WHERE r.id = d.doc_id) AS class_id, coalesce(c.copy, d.doc_id) AS copy_id,
       (SELECT count(*) FROM k WHERE k.i = d.doc_id) AS n_links
FROM documents d LEFT JOIN n ON n.id = d.doc_id LEFT JOIN c ON c.gs = n.gs
"""

SQL["op11_merkle_manifest"] = """
WITH RECURSIVE f AS (
  SELECT *, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id END,
    CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END,
    CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END,
    CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars END) AS head,
    replace(text, chr(10), '') AS cut FROM documents),
b AS (SELECT DISTINCT doc_id, CAST(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS BIGINT) AS crc
  FROM documents WHERE doc_id IS NOT NULL),
a AS (SELECT f.doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
    CASE WHEN crc % 2 = 1 THEN sha256(head || CASE WHEN cut IS NULL THEN '-' ELSE octet_length(encode(cut)) || ':' || cut END) END AS bad
  FROM f LEFT JOIN b USING (doc_id)),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM a),
t(source, lvl, i, h) AS (SELECT source, 0, i, leaf FROM l UNION ALL
  SELECT source, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, max(i) OVER (PARTITION BY source) AS m FROM t)
  WHERE m > 0 GROUP BY source, lvl, i // 3),
s AS (SELECT source, max_by(h, lvl) AS subroot, max(lvl) AS depth, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS p
  FROM t WHERE i = 0 GROUP BY source),
u(lvl, i, h) AS (SELECT 0, p, subroot FROM s UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, max(i) OVER () AS m FROM u) WHERE m > 0 GROUP BY lvl, i // 3),
r AS (SELECT max_by(h, lvl) AS root, max(lvl) AS above FROM u WHERE i = 0),
w(source, i, lvl, pos, folded, sib) AS (SELECT source, i, 0, i, coalesce(bad, leaf), '' FROM l UNION ALL
  SELECT w.source, w.i, w.lvl + 1, w.pos // 3,
    sha256(coalesce(x0, folded) || CASE WHEN w.pos % 3 = 1 THEN folded ELSE coalesce(x1, '') END || CASE WHEN w.pos % 3 = 2 THEN folded ELSE coalesce(x2, '') END),
    sib || coalesce(x0, '') || CASE WHEN w.pos % 3 = 1 THEN '' ELSE coalesce(x1, '') END || CASE WHEN w.pos % 3 = 2 THEN '' ELSE coalesce(x2, '') END
  FROM w JOIN s ON s.source IS NOT DISTINCT FROM w.source JOIN (
    SELECT source, lvl, i // 3 AS run, max(h) FILTER (i % 3 = 0) AS h0, max(h) FILTER (i % 3 = 1) AS x1, max(h) FILTER (i % 3 = 2) AS x2 FROM t GROUP BY ALL) k
    ON k.source IS NOT DISTINCT FROM w.source AND k.lvl = w.lvl AND k.run = w.pos // 3,
    LATERAL (SELECT CASE WHEN w.pos % 3 = 0 THEN NULL ELSE h0 END AS x0) WHERE w.lvl < s.depth),
z(source, i, lvl, pos, folded, sib) AS (SELECT w.source, w.i, 0, s.p, folded, sib FROM w JOIN s ON s.source IS NOT DISTINCT FROM w.source AND w.lvl = s.depth
  UNION ALL
  SELECT z.source, z.i, z.lvl + 1, z.pos // 3,
    sha256(coalesce(x0, folded) || CASE WHEN z.pos % 3 = 1 THEN folded ELSE coalesce(x1, '') END || CASE WHEN z.pos % 3 = 2 THEN folded ELSE coalesce(x2, '') END),
    sib || coalesce(x0, '') || CASE WHEN z.pos % 3 = 1 THEN '' ELSE coalesce(x1, '') END || CASE WHEN z.pos % 3 = 2 THEN '' ELSE coalesce(x2, '') END
  FROM z JOIN (SELECT lvl, i // 3 AS run, max(h) FILTER (i % 3 = 0) AS h0, max(h) FILTER (i % 3 = 1) AS x1, max(h) FILTER (i % 3 = 2) AS x2 FROM u GROUP BY ALL) k
    ON k.lvl = z.lvl AND k.run = z.pos // 3,
    LATERAL (SELECT CASE WHEN z.pos % 3 = 0 THEN NULL ELSE h0 END AS x0), r WHERE z.lvl < r.above)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(z.sib) AS proof_sha256, z.folded AS folded_root, z.folded = r.root AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN r
JOIN z ON z.source IS NOT DISTINCT FROM l.source AND z.i = l.i AND z.lvl = r.above
"""

SQL["op12_bitsliced_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q,
                  row_number() OVER () AS r FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, a.r AS qr, b.vec_id, b.r,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
      FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0 AND b.vec_id IS NOT NULL),
k AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
"""

SQL["op13_filter_interaction"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
e AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
w AS (SELECT d.*, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
x AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
        len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
        100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > e.first, false)] AS fails
      FROM w JOIN e USING (t) LEFT JOIN g USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
r AS (SELECT part, p, n, good, toxic, fails, list_position(list_transform(p, lambda i: fails[i]), true) AS step FROM m, o),
s AS (SELECT part, p, k.i AS step, p[k.i] AS filter,
             CAST(sum(n) FILTER (step IS NULL OR step > k.i) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (step = k.i), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (step < k.i AND fails[p[k.i]]), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (fails[p[k.i]] AND len(list_filter(fails, lambda y: y)) = 1), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(good) FILTER (step = k.i), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(toxic) FILTER (step = k.i), 0) AS BIGINT) AS toxic_lost
      FROM r, f k GROUP BY part, p, k.i)
SELECT part, array_to_string(list_transform(p, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
       coalesce(kept, 0) AS kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM s
"""
