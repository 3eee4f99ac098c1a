"""DuckDB SQL for the rows of those queries that SQL can express."""

OP4 = r"""
WITH lines AS (
  SELECT d.rowid AS r, u.i, u.line, trim(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT row_number() OVER () AS rowid, coalesce(text, '') AS text FROM documents) d,
       LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS i) u
), hot AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT l.*, h.k IS NOT NULL AS dropped FROM lines l LEFT JOIN hot h ON l.k = h.k),
per AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS kept
  FROM marked GROUP BY r
)
SELECT d.doc_id, p.n_lines, p.n_dropped, sha256(p.kept) AS kept_sha256
FROM per p JOIN (SELECT row_number() OVER () AS rowid, doc_id FROM documents) d ON d.rowid = p.r
"""

OP7 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT DISTINCT item_id, w, least(len(w), 13) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM items)
), places AS (
  SELECT d.r, l.k, p.s, array_to_string(d.w[p.s : p.s + l.k - 1], ' ') AS g
  FROM docs d, (SELECT DISTINCT k FROM items) l, LATERAL (SELECT unnest(range(1, len(d.w) - l.k + 2)) AS s) p
), hits AS (SELECT p.r, p.s, p.k, v.item_id FROM places p JOIN windows v ON p.k = v.k AND p.g = v.g),
covered AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + k)) AS pos FROM (SELECT DISTINCT r, s, k FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.names, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c ON c.r = d.r LEFT JOIN named n ON n.r = d.r
"""

OP2 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 100
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP1 = r"""
WITH hex AS (SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS digits FROM documents),
crc AS (  -- half bytes, the lower one of each byte first
  SELECT r, doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, 2 * (size - 8)), lambda i: strpos('0123456789ABCDEF', digits[(i // 2) * 2 + 2 - i % 2]) - 1)),
    lambda c, d: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][1 + (xor(c, d) & 15)])), 4294967295) AS text_crc32 FROM hex
), scored AS (
  SELECT c.doc_id, s, -1.0 / ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(c.doc_id AS VARCHAR), '\N') || '|' || s), 1, 15) AS BIGINT) >> 8 AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS score
  FROM (SELECT DISTINCT doc_id FROM crc) c, range(0, 25) t(s)
), best AS (
  SELECT a.doc_id, a.s AS shard, CASE WHEN b.score > a.score THEN 24 ELSE a.s END AS grown
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, s) AS k FROM scored WHERE s < 24) WHERE k = 1) a
  JOIN (SELECT * FROM scored WHERE s = 24) b ON a.doc_id IS NOT DISTINCT FROM b.doc_id
), placed AS (
  SELECT c.*, b.shard, b.grown, CAST('0x' || substr(md5(coalesce(CAST(c.doc_id AS VARCHAR), '\N') || '|' || size || '|' || text_crc32), 1, 15) AS BIGINT) AS h
  FROM crc c JOIN best b ON c.doc_id IS NOT DISTINCT FROM b.doc_id
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, size, text_crc32) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard,
       count(*) OVER (PARTITION BY doc_id, size, text_crc32) AS copies
FROM placed
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i : i + 2], ' ')))) AS g FROM d WHERE len(w) > 0),
class AS (SELECT min(doc_id) AS c, count(*) AS class_size, len(g) AS n, g FROM s GROUP BY g),
one AS (SELECT c, n, unnest(g) AS x FROM class),
pair AS (
  SELECT a.c AS a, b.c AS b FROM one a JOIN one b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  WITH RECURSIVE walk(c, to_) AS (
    SELECT c, c FROM class UNION SELECT w.c, e.v FROM walk w JOIN (SELECT a AS u, b AS v FROM pair UNION ALL SELECT b, a FROM pair) e ON e.u = w.to_
  ) SELECT c, min(to_) AS component_id FROM walk GROUP BY c
)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_shingles, coalesce(reach.component_id, d.doc_id) AS component_id, coalesce(k.class_size, 1) AS class_size
FROM d LEFT JOIN s ON s.r = d.r LEFT JOIN class k ON k.g = s.g LEFT JOIN reach ON reach.c = k.c
"""

OP6 = r"""
WITH d AS (SELECT doc_id, source, md5(text) AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source),
weighed AS (SELECT source, source_size, k % 3 AS kind, [3.0::DOUBLE, 1, 2][k % 3 + 1] AS w FROM src),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY 2 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY 2 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), level AS (SELECT greatest(max(level), 0) AS l FROM levels),
plan AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, kind, w, least(2.0 * source_size, l * w) AS target,
         CAST(least(round_even(least(2.0 * source_size, l * w), 0), 2 * source_size) AS BIGINT) AS demand FROM weighed, level
), ordered AS (
  SELECT d.*, p.source_size, p.kind, p.w, p.target, p.demand,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o
  FROM (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\N') || '|' || coalesce(key, '\N') || '|' || size), 1, 15) AS BIGINT) AS h FROM d) d
  JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), taken AS (
  SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS f FROM ordered
), counted AS (
  SELECT *, size * (f + CASE WHEN size > 0 AND 2 * (demand - f * source_size - o) >= size AND f * source_size + o + size <= 2 * source_size THEN 1 ELSE 0 END) AS taken FROM taken
), shares AS (SELECT *, CASE WHEN taken > 0 THEN CAST(o AS DOUBLE) / demand END AS q FROM counted),
placed AS (
  SELECT *, CASE kind WHEN 0 THEN 0.0 WHEN 1 THEN CASE WHEN q >= 0.375 THEN 0.375 ELSE 0.0 END ELSE 0.0 END AS f0,
            CASE WHEN kind = 1 AND q >= 0.375 THEN 0.5 ELSE 0.0 END AS t0, CASE kind WHEN 1 THEN 0.5 ELSE 1.0 END AS dt,
            CASE kind WHEN 0 THEN 4.5 WHEN 1 THEN CASE WHEN q >= 0.375 THEN 1.0 ELSE 0.5 END ELSE 2.0 END AS w0,
            CASE kind WHEN 0 THEN 1.5 WHEN 1 THEN CASE WHEN q >= 0.375 THEN 1.5 ELSE 1.0 END ELSE 2.0 END AS w1 FROM shares
), area AS (SELECT *, (q - f0) * w / dt AS a FROM placed)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, source,
       CASE WHEN taken > 0 THEN least(t0 + dt * (a * 2 / (w0 + sqrt(greatest(w0 * w0 + (w1 - w0) * a * 2, 0.0)))), 1.0) END AS position
FROM area
"""

NEAR = r"""
WITH q AS (SELECT item_id, list_sort(list_transform(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> ''), lambda w: lower(w))), lambda w: {'n': -length(w), 'w': w}))[1:3] AS ws FROM benchmark),
t AS (SELECT item_id, len(ws) AS k, unnest(list_transform(ws, lambda x: x.w)) AS term FROM q),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT r, doc_id, unnest(range(0, len(w))) AS pos, lower(unnest(w)) AS term FROM d),
h AS (SELECT r, doc_id, item_id, k, pos, term FROM p JOIN t USING (term)),
n AS (SELECT a.item_id, a.r, a.doc_id, a.k, a.pos, b.term, max(b.pos) AS last FROM h a JOIN h b ON a.r = b.r AND a.item_id = b.item_id AND b.pos BETWEEN a.pos - 19 AND a.pos GROUP BY ALL)
SELECT item_id, doc_id, CAST(min(last) AS INTEGER) AS first_pos, CAST(pos AS INTEGER) AS last_pos FROM n GROUP BY item_id, r, doc_id, k, pos HAVING count(*) = k
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) a JOIN v c ON c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

OP12 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(x, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase, any_value(w[s : s + k - 1]) AS w, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
  GROUP BY lang, k, array_to_string(w[s : s + k - 1], ' ') HAVING count(*) >= 100
), inside AS (
  SELECT lang, array_to_string(w[s : s + j - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, w, f, j, unnest(range(1, k - j + 2)) AS s FROM f, (SELECT unnest(range(2, 5)) AS j) WHERE j < k)
  GROUP BY lang, array_to_string(w[s : s + j - 1], ' ')
), kept AS (
  SELECT f.* FROM f LEFT JOIN inside i ON i.lang = f.lang AND i.phrase = f.phrase WHERE f.k > 1 AND (i.most IS NULL OR 100 * i.most < 100 * f.f)
), cut AS (
  SELECT lang, phrase, f AS a, c, array_to_string(w[1 : c], ' ') AS head, array_to_string(w[c + 1 : k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, c.c
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN total t ON t.lang = c.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best
QUALIFY rank <= 2000
"""

PHRASES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')) t(q, label)),
f AS (SELECT r, label, unnest(list_filter(range(0, len(w) - len(q) + 1), lambda i: w[i + 1 : i + len(q)] = q)) AS word FROM d, p),
g AS (SELECT r, count(*) AS n, min(word) AS lo, max(word) AS hi FROM f GROUP BY r), l AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT r, label FROM f) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (r) LEFT JOIN l USING (r)
"""

ORACLES = {"license_phrases": PHRASES, "op12_collocations": OP12, "op13_hard_negatives": OP13, "proximity_matches": NEAR, "op1_sharding": OP1, "op3_ngram_join": OP3, "op6_mixing": OP6, "op2_warc": OP2, "op5_top_inner_products": OP5, "op7_decontamination": OP7, "op4_line_dedup": OP4}
