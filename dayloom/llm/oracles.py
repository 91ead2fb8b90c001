"""DuckDB SQL stating the results of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

# Words of both tables, hit positions by joining the text of every window of ten words.
ORACLES["op5_fm_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + 9], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, greatest(1, len(w) - size + 2))) AS i FROM d, sizes)),
found AS (SELECT doc_id, i, size, item_id FROM grams JOIN windows USING (size, words)),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, size)) AS k FROM found) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Shared shingles counted pair by pair, then the smallest doc_id over the links.
ORACLES["op10_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
part AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN part USING (doc_id) LEFT JOIN n USING (doc_id)
"""

# Every query against every other vector.
ORACLES["op2_pivot_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2])) AS score
  FROM v q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""

# crc32 of a text: the table by its rule, then one step a byte.
_CRC = """
t AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
"""
_OF = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
  range(1, octet_length(encode({text})) + 1), lambda k: CAST(('0x' || substr(hex(encode({text})), 2 * k - 1, 2)) AS BIGINT))),
  lambda c, b: xor(crc[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)))"""

# Near words share what is left when one letter goes: in the same place, or from the longer one.
ORACLES["op12_spelling_variants"] = (
    "WITH RECURSIVE" + _CRC + r"""
d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS said, run, count(*) AS n FROM d WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, """ + _OF.format(text="said") + r""" AS h FROM r, t),
o AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
  FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, w.word, w.n FROM cut a JOIN w ON a.rest = w.word
  UNION SELECT w.word, w.n, a.word, a.n FROM cut a JOIN w ON a.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, max(n) AS n FROM near GROUP BY 1),
form AS (
  SELECT near.word, min(other) AS form, near.m AS form_n FROM near JOIN best ON near.word = best.word AND near.m = best.m
  WHERE near.m >= 5 * near.n GROUP BY near.word, near.m),
chain AS (
  SELECT word, form AS root FROM form UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON chain.root = form.word),
last AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM form))
SELECT w.word, form.form, coalesce(last.root, w.word) AS root, w.n, coalesce(best.n_near, 0) AS n_near, form.form_n
FROM w LEFT JOIN best USING (word) LEFT JOIN form USING (word) LEFT JOIN last USING (word)
"""
)

# Stretches of equal words q apart, seen through four words at a time: each run shows at least three.
ORACLES["op13_periodic_runs"] = (
    "WITH" + _CRC + r"""
d AS (
  SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT d.*, CAST(len(w) AS BIGINT) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE """
    + _OF.format(text="CAST(doc_id AS VARCHAR)")
    + r""" END AS h FROM d, t),
a AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
words AS (
  SELECT id, doc_id, n, CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(n), lambda i: w[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT) + 1]) END AS w FROM p),
four AS (
  SELECT id, n, i, array_to_string(w[i + 1 : i + 4], ' ') AS f FROM (SELECT id, n, w, unnest(range(0, greatest(n - 3, 0))) AS i FROM words)),
pairs AS (
  SELECT x.id, y.i - x.i AS q, x.i AS i FROM four x JOIN four y
  ON x.id = y.id AND x.f = y.f AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT id, q, min(i) AS s, count(*) + 3 + q AS length
  FROM (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS k FROM pairs) GROUP BY id, q, k),
runs AS (
  SELECT id, s, length, min(q) AS q FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY id, s, length),
listed AS (
  SELECT id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS list,
    min({'a': -length, 'b': s, 'c': q}) AS top FROM runs GROUP BY 1),
dropped AS (SELECT DISTINCT id, unnest(range(s + q, s + length)) AS i FROM runs),
kept AS (
  SELECT id, string_agg(word, ' ' ORDER BY i) AS line
  FROM (SELECT id, unnest(w) AS word, unnest(range(n)) AS i FROM words) ANTI JOIN dropped USING (id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.b AS BIGINT) AS start, CAST(-top.a AS BIGINT) AS length, CAST(top.c AS BIGINT) AS period,
  CAST(1000 * -top.a // top.c AS BIGINT) AS exponent_milli, sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM words LEFT JOIN listed USING (id) LEFT JOIN kept USING (id)
"""
)
