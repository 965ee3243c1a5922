"""DuckDB texts of the operators that SQL can express over whole tables."""

WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS run FROM (SELECT *, UNNEST(range(1, len(ws) - 11)) AS i FROM d) x),
f AS (SELECT run, MIN(doc_id) AS first_id FROM g GROUP BY run),
c AS (SELECT DISTINCT rid, UNNEST(range(i, i + 13)) AS p FROM g JOIN f ON f.run = g.run WHERE f.first_id < g.doc_id),
n AS (SELECT rid, COUNT(*) AS n_removed FROM c GROUP BY rid),
w AS (SELECT rid, UNNEST(ws) AS word, generate_subscripts(ws, 1) AS p FROM d WHERE rid IN (SELECT rid FROM n)),
k AS (SELECT w.rid, string_agg(w.word, ' ' ORDER BY w.p) AS kept FROM w LEFT JOIN c ON c.rid = w.rid AND c.p = w.p WHERE c.rid IS NULL GROUP BY w.rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, COALESCE(n.n_removed, 0) AS n_removed,
  sha256(CASE WHEN n.rid IS NULL THEN array_to_string(d.ws, ' ') ELSE COALESCE(k.kept, '') END) AS kept_sha256
FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN k ON k.rid = d.rid"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, CAST([5, 2, 1][1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM d GROUP BY source),
r AS (SELECT *, 2.0 * source_size AS cap, CAST(1.5 AS DOUBLE) * SUM(source_size) OVER () AS whole, SUM(w) OVER () AS all_w,
  COALESCE(SUM(2.0 * source_size) OVER o, 0) AS caps_before, COALESCE(SUM(w) OVER o, 0) AS w_before
  FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, w * ((whole - caps_before) / (all_w - w_before)) > cap AS stopped FROM r),
u AS (SELECT MAX(whole) - COALESCE(SUM(cap) FILTER (WHERE stopped), 0) AS rest, SUM(w) FILTER (WHERE NOT stopped) AS open_w FROM b),
t AS (SELECT source, source_size, ROUND(CAST(CASE WHEN stopped THEN cap ELSE w * (u.rest / u.open_w) END AS DOUBLE), 6) AS target FROM b, u),
p AS (SELECT d.*, t.source_size, t.target, COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY md5(COALESCE(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST(LEAST(GREATEST(FLOOR(target) - start, 0), size) + LEAST(GREATEST(FLOOR(target) - source_size - start, 0), size) AS BIGINT) AS taken FROM p"""


def _round(x: str, books: str) -> str:
    """Nearest entry (rid, p, e, d) of every part ``x`` in ``books``."""
    return f"""SELECT rid, p, min_by(e, d * 64 + e) AS e, MIN(d) AS d FROM (
  SELECT x.rid, x.p, b.e, list_sum(list_transform(list_zip(x.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM {x} x JOIN {books} b ON b.p = x.p) y GROUP BY rid, p"""


def _means(nearest: str, books: str) -> str:
    """Entries of ``books`` after a round: floor of the mean of their parts, unused ones as they are."""
    return f"""SELECT b.p, b.e, COALESCE(m.part, b.part) AS part FROM {books} b LEFT JOIN (
  SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS part FROM (
    SELECT p, e, i, SUM(v) AS s, COUNT(*) AS c FROM (
      SELECT n.p, n.e, UNNEST(x.part) AS v, generate_subscripts(x.part, 1) AS i FROM {nearest} n JOIN x ON x.rid = n.rid AND x.p = n.p) u GROUP BY p, e, i) s GROUP BY p, e) m ON m.p = b.p AND m.e = b.e"""


VECTOR_CODES = f"""
WITH k AS (SELECT ROW_NUMBER() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
w AS (SELECT MAX(len(v)) // 16 AS w FROM k),
x AS MATERIALIZED (SELECT rid, vec_id, p, v[p * w + 1:p * w + w] AS part FROM k, w, (SELECT UNNEST(range(16)) AS p) r),
b0 AS MATERIALIZED (SELECT p, place AS e, part FROM x JOIN (SELECT rid, ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS place FROM k) o ON o.rid = x.rid WHERE place < 64),
n1 AS MATERIALIZED ({_round('x', 'b0')}),
b1 AS MATERIALIZED ({_means('n1', 'b0')}),
n2 AS MATERIALIZED ({_round('x', 'b1')}),
b2 AS MATERIALIZED ({_means('n2', 'b1')}),
n3 AS MATERIALIZED ({_round('x', 'b2')}),
h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS digest FROM b2),
c AS (SELECT k.vec_id, k.label, string_agg(format('{{:02x}}', n.e), '' ORDER BY n.p) AS code, CAST(SUM(n.d) AS BIGINT) AS error FROM n3 n JOIN k ON k.rid = n.rid GROUP BY k.rid, k.vec_id, k.label),
t AS (SELECT label, CAST(SUM(error) AS BIGINT) AS label_error FROM c GROUP BY label)
SELECT c.vec_id, c.code, c.error, t.label_error, h.digest AS codebooks_sha256 FROM c JOIN t ON t.label IS NOT DISTINCT FROM c.label, h"""

COLLOCATIONS = r"""
WITH w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
  SELECT COALESCE(lang, 'und') AS lang, UNNEST(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) d),
g AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, ws, size, UNNEST(range(1, CAST(len(ws) AS BIGINT) - size + 2)) AS i FROM w, (SELECT UNNEST(range(1, 5)) AS size) s) u),
f AS MATERIALIZED (SELECT lang, size, phrase, COUNT(*) AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, size, phrase HAVING COUNT(*) >= 30),
n AS (SELECT lang, CAST(SUM(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
u AS (SELECT lang, phrase, f AS a, cut, array_to_string(ws[1:cut], ' ') AS first, array_to_string(ws[cut + 1:], ' ') AS rest FROM (SELECT *, UNNEST(range(1, size)) AS cut FROM f WHERE size > 1) c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * u.a // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.first JOIN f r ON r.lang = u.lang AND r.phrase = u.rest),
b AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(ws[p:p + k - 1], ' ') AS phrase, MAX(f) AS longer FROM (
  SELECT lang, ws, f, k, UNNEST(range(1, size - k + 2)) AS p FROM (SELECT *, UNNEST(range(2, size)) AS k FROM f WHERE size > 2) y) z GROUP BY 1, 2),
c AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n, k.score FROM k JOIN n ON n.lang = k.lang WHERE k.rank <= 2000"""
