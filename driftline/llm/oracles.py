"""DuckDB SQL that says what the numbered queries must return, where SQL can say it."""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * common >= 80 * (na.n + nb.n - common)
), c(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.reach
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c.reach) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id) GROUP BY d.doc_id
"""

SUBSTRING = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM d
), m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
r AS (SELECT DISTINCT g.doc_id, unnest(range(i, i + 50)) AS i FROM g JOIN m USING (h) WHERE m.least < g.doc_id),
x AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
c(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.vec_id, l.b FROM c JOIN l ON l.a = c.reach),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id, min(reach) AS component_id FROM c GROUP BY vec_id)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN r USING (vec_id) LEFT JOIN n USING (vec_id)
"""

#: CRC-32 of each distinct word from its bytes, with a table made from the polynomial.
RESAMPLE = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), f AS (SELECT doc_id, unnest(w) AS w FROM d),
k AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(w)), 2), lambda i: CAST('0x' || substr(hex(w), CAST(i AS INTEGER) + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM f UNION SELECT w FROM q), tab
), s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM q JOIN k USING (w) GROUP BY bucket),
a AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM f) AS all_s, (SELECT CAST(count(*) AS DOUBLE) FROM q) AS all_t),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), a),
m AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
o AS (
  SELECT d.doc_id, len(w) AS words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN m USING (doc_id)
), r AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n <= (SELECT 10 * count(*) // 100 FROM o WHERE words >= 20) THEN n END AS rank FROM r
"""


def clusters(rounds: int = 10, k: int = 8, dims: int = 64) -> str:
    """Rounds of centroids one after another; components stand in columns of (number, dimension)."""
    nearest = "SELECT vec_id, e, CAST(n AS INTEGER) AS n, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, n) AS o FROM (SELECT v.vec_id, v.e, c.n, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS dist FROM v, {c} c)) WHERE o = 1"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(c=f'c{r}')})")
        steps.append(f"m{r} AS (SELECT n, d, CAST(sum(e[d]) AS BIGINT) AS s, count(*) AS many FROM a{r}, (SELECT CAST(unnest(range(1, {dims + 1})) AS INTEGER) AS d) GROUP BY n, d)")
        steps.append(f"f{r} AS (SELECT n, list((s - ((s % many) + many) % many) // many ORDER BY d) AS e FROM m{r} GROUP BY n)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT n, coalesce(f{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN f{r} USING (n))")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS n, e FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k})),
{", ".join(steps)},
last AS ({nearest.format(c=f"c{rounds}")})
SELECT vec_id, l.n AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY l.n) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM last l JOIN c{rounds} c ON c.n = l.n
"""
