"""DuckDB SQL for the operators that SQL can express over whole tables of moderate size."""

from __future__ import annotations

SPACE = r"'[\t-\r ]+'"
WORDS = f"list_filter(regexp_split_to_array(coalesce({{}}, ''), {SPACE}), lambda w: w <> '')"

LINE_DEDUP = f"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM docs),
worded AS (SELECT doc_id, line_no, {WORDS.format('line')} AS w FROM lines),
sets AS (
  SELECT doc_id, line_no, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS tokens
  FROM worded WHERE len(w) > 0),
tokens AS (SELECT doc_id, line_no, len(tokens) AS n, unnest(tokens) AS token FROM sets),
gone AS (
  SELECT DISTINCT doc_id, line_no FROM (
    SELECT b.doc_id, b.line_no, a.doc_id AS other, a.line_no AS other_line, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS shared
    FROM tokens a JOIN tokens b ON a.token = b.token AND (a.doc_id, a.line_no) < (b.doc_id, b.line_no)
    GROUP BY ALL HAVING 9 * count(*) >= 4 * (any_value(a.n) + any_value(b.n)))),
numbers AS (SELECT doc_id, list(line_no) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(parts), 0)::INTEGER AS n_lines, coalesce(len(gone), 0)::INTEGER AS n_removed,
  CASE WHEN text IS NOT NULL THEN sha256(array_to_string(
    [p FOR p, i IN parts IF NOT list_contains(coalesce(gone, []), i)], chr(10))) END AS kept_sha256
FROM docs d LEFT JOIN numbers n ON n.doc_id = d.doc_id"""

DEBRUIJN_DEDUP = f"""
WITH docs AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)),
firsts AS (SELECT s, min(doc_id) AS source FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, i + k AS place FROM windows JOIN firsts USING (s), range(0, 50) AS steps(k) WHERE source < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM docs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


SUFFIX_DEDUP = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, substring(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM docs)),
firsts AS (SELECT s, min(doc_id) AS source FROM windows GROUP BY s),
starts AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE source < doc_id),
marked AS (
  SELECT doc_id, i, i > coalesce(max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh
  FROM starts),
numbered AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS z FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, span, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM spans),
pieces AS (
  SELECT doc_id, min(a) AS first, sum(z - a) AS removed, count(*) AS n,
    string_agg(substring(h, 2 * z - 1, 2 * (coalesce(next, length(h) // 2 + 1) - z)), '' ORDER BY a) AS rest
  FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN first IS NULL THEN h ELSE substring(h, 1, 2 * first - 2) || rest END)) AS kept_sha256
FROM docs d LEFT JOIN pieces p ON p.doc_id = d.doc_id"""


def _clustering(rounds: int = 5, clusters: int = 40) -> str:
    """K-means over whole vectors: one pair of steps for each round."""
    gap = "list_sum(list_transform(range(1, 65), lambda d: (p.v[d] - c.v[d]) * (p.v[d] - c.v[d])))::BIGINT"

    def nearest(n: int) -> str:
        pairs = f"SELECT p.row, any_value(p.vec_id) AS vec_id, any_value(p.v) AS v, min(({gap}, c.cluster)) AS best FROM kept p CROSS JOIN c{n} c GROUP BY p.row"
        return f"a{n} AS MATERIALIZED (SELECT row, vec_id, v, best[1] AS distance, best[2] AS cluster FROM ({pairs}))"

    def moved(n: int) -> str:
        sums = f"SELECT cluster, d, sum(v[d]) AS s, count(*) AS n FROM a{n - 1}, range(1, 65) AS dims(d) GROUP BY ALL"
        exact = "CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END"
        means = f"SELECT cluster, list(({exact})::BIGINT ORDER BY d) AS v FROM ({sums}) GROUP BY cluster"
        return f"c{n} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{n - 1} c LEFT JOIN ({means}) m USING (cluster))"

    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", f"""
c0 AS MATERIALIZED (
  SELECT place - 1 AS cluster, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) AS place FROM kept) WHERE place <= {clusters})"""]
    for n in range(1, rounds + 1):
        steps += [nearest(n - 1), moved(n)]
    steps.append(nearest(rounds))
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)"""


RESAMPLING = r"""
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
worded AS (
  SELECT 'd' || row_number() OVER () AS row, doc_id, text FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT 'b' || row_number() OVER (), NULL, text FROM benchmark),
split AS (
  SELECT row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM worded),
runs AS (
  SELECT row, array_to_string(w[i:i + n - 1], ' ') AS run, count(*) AS times
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, range(1, 4) AS sizes(n)) GROUP BY ALL),
hashed AS (
  SELECT run, xor(4294967295, list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1:2 * i])::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT run, hex(encode(run)) AS h FROM (SELECT DISTINCT run FROM runs)), steps),
found AS (SELECT row, bucket, sum(times) AS times FROM runs JOIN hashed USING (run) GROUP BY ALL),
counts AS (
  SELECT bucket, coalesce(sum(times) FILTER (row LIKE 'd%'), 0) AS s, coalesce(sum(times) FILTER (row LIKE 'b%'), 0) AS t FROM found GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT row, sum(times)::BIGINT AS n_features, sum(times * gain)::BIGINT AS weight FROM found JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, len(w) >= 20 AS enough, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM split LEFT JOIN weights USING (row) WHERE doc_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (ORDER BY enough DESC, score DESC, doc_id) AS place, 5 * (count(*) FILTER (enough) OVER ()) // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM placed"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_suffix_dedup": SUFFIX_DEDUP, "op9_line_dedup": LINE_DEDUP, "op10_debruijn_dedup": DEBRUIJN_DEDUP,
        "op12_centroid_clustering": _clustering(), "op13_resampling": RESAMPLING,
    }
