"""DuckDB formulations of the contract queries that SQL can express."""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS m, w, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS k FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, m, array_to_string(w[k + 1 : k + m], ' ') AS p FROM bw),
win AS (SELECT doc_id, m, w, unnest(range(0, len(w) - m + 1)) AS k FROM d, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m),
hits AS (SELECT doc_id, k, win.m AS m, item_id FROM win JOIN pat ON win.m = pat.m AND array_to_string(w[k + 1 : k + win.m], ' ') = p),
hw AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + least(5, len(w))], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(5, len(w)) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.id = doc_id
"""

_KEY = "translate(trim(line, e' \\t\\n\\x0B\\x0C\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
k AS (SELECT *, {_KEY} AS k FROM x),
f AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
m AS (SELECT r, pos, line, f.k IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last AS gone FROM k LEFT JOIN f ON k.k = f.k),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS t FROM m GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM d JOIN g USING (r)
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SQUARED = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
#: floor(s / n) of whole numbers, for either sign
_MEAN = "((s - ((s % n) + n) % n) // n)::BIGINT"


def _centroids(rounds: int = 3) -> str:
    """Lloyd rounds over all pairs of vector and centroid, one after another."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_FINITE} AND len(embedding) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT 16))",
    ]
    for k in range(rounds + 1):
        steps.append(f"p{k} AS MATERIALIZED (SELECT vec_id, v, j, {_SQUARED.format(a='v', b='c')} AS d FROM v, c{k})")
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, v, j, d FROM p{k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(64)) AS i FROM a{k}) GROUP BY j, i)")
            steps.append(f"m{k} AS (SELECT j, list({_MEAN} ORDER BY i) AS c FROM s{k} GROUP BY j)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT j, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (j))")
    last = (
        "SELECT vec_id, j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"
    )
    return "WITH " + ",\n".join(steps) + "\n" + last


def _codebooks(rounds: int = 2) -> str:
    """Lloyd rounds of every part position over all pairs of part and entry, one after another."""
    steps = [
        f"e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_FINITE})",
        "v AS MATERIALIZED (SELECT vec_id, p, v[p * w + 1 : p * w + w] AS x FROM (SELECT vec_id, v, len(v) // 16 AS w, unnest(range(16)) AS p FROM e))",
        "f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM e ORDER BY vec_id LIMIT 64)",
        "c0 AS MATERIALIZED (SELECT p, j, x AS c FROM v JOIN f USING (vec_id))",
    ]
    for k in range(rounds + 1):
        steps.append(f"p{k} AS MATERIALIZED (SELECT vec_id, p, x, j, {_SQUARED.format(a='x', b='c')} AS d FROM v JOIN c{k} USING (p))")
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, x, j, d FROM p{k} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, j) = 1)")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT p, j, i, sum(y) AS s, count(*) AS n FROM (SELECT p, j, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{k}) GROUP BY p, j, i)")
            steps.append(f"m{k} AS (SELECT p, j, list({_MEAN} ORDER BY i) AS c FROM s{k} GROUP BY p, j)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, j, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, j))")
    last = (
        f"g AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),\n"
        f"b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS h FROM c{rounds})\n"
        "SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, b.h AS codebooks_sha256 FROM g JOIN e USING (vec_id), b"
    )
    return "WITH " + ",\n".join(steps) + ",\n" + last


CENTROIDS, CODEBOOKS = _centroids(), _codebooks()
