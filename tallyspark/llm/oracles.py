"""DuckDB SQL of operators 2, 8 and 10, by plain set operations over whole tables (made for the smaller test sizes)."""

WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS l FROM documents),
w AS (SELECT doc_id, p, l[p : p + 34] AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 33)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + i AS p FROM r, range(35) t(i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, (len(l) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_GROUP = "('0x' || substr(h, {at}, 5))::BIGINT"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_LETTERS}', (({_GROUP.format(at=5 * g + 1)} >> {s}) & 31)::INT + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS top FROM p)
SELECT page_id, strlen(x)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to, true AS digest_ok FROM t
"""

NEAR = f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) ELSE w END AS g FROM l),
c AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT rep, n, unnest(g) AS k FROM c),
e AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.k = b.k AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a),
low AS (SELECT a AS rep, least(a, min(b)) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(m, c.rep, doc_id) AS component_id, doc_id = coalesce(m, c.rep, doc_id) AS kept
FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN low ON low.rep = c.rep
"""
