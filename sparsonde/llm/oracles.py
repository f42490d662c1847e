"""SQL (DuckDB) for the queries of this subpackage that SQL can express."""

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, i + k AS p FROM win JOIN again USING (g), range(35) r(k)),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""

OP6 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(x, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT x, min(c) AS c FROM reach GROUP BY x) m ON m.x = d.doc_id"""

OP8 = r"""WITH line AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
full_line AS (SELECT * FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
first AS (SELECT x, min((doc_id, pos)) AS f, length(x) AS n FROM full_line GROUP BY x),
part AS (SELECT x, f, n, unnest([left(x, (n - 1) // 2), left(x, greatest(n - 2, 0) // 2), '>' || right(x, (n - 1) // 2), '>' || right(x, greatest(n - 2, 0) // 2)]) AS k FROM first),
near AS (SELECT DISTINCT a.x FROM part a JOIN part b ON a.k = b.k AND b.f < a.f AND abs(a.n - b.n) <= 1 AND len(list_filter(range(greatest(a.n, b.n)), lambda p: left(a.x, p) = left(b.x, p) AND substr(a.x, p + 1 + (a.n >= b.n)::INT) = substr(b.x, p + 1 + (b.n >= a.n)::INT))) > 0),
gone AS (SELECT doc_id, pos FROM full_line l JOIN first USING (x) WHERE (doc_id, pos) <> f OR x IN (SELECT x FROM near)),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY pos) AS t FROM line ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, (SELECT count(*) FROM full_line f WHERE f.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)"""

_SOUND = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_ROUND = """, a{n} AS (SELECT vec_id, q, c, d FROM (SELECT v.vec_id, v.q, m.c, list_distance(v.q, m.q)::DOUBLE AS e, round(e * e)::BIGINT AS d, row_number() OVER (PARTITION BY v.vec_id ORDER BY d, m.c) AS k FROM v, c{n} m) WHERE k = 1)"""
_MOVED = """, s{n} AS (SELECT c, i, floor(sum(q[i]::HUGEINT)::DOUBLE / count(*)) AS x FROM a{n}, range(1, 65) r(i) GROUP BY c, i),
c{m} AS (SELECT o.c, coalesce(n.q, o.q) AS q FROM c{n} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS q FROM s{n} GROUP BY c) n USING (c))"""
OP11 = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings WHERE len(embedding) = 64 AND {_SOUND}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q FROM v QUALIFY c < 16){"".join(_ROUND.format(n=n) + _MOVED.format(n=n, m=n + 1) for n in range(3))}{_ROUND.format(n=3)}
SELECT vec_id, a3.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a3.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(c3.q, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a3 JOIN c3 ON a3.c = c3.c"""

OP12 = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings WHERE {_SOUND}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP13 = f"""WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor((c >> 1), (c & 1) * 3988292384), i)) AS tab),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS w FROM documents),
f AS (SELECT rid, x, count(*) AS k FROM (SELECT rid, unnest(w) AS x FROM d) GROUP BY ALL),
g AS (SELECT x, count(*) AS k FROM (SELECT unnest(regexp_extract_all({_LOWER}, {_LETTERS})) AS x FROM benchmark) GROUP BY ALL),
e AS (SELECT x, coalesce(a.s, 0)::DOUBLE AS s, coalesce(g.k, 0)::DOUBLE AS t, hex(encode(x)) AS h FROM (SELECT x, sum(k) AS s FROM f GROUP BY x) a FULL JOIN g USING (x)),
b AS (SELECT x, s, t, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, y: xor(crc.tab[(xor(c, y) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS b FROM e, crc),
gain AS (SELECT b, floor(1000 * ln((sum(t) + 1) * ((SELECT sum(s) FROM e) + 10000) / ((sum(s) + 1) * ((SELECT sum(t) FROM e) + 10000)))) AS gain FROM b GROUP BY b),
weight AS (SELECT rid, floor(sum(k * gain) / sum(k))::BIGINT AS weight FROM f JOIN b USING (x) JOIN gain USING (b) GROUP BY rid),
r AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score FROM d LEFT JOIN weight USING (rid)),
o AS (SELECT *, n_words >= 20 AS may, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_words >= 20) OVER () AS n FROM r)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN may AND k <= 10 * n // 100 THEN k END::BIGINT AS rank FROM o"""
