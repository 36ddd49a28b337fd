"""SQL for DuckDB of the operators that it can express; the others' tests use brute force."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT doc_id, i FROM win JOIN first USING (h) WHERE m < doc_id),
c AS (SELECT w.doc_id, w.i, w.word, coalesce(max(g.i) OVER (PARTITION BY w.doc_id ORDER BY w.i), -100) >= w.i - 49 AS covered FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i)
SELECT d.doc_id, cast(len(d.ws) AS BIGINT) AS n_words, count(*) FILTER (WHERE covered) AS n_removed, sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.i) FILTER (WHERE NOT covered), '')) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id, d.ws"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""

SUFFIXES = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
win AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS i FROM n WHERE n >= 400)),
many AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM many)),
run AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 400 THEN 0 ELSE 1 END AS new FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM run) GROUP BY doc_id, g),
gap AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, -1, 0 FROM n)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * gap.a + 1, 2 * (coalesce(gap.b, n) - gap.a)), '' ORDER BY gap.a) AS x FROM gap JOIN n USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_bytes, cast(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(from_hex(kept.x)) AS kept_sha256 FROM n JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

MIX = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, cast(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS content FROM documents),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER p, 0.0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0.0) AS open, sum(source_size) OVER () AS total FROM w WINDOW p AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped) / open AS level FROM o), m AS (SELECT min_by(level, capped) FILTER (WHERE weight * level <= cap) AS level FROM l),
t AS (SELECT source, source_size, round(least(coalesce(m.level * weight, cap), cap), 6) AS target FROM l, m),
b AS (SELECT *, cast(round(sum(target) OVER () / 16) AS BIGINT) AS n, sum(target) OVER () AS votes FROM t),
sb AS (SELECT source, j, target / (2 * j + 1) AS q, n FROM (SELECT *, unnest(range(0, cast(ceil(target / votes * n) AS BIGINT) + 1000)) AS j FROM b WHERE target > 0)),
sq AS (SELECT source, count(*) AS blocks FROM (SELECT *, row_number() OVER (ORDER BY q DESC, source NULLS LAST, j) AS r FROM sb) WHERE r <= n GROUP BY source),
x AS (SELECT d.*, t.source_size, t.target, coalesce(sq.blocks, 0) AS blocks, ('0x' || substr(content, 1, 15))::BIGINT % greatest(cast(ceil(t.source_size / 200000) AS BIGINT), 1) AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN sq ON d.source IS NOT DISTINCT FROM sq.source),
h AS (SELECT source, shard, cast(sum(size) AS BIGINT) AS shard_size, max(blocks) AS blocks FROM x GROUP BY ALL), hv AS (SELECT *, sum(shard_size) OVER (PARTITION BY source) AS votes FROM h),
hb AS (SELECT source, shard, blocks, unnest(range(0, cast(ceil(shard_size / votes * blocks) AS BIGINT) + 1000)) AS j, shard_size / (2 * j + 1) AS q FROM hv WHERE shard_size > 0),
hq AS (SELECT source, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, j) AS r FROM hb) WHERE r <= blocks GROUP BY ALL),
y AS (SELECT h.*, cast(least(coalesce(quota, 0) * 16, floor(shard_size * 3.0)) AS BIGINT) AS words FROM h LEFT JOIN hq ON h.source IS NOT DISTINCT FROM hq.source AND h.shard = hq.shard),
z AS (SELECT x.*, y.shard_size, y.words, CASE WHEN y.shard_size > 0 THEN y.words // y.shard_size ELSE 0 END AS passes, sum(size) OVER (PARTITION BY x.source, x.shard ORDER BY md5('mix:' || content), size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM x JOIN y ON x.source IS NOT DISTINCT FROM y.source AND x.shard = y.shard)
SELECT doc_id, size, source_size, target, cast(passes * size + least(greatest(words - passes * shard_size - before, 0), size) AS BIGINT) AS taken, source, cast(shard AS INT) AS shard FROM z"""
