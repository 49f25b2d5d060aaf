"""SQL twins of the contract queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5(concat(coalesce(cast(doc_id AS varchar), ''), ':17')) AS k FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, cast([5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS double) AS weight FROM s),
c AS (SELECT *, source_size * 2e0 AS cap, source_size * 2e0 / weight AS r FROM w),
l AS (SELECT *, row_number() OVER o AS rn, (sum(source_size) OVER () * 1.5e0 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c WINDOW o AS (ORDER BY r, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, rn) FROM l WHERE level <= r), 'infinity'::double) * weight) AS target FROM l),
m AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN cast(floor(floor(t.target) / t.source_size) AS bigint) ELSE 0 END AS epochs, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, cast(size AS bigint) AS size, source_size, target, cast(epochs * size + greatest(0, least(size, cast(floor(target) AS bigint) - epochs * source_size - before)) AS bigint) AS taken, source, epochs FROM m
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, w FROM d),
x AS (SELECT doc_id, pos, w[pos] AS word, CASE WHEN pos + 34 <= len(w) THEN array_to_string(w[pos:pos + 34], ' ') END AS win FROM p),
y AS (SELECT doc_id, pos, word, win IS NOT NULL AND count(win) OVER (PARTITION BY win) > 1 AS again FROM x),
z AS (SELECT doc_id, pos, word, max(cast(again AS int)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM y),
k AS (SELECT doc_id, cast(sum(gone) AS bigint) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM z GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def _place(shards: int, name: str) -> str:
    return f"""{name} AS (SELECT doc_id, arg_max(i, -1e0 / ln((cast(concat('0x', substr(md5(concat(coalesce(cast(doc_id AS varchar), ''), ':', i)), 1, 13)) AS bigint) + 0.5e0) / 4503599627370496e0)) AS shard FROM documents, range({shards}) r(i) GROUP BY doc_id)"""



def _round(i: int, last: bool) -> str:
    """Assignment to the centroids of round i, and the centroids after it."""
    assigned = f"""a{i} AS MATERIALIZED (SELECT rid, min(d * 8 + j) % 8 AS j, min(d * 8 + j) // 8 AS d FROM (SELECT rid, j, list_sum(list_transform(range(1, 65), lambda x: (q[x] - c[x]) * (q[x] - c[x])))::bigint AS d FROM v, c{i}) GROUP BY rid)"""
    if last:
        return assigned
    return f"""{assigned},
m{i} AS MATERIALIZED (SELECT j, list(cast((s - ((s % n) + n) % n) // n AS bigint) ORDER BY pos) AS c FROM (SELECT j, pos, sum(x)::bigint AS s, count(*) AS n FROM (SELECT j, unnest(q) AS x, unnest(range(1, 65)) AS pos FROM a{i} JOIN v USING (rid)) GROUP BY j, pos) GROUP BY j),
c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.j = c{i}.j)"""


OP11 = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS double)) AS bigint)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS j, q AS c FROM (SELECT sha256(concat('3:', cast(vec_id AS varchar))) AS h, q FROM v ORDER BY h, q LIMIT 8)),
{", ".join(_round(i, i == 10) for i in range(11))},
t AS MATERIALIZED (SELECT j, cast(sum(d) AS bigint) AS s FROM a10 GROUP BY j)
SELECT v.vec_id, cast(a10.j AS int) AS cluster, a10.d AS distance, t.s AS cluster_inertia, (SELECT cast(sum(s) AS bigint) FROM t) AS inertia, sha256(array_to_string(c10.c, ',')) AS centroid_sha256
FROM v JOIN a10 USING (rid) JOIN t ON t.j = a10.j JOIN c10 ON c10.j = a10.j
"""

# The CRC goes over the bytes by a table of 256 remainders, which is itself eight steps of the polynomial.
OP9 = f"""
WITH {_place(40, 'a')}, {_place(41, 'b')},
tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT doc_id, len(h) // 2 + 16 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: cast(concat('0x', x) AS bigint))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab),
n AS (SELECT a.doc_id, a.shard, md5(coalesce(cast(a.doc_id AS varchar), '')) AS k FROM a)
SELECT crc.doc_id, cast(size AS bigint) AS size, text_crc32, 'key' AS law, cast(a.shard AS int) AS shard, cast(b.shard AS int) AS grown_shard, row_number() OVER (PARTITION BY a.shard ORDER BY substr(md5(concat('slot', coalesce(cast(crc.doc_id AS varchar), ''))), 1, 3), crc.doc_id IS NULL, md5(concat('slot', coalesce(cast(crc.doc_id AS varchar), ''))), crc.doc_id) - 1 AS slot FROM crc JOIN a ON a.doc_id = crc.doc_id JOIN b ON b.doc_id = crc.doc_id
"""

OP13 = """
WITH tab AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
h AS (SELECT doc_id, source, lang, length(text) AS len, doc_id + xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(cast(doc_id AS varchar))), '..'), lambda x: cast(concat('0x', x) AS bigint))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS place FROM documents, tab),
e AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, 60 * ((place - ((place % 6) + 6) % 6) // 6) AS event_s FROM h),
w AS (SELECT rid, doc_id, source, event_s, unnest([600, 43200]) AS width FROM e),
g AS (SELECT w.rid, w.width, count(*) AS n, sum(o.len) AS s, count(DISTINCT o.lang) AS langs, list_sort(list(o.len) FILTER (o.len IS NOT NULL)) AS l FROM w JOIN e o ON o.source IS NOT DISTINCT FROM w.source AND o.event_s < w.event_s AND o.event_s >= w.event_s - w.width GROUP BY w.rid, w.width)
SELECT w.doc_id, cast(w.width AS bigint) AS window_s, w.event_s, coalesce(n, 0) AS n_events, cast(coalesce(s, 0) AS bigint) AS sum_chars, coalesce(langs, 0) AS n_langs, l[(len(l) + 1) // 2] AS median_chars, l[(90 * len(l) + 99) // 100] AS high_chars
FROM w LEFT JOIN g ON g.rid = w.rid AND g.width = w.width
"""
