"""SQL for the operators whose whole result SQL can express; it compares everything with everything."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


OP1 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents), b AS (SELECT item_id, {words("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i + 1 : i + 13] AS win FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT len(win) AS n FROM win),
spots AS (SELECT r, n, i, w[i + 1 : i + n] AS win FROM (SELECT r, n, w, unnest(range(len(w) - n + 1)) AS i FROM d, size WHERE len(w) >= n)),
occ AS (SELECT r, i, n, item_id FROM spots JOIN win USING (win)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS k FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""

OP2 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN strlen(h) >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""

OP10 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i + 1 : i + 5], ' ') AS sh FROM (SELECT r, w, unnest(range(greatest(len(w) - 5, 0) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n, list_sort(list(sh)) AS shingles FROM s GROUP BY r),
link AS (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.r <> y.r GROUP BY ALL) JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 5 * c >= 4 * (p.n + q.n - c)),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
grp AS (SELECT a AS r, min(doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY a), cnt AS (SELECT a AS r, count(*) AS k FROM link GROUP BY a),
copy AS (SELECT r, min(doc_id) OVER (PARTITION BY shingles) AS copy_class FROM n JOIN d USING (r))
SELECT doc_id, coalesce(copy_class, doc_id) AS copy_class, class_id, coalesce(k, 0)::BIGINT AS n_links FROM d JOIN grp USING (r) LEFT JOIN cnt USING (r) LEFT JOIN copy USING (r)"""

OP13 = """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.c, b.c)::BIGINT AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.c) = len(b.c) WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, id, s FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5)
SELECT pos.anchor_id, pos.id AS positive_id, row_number() OVER (PARTITION BY pos.anchor_id, pos.id ORDER BY p.s DESC, p.id)::INTEGER AS rank, p.id AS negative_id, pos.s AS positive_score, p.s AS negative_score
FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND NOT p.same AND 80 * pos.s <= 100 * p.s AND 100 * p.s <= 100 * pos.s QUALIFY rank <= 5"""

#: Powers of the rolling hash's base, the highest first, as one list; the hash is a sum of products modulo 2**64.
_BASE, _SPREAD, _GRAM, _WINDOW = 6364136223846793005, 0x9E3779B97F4A7C15, 12, 32
_TERMS = " + ".join(f"coalesce(lead(c, {j}) OVER w, 0)::UHUGEINT * {pow(_BASE, _GRAM - 1 - j, 2**64)}::UHUGEINT" for j in range(_GRAM))
_SHORT = "[" + ", ".join(f"{pow(_BASE, j, 2**64)}::UHUGEINT" for j in range(_GRAM)) + "]"

OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT r, doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC NULLS LAST, r), first_value(t) OVER (ORDER BY doc_id DESC NULLS LAST, r)) AS nt FROM d),
e AS (SELECT *, left(t, n - n // 3) || left(nt, n // 3) AS et FROM o),
x AS (SELECT md5(t) AS k, t, length(t) AS n FROM (SELECT t FROM e UNION SELECT et FROM e) WHERE t <> ''),
c AS (SELECT k, n, generate_subscripts(l, 1) - 1 AS i, unicode(unnest(l))::UBIGINT AS c FROM (SELECT k, n, string_split(t, '') AS l FROM x)),
h AS (SELECT k, i, greatest(n - {_GRAM}, 0) + 1 AS runs, ({_TERMS}) % 18446744073709551616::UHUGEINT AS h FROM c WHERE n >= {_GRAM} WINDOW w AS (PARTITION BY k ORDER BY i) QUALIFY i <= n - {_GRAM}
  UNION ALL SELECT k, 0, 1, sum(c::HUGEINT * ({_SHORT}[n - i])::HUGEINT)::UHUGEINT % 18446744073709551616::UHUGEINT FROM c WHERE n < {_GRAM} GROUP BY k),
key AS (SELECT k, i, runs, ((h * {_SPREAD}::UHUGEINT) % 18446744073709551616::UHUGEINT // 65536::UHUGEINT)::HUGEINT * 4294967296 + 4294967295 - i AS key FROM h),
kept AS (SELECT DISTINCT k, (key // 4294967296)::BIGINT AS hash, (4294967295 - key % 4294967296)::BIGINT AS pos FROM (SELECT k, i, runs, min(key) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND {_WINDOW - 1} FOLLOWING) AS key FROM key) WHERE i = 0 OR i + {_WINDOW} <= runs),
fp AS (SELECT k, string_agg(printf('%012x', hash) || printf('%02x', pos - before), '' ORDER BY pos) AS fp FROM (SELECT *, lag(pos, 1, 0) OVER (PARTITION BY k ORDER BY pos) AS before FROM kept) GROUP BY k),
s AS (SELECT DISTINCT k, hash FROM kept), cnt AS (SELECT k, count(*) AS m FROM s GROUP BY k),
p AS (SELECT e.*, a.k AS ka, b.k AS kb, c.k AS kc FROM e LEFT JOIN x a ON a.t = e.t LEFT JOIN x b ON b.t = e.et LEFT JOIN x c ON c.t = e.nt),
common AS (SELECT u.k AS ku, v.k AS kv, count(*) AS common FROM (SELECT DISTINCT ka, kb FROM (SELECT ka, kb FROM p UNION SELECT ka, kc FROM p)) q JOIN s u ON u.k = q.ka JOIN s v ON v.k = q.kb AND v.hash = u.hash GROUP BY ALL)
SELECT doc_id, n::BIGINT AS n_chars, sha256(et) AS edited_sha256, coalesce(f.fp, '') AS fingerprint, coalesce(g.fp, '') AS edited_fingerprint,
  CASE WHEN ka IS NULL AND kb IS NULL THEN 1.0 ELSE coalesce(i.common / (x.m + y.m - i.common), 0.0) END::DOUBLE AS near_edited, CASE WHEN ka IS NULL AND kc IS NULL THEN 1.0 ELSE coalesce(j.common / (x.m + z.m - j.common), 0.0) END::DOUBLE AS near_next
FROM p LEFT JOIN fp f ON f.k = ka LEFT JOIN fp g ON g.k = kb LEFT JOIN cnt x ON x.k = ka LEFT JOIN cnt y ON y.k = kb LEFT JOIN cnt z ON z.k = kc LEFT JOIN common i ON i.ku = ka AND i.kv = kb LEFT JOIN common j ON j.ku = ka AND j.kv = kc"""

#: One byte for each letter beyond ASCII, as DuckDB's edit distance counts bytes; words hold none of these.
_BEYOND, _BYTES = "".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, range(0x21, 0x61))).replace("'", "''")

#: A checksum's table by its rule (eight shifts a value), and the checksum of each run byte by byte.
OP11 = f"""WITH RECURSIVE bit(i, s, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, s + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bit WHERE s < 8),
tab AS (SELECT i, v FROM bit WHERE s = 8),
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL HAVING length(run) >= 6),
b AS (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs),
crc(run, c, h, i, v) AS (SELECT run, c, h, 0, 4294967295 FROM b UNION ALL SELECT run, c, h, crc.i + 1, xor(crc.v // 256, tab.v) FROM crc JOIN tab ON tab.i = xor(crc.v % 256, ('0x' || substr(h, 2 * crc.i + 1, 2))::BIGINT) WHERE 2 * crc.i < length(h)),
s AS (SELECT run, c, xor(v, 4294967295) AS v FROM crc WHERE 2 * i = length(h)),
w AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN v % 199 = 0 THEN left(run, v % length(run)) || substr(run, v % length(run) + 2) ELSE run END AS word, c FROM s) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
y AS (SELECT *, translate(word, '{_BEYOND}', '{_BYTES}') AS bytes FROM w),
near AS (SELECT a.word, a.n, o.word AS other, o.n AS other_n FROM y a JOIN y o ON abs(length(a.word) - length(o.word)) <= 1 AND levenshtein(a.bytes, o.bytes) = 1),
f AS (SELECT w.word, any_value(w.n) AS n, count(other) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM w LEFT JOIN near USING (word) GROUP BY w.word),
g AS (SELECT word, n, n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM f),
walk(word, root) AS (SELECT word, word FROM g UNION SELECT walk.word, g.form FROM walk JOIN g ON g.word = walk.root WHERE g.form IS NOT NULL),
last AS (SELECT walk.word, root FROM walk JOIN g ON g.word = root WHERE g.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM g JOIN last USING (word)"""
