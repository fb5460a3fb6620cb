"""DuckDB SQL for the operators that SQL can express: exact results, by brute force over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _shingles(k: int) -> str:
    """List of distinct k-word shingles of a word list w, or the whole sequence of a shorter one."""
    return f"CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i+{k - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"


OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL)
  WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = e.vec_id
"""

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_shingles(2)} AS s FROM (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents)),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, len(s)::BIGINT AS n_shingles, m AS component_id, d.doc_id = m AS kept FROM d JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id
"""

OP5 = f"""
WITH i AS (SELECT item_id, least(len(w), 5) AS k, w FROM (SELECT item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j+k-1], ' '))) AS x FROM i),
z AS (SELECT item_id, k, count(*) AS n FROM q GROUP BY 1, 2),
d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j+k-1], ' '))) AS x FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)
SELECT s.doc_id, q.item_id, count(*)::BIGINT AS shared, z.n::BIGINT AS item_shingles FROM s JOIN q ON s.k = q.k AND s.x = q.x JOIN z ON z.item_id = q.item_id AND z.k = q.k
GROUP BY s.doc_id, q.item_id, z.k, z.n HAVING count(*) >= 0.8 * z.n - 1e-9
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, j, sha256(array_to_string(w[j:j+34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS j FROM d WHERE len(w) >= 35)),
g AS (SELECT doc_id, j FROM (SELECT doc_id, j, count(*) OVER (PARTITION BY h) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, list_distinct(flatten(list(range(j, j + 35)))) AS gone FROM g GROUP BY doc_id),
t AS (SELECT d.doc_id, d.w, len(coalesce(c.gone, [])) AS n, c.gone FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept FROM (SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d) u WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS e, unnest(gone) AS m FROM c) v WHERE v.e = u.doc_id AND v.m = u.j) GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, t.n::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""

# CRC-32 of the bytes of a text, four bits at a time; fixed values: its remainders for the 16 low half bytes
_CRC_TABLE = [
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
]
_HALF = "xor(({0}) >> 4, t[(({0}) & 15) + 1])"
_CRC = f"4294967295 - reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {_HALF.format(_HALF.format('xor(a, b)'))})"

OP12 = f"""
WITH s AS (SELECT sale_id, floor(floor(epoch(sold_at)) / 3600)::BIGINT AS slot, floor(floor(100 * total::DOUBLE + 0.5) / 100)::BIGINT AS level, 1 + coalesce(({_CRC}) % 2, 0) AS w FROM sales, (SELECT {_CRC_TABLE}::BIGINT[] AS t)),
h AS (SELECT slot, level, count(*) AS n, sum(w) AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY 1, 2),
c AS (SELECT b.slot, b.level, coalesce(sum(a.n), 0)::BIGINT AS n, coalesce(sum(a.w), 0)::BIGINT AS w FROM h b LEFT JOIN h a ON a.slot <= b.slot AND a.level > b.level GROUP BY 1, 2)
SELECT s.sale_id, s.slot, s.level, c.n AS n_sales, c.w AS n_rows FROM s LEFT JOIN c ON c.slot = s.slot AND c.level = s.level
"""
