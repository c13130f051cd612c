"""DuckDB SQL for the queries that SQL can express."""

OP6 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP7 = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, p AS pos, array_to_string(ls[p + 1:p + 3], chr(10)) AS win FROM (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS p FROM l)),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM w),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM f, (SELECT unnest(range(3)) AS k) WHERE n > 1),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
k AS (SELECT u.doc_id, string_agg(line, chr(10) ORDER BY u.pos) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, pos) GROUP BY 1)
SELECT l.doc_id, len(ls) AS n_lines, len(ls) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM l LEFT JOIN k USING (doc_id)
"""

# crc32 by its definition: bytes one by one; a byte's remainder is the sum (xor) of the remainders of its bits. Fixed values.
_BITS = (1996959894, 3993919788, 124634137, 249268274, 498536548, 997073096, 1994146192, 3988292384)
_STEP = "c >> 8"
for _k, _r in enumerate(_BITS):
    _STEP = f"xor({_STEP}, ((xor(c & 255, b) >> {_k}) & 1) * {_r})"


def crc32(text: str) -> str:
    """SQL: the unsigned crc32 of a text's UTF-8 bytes."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce([4294967295] || {octets}, lambda c, b: {_STEP}), 4294967295)"


def _unit(what: str) -> str:
    """SQL: 52 bits of an MD5 as a whole number."""
    return f"('0x' || substr(md5({what}), 1, 13))::BIGINT"


OP11 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, source, strlen(t) + 16 AS size, {crc32("t")} AS text_crc32, md5(t) AS tie,
  {_unit("'interleave-1:' || coalesce(doc_id::VARCHAR, '-')")} AS k,
  {_unit("'interleave-1:source:' || coalesce('=' || source, '-')")} / 4503599627370496.0::DOUBLE AS u FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, tie) AS rank, count(*) OVER (PARTITION BY source) AS n FROM h),
f AS (SELECT *, (rank::DOUBLE - u) / n::DOUBLE AS share FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY share, source NULLS FIRST, rank) - 1 AS place, count(*) OVER () AS total FROM f),
s AS (SELECT *, place * 40 // total AS shard FROM p)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot,
  NULL::INT AS grown_shard FROM s
"""


def _leaf(*values: str) -> str:
    parts = " || ".join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in values)
    return f"sha256({parts})"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, leaves: str) -> str:
    """SQL: nodes (tree, level, i, node, n) of the trees over leaves (tree, i, node, n); n is the tree's node count of that level."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, i, node, n FROM {leaves}
  UNION ALL
  SELECT tree, any_value(level) + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY tree, i // 8)"""


def _walk(name: str, start: str, nodes: str) -> str:
    """SQL: each start (id, tree, i, node, path) led to its tree's root, with its siblings in ``path``."""
    side = "(SELECT coalesce(string_agg(x.node, '' ORDER BY x.i), '') FROM {n} x WHERE x.tree = w.tree AND x.level = w.level AND x.i // 8 = w.i // 8 AND x.i {o} w.i)"
    before, after = side.format(n=nodes, o="<"), side.format(n=nodes, o=">")
    return f"""{name} AS (
  SELECT id, tree, 0 AS level, i, node, n, path FROM {start}
  UNION ALL
  SELECT id, tree, level + 1, i // 8, sha256(before || node || after), (n + 7) // 8, path || before || after
  FROM (SELECT w.*, {before} AS before, {after} AS after FROM {name} w WHERE n > 1))"""


OP13 = f"""
WITH RECURSIVE l AS (SELECT doc_id, lang, {_leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
  CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf("doc_id", "source", "lang", "n_chars", _LOWER)} END AS other FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM l)),
o AS (SELECT l.doc_id, g.tree, l.leaf, coalesce(l.other, l.leaf) AS given, row_number() OVER (PARTITION BY g.tree ORDER BY l.doc_id NULLS FIRST, l.leaf) - 1 AS i,
  count(*) OVER (PARTITION BY g.tree) AS n, row_number() OVER (ORDER BY g.tree, l.doc_id NULLS FIRST, l.leaf) AS id FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang),
low AS (SELECT tree, i, leaf AS node, n FROM o),
{_tree("a", "low")},
sub AS (SELECT tree, node AS subroot FROM a WHERE n = 1),
up AS (SELECT 0 AS tree, tree AS i, subroot AS node, (SELECT count(*) FROM sub) AS n FROM sub),
{_tree("b", "up")},
given AS (SELECT id, tree, i, given AS node, n, '' AS path FROM o),
{_walk("w1", "given", "a")},
mid AS (SELECT id, 0 AS tree, tree AS i, node, (SELECT count(*) FROM sub) AS n, path FROM w1 WHERE n = 1),
{_walk("w2", "mid", "b")},
folded AS (SELECT id, node AS folded_root, sha256(path) AS proof_sha256 FROM w2 WHERE n = 1)
SELECT o.doc_id, o.leaf, sub.subroot, r.node AS root, f.proof_sha256, f.folded_root, f.folded_root = r.node AS verified
FROM o JOIN sub USING (tree) JOIN folded f USING (id), (SELECT node FROM b WHERE n = 1) r
"""

SQL = {"op6_exact_dedup": OP6, "op7_line_dedup": OP7, "op11_sharding": OP11, "op13_merkle_manifest": OP13}
