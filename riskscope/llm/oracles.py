"""DuckDB statements for the queries of this subpackage that SQL can express, named after them."""

from __future__ import annotations

FANOUT = 16
# Levels that the statement unrolls: 16 ** 6 rows of a source, 16 ** 6 sources.
_DEPTH = 6


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str = "text") -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


def _tree(name: str, key: str, passed: str) -> list[str]:
    """Levels {name}0 (key, pos, n, node) upwards; {name}_way: pos of a bottom node, its siblings as l, r by level."""
    parts = []
    for k in range(_DEPTH):
        parts.append(
            f"""{name}{k + 1} AS (SELECT {key}, CASE WHEN n > 1 THEN pos // {FANOUT} ELSE pos END AS pos,
            (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n,
            CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node
            FROM {name}{k} GROUP BY {key}, CASE WHEN n > 1 THEN pos // {FANOUT} ELSE pos END)"""
        )
        parts.append(
            f"""{name}_sib{k} AS (SELECT a.{key}, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
            coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r, any_value(a.n) > 1 AS open
            FROM {name}{k} a JOIN {name}{k} b ON a.{key} IS NOT DISTINCT FROM b.{key} AND a.pos // {FANOUT} = b.pos // {FANOUT}
            GROUP BY a.{key}, a.pos)"""
        )
    joins = " ".join(
        f"JOIN {name}_sib{k} s{k} ON s{k}.{key} IS NOT DISTINCT FROM t.{key} AND s{k}.pos = t.pos // {FANOUT**k}" for k in range(_DEPTH)
    )
    way = ", ".join(f"CASE WHEN s{k}.open THEN {{'l': s{k}.l, 'r': s{k}.r}} END" for k in range(_DEPTH))
    parts.append(f"{name}_way AS (SELECT {passed}, list_filter([{way}], lambda s: s IS NOT NULL) AS way FROM {name}0 t {joins})")
    return parts


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# The checksum of the decimal id: one step a byte, from a table that eight shifts a byte make.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: xor(crc >> 8, steps[(xor(crc, byte) & 255) + 1])), 4294967295)"""

OP11_MERKLE_MANIFEST = f"""
WITH crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
given AS (SELECT doc_id, source, {_leaf()} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf()} END AS presented FROM documents, crc_table),
doc0 AS (SELECT source, doc_id, leaf AS node, presented,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM given),
{", ".join(_tree("doc", "source", "t.*"))},
top0 AS (SELECT 0 AS whole, source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM doc{_DEPTH}),
{", ".join(_tree("top", "whole", "t.*"))},
proofs AS (SELECT d.doc_id, d.node AS leaf, d.presented, p.node AS subroot, (SELECT node FROM top{_DEPTH}) AS root,
    list_concat(d.way, p.way) AS way FROM doc_way d JOIN top_way p ON d.source IS NOT DISTINCT FROM p.source),
folded AS (SELECT *, list_reduce(list_prepend({{'l': presented, 'r': ''}}, way),
    lambda node, s: {{'l': sha256(s.l || node.l || s.r), 'r': ''}}).l AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: s.l || s.r), '')) AS proof_sha256,
    folded_root, folded_root = root AS verified FROM folded
"""

OP13_RTREE_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.q, b.q),
    lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
