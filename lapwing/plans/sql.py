"""Pieces of DuckDB SQL that the queries' oracles share."""

from __future__ import annotations

MANIFEST = """manifest AS (
  SELECT p_partkey AS sku_id, l_partkey || '/' || l_suppkey || '.jpg' AS image_path, p_name AS title, p_brand AS brand, p_type AS category
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) x JOIN part ON l_partkey = p_partkey)"""

SKUS = "skus AS (SELECT sku_id, min(category) AS category, count(*) AS n_rows FROM manifest GROUP BY sku_id)"

VECTORS = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"

ITEMS = VECTORS + """, p AS (
  SELECT vec_id, label, list_transform(v, lambda x, i: x + (CAST(0.2 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (vec_id % 5))
    * (((vec_id * 7919 + i * 104729 + vec_id * i * 31) % 1009) / CAST(1009 AS DOUBLE) - CAST(0.5 AS DOUBLE))) AS w FROM e),
items AS (
  SELECT vec_id * 2 AS item_id, vec_id AS sku_id, label AS category, v AS vec FROM e
  UNION ALL
  SELECT vec_id * 2 + 1, vec_id, label, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM p)"""

#: Every item against all others, ranked: (query_id, item_id, sku_id, similarity, rank).
RANKED = ITEMS + """, near AS (
  SELECT a.item_id AS query_id, a.sku_id AS own, a.category, b.item_id, b.sku_id, round(list_dot_product(a.vec, b.vec), 12) AS similarity
  FROM items a JOIN items b ON a.item_id <> b.item_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM near)"""

PAIRS = ITEMS + """, pairs AS (
  SELECT a.category AS category, a.sku_id = b.sku_id AS same, a.category = b.category AS together, list_dot_product(a.vec, b.vec) AS s
  FROM items a JOIN items b ON a.item_id < b.item_id)"""


def token(seed: object, *keys: str) -> str:
    return f"md5('{seed}'" + "".join(f" || '|' || {k}" for k in keys) + ")"


def uniform(seed: object, *keys: str) -> str:
    return f"(CAST('0x' || substr({token(seed, *keys)}, 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def ranks(groups: str, seed: object, key: str = "sku_id") -> str:
    part = f"PARTITION BY {groups} " if groups else ""
    return f"row_number() OVER ({part}ORDER BY {token(seed, key)})"
