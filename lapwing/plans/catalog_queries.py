"""Catalog, pairing and text queries: name -> (plan, DuckDB SQL or None)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions import text as T
from lapwing.operators import catalog, pairs, serve
from lapwing.plans import sql as S
from lapwing.sources import tables
from lapwing.sources.buckets import bucketed
from lapwing.sources.shared import once, shared_folder, stored
from lapwing.streaming import endless

SAMPLE = 301


def _skus(spark: SparkSession, d: str) -> DataFrame:
    """The SKU table: the whole manifest aggregated once, for plans that count, rank and join it."""
    return once(catalog.sku_table(tables.manifest(spark, d)))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return catalog.split_skus(_skus(spark, d))


def _split_manifest(spark: SparkSession, d: str) -> DataFrame:
    return tables.manifest(spark, d).join(_split(spark, d).select("sku_id", "split"), "sku_id")


def manifest_build(spark, d):
    return catalog.build_manifest(tables.listings(spark, d), tables.image_index(spark, d)).withColumn("image_index", F.col("image_index").cast("long"))


def min_images(spark, d):
    return catalog.with_min_images(tables.manifest(spark, d), 25).groupBy("sku_id").agg(F.count("*").alias("n"))


def tail_consolidation(spark, d):
    return catalog.category_counts(catalog.consolidate(tables.manifest(spark, d, fine=True)))


def category_counts(spark, d):
    return catalog.category_counts(tables.manifest(spark, d)).orderBy(F.desc("n_rows"), "category")


def images_per_sku(spark, d):
    return catalog.images_per_sku(tables.manifest(spark, d))


def stratified_sample(spark, d):
    return catalog.stratified_sample(_skus(spark, d), SAMPLE)


def sku_splits(spark, d):
    return _split(spark, d)


def split_totals(spark, d):
    return catalog.split_totals(_split_manifest(spark, d))


def split_leaks(spark, d):
    return catalog.leaks(_split_manifest(spark, d))


def catalog_stats(spark, d):
    return catalog.catalog_stats(_split_manifest(spark, d))


def localised_names(spark, d):
    turns = tables.read(spark, d, "conversations")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("language_tag"), t["text"].alias("value")))
    return turns.groupBy("conv_id").agg(entries.alias("e")).select("conv_id", T.pick_localised(F.col("e"), "assistant").alias("title"))


def positive_pairs(spark, d):
    return pairs.positive_pairs(tables.manifest(spark, d))


def hard_negatives(spark, d):
    return pairs.hard_negatives(_skus(spark, d))


def triplets(spark, d):
    return pairs.triplets(tables.manifest(spark, d))


def top_categories(spark, d):
    return catalog.category_counts(tables.manifest(spark, d, fine=True)).orderBy(F.desc("n_rows"), "category").limit(15)


def last_categories(spark, d):
    """The type of each user's last event."""
    e = tables.read(spark, d, "events").select(F.col("user_id").alias("sku_id"), F.col("event_type").alias("category"), "event_id")
    return catalog.last_of(e, "sku_id", "category", "event_id")


def category_estimates(spark, d):
    """Whether sketches, by category and merged for all, tell the distinct SKUs within 5 %."""
    manifest = stored(tables.manifest(spark, d, fine=True).select("category", "sku_id"), "manifest")
    sketches = stored(catalog.category_sketches(manifest), "sketches")
    every = sketches.agg(F.hll_union_agg("sketch").alias("sketch")).select(F.lit("*").alias("category"), "sketch")
    exact = manifest.groupBy("category").agg(F.countDistinct("sku_id").alias("n")).unionByName(manifest.agg(F.countDistinct("sku_id").alias("n")).withColumn("category", F.lit("*")))
    estimate = F.hll_sketch_estimate("sketch")
    return sketches.unionByName(every).join(exact, "category").select("category", F.col("n").alias("n_skus"), (F.abs(estimate - F.col("n")) <= F.greatest(F.lit(1.0), 0.05 * F.col("n"))).alias("near"))


def end_to_end_splits(spark, d):
    rows = catalog.end_to_end_splits(tables.listings(spark, d), tables.image_index(spark, d), SAMPLE)
    return rows.groupBy("sku_id", "category", "split").agg(F.count("*").alias("n_rows"))


def bucketed_splits(spark, d):
    """Rows of each SKU with its split, from tables bucketed by SKU: neither the join nor the counts move a row."""
    rows = bucketed(tables.manifest(spark, d).select("sku_id", "image_path", "category"), "sku_id", label="manifest")
    split = bucketed(_split(spark, d).select("sku_id", "split"), "sku_id", label="split")
    return rows.join(split.hint("merge"), "sku_id").groupBy("sku_id").agg(F.first("split").alias("split"), F.count("*").alias("n_rows"), F.min("image_path").alias("first_path"), F.max("image_path").alias("last_path"))


def inverted_lists(spark, d):
    """SKUs of each category by a table bucketed by category: numbers, and the least and greatest of them."""
    skus = bucketed(_skus(spark, d).select("category", "sku_id", "n_rows"), "category", label="categories")
    return skus.groupBy("category").agg(F.count("*").alias("n_skus"), F.sum("n_rows").alias("n_rows"), F.min("sku_id").alias("first_sku"), F.max("sku_id").alias("last_sku"))


def endless_triplets(spark, d):
    """Two and a half epochs of the endless stream of triplets, in micro-batches that cross the epochs' ends."""
    rows = stored(pairs.triplets(tables.manifest(spark, d)), "triplets")
    n, folder = rows.count(), f"{shared_folder(spark)}/draws-{uuid.uuid4().hex}"
    query = endless.serve_triplets(endless.draws(spark, n, max(1, n * 9 // 10), until=n * 5 // 2), rows, f"{folder}/out", f"{folder}/log")
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(f"{folder}/out").select("draw", "epoch", "sku_id", "anchor_path", "positive_path", "negative_sku", "negative_path")


def pair_batch(spark, d):
    return pairs.draw_batch(pairs.positive_pairs(tables.manifest(spark, d)), 64)


def epoch_order(spark, d):
    return pairs.shuffled(_skus(spark, d).select("sku_id"), "sku_id", epoch=3)


def text_quality(spark, d):
    t = tables.titles(spark, d)
    return t.select("sku_id", T.text_quality(F.col("title")).alias("quality"), T.image_weight(F.col("title")).alias("weight"), T.collapse_spaces(F.col("title")).alias("title"))


def _tokens(spark, d, length, vocabulary, text):
    ids = T.hash_tokens(text, length, vocabulary)
    t = tables.titles(spark, d).select("sku_id", ids.alias("ids"))
    return t.select("sku_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.aggregate(T.token_mask(F.col("ids")), F.lit(0).cast("long"), lambda s, m: s + m).alias("n_tokens"))


def hash_tokens(spark, d):
    return _tokens(spark, d, 64, 30000, F.col("title"))


def serve_tokens(spark, d):
    return _tokens(spark, d, 32, 10000, F.when(F.trim("title") == "", "<empty>").otherwise(F.col("title")))


def _changed(spark, d, change):
    return tables.titles(spark, d).select("sku_id", change(F.col("title"), F.col("brand"), F.col("sku_id")).alias("title"))


def typo(spark, d):
    return _changed(spark, d, lambda t, b, k: T.typo(t, k, 42))


def swap(spark, d):
    return _changed(spark, d, lambda t, b, k: T.swap(t, k, 42))


def drop_words(spark, d):
    return _changed(spark, d, lambda t, b, k: T.drop_words(t, b, k, 42))


def truncate(spark, d):
    return _changed(spark, d, lambda t, b, k: T.truncate(t, k, 42))


def perturb(spark, d):
    return T.perturb(tables.titles(spark, d), "title", "brand", "sku_id").select("sku_id", "title")


def json_properties(spark, d):
    v = F.try_parse_json("props")
    return tables.read(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"))


def request_validation(spark, d):
    turns = tables.read(spark, d, "conversations")
    image = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("")
    return serve.validated(turns.select("conv_id", "turn", image.alias("image_base64"), (F.col("turn") * 20).alias("top_k"))).select("conv_id", "turn", "error")


TYPO_SQL = """
SELECT sku_id, CASE WHEN length(title) >= 3 AND near IS NOT NULL
  THEN substr(title, 1, place - 1) || CASE WHEN found = lower(found) THEN new ELSE upper(new) END || substr(title, place + 1) ELSE title END AS title
FROM (SELECT *, substr(near, CAST(least(floor({to} * length(near)), length(near) - 1) AS BIGINT) + 1, 1) AS new
  FROM (SELECT *, {table} AS near
    FROM (SELECT *, substr(title, place, 1) AS found
      FROM (SELECT *, CAST(least(floor({at} * length(title)), length(title) - 1) AS BIGINT) + 1 AS place FROM ({source})))))
"""
SWAP_SQL = """
SELECT sku_id, CASE WHEN length(title) >= 4 THEN substr(title, 1, place - 1) || substr(title, place + 1, 1) || substr(title, place, 1) || substr(title, place + 2) ELSE title END AS title
FROM (SELECT *, CAST(least(floor({at} * (length(title) - 1)), length(title) - 2) AS BIGINT) + 1 AS place FROM ({source}))
"""
DROP_SQL = """
SELECT sku_id, CASE WHEN len(words) > 2 AND len(rest) > 0 THEN array_to_string(rest, ' ') ELSE title END AS title
FROM (SELECT *, list_filter(picked, lambda w, i: {word} > CAST(0.15 AS DOUBLE)) AS rest
  FROM (SELECT *, CASE WHEN coalesce(brand, '') <> '' AND {brand} < CAST(0.4 AS DOUBLE) THEN list_filter(words, lambda w: lower(w) <> lower(brand)) ELSE words END AS picked
    FROM (SELECT *, {words} AS words FROM ({source}))))
"""
CUT_SQL = """
SELECT sku_id, CASE WHEN len(words) > 3
  THEN array_to_string(words[1:2 + CAST(least(floor({at} * (len(words) - 2)), len(words) - 3) AS BIGINT)], ' ') ELSE title END AS title
FROM (SELECT *, {words} AS words FROM ({source}))
"""
TITLES = "SELECT doc_id AS sku_id, text AS title, string_split_regex(text, '\\s+')[1] AS brand FROM documents"


def _typo_sql(source: str) -> str:
    table = "CASE lower(found) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.KEY_NEIGHBOURS.items()) + " END"
    return TYPO_SQL.format(source=source, table=table, at=S.uniform("42:typo-at", "sku_id"), to=S.uniform("42:typo-to", "sku_id"))


def _swap_sql(source: str) -> str:
    return SWAP_SQL.format(source=source, at=S.uniform("42:swap", "sku_id"))


def _drop_sql(source: str) -> str:
    return DROP_SQL.format(source=source, word=S.uniform("42:word", "sku_id", "(i - 1)"), brand=S.uniform("42:brand", "sku_id"), words=S.words("title"))


def _cut_sql(source: str) -> str:
    return CUT_SQL.format(source=source, at=S.uniform("42:cut", "sku_id"), words=S.words("title"))


def _perturb_sql() -> str:
    """Each step beside its input, chosen by the step's draw."""
    source, steps = "t0", ""
    for n, (name, p, make) in enumerate((("drop", 0.2, _drop_sql), ("cut", 0.15, _cut_sql), ("swap", 0.2, _swap_sql), ("typo", 0.3, _typo_sql)), 1):
        draw = S.uniform(f"42:{name}?", "a.sku_id")
        steps += f""", s{n} AS ({make(f"SELECT * FROM {source}")}), t{n} AS (
            SELECT a.sku_id, a.brand, CASE WHEN {draw} < CAST({p} AS DOUBLE) THEN b.title ELSE a.title END AS title FROM {source} a JOIN s{n} b USING (sku_id))"""
        source = f"t{n}"
    empty = S.uniform("42:empty?", "t0.sku_id")
    last = f"trim(regexp_replace({source}.title, '\\s+', ' ', 'g'))"
    return f"""WITH t0 AS ({TITLES}){steps}
        SELECT t0.sku_id, CASE WHEN trim(t0.title) = '' OR {empty} < CAST(0.05 AS DOUBLE) THEN '' WHEN {last} = '' THEN t0.title ELSE {last} END AS title
        FROM t0 JOIN {source} USING (sku_id)"""


def _tokens_sql(length: int, vocabulary: int, text: str) -> str:
    return f"""
    SELECT sku_id, array_to_string(list_concat(ids, list_transform(range({length} - len(ids)), lambda i: '0')), ' ') AS ids, CAST(len(ids) AS BIGINT) AS n_tokens
    FROM (SELECT doc_id AS sku_id, list_transform({S.words(f"lower({text})")}[1:{length}],
        lambda w: CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {vocabulary} + 1 AS VARCHAR)) AS ids FROM documents)"""


_with = lambda *parts: "WITH " + ", ".join(parts) + " "
_split_sql = f"""split AS (
  SELECT sku_id, category, n_rows, CASE WHEN (rank - CAST(0.5 AS DOUBLE)) / n < CAST(0.8 AS DOUBLE) THEN 'train'
    WHEN (rank - CAST(0.5 AS DOUBLE)) / n < CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, {S.ranks("category", 42)} AS rank, count(*) OVER (PARTITION BY category) AS n FROM skus))"""
_positive_sql = f"""positive AS (
  SELECT sku_id, max(image_path) FILTER (n = 1) AS anchor_path, coalesce(max(image_path) FILTER (n = 2), max(image_path) FILTER (n = 1)) AS positive_path,
         count(*) FILTER (n = 2) > 0 AS is_multi_angle
  FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY {S.token(42, "sku_id", "image_path")}, image_path) AS n FROM manifest) WHERE n <= 2 GROUP BY sku_id)"""
_negative_sql = f"""ring AS (SELECT *, {S.ranks("category", 42)} AS r, count(*) OVER (PARTITION BY category) AS n FROM skus),
negative AS (
  SELECT a.sku_id, a.category, b.sku_id AS negative_sku, TRUE AS same_category FROM ring a JOIN ring b ON a.category = b.category AND a.r % a.n + 1 = b.r WHERE a.n > 1)"""

_triplet_sql = """SELECT p.sku_id, p.anchor_path, p.positive_path, n.negative_sku, o.anchor_path AS negative_path, p.is_multi_angle, n.same_category
FROM positive p JOIN negative n USING (sku_id) JOIN positive o ON n.negative_sku = o.sku_id"""

QUERIES = {
    "manifest_build": (manifest_build, """
WITH im AS (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY sk <> mk, sk) AS place FROM (SELECT *, max(sk) OVER (PARTITION BY pk) AS mk FROM im)),
k AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY place) - 1 AS i FROM o WHERE sk % 10 <> 3)
SELECT CAST(pk AS VARCHAR) AS sku_id, 'img/' || pk || '-' || sk || '.jpg' AS image_path, i AS image_index, i = 0 AS is_main_image, p_name AS title, p_brand AS brand,
       CASE WHEN pk % 50 = 0 THEN 'OTHER' ELSE p_type END AS category
FROM k JOIN part ON pk = p_partkey WHERE pk % 97 <> 0"""),
    "min_images": (min_images, _with(S.MANIFEST) + "SELECT sku_id, count(*) AS n FROM manifest GROUP BY sku_id HAVING count(*) >= 25"),
    "tail_consolidation": (tail_consolidation, """
WITH m AS (SELECT p_partkey AS sku_id, p_brand || ':' || p_size % 5 AS category FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) x JOIN part ON l_partkey = p_partkey),
c AS (SELECT category AS k, count(DISTINCT sku_id) AS n FROM m GROUP BY category)
SELECT CASE WHEN n < 20 THEN 'OTHER' ELSE category END AS category, count(*) AS n_rows, count(DISTINCT sku_id) AS n_skus FROM m JOIN c ON category = k GROUP BY 1"""),
    "category_counts": (category_counts, _with(S.MANIFEST) + "SELECT category, count(*) AS n_rows, count(DISTINCT sku_id) AS n_skus FROM manifest GROUP BY category"),
    "images_per_sku": (images_per_sku, _with(S.MANIFEST, S.SKUS) + "SELECT count(*) AS n_skus, avg(n_rows) AS mean, quantile_cont(n_rows, 0.5) AS median, max(n_rows) AS most, min(n_rows) AS least FROM skus"),
    "stratified_sample": (stratified_sample, _with(S.MANIFEST, S.SKUS, f"""
q AS (SELECT category, count(*) AS n, sum(count(*)) OVER () AS whole FROM skus GROUP BY category),
b AS (SELECT *, n * {SAMPLE} // whole AS base, row_number() OVER (ORDER BY n * {SAMPLE} % whole DESC, category) AS place FROM q),
c AS (SELECT *, base + CASE WHEN place <= {SAMPLE} - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT *, {S.ranks("category", 42)} AS rank FROM skus)""") + "SELECT r.sku_id, r.category, r.n_rows FROM r JOIN c USING (category) WHERE rank <= quota"),
    "sku_splits": (sku_splits, _with(S.MANIFEST, S.SKUS, _split_sql) + "SELECT * FROM split"),
    "top_categories": (top_categories, """
WITH m AS (SELECT p_partkey AS sku_id, p_brand || ':' || p_size % 5 AS category FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) x JOIN part ON l_partkey = p_partkey)
SELECT category, count(*) AS n_rows, count(DISTINCT sku_id) AS n_skus FROM m GROUP BY category ORDER BY n_rows DESC, category LIMIT 15"""),
    "last_categories": (last_categories, "SELECT user_id AS sku_id, arg_max(event_type, event_id) AS category FROM events GROUP BY user_id"),
    "category_estimates": (category_estimates, """
WITH m AS (SELECT p_partkey AS sku_id, p_brand || ':' || p_size % 5 AS category FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) x JOIN part ON l_partkey = p_partkey)
SELECT coalesce(category, '*') AS category, count(DISTINCT sku_id) AS n_skus, TRUE AS near FROM m GROUP BY ROLLUP (category)"""),
    "end_to_end_splits": (end_to_end_splits, f"""
WITH im AS (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem),
k AS (SELECT CAST(pk AS VARCHAR) AS sku_id, pk FROM im WHERE sk % 10 <> 3 AND pk % 97 <> 0),
skus AS (SELECT sku_id, CASE WHEN pk % 50 = 0 THEN 'OTHER' ELSE p_type END AS category, count(*) AS n_rows FROM k JOIN part ON pk = p_partkey GROUP BY ALL),
q AS (SELECT category, count(*) AS n, sum(count(*)) OVER () AS whole FROM skus GROUP BY category),
b AS (SELECT *, n * {SAMPLE} // whole AS base, row_number() OVER (ORDER BY n * {SAMPLE} % whole DESC, category) AS place FROM q),
c AS (SELECT *, base + CASE WHEN place <= {SAMPLE} - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT *, {S.ranks("category", 42)} AS rank FROM skus),
chosen AS (SELECT r.sku_id, r.category, r.n_rows FROM r JOIN c USING (category) WHERE rank <= quota),
""" + _split_sql.replace("FROM skus)", "FROM chosen)") + " SELECT sku_id, category, split, n_rows FROM split"),
    "bucketed_splits": (bucketed_splits, _with(S.MANIFEST, S.SKUS, _split_sql) + """
SELECT sku_id, any_value(split) AS split, count(*) AS n_rows, min(image_path) AS first_path, max(image_path) AS last_path FROM manifest JOIN split USING (sku_id) GROUP BY sku_id"""),
    "inverted_lists": (inverted_lists, _with(S.MANIFEST, S.SKUS) + "SELECT category, count(*) AS n_skus, CAST(sum(n_rows) AS BIGINT) AS n_rows, min(sku_id) AS first_sku, max(sku_id) AS last_sku FROM skus GROUP BY category"),
    "split_totals": (split_totals, _with(S.MANIFEST, S.SKUS, _split_sql) + "SELECT split, count(*) AS n_rows, count(DISTINCT sku_id) AS n_skus FROM manifest JOIN split USING (sku_id) GROUP BY ROLLUP (split)"),
    "split_leaks": (split_leaks, _with(S.MANIFEST, S.SKUS, _split_sql) + """
SELECT a, b, CAST((SELECT count(*) FROM (SELECT sku_id FROM split WHERE split = a INTERSECT SELECT sku_id FROM split WHERE split = b)) AS BIGINT) AS shared
FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) t(a, b)"""),
    "catalog_stats": (catalog_stats, _with(S.MANIFEST, S.SKUS, _split_sql, """
m AS (SELECT split, manifest.category FROM manifest JOIN split USING (sku_id)),
t AS (SELECT sku_id, count(*) AS n FROM manifest GROUP BY sku_id),
a AS (SELECT string_agg('"' || split || '":' || n, ',' ORDER BY split) AS j FROM (SELECT split, count(*) AS n FROM m GROUP BY split)),
b AS (SELECT string_agg('"' || category || '":' || n, ',' ORDER BY category) AS j FROM (SELECT category, count(*) AS n FROM m GROUP BY category))""") + """
SELECT '{"splits":{' || a.j || '},"categories":{' || b.j || '},"n_skus":' || count(*) || ',"mean":' || avg(n) || ',"median":' || quantile_cont(n, 0.5) || ',"most":' || max(n) || ',"least":' || min(n) || '}' AS stats
FROM t, a, b GROUP BY a.j, b.j"""),
    "localised_names": (localised_names, """
SELECT conv_id, trim(coalesce(arg_min(text, turn) FILTER (role LIKE 'assistant%'), arg_min(text, turn), '')) AS title FROM conversations GROUP BY conv_id"""),
    "positive_pairs": (positive_pairs, _with(S.MANIFEST, _positive_sql) + "SELECT * FROM positive"),
    "hard_negatives": (hard_negatives, _with(S.MANIFEST, S.SKUS, _negative_sql) + "SELECT * FROM negative"),
    "triplets": (triplets, _with(S.MANIFEST, S.SKUS, _positive_sql, _negative_sql) + _triplet_sql),
    "endless_triplets": (endless_triplets, _with(S.MANIFEST, S.SKUS, _positive_sql, _negative_sql, f"t AS ({_triplet_sql})", """
served AS (SELECT t.*, CAST(e AS BIGINT) AS epoch, e * count(*) OVER (PARTITION BY e) + row_number() OVER (PARTITION BY e ORDER BY md5('42:' || e || '|' || sku_id)) - 1 AS draw FROM t, (SELECT unnest([0, 1, 2]) AS e))""")
        + "SELECT draw, epoch, sku_id, anchor_path, positive_path, negative_sku, negative_path FROM served WHERE draw < (SELECT count(*) * 5 // 2 FROM t)"),
    "pair_batch": (pair_batch, _with(S.MANIFEST, _positive_sql, f"""
r AS (SELECT *, {S.ranks("", 42)} AS rank, count(*) OVER () AS total FROM positive),
d AS (SELECT range AS draw, CAST(least(floor({S.uniform("42:draw", "range")} * (SELECT count(*) FROM positive)), (SELECT count(*) FROM positive) - 1) AS BIGINT) + 1 AS want FROM range(64))""") + """
SELECT draw, sku_id, anchor_path, positive_path, is_multi_angle FROM d JOIN r ON want = rank"""),
    "epoch_order": (epoch_order, _with(S.MANIFEST, S.SKUS) + f"SELECT sku_id, {S.ranks('', '42:3')} AS place FROM skus"),
    "text_quality": (text_quality, f"""
SELECT doc_id AS sku_id, least(len({S.words("text")}) / CAST(20 AS DOUBLE), 1.0) AS quality,
       CAST(CASE WHEN len({S.words("text")}) <= 3 THEN 0.85 WHEN len({S.words("text")}) >= 10 THEN 0.50 ELSE 0.70 END AS DOUBLE) AS weight,
       trim(regexp_replace(text, '\\s+', ' ', 'g')) AS title FROM documents"""),
    "hash_tokens": (hash_tokens, _tokens_sql(64, 30000, "text")),
    "serve_tokens": (serve_tokens, _tokens_sql(32, 10000, "CASE WHEN trim(text) = '' THEN '<empty>' ELSE text END")),
    "typo": (typo, _typo_sql(TITLES)),
    "swap_characters": (swap, _swap_sql(TITLES)),
    "drop_words": (drop_words, _drop_sql(TITLES)),
    "truncate_title": (truncate, _cut_sql(TITLES)),
    "perturb_title": (perturb, _perturb_sql()),
    "json_properties": (json_properties, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "request_validation": (request_validation, """
SELECT conv_id, turn, CASE WHEN turn % 2 <> 0 OR coalesce(text, '') = '' THEN 'image_base64 is required' WHEN NOT turn * 20 BETWEEN 1 AND 50 THEN 'top_k must be 1 to 50' END AS error
FROM conversations"""),
}
