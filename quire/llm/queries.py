"""The pN_ queries over the tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, leakage, lookalike, markup, neardup, neighbours, packing, scans, sentences, splitting

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1 ---------------------------------------------------------------------------
def _labelled(spark: SparkSession, d: str) -> DataFrame:
    blocks = _table(spark, d, "blocks").where("type = 'text' and extraction_method = 'direct'").select(F.concat(F.lit("b"), "block_id").alias("item"), F.col("content").alias("text"), F.col("lang").alias("label"))
    hits = _table(spark, d, "retrieved").select(F.concat(F.lit("r"), "id").alias("item"), F.col("content").alias("text"), F.col("metadata")["lang"].alias("label"))
    return blocks.unionAll(hits)


def _languages(spark: SparkSession, d: str) -> DataFrame:
    items = _labelled(spark, d)
    sure = language.labelled_sample(_table(spark, d, "documents"), "doc_id", "text", "lang")
    net = language.fit_twice(sure, language.labelled_sample(items, "item", "text", "label", language.SAMPLE_ITEMS))
    found = language.identify(items, "item", "text", "label", net)
    src = F.when(F.col("item").startswith("b"), "blocks").otherwise("retrieved")
    return found.withColumn("src", src).withColumn("item_id", F.expr("substring(item, 2)")).drop("item")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = _languages(spark, d)
    case = (F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.col("langs")[0])
    return found.where(case).select("src", "item_id", F.explode("langs").alias("lang_code")).distinct()


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    found = _languages(spark, d).dropDuplicates(["src", "item_id"])
    return found.select("src", "item_id", F.explode("segments").alias("s")).select("src", "item_id", "s.start", "s.end", "s.lang", F.round("s.confidence", 6).alias("confidence"))


# 2 ---------------------------------------------------------------------------
def _scans(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "blocks").where("type = 'text' and extraction_method = 'region'")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    noise = scans.page_noise(_scans(spark, d), "block_id", "doc_id", "page", "content")
    kinds = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("hyphen", "char", "header", "pageno")]))
    return noise.select("block_id", F.explode(kinds).alias("noise")).distinct()


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_pages(_scans(spark, d), "block_id", "doc_id", "page", "content")


# 3 ---------------------------------------------------------------------------
def _records(spark: SparkSession, d: str) -> DataFrame:
    segments = _table(spark, d, "segments").select(F.lit("segments").alias("src"), "id", "text")
    hits = _table(spark, d, "retrieved").select(F.lit("retrieved").alias("src"), "id", F.col("content").alias("text"))
    return segments.unionAll(hits)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(_records(spark, d), "id", "text", "src", n=3, threshold=0.6)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(_records(spark, d), "id", "text", "src", n=3, threshold=0.6)


# 4 ---------------------------------------------------------------------------
def _pieces(spark: SparkSession, d: str) -> DataFrame:
    blocks = _table(spark, d, "blocks").select(F.struct(F.lit("blocks").alias("src"), F.col("block_id").alias("item_id")).alias("item"), F.col("content").alias("text"))
    hits = _table(spark, d, "retrieved").select(F.struct(F.lit("retrieved").alias("src"), F.col("id").alias("item_id")).alias("item"), F.col("content").alias("text"))
    both = blocks.unionAll(hits).withColumn("item", F.to_json("item"))
    out = splitting.split_items(both, "item", "text")
    key = F.from_json("item", "src string, item_id string")
    return out.select(key.alias("key"), "piece_no", "start", "end", "piece", "runs", "has_run").select("key.src", "key.item_id", "piece_no", "start", "end", "piece", "runs", "has_run")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    runs = F.when(F.col("has_run"), F.col("runs")).when(F.col("piece_no") == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return _pieces(spark, d).select("src", "item_id", F.explode(runs).alias("run_start")).distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).drop("runs", "has_run").dropDuplicates(["src", "item_id", "piece_no"])


# 5 ---------------------------------------------------------------------------
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    blocks = _table(spark, d, "blocks").where("type = 'text' and extraction_method = 'direct'")
    return sentences.split_sentences(blocks, "block_id", "content").select("block_id", "sent_end").distinct()


# 6 ---------------------------------------------------------------------------
def _marked(spark: SparkSession, d: str) -> DataFrame:
    blocks = _table(spark, d, "blocks")
    text = blocks.where("type = 'text' and extraction_method in ('direct', 'structure')").select(F.concat(F.lit("c"), "block_id").alias("item"), F.col("content").alias("text"), F.lit(False).alias("is_table"), "source")
    table = blocks.where("type = 'table'").select(F.concat(F.lit("m"), "block_id").alias("item"), F.col("markdown").alias("text"), F.lit(True).alias("is_table"), "source")
    return text.unionAll(table)


def _field() -> Column:
    return F.when(F.col("item").startswith("c"), "content").otherwise("markdown")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = markup.clean_markup(_marked(spark, d), "item", "text", "is_table", units=False)
    return found.where(F.size("kinds") > 0).select(F.expr("substring(item, 2)").alias("block_id"), _field().alias("field"), F.explode("kinds").alias("markup")).distinct()


def p6_units(spark: SparkSession, d: str) -> DataFrame:
    found = markup.clean_markup(_marked(spark, d), "item", "text", "is_table").dropDuplicates(["item"])
    return found.select(F.expr("substring(item, 2)").alias("block_id"), _field().alias("field"), F.posexplode("units").alias("unit_no", "unit")).select("block_id", "field", "unit_no", "unit.role", "unit.text")


def p6_unique_runs(spark: SparkSession, d: str) -> DataFrame:
    items = _marked(spark, d)
    clean = markup.clean_markup(items, "item", "text", "is_table").dropDuplicates(["item"])
    lines = clean.select("item", F.array_join(F.transform("units", lambda u: u["text"]), "\n").alias("text"))
    hosts = items.select("item", "source").dropDuplicates(["item"])
    runs = markup.boilerplate(lines.join(hosts, "item"), "source", "item", "text")
    return runs.select(F.expr("substring(item, 2)").alias("block_id"), _field().alias("field"), "text", "removed")


# 7 ---------------------------------------------------------------------------
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_neighbours(spark, d).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.most_similar(_table(spark, d, "vectors"), "id", "seq", "op", "embedding")


# 8 ---------------------------------------------------------------------------
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"), "doc_id", "text").where("piece_no > 0").select("doc_id").distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"), "doc_id", "text")


# 9 ---------------------------------------------------------------------------
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "heldout_items"), "item_id", "text")


# 10 --------------------------------------------------------------------------
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_pairs(_table(spark, d, "documents"), "doc_id", "text").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p10_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_groups(_table(spark, d, "documents"), "doc_id", "text")


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical(_table(spark, d, "documents"), "doc_id", "text").select("doc_id", "form")


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


_SIMILAR = r"""
WITH r AS (SELECT 'segments' AS src, id, text FROM segments UNION SELECT 'retrieved', id, content FROM retrieved),
t AS (SELECT src, id, text, regexp_extract_all(regexp_replace(lower(nfc_normalize(text)), '([\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS w FROM r WHERE text <> '' AND id IS NOT NULL),
g AS (SELECT src, id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS gram FROM t WHERE len(w) > 0),
n AS (SELECT src, id, count(*) AS n FROM g GROUP BY src, id),
j AS (SELECT a.src, a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.src = b.src AND a.gram = b.gram AND a.id < b.id GROUP BY 1, 2, 3)
SELECT j.src, id_a, id_b FROM j JOIN n x ON x.src = j.src AND x.id = id_a JOIN n y ON y.src = j.src AND y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c)
UNION SELECT a.src, a.id, b.id FROM t a JOIN t b ON a.src = b.src AND a.text = b.text AND a.id < b.id
"""

_RUNS = """
WITH i AS (SELECT DISTINCT 'blocks' AS src, block_id AS item_id, content AS c FROM blocks WHERE length(content) > 500 UNION SELECT DISTINCT 'retrieved', id, content FROM retrieved WHERE length(content) > 500),
p AS (SELECT src, item_id, unnest(string_split_regex(c, '[ \\t\\n\\r\\x{3000}.!?;:,\\x{3002}\\x{FF01}\\x{FF1F}\\x{FF1B}\\x{FF1A}\\x{FF0C}\\x{3001}\\x{2026}]')) AS part,
 generate_subscripts(string_split_regex(c, '[ \\t\\n\\r\\x{3000}.!?;:,\\x{3002}\\x{FF01}\\x{FF1F}\\x{FF1B}\\x{FF1A}\\x{FF0C}\\x{3001}\\x{2026}]'), 1) AS k FROM i),
o AS (SELECT src, item_id, part, sum(length(part) + 1) OVER (PARTITION BY src, item_id ORDER BY k) - length(part) - 1 AS run_start FROM p),
l AS (SELECT src, item_id, run_start::BIGINT AS run_start FROM o WHERE length(part) > 500)
SELECT * FROM l UNION ALL SELECT src, item_id, -1 FROM i WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.src = i.src AND l.item_id = i.item_id)
"""

_NEAREST = """
WITH v AS (SELECT id, embedding::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM vectors) WHERE r = 1 AND op = 'add' AND len(embedding) = 384
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
h AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS r FROM v a JOIN v b ON a.id <> b.id)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM h WHERE r <= 5
"""


def oracle_sql() -> dict[str, str]:
    """Only for what DuckDB can say on whole tables; the rest is tested against brute force."""
    return {
        "p3_found": _SIMILAR,
        "p4_found": _RUNS,
        "p7_found": _NEAREST,
        "p8_found": "SELECT DISTINCT doc_id FROM documents WHERE octet_length(encode(text)) + 1 > 2048",
    }
