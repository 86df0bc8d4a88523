"""The queries on composed retrieval, tiers of memory, sources and processing chains."""

from __future__ import annotations

import pandas as pd

from quire.operators import knowledge as KN
from quire.operators import process as P
from quire.operators import retrieval as R
from quire.operators import working as W
from quire.sources import documents as DOC

from .catalogue import _HITS, BLK, CAC, COS, E, NOW, SEG, STORE, WS, C, DataFrame, F, SparkSession, _blocks, _cache, _entries, _epoch, _hybrid_queries, _hybrid_sql, _segments, _t, _top, files, query, render, split
from .catalogue2 import CELLS, X, _latex_sql
from .pipeline import Pipeline


def _questions(e: DataFrame) -> DataFrame:
    """Queries of which every other one asks for the opposite of its vector, so that some find nothing near."""
    turned = F.when(F.col("id") % 200 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    return e.where("id % 100 = 0").select(F.col("id").alias("query_id"), turned.alias("query_vector"), F.col("text").alias("query_text"))


_QST = f"{E}, q AS (SELECT id, text, CASE WHEN id % 200 = 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM e WHERE id % 100 = 0)"


def _ranked(score: str, k: int, where: str = "true") -> str:
    return f"(SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (SELECT q.id AS query_id, x.id, {score} AS similarity FROM q, e x WHERE q.v IS NOT NULL AND x.v IS NOT NULL AND {where}) QUALIFY rank <= {k})"


_SHARE = f"""SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank, 'keyword' AS kind FROM (SELECT l.id AS query_id, x.id, round(greatest(0.1::DOUBLE, coalesce(len(list_filter(l.w, lambda k: contains(lower(x.text), k))) / nullif(len(l.w), 0)::DOUBLE, 0) * 0.3::DOUBLE), 6) AS similarity
 FROM (SELECT id, list_filter(regexp_split_to_array(lower(text), '{WS}+'), lambda k: k <> '') AS w FROM q WHERE id NOT IN (SELECT query_id FROM h)) l, e x WHERE x.text IS NOT NULL) QUALIFY rank <= 5"""


@query(f"WITH {_QST}, h AS (SELECT * FROM {_ranked(COS, 15)} WHERE similarity >= 0.41), i AS (SELECT query_id, id, similarity, rank, 'index' AS kind FROM h WHERE rank <= 5) SELECT * FROM i UNION ALL SELECT * FROM ({_SHARE})")
def ret_indexed(spark, d):
    e = _entries(spark, d)
    return R.indexed_retrieve(e, _questions(e), 5, 0.82)


@query(
    f"""WITH {_QST}, h AS (SELECT * FROM {_ranked(COS, 15)} WHERE similarity >= 0.41), c AS (SELECT h.query_id, h.id, CASE WHEN n.v IS NULL THEN h.similarity ELSE round(0.7::DOUBLE * h.similarity + 0.3::DOUBLE * round(greatest(0, least(1, list_cosine_similarity(x.v, n.v))), 6), 6) END AS similarity
 FROM h JOIN e x ON x.id = h.id LEFT JOIN e n ON n.id = h.query_id + 1 WHERE h.rank <= 5), i AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank, 'index' AS kind FROM c) SELECT * FROM i UNION ALL SELECT * FROM ({_SHARE})"""
)
def ret_indexed_in_context(spark, d):
    e = _entries(spark, d)
    following = e.select((F.col("id") - 1).alias("query_id"), F.col("embedding").alias("context_vector"))
    return R.indexed_retrieve(e, _questions(e).join(following, "query_id", "left"), 5, 0.82)


@query(f"WITH {_QST}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM {_ranked(STORE, 15)} WHERE similarity >= 0.5) WHERE r <= 5), f AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM (SELECT id FROM e ORDER BY id LIMIT 5)) SELECT query_id, id, similarity, r AS rank FROM h UNION ALL SELECT q.id, f.id, 0.1::DOUBLE, f.rank FROM q, f WHERE q.v IS NOT NULL AND q.id NOT IN (SELECT query_id FROM h)")
def ret_fallback(spark, d):
    e = _entries(spark, d)
    return R.fallback_retrieve(e, _questions(e), 5, 0.9)


@query(
    f"""WITH {_QST}, g AS (SELECT q.id AS query_id, x.id, greatest(CASE WHEN q.v IS NULL OR x.v IS NULL THEN 0 ELSE {COS} END, CASE WHEN len(list_filter(regexp_split_to_array(lower(q.text), '{WS}+'), lambda k: k <> '' AND contains(lower(x.text), k))) > 0 THEN 0.4::DOUBLE ELSE 0 END) AS similarity FROM q, e x WHERE x.text IS NOT NULL),
 h AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM g WHERE similarity >= 0.1 QUALIFY rank <= 5) SELECT * FROM h UNION ALL SELECT q.id, (SELECT min(id) FROM e), 0.1::DOUBLE, 1 FROM q WHERE q.id NOT IN (SELECT query_id FROM h)"""
)
def ret_fallback_single(spark, d):
    e = _entries(spark, d)
    return R.rescan(e, _questions(e), 5)


_TIERS = f"""u AS (SELECT query_id, id, similarity, 0 AS tier FROM wm UNION ALL SELECT query_id, id, score, 1 FROM lt), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY similarity DESC, tier) = 1),
 tt AS (SELECT query_id, id, similarity, tier, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM o QUALIFY rank <= 5)"""
_LONG = _hybrid_sql("", f"SELECT query_id, id, similarity FROM ({_top('e', STORE, 15, cte=E)}) WHERE similarity >= 0.2")


@query(f"WITH wm AS ({_top('e', COS, 5, 'x.id % 3 = 0', E)}), lt AS ({_LONG}), {_TIERS} SELECT query_id, id, similarity, tier, rank FROM tt")
def ret_three_tier(spark, d):
    e = _entries(spark, d)
    return R.three_tier(e.where("id % 3 = 0"), e, _hybrid_queries(e), 5, 0.4)


@query(
    f"""WITH wm AS ({_top('e', COS, 5, 'x.id % 3 = 0', E)}), lt AS ({_LONG}), {_TIERS}, ix AS (SELECT query_id, id, similarity FROM ({_top('e', COS, 5, cte=E)}) WHERE similarity >= 0.4),
 fu AS (SELECT query_id, id, similarity, 0 AS part FROM ix UNION ALL SELECT query_id, id, similarity, 1 FROM tt WHERE NOT EXISTS (SELECT 1 FROM ix WHERE ix.query_id = tt.query_id AND ix.id = tt.id)) SELECT query_id, id, similarity, part, row_number() OVER (PARTITION BY query_id ORDER BY part, similarity DESC, id) AS rank FROM fu QUALIFY rank <= 5"""
)
def ret_perform(spark, d):
    e = _entries(spark, d)
    return R.perform(e.where("id % 3 = 0"), e, _hybrid_queries(e), 5, 0.4)


@query(f"WITH {E}, h AS ({_top('e', COS, 5, cte=E)}) SELECT h.query_id, h.id, h.similarity, h.rank, q.id % 200 = 0 AND q.ts IS NOT NULL AS cached FROM h JOIN e q ON q.id = h.query_id WHERE q.text IS NOT NULL")
def ret_cached(spark, d):
    e = _entries(spark, d).where("text is not null")
    asked = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"), F.concat_ws(" ", "id", "text").alias("query_text"), "ts")
    first = R.search.top_k(_entries(spark, d), asked.where("query_id % 200 = 0 and ts is not null"), 5).groupBy("query_id").agg(F.collect_list(F.struct("id", "similarity", F.col("rank"))).alias("result"))
    cache = asked.join(first, "query_id").select(R.request_key("query_text", 5, 0.0, "flat").alias("key"), "result", F.lit(100.0).alias("ts"), F.lit(60.0).alias("ttl_s"))
    answers, _ = R.get_or_compute(cache, asked, lambda lost: R.search.top_k(_entries(spark, d), lost, 5), 150.0, 60.0, 5, 0.0, "flat")
    return answers


# Tiers of memory -------------------------------------------------------------------
def _work_log(spark: SparkSession, d: str) -> DataFrame:
    """The event log as a log of working memories, one for each of seven owners."""
    e = _t(spark, d, "events")
    op = F.element_at(F.array(*[F.lit(x) for x in ("add", "add", "get", "add", "update", "get", "remove")]), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(F.col("event_id").alias("log_no"), F.concat(F.lit("i"), F.col("event_id") * 31 % 97).alias("id"), op.alias("op"), (F.col("value") % 1).alias("priority"), _epoch("ts").alias("ts"), (F.col("user_id") % 7).alias("owner"))


@query()
def wm_fold(spark, d):
    return W.fold(_work_log(spark, d), 20, "owner").withColumn("priority", F.round("priority", 6))


@query()
def wm_held(spark, d):
    kept = W.held(W.fold(_work_log(spark, d), 20, "owner"))
    return W.maintain(kept, NOW).select("owner", "id", F.round("priority", 6).alias("priority"), "access_count")


@query("SELECT 'i' || (event_id * 31 % 97) AS id, event_id AS log_no FROM events WHERE event_id * 31 % 97 < 3 ORDER BY event_id LIMIT 25")
def wm_by_filter(spark, d):
    return W.by_filter(_work_log(spark, d), "id in ('i0', 'i1', 'i2')", 25, "log_no").select("id", "log_no")


@query(
    f"""WITH {SEG}, m AS (SELECT text, coalesce(metadata['source'], 'unknown') AS source, length(regexp_replace(text, '[\\p{{L}}\\s]', '', 'g')) / greatest(length(text), 1)::DOUBLE AS dense FROM s WHERE length(trim(text, ' ')) > 0),
 o AS (SELECT DISTINCT sha256(concat_ws(chr(31), source, text)) AS id, source, 0.5::DOUBLE + CASE WHEN length(text) > 1000 THEN 0.2::DOUBLE WHEN length(text) < 50 THEN -0.1::DOUBLE ELSE 0 END + CASE WHEN dense > 0.2 THEN 0.1::DOUBLE ELSE 0 END AS content,
 0.5::DOUBLE + CASE source WHEN 'expert_input' THEN 0.3::DOUBLE WHEN 'user_input' THEN 0.1::DOUBLE WHEN 'generated' THEN -0.1::DOUBLE ELSE 0 END AS ext FROM m) SELECT id, source, round(greatest(0.1, least(1, content * 0.3::DOUBLE + 0.2::DOUBLE + ext * 0.3::DOUBLE)), 6) AS priority FROM o"""
)
def know_added(spark, d):
    entries, working, _ = KN.added(_segments(spark, d).select("text", F.coalesce(F.col("metadata")["source"], F.lit("unknown")).alias("source")), NOW)
    return entries.join(working, "id").select("id", F.col("metadata")["source"].alias("source"), "priority")


@query(f"WITH {SEG} SELECT id FROM s WHERE seg_no % 5 <> 0 OR seg_no IS NULL")
def know_removed(spark, d):
    s = _segments(spark, d)
    return KN.removed(s, s.where("seg_no % 5 = 0")).select("id")


@query(f"WITH {SEG}, r AS (SELECT id, importance * (least(access_count, 10) * 0.2::DOUBLE + 1) AS strength, ({NOW} - ts) / 86400 AS days FROM s) SELECT id FROM r WHERE CASE WHEN strength > 0 THEN exp(-days * 0.1::DOUBLE / strength) ELSE 0 END >= 0.3")
def know_forgetting(spark, d):
    return KN.clean_up(_segments(spark, d), "forgetting_curve", 400, NOW).select("id")


@query(f"WITH {SEG} SELECT id, round(CASE WHEN seg_no % 5 = 0 THEN greatest(importance * 0.3::DOUBLE, 0.1) ELSE importance END, 6) AS importance, coalesce(seg_no % 5 = 0, false) AS forgotten FROM s")
def know_forgotten(spark, d):
    s = _segments(spark, d)
    return KN.forget(s, s.where("seg_no % 5 = 0")).select("id", F.round("importance", 6).alias("importance"), "forgotten")


@query(
    f"""WITH {SEG}, {_HITS}, x AS (SELECT id, arg_max(op, seq) AS op FROM vectors WHERE id IS NOT NULL GROUP BY id), n AS (SELECT count(*)::DOUBLE AS a, count(*) FILTER (WHERE access_count > 0)::DOUBLE AS w FROM s),
 tier AS (SELECT 'short_term' AS part, 100::DOUBLE AS cap, least(a, 100) AS used FROM n UNION ALL SELECT 'working', 500, least(w, 500) FROM n UNION ALL SELECT 'long_term', 10000, least(a, 10000) FROM n),
 gg AS (SELECT count(*)::DOUBLE AS q, count(*) FILTER (WHERE kind = 'exact')::DOUBLE AS e, count(*) FILTER (WHERE kind = 'expired')::DOUBLE AS x, count(*) FILTER (WHERE kind = 'miss')::DOUBLE AS m FROM k)
 SELECT part, 'capacity' AS name, cap AS value FROM tier UNION ALL SELECT part, 'used', used FROM tier UNION ALL SELECT part, 'usage_percent', round(used / cap * 100, 4) FROM tier
 UNION ALL SELECT 'index', 'live', count(*) FILTER (WHERE op IS DISTINCT FROM 'delete')::DOUBLE FROM x UNION ALL SELECT 'index', 'total', count(*)::DOUBLE FROM x UNION ALL SELECT 'index', 'deleted', count(*) FILTER (WHERE op = 'delete')::DOUBLE FROM x
 UNION ALL SELECT 'cache', 'queries', q FROM gg UNION ALL SELECT 'cache', 'hits', e FROM gg UNION ALL SELECT 'cache', 'exact_ratio', round(e / greatest(q, 1), 6) FROM gg UNION ALL SELECT 'cache', 'expired_ratio', round(x / greatest(q, 1), 6) FROM gg UNION ALL SELECT 'cache', 'miss_ratio', round(m / greatest(q, 1), 6) FROM gg"""
)
def sys_status(spark, d):
    s = _segments(spark, d)
    return KN.system_status(s, s.where("access_count > 0"), s, _t(spark, d, "vectors"), C.ttl_hits(_cache(spark, d)))


# Cache -----------------------------------------------------------------------------
_HELD = f"{CAC}, lk AS (SELECT key, arg_max(op, struct_pack(a := ts, b := log_no)) AS op FROM c WHERE op IN ('put', 'evict') AND key IS NOT NULL AND ts IS NOT NULL GROUP BY key)"


@query(f"WITH {_HELD}, n AS (SELECT least(count(*), 1000) AS n FROM lk WHERE op = 'put') SELECT n AS size, 1000 AS capacity, round(n / 1000::DOUBLE, 6) AS usage FROM n")
def cache_usage(spark, d):
    return C.usage(_cache(spark, d), 1000)


@query(f"WITH {_HELD} SELECT DISTINCT c.key, coalesce(lk.op = 'put', false) AS held FROM c LEFT JOIN lk ON lk.key = c.key WHERE c.key IS NOT NULL")
def cache_members(spark, d):
    log = _cache(spark, d)
    return C.members(log, log.where("key is not null"))


@query()
def cache_owner_fold(spark, d):
    log = _cache(spark, d).withColumn("owner", F.length("key") % 5)
    return C.fold(log, 20, owner="owner")


# Blocks ----------------------------------------------------------------------------
_BOX = "SELECT DISTINCT doc_id, page, block_id, type, extraction_method, coordinates, coordinates[1] AS x0, coordinates[2] AS y0, coordinates[3] AS x1, coordinates[4] AS y1, coalesce(confidence >= 0.6, false) AS valid FROM b"


def _meets(a: str, b: str) -> str:
    """Whether two boxes of a page share half of the smaller area."""
    size = lambda t: f"(({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0))"
    whole = " AND ".join(f"len({t}.coordinates) = 4 AND {t}.page IS NOT NULL AND {t}.x1 > {t}.x0 AND {t}.y1 > {t}.y0" for t in (a, b))
    return f"{whole} AND {a}.doc_id = {b}.doc_id AND {a}.page = {b}.page AND {a}.x0 < {b}.x1 AND {b}.x0 < {a}.x1 AND {a}.y0 < {b}.y1 AND {b}.y0 < {a}.y1 AND ((least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * (least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))) / least({size(a)}, {size(b)}) >= 0.5"


@query(f"WITH {BLK}, r AS ({_BOX}) SELECT block_id FROM r t WHERE type = 'text' AND NOT EXISTS (SELECT 1 FROM r o WHERE o.type = 'image' AND {_meets('t', 'o')})")
def blk_no_overlap(spark, d):
    b = _blocks(spark, d)
    return DOC.without_overlaps(b.where("type = 'text'"), b.where("type = 'image'")).select("block_id")


def _found_images(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as images found in three ways; what is confident could be read."""
    return _blocks(spark, d).select("block_id", "doc_id", "page", "coordinates", F.when(F.col("type") == "text", F.col("extraction_method")).when(F.col("type") == "image", "direct").when(F.col("type") == "table", "region").otherwise("structure").alias("extraction_method"), F.coalesce(F.col("confidence") >= 0.6, F.lit(False)).alias("valid"))


@query(
    f"""WITH {BLK}, r AS (SELECT * REPLACE (CASE type WHEN 'text' THEN extraction_method WHEN 'image' THEN 'direct' WHEN 'table' THEN 'region' ELSE 'structure' END AS extraction_method) FROM ({_BOX})), di AS (SELECT * FROM r WHERE valid AND extraction_method = 'direct'),
 po AS (SELECT doc_id, page FROM r WHERE extraction_method = 'direct' GROUP BY doc_id, page HAVING count(*) FILTER (WHERE valid) < count(*) * 0.5),
 rg AS (SELECT * FROM r t WHERE valid AND extraction_method = 'region' AND EXISTS (SELECT 1 FROM po WHERE po.doc_id = t.doc_id AND po.page = t.page) AND NOT EXISTS (SELECT 1 FROM di o WHERE {_meets('t', 'o')})),
 kp AS (SELECT * FROM di UNION ALL SELECT * FROM rg), st AS (SELECT * FROM r t WHERE valid AND extraction_method = 'structure' AND len(coordinates) = 4 AND x1 - x0 >= 100 AND y1 - y0 >= 100 AND NOT EXISTS (SELECT 1 FROM kp o WHERE {_meets('t', 'o')}))
 SELECT block_id, extraction_method FROM kp UNION ALL SELECT block_id, extraction_method FROM st"""
)
def blk_images(spark, d):
    return DOC.image_blocks(_found_images(spark, d)).select("block_id", "extraction_method")


@query(
    f"""WITH {BLK}, r AS (SELECT DISTINCT doc_id, block_id, type, confidence FROM b), f AS (SELECT doc_id, coalesce(string_agg(type, ' ' ORDER BY block_id) FILTER (WHERE confidence >= 0.6), '') AS text, coalesce(round(avg(confidence) FILTER (WHERE confidence >= 0.6), 9), 0) AS confidence FROM r GROUP BY doc_id) SELECT * FROM f"""
)
def ocr_plain(spark, d):
    return DOC.reading_text(_blocks(spark, d).select("doc_id", F.col("block_id").alias("seq"), F.col("type").alias("text"), "confidence"), "doc_id")


# Chains ----------------------------------------------------------------------------
@query(f"WITH {BLK} SELECT block_id, trim(regexp_replace(content, '{WS}+', ' ', 'g'), ' ') AS content, true AS processed FROM b WHERE type = 'text' AND content IS NOT NULL UNION ALL SELECT block_id, content, false FROM b WHERE type = 'text' AND content IS NULL")
def proc_text(spark, d):
    return P.process(_blocks(spark, d)).where("type = 'text'").select("block_id", "content", "processed")


@query(
    f"""{CELLS}, fd AS (SELECT block_id, r, c, CASE WHEN r = 0 THEN value ELSE coalesce(last_value(CASE WHEN r > 0 AND trim(value, ' ') <> '' THEN value END IGNORE NULLS) OVER (PARTITION BY block_id, c ORDER BY r), value) END AS value FROM pd),
 ln AS (SELECT block_id, r, '| ' || string_agg(value, ' | ' ORDER BY c) || ' |' AS line, '| ' || string_agg('---', ' | ' ORDER BY c) || ' |' AS bar FROM fd GROUP BY block_id, r), md AS (SELECT block_id, string_agg(CASE WHEN r = 0 THEN line || chr(10) || bar ELSE line END, chr(10) ORDER BY r) AS text FROM ln GROUP BY block_id),
 ok AS (SELECT block_id FROM t WHERE len(list_filter(rows, lambda x: len(list_filter(x, lambda y: trim(coalesce(y, ''), ' ') <> '')) > 0)) > 0)
 SELECT b.block_id, CASE WHEN ok.block_id IS NOT NULL THEN md.text ELSE b.markdown END AS markdown, ok.block_id IS NOT NULL AS processed FROM b LEFT JOIN ok ON ok.block_id = b.block_id LEFT JOIN md ON md.block_id = b.block_id WHERE b.type = 'table'"""
)
def proc_table(spark, d):
    return P.process(_blocks(spark, d)).where("type = 'table'").select("block_id", "markdown", "processed")


_LATEX = " OR ".join(f"contains(t, '{c}')" for c in X.COMMANDS)


@query(
    f"""WITH {BLK}, f AS (SELECT block_id, coalesce(formula_text, content, '') AS formula_text FROM b WHERE type = 'formula'), g AS (SELECT *, trim(formula_text, ' ' || chr(9) || chr(10) || chr(13)) AS r FROM f),
 s AS (SELECT *, CASE WHEN r LIKE '$$%$$' AND length(r) >= 4 THEN r[3:-3] WHEN r LIKE '$%$' AND length(r) >= 2 THEN r[2:-2] WHEN starts_with(r, '\\begin{{equation}}') AND suffix(r, '\\end{{equation}}') THEN r[17:-15] ELSE r END AS t FROM g),
 l AS (SELECT *, CASE WHEN {_LATEX} THEN t ELSE {_latex_sql('t')} END AS o FROM s), c AS (SELECT *, CASE WHEN o LIKE '$$%$$' AND length(o) >= 4 THEN o[3:-3] WHEN o LIKE '$%$' AND length(o) >= 2 THEN o[2:-2] ELSE o END AS q FROM l)
 SELECT block_id, formula_text, CASE WHEN NOT contains(t, chr(10)) AND length(t) < 50 THEN '$' || q || '$' ELSE '$$' || q || '$$' END AS latex, true AS processed FROM c"""
)
def proc_formula(spark, d):
    return P.process(P.extract(_blocks(spark, d))).where("type = 'formula'").select("block_id", "formula_text", "latex", "processed")


@query(f"WITH {BLK} SELECT type, count(*) AS n, count(*) FILTER (WHERE type = 'table' AND table_data IS NULL) AS n_grids, sum(CASE WHEN type = 'formula' THEN length(coalesce(formula_text, content, '')) ELSE 0 END)::BIGINT AS n_formula FROM b WHERE type IN ('text', 'image', 'table', 'formula') GROUP BY type")
def proc_extract(spark, d):
    b = _blocks(spark, d)
    had = b.where("type = 'table' and table_data is null").select("block_id", F.lit(1).alias("was_null"))
    rows = P.extract(b).where("extracted").join(had, "block_id", "left")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.count("was_null").alias("n_grids"), F.sum(F.when(F.col("type") == "formula", F.length("formula_text")).otherwise(0)).alias("n_formula"))


@query(
    f"""WITH {BLK}, x AS (SELECT block_id, string_split(content, chr(10)) AS ls FROM b WHERE content IS NOT NULL), l AS (SELECT block_id, generate_subscripts(ls, 1) AS p, regexp_replace(unnest(ls), '^{WS}+|{WS}+$', '', 'g') AS line FROM x),
 k AS (SELECT block_id, f, count(*) FILTER (WHERE regexp_matches(line, CASE f WHEN 0 THEN '{split.CHAPTERS[0]}' WHEN 1 THEN '{split.CHAPTERS[1]}' ELSE '{split.CHAPTERS[2]}' END)) AS n FROM l, range(0, 3) g(f) GROUP BY block_id, f), u AS (SELECT block_id, min(f) AS f FROM k WHERE n >= 2 GROUP BY block_id),
 s AS (SELECT l.block_id, p, line, sum(CASE WHEN regexp_matches(line, CASE f WHEN 0 THEN '{split.CHAPTERS[0]}' WHEN 1 THEN '{split.CHAPTERS[1]}' ELSE '{split.CHAPTERS[2]}' END) THEN 1 ELSE 0 END) OVER (PARTITION BY l.block_id ORDER BY p) AS seg FROM l JOIN u ON u.block_id = l.block_id)
 SELECT block_id, (seg - 1)::INT AS seg_no, string_agg(line, chr(10) ORDER BY p) AS text FROM s WHERE seg > 0 GROUP BY block_id, seg"""
)
def split_chapters(spark, d):
    return split.split_chapters(_blocks(spark, d), "block_id", "content")


@query()
def note_page(spark, d):
    return render.render(_blocks(spark, d).where("type = 'text' and extraction_method = 'structure'"), "block_id", "content", "page")


@query()
def pipe_notes(spark, d):
    """Every document through the whole pipeline, with the stand-in vectors."""
    vectors = files.hashed_vectors(32)
    pipe = Pipeline(lambda texts: [v if v is not None else [0.0] * 32 for v in vectors(pd.Series(texts))], 32, now=NOW)
    notes = _t(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("note"), "text")
    return pipe.generate(notes, ["markdown"])["markdown"]
