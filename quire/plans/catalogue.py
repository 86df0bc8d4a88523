"""The engine's queries over the tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import formulas as X
from quire.functions import tables as B
from quire.functions import text as T
from quire.functions import vector as V
from quire.operators import blocks as K
from quire.operators import cache as C
from quire.operators import graph, render, split, warnings
from quire.operators import lifecycle as L
from quire.operators import memory as M
from quire.operators import search as S
from quire.sources import files

#: The moment that ages are counted to, as epoch seconds.
NOW = 1767225600.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _epoch(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(df: DataFrame, *more: str) -> DataFrame:
    """Queries: the rows whose id is divisible by 100."""
    return df.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"), *more)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """All documents, with a vector where there is one of their number."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang", _epoch("added_ts").alias("ts"))
    return docs.join(_vectors(spark, d), "id", "left")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "segments")
    rest = [c for c in rows.columns if c not in ("id", "loaded_ts")]
    last = rows.groupBy("id").agg(F.max_by(F.struct(*rest), "loaded_ts").alias("s"))
    out = last.select("id", *[F.col(f"s.{c}").alias(c) for c in rest])
    ts = F.coalesce(L.number("metadata", "timestamp"), F.lit(NOW))
    return out.select("id", "text", "doc_id", "seg_no", "metadata", "added_ts", ts.alias("ts"), F.coalesce(L.number("metadata", "access_count"), F.lit(0.0)).alias("access_count"), F.coalesce(L.number("metadata", "importance"), F.lit(0.5)).alias("importance"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each block as it was last delivered."""
    rows = _t(spark, d, "blocks")
    rest = [c for c in rows.columns if c not in ("block_id", "loaded_ts")]
    last = rows.groupBy("block_id").agg(F.max_by(F.struct(*rest), "loaded_ts").alias("s"))
    return last.select("block_id", *[F.col(f"s.{c}").alias(c) for c in rest])


def _cache(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "cache_log").select("log_no", F.col("query_text").alias("key"), F.lower(F.trim("op")).alias("op"), "ttl_s", _epoch("logged_ts").alias("ts"), "loaded_ts")
    last = rows.groupBy("log_no").agg(F.max_by(F.struct("key", "op", "ttl_s", "ts"), "loaded_ts").alias("s"))
    return last.select("log_no", "s.*")


WS = T.SPACE
E = "e AS (SELECT d.doc_id AS id, d.text, d.source, d.lang, epoch(d.added_ts) AS ts, v.embedding::DOUBLE[] AS v, v.label FROM documents d LEFT JOIN embeddings v ON d.doc_id = v.vec_id)"
N = "n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
COS = "round(greatest(0, least(1, list_cosine_similarity(q.v, x.v))), 6)"
STORE = "round(1 - greatest(0, least(1, list_distance(q.v, x.v) * list_distance(q.v, x.v))), 6)"
SEG = f"""s AS (SELECT id, arg_max(text, loaded_ts) AS text, arg_max(doc_id, loaded_ts) AS doc_id, arg_max(seg_no, loaded_ts) AS seg_no, arg_max(metadata, loaded_ts) AS metadata,
 arg_max(added_ts, loaded_ts) AS added_ts, coalesce(try_cast(arg_max(metadata, loaded_ts)['timestamp'] AS DOUBLE), {NOW}) AS ts,
 coalesce(try_cast(arg_max(metadata, loaded_ts)['access_count'] AS DOUBLE), 0::DOUBLE) AS access_count, coalesce(try_cast(arg_max(metadata, loaded_ts)['importance'] AS DOUBLE), 0.5::DOUBLE) AS importance FROM segments GROUP BY id)"""
BLK = "b AS (SELECT DISTINCT ON (block_id) * FROM blocks ORDER BY block_id, loaded_ts DESC)"
CAC = "c AS (SELECT DISTINCT ON (log_no) log_no, query_text AS key, lower(trim(op)) AS op, ttl_s, epoch(logged_ts) AS ts FROM cache_log ORDER BY log_no, loaded_ts DESC)"


def _top(frm: str, score: str, k: int, where: str = "true", cte: str | None = None) -> str:
    return f"WITH {cte or N}, h AS (SELECT q.id AS query_id, x.id AS id, {score} AS similarity FROM {frm} q, {frm} x WHERE q.id % 100 = 0 AND q.v IS NOT NULL AND x.v IS NOT NULL AND {where}) SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM h) WHERE rank <= {k}"


# Vector index ------------------------------------------------------------------
@query(_top("n", COS, 5))
def vec_flat_topk(spark, d):
    v = _vectors(spark, d)
    return S.top_k(v, _asked(v), 5)


@query(_top("n", COS, 12))
def vec_batch_topk(spark, d):
    v = _vectors(spark, d)
    return S.top_k(v, _asked(v), 12)


@query(f"SELECT query_id, id, similarity, rank FROM ({_top('n', COS, 10)}) WHERE similarity >= 0.25 AND rank <= 5")
def vec_threshold_retrieve(spark, d):
    v = _vectors(spark, d)
    return S.top_k(v, _asked(v), 10).where("similarity >= 0.25 and rank <= 5")


@query("SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_cosine_unclamped(spark, d):
    v = _vectors(spark, d)
    following = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next"))
    return v.join(following, "id").select("id", F.round(V.raw_cosine("embedding", "next"), 6).alias("similarity"))


@query(_top("n", STORE, 5))
def vec_squared_l2_similarity(spark, d):
    v = _vectors(spark, d)
    return S.top_k(v, _asked(v), 5, metric="sqeuclidean")


@query("SELECT id, max(seq) AS seq, arg_max(op, seq) AS op, coalesce(arg_max(coalesce(len(embedding), -1), seq), -1)::INT AS dim FROM vectors WHERE id IS NOT NULL GROUP BY id")
def vec_upsert_latest(spark, d):
    log = _t(spark, d, "vectors").select("id", "seq", "op", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim"))
    return S.latest_state(log).select("id", "seq", "op", "dim")


@query(
    """WITH l AS (SELECT id, embedding::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM vectors) WHERE r = 1 AND op = 'add' AND len(embedding) = 384
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 h AS (SELECT q.id AS query_id, x.id, round(greatest(0, least(1, list_cosine_similarity(q.v, x.v))), 6) AS similarity FROM l q, l x WHERE try_cast(substr(q.id, 2) AS BIGINT) % 100 = 0)
 SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM h) WHERE rank <= 5"""
)
def vec_tombstone_topk(spark, d):
    v = S.live(_t(spark, d, "vectors"), 384)
    asked = v.where("try_cast(substring(id, 2) as bigint) % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return S.top_k(v, asked, 5)


@query("WITH l AS (SELECT id, arg_max(op, seq) AS op FROM vectors WHERE id IS NOT NULL GROUP BY id) SELECT count(*) FILTER (WHERE op IS DISTINCT FROM 'delete') AS live, count(*) AS total, count(*) FILTER (WHERE op = 'delete') AS deleted FROM l")
def vec_index_stats(spark, d):
    return S.index_stats(_t(spark, d, "vectors"))


def _label_means(v: DataFrame) -> DataFrame:
    return S.mean_vectors(v, "label")


_MEANS = f"{N}, m AS (SELECT label AS cell, i, round(avg(v[i]), 9) AS x FROM n, range(1, 65) r(i) GROUP BY label, i), c AS (SELECT cell, list(x ORDER BY i) AS v FROM m GROUP BY cell)"


@query(f"WITH {_MEANS} SELECT n.id, arg_min(c.cell, struct_pack(d := round(list_distance(n.v, c.v) * list_distance(n.v, c.v), 9), c := c.cell)) AS cell FROM n, c GROUP BY n.id")
def vec_ivf_assign(spark, d):
    v = _vectors(spark, d)
    return S.assign_cells(v, _label_means(v)).select("id", "cell")


@query(
    f"""WITH {_MEANS}, a AS (SELECT n.id, n.v, arg_min(c.cell, struct_pack(d := round(list_distance(n.v, c.v) * list_distance(n.v, c.v), 9), c := c.cell)) AS cell FROM n, c GROUP BY n.id, n.v),
 p AS (SELECT id, v, cell FROM (SELECT n.id, n.v, c.cell, row_number() OVER (PARTITION BY n.id ORDER BY round(list_distance(n.v, c.v) * list_distance(n.v, c.v), 9), c.cell) AS r FROM n, c WHERE n.id % 100 = 0) WHERE r <= 3),
 h AS (SELECT q.id AS query_id, x.id, {COS} AS similarity FROM p q JOIN a x ON q.cell = x.cell)
 SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM h) WHERE rank <= 5"""
)
def vec_ivf_search(spark, d):
    v = _vectors(spark, d)
    cells = _label_means(v)
    return S.probe_search(S.assign_cells(v, cells), cells, _asked(v), 5, probes=3)


@query()
def vec_ivf_kmeans(spark, d):
    v = _vectors(spark, d)
    return S.assign_cells(v, S.fit_cells(v, 16)).groupBy("cell").agg(F.count("*").alias("n"))


# Memory ------------------------------------------------------------------------
@query(f"SELECT * FROM ({_top('e', STORE, 5, cte=E)}) WHERE similarity >= 0.2")
def mem_simple(spark, d):
    e = _entries(spark, d)
    return M.simple(e, _asked(e), 5, 0.2)


@query(
    f"""WITH {E}, h AS ({_top('e', STORE, 15, cte=E)}), g AS (SELECT h.query_id, h.id, h.similarity, round(exp(-0.01 * ({NOW} - coalesce(e.ts, {NOW})) / 86400), 6) AS score FROM h JOIN e ON h.id = e.id)
 SELECT query_id, id, similarity, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g) WHERE rank <= 5"""
)
def mem_time_weighted(spark, d):
    e = _entries(spark, d)
    return M.time_weighted(e, _asked(e), NOW, 5).select("query_id", "id", "similarity", "score", "rank")


def _with_context(e: DataFrame) -> DataFrame:
    following = e.select((F.col("id") - 1).alias("query_id"), F.col("embedding").alias("context_vector"))
    return _asked(e).join(following, "query_id").select("query_id", V.mean_vector("query_vector", "context_vector").alias("query_vector"))


_CTX = f"{E}, q AS (SELECT a.id, list_transform(range(1, 65), lambda i: (a.v[i] + b.v[i]) / 2) AS v FROM e a JOIN e b ON b.id = a.id + 1 WHERE a.id % 100 = 0 AND a.v IS NOT NULL AND b.v IS NOT NULL)"


@query(f"WITH {_CTX}, h AS (SELECT q.id AS query_id, x.id, {STORE} AS similarity FROM q, e x WHERE x.v IS NOT NULL) SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM h) WHERE rank <= 5 AND similarity >= 0.1")
def mem_context_aware(spark, d):
    e = _entries(spark, d)
    return M.simple(e, _with_context(e), 5, 0.1)


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _kw(frm: str, key: str, text: str, n: int) -> str:
    """Keywords: (key, word, r) with r up to n."""
    return f"""(SELECT k, word, r FROM (SELECT k, word, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, min(pos)) AS r FROM
 (SELECT {key} AS k, unnest(regexp_split_to_array(lower({text}), '{WS}+')) AS word, generate_subscripts(regexp_split_to_array(lower({text}), '{WS}+'), 1) AS pos FROM {frm})
 WHERE length(word) > 1 AND word NOT IN ({_STOP}) GROUP BY k, word) WHERE r <= {n})"""


def _hybrid_queries(e: DataFrame) -> DataFrame:
    asked = e.where("id % 100 = 0")
    words = M.keywords(asked, "id", "text", 5)
    return asked.join(words, "id", "left").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def _hybrid_sql(extra: str, hits: str) -> str:
    return f"""WITH {E}{extra}, w AS {_kw("(SELECT * FROM e WHERE id % 100 = 0)", "id", "text", 5)}, wn AS (SELECT k, count(*) AS n FROM w GROUP BY k),
 h AS ({hits}), sc AS (SELECT h.query_id, h.id, h.similarity, coalesce(round((SELECT count(*) FROM w WHERE w.k = h.query_id AND contains(lower(e.text), w.word)) / nullif(wn.n, 0)::DOUBLE, 6), 0) AS keyword_score FROM h JOIN e ON e.id = h.id LEFT JOIN wn ON wn.k = h.query_id),
 f AS (SELECT *, round(greatest(similarity * 0.8::DOUBLE + keyword_score * 0.2::DOUBLE, similarity * 0.9::DOUBLE), 6) AS score FROM sc),
 g AS (SELECT *, max(CASE WHEN score >= 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS passing FROM f)
 SELECT query_id, id, similarity, keyword_score, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g WHERE passing = 0 OR score >= 0.4) WHERE rank <= 5"""


@query(_hybrid_sql("", f"SELECT query_id, id, similarity FROM ({_top('e', STORE, 15, cte=E)}) WHERE similarity >= 0.2"))
def mem_hybrid(spark, d):
    e = _entries(spark, d)
    return M.hybrid(e, _hybrid_queries(e), 5, 0.4).select("query_id", "id", "similarity", "keyword_score", "score", "rank")


@query(
    _hybrid_sql(
        _CTX.removeprefix(E) + f", a AS (SELECT query_id, id, similarity FROM ({_top('e', STORE, 15, cte=E)}) WHERE similarity >= 0.2), c AS (SELECT query_id, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM (SELECT q.id AS query_id, x.id, {STORE} AS similarity FROM q, e x WHERE x.v IS NOT NULL)) WHERE r <= 10)",
        "SELECT query_id, id, max(similarity) AS similarity FROM (SELECT * FROM a UNION ALL SELECT * FROM c) GROUP BY query_id, id",
    )
)
def mem_hybrid_with_context(spark, d):
    e = _entries(spark, d)
    context = S.top_k(e, _with_context(e), 10, metric="sqeuclidean")
    return M.hybrid(e, _hybrid_queries(e), 5, 0.4, extra=context).select("query_id", "id", "similarity", "keyword_score", "score", "rank")


@query(
    f"""WITH {E}, w AS ({_top('e', COS, 5, 'x.id % 3 = 0', E)}), l AS ({_top('e', STORE, 5, cte=E)}),
 u AS (SELECT query_id, id, similarity, 0 AS tier FROM w UNION ALL SELECT query_id, id, similarity, 1 FROM l),
 o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY similarity DESC, tier) AS r FROM u) WHERE r = 1)
 SELECT query_id, id, similarity, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM o) WHERE rank <= 5"""
)
def mem_merge_tiers(spark, d):
    e = _entries(spark, d)
    return M.merge_tiers(S.top_k(e.where("id % 3 = 0"), _asked(e), 5), S.top_k(e, _asked(e), 5, metric="sqeuclidean"), 5)


@query(
    f"""WITH {E}, h AS ({_top('e', COS, 10, cte=E)}), g AS (SELECT h.query_id, h.id, h.similarity AS original_similarity, round(greatest(0, least(1, list_cosine_similarity(x.v, c.v))), 6) AS context_similarity FROM h JOIN e x ON x.id = h.id JOIN e c ON c.id = h.query_id + 1 WHERE c.v IS NOT NULL),
 f AS (SELECT *, round(0.7::DOUBLE * original_similarity + 0.3::DOUBLE * context_similarity, 6) AS similarity FROM g)
 SELECT query_id, id, similarity, original_similarity, context_similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM f"""
)
def mem_context_reweight(spark, d):
    e = _entries(spark, d)
    context = e.where("embedding is not null").select((F.col("id") - 1).alias("query_id"), F.col("embedding").alias("c"))
    hits = S.top_k(e, _asked(e), 10).join(e.select("id", "embedding"), "id").join(context, "query_id")
    hits = hits.withColumn("context_similarity", F.round(V.cosine("embedding", "c"), 6)).drop("embedding", "c")
    return M.context_reweight(hits, 0.3).select("query_id", "id", "similarity", "original_similarity", "context_similarity", "rank")


@query(
    f"""WITH {E}, q AS (SELECT id, CASE WHEN id % 200 = 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM e WHERE id % 100 = 0), h AS (SELECT DISTINCT query_id FROM (SELECT q.id AS query_id, {COS} AS similarity FROM q, e x WHERE q.v IS NOT NULL AND x.v IS NOT NULL) WHERE similarity >= 0.41),
 w AS {_kw("(SELECT * FROM e WHERE id % 100 = 0 AND id NOT IN (SELECT query_id FROM h))", "id", "text", 5)}, wn AS (SELECT k, count(*) AS n FROM w GROUP BY k),
 t AS (SELECT DISTINCT id, unnest(regexp_split_to_array(lower(text), '{WS}+')) AS word FROM e), f AS (SELECT w.k AS query_id, t.id, round(greatest(0.1::DOUBLE, count(*) / any_value(wn.n)::DOUBLE * 0.3::DOUBLE), 6) AS similarity FROM w JOIN wn ON wn.k = w.k JOIN t ON t.word = w.word GROUP BY w.k, t.id)
 SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM f) WHERE rank <= 5"""
)
def mem_keyword_fallback(spark, d):
    e = _entries(spark, d)
    turned = F.when(F.col("query_id") % 200 == 0, F.transform("query_vector", lambda x: -x)).otherwise(F.col("query_vector"))
    asked = _hybrid_queries(e).withColumn("query_vector", turned)
    return M.keyword_fallback(e, asked, M.indexed(e, asked, 5, 0.82), 5)


@query(
    f"""WITH {E}, h AS (SELECT * FROM ({_top('e', COS, 5, cte=E)}) WHERE similarity >= 0.35), m AS ({_top('e', STORE, 5, 'x.id <> q.id', E)}),
 u AS (SELECT query_id, id, similarity, 0 AS part FROM h UNION ALL SELECT query_id, id, similarity, 1 FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = m.query_id AND h.id = m.id))
 SELECT query_id, id, similarity, part, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, similarity DESC, id) AS rank FROM u) WHERE rank <= 5"""
)
def mem_fillup(spark, d):
    e = _entries(spark, d)
    hits = S.top_k(e, _asked(e), 5).where("similarity >= 0.35")
    more = S.top_k(e, _asked(e), 6, metric="sqeuclidean").where("id <> query_id").drop("rank")
    return M.fill_up(hits, S.rank_hits(more, 5), 5)


@query(f"WITH {E}, h AS ({_top('e', COS, 5, cte=E)}) SELECT h.query_id, h.id, h.similarity, h.rank FROM h JOIN e a ON a.id = h.query_id JOIN e b ON b.id = h.id WHERE a.source IS DISTINCT FROM b.source")
def mem_exclude_same_doc(spark, d):
    e = _entries(spark, d)
    hits = S.top_k(e, _asked(e), 5).join(e.select(F.col("id").alias("query_id"), F.col("source").alias("query_doc")), "query_id").join(e.select("id", F.col("source").alias("hit_doc")), "id")
    return M.other_documents(hits).select("query_id", "id", "similarity", "rank")


@query("SELECT query_no, rank_no, id FROM retrieved WHERE metadata['source'] = 'pdf/collected_course_reader.pdf' AND metadata['lang'] = 'en'")
def mem_metadata_filter(spark, d):
    return S.filter_metadata(_t(spark, d, "retrieved"), {"source": "pdf/collected_course_reader.pdf", "lang": "en"}).select("query_no", "rank_no", "id")


@query(
    f"""WITH {E}, h AS (SELECT query_id, id, similarity FROM ({_top('e', COS, 6, cte=E)})), j AS (SELECT h.*, row_number() OVER (PARTITION BY h.query_id ORDER BY h.similarity DESC, h.id) AS r FROM h JOIN e a ON a.id = h.query_id JOIN e b ON b.id = h.id WHERE a.text <> b.text AND h.similarity >= 0.24),
 g AS (SELECT query_id, count(*) AS n_refs, string_agg('- ' || id || ' (' || printf('%.2f', similarity) || ')', chr(10) ORDER BY r) AS refs FROM j WHERE r <= 3 GROUP BY query_id)
 SELECT e.id AS query_id, coalesce(g.n_refs, 0)::INT AS n_refs, CASE WHEN g.n_refs > 0 THEN e.text || chr(10) || chr(10) || g.refs ELSE e.text END AS text FROM e LEFT JOIN g ON g.query_id = e.id WHERE e.id % 100 = 0"""
)
def mem_augment_refs(spark, d):
    e = _entries(spark, d)
    hits = S.top_k(e, _asked(e), 6).drop("rank").join(e.select("id", "text"), "id")
    return M.augment(e.where("id % 100 = 0").select("id", "text"), hits, 0.24)


@query(f"WITH {SEG} SELECT id, lag(text) OVER (PARTITION BY doc_id ORDER BY seg_no, id) AS before, lead(text) OVER (PARTITION BY doc_id ORDER BY seg_no, id) AS after FROM s WHERE doc_id IS NOT NULL")
def mem_neighbour_context(spark, d):
    s = _segments(spark, d).where("doc_id is not null").withColumn("place", F.struct("seg_no", "id"))
    return M.neighbour_context(s, "doc_id", "place", "text").select("id", "before", "after")


@query(f"WITH {SEG} SELECT count(*) AS n, round(avg(length(text)), 6) AS avg_length, round(avg(try_cast(metadata['access_count'] AS DOUBLE)), 6) AS avg_access, max(try_cast(metadata['access_count'] AS DOUBLE)) AS max_access, round(min(try_cast(metadata['timestamp'] AS DOUBLE)), 3) AS first_ts, round(max(try_cast(metadata['timestamp'] AS DOUBLE)), 3) AS last_ts FROM s")
def mem_stats(spark, d):
    s = _segments(spark, d)
    access, ts = L.number("metadata", "access_count"), L.number("metadata", "timestamp")
    return s.agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("avg_length"), F.round(F.avg(access), 6).alias("avg_access"), F.max(access).alias("max_access"), F.round(F.min(ts), 3).alias("first_ts"), F.round(F.max(ts), 3).alias("last_ts"))


@query(f"WITH {SEG} SELECT coalesce(metadata['source'], 'unknown') AS source, count(*) AS n FROM s GROUP BY 1")
def mem_source_counts(spark, d):
    return _segments(spark, d).groupBy(F.coalesce(F.col("metadata")["source"], F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


@query(f"WITH {SEG} SELECT 'short_term' AS tier, 100 AS capacity, least(count(*), 100) AS used, round(least(count(*), 100) / 100::DOUBLE * 100, 4) AS usage_percent FROM s UNION ALL SELECT 'working', 500, least(count(*), 500), round(least(count(*), 500) / 500::DOUBLE * 100, 4) FROM s WHERE access_count > 0")
def tier_stats(spark, d):
    s = _segments(spark, d)
    return L.tier_stats(s, 100, "short_term").unionAll(L.tier_stats(s.where("access_count > 0"), 500, "working"))


@query(
    f"""WITH {E}, h AS (SELECT * FROM ({_top('e', STORE, 15, cte=E)})), w AS {_kw("(SELECT * FROM e WHERE id % 100 = 0)", "id", "text", 5)},
 g AS (SELECT h.query_id, h.id, greatest(h.similarity, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.k = h.query_id AND contains(lower(e.text), w.word)) THEN 0.4::DOUBLE ELSE 0 END) AS similarity FROM h JOIN e ON e.id = h.id)
 SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM g WHERE similarity >= 0.1) WHERE rank <= 5"""
)
def mem_fallback_retrieve(spark, d):
    e = _entries(spark, d)
    asked = _hybrid_queries(e)
    hits = S.top_k(e, asked, 15, metric="sqeuclidean").drop("rank").join(e.select("id", "text"), "id").join(asked.select("query_id", "keywords"), "query_id")
    lifted = M.fallback_scores(hits, F.exists("keywords", lambda k: F.contains(F.lower("text"), k)))
    return S.rank_hits(lifted.select("query_id", "id", "similarity"), 5)


# Text ----------------------------------------------------------------------------
@query(f"SELECT k AS doc_id, word, r AS rank FROM {_kw('documents', 'doc_id', 'text', 5)}")
def kw_extract(spark, d):
    words = M.keywords(_t(spark, d, "documents"), "doc_id", "text", 5)
    return words.select("doc_id", F.posexplode("keywords").alias("rank", "word")).select("doc_id", "word", (F.col("rank") + 1).alias("rank"))


@query("SELECT doc_id, round(len(list_filter(['the', 'energía', 'schwingung', '概率', 'theorem'], lambda k: contains(lower(text), k))) / 5::DOUBLE, 6) AS score FROM documents WHERE text IS NOT NULL")
def kw_score(spark, d):
    words = F.array(*[F.lit(w) for w in ("the", "energía", "schwingung", "概率", "theorem")])
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.round(T.keyword_score("text", words), 6).alias("score"))


@query(f"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: replace(trim(regexp_replace(l, '{WS}+', ' ', 'g'), ' '), '- ', '')), chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def text_clean(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", T.clean_lines("text").alias("text"))


@query(f"SELECT doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ') AS text FROM documents WHERE text IS NOT NULL")
def text_normalize_ws(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", T.normalize_space("text").alias("text"))


@query("SELECT k AS block_id, string_agg(line, chr(10) ORDER BY p) AS text FROM (SELECT k, line, min(p) AS p FROM (SELECT block_id AS k, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS p FROM (SELECT DISTINCT block_id, content FROM blocks WHERE content IS NOT NULL)) GROUP BY k, line) GROUP BY k")
def text_dedup_lines(spark, d):
    return _blocks(spark, d).where("content is not null").select("block_id", T.distinct_lines("content").alias("text"))


@query("SELECT md5(text) AS key, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
def text_md5_dump(spark, d):
    return _t(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(f"SELECT doc_id, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS text FROM documents WHERE text IS NOT NULL")
def text_llm_postprocess(spark, d):
    """Every text as a model's answer, in a fence and quotes; those that it has itself stay."""
    rows = _t(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", T.unwrap_answer(F.concat(F.lit(" ```markdown\n\""), "text", F.lit("\"\n```\n"))).alias("text"))


@query(
    r"""WITH h AS (SELECT doc_id, trim(coalesce(source, ''), ' ') AS title, regexp_replace('<nav>menu</nav><article><p>' || text || '</p></article>', '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>|<meta[^>]*>', '', 'g') AS body FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, title, CASE WHEN regexp_extract(body, '(?is)<main[^>]*>(.*?)</main>', 1) <> '' THEN regexp_extract(body, '(?is)<main[^>]*>(.*?)</main>', 1) ELSE regexp_extract(body, '(?is)<article[^>]*>(.*?)</article>', 1) END AS part FROM h),
 l AS (SELECT doc_id, title, string_split(regexp_replace(part, '<!--[\s\S]*?-->|</?[A-Za-z][^>]*>|<[!?][^>]*>', chr(10), 'g'), chr(10)) AS ls FROM p)
 SELECT doc_id, title, CASE WHEN title <> '' THEN title || chr(10) ELSE '' END || array_to_string(list_filter(list_transform(ls, lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)) AS text FROM l"""
)
def web_text(spark, d):
    """Every text in a page, with its source as the title."""
    rows = _t(spark, d, "documents").where("text is not null")
    html = F.concat(F.lit("<html><head><title>"), F.coalesce("source", F.lit("")), F.lit("</title><script>var a = 1;</script></head><body><nav>menu</nav><article><p>"), "text", F.lit("</p></article></body></html>"))
    return rows.withColumn("html", html).select("doc_id", T.page_title("html").alias("title"), T.page_text("html").alias("text"))


@query("SELECT source, left(regexp_replace(regexp_replace('https://host.example/' || source, '^https?://', ''), '[\\\\/:*?\"<>|]', '_', 'g'), 100) AS name FROM inputs")
def web_link_name(spark, d):
    return _t(spark, d, "inputs").select("source", T.link_name(F.concat(F.lit("https://host.example/"), "source")).alias("name"))


# Sources --------------------------------------------------------------------------
@query("SELECT source, coalesce(size_mb <= 50 AND lower(regexp_extract(source, '\\.([A-Za-z0-9]+)$', 1)) IN ('pdf', 'jpg', 'jpeg', 'png', 'py', 'java', 'js', 'c', 'cpp', 'txt', 'md'), false) AS ok FROM inputs")
def src_admitted(spark, d):
    return _t(spark, d, "inputs").select("source", files.admitted("size_mb", "source").alias("ok"))


@query("SELECT category, count(*) AS n, round(sum(size_mb), 3) AS size_mb FROM inputs WHERE size_mb <= 50 GROUP BY category")
def src_categories(spark, d):
    return _t(spark, d, "inputs").where(F.col("size_mb") <= files.MAX_MB).groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("size_mb"), 3).alias("size_mb"))


@query("SELECT list_position(['pdf', 'codes', 'links', 'images'], i.category)::INT AS src_order, d.source, '[' || i.category || ': ' || d.source || ']' || chr(10) || d.text AS text FROM documents d JOIN inputs i ON i.source = d.source WHERE length(d.text) > 0")
def src_tagged_texts(spark, d):
    texts = _t(spark, d, "documents").select("source", "text").join(_t(spark, d, "inputs").select("source", "category"), "source")
    return files.tagged(texts)


# Lifecycle ------------------------------------------------------------------------
@query(
    f"""WITH {SEG}, m AS (SELECT id, text, metadata['source'] AS source, try_cast(metadata['importance'] AS DOUBLE) AS x, length(regexp_replace(text, '[\\p{{L}}\\s]', '', 'g')) / greatest(length(text), 1)::DOUBLE AS dense FROM s WHERE text IS NOT NULL),
 o AS (SELECT *, 0.5::DOUBLE + CASE WHEN length(text) > 1000 THEN 0.2::DOUBLE WHEN length(text) < 50 THEN -0.1::DOUBLE ELSE 0 END + CASE WHEN dense > 0.2 THEN 0.1::DOUBLE ELSE 0 END AS content,
 0.5::DOUBLE + CASE source WHEN 'expert_input' THEN 0.3::DOUBLE WHEN 'user_input' THEN 0.1::DOUBLE WHEN 'generated' THEN -0.1::DOUBLE ELSE 0 END AS ext FROM m)
 SELECT id, round(greatest(0.1, least(1, content * 0.3::DOUBLE + 0.2::DOUBLE + CASE WHEN x IS NOT NULL THEN x * 0.7::DOUBLE + ext * 0.3::DOUBLE ELSE ext END * 0.3::DOUBLE)), 6) AS importance FROM o"""
)
def life_importance(spark, d):
    s = _segments(spark, d).where("text is not null")
    return s.select("id", F.round(T.initial_importance("text", F.col("metadata")["source"], L.number("metadata", "importance")), 6).alias("importance"))


@query("SELECT user_id, count(*) AS access_count, round(max(epoch(ts)), 3) AS last_accessed FROM events GROUP BY user_id")
def life_access_counts(spark, d):
    return L.access_counts(_t(spark, d, "events").withColumn("ts", F.round(_epoch("ts"), 3)), "user_id", "ts")


@query(f"WITH {SEG} SELECT id, round(least(1, importance * (least(access_count, 100) * 0.01::DOUBLE + 1)), 6) AS importance FROM s")
def life_access_importance(spark, d):
    return _segments(spark, d).select("id", F.round(L.accessed_importance("importance", "access_count"), 6).alias("importance"))


@query(f"WITH {SEG} SELECT id, round(least(1, importance * 1.5::DOUBLE * 1.2::DOUBLE), 6) AS importance FROM s WHERE access_count > 0")
def life_reinforce(spark, d):
    return _segments(spark, d).where("access_count > 0").select("id", F.round(L.reinforced("importance", 1.2), 6).alias("importance"))


@query(
    f"""WITH {SEG}, r AS (SELECT id, importance * (least(access_count, 10) * 0.2::DOUBLE + 1) AS strength, ({NOW} - ts) / 86400 AS days FROM s), t AS (SELECT id, CASE WHEN strength > 0 THEN exp(-days * 0.1::DOUBLE / strength) ELSE 0 END AS retention FROM r)
 SELECT id, round(retention, 6) AS retention, retention < 0.3 AS forget FROM t"""
)
def life_forgetting_curve(spark, d):
    s = _segments(spark, d)
    keep = L.retention("importance", "access_count", (F.lit(NOW) - F.col("ts")) / L.DAY)
    return s.select("id", F.round(keep, 6).alias("retention"), (keep < 0.3).alias("forget"))


@query(f"WITH {SEG} SELECT id FROM s WHERE access_count > 0 AND ts < {NOW} - 400 * 86400")
def life_forget_by_age(spark, d):
    return _segments(spark, d).where((F.col("access_count") > 0) & (F.col("ts") < NOW - 400 * L.DAY)).select("id")


@query(f"WITH {SEG} SELECT id, round(greatest(importance * 0.3::DOUBLE, 0.1), 6) AS importance, true AS forgotten FROM s WHERE importance < 0.4")
def life_forget_one(spark, d):
    return _segments(spark, d).where("importance < 0.4").select("id", F.round(L.forgotten_importance("importance"), 6).alias("importance"), F.lit(True).alias("forgotten"))


@query(f"WITH {SEG} SELECT id, round(importance * 0.6::DOUBLE + least(0.4::DOUBLE, access_count * 0.02::DOUBLE) + exp(-({NOW} - ts) / 43200) * 0.4::DOUBLE, 6) AS score FROM s")
def life_eviction_score(spark, d):
    return _segments(spark, d).select("id", F.round(L.eviction_score("importance", "access_count", F.lit(NOW) - F.col("ts")), 6).alias("score"))


@query(f"WITH {SEG} SELECT id, round(least(1, importance * 0.5::DOUBLE + least(0.3::DOUBLE, access_count * 0.02::DOUBLE) + exp(-({NOW} - ts) / 43200) * 0.2::DOUBLE), 6) AS priority FROM s")
def life_recompute_priority(spark, d):
    return _segments(spark, d).select("id", F.round(L.recomputed_priority("importance", "access_count", F.lit(NOW) - F.col("ts")), 6).alias("priority"))


def _trim(order: str) -> str:
    return f"WITH {SEG} SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {order} NULLS FIRST, id) AS r, count(*) OVER () AS n FROM s) WHERE n <= 400 OR r > n - 320"


@query(_trim("ts"))
def life_cleanup_oldest(spark, d):
    return L.trim(_segments(spark, d).select("id", "ts"), "ts", 400).select("id")


@query(_trim("access_count"))
def life_cleanup_least_used(spark, d):
    return L.trim(_segments(spark, d).select("id", "access_count"), "access_count", 400).select("id")


@query(
    f"""WITH {N}, p AS (SELECT i, round(avg(v[i]), 9) AS x FROM (SELECT * FROM n ORDER BY md5(id::VARCHAR), id LIMIT 10), range(1, 65) r(i) GROUP BY i), q AS (SELECT list(x ORDER BY i) AS v FROM p),
 f AS (SELECT x.id, round(list_distance(q.v, x.v) * list_distance(q.v, x.v), 6) AS far FROM n x, q) SELECT id FROM (SELECT id, row_number() OVER (ORDER BY -far, id) AS r, count(*) OVER () AS n FROM f) WHERE n <= 400 OR r > n - 320"""
)
def life_cleanup_relevance(spark, d):
    v = _vectors(spark, d)
    some = v.orderBy(F.md5(F.col("id").cast("string")), "id").limit(10).select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    probe = some.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("probe"))
    far = v.crossJoin(F.broadcast(probe)).select("id", (-F.round(V.squared_distance("embedding", "probe"), 6)).alias("near"))
    return L.trim(far, "near", 400).select("id")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def stm_recent(spark, d):
    return L.recent(_t(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id", 100, 50)


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id ORDER BY value DESC, user_id LIMIT 20")
def wm_top(spark, d):
    return L.top_priority(_t(spark, d, "events"), "user_id", "event_id", "value", 20)


@query(f"WITH {SEG}, m AS (SELECT id, map_concat(metadata, MAP {{'source': 'edited', 'editor': 'night shift'}}) AS m FROM s WHERE metadata IS NOT NULL) SELECT id, m['source'] AS source, m['editor'] AS editor, m['timestamp'] AS ts, cardinality(m)::INT AS n FROM m")
def life_update_metadata(spark, d):
    new = F.create_map(F.lit("source"), F.lit("edited"), F.lit("editor"), F.lit("night shift"))
    m = _segments(spark, d).where("metadata is not null").select("id", L.merge_metadata("metadata", new).alias("m"))
    return m.select("id", F.col("m")["source"].alias("source"), F.col("m")["editor"].alias("editor"), F.col("m")["timestamp"].alias("ts"), F.size("m").alias("n"))


# Cache ----------------------------------------------------------------------------
_HITS = f"""{CAC}, w AS (SELECT *, last_value(CASE WHEN op IN ('put', 'evict') THEN struct_pack(op := op, ts := ts, ttl := ttl_s) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, log_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM c WHERE key IS NOT NULL AND ts IS NOT NULL),
 g AS (SELECT log_no, key, CASE WHEN st.op = 'put' THEN round(ts - st.ts, 3) END AS age_s, st.ttl AS ttl FROM w WHERE op = 'get'),
 k AS (SELECT log_no, key, age_s, CASE WHEN age_s IS NULL THEN 'miss' WHEN ttl IS NOT NULL AND age_s > ttl THEN 'expired' ELSE 'exact' END AS kind FROM g)"""


@query(f"WITH {_HITS} SELECT log_no, key, age_s, kind FROM k")
def cache_ttl_hits(spark, d):
    return C.ttl_hits(_cache(spark, d))


@query(f"WITH {_HITS} SELECT count(*) AS queries, count(*) FILTER (WHERE kind = 'exact') AS hits, round(count(*) FILTER (WHERE kind = 'exact') / greatest(count(*), 1)::DOUBLE, 6) AS exact_ratio, round(count(*) FILTER (WHERE kind = 'expired') / greatest(count(*), 1)::DOUBLE, 6) AS expired_ratio, round(count(*) FILTER (WHERE kind = 'miss') / greatest(count(*), 1)::DOUBLE, 6) AS miss_ratio FROM k")
def cache_stats(spark, d):
    return C.stats(C.ttl_hits(_cache(spark, d)))


@query(
    f"""WITH {CAC}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, log_no DESC) AS r FROM c WHERE op IN ('put', 'evict') AND key IS NOT NULL AND ts IS NOT NULL) WHERE r = 1)
 SELECT key, round(1760000000.0 - ts, 3) AS age_s FROM l WHERE op = 'put' AND (ttl_s IS NULL OR 1760000000.0 - ts <= ttl_s)"""
)
def cache_unexpired(spark, d):
    return C.unexpired(_cache(spark, d), 1760000000.0)


@query(f"WITH {CAC} SELECT md5(key) AS query_key, count(*) AS n FROM c WHERE key IS NOT NULL GROUP BY md5(key)")
def cache_keys(spark, d):
    return _cache(spark, d).where("key is not null").groupBy(C.query_key("key").alias("query_key")).agg(F.count("*").alias("n"))


@query()
def cache_lru_fold(spark, d):
    return C.fold(_cache(spark, d), 20)


@query()
def cache_semantic_fold(spark, d):
    log = files.with_provider(_cache(spark, d), files.hashed_vectors(32), "key", "vector", "array<double>")
    return C.fold(log, 20, 0.8)
