"""Retrieval over stored entries: simple, time-weighted, context-aware and hybrid, and their merges.

Entries have ``id``, ``text``, ``embedding``, ``ts`` (epoch seconds), queries ``query_id``,
``query_vector`` and what a mode needs besides. Every mode answers all queries in one plan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

from .search import rank_hits, top_k

DAY = 86400.0


def _most_common(n: int):
    stop = frozenset(T.STOPWORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Python's blanks are those of SPACE
            best = [[w for w, _ in Counter(w for w in text.split() if len(w) > 1 and w not in stop).most_common(n)] for text in batch.column(1).to_pylist()]
            kept = pa.array([bool(x) for x in best], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), pa.array(best, pa.list_(pa.string())).filter(kept)], names=[batch.schema.names[0], "keywords"])

    return run


def keywords(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """The n most frequent words of each text, ties by first occurrence: the key, keywords, in order.

    Words of one character and stop words are none; texts without a word have no row. Each row is
    counted where it lies, without a shuffle.
    """
    rows = df.where(F.col(text).isNotNull()).select(key, F.lower(text).alias("_text"))
    return rows.mapInArrow(_most_common(n), f"`{key}` {df.schema[key].dataType.simpleString()}, keywords array<string>")


def simple(entries: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.6) -> DataFrame:
    """Top k by the store's similarity (1 minus the clamped squared distance), then the threshold."""
    return top_k(entries, queries, k, metric="sqeuclidean").where(F.col("similarity") >= threshold)


def decay(ts: Column | str, now: float, rate: float) -> Column:
    """exp(-rate * age in days); an unknown time counts as now."""
    t = F.coalesce(F.col(ts) if isinstance(ts, str) else ts, F.lit(now))
    return F.exp(-rate * (F.lit(now) - t) / DAY)


def time_weighted(entries: DataFrame, queries: DataFrame, now: float, k: int = 5, rate: float = 0.01, threshold: float = 0.0) -> DataFrame:
    """The 3k nearest entries of each query, ranked by how recent they are."""
    near = top_k(entries, queries, 3 * k, metric="sqeuclidean").drop("rank")
    aged = near.join(entries.select("id", "ts"), "id").withColumn("score", F.round(decay("ts", now, rate), 6)).drop("ts")
    return rank_hits(aged, k, "score").where(F.col("score") >= threshold)


def hybrid(entries: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.6, extra: DataFrame | None = None) -> DataFrame:
    """Semantic hits reranked with keyword scores: max(0.8 s + 0.2 w, 0.9 s).

    ``queries`` also have ``keywords``. ``extra`` are hits by context (query_id, id,
    similarity), merged by the greater similarity. If no hit of a query reaches the
    threshold, all of its hits are kept.
    """
    hits = top_k(entries, queries, max(3 * k, 10), metric="sqeuclidean").where(F.col("similarity") >= threshold - 0.2).select("query_id", "id", "similarity")
    if extra is not None:
        hits = merge_best([hits, extra.select("query_id", "id", "similarity")])
    scored = hits.join(entries.select("id", "text"), "id").join(queries.select("query_id", "keywords"), "query_id")
    scored = scored.withColumn("keyword_score", F.round(T.keyword_score("text", "keywords"), 6))
    both = scored.withColumn("score", F.round(F.greatest(F.col("similarity") * 0.8 + F.col("keyword_score") * 0.2, F.col("similarity") * 0.9), 6)).drop("text", "keywords")
    return rank_hits(keep_passing(both, "score", threshold), k, "score")


def keep_passing(hits: DataFrame, score: str, threshold: float) -> DataFrame:
    """Hits that reach the threshold; all of a query's hits where none does."""
    some = F.max((F.col(score) >= threshold).cast("int")).over(Window.partitionBy("query_id"))
    return hits.withColumn("_some", some).where((F.col("_some") == 0) | (F.col(score) >= threshold)).drop("_some")


def merge_best(parts: list[DataFrame]) -> DataFrame:
    """Union of hits, each (query, id) once with its greatest similarity."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))


def merge_tiers(working: DataFrame, long_term: DataFrame, k: int) -> DataFrame:
    """Working and long-term hits as one ranking; of equal similarities the working tier's row stands."""
    both = working.select("query_id", "id", "similarity", F.lit(0).alias("tier")).unionByName(long_term.select("query_id", "id", "similarity", F.lit(1).alias("tier")))
    first = Window.partitionBy("query_id", "id").orderBy(F.desc("similarity"), "tier")
    one = both.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    return rank_hits(one, k)


def fill_up(hits: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """Hits, and behind them those of ``more`` that are not among them, up to k a query."""
    rest = more.join(hits, ["query_id", "id"], "left_anti")
    both = hits.select("query_id", "id", "similarity", F.lit(0).alias("part")).unionByName(rest.select("query_id", "id", "similarity", F.lit(1).alias("part")))
    order = Window.partitionBy("query_id").orderBy("part", F.desc("similarity"), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def context_reweight(hits: DataFrame, weight: float = 0.3) -> DataFrame:
    """(1 - w) * similarity + w * context_similarity, ranked again; both old values are kept."""
    new = F.round((1 - weight) * F.col("similarity") + weight * F.col("context_similarity"), 6)
    out = hits.withColumn("original_similarity", F.col("similarity")).withColumn("similarity", new).drop("rank")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")))


def keyword_fallback(entries: DataFrame, queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """For queries without any hit: entries that hold one of their keywords, at max(0.1, 0.3 * share)."""
    lost = queries.join(hits, "query_id", "left_anti").select("query_id", F.size("keywords").alias("n"), F.explode("keywords").alias("word"))
    words = entries.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), T.SPACE + "+"))).alias("word"))
    found = lost.join(words, "word").groupBy("query_id", "id").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    return rank_hits(found.select("query_id", "id", F.round(F.greatest(F.lit(0.1), F.col("m") / F.col("n") * 0.3), 6).alias("similarity")), k)


def indexed(entries: DataFrame, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """Index hits at half the threshold (0.1 at least), over-fetched and cut to k."""
    return rank_hits(top_k(entries, queries, max(3 * k, 10)).where(F.col("similarity") >= max(0.1, 0.5 * threshold)).drop("rank"), k)


def fallback_scores(hits: DataFrame, any_keyword: Column) -> DataFrame:
    """Similarity of at least 0.4 where any keyword occurs, from 0.1 on."""
    lifted = F.greatest("similarity", F.when(any_keyword, 0.4).otherwise(0.0))
    return hits.withColumn("similarity", lifted).where(F.col("similarity") >= 0.1)


def other_documents(hits: DataFrame, k: int = 5) -> DataFrame:
    """The k best hits of each document, then without its own: there can be fewer than k."""
    return hits.where(F.col("rank") <= k).where(~F.col("query_doc").eqNullSafe(F.col("hit_doc")))


def neighbour_context(segments: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """The segments with the texts before and after them in their document."""
    w = Window.partitionBy(doc).orderBy(order)
    return segments.withColumn("before", F.lag(text).over(w)).withColumn("after", F.lead(text).over(w))


def reference(key: Column, similarity: Column) -> Column:
    """The line that refers to a hit."""
    return F.format_string("- %s (%.2f)", key, similarity)


def augment(segments: DataFrame, hits: DataFrame, min_similarity: float, most: int = 3) -> DataFrame:
    """Each segment's text with up to ``most`` references below it: query_id, text, refs.

    ``hits`` have query_id, id, text, similarity; a hit with the segment's own text is none.
    """
    own = hits.withColumnRenamed("text", "hit_text").join(segments.select(F.col("id").alias("query_id"), F.col("text")), "query_id")
    kept = rank_hits(own.where((F.col("hit_text") != F.col("text")) & (F.col("similarity") >= min_similarity)), most)
    line = reference(F.col("id").cast("string"), F.col("similarity"))
    refs = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias("refs"))
    out = segments.select(F.col("id").alias("query_id"), "text").join(refs, "query_id", "left").withColumn("n_refs", F.coalesce(F.size("refs"), F.lit(0)))
    return out.select("query_id", "n_refs", F.when(F.col("n_refs") > 0, F.concat("text", F.lit("\n\n"), F.array_join("refs", "\n"))).otherwise(F.col("text")).alias("text"))


def weighted(semantic: Column, keyword: Column, temporal: Column, relational: Column, preference: Column) -> Column:
    """The declared weights of the five signals."""
    return semantic * 0.4 + keyword * 0.2 + temporal * 0.15 + relational * 0.15 + preference * 0.1
