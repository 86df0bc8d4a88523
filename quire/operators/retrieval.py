"""Composed retrieval: index, context, keywords, fallbacks, tiers and the result cache, for all queries of a batch in one plan.

Entries have ``id``, ``text`` and ``embedding``; queries ``query_id``, ``query_vector``, ``query_text`` and,
where a context counts, ``context_vector``. A fallback answers only the queries that nothing before it
answered: they are told apart by an anti-join, never by looking at one query at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.errors import IndexLogError
from quire.functions import text as T
from quire.functions import vector as V

from . import memory, search
from .lineage import cut

#: Similarity of what a fallback returns without any match, and of an entry that holds a word of the query.
FLOOR, WORD = 0.1, 0.4


def words(text: Column | str) -> Column:
    """The words of a query, in lower case, repeated ones too."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), T.SPACE + "+"), lambda w: w != "")


class _Words:
    """The words of a set of queries in one automaton; counts how many of each query's words a text holds."""

    def __init__(self, asked: list[list[str]]):
        self.n = len(asked)
        self.size = np.array([max(1, len(own or [])) for own in asked], dtype=np.float64)
        self.empty = np.array([not own for own in asked])
        of: dict[str, dict[int, int]] = {}
        for q, own in enumerate(asked):
            for w in own or []:
                of.setdefault(w, {})[q] = of.setdefault(w, {}).get(q, 0) + 1
        self.automaton = ahocorasick.Automaton()
        for w, by in of.items():
            self.automaton.add_word(w, (w, np.fromiter(by, np.int64, len(by)), np.fromiter(by.values(), np.int64, len(by))))
        if of:
            self.automaton.make_automaton()
        self.any = bool(of)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((self.n, len(texts)), np.int32)
        if self.any:
            for r, text in enumerate(texts):
                for _, queries, times in {m[0]: m for _, m in self.automaton.iter(text or "")}.values():
                    out[queries, r] += times
        return out


def _best(score: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, places of its k best rows) where a score of -1 is no row; ties go to the smaller name."""
    for q, row in enumerate(score):
        kept = np.flatnonzero(row >= 0)
        if len(kept) > k:
            kept = kept[row[kept] >= np.partition(row[kept], len(kept) - k)[len(kept) - k]]
        yield q, kept[np.lexsort((names[kept], -row[kept]))][:k]


def _scored(asked: pa.Table, k: int, lifted: bool):
    """Scores a chunk of (id, text, v) for the asked (query_id, words, query_vector): (query place, id, similarity)."""
    own = _Words(asked.column("words").to_pylist())
    sets = search._by_size(asked.column("query_vector").combine_chunks()) if lifted else []

    def run(ids: pa.Array, texts: list, vectors: pa.Array | None) -> tuple[list, list, list]:
        names, out = np.array(ids.to_pylist()), ([], [], [])
        count = own.counts(texts)
        if lifted:
            score = np.zeros(count.shape)
            for matrix, at in sets:
                rows, places = search._rows(vectors, matrix.shape[1])
                if len(rows):
                    score[np.ix_(at, places)] = np.round(search._scores(matrix, rows, "cosine"), 6) + 0.0
            score = np.where(count > 0, np.maximum(score, WORD), score)
            score = np.where(score >= FLOOR, score, -1)
        else:
            share = np.where(own.empty[:, None], 0.0, count / own.size[:, None])
            score = np.round(np.maximum(FLOOR, share * 0.3), 6)
        for q, chosen in _best(score, names, k):
            out[0].extend([q] * len(chosen)), out[1].extend(names[chosen].tolist()), out[2].extend(score[q, chosen].tolist())
        return out

    return run


def _text_search(entries: DataFrame, queries: DataFrame, k: int, lifted: bool, block: int) -> DataFrame:
    """The k best entries of each query by its words (and vector), as ``top_k`` finds them by vectors."""
    name, kind = search._kind(entries, "id")
    wanted, q_kind = search._kind(queries, "query_id")
    vector = F.col("query_vector") if lifted else F.lit(None).cast("array<double>")
    asked = queries.select("query_id", words("query_text").alias("words"), vector.alias("query_vector"))
    rows = entries.select("id", F.lower("text").alias("text"), (F.col("embedding") if lifted else F.lit(None).cast("array<double>")).alias("v")).where("text is not null")
    fields = [q_kind, kind, pa.float64()]
    schema = f"query_id {wanted}, id {name}, similarity double"
    head = asked.limit(block + 1).toArrow()

    def chunks(run, keys: pa.Array, batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                places, ids, scores = run(part.column(0), part.column(1).to_pylist(), part.column(2))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int64())).cast(fields[0]), pa.array(ids, fields[1]), pa.array(scores, fields[2])], names=["query_id", "id", "similarity"])

    if len(head) <= block:
        if not len(head):
            return entries.sparkSession.createDataFrame([], f"{schema}, rank int")

        def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from chunks(_scored(head, k, lifted), head.column("query_id").combine_chunks(), batches)

        return search.rank_hits(rows.mapInArrow(one_pass, schema), k)

    def one_box(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        empty = pa.schema([("query_id", fields[0]), ("id", fields[1]), ("similarity", fields[2])])
        if not len(mine) or not len(theirs):
            return empty.empty_table()
        batches = mine.select(["id", "text", "v"]).combine_chunks().to_batches()
        return pa.Table.from_batches(list(chunks(_scored(theirs, k, lifted), theirs.column("query_id").combine_chunks(), batches)), schema=empty)

    met = search.meet(rows.withColumn("cell", F.lit(0)), asked.withColumn("cell", F.lit(0)), one_box, schema, 8192, block)
    return search.rank_hits(met, k)


def keyword_share(entries: DataFrame, queries: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """Every entry at max(0.1, 0.3 * share of the query's words that its text holds); the k best, ties by id.

    A word counts where it is any part of the text; a query without words has every entry at 0.1.
    Entries without a text are none.
    """
    return _text_search(entries, queries, k, False, block)


def rescan(entries: DataFrame, queries: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """Every entry by cosine, at 0.4 at least where it holds a word of the query, from 0.1 on; where none is, the first one at 0.1."""
    hits = cut(_text_search(entries, queries, k, True, block))
    return hits.unionByName(_first_rows(entries, _lost(queries, hits), 1))


def _lost(queries: DataFrame, hits: DataFrame) -> DataFrame:
    return queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")


def _first_rows(entries: DataFrame, lost: DataFrame, k: int) -> DataFrame:
    """The first k entries by id, at 0.1, for each query that nothing answered; k rows are broadcast."""
    first = entries.select("id").orderBy("id").limit(k).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    each = lost.select("query_id").join(F.broadcast(first)).select("query_id", F.posexplode("ids").alias("rank", "id"))
    return each.select("query_id", "id", F.lit(FLOOR).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def indexed_retrieve(entries: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.7, context_weight: float = 0.3) -> DataFrame:
    """Index hits from half the threshold on (0.1 at least), reweighted by context; keywords where there is none.

    Columns: query_id, id, similarity, rank, kind (index or keyword). The index's
    max(3k, 10) best are looked at and cut to k. With a ``context_vector`` a hit has
    (1 - w) * similarity + w * its cosine with the context. Queries that the index leaves
    without a hit, also those without a vector, get ``keyword_share``.
    """
    hits = cut(memory.indexed(entries, queries, k, threshold))
    out = hits
    if "context_vector" in queries.columns:
        both = hits.join(queries.select("query_id", "context_vector"), "query_id").join(entries.select("id", "embedding"), "id")
        near = F.round(V.cosine("embedding", "context_vector"), 6)
        new = F.when(F.col("context_vector").isNull(), F.col("similarity")).otherwise(F.round((1 - context_weight) * F.col("similarity") + context_weight * near, 6))
        out = search.rank_hits(both.select("query_id", "id", new.alias("similarity")), k)
    back = keyword_share(entries, _lost(queries, hits), k)
    return out.select("query_id", "id", "similarity", "rank", F.lit("index").alias("kind")).unionByName(back.withColumn("kind", F.lit("keyword")))


def fallback_retrieve(entries: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.7) -> DataFrame:
    """The store's 3k nearest from min(threshold, 0.5) on, cut to k; for queries left without one the first k entries at 0.1."""
    near = search.top_k(entries, queries, 3 * k, metric="sqeuclidean").where(F.col("similarity") >= min(threshold, 0.5))
    hits = cut(search.rank_hits(near.drop("rank"), k))
    return hits.unionByName(_first_rows(entries, _lost(queries.where("query_vector is not null"), hits), k))


def three_tier(working: DataFrame, entries: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.6) -> DataFrame:
    """Working memory by cosine and long-term memory by the hybrid mode as one ranking: query_id, id, similarity, tier, rank.

    Of an entry in both the greater similarity stands, of equal ones the working tier's. ``queries``
    have ``keywords``. What was returned is accessed; see ``accesses``.
    """
    near = search.top_k(working, queries, k)
    far = memory.hybrid(entries, queries, k, threshold).select("query_id", "id", F.col("score").alias("similarity"))
    return memory.merge_tiers(near, far, k)


def accesses(hits: DataFrame, now: float) -> DataFrame:
    """The access log's rows for what was returned: id, ts. State changes only when they are appended."""
    return hits.select("id", F.lit(now).alias("ts"))


def perform(working: DataFrame, entries: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.6) -> DataFrame:
    """Index hits from the threshold on, filled up to k from the three tiers: query_id, id, similarity, part, rank."""
    hits = search.top_k(entries, queries, k).where(F.col("similarity") >= threshold)
    return memory.fill_up(hits, three_tier(working, entries, queries, k, threshold).drop("rank", "tier"), k)


def request_key(text: Column | str, k: int, threshold: float, mode: str) -> Column:
    """The cache's key of a request: its text and all that the answer depends on."""
    t = F.col(text) if isinstance(text, str) else text
    return F.md5(F.concat_ws("\x1f", t, F.lit(str(k)), F.lit(str(threshold)), F.lit(mode)))


def get_or_compute(cache: DataFrame, queries: DataFrame, compute: Callable[[DataFrame], DataFrame], now: float, ttl: float | None, k: int, threshold: float, mode: str) -> tuple[DataFrame, DataFrame]:
    """(answers, puts): cached answers where they are fresh, computed ones elsewhere.

    ``cache`` has key, result (an array of id, similarity, rank), ts and ttl_s; its last put of a
    key counts. An entry that is older than its time to live, or holds null, is a miss. Answers:
    query_id, id, similarity, rank, cached. Puts, to be appended to the cache, hold the computed
    answers, also empty ones; requests of one key are computed once.
    """
    asked = queries.withColumn("key", request_key("query_text", k, threshold, mode))
    held = cache.where("key is not null").groupBy("key").agg(F.max_by(F.struct("result", "ts", "ttl_s"), "ts").alias("s"))
    fresh = held.where("s.result is not null").where(F.col("s.ttl_s").isNull() | (F.lit(now) - F.col("s.ts") <= F.col("s.ttl_s"))).select("key", F.col("s.result").alias("result"))
    found = asked.join(fresh, "key").select("query_id", F.explode("result").alias("r")).select("query_id", "r.id", "r.similarity", "r.rank", F.lit(True).alias("cached"))
    lost = cut(asked.join(fresh, "key", "left_anti"))
    one = lost.join(lost.groupBy("key").agg(F.min("query_id").alias("query_id")), ["key", "query_id"], "left_semi")
    made = cut(compute(one).select("query_id", "id", "similarity", "rank").join(one.select("query_id", "key"), "query_id"))
    results = made.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "similarity"))).alias("r"))
    shaped = F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["similarity"].alias("similarity"), x["rank"].alias("rank")))
    none = F.array().cast(cache.schema["result"].dataType)
    puts = one.select("key").join(results.select("key", shaped.alias("result")), "key", "left").select("key", F.coalesce(F.col("result").cast(cache.schema["result"].dataType), none).alias("result"), F.lit(now).alias("ts"), F.lit(ttl).cast("double").alias("ttl_s"))
    answers = lost.select("query_id", "key").join(made.drop("query_id"), "key").select("query_id", "id", "similarity", "rank", F.lit(False).alias("cached"))
    return found.unionByName(answers), puts


def search_index(vectors: DataFrame, queries: DataFrame, k: int, kind: str = "hybrid", cells: DataFrame | None = None, probes: int = 10) -> DataFrame:
    """One way into every kind of index. ``flat``, ``hnsw`` and ``hybrid`` are exact; ``ivf`` probes its lists, and is exact until they are built.

    ``cells`` are the lists' centroids (``fit_cells``). An unknown kind is an error.
    """
    if kind not in ("flat", "hnsw", "hybrid", "ivf"):
        raise IndexLogError(f"unknown kind of index: {kind}")
    if kind != "ivf" or cells is None:
        return search.top_k(vectors, queries, k)
    return search.probe_search(search.assign_cells(vectors, cells), cells, queries, k, probes)


def build_index(vectors: DataFrame, kind: str = "hybrid", lists: int | None = None, most: int = 10000) -> tuple[DataFrame, DataFrame | None]:
    """(rows, centroids) of an index. Only ``ivf`` has lists, as many as the root of its capacity, or of its rows if they are fewer."""
    if kind != "ivf":
        return vectors, None
    n = vectors.where(F.col("embedding").isNotNull()).limit(lists or max(1, int(most**0.5))).count()
    if not n:
        return vectors, None
    cells = search.fit_cells(vectors, n)
    return search.assign_cells(vectors, cells), cells


def batch_pairs(ids: list, vectors: list) -> list[tuple]:
    """Pairs of a batch to be added; lists of different length are an error."""
    if len(ids) != len(vectors):
        raise IndexLogError(f"{len(ids)} ids and {len(vectors)} vectors")
    return list(zip(ids, vectors))


def related(entries: DataFrame, hits: DataFrame, order: str = "rank") -> DataFrame:
    """Hits with the stored rows they stand for, joined by id and not by position."""
    window = Window.partitionBy("query_id").orderBy(order)
    return hits.join(entries, "id").withColumn(order, F.row_number().over(window))
