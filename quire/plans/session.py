"""A thin facade: a knowledge base over a table of entries, with one call for each way of asking."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import graph, knowledge, memory, retrieval
from quire.operators import search as S
from quire.sources import documents as D

MODES = ("simple", "time_weighted", "context_aware", "hybrid")


@dataclass
class KnowledgeBase:
    """Entries with id, text, embedding and ts (epoch seconds), and the defaults of asking them."""

    entries: DataFrame
    k: int = 5
    threshold: float = 0.6
    now: float = 0.0

    def query(self, queries: DataFrame, mode: str = "simple", k: int | None = None, threshold: float | None = None) -> DataFrame:
        """Hits of all queries in one plan; an unknown mode is the simple one.

        ``queries`` have query_id and query_vector; for ``hybrid`` also keywords, for
        ``context_aware`` also context_vector.
        """
        k = self.k if k is None else k
        t = self.threshold if threshold is None else threshold
        if mode == "time_weighted":
            return memory.time_weighted(self.entries, queries, self.now, k, threshold=t)
        if mode == "context_aware":
            from quire.functions.vector import mean_vector

            asked = queries.select("query_id", mean_vector("query_vector", "context_vector").alias("query_vector"))
            return memory.simple(self.entries, asked, k, t)
        if mode == "hybrid":
            return memory.hybrid(self.entries, queries, k, t)
        return memory.simple(self.entries, queries, k, t)

    def documents(self, queries: DataFrame, mode: str = "simple") -> DataFrame:
        """Hits with the entries' texts: query_id, rank, id, content, similarity."""
        hits = self.query(queries, mode)
        return hits.join(self.entries.select("id", F.col("text").alias("content")), "id").select("query_id", "rank", "id", "content", "similarity")

    def search(self, texts: DataFrame, embed, dim: int, mode: str = "simple") -> DataFrame:
        """Documents for texts (query_id, query_text): blank texts, and those the provider fails on, have none."""
        asked = D.embedded(texts.where("length(trim(query_text)) > 0"), "query_text", embed, dim, "query_vector").where("error is null")
        if mode == "hybrid":
            words = memory.keywords(asked, "query_id", "query_text", 5)
            asked = asked.join(words, "query_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
        return self.documents(asked, mode)

    def get(self, ids: DataFrame, include: list[str] | None = None) -> DataFrame:
        """The entries of the wanted ids; ``include`` names the columns that are read besides the id."""
        return self.scan(include).join(ids.select("id").distinct(), "id", "left_semi")

    def scan(self, include: list[str] | None = None) -> DataFrame:
        """All entries, or the named columns of them."""
        return self.entries if include is None else self.entries.select("id", *[c for c in include if c != "id"])

    def sizes(self) -> DataFrame:
        """Number of entries and their mean length."""
        return self.entries.agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("avg_length"))

    def remove(self, ids: DataFrame) -> KnowledgeBase:
        """The base without the entries of the ids."""
        return replace(self, entries=knowledge.removed(self.entries, ids))

    def clean_up(self, strategy: str, most: int) -> KnowledgeBase:
        return replace(self, entries=knowledge.clean_up(self.entries, strategy, most, self.now))

    def associations(self, core: DataFrame, depth: int = 2) -> DataFrame:
        return graph.associations(self.entries, core, depth)

    def nearest(self, queries: DataFrame) -> DataFrame:
        return S.top_k(self.entries, queries, self.k)


@dataclass
class CachedKnowledgeBase:
    """A knowledge base whose answers are kept: the options of the index and of the cache, and the cache as a log.

    The key of an answer holds the text, k, threshold and mode. Adding entries clears the cache.
    """

    base: KnowledgeBase
    cache: DataFrame
    ttl: float | None = 3600.0
    use_cache: bool = True

    SCHEMA = "key string, result array<struct<id:bigint,similarity:double,rank:int>>, ts double, ttl_s double"

    def query(self, queries: DataFrame, mode: str = "simple") -> tuple[DataFrame, CachedKnowledgeBase]:
        """(answers, the base with what was computed in its cache). ``queries`` also have query_text."""
        if not self.use_cache:
            return self.base.query(queries, mode).select("query_id", "id", "similarity", "rank").withColumn("cached", F.lit(False)), self
        b = self.base
        answers, puts = retrieval.get_or_compute(self.cache, queries, lambda lost: b.query(lost, mode), b.now, self.ttl, b.k, b.threshold, mode)
        return answers, replace(self, cache=self.cache.unionByName(puts))

    def add(self, entries: DataFrame) -> CachedKnowledgeBase:
        """With more entries; an id that is there already is replaced."""
        kept = knowledge.removed(self.base.entries, entries).unionByName(entries)
        return replace(self, base=replace(self.base, entries=kept), cache=self.cache.limit(0))
