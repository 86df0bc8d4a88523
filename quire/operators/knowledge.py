"""Knowledge in three tiers: adding to all of them, removing, cleaning up, and the state of the system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import vector as V

from . import cache, lifecycle, search
from .search import mean_vectors

STRATEGIES = ("oldest", "least_used", "relevance", "forgetting_curve")


def added(items: DataFrame, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(long-term entries, working-memory adds, short-term rows) of new knowledge.

    ``items`` have text, and may have source, importance (an explicit mark) and metadata; what is
    given in metadata stands above the defaults. Empty texts are none. Ids are made of source and
    text, so adding again changes nothing. The working tier's priority is the importance.
    """
    have = set(items.columns)
    source = F.coalesce(F.col("source"), F.lit("unknown")) if "source" in have else F.lit("unknown")
    explicit = F.col("importance").cast("double") if "importance" in have else None
    own = F.col("metadata") if "metadata" in have else F.create_map().cast("map<string,string>")
    rows = items.where(F.length(F.trim("text")) > 0).withColumn("_importance", T.initial_importance("text", source, explicit)).withColumn("_source", source)
    base = F.create_map(F.lit("source"), F.col("_source"), F.lit("timestamp"), F.lit(str(now)), F.lit("access_count"), F.lit("0"), F.lit("importance"), F.round("_importance", 6).cast("string"))
    rows = rows.select(lifecycle.entry_id("_source", "text").alias("id"), "text", lifecycle.merge_metadata(base, own).alias("metadata"), F.round("_importance", 6).alias("importance")).dropDuplicates(["id"])
    working = rows.select("id", F.lit("add").alias("op"), F.col("importance").alias("priority"), F.lit(now).alias("ts"))
    return rows.select("id", "text", "metadata"), working, rows.select("id", "text", F.lit(now).alias("ts"))


def removed(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries without those of the ids; ids that are not there change nothing."""
    return entries.join(ids.select("id").distinct(), "id", "left_anti")


def removals(ids: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(index deletes, working-memory removals) that go to the logs when entries are removed."""
    one = ids.select("id").where("id is not null").distinct()
    return one.select("id", F.lit("delete").alias("op")), one.select("id", F.lit("remove").alias("op"), F.lit(None).cast("double").alias("priority"), F.lit(now).alias("ts"))


def relevance(entries: DataFrame, probes: int = 10, vector: str = "embedding") -> DataFrame:
    """Entries with ``near``: minus the squared distance to the mean of the ``probes`` entries of smallest hash; null without a vector."""
    some = entries.where(F.col(vector).isNotNull()).orderBy(F.md5(F.col("id").cast("string")), "id").limit(probes)
    probe = mean_vectors(some.select(F.lit(0).alias("one"), vector), "one", vector).select(F.col("centroid").alias("_probe"))
    held = probe.agg(F.first("_probe").alias("_probe"))
    return entries.crossJoin(F.broadcast(held)).withColumn("near", -F.round(V.squared_distance(vector, "_probe"), 6)).drop("_probe")


def clean_up(entries: DataFrame, strategy: str, most: int, now: float, share: float = 0.8) -> DataFrame:
    """Entries that stay by a strategy. Columns of entries: id, ts, access_count, importance, and embedding for relevance.

    ``oldest``, ``least_used`` and ``relevance`` trim to ``share`` of ``most`` when there are more;
    ``forgetting_curve`` drops what is retained under 0.3, however many there are. An unknown
    strategy is ``oldest``.
    """
    if strategy == "forgetting_curve":
        kept = lifecycle.retention("importance", "access_count", (F.lit(now) - F.coalesce("ts", F.lit(now))) / lifecycle.DAY)
        return entries.where(kept >= 0.3)
    if strategy == "relevance":
        return lifecycle.trim(relevance(entries), "near", most, share=share).drop("near")
    return lifecycle.trim(entries, "access_count" if strategy == "least_used" else "ts", most, share=share)


def forget(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft forgetting: the importance of the ids falls to 0.3 of it, 0.1 at least, and they are marked."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    both = entries.join(hit, "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    return both.withColumn("importance", F.when(F.col("_hit"), lifecycle.forgotten_importance("importance")).otherwise(F.col("importance"))).withColumn("forgotten", F.col("_hit")).drop("_hit")


def system_status(short_term: DataFrame, working: DataFrame, long_term: DataFrame, index_log: DataFrame, gets: DataFrame, capacities: tuple[int, int, int] = (100, 500, 10000)) -> DataFrame:
    """One row for each figure: part, name, value. Tiers' sizes and use, the index's rows, the cache's ratios."""

    def long(df: DataFrame, part: str) -> DataFrame:
        names = [c for c in df.columns if c != "tier"]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names]))
        return df.select(F.lit(part).alias("part"), pairs.alias("p")).select("part", "p.name", "p.value")

    tiers = [long(lifecycle.tier_stats(df, n, name), name) for df, n, name in zip((short_term, working, long_term), capacities, ("short_term", "working", "long_term"))]
    out = tiers[0]
    for part in (*tiers[1:], long(search.index_stats(index_log), "index"), long(cache.stats(gets), "cache")):
        out = out.unionByName(part)
    return out
