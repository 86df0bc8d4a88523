"""Query cache as a log: hits within their time to live, statistics, and folds for capacity and similarity."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.errors import CacheError


def ttl_hits(log: DataFrame) -> DataFrame:
    """Each get with the age of the put before it and its kind: exact, expired or miss.

    ``log`` has log_no, key, op (get, put, evict), ttl_s and ts (epoch seconds). Without a
    capacity the last put or evict of the key decides. An age over the time to live is
    expired; without one an entry never expires. Rows without a key are no accesses.
    """
    order = Window.partitionBy("key").orderBy("ts", "log_no").rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(F.col("op").isin("put", "evict"), F.struct(F.col("op").alias("op"), F.col("ts").alias("ts"), F.col("ttl_s").alias("ttl")))
    seen = log.where("key is not null and ts is not null").withColumn("state", F.last(state, ignorenulls=True).over(order)).where("op = 'get'")
    age = F.when(F.col("state.op") == "put", F.round(F.col("ts") - F.col("state.ts"), 3))
    kind = F.when(age.isNull(), "miss").when(F.col("state.ttl").isNotNull() & (age > F.col("state.ttl")), "expired").otherwise("exact")
    return seen.select("log_no", "key", age.alias("age_s"), kind.alias("kind"))


def stats(gets: DataFrame) -> DataFrame:
    """Hits, misses and ratios over all gets; the ratio's divisor is at least 1."""
    n = F.greatest(F.count("*"), F.lit(1))
    share = lambda kind: F.round(F.count_if(F.col("kind") == kind) / n, 6)
    return gets.agg(F.count("*").alias("queries"), F.count_if(F.col("kind") == "exact").alias("hits"), share("exact").alias("exact_ratio"), share("expired").alias("expired_ratio"), share("miss").alias("miss_ratio"))


def unexpired(log: DataFrame, now: float) -> DataFrame:
    """Entries whose last change is a put that is not older than its time to live."""
    last = log.where("op in ('put', 'evict') and key is not null and ts is not null").groupBy("key").agg(F.max_by(F.struct("op", "ts", "ttl_s"), F.struct("ts", "log_no")).alias("s"))
    live = last.where("s.op = 'put'").where(F.col("s.ttl_s").isNull() | (F.lit(now) - F.col("s.ts") <= F.col("s.ttl_s")))
    return live.select("key", F.round(F.lit(now) - F.col("s.ts"), 3).alias("age_s"))


def _fold(capacity: int, threshold: float | None):
    """Folds logs in order of shard and time; between batches only the entries of one cache are held."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: OrderedDict = OrderedDict()
        shard = object()
        for rows in pages:
            out = []
            for r in rows.itertuples(index=False):
                if r.shard != shard:
                    held.clear()
                    shard = r.shard
                vector = None if threshold is None or r.vector is None else list(map(float, r.vector))
                if r.op == "evict":
                    held.pop(r.key, None)
                elif r.op == "put":
                    # only a new key can exceed the capacity
                    if r.key not in held and len(held) >= capacity:
                        held.popitem(last=False)
                    held[r.key] = (r.ts, r.ttl_s, vector)
                    held.move_to_end(r.key)
                elif r.op == "get":
                    kind = "miss"
                    if r.key in held:
                        ts, ttl, _ = held[r.key]
                        if ttl == ttl and ttl is not None and r.ts - ts > ttl:
                            # an expired exact hit is deleted and is a miss; similarity is not tried
                            del held[r.key]
                            kind = "expired"
                        else:
                            held.move_to_end(r.key)
                            kind = "exact"
                    elif vector is not None:
                        best, key = threshold, None
                        for k, (ts, ttl, v) in held.items():
                            if v is None or len(v) != len(vector) or ttl == ttl and ttl is not None and r.ts - ts > ttl:
                                continue
                            a, b = sum(x * x for x in v) ** 0.5, sum(x * x for x in vector) ** 0.5
                            s = sum(x * y for x, y in zip(v, vector)) / (a * b) if a and b else 0.0
                            if s > best or s == best and key is None:
                                best, key = s, k
                        if key is not None:
                            held.move_to_end(key)
                            kind = "similar"
                    out.append((r.log_no, r.shard, r.key, kind))
            yield pd.DataFrame(out, columns=["log_no", "shard", "key", "kind"])

    return run


def fold(log: DataFrame, capacity: int, threshold: float | None = None, shards: int = 1, owner: str | None = None) -> DataFrame:
    """Gets with their kind under a capacity (least recently used goes) and, with ``threshold``, similarity.

    One cache of ``capacity`` entries, its log folded in order of time: each step depends on
    all before it, so the fold is one task, which holds the entries of the cache and no more
    of the log than a batch. ``owner`` names a column (a user, a tenant) whose values have a cache
    each; caches are folded side by side. ``shards`` above 1 asks for as many independent caches by
    hash of the key instead, each of ``capacity`` entries; a similar entry may be in any of them, so
    ``threshold`` has one cache an owner only. It needs a column ``vector``. Columns: log_no, shard,
    key, kind (exact, similar, expired, miss), and the owner where one is named; null is an owner too.
    """
    if shards != 1 and (threshold is not None or owner is not None):
        raise CacheError("similarity is searched in one cache, and owners have one each")
    given = log.where("key is not null and ts is not null")
    vector = [] if threshold is None else ["vector"]
    if owner is not None:
        dealt = given.select("log_no", "key", "op", "ttl_s", "ts", *vector, F.col(owner).cast("string").alias("shard")).repartition("shard")
        out = dealt.sortWithinPartitions("shard", "ts", "log_no").mapInPandas(_fold(capacity, threshold), "log_no long, shard string, key string, kind string")
        return out.select("log_no", F.col("shard").cast(log.schema[owner].dataType).alias(owner), "key", "kind")
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    dealt = given.withColumn("shard", shard).select("log_no", "key", "op", "ttl_s", "ts", *vector, "shard")
    order = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "ts", "log_no")
    return order.mapInPandas(_fold(capacity, threshold), "log_no long, shard int, key string, kind string")


def fold_stats(gets: DataFrame) -> DataFrame:
    """Figures of a fold: queries, and the counts and ratios of exact, similar, expired and missed gets."""
    n = F.greatest(F.count("*"), F.lit(1))
    kinds = ("exact", "similar", "expired", "miss")
    counts = [F.count_if(F.col("kind") == k) for k in kinds]
    return gets.agg(F.count("*").alias("queries"), *[c.alias(f"n_{k}") for k, c in zip(kinds, counts)], *[F.round(c / n, 6).alias(f"{k}_ratio") for k, c in zip(kinds, counts)])


def held_keys(log: DataFrame) -> DataFrame:
    """Keys that are in a cache without a capacity, whatever their age: those whose last change is a put."""
    last = log.where("op in ('put', 'evict') and key is not null and ts is not null").groupBy("key").agg(F.max_by("op", F.struct("ts", "log_no")).alias("op"))
    return last.where("op = 'put'").select("key")


def usage(log: DataFrame, capacity: int) -> DataFrame:
    """Size of the cache, expired entries too, its capacity and the share in use."""
    return held_keys(log).agg(F.least(F.count("*"), F.lit(capacity)).alias("size")).select("size", F.lit(capacity).alias("capacity"), F.round(F.col("size") / capacity, 6).alias("usage"))


def members(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Each wanted key and whether it is held; the time to live does not count."""
    return keys.select("key").distinct().join(held_keys(log).withColumn("held", F.lit(True)), "key", "left").select("key", F.coalesce("held", F.lit(False)).alias("held"))


def vector_key(vector: Column | str) -> Column:
    return F.md5(F.to_json(F.col(vector) if isinstance(vector, str) else vector))


def query_key(text: str) -> Column:
    return F.md5(F.col(text))
