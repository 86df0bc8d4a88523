"""Importance, reinforcement, forgetting and eviction as expressions and windows over state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

from .lineage import cut

HALF_DAY = 12 * 3600.0
DAY = 86400.0
#: Rows that a range has on average when ranks are counted.
RANGE_ROWS = 500_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(metadata: Column | str, name: str) -> Column:
    """A number kept as a string in a map; null where it is missing or no number."""
    return F.expr(f"try_cast({metadata}['{name}'] as double)") if isinstance(metadata, str) else F.try_to_number(metadata[name])


def eviction_score(base: Column | str, access: Column | str, idle: Column | str) -> Column:
    """0.6 * base + min(0.4, 0.02 * accesses) + 0.4 * exp(-idle / 12 h); the lowest is evicted."""
    return _col(base) * 0.6 + F.least(F.lit(0.4), _col(access) * 0.02) + F.exp(-_col(idle) / HALF_DAY) * 0.4


def recomputed_priority(base: Column | str, access: Column | str, idle: Column | str) -> Column:
    return F.least(F.lit(1.0), _col(base) * 0.5 + F.least(F.lit(0.3), _col(access) * 0.02) + F.exp(-_col(idle) / HALF_DAY) * 0.2)


def reinforced(importance: Column | str, factor: float = 1.0) -> Column:
    return F.least(F.lit(1.0), _col(importance) * 1.5 * factor)


def accessed_importance(importance: Column | str, access: Column | str) -> Column:
    return F.least(F.lit(1.0), _col(importance) * (F.least(_col(access), F.lit(100)) * 0.01 + 1))


def retention(importance: Column | str, access: Column | str, days: Column | str) -> Column:
    """exp(-0.1 * days / strength) with strength = importance * (1 + 0.2 * min(accesses, 10))."""
    strength = _col(importance) * (F.least(_col(access), F.lit(10)) * 0.2 + 1)
    return F.when(strength > 0, F.exp(-_col(days) * 0.1 / strength)).otherwise(F.lit(0.0))


def forgotten_importance(importance: Column | str) -> Column:
    return F.greatest(_col(importance) * 0.3, F.lit(0.1))


def access_counts(log: DataFrame, key: str, ts: str) -> DataFrame:
    """Accesses and the last one of each key, from the log."""
    return log.groupBy(key).agg(F.count("*").alias("access_count"), F.max(ts).alias("last_accessed"))


def _nth(entries: DataFrame, order: str, key: str, n: int, total: int) -> tuple:
    """The n-th smallest (order, key) of all rows, nulls first.

    The two columns are dealt into ranges of bounded size and counted; only the range that
    holds the n-th row is sorted. One row of it comes to the driver, and a count a range.
    """
    first = F.col("o").asc_nulls_first()
    pairs = entries.select(F.col(order).alias("o"), F.col(key).alias("k"))
    ranged = cut(pairs.repartitionByRange(max(1, -(-total // RANGE_ROWS)), first, "k").withColumn("p", F.spark_partition_id()))
    for p, size in sorted((r.p, r.n) for r in ranged.groupBy("p").agg(F.count("*").alias("n")).collect()):
        if n <= size:
            row = ranged.where(F.col("p") == p).orderBy(first, "k").offset(n - 1).limit(1).first()
            return row.o, row.k
        n -= size
    raise ValueError("fewer rows than that")


def trim(entries: DataFrame, order: str, most: int, key: str = "id", share: float = 0.8) -> DataFrame:
    """Entries that stay when more than ``most`` are trimmed to ``share`` of it, lowest ``order`` first, ties by key.

    Nulls of ``order`` go first. Keys are unique and not null. The last entry that goes is found
    by counting ranges; what stays is then a filter, without a sort or join of the entries.
    """
    total = entries.count()
    drop = total - int(share * most) if total > most else 0
    if drop <= 0:
        return entries
    value, last = _nth(entries, order, key, drop, total)
    behind = F.col(key) > F.lit(last)
    if value is None:
        return entries.where(F.col(order).isNotNull() | behind)
    kind = entries.schema[order].dataType
    return entries.where((F.col(order) > F.lit(value).cast(kind)) | ((F.col(order) == F.lit(value).cast(kind)) & behind))


def recent(log: DataFrame, order: str, capacity: int, n: int) -> DataFrame:
    """The last n items of a ring of ``capacity``, in order of arrival."""
    return log.orderBy(F.desc(order)).limit(min(capacity, n)).orderBy(order)


def top_priority(log: DataFrame, key: str, order: str, priority: str, n: int) -> DataFrame:
    """The n keys of highest latest priority, ties by key."""
    last = log.groupBy(key).agg(F.max_by(priority, order).alias(priority))
    return last.orderBy(F.desc(priority), key).limit(n)


def merge_metadata(old: Column | str, new: Column | str) -> Column:
    """Both maps; where both have a name the new value stands."""
    o, n = _col(old), _col(new)
    return F.map_concat(F.map_filter(F.coalesce(o, F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key(n, k), F.lit(False))), F.coalesce(n, F.create_map().cast("map<string,string>")))


def tier_stats(sizes: DataFrame, capacity: int, tier: str) -> DataFrame:
    return sizes.agg(F.least(F.count("*"), F.lit(capacity)).alias("used")).select(F.lit(tier).alias("tier"), F.lit(capacity).alias("capacity"), "used", F.round(F.col("used") / capacity * 100, 4).alias("usage_percent"))



def entry_id(*parts: Column | str) -> Column:
    """A deterministic id of an entry from what identifies it; nulls count as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]), 256)


def added_segments(segments: DataFrame, now: float, source: str = "unknown", keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts as new entries: id, text and metadata with source, timestamp, access_count and importance as strings.

    ``segments`` has doc_id, seg_no, text; empty texts are no entries. Columns to ``keep`` stand behind.
    """
    meta = F.create_map(
        F.lit("source"), F.lit(source), F.lit("timestamp"), F.lit(str(now)), F.lit("access_count"), F.lit("0"), F.lit("importance"), T.initial_importance("text", F.lit(source)).cast("string"), F.lit("index"), F.coalesce(F.col("seg_no").cast("string"), F.lit("0"))
    )
    return segments.where(F.length(F.trim("text")) > 0).select(entry_id("doc_id", "seg_no", "text").alias("id"), "text", meta.alias("metadata"), *keep)


def indexed_blocks(blocks: DataFrame) -> DataFrame:
    """One entry for each block with content: id, text and metadata with source, document_id and type."""
    meta = F.create_map(F.lit("source"), F.coalesce("source", F.lit("unknown")), F.lit("document_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("type"), F.col("type"))
    return blocks.where(F.length(F.trim("content")) > 0).select(entry_id("block_id").alias("id"), F.col("content").alias("text"), meta.alias("metadata"))


def updated(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries with changes applied: a new text where one is given, metadata merged (new wins). ``changes``: id, new_text, new_metadata."""
    both = entries.join(changes, "id", "left")
    return both.withColumn("text", F.coalesce("new_text", "text")).withColumn("metadata", merge_metadata("metadata", "new_metadata")).drop("new_text", "new_metadata")


def access_update(entries: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Entries with the accesses of the log added to their counts; ``log``: id, ts."""
    seen = access_counts(log.select(key, "ts"), key, "ts").withColumnRenamed("access_count", "_n")
    return entries.join(seen, key, "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")
