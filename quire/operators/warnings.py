"""Counts of logged warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def warning_counts(log: DataFrame, kind: str, known: list[str]) -> DataFrame:
    """Warnings of each known type; all others, null too, count as other_warnings."""
    name = F.when(F.col(kind).isin(*known), F.col(kind)).otherwise(F.lit("other_warnings"))
    return log.groupBy(name.alias("type")).agg(F.count("*").alias("n"))


def logged(rows: DataFrame, kind: str, message: str, at: str, enabled: bool = True) -> DataFrame:
    """Rows as warnings: type, message, ts. A monitor that is switched off logs nothing; rows without a message are none."""
    out = rows.where(F.col(message).isNotNull()).select(F.coalesce(F.col(kind), F.lit("other_warnings")).alias("type"), F.col(message).alias("message"), F.col(at).cast("double").alias("ts"))
    return out if enabled else out.limit(0)


def since_reset(log: DataFrame, resets: DataFrame) -> DataFrame:
    """Warnings after the last reset (``resets``: ts); all of them where there was none."""
    last = resets.agg(F.max("ts").alias("_reset"))
    return log.crossJoin(F.broadcast(last)).where(F.col("_reset").isNull() | (F.col("ts") > F.col("_reset"))).drop("_reset")


def total(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n"))
