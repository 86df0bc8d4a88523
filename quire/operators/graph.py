"""Associations between entries: breadth-first expansion by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .search import top_k


def associations(entries: DataFrame, core: DataFrame, depth: int = 2, fan: int = 3, threshold: float = 0.0) -> DataFrame:
    """Edges src, dst, level, similarity found from the core entries, level by level.

    ``core`` has a column ``id``. Each entry of the frontier is linked to its ``fan`` most
    similar entries that no earlier level has visited; those are the next frontier. One
    batched search a level, whose edges are written before the next one starts from them, so
    that no level is searched twice; visited entries are excluded by an anti-join.
    """
    spark = entries.sparkSession
    kind = entries.schema["id"].dataType.simpleString()
    frontier, visited = core.select("id").distinct(), core.select("id").distinct()
    out = spark.createDataFrame([], f"src {kind}, dst {kind}, level int, similarity double")
    for level in range(depth):
        queries = entries.join(frontier, "id", "left_semi").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
        open_ = entries.join(visited, "id", "left_anti")
        hits = top_k(open_, queries, fan).where(F.col("similarity") >= threshold)
        edges = cut(hits.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.lit(level).alias("level"), "similarity"))
        out = out.unionAll(edges)
        frontier = edges.select(F.col("dst").alias("id")).distinct()
        visited = visited.unionAll(frontier).distinct()
    return out


def knowledge_graph(entries: DataFrame, core: DataFrame, topic: str, depth: int = 2, fan: int = 3) -> DataFrame:
    """The associations of a topic's core entries as nodes: topic, id, level (0 for the core), degree."""
    edges = associations(entries, core, depth, fan)
    nodes = core.select("id", F.lit(0).alias("level")).unionAll(edges.select(F.col("dst").alias("id"), (F.col("level") + 1).alias("level")))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    first = nodes.groupBy("id").agg(F.min("level").alias("level"))
    return first.join(ends, "id", "left").select(F.lit(topic).alias("topic"), "id", "level", F.coalesce("degree", F.lit(0)).alias("degree"))
