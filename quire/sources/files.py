"""Sources and sinks: input trees, admission, text with fallback decoding, link lists, exports and dumps."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import text as T

# Extensions of each category, those that are always admitted, and the size limit in MB.
CATEGORIES = {"pdf": ("pdf",), "images": ("jpg", "jpeg", "png"), "codes": ("py", "java", "js", "c", "cpp", "txt"), "links": ("txt",)}
ALWAYS = ("py", "java", "js", "c", "cpp", "txt", "md")
MAX_MB = 50.0
ORDER = ("pdf", "codes", "links", "images")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"\.([A-Za-z0-9]+)$", 1))


def admitted(size_mb: Column | str, path: Column | str, allowed: tuple[str, ...] = ("pdf", "jpg", "jpeg", "png"), most: float = MAX_MB) -> Column:
    """Whether a file may be read: of a known size up to the limit and an allowed extension; code and text always have one."""
    size = F.col(size_mb) if isinstance(size_mb, str) else size_mb
    return F.coalesce((size <= most) & extension(path).isin(*allowed, *ALWAYS), F.lit(False))


def scan_inputs(spark: SparkSession, root: str, most: float = MAX_MB) -> DataFrame:
    """Files below ``root`` by category: path, category, size_mb. Link lists are not searched in sub-folders. No content is read."""
    out = None
    for category, kinds in CATEGORIES.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(category != "links").lower()).option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(f"{root}/{category}")
        part = files.select("path", F.lit(category).alias("category"), (F.col("length") / 1048576).alias("size_mb")).where(F.col("size_mb") <= most)
        out = part if out is None else out.unionAll(part)
    return out


def decode(content: Column | str) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are none."""
    raw = F.col(content) if isinstance(content, str) else content
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))


def read_texts(spark: SparkSession, path: str, most: float = MAX_MB) -> DataFrame:
    """Text files up to the size limit: path, text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= int(most * 1048576)).select("path", decode("content").alias("text"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """One link for each line that is not blank: url, name."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")
    return lines.select("url", T.link_name("url").alias("name"))


def text_blocks(texts: DataFrame) -> DataFrame:
    """One text block for each file: page 1, no place, full confidence."""
    return texts.select(F.sha2("path", 256).alias("block_id"), F.col("path").alias("source"), F.lit("text").alias("type"), F.lit(1).alias("page"), F.array(*[F.lit(0.0)] * 4).alias("coordinates"), F.col("text").alias("content"), F.lit(1.0).alias("confidence"))


def tagged(texts: DataFrame) -> DataFrame:
    """Texts with their source's tag before them, in the order of categories: src_order, source, text. ``texts``: category, source, text."""
    order = F.array_position(F.array(*[F.lit(c) for c in ORDER]), F.col("category")).cast("int")
    kept = texts.where(F.length("text") > 0)
    return kept.select(order.alias("src_order"), "source", F.concat(F.lit("["), F.col("category"), F.lit(": "), F.col("source"), F.lit("]\n"), F.col("text")).alias("text"))


def with_provider(df: DataFrame, run: Callable[[pd.Series], pd.Series] | None, column: str, to: str, kind: str = "string") -> DataFrame:
    """A column made by an outside model (embeddings, readings, answers); null where none is given. Called on Arrow batches."""
    if run is None:
        return df.withColumn(to, F.lit(None).cast(kind))
    return df.withColumn(to, F.pandas_udf(run, kind)(F.col(column)))


def hashed_vectors(dim: int = 64) -> Callable[[pd.Series], pd.Series]:
    """A stand-in for an embedding model: hashed term frequencies of unit length. No substitute for one in meaning."""
    import math
    import zlib

    def one(text: str | None) -> list[float] | None:
        if not text:
            return None
        v = [0.0] * dim
        for w in text.lower().split():
            v[zlib.crc32(w.encode()) % dim] += 1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else None

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


def dump_embeddings(df: DataFrame, text: str, vector: str, path: str, model: str, dim: int) -> None:
    """JSON of each distinct text with its vector, keyed by the text's md5."""
    rows = df.where(F.col(text).isNotNull()).select(F.md5(text).alias("key"), F.col(text).alias("text"), F.col(vector).alias("embedding"), F.lit(model).alias("model"), F.lit(dim).alias("dimension"))
    rows.dropDuplicates(["key"]).write.mode("overwrite").json(path)


def export_entries(entries: DataFrame, path: str, form: str = "parquet") -> None:
    """A snapshot of the entries; memory, index and cache tables are written alike."""
    entries.write.mode("overwrite").format(form).save(path)


def import_entries(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema else reader).load(path)


def backup(entries: DataFrame, root: str, day: str) -> str:
    """A dated snapshot below ``root``; its path."""
    path = f"{root}/dt={day}"
    export_entries(entries, path)
    return path


def export_memory(path: str, long_term: DataFrame, working: DataFrame, short_term: DataFrame, index_log: DataFrame, exported_at: float, version: str = "1") -> None:
    """A snapshot of all tiers and the index below ``path``, one folder each, with a manifest of what is in it.

    The manifest is written last: a snapshot without one is not whole.
    """
    spark = long_term.sparkSession
    parts = {"long_term": long_term, "working": working, "short_term": short_term, "index": index_log}
    rows = []
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((version, exported_at, name, spark.read.parquet(f"{path}/{name}").count(), df.schema.json()))
    spark.createDataFrame(rows, "version string, exported_at double, part string, n_rows long, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def import_memory(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of a snapshot by name; one whose rows are not those of its manifest is an error."""
    from pyspark.sql.types import StructType

    out = {}
    for r in spark.read.json(f"{path}/manifest").collect():
        df = spark.read.schema(StructType.fromJson(json.loads(r.schema))).parquet(f"{path}/{r.part}")
        if df.count() != r.n_rows:
            raise EngineError(f"{r.part} has not the {r.n_rows} rows of its manifest")
        out[r.part] = df
    return out


def due(spark: SparkSession, root: str, day: str, every_days: int = 7) -> bool:
    """Whether the last dated snapshot below ``root`` is ``every_days`` or more before ``day``, or there is none."""
    from pyspark.errors import AnalysisException

    try:
        last = spark.read.parquet(root).agg(F.max("dt").cast("string")).first()[0]
    except AnalysisException:
        return True
    return last is None or (date.fromisoformat(day) - date.fromisoformat(last)).days >= every_days


def backup_if_due(entries: DataFrame, root: str, day: str, every_days: int = 7) -> str | None:
    """A dated snapshot, if the interval has passed; its path."""
    return backup(entries, root, day) if due(entries.sparkSession, root, day, every_days) else None


def rebuild(segments: DataFrame, path: str) -> DataFrame:
    """The stored table made anew from segments, which are read before the old rows go; the stored rows."""
    spark = segments.sparkSession
    segments.write.mode("overwrite").parquet(f"{path}.new")
    spark.read.parquet(f"{path}.new").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def dump_preprocessed(texts: DataFrame, path: str) -> None:
    """Preprocessed texts as JSON lines in a folder for each category: name, text. Null and empty texts are left out."""
    texts.where(F.length("text") > 0).select("category", "name", "text").write.mode("overwrite").partitionBy("category").json(path)


def write_notes(notes: DataFrame, path: str, text: str = "text", by: str | None = None) -> None:
    """Notes as text files, in a folder for each value of ``by``."""
    kept = notes.select(*([by] if by else []), text)
    writer = kept.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def clear(path: str, spark: SparkSession, schema: str) -> None:
    """An empty table in the place of the stored one."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def valid_images(df: DataFrame, key: str, pixels: str, height: str, width: str) -> DataFrame:
    """Images of 100 pixels or more a side whose grey values vary (deviation 5 on) and are not nearly all white (5 % under 240)."""
    import numpy as np

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = []
            for raw, h, w in zip(f[pixels], f[height], f[width]):
                if raw is None or min(h, w) < 100 or len(raw) < h * w:
                    ok.append(False)
                    continue
                grey = np.frombuffer(raw, dtype=np.uint8)[: h * w * (len(raw) // (h * w))].reshape(h * w, -1).mean(axis=1)
                ok.append(bool(grey.std() >= 5 and (grey < 240).mean() >= 0.05))
            yield pd.DataFrame({key: f[key], "valid": ok})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, pixels, height, width).mapInPandas(run, f"{key} {kind}, valid boolean")
