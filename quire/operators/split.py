"""Splitting texts by structure and by length."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from statistics import mean, stdev

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# Forms of header lines and of their beginnings, and the sizes.
HEADERS = [r"^#+\s+.+$", r"^第\s*[一二三四五六七八九十百千万\d]+\s*[章节篇部].*$", r"^Chapter\s+\d+.*$", r"^\d+\.\d+\s+.+$", r"^\d+\.\s+.+$", r"^[A-Z]\.\s+.+$", r"^[IVXivx]+\.\s+.+$"]
FAMILIES = [r"^\d+", r"^第\s*[一二三四五六七八九十百千万\d]+\s*[章节篇部]", r"^(?i:Chapter)\s+\d+", r"^#+\s+", r"^\d+\.\d+", r"^\d+\."]
CHUNK, OVERLAP, SAMPLE = 500, 100, 5000
SENTENCE = r"(?<=[。！？.!?])\s*"


def sizes(chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Chunk size of 200 at least, overlap of a quarter of it at most."""
    chunk = max(200, chunk)
    return chunk, min(overlap, chunk // 4)


def sentences(text: Column | str) -> Column:
    """The text cut after every sentence mark, blanks after it dropped; the last part can be empty."""
    return F.split(F.col(text) if isinstance(text, str) else text, SENTENCE)


def header_lines(df: DataFrame, key: str, text: str, sample: int | None = None) -> DataFrame:
    """Lines that have the form of a header: the key, line_no, form (from 0), line. ``sample``: of that many first characters only."""
    lines = df.select(key, F.posexplode(F.split(F.col(text) if sample is None else F.substring(text, 1, sample), "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    form = F.lit(None).cast("int")
    for i, rx in reversed(list(enumerate(HEADERS))):
        form = F.when(F.col("line").rlike(rx), F.lit(i)).otherwise(form)
    return lines.withColumn("form", form).where("form is not null").select(key, "line_no", "form", "line")


def line_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Mean and sample deviation of the lengths of the lines that are not blank."""
    lines = df.select(key, F.explode(F.split(text, "\n")).alias("line")).where(F.trim("line") != "").select(key, F.length(F.trim("line")).alias("n"))
    return lines.groupBy(key).agg(F.count("*").alias("n_lines"), F.round(F.avg("n"), 6).alias("mean_length"), F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 6).alias("deviation"))


def first_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """First words of under 10 characters that begin two or more lines of a text."""
    lines = df.select(key, F.explode(F.split(text, "\n")).alias("line")).where(F.trim("line") != "").select(key, F.split(F.trim("line"), " ")[0].alias("word"))
    return lines.groupBy(key, "word").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.length("word") < 10))


def split_at(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """A new segment at each line that has the pattern; what stands before the first is kept. The key, seg_no, text."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    seg = lines.withColumn("seg", F.sum(F.when(F.trim("line").rlike(pattern) & (F.col("line_no") > 0), 1).otherwise(0)).over(order))
    joined = seg.groupBy(key, "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return joined.select(key, F.col("seg").cast("int").alias("seg_no"), "text")


# Beginnings of chapter lines by kind, in order of preference.
CHAPTERS = [r"^# ", r"^第.*[章节篇部]", r"^(?i)chapter .*\d"]


def split_chapters(df: DataFrame, key: str, text: str) -> DataFrame:
    """Texts cut at their chapter lines, if two or more lines of one kind begin one: the key, seg_no, text.

    Lines are stripped; the first kind that has two is used; what stands before the first
    chapter is left out. Texts without chapters have no row.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, rf"^{T.SPACE}+|{T.SPACE}+$", ""))
    of = lambda rx: F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(rx))
    starts = F.coalesce(*[F.when(F.size(of(rx)) >= 2, of(rx)) for rx in CHAPTERS])
    rows = df.where(F.col(text).isNotNull()).select(key, lines.alias("lines")).withColumn("starts", starts).where("starts is not null")
    parts = F.transform("starts", lambda a, n: F.array_join(F.slice("lines", a + 1, F.coalesce(F.get("starts", n + 1), F.size("lines")) - a), "\n"))
    return rows.select(key, F.posexplode(parts).alias("seg_no", "text"))


def detect_patterns(text: str, sample: int = SAMPLE) -> list[str]:
    """Patterns of header beginnings that two or more header lines share, by form or else by the lines' features.

    The reference looks at the first 5,000 characters to learn the patterns; they then cut the whole text.
    """
    lines = [line.strip() for line in text[:sample].split("\n") if line.strip()]
    headers = [line for line in lines if any(re.match(h, line) for h in HEADERS)]
    if len(headers) < 2:
        headers = _by_features(lines)
    if len(headers) < 2:
        return []
    found = [f for f in FAMILIES if sum(bool(re.match(f, h)) for h in headers) >= 2]
    if not found:
        found = ["^" + re.escape(s) for s, n in Counter(h[:5] for h in headers).items() if n >= 2 and len(s) >= 2]
    return found


def _by_features(lines: list[str]) -> list[str]:
    size = [len(line) for line in lines]
    middle, spread = (mean(size) if size else 0), (stdev(size) if len(size) > 1 else 0)
    common = tuple(w for w, n in Counter(line.split(" ")[0] for line in lines).items() if n >= 2 and len(w) < 10)
    out = []
    for line in lines:
        short, starts, number = len(line) < middle - spread / 2, bool(common) and line.startswith(common), any(map(str.isdigit, line))
        if len(line) < 100 and (short and (starts or number) or starts and number):
            out.append(line)
    return out


def by_patterns(text: str, patterns: list[str]) -> list[str]:
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if out[-1] and any(re.match(p, line.strip()) for p in patterns):
            out.append([])
        out[-1].append(line)
    return ["\n".join(part) for part in out]


def tail(text: str, size: int) -> str:
    end = text[-size:] if size else ""
    at = end.find("。") if "。" in end else end.find(".")
    return end[at + 1 :] if at >= 0 else end


def by_length(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Whole sentences packed into chunks; a longer sentence is cut hard with a stride of chunk - overlap."""
    if len(text) <= chunk:
        return [text]
    out, now = [], ""
    for sentence in re.split(SENTENCE, text):
        if len(sentence) > chunk:
            if now:
                out.append(now)
            out += [sentence[a : a + chunk] for a in range(0, len(sentence), chunk - overlap)]
            now = ""
        elif len(now) + len(sentence) > chunk:
            if now:
                out.append(now)
            now = tail(now, overlap) + sentence if now else sentence
        else:
            now = f"{now} {sentence}" if now else sentence
    return [*out, now] if now else out


def split_text(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """By structure if the text is longer than a chunk and has one, then by length what is still too long."""
    parts = [text]
    if len(text) > chunk and (patterns := detect_patterns(text)):
        parts = by_patterns(text, patterns)
    return [piece for part in parts for piece in by_length(part, chunk, overlap)]


def split_texts(df: DataFrame, key: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The key, seg_no and text of each segment. Null and empty texts have none."""
    chunk, overlap = sizes(chunk, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_text(t, chunk, overlap) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "parts": pa.array(parts, pa.list_(pa.string()))})

    rows = df.select(F.col(key).cast("string").alias("row"), F.col(text).alias("text")).where(F.length("text") > 0)
    out = rows.mapInArrow(run, "row string, parts array<string>")
    return out.select(F.col("row").cast(df.schema[key].dataType).alias(key), F.posexplode("parts").alias("seg_no", "text"))
