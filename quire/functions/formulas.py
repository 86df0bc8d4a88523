"""Expressions on formulas."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Literal rewrites in their order, then patterns; commands that show LaTeX; kinds of formulas in text.
REWRITES = [("sqrt", r"\sqrt"), ("alpha", r"\alpha"), ("beta", r"\beta"), ("gamma", r"\gamma"), ("theta", r"\theta"), ("pi", r"\pi"), ("inf", r"\infty"), ("<=", r"\leq"), (">=", r"\geq"), ("!=", r"\neq"), ("~=", r"\approx"), ("cross", r"\times")]
PATTERNS = [(r"(\d+)\^(\d+)", "$1^{$2}"), (r"([a-zA-Z])\^(\d+)", "$1^{$2}"), (r"(\d+)/(\d+)", r"\\frac{$1}{$2}")]
COMMANDS = [r"\frac", r"\sqrt", r"\sum", r"\int", r"\prod", r"\alpha", r"\beta", r"\gamma", r"\theta", r"\pi", r"\infty", r"\partial", r"\nabla", r"\Delta", r"\Sigma", r"\Omega"]
FORMS = [r"\$\$.+?\$\$", r"\$.+?\$", r"\\begin\{equation\}.+?\\end\{equation\}", r"\\begin\{align\}.+?\\end\{align\}", "[=><∑∫∏√∞±≤≥≈≠∂∆∇∀∃∈∉⊂⊃∪∩]"]
GAP = 20


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_delimiters(formula: Column | str) -> Column:
    """The formula without blanks around it and without its own delimiters or equation environment."""
    t = F.regexp_replace(_col(formula), r"^\s+|\s+$", "")
    return (
        F.when(t.rlike(r"(?s)^\$\$.*\$\$$") & (F.length(t) >= 4), F.substring(t, F.lit(3), F.length(t) - 4))
        .when(t.rlike(r"(?s)^\$.*\$$") & (F.length(t) >= 2), F.substring(t, F.lit(2), F.length(t) - 2))
        .when(t.startswith(r"\begin{equation}") & t.endswith(r"\end{equation}"), F.substring(t, F.lit(17), F.length(t) - 30))
        .otherwise(t)
    )


def to_latex(formula: Column | str, whole_words: bool = False) -> Column:
    """Names and relations as LaTeX commands, powers and fractions in braces, in a fixed order.

    By default names are also rewritten inside longer words; ``whole_words`` leaves those alone.
    """
    out = _col(formula)
    for name, command in REWRITES:
        if whole_words and name.isalpha():
            out = F.regexp_replace(out, rf"(?<![A-Za-z\\]){name}(?![A-Za-z])", command.replace("\\", r"\\"))
        else:
            out = F.replace(out, F.lit(name), F.lit(command))
    for pattern, to in PATTERNS:
        out = F.regexp_replace(out, pattern, to)
    return out


def is_latex(text: Column | str) -> Column:
    hit = F.lit(False)
    for command in COMMANDS:
        hit = hit | F.contains(_col(text), F.lit(command))
    return hit


def delimit(latex: Column | str, original: Column | str) -> Column:
    """Inline delimiters for a single line of under 50 characters, else display delimiters."""
    t = _col(latex)
    bare = F.when(t.startswith("$$") & t.endswith("$$") & (F.length(t) >= 4), F.substring(t, F.lit(3), F.length(t) - 4)).when(t.startswith("$") & t.endswith("$") & (F.length(t) >= 2), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    inline = ~F.contains(_col(original), F.lit("\n")) & (F.length(_col(original)) < 50)
    return F.when(inline, F.concat(F.lit("$"), bare, F.lit("$"))).otherwise(F.concat(F.lit("$$"), bare, F.lit("$$")))


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [re.compile(f, re.S) for f in FORMS]
    region = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
    schema = pa.schema([("row", pa.string()), ("regions", pa.list_(region))])
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            hits = [(m.start(), m.end(), m.group()) for f in found for m in f.finditer(text) if m.group() not in "=><"]
            out.append([{"start": a, "end": b, "text": t} for a, b, t in sorted(hits)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(region))], schema=schema)


def detect(df: DataFrame, key: str, text: str) -> DataFrame:
    """Formula regions by form: the key, start, end (0-based), text. A lone relation sign is none."""
    rows = df.select(F.col(key).cast("string").alias("row"), F.col(text).alias("text")).where(F.length("text") > 0)
    out = rows.mapInArrow(_regions, "row string, regions array<struct<start:int,end:int,text:string>>")
    return out.select(F.col("row").cast(df.schema[key].dataType).alias(key), F.explode("regions").alias("r")).select(key, "r.start", "r.end", "r.text")


def merge_regions(regions: DataFrame, key: str, gap: int = GAP) -> DataFrame:
    """Regions that begin under ``gap`` characters after the furthest end so far, as one: the key, start, end, text."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("start", "end", "text")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = regions.withColumn("fresh", F.when(before.isNull() | (F.col("start") - before >= gap), 1).otherwise(0))
    island = flagged.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "text")))
    return island.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text")).drop("island")
