"""Extracting and processing typed blocks: one chain for each type, and all of them in one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import formulas as X
from quire.functions import tables as B
from quire.functions import text as T

from .blocks import TYPES


def processed_text(text: Column | str, keep_newlines: bool = False) -> Column:
    """White space normalised, then each line once; by default lines are joined, so the second step has one line."""
    return T.distinct_lines(T.normalize_space(text, keep_newlines))


def processed_table(rows: Column | str) -> Column:
    """Padded rows with blanks filled down; null where no row holds anything, which leaves a table as it was."""
    filled = B.fill_down(B.pad_rows(rows))
    return F.when(F.size(B.drop_empty_rows(rows)) > 0, filled)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def processed_formula(formula: Column | str, engine: Column | None = None) -> Column:
    """LaTeX of a formula with the delimiters of its kind; an outside engine's answer stands where there is one."""

    def shaped(bare: Column) -> Column:
        latex = F.when(X.is_latex(bare), bare).otherwise(X.to_latex(bare))
        return _with(latex if engine is None else F.coalesce(engine, latex), lambda own: X.delimit(own, bare))

    return _with(X.strip_delimiters(formula), shaped)


def extract(blocks: DataFrame) -> DataFrame:
    """Blocks with their payload and ``extracted``; unknown types are dropped.

    Texts are cleaned; a table without cells gets its empty grid (negative or unknown sizes have
    none); a formula's text is its content; images stay as they are.
    """
    kind = F.col("type")
    grid = B.placeholder(F.greatest(F.lit(0), F.coalesce("n_rows", F.lit(0))), F.greatest(F.lit(0), F.coalesce("n_columns", F.lit(0))))
    rows = blocks.where(kind.isin(*TYPES))
    out = rows.withColumn("content", F.when(kind == "text", T.clean_lines(F.coalesce("content", F.lit("")))).otherwise(F.col("content")))
    out = out.withColumn("table_data", F.when((kind == "table") & F.col("table_data").isNull(), grid).otherwise(F.col("table_data")))
    out = out.withColumn("formula_text", F.when(kind == "formula", F.coalesce("formula_text", "content", F.lit(""))).otherwise(F.col("formula_text")))
    return out.withColumn("extracted", F.lit(True))


def process(blocks: DataFrame, keep_newlines: bool = False, engine: str | None = None) -> DataFrame:
    """Blocks after the chain of their type, with ``processed``; unknown types and blocks without a payload pass as they are.

    ``engine`` names a column with an outside engine's LaTeX.
    """
    kind = F.col("type")
    table, latex = processed_table("table_data"), processed_formula("formula_text", None if engine is None else F.col(engine))
    has = F.when(kind == "text", F.col("content").isNotNull()).when(kind == "table", table.isNotNull()).when(kind == "formula", F.col("formula_text").isNotNull()).when(kind == "image", F.lit(True)).otherwise(F.lit(False))
    out = blocks.withColumn("processed", F.coalesce(has, F.lit(False)))
    done = lambda name: F.col("processed") & (kind == name)
    out = out.withColumn("content", F.when(done("text"), processed_text("content", keep_newlines)).otherwise(F.col("content")))
    out = out.withColumn("table_data", F.when(done("table"), table).otherwise(F.col("table_data"))).withColumn("markdown", F.when(done("table"), B.to_markdown("table_data")).otherwise(F.col("markdown")))
    return out.withColumn("latex", F.when(done("formula"), latex).otherwise(F.col("latex")))


def clip(readings: DataFrame, areas: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The text of each area of a page: area_id and text of the readings whose middle lies in it, in reading order.

    ``readings`` have doc, page, coordinates, text; ``areas`` doc, page, area_id, box. An area without a reading has an empty text.
    """
    at = lambda c, i: F.get(c, F.lit(i))
    mid = readings.where("size(coordinates) = 4").select(doc, "page", ((at("coordinates", 0) + at("coordinates", 2)) / 2).alias("x"), ((at("coordinates", 1) + at("coordinates", 3)) / 2).alias("y"), "text")
    inside = (F.col("x") >= at("box", 0)) & (F.col("x") <= at("box", 2)) & (F.col("y") >= at("box", 1)) & (F.col("y") <= at("box", 3))
    met = areas.join(mid, [doc, "page"], "left").select("area_id", F.when(inside, F.struct("y", "x", "text")).alias("r"))
    return met.groupBy("area_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"]), " ").alias("text"))
