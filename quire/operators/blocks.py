"""Typed content blocks: dispatch, reading order, integration into documents, and spatial rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import tables as B

TYPES = ("text", "image", "table", "formula")
IMAGE, TABLE, FORMULA, RULE = "[image]", "[table]", "[formula]", "---"


def dispatch(blocks: DataFrame, unknown: str = "drop") -> DataFrame:
    """Blocks of a known type; unknown ones are dropped, or passed with ``unknown='pass'``."""
    return blocks if unknown == "pass" else blocks.where(F.col("type").isin(*TYPES))


def position() -> tuple[Column, Column, Column]:
    """Page, top and left of a block; a missing page is 1, missing or malformed coordinates are 0."""
    whole = F.size("coordinates") >= 4
    return F.coalesce("page", F.lit(1)), F.when(whole, F.get("coordinates", F.lit(1))).otherwise(F.lit(0.0)), F.when(whole, F.get("coordinates", F.lit(0))).otherwise(F.lit(0.0))


def rendered() -> Column:
    """A block's text in a document, by type; empty text blocks have none."""
    text = F.trim(F.coalesce("content", F.lit("")))
    caption = F.concat(F.lit(f"{IMAGE}: "), F.coalesce("caption", F.lit("image")))
    image = F.when(F.length("extracted_text") > 0, F.concat(caption, F.lit("\n"), F.col("extracted_text"))).otherwise(caption)
    table = F.when(F.length("markdown") > 0, F.col("markdown")).otherwise(F.lit(TABLE))
    formula = F.when(F.length("latex") > 0, F.col("latex")).otherwise(F.coalesce("formula_text", F.lit(FORMULA)))
    return F.when(F.col("type") == "text", F.when(text != "", text)).when(F.col("type") == "image", image).when(F.col("type") == "table", table).when(F.col("type") == "formula", formula)


def integrate(blocks: DataFrame, doc: str = "doc_id", key: str = "block_id") -> DataFrame:
    """Each document's blocks in reading order as one text; a rule stands between pages, not after the last.

    Parts of a page are gathered first, then the pages. Columns: the document, n_blocks, text.
    """
    page, top, left = position()
    parts = dispatch(blocks).withColumn("part", rendered()).where("part is not null").select(doc, page.alias("page"), F.struct(top.alias("y"), left.alias("x"), F.col(key).alias("k"), "part").alias("p"))
    pages = parts.groupBy(doc, "page").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "\n\n").alias("body"))
    whole = pages.groupBy(doc).agg(F.sum("n").alias("n_blocks"), F.array_sort(F.collect_list(F.struct("page", "body"))).alias("pages"))
    return whole.select(doc, "n_blocks", F.array_join(F.transform("pages", lambda p: p["body"]), f"\n\n{RULE}\n\n").alias("text"))


def page_groups(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks of each type on each page."""
    count = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES]
    return blocks.groupBy(doc, F.coalesce("page", F.lit(1)).alias("page")).agg(F.count("*").alias("n_blocks"), *count)


def overlaps(blocks: DataFrame, least: float = 0.5, key: str = "block_id", doc: str = "doc_id") -> DataFrame:
    """Pairs of blocks of one page whose rectangles share ``least`` of the smaller one's area or more.

    Malformed rectangles and those without an area overlap nothing; blocks without a page or
    document lie on none. Columns: the document, page, a < b, share.
    """
    whole = blocks.where(F.size("coordinates") == 4).select(doc, "page", F.col(key).alias("k"), *[F.get("coordinates", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    whole = whole.where("x1 > x0 and y1 > y0 and page is not null").distinct()
    a, b = whole.alias("a"), whole.alias("b")
    pairs = a.join(b, (F.col(f"a.{doc}") == F.col(f"b.{doc}")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.k") < F.col("b.k")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1")))
    shared = (F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")) * (F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0"))
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    share = F.round(shared / F.least(area("a"), area("b")), 6)
    return pairs.select(F.col(f"a.{doc}").alias(doc), F.col("a.page").alias("page"), F.col("a.k").alias("a"), F.col("b.k").alias("b"), share.alias("share")).where(F.col("share") >= least)


def table_extent(lines: DataFrame, doc: str = "doc_id", tolerance: float = 2.0) -> DataFrame:
    """Tables drawn by three or more horizontal and vertical lines on a page: bounding box, rows, columns."""
    flat = F.abs(F.col("y0") - F.col("y1")) < tolerance
    upright = ~flat & (F.abs(F.col("x0") - F.col("x1")) < tolerance)
    on = lambda c, x: F.when(c, x)
    out = lines.groupBy(doc, "page").agg(
        F.count_if(flat).alias("h"), F.count_if(upright).alias("v"),
        F.min(on(upright, F.least("x0", "x1"))).alias("x_min"), F.min(on(flat, F.least("y0", "y1"))).alias("y_min"),
        F.max(on(upright, F.greatest("x0", "x1"))).alias("x_max"), F.max(on(flat, F.greatest("y0", "y1"))).alias("y_max"),
        F.countDistinct(on(flat, F.round("y0", 1))).alias("ys"), F.countDistinct(on(upright, F.round("x0", 1))).alias("xs"),
    )
    return out.where("h >= 3 and v >= 3").select(doc, "page", "x_min", "y_min", "x_max", "y_max", F.greatest(F.lit(1), F.col("ys") - 1).alias("n_rows"), F.greatest(F.lit(1), F.col("xs") - 1).alias("n_columns"))


def locate_formulas(formulas: DataFrame, texts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The text block of its page that a formula stands in: one that contains it, else the one that shares most characters, if over half.

    ``formulas``: doc, page, formula_id, formula; ``texts``: doc, page, block_id, content.
    """
    both = formulas.where("length(formula) > 0").join(texts.where("content is not null"), [doc, "page"])
    inside = F.contains("content", F.col("formula"))
    shared = F.size(F.filter(F.split("formula", ""), lambda c: (c != "") & F.contains(F.col("content"), c))) / F.length("formula")
    scored = both.select(doc, "page", "formula_id", "block_id", F.when(inside, 2.0).otherwise(F.round(shared, 6)).alias("score")).where("score > 0.5")
    best = scored.groupBy(doc, "page", "formula_id").agg(F.max("score").alias("score"), F.min_by("block_id", F.struct(-F.col("score"), "block_id")).alias("block_id"))
    return best.select(doc, "page", "formula_id", "block_id", F.when(F.col("score") == 2.0, "contained").otherwise("similar").alias("kind"))


def confidence(readings: DataFrame, key: str, conf: str, high: float = 0.6, llm: bool = False, knowledge: bool = False) -> DataFrame:
    """Confidence of a reading: mean of the high ones, else of all, else 0.6; raised by the aids used; in [0.6, 1]."""
    base = F.coalesce(F.avg(F.when(F.col(conf) >= high, F.col(conf))), F.avg(conf), F.lit(0.6))
    raised = base * (1.25 if llm else 1.0) * (1.15 if knowledge else 1.0)
    return readings.groupBy(key).agg(F.round(F.greatest(F.lit(0.6), F.least(F.lit(1.0), raised)), 9).alias("confidence"))


def banding(readings: DataFrame, key: str, conf: str, text: str, order: str) -> DataFrame:
    """Readings in bands high (0.6 on), mid (0.1 on) and low: counts, and the high ones' text in order."""
    band = F.when(F.col(conf) >= 0.6, "high").when(F.col(conf) >= 0.1, "mid").otherwise("low")
    r = readings.withColumn("band", band)
    high = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("band") == "high", F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))), lambda x: x["t"]), " ")
    return r.groupBy(key).agg(*[F.count_if(F.col("band") == b).alias(f"n_{b}") for b in ("high", "mid", "low")], high.alias("high_text"))


def enhancement_confidence(hits: DataFrame, key: str, similarity: str) -> DataFrame:
    """min(0.5 + mean similarity / 2 + 0.2, 0.98); 0.5 without a hit."""
    return hits.groupBy(key).agg(F.round(F.when(F.count(similarity) == 0, 0.5).otherwise(F.least(F.avg(similarity) / 2 + 0.5 + 0.2, F.lit(0.98))), 6).alias("confidence"))


def paragraphs(blocks: DataFrame, key: str = "block_id") -> DataFrame:
    """Text blocks cut at blank lines: the block, place (from 0), paragraph."""
    return blocks.where("type = 'text' and content is not null").select(key, F.posexplode(F.split("content", "\n\n")).alias("place", "paragraph"))


def to_html(text: Column | str) -> Column:
    """An integrated text as HTML, part by part: tables, display formulas, images, rules and paragraphs."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, "\n\n")

    def part(p: Column) -> Column:
        formula = p.startswith("$$") | p.startswith("\\[") | p.startswith("\\begin{")
        return (
            F.when(p.startswith("|"), B.markdown_to_html(p))
            .when(formula, F.concat(F.lit('<div class="formula">'), p, F.lit("</div>")))
            .when(p.startswith(IMAGE), F.concat(F.lit("<figure>"), p, F.lit("</figure>")))
            .when(p == RULE, F.lit("<hr>"))
            .otherwise(F.concat(F.lit("<p>"), p, F.lit("</p>")))
        )

    return F.array_join(F.transform(F.filter(parts, lambda p: F.trim(p) != ""), part), "\n")
