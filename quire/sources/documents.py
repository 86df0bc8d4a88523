"""Documents made of typed blocks. What needs an outside program (PDF pages, readings of images, answers of models) is a
provider: a function given by the caller, run on Arrow batches, whose failures become an ``error`` column and never end a job."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.errors import ProviderError
from quire.functions import text as T
from quire.operators import blocks as K

from .files import CATEGORIES, MAX_MB, ORDER, decode, extension, read_links

BLOCK = "seq int, type string, page int, coordinates array<double>, content string, caption string, extraction_method string, image_data binary, confidence double"
IMAGES, TEXTS, PDFS = ("jpg", "jpeg", "png"), ("txt", "md", "py", "java", "js", "c", "cpp"), ("pdf",)
#: Points that an image region must have on a side, and the share of direct images under which regions are read too.
LEAST_SIDE, ENOUGH = 100.0, 0.5


def with_retry(call: Callable, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The call, repeated with doubled waits while it fails in a way that may pass; the last failure is raised.

    Each call starts from ``wait`` again. Other failures than ``ProviderError(again=True)``,
    ``ConnectionError`` and ``TimeoutError`` are raised at once.
    """

    def run(*args):
        pause = wait
        for left in range(tries - 1, -1, -1):
            try:
                return call(*args)
            except (ProviderError, ConnectionError, TimeoutError) as e:
                if not left or not getattr(e, "again", True):
                    raise
                # waits differ a little, so that tasks do not ask again all at once
                sleep(pause * random.uniform(0.9, 1.1))
                pause *= 2

    return run


def ask(df: DataFrame, column: str, run: Callable[[str], str] | None, to: str = "answer", tries: int = 3, wait: float = 1.0, strip: bool = True) -> DataFrame:
    """The rows with a model's answer to a column, and ``error`` where it failed; null prompts are not asked.

    Without a provider every answer is null and the error says so. Answers lose enclosing fences and quotes.
    """
    if run is None:
        return df.withColumn(to, F.lit(None).cast("string")).withColumn("error", F.lit("no provider"))

    def answers(prompts: pd.Series) -> pd.DataFrame:
        call, out = with_retry(run, tries, wait), []
        for prompt in prompts:
            try:
                out.append((None if prompt is None else call(prompt), None))
            except Exception as e:  # a provider's failure is a value
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["answer", "error"])

    got = df.withColumn("_got", F.pandas_udf(answers, "answer string, error string")(F.col(column)))
    answer = T.unwrap_answer("_got.answer") if strip else F.col("_got.answer")
    return got.withColumn(to, answer).withColumn("error", F.col("_got.error")).drop("_got")


def pages(files: DataFrame, read: Callable[[bytes], list[dict]] | None, extra: str = "") -> DataFrame:
    """What a provider reads from each file: path, the block's columns and error. ``files``: path, content.

    The provider gets a file's bytes and returns its blocks as dicts; missing names are null, ``seq``
    counts them. A file whose reading fails, and every file without a provider, is one row with an error.
    """
    schema = f"path string, {BLOCK}{extra}, error string"
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                try:
                    if read is None:
                        raise ProviderError("no provider")
                    rows = [{"path": path, "seq": i, **block} for i, block in enumerate(read(bytes(content)))]
                except Exception as e:  # one bad file is a row, not the end of the job
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def page_texts(files: DataFrame, read: Callable[[bytes], list[dict]] | None) -> DataFrame:
    """Each file's text: path, text, error. Pages in order, each with its tag before it, empty ones left out."""
    text = pages(files, read).where("error is not null or (type = 'text' and trim(content) <> '')")
    page = F.struct("page", "seq", F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("]\n"), F.col("content")).alias("t"))
    one = text.groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), page))).alias("p"), F.max("error").alias("error"))
    return one.select("path", F.when(F.col("error").isNull(), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")).alias("text"), "error")


def first_valid(attempts: DataFrame, key: str, order: str, valid: str) -> DataFrame:
    """Of each key's attempts (strategies, zooms) the first that is valid; keys without one have no row."""
    rest = [c for c in attempts.columns if c != key]
    best = attempts.where(F.coalesce(F.col(valid), F.lit(False))).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("s"))
    return best.select(key, *[F.col(f"s.{c}").alias(c) for c in rest])


def without_overlaps(rects: DataFrame, others: DataFrame, least: float = 0.5, doc: str = "doc_id") -> DataFrame:
    """The rectangles that share no ``least`` of the smaller area with one of the others on their page (an anti-join).

    Both have doc, page and coordinates, the first also a ``block_id``. Malformed rectangles overlap nothing.
    """

    def side(df: DataFrame, p: str, *more: str) -> DataFrame:
        corners = [F.get("coordinates", F.lit(i)).alias(f"{p}{n}") for i, n in enumerate(("x0", "y0", "x1", "y1"))]
        return df.where("size(coordinates) = 4 and page is not null").select(doc, "page", *more, *corners).where(f"{p}x1 > {p}x0 and {p}y1 > {p}y0")

    a, b = side(rects, "a", "block_id"), side(others, "b").distinct()
    shared = (F.least("ax1", "bx1") - F.greatest("ax0", "bx0")) * (F.least("ay1", "by1") - F.greatest("ay0", "by0"))
    area = F.least((F.col("ax1") - F.col("ax0")) * (F.col("ay1") - F.col("ay0")), (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")))
    met = a.join(b, [doc, "page"]).where("ax0 < bx1 and bx0 < ax1 and ay0 < by1 and by0 < ay1").where(shared / area >= least)
    return rects.join(met.select("block_id").distinct(), "block_id", "left_anti")


def image_blocks(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The images of each page out of what three ways of reading found: direct first, then regions, then the page's structure.

    ``found`` has block_id, doc, page, coordinates, extraction_method and valid (whether its pixels
    could be read). Regions count only on pages where under half of the direct ones are valid, and
    only where they overlap no direct one; structures of 100 points a side or more only where they
    overlap neither.
    """
    good = found.where("valid")
    way = lambda name: F.col("extraction_method") == name
    direct = good.where(way("direct"))
    poor = found.where(way("direct")).groupBy(doc, "page").agg(F.count("*").alias("n"), F.count_if("valid").alias("ok")).where(F.col("ok") < F.col("n") * ENOUGH).select(doc, "page")
    regions = without_overlaps(good.where(way("region")).join(poor, [doc, "page"], "left_semi").select(found.columns), direct, doc=doc)
    side = lambda a, b: F.get("coordinates", F.lit(b)) - F.get("coordinates", F.lit(a))
    wide = good.where(way("structure") & (F.size("coordinates") == 4)).where((side(0, 2) >= LEAST_SIDE) & (side(1, 3) >= LEAST_SIDE))
    kept = direct.unionByName(regions.select(direct.columns))
    return kept.unionByName(without_overlaps(wide, kept, doc=doc).select(direct.columns))


def embedded(df: DataFrame, column: str, run: Callable[[list[str]], list[list[float]]] | None, dim: int, to: str = "embedding") -> DataFrame:
    """The rows with a text's vector of ``dim`` numbers, and ``error`` where there is none.

    The provider gets the texts of a batch at once and returns as many vectors. A null or blank
    text, a vector of another size, and a failed batch are errors of their rows.
    """

    def vectors(texts: pd.Series) -> pd.DataFrame:
        given = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
        out: list[tuple] = [(None, "empty text")] * len(texts)
        try:
            if run is None:
                raise ProviderError("no provider")
            made = run([texts.iloc[i] for i in given]) if given else []
            if len(made) != len(given):
                raise ProviderError(f"{len(given)} texts and {len(made)} vectors")
            for i, v in zip(given, made):
                out[i] = (list(map(float, v)), None) if len(v) == dim else (None, f"{len(v)} numbers instead of {dim}")
        except Exception as e:  # a provider's failure is a value
            for i in given:
                out[i] = (None, f"{type(e).__name__}: {e}")
        return pd.DataFrame(out, columns=["vector", "error"])

    got = df.withColumn("_got", F.pandas_udf(vectors, "vector array<double>, error string")(F.col(column)))
    return got.withColumn(to, F.col("_got.vector")).withColumn("error", F.col("_got.error")).drop("_got")


def ingest(spark: SparkSession, root: str, read_pdf: Callable[[bytes], list[dict]] | None = None, fetch: Callable[[str], str] | None = None, read_image: Callable[[bytes], str] | None = None, most: float = MAX_MB) -> DataFrame:
    """The texts of all inputs below a root, each with its source's tag, in the order of the categories: src_order, source, category, text, error.

    PDF pages, web pages and images come from providers; code and text files are decoded. What
    cannot be read has no text and says why; too large files are none, and empty ones have no row.
    """
    raw = lambda c: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(CATEGORIES[c]) + "}").load(f"{root}/{c}").where(F.col("length") <= int(most * 1048576))
    pdf = page_texts(raw("pdf"), read_pdf).select(F.lit("pdf").alias("category"), F.col("path").alias("source"), "text", "error")
    codes = raw("codes").select(F.lit("codes").alias("category"), F.col("path").alias("source"), decode("content").alias("text"), F.lit(None).cast("string").alias("error"))
    links = ask(read_links(spark, f"{root}/links"), "url", fetch, "html", strip=False).select(F.lit("links").alias("category"), F.col("url").alias("source"), T.page_text("html").alias("text"), "error")
    seen = pages(raw("images"), None if read_image is None else lambda raw_bytes: [{"type": "image", "content": read_image(raw_bytes)}])
    images = seen.select(F.lit("images").alias("category"), F.col("path").alias("source"), F.col("content").alias("text"), "error")
    every = pdf.unionByName(codes).unionByName(links).unionByName(images)
    order = F.array_position(F.array(*[F.lit(c) for c in ORDER]), F.col("category")).cast("int")
    tag = F.concat(F.lit("["), F.col("category"), F.lit(": "), F.col("source"), F.lit("]\n"), F.col("text"))
    return every.select(order.alias("src_order"), "source", "category", F.when(F.length("text") > 0, tag).alias("text"), F.coalesce("error", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "no text")).alias("error"))


def _as_blocks(files: DataFrame, document_type: str, **given: Column) -> DataFrame:
    """One block for each file: path, document_type, the block's columns and error; what is not given is null."""
    columns = [c.split(" ", 1) for c in f"{BLOCK}, error string".split(", ")]
    made = [given.get(n, F.lit(0) if n == "seq" else F.lit(None)).cast(kind).alias(n) for n, kind in columns]
    return files.select("path", F.lit(document_type).alias("document_type"), *made)


def analyze(spark: SparkSession, path: str, read_pdf: Callable[[bytes], list[dict]] | None = None, read_image: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    """The blocks of all files below a path by their kind: path, document_type, the block's columns, error.

    Text and code files are one text block; images one image block (an outside reader gives their
    size, else they have no place), with the file's name as caption; PDF files what the provider
    finds, with its order in ``seq``. Other files are one row with an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", extension("path").alias("ext"))
    of = lambda kinds: files.where(F.col("ext").isin(*kinds))
    whole = {"page": F.lit(1), "coordinates": F.array(*[F.lit(0.0)] * 4), "extraction_method": F.lit("direct"), "confidence": F.lit(1.0)}
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    text = _as_blocks(of(TEXTS), "text", type=F.lit("text"), content=decode("content"), **whole)
    if read_image is None:
        image = _as_blocks(of(IMAGES), "image", type=F.lit("image"), caption=name, image_data=F.col("content"), **whole)
    else:
        image = pages(of(IMAGES), read_image).withColumn("caption", F.coalesce("caption", name)).withColumn("document_type", F.lit("image")).select(text.columns)
    pdf = pages(of(PDFS), read_pdf).withColumn("document_type", F.lit("pdf")).select(text.columns)
    other = _as_blocks(files.where(~F.col("ext").isin(*TEXTS, *IMAGES, *PDFS)), "unknown", error=F.concat(F.lit("unsupported: "), "ext"))
    return text.unionByName(image).unionByName(pdf).unionByName(other)


def reading_text(readings: DataFrame, key: str, high: float = 0.6) -> DataFrame:
    """The plain reading of each image: the key, text (readings of ``high`` confidence or more, in order) and their mean confidence, 0 without one.

    ``readings`` have the key, seq, text, confidence.
    """
    kept = F.when(F.col("confidence") >= high, F.struct("seq", "text"))
    out = readings.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"]), " ").alias("text"), F.round(F.coalesce(F.avg(F.when(F.col("confidence") >= high, F.col("confidence"))), F.lit(0.0)), 9).alias("confidence"))
    return out


def staged_reading(readings: DataFrame, key: str, improve: Callable[[str], str] | None = None, prompt: Callable[[Column, Column | None], Column] | None = None, retrieve: Callable[[DataFrame], DataFrame] | None = None, high: float = 0.6, low: float = 0.1) -> DataFrame:
    """Readings made better in stages: the key, text, stage, confidence, error.

    The readings of high and middle confidence (all, where there are none) are put right by a
    model; what the knowledge base holds near the result (``retrieve``: key, text to key,
    knowledge) goes into a second round. A stage that fails, or is not given, leaves the text of
    the stage before it. Without a model the plain reading stands. Confidence is estimated from
    the readings and the stages that took place.
    """
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("seq", "text")))), lambda x: x["text"]), " ")
    known = readings.where("text is not null")
    raw = known.groupBy(key).agg(ordered(F.col("confidence") >= low).alias("some"), ordered(F.lit(True)).alias("all"), ordered(F.col("confidence") >= high).alias("plain"))
    start = raw.where(F.col("all") != "").select(key, F.when(F.col("some") != "", F.col("some")).otherwise(F.col("all")).alias("start"), "plain")
    make = prompt or (lambda text, knowledge: text if knowledge is None else F.concat_ws("\n\n", text, knowledge))
    one = ask(start.withColumn("_p", make(F.col("start"), None)), "_p", improve, "_one").withColumn("stage", F.when(F.col("_one").isNotNull(), 1).otherwise(0))
    one = one.withColumn("text", F.coalesce("_one", F.when(F.col("plain") != "", F.col("plain")).otherwise(F.col("start")))).select(key, "text", "stage", "error")
    out = one
    if retrieve is not None and improve is not None:
        found = retrieve(one.where("stage = 1").select(key, "text")).select(key, "knowledge").where("length(knowledge) > 0")
        both = one.join(found, key, "left")
        two = ask(both.withColumn("_p", F.when(F.col("knowledge").isNotNull(), make(F.col("text"), F.col("knowledge")))).withColumnRenamed("error", "_e"), "_p", improve, "_two")
        out = two.withColumn("stage", F.when(F.col("_two").isNotNull(), 2).otherwise(F.col("stage"))).withColumn("text", F.coalesce("_two", "text")).withColumn("error", F.coalesce("_e", "error")).select(key, "text", "stage", "error")
    conf = {s: K.confidence(readings, key, "confidence", high, llm=s > 0, knowledge=s > 1).withColumn("stage", F.lit(s)) for s in (0, 1, 2)}
    sure = conf[0].unionByName(conf[1]).unionByName(conf[2])
    return out.join(sure, [key, "stage"]).select(key, "text", "stage", "confidence", "error")
