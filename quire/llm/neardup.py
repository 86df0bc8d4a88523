"""Near-duplicate records (problem 3): MinHash banding, verified on full n-gram sets.

Texts are first made distinct, so a group of exact copies is one text however
many rows it has. Each distinct text gets a MinHash signature; rows that agree
in a whole band meet in a shuffle on the band's hash. Candidates are verified
on the full sets of n-gram hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import counted, cut
from .tokens import tokens

_PRIME = np.uint64(0xFFFFFFFFFFFFFFC5)


def banding(threshold: float, recall: float = 0.999, most: int = 240) -> tuple[int, int]:
    """(bands, rows): the most selective banding whose recall at the threshold reaches ``recall``.

    More rows in a band mean fewer false candidates and more bands; ``most`` bounds the hashes a text has.
    """
    best = None
    for rows in range(1, 17):
        miss = 1 - threshold**rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(miss))) if miss > 0 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches that recall")
    return best


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the token n-grams; a shorter text is one gram of all its tokens."""
    words = tokens(text)
    if not words:
        return np.zeros(0, np.uint64)
    grams = {"\x1f".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}
    return np.sort(np.fromiter((xxhash.xxh3_64_intdigest(g) for g in grams), dtype=np.uint64, count=len(grams)))


def _signatures(n: int, bands: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    mix = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
    schema = pa.schema([("th", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sig = [], []
            for i, (text, src) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                h = shingle_hashes(text, n)
                if not len(h):
                    continue
                with np.errstate(over="ignore"):
                    low = np.min((h[:, None] * mul[None, :] + add[None, :]) >> np.uint64(16), axis=0).reshape(bands, rows)
                    band = (low * mix[None, :]).sum(axis=1, dtype=np.uint64)
                    # texts of different sources never share a band
                    band ^= (band >> np.uint64(29)) ^ np.uint64(xxhash.xxh3_64_intdigest(src))
                keep.append(i), sig.append(band.view(np.int64))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(sig, pa.list_(pa.int64()))], schema=schema)

    return run


def _gram_sets(n: int):
    schema = pa.schema([("th", pa.binary()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingle_hashes(t, n).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], schema=schema)

    return run


def _distinct_texts(base: DataFrame) -> DataFrame:
    """Each text of a source once: th, text, src. Everything below is about these."""
    return base.dropDuplicates(["th"]).select("th", "text", "src")


def _banded(texts: DataFrame, n: int, threshold: float, recall: float, seed: int) -> DataFrame:
    """(key, th) for each band of each text: one hash of the band's number and value, and the text's hash beside it.

    Signatures are written once, so that both sides of a join on bands are one exchange of them.
    """
    bands, rows = banding(threshold, recall)
    signed = cut(texts.mapInArrow(_signatures(n, bands, rows, seed), "th binary, bands array<bigint>"))
    return signed.select(F.posexplode("bands").alias("no", "bh"), "th").select(F.xxhash64("no", "bh").alias("key"), "th")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (ta, tb) whose full n-gram sets are similar enough.

    Sets are made for the texts of candidates only, which need not be distinct in ``texts``.
    """
    wanted = counted(pairs.select(F.col("ta").alias("th")).unionAll(pairs.select(F.col("tb").alias("th"))).distinct())
    full = texts.join(wanted, "th", "left_semi").dropDuplicates(["th"]).select("th", "text").mapInArrow(_gram_sets(n), "th binary, grams array<bigint>")
    both = pairs.join(full.select(F.col("th").alias("ta"), F.col("grams").alias("ga")), "ta").join(full.select(F.col("th").alias("tb"), F.col("grams").alias("gb")), "tb")
    common = F.size(F.array_intersect("ga", "gb"))
    joint = both.select("ta", "tb", common.alias("common"), (F.size("ga") + F.size("gb") - common).alias("joint"))
    return joint.where(F.col("common") >= F.lit(threshold) * F.col("joint")).select("ta", "tb")


def _base(df: DataFrame, key: str, text: str, src: str | None) -> DataFrame:
    """Rows with a text and its hash, which holds the source too."""
    from_ = F.lit("") if src is None else F.coalesce(F.col(src).cast("string"), F.lit(""))
    rows = df.select(from_.alias("src"), F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null and text <> '' and id is not null")
    return rows.withColumn("th", F.unhex(F.md5(F.concat("src", F.lit("\x1f"), "text"))))


def similar_pairs(df: DataFrame, key: str, text: str, src: str | None = None, n: int = 5, threshold: float = 0.8, recall: float = 0.999, seed: int = 7) -> DataFrame:
    """Pairs of keys within a source whose token n-gram sets have a Jaccard similarity of ``threshold`` or more.

    Columns: src, id_a < id_b. Equal texts under different keys count, also those
    without a token; null and empty texts don't. Rows repeated under one key are one.
    """
    base = _base(df, key, text, src)
    members = base.select("src", "id", "th").distinct()
    band = _banded(_distinct_texts(base), n, threshold, recall, seed)
    met = band.select("key", F.col("th").alias("ta")).join(band.select("key", F.col("th").alias("tb")), "key").where("ta < tb").select("ta", "tb").distinct()
    texts = _verified(cut(met), base, n, threshold)
    same = members.groupBy("th").agg(F.count("*").alias("k")).where("k > 1").select(F.col("th").alias("ta"), F.col("th").alias("tb"))
    a = members.select("src", F.col("id").alias("x"), F.col("th").alias("ta"))
    b = members.select(F.col("id").alias("y"), F.col("th").alias("tb"))
    both = texts.unionAll(same).join(a, "ta").join(b, "tb").where("x <> y")
    return both.select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(links: DataFrame, start: DataFrame | None = None, max_rounds: int = 50) -> DataFrame:
    """(th, label) of every text that a link (ta, tb) touches; one label for each connected class.

    Labels spread by the smallest neighbour with pointer jumping; each round is written to the
    shared folder, nothing is collected. ``start`` are labels of classes known before.
    """
    edges = cut(links.unionAll(links.select(F.col("tb").alias("ta"), F.col("ta").alias("tb"))).distinct())
    label = edges.select(F.col("ta").alias("th")).distinct().withColumn("label", F.col("th"))
    if start is not None:
        # a class known before is joined by links of each of its texts to its label
        edges = cut(edges.unionAll(start.where("th <> label").select(F.col("th").alias("ta"), F.col("label").alias("tb"))).unionAll(start.where("th <> label").select(F.col("label").alias("ta"), F.col("th").alias("tb"))).distinct())
        label = edges.select(F.col("ta").alias("th")).distinct().join(start, "th", "left").select("th", F.coalesce("label", "th").alias("label"))
    label = cut(label)
    for _ in range(max_rounds):
        near = edges.join(label.select(F.col("th").alias("tb"), "label"), "tb").groupBy(F.col("ta").alias("th")).agg(F.min("label").alias("near"))
        step = label.join(near, "th").select("th", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        jump = step.join(step.select(F.col("th").alias("label"), F.col("label").alias("far")), "label", "left")
        new = cut(jump.select("th", F.coalesce(F.least("label", "far"), "label").alias("label"), "moved"))
        label = new.select("th", "label")
        if new.where("moved").limit(1).count() == 0:
            return label
    raise RuntimeError(f"classes still change after {max_rounds} rounds")


def similar_groups(df: DataFrame, key: str, text: str, src: str | None = None, n: int = 5, threshold: float = 0.8, recall: float = 0.999, seed: int = 7, max_rounds: int = 50) -> DataFrame:
    """Connected classes of similar texts: src, id, class_id (the class's smallest key), n_texts (different texts in it).

    One row for each key with a text. First each band's texts are held against the smallest of
    them, a star instead of all pairs, and classes are made of what is similar. Then only texts
    that share a band but no class are held against each other, which finds the links that the
    stars leave out; two texts of one class need no further link. So a band that holds a third of
    all texts, near copies of each other, costs a row a text, and no class that the candidates
    connect is torn.
    """
    base = _base(df, key, text, src)
    members = cut(base.select("src", "id", "th").distinct())
    whole = cut(_distinct_texts(base))
    band = _banded(whole, n, threshold, recall, seed)
    several = band.groupBy("key").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo <> hi")
    shared = cut(band.join(several.select("key"), "key", "left_semi"))

    centre = shared.groupBy("key").agg(F.min("th").alias("ta"))
    stars = cut(shared.select("key", F.col("th").alias("tb")).join(centre, "key").where("ta <> tb").select("ta", "tb").distinct())
    first = components(_verified(stars, whole, n, threshold), max_rounds=max_rounds)

    placed = cut(shared.join(first, "th", "left").select("key", "th", F.coalesce("label", "th").alias("class")))
    classes = placed.select("key", "class").distinct()
    mixed = classes.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    ahead = placed.join(mixed, "key", "left_semi").select("key", F.col("th").alias("ta"), F.col("class").alias("own")).join(classes, "key").where(F.col("own") < F.col("class"))
    across = ahead.join(placed.select("key", "class", F.col("th").alias("tb")), ["key", "class"]).select(F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb")).distinct()
    label = components(_verified(cut(across.join(stars, ["ta", "tb"], "left_anti")), whole, n, threshold), first, max_rounds)

    seen = members.join(label, "th", "left").withColumn("label", F.coalesce("label", "th"))
    names = seen.groupBy("label").agg(F.min("id").alias("class_id"))
    texts = seen.select("label", "th").distinct().groupBy("label").agg(F.count("*").alias("n_texts"))
    return seen.join(names.join(texts, "label"), "label").select("src", "id", "class_id", "n_texts")
