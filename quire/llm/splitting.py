"""Oversized items cut at natural boundaries (problem 4).

A text is processed in ranges. A range finds its own boundary characters and
needs nothing else of its neighbours than where the next range's first boundary
lies: the place after the first boundary of a range is an anchor, where a piece
always begins, so the ranges between anchors are cut independently. For files a
worker reads only its range of bytes and a halo; a long text of a column becomes
one row a range. Lengths in code points and numbers of pieces are stitched by prefix
sums, stretches without a boundary by the first boundary of later ranges.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut

#: Code points a piece may have, and those that consecutive pieces share at most.
LIMIT, OVERLAP = 500, 100
#: Code points (of a column) or bytes (of a file) in a range.
RANGE = 1 << 20
# The natural boundaries.
BOUNDARIES = " \t\n\r　.!?;:,。！？；：，、…"
_TABLE = np.zeros(1 << 16, bool)
_TABLE[[ord(c) for c in BOUNDARIES]] = True


def boundary_places(text: str) -> np.ndarray:
    """Positions just after each boundary character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.flatnonzero(_TABLE[np.minimum(codes, 0xFFFF)]) + 1


def long_runs(after: np.ndarray, length: int, limit: int) -> list[int]:
    """Starts of the maximal stretches of more than ``limit`` code points without a boundary."""
    starts = np.concatenate(([0], after))
    ends = np.concatenate((after - 1, [length]))
    return starts[ends - starts > limit].tolist()


def cut_between(after: np.ndarray, start: int, first: int, stop: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces from ``first`` (its overlap reaching back to ``start``) up to ``stop``.

    ``after`` holds the places after boundaries from ``start`` to ``stop``. A piece ends at the last
    boundary that leaves it under the limit and past the overlap, else at the limit itself.
    """
    out, at, fresh = [], start, first
    while fresh < stop:
        if stop - at <= limit:
            out.append((at, stop))
            break
        k = int(np.searchsorted(after, at + limit, side="right")) - 1
        end = int(after[k]) if k >= 0 and after[k] > fresh else at + limit
        out.append((at, end))
        fresh = end
        at = overlap_start(after, end, overlap)
        if at + limit <= fresh:
            at = fresh
    return out


def overlap_start(after: np.ndarray, end: int, overlap: int) -> int:
    """Where a piece begins that follows a cut at ``end``: at the first boundary within the overlap, else its whole length back."""
    if overlap <= 0 or end <= 0:
        return max(0, end)
    k = int(np.searchsorted(after, max(0, end - overlap), side="left"))
    if end <= overlap:
        return 0
    return int(after[k]) if k < len(after) and after[k] < end else end - overlap


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_size: int = RANGE) -> tuple[list[tuple[int, int]], list[int]]:
    """(start, end) of the pieces, and the starts of long runs, of one text in memory."""
    n = len(text)
    after = boundary_places(text)
    anchors = [0]
    for a in range(range_size, n, range_size):
        k = int(np.searchsorted(after, a, side="right"))
        place = int(after[k]) if k < len(after) and after[k] <= a + range_size else a
        if anchors[-1] < place < n:
            anchors.append(place)
    out: list[tuple[int, int]] = []
    for first, stop in zip(anchors, [*anchors[1:], n]):
        out += cut_between(after, overlap_start(after, first, overlap), first, stop, limit, overlap)
    return out, long_runs(after, n, limit)


_PIECES = pa.schema([("row", pa.string()), ("piece_no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("piece", pa.string()), ("runs", pa.list_(pa.int64())), ("has_run", pa.bool_())])
_ROWS = "row string, piece_no int, start long, end long, piece string, runs array<bigint>, has_run boolean"


def _split(limit: int, overlap: int, range_size: int):
    schema = _PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cuts, runs = pieces(text, limit, overlap, range_size)
                done = 0
                for k, (a, b) in enumerate(cuts):
                    for col, x in zip(cols, (key, k, a, b, text[a:b], [r for r in runs if done <= r < b], bool(runs))):
                        col.append(x)
                    done = b
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _advance(raw: np.ndarray, at: int, n: int) -> int:
    """The byte at which the n-th code point after the one at byte ``at`` begins, or the end."""
    starts = np.flatnonzero((raw[at : at + 4 * n + 4] & 0xC0) != 0x80)
    return at + int(starts[n]) if n < len(starts) else len(raw)


def _back(raw: np.ndarray, at: int, n: int) -> int:
    """The byte at which the n-th code point before byte ``at`` begins, or 0."""
    low = max(0, at - 4 * n)
    starts = np.flatnonzero((raw[low:at] & 0xC0) != 0x80)
    return low + int(starts[-n]) if n <= len(starts) else 0


def _cut_ranges(overlap: int, range_size: int):
    """Range rows of long texts: the bytes from one anchor to the next and a halo before them; the text is never decoded whole."""
    schema = pa.schema([("row", pa.string()), ("rid", pa.string()), ("k", pa.int64()), ("halo", pa.string()), ("own", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                raw, rid = np.frombuffer(text.as_buffer(), np.uint8), uuid.uuid4().hex
                decoded = lambda a, b: raw[a:b].tobytes().decode("utf-8", "replace")  # noqa: E731, B023
                k = first = at = 0
                while first < len(raw):
                    # up to the next range's first boundary, else its own start
                    at = stop = _advance(raw, at, range_size)
                    if at < len(raw):
                        after = boundary_places(decoded(at, _advance(raw, at, range_size)))
                        stop = _advance(raw, at, int(after[0])) if len(after) else at
                    if stop == first:
                        continue
                    row = (key.as_py(), rid, k, decoded(_back(raw, first, overlap + 1), first), decoded(first, stop))
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
                    first, k = stop, k + 1

    return run


def _range_cuts(halo: str, own: str, limit: int, overlap: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Boundaries and pieces of a range with its halo, counted from the halo's start."""
    after, before = boundary_places(halo + own), len(halo)
    return after, cut_between(after, overlap_start(after, before, overlap), before, before + len(own), limit, overlap)


def _range_table(limit: int, overlap: int):
    """A range's length and pieces, its first boundary, the long runs that end in it, and the stretch that it leaves open."""
    schema = pa.schema([("rid", pa.string()), ("k", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("first", pa.int64()), ("inner", pa.list_(pa.int64())), ("open", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                after, cuts = _range_cuts(r["halo"], r["own"], limit, overlap)
                fresh = not r["halo"] or _TABLE[min(ord(r["halo"][-1]), 0xFFFF)]
                n, own = len(r["own"]), after[after > len(r["halo"])] - len(r["halo"])
                starts = np.concatenate(([0] if fresh else [], own[own < n])).astype(np.int64)
                ends = (own if fresh else own[1:]) - 1
                closed = starts[: len(ends)]
                row = (r["rid"], r["k"], n, len(cuts), int(own[0]) - 1 if len(own) else None, closed[ends - closed > limit].tolist(), int(starts[-1]) if len(starts) > len(ends) else None)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    return run


def _range_pieces(limit: int, overlap: int):
    schema = _PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                _, cuts = _range_cuts(r["halo"], r["own"], limit, overlap)
                text, shift, runs = r["halo"] + r["own"], r["base"] - len(r["halo"]), np.array(sorted(r["runs"]), np.int64)
                at = np.searchsorted(runs, [r["base"], *(b + shift for _, b in cuts)])
                rows = [(r["row"], r["skip"] + k, a + shift, b + shift, text[a:b], runs[at[k] : at[k + 1]].tolist(), r["has_run"]) for k, (a, b) in enumerate(cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _split_ranges(giants: DataFrame, limit: int, overlap: int, range_size: int) -> DataFrame:
    """Pieces of texts longer than a range: each range is cut on its own and placed by prefix sums."""
    ranges = cut(giants.mapInArrow(_cut_ranges(overlap, range_size), "row string, rid string, k long, halo string, own string").repartition("rid", "k"))
    table = ranges.mapInArrow(_range_table(limit, overlap), "rid string, k long, n long, m long, first long, inner array<bigint>, open long")
    item = Window.partitionBy("rid")
    before, later = item.orderBy("k").rowsBetween(Window.unboundedPreceding, -1), item.orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    placed = table.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("skip", F.coalesce(F.sum("m").over(before), F.lit(0)))
    ends = F.coalesce(F.first(F.col("base") + F.col("first"), ignorenulls=True).over(later), F.sum("n").over(item))
    stretch = F.when(ends - F.col("base") - F.col("open") > limit, F.array("open")).otherwise(F.array().cast("array<bigint>"))
    runs = F.transform(F.concat("inner", stretch), lambda x: x + F.col("base"))
    found = placed.withColumn("runs", runs).withColumn("has_run", F.max(F.size("runs") > 0).over(item)).select("rid", "k", "base", "skip", "runs", "has_run")
    return ranges.join(found, ["rid", "k"]).mapInArrow(_range_pieces(limit, overlap), _ROWS)


def split_items(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_size: int = RANGE) -> DataFrame:
    """Pieces of the items that exceed ``limit`` code points.

    Columns: the key, piece_no, start, end (0-based code points, end exclusive), piece,
    runs (starts of the stretches over the limit without a boundary that begin in the
    piece's own part), has_run. Items within the limit, null and empty ones have no
    row: they need no cut. Repeated rows are cut once each. An item longer than a range
    is dealt out: no worker decodes or tables more than two ranges of it.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")
    long = df.select(F.col(key).cast("string").alias("row"), F.col(text).alias("text")).where(F.length("text") > limit)
    giant = (F.octet_length("text") > range_size) & (F.length("text") > range_size)
    out = long.where(~giant).mapInArrow(_split(limit, overlap, range_size), _ROWS).unionAll(_split_ranges(long.where(giant), limit, overlap, range_size))
    return out.select(F.col("row").cast(df.schema[key].dataType).alias(key), "piece_no", "start", "end", "piece", "runs", "has_run")


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    return system.open_input_file(inner)


def _read(path: str, start: int, end: int, size: int) -> tuple[str, int]:
    """The code points whose first byte lies in the range, and that byte's place. A byte that is no UTF-8 is a code point of its own."""
    with _open(path) as f:
        raw = f.read_at(min(size, end + 3) - start, start)
    a = 0
    while a < len(raw) and a < 4 and (raw[a] & 0xC0) == 0x80:
        a += 1
    b = min(end - start, len(raw))
    while b < len(raw) and (raw[b] & 0xC0) == 0x80:
        b += 1
    return raw[a:b].decode("utf-8", "surrogateescape"), start + a


_NO_UTF8 = re.compile("[\udc80-\udcff]")


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def _tables(limit: int):
    schema = pa.schema([("path", pa.string()), ("k", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("inner", pa.list_(pa.int64())), ("first_byte", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                text, byte = _read(r["path"], r["start"], r["end"], r["length"])
                after = boundary_places(text)
                has = len(after) > 0
                gaps = [int(a) for a, b in zip(after[:-1], after[1:]) if b - 1 - a > limit]
                anchor = int(after[0]) if has else 0
                row = (r["path"], r["k"], len(text), int(after[0]) if has else None, int(after[-1]) if has else None, gaps, byte + len(_bytes(text[:anchor])))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    return run


def _emit(limit: int, overlap: int):
    schema = pa.schema([("path", pa.string()), ("k", pa.int64()), ("i", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                # the anchor's bytes up to the next anchor's, with a halo of the overlap before
                halo = min(r["anchor_byte"], 4 * overlap)
                text, _ = _read(r["path"], r["anchor_byte"] - halo, r["stop_byte"], r["length"])
                own = _bytes(text)
                back = len(own) - (r["stop_byte"] - r["anchor_byte"])
                before = len(own[:back].decode("utf-8", "surrogateescape"))
                base = r["anchor"] - before
                after = boundary_places(text)
                cuts = cut_between(after, overlap_start(after, before, overlap), before, before + r["stop"] - r["anchor"], limit, overlap)
                rows = ([r["path"]] * len(cuts), [r["k"]] * len(cuts), list(range(len(cuts))), [base + a for a, _ in cuts], [base + b for _, b in cuts], [_NO_UTF8.sub("\ufffd", text[a:b]) for a, b in cuts])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

    return run


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")
    dealt = files.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / range_bytes))))
    return dealt.select("path", "length", "k", (F.col("k") * range_bytes).alias("start"), F.least("length", (F.col("k") + 1) * range_bytes).alias("end")).repartition("path", "k")


def split_files(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """Pieces and long runs of UTF-8 files of any size, a range of bytes at a time.

    Returns (path, piece_no, start, end, piece) and (path, run_start). No worker holds
    more than two ranges. Empty files have no row. A range without any boundary begins
    a piece at its own start. A byte that is no UTF-8 counts as a code point and comes out
    as the replacement character. Each file is read twice: for its boundary tables, which are
    written and stitched, and for its pieces, which are written and numbered.
    """
    ranges = _ranges(spark, path, range_bytes)
    scan = cut(ranges.mapInArrow(_tables(limit), "path string, k long, n long, first long, last long, inner array<bigint>, first_byte long"))
    order = Window.partitionBy("path").orderBy("k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = scan.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("path")))
    placed = placed.withColumn("anchor", F.when(F.col("k") == 0, 0).otherwise(F.col("base") + F.coalesce("first", F.lit(0)))).withColumn("anchor_byte", F.when(F.col("k") == 0, 0).otherwise(F.col("first_byte")))
    sized = placed.join(ranges.select("path", "length", "k"), ["path", "k"])
    owned = sized.withColumn("stop", F.coalesce(F.lead("anchor").over(order), "total")).withColumn("stop_byte", F.coalesce(F.lead("anchor_byte").over(order), "length"))
    cuts = cut(owned.where("stop > anchor").select("path", "length", "k", "anchor", "anchor_byte", "stop", "stop_byte").mapInArrow(_emit(limit, overlap), "path string, k long, i long, start long, end long, piece string"))
    per = cuts.groupBy("path", "k").agg(F.count("*").alias("m")).withColumn("skip", F.coalesce(F.sum("m").over(before), F.lit(0))).select("path", "k", "skip")
    out = cuts.join(per, ["path", "k"]).select("path", (F.col("skip") + F.col("i")).alias("piece_no"), "start", "end", "piece")
    left = F.coalesce(F.last(F.col("base") + F.col("last"), ignorenulls=True).over(before), F.lit(0))
    stitched = placed.withColumn("left", left)
    seams = stitched.where(F.col("first").isNotNull() & (F.col("base") + F.col("first") - 1 - F.col("left") > limit)).select("path", F.col("left").alias("run_start"))
    inner = placed.select("path", F.explode(F.transform("inner", lambda x: x + F.col("base"))).alias("run_start"))
    tail = placed.groupBy("path").agg(F.max(F.col("base") + F.col("last")).alias("last"), F.max("total").alias("total")).select("path", F.coalesce("last", F.lit(0)).alias("run_start"), "total").where(F.col("total") - F.col("run_start") > limit).select("path", "run_start")
    return out, seams.unionAll(inner).unionAll(tail)
