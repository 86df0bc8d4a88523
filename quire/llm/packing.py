"""Filling containers of fixed capacity (problem 8).

First-fit decreasing, run independently in randomised groups. Within a group a
tournament tree over the bins' free space finds the first bin that fits in
O(log bins). Only keys and sizes leave the scan; texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Tokens a container holds, and items a group holds on average.
CAPACITY = 2048
GROUP_ITEMS = 4096


class FirstFit:
    """Bins of one capacity; ``place`` puts a size into the first bin with room.

    ``tree`` is a tournament over free space: a node holds the larger of its
    two children, so the walk from the root always takes the left child when
    it has room.
    """

    def __init__(self, capacity: int, expected: int):
        self.capacity = capacity
        self.leaves = 1 << max(1, (max(1, expected) - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)
        self.used = 0

    def place(self, size: int) -> int:
        tree = self.tree
        if size > tree[1]:
            self._grow()
            tree = self.tree
        node = 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        tree[node] -= size
        bin_no = node - self.leaves
        self.used = max(self.used, bin_no + 1)
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
        return bin_no

    def _grow(self) -> None:
        old = self.tree[self.leaves :]
        self.leaves *= 2
        self.tree = [self.capacity] * (2 * self.leaves)
        self.tree[self.leaves : self.leaves + len(old)] = old
        for node in range(self.leaves - 1, 0, -1):
            self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each size; sizes are placed largest first, ties in order."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins = FirstFit(capacity, math.ceil(sum(sizes) / capacity) if sizes else 1)
    out = [0] * len(sizes)
    for i in order:
        out[i] = bins.place(sizes[i])
    return out


def cut_points(raw: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, length) in bytes of the pieces of an oversized text.

    Pieces are as full as they can be without cutting a code point. The closing
    token belongs to the last piece, so that one holds at most capacity - 1 bytes.
    """
    out, at, n = [], 0, len(raw)
    while n - at > capacity - 1:
        end = min(n, at + capacity)
        while end < n and end > at + 1 and (raw[end] & 0xC0) == 0x80:
            end -= 1
        out.append((at, end - at))
        at = end
    out.append((at, n - at))
    return out


def _pieces(capacity: int):
    schema = pa.schema([("key", pa.string()), ("content", pa.int64()), ("piece_no", pa.int32()), ("byte_start", pa.int64()), ("tokens", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).cast(pa.binary())
            size = pc.add(pc.binary_length(text), 1).to_pylist()
            row, no, start, tokens = [], [], [], []
            for i, n in enumerate(size):
                if n <= capacity:
                    row.append(i), no.append(0), start.append(0), tokens.append(n)
                    continue
                cuts = cut_points(text[i].as_py(), capacity)
                for k, (at, length) in enumerate(cuts):
                    row.append(i), no.append(k), start.append(at), tokens.append(length + (k == len(cuts) - 1))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(a, f.type) for a, f in zip((no, start, tokens), list(schema)[2:]))], schema=schema)

    return run


def _fill(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        # an order of its own, so that bins don't depend on how the rows arrive
        table = table.sort_by([("salt", "ascending"), ("key", "ascending"), ("piece_no", "ascending"), ("copy", "ascending")])
        sizes = table.column("tokens").to_pylist()
        bins = first_fit_decreasing(sizes, capacity)
        return table.select(["key", "piece_no", "byte_start", "tokens", "grp"]).append_column("bin_no", pa.array(bins, pa.int32()))

    return run


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Pack texts into containers of ``capacity`` tokens (UTF-8 bytes and one closing token a text).

    Columns: the key, piece_no, byte_start, tokens, container (a string, unique per
    container). A text is cut only if it alone exceeds a container. Null and empty
    texts are not packed. Repeated rows are packed once each. A null key stays null.
    An empty input gives an empty result.

    Pieces are dealt to groups by a hash of key, content, piece and copy number, so
    containers don't depend on how the rows lie in files, and a key or a row that is
    repeated in a third of all rows spreads over all groups. The groups are as many as
    the counted pieces need, so each holds about ``group_items`` of them whatever the input.
    """
    if capacity < 8:
        raise ValueError("capacity must be 8 or more")
    kind = df.schema[key].dataType
    texts = df.select(F.col(key).cast("string").alias("key"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    pieces = texts.where(F.length("text") > 0).mapInArrow(_pieces(capacity), "key string, content long, piece_no int, byte_start long, tokens int")
    counted = cut(pieces.groupBy("key", "content", "piece_no", "byte_start", "tokens").agg(F.count("*").alias("copies")))
    total = counted.agg(F.sum("copies")).first()[0] or 0
    groups = max(1, math.ceil(total / group_items))
    single = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    salted = single.withColumn("salt", F.xxhash64("key", "content", "piece_no", "copy")).withColumn("grp", F.pmod("salt", F.lit(groups)))
    schema = "key string, piece_no int, byte_start long, tokens int, grp long, bin_no int"
    packed = salted.select("key", "piece_no", "byte_start", "tokens", "copy", "salt", "grp").groupBy("grp").applyInArrow(_fill(capacity), schema)
    return packed.select(F.col("key").cast(kind).alias(key), "piece_no", "byte_start", "tokens", F.concat_ws("-", "grp", "bin_no").alias("container"))
