"""The k most similar vectors for every vector (problem 7): randomly rotated one-bit codes over an inverted file.

Every live unit vector goes to the cell of its nearest centroid. In its cell a
vector is coded relative to the centroid c: the residual is rotated at random and
only its signs are kept, with scalars that make the estimate of an inner product
unbiased and give its error bound. Within a box (a cell, or a part of a large one)
the bounds choose the candidates that are reranked with the full vectors. Each vector
then visits the boxes of its next nearest cells as a code of twelve bits a coordinate,
carrying its k-th best similarity so far; the rows there whose upper bound passes it
are reranked with their full vectors, and those that are better come back.

The centroids of the cells are fitted on a bounded sample, many vectors a centroid, so their
number is bounded; a cell that outgrows its size is divided once more by centroids of its own,
fitted where it lies on a sample of it. A vector lives in the nearest of the regions that its
nearest cells offer and visits the next ones. So it meets about as many others in an index of
any size.

Full vectors travel as 16 bits a coordinate: half the bytes, with an error of a
cosine of about 2e-6. A visitor's twelve bits leave an error of about 3e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, counted, cut

#: Vectors a cell has on average, and cells at most; vectors that a centroid is fitted on, and those that the sample has at least.
CELL, MAX_CELLS, PER_CENTROID, SAMPLE = 512, 512, 128, 16384
#: Further regions that a vector visits; vectors a box and visits a task may have.
PROBES, BOX, VISITS = 6, 8192, 16384
#: Vectors from which a cell is divided, its regions at most, sampled vectors a region, rows a task, the regions that a cell offers
#: to a vector that only visits it, and the regions that a vector visits where cells are divided: they lie less neatly than cells.
DIVIDE, MAX_REGIONS, REGION_SAMPLE, ROUTED, OFFERED, REGION_PROBES = 4096, 1024, 64, 32768, 3, 10
#: A region's number is its cell's, shifted, and its place in the cell.
SHIFT = 20
#: Width of the error bound, in units of the estimate's standard deviation.
EPSILON = 2.4


def live_rows(df: DataFrame, key: str, order: str, op: str, vector: str, dim: int) -> DataFrame:
    """(id, embedding) of the keys whose row of highest ``order`` is an add with ``dim`` elements.

    The embeddings are not shuffled: the superseded rows are found on the narrow
    columns, and broadcast only if they are counted to be few.
    """
    narrow = df.select(F.col(key).alias("id"), F.col(order).alias("at")).where("id is not null and at is not null")
    last = narrow.groupBy("id").agg(F.max("at").alias("last"))
    dead = counted(narrow.join(last, "id").where("at < last").select("at"), BROADCAST_ROWS)
    adds = df.where((F.col(op) == "add") & (F.size(vector) == dim)).select(F.col(key).alias("id"), F.col(order).alias("at"), F.col(vector).alias("embedding"))
    return adds.where("id is not null").join(dead, "at", "left_anti").select("id", "embedding")


def _matrix(array: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of float32."""
    if not len(array):
        return np.zeros((0, dim), np.float32)
    return np.frombuffer(b"".join(array.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _blobs(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    size = flat.itemsize * flat.shape[1]
    raw = flat.tobytes()
    return pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary())


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Spherical k-means; an empty centroid takes a row that is far from its own."""
    rng = np.random.default_rng(seed)
    cent = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        label, best = np.zeros(len(sample), np.int64), np.zeros(len(sample), np.float32)
        for k in range(0, len(sample), 2048):
            s = sample[k : k + 2048] @ cent.T
            label[k : k + 2048], best[k : k + 2048] = s.argmax(axis=1), s.max(axis=1)
        order = np.argsort(label, kind="stable")
        used, first = np.unique(label[order], return_index=True)
        sums = np.add.reduceat(sample[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        cent[used] = sums / np.where(norm > 0, norm, 1)
        free = np.setdiff1d(np.arange(cells), used)
        cent[free] = sample[np.argsort(best, kind="stable")[: len(free)]]
    return cent


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(unit: np.ndarray, centre: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated residuals, and per row (|r|, <r, c>, sqrt(D) <signs/sqrt(D), r'>, error scale)."""
    dim = unit.shape[1]
    residual = unit - centre
    norm = np.linalg.norm(residual, axis=1)
    rotated = (residual / np.where(norm > 0, norm, 1)[:, None]) @ turned
    signs = np.where(rotated >= 0, np.float32(1), np.float32(-1))
    agree = (signs * rotated).sum(axis=1) / np.sqrt(dim)
    agree = np.where(norm > 0, np.maximum(agree, 1e-3), 1)
    error = norm * np.sqrt(np.maximum(0, 1 - agree**2)) / agree / np.sqrt(max(1, dim - 1))
    return np.packbits(rotated >= 0, axis=1), np.stack([norm, residual @ centre, agree * np.sqrt(dim), error], axis=1).astype(np.float32)


def estimate(bits: np.ndarray, scalars: np.ndarray, rotated_query: np.ndarray, at_centre: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """[queries, rows] estimated cosines, and the rows' error for a query residual of length 1.

    ``rotated_query`` are the rotated residuals of the queries to the cell's centroid, ``at_centre``
    the queries' inner products with it.
    """
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    inner = rotated_query @ signs.T
    return at_centre[:, None] + scalars[:, 1][None, :] + inner * (scalars[:, 0] / scalars[:, 2])[None, :], scalars[:, 3]


def twelve_bits(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in 4096 steps between the row's extremes: packed codes, and (low, step, length of the rounding error)."""
    low = rotated.min(axis=1)
    step = np.maximum((rotated.max(axis=1) - low) / 4095, 1e-12)
    code = np.clip(np.rint((rotated - low[:, None]) / step[:, None]), 0, 4095).astype(np.uint16)
    off = np.linalg.norm(rotated - (low[:, None] + code * step[:, None]), axis=1)
    last = np.pad((code & 15).astype(np.uint8), ((0, 0), (0, code.shape[1] % 2)))
    return np.concatenate([(code >> 4).astype(np.uint8), last[:, ::2] << 4 | last[:, 1::2]], axis=1), np.stack([low, step, off], axis=1).astype(np.float32)


def from_twelve(packed: np.ndarray, scale: np.ndarray, dim: int) -> np.ndarray:
    """Coordinates of packed codes, as near as their steps allow."""
    high, low = packed[:, :dim].astype(np.float32), packed[:, dim:]
    last = np.stack([low >> 4, low & 15], axis=2).reshape(len(packed), -1)[:, :dim]
    return scale[:, 0:1] + (high * 16 + last) * scale[:, 1:2]


def pack16(unit: np.ndarray) -> pa.Array:
    """Rows as two floats (low, step) and a 16-bit code a coordinate."""
    low = unit.min(axis=1).astype(np.float32)
    step = np.maximum((unit.max(axis=1) - low) / 65535, 1e-12).astype(np.float32)
    code = np.clip(np.rint((unit.astype(np.float64) - low[:, None]) / step[:, None]), 0, 65535).astype(np.uint16)
    return _blobs(np.concatenate([np.stack([low, step], axis=1).view(np.uint16).reshape(len(unit), 4), code], axis=1))


def unpack16(array: pa.Array, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(array.to_pylist()), dtype=np.uint16).reshape(-1, dim + 4)
    head = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return (head[:, 0:1] + raw[:, 4:].astype(np.float64) * head[:, 1:2]).astype(np.float32)


def _units(dim: int):
    schema = pa.schema([("id", pa.string()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = flat.reshape(-1, dim)
            norm = np.linalg.norm(rows, axis=1)
            good = np.isfinite(rows).all(axis=1) & np.isfinite(norm) & (norm > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pack16(rows[good] / norm[good, None])], schema=schema)

    return run


def _assign(centroids: np.ndarray, probes: int):
    """Each vector's nearest cells, nearest first, and how near their centroids are."""
    schema = pa.schema([("id", pa.string()), ("vec", pa.binary()), ("cells", pa.list_(pa.int32())), ("sims", pa.list_(pa.float32()))])
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = unpack16(batch.column(1), dim)
            near = np.empty((len(unit), min(probes + 1, len(centroids))), np.int32)
            sims = np.empty(near.shape, np.float32)
            for k in range(0, len(unit), 1024):
                s = unit[k : k + 1024] @ centroids.T
                top = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
                near[k : k + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1)
                sims[k : k + 1024] = np.take_along_axis(s, near[k : k + 1024], axis=1)
            offsets = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(near.ravel())), pa.ListArray.from_arrays(offsets, pa.array(sims.ravel()))], schema=schema)

    return run


def _fit_regions(dim: int):
    schema = pa.schema([("cell", pa.int32()), ("subs", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        sample = unpack16(table.column("vec").combine_chunks(), dim)
        cell = table.column("cell")[0].as_py()
        subs = fit_centroids(sample, min(len(sample), table.column("regions")[0].as_py()), seed=cell)
        return pa.Table.from_arrays([pa.array([cell], pa.int32()), pa.array([subs.astype(np.float32).tobytes()], pa.binary())], schema=schema)

    return run


def _route(dim: int, probes: int):
    """The nearest regions of a divided cell for the vectors that are nearest to it or may visit it."""
    offer = pa.struct([("sim", pa.float32()), ("region", pa.int64())])
    schema = pa.schema([("id", pa.string()), ("near", pa.list_(offer))])

    def run(rows: pa.Table, subs: pa.Table) -> pa.Table:
        if not len(rows) or not len(subs):
            return schema.empty_table()
        centres = np.frombuffer(subs.column("subs")[0].as_py(), np.float32).reshape(-1, dim)
        base = rows.column("cell")[0].as_py() << SHIFT
        most = np.where(rows.column("nth").to_numpy() == 0, probes + 1, OFFERED)
        unit, near = unpack16(rows.column("vec").combine_chunks(), dim), []
        for a in range(0, len(unit), 1024):
            sims = unit[a : a + 1024] @ centres.T
            for own, order, n in zip(sims, np.argsort(-sims, axis=1, kind="stable"), most[a : a + 1024].tolist()):
                near.append([{"sim": float(own[r]), "region": base + int(r)} for r in order[:n]])
        return pa.Table.from_arrays([rows.column("id").combine_chunks(), pa.array(near, pa.list_(offer))], schema=schema)

    return run


def _regions(placed: DataFrame, dim: int, probes: int) -> DataFrame:
    """(id, vec, region, probes): where each vector lives and the regions it visits, cells that outgrew their size divided.

    A divided cell is sampled by hash in proportion to its regions, and its centroids are fitted
    in one task on that bounded sample; they go to the tasks that route vectors to it, never to the driver.
    """
    whole = lambda c: c.cast("long") * (1 << SHIFT)
    big = cut(placed.groupBy(F.get("cells", F.lit(0)).alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > DIVIDE).withColumn("regions", F.least(F.lit(MAX_REGIONS), F.ceil(F.col("n") / CELL)).cast("int")))
    if not big.limit(1).count():
        all_cells = F.transform("cells", whole)
        return placed.select("id", "vec", F.get(all_cells, F.lit(0)).alias("region"), F.slice(all_cells, 2, probes).alias("probes"))
    # cells are at most MAX_CELLS, so what there is one row of for each is small
    big, probes = F.broadcast(big), max(probes, REGION_PROBES)
    share = F.least(F.lit(1.0), F.col("regions") * (1.2 * REGION_SAMPLE) / F.col("n"))
    sampled = placed.select("id", "vec", F.get("cells", F.lit(0)).alias("cell")).join(big, "cell").where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 20)) < share * (1 << 20) + 1)
    subs = cut(sampled.select("cell", "regions", "vec").groupBy("cell").applyInArrow(_fit_regions(dim), "cell int, subs binary"))
    aim = F.posexplode(F.arrays_zip("cells", "sims")).alias("nth", "c")
    meant = placed.select("id", "vec", aim).select("id", "vec", "nth", F.col("c.cells").alias("cell")).join(big.select("cell"), "cell")
    tasks = F.broadcast(meant.groupBy("cell").agg(F.ceil(F.count("*") / ROUTED).cast("int").alias("tasks")))
    rows = meant.join(tasks, "cell").withColumn("task", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int")).drop("tasks")
    centres = subs.join(tasks, "cell").select("cell", "subs", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    routed = rows.groupBy("cell", "task").cogroup(centres.groupBy("cell", "task")).applyInArrow(_route(dim, probes), "id string, near array<struct<sim:float,region:bigint>>")
    plain = placed.select("id", aim).select("id", F.col("c.cells").alias("cell"), F.col("c.sims").alias("sim")).join(big.select("cell"), "cell", "left_anti").select("id", F.array(F.struct("sim", whole(F.col("cell")).alias("region"))).alias("near"))
    found = plain.unionAll(routed).groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("near")), asc=False).alias("near"))
    near = found.select("id", F.transform("near", lambda x: x["region"]).alias("near")).select("id", F.get("near", F.lit(0)).alias("region"), F.slice("near", 2, probes).alias("probes"))
    return cut(placed.select("id", "vec").join(near, "id"))


_HOME = "id string, region long, part int, code binary, scale binary, floor double, others array<string>, sims array<double>, probes array<bigint>"


def _home(centroids: np.ndarray, k: int):
    dim = centroids.shape[1]
    fields = [("id", pa.string()), ("region", pa.int64()), ("part", pa.int32()), ("code", pa.binary()), ("scale", pa.binary()), ("floor", pa.float64()), ("others", pa.list_(pa.string())), ("sims", pa.list_(pa.float64())), ("probes", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(table: pa.Table) -> pa.Table:
        turned = rotation(dim)
        unit = unpack16(table.column("vec").combine_chunks(), dim)
        n, centre = len(unit), centroids[table.column("region")[0].as_py() >> SHIFT]
        bits, scalars = encode(unit, centre, turned)
        rotated = (unit - centre) @ turned
        length = np.linalg.norm(rotated, axis=1)
        at_centre = unit @ centre
        whole, scale = twelve_bits(unit @ turned)
        ids = table.column("id").to_pylist()
        floor = np.full(n, -2.0)
        others: list[list[str]] = []
        sims: list[list[float]] = []
        for a in range(0, n, 512):
            b = min(n, a + 512)
            est, err = estimate(bits, scalars, rotated[a:b], at_centre[a:b], dim)
            reach = EPSILON * length[a:b, None] * err[None, :] + 1e-5
            own = np.arange(b - a)
            low = est - reach
            low[own, own + a] = -9
            if n > k:
                kth = np.partition(low, n - k, axis=1)[:, n - k]
                chosen = est + reach >= kth[:, None]
            else:
                chosen = np.ones(est.shape, bool)
            chosen[own, own + a] = False
            q, o = np.nonzero(chosen)
            exact = np.concatenate([np.einsum("ij,ij->i", unit[q[s : s + 8192] + a], unit[o[s : s + 8192]], dtype=np.float64) for s in range(0, len(q), 8192)]) if len(q) else np.zeros(0)
            order = np.lexsort((o, -exact, q))
            q, o, exact = q[order], o[order], exact[order]
            start = np.searchsorted(q, own)
            stop = np.searchsorted(q, own, side="right")
            for i in range(b - a):
                s, e = int(start[i]), int(min(stop[i], start[i] + k))
                others.append([ids[x] for x in o[s:e].tolist()])
                sims.append(exact[s:e].tolist())
                if e - s == k:
                    floor[a + i] = exact[e - 1]
        arrays = [table.column("id").combine_chunks(), table.column("region").combine_chunks(), table.column("part").combine_chunks(), _blobs(whole), _blobs(scale), pa.array(floor), pa.array(others, pa.list_(pa.string())), pa.array(sims, pa.list_(pa.float64())), table.column("probes").combine_chunks()]
        return pa.Table.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return run


def _visit(centroids: np.ndarray):
    dim = centroids.shape[1]
    schema = pa.schema([("id", pa.string()), ("other", pa.string()), ("similarity", pa.float64())])

    def run(rows: pa.Table, visits: pa.Table) -> pa.Table:
        if not len(rows) or not len(visits):
            return schema.empty_table()
        turned = rotation(dim)
        centre = centroids[rows.column("region")[0].as_py() >> SHIFT]
        unit = unpack16(rows.column("vec").combine_chunks(), dim)
        bits, scalars = encode(unit, centre, turned)
        full, moved = unit @ turned, centre @ turned
        code = np.frombuffer(b"".join(visits.column("vcode").to_pylist()), dtype=np.uint8).reshape(len(visits), -1)
        scale = _matrix(visits.column("vscale").combine_chunks(), 3)
        floor = visits.column("vfloor").to_numpy()
        left, right, sims = [], [], []
        for a in range(0, len(visits), 1024):
            query = from_twelve(code[a : a + 1024], scale[a : a + 1024], dim)
            residual = query - moved
            est, err = estimate(bits, scalars, residual, query @ moved, dim)
            length = np.linalg.norm(residual, axis=1)
            reach = EPSILON * length[:, None] * err[None, :] + scale[a : a + 1024, 2][:, None] + 1e-5
            q, o = np.nonzero(est + reach > floor[a : a + 1024, None])
            for k in range(0, len(q), 8192):
                exact = np.einsum("ij,ij->i", query[q[k : k + 8192]], full[o[k : k + 8192]], dtype=np.float64)
                better = exact > floor[q[k : k + 8192] + a]
                left.append(q[k : k + 8192][better] + a), right.append(o[k : k + 8192][better]), sims.append(exact[better])
        if not left:
            return schema.empty_table()
        q, o = np.concatenate(left), np.concatenate(right)
        out = pa.Table.from_arrays([visits.column("visitor").take(pa.array(q)), rows.column("id").take(pa.array(o)), pa.array(np.concatenate(sims))], schema=schema)
        return out.filter(pc.not_equal(out.column("id"), out.column("other")))

    return run


def most_similar(df: DataFrame, key: str, order: str, op: str, vector: str, dim: int = 384, k: int = 5, probes: int = PROBES) -> DataFrame:
    """The k most similar other live vectors of every live one: id, rank, other, similarity (cosine).

    Live: the key's row of highest ``order`` is an ``add`` with exactly ``dim`` finite
    values, not all zero. Lengths don't matter. Equal vectors under different keys are
    different ones; ties go to the smaller key. With fewer than k + 1 live vectors each
    gets all others. An empty index gives an empty result. The centroids are fitted on
    at most ``PER_CENTROID * MAX_CELLS`` vectors; every vector is indexed.
    """
    unit = live_rows(df, key, order, op, vector, dim).mapInArrow(_units(dim), "id string, vec binary")
    # the centroids need no liveness: a bounded sample of the adds, by hash of the key
    adds = df.where((F.col(op) == "add") & (F.size(vector) == dim)).select(F.col(key).alias("id"), F.col(vector).alias("embedding"))
    total = adds.count()
    cells = min(MAX_CELLS, max(1, total // CELL))
    size = max(SAMPLE, PER_CENTROID * cells)
    share = min(1.0, 1.2 * size / max(1, total))
    near = adds.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    picked = near.orderBy(F.xxhash64("id"), "id").limit(size).mapInArrow(_units(dim), "id string, vec binary").select("vec").toArrow()
    sample = unpack16(picked.column("vec").combine_chunks(), dim) if len(picked) else np.zeros((0, dim), np.float32)
    if not len(sample):
        return df.sparkSession.createDataFrame([], "id string, rank int, other string, similarity double")
    centroids = fit_centroids(sample, min(len(sample), cells))

    placed = cut(unit.mapInArrow(_assign(centroids, probes), "id string, vec binary, cells array<int>, sims array<float>"))
    settled = _regions(placed, dim, probes)
    # a region that equal vectors make large is dealt into boxes by hash, which visit each other
    parts = counted(settled.groupBy("region").agg(F.ceil(F.count("*") / BOX).cast("int").alias("parts")), BROADCAST_ROWS)
    boxed = settled.join(parts, "region").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    home = cut(boxed.select("id", "vec", "region", "part", "probes").groupBy("region", "part").applyInArrow(_home(centroids, k), _HOME))

    every = F.sequence(F.lit(0), F.col("parts") - 1)
    aims = F.posexplode(F.concat(F.array("region"), "probes")).alias("nth", "region")
    visited = home.select("id", F.col("part").alias("own"), aims).join(parts, "region").select("id", "region", "nth", "own", F.explode(every).alias("part")).where("nth > 0 or part <> own")
    tasks = counted(visited.groupBy("region", "part").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("tasks")), BROADCAST_ROWS)

    wide = home.select("id", "code", "scale", "floor", F.col("part").alias("own"), aims).join(parts, "region")
    visits = wide.select("id", "code", "scale", "floor", "region", "nth", "own", F.explode(every).alias("part")).where("nth > 0 or part <> own")
    visits = visits.join(tasks, ["region", "part"]).select(
        F.col("id").alias("visitor"), F.col("code").alias("vcode"), F.col("scale").alias("vscale"), F.col("floor").alias("vfloor"), F.col("region").alias("vregion"), F.col("part").alias("vpart"),
        F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int").alias("vtask"),
    )
    rows = boxed.join(tasks, ["region", "part"]).select("id", "vec", "region", "part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    met = rows.groupBy("region", "part", "task").cogroup(visits.groupBy("vregion", "vpart", "vtask"))
    far = met.applyInArrow(_visit(centroids), "id string, other string, similarity double")
    near_by = home.select("id", F.explode(F.arrays_zip("others", "sims")).alias("x")).select("id", F.col("x.others").alias("other"), F.col("x.sims").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return near_by.unionAll(far).withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "other", "similarity")
