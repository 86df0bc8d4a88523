"""Exact and cluster-pruned search of a vector index kept as an append-only log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Query vectors that one pass over the index answers; a larger query set meets the index in a grid of boxes of about so many rows.
QUERY_BLOCK = 4096
ROW_BOX = 65536
#: Vectors of a pack, rows of the index that are divided into cells together, rows of such a cell, and rows that one task sees.
PACK, SHARE, CELL_ROWS, TASK_ROWS = 16384, 65536, 256, 1_048_576


def latest_state(log: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The row of highest ``order`` of each key: upserts and deletes folded. Null keys have no row."""
    rest = [c for c in log.columns if c != key]
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s"))
    return last.select(key, *[F.col(f"s.{c}").alias(c) for c in rest])


def live(log: DataFrame, dim: int, key: str = "id", order: str = "seq", op: str = "op", vector: str = "embedding") -> DataFrame:
    """Keys whose last row is an add of ``dim`` finite values, not all zero."""
    state = latest_state(log, key, order).where((F.col(op) == "add") & (F.size(vector) == dim))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return state.where(finite & F.exists(vector, lambda x: x != 0))


def index_stats(log: DataFrame, key: str = "id", order: str = "seq", op: str = "op") -> DataFrame:
    state = latest_state(log.select(key, order, op), key, order)
    deleted = F.count_if(F.coalesce(F.col(op) == "delete", F.lit(False)))
    return state.agg((F.count("*") - deleted).alias("live"), F.count("*").alias("total"), deleted.alias("deleted"))


def _scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    inner = queries @ rows.T
    if metric == "sqeuclidean":
        far = (queries**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None, :] - 2 * inner
        return 1 - np.clip(far, 0, 1)
    length = np.sqrt((queries**2).sum(axis=1))[:, None] * np.sqrt((rows**2).sum(axis=1))[None, :]
    out = np.divide(inner, length, out=np.zeros_like(inner), where=length > 0)
    return out if metric == "raw_cosine" else np.clip(out, 0, 1)


def _rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column that have ``dim`` numbers, as a matrix, and their places."""
    sized = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = column.filter(sized).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    whole = ~np.isnan(rows).any(axis=1)
    return rows[whole], np.flatnonzero(sized.to_numpy(zero_copy_only=False))[whole]


def _by_size(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, places) of the vectors of each size that occurs."""
    sizes = pc.unique(pc.list_value_length(column).drop_null()).to_pylist()
    return [_rows(column, n) for n in sizes if n]


def _chunk_best(asked: np.ndarray, keys: np.ndarray, rows: np.ndarray, names: np.ndarray, k: int, metric: str, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query keys, names, scores) of the k best rows of each query; of equal scores the smaller name."""
    for a in range(0, len(asked), 1024):
        score = np.round(_scores(asked[a : a + 1024], rows, metric), digits) + 0.0
        for q, row in enumerate(score):
            chosen = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
            chosen = chosen[np.lexsort((names[chosen], -row[chosen]))][:k]
            yield np.repeat(keys[a + q : a + q + 1], len(chosen)), names[chosen], row[chosen]


def _hits(found: list, schema: pa.Schema) -> pa.RecordBatch:
    parts = [np.concatenate([f[i] for f in found]).tolist() if found else [] for i in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(parts, schema)], schema=schema)


def _one_pass(asked: list[tuple[np.ndarray, np.ndarray]], k: int, metric: str, digits: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = []
            for keys, matrix in asked:
                rows, places = _rows(batch.column(1), matrix.shape[1])
                if len(rows):
                    names = np.array(batch.column(0).take(pa.array(places)).to_pylist())
                    found += _chunk_best(matrix, keys, rows, names, k, metric, digits)
            yield _hits(found, schema)

    return run


def _one_box(k: int, metric: str, digits: int, schema: pa.Schema):
    """The best rows of one box for the queries that meet it, kept to k a query while its rows pass."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        held: dict[int, list] = {}
        if not len(rows) or not len(queries):
            return schema.empty_table()
        column, names = rows.column("v").combine_chunks(), rows.column("id").combine_chunks()
        asked = queries.column("query_vector").combine_chunks()
        for matrix, at in _by_size(asked):
            for start in range(0, len(rows), 8192):
                values, places = _rows(column.slice(start, 8192), matrix.shape[1])
                if not len(values):
                    continue
                own = np.array(names.take(pa.array(places + start)).to_pylist())
                for q, n, s in _chunk_best(matrix, at, values, own, k, metric, digits):
                    if len(q):
                        if int(q[0]) in held:
                            n, s = (np.concatenate(x) for x in ((held[int(q[0])][0], n), (held[int(q[0])][1], s)))
                            best = np.lexsort((n, -s))[:k]
                            n, s = n[best], s[best]
                        held[int(q[0])] = [n, s]
        keys = queries.column("query_id").combine_chunks()
        at = np.repeat(np.fromiter(held, np.int64, len(held)), [len(n) for n, _ in held.values()])
        both = [pa.array(np.concatenate([x[i] for x in held.values()]).tolist() if held else [], schema.field(i + 1).type) for i in range(2)]
        return pa.Table.from_arrays([keys.take(pa.array(at, pa.int64())), *both], schema=schema)

    return run


def _kind(df: DataFrame, key: str) -> tuple[str, pa.DataType]:
    name = df.schema[key].dataType.simpleString()
    return name, {"bigint": pa.int64(), "int": pa.int32()}.get(name, pa.string())


def meet(rows: DataFrame, asked: DataFrame, run, schema: str, box: int, most: int, least: int = 1) -> DataFrame:
    """``run`` on every pair of a box of rows and a set of asked ones of the same ``cell``.

    A cell of any size is dealt by hash into boxes of about ``box`` rows and what is asked of it
    into sets of about ``most``; each box meets each set in one task. Only the counts of the
    cells, which the index bounds, are broadcast. ``rows`` have an id, ``asked`` a query_id.
    """
    rows_of = rows.groupBy("cell").agg(F.greatest(F.lit(least), F.ceil(F.count("*") / box)).cast("int").alias("_boxes"))
    sets_of = asked.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("_sets"))
    plan = F.broadcast(rows_of.join(sets_of, "cell"))
    left = rows.join(plan, "cell").select(*rows.columns, F.pmod(F.xxhash64(*[c for c in rows.columns if c != "cell"]), F.col("_boxes")).cast("int").alias("box"), F.explode(F.sequence(F.lit(0), F.col("_sets") - 1)).alias("set"))
    right = asked.join(plan, "cell").select(*asked.columns, F.explode(F.sequence(F.lit(0), F.col("_boxes") - 1)).alias("box"), F.pmod(F.xxhash64("query_id"), F.col("_sets")).cast("int").alias("set"))
    keys = ("cell", "box", "set")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _search_boxes(vectors: DataFrame, queries: DataFrame, k: int, metric: str, digits: int, box: int, asked: int, least: int = 1) -> DataFrame:
    """Hits of (id, v, cell) for (query_id, query_vector, cell), cell by cell."""
    name, kind = _kind(vectors, "id")
    wanted, q_kind = _kind(queries, "query_id")
    schema = pa.schema([("query_id", q_kind), ("id", kind), ("similarity", pa.float64())])
    return meet(vectors, queries, _one_box(k, metric, digits, schema), f"query_id {wanted}, id {name}, similarity double", box, asked, least)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "id", vector: str = "embedding", digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """The k most similar rows of the index for every query: query_id, id, similarity, rank.

    ``queries`` have columns ``query_id`` and ``query_vector``. A set of up to ``block`` queries,
    which is looked at first, goes to all executors and is scored against each Arrow batch in
    one pass over the index, without a shuffle. A larger set is a grid: boxes of rows meet sets
    of queries, whatever the sizes of both. Each batch or box passes on its own k best only.
    Similarities are rounded to ``digits`` before ranking, ties go to the smaller id. Vectors
    that are null, of another size or without a number somewhere match nothing; zero vectors
    have similarity 0. No queries or no rows give no hits.
    """
    name, kind = _kind(vectors, key)
    asked = queries.where("query_vector is not null and size(query_vector) > 0").select("query_id", "query_vector")
    wanted, q_kind = _kind(asked, "query_id")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    head = asked.limit(block + 1).toArrow()
    if not len(head):
        return vectors.sparkSession.createDataFrame([], f"query_id {wanted}, id {name}, similarity double, rank int")
    if len(head) <= block:
        keys = np.array(head.column("query_id").to_pylist())
        sets = [(keys[at], matrix) for matrix, at in _by_size(head.column("query_vector").combine_chunks())]
        schema = pa.schema([("query_id", q_kind), ("id", kind), ("similarity", pa.float64())])
        return rank_hits(rows.mapInArrow(_one_pass(sets, k, metric, digits, schema), f"query_id {wanted}, id {name}, similarity double"), k)
    spread = vectors.sparkSession.sparkContext.defaultParallelism
    return rank_hits(_search_boxes(rows.withColumn("cell", F.lit(0)), asked.withColumn("cell", F.lit(0)), k, metric, digits, ROW_BOX, 4 * block, spread), k)


def rank_hits(hits: DataFrame, k: int, score: str = "similarity", query: str = "query_id", key: str = "id") -> DataFrame:
    """The k best hits of each query with their rank; ties go to the smaller key."""
    order = Window.partitionBy(query).orderBy(F.desc(score), key)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)



def _names(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids in a form that sorts as they do; strings as their bytes, which take a quarter of the space."""
    return column.to_numpy() if pa.types.is_integer(column.type) and not column.null_count else np.array(column.cast(pa.binary()).to_pylist())


def _fold_equal(rows: np.ndarray, table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Each distinct vector once, how many rows stand for it, and these: the ones of its k smallest ids."""
    plain = np.ascontiguousarray(rows + 0.0)
    _, first, same = np.unique(plain.view(np.dtype((np.void, plain.itemsize * plain.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((_names(table.column("id")), same))
    order = order[_places(same[order]) < k]
    return rows[first], np.bincount(same[order]), table.take(pa.array(order))


def _places(sorted_keys: np.ndarray) -> np.ndarray:
    """The place of each element among those of its key, from 0."""
    starts = np.flatnonzero(np.r_[True, np.diff(sorted_keys) != 0]) if len(sorted_keys) else np.empty(0, np.int64)
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_keys)]))


def _means(table: pa.Table, vectors: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(matrix, places) by size of the mean of a row's vectors; the first must be there, the others count if they are of its size."""
    first, *others = (table.column(c).combine_chunks() for c in vectors)
    for matrix, at in _by_size(first):
        total, n = matrix.copy(), np.ones(len(at))
        for column in others:
            more, places = _rows(column.take(pa.array(at)), matrix.shape[1])
            total[places] += more
            n[places] += 1
        yield total / n[:, None], at


def _sealed(*tables: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    for table in tables:
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(table)
    return sink.getvalue().to_pybytes()


def _raw(**arrays: np.ndarray) -> pa.Table:
    return pa.table({name: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for name, x in arrays.items()})


def packs(df: DataFrame, sides: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Rows packed for ``pack_hits``: side, dim, n, pack. ``sides``: for ``rows`` and ``asked`` the vectors, of which the mean counts, and the columns to keep.

    A pack holds some thousand vectors of one size, compressed. Vectors that are null or lack a number are left out.
    """
    needed = sorted({c for vectors, kept in sides.values() for c in (*vectors, *kept)})

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for side, (vectors, kept) in sides.items():
            for matrix, at in _means(table, vectors):
                for a in range(0, len(matrix), PACK):
                    data = _sealed(_raw(v=matrix[a : a + PACK]), table.select(kept).take(pa.array(at[a : a + PACK])))
                    yield pa.RecordBatch.from_pydict({"side": [side], "dim": pa.array([matrix.shape[1]], pa.int32()), "n": [len(at[a : a + PACK])], "pack": [data]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACK:
                yield from packed(pa.Table.from_batches(held))
                held = []
        if held:
            yield from packed(pa.Table.from_batches(held))

    return df.select(*needed).mapInArrow(run, "side string, dim int, n long, pack binary")


def _opened(pack: pa.Buffer) -> tuple[pa.Table, pa.Table]:
    source = pa.BufferReader(pack)
    return tuple(pa.ipc.open_stream(source).read_all() for _ in range(2))


def _matrix(table: pa.Table, name: str, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(table.column(name)[0].as_buffer(), kind).reshape(*shape)


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((rows**2).sum(axis=1))
    return length, np.divide(rows, length[:, None], out=np.zeros_like(rows), where=length[:, None] > 0).astype(np.float32)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(rows[a : a + 4096] @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1) for a in range(0, len(rows), 4096)])


def _centres(rows: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Centres of cells, only to look at near rows first and to leave out far ones; they decide about no hit."""
    rng = np.random.default_rng(7)
    some = rows[rng.permutation(len(rows))[: 64 * k]]
    centres = some[:k].copy()
    for _ in range(rounds):
        own = _nearest(some, centres)
        n = np.bincount(own, minlength=k)
        for i in range(rows.shape[1]):
            centres[:, i] = np.where(n > 0, np.bincount(own, some[:, i], k) / np.maximum(n, 1), centres[:, i])
    return centres


def _apart(centres: np.ndarray) -> np.ndarray:
    """Distances of the centres; without end where they are too small to divide by."""
    far = np.sqrt(np.maximum(0, (centres**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * centres @ centres.T))
    return np.where(far > 0.01, far, np.inf).astype(np.float32)


def _share(tables: list[tuple[pa.Table, pa.Table]], dim: int, k: int) -> bytes:
    """Rows in the order of their cells: centres, how far each cell reaches towards each other centre, sizes, and the rows.

    Equal vectors are one, with the rows of its k smallest ids.
    """
    values, counts, rest = _fold_equal(np.concatenate([_matrix(data, "v", np.float64, -1, dim) for data, _ in tables]), pa.concat_tables([x for _, x in tables]), k)
    unit = _unit(values)[1]
    centres = _centres(unit, max(1, len(unit) // CELL_ROWS))
    cell = _nearest(unit, centres)
    order = np.argsort(cell, kind="stable")
    sizes, apart = np.bincount(cell, minlength=len(centres)), _apart(centres)
    reach = np.full(apart.shape, -np.inf, np.float32)
    ends = np.cumsum(sizes)
    for c in np.flatnonzero(sizes):
        along = unit[order[ends[c] - sizes[c] : ends[c]]] @ centres.T
        reach[c] = ((along - along[:, c : c + 1]) / apart[c]).max(axis=0)
    starts = np.cumsum(counts) - counts
    n = counts[order]
    members = np.repeat(starts[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return _sealed(_raw(v=values[order], n=n, centres=centres, sizes=sizes, reach=reach), rest.take(pa.array(members)))


class _Asked:
    """A pack of asked vectors and the best rows that it has met.

    Cells that lie too far away, by the triangle inequality, are left out, and so is what a product in
    single precision, whose error is bounded, shows to be no hit. The rest is scored in double precision,
    and only that decides: the hits are those of a comparison with every row.
    """

    def __init__(self, values: np.ndarray, keys: pa.Table, k: int, digits: int, least: float):
        self.values, self.keys, self.k, self.digits = values, keys, k, digits
        self.length, self.unit = _unit(values)
        self.slack = (values.shape[1] + 8) * 2.0**-24 + 0.5 * 10.0**-digits
        self.bound = np.full(len(values), least)  # no row below it is among the k best
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))  # asked, row, similarity
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.members, self.pairs = 0, 0, 0
        self.rows: list[pa.Table] = []

    def _low(self, of: np.ndarray | slice) -> np.ndarray:
        return np.where(self.bound[of] > 0, self.bound[of] - self.slack, -np.inf).astype(np.float32)

    def meet(self, data: pa.Table, rest: pa.Table) -> None:
        dim = self.values.shape[1]
        values, counts, sizes = _matrix(data, "v", np.float64, -1, dim), _matrix(data, "n", np.int64, -1), _matrix(data, "sizes", np.int64, -1)
        centres, reach = _matrix(data, "centres", np.float32, -1, dim), _matrix(data, "reach", np.float32, len(sizes), -1)
        first = self.members + np.cumsum(counts) - counts
        self.rows.append(rest)
        self.members += len(rest)
        length, unit = _unit(values)
        ends, apart = np.cumsum(sizes), _apart(centres)

        def cells(chosen: np.ndarray, asked: int, cut: bool) -> None:
            for c in np.flatnonzero(chosen.any(axis=1) & (sizes > 0)):
                some = asked + np.flatnonzero(chosen[c])
                for b in range(ends[c] - sizes[c], ends[c], 1024):
                    part = np.ascontiguousarray(unit[b : min(b + 1024, ends[c])].T)
                    step = max(64, 2**19 // part.shape[1])
                    for a in range(0, len(some), step):
                        own = some[a : a + step]
                        score = self.unit[own] @ part
                        if cut and part.shape[1] > 4 * self.k:
                            # k rows of this cell are as good as the k-th of them
                            kth = np.partition(score, part.shape[1] - self.k, axis=1)[:, part.shape[1] - self.k]
                            self.bound[own] = np.maximum(self.bound[own], kth - self.slack)
                        at = np.flatnonzero(score >= self._low(own)[:, None])
                        self.pairs += score.size
                        if len(at):
                            self._score(own[at // part.shape[1]], b + at % part.shape[1], values, length, first, counts)
            self._merge()

        for a in range(0, len(self.unit), 4096):
            along = self.unit[a : a + 4096] @ centres.T
            near = along - 0.5 * (centres**2).sum(axis=1)
            own, lines = near.argmax(axis=1), np.arange(len(near))
            most = max(0, len(centres) - 4)
            done = np.zeros(near.shape[::-1], bool)
            done[own, lines] = True
            cells(done, a, True)
            more = np.zeros_like(done)
            more[np.argpartition(near, most, axis=1)[:, most:] if most else np.arange(len(centres)), lines[:, None]] = True
            cells(more & ~done, a, False)
            done |= more
            low = self._low(slice(a, a + 4096))
            far = np.sqrt(np.maximum(0, 2 - 2 * np.where(np.isfinite(low), low, -1))) + 0.001 + 400 * (dim + 8) * 2.0**-24
            way = np.where(np.isfinite(apart[own]), (along[lines, own][:, None] - along) / apart[own] - reach.T[own], -np.inf)
            cells((way <= far[:, None]).T & ~done, a, False)

    def _score(self, asked: np.ndarray, rows: np.ndarray, values: np.ndarray, length: np.ndarray, first: np.ndarray, counts: np.ndarray) -> None:
        for a in range(0, len(asked), 16384):
            q, r = asked[a : a + 16384], rows[a : a + 16384]
            inner, both = np.einsum("ij,ij->i", self.values[q], values[r]), self.length[q] * length[r]
            score = np.round(np.clip(np.divide(inner, both, out=np.zeros_like(inner), where=both > 0), 0, 1), self.digits) + 0.0
            kept = score >= self.bound[q]
            q, r, score = q[kept], r[kept], score[kept]
            n = counts[r]
            self.found.append((np.repeat(q, n), np.repeat(first[r] - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(score, n)))
            self.waiting += len(self.found[-1][0])
            if self.waiting > 400_000:
                self._merge()

    def _merge(self) -> None:
        """Keeps the k best of each asked vector and what equals the last of them, as far as that are not too many."""
        self.best, self.found, self.waiting = tuple(np.concatenate(x) for x in zip(self.best, *self.found)), [], 0
        self._keep(ties=True)
        if len(self.best[0]) > max(65536, 4 * self.k * len(self.values)):
            self._keep(ties=False)

    def _keep(self, ties: bool) -> None:
        at, row, score = self.best
        order = np.lexsort((-score, at) if ties else (_names(self._taken(row).column("id")), -score, at))
        at, row, score = at[order], row[order], score[order]
        place = _places(at)
        last = np.full(len(self.values), -np.inf)
        last[at[place == self.k - 1]] = score[place == self.k - 1]
        self.bound = np.maximum(self.bound, last)
        kept = (place < self.k) | (score == last[at]) if ties else place < self.k
        self.best = at[kept], row[kept], score[kept]

    def _taken(self, row: np.ndarray) -> pa.Table:
        return pa.concat_tables(self.rows).take(pa.array(row))

    def hits(self, schema: pa.Schema) -> pa.RecordBatch:
        """The asked columns and their hits, best first; asked vectors without any have no row."""
        self._merge()
        if not len(self.best[0]):
            return pa.RecordBatch.from_pylist([], schema=schema)
        self._keep(ties=False)
        at, row, score = self.best
        rows, field = self._taken(row), schema.field("hits").type.value_field
        parts = {"similarity": pa.array(score)} | {c: rows.column(c).combine_chunks() for c in rows.column_names}
        each = pa.StructArray.from_arrays([parts[f.name].cast(f.type) for f in field.type], fields=list(field.type))
        starts = np.flatnonzero(_places(at) == 0)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(at)].astype(np.int32)), each, type=schema.field("hits").type)
        keys = self.keys.take(pa.array(at[starts]))
        return pa.RecordBatch.from_arrays([*(keys.column(f.name).combine_chunks().cast(f.type) for f in schema if f.name != "hits"), lists], schema=schema)


def pack_hits(packed: DataFrame, asked: str, rows: str, k: int, digits: int = 6, least: float = 0.0) -> DataFrame:
    """The k rows of highest cosine, ``least`` or more, for each asked vector: the asked columns and ``hits``, best first.

    ``asked`` and ``rows`` are the columns that the packs keep (DDL); rows have an ``id``. A hit has the similarity,
    rounded before it is ranked, and the columns of its row. Ties go to the smaller id. Packs are written once and rows
    put into the order of cells; each pack of asked vectors meets up to ``TASK_ROWS`` rows in a task, which passes on its
    own k best. So nothing is copied for the pairs, and only these hits are shuffled, if there is more than one such task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"{asked}, hits array<struct<similarity: double, {rows}>>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    held = cut(packed).withColumn("no", F.monotonically_increasing_id())
    count = {r.side: r for r in held.groupBy("side").agg(F.count("*").alias("packs"), F.sum("n").alias("n")).collect()}
    if len(count) < 2:
        return packed.sparkSession.createDataFrame([], ddl)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def done(dim: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"row_dim": pa.array([dim], pa.int32()), "rows": [_share(waiting.pop(dim), dim, k)]})

        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                waiting.setdefault(dim, []).append(_opened(batch.column(1)[i].as_buffer()))
                if sum(len(x) for _, x in waiting[dim]) >= SHARE:
                    yield done(dim)
        for dim in list(waiting):
            yield done(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, now = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                n, dim = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if n != no:
                    if now:
                        yield now.hits(schema)
                    data, keys = _opened(batch.column(2)[i].as_buffer())
                    no, now = n, _Asked(_matrix(data, "v", np.float64, -1, dim), keys, k, digits, least)
                now.meet(*_opened(batch.column(3)[i].as_buffer()))
                pa.default_memory_pool().release_unused()
        if now:
            yield now.hits(schema)

    tasks = -(-count["rows"].n // TASK_ROWS)
    raw = held.where("side = 'rows'").select("dim", "pack", "no").repartitionByRange(-(-count["rows"].n // SHARE), "no").select("dim", "pack")
    right = cut(raw.mapInArrow(shares, "row_dim int, rows binary")).withColumn("row_no", F.monotonically_increasing_id()).repartitionByRange(tasks, "row_no")
    left = held.where("side = 'asked'").select("no", "dim", F.col("pack").alias("asked")).repartitionByRange(count["asked"].packs, "no")
    pairs = left.join(right.hint("shuffle_replicate_nl"), F.col("dim") == F.col("row_dim")).select("no", "dim", "asked", "rows")
    found = pairs.mapInArrow(run, ddl)
    if tasks == 1:
        return found
    keys = [c for c in found.columns if c != "hits"]
    best = F.array_sort(F.transform(F.flatten(F.collect_list("hits")), lambda x: F.struct((-x["similarity"]).alias("far"), x["id"].alias("id"), x.alias("hit"))))
    return found.groupBy(*keys).agg(F.transform(F.slice(best, 1, k), lambda x: x["hit"]).alias("hits"))


def mean_vectors(vectors: DataFrame, group: str, vector: str = "embedding", digits: int = 9) -> DataFrame:
    """The mean vector of each value of a column that has few: cell, centroid, rounded to ``digits``.

    Each batch passes on one sum a group; vectors of another size than most of a group's are no part of it.
    """
    kind = vectors.schema[group].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, column = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1)
            out: tuple[list, list, list] = ([], [], [])
            for rows, at in _by_size(column):
                own = cells[at]
                for cell in {c for c in own.tolist() if c is not None}:
                    mine = rows[own == cell]
                    out[0].append(cell), out[1].append(mine.sum(axis=0)), out[2].append(len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.list_(pa.float64())), pa.array(out[2], pa.int64())], names=["cell", "total", "n"])

    parts = vectors.select(F.col(group).alias("cell"), F.col(vector).alias("v")).mapInArrow(sums, f"cell {kind}, total array<double>, n long")
    sized = parts.groupBy("cell", F.size("total").alias("dim")).agg(F.sum("n").alias("n"), F.collect_list("total").alias("totals"))
    added = F.transform(F.sequence(F.lit(0), F.col("dim") - 1), lambda i: F.round(F.aggregate("totals", F.lit(0.0), lambda s, t: s + F.get(t, i)) / F.col("n"), digits))
    return sized.select("cell", F.struct("n", "dim", added.alias("centroid")).alias("m")).groupBy("cell").agg(F.max("m").alias("m")).select("cell", "m.centroid")


def _lists(centroids: DataFrame) -> tuple[list, np.ndarray]:
    """Names and matrix of the index's lists in order of their names; their number is a parameter of the index."""
    held = sorted((r.cell, r.centroid) for r in centroids.collect())
    return [c for c, _ in held], np.array([v for _, v in held], dtype=np.float64)


def _near(cells: list, matrix: np.ndarray, probes: int, field: pa.Field, digits: int = 9):
    """Appends the names of the nearest lists; vectors of another size have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places = _rows(batch.column(batch.num_columns - 1), matrix.shape[1])
            near: list = [None] * batch.num_rows
            for a in range(0, len(rows), 1024):
                part = rows[a : a + 1024]
                far = np.round(np.stack([((part - c) ** 2).sum(axis=1) for c in matrix], axis=1), digits)
                order = np.argsort(far, axis=1, kind="stable")[:, :probes]
                for at, own in zip(places[a : a + 1024].tolist(), order.tolist()):
                    near[at] = cells[own[0]] if probes == 1 and not pa.types.is_list(field.type) else [cells[i] for i in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(near, field.type)], names=[*batch.schema.names[:-1], field.name])

    return run


def _with_near(df: DataFrame, centroids: DataFrame, vector: str, probes: int, to: str, many: bool) -> DataFrame:
    cells, matrix = _lists(centroids)
    name, kind = _kind(centroids, "cell")
    field = pa.field(to, pa.list_(kind) if many else kind)
    kept = [c for c in df.columns if c != to]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != to)
    kind_sql = f"array<{name}>" if many else name
    if not cells:
        return df.select(*kept, F.lit(None).cast(kind_sql).alias(to))
    return df.select(*kept, F.col(vector).alias("_vector")).mapInArrow(_near(cells, matrix, probes, field), f"{schema}, `{to}` {kind_sql}")


def assign_cells(vectors: DataFrame, centroids: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Each vector's nearest centroid by Euclidean distance: all columns and ``cell``; ties go to the smaller cell.

    The centroids are the fixed lists of the index and go to the executors as one matrix. Vectors
    that are null or of another size have a null cell.
    """
    return _with_near(vectors, centroids, vector, 1, "cell", many=False)


def probe_search(assigned: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, probes: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Top k among the members of each query's ``probes`` nearest lists, box by box, so a list that holds most vectors is many tasks."""
    probed = _with_near(queries.select("query_id", "query_vector"), centroids, "query_vector", probes, "cells", many=True)
    rows = assigned.where(F.col("cell").isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), "cell")
    return rank_hits(_search_boxes(rows, probed.select("query_id", "query_vector", F.explode("cells").alias("cell")), k, "cosine", 6, ROW_BOX, 4 * QUERY_BLOCK), k)


def fit_cells(vectors: DataFrame, k: int, vector: str = "embedding", seed: int = 7) -> DataFrame:
    """Centroids by k-means: cell, centroid."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=10).fit(points)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def filter_metadata(hits: DataFrame, wanted: dict[str, str], metadata: str = "metadata") -> Column:
    """Rows whose metadata has all wanted values."""
    ok = F.lit(True)
    for name, value in wanted.items():
        ok = ok & F.coalesce(F.col(metadata)[name] == value, F.lit(False))
    return hits.where(ok)
