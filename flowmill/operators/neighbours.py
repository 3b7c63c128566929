"""Exact nearest neighbours by cells around pivots.

Rows go to the cell of their nearest pivot; a cell knows how many rows it has and how near and far they
are to its pivot, and is cut into blocks. A query first meets one block of its own cell, which bounds the
distance of its k-th neighbour; the triangle inequality then rules out every cell that can't hold a nearer
row. Blocks of cells that lie together form groups, of queries and of rows. A task holds a group of rows, lets
a group of queries pass by and hands on the k best of each query, so that a query is sent once a group that
it meets, not once a cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import removed, written

#: Rows of a block (64 floats a row: 1 MB).
BLOCK_ROWS = 2048
#: Rows of a group of blocks at most (64 floats a row: 64 MB).
GROUP_ROWS = 131_072
#: Rows that pivots are chosen from, and pivots at most; a cell aims at so many rows.
SAMPLE, PIVOTS, CELL_ROWS = 4096, 256, 512
#: Distances are rounded: bounds are widened by this share of the largest.
SLACK = 1e-9
#: Queries compared at a time (with 2,048 rows: 4 or 8 MB), and pairs whose distances are found by differences at a time.
AT_ONCE, EXACT = 512, 1 << 15
NONE = np.iinfo(np.int64).max


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0))


def _pressed(x: np.ndarray) -> bytes:
    """Vectors byte by byte, so that the zeros of doubles that were floats take no room."""
    planes = np.ascontiguousarray(x, np.float64).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _loosened(pressed: bytes, n: int, dims: int) -> np.ndarray:
    planes = pa.decompress(pressed, decompressed_size=8 * n * dims, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.float64).reshape(n, dims)


def _without_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Which rows stay if only the first k + 1 of equal ones can be among the k nearest of any row."""
    _, kind = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * x.shape[1]))).ravel(), return_inverse=True)
    order = kind.argsort(kind="stable")
    rank = np.arange(len(x)) - np.searchsorted(kind[order], kind[order])
    return np.sort(order[rank <= k])


def _merged(best: tuple, i: np.ndarray, found: tuple, k: int) -> None:
    """Lets the pairs found (d, o, place) of queries i into best (d, o, place: k of each query, nearest first)."""
    rows = np.unique(i)
    of = np.concatenate([np.repeat(rows, k), i])
    every = [np.concatenate([b[rows].ravel(), f]) for b, f in zip(best, found, strict=True)]
    order = np.lexsort((every[1], every[0], of))
    first = order[np.searchsorted(of[order], rows)[:, None] + np.arange(k)]
    for b, f in zip(best, every, strict=True):
        b[rows] = f[first]


class Held:
    """Blocks of rows, ready to be compared: (ids, x, place of the first row)."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, int]], middle: np.ndarray):
        self.blocks, self.middle = blocks, middle
        self.ready = []
        for _, y, _ in blocks:
            ready = self._ready(y)
            with np.errstate(over="ignore"):
                self.ready.append((ready.astype(np.float32), math.sqrt(ready[-1].max(initial=0))))

    def _ready(self, y: np.ndarray) -> np.ndarray:
        y = y - self.middle
        return np.ascontiguousarray(np.column_stack([-2 * y, (y * y).sum(1)]).T)

    def closest(self, ids: np.ndarray, x: np.ndarray, most: np.ndarray, lower: np.ndarray, slack: float, k: int) -> tuple:
        """(d, o, place) of each query's k nearest rows but itself that are no further than `most` (squared); of
        equal distances, the smaller ids. lower: no row of a block is nearer than that."""
        most = most.copy()
        best = np.full((len(x), k), np.inf), np.full((len(x), k), NONE), np.full((len(x), k), -1)
        shifted = np.column_stack([x - self.middle, np.ones(len(x))])
        size = (shifted[:, :-1] ** 2).sum(1)
        with np.errstate(over="ignore"):
            short = shifted.astype(np.float32)
        # the same memory again and again, which is much cheaper than new pages for each block
        room = AT_ONCE * max((len(y) for _, y, _ in self.blocks), default=0)
        products, below = np.empty(8 * room, np.uint8), np.empty(room, bool)
        for j in lower.mean(0).argsort():  # near blocks first, so that the bounds are soon narrow
            (o_ids, y, place), (ready, largest) = self.blocks[j], self.ready[j]
            met = np.flatnonzero(lower[:, j] <= np.sqrt(most) + slack)
            for at in range(0, len(met), AT_ONCE):
                i = met[at : at + AT_ONCE]
                shape, scale = (len(i), len(y)), 4 * (x.shape[1] + 4) * (math.sqrt(size[i].max()) + largest) ** 2
                # single precision picks candidates where its error is small against the distances; they are compared exactly below
                kind, off = np.float32, scale * 2.0**-23 + 1e-30
                if not (scale < 1e30 and off <= 0.01 * np.median(most[i])):
                    kind, off = np.float64, scale * 2.0**-52
                left, right = (short[i], ready) if kind is np.float32 else (shifted[i], self._ready(y))
                # squared distances less the query's own size, rounded
                near = np.matmul(left, right, out=products[: len(i) * len(y) * left.itemsize].view(kind).reshape(shape))
                limit = (most[i] - size[i] + off).astype(kind)
                if len(y) > k + 1 and len(free := np.flatnonzero(np.isinf(limit))):
                    limit[free] = np.partition(near[free], k, axis=1)[:, k] + kind(2 * off)  # k + 1, as one may be the query itself
                hits = np.flatnonzero(np.less_equal(near, limit[:, None], out=below[: len(i) * len(y)].reshape(shape)))
                for part in range(0, len(hits), EXACT):
                    q, o = np.divmod(hits[part : part + EXACT], len(y))
                    q = i[q]
                    # by differences, so that equal rows are at the same distance in every block
                    d = ((x[q] - y[o]) ** 2).sum(1)
                    ok = np.flatnonzero((d <= most[q]) & (o_ids[o] != ids[q]))
                    if len(ok):
                        _merged(best, q[ok], (d[ok], o_ids[o[ok]], place + o[ok]), k)
                most[i] = np.minimum(most[i], best[0][i, -1])
        return best


def pivots(rows: DataFrame, seed: int = 42) -> np.ndarray:
    """Up to PIVOTS rows (x) far from one another, out of a sample of stated size."""
    # written first: else each task sends its own SAMPLE rows to the driver
    table = written(rows.orderBy(F.xxhash64(F.lit(seed), "row_id"), "row_id").limit(SAMPLE).select("row_id", "x"), "drawn")
    drawn = sorted(table.collect(), key=lambda r: r["row_id"])
    removed(table)
    if not drawn:
        return np.zeros((0, 0))
    x = np.array([r["x"] for r in drawn], float)
    chosen, far = [0], _apart(x, x[:1])[:, 0]
    for _ in range(min(PIVOTS, rows.count() // CELL_ROWS, len(x) - 1)):
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _apart(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


class Runs:
    """Blocks of cells, in an order that keeps near cells together, in groups of about so many rows."""

    def __init__(self, count: np.ndarray, parts: np.ndarray, order: np.ndarray, rows: int):
        self.parts, self.first = parts, np.zeros(len(parts), np.int64)
        self.first[order] = np.cumsum(parts[order]) - parts[order]
        size = np.repeat((count / parts)[order], parts[order])
        self.n = max(1, -(-int(count.sum()) // rows))
        self.group = np.minimum((np.cumsum(size) - size / 2) * self.n / max(1, count.sum()), self.n - 1).astype(np.int64)

    def of(self, cell: int, part: int) -> int:
        return int(self.group[self.first[cell] + part])


class Shape:
    """What tasks know of the cells: their pivots, how many rows each has, how near and far these are."""

    def __init__(self, centres: np.ndarray, k: int):
        self.centres, self.k = centres, k
        self.count, self.near, self.far = np.zeros(len(centres), np.int64), np.full(len(centres), np.inf), np.zeros(len(centres))

    @property
    def slack(self) -> float:
        return SLACK * float(np.abs(self.centres).max(initial=1.0) + self.far.max(initial=0.0))

    def lower(self, x: np.ndarray) -> np.ndarray:
        """No row of a cell is nearer to a query than that."""
        d = _apart(x, self.centres)
        return np.where(self.count > 0, np.maximum(d - self.far, self.near - d), np.inf)

    def sure(self, x: np.ndarray) -> np.ndarray:
        """The k nearest others of a query are surely no further than that: enough rows lie within the farthest of some cells."""
        upper = np.where(self.count > 0, _apart(x, self.centres) + self.far, np.inf)
        order = upper.argsort(1)
        enough = np.take_along_axis(np.broadcast_to(self.count, upper.shape), order, 1).cumsum(1) > self.k
        return np.where(enough.any(1), np.take_along_axis(upper, np.take_along_axis(order, enough.argmax(1)[:, None], 1), 1)[:, 0], np.inf)

    def meets(self, x: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which queries meet which cells, if they look no further than `most` (squared)."""
        return self.lower(x) <= (np.sqrt(most) + self.slack)[:, None]


class Cells:
    """The rows (row_id, x, tag) in blocks, and what is known of each cell."""

    def __init__(self, rows: DataFrame, centres: np.ndarray, k: int):
        self.centres, self.k, self.tag = centres, k, rows.schema["tag"].dataType.simpleString()
        placed = written(self._placed(rows), "cells")
        self.shape = Shape(centres, k)
        for c, n, lo, hi in placed.groupBy("cell").agg(F.count("*"), F.min("d"), F.max("d")).collect():  # a row a pivot
            self.shape.count[c], self.shape.near[c], self.shape.far[c] = n, lo, hi
        self.count = self.shape.count
        self.parts = np.maximum(1, -(-self.count // BLOCK_ROWS))
        self.blocks = written(self._packed(placed, self.parts, once=True), "cell-blocks")
        removed(placed)

    def _placed(self, rows: DataFrame) -> DataFrame:
        centres = self.centres

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    d = _apart(np.stack(pdf["x"]), centres)
                    yield pdf.assign(cell=d.argmin(1).astype(np.int32), d=d.min(1))

        extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("row_id", "x"))
        return rows.mapInPandas(run, f"row_id long, x array<double>{extra}, cell int, d double")

    def _packed(self, placed: DataFrame, parts: np.ndarray, once: bool) -> DataFrame:
        """(cell, part, ids, xs, tags): blocks of about BLOCK_ROWS rows, by row_id. once: without copies that can't be
        among the k nearest of any row."""
        k = self.k

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            t = t.combine_chunks().sort_by("row_id")
            ids, x = t.column("row_id").to_numpy(), np.asarray(t.column("x").combine_chunks().flatten(), np.float64).reshape(len(t), -1)
            tags = t.column("tag").combine_chunks()
            tags = tags if isinstance(tags, pa.Array) else tags.chunk(0)
            if once and len(kept := _without_copies(x, k)) < len(x):
                ids, x, tags = ids[kept], x[kept], tags.take(pa.array(kept))
            return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "xs": pa.array([_pressed(x)], pa.binary()), "tags": pa.ListArray.from_arrays(pa.array([0, len(tags)], pa.int32()), tags)})

        split = F.array(*[F.lit(int(p)) for p in parts])[F.col("cell")]
        rows = placed.withColumn("part", F.pmod(F.xxhash64("row_id"), split).cast("int")).select("cell", "part", "row_id", "x", "tag")
        return rows.groupBy("cell", "part").applyInArrow(pack, f"cell int, part int, ids binary, xs binary, tags array<{self.tag}>")

    def asked(self, queries: DataFrame, tasks: int) -> tuple[DataFrame, Runs, Runs]:
        """(cell, part, ids, xs, most): blocks of queries, each query having met a block of its own cell, which bounds the
        squared distance of its k-th neighbour; and the groups of the queries' blocks and of the rows'."""
        k, dims, kind = self.k, self.centres.shape[1], self.tag
        placed = written(self._placed(queries.drop("tag")).withColumn("tag", F.lit(None).cast(kind)), "query-cells")
        count = np.zeros(len(self.centres), np.int64)
        for c, n in placed.groupBy("cell").count().collect():  # a row a pivot
            count[c] = n
        parts = np.maximum(1, -(-count // BLOCK_ROWS))
        packed = written(self._packed(placed, parts, once=False).drop("tags"), "query-blocks")
        removed(placed)
        shape = self.shape

        def bound(batches):
            for b in batches:
                mosts = []
                for q_ids, q_xs, ids, xs in zip(*[b.column(j).to_pylist() for j in (2, 3, 4, 5)], strict=True):
                    q_ids = np.frombuffer(q_ids, np.int64)
                    q = _loosened(q_xs, len(q_ids), dims)
                    most = (shape.sure(q) + shape.slack) ** 2 * (1 + SLACK)
                    if ids is not None:
                        ids = np.frombuffer(ids, np.int64)
                        held = Held([(ids, _loosened(xs, len(ids), dims), 0)], q.mean(0))
                        own = held.closest(q_ids, q, np.full(len(q), np.inf), np.zeros((len(q), 1)), shape.slack, k)[0]
                        most = np.minimum(most, own[:, -1])
                    mosts.append(most.tobytes())
                yield pa.RecordBatch.from_arrays([*[b.column(j) for j in range(4)], pa.array(mosts, pa.binary())], ["cell", "part", "ids", "xs", "most"])

        own = F.pmod("part", F.array(*[F.lit(int(p)) for p in self.parts])[F.col("cell")]).cast("int")
        home = self.blocks.select("cell", F.col("part").alias("home"), F.col("ids").alias("o_ids"), F.col("xs").alias("o_xs"))
        met = packed.withColumn("home", own).join(home, ["cell", "home"], "left").select("cell", "part", "ids", "xs", "o_ids", "o_xs")
        asked = written(met.mapInArrow(bound, "cell int, part int, ids binary, xs binary, most binary"), "asked")
        removed(packed)
        rows = int(min(GROUP_ROWS, max(BLOCK_ROWS, math.sqrt(float(count.sum()) * float(self.count.sum()) / tasks))))
        few = max(1, -(-int(self.count.sum()) // rows))
        order = _apart(self.centres, self.centres[:few]).argmin(1).argsort(kind="stable")
        return asked, Runs(count, parts, order, rows), Runs(self.count, self.parts, order, rows)

    def visits(self, asked: DataFrame) -> DataFrame:
        """(cell, part, ids): the queries that each block of rows meets at most, BLOCK_ROWS queries at a time."""
        dims, parts, shape = self.centres.shape[1], self.parts, self.shape

        def run(batches):
            blocks = (tuple(v.as_py() for v in row) for b in batches for row in zip(*[b.column(j) for j in (2, 3, 4)], strict=True))
            for ids, x, most in _gathered(blocks, dims):
                meets = shape.meets(x, most)
                for c in np.flatnonzero(meets.any(0)):
                    met = np.sort(ids[meets[:, c]]).tobytes()
                    yield pd.DataFrame({"cell": np.int32(c), "part": np.arange(parts[c], dtype=np.int32), "ids": [met] * parts[c]})

        return asked.mapInArrow(lambda batches: (pa.RecordBatch.from_pandas(p, preserve_index=False) for p in run(batches)), "cell int, part int, ids binary")

    def _reach(self, of: Runs):
        """x, most -> which queries meet which group of rows."""
        shape, cells = self.shape, len(self.centres)
        holds = np.zeros((of.n, cells), bool)
        for c in range(cells):
            holds[of.group[of.first[c] : of.first[c] + of.parts[c]], c] = True

        def reach(x: np.ndarray, most: np.ndarray) -> np.ndarray:
            meets = shape.meets(x, most)
            return np.column_stack([meets[:, holds[g]].any(1) for g in range(of.n)])

        return reach

    def sent(self, asked: DataFrame, ask: Runs, hold: Runs) -> tuple[DataFrame, int]:
        """(slot, kind, cell, ids, xs, most, tags) and the number of slots: a slot is a group of rows (kind 0) with a
        group of queries that has some that meet it (kind 1)."""
        dims, reach, tag = self.centres.shape[1], self._reach(hold), self.tag

        def pairs(batches):
            for b in batches:
                met = set()
                for cell, part, ids, xs, most in zip(*[b.column(j).to_pylist() for j in range(5)], strict=True):
                    to = reach(_loosened(xs, len(ids) // 8, dims), np.frombuffer(most))
                    met |= {(ask.of(cell, part), int(g)) for g in np.flatnonzero(to.any(0))}
                if met:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in zip(*sorted(met), strict=True)], ["q", "g"])

        found = sorted((r["q"], r["g"]) for r in asked.mapInArrow(pairs, "q int, g int").distinct().collect())  # a row a slot
        slots = np.full((ask.n, hold.n), -1, np.int64)
        for i, (q, g) in enumerate(found):
            slots[q, g] = i
        names = ["slot", "kind", "cell", "ids", "xs", "most", "tags"]
        schema = f"slot int, kind int, cell int, ids binary, xs binary, most binary, tags array<{tag}>"

        def queries(batches):
            for b in batches:
                for cell, part, ids, xs, most in zip(*[b.column(j).to_pylist() for j in range(5)], strict=True):
                    x = _loosened(xs, len(ids) // 8, dims)
                    to = reach(x, np.frombuffer(most))
                    for g in np.flatnonzero(to.any(0)):
                        who = to[:, g]
                        own = (ids, xs, most) if who.all() else (np.frombuffer(ids, np.int64)[who].tobytes(), _pressed(x[who]), np.frombuffer(most)[who].tobytes())
                        yield {"slot": int(slots[ask.of(cell, part), g]), "kind": 1, "cell": cell, "ids": own[0], "xs": own[1], "most": own[2], "tags": None}

        def as_batches(batches):
            kinds = pa.schema([("slot", pa.int32()), ("kind", pa.int32()), ("cell", pa.int32()), ("ids", pa.binary()), ("xs", pa.binary()), ("most", pa.binary())])
            for row in queries(batches):
                yield pa.RecordBatch.from_pylist([row], schema=kinds)

        def rows(batches):
            for b in batches:
                to = [(i, int(s)) for i, (c, p) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) for s in slots[:, hold.of(c, p)] if s >= 0]
                for i, s in to:
                    one = b.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([0], pa.int32()), one.column(0), one.column(2), one.column(3), pa.array([None], pa.binary()), one.column(4)], names)

        sides = asked.mapInArrow(as_batches, schema.rpartition(", ")[0]).withColumn("tags", F.lit(None).cast(f"array<{tag}>"))
        return self.blocks.mapInArrow(rows, schema).unionByName(sides), len(found)

    def met(self, sent: DataFrame, slots: int) -> DataFrame:
        """(row_id, d, o, tag): the k best of each query in each group of rows that it meets, without itself."""
        k, dims, shape = self.k, self.centres.shape[1], self.shape

        def best(batches):
            held, cells, tags, blocks, middle = None, [], [], [], None

            def answered(ids, x, most):
                d, o, place = held.closest(ids, x, most, shape.lower(x)[:, cells], shape.slack, k)
                at = np.nonzero(o != NONE)
                return pa.RecordBatch.from_arrays([pa.array(ids[at[0]]), pa.array(d[at]), pa.array(o[at]), tags.take(pa.array(place[at]))], ["row_id", "d", "o", "tag"])

            def queries():
                nonlocal held, tags
                rows = 0
                for b in batches:
                    kinds, of = b.column(1).to_pylist(), b.column(2).to_pylist()
                    for i, kind in enumerate(kinds):
                        if kind == 0:
                            ids = np.frombuffer(b.column(3)[i].as_py(), np.int64)
                            blocks.append((ids, _loosened(b.column(4)[i].as_py(), len(ids), dims), rows))
                            cells.append(of[i])
                            tags.append(b.column(6)[i].values)
                            rows += len(ids)
                        else:
                            if held is None:
                                held, tags = Held(blocks, np.mean([y.mean(0) for _, y, _ in blocks], axis=0)), pa.concat_arrays(tags)
                            yield tuple(b.column(j)[i].as_py() for j in (3, 4, 5))

            for chunk in _gathered(queries(), dims):
                yield answered(*chunk)

        dealt = sent.repartitionById(max(1, slots), "slot").sortWithinPartitions("kind")
        return dealt.mapInArrow(best, f"row_id long, d double, o long, tag {self.tag}")


def _gathered(blocks, dims: int):
    """Blocks (ids, xs, most) of queries as arrays, small ones together up to BLOCK_ROWS rows."""
    some, n = [], 0
    for ids, xs, most in blocks:
        if n and n + len(ids) // 8 > BLOCK_ROWS:
            yield tuple(np.concatenate(c) for c in zip(*some, strict=True))
            some, n = [], 0
        ids = np.frombuffer(ids, np.int64)
        some.append((ids, _loosened(xs, len(ids), dims), np.frombuffer(most)))
        n += len(ids)
    if some:
        yield tuple(np.concatenate(c) for c in zip(*some, strict=True))


def usable(rows: DataFrame, tag: Column) -> DataFrame:
    """(row_id, x, tag) of the rows with an id and a vector."""
    return rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("x").cast("array<double>").alias("x"), tag.alias("tag")).where("row_id is not null and x is not null")


def nearest(queries: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """(row_id, n): the k nearest others (d: squared distance, o, tag) of each query, nearest first, without
    the row itself; of equal distances, the smaller ids. Queries without others have no row.

    Both are (row_id, x, tag), ids being unique; vectors have one length. Neighbours are exact."""
    found, visits, cells = search(queries, others, k)
    if cells is not None:
        removed(visits, cells.blocks)
    return found


def search(queries: DataFrame, others: DataFrame, k: int) -> tuple[DataFrame, DataFrame, Cells]:
    """nearest(), the visits to blocks of rows, and the cells."""
    centres = pivots(others)
    if not len(centres):
        kind = others.schema["tag"].dataType.simpleString()
        none = f"array<struct<d:double,o:bigint,tag:{kind}>>"
        return queries.where("false").select("row_id", F.lit(None).cast(none).alias("n")), queries.where("false"), None
    cells = Cells(others, centres, k)
    asked, ask, hold = cells.asked(queries, 3 * queries.sparkSession.sparkContext.defaultParallelism)
    best = F.slice(F.array_sort(F.collect_list(F.struct("d", "o", "tag"))), 1, k).alias("n")  # k a group that the query meets
    found = written(cells.met(*cells.sent(asked, ask, hold)).groupBy("row_id").agg(best), "neighbours")
    return found, cells.visits(asked), cells
