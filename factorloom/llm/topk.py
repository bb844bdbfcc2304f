"""Exact top-k inner products with KD-trees per shard.

Rows are dealt to shards by a KD-tree over a bounded sample: it splits at the median of the widest dimension,
and its leaves are the shards. Each shard has the tight box of all its rows and a tree of its own, split the
same way. A query visits nodes best-first by the greatest inner product any point of the box could have and
stops when that is below its kth score. Each query first searches one shard, its home, whose box promises
most; the kth score found there goes with it to the other shards whose boxes can reach it, and to no
others, and prunes there from the start. Boxes that are too many for one task stand in groups with a box of their own; a query
first finds the groups that it can reach, then their boxes. Queries meet shards in blocks, so no task holds all queries;
a shard is copied once for each block of queries that ask it, and not at all if none does.
The sample only decides which rows lie together: every row is searched or ruled out by a box that holds it.

Rows: a vector that is null, empty or has a null or non-finite component takes no part; vectors of
different lengths are not compared; ids name queries: of query rows with one id the smallest vector is
asked, and rows with the query's id are no candidates; repeated candidate rows each count; equal
scores rank by the smaller id; rows with a null id take no part; an empty table gives no rows. Only
vec_id and embedding are read. Components must be small enough for scores to fit a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.llm import common

K = 5
#: Every so many ids is a query, by the query's contract.
QUERY_EVERY = 50
SCALE = 256
#: Most rows of a shard and most queries of a block.
SHARD_ROWS = 100_000
BLOCK_QUERIES = 50_000
LEAF_ROWS = 128
#: Rows and bytes of the sample that the tree over the shards is fitted to, at most about; bytes of boxes that are sent to tasks.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64_000_000
BOX_BYTES = 64_000_000

RESULT = "query_id long, vec_id long, score long"


class Tree:
    """KD-tree over integer rows in level order of creation."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        self.ids, self.rows = ids, rows
        self.spans: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int]] = []
        low, high = [], []
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = order[a:b]
            box = rows[own]
            lo, hi = box.min(axis=0), box.max(axis=0)
            node = len(self.spans)
            self.spans.append((a, b))
            self.kids.append((-1, -1))
            low.append(lo)
            high.append(hi)
            if parent >= 0:
                k = list(self.kids[parent])
                k[side] = node
                self.kids[parent] = (k[0], k[1])
            if b - a > leaf and (hi > lo).any():
                d = int((hi - lo).argmax())
                mid = (b - a) // 2
                order[a:b] = own[np.argpartition(box[:, d], mid)]
                todo += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.rows, self.ids = rows[order], ids[order]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest inner product a point of each node's box can have with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, name: int, query: np.ndarray, bound: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, -id) with scores of `floor` or more, best-first over the nodes."""
        best: list[tuple[float, int]] = []  # smallest on top
        queue = [(-bound[0], 0)]
        while queue:
            most, node = heapq.heappop(queue)
            if -most < floor:
                break
            kids = self.kids[node]
            if kids[0] >= 0:
                for c in kids:
                    if bound[c] >= floor:
                        heapq.heappush(queue, (-bound[c], c))
                continue
            a, b = self.spans[node]
            score = self.rows[a:b] @ query
            for i in np.flatnonzero((score >= floor) & (self.ids[a:b] != name)):
                item = (score[i], -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Usable rows with their components as floor(scale * x): vec_id, v."""
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.where(usable).select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """Floating point if all sums of products stay exact in it, else integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float64 if most < 2**52 else np.int64


class Splits:
    """A KD-tree over a sample whose leaves are numbered; for vectors of one length."""

    def __init__(self, rows: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # dimension, threshold, left, right; a leaf has its number as ~left
        self.leaves = 0
        self._grow(rows, leaves)

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append((0, 0.0, ~self.leaves, 0))
        if leaves > 1 and len(rows) > 1 and (spread := rows.max(axis=0) - rows.min(axis=0)).max() > 0:
            d = int(spread.argmax())
            cut = float(np.median(rows[:, d]))
            low = rows[:, d] <= cut
            if low.all():
                low = rows[:, d] < cut
                cut = float(rows[low, d].max())
            left = self._grow(rows[low], leaves - leaves // 2)
            right = self._grow(rows[~low], leaves // 2)
            self.nodes[at] = (d, cut, left, right)
        else:
            self.leaves += 1
        return at

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        d, cut, left, right = (np.array(x) for x in zip(*self.nodes, strict=True))
        at = np.zeros(len(rows), np.int64)
        while (going := left[at] >= 0).any():
            own = at[going]
            at[going] = np.where(rows[going, d[own]] <= cut[own], left[own], right[own])
        return ~left[at]


def fitted(vectors: DataFrame, n: int, widest: int, shards: int) -> dict[int, Splits]:
    """Trees over a sample of about SAMPLE_ROWS rows (fewer, if vectors are so wide that they pass SAMPLE_BYTES), by length of the vectors."""
    share = common.sample_share(n, min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * max(1, widest)))))
    got = vectors.where(common.hashed_share(F.col("vec_id"), share, 3)).select("vec_id", "v", F.size("v").alias("dims")).toArrow()
    out = {}
    for k in pc.unique(got["dims"]).to_pylist():
        own = got.filter(pc.equal(got["dims"], k)).sort_by("vec_id")
        out[k] = Splits(_matrix(own["v"]).astype(float), max(1, round(shards * len(own) / len(got))))
    return out


def dealt_out(vectors: DataFrame, trees: dict[int, Splits]) -> DataFrame:
    """Rows with their length, shard and a running number, by which a shard of too many rows is cut.

    Vectors of a length that is not in the sample lie in shard 0 of theirs.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            shard = np.zeros(len(dims), np.int32)
            for k in np.unique(dims).tolist():
                if k in trees:
                    own = np.flatnonzero(dims == k)
                    shard[own] = trees[k].leaf_of(_matrix(pa.chunked_array([batch.column("v").take(pa.array(own))])).astype(float))
            number = pa.array(np.arange(start, start + len(dims), dtype=np.int64))
            start += len(dims)
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), batch.column("dims"), pa.array(shard), number], ["vec_id", "v", "dims", "shard", "number"])

    common.bounded(vectors.sparkSession)
    return vectors.select("vec_id", "v", F.size("v").alias("dims")).mapInArrow(deal, "vec_id long, v array<long>, dims int, shard int, number long")


def boxes_of(dealt: DataFrame) -> DataFrame:
    """The tight box of each shard: dims, shard, low, high. Each task first makes its own boxes."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[tuple[int, int], np.ndarray] = {}
        high: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            key = batch.column("dims").to_numpy().astype(np.int64) << 32 | batch.column("shard").to_numpy()
            for k in np.unique(key).tolist():
                own = _matrix(pa.chunked_array([batch.column("v").take(pa.array(np.flatnonzero(key == k)))]))
                lo, hi, at = own.min(axis=0), own.max(axis=0), (k >> 32, k & 0xFFFFFFFF)
                low[at], high[at] = np.minimum(low.get(at, lo), lo), np.maximum(high.get(at, hi), hi)
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(([d for d, _ in low], [s for _, s in low], list(low.values()), list(high.values())), kinds, strict=True)], ["dims", "shard", "low", "high"])

    return merged(dealt.select("v", "dims", "shard").mapInArrow(measure, "dims int, shard int, low array<long>, high array<long>"))


def merged(parts: DataFrame) -> DataFrame:
    """One box a shard from parts of it: dims, shard, low, high."""
    each = parts.select("dims", "shard", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x")).groupBy("dims", "shard", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]).alias(c)  # noqa: E731  one entry a dimension
    return each.groupBy("dims", "shard").agg(side("low"), side("high"))


PLACED = "query_id long, q array<long>, dims int, floor long, shard int, own boolean"
_ASKED = ["query_id", "q", "dims", "floor"]
#: Names, low and high corners of boxes.
Boxes = tuple[np.ndarray, np.ndarray, np.ndarray]


def reached(q: np.ndarray, floors: list[int | None], boxes: Boxes, home: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, the boxes they ask (by place), and whether that is the row's box of greatest bound.

    A row of `home` asks that box only; another asks every box whose bound reaches its floor, but not its box of greatest bound
    where `own` is true, as it has been asked.
    """
    _, low, high = boxes
    most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    best, all_ = most.argmax(axis=1), np.arange(len(q))
    least = np.array([-np.inf if f is None else f for f in floors])
    asks = most + 1 + 1e-12 * np.abs(most) >= least[:, None]  # rounding may not lose a shard
    asks[home] = False
    asks[all_[home], best[home]] = True
    if own is not None:
        asks[all_[own & ~home], best[own & ~home]] = False
    row, at = np.nonzero(asks)
    return row, at, best[row] == at


def _asks(table: pa.Table | pa.RecordBatch, boxes: Boxes, home: bool, skip: bool | None) -> pa.Table:
    """Queries of one length with the boxes they ask. With `skip` None the column own says whose best box was asked."""
    parts = []
    for a in range(0, table.num_rows, 256):
        part = table.slice(a, 256)
        column = part.column("q")
        q = _matrix(column if isinstance(column, pa.ChunkedArray) else pa.chunked_array([column])).astype(float)
        own = part.column("own").to_numpy(zero_copy_only=False).astype(bool) if skip is None else np.full(len(q), skip)
        row, at, best = reached(q, part.column("floor").to_pylist(), boxes, np.full(len(q), home), own)
        held = part.select(_ASKED).take(pa.array(row))
        parts.append(pa.table([*held.columns, pa.array(boxes[0][at], pa.int32()), pa.array(best)], [*_ASKED, "shard", "own"]))
    return pa.concat_tables(parts)


def placed(asking: DataFrame, boxes: dict[int, Boxes], home: bool, skip: bool = True) -> DataFrame:
    """Queries (query_id, q, dims, floor) with the box of greatest bound (home), or with every box whose bound reaches the floor.

    With `skip` the latter leaves out the box of greatest bound. Columns shard and own (the box of greatest bound).
    """

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for k in np.unique(dims).tolist():
                if k in boxes:
                    yield from _asks(batch.take(pa.array(np.flatnonzero(dims == k))), boxes[k], home, skip).to_batches()

    return asking.select(*_ASKED).mapInArrow(bound, PLACED)


class Placing:
    """The shards' boxes: sent to tasks if they take at most `box_bytes`, else in two levels of which the upper is sent."""

    def __init__(self, box: DataFrame, folder: str, box_bytes: int, block_queries: int, asked: int):
        n, size = box.agg(F.count("*"), F.sum(16 * F.col("dims").cast("long") + 40)).first()
        self.box, self.per = box, 1
        if (size or 0) > box_bytes:
            self.per = -(-n // max(1, box_bytes * n // size))  # shards are numbered in the order of their tree, so neighbours lie together
            box = common.written(merged(box.withColumn("shard", F.floor(F.col("shard") / self.per).cast("int"))), f"{folder}/groups")
        self.upper = {d: (np.array([r.shard for r in rows]), np.array([r.low for r in rows], float), np.array([r.high for r in rows], float)) for d, rows in _by_dims(box.orderBy("dims", "shard").collect()).items()}
        #: parts that the queries of a group are dealt over
        self.parts = max(box.sparkSession.sparkContext.defaultParallelism, -(-asked // block_queries))

    def shards(self, asking: DataFrame, home: bool) -> DataFrame:
        """Queries with their shards, as in `placed`."""
        if self.per == 1:
            return placed(asking, self.upper, home)
        groups = placed(asking, self.upper, home, skip=False).withColumnRenamed("shard", "grp")
        groups = groups.withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(4)), F.lit(self.parts)))
        lower = self.box.withColumn("grp", F.floor(F.col("shard") / self.per).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.parts - 1).cast("long"))))

        def within(asks: pa.Table, boxes: pa.Table) -> pa.Table:
            if not asks.num_rows or not boxes.num_rows:
                return pa.table({c: pa.array([], t) for c, t in zip([*_ASKED, "shard", "own"], [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int32(), pa.bool_()], strict=True)})
            boxes = boxes.sort_by("shard")  # home is the first of equal bounds, in both turns
            return _asks(asks, (boxes["shard"].to_numpy(), _matrix(boxes["low"]).astype(float), _matrix(boxes["high"]).astype(float)), home, None)

        key = ["dims", "grp", "part"]
        return groups.groupBy(*key).cogroup(lower.groupBy(*key)).applyInArrow(within, PLACED)


def top_k(vectors: DataFrame, queries: DataFrame, folder: str, k: int = K, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, box_bytes: int = BOX_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows. Both tables have vec_id and v.

    The shards' boxes go to the tasks if they take at most `box_bytes`; else groups of them do, and queries meet boxes by group.
    """
    spark = vectors.sparkSession
    n, widest = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = max(1, -(-n // shard_rows), min(spark.sparkContext.defaultParallelism, n // 1000))
    asked = common.written(queries.groupBy("vec_id").agg(F.min("v").alias("v")), f"{folder}/queries")
    dealt = common.written(dealt_out(vectors, fitted(vectors, n, widest or 0, shards)), f"{folder}/shards")
    # equal rows can't be split by a tree: a shard of more than twice the rows is searched in slices
    slices = common.written(dealt.groupBy("dims", "shard").agg(F.ceil(F.count("*") / (2 * shard_rows)).cast("int").alias("slices")), f"{folder}/slices")
    places = Placing(common.written(boxes_of(dealt), f"{folder}/boxes"), folder, box_bytes, block_queries, asked.count())
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dims"))

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if rows.num_rows and wanted.num_rows:
            ids, points, q = rows["vec_id"].to_numpy(), _matrix(rows["v"]), _matrix(wanted["q"])
            kind = _exact(points, q)
            tree, q = Tree(ids, points.astype(kind)), q.astype(kind)
            names, floors = wanted["query_id"].to_pylist(), wanted["floor"].to_pylist()
            for a in range(0, len(names), 256):
                for name, query, bound, floor in zip(names[a : a + 256], q[a : a + 256], tree.bounds(q[a : a + 256]), floors[a : a + 256], strict=True):
                    out += [(name, -i, int(s)) for s, i in tree.search(name, query, bound, k, -np.inf if floor is None else floor)]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    def search(asking: DataFrame, home: bool) -> DataFrame:
        """Each shard in as many copies as it has blocks of queries; what a query asks is found twice, which costs less than to write it."""
        asking = places.shards(asking, home)
        blocks = asking.groupBy("dims", "shard").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks")).join(slices, ["dims", "shard"])
        blocks = common.written(blocks, f"{folder}/{'home' if home else 'rest'}_blocks")  # a row a shard
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        cells = dealt.join(blocks, ["dims", "shard"]).withColumns({"slice": F.pmod("number", "slices").cast("int"), "block": each("blocks")})
        wanted = asking.join(blocks, ["dims", "shard"]).withColumns({"block": F.pmod(F.xxhash64("query_id", F.lit(2)), F.col("blocks")).cast("int"), "slice": each("slices")})
        key = ["shard", "block", "slice", "dims"]
        return cells.select("vec_id", "v", *key).groupBy(*key).cogroup(wanted.select("query_id", "q", "floor", *key).groupBy(*key)).applyInArrow(run, RESULT)

    first = common.written(search(asked.withColumn("floor", F.lit(None).cast("long")), home=True), f"{folder}/home")
    # each slice gives at most k rows a query; a window with a rank limit keeps k of them before the shuffle
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # the kth score at home, if there are k: what other shards must reach
    near = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    floors = near.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
    found = near.drop("rank").unionByName(search(asked.join(floors, "query_id", "left"), home=False))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _by_dims(rows: list) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.dims, []).append(r)
    return out
