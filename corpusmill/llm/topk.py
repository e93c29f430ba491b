"""Exact top-k by inner product over KD-trees.

1. Median splits of a bounded sample divide space into at most ``CELLS`` cells; every vector is located in one, and a
   cell's vectors are dealt by hash into shards of about ``SHARD`` rows, so that no shard grows with a cell (or with
   copies of one vector).
2. Each shard's KD-tree (median splits on the widest dimension, tight bounding boxes) is built once, in a task that also
   searches it for the shard's own queries: the k-th score found there is what other shards have to beat.
3. Queries of a cell form blocks.  A block visits the cells whose tight box can reach the k-th score of any of its
   queries, and takes along only those queries.  A task searches one tree for one such block, best first, by the bound
   that a box puts on the inner product; only what beats the k-th score so far comes back.

A vector is copied once for each block that must visit its cell.  Where boxes tell cells apart these are few; vectors
in all directions alike leave no box out of reach, and exact search then compares all blocks with all shards.  A tree is
copied once for each wave of some eight blocks that visit it.

Vectors that are null, or hold a null, NaN or infinite component, take no part, as query or as candidate.  A
repeated vec_id is a candidate once for each row; rows with the query's own vec_id are not its candidates; a query id
that repeats asks with each of its vectors, and its answers are the best of all.  A null vec_id takes no part.  Vectors
of another length than the query's are not its candidates.  Ties go to the smaller vec_id.  Scores are exact while they
and their parts stay below 2**53 in size.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import lean
from .shared import staged

SHARD, BLOCK, LEAF, CELLS, WAVE, SAMPLE_BYTES = 4096, 8192, 64, 256, 8, 16 << 20


class Tree:
    """A KD-tree as arrays: boxes of all nodes, children of inner nodes, a slice of rows for each leaf."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.low, self.high, self.kids, self.span, self.least = [], [], [], [], []
        order = np.arange(len(ids))
        self._build(ids, rows, order, 0, len(ids))
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, ids: np.ndarray, rows: np.ndarray, order: np.ndarray, a: int, b: int) -> int:
        node, part = len(self.low), rows[order[a:b]]
        low, high = part.min(axis=0), part.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(None)
        self.span.append((a, b))
        self.least.append(int(ids[order[a:b]].min()))
        if b - a > LEAF and (high > low).any():
            axis, m = int(np.argmax(high - low)), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], m)]
            self.kids[node] = (self._build(ids, rows, order, a, a + m), self._build(ids, rows, order, a + m, b))
        return node

    PARTS = ("low", "high", "kids", "span", "least", "ids", "rows")

    def pack(self) -> list[bytes]:
        kids = np.array([k or (-1, -1) for k in self.kids], dtype=np.int64)
        return [np.ascontiguousarray(x).tobytes() for x in (self.low, self.high, kids, np.array(self.span, dtype=np.int64), np.array(self.least, dtype=np.int64), self.ids, self.rows)]

    @classmethod
    def unpack(cls, parts: list[bytes], width: int) -> Tree:
        tree = cls.__new__(cls)
        tree.low, tree.high, tree.rows = (np.frombuffer(parts[i]).reshape(-1, width) for i in (0, 1, 6))
        pairs = [np.frombuffer(parts[i], dtype=np.int64).reshape(-1, 2).tolist() for i in (2, 3)]
        tree.kids, tree.span = [None if k[0] < 0 else tuple(k) for k in pairs[0]], pairs[1]
        tree.least, tree.ids = np.frombuffer(parts[4], dtype=np.int64).tolist(), np.frombuffer(parts[5], dtype=np.int64)
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that each query's inner product can reach in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def _worst(best: list[tuple[float, int]], k: int) -> tuple[float, int]:
    return best[0] if len(best) == k else (-np.inf, 0)


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, best: list[list[tuple[float, int]]], k: int) -> None:
    """Best-first search; ``best`` holds each query's k best so far as a heap of (score, -vec_id)."""
    bounds = tree.bounds(queries)
    for q in range(len(query_ids)):
        bound, mine, own, vector = bounds[q], best[q], int(query_ids[q]), queries[q]
        queue = [(-bound[0], 0)]
        while queue:
            reach, node = heapq.heappop(queue)
            if (-reach, -tree.least[node]) <= _worst(mine, k) and len(mine) == k:
                if -reach < mine[0][0]:
                    break  # all that is left reaches less
                continue
            kids = tree.kids[node]
            if kids is not None:
                for kid in kids:
                    heapq.heappush(queue, (-bound[kid], kid))
                continue
            a, b = tree.span[node]
            scores, ids = tree.rows[a:b] @ vector, tree.ids[a:b]
            if len(mine) == k:
                good = np.flatnonzero(scores >= mine[0][0])
            else:
                good = np.arange(b - a)
            if len(good) > k:  # by score, then smaller id
                good = good[np.lexsort((ids[good], -scores[good]))]
            kept = 0
            for i in good.tolist():
                if ids[i] == own:
                    continue
                item = (float(scores[i]), -int(ids[i]))
                if len(mine) < k:
                    heapq.heappush(mine, item)
                elif item > mine[0]:
                    heapq.heapreplace(mine, item)
                kept += 1
                if kept >= k:
                    break


def scaled(vectors: DataFrame, vector: str, scale: float, is_query: str) -> DataFrame:
    """id, v (floor(scale * x) of each component as a double) and asks, of the vectors that take part."""
    whole = F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"), F.expr(is_query).alias("asks"))


class Cells:
    """Median splits of a sample: which cell a vector falls into."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis (-1: a leaf), value, left or cell, right
        self.count = 0
        self._split(sample, cells)

    def _split(self, part: np.ndarray, cells: int) -> int:
        node = len(self.nodes)
        self.nodes.append((-1, 0.0, self.count, 0))
        wide = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
        if cells > 1 and wide.size and wide.max() > 0:
            axis = int(np.argmax(wide))
            value = float(np.median(part[:, axis]))
            below = part[:, axis] < value
            if not below.any():
                value = float(np.min(part[part[:, axis] > value, axis]))
                below = part[:, axis] < value
            left = self._split(part[below], cells // 2)
            self.nodes[node] = (axis, value, left, self._split(part[~below], cells - cells // 2))
        else:
            self.count += 1
        return node

    def locate(self, v: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(v), np.int32), [(0, np.arange(len(v)))]
        while todo:
            node, who = todo.pop()
            axis, value, left, right = self.nodes[node]
            if axis < 0:
                out[who] = left
            elif len(who):
                below = v[who, axis] < value
                todo += [(left, who[below]), (right, who[~below])]
        return out


def _rows_by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and vectors of each length."""
    flat, sizes = batch.column("v").flatten().to_numpy(zero_copy_only=False), batch.column("size").to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        who = np.flatnonzero(sizes == size)
        yield who, flat[starts[who][:, None] + np.arange(size)]


SHARED = "size int, cell int, shard int"
TREE = ", ".join(f"{x} binary" for x in Tree.PARTS)
ASK = "id long, floor double, v binary, best_ids binary, best_scores binary"


def _built(k: int):
    """A shard's tree, and its own queries with what the tree has for them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        size, cell, shard = (x.as_py() for x in key)
        ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), size)
        tree, best = Tree(ids, v), [[] for _ in range(int(asks.sum()))]
        search(tree, ids[asks], v[asks], best, k)
        rows = [(size, cell, shard, *tree.pack(), None, None, None, None, None)]
        for i, vector, heap in zip(ids[asks].tolist(), v[asks], best):
            floor = heap[0][0] if len(heap) == k else -np.inf
            found = np.array([(-m, s) for s, m in heap]).reshape(-1, 2)
            rows.append((size, cell, shard, *[None] * len(Tree.PARTS), i, floor, vector.tobytes(), found[:, 0].astype(np.int64).tobytes(), found[:, 1].tobytes()))
        types = [pa.int32()] * 3 + [pa.binary()] * len(Tree.PARTS) + [pa.int64(), pa.float64()] + [pa.binary()] * 3
        names = ["size", "cell", "shard", *Tree.PARTS, "id", "floor", "v", "best_ids", "best_scores"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


VISIT = "size int, cell int, block long, asked binary, homes binary, floors binary, vectors binary"


def _visits(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """For each cell that some query of the block must visit, those queries in one row."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        size, home, block = (x.as_py() for x in key)
        ids, shards, floors = (table.column(c).to_numpy() for c in ("id", "shard", "floor"))
        v = np.frombuffer(b"".join(table.column("v").to_pylist())).reshape(len(ids), size)
        cells, low, high = boxes[size]
        reach = np.maximum(v, 0) @ high.T + np.minimum(v, 0) @ low.T
        rows = []
        for j, cell in enumerate(cells.tolist()):
            who = np.flatnonzero(reach[:, j] >= floors)
            if len(who):
                homes = np.where(cell == home, shards[who], -1).astype(np.int64)  # what has been searched already
                rows.append((size, cell, (home << 32) + block, ids[who].tobytes(), homes.tobytes(), floors[who].tobytes(), v[who].tobytes()))
        types = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=[x.split()[0] for x in VISIT.split(", ")])

    return run


def _searched(k: int):
    """One tree, searched for all blocks of a wave that visit it."""

    def run(key: tuple, visits: pa.Table, trees: pa.Table) -> pa.Table:
        size, shard, out = key[0].as_py(), key[2].as_py(), []
        rows = visits.to_pylist() if len(trees) else []
        tree = Tree.unpack([trees.column(x)[0].as_py() for x in Tree.PARTS], size) if rows else None
        for row in rows:
            ids, homes = (np.frombuffer(row[x], dtype=np.int64) for x in ("asked", "homes"))
            floors, v = np.frombuffer(row["floors"]), np.frombuffer(row["vectors"]).reshape(len(ids), size)
            go = np.flatnonzero(homes != shard)
            # k places at the score to beat, after any id: a tie with it still comes in.
            best = [[(float(floors[i]), -(2**63))] * k if floors[i] > -np.inf else [] for i in go.tolist()]
            search(tree, ids[go], v[go], best, k)
            out += [(int(i), -m, int(s)) for i, heap in zip(ids[go], best) for s, m in heap if m > -(2**63)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), zip(*out) if out else ([], [], []))})

    return run


def top_k(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, scale: float = 256.0, vector: str = "embedding", shard: int = SHARD, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to the smaller vec_id."""
    base = scaled(vectors, vector, scale, is_query).withColumn("size", F.size("v"))
    base = staged(base.where("size > 0"), "topk-vectors")
    shape = base.agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
    limit = max(64, SAMPLE_BYTES // (8 * (shape.size or 1)))
    sample = base.select("size", "v").orderBy(F.xxhash64("id", "v")).limit(limit).collect()  # bounded in bytes; it only places the cells
    trees: dict[int, Cells] = {}
    for size in {r.size for r in sample}:
        mine = np.array([r.v for r in sample if r.size == size]).reshape(-1, size)
        trees[size] = Cells(mine, min(cells, shape.n // shard + 1, len(mine)))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(len(batch), np.int32)
            for who, v in _rows_by_size(batch):
                if v.shape[1] in trees:
                    cell[who] = trees[v.shape[1]].locate(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    located = staged(base.select("size", "id", "v", "asks").mapInArrow(lean(locate), "size int, id long, v array<double>, asks boolean, cell int"), "topk-located")
    counts = located.groupBy("size", "cell").agg(F.ceil(F.count("*") / shard).alias("shards"), F.ceil(F.greatest(F.count_if("asks"), F.lit(1)) / block).alias("blocks"))
    counts = F.broadcast(staged(counts, "topk-counts"))  # at most ``cells`` rows a length of vectors
    dealt = located.join(counts, ["size", "cell"]).withColumn("shard", F.pmod(F.xxhash64("id", F.lit("s"), "v"), "shards").cast("int"))
    built = staged(dealt.groupBy("size", "cell", "shard").applyInArrow(_built(k), f"{SHARED}, {TREE}, {ASK}"), "topk-trees")
    shards, asks = built.where("id IS NULL"), built.where("id IS NOT NULL")

    def box(key: tuple, table: pa.Table) -> pa.Table:
        low, high = (np.array([np.frombuffer(x)[: key[0].as_py()] for x in table.column(c).to_pylist()]) for c in ("low", "high"))
        return pa.table({"size": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([key[1].as_py()], pa.int32()), "low": pa.array([low.min(axis=0).tobytes()], pa.binary()), "high": pa.array([high.max(axis=0).tobytes()], pa.binary())})

    # At most ``cells`` boxes a length of vectors; a shard's first node is its box.
    width = F.col("size") * 8
    tops = shards.select("size", "cell", *[F.substring(c, F.lit(1), width).alias(c) for c in ("low", "high")])
    boxes = {}
    found = tops.groupBy("size", "cell").applyInArrow(box, "size int, cell int, low binary, high binary").collect()
    for size in {r.size for r in found}:
        mine = [r for r in found if r.size == size]
        boxes[size] = (np.array([r.cell for r in mine]), *(np.array([np.frombuffer(r[c]) for r in mine]) for c in ("low", "high")))

    asked = asks.select("size", "cell", "shard", "id", "floor", "v").join(counts, ["size", "cell"])
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit("q"), "v"), "blocks"))
    visits = asked.groupBy("size", "cell", "block").applyInArrow(_visits(boxes), VISIT)
    # One row for each shard of the cell, so that a cell of many shards is joined by many tasks.
    each = visits.join(counts.select("size", "cell", "shards"), ["size", "cell"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1))).drop("shards")
    # A tree is copied once for a wave of some WAVE blocks, not for each block.
    total = counts.agg(F.sum("blocks").alias("n")).first().n or 0
    each = each.withColumn("wave", F.pmod(F.xxhash64("block"), F.lit(-(-total // WAVE) or 1)))
    keys = ["size", "cell", "shard", "wave"]
    trees = shards.select("size", "cell", "shard", *Tree.PARTS).join(each.select(*[F.col(c).alias(c) for c in keys]).distinct(), ["size", "cell", "shard"])
    more = each.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(_searched(k), "query_id long, vec_id long, score long")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = (batch.column(c).to_pylist() for c in ("best_ids", "best_scores"))
            who = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), [len(x) // 8 for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.frombuffer(b"".join(ids), dtype=np.int64)), pa.array(np.frombuffer(b"".join(scores)).astype(np.int64))], ["query_id", "vec_id", "score"])

    first = asks.select("id", "best_ids", "best_scores").mapInArrow(lean(own), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
