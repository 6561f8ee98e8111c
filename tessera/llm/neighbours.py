"""Approximate nearest neighbours by a forest of random-projection trees.

A tree splits the space by hyperplanes between two points drawn at random, at the median of a
bounded sample. The trees are fitted on the driver, and every row is put into its leaf of every
tree. A query walks all trees through one priority queue, which holds the branches not taken,
nearest hyperplanes first, until it has visited VISITS leaves; how many that are is calibrated on
the sample, for RECALL. The rows in these leaves are its candidates, and are ranked by their exact
inner products. Leaves and queries meet in blocks of bounded size.

Equal vectors are searched once: of each the smallest ids are kept, as many as a result can show.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tessera.llm.tables import quoted, table
from tessera.session import checkpoint

NEIGHBOURS, EVERY = 20, 20
#: Trees; rows that a leaf is to hold; fewest leaves of a tree, and most, as the sample must still split them; fuller leaves are dealt in blocks.
TREES, LEAF_ROWS, FEWEST_LEAVES, MOST_LEAVES = 4, 512, 32, 128
#: Vectors in the sample, queries that calibrate the search on it, and the recall they must reach there.
SAMPLE, TRIALS, RECALL, SEED = 8192, 256, 0.94, 42
#: Rows and queries of a leaf that meet in one task at most, on average.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4096


@dataclass
class Forest:
    """Hyperplanes of all trees, the branches below each (a leaf is -1 less its number), roots, leaves, visits, and the sample."""

    normals: np.ndarray
    offsets: np.ndarray
    below: list[tuple[int, int]]
    roots: list[int]
    leaves: int
    visits: int
    sample: np.ndarray
    sample_homes: np.ndarray | None = None

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Signed distances of vectors from all hyperplanes."""
        return x @ self.normals.T - self.offsets

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Each vector's leaf in every tree."""
        side = self.margins(x) >= 0
        out = np.empty((len(x), len(self.roots)), np.int64)
        below = np.array(self.below, np.int64).reshape(-1, 2)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                node[inner] = below[node[inner], side[inner, node[inner]].astype(np.int64)]
            out[:, t] = -1 - node
        return out

    def visited(self, margins: np.ndarray, visits: int) -> list[int]:
        """The first leaves that a query's search comes to, by its margins."""
        queue = [(0.0, k, root) for k, root in enumerate(self.roots)]
        out: list[int] = []
        order = len(queue)
        while queue and len(out) < visits:
            so_far, _, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node]
                low, high = self.below[node]
                near, far = (high, low) if m >= 0 else (low, high)
                order += 1
                heapq.heappush(queue, (so_far + m * m, order, far))
                node = near
            out.append(-1 - node)
        return out

    def floors(self, x: np.ndarray, visits: list[list[int]], k: int) -> np.ndarray:
        """Scores that each vector's k-th best candidate is known to reach, from sampled rows in the leaves that it visits."""
        homes, scores = self.sample_homes, x @ self.sample.T
        out = np.full(len(x), -np.inf)
        for q, leaves in enumerate(visits):
            seen = np.zeros(self.leaves, bool)
            seen[leaves] = True
            own = scores[q, seen[homes].any(axis=1)]
            if len(own) >= k:
                out[q] = np.partition(own, len(own) - k)[len(own) - k]
        return out


def plant(sample: np.ndarray, leaves: int, trees: int = TREES, k: int = NEIGHBOURS, recall: float = RECALL, seed: int = SEED) -> Forest:
    """Fit a forest on different vectors and calibrate how many leaves a search visits."""
    rng = np.random.default_rng(seed)
    normals: list[np.ndarray] = []
    offsets: list[float] = []
    below: list[tuple[int, int]] = []
    count = 0

    def split(rows: np.ndarray, depth: int) -> int:
        nonlocal count
        if depth and len(rows) > 1:
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = (a - b) / np.linalg.norm(a - b)
            values = sample[rows] @ normal
            offset = float(np.median(values))
            high = values >= offset
            if 0 < high.sum() < len(rows):
                node = len(below)
                normals.append(normal)
                offsets.append(offset)
                below.append((0, 0))
                below[node] = (split(rows[~high], depth - 1), split(rows[high], depth - 1))
                return node
        count += 1
        return -count

    depth = int(math.log2(leaves))
    roots = [split(np.arange(len(sample)), depth) for _ in range(trees)]
    width = sample.shape[1]
    forest = Forest(np.array(normals).reshape(-1, width), np.array(offsets), below, roots, count, count, sample)
    forest.sample_homes = forest.leaves_of(sample)
    if len(sample) > k:
        trial = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)
        scores = sample[trial] @ sample.T
        scores[np.arange(len(trial)), trial] = -np.inf
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        homes, margins = forest.sample_homes, forest.margins(sample[trial])
        found = []
        for row, near in zip(margins, best):
            turn = np.empty(count, np.int64)
            order = forest.visited(row, count)
            turn[order] = np.arange(1, len(order) + 1)
            found.append(turn[homes[near]].min(axis=1))
        needed = np.sort(np.concatenate(found))
        forest.visits = int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])
    return forest


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``a`` and ``b``, by the same order of additions whatever else is in the arrays."""
    return (a * b).sum(axis=1)


def ranked(queries: np.ndarray, floors: np.ndarray, rows: np.ndarray, ids: list[list[int]], k: int, skipped: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, scores, ids) of the k best ids among rows that reach the query's floor; of equal scores the smaller ids; rows that are ``skipped`` come from elsewhere."""
    counts = np.array([len(x) for x in ids])
    flat, starts = np.array([i for x in ids for i in x], np.int64), np.cumsum(counts) - counts
    for at in range(0, len(queries), 256):
        scores = queries[at : at + 256] @ rows.T
        if len(rows) > k:
            bound = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
            bound = np.maximum(bound, floors[at : at + 256])
        else:
            bound = floors[at : at + 256]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0)))
        for q, (row, least) in enumerate(zip(scores, bound - slack)):
            near = np.flatnonzero(row >= least)
            near = near[~skipped(at + q, near)]
            if not len(near):
                continue
            value = exact(queries[at + q], rows[near])
            many = counts[near]
            own = flat[np.repeat(starts[near] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            score = np.repeat(value, many)
            order = np.lexsort((own, -score))[:k]
            yield at + q, score[order], own[order]


def nearest(df: DataFrame, is_query: Column, k: int = NEIGHBOURS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found nearest to each query row by inner product, the query's own id left out.

    Ranks start at 1; ties go to the smaller id; with k other rows or fewer, all are found. Rows
    whose id is null, or whose vector is null, zero, or holds null, NaN or infinite components,
    take no part; nor do those of another length than most vectors have (the longer one, if two
    are as frequent). Rows repeated with id and vector count once. An empty table gives no rows.
    """
    element = df.schema[vector].dataType.elementType
    kind = element if isinstance(element, FloatType) else DoubleType()
    value = F.transform(quoted(vector), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    sound = F.forall(quoted(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(quoted(vector), lambda x: x.cast("double") != 0)
    rows = df.where(quoted(vec_id).isNotNull() & F.coalesce(sound, F.lit(False))).select(quoted(vec_id).cast("long").alias("id"), value.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    result = "query_id long, rank int, vec_id long, score double"
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return df.sparkSession.createDataFrame([], result)
    width = widths.width
    # k ids and one more, which may be the query's own
    hashes = [F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), F.col("v")).alias("b")]
    keyed = rows.where(F.size("v") == width).select("id", "v", "q", *hashes)
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))
    asked = keyed.where("q").select("a", "b").distinct().withColumn("asked", F.lit(True))
    # repeated rows would take the places of other ids
    few = keyed.groupBy("a", "b", "id").agg(F.first("v").alias("v")).withColumn("place", place).where(F.col("place") <= k + 1)
    vectors = few.groupBy("a", "b").agg(F.first("v").alias("v"), F.array_distinct(F.sort_array(F.collect_list("id"))).alias("ids"))
    different = checkpoint(vectors.join(asked, ["a", "b"], "left"))
    n, n_asked = different.agg(F.count("*"), F.count("asked")).first()
    drawn = different.orderBy("a", "b").limit(SAMPLE).select("v").toArrow()["v"]
    leaves = 2 ** round(math.log2(min(max(n / LEAF_ROWS, FEWEST_LEAVES), MOST_LEAVES)))
    forest = plant(matrix(drawn, width), leaves, k=k)
    row_blocks = max(1, math.ceil(n * TREES / forest.leaves / BLOCK_ROWS))
    query_blocks = max(1, math.ceil(n_asked * forest.visits / forest.leaves / BLOCK_QUERIES))
    shared = df.sparkSession.sparkContext.broadcast(forest)
    vector_type = ArrayType(kind)
    cells = StructType([StructField("leaf", IntegerType()), StructField("row_block", IntegerType()), StructField("query_block", IntegerType()), StructField("a", LongType()), StructField("b", LongType()), StructField("v", vector_type), StructField("ids", ArrayType(LongType())), StructField("homes", ArrayType(IntegerType())), StructField("floor", DoubleType()), StructField("visits", BinaryType())])
    dealt = different.select("a", "b", "v", "ids", F.col("asked").isNotNull().alias("asked")).mapInArrow(_deal(shared, width, k + 1, row_blocks, query_blocks), cells)
    hits = dealt.groupBy("leaf", "row_block", "query_block").applyInArrow(_meet(width, k + 1), "a long, b long, vec_id long, score double")
    best = hits.groupBy("a", "b", "vec_id").agg(F.max("score").alias("score"))
    queries = keyed.where("q").select(F.col("id").alias("query_id"), "a", "b").distinct()
    top = best.withColumn("place", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    listed = top.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("hits"))
    others = queries.join(listed, ["a", "b"]).select("query_id", F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")).alias("hits"))
    return others.select("query_id", F.posexplode(F.slice("hits", 1, k)).alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def _deal(shared, width: int, k: int, row_blocks: int, query_blocks: int) -> Callable:
    """Puts every vector into its leaves, and every query into the leaves it visits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                x = matrix(batch.column("v"), width)
                if not len(x):
                    continue
                asked = np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False))
                a = batch.column("a").to_numpy()
                homes = forest.leaves_of(x)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(homes.ravel().astype(np.int32)), homes.shape[1]).cast(pa.list_(pa.int32()))
                yield cells(batch, np.repeat(np.arange(len(x)), homes.shape[1]), homes.ravel(), a, lists, None, None, None)
                visits = [forest.visited(m, forest.visits) for m in forest.margins(x[asked])]
                if visits:
                    floors = forest.floors(x[asked], visits, k)
                    many = [len(v) for v in visits]
                    seen = np.zeros((len(visits), forest.leaves), bool)
                    owner = np.repeat(np.arange(len(asked)), many)
                    seen[owner, np.concatenate(visits)] = True
                    maps = pa.array([row.tobytes() for row in np.packbits(seen, axis=1)], pa.binary())
                    yield cells(batch, np.repeat(asked, many), np.concatenate(visits), a, None, maps, floors, owner)

    def cells(batch: pa.RecordBatch, source: np.ndarray, leaf: np.ndarray, a: np.ndarray, homes: pa.Array | None, maps: pa.Array | None, floors: np.ndarray | None, owner: np.ndarray | None) -> pa.RecordBatch:
        queries = floors is not None
        own, copies = (query_blocks, row_blocks) if queries else (row_blocks, query_blocks)
        block = np.repeat((a[source] % own).astype(np.int32), copies)
        copy = np.tile(np.arange(copies, dtype=np.int32), len(source))
        source, leaf = np.repeat(source, copies), np.repeat(leaf, copies)
        take = batch.take(pa.array(source))
        lists = pa.nulls(len(source), pa.list_(pa.int32())) if queries else homes.take(pa.array(source))
        visits = maps.take(pa.array(np.repeat(owner, copies))) if queries else pa.nulls(len(source), pa.binary())
        floor = pa.array(np.repeat(floors[owner], copies)) if queries else pa.nulls(len(source), pa.float64())
        ids = pa.nulls(len(source), take.column("ids").type) if queries else take.column("ids")
        arrays = [pa.array(leaf.astype(np.int32)), pa.array(copy if queries else block), pa.array(block if queries else copy), take.column("a"), take.column("b"), take.column("v"), ids, lists, floor, visits]
        return pa.RecordBatch.from_arrays(arrays, names=["leaf", "row_block", "query_block", "a", "b", "v", "ids", "homes", "floor", "visits"])

    return deal


def _meet(width: int, k: int) -> Callable:
    """Ranks a block of a leaf's rows for a block of the queries that visit it."""

    def meet(cell: pa.Table) -> pa.Table:
        asking = cell["floor"].is_valid()
        queries, rows = cell.filter(asking), cell.filter(pa.compute.invert(asking))
        a, b = queries["a"].to_numpy(), queries["b"].to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(rows):
            # a row that an earlier tree has shown to a query too is left to that tree
            homes = np.array(rows["homes"].to_pylist(), np.int64)
            earlier = homes[:, : int(np.flatnonzero(homes[0] == cell["leaf"][0].as_py())[0])]
            seen = np.unpackbits(np.frombuffer(b"".join(queries["visits"].to_pylist()), np.uint8).reshape(len(queries), -1), axis=1).astype(bool)
            for q, score, ids in ranked(matrix(queries["v"], width), queries["floor"].to_numpy(), matrix(rows["v"], width), rows["ids"].to_pylist(), k, lambda q, near: seen[q][earlier[near]].any(axis=1)):
                out.append((np.full(len(ids), a[q]), np.full(len(ids), b[q]), ids, score))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        return pa.table(dict(zip(("a", "b", "vec_id", "score"), map(pa.array, columns))))

    return meet


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors found nearest to each whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
