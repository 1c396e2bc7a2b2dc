"""Approximate nearest neighbours by a hash-prefix forest.

Every tree hashes vectors to 64-bit strings (signs of random projections, the first projection in the
highest bit) and keeps them as a sorted array. A query descends in each tree towards its longest-prefix
matches, whose lengths vary with the density there, as far as any level may hold enough; then all trees
ascend together, one bit at a time, until their ranges hold enough candidates. At the last level the
trees are taken in order and the ascent ends inside it, so little more than asked for are scored, exactly.

Inner products are brought to angles by one more coordinate that fills every vector up to the largest
norm. The index is cut into blocks of distinct vectors (by hash), each with a forest of its own; the
stated queries visit every block, in blocks of their own that are larger, so a vector is shipped once
for every ``query_rows`` queries and no task holds more than ``TASK_BLOCKS`` blocks of it and one of queries. A
task goes through its blocks one by one and hands on the best of them all, so fewer rows are ranked; building
a block's trees anew for each block of queries is about a fiftieth of searching it. Equal vectors form a
class: it is indexed once, with its smallest k + 1 ids, which is all that any result can show, so a very
common vector costs one entry.

``share`` (candidates as a share of a block, ``least`` at least) decides the recall: vectors whose
neighbours are barely nearer than the rest need a large one. It is fitted, unless given: on a bounded
sample of classes (one block, ``FIT_QUERIES`` of them as queries) the forest is held against brute force,
for as many neighbours as a block may hold of the k nearest of all (``fit_k``), and the smallest of ``SHARES`` is taken whose
recall, less two standard errors of its mean, reaches ``target``. Every class is indexed.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of
different lengths never meet. Repeated rows count once; an id that repeats with other vectors is searched
with all of them, and found, by its best score. Fewer candidates than k: all of them. An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

TREES, LEAST, SEED = 256, 200, 20
BLOCK_ROWS, QUERY_ROWS = 8192, 65_536
BITS, TASK_BLOCKS = 64, 8
#: The fit: queries of the sample, shares that are tried, and the recall that is asked for.
FIT_QUERIES, SHARES, TARGET = 512, (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9, 1.0), 0.95


def takes_part(vector: Column) -> Column:
    """Whether a vector has only finite components, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted arrays of hash strings over one block of vectors."""

    def __init__(self, vectors: np.ndarray, radius: float, trees: int, seed: int = SEED):
        self.vectors, self.trees = vectors, trees
        draw = np.random.default_rng([seed, vectors.shape[1]])
        self.planes = draw.standard_normal((vectors.shape[1] + 1, trees * BITS))
        rest = np.sqrt(np.maximum(radius**2 - (vectors**2).sum(axis=1), 0))
        strings = self._strings(np.column_stack([vectors, rest]))
        self.order = np.ascontiguousarray(np.argsort(strings, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.take_along_axis(strings.T, self.order, 1))

    def _strings(self, full: np.ndarray) -> np.ndarray:
        out = np.empty((len(full), self.trees), np.uint64)
        for t in range(self.trees):
            signs = full @ self.planes[:, t * BITS : (t + 1) * BITS] > 0
            out[:, t] = np.packbits(signs, axis=1).view(">u8")[:, 0]
        return out

    def candidates(self, queries: np.ndarray, enough: int):
        """Of each query, the rows of the block that the synchronous ascent reaches: ``enough`` of them and the rest of the last tree's range, or all."""
        size = len(self.vectors)
        if enough >= size:
            yield from ((i, np.arange(size)) for i in range(len(queries)))
            return
        norms = np.sqrt((queries**2).sum(axis=1, keepdims=True))
        strings = self._strings(np.column_stack([queries / norms, np.zeros(len(queries))]))
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by prefix length from 1: queries, where their ranges begin, and how long they are
        going = np.arange(len(queries))
        for bits in range(1, BITS + 1):  # each query descends as long as it may find enough at that length
            span = np.uint64(BITS - bits)
            first = strings[going] >> span << span
            last = first | np.uint64((1 << int(span)) - 1)
            low, length = np.empty(first.shape, np.int64), np.empty(first.shape, np.int64)
            for t in range(self.trees):
                low[:, t] = np.searchsorted(self.sorted[t], first[:, t])
                length[:, t] = np.searchsorted(self.sorted[t], last[:, t], "right")
            length -= low
            stays = length.sum(axis=1) >= enough
            going = going[stays]
            if not len(going):
                break
            levels.append((going, low[stays], length[stays]))
        flat, base = self.order.reshape(-1), np.arange(self.trees, dtype=np.int64) * size
        for i in range(len(queries)):
            deeper = np.zeros(0, np.int32)
            for own, lows, lengths in reversed(levels):  # ascend in all trees at once
                at = int(np.searchsorted(own, i))
                if at == len(own) or own[at] != i:
                    continue
                low, length = lows[at], lengths[at]
                upto = np.cumsum(length)
                found = flat[np.arange(upto[-1]) + np.repeat(base + low - upto + length, length)]
                tree = np.full(size, self.trees + 1, np.int16)  # of each row, the first tree that has it; 0 if a longer prefix had it
                tree[found[::-1]] = np.repeat(np.arange(1, self.trees + 1, dtype=np.int16), length)[::-1]
                tree[deeper] = 0
                held = np.cumsum(np.bincount(tree, minlength=self.trees + 2))[: self.trees + 1]
                if held[-1] < enough:
                    deeper = np.flatnonzero(tree <= self.trees)
                    continue
                yield i, np.flatnonzero(tree <= int(np.searchsorted(held, enough)))
                break
            else:
                yield i, np.arange(size)


def _search(index: pa.Table, queries: pa.Table, radius: float, k: int, trees: int, share: float, least: int) -> pa.Table:
    """(query, found, score): of each query the best k + 1 of several blocks, with all that tie with the last."""
    held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if index.num_rows and queries.num_rows:
        asked, classes = _matrix(queries), queries.column("class").to_numpy()
        for block in np.unique(index.column("block").to_numpy()).tolist():
            found = _block_search(index.filter(pc.equal(index.column("block"), block)), asked, classes, radius, k, trees, share, least)
            held = _best(tuple(np.concatenate(pair) for pair in zip(held, found, strict=True)), k + 1)
    return pa.table(dict(zip(("query", "found", "score"), held, strict=True)))


def _block_search(index: pa.Table, asked: np.ndarray, classes: np.ndarray, radius: float, k: int, trees: int, share: float, least: int) -> tuple[np.ndarray, ...]:
    out: tuple[list, list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
    vectors = _matrix(index)
    names = index.column("class").to_numpy()
    order = np.argsort(names, kind="stable")
    vectors, names = vectors[order], names[order]
    forest = Forest(vectors, radius, trees)
    for at in range(0, len(asked), 256):
        for i, rows in forest.candidates(asked[at : at + 256], max(least, int(share * len(vectors)))):
            score = (vectors[rows] * asked[at + i]).sum(axis=1)
            best = _top(score, names[rows], min(k + 1, len(rows)))
            for part, values in zip(out, (np.full(len(best), classes[at + i]), names[rows[best]], score[best]), strict=True):
                part.append(values)
    return tuple(np.concatenate(part) for part in out)


def _best(rows: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Of each query the k largest scores, with all that tie with the last."""
    order = np.lexsort((-rows[2], rows[0]))
    query, found, score = (part[order] for part in rows)
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(query)))
    edge = np.repeat(score[first + np.minimum(k, size) - 1], size)
    return tuple(part[score >= edge] for part in (query, found, score))


def fit_share(vectors: np.ndarray, radius: float, k: int, trees: int, least: int, target: float, queries: int = FIT_QUERIES) -> tuple[float, float]:
    """The smallest share whose recall of the k nearest among these distinct vectors surely reaches the target, and what it surely is."""
    forest, asked = Forest(vectors, radius, trees), np.arange(min(queries, len(vectors)))
    score = vectors[asked] @ vectors.T
    score[asked, asked] = -np.inf
    k = min(k, len(vectors) - 1)
    if k < 1:
        return 1.0, 1.0
    edge = -np.partition(-score, k - 1, axis=1)[:, k - 1]

    def recall(share: float) -> float:
        each = np.array([min(k, int((score[i, rows] >= edge[i]).sum())) / k for i, rows in forest.candidates(vectors[asked], max(least, int(share * len(vectors))))])
        return float(each.mean() - 2 * each.std() / np.sqrt(len(each)))

    share = SHARES[min(bisect.bisect_left(SHARES, target, key=recall), len(SHARES) - 1)]
    return share, recall(share)


def fit_k(k: int, blocks: int) -> int:
    """How many neighbours in one block a fit looks at: half as many again as fall to a block on average, since only the nearest of all blocks count."""
    return min(k, -(-3 * k // (2 * blocks)))


def _fitted(classes: DataFrame, n: int, radius: float, k: int, trees: int, least: int, target: float, block_rows: int) -> float:
    """The largest of the shares that the vectors' lengths need, each fitted on a sample of at most about one block."""
    chance = F.pmod(F.xxhash64("class", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, block_rows / max(n, 1)) * (1 << 30))

    def fit(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("class").to_numpy(), kind="stable")
        return pa.table({"share": [fit_share(_matrix(table)[order], radius, k, trees, least, target)[0]]})

    found = classes.where(chance).groupBy("width").applyInArrow(lambda t: fit(t), "share double").agg(F.max("share")).first()[0]
    return 1.0 if found is None else found


def _top(score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """The k largest scores, with all that tie with the last."""
    edge = np.partition(score, len(score) - k)[len(score) - k]
    some = np.flatnonzero(score >= edge)
    return some[np.lexsort((names[some], -score[some]))]


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("vector").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, share: float | None = None, least: int = LEAST, block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS, target: float = TARGET,
) -> DataFrame:
    """(query_id, rank, id, score): of each query row, the k rows found with the largest inner product."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # two hashes of different seeds name a vector; -0.0 and 0.0 are one
    rows = rows.where(takes_part(F.col("vector")) & F.col("id").isNotNull()).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    rows = written(rows.withColumn("a", F.xxhash64("vector")).withColumn("b", F.xxhash64(F.lit(1), "vector")), "vectors")
    size = rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    radius = float(size or 0.0)
    distinct = rows.groupBy("a", "b").agg(F.any_value("vector").alias("vector"), F.max("asks").alias("asks"))
    classes = written(distinct.withColumn("width", F.size("vector")).withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    named = classes.select("a", "b", "class")
    ids = rows.groupBy("a", "b", "id").agg(F.max("asks").alias("asks"))
    smallest = Window.partitionBy("a", "b").orderBy("id")
    members = ids.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1).join(named, ["a", "b"]).select(F.col("class").alias("found"), F.col("id").alias("candidate"))

    n, asked = classes.count(), classes.where("asks").count()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-asked // query_rows))
    if share is None:
        share = _fitted(classes, n, radius, fit_k(k, blocks), trees, least, target, block_rows)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda count, salt: F.pmod(F.xxhash64("class", F.lit(salt)), F.lit(count)).cast("int")
    index = classes.select("class", "vector", "width", own(blocks, 1).alias("block"), every(query_blocks).alias("query_block"))
    # as many blocks a task as leave work for all
    several = max(1, min(TASK_BLOCKS, blocks * query_blocks // (4 * vectors.sparkSession.sparkContext.defaultParallelism)))
    tasks = -(-blocks // several)
    queries = classes.where("asks").select("class", "vector", "width", own(query_blocks, 2).alias("query_block"), every(tasks).alias("task"))
    index = index.withColumn("task", F.floor(F.col("block") / several).cast("int"))
    keys = ["width", "task", "query_block"]

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, radius, k, trees, share, least)

    near = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(lambda a, b: searched(a, b), "query long, found long, score double")
    # k + 1 classes and those that tie with the last hold k rows besides the query's own
    best = near.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("place") <= k + 1).drop("place")
    best = written(best, "near-classes")
    asking = ids.where("asks").join(named, ["a", "b"]).select(F.col("id").alias("query_id"), F.col("class").alias("query"))
    pairs = asking.join(best, "query").join(members, "found").where("candidate <> query_id").groupBy("query_id", "candidate").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("candidate").alias(id_col), "score")
