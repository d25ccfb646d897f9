"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are dealt into index blocks of bounded size.  A task reads a block's vectors, builds its index once,
and then streams the whole query set past it in parts of bounded size, so neither side is limited.  For
each dimension a block has two posting lists, by how far a component lies above the block's minimum and below
its maximum, so that every contribution to a query's score is its weight times a non-negative impact.
Impacts are quantised to levels; segments (dimension, side, level) are processed from the highest level
down, adding the level's lower bound for all queries at hand.  What an unprocessed or rounded impact
can still add is bounded for each query; processing stops once that bound proves that all but a few
vectors can't reach the k-th score, and the possible members are rescored with exact integers.  A last
step merges k rows a block for each query.  Vectors with components over LARGEST are kept beside the index and
scored with integers of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import table

SCALE = 256
K = 5
QUERY_STEP = 50
#: Rows of an index block, about, and queries that are processed at a time, at most.
INDEX_ROWS, QUERY_ROWS = 8192, 128
LEVELS = 32
#: A proof is tried first when no impact above this level is left, then each time the level has halved.
PROVING = 16
#: Share of a block that may be left as possible members when processing stops.
FEW = 0.01
#: Vectors with larger components, or with more of them, aren't indexed: their sums may not fit a long.
LARGEST, WIDEST = 1 << 24, 1 << 14


def vectors_rounding(dims: int) -> float:
    """Relative error of a sum of the terms of all segments of a vector, doubled."""
    return 4.0 * dims * LEVELS * 2.0**-52


class Block:
    """The impact-ordered index of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.stopped = self.rescored = 0  # queries that a proof ended early, and rows scored exactly
        self.low, self.high = vectors.min(0), vectors.max(0)
        # One step fits all dimensions, so that levels compare across them.
        self.step = max(1, -(-int((self.high - self.low).max() + 1) // LEVELS))
        self.segments: dict[int, list[tuple[int, bool, np.ndarray]]] = {}
        for d in range(vectors.shape[1]):
            for up, impact in ((True, vectors[:, d] - self.low[d]), (False, self.high[d] - vectors[:, d])):
                level = impact // self.step
                order = np.argsort(level, kind="stable")
                cuts = np.flatnonzero(np.diff(level[order])) + 1
                for rows in np.split(order, cuts):
                    if level[rows[0]]:
                        self.segments.setdefault(int(level[rows[0]]), []).append((d, up, rows))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query id, vector id, score) of each query's k best rows of the block, itself excluded."""
        n, few = len(self.ids), max(4 * k, int(FEW * len(self.ids)))
        weight = np.abs(queries).astype(np.float64)
        up, down = np.where(queries > 0, weight, 0.0), np.where(queries < 0, weight, 0.0)
        acc = np.zeros((n, len(queries)))  # lower bounds of the shifted scores
        own = self.ids[:, None] == query_ids[None, :]
        acc[own] = -np.inf
        kth = max(0, n - k - int(own.sum(0).max(initial=0)))
        possible: list[np.ndarray | None] = [None] * len(queries)
        open_ = np.arange(len(queries))
        total = weight.sum(1)
        # Sums of doubles are exact up to 2^53; beyond that the bound takes their rounding in.
        span = float((self.high - self.low).max()) + self.step
        sums = total * span
        slack = np.where(sums < 2.0**52, 0.0, sums * vectors_rounding(self.vectors.shape[1]))
        proving = PROVING
        for level in sorted(self.segments, reverse=True):
            for d, side, rows in self.segments[level]:
                acc[rows] += (up if side else down)[:, d] * (level * self.step)
            # Unprocessed impacts are below this level, processed ones are at most one step - 1 above what was added.
            rest = total * (level * self.step - 1) + slack
            if level <= proving:
                proving = level // 2
                open_ = self._prove(acc, rest, open_, kth, few, possible)
                if not len(open_):
                    break
        self.stopped += sum(p is not None for p in possible)
        self._prove(acc, total * (self.step - 1) + slack, open_, kth, n, possible)
        out = []
        for q, rows in enumerate(possible):
            rows = rows[self.ids[rows] != query_ids[q]]
            self.rescored += len(rows)
            score = self.vectors[rows] @ queries[q]
            for i in np.lexsort((self.ids[rows], -score))[:k]:
                out.append((int(query_ids[q]), int(self.ids[rows[i]]), int(score[i])))
        return out

    @staticmethod
    def _prove(acc: np.ndarray, rest: np.ndarray, open_: np.ndarray, kth: int, few: int, possible: list) -> np.ndarray:
        """Fill in the possible members of the queries that have at most `few`; returns the queries still open."""
        left = []
        for q in open_:
            own = acc[:, q]
            near = np.flatnonzero(own + rest[q] >= np.partition(own, kth)[kth])
            if len(near) <= few:
                possible[q] = near
            else:
                left.append(q)
        return np.array(left, int)


def _integers(vectors: list[list[float]], scale: int) -> list[list[int]]:
    """floor(scale * x) as integers of any size."""
    scaled = [[x * scale for x in v] for v in vectors]
    return [[math.floor(y) if math.isfinite(y) else int(x) * scale for x, y in zip(v, own, strict=True)] for v, own in zip(vectors, scaled, strict=True)]


def _plainly(ids: np.ndarray, vectors: list[list[int]], query_ids: np.ndarray, queries: list[list[int]], k: int) -> list[tuple[int, int, int]]:
    """As Block.search, one product after the other, with integers of any size."""
    out = []
    for query_id, q in zip(query_ids.tolist(), queries, strict=True):
        found = [(-sum(x * y for x, y in zip(v, q, strict=True)), i) for i, v in zip(ids.tolist(), vectors, strict=True) if i != query_id]
        out += [(query_id, i, -score) for score, i in sorted(found)[:k]]
    return out


class _Part:
    """The vectors of one block and length, then the queries that pass by."""

    def __init__(self, dims: int, k: int, scale: int) -> None:
        self.dims, self.k, self.scale = dims, k, scale
        self.block: Block | None = None
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.wide_ids, self.wide = np.zeros(0, np.int64), []

    def _split(self, ids: pa.Array, plain: pa.Array, wide: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        own, ok = ids.to_numpy(), plain.is_valid().to_numpy(zero_copy_only=False)
        return own[ok], plain.drop_null().flatten().to_numpy().astype(np.int64).reshape(-1, self.dims), own[~ok], _integers(wide.drop_null().to_pylist(), self.scale)

    def add(self, *columns: pa.Array) -> None:
        ids, vectors, wide_ids, wide = self._split(*columns)
        self.parts.append((ids, vectors))
        self.wide_ids, self.wide = np.concatenate([self.wide_ids, wide_ids]), self.wide + wide

    def ask(self, *columns: pa.Array) -> list[tuple[int, int, int]]:
        if self.block is None and any(len(i) for i, _ in self.parts):
            self.block = Block(np.concatenate([i for i, _ in self.parts]), np.concatenate([v for _, v in self.parts]))
        self.parts = []
        ids, queries, wide_ids, wide = self._split(*columns)
        out = []
        for at in range(0, len(ids), QUERY_ROWS):
            if self.block is not None:
                out += self.block.search(ids[at : at + QUERY_ROWS], queries[at : at + QUERY_ROWS], self.k)
        if self.wide:
            out += _plainly(self.wide_ids, self.wide, ids, queries.tolist(), self.k)
        if wide:
            out += _plainly(self.wide_ids, self.wide, wide_ids, wide, self.k)
            if self.block is not None:
                out += _plainly(self.block.ids, self.block.vectors.tolist(), wide_ids, wide, self.k)
        return out


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_step: int = QUERY_STEP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank from 1, id, score): the k best inner products of every row whose id is divisible by query_step.

    Components are floor(scale * x), x as double.  Ties go to the smaller id; a query's own id is no
    candidate.  Rows with a null id, a null vector, or a null or non-finite component take no part; empty
    vectors neither.  Rows that agree in id and vector count once; of rows that share an id with different
    vectors each is a candidate under that id, and as queries their results are one list of k.  Vectors of different
    length have no product.  Fewer than k candidates give fewer rows.  Components of any size take part; a score in
    the result that doesn't fit a long raises an error.  Other columns are ignored, whatever their names.  An empty
    table gives an empty result.
    """
    own = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(own, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is greater than all
    plain = F.forall("w", lambda x: F.abs(x * F.lit(float(scale))) <= F.lit(float(LARGEST))) & (F.size("w") <= WIDEST)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(finite, own).alias("w")).where("id is not null and w is not null and size(w) > 0")
    rows = rows.select("id", F.size("w").alias("dims"), F.when(plain, F.transform("w", lambda x: F.floor(x * F.lit(float(scale))).cast("int"))).alias("v"), F.when(~plain, F.col("w")).alias("w"))
    rows = table(rows.distinct(), "topk_rows")
    blocks = -(-rows.count() // INDEX_ROWS) or 1

    # Every vector goes to one block and every query past all blocks.
    at = F.pmod(F.xxhash64("id", "v", "w"), F.lit(blocks)).cast("int")
    index = rows.select(at.alias("b"), "dims", F.lit(0).alias("kind"), "id", "v", "w")
    asked = rows.where(F.col("id") % query_step == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "dims", F.lit(1).alias("kind"), "id", "v", "w")
    dealt = index.union(asked).repartition(2 * blocks, "b", "dims").sortWithinPartitions("b", "dims", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None
        for batch in batches:
            b, dims, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(dims) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if at != (b[lo], dims[lo]):
                    at, part = (b[lo], dims[lo]), _Part(int(dims[lo]), k, scale)
                columns = [batch.column(i).slice(lo, hi - lo) for i in (3, 4, 5)]
                if kind[lo] == 0:
                    part.add(*columns)
                    continue
                found = part.ask(*columns)
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["query_id", "id", "score"])

    found = dealt.mapInArrow(search, "query_id long, id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
