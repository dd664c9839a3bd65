"""Nearest neighbours by inner product through collision-counting hashing.

Every block of vectors keeps one sorted array for each random projection. Around a query's own
projections windows grow step by step (virtual rehashing: the sorted arrays stay as they are); a
vector that lies in enough windows at once has collided often enough to be verified, by its exact
inner product. Windows grow until enough vectors are verified, at last to the whole block, so a
query always gets as many neighbours as there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAREST = 20
QUERY_EVERY = 20
#: Random projections of a block, and the share of them that a vector must collide in.
PROJECTIONS = 48
COLLISION_SHARE = 0.9
#: Verified vectors of a block after which windows stop to grow: some times the neighbours wanted
#: and a share of the block.
VERIFIED_TIMES = 8
VERIFIED_SHARE = 0.28
#: First half width of a window in standard deviations of its projection, and its growth.
FIRST_WINDOW = 1.5
GROWTH = 1.15
#: Vectors and queries of a block at most, on average.
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 4096


class SortedProjections:
    """One block: vectors made equally long by one more component, and their sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        square = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.lifted = np.hstack([self.vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]])
        rng = np.random.default_rng(7)
        self.lines = rng.normal(size=(self.lifted.shape[1], PROJECTIONS))
        shadow = self.lifted @ self.lines
        self.order = np.argsort(shadow, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(shadow, self.order.T.astype(np.int64), axis=0).T.copy()
        self.length = float(np.sqrt(square.max()))

    def search(self, queries: np.ndarray, own: np.ndarray, nearest: int):
        """For each query: ids and inner products of the nearest found, best first, then by id."""
        n = len(self.ids)
        size = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        # on the sphere of the lifted vectors
        centre = (queries * (self.length / size)[:, None]) @ self.lines[:-1]
        missing = PROJECTIONS - int(np.ceil(COLLISION_SHARE * PROJECTIONS))
        wanted = min(n, 1 + VERIFIED_TIMES * nearest + int(VERIFIED_SHARE * n))
        half, open_ = FIRST_WINDOW * self.length, np.arange(len(queries))
        out = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        while len(open_):
            low, high = (
                np.stack([np.searchsorted(s, c, side) for s, c in zip(self.sorted, edge)])
                for side, edge in (("left", centre[open_].T - half), ("right", centre[open_].T + half))
            )
            left = []
            for i, q in enumerate(open_):
                # windows hold most of a block: the misses are fewer to count than the collisions
                outside = [o[:a] for o, a in zip(self.order, low[:, i])]
                outside += [o[b:] for o, b in zip(self.order, high[:, i])]
                found = np.flatnonzero(np.bincount(np.concatenate(outside), minlength=n) <= missing)
                if len(found) < wanted:
                    left.append(q)
                    continue
                found = found[self.ids[found] != own[q]]
                score = self.vectors[found] @ queries[q]
                if len(found) > 4 * nearest:
                    least = np.partition(score, len(score) - nearest)[len(score) - nearest]
                    found, score = found[score >= least], score[score >= least]
                best = np.lexsort((self.ids[found], -score))[:nearest]
                out[q] = (self.ids[found][best], score[best])
            half, open_ = half * GROWTH, np.array(left, dtype=np.int64)
        return out


def _usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, v (doubles) of rows that take part: whole, finite and not zero, with an id."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")
    )
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _blocks(count: int, size: int) -> int:
    return max(1, -(-count // size))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")


def search(
    vectors: DataFrame, nearest: int = NEAREST, every: int = QUERY_EVERY, id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest found for ids divisible by `every`.

    Blocks of queries meet blocks of vectors, each pair of blocks in a task of bounded size. Vectors
    that are null, zero or hold null or non-finite components take no part, nor do those of another
    length than most (ties: the shorter) or without an id. A query's candidates are all rows of
    other ids; rows that share an id are all candidates. No vectors: no rows.
    """
    rows = _usable(vectors, id_column, vector_column)
    is_query = F.col("vec_id") % every == 0
    sizes = (
        rows.groupBy(F.size("v").alias("size"))
        .agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries"))
        .orderBy(F.desc("n"), "size")
        .first()
    )
    if sizes is None:
        return rows.select(
            F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        )
    rows = rows.where(F.size("v") == sizes["size"])
    of_vectors, of_queries = _blocks(sizes["n"], BLOCK_VECTORS), _blocks(sizes["queries"], BLOCK_QUERIES)

    def every_block(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    data = rows.select(_block(of_vectors).alias("a"), "vec_id", "v").select(
        "a", every_block(of_queries).alias("b"), "vec_id", "v"
    )
    queries = rows.where(is_query).select(_block(of_queries).alias("b"), "vec_id", "v").select(
        every_block(of_vectors).alias("a"), "b", "vec_id", "v"
    )
    width = sizes["size"]

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            block = SortedProjections(left["vec_id"].to_numpy(), _array(left, width))
            own = right["vec_id"].to_numpy()
            for query, (ids, scores) in zip(own, block.search(_array(right, width), own, nearest)):
                out.append((np.full(len(ids), query), ids, scores))
        columns = [np.concatenate(c) for c in zip(*out)] or [np.empty(0)] * 3
        return pa.table(
            {
                "query_id": pa.array(columns[0], pa.int64()),
                "vec_id": pa.array(columns[1], pa.int64()),
                "score": pa.array(columns[2], pa.float64()),
            }
        )

    best = (
        data.groupBy("a", "b")
        .cogroup(queries.groupBy("a", "b"))
        .applyInArrow(found, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )


def _array(table: pa.Table, width: int) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
