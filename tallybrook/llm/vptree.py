"""Nearest neighbours by cosine with vantage-point trees, one for each shard of the vectors.

On unit vectors the nearest by Euclidean distance are those with the largest cosine. A tree's node keeps the least and largest
distance of each child's vectors from the node's vantage point; a query passes a child over when even the nearest point these
bounds allow is farther than ``factor`` times its k-th best distance so far (smaller factors prune more; 1 is exact search).
Queries walk a tree together, so distances at a node or leaf are one small matrix product, and leave a branch one by one. In a
leaf whatever is within rounding of a query's k-th best is ranked by its exact cosine and id, so ties are settled as in the result.

A shard's tree is built once, in the task that has the shard's vectors; all queries then stream past it in blocks. Of equal
vectors only the k + 1 smallest ids can be among anyone's k nearest, so the others are dropped first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors a shard aims at, queries of one block, vectors of a leaf.
SHARD_ROWS, QUERY_ROWS, LEAF = 16384, 4096, 192
#: Added to pruning distances and to cosines against rounding.
SLACK = 1e-6


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which keeps their cosines, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


class Tree:
    """Vantage-point tree over vectors of one dimension; ``nodes`` are (None, rows) or (vantage row, [(lo, hi, child), ...])."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int) -> None:
        self.ids, self.v = ids, scaled(vectors)
        self.len = lengths(self.v)
        self.u = self.v / self.len[:, None]
        self.repeated = len(np.unique(ids)) < len(ids)
        self.nodes: list[tuple] = []
        self._grow(np.arange(len(ids)), np.random.default_rng(seed))

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        at, u = len(self.nodes), self.u
        self.nodes.append((None, rows))
        if len(rows) > LEAF:
            tried = rows[rng.integers(0, len(rows), 6)]
            some = u[rows[rng.integers(0, len(rows), 128)]]
            spread = np.sqrt(np.maximum(0, 2 - 2 * u[tried] @ some.T)).std(axis=1)
            vantage = int(tried[spread.argmax()])
            d = np.sqrt(np.maximum(0, 2 - 2 * u[rows] @ u[vantage]))
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            children = [(float(d[p[0]]), float(d[p[-1]]), rows[p]) for p in (order[:half], order[half:])]
            self.nodes[at] = (vantage, [(lo, hi, self._grow(part, rng)) for lo, hi, part in children])
        return at

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the vectors (or -1) and exact cosines of each query's ``k`` nearest found, by falling cosine, then rising id."""
        q = scaled(queries)
        qlen = lengths(q)
        qu = q / qlen[:, None]
        best, found = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)

        def leaf(who: np.ndarray, rest: np.ndarray) -> None:
            near = qu[who] @ self.u[rest].T
            near[self.ids[rest][None, :] == qids[who][:, None]] = -np.inf
            least = best[who, -1]
            if len(rest) > k and not self.repeated:  # what k vectors of this leaf beat isn't looked at
                least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k])
            i, j = np.nonzero((near > -np.inf) & (near >= least[:, None] - SLACK))
            if not len(i):
                return
            i, j = who[i], rest[j]
            cos = np.concatenate([(self.v[j[a : a + 65536]] * q[i[a : a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536)]) / (self.len[j] * qlen[i])
            own = np.unique(i)
            i, j, cos = np.concatenate([np.repeat(own, k), i]), np.concatenate([found[own].ravel(), j]), np.concatenate([best[own].ravel(), cos])
            i, j, cos = i[j >= 0], j[j >= 0], cos[j >= 0]
            order = np.lexsort((self.ids[j], -cos, i))
            if self.repeated:  # an id with several vectors counts with its best
                _, once = np.unique(np.stack([i[order], self.ids[j[order]]], axis=1), axis=0, return_index=True)
                order = order[np.sort(once)]
            i, j, cos = i[order], j[order], cos[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            top = nth < k
            best[own], found[own] = -np.inf, -1
            best[i[top], nth[top]], found[i[top], nth[top]] = cos[top], j[top]

        def visit(at: int, who: np.ndarray) -> None:
            vantage, rest = self.nodes[at]
            if vantage is None:
                leaf(who, rest)
                return
            d = np.sqrt(np.maximum(0, 2 - 2 * qu[who] @ self.u[vantage]))
            near_first = d <= (rest[0][1] + rest[1][0]) / 2
            for first in (True, False):  # each query looks into its own half first
                for side, (lo, hi, child) in enumerate(rest):
                    mine = np.flatnonzero((near_first == (side == 0)) == first)
                    reach = factor * np.sqrt(np.maximum(0, 2 - 2 * best[who[mine], -1])) + SLACK
                    mine = mine[np.maximum(lo - d[mine], d[mine] - hi) <= reach]
                    if len(mine):
                        visit(child, who[mine])

        if len(q):
            visit(0, np.arange(len(q)))
        return found, best


def _searched(k: int, factor: float, seed: int):
    """Reads (shard, asked, id, v) sorted by shard, its vectors before its queries; gives (query_id, vec_id, score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, vectors, trees = None, {}, {}, {}
        for b in batches:
            dims = b["v"].map(len)
            for (shard, asked, size), rows in b.groupby(["shard", "asked", dims.rename("size")], sort=True):
                if shard != now:
                    now, ids, vectors, trees = shard, {}, {}, {}
                v = np.stack(rows["v"].to_numpy())
                if not asked:
                    ids.setdefault(size, []).append(rows["id"].to_numpy())
                    vectors.setdefault(size, []).append(v)
                    continue
                if size in ids:
                    trees[size] = Tree(np.concatenate(ids.pop(size)), np.concatenate(vectors.pop(size)), seed)
                if size not in trees:
                    continue
                tree, qids = trees[size], rows["id"].to_numpy()
                for a in range(0, len(v), QUERY_ROWS):
                    found, cos = tree.search(qids[a : a + QUERY_ROWS], v[a : a + QUERY_ROWS], k, factor)
                    i, j = np.nonzero(found >= 0)
                    yield pd.DataFrame({"query_id": qids[a : a + QUERY_ROWS][i], "vec_id": tree.ids[found[i, j]], "score": cos[i, j]})

    return run


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding", shards: int | None = None, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's ``k`` nearest among all other ids, nearest first, ties to smaller ids.

    ``queries`` has the columns of ``vectors``; a candidate with the query's own id isn't returned. Vectors that are null, zero,
    of another length than the query's, or hold null or non-finite components take no part, nor do null ids. Rows that repeat
    an id and vector count once; an id with several vectors is found by each and reported once, with its best. ``score`` is the
    cosine of the stored vectors in double precision. Fewer candidates than ``k`` give fewer rows.
    """
    good = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    first = Window.partitionBy("v").orderBy("id")
    points = good(vectors).distinct().withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= k + 1)
    if shards is None:
        shards = max(1, -(-vectors.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(shards)).cast("int").alias("shard")
    # every shard meets all queries
    asked = good(queries).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asked"), "id", "v")
    both = points.select(shard, F.lit(0).alias("asked"), "id", "v").unionByName(asked)
    hits = both.repartition("shard").sortWithinPartitions("shard", "asked").mapInPandas(_searched(k, factor, seed), "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
