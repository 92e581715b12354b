"""Nearest neighbours by collision-counting hashing over sorted projections.

The index of a block of vectors is a number of sorted arrays, one for each random projection. A query looks at windows
around its own projections; widening them all by a factor (virtual rehashing) collides more vectors with it. Vectors that
collide in enough of the arrays are verified, by the measure itself in double precision on the original components, and
widening ends when enough vectors of the block were verified.

The largest inner product becomes the smallest distance by one more component: x/M with sqrt(1 - |x/M|^2), M the greatest
length in the table, and the query scaled to length one with a zero.

Every pair of a query block and an index block is one task's work; every row is indexed. A task returns its best for each
query, and the best of these are the result: nearest first, ties to the smaller vec_id.

Vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of different lengths are
never compared. Other columns, whatever their names, are not carried. Rows without vec_id take no part. Rows of one vec_id are vectors of their own; a query's own row alone is
left out. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import release, stored
from gridloom.llm.vectors import matrix, numbered, usable

PROJECTIONS, COLLIDE, WIDEN, START = 96, 0.6, 1.12, 0.8
#: Queries whose windows a task looks up together.
AT_ONCE = 64
#: Rows of a block that are sorted together: their ranks are 16-bit numbers. Windows are ranges of projections, so slices collide as one.
RANKED = 65_536
#: The share of a block's vectors that a query verifies at least.
VERIFIED = 0.12


class CollisionIndex:
    """Sorted projections of a block of vectors, in slices, and every vector's rank in each."""

    def __init__(self, vectors: np.ndarray, longest: float, projections: int = PROJECTIONS, seed: int = 7):
        self.vectors, self.single, self.longest = vectors, vectors.astype(np.float32), longest
        unit = vectors / longest
        rest = np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(axis=1)))
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections))
        projected = self.directions.T @ np.column_stack([unit, rest]).T
        self.sorted = [projected[:, a : a + RANKED].copy() for a in range(0, max(1, len(vectors)), RANKED)]
        self.ranks = [np.empty(part.shape, np.uint16) for part in self.sorted]
        for part, ranks in zip(self.sorted, self.ranks, strict=True):
            for values, rank in zip(part, ranks, strict=True):
                order = np.argsort(values)
                rank[order] = np.arange(len(order), dtype=np.uint16)
                values[:] = values[order]

    def windows(self, centres: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query, slice and projection, the first rank around the query's own projection and the number of them."""
        edge = lambda at, side: np.array([[np.searchsorted(s, c, side=side) for s, c in zip(part, at.T, strict=True)] for part in self.sorted])
        first, past = edge(centres - half, "left"), edge(centres + half, "right")
        return np.moveaxis(first, 2, 0), np.moveaxis(past - first, 2, 0)

    def colliding(self, first: np.ndarray, width: np.ndarray, need: int) -> np.ndarray:
        """The rows whose ranks are in at least `need` of one query's windows.

        A window is a run of ranks, so each array takes three passes over its ranks instead of a step for each row in the
        window; a rank below the window wraps to a number above its width.
        """
        found = []
        for ranks, starts, widths in zip(self.ranks, first, width, strict=True):
            m, n = ranks.shape
            above, inside, count = np.empty(n, np.uint16), np.empty(n, np.bool_), np.zeros(n, np.min_scalar_type(m))
            for k in np.flatnonzero(widths):
                np.subtract(ranks[k], np.uint16(starts[k]), out=above)
                np.less_equal(above, np.uint16(widths[k] - 1), out=inside)
                np.add(count, inside.view(np.uint8), out=count)
            found.append(np.flatnonzero(count >= need) + RANKED * len(found))
        return np.concatenate(found)

    def candidates(self, queries: np.ndarray, least: int, collide: float = COLLIDE, widen: float = WIDEN):
        """For each query, its number and the rows that collide with it in enough arrays, once at least `least` do.

        Windows only grow, so the first that suffice are looked for from where the query before found its own.
        """
        m, n = self.directions.shape[1], len(self.vectors)
        centres = queries / np.linalg.norm(queries, axis=1)[:, None] @ self.directions[:-1]
        need, least = min(m, int(np.ceil(collide * m))), min(least, n)
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        step = 0

        def at(query: int, step: int) -> np.ndarray:
            if step not in known:
                known[step] = self.windows(centres, START * widen**step)
            return self.colliding(known[step][0][query], known[step][1][query], need)

        for query in range(len(queries)):
            found = at(query, step)
            if len(found) < least:
                while len(found) < least:
                    step += 1
                    found = at(query, step)
            else:
                while step and len(fewer := at(query, step - 1)) >= least:
                    found, step = fewer, step - 1
            yield query, found


def best(index: CollisionIndex, ids: np.ndarray, rows: np.ndarray, own: int, query: np.ndarray, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the given rows: their places and scores. Equal vectors get equal sums.

    Single precision tells which rows can be among the k, with a margin of many times its error; those are computed in
    double precision.
    """
    at = at[rows[at] != own]
    if len(at) > 4 * k:
        rough = index.single[at] @ query.astype(np.float32)
        margin = 1e-6 * len(query) * index.longest * np.linalg.norm(query)
        at = at[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - margin]
    score = (index.vectors[at] * query).sum(axis=1)
    order = np.lexsort((ids[at], -score))[:k]
    return at[order], score[order]


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, verified: float = VERIFIED) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of every row that is_query holds for, against all rows."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), is_query.alias("asks"))
    rows = stored(base.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("row", F.monotonically_increasing_id()))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    longest = rows.agg(F.max(length).alias("m")).first().m or 1.0
    n, blocks = numbered(rows, 65_536, 262_144, 64.0)
    asked, asking = numbered(rows.where("asks"), 512, 16_384, 8.0)
    spread = lambda c, m: F.pmod(F.xxhash64(F.col(c)), F.lit(m)).cast("int")
    index = rows.withColumns({"x": spread("row", blocks), "q": F.explode(F.sequence(F.lit(0), F.lit(asking - 1))), "asks": F.lit(False)})
    queries = rows.where("asks").withColumns({"q": spread("row", asking), "x": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "asks": F.lit(True)})
    met = index.unionByName(queries).withColumn("dims", F.size("v"))

    def look(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy()
        held, mine = np.flatnonzero(~asks), np.flatnonzero(asks)
        out: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if len(held) and len(mine):
            v = matrix(group["v"].take(pa.array(held)))
            ids, own = group["vec_id"].to_numpy(), group["row"].to_numpy()
            built = CollisionIndex(v, longest)
            asked = matrix(group["v"].take(pa.array(mine)))
            for a in range(0, len(mine), AT_ONCE):
                for k_, near in built.candidates(asked[a : a + AT_ONCE], k + 1 + int(verified * len(v))):
                    at = mine[a + k_]
                    places, scores = best(built, ids[held], own[held], own[at], asked[a + k_], k, near)
                    out["query_row"] += [own[at]] * len(places)
                    out["query_id"] += [ids[at]] * len(places)
                    out["vec_id"] += ids[held][places].tolist()
                    out["score"] += scores.tolist()
        release()
        kinds = {"query_row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(out[c], kind) for c, kind in kinds.items()})

    found = met.groupBy("x", "q", "dims").applyInArrow(look, "query_row long, query_id long, vec_id long, score double")
    first = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
