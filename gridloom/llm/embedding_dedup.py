"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors are one class. Classes are dealt into blocks, and each pair of blocks is one task's work: vectors, scaled to
length one, are quantised to int8 with a scale of their own, tiles of them are multiplied, and with x = x' + e the product
of two vectors differs from that of the quantised ones by at most |x'| |e_y| + |e_x| |y|. Only pairs that may reach the
threshold within that bound are computed again, from the original components in double precision.

A task returns what grows with its vectors, not with its pairs: how many vectors each one links to, and the links of a
spanning forest. No link is lost: the pairs of blocks cover every pair of classes.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; neither do vectors of
different lengths with each other. Rows without vec_id link with nothing and have no component. Repeated rows are vectors
of their own. An empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import release, stored
from gridloom.llm.components import connected
from gridloom.llm.vectors import matrix, numbered, usable

TILE = 1024


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, length of the quantised vector, length of the error) of each row."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def linked(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Yields arrays (i, j) of the rows of x and y whose cosine reaches the threshold; i < j if x and y are the same rows."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, lx, ex = quantised(x / nx[:, None])
    qy, sy, ly, ey = (qx, sx, lx, ex) if same else quantised(y / ny[:, None])
    # products of int8 are exact in float32 while their sum stays below 2^24
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    for a in range(0, len(x), TILE):
        left = qx[a : a + TILE].astype(kind)
        for b in range(a if same else 0, len(y), TILE):
            product = (left @ qy[b : b + TILE].astype(kind).T).astype(np.float64)
            product *= sx[a : a + TILE, None] * sy[None, b : b + TILE]
            bound = lx[a : a + TILE, None] * ey[None, b : b + TILE] + ex[a : a + TILE, None]
            i, j = np.nonzero(product + bound >= threshold - 1e-9)
            i, j = i + a, j + b
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 200_000):
                p, q = i[k : k + 200_000], j[k : k + 200_000]
                exact = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q])
                yield p[exact >= threshold], q[exact >= threshold]


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]], size: int, parent: np.ndarray) -> list[tuple[int, int]]:
    edges = []
    for p, q in pairs:
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            while parent[b] != b:
                parent[b] = parent[parent[b]]
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((a, b))
    return edges


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) a row of vectors."""
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).withColumn("ok", usable(F.col("v")) & F.col("vec_id").isNotNull()))
    classes = rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    _, blocks = numbered(classes, 4096, 131_072, 36.0)
    dealt = classes.select("node", "copies", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dims"), F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = dealt.withColumn("other", other).withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("other")

    def compare(group: pa.Table) -> pa.Table:
        p, q = group["p"][0].as_py(), group["q"][0].as_py()
        block = group["block"].to_numpy()
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        left = np.flatnonzero(block == p)
        right = left if p == q else np.flatnonzero(block == q)
        x = matrix(group["v"].take(pa.array(left)))
        y = x if p == q else matrix(group["v"].take(pa.array(right)))
        degree, parent, edges = np.zeros(len(node), dtype=np.int64), np.arange(len(node)), []
        if len(x) and len(y):
            for i, j in linked(x, y, threshold, p == q):
                i, j = left[i], right[j]
                np.add.at(degree, i, copies[j])
                np.add.at(degree, j, copies[i])
                edges += _forest([(i, j)], len(node), parent)
        some = np.flatnonzero(degree)
        a = np.concatenate([node[some], node[[e[0] for e in edges]] if edges else np.zeros(0, dtype=np.int64)])
        b = pa.array([None] * len(some) + (node[[e[1] for e in edges]].tolist() if edges else []), pa.int64())
        n = np.concatenate([degree[some], np.zeros(len(edges), dtype=np.int64)])
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": pa.array(n, pa.int64())})

    found = stored(met.groupBy("p", "q", "dims").applyInArrow(compare, "a long, b long, n long"))
    degrees = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    parts = connected(found.where("b is not null").select("a", "b"))
    own = classes.select("v", "node", "first", "copies").join(degrees, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = own.where("component is not null").groupBy("part").agg(F.min("first").alias("least"))
    done = own.join(least, "part", "left").select("v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    met_rows = rows.where("ok").join(done, "v").select("vec_id", "n_links", "component_id")
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met_rows.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
