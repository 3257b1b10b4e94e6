"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected to M Gaussian directions; the squared projected distance of two vectors, over their squared true
distance, is chi-squared with M degrees. A top kd-tree, fitted to at most SAMPLE projected rows, cuts space into cells;
every row is indexed in its cell, cells of more than 2 * CELL rows are split by a hash of vec_id, so a part stays of that size
however large the table is, and each part builds its own kd-tree of buckets. A query takes buckets in the order of projected distance and verifies their vectors by the true
distance. It stops when a vector nearer than the K-th so far would lie so far away in projection with a probability of
1 - P at most (the chi-square test). Round one searches the query's own cell; its K-th distance then tells, by the same
test, which other cells round two must visit.

Vectors null, zero, with null or non-finite components, or of a length other than the most frequent one take no part,
nor do rows without a vec_id. Ties go to the smaller vec_id. With fewer than K candidates all are given, and round two
visits every cell. Rows with the query's own vec_id are no candidates. Extra columns are ignored; empty tables give no
rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, table, written

M, K, P = 10, 10, 0.97
SAMPLE, CELL, CELLS, BUCKET = 20_000, 4096, 1 << 16, 64


def chi_square_cdf(x: float, m: int = M) -> float:
    """For even m."""
    h = x / 2
    return 1 - math.exp(-h) * sum(h**i / math.factorial(i) for i in range(m // 2))


def chi_square_quantile(p: float = P, m: int = M) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, m) < p else (lo, mid)
    return hi


def directions(dim: int, m: int = M, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


def top_tree(points: np.ndarray, depth: int) -> np.ndarray:
    """(axis, value) of the 2 ** depth - 1 inner nodes, in heap order."""
    tree = np.zeros((2**depth - 1, 2))

    def cut(node, p, d):
        if d == 0:
            return
        axis = int(np.argmax(p.max(0) - p.min(0))) if len(p) else 0
        value = float(np.median(p[:, axis])) if len(p) else 0.0
        tree[node] = axis, value
        low = p[:, axis] <= value
        cut(2 * node + 1, p[low], d - 1)
        cut(2 * node + 2, p[~low], d - 1)

    cut(0, points, depth)
    return tree


def cell_of(points: np.ndarray, tree: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for _ in range((len(tree) + 1).bit_length() - 1):
        axis, value = tree[node, 0].astype(int), tree[node, 1]
        node = 2 * node + np.where(points[np.arange(len(points)), axis] <= value, 1, 2)
    return node - len(tree)


class KdTree:
    """Buckets of a kd-tree over projected points, with their boxes."""

    def __init__(self, points: np.ndarray, bucket: int = BUCKET):
        self.parts, stack = [], [np.arange(len(points))]
        while stack:
            ix = stack.pop()
            p = points[ix]
            spread = p.max(0) - p.min(0)
            if len(ix) <= bucket or not spread.max():
                self.parts.append(ix)
                continue
            order = ix[np.argpartition(p[:, spread.argmax()], len(ix) // 2)]
            stack += [order[: len(ix) // 2], order[len(ix) // 2 :]]
        self.low = np.array([points[i].min(0) for i in self.parts])
        self.high = np.array([points[i].max(0) for i in self.parts])

    def near(self, q: np.ndarray):
        """(squared projected distance, rows) of the buckets, nearest first."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        d = (gap**2).sum(1)
        for i in np.argsort(d, kind="stable"):
            yield float(d[i]), self.parts[i]


def search(tree: KdTree, vectors: np.ndarray, ids: np.ndarray, q: np.ndarray, qp: np.ndarray, own: int, bound: float, limit: float, k: int = K):
    """The k nearest of vectors to q, as (distance, vec_id), but for rows of the query's own id."""
    best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
    for near, rows in tree.near(qp):
        kth = min(bound, best_d[-1]) if len(best_d) == k else bound
        if near > limit * kth * kth:
            break
        rows = rows[ids[rows] != own]
        d = np.sqrt(((vectors[rows] - q) ** 2).sum(1))
        best_d, best_i = np.concatenate([best_d, d]), np.concatenate([best_i, ids[rows]])
        order = np.lexsort((best_i, best_d))[:k]
        best_d, best_i = best_d[order], best_i[order]
    return best_d, best_i


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part."""
    v = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.filter(~F.exists("embedding", lambda x: F.coalesce(bad(x), F.lit(True))) & F.exists("embedding", lambda x: x != 0))
    top = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("embedding") == (top["n"] if top else 0))


def nearest(vectors: DataFrame, is_query, k: int = K, p: float = P, cell: int = CELL) -> DataFrame:
    """The k nearest candidates of each row for which is_query holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    kind = "query_id long, rank int, vec_id long, score double"
    v = written(usable(vectors).withColumn("q", F.coalesce(is_query, F.lit(False))), "vectors")
    n = v.count()
    if not n:
        return spark.createDataFrame([], kind)
    sample = v.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("embedding").toPandas()["embedding"]
    sample = np.stack(sample.to_numpy())
    r = directions(sample.shape[1])
    cells = min(CELLS, -(-n // cell))  # their boxes are at most CELLS * 2 * M doubles
    depth = min(math.ceil(math.log2(cells)), max(0, int(math.log2(len(sample))) - 3)) if cells > 1 else 0
    tree, limit = top_tree(sample @ r, depth), chi_square_quantile(p)

    def place(batches):
        import pyarrow as pa

        for b in batches:
            x = np.stack([np.array(e) for e in b.column(1).to_pylist()]) if b.num_rows else np.zeros((0, len(r)))
            pts = x @ r
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell_of(pts, tree)), pa.array(list(pts), pa.list_(pa.float64()))], ["vec_id", "embedding", "q", "cell", "pts"])

    placed = v.mapInArrow(place, "vec_id long, embedding array<double>, q boolean, cell long, pts array<double>")
    placed = written(placed, "placed")
    box = [f(F.col("pts")[i]).alias(f"{a}{i}") for i in range(M) for a, f in (("lo", F.min), ("hi", F.max))]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *box).toPandas().sort_values("cell")
    low, high = (boxes[[f"{a}{i}" for i in range(M)]].to_numpy(float) for a in ("lo", "hi"))
    numbers, parts = boxes["cell"].to_numpy(np.int64), np.maximum(1, -(-boxes["n"].to_numpy() // (2 * cell)))
    split = spark.createDataFrame(list(zip(numbers.tolist(), parts.tolist())), "cell long, parts int")
    index = placed.join(F.broadcast(split), "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), "vec_id", "embedding", "pts")
    queries = written(placed.filter("q").select("vec_id", "embedding", "pts", "cell"), "ann-queries")
    found = "query_id long, vec_id long, score double"

    def visit(ix, qs):
        import pandas as pd

        out = []
        if len(ix) and len(qs):
            x, pts, ids = np.stack(ix["embedding"].to_numpy()), np.stack(ix["pts"].to_numpy()), ix["vec_id"].to_numpy()
            t = KdTree(pts)
            for own, e, qp, bound in zip(qs["vec_id"], qs["embedding"], qs["pts"], qs["bound"]):
                d, i = search(t, x, ids, np.array(e), np.array(qp), own, bound, limit, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": i, "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    def round_(todo):
        todo = todo.join(F.broadcast(split), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return index.groupBy("cell", "part").cogroup(todo.groupBy("cell", "part")).applyInPandas(visit, found)

    def ranked(df):
        w = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    one = written(round_(queries.withColumn("bound", F.lit(float("inf")))), "ann-1")
    kth = ranked(one).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    more = queries.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def others(batches):
        import pyarrow as pa

        for b in batches:
            for j in range(b.num_rows):
                q, own, bound = np.array(b.column(2)[j].as_py()), b.column(3)[j].as_py(), b.column(4)[j].as_py()
                d = (np.maximum(np.maximum(low - q, q - high), 0) ** 2).sum(1)
                to = numbers[(d <= limit * bound * bound) & (numbers != own)]
                if len(to):
                    take = pa.array(np.full(len(to), j))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in (0, 1, 2)), pa.array(to), b.column(4).take(take)], ["vec_id", "embedding", "pts", "cell", "bound"])

    todo = more.select("vec_id", "embedding", "pts", "cell", "bound").mapInArrow(others, "vec_id long, embedding array<double>, pts array<double>, cell long, bound double")
    both = one.unionByName(round_(todo))
    return ranked(both).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)
