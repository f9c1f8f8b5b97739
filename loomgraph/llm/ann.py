"""Approximate nearest neighbours with a forest of random-projection trees.

* The trees are fitted on a bounded sample of rows (SAMPLE); every row is then indexed, once in each tree.
* A search puts the branches not taken of all trees into one priority queue by their distance to the split, and visits
  leaves in that order. How many leaves is measured, not guessed: for a few probe queries the exact neighbours are
  found in one pass over all rows, and the number is such that RECALL of them are met.
* Rows of visited leaves, and no others, are reranked by the exact distance in double precision. A row that lies in
  visited leaves of several trees is computed once, in the first of them.

Equal vectors are one row of the index with the k + 1 smallest ids, which is all that any answer can use, so a vector
that makes up a third of the table costs no more than another. Rows of a few leaves form a group of bounded size; large
leaves are dealt out over several groups. Rows of the sample that a query's leaves hold bound its k-th distance, so
groups don't return rows that can't be among the k nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import col, stored

TREES = 8
SAMPLE = 32_768
SAMPLE_BYTES = 64 << 20
LEAF = 32
PROBES = 64
RECALL = 0.95
GROUP_ROWS = 8192
#: Rows of the sample among which a query's bound is looked for.
BOUND_ROWS = 8192


class Forest:
    """Perfect binary trees in level order: a direction and a threshold for each inner node."""

    def __init__(self, x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 1):
        rng = np.random.default_rng(seed)
        n, dim = x.shape
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))) if n > leaf else 0)
        self.leaves = 1 << self.depth
        self.trees = trees
        self.dirs = np.zeros((trees, self.leaves - 1, dim))
        self.cuts = np.zeros((trees, self.leaves - 1))
        for t in range(trees):
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                order = np.argsort(node, kind="stable")
                at = np.searchsorted(node[order], np.arange((1 << level) + 1))
                new = np.zeros(n, np.int64)
                for k in range(1 << level):
                    rows = order[at[k] : at[k + 1]]
                    d = rng.normal(size=dim)
                    if rows.size > 1:
                        a, b = x[rng.choice(rows, 2, replace=False)]
                        far = np.linalg.norm(a - b)
                        d = d / np.linalg.norm(d) * 0.5 + ((a - b) / far if far > 0 else 0)
                    d /= np.linalg.norm(d) or 1.0
                    p = x[rows] @ d
                    cut = float(np.median(p)) if rows.size else 0.0
                    h = (1 << level) - 1 + k
                    self.dirs[t, h], self.cuts[t, h] = d, cut
                    new[rows] = 2 * k + (p > cut)
                node = new

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), self.trees), np.int64)
        rows = np.arange(len(x))
        for t in range(self.trees):
            margin = x @ self.dirs[t].T - self.cuts[t]
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (margin[rows, node] > 0)
            out[:, t] = node - (self.leaves - 1)
        return out

    def search(self, q: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The first `most` leaves (tree, leaf) in the order of the shared queue."""
        margin = [self.dirs[t] @ q - self.cuts[t] for t in range(self.trees)]
        queue = [(0.0, t, 0) for t in range(self.trees)]
        out: list[tuple[int, int]] = []
        inner = self.leaves - 1
        while queue and len(out) < most:
            far, t, node = heapq.heappop(queue)
            m = margin[t]
            while node < inner:
                v = float(m[node])
                heapq.heappush(queue, (max(far, abs(v)), t, 2 * node + 1 + (v <= 0)))
                node = 2 * node + 1 + (v > 0)
            out.append((t, node - inner))
        return out

    def visited(self, q: np.ndarray, most: int) -> np.ndarray:
        """(tree, leaf): whether the leaf is among the first `most`."""
        out = np.zeros((self.trees, self.leaves), bool)
        for t, leaf in self.search(q, most):
            out[t, leaf] = True
        return out


def _distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = rows - q
    return np.sqrt((d * d).sum(1))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Doubles; the bytes of a vector hold them, or single-precision numbers where those are exact."""
    raw = column.to_pylist()
    kind = np.float32 if raw and len(raw[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(-1, dim)


def valid(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", trees: int = TREES, sample: int = SAMPLE, recall: float = RECALL, visit: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, n_distances: the k nearest found of each query row, nearest first, ties to the smaller id.

    visit: leaves that a query visits at first; by default as many as the probes need for `recall`. Where those hold too
    few rows it goes on until k are sure to be found. n_distances: of how many different vectors the query's distance was computed. Vectors that aren't valid(), rows
    without an id, and vectors of another length than most take no part. Rows that repeat an id and a vector count once.
    Fewer than k candidates: all of them. An empty table, or one without queries, gives no rows; other columns of any
    name are not used.
    """
    spark = df.sparkSession
    as_double = col(vector).cast("array<double>")
    single = "array<float>" in df.select(col(vector)).dtypes[0][1]
    good = df.select(col(vec_id).cast("long").alias("id"), as_double.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & valid(F.col("v")))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_distances long")
    if not sizes:
        return empty
    dim, kind = sizes[0]["d"], np.float32 if single else np.float64
    sample = max(1024, min(sample, SAMPLE_BYTES // (8 * dim)))
    good = good.where(F.size("v") == dim).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    # Classes of equal vectors: the k + 1 smallest distinct ids; repeated rows go first, so that they take no places.
    first = good.select("id", "v").dropDuplicates().withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("at") <= k + 1)
    classes = first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([pa.compute.list_element(b.column(1), 0), pa.array([r.tobytes() for r in flat], pa.binary()), b.column(1)], names=["rep", "x", "ids"])

    import pyarrow.compute  # noqa: F401

    reps = stored(classes.mapInArrow(packed, "rep long, x binary, ids array<long>"), "ann-classes")
    queries = good.where("q").select("id", "v").dropDuplicates()

    def packed_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], names=["query", "x"])

    asked = stored(queries.mapInArrow(packed_queries, "query long, x binary"), "ann-queries")
    n = reps.count()
    if not n:
        return empty
    # A bounded sample: about `sample` rows whose hash is small, cut to exactly that by the driver.
    share = min(1.0, 1.2 * sample / n)
    some = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).toArrow().sort_by("rep")
    if some.num_rows > sample:
        some = some.take(np.sort(np.random.default_rng(0).permutation(some.num_rows)[:sample]))
    x = _vectors(some.column("x"), dim)
    forest = Forest(x, trees)
    part = np.random.default_rng(2).permutation(len(x))[:BOUND_ROWS]
    shared = spark.sparkContext.broadcast((forest, x[part], forest.place(x[part])))

    # Probes: exact neighbours of a few queries, in one pass over all rows.
    probe = asked.orderBy(F.xxhash64("query"), "query").limit(PROBES).toArrow()
    px, pid = _vectors(probe.column("x"), dim), probe.column("query").to_numpy()
    most = min(visit or forest.trees * forest.leaves, forest.trees * forest.leaves)
    if visit is None and len(px) and forest.depth:

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = shared.value[0]
            for b in batches:
                rows, ids = _vectors(b.column(1), dim), b.column(0).to_numpy()
                leaf = f.place(rows)
                for p in range(len(px)):
                    d = _distances(rows, px[p])
                    d[ids == pid[p]] = np.inf
                    best = np.argsort(d, kind="stable")[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), p), pa.int32()), pa.array(ids[best]), pa.array(d[best]), pa.array(leaf[best].tolist(), pa.list_(pa.int64()))], names=["p", "id", "d", "leaf"])

        near = reps.select("rep", "x").mapInArrow(exact, "p int, id long, d double, leaf array<long>")
        near = near.withColumn("at", F.row_number().over(Window.partitionBy("p").orderBy("d", "id"))).where(F.col("at") <= k).where("d < double('infinity')").select("p", "leaf").toArrow().to_pydict()
        met = []
        for p in range(len(px)):
            rank = np.full((forest.trees, forest.leaves), most)
            for r, (t, leaf) in enumerate(forest.search(px[p], most)):
                rank[t, leaf] = r
            met += [int(min(rank[t, leaf] for t, leaf in enumerate(leaves))) for q, leaves in zip(near["p"], near["leaf"], strict=True) if q == p]
        if met:
            most = int(np.quantile(met, recall, method="higher")) + 1
            most = min(forest.trees * forest.leaves, most + max(8, most // 25))
    bits = min(forest.depth, max(0, int(np.ceil(np.log2(max(n, 1) / GROUP_ROWS)))))
    down = forest.depth - bits
    blocks = max(1, int(np.ceil(n / (1 << bits) / GROUP_ROWS / 2)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value[0]
        for b in batches:
            leaf = f.place(_vectors(b.column(1), dim))
            block = b.column(0).to_numpy() * 2654435761 % 4294967296 % blocks
            for t in range(f.trees):
                group = ((t << bits) + (leaf[:, t] >> down)) * blocks + block
                before = pa.array([r.tobytes() for r in leaf[:, : t + 1].astype(np.int32)], pa.binary())  # the leaves in this and the trees before it
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(leaf[:, t]), before, b.column(0), b.column(1), b.column(2)], names=["g", "leaf", "leaves", "rep", "x", "ids"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, rows, places = shared.value
        trees = np.arange(f.trees)
        for b in batches:
            qs = _vectors(b.column(1), dim)
            for q, qid, raw in zip(qs, b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d, want = _distances(rows, q), most
                while True:
                    seen = f.visited(q, want)
                    met = np.sort(d[seen[trees, places].any(1)])
                    if len(met) > k + 1 or want >= f.trees * f.leaves:
                        break
                    want *= 2  # leaves that hold next to nothing of the sample: on, until k are sure to be found
                bound = float(met[k + 1]) * (1 + 1e-9) if len(met) > k + 1 else float("inf")  # k + 2 vectors: one may be the query's own
                groups = [(int(g) * blocks + s) for g in np.unique((np.argwhere(seen) @ [1 << bits, 0]) + (np.nonzero(seen)[1] >> down)) for s in range(blocks)]
                m = len(groups)
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array([np.packbits(seen).tobytes()] * m, pa.binary()), pa.array([qid] * m, pa.int64()), pa.array([raw] * m, pa.binary()), pa.array([bound] * m, pa.float64())], names=["g", "seen", "query", "x", "bound"])

    def meet(rows, asked):
        import pandas as pd

        out = []
        if len(rows) and len(asked):
            rows = rows.sort_values("leaf", kind="stable")
            leaf, rep, ids = rows["leaf"].to_numpy(), rows["rep"].to_numpy(), rows["ids"].tolist()
            x = _vectors(pa.array(rows["x"]), dim)
            places = np.frombuffer(b"".join(rows["leaves"]), np.int32).reshape(len(rows), -1)
            tree = places.shape[1] - 1
            for raw_seen, query, raw, bound in zip(asked["seen"], asked["query"], asked["x"], asked["bound"], strict=True):
                seen = np.unpackbits(np.frombuffer(raw_seen, np.uint8), count=trees * leaves).view(bool).reshape(trees, leaves)
                at = np.flatnonzero(seen[tree, leaf])
                for t in range(tree):  # computed in an earlier tree
                    at = at[~seen[t, places[at, t]]]
                d = _distances(x[at], np.frombuffer(raw, kind).astype(np.float64))
                keep = np.flatnonzero(d <= bound)
                best = keep[np.lexsort((rep[at[keep]], d[keep]))[: k + 1]]
                out += [(query, float(d[i]), len(at) if j == 0 else 0, ids[at[i]]) for j, i in enumerate(best)] or [(query, None, len(at), [])]
        return pd.DataFrame(out, columns=["query", "score", "tried", "ids"])

    leaves = forest.leaves
    rows = reps.mapInArrow(index, "g long, leaf long, leaves binary, rep long, x binary, ids array<long>")
    routed = asked.mapInArrow(route, "g long, seen binary, query long, x binary, bound double")
    found = rows.groupBy("g").cogroup(routed.groupBy("g")).applyInPandas(meet, "query long, score double, tried long, ids array<long>")
    own = Window.partitionBy("query_id")
    pairs = found.withColumnRenamed("query", "query_id").withColumn("n_distances", F.sum("tried").over(own)).select("query_id", "score", "n_distances", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    return pairs.select("query_id", F.row_number().over(own.orderBy("score", "vec_id")).alias("rank"), "vec_id", "score", "n_distances").where(F.col("rank") <= k)
