"""Approximate nearest neighbours by a forest of random-projection trees.

Every tree splits the space by hyperplanes between two drawn centres, at the median of a
bounded sample, down to leaves.  ALL rows are then placed in a leaf of every tree.  A
query opens the trees through one shared priority queue, ordered by the smallest
distance to a hyperplane on the way (an unopened leaf of any tree competes with all
others), until its budget of leaves is used.  The rows of these leaves are its
candidates, and their exact distances decide.

Queries come in blocks of bounded size; every block is broadcast with the leaves it opens, and
every partition of rows returns its own ``k`` best per query.  Rows are never shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import discard, session, stored

TREES = 32
SAMPLE = 32_768             # rows that shape the trees; bounds what the driver holds
LEAF_ROWS = 150             # rows a leaf aims at
MIN_SAMPLE_LEAF = 16
SEARCH_SHARE = 0.022        # share of all leaves that a query opens ...
MIN_LEAVES = 128            # ... but at least so many
BLOCK_QUERIES = 8_192
K = 10


class Tree:
    """Hyperplanes in heap order: node i has the children 2i and 2i + 1, and node 1 is the root."""

    def __init__(self, x: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        size = 1 << depth
        self.normal = np.zeros((size, x.shape[1]), dtype=np.float32)
        self.cut = np.full(size, np.inf, dtype=np.float32)      # unused nodes send everything left
        self.open = np.zeros(size, dtype=bool)
        stack = [(1, np.arange(len(x)))]
        while stack:
            node, part = stack.pop()
            if node >= size or len(part) < 2 * MIN_SAMPLE_LEAF:
                continue
            normal = self._normal(x, part, rng)
            if normal is None:
                continue
            at = x[part] @ normal
            cut = np.median(at)
            left = at <= cut
            if left.all():
                left = at < cut
                cut = at[left].max() if left.any() else cut
                if not left.any():
                    continue
            self.normal[node], self.cut[node], self.open[node] = normal, cut, True
            stack += [(2 * node, part[left]), (2 * node + 1, part[~left])]

    @staticmethod
    def _normal(x: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
        a, b = x[rng.choice(part, 2, replace=False)]
        for _ in range(4):      # a few steps towards the centres of two halves
            some = x[rng.choice(part, min(64, len(part)), replace=False)]
            nearer = ((some - a) ** 2).sum(axis=1) < ((some - b) ** 2).sum(axis=1)
            a = some[nearer].mean(axis=0) if nearer.any() else a
            b = some[~nearer].mean(axis=0) if not nearer.all() else b
        w = (a - b).astype(np.float32)
        length = float(np.linalg.norm(w))
        return w / np.float32(length) if length > 0 else None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row: the number of its last place in heap order, at full depth."""
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", x, self.normal[node]) > self.cut[node]
            node = 2 * node + right
        return (node - (1 << self.depth)).astype(np.int32)


class Forest:
    def __init__(self, x: np.ndarray, depth: int, trees: int = TREES, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.trees = [Tree(x, depth, rng) for _ in range(trees)]
        self.depth = depth

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree (rows x trees)."""
        return np.stack([t.leaves(x) for t in self.trees], axis=1)

    def search(self, q: np.ndarray, budget: int) -> np.ndarray:
        """Leaves to open for one query, as tree * 2^depth + leaf, best first."""
        size = 1 << self.depth
        side = [t.normal @ q - t.cut for t in self.trees]
        usable = [t.open for t in self.trees]
        queue = [(-np.inf, t, 1) for t in range(len(self.trees))]
        out: list[int] = []
        while queue and len(out) < budget:
            far, t, node = heapq.heappop(queue)
            while node < size and usable[t][node]:
                s = float(side[t][node])
                heapq.heappush(queue, (max(far, abs(s)), t, 2 * node + (s <= 0)))     # the other side, later
                node = 2 * node + (s > 0)
            while node < size:      # closed early: everything went left
                node *= 2
            out.append(t * size + node - size)
        return np.array(out, dtype=np.int64)


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.cast(pa.list_(pa.float64()))
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def build_forest(rows: DataFrame, n: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
                 sample: int = SAMPLE) -> Forest:
    """A forest shaped by about ``sample`` of the ``n`` rows (vec_id, v), chosen by hash."""
    draw = F.pmod(F.xxhash64(F.lit("neighbours"), "vec_id"), F.lit(1 << 30))
    share = min(1.0, sample / max(1, n))
    some = rows.where(draw < F.lit(int(share * (1 << 30)))).select("vec_id", "v").limit(2 * sample).toArrow()
    some = some.combine_chunks()
    x = _matrix(some.column("v").combine_chunks())
    x = x[np.lexsort([*x.T[::-1], some.column("vec_id").to_numpy()])].astype(np.float32)
    depth = max(0, int(np.round(np.log2(max(1, n) / leaf_rows))))
    depth = min(depth, max(0, int(np.log2(max(1, len(x)) / MIN_SAMPLE_LEAF))))
    return Forest(x, depth, trees)


def _probe(forest, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for batch in batches:
            x = _matrix(batch.column(1)).astype(np.float32) if batch.num_rows else np.empty((0, 0))
            leaves = [f.search(q, budget) for q in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaves, pa.list_(pa.int64()))],
                                             names=["query_id", "v", "leaves"])

    return run


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest different ids among the candidates: smallest distance first, then smallest id."""
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    keep = ids != own
    d, ids = d[keep], ids[keep]
    if len(d) > 4 * k:      # every tie with the k-th smallest distance stays (repeated ids count once: widen if need be)
        m = k
        while True:
            edge = np.partition(d, min(m, len(d)) - 1)[min(m, len(d)) - 1]
            near = d <= edge
            if m >= len(d) or len(np.unique(ids[near])) >= k:
                break
            m *= 2
        d, ids = d[near], ids[near]
    order = np.lexsort((ids, d))
    d, ids = d[order], ids[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], d[first]


def _scan(forest, block, k: int):
    """Per partition: place its rows, gather each query's candidates, keep the k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, (query_ids, queries, opened) = forest.value, block.value
        size, names = 1 << f.depth, ["query_id", "vec_id", "score"]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            code = (f.place(x.astype(np.float32)).astype(np.int64) + np.arange(len(f.trees)) * size).ravel()
            order = np.argsort(code, kind="stable")
            begin = np.searchsorted(code[order], np.arange(len(f.trees) * size + 1))
            row = order // len(f.trees)
            q_out, v_out, s_out = [], [], []
            mark = np.zeros(len(ids), dtype=bool)
            for own, q, leaves in zip(query_ids, queries, opened, strict=True):
                lo, n = begin[leaves], begin[leaves + 1] - begin[leaves]
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                mark[row[at]] = True
                some = np.flatnonzero(mark)
                mark[some] = False
                if len(some):
                    found, score = _nearest(x[some], ids[some], q, own, k)
                    q_out.append(np.full(len(found), own))
                    v_out.append(found)
                    s_out.append(score)
            if q_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q_out), pa.int64()),
                                                  pa.array(np.concatenate(v_out), pa.int64()),
                                                  pa.array(np.concatenate(s_out), pa.float64())], names=names)

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
            search_share: float = SEARCH_SHARE, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows found for every query.

    ``rows`` and ``queries`` hold vec_id and embedding.  The measure is the Euclidean distance in
    double precision on the original vectors; ties go to the smaller vec_id; rows with the query's
    own vec_id are no candidates.  Vectors that are null, zero, or hold a null or non-finite
    component take no part, nor do null vec_ids.  Vectors are compared with those of their own
    length, by one search for each length.  A repeated vec_id is listed once, at its nearest
    vector; a repeated query counts once, with its smallest vector of the length most frequent in
    ``rows`` (of equally frequent ones the shorter).  Fewer candidates than ``k`` give fewer rows;
    no rows or no queries give none.  Other columns are not read.
    """
    spark = session(rows)
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"),
                                 F.col("embedding").cast("array<double>").alias("v")) \
        .where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows, queries = clean(rows), clean(queries)
    counts = {r["size"]: r["count"] for r in rows.groupBy(F.size("v").alias("size")).count().collect()}
    sizes = sorted(counts, key=lambda s: (-counts[s], s))
    queries = queries.where(F.size("v").isin(sizes))
    if len(sizes) > 1:
        place = F.array_position(F.array(*[F.lit(s) for s in sizes]), F.size("v"))
        queries = queries.groupBy("vec_id").agg(F.min(F.struct(place.alias("place"), "v")).alias("first")).select("vec_id", "first.v")
        asked = {r["size"] for r in queries.select(F.size("v").alias("size")).distinct().collect()}
        sizes = [s for s in sizes if s in asked]
    else:
        queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    parts = []
    for s in sizes:
        of_size = F.size("v") == s
        parts += _found(rows.where(of_size), counts[s], queries.where(of_size), k, trees, leaf_rows, search_share, block_queries)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(*parts)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _found(rows: DataFrame, n: int, queries: DataFrame, k: int, trees: int, leaf_rows: int, search_share: float,
           block_queries: int) -> list[str]:
    """Paths of the tables of candidates of ``queries`` among the ``n`` rows, all vectors of one length."""
    spark = rows.sparkSession
    f = build_forest(rows, n, trees, leaf_rows)
    budget = max(MIN_LEAVES, int(np.ceil(search_share * trees * (1 << f.depth))))
    forest = spark.sparkContext.broadcast(f)
    probed, probed_path = stored(queries.select("vec_id", "v").mapInArrow(
        _probe(forest, budget), "query_id long, v array<double>, leaves array<long>"), "ann_queries")
    parts = []
    for block in _blocks(probed, block_queries):
        found = rows.select("vec_id", "v").mapInArrow(_scan(forest, spark.sparkContext.broadcast(block), k),
                                                      "query_id long, vec_id long, score double")
        parts.append(stored(found, "ann_found")[1])
    discard(spark, probed_path)
    return parts


def _blocks(probed: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Query ids, vectors and opened leaves, at most ``size`` queries at a time."""
    ids, v, leaves = [], [], []
    for r in probed.toLocalIterator():
        ids.append(r["query_id"])
        v.append(np.array(r["v"]))
        leaves.append(np.array(r["leaves"], dtype=np.int64))
        if len(ids) >= size:
            yield np.array(ids), np.array(v), leaves
            ids, v, leaves = [], [], []
    if ids:
        yield np.array(ids), np.array(v), leaves
