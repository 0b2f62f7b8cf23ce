"""SimHash near-duplicates through vantage-point trees over the fingerprints.

1. Every document gets a 64-bit fingerprint: the bitwise majority of the hashes of its word
   shingles.  Equal fingerprints are one class from here on.
2. A routing tree is built on a bounded sample of classes: each node has a vantage
   fingerprint and a radius; classes within the radius go inside, the others outside.  The
   tree's leaves are the shards.  Every class has one home leaf, and is also sent as a query
   to each leaf that its ball of ``max_bits`` reaches (triangle bounds), so that pairs across
   a boundary are found at the home of one of the two.
3. A shard holds its own vantage-point tree over its home classes, and all its queries
   go down it together; branches out of reach are pruned.  Only a spanning forest of the
   pairs found leaves the shard, never all pairs of a group.
4. Connected components over the forests' edges give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import discard, session, stored, tidy
from faultlens.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
SAMPLE = 262_144            # classes that shape the routing tree; bounds what the driver holds
SHARD_ROWS = 32_768         # home classes a shard holds at most, about
MIN_SAMPLE_LEAF = 16        # but at least so many of the sample
HOT_ROWS, MAX_HOT = 1_000, 10_000   # rows from which a fingerprint is joined by broadcast; fingerprints that can be so large
LEAF_ROWS = 64
PENDING = 1 << 21           # links kept in memory before they are merged


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words."""
    w = text.encode().lower().split() if text else []     # bytes: A-Z only, ASCII white space only
    if not w:
        return 0
    if len(w) < shingle:
        parts = [b" ".join(w)]
    else:
        parts = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    h = np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo:lo + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64) \
            .sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The frame's columns other than ``text``, and ``fp`` (the fingerprint as a signed long)."""
    session(docs)
    others = [c for c in docs.columns if c not in ("text", "fp")]
    rows = docs.select(F.col("text").cast("string"), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(0)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), *batch.columns[1:]],
                                             names=["fp", *others])

    return rows.mapInArrow(tidy(run), rows.select(F.lit(0).cast("long").alias("fp"), *others).schema)


def _distance(f: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(f ^ v).astype(np.int16)


class Router:
    """Vantage-point tree over a sample; its leaves number the shards.

    A node's radius is the one with the fewest sample rows within reach of it, among those that leave at
    least a quarter on each side.  A side is split on until it holds at most ``leaf_rows`` of the sample.
    """

    def __init__(self, sample: np.ndarray, leaf_rows: float, reach: int = MAX_BITS):
        self.nodes: list[tuple[int, int, int, int]] = []    # vantage, radius, inside, outside; a leaf is ~number
        self.leaves, self.reach = 0, reach
        self.root = self._grow(np.unique(sample), max(MIN_SAMPLE_LEAF, leaf_rows), np.random.default_rng(11))

    def _grow(self, f: np.ndarray, leaf_rows: float, rng: np.random.Generator) -> int:
        if len(f) > leaf_rows:
            v = f[rng.integers(len(f))]
            d = _distance(f, v)
            radius = self._radius(d)
            at = len(self.nodes)
            self.nodes.append((0, 0, 0, 0))
            self.nodes[at] = (int(v), radius, self._grow(f[d <= radius], leaf_rows, rng),
                              self._grow(f[d > radius], leaf_rows, rng))
            return at
        self.leaves += 1
        return ~(self.leaves - 1)

    def _radius(self, d: np.ndarray) -> int:
        """The vantage itself is inside, the farthest outside."""
        low, mid, high = (int(x) for x in np.quantile(d, [0.25, 0.5, 0.75]))
        count = np.bincount(d, minlength=65 + self.reach)
        below = np.cumsum(count)
        span = range(max(low, 0), min(high, int(d.max()) - 1) + 1)
        near = {r: int(below[r + self.reach] - (below[r - self.reach] if r >= self.reach else 0)) for r in span}
        return min(near, key=lambda r: (near[r], abs(r - mid))) if near else int(d.max()) - 1

    def route(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): each row's home leaf, and leaves to which it goes as a query.

        Of two rows within reach that part at a node, the inner one goes outside as a query, and
        follows there wherever the other may be; the outer one stays, so each pair meets once.
        """
        rows, leaves, homes = [], [], []
        stack = [(self.root, np.arange(len(f)), True)]
        while stack:
            at, part, home = stack.pop()
            if not len(part):
                continue
            if at < 0:
                rows.append(part)
                leaves.append(np.full(len(part), ~at, dtype=np.int32))
                homes.append(np.full(len(part), home))
                continue
            v, radius, inside, outside = self.nodes[at]
            d = _distance(f[part], np.uint64(v))
            if home:
                stack += [(inside, part[d <= radius], True), (outside, part[d > radius], True),
                          (outside, part[(d <= radius) & (d + self.reach > radius)], False)]
            else:
                stack += [(inside, part[d - self.reach <= radius], False), (outside, part[d + self.reach > radius], False)]
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


class Forest:
    """Spanning forest of links between 0..n-1; memory stays at O(n) however many links come."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.pending.append((a, b))
        self.held += len(a)
        if self.held >= PENDING:
            self.merge()

    def merge(self) -> None:
        if not self.pending:
            return
        a, b = (np.concatenate(x) for x in zip(*self.pending, strict=True))
        self.pending, self.held, lab = [], 0, self.label
        while True:
            la, lb = lab[a], lab[b]
            differ = la != lb
            if not differ.any():
                break
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = lab[lab]
                if np.array_equal(up, lab):
                    break
                lab = up
        self.label = lab


def link(f: np.ndarray, home: np.ndarray, query: np.ndarray, max_bits: int) -> np.ndarray:
    """Labels that join every query with the home rows within ``max_bits`` of it."""
    forest, rng = Forest(len(f)), np.random.default_rng(13)
    stack = [(home, query)]
    while stack:
        p, q = stack.pop()
        if len(p) <= LEAF_ROWS:
            for lo in range(0, len(q), 1 << 14):
                part = q[lo:lo + (1 << 14)]
                a, b = np.nonzero(np.bitwise_count(f[part][:, None] ^ f[p][None, :]) <= max_bits)
                keep = part[a] != p[b]
                forest.add(part[a][keep], p[b][keep])
            continue
        v = f[p[rng.integers(len(p))]]
        dp, dq = _distance(f[p], v), _distance(f[q], v)
        if dp.max() == 0:       # equal fingerprints only
            near = q[dq <= max_bits]
            forest.add(p[1:], np.full(len(p) - 1, p[0]))
            forest.add(near, np.full(len(near), p[0]))
            continue
        radius = min(int(np.median(dp)), int(dp.max()) - 1)
        for sub, reach in ((p[dp <= radius], q[dq - max_bits <= radius]), (p[dp > radius], q[dq + max_bits > radius])):
            if len(sub) and len(reach):
                stack.append((sub, reach))
    forest.merge()
    return forest.label


def _shard_links(max_bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf["fp"].to_numpy().view(np.uint64)
        home = np.flatnonzero(pdf["home"].to_numpy())
        label = link(f, home, np.arange(len(f)), max_bits)
        other = np.flatnonzero(label != np.arange(len(f)))
        signed = f.view(np.int64)
        return pd.DataFrame({"a": signed[other], "b": signed[label[other]]})

    return run


def link_classes(classes: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS,
                 sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) between fingerprints of ``classes`` (one row per distinct ``fp``) whose
    connected components are those of all pairs within ``max_bits``."""
    spark = session(classes)
    n = classes.count()
    draw = F.pmod(F.xxhash64(F.lit("simhash"), "fp"), F.lit(1 << 30))
    share = min(1.0, sample / max(1, n))
    some = classes.where(draw < F.lit(int(share * (1 << 30)))).select("fp").limit(2 * sample)
    drawn = np.array([r[0] for r in some.collect()], dtype=np.int64).view(np.uint64)
    router = Router(drawn, shard_rows * len(drawn) / max(1, n), max_bits)
    shared = spark.sparkContext.broadcast(router)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            row, leaf, home = r.route(f)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(f[row].view(np.int64)), pa.array(home)],
                                             names=["leaf", "fp", "home"])

    return (classes.select("fp").mapInArrow(spread, "leaf int, fp long, home boolean")
            .groupBy("leaf").applyInPandas(_shard_links(max_bits), "a long, b long"))


def group_near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of the fingerprint group), plus any other column of
    ``docs`` but ``text``: one row per input row.

    A null or blank text has fingerprint 0 and is linked like any other.  Null doc_ids get a
    component like others, but never name one; a group of null doc_ids only has a null
    component_id.  Repeated rows and ids are allowed.  An empty table gives an empty result.
    Input columns named ``fp`` or ``component_id`` are replaced.
    """
    spark = session(docs)
    marked, _ = stored(fingerprints(docs.drop("component_id"), shingle), "simhash_docs")
    classes, class_path = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")),
                                 "simhash_classes")
    groups, group_path = connected_components(link_classes(classes, max_bits))
    named = classes.join(groups, classes["fp"] == groups["node"], "left") \
        .select("fp", "least", "copies", F.coalesce("component", "fp").alias("component"))
    named, named_path = stored(named, "simhash_named")
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    lowest, lowest_path = stored(lowest, "simhash_lowest")
    table, _ = stored(named.join(lowest, "component").select("fp", "component_id", "copies"), "simhash_table")
    discard(spark, class_path, group_path, named_path, lowest_path)
    # Fingerprints of many copies, at most MAX_HOT by their least number, meet their rows without a shuffle.
    total = table.agg(F.sum("copies")).first()[0] or 0
    many = F.col("copies") > max(HOT_ROWS, total // MAX_HOT)
    hot = F.broadcast(table.where(many).drop("copies"))
    rest = marked.join(F.broadcast(table.where(many).select("fp")), "fp", "left_anti")
    columns = [*marked.columns, "component_id"]
    return marked.join(hot, "fp").select(columns).unionByName(
        rest.join(table.where(~many).drop("copies"), "fp").select(columns))


def one_per_group(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each near-duplicate group, with its own columns: the one with the
    smallest doc_id (null last), of repeated ids the one with the smallest row hash."""
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    grouped = group_near_duplicates(docs.select("doc_id", "text", row_hash.alias("row_hash")), shingle, max_bits)
    # Repeated rows collapse first; groups without any id are told apart by their fingerprints.
    rows = grouped.groupBy("doc_id", "row_hash", "component_id", "fp").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("odd"), "doc_id", "row_hash", "copies")).alias("first")
    keep = (rows.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own")).agg(first)
            .select(F.col("first.doc_id").alias("keep_id"), F.col("first.row_hash").alias("keep_hash"),
                    F.col("first.copies").alias("keep_copies")))
    keep, _ = stored(keep, "simhash_keep")
    packed = docs.select(F.struct("*").alias("doc"), row_hash.alias("row_hash"))
    same = packed["doc.doc_id"].eqNullSafe(keep["keep_id"]) & (packed["row_hash"] == keep["keep_hash"])
    kept = packed.join(keep, same)
    if keep.where("keep_copies > 1").isEmpty():
        return kept.select("doc.*")
    again = packed.join(keep.where("keep_copies > 1"), same).dropDuplicates(["keep_id", "keep_hash"])
    return kept.where("keep_copies = 1").select("doc.*").unionByName(again.select("doc.*"))
