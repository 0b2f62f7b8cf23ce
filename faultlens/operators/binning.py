"""Features as small integer codes: what the tree engine trains and scores on.

Code 0 is a missing value, code k >= 1 a value between the (k-1)-th and the k-th edge of its feature
(upper edge included).  Edges are the distinct values of a feature with few of them, else exact quantiles of
a bounded sample of the training rows (``EDGE_ROWS``, drawn by the hash of the asset key, so they
depend on neither partitions nor order).  Coded rows are packed into chunks, one row per
``CHUNK_ROWS`` assets, written once and read by every level and round of a fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import schemas as S
from faultlens.session import ship_package
from faultlens.sources.sinks import materialize

EDGE_ROWS = 1 << 17
CHUNK_ROWS = 8192
BATCH_CHUNKS = 16               # chunks that a task's Python gets at once from a large table
TRAIN, JUDGED = 0, 1            # parts of a chunk's rows
CHUNKS = "unit string, n int, keys binary, labels binary, parts binary, codes binary"


@dataclass(frozen=True)
class Bins:
    columns: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    max_bins: int

    @property
    def width(self) -> int:
        """Codes per feature, 0 included."""
        return self.max_bins + 1

    def code(self, values: list[np.ndarray]) -> np.ndarray:
        """[feature, row] codes of the columns' values (NaN: missing)."""
        out = np.zeros((len(self.columns), len(values[0])), np.uint8)
        for f, (v, edges) in enumerate(zip(values, self.edges)):
            known = ~np.isnan(v)
            out[f, known] = 1 + np.searchsorted(np.array(edges), v[known], side="left")
        return out

    def threshold(self, feature: int, code: int) -> float:
        """Largest value that has at most this code."""
        edges = self.edges[feature]
        return float(edges[code - 1]) if code <= len(edges) else float("inf")


def values_of(batch: pa.RecordBatch, columns) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]


def feature_bins(train: DataFrame, columns, max_bins: int, key: str = S.ASSET) -> Bins:
    """Edges of each feature from the training rows (one row per feature reaches the driver)."""
    if not 2 <= max_bins <= 254:
        raise ValueError("max_bins must be in 2..254 (a code is one byte)")
    columns = list(columns)
    n = train.count()
    if n > EDGE_ROWS:
        bucket = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30))
        train = train.filter(bucket < int(EDGE_ROWS / n * (1 << 30)))
    values = train.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("f", "v"))
    probs = [i / max_bins for i in range(1, max_bins)]
    got = values.filter("v IS NOT NULL AND NOT isnan(v)").groupBy("f").agg(
        F.collect_set("v").alias("seen"), F.percentile("v", probs).alias("q")).select(
        "f", F.when(F.size("seen") <= max_bins, F.sort_array("seen")).otherwise(F.col("q")).alias("e"),
        F.array_max("seen").alias("top")).collect()
    edges = {r["f"]: tuple(float(e) for e in np.unique(r["e"]) if e < r["top"]) for r in got}
    return Bins(tuple(columns), tuple(edges.get(i, ()) for i in range(len(columns))), max_bins)


def training_chunks(split: DataFrame, bins: Bins, judged, spread: int, unit: str | None = None,
                    key: str = S.ASSET, label: str = S.LABEL) -> DataFrame:
    """Chunks of the training rows and of those where ``judged`` (a column) holds, written once.

    ``unit`` names the column that tells several training tables apart; each chunk belongs to one.
    """
    ship_package(split.sparkSession)
    part = F.when(judged, F.lit(JUDGED)).when(training_rows(split), F.lit(TRAIN))
    rows = split.select((F.col(unit) if unit else F.lit("")).cast("string").alias("unit"), F.xxhash64(key).alias("key"),
                        F.col(label).cast("int").alias("label"), part.alias("part"),
                        *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(bins.columns)]).filter("part IS NOT NULL")
    if unit:
        rows = rows.repartition(max(spread, rows.sparkSession.sparkContext.defaultParallelism), "unit",
                                F.pmod("key", F.lit(spread))).sortWithinPartitions("unit")
    # Chunks are dealt to all cores: the rows' own partitions may be fewer than these, and uneven.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return materialize(rows.mapInArrow(_pack_training(bins), CHUNKS).repartition(max(spread, cores)), "model/chunks")


@contextmanager
def chunk_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs of the block read and cache chunks ``BATCH_CHUNKS`` at a time.  (By default a batch is thousands of rows, here a
    task's whole share of the table.)"""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.inMemoryColumnarStorage.batchSize")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, str(BATCH_CHUNKS))
    try:
        yield
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def training_rows(split: DataFrame):
    """Column: rows that trees are grown from."""
    train = ~F.col("holdout")
    return train & ~F.col("validation") if "validation" in split.columns else train


def _pack_training(bins: Bins):
    names = [f"f{i}" for i in range(len(bins.columns))]

    def chunk(unit, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        labels = t.column("label")
        if labels.null_count:
            raise ValueError("training rows without a label")
        one = [unit, t.num_rows, t.column("key").to_numpy().astype(np.int64).tobytes(),
               labels.to_numpy().astype(np.uint8).tobytes(), t.column("part").to_numpy().astype(np.uint8).tobytes(),
               bins.code(values_of(t, names)).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], ty) for x, ty in zip(one, (
            pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))],
            names=["unit", "n", "keys", "labels", "parts", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, n = None, [], 0
        for batch in batches:
            units = np.array(batch.column("unit").to_pylist(), dtype=object)
            at = 0
            while at < len(units):
                if n and (units[at] != unit or n == CHUNK_ROWS):
                    yield chunk(unit, held)
                    held, n = [], 0
                unit = units[at]
                same = units[at:at + CHUNK_ROWS - n] == unit
                take = len(same) if same.all() else int(np.argmin(same))
                held.append(batch.slice(at, take))
                n += take
                at += take
        if n:
            yield chunk(unit, held)
    return run


def packed_rows(df: DataFrame, bins: Bins, keep, model=None) -> DataFrame:
    """Any rows as chunks (model, chunk, n, codes, kept): ``kept`` holds the columns ``keep`` as Arrow
    data.  Written once, so that a row keeps its place in its chunk whatever is run again.  ``model``
    is a column with the number of the model that is to see the row (default 0)."""
    ship_package(df.sparkSession)
    number = (model if model is not None else F.lit(0)).cast("int").alias("_model")
    rows = df.select(number, *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(bins.columns)], *keep)
    if model is not None:
        rows = rows.sortWithinPartitions("_model")
    return materialize(rows.mapInArrow(_pack_rows(bins, len(list(keep))), "model int, chunk long, n int, codes binary, kept binary"),
                       "model/rows")


def _pack_rows(bins: Bins, n_kept: int):
    features = [f"_f{i}" for i in range(len(bins.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, i = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            models = batch.column("_model").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(models)) + 1).tolist(), len(models)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                for at in range(a, b, CHUNK_ROWS):
                    part = batch.slice(at, min(CHUNK_ROWS, b - at))
                    kept = part.select(range(1 + len(features), 1 + len(features) + n_kept))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, kept.schema) as out:
                        out.write_batch(kept)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(models[at])], pa.int32()), pa.array([base + i], pa.int64()),
                         pa.array([part.num_rows], pa.int32()), pa.array([bins.code(values_of(part, features)).tobytes()], pa.binary()),
                         pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["model", "chunk", "n", "codes", "kept"])
                    i += 1
    return run


def unpack(kept: bytes) -> pa.Table:
    return pa.ipc.open_stream(kept).read_all()
