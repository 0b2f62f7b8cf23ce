"""Shard placement by a permutation-filled lookup table.

Every shard walks its own permutation of the slots ``0 .. size-1`` of a
prime-sized table (an offset and a skip derived from its name).  The shards
take turns; at its turn a shard claims the first slot of its permutation that
is still free.  A key's slot is its hash modulo the table size, so placement is
one lookup.  Shares differ by at most one slot, and removing a shard moves few
keys of the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537     # prime; bounds the broadcast to 65,537 rows of two numbers
N_SHARDS = 256
MAX_TABLE_SIZE = 10_000_019


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n ** 0.5) + 1))


def _walk(name: str, size: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    offset = int.from_bytes(digest[:8], "little") % size
    skip = int.from_bytes(digest[8:16], "little") % (size - 1) + 1
    return offset, skip


def lookup_table(names: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index into ``names``.  ``size`` must be prime and at least ``len(names)``."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given and distinct")
    if not _is_prime(size) or not len(names) <= size <= MAX_TABLE_SIZE:
        raise ValueError(f"table size {size} must be a prime from {len(names)} to {MAX_TABLE_SIZE}")
    walks = [_walk(n, size) for n in names]
    at = [w[0] for w in walks]
    owner = np.full(size, -1, dtype=np.int32)
    filled = 0
    while True:
        for i, (_, skip) in enumerate(walks):
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + skip) % size
            owner[slot] = i
            at[i] = (slot + skip) % size
            filled += 1
            if filled == size:
                return owner


def table_frame(spark: SparkSession, names: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as rows (slot, shard); its size is bounded by ``size``."""
    import pandas as pd
    owner = lookup_table(names, size)
    return spark.createDataFrame(pd.DataFrame({"slot": np.arange(size, dtype=np.int64),
                                               "shard": owner.astype(np.int32)}))


def place(df: DataFrame, key: str, names: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """Add ``slot`` (long) and ``shard`` (int, index into ``names``) by the key's hash.

    The key is hashed as text with the first 60 bits of MD5.  A null key is hashed as the
    empty text.  Repeated keys share a slot.  Input columns named ``slot`` or ``shard``
    are replaced.  An empty table stays empty.  The broadcast table has ``size`` rows
    whatever the input; no row is shuffled, so a hot key costs nothing extra.
    """
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    slot = F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size))
    keyed = df.drop("shard").withColumn("slot", slot)
    return keyed.join(F.broadcast(table_frame(df.sparkSession, names, size)), "slot", "left")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, n_bytes, slot, shard of every document."""
    names = [f"shard-{i:05d}" for i in range(n_shards)]
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return place(sized, "doc_id", names).select("doc_id", "n_bytes", "slot", "shard")
