"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark item is the set of its windows (``window`` consecutive words; a
shorter item is one window).  A window can only occur in a document that holds
every shingle (``shingle`` consecutive words) of it, so for containment 1 the
necessary prefix of its rarity-ordered shingle list is one token: the rarest.
Rarity is the number of occurrences over all documents.  Document shingles are
joined with these prefix tokens; the shingle's offset in the window fixes where the
window would start (positional bound), the document must have room for it
(length bound), and the words are then compared one by one.

The benchmark side is broadcast in blocks of bounded size; a larger benchmark
takes more blocks, each against all documents.  Documents are never shuffled for the
search itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import session, stored, tidy

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 16 << 20      # item text per broadcast block
OUT_ROWS = 2_000

# Fixed value: a word is a run of a-z, 0-9 (after lower-casing A-Z) and bytes above 127.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The text's words as UTF-8 bytes; none for null."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


class Block:
    """Windows of some items, with everything that the search over a document needs.

    ``vocab``: word -> number from 1 (0: a word of no item).  ``windows``: distinct windows as
    word numbers; ``items``: the item indexes of each window.
    """

    def __init__(self, rows: list[tuple[int | None, str | None]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        seen: dict[tuple[int, ...], set[int]] = {}
        for item_id, text in rows:
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words(text)]
            if w:
                self.ids.append(item_id)
                for i in range(max(1, len(w) - window + 1)):
                    seen.setdefault(tuple(w[i:i + window]), set()).add(len(self.ids) - 1)
        self.windows = list(seen)
        self.items = [sorted(seen[w]) for w in self.windows]
        self.base = np.uint64(len(self.vocab) + 1)
        self.shingle = shingle
        # Item words shorter than a shingle are looked up by shingles of their own length.
        self.codes = {n: np.unique(np.array([c for w in self.windows if min(shingle, len(w)) == n
                                             for c in self._codes_of(w, n)], dtype=np.uint64))
                      for n in sorted({min(shingle, len(w)) for w in self.windows})}

    def _codes_of(self, w: tuple[int, ...], n: int) -> list[int]:
        base, out = int(self.base), []
        for i in range(len(w) - n + 1):
            c = 0
            for x in w[i:i + n]:
                c = (c * base + x) & 0xFFFFFFFFFFFFFFFF
            out.append(c)
        return out

    def numbers(self, text: str | None) -> np.ndarray:
        known = self.vocab.get
        return np.array([known(w, 0) for w in words(text)], dtype=np.uint64)

    def doc_codes(self, num: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and codes of the shingles of ``n`` words all of which are item words."""
        m = len(num) - n + 1
        if m <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        code, known = num[:m].copy(), num[:m] > 0
        for k in range(1, n):
            code *= self.base
            code += num[k:k + m]
            known &= num[k:k + m] > 0
        at = np.flatnonzero(known)
        return at, code[at]

    def count(self, num: np.ndarray, counts: dict[int, np.ndarray]) -> None:
        """Add the document's occurrences of the item shingles to ``counts``."""
        for n, codes in self.codes.items():
            _, code = self.doc_codes(num, n)
            at = np.searchsorted(codes, code)
            at[at == len(codes)] = 0
            counts[n] += np.bincount(at[codes[at] == code], minlength=len(codes))

    def index(self, counts: dict[int, np.ndarray]) -> None:
        """Keep, for every window, its rarest shingle (ties: the first) as the prefix token."""
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for k, w in enumerate(self.windows):
            n = min(self.shingle, len(w))
            codes = self._codes_of(w, n)
            at = np.searchsorted(self.codes[n], np.array(codes, dtype=np.uint64))
            offset = int(np.argmin(counts[n][at]))
            rows.setdefault(n, []).append((codes[offset], k, offset))
        for n, r in rows.items():
            r.sort()
            self.prefix[n] = (np.array([x[0] for x in r], dtype=np.uint64),
                              np.array([x[1] for x in r], dtype=np.int64),
                              np.array([x[2] for x in r], dtype=np.int64))
        self.table = np.array([w + (0,) * (max(map(len, self.windows)) - len(w)) for w in self.windows],
                              dtype=np.uint64) if self.windows else np.empty((0, 0), np.uint64)
        self.sizes = np.array([len(w) for w in self.windows], dtype=np.int64)

    def find(self, num: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every window occurrence in a document."""
        starts, found = [], []
        for n, (codes, window, offset) in self.prefix.items():
            at, code = self.doc_codes(num, n)
            lo, hi = np.searchsorted(codes, code, "left"), np.searchsorted(codes, code, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            reps = (hi - lo)[hit]
            row = np.repeat(lo[hit], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            k = window[row]
            start = np.repeat(at[hit], reps) - offset[row]
            fits = (start >= 0) & (start + self.sizes[k] <= len(num))
            start, k = start[fits], k[fits]
            same = np.ones(len(k), dtype=bool)
            for i in range(self.table.shape[1]):
                live = np.flatnonzero(same & (self.sizes[k] > i))
                same[live] = num[start[live] + i] == self.table[k[live], i]
            starts.append(start[same])
            found.append(k[same])
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(starts), np.concatenate(found)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """Items in blocks of bounded text size, streamed through the driver one block at a time."""
    block: list[tuple[int | None, str | None]] = []
    size = 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        block.append((item_id, text))
        size += len((text or "").encode()) + 16
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _shingle_counts(docs: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """Occurrences of the block's shingles over all documents (one array per shingle length)."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        counts = {n: np.zeros(len(c), dtype=np.int64) for n, c in b.codes.items()}
        for batch in batches:
            for text in batch.column(0):
                b.count(b.numbers(text.as_py()), counts)
        for n, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n), pa.int32()), pa.array(at, pa.int32()),
                                              pa.array(c[at], pa.int64())], names=["n", "at", "c"])

    rows = (docs.select("doc.text").mapInArrow(tidy(run), "n int, at int, c long")
            .groupBy("n", "at").agg(F.sum("c").alias("c")).collect())    # at most one row per item shingle
    shared.unpersist()
    counts = {n: np.zeros(len(c), dtype=np.int64) for n, c in block.codes.items()}
    for n, at, c in rows:
        counts[n][at] = c
    return counts


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc (struct of the input row), n_words, spans (array of [begin, end) word ranges that item
    windows cover, merged and in order) and item_ids (distinct ids of the items with an occurring window).

    One output row per input row, repeated rows and null doc_ids included; extra columns stay
    inside ``doc`` whatever their names.  A null or empty text has no words and no spans.  Items
    without words have no windows; the windows of an item with a null id count as hits, its id is
    not listed.  Repeated items count once.  An empty benchmark hits nothing, an empty table gives
    an empty result.
    """
    spark = session(docs)
    packed = docs.select(F.struct("*").alias("doc"))
    parts: list[DataFrame] = []
    blocks = _blocks(benchmark, block_bytes)
    block = next(blocks, [])
    while True:
        later = next(blocks, None)
        only = later is None and not parts
        if not only and not parts:      # several blocks: rows need a key to be brought together again
            packed, _ = stored(packed.withColumn("row", F.monotonically_increasing_id()), "decontaminate_docs")
        b = Block(block, window, shingle)
        b.index(_shingle_counts(packed, b) if b.windows else {})
        whole = T.StructType([packed.schema["doc"], *T.StructType.fromDDL(
            "n_words long, spans array<struct<begin:int,end:int>>, item_ids array<string>").fields])
        parts.append(packed.mapInArrow(tidy(_searcher(spark.sparkContext.broadcast(b), only)),
                                       whole if only else "row long, n_words long, begin int, end int, item_id string"))
        if later is None:
            break
        block = later
    return parts[0] if len(parts) == 1 else _merged(packed, parts)


def _searcher(shared, whole: bool):
    """Per document: its merged spans and items (``whole``), or one row per span and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(lo, OUT_ROWS)
                found = [_hits(b, t) for t in part.column(0).field("text").to_pylist()]
                yield (_as_rows if whole else _as_parts)(part, found)

    return run


def _hits(b: Block, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
    num = b.numbers(text)
    start, k = b.find(num)
    if not len(start):
        return len(num), [], []
    mark = np.zeros(len(num) + 1, dtype=np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + b.sizes[k], -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(mark) > 0]).astype(np.int8)))
    items = {b.ids[i] for w in np.unique(k) for i in b.items[w]} - {None}
    return len(num), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), sorted(map(str, items))


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _as_rows(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
    spans = [[{"begin": a, "end": e} for a, e in f[1]] for f in found]
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array(spans, _SPANS),
         pa.array([f[2] for f in found], pa.list_(pa.string()))], names=["doc", "n_words", "spans", "item_ids"])


def _as_parts(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
    rows = part.column(1).to_pylist()
    out = []
    for row, (n, spans, items) in zip(rows, found, strict=True):
        out.append((row, n, None, None, None))
        out += [(row, n, a, e, None) for a, e in spans]
        out += [(row, n, None, None, i) for i in items]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    cols = list(zip(*out, strict=True)) if out else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                      names=["row", "n_words", "begin", "end", "item_id"])


def _merged(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Bring the blocks' spans and items of each document together; overlapping spans are merged."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    span = F.when(F.col("begin").isNotNull(), F.struct("begin", "end"))
    per = union.groupBy("row").agg(F.max("n_words").alias("n_words"),
                                   F.array_sort(F.collect_set(span)).alias("raw"),
                                   F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    merge = F.aggregate(
        "raw", F.array().cast("array<struct<begin:int,end:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["begin"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                                  F.element_at(acc, -1)["begin"].alias("begin"),
                                  F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))
    return docs.join(per, "row").select("doc", "n_words", merge.alias("spans"), "item_ids")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit word, with their own columns."""
    return find_benchmark(docs, benchmark, **options).where(F.size("spans") == 0).select("doc.*")
