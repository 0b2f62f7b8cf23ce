"""Filter interaction audit: what each filter removes in every order of the filters.

A document's measures come from one pass of a table-driven transducer over its UTF-8 bytes: a
byte's class (word byte, capital, first byte of a code point, symbol) drives a two-state machine
(outside or inside a word) that counts words, capitals, code points and symbols and emits the
word spans.  Spans go into an open-addressed hash table per document whose hits are verified
byte by byte, so the number of distinct words is exact.  The pass works on the byte buffers of
whole Arrow batches in windows of bounded size that end outside words.

The filters are judged once per document; every order follows from the counts per set of
failed filters (at most 32 per part), so the work over the documents does not depend on the
number of orders.  Copies of a text collapse in partial aggregates before they are compared.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import session, stored, tidy

# The filters in the order of their bits, and their thresholds.
FILTERS = "ABCDE"
MIN_WORDS = 50                  # A: fewer words
DISTINCT_PERCENT = 65           # B: a smaller share of distinct words
CAPITAL_PERCENT = 5             # C: a larger share of capitals
SYMBOLS = b"#$%&*|"             # D: any of these
# Bytes that separate words (space, and tab to carriage return).
SPACES = b" \t\n\v\f\r"

WORD, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8
CLASSES = np.array([(WORD if b not in SPACES else 0) | (CAPITAL if 0x41 <= b <= 0x5A else 0)
                    | (POINT if b & 0xC0 != 0x80 else 0) | (SYMBOL if b in SYMBOLS else 0)
                    for b in range(256)], dtype=np.uint8)
WINDOW = 1 << 19                # bytes per pass of the transducer
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that its powers can be divided out modulo 2^64
_MIX = np.uint64(0xBF58476D1CE4E5B9)
MEASURED = "doc_id {}, part string, digest binary, mask int"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Transducer:
    """Counts per document of a buffer of concatenated texts."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.up = self.down = np.empty(0, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.up) < n + 1:
            self.up = _powers(_BASE, n + 1)
            self.down = _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def _hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A polynomial hash of each span from one prefix sum."""
        self._tables(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * self.up[:len(data)], out=total[1:])
        h = (total[end] - total[begin]) * self.down[begin]
        h ^= h >> np.uint64(31)
        h *= _MIX
        return h ^ (h >> np.uint64(29))

    @staticmethod
    def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the spans of ``size`` bytes at ``a`` and ``b`` hold the same bytes."""
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        differs = data[np.repeat(a, size) + step] != data[np.repeat(b, size) + step]
        return np.add.reduceat(differs, first) == 0

    def _insert(self, data: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Indexes of the spans that entered the hash table (first of their bytes in their document)."""
        n = len(begin)
        if not n:
            return np.empty(0, np.int64)
        h, size = self._hashes(data, begin, end), end - begin
        mask = (1 << int(2 * n - 1).bit_length()) - 1
        at = ((h + doc.astype(np.uint64) * _MIX) & np.uint64(mask)).astype(np.int64)
        table = np.full(mask + 1, -1, np.int64)
        new, todo = np.zeros(n, bool), np.arange(n)
        while len(todo):
            free = todo[table[at[todo]] < 0]
            table[at[free][::-1]] = free[::-1]          # of several spans the first gets the slot
            held = table[at[todo]]
            own = held == todo
            new[todo[own]] = True
            alike = ~own & (h[held] == h[todo]) & (size[held] == size[todo]) & (doc[held] == doc[todo])
            pair = np.flatnonzero(alike)
            if len(pair):
                alike[pair] = self._equal(data, begin[held[pair]], begin[todo[pair]], size[todo[pair]])
            todo = todo[~own & ~alike]
            at[todo] = (at[todo] + 1) & mask
        return np.flatnonzero(new)

    def _pass(self, data: np.ndarray, offsets: np.ndarray):
        cls = CLASSES[data]
        inside = (cls & WORD).astype(bool)
        edge = np.zeros(len(data) + 1, bool)            # the machine starts outside a word at every text
        edge[offsets] = True
        begin = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
        end = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
        doc = np.searchsorted(offsets, begin, side="right") - 1
        docs = len(offsets) - 1
        counts = np.zeros((4, docs), np.int64)
        counts[0] = np.bincount(doc, minlength=docs)
        for row, bit in ((1, CAPITAL), (2, POINT), (3, SYMBOL)):
            sums = np.r_[0, np.cumsum(cls & bit > 0)]
            counts[row] = sums[offsets[1:]] - sums[offsets[:-1]]
        return counts, doc, begin, end, self._insert(data, doc, begin, end)

    def _long(self, data: np.ndarray) -> np.ndarray:
        """One text longer than a window: window by window, each ending outside a word."""
        total, seen, at = np.zeros(4, np.int64), set(), 0
        while at < len(data):
            stop = min(at + self.window, len(data))
            if stop < len(data):
                gaps = np.flatnonzero(~CLASSES[data[at:stop]].astype(np.uint8) & WORD)
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                else:                                   # inside one very long word: up to its end
                    while stop < len(data) and CLASSES[data[stop]] & WORD:
                        stop += 1
            part = data[at:stop]
            counts, _, begin, end, new = self._pass(part, np.array([0, len(part)]))
            total += counts[:, 0]
            seen.update(part[begin[i]:end[i]].tobytes() for i in new)
            at = stop
        return np.r_[total, len(seen)]

    def measure(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[words, capitals, code points, symbols, distinct words] x documents."""
        docs = len(offsets) - 1
        out = np.zeros((5, docs), np.int64)
        i = 0
        while i < docs:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + self.window, side="right")) - 1)
            part = data[offsets[i]:offsets[j]]
            if j == i + 1 and len(part) > self.window:
                out[:, i] = self._long(part)
            else:
                counts, doc, _, _, new = self._pass(part, offsets[i:j + 1] - offsets[i])
                out[:4, i:j] = counts
                out[4, i:j] = np.bincount(doc[new], minlength=j - i)
            i = j
        return out


def failures(counts: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that fail, from the counts of :meth:`Transducer.measure`."""
    words, capitals, points, symbols, distinct = counts
    return ((words < MIN_WORDS) * 1 | (100 * distinct < DISTINCT_PERCENT * words) * 2
            | (100 * capitals > CAPITAL_PERCENT * points) * 4 | (symbols > 0) * 8).astype(np.int32)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = Transducer()
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(2).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        mask = failures(machine.measure(data, offsets))
        digest = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(mask)],
            names=["doc_id", "part", "digest", "mask"])


def _effects() -> tuple[list[tuple[str, int]], np.ndarray, dict[str, np.ndarray]]:
    """The (order, step) rows, their filter's bit, and per row which sets of failed filters count."""
    rows, own, before = [], [], []
    for order in itertools.permutations(FILTERS):
        for k, f in enumerate(order):
            rows.append(("".join(order), k + 1))
            own.append(1 << FILTERS.index(f))
            before.append(sum(1 << FILTERS.index(x) for x in order[:k]))
    own, before, sets = np.array(own)[:, None], np.array(before)[:, None], np.arange(32)[None, :]
    fails, gone = sets & own > 0, sets & before > 0
    size = np.array([bin(m).count("1") for m in range(32)])
    share = np.where(size > 0, 120 // np.maximum(size, 1), 0)     # orders in which one of its filters comes first
    return rows, own[:, 0], {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone,
                             "unique_fails": (sets == own) & True, "shapley": fails * share[None, :]}


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, _, effect = _effects()
    order = pa.array([r[0] for r in rows])
    step = pa.array([r[1] for r in rows], pa.int32())
    for batch in batches:
        for part, sets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n, good, toxic = (np.zeros(32, np.int64) for _ in range(3))
            for s in sets:
                n[s["mask"]], good[s["mask"]], toxic[s["mask"]] = s["n"], s["good"], s["toxic"]
            lost = effect["removed"].astype(np.int64)
            got = {c: m.astype(np.int64) @ n for c, m in effect.items()} | {"good_lost": lost @ good, "toxic_lost": lost @ toxic}
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.string()), order, step, *[pa.array(got[c]) for c in _COUNTS]],
                names=["part", "filter_order", "step", *_COUNTS])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (``source``; null counts as empty), order of the five filters and step: the
    documents kept after the step, removed in it, failing its filter but removed earlier (redundant),
    failing its filter only, good and toxic documents removed in it, and the filter's removals summed
    over all orders (shapley).

    ``docs`` needs doc_id, text and source, ``labels`` doc_id, quality and toxic; other columns are
    ignored.  A null text is empty.  A document without words fails A only (no share to judge).
    Filter E compares whole texts table-wide by SHA-256: a row fails if a smaller non-null doc_id has
    the same text; rows of one doc_id do not fail each other, rows without doc_id never fail, and
    each row counts.  Several labels of a document count as one that holds any of them; documents
    without label (or doc_id) are neither good nor toxic.  An empty table gives no rows.
    """
    session(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"),
                        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    judged, _ = stored(texts.mapInArrow(tidy(_measure), MEASURED.format(id_type)), "audit_judged")
    # Repeated rows of a document are one row with their number; a document's flags join that.
    rows = judged.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").select(
        "doc_id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # Copies collapse before they meet: a row per text, part and flags, with its smallest document.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups, _ = stored(rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), least.alias("least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")), "audit_groups")
    shared = groups.groupBy("digest").agg(F.min("least.doc_id").alias("first"), F.count(F.lit(1)).alias("c")) \
        .where("c > 1").select("digest", "first")
    first = F.coalesce("first", "least.doc_id")
    stays = F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    split = groups.join(shared, "digest", "left").select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", stays.alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - stays).alias("n")))).alias("s"))
    sets = split.where("s.n > 0").groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("good")).alias("good"),
        F.sum(F.col("s.n") * F.col("toxic")).alias("toxic"))
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))
    return parts.mapInArrow(_expand, AUDIT)


ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CAST(len(words) < {MIN_WORDS} AS INTEGER)
        + 2 * CAST(100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words) AS INTEGER)
        + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(text) AS INTEGER)
        + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
        + 16 * CAST(coalesce(w.doc_id > first, false) AS INTEGER) AS mask
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
p AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM d GROUP BY part, mask),
f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
      FROM o, range(1, 6) r(step)),
x AS (SELECT *, mask & own > 0 AS fails, mask & before > 0 AS gone FROM p, s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN fails THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM x GROUP BY part, filter_order, step"""
