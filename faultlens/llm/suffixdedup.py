"""Exact substring dedup with suffix arrays built shard by shard by external induced sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a document
with a smaller id, or earlier in the same one).  Equal strings must meet in one shard:

1. Every string of ``length`` bytes (a window) is dealt by its anchor, the least hash of the
   shorter strings inside it.  The anchor follows from the window's bytes alone, and
   neighbouring windows mostly share it; a maximal run of them is one piece.
2. Only hashes of pieces are shuffled.  Equal pieces collapse, first in the task that reads them,
   then in the anchor's bucket: all but the earliest are removed runs.  A piece whose anchor has
   no second, different piece, and comes once in this one, holds no window that occurs twice and is done.
3. The bytes of the other pieces go to their anchor's shard, where ``induced.suffix_array`` orders
   all suffixes with their common prefixes.  Neighbours that share ``length`` bytes are one
   window; all occurrences but the earliest are removed runs.
4. Each document takes its removed runs.

An anchor with very many different pieces (a passage that a third of all documents
hold, in as many contexts) is split: its windows are dealt by their own hash, and of them only
those that share their hash with another one are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import discard, give_back, session, shuffles_dropped, stored, tidy
from faultlens.llm.induced import Workspace, suffix_array

LENGTH = 100
GRAM = 32                   # bytes of the strings whose least hash is a window's anchor
HOT_PIECES = 64             # different pieces of one anchor, in a task or bucket, from which it is split
CHUNK_BYTES = 1 << 20       # bytes hashed at once
FLUSH_BYTES = 16 << 20      # text of a task held before its pieces are collapsed
SPREAD = 4                  # buckets for each shuffle partition, so that partitions come out even
SHARD_BYTES = 16 << 20      # open pieces of a shard, on average; a shard is sorted in a task's memory
OUT_ROWS = 50_000
NO_ID = -(1 << 63)          # stands for a null doc_id, before every other

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_SPANS = "kid long, th long, begin int, end int"
_STEP = f"bucket int, blob binary, {_SPANS}"
_FOUND = f"kind int, {_SPANS}, anchor long, hot boolean"


# ---- pieces of a text ------------------------------------------------------

def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """64-bit hash of every string of GRAM bytes."""
    n = len(buf) - GRAM + 1
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), shape=(len(buf),), strides=(1,))
    h = eight * _ODD[0]
    h ^= h >> np.uint64(32)
    out = h[:n].copy()
    for k in range(8, GRAM, 8):
        out *= _ODD[k // 8]
        out += h[k:k + n]
    out ^= out >> np.uint64(29)
    out *= _ODD[4]
    out ^= out >> np.uint64(32)
    return out


def _slid(low: np.ndarray, width: int, least) -> np.ndarray:
    """Least (or greatest) of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        low = least(low[:-have], low[have:])
        have *= 2
    return least(low[:have - width], low[width - have:]) if have < width else low


def pieces(buf: np.ndarray, begin: np.ndarray, end: np.ndarray,
           length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor, inner) of the pieces of the texts buf[begin[i]:end[i]], each of ``length`` bytes
    or more.  ``inner``: the anchor may occur twice in the piece, so equal windows can lie inside it."""
    grams = _gram_hashes(buf)
    width = length - GRAM + 1
    low = _slid(grams, width, np.minimum)
    new = np.append(True, low[1:] != low[:-1])
    new[begin] = True
    valid = np.zeros(len(low) + 1, dtype=np.int8)
    valid[begin] = 1
    valid[end - length + 1] -= 1
    start = np.flatnonzero(new & (np.cumsum(valid[:-1]) > 0))
    stop = (end - length + 1)[np.searchsorted(begin, start, "right") - 1]
    windows = np.minimum(np.append(start[1:], len(low)), stop) - start
    anchor = low[start]
    # A string is some window's anchor if the greatest of the least hashes around it is its own.
    edge = np.zeros(width - 1, dtype=low.dtype)
    at = np.flatnonzero(_slid(np.concatenate([edge, low, edge]), width, np.maximum) == grams)
    twice = grams[at[1:]][(grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) < width)]
    inner = windows > width
    if len(twice):
        inner |= np.isin(anchor, twice)
    return start, windows, anchor, inner


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal ranges (touching ones are joined)."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.append(True, begin[1:] > end[:-1])
    return begin[first], end[np.append(np.flatnonzero(first)[1:], len(end)) - 1]


# ---- packed columns --------------------------------------------------------

def _pack(*columns: np.ndarray) -> bytes:
    raw = [len(columns).to_bytes(4, "little"), len(columns[0]).to_bytes(4, "little") if columns else b""]
    raw += [c.dtype.str.encode().ljust(4) + c.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, n = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    out, at = [], 8
    for _ in range(k):
        kind = np.dtype(raw[at:at + 4].decode().strip())
        out.append(np.frombuffer(raw, kind, n, at + 4))
        at += 4 + n * kind.itemsize
    return out


def _step(*parts: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    missing = lambda n, t: pa.nulls(n, t) if t == pa.binary() else pa.array(np.zeros(n, np.int64), t)
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("kid", pa.int64()), ("th", pa.int64()),
                        ("begin", pa.int32()), ("end", pa.int32())])
    for p in parts:
        for lo in range(0, len(p["bucket"]), OUT_ROWS):
            yield pa.RecordBatch.from_arrays(
                [pa.array(p[f.name][lo:lo + OUT_ROWS], f.type) if f.name in p else
                 # No null numbers: pandas would read the column as floats, which do not hold large ids.
                 missing(len(p["bucket"][lo:lo + OUT_ROWS]), f.type) for f in schema], schema=schema)


# ---- 1 and 2: hashes of pieces ---------------------------------------------

class _Collapse:
    """Pieces of a task's documents; equal ones are collapsed before anything is shuffled."""

    def __init__(self, buckets: int, length: int):
        self.buckets, self.length = buckets, length
        self.docs: list[tuple[int, int, bytes]] = []
        self.size = 0

    def add(self, kid: int, th: int, text: bytes) -> bool:
        self.docs.append((kid, th, text))
        self.size += len(text)
        return self.size >= FLUSH_BYTES

    def flush(self) -> Iterator[pa.RecordBatch]:
        docs, self.docs, self.size = sorted(self.docs, key=lambda d: d[:2]), [], 0
        if not docs:
            return
        kid = np.array([d[0] for d in docs], dtype=np.int64)
        th = np.array([d[1] for d in docs], dtype=np.int64)
        cols = [[], [], [], [], [], []]     # document, start, windows, anchor, hash of the bytes, inner
        for part in self._chunks(docs):
            for c, x in zip(cols, part, strict=True):
                c.append(x)
        doc, start, windows, anchor, code, inner = (np.concatenate(c) for c in cols)
        # Documents come in order, so of equal pieces the first is the earliest.
        key = anchor ^ code * _ODD[1]
        order = np.argsort(key, kind="stable")
        first = np.append(True, (anchor[order][1:] != anchor[order][:-1]) | (code[order][1:] != code[order][:-1]))
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        # The same place of a repeated row is no earlier occurrence.
        twin = (kid[doc[order]] == kid[doc[lead]]) & (th[doc[order]] == th[doc[lead]]) & (start[order] == start[lead])
        yield from self._spans(kid, th, doc, start, windows, order[~first & ~twin])
        keep = np.sort(order[first])
        yield from self._blobs(kid, th, *(x[keep] for x in (doc, start, windows, anchor, code, inner)))

    def _chunks(self, docs) -> Iterator[tuple[np.ndarray, ...]]:
        held, size = [], 0
        for i, (_, _, text) in enumerate(docs):
            # A long text is cut into chunks that overlap by length - 1 bytes: every window is in one.
            step = CHUNK_BYTES - self.length + 1
            for lo in range(0, max(1, len(text) - self.length + 1), step):
                held.append((i, lo, text[lo:lo + CHUNK_BYTES]))
                size += len(held[-1][2])
                if size >= CHUNK_BYTES:
                    yield self._hashed(held)
                    held, size = [], 0
        if held:
            yield self._hashed(held)

    def _hashed(self, held) -> tuple[np.ndarray, ...]:
        raw = b"".join(h[2] for h in held)
        size = np.array([len(h[2]) for h in held], dtype=np.int64)
        end = np.cumsum(size)
        begin = end - size
        start, windows, anchor, inner = pieces(np.frombuffer(raw, dtype=np.uint8), begin, end, self.length)
        view, tail = memoryview(raw), self.length - 1
        code = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in
                         zip(start.tolist(), (start + windows + tail).tolist(), strict=True)], dtype=np.uint64)
        code &= np.uint64(0xFFFFFFFFFFFF)
        which = np.searchsorted(begin, start, "right") - 1
        doc = np.array([h[0] for h in held], dtype=np.int64)[which]
        offset = np.array([h[1] for h in held], dtype=np.int64)[which]
        return doc, start - begin[which] + offset, windows, anchor, code, inner

    def _spans(self, kid, th, doc, start, windows, gone) -> Iterator[pa.RecordBatch]:
        if not len(gone):
            return
        # One number line: documents one after the other, with room between.
        room = int((start + windows).max()) + self.length + 1
        begin = doc[gone] * room + start[gone]
        begin, end = _merged(begin, begin + windows[gone] + self.length - 1)
        d = begin // room
        yield from _step({"bucket": ((kid[d].view(np.uint64) * _ODD[0] >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int32),
                          "kid": kid[d], "th": th[d], "begin": (begin - d * room).astype(np.int32),
                          "end": (end - d * room).astype(np.int32)})

    def _blobs(self, kid, th, doc, start, windows, anchor, code, inner) -> Iterator[pa.RecordBatch]:
        values, where, count = np.unique(anchor, return_inverse=True, return_counts=True)
        hot = count[where] > HOT_PIECES
        n = np.uint64(self.buckets)
        bucket = ((anchor >> np.uint64(7)) % n).astype(np.int32)
        bucket[hot] = ((anchor[hot] ^ code[hot] * _ODD[2]) % n).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        marks = values[count > HOT_PIECES]      # tell the anchor's own bucket that it is split
        mark_bucket = ((marks >> np.uint64(7)) % n).astype(np.int32)
        out = []
        for b in range(self.buckets):
            at = order[cuts[b]:cuts[b + 1]]
            mark = marks[mark_bucket == b] if len(marks) else marks
            if not len(at) and not len(mark):
                continue
            d, local = np.unique(doc[at], return_inverse=True)
            out.append((b, b"".join(_framed(x) for x in (
                _pack(kid[d], th[d]),
                _pack(np.diff(local, prepend=0).astype(np.uint32), start[at].astype(np.int32), windows[at].astype(np.int32),
                      anchor[at], (code[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                      (code[at] >> np.uint64(32)).astype(np.uint16), hot[at], inner[at]),
                _pack(mark)))))
        yield from _step({"bucket": np.array([o[0] for o in out], dtype=np.int32), "blob": [o[1] for o in out]})


def _framed(blob: bytes) -> bytes:
    return len(blob).to_bytes(4, "little") + blob


def _frames(blob: bytes) -> list[list[np.ndarray]]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at:at + 4], "little")
        out.append(_unpack(blob[at + 4:at + 4 + n]))
        at += 4 + n
    return out


def _found_frame(kind, kid, th, begin, end, anchor=None, hot=None) -> pd.DataFrame:
    n = len(kid)
    return pd.DataFrame({"kind": np.full(n, kind, np.int32), "kid": kid.astype(np.int64), "th": th.astype(np.int64),
                         "begin": begin.astype(np.int32), "end": end.astype(np.int32),
                         "anchor": np.zeros(n, np.int64) if anchor is None else anchor.view(np.int64),
                         "hot": np.zeros(n, bool) if hot is None else hot})


def _earliest(kid, th, start, key_group: np.ndarray) -> np.ndarray:
    """Order of all members by (group, document, start)."""
    return np.lexsort((start, th, kid, key_group))


def _compare_pieces(length: int):
    """One bucket: collapse equal pieces of all tasks; pass on those whose anchor has different ones, or comes twice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        spans = pdf[pdf["blob"].isna()]
        out = [_found_frame(0, *(spans[c].to_numpy() for c in ("kid", "th", "begin", "end")))]
        rows, marks = [], []
        for blob in pdf["blob"].dropna():
            (kid, th), (local, start, windows, anchor, low, high, hot, inner), (mark,) = _frames(bytes(blob))
            doc = np.cumsum(local.astype(np.int64))
            rows.append((kid[doc], th[doc], start.astype(np.int64), windows.astype(np.int64), anchor,
                         low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), hot, inner))
            marks.append(mark)
        if not rows or not sum(len(r[0]) for r in rows):
            return pd.concat(out)
        kid, th, start, windows, anchor, code, hot, inner = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.argsort(anchor ^ code * _ODD[1], kind="stable")
        a, c = anchor[order], code[order]
        first = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))
        alone = first & np.append(first[1:], True)
        several, group = order[~alone], np.cumsum(first)[~alone]
        by = _earliest(kid[several], th[several], start[several], group)
        several, group = several[by], group[by]
        lead = np.append(True, group[1:] != group[:-1]) if len(group) else np.empty(0, bool)
        head = several[np.maximum.accumulate(np.where(lead, np.arange(len(several)), 0))] if len(several) else several
        twin = (kid[several] == kid[head]) & (th[several] == th[head]) & (start[several] == start[head])
        gone = several[~lead & ~twin]
        out.append(_found_frame(0, kid[gone], th[gone], start[gone], start[gone] + windows[gone] + length - 1))
        kept = np.concatenate([order[alone], several[lead]])
        split = np.unique(np.concatenate([*marks, np.empty(0, np.uint64)]))
        _, where, count = np.unique(anchor[kept], return_inverse=True, return_counts=True)
        is_hot = hot[kept] | (count[where] > HOT_PIECES) | np.isin(anchor[kept], split)
        need = (count[where] > 1) | is_hot | inner[kept]
        k = kept[need]
        out.append(_found_frame(1, kid[k], th[k], start[k], start[k] + windows[k] + length - 1, anchor[k], is_hot[need]))
        return pd.concat(out)

    return run


# ---- 3: bytes of pieces, suffix arrays -------------------------------------

def _shards(found: DataFrame, buckets: int, length: int) -> int:
    """How many shards the open pieces go to: ``buckets``, or as many as their measured bytes need."""
    size = F.col("end").cast("long") - F.col("begin")
    held = F.when(F.col("hot"), F.greatest(size - length + 1, F.lit(0)) * (length + 24)).otherwise(size + 24)
    total = found.where("kind = 1").agg(F.sum(held)).first()[0] or 0
    return max(buckets, -(-total // SHARD_BYTES))


def _cut_pieces(buckets: int, length: int):
    """Send the bytes of the documents' open pieces to their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, int, bytes]]] = {}
        windows: dict[bytes, tuple[int, int, int]] = {}
        gone: list[tuple[int, int, int]] = []
        size = 0
        for batch in batches:
            for kid, th, text, spans in zip(*(batch.column(i) for i in range(4)), strict=True):
                kid, th, raw = kid.as_py(), th.as_py(), (text.as_py() or "").encode()
                for s in spans.as_py():
                    piece = raw[s["begin"]:s["end"]]
                    if not s["hot"]:
                        held.setdefault((s["anchor"] >> 7) % buckets, []).append((kid, th, s["begin"], piece))
                        size += len(piece) + 24
                        continue
                    for i in range(len(piece) - length + 1):     # a split anchor: every window by itself
                        w, me = piece[i:i + length], (kid, th, s["begin"] + i)
                        other = windows.setdefault(w, me)
                        if other is not me and other != me:
                            windows[w] = min(me, other)
                            gone.append(max(me, other))
                        elif other is me:
                            size += length + 24
                if size >= FLUSH_BYTES:
                    yield from _send(held, windows, gone, buckets, length)
                    held, windows, gone, size = {}, {}, [], 0
        yield from _send(held, windows, gone, buckets, length)

    return run


def _send(held, windows, gone, buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    loose: dict[int, list[tuple[int, int, int, bytes]]] = {}
    for w, (kid, th, at) in windows.items():
        loose.setdefault(xxhash.xxh3_64_intdigest(w) % buckets, []).append((kid, th, at, w))
    if held or loose:
        blobs = []
        for b, rows, split in [(*x, False) for x in held.items()] + [(*x, True) for x in loose.items()]:
            cols = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
            sizes = np.array([len(r[3]) for r in rows], dtype=np.int64)
            blobs.append((b, _framed(_pack(*cols, sizes, np.full(len(rows), split)))
                          + _framed(_pack(np.frombuffer(b"".join(r[3] for r in rows), np.uint8)))))
        yield from _step({"bucket": np.array([x[0] for x in blobs], np.int32), "blob": [x[1] for x in blobs]})
    if gone:
        kid, th, at = (np.array(x, dtype=np.int64) for x in zip(*gone, strict=True))
        # Neighbouring windows of one document become one run.
        order = np.lexsort((at, th, kid))
        kid, th, at = kid[order], th[order], at[order]
        new = np.append(True, (kid[1:] != kid[:-1]) | (th[1:] != th[:-1]) | (at[1:] > at[:-1] + length))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        yield from _step({"bucket": np.zeros(len(first), np.int32), "kid": kid[first], "th": th[first],
                          "begin": at[first].astype(np.int32), "end": (at[last] + length).astype(np.int32)})


def repeats(kid: np.ndarray, th: np.ndarray, start: np.ndarray, strings: list[bytes], length: int,
            space: Workspace) -> np.ndarray:
    """(string, offset) of every window of ``length`` bytes of which an equal one occurs earlier, by
    (document, start); a string stands at ``start`` of its document."""
    order, lcp, begin = suffix_array(strings, length, space)
    if len(order) < 2:
        return np.empty((0, 2), dtype=np.int64)
    joined = np.flatnonzero(lcp >= length)      # with the one before it
    member = np.union1d(joined, joined - 1)
    group = np.cumsum(np.append(True, lcp[member][1:] < length)) if len(member) else member
    place = order[member]
    which = np.searchsorted(begin, place, "right") - 1
    offset = place - begin[which]
    size = np.array([len(x) for x in strings], dtype=np.int64)
    whole = offset + length <= size[which]      # not across the end of a string
    which, offset, group = which[whole], offset[whole], group[whole]
    at = start[which] + offset
    by = _earliest(kid[which], th[which], at, group)
    which, offset, group, at = which[by], offset[by], group[by], at[by]
    lead = np.append(True, group[1:] != group[:-1]) if len(group) else np.empty(0, bool)
    head = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
    same = (kid[which] == kid[which[head]]) & (th[which] == th[which[head]]) & (at == at[head]) if len(lead) else lead
    return np.stack([which, offset], axis=1)[~lead & ~same]


def _met(strings: list[bytes], split: np.ndarray) -> np.ndarray:
    """Places of the strings to sort: all but the windows of split anchors whose hash no other one has.  (An anchor
    is split in every document or in none, and equal windows share their shard, so those occur once.)"""
    loose = np.flatnonzero(split)
    code = np.array([xxhash.xxh3_64_intdigest(strings[i]) for i in loose.tolist()], dtype=np.uint64)
    _, where, count = np.unique(code, return_inverse=True, return_counts=True)
    keep = ~split
    keep[loose[count[where] > 1]] = True
    return np.flatnonzero(keep)


def _sort_shard(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols, strings = [], []
        for blob in pdf["blob"]:
            (*col, sizes, split), (raw,) = _frames(bytes(blob))
            ends, data = np.cumsum(sizes).tolist(), raw.tobytes()
            strings += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            cols.append((*col, split))
        kid, th, start, split = (np.concatenate(c) for c in zip(*cols, strict=True))
        met = _met(strings, split)
        strings = [strings[i] for i in met.tolist()]
        kid, th, start = kid[met], th[met], start[met]
        with Workspace() as space:
            found = repeats(kid, th, start, strings, length, space)
        give_back()
        if not len(found):
            return pd.DataFrame({"kid": kid[:0], "th": th[:0], "begin": np.empty(0, np.int32), "end": np.empty(0, np.int32)})
        room = max(map(len, strings)) + length + 1
        begin = found[:, 0] * room + found[:, 1]
        begin, end = _merged(begin, begin + length)
        s = begin // room
        return pd.DataFrame({"kid": kid[s], "th": th[s], "begin": (begin - s * room + start[s]).astype(np.int32),
                             "end": (end - s * room + start[s]).astype(np.int32)})

    return run


# ---- 4: documents ----------------------------------------------------------

def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(0).field("text"), batch.column(1)
        kept, runs, lo, size = [], [], 0, 0
        for i in range(batch.num_rows):
            raw = (texts[i].as_py() or "").encode()
            found = spans[i].as_py() or []
            if found:
                begin, end = _merged(np.array([s["begin"] for s in found], dtype=np.int64),
                                     np.array([s["end"] for s in found], dtype=np.int64))
                found = [{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                cut = [0, *(x for s in found for x in (s["begin"], s["end"])), len(raw)]
                raw = b"".join(raw[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True))
            kept.append(raw)
            runs.append(found)
            size += len(raw)
            if size >= 8 << 20 or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(kept)),
                     pa.array(runs, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                     pa.array(kept, pa.binary())], names=["doc", "removed", "kept"])
                kept, runs, lo, size = [], [], i + 1, 0


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc (struct of the input row), removed (maximal runs [begin, end) of removed bytes, in order) and
    kept (the remaining bytes).

    One output row per input row; extra columns stay inside ``doc`` whatever their names.  A null
    text counts as empty.  A null doc_id stands before every other.  Rows that repeat in doc_id and
    text count as one document and get the same result; rows with one doc_id and different texts are
    ordered by the text's signed XXH64 (seed 42).  Texts below ``length`` bytes keep all.  An empty table gives
    an empty result.
    """
    if not GRAM <= length < 255:
        raise ValueError(f"length must be from {GRAM} to 254")
    with shuffles_dropped(session(docs)):
        keyed, per_doc = _removed_runs(docs, length)
    joined = keyed.join(per_doc.hint("shuffle_hash"), ["kid", "th"], "left").select("doc", "runs")
    return joined.mapInArrow(tidy(_apply), T.StructType([joined.schema["doc"], *T.StructType.fromDDL(
        "removed array<struct<begin:int,end:int>>, kept binary").fields]))


def _removed_runs(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """The documents by (kid, th), and the written removed runs of those that have some."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = SPREAD * partitions
    # Only repeated ids need the text's hash to tell their rows apart.
    ids = docs.select(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary")) if ids["n"] != ids["d"] else F.lit(0)
    kid = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    keyed = docs.select(kid.alias("kid"), th.cast("long").alias("th"), F.struct("*").alias("doc"))
    texts = keyed.select("kid", "th", F.col("doc.text").alias("text")).where(F.octet_length("text") >= length)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _Collapse(buckets, length)
        for batch in batches:
            for k, t, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                if c.add(k.as_py(), t.as_py(), text.as_py().encode()):
                    yield from c.flush()
        yield from c.flush()

    found, found_path = stored(texts.mapInArrow(tidy(collapse), _STEP).groupBy("bucket")
                               .applyInPandas(_compare_pieces(length), _FOUND), "suffix_found")
    spans = found.where("kind = 0").select("kid", "th", "begin", "end")
    shards = _shards(found, buckets, length)
    # Documents with open pieces, each with its list of them (bounded by its own length).
    wanted = found.where("kind = 1").groupBy("kid", "th").agg(
        F.collect_list(F.struct("begin", "end", "anchor", "hot")).alias("open"))
    cut, cut_path = stored(texts.join(wanted.hint("shuffle_hash"), ["kid", "th"]).select("kid", "th", "text", "open")
                           .mapInArrow(tidy(_cut_pieces(shards, length)), _STEP), "suffix_pieces")
    sorted_out, sorted_path = stored(cut.where("blob is not null").groupBy("bucket")
                                     .applyInPandas(_sort_shard(length), _SPANS), "suffix_repeats")
    gone = spans.unionByName(cut.where("blob is null").select("kid", "th", "begin", "end")).unionByName(sorted_out)
    per_doc, _ = stored(gone.groupBy("kid", "th").agg(F.collect_list(F.struct("begin", "end")).alias("runs")),
                        "suffix_runs")
    discard(spark, found_path, cut_path, sorted_path)
    return keyed, per_doc


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their own columns, the text without its removed runs (``n_chars``, if there,
    follows).  A null text stays null."""
    @F.pandas_udf("string")
    def whole_characters(kept: pd.Series) -> pd.Series:     # bytes of characters that were cut apart go too
        return kept.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    out = remove_repeats(docs, length)
    text = F.when(F.col("doc.text").isNotNull(), whole_characters("kept"))
    cut = out.select("doc", F.when(F.size("removed") == 0, F.col("doc.text")).otherwise(text).alias("text"))
    values = {"text": F.col("text"), "n_chars": F.length("text").cast(
        docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")}
    return cut.select(*[values[c].alias(c) if c in values else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
