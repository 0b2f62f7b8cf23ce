"""Byte-level BPE by backtracking over longest token matches, and decoding.

Encoding a piece never replays merges.  An Aho-Corasick automaton over the
reversed tokens gives the longest token that starts at every byte.  The encoder
then walks forward: it takes the longest token at the present place, keeps it if
the pair (last token, this token) is one that the merges could leave side by
side, else falls back to the next shorter token that is a prefix of it, and, if
none is left, marks the place as a dead end and steps back.  Every place is
marked at most once, so the time is linear in the piece.  The pair test unfolds
both tokens along their merge tree (last merge first) and looks for a merge that
would have joined them earlier; its results are kept in a table.

Decoding gathers the bytes of all ids through one table of offsets.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import session, tidy

# Fixed value: the pattern by which byte-level BPE vocabularies split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same split for texts whose characters all lie where the two engines' classes agree.
_PLAIN = re.compile(r"[\t-\r -~\u00c0-\u024f\u2013-\u2026\u20ac]*")
_PLAIN_SPLIT = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
MAX_TOKENIZER_BYTES = 64 << 20   # the broadcast file is refused beyond this
CACHED_PIECES = 500_000          # memory bound of a worker's piece cache; it restarts when full
CACHED_PAIRS = 1_000_000
OUT_BYTES = 8 << 20              # text bytes per output batch


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte, as byte-level vocabularies write them."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary (the JSON of the tokenizers library)."""

    def __init__(self, spec: bytes):
        doc = json.loads(spec)
        model, alphabet = doc["model"], _byte_alphabet()
        if model["type"] != "BPE" or doc["normalizer"] or model.get("ignore_merges") \
                or doc["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level BPE without normaliser or prefix space is supported")
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab: dict[str, int] = model["vocab"]
        # Own numbering: 256 single bytes, then one number per merge in order.
        self.tokens: list[bytes] = [bytes([b]) for b in range(256)]
        shown = {b: c for c, b in alphabet.items()}
        self.out_id: list[int] = [vocab[shown[b]] for b in range(256)]
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        number = {t: i for i, t in enumerate(self.tokens)}
        self.joined: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right = number[raw(a)], number[raw(b)]
            whole = self.tokens[left] + self.tokens[right]
            if whole not in number:
                number[whole] = len(self.tokens)
                self.tokens.append(whole)
                self.out_id.append(vocab[a + b])
                self.parts.append((left, right))
            self.joined.setdefault((left, right), number[whole])
        self.number = number
        self.sizes = [len(t) for t in self.tokens]
        self.shorter = [self._prefix(t) for t in self.tokens]
        self.finder = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.finder.add_word(t[::-1].decode("latin-1"), i)
        self.finder.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.packed = [int(i).to_bytes(4, "little") for i in self.out_id]
        self.split = regex.compile(PATTERN)
        added = {t["content"]: t["id"] for t in doc.get("added_tokens") or []}
        for t in doc.get("added_tokens") or []:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
                raise ValueError(f"added token {t['content']!r} has options that are not supported")
        self.added = added
        longest_first = sorted(added, key=len, reverse=True)
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.pieces: dict[str, bytes] = {}
        by_id = {i: t for i, t in zip(self.out_id, self.tokens)} | {i: c.encode() for c, i in added.items()}
        size = max(by_id) + 1
        lengths = np.array([len(by_id.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), dtype=np.uint8)

    def _prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (i := self.number.get(token[:n])) is not None:
                return i
        return -1

    def _fits(self, a: int, b: int) -> bool:
        """Whether the merges can end with ``a`` directly before ``b``."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = self._unfolds(a, b)
        return known

    def _unfolds(self, a: int, b: int) -> bool:
        """Undo the younger of the two merges until both are single bytes; at no moment
        may a merge exist that joins the two edge tokens and is older than what was undone."""
        before = len(self.tokens) + 1
        while True:
            whole = self.joined.get((a, b))
            if whole is not None and whole < before:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:       # the left token is younger: its right half stood at the edge before
                before, a = a, self.parts[a][1]
            else:           # equal age counts as the left one being made first
                before, b = b + 1, self.parts[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Own token numbers of one piece."""
        whole = self.number.get(piece)
        if whole is not None:
            return [whole]
        last = len(piece) - 1
        # By end in the reversed piece; the longest match comes first there, so it is put last here.
        longest = dict(list(self.finder.iter(piece[::-1].decode("latin-1")))[::-1])
        sizes, shorter, pairs, fits = self.sizes, self.shorter, self.pairs, self._fits
        closed: set[int] = set()
        out: list[int] = []
        at, token, before = 0, longest[last], -1
        while True:
            end = at + sizes[token]
            if end not in closed:
                if before < 0:
                    ok = True
                elif (ok := pairs.get(before << 32 | token)) is None:
                    ok = fits(before, token)
                if ok:
                    out.append(token)
                    if end > last:
                        return out
                    at, before, token = end, token, longest[last - end]
                    continue
            if (short := shorter[token]) >= 0:
                token = short
            else:
                closed.add(at)
                token = out.pop()
                at -= sizes[token]
                before = out[-1] if out else -1

    def _piece(self, piece: str) -> bytes:
        packed = b"".join([self.packed[t] for t in self.encode_piece(piece.encode())])
        if len(piece) <= 64:
            if len(self.pieces) >= CACHED_PIECES:
                self.pieces.clear()
            self.pieces[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; added tokens in the text keep their id."""
        parts = self.added_split.split(text) if self.added_split else [text]
        known = self.pieces.get
        found = (_PLAIN_SPLIT if _PLAIN.fullmatch(text) else self.split).findall
        out: list[bytes] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                out += [known(p) or self._piece(p) for p in found(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        a = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        size = self.start[a + 1] - self.start[a]
        ends = np.cumsum(size)
        if not len(a):
            return ""
        gather = np.arange(ends[-1], dtype=np.int64) + np.repeat(self.start[a] - ends + size, size)
        return self.blob[gather].tobytes().decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(spec: bytes) -> Codec:
    """The codec of a vocabulary file's content, built once per worker process."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec)
        gc.freeze()         # the tables live as long as the worker: no need to scan them again
    return _CODECS[key]


def forget_pieces() -> None:
    """Drop the piece and pair caches: later stages in the same worker need the memory."""
    for c in _CODECS.values():
        c.pieces.clear()
        c.pairs.clear()


def read_spec(tokenizer_path: str) -> bytes:
    with open(tokenizer_path, "rb") as f:
        spec = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(spec) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path} exceeds {MAX_TOKENIZER_BYTES} bytes")
    return spec


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, s in enumerate(sizes):
        total += s
        if total >= OUT_BYTES:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc (struct of the input row), n_tokens, ids (packed little-endian uint32), decoded (text from the ids).

    One output row per input row, no shuffle; repeated rows give repeated results; extra columns
    stay inside ``doc`` whatever their names.  A null text counts as empty (no ids, empty decoded
    text).  An empty table gives an empty result.  Memory follows the largest single text.
    """
    spark = session(docs)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for batch in batches:
            texts = batch.column(0).field("text")
            for a, b in _chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                packed = [c.encode(t or "") for t in texts.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(p) // 4 for p in packed], pa.int64()),
                     pa.array(packed, pa.binary()), pa.array([c.decode(p) for p in packed], pa.string())],
                    names=["doc", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.struct("*").alias("doc"))
    return rows.mapInArrow(tidy(run, forget_pieces), T.StructType([rows.schema["doc"], *T.StructType.fromDDL(
        "n_tokens long, ids binary, decoded string").fields]))


def decode_ids(df: DataFrame, column: str, tokenizer_path: str) -> DataFrame:
    """Add ``decoded`` (replacing one of that name): the text of packed ids; null stays null."""
    spec = session(df).sparkContext.broadcast(read_spec(tokenizer_path))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        c = codec(spec.value)
        return ids.map(lambda p: None if p is None else c.decode(bytes(p)))

    return df.withColumn("decoded", text(F.col(column)))
