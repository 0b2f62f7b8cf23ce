"""Conversation structure repair: the cheapest edits that make the roles alternate.

A repaired conversation is empty or an optional system turn followed by pairs of user and assistant.
Edits are the arcs of a layered graph (rows consumed x automaton state), and each arc's letter fixes
the state it leads to.  A backward dynamic program gives every node its cost to the end.  Among the
arcs that keep that cost, paths are ranked by the first 1, 2, 4, ... letters of their audit: a node's
rank for 2k letters is the rank of the pair (its rank for k letters, that of the node k letters on),
and the pointers double with it.  The final ranks choose the arc at every node, and the doubled
pointers unfold the path.

Rows are sorted by range partitioning, so a conversation of any length spreads over tasks.  It is cut
into segments; one that lies whole inside a partition is solved there.  Of the others, segments exchange
only small tables: first occurrences of texts, a 4 x 4 matrix of costs between states, and the state at
each cut.  Texts of such a conversation meet once more, as a stream, for the hash of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import session, stored, tidy

SEGMENT_ROWS = 4096
SEGMENT_BYTES = 4 << 20
# White space, and the marks that end a sentence.
SPACES, ENDS = " \t\n\v\f\r", ".!?"
# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)
_CODE = {"u": 1, "a": 2, "s": 3}                # initials; anything else is 0
_EXPECTED = np.array([1, 1, 2, 1])              # initial that a re-roled or inserted turn gets in each state
_NEXT = np.array([USER, USER, ASSISTANT, USER])  # state after that turn
_KEEPS = np.full((4, 4), -1)                    # state after keeping a row, by state and initial
_KEEPS[[START, SYSTEM, ASSISTANT], 1] = USER
_KEEPS[USER, 2] = ASSISTANT
_KEEPS[START, 3] = SYSTEM
_FAR = 1 << 40
# Cost of the turns still to insert after the last row, and their number.
_TAIL = np.array([0, 2, 1, 0])
BLANK, CUT, REPEAT = 1, 2, 4                    # bits of a row's flags
_LETTERS = " DIKR"                              # audit letters in ASCII order, from 1
_LEGAL = {"su", "ua", "au"}


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with planted faults, by the remainder of the CRC-32 of
    ``conv_id:turn`` by 20: 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it,
    4 makes it a user's.  Nulls read as one space (conv_id and turn themselves stay null)."""
    def read(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    v = F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn")).cast("binary")) % 20
    text = F.when(v == 1, F.lit("")).when(v == 2, F.regexp_replace(read("text"), "[.!?]", "")).otherwise(read("text"))
    role = F.when(v == 4, F.lit("user")).otherwise(read("role"))
    copies = F.when(v == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(v != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_c")) \
        .select("conv_id", "turn", "role", "text", F.explode("_c").alias("_c")).drop("_c")


# ---------------------------------------------------------------------------------- segments

_SEGMENT = ("conv_id {c}, sid long, open boolean, initials binary, flags binary, digests binary, illegal long, turn_first {t}, "
            "turn_last {t}, turns long, role_first string, role_last string, roles array<string>, texts array<string>")


class _Segment:
    def __init__(self, conv, sid: int):
        self.conv, self.sid, self.size = conv, sid, 0
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.initials, self.flags, self.digests = bytearray(), bytearray(), bytearray()
        self.seen: set[bytes] = set()
        self.illegal = self.turns = 0
        self.first = self.last = None

    def add(self, turn, role: str, text: str) -> None:
        body = text.rstrip(SPACES)
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        flag = BLANK if not body.strip(SPACES) else 0 if body[-1] in ENDS else CUT
        if not flag & BLANK:
            if digest in self.seen:
                flag = REPEAT
            self.seen.add(digest)
        if self.roles and self.roles[-1][:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        if turn is not None:
            if self.first is None:
                self.first = turn
            self.turns += turn != self.last
            self.last = turn
        self.roles.append(role)
        self.texts.append(text)
        self.initials.append(_CODE.get(role[:1], 0))
        self.flags.append(flag)
        self.digests += digest
        self.size += len(text)

    def row(self, is_open: bool) -> dict:
        return {"conv_id": self.conv, "sid": self.sid, "open": is_open, "initials": bytes(self.initials), "flags": bytes(self.flags),
                "digests": bytes(self.digests), "illegal": self.illegal, "turn_first": self.first, "turn_last": self.last,
                "turns": self.turns, "role_first": self.roles[0], "role_last": self.roles[-1], "roles": self.roles,
                "texts": self.texts}


def _segments(schema: pa.Schema, rows_per: int, bytes_per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, first = TaskContext.get().partitionId() << 32, 0, True
        now, cut = None, False              # cut: the conversation has an earlier segment in this partition
        out, held = [], 0
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now is not None and (conv != now.conv or len(now.roles) >= rows_per or now.size >= bytes_per):
                    same = conv == now.conv
                    out.append(now.row(first or cut or same))
                    held += now.size
                    first, cut = first and same, same
                    now = None
                    if len(out) >= 2000 or held >= bytes_per:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if now is None:
                    now = _Segment(conv, base + n)
                    n += 1
                now.add(turn, role, text)
        if now is not None:
            out.append(now.row(True))       # the next partition may continue it
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


# ---------------------------------------------------------------------------------- the graph

@dataclass
class Graph:
    """Layered graphs of several segments: ``layer[s]`` is the layer before the first row of segment s."""
    initials: np.ndarray
    flags: np.ndarray
    sizes: np.ndarray

    def __post_init__(self):
        self.first = np.cumsum(self.sizes) - self.sizes              # row
        self.layer = self.first + np.arange(len(self.sizes))         # one layer more than rows per segment

    def costs(self, exits: np.ndarray) -> np.ndarray:
        """Least cost from every node to the exits, whose own costs are ``exits`` [segment, state, case]."""
        v = np.full((int(self.sizes.sum()) + len(self.sizes), *exits.shape[1:]), _FAR, np.int64)
        v[self.layer + self.sizes] = exits
        order = np.argsort(-self.sizes, kind="stable")
        sizes = self.sizes[order]
        for back in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            s = order[:int(np.searchsorted(-sizes, -back, side="right"))]
            i = self.sizes[s] - back
            row, at = self.first[s] + i, self.layer[s] + i
            v[at] = self._relax(self._row_costs(row, v[at + 1]))
        return v

    def _row_costs(self, row: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Cost of deleting, keeping or re-roling the row, the cheapest: [row, state, case]."""
        d, k, r = self.choices(row, after)
        return np.minimum(d, np.minimum(k, r))

    def choices(self, row: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flag = self.flags[row]
        extra = np.where(flag & CUT, TRUNCATED, 0)[:, None, None]
        lost = ((flag & (BLANK | REPEAT)) > 0)[:, None, None]
        to = _KEEPS[:, self.initials[row]].T                          # [row, state]
        keep = np.take_along_axis(after, np.maximum(to, 0)[:, :, None], axis=1) + extra
        keep = np.where((to < 0)[:, :, None] | lost, _FAR, keep)
        rerole = np.where(lost, _FAR, after[:, _NEXT] + REROLE + extra)
        return after + DELETE, keep, rerole

    @staticmethod
    def _relax(w: np.ndarray) -> np.ndarray:
        """Inserts before a row; two in a row reach every state that inserts can reach."""
        once = np.minimum(w, w[:, _NEXT] + INSERT)
        return np.minimum(once, once[:, _NEXT] + INSERT)

    def arcs(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[node, letter - 1] targets of the optimal arcs D, I, K, R (-1: none); node = 4 x layer + state."""
        v = v[:, :, 0]
        layers = np.delete(np.arange(len(v)), self.layer + self.sizes)       # every layer but the exits
        row = layers - np.searchsorted(self.layer, layers, side="right") + 1
        after = v[layers + 1][:, :, None]
        d, k, r = (x[:, :, 0] for x in self.choices(row, after))
        here = v[layers]
        to = np.full((len(v), 4, 4), -1, np.int64)
        nodes = 4 * layers[:, None]
        state = np.arange(4)[None, :]
        keeps = np.maximum(_KEEPS[:, self.initials[row]].T, 0)
        to[layers, :, 0] = np.where(d == here, nodes + 4 + state, -1)
        to[layers, :, 1] = np.where(here[:, _NEXT] + INSERT == here, nodes + _NEXT[None, :], -1)
        to[layers, :, 2] = np.where(k == here, nodes + 4 + keeps, -1)
        to[layers, :, 3] = np.where(r == here, nodes + 4 + _NEXT[None, :], -1)
        to[v >= _FAR] = -1                                                    # no way to the end from here
        return to.reshape(-1, 4)


def least_paths(to: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(letter of the least path's arc at every node, 0 at the ends; pointers 1, 2, 4, ... letters on).

    ``to[node, letter - 1]`` are the optimal arcs.  ``longest`` bounds the letters of a path.
    """
    nodes = np.arange(len(to))
    letter = np.where((to >= 0).any(1), (to >= 0).argmax(1) + 1, 0)
    point = np.where(letter > 0, to[nodes, np.maximum(letter - 1, 0)], nodes)
    rank, k = letter.astype(np.int64), 1
    while k < longest:
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[point], return_inverse=True)
        point, k = point[point], 2 * k
    # The arc of least (letter, rank of its target): its audit is the least of the node's paths.
    key = np.where(to >= 0, np.arange(1, 5)[None, :] * (len(to) + 1) + rank[np.maximum(to, 0)], np.iinfo(np.int64).max)
    best = key.argmin(1)
    letter = np.where((to >= 0).any(1), best + 1, 0)
    pointers, k = [np.where(letter > 0, to[nodes, best], nodes)], 1
    while k < longest:
        pointers.append(pointers[-1][pointers[-1]])
        k *= 2
    return letter, pointers


def unfold(pointers: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    """[start, step]: the nodes of the paths from ``start``, by halving the doubled strides."""
    path = start[:, None]
    for p in reversed(pointers):
        path = np.stack([path, p[path]], axis=2).reshape(len(start), -1)
    return path


def _graph(initials: list[bytes], flags: list[bytes]) -> Graph:
    return Graph(np.frombuffer(b"".join(initials), np.uint8), np.frombuffer(b"".join(flags), np.uint8),
                 np.array([len(f) for f in flags], np.int64))


def _solve(initials: list[bytes], flags: list[bytes], exits: np.ndarray):
    """Costs, letters, pointers and graph of some segments for the cost of their exit states."""
    g = _graph(initials, flags)
    v = g.costs(exits[:, :, None])
    # Between two rows at most two inserts, so a path has at most three letters for a row.
    letter, pointers = least_paths(g.arcs(v), 3 * int(g.sizes.max(initial=1)))
    return g, v, letter, pointers


def _walk(letters: np.ndarray, states: np.ndarray, roles: list[str], texts: list[str], tail: int = 0):
    """(audit, repaired turns) of one segment from the letters and states along its path."""
    audit, turns, i = [], [], 0
    for c, s in zip(letters, states):
        if not c:
            break
        audit.append(_LETTERS[c])
        if c == 2:
            turns.append(("assistant" if s == USER else "user", ""))
            continue
        if c == 3:
            turns.append((roles[i], texts[i]))
        elif c == 4:
            turns.append(("assistant" if s == USER else "user", texts[i]))
        i += 1
    for name in ("user", "assistant")[2 - tail:] if tail else ():
        audit.append("I")
        turns.append((name, ""))
    return "".join(audit), turns


def _paths(batch: pa.RecordBatch, exits: np.ndarray, entry: np.ndarray, ends: np.ndarray):
    """(cost, audit, turns) of every segment of the batch, in blocks of alike length."""
    initials, flags = batch.column("initials").to_pylist(), batch.column("flags").to_pylist()
    roles, texts = batch.column("roles").to_pylist(), batch.column("texts").to_pylist()
    out = [None] * len(flags)
    order = sorted(range(len(flags)), key=lambda i: len(flags[i]))
    at = 0
    while at < len(order):      # the unfolded block holds (segments x longest) nodes
        most = max(8, 2 * len(flags[order[at]]))
        block = [i for i in order[at:at + max(1, 200_000 // most)] if len(flags[i]) <= most]
        at += len(block)
        g, v, letter, pointers = _solve([initials[i] for i in block], [flags[i] for i in block], exits[block])
        start = 4 * g.layer + entry[block]
        nodes = unfold(pointers, start)
        for j, i in enumerate(block):
            tail = 0
            if ends[i]:
                tail = int(_TAIL[nodes[j, -1] % 4])
            audit, turns = _walk(letter[nodes[j]], nodes[j] % 4, roles[i], texts[i], tail)
            out[i] = (int(v[g.layer[j], entry[i], 0]), audit, turns)
    return out


def _body(turns) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in turns).encode()


# ---------------------------------------------------------------------------------- tasks

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SUMMARY = "conv_id {c}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"


def _flag_counts(flags: bytes) -> tuple[int, int, int]:
    f = np.frombuffer(flags, np.uint8)
    return tuple(int((f & bit > 0).sum()) for bit in (BLANK, REPEAT, CUT))


def _closed(schema: pa.Schema):
    """Conversations that lie whole in one segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            got = _paths(batch, np.repeat(INSERT * _TAIL[None, :], n, axis=0), np.zeros(n, np.int64), np.ones(n, bool))
            rows = []
            for r, (cost, audit, turns) in zip(batch.select(["conv_id", "flags", "illegal", "turn_first", "turn_last", "turns"])
                                               .to_pylist(), got):
                blank, again, cut = _flag_counts(r["flags"])
                rows.append({"conv_id": r["conv_id"], "gaps": _gaps(r["turn_first"], r["turn_last"], r["turns"]), "blank": blank,
                             "duplicate": again, "truncated": cut, "illegal": r["illegal"], "cost": cost, "audit": audit,
                             "repaired_sha256": hashlib.sha256(_body(turns)).hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def _gaps(low, high, distinct: int) -> int:
    return 0 if low is None else int(high) - int(low) + 1 - int(distinct)


def _first_texts(schema: pa.Schema):
    """A row per distinct text of a segment that is not blank: its digest and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows += [{"conv_id": r["conv_id"], "sid": r["sid"], "at": i, "digest": r["digests"][16 * i:16 * i + 16]}
                         for i, f in enumerate(r["flags"]) if not f & (BLANK | REPEAT)]
            yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def _matrices(schema: pa.Schema):
    """Flags with the repeats of earlier segments, and the least costs from entry to exit states."""
    ends = np.where(np.eye(4, dtype=bool), 0, _FAR)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            for r in rows:
                f = bytearray(r["flags"])
                for i in r.pop("repeats") or ():
                    f[i] = REPEAT
                r["flags"] = bytes(f)
                r["blank"], r["duplicate"], r["truncated"] = _flag_counts(r["flags"])
            g = _graph([r["initials"] for r in rows], [r["flags"] for r in rows])
            v = g.costs(np.repeat(ends[None], len(rows), axis=0))
            for r, layer in zip(rows, g.layer):
                r["matrix"] = v[layer].reshape(-1).tolist()
            yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def _fold_costs(pdf: pd.DataFrame) -> pd.DataFrame:
    """One conversation's segments from the last to the first: the cost of every exit state; its counts."""
    pdf = pdf.sort_values("sid", ignore_index=True)
    to_go, exits = INSERT * _TAIL, []
    for m in reversed(pdf["matrix"].tolist()):
        exits.append(np.minimum(to_go, _FAR).tolist())
        to_go = (np.array(m, np.int64).reshape(4, 4) + np.minimum(to_go, _FAR)[None, :]).min(1)
    first, last = pdf["turn_first"], pdf["turn_last"]
    turns, before = 0, None
    for n, a, b in zip(pdf["turns"], first, last):
        if n:
            turns += int(n) - (before is not None and a == before)
            before = b
    joints = sum((a or "")[:1] + (b or "")[:1] not in _LEGAL for a, b in zip(pdf["role_last"][:-1], pdf["role_first"][1:]))
    named = first.notna()
    low, high = (first[named].iloc[0], last[named].iloc[-1]) if named.any() else (None, None)
    counts = {"gaps": _gaps(low, high, turns), "illegal": int(pdf["illegal"].sum()) + joints, "cost": int(to_go[START])}
    counts |= {c: int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated")}
    out = pd.DataFrame({"sid": pdf["sid"], "exits": exits[::-1], "ends": [False] * (len(pdf) - 1) + [True]})
    return out.assign(**{c: counts[c] for c in _COUNTS})


def _maps(schema: pa.Schema):
    """The exit state of the least path from every entry state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:              # one segment at a time: long ones are large
                g, _, _, pointers = _solve([r["initials"]], [r["flags"]], np.array([r["exits"]], np.int64))
                # The largest stride is beyond any path, and the ends point at themselves.
                r["leads"] = [int(x) for x in pointers[-1][np.arange(4)] % 4]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def _fold_entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which the chosen path enters each segment of a conversation."""
    pdf = pdf.sort_values("sid", ignore_index=True)
    state, entry = START, []
    for leads in pdf["leads"]:
        entry.append(state)
        state = int(leads[state])
    return pd.DataFrame({"sid": pdf["sid"], "entry": np.array(entry, np.int32)})


def _pieces(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                r = one.drop_columns(["roles", "texts", "initials", "flags"]).to_pylist()[0]
                (_, audit, turns), = _paths(one, np.array([r.pop("exits")], np.int64), np.array([r.pop("entry")]),
                                            np.array([r.pop("ends")]))
                r |= {"audit": audit, "turns": len(turns), "body": _body(turns)}
                yield pa.RecordBatch.from_pylist([r], schema)
    return run


def _joined(schema: pa.Schema):
    """Sorted pieces of conversations to one row each; texts pass through the hash as they come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = digest = None
        some = False
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if now is None or r["conv_id"] != now["conv_id"]:
                    if now is not None:
                        yield _summary_row(now, digest, schema)
                    now, digest, some = r | {"audit": [r["audit"]]}, hashlib.sha256(), False
                else:
                    now["audit"].append(r["audit"])
                if r["turns"]:
                    digest.update((b"\n" if some else b"") + r["body"])
                    some = True
        if now is not None:
            yield _summary_row(now, digest, schema)
    return run


def _summary_row(r: dict, digest, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{c: r[c] for c in ("conv_id", *_COUNTS)} | {
        "audit": "".join(r["audit"]), "repaired_sha256": digest.hexdigest()}], schema)


# ---------------------------------------------------------------------------------- the operator

def _arrow(spec: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(spec))


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text; other columns are ignored): gaps in
    its turns, its blank, duplicate and truncated rows, illegal neighbours, the least cost, the audit (letters of
    the edits, the least of the cheapest) and the SHA-256 of the repaired conversation.

    Rows are taken by turn, nulls first, ties by role and then by text hash (equal rows are alike).  A null
    role or text reads as one space; a null conv_id is a conversation of its own.  Without rows there is no
    result.  A role whose initial is not u, a or s, an empty one too, can only be deleted or re-roled.
    """
    session(rows)
    spark = rows.sparkSession
    types = {"c": rows.schema["conv_id"].dataType.simpleString(), "t": rows.schema["turn"].dataType.simpleString()}
    plain = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")],
                        F.xxhash64(F.coalesce("text", F.lit(" "))).alias("tie"), F.monotonically_increasing_id().alias("row_no"))
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "tie", "row_no"]
    ordered = plain.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text")

    def step(df: DataFrame, maker, spec: str, *args) -> DataFrame:
        return df.mapInArrow(tidy(maker(_arrow(spec), *args)), spec)

    segments, _ = stored(step(ordered, _segments, _SEGMENT.format(**types), segment_rows, segment_bytes), "conversation_segments")
    summary = _SUMMARY.format(**types)
    whole = step(segments.where("not open"), _closed, summary)

    parts = segments.where("open")
    conv = f"conv_id {types['c']}, sid long"
    firsts, _ = stored(step(parts.select("conv_id", "sid", "flags", "digests"), _first_texts, f"{conv}, at int, digest binary"),
                       "conversation_texts")
    # A text's first segment; a conversation has a row per segment and text at most.
    least = firsts.groupBy("conv_id", "digest").agg(F.min("sid").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = firsts.alias("f").join(least.alias("l"), F.col("f.conv_id").eqNullSafe(F.col("l.conv_id"))
                                   & (F.col("f.digest") == F.col("l.digest")) & (F.col("f.sid") > F.col("l.least")))
    repeats = later.groupBy("f.sid").agg(F.collect_list("f.at").alias("repeats"))
    small = ["conv_id", "sid", "initials", "flags", "illegal", "turn_first", "turn_last", "turns", "role_first", "role_last"]
    stats_spec = (f"{conv}, initials binary, flags binary, illegal long, turn_first {types['t']}, turn_last {types['t']}, turns long, "
                  "role_first string, role_last string, blank long, duplicate long, truncated long, matrix array<long>")
    stats, _ = stored(step(parts.select(*small).join(repeats, "sid", "left").select(*small, "repeats"), _matrices, stats_spec),
                      "conversation_costs")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    folded = stats.drop("initials", "flags").groupBy("conv_id").applyInPandas(
        _fold_costs, f"sid long, exits array<long>, ends boolean, {counts}")
    steps_spec = f"{conv}, initials binary, flags binary, exits array<long>, ends boolean, {counts}, leads array<int>"
    steps, _ = stored(step(stats.select("conv_id", "sid", "initials", "flags").join(folded, "sid").select(
        "conv_id", "sid", "initials", "flags", "exits", "ends", *_COUNTS), _maps, steps_spec), "conversation_steps")
    entries = steps.select("conv_id", "sid", "leads").groupBy("conv_id").applyInPandas(_fold_entries, "sid long, entry int")
    ready = parts.select("sid", "roles", "texts").join(steps.drop("leads"), "sid").join(entries, "sid")
    pieces, _ = stored(step(ready, _pieces, f"{conv}, {counts}, audit string, turns int, body binary"), "conversation_pieces")
    long = step(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "sid"), _joined, summary)
    return whole.unionByName(long)


def audit_conversations(rows: DataFrame) -> DataFrame:
    """:func:`damaged` then :func:`repair`, with a row of zeros for conversations that lost every row."""
    fixed = repair(damaged(rows))
    marked = rows.select("conv_id").withColumn("n", F.lit(0)).unionByName(damaged(rows).select("conv_id", F.lit(1).alias("n")))
    gone = marked.groupBy("conv_id").agg(F.max("n").alias("n")).where("n = 0")
    return fixed.unionByName(gone.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in _COUNTS], F.lit("").alias("audit"),
                                         F.sha2(F.lit(b""), 256).alias("repaired_sha256")))
