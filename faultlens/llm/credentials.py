"""Secret scan by grammar inference.

Fixed patterns find the plain credentials (base spans).  They label the credentials that the formats
are learned from: per kind, a prefix tree of the credentials is folded by the ALERGIA scheme, which
merges a state into an earlier one if their stop and transition frequencies agree within a Hoeffding
bound, all the way down.  What remains is a probabilistic automaton of the kind's format; ordinary runs of
the same characters give the automaton of everything else.  Every other run of at least
``CANDIDATE`` characters is scored by its log likelihood ratio per character, and joins the spans if it
beats both the weakest held-out credentials and nearly all held-out ordinary runs.

Texts are scanned once, in tasks; what is kept of a document are its spans and candidate runs.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import discard, session, stored, tidy

# The kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")       # runs are maximal, so shorter ones need not be matched first
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

CANDIDATE = 16                  # characters of a candidate run at least
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
OTHER = "other"                 # label of ordinary runs
SLICES = 256                    # of the hashes; a label's strings are numbered slice by slice
CONFIDENCE = 0.05               # of the Hoeffding test
WEAKEST = 0.02                  # share of the held-out credentials that may score below the bound
ALPHABET = 66
UNSEEN = 0.05                   # probability kept in every state for symbols it has not seen
ORDINARY = 0.01                 # share of the held-out ordinary runs that may score above the bound (unlabelled credentials)

SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start and kind; leftmost, without overlap within a kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of credential characters that touch no base span."""
    if not base:
        return [m.span() for m in RUN.finditer(text)]
    starts, ends = [s[1] for s in base], np.maximum.accumulate([s[2] for s in base])
    out = []
    for m in RUN.finditer(text):
        before = int(np.searchsorted(starts, m.end(), side="left"))
        if not before or ends[before - 1] <= m.start():
            out.append(m.span())
    return out


# ---------------------------------------------------------------------------------- grammar inference

class Automaton:
    """Probabilistic automaton of states (visits, stops, {symbol: (next state, count)}), smoothed.

    A share ``UNSEEN`` of every state's probability is kept for the symbols' frequencies over all states
    (each of ``ALPHABET`` symbols counted once more), so a symbol that the format never has costs most.
    """

    def __init__(self, states: list[tuple[int, int, dict[str, tuple[int, int]]]]):
        counts: dict[str, int] = {}
        for _, stop, arcs in states:
            counts[""] = counts.get("", 0) + stop
            for c, (_, k) in arcs.items():
                counts[c] = counts.get(c, 0) + k
        total = sum(counts.values()) + ALPHABET
        self.general = {c: UNSEEN * (k + 1) / total for c, k in counts.items()}
        self.never = math.log(UNSEEN / total)
        self.states = []
        for n, stop, arcs in states:
            keep = (1.0 - UNSEEN) / max(n, 1)
            self.states.append((math.log(keep * stop + self.general[""]),
                                {c: (s, math.log(keep * k + self.general[c])) for c, (s, k) in arcs.items()}))
        self.general = {c: math.log(p) for c, p in self.general.items()}

    def log_likelihood(self, text: str) -> float:
        """A symbol that the state has no arc for leaves the state as it is."""
        total, state = 0.0, 0
        for c in text:
            got = self.states[state][1].get(c)
            if got is None:
                total += self.general.get(c, self.never)
            else:
                state, gain = got
                total += gain
        return total + self.states[state][0]


class _Tree:
    """Prefix tree of distinct sorted strings: per state its visits, stops, and arcs (symbol -> [state, count]).

    States are numbered as the strings enter them.  Those that a single string visits are not built: they follow from the string
    (:meth:`state` builds one where a fold adds to it), so the tree is as large as what the strings share.
    """

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.first: list[int] = []              # number of the first state that is new with a string
        self.shared: list[int] = []             # symbols that a string shares with the one before
        self.states: dict[int, list] = {0: [len(strings), 0, {}]}
        path, last, total = [0], "", 1
        for i, s in enumerate(strings):
            same = _common(last, s)
            del path[same + 1:]
            for at in path[1:]:
                self.states[at][0] += 1
            for d, at in enumerate(path[:-1]):
                self.states[at][2][s[d]][1] += 1
            self.first.append(total)
            self.shared.append(same)
            built = max(same, _common(s, strings[i + 1]) if i + 1 < len(strings) else 0)
            for d in range(same, len(s)):
                self.states[path[-1]][2][s[d]] = [total + d - same, 1]
                if d >= built:
                    break
                path.append(total + d - same)
                self.states[path[-1]] = [1, 0, {}]
            if len(path) == len(s) + 1:
                self.states[path[-1]][1] += 1
            total += len(s) - same
            last = s

    def visits(self, at: int) -> int:
        got = self.states.get(at)
        return got[0] if got else 1

    def state(self, at: int) -> list:
        """[visits, stops, arcs] of a state."""
        got = self.states.get(at)
        if got is None:
            symbol = self._symbol(at)
            got = self.states[at] = [1, 0, {symbol: [at + 1, 1]}] if symbol else [1, 1, {}]
        return got

    def _symbol(self, at: int) -> str:
        """The one symbol after a state that is not built; empty at its string's end."""
        i = bisect.bisect_right(self.first, at) - 1
        d = self.shared[i] + 1 + at - self.first[i]
        return self.strings[i][d:d + 1]

    def alike(self, a: int, b: int, c: float) -> bool:
        """Whether the states' futures agree within the bound; rarer futures have wider bounds."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            n, m = self.visits(a), self.visits(b)
            bound = c * (n ** -0.5 + m ** -0.5)
            if bound >= 1:
                continue            # no evidence here, nor below
            (_, stop_a, arcs_a), (_, stop_b, arcs_b) = self.state(a), self.state(b)
            if abs(stop_a / n - stop_b / m) > bound:
                return False
            for s in arcs_a.keys() | arcs_b.keys():
                x, y = arcs_a.get(s), arcs_b.get(s)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) > bound:
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def fold(self, into: int, tree: int) -> list[tuple[int, str]]:
        """Add the subtree ``tree`` to the state ``into``; the arcs (state, symbol) that have more visits now."""
        todo, more = [(into, tree)], []
        while todo:
            a, b = todo.pop()
            to, n = self.state(a), self.visits(b)
            gone = self.states.pop(b, None)
            if gone is None:                    # one string's way
                symbol = self._symbol(b)
                gone = [1, 0, {symbol: [b + 1, 1]}] if symbol else [1, 1, {}]
            to[0] += n
            to[1] += gone[1]
            for s, (y, k) in gone[2].items():
                arc = to[2].setdefault(s, [y, 0])
                arc[1] += k
                more.append((a, s))
                if arc[0] != y:
                    todo.append((arc[0], y))
        return more


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def infer(strings: list[str], confidence: float = CONFIDENCE) -> list[tuple[int, int, dict[str, tuple[int, int]]]]:
    """The automaton's states, state 0 first, by merging compatible states of the distinct strings' prefix tree.

    The next state to judge is the most visited child of a settled one (ties: the earlier in the
    tree), so that merges rest on the most evidence; it is tried against the settled states in order.
    """
    tree = _Tree(sorted(set(strings)))
    c = math.sqrt(0.5 * math.log(2 / confidence))
    settled, order = {0}, [0]
    frontier: list[tuple[int, int, int, str]] = []      # an entry holds as long as its state has so many visits

    def push(a: int, s: str) -> None:
        b = tree.state(a)[2][s][0]
        if a in settled and b not in settled:
            heapq.heappush(frontier, (-tree.visits(b), b, a, s))

    for s in tree.state(0)[2]:
        push(0, s)
    while frontier:
        n, b, a, s = heapq.heappop(frontier)
        if b in settled or tree.state(a)[2][s][0] != b or tree.visits(b) != -n:
            continue
        for state in order:
            if tree.alike(state, b, c):
                tree.state(a)[2][s][0] = state
                for arc in tree.fold(state, b):
                    push(*arc)
                break
        else:
            settled.add(b)
            order.append(b)
            for s in tree.state(b)[2]:
                push(b, s)
    number = {b: i for i, b in enumerate(order)}
    return [(n, stop, {s: (number[x], k) for s, (x, k) in sorted(arcs.items())}) for n, stop, arcs in map(tree.state, order)]


# ---------------------------------------------------------------------------------- tasks

def _scan(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, runs = [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                found = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b, "text": _learned(k, text[a:b])} for k, a, b in found])
                runs.append([{"start": a, "end": b, "text": text[a:b]} for a, b in candidates(text, found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, schema.field("found").type), pa.array(runs, schema.field("runs").type)], schema=schema)
    return run


def _learned(kind: str, span: str) -> str:
    """What a model learns from a base span: an assignment's value, else the span."""
    return ASSIGN.fullmatch(span).group(2) if kind == "assign" else span


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text, seed=11)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings' hashes, as signed numbers of the same order, and the slice of them that a string lies in."""
    for batch in batches:
        keys = np.array([_key(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array((keys ^ np.uint64(1 << 63)).view(np.int64)), pa.array((keys // np.uint64((1 << 64) // SLICES)).astype(np.int32))],
            names=["label", "text", "key", "slice"])


def dealt(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """(label, text, fitted) of all distinct strings of ``rows`` (label, text), written, and the scratch folders: by the order
    of their hashes every other one of a label is ``fitted``, the rest are kept for the bounds."""
    keyed, first = stored(rows.distinct().mapInArrow(tidy(_keyed), "label string, text string, key long, slice int"), "credential_strings")
    sizes = keyed.groupBy("label", "slice").count().collect()          # at most SLICES rows a label
    before, held = [], Counter()
    for r in sorted(sizes, key=lambda r: (r["label"], r["slice"])):
        before.append((r["label"], r["slice"], held[r["label"]]))
        held[r["label"]] += r["count"]
    place = F.row_number().over(Window.partitionBy("label", "slice").orderBy("key", "text")) - 1 + F.col("before")
    out, second = stored(keyed.join(F.broadcast(keyed.sparkSession.createDataFrame(before, "label string, slice int, before long")), ["label", "slice"])
                         .select("label", "text", (place % 2 == 0).alias("fitted")), "credential_strings")
    return out, [first, second]


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """One label's automaton from its strings."""
    return pd.DataFrame({"label": [pdf["label"].iloc[0]], "states": [json.dumps(infer(pdf["text"].tolist()))]})


class Formats:
    """The learned formats and their score bounds; without credentials or ordinary runs nothing is added."""

    def __init__(self, fitted: list[Row]):
        models = {r["label"]: Automaton(json.loads(r["states"])) for r in fitted}
        self.other = models.pop(OTHER, None)
        self.models = {k: models[k] for k in KINDS if k in models and self.other}
        self.bounds: dict[str, float] = {}

    def bound(self, lowest: dict[str, float], ordinary: dict[str, float]) -> None:
        """Set each kind's bound by the score of its weakest credentials and that of the highest ordinary runs; a kind without
        held-out credentials is given up."""
        self.models = {k: m for k, m in self.models.items() if k in lowest}
        self.bounds = {k: max([lowest[k], *([ordinary[k]] if k in ordinary else [])]) for k in self.models}

    def score(self, kind: str, text: str) -> float:
        """Log likelihood ratio per character; capitals without small letters are also read as small ones."""
        forms = {text, text.lower()} if text.upper() == text else {text}
        return max(self.models[kind].log_likelihood(f) - self.other.log_likelihood(f) for f in forms) / (len(text) + 1)

    def judge(self, text: str) -> tuple[str, float] | None:
        """(kind, score) of the likeliest format above its bound."""
        got = [(self.score(k, text), k) for k in self.models]
        over = [(s, k) for s, k in got if s > self.bounds[k]]
        return max(over, key=lambda x: (x[0], -KINDS.index(x[1])))[::-1] if over else None


def _ordered(score: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = score.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def of_rank(scores: DataFrame, ranks: dict[tuple[str, bool], int]) -> dict[tuple[str, bool], float]:
    """The score of that rank, from 0 up, of each (kind, own) in ``scores`` (kind, own, key: :func:`_ordered`): 16 bits of it a job, by
    counts of the scores that share the bits so far."""
    at, left = {g: None for g in ranks}, dict(ranks)
    for shift in (48, 32, 16, 0):
        part = F.shiftright("key", shift)
        inside = [(F.col("kind") == k) & (F.col("own") == F.lit(o)) & (F.lit(True) if x is None else F.shiftright("key", shift + 16) == x)
                  for (k, o), x in at.items()]
        if not inside:
            return {}
        counts = scores.where(functools.reduce(lambda a, b: a | b, inside)).groupBy("kind", "own", part.alias("part")).count().collect()
        at.update(dict.fromkeys(at))
        for r in sorted(counts, key=lambda r: r["part"]):
            g = r["kind"], r["own"]
            if at[g] is None:
                if left[g] < r["count"]:
                    at[g] = r["part"]
                else:
                    left[g] -= r["count"]
    return {g: float(_ordered(np.array([x], np.int64).view(float)).view(float)[0]) for g, x in at.items()}


def learn(found: DataFrame) -> Formats:
    """Formats from all base spans and ordinary runs of scanned documents.

    Every distinct string counts: half of a label's are what its automaton is inferred from, by the other half's scores the bounds
    are set.  The merging is a sequence of decisions on one prefix tree, so a label is fitted in one task.
    """
    spark = found.sparkSession
    labelled = found.select(F.explode("found").alias("f")).select(F.col("f.kind").alias("label"), F.col("f.text").alias("text"))
    ordinary = found.select(F.explode("runs").alias("r")).select(F.lit(OTHER).alias("label"), F.col("r.text").alias("text"))
    strings, scratch = dealt(labelled.unionByName(ordinary))
    formats = Formats(strings.where("fitted").groupBy("label").applyInPandas(_fit, "label string, states string").collect())
    shared = spark.sparkContext.broadcast(formats)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = [(k, label == k, known.score(k, t)) for label, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for k in known.models if label in (k, OTHER)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()),
                                              pa.array(_ordered(np.array([r[2] for r in rows], float)))], names=["kind", "own", "key"])

    scores, path = stored(strings.where("NOT fitted").select("label", "text").mapInArrow(tidy(scored), "kind string, own boolean, key long"),
                          "credential_scores")
    sizes = {(r["kind"], r["own"]): r["count"] for r in scores.groupBy("kind", "own").count().collect()}
    got = of_rank(scores, {(k, own): int(WEAKEST * n) if own else n - 1 - int(ORDINARY * n) for (k, own), n in sizes.items()})
    formats.bound({k: s for (k, own), s in got.items() if own}, {k: s for (k, own), s in got.items() if not own})
    shared.unpersist()
    discard(spark, *scratch, path)
    return formats


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, base, added) of every row of ``docs``: spans (kind, start, end in code points) of the fixed
    patterns and those the learned formats add, each by start and kind; other columns are ignored.

    A null or empty text has no spans.  Rows may repeat; each gets its own.  Without a labelled
    credential of a kind, nothing of that kind is added; an empty table gives no rows.
    """
    spark = session(docs)
    id_type = docs.schema[id_column].dataType.simpleString()
    spec = (f"doc_id {id_type}, found array<struct<kind:string,start:int,end:int,text:string>>, "
            "runs array<struct<start:int,end:int,text:string>>")
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(T._parse_datatype_string(spec))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    found, _ = stored(texts.mapInArrow(tidy(_scan(schema)), spec), "credential_spans")
    formats = spark.sparkContext.broadcast(learn(found))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = formats.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            added = []
            for runs in batch.column(2).to_pylist():
                got = [(r, known.judge(r["text"])) for r in runs]
                added.append([{"kind": hit[0], "start": r["start"], "end": r["end"]} for r, hit in got if hit])
            base = [[{k: s[k] for k in ("kind", "start", "end")} for s in row] for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(added, kind)],
                                             names=["doc_id", "base", "added"])

    return found.mapInArrow(tidy(judged), f"doc_id {id_type}, base {SPANS}, added {SPANS}")


def joined(spans):
    """Column: spans as ``kind:start:end`` by start, then kind as listed, comma-joined."""
    order = F.transform(spans, lambda s: F.struct(
        s["start"].alias("a"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["end"].alias("b"),
        F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("t")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: s["t"]), ",")
