"""Conversation repair against a recursive search over all edits, in one segment and in many."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from faultlens.llm import conversation as C
from faultlens.llm import registry

SCHEMA = "conv_id long, turn long, role string, text string, row_no string, sid int"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        v = zlib.crc32(key.encode()) % 20
        if v:
            out += [(conv, turn, "user" if v == 4 else role,
                     "" if v == 1 else re.sub("[.!?]", "", text) if v == 2 else text)] * (2 if v == 3 else 1)
    return out


def brute(rows):
    """The operator's row of one conversation, from its rows in order."""
    seen, flags = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        flags.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.lru_cache(None)
    def best(i, done, budget):
        """Least (cost, audit, turns) from row i after the initials ``done`` (its last one, or ''), inserts left."""
        options = []
        if i == len(rows) and done in ("", "a"):
            options.append((0, "", ()))
        want = "a" if done == "u" else "u"
        name = {"u": "user", "a": "assistant"}[want]
        if budget:
            c, a, t = best(i, want, budget - 1)
            options.append((2 + c, "I" + a, ((name, ""),) + t))
        if i < len(rows):
            role, text, f = rows[i][2], rows[i][3], flags[i]
            c, a, t = best(i + 1, done, 3)
            options.append((3 + c, "D" + a, t))
            if f not in ("b", "d"):
                extra = f == "t"
                c, a, t = best(i + 1, want, 3)
                options.append((2 + extra + c, "R" + a, ((name, text),) + t))
                first = role[:1]
                if first == want or first == "s" and done == "":
                    c, a, t = best(i + 1, first, 3)
                    options.append((extra + c, "K" + a, ((role, text),) + t))
        return min(options, default=(10 ** 9, "", ()))

    cost, audit, turns = best(0, "", 3)
    named = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (max(named) - min(named) + 1 - len(set(named)) if named else 0, flags.count("b"), flags.count("d"), flags.count("t"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


def expected(spark, rows, damage):
    import xxhash
    out = {}
    for r in brute_damage(rows) if damage else [(c, t, " " if a is None else a, " " if x is None else x) for c, t, a, x in rows]:
        out.setdefault(r[0], []).append(r)

    def order(r):
        tie = xxhash.xxh64(r[3].encode(), seed=42).intdigest()
        return (r[1] is not None, r[1] or 0, r[2].encode(), tie - (1 << 64) if tie >> 63 else tie)
    got = {c: brute(sorted(rs, key=order)) for c, rs in out.items()}
    return {r[0]: (0,) * 6 + ("", EMPTY) for r in rows} | got if damage else got


def odd_rows(seed, convs=120, turns=9):
    rng = random.Random(seed)
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "tool", "", None, "usher"]
    texts = ["Hi.", "Yes!", "no end", "", " \t", None, "Why?", "a. ", "x" * 50 + ".", "é?", "\x85"]
    rows = []
    for c in [None, *range(convs)]:
        for t in range(rng.randint(0, turns)):
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice(texts) or rng.choice(texts)))
    return rows + rows[:7]


def collect(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_the_search_over_all_edits(shared, seed):
    rows = odd_rows(seed)
    frame = shared.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert collect(C.audit_conversations(frame)) == expected(shared, rows, True)
    assert collect(C.repair(frame, segment_rows=2)) == expected(shared, rows, False)


def test_one_conversation_over_many_tasks(shared):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", "", "c!", f"{t}."]))
            for t in range(700)] + [(c, 0, "user", "Hi.") for c in range(20)] + [(8, None, "user", "same.")] * 90
    frame = shared.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    import sys
    sys.setrecursionlimit(20_000)
    want = expected(shared, rows, False)
    assert collect(C.repair(frame)) == want
    assert collect(C.repair(frame, segment_rows=16)) == want
    assert collect(C.repair(frame, segment_bytes=64)) == want


def test_empty_table(shared):
    frame = shared.createDataFrame([], SCHEMA)
    assert C.audit_conversations(frame).count() == 0 and C.repair(frame).count() == 0


def test_ranks_select_the_least_of_equal_paths():
    import numpy as np
    # Node 0 has arcs I and R, node 1 only K, node 2 only D; both ways end in node 3.
    to = np.array([[-1, 1, -1, 2], [-1, -1, 3, -1], [3, -1, -1, -1], [-1] * 4])
    letter, pointers = C.least_paths(to, 2)
    assert letter.tolist() == [2, 3, 1, 0] and C.unfold(pointers, np.array([0]))[0][:3].tolist() == [0, 1, 3]


def test_query_over_the_whole_table(shared):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in shared.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collect(registry.QUERIES["op13_conversations"](shared, path)) == expected(shared, rows, True)
