"""Filter audit: the transducer against a plain reading, and the audit against DuckDB on odd rows."""

import random
import re

import duckdb
import numpy as np
import pytest

from faultlens.llm import filteraudit as A

DOCS = "doc_id long, text string, source string, part string, mask int, n string, digest long"
LABELS = "doc_id long, quality int, toxic int, good string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text), len(set(words))]


def texts(seed, n=60):
    rng = random.Random(seed)
    parts = ["a", "B", "the", "é", "🙂", " ", "  ", "\t", "\n", "\x85", "\xa0", "#", "word", "XYZ", "\x00", "日本語"]
    return ["", " ", "a", " a", "a ", "x" * 3000, "y " * 2000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 400))) for _ in range(n)]


@pytest.mark.parametrize("window", [7, 64, 1 << 19])
def test_the_transducer_counts_like_a_plain_reading(window):
    docs = texts(1)
    raw = [t.encode() for t in docs]
    offsets = np.cumsum([0] + [len(b) for b in raw])
    got = A.Transducer(window).measure(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert got.T.tolist() == [plain(t) for t in docs]


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(A.Transducer, "_hashes", lambda self, data, begin, end: np.zeros(len(begin), np.uint64))
    docs = texts(2, 12)
    raw = [t.encode() for t in docs]
    got = A.Transducer().measure(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(b) for b in raw]))
    assert got[4].tolist() == [plain(t)[4] for t in docs]


def audit(spark, docs, labels, parts=3):
    d = spark.createDataFrame([(*r, "p", 1, "n", 2) for r in docs], DOCS).repartition(parts)
    out = A.audit_filters(d, spark.createDataFrame([(*r, "g") for r in labels], LABELS))
    return sorted(map(tuple, out.collect()))


def oracle(docs, labels):
    import pandas as pd
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    return sorted(con.execute(A.ORACLE).fetchall())


def test_audit_of_odd_rows(shared):
    rng = random.Random(4)
    pool = [t.replace("\x00", "") for t in texts(5, 30)] + ["Good words " * 3 + f"{' '.join(f'w{j}' for j in range(k, k + 60))}" for k in range(8)] + [None]
    docs = [(rng.choice([i, i, i, 5]), rng.choice(pool), rng.choice(["web", "web", "news", "", None])) for i in range(400)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 400, 3)] + [(3, 1, 1), (None, 1, 1)]
    assert audit(shared, docs, labels) == oracle(docs, labels)


def test_rows_without_id_and_empty_tables(shared):
    docs = [(None, "same text", "a"), (None, "same text", "a"), (2, "same text", "b"), (2, "same text", "b"), (9, "same text", "a")]
    got = audit(shared, docs, [(9, 1, 0)])
    assert got == oracle(docs, [(9, 1, 0)])
    first = {r[0]: r for r in got if r[1] == "EABCD" and r[2] == 1}
    assert first["a"][4] == 1 and first["b"][4] == 0 and first["a"][7] == 1
    assert audit(shared, [], []) == []


def test_effects_add_up(shared):
    got = audit(shared, [(i, t, "s") for i, t in enumerate(texts(8))], [])
    assert len(got) == 600
    by_filter = {}
    for part, order, step, kept, removed, *_, shapley in got:
        by_filter.setdefault(order[step - 1], [0, shapley])[0] += removed
    assert all(total == shapley for total, shapley in by_filter.values())
