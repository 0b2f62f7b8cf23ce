"""The registered queries and the pipeline on a folder of tables, against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_texts import PATH, _brute_fingerprint, _brute_removed
from tokenizers import Tokenizer

import corpus_pipeline
from faultlens.llm import langid, registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SCRATCH_NAMES = ["row", "doc", "spans", "fp", "kid", "th", "runs", "open", "ids", "kept", "removed", "lang_pred", "score",
                 "component_id", "row_hash", "keep_id", "bucket", "item_ids", "n_words", "copies", "evidence", "why"]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def words(text):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items):
    """(words, hit words, items) by looking up every run of words in the set of windows."""
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[a:a + 10]), set()).add(str(i))
    w, hit, found = words(text), set(), set()
    for size in {len(x) for x in windows}:
        for a in range(len(w) - size + 1):
            if (got := windows.get(tuple(w[a:a + size]))):
                hit |= set(range(a, a + size))
                found |= got
    return len(w), len(hit), sorted(found)


def components(rows):
    """doc_id -> smallest doc_id reachable over fingerprints at 2 or fewer differing bits."""
    fp = {i: _brute_fingerprint(t) for i, t in rows}
    label = {f: f for f in fp.values()}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    least = {}
    for i in sorted(fp):
        least.setdefault(label[fp[i]], i)
    return {i: (f"{f:016x}", least[label[f]]) for i, f in fp.items()}


@pytest.fixture(scope="module")
def tables(shared, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = shared.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*[c.split()[0] for c in DOCS.split(", ")])
    bench = shared.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    some = docs.where(F.length("text") > 400).orderBy("doc_id").limit(3).collect()
    leak = bench.orderBy("item_id").first()["text"]
    extra = [(9000, None, "en", "s", None), (9001, "", None, None, 0), (9002, "12 34 !!", "en", "s", 8), (9003, some[0]["text"], "en", "s", 1),
             (9004, some[0]["text"], None, "t", 1), (9005, some[1]["text"][:300] + " " + some[2]["text"][:350], "en", "s", 5),
             (9006, some[2]["text"][100:] + " Ende " + leak.upper(), None, "s", 2), (9007, "the <|endoftext|> of and", "en", "s", 3)]
    docs.unionByName(shared.createDataFrame(extra, DOCS)).write.parquet(f"{d}/documents.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    return d


def read(spark, d):
    return [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]


def test_document_queries_equal_brute_force(shared, tables):
    rows = [(r[0], r[1]) for r in read(shared, tables)]
    got = lambda name: {r["doc_id"]: tuple(r)[1:] for r in registry.QUERIES[name](shared, tables).collect()}
    assert got("op2_simhash") == components(rows)
    lib, want = Tokenizer.from_file(PATH), {}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode()))
    assert got("op4_bpe") == want
    items = [tuple(r) for r in shared.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    want = {}
    for i, t in rows:
        n, hit, found = brute_hits(t, items)
        want[i] = (n, hit, len(found), sha(",".join(found).encode()), hit > 0)
    assert got("op5_decontamination") == want and want[9006][4]
    assert got("op6_suffix") == {r[0]: w for r, w in zip(rows, _brute_removed(rows, 100), strict=True)}


def test_pipeline_equals_brute_force(shared, tables):
    docs = shared.read.parquet(f"{tables}/documents.parquet")
    model, rows = langid.train(docs), read(shared, tables)
    least = langid.NEAR_CHANCE / max(2, len(model.langs))
    rows = [r for r in rows if (p := model.predict(r[1]))[0] != "und" and p[1] >= least
            and model.evidence(r[1]) >= langid.LEAST_EVIDENCE]
    first = components([r[:2] for r in rows])
    rows = [r for r in rows if first[r[0]][1] == r[0]]
    seen, cut = set(), []
    for r in rows:
        raw, gone = r[1].encode(), np.zeros(len(r[1].encode()), bool)
        for a in range(len(raw) - 99):
            if raw[a:a + 100] in seen:
                gone[a:a + 100] = True
            seen.add(raw[a:a + 100])
        cut.append((r[0], bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore"), *r[2:4]))
    items = [tuple(r) for r in shared.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [r for r in cut if not brute_hits(r[1], items)[1]]
    lib, want = Tokenizer.from_file(PATH), {}
    for i, t, lang, source in kept:
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = (lang, source, len(ids), np.array(ids, "<u4").tobytes(), True)
    got = [tuple(r) for r in corpus_pipeline.run(shared, tables).collect()]
    assert len(got) == len(want) and {r[0]: (*r[1:4], bytes(r[4]), r[5]) for r in got} == want
    assert 9000 not in want and 9002 not in want and 9003 not in want and 9006 not in want and 9007 in want


def test_pipeline_of_an_empty_table(shared, tables, tmp_path):
    shared.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    shared.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(shared, str(tmp_path))
    assert out.count() == 0 and out.columns[:4] == ["doc_id", "lang", "source", "n_tokens"]


def test_stages_take_odd_rows_and_clashing_columns(shared, tables):
    """Null ids, repeated rows, and columns that the operators use inside; then no rows at all."""
    base = [(1, "the house of the river and the people who live there"), (1, "the house of the river and the people who live there"),
            (None, "das Haus und der Fluss sind nicht weit von der Stadt"), (None, None), (2, ""), (3, "a" * 5000)]
    for rows in (base, []):
        docs = shared.createDataFrame([(i, t, None, None, None, *range(len(SCRATCH_NAMES))) for i, t in rows],
                                      DOCS + "".join(f", {n} int" for n in SCRATCH_NAMES))
        for name, stage in corpus_pipeline.STAGES:
            if name == "language_id":
                out = langid.with_language(docs, langid.train(shared.read.parquet(f"{tables}/documents.parquet")))
                assert stage(shared, docs, tables).columns == docs.columns
            else:
                out = stage(shared, docs, tables)
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
            got = out.collect()
            assert len(got) <= len(rows) and (not rows or got)
