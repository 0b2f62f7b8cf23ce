"""Text operators against brute force, with nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultlens.llm import bpe, decontaminate, induced, langid, simhash, suffixdedup

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, row string, doc string, spans int, fp int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], DOCS)


def odd_texts(seed=1):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "é", "ß", "123", "!", "<|endoftext|>", "'ll", "ing", "日本", "🙂", "\x85", "_", "×"]
    return ["", None, "a" * 3000, " " * 500] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(60)]


def test_bpe_equals_the_library(shared):
    lib = Tokenizer.from_file(PATH)
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "again"), (3, texts[3]), (3, texts[3])]
    got = bpe.encode_documents(frame(shared, rows), PATH).select("doc.*", "n_tokens", "ids", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(ids, dtype="<u4").tobytes() and r["n_tokens"] == len(ids)
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)
    again = bpe.decode_ids(shared.createDataFrame([(bytes(got[0]["ids"]),), (None,)], "ids binary"), "ids", PATH).collect()
    assert [r["decoded"] for r in again] == [got[0]["decoded"], None]
    assert bpe.encode_documents(frame(shared, []), PATH).count() == 0


def test_bpe_long_piece_is_exact():
    lib, c = Tokenizer.from_file(PATH), bpe.codec(bpe.read_spec(PATH))
    for text in ("ab" * 4000, "x" * 9000, "".join(random.Random(2).choices("abcdefgh", k=9000))):
        assert c.encode(text) == np.array(lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                                 "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item_id, t in items:
        x = words(t)
        for i in range(max(1, len(x) - window + 1)) if x else ():
            win = x[i:i + window]
            for a in range(len(w) - len(win) + 1):
                if w[a:a + len(win)] == win:
                    hit |= set(range(a, a + len(win)))
                    if item_id is not None:
                        found.add(str(item_id))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_equals_brute_force(shared, block_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "cé", "D", "42"])
    items = [(1, " ".join(word() for _ in range(12))), (2, "lone"), (10, "a, b"), (None, "null id"), (4, None), (5, "!!"),
             (1, "a b a b a b a b a b a"), (7, " ".join(word() for _ in range(10)))]
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(90, f"x {items[0][1].upper()} y"), (91, "Lone; null id"), (92, None), (None, "lone"), (90, "a b"), (90, "a b")]
    bench = shared.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_benchmark(frame(shared, rows), bench, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = _brute_hits(r["doc"]["text"], items)
        assert (r["n_words"], sum(s["end"] - s["begin"] for s in r["spans"]), list(r["item_ids"])) == (n, hit, found)
    kept = decontaminate.decontaminated(frame(shared, rows), bench, block_bytes=block_bytes)
    assert kept.columns == frame(shared, []).columns
    assert kept.count() == sum(not _brute_hits(t, items)[1] for _, t in rows)
    assert decontaminate.find_benchmark(frame(shared, rows), bench.limit(0)).where("size(spans) > 0").count() == 0


def test_suffix_array_in_memory_and_on_disk():
    rng = random.Random(5)
    for _ in range(60):
        alphabet = rng.choice([b"ab", b"a", b"abcdefgh", bytes(range(256))])
        strings = [bytes(rng.choices(alphabet, k=rng.choice([0, 1, 5, 40]))) for _ in range(rng.randint(0, 5))]
        s = [x for t in strings for x in [*(b + 2 for b in t), 1]] + [0]
        cap = rng.choice([3, 100])
        for memory, reduced in ((1 << 20, 1 << 20), (7, 4)):
            with induced.Workspace(memory, reduced) as space:
                order, lcp, _ = induced.suffix_array(strings, cap, space)
                order, lcp = order.tolist(), lcp.tolist()
            assert sorted(order) == list(range(len(s)))
            for i in range(1, len(s)):
                a, b = s[order[i - 1]:], s[order[i]:]
                k = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
                assert lcp[i] == min(k, cap) and (k >= cap or a[:k + 1] < b[:k + 1])


def _brute_removed(rows, length):
    """(bytes, removed, runs, kept) of each row by its place in (doc_id, hash) order."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    key = lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    seen, out = set(), {}
    for k in sorted({(*key(r), r[1]) for r in rows}, key=lambda k: k[:3]):
        raw = (k[3] or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone[:-1].astype(np.int8)])) == 1).sum())
        out[k] = (len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return [out[(*key(r), r[1])] for r in rows]


@pytest.mark.parametrize("hot", [2, 64])
def test_suffix_dedup_equals_brute_force(shared, monkeypatch, hot):
    monkeypatch.setattr(suffixdedup, "HOT_PIECES", hot)
    monkeypatch.setattr(suffixdedup, "CHUNK_BYTES", 700)
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdé ", k=180))
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    rows = [(i, text(rng.randint(0, 300)) + passage[rng.randint(0, 40):rng.randint(100, 180)] + text(rng.randint(0, 200)))
            for i in range(40)]
    base = text(2500)
    rows += [(100 + i, base[:i * 200] + "#" + base[i * 200:]) for i in range(8)]
    rows += [(200, "ab" * 400), (201, "x" * 900), (202, "ab" * 60 + "x" * 300), (203, None), (204, ""), (205, "short"),
             (None, base), (None, base[::-1]), (None, "q" * 150), (206, base), (206, base), (207, passage), (207, base), (208, "é" * 400)]
    # Ids beyond what a float holds, and a negative one.
    rows += [((1 << 60) + i, text(150) + base[300 * i:300 * i + 400]) for i in range(4)] + [((1 << 60) + 1, passage), (-5, passage + "!")]
    got = suffixdedup.remove_repeats(frame(shared, rows)).collect()
    assert len(got) == len(rows)
    want = {(r[0], r[1]): w for r, w in zip(rows, _brute_removed(rows, 100), strict=True)}
    for r in got:
        kept, removed = bytes(r["kept"]), sum(s["end"] - s["begin"] for s in r["removed"])
        assert want[r["doc"]["doc_id"], r["doc"]["text"]] == (len(kept) + removed, removed, len(r["removed"]),
                                                              hashlib.sha256(kept).hexdigest())
    assert suffixdedup.remove_repeats(frame(shared, [])).count() == 0
    cut = suffixdedup.without_repeats(frame(shared, rows))
    assert cut.columns == frame(shared, []).columns and cut.where("doc_id = 203 and text is null").count() == 1


def _brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_equal_brute_force(shared):
    rng = random.Random(7)
    base = [" ".join(rng.choices(["La", "le", "É", "go", "x1"], k=40)) for _ in range(10)]
    rows = [(i, base[i % 10] + (" end" if i % 3 == 0 else "")) for i in range(60)]
    rows += [(70, None), (71, " \t"), (72, "One two"), (73, "one TWO"), (None, "one two"), (74, "a b c"), (75, base[0]), (75, base[0])]
    got = simhash.group_near_duplicates(frame(shared, rows).select("doc_id", "text", F.col("text").alias("again"))).collect()
    assert len(got) == len(rows)
    fp = {t: _brute_fingerprint(t) for _, t in rows}
    label = {f: f for f in fp.values()}
    for _ in label:
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for i, t in rows:
        if i is not None:
            least[label[fp[t]]] = min(i, least.get(label[fp[t]], i))
    for r in got:
        assert r["fp"] & (1 << 64) - 1 == fp[r["again"]] and r["component_id"] == least[label[fp[r["again"]]]]
    kept = simhash.one_per_group(frame(shared, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.one_per_group(frame(shared, [])).count() == 0


def test_vantage_point_search_finds_every_pair():
    rng = np.random.default_rng(0)
    f = [rng.integers(0, 2 ** 63, 200, dtype=np.uint64)]
    for _ in range(6):
        f.append(f[-1] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)))
    f = np.unique(np.concatenate(f))
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 2
    label = np.arange(len(f))
    for _ in range(8):
        label = np.array([label[near[i]].min() for i in range(len(f))])
    assert (simhash.link(f, np.arange(len(f)), np.arange(len(f)), 2) == label).all()
    router = simhash.Router(f, 40)
    row, leaf, home = router.route(f)
    assert router.leaves > 8 and sorted(row[home].tolist()) == list(range(len(f)))
    at = dict(zip(row[home].tolist(), leaf[home].tolist(), strict=True))
    reached = set(zip(row.tolist(), leaf.tolist(), strict=True))
    # Of every pair one is at the other's home.
    assert all((a, at[b]) in reached or (b, at[a]) in reached for a, b in zip(*np.nonzero(near), strict=True))


def test_routing_sends_few_copies():
    """Random fingerprints, the worst case for boundaries: below four rows a class at a million classes."""
    f = np.random.default_rng(1).integers(0, 2 ** 63, 1_000_000, dtype=np.uint64) * np.uint64(2)
    sample = f[:simhash.SAMPLE]
    router = simhash.Router(sample, simhash.SHARD_ROWS * len(sample) / len(f), 2)
    row, leaf, home = router.route(f[::50])
    sizes = np.bincount(leaf[home], minlength=router.leaves) * 50
    assert len(row) < 4 * len(f[::50]) and sizes.max() < 2 * simhash.SHARD_ROWS and router.leaves > 40


def test_fingerprints_of_many_copies_are_joined_apart(shared, monkeypatch):
    texts = [f"some text number {i % 7} of the copies" for i in range(60)] + ["one more that is like no other text here"] + [None] * 5
    docs = frame(shared, [(i if i % 9 else None, t) for i, t in enumerate(texts)])
    key = lambda r: tuple(map(str, r))      # noqa: E731
    want = sorted(simhash.group_near_duplicates(docs).collect(), key=key)
    monkeypatch.setattr(simhash, "HOT_ROWS", 5)
    monkeypatch.setattr(simhash, "MAX_HOT", 3)
    assert sorted(simhash.group_near_duplicates(docs).collect(), key=key) == want and len(want) == len(texts)


def test_leader_weights_equal_a_plain_loop(monkeypatch):
    """Follow-the-regularised-leader, coordinate by coordinate in plain Python."""
    monkeypatch.setattr(langid, "L1", 0.05)     # so that some weights are zero on these few rows
    rng = np.random.default_rng(4)
    rows, labels, buckets, langs = [], [], 12, 3
    for i in range(30):
        at = np.sort(rng.choice(buckets, 4, replace=False))
        x = rng.random(4)
        rows.append((at, x / np.linalg.norm(x)))
        labels.append(i % langs)
    got, bias = langid.fit_ftrl(rows, np.array(labels), buckets, langs)
    z = [[0.0] * langs for _ in range(buckets + 1)]
    n = [[0.0] * langs for _ in range(buckets + 1)]

    def weight(j, k):
        l1 = 0.0 if j == buckets else langid.L1 * len(rows)
        if abs(z[j][k]) <= l1:
            return 0.0
        step = (langid.BETA + n[j][k] ** 0.5) / langid.ALPHA + langid.L2 * len(rows)
        return -(z[j][k] - (l1 if z[j][k] > 0 else -l1)) / step

    order = np.random.default_rng(7)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(rows)):
            terms = [*zip(rows[i][0].tolist(), rows[i][1].tolist()), (buckets, 1.0)]
            w = {(j, k): weight(j, k) for j, _ in terms for k in range(langs)}
            scores = [sum(x * w[j, k] for j, x in terms) for k in range(langs)]
            e = [np.exp(s - max(scores)) for s in scores]
            p = [v / sum(e) for v in e]
            for k in range(langs):
                for j, x in terms:
                    g = x * (p[k] - (k == labels[i]))
                    z[j][k] += g - ((n[j][k] + g * g) ** 0.5 - n[j][k] ** 0.5) / langid.ALPHA * w[j, k]
                    n[j][k] += g * g
    want = np.array([[weight(j, k) for k in range(langs)] for j in range(buckets + 1)])
    assert np.allclose(got, want[:-1], atol=1e-6) and np.allclose(bias, want[-1]) and (want[:-1] == 0).any()


def test_language_held_out_accuracy_and_odd_rows(shared):
    docs = shared.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    out = langid.predict_language(docs, model).select("doc.*", "lang_pred", "score").where(langid.remainder() == 2)
    right = out.where("lang = lang_pred").count() / out.count()
    assert right >= 0.97 and out.where("score < 0 or score > 1").count() == 0
    assert (model.weights == 0).mean() > 0.3 and model.temperature > 0
    rows = [(1, None), (2, ""), (3, "12 !! 34"), (5, "½ ² ③"), (4, "é"), (None, "the of and"), (4, "é")]
    got = langid.predict_language(frame(shared, rows), model).select("doc.doc_id", "doc.text", "lang_pred", "score").collect()
    assert {r["lang_pred"] == "und" for r in got if r["doc_id"] in (1, 2, 3, 5)} == {True}
    assert all(r["lang_pred"] in model.langs for r in got if r["doc_id"] in (4, None))
    none = langid.train(docs.limit(0))
    assert none.predict("text") == ("und", 0.0) and none.langs == []
    assert langid.predict_language(frame(shared, []), model).count() == 0


def test_language_is_known_by_evidence(shared):
    """Random letters and unlearned scripts go, whatever their score; the training documents stay."""
    docs = shared.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    rng = random.Random(2)
    letters = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))        # noqa: E731
    odd = [(i, letters("bcdfghjklmnpqrstvwxz   ", 300)) for i in range(20)] + [(100 + i, letters("абвгдежзиклмнопрст  ", 80)) for i in range(20)]
    odd += [(200 + i, letters("あいうえおかきくけこさしすせそ", 60)) for i in range(20)] + [(300, "123"), (301, None)]
    why = [r["why"] for r in langid.judged_languages(frame(shared, odd), model).collect()]
    assert why.count("unlike training") >= 58 and why[-2:] == ["no letters"] * 2
    plain = [(i, t) for i, t in enumerate(["The token = 9004e046e75240f42eecdbd3dffbc7f3d75db0ff", "the <|endoftext|> of and", "OK.", "Haus"])]
    assert [r["why"] for r in langid.judged_languages(frame(shared, plain), model).collect()].count("unlike training") == 0
    kept = langid.judged_languages(docs, model).groupBy("why").count().collect()
    counts = {r["why"]: r["count"] for r in kept}
    lost = docs.count() - counts[None]
    assert lost == counts.get("no letters", 0) + counts.get("unlike training", 0) + counts.get("near chance", 0) and lost <= 3
    assert langid.with_language(docs, model).columns == docs.columns


def test_spill_goes_to_the_folders_of_spark(shared, tmp_path, monkeypatch):
    here = shared.sparkContext.parallelize([0], 1).map(lambda _: induced.spill_folder()).first()
    assert here and ("blockmgr" in here or "spark" in here)
    monkeypatch.setenv("SPARK_LOCAL_DIRS", f"/no/such/folder,{tmp_path}")
    with induced.Workspace(memory_rows=4) as space:
        space.array(100, np.int64)[:] = 7
        assert len(list(tmp_path.iterdir())) == 1
    assert not list(tmp_path.iterdir())


def test_suffix_shards_follow_the_bytes_of_the_open_pieces(shared, monkeypatch):
    run = "".join(chr(97 + i * i % 23) + str(i) for i in range(80))
    docs = shared.createDataFrame([(i, f"{i} head {'xyz'[i % 3] * i} " + run + f" tail {i * 7919}") for i in range(12)], "doc_id long, text string")
    cut, counts = suffixdedup._cut_pieces, []
    monkeypatch.setattr(suffixdedup, "_cut_pieces", lambda n, length: counts.append(n) or cut(n, length))
    want = {r["doc_id"]: r["text"] for r in suffixdedup.without_repeats(docs).collect()}
    monkeypatch.setattr(suffixdedup, "SHARD_BYTES", 16)
    assert {r["doc_id"]: r["text"] for r in suffixdedup.without_repeats(docs).collect()} == want
    assert run in want[0] and all(run not in want[i] for i in range(1, 12))
    assert counts[1] > counts[0] == suffixdedup.SPREAD * int(shared.conf.get("spark.sql.shuffle.partitions"))


def test_suffix_dedup_leaves_no_shuffle_files(shared):
    from pathlib import Path

    folders = shared._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    there = lambda: {f for d in folders for f in Path(d.toString()).rglob("shuffle_*.data")}     # noqa: E731
    before = there()
    same = " ".join(f"word{i}" for i in range(60))
    docs = frame(shared, [(i, f"{i} {same} {i}") for i in range(40)])
    out = suffixdedup.remove_repeats(docs)      # the steps before the last one are done
    left = {f for f in there() - before if f.exists()}
    assert not left
    assert shared.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert sum(len(r["removed"]) > 0 for r in out.select("removed").collect()) == 39
