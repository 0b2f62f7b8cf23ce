"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: hashed counts of the lower-cased text's 1-, 2- and 3-grams of characters,
weighted by inverse document frequency and scaled to unit length.  Document frequencies
come from ALL training documents (one distributed pass).  The weights are fitted by
follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) on a bounded
sample, and one temperature is fitted on a part of the sample that the weights never saw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import session, tidy

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SAMPLE_PER_LANG = 400       # documented bound: expected training texts per language
MAX_LANGS = 1_000           # bounds the model's size: BUCKETS x MAX_LANGS weights
UNDETERMINED = "und"
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 2e-3, 1e-3
NEAR_CHANCE = 1.1           # a document is rejected if its best language is below this times an even share ...
SEEN_SHARE = 0.002          # ... or if too few n-grams of its letters are in buckets that this share of the training documents have:
LEAST_EVIDENCE = 0.9        # less than this share of them,
EVIDENCE_SLACK = 1.5        # with so many standard errors (one over the root of their number) to spare, so short texts stay
CHUNK_CHARS = 1 << 18       # long texts are counted in pieces of this size, so memory stays flat
_TRAIN = "bucket int, df long, doc_id long, lang string, part int, at binary, x binary"
_TRAIN_NAMES = [c.split()[0] for c in _TRAIN.split(", ")]
_LETTER = regex.compile(r"\p{L}")
_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}']+")
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def gram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the text's hashed character n-grams (float32, whole text)."""
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = np.zeros(buckets, dtype=np.int64)
    longest = max(ORDERS)
    for lo in range(0, len(cp), CHUNK_CHARS):
        piece = cp[lo:lo + CHUNK_CHARS + longest - 1]
        grams = np.zeros(len(piece), dtype=np.uint32)
        for n in range(1, longest + 1):
            m = len(piece) - n + 1
            if m <= 0:
                break
            grams = grams[:m] * _MIX[0] + piece[n - 1:n - 1 + m] + np.uint32(n)
            if n in ORDERS:
                code = grams * _MIX[1]
                code ^= code >> np.uint32(15)
                code *= _MIX[2]
                code >>= shift
                total += np.bincount(code[:CHUNK_CHARS], minlength=buckets)
    return total.astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray         # float32[buckets]
    weights: np.ndarray     # float32[buckets, langs]
    bias: np.ndarray        # float64[langs]
    temperature: float
    seen: np.ndarray | None = None      # bool[buckets]: buckets that enough training documents have

    def features(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf
        norm = float(np.sqrt(np.dot(x, x)))
        return x / np.float32(norm) if norm > 0 else x

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return self.features(counts).astype(np.float64) @ self.weights + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language (ties: first by name) and its calibrated probability."""
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        p = _softmax(self.logits(gram_counts(text, len(self.idf))) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])

    def evidence(self, text: str | None) -> float:
        """Share of the n-grams of the text's letters that training has seen, and the slack that their number allows."""
        if self.seen is None or not has_letter(text):
            return 0.0
        counts = gram_counts(" " + _NO_LETTERS.sub(" ", text).strip() + " ", len(self.idf))
        n = float(counts.sum())
        return float(counts[self.seen].sum()) / n + EVIDENCE_SLACK / n ** 0.5


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int,
             n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from sparse rows (indices, values).

    The last coordinate is the bias (value 1, no L1).  ``z`` and ``n`` are the leader's sums;
    a coordinate stays exactly zero while |z| is within the L1 penalty.
    """
    z = np.zeros((buckets + 1, n_langs))
    n = np.zeros((buckets + 1, n_langs))
    order = np.random.default_rng(7)
    l1 = L1 * len(rows)
    l1_of = np.full((buckets + 1, 1), l1)
    l1_of[-1] = 0.0

    def solve(at: np.ndarray) -> np.ndarray:
        za = z[at]
        step = (BETA + np.sqrt(n[at])) / ALPHA + L2 * len(rows)
        return np.where(np.abs(za) <= l1_of[at], 0.0, -(za - np.sign(za) * l1_of[at]) / step)

    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], buckets), np.append(rows[i][1], 1.0)
            w = solve(at)
            p = _softmax(x @ w)
            p[labels[i]] -= 1.0
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = solve(np.arange(buckets + 1))
    return w[:-1].astype(np.float32), w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss (golden-section search on its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def remainder() -> F.col:
    """crc32(doc_id as text) mod 4; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, buckets: int = BUCKETS, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on the documents with a language, a text with a letter, and a remainder other than 2.

    Language counts and document frequencies cover all of them.  The weights use a hash
    sample of about ``sample_per_lang`` texts a language, whatever the input size; of
    these, the ones with remainder 3 only fit the temperature.
    """
    session(docs)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"), remainder().alias("part")) \
        .where("lang is not null and text is not null and part <> 2")
    per_lang = {r["lang"]: r["count"] for r in
                rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(per_lang) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not per_lang:
        return Model([], np.zeros(buckets, np.float32), np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0)
    share = F.create_map([x for k, v in per_lang.items()
                          for x in (F.lit(k), F.lit(min(1.0, sample_per_lang / v)))])
    # By id and text: an id (or null) that many rows hold is not drawn as a whole; repeated rows are drawn once.
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.withColumn("sampled", draw < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, df) of the partition, and the sampled texts' counts."""
        df, n = np.zeros(buckets, dtype=np.int64), 0
        empty = lambda k, t: pa.nulls(k, t)
        for batch in batches:
            ids, langs = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist()
            parts, sampled = batch.column("part").to_pylist(), batch.column("sampled").to_pylist()
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                if not has_letter(text):
                    continue
                counts = gram_counts(text, buckets)
                df += counts > 0
                n += 1
                if sampled[i]:
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays(
                        [empty(1, pa.int32()), empty(1, pa.int64()), pa.array([ids[i]], pa.int64()),
                         pa.array([langs[i]], pa.string()), pa.array([int(parts[i])], pa.int32()),
                         pa.array([at.astype("<u4").tobytes()], pa.binary()),
                         pa.array([counts[at].astype("<f4").tobytes()], pa.binary())], names=_TRAIN_NAMES)
        at = np.flatnonzero(df)
        at, c = np.append(at, buckets), np.append(df[at], n)    # the last bucket holds the documents
        k = len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(c, pa.int64()), empty(k, pa.int64()), empty(k, pa.string()),
             empty(k, pa.int32()), empty(k, pa.binary()), empty(k, pa.binary())], names=_TRAIN_NAMES)

    # One pass; frequencies meet in one row per bucket, sampled rows pass through by their id.
    out = (rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "part", "sampled")
           .mapInArrow(tidy(run), _TRAIN)
           .groupBy("bucket", "doc_id", "lang", "part", "at", "x").agg(F.sum("df").alias("df")).collect())
    idf, df, n_docs = np.zeros(buckets, dtype=np.float32), np.zeros(buckets), 0
    for r in out:
        if r["bucket"] == buckets:
            n_docs = r["df"]
    for r in out:
        if r["bucket"] is not None and r["bucket"] < buckets:
            idf[r["bucket"]] = np.log((1 + n_docs) / (1 + r["df"])) + 1
            df[r["bucket"]] = r["df"]
    langs = sorted({r["lang"] for r in out if r["at"] is not None})
    sample = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["part"], bytes(r["at"]), bytes(r["x"]))
                     for r in out if r["at"] is not None))
    model = Model(langs, idf, np.zeros((buckets, len(langs)), np.float32), np.zeros(len(langs)), 1.0, df >= max(1, SEEN_SHARE * n_docs))
    fit, held = [], []
    for _, _, lang, part, at, x in sample:
        at, x = np.frombuffer(at, "<u4").astype(np.int64), np.frombuffer(x, "<f4") * idf[np.frombuffer(at, "<u4")]
        x = x / max(1e-12, float(np.sqrt(np.dot(x, x))))
        (held if part == 3 else fit).append((at, x.astype(np.float64), langs.index(lang)))
    fit = fit or held
    model.weights, model.bias = fit_ftrl([r[:2] for r in fit], np.array([r[2] for r in fit]), buckets, len(langs))
    logits = np.array([x @ model.weights[at] + model.bias for at, x, _ in held]).reshape(len(held), len(langs))
    model.temperature = fit_temperature(logits, np.array([r[2] for r in held], dtype=np.int64))
    return model


def predict_language(docs: DataFrame, model: Model, evidence: bool = False) -> DataFrame:
    """doc (struct of the input row), lang_pred, score; with ``evidence`` that of :meth:`Model.evidence` too.

    One output row per input row; only the text is looked at.  A text that is null or has no
    letter, or any text under a model without languages, gives ``und`` with score 0.
    Repeated rows give repeated results; extra columns stay inside ``doc``; an empty
    table gives an empty result.
    """
    spark = session(docs)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0).field("text")]
            found = [m.predict(t) for t in texts]
            more = [pa.array([m.evidence(t) for t in texts], pa.float64())] if evidence else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), *more],
                names=["doc", "lang_pred", "score", "evidence"][:3 + evidence])

    rows = docs.select(F.struct("*").alias("doc"))
    return rows.mapInArrow(tidy(run), T.StructType([rows.schema["doc"], *T.StructType.fromDDL(
        "lang_pred string, score double" + ", evidence double" * evidence).fields]))


def judged_languages(docs: DataFrame, model: Model, min_score: float | None = None) -> DataFrame:
    """:func:`predict_language` and ``why``: null for a document that stays, else why its language is not known.

    ``no letters``; ``unlike training``: the evidence is below ``LEAST_EVIDENCE``, as in a language that is not
    among the learned ones or in random letters; ``near chance``: the best
    score is below ``min_score`` (default: clearly above an even share of all languages, so that short but ordinary
    texts stay).
    """
    if min_score is None:
        min_score = NEAR_CHANCE / max(2, len(model.langs))
    why = (F.when(F.col("lang_pred") == UNDETERMINED, "no letters")
           .when(F.col("evidence") < LEAST_EVIDENCE, "unlike training")
           .when(F.col("score") < min_score, "near chance"))
    return predict_language(docs, model, evidence=True).withColumn("why", why)


def with_language(docs: DataFrame, model: Model, min_score: float | None = None) -> DataFrame:
    """The documents whose language is known (:func:`judged_languages`); their own columns."""
    return judged_languages(docs, model, min_score).where("why is null").select("doc.*")
