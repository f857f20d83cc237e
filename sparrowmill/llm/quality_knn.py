"""Quality by votes of the nearest labelled documents in a latent semantic space.

Terms are words and the shapes of tokens (letters as A or a, digits as 0, runs shortened), and
marks for how much of a text repeats.  Weights are log counts times inverse document frequency; the
singular vectors of the labelled documents' matrix span the latent space.  The labelled
vectors are broadcast (at most `SAMPLE` x `DIMENSIONS` floats, under 1 MB), each block of documents is
multiplied with all of them, and the `NEAREST` most similar vote with their similarity.  Votes
count per label in inverse proportion to the label's frequency, so that the rarer label isn't outvoted.

The labelled rows for the fit are at most `SAMPLE`, chosen by the hash of doc_id among rows whose
crc32(doc_id as text) mod 5 isn't 0; every document is scored.  Labels, lang, source and doc_id are no inputs.

Vectors are rounded to multiples of 2^-14, so their products and the votes are sums of whole numbers,
which come out the same in any order and block.  Ties: all rows as similar as the `NEAREST`-th vote.

Defined results: null, empty and blank texts score 0; texts without a known term, and all texts
if there are no labels of both kinds, score PRIOR; of rows of `labels` that repeat a doc_id the lower label
counts; repeated rows get equal results; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, pick, table, texts_of

SAMPLE, TERMS, DIMENSIONS, NEAREST, BLOCK = 4_000, 2_048, 48, 25, 256
THRESHOLD, PRIOR, SCALE = 0.3, 0.5, 1 << 14
_RUNS = re.compile(r"a+|A+|0+|([^\sa-zA-Z0])\1+")


class _Shapes(dict):
    """str.translate table: letters to a or A, digits to 0, the rest stays."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = out = ord("A") if c.isupper() else ord("a") if c.isalpha() else ord("0") if c.isdigit() else code
        return out


_SHAPES = _Shapes()


def _run(m: re.Match) -> str:
    s = m.group()
    return s[0] if len(s) == 1 or s[0] == "a" else s[0] * 2


def terms(text: str) -> Counter:
    """Term counts of a text."""
    words = Counter(text.split())
    if not words:
        return words
    total, most = words.total(), max(words.values())
    shapes: Counter = Counter()
    for w, n in words.items():
        shapes["\0" + _RUNS.sub(_run, w.translate(_SHAPES))[:12]] += n
    lines = [x for x in text.split("\n") if x.strip()]
    out = Counter({w.lower(): n for w, n in words.items() if len(w) < 24})
    out.update(shapes)
    out["\1variety%d" % min(9, 10 * len(words) // total)] = 1 + total // 4
    out["\1most%d" % min(9, 10 * most // total)] = 1 + total // 4
    out["\1lines%d" % min(9, 10 * len(set(lines)) // len(lines))] = 1 + total // 8
    out["\1length%d" % min(16, total.bit_length())] = 2
    return out


class Model(NamedTuple):
    vocabulary: dict[str, int]
    idf: np.ndarray
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, of length SCALE, in whole numbers
    labels: np.ndarray  # 0 or 1 for each labelled row
    weights: np.ndarray  # of a vote for 0 and for 1: 1 / frequency of the label

    def vector(self, text: str) -> np.ndarray:
        known = self.vocabulary
        found = [(known[t], n) for t, n in terms(text).items() if t in known]
        if not found:
            return np.zeros(self.axes.shape[1])
        at, n = np.array(found).T
        w = np.log1p(n) * self.idf[at]
        return whole((w / np.linalg.norm(w)) @ self.axes[at])

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), PRIOR)
        for a in range(0, len(texts), BLOCK) if len(self.vectors) else ():
            near = np.maximum(np.array([self.vector(t) for t in texts[a : a + BLOCK]]) @ self.vectors.T, 0)
            k = min(NEAREST, near.shape[1])
            near[near < np.partition(near, near.shape[1] - k, axis=1)[:, [near.shape[1] - k]]] = 0
            votes = np.column_stack([near[:, self.labels == c].sum(axis=1) for c in (0, 1)]) * self.weights
            total = votes.sum(axis=1)
            out[a : a + BLOCK] = np.where(total > 0, votes[:, 1] / np.where(total > 0, total, 1), PRIOR)
        return np.where([bool(t) and not t.isspace() for t in texts], out, 0.0)


def whole(v: np.ndarray) -> np.ndarray:
    """Vectors of length SCALE, rounded."""
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.rint(v / np.maximum(size, 1e-9) * SCALE)


EMPTY = Model({}, np.zeros(0), np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(2))


def fit(texts: list[str], quality: list[int]) -> Model:
    y = np.array(quality)
    if not len(y) or y.min() == y.max():
        return EMPTY
    bags = [terms(t) for t in texts]
    df = Counter(t for bag in bags for t in bag)
    chosen = sorted((t for t, n in df.items() if n >= 3), key=lambda t: (t[0] > "\1", -df[t], t))[:TERMS]
    if not chosen:
        return EMPTY
    at = {t: k for k, t in enumerate(chosen)}
    idf = np.log((1 + len(bags)) / (1 + np.array([df[t] for t in chosen]))) + 0.05
    x = np.zeros((len(bags), len(chosen)), np.float32)
    for r, bag in enumerate(bags):
        for t in bag.keys() & at.keys():
            x[r, at[t]] = bag[t]
    x = np.log1p(x) * idf.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    # singular vectors by subspace iteration; the start is fixed
    d = min(DIMENSIONS, *x.shape)
    q = np.random.default_rng(5).standard_normal((len(chosen), d)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    share = np.bincount(y, minlength=2) / len(y)
    return Model(at, idf, q.astype(np.float64), whole(x.astype(np.float64) @ q), y, 1 / share)


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = pick(labels, "doc_id", "quality").where("quality IN (0, 1) AND doc_id IS NOT NULL")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # each label gives half of the sample at most, so the rarer one is well covered
    parts = [rows.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for k in (0, 1)]
    # `sample` rows of 12 bytes: the broadcast is bounded.
    got = pick(docs, "doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id").dropDuplicates(["doc_id"])
    texts, quality = [], []
    for r in sorted(got.collect(), key=lambda r: r["doc_id"]):
        texts.append(r["text"] or "")
        quality.append(int(r["quality"]))
    return fit(texts, quality)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batch: pa.RecordBatch) -> dict:
        s = Model(*shared.value).scores(texts_of(batch.column(1)))
        return {"doc_id": batch.column(0), "score": pa.array(s, pa.float64())}

    out = map_batches(pick(docs, "doc_id", "text"), run, "doc_id long, score double")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", F.coalesce(rest, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op3_quality_knn": query}
