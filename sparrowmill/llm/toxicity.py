"""Toxicity as a cumulative-link ordinal regression on sparse word counts.

P(grade <= k | x) = sigmoid(theta_k - w.x): one weight vector for all thresholds, which stay in
order because their gaps are exponentials.  The labels say toxic or not, so grades come from
them and from evidence of other documents: 0 for a document that isn't labelled toxic; for a toxic one 1, 2 or 3
by the number of its words (under 4, 4 to 8, more) that the toxic documents of the other half of the sample
use far more often than others.  So no document's grade follows from words chosen on it, and every sampled row is kept.

The model is fitted on the driver from the word counts of at most `SAMPLE` labelled rows, half of them toxic at most,
chosen by the hash of their doc_id, with features from at most `FEATURES` words; both are documented bounds of a fit, and
every document is scored.

Defined results: null and empty texts have no features, severity near 0 and aren't rejected;
repeated rows get equal results; without labels of both kinds nothing is rejected; an empty
table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin, discard, map_batches, pick, small, stash, table, texts_of

WORD = re.compile(r"[^\W\d_]+")
SAMPLE, FEATURES, LEAST_DOCS, LEAST_Z, RATIO = 4_000, 512, 4, 6.0, 20
#: Toxic documents that use a word, if few labels leave no better evidence.
LEAST_ANY = 3
GRADES = (4, 9)
REJECT = 0.5
#: How many times worse it is to reject a share of the clean documents than to keep the same share of the toxic ones.
CALM = 5.0


class Model(NamedTuple):
    """words -> weight, and the thresholds between the grades 0, 1, 2 and 3."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def grades(self, text: str) -> np.ndarray:
        """Probability of each grade."""
        return probabilities(self.score(text), self.thresholds)

    def score(self, text: str) -> float:
        known = self.weights
        counts = Counter([w for w in WORD.findall(text.lower()) if w in known])
        return sum(known[w] * math.log1p(n) for w, n in sorted(counts.items()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def probabilities(score: float, thresholds: tuple[float, ...]) -> np.ndarray:
    up = np.concatenate([[0.0], _sigmoid(np.array(thresholds) - score), [1.0]])
    return np.diff(up)


def evidence(bags: list[Counter], toxic: np.ndarray) -> dict[str, float]:
    """z of the difference between a word's shares of toxic and of other documents, for words that pass LEAST_Z."""
    df = [Counter(), Counter()]
    for bag, t in zip(bags, toxic):
        df[int(t)].update(bag.keys())
    return evidence_of(df[0], df[1], int((toxic == 0).sum()), int(toxic.sum()))


def evidence_of(df0: dict[str, int], df1: dict[str, int], n0: int, n1: int) -> dict[str, float]:
    """`evidence` from the numbers of other (0) and toxic (1) documents that use a word; words of under LEAST_ANY toxic ones don't matter."""
    out = {}
    for w, a in df1.items():
        b = df0.get(w, 0)
        if a >= LEAST_DOCS:
            share = (a + b) / (n0 + n1)
            z = (a / n1 - b / n0) / math.sqrt(max(share * (1 - share), 1e-9) * (1 / n0 + 1 / n1))
            if z > LEAST_Z and a * n0 > RATIO * b * n1:
                out[w] = z
    if not out:  # few labels: the best words that only toxic documents use
        only = sorted(((a, w) for w, a in df1.items() if a >= LEAST_ANY and not df0.get(w)), key=lambda x: (-x[0], x[1]))
        out = {w: 1.0 for _, w in only[:FEATURES]}
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:FEATURES])


def crossed_grades(bags: list[Counter], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 3: a toxic document's hits are counted with the evidence of the half of the rows it isn't in."""
    half = np.arange(len(bags)) % 2
    hits = np.zeros(len(bags), np.int64)
    for k in (0, 1):
        rows = np.flatnonzero(half != k)
        found = evidence([bags[r] for r in rows], toxic[rows]) if len(set(toxic[rows].tolist())) == 2 else {}
        for r in np.flatnonzero(half == k).tolist():
            hits[r] = sum(n for w, n in bags[r].items() if w in found)
    return _grades(hits, toxic)


def _grades(hits: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    return np.where(toxic == 1, 1 + np.searchsorted(GRADES, hits, side="right"), 0)


def likelihood(params: np.ndarray, x: np.ndarray, grade: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Weighted mean log-likelihood of the grades, less the penalty, and its gradient.  `params`: weights, first threshold, logarithms of the gaps."""
    n, k = x.shape[1], len(params) - x.shape[1]
    w, gaps = params[:n], np.exp(params[n + 1 :])
    theta = params[n] + np.concatenate([[0], np.cumsum(gaps)])
    cut = np.concatenate([[-np.inf], theta, [np.inf]])
    s = x @ w
    hi, lo = _sigmoid(cut[grade + 1] - s), _sigmoid(cut[grade] - s)
    hi[grade == k], lo[grade == 0] = 1.0, 0.0
    p = np.maximum(hi - lo, 1e-12)
    dh, dl = weight * hi * (1 - hi) / p, weight * lo * (1 - lo) / p
    g = np.array([dh[grade == j].sum() - dl[grade == j + 1].sum() for j in range(k)])
    grad = np.concatenate([-(x.T @ (dh - dl)), [g.sum()], [g[j:].sum() * gaps[j - 1] for j in range(1, k)]]) / len(s)
    grad[:n] -= l2 * w
    return float((weight * np.log(p)).mean() - 0.5 * l2 * (w @ w)), grad


#: A model by which nothing is toxic.
NONE = Model({}, (40.0, 41.0, 42.0))


def fit(texts: list[str], toxic: list[int], **how) -> Model:
    """The model of these texts; `train` makes the same one of a table without their texts."""
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return NONE
    bags = [Counter(WORD.findall(t.lower())) for t in texts]
    words = list(evidence(bags, y))
    at = {w: k for k, w in enumerate(words)}
    raw = np.zeros((len(bags), len(words)), np.float64)
    for r, bag in enumerate(bags):
        for w in bag.keys() & at.keys():
            raw[r, at[w]] = bag[w]
    return ascend(words, raw, crossed_grades(bags, y), y, **how)


def ascend(words: list[str], raw: np.ndarray, grade: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.3, l2: float = 1e-3) -> Model:
    """Gradient ascent (Adam) on the likelihood of the grades.  `raw`: how often each row has each of `words`."""
    if not words:
        return NONE
    x = np.log1p(raw)
    # toxic documents are few: both kinds weigh the same in the likelihood
    share = np.bincount(y, minlength=2) / len(y)
    weight = 0.5 / share[y]
    k = len(GRADES) + 1
    params = np.concatenate([np.full(len(words), 1.0), [1.0], np.zeros(k - 1)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        _, grad = likelihood(params, x, grade, weight, l2)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        params[len(words) + 1 :] = np.clip(params[len(words) + 1 :], -6, 3)  # a grade that no row has would end at a gap of nothing
    theta = params[len(words)] + np.concatenate([[0], np.cumsum(np.exp(params[len(words) + 1 :]))])
    theta += cut(x @ params[: len(words)], y) - theta[0]
    return Model(dict(zip(words, params[: len(words)].tolist())), tuple(theta.tolist()))


def cut(score: np.ndarray, toxic: np.ndarray) -> float:
    """Where the share of toxic rows from here on and `CALM` times that of others below are the most together; of equal places the middle of the widest gap.

    The first threshold is put here and the others move along: likelihood places it by all grades at once.
    """
    at = np.unique(score)
    below = np.searchsorted(np.sort(score[toxic == 0]), at[1:], side="left") / max(1, (toxic == 0).sum())
    above = 1 - np.searchsorted(np.sort(score[toxic == 1]), at[1:], side="left") / max(1, (toxic == 1).sum())
    if len(at) < 2:
        return float(at[0]) + 1.0
    gain = np.round(CALM * below + above, 9)
    best = np.flatnonzero(gain == gain.max())
    k = int(best[np.diff(at)[best].argmax()])
    return float(at[k] + at[k + 1]) / 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents; the order by hash makes the choice repeatable.

    Texts may be long, so they and their words stay on the executors.  The driver gets the rows' ids, in how many rows the words
    of toxic documents are, and then for each row the counts of the chosen words.
    """
    rows = pick(labels, "doc_id", "toxic").where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [rows.where((F.col("toxic") > 0) == F.lit(k)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for k in (False, True)]
    # `sample` rows of 12 bytes: the broadcast is bounded.
    got = pick(docs, "doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id").dropDuplicates(["doc_id"])
    bags = stash(got.select("doc_id", "toxic", "text").mapInArrow(_bags, "doc_id long, toxic boolean, words array<string>, counts array<int>"))
    ids = sorted((r["doc_id"], r["toxic"]) for r in bags.select("doc_id", "toxic").collect())
    y = np.array([int(t) for _, t in ids])
    model = NONE
    if len(y) and y.min() != y.max():
        place = {i: r for r, (i, _) in enumerate(ids)}
        model = _trained(bags, y, place)
    discard(bags)
    return model


def _bags(batches):
    begin(__name__)
    for batch in (piece for whole in batches for piece in small(whole, 64)):
        counts = [Counter(WORD.findall(t.lower())) for t in texts_of(batch.column(2))]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "toxic": pa.array([t > 0 for t in batch.column(1).to_pylist()], pa.bool_()),
                                          "words": pa.array([list(c) for c in counts], pa.list_(pa.string())), "counts": pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))})


def _trained(bags: DataFrame, y: np.ndarray, place: dict[int, int]) -> Model:
    """The model of `bags`, whose rows are at `place` in the order of their ids and toxic by `y`."""
    half = bags.sparkSession.createDataFrame([(i, r % 2) for i, r in place.items()], "doc_id long, half int")
    used = bags.join(F.broadcast(half), "doc_id").select("toxic", "half", F.explode("words").alias("word"))  # a row for each of the sample
    kinds = [(k, t) for k in (0, 1) for t in (False, True)]
    df = used.groupBy("word").agg(*[F.count_if((F.col("half") == k) & (F.col("toxic") == F.lit(t))).alias(f"n{k}{int(t)}") for k, t in kinds]).where(f"n01 + n11 >= {LEAST_ANY}")
    table_ = [(r["word"], r["n00"], r["n01"], r["n10"], r["n11"]) for r in df.collect()]

    def of(halves: tuple[int, ...]) -> dict[str, float]:
        mine = y[np.isin(np.arange(len(y)) % 2, halves)]
        if len(set(mine.tolist())) < 2:
            return {}
        n = [{r[0]: c for r in table_ if (c := sum(r[1 + 2 * k + t] for k in halves))} for t in (0, 1)]
        return evidence_of(*n, int((mine == 0).sum()), int(mine.sum()))

    words, found = list(of((0, 1))), [of((1,)), of((0,))]  # a row's hits are those of the other half's words
    at = {w: k for k, w in enumerate(words)}

    def counted(batches):
        begin(__name__)
        for batch in (piece for whole in batches for piece in small(whole, 64)):
            raws, hits = [], []
            for i, ws, ns in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = np.zeros(len(at), np.int32)
                for w, n in zip(ws, ns):
                    if w in at:
                        raw[at[w]] = n
                raws.append(raw.tobytes())
                hits.append(sum(n for w, n in zip(ws, ns) if w in found[place[i] % 2]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "hits": pa.array(hits, pa.int64()), "raw": pa.array(raws, pa.binary())})

    hits, raw = np.zeros(len(y), np.int64), np.zeros((len(y), len(words)), np.float64)
    for r in bags.select("doc_id", "words", "counts").mapInArrow(counted, "doc_id long, hits long, raw binary").collect():
        hits[place[r["doc_id"]]] = r["hits"]
        raw[place[r["doc_id"]]] = np.frombuffer(r["raw"], np.int32)
    return ascend(words, raw, _grades(hits, y), y)


def _columns(texts: list[str], model: Model) -> dict:
    score = np.array([model.score(t) for t in texts], np.float64)
    p = np.diff(np.column_stack([np.zeros(len(texts)), _sigmoid(np.array(model.thresholds)[None, :] - score[:, None]), np.ones(len(texts))]), axis=1)
    p_toxic = 1 - p[:, 0]
    return {"severity": pa.array(p @ np.arange(p.shape[1]), pa.float64()), "p_toxic": pa.array(p_toxic, pa.float64()), "grade": pa.array(p.argmax(axis=1).astype(np.int32), pa.int32()), "toxic": pa.array(p_toxic >= REJECT, pa.bool_())}


def graded(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic, grade (likeliest), toxic (p_toxic >= REJECT)."""
    return map_batches(pick(docs, "doc_id", "text"), lambda b: {"doc_id": b.column(0)} | _columns(texts_of(b.column(1)), model),
                       "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that aren't toxic, unchanged and in one pass."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        begin(__name__)
        for batch in (piece for whole in batches for piece in small(whole)):
            bad = _columns(texts_of(batch.column(at)), model)["toxic"].to_pylist()
            yield batch.filter(pa.array([not x for x in bad], pa.bool_()))

    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    return flat.mapInArrow(run, flat.schema).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return graded(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_toxicity": query}
