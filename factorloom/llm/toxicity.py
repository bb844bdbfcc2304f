"""Toxic passages as maximum-scoring segments of token log-odds.

A token is a word or, where the word is too rare to tell, a beginning of it. Its score is the log-odds of
toxic against other documents with an informative Dirichlet prior (the tokens' shares in both), if
that is significant; every other token costs a drift. A linear-time scan finds all maximal segments,
not only the best. Over clean text the best segment of n words follows an extreme-value law, P(max < S) =
exp(-K n exp(-lambda S)): lambda solves sum p_i exp(lambda s_i) = 1 over the scores s_i of clean tokens, and K is
fitted to the clean texts' maxima by greatest likelihood. A document's evidence is the sum of
lambda S - ln(K n) over the segments where it is positive, and a logistic curve fitted on the
training sample turns it into a score.

Rows: a null text is the empty text; a text without toxic tokens has no segment and the curve's base
score; repeated rows are each scored; an empty table gives no rows; without toxic labels no token
scores. Only doc_id, text and the labels are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm import common, words

#: Labelled documents that tokens' odds come from, about.
SAMPLE_DOCS = 20_000
#: Lengths of the beginnings that stand for rare words.
STEMS = (7, 6, 5, 4, 3)
#: Weight of the prior, in documents; least log-odds, and standard deviations above 0, of a scoring token.
PRIOR_DOCS = 50.0
LEAST_ODDS = 1.5
LEAST_Z = 3.0
DRIFT = 0.25
MOST_SCORE = 6.0
THRESHOLD = 0.7

SCORE = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Model:
    """Scores of tokens (stems end in '*'), the law of clean segments and the final curve."""

    tokens: dict[str, float]
    rate: float
    constant: float
    slope: float
    base: float

    def word_scores(self, names: list[str]) -> np.ndarray:
        """The score of each word: its own, else that of its longest scoring stem, else 0."""
        get, stems = self.tokens.get, tuple(k for k in STEMS if any(t.endswith("*") and len(t) == k + 1 for t in self.tokens))
        out = np.zeros(len(names))
        for i, w in enumerate(names):
            s = get(w, 0.0)
            if not s:
                for k in stems:
                    if len(w) >= k and (s := get(w[:k] + "*", 0.0)):
                        break
            out[i] = s
        return out


def segments(at: np.ndarray, score: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, one past last, score) of a row of tokens, in linear time.

    `at` are the places of the scoring tokens, ascending; each token between costs `drift`. Each
    segment on the stack knows the last one before it whose left sum is smaller, so no search goes over
    the same segments twice.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, past last, the earlier segment
    total, done = 0.0, 0
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (p - done)
        left, first = total, p
        total += s
        done = p + 1
        k = len(stack) - 1
        while True:
            while k >= 0 and stack[k][0] >= left:
                k = stack[k][4]
            if k < 0 or stack[k][1] >= total:
                stack.append((left, total, first, done, k))
                break
            left, first, before = stack[k][0], stack[k][2], stack[k][4]
            del stack[k:]
            k = before
    return [(a, b, r - left) for left, r, a, b, _ in stack]


def hit_scores(model: Model, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and scores of the scoring tokens of each text that has any."""
    for row, _, _, score in _hits(model, texts):
        yield row, score


def found(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """Row, number of words and segments of each text that has a scoring token."""
    for row, n, at, score in _hits(model, texts):
        yield row, n, segments(at, score)


def _hits(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    coded, names = words.words(texts)
    score = model.word_scores(names)[coded.values] if names else np.zeros(0)
    hits = np.flatnonzero(score)
    row = np.searchsorted(coded.offsets, hits, side="right") - 1
    n = coded.lengths()
    for group in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(row)) + 1) if len(hits) else ():
        r = int(row[group[0]])
        yield r, int(n[r]), hits[group] - coded.offsets[r], score[hits[group]]


def evidence(model: Model, texts: pa.Array) -> np.ndarray:
    """Sum over a text's segments of how far they are beyond chance."""
    out = np.zeros(len(texts))
    for row, n, own in found(model, texts):
        floor = np.log(model.constant * n)
        out[row] = sum(max(0.0, model.rate * s - floor) for _, _, s in own)
    return out


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.base + model.slope * np.log1p(evidence(model, texts)), -35, 35)))


def _counts(sample: DataFrame) -> DataFrame:
    """Documents of each label that hold each token: token, toxic, other."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            coded, names = words.words(common.as_text(part.column("text")))
            toxic = part.column("label").to_numpy(zero_copy_only=False) > 0
            every = [(i, w) for i, w in enumerate(names)]
            tokens = [w for _, w in every] + [w[:k] + "*" for k in STEMS for _, w in every if len(w) >= k]
            of = np.concatenate([np.arange(len(names)), *(np.array([i for i, w in every if len(w) >= k], np.int64) for k in STEMS)]).astype(np.int64)
            flat = pa.array(tokens, pa.large_string()).dictionary_encode()
            code = flat.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(of, kind="stable")
            lens = np.bincount(of, minlength=len(names))
            spread, ends = words.gather(code[order], np.cumsum(lens) - lens, lens, coded.values)
            row, token, _ = words.counted(words.Ragged(spread, np.concatenate([[0], ends])[coded.offsets]))
            n = len(flat.dictionary)
            return pa.record_batch([flat.dictionary.cast(pa.string()), pa.array(np.bincount(token[toxic[row]], minlength=n)), pa.array(np.bincount(token[~toxic[row]], minlength=n))], ["token", "toxic", "other"])

        return kernel

    return common.map_text(sample, "text", make, "token string, toxic long, other long", 4_000_000).groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def train(docs: DataFrame, labels: DataFrame, folder: str, column: str = "toxic", bound: int = SAMPLE_DOCS) -> Model:
    """Learn token scores, the extreme-value law and the curve from about `bound` labelled documents that are not held out."""
    sample = common.written(common.labelled_sample(docs, labels, column, bound).groupBy("text").agg(F.max("label").alias("label")), f"{folder}/sample")
    sizes = {r.label: r.n for r in sample.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        p = (n_toxic + 1) / (n_toxic + n_other + 2)
        return Model({}, 1.0, 1.0, 0.0, float(np.log(p / (1 - p))) if n_toxic + n_other else -1.0)
    share = (F.col("toxic") + F.col("other")) / F.lit(float(n_toxic + n_other))
    a, b = F.col("toxic") + PRIOR_DOCS * share, F.col("other") + PRIOR_DOCS * share
    odds = F.log(a / (n_toxic + PRIOR_DOCS - a)) - F.log(b / (n_other + PRIOR_DOCS - b))
    telling = _counts(sample).where("toxic >= 3").select("token", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")).where((F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z))
    tokens = {r.token: min(MOST_SCORE, r.odds) for r in telling.collect()}
    # scores of clean words, and segments of all training texts, under these tokens
    first = Model(tokens, 1.0, 1.0, 0.0, 0.0)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = common.as_text(part.column("text"))
            n = words.hashed_words(texts).lengths()
            per: list[list[float]] = [[] for _ in range(len(texts))]
            hits: list[list[float]] = [[] for _ in range(len(texts))]
            for row, _, own in found(first, texts):
                per[row] = [s for _, _, s in own]
            for row, scores in hit_scores(first, texts):
                hits[row] = scores.tolist()
            return pa.record_batch([pa.array((part.column("label").to_numpy(zero_copy_only=False) > 0).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(per, pa.list_(pa.float64())), pa.array(hits, pa.list_(pa.float64()))], ["label", "n", "segments", "hits"])

        return kernel

    rows = common.map_text(sample, "text", make, "label int, n long, segments array<double>, hits array<double>").toArrow().to_pylist()
    clean = [r for r in rows if not r["label"]]
    rate, constant = law(np.array([r["n"] for r in clean], float), np.array([max(r["segments"], default=0.0) for r in clean]), np.array([s for r in clean for s in r["hits"]]), tokens)
    gathered = np.array([sum(max(0.0, rate * s - np.log(constant * r["n"])) for s in r["segments"]) for r in rows])
    slope, base = curve(np.log1p(gathered), np.array([r["label"] for r in rows], float))
    return Model(tokens, rate, constant, slope, base)


def law(n: np.ndarray, best: np.ndarray, hits: np.ndarray, tokens: dict[str, float], drift: float = DRIFT) -> tuple[float, float]:
    """lambda and K of the extreme-value law from clean texts: their words, best segments (0: none), and scoring tokens.

    Without a scoring token in clean text the least score stands in, once. A text without a segment has a
    maximum somewhere below the least score, which the likelihood counts as such.
    """
    least = min(tokens.values(), default=1.0)
    hits = hits if len(hits) else np.array([least])
    words_ = max(float(n.sum()), len(hits) + 1.0)
    rest = (words_ - len(hits)) / words_
    low, high = 1e-4, 50.0
    for _ in range(80):  # the positive root; below it the sum is under 1, as the mean score is negative
        mid = (low + high) / 2
        total = np.exp(np.minimum(700, mid * hits)).sum() / words_ + rest * np.exp(-mid * drift)
        low, high = (low, mid) if total > 1 else (mid, high)
    rate, some = (low + high) / 2, best > 0
    exposed = (n[some] * np.exp(-rate * best[some])).sum() + (n[~some] * np.exp(-rate * least)).sum()
    return rate, float((some.sum() + 1) / max(1e-9, exposed + 1e-9))


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """Slope and base of a logistic curve, by Newton's method with a small ridge."""
    w = np.zeros(2)
    z = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        gradient = z.T @ (p - y) + ridge * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return float(max(0.0, w[0])), float(w[1])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Score and decision for every document."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            s = scores(model, common.as_text(part.column("text")))
            return pa.record_batch([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return kernel

    return common.scored(docs, make, SCORE)


def passages(docs: DataFrame, model: Model, most_expected: float = 0.01) -> DataFrame:
    """Every significant passage: doc_id, first and past-last word, score, chance of such a segment in the text, its words."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = common.as_text(part.column("text"))
            ids = part.column("doc_id").to_pylist()
            out = []
            for row, n, own in found(model, texts):
                names = words.words_of(texts[row].as_py())
                for a, b, s in own:
                    expected = model.constant * n * float(np.exp(-model.rate * s))
                    if expected <= most_expected:
                        out.append((ids[row], a, b, s, float(-np.expm1(-expected)), " ".join(names[a:b])))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "first_word", "end_word", "score", "p_value", "passage"])

        return kernel

    return common.map_text(docs.select("doc_id", "text"), "text", make, "doc_id long, first_word long, end_word long, score double, p_value double, passage string")
