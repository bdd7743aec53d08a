"""Quality classifier by positive-unlabelled learning.

Trusted positives (labelled 1) and unlabelled web text train a small network under the non-negative unbiased risk:
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)). No document labelled 0 takes part in any step. The class prior pi of the unlabelled text
is estimated from the two samples: a first network orders them, and pi is the least share of the unlabelled above some
score to that of the positives above it. The raw output becomes a probability by a logistic curve that minimises the unbiased
logistic risk of the same two samples, which is convex; by it the mean probability of unlabelled text is pi.
Inputs are statistics of the whole text alone. Training uses bounded samples chosen by a hash; scoring covers all rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import map_column, text_or_empty

#: Rows of the training samples, about: documents labelled 1, unlabelled ones. Twice as many are never exceeded.
POSITIVE_ROWS, UNLABELLED_ROWS = 20_000, 20_000
THRESHOLD = 0.3
_CLASS = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _c == " " else 4 if _c == "\n" else 5 if _c in ".,;:" else 6 if _c == "!" else 7 if _c == "|" else 8 if _i < 128 else 9
N_FEATURES = 24


def text_features(text: str) -> list[float]:
    """Statistics of a whole text; defined for the empty text too."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(len(raw), 1)
    by = np.bincount(_CLASS[raw], minlength=10) / n if len(raw) else np.zeros(10)
    words = text.split()
    w = max(len(words), 1)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = text.split("\n")
    top = counts.most_common(1)[0][1] if counts else 0
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 0
    return [
        *by, np.log1p(n), np.log1p(len(words)), len(counts) / w, top / w, pairs / max(w - 1, 1), sum(map(str.__eq__, words, words[1:])) / w,
        float(lengths.mean()), float(lengths.std()), sum(map(str.isupper, words)) / w, sum(map(str.istitle, words)) / w,
        len(set(lines)) / len(lines), w / len(lines), (lengths <= 2).mean(), sum(not x[-1:].isalnum() for x in words) / w,
    ]


@dataclass
class Scorer:
    """Standardised features -> hidden layer -> raw output -> calibrated probability."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 600, rate: float = 0.02, seed: int = 3) -> Scorer:
    """Full-batch Adam on the non-negative risk with the sigmoid loss; where the negative part of the risk falls below
    zero, the step raises it instead (gradient of its negation), as the method prescribes."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = unlabelled.mean(0), np.maximum(both.std(0), 1e-6)
    rng = np.random.default_rng(seed)
    d = both.shape[1]
    s = Scorer(mean, scale, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    zp, zu = (np.clip((v - mean) / scale, -6, 6) for v in (positive, unlabelled))
    params = [s.w1, s.b1, s.w2, np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        hp, hu = np.tanh(zp @ params[0] + params[1]), np.tanh(zu @ params[0] + params[1])
        fp, fu = hp @ params[2] + params[3], hu @ params[2] + params[3]
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        # sigmoid loss: as positive 1 - s, as negative s
        negative = su.mean() - prior * sp.mean()
        dp = -prior * sp * (1 - sp) / len(fp)
        if negative >= 0:
            dp, du = 2 * dp, su * (1 - su) / len(fu)
        else:
            dp, du = -dp, -su * (1 - su) / len(fu)
            # gradient of -(R_u(-) - pi R_p(-))
        grads = [0, 0, 0, 0]
        for z, h, df in ((zp, hp, dp), (zu, hu, du)):
            back = np.outer(df, params[2]) * (1 - h**2)
            grads = [grads[0] + z.T @ back, grads[1] + back.sum(0), grads[2] + h.T @ df, grads[3] + df.sum(keepdims=True)]
        for k, p in enumerate(params):
            g = grads[k] + 1e-4 * p
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    s.w1, s.b1, s.w2, s.b2 = params[0], params[1], params[2], float(params[3][0])
    return s


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives among the unlabelled, of scores that neither sample was trained on: the least ratio, over all thresholds,
    of the unlabelled above it to the positives above it, each with a margin for the size of its sample."""
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    margin = lambda n: np.sqrt(np.log(4 / confidence) / (2 * n))
    best = np.argmin((u + margin(len(unlabelled)) + margin(len(positive))) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def calibrate(s: Scorer, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Scorer:
    """Slope a and shift b of the raw output f: the least mean of log(1 + exp(a f + b)) over the unlabelled, less prior times the mean
    of a f + b over the positives, by Newton's method; slightly regularised; the slope stays positive."""
    fu = s.raw(unlabelled)
    at = np.stack([fu, np.ones_like(fu)], 1)
    target, w = prior * np.array([s.raw(positive).mean(), 1.0]), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ w, -30, 30)))
        h = (at.T * np.maximum(p * (1 - p), 1e-6)) @ at / len(fu) + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, target - at.T @ p / len(fu) - 1e-4 * w)
        w = w + np.clip(step, -0.5, 0.5)
        if abs(step).max() < 1e-8:
            break
    s.slope, s.shift = max(float(w[0]), 1e-3), float(w[1])
    return s


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Scorer, float]:
    """The scorer and the class prior. Halves of the samples train the network that orders the other halves for the prior."""
    half = fit_nnpu(positive[::2], unlabelled[::2], 0.5)
    prior = estimate_prior(half.raw(positive[1::2]), half.raw(unlabelled[1::2])) if min(len(positive), len(unlabelled)) > 1 else 0.5
    return calibrate(fit_nnpu(positive, unlabelled, prior), positive, unlabelled, prior), prior


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5: labels of these rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sample(rows: DataFrame, total: int, bound: int) -> np.ndarray:
    """Features of about `bound` of the `total` rows (doc_id, text), chosen by a hash of the row; whole repeated rows are chosen
    together, and 2 * bound rows are the end of it."""
    share, parts = min(1.0, bound / max(total, 1)), 1 << 30
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < int(share * parts))
    if chosen.count() > 2 * bound:  # only where one row repeats very often; a limit brings its rows to one task
        chosen = chosen.limit(2 * bound)

    def run(texts: list[str]) -> dict[str, list]:
        return {"x": [text_features(t) for t in texts]}

    got = map_column(chosen.select("doc_id", "text"), "text", run, "doc_id long, x array<double>", keep=["doc_id"]).collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["x"]))
    return np.array([r["x"] for r in got], float).reshape(len(got), N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Scorer | None:
    """None where there is no positive label or no unlabelled text to learn from. labels: doc_id, quality (null rows ignored,
    repeated ids: the highest). Documents without an id are not learnt from. Extra columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).where(~held_out())
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y is not null and doc_id is not null").where(~held_out())
    good = labels.groupBy("doc_id").agg(F.max("y").alias("y")).where("y = 1").select("doc_id")
    n_good, n_docs = good.count(), docs.count()
    # at most twice the bound of ids, so that they may be sent to every task
    share = min(1.0, positive_rows / max(n_good, 1))
    good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * positive_rows)
    trusted = docs.join(F.broadcast(good), "doc_id", "left_semi")
    positive = _sample(trusted, trusted.count(), positive_rows)
    unlabelled = _sample(docs, n_docs, unlabelled_rows)
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled)[0]


def _scored(rows: DataFrame, scorer: Scorer | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of rows, and the score of their text."""

    def run(texts: list) -> dict[str, list]:
        if scorer is None or not texts:
            return {"score": [0.5] * len(texts)}
        return {"score": scorer.predict(np.array([text_features(t or "") for t in texts], float)).tolist()}

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return map_column(rows, "text", run, f"{kept}, score double", keep)


def score_quality(docs: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1, higher: better) for every row. Null text: empty. Without a scorer (nothing to learn from) every
    score is 0.5, so that nothing is rejected. Repeated rows get equal scores; very long texts are read whole; extra columns are
    ignored; an empty table gives an empty one."""
    return _scored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), scorer, ["id"])


def keep_good(docs: DataFrame, scorer: Scorer | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The input rows, columns unchanged, that score at least `threshold`."""
    others = [F.col(c) for c in docs.columns if c != text_col]
    rows = docs.select((F.struct(*others) if others else F.lit(0)).alias("rest"), F.col(text_col).alias("text"))
    good = _scored(rows, scorer, ["rest", "text"]).where(F.col("score") >= threshold)
    return good.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
