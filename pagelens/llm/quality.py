"""Quality scores by Bradley-Terry pairwise ranking.

A labelled good text should beat a labelled bad one with probability sigmoid(score difference). The score
is linear in features of the text, so a pair's loss is the logistic loss on its feature difference. The
threshold is a quantile of the training scores, and scores are shifted so that it falls on 0.3.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import remainder
from pagelens.llm.rules import measured
from pagelens.llm.textstats import NAMES
from pagelens.session import materialize

#: Labelled rows the classifier is fitted on, about; scoring covers every row.
SAMPLE = 20_000
#: Opponents of each sampled row.
PAIRS = 8
FOLDS = 5
CUT = 0.3
#: Features: shares in [0, 1], their roots (which open the low end) and logarithms of sizes.
SHARES = {
    "symbols": "n_symbols / greatest(word_chars, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)", "upper": "n_upper / greatest(n_letters, 1)",
    "bangs": "n_bangs / greatest(n_words, 1)", "digits": "n_digits / greatest(word_chars, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
}
SIZES = {"words": "log1p(n_words)", "length": "log1p(word_chars / greatest(n_words, 1))", "line": "log1p(n_words / greatest(n_lines, 1))"}
FEATURES = {**SHARES, **{f"{k}_root": f"sqrt({v})" for k, v in SHARES.items()}, **SIZES, **{f"{k}_square": f"{v} * {v}" for k, v in SIZES.items()}}


@dataclass(frozen=True)
class Ranking:
    """Weights of the features and the raw score at the threshold."""

    weights: tuple[float, ...]
    threshold: float

    def score(self) -> Column:
        raw = sum((F.expr(e) * w for e, w in zip(FEATURES.values(), self.weights)), F.lit(0.0))
        return (1 / (1 + F.exp(-(raw - self.threshold + math.log(CUT / (1 - CUT)))))).cast("double")


def fit(x: np.ndarray, good: np.ndarray, seed: int = 7, l2: float = 1e-3) -> Ranking:
    """Newton steps on the pairwise logistic loss; without both labels every text scores the same."""
    if not len(x) or good.all() or not good.any():
        return Ranking((0.0,) * len(FEATURES), -1.0 if len(x) and good.all() else 0.0 if not len(x) else 1.0)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / spread
    rng = np.random.default_rng(seed)
    win, lose = np.nonzero(good)[0], np.nonzero(~good)[0]
    a = np.r_[np.repeat(win, PAIRS), rng.choice(win, len(lose) * PAIRS)]
    b = np.r_[rng.choice(lose, len(win) * PAIRS), np.repeat(lose, PAIRS)]
    d, w = z[a] - z[b], np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + l2 * np.eye(len(w)), d.T @ (1 - p) / len(d) - l2 * w)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    weights = w / spread
    raw = x @ weights
    # the quantile that leaves as many below it as are labelled bad, set halfway to the next score
    ranked = np.sort(raw)
    k = int((~good).sum())
    return Ranking(tuple(float(v) for v in weights), float((ranked[k - 1] + ranked[k]) / 2))


def train(measures: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """Learn from labelled documents outside the held-out fold; a hash of doc_id chooses about ``sample`` of them."""
    rows = measures.join(labels.select(F.col("doc_id").alias("_d"), "quality").filter("quality IN (0, 1)"), F.col("doc_id") == F.col("_d"))
    rows = rows.filter(remainder(F.col("doc_id"), FOLDS) != 0)
    total = rows.count()
    share = min(1.0, sample / max(total, 1))
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * sample)
    order = ["doc_id", "quality", *NAMES]
    got = picked.select(*order, *[F.expr(e).cast("double").alias(f"_f{i}") for i, e in enumerate(FEATURES.values())]).toPandas().sort_values(order)
    x = got[[f"_f{i}" for i in range(len(FEATURES))]].to_numpy(dtype=float)
    return fit(x, got["quality"].to_numpy() == 1)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, from its text alone.

    Null and empty texts are scored as texts without words. Documents without doc_id are scored and count
    as not held out. A label that occurs twice counts twice; labels other than 0 and 1 are left out;
    without usable labels all scores are equal.
    """
    measures = materialize(measured(docs, ("doc_id",)), "measures")
    model = train(measures, labels)
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    out = measures.select("doc_id", held.alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
