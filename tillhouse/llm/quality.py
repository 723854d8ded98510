"""Quality classifier learned from positive and unlabelled documents.

Trusted documents are positive; web text without a label is a mixture of good and bad whose share
of good (the class prior) is estimated from the labelled rows. A logistic model minimises the non-negative
unbiased risk: the risk on positives, plus the risk of the unlabelled as negatives less what the positives
among them account for, never below zero.

Inputs are the style of the whole text only: shares of characters, repetition, lengths. Labels,
ids, language and source are no inputs. The model has a few dozen weights and is fitted on a
bounded sample, chosen by a hash of the id; every document is scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.workspace import Workspace, importable, tidy

# Bounds of the sample that the model is fitted on: documents of each kind.
POSITIVES = 6_000
UNLABELLED = 12_000
THRESHOLD = 0.7
SIGNS = "!#$%&*|/<>{}[]@=_\\^~"

FEATURES = (
    "log_words", "word_length", "long_words", "upper_words", "title_words", "digits", "signs",
    "top_sign", "stops", "other", "distinct", "top_word", "runs", "same_lines", "line_length",
    "short_lines", "bare_ends", "vowels",
)


def features(text: str | None) -> list[float]:
    """Style of a whole text. A null or empty text has all zeros but the first."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    letters = Counter(text)
    size = len(text)
    counts = Counter(words)
    signs = [letters.get(c, 0) for c in SIGNS]
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, words))
    alpha = sum(v for c, v in letters.items() if c.isalpha())
    return [
        math.log1p(n),
        alpha / n / 10,
        sum(len(w) > 20 for w in words) / n,
        upper / n,
        sum(map(str.istitle, words)) / n,
        sum(v for c, v in letters.items() if c.isdigit()) / size,
        sum(signs) / n,
        max(signs) / n,
        (letters.get(".", 0) + letters.get(",", 0)) / n,
        sum(v for c, v in letters.items() if not (c.isalnum() or c.isspace())) / size,
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        sum(x.rstrip()[-1:] not in ".!?:;,\"'" for x in lines) / max(1, len(lines)),
        sum(letters.get(c, 0) for c in "aeiouAEIOU") / max(1, alpha),
    ]


@dataclass(frozen=True)
class Model:
    """Cut points of each feature, and a weight for each of its bins."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        """One-hot bins, so a feature may count against a text at either end."""
        hot = [np.ones((len(x), 1))]
        for j, cut in enumerate(self.cuts):
            hot.append(np.eye(len(cut) + 1)[np.searchsorted(cut, x[:, j], "right")])
        return np.concatenate(hot, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))


def fit(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    bins: int = 12,
    steps: int = 400,
    rate: float = 0.1,
    decay: float | None = None,
) -> Model:
    """Minimise the non-negative unbiased risk of the logistic loss by gradient steps (Adam).

    The risk is ``prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])``. Where the
    bracket falls below zero, the step climbs out of it again instead of going on.
    """
    both = np.concatenate([positive, unlabelled])
    decay = 2 / len(both) if decay is None else decay  # few rows bear only small weights
    inner = np.linspace(0, 1, bins + 1)[1:-1]
    # Tails matter most: rare styles get bins of their own.
    spots = np.unique(np.concatenate([inner, [0.005, 0.01, 0.02, 0.04, 0.96, 0.98, 0.99, 0.995]]))
    cuts = [np.unique(np.quantile(both[:, j], spots)) for j in range(both.shape[1])]
    model = Model(cuts, np.zeros(1), prior)
    p, u = model.design(positive), model.design(unlabelled)
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        # d loss(+) = -(1 - s) x, d loss(-) = s x
        as_good = -prior * (p.T @ (1 - sp)) / len(p)
        as_bad = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        bracket = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        grad = (as_good + as_bad if bracket >= 0 else -as_bad) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(cuts, w, prior)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Documents whose labels are never learned from."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sampled(rows: DataFrame, most: int, total: int) -> np.ndarray:
    """Features of about ``most`` of ``total`` rows, by hash of the id: at most twice as many."""
    share = min(1.0, most / max(1, total))
    kept = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [features(t) for t in batch["text"]]})

    found = kept.select("text").mapInPandas(run, "x array<double>").limit(2 * most).toPandas()
    return np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> Model:
    """Fit on documents that are not held out.

    Labels of the same document that disagree cancel out: only documents that all their labels
    call good are trusted. Without positives every score is the prior, one half.
    """
    importable(docs.sparkSession)
    work = Workspace(docs.sparkSession, "quality")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(~held_out())
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.min(label).alias("good"))
        .filter(~held_out())
    )
    known = work.save(known, "labels")
    count = known.agg(F.count("*").alias("n"), F.sum((F.col("good") == 1).cast("int")).alias("p")).first()
    if not count.p:
        return Model([], np.zeros(1), 0.5)
    # A share of the ids is chosen before the texts meet the labels.
    share = min(1.0, positives / count.p)
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    trusted = rows.filter(chosen).join(known.filter("good = 1").filter(chosen).select("doc_id"), "doc_id", "left_semi")
    p = _sampled(trusted, positives, positives)
    u = _sampled(rows, unlabelled, rows.count())
    if not len(p) or not len(u):
        return Model([], np.zeros(1), 0.5)
    return fit(p, u, count.p / count.n)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, one row per row of ``docs``.

    Null and empty texts are scored as texts without words. Rows without an id are never held out.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([features(t) for t in batch["text"]], float).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.score(x)})

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    scored = rows.mapInPandas(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents that the classifier does not reject, all columns unchanged: a filter in the scan.

    Without trusted documents no model can be fitted, and all documents stay.
    """
    model = train(docs, labels, doc_id, text)
    if not model.cuts:
        return docs

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
                yield pd.Series(model.score(x))

        return tidy(scores)(batches)

    return docs.filter(quality(F.col(text)) >= THRESHOLD)
