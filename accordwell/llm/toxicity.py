"""Toxicity scores by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic examples and unlabelled text only; the risk estimator
corrects for the share of toxic documents (the class prior) among the unlabelled ones, and its negative part is
kept from falling below zero (where it does, that part's gradient is taken backwards).

A word's score is the sum of its hashed subword weights, scaled by their number; a document's
log odds are the logarithm of the sum of the exponentials of its distinct words' scores: other words add next to nothing, so a
few toxic words count in a long text as in a short one, and more of them count for more.

The risk isn't convex and a sample may be small, so several fits, each from its own seed, are averaged. Before that each is
calibrated on the unlabelled text that it has seen: two shifts of its bias would make the mean score, or the share of scores that
pass the threshold, equal to the class prior; it takes the middle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_tasks, fit_sample, held_out, portions
from .subwords import WordTable, in_portions, subword_features

#: Toxic and unlabelled documents to fit on.
FIT_TOXIC, FIT_UNLABELLED = 1500, 3000
BITS, LEAST, MOST = 18, 3, 5
THRESHOLD = 0.5
#: One fit for each.
SEEDS = (13, 14, 15)
BLOCK = 1 << 15  # words whose features are made at once
LETTERS = re.compile(r"[^\W\d_]+")


def distinct_words(text: str) -> list[str]:
    return list(set(LETTERS.findall(text.lower())))


def pool(scores: np.ndarray) -> float:
    """Log of the sum of exponentials."""
    top = scores.max()
    return float(top + np.log(np.exp(scores - top).sum()))


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one span after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class PositiveUnlabelled:
    def __init__(self, prior: float) -> None:
        self.prior = prior
        self.weights = np.zeros(1 << BITS)
        self.bias = 0.0

    def fit(self, toxic: list[list[str]], other: list[list[str]], epochs: int = 20, rate: float = 0.1, batch: int = 64, seed: int = 13) -> "PositiveUnlabelled":
        """``toxic`` and ``other``: the distinct words of each confirmed and each unlabelled document."""
        rng = np.random.default_rng(seed)
        number: dict[str, int] = {}
        docs = [np.array([number.setdefault(w, len(number)) for w in words], np.int32) for words in toxic + other]
        words = list(number)
        del number
        parts = [subword_features(words[k : k + BLOCK], BITS, LEAST, MOST) for k in range(0, len(words), BLOCK)]
        features = np.concatenate([np.empty(0, np.int32), *(f.astype(np.int32) for f, _ in parts)])
        counts = np.concatenate([np.empty(0, np.int64), *(n for _, n in parts)])
        starts = np.cumsum(counts) - counts
        positives = [i for i in range(len(toxic)) if len(docs[i])]
        unlabelled = [i for i in range(len(toxic), len(docs)) if len(docs[i])]
        if not positives or not unlabelled:
            return self
        slope, bias_slope = np.zeros(1 << BITS), 0.0  # sums of squared gradients
        steps = epochs * max(1, len(unlabelled) // batch)
        mean, mean_bias = np.zeros(1 << BITS), 0.0  # of the second half of the steps
        for step in range(steps):
            pick = [*rng.choice(positives, batch), *rng.choice(unlabelled, batch)]
            grad, by_doc = self.gradient([(features, starts, counts, docs[i]) for i in pick], batch)
            slope += grad * grad
            self.weights -= rate * grad / (np.sqrt(slope) + 1e-6)
            bias_slope += by_doc.sum() ** 2
            self.bias -= rate * by_doc.sum() / (bias_slope**0.5 + 1e-6)
            if step >= steps // 2:
                mean += self.weights
                mean_bias += self.bias
        self.weights, self.bias = mean / (steps - steps // 2), mean_bias / (steps - steps // 2)
        return self

    def calibrate(self, other: list[list[str]]) -> "PositiveUnlabelled":
        """Shift the bias by what the class prior asks of the scores of unlabelled documents (their distinct words)."""
        scorer = Scorer(self)
        odds = np.array([o for k in range(0, len(other), 500) for o in scorer.odds(other[k : k + 500]) if np.isfinite(o)])
        if len(odds):
            low, high = odds.min() - 30, odds.max() + 30
            for _ in range(60):  # the shift at which the mean score is the prior
                middle = (low + high) / 2
                over = (1 / (1 + np.exp(-np.clip(odds - middle, -30, 30)))).mean() > self.prior
                low, high = (middle, high) if over else (low, middle)
            self.bias -= (low + np.quantile(odds, 1 - self.prior)) / 2
        return self

    def gradient(self, docs: list[tuple], batch: int) -> tuple[np.ndarray, np.ndarray]:
        """Descent direction by weight and by document; ``docs`` are ``batch`` confirmed ones, then unlabelled ones.

        It is the gradient of the corrected risk; where the negatives' part of the risk is below zero, that part's gradient is taken backwards.
        """
        features, starts, counts, _ = docs[0]
        sizes = np.array([len(d[3]) for d in docs])
        words = np.concatenate([d[3] for d in docs])
        n = counts[words]
        used = features[spans(starts[words], n)]
        scale = n**-0.5
        scores = np.add.reduceat(self.weights[used], np.cumsum(n) - n) * scale
        first = np.cumsum(sizes) - sizes
        top = np.maximum.reduceat(scores, first)
        weight = np.exp(scores - np.repeat(top, sizes))
        total = np.add.reduceat(weight, first)
        pooled, by_word = top + np.log(total), weight / np.repeat(total, sizes)
        odds = pooled + self.bias
        sigma = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        p = np.arange(len(docs)) < batch
        # logistic loss: log(1 + exp(-g)) for a positive, log(1 + exp(g)) for a negative
        as_negative = np.logaddexp(0, odds)
        negative = as_negative[~p].mean() - self.prior * as_negative[p].mean()
        share = 1 / np.where(p, batch, max(1, len(docs) - batch))
        # derivatives of the positive part and of the part that stands for the negatives
        up = np.where(p, self.prior * (sigma - 1) * share, 0)
        down = np.where(p, -self.prior * sigma * share, sigma * share)
        by_doc = up + down if negative >= 0 else -down
        back = np.repeat(np.repeat(by_doc, sizes) * by_word * scale, n)
        return np.bincount(used, weights=back, minlength=1 << BITS), by_doc


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_unlabelled: int = FIT_UNLABELLED, seeds: tuple[int, ...] = SEEDS) -> PositiveUnlabelled | None:
    """Learn from rows that aren't held out: those whose label ``toxic`` is 1, and any others as unlabelled text.

    About ``fit_toxic`` and ``fit_unlabelled`` documents, by a hash of doc_id and text, are taken with their whole texts: bounded samples of rows.
    Their distinct words are found where the rows are; each of the ``seeds`` is fitted in one task. The class prior is the share of 1
    among all labels of such rows. Null texts are left out; a doc_id with several labels is toxic if one of them is 1. None without a toxic row.
    The samples are bounded in rows, not in characters: the distinct words of their texts meet in each of those tasks.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic_"))
    seen = known.agg(F.count("*").alias("n"), F.sum("toxic_").alias("toxic")).first()
    if not seen.toxic:
        return None
    text = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("doc_id", "text")
    toxic = fit_sample(text.join(known.where("toxic_ = 1").select("doc_id"), "doc_id"), fit_toxic, seen.toxic, "doc_id", "text")
    other = fit_sample(text, fit_unlabelled, text.count(), "doc_id", "text")
    both = toxic.select("hash_", F.lit(1).alias("toxic"), "text").unionAll(other.select("hash_", F.lit(0).alias("toxic"), "text"))
    prior = seen.toxic / seen.n

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([sorted(distinct_words(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], names=["hash_", "toxic", "words"])

    def fit(rows: pa.Table, seed: int) -> PositiveUnlabelled:
        flag, words = rows.column("toxic").to_pylist(), rows.column("words").to_pylist()
        other = [w for w, f in zip(words, flag) if not f]
        return PositiveUnlabelled(prior).fit([w for w, f in zip(words, flag) if f], other, seed=seed).calibrate(other)

    model, fits = PositiveUnlabelled(prior), fit_in_tasks(both.mapInArrow(split, "hash_ long, toxic int, words array<string>"), fit, seeds)
    if fits:
        model.weights, model.bias = np.mean([f.weights for f in fits], 0), float(np.mean([f.bias for f in fits]))
    return model


class Scorer:
    """Scores whole texts; remembers the words it has seen, up to a bound."""

    def __init__(self, model: PositiveUnlabelled | None) -> None:
        self.model = model
        self.table = WordTable(self._describe)

    def _describe(self, words: list[str]) -> np.ndarray:
        if not words or not self.model:
            return np.zeros(len(words))
        features, counts = subword_features(words, BITS, LEAST, MOST)
        return np.add.reduceat(self.model.weights[features], np.cumsum(counts) - counts) * counts**-0.5

    def odds(self, some: list[list[str]]) -> list[float]:
        """Log odds of documents given by their distinct words."""
        self.table.learn(some)
        return [pool(self.table.rows[self.table.numbers(words)]) + self.model.bias if words and self.model else -np.inf for words in some]

    def score(self, texts: pa.Array) -> np.ndarray:
        odds = [o for some in in_portions([t or "" for t in texts.to_pylist()], distinct_words) for o in self.odds(some)]
        return 1 / (1 + np.exp(-np.clip(np.array(odds, np.float64), -745, 500)))


def score_toxicity(docs: DataFrame, model: PositiveUnlabelled | None) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text; other columns are ignored).

    Per row: doc_id, held_out, score (probability of label 1), predicted (1 from 0.5 on). A text that is null
    or has no letters scores 0, and so does every text without a model. Repeated rows are each scored.
    A very long text counts with all its distinct words. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in portions(batch, 1, 1000):
                score = scorer.score(part.column(1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0),
                        "held_out": part.column(2),
                        "score": pa.array(score, pa.float64()),
                        "predicted": pa.array((score >= THRESHOLD).astype(np.int32)),
                    }
                )

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out")
    )
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: PositiveUnlabelled | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``; all columns are kept, whatever their names. Null and wordless texts stay; rows that repeat are judged alike; empty tables stay empty."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in portions(batch, place, 1000):
                yield part.filter(pa.array(scorer.score(part.column(place)) < threshold))

    return docs.mapInArrow(run, docs.schema)
