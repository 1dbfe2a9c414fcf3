"""Quality scores by supervised subword embeddings.

A document is the average of learned vectors, one for each hashed word and character n-gram
(and one for a word that repeats the word before it); a softmax over its projection gives the
label's probability. Trained by stochastic gradient descent in numpy on a bounded sample.

A trained model is linear up to the softmax, so a word adds one number and a count; texts are
scored word by word from a table of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_task, fit_sample, held_out, portions
from .subwords import WordTable, in_portions, subword_features

#: Labelled documents to fit on.
FIT_DOCS = 3000
BITS, LEAST, MOST = 17, 3, 4
REPEAT = 1 << BITS  # the feature of a repeated word
THRESHOLD = 0.3


class SubwordClassifier:
    def __init__(self, dim: int = 8, labels: int = 2, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (REPEAT + 1, dim)).astype(np.float32)
        self.output = rng.normal(0, 0.1, (labels, dim)).astype(np.float32)
        self.bias = np.zeros(labels, np.float32)

    def fit(self, documents: list[tuple[np.ndarray, np.ndarray]], truth: np.ndarray, epochs: int = 8, rate: float = 0.3, seed: int = 5) -> "SubwordClassifier":
        """``documents``: (feature numbers, their shares of the document) each."""
        rng = np.random.default_rng(seed)
        step, steps = 0, epochs * len(documents)
        for _ in range(epochs):
            for i in rng.permutation(len(documents)):
                at = rate * (1 - step / steps)
                step += 1
                features, share = documents[i]
                mean = share @ self.vectors[features]
                logits = self.output @ mean + self.bias
                e = np.exp(logits - logits.max())
                error = e / e.sum()
                error[truth[i]] -= 1
                back = self.output.T @ error
                self.output -= (at * error)[:, None] * mean
                self.bias -= 0.1 * at * error
                # a feature's own step counts as if the document had 1 / sum(share**2) of equal weight
                self.vectors[features] -= np.outer(share * (at / (share @ share) ** 0.5), back)
        return self

    def line(self) -> tuple[np.ndarray, float]:
        """What each feature adds to the log odds of label 1 before averaging, and the constant."""
        return self.vectors @ (self.output[1] - self.output[0]), float(self.bias[1] - self.bias[0])


def document_features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for text in texts:
        words = text.split()
        numbers: dict[str, int] = {}
        index = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        features, counts = subword_features(list(numbers), BITS, LEAST, MOST)
        weight = np.repeat(np.bincount(index, minlength=len(numbers)), counts)
        repeats = np.count_nonzero(index[1:] == index[:-1])
        total = weight.sum() + repeats
        own, inverse = np.unique(features, return_inverse=True)
        share = np.bincount(inverse, weights=weight, minlength=len(own))
        if repeats:
            own, share = np.append(own, REPEAT), np.append(share, repeats)
        out.append((own.astype(np.int32), (share / max(1, total)).astype(np.float32)))
    return out


def fit_quality_model(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> SubwordClassifier | None:
    """Learn label ``quality`` from the rows of ``labels`` that aren't held out and have text.

    About ``fit_docs`` documents, by a hash of doc_id and text, are taken with their whole texts: a bounded sample of rows, fitted in one task.
    A doc_id with several labels counts as 1 if one of them is 1. None if the sample has fewer than two kinds of label, as that of an empty table has.
    The sample is bounded in rows, not in characters: its whole texts meet in that task.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("truth_"))
    text = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(known, "doc_id")
    sample = fit_sample(text, fit_docs, known.count(), "doc_id", "text").select("hash_", "text", F.col("truth_").alias("truth"))

    def fit(rows: pa.Table) -> SubwordClassifier | None:
        truth = rows.column("truth").to_pylist()
        if len(set(truth)) < 2:
            return None
        return SubwordClassifier().fit(document_features(rows.column("text").to_pylist()), np.array(truth))

    return fit_in_task(sample, fit)


def score_quality(docs: DataFrame, model: SubwordClassifier | None) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text; other columns are ignored).

    Per row: doc_id, held_out, score (probability of label 1), predicted (1 from 0.3 on). A text that is null
    or has no words gets the score of the constant alone; without a model every score is 0.5. Repeated rows are each scored.
    A very long text is averaged over all its words. An empty table gives an empty result.
    """
    line, constant = model.line() if model else (np.zeros(REPEAT + 1), 0.0)

    def describe(words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, 2))
        features, counts = subword_features(words, BITS, LEAST, MOST)
        return np.stack([np.add.reduceat(line[features].astype(np.float64), np.cumsum(counts) - counts), counts], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(describe)
        for batch in batches:
            for part in portions(batch, 1, 1000):
                scores = []
                for some in in_portions([t or "" for t in part.column(1).to_pylist()], str.split):
                    table.learn(some)
                    for words in some:
                        number = table.numbers(words)
                        total, n = table.rows[number].sum(axis=0) if len(number) else (0.0, 0)
                        repeats = np.count_nonzero(number[1:] == number[:-1])
                        scores.append((total + repeats * line[REPEAT]) / max(1, n + repeats) + constant)
                score = 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
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
