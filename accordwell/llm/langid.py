"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of fixed length, forwards and backwards; each window starts
from the zero state, and a softmax labels every byte. A document's probabilities are the mean
over all its bytes. Training is plain numpy: backpropagation through time and Adam, on a
bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_task, fit_sample, held_out, portions

#: Documents to fit on.
FIT_DOCS = 3000
WINDOW, FIT_WINDOW, SPACE = 256, 128, 32
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """Parameters of the two directions (index 0 forwards, 1 backwards) and the output layer."""

    def __init__(self, languages: list[str], hidden: int = 12, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        self.params = {}
        for d in "01":
            self.params["x" + d] = draw(3 * hidden, 256, s=0.3)
            self.params["u" + d] = draw(3 * hidden, hidden, s=hidden**-0.5)
            self.params["w" + d] = draw(len(languages), hidden, s=hidden**-0.5)
        self.params["b"] = np.zeros((len(languages), 1), np.float32)

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 400, batch: int = 256, rate: float = 0.02, seed: int = 11) -> "ByteGRU":
        """``windows``: bytes, a row each; ``labels``: the row's language number. Languages are drawn equally often."""
        rng = np.random.default_rng(seed)
        rows = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.params.items()}
        for step in range(1, steps + 1):
            truth = rng.integers(0, len(rows), batch)
            pick = np.array([rows[k][rng.integers(0, len(rows[k]))] for k in truth])
            grads = self._gradients(np.ascontiguousarray(windows[pick].T), truth)
            at = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                self.params[k] -= at * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def _gradients(self, seq: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions; ``seq`` is positions by rows."""
        p, h, (steps, batch) = self.params, self.hidden, seq.shape
        tapes, outs = {}, {}
        for d in "01":
            order = range(steps) if d == "0" else range(steps - 1, -1, -1)
            state = np.zeros((h, batch), np.float32)
            tape, out = [], np.empty((steps, h, batch), np.float32)
            for t in order:
                a, u = p["x" + d][:, seq[t]], p["u" + d] @ state
                z, r = _sigmoid(a[:h] + u[:h]), _sigmoid(a[h : 2 * h] + u[h : 2 * h])
                n = np.tanh(a[2 * h :] + r * u[2 * h :])
                tape.append((t, state, z, r, n, u[2 * h :]))
                state = n + z * (state - n)
                out[t] = state
            tapes[d], outs[d] = tape, out
        logits = p["w0"] @ outs["0"] + p["w1"] @ outs["1"] + p["b"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        delta = e / e.sum(axis=1, keepdims=True)
        delta[:, truth, np.arange(batch)] -= 1
        delta /= steps * batch
        grads = {"b": delta.sum(axis=(0, 2))[:, None]}
        flat = seq.ravel()
        for d in "01":
            grads["w" + d] = np.einsum("tcb,thb->ch", delta, outs[d])
            back = np.einsum("ch,tcb->thb", p["w" + d], delta)
            gu, da = np.zeros_like(p["u" + d]), np.empty((steps, 3 * h, batch), np.float32)
            later = np.zeros((h, batch), np.float32)
            for t, before, z, r, n, un in reversed(tapes[d]):
                dh = back[t] + later
                dan = dh * (1 - z) * (1 - n * n)
                daz = dh * (before - n) * z * (1 - z)
                dar = dan * un * r * (1 - r)
                da[t, :h], da[t, h : 2 * h], da[t, 2 * h :] = daz, dar, dan
                du = np.concatenate([daz, dar, dan * r])
                gu += du @ before.T
                later = dh * z + p["u" + d].T @ du
            grads["u" + d] = gu
            grads["x" + d] = np.stack([np.bincount(flat, weights=da[:, j].ravel(), minlength=256) for j in range(3 * h)]).astype(np.float32)
        return grads


class Labeller:
    """Labels every byte of windows; buffers are made once."""

    def __init__(self, model: ByteGRU, rows: int = 2048) -> None:
        h, c = model.hidden, len(model.languages)
        self.rows, self.h, self.c = rows, h, c
        p = model.params
        # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2: the halves go into the weights
        half = np.repeat(np.array([0.5, 0.5, 1], np.float32), h)[:, None]
        self.x = [np.ascontiguousarray(p["x" + d] * half) for d in "01"]
        self.u = [np.ascontiguousarray(p["u" + d] * half) for d in "01"]
        self.w, self.b = [p["w0"], p["w1"]], p["b"]

    def run(self, seq: np.ndarray, lengths: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """``seq``: positions by windows; ``lengths``: bytes of each window that are text, the rest is padding.

        Returns the sums of the probabilities over a window's text, languages by windows, and the positions' labels."""
        steps, rows = seq.shape
        h, c = self.h, self.c
        ahead = np.empty((steps, c, rows), np.float32)
        total = np.zeros((c, rows), np.float32)
        labels = np.empty((steps, rows), np.uint8) if marks else None
        a, u = np.empty((3 * h, rows), np.float32), np.empty((3 * h, rows), np.float32)
        e = np.empty((c, rows), np.float32)
        for d in (0, 1):
            state = np.zeros((h, rows), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(self.x[d], seq[t], axis=1, out=a, mode="clip")
                np.matmul(self.u[d], state, out=u)
                gates = a[: 2 * h]
                gates += u[: 2 * h]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                fresh, un = a[2 * h :], u[2 * h :]
                un *= a[h : 2 * h]
                fresh += un
                np.tanh(fresh, out=fresh)
                state -= fresh
                state *= a[:h]
                state += fresh
                if d == 0:
                    np.matmul(self.w[0], state, out=ahead[t])
                    continue
                np.matmul(self.w[1], state, out=e)
                e += ahead[t]
                e += self.b
                if marks:
                    labels[t] = e.argmax(axis=0)
                e -= e.max(axis=0)
                np.exp(e, out=e)
                e *= (t < lengths) / e.sum(axis=0)
                total += e
        return total, labels


def cut_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of each window of documents that lie in ``data`` from starts to ends."""
    counts = -(-(ends - starts) // WINDOW)
    doc = np.repeat(np.arange(len(starts)), counts)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[doc] + k * WINDOW
    return doc, at, np.minimum(WINDOW, ends[doc] - at)


def gather(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The windows' bytes, positions by windows, padded with spaces."""
    if not len(data):
        return np.full((WINDOW, len(at)), SPACE, np.uint8)
    index = at[None, :] + np.arange(WINDOW)[:, None]
    seq = data[np.minimum(index, len(data) - 1)]
    seq[np.arange(WINDOW)[:, None] >= lengths[None, :]] = SPACE
    return seq


def training_windows(text: str) -> list[bytes]:
    """The whole text in windows of ``FIT_WINDOW`` bytes; the last one ends with the text, a shorter text is padded."""
    raw = text.encode("utf-8", "replace")
    last = max(0, len(raw) - FIT_WINDOW)
    return [raw[k : k + FIT_WINDOW].ljust(FIT_WINDOW) for k in [*range(0, last, FIT_WINDOW), last]]


def fit_language_model(docs: DataFrame, fit_docs: int = FIT_DOCS, steps: int = 400) -> ByteGRU:
    """Learn from text and lang of the rows that aren't held out and have both.

    About ``fit_docs`` documents, by a hash of doc_id and text, are taken with their whole texts: a bounded sample of rows, fitted in one task.
    Of rows with equal doc_id and text the smallest lang counts. No such rows, or an empty table: a model without languages.
    The sample is bounded in rows, not in characters: its whole texts meet in that task.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sample = fit_sample(known, fit_docs, known.count(), "doc_id", "text").select("hash_", "text", "lang")

    def fit(rows: pa.Table) -> ByteGRU:
        names = rows.column("lang").to_pylist()
        languages = sorted(set(names))
        if len(languages) < 2:
            return ByteGRU(languages)
        windows = [training_windows(t) for t in rows.column("text").to_pylist()]
        truth = np.repeat([languages.index(n) for n in names], [len(w) for w in windows])
        flat = np.frombuffer(b"".join(x for w in windows for x in w), np.uint8).reshape(-1, FIT_WINDOW)
        return ByteGRU(languages).fit(flat, truth, steps=steps)

    return fit_in_task(sample, fit)


class Pooler:
    """Languages and probabilities of whole texts."""

    def __init__(self, model: ByteGRU) -> None:
        self.languages = model.languages
        self.labeller = Labeller(model) if len(model.languages) > 1 else None

    def pool(self, texts: pa.Array, marks: bool = False) -> tuple[list[str], np.ndarray, list[bytes]]:
        """(language, score, label of every byte if asked) of each text."""
        raw = texts.fill_null("").cast(pa.binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        sizes = offsets[1:] - offsets[:-1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        known = [bool(self.languages) and any(map(str.isalpha, t or "")) for t in texts.to_pylist()]
        pooled = np.zeros((len(raw), max(1, len(self.languages))))
        found: list[list[bytes]] = [[] for _ in range(len(raw))]
        if self.labeller:
            doc, at, lengths = cut_windows(data, offsets[:-1], offsets[1:])
            for b in range(0, len(doc), self.labeller.rows):
                own = slice(b, b + self.labeller.rows)
                sums, labels = self.labeller.run(gather(data, at[own], lengths[own]), lengths[own], marks)
                np.add.at(pooled, doc[own], sums.T)
                if marks:
                    for j, (i, n) in enumerate(zip(doc[own], lengths[own])):
                        found[i].append(labels[:n, j].tobytes())
        else:
            pooled += sizes[:, None]
        pooled /= np.maximum(1, sizes)[:, None]
        best = pooled.argmax(axis=1)
        names = [self.languages[i] if x else UNKNOWN for i, x in zip(best, known)]
        score = np.where(known, np.clip(pooled[np.arange(len(best)), best], 0, 1), 0.0)
        return names, score, [b"".join(x) for x in found]


def identify_languages(docs: DataFrame, model: ByteGRU, marks: bool = False) -> DataFrame:
    """Label every byte of every whole text and pool the document's probabilities.

    Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, held_out, lang_pred, score (mean
    probability of that language over the text's bytes); with ``marks`` also labels, a binary with the language
    number of every byte. A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing
    could be learned. Equal probabilities: the first language by name. Repeated rows are each labelled. A very long text is
    labelled window by window, whole; it shares a batch with no other. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(model)
        for batch in batches:
            for part in portions(batch, 1, 1000):
                names, score, labels = pooler.pool(part.column(1), marks)
                columns = {
                    "doc_id": part.column(0),
                    "held_out": part.column(2),
                    "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(score, pa.float64()),
                }
                if marks:
                    columns["labels"] = pa.array(labels, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out")
    )
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return narrow.mapInArrow(run, schema + ", labels binary" if marks else schema)


def keep_identified(docs: DataFrame, model: ByteGRU, least: float) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of at least ``least``; all columns are kept, whatever their names. Null and letterless texts go; rows that repeat are judged alike; empty tables stay empty; long texts are read whole."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(model)
        for batch in batches:
            for part in portions(batch, place, 1000):
                names, score, _ = pooler.pool(part.column(place))
                yield part.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, score)]))

    return docs.mapInArrow(run, docs.schema)
