"""Periodic runs of words by harmonic grid probing.

A run of period p and 2p words or more holds two neighbours jp and (j+1)p of the grid of p, and they are equal; so equality at all
neighbours of all grids, about n log n probes for n words, misses no run. Survivors are extended both ways, chunk by
chunk, all at once. Periods are taken by octaves, where none is a multiple of another. A grid point within a run found
before, whose period divides the grid's, is skipped: it leads to that run again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions
from .hashing import WORDS

#: A run has at least so many words.
LEAST = 12
#: Probes made, and words compared, at a time.
PROBES, COMPARED = 1 << 20, 1 << 20
#: Words of documents that are searched together.
TOGETHER = 1 << 16

Rewrite = Callable[[int | None, list[str]], list[str]]


def _probes(first: int, last: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, grid point jp) for periods ``first`` to ``last`` where (j+1)p < n, in portions."""
    p = first
    while p <= last:
        sizes = (n - 1) // np.arange(p, min(last, p + PROBES) + 1)
        few = max(1, int(np.searchsorted(np.cumsum(sizes), PROBES)))
        periods, sizes = np.repeat(np.arange(p, p + few)[: len(sizes)], sizes[:few]), sizes[:few]
        steps = np.arange(len(periods)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield periods, steps * periods
        p += few


def _reach(ids: np.ndarray, at: np.ndarray, period: np.ndarray, way: int, width: int) -> np.ndarray:
    """How many of the ``width`` places from ``at`` on, forwards or backwards, are equal to the place a period later, up to the first that isn't."""
    out = np.empty(len(at), np.int64)
    steps = way * np.arange(width)
    for k in range(0, len(at), rows := max(1, COMPARED // width)):
        places = at[k : k + rows, None] + steps
        later = places + period[k : k + rows, None]
        fits = (places >= 0) & (later < len(ids))
        same = fits & (ids[np.clip(places, 0, len(ids) - 1)] == ids[np.clip(later, 0, len(ids) - 1)])
        out[k : k + rows] = np.where(same.all(1), width, same.argmin(1))
    return out


def _extend(ids: np.ndarray, period: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs that survivors belong to, each once."""
    need = np.maximum(least - period, period)  # equal places that a run has
    right, left = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
    more_right, more_left = np.ones(len(at), bool), np.ones(len(at), bool)
    width = 8
    while len(at) and (more_right.any() or more_left.any()):
        go = np.flatnonzero(more_right)
        got = _reach(ids, at[go] + right[go], period[go], 1, width)
        right[go], more_right[go] = right[go] + got, got == width
        go = np.flatnonzero(more_left)
        got = _reach(ids, at[go] - 1 - left[go], period[go], -1, width)
        left[go], more_left[go] = left[go] + got, got == width
        alive = more_right | more_left | (left + right >= need)
        # a grid point within the stretch of the one before it, of the same period, leads to the same run
        alive[1:] &= (period[1:] != period[:-1]) | (at[1:] >= at[:-1] + right[:-1])
        at, period, right, left, more_right, more_left, need = (x[alive] for x in (at, period, right, left, more_right, more_left, need))
        width = min(4 * width, COMPARED)
    return at - left, at + right + period, period


def find_runs(ids: np.ndarray, least: int = LEAST, longest: int | None = None) -> np.ndarray:
    """All runs of ``ids``, rows (start, length, smallest period), by start and period; those of periods up to ``longest`` if it is given."""
    n, found = len(ids), np.empty((0, 3), np.int64)
    most = n // 2 if longest is None else min(longest, n // 2)
    octave = 1
    while octave <= most:
        new = []
        for period, at in _probes(octave, min(2 * octave - 1, most), n):
            hit = ids[at] == ids[at + period]
            period, at = period[hit], at[hit]
            if len(found) and len(at):
                order = np.argsort(at, kind="stable")
                sorted_at, skip = at[order], np.zeros(len(at), bool)
                for start, end, q in found[found[:, 1] - found[:, 0] > octave]:
                    i, j = np.searchsorted(sorted_at, (start, end))
                    some = order[i:j]
                    skip[some[(period[some] % q == 0) & (at[some] + period[some] < end)]] = True
                period, at = period[~skip], at[~skip]
            if len(at):
                new.append(np.stack(_extend(ids, period, at, least), 1))
        if new:
            runs = np.concatenate(new)
            found = np.concatenate([found, np.unique(runs[runs[:, 1] - runs[:, 0] >= np.maximum(least, 2 * runs[:, 2])], axis=0)])
        octave *= 2
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return np.stack([found[:, 0], found[:, 1] - found[:, 0], found[:, 2]], 1)


def runs_of_documents(documents: list[list[str]], least: int = LEAST) -> list[np.ndarray]:
    """``find_runs`` for each document. Documents of similar lengths are searched together, end to end, with no number in common, so no run passes a border."""
    out, none = [np.empty((0, 3), np.int64)] * len(documents), np.empty(0, np.int64)
    order = [k for k in sorted(range(len(documents)), key=lambda k: len(documents[k])) if len(documents[k]) >= least]
    while order:
        sizes = np.cumsum([len(documents[k]) for k in order])
        some = order[: max(1, int(np.searchsorted(sizes, TOGETHER, "right")))]
        order, starts = order[len(some) :], np.append(0, sizes[: len(some)])
        ids = np.concatenate([none, *(np.fromiter(map({}.setdefault, documents[k], count(int(at))), np.int64, len(documents[k])) for k, at in zip(some, starts))])
        runs = find_runs(ids, least, len(documents[some[-1]]) // 2)
        cut = np.searchsorted(runs[:, 0], starts)
        for k, i, j, at in zip(some, cut, cut[1:], starts):
            out[k] = runs[i:j] - [at, 0, 0]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay if every run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """One in ten documents, by the checksum of its id, repeats words from some place on, with a period that depends on it too. A null id changes nothing."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _collapse(rewrite: Rewrite | None, least: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, text = pa.int64(), pa.string()
        for batch in batches:
            for part in portions(batch, 1):
                rows, texts = [], [WORDS.findall(t or "") for t in part.column(1).to_pylist()]
                if rewrite:
                    texts = list(map(rewrite, part.column(0).to_pylist(), texts))
                for words, runs in zip(texts, runs_of_documents(texts, least)):
                    kept = words if not len(runs) else [words[k] for k in np.flatnonzero(kept_words(len(words), runs))]
                    rows.append((runs, " ".join(kept)))
                n_runs = pa.array([len(r) for r, _ in rows], longs)
                if digests:
                    best = [r[np.lexsort((r[:, 2], r[:, 0], -r[:, 1]))[0]].tolist() if len(r) else (None,) * 3 for r, _ in rows]
                    hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                    columns = {"start": [b[0] for b in best], "length": [b[1] for b in best], "period": [b[2] for b in best], "exponent_milli": [b[2] and 1000 * b[1] // b[2] for b in best]}
                    arrays = [pa.array(c, longs) for c in columns.values()]
                    arrays += [pa.array([hexed("".join("%d,%d,%d\n" % tuple(x) for x in r.tolist())) for r, _ in rows], text), pa.array([hexed(k) for _, k in rows], text)]
                    names = [*columns, "runs_sha256", "collapsed_sha256"]
                else:
                    one = pa.struct([("start", longs), ("length", longs), ("period", longs)])
                    arrays = [pa.array([[dict(zip(("start", "length", "period"), x)) for x in r.tolist()] for r, _ in rows], pa.list_(one)), pa.array([k for _, k in rows], text)]
                    names = ["runs", "collapsed"]
                yield pa.RecordBatch.from_arrays([part.column(0), n_runs, *arrays], names=["doc_id", "n_runs", *names])

    return run


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None, least: int = LEAST) -> DataFrame:
    """Each document's runs (start, length, smallest period; by start and period) and its text with every run collapsed to one period, words joined by one space.

    Columns: doc_id, n_runs, runs, collapsed. ``rewrite`` may change the words first. Null and wordless texts have no runs and an empty ``collapsed``;
    rows that repeat are treated alike; empty tables give empty tables; other columns aren't read. Texts are read whole; their work grows as n log n with the words.
    """
    kind = "doc_id long, n_runs long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_collapse(rewrite, least, False), kind)


def run_digests(docs: DataFrame, rewrite: Rewrite | None = planted) -> DataFrame:
    """``periodic_runs`` with the longest run (of equal ones the first, then the shortest period; nulls if there is none) and digests of runs and kept words."""
    kind = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_collapse(rewrite, LEAST, True), kind)
