"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block of queries by chunk of candidates.
Rounds of global score histograms narrow down, for all queries at once, the interval that
holds the k-th score, until it is one integer wide. A last pass keeps what reaches that score and breaks ties
by id. A task sends only the bins from its own k-th score upwards: lower ones can't hold the global one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

HIST = "query_id long, bin long, n long"
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """vec_id and v, each component floor(scale * x); without vectors null, or with null or non-finite components."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite).select(
        "vec_id", F.transform("x", lambda c: F.floor(F.lit(scale) * c)).alias("v")
    )


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _score_rows(queries: pa.Table, candidates: pa.Table, tile: int = 128):
    """Yields (row number of the query, exact scores as int64, ids), without the query's own rows."""
    if not queries.num_rows or not candidates.num_rows:
        return
    q, c = _matrix(queries), _matrix(candidates)
    own, ids = queries.column("query_id").to_numpy(), candidates.column("vec_id").to_numpy()
    # doubles are exact while no partial sum can pass 2**53; beyond that, Python's integers
    most = [max(map(abs, (int(m.max(initial=0)), int(m.min(initial=0))))) for m in (q, c)]
    kind = np.float64 if most[0] * most[1] * max(1, q.shape[1]) < 2**53 else object
    q, c = q.astype(kind), c.astype(kind).T
    for k in range(0, len(q), tile):
        scores = q[k : k + tile] @ c
        for r, row in enumerate(scores):
            other = ids != own[k + r]
            yield k + r, row[other].astype(np.int64), ids[other]


def exact_top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 10, bins: int = 4096, chunk: int = 16384, block: int = 16384
) -> DataFrame:
    """The k candidates of highest integer inner product for each query, ties to the smaller vec_id.

    Both tables have vec_id and v (array of long); see ``integer_vectors``. A query never
    finds rows with its own vec_id. Repeated candidate rows count as often as they occur; of repeated queries of one
    vec_id the smallest vector counts. Vectors of another length than the query's take no part for it. Fewer than k
    candidates: all. Empty tables give an empty result. Scores must fit 64 bits.
    Returns query_id, rank (from 1), vec_id, score.
    """
    dim = F.size("v").alias("dim")
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v", dim)
    candidates = candidates.select("vec_id", "v", dim)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    seen = candidates.agg(F.count("*").alias("n"), F.max(norm).alias("m")).first()
    asked = queries.agg(F.count("*").alias("n"), F.max(norm).alias("m")).first()
    chunks, blocks = -(-max(1, seen.n) // chunk), -(-max(1, asked.n) // block)
    limit = int(((seen.m or 0.0) * (asked.m or 0.0)) ** 0.5 * (1 + 1e-9)) + 2

    spread = (
        candidates.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(chunks)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .groupBy("dim", "block", "chunk")
    )

    def against_all(asking: DataFrame, work, schema: str) -> DataFrame:
        """Each block of queries against each chunk of candidates."""
        placed = asking.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
            "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
        )
        return placed.groupBy("dim", "block", "chunk").cogroup(spread).applyInArrow(work, schema)

    def histogram(span: int, width: int):
        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            lo, need, own = (left.column(n).to_numpy() for n in ("lo", "need", "query_id"))
            out: tuple[list, list, list] = ([], [], [])
            for r, scores, _ in _score_rows(left, right):
                b = scores - lo[r]
                b = b[(b >= 0) & (b < span)] // width
                if len(b) > need[r]:
                    b = b[b >= np.partition(b, len(b) - need[r])[len(b) - need[r]]]
                value, n = np.unique(b, return_counts=True)
                out[0].append(np.full(len(value), own[r]))
                out[1].append(value)
                out[2].append(n)
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
            return pa.table(dict(zip(("query_id", "bin", "n"), (pa.array(x, pa.int64()) for x in flat))))

        return work

    def select(left: pa.Table, right: pa.Table) -> pa.Table:
        kth, own = left.column("lo").to_numpy(), left.column("query_id").to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        for r, scores, ids in _score_rows(left, right):
            tied = np.sort(ids[scores == kth[r]])[:k]
            above = scores > kth[r]
            if above.sum() > k:  # only where the query has fewer than k candidates is there no k-th score
                order = np.lexsort((ids[above], -scores[above]))[:k]
                found, value = ids[above][order], scores[above][order]
            else:
                found, value = ids[above], scores[above]
            out[0].append(np.full(len(found) + len(tied), own[r]))
            out[1].append(np.concatenate([found, tied]))
            out[2].append(np.concatenate([value, np.full(len(tied), kth[r])]))
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(x, pa.int64()) for x in flat))))

    state = queries.withColumns({"lo": F.lit(-limit).cast("long"), "need": F.lit(k).cast("long")})
    width = 2 * limit + 1
    while width > 1:
        span, width = width, -(-width // bins)
        by_bin = against_all(state, histogram(span, width), HIST).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("query_id").orderBy(F.desc("bin"))
        kth = (
            by_bin.withColumn("upto", F.sum("n").over(down))
            .join(state.select("query_id", "need"), "query_id")
            .where("upto >= need and upto - n < need")
            .select("query_id", "bin", (F.col("upto") - F.col("n")).alias("above"))
        )
        # written each round: the next one reads it three times, so plans would grow threefold with every round
        state = materialise(
            state.join(kth, "query_id", "left").select(
                "query_id",
                "v",
                "dim",
                (F.col("lo") + F.coalesce("bin", F.lit(0)) * F.lit(width)).alias("lo"),
                (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"),
            )
        )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        against_all(state, select, FOUND)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
