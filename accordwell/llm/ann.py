"""Approximate nearest neighbours by stable random projections and kd-trees.

Maximum inner product becomes least Euclidean distance: vectors get one more component that
lifts them to one norm, queries are scaled to that norm. Gaussian projections to ``DIMS``
dimensions are 2-stable: projected over true squared distance follows a chi-square
distribution.

The upper part of the kd-tree, fitted on a bounded sample, cuts the projected space into cells, each dealt over tasks by its size;
the lower part is built in the tasks. A query first searches a part of its own cell, then the cells that
its stopping test can reach. A search walks the tree by box distance, takes neighbours in the order of their projected distance, verifies
them at full length and renews the stopping test: a vector nearer than the k-th best so far would lie
beyond the next projected neighbour with at most probability 1 - ``CONFIDENCE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fit_sample, materialise

DIMS, CONFIDENCE, LEAF = 16, 0.9, 32
#: Vectors that the upper tree is fitted on, and how many cells it has at most.
SAMPLE, MOST_CELLS = 16384, 4096
PORTION = 64  # neighbours verified between the first two stopping tests; up to 16 times as many later on
FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, dims: int) -> float:
    """For an even number of dimensions, where the distribution function is a finite sum."""
    below = lambda x: 1 - exp(-x / 2) * sum(np.prod([x / 2 / j for j in range(1, i + 1)]) for i in range(dims // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles); without vectors null, zero, or with null or non-finite components."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))


class Tree:
    """A kd-tree over points: halves at the median of the widest dimension, down to ``size`` rows or ``most`` leaves."""

    def __init__(self, points: np.ndarray, size: int = LEAF, most: int = 1 << 30) -> None:
        self.axis, self.cut, self.child, self.rows = [0], [0.0], [(0, 0)], [np.arange(len(points))]
        self.leaf = [True]
        self.low, self.high = [points.min(axis=0, initial=np.inf)], [points.max(axis=0, initial=-np.inf)]
        todo, leaves = [0], 1
        while todo and leaves < most:
            node = todo.pop(0)
            rows, axis = self.rows[node], int(np.argmax(self.high[node] - self.low[node]))
            if len(rows) <= size or self.high[node][axis] <= self.low[node][axis]:
                continue
            cut = float(np.partition(points[rows, axis], len(rows) // 2)[len(rows) // 2])
            right = points[rows, axis] >= cut
            if right.all():  # the lower half is one value
                right = points[rows, axis] > cut
                cut = float(points[rows[right], axis].min())
            self.leaf[node], self.axis[node], self.cut[node], self.child[node] = False, axis, cut, (len(self.rows), len(self.rows) + 1)
            for part in (rows[~right], rows[right]):
                todo.append(len(self.rows))
                self.rows.append(part)
                self.axis.append(0), self.cut.append(0.0), self.child.append((0, 0)), self.leaf.append(True)
                self.low.append(points[part].min(axis=0)), self.high.append(points[part].max(axis=0))
            leaves += 1
        self.axis, self.cut, self.child, self.leaf, self.low, self.high = map(np.array, (self.axis, self.cut, self.child, self.leaf, self.low, self.high))

    def without_rows(self) -> "Tree":
        self.rows = []
        return self

    def descend(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls in."""
        node = np.zeros(len(points), np.int64)
        while not (done := self.leaf[node]).all():
            right = points[np.arange(len(points)), self.axis[node]] >= self.cut[node]
            node = np.where(done, node, self.child[node, right.astype(np.int64)])
        return node

    def reach(self, centre: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which centre, leaf, its box's squared distance) for the leaves that lie ``within`` the squared distance of each centre."""
        who, node = np.arange(len(centre)), np.zeros(len(centre), np.int64)
        out = []
        while len(who):
            away = box_distance(centre[who], self.low[node], self.high[node])
            ok = away <= within[who]
            who, node, away = who[ok], node[ok], away[ok]
            end = self.leaf[node]
            out.append((who[end], node[end], away[end]))
            who, node = np.repeat(who[~end], 2), self.child[node[~end]].ravel()
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (np.maximum(0, np.maximum(low - points, points - high)) ** 2).sum(axis=-1)


class Space:
    """Projections of vectors and queries of any width; components are scaled by a power of two, so squares stay finite."""

    def __init__(self, largest: float, norm: float, dims: int, seed: int) -> None:
        self.scale = 2.0 ** -np.ceil(np.log2(largest)) if largest else 1.0
        self.norm, self.dims, self.seed = norm, dims, seed

    def _matrix(self, width: int) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(width + 1, self.dims))

    def points(self, x: np.ndarray) -> np.ndarray:
        m, x = self._matrix(x.shape[1]), x * self.scale
        lift = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))
        return x @ m[:-1] + lift[:, None] * m[-1]

    def centres(self, q: np.ndarray) -> np.ndarray:
        q = q * self.scale
        return (q / self.lengths(q)[:, None] * self.norm) @ self._matrix(q.shape[1])[:-1]

    @staticmethod
    def lengths(q: np.ndarray) -> np.ndarray:
        top = np.abs(q).max(axis=1)
        return top * np.sqrt(((q / top[:, None]) ** 2).sum(axis=1))

    def distance(self, score: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Squared distance, in this space, of a candidate with that (scaled) score; infinite for no score."""
        cosine = np.where(np.isfinite(score), score, 0) / self.lengths(q * self.scale)
        return np.where(np.isfinite(score), np.maximum(0, 2 * self.norm**2 - 2 * self.norm * cosine), np.inf) + 1e-9 * self.norm**2


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(space: Space, reach: float, k: int, x: np.ndarray, ids: np.ndarray, points: np.ndarray, q: np.ndarray, own: np.ndarray, floor: np.ndarray) -> Iterator[tuple]:
    """Yields (row numbers of x, how many were verified) of each query; ``floor``: a score (scaled) that the k-th best is known to reach."""
    tree = Tree(points)
    # rows in the order of the leaves, so that what lies together is read together
    turn = np.concatenate([tree.rows[n] for n in np.flatnonzero(tree.leaf)])
    scaled, ids, points = x[turn] * space.scale, ids[turn], points[turn]
    coarse = scaled.astype(np.float32)
    size = np.array([len(r) if end else 0 for r, end in zip(tree.rows, tree.leaf)])
    start = np.cumsum(size) - size
    for at in range(0, len(q), 128):
        some = slice(at, at + 128)
        centre, kth = space.centres(q[some]), space.distance(floor[some], q[some])
        who, leaf, away = tree.reach(centre, reach * kth)
        order = np.lexsort((away, who))
        who, leaf, away = who[order], leaf[order], away[order]
        ends = np.searchsorted(who, np.arange(len(centre) + 1))
        for i in range(len(centre)):
            mine = slice(ends[i], ends[i + 1])
            found = _walk(space, reach, k, (scaled, coarse), ids, points, (start[leaf[mine]], size[leaf[mine]]), q[at + i], own[at + i], centre[i], kth[i], floor[at + i], away[mine])
            yield turn[found[0]], found[1]


def _walk(space, reach, k, vectors, ids, points, leaves, q, own, centre, kth, floor, away):
    """One query: leaves by box distance; the neighbours nearer than the next unopened leaf are verified by projected distance."""
    query = q * space.scale
    (x, coarse), (start, sizes) = vectors, leaves
    rough, slack = query.astype(np.float32), 1e-5 * space.norm * float(space.lengths(query[None, :])[0])
    best, rows = np.empty(0), np.empty(0, np.int64)
    waiting, far = np.empty(0, np.int64), np.empty(0)
    opened, portion, verified, size = 0, 16, 0, PORTION
    while opened < len(away) or len(waiting):
        if opened < len(away):
            more = np.concatenate([np.arange(b, b + n) for b, n in zip(start[opened : opened + portion], sizes[opened : opened + portion])])
            opened, portion = opened + portion, 2 * portion
            apart = points[more] - centre
            waiting, far = np.append(waiting, more), np.append(far, np.einsum("ij,ij->i", apart, apart))
        safe = away[opened] if opened < len(away) else np.inf
        ready = far <= safe
        now, at = waiting[ready], far[ready]
        waiting, far = waiting[~ready], far[~ready]
        order = np.argsort(at)
        now, at, done = now[order], at[order], 0
        while done < len(now):
            # the stopping test, for each of the next neighbours
            some = now[done : done + size][: np.searchsorted(at[done : done + size], reach * kth, side="right")]
            if not len(some):
                return rows, verified
            done, size = done + size, min(2 * size, 16 * PORTION)
            verified, some = verified + len(some), np.sort(some)
            about = coarse[some] @ rough  # differs from the score by rounding only
            some = some[(about >= floor - slack) & (ids[some] != own)]
            every, which = np.append(best, (x[some] * query).sum(axis=1)), np.append(rows, some)
            keep = np.lexsort((ids[which], -every))[:k]
            best, rows = every[keep], which[keep]
            if len(best) == k and best[-1] > floor:
                floor = best[-1]
                kth = float(space.distance(np.array([floor]), q[None, :])[0])
        if safe > reach * kth:
            break
    return rows, verified


def _place(space: Space, trees: dict[int, Tree], query: bool):
    """Adds the cell (leaf of the upper tree) and, for candidates, the projected point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column("dim").to_numpy()
            for d in np.unique(dims):
                part = table.take(pa.array(np.flatnonzero(dims == d)))
                for k in range(0, part.num_rows, 4096):
                    own = part.slice(k, 4096).combine_chunks()
                    points = (space.centres if query else space.points)(_matrix(own.column("v")))
                    own = own.append_column("cell", pa.array(trees[int(d)].descend(points).astype(np.int32)))
                    if not query:
                        own = own.append_column("p", pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), space.dims).cast(pa.list_(pa.float64())))
                    yield from own.to_batches()

    return run


def _route(space: Space, reach: float, cells: dict[int, tuple]):
    """The cells that each query's stopping test can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column("dim").to_numpy()
            for d in np.unique(dims):
                if int(d) not in cells:
                    continue
                part = table.take(pa.array(np.flatnonzero(dims == d)))
                number, low, high = cells[int(d)]
                for k in range(0, part.num_rows, 256):
                    own = part.slice(k, 256).combine_chunks()
                    q, floor = _matrix(own.column("v")), own.column("floor").to_numpy()
                    within = reach * space.distance(floor, q)
                    who, at = np.nonzero(box_distance(space.centres(q)[:, None, :], low[None], high[None]) <= within[:, None])
                    yield from own.take(pa.array(who)).append_column("at", pa.array(number[at].astype(np.int32))).to_batches()

    return run


def _search(space: Space, reach: float, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)])
        if left.num_rows and right.num_rows:
            q, x, points = (_matrix(c) for c in (left.column("v"), right.column("v"), right.column("p")))
            own, ids, floor = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy(), left.column("floor").to_numpy()
            for i, (rows, _) in enumerate(search(space, reach, k, x, ids, points, q, own, floor)):
                out[0].append(np.full(len(rows), own[i]))
                out[1].append(ids[rows])
                out[2].append((x[rows] * q[i]).sum(axis=1))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(np.concatenate(x)) for x in out))))

    return run


def nearest_neighbours(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 20,
    confidence: float = CONFIDENCE,
    dims: int = DIMS,
    sample: int = SAMPLE,
    chunk: int = 16384,
    block: int = 16384,
    seed: int = 17,
) -> DataFrame:
    """The k candidates of largest inner product found for each query: query_id, rank (from 1), vec_id, score.

    Both tables have vec_id and v; see ``clean_vectors``. A query never finds rows with its own vec_id.
    Ties go to the smaller vec_id. Repeated candidate rows count as often as they occur; of repeated queries of one vec_id the
    smallest vector counts. Vectors of another length than the query's take no part for it. Fewer than k candidates:
    all of them. Empty tables give an empty result. Every candidate is indexed; a neighbour is missed with a probability of at most 1 - ``confidence``
    in each cell. Components of any finite size may occur; a score beyond the range of a double is infinite.
    The upper tree is fitted on about ``sample`` vectors, a bounded sample.
    """
    dim = F.size("v").alias("dim")
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v", dim)
    candidates = candidates.select("vec_id", "v", dim)
    top = F.array_max(F.transform("v", F.abs))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / top) * (c / top))
    seen = candidates.groupBy("dim").agg(F.count("*").alias("n"), F.max(top).alias("largest"), F.max(top * F.sqrt(square)).alias("norm")).collect()
    largest = max((r.largest for r in seen), default=1.0)
    space = Space(largest, 1.0, dims, seed)
    space.norm = max((r.norm * space.scale for r in seen), default=1.0) * (1 + 1e-12)
    reach, total = chi_square_quantile(confidence, dims), sum(r.n for r in seen)
    picked = fit_sample(candidates, sample, total, "vec_id", "v").orderBy("hash_").select("dim", "v").toArrow()
    trees = {}
    for r in seen:
        own = picked.filter(pa.array(picked.column("dim").to_numpy() == r.dim)).column("v")
        points = space.points(_matrix(own)) if len(own) else np.empty((0, dims))
        trees[r.dim] = Tree(points, size=16, most=min(max(1, MOST_CELLS * r.n // total), -(-r.n // chunk))).without_rows()

    number = F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("number")
    index = materialise(candidates.select("vec_id", "v", "dim", number).mapInArrow(_place(space, trees, False), "vec_id long, v array<double>, dim int, number long, cell int, p array<double>"))
    edges = [f(F.col("p")[i]).alias(f"{name}{i}") for i in range(dims) for name, f in (("low", F.min), ("high", F.max))]
    sizes = index.groupBy("dim", "cell").agg(F.count("*").alias("n"), *edges).collect()
    cells = {}
    for d in trees:
        rows = [r for r in sizes if r.dim == d]
        cells[d] = (np.array([r.cell for r in rows]), *(np.array([[r[f"{name}{i}"] for i in range(dims)] for r in rows]) for name in ("low", "high")))
    parts = {(r.dim, r.cell): -(-r.n // chunk) for r in sizes}
    spark = candidates.sparkSession

    def searched(asking: DataFrame) -> DataFrame:
        """``asking``: query_id, v, dim, floor, at (cell), part. Each block of queries meets each part of a cell that it asks for."""
        asked = asking.groupBy("dim", "at").agg(F.count("*").alias("n")).collect()  # one row for each cell at most
        blocks = [(r.dim, r["at"], parts[r.dim, r["at"]], -(-r.n // (block * parts[r.dim, r["at"]]))) for r in asked if (r.dim, r["at"]) in parts]
        layout = F.broadcast(spark.createDataFrame(blocks, "dim int, cell int, parts int, blocks int"))
        spread = (
            index.join(layout, ["dim", "cell"])
            .withColumn("part", F.pmod("number", "parts").cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("dim", "cell", "part", "block", "vec_id", "v", "p")
        )
        placed = (
            asking.withColumnRenamed("at", "cell")
            .join(layout, ["dim", "cell"])
            .withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
            .select("dim", "cell", "part", "block", "query_id", "v", "floor")
        )
        key = ("dim", "cell", "part", "block")
        return placed.groupBy(*key).cogroup(spread.groupBy(*key)).applyInArrow(_search(space, reach, k), FOUND)

    pieces = F.broadcast(spark.createDataFrame([(d, c, n) for (d, c), n in parts.items()], "dim int, cell int, parts int"))
    none = F.lit(float("-inf")).alias("floor")
    at_home = materialise(
        queries.mapInArrow(_place(space, trees, True), "query_id long, v array<double>, dim int, cell int")
        .join(pieces, ["dim", "cell"], "left")
        .select("query_id", "v", "dim", none, F.col("cell").alias("at"), F.pmod(F.xxhash64("query_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    ) if trees else queries.select("query_id", "v", "dim", none, F.lit(0).alias("at"), F.lit(0).alias("part")).limit(0)
    near = materialise(searched(at_home))
    floors = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).select(
        "query_id", F.when(F.col("n") >= k, F.col("s") * F.lit(space.scale) * F.lit(space.scale)).alias("s")
    )
    asking = at_home.join(floors, "query_id", "left").select(
        "query_id", "v", "dim", F.coalesce(F.when(F.abs("s") < float("inf"), F.col("s")), F.lit(float("-inf"))).alias("floor"), F.col("at").alias("home"), F.col("part").alias("own")
    )
    routed = (
        asking.mapInArrow(_route(space, reach, cells), "query_id long, v array<double>, dim int, floor double, home int, own int, at int")
        .join(pieces.withColumnRenamed("cell", "at"), ["dim", "at"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("not (at = home and part = own)")
        .select("query_id", "v", "dim", "floor", "at", "part")
    )
    found = near.unionAll(searched(materialise(routed)))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
