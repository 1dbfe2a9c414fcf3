"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, shared_dir  # noqa: F401  used by the operators

#: Words are maximal runs of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it has more than this share of all rows, so there are at most as many hot keys as this number.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 0 on division by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def portions(batch: pa.RecordBatch, place: int, rows: int = 500, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows whose texts, in column ``place``, have about ``size`` bytes at most (a single longer text is a slice)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and (k - start >= rows or total + n > size):
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def fit_sample(rows: DataFrame, n: int, of: int, *keys: str) -> DataFrame:
    """About ``n`` of ``of`` rows, whole: those whose hash of ``keys`` is in the lowest n-th of all hashes; rows with equal keys count once.

    The share is applied where the rows are. As equal keys count once, the number taken is a binomial count of mean ``n`` at most,
    however much rows repeat. Columns: hash_ and those of ``rows`` (of rows with equal keys, the smallest).
    """
    low = -(2**63) + min(2**64 - 1, 2**64 * n // max(1, of))
    hashed = rows.withColumn("hash_", F.xxhash64(*keys)).where(F.col("hash_") <= F.lit(low).cast("long"))
    return hashed.groupBy("hash_").agg(F.min(F.struct(*rows.columns)).alias("row_")).select("hash_", "row_.*")


def fit_in_task(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of a bounded sample (see ``fit_sample``), in the order of its hashes; it runs in one task, the driver gets only the model."""
    names = sample.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            rows = pa.Table.from_batches(parts)
            rows = rows.take(pa.array(sorted(range(rows.num_rows), key=rows.column("hash_").to_pylist().__getitem__)))
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(rows))], pa.binary())})

    made = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else fit(pa.table({n: pa.array([]) for n in names}))


def fit_in_tasks(sample: DataFrame, fit: Callable[[pa.Table, int], object], seeds: tuple[int, ...]) -> list:
    """What ``fit`` makes of a bounded sample with each seed, in the order of the seeds, one task for each; nothing if the sample is empty."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        seed = key[0].as_py()
        rows = rows.sort_by([(rows.column_names[k], "ascending") for k in range(2)])
        return pa.table({"seed": pa.array([seed], pa.int32()), "model": pa.array([pickle.dumps(fit(rows, seed))], pa.binary())})

    dealt = sample.withColumn("seed_", F.explode(F.array(*map(F.lit, seeds))))
    made = {r.seed: r.model for r in dealt.groupBy("seed_").applyInArrow(run, "seed int, model binary").collect()}
    return [pickle.loads(made[s]) for s in seeds if s in made]


def join_some_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``left`` with the columns of ``right``, a left join on ``keys``, none of whose values gathers all its rows of ``left`` in one task.

    ``right``, a written table, has each key once, with a column ``n``: how many rows of ``left`` have it, ``rows`` in all. Keys with more than
    one in ``HOT_KEYS`` of the rows are at most ``HOT_KEYS`` rows of ``right``: their hashes come to the driver, and they are sent to all tasks; the others are joined by sort-merge.
    """
    key = F.xxhash64(*keys)
    hot = [r.h for r in right.where(F.col("n") > max(1, rows // HOT_KEYS)).select(key.alias("h")).collect()]
    if not hot:
        return left.join(right.drop("n"), keys, "left")
    chosen = key.isin(hot)
    found = left.where(chosen).join(F.broadcast(right.where(chosen).drop("n")), keys, "left")
    return found.unionByName(left.where(~chosen).join(right.where(~chosen).drop("n").hint("merge"), keys, "left"))
