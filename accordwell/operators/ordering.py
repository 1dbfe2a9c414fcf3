"""Global order: ordered files, and ordinals without gaps, from range partitions and the sizes of the partitions before.

Nothing is sorted in one task: rows go to ranges, each range is sorted, and a small table with a row for each range (and key) says
how many rows come before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query
from ..storage import materialise

_PLACES = 33  # a generated id is a partition's number, then 33 bits for the place in it


def _ranged(rows: DataFrame, order: Sequence[Column | str], kept: Sequence[str] | None = None, n: int | None = None) -> DataFrame:
    """``rows`` (of their columns those ``kept``) in order over range partitions, written once, with range_ and place_ (from 0). Where their number ``n`` is known, there are as many ranges as that needs."""
    made = rows.repartitionByRange(*([] if n is None else [P.portions_of(rows.sparkSession, n)]), *order).sortWithinPartitions(*order).withColumn("id_", F.monotonically_increasing_id())
    return materialise(made.select(*(kept or rows.columns), F.shiftright("id_", _PLACES).alias("range_"), F.col("id_").bitwiseAND(F.lit((1 << _PLACES) - 1)).alias("place_")))


def with_ordinals(rows: DataFrame, *order: Column | str, name: str = "ordinal", kept: Sequence[str] | None = None, n: int | None = None) -> DataFrame:
    """``rows`` (of their columns those ``kept``) with their places in the global order, from 1 without gaps. ``n``: how many they are, if known. Rows that tie in ``order`` follow one another in no stated order, so order by a key."""
    ranged = _ranged(rows, order, kept, n)
    before = ranged.groupBy("range_").agg(F.count("*").alias("n_")).withColumn("before_", F.sum("n_").over(W.orderBy("range_")) - F.col("n_"))
    placed = ranged.join(F.broadcast(before.drop("n_")), "range_")  # a row for each range
    return placed.select(*(kept or rows.columns), (F.col("before_") + F.col("place_") + 1).alias(name))


def with_ordinals_within(rows: DataFrame, keys: Sequence[str], *order: Column | str, name: str = "ordinal") -> DataFrame:
    """``rows`` with their places among the rows with equal ``keys``, from 1 without gaps; a key with any share of the rows is dealt over many ranges. Keys aren't null."""
    ranged = _ranged(rows, [*keys, *order])
    here = ranged.groupBy("range_", *keys).agg(F.count("*").alias("n_"), F.min("place_").alias("first_"))
    before = here.withColumn("before_", F.sum("n_").over(W.partitionBy(*keys).orderBy("range_")) - F.col("n_"))
    placed = ranged.join(before.drop("n_"), ["range_", *keys])
    return placed.select(*rows.columns, (F.col("before_") + F.col("place_") - F.col("first_") + 1).alias(name))


def write_ordered(rows: DataFrame, path: str, *order: Column | str) -> None:
    """Write Parquet files that follow one another in the order: the rows of a file come before those of the next, by file name."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


_UNRESOLVED = """
SELECT c_name AS issuer_name, version_number, instruction_order, instruction_type, target_section_ref, amendment_version_id
FROM amendment_instruction i JOIN agreement_version v ON v.agreement_version_id = i.amendment_version_id JOIN customer ON c_custkey = v.agreement_id
WHERE i.status = 'UNRESOLVED' OR instruction_type = 'UNRESOLVED'"""


@query(
    "srt_unresolved_queue",
    f"SELECT *, CAST(row_number() OVER (ORDER BY issuer_name, version_number, instruction_order, amendment_version_id) AS BIGINT) AS ordinal FROM ({_UNRESOLVED})",
    "amendment_instruction agreement_version",
)
def srt_unresolved_queue(spark, sf_dir):
    """The queue of unresolved instructions in reading order: issuer, version, instruction."""
    i = P.amendment_instruction(spark, sf_dir).where("status = 'UNRESOLVED' OR instruction_type = 'UNRESOLVED'")
    v = P.agreement_version(spark, sf_dir).select(F.col("agreement_version_id").alias("amendment_version_id"), "agreement_id", "version_number")
    named = i.join(v, "amendment_version_id").join(P.agreement(spark, sf_dir), "agreement_id")
    rows = named.select("issuer_name", "version_number", "instruction_order", "instruction_type", "target_section_ref", "amendment_version_id")
    return with_ordinals(rows, "issuer_name", "version_number", "instruction_order", "amendment_version_id")


@query(
    "srt_reference_changes",
    """
SELECT *, CAST(row_number() OVER (PARTITION BY agreement_id ORDER BY effective_start, version_number, instruction_order, amendment_version_id) AS BIGINT) AS ordinal FROM (
  SELECT v.agreement_id, version_number, instruction_order, target_section_ref, effective_start, amendment_version_id
  FROM amendment_instruction i JOIN agreement_version v ON v.agreement_version_id = i.amendment_version_id)""",
    "amendment_instruction agreement_version",
)
def srt_reference_changes(spark, sf_dir):
    """Each agreement's references in the order in which they took effect, numbered."""
    v = P.agreement_version(spark, sf_dir).select(F.col("agreement_version_id").alias("amendment_version_id"), "agreement_id", "version_number")
    rows = P.amendment_instruction(spark, sf_dir).join(v, "amendment_version_id").select("agreement_id", "version_number", "instruction_order", "target_section_ref", "effective_start", "amendment_version_id")
    return with_ordinals_within(rows, ["agreement_id"], "effective_start", "version_number", "instruction_order", "amendment_version_id")
