"""Shards by rendezvous hashing of record keys.

Every shard draws a number from (key, shard), divided by the shard's weight; the least wins. Key and shards alone decide, so a record moves
only if its winner goes or a new shard draws less. Draws are exponential, so shares are as the weights.

Places in a shard come from ``BUCKETS`` ranges of a hash of the record within each shard: numbers within a range, and the sizes of the ranges
before it. No shard is sorted in one task. Rows alike in every column are counted before they are dealt, and go on in portions of ``PORTION``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType
from pyspark.sql.window import Window as W

from .common import materialise

BUCKETS, PORTION = 4096, 1 << 16
#: Draws in one digest of 128 bits.
_DRAWS = 4


def _hex_number(digest: Column, k: int = 0) -> Column:
    """The k-th 32 bits of a hexadecimal digest, unsigned."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _draw(key: Column, shards: list[tuple[int, float]]) -> list[Column]:
    """(draw, shard) for each shard: minus the logarithm of a uniform number, divided by the weight."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    digests = {block: F.md5(F.concat(text, F.lit(f":{block}")).cast("binary")) for block in {i // _DRAWS for i, _ in shards}}
    uniform = lambda i: (_hex_number(digests[i // _DRAWS], i % _DRAWS) + F.lit(0.5)) / F.lit(2.0**32)
    return [F.struct((-F.log(uniform(i)) / F.lit(float(w))).alias("draw"), F.lit(i).alias("shard")) for i, w in shards]


def with_shards(records: DataFrame, key: str, weights: list[float], name: str = "shard") -> DataFrame:
    """``records`` with the shard of each in column ``name`` (an existing one of that name is replaced): from 0, one for each weight. No shuffle.

    A weight of 0 gives a shard nothing; at least one weight must be positive. Equal draws go to the smaller shard. Null keys count as an empty text; rows that share a key share a shard.
    Texts aren't read unless they are the key; empty tables stay empty.
    """
    shards = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not shards:
        raise ValueError("no shard has a positive weight")
    return records.withColumn(name, F.array_min(F.array(*_draw(F.col(key), shards)))["shard"])


def with_slots(records: DataFrame, shard: str = "shard", buckets: int = BUCKETS, portion: int = PORTION) -> DataFrame:
    """``records``, of narrow columns, with ``slot``, which numbers each shard's rows without gaps from 0, in the order of a hash of the rows.

    Rows alike in all columns are interchangeable: they are counted first and take consecutive numbers, portion by portion.
    """
    names = [c for c in records.columns if c != shard]
    counted = records.groupBy(*records.columns).agg(F.count("*").alias("n_"))
    portions = counted.withColumn("portion_", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_ - 1) DIV {portion}"))))
    words = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*names, "portion_"]]
    order = portions.withColumns({"m_": F.least(F.lit(portion).cast("long"), F.col("n_") - F.col("portion_") * portion), "order_": _hex_number(F.md5(F.concat_ws(":", *words).cast("binary")))})
    dealt = materialise(order.withColumn("bucket_", F.shiftright(F.col("order_") * buckets, 32).cast("int")).drop("n_"))
    sizes = dealt.groupBy(shard, "bucket_").agg(F.sum("m_").alias("rows_"))
    before = sizes.withColumn("base_", F.sum("rows_").over(W.partitionBy(shard).orderBy("bucket_")) - F.col("rows_")).drop("rows_")
    within = W.partitionBy(shard, "bucket_").orderBy("order_", *names, "portion_")
    placed = dealt.withColumn("at_", F.sum("m_").over(within) - F.col("m_")).join(before.hint("merge"), [shard, "bucket_"])
    first = F.col("base_") + F.col("at_")
    each = placed.withColumn("slot", F.explode(F.sequence(first, first + F.col("m_") - 1)))
    return each.select(*records.columns, "slot")


def shard_digests(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Where each document lies among ``shards`` equal shards by its doc_id, and where it would with one more.

    Columns: doc_id, size (bytes of the text in UTF-8 and 16), text_crc32, law (``key``), shard, slot, grown_shard. A null text has no bytes. Rows that
    repeat each have a slot; null ids count as an empty text; further columns aren't read; of long texts only size and checksum are kept.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(text).cast("long") + 16
    narrow = docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"))
    slots = with_slots(with_shards(narrow, "doc_id", [1.0] * shards))
    grown = with_shards(slots, "doc_id", [1.0] * (shards + 1), "grown_shard")
    return grown.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str, weights: list[float], rows: int = 100_000) -> None:
    """Write ``docs`` whole as Parquet, a folder ``shard=i`` for each shard that gets rows; a shard is dealt over many tasks, and a file has at most ``rows`` rows."""
    placed = with_shards(docs, key, weights)
    plain = [f.name for f in docs.schema if isinstance(f.dataType, AtomicType)]
    spread = placed.repartition("shard", F.pmod(F.xxhash64(*plain), F.lit(64)))
    spread.write.partitionBy("shard").option("maxRecordsPerFile", rows).parquet(path)
