"""Bitemporal operators: as-of, intervals, integrity, and copies that have fallen behind.

Validity is half-open, [valid_from, valid_to); a null end is open.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query
from .lineage import cycle_nodes, parent_edges

AS_OF = datetime(1997, 1, 1)


def in_force(at: Column | datetime, begin: str = "valid_from", end: str = "valid_to") -> Column:
    at = at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz")
    return (F.col(begin) <= at) & (F.col(end).isNull() | (F.col(end) > at))


def kernel_as_of(versions: DataFrame, at: datetime) -> DataFrame:
    """The version of each (agreement_id, canonical_key) in force at a time: the highest number, then the largest id.

    An aggregation keeps one row per key while reading, so no key is sorted or held as a whole.
    """
    live = versions.where(in_force(at))
    best = F.max_by(F.struct("version_id", "version_number", "status", "valid_from", "threshold"), F.struct("version_number", "version_id"))
    return live.groupBy("agreement_id", "canonical_key").agg(best.alias("v")).select("agreement_id", "canonical_key", "v.*")


@query(
    "tmp_kernel_as_of",
    """
SELECT agreement_id, canonical_key, version_id, version_number, status, valid_from, threshold FROM (
  SELECT *, row_number() OVER (PARTITION BY agreement_id, canonical_key ORDER BY version_number DESC, version_id DESC) AS rn
  FROM commitment_version
  WHERE valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')) WHERE rn = 1""",
    "commitment_version",
)
def tmp_kernel_as_of(spark, sf_dir):
    return kernel_as_of(P.commitment_version(spark, sf_dir), AS_OF)


@query(
    "tmp_kernel_as_of_by_agreement_count",
    """
SELECT agreement_id, count(DISTINCT canonical_key) AS n_keys,
       CAST(count(*) FILTER (status = 'ACTIVE') AS BIGINT) AS n_active
FROM commitment_version
WHERE valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')
GROUP BY agreement_id""",
    "commitment_version",
)
def tmp_kernel_as_of_by_agreement_count(spark, sf_dir):
    return (
        P.commitment_version(spark, sf_dir)
        .where(in_force(AS_OF))
        .groupBy("agreement_id")
        .agg(F.count_distinct("canonical_key").alias("n_keys"), F.count_if(F.col("status") == "ACTIVE").alias("n_active"))
    )


def latest_version(versions: DataFrame) -> DataFrame:
    """Open-ended first, then the latest start, then the largest id."""
    order = W.partitionBy("agreement_id", "canonical_key").orderBy(F.desc_nulls_first("valid_to"), F.desc("valid_from"), F.desc("version_id"))
    return versions.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("agreement_id", "canonical_key", "version_id", "valid_from", "valid_to")


@query(
    "tmp_latest_version",
    """
SELECT agreement_id, canonical_key, version_id, valid_from, valid_to FROM (
  SELECT *, row_number() OVER (PARTITION BY agreement_id, canonical_key
    ORDER BY valid_to DESC NULLS FIRST, valid_from DESC, version_id DESC) AS rn FROM commitment_version) WHERE rn = 1""",
    "commitment_version",
)
def tmp_latest_version(spark, sf_dir):
    return latest_version(P.commitment_version(spark, sf_dir))


def close_intervals(versions: DataFrame) -> DataFrame:
    """Ends each version where the next of its key begins."""
    key = W.partitionBy("agreement_id", "canonical_key").orderBy("valid_from", "version_id")
    return versions.withColumn("valid_to", F.lead("valid_from").over(key))


@query(
    "tmp_interval_close",
    """
SELECT version_id, valid_from,
       lead(valid_from) OVER (PARTITION BY agreement_id, canonical_key ORDER BY valid_from, version_id) AS valid_to
FROM commitment_version""",
    "commitment_version",
)
def tmp_interval_close(spark, sf_dir):
    return close_intervals(P.commitment_version(spark, sf_dir).drop("valid_to")).select("version_id", "valid_from", "valid_to")


def contradictory_active(versions: DataFrame) -> DataFrame:
    """Pairs of overlapping active versions of one key, with id_a < id_b.

    One sort of a key finds the versions that overlap any other (they begin before the latest end so far, or end after the next begins);
    only these are joined, so keys without contradictions, however long, cost a sort.
    """
    live = versions.where("status = 'ACTIVE'").withColumn("until", F.coalesce("valid_to", F.lit(datetime(9999, 12, 31)).cast("timestamp_ntz")))
    by_start = W.partitionBy("agreement_id", "canonical_key").orderBy("valid_from", "version_id")
    marked = live.withColumns({"latest": F.max("until").over(by_start.rowsBetween(W.unboundedPreceding, -1)), "next": F.lead("valid_from").over(by_start)})
    live = marked.where("latest > valid_from or next < until").drop("latest", "next")
    a, b = live.alias("a"), live.alias("b")
    same = (F.col("a.agreement_id") == F.col("b.agreement_id")) & (F.col("a.canonical_key") == F.col("b.canonical_key"))
    overlap = (F.col("a.version_id") < F.col("b.version_id")) & (F.col("a.valid_from") < F.col("b.until")) & (F.col("b.valid_from") < F.col("a.until"))
    return a.join(b, same & overlap).select(
        F.col("a.agreement_id").alias("agreement_id"), F.col("a.canonical_key").alias("canonical_key"), F.col("a.version_id").alias("id_a"), F.col("b.version_id").alias("id_b")
    )


@query(
    "tmp_contradictory_active",
    """
WITH v AS (SELECT *, valid_from + INTERVAL 400 DAY AS until FROM commitment_version WHERE status = 'ACTIVE')
SELECT a.agreement_id, a.canonical_key, a.version_id AS id_a, b.version_id AS id_b
FROM v a JOIN v b ON a.agreement_id = b.agreement_id AND a.canonical_key = b.canonical_key
 AND a.version_id < b.version_id AND a.valid_from < b.until AND b.valid_from < a.until""",
    "commitment_version",
)
def tmp_contradictory_active(spark, sf_dir):
    unclosed = P.commitment_version(spark, sf_dir).withColumn("valid_to", F.col("valid_from") + F.expr("INTERVAL 400 DAYS"))
    return contradictory_active(unclosed)


@query("tmp_invalid_interval", "SELECT version_id, valid_from, valid_to FROM commitment_version WHERE valid_to <= valid_from", "commitment_version")
def tmp_invalid_interval(spark, sf_dir):
    return P.commitment_version(spark, sf_dir).where("valid_to <= valid_from").select("version_id", "valid_from", "valid_to")


def integrity_verdict(versions: DataFrame) -> DataFrame:
    """Per agreement the counts of what must not be, and whether all are zero.

    ``cycles`` counts versions on a cycle of any length, ``self_loops`` those of them that are their own parents,
    ``contradictions`` pairs of overlapping active versions of one key.
    """
    known = versions.select(F.col("version_id").alias("parent_version_id"), F.lit(True).alias("known"))
    cyclic = cycle_nodes(parent_edges(versions)).select(F.col("node").alias("version_id"), F.lit(True).alias("cyclic"))
    contradictions = contradictory_active(versions).groupBy("agreement_id").agg(F.count("*").alias("contradictions"))
    counts = versions.join(known, "parent_version_id", "left").join(cyclic, "version_id", "left").groupBy("agreement_id").agg(
        F.count("*").alias("versions"),
        F.count_if(F.col("valid_to") <= F.col("valid_from")).alias("invalid_intervals"),
        F.count_if(F.col("parent_version_id").isNotNull() & F.col("known").isNull()).alias("orphans"),
        F.count_if(F.col("parent_version_id") == F.col("version_id")).alias("self_loops"),
        F.count("cyclic").alias("cycles"),
    )
    counts = counts.join(contradictions, "agreement_id", "left").withColumn("contradictions", F.coalesce("contradictions", F.lit(0)))
    return counts.withColumn("sound", F.expr("invalid_intervals = 0 and orphans = 0 and cycles = 0 and contradictions = 0"))


@query(
    "tmp_integrity_verdict",
    """
WITH n AS (SELECT agreement_id, count(*) AS versions,
    CAST(count(*) FILTER (valid_to <= valid_from) AS BIGINT) AS invalid_intervals,
    CAST(count(*) FILTER (parent_version_id IS NOT NULL AND parent_version_id NOT IN (SELECT version_id FROM commitment_version)) AS BIGINT) AS orphans,
    CAST(count(*) FILTER (parent_version_id = version_id) AS BIGINT) AS self_loops
  FROM commitment_version GROUP BY agreement_id)
SELECT *, invalid_intervals = 0 AND orphans = 0 AND self_loops = 0 AS sound FROM n""",
    "commitment_version",
)
def tmp_integrity_verdict(spark, sf_dir):
    """The whole verdict; of the counts only those that the SQL has, as the tables have neither longer cycles nor contradictions."""
    return integrity_verdict(P.commitment_version(spark, sf_dir)).drop("cycles", "contradictions")


@query(
    "tmp_waiver_restore",
    """
SELECT version_id, 'WAIVED' AS kind, valid_from AS begins, valid_from + INTERVAL 90 DAY AS ends, threshold FROM commitment_version WHERE status = 'WAIVED'
UNION ALL
SELECT version_id, 'RESTORED', valid_from + INTERVAL 90 DAY, valid_to, threshold FROM commitment_version WHERE status = 'WAIVED'""",
    "commitment_version",
)
def tmp_waiver_restore(spark, sf_dir):
    """A waiver is a bounded state and a scheduled return to the terms after the amendment."""
    end = F.col("valid_from") + F.expr("INTERVAL 90 DAYS")
    state = F.struct(F.lit("WAIVED").alias("kind"), F.col("valid_from").alias("begins"), end.alias("ends"))
    restore = F.struct(F.lit("RESTORED").alias("kind"), end.alias("begins"), F.col("valid_to").alias("ends"))
    waived = P.commitment_version(spark, sf_dir).where("status = 'WAIVED'")
    return waived.select("version_id", F.explode(F.array(state, restore)).alias("s"), "threshold").select("version_id", "s.*", "threshold")


@query(
    "tmp_due_restores",
    """
SELECT agreement_id, canonical_key, max(valid_from + INTERVAL 90 DAY) AS restored_at, CAST(count(*) AS BIGINT) AS n
FROM commitment_version WHERE status = 'WAIVED' AND valid_from + INTERVAL 90 DAY <= TIMESTAMP '1997-01-01'
GROUP BY agreement_id, canonical_key""",
    "commitment_version",
)
def tmp_due_restores(spark, sf_dir):
    due = P.commitment_version(spark, sf_dir).where("status = 'WAIVED'").withColumn("at", F.col("valid_from") + F.expr("INTERVAL 90 DAYS"))
    return due.where(F.col("at") <= F.lit(AS_OF).cast("timestamp_ntz")).groupBy("agreement_id", "canonical_key").agg(F.max("at").alias("restored_at"), F.count("*").alias("n"))


@query(
    "tmp_renumber_report",
    """
SELECT i.agreement_id, a.issuer_name, i.step, concat('7.', i.target_key) AS old_ref, concat('8.', i.target_key) AS new_ref
FROM instruction_stream i JOIN agreement a USING (agreement_id) WHERE i.instruction_type = 'RENUMBER_REFERENCE'""",
    "agreement instruction_stream",
)
def tmp_renumber_report(spark, sf_dir):
    """Renumberings are events of their own; they never change a state."""
    events = P.instruction_stream(spark, sf_dir).where("instruction_type = 'RENUMBER_REFERENCE'")
    return events.join(P.agreement(spark, sf_dir), "agreement_id").select(
        "agreement_id", "issuer_name", "step", F.concat(F.lit("7."), "target_key").alias("old_ref"), F.concat(F.lit("8."), "target_key").alias("new_ref")
    )


@query(
    "tmp_propagation_stale",
    """
SELECT v.agreement_id, a.issuer_name, v.version_id, p.threshold AS old_threshold, v.threshold AS new_threshold,
       CASE WHEN r.representation_id IS NULL THEN 'MISSING' WHEN r.stated_threshold = v.threshold THEN 'CURRENT' ELSE 'STALE' END AS state
FROM commitment_version v JOIN agreement a USING (agreement_id)
JOIN commitment_version p ON p.version_id = v.parent_version_id
LEFT JOIN representation r ON r.representation_id = v.version_id AND r.representation_type = 'risk_model'
WHERE v.threshold > p.threshold AND (r.representation_id IS NULL OR r.stated_threshold <> v.threshold)""",
    "agreement commitment_version representation",
)
def tmp_propagation_stale(spark, sf_dir):
    """Relaxed commitments whose copy elsewhere is missing or states the old value."""
    v = P.commitment_version(spark, sf_dir)
    parent = v.select(F.col("version_id").alias("parent_version_id"), F.col("threshold").alias("old_threshold"))
    copies = P.representation(spark, sf_dir).where("representation_type = 'risk_model'").select(F.col("representation_id").alias("version_id"), "stated_threshold", F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "MISSING").when(F.col("stated_threshold") == F.col("threshold"), "CURRENT").otherwise("STALE")
    return (
        v.join(parent, "parent_version_id")
        .where("threshold > old_threshold")
        .join(P.agreement(spark, sf_dir), "agreement_id")
        .join(copies, "version_id", "left")
        .withColumn("state", state)
        .where("state <> 'CURRENT'")
        .select("agreement_id", "issuer_name", "version_id", "old_threshold", F.col("threshold").alias("new_threshold"), "state")
    )


@query(
    "tmp_propagation_diff",
    """
SELECT r.representation_id, r.observed_at, v.version_id, r.stated_threshold, v.threshold,
       r.stated_threshold IS DISTINCT FROM v.threshold AS differs
FROM representation r LEFT JOIN commitment_version v ON v.agreement_id = r.agreement_id AND v.canonical_key = r.canonical_key
 AND v.valid_from <= r.observed_at AND (v.valid_to IS NULL OR v.valid_to > r.observed_at)""",
    "commitment_version representation",
)
def tmp_propagation_diff(spark, sf_dir):
    """Each copy against the version in force when it was observed: an as-of range join within the key."""
    v = P.commitment_version(spark, sf_dir).alias("v")
    r = P.representation(spark, sf_dir).alias("r")
    on = (F.col("v.agreement_id") == F.col("r.agreement_id")) & (F.col("v.canonical_key") == F.col("r.canonical_key")) & in_force(F.col("r.observed_at"), "v.valid_from", "v.valid_to")
    return r.join(v, on, "left").select(
        "representation_id", "observed_at", "version_id", "stated_threshold", "threshold", (~F.col("stated_threshold").eqNullSafe(F.col("threshold"))).alias("differs")
    )


@query(
    "tmp_version_sequence",
    """
SELECT version_id, version_number, CAST(row_number() OVER (PARTITION BY agreement_id, canonical_key ORDER BY valid_from, version_id) - 1 AS INTEGER) AS expected_predecessor,
       version_number = row_number() OVER (PARTITION BY agreement_id, canonical_key ORDER BY valid_from, version_id) AS monotonic
FROM commitment_version""",
    "commitment_version",
)
def tmp_version_sequence(spark, sf_dir):
    """Numbers rise by one: the optimistic check against the predecessor's number."""
    rank = F.row_number().over(W.partitionBy("agreement_id", "canonical_key").orderBy("valid_from", "version_id"))
    return P.commitment_version(spark, sf_dir).select("version_id", "version_number", (rank - 1).alias("expected_predecessor"), (F.col("version_number") == rank).alias("monotonic"))
