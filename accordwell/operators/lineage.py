"""Lineage over parent edges: traces, cycles, orphans, histories, and the edges' own life.

Paths are found by doubling: paths of length up to 2n are paths of length up to n joined with
themselves, so a history of depth d takes about log2(d) joins and no row or level limit applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query
from ..storage import materialise


def ancestor_paths(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) for all ancestors along ``edges`` (node, parent), depth the least number of steps.

    A node on a cycle is its own ancestor.
    """
    one = edges.where("node is not null and parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    paths, size = materialise(one), -1
    while (now := paths.count()) != size:
        size = now
        further = paths.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("up"), F.col("depth").alias("more"))
        longer = paths.join(further, "ancestor").select("node", F.col("up").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        paths = materialise(paths.unionAll(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
    return paths


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """The nodes that lie on cycles of ``edges`` (node, parent), where a node has one parent at most, as versions have.

    Every node points at its ancestor 1, 2, 4, ... steps up, one row each; nodes that have none drop out. Once neither the
    nodes nor their ancestors get fewer, the ancestors are the nodes on cycles. Long histories cost rounds, not rows.
    """
    up = materialise(edges.where("node is not null and parent is not null").select("node", F.col("parent").alias("up")).distinct())
    before = None
    while (now := up.agg(F.count("*"), F.count_distinct("up")).first()) != before and now[0]:
        before = now
        further = up.select(F.col("node").alias("up"), F.col("up").alias("above"))
        up = materialise(up.join(further, "up").select("node", F.col("above").alias("up")))
    return up.select(F.col("up").alias("node")).distinct()


def topmost_ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) with the ancestor that has no parent, for nodes with one parent at most; nodes whose way up ends in a cycle are left out.

    Pointer jumping: each round a node takes over the pointer of what it points at, so there is one row for each node, and about log2(depth) rounds.
    """
    up = materialise(edges.where("node is not null and parent is not null").select("node", F.col("parent").alias("up"), F.lit(1).alias("depth")).distinct().withColumn("moved", F.lit(True)))
    for _ in range(up.count().bit_length() + 1):
        further = up.select(F.col("node").alias("up"), F.col("up").alias("above"), F.col("depth").alias("more"))
        up = materialise(
            up.join(further, "up", "left").select("node", F.coalesce("above", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved"))
        )
        if up.where("moved").isEmpty():
            break
    return up.where("not moved").select("node", F.col("up").alias("ancestor"), "depth")


def parent_edges(versions: DataFrame) -> DataFrame:
    return versions.select(F.col("version_id").alias("node"), F.col("parent_version_id").alias("parent"))


@query(
    "grf_lineage_trace",
    """
WITH RECURSIVE t AS (
  SELECT version_id AS node, version_id AS ancestor, parent_version_id AS up, 0 AS depth FROM commitment_version
  UNION ALL
  SELECT t.node, p.version_id, p.parent_version_id, t.depth + 1 FROM t JOIN commitment_version p ON p.version_id = t.up)
SELECT node, ancestor, depth FROM t WHERE depth > 0""",
    "commitment_version",
)
def grf_lineage_trace(spark, sf_dir):
    """Every version's way back to its origin, with the depth of each ancestor."""
    return ancestor_paths(parent_edges(P.commitment_version(spark, sf_dir)))


def plant_cycles(versions: DataFrame) -> DataFrame:
    """All parent edges of ``versions``; every origin whose id is a multiple of 11 gets its key's third version as parent, or the last of fewer."""
    early = F.when(F.col("version_number") <= 3, F.struct("version_number", "version_id"))
    key = versions.groupBy("agreement_id", "canonical_key").agg(F.min_by("version_id", "version_number").alias("node"), F.max(early)["version_id"].alias("planted"))
    planted = key.where("node % 11 = 0").select("node", "planted")
    return parent_edges(versions).join(planted, "node", "left").select("node", F.coalesce("planted", "parent").alias("parent"))


@query(
    "grf_version_cycles",
    """
SELECT version_id AS node FROM (
  SELECT version_id, version_number, first_value(version_id) OVER (PARTITION BY agreement_id, canonical_key ORDER BY version_number) AS origin FROM commitment_version)
WHERE origin % 11 = 0 AND version_number <= 3""",
    "commitment_version",
)
def grf_version_cycles(spark, sf_dir):
    """Versions on cycles, over the whole lineage. The SQL knows where the cycles were planted."""
    return cycle_nodes(plant_cycles(P.commitment_version(spark, sf_dir)))


@query(
    "grf_orphans",
    """
WITH e AS (SELECT version_id, CASE WHEN version_id % 11 = 0 THEN -version_id ELSE parent_version_id END AS parent FROM commitment_version)
SELECT version_id, parent FROM e WHERE parent IS NOT NULL AND parent NOT IN (SELECT version_id FROM commitment_version)""",
    "commitment_version",
)
def grf_orphans(spark, sf_dir):
    """Versions whose parent doesn't exist; some parents are spoilt first."""
    v = P.commitment_version(spark, sf_dir)
    broken = v.select("version_id", F.when(F.col("version_id") % 11 == 0, -F.col("version_id")).otherwise(F.col("parent_version_id")).alias("parent"))
    return broken.where("parent is not null").join(v.select(F.col("version_id").alias("parent")), "parent", "left_anti").select("version_id", "parent")


@query(
    "grf_reach_origin",
    """
WITH RECURSIVE t AS (
  SELECT version_id, version_id AS origin, 0 AS depth FROM commitment_version WHERE parent_version_id IS NULL
  UNION ALL SELECT v.version_id, t.origin, t.depth + 1 FROM t JOIN commitment_version v ON v.parent_version_id = t.version_id)
SELECT version_id, origin, depth FROM t""",
    "commitment_version",
)
def grf_reach_origin(spark, sf_dir):
    """The origin of each version and the steps to it; versions that reach none are left out."""
    v = P.commitment_version(spark, sf_dir)
    roots = v.where("parent_version_id is null").select(F.col("version_id").alias("origin"))
    up = topmost_ancestors(parent_edges(v)).select(F.col("node").alias("version_id"), F.col("ancestor").alias("origin"), "depth")
    return up.join(roots, "origin").select("version_id", "origin", "depth").unionAll(roots.select(F.col("origin").alias("version_id"), "origin", F.lit(0)))


@query(
    "grf_children",
    "SELECT parent_version_id AS version_id, CAST(count(*) AS BIGINT) AS n_children, min(version_id) AS first_child FROM commitment_version WHERE parent_version_id IS NOT NULL GROUP BY parent_version_id",
    "commitment_version",
)
def grf_children(spark, sf_dir):
    v = P.commitment_version(spark, sf_dir).where("parent_version_id is not null")
    return v.groupBy(F.col("parent_version_id").alias("version_id")).agg(F.count("*").alias("n_children"), F.min("version_id").alias("first_child"))


@query(
    "grf_history_by_field",
    """
WITH e AS (SELECT v.version_id, v.agreement_id, v.canonical_key, v.valid_from, v.threshold, v.status, p.threshold AS t0, p.status AS s0
  FROM commitment_version v JOIN commitment_version p ON p.version_id = v.parent_version_id)
SELECT agreement_id, canonical_key, 'threshold' AS field, version_id, valid_from, CAST(t0 AS VARCHAR) IS NOT NULL AS has_old FROM e WHERE t0 <> threshold
UNION ALL SELECT agreement_id, canonical_key, 'status', version_id, valid_from, s0 IS NOT NULL FROM e WHERE s0 <> status""",
    "commitment_version",
)
def grf_history_by_field(spark, sf_dir):
    """One row per change of a field along the edges."""
    v = P.commitment_version(spark, sf_dir)
    old = v.select(F.col("version_id").alias("parent_version_id"), F.col("threshold").alias("t0"), F.col("status").alias("s0"))
    fields = F.filter(
        F.array(
            F.when(F.col("t0") != F.col("threshold"), F.struct(F.lit("threshold").alias("field"), F.col("t0").isNotNull().alias("has_old"))),
            F.when(F.col("s0") != F.col("status"), F.struct(F.lit("status").alias("field"), F.col("s0").isNotNull().alias("has_old"))),
        ),
        lambda f: f.isNotNull(),
    )
    return v.join(old, "parent_version_id").select("agreement_id", "canonical_key", F.explode(fields).alias("f"), "version_id", "valid_from").select(
        "agreement_id", "canonical_key", "f.field", "version_id", "valid_from", "f.has_old"
    )


@query(
    "grf_edge_status_machine",
    """
WITH s AS (SELECT user_id, event_id, event_type,
    CASE event_type WHEN 'purchase' THEN 'VALIDATED' WHEN 'error' THEN 'REJECTED' ELSE 'PENDING' END AS to_status,
    lag(CASE event_type WHEN 'purchase' THEN 'VALIDATED' WHEN 'error' THEN 'REJECTED' ELSE 'PENDING' END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status FROM events)
SELECT user_id, event_id, from_status, to_status, from_status IS NOT NULL AND from_status <> 'PENDING' AS illegal FROM s""",
)
def grf_edge_status_machine(spark, sf_dir):
    """A pending edge becomes validated or rejected; any change of a settled one is illegal."""
    to = F.when(F.col("event_type") == "purchase", "VALIDATED").when(F.col("event_type") == "error", "REJECTED").otherwise("PENDING")
    before = F.lag(to).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    moves = P.read(spark, sf_dir, "events").select("user_id", "event_id", before.alias("from_status"), to.alias("to_status"))
    return moves.withColumn("illegal", F.col("from_status").isNotNull() & (F.col("from_status") != "PENDING"))


@query(
    "grf_version_graph",
    """
SELECT agreement_id, canonical_key, version_id, parent_version_id,
       CASE WHEN parent_version_id IS NULL THEN 'ADDS' WHEN status = 'WAIVED' THEN 'WAIVES' WHEN status = 'SUSPENDED' THEN 'SUPERSEDES' ELSE 'MODIFIES' END AS edge_type
FROM commitment_version""",
    "commitment_version",
)
def grf_version_graph(spark, sf_dir):
    """Nodes with the kind of the edge that leads to them."""
    kind = F.when(F.col("parent_version_id").isNull(), "ADDS").when(F.col("status") == "WAIVED", "WAIVES").when(F.col("status") == "SUSPENDED", "SUPERSEDES").otherwise("MODIFIES")
    return P.commitment_version(spark, sf_dir).select("agreement_id", "canonical_key", "version_id", "parent_version_id", kind.alias("edge_type"))


@query(
    "grf_degree_risk",
    """
WITH e AS (SELECT DISTINCT l_suppkey AS source, l_partkey % 40 AS target FROM lineitem),
d AS (SELECT target AS node, count(*) AS in_degree FROM e GROUP BY target)
SELECT node, in_degree, CASE WHEN in_degree >= 8 THEN 'HIGH' WHEN in_degree >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM d""",
)
def grf_degree_risk(spark, sf_dir):
    """How many depend on a node, in bands from 3 and from 8."""
    edges = P.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 40).alias("target"))
    degree = edges.groupBy(F.col("target").alias("node")).agg(F.count_distinct("source").alias("in_degree"))
    return degree.withColumn("risk", F.when(F.col("in_degree") >= 8, "HIGH").when(F.col("in_degree") >= 3, "MEDIUM").otherwise("LOW"))
