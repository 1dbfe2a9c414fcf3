"""Traces of a commitment's identity back to its origin, and whether the origin is reached.

An edge leads from a predecessor to a successor; most keep the identity, some change it (renames, merges, splits). A trace takes the
newest edge of the identity that it hasn't taken yet; an edge that changes the identity leads on to its predecessor; it ends where no edge is left.

Between two changes a trace only counts down the edges of one identity, so an identity is one hop: to the predecessor of its newest
changing edge. Hops are doubled (pointer jumping), about log2(hops) rounds. Where hops lead into a cycle the trace comes back to identities whose newest
edges it has taken; only those traces are walked hop by hop, all at once, and each remembers how far it got in which identity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query
from ..storage import materialise
from .ordering import with_ordinals_within

#: The kinds of edges that need no predecessor.
ORIGIN_CLASS, ORIGIN_FAMILY = "ORIGINATES_FROM", "CREATE"


def reaches_origin(predecessor: Column, successor: Column, edge_class: Column, family: Column, known: Column) -> Column:
    """The verdict on a trace by its last edge: it originates, or keeps the identity (the edge before it lies outside), or creates without predecessor, or has a predecessor with edges."""
    other = F.when(predecessor.isNull(), F.coalesce(family == ORIGIN_FAMILY, F.lit(False))).otherwise((predecessor == successor) | known)
    return F.coalesce(edge_class == ORIGIN_CLASS, F.lit(False)) | other


class Traces:
    """All traces over ``edges`` (edge_id, predecessor, successor, edge_class, family, at), the newest being the one with the greatest (at, edge_id).

    Null successors take no part; a null predecessor changes the identity to none. An edge_id is expected once.
    """

    def __init__(self, edges: DataFrame) -> None:
        own = edges.where("successor is not null").select("edge_id", "predecessor", "successor", "edge_class", "family", "at")
        # pos 1 is the newest edge of its identity
        self.edges = materialise(with_ordinals_within(own, ["successor"], F.desc("at"), F.desc("edge_id"), name="pos"))
        edge = F.struct("edge_id", "predecessor", "successor", "edge_class", "family")
        self.ends = materialise(self.edges.groupBy(F.col("successor").alias("id")).agg(F.max("pos").alias("n"), F.max_by(edge, "pos").alias("oldest")))
        changing = self.edges.where("predecessor is null or predecessor <> successor")
        known = self.ends.select(F.col("id").alias("predecessor"), F.lit(True).alias("known"))
        numbered = with_ordinals_within(changing.select(F.col("successor").alias("id"), "predecessor", "pos", edge.alias("edge")), ["id"], "pos", name="turn")
        self.turns = materialise(numbered.join(known, "predecessor", "left").withColumn("known", F.coalesce("known", F.lit(False))))
        first = self.turns.where("turn = 1").select("id", "pos", "predecessor", "edge", "known")
        #: one hop of each identity: where to (null: the trace ends here), after how many edges, by which edge
        self.hops = materialise(
            self.ends.join(first, "id", "left").select(
                "id", F.when(F.col("known"), F.col("predecessor")).alias("up"), F.coalesce("pos", "n").alias("taken"), F.coalesce("edge", "oldest").alias("edge"), F.coalesce("known", F.lit(True)).alias("known")
            )
        )
        self._jump()

    def _jump(self) -> None:
        """``straight``: (id, root, before, changes), of the traces that end; ``lost``: the identities whose traces run into cycles."""
        ends = F.col("up").isNull()
        now = self.hops.select("id", F.coalesce("up", "id").alias("to"), F.when(ends, 0).otherwise(F.col("taken")).cast("long").alias("before"), F.when(ends, 0).otherwise(1).cast("long").alias("changes"), ends.alias("done"))
        now, left = materialise(now), None
        while (open_ := now.where("not done").count()) != left and open_:
            left = open_
            further = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("before").alias("b2"), F.col("changes").alias("c2"), F.col("done").alias("d2"))
            moved = now.where("not done").join(further, "to").select("id", F.col("to2").alias("to"), (F.col("before") + F.col("b2")).alias("before"), (F.col("changes") + F.col("c2")).alias("changes"), F.col("d2").alias("done"))
            now = materialise(now.where("done").unionAll(moved))
        self.straight = now.where("done").select("id", F.col("to").alias("root"), "before", "changes")
        self.lost = now.where("not done").select("id")

    def _walk(self) -> DataFrame:
        """Traces through cycles: (id, path, edge, known), path the stretches taken: (id, after, upto) by the positions of edges."""
        none = F.array().cast("array<struct<id: bigint, after: bigint, upto: bigint>>")
        edge = self.hops.schema["edge"].dataType
        now = materialise(self.lost.select("id", F.col("id").alias("here"), none.alias("path"), F.lit(None).cast(edge).alias("edge")))
        finished = []
        turns = self.turns.select(F.col("id").alias("here"), "turn", "pos", "predecessor", F.col("edge").alias("next"), "known")
        ends = self.ends.select(F.col("id").alias("here"), "n", "oldest")
        while not now.isEmpty():
            mine = F.filter("path", lambda s: s["id"] == F.col("here"))
            at = now.withColumn("turn", F.size(mine).cast("long") + 1).withColumn("after", F.coalesce(F.array_max(F.transform(mine, lambda s: s["upto"])), F.lit(0).cast("long")))
            stepped = at.join(turns, ["here", "turn"], "left").join(ends, "here")
            turned = F.col("pos").isNotNull()
            upto = F.coalesce("pos", "n")
            stretch = F.when(upto > F.col("after"), F.array(F.struct(F.col("here").alias("id"), F.col("after").alias("after"), upto.alias("upto")))).otherwise(none)
            last = F.when(turned, F.col("next")).when(F.col("n") > F.col("after"), F.col("oldest")).otherwise(F.col("edge"))
            # the last edge may be one that led to an identity whose edges were all taken: such an identity is known
            on = stepped.select("id", F.when(turned & F.col("known"), F.col("predecessor")).alias("here"), F.concat("path", stretch).alias("path"), last.alias("edge"), F.coalesce("known", F.lit(True)).alias("known"))
            now = materialise(on)
            finished.append(now.where("here is null").select("id", "path", "edge", "known"))
            now = now.where("here is not null").drop("known")
        return reduce(DataFrame.unionAll, finished) if finished else self.lost.select("id", none.alias("path"), F.lit(None).cast(edge).alias("edge"), F.lit(True).alias("known"))

    def summaries(self) -> DataFrame:
        """(id, n_edges, changes, terminal_edge, reachable) of every identity that an edge names; one without edges has no trace and isn't reached."""
        ends = self.hops.select(F.col("id").alias("root"), "taken", "edge", "known", "up")
        changed = lambda e: (e["predecessor"].isNull() | (e["predecessor"] != e["successor"])).cast("long")
        straight = self.straight.join(ends, "root").select("id", (F.col("before") + F.col("taken")).alias("n_edges"), (F.col("changes") + changed(F.col("edge"))).alias("changes"), "edge", "known")
        self.walked = materialise(self._walk())
        taken = F.aggregate("path", F.lit(0).cast("long"), lambda n, s: n + s["upto"] - s["after"])
        # every stretch but the last ends in a change; the last does if its edge changes the identity
        turns = F.size("path").cast("long") - 1 + changed(F.col("edge"))
        walked = self.walked.select("id", taken.alias("n_edges"), turns.alias("changes"), "edge", "known")
        verdict = reaches_origin(F.col("edge.predecessor"), F.col("edge.successor"), F.col("edge.edge_class"), F.col("edge.family"), F.col("known"))
        found = straight.unionAll(walked).select("id", "n_edges", "changes", F.col("edge.edge_id").alias("terminal_edge"), verdict.alias("reachable"))
        nowhere = self.edges.where("predecessor is not null").select(F.col("predecessor").alias("id")).distinct().join(self.ends.select("id"), "id", "left_anti")
        return found.unionAll(nowhere.select("id", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(None).cast(found.schema["terminal_edge"].dataType), F.lit(False)))

    def chains(self) -> DataFrame:
        """(id, position, edge_id): every trace edge by edge, the newest first. As many rows as all traces have edges; call after ``summaries``."""
        jumps = materialise(self.hops.where("up is not null").join(self.straight.select("id"), "id").select("id", F.col("up").alias("to"), F.col("taken").cast("long").alias("n")))
        reached = materialise(self.straight.select("id", F.col("id").alias("own"), F.lit(0).cast("long").alias("before")))
        while not jumps.isEmpty():
            later = jumps.join(reached.select(F.col("id").alias("to"), "own", "before"), "to").select("id", "own", (F.col("before") + F.col("n")).alias("before"))
            further = jumps.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"))
            reached = materialise(reached.unionAll(later))
            jumps = materialise(jumps.join(further, "to").select("id", F.col("to2").alias("to"), (F.col("n") + F.col("n2")).alias("n")))
        straight = reached.join(self.hops.select(F.col("id").alias("own"), F.col("taken").alias("upto")), "own").select("id", "own", F.lit(0).cast("long").alias("after"), "upto", "before")
        before = F.aggregate(F.slice("path", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda n, s: n + s["upto"] - s["after"])
        walked = self.walked.select("id", "path", F.posexplode("path").alias("k", "s")).select("id", F.col("s.id").alias("own"), "s.after", "s.upto", before.alias("before"))
        stretches = straight.unionAll(walked)
        taken = self.edges.select(F.col("successor").alias("own"), "pos", "edge_id").join(stretches, "own").where("after < pos and pos <= upto")
        return taken.select("id", (F.col("before") + F.col("pos") - F.col("after")).alias("position"), "edge_id")


P.SQL["identity_edge"] = """
SELECT o_orderkey AS edge_id, CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_custkey % 8 > 0 THEN o_custkey - 1 ELSE -o_custkey END
    WHEN o_orderkey % 41 = 0 AND o_custkey % 8 < 7 THEN o_custkey + 1 WHEN o_orderkey % 43 = 0 THEN o_custkey - o_custkey % 8 ELSE o_custkey END AS predecessor, o_custkey AS successor,
  CASE WHEN o_orderkey % 17 = 0 THEN 'ORIGINATES_FROM' ELSE 'MODIFIES' END AS edge_class,
  CASE WHEN o_orderkey % 58 = 0 OR o_orderkey % 13 = 0 THEN 'CREATE' WHEN o_orderkey % 29 = 0 THEN 'TERMINATE' WHEN o_orderkey % 7 = 0 THEN 'RENUMBER' ELSE 'SCALAR_REPLACEMENT' END AS family, o_orderdate AS at
FROM orders"""


def identity_edge(spark, sf_dir) -> DataFrame:
    """Edges between commitments: renames to a neighbour, some of which has none of its own, merges into the first of eight, some back (cycles), ends and new beginnings."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    renamed = F.when(c % 8 > 0, c - 1).otherwise(-c)
    predecessor = F.when(k % 29 == 0, None).when(k % 7 == 0, renamed).when((k % 41 == 0) & (c % 8 < 7), c + 1).when(k % 43 == 0, c - c % 8).otherwise(c)
    family = F.when((k % 58 == 0) | (k % 13 == 0), "CREATE").when(k % 29 == 0, "TERMINATE").when(k % 7 == 0, "RENUMBER").otherwise("SCALAR_REPLACEMENT")
    return P.read(spark, sf_dir, "orders").select(
        k.alias("edge_id"), predecessor.alias("predecessor"), c.alias("successor"), F.when(k % 17 == 0, "ORIGINATES_FROM").otherwise("MODIFIES").alias("edge_class"), family.alias("family"), F.col("o_orderdate").alias("at")
    )


_TRACE = """
WITH RECURSIVE t AS (
  SELECT id AS id, id AS here, CAST([] AS BIGINT[]) AS taken, CAST(0 AS BIGINT) AS changes FROM (SELECT successor AS id FROM identity_edge UNION SELECT predecessor FROM identity_edge WHERE predecessor IS NOT NULL)
  UNION ALL
  SELECT id, here, list_append(taken, edge_id), changes + CAST(here IS DISTINCT FROM successor AS BIGINT) FROM (
    SELECT t.id, e.predecessor AS here, t.taken, t.changes, e.edge_id, e.successor FROM t JOIN identity_edge e ON e.successor = t.here AND NOT list_contains(t.taken, e.edge_id)
    QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY e.at DESC, e.edge_id DESC) = 1)),
whole AS (SELECT id, arg_max(taken, len(taken)) AS taken, max(changes) AS changes FROM t GROUP BY id)
"""
_VERDICT = """
, s AS (
  SELECT id, CAST(len(taken) AS BIGINT) AS n_edges, changes, taken[-1] AS terminal_edge FROM whole),
v AS (
  SELECT s.*, coalesce(edge_class = 'ORIGINATES_FROM' OR CASE WHEN predecessor IS NULL THEN family = 'CREATE' ELSE predecessor = successor OR predecessor IN (SELECT successor FROM identity_edge) END, false) AS reachable
  FROM s LEFT JOIN identity_edge e ON e.edge_id = s.terminal_edge)
"""


@query("grf_trace_to_origin", _TRACE + _VERDICT + "SELECT id, n_edges, changes, terminal_edge, reachable FROM v", "identity_edge")
def grf_trace_to_origin(spark, sf_dir):
    """Each commitment's trace: its length, its changes of identity, its last edge, and whether it reaches an origin."""
    return Traces(identity_edge(spark, sf_dir)).summaries()


@query("grf_edge_reachability", _TRACE + _VERDICT + "SELECT edge_id, successor, reachable, v.terminal_edge FROM identity_edge JOIN v ON v.id = successor", "identity_edge")
def grf_edge_reachability(spark, sf_dir):
    """Every edge with the verdict on the commitment that it leads to."""
    traces = Traces(identity_edge(spark, sf_dir))
    verdicts = traces.summaries().select(F.col("id").alias("successor"), "reachable", "terminal_edge")
    return traces.edges.join(verdicts, "successor").select("edge_id", "successor", "reachable", "terminal_edge")


@query("grf_trace_chains", _TRACE + "SELECT id, unnest(range(1, len(taken) + 1)) AS position, unnest(taken) AS edge_id FROM whole", "identity_edge")
def grf_trace_chains(spark, sf_dir):
    """Every trace, edge by edge."""
    traces = Traces(identity_edge(spark, sf_dir))
    traces.summaries()
    return traces.chains()
