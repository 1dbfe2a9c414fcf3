"""Folding instructions over commitment states.

An instruction reads and writes its own key only, so the fold is independent for every (agreement, key). A key may have
any number of instructions: they are cut into ordered segments, each segment becomes a table of what it makes of every
status, and a key's tables, one for each segment, are chained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query

STATE = "struct<status:string,value:double,applied:int,unresolved:int>"


def _step(state: Column, i: Column) -> Column:
    """One guarded instruction: what can't be applied leaves the state as it is and counts as unresolved."""
    kind, exists = i["instruction_type"], state["status"].isNotNull()
    done = lambda status, value: F.struct(status.alias("status"), value.alias("value"), (state["applied"] + 1).alias("applied"), state["unresolved"].alias("unresolved"))
    failed = F.struct(state["status"].alias("status"), state["value"].alias("value"), state["applied"].alias("applied"), (state["unresolved"] + 1).alias("unresolved"))
    return (
        F.when((kind == "ADD_COMMITMENT") & ~exists, done(F.lit("ACTIVE"), i["new_value"]))
        .when((kind == "REPLACE_VALUE") & exists, done(state["status"], i["new_value"]))
        .when((kind == "WAIVE_TEMPORARILY") & exists, done(F.lit("WAIVED"), state["value"]))
        .when((kind == "REINSTATE") & exists, done(F.lit("ACTIVE"), state["value"]))
        .when((kind == "SUSPEND") & exists, done(F.lit("SUSPENDED"), state["value"]))
        .when((kind == "DELETE_COMMITMENT") & exists, done(F.lit("DELETED"), state["value"]))
        .when(kind == "RENUMBER_REFERENCE", state)
        .otherwise(failed)
    )


#: The statuses in which a segment may begin; null, before a commitment is added, first.
STATUSES = (None, "ACTIVE", "WAIVED", "SUSPENDED", "DELETED")
#: As STATE, but for a segment: whether it sets a value of its own, and which.
EXIT = "struct<status:string,value:struct<own:boolean,value:double>,applied:int,unresolved:int>"


def segment_tables(instructions: DataFrame) -> DataFrame:
    """(agreement_id, target_key, segment, exits): of each segment of a key's instructions the outcome for each of STATUSES.

    A segment is what a range partition in the order of key and ``step`` has of the key, so no key's instructions need meet in a task.
    """
    ranged = instructions.select("agreement_id", "target_key", "step", "instruction_type", "new_value").repartitionByRange("agreement_id", "target_key", "step", "instruction_type", "new_value")
    cut = ranged.withColumn("segment", F.spark_partition_id())
    new = F.struct(F.lit(True).alias("own"), F.col("new_value").cast("double").alias("value")).alias("new_value")
    ordered = F.array_sort(F.collect_list(F.struct("step", "instruction_type", new)))
    entry = lambda s: F.expr(f"cast(named_struct('status', {'null' if s is None else repr(s)}, 'value', named_struct('own', false, 'value', null), 'applied', 0, 'unresolved', 0) as {EXIT})")
    exits = F.aggregate(ordered, F.array(*map(entry, STATUSES)), lambda states, i: F.transform(states, lambda s: _step(s, i).cast(EXIT)))
    return cut.groupBy("agreement_id", "target_key", "segment").agg(exits.alias("exits"))


def fold_instructions(instructions: DataFrame) -> DataFrame:
    """Final state of each (agreement_id, target_key) after its instructions in the order of ``step``.

    Columns: status and value (null if never added), applied, unresolved, and outcome: COMPLETE, PARTIAL or UNRESOLVED.
    """
    tables = F.array_sort(F.collect_list(F.struct("segment", "exits")))
    start = F.expr(f"cast(named_struct('status', null, 'value', null, 'applied', 0, 'unresolved', 0) as {STATE})")

    def chain(s: Column, table: Column) -> Column:
        at = F.when(s["status"].isNull(), 1).otherwise(F.array_position(F.array(*map(F.lit, STATUSES)), s["status"]).cast("int"))
        out = F.element_at(table["exits"], at)
        value = F.when(out["value"]["own"], out["value"]["value"]).otherwise(s["value"])
        return F.struct(out["status"].alias("status"), value.alias("value"), (s["applied"] + out["applied"]).alias("applied"), (s["unresolved"] + out["unresolved"]).alias("unresolved")).cast(STATE)

    folded = segment_tables(instructions).groupBy("agreement_id", "target_key").agg(F.aggregate(tables, start, chain).alias("s"))
    return folded.select("agreement_id", "target_key", "s.*").withColumn("outcome", execution_status(F.col("applied"), F.col("unresolved")))


def execution_status(applied: Column, unresolved: Column) -> Column:
    return (
        F.when((applied == 0) & (unresolved == 0), "COMPLETE").when(applied == 0, "UNRESOLVED").when(unresolved > 0, "PARTIAL").otherwise("COMPLETE")
    )


_FOLD_SQL = """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY agreement_id, target_key ORDER BY step) AS n FROM instruction_stream),
f AS (
  SELECT agreement_id, target_key, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS DOUBLE) AS value, 0 AS applied, 0 AS unresolved
  FROM (SELECT DISTINCT agreement_id, target_key FROM o)
  UNION ALL
  SELECT f.agreement_id, f.target_key, o.n,
    CASE WHEN instruction_type = 'ADD_COMMITMENT' AND status IS NULL THEN 'ACTIVE'
         WHEN instruction_type = 'WAIVE_TEMPORARILY' AND status IS NOT NULL THEN 'WAIVED' ELSE status END,
    CASE WHEN instruction_type = 'ADD_COMMITMENT' AND status IS NULL OR instruction_type = 'REPLACE_VALUE' AND status IS NOT NULL THEN new_value ELSE value END,
    applied + CASE WHEN instruction_type = 'ADD_COMMITMENT' AND status IS NULL OR instruction_type = 'REPLACE_VALUE' AND status IS NOT NULL
         OR instruction_type = 'WAIVE_TEMPORARILY' AND status IS NOT NULL THEN 1 ELSE 0 END,
    unresolved + CASE WHEN instruction_type = 'RENUMBER_REFERENCE' OR instruction_type = 'ADD_COMMITMENT' AND status IS NULL
         OR instruction_type = 'REPLACE_VALUE' AND status IS NOT NULL OR instruction_type = 'WAIVE_TEMPORARILY' AND status IS NOT NULL THEN 0 ELSE 1 END
  FROM f JOIN o ON o.agreement_id = f.agreement_id AND o.target_key = f.target_key AND o.n = f.n + 1),
last AS (SELECT *, row_number() OVER (PARTITION BY agreement_id, target_key ORDER BY n DESC) AS rn FROM f)
"""
_OUTCOME = "CASE WHEN applied = 0 AND unresolved = 0 THEN 'COMPLETE' WHEN applied = 0 THEN 'UNRESOLVED' WHEN unresolved > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END"


@query("sta_fold_replace_guarded", _FOLD_SQL + f"SELECT agreement_id, target_key, status, value, applied, unresolved, {_OUTCOME} AS outcome FROM last WHERE rn = 1", "instruction_stream")
def sta_fold_replace_guarded(spark, sf_dir):
    return fold_instructions(P.instruction_stream(spark, sf_dir))


@query("sta_fold_status", _FOLD_SQL + f"SELECT {_OUTCOME} AS outcome, CAST(count(*) AS BIGINT) AS n, CAST(sum(applied) AS BIGINT) AS applied FROM last WHERE rn = 1 GROUP BY 1", "instruction_stream")
def sta_fold_status(spark, sf_dir):
    return fold_instructions(P.instruction_stream(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("applied").alias("applied"))


@query(
    "sta_list_add_remove",
    """
WITH x AS (SELECT o_custkey AS agreement_id, list_sort(list_distinct(list(o_orderpriority))) AS parties FROM orders GROUP BY o_custkey)
SELECT agreement_id, len(parties) AS n_before,
       array_to_string(list_sort(list_distinct(list_append(parties, '9-NEW'))), '|') AS after_add,
       array_to_string(list_filter(parties, lambda p: p <> '1-URGENT'), '|') AS after_remove,
       NOT list_contains(parties, '1-URGENT') AS removal_unresolved FROM x""",
)
def sta_list_add_remove(spark, sf_dir):
    """Adding is idempotent and keeps order; removing what isn't there stays unresolved."""
    lists = P.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("agreement_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("parties"))
    return lists.select(
        "agreement_id",
        F.size("parties").cast("long").alias("n_before"),
        F.array_join(F.array_sort(F.array_union("parties", F.array(F.lit("9-NEW")))), "|").alias("after_add"),
        F.array_join(F.array_remove("parties", "1-URGENT"), "|").alias("after_remove"),
        (~F.array_contains("parties", "1-URGENT")).alias("removal_unresolved"),
    )


@query(
    "sta_execution_status",
    f"""
WITH c AS (SELECT amendment_version_id, CAST(count(*) FILTER (status = 'APPLIED' AND instruction_type <> 'UNRESOLVED') AS BIGINT) AS applied,
  CAST(count(*) FILTER (status <> 'APPLIED' OR instruction_type = 'UNRESOLVED') AS BIGINT) AS unresolved FROM amendment_instruction GROUP BY 1)
SELECT amendment_version_id, applied, unresolved, {_OUTCOME} AS outcome FROM c""",
    "amendment_instruction",
)
def sta_execution_status(spark, sf_dir):
    ok = (F.col("status") == "APPLIED") & (F.col("instruction_type") != "UNRESOLVED")
    counts = P.amendment_instruction(spark, sf_dir).groupBy("amendment_version_id").agg(F.count_if(ok).alias("applied"), F.count_if(~ok).alias("unresolved"))
    return counts.withColumn("outcome", execution_status(F.col("applied"), F.col("unresolved")))


def inherited_unresolved(instructions: DataFrame) -> DataFrame:
    """Unresolved work that each step inherits: opened at an earlier step and not yet resolved before it ends.

    Columns in: agreement_id, step, target_key, instruction_type. An unresolved item is resolved by the first strictly later
    constructive instruction on its key. Openings and closings become +1 and -1 events; a running sum over them
    replaces a join of every item with every step.
    """
    key = W.partitionBy("agreement_id", "target_key").orderBy("step").rowsBetween(1, W.unboundedFollowing)
    constructive = F.when(F.col("instruction_type").isin("ADD_COMMITMENT", "REPLACE_VALUE"), F.col("step"))
    items = instructions.withColumn("closed_at", F.min(constructive).over(key))
    opened = items.where("instruction_type = 'UNRESOLVED'")
    events = opened.select("agreement_id", "step", F.lit(1).alias("d")).unionAll(opened.where("closed_at is not null").select("agreement_id", F.col("closed_at"), F.lit(-1)))
    steps = instructions.select("agreement_id", "step").distinct()
    moves = events.groupBy("agreement_id", "step").agg(F.sum("d").alias("change"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("own"))
    running = W.partitionBy("agreement_id").orderBy("step")
    total = F.sum(F.coalesce("change", F.lit(0))).over(running)
    own = F.coalesce("own", F.lit(0)).alias("own")
    return steps.join(moves, ["agreement_id", "step"], "left").select("agreement_id", "step", own, (total - own).alias("inherited"))


_INHERITED = """
WITH i AS (SELECT *, min(CASE WHEN instruction_type IN ('ADD_COMMITMENT', 'REPLACE_VALUE') THEN step END)
    OVER (PARTITION BY agreement_id, target_key ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed_at FROM instruction_stream),
u AS (SELECT agreement_id, step AS opened, closed_at FROM i WHERE instruction_type = 'UNRESOLVED'),
s AS (SELECT s.agreement_id, s.step,
  (SELECT CAST(count(*) AS BIGINT) FROM u WHERE u.agreement_id = s.agreement_id AND u.opened = s.step) AS own,
  (SELECT CAST(count(*) AS BIGINT) FROM u WHERE u.agreement_id = s.agreement_id AND u.opened < s.step AND (u.closed_at IS NULL OR u.closed_at > s.step)) AS inherited
  FROM instruction_stream s)
"""


@query("sta_inherited_unresolved", _INHERITED + "SELECT agreement_id, step, own, inherited FROM s", "instruction_stream")
def sta_inherited_unresolved(spark, sf_dir):
    return inherited_unresolved(P.instruction_stream(spark, sf_dir))


@query("sta_authority_steps", _INHERITED + "SELECT agreement_id, step, own = 0 AND inherited = 0 AS resolving, (sum(own) OVER (PARTITION BY agreement_id ORDER BY step)) = 0 AS never_resolving FROM s", "instruction_stream")
def sta_authority_steps(spark, sf_dir):
    """Whether a step is authoritative, by the two definitions: with later resolution, and without."""
    open_items = inherited_unresolved(P.instruction_stream(spark, sf_dir))
    before = F.sum("own").over(W.partitionBy("agreement_id").orderBy("step"))
    return open_items.select("agreement_id", "step", F.expr("own = 0 and inherited = 0").alias("resolving"), (before == 0).alias("never_resolving"))


@query(
    "sta_persistence_plan",
    "SELECT amendment_version_id, target_key, min(effective_start) AS effective_start, CAST(count(*) AS BIGINT) AS n_instructions FROM amendment_instruction WHERE instruction_type <> 'UNRESOLVED' GROUP BY 1, 2",
    "amendment_instruction",
)
def sta_persistence_plan(spark, sf_dir):
    """One new version per target of an amendment, from the earliest start of its instructions."""
    i = P.amendment_instruction(spark, sf_dir).where("instruction_type <> 'UNRESOLVED'")
    return i.groupBy("amendment_version_id", "target_key").agg(F.min("effective_start").alias("effective_start"), F.count("*").alias("n_instructions"))


EDGE_OF = {"WAIVE_TEMPORARILY": "WAIVES", "REINSTATE": "REINSTATES", "DELETE_COMMITMENT": "SUPERSEDES", "DELETE": "SUPERSEDES"}


def edge_type(instruction_type: Column) -> Column:
    out = F.lit("MODIFIES")
    for kind, edge in EDGE_OF.items():
        out = F.when(instruction_type == kind, edge).otherwise(out)
    return out


@query(
    "sta_edge_types",
    "SELECT CASE instruction_type WHEN 'WAIVE_TEMPORARILY' THEN 'WAIVES' WHEN 'REINSTATE' THEN 'REINSTATES' WHEN 'DELETE' THEN 'SUPERSEDES' ELSE 'MODIFIES' END AS edge_type, CAST(count(*) AS BIGINT) AS n FROM instruction_stream GROUP BY 1",
    "instruction_stream",
)
def sta_edge_types(spark, sf_dir):
    return P.instruction_stream(spark, sf_dir).groupBy(edge_type(F.col("instruction_type")).alias("edge_type")).agg(F.count("*").alias("n"))


@query(
    "sta_reference_events",
    "SELECT agreement_id, step, target_key AS old_ref, concat(target_key, 'a') AS new_ref FROM instruction_stream WHERE instruction_type = 'RENUMBER_REFERENCE' AND target_key <> 'k0'",
    "instruction_stream",
)
def sta_reference_events(spark, sf_dir):
    """Renumberings with both references; those lacking one stay unresolved and give no event."""
    i = P.instruction_stream(spark, sf_dir).where("instruction_type = 'RENUMBER_REFERENCE'")
    return i.withColumn("new_ref", F.when(F.col("target_key") != "k0", F.concat("target_key", F.lit("a")))).where("new_ref is not null").select("agreement_id", "step", F.col("target_key").alias("old_ref"), "new_ref")


@query(
    "sta_resolution_match",
    """
SELECT u.agreement_id, u.step AS unresolved_step, min(r.step) AS resolved_by FROM instruction_stream u
LEFT JOIN instruction_stream r ON r.agreement_id = u.agreement_id AND r.target_key = u.target_key AND r.step > u.step AND r.instruction_type IN ('ADD_COMMITMENT', 'REPLACE_VALUE')
WHERE u.instruction_type = 'UNRESOLVED' GROUP BY 1, 2""",
    "instruction_stream",
)
def sta_resolution_match(spark, sf_dir):
    """The first later constructive instruction on the same key, found in one sort of the key instead of a range join."""
    later = W.partitionBy("agreement_id", "target_key").orderBy("step").rowsBetween(1, W.unboundedFollowing)
    found = F.min(F.when(F.col("instruction_type").isin("ADD_COMMITMENT", "REPLACE_VALUE"), F.col("step"))).over(later)
    return P.instruction_stream(spark, sf_dir).withColumn("resolved_by", found).where("instruction_type = 'UNRESOLVED'").select("agreement_id", F.col("step").alias("unresolved_step"), "resolved_by")


@query(
    "sta_apply_families",
    """
SELECT version_id, CASE WHEN version_id % 5 = 0 THEN 'TERMINATED' WHEN version_id % 5 = 1 THEN 'WAIVED' WHEN version_id % 5 = 2 THEN 'ACTIVE' ELSE status END AS new_status,
       CASE WHEN version_id % 5 = 3 THEN threshold * 2 ELSE threshold END AS new_threshold FROM commitment_version""",
    "commitment_version",
)
def sta_apply_families(spark, sf_dir):
    """What a family of transformation does to a state: terminate, waive, reinstate, replace a scalar, nothing."""
    family = F.element_at(F.array(*map(F.lit, ("TERMINATE", "WAIVER", "REINSTATEMENT", "SCALAR_REPLACEMENT", "NONE"))), (F.col("version_id") % 5 + 1).cast("int"))
    v = P.commitment_version(spark, sf_dir).withColumn("family", family)
    status = F.when(F.col("family") == "TERMINATE", "TERMINATED").when(F.col("family") == "WAIVER", "WAIVED").when(F.col("family") == "REINSTATEMENT", "ACTIVE").otherwise(F.col("status"))
    return v.select("version_id", status.alias("new_status"), F.when(F.col("family") == "SCALAR_REPLACEMENT", F.col("threshold") * 2).otherwise(F.col("threshold")).alias("new_threshold"))
