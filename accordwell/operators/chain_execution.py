"""Whole chains: an original state, amendments one after another, waivers that end in between, and whether each step may be relied on.

An amendment reads and writes the state of its targets, so a (chain, target) is a key of its own: its original state, its
instructions and the time of comparison come in order, past one small state. A waiver schedules the terms that hold when it is over:
those at the end of its amendment. They come into force before the first later amendment that takes effect by then, or at the comparison. The stream of
``streaming.chains`` applies the same steps and has timers for the restores.

Amendments of a chain don't take effect before those that they follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..functions.columns import python_values
from ..registry import query
from ..storage import materialise
from .execution import LISTS, effective_field, resolutions, step
from .state import execution_status

STATE = "status string, valid_from long, valid_to long, waived_from long, waived_to long, fields map<string,string>, exceptions array<string>, party array<string>"
ROW = (
    "chain_id long, target_key string, amendment_number int, instruction_order int, at long, instruction_type string, domain_effect string, field string, "
    "old_value string, new_value string, payload map<string,string>, old_ref string, new_ref string, effective_start long, effective_end long"
)
#: Kinds of result rows: an event for each instruction, a restore, an error of an amendment's plan, a key's state at the comparison.
RESULT = f"kind string, chain_id long, target_key string, amendment_number int, instruction_order int, instruction_type string, wanted string, outcome string, action string, field_ string, old string, new string, {STATE}"
_NAMES = [c.strip().split()[0] for c in ROW.split(", ")]
ORIGIN, COMPARISON = 0, 2**31 - 1  # amendment numbers of the rows that open and close a key; those of amendments lie between


@dataclass
class Key:
    """What is kept of one target: its state, scheduled restores, and the waivers of the amendment that is being read."""

    now: dict | None = None
    pending: list[tuple[int, dict]] = field(default_factory=list)
    amendment: int | None = None
    waivers: int = 0
    until: int | None = None

    def close(self) -> str | None:
        """The amendment is over: schedule the restore of its waiver. Two waivers of one target are an error."""
        error = "several waivers" if self.waivers > 1 else None
        if self.waivers == 1 and self.now:
            self.pending.append((self.until, {**self.now, "status": "ACTIVE", "valid_from": self.until, "valid_to": None, "waiver": None}))
        self.amendment, self.waivers, self.until = None, 0, None
        return error

    def restore(self, at: int | None) -> int:
        """Put scheduled terms into force that are due; how many were."""
        due = [s for t, s in self.pending if at is not None and t <= at]
        if due:
            self.now, self.pending = due[-1], [p for p in self.pending if p[0] > at]
        return len(due)

    def read(self, i: dict) -> Iterator[dict]:
        """The events of one instruction, and of what comes before it: errors and restores."""
        if self.amendment is not None and self.amendment != i["amendment_number"]:
            error = self.close()
            if error:
                yield {"kind": "error", "outcome": "ERROR", "action": error}
        if self.amendment is None and self.restore(i["at"]):
            yield {"kind": "restore", "outcome": "APPLIED", "action": "restore"}
        self.amendment = i["amendment_number"]
        self.now, event = step(self.now, i)
        if event["action"] == "waive":
            self.waivers, self.until = self.waivers + 1, i["effective_end"]
        yield {"kind": "event", "instruction_order": i["instruction_order"], "instruction_type": i["instruction_type"], **event}


def origin_state(fields: dict, start: int | None, end: int | None) -> dict:
    """A state from its fields, of which the lists are joined by "|"; active unless a status is among them."""
    lists = {n: [x for x in (fields.pop(n, None) or "").split("|") if x] for n in LISTS}
    return {"status": fields.pop("status", None) or "ACTIVE", "valid_from": start, "valid_to": end, "fields": fields, **lists}


def _columns(state: dict | None) -> tuple:
    if not state:
        return (None,) * 8
    start, end = state.get("waiver") or (None, None)
    return state["status"], state["valid_from"], state["valid_to"], start, end, list(state["fields"].items()), state["exceptions"], state["party"]


#: Columns of events, restores and errors, and of states.
_OF_EVENTS = [c.split()[0] for c in RESULT.split(", ")][:12]
_OF_STATES = ["kind", "chain_id", "target_key", "action", *[c.split()[0] for c in STATE.split(", ")]]
_TYPES = dict(c.split() for c in RESULT.split(", "))


def _schema(names: list[str]) -> pa.Schema:
    text = pa.string()
    kinds = {"string": text, "long": pa.int64(), "int": pa.int32(), "map<string,string>": pa.map_(text, text), "array<string>": pa.list_(text)}
    return pa.schema([(n, kinds[_TYPES[n]]) for n in names])


def _run(batches: Iterator[pa.RecordBatch], states: bool) -> Iterator[pa.RecordBatch]:
    """Rows of states, or of everything else: only what is asked for leaves the task."""
    schema, key, kept = _schema(_OF_STATES if states else _OF_EVENTS), None, Key()
    for batch in batches:
        rows = []
        for values in zip(*map(python_values, batch.columns)):
            i = dict(zip(_NAMES, values))
            own = i["chain_id"], i["target_key"]
            if own != key:
                key, kept = own, Key()
            if i["amendment_number"] == ORIGIN:
                kept.now = origin_state(dict(i["payload"]), i["effective_start"], i["effective_end"])
                continue
            if i["amendment_number"] == COMPARISON:
                error = kept.close()
                if states:
                    restored = kept.restore(i["at"])
                    rows.append(("state", *own, "restore" if restored else None, *_columns(kept.now)))
                elif error:
                    rows.append(("error", *own, None, None, None, None, "ERROR", error, None, None, None))
                continue
            if i["payload"] is not None:
                i["payload"] = dict(i["payload"])
            for e in kept.read(i):
                if states:
                    continue
                event = e["kind"] == "event"
                rows.append((e["kind"], *own, i["amendment_number"], e.get("instruction_order"), e.get("instruction_type"), i["field"] if event else None, e["outcome"], e["action"], e.get("field"), e.get("old"), e.get("new")))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def prepared(instructions: DataFrame) -> DataFrame:
    """Instructions with the columns of ROW, times in microseconds (missing ones are null). A commitment that is added has the key that its payload names, else ``target_key``."""
    types = dict(c.strip().split(" ") for c in ROW.split(", "))
    full = instructions.select(*[(F.col(n) if n in instructions.columns else F.lit(None)).alias(n) for n in _NAMES])
    adds = F.col("instruction_type").isin("ADD", "ADD_COMMITMENT") & F.col("payload").isNotNull()
    times = {n: F.unix_micros(F.col(n).cast("timestamp")) for n in ("at", "effective_start", "effective_end")}
    keyed = full.withColumns({**times, "target_key": F.when(adds, F.coalesce(F.col("payload").cast(types["payload"])["canonical_key"], F.col("target_key"))).otherwise(F.col("target_key"))})
    plain = keyed.withColumn("payload", F.map_filter(F.col("payload").cast(types["payload"]), lambda k, _: k != "canonical_key"))
    return plain.select(*[F.col(n).cast(types[n]) for n in _NAMES])


class Chains:
    """Chains run from their original states.

    ``amendments``: chain_id, amendment_number (1 or more), at (effective time). ``instructions``: chain_id, amendment_number, instruction_order and the
    columns of ROW that they have. ``origins``: chain_id, target_key, payload (fields, with lists joined by "|"). ``chains``: chain_id, comparison_at.
    Instructions whose amendment is unknown have no effective time, so they wait for no restore. States and events are each made by a run of their own.
    """

    def __init__(self, amendments: DataFrame, instructions: DataFrame, origins: DataFrame, chains: DataFrame) -> None:
        self.amendments = amendments.select("chain_id", "amendment_number", "at")
        timed = prepared(instructions.drop("at").join(self.amendments, ["chain_id", "amendment_number"], "left"))
        opening = prepared(origins.withColumns({"amendment_number": F.lit(ORIGIN), "instruction_order": F.lit(0), "instruction_type": F.lit("ORIGIN")}))
        keys = timed.select("chain_id", "target_key").unionAll(opening.select("chain_id", "target_key")).distinct()
        ends = keys.join(chains.select("chain_id", F.col("comparison_at").alias("at")), "chain_id", "left").withColumn("amendment_number", F.lit(COMPARISON))
        rows = timed.withColumn("field", effective_field(F.col("field"), F.col("domain_effect"))).unionAll(opening).unionAll(prepared(ends))
        order = ["chain_id", "target_key", "amendment_number", "instruction_order", *[n for n in _NAMES if n not in ("chain_id", "target_key", "amendment_number", "instruction_order", "payload")]]
        self.rows = rows.repartition("chain_id", "target_key").sortWithinPartitions(*order)

    def _of(self, states: bool) -> DataFrame:
        names = _OF_STATES if states else _OF_EVENTS
        return self.rows.mapInArrow(partial(_run, states=states), ", ".join(f"{n} {_TYPES[n]}" for n in names))

    @cached_property
    def _outcomes(self) -> DataFrame:
        """What ``resolved`` and ``steps`` read of the events, more than once: written once."""
        return materialise(self._of(states=False).where("kind = 'event'").select("chain_id", "target_key", "amendment_number", "instruction_type", "outcome", "wanted"))

    def events(self) -> DataFrame:
        """What each instruction did or why it stays unresolved; restores, before the amendment that finds them due; errors of plans."""
        return self._of(states=False).select("kind", "chain_id", "target_key", "amendment_number", "instruction_order", "instruction_type", "outcome", "action", F.col("field_").alias("field"), "old", "new")

    def states(self) -> DataFrame:
        """Every target's state at its chain's comparison, and whether a restore came after the last amendment."""
        times = {n: F.timestamp_micros(n).cast("timestamp_ntz") for n in ("valid_from", "valid_to", "waived_from", "waived_to")}
        return self._of(states=True).withColumns(times).select("chain_id", "target_key", *[c.strip().split()[0] for c in STATE.split(", ")], F.col("action").isNotNull().alias("restored"))

    def resolved(self) -> DataFrame:
        """What stayed unresolved, and the first later amendment that resolved it: (chain_id, target_key, amendment_number, resolved_by)."""
        e = self._outcomes.select(F.col("chain_id").alias("agreement_id"), "target_key", F.col("amendment_number").alias("step"), "instruction_type", "outcome", "wanted")
        return resolutions(e).select(F.col("agreement_id").alias("chain_id"), "target_key", F.col("step").alias("amendment_number"), "resolved_by")

    def steps(self) -> DataFrame:
        """Each amendment: applied, unresolved, status, outstanding (what it and those before left open and nothing resolved yet), and authoritative."""
        keys = ["chain_id", "amendment_number"]
        done = self._outcomes.groupBy(*keys).agg(F.count_if(F.col("outcome") == "APPLIED").alias("applied"), F.count_if(F.col("outcome") != "APPLIED").alias("unresolved"))
        open_ = self.resolved()
        moves = open_.select(*keys, F.lit(1).alias("n")).unionAll(open_.where("resolved_by is not null").select("chain_id", F.col("resolved_by").alias("amendment_number"), F.lit(-1).alias("n"))).groupBy(*keys).agg(F.sum("n").alias("n"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
        whole = self.amendments.join(done, keys, "left").join(moves, keys, "left").select(*keys, "at", zero("applied"), zero("unresolved"), zero("n"))
        outstanding = F.sum("n").over(W.partitionBy("chain_id").orderBy("amendment_number"))
        status = F.when((F.col("applied") == 0) & (F.col("unresolved") == 0), "COMPLETE").otherwise(execution_status(F.col("applied"), F.col("unresolved")))
        judged = whole.withColumns({"outstanding": outstanding, "status": status})
        return judged.select(*keys, F.col("at").alias("effective_at"), "applied", "unresolved", "status", "outstanding", ((F.col("status") == "COMPLETE") & (F.col("outstanding") == 0)).alias("authoritative"))


P.SQL["chain_amendment"] = """
SELECT o_custkey AS chain_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS amendment_number, o_orderdate AS effective_at, o_orderkey FROM orders"""

P.SQL["chain_instruction"] = """
SELECT chain_id, amendment_number, effective_at, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS INTEGER) AS instruction_order, concat('k', CAST(l_partkey % 3 AS VARCHAR)) AS target_key,
  CASE WHEN m < 2 THEN 'REPLACE_VALUE' WHEN m = 2 THEN 'REPLACE_TEXT' WHEN m < 6 THEN 'WAIVE_TEMPORARILY' WHEN m = 6 THEN 'SUSPEND' WHEN m = 7 THEN 'REINSTATE' WHEN m = 8 THEN 'ADD_COMMITMENT' ELSE 'RESTATE_SECTION' END AS instruction_type,
  CASE WHEN m = 2 THEN 'DEADLINE_CHANGE' END AS domain_effect, CASE WHEN m = 0 THEN 'threshold' WHEN m = 1 THEN 'deadline' END AS field, CASE WHEN m < 2 AND l_quantity > 25 THEN CAST(l_linenumber % 2 AS VARCHAR) END AS old_value,
  CASE WHEN m < 3 THEN CAST(CAST(l_quantity AS INTEGER) % 2 AS VARCHAR) END AS new_value, CASE WHEN m = 8 THEN CAST(l_linenumber % 2 AS VARCHAR) END AS added,
  CASE WHEN m BETWEEN 3 AND 5 THEN effective_at END AS effective_start, CASE WHEN m BETWEEN 3 AND 5 THEN effective_at + to_days(CAST(l_quantity AS INTEGER) * 8 - 16) END AS effective_end
FROM (SELECT *, l_partkey % 10 AS m FROM lineitem JOIN chain_amendment ON o_orderkey = l_orderkey)"""


def chain_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A customer's orders as a chain: two of three targets exist at first; waivers of many lengths end between amendments or stack up."""
    amendments = P.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("chain_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("amendment_number"), F.col("o_orderdate").alias("at"), "o_orderkey"
    )
    s = lambda c: c.cast("string")
    m, n, q = F.col("m"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    lines = P.read(spark, sf_dir, "lineitem").withColumn("m", F.col("l_partkey") % 10).join(amendments, F.col("o_orderkey") == F.col("l_orderkey"))
    kind = (
        F.when(m < 2, "REPLACE_VALUE").when(m == 2, "REPLACE_TEXT").when(m < 6, "WAIVE_TEMPORARILY").when(m == 6, "SUSPEND").when(m == 7, "REINSTATE").when(m == 8, "ADD_COMMITMENT").otherwise("RESTATE_SECTION")
    )
    waives = m.between(3, 5)
    instructions = lines.select(
        "chain_id",
        "amendment_number",
        F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")).alias("instruction_order"),
        F.concat(F.lit("k"), s(F.col("l_partkey") % 3)).alias("target_key"),
        kind.alias("instruction_type"),
        F.when(m == 2, "DEADLINE_CHANGE").alias("domain_effect"),
        F.when(m == 0, "threshold").when(m == 1, "deadline").alias("field"),
        F.when((m < 2) & (F.col("l_quantity") > 25), s(n % 2)).alias("old_value"),
        F.when(m < 3, s(q % 2)).alias("new_value"),
        F.when(m == 8, F.create_map(F.lit("threshold"), s(n % 2))).alias("payload"),
        F.when(waives, F.col("at")).alias("effective_start"),
        F.when(waives, F.col("at") + F.make_dt_interval(q * 8 - 16)).alias("effective_end"),
    )
    chains = amendments.select("chain_id").distinct()
    origins = chains.select("chain_id", F.explode(F.array(F.lit("k0"), F.lit("k1"))).alias("target_key"), F.create_map(F.lit("threshold"), F.lit("0"), F.lit("deadline"), F.lit("1")).alias("payload"))
    return amendments, instructions, origins, chains.withColumn("comparison_at", F.lit("1998-06-01").cast("timestamp_ntz"))


_CHAINS = """
WITH RECURSIVE rows AS (
  SELECT *, row_number() OVER (PARTITION BY chain_id, target_key ORDER BY amendment_number, instruction_order) AS n FROM (
    SELECT * FROM chain_instruction
    UNION ALL SELECT chain_id, 2147483647, TIMESTAMP '1998-06-01', 0, target_key, 'COMPARISON', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (
      SELECT chain_id, target_key FROM chain_instruction UNION SELECT chain_id, unnest(['k0', 'k1']) FROM chain_amendment))),
f AS (
  SELECT DISTINCT chain_id, target_key, CAST(0 AS BIGINT) AS n, CAST(NULL AS INTEGER) AS amendment_number, CAST(NULL AS INTEGER) AS instruction_order, '' AS instruction_type, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS domain_effect, '' AS result,
    CASE WHEN target_key <> 'k2' THEN 'ACTIVE' END AS status, CASE WHEN target_key <> 'k2' THEN '0' END AS threshold, CASE WHEN target_key <> 'k2' THEN '1' END AS deadline,
    CAST(NULL AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, CAST(NULL AS TIMESTAMP) AS waived_from, CAST(NULL AS TIMESTAMP) AS waived_to,
    CAST([] AS STRUCT(t TIMESTAMP, threshold VARCHAR, deadline VARCHAR)[]) AS pending, CAST(0 AS INTEGER) AS waivers, CAST(NULL AS TIMESTAMP) AS until, false AS restored
  FROM rows
  UNION ALL
  SELECT chain_id, target_key, n, amendment_number, instruction_order, instruction_type, field, domain_effect, result,
    CASE result WHEN 'add' THEN 'ACTIVE' WHEN 'waive' THEN 'WAIVED' WHEN 'status' THEN CASE instruction_type WHEN 'SUSPEND' THEN 'SUSPENDED' ELSE 'ACTIVE' END ELSE status END,
    CASE WHEN result = 'add' THEN added WHEN result = 'replace' AND field = 'threshold' THEN new_value ELSE threshold END,
    CASE WHEN result = 'add' THEN NULL WHEN result = 'replace' AND field IS DISTINCT FROM 'threshold' THEN new_value ELSE deadline END,
    CASE result WHEN 'add' THEN effective_start WHEN 'waive' THEN effective_start ELSE valid_from END, CASE result WHEN 'add' THEN NULL WHEN 'waive' THEN effective_end ELSE valid_to END,
    CASE result WHEN 'waive' THEN effective_start ELSE waived_from END, CASE result WHEN 'waive' THEN effective_end ELSE waived_to END,
    pending, waivers + CASE result WHEN 'waive' THEN 1 ELSE 0 END, CASE result WHEN 'waive' THEN effective_end ELSE until END, restored
  FROM (SELECT *, CASE WHEN instruction_type = 'COMPARISON' THEN '' WHEN instruction_type = 'ADD_COMMITMENT' THEN CASE WHEN status IS NOT NULL THEN 'exists already' ELSE 'add' END WHEN instruction_type = 'RESTATE_SECTION' THEN 'needs decomposition' WHEN status IS NULL THEN 'unknown target'
      WHEN instruction_type IN ('REPLACE_VALUE', 'REPLACE_TEXT') THEN CASE WHEN old_value IS NOT NULL AND old_value IS DISTINCT FROM CASE WHEN field = 'threshold' THEN threshold ELSE deadline END THEN 'old value differs' ELSE 'replace' END
      WHEN instruction_type = 'WAIVE_TEMPORARILY' THEN CASE WHEN effective_end <= effective_start THEN 'no waiver interval' ELSE 'waive' END ELSE 'status' END AS result
    FROM (SELECT * EXCLUDE (status, threshold, deadline, valid_from, valid_to, waived_from, waived_to, pending),
        CASE WHEN due THEN 'ACTIVE' ELSE status END AS status, CASE WHEN due THEN last.threshold ELSE threshold END AS threshold, CASE WHEN due THEN last.deadline ELSE deadline END AS deadline,
        CASE WHEN due THEN last.t ELSE valid_from END AS valid_from, CASE WHEN due THEN NULL ELSE valid_to END AS valid_to, CASE WHEN NOT due THEN waived_from END AS waived_from, CASE WHEN NOT due THEN waived_to END AS waived_to,
        CASE WHEN due THEN list_filter(pending, lambda p: p.t > effective_at) ELSE pending END AS pending, due AS restored
      FROM (SELECT *, list_filter(pending, lambda p: p.t <= effective_at)[-1] AS last, new_one AND len(list_filter(pending, lambda p: p.t <= effective_at)) > 0 AS due
        FROM (SELECT r.*, f.status, f.threshold, f.deadline, f.valid_from, f.valid_to, f.waived_from, f.waived_to, f.amendment_number IS DISTINCT FROM r.amendment_number AS new_one,
            CASE WHEN f.amendment_number IS DISTINCT FROM r.amendment_number AND f.waivers = 1 THEN list_append(f.pending, {'t': f.until, 'threshold': f.threshold, 'deadline': f.deadline}) ELSE f.pending END AS pending,
            CASE WHEN f.amendment_number IS DISTINCT FROM r.amendment_number THEN 0 ELSE f.waivers END AS waivers, CASE WHEN f.amendment_number IS NOT DISTINCT FROM r.amendment_number THEN f.until END AS until
          FROM f JOIN rows r ON r.chain_id = f.chain_id AND r.target_key = f.target_key AND r.n = f.n + 1))))),
e AS (SELECT *, CASE WHEN result IN ('add', 'replace', 'waive', 'status') THEN 'APPLIED' ELSE 'UNRESOLVED' END AS outcome, coalesce(field, CASE domain_effect WHEN 'DEADLINE_CHANGE' THEN 'deadline' END) AS wanted FROM f WHERE n > 0 AND instruction_type <> 'COMPARISON')
"""


@query("sta_chain_states", _CHAINS + "SELECT chain_id, target_key, status, threshold, deadline, valid_from, valid_to, waived_from, waived_to, restored FROM f WHERE instruction_type = 'COMPARISON'", "chain_amendment chain_instruction")
def sta_chain_states(spark, sf_dir):
    """The state of every target at its chain's comparison, from an original state through all amendments and ended waivers."""
    states = Chains(*chain_tables(spark, sf_dir)).states()
    return states.withColumns({n: F.col("fields")[n] for n in ("threshold", "deadline")}).drop("fields", *LISTS)


@query("sta_chain_events", _CHAINS + "SELECT chain_id, target_key, amendment_number, instruction_order, outcome, result AS action FROM e UNION ALL SELECT chain_id, target_key, amendment_number, NULL, 'APPLIED', 'restore' FROM f WHERE restored AND instruction_type <> 'COMPARISON'", "chain_amendment chain_instruction")
def sta_chain_events(spark, sf_dir):
    """Every instruction's outcome and every restore before an amendment."""
    return Chains(*chain_tables(spark, sf_dir)).events().where("kind <> 'error'").select("chain_id", "target_key", "amendment_number", "instruction_order", "outcome", "action")


@query(
    "sta_chain_steps",
    _CHAINS
    + """, u AS (SELECT u.chain_id, u.amendment_number, u.target_key, u.instruction_order, min(a.amendment_number) AS resolved_by FROM e u LEFT JOIN e a ON a.outcome = 'APPLIED' AND a.chain_id = u.chain_id AND a.target_key = u.target_key
  AND a.instruction_type = u.instruction_type AND a.wanted IS NOT DISTINCT FROM u.wanted AND a.amendment_number > u.amendment_number WHERE u.outcome = 'UNRESOLVED' GROUP BY 1, 2, 3, 4),
c AS (SELECT a.chain_id, a.amendment_number, a.effective_at, CAST(count(*) FILTER (e.outcome = 'APPLIED') AS BIGINT) AS applied, CAST(count(*) FILTER (e.outcome = 'UNRESOLVED') AS BIGINT) AS unresolved FROM chain_amendment a LEFT JOIN e USING (chain_id, amendment_number) GROUP BY 1, 2, 3),
o AS (SELECT c.*, (SELECT CAST(count(*) AS BIGINT) FROM u WHERE u.chain_id = c.chain_id AND u.amendment_number <= c.amendment_number AND (u.resolved_by IS NULL OR u.resolved_by > c.amendment_number)) AS outstanding,
  CASE WHEN unresolved = 0 THEN 'COMPLETE' WHEN applied = 0 THEN 'UNRESOLVED' ELSE 'PARTIAL' END AS status FROM c)
SELECT *, status = 'COMPLETE' AND outstanding = 0 AS authoritative FROM o""",
    "chain_amendment chain_instruction",
)
def sta_chain_steps(spark, sf_dir):
    """Every amendment's status, what stays open after it, and whether it is authoritative."""
    return Chains(*chain_tables(spark, sf_dir)).steps()
