"""Execution of instructions of every type over whole commitment states, with an event for each.

A commitment has a status, an interval, fields, and two lists (exceptions and parties). An instruction that can't be applied leaves the
state as it was, and says why. Instructions of a key depend on one another through the values that they guard, so a key is
read in order, as a stream with one small state; no key is gathered. The streaming operator applies the same step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..functions.columns import python_values
from ..registry import query
from .state import _OUTCOME, execution_status

# Fields of a commitment, the field that an effect stands for, statuses that types set.
FIELDS = ("modality", "action", "subject", "operator", "threshold", "unit", "frequency", "deadline", "rate", "scope", "trigger", "grace_period", "cure", "application_order")
LISTS = ("exceptions", "party")
FIELD_OF_EFFECT = {"DEADLINE_CHANGE": "deadline", "FREQUENCY_CHANGE": "frequency", "PARTY_CHANGE": "party", "SCOPE_CHANGE": "scope", "COVENANT_THRESHOLD_CHANGE": "threshold", "RATE_CHANGE": "rate"}
#: Types that can resolve what stayed open before; a change of rate has no field there.
CONSTRUCTIVE = ("REPLACE_VALUE", "REPLACE_TEXT", "ADD", "ADD_COMMITMENT", "DELETE", "DELETE_COMMITMENT", "WAIVE_TEMPORARILY", "SUSPEND", "REINSTATE", "RESTATE_SECTION")
RESOLVED_FIELD_OF_EFFECT = {e: f for e, f in FIELD_OF_EFFECT.items() if e != "RATE_CHANGE"}
STATUS_SET_BY = {"DELETE_COMMITMENT": "DELETED", "SUSPEND": "SUSPENDED", "REINSTATE": "ACTIVE", "DELETE": "DELETED"}
LIST_OF_EFFECT = {"ADD": {"EXCEPTION_EXPANSION": "exceptions", "PARTY_CHANGE": "party"}, "DELETE": {"EXCEPTION_REMOVAL": "exceptions", "PARTY_CHANGE": "party"}}

INSTRUCTION = (
    "agreement_id long, target_key string, step int, instruction_type string, domain_effect string, field string, old_value string, new_value string, "
    "payload map<string,string>, old_ref string, new_ref string, effective_start timestamp_ntz, effective_end timestamp_ntz"
)
EVENT = (
    "agreement_id long, target_key string, step int, instruction_type string, outcome string, action string, field string, old string, new string, "
    "status string, valid_from timestamp_ntz, valid_to timestamp_ntz, fields map<string,string>, exceptions array<string>, party array<string>"
)
OUTCOME = "agreement_id long, target_key string, step int, instruction_type string, wanted string, outcome string, action string"


class Refused(Exception):
    """An instruction that stays unresolved; the text is a short code."""


def apply_instruction(state: dict | None, i: dict) -> tuple[dict | None, tuple]:
    """(state after, (action, field, old, new)); ``state`` isn't changed. Raises Refused."""
    kind, effect = i["instruction_type"], i["domain_effect"]
    if kind == "RENUMBER_REFERENCE":
        if not i["old_ref"] or not i["new_ref"]:
            raise Refused("references missing")
        return state, ("reference_change", None, i["old_ref"], i["new_ref"])
    if kind in ("ADD_COMMITMENT", "ADD") and i["payload"] is not None:
        if state:
            raise Refused("exists already")
        fields = dict(i["payload"])
        lists = {name: [x for x in (fields.pop(name, None) or "").split("|") if x] for name in LISTS}
        return {"status": fields.pop("status", None) or "ACTIVE", "valid_from": i["effective_start"], "valid_to": None, "fields": fields, **lists}, ("add", None, None, None)
    if kind in ("ADD_COMMITMENT", "RESTATE_SECTION", "UNRESOLVED"):
        raise Refused({"ADD_COMMITMENT": "payload missing", "RESTATE_SECTION": "needs decomposition", "UNRESOLVED": "not parsed"}[kind])
    if not state:
        raise Refused("unknown target")
    if kind in ("REPLACE_VALUE", "REPLACE_TEXT"):
        return _replace(state, i)
    if kind == "WAIVE_TEMPORARILY":
        start, end = i["effective_start"], i["effective_end"]
        if not start or not end or end <= start:
            raise Refused("no waiver interval")
        return {**state, "status": "WAIVED", "valid_from": start, "valid_to": end, "waiver": (start, end)}, ("waive", "status", state["status"], "WAIVED")
    name = LIST_OF_EFFECT.get(kind, {}).get(effect)
    if name:
        return _edit_list(state, i, name)
    if kind in STATUS_SET_BY:
        return {**state, "status": STATUS_SET_BY[kind]}, ("status", "status", state["status"], STATUS_SET_BY[kind])
    raise Refused("no list named" if kind == "ADD" else "unsupported type")


def _replace(state: dict, i: dict) -> tuple[dict, tuple]:
    name = i["field"] or FIELD_OF_EFFECT.get(i["domain_effect"])
    if name not in FIELDS and name not in LISTS:
        raise Refused("no such field")
    held = state[name] if name in LISTS else state["fields"].get(name)
    held = "|".join(held) if name in LISTS else held
    if i["old_value"] is not None and i["old_value"] != held:
        raise Refused("old value differs")
    if name in LISTS:
        after = {**state, name: (i["new_value"] or "").split("|")}
    else:
        after = {**state, "fields": {**state["fields"], name: i["new_value"]}}
    return after, ("replace", name, held, i["new_value"])


def _edit_list(state: dict, i: dict, name: str) -> tuple[dict, tuple]:
    held, adds = state[name], i["instruction_type"] == "ADD"
    item = i["new_value"] if adds else i["old_value"]
    if adds:
        items = held if item in held else [*held, item]
    elif name == "exceptions" and item not in held:
        raise Refused("no such exception")
    else:
        items = [x for x in held if x != item]
    return {**state, name: items}, (("add_" if adds else "remove_") + name, name, "|".join(held), "|".join(items))


def step(state: dict | None, i: dict) -> tuple[dict | None, dict]:
    """The state after one instruction and its event."""
    try:
        state, (action, field, old, new) = apply_instruction(state, i)
        outcome = "APPLIED"
    except Refused as why:
        outcome, action, field, old, new = "UNRESOLVED", str(why), None, None, None
    return state, {"outcome": outcome, "action": action, "field": field, "old": old, "new": new}


_NAMES = [c.split()[0] for c in INSTRUCTION.split(", ")]
_STATE_COLUMNS = ("status", "valid_from", "valid_to", "fields", "exceptions", "party")
FINAL = "agreement_id long, target_key string, applied long, unresolved long, status string, valid_from timestamp_ntz, valid_to timestamp_ntz, fields map<string,string>, exceptions array<string>, party array<string>"


def _schema(columns: str) -> pa.Schema:
    text, kinds = pa.string(), {"long": pa.int64(), "int": pa.int32(), "timestamp_ntz": pa.timestamp("us")}
    kinds |= {"map<string,string>": pa.map_(text, text), "array<string>": pa.list_(text), "string": text}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])


def _instructions(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows from columns; times as microseconds, which cost less than objects."""
    columns = [c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c for c in batch.columns[: len(_NAMES)]]
    for values in zip(*map(python_values, columns)):
        i = dict(zip(_NAMES, values))
        if i["payload"] is not None:
            i["payload"] = dict(i["payload"])
        yield i


def _state_values(state: dict | None) -> list:
    return [list(state[n].items()) if n == "fields" else state[n] for n in _STATE_COLUMNS] if state else [None] * len(_STATE_COLUMNS)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    """Rows by columns, times given as microseconds."""
    made = (pa.array(c, pa.int64()).cast(f.type) if pa.types.is_timestamp(f.type) else pa.array(c, f.type) for c, f in zip(zip(*rows), schema))
    return pa.RecordBatch.from_arrays(list(made), schema=schema)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, key, state = _schema(EVENT), None, None
    for batch in batches:
        rows = []
        for i in _instructions(batch):
            if (own := (i["agreement_id"], i["target_key"])) != key:
                key, state = own, None
            state, event = step(state, i)
            rows.append((*own, i["step"], i["instruction_type"], *event.values(), *_state_values(state)))
        if rows:
            yield _batch(rows, schema)


def _run_to_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, key, state, counts = _schema(FINAL), None, None, [0, 0]
    for batch in batches:
        rows = []
        for i in _instructions(batch):
            if (own := (i["agreement_id"], i["target_key"])) != key:
                if key is not None:
                    rows.append((*key, *counts, *_state_values(state)))
                key, state, counts = own, None, [0, 0]
            state, event = step(state, i)
            counts[event["outcome"] != "APPLIED"] += 1
        if rows:
            yield _batch(rows, schema)
    if key is not None:
        yield _batch([(*key, *counts, *_state_values(state))], schema)


def _run_to_outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, key, state = _schema(OUTCOME), None, None
    for batch in batches:
        outcomes, actions = [], []
        for i in _instructions(batch):
            if (own := (i["agreement_id"], i["target_key"])) != key:
                key, state = own, None
            state, event = step(state, i)
            outcomes.append(event["outcome"])
            actions.append(event["action"])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(len(_NAMES)), pa.array(outcomes, pa.string()), pa.array(actions, pa.string())], schema=schema)


def _in_order(instructions: DataFrame, *more: Column) -> DataFrame:
    types = dict(c.split() for c in INSTRUCTION.split(", "))
    full = instructions.select(*[(F.col(n) if n in instructions.columns else F.lit(None)).cast(types[n]).alias(n) for n in _NAMES], *more)
    order = ["agreement_id", "target_key", "step", *[n for n in _NAMES[3:] if n != "payload"]]
    return full.repartition("agreement_id", "target_key").sortWithinPartitions(*order)


def execute_to_states(instructions: DataFrame) -> DataFrame:
    """``final_states(execute(instructions))`` without the events: only each key's last state leaves the tasks."""
    done = _in_order(instructions).mapInArrow(_run_to_ends, FINAL)
    return done.select("agreement_id", "target_key", *_STATE_COLUMNS, "applied", "unresolved", execution_status(F.col("applied"), F.col("unresolved")).alias("outcome"))


def execute_to_outcomes(instructions: DataFrame) -> DataFrame:
    """``execute`` without states and values: what became of each instruction, and the effective field that it is about (``wanted``)."""
    field, effect = (F.col(n) if n in instructions.columns else F.lit(None).cast("string") for n in ("field", "domain_effect"))
    return _in_order(instructions, effective_field(field, effect).alias("wanted")).mapInArrow(_run_to_outcomes, OUTCOME)


def execute(instructions: DataFrame) -> DataFrame:
    """An event for each instruction, in the order of ``step`` for each (agreement_id, target_key), with the state after it.

    Missing columns of INSTRUCTION count as null. Equal steps are taken in the order of the other columns. Null keys are a key of their own.
    """
    return _in_order(instructions).mapInArrow(_run, EVENT)


def final_states(events: DataFrame) -> DataFrame:
    """Each key's state after its last event, with counts and the execution status."""
    last = F.max_by(F.struct("status", "valid_from", "valid_to", "fields", "exceptions", "party"), "step").alias("s")
    done = events.groupBy("agreement_id", "target_key").agg(last, F.count_if(F.col("outcome") == "APPLIED").alias("applied"), F.count_if(F.col("outcome") != "APPLIED").alias("unresolved"))
    return done.select("agreement_id", "target_key", "s.*", "applied", "unresolved", execution_status(F.col("applied"), F.col("unresolved")).alias("outcome"))


def effective_field(field: Column, effect: Column) -> Column:
    """The field that an instruction is about: the one it names, else the one that its effect stands for; else null."""
    named = F.coalesce(*[F.when(effect == e, f) for e, f in RESOLVED_FIELD_OF_EFFECT.items()])
    return F.coalesce(F.when(field != "", field), named)


def resolutions(events: DataFrame) -> DataFrame:
    """(agreement_id, target_key, step, resolved_by) of what stayed unresolved: the first later step that applied the same constructive type to the same effective field (column ``wanted``, may be null) of the target. Without a target nothing is resolved."""
    later = W.partitionBy("agreement_id", "target_key", "instruction_type", "wanted").orderBy("step").rangeBetween(1, W.unboundedFollowing)
    resolving = (F.col("outcome") == "APPLIED") & F.col("instruction_type").isin(*CONSTRUCTIVE) & (F.col("target_key") != "")
    found = F.min(F.when(resolving, F.col("step"))).over(later)
    return events.withColumn("resolved_by", found).where("outcome = 'UNRESOLVED'").select("agreement_id", "target_key", "step", "resolved_by")


P.SQL["full_instruction"] = """
SELECT l_suppkey AS agreement_id, concat('k', CAST(l_partkey % 4 AS VARCHAR)) AS target_key,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS INTEGER) AS step,
  CASE WHEN m < 2 THEN 'ADD_COMMITMENT' WHEN m < 5 THEN 'REPLACE_VALUE' WHEN m = 5 THEN 'REPLACE_TEXT' WHEN m = 6 THEN 'WAIVE_TEMPORARILY' WHEN m = 7 THEN 'SUSPEND'
       WHEN m = 8 THEN 'REINSTATE' WHEN m = 9 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'DELETE' ELSE 'DELETE_COMMITMENT' END WHEN m < 12 THEN 'ADD' WHEN m < 14 THEN 'DELETE'
       WHEN m = 14 THEN 'RENUMBER_REFERENCE' WHEN l_linenumber % 3 = 0 THEN 'RESTATE_SECTION' WHEN l_linenumber % 3 = 1 THEN 'UNRESOLVED' ELSE 'FIND_REPLACE_REFERENCE' END AS instruction_type,
  CASE WHEN m = 5 THEN 'DEADLINE_CHANGE' WHEN m IN (11, 13) THEN 'PARTY_CHANGE' WHEN m = 10 THEN 'EXCEPTION_EXPANSION' WHEN m = 12 THEN 'EXCEPTION_REMOVAL' END AS domain_effect,
  CASE WHEN m IN (2, 3) THEN 'threshold' WHEN m = 4 AND l_linenumber < 4 THEN 'colour' WHEN m = 4 THEN 'threshold' END AS field,
  CASE WHEN m IN (2, 3, 4) AND l_quantity < 20 THEN NULL WHEN m IN (2, 3, 4) THEN CAST(l_linenumber % 2 AS VARCHAR) WHEN m IN (12, 13) THEN concat('x', CAST(l_linenumber % 3 AS VARCHAR)) END AS old_value,
  CASE WHEN m < 6 THEN CAST(CAST(l_quantity AS INTEGER) % 2 AS VARCHAR) WHEN m IN (10, 11) THEN concat('x', CAST(CAST(l_quantity AS INTEGER) % 3 AS VARCHAR)) END AS new_value,
  m = 0 OR m = 1 AND l_linenumber > 2 AS has_payload, l_tax < 0.05 AS has_refs,
  CASE WHEN m = 6 AND l_linenumber = 7 THEN NULL ELSE l_shipdate END AS effective_start, CASE WHEN m = 6 THEN l_shipdate + to_days(CAST(l_quantity AS INTEGER) - 10) END AS effective_end
FROM (SELECT *, (l_orderkey + l_linenumber) % 16 AS m FROM lineitem)"""


def full_instruction(spark, sf_dir) -> DataFrame:
    """Instructions of every type, of few distinct values, so that guards hold and fail."""
    m, n, q = F.col("m"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    s = lambda c: c.cast("string")
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    kind = (
        F.when(m < 2, "ADD_COMMITMENT").when(m < 5, "REPLACE_VALUE").when(m == 5, "REPLACE_TEXT").when(m == 6, "WAIVE_TEMPORARILY").when(m == 7, "SUSPEND").when(m == 8, "REINSTATE")
        .when((m == 9) & (n % 2 == 1), "DELETE_COMMITMENT").when(m == 9, "DELETE").when(m < 12, "ADD").when(m < 14, "DELETE").when(m == 14, "RENUMBER_REFERENCE")
        .when(n % 3 == 0, "RESTATE_SECTION").when(n % 3 == 1, "UNRESOLVED").otherwise("FIND_REPLACE_REFERENCE")
    )
    guarded, payload = m.isin(2, 3, 4), (m == 0) | ((m == 1) & (n > 2))
    new = F.when(m < 6, s(q % 2)).when(m.isin(10, 11), F.concat(F.lit("x"), s(q % 3)))
    ref = lambda prefix: F.when(F.col("l_tax") < 0.05, F.concat(F.lit(prefix), s(n)))
    return P.read(spark, sf_dir, "lineitem").withColumn("m", (F.col("l_orderkey") + F.col("l_linenumber")) % 16).select(
        F.col("l_suppkey").alias("agreement_id"),
        F.concat(F.lit("k"), s(F.col("l_partkey") % 4)).alias("target_key"),
        F.row_number().over(W.partitionBy("l_suppkey").orderBy(*order)).alias("step"),
        kind.alias("instruction_type"),
        F.when(m == 5, "DEADLINE_CHANGE").when(m.isin(11, 13), "PARTY_CHANGE").when(m == 10, "EXCEPTION_EXPANSION").when(m == 12, "EXCEPTION_REMOVAL").alias("domain_effect"),
        F.when(m.isin(2, 3) | ((m == 4) & (n > 3)), "threshold").when(m == 4, "colour").alias("field"),
        F.when(guarded & (q >= 20), s(n % 2)).when(m.isin(12, 13), F.concat(F.lit("x"), s(n % 3))).alias("old_value"),
        new.alias("new_value"),
        F.when(payload, F.create_map(F.lit("threshold"), s(q % 2))).alias("payload"),
        ref("Section 7.").alias("old_ref"),
        ref("Section 8.").alias("new_ref"),
        F.when((m != 6) | (n != 7), F.col("l_shipdate")).alias("effective_start"),
        F.when(m == 6, F.col("l_shipdate") + F.make_dt_interval(q - 10)).alias("effective_end"),
    )


_EXECUTION = """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY agreement_id, target_key ORDER BY step) AS n FROM full_instruction),
f AS (
  SELECT agreement_id, target_key, CAST(0 AS BIGINT) AS n, 0 AS step, '' AS instruction_type, '' AS result, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS threshold, CAST(NULL AS VARCHAR) AS deadline,
    CAST([] AS VARCHAR[]) AS exceptions, CAST([] AS VARCHAR[]) AS party, CAST(NULL AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to
  FROM (SELECT DISTINCT agreement_id, target_key FROM o)
  UNION ALL
  SELECT agreement_id, target_key, n, step, instruction_type, result,
    CASE WHEN result = 'add' THEN 'ACTIVE' WHEN result = 'waive' THEN 'WAIVED' WHEN result = 'status' THEN CASE instruction_type WHEN 'SUSPEND' THEN 'SUSPENDED' WHEN 'REINSTATE' THEN 'ACTIVE' ELSE 'DELETED' END ELSE status END,
    CASE WHEN result = 'add' OR result = 'replace' AND field IS NOT NULL THEN new_value ELSE threshold END,
    CASE WHEN result = 'replace' AND field IS NULL THEN new_value ELSE deadline END,
    CASE WHEN result = 'add_exceptions' AND NOT list_contains(exceptions, new_value) THEN list_append(exceptions, new_value) WHEN result = 'remove_exceptions' THEN list_filter(exceptions, lambda x: x <> old_value) ELSE exceptions END,
    CASE WHEN result = 'add_party' AND NOT list_contains(party, new_value) THEN list_append(party, new_value) WHEN result = 'remove_party' THEN list_filter(party, lambda x: x <> old_value) ELSE party END,
    CASE WHEN result IN ('add', 'waive') THEN effective_start ELSE valid_from END, CASE WHEN result = 'waive' THEN effective_end ELSE valid_to END
  FROM (SELECT o.*, f.status, f.threshold, f.deadline, f.exceptions, f.party, f.valid_from, f.valid_to,
    CASE WHEN o.instruction_type = 'RENUMBER_REFERENCE' THEN CASE WHEN has_refs THEN 'reference_change' ELSE 'references missing' END
      WHEN o.instruction_type = 'ADD_COMMITMENT' THEN CASE WHEN NOT has_payload THEN 'payload missing' WHEN f.status IS NOT NULL THEN 'exists already' ELSE 'add' END
      WHEN o.instruction_type = 'RESTATE_SECTION' THEN 'needs decomposition' WHEN o.instruction_type = 'UNRESOLVED' THEN 'not parsed'
      WHEN f.status IS NULL THEN 'unknown target'
      WHEN o.instruction_type IN ('REPLACE_VALUE', 'REPLACE_TEXT') THEN CASE WHEN field = 'colour' THEN 'no such field'
        WHEN old_value IS NOT NULL AND old_value IS DISTINCT FROM CASE WHEN field IS NULL THEN f.deadline ELSE f.threshold END THEN 'old value differs' ELSE 'replace' END
      WHEN o.instruction_type = 'WAIVE_TEMPORARILY' THEN CASE WHEN effective_start IS NULL OR effective_end IS NULL OR effective_end <= effective_start THEN 'no waiver interval' ELSE 'waive' END
      WHEN o.instruction_type = 'ADD' THEN CASE domain_effect WHEN 'PARTY_CHANGE' THEN 'add_party' ELSE 'add_exceptions' END
      WHEN o.instruction_type = 'DELETE' AND domain_effect = 'PARTY_CHANGE' THEN 'remove_party'
      WHEN o.instruction_type = 'DELETE' AND domain_effect = 'EXCEPTION_REMOVAL' THEN CASE WHEN list_contains(f.exceptions, old_value) THEN 'remove_exceptions' ELSE 'no such exception' END
      WHEN o.instruction_type IN ('DELETE', 'DELETE_COMMITMENT', 'SUSPEND', 'REINSTATE') THEN 'status' ELSE 'unsupported type' END AS result
    FROM f JOIN o ON o.agreement_id = f.agreement_id AND o.target_key = f.target_key AND o.n = f.n + 1)),
e AS (SELECT *, CASE WHEN result IN ('reference_change', 'add', 'replace', 'waive', 'status', 'add_party', 'add_exceptions', 'remove_party', 'remove_exceptions') THEN 'APPLIED' ELSE 'UNRESOLVED' END AS outcome FROM f WHERE n > 0)
"""


@query("sta_execution_events", _EXECUTION + "SELECT agreement_id, target_key, step, instruction_type, outcome, result AS action FROM e", "full_instruction")
def sta_execution_events(spark, sf_dir):
    """The event log: what each instruction did, or why it stays unresolved."""
    return execute_to_outcomes(full_instruction(spark, sf_dir)).drop("wanted")


@query(
    "sta_execution_states",
    _EXECUTION
    + f""", c AS (SELECT agreement_id, target_key, CAST(count(*) FILTER (outcome = 'APPLIED') AS BIGINT) AS applied, CAST(count(*) FILTER (outcome <> 'APPLIED') AS BIGINT) AS unresolved, max(n) AS n FROM e GROUP BY 1, 2)
SELECT agreement_id, target_key, status, threshold, deadline, CASE WHEN status IS NOT NULL THEN array_to_string(exceptions, '|') END AS exceptions, CASE WHEN status IS NOT NULL THEN array_to_string(party, '|') END AS party,
  valid_from, valid_to, applied, unresolved, {_OUTCOME} AS outcome FROM c JOIN e USING (agreement_id, target_key, n)""".replace("outcome FROM c JOIN e", "outcome FROM c JOIN (SELECT * EXCLUDE (outcome) FROM e) e"),
    "full_instruction",
)
def sta_execution_states(spark, sf_dir):
    """Every commitment after all its instructions, and how complete its execution is."""
    states = execute_to_states(full_instruction(spark, sf_dir))
    lists = {n: F.array_join(n, "|") for n in LISTS}
    return states.withColumns({**lists, **{n: F.col("fields")[n] for n in ("threshold", "deadline")}}).drop("fields")


_EFFECTIVE = "coalesce(i.field, CASE i.domain_effect " + " ".join(f"WHEN '{e}' THEN '{f}'" for e, f in RESOLVED_FIELD_OF_EFFECT.items()) + " END)"


@query(
    "sta_resolved_by_match",
    _EXECUTION
    + f""", w AS (SELECT e.*, {_EFFECTIVE} AS wanted FROM e JOIN full_instruction i ON i.agreement_id = e.agreement_id AND i.step = e.step)
SELECT u.agreement_id, u.target_key, u.step, min(a.step) AS resolved_by FROM w u
LEFT JOIN w a ON a.outcome = 'APPLIED' AND a.instruction_type IN {CONSTRUCTIVE} AND a.agreement_id = u.agreement_id AND a.target_key = u.target_key AND a.instruction_type = u.instruction_type AND a.wanted IS NOT DISTINCT FROM u.wanted AND a.step > u.step
WHERE u.outcome = 'UNRESOLVED' GROUP BY 1, 2, 3""",
    "full_instruction",
)
def sta_resolved_by_match(spark, sf_dir):
    """An unresolved instruction is resolved by the first later applied one of its type on the same field of the same target."""
    return resolutions(execute_to_outcomes(full_instruction(spark, sf_dir)))
