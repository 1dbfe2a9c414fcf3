"""Amendments as a stream: the guarded fold with state per (agreement, key), and windowed counts with a watermark.

The stateful operator keeps one small state per key and applies instructions in the order of their times within a batch; an
instruction older than the last applied one is stale and counts as unresolved. A batch run over ordered input equals the stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.execution import step
from ..projections import INSTRUCTION_OF_EVENT

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
STATE = "status string, value double, applied int, unresolved int, last_step long"
OUT = "agreement_id long, target_key string, status string, value double, applied int, unresolved int"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def as_instructions(events: DataFrame) -> DataFrame:
    kind = F.lit("UNRESOLVED")
    for event, instruction in INSTRUCTION_OF_EVENT.items():
        kind = F.when(F.col("event_type") == event, instruction).otherwise(kind)
    return events.select(
        F.col("user_id").alias("agreement_id"), F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")).alias("target_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("step"), "event_id", kind.alias("instruction_type"), F.col("value").alias("new_value")
    )


STATUS_SET_BY = {"WAIVE_TEMPORARILY": "WAIVED", "REINSTATE": "ACTIVE", "SUSPEND": "SUSPENDED", "DELETE_COMMITMENT": "DELETED"}


def apply_one(state: tuple, kind: str, value: float) -> tuple:
    """The guarded step of the batch fold on (status, value, applied, unresolved)."""
    status, old, applied, unresolved = state
    if kind == "RENUMBER_REFERENCE":
        return state
    if kind == "ADD_COMMITMENT" and status is None:
        return "ACTIVE", value, applied + 1, unresolved
    if kind == "REPLACE_VALUE" and status is not None:
        return status, value, applied + 1, unresolved
    if kind in STATUS_SET_BY and status is not None:
        return STATUS_SET_BY[kind], old, applied + 1, unresolved
    return status, old, applied, unresolved + 1


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, value, applied, unresolved, last = state.get if state.exists else (None, None, 0, 0, -(2**62))
    rows = pd.concat(list(batches)).sort_values(["step", "event_id"])
    for step, kind, new in zip(rows["step"], rows["instruction_type"], rows["new_value"]):
        if step < last:
            unresolved += 1
            continue
        last = step
        status, value, applied, unresolved = apply_one((status, value, applied, unresolved), kind, new)
    state.update((status, value, applied, unresolved, int(last)))
    yield pd.DataFrame({"agreement_id": [key[0]], "target_key": [key[1]], "status": [status], "value": [value], "applied": [applied], "unresolved": [unresolved]})


def fold_stream(instructions: DataFrame) -> DataFrame:
    """The state of each key after each batch that touches it (update mode)."""
    return instructions.groupBy("agreement_id", "target_key").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


EXECUTED = "agreement_id long, target_key string, step long, outcome string, action string, status string"


def _execute(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept, last = state.get if state.exists else ("null", -(2**62))
    now, out = json.loads(kept), []
    rows = pd.concat(list(batches)).astype(object)
    for i in rows.where(rows.notna(), None).sort_values("step").to_dict("records"):
        if i["step"] < last:
            event = {"outcome": "UNRESOLVED", "action": "stale"}
        else:
            last = i["step"]
            now, event = step(now, i | {"payload": dict(i["payload"]) if i["payload"] is not None else None})
        out.append((*key, int(i["step"]), event["outcome"], event["action"], now and now["status"]))
    state.update((json.dumps(now, default=str), int(last)))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in EXECUTED.split(", ")])


def execute_stream(instructions: DataFrame) -> DataFrame:
    """An event for each instruction, by the step of the batch operator, with the columns of ``operators.execution.INSTRUCTION`` (step as long).

    Instructions of a batch are taken in the order of ``step``; one that comes after a later step was applied is stale and stays unresolved.
    """
    return instructions.groupBy("agreement_id", "target_key").applyInPandasWithState(_execute, EXECUTED, "commitment string, last_step long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Instructions per type and time window; rows later than the watermark are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
