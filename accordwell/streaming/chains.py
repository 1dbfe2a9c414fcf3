"""Chains of amendments as a stream, from given original states, with timers for the ends of waivers.

Applies the steps of ``operators.chain_execution``. A restore that is due comes before the next amendment of its key; where none comes,
an event-time timer puts it into force when the watermark has passed the end of the waiver. Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chain_execution import Key, origin_state

EVENTS = "chain_id long, target_key string, amendment_number int, instruction_order int, kind string, outcome string, action string, status string"


class ChainProcessor(StatefulProcessor):
    """One target's state, kept as JSON of whole numbers and texts, which it gives back unchanged."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "key string, last int")

    def _load(self) -> tuple[Key, int]:
        if not self.kept.exists():
            return Key(), 0
        text, last = self.kept.get()
        return Key(**json.loads(text)), last

    def _save(self, key: Key, last: int) -> None:
        self.kept.update((json.dumps(asdict(key)), last))

    @staticmethod
    def _row(own: tuple, key: Key, e: dict, amendment: int | None) -> Row:
        return Row(chain_id=own[0], target_key=own[1], amendment_number=amendment, instruction_order=e.get("instruction_order"), kind=e["kind"], outcome=e["outcome"], action=e["action"], status=key.now and key.now["status"])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._save(Key(now=origin_state(dict(initialState.payload), initialState.effective_start, initialState.effective_end)), 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept, last = self._load()
        given = sorted((r.asDict() for r in rows), key=lambda r: (r["amendment_number"], r["instruction_order"]))
        for i in given:
            if i["amendment_number"] < last:
                yield self._row(key, kept, {"kind": "event", "instruction_order": i["instruction_order"], "outcome": "UNRESOLVED", "action": "stale"}, i["amendment_number"])
                continue
            last = i["amendment_number"]
            i["payload"] = None if i["payload"] is None else dict(i["payload"])
            for e in kept.read(i):
                yield self._row(key, kept, e, last)
            if kept.until is not None:
                self.handle.registerTimer(-(-kept.until // 1000))
        self._save(kept, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept, last = self._load()
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if kept.until is not None and kept.until <= at:
            kept.close()
        if kept.restore(at):
            yield self._row(key, kept, {"kind": "restore", "outcome": "APPLIED", "action": "restore"}, None)
        self._save(kept, last)

    def close(self) -> None:
        pass


def chain_stream(instructions: DataFrame, origins: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Events of streamed ``instructions``: the columns of ``chain_execution.ROW`` as ``prepared`` makes them, and ``took_effect``, their amendment's time as a timestamp.

    ``origins`` is a batch of original states in the same columns. An instruction of an amendment before the last one read is stale and stays unresolved.
    """
    timed = instructions.withWatermark("took_effect", late)
    start = origins.groupBy("chain_id", "target_key")
    return timed.groupBy("chain_id", "target_key").transformWithState(ChainProcessor(), EVENTS, "append", "eventTime", start)


def with_event_time(prepared: DataFrame) -> DataFrame:
    return prepared.withColumn("took_effect", F.timestamp_micros("at"))
