"""Chains of amendments by hand, in one batch and as a stream: original states, restores, what stays open, several waivers."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from accordwell.operators import chain_execution as C
from accordwell.streaming import chains as S

COLUMNS = "chain_id long, amendment_number int, instruction_order int, target_key string, instruction_type string, domain_effect string, field string, old_value string, new_value string, payload map<string,string>, effective_start timestamp_ntz, effective_end timestamp_ntz"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def day(month, d=1, year=2026):
    return datetime(year, month, d)


def instruction(chain, amendment, order, kind, key=None, **more):
    row = dict.fromkeys(NAMES) | {"chain_id": chain, "amendment_number": amendment, "instruction_order": order, "instruction_type": kind, "target_key": key} | more
    return tuple(row[n] for n in NAMES)


def replace(chain, amendment, order, key, old, new, field="threshold"):
    return instruction(chain, amendment, order, "REPLACE_VALUE", key, field=field, old_value=old, new_value=new)


def waive(chain, amendment, order, key, start, end):
    return instruction(chain, amendment, order, "WAIVE_TEMPORARILY", key, effective_start=start, effective_end=end)


#: 1 clean, 2 what stays open is not resolved elsewhere, 3 a waiver that is over, 4 a restore past an amendment of another target, 5 resolved by the same field, 6 two waivers at once, 7 no amendments
AMENDMENTS = [
    (1, 1, day(1, 15)), (1, 2, day(3)), (1, 3, day(6)), (2, 1, day(2)), (2, 2, day(5)), (3, 1, day(1)), (3, 2, day(7)),
    (4, 1, day(1)), (4, 2, day(3)), (4, 3, day(8)), (5, 1, day(1)), (5, 2, day(2)), (5, 3, day(3)), (6, 1, day(1)), (6, 2, day(9)), (8, 1, day(1)),
]
INSTRUCTIONS = [
    replace(1, 1, 1, "lev", "4.0", "4.5"),
    instruction(1, 2, 1, "ADD", payload={"canonical_key": "dscr", "threshold": "1.25", "party": "borrower"}),
    replace(1, 2, 2, "rev", "50", "75"),
    replace(1, 3, 1, "lev", "4.5", "4.0"),
    instruction(1, 3, 2, "ADD", "lev", domain_effect="EXCEPTION_EXPANSION", new_value="acquisition"),
    replace(2, 1, 1, "lev", "4.0", "4.1"),
    instruction(2, 1, 2, "RESTATE_SECTION", "icr"),
    replace(2, 2, 1, "lev", "4.1", "4.2"),
    waive(3, 1, 1, "lev", day(1), day(6, 30)),
    replace(3, 2, 1, "lev", "4.0", "4.5"),
    waive(4, 1, 1, "lev", day(1), day(7)),
    replace(4, 2, 1, "icr", "3.0", "2.5"),
    replace(4, 3, 1, "icr", "2.5", "2.0"),
    replace(5, 1, 1, "icr", "9.9", "2.5"),
    replace(5, 2, 1, "lev", "4.0", "4.5"),
    instruction(5, 3, 1, "REPLACE_VALUE", "icr", domain_effect="COVENANT_THRESHOLD_CHANGE", old_value="3.0", new_value="2.5"),
    waive(6, 1, 1, "lev", day(1), day(3)),
    waive(6, 1, 2, "lev", day(1), day(4)),
    replace(6, 2, 1, "lev", "4.0", "5.0"),
    waive(8, 1, 1, "lev", day(1), day(12, 1)),
    instruction(8, 1, 2, "SUSPEND", "icr"),
]
CHAINS = [(c, day(10)) for c in range(1, 9)]


def tables(spark):
    amendments = spark.createDataFrame(AMENDMENTS, "chain_id long, amendment_number int, at timestamp_ntz")
    instructions = spark.createDataFrame(INSTRUCTIONS, COLUMNS)
    origins = spark.createDataFrame([(c, k, {"threshold": v, "exceptions": "a|b"}) for c, _ in CHAINS for k, v in (("lev", "4.0"), ("icr", "3.0"), ("rev", "50"))], "chain_id long, target_key string, payload map<string,string>")
    return amendments, instructions, origins, spark.createDataFrame(CHAINS, "chain_id long, comparison_at timestamp_ntz")


@pytest.fixture(scope="module")
def chains(spark):
    return C.Chains(*tables(spark))


def test_states_at_the_comparison(chains):
    s = {(r.chain_id, r.target_key): r for r in chains.states().collect()}
    of = lambda c, k: (s[c, k].status, s[c, k].fields["threshold"])
    assert of(1, "lev") == ("ACTIVE", "4.0") and s[1, "lev"].exceptions == ["a", "b", "acquisition"]
    assert of(1, "dscr") == ("ACTIVE", "1.25") and s[1, "dscr"].party == ["borrower"] and "canonical_key" not in s[1, "dscr"].fields
    assert of(1, "rev") == ("ACTIVE", "75") and of(1, "icr") == ("ACTIVE", "3.0")
    assert of(2, "lev") == ("ACTIVE", "4.2")
    assert of(3, "lev") == ("ACTIVE", "4.5") and s[3, "lev"].valid_from == day(6, 30) and s[3, "lev"].waived_from is None
    assert of(4, "lev") == ("ACTIVE", "4.0") and s[4, "lev"].restored and of(4, "icr") == ("ACTIVE", "2.0")
    assert of(6, "lev") == ("WAIVED", "5.0")
    assert of(7, "lev") == ("ACTIVE", "4.0") and not s[7, "lev"].restored
    assert of(8, "lev") == ("WAIVED", "4.0") and (s[8, "lev"].waived_from, s[8, "lev"].waived_to) == (day(1), day(12, 1))


def test_status_and_authority_of_each_amendment(chains):
    steps = {(r.chain_id, r.amendment_number): (r.status, r.outstanding, r.authoritative) for r in chains.steps().collect()}
    assert [steps[1, k] for k in (1, 2, 3)] == [("COMPLETE", 0, True)] * 3
    assert steps[2, 1] == ("PARTIAL", 1, False) and steps[2, 2] == ("COMPLETE", 1, False)
    assert steps[5, 1] == ("UNRESOLVED", 1, False) and steps[5, 2] == ("COMPLETE", 1, False) and steps[5, 3] == ("COMPLETE", 0, True)
    assert len(steps) == len(AMENDMENTS)
    assert [r.action for r in chains.events().where("kind = 'error'").collect()] == ["several waivers"]
    assert {(r.chain_id, r.target_key, r.resolved_by) for r in chains.resolved().collect()} == {(2, "icr", None), (5, "icr", 3)}


def test_a_stream_gives_the_events_of_the_batch(spark, chains, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    amendments, instructions, origins, _ = tables(spark)
    rows = C.prepared(instructions.join(amendments, ["chain_id", "amendment_number"]))
    late = C.prepared(spark.createDataFrame([instruction(99, 1, 1, "SUSPEND", "none")], COLUMNS).withColumn("at", F.lit(day(10)).cast("timestamp_ntz")))
    for k, (at,) in enumerate(sorted(rows.select("at").distinct().collect())):
        rows.where(F.col("at") == at).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={k:02d}"))
    late.coalesce(1).write.parquet(str(tmp_path / "in" / "b=98"))
    late.withColumn("amendment_number", F.lit(2)).coalesce(1).write.parquet(str(tmp_path / "in" / "b=99"))
    out = str(tmp_path / "out")
    opening = C.prepared(origins.withColumns({"amendment_number": F.lit(0), "instruction_order": F.lit(0)}))
    (tmp_path / "now").mkdir()
    for k, f in enumerate(sorted((tmp_path / "in").glob("b=*/*.parquet"))):  # one file a batch, oldest first
        f.rename(at := tmp_path / "now" / f"{k:02d}.parquet")
        os.utime(at, (1_700_000_000 + 10 * k,) * 2)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "now"))
    events = S.chain_stream(S.with_event_time(source), opening)
    events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination(300)
    got = spark.read.schema(S.EVENTS).parquet(out).where("chain_id < 90").collect()
    key = lambda r: (r.chain_id, r.target_key, r.amendment_number, r.instruction_order, r.outcome, r.action)
    batch = chains.events().collect()
    assert sorted(map(key, (r for r in got if r.kind == "event"))) == sorted(map(key, (r for r in batch if r.kind == "event")))
    restores = [(r.chain_id, r.target_key) for r in batch if r.kind == "restore"] + [(r.chain_id, r.target_key) for r in chains.states().where("restored").collect()]
    assert sorted((r.chain_id, r.target_key) for r in got if r.kind == "restore") == sorted(restores)


def test_awkward_chains(spark):
    """Empty tables, a null target, instructions of an unknown amendment, repeated rows, and rows in any order."""
    amendments, instructions, origins, chains = tables(spark)
    none = C.Chains(amendments.limit(0), instructions.limit(0), origins.limit(0), chains)
    assert none.states().count() == none.events().count() == none.steps().count() == 0
    odd = [instruction(1, 1, 1, "REPLACE_VALUE"), instruction(1, 7, 1, "SUSPEND", "lev"), *INSTRUCTIONS, INSTRUCTIONS[5]]
    random.Random(5).shuffle(odd)
    some = C.Chains(amendments, spark.createDataFrame(odd, COLUMNS).repartition(7), origins, chains)
    found = {(r.chain_id, r.target_key): r for r in some.states().collect()}
    assert found[1, "lev"].status == "SUSPENDED" and found[3, "lev"].fields["threshold"] == "4.5"
    twice = [(r.outcome, r.action) for r in some.events().where("chain_id = 2 and amendment_number = 1 and instruction_type = 'REPLACE_VALUE'").collect()]
    assert sorted(twice) == [("APPLIED", "replace"), ("UNRESOLVED", "old value differs")]
    lost = some.events().where("target_key is null").collect()
    assert [r.outcome for r in lost] == ["UNRESOLVED"]


def test_states_without_events_are_the_states_of_the_events(spark):
    from accordwell.operators import execution as X

    few = X.full_instruction(spark, "/root/testdata/sf0.001")
    slow, fast = X.final_states(X.execute(few)), X.execute_to_states(few).select(*X.final_states(X.execute(few)).columns)
    key = lambda r: (r.agreement_id, r.target_key)
    assert sorted(map(repr, slow.collect())) == sorted(map(repr, fast.collect())) and len({key(r) for r in fast.collect()}) == fast.count()
    assert X.execute_to_states(few.limit(0)).count() == 0
