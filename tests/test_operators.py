"""Planted cases: folds, lineage, intervals, gates and matching on small literal tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from accordwell.operators import compare, documents, gates, lineage, mapping, state, temporal


def at(month: int, year: int = 2023) -> datetime:
    return datetime(year, month, 1)


VERSION = "version_id long, agreement_id long, canonical_key string, status string, valid_from timestamp_ntz, valid_to timestamp_ntz, version_number int, threshold double"


def test_kernel_as_of_is_half_open(spark):
    rows = [(1, 1, "a", "ACTIVE", at(1), at(3), 1, 4.0), (2, 1, "a", "ACTIVE", at(3), None, 2, 4.5)]
    v = spark.createDataFrame(rows, VERSION)
    for when, want in ((at(2), [1]), (at(3), [2]), (at(12), [2]), (datetime(2022, 1, 1), [])):
        assert [r.version_id for r in temporal.kernel_as_of(v, when).collect()] == want


def test_overlap_is_found_only_within_a_key(spark):
    rows = [
        (1, 1, "a", "ACTIVE", at(1), at(6), 1, 1.0),
        (2, 1, "a", "ACTIVE", at(5), None, 2, 1.0),
        (3, 1, "b", "ACTIVE", at(1), at(5), 1, 1.0),
        (4, 1, "b", "ACTIVE", at(5), None, 2, 1.0),
        (5, 2, "a", "ACTIVE", at(1), None, 1, 1.0),
        (6, 1, "a", "WAIVED", at(1), None, 3, 1.0),
    ]
    found = temporal.contradictory_active(spark.createDataFrame(rows, VERSION)).collect()
    assert [(r.id_a, r.id_b) for r in found] == [(1, 2)]


def test_latest_version_prefers_the_open_one(spark):
    rows = [(1, 1, "a", "ACTIVE", at(1), None, 1, 1.0), (2, 1, "a", "ACTIVE", at(2), at(3), 2, 1.0)]
    assert temporal.latest_version(spark.createDataFrame(rows, VERSION)).first().version_id == 1


INSTRUCTION = "agreement_id long, target_key string, step int, instruction_type string, new_value double"


def fold(spark, rows):
    return {(r.agreement_id, r.target_key): r for r in state.fold_instructions(spark.createDataFrame(rows, INSTRUCTION)).collect()}


def test_clean_chain(spark):
    rows = [(1, "lev", 1, "ADD_COMMITMENT", 4.0), (1, "lev", 2, "REPLACE_VALUE", 4.5), (1, "lev", 3, "REPLACE_VALUE", 4.0), (1, "cap", 2, "ADD_COMMITMENT", 9.0)]
    got = fold(spark, rows)
    assert got[1, "lev"].value == 4.0 and got[1, "lev"].outcome == "COMPLETE" and got[1, "cap"].value == 9.0


def test_a_failed_guard_leaves_the_state(spark):
    rows = [(1, "lev", 1, "REPLACE_VALUE", 9.0), (1, "lev", 2, "ADD_COMMITMENT", 4.0), (1, "lev", 3, "ADD_COMMITMENT", 5.0), (1, "lev", 4, "WAIVE_TEMPORARILY", None), (1, "lev", 5, "REPLACE_VALUE", 6.0)]
    r = fold(spark, rows)[1, "lev"]
    assert (r.status, r.value, r.applied, r.unresolved, r.outcome) == ("WAIVED", 6.0, 3, 2, "PARTIAL")


def test_reinstating_works_on_any_status_and_others_are_untouched(spark):
    rows = [(1, "a", 1, "ADD_COMMITMENT", 1.0), (1, "a", 2, "DELETE_COMMITMENT", None), (1, "a", 3, "REINSTATE", None), (2, "a", 1, "UNRESOLVED", None)]
    got = fold(spark, rows)
    assert got[1, "a"].status == "ACTIVE" and got[1, "a"].unresolved == 0 and got[2, "a"].outcome == "UNRESOLVED"


def test_fold_does_not_depend_on_partitioning(spark):
    rows = [(i % 5, f"k{i % 3}", i, ["ADD_COMMITMENT", "REPLACE_VALUE", "WAIVE_TEMPORARILY", "REINSTATE"][i % 4], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, INSTRUCTION)
    key = lambda d: sorted(map(str, state.fold_instructions(d).collect()))
    assert key(df) == key(df.orderBy(F.rand(3)).repartition(7))


def test_only_a_later_constructive_step_on_the_same_key_resolves(spark):
    rows = [(1, "a", 1, "UNRESOLVED", None), (1, "b", 2, "REPLACE_VALUE", 1.0), (1, "a", 3, "REPLACE_VALUE", 1.0), (1, "c", 4, "UNRESOLVED", None)]
    got = [(r.step, r.own, r.inherited) for r in state.inherited_unresolved(spark.createDataFrame(rows, INSTRUCTION)).orderBy("step").collect()]
    assert got == [(1, 1, 0), (2, 0, 1), (3, 0, 0), (4, 1, 0)]


def test_paths_and_cycles(spark):
    chain = [(i, i - 1) for i in range(2, 41)]
    paths = lineage.ancestor_paths(spark.createDataFrame(chain + [(100, 101), (101, 102), (102, 100)], "node long, parent long"))
    assert paths.where("node = 40 and ancestor = 1").first().depth == 39
    assert sorted(r.node for r in paths.where("node = ancestor").collect()) == [100, 101, 102]
    assert lineage.ancestor_paths(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_gate_takes_the_first_reason(spark):
    schema = "execution string, completeness string, validity string, checks_passed boolean, lineage_valid boolean, inherited int, evidence string, uncertainty string, target_level string"
    rows = [
        ("COMPLETE", "COMPLETE", "VALID", True, True, 0, "SUFFICIENT", "LOW", "SUFFICIENT"),
        ("COMPLETE", "COMPLETE", "VALID", True, None, 0, "SUFFICIENT", "LOW", "SUFFICIENT"),
        ("COMPLETE", "COMPLETE", "INVALID", False, False, 1, "WEAK", "HIGH", "WEAK"),
        ("COMPLETE", "COMPLETE", "VALID", True, True, 0, "WEAK", "HIGH", "WEAK"),
        ("PARTIAL", "COMPLETE", "VALID", True, True, 0, "SUFFICIENT", "LOW", "SUFFICIENT"),
    ]
    got = [(r.decision, r.reason) for r in gates.authority_gate(spark.createDataFrame(rows, schema)).collect()]
    assert got == [
        ("GRANTED", "all conditions hold"),
        ("BLOCKED", "lineage not valid"),
        ("BLOCKED", "proof invalid"),
        ("VALIDATION_REQUIRED", "uncertainty high"),
        ("PARTIAL", "execution partial"),
    ]


def test_state_diff_is_null_safe(spark):
    s = "agreement_id long, canonical_key string, threshold double, status string, unit string"
    mine = spark.createDataFrame([(1, "a", 1.0, "X", None), (1, "b", 2.0, "X", "USD")], s)
    truth = spark.createDataFrame([(1, "a", 1.0, "Y", None), (1, "c", 2.0, "X", "USD")], s)
    got = {r.canonical_key: (r.presence, r.differing) for r in compare.state_diff(mine, truth).collect()}
    assert got == {"a": ("both", "status"), "b": ("extra", None), "c": ("missing", None)}


def test_overlaps_keep_the_first_then_the_priority(spark):
    rows = [(1, 0, 10, 2), (1, 5, 20, 0), (1, 10, 12, 1), (1, 30, 40, 3), (1, 30, 35, 1)]
    kept = documents.drop_overlaps(spark.createDataFrame(rows, "document_id long, start int, end int, priority int")).collect()
    assert sorted((r.start, r.end) for r in kept) == [(0, 10), (10, 12), (30, 35)]


@pytest.mark.parametrize(
    "text, want",
    [
        ('Section 7.1 is amended by deleting "4.00" and substituting "4.50" and is waived until May', ["REPLACE_TEXT", "WAIVE_TEMPORARILY"]),
        ("amended and restated in its entirety", ["RESTATE_SECTION"]),
        ("nothing", []),
        (None, []),
    ],
)
def test_instruction_spans(spark, text, want):
    got = documents.instruction_spans(spark.createDataFrame([(1, text)], "document_id long, text string")).orderBy("start").collect()
    assert [r.instruction_type for r in got] == want
    for r in got:
        assert text[r.start : r.end]


def test_addresses_prefer_equal_then_longer_then_shorter(spark):
    a = spark.createDataFrame([("7.1", "x", 1), ("7.1.2", "y", 2), ("8", "z", 3)], "section string, key string, seq long")
    q = spark.createDataFrame([(1, "7.1"), (2, "7"), (3, "8.4.1"), (4, "9"), (5, "7.10")], "q_id long, q string")
    got = {r.q_id: (r.key, r.tier) for r in mapping.resolve_address(q, a).collect()}
    assert got == {1: ("x", 1), 2: ("x", 2), 3: ("z", 3)}
