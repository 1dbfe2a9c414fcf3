"""Chains of amendments by hand: clean, partial, waivers with restores, and resolution of what was left open."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from accordwell.operators import execution as X
from accordwell.operators.bitemporal import authoritative_kernel, persistence_plan, with_restores
from accordwell.operators.conservation import invariant_results
from accordwell.operators.gates import authority_gate
from accordwell.operators.grammar import filing_segments, parse_instructions

NAMES = [c.split()[0] for c in X.INSTRUCTION.split(", ")]


def day(month, year=2020):
    return datetime(year, month, 1)


def instruction(step, kind, key="leverage", **more):
    row = dict.fromkeys(NAMES) | {"agreement_id": 1, "target_key": key, "step": step, "instruction_type": kind} | more
    return tuple(row[n] for n in NAMES)


def run(spark, *rows):
    events = X.execute(spark.createDataFrame(list(rows), X.INSTRUCTION)).orderBy("target_key", "step").collect()
    states = {s.target_key: s for s in X.final_states(spark.createDataFrame(events, X.EVENT)).collect()}
    return events, states


START = instruction(0, "ADD_COMMITMENT", payload={"threshold": "4.0", "exceptions": "a|b", "party": "p"})


def test_a_clean_chain(spark):
    events, states = run(
        spark,
        START,
        instruction(1, "REPLACE_VALUE", field="threshold", old_value="4.0", new_value="4.5"),
        instruction(2, "ADD", domain_effect="EXCEPTION_EXPANSION", new_value="c"),
        instruction(3, "REPLACE_VALUE", domain_effect="COVENANT_THRESHOLD_CHANGE", old_value="4.5", new_value="4.0"),
        instruction(4, "ADD", key="coverage", payload={"threshold": "2.0"}),
        instruction(5, "ADD", domain_effect="EXCEPTION_EXPANSION", new_value="c"),
    )
    assert all(e.outcome == "APPLIED" for e in events)
    s = states["leverage"]
    assert s.fields["threshold"] == "4.0" and s.exceptions == ["a", "b", "c"] and s.outcome == "COMPLETE" and s.applied == 5
    assert states["coverage"].fields["threshold"] == "2.0"


def test_a_restatement_leaves_a_step_partial(spark):
    _, states = run(spark, START, instruction(1, "RESTATE_SECTION"), instruction(2, "REPLACE_VALUE", field="threshold", new_value="5"))
    assert (states["leverage"].outcome, states["leverage"].unresolved, states["leverage"].fields["threshold"]) == ("PARTIAL", 1, "5")


def test_what_cannot_be_applied_changes_nothing(spark):
    refused = [
        instruction(1, "REPLACE_VALUE", field="threshold", old_value="9", new_value="5"),
        instruction(2, "REPLACE_VALUE", field="colour", new_value="5"),
        instruction(3, "REPLACE_TEXT", new_value="5"),
        instruction(4, "ADD_COMMITMENT", payload={"threshold": "1"}),
        instruction(5, "ADD_COMMITMENT"),
        instruction(6, "DELETE", domain_effect="EXCEPTION_REMOVAL", old_value="z"),
        instruction(7, "WAIVE_TEMPORARILY", effective_start=day(3), effective_end=day(3)),
        instruction(8, "WAIVE_TEMPORARILY", effective_start=day(3)),
        instruction(9, "ADD", new_value="x"),
        instruction(10, "FIND_REPLACE_REFERENCE"),
        instruction(11, "UNRESOLVED"),
        instruction(12, "RENUMBER_REFERENCE", old_ref="7.1"),
        instruction(1, "SUSPEND", key="unknown"),
    ]
    events, states = run(spark, START, *refused)
    assert [e.outcome for e in events] == ["APPLIED"] + ["UNRESOLVED"] * len(refused)
    s = states["leverage"]
    assert (s.status, s.fields["threshold"], s.exceptions, s.party, s.outcome) == ("ACTIVE", "4.0", ["a", "b"], ["p"], "PARTIAL")
    assert states["unknown"].status is None and states["unknown"].outcome == "UNRESOLVED"


def test_statuses_and_lists(spark):
    events, states = run(
        spark,
        START,
        instruction(1, "SUSPEND"),
        instruction(2, "REPLACE_VALUE", field="threshold", new_value="5"),
        instruction(3, "REINSTATE"),
        instruction(4, "DELETE", domain_effect="PARTY_CHANGE", old_value="nobody"),
        instruction(5, "ADD", domain_effect="PARTY_CHANGE", new_value="q"),
        instruction(6, "DELETE", domain_effect="EXCEPTION_REMOVAL", old_value="a"),
        instruction(7, "RENUMBER_REFERENCE", old_ref="7.1", new_ref="8.1"),
        instruction(8, "DELETE"),
    )
    assert [e.status for e in events] == ["ACTIVE", "SUSPENDED", "SUSPENDED"] + ["ACTIVE"] * 5 + ["DELETED"]
    assert (states["leverage"].exceptions, states["leverage"].party) == (["b"], ["p", "q"])


def test_only_the_same_target_field_and_type_resolves(spark):
    rows = [
        START,
        instruction(1, "REPLACE_VALUE", field="threshold", old_value="9", new_value="5"),
        instruction(2, "REPLACE_VALUE", field="deadline", new_value="May"),
        instruction(3, "REPLACE_TEXT", field="threshold", new_value="6"),
        instruction(4, "REPLACE_VALUE", field="threshold", old_value="6", new_value="7"),
    ]
    df = spark.createDataFrame(rows, X.INSTRUCTION)
    wanted = df.select("agreement_id", "target_key", "step", F.coalesce("field", "domain_effect", F.lit("")).alias("wanted"))
    got = X.resolutions(X.execute(df).join(wanted, ["agreement_id", "target_key", "step"])).collect()
    assert [(r.step, r.resolved_by) for r in got] == [(1, 4)]


VERSION = "version_id long, agreement_id long, canonical_key string, status string, valid_from timestamp_ntz, valid_to timestamp_ntz, effective_at timestamp_ntz, version_number int, recorded_at timestamp_ntz, threshold double"


def kernel(spark, versions, at):
    rows = authoritative_kernel(with_restores(spark.createDataFrame(versions, VERSION)), at).collect()
    return [(r.version_id, r.status, r.threshold) for r in rows]


def test_a_waiver_gives_way_to_the_restored_terms(spark):
    """Waived from January to July; an unrelated amendment in March; one in August that hasn't taken effect."""
    versions = [
        (1, 1, "k", "SUPERSEDED", None, day(1), None, 0, day(1), 4.0),
        (2, 1, "k", "WAIVED", day(1), day(7), day(1), 1, day(1), 4.0),
        (3, 1, "other", "ACTIVE", None, None, day(3), 2, day(3), 1.0),
        (4, 1, "k", "ACTIVE", day(8), None, day(9), 3, day(8), 5.0),
    ]
    one = [v for v in versions if v[2] == "k"]
    assert kernel(spark, one, day(3)) == [(2, "WAIVED", 4.0)]
    assert kernel(spark, one, day(7)) == [(2, "ACTIVE", 4.0)]  # half-open
    assert kernel(spark, one, day(8)) == [(2, "ACTIVE", 4.0)]
    assert kernel(spark, one, day(9)) == [(4, "ACTIVE", 5.0)]
    assert kernel(spark, versions[2:3], day(1)) == [] and kernel(spark, versions[2:3], day(3)) == [(3, "ACTIVE", 1.0)]
    assert kernel(spark, [], day(3)) == []


def test_plans_refuse_stacked_waivers(spark):
    schema = "amendment_version_id long, target_key string, instruction_order int, instruction_type string, effective_start timestamp_ntz, effective_end timestamp_ntz, amended_at timestamp_ntz"
    rows = [
        (1, "a", 1, "WAIVE_TEMPORARILY", day(1), day(2), day(1)), (1, "a", 2, "WAIVE_TEMPORARILY", day(3), day(4), day(1)),
        (1, "b", 3, "WAIVE_TEMPORARILY", day(1), None, day(1)), (1, "c", 4, "REPLACE_VALUE", None, None, day(5)), (2, "d", 1, "DELETE", None, None, None), (3, "e", 1, "WAIVE_TEMPORARILY", day(1), day(2), None),
    ]
    got = {r.target_key: r for r in persistence_plan(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r.error for k, r in got.items()} == {"a": "several waivers", "b": "waiver without interval", "c": None, "d": "no effective time", "e": None}
    assert got["c"].valid_from == day(5) and got["c"].edge_type == "MODIFIES" and got["e"].restore_from == day(2)


GOOD = {"execution": "COMPLETE", "completeness": "COMPLETE", "validity": "VALID", "checks_passed": True, "lineage_valid": True, "inherited": 0, "evidence": "SUFFICIENT", "uncertainty": "NONE", "target_level": "SUFFICIENT"}
GATE = "execution string, completeness string, validity string, checks_passed boolean, lineage_valid boolean, inherited long, evidence string, uncertainty string, target_level string"


@pytest.mark.parametrize("name", [None, *GOOD])
def test_the_gate_is_closed_on_nulls(spark, name):
    row = GOOD | ({name: None} if name else {})
    got = authority_gate(spark.createDataFrame([tuple(row.values())], GATE)).first()
    assert (got.decision == "GRANTED") == (name is None)


def test_the_gate_sends_the_indeterminate_to_validation(spark):
    got = authority_gate(spark.createDataFrame([tuple((GOOD | {"validity": "INDETERMINATE"}).values()), (None,) * 9], GATE)).collect()
    assert [r.decision for r in got] == ["VALIDATION_REQUIRED", "BLOCKED"]


def test_a_change_without_anything_breaks_what_it_can(spark):
    kernel = "struct<commitment_id:string,status:string,valid_from:timestamp_ntz,valid_to:timestamp_ntz,fields:map<string,string>,lists:map<string,array<string>>>"
    schema = f"family string, before {kernel}, after {kernel}, affected array<struct<name:string,declared_old:string,old:string,new:string>>, preserved array<string>, commitment_id string, source_span string, source_document string, source_authority string, old_value_verified boolean"
    rows = [("WAIVER", None, None, [], [], None, None, None, None, None), ("CREATE", None, None, [], [], "c", "s", None, None, None), ("no such family", None, None, None, None, None, None, None, None, None)]
    got = invariant_results(spark.createDataFrame(rows, schema)).collect()
    assert got[0].failed == ["identity_persistence", "unchanged_field_preservation", "target_reference_separation", "lineage_continuity", "out_of_scope_isolation"]
    assert got[1].all_passed and got[2].checked == 0


def test_grammars_and_segments(spark):
    texts = [
        "Section 7.1 stands. Later Section 7.2 is amended by adding a thing. Compliance with Section 9 and more is hereby waived.",
        'NOW THEREFORE Section 7.04 is hereby amended to replace it. Section 7.10 is amended by deleting "old" and inserting "new". [Signature pages follow]\nANNEX A\n\nCREDIT AGREEMENT',
        None,
        "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    old = parse_instructions(df, "0.2").where("document_id = 0").collect()
    assert {(r.instruction_type, r.section) for r in old} == {("ADD_COMMITMENT", "Section 7.1"), ("WAIVE_TEMPORARILY", "Section 7.1")}
    new = parse_instructions(df).collect()
    found = [(r.instruction_type, r.section, r.old_text, r.new_text) for r in new if r.document_id == 1]
    assert found == [("REPLACE_TEXT", "Section 7.10", "old", "new")]
    seg = {r.document_id: r for r in filing_segments(df).collect()}
    assert texts[1][seg[1].composite_start :].startswith("ANNEX A") and seg[1].annex is None and seg[0].body_end == len(texts[0])
