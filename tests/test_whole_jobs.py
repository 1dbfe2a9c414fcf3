"""Whole jobs on small literal tables, where a list, a filter or a prefix once cut something off."""

import random
import re
from datetime import datetime

import duckdb

from accordwell import projections, registry
from accordwell.operators import evaluation, extraction, lineage, state, temporal


def test_corpus_structure_counts_formats_outside_the_list(spark):
    texts = spark.createDataFrame([("src0",), ("src0",), ("src7",), (None,)], "format string")
    got = {r.format: (r.n, r.percent) for r in evaluation.corpus_structure(texts, evaluation.FORMATS).collect()}
    assert got == {"src0": (2, 50.0), "src1": (0, 0.0), "src2": (0, 0.0), "unknown": (0, 0.0), "src7": (1, 25.0), None: (1, 25.0)}


def test_corpus_structure_accounts_for_every_document(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = registry.QUERIES["agg_corpus_structure_all"](spark, sf_dir).collect()
    assert sum(r.n for r in got) == duckdb.sql(f"select count(*) from '{sf_dir}/documents.parquet'").fetchall()[0][0]


def test_provenance_keeps_every_id(spark):
    rows = [("a", i) for i in range(1, 1203)] + [(None, 7), (None, 501)]
    got = {(r.metric, r.n, r.id) for r in evaluation.provenance_rows(spark.createDataFrame(rows, "metric string, id long")).collect()}
    assert got == {("a", 1202, i) for i in range(1, 1203)} | {(None, 2, 7), (None, 2, 501)}


def test_cycles_of_any_length_without_what_leads_to_them(spark):
    """Against following each node's parents one by one."""
    parent = {i: i - 1 for i in range(2, 60)}  # a chain
    parent |= {100: 102, 101: 100, 102: 101} | {i: i - 1 for i in range(103, 140)}  # a cycle of three with a long tail
    parent |= {200: 200, 201: 200, 300: 301, 301: 300, 400: 999}  # one on itself, one of two, and a parent that isn't there
    parent |= {i: 500 + (i - 499) % 37 for i in range(500, 537)}

    def on_cycle(n):
        at = parent.get(n)
        for _ in parent:
            if at is None or at == n:
                break
            at = parent.get(at)
        return at == n

    got = lineage.cycle_nodes(spark.createDataFrame([*parent.items(), (1, None)], "node long, parent long")).collect()
    assert sorted(r.node for r in got) == sorted(n for n in parent if on_cycle(n))


def test_verdict_sees_long_cycles_and_contradictions(spark):
    at = lambda month: datetime(2023, month, 1)
    rows = [
        (1, 1, "a", None, "ACTIVE", at(1), at(3)),
        (2, 1, "a", 1, "ACTIVE", at(3), None),
        (3, 2, "a", 4, "ACTIVE", at(1), at(3)),  # two-step cycle
        (4, 2, "a", 3, "ACTIVE", at(3), None),
        (5, 3, "a", None, "ACTIVE", at(1), at(4)),  # overlapping
        (6, 3, "a", 5, "ACTIVE", at(3), None),
        (7, 4, "a", 99, "ACTIVE", at(1), None),
        (8, 5, "a", None, "ACTIVE", at(2), at(2)),
        (9, 6, "a", 9, "ACTIVE", at(1), None),
    ]
    schema = "version_id long, agreement_id long, canonical_key string, parent_version_id long, status string, valid_from timestamp_ntz, valid_to timestamp_ntz"
    got = {r.agreement_id: r for r in temporal.integrity_verdict(spark.createDataFrame(rows, schema)).collect()}
    assert {a: r.sound for a, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    assert [(got[a].invalid_intervals, got[a].orphans, got[a].self_loops, got[a].cycles, got[a].contradictions) for a in range(1, 7)] == [
        (0, 0, 0, 0, 0), (0, 0, 0, 2, 0), (0, 0, 0, 0, 1), (0, 1, 0, 0, 0), (1, 0, 0, 0, 0), (0, 0, 1, 1, 0)
    ]


def test_the_registered_verdict_uses_the_whole_one(spark, monkeypatch):
    v = "version_id long, agreement_id long, canonical_key string, parent_version_id long, status string, valid_from timestamp_ntz, valid_to timestamp_ntz"
    rows = [(1, 1, "a", 2, "ACTIVE", datetime(2023, 1, 1), datetime(2023, 2, 1)), (2, 1, "a", 1, "ACTIVE", datetime(2023, 2, 1), None)]
    monkeypatch.setattr(temporal.P, "commitment_version", lambda spark, sf_dir: spark.createDataFrame(rows, v))
    assert [r.sound for r in registry.QUERIES["tmp_integrity_verdict"](spark, "").collect()] == [False]


def test_cycles_are_found_on_all_edges_of_the_lineage(spark):
    """The registered query against following every edge of the planted lineage by hand."""
    sf_dir = "/root/testdata/sf0.001"
    versions = projections.commitment_version(spark, sf_dir)
    parent = {r.node: r.parent for r in lineage.plant_cycles(versions).collect()}
    assert len(parent) == versions.count()
    want = set()
    for n in parent:
        at = parent[n]
        for _ in parent:
            if at is None or at == n:
                break
            at = parent.get(at)
        if at == n:
            want.add(n)
    got = [r.node for r in registry.QUERIES["grf_version_cycles"](spark, sf_dir).collect()]
    assert want and len(got) == len(want) and set(got) == want
    assert any(parent[n] != n for n in want) and any(p in want and n not in want for n, p in parent.items())


def test_composites_are_found_wherever_they_begin(spark):
    texts = {
        1: "x" * 30_000 + "\nLicensed under MIT",
        2: "LICENSE and nothing else",
        3: "no such segment, though CAPITALS",
        4: "HEAD \U0001f600 " + "y" * 2500 + "license " + "z" * 480 + "\nQ AB",
        5: "license " + "z" * 490 + "AB",
        6: "license " + "z" * 491 + "AB",
        7: None,
        8: "",
    }
    got = {r.doc_id: (r.start, r.composite) for r in extraction.composite_segments(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}

    def want(text):
        at = (text or "").lower().find("license")
        return (at, bool(re.search("[A-Z]{2,}", text[at : at + 500]))) if at >= 0 else (None, False)

    assert got == {k: want(t) for k, t in texts.items()}
    assert [got[k][1] for k in (1, 3, 5, 6)] == [True, False, True, False]


def test_a_long_history_is_folded_in_segments(spark):
    """One key with most of the instructions, against folding them one after another."""
    kinds = ["ADD_COMMITMENT", "REPLACE_VALUE", "WAIVE_TEMPORARILY", "REINSTATE", "SUSPEND", "RENUMBER_REFERENCE", "UNRESOLVED"]
    pick = random.Random(5)
    rows = [(1, "hot", n, pick.choice(kinds), pick.choice([None, float(n)])) for n in range(4000)] + [(1, "hot", 3990, "DELETE_COMMITMENT", None)]
    rows += [(a, k, n, pick.choice([*kinds, "DELETE_COMMITMENT"]), float(n)) for a in range(2, 30) for k in ("x", "y") for n in range(pick.randrange(1, 9))]
    pick.shuffle(rows)
    schema = "agreement_id long, target_key string, step int, instruction_type string, new_value double"
    df = spark.createDataFrame(rows, schema)
    status_after = {"WAIVE_TEMPORARILY": "WAIVED", "REINSTATE": "ACTIVE", "SUSPEND": "SUSPENDED", "DELETE_COMMITMENT": "DELETED"}
    want: dict = {}
    for a, k, _, kind, new in sorted(rows, key=lambda r: r[:4]):
        status, value, applied, unresolved = want.get((a, k), (None, None, 0, 0))
        known = status is not None
        if kind == "ADD_COMMITMENT" and status is None:
            status, value, applied = "ACTIVE", new, applied + 1
        elif kind == "REPLACE_VALUE" and known:
            value, applied = new, applied + 1
        elif kind in status_after and known:
            status, applied = status_after[kind], applied + 1
        elif kind != "RENUMBER_REFERENCE":
            unresolved += 1
        want[a, k] = status, value, applied, unresolved
    got = {(r.agreement_id, r.target_key): (r.status, r.value, r.applied, r.unresolved) for r in state.fold_instructions(df).collect()}
    assert got == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert state.segment_tables(df).where("target_key = 'hot'").count() > 2
        got = {(r.agreement_id, r.target_key): (r.status, r.value, r.applied, r.unresolved) for r in state.fold_instructions(df).collect()}
        assert got == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
