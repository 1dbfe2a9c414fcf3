"""Traces through renames, merges and cycles, global order over many partitions, predecessors as of an amendment, and authorisation step by step."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from accordwell.operators import authorisation as A
from accordwell.operators.addresses import address_book
from accordwell.operators.identity import Traces
from accordwell.operators.ordering import with_ordinals, with_ordinals_within, write_ordered

EDGE = "edge_id long, predecessor long, successor long, edge_class string, family string, at long"


def trace_by_force(edges):
    """(edges taken, reachable) of every identity, one step after another."""
    by = {}
    for e in sorted(edges, key=lambda e: (e[5], e[0])):
        by.setdefault(e[2], []).append(e)
    out = {}
    for start in {e[2] for e in edges} | {e[1] for e in edges if e[1] is not None}:
        taken, here = [], start
        while here is not None:
            left = [e for e in by.get(here, []) if e not in taken]
            if not left:
                break
            taken.append(left[-1])
            here = left[-1][1] if left[-1][1] != left[-1][2] else here
        ok = False
        if taken:
            e = taken[-1]
            ok = e[3] == "ORIGINATES_FROM" or (e[4] == "CREATE" if e[1] is None else e[1] == e[2] or e[1] in by)
        out[start] = ([e[0] for e in taken], ok)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_traces_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    edges = []
    for k in range(160):
        s = rng.randrange(24)
        p = rng.choice([s, s, s, s - 1, s - 1, None, rng.randrange(24), 100 + s])
        edges.append((k, p, s, rng.choice(["MODIFIES"] * 5 + ["ORIGINATES_FROM"]), rng.choice(["CREATE", "SCALAR_REPLACEMENT", "SCALAR_REPLACEMENT"]), rng.randrange(60)))
    traces = Traces(spark.createDataFrame(edges, EDGE))
    want = trace_by_force(edges)
    got = {r.id: r for r in traces.summaries().collect()}
    assert {i: (r.n_edges, r.reachable, r.terminal_edge) for i, r in got.items()} == {i: (len(t), ok, t[-1] if t else None) for i, (t, ok) in want.items()}
    kept = {e[0]: e[1] != e[2] for e in edges}
    assert {i: r.changes for i, r in got.items()} == {i: sum(kept[e] for e in t) for i, (t, _) in want.items()}
    chains = {}
    for r in traces.chains().collect():
        chains.setdefault(r.id, {})[r.position] = r.edge_id
    assert {i: [c[k] for k in sorted(c)] for i, c in chains.items()} == {i: t for i, (t, _) in want.items() if t}


def test_traces_of_one_cycle_and_of_nothing(spark):
    loop = [(1, 2, 1, "MODIFIES", "RENUMBER", 1), (2, 1, 2, "MODIFIES", "RENUMBER", 2)]
    got = {r.id: (r.n_edges, r.reachable) for r in Traces(spark.createDataFrame(loop, EDGE)).summaries().collect()}
    assert got == {1: (2, True), 2: (2, True)}
    assert Traces(spark.createDataFrame([], EDGE)).summaries().count() == 0


def test_ordinals_over_many_partitions(spark, tmp_path):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("key")).repartition(17)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        whole = sorted((r.h, r.ordinal) for r in with_ordinals(rows, "h").collect())
        assert [n for _, n in whole] == list(range(1, 5001))
        got = {}
        for r in with_ordinals_within(rows, ["key"], F.desc("h"), name="n").collect():
            got.setdefault(r.key, []).append((-r.h, r.n))
        assert all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())  # one key has two thirds of all
        write_ordered(rows, str(tmp_path / "out"), "h")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out").glob("part-*.parquet"))
    values = [[r.h for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert len(files) > 1 and sum(values, []) == sorted(h for h, _ in whole)
    assert with_ordinals(rows.limit(0), "h").count() == 0


def test_as_of_takes_the_last_before(spark):
    have = spark.createDataFrame([("a", 1, 10), ("a", 3, 11), ("a", 3, 12), ("b", 5, 13), (None, 1, 14)], "k string, n int, v int")
    asked = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 4), ("b", 5), ("c", 9), (None, 9), ("a", None), ("a", 4)], "k string, n int").withColumn("v_", F.lit("clash"))
    got = sorted((r.k or "", -1 if r.n is None else r.n, r.v, r.found) for r in A.as_of(asked.drop("v_"), have, ["k"], "n", ["v"], "v").collect())
    assert got == [("", 9, None, False), ("a", -1, None, False), ("a", 0, None, False), ("a", 1, None, False), ("a", 2, 10, True), ("a", 4, 12, True), ("a", 4, 12, True), ("b", 5, None, False), ("c", 9, None, False)]


def test_authorisation_step_by_step(spark):
    book = address_book(
        spark.createDataFrame([(1, "Section 7.10(a)", "lev", 1), (1, "Section 2.01", "rev", 2)], "agreement_id int, section_ref string, commitment_id string, seq int"),
        spark.createDataFrame([(1, "rev", "Section 2.02", 3)], "agreement_id int, commitment_id string, new_ref string, seq int"),
    )
    versions = spark.createDataFrame([(1, "lev", 1, 100, {"threshold": "4.0"}), (1, "rev", 5, 101, {"threshold": "50"})], "agreement_id int, commitment_id string, amendment_number int, version_id long, fields map<string,string>")
    base = dict(agreement_id=1, amendment_number=2, section_ref="Section 7.10", source_text="from 4.00 to 4.50", effective_date=None, instruction_type="REPLACE_VALUE", target_field="threshold", new_value="4.5", declared_old_value="4.00", exception_text=None, alias_match="ratio", text_match=None, canonical_key_hint="lev", value_provenance="PARSER_EXTRACTED", family_hint=None)
    cases = [
        ({}, "authorized"), ({"section_ref": "Section 9.9"}, "target_identity"), ({"section_ref": None}, "target_identity"), ({"section_ref": "Section 2.01"}, "predecessor_lookup"), ({"amendment_number": 1}, "predecessor_lookup"),
        ({"instruction_type": "UNRESOLVED"}, "transformation_type"), ({"instruction_type": "ADD"}, "transformation_type"), ({"target_field": None}, "affected_fields"), ({"new_value": None}, "value_extraction"),
        ({"source_text": None}, "value_provenance"), ({"value_provenance": "UNKNOWN"}, "value_provenance"), ({"value_provenance": "RUMOUR"}, "value_provenance"), ({"value_provenance": "CURATOR_PROVIDED"}, "authorized"),
        ({"value_provenance": "CURATOR_PROVIDED", "new_value": "9.5"}, "value_provenance"), ({"declared_old_value": "5"}, "old_value_consistency"), ({"declared_old_value": None}, "authorized"),
        ({"instruction_type": "WAIVE_TEMPORARILY", "target_field": None, "new_value": None, "value_provenance": "UNKNOWN"}, "authorized"), ({"instruction_type": "DELETE", "effective_date": date(2026, 1, 1)}, "authorized"),
        ({"instruction_type": "ADD", "exception_text": "liens", "target_field": None}, "authorized"), ({"instruction_type": "ADD_COMMITMENT", "target_field": None}, "authorized"),
    ]
    kind = "id int, agreement_id int, amendment_number int, section_ref string, source_text string, effective_date date, instruction_type string, target_field string, new_value string, declared_old_value string, exception_text string, alias_match string, text_match string, canonical_key_hint string, value_provenance string, family_hint string"
    rows = spark.createDataFrame([(k, *(base | c).values()) for k, (c, _) in enumerate(cases)], kind)
    got = {r.id: r for r in A.authorise(rows, book, versions, "id").collect()}
    assert [got[k].step for k in range(len(cases))] == [step for _, step in cases]
    assert (got[0].confidence, got[0].predecessor, got[0].family, len(got[0].preserved)) == (95, 100, "SCALAR_REPLACEMENT", 19)
    assert [tuple(v) for v in got[0]["values"]] == [("threshold", "4.0", "4.5")]
    assert [tuple(v) for v in got[16]["values"]] == [("status", None, "WAIVED"), ("applicability", None, '{"waived": true}')]
    assert [v.field for v in got[17]["values"]] == ["status", "valid_to"] and [v.new_value for v in got[18]["values"]] == ["liens"] and len(got[19]["values"]) == 3
