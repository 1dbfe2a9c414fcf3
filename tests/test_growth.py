"""What made queries grow faster than their input: work that one task did, rounds, and rows that were shuffled more than once."""

import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from accordwell import registry, suite  # noqa: F401
from accordwell.operators import authorisation as A
from accordwell.operators import chain_execution as H
from accordwell.operators import clauses as C
from accordwell.operators import execution as E
from accordwell.operators import grammar as G
from accordwell.functions.columns import python_values
from accordwell import projections as P
from accordwell.operators import matching as M
from accordwell.operators import ordering as O_
from accordwell.operators import promotion as O
from accordwell.operators import reconciliation as R
from accordwell.operators import registries as Y
from accordwell.operators import resolver as V

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_filings_are_parsed_by_all_cores(spark):
    assert G.filing(spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_patterns_are_tried_only_where_their_words_follow(monkeypatch):
    class Counted:
        tried = 0

        def match(self, body, place):
            Counted.tried += 1

    body = "".join(f"Section {k} stands. " for k in range(100)) + "Section 7.1 is hereby waived."
    for version in ("0.3", "0.4"):
        Counted.tried = 0
        G._matches([(kind, Counted()) for kind, _ in G.GRAMMARS[version]], G.NEEDED[version], body)
        assert Counted.tried <= 102  # the places and "is hereby", by one pattern of many


def test_patterns_are_tried_only_where_their_words_are_near(spark):
    class Counted:
        tried = 0

        def match(self, body, place):
            Counted.tried += 1

    body = "".join(f"Section {k} stands. " for k in range(100)) + "x " * 100 + "Section 7.1 is hereby deleted in its entirety."
    G._matches([(kind, Counted()) for kind, _ in G.GRAMMARS["0.4"][:3]], G.NEEDED["0.4"][:3], body, "0.4")
    assert Counted.tried < 15  # not all 100
    rnd = random.Random(3)
    words = "Section_7.1 Section_7.deleted ARTICLE_5 the requirement_of is hereby deleted removed in_its_entirety amended and_restated by_adding delete “x” replaced_with waived of_the_Loan_Agreement to_read_as_follows from \n , ſection_3 \xa0".replace("\n", "\\n").split(" ")
    for version, grammar in G.GRAMMARS.items():
        patterns = [(kind, re.compile(p, re.I | re.S)) for kind, p in grammar]
        for _ in range(1500):
            text = rnd.choice((" ", "  ", " " + "y" * 60 + " ")).join(rnd.choices(words, k=rnd.randrange(25))).replace("_", " ").replace("\\n", "\n")
            assert G._matches(patterns, G.NEEDED[version], text, version) == G._matches(patterns, G.NEEDED[version], text)


def test_contexts_leave_the_tasks_only_where_asked_for(spark):
    for name in ("doc_grammar_03", "doc_grammar_04"):
        assert "context" not in registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "context" in G.parse_instructions(G.filing(spark, DATA)).columns


def test_places_of_segments_count_code_points(spark):
    text = "\U0001f600 NOW, THEREFORE, Section 1 stands. IN WITNESS WHEREOF\nANNEX A\n\nCREDIT AGREEMENT"
    odd = text.replace("S", "ſ", 1)  # small letters differ in number or kind: read without them
    for t in (text, odd):
        got = G.filing_segments(spark.createDataFrame([(1, t)], "document_id long, text string")).first()
        assert (got.body_start, got.body_end, got.composite_start, got.annex) == (2, t.index("IN WITNESS"), t.index("ANNEX"), None)


def test_spans_whose_id_repeats_keep_their_match(spark, tmp_path):
    rows = [(doc, 7 * doc + k % 2, 4 - 3 * (k == 0), 20.0 + k, "N") for doc in range(400) for k in range(5)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string")
    lines.orderBy(F.rand(1)).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.QUERIES["map_span_gold_match"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(d, 70 * d + 1, 70 * d + 4) for d in range(400)]


@pytest.mark.parametrize("most", [M.MOST_PAIRS, 20])
def test_spans_are_matched_in_groups_as_by_rounds(spark, monkeypatch, most):
    rnd = random.Random(5)
    rows = [(rnd.randrange(12), rnd.choice("AB"), f"s{rnd.randrange(3)}" if rnd.random() > 0.1 else None, b if rnd.random() > 0.2 else None, b + rnd.randint(-5, 60), n) for n in range(600) for b in [rnd.randrange(300)]]
    rows += [(None, "A", "s1", 0, 10, 600), (3, None, "s1", 0, 10, 601)]
    spans = spark.createDataFrame(rows, "document_id long, instruction_type string, target_ref string, b int, e int, n long")
    gold, detected = spans.where("n % 2 = 0").withColumnRenamed("n", "gold_id"), spans.where("n % 2 = 1").withColumnRenamed("n", "detected_id")
    wanted = sorted(map(tuple, M.greedy_matching(M.span_pairs(gold, detected)).collect()))
    monkeypatch.setattr(M, "MOST_PAIRS", most)
    assert wanted and sorted(map(tuple, M.match_spans(gold, detected).collect())) == wanted
    assert M.match_spans(gold.limit(0), detected).count() == 0


@pytest.mark.parametrize("most", [M.MOST_PAIRS, 20])
def test_counts_of_matches_need_no_numbers_over_all_spans(spark, monkeypatch, most):
    gold, detected = M.annotation(spark, DATA)
    wanted = sorted(map(tuple, M.match_counts(gold, detected, M.match_spans(gold, detected)).collect()))
    monkeypatch.setattr(M, "MOST_PAIRS", most)
    numbered, number = [], M.with_ordinals
    monkeypatch.setattr(M, "with_ordinals", lambda rows, *order, **more: numbered.append(rows) or number(rows, *order, **more))
    assert sorted(map(tuple, registry.QUERIES["agg_gold_match_counts"](spark, DATA).collect())) == wanted
    assert len(numbered) == (most == 20)  # only large groups that go by rounds


def test_sorts_are_cut_into_portions_by_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_ROWS", 100)
    parted = lambda df: df.rdd.getNumPartitions()
    rows = spark.range(5000).select(F.col("id").alias("n"), (F.col("id") % 7).alias("k"), F.lit("x").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert parted(A.as_of(rows.drop("v"), rows, ["k"], "n", ["v"], "v")) == 100
        assert parted(M.match_spans(*M.annotation_in_line(spark, DATA), M._IN_LINE)) > 50
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert O_.with_ordinals(rows, "n", n=5000).select(F.max("ordinal")).first()[0] == 5000
    assert P.portions_of(spark, 10**9) == 10**7 and P.portions_of(spark, 0) == spark.sparkContext.defaultParallelism


def test_matching_takes_no_rounds(spark, monkeypatch):
    def rounds(*_):
        raise AssertionError("rounds over all pairs")

    monkeypatch.setattr(M, "greedy_matching", rounds)
    assert registry.QUERIES["map_greedy_gold_match"](spark, DATA).count() > 0


def test_ledgers_are_counted_without_ids_or_a_join_back(spark, monkeypatch):
    def ordered(*_, **__):
        raise AssertionError("ids for counts")

    monkeypatch.setattr(R, "with_ordinals", ordered)
    ledger = R.candidate_ledger(spark, DATA)
    plan = ledger._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of evidence with addresses
    assert "source_text" not in plan[: plan.index("Window")]  # texts stay behind the sort
    metrics = {r.metric: r.n for r in R.ledger_metrics(ledger).collect()}
    assert metrics["mapped"] == ledger.count() and list(metrics) == [*R.METRICS, *R.RATES]


def test_evidence_is_judged_from_plain_columns_in_methods_that_are_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("eng_refusals", "eng_authorisations", "agg_family_counters", "agg_metric_provenance"):
            run = (R.candidate_ledger(spark, DATA).select("evidence_id", *R.MEASURED) if name == "agg_metric_provenance" else registry.QUERIES[name](spark, DATA))._jdf.queryExecution()
            assert ("lambda" in run.optimizedPlan().toString()) == (name == "eng_authorisations")  # lists only where they are asked for
            stages = run.debug().codegenToSeq()
            assert max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000  # larger ones stay interpreted
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_bitmaps_are_made_of_rows_that_are_not_multiplied(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_ROWS", 1000)
    ledger = spark.range(1, 70_001).select(F.col("id").alias("candidate"), F.expr("if(id % 2 = 0, 'x', null) AS target"), F.lit("parser").alias("origin"), F.lit("promoted").alias("disposition"), F.lit(None).cast("boolean").alias("legacy_attempted"), F.lit(None).cast("string").alias("legacy_disposition"), F.expr("id % 3 = 0 AS state_mutated"), F.lit(False).alias("authority_promoted"), F.lit(True).alias("gold_available"), F.lit("correct").alias("correctness"))
    got = R.provenance(ledger, n=70_000)
    run = got._jdf.queryExecution().optimizedPlan()
    assert run.toString().rindex("Generate") < run.toString().index("Aggregate")  # above it in the plan: after it
    counts = {(r.metric, r.bucket): r.n for r in got.select("metric", "bucket", F.bitmap_count("rows").alias("n")).collect()}
    assert counts["mapped", 1] == 32_768 and counts["mapped", 3] == 70_000 - 65_536 and counts["parser_target_resolved", 2] == 16_384 and ("authoritative_promotion", 1) not in counts
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = got._jdf.queryExecution().debug().codegenToSeq()
        assert max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_all_fields_of_a_family_that_carries_values_get_the_same(spark):
    families = {*A.FAMILY_OF_TYPE.values(), *A.NAMED_FIELD_FAMILIES, *A.AFFECTED_BY_FAMILY, "OTHER"}
    rows = [(f, t, n, x, None) for f in families for t in (None, "", "exceptions", "threshold", "applicability") for n in (None, "1") for x in (None, "liens")]
    e = spark.createDataFrame(rows, "f string, target_field string, new_value string, exception_text string, effective_date date")
    f = F.col("f")
    set_ = F.transform(A.affected_fields(f), lambda n: A.new_value_of(f, n))
    one = F.transform(A.affected_fields(f), lambda n: A.carried_value(f))
    got = e.select("f", A.affected_fields(f).isNull().alias("a"), A.fields_unknown(f).alias("b"), set_.alias("x"), one.alias("y")).collect()
    assert all(r.a == r.b for r in got) and {r.a for r in got} == {True, False}
    assert all(r.x == r.y and r.x != [] for r in got if r.f not in A.WITHOUT_VALUES)


def test_sections_without_clauses_are_found_by_all_cores(spark, monkeypatch):
    assert C.agreement_text(spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    tried = []
    monkeypatch.setattr(C, "clause_tree", lambda text: tried.append(text) or [])
    text = "Section 7.11 Financial Covenants. It holds:\n(a) One."
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["document_id", "text"])
    (without,), (whole,) = C._run(iter([batch]), clauses=False), C._run(iter([batch]), clauses=True)
    assert without.column(1) == whole.column(1) and tried == [text]


def test_headings_labels_and_verbs_are_tried_only_where_they_may_begin():
    assert [m["number"] for m in C._headings("Section 1 One\nSection 2 Two. Section 3 Three.\tSection 4 Four Section 5 Five.Section 6 Six")] == ["1", "2", "3", "4"]
    assert [m["label"] for m in C._labels("(a) x and (b) y band (c) z\n \n (d) w; (e) v (f) u or(g) t")] == ["a", "b", "d", "e", "g"]
    assert C._states_covenant("It ſhall exceed", values=False) and not C._states_covenant("It shall stay at 5%", values=False)
    assert C._states_covenant("It shall stay at 5%", values=True)


def test_entries_are_tried_only_where_their_word_is(spark):
    assert [Y.rare_word(p) for p in (r"Minimum\s+Liquidity(?:\s+Ratio)?", r"Minimum\s+Shareholders.?\s+Equity", r"section\s+5\.0?1", r"section\s+10\.1\b")] == ["liquidity", "shareholders", "5.", "10.1"]
    texts = ["MINIMUM \t LIQUIDITY", "minimum shareholders' equity of a Term\xa0Loan", "Tier 1 Leverage Ratio", "Revolving  Credit", "Section 5.1", "SECTION 10.10", "section\n6.012", "Kelvin", "", None]
    asked = spark.createDataFrame([(a, b) for a in texts for b in texts], "t string, s string")
    plain = lambda c: Y.plain_spaces(F.coalesce(F.col(c), F.lit("")))
    tried = F.array_compact(F.array(*[F.when(plain("s" if how else "t").rlike("(?i)" + p), F.lit(k)) for k, (p, _, how) in enumerate(Y.REGISTRY)]))
    assert all(r.a == r.b for r in asked.select(tried.alias("a"), Y.matching_entries(F.col("t"), F.col("s")).alias("b")).collect())
    assert Y.mention(spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert V.resolver_tables(spark, DATA)[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_entries_are_tried_once(spark):
    plan = Y.resolve_mentions(Y.mention(spark, DATA), Y.in_state(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("RLIKE" in line and "Filter" in line for line in plan.splitlines())


def test_only_what_is_asked_for_leaves_the_tasks(spark, monkeypatch):
    chains = H.Chains(*H.chain_tables(spark, DATA))
    assert "fields" not in chains._of(states=False).columns and "old" not in chains._of(states=True).columns
    written = []
    monkeypatch.setattr(H, "materialise", lambda df: written.append(df.columns) or df)
    H.Chains(*H.chain_tables(spark, DATA)).states(), H.Chains(*H.chain_tables(spark, DATA)).events(), H.Chains(*H.chain_tables(spark, DATA)).steps()
    assert written == [["chain_id", "target_key", "amendment_number", "instruction_type", "outcome", "wanted"]]


def test_outcomes_are_resolved_without_a_join(spark):
    plan = registry.QUERIES["sta_resolved_by_match"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    bare = spark.createDataFrame([(1, "k", 1, "SUSPEND"), (1, "k", 2, "ADD")], "agreement_id long, target_key string, step int, instruction_type string")
    got = E.execute_to_outcomes(bare)
    assert sorted(map(tuple, got.collect())) == sorted((r.agreement_id, r.target_key, r.step, r.instruction_type, None, r.outcome, r.action) for r in E.execute(bare).collect())


def test_python_values_are_those_of_arrow():
    text = pa.string()
    for values, kind in (([1, None, 2**62 + 1], pa.int64()), ([1, 2], pa.int32()), ([True, None], pa.bool_()), ([True], pa.bool_()), (["a", None, ""], text), ([None, None], pa.int64()), ([], text), ([[("a", None)], None, []], pa.map_(text, text))):
        column = pa.array(values, kind)
        got = python_values(column)
        assert got == column.to_pylist() and list(map(type, got)) == list(map(type, column.to_pylist()))


def test_snapshots_need_only_the_last_operations(spark):
    operations = O.kernel_operation(spark, DATA)
    ends = O.replay_to_ends(operations)
    assert ends.count() == operations.select("commitment_id").distinct().count()
    mine = ends.where("version > 0 and not deleted").select("commitment_id", "version", "current")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, O.snapshot(O.replay(operations)).collect()))
    assert O.replay_to_ends(operations.limit(0)).count() == 0


def test_plans_combine_instructions_before_the_join(spark):
    plan = registry.QUERIES["tmp_persistence_plan"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Join") < plan.index("Aggregate")
