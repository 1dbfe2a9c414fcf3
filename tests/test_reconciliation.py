"""Metrics by hand, and the rows behind them."""

from accordwell.operators import reconciliation as R

LEDGER = "candidate long, chain_id int, family string, target string, origin string, disposition string, legacy_attempted boolean, legacy_disposition string, state_mutated boolean, authority_promoted boolean, gold_available boolean, correctness string"
ROWS = [
    (1, 1, "WAIVER", "lev", "parser", "promoted", False, None, True, True, True, "correct"),
    (2, 1, "WAIVER", "lev", "extraction", "rejected", True, "applied", True, False, True, "incorrect"),
    (3, 2, None, None, "extraction", "routed", False, None, False, False, False, "not_scorable"),
    (40_000, 3, "CREATE", "rev", "parser", "promoted", False, None, True, True, True, "incorrect"),
    (32_768, 4, "CREATE", "rev", "parser", "routed", True, "unresolved", None, None, None, None),
]


def test_counts_rates_and_the_rows_behind_them(spark):
    ledger = spark.createDataFrame(ROWS, LEDGER)
    bitmaps = R.provenance(ledger)
    values = {r.metric: r for r in R.metric_values(bitmaps).collect()}
    assert {m: values[m].n for m in ("mapped", "spine_promoted", "spine_rejected", "scorable", "verified_correct", "incorrect_promoted", "unscored", "legacy_unresolved", "parser_mapped")} == {
        "mapped": 5, "spine_promoted": 2, "spine_rejected": 1, "scorable": 3, "verified_correct": 1, "incorrect_promoted": 1, "unscored": 1, "legacy_unresolved": 1, "parser_mapped": 3,
    }
    assert (values["precision"].rate, values["parser_precision"].rate, values["extraction_precision"].denominator) == (0.3333, 0.5, 1)
    assert sorted(r.id for r in R.rows_behind(bitmaps, "mapped").collect()) == [1, 2, 3, 32_768, 40_000]
    assert sorted(r.id for r in R.rows_behind(bitmaps, "spine_promoted").collect()) == [1, 40_000]


def test_parts_merge_and_counts_stay(spark):
    ledger = spark.createDataFrame(ROWS, LEDGER)
    parts = R.provenance(ledger.where("candidate < 3")).unionAll(R.provenance(ledger.where("candidate >= 2")))  # row 2 is in both
    merged = {(r.metric, r.bucket): bytes(r.rows) for r in R.merge_provenance(parts).collect()}
    assert merged == {(r.metric, r.bucket): bytes(r.rows) for r in R.provenance(ledger).collect()}


def test_chains_and_an_empty_ledger(spark):
    ledger = spark.createDataFrame(ROWS, LEDGER)
    failures = {r.chain_id: r.first_failure for r in R.chain_rows(ledger).collect()}
    assert failures == {1: "no_incorrect", 2: "target_resolved", 3: "no_incorrect", 4: "executable_available"}
    assert [r.n for r in R.chain_funnel(R.chain_rows(ledger)).orderBy("position").collect()] == [4, 4, 3, 2, 2, 2, 0]
    assert {r.family: (r.total_count, r.verified_incorrect) for r in R.family_inventory(ledger).collect()} == {"WAIVER": (2, 1), "CREATE": (2, 1), "none": (1, 0)}
    empty = ledger.limit(0)
    values = R.metric_values(R.provenance(empty)).collect()
    assert len(values) == len(R.METRICS) + len(R.RATES) and all(r.n == 0 and r.rate is None for r in values)
    assert [r.n for r in R.chain_funnel(R.chain_rows(empty)).collect()] == [0] * len(R.FUNNEL)
