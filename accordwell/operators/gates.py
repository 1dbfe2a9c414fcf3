"""Conservation checks, proofs and gates: rules over the columns of a row, first match wins.

Every rule is a column expression, so a whole rule engine is one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for test, result in reversed(rules):
        out = F.when(test, result).otherwise(out)
    return out


def _pairs(spark, sf_dir) -> DataFrame:
    """Each version beside its predecessor."""
    v = P.commitment_version(spark, sf_dir)
    old = v.select(
        F.col("version_id").alias("parent_version_id"), F.col("threshold").alias("old_threshold"), F.col("status").alias("old_status"), F.col("valid_from").alias("old_from"), F.col("canonical_key").alias("old_key")
    )
    return v.join(old, "parent_version_id")


_PAIRS = """
WITH p AS (SELECT v.*, o.threshold AS old_threshold, o.status AS old_status, o.valid_from AS old_from, o.canonical_key AS old_key
  FROM commitment_version v JOIN commitment_version o ON o.version_id = v.parent_version_id)
"""

#: Which invariants a family of transformation is held to. Fixed values.
APPLICABLE = {
    "identity_persistence": ("SCALAR_REPLACEMENT", "WAIVER", "REINSTATEMENT", "TERMINATE"),
    "unchanged_fields": ("SCALAR_REPLACEMENT", "WAIVER", "REINSTATEMENT", "TERMINATE"),
    "old_value": ("SCALAR_REPLACEMENT",),
    "temporal": ("WAIVER", "REINSTATEMENT", "TERMINATE"),
}


def family_of(old_status: Column, status: Column) -> Column:
    return F.when((status == "WAIVED") & (old_status != "WAIVED"), "WAIVER").when((old_status == "WAIVED") & (status == "ACTIVE"), "REINSTATEMENT").when(status == "SUSPENDED", "TERMINATE").otherwise("SCALAR_REPLACEMENT")


_FAMILY = "CASE WHEN status = 'WAIVED' AND old_status <> 'WAIVED' THEN 'WAIVER' WHEN old_status = 'WAIVED' AND status = 'ACTIVE' THEN 'REINSTATEMENT' WHEN status = 'SUSPENDED' THEN 'TERMINATE' ELSE 'SCALAR_REPLACEMENT' END"


@query(
    "con_invariant_matrix",
    _PAIRS
    + f""", f AS (SELECT *, {_FAMILY} AS family FROM p)
SELECT version_id, family, concat_ws(',',
  CASE WHEN canonical_key <> old_key THEN 'identity_persistence' END,
  CASE WHEN family = 'SCALAR_REPLACEMENT' AND old_threshold < 50000 THEN 'old_value' END,
  CASE WHEN family IN ('WAIVER', 'REINSTATEMENT', 'TERMINATE') AND valid_from <= old_from THEN 'temporal' END,
  CASE WHEN family <> 'SCALAR_REPLACEMENT' AND threshold <> old_threshold THEN 'unchanged_fields' END) AS failed FROM f""",
    "commitment_version",
)
def con_invariant_matrix(spark, sf_dir):
    """The invariants that a change breaks, of those that apply to its family."""
    rows = _pairs(spark, sf_dir).withColumn("family", family_of(F.col("old_status"), F.col("status")))
    broken = {
        "identity_persistence": F.col("canonical_key") != F.col("old_key"),
        "old_value": F.col("old_threshold") < 50000,
        "temporal": F.col("valid_from") <= F.col("old_from"),
        "unchanged_fields": (F.col("family") != "SCALAR_REPLACEMENT") & (F.col("threshold") != F.col("old_threshold")),
    }
    failed = [F.when(F.col("family").isin(*APPLICABLE[n]) & b, n) for n, b in broken.items()]
    return rows.select("version_id", "family", F.concat_ws(",", *failed).alias("failed"))


@query(
    "con_loss_detector",
    """
WITH k AS (SELECT o_custkey AS agreement_id, list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderkey % 3 <> 0))) AS before, list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderkey % 4 <> 0))) AS after FROM orders GROUP BY 1)
SELECT agreement_id, unnest(list_filter(before, lambda x: NOT list_contains(coalesce(after, []), x))) AS lost FROM k""",
)
def con_loss_detector(spark, sf_dir):
    """Items of a list that the next state lacks."""
    kept = lambda c: F.collect_set(F.when(c, F.col("o_orderpriority")))
    k = P.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("agreement_id")).agg(kept(F.col("o_orderkey") % 3 != 0).alias("before"), kept(F.col("o_orderkey") % 4 != 0).alias("after"))
    return k.select("agreement_id", F.explode(F.array_except("before", "after")).alias("lost"))


@query(
    "con_gain_loss",
    """
WITH k AS (SELECT o_custkey AS agreement_id, count(DISTINCT o_orderpriority) FILTER (o_orderkey % 3 <> 0) AS before, count(DISTINCT o_orderpriority) FILTER (o_orderkey % 4 <> 0) AS after, max(o_orderkey) % 2 = 0 AS affected FROM orders GROUP BY 1)
SELECT agreement_id, before, after, NOT (after > before AND NOT affected) AS no_unsupported_gain, NOT (after < before AND NOT affected) AS no_silent_loss FROM k""",
)
def con_gain_loss(spark, sf_dir):
    """A list may grow or shrink only where the change says that it affects it."""
    size = lambda c: F.count_distinct(F.when(c, F.col("o_orderpriority")))
    k = P.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("agreement_id")).agg(
        size(F.col("o_orderkey") % 3 != 0).alias("before"), size(F.col("o_orderkey") % 4 != 0).alias("after"), (F.max("o_orderkey") % 2 == 0).alias("affected")
    )
    return k.select("agreement_id", "before", "after", F.expr("not (after > before and not affected)").alias("no_unsupported_gain"), F.expr("not (after < before and not affected)").alias("no_silent_loss"))


#: Statuses from which a transition is legal. Fixed values.
LEGAL_FROM = {"WAIVER": ("ACTIVE",), "REINSTATEMENT": ("WAIVED",), "TERMINATE": ("ACTIVE", "WAIVED")}


@query(
    "con_transition_validity",
    _PAIRS
    + f""", f AS (SELECT *, {_FAMILY} AS family FROM p)
SELECT family, old_status, CAST(count(*) AS BIGINT) AS n, bool_and(CASE family WHEN 'WAIVER' THEN old_status = 'ACTIVE' WHEN 'REINSTATEMENT' THEN old_status = 'WAIVED' WHEN 'TERMINATE' THEN old_status IN ('ACTIVE', 'WAIVED') ELSE true END) AS legal
FROM f GROUP BY 1, 2""",
    "commitment_version",
)
def con_transition_validity(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select(family_of(F.col("old_status"), F.col("status")).alias("family"), "old_status")
    legal = F.lit(True)
    for family, sources in LEGAL_FROM.items():
        legal = F.when(F.col("family") == family, F.col("old_status").isin(*sources)).otherwise(legal)
    return rows.groupBy("family", "old_status").agg(F.count("*").alias("n"), F.bool_and(legal).alias("legal"))


#: Bands of identity confidence: evidence level, and uncertainty. Fixed values.
BANDS = ((0.85, "SUFFICIENT"), (0.7, "CORROBORATED"), (0.5, "WEAK"))
UNCERTAINTY = ((0.85, "NONE"), (0.7, "LOW"), (0.5, "MEDIUM"))


def evidence_level(confidence: Column) -> Column:
    return first_match([(confidence >= at, level) for at, level in BANDS], "INSUFFICIENT")


def uncertainty(confidence: Column) -> Column:
    return first_match([(confidence >= at, level) for at, level in UNCERTAINTY], "HIGH")


#: The test data's confidences, spread over all bands.
_CONFIDENCE = "round(1 - (1 - parser_confidence) * 8, 2)"
_LEVEL = f"CASE WHEN {_CONFIDENCE} >= 0.85 THEN 'SUFFICIENT' WHEN {_CONFIDENCE} >= 0.7 THEN 'CORROBORATED' WHEN {_CONFIDENCE} >= 0.5 THEN 'WEAK' ELSE 'INSUFFICIENT' END"
_UNSURE = f"CASE WHEN {_CONFIDENCE} >= 0.85 THEN 'NONE' WHEN {_CONFIDENCE} >= 0.7 THEN 'LOW' WHEN {_CONFIDENCE} >= 0.5 THEN 'MEDIUM' ELSE 'HIGH' END"


@query(
    "prf_bands",
    f"SELECT {_LEVEL} AS level, {_UNSURE} AS uncertainty, CAST(count(*) AS BIGINT) AS n, min({_CONFIDENCE}) AS lowest FROM amendment_instruction GROUP BY 1, 2",
    "amendment_instruction",
)
def prf_bands(spark, sf_dir):
    i = P.amendment_instruction(spark, sf_dir).withColumn("c", F.expr(_CONFIDENCE))
    return i.groupBy(evidence_level(F.col("c")).alias("level"), uncertainty(F.col("c")).alias("uncertainty")).agg(F.count("*").alias("n"), F.min("c").alias("lowest"))


def proof_completeness(level: Column, affected: Column, checks: Column) -> Column:
    """COMPLETE if the target is well evidenced, each of the affected fields (array of structs with old and new) has a value, and checks were run."""
    valued = F.forall(affected, lambda f: f["old"].isNotNull() | f["new"].isNotNull())
    good = level.isin("SUFFICIENT", "CORROBORATED") & valued & (checks > 0)
    return F.when(F.coalesce(good, F.lit(False)), "COMPLETE").otherwise("INCOMPLETE")


def proof_validity(resolved: Column, checks_passed: Column, level: Column) -> Column:
    """INVALID without a target or with a failed check; INDETERMINATE where the evidence is weak or worse."""
    sound = F.coalesce(resolved, F.lit(False)) & F.coalesce(checks_passed, F.lit(False))
    return F.when(~sound, "INVALID").when(level.isin("SUFFICIENT", "CORROBORATED"), "VALID").otherwise("INDETERMINATE")


@query(
    "prf_proof_states",
    f"""
WITH p AS (SELECT *, {_LEVEL} AS level, old_value < 48 AS resolved, CASE WHEN instruction_order = 6 THEN NULL ELSE new_value >= 3000 END AS passed, CASE WHEN old_value % 7 = 0 THEN NULL ELSE old_value END AS old,
  CASE WHEN old_value % 14 = 0 THEN NULL ELSE new_value END AS new FROM amendment_instruction)
SELECT amendment_version_id, instruction_order, CASE WHEN level IN ('SUFFICIENT', 'CORROBORATED') AND (old IS NOT NULL OR new IS NOT NULL) AND instruction_order < 7 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS completeness,
  CASE WHEN NOT (resolved AND coalesce(passed, false)) THEN 'INVALID' WHEN level IN ('SUFFICIENT', 'CORROBORATED') THEN 'VALID' ELSE 'INDETERMINATE' END AS validity FROM p""",
    "amendment_instruction",
)
def prf_proof_states(spark, sf_dir):
    i = P.amendment_instruction(spark, sf_dir)
    level = evidence_level(F.expr(_CONFIDENCE))
    one = F.struct(F.expr("case when old_value % 7 <> 0 then old_value end").alias("old"), F.expr("case when old_value % 14 <> 0 then new_value end").alias("new"))
    checks = F.when(F.col("instruction_order") < 7, 10).otherwise(0)
    passed = F.when(F.col("instruction_order") != 6, F.col("new_value") >= 3000)
    return i.select("amendment_version_id", "instruction_order", proof_completeness(level, F.array(one), checks).alias("completeness"), proof_validity(F.col("old_value") < 48, passed, level).alias("validity"))


def authority_gate(rows: DataFrame) -> DataFrame:
    """Adds decision and reason. The first test that isn't passed decides; a null counts as the failing value.

    Columns: execution, completeness and validity (of the proof), checks_passed, lineage_valid, inherited (unresolved work of earlier steps), evidence,
    uncertainty, target_level (evidence of the target's identity).
    """
    is_ = lambda name, value: F.col(name) == value
    yes = lambda test: F.coalesce(test, F.lit(False))
    tests = [
        (yes(is_("execution", "UNRESOLVED")), "UNRESOLVED", "execution unresolved"),
        (yes(is_("execution", "PARTIAL")), "PARTIAL", "execution partial"),
        (~yes(is_("execution", "COMPLETE")), "BLOCKED", "execution not complete"),
        (~yes(is_("completeness", "COMPLETE")), "BLOCKED", "proof incomplete"),
        (~yes(F.col("validity").isin("VALID", "INDETERMINATE")), "BLOCKED", "proof invalid"),
        (~yes(F.col("checks_passed")), "BLOCKED", "conservation checks failed"),
        (~yes(F.col("lineage_valid")), "BLOCKED", "lineage not valid"),
        (~yes(F.col("inherited") <= 0), "BLOCKED", "inherited work"),
        (~yes(F.col("evidence").isin("SUFFICIENT", "CORROBORATED", "WEAK")), "BLOCKED", "evidence insufficient"),
        (~yes(F.col("uncertainty").isin("NONE", "LOW", "MEDIUM")), "VALIDATION_REQUIRED", "uncertainty high"),
        (~yes(F.col("target_level").isin("SUFFICIENT", "CORROBORATED")), "VALIDATION_REQUIRED", "target evidence weak"),
        (is_("validity", "INDETERMINATE"), "VALIDATION_REQUIRED", "validity indeterminate"),
    ]
    return rows.withColumns(
        {"decision": first_match([(t, d) for t, d, _ in tests], "GRANTED"), "reason": first_match([(t, r) for t, _, r in tests], "all conditions hold")}
    )


#: Test rows for the gate: every value of every column, and nulls.
_GATE_COLUMNS = {
    "execution": "CASE WHEN new_value < 1500 THEN NULL WHEN new_value < 2500 THEN 'FAILED' WHEN instruction_type = 'UNRESOLVED' AND instruction_order > 2 THEN 'UNRESOLVED' WHEN status <> 'APPLIED' AND instruction_order > 3 THEN 'PARTIAL' ELSE 'COMPLETE' END",
    "completeness": "CASE WHEN old_value = 1 THEN NULL WHEN old_value = 2 THEN 'INCOMPLETE' ELSE 'COMPLETE' END",
    "validity": "CASE WHEN old_value = 3 THEN NULL WHEN old_value = 4 THEN 'INVALID' WHEN old_value > 30 THEN 'INDETERMINATE' ELSE 'VALID' END",
    "checks_passed": "CASE WHEN old_value = 5 THEN NULL ELSE old_value <> 6 END",
    "lineage_valid": "CASE WHEN old_value = 7 THEN NULL ELSE old_value <> 8 END",
    "inherited": "CASE WHEN old_value = 9 THEN NULL ELSE instruction_order - 6 END",
    "evidence": f"CASE WHEN old_value = 10 THEN NULL ELSE {_LEVEL} END",
    "uncertainty": "CASE WHEN old_value = 11 THEN NULL WHEN old_value = 12 THEN 'HIGH' WHEN old_value = 13 THEN 'MEDIUM' ELSE 'LOW' END",
    "target_level": "CASE WHEN old_value = 14 THEN NULL WHEN old_value = 15 THEN 'WEAK' ELSE 'SUFFICIENT' END",
}
_GATE = (
    "WITH g AS (SELECT amendment_version_id, instruction_order, " + ", ".join(f"{sql} AS {name}" for name, sql in _GATE_COLUMNS.items()) + """ FROM amendment_instruction),
d AS (SELECT *, CASE WHEN execution IS NULL THEN 'BLOCKED|execution not complete' WHEN execution = 'UNRESOLVED' THEN 'UNRESOLVED|execution unresolved' WHEN execution = 'PARTIAL' THEN 'PARTIAL|execution partial'
  WHEN execution <> 'COMPLETE' THEN 'BLOCKED|execution not complete' WHEN completeness IS NULL OR completeness <> 'COMPLETE' THEN 'BLOCKED|proof incomplete'
  WHEN validity IS NULL OR validity = 'INVALID' THEN 'BLOCKED|proof invalid' WHEN checks_passed IS NULL OR NOT checks_passed THEN 'BLOCKED|conservation checks failed'
  WHEN lineage_valid IS NULL OR NOT lineage_valid THEN 'BLOCKED|lineage not valid' WHEN inherited IS NULL OR inherited > 0 THEN 'BLOCKED|inherited work' WHEN evidence IS NULL OR evidence = 'INSUFFICIENT' THEN 'BLOCKED|evidence insufficient'
  WHEN uncertainty IS NULL OR uncertainty = 'HIGH' THEN 'VALIDATION_REQUIRED|uncertainty high' WHEN target_level IS NULL OR target_level = 'WEAK' THEN 'VALIDATION_REQUIRED|target evidence weak'
  WHEN validity = 'INDETERMINATE' THEN 'VALIDATION_REQUIRED|validity indeterminate' ELSE 'GRANTED|all conditions hold' END AS dr FROM g)
"""
)


def _gate_rows(spark, sf_dir) -> DataFrame:
    i = P.amendment_instruction(spark, sf_dir)
    return authority_gate(i.select("amendment_version_id", "instruction_order", *(F.expr(sql).alias(name) for name, sql in _GATE_COLUMNS.items())))


@query("gat_authority", _GATE + "SELECT amendment_version_id, instruction_order, split_part(dr, '|', 1) AS decision, split_part(dr, '|', 2) AS reason FROM d", "amendment_instruction")
def gat_authority(spark, sf_dir):
    return _gate_rows(spark, sf_dir).select("amendment_version_id", "instruction_order", "decision", "reason")


@query(
    "gat_step_proofs",
    _GATE
    + """SELECT amendment_version_id, CASE WHEN bool_and(dr LIKE 'GRANTED%') THEN 'GRANTED' ELSE arg_min(split_part(dr, '|', 1), instruction_order) FILTER (dr NOT LIKE 'GRANTED%') END AS decision,
min(instruction_order) FILTER (dr NOT LIKE 'GRANTED%') AS first_offender FROM d GROUP BY 1""",
    "amendment_instruction",
)
def gat_step_proofs(spark, sf_dir):
    """A step takes the decision of its first offending proof."""
    bad = F.when(F.col("decision") != "GRANTED", F.struct("instruction_order", "decision"))
    return _gate_rows(spark, sf_dir).groupBy("amendment_version_id").agg(F.min(bad).alias("b")).select(
        "amendment_version_id", F.coalesce("b.decision", F.lit("GRANTED")).alias("decision"), F.col("b.instruction_order").alias("first_offender")
    )


@query(
    "gat_freeze",
    """
SELECT CAST(count(*) FILTER (valid_to <= valid_from) AS BIGINT) AS invalid, CAST(count(*) FILTER (threshold IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (parent_version_id IS NULL) AS BIGINT) AS roots,
  count(*) FILTER (valid_to <= valid_from) = 0 AND count(*) FILTER (threshold IS NULL) = 0 AND count(*) FILTER (parent_version_id IS NULL) > 0 AS may_freeze FROM commitment_version""",
    "commitment_version",
)
def gat_freeze(spark, sf_dir):
    v = P.commitment_version(spark, sf_dir)
    m = v.agg(F.count_if(F.col("valid_to") <= F.col("valid_from")).alias("invalid"), F.count_if(F.col("threshold").isNull()).alias("missing"), F.count_if(F.col("parent_version_id").isNull()).alias("roots"))
    return m.withColumn("may_freeze", F.expr("invalid = 0 and missing = 0 and roots > 0"))


@query(
    "flt_unresolved_queue",
    "SELECT amendment_version_id, instruction_order, instruction_type, status, CASE WHEN instruction_type = 'UNRESOLVED' THEN 10 ELSE 50 END AS priority FROM amendment_instruction WHERE status = 'UNRESOLVED' OR instruction_type = 'UNRESOLVED'",
    "amendment_instruction",
)
def flt_unresolved_queue(spark, sf_dir):
    i = P.amendment_instruction(spark, sf_dir).where("status = 'UNRESOLVED' or instruction_type = 'UNRESOLVED'")
    return i.select("amendment_version_id", "instruction_order", "instruction_type", "status", F.when(F.col("instruction_type") == "UNRESOLVED", 10).otherwise(50).alias("priority"))


@query(
    "flt_auto_policy",
    """
SELECT amendment_version_id, instruction_order, CASE WHEN count(*) OVER (PARTITION BY amendment_version_id, target_key) = 1 AND instruction_type IN ('ADD', 'REPLACE_VALUE') AND status = 'APPLIED' AND parser_confidence >= 0.95 AND new_value < 50000 THEN 'AUTO' ELSE 'REVIEW' END AS route FROM amendment_instruction""",
    "amendment_instruction",
)
def flt_auto_policy(spark, sf_dir):
    """Automatic only with a unique target, a supported type, a matching guard, enough confidence and little at stake."""
    unique = F.count("*").over(W.partitionBy("amendment_version_id", "target_key")) == 1
    ok = unique & F.col("instruction_type").isin("ADD", "REPLACE_VALUE") & F.expr("status = 'APPLIED' and parser_confidence >= 0.95 and new_value < 50000")
    return P.amendment_instruction(spark, sf_dir).select("amendment_version_id", "instruction_order", F.when(ok, "AUTO").otherwise("REVIEW").alias("route"))


@query(
    "flt_gold_validation",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(';', CASE WHEN l_quantity > 45 THEN 'span too long' END, CASE WHEN l_discount > 0.08 THEN 'status unknown' END, CASE WHEN l_shipdate < TIMESTAMP '1993-01-01' THEN 'date too early' END) AS errors
FROM lineitem WHERE l_quantity > 45 OR l_discount > 0.08 OR l_shipdate < TIMESTAMP '1993-01-01'""",
)
def flt_gold_validation(spark, sf_dir):
    """The list of a record's errors, for records that have any."""
    tests = {"span too long": "l_quantity > 45", "status unknown": "l_discount > 0.08", "date too early": "l_shipdate < timestamp_ntz'1993-01-01'"}
    errors = F.concat_ws(";", *[F.when(F.expr(t), n) for n, t in tests.items()])
    return P.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", errors.alias("errors")).where("errors <> ''")


@query("saf_value_compatibility", "SELECT document_id, CASE WHEN contains(text, 'Ratio') AND contains(text, '$') THEN 'ratio class with dollars' WHEN contains(text, 'Capital Expenditures') AND NOT contains(text, '$') THEN 'amount class without dollars' ELSE 'compatible' END AS verdict FROM clause", "clause")
def saf_value_compatibility(spark, sf_dir):
    """Ratios and amounts want values of their kind."""
    t = F.col("text")
    rules = [(t.contains("Ratio") & t.contains("$"), "ratio class with dollars"), (t.contains("Capital Expenditures") & ~t.contains("$"), "amount class without dollars")]
    return P.clause(spark, sf_dir).select("document_id", first_match(rules, "compatible").alias("verdict"))


@query(
    "eng_identity_confidence",
    """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 20 THEN 0.90 WHEN l_quantity < 30 THEN 0.85 ELSE 0.0 END AS base, l_discount < 0.05 AS alias_hit, l_tax < 0.04 AS text_hit, l_linenumber < 4 AS hint FROM lineitem),
c AS (SELECT *, CASE WHEN base = 0 AND NOT alias_hit THEN 0.0 WHEN base = 0 THEN 0.30 ELSE least(0.95, base + CASE WHEN alias_hit THEN 0.05 ELSE 0 END) END AS c1 FROM s),
d AS (SELECT *, CASE WHEN c1 = 0 THEN 0 ELSE least(0.95, least(0.95, c1 + CASE WHEN text_hit THEN 0.03 ELSE 0 END) + CASE WHEN hint THEN 0.02 ELSE 0 END) END AS c2 FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(c2 * 100) AS INTEGER) AS percent, CASE WHEN round(c2 * 100) >= 85 THEN 'SUFFICIENT' WHEN round(c2 * 100) >= 70 THEN 'CORROBORATED' WHEN round(c2 * 100) >= 50 THEN 'WEAK' ELSE 'INSUFFICIENT' END AS level FROM d""",
)
def eng_identity_confidence(spark, sf_dir):
    """Signals add up to a confidence in hundredths, capped at 95 after each; without a candidate it stays 0."""
    q = F.col("l_quantity")
    base = F.when(q < 20, 90).when(q < 30, 85).otherwise(0)
    alias = F.col("l_discount") < 0.05
    cap = lambda c: F.least(F.lit(95), c)
    plus = lambda test, n: F.when(test, n).otherwise(0)
    one = F.when((base == 0) & ~alias, 0).when(base == 0, 30).otherwise(cap(base + plus(alias, 5)))
    two = F.when(one == 0, 0).otherwise(cap(cap(one + plus(F.col("l_tax") < 0.04, 3)) + plus(F.col("l_linenumber") < 4, 2)))
    level = first_match([(two >= 85, "SUFFICIENT"), (two >= 70, "CORROBORATED"), (two >= 50, "WEAK")], "INSUFFICIENT")
    return P.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", two.cast("int").alias("percent"), level.alias("level"))


ALL_FIELDS = ("action", "deadline", "frequency", "operator", "party", "rate", "scope", "status", "subject", "threshold", "unit")
AFFECTED = {"REPLACE_VALUE": ("threshold", "unit"), "ADD": ("scope",), "UNRESOLVED": ()}


@query(
    "eng_preserved_fields",
    """
SELECT DISTINCT instruction_type, CASE instruction_type WHEN 'REPLACE_VALUE' THEN 'SCALAR_REPLACEMENT' WHEN 'ADD' THEN 'EXCEPTION_EXPANSION' ELSE 'NONE' END AS family,
  array_to_string(list_filter(['action','deadline','frequency','operator','party','rate','scope','status','subject','threshold','unit'], lambda f: NOT list_contains(CASE instruction_type WHEN 'REPLACE_VALUE' THEN ['threshold','unit'] WHEN 'ADD' THEN ['scope'] ELSE [] END, f)), ',') AS preserved
FROM amendment_instruction""",
    "amendment_instruction",
)
def eng_preserved_fields(spark, sf_dir):
    """Family, affected and therefore preserved fields of an instruction type."""
    kind = F.col("instruction_type")
    everything = F.array(*map(F.lit, ALL_FIELDS))
    preserved = everything
    for name, fields in AFFECTED.items():
        preserved = F.when(kind == name, F.array_except(everything, F.array(*map(F.lit, fields)).cast("array<string>"))).otherwise(preserved)
    family = first_match([(kind == "REPLACE_VALUE", "SCALAR_REPLACEMENT"), (kind == "ADD", "EXCEPTION_EXPANSION")], "NONE")
    return P.amendment_instruction(spark, sf_dir).select("instruction_type").distinct().select("instruction_type", family.alias("family"), F.array_join(preserved, ",").alias("preserved"))


@query(
    "eng_authorisation_step",
    """
SELECT amendment_version_id, instruction_order, CASE WHEN instruction_type = 'UNRESOLVED' THEN 'family' WHEN old_value > 48 THEN 'identity' WHEN status <> 'APPLIED' THEN 'predecessor_lookup' WHEN new_value < 3000 THEN 'old_value' WHEN parser_confidence < 0.93 THEN 'provenance' ELSE 'authorized' END AS step FROM amendment_instruction""",
    "amendment_instruction",
)
def eng_authorisation_step(spark, sf_dir):
    """The step at which an authorisation is refused, or that it isn't."""
    rules = [("instruction_type = 'UNRESOLVED'", "family"), ("old_value > 48", "identity"), ("status <> 'APPLIED'", "predecessor_lookup"), ("new_value < 3000", "old_value"), ("parser_confidence < 0.93", "provenance")]
    step = first_match([(F.expr(t), n) for t, n in rules], "authorized")
    return P.amendment_instruction(spark, sf_dir).select("amendment_version_id", "instruction_order", step.alias("step"))


@query(
    "cls_failure_category",
    """
WITH c AS (SELECT amendment_version_id, bool_or(instruction_type = 'UNRESOLVED') AS parse, bool_or(status <> 'APPLIED') AS apply, bool_or(parser_confidence < 0.91) AS doubt FROM amendment_instruction GROUP BY 1)
SELECT amendment_version_id, CASE WHEN CAST(parse AS INT) + CAST(apply AS INT) + CAST(doubt AS INT) > 1 THEN 'MULTIPLE' WHEN parse THEN 'PARSE' WHEN apply THEN 'APPLY' WHEN doubt THEN 'DOUBT' ELSE 'NONE' END AS category FROM c""",
    "amendment_instruction",
)
def cls_failure_category(spark, sf_dir):
    """One category per chain, MULTIPLE where several apply."""
    flags = {"PARSE": "instruction_type = 'UNRESOLVED'", "APPLY": "status <> 'APPLIED'", "DOUBT": "parser_confidence < 0.91"}
    c = P.amendment_instruction(spark, sf_dir).groupBy("amendment_version_id").agg(*[F.bool_or(F.expr(t)).alias(n) for n, t in flags.items()])
    some = F.array_compact(F.array(*[F.when(F.col(n), n) for n in flags]))
    return c.select("amendment_version_id", F.when(F.size(some) > 1, "MULTIPLE").otherwise(F.coalesce(F.get(some, F.lit(0)), F.lit("NONE"))).alias("category"))


@query(
    "led_chain_rows",
    """
SELECT amendment_version_id, CAST(count(*) AS BIGINT) AS candidates, CAST(count(*) FILTER (status = 'APPLIED') AS BIGINT) AS applied, round(sum(new_value), 2) AS exposure, max(instruction_order) AS last_order,
  CASE WHEN count(*) FILTER (instruction_type = 'UNRESOLVED') > 0 THEN 'parse' WHEN count(*) FILTER (status <> 'APPLIED') > 0 THEN 'apply' ELSE 'none' END AS first_failure FROM amendment_instruction GROUP BY 1""",
    "amendment_instruction",
)
def led_chain_rows(spark, sf_dir):
    """The ledger: one row per chain with its counts and where it failed first."""
    i = P.amendment_instruction(spark, sf_dir)
    failure = first_match([(F.count_if(F.col("instruction_type") == "UNRESOLVED") > 0, "parse"), (F.count_if(F.col("status") != "APPLIED") > 0, "apply")], "none")
    return i.groupBy("amendment_version_id").agg(
        F.count("*").alias("candidates"), F.count_if(F.col("status") == "APPLIED").alias("applied"), F.round(F.sum("new_value"), 2).alias("exposure"), F.max("instruction_order").alias("last_order"), failure.alias("first_failure")
    )
