"""Safety checks on candidate changes: is the value of the target's kind, is the target the one that the section names, does the old value hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import projections as P
from ..functions import legal as L
from ..registry import query
from .gates import first_match
from .registries import PERCENT_CLASSES, matching_entries, REGISTRY

# What kind of value a class's threshold is.
DOLLAR_CLASSES = ("financial_covenant.tangible_net_worth", "financial_covenant.fixed_charge_coverage")
RATIO_CLASSES = ("financial_covenant.leverage_ratio", "financial_covenant.debt_service_coverage", "financial_covenant.interest_coverage", "financial_covenant.current_ratio")
FACILITY = "facility."
PASS, FAIL, NOT_APPLICABLE = "PASS", "FAIL", "NOT_APPLICABLE"


def _verdict(applies: Column, passes: Column) -> Column:
    return F.when(~F.coalesce(applies, F.lit(False)), NOT_APPLICABLE).when(F.coalesce(passes, F.lit(False)), PASS).otherwise(FAIL)


def section_class(section_ref: Column) -> Column:
    """The class that a section stands for; null for none."""
    first = F.get(matching_entries(F.lit(None).cast("string"), section_ref), F.lit(0))
    return F.get(F.array(*[F.lit(c) for _, c, _ in REGISTRY]), first)


def check_candidates(candidates: DataFrame) -> DataFrame:
    """``candidates`` with value_compatible, same_kind, section_consistent, section_corroborates, old_value (PASS, FAIL or NOT_APPLICABLE), level, reason, completeness,
    validity and is_safe.

    Columns: canonical_id, field, operation, text, section_ref, confidence, new_value (text), value_kind (number, text, or schedule), declared_old, current (text; null without
    such a commitment or value).
    """
    c = F.col
    target, field, text = c("canonical_id"), c("field"), c("text")
    facility = target.startswith(FACILITY)
    dollars, percent, ratio = L.dollar_amount(text).isNotNull(), L.new_percentage(text).isNotNull(), L.ratio_threshold(text).isNotNull()
    schedule = L.step_down_schedule(text).isNotNull()
    # a schedule has several thresholds: one number doesn't stand for it
    ratio_fits = F.when(schedule, c("value_kind") == "schedule").otherwise(ratio)
    fits = F.when(facility, dollars).when(target.isin(*DOLLAR_CLASSES), ratio | dollars).when(target.isin(*PERCENT_CLASSES), percent).otherwise(ratio_fits)
    known = facility | target.isin(*DOLLAR_CLASSES, *PERCENT_CLASSES, *RATIO_CLASSES)
    by_section = section_class(c("section_ref"))
    structural = (c("operation") == "ADD") & field.isin("exceptions", "party")
    checks = {
        "value_compatible": _verdict((field == "threshold") & c("new_value").isNotNull() & (c("value_kind") != "text") & known, fits),
        "same_kind": _verdict((field == "threshold") & facility, ~text.rlike(L.ANY_RATIO)),
        "section_consistent": _verdict(by_section.isNotNull(), by_section == target),
        "section_corroborates": _verdict(structural, by_section == target),
        "old_value": _verdict(c("declared_old").isNotNull() & c("current").isNotNull() & ~field.isin("exceptions", "party"), c("declared_old") == c("current")),
    }
    checked = candidates.withColumns(checks)
    reasons = {
        "section_consistent": "section contradicts alias",
        "same_kind": "text contains cross-type evidence",
        "value_compatible": "value extraction incompatible with target field",
        "section_corroborates": "section does not corroborate structural amendment target",
    }
    against = F.concat_ws("; ", *[F.when(c(name) == FAIL, words) for name, words in reasons.items()])
    weak, same = c("confidence") <= 0.60, F.coalesce(by_section == target, F.lit(False))
    level = first_match([(weak & same, "CORROBORATED"), (weak, "WEAK"), (against != "", "INSUFFICIENT")], "SUFFICIENT")
    reason = F.when(weak & same, "section-only match with section corroboration").when(weak, "section-only match without corroboration").when(against != "", against).otherwise("alias match with compatible evidence")
    filled = lambda n: F.coalesce(c(n), F.lit("")) != ""
    complete = filled("canonical_id") & filled("field") & c("new_value").isNotNull() & filled("text")
    any_fail = F.array_contains(F.array(*map(c, checks)), FAIL)
    validity = F.when(~complete, "INDETERMINATE").when(any_fail, "INVALID").when(c("level").isin("SUFFICIENT", "CORROBORATED"), "VALID").otherwise("INDETERMINATE")
    graded = checked.withColumns({"level": level, "reason": reason}).withColumns({"completeness": F.when(complete, "COMPLETE").otherwise("INCOMPLETE"), "validity": validity})
    return graded.withColumn("is_safe", (c("completeness") == "COMPLETE") & (c("validity") == "VALID"))


#: Test texts ({n}: a digit), and by hand what they hold: ratio (added to n), dollars (times n), percent (added to n), maturity date, steps, steady threshold (added to n), any ratio.
_TEXTS = (
    ("The ratio shall not exceed {n}.25 to 1.00.", 0.25, None, None, None, 0, None, True),
    ("A Leverage Ratio of {n}.50:1.00 is set.", 0.5, None, None, None, 0, None, True),
    ("Not exceeding anything, {n}.75 to 1.00 applies.", None, None, None, None, 0, None, True),
    ("The Revolving Commitment is increased to ${n} million.", None, 1000000, None, None, 0, None, False),
    ("The facility of ${n},500 is replaced by ${n} billion.", None, 1000000000, None, None, 0, None, False),
    ("Amounts up to ${n},000,000.50 are permitted.", None, 1000000, None, None, 0, None, False),
    ("The Applicable Rate of 3.00% is amended to {n}.5%.", None, None, 0.5, None, 0, None, False),
    ("A margin of {n} % is paid.", None, None, 0.0, None, 0, None, False),
    ("Margins of 1% and {n}% are paid.", None, None, None, None, 0, None, False),
    ("The Maturity Date of June 30, 2024 is extended to December 3{n2}, 2025.", None, None, None, "2025-12-3{n2}", 0, None, False),
    ("It began on May 1, 2020. The Maturity Date is March 1{n}, 2031.", None, None, None, "2031-03-1{n}", 0, None, False),
    ("The Maturity Date moves from May 1, 2020 or June 1, 2021.", None, None, None, None, 0, None, False),
    ("(i) ending on June 30, 2023 to exceed {n}.00 to 1.00, (ii) ending on September 30, 2023 to exceed {n}.25 to 1.00, and for any quarter ending thereafter, to exceed {n}.50 to 1.00.", None, None, None, None, 2, 0.5, True),
    ("(i) ending on Smarch 30, 2023 to exceed {n}.00 to 1.00.", None, None, None, None, 0, None, True),
    ("", None, None, None, None, 0, None, False),
)


def _sql_value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


P.SQL["legal_text"] = (
    "SELECT o_orderkey AS document_id, o_custkey % 9 + 1 AS n, t.k, replace(replace(t.template, '{n}', CAST(o_custkey % 9 + 1 AS VARCHAR)), '{n2}', CAST(o_custkey % 2 AS VARCHAR)) AS text, t.ratio_plus, t.dollar_times, t.percent_plus,"
    " replace(replace(t.maturity, '{n}', CAST(o_custkey % 9 + 1 AS VARCHAR)), '{n2}', CAST(o_custkey % 2 AS VARCHAR)) AS maturity, t.steps, t.steady_plus, t.any_ratio FROM orders JOIN (VALUES "
    + ", ".join("(" + ", ".join(map(_sql_value, (k, *row))) + ")" for k, row in enumerate(_TEXTS))
    + f") t(k, template, ratio_plus, dollar_times, percent_plus, maturity, steps, steady_plus, any_ratio) ON t.k = o_orderkey % {len(_TEXTS)}"
)


def legal_text(spark, sf_dir) -> DataFrame:
    n = (F.col("o_custkey") % 9 + 1).cast("string")
    template = F.get(F.array(*[F.lit(t[0]) for t in _TEXTS]), (F.col("o_orderkey") % len(_TEXTS)).cast("int"))
    text = F.replace(F.replace(template, F.lit("{n}"), n), F.lit("{n2}"), (F.col("o_custkey") % 2).cast("string"))
    return P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), text.alias("text"), "o_custkey")


@query(
    "scl_legal_values",
    """
SELECT document_id, CAST(n + ratio_plus AS DOUBLE) AS ratio, CAST(n * dollar_times AS BIGINT) AS dollars, CAST(n + percent_plus AS DOUBLE) AS percent, maturity, CASE WHEN steps > 0 OR steady_plus IS NOT NULL THEN CAST(steps AS INTEGER) END AS steps,
  CAST(n + steady_plus AS DOUBLE) AS steady, CASE WHEN steps = 2 THEN '2023-06-30' END AS first_end FROM legal_text""",
    "legal_text",
)
def scl_legal_values(spark, sf_dir):
    """The values in legal wording. The SQL knows what was written into each text."""
    t, s = F.col("text"), L.step_down_schedule(F.col("text"))
    return legal_text(spark, sf_dir).select(
        "document_id",
        L.ratio_threshold(t).alias("ratio"),
        L.dollar_amount(t).alias("dollars"),
        L.new_percentage(t).alias("percent"),
        L.maturity_date(t).alias("maturity"),
        F.when(s.isNotNull(), F.size(s["steps"])).alias("steps"),
        s["steady"].alias("steady"),
        F.get(s["steps"], F.lit(0))["period_end"].alias("first_end"),
    )


#: Test candidates, from the columns of an order: expressions that both engines read.
_CANDIDATE = {
    "canonical_id": "CASE o_custkey % 6 WHEN 0 THEN 'facility.revolving_facility' WHEN 1 THEN 'financial_covenant.tangible_net_worth' WHEN 2 THEN 'financial_covenant.texas_ratio' WHEN 3 THEN 'financial_covenant.leverage_ratio' WHEN 4 THEN 'other.thing' END",
    "field": "CASE WHEN o_custkey % 7 = 0 THEN 'exceptions' WHEN o_custkey % 7 = 1 THEN 'deadline' ELSE 'threshold' END",
    "operation": "CASE WHEN o_custkey % 2 = 0 THEN 'ADD' ELSE 'REPLACE_VALUE' END",
    "section_ref": "CASE o_custkey % 5 WHEN 0 THEN 'Section 7.10' WHEN 1 THEN 'Section 2.01' WHEN 2 THEN 'Section 7.15(b)' WHEN 3 THEN 'Section 99.9' END",
    "confidence": "CASE WHEN o_custkey % 4 = 0 THEN 0.6 ELSE 0.95 END",
    "new_value": "CASE WHEN o_custkey % 11 <> 0 THEN '1' END",
    "value_kind": "CASE WHEN o_custkey % 8 = 0 THEN 'text' WHEN o_custkey % 8 = 1 THEN 'schedule' ELSE 'number' END",
    "declared_old": "CASE WHEN o_custkey % 3 = 0 THEN 'a' END",
    "current": "CASE o_custkey % 10 WHEN 0 THEN 'a' WHEN 1 THEN NULL ELSE 'b' END",
}


@query(
    "saf_candidate_checks",
    "WITH c AS (SELECT t.*, " + ", ".join(f"{sql} AS {name}" for name, sql in _CANDIDATE.items()) + """ FROM legal_text t JOIN orders ON o_orderkey = t.document_id),
s AS (SELECT *, canonical_id LIKE 'facility.%' AS facility, CASE section_ref WHEN 'Section 7.10' THEN 'financial_covenant.leverage_ratio' WHEN 'Section 2.01' THEN 'facility.revolving_facility' WHEN 'Section 7.15(b)' THEN 'financial_covenant.tangible_net_worth' END AS by_section,
  steps > 0 OR steady_plus IS NOT NULL AS schedule FROM c),
k AS (SELECT *, CASE WHEN coalesce(field = 'threshold' AND new_value IS NOT NULL AND value_kind <> 'text' AND canonical_id <> 'other.thing', false) THEN
    CASE WHEN CASE WHEN facility THEN dollar_times IS NOT NULL WHEN canonical_id LIKE '%net_worth' THEN ratio_plus IS NOT NULL OR dollar_times IS NOT NULL WHEN canonical_id LIKE '%texas%' THEN percent_plus IS NOT NULL
      WHEN schedule THEN value_kind = 'schedule' ELSE ratio_plus IS NOT NULL END THEN 'PASS' ELSE 'FAIL' END ELSE 'NOT_APPLICABLE' END AS value_compatible,
  CASE WHEN coalesce(field = 'threshold' AND facility, false) THEN CASE WHEN any_ratio THEN 'FAIL' ELSE 'PASS' END ELSE 'NOT_APPLICABLE' END AS same_kind,
  CASE WHEN by_section IS NULL THEN 'NOT_APPLICABLE' WHEN by_section IS NOT DISTINCT FROM canonical_id THEN 'PASS' ELSE 'FAIL' END AS section_consistent,
  CASE WHEN operation = 'ADD' AND field = 'exceptions' THEN CASE WHEN by_section = canonical_id THEN 'PASS' ELSE 'FAIL' END ELSE 'NOT_APPLICABLE' END AS section_corroborates,
  CASE WHEN declared_old IS NOT NULL AND "current" IS NOT NULL AND field <> 'exceptions' THEN CASE WHEN declared_old = "current" THEN 'PASS' ELSE 'FAIL' END ELSE 'NOT_APPLICABLE' END AS old_value FROM s),
r AS (SELECT *, concat_ws('; ', CASE WHEN section_consistent = 'FAIL' THEN 'section contradicts alias' END, CASE WHEN same_kind = 'FAIL' THEN 'text contains cross-type evidence' END,
  CASE WHEN value_compatible = 'FAIL' THEN 'value extraction incompatible with target field' END, CASE WHEN section_corroborates = 'FAIL' THEN 'section does not corroborate structural amendment target' END) AS against FROM k),
e AS (SELECT *, CASE WHEN confidence <= 0.6 THEN CASE WHEN by_section = canonical_id THEN 'CORROBORATED' ELSE 'WEAK' END WHEN against <> '' THEN 'INSUFFICIENT' ELSE 'SUFFICIENT' END AS level,
  CASE WHEN confidence <= 0.6 THEN CASE WHEN by_section = canonical_id THEN 'section-only match with section corroboration' ELSE 'section-only match without corroboration' END WHEN against <> '' THEN against ELSE 'alias match with compatible evidence' END AS reason,
  canonical_id IS NOT NULL AND new_value IS NOT NULL AND text <> '' AS complete FROM r)
SELECT document_id, value_compatible, same_kind, section_consistent, section_corroborates, old_value, level, reason, CASE WHEN complete THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS completeness,
  CASE WHEN NOT complete THEN 'INDETERMINATE' WHEN 'FAIL' IN (value_compatible, same_kind, section_consistent, section_corroborates, old_value) THEN 'INVALID' WHEN level IN ('SUFFICIENT', 'CORROBORATED') THEN 'VALID' ELSE 'INDETERMINATE' END AS validity,
  complete AND NOT 'FAIL' IN (value_compatible, same_kind, section_consistent, section_corroborates, old_value) AND level IN ('SUFFICIENT', 'CORROBORATED') AS is_safe FROM e""",
    "legal_text",
)
def saf_candidate_checks(spark, sf_dir):
    """All safety checks of a candidate, its evidence, and whether it is safe."""
    rows = legal_text(spark, sf_dir).select("document_id", "text", *(F.expr(sql).alias(name) for name, sql in _CANDIDATE.items()))
    names = ("value_compatible", "same_kind", "section_consistent", "section_corroborates", "old_value", "level", "reason", "completeness", "validity", "is_safe")
    return check_candidates(rows).select("document_id", *names)
