"""Six rules from an instruction's text and section to a change: the first that fires decides, with a value or without.

Every rule is a struct over the same columns, null where it doesn't fire; one projection takes the first. A rule that fires without finding its value
leaves the instruction unresolved (ambiguous value); where no rule fires the commitment is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import projections as P
from ..functions import legal as L
from ..functions.text import plain_spaces
from ..registry import query
from .resolver import EXCEPTION, PARTY, number_text

# Commitments of sections, by their beginnings in this order; the rules' wordings and what they are worth.
SECTION_COMMITMENTS = (
    ("section 7.10", "financial_covenant.leverage_ratio"),
    ("section 7.11", "financial_covenant.leverage_ratio"),
    ("section 7.01", "facility.credit_agreement"),
    ("section 7.02", "facility.credit_agreement"),
    ("section 7.03", "facility.credit_agreement"),
    ("section 6.01", "facility.credit_agreement"),
    ("section 6.02", "facility.credit_agreement"),
)
LEVERAGE, JUNIOR = r"(?i)Total Funded Debt to EBITDA|Core Leverage Ratio", r"(?i)Junior Credit Agreement"
MATURITY, RATE = r"(?i)Maturity\s+Date", r"(?i)Applicable\s+(?:Rate|Margin)"
JOINS_OR_LEAVES = r"(?i)shall\s+become\s+a\s+party|is\s+hereby\s+released|is\s+hereby\s+added\s+as"
RELEASED = r"(?i)^is\s+hereby\s+released"
CONFIDENCE = {"leverage_step_down": 0.95, "junior_agreement": 0.90, "maturity_date": 0.90, "rate": 0.85, "exception": 0.85, "party": 0.85}
AGREEMENT = "facility.credit_agreement"


def section_commitment(section_ref: Column) -> Column:
    """The commitment of a section; null for others and for none."""
    low = F.lower(F.trim(section_ref))
    return F.coalesce(*[F.when(low.startswith(s), c) for s, c in SECTION_COMMITMENTS])


def _change(rule: str, target: Column | str, field: str, operation: Column | str, new: Column | None = None, old: Column | None = None, unit: str | None = None) -> Column:
    none, literal = F.lit(None).cast("string"), lambda x: F.lit(x) if isinstance(x, str) else x
    new, old = none if new is None else new, none if old is None else old
    found = new.isNotNull() | old.isNotNull()
    return F.struct(
        literal(target).alias("commitment_id"),
        F.lit(field).alias("field"),
        literal(operation).alias("operation"),
        new.alias("new_value"),
        old.alias("old_value"),
        F.lit(unit).cast("string").alias("unit"),
        F.when(found, CONFIDENCE[rule]).otherwise(0.0).alias("confidence"),
        F.when(~found, "AMBIGUOUS_VALUE").alias("reason"),
        F.lit(rule).alias("rule"),
    )


def map_instructions(instructions: DataFrame) -> DataFrame:
    """``instructions`` (instruction_type, section_ref, text and others) with commitment_id, field, operation, new_value, old_value, unit, confidence, reason (null: mapped) and rule.

    A schedule's new value is its steps and steady threshold as JSON, a new junior agreement's is its terms. Null texts and sections count as empty.
    """
    t, ref, kind = F.col("t_"), F.col("ref_"), F.col("instruction_type")
    by_section = section_commitment(ref)
    elsewhere = ~F.coalesce(by_section.startswith("financial_covenant."), F.lit(False))
    schedule = L.step_down_schedule(t)
    steps = F.transform(schedule["steps"], lambda s: F.struct(s["period_end"].alias("period_end"), number_text(s["threshold"]).alias("threshold")))
    schedule_text = F.when(schedule.isNotNull(), F.to_json(F.struct(steps.alias("steps"), number_text(schedule["steady"]).alias("steady"))))
    amount = L.part(t, L.PLAIN_AMOUNT)
    dollars = F.split_part(F.replace(amount, F.lit(","), F.lit("")), F.lit("."), F.lit(1)).try_cast("long")
    terms = F.when(dollars.isNotNull(), F.to_json(F.struct(F.lit("facility.junior_credit_agreement").alias("canonical_key"), F.lit("facility_commitment").alias("commitment_type"), F.array(F.lit("borrower")).alias("party"), F.lit("permit").alias("action"), F.lit("junior_credit_agreement").alias("subject"), dollars.alias("threshold"), F.lit("usd").alias("unit"))))
    sentence = F.trim(F.get(F.filter(F.split(t, r"(?<=[.])\s+"), lambda s: s.rlike(EXCEPTION)), F.lit(0)))
    sentence = F.when(t.rlike(EXCEPTION), F.coalesce(sentence, F.lit("")))
    adds = kind == "ADD"
    place = F.regexp_instr(t, F.lit(JOINS_OR_LEAVES))
    after = F.substring(t, place, F.lit(2**31 - 1))
    leaves = after.rlike(RELEASED)
    role = F.lower(L.part(F.regexp_replace(after, "^(?:" + JOINS_OR_LEAVES + ")", ""), PARTY))
    rules = [
        F.when(ref.rlike(r"(?i)Section\s+7\.10") & t.rlike(LEVERAGE), _change("leverage_step_down", "financial_covenant.leverage_ratio", "applicability", "REPLACE_VALUE", schedule_text, unit="ratio")),
        F.when(ref.rlike(r"(?i)Section\s+7\.01") & t.rlike(JUNIOR), _change("junior_agreement", "facility.junior_credit_agreement", "amount", "ADD", terms, unit="usd")),
        F.when(kind.isin("REPLACE_VALUE", "REPLACE_TEXT") & t.rlike(MATURITY) & elsewhere, _change("maturity_date", AGREEMENT, "deadline", "REPLACE_VALUE", L.maturity_date(t), unit="date")),
        F.when(t.rlike(RATE) & elsewhere, _change("rate", AGREEMENT, "rate", "REPLACE_VALUE", number_text(L.new_percentage(t)), unit="percent")),
        F.when(kind.isin("ADD", "DELETE") & t.rlike(EXCEPTION) & by_section.isNotNull(), _change("exception", by_section, "exceptions", kind, F.when(adds, sentence), F.when(~adds, sentence))),
        F.when((place > 0) & role.isNotNull() & by_section.isNotNull(), _change("party", by_section, "party", F.when(leaves, "DELETE").otherwise("ADD"), F.when(~leaves, role), F.when(leaves, role))),
    ]
    none = F.lit(None).cast("string")
    unknown = F.struct(none.alias("commitment_id"), none.alias("field"), kind.alias("operation"), none.alias("new_value"), none.alias("old_value"), none.alias("unit"), F.lit(0.0).alias("confidence"), F.lit("UNKNOWN_COMMITMENT").alias("reason"), none.alias("rule"))
    read = instructions.withColumns({"t_": plain_spaces(F.coalesce("text", F.lit(""))), "ref_": plain_spaces(F.coalesce("section_ref", F.lit("")))})
    return read.withColumn("m_", F.coalesce(*rules, unknown)).select(*instructions.columns, "m_.*")


_LEVELS = "exceed Total Funded Debt to EBITDA (i) ending on June 30, 2023 to exceed 4.00 to 1.00; for any quarter ending thereafter, to exceed 3.50 to 1.00"
_TERMS = '{"canonical_key":"facility.junior_credit_agreement","commitment_type":"facility_commitment","party":["borrower"],"action":"permit","subject":"junior_credit_agreement","threshold":25000000,"unit":"usd"}'
# Test instructions, and by hand what comes of them: text, section, type; commitment, field, operation, new value, old value, reason, rule.
_CASES = (
    (_LEVELS, "Section 7.10", "REPLACE_TEXT", "financial_covenant.leverage_ratio", "applicability", "REPLACE_VALUE", '{"steps":[{"period_end":"2023-06-30","threshold":"4"}],"steady":"3.5"}', None, None, "leverage_step_down"),
    ("the Core Leverage Ratio is lower", "section 7.10(a)", "REPLACE_TEXT", "financial_covenant.leverage_ratio", "applicability", "REPLACE_VALUE", None, None, "AMBIGUOUS_VALUE", "leverage_step_down"),
    ("a Junior Credit Agreement of up to $25,000,000", "Section 7.01", "ADD", "facility.junior_credit_agreement", "amount", "ADD", _TERMS, None, None, "junior_agreement"),
    ("a Junior Credit Agreement", "Section 7.01(b)", "ADD", "facility.junior_credit_agreement", "amount", "ADD", None, None, "AMBIGUOUS_VALUE", "junior_agreement"),
    ("the Maturity Date shall be June 30, 2027", "Section 2.08", "REPLACE_VALUE", AGREEMENT, "deadline", "REPLACE_VALUE", "2027-06-30", None, None, "maturity_date"),
    ("the Maturity\xa0Date is moved", None, "REPLACE_TEXT", AGREEMENT, "deadline", "REPLACE_VALUE", None, None, "AMBIGUOUS_VALUE", "maturity_date"),
    ("the Maturity Date shall be June 30, 2027", "Section 7.11", "REPLACE_VALUE", None, None, "REPLACE_VALUE", None, None, "UNKNOWN_COMMITMENT", None),
    ("the Maturity Date shall be June 30, 2027", "Section 2.08", "RESTATE_SECTION", None, None, "RESTATE_SECTION", None, None, "UNKNOWN_COMMITMENT", None),
    ("the Applicable Margin shall be 2.50%", None, "RESTATE_SECTION", AGREEMENT, "rate", "REPLACE_VALUE", "2.5", None, None, "rate"),
    ("the Applicable Rate is 1% or 2%", "Section 7.02", "REPLACE_TEXT", AGREEMENT, "rate", "REPLACE_VALUE", None, None, "AMBIGUOUS_VALUE", "rate"),
    ("Liens stay. This shall not apply to leases. End.", "Section 6.01", "ADD", AGREEMENT, "exceptions", "ADD", "This shall not apply to leases.", None, None, "exception"),
    ("Notwithstanding the above, leases.", "SECTION 7.11(c)", "DELETE", "financial_covenant.leverage_ratio", "exceptions", "DELETE", None, "Notwithstanding the above, leases.", None, "exception"),
    ("Notwithstanding the above, leases.", "Section 9.9", "ADD", None, None, "ADD", None, None, "UNKNOWN_COMMITMENT", None),
    ("Acme shall become a party as a Guarantor", "Section 6.02", "UNRESOLVED", AGREEMENT, "party", "ADD", "guarantor", None, None, "party"),
    ("The Borrower says that Acme is hereby released as Lender", "Section 7.03", "UNRESOLVED", AGREEMENT, "party", "DELETE", None, "lender", None, "party"),
    ("The Lender is hereby released", "Section 7.03", "DELETE", None, None, "DELETE", None, None, "UNKNOWN_COMMITMENT", None),
    (None, None, "ADD", None, None, "ADD", None, None, "UNKNOWN_COMMITMENT", None),
)
_sql = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


@query(
    "map_six_rules",
    "WITH k(n, commitment_id, field, operation, new_value, old_value, reason, rule) AS (VALUES "
    + ", ".join("(" + ", ".join(map(_sql, (n, *c[3:]))) + ")" for n, c in enumerate(_CASES))
    + f") SELECT o_orderkey AS document_id, commitment_id, field, operation, new_value, old_value, CAST(CASE WHEN reason IS NOT NULL THEN 0 ELSE CASE rule WHEN 'leverage_step_down' THEN 0.95 WHEN 'junior_agreement' THEN 0.9 WHEN 'maturity_date' THEN 0.9 ELSE 0.85 END END AS DOUBLE) AS confidence, reason, rule FROM orders JOIN k ON k.n = o_orderkey % {len(_CASES)}",
)
def map_six_rules(spark, sf_dir):
    """Every instruction's change by the first rule that fires. The SQL knows what was written into each text."""
    o = P.read(spark, sf_dir, "orders")
    k = (F.col("o_orderkey") % len(_CASES)).cast("int")
    of = lambda n: F.get(F.array(*[F.lit(c[n]).cast("string") for c in _CASES]), k)
    asked = o.select(F.col("o_orderkey").alias("document_id"), of(0).alias("text"), of(1).alias("section_ref"), of(2).alias("instruction_type"))
    return map_instructions(asked).select("document_id", "commitment_id", "field", "operation", "new_value", "old_value", "confidence", "reason", "rule")
