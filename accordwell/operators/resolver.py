"""From a parsed instruction to a candidate change in ten steps, which stop at the first that fails and leave a trace.

1 target, 2 commitment in force, 3 field, 4 values, 5 unit, 6 operation, 7 candidate, 8 obligations and safety, 9 mapped, 10 unresolved.

Steps are columns; the registries give the target by one projection and an equi-join with the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import projections as P
from ..functions import legal as L
from ..functions.text import plain_spaces
from ..registry import query
from .registries import class_unit, resolve_mentions
from .safety import check_candidates

# The wordings that tell the field, in the order in which they are tried, and those of old values and exceptions.
NEW_COMMITMENT = r"(?i)is\s+hereby\s+(?:added|amended)|shall\s+mean|is\s+amended\s+to\s+read"
EXCEPTION = r"(?i)notwithstanding|shall\s+not\s+apply|except\s+(?:that|as)\b"
PARTY = r"(?i)\b(Guarantor|Borrower|Lender)\b"
FIELD_WORDINGS = (
    ("deadline", r"(?i)maturity\s+date"),
    ("rate", r"(?i)applicable\s+(?:rate|margin)"),
    ("threshold", r"\$\s*[\d,]+"),
    ("threshold", r"(?i)to\s+1\.00|:1\.00|not\s+to\s+exceed"),
    ("percent", r"\d+(?:\.\d+)?\s*%"),
    ("exceptions", EXCEPTION),
    ("party", r"(?i)shall\s+become\s+a\s+party|is\s+hereby\s+released|is\s+hereby\s+added\s+as"),
)
AMOUNT = r"(?i)\$\s*[\d,]+(?:\.\d+)?(?:\s*(?:million|billion))?"
OLD_RATIO = (r"(?i)from\s+([\d.]+)\s*(?:to\s+|:)\s*1\.00\s+to\s+[\d.]+", r"(?i)of\s+([\d.]+)\s*(?:to\s+|:)\s*1\.00")
OLD_RATE, OLD_DATE = r"(?i)from\s+([\d.]+)\s*%", r"(?i)from\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4})"
LIST_FIELDS = ("exceptions", "party")
DELETES, REPLACES = ("DELETE", "DELETE_COMMITMENT"), ("REPLACE_VALUE", "REPLACE_TEXT")
STEPS = ("target", "commitment", "field", "values", "unit", "operation", "candidate", "validation", "mapped")


def target_field(text: Column, target: Column, hint: Column) -> Column:
    """The field that a text changes: by its wording, else the hint. A percentage is a rate for a facility, else a threshold."""
    percent = F.when(target.startswith("facility."), "rate").otherwise("threshold")
    return F.coalesce(*[F.when(text.rlike(p), percent if name == "percent" else F.lit(name)) for name, p in FIELD_WORDINGS], hint)


def number_text(value: Column) -> Column:
    """A number as text that reads the same in every engine: without zeros after its last other digit."""
    return F.when(value.isNotNull(), F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", ""))


def new_value(text: Column, field: Column, target: Column) -> Column:
    """The new value as text; null where the text has none or several that can't be told apart."""
    schedule = L.step_down_schedule(text)
    stepped = F.coalesce(schedule["steady"], F.element_at(F.filter(schedule["steps"], lambda s: s["threshold"].isNotNull()), -1)["threshold"])
    dollars = L.dollar_amount(text).cast("double")
    single = F.when(F.size(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0))) == 1, dollars)
    covenant = F.when(schedule.isNotNull(), stepped).otherwise(F.coalesce(L.ratio_threshold(text), L.new_percentage(text), dollars))
    sentence = F.get(F.filter(F.split(text, r"(?<=[.])\s+"), lambda s: s.rlike(EXCEPTION)), F.lit(0))
    return (
        F.when(field == "threshold", number_text(F.when(target.startswith("facility."), single).otherwise(covenant)))
        .when(field == "rate", number_text(L.new_percentage(text)))
        .when(field == "deadline", L.maturity_date(text))
        .when(field == "exceptions", F.trim(sentence))
        .when(field == "party", F.lower(L.part(text, PARTY)))
    )


def old_value(text: Column, field: Column, target: Column) -> Column:
    """The value that a text says held before, if it does."""
    ratio = F.coalesce(*[L.part(text, p).try_cast("double") for p in OLD_RATIO])
    return (
        F.when((field == "threshold") & ~target.startswith("facility."), number_text(ratio))
        .when(field == "rate", number_text(L.part(text, OLD_RATE).try_cast("double")))
        .when(field == "deadline", L.written_date(L.part(text, OLD_DATE)))
    )


def value_in_source(value: Column, text: Column) -> Column:
    """A number is in the text in one of its spellings (4.5, 4.50, 4.0, 4; from 1000 on also without commas); other values of more than five characters stand there as they are."""
    number = value.try_cast("double")
    spelled = F.array(value, F.format_string("%.2f", number), F.format_string("%.1f", number))
    found = F.exists(spelled, lambda s: text.contains(s)) | ((number > 1000) & F.replace(text, F.lit(","), F.lit("")).contains(number.cast("decimal(38,0)").cast("string")))
    return F.when(number.isNotNull(), found).otherwise((F.length(value) <= 5) | text.contains(value))


def resolve_instructions(instructions: DataFrame, state: DataFrame) -> DataFrame:
    """``instructions`` (mention_id, agreement_id, text, section_ref, instruction_type) with canonical_id, field, operation, new_value, old_value, unit, confidence, failed_step (0: none), reason and trace.

    ``state``: agreement_id, canonical_key and fields (a map). The trace has a row for each step up to the last one taken: its name, whether it passed, and what it found.
    Null texts resolve by their section at most and fail at the values.
    """
    c = F.col
    named = resolve_mentions(instructions, state.select("agreement_id", "canonical_key"))
    current = state.select("agreement_id", c("canonical_key").alias("canonical_id"), c("fields").alias("held")).dropDuplicates(["agreement_id", "canonical_id"])
    known = named.join(current, ["agreement_id", "canonical_id"], "left").withColumn("t", plain_spaces(F.coalesce("text", F.lit(""))))
    t, kind = c("t"), c("instruction_type")
    seen = known.withColumn("field", target_field(t, c("canonical_id"), c("field_hint")))
    valued = seen.withColumns({"new_value": new_value(t, c("field"), c("canonical_id")), "old_value": old_value(t, c("field"), c("canonical_id"))})
    replaces = kind.isin(*REPLACES)
    operation = F.when(c("field").isin(*LIST_FIELDS) & (replaces | (kind == "RESTATE_SECTION")), "ADD").when(kind == "RESTATE_SECTION", "REPLACE_VALUE").otherwise(kind)
    unit = F.when(c("field") == "deadline", "date").when(c("field") == "rate", "percent").when(c("field").isin(*LIST_FIELDS), None).otherwise(class_unit(c("canonical_id")))
    now = F.try_element_at("held", c("field"))
    made = valued.withColumns({"operation": operation, "unit": unit, "current": now})
    number = c("new_value").try_cast("double").isNotNull() & (c("field") != "deadline")
    checked = check_candidates(made.withColumns({"value_kind": F.when(number, "number").otherwise("text"), "declared_old": c("old_value"), "raw": c("text"), "text": t}))
    numeric = lambda x: x.try_cast("double")
    # "old_value" is now a verdict of the checks; the value itself is declared_old
    differs = F.coalesce(F.when(numeric(c("declared_old")).isNotNull() & numeric(c("current")).isNotNull(), numeric(c("declared_old")) != numeric(c("current"))).otherwise(c("declared_old") != c("current")), F.lit(False))
    obligation = (
        F.when(c("held").isNull() & (c("operation") != "ADD"), "target_not_in_state")
        .when(c("field").isin(*LIST_FIELDS) & c("operation").isin(*REPLACES), "replace_on_list_field")
        .when(~c("field").isin(*LIST_FIELDS) & differs, "old_value_mismatch")
        .when(~value_in_source(c("new_value"), t), "new_value_not_in_source")
    )
    safe = F.when(~c("is_safe"), F.concat(F.lit("unsafe: "), F.lower("validity")))
    missing = c("held").isNull() & (kind != "ADD") & ~t.rlike(NEW_COMMITMENT)
    fails = [
        F.when(kind.isin(*DELETES), "delete_requires_manual_review").when(c("canonical_id").isNull(), "unknown_commitment"),
        F.when(missing, "unknown_commitment"),
        F.when(c("field").isNull(), "unknown_field"),
        F.when(c("new_value").isNull(), "ambiguous_value"),
        F.lit(None).cast("string"),
        F.lit(None).cast("string"),
        F.lit(None).cast("string"),
        F.coalesce(obligation, safe),
        F.lit(None).cast("string"),
    ]
    details = [c("canonical_id"), F.when(c("held").isNull(), "new").otherwise("in force"), c("field"), c("new_value"), c("unit"), c("operation"), c("canonical_id"), F.col("level"), F.lit("mapped")]
    failed = F.coalesce(*[F.when(f.isNotNull(), k) for k, f in enumerate(fails, 1)], F.lit(0))
    reasons = F.coalesce(*fails)
    judged = checked.withColumns({"failed_step": failed, "reason": reasons})
    rows = [F.struct(F.lit(n).alias("step"), f.isNull().alias("passed"), F.coalesce(f, d).alias("detail")) for n, f, d in zip(STEPS, fails, details)]
    last = F.when(c("failed_step") == 0, len(STEPS)).otherwise(c("failed_step"))
    trace = F.concat(F.slice(F.array(*rows), F.lit(1), last), F.when(c("failed_step") > 0, F.array(F.struct(F.lit("unresolved").alias("step"), F.lit(True).alias("passed"), c("reason").alias("detail")))).otherwise(F.array().cast("array<struct<step: string, passed: boolean, detail: string>>")))
    ok = lambda x, k: F.when((c("failed_step") == 0) | (c("failed_step") > k), x)
    return judged.select(
        "mention_id",
        "agreement_id",
        ok(c("canonical_id"), 1).alias("canonical_id"),
        ok(c("field"), 3).alias("field"),
        ok(c("operation"), 6).alias("operation"),
        ok(c("new_value"), 4).alias("new_value"),
        ok(c("declared_old"), 4).alias("old_value"),
        ok(c("unit"), 5).alias("unit"),
        F.when(c("failed_step") == 0, c("confidence")).otherwise(0.0).alias("confidence"),
        "failed_step",
        "reason",
        trace.alias("trace"),
    )


# Test instructions, and by hand what comes of them where their target is in force: text, section, type, target, field, operation, new value, old value, failed step, reason.
_CASES = (
    ("the Total Leverage Ratio shall not exceed 4.50 to 1.00", None, "REPLACE_VALUE", "financial_covenant.leverage_ratio", "threshold", "REPLACE_VALUE", "4.5", None, 0, None),
    ("the Total Leverage Ratio goes from 4.00 to 1.00 to 3.50 to 1.00, not to exceed 3.50 to 1.00", None, "REPLACE_TEXT", "financial_covenant.leverage_ratio", "threshold", "REPLACE_TEXT", "3.5", "4", 0, None),
    ("Interest Coverage Ratio is removed", None, "DELETE", None, None, None, None, None, 1, "delete_requires_manual_review"),
    ("the Total Leverage Ratio covenant is restated", None, "RESTATE_SECTION", "financial_covenant.leverage_ratio", "threshold", None, None, None, 4, "ambiguous_value"),
    ("Revolving Commitments of $5 million and $7 million", None, "REPLACE_VALUE", "facility.revolving_facility", "threshold", None, None, None, 4, "ambiguous_value"),
    ("Revolving Commitments are increased to $5 million", None, "REPLACE_VALUE", "facility.revolving_facility", "threshold", "REPLACE_VALUE", "5000000", None, 8, "new_value_not_in_source"),
    ("Revolving Commitments are increased to $75,000,000", None, "RESTATE_SECTION", "facility.revolving_facility", "threshold", "REPLACE_VALUE", "75000000", None, 0, None),
    ("Liens stay. Notwithstanding the Total Leverage Ratio, liens are permitted.", None, "REPLACE_TEXT", "financial_covenant.leverage_ratio", "exceptions", "ADD", "Notwithstanding the Total Leverage Ratio, liens are permitted.", None, 8, "unsafe: invalid"),
    ("Liens stay. Notwithstanding the Total Leverage Ratio, liens are permitted.", "Section 7.10", "REPLACE_TEXT", "financial_covenant.leverage_ratio", "exceptions", "ADD", "Notwithstanding the Total Leverage Ratio, liens are permitted.", None, 0, None),
    ("nothing of note", None, "REPLACE_VALUE", None, None, None, None, None, 1, "unknown_commitment"),
    (None, None, "REPLACE_VALUE", None, None, None, None, None, 1, "unknown_commitment"),
    ("The Maturity\xa0Date of the Revolving Commitments shall be June 30, 2027", None, "REPLACE_VALUE", "facility.revolving_facility", "deadline", "REPLACE_VALUE", "2027-06-30", None, 8, "new_value_not_in_source"),
    ("the Total Leverage Ratio shall not exceed 4.50 to 1.00", "Section 2.01", "REPLACE_VALUE", "financial_covenant.leverage_ratio", "threshold", "REPLACE_VALUE", "4.5", None, 8, "unsafe: invalid"),
)
_sql = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def resolver_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Instructions of every outcome; the threshold in force is 4 in every other agreement."""
    from .registries import in_state

    o = P.spread(P.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    k = (F.col("o_orderkey") % len(_CASES)).cast("int")
    of = lambda n: F.get(F.array(*[F.lit(c[n]).cast("string") for c in _CASES]), k)
    asked = o.select(F.col("o_orderkey").alias("mention_id"), (F.col("o_custkey") % 25).alias("agreement_id"), of(0).alias("text"), of(1).alias("section_ref"), of(2).alias("instruction_type"))
    held = in_state(spark, sf_dir).withColumn("fields", F.create_map(F.lit("threshold"), F.when(F.col("agreement_id") % 2 == 0, "4").otherwise("3")))
    return asked, held


@query(
    "res_ten_steps",
    "WITH k(n, target, field, operation, new_value, old_value, failed, why) AS (VALUES "
    + ", ".join("(" + ", ".join(map(_sql, (n, *c[3:]))) + ")" for n, c in enumerate(_CASES))
    + f"""),
s AS (SELECT DISTINCT agreement_id, canonical_key FROM in_state),
j AS (SELECT o_orderkey AS mention_id, k.*, s.canonical_key IS NULL AND failed <> 1 AS absent, coalesce(old_value = '4' AND o_custkey % 25 % 2 = 1, false) AS other FROM orders JOIN k ON k.n = o_orderkey % {len(_CASES)} LEFT JOIN s ON s.agreement_id = o_custkey % 25 AND s.canonical_key = k.target),
r AS (SELECT *, CAST(CASE WHEN absent THEN 1 WHEN other THEN 8 ELSE failed END AS INTEGER) AS failed_step, CASE WHEN absent THEN 'unknown_commitment' WHEN other THEN 'old_value_mismatch' ELSE why END AS reason FROM j)
SELECT mention_id, CASE WHEN failed_step <> 1 THEN target END AS canonical_id, CASE WHEN failed_step NOT IN (1, 3) THEN field END AS field, CASE WHEN failed_step IN (0, 8) THEN operation END AS operation, CASE WHEN failed_step IN (0, 8) THEN new_value END AS new_value,
  CASE WHEN failed_step IN (0, 8) THEN old_value END AS old_value, failed_step, reason, CAST(CASE failed_step WHEN 0 THEN 9 ELSE failed_step + 1 END AS INTEGER) AS n_trace FROM r""",
    "in_state",
)
def res_ten_steps(spark, sf_dir):
    """Every instruction's candidate, or the step at which it fails. The SQL knows what was written into each text."""
    done = resolve_instructions(*resolver_tables(spark, sf_dir))
    return done.select("mention_id", "canonical_id", "field", "operation", "new_value", "old_value", "failed_step", "reason", F.size("trace").alias("n_trace"))
