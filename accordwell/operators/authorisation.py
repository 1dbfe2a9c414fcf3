"""From evidence in an amendment to an authorised transformation of a commitment, or the step that refuses it.

1. The target comes from the agreement's own addresses; aliases, texts and hints only add to the confidence.
2. The predecessor is the target's last version from before the amendment.
3. The instruction's type gives the family, 4. the family the affected fields, 5. evidence and predecessor their new and old values.
6. New values need a provenance, and values that a person gave must be found in the source text.
7. A declared old value must be the predecessor's.

Every step is a column over the evidence; the first that fails names the result. One join for the address, one sort for the predecessor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query
from ..storage import materialise
from .addresses import _BOOK, _book, resolve_addresses

# The fields of a commitment, the families of instruction types, families without extracted values, families whose declared old value is checked.
SEMANTIC_FIELDS = (
    "threshold", "operator", "unit", "frequency", "scope", "exceptions", "trigger", "cure", "applicability", "rate",
    "deadline", "party", "action", "subject", "modality", "valid_from", "valid_to", "status", "grace_period", "application_order",
)
FAMILY_OF_TYPE = {
    "REPLACE_VALUE": "SCALAR_REPLACEMENT",
    "REPLACE_TEXT": "SCALAR_REPLACEMENT",
    "DELETE": "TERMINATE",
    "DELETE_COMMITMENT": "TERMINATE",
    "ADD_COMMITMENT": "CREATE",
    "RESTATE_SECTION": "IDENTITY_PRESERVING_RESTATEMENT",
    "WAIVE_TEMPORARILY": "WAIVER",
    "SUSPEND": "WAIVER",
    "REINSTATE": "REINSTATEMENT",
    "RENUMBER_REFERENCE": "RENUMBER",
    "FIND_REPLACE_REFERENCE": "DEFINED_TERM_PROPAGATION",
}
NAMED_FIELD_FAMILIES = ("SCALAR_REPLACEMENT", "MULTI_FIELD_REPLACEMENT", "IDENTITY_PRESERVING_RESTATEMENT", "DEFINED_TERM_PROPAGATION")
AFFECTED_BY_FAMILY = {
    "EXCEPTION_EXPANSION": ("exceptions",),
    "EXCEPTION_CONTRACTION": ("exceptions",),
    "WAIVER": ("status", "applicability"),
    "REINSTATEMENT": ("status", "applicability"),
    "RENUMBER": (),
    "SCHEDULE_REPLACEMENT": ("applicability",),
    "TEMPORAL_STEP_CHANGE": ("applicability", "valid_from", "valid_to"),
}
CREATED_FIELDS = ("threshold", "operator", "unit")
WITHOUT_VALUES = ("WAIVER", "REINSTATEMENT", "TERMINATE", "RENUMBER")
CHECKED_OLD_VALUE = ("SCALAR_REPLACEMENT", "MULTI_FIELD_REPLACEMENT", "EXCEPTION_CONTRACTION", "SCHEDULE_REPLACEMENT", "TEMPORAL_STEP_CHANGE", "IDENTITY_PRESERVING_RESTATEMENT")
EVIDENCE = ("source_text", "section_ref", "effective_date", "instruction_type", "target_field", "new_value", "declared_old_value", "exception_text", "alias_match", "text_match", "canonical_key_hint", "value_provenance", "family_hint")
#: Hundredths: an address, and what an alias, a text and a confirmed hint add; never above the last.
ADDRESS, ALIAS, TEXT, HINT, MOST = 90, 5, 3, 2, 95


def as_of(asked: DataFrame, history: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], tie: str, n: int | None = None) -> DataFrame:
    """``asked`` with ``columns`` of the last row of ``history`` (of equal keys) whose ``order`` is smaller; null where there is none, and a flag ``found``.

    Union and carry: both tables in one sort by key and order, and the last value seen goes down to those who ask. No range join.
    Portions are as many as the rows need, whose number is ``n`` (else they are counted); a key's rows are in one of them. Of rows with equal ``order`` the one with the greatest ``tie`` counts. Null keys find nothing.
    """
    n = asked.count() + history.count() if n is None else n
    have = history.select(*keys, order, F.lit(True).alias("had_"), F.col(tie).alias("t_"), F.struct(*columns).alias("v_"))
    lost = F.col(order).isNull()
    for k in keys:
        lost = lost | F.col(k).isNull()
    # rows that find nothing whatever the history are dealt over all tasks; columns stay apart, so that those not used later aren't shuffled
    ask = asked.withColumns({"had_": F.lit(False), "deal_": F.when(lost, F.monotonically_increasing_id() % 4096)})
    one = ask.unionByName(have, allowMissingColumns=True).repartition(P.portions_of(asked.sparkSession, n), *keys, "deal_")
    carried = F.last("v_", ignorenulls=True).over(W.partitionBy(*keys, "deal_").orderBy(order, "had_", "t_").rowsBetween(W.unboundedPreceding, 0))
    seen = one.withColumn("v_", carried).where("not had_").withColumn("v_", F.when(F.col("deal_").isNull(), F.col("v_")))
    return seen.select(*asked.columns, *[F.col("v_")[c].alias(c) for c in columns], F.col("v_").isNotNull().alias("found"))


def family_of_evidence() -> Column:
    """The transformation that an instruction stands for; a schedule, steps or several fields are named by ``family_hint``. Null if none."""
    kind, exceptions = F.upper("instruction_type"), F.col("target_field") == "exceptions"
    plain = F.try_element_at(F.create_map(*[F.lit(x) for pair in FAMILY_OF_TYPE.items() for x in pair]), kind)
    adds = F.when((F.coalesce("exception_text", F.lit("")) != "") | exceptions, "EXCEPTION_EXPANSION")
    hinted = F.when(kind.isin("REPLACE_VALUE", "REPLACE_TEXT") & F.col("family_hint").isin("MULTI_FIELD_REPLACEMENT", "SCHEDULE_REPLACEMENT", "TEMPORAL_STEP_CHANGE"), F.col("family_hint"))
    return F.when(kind == "ADD", adds).when(kind.isin("DELETE", "DELETE_COMMITMENT") & exceptions, "EXCEPTION_CONTRACTION").otherwise(F.coalesce(hinted, plain))


def affected_fields(family: Column) -> Column:
    """The fields that a transformation changes, null if they can't be told."""
    names = lambda fields: F.array(*map(F.lit, fields)).cast("array<string>")
    target = F.when(F.coalesce("target_field", F.lit("")) != "", F.array("target_field"))
    fixed = F.try_element_at(F.create_map(*[x for f, fields in AFFECTED_BY_FAMILY.items() for x in (F.lit(f), names(fields))]), family)
    return (
        F.when(family.isin(*NAMED_FIELD_FAMILIES), target)
        .when(family == "CREATE", F.coalesce(target, names(CREATED_FIELDS)))
        .when(family == "TERMINATE", F.when(F.col("effective_date").isNotNull(), names(("status", "valid_to"))).otherwise(names(("status",))))
        .otherwise(fixed)
    )


def _among(name: Column, names: Sequence[str]) -> Column:
    """``isin`` as a loop over a list, whose code stays short, so that the step's method is still compiled."""
    return F.array_contains(F.array(*map(F.lit, names)), name)


def fields_unknown(family: Column) -> Column:
    """Whether ``affected_fields`` is null, without making the lists."""
    return F.when(_among(family, NAMED_FIELD_FAMILIES), F.coalesce("target_field", F.lit("")) == "").otherwise(~_among(family, ("CREATE", "TERMINATE", *AFFECTED_BY_FAMILY)))


def new_value_of(family: Column, name: Column) -> Column:
    """The value that a field gets: the evidence's for the field that it names, else what the family sets."""
    status = F.when(family == "WAIVER", "WAIVED").when(family == "REINSTATEMENT", "ACTIVE").when(family == "TERMINATE", "TERMINATED")
    rest = F.when(family == "WAIVER", '{"waived": true}').when(family == "REINSTATEMENT", "{}").when(family == "TERMINATE", F.col("effective_date").cast("string"))
    return (
        F.when(name == F.col("target_field"), F.col("new_value"))
        .when(family == "EXCEPTION_EXPANSION", F.col("exception_text"))
        .when(family.isin("WAIVER", "REINSTATEMENT", "TERMINATE"), F.when(name == "status", status).otherwise(rest))
        .otherwise(F.col("new_value"))
    )


def carried_value(family: Column) -> Column:
    """What ``new_value_of`` gives for every affected field of a family that carries values (not WITHOUT_VALUES): they all get the same."""
    return F.when((family == "EXCEPTION_EXPANSION") & ~F.col("target_field").eqNullSafe("exceptions"), F.col("exception_text")).otherwise(F.col("new_value"))


def corroborated(text: Column, value: Column) -> Column:
    """A value is in its source text; a number also in a shorter spelling, without the zeros after its point. No value is corroborated by anything."""
    short = F.regexp_replace(value, r"\.?0+$", "")
    number = value.rlike(r"^-?[0-9]+\.[0-9]+$")
    return value.isNull() | text.contains(F.when(number, short).otherwise(value))


def authorise(evidence: DataFrame, book: DataFrame, versions: DataFrame, id_column: str, carried: Sequence[str] = ()) -> DataFrame:
    """The outcome for each row of ``evidence``: where it is refused (``step``), or ``authorized`` with everything that the transformation consists of. Columns ``carried`` come along; one of them may be ``kind``, the evidence's family whether refused or not.

    ``evidence``: ``id_column``, agreement_id, amendment_number and EVIDENCE. ``book``: see ``addresses.address_book``. ``versions``: agreement_id, commitment_id,
    amendment_number, version_id and fields (a map). Steps that refuse: target_identity, predecessor_lookup, transformation_type, affected_fields, value_extraction, value_provenance, old_value_consistency.
    All that doesn't need the predecessor is judged before its sort, from plain columns; lists of values are made only where they are asked for, and texts stay behind. References, the book and resolved addresses are written once, so that they aren't made again and Spark knows their size.
    """
    c = F.col
    asked = materialise(evidence.select("agreement_id", "section_ref").distinct())
    addresses = materialise(resolve_addresses(asked, materialise(book)).drop("tier"))
    named = evidence.join(addresses, ["agreement_id", "section_ref"], "left")
    adds = lambda test, n: F.when(test, n).otherwise(0)
    confidence = F.least(F.lit(MOST), F.lit(ADDRESS) + adds(c("alias_match") != "", ALIAS) + adds(c("text_match") != "", TEXT) + adds(c("canonical_key_hint") == c("commitment_id"), HINT))
    confidence = F.when(c("commitment_id").isNotNull(), confidence).otherwise(adds(c("alias_match") != "", 30)).cast("int")
    told = named.withColumns({"kind": family_of_evidence(), "confidence": confidence})
    fields = F.transform(affected_fields(c("kind")), lambda n: F.struct(n.alias("field"), new_value_of(c("kind"), n).alias("new_value")))
    empty = carried_value(c("kind")).isNull()
    carries = ~_among(c("kind"), WITHOUT_VALUES)
    text = F.coalesce("source_text", F.lit(""))
    # UNKNOWN is a provenance for nothing but empty values, which are refused before
    known = c("value_provenance").isin("PARSER_EXTRACTED", "CURATOR_PROVIDED") & (text != "")
    provenance = F.when(known, (c("value_provenance") == "PARSER_EXTRACTED") | corroborated(text, c("new_value"))).otherwise(False)
    refusal = (
        F.when(c("kind").isNull(), "transformation_type")
        .when(fields_unknown(c("kind")), "affected_fields")
        .when(carries & empty, "value_extraction")
        .when(carries & ~provenance, "value_provenance")
    )
    unchecked = c("declared_old_value").isNull() | ~_among(c("kind"), CHECKED_OLD_VALUE) | c("target_field").isNull()
    judged = told.withColumn("refusal_", refusal)
    going = judged.select(
        id_column,
        "agreement_id",
        "amendment_number",
        "commitment_id",
        "confidence",
        "refusal_",
        *carried,
        *[F.when(c("refusal_").isNull(), x).alias(n) for n, x in {"family_": c("kind"), "set_": fields, "declared_": F.when(~unchecked, c("declared_old_value")), "checked_": F.when(~unchecked, c("target_field"))}.items()],
    )
    past = as_of(going, versions, ["agreement_id", "commitment_id"], "amendment_number", ["version_id", "fields"], "version_id", evidence.count() + versions.count())
    held, declared = F.try_element_at(c("fields"), c("checked_")), c("declared_")
    number = lambda x: x.try_cast("double")
    same = F.coalesce(F.when(number(held).isNotNull() & number(declared).isNotNull(), number(held) == number(declared)).otherwise(held == declared), F.lit(False))
    step = (
        F.when(c("commitment_id").isNull(), "target_identity")
        .when(~c("found"), "predecessor_lookup")
        .when(c("refusal_").isNotNull(), c("refusal_"))
        .when(declared.isNotNull() & ~same, "old_value_consistency")
        .otherwise("authorized")
    )
    ended = past.withColumn("step", step)
    ok = c("step") == "authorized"
    values = F.transform("set_", lambda v: F.struct(v["field"].alias("field"), F.try_element_at(c("fields"), v["field"]).alias("old_value"), v["new_value"].alias("new_value")))
    preserved = F.array_except(F.array(*map(F.lit, SEMANTIC_FIELDS)), F.transform("set_", lambda v: v["field"]))
    return ended.select(
        id_column,
        "agreement_id",
        "step",
        "confidence",
        F.when(c("step") != "target_identity", c("commitment_id")).alias("commitment_id"),
        F.when(~c("step").isin("target_identity", "predecessor_lookup"), c("version_id")).alias("predecessor"),
        F.when(ok, c("family_")).alias("family"),
        F.when(ok, values).alias("values"),
        F.when(ok, preserved).alias("preserved"),
        *carried,
    )


P.SQL["evidence"] = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS evidence_id, l_suppkey % 30 AS agreement_id, CAST(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS INTEGER) AS amendment_number,
  CASE WHEN l_partkey % 29 <> 0 THEN concat('Section 7.', CAST(l_partkey % 25 AS VARCHAR), CASE l_linenumber WHEN 1 THEN '(a)' WHEN 2 THEN '(A)' WHEN 3 THEN '(a)(i)(x)' ELSE '' END) END AS section_ref,
  CASE WHEN l_orderkey % 11 > 0 THEN concat('shall be ', CAST(CAST(l_quantity AS INTEGER) % 4 AS VARCHAR), '.50 to 1.00') END AS source_text, CASE WHEN l_orderkey % 3 > 0 THEN CAST(l_shipdate AS DATE) END AS effective_date,
  CASE l_orderkey % 12 WHEN 0 THEN 'ADD' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'ADD_COMMITMENT' WHEN 3 THEN 'RESTATE_SECTION' WHEN 4 THEN 'WAIVE_TEMPORARILY' WHEN 5 THEN 'REINSTATE' WHEN 6 THEN 'RENUMBER_REFERENCE' WHEN 7 THEN 'FIND_REPLACE_REFERENCE' WHEN 8 THEN 'UNRESOLVED' ELSE 'replace_value' END AS instruction_type,
  CASE l_partkey % 5 WHEN 0 THEN 'exceptions' WHEN 1 THEN NULL ELSE 'threshold' END AS target_field, CASE WHEN l_partkey % 7 > 0 THEN concat(CAST(CAST(l_quantity AS INTEGER) % 5 AS VARCHAR), '.5') END AS new_value,
  CASE WHEN l_suppkey % 2 = 0 THEN concat(CAST(l_partkey % 4 AS VARCHAR), '.50') END AS declared_old_value, CASE WHEN l_suppkey % 3 = 0 THEN 'investments' END AS exception_text, CASE WHEN l_tax < 0.04 THEN 'ratio' END AS alias_match, CASE WHEN l_discount < 0.05 THEN 'text' END AS text_match,
  concat('c', CAST(l_suppkey % 17 AS VARCHAR)) AS canonical_key_hint, CASE l_orderkey % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'CURATOR_PROVIDED' WHEN 2 THEN 'PARSER_EXTRACTED' ELSE CASE WHEN l_orderkey % 8 = 3 THEN 'PARSER_EXTRACTED' ELSE 'RUMOUR' END END AS value_provenance,
  CASE WHEN l_partkey % 13 = 0 THEN 'SCHEDULE_REPLACEMENT' END AS family_hint FROM lineitem"""
P.SQL["kernel_version"] = """
SELECT o_custkey % 30 AS agreement_id, concat('c', CAST(o_custkey % 17 AS VARCHAR)) AS commitment_id, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS INTEGER) AS amendment_number, o_orderkey AS version_id,
  concat(CAST(o_orderkey % 4 AS VARCHAR), '.5') AS threshold, CASE WHEN o_orderkey % 2 = 0 THEN 'liens' END AS exceptions FROM orders"""


def evidence_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Evidence of all kinds against versions of commitments under the addresses of ``map_address_book``."""
    k, p, s, n, q = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    text = lambda x: x.cast("string")
    days = lambda x: F.datediff(x, F.lit("1992-01-01"))
    kinds = ("ADD", "DELETE", "ADD_COMMITMENT", "RESTATE_SECTION", "WAIVE_TEMPORARILY", "REINSTATE", "RENUMBER_REFERENCE", "FIND_REPLACE_REFERENCE", "UNRESOLVED")
    kind = F.coalesce(F.get(F.array(*map(F.lit, kinds)), (k % 12).cast("int")), F.lit("replace_value"))
    tail = F.when(n == 1, "(a)").when(n == 2, "(A)").when(n == 3, "(a)(i)(x)").otherwise("")
    evidence = P.read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", k, n, p, s, F.to_date("l_shipdate")).alias("evidence_id"),
        (s % 30).alias("agreement_id"),
        days(F.col("l_shipdate")).alias("amendment_number"),
        F.when(p % 29 != 0, F.concat(F.lit("Section 7."), text(p % 25), tail)).alias("section_ref"),
        F.when(k % 11 > 0, F.concat(F.lit("shall be "), text(q % 4), F.lit(".50 to 1.00"))).alias("source_text"),
        F.when(k % 3 > 0, F.to_date("l_shipdate")).alias("effective_date"),
        kind.alias("instruction_type"),
        F.when(p % 5 == 0, "exceptions").when(p % 5 > 1, "threshold").alias("target_field"),
        F.when(p % 7 > 0, F.concat(text(q % 5), F.lit(".5"))).alias("new_value"),
        F.when(s % 2 == 0, F.concat(text(p % 4), F.lit(".50"))).alias("declared_old_value"),
        F.when(s % 3 == 0, "investments").alias("exception_text"),
        F.when(F.col("l_tax") < 0.04, "ratio").alias("alias_match"),
        F.when(F.col("l_discount") < 0.05, "text").alias("text_match"),
        F.concat(F.lit("c"), text(s % 17)).alias("canonical_key_hint"),
        F.when(k % 4 == 0, "UNKNOWN").when(k % 4 == 1, "CURATOR_PROVIDED").when((k % 4 == 2) | (k % 8 == 3), "PARSER_EXTRACTED").otherwise("RUMOUR").alias("value_provenance"),
        F.when(p % 13 == 0, "SCHEDULE_REPLACEMENT").alias("family_hint"),
    )
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    versions = P.read(spark, sf_dir, "orders").select(
        (c % 30).alias("agreement_id"),
        F.concat(F.lit("c"), text(c % 17)).alias("commitment_id"),
        days(F.col("o_orderdate")).alias("amendment_number"),
        o.alias("version_id"),
        F.create_map(F.lit("threshold"), F.concat(text(o % 4), F.lit(".5")), F.lit("exceptions"), F.when(o % 2 == 0, "liens")).alias("fields"),
    )
    return evidence, versions


_SETS = "CASE WHEN family = 'WAIVER' THEN CASE WHEN x = 'status' THEN 'WAIVED' ELSE '{\"waived\": true}' END WHEN family = 'REINSTATEMENT' THEN CASE WHEN x = 'status' THEN 'ACTIVE' ELSE '{}' END WHEN family = 'TERMINATE' THEN CASE WHEN x = 'status' THEN 'TERMINATED' ELSE CAST(effective_date AS VARCHAR) END"
_AUTHORISED = (
    _BOOK
    + f""", asked AS (SELECT DISTINCT agreement_id, section_ref, lower(trim(section_ref)) AS q FROM evidence WHERE section_ref <> ''),
hits AS (SELECT a.agreement_id, a.section_ref, b.commitment_id, CASE WHEN b.ref = a.section_ref THEN 1 WHEN starts_with(lower(b.ref), a.q) THEN 2 ELSE 3 END AS tier, b.old, b.seq FROM asked a JOIN book b ON b.agreement_id = a.agreement_id AND (b.ref = a.section_ref OR starts_with(lower(b.ref), a.q) OR starts_with(a.q, lower(b.ref)))),
found AS (SELECT agreement_id, section_ref, commitment_id FROM hits QUALIFY row_number() OVER (PARTITION BY agreement_id, section_ref ORDER BY tier, old, seq) = 1),
past AS (SELECT e.evidence_id, max((v.amendment_number, v.version_id)) AS m FROM evidence e JOIN found f USING (agreement_id, section_ref) JOIN kernel_version v ON v.agreement_id = e.agreement_id AND v.commitment_id = f.commitment_id AND v.amendment_number < e.amendment_number GROUP BY 1),
j AS (SELECT e.*, f.commitment_id, v.version_id, v.threshold, v.exceptions FROM evidence e LEFT JOIN found f USING (agreement_id, section_ref) LEFT JOIN past USING (evidence_id) LEFT JOIN kernel_version v ON v.version_id = m[2]),
k AS (SELECT *, CASE WHEN instruction_type = 'ADD' THEN CASE WHEN exception_text <> '' OR target_field = 'exceptions' THEN 'EXCEPTION_EXPANSION' END WHEN instruction_type = 'DELETE' THEN CASE WHEN target_field = 'exceptions' THEN 'EXCEPTION_CONTRACTION' ELSE 'TERMINATE' END WHEN instruction_type = 'replace_value' THEN coalesce(family_hint, 'SCALAR_REPLACEMENT')
  WHEN instruction_type = 'ADD_COMMITMENT' THEN 'CREATE' WHEN instruction_type = 'RESTATE_SECTION' THEN 'IDENTITY_PRESERVING_RESTATEMENT' WHEN instruction_type = 'WAIVE_TEMPORARILY' THEN 'WAIVER' WHEN instruction_type = 'REINSTATE' THEN 'REINSTATEMENT' WHEN instruction_type = 'RENUMBER_REFERENCE' THEN 'RENUMBER' WHEN instruction_type = 'FIND_REPLACE_REFERENCE' THEN 'DEFINED_TERM_PROPAGATION' END AS family FROM j),
a AS (SELECT *, CASE WHEN family IN ('SCALAR_REPLACEMENT', 'IDENTITY_PRESERVING_RESTATEMENT', 'DEFINED_TERM_PROPAGATION') THEN CASE WHEN target_field IS NOT NULL THEN [target_field] END WHEN family = 'CREATE' THEN CASE WHEN target_field IS NOT NULL THEN [target_field] ELSE ['threshold', 'operator', 'unit'] END
  WHEN family IN ('EXCEPTION_EXPANSION', 'EXCEPTION_CONTRACTION') THEN ['exceptions'] WHEN family IN ('WAIVER', 'REINSTATEMENT') THEN ['status', 'applicability'] WHEN family = 'TERMINATE' THEN CASE WHEN effective_date IS NOT NULL THEN ['status', 'valid_to'] ELSE ['status'] END WHEN family = 'SCHEDULE_REPLACEMENT' THEN ['applicability'] WHEN family = 'RENUMBER' THEN CAST([] AS VARCHAR[]) END AS affected FROM k),
n AS (SELECT *, list_transform(affected, lambda x: CASE WHEN x = target_field THEN new_value WHEN family = 'EXCEPTION_EXPANSION' THEN exception_text ELSE {_SETS} ELSE new_value END END) AS new_values,
  list_transform(affected, lambda x: CASE x WHEN 'threshold' THEN threshold WHEN 'exceptions' THEN exceptions END) AS old_values, CASE target_field WHEN 'threshold' THEN threshold WHEN 'exceptions' THEN exceptions END AS held, family IN ('WAIVER', 'REINSTATEMENT', 'TERMINATE', 'RENUMBER') AS bare FROM a),
judged AS (SELECT *, CASE WHEN commitment_id IS NULL THEN 'target_identity' WHEN version_id IS NULL THEN 'predecessor_lookup' WHEN family IS NULL THEN 'transformation_type' WHEN affected IS NULL THEN 'affected_fields' WHEN NOT bare AND len(list_filter(new_values, lambda x: x IS NULL)) > 0 THEN 'value_extraction'
  WHEN NOT bare AND NOT CASE value_provenance WHEN 'PARSER_EXTRACTED' THEN source_text IS NOT NULL WHEN 'UNKNOWN' THEN false WHEN 'CURATOR_PROVIDED' THEN source_text IS NOT NULL AND (new_value IS NULL OR contains(source_text, new_value)) ELSE false END THEN 'value_provenance'
  WHEN declared_old_value IS NOT NULL AND target_field IS NOT NULL AND family IN ('SCALAR_REPLACEMENT', 'EXCEPTION_CONTRACTION', 'SCHEDULE_REPLACEMENT', 'IDENTITY_PRESERVING_RESTATEMENT') AND coalesce(CASE WHEN TRY_CAST(held AS DOUBLE) IS NOT NULL THEN TRY_CAST(held AS DOUBLE) <> TRY_CAST(declared_old_value AS DOUBLE) ELSE held <> declared_old_value END, true) THEN 'old_value_consistency' ELSE 'authorized' END AS step,
  CAST(CASE WHEN commitment_id IS NULL THEN CASE WHEN alias_match <> '' THEN 30 ELSE 0 END ELSE least(95, least(95, least(95, 90 + CASE WHEN alias_match <> '' THEN 5 ELSE 0 END) + CASE WHEN text_match <> '' THEN 3 ELSE 0 END) + CASE WHEN canonical_key_hint = commitment_id THEN 2 ELSE 0 END) END AS INTEGER) AS confidence FROM n)
"""
)


@query(
    "eng_authorisations",
    _AUTHORISED
    + "SELECT evidence_id, step, confidence, commitment_id, CASE WHEN step NOT IN ('target_identity', 'predecessor_lookup') THEN version_id END AS predecessor, CASE WHEN step = 'authorized' THEN family END AS family, CASE WHEN step = 'authorized' THEN array_to_string(list_transform(list_zip(affected, old_values, new_values), lambda x: concat(x[1], ':', coalesce(x[2], '-'), '>', coalesce(x[3], '-'))), ',') END AS changes, CASE WHEN step = 'authorized' THEN CAST(20 - len(affected) AS INTEGER) END AS n_preserved FROM judged",
    "address_given evidence kernel_version",
)
def eng_authorisations(spark, sf_dir):
    """Every piece of evidence: authorised, with its changes, or the step that refuses it."""
    evidence, versions = evidence_tables(spark, sf_dir)
    done = authorise(evidence, _book(spark, sf_dir), versions, "evidence_id")
    dash = lambda x: F.coalesce(x, F.lit("-"))
    changes = F.array_join(F.transform("values", lambda v: F.concat(v["field"], F.lit(":"), dash(v["old_value"]), F.lit(">"), dash(v["new_value"]))), ",")
    return done.select("evidence_id", "step", "confidence", "commitment_id", "predecessor", "family", changes.alias("changes"), F.size("preserved").alias("n_preserved"))


@query("eng_refusals", _AUTHORISED + "SELECT step, coalesce(family, 'none') AS family, CAST(count(*) AS BIGINT) AS n FROM judged GROUP BY ALL", "address_given evidence kernel_version")
def eng_refusals(spark, sf_dir):
    """How often each step refuses, by family of the evidence."""
    evidence, versions = evidence_tables(spark, sf_dir)
    done = authorise(evidence, _book(spark, sf_dir), versions, "evidence_id", ["kind"])
    return done.groupBy("step", F.coalesce("kind", F.lit("none")).alias("family")).agg(F.count("*").alias("n"))
