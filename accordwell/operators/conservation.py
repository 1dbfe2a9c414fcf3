"""The ten conservation invariants of a change, by family of transformation, over the kernels before and after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query

# The families, and the invariants in the order in which they are checked with the families that they apply to.
FAMILIES = (
    "SCALAR_REPLACEMENT", "MULTI_FIELD_REPLACEMENT", "EXCEPTION_EXPANSION", "EXCEPTION_CONTRACTION", "SCHEDULE_REPLACEMENT", "TEMPORAL_STEP_CHANGE", "WAIVER", "REINSTATEMENT",
    "IDENTITY_PRESERVING_RESTATEMENT", "DEFINED_TERM_PROPAGATION", "RENUMBER", "TERMINATE", "CREATE",
)
EXISTING = FAMILIES[:-1]
APPLIES_TO = {
    "identity_persistence": EXISTING,
    "old_value_consistency": ("SCALAR_REPLACEMENT", "MULTI_FIELD_REPLACEMENT", "EXCEPTION_CONTRACTION", "SCHEDULE_REPLACEMENT", "TEMPORAL_STEP_CHANGE", "IDENTITY_PRESERVING_RESTATEMENT"),
    "unchanged_field_preservation": EXISTING,
    "no_unsupported_semantic_gain": FAMILIES,
    "no_silent_semantic_loss": FAMILIES,
    "target_reference_separation": FAMILIES,
    "lineage_continuity": FAMILIES,
    "temporal_validity": ("SCHEDULE_REPLACEMENT", "TEMPORAL_STEP_CHANGE", "WAIVER", "REINSTATEMENT", "TERMINATE", "CREATE"),
    "out_of_scope_isolation": FAMILIES,
    "transformation_completeness": ("MULTI_FIELD_REPLACEMENT", "IDENTITY_PRESERVING_RESTATEMENT", "DEFINED_TERM_PROPAGATION", "SCHEDULE_REPLACEMENT", "CREATE"),
}
LEGAL_BEFORE = {"REINSTATEMENT": ("WAIVED",), "WAIVER": ("ACTIVE",), "TERMINATE": ("ACTIVE", "WAIVED")}


def _same_value(a: Column, b: Column) -> Column:
    """Equal as numbers where both are numbers, else as texts."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.eqNullSafe(b))


def invariant_results(changes: DataFrame) -> DataFrame:
    """``changes`` with failed (array of invariant names, in order), checked (how many applied) and all_passed.

    Columns: family; before, after (structs: commitment_id, status, valid_from, valid_to, fields map<string,string>, lists map<string,array<string>>; null where there is
    no such kernel); affected (array of structs name, declared_old, old, new); preserved (array of field names); commitment_id, source_span, source_document,
    source_authority; old_value_verified. A field's value is its text; whether numbers or texts are compared follows from them. A family that isn't known has no checks.
    """
    family, before, after, affected = (F.col(c) for c in ("family", "before", "after", "affected"))
    both = before.isNotNull() & after.isNotNull()
    text_of = lambda side, name: F.coalesce(side["fields"][name], F.array_join(side["lists"][name], "|"))
    named = F.transform(affected, lambda a: a["name"])
    grown = lambda more, less: F.exists(
        F.map_keys(before["lists"]), lambda n: ~F.array_contains(named, n) & (F.size(more["lists"][n]) > F.size(less["lists"][n])) & (F.size(less["lists"][n]) >= 0)
    )
    legal = F.lit(True)
    for kind, statuses in LEGAL_BEFORE.items():
        legal = F.when(family == kind, before.isNull() | before["status"].isin(*statuses)).otherwise(legal)
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    # what breaks each
    breaks = {
        "identity_persistence": ~both | ~before["commitment_id"].eqNullSafe(after["commitment_id"]),
        "old_value_consistency": ~F.coalesce(F.col("old_value_verified"), F.lit(False))
        | (before.isNotNull() & F.exists(affected, lambda a: a["declared_old"].isNotNull() & ~_same_value(a["declared_old"], text_of(before, a["name"])))),
        "unchanged_field_preservation": ~both | F.exists(F.col("preserved"), lambda n: ~text_of(before, n).eqNullSafe(text_of(after, n))),
        "no_unsupported_semantic_gain": both & (family != "CREATE") & grown(after, before),
        "no_silent_semantic_loss": both & (family != "CREATE") & grown(before, after),
        "target_reference_separation": missing("source_span") & missing("source_document"),
        "lineage_continuity": (family != "CREATE") & (before.isNull() | missing("source_authority")),
        "temporal_validity": after.isNotNull() & (F.coalesce(after["valid_from"] > after["valid_to"], F.lit(False)) | ~F.coalesce(legal, F.lit(False))),
        "out_of_scope_isolation": missing("commitment_id"),
        "transformation_completeness": F.exists(affected, lambda a: a["old"].isNull() & a["new"].isNull()),
    }
    failed = F.array_compact(F.array(*[F.when(family.isin(*APPLIES_TO[n]) & F.coalesce(b, F.lit(True)), n) for n, b in breaks.items()]))
    checked = sum((F.when(family.isin(*names), 1).otherwise(0) for names in APPLIES_TO.values()), F.lit(0))
    return changes.withColumn("failed", failed).withColumns({"checked": checked, "all_passed": F.size("failed") == 0})


#: Test changes: all families, and every way to break an invariant, from the columns of a line item. Numbers are small so that values agree often.
_PARTS = {
    "family": "CASE l_partkey % 13 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(FAMILIES)) + " END",
    "has_before": "l_linenumber <> 7",
    "has_after": "l_quantity <> 49",
    "id_after": "CASE WHEN l_quantity = 48 THEN 'other' ELSE 'c' END",
    "status_before": "CASE WHEN l_returnflag = 'A' THEN 'WAIVED' WHEN l_returnflag = 'N' THEN 'ACTIVE' ELSE 'SUSPENDED' END",
    "days": "CAST(l_quantity AS INTEGER) - 3",
    "old_text": "CASE WHEN l_linenumber % 2 = 0 THEN '4.0' ELSE 'four' END",
    "declared": "CASE WHEN l_quantity < 20 THEN NULL WHEN l_quantity < 40 THEN CASE WHEN l_linenumber % 2 = 0 THEN '4' ELSE 'four' END ELSE '5' END",
    "new_text": "CASE WHEN l_tax > 0.01 THEN '4.5' END",
    "unit_after": "CASE WHEN l_quantity = 47 THEN 'usd' ELSE 'ratio' END",
    "n_before": "l_linenumber % 3",
    "n_after": "CASE WHEN l_quantity > 44 THEN (l_linenumber + 1) % 3 ELSE l_linenumber % 3 END",
    "lists_affected": "l_suppkey % 2 = 0",
    "verified": "CASE WHEN l_quantity = 46 THEN NULL ELSE l_quantity <> 45 END",
    "span": "CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 'span' END",
    "document": "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'document' END",
    "authority": "CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE 'amendment' END",
    "commitment_id": "CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE 'c' END",
}
P.SQL["change"] = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, " + ", ".join(f"{sql} AS {name}" for name, sql in _PARTS.items()) + " FROM lineitem"


def change(spark, sf_dir) -> DataFrame:
    rows = P.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", *(F.expr(sql).alias(name) for name, sql in _PARTS.items()))
    items = lambda n: F.slice(F.array(*map(F.lit, ("x", "y"))), 1, F.col(n).cast("int"))
    fields = lambda value, unit: F.map_from_arrays(F.array(*map(F.lit, ("threshold", "unit"))), F.array(value, unit))
    begins, ends = F.col("l_shipdate"), F.col("l_shipdate") + F.make_dt_interval("days")
    lists = lambda n: F.create_map(F.lit("exceptions"), items(n))
    before = F.struct(F.lit("c").alias("commitment_id"), F.col("status_before").alias("status"), begins.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), fields(F.col("old_text"), F.lit("ratio")).alias("fields"), lists("n_before").alias("lists"))
    after = F.struct(F.col("id_after").alias("commitment_id"), F.lit("ACTIVE").alias("status"), begins.alias("valid_from"), ends.alias("valid_to"), fields(F.col("new_text"), F.col("unit_after")).alias("fields"), lists("n_after").alias("lists"))
    none = F.lit(None).cast("string")
    threshold = F.struct(F.lit("threshold").alias("name"), F.col("declared").alias("declared_old"), F.when(F.col("l_linenumber") != 5, F.col("old_text")).alias("old"), F.col("new_text").alias("new"))
    exceptions = F.struct(F.lit("exceptions").alias("name"), none.alias("declared_old"), F.lit("").alias("old"), F.lit("").alias("new"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "family",
        F.when(F.col("has_before"), before).alias("before"),
        F.when(F.col("has_after"), after).alias("after"),
        F.when(F.col("lists_affected"), F.array(threshold, exceptions)).otherwise(F.array(threshold)).alias("affected"),
        F.array(F.lit("unit")).alias("preserved"),
        "commitment_id", F.col("span").alias("source_span"), F.col("document").alias("source_document"), F.col("authority").alias("source_authority"), F.col("verified").alias("old_value_verified"),
    )


def _listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query(
    "con_ten_invariants",
    f"""
WITH b AS (SELECT *, has_before AND has_after AS pair, {", ".join(f"family IN ({_listed(names)}) AS a{k}" for k, names in enumerate(APPLIES_TO.values()))} FROM change),
f AS (SELECT *, concat_ws(',',
  CASE WHEN a0 AND (NOT pair OR id_after <> 'c') THEN 'identity_persistence' END,
  CASE WHEN a1 AND (NOT coalesce(verified, false) OR has_before AND declared IS NOT NULL AND NOT (declared = old_text OR declared = '4' AND old_text = '4.0')) THEN 'old_value_consistency' END,
  CASE WHEN a2 AND (NOT pair OR unit_after <> 'ratio') THEN 'unchanged_field_preservation' END,
  CASE WHEN a3 AND pair AND family <> 'CREATE' AND NOT lists_affected AND n_after > n_before THEN 'no_unsupported_semantic_gain' END,
  CASE WHEN a4 AND pair AND family <> 'CREATE' AND NOT lists_affected AND n_after < n_before THEN 'no_silent_semantic_loss' END,
  CASE WHEN a5 AND span = '' AND document IS NULL THEN 'target_reference_separation' END,
  CASE WHEN a6 AND family <> 'CREATE' AND (NOT has_before OR authority = '') THEN 'lineage_continuity' END,
  CASE WHEN a7 AND has_after AND (days < 0 OR has_before AND (family = 'REINSTATEMENT' AND status_before <> 'WAIVED' OR family = 'WAIVER' AND status_before <> 'ACTIVE' OR family = 'TERMINATE' AND status_before = 'SUSPENDED')) THEN 'temporal_validity' END,
  CASE WHEN a8 AND commitment_id IS NULL THEN 'out_of_scope_isolation' END,
  CASE WHEN a9 AND l_linenumber = 5 AND new_text IS NULL THEN 'transformation_completeness' END) AS failed,
  {" + ".join(f"CAST(a{k} AS INTEGER)" for k in range(len(APPLIES_TO)))} AS checked FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, family, failed, CAST(checked AS INTEGER) AS checked, failed = '' AS all_passed FROM f""",
    "change",
)
def con_ten_invariants(spark, sf_dir):
    """The invariants that each change breaks, of those that apply to its family."""
    rows = invariant_results(change(spark, sf_dir))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "family", F.array_join("failed", ",").alias("failed"), "checked", "all_passed")
