"""Ledgers, layered metrics, staged candidates and identity changes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query
from .gates import _FAMILY, _PAIRS, _pairs, family_of, first_match
from .lineage import topmost_ancestors


@query(
    "led_candidates",
    """
SELECT amendment_version_id, instruction_order, CASE WHEN instruction_type = 'UNRESOLVED' THEN 'ROUTED' WHEN status = 'APPLIED' THEN 'APPLIED' ELSE 'REJECTED' END AS disposition,
  CASE WHEN instruction_type = 'UNRESOLVED' THEN NULL WHEN new_value > old_value THEN 'yes' ELSE 'no' END AS correct, CASE WHEN instruction_type = 'UNRESOLVED' THEN 'parse' WHEN status <> 'APPLIED' THEN 'apply' WHEN NOT new_value > old_value THEN 'value' END AS first_failure FROM amendment_instruction""",
    "amendment_instruction",
)
def led_candidates(spark, sf_dir):
    """A row per candidate: what became of it, whether rightly, and where it failed first."""
    parsed, applied, right = F.col("instruction_type") != "UNRESOLVED", F.col("status") == "APPLIED", F.col("new_value") > F.col("old_value")
    return P.amendment_instruction(spark, sf_dir).select(
        "amendment_version_id",
        "instruction_order",
        F.when(~parsed, "ROUTED").when(applied, "APPLIED").otherwise("REJECTED").alias("disposition"),
        F.when(parsed, F.when(right, "yes").otherwise("no")).alias("correct"),
        F.when(~parsed, "parse").when(~applied, "apply").when(~right, "value").alias("first_failure"),
    )


@query(
    "agg_layers",
    """
WITH c AS (SELECT amendment_version_id, count(*) AS n, count(*) FILTER (instruction_type <> 'UNRESOLVED') AS parsed, count(*) FILTER (instruction_type <> 'UNRESOLVED' AND status = 'APPLIED') AS applied, count(*) FILTER (instruction_type <> 'UNRESOLVED' AND status = 'APPLIED' AND new_value > 20000) AS exact FROM amendment_instruction GROUP BY 1)
SELECT 'extraction' AS layer, round(sum(parsed) / sum(n), 4) AS pooled, round(avg(parsed / n), 4) AS mean, CAST(count(*) FILTER (parsed > 0) AS BIGINT) AS scored FROM c
UNION ALL SELECT 'transformation', round(sum(applied) / sum(parsed), 4), round(avg(CASE WHEN parsed > 0 THEN applied / parsed END), 4), count(*) FILTER (applied > 0) FROM c
UNION ALL SELECT 'reconstruction', round(sum(exact) / sum(applied), 4), round(avg(CASE WHEN applied > 0 THEN exact / applied END), 4), count(*) FILTER (exact > 0) FROM c""",
    "amendment_instruction",
)
def agg_layers(spark, sf_dir):
    """Each layer on what the one before passed on: the ratio of sums, and the mean over chains that have a denominator."""
    parsed = F.col("instruction_type") != "UNRESOLVED"
    applied = parsed & (F.col("status") == "APPLIED")
    c = P.amendment_instruction(spark, sf_dir).groupBy("amendment_version_id").agg(
        F.count("*").alias("n"), F.count_if(parsed).alias("parsed"), F.count_if(applied).alias("applied"), F.count_if(applied & (F.col("new_value") > 20000)).alias("exact")
    )
    layers = (("extraction", "parsed", "n"), ("transformation", "applied", "parsed"), ("reconstruction", "exact", "applied"))
    parts = [
        F.struct(
            F.lit(name).alias("layer"),
            F.round(F.sum(num) / F.sum(den), 4).alias("pooled"),
            F.round(F.avg(F.when(F.col(den) > 0, F.col(num) / F.col(den))), 4).alias("mean"),
            F.count_if(F.col(num) > 0).alias("scored"),
        )
        for name, num, den in layers
    ]
    return c.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


@query(
    "agg_list_agreement",
    """
WITH g AS (SELECT o_custkey AS k, list_sort(list_distinct(list(lower(o_orderpriority)) FILTER (o_orderkey % 3 <> 0))) AS a, list_sort(list_distinct(list(lower(upper(o_orderpriority))) FILTER (o_orderkey % 5 <> 0))) AS b FROM orders GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (coalesce(a, []) = coalesce(b, [])) AS BIGINT) AS equal FROM g""",
)
def agg_list_agreement(spark, sf_dir):
    """Lists count as equal if they are so as sets of lower-case items."""
    kept = lambda c: F.array_sort(F.collect_set(F.when(c, F.lower("o_orderpriority"))))
    g = P.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(kept(F.col("o_orderkey") % 3 != 0).alias("a"), kept(F.col("o_orderkey") % 5 != 0).alias("b"))
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("equal"))


@query(
    "agg_step_provenance",
    "SELECT agreement_id, CAST(count(*) FILTER (instruction_type = 'ADD_COMMITMENT') AS BIGINT) AS added, CAST(count(*) FILTER (instruction_type = 'REPLACE_VALUE') AS BIGINT) AS replaced, CAST(count(*) FILTER (instruction_type = 'UNRESOLVED') AS BIGINT) AS unresolved, count(DISTINCT target_key) AS total_targets FROM instruction_stream GROUP BY 1",
    "instruction_stream",
)
def agg_step_provenance(spark, sf_dir):
    n = lambda k, name: F.count_if(F.col("instruction_type") == k).alias(name)
    return P.instruction_stream(spark, sf_dir).groupBy("agreement_id").agg(
        n("ADD_COMMITMENT", "added"), n("REPLACE_VALUE", "replaced"), n("UNRESOLVED", "unresolved"), F.count_distinct("target_key").alias("total_targets")
    )


@query(
    "win_current_node",
    "SELECT agreement_id, canonical_key, arg_max(version_id, version_number * 10 + CASE status WHEN 'ACTIVE' THEN 3 WHEN 'WAIVED' THEN 2 ELSE 1 END) AS current FROM commitment_version GROUP BY 1, 2",
    "commitment_version",
)
def win_current_node(spark, sf_dir):
    """The node of the highest number; among equals by the rank of its kind."""
    rank = first_match([(F.col("status") == "ACTIVE", "3"), (F.col("status") == "WAIVED", "2")], "1")
    return P.commitment_version(spark, sf_dir).groupBy("agreement_id", "canonical_key").agg(F.max_by("version_id", F.struct("version_number", rank)).alias("current"))


@query(
    "win_state_carried",
    "SELECT agreement_id, step, target_key, last_value(CASE WHEN instruction_type IN ('ADD_COMMITMENT', 'REPLACE_VALUE') THEN new_value END IGNORE NULLS) OVER (PARTITION BY agreement_id, target_key ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM instruction_stream",
    "instruction_stream",
)
def win_state_carried(spark, sf_dir):
    """The value that a step takes over from the last one that set it."""
    w = W.partitionBy("agreement_id", "target_key").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    value = F.when(F.col("instruction_type").isin("ADD_COMMITMENT", "REPLACE_VALUE"), F.col("new_value"))
    return P.instruction_stream(spark, sf_dir).select("agreement_id", "step", "target_key", F.last(value, ignorenulls=True).over(w).alias("carried"))


@query(
    "tmp_stage_promote",
    """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY agreement_id, canonical_key ORDER BY version_number DESC) AS age FROM commitment_version)
SELECT agreement_id, canonical_key, max(version_id) FILTER (age = 1) AS staged, max(version_id) FILTER (age = 2) AS predecessor,
  CASE WHEN max(status) FILTER (age = 1) = 'SUSPENDED' THEN max(version_id) FILTER (age = 2) ELSE max(version_id) FILTER (age = 1) END AS current FROM s WHERE age <= 2 GROUP BY 1, 2""",
    "commitment_version",
)
def tmp_stage_promote(spark, sf_dir):
    """The newest version is staged on its predecessor; the gate's decision says which of the two is current. Nothing is changed in place."""
    age = F.row_number().over(W.partitionBy("agreement_id", "canonical_key").orderBy(F.desc("version_number")))
    s = P.commitment_version(spark, sf_dir).withColumn("age", age).where("age <= 2")
    of = lambda c, k: F.max(F.when(F.col("age") == k, F.col(c)))
    return s.groupBy("agreement_id", "canonical_key").agg(
        of("version_id", 1).alias("staged"), of("version_id", 2).alias("predecessor"), F.when(of("status", 1) == "SUSPENDED", of("version_id", 2)).otherwise(of("version_id", 1)).alias("current")
    )


@query("tmp_establish_origin", "SELECT version_id, agreement_id, canonical_key, 0 AS version, threshold FROM commitment_version WHERE parent_version_id IS NULL", "commitment_version")
def tmp_establish_origin(spark, sf_dir):
    return P.commitment_version(spark, sf_dir).where("parent_version_id is null").select("version_id", "agreement_id", "canonical_key", F.lit(0).alias("version"), "threshold")


@query(
    "con_all_invariants",
    _PAIRS
    + f""", f AS (SELECT *, {_FAMILY} AS family FROM p)
SELECT family, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (canonical_key = old_key) AS BIGINT) AS identity, CAST(count(*) FILTER (old_threshold IS NOT NULL) AS BIGINT) AS old_value, CAST(count(*) FILTER (status = old_status OR family <> 'SCALAR_REPLACEMENT') AS BIGINT) AS unchanged,
  CAST(count(*) FILTER (parent_version_id IS NOT NULL AND agreement_id IS NOT NULL) AS BIGINT) AS lineage, CAST(count(*) FILTER (valid_to IS NULL OR valid_to > valid_from) AS BIGINT) AS temporal, CAST(count(*) FILTER (threshold IS NOT NULL AND status IS NOT NULL) AS BIGINT) AS complete FROM f GROUP BY family""",
    "commitment_version",
)
def con_all_invariants(spark, sf_dir):
    """How many changes of each family hold each invariant."""
    c = F.col
    family = family_of(c("old_status"), c("status"))
    holds = {
        "identity": c("canonical_key") == c("old_key"),
        "old_value": c("old_threshold").isNotNull(),
        "unchanged": (c("status") == c("old_status")) | (c("family") != "SCALAR_REPLACEMENT"),
        "lineage": c("parent_version_id").isNotNull() & c("agreement_id").isNotNull(),
        "temporal": c("valid_to").isNull() | (c("valid_to") > c("valid_from")),
        "complete": c("threshold").isNotNull() & c("status").isNotNull(),
    }
    return _pairs(spark, sf_dir).withColumn("family", family).groupBy("family").agg(F.count("*").alias("n"), *[F.count_if(t).alias(n) for n, t in holds.items()])


@query(
    "prf_build",
    """
SELECT amendment_version_id, instruction_order, CASE WHEN target_key IS NULL OR effective_start IS NULL THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS completeness, CASE WHEN status = 'APPLIED' THEN CASE WHEN new_value >= old_value THEN 'VALID' ELSE 'INVALID' END ELSE 'INDETERMINATE' END AS validity,
  CASE WHEN parser_confidence >= 0.97 THEN 'LOW' WHEN parser_confidence >= 0.93 THEN 'MEDIUM' ELSE 'HIGH' END AS uncertainty FROM amendment_instruction""",
    "amendment_instruction",
)
def prf_build(spark, sf_dir):
    """A proof's completeness, validity after execution, and uncertainty."""
    c = F.col
    return P.amendment_instruction(spark, sf_dir).select(
        "amendment_version_id",
        "instruction_order",
        F.when(c("target_key").isNull() | c("effective_start").isNull(), "INCOMPLETE").otherwise("COMPLETE").alias("completeness"),
        F.when(c("status") != "APPLIED", "INDETERMINATE").when(c("new_value") >= c("old_value"), "VALID").otherwise("INVALID").alias("validity"),
        F.when(c("parser_confidence") >= 0.97, "LOW").when(c("parser_confidence") >= 0.93, "MEDIUM").otherwise("HIGH").alias("uncertainty"),
    )


@query(
    "grf_identity_trace",
    """
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS id, l_partkey - 1 AS predecessor FROM lineitem WHERE l_partkey % 6 <> 0),
t AS (SELECT id, predecessor AS reached, 1 AS changes FROM e UNION ALL SELECT t.id, e.predecessor, t.changes + 1 FROM t JOIN e ON e.id = t.reached)
SELECT id, min(reached) AS origin, max(changes) AS changes FROM t GROUP BY id""",
)
def grf_identity_trace(spark, sf_dir):
    """Through changes of identity back to the first one, with the number of changes."""
    p = F.col("l_partkey")
    edges = P.read(spark, sf_dir, "lineitem").where(p % 6 != 0).select(p.alias("node"), (p - 1).alias("parent")).distinct()
    return topmost_ancestors(edges).select(F.col("node").alias("id"), F.col("ancestor").alias("origin"), F.col("depth").alias("changes"))


@query(
    "grf_edge_lookup",
    "SELECT canonical_key, CAST(count(*) AS BIGINT) AS edges, CAST(count(*) FILTER (status = 'ACTIVE') AS BIGINT) AS validated, bool_or(status <> 'ACTIVE') AS any_unvalidated, min(valid_from) AS oldest FROM commitment_version WHERE parent_version_id IS NOT NULL GROUP BY 1",
    "commitment_version",
)
def grf_edge_lookup(spark, sf_dir):
    """Edges by key: how many, how many validated, whether any isn't, and the oldest."""
    active = F.col("status") == "ACTIVE"
    return P.commitment_version(spark, sf_dir).where("parent_version_id is not null").groupBy("canonical_key").agg(
        F.count("*").alias("edges"), F.count_if(active).alias("validated"), F.bool_or(~active).alias("any_unvalidated"), F.min("valid_from").alias("oldest")
    )


@query("eng_affected_values", "SELECT amendment_version_id, instruction_order, CASE instruction_type WHEN 'REPLACE_VALUE' THEN 'threshold' WHEN 'ADD' THEN 'exceptions' END AS field, CASE WHEN instruction_type = 'REPLACE_VALUE' THEN old_value END AS old_value, CASE WHEN instruction_type <> 'UNRESOLVED' THEN new_value END AS new_value, instruction_type <> 'REPLACE_VALUE' OR old_value < 50 AS old_verified FROM amendment_instruction", "amendment_instruction")
def eng_affected_values(spark, sf_dir):
    """Affected field, old and new value of an instruction, and whether a declared old value holds."""
    kind = F.col("instruction_type")
    return P.amendment_instruction(spark, sf_dir).select(
        "amendment_version_id",
        "instruction_order",
        F.when(kind == "REPLACE_VALUE", "threshold").when(kind == "ADD", "exceptions").alias("field"),
        F.when(kind == "REPLACE_VALUE", F.col("old_value")).alias("old_value"),
        F.when(kind != "UNRESOLVED", F.col("new_value")).alias("new_value"),
        ((kind != "REPLACE_VALUE") | (F.col("old_value") < 50)).alias("old_verified"),
    )


@query("map_party_change", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'ADD' WHEN o_orderstatus = 'P' THEN 'REMOVE' END AS operation, regexp_extract(concat('joined by ', o_orderpriority, ' as Guarantor'), 'as ([A-Z][a-z]+)', 1) AS party_role FROM orders WHERE o_orderstatus <> 'O'")
def map_party_change(spark, sf_dir):
    """The operation from the trigger, the role after it."""
    text = F.concat(F.lit("joined by "), "o_orderpriority", F.lit(" as Guarantor"))
    operation = F.when(F.col("o_orderstatus") == "F", "ADD").when(F.col("o_orderstatus") == "P", "REMOVE")
    return P.read(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select("o_orderkey", operation.alias("operation"), F.regexp_extract(text, "as ([A-Z][a-z]+)", 1).alias("party_role"))


@query("map_exception_sentence", "SELECT doc_id, sha256(list_filter(string_split(text, '. '), lambda s: contains(lower(s), 'the'))[1]) AS sentence_sha256 FROM documents")
def map_exception_sentence(spark, sf_dir):
    """The first sentence with a trigger word."""
    first = F.get(F.filter(F.split("text", r"\. "), lambda s: F.lower(s).contains("the")), F.lit(0))
    return P.read(spark, sf_dir, "documents").select("doc_id", F.sha2(first, 256).alias("sentence_sha256"))


@query(
    "eng_applicability_merge",
    "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(concat(o_orderpriority, '=', o_orderstatus)))), ';') AS pairs, count(DISTINCT o_orderpriority) AS n_keys FROM orders GROUP BY 1",
)
def eng_applicability_merge(spark, sf_dir):
    pair = F.concat("o_orderpriority", F.lit("="), "o_orderstatus")
    return P.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(pair)), ";").alias("pairs"), F.count_distinct("o_orderpriority").alias("n_keys"))
