"""Composite analyses of whole amendment chains: each takes DataFrames and gives named DataFrames.

Nothing here runs a job; what a caller doesn't use isn't computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..operators.gates import _CONFIDENCE, evidence_level, first_match
from ..operators.state import _FOLD_SQL, _INHERITED, execution_status, fold_instructions, inherited_unresolved
from ..registry import query


def reconstruct_chains(instructions: DataFrame) -> dict[str, DataFrame]:
    """Folds every chain and says which steps, and which chains, are authoritative.

    ``state``: the final state of each key. ``steps``: own and inherited unresolved work and authority by the resolving and the
    never-resolving definition. ``chains``: the last step's authority with counts.
    """
    state = fold_instructions(instructions)
    before = F.sum("own").over(W.partitionBy("agreement_id").orderBy("step"))
    steps = inherited_unresolved(instructions).select(
        "agreement_id", "step", "own", "inherited", F.expr("own = 0 and inherited = 0").alias("authoritative"), (before == 0).alias("strictly_authoritative")
    )
    chains = steps.groupBy("agreement_id").agg(
        F.max("step").alias("last_step"), F.count_if("authoritative").alias("authoritative_steps"), F.max_by("authoritative", "step").alias("authoritative"), F.max_by("inherited", "step").alias("still_open")
    )
    return {"state": state, "steps": steps, "chains": chains}


@query(
    "pln_reconstruct_chains",
    _INHERITED
    + """, t AS (SELECT agreement_id, step, own, inherited, own = 0 AND inherited = 0 AS ok FROM s)
SELECT agreement_id, max(step) AS last_step, CAST(count(*) FILTER (ok) AS BIGINT) AS authoritative_steps, arg_max(ok, step) AS authoritative, arg_max(inherited, step) AS still_open FROM t GROUP BY 1""",
    "instruction_stream",
)
def pln_reconstruct_chains(spark, sf_dir):
    return reconstruct_chains(P.instruction_stream(spark, sf_dir))["chains"]


@query(
    "pln_chain_summary",
    _FOLD_SQL
    + """SELECT agreement_id, CAST(count(*) AS BIGINT) AS keys, CAST(count(*) FILTER (status = 'ACTIVE') AS BIGINT) AS active, CAST(sum(applied) AS BIGINT) AS applied, CAST(sum(unresolved) AS BIGINT) AS unresolved,
CASE WHEN sum(applied) = 0 AND sum(unresolved) = 0 THEN 'COMPLETE' WHEN sum(applied) = 0 THEN 'UNRESOLVED' WHEN sum(unresolved) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS outcome FROM last WHERE rn = 1 GROUP BY agreement_id""",
    "instruction_stream",
)
def pln_chain_summary(spark, sf_dir):
    """A chain's final state in one row."""
    s = reconstruct_chains(P.instruction_stream(spark, sf_dir))["state"].groupBy("agreement_id").agg(
        F.count("*").alias("keys"), F.count_if(F.col("status") == "ACTIVE").alias("active"), F.sum("applied").alias("applied"), F.sum("unresolved").alias("unresolved")
    )
    return s.withColumn("outcome", execution_status(F.col("applied"), F.col("unresolved")))


def conservation_spine(candidates: DataFrame) -> dict[str, DataFrame]:
    """Sends candidates through the layers: the layer that rejects one is its disposition, the others are promoted or routed.

    ``candidates``: instruction_type, status, old_value, new_value, confidence and any keys.
    """
    rules = [
        (F.col("instruction_type") == "UNRESOLVED", "ROUTED"),
        (F.col("old_value") > 48, "REJECTED_IDENTITY"),
        (F.col("new_value") < 3000, "REJECTED_OLD_VALUE"),
        (F.col("status") != "APPLIED", "REJECTED_CONSERVATION"),
        (evidence_level(F.col("confidence")) == "INSUFFICIENT", "REJECTED_PROOF"),
        (evidence_level(F.col("confidence")) == "WEAK", "VALIDATION_REQUIRED"),
    ]
    ledger = candidates.withColumn("disposition", first_match(rules, "PROMOTED"))
    counts = ledger.groupBy("disposition").agg(F.count("*").alias("n"))
    return {"ledger": ledger, "dispositions": counts}


@query(
    "pln_spine_dispositions",
    """
SELECT CASE WHEN instruction_type = 'UNRESOLVED' THEN 'ROUTED' WHEN old_value > 48 THEN 'REJECTED_IDENTITY' WHEN new_value < 3000 THEN 'REJECTED_OLD_VALUE' WHEN status <> 'APPLIED' THEN 'REJECTED_CONSERVATION'
  WHEN round(1 - (1 - parser_confidence) * 8, 2) < 0.5 THEN 'REJECTED_PROOF' WHEN round(1 - (1 - parser_confidence) * 8, 2) < 0.7 THEN 'VALIDATION_REQUIRED' ELSE 'PROMOTED' END AS disposition, CAST(count(*) AS BIGINT) AS n FROM amendment_instruction GROUP BY 1""",
    "amendment_instruction",
)
def pln_spine_dispositions(spark, sf_dir):
    return conservation_spine(P.amendment_instruction(spark, sf_dir).withColumn("confidence", F.expr(_CONFIDENCE)))["dispositions"]


@query(
    "pln_smoke_questions",
    """
SELECT 'Q1 in force' AS question, CAST(count(*) AS BIGINT) AS n FROM commitment_version WHERE valid_to IS NULL
UNION ALL SELECT 'Q2 orphans', count(*) FROM commitment_version WHERE parent_version_id IS NOT NULL AND parent_version_id NOT IN (SELECT version_id FROM commitment_version)
UNION ALL SELECT 'Q3 changed', count(*) FROM commitment_version v JOIN commitment_version p ON p.version_id = v.parent_version_id WHERE v.threshold <> p.threshold
UNION ALL SELECT 'Q4 waived', count(*) FROM commitment_version WHERE status = 'WAIVED'""",
    "commitment_version",
)
def pln_smoke_questions(spark, sf_dir):
    """Four questions of one self-join: what is in force, orphans, changes, waivers."""
    v = P.commitment_version(spark, sf_dir)
    old = v.select(F.col("version_id").alias("parent_version_id"), F.col("threshold").alias("old"), F.lit(True).alias("known"))
    j = v.join(old, "parent_version_id", "left")
    tests = {
        "Q1 in force": F.col("valid_to").isNull(),
        "Q2 orphans": F.col("parent_version_id").isNotNull() & F.col("known").isNull(),
        "Q3 changed": F.col("threshold") != F.col("old"),
        "Q4 waived": F.col("status") == "WAIVED",
    }
    counted = j.agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("question"), F.col(n).alias("n")) for n in tests])).alias("x")).select("x.*")


@query(
    "pln_freeze_study",
    """
WITH c AS (SELECT chain_id, count(*) AS steps, count(*) FILTER (outcome = 'UNRESOLVED') AS bad, max(size) AS largest FROM chain_step GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS chains, round(avg(CASE WHEN bad = 0 THEN 1.0 ELSE 0.0 END), 4) AS success_rate, CAST(count(*) FILTER (steps >= 3 AND bad = 0) AS BIGINT) AS long_and_clean, max(largest) AS largest,
  avg(CASE WHEN bad = 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AND min(steps) >= 1 AS may_freeze FROM c""",
    "chain_step",
)
def pln_freeze_study(spark, sf_dir):
    c = P.chain_step(spark, sf_dir).groupBy("chain_id").agg(F.count("*").alias("steps"), F.count_if(F.col("outcome") == "UNRESOLVED").alias("bad"), F.max("size").alias("largest"))
    clean = (F.col("bad") == 0).cast("double")
    return c.agg(
        F.count("*").alias("chains"),
        F.round(F.avg(clean), 4).alias("success_rate"),
        F.count_if((F.col("steps") >= 3) & (F.col("bad") == 0)).alias("long_and_clean"),
        F.max("largest").alias("largest"),
        ((F.avg(clean) >= 0.5) & (F.min("steps") >= 1)).alias("may_freeze"),
    )
