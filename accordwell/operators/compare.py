"""Comparing states: full-outer differences by key and agreement by field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query

FIELDS = ("threshold", "status", "unit")

_STATES = """
WITH truth AS (SELECT o_custkey AS agreement_id, o_orderpriority AS canonical_key, max(o_totalprice) AS threshold, max(o_orderstatus) AS status, 'USD' AS unit
  FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1, 2),
mine AS (SELECT o_custkey AS agreement_id, o_orderpriority AS canonical_key, max(CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice + 1 ELSE o_totalprice END) AS threshold,
  min(o_orderstatus) AS status, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'USD' END AS unit FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2)
"""


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two versions of a state that differ in keys and fields."""
    o = P.read(spark, sf_dir, "orders")
    keys = [F.col("o_custkey").alias("agreement_id"), F.col("o_orderpriority").alias("canonical_key")]
    truth = o.where("o_orderkey % 4 <> 0").groupBy(*keys).agg(F.max("o_totalprice").alias("threshold"), F.max("o_orderstatus").alias("status"), F.lit("USD").alias("unit"))
    price = F.when(F.col("o_orderkey") % 6 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    mine = o.where("o_orderkey % 5 <> 0").groupBy(*keys).agg(F.max(price).alias("threshold"), F.min("o_orderstatus").alias("status"))
    return truth, mine.withColumn("unit", F.when(F.col("agreement_id") % 9 == 0, F.lit(None)).otherwise(F.lit("USD")))


def state_diff(mine: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("agreement_id", "canonical_key"), fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A row per key: presence (both, missing, extra) and the fields that differ, null-safe, joined by commas."""
    m = mine.select(*keys, F.struct(*fields).alias("m"))
    t = truth.select(*keys, F.struct(*fields).alias("t"))
    presence = F.when(F.col("m").isNull(), "missing").when(F.col("t").isNull(), "extra").otherwise("both")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"m.{f}").eqNullSafe(F.col(f"t.{f}")), f) for f in fields]))
    return m.join(t, list(keys), "full_outer").select(*keys, presence.alias("presence"), F.when(presence == "both", F.array_join(differ, ",")).alias("differing"))


@query(
    "cmp_state_diff",
    _STATES
    + """
SELECT coalesce(m.agreement_id, t.agreement_id) AS agreement_id, coalesce(m.canonical_key, t.canonical_key) AS canonical_key,
  CASE WHEN m.agreement_id IS NULL THEN 'missing' WHEN t.agreement_id IS NULL THEN 'extra' ELSE 'both' END AS presence,
  CASE WHEN m.agreement_id IS NOT NULL AND t.agreement_id IS NOT NULL THEN concat_ws(',', CASE WHEN m.threshold IS DISTINCT FROM t.threshold THEN 'threshold' END,
    CASE WHEN m.status IS DISTINCT FROM t.status THEN 'status' END, CASE WHEN m.unit IS DISTINCT FROM t.unit THEN 'unit' END) END AS differing
FROM mine m FULL JOIN truth t ON m.agreement_id = t.agreement_id AND m.canonical_key = t.canonical_key""",
)
def cmp_state_diff(spark, sf_dir):
    truth, mine = _states(spark, sf_dir)
    return state_diff(mine, truth)


@query(
    "cmp_field_mismatches",
    _STATES
    + """
SELECT agreement_id, canonical_key, f AS field FROM (
  SELECT agreement_id, canonical_key, unnest(['threshold', 'status', 'unit']) AS f,
    unnest([m.threshold IS DISTINCT FROM t.threshold, m.status IS DISTINCT FROM t.status, m.unit IS DISTINCT FROM t.unit]) AS d
  FROM mine m JOIN truth t USING (agreement_id, canonical_key)) WHERE d""",
)
def cmp_field_mismatches(spark, sf_dir):
    truth, mine = _states(spark, sf_dir)
    both = state_diff(mine, truth).where("presence = 'both' and differing <> ''")
    return both.select("agreement_id", "canonical_key", F.explode(F.split("differing", ",")).alias("field"))


@query(
    "cmp_field_agreement",
    _STATES
    + """, d AS (SELECT m.agreement_id IS NOT NULL AS there, m.threshold IS NOT DISTINCT FROM t.threshold AS a, m.status IS NOT DISTINCT FROM t.status AS b,
   m.unit IS NOT DISTINCT FROM t.unit AS c FROM truth t LEFT JOIN mine m ON m.agreement_id = t.agreement_id AND m.canonical_key = t.canonical_key),
u AS (SELECT 'threshold' AS field, there AND a AS ok FROM d UNION ALL SELECT 'status', there AND b FROM d UNION ALL SELECT 'unit', there AND c FROM d)
SELECT field, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (ok) AS BIGINT) AS matched, round(count(*) FILTER (ok) / count(*), 4) AS agreement FROM u GROUP BY field""",
)
def cmp_field_agreement(spark, sf_dir):
    """Share of matching fields; a commitment that is missing counts against every field."""
    truth, mine = _states(spark, sf_dir)
    rows = state_diff(mine, truth).where("presence <> 'extra'")
    ok = lambda f: (F.col("presence") == "both") & ~F.array_contains(F.split(F.coalesce("differing", F.lit("")), ","), f)
    fields = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), ok(f).alias("ok")) for f in FIELDS])).alias("x"))
    return fields.groupBy("x.field").agg(F.count("*").alias("total"), F.count_if("x.ok").alias("matched")).withColumn("agreement", F.round(F.col("matched") / F.col("total"), 4))


@query(
    "cmp_missing_extra_deleted",
    _STATES
    + """
SELECT 'missing' AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT agreement_id, canonical_key FROM truth EXCEPT ALL SELECT agreement_id, canonical_key FROM mine)
UNION ALL SELECT 'extra', count(*) FROM (SELECT agreement_id, canonical_key FROM mine EXCEPT ALL SELECT agreement_id, canonical_key FROM truth)
UNION ALL SELECT 'common', count(*) FROM (SELECT agreement_id, canonical_key FROM mine INTERSECT SELECT agreement_id, canonical_key FROM truth)
UNION ALL SELECT 'union', count(*) FROM (SELECT agreement_id, canonical_key FROM mine UNION SELECT agreement_id, canonical_key FROM truth)
UNION ALL SELECT 'deleted', count(*) FROM (SELECT agreement_id, canonical_key FROM truth WHERE status = 'F' EXCEPT SELECT agreement_id, canonical_key FROM mine)""",
)
def cmp_missing_extra_deleted(spark, sf_dir):
    """Sizes of the key sets; one outer join stands for all five set operations."""
    truth, mine = _states(spark, sf_dir)
    k = ["agreement_id", "canonical_key"]
    sides = mine.select(*k, F.lit(True).alias("m")).join(truth.select(*k, F.lit(True).alias("t"), F.col("status").alias("s")), k, "full_outer")
    m, t = F.col("m").isNotNull(), F.col("t").isNotNull()
    kinds = {"missing": t & ~m, "extra": m & ~t, "common": m & t, "union": m | t, "deleted": t & ~m & (F.col("s") == "F")}
    return sides.agg(*[F.count_if(c).alias(n) for n, c in kinds.items()]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("n")) for n in kinds])).alias("x")).select("x.*")


@query(
    "win_silent_loss",
    """
SELECT a.agreement_id, a.step, a.target_key FROM instruction_stream a LEFT JOIN instruction_stream b ON b.agreement_id = a.agreement_id AND b.step = a.step + 1 AND b.target_key = a.target_key
WHERE b.step IS NULL AND a.instruction_type = 'ADD_COMMITMENT'""",
    "instruction_stream",
)
def win_silent_loss(spark, sf_dir):
    """Keys that a step has and the next step lacks."""
    i = P.instruction_stream(spark, sf_dir)
    after = i.select("agreement_id", (F.col("step") - 1).alias("step"), "target_key")
    return i.where("instruction_type = 'ADD_COMMITMENT'").select("agreement_id", "step", "target_key").join(after, ["agreement_id", "step", "target_key"], "left_anti")


@query("win_last_applied", "SELECT agreement_id, target_key, max(step) AS last_step, arg_max(instruction_type, step) AS last_type FROM instruction_stream WHERE instruction_type <> 'UNRESOLVED' GROUP BY 1, 2", "instruction_stream")
def win_last_applied(spark, sf_dir):
    i = P.instruction_stream(spark, sf_dir).where("instruction_type <> 'UNRESOLVED'")
    return i.groupBy("agreement_id", "target_key").agg(F.max("step").alias("last_step"), F.max_by("instruction_type", "step").alias("last_type"))


@query(
    "win_false_promotion",
    """
SELECT chain_id, amendment_number FROM (SELECT *, max(CASE WHEN outcome = 'UNRESOLVED' OR size < 60 THEN 1 ELSE 0 END)
  OVER (PARTITION BY chain_id ORDER BY amendment_number) AS wrong FROM chain_step) WHERE outcome = 'RESOLVING' AND wrong = 1""",
    "chain_step",
)
def win_false_promotion(spark, sf_dir):
    """Steps held to be authoritative although they or an earlier one are incorrect."""
    wrong = F.max(((F.col("outcome") == "UNRESOLVED") | (F.col("size") < 60)).cast("int")).over(W.partitionBy("chain_id").orderBy("amendment_number"))
    return P.chain_step(spark, sf_dir).withColumn("wrong", wrong).where("outcome = 'RESOLVING' and wrong = 1").select("chain_id", "amendment_number")


@query("win_chain_authoritative", "SELECT chain_id, max(amendment_number) AS last_step, arg_max(outcome, amendment_number) = 'RESOLVING' AS authoritative FROM chain_step GROUP BY chain_id", "chain_step")
def win_chain_authoritative(spark, sf_dir):
    steps = P.chain_step(spark, sf_dir).groupBy("chain_id")
    return steps.agg(F.max("amendment_number").alias("last_step"), (F.max_by("outcome", "amendment_number") == "RESOLVING").alias("authoritative"))
