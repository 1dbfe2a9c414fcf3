"""Mapping clause texts to fields and commitments: ordered rules, aliases and section addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..functions import text as T
from ..registry import query
from .gates import first_match


@query(
    "scl_dates_amounts",
    """
WITH m AS (SELECT *, regexp_extract(text, '([A-Z][a-z]+) ([0-9]{1,2}), ([0-9]{4})', 1) AS mon, regexp_extract(text, '([A-Z][a-z]+) ([0-9]{1,2}), ([0-9]{4})', 2) AS d, regexp_extract(text, '([A-Z][a-z]+) ([0-9]{1,2}), ([0-9]{4})', 3) AS y,
  list_position(['January','February','March','April','May','June','July','August','September','October','November','December'], regexp_extract(text, '([A-Z][a-z]+) ([0-9]{1,2}), ([0-9]{4})', 1)) AS k FROM clause)
SELECT document_id, CASE WHEN k > 0 THEN concat(lpad(y, 4, '0'), '-', lpad(CAST(k AS VARCHAR), 2, '0'), '-', lpad(d, 2, '0')) END AS iso,
  try_cast(nullif(regexp_extract(text, '([0-9]+\\.[0-9]+) to 1\\.00', 1), '') AS DOUBLE) AS ratio,
  CASE WHEN len(regexp_extract_all(text, '([0-9]+\\.[0-9]+)%', 1)) = 1 THEN try_cast(regexp_extract(text, '([0-9]+\\.[0-9]+)%', 1) AS DOUBLE) END AS percent,
  try_cast(nullif(replace(regexp_extract(text, '\\$([0-9,]+)', 1), ',', ''), '') AS BIGINT) AS dollars,
  CASE WHEN contains(lower(text), 'not exceed') OR contains(lower(text), 'maximum') THEN '<=' WHEN contains(lower(text), 'minimum') OR contains(lower(text), 'maintain') THEN '>=' END AS direction FROM m""",
    "clause",
)
def scl_dates_amounts(spark, sf_dir):
    t = F.col("text")
    return P.clause(spark, sf_dir).select(
        "document_id", T.iso_date(t).alias("iso"), T.ratio_of(t).alias("ratio"), T.percent_of(t).alias("percent"), T.dollars_of(t).alias("dollars"), T.direction_of(t).alias("direction")
    )


@query(
    "map_rules_first_match",
    """
SELECT document_id, CASE WHEN contains(text, 'substituting') AND contains(text, 'to 1.00') THEN 'threshold' WHEN regexp_matches(text, 'waived until') THEN 'applicability' WHEN regexp_matches(text, '[0-9]+\\.[0-9]+%') THEN 'rate'
  WHEN contains(text, 'adding the following') THEN 'exceptions' ELSE 'UNKNOWN_COMMITMENT' END AS field FROM clause""",
    "clause",
)
def map_rules_first_match(spark, sf_dir):
    """Ordered rules; what none matches is unknown, never guessed."""
    t = F.col("text")
    rules = [(t.contains("substituting") & t.contains("to 1.00"), "threshold"), (t.rlike("waived until"), "applicability"), (t.rlike(r"[0-9]+\.[0-9]+%"), "rate"), (t.contains("adding the following"), "exceptions")]
    return P.clause(spark, sf_dir).select("document_id", first_match(rules, "UNKNOWN_COMMITMENT").alias("field"))


#: Aliases of commitment classes with their priorities. Fixed values.
ALIASES = ((1, "LEVERAGE", "Leverage Ratio"), (2, "COVERAGE", "Interest Coverage"), (3, "CAPEX", "Capital Expenditures"), (4, "GENERIC_RATIO", "Ratio"), (5, "AGREEMENT", "Credit Agreement"))


def resolve_alias(texts: DataFrame, in_state: tuple[str, ...]) -> DataFrame:
    """The alias of highest priority in each text whose class is in the state, at 0.95; a registry of a few lines becomes one expression."""
    hit = F.coalesce(*[F.when(F.col("text").contains(phrase), name) for _, name, phrase in sorted(ALIASES) if name in in_state])
    return texts.select("document_id", hit.alias("alias"), F.when(hit.isNotNull(), 0.95).alias("confidence"))


@query(
    "map_alias_priority",
    """
WITH a(priority, class, phrase) AS (VALUES (1, 'LEVERAGE', 'Leverage Ratio'), (3, 'CAPEX', 'Capital Expenditures'), (4, 'GENERIC_RATIO', 'Ratio'))
SELECT c.document_id, arg_min(a.class, a.priority) AS alias, CASE WHEN min(a.priority) IS NOT NULL THEN 0.95 END::DOUBLE AS confidence FROM clause c LEFT JOIN a ON contains(c.text, a.phrase) GROUP BY 1""",
    "clause",
)
def map_alias_priority(spark, sf_dir):
    return resolve_alias(P.clause(spark, sf_dir), ("LEVERAGE", "CAPEX", "GENERIC_RATIO"))


def resolve_address(questions: DataFrame, addresses: DataFrame) -> DataFrame:
    """The address (section, key, seq) that a question (q_id, q) means: equal, else one that continues it, else one that it continues.

    Every prefix of both sides at a dot becomes a row, so that the prefix tests are equi-joins; the best tier wins, then the
    earliest address.
    """

    def prefixes(c: str):
        parts = F.split(c, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))

    tier = lambda df, n: df.select("q_id", "key", F.struct(F.lit(n).alias("tier"), "seq").alias("rank"))
    equal = tier(questions.join(addresses, F.col("q") == F.col("section")), 1)
    longer = addresses.withColumn("p", F.explode(prefixes("section"))).where("p <> section")
    continues = tier(questions.join(longer, F.col("q") == F.col("p")), 2)
    shorter = questions.withColumn("p", F.explode(prefixes("q"))).where("p <> q")
    continued = tier(shorter.join(addresses, F.col("p") == F.col("section")), 3)
    return equal.unionAll(continues).unionAll(continued).groupBy("q_id").agg(F.min_by("key", "rank").alias("key"), F.min("rank")["tier"].alias("tier"))


_ADDRESS = """
WITH a AS (SELECT concat('7.', CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN '.1' ELSE '' END) AS section, p_brand AS key, min(p_partkey) AS seq FROM part WHERE p_size <= 30 GROUP BY 1, 2),
q AS (SELECT s_suppkey AS q_id, concat('7.', CAST(s_suppkey % 40 AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN '.1' ELSE '' END) AS q FROM supplier)
"""


@query(
    "map_prefix_address",
    _ADDRESS
    + """SELECT q_id, arg_min(key, CAST(tier AS BIGINT) * 1000000000 + seq) AS key, min(tier) AS tier FROM (
SELECT q_id, key, seq, CASE WHEN q = section THEN 1 WHEN starts_with(section, q || '.') THEN 2 WHEN starts_with(q, section || '.') THEN 3 END AS tier FROM q, a) WHERE tier IS NOT NULL GROUP BY q_id""",
)
def map_prefix_address(spark, sf_dir):
    section = F.concat(F.lit("7."), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".1").otherwise(""))
    a = P.read(spark, sf_dir, "part").where("p_size <= 30").groupBy(section.alias("section"), F.col("p_brand").alias("key")).agg(F.min("p_partkey").alias("seq"))
    q = F.concat(F.lit("7."), (F.col("s_suppkey") % 40).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".1").otherwise(""))
    return resolve_address(P.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("q_id"), q.alias("q")), a)


@query(
    "res_validators",
    """
SELECT document_id, concat_ws(';', CASE WHEN NOT contains(text, 'Section') THEN 'no target' END, CASE WHEN NOT regexp_matches(text, '[0-9]+\\.[0-9]+ to 1|[$]|%') THEN 'no value' END,
  CASE WHEN contains(text, 'September 31') THEN 'impossible date' END, CASE WHEN length(text) < 60 THEN 'too short' END) AS failures FROM clause""",
    "clause",
)
def res_validators(spark, sf_dir):
    """The list of deterministic validators that a candidate fails."""
    t = F.col("text")
    tests = {"no target": ~t.contains("Section"), "no value": ~t.rlike(r"[0-9]+\.[0-9]+ to 1|[$]|%"), "impossible date": t.contains("September 31"), "too short": F.length(t) < 60}
    return P.clause(spark, sf_dir).select("document_id", F.concat_ws(";", *[F.when(c, n) for n, c in tests.items()]).alias("failures"))


@query(
    "res_failed_step",
    """
SELECT document_id, CASE WHEN NOT contains(text, 'amended') AND NOT contains(text, 'waived') THEN 'operation' WHEN NOT regexp_matches(text, 'Ratio|to 1[.]00|[$]|%') THEN 'field' WHEN NOT regexp_matches(text, '[0-9]+[.][0-9]+ to 1[.]00|[$][0-9]') THEN 'new_value' ELSE 'resolved' END AS step FROM clause""",
    "clause",
)
def res_failed_step(spark, sf_dir):
    """Staged resolution: the first step that fails."""
    t = F.col("text")
    rules = [(~t.contains("amended") & ~t.contains("waived"), "operation"), (~t.rlike("Ratio|to 1[.]00|[$]|%"), "field"), (~t.rlike("[0-9]+[.][0-9]+ to 1[.]00|[$][0-9]"), "new_value")]
    return P.clause(spark, sf_dir).select("document_id", first_match(rules, "resolved").alias("step"))


@query(
    "map_span_gold_match",
    """
WITH s AS (SELECT l_orderkey AS d, l_returnflag AS kind, CAST(l_partkey % 300 AS INTEGER) AS b, CAST(l_partkey % 300 + l_quantity AS INTEGER) AS e, l_partkey * 10 + l_linenumber AS id, l_linenumber <= 3 AS gold FROM lineitem),
m AS (SELECT g.d, g.id AS gold_id, p.id AS pred_id, row_number() OVER (PARTITION BY g.d, g.id ORDER BY abs(g.b - p.b), p.id) AS rg, row_number() OVER (PARTITION BY p.d, p.id ORDER BY abs(g.b - p.b), g.id) AS rp
  FROM s g JOIN s p ON g.d = p.d AND g.kind = p.kind AND g.gold AND NOT p.gold AND g.b < p.e AND p.b < g.e)
SELECT d AS document_id, gold_id, pred_id FROM m WHERE rg = 1 AND rp = 1""",
)
def map_span_gold_match(spark, sf_dir):
    """One-to-one matches of gold and predicted spans of one type that intersect: each must be the other's nearest."""
    start = (F.col("l_partkey") % 300).cast("int")
    s = P.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("kind"), start.alias("b"), (start + F.col("l_quantity")).cast("int").alias("e"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), "l_linenumber"
    )
    g, p = s.where("l_linenumber <= 3").alias("g"), s.where("l_linenumber > 3").alias("p")
    on = (F.col("g.document_id") == F.col("p.document_id")) & (F.col("g.kind") == F.col("p.kind")) & (F.col("g.b") < F.col("p.e")) & (F.col("p.b") < F.col("g.e"))
    m = g.join(p, on).select(F.col("g.document_id").alias("document_id"), F.col("g.id").alias("gold_id"), F.col("p.id").alias("pred_id"), F.abs(F.col("g.b") - F.col("p.b")).alias("gap"))
    m = m.groupBy("document_id", "gold_id", "pred_id").agg(F.min("gap").alias("gap"))  # ids that repeat in a document are one span here, else each side may take another copy and the match be lost
    nearest = lambda own, other: F.row_number().over(W.partitionBy("document_id", own).orderBy("gap", other))
    return m.withColumns({"rg": nearest("gold_id", "pred_id"), "rp": nearest("pred_id", "gold_id")}).where("rg = 1 and rp = 1").select("document_id", "gold_id", "pred_id")
