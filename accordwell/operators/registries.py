"""Which commitment a text or a section speaks of: registries of phrases and sections, first match by priority, among the commitments in force."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import projections as P
from ..functions.text import plain_spaces
from ..registry import query

# Priority (lower is tried first), class, pattern of a phrase.
ALIASES = (
    (10, "financial_covenant.leverage_ratio", r"Total\s+Funded\s+Debt\s+to\s+EBITDA"),
    (10, "financial_covenant.leverage_ratio", r"Core\s+Leverage\s+Ratio"),
    (10, "financial_covenant.leverage_ratio", r"Total\s+Debt\s+to\s+EBITDA"),
    (10, "financial_covenant.leverage_ratio", r"Debt\s+to\s+EBITDAX"),
    (10, "financial_covenant.leverage_ratio", r"Ratio\s+of\s+Debt\s+to\s+EBITDAX"),
    (10, "financial_covenant.leverage_ratio", r"Senior\s+Funded\s+Debt\s+to\s+EBITDA"),
    (10, "financial_covenant.leverage_ratio", r"Consolidated\s+Leverage\s+Ratio"),
    (10, "financial_covenant.leverage_ratio", r"Total\s+Leverage\s+Ratio"),
    (11, "financial_covenant.leverage_ratio", r"Total\s+Leverage"),
    (5, "financial_covenant.leverage_ratio", r"Maximum\s+Total\s+Leverage\s+Ratio"),
    (8, "financial_covenant.leverage_ratio", r"Maximum\s+Leverage\s+Ratio"),
    (10, "financial_covenant.leverage_ratio", r"Long\s+Term\s+Debt\s+to\s+Long\s+Term\s+Capitalization"),
    (50, "financial_covenant.leverage_ratio", r"Leverage\s+Ratio"),
    (10, "financial_covenant.debt_service_coverage", r"Debt\s+Service\s+Coverage"),
    (5, "financial_covenant.debt_service_coverage", r"Debt\s+Service\s+Coverage\s+Ratio"),
    (10, "financial_covenant.fixed_charge_coverage", r"Fixed\s+Charge\s+Coverage"),
    (5, "financial_covenant.fixed_charge_coverage", r"Fixed\s+Charge\s+Coverage\s+Ratio"),
    (10, "financial_covenant.interest_coverage", r"Interest\s+Coverage"),
    (10, "financial_covenant.interest_coverage", r"EBIT\s+to\s+Interest\s+Ratio"),
    (5, "financial_covenant.interest_coverage", r"Interest\s+Coverage\s+Ratio"),
    (10, "financial_covenant.current_ratio", r"Current\s+Ratio"),
    (10, "financial_covenant.tangible_net_worth", r"Tangible\s+Net\s+Worth"),
    (5, "financial_covenant.tier_1_leverage_ratio", r"Tier\s+1\s+Leverage\s+Ratio"),
    (10, "financial_covenant.risk_based_capital_ratio", r"Risk.Based\s+Capital\s+Ratio"),
    (10, "financial_covenant.texas_ratio", r"Texas\s+Ratio"),
    (10, "financial_covenant.return_on_average_assets", r"Return\s+on\s+Average\s+Assets"),
    (10, "facility.revolving_facility", r"Revolving\s+(?:Loan|Facility|Credit|Commitment)"),
    (10, "facility.revolving_facility", r"Revolving\s+Facility"),
    (20, "facility.term_loan", r"Term\s+Loan"),
    (20, "facility.term_loan", r"Term\s+Commitment"),
    (10, "facility.delayed_draw_term_loan", r"Delayed\s+Draw\s+Term"),
    (5, "financial_covenant.tangible_net_worth", r"Minimum\s+Tangible\s+Net\s+Worth"),
    (10, "financial_covenant.tangible_net_worth", r"Minimum\s+Shareholders.?\s+Equity"),
    (10, "financial_covenant.tangible_net_worth", r"Minimum\s+Stockholders.?\s+Equity"),
    (10, "financial_covenant.leverage_ratio", r"Funded\s+Debt\s+to\s+EBITDA"),
    (15, "financial_covenant.leverage_ratio", r"Debt\s+to\s+EBITDA"),
    (8, "financial_covenant.leverage_ratio", r"Net\s+Leverage\s+Ratio"),
    (8, "financial_covenant.leverage_ratio", r"First\s+Lien\s+Leverage\s+Ratio"),
    (8, "financial_covenant.leverage_ratio", r"Secured\s+Leverage\s+Ratio"),
    (10, "financial_covenant.debt_service_coverage", r"Asset\s+Coverage\s+Ratio"),
    (10, "financial_covenant.current_ratio", r"Minimum\s+Working\s+Capital"),
    (10, "financial_covenant.interest_coverage", r"Minimum\s+Liquidity(?:\s+Ratio)?"),
)
# Pattern of a section's number, class.
SECTIONS = (
    (r"7\.10", "financial_covenant.leverage_ratio"),
    (r"7\.11", "financial_covenant.leverage_ratio"),
    (r"6\.10", "financial_covenant.leverage_ratio"),
    (r"6\.11", "financial_covenant.leverage_ratio"),
    (r"5\.0?1", "financial_covenant.leverage_ratio"),
    (r"9\.1\b", "financial_covenant.leverage_ratio"),
    (r"10\.1\b", "financial_covenant.leverage_ratio"),
    (r"7\.12", "financial_covenant.fixed_charge_coverage"),
    (r"6\.12", "financial_covenant.fixed_charge_coverage"),
    (r"7\.13", "financial_covenant.interest_coverage"),
    (r"6\.13", "financial_covenant.interest_coverage"),
    (r"7\.14", "financial_covenant.current_ratio"),
    (r"6\.14", "financial_covenant.current_ratio"),
    (r"7\.15", "financial_covenant.tangible_net_worth"),
    (r"6\.15", "financial_covenant.tangible_net_worth"),
    (r"7\.16", "financial_covenant.debt_service_coverage"),
    (r"6\.16", "financial_covenant.debt_service_coverage"),
    (r"2\.0?1\b", "facility.revolving_facility"),
    (r"2\.0?2\b", "facility.term_loan"),
    (r"2\.0?3\b", "facility.delayed_draw_term_loan"),
    (r"7\.0?1\b", "facility.revolving_facility"),
    (r"7\.0?2\b", "facility.term_loan"),
    (r"6\.0?1\b", "facility.revolving_facility"),
    (r"6\.0?2\b", "facility.term_loan"),
    (r"6\.0?3\b", "facility.delayed_draw_term_loan"),
)
PERCENT_CLASSES = ("financial_covenant.tier_1_leverage_ratio", "financial_covenant.risk_based_capital_ratio", "financial_covenant.texas_ratio", "financial_covenant.return_on_average_assets")
BY_TEXT, BY_SECTION, BY_SECTION_IN_STATE = 0.95, 0.70, 0.60


#: (pattern, class, how: 0 text, 1 section) in the order in which they are tried.
REGISTRY = [(p, c, 0) for _, c, p in sorted(ALIASES, key=lambda a: a[0])] + [(r"section\s+" + p, c, 1) for p, c in SECTIONS]


def class_unit(name: Column) -> Column:
    """Unit of a registered class: usd for facilities, percent or ratio for covenants; null for others."""
    known = sorted({c for _, c, _ in REGISTRY})
    return F.when(~name.isin(*known), None).when(name.startswith("facility."), "usd").when(name.isin(*PERCENT_CLASSES), "percent").otherwise("ratio")


def rare_word(pattern: str) -> str:
    """Small letters that every match of an entry's pattern has: a run of plain characters outside of groups and of what may be missing; one with a dot, else the longest."""
    plain = re.sub(r"\(\?:.*?\)\??", " ", pattern)
    plain = re.sub(r"(?:\\[sb]|.)[?*+]", " ", plain).replace("\\b", " ").replace("\\.", "\0")
    return max(re.split(r"[ .]", plain), key=lambda run: ("\0" in run, len(run))).replace("\0", ".").lower()


def matching_entries(text: Column, section: Column) -> Column:
    """Numbers of the registry's entries that match, in the order in which they are tried: one projection, whatever the registry's size. A pattern is tried only where its rarest word is."""
    subject = lambda how: plain_spaces(F.coalesce(section if how else text, F.lit("")))
    hits = [F.when(F.lower(subject(how)).contains(rare_word(pattern)) & subject(how).rlike("(?i)" + pattern), F.lit(k)) for k, (pattern, _, how) in enumerate(REGISTRY)]
    return F.array_compact(F.array(*hits))


def resolve_mentions(mentions: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """``mentions`` with canonical_id, field_hint and confidence; null, null and 0 where nothing matches.

    Columns: agreement_id, mention_id (unique), text, section_ref. With ``state`` (agreement_id, canonical_key) only commitments in force count, and an entry
    whose commitment isn't gives way to the next: matches become rows, an equi-join keeps those in force, the first of a mention is picked.
    """
    number = F.col("number")
    names = F.array(*[F.lit(c) for _, c, _ in REGISTRY])
    found = mentions.withColumn("matches", matching_entries(F.col("text"), F.col("section_ref")))
    if state is None:
        chosen = found.withColumn("number", F.get("matches", F.lit(0)))
    else:
        # outer: else a filter on the size of matches is inferred, and computes them once more where the texts are read
        rows = found.select("mention_id", "agreement_id", F.explode_outer("matches").alias("number")).withColumn("canonical_key", F.get(names, number))
        first = rows.join(state.select("agreement_id", "canonical_key").distinct(), ["agreement_id", "canonical_key"], "left_semi").groupBy("mention_id").agg(F.min("number").alias("number"))
        chosen = found.join(first, "mention_id", "left")
    by_text = sum(how == 0 for _, _, how in REGISTRY)
    sure = F.when(number < by_text, BY_TEXT).when(number.isNotNull(), BY_SECTION if state is None else BY_SECTION_IN_STATE).otherwise(0.0)
    return chosen.withColumns({"canonical_id": F.get(names, number), "field_hint": F.when(number.isNotNull(), "threshold"), "confidence": sure}).drop("matches", "number")


_PHRASES = ("the Maximum Total Leverage Ratio shall", "Tier 1  Leverage Ratio and Texas Ratio", "a Fixed Charge Coverage test, or Current Ratio", "interest coverage ratio", "Delayed Draw Term Loan", "Revolving Commitments", "Minimum Shareholders' Equity", "nothing of note", "Term\xa0Loans only", "Debt to EBITDAX", "risk-based capital ratio")
_PICK = "CASE CAST(o_orderkey % 13 AS INTEGER) " + " ".join(f"WHEN {k} THEN '{p.replace(chr(39), chr(39) * 2)}'" for k, p in enumerate(_PHRASES)) + " WHEN 11 THEN '' END"
P.SQL["mention"] = f"""
SELECT o_custkey % 25 AS agreement_id, o_orderkey AS mention_id, {_PICK} AS text, CASE WHEN o_custkey % 6 <> 0 THEN concat(CASE WHEN o_custkey % 2 = 0 THEN 'Section ' ELSE 'SECTION  ' END, CAST(o_custkey % 4 + 5 AS VARCHAR), '.', CAST(o_orderkey % 17 AS VARCHAR)) END AS section_ref FROM orders"""
P.SQL["in_state"] = "SELECT DISTINCT o_custkey % 25 AS agreement_id, c AS canonical_key FROM orders, (SELECT unnest([" + ", ".join(f"'{c}'" for c in sorted({c for _, c, _ in REGISTRY})) + "]) AS c) WHERE (o_custkey % 25 + length(c)) % 3 > 0"


def mention(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.get(F.array(*map(F.lit, (*_PHRASES, ""))), (k % 13).cast("int"))
    ref = F.concat(F.when(c % 2 == 0, "Section ").otherwise("SECTION  "), (c % 4 + 5).cast("string"), F.lit("."), (k % 17).cast("string"))
    return P.spread(P.read(spark, sf_dir, "orders").select(k, c), "o_orderkey").select((c % 25).alias("agreement_id"), k.alias("mention_id"), text.alias("text"), F.when(c % 6 != 0, ref).alias("section_ref"))


def in_state(spark, sf_dir) -> DataFrame:
    agreements = P.read(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("agreement_id")).distinct()
    names = F.explode(F.array(*map(F.lit, sorted({c for _, c, _ in REGISTRY}))))
    return agreements.withColumn("canonical_key", names).where((F.col("agreement_id") + F.length("canonical_key")) % 3 > 0)


_MATCH = (
    "WITH g(pattern, canonical_id, how, number) AS (VALUES " + ", ".join(f"('(?i){p}', '{c}', {h}, {k})" for k, (p, c, h) in enumerate(REGISTRY)) + """),
s AS (SELECT DISTINCT text AS subject, 0 AS how FROM mention UNION SELECT DISTINCT section_ref, 1 FROM mention),
hit AS (SELECT s.subject, s.how, g.canonical_id, g.number FROM s JOIN g ON g.how = s.how AND regexp_matches(translate(s.subject, chr(160), ' '), g.pattern)),
m AS (SELECT mention_id, agreement_id, canonical_id, how, number FROM mention JOIN hit ON hit.subject = CASE WHEN hit.how = 0 THEN text ELSE section_ref END)
"""
)
_FIRST = """, f AS (SELECT mention_id, arg_min(canonical_id, number) AS canonical_id, arg_min(how, number) AS how FROM m {} GROUP BY 1)
SELECT n.mention_id, f.canonical_id, CASE WHEN f.how IS NOT NULL THEN 'threshold' END AS field_hint, CAST(CASE f.how WHEN 0 THEN 0.95 WHEN 1 THEN {} ELSE 0 END AS DOUBLE) AS confidence FROM mention n LEFT JOIN f USING (mention_id)"""


@query("map_resolve_mention", _MATCH + _FIRST.format("", "0.7"), "mention")
def map_resolve_mention(spark, sf_dir):
    """The commitment that a text or its section speaks of."""
    return resolve_mentions(mention(spark, sf_dir)).select("mention_id", "canonical_id", "field_hint", "confidence")


@query("map_resolve_in_state", _MATCH + _FIRST.format("WHERE (agreement_id, canonical_id) IN (SELECT (agreement_id, canonical_key) FROM in_state)", "0.6"), "mention in_state")
def map_resolve_in_state(spark, sf_dir):
    """As before, among the commitments that the agreement has in force."""
    return resolve_mentions(mention(spark, sf_dir), in_state(spark, sf_dir)).select("mention_id", "canonical_id", "field_hint", "confidence")


@query(
    "map_class_units",
    "SELECT DISTINCT canonical_key, CASE WHEN canonical_key LIKE 'facility.%' THEN 'usd' WHEN canonical_key LIKE '%tier_1%' OR canonical_key LIKE '%risk_based%' OR canonical_key LIKE '%texas%' OR canonical_key LIKE '%average_assets' THEN 'percent' ELSE 'ratio' END AS unit FROM in_state",
    "in_state",
)
def map_class_units(spark, sf_dir):
    return in_state(spark, sf_dir).select("canonical_key").distinct().withColumn("unit", class_unit(F.col("canonical_key")))
