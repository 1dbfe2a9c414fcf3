"""Extraction of commitments from clauses: rules, fields, operations, values, and what goes to review.

The first rule that applies wins and says so; what no rule covers goes to a queue with a reason, never to a guess.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import projections as P
from ..functions import text as T
from ..registry import query
from .gates import first_match

_RATIO = "try_cast(nullif(regexp_extract(text, '([0-9]+[.][0-9]+) to 1[.]00', 1), '') AS DOUBLE)"
_PERCENT = "CASE WHEN len(regexp_extract_all(text, '([0-9]+[.][0-9]+)%', 1)) = 1 THEN try_cast(regexp_extract(text, '([0-9]+[.][0-9]+)%', 1) AS DOUBLE) END"
_DOLLARS = "try_cast(nullif(replace(regexp_extract(text, '[$]([0-9,]+)', 1), ',', ''), '') AS DOUBLE)"


def extract_values(texts: DataFrame) -> DataFrame:
    """Adds value, unit and rule from the first of ratio, percent and dollars that finds something."""
    t = F.col("text")
    some = lambda value, unit, rule: F.when(value.isNotNull(), F.struct(value.cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(rule).alias("rule")))
    found = F.coalesce(some(T.ratio_of(t), "x", "ratio"), some(T.percent_of(t), "%", "percent"), some(T.dollars_of(t), "USD", "dollar"))
    return texts.withColumn("f", found).select("*", "f.*").drop("f")


@query(
    "doc_extraction_rules",
    f"""
WITH v AS (SELECT document_id, {_RATIO} AS a, {_PERCENT} AS b, {_DOLLARS} AS c FROM clause)
SELECT document_id, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 'x' WHEN b IS NOT NULL THEN '%' WHEN c IS NOT NULL THEN 'USD' END AS unit,
  CASE WHEN a IS NOT NULL THEN 'ratio' WHEN b IS NOT NULL THEN 'percent' WHEN c IS NOT NULL THEN 'dollar' END AS rule FROM v""",
    "clause",
)
def doc_extraction_rules(spark, sf_dir):
    return extract_values(P.clause(spark, sf_dir)).select("document_id", "value", "unit", "rule")


@query(
    "doc_extraction_queue",
    f"""
WITH v AS (SELECT document_id, coalesce({_RATIO}, {_PERCENT}, {_DOLLARS}) AS value, regexp_extract(text, 'Section ([0-9.]+[0-9])', 1) AS section, contains(text, 'Ratio') OR contains(text, 'Expenditures') AS named FROM clause),
r AS (SELECT *, value IS NOT NULL AND section <> '' AS extracted FROM v)
SELECT section, CAST(count(*) FILTER (extracted) AS BIGINT) AS commitments, CAST(count(*) FILTER (NOT extracted AND named) AS BIGINT) AS without_value, CAST(count(*) FILTER (NOT extracted AND NOT named) AS BIGINT) AS unnamed,
  round(count(*) FILTER (extracted) / count(*), 4) AS coverage FROM r GROUP BY section""",
    "clause",
)
def doc_extraction_queue(spark, sf_dir):
    """Per section what was extracted, what waits for review and why, and the coverage."""
    rows = extract_values(P.clause(spark, sf_dir)).select(
        F.regexp_extract("text", r"Section ([0-9.]+[0-9])", 1).alias("section"), "value", (F.col("text").contains("Ratio") | F.col("text").contains("Expenditures")).alias("named")
    )
    ok = F.col("value").isNotNull() & (F.col("section") != "")
    return rows.groupBy("section").agg(
        F.count_if(ok).alias("commitments"), F.count_if(~ok & F.col("named")).alias("without_value"), F.count_if(~ok & ~F.col("named")).alias("unnamed"), F.round(F.count_if(ok) / F.count("*"), 4).alias("coverage")
    )


def find_sections(texts: DataFrame, least: int = 40) -> DataFrame:
    """Sections of each text: (document_id, section, start, end). A heading begins a line or the text; entries of
    a table of contents (too short, or ending in a page number) are no sections."""
    heading = re.compile(r"(?:^|\n)[ \t]*(?:Section|SECTION|ARTICLE|Article)[ \t]+([0-9]+(?:\.[0-9]+)*|[IVXLC]+)\b")
    page = re.compile(r"[. ]{3,}[0-9]+[ \t]*$")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = list(heading.finditer(text or ""))
                for m, end in zip(hits, [*(h.start() for h in hits[1:]), len(text or "")]):
                    body = text[m.start() : end].strip()
                    if len(body) >= least and not page.search(body.split("\n")[0]):
                        for column, value in zip(out, (doc, m.group(1), m.start(1), end)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["document_id", "section", "start", "end"])

    return texts.select(F.col("document_id").cast("long").alias("document_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "document_id long, section string, start int, end int")


@query("doc_sections", "SELECT document_id, regexp_extract(text, 'Section ([0-9.]+[0-9])', 1) AS section, CAST(length(text) AS INTEGER) AS \"end\" FROM clause WHERE length(text) >= 40", "clause")
def doc_sections(spark, sf_dir):
    return find_sections(P.clause(spark, sf_dir)).select("document_id", "section", "end")


@query("doc_clause_split", "SELECT doc_id, CAST(p AS INTEGER) AS position, sha256(s) AS clause_sha256 FROM (SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, list_filter(string_split(text, '. '), lambda x: length(x) >= 20) AS l FROM documents))")
def doc_clause_split(spark, sf_dir):
    """Sentences of some length, numbered from 1."""
    parts = F.filter(F.split("text", r"\. "), lambda s: F.length(s) >= 20)
    return P.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("p", "s")).select("doc_id", (F.col("p") + 1).alias("position"), F.sha2("s", 256).alias("clause_sha256"))


@query(
    "doc_facilities",
    """
SELECT document_id, nullif(regexp_extract(text, '[$]([0-9]+),000,000', 1), '') AS amount,
  CASE WHEN contains(text, ',000,000') THEN try_cast(regexp_extract(text, '[$]([0-9]+),000,000', 1) AS BIGINT) * 1000000 END AS dollars FROM clause WHERE contains(text, '$')""",
    "clause",
)
def doc_facilities(spark, sf_dir):
    """Amounts of facilities in dollars, millions written out."""
    t = F.col("text")
    amount = F.nullif(F.regexp_extract(t, r"[$]([0-9]+),000,000", 1), F.lit(""))
    return P.clause(spark, sf_dir).where(t.contains("$")).select("document_id", amount.alias("amount"), (amount.try_cast("long") * 1_000_000).alias("dollars"))


@query(
    "doc_context_cascade",
    """
SELECT document_id, CASE WHEN contains(text, 'Leverage Ratio') THEN 0.95 WHEN regexp_matches(text, 'Section 7[.]1[^0-9]') THEN 0.65 WHEN contains(text, 'Section 7') AND contains(text, 'Ratio') THEN 0.60 WHEN contains(text, 'Credit Agreement') THEN 0.55 END::DOUBLE AS confidence FROM clause""",
    "clause",
)
def doc_context_cascade(spark, sf_dir):
    """The strongest kind of context that resolves a clause."""
    t = F.col("text")
    tests = ((t.contains("Leverage Ratio"), 0.95), (t.rlike(r"Section 7[.]1[^0-9]"), 0.65), (t.contains("Section 7") & t.contains("Ratio"), 0.60), (t.contains("Credit Agreement"), 0.55))
    return P.clause(spark, sf_dir).select("document_id", F.coalesce(*[F.when(c, v) for c, v in tests]).alias("confidence"))


def composite_segments(texts: DataFrame) -> DataFrame:
    """(doc_id, start, composite): where the segment of the first "license" begins in the whole text, counted from 0, and
    whether its first 500 characters have capitals in a row. No segment: null and false."""
    head = F.regexp_extract("text", r"(?s)(?i:license).{0,493}", 0)
    before = F.when(head != "", F.length(F.regexp_extract("text", r"(?s)^(.*?)(?i:license)", 1)))
    return texts.select("doc_id", before.alias("start"), F.coalesce(head.rlike("[A-Z]{2,}"), F.lit(False)).alias("composite"))


@query(
    "doc_composite_segments",
    """
WITH h AS (SELECT doc_id, text, regexp_extract(text, '(?s)(?i:license).{0,493}', 0) AS head FROM documents)
SELECT doc_id, CASE WHEN head <> '' THEN CAST(strpos(text, head) - 1 AS INTEGER) END AS start, coalesce(regexp_matches(head, '[A-Z]{2,}'), false) AS composite FROM h""",
)
def doc_composite_segments(spark, sf_dir):
    """The segment wherever it begins."""
    return composite_segments(P.read(spark, sf_dir, "documents"))


def original_dates(texts: DataFrame, near: int = 100) -> DataFrame:
    """(document_id, iso) of the first date that isn't within ``near`` characters after "Amendment": the original's date."""
    date = re.compile(r"([A-Z][a-z]+) ([0-9]{1,2}), ([0-9]{4})")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                own = None
                for m in date.finditer(text or ""):
                    if m.group(1) in T.MONTHS and "Amendment" not in text[max(0, m.start() - near) : m.start()]:
                        own = f"{m.group(3)}-{T.MONTHS.index(m.group(1)) + 1:02d}-{int(m.group(2)):02d}"
                        break
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["document_id", "iso"])

    return texts.select(F.col("document_id").cast("long").alias("document_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "document_id long, iso string")


@query("doc_original_date", "SELECT document_id, CASE WHEN contains(text, 'June 30, ') THEN concat(regexp_extract(text, 'June 30, ([0-9]{4})', 1), '-06-30') WHEN contains(text, 'September 31, 2023') THEN '2023-09-31' END AS iso FROM clause", "clause")
def doc_original_date(spark, sf_dir):
    return original_dates(P.clause(spark, sf_dir))


def _operation(t: Column) -> Column:
    return first_match([(t.contains("adding"), "ADD"), (t.contains("deleted in its entirety"), "DELETE"), (t.contains("substituting"), "REPLACE"), (t.contains("restated"), "RESTATE"), (t.contains("waived"), "WAIVE")], "UNKNOWN")


_OPERATION = "CASE WHEN contains(text, 'adding') THEN 'ADD' WHEN contains(text, 'deleted in its entirety') THEN 'DELETE' WHEN contains(text, 'substituting') THEN 'REPLACE' WHEN contains(text, 'restated') THEN 'RESTATE' WHEN contains(text, 'waived') THEN 'WAIVE' ELSE 'UNKNOWN' END"


@query(
    "res_operation_values",
    f"""
SELECT document_id, {_OPERATION} AS operation, try_cast(nullif(regexp_extract(text, 'deleting "([0-9]+[.][0-9]+)', 1), '') AS DOUBLE) AS declared_old, try_cast(nullif(regexp_extract(text, 'substituting "([0-9]+[.][0-9]+)', 1), '') AS DOUBLE) AS new_value,
  CASE WHEN len(regexp_extract_all(text, '[$][0-9,]+', 0)) = 1 THEN {_DOLLARS} END AS only_dollars FROM clause""",
    "clause",
)
def res_operation_values(spark, sf_dir):
    """Operation, declared old value, new value, and a dollar amount only where there is just one."""
    t = F.col("text")
    number = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).try_cast("double")
    only = F.when(F.size(F.regexp_extract_all(t, F.lit(r"[$][0-9,]+"), F.lit(0))) == 1, T.dollars_of(t).cast("double"))
    return P.clause(spark, sf_dir).select(
        "document_id", _operation(t).alias("operation"), number(r'deleting "([0-9]+[.][0-9]+)').alias("declared_old"), number(r'substituting "([0-9]+[.][0-9]+)').alias("new_value"), only.alias("only_dollars")
    )


@query(
    "res_genre_dispatch",
    f"""
WITH g AS (SELECT document_id, text, CASE WHEN contains(text, 'restated') THEN 'restatement' WHEN contains(text, 'deleting') OR contains(text, 'adding') THEN 'incremental' WHEN contains(text, 'waived') THEN 'waiver' ELSE 'other' END AS genre FROM clause)
SELECT genre, {_OPERATION} AS operation, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1, 2""",
    "clause",
)
def res_genre_dispatch(spark, sf_dir):
    """Genre picks the adapter; one projection stands for the union of the adapters' branches."""
    t = F.col("text")
    genre = first_match([(t.contains("restated"), "restatement"), (t.contains("deleting") | t.contains("adding"), "incremental"), (t.contains("waived"), "waiver")], "other")
    return P.clause(spark, sf_dir).groupBy(genre.alias("genre"), _operation(t).alias("operation")).agg(F.count("*").alias("n"))


@query(
    "eng_value_corroboration",
    f"""
WITH v AS (SELECT document_id, text, {_RATIO} AS value FROM clause)
SELECT document_id, value, value IS NOT NULL AND contains(text, printf('%.2f', value)) AS corroborated, value IS NOT NULL AND contains(text, printf('%.1f', value)) AS short_form FROM v""",
    "clause",
)
def eng_value_corroboration(spark, sf_dir):
    """Whether a value stands in its source text in one of its written forms."""
    v = P.clause(spark, sf_dir).withColumn("value", T.ratio_of(F.col("text")))
    there = lambda f: F.coalesce(F.col("text").contains(F.format_string(f, "value")), F.lit(False)) & F.col("value").isNotNull()
    return v.select("document_id", "value", there("%.2f").alias("corroborated"), there("%.1f").alias("short_form"))


@query(
    "saf_aggregate_proof",
    """
WITH c AS (SELECT document_id, contains(text, 'Section') AS section, NOT (contains(text, 'Ratio') AND contains(text, '$')) AS type_ok, regexp_matches(text, '[0-9]+[.][0-9]+|[$]') AS value, NOT contains(text, 'modified') AS clear FROM clause)
SELECT document_id, concat_ws('; ', CASE WHEN NOT section THEN 'no section' END, CASE WHEN NOT type_ok THEN 'type' END, CASE WHEN NOT value THEN 'no value' END, CASE WHEN NOT clear THEN 'vague' END) AS reasons,
  CASE WHEN section AND type_ok AND value AND clear THEN 'SUFFICIENT' WHEN section AND type_ok AND value THEN 'CORROBORATED' WHEN section THEN 'WEAK' ELSE 'INSUFFICIENT' END AS evidence, section AND type_ok AND value AND clear AS is_safe FROM c""",
    "clause",
)
def saf_aggregate_proof(spark, sf_dir):
    """All checks of a candidate, the evidence level that they make, and whether it is safe."""
    t = F.col("text")
    checks = {"no section": t.contains("Section"), "type": ~(t.contains("Ratio") & t.contains("$")), "no value": t.rlike("[0-9]+[.][0-9]+|[$]"), "vague": ~t.contains("modified")}
    section, kind, value, clear = checks.values()
    level = first_match([(section & kind & value & clear, "SUFFICIENT"), (section & kind & value, "CORROBORATED"), (section, "WEAK")], "INSUFFICIENT")
    return P.clause(spark, sf_dir).select("document_id", F.concat_ws("; ", *[F.when(~c, n) for n, c in checks.items()]).alias("reasons"), level.alias("evidence"), (section & kind & value & clear).alias("is_safe"))


@query(
    "cls_taxonomy_buckets",
    "SELECT CASE WHEN contains(text, 'modified') THEN 'vague operation' WHEN contains(text, '1.1') AND contains(text, 'hereby') THEN 'definition' WHEN contains(text, 'restated') THEN 'restatement' WHEN contains(text, '%') THEN 'rate' ELSE 'other' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM clause GROUP BY 1",
    "clause",
)
def cls_taxonomy_buckets(spark, sf_dir):
    """Root causes; the test for section 1.1 holds for any text with it, as ordered here."""
    t = F.col("text")
    rules = [(t.contains("modified"), "vague operation"), (t.contains("1.1") & t.contains("hereby"), "definition"), (t.contains("restated"), "restatement"), (t.contains("%"), "rate")]
    return P.clause(spark, sf_dir).groupBy(first_match(rules, "other").alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "cls_eligibility",
    "SELECT document_id, CASE WHEN contains(text, 'Ratio') AND regexp_matches(text, '[0-9]') THEN 'IN' WHEN contains(text, 'deleted') THEN 'OUT' ELSE 'AMBIGUOUS' END AS eligibility, CASE WHEN contains(text, 'September 31') THEN 'protocol' WHEN contains(text, 'modified') THEN 'interpretation' ELSE 'none' END AS failure FROM clause",
    "clause",
)
def cls_eligibility(spark, sf_dir):
    t = F.col("text")
    eligibility = first_match([(t.contains("Ratio") & t.rlike("[0-9]"), "IN"), (t.contains("deleted"), "OUT")], "AMBIGUOUS")
    failure = first_match([(t.contains("September 31"), "protocol"), (t.contains("modified"), "interpretation")], "none")
    return P.clause(spark, sf_dir).select("document_id", eligibility.alias("eligibility"), failure.alias("failure"))


@query(
    "src_exhibits",
    "SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a[^>]*href', 0)) AS INTEGER) AS links, regexp_matches(html, '(?i)<table') AS has_table, contains(lower(html), 'agreement') AS candidate FROM pages",
)
def src_exhibits(spark, sf_dir):
    """What an index page links to, and whether it is a candidate."""
    h = F.col("html")
    return P.read(spark, sf_dir, "pages").select(
        "page_id", F.size(F.regexp_extract_all(h, F.lit("(?i)<a[^>]*href"), F.lit(0))).alias("links"), h.rlike("(?i)<table").alias("has_table"), F.lower(h).contains("agreement").alias("candidate")
    )
