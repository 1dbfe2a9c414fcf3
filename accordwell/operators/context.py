"""What an agreement's own texts say about the commitment that an instruction means: headings of its sections and its defined terms.

Terms and headings become a dictionary for each agreement. An instruction's text finds the agreement's terms by an equi-join on the
hash of their first words (one or two), of which a text has two for each word; the term is then compared as a whole. Candidates come
in order: the text itself, the section's commitments, defined terms (the longest first), the section's heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import projections as P
from ..functions.text import plain_spaces
from ..registry import query
from .registries import _MATCH, in_state, resolve_mentions

# The wordings of definitions and headings, and what each kind of candidate is worth.
DEFINED_TERM = r'(?i)["\x{201c}]([A-Z][A-Za-z\s]{2,60})["\x{201d}]\s*(?:shall\s+)?means?\s+(.{10,200}?)[.;]'
SECTION_HEADING = r"(?i)Section\s+(\d+\.\d+)\s*\.?\s+([A-Z][^\n]{3,80}?)\s*[.\n]"
BY_CONTEXT_SECTION, BY_TERM, BY_HEADING = 0.65, 0.60, 0.55


def _pairs(texts: DataFrame, pattern: str, names: tuple[str, str]) -> DataFrame:
    """(agreement_id, two groups of every match); of equal first groups the one of the last text, and there the last, counts."""
    t = plain_spaces(F.col("text"))
    groups = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(pattern), F.lit(k)).alias(n) for k, n in enumerate(names, 1)])
    found = texts.select("agreement_id", "document_id", F.posexplode(groups).alias("at", "m")).select("agreement_id", "document_id", "at", *[F.trim(F.col("m")[n]).alias(n) for n in names])
    return found.groupBy("agreement_id", names[0]).agg(F.max_by(names[1], F.struct("document_id", "at")).alias(names[1]), F.min(F.struct("document_id", "at")).alias("first"))


def defined_terms(texts: DataFrame) -> DataFrame:
    """(agreement_id, term, definition, first) of the terms that an agreement's texts (agreement_id, document_id, text) define."""
    return _pairs(texts, DEFINED_TERM, ("term", "definition"))


def section_headings(texts: DataFrame) -> DataFrame:
    """(agreement_id, number, heading, first) of an agreement's numbered sections."""
    return _pairs(texts, SECTION_HEADING, ("number", "heading"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(plain_spaces(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms_in_texts(texts: DataFrame, terms: DataFrame, id_column: str) -> DataFrame:
    """(id_column, agreement_id, term, definition, first) for each text (id_column, agreement_id, text) and term of its agreement that it contains, without regard to case, beginning with a word."""
    key = lambda words, n: F.xxhash64(F.array_join(F.slice(words, F.lit(1), n), " "))
    own = _words(F.col("term"))
    known = terms.select("agreement_id", "term", "definition", "first", key(own, F.least(F.lit(2), F.size(own))).alias("key"))
    words = texts.select(id_column, "agreement_id", F.lower(plain_spaces(F.coalesce("text", F.lit("")))).alias("low")).withColumn("w", _words(F.col("low")))
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array(F.xxhash64(F.get("w", i - 1)), F.xxhash64(F.array_join(F.slice("w", i, F.lit(2)), " ")))))
    asked = words.where(F.size("w") > 0).select(id_column, "agreement_id", "low", F.explode(F.array_distinct(starts)).alias("key"))
    met = asked.join(known, ["agreement_id", "key"]).where(F.col("low").contains(F.lower("term")))
    return met.select(id_column, "agreement_id", "term", "definition", "first")


def resolve_in_context(mentions: DataFrame, texts: DataFrame, state: DataFrame) -> DataFrame:
    """``mentions`` (agreement_id, mention_id, text, section_ref) with canonical_id, field_hint, confidence and how: text, section, term or heading; null, null, 0 and null if nothing resolves.

    ``texts``: agreement_id, document_id, text. ``state``: agreement_id, canonical_key. A text without agreement or words finds nothing but by its section.
    """
    held = state.select("agreement_id", F.col("canonical_key").alias("canonical_id")).distinct()
    names = ["mention_id", "canonical_id", "field_hint", "confidence"]
    direct = resolve_mentions(mentions, state).where("confidence > 0").select(*names, F.lit(1).alias("step"), F.struct(F.lit(0).alias("a"), F.lit("").alias("b")).alias("o"))
    heads = section_headings(texts)
    head_row = F.struct("agreement_id", "number")
    asked = mentions.select("mention_id", "agreement_id", F.regexp_extract(F.coalesce("section_ref", F.lit("")), r"(\d+\.\d+)", 1).alias("number")).where("number <> ''")

    def resolved(rows: DataFrame, key: Column, text: Column, section: Column, of: DataFrame | None) -> DataFrame:
        return resolve_mentions(rows.select("agreement_id", key.alias("mention_id"), text.alias("text"), section.alias("section_ref")), of).where("confidence > 0").select("mention_id", "canonical_id")

    none = F.lit(None).cast("string")
    by_number = resolved(heads, head_row, none, F.concat(F.lit("Section "), "number"), None).withColumn("rank", F.lit(0))
    by_words = resolved(heads, head_row, F.col("heading"), none, None).withColumn("rank", F.lit(1))
    candidates = by_number.unionAll(by_words).select("mention_id.*", "canonical_id", "rank")
    section = asked.join(candidates.join(held, ["agreement_id", "canonical_id"]), ["agreement_id", "number"])
    second = section.select("mention_id", "canonical_id", F.lit("threshold"), F.lit(BY_CONTEXT_SECTION), F.lit(2), F.struct("rank", F.lit("")))
    used = terms_in_texts(mentions, defined_terms(texts), "mention_id")
    defined = used.select("agreement_id", "definition").distinct()
    meaning = resolved(defined, F.struct("agreement_id", "definition"), F.col("definition"), none, state).select("mention_id.*", F.col("canonical_id"))
    third = used.join(meaning, ["agreement_id", "definition"]).select("mention_id", "canonical_id", F.lit("threshold"), F.lit(BY_TERM), F.lit(3), F.struct(-F.length("term"), F.lower("term")))
    title = resolved(heads, head_row, F.col("heading"), none, state).select("mention_id.*", "canonical_id")
    fourth = asked.join(title, ["agreement_id", "number"]).select("mention_id", "canonical_id", F.lit("threshold"), F.lit(BY_HEADING), F.lit(4), F.struct(F.lit(0), F.lit("")))
    every = direct.unionAll(second).unionAll(third).unionAll(fourth)
    best = every.groupBy("mention_id").agg(F.min_by(F.struct("canonical_id", "field_hint", "confidence", "step"), F.struct("step", "o")).alias("x"))
    how = F.coalesce(*[F.when(F.col("x.step") == k, n) for k, n in enumerate(("text", "section", "term", "heading"), 1)])
    return mentions.join(best, "mention_id", "left").select(*mentions.columns, "x.canonical_id", "x.field_hint", F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"), how.alias("how"))


_DEFINITIONS = (
    '"Covered Ratio" means the Total Leverage Ratio of the Borrower. "Senior Covered Ratio" shall mean the Interest Coverage Ratio of the Group;\nSection 7.31 Fixed Charge Coverage Ratio.\nSection 7.32 Other Matters.\n',
    '"Covered Ratio" means the Texas Ratio at any time. “Test Line” means Revolving Commitments of the Lenders.\nSection 7.31 Interest Coverage Ratio and Texas Ratio.\n',
    'Section 9.9 Nothing of Note.\nThe "Words" mean nothing at all.\n',
)
_SAYS = ("the Total Leverage Ratio shall be 4.0", "the senior covered ratio is 3.0", "The Covered Ratio may rise", "a Test Line of two", "no commitment here", "uncovered ratio", "Covered\xa0Ratio", "")
_quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
P.SQL["agreement_words"] = "SELECT o_orderkey AS document_id, o_custkey % 25 AS agreement_id, CASE o_custkey % 25 % 4 " + " ".join(f"WHEN {k} THEN {_quote(t)}" for k, t in enumerate(_DEFINITIONS)) + " END AS text FROM orders"
P.SQL["said"] = "SELECT o_orderkey AS mention_id, o_custkey % 25 AS agreement_id, CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN {_quote(t)}" for k, t in enumerate(_SAYS)) + " END AS text, CASE o_orderkey % 7 WHEN 0 THEN 'Section 7.31' WHEN 1 THEN 'Section 7.32(a)' WHEN 2 THEN 'Section 9.9' WHEN 3 THEN 'Article' END AS section_ref FROM orders"


def context_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = P.read(spark, sf_dir, "orders")
    k, a = F.col("o_orderkey"), F.col("o_custkey") % 25
    texts = o.select(k.alias("document_id"), a.alias("agreement_id"), F.get(F.array(*map(F.lit, _DEFINITIONS)), (a % 4).cast("int")).alias("text"))
    ref = F.when(k % 7 == 0, "Section 7.31").when(k % 7 == 1, "Section 7.32(a)").when(k % 7 == 2, "Section 9.9").when(k % 7 == 3, "Article")
    return o.select(k.alias("mention_id"), a.alias("agreement_id"), F.get(F.array(*map(F.lit, _SAYS)), (k % 8).cast("int")).alias("text"), ref.alias("section_ref")), texts


_REGISTRY_SQL = _MATCH[: _MATCH.index("s AS (SELECT DISTINCT")].rstrip().rstrip(",")
_CONTEXT = (
    _REGISTRY_SQL
    + r""", terms AS (SELECT DISTINCT agreement_id, s.a AS term, s.b AS definition FROM (SELECT agreement_id, regexp_extract(d, '(?i)["“]([A-Z][A-Za-z\s]{2,60})["”]\s*(?:shall\s+)?means?\s+(.{10,200}?)[.;]', ['a', 'b']) AS s
  FROM (SELECT agreement_id, unnest(regexp_extract_all(text, '(?i)["“][A-Z][A-Za-z\s]{2,60}["”]\s*(?:shall\s+)?means?\s+.{10,200}?[.;]')) AS d FROM agreement_words))),
heads AS (SELECT DISTINCT agreement_id, regexp_extract(d, '(?i)Section\s+(\d+\.\d+)', 1) AS number, trim(regexp_extract(d, '(?i)Section\s+\d+\.\d+\s*\.?\s+([A-Z][^\n]{3,80}?)\s*[.\n]', 1)) AS heading
  FROM (SELECT agreement_id, unnest(regexp_extract_all(text, '(?i)Section\s+\d+\.\d+\s*\.?\s+[A-Z][^\n]{3,80}?\s*[.\n]')) AS d FROM agreement_words)),
asked AS (SELECT *, translate(coalesce(text, ''), chr(160), ' ') AS t, regexp_extract(coalesce(section_ref, ''), '(\d+\.\d+)', 1) AS num FROM said),
subjects AS (SELECT DISTINCT t AS subject, 0 AS how FROM asked UNION SELECT DISTINCT section_ref, 1 FROM asked UNION SELECT definition, 0 FROM terms UNION SELECT heading, 0 FROM heads UNION SELECT 'Section ' || number, 1 FROM heads),
hit AS (SELECT s.subject, s.how, g.canonical_id, g.number FROM subjects s JOIN g ON g.how = s.how AND regexp_matches(s.subject, g.pattern)),
anyhit AS (SELECT subject, how, arg_min(canonical_id, number) AS canonical_id FROM hit GROUP BY 1, 2),
every AS (
  SELECT mention_id, canonical_id, CASE how WHEN 0 THEN 0.95 ELSE 0.60 END AS confidence, 1 AS step, number AS o FROM asked JOIN hit ON hit.subject = CASE WHEN hit.how = 0 THEN t ELSE section_ref END WHERE (agreement_id, canonical_id) IN (SELECT (agreement_id, canonical_key) FROM in_state)
  UNION ALL SELECT mention_id, canonical_id, 0.65, 2, 1 - how FROM asked a JOIN heads h ON h.agreement_id = a.agreement_id AND h.number = a.num JOIN anyhit x ON x.subject = CASE WHEN x.how = 1 THEN 'Section ' || h.number ELSE h.heading END WHERE (a.agreement_id, canonical_id) IN (SELECT (agreement_id, canonical_key) FROM in_state)
  UNION ALL SELECT mention_id, canonical_id, 0.60, 3, number - 1000 * length(term) FROM asked a JOIN terms m ON m.agreement_id = a.agreement_id AND regexp_matches(lower(t), '(^|[^a-z0-9])' || lower(term)) JOIN hit x ON x.how = 0 AND x.subject = m.definition WHERE (a.agreement_id, canonical_id) IN (SELECT (agreement_id, canonical_key) FROM in_state)
  UNION ALL SELECT mention_id, canonical_id, 0.55, 4, x.number FROM asked a JOIN heads h ON h.agreement_id = a.agreement_id AND h.number = a.num JOIN hit x ON x.how = 0 AND x.subject = h.heading WHERE (a.agreement_id, canonical_id) IN (SELECT (agreement_id, canonical_key) FROM in_state)),
best AS (SELECT mention_id, arg_min(canonical_id, (step, o)) AS canonical_id, arg_min(confidence, (step, o)) AS confidence, min(step) AS step FROM every GROUP BY 1)
"""
)


@query("map_resolve_in_context", _CONTEXT + "SELECT mention_id, canonical_id, CASE WHEN step IS NOT NULL THEN 'threshold' END AS field_hint, CAST(coalesce(confidence, 0) AS DOUBLE) AS confidence, ['text', 'section', 'term', 'heading'][step] AS how FROM said LEFT JOIN best USING (mention_id)", "agreement_words said in_state")
def map_resolve_in_context(spark, sf_dir):
    """The commitment that an instruction means: by its text, its section, a defined term or its section's heading."""
    mentions, texts = context_tables(spark, sf_dir)
    return resolve_in_context(mentions, texts, in_state(spark, sf_dir)).select("mention_id", "canonical_id", "field_hint", "confidence", "how")


@query("doc_defined_terms", _CONTEXT + "SELECT agreement_id, term, definition FROM terms", "agreement_words said in_state")
def doc_defined_terms(spark, sf_dir):
    """The dictionary of each agreement."""
    return defined_terms(context_tables(spark, sf_dir)[1]).select("agreement_id", "term", "definition")
