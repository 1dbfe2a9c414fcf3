"""Document table functions: texts from markup, segments, instructions and genres.

Native functions throughout; patterns keep to what every common regular expression engine reads alike. Where spans in
the text are needed, ``instruction_spans`` reads them in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import projections as P
from ..functions.text import FREQUENT, character_references, plain_spaces
from ..registry import query
from .gates import first_match

def html_to_text(html: Column) -> Column:
    """Scripts, styles, comments and tags go, character references are resolved, no-break and other spaces become plain, lines are trimmed and blank ones dropped."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    out = plain_spaces(character_references(F.regexp_replace(out, r"<[^>]*>", "\n")))
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")


_BARE = "regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g')"
_NAMES = "MAP {" + ", ".join(f"'{n}': chr({ord(c)})" for n, c in FREQUENT.items()) + "}"
_NAME = "regexp_extract(x, '^([A-Za-z][A-Za-z0-9]*);?', 1)"
# names that may lack their semicolon are among the frequent ones in this SQL
_TEXT = f"""translate(string_split({_BARE}, '&')[1] || array_to_string(list_transform(string_split({_BARE}, '&')[2:], lambda x: CASE WHEN names[{_NAME}] IS NOT NULL THEN names[{_NAME}] || regexp_replace(x, '^[A-Za-z0-9]+;?', '') ELSE '&' || x END), ''), chr(160), ' ')"""
_TEXT = f"array_to_string(list_filter(list_transform(string_split({_TEXT}, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> ''), chr(10))"


@query("doc_html_to_text", f"WITH t AS (SELECT page_id, {_TEXT} AS text FROM pages, (SELECT {_NAMES} AS names)) SELECT page_id, sha256(text) AS text_sha256, CAST(length(text) AS INTEGER) AS n_chars FROM t")
def doc_html_to_text(spark, sf_dir):
    text = P.read(spark, sf_dir, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))
    return text.select("page_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("n_chars"))


@query(
    "doc_redline_strip",
    "SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<s>.*?</s>|<del>.*?</del>', '', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS text_sha256 FROM pages",
)
def doc_redline_strip(spark, sf_dir):
    """Struck-out passages go with their text, other tags without, white space collapses."""
    out = F.regexp_replace("html", r"(?is)<s>.*?</s>|<del>.*?</del>", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return P.read(spark, sf_dir, "pages").select("page_id", F.sha2(out, 256).alias("text_sha256"))


@query("doc_sha256_dedupe", "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies, CAST(max(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY 1")
def doc_sha256_dedupe(spark, sf_dir):
    """A stored document per content hash."""
    d = P.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n"))
    return d.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n").alias("n_bytes"))


#: The operative phrases of amendments, in order of priority, free of look-around. Fixed values.
GRAMMAR = (
    ("REPLACE_TEXT", r'by deleting "[^"]*" and substituting "[^"]*"'),
    ("ADD", r"by adding the following"),
    ("DELETE", r"deleted in its entirety"),
    ("RESTATE_SECTION", r"amended and restated in its entirety"),
    ("WAIVE_TEMPORARILY", r"waived until"),
    ("UNRESOLVED", r"modified by"),
)


@query(
    "doc_parse_grammar",
    "SELECT document_id, "
    + "CASE "
    + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in GRAMMAR)
    + " END AS instruction_type, regexp_extract(text, 'Section ([0-9.]+[0-9])', 1) AS section, nullif(regexp_extract(text, 'deleting \"([^\"]*)\"', 1), '') AS old_text, nullif(regexp_extract(text, 'substituting \"([^\"]*)\"', 1), '') AS new_text FROM clause",
    "clause",
)
def doc_parse_grammar(spark, sf_dir):
    """Instruction type, section and old and new text of each clause."""
    kind = first_match([(F.col("text").rlike(p), n) for n, p in GRAMMAR], "")
    part = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return P.clause(spark, sf_dir).select(
        "document_id",
        F.nullif(kind, F.lit("")).alias("instruction_type"),
        F.regexp_extract("text", r"Section ([0-9.]+[0-9])", 1).alias("section"),
        part(r'deleting "([^"]*)"').alias("old_text"),
        part(r'substituting "([^"]*)"').alias("new_text"),
    )


def instruction_spans(texts: DataFrame) -> DataFrame:
    """(document_id, instruction_type, start, end) of every phrase of the grammar, overlaps removed.

    Of phrases that begin together the one of higher priority, then the longer; a phrase that begins before the
    last kept one ends goes. Offsets count code points from 0.
    """
    patterns = [(n, re.compile(p, re.I | re.S)) for n, p in GRAMMAR]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"document_id": [], "instruction_type": [], "start": [], "end": []}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = sorted((m.start(), rank, m.start() - m.end(), name, m.end()) for rank, (name, p) in enumerate(patterns) for m in p.finditer(text or ""))
                free = 0
                for start, _, _, name, end in hits:
                    if start >= free:
                        free = end
                        for column, value in zip(out.values(), (doc, name, start, end)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["document_id"], pa.int64()), pa.array(out["instruction_type"], pa.string()), pa.array(out["start"], pa.int32()), pa.array(out["end"], pa.int32())], names=list(out))

    return texts.select(F.col("document_id").cast("long").alias("document_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "document_id long, instruction_type string, start int, end int")


_SPAN = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN instr(text, regexp_extract(text, '{p}', 0)) - 1" for _, p in GRAMMAR) + " END"


@query("doc_instruction_spans", f"SELECT document_id, CAST({_SPAN} AS INTEGER) AS start FROM clause WHERE {_SPAN} IS NOT NULL", "clause")
def doc_instruction_spans(spark, sf_dir):
    return instruction_spans(P.clause(spark, sf_dir)).select("document_id", "start")


def drop_overlaps(spans: DataFrame) -> DataFrame:
    """Greedy overlap removal per document over (document_id, start, end, priority), as a fold over the document's sorted spans."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "priority", (-(F.col("end") - F.col("start"))).alias("minus"), "end")))
    first = F.struct(F.lit(-1).alias("free"), F.expr("cast(array() as array<struct<start:int,priority:int,minus:int,end:int>>)").alias("kept"))
    fold = F.aggregate(
        ordered, first, lambda a, s: F.when(s["start"] >= a["free"], F.struct(s["end"].alias("free"), F.array_append(a["kept"], s).alias("kept"))).otherwise(a), lambda a: a["kept"]
    )
    return spans.groupBy("document_id").agg(fold.alias("kept")).select("document_id", F.explode("kept").alias("k")).select("document_id", "k.start", "k.end", "k.priority")


_SPANS = "SELECT l_orderkey AS document_id, CAST(l_partkey % 300 AS INTEGER) AS start, CAST(l_partkey % 300 + l_quantity AS INTEGER) AS \"end\", CAST(l_linenumber AS INTEGER) AS priority FROM lineitem"


@query(
    "doc_overlap_dedupe",
    f"""
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY start, priority, start - "end", "end") AS n FROM ({_SPANS})),
f AS (SELECT document_id, n, start, "end", priority, "end" AS free, true AS kept FROM s WHERE n = 1
  UNION ALL SELECT s.document_id, s.n, s.start, s."end", s.priority, CASE WHEN s.start >= f.free THEN s."end" ELSE f.free END, s.start >= f.free FROM f JOIN s ON s.document_id = f.document_id AND s.n = f.n + 1)
SELECT document_id, start, "end", priority FROM f WHERE kept""",
)
def doc_overlap_dedupe(spark, sf_dir):
    start = (F.col("l_partkey") % 300).cast("int")
    spans = P.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), start.alias("start"), (start + F.col("l_quantity")).cast("int").alias("end"), F.col("l_linenumber").cast("int").alias("priority")
    )
    return drop_overlaps(spans)


@query("doc_context_window", "SELECT doc_id, trim(substring(text, greatest(1, strpos(text, 'the') - 50), 100), ' ') AS context FROM documents WHERE strpos(text, 'the') > 0")
def doc_context_window(spark, sf_dir):
    """Fifty characters on each side of the first hit."""
    at = F.instr("text", "the")
    d = P.read(spark, sf_dir, "documents").where(at > 0)
    return d.select("doc_id", F.trim(F.substring("text", F.greatest(F.lit(1), at - 50), F.lit(100))).alias("context"))


@query(
    "doc_segment",
    """
WITH m AS (SELECT doc_id, length(text) AS n, strpos(text, chr(10)) AS head, strpos(text, 'License') AS tail FROM documents)
SELECT doc_id, CAST(CASE WHEN head = 0 THEN 0 ELSE head END AS INTEGER) AS body_start, CAST(CASE WHEN tail > head THEN tail - 1 ELSE n END AS INTEGER) AS body_end, CASE WHEN head = 0 THEN 'whole' WHEN tail > head THEN 'composite' ELSE 'body' END AS kind FROM m""",
)
def doc_segment(spark, sf_dir):
    """Where the body begins and ends, by the first markers."""
    m = P.read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.instr("text", "\n").alias("head"), F.instr("text", "License").alias("tail"))
    return m.select(
        "doc_id",
        F.col("head").alias("body_start"),
        F.when(F.col("tail") > F.col("head"), F.col("tail") - 1).otherwise(F.col("n")).alias("body_end"),
        F.when(F.col("head") == 0, "whole").when(F.col("tail") > F.col("head"), "composite").otherwise("body").alias("kind"),
    )


#: Genre signatures over a text's head; a terminal genre wins at once, else the last that matches. Fixed values.
SIGNATURES = (("table", r" \| ", False), ("shouting", r"[A-Z]{4,}!!", True), ("licensed", r"License", False), ("junk", r"[a-z](###|&&&|\$\$\$)", True), ("links", r"https?://", False))


@query(
    "doc_genre_classify",
    "WITH h AS (SELECT doc_id, substring(text, 1, 200000) AS t FROM documents) SELECT doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p, last in SIGNATURES if last)
    + " ".join(f" WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p, last in reversed(SIGNATURES) if not last)
    + " ELSE 'plain' END AS genre FROM h",
)
def doc_genre_classify(spark, sf_dir):
    head = P.read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 200000).alias("t"))
    order = [s for s in SIGNATURES if s[2]] + [s for s in reversed(SIGNATURES) if not s[2]]
    return head.select("doc_id", first_match([(F.col("t").rlike(p), n) for n, p, _ in order], "plain").alias("genre"))


@query("doc_accession", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(lpad(CAST(page_id AS VARCHAR), 18, '0'), '^(.{10})(.{2})(.{6})$', '\\1-\\2-\\3') AS accession FROM pages")
def doc_accession(spark, sf_dir):
    """Accession numbers in 10-2-6 form."""
    number = F.lpad(F.col("page_id").cast("string"), 18, "0")
    return P.read(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_replace(number, r"^(.{10})(.{2})(.{6})$", "$1-$2-$3").alias("accession")
    )


@query(
    "doc_instruction_numbering",
    "SELECT document_id, start, CAST(row_number() OVER (PARTITION BY document_id ORDER BY start, priority, \"end\") AS INTEGER) AS number FROM (" + _SPANS + ")",
)
def doc_instruction_numbering(spark, sf_dir):
    start = (F.col("l_partkey") % 300).cast("int")
    spans = P.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), start.alias("start"), "l_linenumber", (start + F.col("l_quantity")).cast("int").alias("end"))
    return spans.select("document_id", "start", F.row_number().over(W.partitionBy("document_id").orderBy("start", "l_linenumber", "end")).alias("number"))


@query(
    "flt_document_validation",
    """
WITH c AS (SELECT doc_id, n_chars >= 1500 AS min_chars, contains(lower(text), 'the') AS phrase, regexp_matches(text, '[0-9]') AS figures, NOT contains(substring(text, 1, 500), '###') AS title FROM documents)
SELECT doc_id, min_chars AND phrase AND title AS valid, CASE WHEN NOT min_chars THEN 'too short' WHEN NOT phrase THEN 'phrase missing' WHEN NOT title THEN 'wrong title' ELSE 'ok' END AS reason,
  CAST(min_chars AS INTEGER) + CAST(phrase AS INTEGER) + CAST(figures AS INTEGER) + CAST(title AS INTEGER) >= 3 AS likely FROM c""",
)
def flt_document_validation(spark, sf_dir):
    """Named checks in order, the first failure as reason, and a vote of at least three of four signals."""
    t = F.col("text")
    checks = {"min_chars": F.col("n_chars") >= 1500, "phrase": F.lower(t).contains("the"), "figures": t.rlike("[0-9]"), "title": ~F.substring(t, 1, 500).contains("###")}
    c = P.read(spark, sf_dir, "documents").select("doc_id", *[v.alias(n) for n, v in checks.items()])
    reason = first_match([(~F.col("min_chars"), "too short"), (~F.col("phrase"), "phrase missing"), (~F.col("title"), "wrong title")], "ok")
    votes = sum((F.col(n).cast("int") for n in checks), F.lit(0))
    return c.select("doc_id", F.expr("min_chars and phrase and title").alias("valid"), reason.alias("reason"), (votes >= 3).alias("likely"))
