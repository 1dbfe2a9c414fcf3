"""Grammars of amending language: segments of a filing, instructions with their places, and the genre of the whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import projections as P
from ..functions.columns import python_values
from ..functions.text import OTHER_SPACES, plain_spaces
from ..registry import query

# Markers of segments.
BODY, SIGNED, WITNESS = r"(?i)NOW,?\s+THEREFORE", r"(?i)\[?signature\s+pages?\s+follow\]?", r"(?i)IN\s+WITNESS\s+WHEREOF"
ANNEX = r"(?i)ANNEX\s+A\s*\n+\s*(?:(?:AMENDED\s+AND\s+RESTATED\s+)?CREDIT\s+AGREEMENT|Composite\s+Amended\s+and\s+Restated\s+Credit\s+Agreement)"
ANY_ANNEX, COMPOSITE = r"(?i)ANNEX\s+A\b", r"(?i)(?:AMENDED\s+AND\s+RESTATED|Composite)"

# Targets, and the wordings of instructions in the order in which they are tried.
SECTION = r"(?P<section>Section\s+[A-Za-z0-9.\-()]+)"
TARGET = r"(?P<section>(?:Section|Article|Schedule|Exhibit)\s+[A-Za-z0-9.\-()]+)"
UNCROSSED = r"(?:(?!\b(?:Section|Article|Schedule|Exhibit)\b\s+[A-Za-z0-9]).){0,200}?"
OF_AGREEMENT = r"(?:\s*\[[^\]]*\])?(?:\s*\([^)]*\))?\s+of\s+the\s+(?:Credit|Note\s+Purchase|Loan)\s+Agreement.{0,60}?(?:is hereby )?(?:further\s+)?(?:modified\s+and\s+)?amended\s+by\s+(?:\(\w+\)\s+)*"
REPLACING = r"(?:deleting|delete)\s+[“\"](?P<old>[^“\"]+)[”\"].*?(?:replacing\s+(?:it|the same)\s+with|replace(?:d)?\s+with)\s+[“\"](?P<new>[^“\"]+)[”\"]"
GONE, ANEW = r"(?:is hereby )?(?:deleted|removed)\s+in\s+its\s+entirety", r"(?:is hereby )?amended\s+and\s+restated\s+in\s+its\s+entirety"
LATE_WAIVER = r"(?:compliance\s+with\s+|the\s+requirement\s+(?:contained\s+in\s+|of\s+))?{}\s*(?:is\s+hereby\s+waived|is\s+waived)"
GRAMMARS = {
    "0.2": (
        ("REPLACE_TEXT", SECTION + r".*?" + REPLACING),
        ("DELETE_COMMITMENT", SECTION + r".*?" + GONE),
        ("RESTATE_SECTION", SECTION + r".*?" + ANEW),
        ("WAIVE_TEMPORARILY", r"(?:compliance\s+with\s+)?" + SECTION + r".*?(?:is hereby )?waived"),
        ("ADD_COMMITMENT", SECTION + r".*?(?:is hereby )?amended\s+by\s+adding"),
    ),
    "0.3": (
        ("REPLACE_TEXT", SECTION + r"[^\n]{0,200}?" + REPLACING),
        ("DELETE_COMMITMENT", SECTION + r"[^\n]{0,200}?" + GONE),
        ("RESTATE_SECTION", SECTION + r"[^\n]{0,200}?" + ANEW),
        ("WAIVE_TEMPORARILY", LATE_WAIVER.format(SECTION)),
        ("ADD_COMMITMENT", SECTION + r"[^\n]{0,200}?(?:is hereby )?amended\s+by\s+adding"),
    ),
    "0.4": (
        (
            "REPLACE_TEXT",
            TARGET + UNCROSSED + r"(?:is\s+(?:hereby\s+)?(?:further\s+)?(?:modified\s+and\s+)?amended\s+by\s+)(?:\(\w+\)\s+)*(?:deleting|delete)\s+"
            r"(?:the\s+(?:single\s+instance\s+of\s+)?(?:definition\s+(?:of\s+)?[“\"]?)?)?[“\"]?(?P<old>[^“\"]{1,200})[”\"]?.{0,500}?"
            r"(?:replacing\s+(?:it|the same|each)?\s*(?:with|by)|replace(?:d)?\s+with|inserting\s+(?:the\s+following(?:\s+new)?\s+)?|substituting\s+in\s+its\s+place\s+(?:the\s+following(?:\s+new)?\s+)?)"
            r"[“\"]?(?P<new>[^“\"]{1,200})[”\"]?",
        ),
        ("DELETE", TARGET + r".{0,200}?" + GONE),
        ("RESTATE_SECTION", TARGET + r".{0,200}?" + ANEW),
        ("WAIVE_TEMPORARILY", LATE_WAIVER.format(TARGET)),
        ("ADD", TARGET + OF_AGREEMENT + r"(?:adding|inserting)"),
        ("DELETE", TARGET + OF_AGREEMENT + r"deleting"),
        ("UNRESOLVED", TARGET + OF_AGREEMENT + r"modifying"),
        ("RESTATE_SECTION", TARGET + r".{0,200}?(?:is\s+(?:hereby\s+)?amended\s+to\s+read\s+as\s+follows)"),
        ("DELETE", r"is\s+hereby\s+deleted\s+from\s+" + TARGET + r"(?:\s+in\s+its\s+entirety)?"),
    ),
}
#: Of instructions that begin together the first here is kept. Fixed values.
RANK = {"REPLACE_TEXT": 0, "ADD": 1, "DELETE": 1, "RESTATE_SECTION": 2, "WAIVE_TEMPORARILY": 2, "UNRESOLVED": 3}
#: Characters of context on each side. Fixed values.
CONTEXT = {"0.2": 450, "0.3": 500, "0.4": 500}
INSTRUCTIONS = "document_id long, number int, instruction_type string, section string, start int, end int, old_text string, new_text string, context string"


#: Letters beyond ASCII that patterns without regard to case take for i, k and s.
ODD_LETTERS = "\u0130\u0131\u017f\u212a"
_OTHER_SPACE = re.compile(f"[{OTHER_SPACES}]")
_PLAIN = dict.fromkeys(map(ord, OTHER_SPACES), " ")


def _small(text: str) -> str | None:
    """``text`` in small letters, each at its place, in which plain patterns find what patterns without regard to case find in ``text``; None where that doesn't hold."""
    low = text.lower()
    if text.isascii():
        return low
    return None if len(low) != len(text) or any(c in text for c in ODD_LETTERS) else low


def _spaces_from(text: str, at: int) -> int:
    """Where the spaces before ``at`` begin."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    return at


class _Marker:
    """A marker of segments: searched among small letters, from its word on; before the spaces that lead to the word, the marker has at most ``lead`` characters."""

    def __init__(self, pattern: str, word: str, lead: int = 0) -> None:
        pattern = pattern.replace(r"\b", r"(?u:\b)")
        self.word, self.lead, self.any_case, self.small = word, lead, re.compile(pattern, re.A), re.compile(pattern.removeprefix("(?i)").lower(), re.A)

    def place(self, text: str, low: str | None, after: int) -> int | None:
        if low is None:
            m = self.any_case.search(text, after)
        elif (at := low.find(self.word, after)) < 0:
            return None
        else:
            m = self.small.search(low, max(after, _spaces_from(low, at) - self.lead))
        return m.start() if m else None


_BODY, _SIGNED, _WITNESS, _ANNEXES = _Marker(BODY, "therefore", len("NOW,")), _Marker(SIGNED, "signature", len("[")), _Marker(WITNESS, "witness", len("IN")), (_Marker(ANNEX, "annex"), _Marker(ANY_ANNEX, "annex"))
_COMPOSITE, _LETTER = re.compile(COMPOSITE, re.A), re.compile(r"(?i)ANNEX\s+([A-Z])", re.A)


def _plain(text: str) -> str:
    return text if text.isascii() or not _OTHER_SPACE.search(text) else text.translate(_PLAIN)


def _body(t: str, low: str | None) -> tuple[int, int]:
    """Beginning and end of the body."""
    start = _BODY.place(t, low, 0) or 0
    return start, min((k for k in (_SIGNED.place(t, low, start), _WITNESS.place(t, low, start)) if k is not None), default=len(t))


def segments(text: str) -> tuple[int, int, int | None, str | None]:
    """(body_start, body_end, composite_start, annex) of one filing; see ``filing_segments``."""
    t = _plain(text)
    low = _small(t)
    start, end = _body(t, low)
    composite = next((k for m in _ANNEXES if (k := m.place(t, low, end)) is not None), None)
    if composite is None or not _COMPOSITE.search(head := t[composite : composite + 500]):
        return start, end, composite, None
    m = _LETTER.search(head[:50])
    return start, end, composite, m[1].upper() if m else "A"


SEGMENTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("body_start", "body_end", "composite_start")] + [T.StructField("annex", T.StringType())])


@F.arrow_udf(SEGMENTS)
def _segments(texts: pa.Array) -> pa.Array:
    found = [(0, None, None, None) if t is None else segments(t) for t in python_values(texts)]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
    return pa.StructArray.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], SEGMENTS.names)


def filing_segments(texts: DataFrame) -> DataFrame:
    """``texts`` with body_start, body_end, composite_start (null without one) and annex (letter of a restated agreement, else null). Offsets count code points from 0.

    The body goes from NOW, THEREFORE (else the beginning) to the signatures (else the end); the composite begins with the annex after it.
    """
    return texts.withColumn("segments_", _segments("text")).withColumns({n: F.col("segments_")[n] for n in SEGMENTS.names}).drop("segments_")


#: How any wording begins: the places where patterns are tried at all; words and pairs of words say the same of small letters.
BEGINNING = re.compile(r"(?:Section|Article|Schedule|Exhibit|compliance|the\s+requirement|is\s+hereby)\s", re.I)
FIRST_WORDS, FIRST_PAIRS = ("section", "article", "schedule", "exhibit", "compliance"), (("the", "requirement"), ("is", "hereby"))
NEW_WORDING, NEW_WORDS = re.compile(r"replac|inserting|substituting", re.I), ("replac", "inserting", "substituting")
#: Words that no match of a pattern is without, in the order of ``GRAMMARS``: a place that one of them doesn't follow isn't tried, as finding that out by the pattern takes long.
_EARLY = (("delet", "replac"), ("entirety",), ("restated",), ("waived",), ("adding",))
NEEDED = {
    "0.2": _EARLY,
    "0.3": _EARLY,
    "0.4": (("amended", "delet"), ("entirety",), ("restated",), ("waived",), ("agreement", "amended"), ("agreement", "deleting"), ("agreement", "modifying"), ("follows",), ("deleted", "from")),
}
#: The same for where a pattern is tried: by its place in ``GRAMMARS``, of patterns that begin with their target (``TARGETS``), words of which one begins at most so many characters after it.
TARGETS = {v: re.compile(TARGET if v == "0.4" else SECTION, re.I) for v in GRAMMARS}
_EVERYWHERE = ((), 0)
_GONE_NEAR, _AMENDED_NEAR = (("deleted", "removed"), 200 + len("is hereby ")), (("amended",), 200 + len("is hereby "))
NEAR = {
    "0.2": {k: _EVERYWHERE for k in (0, 1, 2, 4)},
    "0.3": {0: (("deleting", "delete"), 200), 1: _GONE_NEAR, 2: _AMENDED_NEAR, 4: _AMENDED_NEAR},
    "0.4": {0: _EVERYWHERE, 1: _GONE_NEAR, 2: _AMENDED_NEAR, 4: _EVERYWHERE, 5: _EVERYWHERE, 6: _EVERYWHERE, 7: _EVERYWHERE},
}


def _places(body: str, low: str | None) -> list[int]:
    """Where a wording may begin."""
    if low is None:
        return [m.start() for m in BEGINNING.finditer(body)]
    out = []
    for word in FIRST_WORDS:
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if low[end : end + 1].isspace():
                out.append(at)
            at = low.find(word, end)
    for first, word in FIRST_PAIRS:
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if low[end : end + 1].isspace() and (space := _spaces_from(low, at)) < at and low.endswith(first, 0, space):
                out.append(space - len(first))
            at = low.find(word, end)
    return sorted(out)


def _matches(patterns: list[tuple[str, re.Pattern]], needed: tuple[tuple[str, ...], ...], body: str, version: str | None = None, low: str | None = None) -> list[tuple[int, int, str, dict]]:
    """All matches, those of one pattern without overlaps; one pass finds the places, instead of one for each pattern. ``version``: of NEAR; ``low``: the body's ``_small``, if known."""
    low = _small(body) if low is None else low
    places, out = _places(body, low), []
    if not places:
        return out
    near = NEAR.get(version, {}) if low is not None else {}
    ends = [m.end() if (m := TARGETS[version].match(body, place)) else None for place in places] if near else [None] * len(places)
    for k, ((kind, pattern), wanted) in enumerate(zip(patterns, needed)):
        last = len(body) if low is None else min(map(low.rfind, wanted))
        if kind == "REPLACE_TEXT":
            last = min(last, max((m.start() for m in NEW_WORDING.finditer(body)), default=-1) if low is None else max(map(low.rfind, NEW_WORDS)))
        free, (words, reach) = 0, near.get(k, (None, 0))
        for place, end in zip(places, ends):
            if place > last:
                break
            if words is not None and (end is None or words and all(low.find(w, place, end + reach + len(w)) < 0 for w in words)):
                continue
            if place >= free and (m := pattern.match(body, place)):
                free = m.end()
                out.append((m.start(), free, kind, m.groupdict()))
    return out


def _without_overlaps(found: list[tuple[int, int, str, dict]]) -> list[tuple[int, int, str, dict]]:
    """What begins first stays, then what ranks first, then the longest; kept ones lie one after another, so the last end decides."""
    kept, free = [], -1
    for hit in sorted(found, key=lambda h: (h[0], RANK[h[2]], h[0] - h[1])):
        if hit[0] >= free:
            kept.append(hit)
            free = hit[1]
    return kept


def parse_instructions(texts: DataFrame, version: str = "0.4", context: bool = True) -> DataFrame:
    """The instructions of each text (document_id, text) by one of the ``GRAMMARS``, numbered by their beginning; their context, which is long, only where it is asked for.

    0.2 reads the whole text, 0.3 and 0.4 the body of the filing; 0.4 drops overlaps. Null texts have none. Places count code points from 0.
    """
    patterns = [(kind, re.compile(p, re.I | re.S)) for kind, p in GRAMMARS[version]]
    radius = CONTEXT[version]
    made = INSTRUCTIONS.split(", ")[: None if context else -1]
    names = [c.split()[0] for c in made]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(*(python_values(batch.column(k)) for k in range(2))):
                t = _plain(text)
                low = _small(t)
                begin, end = (0, len(text)) if version == "0.2" else _body(t, low)
                body = text[begin:end]
                found = _matches(patterns, NEEDED[version], body, version, low[begin:end] if low is not None and t is text else None)
                found = _without_overlaps(found) if version == "0.4" else sorted(found, key=lambda h: h[0])
                for number, (a, b, kind, groups) in enumerate(found, 1):
                    row = (doc, number, kind, groups.get("section"), begin + a, begin + b, groups.get("old"), groups.get("new"))
                    rows.append((*row, text[max(0, begin + a - radius) : begin + b + radius].strip()) if context else row)
            columns = zip(*rows) if rows else ((),) * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    known = texts.where("text is not null").select(F.col("document_id").cast("long").alias("document_id"), "text")
    return known.mapInArrow(run, ", ".join(made))


# Test filings ({n}: a digit): two instructions each; by hand, what 0.4 and 0.3 find in them, and the target.
_CLAUSES = (
    ('Section 7.{n} is hereby amended by deleting "old {n}" and inserting "new {n}"', "REPLACE_TEXT", None, "Section 7.{n}"),
    ("Section 2.{n} of the Credit Agreement is hereby amended by adding", "ADD", "ADD_COMMITMENT", "Section 2.{n}"),
    ("Article {n} is hereby deleted in its entirety", "DELETE", None, "Article {n}"),
    ("Schedule {n} is hereby amended and restated in its entirety", "RESTATE_SECTION", None, "Schedule {n}"),
    ("compliance with Section 6.{n} is hereby waived", "WAIVE_TEMPORARILY", "WAIVE_TEMPORARILY", "Section 6.{n}"),
    ("Exhibit {n} of the Loan Agreement is amended by modifying", "UNRESOLVED", None, "Exhibit {n}"),
    ("Section 3.{n}(a) is amended to read as follows", "RESTATE_SECTION", None, "Section 3.{n}(a)"),
    ("is hereby deleted from Section 4.{n} in its entirety", "DELETE", None, "Section 4.{n}"),
    ("Section 5.{n} of the Credit Agreement is hereby amended as follows", None, None, None),
    ("Section 5.{n} of the Credit Agreement is hereby amended by (i) deleting", "DELETE", None, "Section 5.{n}"),
    ("SECTION 8.{n} IS HEREBY DELETED IN ITS ENTIRETY", "DELETE", "DELETE_COMMITMENT", "SECTION 8.{n}"),
)
_HEAD = "WHEREAS Section 9.9 is hereby deleted in its entirety. "
_FILL = ". " + "lorem " * 150
_END = "IN WITNESS WHEREOF Section 9.8 is hereby deleted in its entirety. "
_ANNEX = "\nANNEX A\n\nAMENDED AND RESTATED CREDIT AGREEMENT among the parties"


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


P.SQL["clause_wording"] = "SELECT k, template, found_04, found_03, target FROM (VALUES " + ", ".join(f"({k}, " + ", ".join(map(_quoted, row)) + ")" for k, row in enumerate(_CLAUSES)) + ") c(k, template, found_04, found_03, target)"
P.SQL["filing"] = f"""
SELECT o_orderkey AS document_id, CAST(o_custkey % 9 + 1 AS VARCHAR) AS n, o_orderkey % 4 > 0 AS marked, o_orderkey % 3 = 0 AS annexed, o_orderkey % {len(_CLAUSES)} AS first, (o_orderkey + o_custkey) % {len(_CLAUSES)} AS second FROM orders"""


def filing(spark, sf_dir) -> DataFrame:
    """Filings made of keys, which are dealt over the cores first: a small file of keys is one split, but gives long texts."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    clauses = F.array(*[F.lit(c[0]) for c in _CLAUSES])
    one = lambda at: F.replace(F.get(clauses, at.cast("int")), F.lit("{n}"), (cust % 9 + 1).cast("string"))
    head = F.when(key % 4 > 0, _HEAD + "NOW, THEREFORE, ").otherwise("")
    text = F.concat(head, one(key % len(_CLAUSES)), F.lit(_FILL), one((key + cust) % len(_CLAUSES)), F.lit(_FILL + _END), F.when(key % 3 == 0, _ANNEX).otherwise(""))
    return P.spread(P.read(spark, sf_dir, "orders").select(key, cust), "o_orderkey").select(key.alias("document_id"), text.alias("text"))


_LEAD, _THEREFORE = len(_HEAD), len("NOW, THEREFORE, ")
_PLACES = f"""
WITH w AS (SELECT f.*, replace(a.template, '{{n}}', n) AS one, replace(b.template, '{{n}}', n) AS two, a.found_04 AS one_04, b.found_04 AS two_04, a.found_03 AS one_03, b.found_03 AS two_03,
    replace(a.target, '{{n}}', n) AS one_target, replace(b.target, '{{n}}', n) AS two_target, CASE WHEN marked THEN {_LEAD + _THEREFORE} ELSE 0 END AS lead
  FROM filing f JOIN clause_wording a ON a.k = f.first JOIN clause_wording b ON b.k = f.second),
h AS (SELECT document_id, n, lead AS start, one AS words, one_04 AS found_04, one_03 AS found_03, one_target AS target FROM w
  UNION ALL SELECT document_id, n, lead + length(one) + {len(_FILL)}, two, two_04, two_03, two_target FROM w)
"""
_FOUND = """SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY start) AS INTEGER) AS number, {0} AS instruction_type, target AS section, CAST(start AS INTEGER) AS start, CAST(start + length(words) AS INTEGER) AS "end",
  CASE WHEN {0} = 'REPLACE_TEXT' THEN concat('old ', n) END AS old_text, CASE WHEN {0} = 'REPLACE_TEXT' THEN concat('new ', n) END AS new_text FROM h WHERE {0} IS NOT NULL"""


@query("doc_grammar_04", _PLACES + _FOUND.format("found_04"), "clause_wording filing")
def doc_grammar_04(spark, sf_dir):
    """Instructions of the body by the broad grammar. The SQL knows what was written where."""
    return parse_instructions(filing(spark, sf_dir), context=False)


@query("doc_grammar_03", _PLACES + _FOUND.format("found_03"), "clause_wording filing")
def doc_grammar_03(spark, sf_dir):
    """Instructions of the body by the narrower grammar, sections only."""
    return parse_instructions(filing(spark, sf_dir), "0.3", context=False)


@query(
    "doc_filing_segments",
    _PLACES
    + f"""SELECT document_id, CAST(CASE WHEN marked THEN {_LEAD} ELSE 0 END AS INTEGER) AS body_start, CAST(lead + length(one) + length(two) + {2 * len(_FILL)} AS INTEGER) AS body_end,
  CASE WHEN annexed THEN CAST(lead + length(one) + length(two) + {2 * len(_FILL) + len(_END) + 1} AS INTEGER) END AS composite_start, CASE WHEN annexed THEN 'A' END AS annex FROM w""",
    "clause_wording filing",
)
def doc_filing_segments(spark, sf_dir):
    """Header, body, signatures and composite of a filing."""
    return filing_segments(filing(spark, sf_dir)).drop("text")


# Signatures of genres in the order in which they are tried; the first three end the search.
SIGNATURES = (
    ("full_restatement", r"amended\s+in\s+its\s+entirety\s+to\s+read\s+in\s+the\s+form"),
    ("conformed_copy_stricken_double_underlined", r"stricken\s+text.*?double.?underlined\s+text"),
    ("conformed_copy_explicit", r"conformed\s+copy\s+of\s+the\s+Amended\s+Credit\s+Agreement"),
    ("incremental_section_amended_by", r"Section\s+[\d.]+\w*\s+is\s+hereby\s+amended\s+by"),
    ("incremental_is_hereby_amended_to_delete", r"is\s+hereby\s+amended\s+to\s+delete\s+(?!the\s+stricken\s+text)"),
    ("incremental_is_hereby_amended_by_deleting", r"is\s+hereby\s+amended\s+by\s+deleting"),
    ("incremental_is_hereby_amended_by_replacing", r"is\s+hereby\s+amended\s+by\s+replacing"),
    ("incremental_section_amended_to_read", r"Section\s+[\d.]+\w*\s+is\s+hereby\s+amended\s+to\s+read"),
    ("incremental_section_amended_to_add", r"Section\s+[\d.]+\w*\s+is\s+hereby\s+amended\s+to\s+add"),
    ("incremental_section_amended_and_rested", r"Section\s+[\d.]+\w*\s+is\s+hereby\s+amended\s+and\s+restated"),
    ("incremental_amended_to_add_following", r"is\s+hereby\s+amended\s+to\s+add\s+the\s+following"),
    ("incremental_credit_agreement_amended", r"Credit\s+Agreement\s+is\s+hereby\s+amended\s+(?:as\s+follows|by)"),
    ("incremental_amended_as_follows", r"is\s+hereby\s+amended\s+as\s+follows"),
    ("incremental_amended_to_provide", r"is\s+hereby\s+amended\s+to\s+provide\s+as\s+follows"),
    ("incremental_amended_to_read", r"is\s+hereby\s+amended\s+to\s+read\s+as\s+follows"),
    ("incremental_section_modified", r"Section\s+[\d.]+\w*\s+(?:of\s+the\s+)?(?:Credit\s+Agreement\s+)?is\s+(?:hereby\s+)?modified"),
    ("incremental_definition_amended", r'(?:definition|clause)\s+(?:of\s+)?["\x93\x94].+?["\x93\x94]\s+(?:in\s+)?Section\s+[\d.]+\w*\s+is\s+hereby\s+amended'),
    ("incremental_agreement_amended_hereby", r"(?:Agreement|Credit\s+Agreement)\s+is\s+hereby\s+(?:amended|modified|supplemented)"),
    ("incremental_is_amended_by", r"Section\s+[\d.]+\w*\s+is\s+amended\s+by"),
    ("incremental_shall_be_amended", r"shall\s+be\s+amended\s+(?:to|by|as)"),
    ("incremental_is_amended_by_deleting", r"is\s+amended\s+by\s+(?:deleting|replacing|adding)"),
    ("incremental_are_amended", r"Sections\s+[\d.]+\w*\s+(?:and\s+[\d.]+\w*\s+)?are\s+hereby\s+amended"),
    ("incremental_by_deleting_and_replacing", r"by\s+deleting\s+.*?\s+and\s+(?:replacing|inserting|adding)"),
)
HEAD_CHARS = 200_000  # of a filing, for its genre. Fixed value.
ENDING = 3


def filing_genre(texts: DataFrame) -> DataFrame:
    """``texts`` with genre, confidence, evidence (the signatures found, in order), annex_a and parser_supported; a null text is UNKNOWN.

    The first of the ending signatures decides alone; else all that match are evidence and the genre is incremental.
    """
    head = plain_spaces(F.substring(F.coalesce("text", F.lit("")), 1, HEAD_CHARS))
    hits = [head.rlike("(?is)" + p) for _, p in SIGNATURES]
    ended = F.coalesce(*[F.when(h, n) for h, (n, _) in zip(hits[:ENDING], SIGNATURES)])
    others = F.array_compact(F.array(*[F.when(h, n) for h, (n, _) in zip(hits[ENDING:], SIGNATURES[ENDING:])]))
    marked = texts.withColumns({"ended": ended, "evidence": F.when(ended.isNotNull(), F.array(ended)).otherwise(others), "annex_a": head.rlike(r"(?i)Annex\s+A")})
    some = F.size("evidence") > 0
    genre = F.when(F.col("ended") == "full_restatement", "FULL_RESTATEMENT").when(F.col("ended").isNotNull(), "CONFORMED_COPY").when(some, "INCREMENTAL").otherwise("UNKNOWN")
    confidence = F.when(F.col("ended").isNotNull(), 0.95).when(some, 0.80).otherwise(0.0)
    return marked.withColumns({"genre": genre, "confidence": confidence, "parser_supported": genre == "INCREMENTAL"}).drop("ended")


_GENRE_TEXTS = (
    "is amended in its entirety to read in the form attached as Annex A; Section 1.1 is hereby amended by deleting x",
    "delete the stricken text and add the double-underlined text", "a conformed copy of the Amended Credit Agreement", "Section 2.1 is hereby amended by replacing y", "it is hereby amended to delete the word",
    "it is hereby amended to delete the stricken text", "Section 3.2a is hereby amended to read as follows", "Section 3 is hereby amended to add the following", "Section 4 is hereby amended and restated",
    "The Credit Agreement is hereby amended as follows", "it is hereby amended to provide as follows", "Section 5.5 of the Credit Agreement is modified", 'the definition of "EBITDA" in Section 1.01 is hereby amended', "This Agreement is hereby supplemented",
    "Section 6 is amended by adding", "it shall be amended to say", "Sections 7.1 and 7.2 are hereby amended", "changed by deleting a and inserting b", "nothing here", "annex  a", "Section\xa07.10 is\u2009hereby\xa0amended by replacing y",
)
P.SQL["genre_text"] = f"SELECT o_orderkey AS document_id, CASE o_orderkey % {len(_GENRE_TEXTS) + 1} " + " ".join(f"WHEN {k} THEN {_quoted(t)}" for k, t in enumerate(_GENRE_TEXTS)) + " END AS text FROM orders"


def _re2(pattern: str) -> str:
    """The SQL engine has no look-ahead; the one signature with it is written as two tests."""
    return pattern.replace(r"(?!the\s+stricken\s+text)", "").replace(r"\x93\x94", "")


@query(
    "doc_filing_genre",
    "WITH s AS (SELECT document_id, translate(coalesce(text, ''), concat(chr(160), chr(8201)), '  ') AS t FROM genre_text), h AS (SELECT document_id, regexp_matches(t, '(?i)Annex\\s+A') AS annex_a, "
    + ", ".join(f"regexp_matches(t, {_quoted('(?is)' + _re2(p))})" + (" AND NOT regexp_matches(t, '(?i)delete\\s+the\\s+stricken')" if "(?!" in p else "") + f" AS h{k}" for k, (_, p) in enumerate(SIGNATURES))
    + " FROM s) SELECT document_id, CASE WHEN h0 THEN 'FULL_RESTATEMENT' WHEN h1 OR h2 THEN 'CONFORMED_COPY' WHEN "
    + " OR ".join(f"h{k}" for k in range(ENDING, len(SIGNATURES)))
    + " THEN 'INCREMENTAL' ELSE 'UNKNOWN' END AS genre, CASE WHEN h0 THEN 'full_restatement' WHEN h1 THEN 'conformed_copy_stricken_double_underlined' WHEN h2 THEN 'conformed_copy_explicit' ELSE concat_ws(',', "
    + ", ".join(f"CASE WHEN h{k} THEN '{n}' END" for k, (n, _) in enumerate(SIGNATURES) if k >= ENDING)
    + ") END AS evidence, annex_a FROM h",
    "genre_text",
)
def doc_filing_genre(spark, sf_dir):
    """Full restatement, conformed copy, incremental or unknown, with the signatures that say so."""
    text = F.get(F.array(*map(F.lit, _GENRE_TEXTS)), (F.col("o_orderkey") % (len(_GENRE_TEXTS) + 1)).cast("int"))
    texts = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), text.alias("text"))
    return filing_genre(texts).select("document_id", "genre", F.array_join("evidence", ",").alias("evidence"), "annex_a")
