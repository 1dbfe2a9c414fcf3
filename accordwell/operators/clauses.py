"""Covenant sections of an agreement and the tree of clauses in them.

One pass over a text finds headings; what they say and, for some, what their bodies say makes sections of them. In a
section, labels such as (a), (ii), (B) and (3) are read with a stack of the open lists: a label goes on with the innermost list
whose successor it is, else it begins a list of its own kind, else it only refers to a clause. So (i) after (h) is a letter, and after a
sentence of clause (a) it is a Roman number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import projections as P
from ..functions.columns import python_values
from ..registry import query
from .grammar import _small

# Titles of covenant sections in the order of their rank, wordings of covenants and values, entries of a table of contents.
FAMILIES = (
    ("financial_covenants", re.compile(r"(?:Certain\s+)?Financial\s+Covenants", re.I)),
    ("covenants", re.compile(r"(?:Certain\s+)?Covenants", re.I)),
    ("financial_condition", re.compile(r"(?:Certain\s+)?Financial\s+(?:Condition|Performance\s+Covenants)", re.I)),
    ("broad_covenants", re.compile(r"(?:Certain\s+)?(?:Affirmative|Negative)\s+Covenants", re.I)),
)
COVENANT_NAME = re.compile(r"\b(?:Ratio|Net\s+Worth|Liquidity|EBITDA|Capital\s+Expenditures|Coverage|Indebtedness\s+to|Working\s+Capital)\b", re.I)
RATIO = re.compile(r"[\d.]+\s*(?:to|:)\s*1\.0+", re.I)
VERB = re.compile(r"shall\s+(?:not\s+)?(?:permit|maintain|have\s+and\s+maintain|be\s+(?:less|greater)\s+than|exceed)|may\s+not\s+(?:be\s+)?(?:less|greater)\s+than|will\s+not\s+permit", re.I)
VERB_WORDS = ("shall", "may", "will")
VALUE = re.compile(r"\$\s*[\d,]+|\d+(?:\.\d+)?\s*%")
LEADER, PAGE = re.compile(r"[ \t]*\.{3,}"), re.compile(r"[\s.]*\n\s*\d{1,4}\s*\n")

#: A heading begins a line or follows a sentence: a word or a dotted number, then a title in capitals to the end of the line or its first full stop.
HEADING = re.compile(
    r"[ \t]*(?:(?P<word>(?:Section|Article)\s+)(?P<number>\d+(?:\.\d+)*|[IVXL]+)\.?\s+|(?P<bare>\d+(?:\.\d+)*|[IVXL]+)\.?[ \t]+)(?P<title>(?!(?:Section|Article)\s)[A-Z][^\n.]{2,80})", re.I
)
BEGINNINGS = ("\n", ". ", ".\t")
#: A label stands at the start, after a line's end or one of ``;:.,``, or after "and" or "or"; spaces may lie between.
LABEL = re.compile(r"\((?P<label>[a-z]{1,5}|[A-Z]{1,2}|\d{1,2})\)(?=\s)")
LABELLED = re.compile(r"\band|\bor")
ROMAN = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")
ROMANS = {tens + ones: 10 * t + o for t, tens in enumerate(ROMAN[1]) for o, ones in enumerate(ROMAN[0]) if tens + ones}


class Clause(NamedTuple):
    path: str
    depth: int
    start: int
    end: int


def _values(label: str) -> list[tuple[str, int]]:
    """The lists that a label may belong to, and its place in each: letters (aa follows z), Roman numbers, capitals, numbers."""
    if label.isdigit():
        return [("1", int(label))]
    if label.isupper():
        return [("A", 26 * (len(label) - 1) + ord(label[-1]) - 64)] if len(set(label)) == 1 else []
    out = [("a", 26 * (len(label) - 1) + ord(label[0]) - 96)] if len(set(label)) == 1 and len(label) <= 2 else []
    return out + ([("i", ROMANS[label])] if label in ROMANS else [])


def _headings(text: str) -> Iterator[re.Match]:
    """Matches of HEADING in order, tried only where one may begin, none inside another."""
    places = {0}
    for mark in BEGINNINGS:
        k = text.find(mark)
        while k >= 0:
            places.add(k + len(mark))
            k = text.find(mark, k + 1)
    after = 0
    for place in sorted(places):
        if place > after or not place:
            m = HEADING.match(text, place)
            if m:
                after = m.end()
                yield m


def _labels(text: str) -> Iterator[re.Match]:
    for m in LABEL.finditer(text):
        at = own = m.start()
        while at and text[at - 1].isspace():
            at -= 1
        if not at or text[at - 1] in ";:.," or "\n" in text[at:own] or any(LABELLED.fullmatch(text, at - n, at) for n in (2, 3) if at >= n):
            yield m


def _states_covenant(body: str, values: bool) -> bool:
    """Whether a body has a ratio or a covenant's verb, or with ``values`` a value; patterns are tried only where their words are."""
    if "1.0" in body and RATIO.search(body):
        return True
    low = _small(body)
    if low is None:
        if VERB.search(body):
            return True
    else:
        for word in VERB_WORDS:
            k = low.find(word)
            while k >= 0:
                if VERB.match(body, k):
                    return True
                k = low.find(word, k + 1)
    return values and ("$" in body or "%" in body) and VALUE.search(body) is not None


def clause_tree(text: str) -> list[Clause]:
    """The clauses of a section with their paths (a.ii.B), in order; each ends where the next of its list or of a list around it begins."""
    stack: list[list] = []  # kind, number, label, index of the clause
    found: list[list] = []  # path, depth, start, end

    def close(depth: int, at: int) -> None:
        while len(stack) > depth:
            found[stack.pop()[3]][3] = at

    for m in _labels(text):
        label, at = m["label"], m.start("label") - 1
        values = _values(label)
        level = next((k for k in range(len(stack) - 1, -1, -1) if (stack[k][0], stack[k][1] + 1) in values), None)
        if level is not None:
            kind, number = stack[level][0], stack[level][1] + 1
        else:
            kind, number = next(((k, n) for k, n in values if n == 1 and k not in {s[0] for s in stack}), (None, 0))
            if kind is None:
                continue
            level = len(stack)
        close(level, at)
        stack.append([kind, number, label, len(found)])
        found.append([".".join(s[2] for s in stack), len(stack), at, len(text)])
    return [Clause(*c) for c in found]


def _arabic(number: str) -> str:
    return str(ROMANS.get(number.lower(), number)) if not number[0].isdigit() else number


def covenant_sections(text: str) -> list[tuple[str, str, str, int, int]]:
    """(family, number, title, start, end) of the covenant sections, in order.

    Headings that a dot leader or a page number on its own line follows are entries of a table of contents. Of headings with one number the last counts, of families the first in
    FAMILIES; plain "Covenants" only where no "Financial Covenants" are. Sections of the last two kinds need a ratio, a covenant's verb or, if a single covenant is named, a value in their bodies.
    """
    headings, titles = [], []
    for m in _headings(text):
        title = m["title"]
        if not title[0].isupper() or m["bare"] and "." not in m["bare"] and len(m["bare"]) > 2:
            continue
        if LEADER.match(text, m.end()) or LEADER.search(title) or PAGE.match(text[m.end() : m.end() + 15]):
            continue
        headings.append(m)
        titles.append(title)
    starts = [m.start("word") if m["word"] else m.start("bare") for m in headings]
    numbers = [m["number"] or m["bare"] for m in headings]
    plainly = [_arabic(n) for n in numbers]
    # a title without these letters is of no family
    named = [k for k, title in enumerate(titles) if "covenant" in (low := title.lower()) or "cond" in low]

    def end_of(k: int) -> int:
        own = plainly[k]
        for j in range(k + 1, len(headings)):
            if plainly[j] != own and not plainly[j].startswith(own + "."):
                return starts[j]
        return len(text)

    chosen: dict[str, tuple[int, str, int]] = {}  # by number: rank, family, heading
    plain = any(FAMILIES[0][1].match(titles[k]) for k in named)
    ranks: dict[int, int | None] = {k: next((r for r, (_, p) in enumerate(FAMILIES) if p.match(titles[k]) and not (r == 1 and plain)), None) for k in named}
    for k, m in enumerate(headings):
        rank = ranks.get(k)
        if rank is None and not (m["word"] and "." in numbers[k] and COVENANT_NAME.search(titles[k])):
            continue
        body = text[m.end() : end_of(k)] if rank in (None, 3) else ""
        if rank == 3 and not _states_covenant(body, values=False):
            rank = None
        family = FAMILIES[rank][0] if rank is not None else "single_covenant"
        if rank is None:
            if not (m["word"] and "." in numbers[k] and COVENANT_NAME.search(m["title"])) or not _states_covenant(body, values=True):
                continue
            rank = len(FAMILIES)
        held = chosen.get(numbers[k])
        if held is None or rank <= held[0]:
            chosen[numbers[k]] = (rank, family, k)
    return [(family, number, re.sub(r"\s+", " ", headings[k]["title"]).strip(), starts[k], end_of(k)) for number, (_, family, k) in sorted(chosen.items(), key=lambda c: starts[c[1][2]])]


SECTIONS = "document_id long, family string, number string, title string, start int, end int, clauses array<struct<path: string, depth: int, start: int, end: int>>"


def _run(batches: Iterator[pa.RecordBatch], clauses: bool) -> Iterator[pa.RecordBatch]:
    clause = pa.struct([("path", pa.string()), ("depth", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(clause)]
    names = ["document_id", "family", "number", "title", "start", "end", "clauses"]
    for batch in batches:
        rows = []
        for doc, text in zip(*map(python_values, batch.columns)):
            for family, number, title, start, end in covenant_sections(text or ""):
                tree = clauses and [{"path": c.path, "depth": c.depth, "start": start + c.start, "end": start + c.end} for c in clause_tree(text[start:end])]
                rows.append((doc, family, number, title, start, end, tree or []))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def find_covenant_sections(texts: DataFrame, clauses: bool = True) -> DataFrame:
    """Sections and their clauses of ``texts`` (document_id, text); places count code points from 0. Null texts have none; texts are read whole, each by itself. Without ``clauses`` only sections are looked for, and their lists are empty."""
    return texts.select(F.col("document_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_run, clauses=clauses), SECTIONS)


# A text of known structure: a table of contents, an article, sections of four families, clauses three deep, references that are no clauses.
_PARTS = (
    "Section 7.11 Financial Covenants........ 38\nSection 8.01 Events of Default\n52\n{pad}\n",
    "Section 7.11 Financial Covenants. The Borrower agrees:\n(a) Leverage Ratio. The Borrower shall not permit the ratio to exceed {n}.50 to 1.00, subject to clause (c) below:\n(i) first {pad};\n(ii) second:\n(A) deep; and (B) deeper;\n(iii) third;\n",
    "(b) Coverage. At least 2.00 to 1.00.\n",
    "Section 7.12 Financial Condition. Sound.\n",
    "ARTICLE VIII Negative Covenants\n8.1 Liens. None shall exceed 5%.\n8.2 Sales. None.\n",
    "ARTICLE IX Affirmative Covenants\nThe Borrower pays its taxes {pad}.\n",
    "Section 10.3 Minimum Liquidity. Not below $5,000,000.\nSection 10.4 Coverage of Insurance. As usual.\n",
)
P.SQL["agreement_text"] = (
    "SELECT o_orderkey AS document_id, " + " || ".join("replace(replace('" + p.replace("\n", "' || chr(10) || '") + "', '{pad}', repeat('x', CAST(o_custkey % 40 AS INTEGER))), '{n}', CAST(o_orderkey % 9 AS VARCHAR))" for p in _PARTS) + " AS text FROM orders"
)


def agreement_text(spark, sf_dir) -> DataFrame:
    pad, n = F.repeat(F.lit("x"), (F.col("o_custkey") % 40).cast("int")), (F.col("o_orderkey") % 9).cast("string")
    text = F.replace(F.replace(F.lit("".join(_PARTS)), F.lit("{pad}"), pad), F.lit("{n}"), n)
    return P.spread(P.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(F.col("o_orderkey").alias("document_id"), text.alias("text"))


_KNOWN_SECTIONS = (
    ("financial_covenants", "7.11", "Section 7.11 Financial Covenants. The", "Section 7.12"), ("financial_condition", "7.12", "Section 7.12", "ARTICLE VIII"),
    ("broad_covenants", "VIII", "ARTICLE VIII", "ARTICLE IX"), ("single_covenant", "10.3", "Section 10.3", "Section 10.4"),
)
_KNOWN_CLAUSES = (
    ("a", "(a) Lev", "(b) Cov"), ("a.i", "(i) first", "(ii) second"), ("a.ii", "(ii) second", "(iii) third"), ("a.ii.A", "(A) deep;", "(B) deeper"), ("a.ii.B", "(B) deeper", "(iii) third"), ("a.iii", "(iii) third", "(b) Cov"), ("b", "(b) Cov", "Section 7.12"),
)
_AT = "CAST(strpos(text, '{}') - 1 AS INTEGER)".format


@query("doc_covenant_sections", " UNION ALL ".join(f"SELECT document_id, '{f}' AS family, '{n}' AS number, {_AT(b)} AS start, {_AT(e)} AS \"end\" FROM agreement_text" for f, n, b, e in _KNOWN_SECTIONS), "agreement_text")
def doc_covenant_sections(spark, sf_dir):
    """Covenant sections of four kinds of headings, without the entries of a table of contents. The SQL knows where they were written."""
    return find_covenant_sections(agreement_text(spark, sf_dir), clauses=False).select("document_id", "family", "number", "start", "end")


@query("doc_clause_tree", " UNION ALL ".join(f"SELECT document_id, '7.11' AS number, '{p}' AS path, {_AT(b)} AS start, {_AT(e)} AS \"end\" FROM agreement_text" for p, b, e in _KNOWN_CLAUSES), "agreement_text")
def doc_clause_tree(spark, sf_dir):
    """The clauses of a section, three lists deep. The SQL knows where they were written."""
    sections = find_covenant_sections(agreement_text(spark, sf_dir))
    return sections.select("document_id", "number", F.explode("clauses").alias("c")).select("document_id", "number", "c.path", "c.start", "c.end")
