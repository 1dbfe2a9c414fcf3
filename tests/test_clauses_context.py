"""Labels of clauses, headings of sections, defined terms, and matching, on cases by hand."""

import random

from pyspark.sql import functions as F

from accordwell.operators.clauses import clause_tree, covenant_sections, find_covenant_sections
from accordwell.operators.matching import greedy_matching, span_pairs


def paths(text):
    return [c.path for c in clause_tree(text)]


def test_letters_and_roman_numbers():
    letters = "".join(f"\n({c}) x" for c in "abcdefghij")
    assert paths(letters) == list("abcdefghij")
    assert paths("\n(a) x:\n(i) y;\n(ii) y;\n(b) z") == ["a", "a.i", "a.ii", "b"]
    assert paths("\n(a) x\n(1) y\n(2) z\n(A) deep\n(B) deep\n(3) w\n(b) v") == ["a", "a.1", "a.2", "a.2.A", "a.2.B", "a.3", "b"]
    assert paths("\n(a) see clause (c) above\n(b) under (b) or\n(iv) odd") == ["a", "b"]
    roman = "\n(a) x" + "".join(f"\n({r}) y;" for r in ("i", "ii", "iii", "iv", "v", "vi")) + "\n(b) z"
    assert paths(roman) == ["a", *(f"a.{r}" for r in ("i", "ii", "iii", "iv", "v", "vi")), "b"]
    many = "".join(f"\n({chr(97 + k) if k < 26 else chr(97 + k - 26) * 2}) x" for k in range(30))
    assert paths(many)[-4:] == ["aa", "bb", "cc", "dd"]
    assert paths("") == [] and paths("(x) y") == []


def test_ends_of_clauses():
    text = "\n(a) one:\n(i) two;\n(ii) three\n(b) four"
    got = {c.path: text[c.start : c.end] for c in clause_tree(text)}
    assert got == {"a": text[1 : text.index("(b)")], "a.i": "(i) two;\n", "a.ii": "(ii) three\n", "b": "(b) four"}


def test_headings_of_contents_pages_and_plain_covenants():
    body = "\n6.1 Covenants. It shall not exceed 3.00 to 1.00.\n7.2 Other Matters. None."
    assert [(f, n) for f, n, *_ in covenant_sections(body)] == [("covenants", "6.1")]
    toc = "Section 6.1 Financial Covenants ..... 12\nSection 6.1 Financial Covenants\n12\n"
    assert covenant_sections(toc) == []
    twice = toc + "text\nSection 6.1 Financial Covenants. First.\nSection 6.1 Financial Covenants. Second.\nSection 7.1 Events. None"
    got = covenant_sections(twice)
    assert len(got) == 1 and twice[got[0][3] : got[0][4]].startswith("Section 6.1 Financial Covenants. Second.")
    article = "\nARTICLE V Financial Covenants\n5.1 Leverage. Low.\n5.2 Coverage. High.\nARTICLE VI Events of Default\n"
    assert [article[s:e] for *_, s, e in covenant_sections(article)] == [article[1 : article.index("ARTICLE VI")]]


def test_sections_of_awkward_texts(spark):
    """Null, empty and very long texts, rows that repeat, other columns."""
    long = "x " * 300_000 + "\nSection 7.11 Financial Covenants. It shall not permit.\n(a) One.\n(b) Two."
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (3, long, 0)]
    got = find_covenant_sections(spark.createDataFrame(rows, "document_id long, text string, start int")).collect()
    assert [(r.document_id, r.number, len(r.clauses)) for r in got] == [(3, "7.11", 2)] * 2
    assert find_covenant_sections(spark.createDataFrame([], "document_id long, text string")).count() == 0


def test_greedy_matching_equals_a_sequential_one(spark):
    rng = random.Random(4)
    pairs = sorted({(g, 1000 + d): rng.randrange(4) / 4 for g in range(40) for d in range(40) if rng.random() < 0.3}.items())
    want, used = [], set()
    for (g, d), s in sorted(pairs, key=lambda p: (-p[1], p[0])):
        if g not in used and d not in used:
            want.append((g, d, s))
            used |= {g, d}
    rows = [(g, d, s) for (g, d), s in pairs] + [(1, 2000, None)]
    got = greedy_matching(spark.createDataFrame(rows, "gold_id long, detected_id long, score double"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert greedy_matching(got.limit(0)).count() == 0


def test_spans_in_many_buckets_meet_once(spark):
    kind = "document_id long, {}_id long, instruction_type string, target_ref string, b int, e int"
    gold = spark.createDataFrame([(1, 1, "ADD", "s", 0, 5000), (1, 2, "ADD", "s", None, None), (2, 3, "ADD", "s", 10, 20), (2, 4, "ADD", "s", 20, 20)], kind.format("gold"))
    detected = spark.createDataFrame([(1, 7, "ADD", "s", 100, 4000), (2, 8, "ADD", "s", 20, 30), (2, 9, "DELETE", "s", 10, 20)], kind.format("detected"))
    got = sorted(map(tuple, span_pairs(gold, detected).select("gold_id", "detected_id", F.round("score", 3)).collect()))
    assert got == [(1, 7, 0.78), (2, 7, 0.0)]
