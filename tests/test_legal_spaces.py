"""Legal text with no-break spaces and character references reads like plain text."""

import html

import pytest
from pyspark.sql import functions as F

from accordwell.functions import legal as L
from accordwell.functions.text import OTHER_SPACES, character_references, plain_spaces
from accordwell.operators.documents import html_to_text
from accordwell.operators.grammar import filing_genre, filing_segments, parse_instructions
from accordwell.operators.registries import resolve_mentions


def one(spark, text, **columns):
    return spark.createDataFrame([(text,)], "t string").select(*[f(F.col("t")).alias(n) for n, f in columns.items()]).first()


@pytest.mark.parametrize("space", [" ", "\xa0", " ", " "])
def test_values(spark, space):
    text = "The maximum ratio of 4.50 to 1.00 applies; the fee is $5 million, set at 2.5% a year. The Maturity Date shall be June 30, 2027.".replace(" ", space)
    got = one(spark, text, ratio=L.ratio_threshold, dollars=L.dollar_amount, percent=L.new_percentage)
    assert tuple(got) == (4.5, 5_000_000, 2.5)
    sentence = "The Maturity Date shall be June 30, 2027".replace(" ", space)
    assert one(spark, sentence, m=L.maturity_date).m == "2027-06-30"
    steps = "(i) ending on June 30, 2023 to exceed 4.00 to 1.00; for any quarter ending thereafter, to exceed 3.50 to 1.00".replace(" ", space)
    assert one(spark, steps, s=L.step_down_schedule).s.steady == 3.5


@pytest.mark.parametrize("space", [" ", "\xa0"])
def test_genre_mentions_and_places(spark, space):
    say = lambda text: spark.createDataFrame([(1, text.replace(" ", space))], "document_id long, text string")
    assert filing_genre(say("Section 7.10 is hereby amended by replacing y")).first().genre == "INCREMENTAL"
    mention = say("the Total Leverage Ratio shall").selectExpr("1L AS agreement_id", "document_id AS mention_id", "text", "'' AS section_ref")
    assert resolve_mentions(mention).first().canonical_id == "financial_covenant.leverage_ratio"
    text = "NOW, THEREFORE, Section 7.10 of the Credit Agreement is hereby amended by adding the following. IN WITNESS WHEREOF Section 9.1 is hereby deleted in its entirety"
    segments = filing_segments(say(text)).first()
    assert (segments.body_start, segments.body_end) == (0, text.index("IN WITNESS"))
    assert [r.instruction_type for r in parse_instructions(say(text)).collect()] == ["ADD"]


def test_pages_with_references_parse_like_plain_ones(spark):
    plain = "<p>Section 7.10 is amended by deleting “4.0” and replacing it with “4.5”</p>"
    coded = "<p>Section&#160;7.10 is&nbsp;amended by deleting &#8220;4.0&#8221; and replacing it with &ldquo;4.5&#x201D;</p>"
    windows = "<p>Section&#xA0;7.10 is amended by deleting &#147;4.0&#148; and replacing it with &#147;4.5&#148;</p>"
    texts = {one(spark, h, t=html_to_text).t for h in (plain, coded, windows)}
    assert texts == {"Section 7.10 is amended by deleting “4.0” and replacing it with “4.5”"}


def test_references_equal_the_standard_library(spark):
    texts = ["&#0;&#xD800;&#1114112;&#99999999999999999999;", "&am x &", "&;&#;&#x;", "&frac12;&hellip;&ngE;&CounterClockwiseContourIntegral;", "&#128512;&#129;&amp;lt;", "", "&copy and &amp", "&#65&#x42"]
    for t in texts:
        assert one(spark, t, t=character_references).t == html.unescape(t)
    assert one(spark, None, t=character_references).t is None
    assert one(spark, "a" + OTHER_SPACES, t=plain_spaces).t == "a" + " " * len(OTHER_SPACES)
    assert all(c.isspace() for c in OTHER_SPACES)
