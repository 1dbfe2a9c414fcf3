"""Values in legal wording: ratios, amounts, rates, dates and step-down schedules, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MONTHS, plain_spaces

# The wordings.
RATIO = r"([\d.]+)\s*(?:to\s+|[:]\s*)1\.00"
LIMIT = r"(?i)(?:not\s+to\s+exceed|not\s+greater\s+than|shall\s+not\s+exceed|shall\s+not\s+be\s+greater\s+than|maximum\s+(?:ratio\s+of\s+)?|not\s+to\s+be\s+greater\s+than|not\s+exceed)\s+" + RATIO
LEVEL = r"(?i)(?:ratio|level)\s+(?:of\s+)?" + RATIO
ANY_RATIO = r"(?i)[\d.]+\s*(?:to\s+|:\s*)1\.00"
SCALED = r"(?i)\$\s*([\d.]+)\s*(million|billion)"
PLAIN_AMOUNT = r"\$\s*([\d,]+(?:\.\d+)?)"
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
NEW_PERCENT = r"(?i)(?:amended\s+to|to\s+mean|set\s+at|shall\s+be|to\s+be)\s*" + PERCENT
DATE = r"([A-Za-z]+\s+\d{1,2},?\s+\d{4})"
MATURITY = r"(?i)Maturity\s+Date"
NEW_MATURITY = MATURITY + r"[^.]{0,80}?(?:amended\s+to\s+mean|extended\s+to|shall\s+be|means)\s+\"?" + DATE
STEP = r"(?i)\([ivx]+\)\s+ending\s+on\s+" + DATE + r"\s+to\s+exceed\s+([\d.]+)\s+to\s+1\.00"
STEADY = r"(?i)for\s+any\s+quarter\s+ending\s+thereafter,?\s+to\s+exceed\s+([\d.]+)\s+to\s+1\.00"


def part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parts(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def written_date(text: Column) -> Column:
    """'June 30, 2023' (the comma may be missing) as '2023-06-30'; null for an unknown month."""
    text = plain_spaces(text)
    pattern = r"^\s*([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
    months = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m.lower()), F.lit(i))])
    month = F.try_element_at(months, F.lower(part(text, pattern)))
    return F.when(month.isNotNull(), F.format_string("%04d-%02d-%02d", part(text, pattern, 3).cast("int"), month, part(text, pattern, 2).cast("int")))


def ratio_threshold(text: Column) -> Column:
    """The ratio that a text sets as a limit, or else names as a level."""
    text = plain_spaces(text)
    return F.coalesce(part(text, LIMIT).try_cast("double"), part(text, LEVEL).try_cast("double"))


def dollar_amount(text: Column) -> Column:
    """Whole dollars of the first amount in millions or billions, or else of the first amount."""
    text = plain_spaces(text)
    scale = F.when(F.lower(part(text, SCALED, 2)) == "million", 1_000_000).otherwise(1_000_000_000)
    scaled = (part(text, SCALED).try_cast("decimal(20,6)") * scale).cast("long")
    return F.coalesce(scaled, F.split_part(F.replace(part(text, PLAIN_AMOUNT), F.lit(","), F.lit("")), F.lit("."), F.lit(1)).try_cast("long"))


def new_percentage(text: Column) -> Column:
    """The percentage after amending words, or else the only one; null where that isn't clear."""
    text = plain_spaces(text)
    only = F.when(F.size(parts(text, PERCENT)) == 1, part(text, PERCENT))
    return F.coalesce(part(text, NEW_PERCENT), only).try_cast("double")


def maturity_date(text: Column) -> Column:
    """The new maturity date: after amending words, or else the only date in the sentences that speak of it."""
    text = plain_spaces(text)
    sentences = F.filter(F.split(text, r"(?<=[.])\s+"), lambda s: s.rlike(MATURITY))
    dates = F.flatten(F.transform(sentences, lambda s: parts(s, DATE)))
    only = F.when(F.size(dates) == 1, F.get(dates, F.lit(0)))
    amended = part(text, NEW_MATURITY)
    return F.when(text.rlike(MATURITY), F.when(amended.isNotNull(), written_date(amended)).otherwise(written_date(only)))


def step_down_schedule(text: Column) -> Column:
    """struct(steps: array of (period_end, threshold), steady: the threshold thereafter); null without either, or where a date isn't one."""
    text = plain_spaces(text)
    dates, values = parts(text, STEP, 1), parts(text, STEP, 2)
    steps = F.zip_with(dates, values, lambda d, v: F.struct(written_date(d).alias("period_end"), v.try_cast("double").alias("threshold")))
    steady = part(text, STEADY).try_cast("double")
    good = ((F.size(dates) > 0) | steady.isNotNull()) & ~F.exists(steps, lambda s: s["period_end"].isNull())
    return F.when(good, F.struct(steps.alias("steps"), steady.alias("steady")))
