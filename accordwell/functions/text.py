"""Scalar functions over legal text: dates, amounts, ratios, rates and normal forms. All are native column expressions."""

from __future__ import annotations

import json
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


#: White space beyond space, tab and line ends: separators of information, next line, no-break, ogham, typographic, narrow, mathematical and ideographic spaces.
OTHER_SPACES = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def plain_spaces(text: Column) -> Column:
    """``text`` with a space for every white space character that patterns don't know; places in the text stay the same."""
    return F.translate(text, OTHER_SPACES, " " * len(OTHER_SPACES))


def _literal_map(entries: dict[str, str]) -> Column:
    """A map as one literal, whatever its size."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


#: What names stand for; the frequent ones apart, as a lookup passes over a map's entries. Some names may lack their semicolon.
FREQUENT = {n: chr(c) for n, c in name2codepoint.items()}
NAMED = {n.rstrip(";"): t for n, t in html5.items() if n.endswith(";")}
WITHOUT_SEMICOLON = {n: t for n, t in html5.items() if not n.endswith(";")}
#: Numbers from 128 to 159 mean what they are in the Windows code page, where it has them.
WINDOWS = {str(k): bytes([k]).decode("cp1252") for k in range(128, 160) if k not in (129, 141, 143, 144, 157)}


def character_references(text: Column) -> Column:
    """``text`` with numeric and named character references resolved, once. Numbers that are no characters give U+FFFD; unknown names stay as they are."""
    known, frequent, bare, windows = map(_literal_map, (NAMED, FREQUENT, WITHOUT_SEMICOLON, WINDOWS))

    def resolved(piece: Column) -> Column:
        decimal, hexadecimal, name = (F.regexp_extract(piece, p, 1) for p in ("^#([0-9]+)", "^#[xX]([0-9a-fA-F]+)", "^([A-Za-z][A-Za-z0-9]*)"))
        # numbers too long for any character are too long for a conversion as well
        short = lambda digits, base: F.when(F.length(digits) > 12, -1).otherwise(F.conv(digits, base, 10).cast("long"))
        number = F.when(decimal != "", short(decimal, 10)).when(hexadecimal != "", short(hexadecimal, 16))
        wrong = (number <= 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        sign = F.when(wrong, "\ufffd").otherwise(F.coalesce(F.try_element_at(windows, number.cast("string")), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")))
        closed = piece.startswith(F.concat(name, F.lit(";")))
        named = F.when(name == "", None).when(closed, F.coalesce(F.try_element_at(frequent, name), F.try_element_at(known, name))).otherwise(F.try_element_at(bare, name))
        rest = F.regexp_replace(piece, "^(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?", "")
        return F.coalesce(F.concat(F.when(number.isNotNull(), sign).otherwise(named), rest), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    later = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), resolved)
    return F.when(text.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(later, ""))).otherwise(text)


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def iso_date(text: Column) -> Column:
    """'June 30, 2023' as '2023-06-30'; null for an unknown month. Days aren't checked against the month."""
    pattern = r"([A-Z][a-z]+) ([0-9]{1,2}), ([0-9]{4})"
    months = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))])
    month = F.try_element_at(months, _part(text, pattern))
    return F.when(month.isNotNull(), F.format_string("%04d-%02d-%02d", _part(text, pattern, 3).cast("int"), month, _part(text, pattern, 2).cast("int")))


def ratio_of(text: Column) -> Column:
    """x of 'x to 1.00'."""
    return _part(text, r"([0-9]+\.[0-9]+) to 1\.00").try_cast("double")


def percent_of(text: Column) -> Column:
    """The percentage, if there is just one."""
    return F.when(F.size(F.regexp_extract_all(text, F.lit(r"([0-9]+\.[0-9]+)%"), F.lit(1))) == 1, _part(text, r"([0-9]+\.[0-9]+)%").try_cast("double"))


def dollars_of(text: Column) -> Column:
    return F.replace(_part(text, r"\$([0-9,]+)"), F.lit(","), F.lit("")).try_cast("long")


def direction_of(text: Column) -> Column:
    """Whether a threshold is a ceiling or a floor."""
    low = F.lower(text)
    return F.when(low.contains("not exceed") | low.contains("maximum"), "<=").when(low.contains("minimum") | low.contains("maintain"), ">=")
