"""String helpers: trimming, recoding, title parsing, name cleaning."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace stripped by R's trimws: space, tab, carriage return, line feed.
_EDGE_WS = r"^[ \t\r\n]+|[ \t\r\n]+$"
# A four-digit year in parentheses; the FIRST one is the title's year.
_YEAR_IN_PARENS = r"\((\d{4})\)"
# A trailing "(dddd)" with the whitespace around it.
_TRAILING_YEAR = r"\s*\(\d{4}\)\s*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_all(x) -> Column:
    """Trim spaces, tabs, CR and LF at both ends (plain ``trim`` strips spaces only)."""
    return F.regexp_replace(_c(x), _EDGE_WS, "")


def recode(x, mapping: dict[str, str]) -> Column:
    """Replace values found in ``mapping``; anything else is kept.

    The map is a literal, so the lookup is a codegen'd map access rather than
    a join; ``mapping`` is a small fixed dictionary of corrections.
    """
    x = _c(x)
    if not mapping:
        return x
    lit_map = F.create_map(*[F.lit(v) for v in chain.from_iterable(sorted(mapping.items()))])
    return F.coalesce(F.try_element_at(lit_map, x), x)


def title_year(x) -> Column:
    """Year = the first four digits in parentheses, as int; null when absent."""
    return F.nullif(F.regexp_extract(_c(x), _YEAR_IN_PARENS, 1), F.lit("")).try_cast("int")


def title_strip_year(x) -> Column:
    """Title without a trailing "(dddd)" (an earlier year in the title stays)."""
    return F.regexp_replace(_c(x), _TRAILING_YEAR, "")


def capitalize_first(x) -> Column:
    """Upper-case the first character only (not ``initcap``); empty stays empty."""
    x = _c(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def clean_name(name: str) -> str:
    """snake_case, lower-case column name; digit-leading names get an ``x`` prefix."""
    s = name.strip()
    if s != s.upper() and s != s.lower():   # camelCase -> camel_case; ALLCAPS stays whole
        s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s
