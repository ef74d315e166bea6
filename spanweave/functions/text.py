"""Text expressions: normal form, words, q-grams, sentences, markup removal."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normal_form(c) -> Column:
    """Lower case; every run of characters that are no letter, digit or '_' is one blank; trimmed."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), r"[^\p{L}\p{N}_]+", " "))


@F.pandas_udf("string")
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for texts that need it before ``normal_form``."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def words(c) -> Column:
    """The lower-cased runs of letters, digits and '_'."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def qgrams(c, q: int) -> Column:
    """All substrings of q characters in order; none for shorter texts."""
    if q < 1:
        raise ValueError("q must be at least 1")
    t = _c(c)
    n = F.length(t)
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substring(t, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def sentences(c, least: int = 8) -> Column:
    """Trimmed pieces between '.', ';' and line ends of at least ``least`` characters."""
    return F.filter(F.transform(F.split(_c(c), r"[.;\n]"), F.trim), lambda x: F.length(x) >= least)


def html_text(c) -> Column:
    """Visible text of a page: scripts, styles, comments and tags go, five entities are decoded, blanks collapse."""
    t = F.regexp_replace(_c(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def title(c, limit: int = 240) -> Column:
    """The first line that isn't blank, cut at ``limit`` characters; null where there is none."""
    lines = F.filter(F.transform(F.split(_c(c), "\n"), F.trim), lambda x: x != "")
    return F.substring(F.get(lines, F.lit(0)), 1, limit)


def slug(c) -> Column:
    """Lower-case ASCII letters and digits with single dashes between."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
