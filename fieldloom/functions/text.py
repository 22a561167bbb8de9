"""Text expressions: cleaning, administrative names, keys, similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Endings of administrative names, and what is stripped around names.
ADMIN_SUFFIXES = (
    r"local\s*government\s*area", r"local\s*govt\.?\s*area", r"local\s*govt\.?", r"l\.?\s*g\.?\s*a\.?",
    r"lga", r"senatorial\s*district", r"district", r"state",
)
EDGE_MARKS = " .,;:-–—"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_text(c: Column, unicode_forms: bool = False) -> Column:
    """Null to '', white space of any script collapsed, marks at the ends gone; unicode_forms also folds compatibility forms (an Arrow UDF)."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    s = _nfkc(s) if unicode_forms else s
    return F.btrim(F.btrim(F.regexp_replace(s, r"(?U)[\s\x{001C}-\x{001F}]+", " ")), F.lit(EDGE_MARKS))


def title_case_admin(c: Column) -> Column:
    """Lower case with a capital after each space and hyphen."""
    hyphened = lambda part: F.array_join(F.transform(F.split(part, "-", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "-")
    return F.array_join(F.transform(F.split(F.lower(clean_text(c)), " ", -1), hyphened), " ")


def match_key(c: Column, strip_suffix: bool = True, unicode_forms: bool = False) -> Column:
    """The join key of a name: endings off one after another until none is left, letters and digits alone, upper case.

    Each turn shortens a name by a word at least, so as many turns as it has words reach the end; the
    turns stop working, and cost next to nothing, once a name has no ending.
    """
    ending = rf"(?i)\b(?:{'|'.join(ADMIN_SUFFIXES)})\b\s*$"
    s = clean_text(c, unicode_forms)
    if strip_suffix:
        words = F.sequence(F.lit(1), F.regexp_count(s, F.lit(r"\w+")) + 1)
        s = F.aggregate(words, s, lambda name, _: F.when(name.rlike(ending), F.btrim(F.regexp_replace(name, ending, ""))).otherwise(name))
    return F.upper(F.regexp_replace(s, "[^A-Za-z0-9]+", ""))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def last_number(c: Column) -> Column:
    """The last free-standing number of two to six digits."""
    found = F.regexp_extract_all(c, F.lit(r"\b(\d{2,6})\b"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).try_cast("int")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by longest common blocks; JVM functions have no such measure."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def percent_ci(p: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.1f (%.1f-%.1f)", p * 100, low * 100, high * 100)


def selected(c: Column, option: Column | str) -> Column:
    """Whether a space-delimited multiple choice holds an option."""
    return F.array_contains(F.split(F.coalesce(c, F.lit("")), r"\s+", -1), option)


def count_selected(c: Column) -> Column:
    trimmed = F.btrim(F.coalesce(c, F.lit("")))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+", -1)))
