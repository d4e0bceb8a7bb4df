"""Text functions that the engine needs and Spark lacks (NFKC, casefold, sequence similarity), and small column helpers."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from cinelake.functions import tokens as T

_BRACKET = re.compile(T.BRACKET)
_EPISODE = re.compile(T.EPISODE_MARK, re.IGNORECASE)


def _words(text: str) -> str:
    """Letters and numbers, everything else a blank; blanks collapsed, case folded."""
    return " ".join("".join(c if c.isalnum() or c.isspace() else " " for c in text).split()).casefold()


def title_key(text: str | None) -> str:
    """Normal form of a title: without bracketed parts and episode marks."""
    text = _BRACKET.sub(" ", unicodedata.normalize("NFKC", text or ""))
    return _words(_EPISODE.sub(" ", text).replace("_", " "))


def alias_key(text: str | None) -> str:
    """Normal form for the comparison of titles: brackets and episode marks stay."""
    return _words(unicodedata.normalize("NFKC", text or "").casefold())


def ratio_of_keys(x: str, y: str, matcher: difflib.SequenceMatcher | None = None) -> float:
    """Share of matching blocks of two alias keys, 0 to 100, one decimal. matcher: one whose second text is y already."""
    if not x or not y:
        return 0.0
    if x == y:
        return 100.0
    matcher = matcher or difflib.SequenceMatcher(None, "", y)
    matcher.set_seq1(x)
    return round(matcher.ratio() * 100, 1)


def similarity(a: str | None, b: str | None) -> float:
    """ratio_of_keys of two titles' alias keys. The order of the two matters."""
    return ratio_of_keys(alias_key(a), alias_key(b))


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


@pandas_udf(StringType())
def normalize_title_text(s: pd.Series) -> pd.Series:
    return s.map(title_key)


@pandas_udf(StringType())
def normalize_alias(s: pd.Series) -> pd.Series:
    return s.map(alias_key)


@pandas_udf(DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lookup(values: dict, key: Column, otherwise: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), otherwise)


def to_double(c: Column) -> Column:
    """Numbers as text; anything else (also 'N/A') is null."""
    return c.try_cast("double")


def to_int(c: Column) -> Column:
    """Truncates; text that is no number is null."""
    return c.try_cast("double").try_cast("long")


def rate(c: Column) -> Column:
    """'a/b' or a number; null for a zero divisor."""
    parts = F.split(c, "/")
    return F.when(c.contains("/"), F.try_divide(parts[0].try_cast("double"), F.nullif(parts[1].try_cast("double"), F.lit(0.0)))).otherwise(c.try_cast("double"))


def duration_text(seconds: Column) -> Column:
    """H:MM:SS of the half-even rounded seconds, empty for null."""
    s = F.bround(seconds).cast("long")
    return F.when(s.isNull(), "").otherwise(F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def step(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns like withColumns, but as rows of a one-element array that is inlined. The optimizer doesn't merge
    that with later steps, so an expression that many later ones use is evaluated once and not copied into each."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
