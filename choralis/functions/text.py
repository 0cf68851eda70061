"""Normalisation, tokens and shingles."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: words that carry no content of their own.
STOP_WORDS = (
    "a an and are as at be but by for from has have i if in is it its of on or so that the this to was we what will "
    "with you your they our my me do not just"
).split()


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return pd.Series([unicodedata.normalize("NFKC", t) if isinstance(t, str) and not t.isascii() else t for t in texts], dtype=object)


def normalised(text: Column, compose: bool = True) -> Column:
    """Lower case, without links, mentions, apostrophes and marks, single spaces; null gives an empty text."""
    t = F.lower(nfkc(text) if compose else text)
    t = F.replace(t, F.lit("’"), F.lit("'"))
    t = F.regexp_replace(t, r"https?://\S+", " ")
    t = F.regexp_replace(t, r"@\w+", " ")
    t = F.replace(t, F.lit("'"), F.lit(""))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\s]", " ")
    return F.coalesce(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def tokens(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def lexical_diversity(words: Column) -> Column:
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_distinct(words)) / F.size(words))


def shingles(words: Column, n: int) -> Column:
    last = F.size(words) - n
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<string>"))


def contentful(shingle: Column) -> Column:
    return F.exists(F.split(shingle, " "), lambda w: ~w.isin(STOP_WORDS))
