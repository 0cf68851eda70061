"""Rounding, time differences and regular expressions, bit for bit as specified."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary that knows ASCII word characters only.
ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def spark_pattern(pattern: str) -> str:
    """The pattern with ASCII word boundaries, whatever the JVM takes \\b for."""
    return pattern.replace(r"\b", ASCII_BOUNDARY)


def round3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def mean3(x: Column) -> Column:
    """Rounded mean of values of three decimals, the same in whatever order they are added."""
    return F.floor(F.avg(F.round(x * 1000).cast("long")) + 0.5) / 1000


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def floor_seconds(a: Column, b: Column) -> Column:
    """Whole seconds from a to b, rounded down."""
    return F.floor((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1_000_000)


def epoch(a: Column) -> Column:
    return F.floor(F.unix_micros(a.cast("timestamp")) / 1_000_000)


def percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))


def label(p: Column, human: float, automation: float) -> Column:
    return F.when(p < human, "human_like").when(p < automation, "uncertain").otherwise("automation_like")
