"""Joins and counts by nearness in time, for any number of rows of a key.

A key's rows are cut into buckets of time, so a key with a third of all rows is as many groups as it has buckets; only
rows near a border are dealt twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _named(taken: Sequence[str], name: str) -> str:
    held = {x.lower() for x in taken}
    while name.lower() in held:
        name += "_"
    return name


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, most: int, residual: Column | None = None) -> DataFrame:
    """All columns of the rows of both sides that agree in `on` and whose times, whole numbers, differ by at most `most`.

    Buckets are as wide as that, so a row of the left meets its own and the two beside it: rows of the right, which should
    be the fewer, are dealt to the buckets that they can be met from. A pair meets in the left row's bucket alone, so none
    comes twice. Null keys and null times meet nothing; rows that repeat meet each; names but those of `on` must differ.
    """
    width = max(1, most)
    bucket = _named([*left.columns, *right.columns], "bucket")
    near = F.explode(F.sequence(F.floor((F.col(right_time) - most) / width), F.floor((F.col(right_time) + most) / width)))
    a = left.where(F.col(left_time).isNotNull()).withColumn(bucket, F.floor(F.col(left_time) / width))
    b = right.where(F.col(right_time).isNotNull()).withColumn(bucket, near)
    met = a.join(b, [*on, bucket]).drop(bucket).where(F.abs(F.col(left_time) - F.col(right_time)) <= most)
    return met if residual is None else met.where(residual)


def near_counts(rows: DataFrame, by: Sequence[str], time: str, reaches: dict[str, int], span: int | None = None) -> DataFrame:
    """rows with, for each name of `reaches`, the number of other rows of the same `by` within so much time, both ways.

    The number is that of a value range around each row. It is taken as the difference of two frames that only grow, the
    rows up to the range's end and those before its start, so that its cost is linear in the rows however many a range
    holds. Windows are over spans of time, by default 16 times the longest reach, with the rows beside them that their
    ranges can reach. Rows with a null key or time are no one's neighbours and get nulls; ties are neighbours.
    """
    longest = max(reaches.values())
    span = span or max(1, 16 * longest)
    home, cut, own = (_named([*rows.columns, *reaches], x) for x in ("home", "span", "own"))
    t = F.col(time)
    known = F.lit(True)
    for c in [*by, time]:
        known = known & F.col(c).isNotNull()
    told = rows.where(known).withColumn(home, F.floor(t / span))
    dealt = told.withColumn(cut, F.explode(F.sequence(F.floor((t - longest) / span), F.floor((t + longest) / span))))
    order = Window.partitionBy(*by, cut).orderBy(time)

    def upto(end: int) -> Column:
        return F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, end))

    counts = {name: upto(r) - upto(-r - 1) - 1 for name, r in reaches.items()}
    found = dealt.select("*", *[c.alias(n) for n, c in counts.items()]).withColumn(own, F.col(home) == F.col(cut)).where(own).drop(home, cut, own)
    return found.unionByName(rows.where(~known).select("*", *[F.lit(None).cast("long").alias(n) for n in counts]))
