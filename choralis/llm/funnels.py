"""Ordered funnels: how many attempts of a client reach each step, and how long the steps take.

A row of a funnel's first kind starts an attempt. The next step is the client's earliest row of its kind that is later
than the previous step. It is reached unless it comes over `within` after the previous step, or an excluded row lies
after the previous step and not after the next; otherwise the attempt ends.

The next row of every kind, excluded kinds included, is a running minimum over a native range window from one microsecond
following to the end: in time order read backwards, which is the same frame at a cost linear in its rows. Since no step
looks further than `within`, a client's rows are cut into spans of `span`, and rows in the first `within` of a span are
also dealt to the span before it, where they are only looked at. So the windows of a client with a third of all rows
are as many as its spans. Attempts then go from step to step by equi-joins on client, kind and time.

A median is exact: the times of each step are counted in cells of CELL microseconds, the running number of the times
before each cell (at most within / CELL of them) tells in which cell the wanted one lies, and only that cell's distinct
times, at most CELL, are ranked in a window.

Defined cases. Rows with a null client, kind or time take no part, and rows that agree in the three count once, so rows
that repeat change nothing; ties in time are not later than each other, so they never follow one another, but an excluded
row at the time of the next step excludes it. A client without a first step is absent, an empty table gives an empty
result. Texts may be of any length. Columns besides the three are not read, so their names may be any.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choralis.llm.common import written

MINUTE = 60_000_000
#: Microseconds of a cell: about the root of the 15 minutes that times lie in, so cells and times in a cell are as many.
CELL = 30_000


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, ...]
    excluded: tuple[str, ...] = field(default=())


def micros(rows: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a time; of one without a zone as its clock shows, whatever the session's zone is."""
    c = F.col(ts)
    if dict(rows.dtypes)[ts] != "timestamp_ntz":
        return F.unix_micros(c)
    day = F.unix_date(c.cast("date")).cast("long") * (24 * 60 * MINUTE)
    seconds = F.date_part(F.lit("SECOND"), c)  # with six decimals
    minutes = F.hour(c).cast("long") * 60 + F.minute(c)
    return day + minutes * MINUTE + (seconds * 1_000_000).cast("long")


def next_rows(rows: DataFrame, kinds: Sequence[str], within: int, span: int, client: str = "client_id", kind: str = "kind", ts: str = "ts") -> DataFrame:
    """client, kind, us of the distinct rows, and next_<i>: the time of the client's earliest later row of kinds[i], null
    if there is none within `within` microseconds."""
    told = rows.select(F.col(client).alias("client"), F.col(kind).alias("kind"), micros(rows, ts).alias("us")).where("client is not null and kind is not null and us is not null")
    home = F.floor(F.col("us") / span).cast("long")
    first = F.floor((F.col("us") - within) / span).cast("long")
    # dealt once by client and span: the distinct rows and the windows need no further exchange
    dealt = told.withColumn("home", home).withColumn("span", F.explode(F.sequence(first, F.col("home")))).repartition("client", "span")
    each = dealt.groupBy("client", "span", "kind", "us").agg(F.max(F.col("home") == F.col("span")).alias("own"))
    later = Window.partitionBy("client", "span").orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, -1)
    found = each.select("*", *[F.min(F.when(F.col("kind") == k, F.col("us"))).over(later).alias(f"next_{i}") for i, k in enumerate(kinds)])
    return found.where("own").select("client", "kind", "us", *[F.when(F.col(f"next_{i}") - F.col("us") <= within, F.col(f"next_{i}")).alias(f"next_{i}") for i in range(len(kinds))])


def _reached(funnel: Funnel, step: int, kinds: Sequence[str]) -> Column:
    """The time of the step (counted from 0) that follows a row of the step before, null if it isn't reached."""
    to = F.col(f"next_{kinds.index(funnel.steps[step])}")
    out = [F.col(f"next_{kinds.index(k)}") for k in funnel.excluded]
    return reduce(lambda x, stop: F.when(stop.isNull() | (stop > to), x), out, to)


def attempts(rows: DataFrame, funnels: Sequence[Funnel], within: int = 15 * MINUTE, span: int = 60 * MINUTE, **columns: str) -> DataFrame:
    """One row for each attempt: funnel (its place), client, d2, d3, ...: microseconds of each reached step from the one
    before, null from the first step that isn't reached on."""
    kinds = sorted({k for f in funnels for k in (*f.steps[1:], *f.excluded)})
    most = max(len(f.steps) for f in funnels)
    follow = written(next_rows(rows, kinds, within, span, **columns), "funnel-next")
    firsts = [follow.where(F.col("kind") == f.steps[0]).select(F.lit(i).alias("funnel"), "client", "us", _reached(f, 1, kinds).alias("to")) for i, f in enumerate(funnels)]
    at = reduce(DataFrame.unionAll, firsts).withColumn("d2", F.col("to") - F.col("us")).drop("us")
    done = []
    for step in range(2, most):
        done.append(at.where("to is null").select("funnel", "client", *[F.col(f"d{s}") if s <= step else F.lit(None).cast("long").alias(f"d{s}") for s in range(2, most + 1)]))
        # the rows that a step ends at, with the time of the step after it
        ends = [
            follow.where(F.col("kind") == f.steps[step - 1]).select(F.lit(i).alias("funnel"), "client", "kind", F.col("us").alias("to"), _reached(f, step, kinds).alias("then"))
            for i, f in enumerate(funnels) if len(f.steps) > step
        ]
        names = F.create_map(*[x for i, f in enumerate(funnels) for x in (F.lit(i), F.lit(f.steps[step - 1] if len(f.steps) >= step else None))])
        moved = at.where("to is not null").withColumn("kind", names[F.col("funnel")])
        # an attempt whose next step is out of reach has no row to meet
        hit = reduce(DataFrame.unionAll, ends).where("then is not null")
        at = moved.join(hit, ["funnel", "client", "kind", "to"], "left").withColumn(f"d{step + 1}", F.col("then") - F.col("to")).drop("to", "kind").withColumnRenamed("then", "to")
    return reduce(DataFrame.unionAll, [*done, at.drop("to").select("funnel", "client", *[f"d{s}" for s in range(2, most + 1)])])


def percentiles(times: DataFrame, keys: Sequence[str], percent: int = 50, cell: int = CELL) -> DataFrame:
    """keys, t: the ceil(percent * n / 100)-th smallest of the n times d (whole, 0 or more) of each key."""
    counts = times.groupBy(*keys, "d").agg(F.count("*").alias("n")).withColumn("cell", F.floor(F.col("d") / cell).cast("long"))
    counts = written(counts, "funnel-times")
    cells = counts.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys)
    told = cells.select(*keys, "cell", "n", F.sum("n").over(by.orderBy("cell")).alias("upto"), F.sum("n").over(by).alias("all"))
    want = F.floor((F.col("all") * percent + 99) / 100).cast("long")
    chosen = told.withColumn("want", want).where("upto - n < want and want <= upto").select(*keys, "cell", (F.col("want") - F.col("upto") + F.col("n")).alias("want"))
    near = counts.join(chosen, [*keys, "cell"])
    rank = F.sum("n").over(by.orderBy("d"))
    return near.withColumn("upto", rank).where("upto - n < want and want <= upto").select(*keys, F.col("d").alias("t"))


def count_funnels(rows: DataFrame, funnels: Sequence[Funnel], within: int = 15 * MINUTE, span: int = 60 * MINUTE, percent: int = 50, **columns: str) -> DataFrame:
    """funnel, client_id, n1, n2, ...: attempts that reach each step, deepest: the last step that any reached, t2, t3, ...:
    percentiles of the steps' microseconds, same_depth: clients of equal funnel and deepest."""
    most = max(len(f.steps) for f in funnels)
    tried = written(attempts(rows, funnels, within, span, **columns), "funnel-attempts")
    steps = range(2, most + 1)
    numbers = tried.groupBy("funnel", "client").agg(F.count("*").alias("n1"), *[F.count(f"d{s}").alias(f"n{s}") for s in steps])
    times = tried.where("d2 is not null").select("funnel", "client", F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"d{s}").alias("d")) for s in steps])).alias("x"))
    middle = percentiles(times.select("funnel", "client", "x.*").where("d is not null"), ["funnel", "client", "step"], percent)
    middle = middle.groupBy("funnel", "client").agg(*[F.max(F.when(F.col("step") == s, F.col("t"))).alias(f"t{s}") for s in steps])
    deepest = reduce(lambda x, s: F.when(F.col(f"n{s}") > 0, s).otherwise(x), steps, F.lit(1)).alias("deepest")
    full = written(numbers.select("*", deepest).join(middle, ["funnel", "client"], "left"), "funnel-clients")
    alike = full.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))  # a row for each funnel and step at most
    names = F.create_map(*[x for i, f in enumerate(funnels) for x in (F.lit(i), F.lit(f.name))])
    out = full.join(F.broadcast(alike), ["funnel", "deepest"])
    return out.select(names[F.col("funnel")].alias("funnel"), F.col("client").alias("client_id"), "n1", *[f"n{s}" for s in steps], "deepest", *[f"t{s}" for s in steps], "same_depth")
