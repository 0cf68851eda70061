"""When similar replies arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choralis.config import Config
from choralis.functions.exact import clamp, epoch, floor_seconds, round3


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once however often f uses it, in lambdas too: a lambda's argument is."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def regularity(times: Column) -> Column:
    """1 - deviation / mean of the gaps between sorted times, 0 to 1; null below four times, 1 if all are equal."""

    def of_gaps(gaps: Column) -> Column:
        n = F.size(gaps).cast("double")
        mean = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g) / n

        def of_mean(mean: Column) -> Column:
            spread = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + (g - mean) * (g - mean)) / n)
            return F.when(mean == 0, 1.0).otherwise(round3(clamp(1 - spread / F.nullif(mean, F.lit(0.0)))))

        return _once(mean, of_mean)

    def of_times(t: Column) -> Column:
        return _once(F.transform(F.sequence(F.lit(2), F.size(t)), lambda k: F.get(t, k - 1) - F.get(t, k - 2)), of_gaps)

    return F.when(F.size(times) >= 4, _once(times, of_times))


def reply_timing(replies: DataFrame, posts: DataFrame, directed: DataFrame, config: Config) -> DataFrame:
    """conv_id, pos, seconds_after, within30, within60, in_burst, regularity."""
    when = replies.select("conv_id", F.col("pos").alias("j"), epoch(F.col("created_at")).alias("e"))
    near = directed.where(F.col("sim") >= config.similar).join(when, ["conv_id", "j"])
    near = near.groupBy("conv_id", F.col("i").alias("pos")).agg(
        F.count(F.when(F.col("dt") <= 30, 1)).alias("within30"), F.count(F.when(F.col("dt") <= 60, 1)).alias("within60"), F.collect_list("e").alias("others")
    )
    after = F.greatest(F.lit(0).cast("long"), floor_seconds(F.col("posted_at"), F.col("created_at")))
    base = replies.join(posts.select("conv_id", F.col("created_at").alias("posted_at")), "conv_id")
    base = base.select("conv_id", "pos", "reply_id", after.alias("seconds_after"), epoch(F.col("created_at")).alias("own"))
    out = base.join(near, ["conv_id", "pos"], "left")
    w60 = F.coalesce("within60", F.lit(0))
    times = F.sort_array(F.concat(F.array("own"), F.coalesce("others", F.array().cast("array<bigint>"))))
    return out.select("conv_id", "pos", "reply_id", "seconds_after", F.coalesce("within30", F.lit(0)).alias("within30"), w60.alias("within60"), (w60 >= config.burst).alias("in_burst"), regularity(times).alias("regularity"))
