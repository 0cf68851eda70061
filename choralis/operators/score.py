"""How automated and coordinated a whole conversation looks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choralis.config import Config
from choralis.functions.exact import round3


def thread_score(classified: DataFrame, graph: DataFrame, similar: DataFrame, in_cluster: DataFrame, config: Config) -> DataFrame:
    """Four shares and their weighted sum, at most 1; without accounts all are 0."""
    sized = in_cluster.groupBy("conv_id", "cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= config.large_cluster)
    large = sized.groupBy("conv_id").agg(F.sum("n").alias("large"))
    rows = classified.select("conv_id", "account_id", "label").join(graph.select("conv_id", "account_id", "coordinated"), ["conv_id", "account_id"])
    by = rows.groupBy("conv_id").agg(
        F.count("*").alias("accounts"), F.count(F.when(F.col("label") == "automation_like", 1)).alias("automated"), F.count(F.when(F.col("coordinated") > 0, 1)).alias("coordinated")
    )
    dup = similar.groupBy("conv_id").agg(F.avg(F.col("near_duplicate").cast("int")).alias("dup"))
    out = by.join(dup, "conv_id").join(large, "conv_id", "left")
    a, c = F.col("automated") / F.col("accounts"), F.col("coordinated") / F.col("accounts")
    big = F.coalesce("large", F.lit(0)) / F.col("accounts")
    total = F.least(F.lit(1.0), 0.40 * a + 0.20 * c + 0.25 * F.col("dup") + 0.15 * big)
    return out.select("conv_id", round3(total).alias("score"), round3(a).alias("automation_share"), round3(c).alias("coordinated_share"), round3(F.col("dup")).alias("duplicate_share"), round3(big).alias("large_cluster_share"))
