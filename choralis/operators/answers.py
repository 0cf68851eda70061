"""Answers of external scorers, kept from one run to the next."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from choralis.functions.settle import kept


def key_of(payload: str) -> Column:
    return F.sha2(payload, 256)


@dataclass(frozen=True)
class AnswerCache:
    """A table of answers by the hash of what was asked, of which the `keep` used last stay.

    Each update writes a new version beside the old one and only then removes those before that, so a reader finds a whole
    version at any time and a run that is killed leaves the last one as it was. Runs that update at once both stay right:
    one's answers are lost and asked for again.
    """

    folder: str
    keep: int = 2_000

    def _versions(self, spark: SparkSession) -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [x.getPath().getName() for x in files.listStatus(path)]
        whole = [n for n in names if n.startswith("v") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in whole)

    def entries(self, spark: SparkSession, schema: str) -> DataFrame:
        """key, the answer's columns and used: microseconds of the last use."""
        found = self._versions(spark)
        full = f"key string, {schema}, used long"
        return spark.read.schema(full).parquet(f"{self.folder}/v{found[-1]}") if found else spark.createDataFrame([], full)

    def answered(self, asked: DataFrame, ask, schema: str) -> DataFrame:
        """payload, reason and the answer's columns for each payload of asked: from the table, or from `ask` (a function of a
        DataFrame of payloads), which is only given those that aren't there. Answers with a reason, which failed, aren't kept."""
        told = asked.select("payload").distinct().withColumn("asked", key_of("payload"))
        got = self.by_key(asked, ask, schema)
        return told.join(got, F.col("asked").eqNullSafe(F.col("key"))).drop("asked", "key")

    def by_key(self, asked: DataFrame, ask, schema: str) -> DataFrame:
        """The same with the payload's key instead, which moves in its place: payloads are as long as the texts they hold, and
        only those that `ask` is given move."""
        spark, now = asked.sparkSession, time.time_ns() // 1000
        names = [f.split()[0] for f in schema.split(", ")]
        held = self.entries(spark, schema)
        told = asked.select("payload", key_of("payload").alias("key"))
        keys = kept(told.select("key").distinct(), "asked-keys")
        known = kept(keys.join(held.drop("used"), "key"), "known-answers")
        missing = kept(keys.join(held, "key", "left_anti").withColumnRenamed("key", "missing"), "missing-answers")
        unknown = told.join(missing, F.col("key").eqNullSafe(F.col("missing")), "left_semi").groupBy("key").agg(F.first("payload").alias("payload"))
        new = kept(ask(unknown.select("payload")).select(key_of("payload").alias("key"), "reason", *names), "new-answers")
        fresh = new.where("reason is null").select("key", *names, F.lit(now).alias("used"))
        old = held.join(known.select("key"), "key", "left_anti").unionByName(known.select("key", *names).withColumn("used", F.lit(now)))
        self._write(old.unionByName(fresh).orderBy(F.desc("used"), "key").limit(self.keep))
        return known.select("key", F.lit(None).cast("string").alias("reason"), *names).unionByName(new)

    def _write(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        found = self._versions(spark)
        rows.write.mode("overwrite").parquet(f"{self.folder}/v{(found[-1] if found else 0) + 1}")
        for n in found[:-1]:  # the one before may still be read
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{n}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
