"""The property graph as tables of nodes and edges, partitioned by analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choralis.functions import settle

NODES = ("analysis", "post", "account", "reply", "pattern", "cluster")
EDGES = ("posted", "replies_to", "similar_to", "coordinated_with", "contains_pattern", "member_of")
ID = r"^[a-f0-9]{32}$"


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(ID), F.lit(False))


def write_graph(tables: dict[str, DataFrame], folder: str, mode: str = "append") -> None:
    """One partitioned table for each label and relationship; rows must have analysis_id."""
    for name, df in tables.items():
        df.write.mode(mode).partitionBy("analysis_id").parquet(f"{folder}/{name}")


def read_graph(spark: SparkSession, folder: str, name: str, analysis_id: str | None = None) -> DataFrame:
    found = spark.read.parquet(f"{folder}/{name}").schema  # where ids are digits alone, Spark takes them for numbers
    fields = [T.StructField(f.name, T.StringType() if f.name == "analysis_id" else f.dataType) for f in found]
    df = spark.read.schema(T.StructType(fields)).parquet(f"{folder}/{name}")
    return df if analysis_id is None else df.where(F.col("analysis_id") == analysis_id)


def graph_tables(a) -> dict[str, DataFrame]:
    """Nodes and edges of an analysis (see choralis.plans.analysis), with conv_id as analysis_id."""
    r = a.replies.select("conv_id", "pos", "reply_id")
    similar = a.top_edges.join(r.withColumnsRenamed({"pos": "i", "reply_id": "source"}), ["conv_id", "i"]).join(r.withColumnsRenamed({"pos": "j", "reply_id": "target"}), ["conv_id", "j"])
    tables = {
        "analysis": a.scores,
        "post": a.posts,
        "account": a.classified.select("conv_id", "account_id", "username", "reply_count", "component", "automation", "coordination", "confidence", "label", "category", "degree"),
        "reply": a.replies.join(a.similar.drop("account_id", "pos"), ["conv_id", "reply_id"]).join(a.timing.drop("pos"), ["conv_id", "reply_id"]),
        "pattern": a.patterns.select("conv_id", "pattern_id", "text", "account_count"),
        "cluster": a.clusters,
        "posted": a.replies.select("conv_id", "account_id", "reply_id"),
        "replies_to": a.replies.select("conv_id", "reply_id").join(a.posts.select("conv_id", "post_id"), "conv_id"),
        "similar_to": similar.select("conv_id", "source", "target", "sim", "dt"),
        "coordinated_with": a.coordination,
        "contains_pattern": a.patterns.select("conv_id", F.explode("reply_set").alias("reply_id"), "pattern_id"),
        "member_of": a.members.select("conv_id", "account_id", "cluster_id"),
    }
    return {k: v.withColumnRenamed("conv_id", "analysis_id") for k, v in tables.items()}


def kept_analyses(analyses: DataFrame, keep: int = 30) -> DataFrame:
    """analyses (analysis_id, created_at, demo, running) with kept: the newest that are neither demo nor running stay
    up to the limit, demo and running ones always. Only a limit's rows of each task meet in one task."""
    settled = analyses.where(~F.col("demo") & ~F.col("running"))
    newest = settled.orderBy(F.desc("created_at"), "analysis_id").limit(keep).select("analysis_id", F.lit(True).alias("new"))
    out = analyses.join(newest, "analysis_id", "left")
    return out.withColumn("kept", F.col("demo") | F.col("running") | F.coalesce("new", F.lit(False))).drop("new")


def status(runs: DataFrame, stored: DataFrame) -> DataFrame:
    """analysis_id, status, replies, accounts: the live run where there is one, else what is stored."""
    cols = ("status", "replies", "accounts")
    both = runs.select("analysis_id", *[F.col(c).alias(f"l_{c}") for c in cols]).join(stored.select("analysis_id", *cols), "analysis_id", "full")
    return both.select("analysis_id", *[F.coalesce(f"l_{c}", c).alias(c) for c in cols])


def stored_ids(names: DataFrame, prefix: str = "lens_") -> DataFrame:
    """Analysis ids of stored graph names: those with the prefix whose rest is a valid id."""
    rest = F.substring("name", len(prefix) + 1, 1000)
    return names.where(F.col("name").startswith(prefix)).select(rest.alias("analysis_id")).where(valid_id(F.col("analysis_id")))


def with_properties(nodes: DataFrame, computed: DataFrame, *key: str) -> DataFrame:
    """nodes with the columns of computed (one row for each key): a node whose key is there takes its values, nulls too;
    the others keep theirs, or null where the column is new. Keys without a node add nothing."""
    new = [c for c in computed.columns if c not in key]
    given = computed.select(*key, F.struct(*new).alias("_set"))
    found = F.col("_set").isNotNull()
    values = {c: F.when(found, F.col("_set")[c]).otherwise(F.col(c)) if c in nodes.columns else F.col("_set")[c] for c in new}
    return nodes.join(given, list(key), "left").withColumns(values).drop("_set")


def completed(analyses: DataFrame, scores: DataFrame) -> DataFrame:
    """analyses (analysis_id and others) with complete: whether scores (analysis_id and others) has a row for it, whose
    values it takes."""
    done = with_properties(analyses, scores.withColumn("complete", F.lit(True)), "analysis_id")
    return done.withColumn("complete", F.coalesce("complete", F.lit(False)))


def reset_ids(names: DataFrame, analyses: DataFrame) -> DataFrame:
    """Of the stored ids (analysis_id) those that a reset of the demo deletes: flagged demo, or without an analysis row."""
    known = analyses.select("analysis_id", F.coalesce("demo", F.lit(False)).alias("demo"))
    return names.select("analysis_id").distinct().join(known, "analysis_id", "left").where(F.coalesce("demo", F.lit(True))).select("analysis_id")


def delete_analyses(ids: DataFrame, folder: str) -> int:
    """Drops the partitions of the ids (analysis_id) from all tables of the folder; the number of partitions dropped. Ids
    are streamed, and only well-formed ones name a folder."""
    jvm, conf = ids.sparkSession._jvm, ids.sparkSession._jsc.hadoopConfiguration()
    dropped = 0
    for row in ids.select("analysis_id").where(valid_id(F.col("analysis_id"))).distinct().toLocalIterator():
        for name in (*NODES, *EDGES):
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/analysis_id={row[0]}")
            dropped += path.getFileSystem(conf).delete(path, True)
    return dropped


def newest(spark: SparkSession, path: str) -> int:
    """The number of the table's last manifest that was written to its end, -1 where there is none."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/n=*/_SUCCESS")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    return max((int(f.getPath().getParent().getName()[2:]) for f in found), default=-1)


def _manifest(spark: SparkSession, path: str, unit: str, n: int) -> DataFrame:
    return spark.read.schema(f"`{unit}` string, version string").parquet(f"{path}/manifest/n={n}")


def put_stored(rows: DataFrame, path: str, unit: str = "analysis_id") -> None:
    """rows as the first version of a table that `upsert` changes, in partitions by the column unit, whose values are taken
    as text and must not be null. A table that exists already is an error."""
    version = f"v{uuid.uuid4().hex}"
    known = F.coalesce(F.col(unit).cast("string"), F.raise_error(F.lit(f"{unit} is null")).cast("string"))
    rows.withColumn(unit, known).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", unit).parquet(f"{path}/rows")
    units = rows.select(F.col(unit).cast("string").alias(unit)).distinct()
    units.withColumn("version", F.lit(version)).write.parquet(f"{path}/manifest/n=0")


def stored(spark: SparkSession, path: str, unit: str = "analysis_id", n: int | None = None) -> DataFrame:
    """The table as its last whole manifest has it, or manifest n. A reader keeps what it began with: writes add files and
    manifests and change none. Columns that only some versions have are null in the others."""
    held = _manifest(spark, path, unit, newest(spark, path) if n is None else n)
    found = spark.read.option("mergeSchema", True).parquet(f"{path}/rows").schema
    typed = T.StructType([T.StructField(f.name, T.StringType() if f.name in (unit, "version") else f.dataType) for f in found])
    rows = spark.read.schema(typed).parquet(f"{path}/rows")
    return rows.join(held, [unit, "version"], "left_semi").drop("version")


def upsert(computed: DataFrame, path: str, *key: str, unit: str = "analysis_id") -> int:
    """Nodes whose unit and key are in computed (one row for each) take its other columns, as `with_properties` has it; the
    number of the manifest that shows it. Only partitions that computed names are written, under a new version, and the
    manifest comes last: a write that is killed leaves the old state, as does the later of two writers, which fails.
    Units that the table hasn't are ignored; an empty computed changes no row."""
    spark = computed.sparkSession
    n = newest(spark, path)
    version = f"v{uuid.uuid4().hex}"
    given = computed.withColumn(unit, F.col(unit).cast("string"))
    touched = given.select(unit).distinct()
    rows = with_properties(stored(spark, path, unit, n).join(touched, unit, "left_semi"), given, unit, *key)
    rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", unit).parquet(f"{path}/rows")
    held = _manifest(spark, path, unit, n)
    now = held.join(touched.withColumn("new", F.lit(version)), unit, "left").select(unit, F.coalesce("new", "version").alias("version"))
    now.write.parquet(f"{path}/manifest/n={n + 1}")
    return n + 1


def clustered(rows: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """rows as a catalogue table in sorted buckets of the key: joins and look-ups by the key with other tables of as many
    buckets move no rows. The number of buckets should follow the size, some 200 MB a bucket."""
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", settle.fresh_path(spark, name)).saveAsTable(table)
    return spark.table(table)
