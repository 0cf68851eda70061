"""Pieces that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python worker works on at once, besides a single longer text.
CHUNK_CHARS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; only where it is unset on one machine, as in
    tests, a temporary folder takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="choralis-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, read as often as needed, kept when an executor is lost. options:
    of the writer."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def lean_worker():
    """Around a task's Python code: memory that the task has freed goes back to the system at its end, for a worker lives
    on and later tasks of other stages add theirs."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def quoted(name: str) -> str:
    """The column of that name, whatever dots or backticks it holds."""
    return "`" + name.replace("`", "``") + "`"


def without(batch: pa.RecordBatch, *names: str) -> dict[str, pa.Array]:
    """The batch's columns but for those named so in any case of letters."""
    gone = {n.lower() for n in names}
    return {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.lower() not in gone}


def schema_without(docs: DataFrame, *names: str) -> T.StructType:
    """The schema of what `without` leaves."""
    gone = {n.lower() for n in names}
    return T.StructType([f for f in docs.schema.fields if f.name.lower() not in gone])


def few(values: list, most: int, what: str) -> list:
    """values, or an error where there are more than `most`: what reaches the driver or a broadcast must be bounded."""
    if len(values) > most:
        raise ValueError(f"more than {most} {what}: raise the bound, or merge the rare ones first")
    return values


def row_key_of(docs: DataFrame) -> Column:
    """64 bits of all columns that can be hashed, that is without maps."""
    return row_key(*[quoted(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, or name with underscores behind it, such that no taken name equals it in any case of letters."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def least_hashes(rows: DataFrame, group: str, h: str, most: int, size: str | None = None, most_size: int = 0) -> DataFrame:
    """Of each group's rows the `most` with the least hashes h, and of these, in order, as many as `most_size` of the
    column size allow, one at least. A sample that is as large whatever the number of rows: counts of a logarithmic
    histogram tell first which rows can be among the least, so only about `most` rows of a group meet in one task."""
    cell = F.floor(F.log2(F.shiftrightunsigned(h, 1).cast("double") + 1) * 16)
    counts = rows.groupBy(F.col(group).alias("_group"), cell.alias("_cell")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_cell")) - F.col("_n")
    cut = counts.withColumn("_before", before).where(F.col("_before") < most).groupBy("_group").agg(F.max("_cell").alias("_cut"))
    near = rows.join(cut, F.col(group).eqNullSafe(F.col("_group"))).where(cell <= F.col("_cut")).drop("_group", "_cut")
    order = Window.partitionBy(group).orderBy(F.shiftrightunsigned(h, 1), h)
    kept = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    if size:
        held = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
        kept = kept.withColumn("_held", held).where((F.col("_held") <= most_size) | (F.col("_rank") == 1)).drop("_held")
    return kept.drop("_rank")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*cols: str) -> Column:
    """64 bits of the named columns; a null differs from every value."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def crc_mod_py(doc_id, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), each of about `most` bytes or of one longer text."""
    most = most or CHUNK_CHARS
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(col):
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, end - at), [t or "" for t in col.slice(at, end - at).to_pylist()]
            at = end


#: Rows and bytes that go to a Python worker at once, where the session leaves Spark's defaults (10,000 and 64 MB).
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def map_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """rows.mapInArrow in small batches, with the memory given back at each task's end. Names with dots or backticks, which
    mapInArrow itself reads as paths, reach `run` as they are."""
    conf = rows.sparkSession.conf
    for name, (default, own) in BATCHES.items():
        if conf.get(name, default) == default:
            conf.set(name, own)

    plain = rows
    names = rows.columns
    if odd := any("." in n or "`" in n for n in names):
        plain = rows.toDF(*[f"c{k}" for k in range(len(names))])
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    made = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(schema.fields)]) if odd else schema

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_worker():
            if odd:
                for out in run(b.rename_columns(names) for b in batches):
                    yield out.rename_columns([f"c{k}" for k in range(out.num_columns)])
            else:
                yield from run(batches)

    out = plain.mapInArrow(lean, made)
    return out.toDF(*[f.name for f in schema.fields]) if odd else out
