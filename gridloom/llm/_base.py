"""What the operators of this subpackage share: input, intermediate tables, workers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that a Python worker gets at once (or one row, where that has more).
BATCH_BYTES = 1 << 20
#: White space of every contract here: space and the five ASCII controls from tab to return.
WS = r"[\x20\x09-\x0D]+"


def release() -> None:
    """Gives this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function over record batches that gives free memory back at its end: workers are used again, also by other operators."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package wherever the driver was started, and bounds the bytes (not the rows) of the batches that they get: texts are long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    if before is None or not before.isdigit() or int(before) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (top, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, a local session gets a temporary one, as in tests; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _place(spark: SparkSession, name: str):
    """A path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


#: Spilled tables of the scopes that are open.
_SCOPES: list[list[tuple[SparkSession, str]]] = []


@contextlib.contextmanager
def scope():
    """Tables that are spilled inside are deleted at the end, but for those that are taken out of the list that it gives."""
    held: list[tuple[SparkSession, str]] = []
    _SCOPES.append(held)
    try:
        yield held
    finally:
        _SCOPES.pop()
        for spark, name in held:
            path, system = _place(spark, name)
            system.delete(path, True)


def spill(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors. What is not deleted before goes when the application ends."""
    spark = df.sparkSession
    name = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(name)
    path, system = _place(spark, name)
    system.deleteOnExit(path)
    if _SCOPES:
        _SCOPES[-1].append((spark, name))
    return spark.read.schema(df.schema).parquet(name)


def bucketed(df: DataFrame, tag: str, buckets: int, key: str) -> DataFrame:
    """Writes df as spill does, in buckets of the key, so that a join by the key need not shuffle it."""
    spark = df.sparkSession
    table = f"{tag}_{uuid.uuid4().hex}"
    name = f"{shared_dir(spark)}/{table}"
    df.write.bucketBy(buckets, key).option("path", name).saveAsTable(table)
    path, system = _place(spark, name)
    system.deleteOnExit(path)
    if _SCOPES:
        _SCOPES[-1].append((spark, name))
    return spark.table(table)


def forget(*frames: DataFrame) -> None:
    """Deletes spilled tables that nothing reads any more."""
    for df in frames:
        for name in {os.path.dirname(f) for f in df.inputFiles()}:
            path, system = _place(df.sparkSession, name)
            system.delete(path, True)


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of 128 bits of a row by content; repeated rows share it and get the same result."""
    parts = (F.coalesce(F.concat(F.lit("v"), x.cast("string")), F.lit("n")) for x in (doc_id, text))
    return F.unhex(F.md5(F.concat_ws("\x00", *parts).cast("binary")))


def held_out(doc_id: Column, parts: int, rest: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == rest, F.lit(False))


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs do not have."""
    taken = {c.lower() for c in docs.columns}
    found = f"__{name}__"
    while found in taken:
        found += "_"
    return found


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """docs with one row of each group, all columns; found has (id, mark, grp) for each row of docs in a group.

    A row is told by its id and its 64-bit mark of the content, which matters where ids repeat. The
    row of the smallest (id, mark) stays, null ids last. Of rows that share both, only one stays;
    which of them is not defined. The table of dropped rows is narrow, so that Spark may find it
    small enough to broadcast and need not shuffle texts.
    """
    at, own = free(docs, "id"), free(docs, "mark")
    order = F.struct(F.col("id").isNull().alias("late"), "id", "mark")
    best = found.groupBy("grp").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp", "best.id", "best.mark")
    best = spill(best.toDF("grp", at, own), "kept")
    members = found.join(best, "grp")
    same = F.col("id").eqNullSafe(F.col(at)) & (F.col("mark") == F.col(own))
    drop = spill(members.filter(~same).select(F.col("id").alias(at), F.col("mark").alias(own)).distinct(), "dropped")
    again = spill(members.filter(same).groupBy(at, own).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "again")
    forget(best)

    def those(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
        return rows.join(table, rows[id_col].eqNullSafe(table[at]) & (mark == table[own]), how)

    kept = those(docs, drop, "left_anti")
    if again.isEmpty():
        return kept
    twice = those(docs, again, "left_semi").withColumn(own, mark).dropDuplicates([id_col, own]).select(*docs.columns)
    return those(kept, again, "left_anti").union(twice)
