"""Sources and sinks: wide and long panels, headerless text, encodings, inventories."""

from __future__ import annotations

import fnmatch
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.functions import scalars as S


def wide_panel(spark: SparkSession, path: str, time_column: str = "GMT", columns: list[str] | None = None) -> DataFrame:
    """A wide CSV, a column per entity, as (ts, entity, value): columns are pruned before they are stacked, and what is no number is NULL."""
    raw = spark.read.csv(path, header=True)
    wanted = columns or [c for c in raw.columns if c != time_column]
    long = raw.select(time_column, *wanted).unpivot([time_column], wanted, "entity", "text")
    return long.select(F.col(time_column).cast("timestamp_ntz").alias("ts"), "entity", S.clean_number(F.col("text")).alias("value"))


def meter_text(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Headerless text of `meter code value` over many files: rows of slots 1 to 48, and the others with their date."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(paths).select(parts[0].cast("int").alias("meter_id"), parts[1].cast("int").alias("code"), parts[2].try_cast("float").alias("value"))
    rows = rows.select("*", S.day_of_code(F.col("code")).alias("day"), S.slot_of_code(F.col("code")).alias("slot"))
    standard = F.col("slot").between(1, 48)
    return rows.filter(standard), rows.filter(~standard).withColumn("local_date", S.date_of_day(F.col("day")))


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether the whole file decodes as UTF-8. Read in Latin-1 lines, so that no file is held as a whole."""
    lines = spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\u0001", quote="").toDF("value")
    return lines.filter(~F.is_valid_utf8(F.encode("value", "ISO-8859-1").cast("string"))).limit(1).isEmpty()


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of which every column stays text, in UTF-8 or else Windows-1252; a byte-order mark is no part of the first name."""
    if is_utf8(spark, path):
        df = spark.read.csv(path, header=True, inferSchema=False)
        return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))
    # Spark reads Latin-1; the two differ in the places 0x80 to 0x9F.
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    here, there = ("".join(x) for x in zip(*(p for p in pairs if p[1])))
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="ISO-8859-1")
    table = str.maketrans(here, there)
    return df.select(*(F.translate(f"`{c}`", here, there).alias(c.translate(table)) for c in df.columns))


def row_block(df: DataFrame, index: str, first: int, last: int) -> DataFrame:
    """Rows of a closed range of an index column: a filter that reaches the scan."""
    return df.filter(F.col(index).between(first, last))


def conforms(df: DataFrame, schema: str, rows: int | None = None) -> list[str]:
    """How a table departs from a schema (DDL) and a number of rows: nothing if it doesn't. Rows are counted from file footers."""
    found, wanted = dict(df.dtypes), {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema).fields}
    out = [f"{n}: {found.get(n, 'missing')} in place of {t}" for n, t in wanted.items() if found.get(n) != t] + [f"{n}: not expected" for n in found if n not in wanted]
    if rows is not None and (n := df.count()) != rows:
        out.append(f"{n} rows in place of {rows}")
    return out


def one_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """The one file below a folder whose name matches a glob; an error for none or several. The file system of Spark is asked, wherever that is."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while listed.hasNext():
        name = listed.next().getPath()
        if fnmatch.fnmatch(name.getName(), pattern):
            found.append(name.toString())
    if len(found) != 1:
        raise FileNotFoundError(f"expected one file {pattern} below {folder}, found {sorted(found)}")
    return found[0]


def table_of(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, JSON or Parquet file by the end of its name; columns of a CSV stay text."""
    end = path.rsplit(".", 1)[-1].lower()
    readers = {"csv": lambda: text_csv(spark, path), "json": lambda: spark.read.json(path), "parquet": lambda: spark.read.parquet(path)}
    if end not in readers:
        raise ValueError(f"no reader for {path}")
    return readers[end]()


def write_partitioned(df: DataFrame, path: str, *by: str, schema: str | None = None, level: int = 3, group_rows: int = 250_000) -> None:
    """Parquet in zstd of a level, in row groups of at most group_rows rows, never over what is there; if a schema (DDL) is given, in exactly its columns and types."""
    if schema:
        df = df.select(*(F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(schema).fields))
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(level), "parquet.block.row.count.limit": str(group_rows)}
    df.write.mode("errorifexists").options(**options).partitionBy(*by).parquet(path)


#: Columns of a table of predictions.
PREDICTIONS = "entity string, target_ts timestamp, origin_ts timestamp, lead int, strategy string, seed int, actual float, predicted float, persistence float, daily float"


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions by strategy and lead, in their fixed schema; tasks write as they go and hold no more than a row group."""
    write_partitioned(df, path, "strategy", "lead", schema=PREDICTIONS, group_rows=131_072)


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """One report table as CSV with a header, JSON lines or Parquet: it appears as a whole or not at all, and never over what is there. Small results are one file, large ones several: what makes them keeps its tasks."""
    writer = df.hint("rebalance").write.mode("errorifexists")
    {"csv": lambda: writer.csv(path, header=True), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()


def write_report(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> list[str]:
    """Each named table into a place of its own below a folder; the places written."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", kind)
    return [f"{folder}/{name}" for name in tables]


def inventory(spark: SparkSession, path: str, piece: int = 1 << 20) -> DataFrame:
    """Relative path, bytes and SHA-256 of each file below a folder. Each file is read as a stream, in pieces, by the task that hashes it, so that its size has no bound."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(top).toString().rstrip("/") + "/"
    listed, rows = system.listFiles(top, True), []
    while listed.hasNext():
        f = listed.next()
        if f.getPath().getName()[0] in "._":
            continue  # marks of writers, no output
        rows.append((f.getPath().toString().removeprefix(base), f.getPath().toString(), f.getLen()))
    files = spark.createDataFrame(rows, "file string, place string, bytes long").repartition(max(1, len(rows)))

    def run(batches):
        from pyarrow import fs

        for pdf in batches:
            out = []
            for place in pdf["place"]:
                if place.startswith("file:"):
                    store, name = fs.LocalFileSystem(), place.removeprefix("file://").removeprefix("file:")
                else:
                    store, name = fs.FileSystem.from_uri(place)
                digest = hashlib.sha256()
                with store.open_input_stream(name) as stream:
                    while part := stream.read(piece):
                        digest.update(part)
                out.append(digest.hexdigest())
            yield pdf[["file", "bytes"]].assign(sha256=out)

    return files.mapInPandas(run, "file string, bytes long, sha256 string")


def shuffled_batches(samples: DataFrame, seed: int, epoch: int, *keys: str, size: int = 512, groups: int = 64) -> DataFrame:
    """Samples with (part, batch, place): batches of `size` in an order that (seed, epoch) fix.

    Groups of samples are shuffled by a hash of the group, samples within a group by a hash of their
    keys: groups run side by side, and no task sorts the whole table.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(groups))
    own = Window.partitionBy("__group").orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), *keys), *keys)
    dealt = samples.withColumn("__group", part).withColumn("place", F.row_number().over(own) - 1)
    order = samples.sparkSession.range(groups).select(F.col("id").alias("__group"), (F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), "id"), "id")) - 1).alias("part"))
    return dealt.join(F.broadcast(order), "__group").select(*samples.columns, "part", F.floor(F.col("place") / size).cast("int").alias("batch"), (F.col("place") % size).alias("place"))
