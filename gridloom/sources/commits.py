"""A sink whose files appear together: tasks write beside the target, one commit moves them, an abort leaves nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import csv, fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from gridloom.sources.stores import opened, register

#: Rows that a task holds before it writes them.
ROWS = 250_000


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class Committed(DataSource):
    """Options: path, kind (parquet, csv, json), rows (of a buffer), level (of zstd, for Parquet)."""

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("files are never written over others: take a new path")
        return Writer(dict(self.options))


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "parquet")
        self.rows, self.level = int(options.get("rows", ROWS)), int(options.get("level", 3))
        if self.kind not in ("parquet", "csv", "json"):
            raise ValueError(f"no writer for {self.kind}")
        store, name = opened(self.path)
        if store.get_file_info(name).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} is there already")
        # Beside the target, so that the last step is a rename within one store.
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"
        store.create_dir(opened(self.staging)[1], recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file of this attempt, under a name of its own: a second attempt of a task never meets the first one's."""
        name, rows = f"part-{uuid.uuid4().hex}.{self.kind}", 0
        store, top = opened(self.staging)
        sink, held, size = None, [], 0

        def flush() -> None:
            nonlocal sink, held, size
            table = pa.Table.from_batches(held)
            if sink is None:
                sink = _Sink(store, f"{top}/{name}", table.schema, self.kind, self.level)
            sink.write(table)
            held, size = [], 0

        try:
            for batch in iterator:
                while batch.num_rows:
                    part = batch.slice(0, self.rows - size)
                    held.append(part)
                    size, rows, batch = size + part.num_rows, rows + part.num_rows, batch.slice(part.num_rows)
                    if size == self.rows:
                        flush()
            if held:
                flush()
        finally:
            if sink is not None:
                sink.close()
        return Written(name if rows else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = opened(self.staging)
        for i, m in enumerate(m for m in messages if m is not None and m.name):
            store.move(f"{top}/{m.name}", f"{top}/part-{i:05d}.{self.kind}")
        kept = {f"part-{i:05d}.{self.kind}" for i, _ in enumerate([m for m in messages if m is not None and m.name])}
        for f in store.get_file_info(fs.FileSelector(top)):
            if f.base_name not in kept:  # of attempts that did not win
                store.delete_file(f.path)
        store.move(top, opened(self.path)[1])

    def abort(self, messages: list[Written | None]) -> None:
        store, top = opened(self.staging)
        if store.get_file_info(top).type != fs.FileType.NotFound:
            store.delete_dir(top)


class _Sink:
    """A file of one kind, written table by table."""

    def __init__(self, store: fs.FileSystem, name: str, schema: pa.Schema, kind: str, level: int):
        self.stream, self.kind = store.open_output_stream(name), kind
        if kind == "parquet":
            self.writer = pq.ParquetWriter(self.stream, schema, compression="zstd", compression_level=level)
        elif kind == "csv":
            self.writer = csv.CSVWriter(self.stream, schema)

    def write(self, table: pa.Table) -> None:
        if self.kind == "json":
            self.stream.write("".join(json.dumps({k: v for k, v in r.items() if v is not None}, default=str, ensure_ascii=False) + "\n" for r in table.to_pylist()).encode())
        else:
            self.writer.write_table(table)

    def close(self) -> None:
        if self.kind != "json":
            self.writer.close()
        self.stream.close()


def write(df: DataFrame, path: str, kind: str = "parquet", rows: int = ROWS, level: int = 3) -> None:
    """df as files below path: all of them or none, never over what is there. A task buffers `rows` rows (a row group of Parquet). Tables without rows leave an empty folder."""
    name = register(df.sparkSession, Committed)
    df.write.format(name).mode("append").options(path=path, kind=kind, rows=rows, level=level).save()
