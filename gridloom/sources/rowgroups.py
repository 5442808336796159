"""Parquet by row groups: partitions come from file footers, in an order that a seed and an epoch fix."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from gridloom.sources.stores import opened, register

#: Places of a sample in the epoch.
PLACES = [pa.field("part", pa.int32()), pa.field("batch", pa.int32()), pa.field("place", pa.int32())]


#: Tasks of a scan at most: the driver holds these, and Spark what it knows of each.
TASKS = 128


@dataclass
class Stretch(InputPartition):
    """Row groups (file, number) that follow one another in the epoch's order; `first` is the place of the first."""

    first: int
    groups: list[tuple[str, int]]


def files_of(place: str) -> list[str]:
    store, name = opened(place)
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [place]
    found = store.get_file_info(fs.FileSelector(name, recursive=True))
    front = place.rstrip("/")
    return sorted(front + f.path[len(name.rstrip("/")) :] for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


class RowGroups(DataSource):
    """Options: path, seed, epoch, batch, columns (names with commas, all by default), and split_column with split: only rows of this value are samples."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def _arrow(self) -> pa.Schema:
        store, name = opened(files_of(self.options["path"])[0])
        with store.open_input_file(name) as f:
            whole = pq.read_schema(f)
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        return pa.schema([whole.field(c) for c in wanted] if wanted else list(whole))

    def schema(self) -> StructType:
        return from_arrow_schema(pa.schema([*self._arrow(), *PLACES]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options), self._arrow())


class Reader(DataSourceReader):
    def __init__(self, options: dict, arrow: pa.Schema):
        self.path, self.arrow = options["path"], arrow
        self.seed, self.epoch, self.batch = (int(options.get(k, d)) for k, d in (("seed", 0), ("epoch", 1), ("batch", 512)))
        self.split = (options["split_column"], options["split"]) if "split" in options else None

    def partitions(self) -> list[Stretch]:
        every = []
        for file in files_of(self.path):
            store, name = opened(file)
            with store.open_input_file(name) as f:
                every += [(file, i) for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
        order = np.random.default_rng([self.seed, self.epoch]).permutation(len(every))
        size = max(1, -(-len(every) // TASKS))
        return [Stretch(at, [every[k] for k in order[at : at + size]]) for at in range(0, len(every), size)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        columns = [*self.arrow.names, *([self.split[0]] if self.split and self.split[0] not in self.arrow.names else [])]
        with ExitStack() as stack:
            held: dict[str, pq.ParquetFile] = {}
            for part, (file, group) in enumerate(partition.groups, partition.first):
                if file not in held:
                    store, name = opened(file)
                    held[file] = pq.ParquetFile(stack.enter_context(store.open_input_file(name)))
                yield from self._batches(held[file].read_row_group(group, columns=columns), part)

    def _batches(self, rows: pa.Table, part: int) -> Iterator[pa.RecordBatch]:
        if self.split:
            rows = rows.filter(pa.compute.equal(rows[self.split[0]].cast(pa.string()), self.split[1]))
        rows = rows.select(self.arrow.names)
        rows = rows.take(np.random.default_rng([self.seed, self.epoch, part]).permutation(len(rows)))
        at = np.arange(len(rows))
        places = [np.full(len(rows), part), at // self.batch, at % self.batch]
        for field, values in zip(PLACES, places):
            rows = rows.append_column(field, pa.array(values.astype(np.int32)))
        yield from rows.to_batches(max_chunksize=8192)


def batches(spark: SparkSession, path: str, seed: int, epoch: int, size: int = 512, columns: list[str] | None = None, split: tuple[str, str] | None = None) -> DataFrame:
    """Samples of a Parquet file or folder with (part, batch, place): row groups in shuffled order, rows shuffled within each, by (seed, epoch).

    A task holds one row group at a time, of a stretch of the epoch's order, so that tasks don't grow with
    row groups; it reads no other column than those asked for. Nothing is shuffled between tasks.
    """
    options = {"path": path, "seed": seed, "epoch": epoch, "batch": size, "columns": ",".join(columns or [])}
    if split:
        options |= {"split_column": split[0], "split": split[1]}
    return spark.read.format(register(spark, RowGroups)).options(**options).load()
