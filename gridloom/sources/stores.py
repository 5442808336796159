"""Files for tasks that read or write them without Spark's own readers, wherever they are."""

from __future__ import annotations

import sys

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession


def opened(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and its name there."""
    if place.startswith("file:"):
        return fs.LocalFileSystem(), "/" + place.removeprefix("file:").lstrip("/")
    if "://" in place:
        return fs.FileSystem.from_uri(place)
    return fs.LocalFileSystem(), place


def register(spark: SparkSession, kind: type) -> str:
    """Makes a Python data source known to the session; its module travels with it, so that workers need not have it."""
    for name in (kind.__module__, __name__):
        cloudpickle.register_pickle_by_value(sys.modules[name])
    spark.dataSource.register(kind)
    return kind.name()
