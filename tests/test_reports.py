"""Report tables as a graph of views."""

from graphlib import CycleError

import pytest
from pyspark.sql import functions as F

from gridloom.plans.reports import View, copied, reshaped, static, written


def test_each_view_is_made_once_after_its_needs(spark, tmp_path):
    made = []

    def base():
        made.append("base")
        return spark.range(5).select("id", (F.col("id") / 2).alias("half"), F.lit("a, \"b\"").alias("t"))

    views = {
        "base": View(base),
        "one": copied("base"),
        "two": reshaped("base", lambda d: d.filter("half > 1")),
        "both": View(lambda a, b: a.join(b, "id", "left_anti"), ("one", "two")),
        "words": static(spark, "a string, b int", [("x", 1), (None, 2)]),
        "unused": View(lambda: 1 / 0),
    }
    out = written(spark, views, ["both", "words", "two"], f"{tmp_path}/r")
    assert made == ["base"] and set(out) == {"base", "one", "two", "both", "words"}
    assert [tuple(r) for r in out["both"].orderBy("id").collect()] == [(0, 0.0, 'a, "b"'), (1, 0.5, 'a, "b"'), (2, 1.0, 'a, "b"')]
    assert out["both"].schema["half"].dataType.simpleString() == "double" and out["words"].filter("a is null").count() == 1
    again = written(spark, views, ["two"], f"{tmp_path}/p", "parquet")
    assert again["two"].count() == 2 and set(again) == {"base", "two"}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        written(spark, views, ["two"], f"{tmp_path}/p", "parquet")


def test_shuffled_parts_are_not_joined_into_large_tasks(spark, tmp_path):
    """Tasks of a written table read about a megabyte each, however few cores there are; the setting goes back afterwards."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, parts = spark.conf.get(name, None), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        wide = View(lambda: spark.range(1_000_000).groupBy(F.xxhash64("id").alias("x")).agg(F.count("id").alias("n")).select("x", "n", F.spark_partition_id().alias("p")))
        out = written(spark, {"wide": wide}, ["wide"], f"{tmp_path}/w")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert spark.conf.get(name, None) == before
    assert out["wide"].count() == 1_000_000 and out["wide"].agg(F.count_distinct("p")).first()[0] > spark.sparkContext.defaultParallelism


def test_circles_and_gaps_are_errors(spark, tmp_path):
    with pytest.raises(CycleError):
        written(spark, {"a": copied("b"), "b": copied("a")}, ["a"], str(tmp_path))
    with pytest.raises(KeyError):
        written(spark, {"a": copied("b")}, ["a"], str(tmp_path))
