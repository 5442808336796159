"""Sources, sinks and the slot stream."""

import pytest
from pyspark.sql import functions as F

from gridloom.plans import config
from gridloom.sources import ingest
from gridloom.streaming.slots import slot_sums


def test_wide_panel(spark, tmp_path):
    (tmp_path / "w.csv").write_text("GMT,N0001,N0002\n2013-01-01 00:00:00,1.5,x\n2013-01-01 00:30:00,,NaN\n")
    got = ingest.wide_panel(spark, str(tmp_path / "w.csv")).orderBy("ts", "entity").collect()
    assert [r["value"] for r in got] == [1.5, None, None, None]
    assert ingest.wide_panel(spark, str(tmp_path / "w.csv"), columns=["N0001"]).count() == 2


def test_meter_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1000 19503 0.14\n1000 19549 0.2\n")
    (tmp_path / "b.txt").write_text("1001  00148   1.0\n")
    standard, other = ingest.meter_text(spark, str(tmp_path))
    assert sorted((r["meter_id"], r["day"], r["slot"]) for r in standard.collect()) == [(1000, 195, 3), (1001, 1, 48)]
    assert str(other.first()["local_date"]) == "2009-07-14"


def test_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿id,a\n1,é\n".encode())
    (tmp_path / "c.csv").write_bytes("id,a\n1,é\n".encode("cp1252"))
    for name in ("u.csv", "c.csv"):
        got = ingest.text_csv(spark, str(tmp_path / name))
        assert got.columns == ["id", "a"] and got.first()["a"] == "é"


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("k", F.col("id") % 2)
    ingest.write_partitioned(df, str(tmp_path / "p"), "k")
    assert ingest.row_block(spark.read.parquet(str(tmp_path / "p")), "id", 3, 5).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        ingest.write_partitioned(df, str(tmp_path / "p"), "k")
    found = ingest.inventory(spark, str(tmp_path / "p")).collect()
    assert found and all(len(r["sha256"]) == 64 and r["bytes"] > 0 for r in found)
    assert {r["file"].split("/")[0] for r in found} == {"k=0", "k=1"}
    one, two = (sorted(ingest.shuffled_batches(x, 1, 1, "id", size=2, groups=3).collect()) for x in (df, df.repartition(3)))
    assert one == two and {r["place"] for r in one} <= {0, 1} and sorted(ingest.shuffled_batches(df, 1, 2, "id", size=2, groups=3).collect()) != one


def test_fixed_schemas_and_reports(spark, tmp_path):
    rows = spark.sql("SELECT 'e1' AS entity, TIMESTAMP'2024-01-01' AS target_ts, TIMESTAMP'2024-01-01' AS origin_ts, 1L AS lead, 'full' AS strategy, 1 AS seed, 1.5D AS actual, 1D AS predicted, 1D AS persistence, 2D AS daily, 'x' AS more")
    ingest.write_predictions(rows, str(tmp_path / "predictions"))
    back = spark.read.parquet(str(tmp_path / "predictions"))
    assert "more" not in back.columns and dict(back.dtypes)["actual"] == "float"
    assert ingest.conforms(back, "entity string, actual float", 1)[0].endswith("not expected") and ingest.conforms(spark.range(3), "id bigint", 3) == []
    assert ingest.conforms(spark.range(3), "id int, b string", 2) == ["id: bigint in place of int", "b: missing in place of string", "3 rows in place of 2"]
    for kind in ("csv", "json", "parquet"):
        places = ingest.write_report({"one": spark.range(2), "two": spark.range(3)}, str(tmp_path / kind), kind)
        assert [p.rsplit("/", 1)[1] for p in places] == ["one", "two"]
        with pytest.raises(Exception, match="(?i)exists"):
            ingest.write_report({"one": spark.range(2)}, str(tmp_path / kind), kind)
        path = ingest.one_file(spark, f"file://{tmp_path}/{kind}/two", f"part-*.{kind}")
        assert ingest.table_of(spark, path).count() == 3
    with pytest.raises(FileNotFoundError):
        ingest.one_file(spark, str(tmp_path), "part-*")
    with pytest.raises(ValueError):
        ingest.table_of(spark, "a.txt")


def test_report_tables_of_any_size(spark, tmp_path):
    """Writing a table leaves the tasks that make it as many as they were; a small table is one file, a large one several."""
    from pyspark import TaskContext

    def who(batches):
        for pdf in batches:
            yield pdf.assign(part=TaskContext.get().partitionId())

    df = spark.range(0, 4000, 1, 4).mapInPandas(who, "id long, part int")
    ingest.write_table(df, str(tmp_path / "small"), "parquet")
    assert spark.read.parquet(str(tmp_path / "small")).select("part").distinct().count() == 4
    assert len(list((tmp_path / "small").glob("part-*"))) == 1
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        ingest.write_table(spark.range(0, 400_000, 1, 4).select("id", F.xxhash64("id").alias("h")), str(tmp_path / "large"), "csv")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "large").glob("part-*"))) > 4 and ingest.text_csv(spark, str(tmp_path / "large")).count() == 400_000


def test_specs(spark):
    spec = config.load('{"bands": [{"min": 0, "max": 2, "label": "low"}, {"min": 3, "max": 9, "label": "high"}], "gates": [{"name": "large", "column": "id", "operator": ">=", "value": 2}], "routes": [{"parent": "q1", "operator": "in", "value": ["a"], "targets": ["q2"]}], "comparisons": [{"id": "x", "focal": "full", "comparator": "direct"}]}')
    got = spark.range(4).select(config.banded("id", spec["bands"]).alias("b"), config.gates(spec["gates"])["large"].alias("g")).collect()
    assert [tuple(r) for r in got] == [("low", False), ("low", False), ("low", True), ("high", True)]
    assert config.routes(spec["routes"])[0].targets == ("q2",) and config.comparisons(spec["comparisons"]) == [("x", "full", "direct")]
    assert config.differences({"a": {"x": {"y": 1}}, "b": {"x": {"y": 2}}}, ["x.y"])[0][0] == "x.y" and len(config.fingerprint(spec)) == 64


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-01 00:10:00', 1.0D), (1, TIMESTAMP_NTZ'2024-01-01 00:20:00', 2.0D), (1, TIMESTAMP_NTZ'2024-01-01 05:00:00', 4.0D) t(entity, ts, value)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = slot_sums(stream, "entity", "ts", "value").writeStream.outputMode("append").format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM slots").collect()
    assert [(r["entity"], r["value"], r["readings"]) for r in got] == [(1, 3.0, 2)]
