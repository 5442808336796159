"""Python data sources: workbooks, row groups, and the sink with one commit."""

import glob
import os
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.sources import commits, rowgroups, workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, sheets, strings="<si><t>id</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si><si><t>é &lt;x&gt;</t></si>"):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{strings}</sst>")
    return str(path)


BODY = (
    '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>name</t></is></c><c r="E2" t="inlineStr"><is><t>ID</t></is></c></row>'
    '<row r="3"><c r="B3"><v>1.5</v></c><c r="C3" t="s"><v>1</v></c></row>'
    '<row r="5"><c r="B5" t="b"><v>1</v></c><c r="C5" t="str"><v>formula</v></c><c r="E5" t="s"><v>2</v></c></row>'
    '<row r="6"><c r="Z6"><v>9</v></c></row>'
)


def test_workbook(spark, tmp_path):
    path = book(tmp_path / "a.xlsx", {"data": BODY, "empty": ""})
    df = workbooks.workbook(spark, path, cells="B2:E6")
    assert df.columns == ["id", "name", "D", "ID_E"]
    assert [tuple(r) for r in df.collect()] == [("1.5", "two runs", None, None), ("TRUE", "formula", None, "é <x>")]
    for rows in (1, 2, 100):
        assert workbooks.workbook(spark, path, "data", "B2:E6", rows=rows).collect() == df.collect()
    bare = workbooks.workbook(spark, path, "data", "C3:C5", header=False)
    assert bare.columns == ["C"] and [r[0] for r in bare.collect()] == ["two runs", "formula"]
    whole = workbooks.workbook(spark, path)
    assert len(whole.columns) == 26 and whole.count() == 3
    assert workbooks.workbook(spark, path, "empty").count() == 0
    found = [tuple(r) for r in workbooks.sheets(spark, path).orderBy("place").collect()]
    assert found == [(0, "data", "B2:Z6", 4, 9), (1, "empty", None, 0, 0)]


def test_workbook_errors(spark, tmp_path):
    path = book(tmp_path / "b.xlsx", {"one": BODY, "two": BODY})
    with pytest.raises(Exception, match="expected one sheet"):
        workbooks.workbook(spark, path).count()
    with pytest.raises(Exception, match="no sheet"):
        workbooks.workbook(spark, path, "three").count()
    with pytest.raises(ValueError):
        workbooks.cell_range("1A")
    assert workbooks.cell_range("B:D") == (2, None or 1, 4, None) and workbooks.cell_range("aa7") == (27, 7, 27, 7) and workbooks.cell_range(None) == (1, 1, None, None)
    assert [workbooks.column_letters(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_workbook_round_trip(spark, tmp_path):
    rows = [(i, f"name {i} & <b>", None if i % 3 else i / 2) for i in range(500)]
    path = str(tmp_path / "c.xlsx")
    workbooks.write_workbook(path, {"a": (["k", "t", "v"], rows)})
    df = workbooks.workbook(spark, path, rows=64)
    assert df.rdd.getNumPartitions() == 8
    assert [tuple(r) for r in df.orderBy(F.col("k").cast("int")).collect()] == [(str(k), t, None if v is None else str(v)) for k, t, v in rows]


def test_row_groups(spark, tmp_path):
    rng = np.random.default_rng(0)
    for f in range(3):
        t = pa.table({"i": np.arange(f * 1000, f * 1000 + 1000), "split": np.where(rng.random(1000) < 0.7, "train", "test"), "v": rng.random(1000)})
        pq.write_table(t, tmp_path / f"{f}.parquet", row_group_size=130)
    df = rowgroups.batches(spark, str(tmp_path), 5, 1, 50, ["i"])
    assert df.columns == ["i", "part", "batch", "place"] and df.rdd.getNumPartitions() == 24
    one = df.toPandas()
    assert sorted(one["i"]) == list(range(3000)) and one.groupby(["part", "batch"]).size().max() == 50
    assert all((g["place"].to_numpy() == np.arange(len(g))).all() for _, g in one.groupby(["part", "batch"]))
    order = lambda p: p.sort_values(["part", "batch", "place"])["i"].tolist()
    again, two, seed = (rowgroups.batches(spark, str(tmp_path), s, e, 50, ["i"]).toPandas() for s, e in ((5, 1), (5, 2), (6, 1)))
    assert order(one) == order(again) != order(two) and order(one) != order(seed) and order(one) != list(range(3000))
    # A part is one row group, and not the group of its own number.
    assert all(g["i"].max() - g["i"].min() < 130 for _, g in one.groupby("part"))
    train = rowgroups.batches(spark, str(tmp_path), 5, 1, 50, ["i", "v"], ("split", "train")).toPandas()
    want = pq.read_table(tmp_path).to_pandas()
    assert sorted(train["i"]) == sorted(want[want["split"] == "train"]["i"])
    assert set(rowgroups.batches(spark, f"{tmp_path}/1.parquet", 1, 1).columns) == {"i", "split", "v", "part", "batch", "place"}


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_committed_files(spark, tmp_path, kind):
    path = f"{tmp_path}/out/{kind}"
    df = spark.range(1000).select("id", F.concat(F.lit('é "q", '), F.col("id")).alias("t"), F.when(F.col("id") % 2 == 0, F.col("id") / 4).alias("v")).repartition(3)
    commits.write(df, path, kind, rows=100)
    read = spark.read.schema("id long, t string, v double")
    back = {"parquet": read.parquet, "csv": lambda p: read.csv(p, header=True, escape='"'), "json": read.json}[kind](path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert len(glob.glob(f"{path}/*")) == 3 and os.listdir(f"{tmp_path}/out") == [kind]
    if kind == "parquet":
        assert max(pq.ParquetFile(f).metadata.row_group(0).num_rows for f in glob.glob(f"{path}/*")) == 100
    with pytest.raises(Exception, match="there already"):
        commits.write(df, path, kind)
    commits.write(df.limit(0), f"{path}-none", kind)
    assert os.path.isdir(f"{path}-none") and not glob.glob(f"{path}-none/*")


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    fails = F.udf(lambda i: 1 // (700 - i), "long")
    path = f"{tmp_path}/out"
    with pytest.raises(Exception, match="ZeroDivisionError"):
        commits.write(spark.range(0, 1000, 1, 4).select("id", fails("id").alias("x")), path, rows=10)
    assert not os.listdir(tmp_path)
    commits.write(spark.range(10), path)
    assert spark.read.parquet(path).count() == 10
