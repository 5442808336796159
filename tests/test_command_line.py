"""The command line, and names without private prefixes."""

import pytest
from pyspark.sql import functions as F

from gridloom.__main__ import main
from gridloom.functions import scalars as S
from tests.conftest import SF


def test_list(capsys):
    assert main(["list"]) == 0
    names = capsys.readouterr().out.split("\n")
    assert "household_metrics" in names and any(n.endswith("(no SQL)") for n in names)


def test_run(spark, tmp_path, capsys):
    out = str(tmp_path / "out")
    head = ["run", "public_names", "--input", SF]
    assert main([*head, "--check-only"], spark) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["key bigint", "path string"]
    main([*head, "--output", out], spark)
    n = spark.read.parquet(out).count()
    assert n == spark.read.parquet(f"{SF}/customer.parquet").count()
    with pytest.raises(Exception, match="(?i)exists"):
        main([*head, "--output", out], spark)
    main([*head, "--output", out, "--overwrite", "--format", "csv"], spark)
    assert spark.read.csv(out, header=True).count() == n


def test_bad_arguments():
    for argv in ([], ["run", "no_such_query", "--input", SF, "--output", "x"], ["run", "public_names", "--input", SF]):
        with pytest.raises(SystemExit):
            main(argv)


def test_public_path(spark):
    cases = {"/srv/p/a/b.csv": "a/b.csv", "/srv/p": ".", "/srv/p/": ".", "/srv/pq/x": "x", "/srv//p/./a": "a", "/opt/x/": "x", "~/x/y": "y", "a//b": "a/b", "./a/.": "a", "": ".", "/": "", None: None}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", S.public_path(F.col("p"), "/srv/p/").alias("q"))
    assert {r["p"]: r["q"] for r in got.collect()} == cases


def test_public_text(spark):
    got = spark.createDataFrame([("at /srv/p/x and /home/u.v/y, /srv/p",), (None,)], "t string").select(S.public_text(F.col("t"), {"/srv/p": "<top>", "": "?", "/home/u.v": "<home>"}).alias("t"))
    assert [r["t"] for r in got.collect()] == ["at <top>/x and <home>/y, <top>", None]
