"""Report tables as a graph of named views: each is made from others or from a query, and written once."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import ingest


@dataclass(frozen=True)
class View:
    """make gets the views that are needed, by name, as they were written."""

    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()


def static(spark: SparkSession, columns: str, rows: list[tuple]) -> View:
    return View(lambda: spark.createDataFrame(rows, columns).coalesce(1))


def copied(name: str) -> View:
    return View(lambda one: one, (name,))


def reshaped(name: str, change: Callable[[DataFrame], DataFrame]) -> View:
    return View(change, (name,))


#: Bytes that a task reads from a shuffle while tables are written: dense grids and leads make some 50 times as much of them.
SHARE = "1m"


@contextlib.contextmanager
def _small_shares(spark: SparkSession):
    """Keeps Spark from joining shuffled parts into as few tasks as there are cores, whose memory would grow with the input."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    spark.conf.set(name, SHARE)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def written(spark: SparkSession, views: Mapping[str, View], wanted: list[str], folder: str, kind: str = "csv") -> dict[str, DataFrame]:
    """The wanted views and all that they need, each written below folder after those that it needs, and read again in its own types. Needs that go in a circle, or that there are not, are errors."""
    graph: dict[str, tuple[str, ...]] = {}
    ahead = list(wanted)
    while ahead:
        name = ahead.pop()
        if name not in graph:
            if name not in views:
                raise KeyError(f"no view {name}")
            graph[name] = views[name].needs
            ahead += graph[name]
    out: dict[str, DataFrame] = {}
    for name in TopologicalSorter(graph).static_order():
        df = views[name].make(*(out[n] for n in graph[name]))
        with _small_shares(spark):
            ingest.write_table(df, f"{folder}/{name}", kind)
        read = spark.read.schema(df.schema)
        out[name] = read.csv(f"{folder}/{name}", header=True) if kind == "csv" else getattr(read, kind)(f"{folder}/{name}")
    return out


#: Report tables by the query that each is a copy of.
COPIES = {
    "Table_A_1": "coverage_by_period", "Table_B_1": "eligibility_flow", "Table_B_2": "useful_transitions", "Table_D_4": "sample_counts_rollup", "Table_D_5": "support_patterns",
    "Table_4_1": "seed_summary", "Table_F_1": "group_gain_summary", "Table_F_3": "one_way_effect", "Table_F_4": "pairwise_hedges", "Table_F_5": "risk_difference_fisher", "Table_F_7": "gain_distribution", "Table_F_8": "lead_shift",
    "Table_I_1": "conditional_gain", "Table_I_2": "composition_decomposition", "Table_J_1": "composition_decomposition", "Table_J_2": "conditional_gain",
    "Table_K_1": "drift_features", "Table_L_1": "drift_quartiles", "Table_M_1": "availability_by_group", "Table_M_2": "sample_availability", "Table_M_3": "contingency_table", "Table_M_5": "contingency_table", "Table_M_4": "contingency_cramers_v", "Table_M_6": "kruskal_h",
}

#: The strategies as the report describes them.
STRATEGY_ROWS = [("source", "source", "none"), ("direct", "source", "test"), ("tuned", "dense head", "short span"), ("limited", "all", "short span"), ("full", "all", "whole span")]


def report_views(spark: SparkSession, sf: str, queries: Mapping[str, Callable]) -> dict[str, View]:
    """The report's tables over the registered queries: static ones, copies, and those that are made from other tables."""
    views = {q: View(lambda q=q: queries[q](spark, sf)) for q in set(COPIES.values())}
    views |= {t: copied(q) for t, q in COPIES.items()}
    views["Table_3_3"] = static(spark, "strategy string, trained string, target_data string", STRATEGY_ROWS)
    views["Table_F_2"] = reshaped("Table_F_1", lambda d: d.select("*", (F.col("positive_share") > 0.5).alias("mostly_positive")) if "positive_share" in d.columns else d)
    views["contents"] = View(lambda *tables: _contents(spark, sorted([*COPIES, "Table_3_3", "Table_F_2"]), tables), tuple(sorted([*COPIES, "Table_3_3", "Table_F_2"])))
    return views


def _contents(spark: SparkSession, names: list[str], tables: tuple[DataFrame, ...]) -> DataFrame:
    out = None
    for name, t in zip(names, tables):
        one = t.agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.union(one)
    return out
