"""Queries that go through sources and sinks, and audits of results, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import metrics as M
from gridloom.plans import config
from gridloom.plans.panel_queries import DAYS, ENTITY_SQL, FACTS_SQL, LOOKBACK, TYPE_SQL, USER_SQL, entity_metrics, facts, pooled_metrics, type_grid, user_grid
from gridloom.plans.registry import Registry, r, rounded
from gridloom.sources import commits, ingest, rowgroups, workbooks
from gridloom.sources.scratch import scratch
from gridloom.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("wide_csv_scan", f"WITH {TYPE_SQL} SELECT strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(slot * 2 AS INT)), '%Y-%m-%d %H:%M') AS at, entity, round(value, 2) AS value FROM g")
def wide_csv_scan(spark, sf):
    """A wide text panel, a column for each entity, written and scanned."""
    g = type_grid(spark, sf).withColumn("GMT", F.timestamp_add("HOUR", F.col("slot") * 2, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    names = sorted(x[0] for x in g.select("entity").distinct().collect())  # event types, a few
    path = scratch(spark, "wide")
    g.groupBy(F.date_format("GMT", "yyyy-MM-dd HH:mm:ss").alias("GMT")).pivot("entity", names).agg(F.first("value")).write.csv(path, header=True)
    return ingest.wide_panel(spark, path).select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "entity", r("value", 2).alias("value"))


METER = "l_partkey % 800 * 100 + l_linenumber * 11"


@query("meter_text_scan", f"SELECT CAST(l_suppkey AS INT) AS meter_id, CAST(({METER}) // 100 AS INT) AS day, CAST(({METER}) % 100 AS INT) AS slot, strftime(DATE '2009-01-01' + CAST(({METER}) // 100 AS INT) - 1, '%Y-%m-%d') AS date, ({METER}) % 100 <= 48 AS standard, count(*) AS readings, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1, 2, 3, 4, 5")
def meter_text_scan(spark, sf):
    """Headerless text of meter, code and value over several files."""
    path = scratch(spark, "meters")
    table(spark, sf, "lineitem").select(F.concat_ws("  ", F.col("l_suppkey").cast("string"), F.lpad(F.expr(f"cast({METER} as string)"), 5, "0"), F.col("l_quantity").cast("string"))).repartition(6).write.text(path)
    standard, other = ingest.meter_text(spark, path)
    both = standard.withColumn("local_date", S.date_of_day(F.col("day"))).withColumn("standard", F.lit(True)).unionByName(other.withColumn("standard", F.lit(False)))
    out = both.groupBy("meter_id", "day", "slot", F.date_format("local_date", "yyyy-MM-dd").alias("date"), "standard")
    return out.agg(F.count(F.lit(1)).alias("readings"), r(F.sum(F.col("value").cast("double")), 2).alias("total"))


@query("encoded_csv_scan", "SELECT e.encoding, CAST(n_nationkey AS VARCHAR) AS key, concat(n_name, ' né') AS name FROM nation CROSS JOIN (VALUES ('UTF-8'), ('ISO-8859-1')) e(encoding)")
def encoded_csv_scan(spark, sf):
    """The same table in two encodings, told apart on reading."""
    out = None
    for encoding in ("UTF-8", "ISO-8859-1"):
        path = scratch(spark, "encoded")
        table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.concat("n_name", F.lit(" né")).alias("name")).coalesce(1).write.csv(path, header=True, encoding=encoding)
        one = ingest.text_csv(spark, path).select(F.lit(encoding).alias("encoding"), "key", "name")
        out = one if out is None else out.union(one)
    return out


@query("file_inventory", "SELECT r_name AS name, CAST(octet_length(encode(concat(r_name, chr(10)))) AS BIGINT) AS bytes, sha256(concat(r_name, chr(10))) AS sha256 FROM region")
def file_inventory(spark, sf):
    """A file for each region, with its size and hash."""
    path = scratch(spark, "files")
    table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_name").alias("text")).write.partitionBy("name").text(path)
    return ingest.inventory(spark, path).select(F.url_decode(F.regexp_extract("file", "name=([^/]*)/", 1)).alias("name"), "bytes", "sha256")


@query("row_block", "SELECT event_id, user_id FROM events WHERE event_id BETWEEN 100 AND 399")
def row_block(spark, sf):
    return ingest.row_block(table(spark, sf, "events").select("event_id", "user_id"), "event_id", 100, 399)


@query("single_file", "SELECT r_regionkey, r_name FROM region")
def single_file(spark, sf):
    """The one file of a name below a folder, read by its kind."""
    return ingest.table_of(spark, ingest.one_file(spark, sf, "region.parquet")).select("r_regionkey", "r_name")


@query("schema_check", "SELECT * FROM (VALUES ('nation', 'n_nationkey: int in place of bigint'), ('nation', 'n_regionkey: not expected'), ('nation', '25 rows in place of 24'), ('region', 'none')) t(name, departure)")
def schema_check(spark, sf):
    """Columns and numbers of rows against what is expected."""
    expected = {"region": ("r_regionkey int, r_name string", 5), "nation": ("n_nationkey bigint, n_name string", 24)}
    rows = [(n, d) for n, (schema, k) in expected.items() for d in ingest.conforms(table(spark, sf, n), schema, k) or ["none"]]
    return spark.createDataFrame(rows, "name string, departure string")


@query("batches", "SELECT count(*) AS samples, count(DISTINCT event_id) AS distinct_samples, 128 AS largest, 0 AS gaps FROM events")
def batches(spark, sf):
    """Shuffled batches hold every sample once; all but the last of a part are full."""
    b = ingest.shuffled_batches(table(spark, sf, "events").select("event_id"), 7, 3, "event_id", size=128, groups=4)
    per = b.groupBy("part", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"))
    holes = per.agg(F.max("n").cast("int").alias("largest"), F.count_if(F.col("last") != F.col("n") - 1).cast("int").alias("gaps"))
    return b.agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("event_id").alias("distinct_samples")).crossJoin(F.broadcast(holes))


@query("prediction_sink", FACTS_SQL + "SELECT CAST(entity AS VARCHAR) AS entity, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(slot AS INT)), '%Y-%m-%d') AS target, CAST(lead AS INT) AS lead, strategy, CAST(seed AS INT) AS seed, round(CAST(CAST(actual AS FLOAT) AS DOUBLE), 2) AS actual, round(CAST(CAST(predicted AS FLOAT) AS DOUBLE), 2) AS predicted FROM f")
def prediction_sink(spark, sf):
    """Predictions written in their fixed schema and read again."""
    path = scratch(spark, "predictions")
    at = F.lit("2024-01-01").cast("date")
    f = facts(spark, sf).select("entity", F.date_add(at, F.col("slot")).alias("target_ts"), F.date_add(at, F.col("slot") - F.col("lead")).alias("origin_ts"), "lead", "strategy", "seed", "actual", "predicted", F.col("naive").alias("persistence"), F.col("naive").alias("daily"))
    ingest.write_predictions(f, path)
    back = spark.read.parquet(path)
    return back.select("entity", F.date_format("target_ts", "yyyy-MM-dd").alias("target"), F.col("lead").cast("int").alias("lead"), "strategy", "seed", *(F.round(F.col(c).cast("double"), 2).alias(c) for c in ("actual", "predicted")))


@query("report_tables", FACTS_SQL + "SELECT 'pooled' AS report, count(*) AS rows FROM (SELECT DISTINCT strategy, seed, lead FROM f) UNION ALL SELECT 'entities', count(*) FROM (SELECT DISTINCT entity, lead, strategy, seed FROM f) UNION ALL SELECT 'regions', count(*) FROM region")
def report_tables(spark, sf):
    """Named results written as CSV reports, and the rows found in each."""
    named = {"pooled": pooled_metrics(spark, sf), "entities": rounded(entity_metrics(spark, sf)), "regions": table(spark, sf, "region")}
    out = None
    for name, path in zip(named, ingest.write_report(named, scratch(spark, "report"))):
        one = ingest.text_csv(spark, path).agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.union(one)
    return out


BALANCES = "SELECT n_name AS nation, count(*) AS customers, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"


def _book(spark, sf) -> tuple[str, list[str]]:
    """A workbook of two sheets: balances of customers by nation, and the regions. Its path, and the nations in order."""
    found = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    found = found.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("customers"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents")).orderBy("nation")
    balances = [tuple(r) for r in found.collect()]  # a row for each nation
    regions = [(r["r_name"], r["r_regionkey"]) for r in table(spark, sf, "region").collect()]
    path = f"{scratch(spark, 'book')}.xlsx"
    workbooks.write_workbook(path, {"balances": (found.columns, balances), "regions": (["name", "key"], regions)})
    return path, [n for n, *_ in balances]


@query("workbook_scan", f"WITH b AS ({BALANCES}) SELECT 'balances' AS sheet, nation AS name, CAST(customers AS VARCHAR) AS value FROM b WHERE nation < 'NATION_2' UNION ALL SELECT 'regions', r_name, CAST(r_regionkey AS VARCHAR) FROM region")
def workbook_scan(spark, sf):
    """A range of cells of a workbook's first sheet, and its second sheet as a whole."""
    path, nations = _book(spark, sf)
    one = workbooks.workbook(spark, path, "balances", f"A1:B{sum(n < 'NATION_2' for n in nations) + 1}", rows=7).select(F.lit("balances").alias("sheet"), F.col("nation").alias("name"), F.col("customers").alias("value"))
    return one.union(workbooks.workbook(spark, path, "regions").select(F.lit("regions"), "name", "key"))


@query("workbook_sheets", f"WITH b AS ({BALANCES}) SELECT 0 AS place, 'balances' AS sheet, concat('A1:C', count(*) + 1) AS cells, count(*) + 1 AS rows, 3 * (count(*) + 1) AS filled FROM b UNION ALL SELECT 1, 'regions', concat('A1:B', count(*) + 1), count(*) + 1, 2 * (count(*) + 1) FROM region")
def workbook_sheets(spark, sf):
    """The inventory of a workbook's sheets."""
    return workbooks.sheets(spark, _book(spark, sf)[0])


@query("row_group_batches", "SELECT event_type, count(*) AS samples, count(DISTINCT event_id) AS distinct_samples, 0 AS gaps, true AS same_again, true AS other_epoch_differs FROM events GROUP BY 1")
def row_group_batches(spark, sf):
    """Samples of each split in batches from shuffled row groups: each sample once, batches without gaps, the same for an epoch and others for the next one."""
    out = None
    path = scratch(spark, "events")
    table(spark, sf, "events").select("event_id", "event_type").repartition(4, "event_id").write.option("parquet.block.row.count.limit", 500).parquet(path)
    for split in sorted(r[0] for r in table(spark, sf, "events").select("event_type").distinct().collect()):
        one, again, other = (rowgroups.batches(spark, path, 7, epoch, 128, ["event_id"], ("event_type", split)) for epoch in (1, 1, 2))
        sign = lambda df: df.agg(F.sum(F.xxhash64("event_id", "part", "batch", "place").cast("decimal(20,0)")).alias("s"))
        gaps = one.groupBy("part", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last")).agg(F.count_if(F.col("n") != F.col("last") + 1).cast("int").alias("gaps"))
        counts = one.agg(F.lit(split).alias("event_type"), F.count(F.lit(1)).alias("samples"), F.count_distinct("event_id").alias("distinct_samples"))
        a, b, c = (sign(x).withColumnRenamed("s", n) for x, n in ((one, "a"), (again, "b"), (other, "c")))
        row = counts.crossJoin(F.broadcast(gaps)).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
        row = row.select("event_type", "samples", "distinct_samples", "gaps", (F.col("a") == F.col("b")).alias("same_again"), (F.col("a") != F.col("c")).alias("other_epoch_differs"))
        out = row if out is None else out.union(row)
    return out


@query("committed_tables", " UNION ALL ".join(f"SELECT '{kind}' AS kind, event_type, count(*) AS rows, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL" for kind in ("parquet", "csv", "json")))
def committed_tables(spark, sf):
    """A table written in each kind by the sink with one commit, and read again by Spark."""
    df = table(spark, sf, "events").select("event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    out = None
    for kind in ("parquet", "csv", "json"):
        path = scratch(spark, "committed")
        commits.write(df, path, kind, rows=1000)
        read = spark.read.schema("event_id long, event_type string, cents long")
        back = {"parquet": lambda: read.parquet(path), "csv": lambda: read.csv(path, header=True), "json": lambda: read.json(path)}[kind]()
        one = back.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("cents").alias("cents")).select(F.lit(kind).alias("kind"), "event_type", "rows", "cents")
        out = one if out is None else out.union(one)
    return out


SETTINGS = {"window.slots": "count(DISTINCT date_trunc('hour', ts))", "window.first": "strftime(min(ts), '%Y-%m-%d')", "scale.floor": "'0.01'", "scale.kind": "'z'", "rows": "count(*)"}


@query("config_audit", "WITH c AS (SELECT event_type AS config, " + ", ".join(f'CAST({v} AS VARCHAR) AS "{k}"' for k, v in SETTINGS.items()) + " FROM events GROUP BY 1), l AS (" + " UNION ALL ".join(f"""SELECT '{k}' AS path, config, "{k}" AS value FROM c""" for k in SETTINGS) + " UNION ALL SELECT 'scale.offset', config, NULL FROM c), s AS (SELECT path, count(DISTINCT value) AS n, count(value) AS k, count(*) AS m FROM l GROUP BY 1) SELECT path, config, value FROM l JOIN s USING (path) WHERE n > 1 OR (k > 0 AND k < m) OR k = 0")
def config_audit(spark, sf):
    """Settings stored for each run, a nested JSON document each, that should be the same in all runs and aren't, or that a run lacks."""
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("config")).agg(F.count_distinct(F.date_trunc("hour", "ts")).alias("slots"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first"), F.count(F.lit(1)).alias("rows"))
    path = scratch(spark, "configs")
    e.select("config", F.struct(F.struct("slots", "first").alias("window"), F.struct(F.lit("0.01").alias("floor"), F.lit("z").alias("kind")).alias("scale"), "rows").alias("settings")).write.json(path)
    stored = spark.read.schema("config string, settings string").json(path)
    return config.departures(stored, "config", "settings", [*SETTINGS, "scale.offset"])


# ---- audits -----------------------------------------------------------------------------------


@query("strategy_support_equality", FACTS_SQL + "SELECT x.strategy AS a, y.strategy AS b, count(*) AS rows, count_if(x.entity IS NULL OR y.entity IS NULL) AS unmatched, count_if(abs(x.actual - y.actual) > 1e-8 + 1e-5 * abs(y.actual)) AS unequal FROM f x JOIN f y ON x.entity = y.entity AND x.slot = y.slot AND x.lead = y.lead AND x.seed = y.seed AND x.strategy < y.strategy GROUP BY 1, 2")
def strategy_support_equality(spark, sf):
    """For each two strategies, whether they have the same keys and, nearly, the same actual values."""
    return M.support_equality(facts(spark, sf), "strategy", "entity", "slot", "lead", "seed")


@query("support_differences", FACTS_SQL + ", k AS (SELECT DISTINCT entity, slot, lead FROM f) SELECT x.lead AS a, y.lead AS b, CAST(sum(CAST(NOT EXISTS (SELECT 1 FROM k z WHERE z.entity = x.entity AND z.slot = x.slot AND z.lead = y.lead) AS INT)) AS BIGINT) AS only_a FROM k x CROSS JOIN (SELECT DISTINCT lead FROM k) y WHERE x.lead <> y.lead GROUP BY 1, 2")
def support_differences(spark, sf):
    """Keys that one lead has and another lacks."""
    has = facts(spark, sf).groupBy("entity", "slot").agg(F.collect_set("lead").alias("leads"))
    leads = [1, 2]
    each = has.agg(*(F.count_if(F.array_contains("leads", a) & ~F.array_contains("leads", b)).alias(f"{a}_{b}") for a in leads for b in leads if a != b))
    return each.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("only_a")) for a in leads for b in leads if a != b))).alias("x")).select("x.*")


@query("stored_vs_recomputed", ENTITY_SQL + " SELECT strategy, count(*) AS entities, 0 AS differing FROM m GROUP BY 1")
def stored_vs_recomputed(spark, sf):
    """Stored metrics of entities against the same from their rows."""
    path = scratch(spark, "stored")
    entity_metrics(spark, sf).select("entity", "lead", "strategy", "seed", F.col("mae").alias("stored")).write.parquet(path)
    now = M.with_errors(facts(spark, sf)).groupBy("entity", "lead", "strategy", "seed").agg(F.avg("absolute_error").alias("mae"))
    both = now.join(spark.read.parquet(path), ["entity", "lead", "strategy", "seed"], "full")
    return both.groupBy("strategy").agg(F.count(F.lit(1)).alias("entities"), F.count_if(~F.coalesce(F.abs(F.col("mae") - F.col("stored")) <= 1e-9, F.lit(False))).cast("int").alias("differing"))


@query("relative_gain_variants", ENTITY_SQL + ", w AS (SELECT entity, lead, seed, max(CASE WHEN strategy = 'direct' THEN mae END) AS d, max(CASE WHEN strategy = 'full' THEN mae END) AS f FROM m GROUP BY 1, 2, 3) SELECT entity, lead, seed, round(CASE WHEN abs(d) > 1e-12 THEN 100 * (d - f) / d END, 4) AS near_zero, round(CASE WHEN d > 0 THEN 100 * (d - f) / d END, 4) AS positive, round(100 * (d - f) / greatest(d, 1.0), 4) AS floored FROM w")
def relative_gain_variants(spark, sf):
    """Relative gains with denominators that are not near zero, that are positive, and that are kept above a floor."""
    w = M.by_strategy(entity_metrics(spark, sf), "mae", ["direct", "full"], "entity", "lead", "seed")
    gain, base = F.col("direct") - F.col("full"), F.col("direct")
    return w.select("entity", "lead", "seed", r(S.safe_ratio(gain, base, scale=100.0), 4).alias("near_zero"), r(S.positive_ratio(gain, base, scale=100.0), 4).alias("positive"), r(S.floored_ratio(gain, base, 1.0, scale=100.0), 4).alias("floored"))


@query("fit_eligibility", f"WITH {USER_SQL}, u AS (SELECT entity, slot % 7 AS s, avg(value) AS v FROM g GROUP BY 1, 2 HAVING avg(value) IS NOT NULL) SELECT entity, round(stddev_pop(v), 6) AS profile_std, stddev_pop(v) >= 0.01 AND count(*) = 7 AS fit_eligible FROM u GROUP BY 1")
def fit_eligibility(spark, sf):
    """Whether an entity's profile is whole and varies enough to be clustered."""
    p = user_grid(spark, sf).groupBy("entity", (F.col("slot") % 7).alias("s")).agg(F.avg("value").alias("v")).filter("v is not null")
    return rounded(p.groupBy("entity").agg(F.stddev_pop("v").alias("profile_std"), ((F.stddev_pop("v") >= 0.01) & (F.count(F.lit(1)) == 7)).alias("fit_eligible")))


#: Made-up paths: below the project, elsewhere, in the home folder, relative, and none.
PLACE = "CASE c_custkey % 5 WHEN 0 THEN concat('/srv/study/out//', c_name, '.csv') WHEN 1 THEN concat('/opt/tools/', c_name, '/') WHEN 2 THEN concat('/home/one/./', c_name) WHEN 3 THEN concat('./out/', c_name) END"


@query(
    "public_names",
    f"SELECT c_custkey AS key, CASE c_custkey % 5 WHEN 0 THEN concat('out/', c_name, '.csv') WHEN 3 THEN concat('out/', c_name) WHEN 4 THEN NULL ELSE c_name END AS path, replace(replace('read ' || ({PLACE}), '/srv/study', '$PROJECT'), '/home/one', '$HOME') AS note FROM customer",
)
def public_names(spark, sf):
    """Paths and notes without the machine's own prefixes."""
    place = F.expr(PLACE)
    note = S.public_text(F.concat(F.lit("read "), place), {"/srv/study": "$PROJECT", "/home/one": "$HOME"})
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), S.public_path(place, "/srv/study/").alias("path"), note.alias("note"))
