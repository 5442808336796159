"""Resampling as relations: permutation tests, bootstrap intervals, repeated folds.

A replicate is a set of rows like any other, so that replicates spread over all tasks and no study
is gathered in one. Random numbers come from draw(), a hash of replicate and entity in 31-bit
arithmetic that every SQL engine computes alike; the same seed gives the same result anywhere.
Entities are whole numbers. Statistics are compared after rounding to TELL digits, so that the order
in which sums are taken can't tell two equal ones apart.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import safe_ratio
from gridloom.sources.scratch import scratch

PRIME, TELL = 2147483647, 12
#: Entities of a block, and replicates that are drawn together.
BLOCK, CHUNK = 4096, 250


def draw(entity: str, replicate: str, seed: int = 0) -> str:
    """SQL of a random number from 0 to PRIME - 1 for an entity in a replicate (both SQL of whole numbers below 2^31)."""
    mod = lambda x: f"(({x}) % {PRIME})"
    a = mod(f"CAST({entity} AS BIGINT) * 7919 + CAST({replicate} AS BIGINT) * 104729 + {seed * 1299709 + 12345}")
    b = mod(f"{a} * 48271 + 11")
    c = mod(f"{b} * {b} + {a}")
    d = mod(f"{c} * 69621 + 7")
    return mod(f"{d} * {d} + {c}")


def drawn_numbers(entities: np.ndarray, replicate: int, seed: int = 0) -> np.ndarray:
    """draw() of many entities (int64) in a replicate."""
    def rest(x):
        if below:
            return np.fmod(x, PRIME)  # SQL's remainder has the sign of the number
        low = x & PRIME
        x >>= 31
        low += x
        return low  # below 2^33 and the same remainder, as PRIME is 2^31 - 1

    below, out = len(entities) > 0 and entities.min() < 0, np.empty(len(entities), np.int64)
    for at in range(0, len(entities), BLOCK):  # what fits a core's cache
        a = rest(entities[at : at + BLOCK] * 7919 + (int(replicate) * 104729 + seed * 1299709 + 12345))
        b = rest(a * 48271 + 11)
        c = rest(b * b + a)
        d = rest(c * 69621 + 7)
        x = rest(rest(d * d + c))
        out[at : at + BLOCK] = x if below else x - PRIME * (x >= PRIME)
    return out


def replicated(df: DataFrame, times: int, only: list[int] | None = None) -> DataFrame:
    return df.withColumn("r", F.explode(F.lit(only) if only else F.sequence(F.lit(1), F.lit(times))))


def shuffled(df: DataFrame, ident: str, times: int, seed: int, *by: str, only: list[int] | None = None) -> DataFrame:
    """df once for each replicate r (or for those of a list), with place: 1, 2, ... in random order within `by`."""
    order = Window.partitionBy("r", *by).orderBy(F.expr(draw(ident, "r", seed)), ident)
    return replicated(df, times, only).withColumn("place", F.row_number().over(order))


def redrawn(df: DataFrame, ident: str, times: int, seed: int, *by: str) -> DataFrame:
    """Bootstrap samples within `by`, a whole number (or nothing): as many rows as there are, drawn with replacement, for each replicate r."""
    own = Window.partitionBy(*by)
    numbered = df.select("*", F.row_number().over(own.orderBy(ident)).alias("__i"), F.count(F.lit(1)).over(own).alias("__n"))
    stream = f"__i * 101 + {by[0]}" if by else "__i"
    drawn = replicated(numbered.select(*by, "__i", "__n"), times).select("r", *by, F.expr(f"CAST({draw(stream, 'r', seed)} % __n + 1 AS INT)").alias("__i"))
    # One row for each key: a study of any size is dealt out. Spark takes the drawn numbers for as few as the entities, and would broadcast them.
    return drawn.join(numbered.drop("__n").hint("shuffle_hash"), [*by, "__i"]).drop("__i")


def bootstrap_sums(df: DataFrame, ident: str, features: dict[str, Column], times: int, seed: int, *by: str) -> DataFrame:
    """(by, r, n, features): for each replicate, how many rows were drawn within `by` and the sums of the features over them, each row as often as it was drawn.

    How often is multinomial, and drawn in two steps: a group's draws are split over its blocks of
    entities, then a block's over its entities. A replicate leaves one row a block, so that rows
    grow with blocks times replicates, not with entities times replicates, and the study is never
    sent anywhere. Streams are seeded by group, block and chunk of replicates: results don't depend
    on partitions. Without `by` all rows are one group; ids tell rows apart.
    """
    names = list(features)
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")
    rows = df.select(*by, group.alias("__g"), F.col(ident).alias("__i"), *(c.cast("double").alias(n) for n, c in features.items()))
    size = rows.groupBy("__g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("__blocks"))
    dealt = rows.join(size, "__g").withColumn("__b", F.pmod(F.xxhash64("__i"), F.col("__blocks")))
    blocks = dealt.groupBy(*by, "__g", "__b").agg(F.array_sort(F.collect_list(F.struct("__i", *names))).alias("__rows"))
    held = blocks.groupBy("__g").agg(F.array_sort(F.collect_list(F.struct("__b", F.size("__rows").alias("n")))).alias("__sizes"))
    chunks = held.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(-(-times // CHUNK) - 1))))

    def split(batches):
        for pdf in batches:
            for g, c, sizes in zip(pdf["__g"], pdf["__c"], pdf["__sizes"]):
                n = np.array([s["n"] for s in sizes], float)
                rng = np.random.default_rng([seed, int(g) & (1 << 63) - 1, int(c)])
                drawn = rng.multinomial(int(n.sum()), n / n.sum(), size=min(CHUNK, times - int(c) * CHUNK))
                yield pd.DataFrame({"__g": g, "__b": [s["__b"] for s in sizes], "__c": c, "__drawn": list(drawn.T)})

    drawn = chunks.mapInPandas(split, "__g long, __b long, __c int, __drawn array<long>")
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)

    def weigh(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                x = np.array([[r[n] for n in names] for r in row["__rows"]], float).reshape(len(row["__rows"]), len(names))
                rng = np.random.default_rng([seed, int(row["__g"]) & (1 << 63) - 1, int(row["__c"]), int(row["__b"])])
                counts = rng.multinomial(np.asarray(row["__drawn"], np.int64), np.full(len(x), 1 / len(x)))
                out = pd.DataFrame(counts @ x, columns=names)
                yield out.assign(r=np.arange(len(counts)) + int(row["__c"]) * CHUNK + 1, n=counts.sum(1), **{c: row[c] for c in by})[[*by, "r", "n", *names]]

    schema = f"{fields}r long, n long" + "".join(f", `{n}` double" for n in names)
    parts = blocks.join(drawn, ["__g", "__b"]).select(*by, "__g", "__b", "__c", "__drawn", "__rows").mapInPandas(weigh, schema)
    # Decimals, so that the order of blocks does not matter.
    return parts.groupBy(*by, "r").agg(F.sum("n").alias("n"), *(F.sum(F.col(n).cast("decimal(38,9)")).cast("double").alias(n) for n in names))


def told(x: Column) -> Column:
    return F.round(x, TELL)


def p_value(replicates: DataFrame, exceeds: Column, times: int) -> DataFrame:
    """Exceedances, and (exceedances + 1) / (times + 1)."""
    n = F.count_if(exceeds)
    return replicates.agg(n.alias("exceedances"), ((n + 1) / F.lit(times + 1.0)).alias("p"))


def interval(name: str) -> list[Column]:
    return [F.percentile(name, p).alias(f"{name}_{side}") for side, p in (("low", 0.025), ("high", 0.975))]


def _places(df: DataFrame, group: str) -> DataFrame:
    """Stretches of places that stand for the groups after a shuffle. A few rows."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(group))
    return n.select(group, "n", (upto - F.col("n")).alias("after"), upto.alias("upto"))


def _regrouped(df: DataFrame, ident: str, keep: list[str], group: str, times: int, seed: int, only: list[int] | None = None) -> DataFrame:
    """Replicates in which the labels of `group` are permuted, row by row."""
    moved = shuffled(df.select(ident, *keep), ident, times, seed, only=only)
    return moved.join(F.broadcast(_places(df, group)), F.col("place").between(F.col("after") + 1, F.col("upto")))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Standard deviations that a group's last place is looked for on either side of where it is expected.
REACH = 6.0


def regrouped_sums(df: DataFrame, ident: str, features: dict[str, Column], group: str, times: int, seed: int = 0) -> DataFrame:
    """(r, group, n, features): sums over the rows that fall to each group when its labels are permuted, NULLs not counted; the same permutations as by sorting all rows.

    Labels go by places, so all that a replicate needs are the numbers drawn at the last place of
    each group. As draws are even, those are near where they are expected: a block of rows is summed
    between these stretches, and only the rows inside them, some square root of all, are sent and put in order.
    A replicate whose places lie elsewhere is sorted as a whole.
    """
    names = list(features)
    rows = _written(df.select(F.col(ident).cast("long").alias("__i"), F.col(group).alias("__k"), *(c.cast("double").alias(n) for n, c in features.items())), "regrouped")
    places = sorted(_places(rows, "__k").collect(), key=lambda p: p["upto"])  # a row for each group
    upto, total = np.array([p["upto"] for p in places], np.int64), int(places[-1]["upto"]) if places else 0
    share = upto[:-1] / max(total, 1)
    reach = REACH * np.sqrt(share * (1 - share) / max(total, 1)) + 8 / max(total, 1)
    edges: list[int] = []  # begins and ends of stretches in turn; those that meet are one
    for low, high in zip((PRIME * (share - reach)).astype(np.int64), (PRIME * (share + reach)).astype(np.int64)):
        if edges and low <= edges[-1]:
            edges[-1] = int(high)
        else:
            edges += [int(low), int(high)]
    cuts, k, f = np.array(edges, np.int64), len(edges) + 1, len(names)
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64("__i"), F.lit(-(-max(total, 1) // (4 * BLOCK)))))
    fields = F.struct("__i", F.array(*(F.coalesce(n, F.lit(0.0)) for n in names)).alias("x"))
    blocks = dealt.groupBy("__b").agg(F.collect_list(fields).alias("rows")).select("__b", F.col("rows.__i").alias("ids"), F.flatten("rows.x").alias("values"))
    chunks = -(-times // CHUNK)
    sent = blocks.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(chunks, "__b", "__c")

    def split(batches):
        for pdf in batches:
            for ids, values, c in zip(pdf["ids"], pdf["values"], pdf["__c"]):
                ids, x = np.asarray(ids, np.int64), np.asarray(values, float).reshape(-1, f)
                out = []
                for r in range(int(c) * CHUNK + 1, min(times, (int(c) + 1) * CHUNK) + 1):
                    drawn = drawn_numbers(ids, r, seed)
                    at = np.searchsorted(cuts, drawn, "right")
                    near = np.flatnonzero(at % 2)
                    sums = [np.bincount(at, minlength=k)] + [np.bincount(at, x[:, j], k) for j in range(f)]
                    out.append((r, np.concatenate(sums).astype(float), (drawn[near] << 32) + (ids[near] + (1 << 31)), x[near].ravel()))
                yield pd.DataFrame(out, columns=["r", "sums", "keys", "values"])

    parts = sent.select("ids", "values", "__c").mapInPandas(split, "r long, sums array<double>, keys array<long>, values array<double>")
    held = parts.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("keys", "values", "sums"))).alias("p"))  # in order, so that partitions don't matter
    each = held.select("r", *(F.flatten(f"p.{c}").alias(c) for c in ("sums", "keys", "values")))

    def place(batches):
        for pdf in batches:
            out = []
            for r, sums, keys, values in zip(pdf["r"], pdf["sums"], pdf["keys"], pdf["values"]):
                sums = np.asarray(sums, float).reshape(-1, f + 1, k).sum(0).T
                keys, x = np.asarray(keys, np.int64), np.asarray(values, float).reshape(-1, f)
                order = np.argsort(keys)
                inside = np.searchsorted(keys[order] >> 32, cuts)  # how many rows of stretches lie before each edge
                run = np.vstack([np.zeros((1, f)), np.cumsum(x[order], 0)])
                gaps = np.cumsum(sums[::2], 0)  # rows and sums before each stretch, those of stretches left out
                found = np.zeros((len(upto) + 1, f))
                found[-1] = sums[:, 1:].sum(0)
                for j, last in enumerate(upto[:-1]):
                    s = np.searchsorted(cuts[1::2], int(PRIME * share[j]), "right")  # its stretch
                    m = int(last - gaps[s, 0])
                    if not inside[2 * s] <= m <= inside[2 * s + 1]:
                        found = None
                        break
                    found[j + 1] = gaps[s, 1:] + run[m]
                for j, (last, own) in enumerate(zip(upto, np.diff(np.concatenate([[0], upto])))):
                    out.append((r, j, own, *([None] * f if found is None else found[j + 1] - found[j])))
            yield pd.DataFrame(out, columns=["r", "__j", "n", *names]).astype({n: float for n in names})

    sums = _written(each.mapInPandas(place, "r long, __j int, n long" + "".join(f", `{n}` double" for n in names)), "sums")
    labels = df.sparkSession.createDataFrame([(j, p["__k"]) for j, p in enumerate(places)], f"__j int, `{group}` {df.schema[group].dataType.simpleString()}")
    out = ["r", group, "n", *names]
    missing = [r["r"] for r in sums.filter(F.col(names[0]).isNull()).select("r").distinct().collect()] if names else []
    found = sums.join(F.broadcast(labels), "__j").select(*out)
    if not missing:
        return found
    rest = _regrouped(rows, "__i", names, "__k", times, seed, missing).groupBy("r", F.col("__k").alias(group)).agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names))
    return found.filter(~F.col("r").isin(missing)).union(rest.select(*out))


def _effects(sums: DataFrame, *by: str) -> DataFrame:
    """eta2 and omega2 from n, s (sum) and q (sum of squares) of each group."""
    n, s, q, k = F.sum("n"), F.sum("s"), F.sum("q"), F.count(F.lit(1))
    both = sums.groupBy(*by).agg(n.alias("n"), k.alias("k"), (F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n).alias("between"), (q - s * s / n).alias("total"))
    ms = (F.col("total") - F.col("between")) / (F.col("n") - F.col("k"))
    return both.select(*by, safe_ratio(F.col("between"), F.col("total")).alias("eta2"), safe_ratio(F.col("between") - (F.col("k") - 1) * ms, F.col("total") + ms).alias("omega2"))


def _sums(df: DataFrame, x: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))


def permutation_effect(df: DataFrame, ident: str, x: str, group: str, times: int = 1999, seed: int = 0) -> DataFrame:
    """eta squared and its p by permuting group labels."""
    own = _effects(_sums(df, x, group)).select(F.col("eta2").alias("own"))
    each = _effects(regrouped_sums(df, ident, {"s": F.col(x), "q": F.col(x) * F.col(x)}, group, times, seed), "r")
    both = each.crossJoin(F.broadcast(own))  # one row
    n = F.count_if(told(F.col("eta2")) >= told(F.col("own")))
    return both.agg(F.first("own").alias("eta2"), n.alias("exceedances"), ((n + 1) / F.lit(times + 1.0)).alias("p"))


def bootstrap_effect(df: DataFrame, ident: str, x: str, group: str, times: int = 1000, seed: int = 0) -> DataFrame:
    """Percentile intervals of eta and omega squared, entities drawn within their groups (whole numbers)."""
    own = _effects(_sums(df, x, group)).select(F.col("eta2").alias("own"))
    each = _effects(_sums(redrawn(df.select(ident, x, group), ident, times, seed, group), x, "r", group), "r")
    found = each.agg(*interval("eta2"), *interval("omega2"))
    return found.crossJoin(F.broadcast(own)).select(F.col("own").alias("eta2"), "eta2_low", "eta2_high", "omega2_low", "omega2_high")


def bootstrap_effect_by_counts(df: DataFrame, ident: str, x: str, group: str, times: int = 1000, seed: int = 0) -> DataFrame:
    """As bootstrap_effect(), from counts in place of drawn rows: for studies of any size."""
    some = df.filter(F.col(x).isNotNull())
    own = _effects(_sums(some, x, group)).select(F.col("eta2").alias("own"))
    sums = bootstrap_sums(some, ident, {"s": F.col(x), "q": F.col(x) * F.col(x)}, times, seed, group)
    found = _effects(sums, "r").agg(*interval("eta2"), *interval("omega2"))
    return found.crossJoin(F.broadcast(own)).select(F.col("own").alias("eta2"), "eta2_low", "eta2_high", "omega2_low", "omega2_high")  # one row


def permutation_difference(df: DataFrame, ident: str, x: str, group: str, a, b, times: int = 1999, seed: int = 0) -> DataFrame:
    """Difference of the means of groups b and a, its p by permuting labels, and its bootstrap interval."""
    two = df.filter(F.col(group).isin(a, b)).select(ident, x, group)
    means = lambda d, *by: d.groupBy(*by).agg((F.avg(F.when(F.col(group) == b, F.col(x))) - F.avg(F.when(F.col(group) == a, F.col(x)))).alias("d"))
    own = means(two).select(F.col("d").alias("difference"))
    sums = regrouped_sums(two, ident, {"s": F.col(x), "m": F.col(x).isNotNull().cast("int")}, group, times, seed)
    side = lambda v: F.max(F.when(F.col(group) == v, safe_ratio(F.col("s"), F.col("m"))))
    moved = sums.groupBy("r").agg((side(b) - side(a)).alias("d")).crossJoin(F.broadcast(own))
    n = F.count_if(told(F.abs("d")) >= told(F.abs("difference")))
    p = moved.agg(F.first("difference").alias("difference"), ((n + 1) / F.lit(times + 1.0)).alias("p"))
    low = means(redrawn(two, ident, times, seed + 1, group), "r").withColumnRenamed("d", "difference").agg(*interval("difference")).toDF("low", "high")
    return p.crossJoin(F.broadcast(low))


def bootstrap_spearman(df: DataFrame, ident: str, x: str, y: str, group: str, times: int = 500, seed: int = 0) -> DataFrame:
    """Rank correlation within each group (a whole number) and its percentile interval; replicates without variance don't count."""
    from gridloom.operators.stats import average_rank, correlation

    def rho(d: DataFrame, *by: str) -> DataFrame:
        ranked = d.select(*by, average_rank(x, list(by)).alias("rx"), average_rank(y, list(by)).alias("ry"))
        return ranked.groupBy(*by).agg(correlation("rx", "ry").alias("rho"))

    own = rho(df, group)
    each = rho(redrawn(df.select(ident, x, y, group), ident, times, seed, group), group, "r")
    return own.join(each.groupBy(group).agg(*(c for c in interval("rho"))).toDF(group, "low", "high"), group)


def monte_carlo_chi_square(df: DataFrame, ident: str, row: str, column: str, times: int = 20000, seed: int = 0) -> DataFrame:
    """chi square and its p by permuting one margin."""
    from gridloom.operators.stats import cross_counts

    df = _written(df.select(ident, row, column), "study")
    cells = _written(cross_counts(df, row, column).select(row, column, "expected", F.col("n").alias("seen")), "cells")
    names = [v[0] for v in cells.select(row).distinct().orderBy(row).collect()]  # a few
    value = lambda n: F.sum(n * n / F.col("expected")) - F.sum(n)
    own = cells.agg(value(F.col("seen")).alias("chi2"))
    sums = regrouped_sums(df, ident, {f"m{i}": (F.col(row) == v).cast("int") for i, v in enumerate(names)} or {"m0": F.lit(0)}, column, times, seed)
    kind = reduce(lambda c, v: c.when(F.col(row) == v[1], v[0]), enumerate(names), F.when(F.lit(False), -1))
    counts = sums.select("r", column, F.posexplode(F.array(*(F.col(f"m{i}") for i in range(max(1, len(names)))))).alias("__kind", "m"))
    each = counts.join(F.broadcast(cells.withColumn("__kind", kind)), [column, "__kind"]).groupBy("r").agg(value(F.col("m")).alias("x"))  # empty cells add nothing to this form of chi square
    n = F.count_if(F.round("x", 9) >= F.round("chi2", 9))
    return each.crossJoin(F.broadcast(own)).agg(F.first("chi2").alias("chi2"), n.alias("exceedances"), ((n + 1) / F.lit(times + 1.0)).alias("p"))


#: Tables that are drawn from one random stream.
STREAM = 500


def random_tables(spark: SparkSession, rows: list[int], columns: list[int], times: int, seed: int = 0) -> DataFrame:
    """(r, cells): random tables with these margins, as likely as by permuting the study's labels, row by row in one array.

    A cell is drawn from what its row and column have left (a hypergeometric number), so a table
    costs its cells, whatever the size of the study, which has less than a billion rows. Streams of
    STREAM tables are seeded by their number: results don't depend on partitions.
    """
    if sum(rows) != sum(columns):
        raise ValueError("margins of different totals")

    def run(batches):
        for pdf in batches:
            for stream in pdf["id"]:
                rng, n = np.random.default_rng([seed, int(stream)]), min(STREAM, times - int(stream) * STREAM)
                left, cells = np.tile(np.array(columns, np.int64), (n, 1)), []
                for total in rows:
                    to_go = np.full(n, total, np.int64)
                    for j in range(len(columns)):
                        beyond = left[:, j + 1 :].sum(1)
                        x = rng.hypergeometric(left[:, j], beyond, to_go) if j + 1 < len(columns) else to_go.copy()
                        left[:, j] -= x
                        to_go -= x
                        cells.append(x)
                yield pd.DataFrame({"r": np.arange(n) + int(stream) * STREAM + 1, "cells": list(np.stack(cells, 1))})

    return spark.range(-(-times // STREAM)).mapInPandas(run, "r long, cells array<long>")


def monte_carlo_tables(df: DataFrame, row: str, column: str, times: int = 20000, seed: int = 0) -> DataFrame:
    """chi square, its p over random tables of the study's margins, and how many of those tables miss a margin (none). The study is only counted; rows without either label don't count."""
    seen = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("n")).collect()  # as many rows as cells
    names = [sorted({r[c] for r in seen}) for c in (row, column)]
    table = np.zeros((len(names[0]), len(names[1])), np.int64)
    for r in seen:
        table[names[0].index(r[row]), names[1].index(r[column])] = r["n"]
    margins = [table.sum(1).tolist(), table.sum(0).tolist()]
    expected = np.outer(*margins) / max(table.sum(), 1)
    own = float((table**2 / expected).sum() - table.sum()) if table.size else 0.0
    drawn = random_tables(df.sparkSession, *margins, times, seed)
    x = F.aggregate(F.zip_with("cells", F.lit(expected.ravel().tolist()), lambda n, e: n * n / e), F.lit(0.0), lambda s, v: s + v) - F.lit(float(table.sum()))
    k = len(names[1])
    total = lambda places: reduce(lambda a, b: a + b, (F.get("cells", p) for p in places))
    right = [total(range(i * k, i * k + k)) == m for i, m in enumerate(margins[0])] + [total(range(j, table.size, k)) == m for j, m in enumerate(margins[1])]
    wrong = ~reduce(lambda a, b: a & b, right) if right else F.lit(False)
    n = F.count_if(F.round(x, 9) >= F.round(F.lit(own), 9))
    return drawn.agg(F.lit(own).alias("chi2"), F.count(F.lit(1)).alias("tables"), F.count_if(wrong).alias("wrong_margins"), n.alias("exceedances"), ((n + 1) / F.lit(times + 1.0)).alias("p"))


#: Rows of a group that a task holds to put them in order again and again; larger groups are sorted by Spark, a row for each replicate.
HELD = 1 << 21


def permuted_sums(rows: DataFrame, ident: str, group: str, z: str, code: str, codes: int, times: int, seed: int = 0) -> DataFrame:
    """(r, b): for each replicate and group, the sums of z by the code (0 to codes - 1, or NULL) of the place that it falls to when it is permuted within the group, less what the codes' shares of the group would get.

    All ranks of a replicate are needed. They cost no shuffle of rows times replicates: a task takes
    a group in blocks, with a chunk of replicates, draws and orders in arrays. Groups have HELD rows at most.
    """
    own, n = Window.partitionBy(group), F.count(F.lit(1))
    block = lambda c: F.floor((c - 1) / BLOCK).cast("int")
    turn = F.row_number().over(own.orderBy(ident))
    some = rows.select(F.col(group).alias("__g"), block(turn).alias("__b"), (block(turn) == block(n.over(own))).alias("__end"), F.col(ident).cast("long").alias("i"), F.coalesce(F.col(z), F.lit(0.0)).alias("z"), F.coalesce(F.col(code), F.lit(codes)).cast("int").alias("k"))
    blocks = some.groupBy("__g", "__b", "__end").agg(F.array_sort(F.collect_list(F.struct("i", "z", "k"))).alias("s")).select("__g", "__b", "__end", *(F.col(f"s.{c}").alias(c) for c in "izk"))
    chunks = -(-times // CHUNK)
    sent = blocks.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(chunks, "__g", "__c").sortWithinPartitions("__g", "__c", "__b")

    def run(batches):
        parts: list[tuple] = []
        for pdf in batches:
            for i, z_, k, c, end in zip(pdf["i"], pdf["z"], pdf["k"], pdf["__c"], pdf["__end"]):
                parts.append((i, z_, k))
                if not end:
                    continue
                ids, values, at = (np.concatenate(a) for a in zip(*parts))
                parts = []
                ids, number = ids.astype(np.int64), np.arange(len(ids))
                n = np.bincount(at, minlength=codes + 1)[:codes]
                share = n / max(n.sum(), 1)
                out = []
                for r in range(int(c) * CHUNK + 1, min(times, (int(c) + 1) * CHUNK) + 1):
                    keys = drawn_numbers(ids, r, seed) << 32
                    keys += number  # ids ascend: of equal draws the smaller id comes first
                    keys.sort()
                    keys &= (1 << 32) - 1
                    found = np.bincount(at, values[keys], codes + 1)[:codes]
                    out.append((r, found - share * found.sum()))
                yield pd.DataFrame(out, columns=["r", "b"])

    return sent.select("i", "z", "k", "__c", "__end").mapInPandas(run, "r long, b array<double>")


def partial_r2(df: DataFrame, ident: str, y: str, group: str, category: str, times: int = 20000, seed: int = 0) -> DataFrame:
    """R squared of groups, of groups and categories, the partial R squared, and its p by permuting residuals within groups.

    By Frisch, Waugh and Lovell all that a replicate needs is the products of its residuals with the
    categories' dummies, both less their group means. Categories are a few.
    """
    df = _written(df.select(ident, y, group, category), "study")
    names = [r[0] for r in df.select(category).distinct().orderBy(category).collect()][1:]
    own = Window.partitionBy(group)
    less = lambda c: c - F.avg(c).over(own)
    rx = [f"x{i}" for i in range(len(names))]
    rows = df.select(ident, group, y, category, less(F.col(y)).alias("ry"), F.row_number().over(own.orderBy(ident)).alias("place"), *(less((F.col(category) == v).cast("double")).alias(c) for c, v in zip(rx, names)))
    pairs = [(i, j) for i in range(len(rx)) for j in range(len(rx))]
    got = rows.agg(F.var_pop(y).alias("v"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max("place"), F.lit(0)).alias("largest"), F.sum(F.col("ry") * F.col("ry")).alias("rest"), *(F.sum(F.col(rx[i]) * F.col(rx[j])).alias(f"g{i}_{j}") for i, j in pairs)).first()
    inverse = np.linalg.pinv(np.array([got[f"g{i}_{j}"] for i, j in pairs], float).reshape(len(rx), len(rx))) if rx else np.zeros((0, 0))
    explained = reduce(lambda a, b: a + b, (F.lit(float(inverse[i, j])) * F.col(f"b{i}") * F.col(f"b{j}") for i, j in pairs), F.lit(0.0))
    products = [F.sum(F.col(c) * F.col("z")).alias(f"b{i}") for i, c in enumerate(rx)] or [F.lit(0).alias("b")]
    one = rows.withColumn("z", F.col("ry")).agg(*products).select((explained / F.lit(got["rest"])).alias("partial_r2"))
    known = rows.filter(F.col(group).isNotNull())
    size = F.count(F.lit(1)).over(own)
    code = reduce(lambda c, v: c.when(F.col(category) == v[1], v[0]), enumerate(names), F.when(F.lit(False), 0)).when(F.col(category).isNotNull(), len(names))
    held = known.withColumn("code", code).withColumn("__n", size).filter(F.col("__n") <= HELD)
    sums = permuted_sums(held, ident, group, "ry", "code", len(names) + 1, times, seed).select("r", *(F.get("b", F.lit(i)).alias(c) for i, c in enumerate(rx)))
    if got["largest"] > HELD:
        large = known.withColumn("__n", size).filter(F.col("__n") > HELD)
        moved = shuffled(large.select(ident, group, F.col("ry").alias("z")), ident, times, seed, group).select("r", group, "place", "z")
        sums = sums.union(moved.join(large.select(group, "place", *rx), [group, "place"]).groupBy("r").agg(F.count(F.lit(1)), *(F.sum(F.col(c) * F.col("z")).alias(c) for c in rx)).select("r", *rx))
    each = sums.groupBy("r").agg(*([F.sum(c).alias(f"b{i}") for i, c in enumerate(rx)] or [F.lit(0).alias("b")])).select((explained / F.lit(got["rest"])).alias("x"))
    n = F.count_if(told(F.col("x")) >= told(F.col("partial_r2")))
    p = each.crossJoin(F.broadcast(one)).agg(F.first("partial_r2").alias("partial_r2"), ((n + 1) / F.lit(times + 1.0)).alias("p"))
    share = F.lit(got["rest"] / (got["v"] * got["n"]))
    return p.select((1 - share).alias("r2_group"), (1 - share * (1 - F.col("partial_r2"))).alias("r2_full"), "partial_r2", "p")


def cross_validated(df: DataFrame, ident: str, y: str, group: str, folds: int = 10, repeats: int = 50, seed: int = 0) -> DataFrame:
    """Out-of-fold R squared of group means, AUC and Brier skill of groups' shares of positive values; means over repeated folds stratified by group."""
    from gridloom.operators.stats import average_rank

    up = (F.col(y) > 0).cast("int")
    rows = shuffled(df.select(ident, F.col(y).alias("v"), up.alias("up"), group), ident, repeats, seed, group).withColumn("fold", (F.col("place") - 1) % folds)
    whole, part = Window.partitionBy("r", group), Window.partitionBy("r", group, "fold")
    others = lambda c: F.sum(c).over(whole) - F.sum(c).over(part)
    left = rows.select("r", "v", "up", others(F.lit(1)).alias("n"), others("v").alias("t"), others("up").alias("u")).filter("n > 0")
    told_ = left.select("r", "v", "up", (F.col("t") / F.col("n")).alias("guess"), (F.col("u") / F.col("n")).alias("chance"))
    ranked = told_.withColumn("rank", average_rank("chance", ["r"]))
    ones, zeros = F.sum("up"), F.sum(1 - F.col("up"))
    share = F.avg("up")
    each = ranked.groupBy("r").agg(
        (1 - F.sum(F.pow(F.col("v") - F.col("guess"), 2)) / (F.var_pop("v") * F.count(F.lit(1)))).alias("r2"),
        F.when((ones > 0) & (zeros > 0), (F.sum(F.col("rank") * F.col("up")) - ones * (ones + 1) / 2) / (ones * zeros)).alias("auc"),
        F.when((ones > 0) & (zeros > 0), 1 - F.avg(F.pow(F.col("chance") - F.col("up"), 2)) / (share * (1 - share))).alias("brier_skill"),
    )
    return each.agg(*(F.avg(c).alias(c) for c in ("r2", "auc", "brier_skill")))


def composition_bootstrap(df: DataFrame, ident: str, group: str, times: int = 1000, seed: int = 0) -> DataFrame:
    """Intervals of groups' gains, as they are and at the common composition, and of differences between groups at it.

    df has a row for each entity and bin: share, gain, and the squared errors mse_focal and
    mse_comparator, NULL where a bin has no rows. Entities are drawn within groups; a bin's conditional
    value is weighted by the drawn entities' shares, the common composition by the sizes of groups.
    rmse_gain is derived from the squared errors. A replicate counts for a group if all bins have a value.
    """
    entities = df.select(ident, group).distinct()
    drawn = redrawn(entities, ident, times, seed, group).groupBy("r", ident, group).agg(F.count(F.lit(1)).alias("m"))
    rows = drawn.join(df.hint("shuffle_hash"), [ident, group])
    sizes = entities.groupBy(group).agg(F.count(F.lit(1)).alias("size"))

    def conditional(c: str) -> Column:
        w = F.when((F.col("share") > 0) & F.col(c).isNotNull(), F.col("m") * F.col("share"))
        return safe_ratio(F.sum(w * F.col(c)), F.sum(w))

    values = ("gain", "mse_focal", "mse_comparator")
    bins = rows.groupBy("r", group, "bin").agg((F.sum(F.col("m") * F.col("share")) / F.sum("m")).alias("p"), *(conditional(c).alias(c) for c in values)).join(F.broadcast(sizes), group)
    common = Window.partitionBy("r", "bin")
    bins = bins.withColumn("q", F.sum(F.col("size") * F.col("p")).over(common) / F.sum("size").over(common))
    total = lambda w, c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(F.col(w) * F.col(c)))
    root = lambda x: F.when(x.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), x)))
    rmse = lambda w: root(total(w, "mse_comparator")) - root(total(w, "mse_focal"))
    each = bins.groupBy("r", group).agg(total("p", "gain").alias("observed_gain"), total("q", "gain").alias("standardised_gain"), rmse("p").alias("observed_rmse_gain"), rmse("q").alias("standardised_rmse_gain"))
    names = ["observed_gain", "standardised_gain", "observed_rmse_gain", "standardised_rmse_gain"]
    long = each.unpivot(["r", group], names, "estimate", "value").select("r", "estimate", F.col(group).alias("a"), F.col(group).alias("b"), "value")
    x, y = (each.select("r", *(F.col(c).alias(f"{c}_{t}") for c in (group, "standardised_gain", "standardised_rmse_gain"))) for t in "xy")
    pairs = x.join(y, "r").filter(F.col(f"{group}_x") < F.col(f"{group}_y"))
    apart = pairs.select("r", F.col(f"{group}_x").alias("a"), F.col(f"{group}_y").alias("b"), *((F.col(f"{c}_y") - F.col(f"{c}_x")).alias(f"{c}_difference") for c in ("standardised_gain", "standardised_rmse_gain")))
    apart = apart.unpivot(["r", "a", "b"], ["standardised_gain_difference", "standardised_rmse_gain_difference"], "estimate", "value").select("r", "estimate", "a", "b", "value")
    return long.union(apart).groupBy("estimate", "a", "b").agg(F.count("value").alias("replicates"), F.avg("value").alias("mean"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))
