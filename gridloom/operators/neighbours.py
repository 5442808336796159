"""Exact nearest neighbours within groups, through an index of pivots and rings.

Each source lies in the cell of its nearest pivot, and there in a ring of distances to it. By the
triangle inequality a ring is no nearer to a row than the gap between the row's and the ring's
distances to any pivot; a row looks only into rings that may hold one of its k nearest. Rows and
rings meet in blocks, keyed by (group, cell, ring), so that no group is one task's work. How much is
left out depends on the data: in many even dimensions all distances are alike, and little is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.profiles import as_arrays, euclidean, in_blocks
from gridloom.sources.scratch import scratch

#: Pivots of a group and rings of a cell, at most, and the rows that call for one more of either; copies of a group's pivots and rings for its blocks to meet.
PIVOTS, RINGS, ROWS, COPIES = 16, 8, 128, 32
#: Rings to which a block is sent at once.
SENT = 16
#: Ranges of values over which shares are counted side by side.
RANGES = 64


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _beside(blocks: DataFrame, small: DataFrame) -> DataFrame:
    """Blocks with their group's row of a small table, by (group, copy): a group of many blocks is dealt out."""
    copies = small.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return blocks.withColumn("copy", F.pmod("b", F.lit(COPIES)).cast("int")).join(copies, ["group", "copy"]).drop("copy")


def _matrix(rows) -> np.ndarray:
    return np.stack([np.asarray(r["profile"], float) for r in rows])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root mean square differences of all rows of a and b."""
    off = a[:, None] - b[None]
    return np.sqrt(np.einsum("ijk,ijk->ij", off, off) / a.shape[1])


def rings_to_visit(to_pivots: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """For each row of distances to pivots, which rings may hold one of its k nearest; low and high bound a ring's distances to each pivot.

    As many rings as hold k rows, taken by their farthest possible distance, bound the k-th; rings
    whose least possible distance is above that are left out.
    """
    d = to_pivots[:, None]
    most = (d + high[None]).min(2)
    least = np.maximum(np.maximum(low[None] - d, d - high[None]), 0).max(2)
    order = np.argsort(most, 1, kind="stable")
    held = np.cumsum(size[order], 1)
    enough = np.minimum((held < k).sum(1), len(size) - 1)
    bound = np.take_along_axis(most, np.take_along_axis(order, enough[:, None], 1), 1)
    bound = np.where(held[:, -1:] < k, np.inf, bound)
    return least <= bound * (1 + 1e-9) + 1e-12


def nearest_distances(every: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(entity, group, is_source, near, compared): distances of each row of every (entity, group, is_source, profile) to its `most` nearest sources of its group, ascending, without itself, and to how many sources it was compared.

    Profiles are arrays of one length. Where a group has fewer sources, near has as many; rows whose
    group has none go. The same as comparing all pairs.
    """
    kind, group = (every.schema[c].dataType.simpleString() for c in ("entity", "group"))
    every = every.select("entity", "group", "is_source", F.col("profile").cast("array<double>").alias("profile"))
    turn = F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64("entity"), "entity"))
    size = sources.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    pivots = sources.select("group", turn.alias("no"), F.col("profile").cast("array<double>").alias("profile")).filter(F.col("no") <= PIVOTS)
    pivots = pivots.join(size, "group").filter(F.col("no") <= F.ceil(F.col("size") / ROWS))
    pivots = pivots.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "profile"))), lambda s: s["profile"]).alias("pivots"))

    def place(batches):
        for pdf in batches:
            out = []
            for g, block, points in zip(pdf["group"], pdf["block"], pdf["pivots"]):
                d = distances(_matrix(block), np.stack([np.asarray(p, float) for p in points]))
                out += [(r["entity"], g, r["is_source"], r["profile"], int(v.argmin()), float(v.min()), v) for r, v in zip(block, d)]
            yield pd.DataFrame(out, columns=["entity", "group", "is_source", "profile", "cell", "distance", "to_pivots"])

    blocks = _beside(in_blocks(every, "group"), pivots).select("group", "block", "pivots")
    placed = _written(blocks.mapInPandas(place, f"entity {kind}, group {group}, is_source boolean, profile array<double>, cell int, distance double, to_pivots array<double>"), "placed")

    own = placed.filter("is_source")
    radius = own.groupBy("group", "cell").agg(F.max("distance").alias("radius"), F.least(F.lit(RINGS), F.ceil(F.count(F.lit(1)) / ROWS)).alias("rings"))
    ring = F.least(F.col("rings") - 1, F.floor(F.col("rings") * F.coalesce(F.try_divide(F.col("distance"), F.col("radius")), F.lit(0.0)))).cast("int")
    ringed = own.join(radius, ["group", "cell"]).select("entity", "group", "cell", ring.alias("ring"), "to_pivots", "profile")
    # Of a ring its rows, and the least and greatest of their distances to every pivot.
    sides = ringed.select("group", "cell", "ring", F.posexplode("to_pivots").alias("q", "d")).groupBy("group", "cell", "ring", "q").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    sides = sides.groupBy("group", "cell", "ring").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("q", "low", "high"))).alias("s"))
    of = lambda c: F.transform("s", lambda x: x[c]).alias(c)
    rings = sides.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("cell", "ring", "n", of("low"), of("high")))).alias("rings"))

    def visit(batches):
        for pdf in batches:
            # A block goes to many rings, so that what a batch of them sends is many times what it holds: each is sent by itself.
            for g, block, held in zip(pdf["group"], pdf["block"], pdf["rings"]):
                size, low, high = (np.array([r[c] for r in held]) for c in ("n", "low", "high"))
                wanted = rings_to_visit(np.stack([np.asarray(r["to_pivots"], float) for r in block]), size, low, high, most + 1)
                rows = [{c: r[c] for c in ("entity", "is_source", "profile")} for r in block]
                out = [(g, int(r["cell"]), int(r["ring"]), [rows[i] for i in np.flatnonzero(on)]) for r, on in zip(held, wanted.T) if on.any()]
                for at in range(0, len(out), SENT):
                    yield pd.DataFrame(out[at : at + SENT], columns=["group", "cell", "ring", "rows"])

    near = _beside(in_blocks(placed.select("entity", "group", "is_source", "profile", "to_pivots", "cell"), "group", "cell").drop("cell"), rings)
    seekers = near.select("group", "block", "rings").mapInPandas(visit, f"group {group}, cell int, ring int, rows array<struct<entity: {kind}, is_source: boolean, profile: array<double>>>")
    held = in_blocks(ringed.select("entity", "group", "cell", "ring", "profile"), "group", "cell", "ring").drop("b")

    def compare(batches):
        for pdf in batches:
            out = []
            for g, rows, block in zip(pdf["group"], pdf["rows"], pdf["block"]):
                names, others = np.array([r["entity"] for r in rows]), np.array([r["entity"] for r in block])
                d = distances(_matrix(rows), _matrix(block))
                d[names[:, None] == others[None]] = np.inf
                best = np.sort(np.partition(d, min(most, d.shape[1]) - 1, 1)[:, :most], 1)
                out += [(r["entity"], g, r["is_source"], v[np.isfinite(v)], int(n)) for r, v, n in zip(rows, best, np.isfinite(d).sum(1))]
            yield pd.DataFrame(out, columns=["entity", "group", "is_source", "near", "compared"])

    found = seekers.join(held, ["group", "cell", "ring"]).select("group", "rows", "block").mapInPandas(compare, f"entity {kind}, group {group}, is_source boolean, near array<double>, compared long")
    return found.groupBy("entity", "group", "is_source").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most).alias("near"), F.sum("compared").alias("compared"))


def shares_at_least(rows: DataFrame, **names: str) -> DataFrame:
    """rows (entity, group, is_source, values) with, for each name=value, the share in percent of the group's sources whose value is at least the row's. All values are counted at once, and ranges of a group's values side by side."""
    long = rows.unpivot(["entity", "group", "is_source"], list(names.values()), "__of", "__v")
    edges = long.groupBy("group", "__of").agg(F.percentile_approx("__v", [i / RANGES for i in range(1, RANGES)], 1000).alias("__edges"))
    dealt = long.join(edges, ["group", "__of"]).withColumn("__range", F.size(F.filter("__edges", lambda e: e < F.col("__v")))).drop("__edges")
    source = F.col("is_source").cast("int")
    own = Window.partitionBy("group", "__of")
    n = dealt.groupBy("group", "__of", "__range").agg(F.sum(source).alias("__n"))  # some RANGES rows a group
    n = n.select("group", "__of", "__range", (F.sum("__n").over(own.orderBy(F.desc("__range"))) - F.col("__n")).alias("__above"), F.sum("__n").over(own).alias("__all"))
    inside = F.sum(source).over(Window.partitionBy("group", "__of", "__range").orderBy(F.desc("__v")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    share = dealt.withColumn("__in", inside).join(n, ["group", "__of", "__range"]).withColumn("__share", 100 * (F.col("__above") + F.col("__in")) / F.col("__all"))
    pick = lambda v, c: F.max(F.when(F.col("__of") == v, F.col(c)))
    return share.groupBy("entity", "group", "is_source").agg(*(pick(v, "__v").alias(v) for v in names.values()), *(pick(v, "__share").alias(k) for k, v in names.items()))


def support(targets: DataFrame, sources: DataFrame, *ks: int) -> DataFrame:
    """For each target (entity, group, profile) and each k, the mean distance of its k nearest sources of its group, and the share of sources whose own such mean is at least as large; the same share for the distance to the sources' mean profile (centrality)."""
    every = targets.select("entity", "group", "profile", F.lit(False).alias("is_source")).union(sources.select("entity", "group", "profile", F.lit(True)))
    near = nearest_distances(every, sources, max(ks))
    mean = lambda k: F.aggregate(F.slice("near", 1, k), F.lit(0.0), lambda s, x: s + x) / F.size(F.slice("near", 1, k))
    centre = sources.select("group", F.posexplode("profile").alias("i", "v")).groupBy("group", "i").agg(F.avg("v").alias("v"))
    centres = as_arrays(centre, "i", "v", "group").withColumnRenamed("profile", "centre")  # one row a group
    apart = every.join(centres, "group").select("entity", "group", "is_source", euclidean(F.col("profile"), F.col("centre"), per_slot=True).alias("centre_distance"))
    out = near.select("entity", "group", "is_source", *(F.when(F.size("near") > 0, mean(k)).alias(f"support_distance_{k}") for k in ks)).join(apart, ["entity", "group", "is_source"])
    found = shares_at_least(_written(out, "support"), **{f"support_percentile_{k}": f"support_distance_{k}" for k in ks}, centrality_percentile="centre_distance")
    return found.filter("not is_source").drop("is_source")
