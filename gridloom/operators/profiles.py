"""Daily profiles, distances between them, nearest prototypes, neighbour support, clusterings.

A profile is (entity, slot, value), or an array in order of slots for distances. Distances over all
pairs are joined within a group, or against a small prototype side; time-warping distances run in
NumPy, batched by Arrow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.functions.scalars import safe_ratio
from gridloom.operators import warping
from gridloom.sources.scratch import scratch


def slot_profile(panel: DataFrame, slot: str, *by: str) -> DataFrame:
    """Mean value and observed rows per entity and slot of the day."""
    return panel.groupBy("entity", *by, slot).agg(F.avg("value").alias("mean_value"), F.count("value").alias("observed"))


def across_entities(profiles: DataFrame, slot: str, value: str = "mean_value") -> DataFrame:
    return profiles.groupBy(slot).agg(F.avg(value).alias("mean"), F.percentile(value, 0.25).alias("q25"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.75).alias("q75"))


def z_scored(profiles: DataFrame, value: str = "mean_value", floor: float = 0.01) -> DataFrame:
    """Adds each entity's mean, population deviation, z-score, and whether its signal is too low to fit on."""
    own = Window.partitionBy("entity")
    std = F.stddev_pop(value).over(own)
    return profiles.select("*", F.avg(value).over(own).alias("profile_mean"), std.alias("profile_std"), ((F.col(value) - F.avg(value).over(own)) / F.greatest(std, F.lit(floor))).alias("z"), (std < floor).alias("low_signal"))


def as_arrays(profiles: DataFrame, slot: str, value: str, *by: str) -> DataFrame:
    return profiles.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(slot, value))), lambda s: s[value]).alias("profile"))


def peak_slot(slot: str, value: str) -> Column:
    """Aggregate: slot of the largest value, the first on ties."""
    return F.max_by(slot, F.struct(F.col(value), -F.col(slot)))


def local_maxima(profiles: DataFrame, slot: str, value: str, top: int = 2) -> DataFrame:
    """The `top` largest values that no neighbouring slot exceeds."""
    w = Window.partitionBy("entity").orderBy(slot)
    v = F.col(value)
    high = profiles.withColumn("__b", F.coalesce(F.lag(value).over(w), F.lit(float("-inf")))).withColumn("__a", F.coalesce(F.lead(value).over(w), F.lit(float("-inf")))).filter((v >= F.col("__b")) & (v >= F.col("__a")))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(value), slot))
    return high.withColumn("peak_rank", rank).filter(F.col("peak_rank") <= top).drop("__a", "__b")


def ramp(profiles: DataFrame, slot: str, value: str, *by: str) -> DataFrame:
    """Largest absolute change between adjacent slots."""
    w = Window.partitionBy("entity", *by).orderBy(slot)
    return profiles.select("entity", *by, F.abs(F.col(value) - F.lag(value).over(w)).alias("d")).groupBy("entity", *by).agg(F.max("d").alias("max_ramp"))


# ---- distances --------------------------------------------------------------------------------


def euclidean(a: Column, b: Column, per_slot: bool = False) -> Column:
    """Distance of two arrays; per_slot divides the square by their length (root mean square)."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(total / F.size(a)) if per_slot else F.sqrt(total)


def correlation_distance(a: Column, b: Column) -> Column:
    """1 - correlation of two arrays; NULL if either is constant."""
    n = F.size(a)
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y.cast("double")) / n
    centre = lambda x: F.transform(x, lambda y: y.cast("double") - mean(x))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    ca, cb = centre(a), centre(b)
    return 1 - safe_ratio(dot(ca, cb), F.sqrt(dot(ca, ca) * dot(cb, cb)))


def dtw_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Time-warping distances of rows of a and b, pair by pair."""
    return np.sqrt(warping.squared(a, b))


def dtw(a: Column | str, b: Column | str) -> Column:
    """Time-warping distance of two arrays of equal lengths."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(dtw_matrix(np.stack(x.to_numpy()), np.stack(y.to_numpy())) if len(x) else [], dtype="float64")

    return run(a, b)


def to_prototypes(profiles: DataFrame, prototypes: DataFrame, distance) -> DataFrame:
    """(entity, prototype, distance) for all pairs; prototypes (prototype, shape) are a few."""
    return profiles.crossJoin(F.broadcast(prototypes)).select("entity", "prototype", distance(F.col("profile"), F.col("shape")).alias("distance"))


def nearest(distances: DataFrame) -> DataFrame:
    """Nearest and second nearest prototype, lower name on ties, with margin and ratio."""
    rank = F.row_number().over(Window.partitionBy("entity").orderBy("distance", "prototype"))
    r = distances.withColumn("r", rank).filter("r <= 2")
    pick = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    out = r.groupBy("entity").agg(pick(1, "prototype").alias("assigned"), pick(2, "prototype").alias("second"), pick(1, "distance").alias("nearest_distance"), pick(2, "distance").alias("second_distance"))
    return out.select("*", (F.col("second_distance") - F.col("nearest_distance")).alias("margin"), safe_ratio(F.col("nearest_distance"), F.col("second_distance")).alias("ratio"))


#: Profiles that stand together in one row when all pairs of a group are compared.
BLOCK = 256


def in_blocks(profiles: DataFrame, *by: str, blocks: Column | None = None) -> DataFrame:
    """(by, b, block): arrays of up to about BLOCK (entity, profile, and what else profiles have) each, in order of entity, so that pairs never become rows of their own. A block goes by its number b: rows may arrive in any order."""
    size = profiles.groupBy(*by).agg((F.ceil(F.count(F.lit(1)) / BLOCK) if blocks is None else blocks).alias("__n"))
    dealt = profiles.join(F.broadcast(size), list(by)) if by else profiles.crossJoin(F.broadcast(size))
    held = F.struct("entity", "profile", *(c for c in profiles.columns if c not in ("entity", "profile", *by)))
    return dealt.withColumn("b", F.pmod(F.xxhash64("entity"), F.col("__n"))).groupBy(*by, "b").agg(F.array_sort(F.collect_list(held)).alias("block"))


# ---- clusterings ------------------------------------------------------------------------------


#: Blocks of all profiles, and tasks that share the partners of one: both fixed, so that what is sent and held beside sums grows with profiles, not with their pairs.
PARTNERS, SHARES = 16, 8
#: Profiles of a block; only beyond that many in each are there more blocks.
HELD = 1 << 16
#: Profiles on each side whose distances are there at once.
SIDE = 1024


def _block_pairs(profiles: DataFrame) -> DataFrame:
    """(block_x, block_y, same): every two blocks once, and each with itself. Blocks are written once, so that both sides have the same rows under the same number.

    On a ring of blocks each goes to the half that follows it, so that all get as many. Spark does
    not see how often, and would broadcast what is sent: both sides are shuffled by number and share.
    """
    path, n = scratch(profiles.sparkSession, "blocks"), F.count(F.lit(1))
    in_blocks(profiles, blocks=F.greatest(F.ceil(n / HELD), F.least(F.ceil(n / BLOCK), F.lit(PARTNERS)))).write.parquet(path)
    blocks = profiles.sparkSession.read.parquet(path)
    k = (blocks.agg(F.max("b")).first()[0] or 0) + 1
    step = F.explode(F.sequence(F.lit(0), F.lit(k // 2))).alias("step")
    # Blocks that face each other on an even ring meet once.
    x = blocks.select("b", step, F.col("block").alias("block_x")).filter((F.col("step") * 2 < k) | (F.col("b") * 2 < k))
    x = x.select(((F.col("b") + F.col("step")) % k * SHARES + F.col("step") % SHARES).alias("to"), (F.col("step") == 0).alias("same"), "block_x").repartition(min(k * SHARES, 4096), "to")
    share = F.explode(F.sequence(F.lit(0), F.lit(min(SHARES, k // 2 + 1) - 1))).alias("share")
    y = blocks.select("b", share, F.col("block").alias("block_y")).select((F.col("b") * SHARES + F.col("share")).alias("to"), "block_y")
    return x.join(y.hint("shuffle_hash"), "to").select("block_x", "block_y", "same")


def _tiles(n: int, m: int, same: bool):
    """(rows, columns) of the parts of a matrix; of a square one with itself, those on and above its diagonal."""
    for i in range(0, n, SIDE):
        for j in range(i if same else 0, m, SIDE):
            yield slice(i, i + SIDE), slice(j, j + SIDE)


def dtw_pairs(profiles: DataFrame) -> DataFrame:
    """The matrix of time-warping distances as rows (a, b, d) with a before b: pairs of blocks of entities, each computed at once.

    profiles (entity, profile) are arrays of one length. Half the matrix is formed; its rows spread over
    all tasks.
    """
    kind = profiles.schema["entity"].dataType.simpleString()
    kinds = pa.schema([(c, to_arrow_type(profiles.schema["entity"].dataType)) for c in "ab"] + [("d", pa.float64())])

    def read(side):
        return side.field("entity").to_numpy(zero_copy_only=False), side.field("profile").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(side), -1)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                same = batch.column("same")[at].as_py()
                (ea, xa), (eb, xb) = (read(batch.column(c).slice(at, 1).flatten()) for c in ("block_x", "block_y"))
                for rows, columns in _tiles(len(ea), len(eb), same):
                    one, two = (v.ravel() for v in np.meshgrid(ea[rows], eb[columns], indexing="ij"))
                    d = np.sqrt(warping.all_squared(xa[rows], xb[columns])).ravel()
                    if same and rows == columns:
                        on = one < two
                        one, two, d = one[on], two[on], d[on]
                    low = one < two
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.where(low, one, two), np.where(low, two, one), d)], schema=kinds)

    return _block_pairs(profiles.select("entity", "profile")).mapInArrow(run, f"a {kind}, b {kind}, d double")


def _score(mean: DataFrame, *by: str) -> DataFrame:
    """Mean silhouette from mean distances m of each entity a, labelled own, to each label."""
    s = mean.groupBy(*by, "a", "own").agg(F.max(F.when(F.col("own") == F.col("other"), F.col("m"))).alias("inner"), F.min(F.when(F.col("own") != F.col("other"), F.col("m"))).alias("outer"))
    value = F.when(F.col("inner").isNull(), 0.0).otherwise(F.coalesce((F.col("outer") - F.col("inner")) / F.greatest("inner", "outer"), F.lit(0.0)))
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("silhouette"))


def silhouette(labels: DataFrame, pairs: DataFrame, *by: str) -> DataFrame:
    """Mean silhouette of (by, entity, label), one for each clustering, from half a matrix of distances (a, b, d)."""
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    la = labels.select(*by, F.col("entity").alias("a"), F.col("label").alias("own"))
    lb = labels.select(*by, F.col("entity").alias("b"), F.col("label").alias("other"))
    # Sums to each label first: the label of the far end alone says where a distance belongs.
    sums = both.join(lb, "b").groupBy(*by, "a", "other").agg(F.avg("d").alias("m"))
    return _score(sums.join(la, [*by, "a"]), *by)


def silhouettes(profiles: DataFrame, labels: DataFrame, distances) -> DataFrame:
    """Mean silhouette of each fit (k, seed) of labels (k, seed, entity, label), by distances of all rows of two arrays.

    A task has two blocks of profiles; it fills their distances once, part by part, and sums them by
    the cluster of the far end, for all fits in one product. A row of sums leaves it for each entity,
    so that what is sent grows with entities and clusters, not with pairs.
    """
    kind = profiles.schema["entity"].dataType.simpleString()
    own = labels.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("k", "seed", "label"))).alias("own"))
    sizes = sorted(tuple(r) for r in labels.groupBy("k", "seed", "label").agg(F.count(F.lit(1)).alias("size")).collect())  # a row for each cluster
    fits = sorted({r[:2] for r in sizes})
    of_fit = [np.array([r[2] for r in sizes if r[:2] == f]) for f in fits]
    first = np.cumsum([0, *map(len, of_fit)])

    def read(side):
        entity, profile, own = (side.field(c) for c in ("entity", "profile", "own"))
        label = own.flatten().field("label").to_numpy(zero_copy_only=False).reshape(len(side), -1)
        place = np.stack([first[i] + np.searchsorted(c, label[:, i]) for i, c in enumerate(of_fit)], 1)
        return entity, profile.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(side), -1), place

    def marked(place):
        out = np.zeros((len(place), first[-1]))
        np.put_along_axis(out, place, 1.0, 1)
        return out

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                same = batch.column("same")[at].as_py()
                (ea, xa, pa_), (eb, xb, pb) = (read(batch.column(c).slice(at, 1).flatten()) for c in ("block_x", "block_y"))
                ta, tb = np.zeros((len(ea), first[-1])), np.zeros((len(eb), first[-1]))
                for rows, columns in _tiles(len(ea), len(eb), same):
                    d = distances(xa[rows], xb[columns])
                    if same and rows == columns:
                        np.fill_diagonal(d, 0.0)
                    ta[rows] += d @ marked(pb[columns])
                    if not same:
                        tb[columns] += d.T @ marked(pa_[rows])
                    elif rows != columns:
                        ta[columns] += d.T @ marked(pa_[rows])
                for names, total in ((ea, ta),) if same else ((ea, ta), (eb, tb)):
                    for part in (slice(i, i + SIDE) for i in range(0, len(names), SIDE)):
                        flat = total[part].ravel()
                        yield pa.RecordBatch.from_arrays([names[part], pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, first[-1], dtype=np.int32), flat)], ["a", "totals"])

    parts = _block_pairs(profiles.select("entity", "profile").join(own, "entity")).mapInArrow(run, f"a {kind}, totals array<double>").repartition("a")
    sums = parts.select("a", F.posexplode("totals").alias("place", "total")).groupBy("a", "place").agg(F.sum(F.col("total").cast("decimal(38,12)")).cast("double").alias("total"))
    clusters = profiles.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(sizes)], f"place int, k int, seed int, other {labels.schema['label'].dataType.simpleString()}, size long")
    la = labels.select("k", "seed", F.col("entity").alias("a"), F.col("label").alias("own"))
    both = sums.join(F.broadcast(clusters), "place").join(la, ["k", "seed", "a"])
    n = F.col("size") - (F.col("own") == F.col("other")).cast("int")  # none counts itself
    return _score(both.withColumn("m", safe_ratio(F.col("total"), n)), "k", "seed")


def warped_silhouettes(profiles: DataFrame, labels: DataFrame) -> DataFrame:
    return silhouettes(profiles, labels, lambda a, b: np.sqrt(warping.all_squared(a, b)))


def straight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b: by their product, and by differences where that would cancel."""
    norms = (a * a).sum(1)[:, None] + (b * b).sum(1)[None]
    d = norms - 2 * (a @ b.T)
    i, j = np.nonzero(~(d > 1e-3 * norms))
    for at in range(0, len(i), warping.PAIRS):
        p, q = i[at : at + warping.PAIRS], j[at : at + warping.PAIRS]
        d[p, q] = ((a[p] - b[q]) ** 2).sum(1)
    return np.sqrt(d)


def silhouette_of_profiles(profiles: DataFrame) -> DataFrame:
    """Mean silhouette of (entity, label, profile) by Euclidean distances; labels are whole numbers."""
    labels = profiles.select(F.lit(0).alias("k"), F.lit(0).alias("seed"), "entity", F.col("label").cast("int").alias("label"))
    return silhouettes(profiles, labels, straight).drop("k", "seed")


def rand_index(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings in one table."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    n = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cells = n.agg(two("n").alias("cells"), F.sum("n").alias("total"))
    rows = n.groupBy(a).agg(F.sum("n").alias("n")).agg(two("n").alias("row_pairs"))
    cols = n.groupBy(b).agg(F.sum("n").alias("n")).agg(two("n").alias("col_pairs"))
    expected = F.col("row_pairs") * F.col("col_pairs") / (F.col("total") * (F.col("total") - 1) / 2)
    return cells.crossJoin(rows).crossJoin(cols).select(F.col("total").alias("n"), safe_ratio(F.col("cells") - expected, (F.col("row_pairs") + F.col("col_pairs")) / 2 - expected).alias("ari"))


def transition(labels: DataFrame, a: str, b: str) -> DataFrame:
    """How classes of `a` pass into classes of `b`: size, purity, share of the two largest, normalised entropy."""
    n = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(a)
    r = n.select("*", (F.col("n") / F.sum("n").over(own)).alias("p"), F.row_number().over(own.orderBy(F.desc("n"), b)).alias("r"))
    classes = r.crossJoin(F.broadcast(labels.agg(F.count_distinct(b).alias("k"))))
    return classes.groupBy(a).agg(F.sum("n").alias("size"), F.max("p").alias("purity"), F.sum(F.when(F.col("r") <= 2, F.col("p"))).alias("two_child_share"), safe_ratio(-F.sum(F.col("p") * F.ln("p")), F.ln(F.max("k"))).alias("entropy"))


def best_run(runs: DataFrame, *gates: Column) -> DataFrame:
    """Of the fits that pass all gates and have at least the median silhouette, the one of least inertia, lowest seed on ties."""
    ok = runs
    for g in gates:
        ok = ok.filter(g)
    middle = ok.agg(F.percentile("silhouette", 0.5).alias("__m"))
    return ok.crossJoin(F.broadcast(middle)).filter(F.col("silhouette") >= F.col("__m")).orderBy("inertia", "seed").limit(1).drop("__m")


def best_assignment(cost: np.ndarray) -> list[int]:
    """The columns, one for each row, of least total cost; columns may be more than rows, not fewer.

    Rows come one after another, each by the cheapest alternating path to a free column (a shortest
    path under prices that keep all reduced costs above zero): a cube of the size in all.
    """
    rows, columns = cost.shape
    if rows > columns:
        raise ValueError("more rows than columns")
    row_price, column_price = np.zeros(rows), np.zeros(columns)
    row_of = np.full(columns, -1)
    for start in range(rows):
        distance, before, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        row, reached, column = start, 0.0, -1
        while True:
            way = reached + cost[row] - row_price[row] - column_price
            shorter = ~done & (way < distance)
            distance[shorter], before[shorter] = way[shorter], column
            open_ = np.where(done, np.inf, distance)
            column = int(open_.argmin())
            reached = open_[column]
            done[column] = True
            if row_of[column] < 0:
                break
            row = row_of[column]
        settled = done & (distance < reached)
        row_price[start] += reached
        row_price[row_of[settled]] += reached - distance[settled]
        column_price[settled] -= reached - distance[settled]
        while column >= 0:  # back along the path
            previous = before[column]
            row_of[column] = start if previous < 0 else row_of[previous]
            column = previous
    out = np.full(rows, -1)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out.tolist()


def matched_prototypes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(prototype, matched, distance): the one-to-one matching of two small sets of prototypes (prototype, shape) of least total clock distance."""
    names = [sorted(x.collect(), key=lambda r: r["prototype"]) for x in (a, b)]
    shapes = [np.array([r["shape"] for r in x], float) for x in names]
    cost = np.sqrt(((shapes[0][:, None] - shapes[1][None]) ** 2).mean(2))
    kinds = [x.schema["prototype"].dataType.simpleString() for x in (a, b)]
    rows = [(names[0][i]["prototype"], names[1][j]["prototype"], float(cost[i, j])) for i, j in enumerate(best_assignment(cost))]
    return a.sparkSession.createDataFrame(rows, f"prototype {kinds[0]}, matched {kinds[1]}, distance double")


def group_slot_summary(profiles: DataFrame, slot: str, value: str, group: str) -> DataFrame:
    """Median and interquartile range of a value per group and slot, and whether the median is a local maximum."""
    s = profiles.groupBy(group, slot).agg(F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.25).alias("q25"), F.percentile(value, 0.75).alias("q75"))
    w = Window.partitionBy(group).orderBy(slot)
    high = (F.col("median") >= F.coalesce(F.lag("median").over(w), F.col("median"))) & (F.col("median") >= F.coalesce(F.lead("median").over(w), F.col("median")))
    return s.select("*", (F.col("q75") - F.col("q25")).alias("iqr"), high.alias("local_maximum"))


def decision_gates(candidates: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Each candidate with a flag per gate and how many it passes; a gate that can't be told is not passed."""
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in gates.items()}
    return candidates.select("*", *(c.alias(n) for n, c in flags.items()), sum((c.cast("int") for c in flags.values()), F.lit(0)).alias("gates_passed"))
