"""Document fingerprints by SimHash, in DataFrame operations only.

Each word votes with its weight (longer words say more) for the set bits of its hash. Votes for two
bits, 32 apart, are packed into one number, so that 32 sums count all 64. A document's text and its
edited text are split and summed in the partition that holds them: neither is shuffled for it.

Fingerprints within a Hamming radius are found by permuted block tables: with BLOCKS blocks of the
64 bits, two that differ in at most r bits agree in some BLOCKS - r blocks, so that each choice of
such blocks is a table, joined on their bits.
"""

from __future__ import annotations

import os
from collections import Counter
from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _base

#: Bits that may differ, blocks of the tables; rows whose id this divides are searched for; ranges of ids for each shuffle partition.
RADIUS, BLOCKS, SEARCHED, RANGES = 3, 6, 20, 8
_LANES = (1 << 32) | 1


def words(text: Column) -> Column:
    """Words between single spaces, other white space taken as space; empty ones have no weight."""
    return F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")


def weight(word: Column) -> Column:
    """0 for empty words, 1 for words of up to 3 characters, up to 8 for long ones."""
    n = F.length(word)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.least(n, F.lit(10)) - 2)).cast("long")


def votes(h: Column, w: Column) -> list[Column]:
    return [F.sum((F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES))) * w).alias(f"v{k}") for k in range(32)]


def fingerprint() -> Column:
    """A bit is set if more than half of the weight votes for it."""
    out = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"v{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{k}", 32)
        for bit, sum_ in ((k, low), (k + 32, high)):
            mask = 1 << bit
            out = out.bitwiseOR(F.when(sum_ * 2 > F.col("total"), F.lit(mask - (1 << 64) if bit == 63 else mask)).otherwise(F.lit(0).cast("long")))
    return out


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def _position(docs: DataFrame, id_col: str) -> Column:
    """A number that grows with the id: numbers themselves, of other types six bytes of their text, behind those that all ids begin with."""
    ident, kind = F.col(id_col), docs.schema[id_col].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return ident.cast("double")
    text = ident.cast("string")
    ends = docs.agg(F.min(text), F.max(text)).first()
    same = len(os.path.commonprefix([(e or "").encode() for e in ends]))
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), same + 1, 6)), 12, "0"), 16, 10).cast("double")


def _numbers(values: list) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>") if values else F.array().cast("array<double>")


def _part(docs: DataFrame, id_col: str, tie: Column) -> Column:
    """The range of ids that a row is in: RANGES for each shuffle partition, of about as many rows each.

    Where one id has more than a range's rows, and for null ids, ranges go on by `tie`, a number
    from 0 to 1 that orders rows of equal ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ident = F.col(id_col)
    at = _position(docs, id_col)
    n = RANGES * max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = docs.select(at.alias("p")).filter("p is not null").approxQuantile("p", [i / n for i in range(1, n)], 1 / (4 * n))
    many, nulls = Counter(found), docs.filter(ident.isNull()).count()
    bounds = sorted(many)
    # An id alone has this position if it is a whole number that doubles tell apart.
    exact = kind in ("tinyint", "smallint", "int", "bigint")
    heavy = [many[b] if exact and many[b] > 1 and abs(b) < 2**53 else 0 for b in bounds]
    base = list(accumulate((1 + h for h in heavy), initial=0))
    # Two steps: the block of bounds, then the place in it.
    step = max(1, int(len(bounds) ** 0.5))
    block = F.size(F.filter(_numbers(bounds[step - 1 :: step]), lambda b: b < at))
    below = block * step + F.size(F.filter(F.slice(_numbers(bounds), block * step + 1, F.lit(step)), lambda b: b < at))
    here = F.when(F.get(_numbers(bounds), below) == at, F.get(_numbers(heavy), below)).otherwise(0.0)
    spread = F.when(here > 0, 1 + F.floor(tie * here)).otherwise(0)
    late = len(bounds) + sum(heavy) + 1
    each = max(1, docs.count() // n)
    return F.when(ident.isNull(), late + F.floor(tie * (nulls // each + 1))).otherwise(F.get(_numbers(base), below) + F.coalesce(spread, F.lit(0))).cast("long")


def with_next(rows: DataFrame, order: list[Column], columns: dict[str, str]) -> DataFrame:
    """rows with columns of the row that follows in `order` under new names, first after last; column part holds ranges in order."""
    own = Window.partitionBy("part").orderBy(*order)
    firsts = rows.select("part", *columns, F.row_number().over(own).alias("__n")).filter("__n = 1")
    # One row for each range.
    heads = _base.spill(firsts.select("part", F.struct(*columns).alias("__after")), "heads")
    # Numbers of ranges alone: the next one, the first after the last.
    whole = Window.orderBy("part")
    after = heads.select("part").select("part", F.coalesce(F.lead("part").over(whole), F.min("part").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    ring = _base.spill(after.join(heads.withColumnRenamed("part", "next"), "next").select("part", "__after"), "ring")
    _base.forget(heads)
    led = rows.select("*", F.lead(F.struct(*columns)).over(own).alias("__lead"), F.row_number().over(own).alias("nth"))
    both = led.join(ring, "part")
    found = F.coalesce("__lead", "__after")
    return both.select("*", *(found[c].alias(n) for c, n in columns.items())).drop("__lead", "__after")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within.

    The edited text has the first half of the text and as many characters of the next document's
    begin as the other half has. Null texts count as empty; texts without words have fingerprint 0.
    Null ids come last, equal ids in the order of the 64-bit hashes (without the last bit) of their
    texts. n_within is a search by block tables: for rows whose id is a number divisible by SEARCHED,
    how many other rows have a fingerprint within `radius` bits; 0 for all other rows. Other columns
    are not read.
    """
    ident, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.shiftrightunsigned(F.xxhash64(text), 1)
    rows = docs.select(ident.alias("id"), text.alias("text"), hashed.alias("tie"), _part(docs, id_col, hashed / F.lit(float(1 << 63))).alias("part"))
    order = [F.col("id").asc_nulls_last(), F.col("tie"), F.col("text")]
    led = with_next(rows, order, {"text": "following"})
    half = F.floor(F.length("text") / 2).cast("int")
    pair = led.select("part", "nth", "id", F.length("text").cast("long").alias("n_chars"), "text", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("following", F.lit(1), half)).alias("edited"))
    both = pair.select("part", "nth", "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("e"))
    terms = both.select("part", "nth", "id", "n_chars", "edited_sha256", "e.which", F.explode(words(F.col("e.t"))).alias("word"))
    terms = terms.select("part", "nth", "id", "n_chars", "edited_sha256", "which", F.xxhash64("word").alias("h"), weight(F.col("word")).alias("w"))
    sums = terms.groupBy("part", "nth", "id", "n_chars", "edited_sha256", "which").agg(F.sum("w").alias("total"), *votes(F.col("h"), F.col("w")))
    prints = sums.select("part", "nth", "id", "n_chars", "edited_sha256", "which", fingerprint().alias("fp"))
    joined = prints.groupBy("part", "nth", "id", "n_chars", "edited_sha256").agg(*(F.max(F.when(F.col("which") == k, F.col("fp"))).alias(c) for k, c in enumerate(("own", "changed"))))
    joined = _base.spill(joined.withColumnRenamed("nth", "at"), "fingerprints")
    numeric = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    searched = F.coalesce(F.col("id") % SEARCHED == 0, F.lit(False)) if numeric else F.lit(False)
    counts = _base.spill(n_within(joined.select(F.col("own").alias("fp"), searched.alias("searched")), radius), "within")
    out = with_next(joined, [F.col("at")], {"own": "next_own"}).withColumn("searched", searched).join(counts, F.col("own") == counts["query"], "left")
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", _hex(F.col("own")).alias("fingerprint"), _hex(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        F.when(F.col("searched"), F.coalesce("found", F.lit(1)) - 1).otherwise(F.lit(0)).cast("long").alias("n_within"),
    )


def masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The bits of each table: all choices of blocks - radius blocks of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(one, blocks - radius)]


def within(queries: DataFrame, values: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, distance), once for each two, for the distinct values of column fp of both that differ in at most `radius` bits; for a stated set of queries."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius, blocks)]

    def table(df: DataFrame, name: str) -> DataFrame:
        keys = F.explode(F.array(*(F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed))))
        return df.select("fp").distinct().select(F.col("fp").alias(name), keys.alias("k")).select(name, "k.*")

    differ = F.col("query").bitwiseXOR(F.col("fp"))
    # The first of the tables in which the two meet.
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(signed)))
    distance = F.bit_count(differ)
    a, b = table(queries, "query").alias("a"), table(values, "fp").alias("b")
    # Neither side has a bound, and a table has many rows for each value: none is broadcast.
    met = a.hint("merge").join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & (distance <= radius) & (first == F.col("a.table")))
    return met.select("query", "fp", distance.alias("distance"))


def n_within(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, found): for each fingerprint of (fp, searched) that is searched, the number of rows within `radius` bits, its own among them."""
    sizes = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max("searched").alias("searched"))
    sizes = _base.spill(sizes, "sizes")
    pairs = within(sizes.filter("searched"), sizes, radius, blocks)
    return pairs.join(sizes.select("fp", "n"), "fp").groupBy("query").agg(F.sum("n").alias("found"))


def op7_simhash_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_base.table(spark, sf_dir, "documents"))
