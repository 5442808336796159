"""What each filter of a chain removes, in every order of the chain.

Documents are counted by the set of filters that they fail. A chain that has applied some filters
and comes to the next one is an edge of the lattice of subsets; every document contributes to each
of the k 2^(k-1) edges. Every order is a path through the lattice, so its k steps are a join of
aggregated edges, and no order is ever run over the documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _base

#: Failure conditions over measured(): few words, repetitive words, capitals, markup signs.
TESTS: Mapping[str, str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "has_sign",
}
#: The filter of documents whose text a smaller id has.
COPIES = "E"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def measured(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, digest, n_words, n_distinct, n_capitals, n_chars, has_sign) of each row."""
    text = F.col("text")
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = read.select("id", "part", "text", F.array_remove(F.split("text", _base.WS), "").alias("words"))
    return words.select(
        "id",
        "part",
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
        F.length("text").cast("long").alias("n_chars"),
        text.rlike("[#$%&*|]").alias("has_sign"),
    )


def failures(docs: DataFrame, labels: DataFrame, tests: Mapping[str, str], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Documents counted by (part, fails, good, toxic): fails has a bit for each filter of tests, in their order, and a last one for copies.

    Rows that repeat id and text become one before they meet their labels; the rows of a text are
    merged by (text, part, labels) before its smallest id is looked for, so that no task gets a
    row for each copy.
    """
    bits = sum((F.expr(c).cast("int") * (1 << i) for i, c in enumerate(tests.values())), F.lit(0))
    kind = docs.schema[id_col].dataType
    once = measured(docs, id_col, text_col, part_col).select("id", "part", "digest", bits.alias("fails")).groupBy("id", "part", "digest", "fails").agg(F.count(F.lit(1)).alias("n"))
    # Rows without an id meet no label; their digests deal them out.
    known = labels.select(F.col(id_col).alias("__id"), "quality", "toxic").filter("__id is not null").groupBy("__id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("bad"))
    known = known.withColumns({"__alone": F.lit(0).cast("long"), "__none": F.lit(False)})
    once = once.withColumns({"__none": F.col("id").isNull(), "__alone": F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0), "__id": F.coalesce("id", F.lit(0).cast(kind))})
    flagged = once.join(known, ["__none", "__alone", "__id"], "left").select("id", "part", "digest", "fails", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("toxic"))
    # A pair of id and text is one row here unless its part differs, so the rows at the least id are those of one row.
    merged = flagged.groupBy("digest", "part", "fails", "good", "toxic").agg(F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    least = F.min("first").over(Window.partitionBy("digest"))
    stays = F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    told = merged.withColumn("least", least).select("part", "good", "toxic", F.explode(F.array(F.struct("fails", stays.alias("n")), F.struct((F.col("fails") + (1 << len(tests))).alias("fails"), (F.col("n") - stays).alias("n")))).alias("f"))
    return told.groupBy("part", "good", "toxic", "f.fails").agg(F.sum("f.n").alias("n")).filter("n > 0")


def edges(counted: DataFrame, filters: int) -> DataFrame:
    """The measures of each (part, before, bit): `before` are the filters already applied, `bit` is the next one; zeros included."""
    pairs = [(before, 1 << i) for before in range(1 << filters) for i in range(filters) if not before >> i & 1]
    spread = counted.select("*", F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(t).alias("bit")) for b, t in pairs))).alias("edge")).select("*", "edge.before", "edge.bit")
    alive, failing = F.col("fails").bitwiseAND(F.col("before")) == 0, F.col("fails").bitwiseAND(F.col("bit")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return spread.groupBy("part", "before", "bit").agg(
        total(alive & ~failing).alias("kept"),
        total(alive & failing).alias("removed"),
        total(~alive & failing).alias("redundant"),
        total(F.col("fails") == F.col("bit")).alias("unique_fails"),
        total(alive & failing & F.col("good")).alias("good_lost"),
        total(alive & failing & F.col("toxic")).alias("toxic_lost"),
    )


def paths(spark, letters: str) -> DataFrame:
    """The k! k steps (filter_order, step, before, bit) of all orders of k filters."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    rows = [("".join(order), i + 1, sum(bit[c] for c in order[:i]), bit[c]) for order in permutations(letters) for i, c in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, bit int")


def audit(docs: DataFrame, labels: DataFrame, tests: Mapping[str, str] = TESTS, copies: str = COPIES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: what the filter of this step keeps and removes, and its Shapley sum.

    Filters are the tests and the one of copies. Null texts and parts count as empty; an empty
    table has no parts. A row without an id is no copy and makes none, and has no labels. Rows
    that repeat an id count each; of equal texts at the smallest id none is a copy. A document is
    good or toxic if any of its labels says so (quality 1, toxic 1); null labels say nothing.
    Other columns are not read.
    """
    k = len(tests) + 1
    found = edges(failures(docs, labels, tests, id_col, text_col, part_col), k)
    size = F.bit_count("before")
    orders = F.element_at(F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k))), size + 1)
    # A part has few edges: k 2^(k-1).
    valued = found.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "bit")))
    steps = paths(docs.sparkSession, "".join(tests) + copies)
    return valued.join(F.broadcast(steps), ["before", "bit"]).select("part", "filter_order", "step", *MEASURES, "shapley")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first_id FROM d GROUP BY t
), known AS (
  SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS bad FROM labels GROUP BY doc_id
), f AS (
  SELECT d.part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN firsts USING (t) LEFT JOIN known USING (doc_id)
), c AS (
  SELECT part, good, bad, fails, count(*) AS n FROM f GROUP BY ALL
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), s AS (
  SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, 1, step - 1) AS before, substr(filter_order, step, 1) AS filter FROM o, unnest(range(1, 6)) AS r(step)
), m AS (
  SELECT part, filter_order, step, filter, n, good, bad, fails = filter AS alone, contains(fails, filter) AS failing, length(translate(fails, before, '')) = length(fails) AS alive FROM c, s
), g AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (alive AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (alive AND failing), 0) AS removed, coalesce(sum(n) FILTER (failing AND NOT alive), 0) AS redundant,
    coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(n) FILTER (alive AND failing AND good), 0) AS good_lost, coalesce(sum(n) FILTER (alive AND failing AND bad), 0) AS toxic_lost
  FROM m GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM g
"""


def op11_filter_interaction_audit(spark, sf_dir: str) -> DataFrame:
    return audit(_base.table(spark, sf_dir, "documents"), _base.table(spark, sf_dir, "labels"))
