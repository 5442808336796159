"""How far the sources of a language differ in their terms, and which terms make them differ.

Relations throughout: regexp matches are exploded and counted, groups cross the kept vocabulary of
their language so that terms they never use count as zeros, and a self-join on language and term
compares sources. All arithmetic is over integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _base

#: Letters and all that is not ASCII, after A-Z have become lower case.
TERM = r"[a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a term needs to be kept, ranks of terms that are reported.
LEAST, TOP = 10, 10
#: Whole of a probability, and what is added to each count.
UNIT, PRIOR = 1_000_000_000, 2
#: Parts of a language's vocabulary when groups cross it: no task gets a whole language.
SALTS = 64


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (count + PRIOR) / (total + PRIOR kept)), exact for counts beyond 2^63 / UNIT too."""
    wide = (count + PRIOR).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return 1 + F.call_function("div", wide, (total + PRIOR * kept).cast("decimal(19,0)"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))"""
    return F.call_function("div", (p - q) * (p - q), p + q)


def counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs) with one row of a null term for groups that have documents without terms.

    A document's terms and, behind them, its distinct ones are exploded once: places beyond the first count documents.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    matched = docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), F.regexp_extract_all(F.translate(filled(text_col), UPPER, LOWER), F.lit(TERM), F.lit(0)).alias("terms"))
    each = matched.select("lang", "source", F.size("terms").alias("until"), F.concat("terms", F.array_distinct("terms")).alias("terms")).select("lang", "source", "until", F.posexplode_outer("terms").alias("at", "term"))
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("at") < F.col("until")).alias("n"), F.count_if(F.col("at") >= F.col("until")).alias("docs"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """For each (lang, source): how far each other source of its language is from it (part `pair`), and its `top` terms that the language has less of (part `term`).

    Null texts, languages and sources count as empty; every row is a document. A term is kept in a
    language that has it in at least `least` documents. Groups without terms have zeros for all kept
    terms; where a language keeps none, pairs have the value 0. Sources alone in a language have no
    pairs. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    found = _base.spill(counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = _base.spill(found.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).filter(F.col("docs") >= least).drop("docs"), "kept-terms")
    own = _base.spill(found.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "kept-counts")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_total"))
    groups = found.select("lang", "source").distinct().join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = _base.spill(groups.fillna(0), "groups")

    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS))
    crossed = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).join(kept.withColumn("salt", salt), ["lang", "salt"])
    dense = crossed.join(own, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    dense = dense.select("lang", "source", "term", "n", probability(F.col("n"), F.col("total"), F.col("v")).alias("p"), probability(F.col("in_lang"), F.col("lang_total"), F.col("v")).alias("q"))
    dense = _base.spill(dense, "dense-terms")

    one, two = (dense.select("lang", "term", F.col("source").alias(f"source_{t}"), F.col("p").alias(f"p_{t}")) for t in "ab")
    apart = one.join(two, ["lang", "term"]).filter("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(divergence(F.col("p_a"), F.col("p_b"))).alias("value"))
    names = groups.select("lang", "source")
    every = names.toDF("lang", "source_a").join(names.toDF("lang", "source_b"), "lang").filter("source_a < source_b").join(apart, ["lang", "source_a", "source_b"], "left").fillna(0, "value")
    both = F.explode(F.array(*(F.struct(F.col(f"source_{a}").alias("source"), F.col(f"source_{b}").alias("item")) for a, b in ("ab", "ba"))))
    pairs = every.select("lang", both.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    terms = dense.filter("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).filter(F.col("rank") <= top))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), w AS (
  SELECT row, lang, source, unnest(ts) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS in_lang FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d
), v AS (
  SELECT lang, count(*) AS v, sum(in_lang) AS lang_total FROM kept GROUP BY lang
), dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 2)) // (g.total + 2 * v.v)::HUGEINT AS p,
    1 + (1000000000 * (kept.in_lang::HUGEINT + 2)) // (v.lang_total + 2 * v.v)::HUGEINT AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM dense x JOIN dense y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM dense WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def op13_source_divergence_audit(spark, sf_dir: str) -> DataFrame:
    return audit(_base.table(spark, sf_dir, "documents"))
