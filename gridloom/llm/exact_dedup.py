"""Exact duplicates by digest, with heavy digests split off.

Misra-Gries summaries find the digests that may be frequent. Their exact counts and
winners are then verified over all rows and broadcast, so that the rows of a frequent
text are decided where they are read and are never shuffled. The digests that are left
have few rows each and take an ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base

#: Counters of a summary; also the largest number of broadcast rows. A text with more than 2/COUNTERS of all rows is surely among them.
COUNTERS = 1024


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _base.WS, " ")


def pruned(counts: dict, k: int) -> dict:
    """A Misra-Gries summary of at most k counters: the (k+1)-th largest count is taken off all."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {x: c - cut for x, c in counts.items() if c > cut}


def _summaries(k: int):
    @_base.tidy
    def run(batches):
        counts: dict = {}
        for batch in batches:
            found = Counter(counts)
            found.update(batch.column(0).to_pylist())
            counts = pruned(found, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "least"])

    return run


def frequent(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """At most k values of column digest, with every one that more than 2/k of the rows have."""
    parts = digests.select("digest").mapInArrow(_summaries(k), "digest binary, least long")
    return parts.groupBy("digest").agg(F.sum("least").alias("least")).orderBy(F.desc("least"), "digest").limit(k).select("digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty texts are one group. The smallest id of a group
    stays; rows that repeat this id share its decision. Null ids are larger than all others: they
    stay only where a group has no other id. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    _base.ready(spark)
    digests = _base.spill(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest")), "digests")
    candidates = _base.spill(frequent(digests, k), "frequent")
    winners = _base.spill(
        digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1"), "winners"
    )
    split = digests.join(F.broadcast(winners), "digest", "left")
    rest = split.filter("n is null").select("id", "digest")
    # Partial sums first: a text's rows never meet in one task.
    least = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    both = split.filter("n is not null").select("id", "digest", "n", "first").unionByName(rest.join(least, "digest").select("id", "digest", "n", "first"))
    return both.select(
        F.col("id").alias(id_col), F.col("first").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("first")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """docs with one row of each group of exact_groups(): that of the smallest id; all columns stay.

    Null texts count as empty. A group all of whose ids are null keeps one row; of rows that repeat
    id and text, or id and a text that differs in white space alone, one stays.
    """
    found = exact_groups(docs, id_col, text_col, k)
    found = _base.spill(found.filter("group_size > 1").select(F.col(id_col).alias("id"), F.xxhash64("text_sha256").alias("mark"), F.unhex("text_sha256").alias("grp")), "members")
    return _base.one_of_each(docs, found, id_col, F.xxhash64(F.sha2(normalised(docs[text_col]).cast("binary"), 256)))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(_base.table(spark, sf_dir, "documents"))
