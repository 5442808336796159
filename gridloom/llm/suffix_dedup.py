"""Removal of byte strings that occur more than once, by maximal repeats of an enhanced suffix array.

Anchored blocks (anchored.py) bring together all places where a window of the corpus may occur
again. Of blocks with equal anchors, equal ones repeat as a whole. For the different ones, at the
edges of copies, an enhanced suffix array is built over their contents: a stack scan over its
common-prefix lengths walks the interval tree and reports each interval of at least a window whose
occurrences have different left neighbours, with all its occurrences. These maximal repeats cover
exactly the windows that occur elsewhere.

Anchors that more than GROUP different blocks share (a line that a large part of all documents
has) are dealt out again by more and more of the bytes beside them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base, anchored

#: Bytes of a window and of an anchor; different blocks of an anchor that one suffix array takes; blocks of an array.
WINDOW, GRAM, GROUP, BLOCKS = 200, 32, 1000, 1500
U = np.uint64


class SuffixArray:
    """Enhanced suffix array of contents that stand apart: suffixes end with their content."""

    def __init__(self, contents: list, starts: list[int] | np.ndarray):
        """contents: bytes, or arrays of 64-bit elements. starts: how many suffixes from its begin on are taken of each content."""
        sizes = np.fromiter(map(len, contents), np.int64, len(contents))
        n = self.size = int(sizes.sum())
        self.begin = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(contents)), sizes)
        self.offset = np.arange(n) - self.begin[self.owner]
        self.room = sizes[self.owner] - self.offset
        if n and isinstance(contents[0], bytes):
            text = np.frombuffer(b"".join(contents) + bytes(8), np.uint8)
            self.left = np.where(self.offset > 0, text[np.arange(n) - 1].astype(np.int64), np.int64(-1))
            self.word = np.zeros(n, U)
            for i in range(8):
                self.word = (self.word << U(8)) | np.where(self.room > i, text[i : i + n], 0).astype(U)
            self.base, rank = 8, np.unique(self.word, return_inverse=True)[1].astype(np.int64)
        else:
            rank = np.unique(np.concatenate([np.zeros(0, np.int64), *contents]), return_inverse=True)[1].astype(np.int64)
            self.left = np.where(self.offset > 0, rank[np.arange(n) - 1], np.int64(-1))
            self.base = 1
        self.ranks: list[np.ndarray] = []
        length = self.base
        while length < (int(sizes.max()) if n else 0):
            self.ranks.append(rank)
            after = np.zeros(n, np.int64)
            inner = np.flatnonzero(self.room > length)
            after[inner] = rank[inner + length] + 1
            rank = np.unique((rank << 32) | after, return_inverse=True)[1].astype(np.int64)
            length *= 2
        self.ranks.append(rank)
        keep = np.flatnonzero(self.offset < np.asarray(starts)[self.owner]) if n else np.zeros(0, np.int64)
        self.sa = keep[np.argsort(rank[keep], kind="stable")]
        self.lcp = np.zeros(len(self.sa), np.int64)
        if len(self.sa) > 1:
            self.lcp[1:] = self.common(self.sa[:-1], self.sa[1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of pairs of suffixes."""
        got = np.zeros(len(a), np.int64)
        room = np.minimum(self.room[a], self.room[b])
        length = self.base << (len(self.ranks) - 1)
        for rank in reversed(self.ranks):
            on = np.flatnonzero(got < room)
            on = on[rank[a[on] + got[on]] == rank[b[on] + got[on]]]
            got[on] += length
            length //= 2
        if self.base > 1:
            on = np.flatnonzero(got < room)
            x = self.word[a[on] + got[on]] ^ self.word[b[on] + got[on]]
            for i in range(8):
                live = (x >> U(8 * (7 - i))) & U(255) == 0
                got[on[live]] += 1
                on, x = on[live], x[live]
        return np.minimum(got, room)


def maximal_repeats(array: SuffixArray, least: int):
    """(first, last, length) of the intervals of the suffix array whose suffixes share `length` >= least bytes and aren't all preceded by the same byte. A suffix at its content's begin has a left neighbour of its own."""
    lcp, left = array.lcp, array.left
    high = lcp >= least
    # Stretches of the array whose neighbours share `least` bytes: no interval leaves them.
    for lo, hi in anchored.runs_of(high):
        lo -= 1
        lefts = left[array.sa[lo:hi]].tolist()
        if hi - lo == 2:
            if lefts[0] != lefts[1] or lefts[0] < 0:
                yield lo, hi, int(lcp[lo + 1])
            continue
        depth = lcp[lo + 1 : hi].tolist()
        depth.append(0)
        stack: list[list[int]] = []  # length, first suffix, left neighbour (-1: they differ)
        for i, d in enumerate(depth):
            first, own = lo + i, lefts[i]
            while stack and stack[-1][0] > d:
                length, first, seen = stack.pop()
                seen = seen if seen == own else -1
                if seen < 0:
                    yield first, lo + i + 1, length
                own = seen
            if d:
                if stack and stack[-1][0] == d:
                    stack[-1][2] = own if own == stack[-1][2] else -1
                else:
                    stack.append([d, first, own])


def repeated_windows(contents: list[bytes], runs: list[int], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each content, the stretches of its first `run` windows that also start elsewhere in the contents."""
    array = SuffixArray(contents, runs)
    change = np.zeros(array.size + 1, np.int64)
    runs_ = np.asarray(runs)
    for first, last, length in maximal_repeats(array, window):
        at = array.sa[first:last]
        upto = np.minimum(array.offset[at] + length - window + 1, runs_[array.owner[at]]) - array.offset[at]
        np.add.at(change, at, 1)
        np.add.at(change, at + upto, -1)
    mask = np.cumsum(change)[:-1] > 0
    out, at = [], 0
    for c, n in zip(contents, runs):
        out.append(anchored.runs_of(mask[at : at + n]))
        at += len(c)
    return out


def _marks(window: int):
    """Pieces, sorted by key, to (h, c, begin, until): the windows that also start in another block."""

    @_base.tidy
    def run(batches):
        for _, h, c, _, _, _, at, runs, _, contents in anchored.by_group(batches, 10, BLOCKS):
            contents = [x[a : a + n + window - 1] for x, a, n in zip(contents, at, runs)]
            found = [{"h": x, "c": y, "begin": [a + s for s, _ in z], "until": [a + e for _, e in z]} for x, y, a, z in zip(h, c, at, repeated_windows(contents, runs, window)) if z]
            yield pa.RecordBatch.from_pylist(found, MARKS)

    return run


MARKS = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("begin", pa.list_(pa.int32())), ("until", pa.list_(pa.int32()))])
MARKS_SQL = "h long, c long, begin array<int>, until array<int>"


def _finished(window: int, id_col: str, keep: bool):
    @_base.tidy
    def run(batches):
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            ids, rows = batch.column(0), []
            for text, begin, until in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                spans = anchored.covered(np.array(begin or [], np.int64), np.array(until or [], np.int64) + window - 1)
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                rows.append((len(text), sum(e - s for s, e in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), (b"".join(kept) if spans else text) if keep else None))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def removed_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP, keep: bool = True, anchors: int = anchored.ANCHORS) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left; null if not asked for).

    Each byte that is covered by a string of `window` bytes which also starts anywhere else goes,
    judged on the input. Null texts count as empty. Equal rows are documents of their own, so their
    texts repeat each other. Equality is by a 128-bit hash where whole blocks are equal and by bytes
    elsewhere. Ids may be null and may repeat. Other columns are not read.
    """
    spark = docs.sparkSession
    _base.ready(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(_base.row_key(F.col(id_col), F.col(text_col)).alias("id"), F.col(id_col).alias("own"), _base.utf8(F.col(text_col)).alias("text"))
    narrow = texts.select("id", "text").filter(F.length("text") >= window)
    counted = narrow.select(F.lit(0).cast("byte").alias("id"), "text").mapInArrow(anchored.first_scan(anchored.byte_elements, window, gram), "id byte, h long, c long")
    stats = counted.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).filter("n > 1")
    stats = _base.spill(stats.select("h", (F.col("low") < F.col("high")).alias("several")), "anchors")
    found, each = anchored.repeated_blocks(narrow, stats, anchored.byte_elements, window, gram, "binary", [F.count(F.lit(1)).alias("n")], anchors)
    rows = found.drop("anchor").join(stats, "h")
    rows = _base.spill(rows, "repeats")
    spans = rows.filter("not several").select("id", F.array("start").alias("begin"), F.array(F.col("start") + F.col("run")).alias("until"))
    marks = anchored.dealt(
        each.withColumn("first", F.col("c")), window, gram, group,
        lambda few: few.mapInArrow(_marks(window), MARKS_SQL),
        lambda known: known.filter("n > 1").select("h", "c", F.array("at").alias("begin"), F.array(F.col("at") + F.col("run")).alias("until")),
    )
    whole = each.filter("n > 1").select("h", "c", F.array(F.lit(0)).alias("begin"), F.array("run").alias("until"))
    marks = whole.union(marks).groupBy("h", "c").agg(*(F.flatten(F.collect_list(x)).alias(x) for x in ("begin", "until")))
    marks = _base.spill(marks, "marks")
    edges = rows.filter("several").join(marks, ["h", "c"]).select("id", *(F.transform(x, lambda y: y + F.col("start")).alias(x) for x in ("begin", "until")))
    spans = spans.union(edges).groupBy("id").agg(*(F.flatten(F.collect_list(x)).alias(x) for x in ("begin", "until")))
    spans = _base.spill(spans, "spans")
    _base.forget(stats, found, rows, each, marks)
    out = texts.join(spans, "id", "left").select("own", "text", "begin", "until")
    return out.mapInArrow(_finished(window, id_col, keep), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM t WHERE len(h) >= 400
), windows AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM starts
), again AS (
  SELECT s FROM windows GROUP BY s HAVING count(*) > 1
), hits AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM windows WHERE s IN (SELECT s FROM again)
), numbered AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hits
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, k
), gaps AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM spans
), kept AS (
  SELECT g.doc_id, string_agg(substr(t.h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS removed, count(*) AS n FROM gaps g JOIN t ON t.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return removed_repeats(_base.table(spark, sf_dir, "documents"), keep=False).drop("kept")
