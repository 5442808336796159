"""Removal of word passages that an earlier document has, by relative Lempel-Ziv parsing.

Anchored blocks (anchored.py) bring together all places where a passage may occur again. A block
that a document of smaller id has too goes as a whole. Where different blocks share an anchor, at
the edges of a passage, each is parsed against all reference blocks of smaller ids: an index of
all blocks gives for each place the longest match with a reference, the parse takes factors
greedily from left to right, and factors of at least a window become duplicate spans. Windows
that reach over the end of a factor are looked up on their own, as another reference may have them.

Anchors that more than GROUP different blocks share are dealt out again by more and more of the words beside
them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base, anchored
from gridloom.llm.suffix_dedup import MARKS, MARKS_SQL, SuffixArray

#: Words of a window and of an anchor; different blocks of an anchor that one index takes; blocks of an index.
WINDOW, GRAM, GROUP, BLOCKS = 50, 10, 1000, 3000


def longest_matches(array: SuffixArray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place, the length of its longest match with a content of strictly smaller order; 0 below `least`.

    The longest match of a suffix is with the nearest suffix of smaller order before or after it in the array.
    """
    out = np.zeros(array.size, np.int64)
    key = order[array.owner[array.sa]]
    bounds = [(lo - 1, hi) for lo, hi in anchored.runs_of(array.lcp >= least)]
    pairs = np.array([lo for lo, hi in bounds if hi - lo == 2], np.int64)
    for mine, other in ((pairs, pairs + 1), (pairs + 1, pairs)):
        on = np.flatnonzero(key[other] < key[mine])
        out[array.sa[mine[on]]] = array.lcp[pairs[on] + 1]
    for lo, hi in bounds:
        if hi - lo == 2:
            continue
        keys, lcp = key[lo:hi].tolist(), array.lcp[lo:hi].tolist()
        best = [0] * (hi - lo)
        for way in (range(hi - lo), range(hi - lo - 1, -1, -1)):
            stack: list[list[int]] = []
            before = None
            for i in way:
                if before is not None:
                    stack[-1][1] = min(stack[-1][1], lcp[max(i, before)])
                while stack and stack[-1][0] >= keys[i]:
                    shared = stack.pop()[1]
                    if stack:
                        stack[-1][1] = min(stack[-1][1], shared)
                if stack:
                    best[i] = max(best[i], stack[-1][1])
                stack.append([keys[i], 1 << 60])
                before = i
        out[array.sa[lo:hi]] = best
    return out


def parse(match: np.ndarray, runs: int, window: int) -> list[tuple[int, int]]:
    """Greedy factors of one content from its longest matches; the stretches of windows that references have.

    A place without a long match is a factor of its own.
    """
    have = np.zeros(runs, bool)
    at = 0
    long = np.flatnonzero(match[:runs] >= window)
    while len(long) and at <= long[-1]:
        at = int(long[np.searchsorted(long, at)])
        end = at + int(match[at])
        have[at : min(end - window + 1, runs)] = True
        over = np.arange(max(at, end - window + 1), min(end, runs))  # windows that start in the factor and reach over its end
        have[over] |= match[over] >= window
        at = end
    return anchored.runs_of(have)


def parsed(contents: list, runs: list[int], order: list[int], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each content, the stretches of its first `run` windows that a content of smaller order has."""
    array = SuffixArray(contents, runs)
    match = longest_matches(array, np.asarray(order), window)
    return [parse(match[b : b + n], n, window) for b, n in zip(array.begin.tolist(), runs)]


def _marks(window: int):
    """Pieces, sorted by key, to (h, c, begin, until): the windows that a block of smaller `first` has."""

    @_base.tidy
    def run(batches):
        for _, h, c, _, _, _, at, runs, first, contents in anchored.by_group(batches, 10, BLOCKS):
            contents = [np.asarray(x[a : a + n + window - 1], np.int64) for x, a, n in zip(contents, at, runs)]
            found = [{"h": x, "c": y, "begin": [a + s for s, _ in z], "until": [a + e for _, e in z]} for x, y, a, z in zip(h, c, at, parsed(contents, runs, first, window)) if z]
            yield pa.RecordBatch.from_pylist(found, MARKS)

    return run


def _finished(window: int, id_col: str):
    @_base.tidy
    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), []
            for text, begin, until in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words = text.split()
                spans = anchored.covered(np.array(begin or [], np.int64), np.array(until or [], np.int64) + window - 1)
                kept, at = [], 0
                for s, e in spans:
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                left = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if spans else None))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string())))], [id_col, "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def spans(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, group: int, anchors: int = anchored.ANCHORS) -> DataFrame:
    """(id: a row's key, begin, until): the stretches of windows of each row that a row of smaller id has."""
    words = docs.filter(F.col(id_col).isNotNull()).select(F.struct(_base.row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("doc")).alias("id"), _base.utf8(F.col(text_col)).alias("text")).filter(F.length("text") >= 2 * window - 1)
    doc = docs.schema[id_col].dataType.simpleString()
    counted = words.select(F.col("id.doc").alias("id"), "text").mapInArrow(anchored.first_scan(anchored.word_elements, window, gram), f"id {doc}, h long, c long")
    stats = counted.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("c").alias("low"), F.max("c").alias("high")).filter(F.col("least") < F.col("most"))
    stats = _base.spill(stats.select("h", "least", (F.col("low") < F.col("high")).alias("several")), "anchors")
    found, each = anchored.repeated_blocks(words, stats, anchored.word_elements, window, gram, "array<long>", [F.min("id.doc").alias("first")], anchors)
    found = found.select("id.*", "start", "run", "h", "c")
    rows = _base.spill(found.join(stats, "h").filter(F.col("several") | (F.col("doc") > F.col("least"))), "repeats")
    out = rows.filter("not several").select("key", F.array("start").alias("begin"), F.array(F.col("start") + F.col("run")).alias("until"))
    marks = anchored.dealt(
        each, window, gram, group,
        lambda few: few.mapInArrow(_marks(window), MARKS_SQL),
        lambda known: known.filter(F.col("least") < F.col("first")).select("h", "c", F.array("at").alias("begin"), F.array(F.col("at") + F.col("run")).alias("until")),
    )
    marks = _base.spill(marks.groupBy("h", "c").agg(*(F.flatten(F.collect_list(x)).alias(x) for x in ("begin", "until"))), "marks")
    firsts = _base.spill(each.select("h", "c", "first").join(marks, ["h", "c"], "left"), "firsts")
    late = F.col("doc") > F.col("first")
    edges = rows.filter("several").join(firsts, ["h", "c"]).select(
        "key",
        *(F.when(late, F.array(whole)).otherwise(F.transform(x, lambda y: y + F.col("start"))).alias(x) for x, whole in (("begin", F.col("start")), ("until", F.col("start") + F.col("run")))),
    )
    out = out.union(edges.filter("begin is not null")).groupBy("key").agg(*(F.flatten(F.collect_list(x)).alias(x) for x in ("begin", "until")))
    out = _base.spill(out, "spans")
    _base.forget(stats, found, rows, each, marks, firsts)
    return out


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP, anchors: int = anchored.ANCHORS) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256, kept. Other columns are not read.

    kept is the text without the words that a window of `window` words covers which also starts in a
    row of smaller id, words joined by one space; null where nothing is removed. Null texts have no
    words. Rows of equal id don't remove each other's words; rows without an id neither lose words
    nor make others lose any. Words are compared by 64-bit hashes, `window` of them in a row.
    """
    _base.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = spans(docs, id_col, text_col, window, gram, group, anchors).withColumnRenamed("key", "__key")
    texts = docs.select(F.col(id_col).alias("__id"), _base.row_key(F.col(id_col), F.col(text_col)).alias("__key"), _base.utf8(F.col(text_col)).alias("__text"))
    return texts.join(found, "__key", "left").select("__id", "__text", "begin", "until").mapInArrow(_finished(window, id_col), f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """docs with the words that removed_passages() removes taken out of the text, which is then joined by single spaces; all columns stay.

    Texts without such words stay as they are, null and empty ones too; rows of which nothing is left
    go. Rows that repeat an id don't remove each other's words, rows without an id lose none.
    """
    _base.ready(docs.sparkSession)
    key, begin, until = (_base.free(docs, x) for x in ("key", "begin", "until"))
    found = spans(docs, id_col, text_col, window, gram, group).withColumnsRenamed({"key": key, "begin": begin, "until": until})
    place, n = docs.columns.index(text_col), len(docs.columns)
    finish = _finished(window, "id")

    @_base.tidy
    def run(batches):
        for batch in batches:
            text = batch.column(place).cast(pa.binary())
            hit = batch.column(n).is_valid()
            rest = batch.filter(pa.compute.invert(hit))
            if rest.num_rows:
                yield rest.select(range(n))
            part = batch.filter(hit)
            if part.num_rows:
                done = next(finish([pa.RecordBatch.from_arrays([pa.nulls(part.num_rows), text.filter(hit), part.column(n), part.column(n + 1)], ["id", "t", "b", "u"])]))
                left = done.column("n_words").to_numpy() > done.column("n_removed").to_numpy()
                cols = [done.column("kept") if i == place else part.column(i) for i in range(n)]
                yield pa.RecordBatch.from_arrays(cols, schema=rest.select(range(n)).schema).filter(pa.array(left))

    keyed = docs.withColumn(key, _base.row_key(docs[id_col], docs[text_col])).join(found, key, "left").select(*docs.columns, begin, until)
    return keyed.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), starts AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50
), windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS s FROM starts
), firsts AS (
  SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s
), late AS (
  SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE first_id < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM late
), lost AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id
), places AS (
  SELECT w.doc_id, w.ws, coalesce(l.n, 0) AS n_removed, l.ps FROM w LEFT JOIN lost l USING (doc_id)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM places
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id
)
SELECT places.doc_id, len(ws) AS n_words, n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM places LEFT JOIN kept ON kept.doc_id = places.doc_id
"""


def op10_rlz_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removed_passages(_base.table(spark, sf_dir, "documents")).drop("kept")
