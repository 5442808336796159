"""Anchored blocks: how long repeats of a corpus are brought together without comparing all documents.

A window is `window` consecutive elements (bytes or words). Its anchor is its leftmost k-gram of
smallest hash, so equal windows have equal anchors at equal places. Consecutive windows with the
same anchor make a block: `run` windows, run + window - 1 elements. Blocks of equal content have
equal anchor hash h and content hash c (128 bits together), and windows of different blocks can
only be equal where h is. There is about one block for each window/2 elements.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base, hashing

U = np.uint64
#: Elements that are handled together; longer documents are cut into stretches that overlap by window - 1.
STRETCH = 1 << 19
_B = U(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = U(pow(int(_B), -1, 1 << 64))
        return tuple(np.cumprod(np.concatenate([[U(1)], np.full(n, b, U)]), dtype=U) for b in (_B, inverse))


def kgram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all runs of k values."""
    with np.errstate(over="ignore"):
        h, have = None, 0
        part, n, p = values * U(0xD6E8FEB86659FD93) + U(1), 1, _B
        bits = k
        while bits:
            if bits & 1:
                h = part if h is None else _append(h, have, part, p)
                have += n
            bits >>= 1
            if bits:
                part, n, p = part[:-n] * p + part[n:], 2 * n, p * p
        return hashing.mix(h)


def _append(h, have, part, p):
    """Hashes of have + n values from those of have values and of n values."""
    m = min(len(h), len(part) - have)
    return h[:m] * p + part[have : have + m]


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each `width` consecutive hashes (by their first 44 bits)."""
    key = (h & ~U((1 << 20) - 1)) | np.arange(len(h), dtype=U)
    n = 1
    while 2 * n <= width:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    if n < width:
        key = np.minimum(key[: len(key) - (width - n)], key[width - n :])
    return (key & U((1 << 20) - 1)).astype(np.int64)


def blocks(values: np.ndarray, sizes: np.ndarray, window: int, k: int):
    """Blocks of documents that stand one after another in values: document, start in it, run, h, c, place of the anchor in the block."""
    ends = np.cumsum(sizes)
    out = []
    # Stretches: whole documents while they fit; a longer document alone, in overlapping pieces.
    i = 0
    while i < len(sizes):
        j, lo = i, int(ends[i] - sizes[i])
        while j < len(sizes) and ends[j] - lo <= STRETCH:
            j += 1
        if j > i:
            out.append(_stretch(values[lo : ends[j - 1]], np.arange(i, j), (ends[i:j] - sizes[i:j]) - lo, ends[i:j] - lo, np.zeros(j - i, np.int64), window, k))
            i = j
            continue
        at = 0
        while at == 0 or at + window <= sizes[i]:
            piece = values[lo + at : min(lo + at + STRETCH, int(ends[i]))]
            out.append(_stretch(piece, np.array([i]), np.array([0]), np.array([len(piece)]), np.array([at]), window, k))
            at += STRETCH - window + 1
        i += 1
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _stretch(values, docs, begin, end, offset, window, k):
    size = end - begin
    n_win = np.maximum(size - window + 1, 0)
    if len(values) < window or not n_win.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U, np.int64))
    h = kgram_hashes(values, k)
    anchor = sliding_argmin(h, window - k + 1)
    own = np.repeat(np.arange(len(docs)), n_win)
    start = np.arange(len(own)) - np.repeat(np.cumsum(n_win) - n_win, n_win) + begin[own]
    a = anchor[start]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (own[1:] != own[:-1])))
    run = np.diff(np.append(first, len(a)))
    s, d = start[first], own[first]
    power, inverse = _powers(STRETCH)
    with np.errstate(over="ignore"):
        total = np.concatenate([[U(0)], np.cumsum(h * power[: len(h)], dtype=U)])
        content = (total[s + run - 1 + window - k + 1] - total[s]) * inverse[s]
        c = hashing.mix(content ^ (run.astype(U) * hashing.P1))
    return docs[d], s - begin[d] + offset[d], run, h[a[first]], c, a[first] - s


def listed(doc: np.ndarray, n_docs: int, *columns: np.ndarray) -> list[pa.ListArray]:
    """One list for each document."""
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=n_docs))).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in columns]


def covered(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of the union."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs [start, end) of true places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


# ---- over Spark -----------------------------------------------------------------------------

#: Anchors for which filters are made, and bits of a filter for each of them: 64 MB at most. Filters only save shuffling: what passes by chance is sorted out by an exact join, and beyond this number joins alone are made.
ANCHORS, FILTER_BITS = 1 << 25, 16


def byte_elements(texts: list[bytes]):
    """Bytes as elements: values, sizes, and how to get the content of a block."""
    joined = b"".join(texts)
    return np.frombuffer(joined, np.uint8).astype(U), np.fromiter(map(len, texts), np.int64, len(texts)), joined


def word_elements(texts: list[bytes]):
    """Words between ASCII white space as elements, by their XXH64."""
    buffer, start, length, counts = hashing.joined([t.split() for t in texts])
    values = hashing.xxh64(buffer, start, length)
    return values, counts, values


def text_blocks(texts: list[bytes], most: int = 1_000_000):
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def first_scan(elements, window: int, k: int):
    """(id, text) to (id, h, c) for each block."""

    @_base.tidy
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in text_blocks(texts):
                values, sizes, _ = elements(texts[i:j])
                doc, _, _, h, c, _ = blocks(values, sizes, window, k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + i)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], ["id", "h", "c"])

    return run


def _bits(h: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U(64 * n_words - 1)
    return h & mask, (h >> U(32)) & mask


def passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _bits(h, len(words))
    return ((words[a >> U(6)] >> (a & U(63))) & (words[b >> U(6)] >> (b & U(63))) & U(1)).astype(bool)


def filter_of(hashes: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the n values of column h: n x FILTER_BITS / 64 words, rounded up to a power of two, come to the driver."""
    size = 1 << max(10, (n * FILTER_BITS - 1).bit_length())
    mask = F.lit(size - 1).cast("long")
    bit = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftright("h", 32).bitwiseAND(mask))).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    found = bit.select(F.shiftright("bit", 6).alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits")).toArrow()
    words = np.zeros(size // 64, U)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(U)
    return words


def _cut_out(source, begin: list[int], length: list[int], wanted: list[bool]) -> pa.Array:
    """Contents of blocks; null where not wanted."""
    if isinstance(source, bytes):
        return pa.array([source[b : b + n] if w else None for b, n, w in zip(begin, length, wanted)], pa.binary())
    return pa.array([source[b : b + n].view(np.int64) if w else None for b, n, w in zip(begin, length, wanted)], pa.list_(pa.int64()))


def second_scan(elements, window: int, k: int, repeated=None, several=None):
    """(id, text) to (id, start, run, h, c, anchor, content) of the blocks that pass filter `repeated`; content only of those that pass `several`. Without filters, all blocks and no content."""

    @_base.tidy
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in text_blocks(texts):
                values, sizes, source = elements(texts[i:j])
                doc, start, size, h, c, anchor = blocks(values, sizes, window, k)
                wanted = np.zeros(len(h), bool)
                if repeated is not None:
                    on = np.flatnonzero(passes(repeated.value, h))
                    doc, start, size, h, c, anchor = (x[on] for x in (doc, start, size, h, c, anchor))
                    wanted = passes(several.value, h)
                begin = (np.cumsum(sizes) - sizes)[doc] + start
                content = _cut_out(source, begin.tolist(), (size + window - 1).tolist(), wanted.tolist())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + i)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(anchor.astype(np.int32)), content], ["id", "start", "run", "h", "c", "anchor", "content"])

    return run


def _third_scan(elements, window: int):
    """(text, wanted: blocks by start and run) to (h, c, content)."""

    @_base.tidy
    def run(batches):
        for batch in batches:
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = elements([text])[2]
                content = _cut_out(source, [x["start"] for x in wanted], [x["run"] + window - 1 for x in wanted], [True] * len(wanted))
                yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in wanted], pa.int64()) for c in ("h", "c")), content], ["h", "c", "content"])

    return run


def repeated_blocks(texts: DataFrame, stats: DataFrame, elements, window: int, k: int, kind: str, sums: list, anchors: int = ANCHORS) -> tuple[DataFrame, DataFrame]:
    """From (id, text) and the repeated anchors (h, several): the blocks (id, start, run, h, c, anchor) that may have one; and one row (h, c, run, anchor, content, sums) for each different block of anchors that have several."""
    fields = f"id {texts.schema['id'].dataType.simpleString()}, start int, run int, h long, c long, anchor int, content {kind}"
    once = [F.first("run").alias("run"), F.first("anchor").alias("anchor")]  # equal blocks have equal ones
    n = stats.count()
    if n <= anchors:
        repeated, several = (texts.sparkSession.sparkContext.broadcast(filter_of(x, n)) for x in (stats, stats.filter("several")))
        found = _base.spill(texts.mapInArrow(second_scan(elements, window, k, repeated, several), fields), "blocks")
        each = found.filter("content is not null").groupBy("h", "c").agg(*sums, *once, F.first("content").alias("content"))
        return found.drop("content"), _base.spill(each, "contents")
    found = texts.mapInArrow(second_scan(elements, window, k), fields).drop("content")
    found = _base.spill(found.join(stats.select("h"), "h", "left_semi"), "blocks")
    each = found.join(stats.filter("several").select("h"), "h", "left_semi").groupBy("h", "c").agg(*sums, *once, F.min(F.struct("id", "start")).alias("at"))
    each = _base.spill(each, "different")
    wanted = each.select("at.id", F.struct("at.start", "run", "h", "c").alias("w")).groupBy("id").agg(F.collect_list("w").alias("wanted"))
    content = texts.join(wanted, "id").select("text", "wanted").mapInArrow(_third_scan(elements, window), f"h long, c long, content {kind}")
    # Rows that repeat give the content of a block more than once.
    content = content.groupBy("h", "c").agg(F.first("content").alias("content"))
    out = _base.spill(each.drop("at").join(content, ["h", "c"]), "contents")
    _base.forget(each)
    return found, out


def by_group(batches, n_columns: int, most: int):
    """Lists of the columns of whole groups of equal column 0, of about `most` rows together; rows come sorted by it."""
    held: list[list] = [[] for _ in range(n_columns)]
    for batch in batches:
        for x, col in zip(held, batch.columns):
            x.extend(col.to_pylist())
        if len(held[0]) >= most:
            cut = len(held[0])
            last = held[0][-1]
            while cut and held[0][cut - 1] == last:
                cut -= 1
            if cut:
                yield [x[:cut] for x in held]
                held = [x[cut:] for x in held]
    if held[0]:
        yield held


def _split(window: int, k: int):
    """Pieces (key, ..., l, r, at, run, ..., content) to two finer ones each.

    All blocks of a key agree on l elements before their anchor and r after it. Of a window's other
    elements, at least half lie on one side: by that side its windows are dealt to two pieces, whose
    keys take the half next to what is known. Equal windows stay together.
    """

    @_base.tidy
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                content, p, left, right = row["content"], row["anchor"], row["l"], row["r"]
                x = window - left - k - right
                half = (x + 1) // 2
                other = x - half + 1
                s, e, edge = row["at"], row["at"] + row["run"], p - left - half + 1
                for side, (b, u), part in ((0, (s, min(e, edge)), slice(p - left - half, p - left)), (1, (max(s, edge), e), slice(p + k + right, p + k + right + other))):
                    if b < u:
                        seen = content[part] if isinstance(content, bytes) else np.asarray(content[part], np.int64).tobytes()
                        key = hashlib.blake2b(b"%d %d " % (row["key"], side) + seen, digest_size=8).digest()
                        own = content[b : u + window - 1]
                        piece = hashlib.blake2b(own if isinstance(own, bytes) else np.asarray(own, np.int64).tobytes(), digest_size=8).digest()
                        out.append(row | {"piece": int.from_bytes(piece, "little", signed=True), "key": int.from_bytes(key, "little", signed=True), "l": left + half * (side == 0), "r": right + other * (side == 1), "at": b, "run": u - b})
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    return run


def dealt(each, window: int, k: int, group: int, solve, settle):
    """Marks (h, c, begin, until) of different blocks (h, c, anchor, run, first, content).

    solve gets the pieces of keys that at most `group` of them share. Larger keys are split again and
    again, and equal pieces are then taken together: settle gets them with n, how many there are, and
    least, the smallest `first` of them; those of this `first` stay. A piece of one window is settled so.
    """
    rows = each.select(F.col("h").alias("key"), "h", "c", "anchor", *(F.lit(0).alias(x) for x in ("l", "r", "at")), "run", "first", "content")
    out, level = None, 0
    while True:
        sizes = _base.spill(rows.groupBy("key").agg(F.count(F.lit(1)).alias("g")).filter("g > 1"), "sizes")
        large = _base.spill(sizes.filter(F.col("g") > group).select("key"), "large")
        few = rows.join(large, "key", "left_anti") if not level else rows.join(sizes.filter(F.col("g") <= group).select("key"), "key")
        found = solve(few.repartition("key").sortWithinPartitions("key"))
        out = found if out is None else out.union(found)
        if large.isEmpty():
            return out
        fields = rows.withColumn("piece", F.lit(0).cast("long")).schema
        finer = _base.spill(rows.join(large, "key").select(*rows.columns, F.lit(0).cast("long").alias("piece")).mapInArrow(_split(window, k), fields), "pieces")
        same = _base.spill(finer.groupBy("key", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least")), "same")
        both = finer.join(same, ["key", "piece"])
        out = out.union(settle(both))
        rest = both.filter((F.col("first") == F.col("least")) & (F.col("l") + F.col("r") < window - k))
        rows, level = _base.spill(rest.select(rows.columns), "rest"), level + 1
