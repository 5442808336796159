"""Near-duplicate classes by SimHash with pigeonring filtering.

Two fingerprints that differ in at most 3 of 64 bits, cut into four segments on a ring, have a
segment from which every chain of 1, 2, 3, 4 consecutive segments differs in at most 0, 1, 2, 3
bits. So the first segment of the chain is equal and the second differs in at most one bit: an
equal key of the first segment and all but one part of the second brings the two together, and
the whole chain is required before the full comparison.

Fingerprints are compared as distinct values. A key that more than CAP of them share is dealt out
again: of ten nibbles that the key leaves open at most three can differ, so each choice of three
open nibbles makes a finer key, which at most 4096 values can share. What a bucket returns is a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base, hashing
from gridloom.llm.components import components

#: Words of a shingle, seed of its hash, differing bits that still link.
WORDS, SEED, BITS = 3, 42, 3
#: Parts of a second segment, of which one may differ, by the number of distinct fingerprints up to which they serve: 2 give keys of 24 bits (8 for each fingerprint), 4 of 28 bits (16), 16 of 31 bits (64).
PARTS = ((1 << 30, 2), (1 << 34, 4), (1 << 64, 16))
#: Values of a bucket that are compared in one task; larger buckets are dealt out by finer keys.
CAP = 1024
#: Shingles and pairs that are handled at once.
BLOCK, PAIRS = 100_000, 500_000


def fingerprint_block(texts: list[bytes], size: int = WORDS, seed: int = SEED) -> np.ndarray:
    """64-bit SimHashes of texts in UTF-8: a bit is 1 if set in over half the shingles' hashes. Texts without words have 0."""
    buffer, start, length, counts = hashing.joined([t.lower().split() for t in texts])
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    last_word = np.cumsum(counts)
    first_word = last_word - counts
    doc = np.repeat(np.arange(len(texts)), n)
    ends = np.cumsum(n)
    a = first_word[doc] + np.arange(len(doc)) - (ends - n)[doc]
    b = np.minimum(a + size, last_word[doc]) - 1
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    h = hashing.xxh64(buffer, start[a], start[b] + length[b] - start[a], seed)
    sums = np.zeros((len(some), 64), np.int64)
    bounds = (ends - n)[some]
    for i in range(0, len(h), BLOCK):
        bits = np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo = np.searchsorted(bounds, i, "right") - 1
        hi = np.searchsorted(bounds, min(i + BLOCK, len(h)), "left")
        sums[lo:hi] += np.add.reduceat(bits, np.maximum(bounds[lo:hi] - i, 0), axis=0, dtype=np.int32)
    out[some] = np.packbits(sums * 2 > n[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = WORDS, seed: int = SEED) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    @_base.tidy
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [x or b"" for x in batch.column(1).to_pylist()]
            cuts, n = [0], 0
            for i, t in enumerate(texts):
                n += len(t)
                if n > 400_000:
                    cuts.append(i + 1)
                    n = 0
            cuts.append(len(texts))
            fp = np.concatenate([np.zeros(0, np.uint64), *(fingerprint_block(texts[i:j], size, seed) for i, j in zip(cuts, cuts[1:]) if j > i)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col), _base.utf8(F.col(text_col))).mapInArrow(run, f"id {kind}, fp long")


def _keys(parts: int):
    """For each start of a chain and each part of the second segment that may differ: the other bits, and which of the keys it is."""
    width = 16 // parts
    return [((0xFFFF << 16 * i) | (0xFFFF << 16 * ((i + 1) % 4)) & ~(((1 << width) - 1) << (16 * ((i + 1) % 4) + width * p)), i, p) for i in range(4) for p in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masked(column: str, masks: list[int]):
    return F.array(*(F.struct(F.lit(k).alias("k"), F.col(column).bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)))


def _finer(mask: int) -> list[int]:
    """Masks that keep the bits of mask and all but three nibbles of the others."""
    nibbles = [n for n in range(16) if not mask >> (4 * n) & 15]
    return [~sum(15 << (4 * n) for n in c) & (1 << 64) - 1 for c in combinations(nibbles, 3)]


def linked(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether differences x of fingerprints have a chain within the proportional budgets, then at most `bits` bits in all."""
    seg = [np.bitwise_count((x >> np.uint64(16 * i)) & np.uint64(0xFFFF)) for i in range(4)]
    chain = np.zeros(len(x), bool)
    for i in range(4):
        total, ok = np.zeros(len(x), np.uint8), np.ones(len(x), bool)
        for k in range(3):
            total = total + seg[(i + k) % 4]
            ok &= total <= (k + 1) * bits // 4
        chain |= ok
    out = np.zeros(len(x), bool)
    on = np.flatnonzero(chain)
    out[on] = np.bitwise_count(x[on]) <= bits
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of links a-b that aren't their component's smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    on = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[on], nodes[root[on]]


def links_of_block(group: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within groups; equal numbers of group stand together."""
    change = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
    end = np.repeat(change, np.diff(np.append(0, change)))
    more = end - np.arange(len(fp)) - 1
    total = np.cumsum(more)
    ra, rb = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    i = 0
    while i < len(fp):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
        left = np.repeat(np.arange(i, j), more[i:j])
        nth = np.arange(len(left)) - np.repeat(np.cumsum(more[i:j]) - more[i:j], more[i:j])
        right = left + 1 + nth
        on = linked(fp[left] ^ fp[right], bits)
        a, b = forest(fp[left[on]], fp[right[on]])
        ra.append(a)
        rb.append(b)
        i = j
    return forest(np.concatenate(ra), np.concatenate(rb))


@_base.tidy
def _links(batches):
    held: list = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]

    def out(cols):
        g = np.cumsum(np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
        a, b = links_of_block(g, cols[2])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        cols = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False).astype(h.dtype, copy=False) if i < 2 else batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64)]) for i, h in enumerate(held)]
        if not len(cols[0]):
            continue
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cut = len(same) - int(same.sum())
        if cut:
            yield out([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if len(held[0]):
        yield out(held)


def _within(buckets: DataFrame) -> DataFrame:
    """Links within buckets (k, key, fp), each of them small."""
    return buckets.select("k", "key", "fp").repartition("k", "key").sortWithinPartitions("k", "key").mapInArrow(_links, "a long, b long")


def _shared(rows: DataFrame, tag: str) -> DataFrame:
    """rows (k, key, fp) of keys that two or more have, with their number n."""
    n = _base.spill(rows.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), tag)
    return rows.join(n, ["k", "key"])


def links(values: DataFrame, parts: int | None = None, cap: int = CAP) -> DataFrame:
    """Edges (a, b) between distinct values of column fp: every two that differ in at most 3 bits are connected by them, however long the keys are."""
    if parts is None:
        n = values.count()
        parts = next(p for most, p in PARTS if n <= most)
    keys = _keys(parts)
    rows = values.select("fp", F.explode(_masked("fp", [m for m, _, _ in keys])).alias("e")).select("e.k", "e.key", "fp")
    shared = _base.spill(_shared(rows, "sizes"), "buckets")
    out = _within(shared.filter(F.col("n") <= cap))
    large = shared.filter(F.col("n") > cap)
    for k in [r[0] for r in large.select("k").distinct().collect()]:  # at most one row for each key kind
        masks = _finer(keys[k][0])
        finer = large.filter(F.col("k") == k).select("fp", F.explode(_masked("fp", masks)).alias("e")).select("e.k", "e.key", "fp")
        out = out.union(_within(_shared(finer, "sizes")))
    return out


def _classes(fps: DataFrame) -> DataFrame:
    """(fp, root, least): the class of each fingerprint of (id, fp), and its smallest id."""
    values = _base.spill(fps.groupBy("fp").agg(F.min("id").alias("first")), "values")
    roots = components(links(values))
    rooted = values.join(roots, values["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = _base.spill(rooted, "rooted")
    least = _base.spill(rooted.groupBy("root").agg(F.min("first").alias("least")), "classes")
    out = _base.spill(rooted.join(least, "root").select("fp", "root", "least"), "class-of")
    _base.forget(values, rooted, least)
    return out


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the smallest id that links reach).

    Null and wordless texts have fingerprint zero and are linked like any other. Rows that repeat an
    id are rows of their own. Null ids are larger than all others. Other columns are not read.
    """
    _base.ready(docs.sparkSession)
    fps = _base.spill(fingerprints(docs, id_col, text_col, size, seed), "fingerprints")
    classes = _classes(fps).select("fp", "least")
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, seed: int = SEED) -> DataFrame:
    """docs with the row of the smallest id of each class of linked fingerprints; all columns stay.

    Null, empty and wordless texts are one class (fingerprint zero and what links to it). Ids may be
    null (they come last) and may repeat: rows of the same id in one class leave one, rows of the
    same id in different classes are told apart by their texts.
    """
    _base.ready(docs.sparkSession)
    mark = F.xxhash64(docs[text_col])
    fps = _base.spill(fingerprints(docs.select(F.struct(docs[id_col].alias("id"), mark.alias("mark")).alias("row"), docs[text_col].alias("text")), "row", "text", size, seed).select("id.*", "fp"), "fingerprints")
    classes = _classes(fps)
    found = _base.spill(fps.join(classes, "fp").select("id", "mark", F.col("root").alias("grp")), "members")
    _base.forget(fps, classes)
    return _base.one_of_each(docs, found, id_col, mark)


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(_base.table(spark, sf_dir, "documents"))
