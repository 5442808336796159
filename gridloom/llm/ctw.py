"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A symbol is a byte or the text's end: nine binary decisions (first whether the text ends, then a
byte's bits), each in the context of the decisions before it and of up to DEPTH symbols before it;
before a text's begin stands a symbol of its own. Every context of every depth has a
Krichevsky-Trofimov estimate from the whole training corpus; bottom-up, a node's weighted
probability is half its own estimate and half the product of its children's, and the shares that
this gives each depth mix their predictions. Where training has never seen a context, its share goes
to the estimate of the longest one seen. A text's code length is the sum over its decisions.

All strings of DEPTH + 1 symbols are counted over all texts, and the tree is a distributed table of
them: it grows with the corpus, and no string or node is left out. Strings are dealt out by their
latest GROUP context symbols, so that a task has whole subtrees; what is above them, at most 257
nodes for each prefix of a symbol, is summed up and handed down. Texts look frequent strings up in a
broadcast table of bounded size; their other strings are joined. So are the words of the base model.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base

#: Symbols of context, and those by which strings are dealt out.
DEPTH, GROUP = 4, 2
#: Strings and words that are broadcast at most, and the greatest length in bytes of such a word; what is not broadcast is joined.
STRINGS, FREQUENT, LONGEST = 2_000_000, 200_000, 48
#: Strings whose subtrees are computed at once, if they are of several groups.
ROWS = 250_000
#: Bits of a symbol; the symbol for a text's end, and in contexts for what is before its begin.
BITS, END = 9, 256
U = np.uint64


# ---- the tree ---------------------------------------------------------------------------------


def strings(texts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """For each byte of the texts and for each text's end, depth context symbols and itself as one number: latest context symbol first, then the earlier ones, the symbol itself last."""
    if not texts:
        return np.zeros(0, U)
    b = np.frombuffer(b"".join(bytes(depth) + t + b"\0" for t in texts), np.uint8).astype(U)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + depth + 1
    after = np.cumsum(size)
    at = after - size
    b[after - 1] = END
    own = np.ones(len(b), bool)
    for d in range(depth):
        b[at + d], own[at + d] = END, False
    n = len(b) - depth
    key = np.zeros(n, U)
    for d in range(1, depth + 1):
        key |= b[depth - d : depth - d + n] << U(BITS * (depth + 1 - d))
    key |= b[depth:]
    return key[own[depth:]]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma by Stirling's series, for x >= 0.5."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(7):
        small = y < 7
        shift[small] += np.log(y[small])
        y[small] += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - np.log(np.pi) - _lgamma(zeros + ones + 1.0)


class Table:
    """Open addressing over 64-bit keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 1.6 + 1))))
        self.shift, self.mask = U(64 - bits), U((1 << bits) - 1)
        self.keys = np.full(1 << bits, U(2**64 - 1), U)
        self.values = np.zeros(1 << bits, np.float32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == U(2**64 - 1)
            take = left[free]
            self.keys[at[take]] = keys[take]
            won = np.zeros(len(left), bool)
            won[free] = self.keys[at[take]] == keys[take]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + U(1)) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys ^ (keys >> U(23))) * U(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; not a number where there is none."""
        out = np.full(len(keys), np.nan, np.float32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen != U(2**64 - 1))]
            at[left] = (at[left] + U(1)) & self.mask
        return out


def _firsts(x: np.ndarray) -> np.ndarray:
    """Whether each element of a sorted array is the first of its kind."""
    return np.append(True, x[1:] != x[:-1])[: len(x)]


class Subtrees:
    """The nodes of depths top to depth over sorted strings of whole groups, with their counts; strings that training has not seen count 0."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.keys, self.depth, self.top = keys, depth, top
        n, context, symbol = counts.astype(np.float64), keys >> U(BITS), keys & U((1 << BITS) - 1)
        self.cut = []
        for d in range(top, depth):
            u, at = np.unique((context >> U(BITS * (depth - d))) << U(BITS) | symbol, return_inverse=True)
            self.cut.append((u, np.bincount(at, n, len(u))))
        self.cut.append((keys, n))

    def level(self, k: int):
        """Of each depth the nodes of decision k: identity, zeros, ones; the parent of each; and the strings that take the decision, with their node."""
        nodes = []
        for u, c in self.cut:
            on = np.flatnonzero((u & U((1 << BITS) - 1)) != END) if k else np.arange(len(u))
            u, c = u[on], c[on]
            symbol = u & U((1 << BITS) - 1)
            ident = (u >> U(BITS)) << U(BITS) | U(1 << k) | symbol >> U(BITS - k)
            bit = (symbol >> U(BITS - 1 - k)) & U(1) > 0
            new = _firsts(ident)
            first = np.flatnonzero(new)
            sums = [np.add.reduceat(np.where(x, c, 0.0), first) if len(first) else np.zeros(0) for x in (~bit, bit)]
            nodes.append((ident[first], *sums))
            of = on, bit, np.cumsum(new) - 1
        parents = [None]
        for (above, *_), (below, *_) in zip(nodes, nodes[1:]):
            parents.append(np.searchsorted(above, _above(below)))
        return nodes, parents, of

    def weighted(self, nodes, parents) -> list[np.ndarray]:
        """Of each depth the log of the nodes' weighted probabilities."""
        out = [kt(*nodes[-1][1:])]
        for d in range(len(nodes) - 2, -1, -1):
            below = np.bincount(parents[d + 1], out[0], len(nodes[d][0]))
            out.insert(0, np.logaddexp(kt(*nodes[d][1:]), below) + np.log(0.5))
        return out

    def tops(self) -> tuple[np.ndarray, ...]:
        """Summed up for the parents of the topmost nodes: identity, zeros, ones, log of the product of weighted probabilities."""
        out = []
        for k in range(BITS):
            nodes, parents, _ = self.level(k)
            ident, zeros, ones = nodes[0]
            above, at = np.unique(_above(ident), return_inverse=True)
            out.append((above, *(np.bincount(at, x, len(above)) for x in (zeros, ones, self.weighted(nodes, parents)[0]))))
        return tuple(np.concatenate(x) for x in zip(*out))

    def log2(self, upper: np.ndarray) -> np.ndarray:
        """Log2 probabilities of the strings' symbols; upper: of the parents of the topmost nodes, what is mixed so far, the share that is left, and the last estimate."""
        total = np.zeros(len(self.keys))
        for k in range(BITS):
            nodes, parents, (on, bit, of) = self.level(k)
            weighted = self.weighted(nodes, parents)
            state = upper[:, _above(nodes[0][0]).astype(np.int64)]
            for d, (_, zeros, ones) in enumerate(nodes):
                if d:
                    state = state[:, parents[d]]
                state = mixed(state, zeros, ones, weighted[d], last=d == len(nodes) - 1)
            one = state[0] + state[1] * state[2]
            p = np.where(bit, one[of], 1 - one[of])
            total[on] += np.log2(p)
        return total


def _above(ident: np.ndarray) -> np.ndarray:
    """The node of the same decision whose context is shorter by the earliest symbol."""
    return (ident >> U(2 * BITS)) << U(BITS) | ident & U((1 << BITS) - 1)


def mixed(state: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray, last: bool = False) -> np.ndarray:
    """One depth further: what is mixed so far, the share that is left, and the last estimate. Nodes without counts leave all as it is."""
    p = (ones + 0.5) / (zeros + ones + 1.0)
    share = np.ones(len(p)) if last else np.exp(kt(zeros, ones) + np.log(0.5) - weighted)
    new = np.stack([state[0] + state[1] * share * p, state[1] * (1 - share), p])
    return np.where(zeros + ones > 0, new, state)


def crown(ident: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, depth: int) -> np.ndarray:
    """From sums for nodes of `depth`, the mixing states there, as a table over identities."""
    levels = [(ident, zeros, ones, np.logaddexp(kt(zeros, ones), below) + np.log(0.5))]
    for _ in range(depth):
        i, z, o, w = levels[0]
        above, at = np.unique(_above(i), return_inverse=True)
        z, o, w = (np.bincount(at, x, len(above)) for x in (z, o, w))
        levels.insert(0, (above, z, o, np.logaddexp(kt(z, o), w) + np.log(0.5)))
    state = np.tile(np.array([[0.0], [1.0], [0.5]]), len(levels[0][0]))
    for d, (i, z, o, w) in enumerate(levels):
        if d:
            state = state[:, np.searchsorted(levels[d - 1][0], _above(i))]
        state = mixed(state, z, o, w)
    out = np.zeros((3, 1 << BITS * (depth + 1)))
    out[:, ident.astype(np.int64)] = state
    return out


# ---- over Spark -------------------------------------------------------------------------------


def _blocks(texts: list[bytes], most: int = 1_000_000):
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums counts of equal keys."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(_firsts(keys))
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _count_strings(depth: int):
    """(held, text) to (key, n): n counts the texts that aren't held out; strings of others are there too."""

    @_base.tidy
    def run(batches):
        parts, n = [], 0
        for batch in batches:
            held, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in _blocks(texts, 2_000_000):
                for out in (False, True):
                    u, c = np.unique(strings([t for t, h in zip(texts[i:j], held[i:j]) if h is out], depth), return_counts=True)
                    parts.append((u, c * (not out)))
                    n += len(u)
                if n > 3_000_000:
                    parts = [merged(parts)]
                    n = len(parts[0][0])
                    if n > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], ["key", "n"])
                        parts, n = [], 0
        if parts:
            u, c = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["key", "n"])

    return run


def lower(text: bytes) -> bytes:
    """A-Z in lower case."""
    return text.lower()


@_base.tidy
def _count_words(batches):
    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for t in batch.column(0).to_pylist():
            counts.update(lower(t).split())
        if len(counts) > 400_000:
            yield out()
            counts = Counter()
    if counts:
        yield out()


def _whole_groups(batches, shift: int, rows: int):
    """Sorted keys and counts of whole groups, of about `rows` together."""
    held: list[np.ndarray] = [np.zeros(0, U), np.zeros(0, np.int64)]
    for batch in batches:
        held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False).view(h.dtype)]) for i, h in enumerate(held)]
        if len(held[0]) >= rows:
            cut = int(np.searchsorted(held[0], (held[0][-1] >> U(shift)) << U(shift)))
            if cut:
                yield [h[:cut] for h in held]
                held = [h[cut:] for h in held]
    if len(held[0]):
        yield held


def string_table(texts: DataFrame, depth: int = DEPTH, rows: int = ROWS) -> DataFrame:
    """(key, n, log2p) of all strings of (held, text: binary): the model, as an intermediate table. No string is left out."""
    if depth < GROUP:
        raise ValueError(f"contexts of {GROUP} symbols at least")
    counted = texts.select("held", "text").mapInArrow(_count_strings(depth), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = _base.spill(counted, "strings")
    shift = BITS * (depth + 1 - GROUP)
    dealt = counted.repartition(F.shiftright("key", shift)).sortWithinPartitions("key")

    @_base.tidy
    def sums(batches):
        for keys, n in _whole_groups(batches, shift, rows):
            i, z, o, w = Subtrees(keys, n, depth, GROUP).tops()
            yield pa.RecordBatch.from_arrays([pa.array(i.view(np.int64)), pa.array(z), pa.array(o), pa.array(w)], ["ident", "zeros", "ones", "below"])

    # At most 257 x 511 rows.
    tops = dealt.mapInArrow(sums, "ident long, zeros double, ones double, below double").groupBy("ident").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "below"))).orderBy("ident").toArrow()
    ident, *rest = (tops[c].to_numpy() for c in ("ident", "zeros", "ones", "below"))
    upper = texts.sparkSession.sparkContext.broadcast(crown(ident.view(U), *rest, GROUP - 1))

    @_base.tidy
    def codes(batches):
        for keys, n in _whole_groups(batches, shift, rows):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(Subtrees(keys, n, depth, GROUP).log2(upper.value).astype(np.float32))], ["key", "n", "log2p"])

    out = _base.spill(dealt.mapInArrow(codes, "key long, n long, log2p float"), "model")
    _base.forget(counted)
    return out


def _most_frequent(model: DataFrame, most: int) -> Table:
    """The strings of greatest counts, at most `most`, without a sort."""
    step = F.floor(F.log2("n") * 16).cast("int")
    # At most 16 x 63 rows.
    sizes = sorted(model.filter("n > 0").groupBy(step.alias("p")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)
    least, left = None, most
    for p, k in sizes:
        left -= k
        if left < 0:
            break
        least = p
    found = (model.filter((F.col("n") > 0) & (step >= least)) if least is not None else model.limit(0)).select("key", "log2p").toArrow()
    return Table(found["key"].to_numpy().view(U), found["log2p"].to_numpy())


def scores(docs: DataFrame, parts: int = 7, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, frequent: int = FREQUENT, frequent_strings: int = STRINGS, rows: int = ROWS, normal: bool = False) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learns from rows that aren't held out. Null texts count as empty: one token, and a score for the
    end alone; bits_per_byte is null for them. Null ids are not held out. Rows that repeat are scored
    each, and each counts. Without training rows all counts are 0. Other columns are not read. The
    base model divides c + 1 by N (V + 1); normal: by N + (V + 1), so that the probabilities of the V
    known tokens and of one unknown sum to one.
    """
    spark = docs.sparkSession
    _base.ready(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), _base.held_out(F.col(id_col), parts).alias("held"), _base.utf8(F.col(text_col)).alias("text"))
    model = string_table(texts, depth, rows)
    training = texts.filter("not held").select("text")
    words = _base.spill(training.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ends = training.count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + ends, distinct + (ends > 0)
    base = total + (distinct + 1.0) if normal else total * (distinct + 1.0)
    unit = float(-np.log10(base)) if base else 0.0
    top = words.filter(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    table = dict(zip(top["word"].to_pylist(), top["n"].to_pylist()))
    shared = spark.sparkContext.broadcast((_most_frequent(model, frequent_strings), table))  # at most `frequent_strings` and `frequent`
    del top, table
    _base.release()

    @_base.tidy
    def run(batches):
        known, table = shared.value
        end = np.log10(ends + 1.0) + unit
        for batch in batches:
            texts = batch.column(2).to_pylist()
            bits, rare, rare_n, rare_ends = [], [], [], []
            for i, j in _blocks(texts):
                keys = strings(texts[i:j], depth)
                owner = np.repeat(np.arange(j - i), [len(t) + 1 for t in texts[i:j]])
                got = known.get(keys)
                off = np.isnan(got)
                bits.append(np.bincount(owner, np.where(off, 0.0, got), j - i))
                pairs, n = np.unique(np.stack([owner[off].astype(U), keys[off]], 1), axis=0, return_counts=True) if off.any() else (np.zeros((0, 2), U), np.zeros(0, np.int64))
                rare.append(pairs[:, 1].view(np.int64) if len(pairs) else np.zeros(0, np.int64))
                rare_n.append(n)
                rare_ends.append(np.bincount(pairs[:, 0].astype(np.int64), minlength=j - i))
            n_tokens, n_known, sums, rest_words, rest_n, offsets = [], [], [], [], [], [0]
            for t in texts:
                got = list(map(table.get, w := lower(t).split()))
                rest = Counter(x for x, c in zip(w, got) if c is None) if None in got else {}
                c = np.array([x for x in got if x is not None] if rest else got, np.float64)
                n_tokens.append(len(w) + 1)
                n_known.append(len(c) + (ends > 0))
                sums.append(float(np.log10(c + 1.0).sum()) + unit * len(c) + end)
                rest_words += rest.keys()
                rest_n += rest.values()
                offsets.append(len(rest_words))
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rest_words, pa.binary()), pa.array(rest_n, pa.int32())], ["word", "tf"]))
            flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (rare, rare_n, rare_ends)]
            unseen = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(flat[2])).astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[0])), pa.array(flat[1].astype(np.int32))], ["key", "tf"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2)), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(np.concatenate([np.zeros(0), *bits])), rest, unseen], fields)

    fields = ["id", "held", "n_bytes", "n_tokens", "n_known", "known_sum", "bits", "rest", "rare"]
    scored = texts.mapInArrow(run, f"id {kind}, held boolean, n_bytes long, n_tokens long, n_known long, known_sum double, bits double, rest array<struct<word: binary, tf: int>>, rare array<struct<key: bigint, tf: int>>")
    # Rows are numbered once, as they are written.
    scored = _base.spill(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    c, none = F.coalesce("n", F.lit(0)), F.lit(0.0)
    of_words = scored.select("row", F.inline("rest")).join(words, "word", "left").select("row", F.when(c > 0, F.col("tf")).otherwise(0).alias("more"), (F.col("tf") * (F.log10(c + 1.0) + F.lit(unit))).alias("log"), none.alias("bits"))
    of_strings = scored.select("row", F.inline("rare")).join(model.select("key", "log2p"), "key").select("row", F.lit(0).alias("more"), none.alias("log"), (F.col("tf") * F.col("log2p")).alias("bits"))
    per = _base.spill(of_words.union(of_strings).groupBy("row").agg(*(F.sum(x).alias(f"sum_{x}") for x in ("more", "log", "bits"))), "rest")
    _base.forget(model, words)
    out = scored.drop("rest", "rare").join(per, "row", "left")
    score = (F.col("bits") + F.coalesce("sum_bits", none)) * F.lit(float(np.log10(2.0)))
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("sum_more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known_sum") + F.coalesce("sum_log", none)).alias("base_score"), score.alias("score"), "n_bytes", F.when(F.col("n_bytes") > 0, -score / F.lit(float(np.log10(2.0))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op5_context_tree_scores(spark, sf_dir: str) -> DataFrame:
    return scores(_base.table(spark, sf_dir, "documents"), normal=True)
