"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words, and these into segments: at every place that no piece of the model can
cross, as no piece has the two characters beside it with a third one to either side, nor just the
two. Segments are encoded on their own, each distinct one once. The substrings of a segment, up to
the longest piece, are exploded and equi-joined to the piece table, which is a vocabulary of bounded
size and is broadcast; the edges are grouped by segment, in the partition that has it, and folded
with `aggregate`.

For a unigram model the fold is Viterbi: the path of greatest summed score. For a merge (BPE) model
that path is not the library's encoding, so there the fold takes the lattice's best merge, of best
score, then leftmost, until none is left: each merge is an edge over two neighbouring ones. Bounds
of pieces are bits of a number in segments of up to PLACES characters, and an array in longer ones.
Characters that no edge covers become the pieces of their bytes.

Texts are cut once, into chunks that hold their texts as numbers of words and each distinct segment
once, and wait in buckets. The ids of the most frequent segments are broadcast, the others are joined
by parts of all segments to the chunks that have them. Decoding puts the pieces' bytes together again.
"""

from __future__ import annotations

import contextlib
import re
from collections import Counter
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base

SPACE = "▁"
#: Characters of a segment whose bounds are bits; words of texts that a Python worker holds at once.
PLACES, HELD = 61, 300_000
#: Characters of the texts that a chunk holds, distinct words that are cut at once, words whose ids are put together at once.
LETTERS, CUT, WORDS = 1 << 25, 30_000, 300_000
#: Segments whose ids are broadcast, and characters of such a segment; segments of a partition that are grouped by hash, without a sort.
FREQUENT, BROADCAST, GROUPED = 300_000, 64, 10_000
#: Words where spaces are doubled or marks are in the text: the mark before a word is its own, and a line end is a word.
WORD = f"\\n+|{SPACE}*[^{SPACE}\\n]+|{SPACE}+"


@lru_cache(maxsize=4)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pieces(spark, path: str) -> DataFrame:
    """(piece, id, score, rank) of a model file, without control, unknown, unused and byte pieces; a higher score has a higher rank, from 1, and an equal one the same."""
    sp = processor(path)
    rows = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    table = pd.DataFrame(rows, columns=["piece", "id", "score"])
    return spark.createDataFrame(table.assign(rank=table["score"].rank(method="dense").astype("int64")))


@lru_cache(maxsize=4)
def piece_bytes(path: str) -> list[bytes]:
    """What each id stands for; control pieces for nothing."""
    sp = processor(path)
    return [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode() for i in range(sp.get_piece_size())]


def byte_ids(path: str) -> list[int]:
    """Ids of the pieces of the 256 bytes."""
    sp = processor(path)
    return [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


class Cutter:
    """Cuts words into segments where no piece of a model can cross."""

    def __init__(self, names: list[str]):
        chars = sorted({c for p in names for c in p})
        self.size = len(chars) + 1
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, self.size)
        place = {c: i + 1 for i, c in enumerate(chars)}
        self.pairs = self._hashed(np.array(sorted(place[p[0]] * self.size + place[p[1]] for p in names if len(p) == 2), np.int64))
        self.triples = self._hashed(np.array(sorted({(place[p[i]] * self.size + place[p[i + 1]]) * self.size + place[p[i + 2]] for p in names for i in range(len(p) - 2)}), np.int64))

    @staticmethod
    def _hashed(known: np.ndarray) -> np.ndarray:
        """A table of some 16 places a number, each at the first free place from its own on; -1 where free. The last place is always free."""
        out = np.full((1 << int(np.ceil(np.log2(16 * len(known) + 64)))) + len(known) + 1, -1, np.int64)
        for x, at in zip(known.tolist(), Cutter._places(known, out).tolist()):
            while out[at] != -1:
                at += 1
            out[at] = x
        return out

    @staticmethod
    def _places(x: np.ndarray, table: np.ndarray) -> np.ndarray:
        return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(table).bit_length())).astype(np.int64)

    @classmethod
    def _among(cls, x: np.ndarray, table: np.ndarray) -> np.ndarray:
        at = cls._places(x, table)
        found = table[at]
        same = found == x
        left = np.flatnonzero(~same & (found != -1))
        while len(left):  # another number has the place
            at[left] += 1
            found = table[at[left]]
            same[left] = found == x[left]
            left = left[~same[left] & (found != -1)]
        return same

    def cut(self, words: list[str]) -> list[list[str]]:
        """The segments of each word."""
        cps = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        n = len(cps)
        c = self.code[cps].astype(np.int64)
        begins = np.zeros(n + 1, bool)
        begins[ends] = True
        joined = np.zeros(n + 1, bool)  # whether a piece may cross the place before a character
        pair = c[:-1] * self.size + c[1:]
        joined[1:n] = self._among(pair, self.pairs)
        if n > 2:
            triple = self._among(pair[:-1] * self.size + c[2:], self.triples)
            triple &= ~(begins[1 : n - 1] | begins[2:n])  # within a word
            joined[1 : n - 1] |= triple
            joined[2:n] |= triple
        at = np.flatnonzero(~joined[: n + 1] & ~begins)
        at = at[(at > 0) & (at < n)]
        first, last = np.searchsorted(at, ends - np.diff(np.append(0, ends))), np.searchsorted(at, ends)
        out, start = [], 0
        at = at.tolist()
        for w, e, i, j in zip(words, ends.tolist(), first.tolist(), last.tolist()):
            if i == j:
                out.append([w])
            else:
                marks = [0, *(x - start for x in at[i:j]), len(w)]
                out.append([w[a:b] for a, b in zip(marks, marks[1:])])
            start = e
        return out


@lru_cache(maxsize=4)
def cutter(path: str) -> Cutter:
    sp = processor(path)
    return Cutter([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))])


def words_in(text: str) -> list[str]:
    """Words of a text as the model sees it: a mark before it and for each space. No piece crosses a word's end."""
    if not text:
        return []
    if text[0] == " " or "  " in text or SPACE in text:
        return re.findall(WORD, SPACE + text.replace(" ", SPACE))
    return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")


def bare_words_in(text: str) -> list[str]:
    """Words of a text, most of them without the mark before them, which is faster; those that words_in does not find by single spaces have a space before them."""
    if not text:
        return []
    if text[0] == " " or "  " in text or SPACE in text:
        return [" " + w for w in words_in(text)]
    return text.split(" ")


def segments_of(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n): the distinct segments of all texts and how often they occur. Null and empty texts have none."""
    _base.ready(docs.sparkSession)

    @_base.tidy
    def run(batches):
        counts: Counter = Counter()

        def out():
            words = list(counts)
            found: Counter = Counter()
            for segments, n in zip(cutter(path).cut(words), counts.values()):
                for s in segments:
                    found[s] += n
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(words_in(t or ""))
            if len(counts) > HELD:
                yield out()
                counts = Counter()
        if counts:
            yield out()

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spans(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(word, n, begin, length, piece, id, score): the substrings of each word up to `longest`, with the piece that each is, if any. Words stay in their partition."""
    size = F.length("word")
    begins = words.select("word", "n", F.explode(F.sequence(F.lit(0), size - 1)).alias("begin"))
    found = begins.select("word", "n", "begin", F.explode(F.sequence(F.lit(1), F.least(size - F.col("begin"), F.lit(longest)))).alias("length"))
    found = found.withColumn("piece", F.substring("word", F.col("begin") + 1, F.col("length")))
    return found.join(F.broadcast(table), "piece", "left")


def lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(word, n, cells): for each word its substrings' (score, id) in order of begin and length; null where there is no piece."""
    at = F.col("begin").cast("long") * 256 + F.col("length")
    cells = F.collect_list(F.struct(at.alias("at"), "score", "id"))
    return spans(words, table, longest).groupBy("word", "n").agg(F.array_sort(cells).alias("cells"))


def _byte_tail(char: Column, ids: list[int]) -> Column:
    """The byte pieces of one character."""
    table = F.array(*(F.lit(i).cast("long") for i in ids))
    code = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.floor(F.length(code) / 2).cast("int")), lambda k: F.element_at(table, F.conv(F.substring(code, (2 * k - 1).cast("int"), F.lit(2)), 16, 10).cast("int") + 1))


def _let(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


#: An edge as one number: rank, 63 - begin, length and id, so that the greatest is of the best score, then leftmost. NONE is the id of a character without a piece.
RANK_AT, LEFT_AT, LENGTH_AT = 40, 34, 28
NONE = (1 << LENGTH_AT) - 1


def _begin(e: Column) -> Column:
    return (63 - F.shiftright(e, LEFT_AT).bitwiseAND(F.lit(63).cast("long"))).cast("int")


def _length(e: Column) -> Column:
    return F.shiftright(e, LENGTH_AT).bitwiseAND(F.lit(63).cast("long")).cast("int")


def bit_lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(word, n, edges): for words of up to PLACES characters, the pieces in them and the single characters, each as one number, with its two ends and the places inside it as bits."""
    begin, one = F.col("begin").cast("long"), lambda at: F.lit(1 << at).cast("long")
    edge = F.coalesce("rank", F.lit(0).cast("long")) * one(RANK_AT) + (63 - begin) * one(LEFT_AT) + F.col("length") * one(LENGTH_AT) + F.coalesce(F.col("id").cast("long"), F.lit(NONE).cast("long"))
    found = spans(words, table, longest).filter("id is not null or length = 1")
    found = found.groupBy("word", "n").agg(F.collect_list(edge).alias("edges"))

    def ends(e: Column) -> Column:
        return _let(F.struct(_begin(e).alias("b"), _length(e).alias("l")), lambda x: F.struct(e.alias("e"), (_bit(x["b"]) + _bit(x["b"] + x["l"])).alias("ends"), (_bit(x["b"] + x["l"]) - _bit(x["b"] + 1)).alias("inner")))

    return found.select("word", "n", F.transform("edges", ends).alias("edges"))


def merged_bits() -> Column:
    """Bounds of the pieces of a word after all merges, as bits."""
    def step(state: Column, _: Column) -> Column:
        """Beside the bounds the fold keeps the edges that may still come: both ends are bounds, and a bound is inside."""
        best = F.array_max(F.filter(state["edges"], lambda e: F.bit_count(state["bounds"].bitwiseAND(e["inner"])) == 1))

        def merge(bounds: Column) -> Column:
            left = F.filter(state["edges"], lambda e: (bounds.bitwiseAND(e["ends"]) == e["ends"]) & (bounds.bitwiseAND(e["inner"]) != 0))
            return F.struct(bounds.alias("bounds"), left.alias("edges"))

        return F.when(F.size(state["edges"]) == 0, state).otherwise(_let(state["bounds"] - F.coalesce(_let(best, lambda e: state["bounds"].bitwiseAND(e["inner"])), F.lit(0).cast("long")), merge))

    start = F.struct((_bit(F.length("word") + 1) - 1).alias("bounds"), F.filter("edges", lambda e: e["inner"] != 0).alias("edges"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), start, step, lambda s: s["bounds"])


def bit_ids(ids: list[int]) -> Column:
    """Piece ids of the edges between the bounds in column `bounds`; bytes where a character has no piece."""
    bounds, none = F.col("bounds"), F.lit(NONE).cast("long")
    path = F.filter("edges", lambda e: (bounds.bitwiseAND(e["ends"]) == e["ends"]) & (bounds.bitwiseAND(e["inner"]) == 0))
    ordered = F.sort_array(F.transform(path, lambda e: _begin(e["e"]).cast("long") * F.lit(1 << LENGTH_AT).cast("long") + e["e"].bitwiseAND(none)))
    ident = lambda x: x.bitwiseAND(none)
    tails = F.flatten(F.transform(ordered, lambda x: F.when(ident(x) != none, F.array(ident(x))).otherwise(_byte_tail(F.substring("word", (F.shiftright(x, LENGTH_AT) + 1).cast("int"), F.lit(1)), ids))))
    return F.when(F.exists(ordered, lambda x: ident(x) == none), tails).otherwise(F.transform(ordered, ident))


def _cell(begin: Column, end: Column, longest: int) -> Column:
    """The cell of the substring from begin to end; null for one that is too long."""
    def upto(left: Column) -> Column:
        """Cells of the last `left` begins."""
        return F.when(left <= longest, left * (left + 1) / 2).otherwise(longest * (longest + 1) / 2 + (left - longest) * longest)

    size = F.length("word")
    place = (upto(size) - upto(size - begin)).cast("int") + (end - begin)
    return F.when(end - begin <= longest, F.element_at("cells", place))


def _ids(bounds: Column, ids: list[int], longest: int) -> Column:
    """Piece ids of the substrings between bounds; bytes where one is no piece."""
    def one(i: Column) -> Column:
        b, e = F.element_at(bounds, i), F.element_at(bounds, i + 1)
        cell = _cell(b, e, longest)
        return F.when(cell["id"].isNotNull(), F.array(cell["id"])).otherwise(_byte_tail(F.substring("word", b + 1, e - b), ids))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), one))


def merged(longest: int) -> Column:
    """Bounds of the pieces of a word after all merges. Beside the bounds the fold keeps what each two neighbours would score; a merge changes two of these."""
    none = F.lit(float("-inf"))
    score = lambda b, e: F.coalesce(_cell(b, e, longest)["score"], none)

    def step(state: Column, _: Column) -> Column:
        bounds, offers = state["bounds"], state["offers"]

        def merge(i: Column) -> Column:
            at = lambda k: F.element_at(bounds, i + k)
            left = F.when(i > 1, F.array(score(at(-1), at(2)))).otherwise(F.array().cast("array<double>"))
            right = F.when(i < F.size(offers), F.array(score(at(0), at(3)))).otherwise(F.array().cast("array<double>"))
            return F.struct(
                F.concat(F.slice(bounds, F.lit(1), i), F.slice(bounds, i + 2, F.size(bounds))).alias("bounds"),
                F.concat(F.slice(offers, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(offers, i + 2, F.size(offers))).alias("offers"),
            )

        best = F.array_max(offers)
        return F.when(best > none, _let(F.array_position(offers, best).cast("int"), merge)).otherwise(state)

    size = F.length("word")
    first = F.when(size > 1, F.transform(F.sequence(F.lit(0), F.greatest(size - 2, F.lit(0))), lambda b: score(b, b + 2))).otherwise(F.array().cast("array<double>"))
    start = F.struct(F.sequence(F.lit(0), size).alias("bounds"), first.alias("offers"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), start, step)["bounds"]


def best_path(longest: int, unknown: float = -1e6) -> Column:
    """Bounds of the path of greatest summed score; a character without a piece costs `unknown`. Of equal paths, the one with the longer last piece."""
    def step(state: Column, end: Column) -> Column:
        def offer(length: Column) -> Column:
            begin = end - length
            cell = _cell(begin, end, longest)
            score = F.when(cell["id"].isNotNull(), cell["score"]).when(length == 1, F.lit(unknown))
            before = F.element_at(state, begin + 1)
            return F.when(score.isNotNull(), F.struct((before["s"] + score).alias("s"), F.concat(before["b"], F.array(end)).alias("b")))

        offers = F.filter(F.transform(F.sequence(F.lit(1), F.least(end, F.lit(longest))), offer), lambda o: o.isNotNull())
        return F.concat(state, F.array(_let(offers, lambda some: F.aggregate(some, F.element_at(some, 1), lambda a, o: F.when(o["s"] >= a["s"], o).otherwise(a)))))

    start = F.array(F.struct(F.lit(0.0).alias("s"), F.array(F.lit(0)).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.length("word")), start, step, lambda s: F.element_at(s, -1)["b"])


@contextlib.contextmanager
def _grouping_by_hash(spark):
    """Lets collect_list hold all groups of a partition, of which there are about GROUPED; past 128 of them Spark would sort all edges."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(2 * GROUPED))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def encoded_words(words: DataFrame, path: str, unigram: bool = False, places: int = PLACES) -> DataFrame:
    """(word, n, ids): the piece ids of each distinct word or segment, in order. The result is an intermediate table."""
    spark = words.sparkSession
    table = pieces(spark, path)
    longest = int(table.agg(F.max(F.length("piece"))).first()[0])
    ids = byte_ids(path)
    words = _base.spill(words, "words")
    parts = max(words.count() // GROUPED + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = words.repartition(parts, "word")
    short, long = dealt.filter(F.length("word") <= places), words.filter(F.length("word") > places).repartition("word")
    if unigram:
        folded = lattice(dealt, table, longest).withColumn("bounds", best_path(longest)).select("word", "n", _ids(F.col("bounds"), ids, longest).alias("ids"))
    else:
        folded = bit_lattice(short, table, longest).withColumn("bounds", merged_bits()).select("word", "n", bit_ids(ids).alias("ids"))
        folded = folded.union(lattice(long, table, longest).withColumn("bounds", merged(longest)).select("word", "n", _ids(F.col("bounds"), ids, longest).alias("ids")))
    with _grouping_by_hash(spark):
        codes = _base.spill(folded.select("word", "n", F.col("ids").cast("array<int>").alias("ids")), "codes")
    _base.forget(words)
    return codes


class Numbers(dict):
    """Numbers things by their first coming."""

    def __missing__(self, thing) -> int:
        self[thing] = found = len(self)
        return found


def _packed(x: np.ndarray) -> bytes:
    """Non-negative numbers below 2^31 by planes of their bytes, which compress better than the numbers."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(np.asarray(x, "<i4").view(np.uint8).reshape(-1, 4).T), "zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T).view("<i4").ravel()


def _packed_names(names: list[str]) -> bytes:
    """Segments have no spaces, which are marks by then."""
    raw = " ".join(names).encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked_names(raw: bytes) -> list[str]:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True).decode().split(" ")


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Chunk:
    """Some texts as numbers of words, and words as numbers of segments, each distinct one once."""

    def __init__(self):
        self.words, self.numbers, self.sizes, self.rows, self.letters = Numbers(), [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows (id, size, check, text)."""
        self.rows.append(batch.select(range(3)))
        get = self.words.__getitem__
        for t in batch.column(3).to_pylist():
            words = bare_words_in(t)
            self.numbers.append(np.fromiter(map(get, words), np.int32, len(words)))
            self.sizes.append(len(words))
            self.letters += len(t)

    def row(self, chunk: int, cutter: Cutter, parts: int) -> pa.RecordBatch:
        """One row; segments are in order of the part that the hash of each belongs to."""
        words, numbers, found = [w[1:] if w[:1] == " " else SPACE + w for w in self.words], np.concatenate([np.zeros(0, np.int32), *self.numbers]), Numbers()
        # The most frequent word first. Words that occur once come last, as they come in the texts, where a zero will do for each.
        n = np.bincount(numbers, minlength=len(words))
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(n), np.int32)
        rank[order] = np.arange(1, len(n) + 1)
        words, n = [words[i] for i in order.tolist()], n[order]
        rank[rank > int((n > 1).sum())] = 0
        numbers = rank[numbers]
        each, flat = [], []
        for i in range(0, len(words), CUT):
            cut = cutter.cut(words[i : i + CUT])
            each.append(np.fromiter(map(len, cut), np.int32, len(cut)))
            flat.append(np.fromiter(map(found.__getitem__, chain.from_iterable(cut)), np.int32, int(each[-1].sum())))
        each, flat = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (each, flat))
        count = np.bincount(flat, np.repeat(n, each), len(found)).astype(np.int64)
        names = list(found)
        part = np.fromiter((crc32(s.encode()) % parts for s in names), np.int32, len(names))
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        names, count = [names[i] for i in order.tolist()], count[order]
        some, begins = np.unique(part[order], return_index=True)
        slices = [slice(a, b) for a, b in zip(begins.tolist(), [*begins.tolist()[1:], len(names)])]
        inner = pa.StructArray.from_arrays(
            [pa.array(some, pa.int32()), pa.array([_packed_names(names[x]) for x in slices], pa.binary()), pa.array([_packed(count[x]) for x in slices], pa.binary())], ["part", "names", "counts"]
        )
        rows = pa.Table.from_batches(self.rows).combine_chunks()
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        blobs = [pa.array([_packed(x)], pa.binary()) for x in (np.array(self.sizes, np.int32), numbers, each, place[flat] if len(flat) else flat)]
        columns = [pa.array([chunk], pa.int64()), *(one(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)) for c in rows.columns), *blobs, one(inner)]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "id", "size", "check", *BLOBS, "parts"])


BLOBS = ("sizes", "numbers", "each", "segments")


def chunks_of(rows: DataFrame, path: str, parts: int, held: int) -> DataFrame:
    """Rows (id, size, check, text) in chunks of some `held` distinct words: one row a chunk."""
    own = rows.schema["id"].dataType.simpleString()

    @_base.tidy
    def run(batches):
        from pyspark import TaskContext

        number, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches:
            chunk.add(batch)
            if len(chunk.words) >= held or chunk.letters >= LETTERS:
                yield chunk.row(number, cutter(path), parts)
                number, chunk = number + 1, Chunk()
        if chunk.rows:
            yield chunk.row(number, cutter(path), parts)

    kinds = f"chunk long, id array<{own}>, size array<long>, check array<long>, {' binary, '.join(BLOBS)} binary, parts array<struct<part: int, names: binary, counts: binary>>"
    return rows.mapInArrow(run, kinds)


def _segments(chunks: DataFrame, parts: int) -> DataFrame:
    """(word, n): the distinct segments of all chunks and how often they occur, counted part by part."""

    @_base.tidy
    def run(batches):
        counts: Counter = Counter()
        now = None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part, names, ns in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and counts:
                    yield out()
                    counts = Counter()
                now = part
                for w, n in zip(_unpacked_names(names), _unpacked(ns).tolist()):
                    counts[w] += n
        if counts:
            yield out()

    return chunks.select(F.explode("parts").alias("p")).select("p.*").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "word string, n long")


def _frequent(codes: DataFrame, frequent: int) -> Column:
    """Whether a segment is one of the at most `frequent` ones whose ids are broadcast. Counts in steps: without a sort; at most 16 x 63 rows."""
    few = F.length("word") <= BROADCAST
    step = F.floor(F.log2("n") * 16).cast("int")
    least, left = None, frequent
    for p, k in sorted(codes.filter(few).groupBy(step.alias("p")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        left -= k
        if left < 0:
            break
        least = p
    return few & (step >= least) if least is not None else F.lit(False)


@lru_cache(maxsize=4)
def _flat_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What all ids stand for, one after the other, where each begins and how long it is."""
    names = piece_bytes(path)
    sizes = np.array([len(b) for b in names], np.int64)
    return np.frombuffer(b"".join(names), np.uint8), np.cumsum(sizes) - sizes, sizes


def _decoded_lists(ids: np.ndarray, ends: np.ndarray, path: str) -> pa.Array:
    """The bytes that lists of ids stand for: pieces and bytes put together."""
    raw, begins, sizes = _flat_bytes(path)
    long = sizes[ids]
    out = raw[_runs(begins[ids], long)]
    offsets = np.append(0, np.cumsum(long))[ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str, frequent: int) -> DataFrame:
    """(id, size, check, ids, back), one row per row of docs: bytes of the text as the model sees it, and their hash; the bytes that the ids stand for.

    Texts are read and cut once. Chunks wait in buckets for the ids of their segments: these meet by parts
    of all segments, and only they are sent, never the texts.
    """
    spark = docs.sparkSession
    _base.ready(spark)
    kind = np.dtype("<u2" if processor(path).get_piece_size() < 65535 else "<u4")
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = F.when(text == "", "").otherwise(F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(seen).cast("long").alias("size"), F.xxhash64(seen).alias("check"), text.alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    chunks = _base.bucketed(chunks_of(rows, path, parts, HELD), "chunks", parts, "chunk")
    codes = encoded_words(_segments(chunks, parts), path)
    often = _frequent(codes, frequent)
    top = codes.filter(often).select("word", "ids").toArrow()
    flat, ends = top["ids"].combine_chunks().flatten().to_numpy().astype(kind).tobytes() if top.num_rows else b"", (np.cumsum([0, *map(len, top["ids"].to_pylist())]) * kind.itemsize).tolist()
    shared = spark.sparkContext.broadcast({w: flat[a:b] for w, a, b in zip(top["word"].to_pylist(), ends, ends[1:])})  # at most `frequent` segments
    del top, flat, ends
    own = docs.schema[id_col].dataType.simpleString()

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each chunk the ids of its segments of this part that are not broadcast, in order; a size of 0 for the others."""
        known = {w: np.array(i, kind).tobytes() for w, i in zip(right["word"].to_pylist(), right["ids"].to_pylist())}
        out = []
        for names in left["names"].to_pylist():
            got = [known.get(w, b"") for w in _unpacked_names(names)]
            raw = b"".join(got)
            out.append((_packed(np.fromiter(map(len, got), np.int32, len(got)) // kind.itemsize), _packed(np.frombuffer(raw, kind).astype(np.int32))))
        return pa.table({"chunk": left["chunk"], "part": left["part"], "lengths": pa.array([a for a, _ in out], pa.binary()), "fills": pa.array([b for _, b in out], pa.binary())})

    @_base.tidy
    def filled(batches):
        known = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
                fills = {f["part"]: f for f in row["fills"].as_py() or []}
                for p in row["parts"].as_py():
                    names = _unpacked_names(p["names"])
                    fill = fills.get(p["part"])
                    size = _unpacked(fill["lengths"]).tolist() if fill else [0] * len(names)
                    raw, at, got = _unpacked(fill["fills"]).astype(kind).tobytes() if fill else b"", 0, []
                    for w, n in zip(names, size):
                        end = at + n * kind.itemsize
                        got.append(raw[at:end] if n else known[w])
                        at = end
                    lengths.append(np.fromiter(map(len, got), np.int64, len(got)) // kind.itemsize)
                    ids.append(np.frombuffer(b"".join(got), kind).astype(np.int32))
                ids, lengths = np.concatenate(ids), np.concatenate(lengths)
                sizes, numbers, each, segments = (_unpacked(row[n].as_py()) for n in BLOBS)
                once = numbers == 0
                numbers = np.where(once, len(each) - once.sum() + np.cumsum(once), numbers) - 1
                # Segments to words, then words to texts.
                word = np.concatenate([np.zeros(0, np.int32), ids[_runs((np.cumsum(lengths) - lengths)[segments], lengths[segments])]])
                long = np.diff(np.append(0, np.cumsum(lengths[segments]))[np.append(0, np.cumsum(each))])
                starts, last = np.cumsum(long) - long, np.append(0, np.cumsum(sizes))
                docs_, done = [row[n].values for n in ("id", "size", "check")], 0
                while done < len(sizes):
                    to = max(done + 1, int(np.searchsorted(last, last[done] + WORDS, "right")) - 1)
                    some = numbers[last[done] : last[to]]
                    flat = word[_runs(starts[some], long[some])]
                    ends = np.append(0, np.cumsum(long[some]))[last[done : to + 1] - last[done]].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(x.slice(done, to - done) for x in docs_), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())), _decoded_lists(flat, ends, path)], ["id", "size", "check", "ids", "back"])
                    done = to

    left = chunks.select("chunk", F.explode("parts").alias("p")).select("chunk", "p.part", "p.names")
    right = codes.filter(~often).select(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(parts)).cast("int").alias("part"), "word", "ids")
    fills = left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(met, "chunk long, part int, lengths binary, fills binary")
    fills = fills.groupBy("chunk").agg(F.collect_list(F.struct("part", "lengths", "fills")).alias("fills"))
    done = chunks.join(fills.hint("shuffle_hash"), "chunk", "left").select("id", "size", "check", *BLOBS, F.col("parts"), "fills")
    return done.mapInArrow(filled, f"id {own}, size long, check long, ids array<int>, back binary").withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(id, ids) of whole texts, one row per row of docs; null and empty texts have no ids."""
    return _coded(docs, path, id_col, text_col, frequent).select(id_col, "ids")


def decoded_bytes(ids: Column, path: str) -> Column:
    """UTF-8 bytes of the text that ids stand for, with marks: pieces and bytes put together."""
    names = F.split(F.lit(",".join(b.hex() for b in piece_bytes(path))), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(names, (i + 1).cast("int"))), ""))


def decoded(ids: Column, path: str) -> Column:
    """The text that ids stand for, with marks."""
    return F.decode(decoded_bytes(ids, path), "UTF-8")


def document_codes(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs: id, n_pieces, ids, round_trip (whether decoding gives the text with its marks, by length and 64-bit hash).

    Null texts count as empty: no ids, and the round trip holds. Ids and whole rows may repeat.
    Other columns are not read.
    """
    both = _coded(docs, path, id_col, text_col, frequent)
    same = (F.octet_length("back") == F.col("size")) & (F.xxhash64("back") == F.col("check"))
    return both.select(id_col, F.size("ids").alias("n_pieces"), "ids", same.alias("round_trip"))


def word_codes(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """One row per distinct segment of all texts: word, n (occurrences), n_pieces, ids, round_trip (whether decoding gives the segment)."""
    coded = encoded_words(segments_of(docs, path, text_col), path)
    return coded.select("word", "n", F.size("ids").alias("n_pieces"), "ids", (decoded_bytes(F.col("ids"), path) == F.col("word").cast("binary")).alias("round_trip"))


def op6_sentencepiece_lattice(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return document_codes(_base.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
