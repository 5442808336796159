"""Packing of tokenised documents into as few fixed-length sequences as possible.

Documents are tokenised where they are read; only the numbers of pieces of each length, at most
`limit` of them, come to the driver. There bin completion works on lengths: around the longest one
left, a branch-and-bound search enumerates fillings of the rest of a sequence, in order of
decreasing length, keeps the best-fit one as the incumbent and prunes a branch once what is left
cannot waste less. A filling is then used as often as the numbers allow. Where this takes more
sequences than a lower bound, it is the incumbent of a search that goes back over all sequences:
other undominated fillings (none of which could take a longer piece in place of shorter ones), also
used less often, within the waste that one sequence less would allow. That search ends after SEARCH
steps, and sequences() says whether the bound or a whole search proves its result.

What comes out is for each length the stretches of ranks and their sequences, a table whose size
depends on the number of lengths alone; pieces find their place in it by their rank among pieces of
their length, which is counted in blocks, never in one task.
"""

from __future__ import annotations

import bisect
import itertools
import unicodedata
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _base

#: Tokens of a sequence, id at each document's end, blocks in which ranks are counted, steps of the first search for a filling, and of the search over all sequences.
LIMIT, END, SALTS, STEPS, SEARCH = 4096, 1, 64, 2000, 200_000


# ---- ids -------------------------------------------------------------------------------------


class WordCoder:
    """Ids of whole texts, word by word: this tokenizer lower-cases, drops white space, and none of its tokens crosses it.

    The marks that end a word after a letter or an ASCII digit are a pre-token of their own, so that
    words are looked up without them.
    """

    #: Words of each of the two generations that are remembered.
    KEPT = 250_000
    #: ASCII marks but for the apostrophe, which may begin a pre-token with letters.
    MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        #: The characters that byte-level models have for bytes.
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.known = _Known(self)
        self.older: dict[bytes, bytes] = {}

    def encode(self, word: bytes) -> bytes:
        """Ids of one word, found by its parts."""
        found = self.older.get(word)
        if found is not None:
            return found
        if word[-1] in self.MARKS and b"<|" not in word:
            head = word.rstrip(self.MARKS)
            # As the tokenizer sees it, a letter may end in a mark: "İ" becomes two characters.
            if head[-1:].isalnum() or head[-1:] > b"\x7f" and unicodedata.normalize("NFC", head.decode()[-1]).lower()[-1].isalpha():
                return self.known[head] + self.known[word[len(head) :]]
        low = word if b"<|" in word else word.lower()
        if low != word:
            return self.known[low]
        text = word.decode()
        # Words of letters only need no normalising and are one pre-token: the model takes them as they are.
        if text.isalpha():
            if text.isascii():
                return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            if text.casefold() == text == text.lower() and unicodedata.is_normalized("NFC", text):
                return array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.shown))]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > self.KEPT:
            self.known, self.older = _Known(self), dict(self.known)
        get = self.known.__getitem__
        return [b"".join(map(get, t.encode().split())) for t in texts]

    def forget(self) -> None:
        """Gives back the memory of all words."""
        self.known, self.older = _Known(self), {}


class _Known(dict):
    """Remembers the ids of words."""

    def __init__(self, coder: WordCoder):
        self.coder = coder

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.coder.encode(word)
        return found


_coders: dict[str, WordCoder] = {}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end: int = END, keep_ids: bool = True) -> DataFrame:
    """(id, row, piece, start, length, ids_crc32, ids if keep_ids): each text's ids and `end`, cut into pieces of `limit` ids; the last may be shorter. ids are little-endian unsigned 32-bit numbers."""
    kind = docs.schema[id_col].dataType.simpleString()

    @_base.tidy
    def run(batches):
        if tokenizer not in _coders:
            _coders[tokenizer] = WordCoder(tokenizer)
        coder, tail = _coders[tokenizer], np.array([end], "<u4").tobytes()
        try:
            yield from coded(batches, coder, tail)
        finally:
            coder.forget()

    def coded(batches, coder, tail):
        for batch in batches:
            all_ids, all_keys, all_texts = batch.column(0), batch.column(1), [x or "" for x in batch.column(2).to_pylist()]
            at, n = 0, 0
            for i, t in enumerate(all_texts):
                n += len(t)
                if n < 500_000 and i + 1 < len(all_texts):
                    continue
                texts, base = all_texts[at : i + 1], at
                at, n = i + 1, 0
                rows = []
                for d, ids in enumerate(coder.ids(texts)):
                    ids += tail
                    for p, s in enumerate(range(0, len(ids), 4 * limit)):
                        part = ids[s : s + 4 * limit]
                        rows.append((base + d, p, s // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                cols = list(zip(*rows))
                place = pa.array(cols[0], pa.int64())
                out = [all_ids.take(place), all_keys.take(place), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                yield pa.RecordBatch.from_arrays([*out, pa.array(cols[5], pa.binary())] if keep_ids else out, names)

    _base.ready(docs.sparkSession)
    keyed = docs.select(F.col(id_col), _base.row_key(F.col(id_col), F.col(text_col)), F.col(text_col))
    names = ["id", "row", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    return keyed.mapInArrow(run, f"id {kind}, row binary, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


# ---- bin completion --------------------------------------------------------------------------


def completion(lengths: list[int], left: dict[int, int], room: int, steps: int = STEPS) -> tuple[int, list[int]]:
    """(waste, filling) of room: lengths in decreasing order, each at most left[length] times.

    Depth first, longest first: the first filling is best fit by decreasing length and becomes the
    incumbent; a filling that a longer piece dominates comes after that one and wastes more. A branch that can't waste less than the incumbent, because all items up
    to its length together don't fill enough, is pruned; a filling without waste ends the search.
    `lengths` is sorted; after `steps` branches the incumbent is taken.
    """
    best_waste, best = room, []
    sums = [0]
    for x in lengths[: bisect.bisect_right(lengths, room)]:
        sums.append(min(sums[-1] + x * left[x], room))
    stack: list[tuple[int, int, tuple]] = [(bisect.bisect_right(lengths, room), room, ())]
    used = 0
    while stack and used < steps and best_waste:
        used += 1
        upto, rest, chosen = stack.pop()
        if rest - sums[upto] >= best_waste:
            continue
        i = bisect.bisect_right(lengths, rest, 0, upto) - 1
        if i < 0:
            if rest < best_waste:
                best_waste, best = rest, list(chosen)
            continue
        if rest < best_waste:
            best_waste, best = rest, list(chosen)
        x = lengths[i]
        taken = 0
        for y in reversed(chosen):
            if y != x:
                break
            taken += 1
        if i > 0:  # without x
            stack.append((i, rest, chosen))
        if taken < left[x]:
            stack.append((i + 1, rest - x, (*chosen, x)))
    return best_waste, best


#: How many pieces in a sequence the bound by numbers of pieces looks at.
CARDINALITY = 64


def least(counts: dict[int, int], limit: int = LIMIT) -> int:
    """No packing has fewer sequences: total length over limit; for each a, what pieces over limit - a and over half a sequence leave for those from a to half; and for each k, pieces that count floor((k + 1) x / limit) parts of k, of which no sequence holds more than all."""
    x = np.array(sorted(k for k, n in counts.items() if n), np.int64)
    n = np.array([counts[k] for k in x.tolist()], np.int64)
    many, much = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * x))
    half = np.searchsorted(x, limit // 2, "right")
    bound = -(-int(much[-1]) // limit)
    for i in range(half):
        top = np.searchsorted(x, limit - x[i], "right")  # from here on, nothing of x[i] or more fits beside
        free = int(many[top] - many[half]) * limit - int(much[top] - much[half])
        bound = max(bound, int(many[-1] - many[half]) + max(0, -(-(int(much[half] - much[i]) - free) // limit)))
    for k in range(1, CARDINALITY + 1):
        parts, even = (k + 1) * x // limit, (k + 1) * x % limit == 0  # an even share counts as what it is
        odd, exact = int((n * parts)[~even].sum()), int((n * parts)[even].sum())
        bound = max(bound, -(-(odd * (k + 1) + exact * k) // (k * (k + 1))))
    return max(bound, int(many[-1] - many[half]))


def spread(bits: int, n: int) -> int:
    """The union of bits moved up by 0 to n places."""
    done = 0
    while done < n:
        by = min(done + 1, n - done)
        bits |= bits << by
        done += by
    return bits


def dominated(filling: list[int], rest: int, spare: int) -> bool:
    """Whether some pieces of a filling can make room for one longer piece of those left over (spare, a set as bits) without a change of the others.

    The packing that has the longer piece here and these pieces in its place is as good, so that
    the filling need not be looked at. The first piece, around which the others are, stays.
    """
    sums = 1
    for x in filling[1:]:
        sums |= sums << x
    return rest > 0 and bool(spread((sums & ~1) << 1, rest - 1) & spare)


def fillings(lengths: list[int], left: dict[int, int], limit: int, slack: int, spent: list[int], steps: int):
    """(waste, filling) around the longest piece left, for all undominated fillings that waste at most `slack`, longest first: no piece left over fits beside one, or in place of some of its pieces that are shorter together.

    Both tables may change between two fillings, if they are as before when the next one is asked for.
    """
    longest = lengths[-1]
    room = limit - longest
    # What all pieces up to a length fill together, as far as that is less than the room.
    sums = [0]
    for x in lengths:
        if x > room or sums[-1] == room:
            break
        sums.append(min(sums[-1] + x * (left[x] - (x == longest)), room))
    stack: list[tuple[int, int, int, tuple]] = [(bisect.bisect_right(lengths, room), room, room + 1, ())]
    spare = sum(1 << x for x in lengths if x <= room)
    while stack:
        spent[0] += 1
        if spent[0] > steps:
            return
        upto, rest, skipped, chosen = stack.pop()
        # What stays free must be within the slack, and too short for every piece that was passed over.
        if rest - sums[min(upto, len(sums) - 1)] > min(slack, skipped - 1):
            continue
        i = bisect.bisect_right(lengths, rest, 0, upto) - 1
        if i < 0:
            used = sum(1 << y for y in {*chosen, longest} if y <= room and chosen.count(y) + (y == longest) == left[y])
            if not dominated([longest, *chosen], rest, spare & ~used):
                yield rest, [longest, *chosen]
            continue
        x = lengths[i]
        if chosen.count(x) < left[x] - (x == longest):
            stack.append((i, rest, x, chosen))  # without x
            stack.append((i + 1, rest - x, skipped, (*chosen, x)))
        else:
            stack.append((i, rest, skipped, chosen))


def _choices(lengths: list[int], left: dict[int, int], limit: int, slack: int, spent: list[int], steps: int):
    """(times, need, filling, waste) around the longest piece left: each filling as often as it goes, then half as often, then all other numbers."""
    kept = []
    for waste, filling in fillings(lengths, left, limit, slack, spent, steps):
        need = Counter(filling)
        most = min(left[y] // n for y, n in need.items())
        most = min(most, slack // waste) if waste else most
        kept.append((most, need, filling, waste))
        yield kept[-1]
    for most, *rest in kept:
        if most > 3:
            yield most // 2, *rest
    for most, *rest in kept:
        for times in range(most - 1, 0, -1):
            if times != most // 2 or most <= 3:
                yield times, *rest


def improved(counts: dict[int, int], best: list[tuple[int, list[int]]], limit: int = LIMIT, steps: int = SEARCH) -> tuple[list[tuple[int, list[int]]], bool]:
    """The packing of fewest sequences that `steps` steps find, from an incumbent on, and whether none can have fewer.

    Branch and bound over whole packings: a branch ends once it wastes more than one sequence less
    than the incumbent has. Branches are taken in order of how often they leave the first choice,
    so that early sequences are looked at again as soon as late ones.
    """
    total, bound, spent = sum(x * n for x, n in counts.items()), least(counts, limit), [0]
    # Each round for a number of departures has its share of the steps, so that none shuts out the next.
    while sum(t for t, _ in best) > bound:
        slack, found, whole = (sum(t for t, _ in best) - 1) * limit - total, None, False
        for departures in itertools.count():
            upto = min(steps, spent[0] + max(steps // 10, 1))
            found, cut = _within(counts, limit, slack, departures, spent, upto)
            whole = not cut and spent[0] <= upto
            if found or whole or spent[0] >= steps:
                break
        if not found:
            return best, whole
        best = found
    return best, True


def _within(counts: dict[int, int], limit: int, slack: int, departures: int, spent: list[int], steps: int) -> tuple[list | None, bool]:
    """A packing that wastes at most `slack` and departs from the first choice so often at most, or None; and whether that bound left any branch out."""
    left = {x: n for x, n in counts.items() if n}
    lengths, cut = sorted(left), False

    def put(times: int, need: dict[int, int]) -> None:
        for y, n in need.items():
            before, left[y] = left[y], left[y] - times * n
            if before and not left[y]:
                del lengths[bisect.bisect_left(lengths, y)]
            elif left[y] and not before:
                bisect.insort(lengths, y)

    # Choices of each level, departures and slack there, and what the level has put.
    levels = [[_choices(lengths, left, limit, slack, spent, steps), departures, slack, None, 0]] if lengths else []
    while levels:
        level = levels[-1]
        choices, free, room, done, seen = level
        if done:
            put(-done[0], done[1])
            level[3] = None
        if seen and not free:
            # No departure is left here: only whether there was another choice matters.
            cut = cut or next(choices, None) is not None
            levels.pop()
            continue
        choice = next(choices, None) if spent[0] <= steps else None
        if choice is None:
            levels.pop()
            continue
        level[3], level[4] = choice, seen + 1
        put(choice[0], choice[1])
        if not lengths:
            return [(v[3][0], v[3][2]) for v in levels], cut
        room -= choice[0] * choice[3]
        levels.append([_choices(lengths, left, limit, room, spent, steps), free - (seen > 0), room, None, 0])
    return None, cut


def packed(counts: dict[int, int], limit: int = LIMIT, steps: int = STEPS, search: int = SEARCH) -> list[tuple[int, list[int]]]:
    """(times, filling) for all pieces: each filling has at most `limit` tokens and begins with its longest piece. The fewest sequences that `search` steps find."""
    return improved(counts, best_filled(counts, limit, steps), limit, search)[0]


def sequences(counts: dict[int, int], limit: int = LIMIT, steps: int = STEPS, search: int = SEARCH) -> dict[str, int | bool]:
    """For a report: sequences by best filling alone, after the search, the lower bound, and whether fewer are proved impossible."""
    first = best_filled(counts, limit, steps)
    best, proved = improved(counts, first, limit, search)
    return {"best_fit": sum(n for n, _ in first), "packed": sum(n for n, _ in best), "bound": least(counts, limit), "proved": proved}


def best_filled(counts: dict[int, int], limit: int = LIMIT, steps: int = STEPS) -> list[tuple[int, list[int]]]:
    """(times, filling) for all pieces by the best filling around the longest piece left, one after another."""
    left = {x: n for x, n in counts.items() if n}
    lengths = sorted(left)
    out = []
    while lengths:
        x = lengths[-1]
        left[x] -= 1
        if not left[x]:
            lengths.pop()
        _, fill = completion(lengths, left, limit - x, steps)
        left[x] += 1
        if left[x] == 1:
            lengths.append(x)
        filling = [x, *fill]
        need = {y: filling.count(y) for y in set(filling)}
        times = min(left[y] // n for y, n in need.items())
        for y, n in need.items():
            left[y] -= times * n
            if not left[y]:
                del lengths[bisect.bisect_left(lengths, y)]
        out.append((times, filling))
    return out


def places(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Stretches of ranks: pieces of `length` with ranks from `rank` on have sequences from `sequence` on, at `offset`; sorted by length and rank."""
    rows, next_rank, sequence = [], {}, 0
    for times, filling in patterns:
        offset = 0
        for x in filling:
            rank = next_rank.get(x, 0)
            rows.append((x, rank, sequence, offset))
            next_rank[x] = rank + times
            offset += x
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), cols.T))


# ---- over Spark ------------------------------------------------------------------------------


def packing(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end: int = END, salts: int = SALTS, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids (binary) if keep_ids.

    Null texts count as empty: a document with the end id alone. Every row of docs is a document of
    its own, also where ids or whole rows repeat. No sequence has more than `limit` tokens; only
    longer documents are cut. Other columns are not read.
    """
    spark = docs.sparkSession
    found = pieces(docs, tokenizer, id_col, text_col, limit, end, keep_ids)
    found = _base.spill(found.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts))), "pieces")
    # At most limit x salts rows.
    sizes = found.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("length", "ascending"), ("salt", "ascending")])
    length, n = sizes["length"].to_numpy(), sizes["n"].to_numpy()
    counts: dict[int, int] = {}
    for x, m in zip(length.tolist(), n.tolist()):
        counts[x] = counts.get(x, 0) + m
    before = np.cumsum(n) - n
    first = np.searchsorted(length, length, "left")
    base = {(x, s): b for x, s, b in zip(length.tolist(), sizes["salt"].to_pylist(), (before - before[first]).tolist())} if len(n) else {}
    shared = spark.sparkContext.broadcast((base, places(packed(counts, limit))))

    @_base.tidy
    def run(batches):
        base, p = shared.value
        step = int(p["rank"].max(initial=0)) + 1
        key = p["length"] * step + p["rank"]
        for batch in batches:
            length, salt, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "salt", "nth"))
            rank = nth - 1 + np.fromiter((base[x] for x in zip(length.tolist(), salt.tolist())), np.int64, len(length))
            at = np.searchsorted(key, length * step + np.minimum(rank, step - 1), "right") - 1
            out = [batch.column(batch.schema.get_field_index(c)) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*out, pa.array(p["sequence"][at] + rank - p["rank"][at]), pa.array(p["offset"][at])], names)

    kept = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    names = [*kept, "sequence_id", "offset"]
    fields = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in kept)
    ranked = found.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")).cast("long"))
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing(_base.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
