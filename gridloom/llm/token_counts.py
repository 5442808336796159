"""Token counts by a compiled finite-state transducer.

The piece vocabulary of a byte-fallback BPE model is compiled, as far as texts ask for it, into a
deterministic transducer over code points. After any prefix of a text, the last token of the
prefix's own encoding is known, and a token may follow another one just if the model would encode
the two together as these two; so the encoding of a longer prefix depends on the last tokens at
those earlier places only where a piece that is still open has begun. These make up a state, and
each transition carries by how many tokens the count changes.

Texts are cut into chunks that run side by side. A chunk's state map is constant from its first
word start on, as every state leads to the same one there; so tails of all chunks run at once. The
map of what comes before it, the head, is found for the states in which the chunk before may end:
first for a guess in all chunks at once, then for the states that this gives in the chunks before,
until no new one comes up, which is soon, as different states lead to the same one after a few
characters. A parallel prefix scan then composes the maps pairwise, two, four, eight chunks at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base

SPACE = "▁"
#: Documents above this many tokens are marked.
LIMIT = 4096
#: Code points of a chunk.
CHUNK = 1024
#: Cells of a worker's transition table (4 bytes each); beyond it the table starts anew.
CELLS = 24_000_000
#: Token pairs whose fit is remembered when the table starts anew.
PAIRS = 600_000
#: Code points that run together; a longer text is run in parts, from the state in which the part before ended.
BATCH = 2_000_000
_SHIFT, _BIAS = 6, 32


class Transducer:
    """Lazily determinised transducer of a SentencePiece BPE model with byte fallback."""

    def __init__(self, pieces: dict[str, float]):
        self.score = pieces
        self.trie: dict = {}
        self.inside: set[str] = set()
        for p in pieces:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
            self.inside.update(p[i : i + 2] for i in range(len(p) - 1))
        chars = {c for p in pieces for c in p}
        assert all(c in pieces for c in chars), "a character of a piece is no piece itself"
        self.chars = chars
        self.fits: dict[tuple[str | None, str], bool] = {}
        self.col_of = np.full(0x110000, -1, np.int32)
        self.reset()

    def reset(self) -> None:
        """Forgets all states; columns 0 to 3 stand for characters without a piece, of 1 to 4 bytes."""
        if len(self.fits) > PAIRS:
            self.fits.clear()
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.columns: list[str] = ["", "", "", ""]
        self.col_of[:] = -1
        self.width = 128
        self.table = np.full((1024, self.width), -1, np.int32)
        self.empty = self.state((None, ()))
        self.start = self.step(self.empty, SPACE) >> _SHIFT

    def encode(self, text: str) -> list[str]:
        """The model's merges on a short text: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fit(self, last: str | None, token: str) -> bool:
        """Whether the encoding of `last` and `token` together is these two."""
        known = self.fits.get((last, token))
        if known is None:
            known = self.fits[last, token] = self.encode((last or "") + token) == ([token] if last is None else [last, token])
        return known

    def state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            if found >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return found

    def step(self, state: int, char: str, n_bytes: int = 0) -> int:
        """The packed transition: next state and the change of the count. A state is the last token and, for each open piece, its place in the trie, the token before it and the count before it. n_bytes: of a character without a piece, which is that many tokens."""
        last, opened = self.states[state]
        if n_bytes:
            return self.state((None, ())) << _SHIFT | n_bytes + _BIAS
        if last is not None and last[-1] + char not in self.inside:
            last = None  # no piece crosses this place
        found, items = None, []
        for path, before, count in (*opened, ("", last, 0)):
            node = self.trie
            for c in path + char:
                node = node.get(c)
                if node is None:
                    break
            if node is None:
                continue
            if found is None and "" in node and self.fit(before, path + char):
                found = (path + char, count + 1)
            if len(node) > ("" in node):
                items.append((path + char, before, count))
        token, change = found
        return self.state((token, tuple((p, b, n - change) for p, b, n in items))) << _SHIFT | change + _BIAS

    def code(self, cps: np.ndarray) -> np.ndarray:
        """Column numbers of code points."""
        cols = self.col_of[cps]
        if (cols < 0).any():
            for cp in np.unique(cps[cols < 0]):
                c = SPACE if cp == 32 else chr(cp)
                if c not in self.chars:
                    self.col_of[cp] = len(c.encode()) - 1
                elif c == SPACE and self.col_of[32 if cp != 32 else 0x2581] >= 0:
                    self.col_of[cp] = self.col_of[32 if cp != 32 else 0x2581]
                else:
                    self.col_of[cp] = len(self.columns)
                    self.columns.append(c)
            if len(self.columns) > self.width:
                wide = np.full((len(self.table), 2 * max(self.width, len(self.columns) // 2)), -1, np.int32)
                wide[:, : self.width] = self.table
                self.table, self.width = wide, wide.shape[1]
            cols = self.col_of[cps]
        return cols

    def run(self, cols: np.ndarray, begin: np.ndarray, end: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs many stretches side by side; their last states and changes of count."""
        order = np.argsort(begin - end, kind="stable")
        at, length, state = begin[order], (end - begin)[order], states[order].astype(np.int64)
        count = np.zeros(len(order), np.int64)
        n = int(np.searchsorted(-length, 0, "left"))
        for k in range(int(length[0]) if len(length) else 0):
            while length[n - 1] <= k:
                n -= 1
                n = int(np.searchsorted(-length[:n], -k, "left")) if length[n - 1] <= k else n
            cell = state[:n] * self.width + cols[at[:n] + k]
            got = self.table.ravel()[cell]
            if got.min() < 0:
                for x in np.unique(cell[got < 0]).tolist():
                    s, c = divmod(x, self.width)
                    v = self.step(s, self.columns[c], c + 1 if c < 4 else 0)
                    self.table[s, c] = v
                got = self.table.ravel()[cell]
            state[:n] = got >> _SHIFT
            count[:n] += (got & ((1 << _SHIFT) - 1)) - _BIAS
        out_state, out_count = np.empty_like(state), np.empty_like(count)
        out_state[order], out_count[order] = state, count
        return out_state, out_count

    def counts(self, texts: list[str], chunk: int = CHUNK, most: int = BATCH) -> np.ndarray:
        """Tokens of each text, as the model's library counts them."""
        out = np.zeros(len(texts), np.int64)
        for i, j in blocks(texts, most):
            key = None
            # A text of over `most` characters comes last in its block.
            for at in range(0, max(len(texts[j - 1]) if j > i else 0, 1), most):
                part = texts[i:j] if not at and len(texts[j - 1]) <= most else [texts[j - 1][at : at + most]]
                if not at and len(texts[j - 1]) > most and j - i > 1:
                    out[i : j - 1] += self._counts(texts[i : j - 1], chunk, None)[0]
                n, key = self._counts(part, chunk, key)
                out[i:j] += n if len(part) == j - i else np.append(np.zeros(j - i - 1, np.int64), n)
        return out + np.fromiter((len(t) > 0 for t in texts), np.int64, len(texts))

    def _counts(self, texts: list[str], chunk: int, key: tuple | None) -> tuple[np.ndarray, tuple]:
        """Changes of count over texts, each from its begin or from state `key`, and the state at the end of the last."""
        if len(self.states) * self.width > CELLS:
            self.reset()
        entry = self.start if key is None else self.state(key)
        raw = [t.encode("utf-32-le") for t in texts]
        size = np.array([len(b) // 4 for b in raw], np.int64)
        cps = np.frombuffer(b"".join(raw), np.uint32)
        cols = self.code(cps)
        doc_end = np.cumsum(size)
        doc_begin = doc_end - size
        n_chunks = -(-size // chunk)
        doc = np.repeat(np.arange(len(texts)), n_chunks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        begin = doc_begin[doc] + nth * chunk
        end = np.minimum(begin + chunk, doc_end[doc])
        # A word start: white space after something else. From there on a chunk's map is constant.
        space = (cps == 32) | (cps == 0x2581)
        sync = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        first = np.append(sync, len(cps) + 1)[np.searchsorted(sync, begin + (nth > 0), "left")] if len(begin) else begin
        constant = (nth > 0) & (first < end)
        head_end = np.where(constant, first, end)
        total = np.zeros(len(texts), np.int64)
        exits = np.full(len(begin), -1, np.int64)
        tail = np.flatnonzero(constant)
        exits[tail], n = self.run(cols, first[tail], end[tail], np.full(len(tail), self.start))
        # The run starts before the white space itself, in a state that nothing crosses.
        np.add.at(total, doc[tail], n)
        if len(tail):
            exits[tail], n2 = self.run(cols, first[tail], end[tail], np.full(len(tail), self.empty))
            np.add.at(total, doc[tail], n2 - n)
        if not len(begin):
            return total, self.states[entry]
        # State maps of the heads, as (chunk, entry state) to (exit state, change of count), for all states that may come up.
        where = np.arange(len(begin))
        known = np.zeros(0, np.int64)
        columns: list[list[np.ndarray]] = [[], [], []]
        # The state before is known at a text's begin and after a constant map; else the guess is that nothing is open.
        guess = np.where(nth == 0, entry, np.where(exits[where - 1] >= 0, exits[where - 1], self.empty))
        todo, width = where << 32 | guess, 1
        # The last chunk that a head's exit can reach: the next with a constant map, or the text's last.
        final = np.flatnonzero(constant | np.append(nth[1:] == 0, True))
        final = final[np.searchsorted(final, where)]
        while len(todo):
            c, s = todo >> 32, todo & 0xFFFFFFFF
            out, n = self.run(cols, begin[c], head_end[c], s)
            out = np.where(constant[c], exits[c], out)
            for x, y in zip(columns, (todo, out, n)):
                x.append(y)
            known = np.union1d(known, todo)
            more = ~constant[c] & (c + 1 < len(begin))
            more[more] = nth[c[more] + 1] > 0
            todo = np.setdiff1d(c[more] + 1 << 32 | out[more], known)
            if len(todo):
                # Where states go on and on, as in a row of one character, they may well enter the chunks after the next too.
                width = max(1, min(2 * width, len(begin) // len(todo)))
                c, s = np.repeat(todo >> 32, width), np.repeat(todo & 0xFFFFFFFF, width)
                at = c + np.tile(np.arange(width), len(todo))
                todo = np.setdiff1d(at[at <= final[c]] << 32 | s[at <= final[c]], known)
        pair, out, n = (np.concatenate(x) for x in columns)
        order = np.argsort(pair)
        pair, out, n = pair[order], out[order], n[order]
        # The scan: each pair points to the one that its exit enters; composing pointers joins twice as many chunks each round.
        c = pair >> 32
        inner = (c + 1 < len(begin)) & (nth[np.minimum(c + 1, len(begin) - 1)] > 0)
        to = np.append(np.where(inner, np.searchsorted(pair, np.minimum(c + 1, len(begin) - 1) << 32 | out), len(pair)), len(pair))
        n = np.append(n, 0)
        last = np.append(np.where(inner, -1, out), -1)
        while (to < len(pair)).any():
            n = n + n[to]
            last = np.where(last >= 0, last, last[to])
            to = to[to]
        heads = np.searchsorted(pair, np.flatnonzero(nth == 0) << 32 | entry)
        total[doc[nth == 0]] += n[heads]
        return total, self.states[int(last[heads[-1]])]


def load(path: str) -> Transducer:
    """The transducer of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return Transducer({sp.id_to_piece(i): sp.get_score(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))})


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = load(path)
    return _loaded[path]


def blocks(texts: list[str], most: int):
    """Runs of texts of about `most` characters together."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit. Null texts count as empty: no bytes, no tokens. No other column is read."""
    _base.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    @_base.tidy
    def run(batches):
        t = transducer(model)
        for batch in batches:
            ids, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            n = t.counts(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_base.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
