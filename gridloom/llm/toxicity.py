"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A feature is a character n-gram that occurs in a text; its value is the log ratio of its smoothed
counts in toxic and in other training texts, and a logistic regression learns a weight for each.
The classifier is fitted on a bounded sample of the labelled training rows (SAMPLE, by hash of the
id); scoring reads every whole text and has no bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base, hashing

U = np.uint64
#: Labelled rows of a class that are fitted on, characters of the rows of both classes (half of them for each, and what the other class leaves of its half), lengths of n-grams.
SAMPLE, CHARACTERS, GRAMS = 4000, 30_000_000, (4, 5, 6)
#: Buckets of the first count; least texts with an n-gram, and deviations from chance and log ratio, for it to be a feature (weak ones add up in long texts).
BUCKETS, LEAST, DEVIATIONS, RATIO = 1 << 22, 4, 4.5, 2.0
#: Lengths of the n-grams by which copies among training texts are told.
SKETCH = (20, 24)
#: Smoothing of counts, rounds and ridge of the fit, score from which a text counts as toxic.
ALPHA, ROUNDS, RIDGE, THRESHOLD = 0.5, 200, 1e-3, 0.3
_MUL, _ADD = U(0x9E3779B97F4A7C15), U(0x632BE59BD9B4E019)


def grams(texts: list[str], lengths=GRAMS):
    """Hashes of all n-grams of lower-cased texts, for each length: text numbers and hashes. A text begins and ends with a space."""
    raw = [f" {t.lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.fromiter((len(b) // 4 for b in raw), np.int64, len(raw))
    cps = np.frombuffer(b"".join(raw), np.uint32).astype(U)
    end = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    with np.errstate(over="ignore"):
        h = cps * _MUL + _ADD
        one = h
        for n in range(2, max(lengths) + 1):
            if len(cps) < n:
                return
            h = (h[: len(cps) - n + 1] ^ (h[: len(cps) - n + 1] >> U(29))) * _MUL + one[n - 1 :]
            if n in lengths:
                on = np.flatnonzero(np.arange(len(h)) + n <= end[: len(h)])
                yield owner[on], hashing.mix(h[on])


class Classifier:
    """Sorted n-gram hashes, the value (ratio times weight) of each, and the intercept."""

    def __init__(self, features: np.ndarray, values: np.ndarray, intercept: float):
        self.features, self.values, self.intercept = features, values, intercept
        self.maybe = np.zeros(BUCKETS, bool)
        self.maybe[(features % U(BUCKETS)).astype(np.int64)] = True

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities of label 1."""
        found = [np.zeros(0, np.int64)]
        for owner, h in grams(texts):
            on = np.flatnonzero(self.maybe[(h & U(BUCKETS - 1)).astype(np.int64)])
            h, owner = h[on], owner[on]
            at = np.minimum(np.searchsorted(self.features, h), max(len(self.features) - 1, 0))
            hit = self.features[at] == h if len(self.features) else np.zeros(len(h), bool)
            found.append(owner[hit].astype(np.int64) << 32 | at[hit])
        pairs = np.unique(np.concatenate(found))
        z = self.intercept + np.bincount(pairs >> 32, self.values[pairs & 0xFFFFFFFF] if len(pairs) else None, len(texts))[: len(texts)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _blocks(texts: list[str], most: int = 200_000):
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def telling(n1: np.ndarray, n0: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Where the number of toxic texts with an n-gram is far from what chance gives, and the ratio large."""
    n = n1 + n0
    share = pos / (pos + neg)
    spread = np.sqrt(np.maximum(n * share * (1 - share), 1e-9) + 1)
    ratio = np.log((n1 + ALPHA) / (pos + 2 * ALPHA)) - np.log((n0 + ALPHA) / (neg + 2 * ALPHA))
    return (n >= LEAST) & (np.abs(ratio) >= RATIO) & (np.abs(n1 - n * share) >= DEVIATIONS * spread)


def distinct(texts: list[str]) -> list[int]:
    """Places of texts that aren't copies or near copies of an earlier one, by their smallest long n-grams: copies would make all their n-grams telling."""
    seen: set = set()
    out = []
    for i, t in enumerate(texts):
        marks = [(n, int(h.min())) for n in SKETCH for _, h in grams([t], (n,)) if len(h)] or [(0, t)]
        if not any(m in seen for m in marks):
            out.append(i)
        seen.update(marks)
    return out


def fit(texts: list[str], labels: np.ndarray, prior: float | None = None, rounds: int = ROUNDS, ridge: float = RIDGE) -> Classifier:
    """prior: the share of label 1, where texts are a sample by class. Counts texts with each n-gram by class, keeps those whose ratio says most, then fits their weights."""
    labels = np.asarray(labels, bool)
    kept = distinct(texts)
    texts, labels = [texts[i] for i in kept], labels[kept]
    pos, neg = int(labels.sum()), int((~labels).sum())
    if not pos or not neg:
        return Classifier(np.zeros(0, U), np.zeros(0), 3.0 if pos else -3.0)
    # Buckets first, so that n-grams that can't be kept never stand in memory together.
    rough = np.zeros((2, BUCKETS), np.int32)
    for i, j in _blocks(texts):
        for owner, h in grams(texts[i:j]):
            key = np.unique(owner.astype(np.int64) * BUCKETS + (h % U(BUCKETS)).astype(np.int64))
            y = labels[i:j][key // BUCKETS]
            for c in (0, 1):
                rough[c] += np.bincount(key[y == c] % BUCKETS, minlength=BUCKETS).astype(np.int32)
    keep = telling(rough[1], rough[0], pos, neg)
    rows, hashes = [], []
    for i, j in _blocks(texts):
        for owner, h in grams(texts[i:j]):
            on = np.flatnonzero(keep[(h % U(BUCKETS)).astype(np.int64)])
            both = np.unique(np.stack([owner[on].astype(U) + U(i), h[on]], 1), axis=0) if len(on) else np.zeros((0, 2), U)
            rows.append(both[:, 0].astype(np.int64))
            hashes.append(both[:, 1])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    features, col = np.unique(h, return_inverse=True)
    n1 = np.bincount(col[labels[row]], minlength=len(features))
    n0 = np.bincount(col[~labels[row]], minlength=len(features))
    r = np.log((n1 + ALPHA) / (pos + 2 * ALPHA)) - np.log((n0 + ALPHA) / (neg + 2 * ALPHA))
    r[~telling(n1, n0, pos, neg)] = 0
    # Logistic regression on the scaled features, by gradient steps with momentum.
    value = r[col]
    y = labels.astype(float)
    prior = min(max(pos / len(texts) if prior is None else prior, 1e-6), 1 - 1e-6)
    each = np.where(labels, prior / pos, (1 - prior) / neg)
    w, b = np.full(len(features), 0.02), np.log(prior / (1 - prior))
    vw, vb = np.zeros_like(w), 0.0
    norm = np.maximum(np.bincount(row, value * value, len(texts)).mean(), 1e-9)
    rate = 2.0 / norm
    for _ in range(rounds):
        z = b + np.bincount(row, value * w[col], len(texts))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * each
        vw = 0.9 * vw - rate * (np.bincount(col, value * g[row], len(features)) + ridge * w / len(texts))
        vb = 0.9 * vb - 0.2 * g.sum()
        w, b = w + vw, b + vb
    values = w * r
    on = np.flatnonzero(values)
    return Classifier(features[on], values[on], float(b))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y): up to `sample` labelled rows of each class, by hash of the id; none that is held out."""
    wanted = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_base.held_out(F.col("doc_id"), 4))
    wanted = wanted.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("y"))
    picked = [wanted.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    both = F.broadcast(picked[0].union(picked[1]))  # at most 2 x sample rows of two numbers
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(both.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)), "id").select("id", "text", "y")


def within(ids: list, sizes: list[int], characters: int) -> list:
    """Ids in their order, without those whose text would go beyond `characters`; shorter ones after them still count. The shortest alone where every text is longer than that."""
    out, used = [], 0
    for i, n in zip(ids, sizes):
        if used + n <= characters:
            out.append(i)
            used += n
    return out or [i for _, i in sorted(zip(sizes, ids))[:1]]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, characters: int = CHARACTERS, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fits on at most `sample` texts of each class and half of `characters` for each, in order of the ids' hash; what a class leaves of its half goes to the other.

    A row that would go beyond its class's share is left out of the fit as a whole, and no other is
    for it: neither the rows after it nor the other class. A class all of whose texts are longer
    than that keeps the shortest one.
    """
    rows = _base.spill(training_rows(docs, labels, sample, id_col, text_col), "labelled")
    size = F.length("text").cast("long")
    order = rows.select("id", "y", size.alias("n"), F.xxhash64("id").alias("h")).toArrow().to_pandas().sort_values(["y", "h", "id", "n"], ascending=[False, True, True, True])
    # Rows of docs that share an id are taken or left together.
    each = order.groupby(["y", "h", "id"], sort=False, as_index=False)["n"].sum()
    half = characters // 2
    free = half - each.groupby("y")["n"].sum().clip(upper=half)
    ids = [(i,) for y, c in each.groupby("y") for i in within(c["id"].tolist(), c["n"].tolist(), half + int(free.drop(y).sum()))]
    kind = rows.schema["id"].dataType.simpleString()
    picked = rows.join(F.broadcast(rows.sparkSession.createDataFrame(ids, f"id {kind}")), "id").toArrow() if ids else rows.limit(0).toArrow()
    picked = picked.sort_by([("id", "ascending"), ("y", "ascending")])
    model = fit(picked["text"].to_pylist(), picked["y"].to_numpy() > 0)
    del picked
    _base.forget(rows)
    _base.release()
    return model


def scored(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs' id, score and predicted. Null texts count as empty. The model is bounded and broadcast."""
    _base.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.values, model.intercept))

    @_base.tidy
    def run(batches):
        own = Classifier(*shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            score = np.concatenate([np.zeros(0), *(own.scores(texts[i:j]) for i, j in _blocks(texts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: Classifier, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score `threshold` or more; all columns stay. Null texts count as empty; rows that repeat are scored each; ids are not read."""
    _base.ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.values, model.intercept))
    place = docs.columns.index(text_col)

    @_base.tidy
    def run(batches):
        own = Classifier(*shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(place).to_pylist()]
            score = np.concatenate([np.zeros(0), *(own.scores(texts[i:j]) for i, j in _blocks(texts))])
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Where no label of either class is there to learn from, all scores are alike. Other columns of docs are not read."""
    out = scored(docs, train(docs, labels, sample))
    return out.select("doc_id", _base.held_out(F.col("doc_id"), 4).alias("held_out"), "score", "predicted")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(_base.table(spark, sf_dir, "documents"), _base.table(spark, sf_dir, "labels"))
