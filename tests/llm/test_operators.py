"""Each operator on the odd rows and on no rows, against its plain version."""

import hashlib
import math
import random
import zlib
from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import anchored, ctw, exact_dedup, hashing, packing, rlz_dedup, sentencepiece_lattice, simhash, simhash_dedup, suffix_dedup, token_counts, toxicity
from gridloom.llm.components import components
from tests.llm import brute
from tests.llm.conftest import prose

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def expected(ids, results):
    return Counter((i, *r) for i, r in zip(ids, results))


@pytest.mark.parametrize("window, gram, group, anchors", [(200, 32, 1000, anchored.ANCHORS), (200, 32, 1000, 0), (40, 8, 1000, 0), (40, 8, 1000, 10**6), (40, 8, 1, 10**6), (40, 8, 3, 10**6)])
def test_repeats(odd, odd_rows, window, gram, group, anchors):
    """With the very long text in it; with filters and, beyond the number of anchors for them, by joins alone."""
    got = suffix_dedup.removed_repeats(odd, window=window, gram=gram, group=group, anchors=anchors)
    want = brute.repeats([(t or "").encode() for _, t in odd_rows], window)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected([i for i, _ in odd_rows], want)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_maximal_repeats():
    array = suffix_dedup.SuffixArray([b"xabcy", b"zabcw", b"abcy"], [5, 5, 4])
    found = {(bytes(([b"xabcy", b"zabcw", b"abcy"][array.owner[p]])[array.offset[p] :][:n]), b - a) for a, b, n in suffix_dedup.maximal_repeats(array, 2) for p in array.sa[a:b]}
    assert found == {(b"abc", 3), (b"abcy", 2)}


@pytest.mark.parametrize("window, gram, group, anchors", [(50, 10, 1000, anchored.ANCHORS), (50, 10, 1000, 0), (8, 3, 1000, 0), (8, 3, 1000, 10**6), (8, 3, 1, 10**6), (8, 3, 2, 10**6)])
def test_passages(odd, odd_rows, window, gram, group, anchors):
    got = rlz_dedup.removed_passages(odd, window=window, gram=gram, group=group, anchors=anchors)
    want = brute.passages([i for i, _ in odd_rows], [(t or "").encode() for _, t in odd_rows], window)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == expected([i for i, _ in odd_rows], [w[:3] for w in want])


def test_parse_looks_over_factor_ends():
    one, two, whole = [1, 2, 3, 4, 5], [4, 5, 6, 7, 8], [1, 2, 3, 4, 5, 6, 7, 8]
    got = rlz_dedup.parsed([np.array(x) for x in (one, two, whole)], [2, 2, 5], [0, 1, 2], 4)
    assert got == [[], [], [(0, 2), (3, 5)]]


def test_long_documents_are_cut_alike():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 123, anchored.STRETCH + 5000, dtype=np.uint8)
    doc, start, run, h, c, a = anchored.blocks(text.astype(np.uint64), np.array([len(text)]), 200, 32)
    assert (np.sort(np.concatenate([np.arange(s, s + n) for s, n in zip(start, run)])) == np.arange(len(text) - 199)).all()


@pytest.mark.parametrize("chunk", [1024, 13])
def test_token_counts(odd, odd_rows, chunk):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t or "" for _, t in odd_rows]
    want = [len(sp.encode(t)) for t in texts]
    if chunk == 13:
        assert token_counts.load(PIECES).counts(texts, chunk).tolist() == want
    else:
        got = token_counts.token_counts(odd, PIECES)
        assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected([i for i, _ in odd_rows], [(len(t.encode()), n, n > 4096) for t, n in zip(texts, want)])


def test_transducer_on_random_texts():
    import sentencepiece

    rng = random.Random(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["".join(rng.choice(["th", "e", " ", "  ", "ing", "▁", "\n", "er", "\r", "!", "é", "漢", "<s>", "0"]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    t = token_counts.load(PIECES)
    assert t.counts(texts, 7).tolist() == [len(sp.encode(x)) for x in texts]
    t.reset()
    assert t.counts(texts, 64).tolist() == [len(sp.encode(x)) for x in texts]


def test_every_code_point_counts_as_in_the_library():
    import sentencepiece

    sp, t = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.load(PIECES)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x10000 or c % 997 == 0)]
    assert t.counts(chars).tolist() == [len(sp.encode(c)) for c in chars]
    inside = [f"a{c}b ǅ{c}" for c in chars[::7]]
    assert t.counts(inside).tolist() == [len(sp.encode(x)) for x in inside]


@pytest.mark.parametrize("chunk, most", [(7, 50), (3, 9), (64, 10**6), (1024, 100)])
def test_texts_without_word_starts(chunk, most):
    """State maps of heads composed over many chunks, and texts run in parts."""
    import sentencepiece

    rng = random.Random(chunk)
    sp, t = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.load(PIECES)
    texts = ["".join(rng.choice(["th", "e", "ing", "é", "漢", "ǅ", "0", "aaaa", " "[: rng.random() < 0.05]]) for _ in range(rng.choice([0, 1, 5, 80, 700]))) for _ in range(120)]
    texts += ["a" * 5003, "ab" * 2001, "漢" * 999, ""]
    assert t.counts(texts, chunk, most).tolist() == [len(sp.encode(x)) for x in texts]


def test_long_texts_without_spaces_run_side_by_side():
    rng = random.Random(0)
    t = token_counts.load(PIECES)
    steps = []
    run = t.run
    t.run = lambda cols, begin, *rest: steps.append(len(begin)) or run(cols, begin, *rest)
    for text in ("a" * 600_000, "".join(rng.choice("thinger") for _ in range(600_000))):
        steps.clear()
        t.counts([text])
        assert len(steps) < 20 and sum(steps) < 6 * 600_000 / token_counts.CHUNK


@pytest.mark.parametrize("k", [1024, 2])
def test_exact_groups(odd, odd_rows, k):
    groups = {}
    for i, t in odd_rows:
        groups.setdefault(brute.normalised(t), []).append(i)
    want = []
    for i, t in odd_rows:
        ids = groups[brute.normalised(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((keep, len(ids), i == keep, hashlib.sha256(brute.normalised(t).encode()).hexdigest()))
    assert rows(exact_dedup.exact_groups(odd, k=k), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected([i for i, _ in odd_rows], want)


def test_frequent_digests_are_found(spark):
    df = spark.range(9000).select(F.encode(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")), "UTF-8").alias("digest")).repartition(5)
    assert b"hot" in [bytes(r[0]) for r in exact_dedup.frequent(df, 8).collect()]


def test_toxicity_held_out(spark):
    rng = random.Random(0)
    bad = ["vilegrump", "nastoid", "scumlet"]
    texts = [prose(rng, 60).split() for _ in range(800)]
    y = [i % 5 == 0 for i in range(800)]
    for t, on in zip(texts, y):
        if on:
            t.insert(rng.randrange(len(t)), rng.choice(bad))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 803 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(800))
    assert sum(got[i]["predicted"] == y[i] for i in held) / len(held) > 0.95


def _grams(text):
    t = f" {text.lower()} "
    return {t[i : i + n] for n in toxicity.GRAMS for i in range(len(t) - n + 1)}


def test_log_count_ratios_and_fit():
    """Features, ratios and scores of the classifier against plain counting and a plain fit over strings."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["vilegrump", "nastoid"]) if i % 3 == 0 and rng.random() < 0.1 else prose(rng, 1) for _ in range(40)) for i in range(240)]
    y = np.array([i % 3 == 0 for i in range(240)])
    assert toxicity.distinct(texts) == list(range(240)) and toxicity.distinct([texts[0], texts[1], texts[0]]) == [0, 1]
    model = toxicity.fit(texts, y)
    rows = [_grams(t) for t in texts]
    n1, n0 = (Counter(g for r, on in zip(rows, y) if on == c for g in r) for c in (True, False))
    pos, neg, a = int(y.sum()), int((~y).sum()), toxicity.ALPHA
    ratio = {g: math.log((n1[g] + a) / (pos + 2 * a)) - math.log((n0[g] + a) / (neg + 2 * a)) for g in n1 | n0}
    share = pos / (pos + neg)
    telling = {g for g, r in ratio.items() if n1[g] + n0[g] >= toxicity.LEAST and abs(r) >= toxicity.RATIO and abs(n1[g] - (n1[g] + n0[g]) * share) >= toxicity.DEVIATIONS * math.sqrt((n1[g] + n0[g]) * share * (1 - share) + 1)}
    assert len(telling) > 20
    names = sorted(telling)
    x = np.array([[ratio[g] if g in r else 0.0 for g in names] for r in rows])
    # The plain fit: the same gradient steps on a dense matrix.
    w, b, vw, vb = np.full(len(names), 0.02), math.log(share / (1 - share)), np.zeros(len(names)), 0.0
    rate = 2.0 / (x * x).sum(1).mean()
    each = np.where(y, share / pos, (1 - share) / neg)
    for _ in range(toxicity.ROUNDS):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) * each
        vw, vb = 0.9 * vw - rate * (x.T @ g + toxicity.RIDGE * w / len(texts)), 0.9 * vb - 0.2 * g.sum()
        w, b = w + vw, b + vb
    # Hashes that share a bucket with a telling n-gram are counted but have no weight.
    found = {int(h): v for h, v in zip(model.features, model.values)}
    assert len(found) == len(names)
    new = texts[:5] + [prose(rng, 30), "vilegrump", "", "x"]
    z = [b + sum(w[i] * ratio[g] for i, g in enumerate(names) if g in _grams(t)) for t in new]
    assert model.scores(new) == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-6)


def test_long_texts_leave_room_for_others(spark):
    """One long toxic text, or toxic texts that fill the bound, must not keep clean ones or other toxic ones from the fit."""
    rng = random.Random(2)
    texts = [f"{prose(rng, 30)} {'vilegrump' if i % 2 else ''} {prose(rng, 30)}" for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(401)] + [(401, 1), (403, 0)], "doc_id long, toxic int")
    long = [(i, prose(rng, 60_000)) for i in (401, 403)]
    docs = spark.createDataFrame([*enumerate(texts), *long], "doc_id long, text string")
    most = 60 * sum(map(len, texts)) // len(texts)
    model = toxicity.train(docs, labels, characters=most)
    assert len(model.features)
    predicted = model.scores(texts) >= toxicity.THRESHOLD
    assert np.mean(predicted == (np.arange(400) % 2 == 1)) > 0.9
    assert toxicity.within([1, 2, 3, 4], [5, 90, 4, 2], 10) == [1, 3] and toxicity.within([1, 2], [50, 20], 10) == [2] and toxicity.within([], [], 10) == []


def test_toxicity_odd_rows(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, labels).count() == len(odd_rows)
    texts = odd.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert toxicity.toxicity(texts, labels.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "toxic")).count() == len(odd_rows)
    assert toxicity.toxicity(odd, labels.limit(0)).count() == len(odd_rows)
    model = toxicity.Classifier(np.zeros(0, np.uint64), np.zeros(0), -3.0)
    assert toxicity.accepted(odd, model).columns == odd.columns and toxicity.accepted(odd, model).count() == len(odd_rows)


def _symbols(text, depth):
    """Symbols of nine bits: 256 before the begin and at the end."""
    return (*([256] * depth), *text, 256)


def _decisions(symbol):
    return [symbol >> 8] if symbol == 256 else [symbol >> k & 1 for k in range(8, -1, -1)]


def _tree(texts, depth):
    count = {}
    for t in texts:
        p = _symbols(t, depth)
        for i in range(depth, len(p)):
            for d in range(depth + 1):
                q = 1
                for b in _decisions(p[i]):
                    count.setdefault((p[i - d : i][::-1], q), [0, 0])[b] += 1
                    q = 2 * q + b
    return count


def _code(count, depth, texts):
    """Log10 probabilities by recursion over the whole tree."""
    kids = {}
    for c, q in count:
        if c:
            kids.setdefault((c[:-1], q), []).append((c, q))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    @lru_cache(None)
    def weighted(n):
        own = kt(*count[n])
        return own if len(n[0]) == depth else float(np.logaddexp(own, sum(weighted(x) for x in kids[n]))) + math.log(0.5)

    @lru_cache(None)
    def one(context, q):
        mixed, rest, last = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            n = (context[:d], q)
            if n not in count:
                break
            a, b = count[n]
            share = 1.0 if d == depth else math.exp(kt(a, b) + math.log(0.5) - weighted(n))
            last = (b + 0.5) / (a + b + 1)
            mixed, rest = mixed + rest * share * last, rest * (1 - share)
        return mixed + rest * last

    out = []
    for text in texts:
        total, p = 0.0, _symbols(text, depth)
        for i in range(depth, len(p)):
            q = 1
            for b in _decisions(p[i]):
                x = one(p[i - depth : i][::-1], q)
                total += math.log10(x if b else 1 - x)
                q = 2 * q + b
        out.append(total)
    return out


@pytest.mark.parametrize("depth, frequent_strings, rows", [(ctw.DEPTH, ctw.STRINGS, ctw.ROWS), (ctw.DEPTH, 50, 40), (2, 0, 1), (3, 300, 1)])
def test_context_tree(odd, odd_rows, depth, frequent_strings, rows):
    """Scores at the shipped depth against the whole tree, with many, few and no broadcast strings, and groups on their own."""
    texts = [(t or "").encode() for _, t in odd_rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in odd_rows]
    df = odd if depth == ctw.DEPTH else odd.filter("length(text) < 9000")
    if depth != ctw.DEPTH:
        texts, held = zip(*((t, h) for (_, x), t, h in zip(odd_rows, texts, held) if x is not None and len(x) < 9000))
    want = _code(_tree([t for t, h in zip(texts, held) if not h], depth), depth, texts)
    got = ctw.scores(df, depth=depth, frequent_strings=frequent_strings, rows=rows).collect()
    found = sorted((r["n_bytes"], r["held_out"], r["score"]) for r in got)
    for a, b in zip(found, sorted((len(t), h, x) for t, h, x in zip(texts, held, want))):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-5, abs=1e-4)


def test_probabilities_sum_to_one(spark):
    """Of all symbols after a context, the end among them; with texts that all begin alike, the begin's contexts are not mixed up with bytes inside."""
    training = [b"aQ" + bytes([97 + i % 5, 97, 98]) * (i % 3) for i in range(40)]
    every = [b"aQ" + bytes([b]) for b in range(256)] + [b"aQ"]
    df = spark.createDataFrame([(False, bytearray(t)) for t in training] + [(True, bytearray(t)) for t in every], "held boolean, text binary")
    table = {r["key"] & (2**64 - 1): 2.0 ** r["log2p"] for r in ctw.string_table(df).collect()}
    after = ctw.strings(every, ctw.DEPTH)
    context = after[2] >> np.uint64(ctw.BITS)
    assert sum(p for k, p in table.items() if k >> ctw.BITS == int(context)) == pytest.approx(1, abs=1e-5)
    first = ctw.strings([b"aQ"], ctw.DEPTH).tolist()
    assert table[first[0]] > 0.9 and table[first[1]] > 0.9


def test_scores(odd, odd_rows):
    """Base scores by their formula, the byte model on held-out texts better than eight bits."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in odd_rows]
    tokens = [(t or "").encode().lower().split() + [None] for _, t in odd_rows]
    count = Counter(w for t, h in zip(tokens, held) for w in t if not h)
    total, base = sum(count.values()), sum(count.values()) * (len(count) + 1)
    want = [(h, len(t), sum(count[w] > 0 for w in t), total, round(sum(math.log10((count[w] + 1) / base) for w in t), 4)) for t, h in zip(tokens, held)]
    for frequent in (200_000, 5):
        got = ctw.scores(odd, frequent=frequent).withColumn("b", F.round("base_score", 4)).collect()
        found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["b"]) for r in got), key=str)
        for a, b in zip(found, sorted(((i, *w) for (i, _), w in zip(odd_rows, want)), key=str)):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=2e-3)
    long = next(r for r in got if r["doc_id"] == 507)
    assert 0 < long["bits_per_byte"] < 5


def test_base_scores_of_the_query(spark, odd, odd_rows, tmp_path):
    """The contract's columns of op5: log10((c + 1) / (N + 1 * (V + 1))) over tokens, on odd rows and where nothing is known."""
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in odd_rows]
    tokens = [(t or "").encode().lower().split() + [None] for _, t in odd_rows]
    count = Counter(w for t, h in zip(tokens, held) for w in t if not h)
    total = sum(count.values())
    want = [(i, h, len(t), sum(count[w] > 0 for w in t), total, sum(math.log10((count[w] + 1) / (total + 1 * (len(count) + 1))) for w in t)) for (i, _), t, h in zip(odd_rows, tokens, held)]
    got = [tuple(r) for r in ctw.op5_context_tree_scores(spark, f"{tmp_path}/odd").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()]
    order = lambda r: (str(r[0]), *r[1:5], round(r[5], 4))
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
    out = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    spark.createDataFrame([(out, "One two")], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    r = ctw.op5_context_tree_scores(spark, f"{tmp_path}/none").first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 3, 0, 0, 0.0)


def test_segments_are_encoded_alone():
    """No cut changes what the library gives, on its own pieces glued together at random."""
    import sentencepiece

    rng = random.Random(0)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    names = [sp.id_to_piece(i) for i in range(3, sp.get_piece_size()) if not sp.is_byte(i)]
    cut, lead = sentencepiece_lattice.cutter(PIECES).cut, len(sp.encode("\n"))
    for _ in range(300):
        text = "".join(rng.choice(names) for _ in range(rng.randint(1, 12))).replace("▁", " ")
        words = sentencepiece_lattice.words_in(text)
        parts = cut(words)
        assert ["".join(p) for p in parts] == words
        # After a line end, whose pieces are its own.
        ids = [i for p in parts for s in p for i in sp.encode("\n" + s.replace("▁", " "))[lead:]]
        assert ids == sp.encode(text), (text, parts)
    assert cut([]) == [] and cut(["a"]) == [["a"]]


@pytest.mark.parametrize("places", [sentencepiece_lattice.PLACES, 3])
def test_folds_of_merges(spark, odd, places):
    """Bounds as bits and as arrays, very long segments too, against the library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(1)
    words = {"a" * 3000, "▁" + "a" * 70, "ab" * 100, "▁", "e", "ǅ", "漢字", "▁ǅx", "x" * 61, "x" * 62, "x" * 63, *("▁" + "".join(rng.choice("thinger") for _ in range(rng.randint(1, 90))) for _ in range(60))}
    got = sentencepiece_lattice.encoded_words(spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long"), PIECES, places=places).collect()
    lead = len(sp.encode("\n"))
    assert {r["word"]: r["ids"] for r in got} == {w: sp.encode("\n" + w.replace("▁", " "))[lead:] for w in words}


def test_segments_are_counted(odd, odd_rows):
    rows = sentencepiece_lattice.word_codes(odd, PIECES).collect()
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    cut = sentencepiece_lattice.cutter(PIECES).cut
    assert {r["word"]: r["n"] for r in rows} == Counter(s for _, t in odd_rows for p in cut(sentencepiece_lattice.words_in(t or "")) for s in p)


@pytest.mark.parametrize("frequent", [100_000, 5, 0])
def test_whole_texts_encode_and_decode(spark, odd, odd_rows, frequent):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece_lattice.document_codes(odd, PIECES, frequent=frequent)
    assert got.columns == ["doc_id", "n_pieces", "ids", "round_trip"]
    found = got.collect()
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in found)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == Counter((i, tuple(sp.encode(t or ""))) for i, t in odd_rows)
    if frequent == 5:
        back = sentencepiece_lattice.encoded(odd, PIECES, frequent=frequent).select("doc_id", sentencepiece_lattice.decoded(F.col("ids"), PIECES).alias("t")).collect()
        assert Counter((r["doc_id"], r["t"]) for r in back) == Counter((i, "▁" + t.replace(" ", "▁") if t else "") for i, t in odd_rows)


def test_texts_are_cut_once_and_not_sent(spark, odd, odd_rows, monkeypatch):
    """Chunks of a few words give the library's ids; they wait in buckets, and no exchange has texts or their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(sentencepiece_lattice, "HELD", 3)
    got = sentencepiece_lattice.document_codes(odd, PIECES, frequent=5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "holed" not in plan and "text#" not in plan
    assert Counter((r["doc_id"], tuple(r["ids"]), r["round_trip"]) for r in got.collect()) == Counter((i, tuple(sp.encode(t or "")), True) for i, t in odd_rows)
    for x in ([], [0], [5, 0, 1 << 30, 77]):
        assert sentencepiece_lattice._unpacked(sentencepiece_lattice._packed(np.array(x, np.int32))).tolist() == x


def test_query_encodes_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sentencepiece_lattice.op6_sentencepiece_lattice(spark, "/root/testdata/sf0.001")
    assert "doc_id" in got.columns and got.count() == docs.count() and got.filter("not round_trip").count() == 0


def test_viterbi_fold(spark):
    """The unigram fold against all segmentations."""
    score = {"a": -3.0, "b": -3.0, "c": -4.0, "ab": -4.5, "bc": -3.5, "abc": -9.0, "ca": -2.0}
    table = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(score.items())], "piece string, id long, score double")
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcx") for _ in range(rng.randint(1, 7))) for _ in range(40)})

    def best(w):
        if not w:
            return 0.0
        return max((score[w[:k]] if w[:k] in score else -1e6) + best(w[k:]) for k in range(1, min(3, len(w)) + 1) if w[:k] in score or k == 1)

    df = sentencepiece_lattice.lattice(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), table, 3).withColumn("bounds", sentencepiece_lattice.best_path(3))
    for r in df.collect():
        got = sum(score.get(r["word"][a:b], -1e6) for a, b in zip(r["bounds"], r["bounds"][1:]))
        assert got == pytest.approx(best(r["word"]))


def _words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _simhash(text):
    """Votes of words by weight, bit by bit."""
    weights = [(xxhash.xxh64_intdigest(w.encode(), 42), max(1, min(len(w), 10) - 2)) for w in _words(text)]
    total = sum(w for _, w in weights)
    return sum(1 << k for k in range(64) if 2 * sum(w for h, w in weights if h >> k & 1) > total)


@pytest.mark.parametrize("ids", ["numbers", "texts", "one"])
def test_fingerprints(spark, odd, odd_rows, ids):
    """Every column against a plain version; ids that are numbers, texts, or nearly all the same."""
    rows = list(odd_rows)
    if ids == "texts":
        rows = [(None if i is None else f"id-{i}", t) for i, t in odd_rows]
        odd = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    elif ids == "one":
        rows = [(40 if i is None or i % 9 else i, t) for i, t in odd_rows] * 2
        odd = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tie = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) >> 1
    none = "" if ids == "texts" else 0
    rows.sort(key=lambda r: (r[0] is None, none if r[0] is None else r[0].encode() if ids == "texts" else r[0], tie(r[1]), r[1] or ""))
    texts = [t or "" for _, t in rows]
    following = texts[1:] + texts[:1]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, following)]
    own, changed = list(map(_simhash, texts)), list(map(_simhash, edited))
    far = lambda a, b: bin(a ^ b).count("1")
    want = Counter(
        (i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", 1 - far(a, b) / 64, 1 - far(a, c) / 64, sum(far(a, x) <= 3 for x in own) - 1 if ids != "texts" and i is not None and i % 20 == 0 else 0)
        for (i, _), t, e, a, b, c in zip(rows, texts, edited, own, changed, own[1:] + own[:1])
    )
    got = simhash.edited_fingerprints(odd)
    assert rows_of(got) == want
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_ids_that_begin_alike_are_dealt_out(spark):
    ids = [f"doc-{i:07d}" for i in range(3000)]
    docs = spark.createDataFrame([(i,) for i in ids] + [(None,)], "doc_id string")
    got = docs.select("doc_id", simhash._part(docs, "doc_id", F.lit(0.5)).alias("part")).toPandas().dropna().sort_values("doc_id")
    assert got["part"].is_monotonic_increasing and got["part"].value_counts().max() < 600
    one = spark.createDataFrame([("é",), ("é",)], "doc_id string")
    assert one.select(simhash._part(one, "doc_id", F.lit(0.5)).alias("part")).count() == 2


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_block_tables(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 6), replace=False)) for b in base for _ in range(5)]
    values = spark.createDataFrame([(v,) for v in near], "fp long")
    queries = spark.createDataFrame([(int(b),) for b in base], "fp long")
    mask = (1 << 64) - 1
    want = {(int(q), v) for q in base for v in near if bin((int(q) & mask) ^ (v & mask)).count("1") <= 3}
    assert {(r["query"], r["fp"]) for r in simhash.within(queries, values).collect()} == want


@pytest.mark.parametrize("limit", [4096, 50])
def test_packing(odd, odd_rows, limit):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, x in odd_rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), limit):
            part = ids[k : k + limit]
            want[i, k // limit, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.packing(odd, WORDS, limit=limit, keep_ids=True).toPandas()
    found = Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert found == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got.itertuples())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= limit
    if limit == 4096:
        assert got["sequence_id"].nunique() <= -(-got["length"].sum() // limit) + 1


def test_word_coder():
    from tokenizers import Tokenizer

    rng = random.Random(0)
    t, coder = Tokenizer.from_file(WORDS), packing.WordCoder(WORDS)
    coder.KEPT = 50
    parts = [*" \n\t\x0b\x1c\x85\xa0abcXYZ'.,!?éñ漢😀\x000123İſ-_", "<|endoftext|>", " don't", "'S", "́", "ing", "The ", "word, ", "end. "]
    for _ in range(30):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(40)]
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.ids(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    heads, tails = ["the", "Été", "ΟΔΟΣ", "x1", "it's", "a'", "İ", "aİ", "क़", "e\u0301", "¼", "中", "€", "<|endoftext|>", ""], "*#$%&.,;:!?()[]{}<>|-_+=/\\~^@`\"'s"
    words = [rng.choice(heads) + "".join(rng.choice(tails) for _ in range(rng.randint(0, 5))) for _ in range(3000)]
    words += [f"a{chr(c)}*?" for c in [*range(0x80, 0x2100), *range(0xFB00, 0xFB50), *range(0x10400, 0x10450)]]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.ids(words)] == [e.ids for e in t.encode_batch(words, add_special_tokens=False)]


def test_bin_completion():
    assert packing.completion([2, 3, 5], {2: 5, 3: 5, 5: 5}, 11)[0] == 0
    assert sum(n for n, _ in packing.packed({6: 2, 5: 2, 4: 2}, 10)) == 3
    assert packing.packed({}, 10) == []


def test_bound_by_numbers_of_pieces():
    """Where two pieces fit at most the bound says so, and the search ends at once; no bound is above the best packing of small cases."""
    rng = np.random.default_rng(0)
    counts = Counter(rng.integers(1400, 2049, 4000).tolist())
    assert packing.least(counts, 4096) == 2000
    assert packing.least({1366: 10}, 4096) == 5 and packing.least({1365: 9}, 4096) == 3 and packing.least({1024: 8, 1025: 3}, 4096) == 3
    assert packing.least({}, 4096) == 0

    def fewest(pieces, limit):
        best = len(pieces)

        def place(i, free):
            nonlocal best
            if len(free) >= best:
                return
            if i == len(pieces):
                best = len(free)
                return
            for r in sorted({f for f in free if f >= pieces[i]}):
                left = list(free)
                left.remove(r)
                place(i + 1, [*left, r - pieces[i]])
            place(i + 1, [*free, limit - pieces[i]])

        place(0, [])
        return best

    for _ in range(200):
        limit = int(rng.integers(6, 40))
        pieces = sorted(rng.integers(1, limit + 1, int(rng.integers(1, 9))).tolist(), reverse=True)
        assert packing.least(Counter(pieces), limit) <= fewest(pieces, limit)


def test_packing_goes_back_over_sequences():
    """Against the fewest sequences by trying everything."""
    assert sum(n for n, _ in packing.packed({5: 1, 4: 4, 3: 2, 2: 1}, 10)) == 3

    @lru_cache(None)
    def fewest(items, limit):
        if not items:
            return 0
        first, rest = items[0], items[1:]
        ways = {tuple(c) for k in range(len(rest) + 1) for c in combinations(range(len(rest)), k) if first + sum(rest[i] for i in c) <= limit}
        return 1 + min(fewest(tuple(x for i, x in enumerate(rest) if i not in c), limit) for c in ways)

    rng = random.Random(5)
    for _ in range(150):
        limit = rng.randint(8, 24)
        items = tuple(sorted((rng.randint(2, limit * 2 // 3) for _ in range(rng.randint(1, 9))), reverse=True))
        counts = Counter(items)
        got, proved = packing.improved(counts, packing.best_filled(counts, limit), limit)
        assert sum(n for n, _ in got) == fewest(items, limit) >= packing.least(counts, limit) and proved
        assert all(sum(f) <= limit for _, f in got)
        assert sum((Counter({x: n * k for x, k in Counter(f).items()}) for n, f in got), Counter()) == counts
    few = {x: 300 for x in (11, 7, 6, 5, 3)}
    assert sum(n for n, _ in packing.packed(few, 16)) == packing.least(few, 16) == 600


def test_dominated_fillings():
    """By trying all subsets; and no filling that is needed is left out (test_packing_goes_back_over_sequences)."""
    rng = random.Random(6)
    for _ in range(300):
        filling = [30, *(rng.randint(1, 9) for _ in range(rng.randint(0, 5)))]
        rest, spare = rng.randint(0, 6), {rng.randint(1, 20) for _ in range(rng.randint(0, 4))}
        sums = {sum(c) for k in range(1, len(filling)) for c in combinations(filling[1:], k)}
        want = any(s < y <= s + rest for s in sums for y in spare)
        assert packing.dominated(filling, rest, sum(1 << y for y in spare)) == want
    got = list(packing.fillings([2, 3, 4, 6], {2: 2, 3: 2, 4: 1, 6: 1}, 12, 12, [0], 10**6))
    # Beside 6: 4 and 2 (which fill it), 3 and 3, but not 3 and 2 (4 in place of 3), nor 2 and 2 (3 in place of 2).
    assert [f for _, f in got] == [[6, 4, 2], [6, 3, 3]]
    assert packing.sequences({5: 1, 4: 4, 3: 2, 2: 1}, 10) == {"best_fit": 4, "packed": 3, "bound": 3, "proved": True}


def test_near_classes(odd, odd_rows):
    prints = [brute.simhash((t or "").encode()) for _, t in odd_rows]
    want = brute.classes([i for i, _ in odd_rows], prints)
    got = simhash_dedup.near_classes(odd)
    assert rows(got, "doc_id", "fingerprint", "component_id") == expected([i for i, _ in odd_rows], [(f"{p:016x}", c) for p, c in zip(prints, want)])


@pytest.mark.parametrize("cap, parts", [(1024, 2), (5, 2), (1024, 4)])
def test_dense_clusters(spark, cap, parts):
    rng = np.random.default_rng(0)
    values = sorted({int(b) ^ sum(1 << (3 * int(k)) for k in rng.choice(20, rng.integers(0, 6), replace=False)) for b in rng.integers(0, 1 << 62, 2) for _ in range(250)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash_dedup.links(df, parts, cap)).collect()}
    want = dict(zip(values, brute.classes(values, values)))
    assert got == {k: v for k, v in want.items() if k != v}


def test_xxh64():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 4000, dtype=np.uint8).tobytes()
    start, length = rng.integers(0, 3800, 500), rng.integers(0, 150, 500)
    assert hashing.xxh64(data, start, length, 42).tolist() == [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(start, length)]


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_no_rows(spark, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    results = [
        suffix_dedup.removed_repeats(none), token_counts.token_counts(none, PIECES), exact_dedup.exact_groups(none), toxicity.toxicity(none, labels), ctw.scores(none), sentencepiece_lattice.word_codes(none, PIECES),
        simhash.edited_fingerprints(none), packing.packing(none, WORDS), simhash_dedup.near_classes(none), rlz_dedup.removed_passages(none),
        exact_dedup.deduplicated(none), simhash_dedup.one_of_each(none), rlz_dedup.without_passages(none),
    ]
    assert [df.count() for df in results] == [0] * len(results)
