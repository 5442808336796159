"""Filter audit, chat formatting and source divergence against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import groupby, permutations

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat_format, divergence, filter_audit
from tests.llm.test_operators import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- filter interaction -----------------------------------------------------------------------


def failing(doc, docs):
    i, t, _ = doc
    words = WORD.findall(t)
    return "".join(
        c
        for c, on in zip(
            "ABCDE",
            (
                len(words) < 200,
                100 * len(set(words)) < 50 * len(words),
                100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                re.search("[#$%&*|]", t) is not None,
                i is not None and any(j is not None and j < i and u == t for j, u, _ in docs),
            ),
        )
        if on
    )


def brute_audit(docs, good, toxic):
    """One chain run over all documents for each order."""
    docs = [(i, t or "", p or "") for i, t, p in docs]
    out, removed_by = [], Counter()
    marked = [(i, p, failing((i, t, p), docs)) for i, t, p in docs]
    for part in {p for _, _, p in docs}:
        own = [(i, f) for i, p, f in marked if p == part]
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for step, c in enumerate(order):
                gone, left = [x for x in alive if c in x[1]], [x for x in alive if c not in x[1]]
                removed_by[part, c] += len(gone)
                out.append((part, order, step + 1, len(left), len(gone), sum(c in f for _, f in own) - len(gone), sum(f == c for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
                alive = left
    return Counter((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


AUDIT = ("part", "filter_order", "step", *filter_audit.MEASURES, "shapley")


def test_filter_audit(spark, odd, odd_rows):
    langs = {0: "en", 1: None, 2: ""}
    docs = [(i, t, langs.get((i or 0) % 4, "de")) for i, t in odd_rows] + [(900, "X# " * 300, "en"), (901, "X# " * 300, "de"), (901, "X# " * 300, "en"), (902, "a b " * 200, "fr")]
    table = spark.createDataFrame([(i, t, p, "n", 1, "f") for i, t, p in docs], "doc_id long, text string, lang string, n string, fails int, first string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(0, 600, 2)] + [(900, 1, None), (900, None, 1), (None, 1, 1), (4, 1, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    good = {i for i, q, _ in labels.collect() if q == 1 and i is not None}
    toxic = {i for i, _, t in labels.collect() if t == 1 and i is not None}
    assert rows(filter_audit.audit(table, labels), *AUDIT) == brute_audit(docs, good, toxic)
    assert rows(filter_audit.audit(table, labels.limit(0)), *AUDIT) == brute_audit(docs, set(), set())
    names = spark.createDataFrame([(str(i) if i is not None else None, t, p) for i, t, p in docs], "doc_id string, text string, lang string")
    assert filter_audit.audit(names, labels.select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "toxic")).count() == 600 * len({p or "" for _, _, p in docs})


def test_filter_audit_of_nothing(spark, none):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none.withColumn("lang", F.col("part")), labels).count() == 0


def test_edges_are_eighty(spark):
    counted = spark.createDataFrame([("", False, True, 5, 7)], "part string, good boolean, toxic boolean, fails int, n long")
    found = {(r["before"], r["bit"]): r for r in filter_audit.edges(counted, 5).collect()}
    assert len(found) == 80
    assert (found[0, 1]["removed"], found[4, 1]["removed"], found[4, 1]["redundant"], found[0, 2]["kept"], found[0, 1]["toxic_lost"], found[0, 1]["good_lost"]) == (7, 0, 7, 7, 7, 0)
    assert filter_audit.paths(spark, "ABCDE").count() == 600


# ---- chat formatting --------------------------------------------------------------------------

NASTY = ["", None, "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>\\", "[", "</", "s>", "[[INST]]", "<<s>>", "[/INST", "INST]", "é漢😀</s>", "\n", "<s" + "\\" * 5 + ">", "$0 \\1", "user[INST]x[/INST]"]
OTHER = chat_format.Template("<|turn|>", "{:}", "{+}", "<|end|>")


def told(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


@pytest.mark.parametrize("template", [chat_format.Template(), OTHER, chat_format.Template("<|im_start|>", "\n#", "\x1e+", "<|im_end|>")])
def test_chats_read_back(spark, template):
    texts = [*NASTY, "{:}{+}", "{\\:}<|turn|><|end|>", "a" * 50_000, "<|im_end|>\n#\x1e+\\", "\n\n##\n\\#"]
    turns = [(c, (i * 7) % 5, ("user", "assistant", "assistant", None, "[INST]</s>")[(i + c) % 5], texts[(i * 3 + c) % len(texts)]) for c in range(12) for i in range(len(texts))]
    turns += [(50, None, "assistant", "first"), (50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a"), (None, 3, "assistant", "alone"), (None, 3, "user", "alone too"), (None, 3, "user", "alone too"), (51, 0, "user", None)]
    table = spark.createDataFrame([(*t, 1, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, turns int, formatted string, starts string").repartition(3)
    out = chat_format.formatted(table, template)
    got = out.select("conv_id", chat_format.read_back(F.col("formatted"), template).alias("turns"), chat_format.learned(F.col("formatted"), F.col("loss_spans"), template).alias("learned"), "formatted").collect()
    want = defaultdict(list)
    for k, (c, n, r, t) in enumerate(turns):
        want[c if c is not None else ("alone", k)].append(((n is not None, n or 0), r or "", t or ""))
    expected = Counter()
    for c, found in want.items():
        said = [(r, t) for _, r, t in sorted(found)]
        expected[None if isinstance(c, tuple) else c, tuple(said), tuple(t for r, t in said if r == "assistant")] += 1
    assert Counter((g["conv_id"], tuple((t["role"], t["text"]) for t in g["turns"]), tuple(g["learned"])) for g in got) == expected
    for g in got:
        blocks = [r for r, _ in groupby(t["role"] for t in g["turns"])]
        assert g["formatted"].count(template.open) == g["formatted"].count(template.close) == len(blocks)
        assert g["formatted"].count(template.next) == len(g["turns"]) - len(blocks)


def test_texts_without_marks_stay(spark):
    t = chat_format.Template()
    plain = [x for x in ("a < b > c", "[x]", "\\", "INST", "/s>", "") if x is not None]
    df = spark.createDataFrame([(x,) for x in plain], "x string")
    assert [r[0] for r in df.select(t.escaped(F.col("x"))).collect()] == plain


def test_marks_that_overlap_are_refused():
    for marks in (("<s>", "<<", "aa", "bb"), ("ab", "ab", "cd", "ef"), ("", "ab", "cd", "ef"), ("xy", "xyz", "bc", "de"), ("a\\", "cc", "dd", "ee"), ("<s>", "\n", "[b]", "[c]")):
        with pytest.raises(ValueError):
            chat_format.Template(*marks)


def test_no_chats(spark):
    assert chat_format.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_query(spark):
    from tests.conftest import SF

    found = {r["conv_id"]: r for r in chat_format.op12_chat_formatting(spark, SF).collect()}
    text = "</s>[INST] ok [/INST]"
    assert found[-1]["turns_sha256"] == told([("user", text), ("assistant", text)])
    assert (found[-1]["loss_chars"], found[-1]["loss_sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    assert found[-1]["formatted_chars"] == 2 * (13 + len(text) + 3) + len("user") + len("assistant")


# ---- source divergence ------------------------------------------------------------------------


def brute_divergence(docs, least, top):
    docs = [(t or "", a or "", s or "") for t, a, s in docs]
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    count, seen, group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for t, a, s in docs:
        ts = terms(t)
        count[a].update(ts)
        seen[a].update(set(ts))
        group[a, s].update(ts)
    out = []
    for a, s in group:
        kept = [w for w, n in seen[a].items() if n >= least]
        def prob(c):
            total = sum(c[x] for x in kept) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // total for w in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, whole = prob(group[a, s]), prob(count[a])
        pairs = []
        for b, o in group:
            if b == a and o != s:
                q = prob(group[b, o])
                pairs.append((o, sum(f(p[w], q[w]) for w in kept)))
        best = [(w, f(p[w], whole[w])) for w in kept if group[a, s][w] and p[w] > whole[w]]
        for part, items, n in (("pair", pairs, len(pairs)), ("term", best, top)):
            for rank, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:n]):
                out.append((a, s, part, item, v, rank + 1))
    return Counter(out)


FIELDS = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("least, top", [(10, 10), (2, 3), (1, 1000), (1000, 5)])
def test_divergence(spark, odd_rows, least, top):
    docs = [(t, (None, "en", "de", "")[k % 4], (None, "a", "b", "c", "")[k % 5]) for k, (_, t) in enumerate(odd_rows * 2)]
    docs += [("Ünïcode ABC abc ÀÉ İI Σς 漢字ab1cd", "x", s) for s in "aab"] + [(None, "y", "only"), ("1 2 3 _^[", "z", "p"), ("", "z", "q"), ("word", "z", None)]
    table = spark.createDataFrame([(*d, 5, "i", 1.0) for d in docs], "text string, lang string, source string, n int, item string, p double").repartition(3)
    assert rows(divergence.audit(table, least, top), *FIELDS) == brute_divergence(docs, least, top)


def test_divergence_of_nothing(spark, none):
    assert divergence.audit(none.withColumns({"lang": F.col("part"), "source": F.col("part")})).count() == 0


def test_probabilities_are_exact(spark):
    big = 12_345_678_901_234
    df = spark.createDataFrame([(big, 3 * big, 1000)], "n long, total long, v long")
    assert df.select(divergence.probability(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (big + 2) // (3 * big + 2000)


@pytest.mark.parametrize("name", ["op11_filter_interaction_audit", "op12_chat_formatting", "op13_source_divergence_audit"])
def test_audits_match_sql(spark, duck, name):
    from gridloom.llm import queries
    from tests.conftest import SF
    from tests.test_oracles import same

    same(queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).fetch_df())
