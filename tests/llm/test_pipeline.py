"""The pipeline's stages, each against a plain version on its own input."""

import os
import time
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline as cp
from gridloom.llm import _base, toxicity
from tests.conftest import SF
from tests.llm import brute


def test_stages(spark):
    docs = _base.table(spark, SF, "documents")
    stages = dict(cp.STAGES)
    columns = docs.columns
    tables = {}
    for name, f in cp.STAGES:
        before = docs
        docs = _base.spill(f(spark, docs, SF), "stage")
        tables[name] = (before.toPandas(), docs.toPandas())
        if name != "packing":
            assert docs.columns == columns
    assert list(stages) == ["toxicity", "exact dedup", "near dedup", "substring dedup", "packing"]
    before, after = tables["toxicity"]
    labels = _base.table(spark, SF, "labels")
    scores = toxicity.scored(_base.table(spark, SF, "documents"), toxicity.train(_base.table(spark, SF, "documents"), labels)).toPandas().set_index("doc_id")["predicted"]
    assert set(after["doc_id"]) == {i for i in before["doc_id"] if not scores[i]}
    toxic = set(labels.filter("toxic = 1").toPandas()["doc_id"]) & set(before["doc_id"])
    gone = set(before["doc_id"]) - set(after["doc_id"])
    assert len(gone - toxic) < 0.02 * len(before)
    before, after = tables["exact dedup"]
    first = before.assign(t=before["text"].map(brute.normalised)).sort_values("doc_id").drop_duplicates("t")
    assert set(after["doc_id"]) == set(first["doc_id"])
    before, after = tables["near dedup"]
    ids = before["doc_id"].tolist()
    want = brute.classes(ids, [brute.simhash(t.encode()) for t in before["text"]])
    assert set(after["doc_id"]) == set(want)
    before, after = tables["substring dedup"]
    want = brute.passages(before["doc_id"], [t.encode() for t in before["text"]], 50)
    text = {i: (t if not w[1] else b" ".join(w[3]).decode()) for i, t, w in zip(before["doc_id"], before["text"], want) if not w[1] or w[3]}
    assert dict(zip(after["doc_id"], after["text"])) == text
    assert (after["n_chars"] == after["text"].str.len()).all()
    before, after = tables["packing"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    whole = {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in zip(before["doc_id"], before["text"])}
    for i, part in after.sort_values("piece").groupby("doc_id"):
        assert np.frombuffer(b"".join(part["ids"]), "<u4").tolist() == whole[i]
    assert set(after["doc_id"]) == set(whole)


def test_toxic_documents_go_and_others_stay(spark):
    """On a table with enough labels to learn from: a stage that drops all rows fails here, and so does one that drops none."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = (_base.table(spark, sf, x) for x in ("documents", "labels"))
    left = {r["doc_id"] for r in cp.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    known = labels.toPandas().set_index("doc_id")["toxic"]
    toxic, clean = (set(known.index[known == y]) for y in (1, 0))
    assert len(toxic - left) > 0.6 * len(toxic) and len(clean & left) > 0.97 * len(clean)
    assert len(left) > 0.85 * docs.count()


def test_run(spark, monkeypatch):
    """Of all that is spilled only the last stage's table is left."""
    kept, began = [], time.time()
    spill = _base.spill
    monkeypatch.setattr(_base, "spill", lambda df, tag: kept.append(spill(df, tag)) or kept[-1])
    out = cp.run(spark, SF)
    assert out.count() > 0
    names = [f.removeprefix("file:").removeprefix("//").rsplit("/", 1)[0] for f in out.inputFiles()]
    folders = [d for d in os.listdir(os.path.dirname(names[0]))]
    assert len(kept) > 10 and os.path.basename(names[0]) in folders
    made = {tag for tag in folders if tag.rsplit("-", 1)[0] in ("toxicity", "exact-dedup", "near-dedup", "substring-dedup", "labelled", "digests", "winners", "members", "spans")}
    assert not [t for t in made if os.path.getmtime(os.path.join(os.path.dirname(names[0]), t)) > began]
    assert cp.ORACLE_SQL is None


def test_sql_queries(spark, duck):
    from gridloom.llm import queries
    from tests.test_oracles import same

    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name](spark, SF).toPandas(), duck.execute(sql).fetch_df())


def _odd(spark, odd_rows):
    """The odd rows with the columns that the pipeline's documents have, and columns named like the stages' own."""
    rows = [(i, t, len(t or ""), 7, "k", "m", "b", "x", 5, "y", 2.0, [1]) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, __id long, __key string, __drop string, begin string, __mark__ string, __ID__ int, __key__ string, __begin__ double, __until__ array<int>").repartition(3)


def _pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_on_odd_rows(spark, odd_rows, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and ids, clashing names: each stage against its plain version on its own input."""
    docs = _odd(spark, odd_rows)
    labels = spark.createDataFrame([(i, int(300 <= i < 308)) for i in (*range(20), *range(100, 106), *range(300, 308), 505, 506)] + [(None, 1)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    told = toxicity.scored(docs, toxicity.train(docs, labels)).toPandas()
    left = Counter(i if i == i else None for i, p in zip(told["doc_id"], told["predicted"]) if not p)
    out = cp.drop_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert Counter(i for i, _ in _pairs(out).elements()) == left and _pairs(out) <= Counter(odd_rows)
    out = cp.drop_copies(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    groups = {}
    for i, t in odd_rows:
        groups.setdefault(brute.normalised(t), []).append(i)
    got = Counter((r["doc_id"], brute.normalised(r["text"])) for r in out.collect())
    assert got == Counter((min((i for i in ids if i is not None), default=None), t) for t, ids in groups.items())
    out = cp.drop_near_copies(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    classes = brute.classes(list(range(len(odd_rows))), [brute.simhash((t or "").encode()) for _, t in odd_rows])
    members = {}
    for (i, _), c in zip(odd_rows, classes):
        members.setdefault(c, []).append(i)
    got = _pairs(out)
    assert sum(got.values()) == len(members) and got <= Counter(odd_rows)
    assert Counter(i for i, _ in got.elements()) == Counter(min((i for i in ids if i is not None), default=None) for ids in members.values())
    out = cp.cut_passages(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    want = brute.passages([i for i, _ in odd_rows], [(t or "").encode() for _, t in odd_rows], 50)
    assert _pairs(out) == Counter((i, t if not w[1] else b" ".join(w[3]).decode()) for (i, t), w in zip(odd_rows, want) if not w[1] or w[3])
    out = cp.pack(spark, docs, str(tmp_path)).toPandas()
    assert (out["piece"] == 0).sum() == len(odd_rows) and out.groupby("sequence_id")["length"].sum().max() <= 4096


def test_rows_that_share_an_id_are_told_apart(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a b"), (2, "quite another text altogether"), (2, "a  b"), (3, "a b c d e f"), (3, "not the same as the others")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _pairs(cp.drop_copies(spark, docs, "")) == Counter([(1, "a b"), (2, "quite another text altogether"), (3, "a b c d e f"), (3, "not the same as the others")])
    near = _pairs(cp.drop_near_copies(spark, docs, ""))
    assert near[2, "quite another text altogether"] == near[3, "not the same as the others"] == 1 and near[1, "a b"] == 1


def test_stages_without_rows(spark, odd_rows, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = _odd(spark, odd_rows).limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
