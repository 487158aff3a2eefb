"""The pipeline's stages one by one, each against what its operator says of its own input."""

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline as P
from locarium.llm import bpe, mixing, secret_scan

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    # repeated rows, an absent id, text and language, and a column too many
    odd = spark.createDataFrame([(7_000_000, None, None, None, None), (None, "and of the in to is that with", "en", "src0", 29)], docs.schema)
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(odd).selectExpr("*", "1 as score")
    for k, (name, stage) in enumerate(P.STAGES):
        out.append((name, docs))
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return dict(out) | {"result": docs}


def pandas(df):
    return df.toPandas().sort_values(["doc_id"], na_position="last").reset_index(drop=True)


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "encoding"]
    for name in ("near_dedup", "secrets", "mixing", "encoding"):
        assert tuple(stages[name].columns) == P.COLUMNS


def test_quality_keeps_clean_documents(spark, stages):
    before, after = pandas(stages["quality"]), pandas(stages["near_dedup"])
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    kept = set(after.doc_id.dropna())
    clean = set(labels[labels.quality == 1].doc_id) & set(before.doc_id.dropna())
    assert len(clean & kept) >= 0.98 * len(clean)
    junk = set(labels[labels.quality == 0].doc_id)
    assert len(junk & kept) <= 0.25 * len(junk)


def test_one_document_of_each_group(stages):
    before, after = pandas(stages["near_dedup"]), pandas(stages["secrets"])
    assert after.doc_id.dropna().is_unique
    sets = {}
    for r in before.drop_duplicates("doc_id").itertuples():
        w = "".join(c.lower() if c.isascii() else c for c in (r.text or "")).split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = [i for i in sets if pd.notna(i)]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after.doc_id.dropna()) == {i for i in ids if find(i) == i}


def test_secrets_are_replaced(stages):
    before, after = pandas(stages["secrets"]), pandas(stages["mixing"])
    scanner = secret_scan.Scanner()
    assert len(before) == len(after)
    for a, b in zip(before.itertuples(), after.itertuples()):
        found = scanner.spans(a.text or "")
        assert (a.text == b.text or (a.text is None and b.text is None)) == (not found)
        if found:
            assert not scanner.spans(b.text) and b.n_chars == len(b.text)


def test_mixing_draws_nine_tenths(spark, stages):
    before, after = pandas(stages["mixing"]), pandas(stages["encoding"])
    words = lambda d: d.text.fillna("").map(lambda t: len(t.split())).sum()
    assert 0.85 * words(before) < words(after) <= 0.9 * words(before) + 1
    again = pandas(mixing.mixed_documents(stages["mixing"].repartition(5), P.MIX))
    assert after.doc_id.equals(again.doc_id)


def test_encoding(stages):
    before, after = pandas(stages["encoding"]), pandas(stages["result"])
    t = bpe.Transducer(bpe.vocabulary_path())
    assert len(before) == len(after)
    for a, b in zip(before.itertuples(), after.itertuples()):
        ids = np.frombuffer(b.ids, "<u4").tolist()
        assert len(ids) == b.n_tokens and "".join(t.decode(ids)) == (a.text or "")


def test_run_and_empty_tables(spark, tmp_path):
    assert P.run(spark, SF).count() > 500
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    words = lambda tag, n=60: [f"{tag}{k}" for k in range(n)]
    near = " ".join(words("a")[:-1] + ["end"])
    rows = [(1, " ".join(words("a"))), (5, " ".join(words("b"))), (5, " ".join(words("c"))), (5, near), (5, " ".join(words("b"))), (6, " ".join(words("c")[:-1] + ["end"])), (7, ""), (7, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    # of the three texts of 5, one resembles 1 and goes; 6 resembles another; equal rows become one
    assert sorted((r.doc_id, r.text.split(" ")[0]) for r in P.near_dedup(spark, docs, SF).collect()) == [(1, "a0"), (5, "b0"), (5, "c0"), (7, "")]


def test_near_copies_without_an_id_are_compared(spark):
    text = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(text)), (3, " ".join(text[:-1] + ["end"])), (2, "other words " * 9), (None, " ".join(["start"] + text[1:-1]))]
    found = P.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in found) == [(0, 3, False), (0, 3, False), (2, 2, True), (3, 3, True)]
