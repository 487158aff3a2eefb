"""Near duplicates, nearest vectors and mixing against brute force."""

import collections
import itertools

import numpy as np
import pandas as pd
import pytest

from locarium.llm import embed_dedup, minhash, mixing, topk
from locarium.llm.base import Scratch
from locarium.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_shingles string, component_id int"


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)] + [(5, 5), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    ids = {x for e in edges for x in e if None not in e}
    want = {i: c for i, c in components(ids, [e for e in edges if None not in e]).items() if i != c}
    assert {r.id: r.component for r in got} == want
    # stars of many edges, and chains between them
    edges = [(k % 5, 100 + k) for k in range(900)] + [(100 + k, 101 + k) for k in range(0, 900, 90)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r.id: r.component for r in got} == {i: c for i, c in components({x for e in edges for x in e}, edges).items() if i != c}


def shingles(text, width):
    w = "".join(c.lower() if c.isascii() else c for c in text).split(" ") if text else []
    w = [x for x in w if x]
    return set() if not w else {tuple(w)} if len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def near_docs():
    rng = np.random.default_rng(4)
    word = lambda: "w" + str(rng.integers(3000))
    common = [word() for _ in range(40)]
    rows, k = [], 0
    for group in range(25):
        base = [word() for _ in range(int(rng.integers(3, 160)))]
        if group % 3 == 0:
            base[1:1] = common
        for _ in range(int(rng.integers(1, 40 if group == 0 else 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 14))):
                copy[int(rng.integers(len(copy)))] = word()
            k += 1
            rows.append((k * 7 % 1009, " ".join(copy)))
    return rows + [(2000, None), (2001, ""), (2002, "one two"), (2003, "ONE two"), (2004, "one  two"), (2005, "  ")]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    rows = near_docs()
    sets = {i: shingles(t, width) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in rows], SCHEMA)
    for block in (512, 4):
        got = minhash.near_duplicates(docs, width, block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_edges(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (9, text + " "), (None, "other words stand here now"), (4, "long " * 60_000)], "doc_id long, text string")
    got = sorted(minhash.near_duplicates(docs).select("doc_id", "component_id", "kept").collect(), key=str)
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted([("3", "3", True), ("3", "3", True), ("None", "3", False), ("9", "3", False), ("None", "None", True), ("4", "4", True)])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_shuffle(spark):
    """Where no table is small enough to be broadcast unasked, full sets go through a shuffle once
    for each star; a row that is repeated gives its set once."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 2000)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-40]))]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    written = lambda: sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = minhash.near_duplicates(spark.createDataFrame(rows, docs.schema)).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        moved = written() - before
        again = minhash.near_duplicates(docs).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i - i % 2) for i, _ in rows]
    assert sorted((r.doc_id, r.component_id) for r in again) == sorted((i, i - i % 2) for i, _ in rows + rows[:1])
    assert moved < 3 * sum(8 * r.n_shingles for r in got), moved


def test_shared_shingles():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 500, 80).astype(np.uint64)) for _ in range(12)]
    got = minhash.shared_shingles(sets[:5], sets[5:], columns=64)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]).all()


def vector_rows():
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for _ in range(120):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 8))):
            v = base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.25])
            rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(3))))
            k += 1
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] + [0.0] * 15]
    rows += [(k + n, v, 1) for n, v in enumerate(bad)] + [(k + 10, rows[0][1], None), (k + 11, [1.0, 2.0], 1), (k + 12, [2.0, 4.0, 0.0], 1)]
    return rows


def test_similar_vectors(spark):
    rows = vector_rows()
    unit = {}
    for i, v, g in rows:
        if g is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            x = np.zeros(16)
            x[: len(v)] = v
            unit[i] = (x / np.linalg.norm(x), g)
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if unit[a][1] == unit[b][1] and unit[a][0] @ unit[b][0] >= 0.93]
    n = collections.Counter(x for l in links for x in l)
    want = components([i for i, *_ in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as n_links", "2 as rep")
    for cell, block in ((64, 512), (4, 8)):
        got = embed_dedup.similar_vectors(df, cell=cell, block=block, recall=0.999).collect()
        found = sum(r.n_links for r in got) / sum(n.values())
        assert found >= 0.999 and len(got) == len(rows)
        if cell == 64:
            assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n[i], want[i], want[i] == i) for i, *_ in rows}
    assert embed_dedup.similar_vectors(df.limit(0)).count() == 0
    twice = df.where("vec_id = 0").selectExpr("null as vec_id", "embedding", "label").unionByName(df.where("vec_id = 0").select("vec_id", "embedding", "label"))
    assert {(r.vec_id, r.n_links) for r in embed_dedup.similar_vectors(twice).collect()} == {(None, 0), (0, 0)}


def test_groups_of_any_size_have_their_own_grid(spark):
    """One large label among many tiny ones: its grid has many cells, and recall is held against brute force."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((700, 24))
    noise = rng.standard_normal((3, 700, 24)) * rng.choice([0.1, 0.3, 0.36], (3, 700, 1))
    x = np.concatenate([base, *(base + noise)]).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(10_000 + k, x[k % 9].tolist(), k // 2 + 1) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.93
    np.fill_diagonal(linked, False)
    want = components(range(len(x)), zip(*np.nonzero(linked)))
    for block in (4096, 100):
        got = {r.vec_id: r for r in embed_dedup.similar_vectors(df, cell=16, block=block).collect()}
        assert len(got) == len(rows)
        counts = np.array([got[k].n_links for k in range(len(x))])
        assert (counts <= linked.sum(1)).all() and counts.sum() >= 0.999 * linked.sum()
        assert sum(got[k].component_id == want[k] for k in range(len(x))) >= 0.995 * len(x)
        assert all(got[10_000 + k].n_links == (x[k % 9] == x[(k ^ 1) % 9]).all() for k in range(400))


def test_rows_of_one_id_are_compared(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [1.0, 0.1], 1), (7, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.similar_vectors(df).collect()) == [(5, 1, 5), (5, 1, 5), (7, 0, 7)]
    rows = [(0, [1.0, 1.0]), (1, [0.5, 0.0]), (1, [1.0, 0.0]), (0, [1.0, 0.5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i == 0).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 0, 6144), (1, 0, 6144), (2, 1, 4096), (2, 1, 4096), (3, 1, 2048), (3, 1, 2048)]


def test_top_k(spark):
    rows = vector_rows()
    rows += [(9000 + n, rows[0][1], 0) for n in range(30)]  # ties
    whole = {}
    for i, v, _ in rows:
        if v and None not in v and np.isfinite(v).all():
            x = np.zeros(16)
            x[: len(v)] = v
            whole[i] = np.floor(64 * x).astype(int)
    want = {}
    for q in whole:
        if q % 5 == 0:
            best = sorted((-int(whole[q] @ y), i) for i, y in whole.items() if i != q)[:7]
            want[q] = [(i, -s) for s, i in best]
    df = spark.createDataFrame(rows + [(None, [1.0] * 16, 0)], "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as score")
    for group, block in ((2048, 1024), (40, 9)):
        got = collections.defaultdict(list)
        for r in sorted(topk.top_k(df, lambda i: i % 5 == 0, k=7, group=group, block=block).collect(), key=lambda r: r["rank"]):
            got[r.query_id].append((r.vec_id, r.score))
        assert got == want
    few = df.where("vec_id < 4")
    assert topk.top_k(few, lambda i: i == 0).count() == 3
    assert topk.top_k(df.limit(0), lambda i: i == 0).count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join("w" for _ in range(int(rng.integers(0, 30)))), str(rng.choice(["en", "de"])), "src" + str(rng.choice([0, 0, 0, 1, 2, 3]))) for k in range(400)]
    rows += [(500, None, None, None), (501, "", "en", "src0"), (7, rows[7][1], rows[7][2], rows[7][3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as budget", "2 as hash")
    mix = mixing.Mix(domain={"d0": 1, "d1": 3, "d2": 2}, lang={"en": 2}, source={"src3": 0}, max_epochs=2)
    got = mixing.mixed(docs, mix, digits=1).toPandas()
    again = mixing.mixed(docs.repartition(7), mix, digits=3).toPandas()
    key = ["doc_id", "epoch", "source"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert not (got.source == "src3").any()
    supply = mixing._leaf_columns(docs, mixing.domain_of, mixing.words).toPandas().groupby("source").n_tokens.sum()
    # d1 wants half of all, and is given what its one source has twice over; the rest goes to d0 and d2
    assert got[got.source == "src1"].n_tokens.sum() == 2 * supply["src1"]
    assert got.n_tokens.sum() <= supply.sum() and got.n_tokens.sum() > supply.sum() - 6 * 30
    # a leaf's last epoch is a prefix in the order of the hash
    full = pd.Series(got.groupby("doc_id").epoch.max())
    assert full.max() <= 1
    assert mixing.mixed(docs.limit(0), mix).count() == 0
    same = mixing.mixed_documents(docs, mix)
    assert same.columns == docs.columns and same.count() == len(got)
