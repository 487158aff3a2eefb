"""Quality and toxicity: held-out accuracy on the given tables, counterfactual pairs, edge rows."""

import math
import zlib

import numpy as np
import pytest
import xxhash

from locarium.llm import quality, toxicity
from locarium.llm.linear import _MARKS, Features, Ftrl

SF = "/root/testdata/sf0.1"


def joined(spark, df, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    return df.join(labels, "doc_id").where("held_out").toPandas()


@pytest.mark.parametrize("op,label,folds,fold,least", [(quality.op4_quality, "quality", 4, 2, 0.95), (toxicity.op10_toxicity, "toxic", 5, 0, 0.95)])
def test_held_out(spark, op, label, folds, fold, least):
    df = op(spark, SF)
    all_rows = df.toPandas()
    assert len(all_rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(h == (zlib.crc32(str(i).encode()) % folds == fold) for i, h in zip(all_rows.doc_id, all_rows.held_out))
    assert all_rows.score.between(0, 1).all()
    got = joined(spark, df, label)
    assert (got.predicted == got[label]).mean() >= least
    hard = got[got[label] == (1 - (label == "quality"))]
    assert (hard.predicted == hard[label]).mean() >= 0.8


def docs_and_labels(spark):
    texts = [(i, "all good and fine words" if i % 2 else "### %%% $$$ junk", "en", "s", 1) for i in range(200)]
    docs = spark.createDataFrame([*texts, (1000, None, "en", "s", 1), (1001, "", None, None, None), (None, "good", "en", "s", 1), (3, "all good and fine words", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([*[(i, i % 2, 1 - i % 2) for i in range(200)], (5, None, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("train,score", [(quality.train_quality, quality.score_quality), (toxicity.train_toxicity, toxicity.score_toxicity)])
def test_edges(spark, train, score):
    docs, labels = docs_and_labels(spark)
    out = score(docs.selectExpr("*", "1 as score", "2 as held_out"), train(docs, labels)).toPandas()
    assert len(out) == 204 and out.score.notna().all() and out.held_out.notna().all()
    none = score(docs, train(docs, labels.limit(0))).toPandas()
    assert np.allclose(none.score, 0.5)
    one = score(docs, train(docs, labels.where("quality = 1"))).toPandas()
    assert one.score.notna().all()
    assert score(docs.limit(0), train(docs, labels)).count() == 0
    same = score(docs, train(docs, labels)).toPandas().sort_values(["doc_id", "score"])
    assert np.array_equal(same.score.to_numpy(), out.sort_values(["doc_id", "score"]).score.to_numpy())


def test_counterfactual_penalty():
    """Where toxic texts name one group more often, the penalty pulls neutral mentions down."""
    rng, f, swaps = np.random.default_rng(1), Features(16, 4), toxicity.Swaps()
    texts = [(f"the {'muslims' if rng.random() < (0.9 if y else 0.1) else 'people'} are {'scum idiots' if y else 'kind folk'} {rng.integers(99)}", int(y)) for y in rng.random(400) < 0.5]
    scores = []
    for strength in (0.0, 1.0):
        m = Ftrl(16, alpha=1.0, l1=0.5, l2=0.1)
        for _ in range(5):
            for t, y in texts:
                m.learn(f(t), y)
                for v in swaps(t) if strength else ():
                    m.agree(f(t), f(v), strength)
        w = m.weights()
        gap = [w[f(f"the {g} came here")].sum() for g in ("muslims", "christians")]
        scores.append(abs(gap[0] - gap[1]))
        assert w[f("the people are scum idiots 5")].sum() + w[-1] > 0
    assert scores[1] < 0.5 * scores[0]
    assert swaps("no such term") == [] and all("muslim" not in s.lower() for s in swaps("A Muslim said"))


def plain_features(text, bits, prefix):
    """Features by loops over words, in Python integers."""
    wide, odd = (1 << 64) - 1, 0x9E3779B97F4A7C15
    h = lambda x: xxhash.xxh64_intdigest(x.encode())
    words, out, one = text.lower().split(), [], []
    for w in words:
        bare = w.strip(_MARKS)
        one.append(h(bare or w))
        at = w.find(bare)
        out += [one[-1], h("\0m") if bare == w else h("\0m" + w[:at] + "\1" + w[at + len(bare) :][:16])]
        out += [h("\0p" + bare[:prefix])] if prefix else []
    out += [(a * 31 + b) * odd & wide for a, b in zip(one, one[1:])]
    if words:
        out.append((int(12 * sum(a == b for a, b in zip(words, words[1:])) / len(words)) + 1) * 0x51ED27F1)
    return sorted({(x * odd & wide) >> (64 - bits) for x in out})


@pytest.mark.parametrize("prefix", [0, 4])
def test_features_against_loops(prefix):
    f = Features(12, prefix)
    for text in ("", "one", "A b, (c) c c -- «d» é", "w" * 90 + " " + "w" * 90 + " x", "!!! ... a!!!", "long " * 5000):
        assert f(text).tolist() == plain_features(text, 12, prefix)


def labelled_texts(n=240):
    rng = np.random.default_rng(9)
    vocabulary = [f"word{k}" for k in range(60)]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.5)
        words = [str(rng.choice(vocabulary)) for _ in range(int(rng.integers(0, 25)))]
        words += [str(rng.choice(["bad", "vile", "scum"] if y else ["kind", "fine", "calm"])) for _ in range(2)]
        if rng.random() < (0.8 if y else 0.2):
            words.insert(0, "muslims")
        rows.append((i, " ".join(words) + ".", y))
    return rows


def dense_weights(rows, folds, fold, bits, prefix, epochs, seed, alpha, l1, l2, swaps=None, strength=0.0):
    """FTRL over whole weight vectors, one coordinate formula for all."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    first, second = np.full(size, l1), np.full(size, l2)
    first[-1] = second[-1] = 0

    def vector(text, bias):
        x = np.zeros(size)
        x[plain_features(text, bits, prefix)] = 1
        x[-1] = bias
        return x

    def weights():
        return np.where(np.abs(z) <= first, 0, -(z - np.sign(z) * first) / ((1 + np.sqrt(n)) / alpha + second))

    def step(g):
        nonlocal z, n
        z = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / alpha * weights()
        n = n + g * g

    data = [(vector(t, 1), y, [vector(v, 1) for v in swaps(t)] if swaps else []) for i, t, y in rows if zlib.crc32(str(i).encode()) % folds != fold]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            x, y, others = data[k]
            step((1 / (1 + math.exp(-weights() @ x)) - y) * x)
            for o in others:
                step(np.clip(strength * (weights() @ (x - o)), -1, 1) * (x - o))
    return weights()


def test_training_equals_dense_ftrl(spark):
    rows = labelled_texts()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = quality.train_quality(docs, labels, bits=12)
    want = dense_weights(rows, quality.FOLDS, quality.FOLD, 12, 0, 4, 11, 0.3, 1.0, 0.1)
    assert np.abs(got.weights[:-1] - want[:-1]).max() < 1e-6 and np.count_nonzero(want) > 5
    got = toxicity.train_toxicity(docs, labels, bits=12)
    want = dense_weights(rows, toxicity.FOLDS, toxicity.FOLD, 12, 4, 8, 13, 1.0, 3.0, 0.1, toxicity.Swaps(), 1.0)
    assert np.abs(got.weights[:-1] - want[:-1]).max() < 1e-6 and np.count_nonzero(want) > 5
    # scores are the dense product of whole texts, very long ones too
    texts = [t for _, t, _ in rows[:20]] + ["", "kind " * 60_000]
    scored = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), got).toPandas().sort_values("doc_id")
    for s, t in zip(scored.score, texts):
        assert math.isclose(s, 1 / (1 + math.exp(-sum(float(got.weights[k]) for k in plain_features(t, 12, 4)) - float(got.weights[-1]))), abs_tol=1e-9)


def test_penalty_narrows_the_gap_of_groups(spark):
    rows = labelled_texts(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = [(k, f"{g} of word{k} met word{k + 1} here") for k in range(20) for g in ("muslims", "christians")]
    gaps = []
    for strength in (0.0, 1.0):
        model = toxicity.train_toxicity(docs, labels, bits=16, strength=strength)
        scores = [model.score(t) for _, t in neutral]
        gaps.append(np.mean(np.abs(np.array(scores[::2]) - np.array(scores[1::2]))))
        assert model.score("scum and vile") > 0.5 > model.score("kind and calm")
    assert gaps[1] < 0.5 * gaps[0]
