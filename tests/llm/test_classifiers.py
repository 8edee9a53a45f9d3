import zlib

import numpy as np
import pytest

from claimloom.llm import _learn, quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs.join(labels, "doc_id").select("doc_id", "text", "toxic", "quality").orderBy("doc_id").collect()


def split(rows, label, modulus, out):
    held = [zlib.crc32(str(r["doc_id"]).encode()) % modulus == out for r in rows]
    fit = [(r["text"], r[label]) for r, h in zip(rows, held, strict=True) if not h]
    test = [(r["text"], r[label]) for r, h in zip(rows, held, strict=True) if h]
    return ([t for t, _ in fit], np.array([y for _, y in fit])), ([t for t, _ in test], np.array([y for _, y in test]))


def test_toxicity_on_held_out_rows(rows):
    fit, (texts, y) = split(rows, "toxic", 4, 2)
    model = toxicity.fit_texts(*fit)
    score = model.score(texts, model.words())
    assert _learn.auc(score, y) > 0.98
    hit = score >= 0.3
    assert y[hit].mean() > 0.9 and hit[y == 1].mean() > 0.9
    assert abs(score.mean() - y.mean()) < 0.03 and 0 <= score.min() and score.max() <= 1


def test_quality_on_held_out_rows(rows):
    fit, (texts, y) = split(rows, "quality", 3, 1)
    model = quality.fit_texts(*fit)
    score = model.score(texts, quality._Words())
    assert _learn.auc(score, y) > 0.98 and ((score >= 0.5) == y).mean() > 0.97


def test_machine_against_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)), np.zeros((1, 1)))
    index, value = np.array([2, 5, 11, 19]), np.array([0.5, 1.0, 2.0, 0.25])
    pairs = sum(m.vectors[index[i]] @ m.vectors[index[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    assert m.margin(index, value) == pytest.approx(0.3 + m.weight[index] @ value + pairs)


def test_isotonic():
    x, p = _learn.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]), smooth=0)
    assert p.tolist() == [0.0, 0.5, 0.5, 1.0] and x.tolist() == [1, 2, 3, 4]


def test_degenerate_fits():
    for module, attr in ((toxicity, "words"), (quality, None)):
        for texts, y in (([], np.empty(0, int)), (["a"], np.array([1]))):
            model = module.fit_texts(texts, y)
            known = model.words() if attr else quality._Words()
            s = model.score(["", "x y", "z " * 5000], known)
            assert len(s) == 3 and ((0 <= s) & (s <= 1)).all()


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, odd_docs, no_docs, module, label):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (8, None), (9, 0)], f"doc_id long, {label} int")
    model = module.fit(odd_docs, labels)
    got = module.score_documents(odd_docs.withColumnRenamed("lang", "score"), model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert module.score_documents(no_docs, module.fit(no_docs, labels)).count() == 0


def test_filters_keep_columns(odd_docs):
    model = toxicity.fit_texts(["you idiot moron " * 3] * 10 + ["fine words here"] * 40, np.array([1] * 10 + [0] * 40))
    kept = toxicity.drop_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_first_split_against_brute_force():
    """One round of depth one takes the cut with the largest gain of all cuts of all features."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (300, 5)).astype(float)
    y = ((x[:, 3] > 2) ^ (rng.random(300) < 0.2)).astype(int)
    trees = toxicity.Trees(rounds=1, depth=1)
    trees.fit(x, y)
    p = (y.sum() + 0.5) / 301
    g, h = p - y, np.full(300, p * (1 - p))
    best = max(
        (g[left].sum() ** 2 / (h[left].sum() + trees.l2) + g[~left].sum() ** 2 / (h[~left].sum() + trees.l2), f, cut)
        for f in range(5) for cut in range(6)
        if (left := x[:, f] <= cut).any() and not left.all() and min(h[left].sum(), h[~left].sum()) >= trees.least
    )
    which, where, leaf = trees.trees[0]
    assert which[0] == best[1] and best[2] <= where[0] < best[2] + 1
    left = x[:, best[1]] <= best[2]
    want = np.where(left, -trees.rate * g[left].sum() / (h[left].sum() + trees.l2), -trees.rate * g[~left].sum() / (h[~left].sum() + trees.l2))
    assert trees.margin(x) == pytest.approx(trees.base + want)


@pytest.mark.parametrize(("name", "modulus", "out", "cut"), [("op3_toxicity", 4, 2, 0.3), ("op6_quality", 3, 1, 0.5)])
def test_queries(spark, sf, sample_docs, name, modulus, out, cut):
    from claimloom.llm.queries import QUERIES

    got = QUERIES[name](spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    found = {r["doc_id"]: r for r in got.collect()}
    assert sorted(found) == sorted(r["doc_id"] for r in sample_docs.collect())
    for d, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % modulus == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "you idiot", 3, 4, "k")], "doc_id long, text string, __toxicity int, __quality int, Score string")
    tox = toxicity.fit_texts(["you idiot moron " * 3] * 10 + ["fine words here"] * 40, np.array([1] * 10 + [0] * 40))
    assert toxicity.drop_toxic(df, tox, 2.0).columns == df.columns
    good = quality.fit_texts(["some fine words here"] * 10 + ["!! | !!"] * 10, np.array([1] * 10 + [0] * 10))
    assert quality.keep_good(df, good, -1.0).first()[:] == (1, "you idiot", 3, 4, "k")
