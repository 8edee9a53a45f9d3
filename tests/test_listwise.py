"""The listwise ranker: gradients and splits by brute force, held-out nDCG, probe order; places and zips."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import listwise, ranking
from claimloom.operators.numbering import placed, zip_rows

NAMES = ("f0", "f1", "f2")


@pytest.fixture(scope="module")
def rows(spark):
    """80 queries of 12 candidates: relevance follows a threshold on f0 within the query and an interaction, f2 is noise of large scale."""
    draw, out = random.Random(1), []
    for q in range(80):
        for d in range(12):
            f0, f1 = draw.random(), draw.random()
            out.append((q, q * 100 + d, f0, f1, draw.gauss(0, 100), int((f0 > 0.7) != (f1 > 0.8) and draw.random() < 0.9)))
    return spark.createDataFrame(out, "query_id long, doc_id long, f0 double, f1 double, f2 double, relevance int")


def test_gradients_by_pairs():
    draw = np.random.default_rng(3)
    for _ in range(20):
        n = int(draw.integers(1, 9))
        s, y = np.round(draw.normal(size=n), 1), draw.integers(0, 3, n).astype(float)
        place = {i: r for r, i in enumerate(sorted(range(n), key=lambda i: (-s[i], i)))}
        ideal = sum((2**v - 1) / math.log2(r + 2) for r, v in enumerate(sorted(y, reverse=True)))
        g, h = [0.0] * n, [0.0] * n
        for i, j in itertools.permutations(range(n), 2):
            if y[i] > y[j]:
                change = abs((2 ** y[i] - 2 ** y[j]) * (1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2))) / ideal
                wish = 1 / (1 + math.exp(s[i] - s[j]))
                g[i], g[j] = g[i] + wish * change, g[j] - wish * change
                h[i], h[j] = h[i] + wish * (1 - wish) * change, h[j] + wish * (1 - wish) * change
        got = listwise.lambdas(s, y)
        assert np.allclose(got[0], g) and np.allclose(got[1], h) and abs(got[0].sum()) < 1e-9


def test_first_split_by_brute_force(spark, rows):
    model = listwise.fit(rows, NAMES, trees=1, depth=1)
    data = rows.toPandas()
    g, h = np.zeros(len(data)), np.zeros(len(data))
    # before the first tree all scores tie, and candidates stand in the order of their hash
    tie = rows.select("doc_id", F.xxhash64("query_id", *NAMES).alias("tie")).toPandas().set_index("doc_id")["tie"]
    data["tie"] = data["doc_id"].map(tie)
    for _, part in data.groupby("query_id"):
        part = part.sort_values("tie")
        if part["relevance"].nunique() > 1:
            a, b = listwise.lambdas(np.zeros(len(part)), part["relevance"].to_numpy(float))
            g[part.index], h[part.index] = a, b
    keep = h > 0
    best = max(
        (g[keep & (data[f] <= c)].sum() ** 2 / (h[keep & (data[f] <= c)].sum() + 1) + g[keep & (data[f] > c)].sum() ** 2 / (h[keep & (data[f] > c)].sum() + 1), f, c)
        for f in NAMES for c in rows.select(F.percentile_approx(f, [i / 64 for i in range(1, 64)], 10_000)).first()[0]
    )
    (tree,) = model.trees
    assert (NAMES[tree.feature[0]], tree.cut[0]) == best[1:]
    side = keep & (data[best[1]] > best[2])
    assert tree.value[1] == pytest.approx(0.1 * g[side].sum() / (h[side].sum() + 1))




def listwise_rank(scored):
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("learned_score"), "doc_id")
    return scored.select("query_id", F.col("doc_id").alias("ord"), "relevance", F.row_number().over(order).alias("rank"))


def mean_ndcg(scored, k=5):
    total = []
    for _, part in listwise_rank(scored).toPandas().groupby("query_id"):
        rel = part.sort_values("rank")["relevance"].to_numpy()
        if rel.sum():
            total.append((rel[:k] / np.log2(np.arange(min(k, len(rel))) + 2)).sum() / (1 / np.log2(np.arange(min(k, rel.sum())) + 2)).sum())
    return np.mean(total)


def test_held_out_queries(spark, rows):
    """On queries it never saw it ranks better than the linear ranker, whose weights a noisy feature spoils."""
    train, test = rows.where("query_id < 50"), rows.where("query_id >= 50")
    name, score = listwise.train_best(train, NAMES)
    assert name == "listwise"
    linear = ranking.linear_score(test, ranking.linear_ranker(train, NAMES), NAMES)
    ours = mean_ndcg(score(test))
    assert ours >= mean_ndcg(linear) and ours > 0.8
    model = listwise.fit(train, NAMES)
    table = test.toPandas()
    by_numpy = sum(t.scores(table[list(NAMES)].to_numpy()) for t in model.trees)
    by_column = model.score(test).select("doc_id", "learned_score").toPandas().set_index("doc_id")["learned_score"]
    assert np.allclose(by_numpy, by_column.loc[table["doc_id"]])


def test_probe_order(spark, rows):
    def missing(training, features):
        raise ImportError("no such back end")

    order = (("absent", missing), *listwise.PROBES[1:])
    assert listwise.train_best(rows, NAMES, order)[0] == "logistic"
    none = rows.where("relevance = 0")
    name, score = listwise.train_best(none, NAMES)
    assert name == "linear" and {r["learned_score"] for r in score(none.limit(3)).collect()} == {0.0}
    with pytest.raises(ValueError, match="no query"):
        listwise.fit(none, NAMES)


def test_training_rows(spark, rows):
    records = rows.select("query_id").distinct()
    assert listwise.training_rows(records, rows).count() == rows.count()
    few = listwise.training_rows(records, rows, 2)
    assert {r["query_id"] for r in few.select("query_id").distinct().collect()} == {0, 1}


def test_places_and_zip(spark):
    left = spark.createDataFrame([(v, f"l{i}") for i, v in enumerate([5, 1, 1, 10**12, -3, None])], "v long, l string").repartition(3)
    right = spark.createDataFrame([(float(i),) for i in range(4)], "w double").repartition(3)
    got = [(r["place"], r["v"]) for r in placed(left, ["v"]).orderBy("place").collect()]
    assert got == [(1, None), (2, -3), (3, 1), (4, 1), (5, 5), (6, 10**12)]
    zipped = zip_rows(left, right, ["v", "l"], ["w"])
    assert sorted((r["place"], r["l"], r["w"]) for r in zipped.collect()) == [(1, "l5", 0.0), (2, "l4", 1.0), (3, "l1", 2.0), (4, "l2", 3.0)]
    assert zip_rows(left, right.where("w < 0"), ["v"], ["w"]).count() == 0
    with pytest.raises(ValueError, match="both"):
        zip_rows(left, left, ["v"], ["v"])
