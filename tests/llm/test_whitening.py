"""Whitening against a full eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], SCHEMA)


def check(docs, axes=4):
    """The operator's rows against numpy on the collected table."""
    rows = [(r["vec_id"], r["embedding"]) for r in docs.collect()]
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * float(c)) for c in v] for _, v in kept], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = whitening.whiten_embeddings(docs, axes=axes).toPandas()
    assert len(got) == len(kept) * min(axes, x.shape[1])
    assert got["n"].unique().tolist() == [n]
    for j in range(min(axes, x.shape[1])):
        mine = got[got["component"] == j + 1].sort_values(["vec_id"], kind="stable")
        assert mine["deviation"].tolist() == ((n * x - sums) ** 2).sum(axis=1).tolist()
        assert mine["explained"].iloc[0] == pytest.approx(values[j] / values.sum(), rel=1e-9)
        want = (x - sums / n) @ vectors[:, j] / np.sqrt(values[j])
        have = mine["whitened"].to_numpy()
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    return got


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = check(docs)
    assert queries.op13_embedding_whitening(spark, sf).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == docs.count() * 4


def test_odd_vectors(spark):
    """Nulls, non-finite entries and a vector that half of the rows share."""
    draw = np.random.default_rng(3)
    rows = [*draw.normal(size=(200, 6)).astype(float).tolist(), *[[0.5] * 6] * 200, None, [None] * 6, [math.nan] * 6, [math.inf] + [0.0] * 5]
    docs = frame(spark, rows).withColumn("component", F.lit("clash")).withColumn("__x", F.lit(1))
    check(docs)


def test_fewer_dimensions_than_axes(spark):
    check(frame(spark, np.random.default_rng(5).normal(size=(50, 3)).astype(float).tolist()))


def test_no_variance(spark):
    got = whitening.whiten_embeddings(frame(spark, [[1.0, 2.0]] * 3)).toPandas()
    assert len(got) == 6 and got["whitened"].isna().all() and got["explained"].isna().all() and (got["deviation"] == 0).all()
    flat = whitening.whiten_embeddings(frame(spark, [[float(i), 1.0] for i in range(9)])).toPandas()
    second = flat[flat["component"] == 2]
    assert second["whitened"].isna().all() and (second["explained"] == 0).all()
    assert flat[flat["component"] == 1]["explained"].iloc[0] == pytest.approx(1.0)


def test_empty_and_ragged(spark):
    assert whitening.whiten_embeddings(frame(spark, [[1.0]]).where("1 = 0")).count() == 0
    assert whitening.whiten_embeddings(frame(spark, [[], []])).count() == 0
    got = whitening.whiten_embeddings(frame(spark, [[1.0], [2.0, 3.0], [0.0, 1.0], []])).toPandas()
    assert len(got) == 8 and got["whitened"].notna().all()


def test_beyond_a_long(spark):
    got = whitening.whiten_embeddings(frame(spark, [[3e15, 0.0], [0.0, 0.0], [1.0, 1.0]])).toPandas()
    assert got[got["component"] == 1]["deviation"].isna().any()


def test_lobpcg_certifies():
    """Clustered and repeated eigenvalues; far fewer products than dimensions."""
    draw = np.random.default_rng(11)
    q = np.linalg.qr(draw.standard_normal((300, 300)))[0]
    values = np.concatenate([[50.0, 50.0, 49.9, 20.0, 19.0], 10.0 * draw.random(295)])
    matrix = (q * values) @ q.T
    asked = []

    def product(block):
        asked.append(block.shape[1])
        return matrix @ block

    axes, found, residual, rounds = whitening.lobpcg(product, 300, 4)
    assert found == pytest.approx([50.0, 50.0, 49.9, 20.0], rel=1e-11)
    assert residual <= whitening.CERTIFIED and np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12
    assert len(asked) <= rounds + 2 and max(asked) <= 12
    with pytest.raises(RuntimeError, match="residual"):
        whitening.lobpcg(product, 300, 4, rounds=2)


def test_rounds_do_not_follow_the_shuffle(spark, monkeypatch):
    """A vector table over many shuffle partitions is read in as many tasks a round as there are cores."""
    seen = []
    of_all = whitening.total
    monkeypatch.setattr(whitening, "total", lambda blocks, *a: seen.append(blocks.rdd.getNumPartitions()) or of_all(blocks, *a))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        check(frame(spark, np.random.default_rng(6).normal(size=(300, 8)).astype(float).tolist()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(seen) <= spark.sparkContext.defaultParallelism
    assert whitening.pieces(10 * whitening.PIECE, 4) == 10
