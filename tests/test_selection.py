"""Exact selection, skyline and bootstrap, against plain Python and on hot groups."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import grids, metrics, sampling


def plain(values, q):
    v = sorted(values)
    return v[int(np.rint(q / 100 * (len(v) - 1)))]


@pytest.mark.parametrize("limit", [1, 7, 50_000])
def test_percentiles_by_group(spark, limit):
    """Ties, outliers, a null group, groups of one and of equal values, all narrowed to brackets of `limit` values."""
    draw = random.Random(limit)
    groups = {
        "hot": [float(draw.choice([1, 2, 2, 2, 3, 10**12])) for _ in range(700)], "wide": [draw.uniform(-1, 1) for _ in range(800)], None: [draw.gauss(0, 1) for _ in range(60)],
        "one": [4.0], "same": [5.0] * 90, "jump": [0.0] * 300 + [1e300] * 300 + [0.5],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    percents = (0.0, 33.3, 50.0, 95.0, 100.0)
    got = {r["g"]: [r["p0"], r["p33_3"], r["p50"], r["p95"], r["p100"]] for r in metrics.nearest_rank_percentiles(df, "v", percents, ("g",), limit).collect()}
    assert got == {g: [plain(vs, q) for q in percents] for g, vs in groups.items()}


def test_percentiles_of_one_large_group(spark):
    """A million rows in one group: nothing puts the group in order."""
    df = spark.range(1_000_000).select(F.lit("all").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) * F.col("id") % 999_983).alias("v"))
    want = np.sort(df.select("v").toPandas()["v"].to_numpy())
    found = metrics.nearest_rank_percentiles(df, "v", (50.0, 99.0), ("g",))
    (row,) = found.collect()
    assert (row["p50"], row["p99"]) == tuple(want[int(np.rint(q * 999_999))] for q in (0.5, 0.99))
    (alone,) = metrics.nearest_rank_percentiles(df, "v", (50.0,), (), 1_000).collect()
    assert alone["p50"] == row["p50"]
    ordered = df.where("v < 0")
    assert metrics.nearest_rank_percentiles(ordered, "v", (50.0,), ("g",)).count() == 0


def dominated(p, q):
    return all(a <= b for a, b in zip(q, p, strict=True)) and any(a < b for a, b in zip(q, p, strict=True))


def test_skyline_by_all_pairs():
    draw = np.random.default_rng(2)
    for n, d, values in [(300, 4, 6), (1_500, 2, 50), (700, 3, 1_000), (0, 4, 2), (5, 1, 2)]:
        costs = draw.integers(0, values, (n, d)).astype(float)
        kept = grids.skyline(costs)
        rows = costs.tolist()
        assert kept.tolist() == [not any(dominated(p, q) for q in rows) for p in rows]


def points(spark, rows):
    return spark.createDataFrame(rows, "model string, macro_f1 double, latency_ms double, memory_mb double, deployment_feasibility double")


def test_frontier(spark):
    draw = random.Random(3)
    rows = [(f"m{i}", draw.randrange(12) / 10, float(draw.randrange(9)), float(draw.randrange(9)), draw.randrange(5) / 4) for i in range(600)]
    rows += [("x", None, 1.0, 1.0, 1.0), ("again", *rows[0][1:])]
    got = {r["model"] for r in grids.pareto_frontier(points(spark, rows).repartition(7)).collect()}
    cost = {m: (-f, a, b, -c) for m, f, a, b, c in rows if f is not None}
    assert got == {"x", *(m for m, p in cost.items() if not any(dominated(p, q) for q in cost.values()))}
    plan = grids.pareto_frontier(points(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert grids.pareto_frontier(points(spark, [])).count() == 0


def test_frontier_of_a_million(spark):
    """Few of a million points are on the frontier."""
    h = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10**6)) / 1e6
    far = spark.range(1_000_000).select(F.col("id").cast("string").alias("model"), (h(1) * 0.9).alias("macro_f1"), (10 + h(2)).alias("latency_ms"), (10 + h(3)).alias("memory_mb"), (h(4) * 0.9).alias("deployment_feasibility"))
    near = points(spark, [("a", 0.95, 5.0, 6.0, 0.95), ("b", 0.96, 6.0, 5.0, 0.95), ("c", 0.95, 6.0, 6.0, 0.95)])
    began = time.perf_counter()
    assert {r["model"] for r in grids.pareto_frontier(far.union(near)).collect()} == {"a", "b"}
    assert time.perf_counter() - began < 120


@pytest.mark.parametrize("n", [1, 5, 64, 100, 1_000])
def test_resamples_are_multinomial(n):
    """Blocks agree on how the draws split: each resample has n draws in all, and every row is taken once on average."""
    iterations = 400
    counts = np.concatenate([sampling.resample_counts(n, b, iterations, 9, 32) for b in range(-(-n // 32))], axis=1)
    assert counts.shape == (iterations, n) and (counts.sum(axis=1) == n).all()
    if n > 1:
        assert abs(counts.var() - (1 - 1 / n)) < 0.1
        assert np.abs(counts.mean(axis=0) - 1).max() < 0.3


def test_block_bootstrap(spark, monkeypatch):
    """The definition again in plain Python over lists, in blocks of 16 rows."""
    monkeypatch.setattr(sampling, "RESAMPLED", 1_024)
    draw = random.Random(6)
    rows = [(i, draw.random(), draw.random() + 0.1) for i in range(3_000)]
    df = spark.createDataFrame(rows, "ord long, a double, b double")
    (row,) = sampling.block_bootstrap(df.repartition(5), 300).collect()
    (again,) = sampling.block_bootstrap(df, 300).collect()
    diffs = [b - a for _, a, b in rows]
    means = []
    for it in range(300):
        means.append(0.0)
    for block in range(3):
        counts = sampling.resample_counts(3_000, block, 300, 42)
        for it in range(300):
            means[it] += sum(c * d for c, d in zip(counts[it].tolist(), diffs[block * 1_024 :], strict=False)) / 3_000
    means.sort()
    assert (row["ci_low"], row["ci_high"]) == pytest.approx((means[int(0.025 * 300)], means[int(0.975 * 300) - 1]), abs=1e-9)
    assert (again["ci_low"], again["ci_high"]) == pytest.approx((row["ci_low"], row["ci_high"]), abs=1e-9)
    assert row["ci_low"] < row["delta"] < row["ci_high"]
    golden = spark.createDataFrame([(0, 0.2, 0.3), (1, 0.4, 0.5), (2, 0.6, 0.7)], "ord long, a double, b double")
    (small,) = sampling.block_bootstrap(golden).collect()
    assert small["delta"] == pytest.approx(0.1) and small["ci_low"] <= 0.1 + 1e-9 and small["ci_high"] >= 0.1 - 1e-9
    assert sampling.block_bootstrap(golden.where("1 = 0")).first()["delta"] == 0.0
