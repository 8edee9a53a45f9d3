"""Parameter grids evaluated in one pass, Pareto analysis and report deltas."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import constants as C
from claimloom.operators import metrics as M
from claimloom.operators import verify as Y
from claimloom.operators.numbering import numbered, range_bucket
from claimloom.operators.retrieval import broadcast_if_small
from claimloom.session import written


def float_range(low: int, high: int, step: int) -> list[float]:
    """Hundredths from low to high inclusive."""
    return [i / 100 for i in range(low, high + 1, step)]


def threshold_grid(spark, supports: list[float], refutes: list[float], margins: list[float] | None = None) -> DataFrame:
    """(grid_ord, support_threshold, refute_threshold, margin), margins outermost."""
    rows = [(s, r, m) for m in (margins or [0.0]) for s in supports for r in refutes]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "grid_ord int, support_threshold double, refute_threshold double, margin double")


def evaluate_grid(scored: DataFrame, grid: DataFrame, with_margin: bool = False) -> DataFrame:
    """Scores (y, supported, refuted) under every grid row: accuracy, macro F1 over the three labels, refuted rate.

    The grid is a constant number of rows; the scores are read once and first reduced to
    one row for each distinct (y, supported, refuted).
    """
    few = scored.groupBy("y", "supported", "refuted").agg(F.count("*").alias("w"))
    s, r = F.col("supported"), F.col("refuted")
    p = Y.decide_with_margin(s, r, F.col("support_threshold"), F.col("refute_threshold"), F.col("margin")) if with_margin else Y.decide(s, r, F.col("support_threshold"), F.col("refute_threshold"))
    keys = ["grid_ord", "support_threshold", "refute_threshold", "margin"]
    cells = few.crossJoin(F.broadcast(grid)).withColumn("p", p).groupBy(*keys, "y", "p").agg(F.sum("w").alias("w"))
    def total(cond):
        return F.sum(F.when(cond, F.col("w")).otherwise(0))
    sums = [total(F.col("y") == F.col("p")).alias("right"), F.sum("w").alias("n"), total(F.col("p") == C.REFUTED).alias("refuted_n")]
    for i, label in enumerate(C.LABELS):
        sums += [total((F.col("y") == label) & (F.col("p") == label)).alias(f"tp{i}"), (total(F.col("y") == label) + total(F.col("p") == label)).alias(f"both{i}")]
    f1 = [F.when(F.col(f"tp{i}") > 0, 2.0 * F.col(f"tp{i}") / F.col(f"both{i}")).otherwise(0.0) for i in range(3)]
    return cells.groupBy(*keys).agg(*sums).select(*keys, (F.col("right") / F.col("n")).alias("accuracy"), ((f1[0] + f1[1] + f1[2]) / 3).alias("macro_f1"), (F.col("refuted_n") / F.col("n")).alias("refuted_rate"))


def best_row(evaluated: DataFrame, by: str = "macro_f1") -> DataFrame:
    """The first grid row with the largest value."""
    return evaluated.orderBy(F.round(by, 9).desc(), "grid_ord").limit(1)


def top_rows(evaluated: DataFrame, n: int = 10) -> DataFrame:
    return evaluated.orderBy(F.round("macro_f1", 9).desc(), F.round("accuracy", 9).desc(), "grid_ord").limit(n)


def evaluate_gates(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Pairs (y, p, overlap) under each gate threshold: accuracy and macro F1 over labels seen."""
    grid = pairs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(thresholds)], "grid_ord int, threshold double")
    cells = pairs.crossJoin(F.broadcast(grid)).select("grid_ord", "threshold", "y", Y.gated_label(F.col("p"), F.col("overlap"), F.col("threshold")).alias("p"))
    by = ("grid_ord", "threshold")
    return M.accuracy(cells, by).join(M.macro_f1(cells, by), list(by))


#: What a point is judged by, each with the sign that makes less better; blocks that are compared at once, groups a task merges.
DIMENSIONS = (("macro_f1", -1.0), ("latency_ms", 1.0), ("memory_mb", 1.0), ("deployment_feasibility", -1.0))
COMPARED, MERGED = 512, 16


def skyline(costs: np.ndarray) -> np.ndarray:
    """Which rows no other row dominates: nowhere more and somewhere less. Equal rows do not dominate each other.

    Whatever dominates a row comes before it in lexicographic order, so rows in that
    order are compared only with what was kept of those before, a block at a time.
    """
    order = np.lexsort(costs.T[::-1])
    kept = np.zeros(len(costs), bool)
    held = np.empty((0, costs.shape[1]))
    for at in range(0, len(order), COMPARED):
        some = order[at : at + COMPARED]
        alive = np.ones(len(some), bool)
        for other in (*(held[i : i + COMPARED] for i in range(0, len(held), COMPARED)), costs[some]):
            left = np.nonzero(alive)[0]
            mine = costs[some[left]][:, None, :]
            alive[left] = ~((other[None] <= mine).all(2) & (other[None] < mine).any(2)).any(1)
        kept[some[alive]] = True
        held = np.concatenate([held, costs[some[alive]]])
    return kept


def pareto_frontier(points: DataFrame) -> DataFrame:
    """Points that no other dominates: at least as good in macro_f1, latency_ms, memory_mb and deployment_feasibility, better in one.

    Each partition takes the skyline of its distinct points; skylines then merge up a
    tree, so a task holds the skylines of MERGED groups at most, and the last one the
    frontier, 32 bytes a point. Points that lack a value are kept and dominate none, as do
    NaN values; equal points stay or go together.
    """
    names, signs = [d for d, _ in DIMENSIONS], np.array([s for _, s in DIMENSIONS])
    dims = [F.col(n).cast("double").alias(n) for n in names]
    whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) for n in names])
    schema = "part int, " + ", ".join(f"{n} double" for n in names)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            held = held[skyline(held.to_numpy(np.float64) * signs)]
        if held is not None and len(held):
            yield held.assign(part=np.int32(part))[["part", *names]]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[skyline(pdf[names].to_numpy(np.float64) * signs)]

    now = written(points.where(whole).select(*dims).distinct().mapInPandas(local, schema))
    parts, span = (now.agg(F.max("part")).first()[0] or 0) + 1, 1
    while span < parts:
        span *= MERGED
        now = written(now.groupBy(F.floor(F.col("part") / span)).applyInPandas(merge, schema))
    best = broadcast_if_small(now.select(*[F.col(n).alias(f"__{n}") for n in names]))
    same = reduce(lambda a, b: a & b, [F.col(n).cast("double") == F.col(f"__{n}") for n in names])
    return points.where(whole).join(best, same, "left_semi").unionByName(points.where(~F.coalesce(whole, F.lit(False))))


def pareto_report(points: DataFrame) -> DataFrame:
    """All points with a frontier flag, best F1 first, then latency, then memory."""
    flags = pareto_frontier(points).select("model").distinct().withColumn("frontier", F.lit(True))
    order = [F.col("macro_f1").desc(), "latency_ms", "memory_mb", "model"]
    flagged = points.join(flags, "model", "left").withColumn("frontier", F.coalesce("frontier", F.lit(False)))
    return numbered(flagged, -range_bucket(points, "macro_f1"), order, "place")


def feasibility(latency_ms, memory_mb):
    return F.greatest(F.lit(0.0), 1 - latency_ms / 1000 - memory_mb / 500)


def deltas(reports: DataFrame, baseline: str, values: list[str], name: str = "profile") -> DataFrame:
    """Each report's values less the baseline's, and whether it is the first with the largest first value."""
    base = reports.where(F.col(name) == baseline).select(*[F.col(v).alias(f"b_{v}") for v in values]).limit(1)
    best = Window.orderBy(F.round(values[0], 9).desc(), "ord")
    out = reports.withColumn("best", F.row_number().over(best) == 1).crossJoin(F.broadcast(base))
    return out.select("ord", name, *values, *[(F.col(v) - F.col(f"b_{v}")).alias(f"delta_{v}") for v in values], "best")
