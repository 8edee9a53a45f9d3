"""A listwise ranker: boosted trees on pairwise gradients weighted by what a swap changes in nDCG.

Queries lie whole in blocks of a written table. A job for each level of a tree works out
scores, gradients and histograms block by block and adds the histograms up; only those
(nodes x features x bins) and the trees pass through the driver. Every job starts from
the blocks and the trees so far, so a lost executor costs its blocks' work alone.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import constants as C
from claimloom.operators import ranking
from claimloom.session import written

log = logging.getLogger(__name__)

TREES, DEPTH, RATE, BINS = 32, 3, 0.1, 64
#: Queries of a block; added to the curvature of a leaf; least curvature of a leaf.
QUERIES, SMOOTH, LEAST = 256, 1.0, 1e-3


def lambdas(scores: np.ndarray, relevance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of every candidate of one query: for each pair of unlike relevance the wish to swap, times the nDCG a swap changes."""
    order = np.argsort(-scores, kind="stable")
    discount = np.empty(len(scores))
    discount[order] = 1.0 / np.log2(np.arange(len(scores)) + 2.0)
    gain = 2.0**relevance - 1.0
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(len(gain)) + 2.0)).sum()
    if ideal <= 0:
        return np.zeros(len(scores)), np.zeros(len(scores))
    better = relevance[:, None] > relevance[None, :]
    change = np.abs((gain[:, None] - gain[None, :]) * (discount[:, None] - discount[None, :])) / ideal
    wish = 1.0 / (1.0 + np.exp(np.clip(scores[:, None] - scores[None, :], -50, 50)))
    pull = np.where(better, wish * change, 0.0)
    bend = np.where(better, wish * (1.0 - wish) * change, 0.0)
    return pull.sum(1) - pull.sum(0), bend.sum(1) + bend.sum(0)


@dataclass(frozen=True)
class Tree:
    """Splits in heap order (feature -1: none), each with its cut, and the values of the lowest level."""

    feature: tuple[int, ...]
    cut: tuple[float, ...]
    value: tuple[float, ...]

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(levels):
            f, c = np.array(self.feature)[at], np.array(self.cut)[at]
            right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > c)
            at = 2 * at + 1 + right
        return at - (2**levels - 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(x, (len(self.feature) + 1).bit_length() - 1)]

    def column(self, features: list[Column], at: int = 0) -> Column:
        if at >= len(self.feature):
            return F.lit(self.value[at - len(self.feature)])
        if self.feature[at] < 0:
            return self.column(features, 2 * at + 1)
        return F.when(features[self.feature[at]] > self.cut[at], self.column(features, 2 * at + 2)).otherwise(self.column(features, 2 * at + 1))


@dataclass(frozen=True)
class ListwiseRanker:
    features: tuple[str, ...]
    trees: tuple[Tree, ...]

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with learned_score, by expressions alone; absent features count as 0."""
        values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features]
        return rows.withColumn("learned_score", sum((t.column(values) for t in self.trees), F.lit(0.0)))


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of a node's histograms [features, bins]: rows up to the bin go left; the first of equal gains."""
    left_g, left_h = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    all_g, all_h = g.sum(1)[:, None], h.sum(1)[:, None]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + SMOOTH) + right_g**2 / (right_h + SMOOTH) - all_g**2 / (all_h + SMOOTH)
    gain = np.where((left_h >= LEAST) & (right_h >= LEAST), np.round(gain, 12), -np.inf)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def histograms(x: np.ndarray, relevance: np.ndarray, sizes: np.ndarray, cuts: np.ndarray, trees: list[Tree], growing: Tree | None, level: int) -> np.ndarray:
    """[2, nodes, features, bins]: sums of gradient and curvature of a block's rows at a level of the growing tree."""
    scores = sum((t.scores(x) for t in trees), np.zeros(len(x)))
    g, h = np.zeros(len(x)), np.zeros(len(x))
    ends = np.cumsum(sizes)
    for a, b in zip(ends - sizes, ends, strict=True):
        g[a:b], h[a:b] = lambdas(scores[a:b], relevance[a:b])
    node = growing.nodes(x, level) if growing else np.zeros(len(x), np.int64)
    bins, width = cuts.shape[1] + 1, x.shape[1]
    out = np.zeros((2, 2**level, width, bins))
    for f in range(width):
        place = node * bins + np.searchsorted(cuts[f], x[:, f], side="left")
        out[0, :, f] = np.bincount(place, g, 2**level * bins).reshape(-1, bins)
        out[1, :, f] = np.bincount(place, h, 2**level * bins).reshape(-1, bins)
    return out


def fit(training: DataFrame, features: tuple[str, ...] = C.FEATURES, label: str = "relevance", trees: int = TREES, depth: int = DEPTH) -> ListwiseRanker:
    """Boosted trees from rows (query_id, features..., label); a query's rows are a ranking's depth and are held together.

    Absent features count as 0, absent labels as irrelevant. Raises ValueError where no
    query has rows of unlike relevance, as nothing can be learnt from it.
    """
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, f in enumerate(features)]
    rows = written(training.select("query_id", F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"), F.xxhash64("query_id", *values).alias("tie"), *values))
    mixed = rows.groupBy("query_id").agg(F.min("y").alias("a"), F.max("y").alias("b")).where("a < b")
    queries = mixed.count()
    if not queries:
        raise ValueError("no query has both relevant and other rows")
    names = [f"f{i}" for i in range(len(features))]
    quantiles = rows.select(*[F.percentile_approx(n, [i / BINS for i in range(1, BINS)], 10_000).alias(n) for n in names]).first()
    cuts = np.array([list(quantiles[n]) for n in names])  # repeated cuts leave their bins empty

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["query_id", "tie"], kind="stable")
        sizes = pdf.groupby("query_id", sort=True).size().to_numpy(np.int64)
        return pd.DataFrame({"x": [pdf[names].to_numpy(np.float64).tobytes()], "y": [pdf["y"].to_numpy(np.float64).tobytes()], "sizes": [sizes.tobytes()]})

    kept = rows.join(mixed.select("query_id"), "query_id", "left_semi")
    blocks = written(kept.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(-(-queries // QUERIES))).alias("block")).applyInPandas(pack, "x binary, y binary, sizes binary"))
    width = len(features)

    def summed(done: list[Tree], growing: Tree | None, level: int) -> np.ndarray:
        def of(r) -> np.ndarray:
            y = np.frombuffer(r["y"])
            return histograms(np.frombuffer(r["x"]).reshape(len(y), width), y, np.frombuffer(r["sizes"], np.int64), cuts, done, growing, level)

        return blocks.rdd.map(of).treeReduce(np.add)

    done: list[Tree] = []
    for _ in range(trees):
        feature, cut, value = [-1] * (2**depth - 1), [0.0] * (2**depth - 1), [0.0] * 2**depth
        for level in range(depth):
            sums = summed(done, Tree(tuple(feature), tuple(cut), tuple(value)), level)
            for node in range(2**level):
                g, h = sums[:, node]
                gain, f, b = best_split(g, h)
                at, leaf = 2**level - 1 + node, lambda gs, hs: RATE * gs / (hs + SMOOTH)
                if gain > 1e-9:
                    feature[at], cut[at] = f, float(cuts[f, b])
                if level == depth - 1:
                    sides = ((g[f, : b + 1].sum(), h[f, : b + 1].sum()), (g[f, b + 1 :].sum(), h[f, b + 1 :].sum())) if gain > 1e-9 else ((g[0].sum(), h[0].sum()),) * 2
                    value[2 * node : 2 * node + 2] = [leaf(*s) for s in sides]
        done.append(Tree(tuple(feature), tuple(cut), tuple(value)))
    return ListwiseRanker(tuple(features), tuple(done))


def _listwise(training: DataFrame, features: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    return fit(training, features).score


def _spark_ml(kind: str):
    def train(training: DataFrame, features: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
        from pyspark.ml.functions import vector_to_array

        if training.select("relevance").distinct().count() < 2:
            raise ValueError("only one class")
        model = ranking.train_ranker(training, kind, features)
        return lambda rows: model.transform(rows).withColumn("learned_score", vector_to_array("probability")[1]).select(*rows.columns, "learned_score")

    return train


def _linear(training: DataFrame, features: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    weights = written(ranking.linear_ranker(training, features))
    return lambda rows: ranking.linear_score(rows, weights, features)


#: Rankers in the order they are tried; the last always works.
PROBES = (("listwise", _listwise), ("logistic", _spark_ml("logistic")), ("gbt", _spark_ml("gbt")), ("linear", _linear))


def train_best(training: DataFrame, features: tuple[str, ...] = C.FEATURES, probes=PROBES) -> tuple[str, Callable[[DataFrame], DataFrame]]:
    """The first ranker of `probes` that can be trained on the rows: its name and how to add learned_score to rows."""
    for name, train in probes[:-1]:
        try:
            return name, train(training, features)
        except Exception as e:  # a back end that is missing or cannot learn from these rows gives way to the next
            log.warning("ranker %s not used: %s", name, e)
    name, train = probes[-1]
    return name, train(training, features)


def training_rows(records: DataFrame, candidates: DataFrame, cap: int | None = None) -> DataFrame:
    """Candidates of the training queries: all records, or the first `cap` by claim id."""
    chosen = records if cap is None else ranking.training_records(records, cap, "query_id")
    return candidates.join(chosen.select("query_id").distinct(), "query_id", "left_semi")
