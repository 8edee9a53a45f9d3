"""What the two classifiers share: a bounded labelled sample and small numeric tools."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample that a classifier is fitted on: rows, and code points of text.
FIT_ROWS = 8_000
FIT_CHARS = 48_000_000


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fit_on: Column, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most `rows` labelled documents, in the order of a hash of the id.

    `fit_on` says which label rows may be learnt from. Null labels and ids are left
    out, of repeated ids the largest label counts. Reading stops after `chars` code
    points of text in all, so a very long text may be the last; a null text is empty.
    Documents that repeat an id all count. Empty tables give an empty sample; other
    columns are ignored, whatever their names.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & fit_on).groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    few = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    joined = docs.select(F.col("doc_id").alias("__doc"), F.coalesce("text", F.lit("")).alias("__text")).join(F.broadcast(few), F.col("__doc") == F.col("__id"))
    size = F.sum(F.length("__text")).over(_by_hash())
    joined = joined.withColumn("__used", size).where((F.col("__used") <= chars) | (F.col("__used") == F.length("__text")))
    got = joined.select("__text", "__y").toPandas() if not few.isEmpty() else None
    if got is None or got.empty:
        return [], np.empty(0, np.int64)
    return got["__text"].tolist(), got["__y"].to_numpy(np.int64)


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy().orderBy(F.xxhash64("__id"), "__id", F.xxhash64("__text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def isotonic(scores: np.ndarray, y: np.ndarray, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing probabilities, each block shrunk a little to the base rate."""
    base = (y.sum() + 0.5) / (len(y) + 1.0)
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest and highest score
    for s, t in zip(scores[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    x, p = [], []
    for total, weight, low, high in blocks:
        value = (total + smooth * base) / (weight + smooth)
        x += [low, high] if high > low else [low]
        p += [value, value] if high > low else [value]
    return np.array(x), np.maximum.accumulate(np.array(p))


def auc(scores: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    _, inverse, counts = np.unique(scores, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    ranks = (ends - (counts - 1) / 2)[inverse]
    n1 = int(y.sum())
    n0 = len(y) - n1
    return float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")
