"""Order-free sampling and assignment: a hash of seed and key stands for the random order."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.numbering import hash_bucket, numbered, numbered_by


def hash_order(key: Column | str, seed: int | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement; none for n <= 0."""
    return df.orderBy(hash_order(key, seed), key).limit(max(0, n))


def split(df: DataFrame, validation: int, key: str, seed: int = 42) -> DataFrame:
    """Rows with split "val" for `validation` of them (clamped to all) and "train" for the rest."""
    order = hash_order(key, seed)
    out = numbered(df, hash_bucket(order), [order, key], "__place")
    return out.withColumn("split", F.when(F.col("__place") <= max(0, validation), "val").otherwise("train")).drop("__place")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key)


def round_robin(df: DataFrame, buckets: list[str], n: int, order: str = "ord") -> DataFrame:
    """n rows taken in turn from the buckets, which follow each other as first seen; column turn numbers them."""
    inside = Window.partitionBy(*buckets)
    # of a bucket only the first n can be picked: the window is pruned to them before anything is shuffled
    marked = df.withColumn("__rn", F.row_number().over(inside.orderBy(order))).where(F.col("__rn") <= n)
    marked = marked.withColumn("__first", F.min(order).over(inside))
    picked = marked.orderBy("__rn", "__first").limit(n)
    return picked.withColumn("turn", F.row_number().over(Window.orderBy("__rn", "__first"))).drop("__rn", "__first")


def cyclic(values: list[str], place: Column) -> Column:
    """values[place mod n], place from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))


#: Rows of a block of the bootstrap.
RESAMPLED = 1_024


def _draws(node: tuple[int, int], seed: int, draws: np.ndarray, left: int, total: int) -> np.ndarray:
    """How many of each resample's draws fall into the left `left` of a node's `total` rows; the node's own random numbers say."""
    return np.random.default_rng([seed, *node]).binomial(draws, left / total)


def resample_counts(n: int, block: int, iterations: int, seed: int, size: int = RESAMPLED) -> np.ndarray:
    """[iterations, rows of the block] how often each resample of n draws takes each row: exactly multinomial, by splitting binomials.

    The root has n draws; a node with rows on either side of a block border passes each
    side its binomial share. A block's counts follow from its path alone, so blocks are
    worked out apart, in any order and as often as needed, and agree.
    """
    low, high, level, index = 0, -(-n // size), 0, 0
    draws = np.full(iterations, n, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = min(middle * size, n) - low * size
        taken = _draws((level, index), seed, draws, left, min(high * size, n) - low * size)
        level, index = level + 1, 2 * index + (block >= middle)
        low, high, draws = (low, middle, taken) if block < middle else (middle, high, draws - taken)
    rows = min((block + 1) * size, n) - block * size
    return np.random.default_rng([seed, level, index, 1]).multinomial(draws, np.full(rows, 1 / rows))


def block_bootstrap(pairs: DataFrame, iterations: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """As bootstrap(), with resamples drawn by `resample_counts`: rows are read once and never multiplied.

    A block of rows in the order of `ord` adds its part to all resamples at once; what is
    shuffled besides the rows is one array of sums a partition, and those meet in a tree.
    """
    spark = pairs.sparkSession
    rows = numbered_by(pairs, "ord").select((F.col("rn") - 1).alias("place"), (F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).cast("double").alias("d"))
    means = pairs.agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b")).first()
    n = means["n"]
    schema = "mean_a double, mean_b double, delta double, ci_low double, ci_high double"
    if n == 0:
        return spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0)], schema)

    def part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("place")["d"].to_numpy()
        return pd.DataFrame({"sums": [(resample_counts(n, int(key[0]), iterations, seed) @ d).tolist()]})

    blocks = rows.groupBy(F.floor(F.col("place") / RESAMPLED).alias("block")).applyInPandas(part, "sums array<double>")
    sums = blocks.rdd.mapPartitions(lambda it: [reduce(np.add, (np.array(r["sums"]) for r in it), np.zeros(iterations))]).treeReduce(np.add)
    deltas = np.sort(sums / n)
    tail = (1 - confidence) / 2
    low, high = int(tail * iterations), min(iterations - 1, int((1 - tail) * iterations) - 1)
    return spark.createDataFrame([(means["mean_a"], means["mean_b"], means["mean_b"] - means["mean_a"], float(deltas[low]), float(deltas[high]))], schema)


def bootstrap(pairs: DataFrame, iterations: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """One row mean_a, mean_b, delta, ci_low, ci_high of paired scores (ord, a, b).

    A resample draws n places by hashing seed, iteration and draw; its mean difference
    is found by joining the draws with the numbered pairs, all iterations at once.
    """
    rows = numbered_by(pairs, "ord").select((F.col("rn") - 1).alias("place"), "a", "b")
    n = rows.count()
    spark = pairs.sparkSession
    if n == 0:
        return spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0)], "mean_a double, mean_b double, delta double, ci_low double, ci_high double")
    draws = spark.range(iterations * n).select((F.col("id") / n).cast("long").alias("it"), F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n)).alias("place"))
    deltas = draws.join(F.broadcast(rows) if n <= 200_000 else rows, "place").groupBy("it").agg((F.sum("b") / n - F.sum("a") / n).alias("d"))
    tail = (1 - confidence) / 2
    low, high = int(tail * iterations), min(iterations - 1, int((1 - tail) * iterations) - 1)
    ranked = deltas.withColumn("i", F.row_number().over(Window.orderBy("d")) - 1)
    ci = ranked.agg(F.max(F.when(F.col("i") == low, F.col("d"))).alias("ci_low"), F.max(F.when(F.col("i") == high, F.col("d"))).alias("ci_high"))
    means = pairs.agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    return means.crossJoin(ci).select("mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("delta"), "ci_low", "ci_high")
