"""Retrieval, ranking, classification and calibration metrics; empty inputs give 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.retrieval import broadcast_if_small
from claimloom.session import written


def judged(rankings: DataFrame, gold: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rankings (by..., ord, rank) with a 0/1 column rel; gold is (query_id, ord), repeats ignored."""
    flags = gold.select("query_id", "ord").distinct().withColumn("hit", F.lit(1))
    return rankings.join(flags, ["query_id", "ord"], "left").withColumn("rel", F.coalesce("hit", F.lit(0))).drop("hit")


def ideal_dcg(n: Column) -> Column:
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))).otherwise(0.0)


def per_query(rankings: DataFrame, gold: DataFrame, queries: DataFrame, recalls: tuple[int, ...] = (1, 3, 5, 10, 50), ndcgs: tuple[int, ...] = (5, 10), by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """recall_k, ndcg_k, rr and ap of every query; a query without gold or ranking gets 0 everywhere."""
    flagged = judged(rankings, gold, by)
    run = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = flagged.withColumn("seen", F.sum("rel").over(run))
    sums = [F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"hits_{k}") for k in recalls]
    sums += [F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}") for k in ndcgs]
    sums += [F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"), F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("precisions")]
    found = flagged.groupBy(*by).agg(*sums)
    n = gold.select("query_id", "ord").distinct().groupBy("query_id").agg(F.count("*").cast("int").alias("n_rel"))
    out = queries.select(*by).distinct().join(found, list(by), "left").join(n, "query_id", "left").fillna(0)
    has = F.col("n_rel") > 0
    cols = [F.when(has, F.col(f"hits_{k}") / F.col("n_rel")).otherwise(0.0).alias(f"recall_{k}") for k in recalls]
    cols += [F.when(has, F.col(f"dcg_{k}") / ideal_dcg(F.least("n_rel", F.lit(k)))).otherwise(0.0).alias(f"ndcg_{k}") for k in ndcgs]
    return out.select(*by, "n_rel", *cols, "rr", F.when(has, F.col("precisions") / F.col("n_rel")).otherwise(0.0).alias("ap"))


def summary(each: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of per_query(): recall_k, ndcg_k, mrr, map."""
    names = [c for c in each.columns if c.startswith(("recall_", "ndcg_"))]
    return each.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names], F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"), F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"))


def parse_cutoffs(text: str) -> list[int]:
    """Comma-separated cut-offs, ascending and distinct."""
    found = sorted({int(p) for p in text.split(",") if p.strip()})
    if not found or found[0] <= 0:
        raise ValueError("give at least one positive cut-off")
    return found


def accuracy(pairs: DataFrame, by: tuple[str, ...] = (), y: str = "y", p: str = "p") -> DataFrame:
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col(y) == F.col(p)).cast("double")), F.lit(0.0)).alias("accuracy"))


def confusion(pairs: DataFrame, labels: list[str] | None = None, by: tuple[str, ...] = (), y: str = "y", p: str = "p") -> DataFrame:
    """(by..., y, p, n) for every pair of labels seen, or of those given, zeros included."""
    counts = pairs.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    if labels is not None:
        seen = pairs.sparkSession.createDataFrame([(v,) for v in labels], "label string")
    else:
        seen = pairs.select(F.explode(F.array(y, p)).alias("label")).distinct()
    grid = seen.select(F.col("label").alias("y")).crossJoin(seen.select(F.col("label").alias("p")))
    if by:
        grid = pairs.select(*by).distinct().crossJoin(grid)
    return grid.join(counts, [*by, "y", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(pairs: DataFrame, by: tuple[str, ...] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall, F1 and support of each label seen on either side; undefined ratios are 0."""
    counts = pairs.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    sides = counts.select(*by, F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("is_y"), F.lit(0).alias("is_p")), F.struct(F.col("p").alias("label"), F.lit(0).alias("is_y"), F.lit(1).alias("is_p")))).alias("s"), (F.col("y") == F.col("p")).alias("same"), "n")
    sums = sides.groupBy(*by, F.col("s.label").alias("label")).agg(
        F.sum(F.when((F.col("s.is_y") == 1) & F.col("same"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s.is_y") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("s.is_p") == 1, F.col("n")).otherwise(0)).alias("predicted")
    )
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("predicted") + F.col("support"))).otherwise(0.0)
    return sums.select(*by, "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def macro_f1(pairs: DataFrame, by: tuple[str, ...] = (), labels: tuple[str, ...] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """Mean F1 over the labels seen, or over a fixed list (labels never seen count 0)."""
    each = per_class(pairs, by, y, p)
    if labels is None:
        return each.groupBy(*by).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    return each.where(F.col("label").isin(*labels)).groupBy(*by).agg((F.sum("f1") / len(labels)).alias("macro_f1"))


def nei_false_positive_rate(pairs: DataFrame, by: tuple[str, ...] = (), nei: str = "NOT ENOUGH INFO", y: str = "y", p: str = "p") -> DataFrame:
    """Share of NEI rows that were given another label."""
    n = F.count_if(F.col(y) == nei)
    return pairs.groupBy(*by).agg(F.when(n > 0, F.count_if((F.col(y) == nei) & (F.col(p) != nei)) / n).otherwise(0.0).alias("nei_fpr"))


def bin_edges(bins: int) -> list[tuple[float, float]]:
    """Edges as repeated sums rounded to 10 places; the last ends at 1."""
    out, low = [], 0.0
    for i in range(bins):
        high = 1.0 if i == bins - 1 else round(low + 1.0 / bins, 10)
        out.append((low, high))
        low = high
    return out


def calibration_bins(rows: DataFrame, bins: int = 10, correct: str = "correct", confidence: str = "confidence") -> DataFrame:
    """(bin, lower, upper, n, accuracy, confidence) of every bin; empty ones are zeros. The last includes 1."""
    edges = bin_edges(bins)
    number = F.lit(None).cast("int")
    for i, (low, high) in enumerate(edges):
        number = F.coalesce(number, F.when((F.col(confidence) >= low) & ((F.col(confidence) < high) | ((F.lit(high) == 1.0) & (F.col(confidence) == 1.0))), i))
    sums = rows.select(number.alias("bin"), F.col(correct).cast("double").alias("c"), F.col(confidence).cast("double").alias("f")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("accuracy"), F.avg("f").alias("confidence"))
    table = rows.sparkSession.createDataFrame([(i, *e) for i, e in enumerate(edges)], "bin int, lower double, upper double")
    return table.join(sums, "bin", "left").fillna({"n": 0, "accuracy": 0.0, "confidence": 0.0})


def expected_calibration_error(rows: DataFrame, bins: int = 10, correct: str = "correct", confidence: str = "confidence") -> DataFrame:
    """Gaps between accuracy and confidence of the bins, weighted by their share of all rows."""
    b = calibration_bins(rows, bins, correct, confidence)
    total = rows.agg(F.count("*").alias("total"))
    return b.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.abs(F.col("accuracy") - F.col("confidence")) * (F.col("n") / F.col("total")))), F.lit(0.0)).alias("ece"))


def nearest_rank(values: Column, percent: float) -> Column:
    """Percentile of an array at round-half-even(percent/100 * (n - 1)); null for an empty one."""
    return F.get(F.array_sort(values), F.bround(F.lit(percent / 100.0) * (F.size(values) - 1)).cast("int"))


#: Values of a group that may be put in order in one task; cuts of a sketch, and how many beside the wanted place the next bracket reaches.
SELECT_FROM, CUTS, BESIDE = 50_000, 2_000, 4


def nearest_rank_percentiles(rows: DataFrame, value: str, percents: tuple[float, ...], by: tuple[str, ...] = (), select_from: int = SELECT_FROM) -> DataFrame:
    """The same per group by exact selection: no group is gathered or put in order, however large.

    For each group and wanted place there is an open bracket of values. Its sketch, which
    is merged from partial ones, proposes a closer one; what lies below, between and at
    its ends is counted exactly, so the place is at an end or in a smaller bracket. Once
    that holds `select_from` values or fewer, just those are put in order. Null values do
    not count; a group without others gives no row.
    """
    groups = [f"__g{i}" for i in range(len(by))]
    keyed = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col(value).alias("__v"))
    kind = keyed.schema["__v"].dataType
    asked = rows.sparkSession.createDataFrame([(i, float(q)) for i, q in enumerate(percents)], "i int, q double")  # a row a percentile
    counted = keyed.groupBy(*groups).agg(F.count("*").alias("inside")).where("inside > 0").crossJoin(F.broadcast(asked))
    place, none = F.bround(F.col("q") / 100.0 * (F.col("inside") - 1)).cast("long"), F.lit(None).cast(kind)
    # k places are left of the wanted one inside the bracket (lo, hi); `found` is the value once it is known
    state = written(counted.select(*groups, "i", place.alias("k"), none.alias("lo"), none.alias("hi"), "inside", none.alias("found")))
    v, key = F.col("__v"), [*groups, "i"]

    def inside(targets: DataFrame) -> DataFrame:
        """Each target's columns beside every value in its bracket."""
        named = broadcast_if_small(targets.select(*[F.col(g).alias(f"_{g}") for g in groups], *[c for c in targets.columns if c not in groups]))
        met = keyed.join(named, reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups])) if groups else keyed.crossJoin(named)
        return met.where((F.col("lo").isNull() | (v > F.col("lo"))) & (F.col("hi").isNull() | (v < F.col("hi"))))

    wide = F.col("found").isNull() & (F.col("inside") > select_from)
    while not state.where(wide).isEmpty():
        cuts = inside(state.where(wide)).groupBy(*key, "k", "lo", "hi", "inside").agg(F.percentile_approx("__v", [x / CUTS for x in range(CUTS + 1)], 10 * CUTS).alias("cuts"))
        cut = lambda at: F.get("cuts", F.greatest(F.lit(0), F.least(F.lit(CUTS), at)).cast("int"))
        middle = F.floor(F.col("k").cast("double") / F.col("inside") * CUTS)
        closer = written(cuts.select(*key, "k", "lo", "hi", "inside", cut(middle - BESIDE).alias("l"), cut(middle + 1 + BESIDE).alias("h")))
        sums = inside(closer).groupBy(*key, "k", "lo", "hi", "inside", "l", "h").agg(F.count_if(v < F.col("l")).alias("less"), F.count_if(v == F.col("l")).alias("at_l"), F.count_if((v > F.col("l")) & (v < F.col("h"))).alias("mid"), F.count_if((v == F.col("h")) & (v > F.col("l"))).alias("at_h"))
        ends = [F.col("less"), F.col("less") + F.col("at_l"), F.col("less") + F.col("at_l") + F.col("mid"), F.col("less") + F.col("at_l") + F.col("mid") + F.col("at_h")]
        part = F.when(F.col("k") < ends[0], 0).when(F.col("k") < ends[1], 1).when(F.col("k") < ends[2], 2).when(F.col("k") < ends[3], 3).otherwise(4)
        cases = lambda *of: F.coalesce(*[F.when(F.col("part") == i, c) for i, c in enumerate(of)])
        moved = sums.withColumn("part", part).select(
            *key, cases(F.col("k"), F.col("k"), F.col("k") - ends[1], F.col("k"), F.col("k") - ends[3]).alias("k"), cases(F.col("lo"), F.col("lo"), F.col("l"), F.col("lo"), F.col("h")).alias("lo"), cases(F.col("l"), F.col("hi"), F.col("h"), F.col("hi"), F.col("hi")).alias("hi"),
            cases(ends[0], F.col("inside"), F.col("mid"), F.col("inside"), F.col("inside") - ends[3]).alias("inside"), cases(none, F.col("l"), none, F.col("h"), none).alias("found"),
        )
        state = written(state.where(~wide).unionByName(moved))
    some = inside(state.where("found is null")).withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy("__v"))).where(F.col("__rn") == F.col("k") + 1).select(*key, F.col("__v").alias("found"))
    every = state.where("found is not null").select(*key, "found").unionByName(some).groupBy(*groups)
    out = every.agg(*[F.max(F.when(F.col("i") == i, F.col("found"))).alias(f"p{q:g}".replace(".", "_")) for i, q in enumerate(percents)])
    return out.select(*[F.col(g).alias(c) for c, g in zip(by, groups, strict=True)], *[c for c in out.columns if c not in groups])


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, rate) for the four outcomes of two flags, zeros included."""
    grid = rows.sparkSession.createDataFrame([(x, y) for x in (True, False) for y in (True, False)], f"{a} boolean, {b} boolean")
    counts = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return grid.join(counts, [a, b], "left").crossJoin(F.broadcast(total)).select(a, b, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.col("total")).otherwise(0.0).alias("rate"))


def class_weights(rows: DataFrame, label: str, classes: int = 3) -> DataFrame:
    """n / (classes * count) of each label."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy(label).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(label, "n", (F.col("total") / (classes * F.col("n"))).alias("weight"))


def labelled_scores(pairs: DataFrame, by: tuple[str, ...] = (), labels: tuple[str, ...] = ("SUPPORTED", "REFUTED", "NOT ENOUGH INFO"), recall_of: str = "REFUTED") -> DataFrame:
    """Accuracy, macro F1 over fixed labels (absent ones count as 0) and the recall of one label, per group."""
    n, right = F.count("*"), F.col("y") == F.col("p")
    hits = lambda v: F.count_if(right & (F.col("y") == v))
    f1 = lambda v: F.when(hits(v) > 0, 2.0 * hits(v) / (F.count_if(F.col("y") == v) + F.count_if(F.col("p") == v))).otherwise(0.0)
    gold = F.count_if(F.col("y") == recall_of)
    return pairs.groupBy(*by).agg(n.alias("n"), F.coalesce(F.avg(right.cast("double")), F.lit(0.0)).alias("accuracy"), (sum((f1(v) for v in labels), F.lit(0.0)) / len(labels)).alias("macro_f1"), F.when(gold > 0, hits(recall_of) / gold).otherwise(0.0).alias(f"{recall_of.lower()}_recall"))
