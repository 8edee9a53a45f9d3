"""Audits, histograms and report roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import constants as C
from claimloom.functions import text as X
from claimloom.operators.metrics import nearest_rank_percentiles


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(X.col(text), r"(?U)\s+"), lambda w: w != ""))


def histogram(df: DataFrame, column: str | Column, name: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, (F.col(column) if isinstance(column, str) else column).alias(name)).agg(F.count("*").alias("n"))


def filled_histogram(df: DataFrame, column: str, values: tuple[str, ...] = C.LABELS) -> DataFrame:
    """Counts of the given values, zeros included."""
    dim = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    return dim.join(histogram(df, column), "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def quality_audit(records: DataFrame, claim: str = "claim", evidence: str = "evidence", by: tuple[str, ...] = ()) -> DataFrame:
    """Records, repeated claims, records without evidence, mean words of non-empty claims and evidences (null counts as none)."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return records.groupBy(*by).agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct(claim)).alias("duplicate_claims"), F.count_if(~given(evidence)).alias("missing_evidence"),
        F.coalesce(F.avg(F.when(given(claim), word_count(claim))), F.lit(0.0)).alias("average_claim_length"), F.coalesce(F.avg(F.when(given(evidence), word_count(evidence))), F.lit(0.0)).alias("average_evidence_length"),
    )


def group_histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of several columns in one pass of grouping sets."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(each.alias("e")).groupBy("e.column", "e.value").agg(F.count("*").alias("n"))


def overall_and_by(df: DataFrame, by: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates over everything (by is null, overall true) and per group, in one rollup."""
    return df.rollup(by).agg(F.grouping(by).cast("boolean").alias("overall"), *aggregates)


def request_metrics(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Requests, fallback and citation rates, mean confidence and latency, verdict counts of a request log."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    verdicts = [F.count_if(F.col("verdict") == v).alias(f"n_{v.lower().replace(' ', '_')}") for v in C.LABELS]
    return log.groupBy(*by).agg(F.count("*").alias("n_requests"), rate("fallback_used").alias("fallback_rate"), rate("citation_valid").alias("citation_valid_rate"), rate("confidence").alias("mean_confidence"), rate("latency_ms").alias("mean_latency_ms"), *verdicts)


def long_report(df: DataFrame, report: str, keys: list[str]) -> DataFrame:
    """(report, path, value) of every number of a wide metric table, for a roll-up of reports."""
    values = [c for c in df.columns if c not in keys]
    path = lambda c: F.concat_ws(".", *[F.col(k).cast("string") for k in keys], F.lit(c))
    each = F.explode(F.array(*[F.struct(path(c).alias("path"), F.col(c).cast("double").alias("value")) for c in values]))
    return df.select(F.lit(report).alias("report"), each.alias("e")).select("report", "e.path", "e.value")


def preference_stats(pairs: DataFrame, valid: str = "chosen_citation_valid") -> DataFrame:
    """One row: pairs, how many chosen answers cite validly, mean words of prompts, chosen and rejected answers."""
    mean = lambda c: F.bround(F.avg(word_count(c)), 2).alias(f"avg_{c}_words")
    return pairs.agg(F.count("*").alias("n"), F.count_if(F.col(valid)).alias("chosen_valid"), F.bround(F.avg(F.col(valid).cast("double")), 4).alias("chosen_valid_rate"), mean("prompt"), mean("chosen"), mean("rejected"))


def merged_counts(parts: list[DataFrame], value: str = "value") -> DataFrame:
    """Histograms (value, n) added up."""
    return reduce(DataFrame.unionByName, parts).groupBy(value).agg(F.sum("n").alias("n"))


def stage_latencies(log: DataFrame, stages: tuple[str, ...], request: str = "request_id", stage: str = "stage", ms: str = "ms") -> DataFrame:
    """A row per request: milliseconds of each stage, 0 if it did not run, and in all."""
    each = [F.coalesce(F.sum(F.when(F.col(stage) == s, F.col(ms))), F.lit(0.0)).alias(f"{s}_ms") for s in stages]
    return log.groupBy(request).agg(*each, F.coalesce(F.sum(F.when(F.col(stage).isin(*stages), F.col(ms))), F.lit(0.0)).alias("total_ms"))


def runtime_summary(runs: DataFrame, ms: str, by: tuple[str, ...], batch: int = 1) -> DataFrame:
    """Runs, mean, p50 and p95 milliseconds and examples per second of each group."""
    n = runs.where(F.col(ms).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(ms).alias("mean_ms"))
    n = n.withColumn("examples_per_second", F.when(F.col("mean_ms") > 0, batch / (F.col("mean_ms") / 1000.0)))
    return n.join(nearest_rank_percentiles(runs, ms, (50.0, 95.0), by), list(by))
