"""Batch functions in place of the service's routes: retrieve, verify, explain, pipeline, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import audit
from claimloom.operators import retrieval as R
from claimloom.operators import verify as Y


def check_request(claims: DataFrame, top_k: int, longest: int = 1000) -> DataFrame:
    """Claims with an `error` column: null if stripped text has 1 to `longest` characters and top_k is 1 to 20."""
    if not 1 <= top_k <= 20:
        raise ValueError("top_k must be 1 to 20")
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    return claims.withColumn("error", F.when(n == 0, "claim must not be empty").when(n > longest, f"claim must not exceed {longest} characters"))


def evidence_for(claims: DataFrame, corpus: DataFrame, k: int = 5, mode: str = "bm25") -> DataFrame:
    """(query_id, rank, ord, title, text, score): passages of each claim, in rank order."""
    found = R.retrieve(claims, corpus, mode, k)
    cols = ["ord", "text", *(["title"] if "title" in corpus.columns else [])]
    out = found.join(corpus.select(*cols), "ord")
    title = F.col("title") if "title" in corpus.columns else F.lit(None).cast("string")
    return out.select("query_id", "rank", "ord", title.alias("title"), "text", "score")


def verify(claims: DataFrame, corpus: DataFrame, k: int = 5, mode: str = "bm25") -> DataFrame:
    """Outcome of every claim: retrieval, rule verdict, explanation, citation check, abstention."""
    return Y.verify_claims(claims, R.once(evidence_for(claims, corpus, k, mode)), k)


def explain(claims: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    return _explained(claims, R.once(evidence_for(claims, corpus, k)), k)


def _explained(claims: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    pairs = evidence.join(claims.select("query_id", F.col("text").alias("claim")), "query_id")
    results = Y.with_no_evidence(claims, Y.aggregate_claims(Y.verify_passages(pairs)))
    return Y.explain(results, evidence, k).select("query_id", "verdict", "confidence", "explanation", "citations", "check")


def pipeline(claims: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """explain() without abstention or retries, with its evidence."""
    evidence = R.once(evidence_for(claims, corpus, k))
    listed = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ord", "score"))).alias("evidence"))
    return _explained(claims, evidence, k).join(listed, "query_id", "left")


def metrics_summary(log: DataFrame) -> DataFrame:
    return audit.request_metrics(log)
