"""Re-ranking, ranking features and the learned ranker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import citations as Q
from claimloom.functions import constants as C
from claimloom.functions import templates as T
from claimloom.functions import text as X


def heuristic_score(claim: Column | str, evidence: Column | str) -> Column:
    """Coverage of the claim, density in the passage and a point for the whole claim as a substring; 0 for an empty passage."""
    mine, theirs = X.token_set(claim), X.tokens(evidence)
    hits = F.size(F.array_intersect(mine, theirs))
    exact = F.contains(F.lower(X.col(evidence)), F.lower(X.strip(claim))).cast("double")
    return F.when(F.size(theirs) == 0, 0.0).otherwise(X.share(hits, F.size(mine)) + X.share(hits, F.size(theirs)) + exact)


def rerank(candidates: DataFrame, score: Column, k: int | None = None) -> DataFrame:
    """Candidates (query_id, doc_id, ...) by score, ties by doc_id as a string."""
    order = Window.partitionBy("query_id").orderBy(F.round("rerank_score", 9).desc(), F.col("doc_id").cast("string"))
    ranked = candidates.withColumn("rerank_score", score).withColumn("rerank_rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rerank_rank") <= k)


def ranking_features(claim: Column | str, evidence: Column | str, bm25_score: Column, dense_score: Column, bm25_rank: Column, dense_rank: Column, cross_score: Column | None = None, evidence_score: Column | None = None) -> list[Column]:
    """The ten features in their fixed order; scores and ranks that are absent are 0."""
    zero = F.lit(0.0)
    mine, theirs = X.token_set(claim), X.token_set(evidence)
    numbers = [F.array_distinct(X.find_all(t, C.NUMBER)) for t in (claim, evidence)]
    cross = F.coalesce(*[c.cast("double") for c in (cross_score, evidence_score) if c is not None], zero)
    values = [
        F.coalesce(bm25_score.cast("double"), zero), F.coalesce(dense_score.cast("double"), zero), cross, X.jaccard(mine, theirs), X.jaccard(*numbers), X.jaccard(X.date_tokens(claim), X.date_tokens(evidence)),
        F.size(theirs).cast("double"), F.size(mine).cast("double"), F.coalesce(bm25_rank.cast("double"), zero), F.coalesce(dense_rank.cast("double"), zero),
    ]
    return [v.alias(n) for v, n in zip(values, C.FEATURES, strict=True)]


def candidate_union(sources: list[DataFrame]) -> DataFrame:
    """(query_id, ord) of all sources, each once, in the order it was first seen: source, then rank."""
    all_ = None
    for i, s in enumerate(sources):
        s = s.select("query_id", "ord", F.lit(i).alias("src"), F.col("rank").cast("long").alias("rank"))
        all_ = s if all_ is None else all_.unionByName(s)
    first = all_.groupBy("query_id", "ord").agg(F.min(F.struct("src", "rank")).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).drop("first")


def candidates_with_scores(sources: list[DataFrame], bm25: DataFrame, dense: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates of all sources with scores (0 if absent), ranks (null if absent) and the relevance flag."""
    out = candidate_union(sources)
    for name, ranking in (("bm25", bm25), ("dense", dense)):
        out = out.join(ranking.select("query_id", "ord", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank")), ["query_id", "ord"], "left").withColumn(f"{name}_score", F.coalesce(f"{name}_score", F.lit(0.0)))
    return out.join(gold.select("query_id", "ord", F.lit(1).alias("relevance")), ["query_id", "ord"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def linear_ranker(training: DataFrame, features: tuple[str, ...] = C.FEATURES, label: str = "relevance") -> DataFrame:
    """One row of weights: mean over relevant less mean over others; all 0 without relevant rows, all 1 without others."""
    n1, n0 = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    weight = lambda f: F.when(n1 == 0, 0.0).when(n0 == 0, 1.0).otherwise(F.avg(F.when(F.col(label) == 1, F.col(f))) - F.avg(F.when(F.col(label) == 0, F.col(f))))
    return training.agg(*[weight(f).alias(f"w_{f}") for f in features])


def linear_score(rows: DataFrame, weights: DataFrame, features: tuple[str, ...] = C.FEATURES) -> DataFrame:
    """Rows with the dot product of features and weights; weights is one row."""
    score = sum((F.col(f) * F.col(f"w_{f}") for f in features), F.lit(0.0))
    return rows.crossJoin(F.broadcast(weights)).withColumn("learned_score", score).drop(*[f"w_{f}" for f in features])


def train_ranker(training: DataFrame, kind: str = "logistic", features: tuple[str, ...] = C.FEATURES, label: str = "relevance"):
    """A fitted Spark ML pipeline: "logistic" (50 iterations) or "gbt"."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    if kind not in ("logistic", "gbt"):
        raise ValueError(f"unknown ranker {kind}")
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    learn = LogisticRegression(labelCol=label, maxIter=50) if kind == "logistic" else GBTClassifier(labelCol=label, maxIter=20, seed=42)
    return Pipeline(stages=[assemble, learn]).fit(training)


def strategy_ranks(candidates: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """(query_id, strategy, doc_id, relevance, rank): every strategy's order in one window, ties by doc_id as a string."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), s.cast("double").alias("s")) for n, s in scores.items()]))
    long = candidates.select("query_id", "doc_id", "relevance", each.alias("e")).select("query_id", "doc_id", "relevance", "e.*")
    order = Window.partitionBy("query_id", "strategy").orderBy(F.round("s", 9).desc(), F.col("doc_id").cast("string"))
    return long.withColumn("rank", F.row_number().over(order)).drop("s")


def preference_score(answer: Column | str, verdict: Column, context: Column, concise: int = 80) -> Column:
    """Struct score, valid_json, verdict_matches, citation_valid, unsupported_sentence_rate, explanation_length of a candidate answer."""
    payload = T.json_object(answer)
    valid = payload.isNotNull()
    norm = lambda c: F.replace(F.upper(X.strip(c)), F.lit(" "), F.lit("_"))
    matches = valid & (norm(F.coalesce(F.get_json_object(payload, "$.verdict"), F.lit(""))) == F.replace(F.upper(verdict), F.lit(" "), F.lit("_")))
    told = F.coalesce(F.get_json_object(payload, "$.explanation"), F.lit(""))
    listed = F.from_json(F.get_json_object(payload, "$.citations"), "array<string>")
    cited = F.coalesce(F.size(listed), F.lit(0)) > 0
    raw = F.get_json_object(payload, "$.citations")
    quoted = F.filter(listed, lambda x: F.contains(raw, F.concat(F.lit('"'), x, F.lit('"'))))
    text = X.strip(F.concat(told, F.lit(" "), F.array_join(F.transform(quoted, lambda x: F.concat(F.lit("["), x, F.lit("]"))), " ")))
    check = Q.check_citations(text, context)
    rate = F.when(valid & cited, check["unsupported_sentence_rate"]).otherwise(1.0)
    cite_ok = F.coalesce(valid & cited & check["valid"], F.lit(False))
    length = F.when(valid, F.size(F.filter(F.split(told, r"(?U)\s+"), lambda x: x != ""))).otherwise(0)
    score = F.when(valid, 1.0).otherwise(-1.0) + F.when(matches, 1.0).otherwise(0.0)
    score = score + F.when(valid & cited, F.when(cite_ok, 1.0).otherwise(-1.0) + F.when(rate <= 0.25, 1.0).otherwise(-rate)).when(valid, -1.0).otherwise(0.0)
    score = score + F.when((length > 0) & (length <= concise), 0.5).when(length > concise, -0.25).otherwise(0.0) + F.when(matches, 0.0).otherwise(-0.5)
    return F.struct(F.bround(score, 4).alias("score"), valid.alias("valid_json"), F.coalesce(matches, F.lit(False)).alias("verdict_matches"), cite_ok.alias("citation_valid"), rate.alias("unsupported_sentence_rate"), length.alias("explanation_length"))


def candidate_metrics(answer: Column | str, verdict: Column, context: Column) -> Column:
    """Struct json_parse, verdict_consistent, citation_valid, unsupported of a candidate answer: 0, 0, 0, 1 if it holds no JSON object."""
    payload = T.json_object(answer)
    raw = F.get_json_object(payload, "$.citations")
    listed = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    quoted = F.filter(listed, lambda x: F.contains(raw, F.concat(F.lit('"'), x, F.lit('"'))))
    told = X.strip(F.concat(F.coalesce(F.get_json_object(payload, "$.explanation"), F.lit("")), F.lit(" "), F.array_join(F.transform(quoted, lambda x: F.concat(F.lit("["), x, F.lit("]"))), " ")))
    norm = lambda c: F.replace(F.upper(X.strip(c)), F.lit(" "), F.lit("_"))
    same = norm(F.coalesce(F.get_json_object(payload, "$.verdict"), F.lit(""))) == norm(verdict)
    check = Q.check_citations(told, context)
    held = lambda c, none: F.when(payload.isNull(), none).otherwise(c)
    return F.struct(held(F.lit(1.0), 0.0).alias("json_parse_rate"), held(same.cast("double"), 0.0).alias("verdict_consistency_rate"), held(check["valid"].cast("double"), 0.0).alias("citation_valid_rate"), held(check["unsupported_sentence_rate"], 1.0).alias("unsupported_sentence_rate"))


def candidate_rates(rows: DataFrame, metrics: str = "m", by: tuple[str, ...] = ()) -> DataFrame:
    """Means of candidate_metrics() to 4 places, 0 for no rows."""
    names = ("json_parse_rate", "verdict_consistency_rate", "citation_valid_rate", "unsupported_sentence_rate")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.bround(F.coalesce(F.avg(f"{metrics}.{c}"), F.lit(0.0)), 4).alias(c) for c in names])


def training_records(records: DataFrame, cap: int, key: str = "claim_id") -> DataFrame:
    """The first `cap` records by claim id as text, which a ranker is trained on."""
    return records.orderBy(F.col(key).cast("string")).limit(cap)


def best_candidate(scored: DataFrame, by: str = "query_id") -> DataFrame:
    """The answer with the highest score of each query, the first of equals."""
    return scored.groupBy(by).agg(F.max_by(F.struct("candidate", "score"), F.struct("score", -F.col("candidate"))).alias("b")).select(by, "b.*")
