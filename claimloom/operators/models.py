"""Places where models plug in, and the trainable text classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import constants as C
from claimloom.functions import text as X
from claimloom.operators import ranking, verify
from claimloom.operators import retrieval as R

#: text batches in, one vector or number or text a row out; `load` runs once per Python worker and task.
Batch = Callable[[list[str]], list]


def batch_udf(load: Callable[[], Batch], returns: str) -> Callable[..., Column]:
    """A column function from a loader of a batch model. Batches are Arrow; the model is loaded once per task, not per row."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            yield pd.Series(list(model(texts.tolist())), dtype=object if returns.startswith(("array", "string")) else None)

    return F.pandas_udf(run, returns)


def pair_udf(load: Callable[[], Callable[[list[str], list[str]], list]], returns: str = "double") -> Callable[..., Column]:
    """The same for models of two texts: re-rankers, entailment checks."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in parts:
            yield pd.Series(list(model(a.tolist(), b.tolist())), dtype="float64" if returns == "double" else object)

    return F.pandas_udf(run, returns)


def tolerant(model: Callable[..., list]) -> Callable[..., list]:
    """The model, asked again row by row where a batch fails; None for the rows that fail by themselves."""

    def run(*columns: list) -> list:
        try:
            return list(model(*columns))
        except Exception:
            if len(columns[0]) == 1:
                return [None]
            return [run(*([x] for x in row))[0] for row in zip(*columns, strict=True)]

    return run


def tolerant_rerank(candidates: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list]], k: int | None = None) -> DataFrame:
    """reranked() by a pair model; queries for which the model fails on any passage, or can't be loaded, keep the order they came in."""

    def safe():
        try:
            return tolerant(load())
        except Exception:
            return lambda a, b: [None] * len(a)

    scored = candidates.withColumn("rerank_score", pair_udf(safe)("claim", "text"))
    whole = Window.partitionBy("query_id")
    failed = F.max(F.col("rerank_score").isNull() | F.isnan("rerank_score")).over(whole)
    scored = scored.withColumn("rerank_backend", F.when(failed, "input_order").otherwise("cross_encoder"))
    scored = scored.withColumn("rerank_score", F.when(F.col("rerank_backend") == "input_order", -F.col("rank").cast("double")).otherwise(F.col("rerank_score")))
    out = ranking.rerank(scored, F.col("rerank_score"))
    return out if k is None else out.where(F.col("rerank_rank") <= k)


def verify_with(pairs: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list]] | None = None, name: str = "model") -> DataFrame:
    """verify_passages() by a model of (claim, text) that gives [supported, refuted, nei], or by the rules where none is loaded; verifier_name says which."""
    if load is None:
        return verify.verify_passages(pairs).withColumn("verifier_name", F.lit("rules"))
    scored = pairs.withColumn("__p", pair_udf(load, "array<double>")("claim", "text"))
    s, r, n = (F.get("__p", F.lit(i)) for i in range(3))
    top = F.greatest(s, r, n)
    verdict = F.when(s == top, C.SUPPORTED).when(r == top, C.REFUTED).otherwise(C.NEI)
    result = F.struct(verdict.alias("verdict"), top.alias("confidence"), s.alias("supported"), r.alias("refuted"), n.alias("nei"))
    return scored.withColumn("result", result).drop("__p").withColumn("verifier_name", F.lit(name))


def embed(texts: DataFrame, load: Callable[[], Batch] | None = None, dim: int = C.HASH_DIM, text: str = "text") -> DataFrame:
    """Texts with `vector`: of a given model, or else the hashing embedding."""
    return R.with_embedding(texts, dim, text) if load is None else texts.withColumn("vector", batch_udf(load, "array<double>")(text))


def reranked(candidates: DataFrame, backend: str = "none", load=None, k: int | None = None) -> DataFrame:
    """Candidates (query_id, doc_id, claim, text, rank) by a re-ranker: none, heuristic, or a pair model given by `load`.

    A cross-encoder without a model falls back to the heuristic; column rerank_backend says what ran.
    """
    if backend == "none":
        out = candidates.withColumn("rerank_score", -F.col("rank").cast("double")).withColumn("rerank_rank", F.col("rank"))
        out = out if k is None else out.where(F.col("rerank_rank") <= k)
        return out.withColumn("rerank_backend", F.lit("none"))
    if backend == "cross_encoder" and load is not None:
        return ranking.rerank(candidates, pair_udf(load)("claim", "text"), k).withColumn("rerank_backend", F.lit("cross_encoder"))
    if backend not in ("heuristic", "cross_encoder"):
        raise ValueError(f"unknown re-ranker {backend}")
    return ranking.rerank(candidates, ranking.heuristic_score("claim", "text"), k).withColumn("rerank_backend", F.lit("heuristic" if backend == "heuristic" else "heuristic_fallback"))


def generated(claims: DataFrame, load: Callable[[], Batch] | None, prompt: str = "prompt") -> DataFrame:
    """Claims with `answer` from a generator of texts; without one the column is null and callers use templates."""
    return claims.withColumn("answer", F.lit(None).cast("string") if load is None else batch_udf(load, "string")(prompt))


def train_text_classifier(rows: DataFrame, label: str = "label", text: str = "text", vocabulary: int = 10_000, iterations: int = 100):
    """TF-IDF of words and word pairs and a class-balanced logistic regression, as a fitted Spark ML pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StringIndexer

    balanced = rows.join(F.broadcast(_weights(rows, label)), label)
    stages = [
        StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="keep"),
        RegexTokenizer(inputCol=text, outputCol="__one", pattern=r"\w\w+", gaps=False),
        NGram(n=2, inputCol="__one", outputCol="__two"),
        SQLTransformer(statement="SELECT *, concat(__one, __two) AS __terms FROM __THIS__"),
        CountVectorizer(inputCol="__terms", outputCol="__tf", vocabSize=vocabulary),
        IDF(inputCol="__tf", outputCol="features"),
        LogisticRegression(labelCol="__y", weightCol="__weight", maxIter=iterations, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(balanced)


def _weights(rows: DataFrame, label: str) -> DataFrame:
    """One row per label."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    return counts.crossJoin(F.broadcast(total)).select(label, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("__weight"))


def classify(model, rows: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """Rows with `predicted` label and `confidence`."""
    from pyspark.ml.functions import vector_to_array

    names = model.stages[0].labels
    given = rows if label in rows.columns else rows.withColumn(label, F.lit(names[0]))
    given = given.withColumn("__weight", F.lit(1.0))
    out = model.transform(given)
    p = vector_to_array("probability")
    return out.select(*rows.columns, F.element_at(F.array(*map(F.lit, [*names, None])), (F.col("prediction") + 1).cast("int")).alias("predicted"), F.array_max(p).alias("confidence"))


def verifier_inputs(pairs: DataFrame) -> DataFrame:
    """(query_id, input): claim and all its passages, cleaned and in canonical order, for a text classifier."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda p: X.sanitize(p["text"])), "\n")
    return pairs.groupBy("query_id").agg(F.first("claim").alias("claim"), text.alias("evidence")).select("query_id", X.verifier_text("claim", "evidence").alias("input"))


def label_scores(scores: Column) -> Column:
    """An array of (label, score) structs as a struct of the three labels' scores, 0 where absent."""
    pick = lambda label: F.coalesce(F.get(F.filter(scores, lambda s: F.replace(F.upper(s["label"]), F.lit("_"), F.lit(" ")) == label), F.lit(0))["score"], F.lit(0.0))
    return F.struct(pick(C.SUPPORTED).alias("supported"), pick(C.REFUTED).alias("refuted"), pick(C.NEI).alias("nei"))
