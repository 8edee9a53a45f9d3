"""Evaluators: retrieval by strategy and profile, oracle against retrieved evidence, failures, explanations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import citations as Q
from claimloom.functions import templates as T
from claimloom.operators import audit, metrics, sampling, verify
from claimloom.operators import retrieval as R

#: Settings of the compared retrieval profiles.
PROFILES = {
    "bm25_only": {"mode": "bm25"},
    "dense_only": {"mode": "dense"},
    "hybrid_bm25_dense": {"mode": "hybrid"},
    "hybrid_with_query_expansion": {"mode": "hybrid", "expansion_k": 5},
    "hybrid_with_titles": {"mode": "hybrid", "title_k": 5},
}


def retrieval_by_strategy(claims: DataFrame, corpus: DataFrame, gold: DataFrame, strategies: dict[str, dict] | None = None, k: int = 10, cutoffs: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """recall, nDCG, MRR and MAP of every strategy; one row each."""
    rankings, kept = [], {}
    for name, options in (strategies or PROFILES).items():
        found = R.retrieve(claims, corpus, k=k, kept=kept, **options).select("query_id", "ord", "rank", F.lit(name).alias("strategy"))
        rankings.append(found)
    all_ = reduce(DataFrame.unionByName, rankings)
    names = all_.sparkSession.createDataFrame([(n,) for n in (strategies or PROFILES)], "strategy string")
    queries = claims.select("query_id").crossJoin(F.broadcast(names))
    return metrics.summary(metrics.per_query(all_, gold, queries, cutoffs, (k,), ("query_id", "strategy")), ("strategy",))


def oracle_and_retrieved(claims: DataFrame, oracle: DataFrame, retrieved: DataFrame, gate: float | None = None) -> DataFrame:
    """(query_id, evidence_source, mode, verdict, confidence) for both evidence sources, verified per passage and as a bundle.

    claims: query_id, text; the evidences: query_id, rank, text. Claims without evidence are NEI.
    """
    out = []
    for source, evidence in (("oracle", oracle), ("retrieved", retrieved)):
        pairs = evidence.join(claims.select("query_id", F.col("text").alias("claim")), "query_id").select("query_id", "claim", "rank", "text")
        single = verify.with_no_evidence(claims, verify.aggregate_claims(verify.verify_passages(pairs, gate)).select("query_id", "verdict", "confidence"))
        bundle = verify.with_no_evidence(claims, verify.verify_bundle(pairs).select("query_id", "verdict", "confidence"))
        out += [single.select("query_id", F.lit(source).alias("evidence_source"), F.lit("per_passage_max").alias("mode"), "verdict", "confidence"), bundle.select("query_id", F.lit(source).alias("evidence_source"), F.lit("bundle").alias("mode"), "verdict", "confidence")]
    return reduce(DataFrame.unionByName, out)


def evaluate_predictions(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """accuracy, macro F1 over labels seen, NEI false positives and mean confidence per evidence source and mode."""
    by = ("evidence_source", "mode")
    pairs = predictions.join(labels.select("query_id", F.col("label").alias("y")), "query_id").withColumnRenamed("verdict", "p")
    mean = pairs.groupBy(*by).agg(F.avg("confidence").alias("mean_confidence"))
    return metrics.accuracy(pairs, by).join(metrics.macro_f1(pairs, by), list(by)).join(metrics.nei_false_positive_rate(pairs, by), list(by)).join(mean, list(by))


def mode_deltas(evaluated: DataFrame) -> DataFrame:
    """Per mode: oracle less retrieved accuracy and macro F1."""
    pick = lambda s, c: F.max(F.when(F.col("evidence_source") == s, F.col(c)))
    return evaluated.groupBy("mode").agg(*[(pick("oracle", c) - pick("retrieved", c)).alias(f"delta_{c}") for c in ("accuracy", "macro_f1")])


def error_breakdown(predictions: DataFrame, labels: DataFrame, mode: str = "per_passage_max") -> DataFrame:
    """The four outcomes of oracle and retrieved evidence with their shares."""
    right = predictions.where(F.col("mode") == mode).join(labels.select("query_id", "label"), "query_id").groupBy("query_id").agg(F.max(F.when((F.col("evidence_source") == "oracle"), F.col("verdict") == F.col("label"))).alias("oracle_ok"), F.max(F.when((F.col("evidence_source") == "retrieved"), F.col("verdict") == F.col("label"))).alias("retrieved_ok"))
    return metrics.contingency(right, "oracle_ok", "retrieved_ok")


def subset_accuracy(predictions: DataFrame, labels: DataFrame, rankings: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = (10, 50)) -> DataFrame:
    """(k, hit, n, accuracy) of retrieved predictions, apart by whether gold stands among the first k."""
    flags = metrics.judged(rankings, gold).groupBy("query_id").agg(*[F.max(((F.col("rank") <= k) & (F.col("rel") == 1)).cast("int")).alias(f"h{k}") for k in cutoffs])
    rows = predictions.where((F.col("evidence_source") == "retrieved") & (F.col("mode") == "per_passage_max")).join(labels.select("query_id", "label"), "query_id").join(flags, "query_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.coalesce(f"h{k}", F.lit(0)) == 1).alias("hit")) for k in cutoffs]))
    return rows.select((F.col("verdict") == F.col("label")).alias("ok"), each.alias("e")).groupBy("e.k", "e.hit").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"))


def failure_examples(predictions: DataFrame, labels: DataFrame, n: int = 20) -> DataFrame:
    """n wrong retrieved predictions, taken in turn from the buckets of true label and prediction."""
    wrong = predictions.where((F.col("evidence_source") == "retrieved") & (F.col("mode") == "per_passage_max")).join(labels, "query_id").where(F.col("verdict") != F.col("label"))
    return sampling.round_robin(wrong.withColumnRenamed("query_id", "ord"), ["label", "verdict"], n)


def explanation_metrics(answers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Format, decision, citation and support rates of answers (answer, verifier_label, context: array of (citation_id, title, text))."""
    f = T.answer_fields("answer")
    rows = answers.withColumn("f", f)
    ids = F.transform("context", lambda c: F.concat(F.lit("E"), c["citation_id"].cast("string")))
    formed = (F.col("f.decision") != "") & (F.col("f.explanation") != "")
    check = Q.check_citations("f.explanation", F.col("context"))
    length = audit.word_count("f.explanation")
    mean = lambda c, n: F.bround(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 4).alias(n)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), mean(formed, "format_correctness"), mean(F.col("f.decision") == F.col("verifier_label"), "decision_consistency"), mean(F.size("f.citations") > 0, "citation_presence"), mean(Q.listed_precision(F.col("f.citations"), ids), "citation_precision"), mean(check["unsupported_sentence_rate"], "unsupported_rate"), mean(length, "average_length"))


def faithfulness(explanations: DataFrame, text: Column | str, context: Column) -> DataFrame:
    """Mean citation validity, unsupported rate and consistency of explanations."""
    c = explanations.select(Q.check_citations(text, context).alias("c"))
    return c.agg(F.count("*").alias("n"), *[F.bround(F.avg(F.col(f"c.{a}").cast("double")), 4).alias(n) for a, n in (("valid", "citation_valid"), ("citation_precision", "citation_precision"), ("unsupported_sentence_rate", "unsupported_sentence_rate"), ("verdict_consistency", "verdict_consistency"))])


def compare(scores: DataFrame, base: str, challenger: str, metrics_: tuple[str, ...], name: str = "strategy") -> DataFrame:
    """(metric, base, challenger, delta, direction) of two rows of a comparison, to 4 places."""
    pick = lambda who, c: F.bround(F.max(F.when(F.col(name) == who, F.col(c))), 4)
    each = scores.agg(*[pick(w, c).alias(f"{s}_{c}") for w, s in ((base, "b"), (challenger, "c")) for c in metrics_])
    rows = each.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"b_{c}").alias("base"), F.col(f"c_{c}").alias("challenger")) for c in metrics_])).alias("r")).select("r.*")
    delta = F.bround(F.col("challenger") - F.col("base"), 4)
    return rows.withColumn("delta", delta).withColumn("direction", F.when(F.col("delta") > 0, "improved").when(F.col("delta") < 0, "regressed").otherwise("unchanged"))


def best_strategy(scores: DataFrame, value: str, name: str = "strategy") -> DataFrame:
    """The strategy with the largest value, the first by name of equals."""
    return scores.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), name).limit(1).select(F.col(name).alias("best"), value)


def threshold_comparison(claims: DataFrame, evidence: DataFrame, labels: DataFrame, calibrated: tuple[float, float], default: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """(thresholds, n, accuracy, macro_f1, nei_fpr) of the retrieved evidence at default and calibrated thresholds, and what the second gains."""
    pairs = evidence.join(claims.select("query_id", F.col("text").alias("claim")), "query_id").select("query_id", "claim", "rank", "text")
    verified = R.once(verify.verify_passages(pairs))
    out = []
    for name, at in (("default", default), ("calibrated", calibrated)):
        got = verify.with_no_evidence(claims, verify.aggregate_claims(verified, *at).select("query_id", "verdict", "confidence"))
        rows = got.join(labels.select("query_id", F.col("label").alias("y")), "query_id").withColumnRenamed("verdict", "p").withColumn("thresholds", F.lit(name))
        out.append(metrics.labelled_scores(rows, ("thresholds",)).join(metrics.nei_false_positive_rate(rows, ("thresholds",)), "thresholds").select("thresholds", "n", "accuracy", "macro_f1", "nei_fpr"))
    both = reduce(DataFrame.unionByName, out)
    gain = lambda c: (F.max(F.when(F.col("thresholds") == "calibrated", F.col(c))) - F.max(F.when(F.col("thresholds") == "default", F.col(c)))).alias(c)
    return both.unionByName(both.agg(F.lit("delta").alias("thresholds"), F.max("n").alias("n"), gain("accuracy"), gain("macro_f1"), gain("nei_fpr")))


def adapter_metrics(answers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Verdict accuracy, macro F1, parseable, citation and support rates of generated answers (label, answer, context), to 4 places."""
    rows = answers.withColumn("a", T.verdict_answer("answer")).withColumn("c", Q.check_citations("a.explanation", F.col("context"))).withColumn("y", F.col("label")).withColumn("p", F.col("a.verdict"))
    mean = lambda c, n: F.bround(F.avg(c.cast("double")), 4).alias(n)
    rates = rows.groupBy(*by).agg(F.count_if(F.col("p") != "UNPARSEABLE").alias("parseable"), mean(F.col("p") != "UNPARSEABLE", "parseable_rate"), mean(F.col("c.valid"), "citation_valid_rate"), mean(F.col("c.unsupported_sentence_rate"), "unsupported_sentence_rate"))
    scores = metrics.labelled_scores(rows, by)
    both = scores.join(rates, list(by)) if by else scores.crossJoin(F.broadcast(rates))  # one row each
    return both.select(*by, "n", F.bround("accuracy", 4).alias("verdict_accuracy"), F.bround("macro_f1", 4).alias("macro_f1"), "parseable", "parseable_rate", "citation_valid_rate", "unsupported_sentence_rate")
