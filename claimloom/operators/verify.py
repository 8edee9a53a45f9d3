"""Claim verification: the rule verifier, gate, aggregation, decisions and the full pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import citations as Q
from claimloom.functions import constants as C
from claimloom.functions import templates as T
from claimloom.functions import text as X


def negates(claim: Column | str, evidence: Column | str) -> Column:
    """The evidence has the token "not" and shares a token with the claim."""
    theirs = X.space_tokens(evidence)
    return F.array_contains(theirs, "not") & F.arrays_overlap(X.space_tokens(claim), theirs)


def _result(overlap: Column, negated: Column) -> Column:
    verdict = F.when(negated, C.REFUTED).when(overlap >= C.SUPPORT_OVERLAP, C.SUPPORTED).otherwise(C.NEI)
    logit = lambda label: F.when(verdict == label, C.HIT).otherwise(C.MISS)
    return F.struct(verdict.alias("verdict"), F.least(F.lit(0.99), 0.45 + overlap / 2).alias("confidence"), logit(C.SUPPORTED).alias("supported"), logit(C.REFUTED).alias("refuted"), logit(C.NEI).alias("nei"))


def rule_verdict(claim: Column | str, evidence: Column | str) -> Column:
    """Struct verdict, confidence, supported, refuted, nei of one passage."""
    return _result(X.overlap_of(X.space_tokens(claim), X.space_tokens(evidence)), negates(claim, evidence))


def gate(result: Column, overlap: Column, threshold: float) -> Column:
    """A passage below the threshold counts as not enough information with certainty."""
    nothing = F.struct(F.lit(C.NEI).alias("verdict"), F.lit(1.0).alias("confidence"), F.lit(0.0).alias("supported"), F.lit(0.0).alias("refuted"), F.lit(1.0).alias("nei"))
    return F.when(overlap < threshold, nothing).otherwise(result)


def gated_label(prediction: Column, overlap: Column, threshold: Column | float) -> Column:
    return F.when(overlap < threshold, "NEI").otherwise(prediction)


def verify_passages(pairs: DataFrame, gate_threshold: float | None = None) -> DataFrame:
    """(query_id, claim, rank, text) plus result; the gate applies only to claims with several passages."""
    out = pairs.withColumn("result", rule_verdict("claim", "text"))
    if gate_threshold is not None:
        n = pairs.groupBy("query_id").agg(F.count("*").alias("n_passages"))
        out = out.join(n, "query_id").withColumn("result", F.when(F.col("n_passages") > 1, gate(F.col("result"), X.gate_overlap("claim", "text"), gate_threshold)).otherwise(F.col("result"))).drop("n_passages")
    return out


def decide(supported: Column, refuted: Column, support_threshold: Column | float = 0.5, refute_threshold: Column | float = 0.5) -> Column:
    return F.when((supported >= support_threshold) & (supported > refuted), C.SUPPORTED).when((refuted >= refute_threshold) & (refuted > supported), C.REFUTED).otherwise(C.NEI)


def decide_with_margin(supported: Column, refuted: Column, support_threshold: Column, refute_threshold: Column, margin: Column) -> Column:
    """The stronger side must also lead by the margin."""
    return F.when((supported >= support_threshold) & (supported - refuted >= margin), C.SUPPORTED).when((refuted >= refute_threshold) & (refuted - supported >= margin), C.REFUTED).otherwise(C.NEI)


def aggregate_claims(verified: DataFrame, support_threshold: float = 0.5, refute_threshold: float = 0.5) -> DataFrame:
    """Per claim: verdict by the maxima, its confidence, the first passage that reaches the winning maximum.

    A claim with one passage takes that passage's result as it is.
    """
    first = lambda c: F.max_by(F.col("rank"), F.struct(F.col(f"result.{c}"), -F.col("rank")))
    agg = verified.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("result.supported").alias("supported"), F.max("result.refuted").alias("refuted"), F.max("result.nei").alias("nei"), first("supported").alias("at_supported"), first("refuted").alias("at_refuted"), first("nei").alias("at_nei"),
        F.min_by("result", "rank").alias("only"), F.min("rank").alias("only_rank"),
    )
    verdict = decide(F.col("supported"), F.col("refuted"), support_threshold, refute_threshold)
    top = F.greatest("supported", "refuted")
    confidence = F.when(verdict == C.SUPPORTED, F.col("supported")).when(verdict == C.REFUTED, F.col("refuted")).otherwise(F.greatest(F.col("nei"), 1.0 - top))
    at = F.when(verdict == C.SUPPORTED, F.col("at_supported")).when(verdict == C.REFUTED, F.col("at_refuted")).otherwise(F.col("at_nei"))
    one = F.col("n") == 1
    return agg.select("query_id", F.when(one, F.col("only.verdict")).otherwise(verdict).alias("verdict"), F.when(one, F.col("only.confidence")).otherwise(confidence).alias("confidence"), F.when(one, F.col("only_rank")).otherwise(at).alias("winning_rank"), "supported", "refuted", "nei")


def verify_bundle(pairs: DataFrame) -> DataFrame:
    """Per claim: the result for all its passages joined by a newline, in rank order.

    It rests on which of the claim's tokens any passage has and on whether one has the
    token "not", so only these leave a passage, however many a claim has.
    """
    claim, theirs = X.space_tokens("claim"), X.space_tokens("text")
    each = pairs.select("query_id", "claim", F.array_contains(theirs, "not").alias("has_not"), F.explode_outer(F.array_intersect(claim, theirs)).alias("shared"))
    joined = each.groupBy("query_id").agg(F.first("claim").alias("claim"), F.coalesce(F.max("has_not"), F.lit(False)).alias("has_not"), F.collect_set("shared").alias("shared"))
    result = _result(X.overlap_of(claim, F.col("shared")), F.col("has_not") & F.arrays_overlap(claim, F.col("shared")))
    return joined.select("query_id", result.alias("result")).select("query_id", "result.*")


def with_no_evidence(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Every claim; those without passages are NEI at the fixed confidence."""
    return claims.select("query_id").join(results, "query_id", "left").withColumn("confidence", F.when(F.col("verdict").isNull(), C.NO_EVIDENCE_CONFIDENCE).otherwise(F.col("confidence"))).withColumn("verdict", F.coalesce("verdict", F.lit(C.NEI)))


def contexts(evidence: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, context): the first k passages as an array of (citation_id, title, text)."""
    item = F.struct(F.col("rank").alias("citation_id"), "title", "text")
    return evidence.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("context"))


def explain(results: DataFrame, evidence: DataFrame, k: int = 5) -> DataFrame:
    """Results with context, template explanation, its citations and their check."""
    out = results.join(contexts(evidence, k), "query_id", "left").withColumn("context", F.coalesce("context", F.array().cast("array<struct<citation_id:int,title:string,text:string>>")))
    out = out.withColumn("explanation", T.grounded_explanation(F.col("verdict"), F.get("context", F.lit(0))["text"]))
    out = out.withColumn("citations", F.slice(F.transform("context", lambda c: c["citation_id"]), 1, 2))
    return out.withColumn("check", Q.check_citations("explanation", F.col("context")))


def reflect(explained: DataFrame) -> DataFrame:
    """The outcome of verify, explain, check with retries: with a fixed explanation a retry changes nothing.

    Low confidence abstains at once with the verifier's words; a failed check abstains
    after the last retry.
    """
    low = F.col("confidence") < C.ABSTAIN_BELOW
    ok = F.col("check.valid")
    text = T.verifier_explanation(F.col("claim"), F.col("winning_text"), F.col("verdict"))
    return explained.select(
        "query_id", "verdict", "confidence", F.when(low, "abstain").when(ok, "final").otherwise("abstain").alias("decision"), F.when(low, text).otherwise(F.col("explanation")).alias("explanation"), (~low & ok).alias("citation_valid"),
        F.when(low | ok, 0).otherwise(C.MAX_RETRIES).alias("retries_used"), F.when(low, 0.0).otherwise(F.col("check.citation_precision")).alias("citation_precision"), F.when(low, 0.0).otherwise(F.col("check.unsupported_sentence_rate")).alias("unsupported_sentence_rate"),
    )


def verify_claims(claims: DataFrame, evidence: DataFrame, k: int = 5, gate_threshold: float | None = None) -> DataFrame:
    """Claims (query_id, text) with ranked evidence (query_id, rank, title, text) to outcomes."""
    pairs = evidence.join(claims.select("query_id", F.col("text").alias("claim")), "query_id")
    results = with_no_evidence(claims, aggregate_claims(verify_passages(pairs, gate_threshold)))
    won = evidence.select("query_id", F.col("rank").alias("winning_rank"), F.col("text").alias("winning_text"))
    results = results.join(won, ["query_id", "winning_rank"], "left").join(claims.select("query_id", F.col("text").alias("claim")), "query_id")
    return reflect(explain(results, evidence, k))
