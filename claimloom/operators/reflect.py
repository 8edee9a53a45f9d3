"""The reflection loop: retrieve, rank, verify, then explain and check until the citations hold.

Claims are a table, and so are rounds: each takes the claims still pending, asks the
generator, checks its citations and is written down; what passes leaves the table. The
loop ends with the last pending claim or the last retry.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import citations as Q
from claimloom.functions import constants as C
from claimloom.functions import templates as T
from claimloom.operators import verify as Y
from claimloom.session import written

log = logging.getLogger(__name__)

#: (claims, k) to evidence: query_id, rank, title, text. (query_id, claim, rank, title, text) to the same with new ranks. Pairs to (query_id, verdict, confidence).
Retriever = Callable[[DataFrame, int], DataFrame]
Ranker = Callable[[DataFrame], DataFrame]
Verifier = Callable[[DataFrame], DataFrame]
#: (prompt, attempt from 0) to the reply; a column expression or a pandas_udf, see generator().
Generator = Callable[[Column, Column], Column]


def fallback_reply(reason: str) -> str:
    """What stands in for a reply that could not be had."""
    return json.dumps({"explanation": f"Explanation unavailable: {reason}.", "citations": []})


def generator(load: Callable[[], Callable[[str, int], str]], retries: int = 2) -> Generator:
    """A column function from a loader of a text generator, loaded once a task.

    A call that raises is made again up to `retries` times for its row alone, then the
    fall-back reply stands in; a generator that can't be loaded gives it to every row.
    """

    def ask(model, prompt: str, attempt: int) -> str:
        reason = "no reply"
        for _ in range(max(1, retries + 1)):
            try:
                return model(prompt, attempt)
            except Exception as e:  # whatever a model raises costs its row a try
                reason = f"{type(e).__name__}: {e}"
        log.warning("generator failed: %s", reason)
        return fallback_reply(reason)

    @F.pandas_udf("string")
    def reply(prompts: pd.Series, attempts: pd.Series) -> pd.Series:
        try:
            model = load()
        except Exception as e:
            reason = f"{type(e).__name__}: {e}"
            return pd.Series([fallback_reply(reason)] * len(prompts))
        return pd.Series([ask(model, p, int(a)) for p, a in zip(prompts, attempts, strict=True)])

    return reply


def choose_generator(mode: str, load: Callable[[], Callable[[str, int], str]] | None = None, retries: int = 2) -> Generator | None:
    """`template` explains by rule (None), `model` asks the model given; without one it falls back to the template."""
    if mode not in ("template", "model"):
        raise ValueError(f"unknown generator mode {mode}")
    return generator(load, retries) if mode == "model" and load is not None else None


def prompt(claim: Column, verdict: Column, context: Column) -> Column:
    parts = C.EXPLANATION_PROMPT.split("{}")
    return F.concat(F.lit(parts[0]), claim, F.lit(parts[1]), verdict, F.lit(parts[2]), Q.context_block(context), F.lit(parts[3]))


def bracketed(reply: Column) -> Column:
    """Numbers of the words that are a bracketed number, ascending and distinct."""
    words = F.filter(F.split(reply, r"(?U)\s+"), lambda w: F.regexp_like(w, F.lit(r"^\[[\[\]]*\d+[\[\]]*\]$")))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.regexp_extract(w, r"\d+", 0).cast("int"))))


def parsed(reply: Column) -> Column:
    """Struct explanation, citations: of the JSON object in the reply, else the reply itself with its bracketed numbers."""
    payload = T.json_object(reply)
    told = F.get_json_object(payload, "$.explanation")
    named = F.array_contains(F.json_object_keys(payload), "explanation")
    as_json = F.struct(F.when(named, F.coalesce(told, F.lit("None"))).otherwise(reply).alias("explanation"), T.listed_citations(payload).alias("citations"))
    return F.when(payload.isNotNull(), as_json).otherwise(F.struct(reply.alias("explanation"), bracketed(reply).alias("citations")))


def rule_verifier(pairs: DataFrame) -> DataFrame:
    """(query_id, verdict, confidence, winning_rank) of (query_id, claim, rank, text) by the rules."""
    return Y.aggregate_claims(Y.verify_passages(pairs)).select("query_id", "verdict", "confidence", "winning_rank")


def _ranked(claims: DataFrame, evidence: DataFrame, rank: Ranker | None) -> DataFrame:
    if rank is None:
        return evidence
    pairs = evidence.join(claims.select("query_id", F.col("text").alias("claim")), "query_id")
    try:
        return written(rank(pairs).select("query_id", "rank", "title", "text"))
    except Exception as e:  # a ranker that fails leaves the evidence in its order
        log.warning("ranker failed, evidence keeps its order: %s", e)
        return evidence


_OUT = ("query_id", "verdict", "confidence", "decision", "explanation", "citations", "citation_valid", "retries_used", "citation_precision", "unsupported_sentence_rate")


def reflection_loop(claims: DataFrame, retrieve: Retriever, rank: Ranker | None = None, verify: Verifier = rule_verifier, generate: Generator | None = None, k: int = 5, threshold: float = C.ABSTAIN_BELOW, max_retries: int = C.MAX_RETRIES) -> DataFrame:
    """Outcome of every claim (query_id, text), which has to be unique by id.

    Below the threshold a claim abstains at once with the verifier's words. Else each
    round explains (by the generator, or the template without one) and checks; valid
    citations make it final, and after `max_retries` further rounds it abstains with its
    last explanation. Without retries allowed (negative) every claim abstains unasked.
    Claims without evidence are verified as such. Empty claims, an empty table.
    """
    ids = claims.select("query_id", F.col("text").alias("claim"))
    evidence = written(_ranked(claims, written(retrieve(claims, k)), rank).select("query_id", "rank", "title", "text"))
    if max_retries < 0:
        nothing = ids.select("query_id", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("double").alias("confidence"), F.lit("abstain").alias("decision"), F.lit("").alias("explanation"), F.array().cast("array<int>").alias("citations"))
        return nothing.select("*", F.lit(False).alias("citation_valid"), F.lit(max_retries).alias("retries_used"), F.lit(0.0).alias("citation_precision"), F.lit(0.0).alias("unsupported_sentence_rate"))
    found = verify(evidence.join(ids, "query_id"))
    won = F.col("winning_rank") if "winning_rank" in found.columns else F.lit(1)
    found = found.select("query_id", "verdict", "confidence", won.alias("winning_rank"))
    results = Y.with_no_evidence(claims, found).join(evidence.select("query_id", F.col("rank").alias("winning_rank"), F.col("text").alias("winning_text")), ["query_id", "winning_rank"], "left")
    results = results.join(ids, "query_id").join(Y.contexts(evidence, k), "query_id", "left")
    results = written(results.withColumn("context", F.coalesce("context", F.array().cast("array<struct<citation_id:int,title:string,text:string>>"))))

    low = F.col("confidence") < threshold
    told = T.verifier_explanation(F.col("claim"), F.col("winning_text"), F.col("verdict"))
    done = [results.where(low).select("query_id", "verdict", "confidence", F.lit("abstain").alias("decision"), told.alias("explanation"), F.array().cast("array<int>").alias("citations"), F.lit(False).alias("citation_valid"), F.lit(0).alias("retries_used"), F.lit(0.0).alias("citation_precision"), F.lit(0.0).alias("unsupported_sentence_rate"))]
    pending = results.where(~F.coalesce(low, F.lit(False))).select("query_id", "verdict", "confidence", "claim", "context")
    if generate is not None:
        pending = pending.withColumn("prompt", prompt(F.col("claim"), F.col("verdict"), F.col("context")))
    for attempt in range(max_retries + 1):
        if generate is None:
            lead = F.get("context", F.lit(0))["text"]
            reply = F.struct(T.grounded_explanation(F.col("verdict"), lead).alias("explanation"), F.slice(F.transform("context", lambda c: c["citation_id"]), 1, 2).alias("citations"))
        else:
            reply = parsed(F.coalesce(generate(F.col("prompt"), F.lit(attempt)), F.lit("")))
        tried = written(pending.withColumn("reply", reply).withColumn("check", Q.check_citations("reply.explanation", F.col("context"))))
        # a template says the same again, so its claims need not be asked twice
        last = attempt == max_retries or generate is None
        ended = tried if last else tried.where("check.valid")
        used = F.when(F.col("check.valid"), attempt).otherwise(max_retries)
        done.append(ended.select("query_id", "verdict", "confidence", F.when(F.col("check.valid"), "final").otherwise("abstain").alias("decision"), "reply.explanation", "reply.citations", F.col("check.valid").alias("citation_valid"), used.alias("retries_used"), "check.citation_precision", "check.unsupported_sentence_rate"))
        pending = tried.where("not check.valid").drop("reply", "check")
        if last or pending.isEmpty():
            break
    return reduce(DataFrame.unionByName, [d.select(*_OUT) for d in done])
