"""Citation expressions over an explanation and an array of context structs (citation_id, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import constants as C
from claimloom.functions.text import col, find_all, overlap_of, share, strip, token_set


def cited_ids(text: Column | str) -> Column:
    """Distinct numbers in [n], ascending."""
    return F.array_sort(F.array_distinct(F.transform(find_all(text, C.CITATION, 1), lambda x: x.cast("int"))))


def cited_sentences(explanation: Column | str) -> Column:
    """Sentences to check: a "Verdict: ... based on" head goes, fragments of citations alone go."""
    parts = F.transform(F.split(col(explanation), C.CITED_SENTENCE_END), strip)
    headed = lambda s: F.startswith(F.lower(s), F.lit("verdict:")) & F.contains(F.lower(s), F.lit("based on"))
    after = lambda s: F.when(F.contains(s, F.lit("based on")), F.substr(s, F.instr(s, "based on") + 8)).otherwise(s)
    parts = F.transform(parts, lambda s: F.when(headed(s), strip(after(s))).otherwise(s))
    return F.filter(parts, lambda s: (s != "") & ~F.regexp_like(s, F.lit(r"^(?U:(?:\[\d+\]\s*)+)$")))


def lexically_supported(sentence: Column, evidence: Column) -> Column:
    """At least a fifth of the sentence's distinct tokens stand in the evidence."""
    mine = token_set(sentence)
    return (F.size(mine) > 0) & (overlap_of(mine, token_set(evidence)) >= C.SUPPORT_SHARE)


def check_citations(explanation: Column | str, context: Column) -> Column:
    """Struct: citation_precision, unsupported_sentence_rate, verdict_consistency, valid, missing_citations, unsupported_sentences."""
    ids, known = cited_ids(explanation), F.transform(context, lambda c: c["citation_id"].cast("int"))
    missing = F.array_except(ids, known)
    parts = cited_sentences(explanation)
    backed = lambda s: F.exists(context, lambda c: F.array_contains(cited_ids(s), c["citation_id"].cast("int")) & lexically_supported(s, c["text"]))
    unsupported = F.filter(parts, lambda s: ~backed(s))
    precision = F.when(F.size(ids) == 0, 1.0).otherwise(share(F.size(ids) - F.size(missing), F.size(ids)))
    rate = share(F.size(unsupported), F.size(parts))
    return F.struct(precision.alias("citation_precision"), rate.alias("unsupported_sentence_rate"), ((precision >= 0.5) & (rate <= 0.5)).alias("verdict_consistency"), ((F.size(missing) == 0) & (rate == 0)).alias("valid"), F.array_sort(missing).alias("missing_citations"), unsupported.alias("unsupported_sentences"))


def hallucination_rate(check: Column) -> Column:
    """Share of sentences that nothing cited supports."""
    return check["unsupported_sentence_rate"]


def unsupported_rate(explanation: Column | str, context: Column) -> Column:
    """The share of unsupported sentences; without context 1 for any text and 0 for none."""
    return F.when(F.size(context) == 0, F.when(strip(explanation) != "", 1.0).otherwise(0.0)).otherwise(check_citations(explanation, context)["unsupported_sentence_rate"])


def validated_citations(rows: DataFrame, key: str, explanation: str, context: str, validator: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, check): check_citations() with a model's word for support in place of word overlap.

    `validator(sentence, passage text)` is a boolean column, a pandas_udf of an
    entailment model for instance; it sees every sentence beside each passage it cites
    and no other. Keys must tell rows apart.
    """
    base = rows.select(F.col(key).alias("key"), check_citations(explanation, F.col(context)).alias("c"), cited_sentences(explanation).alias("parts"), F.col(context).alias("ctx"))
    parts = base.select("key", "ctx", F.posexplode("parts").alias("i", "s"))
    cited = parts.select("key", "i", "s", F.explode(F.filter("ctx", lambda x: F.array_contains(cited_ids("s"), x["citation_id"].cast("int")))).alias("x"))
    backed = cited.select("key", "i", validator(F.col("s"), F.col("x.text")).alias("ok")).groupBy("key", "i").agg(F.max("ok").alias("ok"))
    found = parts.join(backed, ["key", "i"], "left").where(~F.coalesce("ok", F.lit(False))).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("u"))
    unsupported = F.coalesce("u", F.array().cast("array<string>"))
    rate = share(F.size(unsupported), F.size("parts"))
    check = F.struct(F.col("c.citation_precision").alias("citation_precision"), rate.alias("unsupported_sentence_rate"), ((F.col("c.citation_precision") >= 0.5) & (rate <= 0.5)).alias("verdict_consistency"), ((F.size("c.missing_citations") == 0) & (rate == 0)).alias("valid"), F.col("c.missing_citations").alias("missing_citations"), unsupported.alias("unsupported_sentences"))
    return base.join(found, "key", "left").select(F.col("key").alias(key), check.alias("check"))


def context_block(context: Column) -> Column:
    """[id] title: text, a line each."""
    title = lambda c: F.coalesce(F.concat(F.nullif(c["title"], F.lit("")), F.lit(": ")), F.lit(""))
    return F.array_join(F.transform(context, lambda c: F.concat(F.lit("["), c["citation_id"].cast("string"), F.lit("] "), title(c), c["text"])), "\n")


def listed_precision(listed: Column, known: Column) -> Column:
    """Share of listed citations that exist, repeats counted, to 4 places; 0 for none."""
    return F.bround(share(F.size(F.filter(listed, lambda x: F.array_contains(known, x))), F.size(listed)), 4)
