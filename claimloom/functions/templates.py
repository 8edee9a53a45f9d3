"""Explanations, prompts, completions, rejected answers and lenient parsing of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions import constants as C
from claimloom.functions.text import col, strip


def no_end_mark(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"[.!?]+$", "")


def _conclusion(verdict: Column) -> Column:
    return F.when(verdict == C.SUPPORTED, "supports the claim").when(verdict == C.REFUTED, "contradicts the claim").otherwise("does not establish the claim")


def verifier_explanation(claim: Column, evidence: Column, verdict: Column) -> Column:
    return F.concat(F.lit("Verdict: "), verdict, F.lit(". Claim: "), claim, F.lit(". Evidence: "), F.coalesce(evidence, F.lit("No evidence retrieved.")), F.lit(". This evidence "), _conclusion(verdict), F.lit("."))


def grounded_explanation(verdict: Column, lead_text: Column, lead_id: Column | int = 1) -> Column:
    """Cites the lead passage; without one says so."""
    lead_id = F.lit(lead_id) if isinstance(lead_id, int) else lead_id
    told = F.concat(F.lit("["), lead_id.cast("string"), F.lit("] "), no_end_mark(lead_text), F.lit(" and therefore "), _conclusion(verdict), F.lit("."))
    return F.when(lead_text.isNull(), F.concat(F.lit("Verdict: "), verdict, F.lit(". No evidence was retrieved, so the claim cannot be grounded."))).otherwise(told)


def json_list(items: Column) -> Column:
    """Quoted and comma-separated in brackets, nothing escaped."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))


def evidence_passages(evidence: Column | str) -> Column:
    """One passage E1 of a row's evidence text, none if blank."""
    text = strip(F.coalesce(col(evidence), F.lit("")))
    one = F.array(F.struct(F.lit("E1").alias("doc_id"), text.alias("text"), F.lit(None).cast("string").alias("title")))
    return F.when(text != "", one).otherwise(F.array().cast("array<struct<doc_id:string,text:string,title:string>>"))


def evidence_block(passages: Column) -> Column:
    title = lambda p: F.coalesce(F.concat(F.lit(" ("), F.nullif(p["title"], F.lit("")), F.lit(")")), F.lit(""))
    lines = F.array_join(F.transform(passages, lambda p: F.concat(F.lit("["), p["doc_id"], F.lit("]"), title(p), F.lit(" "), strip(p["text"]))), "\n")
    return F.when(F.size(passages) == 0, C.NO_EVIDENCE_BLOCK).otherwise(lines)


def sft_prompt(claim: Column, label: Column, passages: Column) -> Column:
    return F.concat(F.lit(C.PROMPT_HEAD + "Claim:\n"), strip(claim), F.lit("\n\nVerifier label:\n"), label, F.lit("\n\nEvidence:\n"), evidence_block(passages), F.lit("\n\n" + C.PROMPT_TAIL))


def label_sentence(label: Column, passages: Column) -> Column:
    lead = no_end_mark(F.get(passages, F.lit(0))["text"])
    none = F.when(label == C.NEI_DISK, "The provided evidence does not establish the claim.").otherwise("The claim cannot be grounded because no evidence passages were provided.")
    some = F.when(label == C.SUPPORTED, F.concat(lead, F.lit(" therefore the claim is supported."))).when(label == C.REFUTED, F.concat(lead, F.lit(" therefore the claim is refuted."))).otherwise(F.concat(lead, F.lit(" does not establish the claim, so the correct decision is not enough info.")))
    return F.when(F.size(passages) == 0, none).otherwise(some)


def completion(label: Column, explanation: Column, citations: Column) -> Column:
    return F.concat(F.lit("Decision: "), label, F.lit("\nExplanation: "), explanation, F.lit("\nCitations: "), json_list(citations))


def passage_ids(passages: Column) -> Column:
    return F.transform(passages, lambda p: p["doc_id"])


def sft_completion(label: Column, passages: Column) -> Column:
    return completion(label, label_sentence(label, passages), passage_ids(passages))


def wrong_label(label: Column) -> Column:
    return F.when(label == C.NEI_DISK, C.SUPPORTED).when(label == C.SUPPORTED, C.REFUTED).otherwise(C.NEI_DISK)


def rejected_completion(label: Column, citations: Column, kind: Column) -> Column:
    """The worse answer of a preference pair, by kind of fault."""
    ids = F.when(F.size(citations) > 0, citations).otherwise(F.array(F.lit("E1")))
    text = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in C.REJECTION_TEXTS.items() for x in kv]), kind), F.lit(C.REJECTION_TEXTS["other"]))
    given = F.when(kind == "wrong_label", wrong_label(label)).when(kind == "insufficient_claim", C.NEI_DISK).when(kind.isin(*C.REJECTIONS), label).otherwise(wrong_label(label))
    listed = F.when(kind == "missing_citation", F.array().cast("array<string>")).when(kind == "hallucinated_fact", F.array(F.lit("E99"))).when(kind == "wrong_citation", F.array(F.lit("E999"))).otherwise(ids)
    return completion(given, text, listed)


def json_object(text: Column | str) -> Column:
    """The JSON object a reply holds, as text: the whole reply, else from the first { to the last }; null if neither is one."""
    whole = strip(text)
    inner = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    ok = lambda t: F.when(F.startswith(t, F.lit("{")) & F.try_parse_json(t).isNotNull(), t)
    return F.when(F.try_parse_json(whole).isNotNull(), ok(whole)).otherwise(ok(inner))


def listed_citations(payload: Column) -> Column:
    """Whole numbers and digit strings of the payload's citations, ascending and distinct."""
    items = F.from_json(F.get_json_object(payload, "$.citations"), "array<string>")
    kept = F.filter(F.transform(items, strip), lambda x: F.regexp_like(x, F.lit(r"^\d+$")))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(kept, lambda x: x.cast("int")))), F.array().cast("array<int>"))


def answer_fields(text: Column | str) -> Column:
    """Struct decision, explanation, citations of a Decision / Explanation / Citations answer; absent ones empty."""
    t = col(text)
    return F.struct(
        F.upper(strip(F.regexp_extract(t, r"(?i)decision:\s*([A-Za-z_ ]+)", 1))).alias("decision"),
        strip(F.regexp_extract(t, r"(?is)explanation:\s*(.*?)(?:\n\s*citations:|$)", 1)).alias("explanation"),
        F.coalesce(F.from_json(F.regexp_extract(t, r"(?is)citations:\s*(\[.*?\])", 1), "array<string>"), F.array().cast("array<string>")).alias("citations"),
    )


def verdict_answer(text: Column | str) -> Column:
    """Struct verdict, explanation of a Verdict / Explanation / Citation answer: UNPARSEABLE without a known verdict, the whole answer without an explanation."""
    t = col(text)
    told = F.regexp_extract(t, r"(?is)explanation:\s*(.*?)(?:\ncitation:|\z)", 1)
    verdict = F.upper(F.regexp_extract(t, r"(?i)verdict:\s*(SUPPORTED|REFUTED|NOT ENOUGH INFO)", 1))
    return F.struct(F.coalesce(F.nullif(verdict, F.lit("")), F.lit("UNPARSEABLE")).alias("verdict"), F.when(F.regexp_like(t, F.lit(r"(?i)explanation:")), strip(told)).otherwise(strip(t)).alias("explanation"))


def chat_prompt(claim: Column, evidence: Column) -> Column:
    """The user turn that asks for a verdict: claim, numbered evidence and task."""
    block = F.when(evidence == "", C.NO_EVIDENCE_BLOCK).otherwise(F.concat(F.lit("[1] "), evidence))
    return F.concat(F.lit("Claim: "), claim, F.lit("\nEvidence: "), block, F.lit("\n" + C.CHAT_TASK))


def chat_line(system: str, prompt: Column, answer: Column) -> Column:
    """A line of a chat split: JSON with the messages."""
    return F.to_json(F.struct(chat(system, prompt, answer).alias("messages")))


def chat(system: Column | str | None, user: Column, assistant: Column) -> Column:
    turns = [] if system is None else [("system", F.lit(system) if isinstance(system, str) else system)]
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in [*turns, ("user", user), ("assistant", assistant)]])
