"""Dataset builders: verifier examples, hard negatives, per-passage pairs, SFT, DPO, preference and chat records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import citations as Q
from claimloom.functions import constants as C
from claimloom.functions import templates as T
from claimloom.functions import text as X
from claimloom.functions.labels import artifact_label, verifier_data_label
from claimloom.operators.numbering import hash_bucket, numbered, numbered_by
from claimloom.operators.retrieval import broadcast_if_small, once
from claimloom.operators.sampling import cyclic


def gold_text(evidence: Column) -> Column:
    """Trimmed non-empty texts of an evidence array joined by spaces; null if there is none."""
    return F.nullif(F.array_join(F.filter(F.transform(evidence, lambda e: X.strip(e["text"])), lambda t: t != ""), " "), F.lit(""))


def eligible(examples: DataFrame) -> DataFrame:
    """Examples whose claim and evidence are not blank."""
    return examples.where((X.strip("claim") != "") & (X.strip("evidence") != ""))


def verifier_examples(records: DataFrame, seed: int = 42) -> DataFrame:
    """(ord, claim_id, claim, evidence, label, source, evidence_type) from records (ord, claim_id, claim, label, gold, source).

    Supported and refuted records need gold text. Half of the others, by a hash, get the
    gold text of another record, picked by a hash among the numbered pool.
    """
    labelled = records.withColumn("label", verifier_data_label("label"))
    gold = labelled.where((F.col("label") != C.NEI_DISK) & F.col("gold").isNotNull())
    nei = labelled.where(F.col("label") == C.NEI_DISK)
    pool = numbered_by(gold, "ord", "__place").select((F.col("__place") - 1).alias("place"), F.col("gold").alias("drawn"))
    n = pool.agg(F.count("*").alias("pool_n"))
    number = lambda tag: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(f"{tag}{seed}"), F.col("claim_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    drawn = nei.crossJoin(F.broadcast(n)).withColumn("coin", (F.pmod(number("coin"), F.lit(2)) == 0) & (F.col("pool_n") > 0))
    drawn = drawn.withColumn("place", F.when(F.col("coin"), F.pmod(number("pick"), F.greatest("pool_n", F.lit(1))))).join(pool, "place", "left")
    keep = ["ord", "claim_id", "claim"]
    first = gold.select(*keep, F.col("gold").alias("evidence"), "label", "source", F.lit("gold").alias("evidence_type"))
    second = drawn.select(*keep, F.coalesce("drawn", F.lit("")).alias("evidence"), "label", "source", F.when(F.col("coin"), "retrieved_negative").otherwise("no_evidence").alias("evidence_type"))
    return first.unionByName(second)


#: Where a negative comes from, in the order in which they are listed. Fixed values.
NEGATIVE_TYPES = ("bm25_hard_negative", "dense_hard_negative", "random_negative")


def random_windows(claims: DataFrame, corpus: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(query_id, text, rank): n distinct texts of the whole corpus for each claim, fewer only if it has fewer.

    The corpus's distinct texts are put in the order of a hash; a claim reads on from a
    place that a hash of its id picks, and from the first after the last.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("text")), 256).alias("digest")
    distinct = corpus.select("ord", digest).groupBy("digest").agg(F.min("ord").alias("ord"))
    places = numbered(distinct, hash_bucket(F.col("digest")), ["digest"], "place")
    size = places.agg(F.count("*").alias("size"))
    pick = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(n), F.col("size")) - 1)).alias("rank")
    drawn = claims.select("query_id").crossJoin(F.broadcast(size)).where("size > 0").select("query_id", "size", step)  # one row
    drawn = drawn.select("query_id", "rank", (F.pmod(pick + F.col("rank"), F.col("size")) + 1).alias("place"))
    return broadcast_if_small(broadcast_if_small(drawn).join(places, "place").select("query_id", "rank", "ord")).join(corpus.select("ord", "text"), "ord").select("query_id", "text", "rank")


def mine_negatives(claims: DataFrame, corpus: DataFrame, bm25: DataFrame, dense: DataFrame, depth: int = 8, n_bm25: int = 2, n_dense: int = 2, n_random: int = 1, seed: int = 42) -> DataFrame:
    """(query_id, text, negative_type, place): distinct texts other than the positive, a number from each source.

    Sources are worked through in turn: a text that an earlier source gave does not count
    towards a later source's number. The random source also fills up what is missing.
    """
    texts = corpus.select("ord", "text")
    positives = claims.select("query_id", "positive")

    def ranked(source: DataFrame) -> DataFrame:
        found = source.join(texts, "ord").join(positives, "query_id").where(F.col("text") != F.col("positive"))
        return found.groupBy("query_id", "text").agg(F.min("rank").alias("rank"))

    def cap(rows: DataFrame, n, kind: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "text"))
        return rows.withColumn("place", place).where(F.col("place") <= n).select("query_id", "text", "place", F.lit(NEGATIVE_TYPES[kind]).alias("negative_type"))

    one = cap(ranked(bm25.where(F.col("rank") <= depth)), n_bm25, 0)
    two = ranked(dense.where(F.col("rank") <= depth * 3)).join(one.select("query_id", "text"), ["query_id", "text"], "left_anti")
    # a row a claim and negative: read for what is excluded, for what is still wanted and for the result
    have = once(one.unionByName(cap(two, n_dense, 1)))
    wanted = n_bm25 + n_dense + n_random
    # at most the positive and the negatives before are among the texts drawn
    drawn = random_windows(claims, corpus, 1 + n_bm25 + n_dense + wanted, seed).join(positives, "query_id").where(F.col("text") != F.col("positive")).select("query_id", "text", "rank")
    drawn = drawn.join(have.select("query_id", "text"), ["query_id", "text"], "left_anti")
    counts = have.groupBy("query_id").agg(F.count("*").alias("n"))
    need = positives.select("query_id").join(counts, "query_id", "left").select("query_id", F.greatest(F.lit(n_random), F.lit(wanted) - F.coalesce("n", F.lit(0))).alias("need"))
    return have.unionByName(cap(drawn.join(need, "query_id"), F.col("need"), 2))


def training_pairs(claims: DataFrame, negatives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retriever rows (query_id, claim, positive_evidence, hard_negatives, label) and re-ranker rows (query_id, claim, evidence, relevance, negative_type, label)."""
    turn = F.array_position(F.array(*map(F.lit, NEGATIVE_TYPES)), F.col("negative_type"))
    listed = negatives.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(turn.alias("t"), "place", "text"))), lambda x: x["text"]).alias("hard_negatives"))
    base = claims.select("query_id", "claim", F.col("positive").alias("positive_evidence"), "label")
    retriever = base.join(listed, "query_id", "left").withColumn("hard_negatives", F.coalesce("hard_negatives", F.array().cast("array<string>")))
    gold = base.select("query_id", "claim", F.col("positive_evidence").alias("evidence"), F.lit(1).alias("relevance"), F.lit("gold").alias("negative_type"), "label")
    others = negatives.join(base, "query_id").select("query_id", "claim", F.col("text").alias("evidence"), F.lit(0).alias("relevance"), "negative_type", "label")
    return retriever, gold.unionByName(others)


def spread_negatives(retriever: DataFrame, n: int) -> DataFrame:
    """Anchor, positive and negative_1..n of rows with at least n negatives."""
    return retriever.where(F.size("hard_negatives") >= n).select("query_id", F.col("claim").alias("anchor"), F.col("positive_evidence").alias("positive"), *[F.get("hard_negatives", F.lit(i)).alias(f"negative_{i + 1}") for i in range(n)])


def passage_pairs(claims: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """One oracle row per claim with gold text and one row per retrieved passage.

    claims: query_id, claim, label, gold_text; ranked: query_id, ord, rank, score, title,
    text; gold: query_id, ord, title. Gold passages take the claim's pair label; others
    are NEI with a kind of negative.
    """
    pair_of = F.when(F.col("label") == C.SUPPORTED, "SUPPORTS").when(F.col("label") == C.REFUTED, "REFUTES").otherwise("NEI")
    oracle = claims.where(F.col("gold_text").isNotNull()).select("query_id", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("score"), pair_of.alias("pair_label"), F.lit(1).alias("relevance"), X.pair_overlap("claim", "gold_text").alias("lexical_overlap"), F.lit("oracle").alias("pair_type"))
    titles = gold.groupBy("query_id").agg(F.array_compact(F.collect_set("title")).alias("gold_titles"))
    found = ranked.join(claims, "query_id").join(gold.select("query_id", "ord", F.lit(True).alias("is_gold")).distinct(), ["query_id", "ord"], "left").join(titles, "query_id", "left")
    is_gold = F.coalesce("is_gold", F.lit(False))
    overlap = X.pair_overlap("claim", "text")
    kind = X.negative_type(F.col("title"), F.coalesce("gold_titles", F.array().cast("array<string>")), F.col("label"), overlap, F.col("rank"))
    rest = found.select("query_id", "ord", "rank", "score", F.when(is_gold, pair_of).otherwise("NEI").alias("pair_label"), is_gold.cast("int").alias("relevance"), overlap.alias("lexical_overlap"), F.when(is_gold, "gold_retrieved").otherwise(kind).alias("pair_type"))
    return oracle.unionByName(rest)


def robust_union(oracle: DataFrame, pairs: DataFrame) -> DataFrame:
    """Verifier examples and converted per-passage pairs in one bag."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in C.PAIR_LABELS.items() for x in kv]), F.col("pair_label"))
    more = pairs.select("claim_id", "claim", F.col("passage_text").alias("evidence"), label.alias("label"), "source", F.coalesce("pair_type", F.lit("retrieved")).alias("evidence_type"))
    return oracle.select("claim_id", "claim", "evidence", "label", "source", "evidence_type").unionByName(more)


def topk_augmented(rows: DataFrame, reranked: DataFrame, style: str = "auto") -> DataFrame:
    """Rows (ord, claim, label, evidence) with the top 1, 3 and 5 passages rendered, and gold or top 3 in turn.

    reranked: ord, rank, title, text. The order of rendered passages is a hash of claim and variant.
    """
    listed = reranked.where("rank <= 5").groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "text"))), lambda p: F.struct(p["title"].alias("title"), p["text"].alias("text"))).alias("passages"))
    out = rows.join(listed, "ord", "left").withColumn("passages", F.coalesce("passages", F.array().cast("array<struct<title:string,text:string>>")))
    for k in (1, 3, 5):
        seed = F.concat(F.col("claim"), F.lit(f":top{k}"))
        out = out.withColumn(f"top{k}_evidence", X.render_evidence(F.slice("passages", 1, k), X.evidence_style(seed) if style == "auto" else style, include_title=False, shuffle_seed=seed))
    out = numbered_by(out, "ord", "__place").withColumn("even", F.pmod(F.col("__place") - 1, F.lit(2)) == 0)
    return out.select("ord", "claim", "label", F.col("evidence").alias("gold_evidence"), "top1_evidence", "top3_evidence", "top5_evidence", F.when(F.col("even"), F.col("evidence")).otherwise(F.col("top3_evidence")).alias("mixed_evidence"), F.when(F.col("even"), "gold").otherwise("retrieved_top3").alias("mixed_source"))


def sft_records(rows: DataFrame, split: str) -> DataFrame:
    """Prompt, completion, passages and citations of rows (claim_id, claim, label, evidence, source, evidence_type)."""
    label, passages = artifact_label("label"), T.evidence_passages("evidence")
    out = rows.withColumn("claim", X.strip("claim")).withColumn("verifier_label", label).withColumn("evidence_passages", passages)
    p, v = F.col("evidence_passages"), F.col("verifier_label")
    meta = F.map_filter(F.create_map(F.lit("split"), F.lit(split), F.lit("source"), F.col("source"), F.lit("evidence_type"), F.col("evidence_type"), F.lit("prompt_version"), F.lit("v1"), F.lit("completion_version"), F.lit("v1"), F.lit("evidence_count"), F.size(p).cast("string")), lambda _, x: x.isNotNull())
    return out.select(F.col("claim_id").cast("string").alias("claim_id"), "claim", "verifier_label", "evidence_passages", "source", T.sft_prompt(F.col("claim"), v, p).alias("prompt"), T.sft_completion(v, p).alias("completion"), T.passage_ids(p).alias("citations"), meta.alias("metadata"))


def sft_violations(records: DataFrame) -> Column:
    """What is wrong with an SFT record; an empty array for a valid one."""
    wrong = [(X.strip("prompt") == "", "empty prompt"), (X.strip("completion") == "", "empty completion"), (F.col("citations").isNull(), "citations must be a list"), (F.exists("evidence_passages", lambda p: X.strip(F.coalesce(p["doc_id"], F.lit(""))) == ""), "evidence passage missing doc_id"), (~F.contains("completion", F.col("verifier_label")), "completion must include the verifier label")]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), t) for c, t in wrong]))


def dpo_pairs(records: DataFrame, order: str = "claim_id") -> DataFrame:
    """Preference pairs of SFT records; the kind of rejection goes round by place."""
    out = numbered_by(records, order, "__place").withColumn("rejection_type", cyclic(list(C.REJECTIONS), F.col("__place") - 1))
    return out.select("claim_id", "source", "verifier_label", "rejection_type", "prompt", F.col("completion").alias("chosen"), T.rejected_completion(artifact_label("verifier_label"), F.col("citations"), F.col("rejection_type")).alias("rejected"), "citations")


def dpo_violations(pairs: DataFrame) -> Column:
    wrong = [(X.strip("prompt") == "", "empty prompt"), (X.strip("chosen") == "", "empty chosen"), (X.strip("rejected") == "", "empty rejected"), (F.col("chosen") == F.col("rejected"), "chosen and rejected must differ")]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), t) for c, t in wrong]))


def _display(label: Column) -> Column:
    return F.when(label == C.NEI_DISK, C.NEI).otherwise(label)


def _context_line(evidence: Column) -> Column:
    return F.when(evidence == "", "(no evidence provided)").otherwise(F.concat(F.lit("[1] "), evidence))


def chat_examples(rows: DataFrame, as_json: bool = False, system: str | None = None) -> DataFrame:
    """rows (claim, label, evidence) with `messages`: system, user and assistant turns, the answer as text or as JSON.

    `system` replaces the system turn's text, for assistants that go by a name.
    """
    verdict = _display(F.col("label"))
    lead = F.when(F.col("evidence") != "", F.col("evidence"))
    told = T.grounded_explanation(verdict, lead)
    cited = F.when(lead.isNull(), "(none)").otherwise("[1]")
    user = F.concat(F.lit("Claim: "), F.col("claim"), F.lit("\nEvidence: "), _context_line(F.col("evidence")), F.lit("\n" + (C.JSON_CHAT_TASK if as_json else C.CHAT_TASK)))
    if as_json:
        ids = F.when(lead.isNull(), F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
        answer = F.to_json(F.struct(verdict.alias("verdict"), told.alias("explanation"), ids.alias("citations")))
    else:
        answer = F.concat(F.lit("Verdict: "), verdict, F.lit("\nExplanation: "), told, F.lit("\nCitation: "), cited)
    return rows.withColumn("messages", T.chat(system or (C.JSON_CHAT_SYSTEM if as_json else C.CHAT_SYSTEM), user, answer))


def preference_pairs(rows: DataFrame) -> DataFrame:
    """Chosen and rejected answers of rows (ord, claim, label, evidence) with evidence whose template answer cites validly.

    The kind of fault goes round over the rows that are kept.
    """
    verdict = _display(F.col("label"))
    context = F.array(F.struct(F.lit(1).alias("citation_id"), F.lit(None).cast("string").alias("title"), F.col("evidence").alias("text")))
    answer = lambda v, t, c: F.concat(F.lit("Verdict: "), v, F.lit("\nExplanation: "), t, F.lit("\nCitation: "), c)
    kept = rows.where(X.strip("evidence") != "").withColumn("verdict", verdict).withColumn("told", T.grounded_explanation(verdict, F.col("evidence")))
    kept = kept.where(Q.check_citations("told", context)["valid"])
    kept = numbered_by(kept, "ord", "__place").withColumn("rejection_type", cyclic(list(C.PREFERENCE_FAULTS), F.col("__place") - 1))
    wrong = F.element_at(F.create_map(*[F.lit(x) for kv in C.WRONG_VERDICT.items() for x in kv]), F.col("verdict"))
    low = F.lower("verdict")
    rejected = (
        F.when(F.col("rejection_type") == "wrong_verdict", answer(wrong, T.grounded_explanation(wrong, F.col("evidence")), F.lit("[1]")))
        .when(F.col("rejection_type") == "invalid_citation", answer(F.col("verdict"), F.concat(F.lit("[2] "), T.no_end_mark("evidence"), F.lit(" therefore the claim is "), low, F.lit(".")), F.lit("[2]")))
        .otherwise(answer(F.col("verdict"), F.concat(F.lit("The claim is "), low, F.lit(" based on general background knowledge.")), F.lit("(none)")))
    )
    prompt = F.concat(F.lit(C.CHAT_SYSTEM + "\n\nClaim: "), F.col("claim"), F.lit("\nEvidence: "), _context_line(F.col("evidence")), F.lit("\n" + C.CHAT_TASK))
    return kept.select("ord", F.col("verdict").alias("gold_label"), "rejection_type", prompt.alias("prompt"), answer(F.col("verdict"), F.col("told"), F.lit("[1]")).alias("chosen"), rejected.alias("rejected"))


def flatten_corpus(records: DataFrame) -> DataFrame:
    """One row per claim and passage, metadata merged with the passage's winning; nothing is de-duplicated."""
    flat = records.select("claim_id", "claim", "label", "split", F.col("metadata").alias("m"), F.posexplode("evidence").alias("place", "e"))
    own = F.map_filter(F.coalesce("m", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(F.coalesce("e.metadata", F.create_map().cast("map<string,string>")), k))
    return flat.select("claim_id", "claim", "label", "split", "place", F.col("e.doc_id").alias("doc_id"), F.col("e.title").alias("title"), F.col("e.text").alias("text"), F.map_concat(own, F.coalesce("e.metadata", F.create_map().cast("map<string,string>"))).alias("metadata"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
