"""More registered queries: reports, comparisons and record-level rules, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import citations as Q
from claimloom.functions import constants as C
from claimloom.functions import labels as L
from claimloom.functions import templates as T
from claimloom.functions import text as X
from claimloom.operators import audit, builders, dedupe, metrics, models, ranking, sampling, verify
from claimloom.operators import retrieval as R
from claimloom.operators.numbering import hash_bucket, numbered
from claimloom.plans import api, evaluate
from claimloom.plans import blocks as B
from claimloom.plans import queries as P
from claimloom.plans.queries import ORACLES, QUERIES, query
from claimloom.sources import claims as S

_STRIP = B.trim


def _r(df, *keys, places=6):
    return df.select(*keys, *[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


# ---- records and scans


@query("p05_unescaped_titles", "SELECT item_id, replace(text, '_', ' ') || ' (a) [b]: c' AS title FROM benchmark")
def _(spark, sf):
    raw = F.concat(F.replace("text", F.lit(" "), F.lit("_")), F.lit("_-LRB-a-RRB-_-LSB-b-RSB--COLON-_c"))
    return P.tab(spark, sf, "benchmark").select("item_id", X.unescape_title(raw).alias("title"))


_SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda x: trim(x, E' \\t\\n\\r')), lambda x: x <> '')"


@query("p04_sentence_of_page", f"SELECT doc_id, md5(CASE WHEN n >= 0 AND n < len(s) THEN s[n + 1] WHEN len(s) > 0 THEN s[1] ELSE replace(source, '_', ' ') END) AS sentence_md5 FROM (SELECT doc_id, source, {_SENT} AS s, doc_id % 7 - 1 AS n FROM documents)")
def _(spark, sf):
    d = P.corpus(spark, sf)
    return d.select("doc_id", F.md5(S.sentence_of(F.col("text"), (F.col("doc_id") % 7 - 1).cast("int"), F.col("source")).cast("binary")).alias("sentence_md5"))


@query("p08_picked_sentences", f"SELECT doc_id, md5(CASE WHEN len(g) > 0 THEN array_to_string(g, ' ') ELSE text END) AS picked_md5 FROM (SELECT doc_id, text, list_filter([s[3], s[1], s[100]], lambda x: x IS NOT NULL) AS g FROM (SELECT doc_id, text, {_SENT} AS s FROM documents))")
def _(spark, sf):
    ids = F.array(F.lit(2), F.lit(0), F.lit(-1), F.lit(99))
    return P.corpus(spark, sf).select("doc_id", F.md5(S.picked_sentences(F.col("text"), ids).cast("binary")).alias("picked_md5"))


@query("p09_eligible", f"WITH {P._FSP} SELECT ord FROM fsp WHERE {_STRIP('claim')} <> '' AND {_STRIP('evidence')} <> ''")
def _(spark, sf):
    return builders.eligible(P.first_sentence_pairs(spark, sf)).select("ord")


@query("p22_record_json", "SELECT item_id, '{\"claim_id\":\"' || item_id || '\",\"claim\":' || to_json(text) || ',\"evidence\":[{\"doc_id\":\"' || item_id % 5 || '\"}]}' AS line FROM benchmark")
def _(spark, sf):
    evidence = F.array(F.struct((F.col("item_id") % 5).cast("string").alias("doc_id")))
    return P.tab(spark, sf, "benchmark").select("item_id", F.to_json(F.struct(F.col("item_id").cast("string").alias("claim_id"), F.col("text").alias("claim"), evidence.alias("evidence"))).alias("line"))


@query("k15_training_records", "SELECT item_id AS query_id FROM benchmark ORDER BY CAST(item_id AS VARCHAR) LIMIT 25")
def _(spark, sf):
    return ranking.training_records(P.claims(spark, sf).withColumn("claim_id", F.col("query_id")), 25).select("query_id")


@query("w15_shuffled_union", "SELECT key, row_number() OVER (ORDER BY sha256('42|' || key), key)::BIGINT AS place FROM (SELECT 'd' || doc_id AS key FROM documents UNION ALL SELECT 'b' || item_id FROM benchmark)")
def _(spark, sf):
    d = P.tab(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("key"))
    both = d.unionByName(P.tab(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("key")))
    order = sampling.hash_order("key", 42)
    return numbered(both, hash_bucket(order), [order, "key"], "place").select("key", "place")


@query("b14_sampled_corpus", """WITH s AS (SELECT conv_id, text, row_number() OVER (ORDER BY sha256('42|' || conv_id), conv_id) AS n FROM conversations WHERE turn = 0), p AS (SELECT conv_id, text, CASE WHEN row_number() OVER (ORDER BY sha256('7|' || conv_id), conv_id) <= 15 THEN 'val' ELSE 'train' END AS split FROM s WHERE n <= 60),
c AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, text, split, 0 AS src, conv_id AS ord FROM p UNION ALL SELECT CAST(item_id AS VARCHAR), text, 'benchmark', 1, item_id FROM benchmark)
SELECT doc_id, split, md5(text) AS text_md5 FROM c WHERE trim(text, E' \\t\\n\\r') <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY src, ord) = 1""")
def _(spark, sf):
    first = P.tab(spark, sf, "conversations").where("turn = 0")
    picked = sampling.split(sampling.sample(first, 60, "conv_id"), 15, "conv_id", 7)
    a = picked.select(F.col("conv_id").cast("string").alias("doc_id"), "text", "split", F.col("conv_id").alias("ord"))
    b = P.tab(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), "text", F.lit("benchmark").alias("split"), F.col("item_id").alias("ord"))
    return dedupe.assemble_corpus([a, b]).select("doc_id", "split", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("d12_merged_counts", "SELECT value, count(*)::BIGINT AS n FROM (SELECT lang AS value FROM documents UNION ALL SELECT role FROM conversations UNION ALL SELECT lang FROM documents) GROUP BY value")
def _(spark, sf):
    d, c = audit.histogram(P.tab(spark, sf, "documents"), "lang"), audit.histogram(P.tab(spark, sf, "conversations"), "role")
    return audit.merged_counts([d, c, d])


# ---- retrieval


@query("r19_backends", f"WITH {P._CHANNELS}, {B.rrf('hy', P._BASIC, 5)}, t5 AS (SELECT query_id, ord, rank FROM btop WHERE rank <= 5), u AS (SELECT 'bm25' AS mode, 'bm25' AS backend, query_id, ord, rank FROM t5 UNION ALL SELECT 'unknown', 'bm25_fallback', query_id, ord, rank FROM t5 UNION ALL SELECT 'dense', 'dense', query_id, ord, rank FROM dense WHERE rank <= 5 UNION ALL SELECT 'hybrid', 'hybrid', query_id, ord, rank FROM hy) SELECT mode, backend, query_id, ord, rank::INT AS rank FROM u")
def _(spark, sf):
    q, d, kept = P.claims(spark, sf), P.corpus(spark, sf), {}
    return builders.union_all([R.retrieve(q, d, m, 5, kept).select(F.lit(m).alias("mode"), "backend", "query_id", "ord", "rank") for m in ("bm25", "dense", "hybrid", "unknown")])


@query("j08_best_payload", f"WITH {P._CHANNELS}, u AS (SELECT query_id, ord, rank, score, 0 AS l FROM btop UNION ALL SELECT query_id, ord, rank, score, 1 FROM dense) SELECT query_id, ord, arg_max(l, {{'s': score, 'l': l, 'r': rank}})::INT AS list_no FROM u GROUP BY query_id, ord")
def _(spark, sf):
    q, d = P.claims(spark, sf), P.corpus(spark, sf)
    lists = [R.bm25_topk(q, d, 10), R.dense_topk(R.with_embedding(q), R.with_embedding(d), 10)]
    both = builders.union_all([x.withColumn("list_no", F.lit(i)) for i, x in enumerate(lists)]).withColumn("which", F.col("list_no"))
    return R.best_payload(both, ["which"]).select("query_id", "ord", F.col("which").alias("list_no"))


@query("k04_tolerant_rerank", f"{P._PAIRS}, h AS (SELECT *, max(CASE WHEN query_id % 4 = 0 AND rank = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS bad, len(list_intersect({P.sql_space('claim')}, {P.sql_space('text')}))::DOUBLE AS s FROM pr), o AS (SELECT query_id, ord, CASE WHEN bad = 1 THEN 'input_order' ELSE 'cross_encoder' END AS rerank_backend, CASE WHEN bad = 1 THEN -rank::DOUBLE ELSE s END AS s FROM h) SELECT query_id, ord, rerank_backend, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, CAST(ord AS VARCHAR))::INT AS rerank_rank FROM o")
def _(spark, sf):
    def load():
        def model(claims, texts):
            if any(t == "" for t in texts):
                raise RuntimeError("the model does not take this")
            return [float(len(set(a.lower().split()) & set(b.lower().split()))) for a, b in zip(claims, texts, strict=True)]

        return model

    rows = P._bm25_with_text(spark, sf)
    rows = rows.withColumn("text", F.when((F.col("query_id") % 4 == 0) & (F.col("rank") == 3), "").otherwise(F.col("text")))
    return models.tolerant_rerank(rows, load).select("query_id", "ord", "rerank_backend", "rerank_rank")


# ---- functions over answers


_ANSWER = f"""{P._FSP}, r AS (SELECT *, CASE ord % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NOT_ENOUGH_INFO' END AS label FROM fsp),
an AS (SELECT ord, {P._SHOW} AS gold, evidence, {P._TOLD} AS told, CASE ord % 5 WHEN 0 THEN 'no verdict here' ELSE 'verdict: ' || CASE WHEN ord % 7 = 0 THEN 'Refuted' ELSE lower({P._SHOW}) END || chr(10) || 'Explanation: ' || {P._TOLD} || chr(10) || 'Citation: [1]' END AS answer FROM r)"""
_NOT_ANSWERED = "regexp_extract(answer, '(?i)verdict:\\s*(SUPPORTED|REFUTED|NOT ENOUGH INFO)', 1)"
_PARSED = f"{_ANSWER}, pa AS (SELECT ord, gold, evidence, upper(coalesce(nullif({_NOT_ANSWERED}, ''), 'UNPARSEABLE')) AS verdict, CASE WHEN ord % 5 = 0 THEN answer ELSE {_STRIP('told')} END AS explanation FROM an)"


def answers(spark, sf):
    """(ord, label, answer, context): generated-looking answers, some without a verdict, some with a wrong one."""
    rows = P.sft_rows(spark, sf).withColumn("label", L.artifact_label("label"))
    shown = F.when(F.col("label") == C.NEI_DISK, C.NEI).otherwise(F.col("label"))
    lead = F.when(F.col("evidence") != "", F.col("evidence"))
    told = T.grounded_explanation(shown, lead)
    verdict = F.when(F.col("ord") % 7 == 0, "Refuted").otherwise(F.lower(shown))
    answer = F.when(F.col("ord") % 5 == 0, "no verdict here").otherwise(F.concat(F.lit("verdict: "), verdict, F.lit("\nExplanation: "), told, F.lit("\nCitation: [1]")))
    one = F.array(F.struct(F.lit(1).alias("citation_id"), F.lit(None).cast("string").alias("title"), F.col("evidence").alias("text")))
    context = F.when(F.col("evidence") != "", one).otherwise(F.array().cast("array<struct<citation_id:int,title:string,text:string>>"))
    return rows.select("ord", shown.alias("label"), answer.alias("answer"), context.alias("context"))


@query("f47_verdict_answers", f"WITH {_PARSED} SELECT ord, verdict, md5(explanation) AS explanation_md5 FROM pa")
def _(spark, sf):
    a = answers(spark, sf).select("ord", T.verdict_answer("answer").alias("a"))
    return a.select("ord", "a.verdict", F.md5(F.col("a.explanation").cast("binary")).alias("explanation_md5"))


_CHECKED = f"{_PARSED}, {B.checked('SELECT ord AS key, explanation AS told FROM pa', 'SELECT ord AS key, 1 AS id, evidence AS text FROM pa WHERE evidence <> ' + chr(39) * 2)}"


@query("a54_adapter_metrics", f"""WITH {_CHECKED}, f1 AS (SELECT l, CASE WHEN count(*) FILTER (gold = l AND verdict = l) > 0 THEN 2.0::DOUBLE * count(*) FILTER (gold = l AND verdict = l) / (count(*) FILTER (gold = l) + count(*) FILTER (verdict = l)) ELSE 0.0 END AS f FROM pa, (SELECT unnest({P.sql_list(C.LABELS)}) AS l) GROUP BY l)
SELECT count(*) AS n, round_even(avg(CASE WHEN gold = verdict THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS verdict_accuracy, round_even((SELECT avg(f) FROM f1), 4) AS macro_f1, count(*) FILTER (verdict <> 'UNPARSEABLE') AS parseable, round_even(avg(CASE WHEN verdict <> 'UNPARSEABLE' THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS parseable_rate, round_even(avg(CASE WHEN valid THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS citation_valid_rate, round_even(avg(rate), 4) AS unsupported_sentence_rate FROM pa JOIN ck ON ck.key = pa.ord""")
def _(spark, sf):
    return evaluate.adapter_metrics(answers(spark, sf))


@query("a61_hallucination_rates", f"WITH {_CHECKED} SELECT key AS ord, round(rate, 6) AS hallucination_rate FROM ck")
def _(spark, sf):
    rows = answers(spark, sf).select("ord", "context", T.verdict_answer("answer")["explanation"].alias("told"))
    return rows.select("ord", F.round(Q.hallucination_rate(Q.check_citations("told", F.col("context"))), 6).alias("hallucination_rate"))


@query("f29_unsupported_rates", f"WITH {_CHECKED} SELECT pa.ord, round(CASE WHEN evidence = '' THEN CASE WHEN {_STRIP('explanation')} <> '' THEN 1.0 ELSE 0.0 END ELSE rate END, 6)::DOUBLE AS unsupported FROM pa JOIN ck ON ck.key = pa.ord")
def _(spark, sf):
    rows = answers(spark, sf).select("ord", "context", T.verdict_answer("answer")["explanation"].alias("told"))
    return rows.select("ord", F.round(Q.unsupported_rate("told", F.col("context")), 6).alias("unsupported"))


@query("u01_validated_citations", f"""WITH {P._FSP}, {B.checked(P._TOLD8, P._CTX1)}, vs AS (SELECT a.key, count(*) AS parts, count(*) FILTER (NOT (list_contains(a.sids, 1) AND length(s) % 2 = 0)) AS bad FROM (SELECT x.key, x.i, x.sids, y.s FROM cks2 x JOIN cks1 y ON y.key = x.key AND y.i = x.i) a GROUP BY a.key)
SELECT ck.key AS ord, round(coalesce(bad::DOUBLE / parts, 0), 6) AS unsupported_sentence_rate, len(missing) = 0 AND coalesce(bad, 0) = 0 AS valid FROM ck LEFT JOIN vs ON vs.key = ck.key""")
def _(spark, sf):
    p = P.first_sentence_pairs(spark, sf).where("evidence <> ''")
    ctx = F.array(F.struct(F.lit(1).alias("citation_id"), F.lit(None).cast("string").alias("title"), F.col("evidence").alias("text")))
    told = F.concat(F.lit("[1] "), F.col("claim"), F.when(F.col("ord") % 2 == 0, " [7] And more.").otherwise("; [1] so it is."))

    def load():
        return lambda sentences, passages: [len(s) % 2 == 0 for s in sentences]

    checked = Q.validated_citations(p.select("ord", told.alias("told"), ctx.alias("ctx")), "ord", "told", "ctx", models.pair_udf(load, "boolean"))
    return checked.select("ord", F.round("check.unsupported_sentence_rate", 6).alias("unsupported_sentence_rate"), "check.valid")


@query("f41_chat_lines", f"WITH {P._SFT} SELECT ord, md5('{{\"messages\":[{{\"role\":\"system\",\"content\":' || to_json('{C.CHAT_SYSTEM}') || '}},{{\"role\":\"user\",\"content\":' || to_json(prompt) || '}},{{\"role\":\"assistant\",\"content\":' || to_json(completion) || '}}]}}') AS line_md5 FROM sft")
def _(spark, sf):
    r = builders.sft_records(P.sft_rows(spark, sf), "train")
    return r.select(F.col("claim_id").cast("long").alias("ord"), F.md5(T.chat_line(C.CHAT_SYSTEM, F.col("prompt"), F.col("completion")).cast("binary")).alias("line_md5"))


@query("f45_chat_prompts", f"WITH {P._FSP} SELECT ord, md5('Claim: ' || claim || chr(10) || 'Evidence: ' || CASE WHEN evidence = '' THEN '(no evidence provided)' ELSE '[1] ' || evidence END || chr(10) || '{C.CHAT_TASK}') AS prompt_md5 FROM fsp")
def _(spark, sf):
    return P.first_sentence_pairs(spark, sf).select("ord", F.md5(T.chat_prompt(F.col("claim"), F.col("evidence")).cast("binary")).alias("prompt_md5"))


@query("a69_candidate_rates", f"{P._PREF} SELECT candidate, count(*) AS n, round_even(avg(CASE WHEN valid_json THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS json_parse_rate, round_even(avg(CASE WHEN verdict_matches THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS verdict_consistency_rate, round_even(avg(CASE WHEN citation_valid THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS citation_valid_rate, round_even(avg(unsupported_sentence_rate), 4) AS unsupported_sentence_rate FROM pf GROUP BY candidate")
def _(spark, sf):
    p = P.first_sentence_pairs(spark, sf)
    ctx = F.array(F.struct(F.lit(1).alias("citation_id"), F.lit(None).cast("string").alias("title"), F.col("evidence").alias("text")))
    good = F.to_json(F.struct(F.lit("SUPPORTED").alias("verdict"), F.concat(F.lit("[1] "), F.substring("evidence", 1, 200)).alias("explanation"), F.array(F.lit("1")).alias("citations")))
    each = p.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("answer", F.when(F.col("candidate") == 0, good).otherwise(F.col("claim")))
    return ranking.candidate_rates(each.select("candidate", ranking.candidate_metrics("answer", F.lit("SUPPORTED"), ctx).alias("m")), "m", ("candidate",))


@query("a24_preference_stats", ORACLES["f40_preference_pairs"].split("SELECT ord, v AS gold_label")[0] + f"""SELECT count(*) AS n, count(*) AS chosen_valid, 1.0::DOUBLE AS chosen_valid_rate,
  round_even(avg(len({B.words("'" + C.CHAT_SYSTEM + "' || chr(10) || chr(10) || 'Claim: ' || claim || chr(10) || 'Evidence: [1] ' || evidence || chr(10) || '" + C.CHAT_TASK + "'")})), 2) AS avg_prompt_words,
  round_even(avg(len({B.words("'Verdict: ' || v || chr(10) || 'Explanation: ' || told || chr(10) || 'Citation: [1]'")})), 2) AS avg_chosen_words,
  round_even(avg(len({B.words("'Verdict: ' || CASE kind WHEN 0 THEN w ELSE v END || chr(10) || 'Explanation: ' || CASE kind WHEN 0 THEN '[1] ' || lead || ' and therefore ' || CASE w WHEN 'SUPPORTED' THEN 'supports the claim' ELSE 'contradicts the claim' END || '.' WHEN 1 THEN '[2] ' || lead || ' therefore the claim is ' || lower(v) || '.' ELSE 'The claim is ' || lower(v) || ' based on general background knowledge.' END || chr(10) || 'Citation: ' || CASE kind WHEN 0 THEN '[1]' WHEN 1 THEN '[2]' ELSE '(none)' END")})), 2) AS avg_rejected_words FROM k""")
def _(spark, sf):
    rows = P.sft_rows(spark, sf).withColumn("label", L.artifact_label("label"))
    return audit.preference_stats(builders.preference_pairs(rows).withColumn("chosen_citation_valid", F.lit(True)))


# ---- evaluations


_SIX = ("recall_1", "recall_5", "recall_10", "ndcg_10", "mrr", "map")


def _sql_compare(base: str, challenger: str, names) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS metric, round_even(max({c}) FILTER (strategy = '{base}'), 4) AS base, round_even(max({c}) FILTER (strategy = '{challenger}'), 4) AS challenger FROM me" for c in names)
    return f"SELECT *, round_even(challenger - base, 4) AS delta, CASE WHEN round_even(challenger - base, 4) > 0 THEN 'improved' WHEN round_even(challenger - base, 4) < 0 THEN 'regressed' ELSE 'unchanged' END AS direction FROM ({rows})"


_STRATEGIES = ORACLES["a64_retrieval_by_strategy"].rsplit("SELECT * FROM me", 1)[0]


@query("a65_strategy_notes", _STRATEGIES + _sql_compare("bm25_only", "hybrid_bm25_dense", _SIX))
def _(spark, sf):
    profiles = {n: evaluate.PROFILES[n] for n in ("bm25_only", "hybrid_bm25_dense")}
    scores = evaluate.retrieval_by_strategy(P.claims(spark, sf), P.corpus(spark, sf), P.gold(spark, sf), profiles)
    return evaluate.compare(_r(scores, "strategy"), "bm25_only", "hybrid_bm25_dense", _SIX)


@query("a74_best_strategy", _STRATEGIES + "SELECT strategy AS best, recall_10 FROM me ORDER BY recall_10 DESC, strategy LIMIT 1")
def _(spark, sf):
    scores = evaluate.retrieval_by_strategy(P.claims(spark, sf), P.corpus(spark, sf), P.gold(spark, sf))
    return evaluate.best_strategy(_r(scores, "strategy"), "recall_10")


_FIVE = ("map", "mrr", "ndcg_10", "recall_1", "recall_5")


@query("a66_reranker_comparison", f"{P._PAIRS}, hr AS (SELECT query_id, ord, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, CAST(ord AS VARCHAR)) AS rank FROM (SELECT query_id, ord, {P._HEUR} AS s FROM pr)), ra AS (SELECT 'retrieved' AS strategy, query_id, ord, rank FROM top UNION ALL SELECT 'reranked', query_id, ord, rank FROM hr), {B.per_strategy('ra', 10)} {_sql_compare('retrieved', 'reranked', _FIVE)}")
def _(spark, sf):
    rows = R.once(P._bm25_with_text(spark, sf))
    both = rows.select("query_id", "ord", "rank", F.lit("retrieved").alias("strategy")).unionByName(ranking.rerank(rows, ranking.heuristic_score("claim", "text")).select("query_id", "ord", F.col("rerank_rank").alias("rank"), F.lit("reranked").alias("strategy")))
    names = spark.createDataFrame([("retrieved",), ("reranked",)], "strategy string")
    each = metrics.per_query(both, P.gold(spark, sf), P.claims(spark, sf).select("query_id").crossJoin(F.broadcast(names)), (1, 5, 10), (10,), ("query_id", "strategy"))
    return evaluate.compare(_r(metrics.summary(each, ("strategy",)), "strategy"), "retrieved", "reranked", _FIVE)


_CUTS = (1, 3, 5, 10, 50)
_A28 = f"""WITH {P.BM25}, {P.sql_topk(50)}, g AS (SELECT DISTINCT * FROM gold), n AS (SELECT query_id, count(*)::INT AS n_rel FROM g GROUP BY ALL),
j AS (SELECT t.query_id, t.rank, CASE WHEN g.ord IS NULL THEN 0 ELSE 1 END AS rel FROM top t LEFT JOIN g ON g.query_id = t.query_id AND g.ord = t.ord),
m AS (SELECT query_id, {", ".join(f"sum(rel) FILTER (rank <= {k}) AS h{k}" for k in _CUTS)}, {", ".join(f"coalesce(sum(1.0 / log2(rank + 1)) FILTER (rel = 1 AND rank <= {k}), 0) AS d{k}" for k in (5, 10))} FROM j GROUP BY ALL),
pq AS (SELECT q.query_id, {", ".join(f"CASE WHEN n_rel > 0 THEN h{k} / n_rel ELSE 0 END AS recall_{k}" for k in _CUTS)}, {", ".join(f"CASE WHEN n_rel > 0 THEN d{k} / {P._IDCG.format(n=f'least(n_rel, {k})')} ELSE 0 END AS ndcg_{k}" for k in (5, 10))} FROM q LEFT JOIN m USING (query_id) LEFT JOIN n USING (query_id))"""


@query("a28_retrieval_metrics", f"{_A28} SELECT count(*) AS n_queries, {', '.join(f'round(avg({c}), 4) AS {c}' for c in [*(f'recall_{k}' for k in _CUTS), 'ndcg_5', 'ndcg_10'])} FROM pq")
def _(spark, sf):
    q = P.claims(spark, sf)
    s = metrics.summary(metrics.per_query(R.bm25_topk(q, P.corpus(spark, sf), 50), P.gold(spark, sf), q))
    return _r(s.drop("mrr", "map"), "n_queries", places=4)


_GATES = ORACLES["j16_gate_grid"].split(" SELECT t AS threshold")[0]


@query("a41_gate_argmax", f"{_GATES} SELECT t AS threshold, round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM e GROUP BY t ORDER BY 2 DESC, 1 LIMIT 1")
def _(spark, sf):
    rows = QUERIES["j16_gate_grid"](spark, sf)
    return rows.orderBy(F.col("accuracy").desc(), "threshold").limit(1)


def _sql_scores(rel: str, key: str, labels, extra: str = "") -> str:
    f1 = " + ".join(f"CASE WHEN count(*) FILTER (y = '{v}' AND p = '{v}') > 0 THEN 2.0::DOUBLE * count(*) FILTER (y = '{v}' AND p = '{v}') / (count(*) FILTER (y = '{v}') + count(*) FILTER (p = '{v}')) ELSE 0.0 END" for v in labels)
    return f"SELECT {key}, count(*) AS n, round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy, round(({f1}) / {len(labels)}, 6) AS macro_f1{extra} FROM {rel} GROUP BY {key}"


_RECALL = ", round(coalesce(count(*) FILTER (y = 'REFUTED' AND p = 'REFUTED')::DOUBLE / nullif(count(*) FILTER (y = 'REFUTED'), 0), 0), 6) AS refuted_recall"


@query("a63_challenger_scores", f"WITH {P._BOTH} {_sql_scores('pb', 'evidence_source, mode', C.LABELS, _RECALL)}")
def _(spark, sf):
    p = evaluate.oracle_and_retrieved(*P._evidences(spark, sf))
    rows = p.join(P.labelled_claims(spark, sf).select("query_id", F.col("label").alias("y")), "query_id").withColumnRenamed("verdict", "p")
    return _r(metrics.labelled_scores(rows, ("evidence_source", "mode")), "evidence_source", "mode")


@query("b20_threshold_comparison", f"""WITH {P._PRED}, tv AS (SELECT t.name AS thresholds, ag.query_id, CASE WHEN s >= t.a AND s > r THEN 'SUPPORTED' WHEN r >= t.b AND r > s THEN 'REFUTED' ELSE 'NOT ENOUGH INFO' END AS p FROM ag, (VALUES ('default', 0.5, 0.5), ('calibrated', 0.8, 0.6)) t(name, a, b)), tl AS (SELECT thresholds, label AS y, p FROM tv JOIN lc USING (query_id)),
ts AS (SELECT x.*, z.nei_fpr FROM ({_sql_scores("tl", "thresholds", C.LABELS).replace("round(avg(CASE", "(avg(CASE").replace(", 6) AS accuracy", ") AS accuracy").replace("round((CASE", "((CASE").replace(", 6) AS macro_f1", ") AS macro_f1")}) x JOIN (SELECT thresholds, coalesce(count(*) FILTER (y = 'NOT ENOUGH INFO' AND p <> y)::DOUBLE / nullif(count(*) FILTER (y = 'NOT ENOUGH INFO'), 0), 0.0) AS nei_fpr FROM tl GROUP BY ALL) z USING (thresholds)),
tu AS (SELECT * FROM ts UNION ALL SELECT 'delta', max(n), {", ".join(f"max({c}) FILTER (thresholds = 'calibrated') - max({c}) FILTER (thresholds = 'default')" for c in ("accuracy", "macro_f1", "nei_fpr"))} FROM ts)
SELECT thresholds, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(nei_fpr, 6) AS nei_fpr FROM tu""")
def _(spark, sf):
    q, d = P.claims(spark, sf), P.corpus(spark, sf)
    return _r(evaluate.threshold_comparison(q, api.evidence_for(q, d, 5).select("query_id", "rank", "text"), P.labelled_claims(spark, sf), (0.8, 0.6)), "thresholds")


_PAIR_LABELS = ("SUPPORTS", "REFUTES", "NEI")
_PAIRS70 = "pl70 AS (SELECT source, CASE doc_id % 3 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES' ELSE 'NEI' END AS y, CASE WHEN (length(text) % 13) / 13.0::DOUBLE < 0.4 THEN 'NEI' WHEN length(text) % 2 = 0 THEN 'SUPPORTS' ELSE 'REFUTES' END AS p FROM documents)"


def _pair_predictions(spark, sf):
    n, i = F.length("text"), F.col("doc_id") % 3
    told = F.when(n % 2 == 0, "SUPPORTS").otherwise("REFUTES")
    return P.corpus(spark, sf).select("source", F.when(i == 0, "SUPPORTS").when(i == 1, "REFUTES").otherwise("NEI").alias("y"), verify.gated_label(told, (n % 13) / F.lit(13.0), 0.4).alias("p"))


@query("a70_pair_label_scores", f"WITH {_PAIRS70} {_sql_scores('pl70', 'source', _PAIR_LABELS)}")
def _(spark, sf):
    return _r(metrics.labelled_scores(_pair_predictions(spark, sf), ("source",), _PAIR_LABELS, "REFUTES").drop("refutes_recall"), "source")


@query("a72_class_report", f"WITH {_PAIRS70}, l AS (SELECT unnest({P.sql_list(_PAIR_LABELS)}) AS label) SELECT label, round(coalesce(count(*) FILTER (y = label AND p = label)::DOUBLE / nullif(count(*) FILTER (p = label), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (y = label AND p = label)::DOUBLE / nullif(count(*) FILTER (y = label), 0), 0), 6) AS recall, round(CASE WHEN count(*) FILTER (y = label AND p = label) > 0 THEN 2.0::DOUBLE * count(*) FILTER (y = label AND p = label) / (count(*) FILTER (y = label) + count(*) FILTER (p = label)) ELSE 0.0 END, 6) AS f1, count(*) FILTER (y = label) AS support FROM pl70, l GROUP BY label")
def _(spark, sf):
    return _r(metrics.per_class(_pair_predictions(spark, sf)), "label")


@query("v16_pair_labels", f"WITH {P._PRED} SELECT query_id, rank::INT AS rank, CASE verdict WHEN 'SUPPORTED' THEN 'SUPPORTS' WHEN 'REFUTED' THEN 'REFUTES' ELSE 'NEI' END AS pair_label FROM pl")
def _(spark, sf):
    v, verdict = verify.verify_passages(P.claim_passages(spark, sf)), F.col("result.verdict")
    return v.select("query_id", "rank", F.when(verdict == C.SUPPORTED, "SUPPORTS").when(verdict == C.REFUTED, "REFUTES").otherwise("NEI").alias("pair_label"))


@query("v09_routed_verdicts", f"WITH {P._PRED}, m AS (SELECT query_id, rank, ov AS s, 0.3::DOUBLE AS r, 0.4::DOUBLE AS n FROM pl) SELECT query_id, rank::INT AS rank, 'rules' AS verifier_name, verdict, round(confidence, 6)::DOUBLE AS confidence FROM pl UNION ALL SELECT query_id, rank::INT, 'model', CASE WHEN s >= 0.4 THEN 'SUPPORTED' ELSE 'NOT ENOUGH INFO' END, round(greatest(s, 0.4), 6)::DOUBLE FROM m")
def _(spark, sf):
    def load():
        def share(a, b):
            mine, theirs = set(a.lower().split()), set(b.lower().split())
            return len(mine & theirs) / len(mine) if mine else 0.0

        return lambda claims, texts: [[share(a, b), 0.3, 0.4] for a, b in zip(claims, texts, strict=True)]

    pairs = R.once(P.claim_passages(spark, sf))
    both = models.verify_with(pairs).unionByName(models.verify_with(pairs, load))
    return both.select("query_id", "rank", "verifier_name", "result.verdict", F.round("result.confidence", 6).alias("confidence"))


@query("v08_label_scores", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0.7 ELSE 0.0 END::DOUBLE AS supported, 0.2::DOUBLE AS refuted, (doc_id % 10) / 10.0::DOUBLE AS nei FROM documents")
def _(spark, sf):
    item = lambda n, s: F.struct(F.lit(n).alias("label"), s.cast("double").alias("score"))
    given = F.array(item("refuted", F.lit(0.2)), item("NOT_ENOUGH_INFO", F.col("doc_id") % 10 / F.lit(10.0)), F.when(F.col("doc_id") % 2 == 0, item("Supported", F.lit(0.7))).otherwise(item("other", F.lit(0.9))))
    return P.tab(spark, sf, "documents").select("doc_id", models.label_scores(given).alias("s")).select("doc_id", "s.*")


@query("a18_verifier_data_audit", f"{ORACLES['b03_verifier_examples'].replace('SELECT ord, claim_id, label, gold AS evidence', 'SELECT evidence_type, count(*) AS n, count(*) FILTER (evidence = ' + chr(39) * 2 + ') AS missing_evidence FROM (SELECT ord, claim_id, label, gold AS evidence', 1)}) GROUP BY evidence_type")
def _(spark, sf):
    rows = QUERIES["b03_verifier_examples"](spark, sf)
    return audit.quality_audit(rows, claim="claim_id", by=("evidence_type",)).select("evidence_type", "n", "missing_evidence")


# ---- latencies


@query("t03_stage_latencies", "SELECT user_id, coalesce(sum(value) FILTER (event_id % 3 = 0), 0)::DOUBLE AS retrieval_ms, coalesce(sum(value) FILTER (event_id % 3 = 1), 0)::DOUBLE AS verification_ms, coalesce(sum(value) FILTER (event_id % 3 = 2), 0)::DOUBLE AS explanation_ms, coalesce(sum(value), 0)::DOUBLE AS total_ms FROM (SELECT user_id, event_id, round(value)::BIGINT AS value FROM events) GROUP BY user_id")
def _(spark, sf):
    stages = ("retrieval", "verification", "explanation")
    stage = F.element_at(F.array(*map(F.lit, stages)), (F.col("event_id") % 3 + 1).cast("int"))
    log = P.tab(spark, sf, "events").select("user_id", stage.alias("stage"), F.round("value").alias("ms"))
    return audit.stage_latencies(log, stages, "user_id")


@query("a73_runtime_summary", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, any_value(n) AS n, round(avg(value), 3) AS mean_ms, round(CASE WHEN avg(value) > 0 THEN 8 / (avg(value) / 1000.0) END, 3) AS examples_per_second, max(value) FILTER (i = round_even(0.5 * (n - 1), 0)::INT) AS p50, max(value) FILTER (i = round_even(0.95 * (n - 1), 0)::INT) AS p95 FROM r GROUP BY event_type")
def _(spark, sf):
    s = audit.runtime_summary(P.tab(spark, sf, "events"), "value", ("event_type",), 8)
    return s.select("event_type", "n", F.round("mean_ms", 3).alias("mean_ms"), F.round("examples_per_second", 3).alias("examples_per_second"), "p50", "p95")
