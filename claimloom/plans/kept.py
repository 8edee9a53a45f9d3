"""Registered queries of what is kept, looped or streamed: the index, the reflection loop, exact selection, state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.functions import constants as C
from claimloom.functions import templates as T
from claimloom.functions import text as X
from claimloom.operators import index as I
from claimloom.operators import grids, listwise, reflect, sampling, verify
from claimloom.operators.numbering import zip_rows
from claimloom.plans import api
from claimloom.plans.queries import _CAND, _LOG, _MARGIN, _OUTCOME, _PRED, _TOK, BM25, _features, _sql_content, _sql_grid, claim_passages, claims, corpus, labelled_claims, query, request_log, sql_jaccard, sql_overlap, sql_topk, tab
from claimloom.plans.reports import ORACLES, QUERIES, _r
from claimloom.session import fresh_path, written
from claimloom.sources.upsert import UpsertTable
from claimloom.streaming import state

__all__ = ["ORACLES", "QUERIES"]

# ---- the kept index

_TOP = f"WITH {BM25}, {sql_topk(10)} SELECT query_id, ord, round(score, 6) AS score, rank FROM top"


def _built(spark, sf) -> I.KeptIndex:
    return I.build(corpus(spark, sf), fresh_path(spark, "index"))


def _in_batches(spark, sf) -> I.KeptIndex:
    """Two batches, of which the second is sent twice."""
    docs, kept = corpus(spark, sf), I.KeptIndex(spark, fresh_path(spark, "index"))
    kept.append(docs.where("ord % 2 = 0"))
    for _ in range(2):
        kept.append(docs.where("ord % 2 = 1"))
    return kept


@query("j04_kept_index_topk", _TOP)
def _(spark, sf):
    return _built(spark, sf).topk(claims(spark, sf), 10).withColumn("score", F.round("score", 6))


@query("j04_index_in_batches", _TOP)
def _(spark, sf):
    return _in_batches(spark, sf).topk(claims(spark, sf), 10).withColumn("score", F.round("score", 6))


@query("r02_kept_index_terms", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def _(spark, sf):
    kept = _in_batches(spark, sf)
    kept.compact()
    return kept.terms()


# ---- the reflection loop


def _hesitant(prompt, attempt):
    """A generator that gives grounded replies from the round on that the prompt's length says, as JSON or as plain text, and cites what is not there before."""
    verdict = F.regexp_extract(prompt, r"\nVerdict: ([A-Z ]+)\n", 1)
    lead = F.regexp_extract(prompt, r"(?s)\nEvidence:\n\[1\] (?:src\d+: )?(.*?)\n(?:\[2\] |Write a concise explanation)", 1)
    good = T.grounded_explanation(verdict, lead)
    bad = F.concat(F.lit("Verdict: "), verdict, F.lit(" based on [99]; unsupported citation"))
    as_json = F.concat(F.lit("Reply: "), F.to_json(F.struct(good.alias("explanation"), F.array(F.lit("1")).alias("citations"))))
    return F.when(attempt < F.length(prompt) % 4, bad).when(F.length(prompt) % 2 == 0, as_json).otherwise(good)


_LENGTHS = f"""pb AS (SELECT query_id, string_agg('[' || p.rank || '] ' || (CASE WHEN coalesce(d.source, '') <> '' THEN d.source || ': ' ELSE '' END) || d.text, chr(10) ORDER BY p.rank) AS block FROM top p JOIN d USING (ord) GROUP BY query_id),
pn AS (SELECT oc.query_id, length({" || ".join(f"'{part}'" + (f" || {value}" if value else "") for part, value in zip(C.EXPLANATION_PROMPT.split("{}"), ("q.text", "oc.verdict", "pb.block", ""), strict=True))}) % 4 AS need FROM oc JOIN q USING (query_id) JOIN pb USING (query_id))"""


@query("u08_reflection_rounds", f"""{_OUTCOME}, {_LENGTHS}
SELECT query_id, verdict, round(confidence, 6)::DOUBLE AS confidence, CASE WHEN NOT low AND valid THEN 'final' ELSE 'abstain' END AS decision, NOT low AND valid AS citation_valid, CASE WHEN low THEN 0 WHEN valid THEN need ELSE 3 END::INT AS retries_used,
  round(CASE WHEN low THEN 0.0 ELSE precision END, 6)::DOUBLE AS citation_precision, round(CASE WHEN low THEN 0.0 ELSE rate END, 6)::DOUBLE AS unsupported_sentence_rate FROM oc JOIN pn USING (query_id)""")
def _(spark, sf):
    d = corpus(spark, sf)
    retrieve = lambda asked, k: api.evidence_for(asked, d, k)
    out = reflect.reflection_loop(claims(spark, sf), retrieve, generate=_hesitant, max_retries=3)
    return out.select("query_id", "verdict", F.round("confidence", 6).alias("confidence"), "decision", "citation_valid", "retries_used", F.round("citation_precision", 6).alias("citation_precision"), F.round("unsupported_sentence_rate", 6).alias("unsupported_sentence_rate"))


# ---- resampling


@query("a49_block_bootstrap")
def _(spark, sf):
    """1,000 resamples; drawn by numpy's generators, which SQL has not."""
    pairs = tab(spark, sf, "labels").select(F.col("doc_id").alias("ord"), F.col("quality").cast("double").alias("a"), F.col("toxic").cast("double").alias("b"))
    out = sampling.block_bootstrap(pairs)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# ---- streams: the events arrive in files, are drained in several batches, and the stream is restarted half way

_TTL = 12 * 3600


def _events(spark, sf):
    e = tab(spark, sf, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _arriving(spark, rows, order: str, folder: str, run, files: int = 6) -> None:
    """Write the rows a slice a file; drain the stream after half of the files and again after all."""
    for i, part in enumerate(state.slices(rows, order, files)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if i in (files // 2 - 1, files - 1):
            run(state.table_stream(spark, f"{folder}/in", rows.schema))


@query("t01_ttl_cache", f"""WITH e AS (SELECT user_id, ts, value, lag(ts) OVER w AS before, lag(value) OVER w AS held, lead(ts) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t AS (SELECT INTERVAL {_TTL} SECOND AS ttl)
SELECT user_id AS key, epoch_us(ts) AS at, CASE WHEN before + ttl >= ts THEN 'hit' ELSE 'miss' END AS kind, CASE WHEN before + ttl >= ts THEN held END AS value FROM e, t
UNION ALL SELECT user_id, epoch_us(ts + ttl), 'purged', value FROM e, t WHERE coalesce(after, (SELECT max(ts) FROM events)) > ts + ttl""")
def _(spark, sf):
    folder = fresh_path(spark, "ttl")
    _arriving(spark, _events(spark, sf).select("event_id", "ts", "user_id", "value"), "ts", folder, lambda s: state.drain(state.ttl_cache(s, _TTL), folder, f"{folder}/out"))
    return spark.read.parquet(f"{folder}/out")


@query("t02_running_metrics", f"""WITH {_LOG}, a AS (SELECT count(*) AS requests, sum(fallback_used::INT)::BIGINT AS fallbacks, avg(fallback_used::INT) AS fallback_rate, avg(confidence) AS average_confidence, avg(latency_ms) AS average_latency_ms, avg(citation_valid::INT) AS citation_valid_rate FROM rl),
r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i FROM rl), p AS (SELECT max(latency_ms) FILTER (i >= 0.49 * (requests - 1) AND i <= 0.51 * (requests - 1)) IS NOT NULL AS p50_close, max(latency_ms) FILTER (i >= 0.94 * (requests - 1) AND i <= 0.96 * (requests - 1)) IS NOT NULL AS p95_close FROM r, a)
SELECT requests, fallbacks, round(fallback_rate, 6) AS fallback_rate, round(average_confidence, 6) AS average_confidence, round(average_latency_ms, 6) AS average_latency_ms, round(citation_valid_rate, 6) AS citation_valid_rate, p50_close, p95_close,
  (SELECT string_agg(verdict || '=' || n, ',' ORDER BY verdict) FROM (SELECT verdict, count(*) AS n FROM rl GROUP BY verdict)) AS verdicts, (SELECT string_agg(backend_used || '=' || n, ',' ORDER BY backend_used) FROM (SELECT backend_used, count(*) AS n FROM rl GROUP BY backend_used)) AS backends FROM a, p""")
def _(spark, sf):
    """The state's percentiles are compared with the log: they are close if at most a hundredth of it lies between."""
    log, folder = request_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), fresh_path(spark, "metrics")
    keep = lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/state-{i}")
    last = []
    _arriving(spark, log, "ts", folder, lambda s: state.drain(state.running_state(s), folder, mode="complete", batch=lambda df, i: (keep(df, i), last.append(i))))
    snap = state.snapshot(spark.read.parquet(f"{folder}/state-{last[-1]}"))
    close = lambda q: (F.abs(F.count_if(F.col("latency_ms") <= F.col(f"p{q}_latency_ms")) / F.count("*") - q / 100) <= 0.01).alias(f"p{q}_close")
    checked = log.crossJoin(F.broadcast(snap.select("p50_latency_ms", "p95_latency_ms"))).agg(close(50), close(95))
    listed = lambda c, name: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(name)
    rates = [F.round(c, 6).alias(c) for c in ("fallback_rate", "average_confidence", "average_latency_ms", "citation_valid_rate")]
    return snap.crossJoin(F.broadcast(checked)).select("requests", "fallbacks", *rates, "p50_close", "p95_close", listed("verdicts", "verdicts"), listed("backend_usage_counts", "backends"))


@query("s32_upserted_cache", "SELECT source AS title, doc_id, md5(text) AS extract FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1")
def _(spark, sf):
    """Pages arrive in several batches; each batch is sent twice, and the versions are folded half way."""
    folder = fresh_path(spark, "upsert")
    kept = UpsertTable(spark, f"{folder}/table", ("title",), ("doc_id",))
    pages = corpus(spark, sf).select("title", "doc_id", F.md5(F.col("text").cast("binary")).alias("extract"))

    def twice(df, i):
        kept.upsert(df, i)
        kept.upsert(df, i)

    def run(s):
        state.drain(s, folder, batch=twice)
        kept.compact()

    _arriving(spark, pages, "doc_id", folder, run)
    return kept.read()


# ---- the listwise ranker and positional joins


def held_out(column: str):
    """Queries that a ranker is not trained on."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 2 == 1


@query("k10_listwise_ranker")
def _(spark, sf):
    """Every query is scored, half of them by a ranker that never saw them; the ranker is the first of the probe order that can be trained."""
    rows = written(_features(spark, sf))
    train = listwise.training_rows(claims(spark, sf).where(~held_out("query_id")), rows)
    name, score = listwise.train_best(train)
    order = Window.partitionBy("query_id").orderBy(F.round("learned_score", 9).desc(), F.col("doc_id").cast("string"))
    return score(rows).select("query_id", "doc_id", "relevance", held_out("query_id").alias("held_out"), F.lit(name).alias("ranker"), F.round("learned_score", 6).alias("score"), F.row_number().over(order).alias("rank"))


@query("j13_zipped_predictions", """WITH t AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'SUPPORTED' ELSE 'REFUTED' END AS y_true, row_number() OVER (ORDER BY doc_id) AS place FROM labels), p AS (SELECT CASE length(text) % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NOT ENOUGH INFO' END AS y_pred, row_number() OVER (ORDER BY doc_id) AS place FROM documents)
SELECT place, doc_id, y_true, y_pred, y_true = y_pred AS correct FROM t JOIN p USING (place)""")
def _(spark, sf):
    n = F.length("text")
    true = tab(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, C.SUPPORTED).otherwise(C.REFUTED).alias("y_true"))
    pred = corpus(spark, sf).select("doc_id", F.when(n % 3 == 0, C.SUPPORTED).when(n % 3 == 1, C.REFUTED).otherwise(C.NEI).alias("y_pred"))
    zipped = zip_rows(true, pred.withColumnRenamed("doc_id", "of"), ["doc_id"], ["of"]).drop("of")
    return zipped.withColumn("correct", F.col("y_true") == F.col("y_pred"))


# ---- whole grids on verifier scores of the claims' own passages

_EIGHT, _MARGINS = [0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7], [0.0, 0.02, 0.05, 0.1]
_GATE_GRID = [i / 20 for i in range(13)]


def _passage_scores(spark, sf):
    """(query_id, y, claim, text, p, overlap, supported, refuted) of the first five passages: the rule's confidence in its verdict, the rest of it shared by the others."""
    labels = labelled_claims(spark, sf).select("query_id", F.col("label").alias("y"))
    verified = verify.verify_passages(claim_passages(spark, sf)).join(labels, "query_id")
    score = lambda label: F.when(F.col("result.verdict") == label, F.col("result.confidence")).otherwise((1 - F.col("result.confidence")) / 2)
    return verified.select("query_id", "y", "claim", "text", F.col("result.verdict").alias("p"), X.gate_overlap("claim", "text").alias("overlap"), score(C.SUPPORTED).alias("supported"), score(C.REFUTED).alias("refuted"))


def _pooled(spark, sf):
    return _passage_scores(spark, sf).groupBy("query_id", "y").agg(F.max("supported").alias("supported"), F.max("refuted").alias("refuted"))


def _full_grid(spark, sf):
    return grids.evaluate_grid(_pooled(spark, sf), grids.threshold_grid(spark, _EIGHT, _EIGHT, _MARGINS), with_margin=True)


_FULL = f"""WITH {_PRED}, sg AS (SELECT query_id, label AS y, max(CASE WHEN verdict = 'SUPPORTED' THEN confidence ELSE (1 - confidence) / 2 END) AS s, max(CASE WHEN verdict = 'REFUTED' THEN confidence ELSE (1 - confidence) / 2 END) AS r FROM pl JOIN lc USING (query_id) GROUP BY ALL),
g AS (SELECT row_number() OVER (ORDER BY m, s, r) - 1 AS grid_ord, s AS st, r AS rt, m FROM (SELECT unnest({_EIGHT})::DOUBLE AS s), (SELECT unnest({_EIGHT})::DOUBLE AS r), (SELECT unnest({_MARGINS})::DOUBLE AS m)),
e AS ({_sql_grid(_MARGIN).split(", e AS (")[1]}"""


@query("a38_full_grid", f"{_FULL} SELECT grid_ord::INT AS grid_ord, support_threshold, refute_threshold, margin, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(refuted_rate, 6) AS refuted_rate FROM ev")
def _(spark, sf):
    return _r(_full_grid(spark, sf), "grid_ord", "support_threshold", "refute_threshold", "margin")


@query("a39_full_argmax", f"{_FULL} SELECT grid_ord::INT AS grid_ord, round(macro_f1, 6) AS macro_f1 FROM ev ORDER BY round(macro_f1, 9) DESC, grid_ord LIMIT 1")
def _(spark, sf):
    return grids.best_row(_full_grid(spark, sf)).select("grid_ord", F.round("macro_f1", 6).alias("macro_f1"))


@query("a40_full_top10", f"{_FULL} SELECT grid_ord::INT AS grid_ord, round(macro_f1, 6) AS macro_f1 FROM ev ORDER BY round(macro_f1, 9) DESC, round(accuracy, 9) DESC, grid_ord LIMIT 10")
def _(spark, sf):
    return grids.top_rows(_full_grid(spark, sf)).select("grid_ord", F.round("macro_f1", 6).alias("macro_f1"))


_PAIR = {C.SUPPORTED: "SUPPORTS", C.REFUTED: "REFUTES", C.NEI: "NEI"}
_AS_PAIR = "CASE {x} WHEN 'SUPPORTED' THEN 'SUPPORTS' WHEN 'REFUTED' THEN 'REFUTES' ELSE 'NEI' END"
_GATED = f"""WITH {_PRED}, gp AS (SELECT {_AS_PAIR.format(x="label")} AS y, {_AS_PAIR.format(x="verdict")} AS p, {sql_overlap(_sql_content("claim"), _sql_content("pl.text"))} AS ov FROM pl JOIN lc USING (query_id)),
e AS (SELECT t, y, CASE WHEN ov < t THEN 'NEI' ELSE p END AS p FROM gp, (SELECT unnest({_GATE_GRID})::DOUBLE AS t)),
l AS (SELECT t, v, count(*) FILTER (y = v AND p = v) AS hit, count(*) FILTER (y = v) AS ny, count(*) FILTER (p = v) AS np FROM e, (SELECT unnest(['SUPPORTS', 'REFUTES', 'NEI']) AS v) GROUP BY ALL),
f AS (SELECT t, avg(CASE WHEN hit > 0 THEN 2.0::DOUBLE * hit / (ny + np) ELSE 0 END) FILTER (ny + np > 0) AS macro_f1 FROM l GROUP BY t),
ga AS (SELECT e.t AS threshold, round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy, round(max(macro_f1), 6) AS macro_f1 FROM e JOIN f ON f.t = e.t GROUP BY e.t)"""


@query("j16_all_gates", f"{_GATED} SELECT * FROM ga")
def _(spark, sf):
    name = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in _PAIR.items() for x in kv]), c)
    pairs = _passage_scores(spark, sf).select(name(F.col("y")).alias("y"), name(F.col("p")).alias("p"), "overlap")
    return grids.evaluate_gates(pairs, _GATE_GRID).select("threshold", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("a41_best_of_all_gates", f"{_GATED} SELECT threshold, macro_f1 FROM ga ORDER BY macro_f1 DESC, threshold LIMIT 1")
def _(spark, sf):
    return QUERIES["j16_all_gates"](spark, sf).orderBy(F.col("macro_f1").desc(), "threshold").select("threshold", "macro_f1").limit(1)


# ---- ranking features

def _sql_words_like(x: str, pattern: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\pL\pN_]+'), lambda t: regexp_full_match(t, '{pattern}'))"


def _sql_dates(x: str) -> str:
    months = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
    return f"list_distinct(list_concat({_sql_words_like(x, '[0-9]{4}')}, {_sql_words_like(x, months)}))"


@query("k05_cross_and_dates", f"{_CAND}, c3 AS (SELECT c2.*, {sql_jaccard(_sql_dates('c1.claim'), _sql_dates('c1.text'))} AS date_overlap FROM c2 JOIN c1 USING (query_id, ord)) SELECT query_id, ord, round(bm25_score, 6) AS cross_encoder_score, round(date_overlap, 6) AS date_overlap FROM c3")
def _(spark, sf):
    """The features that k05_ranking_features leaves out, but for numbers; no model is given, so the cross score is the evidence's own."""
    return _features(spark, sf).select("query_id", "ord", F.round("cross_encoder_score", 6).alias("cross_encoder_score"), F.round("date_overlap", 6).alias("date_overlap"))
