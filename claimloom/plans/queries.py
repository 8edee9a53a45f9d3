"""Registered queries of the engine's operators, each with DuckDB SQL where SQL can express it.

Claims are the benchmark passages, the corpus is the documents; a document is gold for a
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import citations as Q
from claimloom.functions import constants as C
from claimloom.functions import labels as L
from claimloom.functions import templates as T
from claimloom.functions import text as X
from claimloom.functions import vectors as V
from claimloom.operators import audit, builders, dedupe, grids, metrics, ranking, sampling, verify
from claimloom.operators import retrieval as R
from claimloom.operators.numbering import numbered_by
from claimloom.plans import api
from claimloom.plans import blocks as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


# ---- relations


def tab(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def claims(spark, sf) -> DataFrame:
    return tab(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def corpus(spark, sf) -> DataFrame:
    return R.spread(tab(spark, sf, "documents")).select(F.col("doc_id").alias("ord"), F.col("doc_id"), F.col("source").alias("title"), "text", "lang", "source")


def gold(spark, sf) -> DataFrame:
    return R.containing(claims(spark, sf), corpus(spark, sf))


def labelled_claims(spark, sf) -> DataFrame:
    """Claims with gold are supported or refuted in turn of their id; the rest are NEI."""
    hit = gold(spark, sf).select("query_id").distinct().withColumn("has", F.lit(1))
    label = F.when(F.col("has").isNull(), C.NEI).when(F.col("query_id") % 2 == 0, C.SUPPORTED).otherwise(C.REFUTED)
    return claims(spark, sf).join(hit, "query_id", "left").withColumn("label", label).drop("has")


def first_sentence_pairs(spark, sf) -> DataFrame:
    """Documents as (ord, claim, evidence): the first line against the rest."""
    d = corpus(spark, sf)
    cut = F.instr("text", "\n")
    return d.select("ord", F.when(cut > 0, F.substr("text", F.lit(1), cut - 1)).otherwise(F.col("text")).alias("claim"), F.when(cut > 0, F.substr("text", cut + 1)).otherwise("").alias("evidence"), "source", "lang", "text")


# ---- SQL building blocks


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def sql_space(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda t: t <> ''))"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


def sql_overlap(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({a}) ELSE 0.0 END)"


def sql_jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END)"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_FSP = "fsp AS (SELECT doc_id AS ord, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS claim, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS evidence, source, lang, text FROM documents)"
BASE = """
q AS (SELECT item_id AS query_id, text FROM benchmark),
d AS (SELECT doc_id AS ord, text, source, lang FROM documents),
gold AS (SELECT q.query_id, d.ord FROM q JOIN d ON contains(d.text, q.text)),
lc AS (SELECT q.query_id, q.text, CASE WHEN q.query_id NOT IN (SELECT query_id FROM gold) THEN 'NOT ENOUGH INFO' WHEN q.query_id % 2 = 0 THEN 'SUPPORTED' ELSE 'REFUTED' END AS label FROM q)"""
_TOK = sql_tokens("text")
BM25 = f"""{BASE},
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK}) AS term FROM q) GROUP BY ALL),
dl AS (SELECT ord, len({_TOK}) AS dl FROM d),
st AS (SELECT count(*) AS n_docs, CASE WHEN avg(dl) > 0 THEN avg(dl) ELSE 1.0 END AS avgdl FROM dl),
po AS (SELECT ord, term, count(*) AS tf FROM (SELECT ord, unnest({_TOK}) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
sc AS (SELECT query_id, ord, sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
       FROM qt JOIN po USING (term) JOIN df USING (term) JOIN dl USING (ord), st GROUP BY ALL)"""


def sql_topk(k: int, name: str = "top") -> str:
    return f"""
{name}_all AS (SELECT query_id, ord, max(score) AS score FROM (SELECT query_id, ord, score FROM sc UNION ALL SELECT query_id, f.ord, 0.0 FROM q, (SELECT ord FROM d ORDER BY ord LIMIT {k}) f) GROUP BY ALL),
{name} AS (SELECT query_id, ord, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM {name}_all QUALIFY rank <= {k})"""


_HASH = f"""
emb0 AS (SELECT side, id, p, sum(('0x' || substr(sha256(tok), 2 * p::INT + 1, 2))::INT / 255.0::DOUBLE - 0.5) AS v
  FROM (SELECT 'q' AS side, query_id AS id, unnest({_TOK}) AS tok FROM q UNION ALL SELECT 'd', ord, unnest({_TOK}) FROM d), (SELECT unnest(range(32)) AS p) GROUP BY ALL),
emb1 AS (SELECT side, id, sqrt(2 * sum(v * v)) AS n FROM emb0 GROUP BY ALL),
dn AS (SELECT a.id AS query_id, b.id AS ord, 2 * sum(a.v * b.v) / (max(x.n) * max(y.n)) AS s FROM emb0 a JOIN emb0 b ON a.p = b.p AND a.side = 'q' AND b.side = 'd' JOIN emb1 x ON x.side = 'q' AND x.id = a.id JOIN emb1 y ON y.side = 'd' AND y.id = b.id GROUP BY ALL),
dense_all AS (SELECT q.query_id, d.ord, coalesce(s, 0.0) AS score FROM q CROSS JOIN d LEFT JOIN dn ON dn.query_id = q.query_id AND dn.ord = d.ord)"""


def sql_dense(k: int) -> str:
    return f"dense AS (SELECT query_id, ord, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM dense_all QUALIFY rank <= {k})"


# ---- scans, normalisation


@query("s05_corpus_scan", "SELECT doc_id, trim(text, E' \\t\\n\\r') AS text_trimmed FROM documents WHERE trim(text, E' \\t\\n\\r') <> ''")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", X.strip("text").alias("text_trimmed")).where("text_trimmed <> ''")


@query("s08_literal_corpus", "SELECT CAST(item_id AS VARCHAR) AS doc_id, text, item_id AS ord FROM benchmark")
def _(spark, sf):
    return R.corpus_of(tab(spark, sf, "benchmark").withColumnRenamed("item_id", "ord"))


@query("s15_last_wins_cache", "SELECT source AS title, doc_id, md5(text) AS extract FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1")
def _(spark, sf):
    return dedupe.keep_first(corpus(spark, sf), ["title"], [F.col("ord").desc()]).select("title", "doc_id", F.md5(F.col("text").cast("binary")).alias("extract"))


@query("s16_uncached_titles", "SELECT DISTINCT lang AS title FROM documents WHERE lang NOT IN (SELECT lang FROM documents WHERE doc_id < 2)")
def _(spark, sf):
    d = corpus(spark, sf)
    cache = d.where("ord < 2").select(F.col("lang").alias("title"))
    return d.select(F.col("lang").alias("title")).distinct().join(cache, "title", "left_anti")


@query("s29_split_suffix", "SELECT source, count(*) AS n FROM documents WHERE suffix(source, '1') GROUP BY source")
def _(spark, sf):
    return corpus(spark, sf).where(F.endswith("source", F.lit("1"))).groupBy("source").agg(F.count("*").alias("n"))


@query("p10_eval_records", "SELECT item_id AS query_id, text FROM benchmark WHERE trim(text) <> '' ORDER BY item_id LIMIT 50")
def _(spark, sf):
    return claims(spark, sf).where(X.strip("text") != "").orderBy("query_id").limit(50)


@query("p11_gold_text", f"WITH {BASE} SELECT query_id, count(*) AS n_gold, md5(string_agg(trim(d.text, E' \\t\\n\\r'), ' ' ORDER BY d.ord)) AS gold_md5 FROM gold JOIN d USING (ord) GROUP BY query_id")
def _(spark, sf):
    g = gold(spark, sf).join(corpus(spark, sf).select("ord", "text"), "ord").groupBy("query_id").agg(F.count("*").alias("n_gold"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("evidence"))
    return g.select("query_id", "n_gold", F.md5(builders.gold_text(F.col("evidence")).cast("binary")).alias("gold_md5"))


@query("p16_index_text", "SELECT doc_id, md5(concat_ws(' ', nullif(trim(source), ''), nullif(trim(text, E' \\t\\n\\r'), ''))) AS index_md5 FROM documents")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", F.md5(X.index_text("title", "text").cast("binary")).alias("index_md5"))


@query("p20_request_checks", "SELECT item_id AS query_id, CASE WHEN length(trim(text)) = 0 THEN 'claim must not be empty' WHEN length(trim(text)) > 300 THEN 'claim must not exceed 300 characters' END AS error FROM benchmark")
def _(spark, sf):
    return api.check_request(claims(spark, sf), 5, 300).select("query_id", "error")


@query("p21_overlap_gate", f"WITH {BASE} SELECT query_id, ord, CASE WHEN {sql_overlap('a', 'b')} < 0.5 THEN 'NEI' ELSE 'SUPPORTS' END AS label FROM (SELECT query_id, ord, {sql_space('q.text')} AS a, {sql_space('d.text')} AS b FROM gold JOIN q USING (query_id) JOIN d USING (ord))")
def _(spark, sf):
    g = gold(spark, sf).join(claims(spark, sf).withColumnRenamed("text", "claim"), "query_id").join(corpus(spark, sf).select("ord", "text"), "ord")
    return g.select("query_id", "ord", verify.gated_label(F.lit("SUPPORTS"), X.overlap_of(X.space_tokens("claim"), X.space_tokens("text")), 0.5).alias("label"))


# ---- retrieval


@query("r01_tokenize", f"SELECT doc_id, len({_TOK}) AS n_tokens, md5(array_to_string({_TOK}, ' ')) AS tokens_md5 FROM documents")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", X.tokens("text").alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query("r02_bm25_index", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def _(spark, sf):
    return R.postings(corpus(spark, sf)).where("term <> ''").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("r02_corpus_stats", f"SELECT count(*) AS n_docs, round(avg(len({_TOK})), 6) AS avgdl FROM documents")
def _(spark, sf):
    return R.corpus_stats(corpus(spark, sf)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("r03_bm25_scores", f"WITH {BM25} SELECT query_id, ord, round(score, 6) AS score FROM sc")
def _(spark, sf):
    return R.bm25_scores(claims(spark, sf), corpus(spark, sf)).select("query_id", "ord", F.round("score", 6).alias("score"))


_OKAPI = BM25.replace("WHERE term IN (SELECT term FROM qt) GROUP BY ALL", "GROUP BY ALL").split("sc AS (")[0]


@query("r04_bm25_okapi_topk", f"""WITH {_OKAPI}
w0 AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, st), w AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM w0) ELSE raw END AS idf FROM w0),
sc AS (SELECT query_id, ord, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qt JOIN po USING (term) JOIN w USING (term) JOIN dl USING (ord), st GROUP BY ALL),
r AS (SELECT q.query_id, d.ord, coalesce(score, 0.0) AS score FROM q CROSS JOIN d LEFT JOIN sc ON sc.query_id = q.query_id AND sc.ord = d.ord)
SELECT query_id, ord, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM r QUALIFY rank <= 10""")
def _(spark, sf):
    return R.bm25_topk(claims(spark, sf), corpus(spark, sf), 10, variant="okapi").withColumn("score", F.round("score", 6))


@query("r05_bm25_topk", f"WITH {BM25}, {sql_topk(10)} SELECT query_id, ord, round(score, 6) AS score, rank FROM top")
def _(spark, sf):
    return R.bm25_topk(claims(spark, sf), corpus(spark, sf), 10).withColumn("score", F.round("score", 6))


@query("r06_hashing_embedding", f"WITH {BASE}, {_HASH.split('dn AS')[0].rstrip().rstrip(',')} SELECT id AS doc_id, p::INT AS pos, round(v / n, 6) + 0.0 AS value FROM emb0 JOIN emb1 USING (side, id) WHERE side = 'd'")
def _(spark, sf):
    e = R.with_embedding(corpus(spark, sf)).where(V.norm("vector") > 0).select("doc_id", F.posexplode(F.slice("vector", 1, 32)).alias("pos", "value"))
    return e.select("doc_id", "pos", F.round("value", 6).alias("value"))


@query("r11_cosine_to_centroid", """WITH e AS (SELECT vec_id, label, embedding FROM embeddings), c AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM e) GROUP BY ALL), v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM e)
SELECT vec_id, round(coalesce(sum(x * m) / nullif(sqrt(sum(x * x)) * sqrt(sum(m * m)), 0), 0), 6) AS cosine FROM v JOIN c USING (label, pos) GROUP BY vec_id""")
def _(spark, sf):
    e = tab(spark, sf, "embeddings")
    return e.join(_centroids(e), "label").select("vec_id", F.round(V.cosine("embedding", "vector"), 6).alias("cosine"))


def _centroids(e: DataFrame) -> DataFrame:
    means = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector"))


@query("r12_l2_normalize", "SELECT vec_id, pos - 1 AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)")
def _(spark, sf):
    return tab(spark, sf, "embeddings").select("vec_id", F.posexplode(V.l2_normalize("embedding")).alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("r13_dense_topk", f"WITH {BASE}, {_HASH}, {sql_dense(10)} SELECT query_id, ord, round(score, 6) AS score, rank FROM dense")
def _(spark, sf):
    return R.dense_topk(R.with_embedding(claims(spark, sf)), R.with_embedding(corpus(spark, sf)), 10).withColumn("score", F.round("score", 6))


@query("r14_rrf", f"WITH {BM25}, {sql_topk(10)}, {_HASH.replace('WITH', '')}, {sql_dense(10)}, u AS (SELECT query_id, ord, rank, 0 AS l FROM top UNION ALL SELECT query_id, ord, rank, 1 FROM dense), f AS (SELECT query_id, ord, sum(1.0::DOUBLE / (60 + rank)) AS score, min({{'l': l, 'r': rank}}) AS first FROM u GROUP BY ALL) SELECT query_id, ord, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first) AS fused_rank FROM f")
def _(spark, sf):
    q, d = claims(spark, sf), corpus(spark, sf)
    lists = [R.bm25_topk(q, d, 10), R.dense_topk(R.with_embedding(q), R.with_embedding(d), 10)]
    both = builders.union_all([x.withColumn("list_no", F.lit(i)) for i, x in enumerate(lists)])
    return R.rrf(both).withColumn("score", F.round("score", 9))


@query("r15_hybrid_topk", f"WITH {BM25}, {sql_topk(10)}, {_HASH}, {sql_dense(10)}, u AS (SELECT query_id, ord, rank, 0 AS l FROM top UNION ALL SELECT query_id, ord, rank, 1 FROM dense), f AS (SELECT query_id, ord, sum(1.0::DOUBLE / (60 + rank)) AS score, min({{'l': l, 'r': rank}}) AS first FROM u GROUP BY ALL) SELECT query_id, ord, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first) AS fused_rank FROM f QUALIFY fused_rank <= 5")
def _(spark, sf):
    return R.hybrid_topk(claims(spark, sf), corpus(spark, sf), 5).withColumn("score", F.round("score", 9))


#: Every channel of the hybrid profiles: BM25, dense, titles (t) and rewritten queries (e).
_CHANNELS = f"""{BASE}, {_HASH}, {sql_dense(10)}, {B.bm25("b", 10)}, {B.expansion()},
eq AS (SELECT {{'q': query_id, 'n': list_no}} AS query_id, text FROM ex), {B.bm25("e", 5, "eq")}, td AS (SELECT ord, coalesce(source, '') AS text FROM d)"""
_BASIC = ["SELECT query_id, ord, rank, 0 AS l FROM btop", "SELECT query_id, ord, rank, 1 FROM dense"]


@query("r15_hybrid_with_expansion", f"WITH {_CHANNELS}, {B.bm25('t', 5, docs='td')}, {B.rrf('hy', [*_BASIC, 'SELECT query_id, ord, rank, 2 FROM ttop', 'SELECT query_id.q, ord, rank, query_id.n + 3 FROM etop'], 5)} SELECT query_id, ord, round(score, 9) AS score, rank::INT AS fused_rank FROM hy")
def _(spark, sf):
    return R.hybrid_topk(claims(spark, sf), corpus(spark, sf), 5, title_k=5, expansion_k=5).withColumn("score", F.round("score", 9))


@query("r16_query_expansion", f"WITH q AS (SELECT item_id AS query_id, text FROM benchmark), {B.expansion()} SELECT query_id, list_no::INT AS list_no, text FROM ex")
def _(spark, sf):
    return R.expand_queries(claims(spark, sf))


@query("r17_vector_store_ip", """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), c AS (SELECT label, pos, avg(x) AS m FROM v GROUP BY ALL),
s AS (SELECT c.label AS query_id, v.vec_id AS ord, sum(x * m) AS score FROM v JOIN c USING (pos) GROUP BY ALL)
SELECT query_id, ord, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM s QUALIFY rank <= 5""")
def _(spark, sf):
    e = tab(spark, sf, "embeddings")
    found = R.dense_topk(_centroids(e).withColumnRenamed("label", "query_id"), e.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector")), 5, "ip")
    return found.withColumn("score", F.round("score", 6))


# ---- re-ranking


def _bm25_with_text(spark, sf, k=10) -> DataFrame:
    q, d = claims(spark, sf), corpus(spark, sf)
    return R.bm25_topk(q, d, k).join(q.withColumnRenamed("text", "claim"), "query_id").join(d.select("ord", "doc_id", "title", "text"), "ord")


_PAIRS = f"WITH {BM25}, {sql_topk(10)}, pr AS (SELECT top.query_id, top.ord, top.score, top.rank, q.text AS claim, d.text AS text, d.source AS title FROM top JOIN q USING (query_id) JOIN d USING (ord))"
_HEUR = f"(CASE WHEN len({sql_tokens('text')}) = 0 THEN 0.0 ELSE (CASE WHEN len(list_distinct({sql_tokens('claim')})) > 0 THEN len(list_intersect(list_distinct({sql_tokens('claim')}), {sql_tokens('text')}))::DOUBLE / len(list_distinct({sql_tokens('claim')})) ELSE 0.0 END) + len(list_intersect(list_distinct({sql_tokens('claim')}), {sql_tokens('text')}))::DOUBLE / len({sql_tokens('text')}) + (CASE WHEN contains(lower(text), lower(trim(claim))) THEN 1.0 ELSE 0.0 END) END)"


@query("k01_heuristic_rerank", f"{_PAIRS}, h AS (SELECT query_id, ord, {_HEUR} AS s FROM pr) SELECT query_id, ord, round(s, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, CAST(ord AS VARCHAR)) AS rerank_rank FROM h")
def _(spark, sf):
    return ranking.rerank(_bm25_with_text(spark, sf), ranking.heuristic_score("claim", "text")).select("query_id", "ord", F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank")


def _features(spark, sf) -> DataFrame:
    q, d = claims(spark, sf), corpus(spark, sf)
    # the gold is read twice, as a source and for relevance
    bm25, dense, g = R.bm25_topk(q, d, 10), R.dense_topk(R.with_embedding(q), R.with_embedding(d), 10), R.once(gold(spark, sf))
    goldrows = g.withColumn("rank", F.col("ord"))
    cand = ranking.candidates_with_scores([bm25, dense, goldrows], bm25, dense, g)
    cand = R.broadcast_if_small(R.once(cand.join(q.withColumnRenamed("text", "claim"), "query_id"))).join(d.select("ord", "doc_id", "text"), "ord")
    return cand.select("query_id", "doc_id", "ord", "relevance", "place", *ranking.ranking_features("claim", "text", F.col("bm25_score"), F.col("dense_score"), F.col("bm25_rank"), F.col("dense_rank"), evidence_score=F.col("bm25_score")))


_NUM = r"regexp_extract_all({x}, '\d+(?:\.\d+)?')"
_CAND = f"""WITH {BM25}, {sql_topk(10)}, {_HASH}, {sql_dense(10)},
c0 AS (SELECT query_id, ord FROM top UNION SELECT query_id, ord FROM dense UNION SELECT query_id, ord FROM gold),
c1 AS (SELECT c.query_id, c.ord, coalesce(t.score, 0.0) AS bm25_score, t.rank AS bm25_rank, coalesce(n.score, 0.0) AS dense_score, n.rank AS dense_rank, CASE WHEN g.ord IS NULL THEN 0 ELSE 1 END AS relevance, q.text AS claim, d.text
  FROM c0 c LEFT JOIN top t ON t.query_id = c.query_id AND t.ord = c.ord LEFT JOIN dense n ON n.query_id = c.query_id AND n.ord = c.ord LEFT JOIN (SELECT DISTINCT * FROM gold) g ON g.query_id = c.query_id AND g.ord = c.ord JOIN q ON q.query_id = c.query_id JOIN d ON d.ord = c.ord),
c2 AS (SELECT query_id, ord, relevance, bm25_score, dense_score, {sql_jaccard(f"list_distinct({sql_tokens('claim')})", f"list_distinct({sql_tokens('text')})")} AS lexical_overlap,
  len(list_distinct({sql_tokens('text')}))::DOUBLE AS evidence_length, len(list_distinct({sql_tokens('claim')}))::DOUBLE AS claim_length, coalesce(bm25_rank, 0)::DOUBLE AS bm25_rank_position, coalesce(dense_rank, 0)::DOUBLE AS dense_rank_position FROM c1)"""


@query("k05_ranking_features", f"{_CAND} SELECT query_id, ord, relevance, round(bm25_score, 6) AS bm25_score, round(dense_score, 6) AS dense_similarity_score, round(lexical_overlap, 6) AS lexical_overlap, evidence_length, claim_length, bm25_rank_position, dense_rank_position FROM c2")
def _(spark, sf):
    f = _features(spark, sf)
    r6 = lambda c: F.round(c, 6).alias(c)
    return f.select("query_id", "ord", "relevance", r6("bm25_score"), r6("dense_similarity_score"), r6("lexical_overlap"), "evidence_length", "claim_length", "bm25_rank_position", "dense_rank_position")


_SEVEN = ("bm25_score", "dense_similarity_score", "lexical_overlap", "evidence_length", "claim_length", "bm25_rank_position", "dense_rank_position")


@query("k11_linear_ranker", f"{_CAND.replace('bm25_score, dense_score, (CASE', 'bm25_score, dense_score AS dense_similarity_score, (CASE')} SELECT " + ", ".join(f"round(avg({f}) FILTER (relevance = 1) - avg({f}) FILTER (relevance = 0), 6) AS w_{f}" for f in _SEVEN) + " FROM c2")
def _(spark, sf):
    w = ranking.linear_ranker(_features(spark, sf), _SEVEN)
    return w.select(*[F.round(c, 6).alias(c) for c in w.columns])


@query("k13_ranking_strategies", f"{_CAND}, s AS (SELECT query_id, ord, relevance, unnest([{{'n': 'bm25', 's': bm25_score}}, {{'n': 'dense', 's': dense_score}}, {{'n': 'lexical', 's': lexical_overlap}}]) AS u FROM c2) SELECT query_id, u.n AS strategy, ord AS doc_id, relevance, row_number() OVER (PARTITION BY query_id, u.n ORDER BY round(u.s, 9) DESC, CAST(ord AS VARCHAR)) AS rank FROM s")
def _(spark, sf):
    return ranking.strategy_ranks(_features(spark, sf), {"bm25": F.col("bm25_score"), "dense": F.col("dense_similarity_score"), "lexical": F.col("lexical_overlap")})


@query("k10_logistic_ranker")
def _(spark, sf):
    f = _features(spark, sf).cache()
    model = ranking.train_ranker(f)
    from pyspark.ml.functions import vector_to_array

    return model.transform(f).select("query_id", "doc_id", F.round(vector_to_array("probability")[1], 3).alias("score"))


_PREF = f"""WITH {_FSP}, e AS (SELECT ord, '[1] ' || substr(evidence, 1, 200) AS told, evidence FROM fsp), {B.checked("SELECT ord AS key, " + B.trim("told || ' [1]'") + " AS told FROM e", "SELECT ord AS key, 1 AS id, evidence AS text FROM e")},
s AS (SELECT ord, valid, rate, len({B.words("told")}) AS n FROM e JOIN ck ON ck.key = e.ord),
pf AS (SELECT ord, 0 AS candidate, round_even(2.0::DOUBLE + CASE WHEN valid THEN 1.0 ELSE -1.0 END + CASE WHEN rate <= 0.25 THEN 1.0 ELSE -rate END + CASE WHEN n BETWEEN 1 AND 80 THEN 0.5 WHEN n > 80 THEN -0.25 ELSE 0.0 END, 4)::DOUBLE AS score, true AS valid_json, true AS verdict_matches, valid AS citation_valid, rate AS unsupported_sentence_rate, n::INT AS explanation_length FROM s
  UNION ALL SELECT ord, 1, -1.5, false, false, false, 1.0, 0 FROM fsp)"""


@query("k16_preference_scores", f"{_PREF} SELECT * FROM pf")
def _(spark, sf):
    p = first_sentence_pairs(spark, sf)
    ctx = F.array(F.struct(F.lit(1).alias("citation_id"), F.lit(None).cast("string").alias("title"), F.col("evidence").alias("text")))
    good = F.to_json(F.struct(F.lit("SUPPORTED").alias("verdict"), F.concat(F.lit("[1] "), F.substring("evidence", 1, 200)).alias("explanation"), F.array(F.lit("1")).alias("citations")))
    each = p.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("answer", F.when(F.col("candidate") == 0, good).otherwise(F.col("claim")))
    return each.select("ord", "candidate", ranking.preference_score("answer", F.lit("SUPPORTED"), ctx).alias("s")).select("ord", "candidate", "s.*")


@query("k17_best_candidate", f"{_PREF} SELECT ord, arg_max(candidate, {{'s': score, 'c': -candidate}})::INT AS candidate, max(score) AS score FROM pf GROUP BY ord")
def _(spark, sf):
    return ranking.best_candidate(QUERIES["k16_preference_scores"](spark, sf), "ord")


# ---- retrieval metrics

_IDCG = "(CASE WHEN {n} > 0 THEN list_sum(list_transform(range(1, {n} + 1), lambda i: 1.0 / log2(i + 1))) ELSE 1.0 END)"
_METRICS = f"""{BM25}, {sql_topk(50)}, g AS (SELECT DISTINCT * FROM gold), n AS (SELECT query_id, count(*)::INT AS n_rel FROM g GROUP BY ALL),
j AS (SELECT t.query_id, t.rank, CASE WHEN g.ord IS NULL THEN 0 ELSE 1 END AS rel FROM top t LEFT JOIN g ON g.query_id = t.query_id AND g.ord = t.ord),
j2 AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS seen FROM j),
m AS (SELECT query_id, sum(rel) FILTER (rank <= 1) AS h1, sum(rel) FILTER (rank <= 5) AS h5, sum(rel) FILTER (rank <= 10) AS h10, coalesce(sum(1.0 / log2(rank + 1)) FILTER (rel = 1 AND rank <= 10), 0) AS dcg, coalesce(1.0 / min(rank) FILTER (rel = 1), 0) AS rr, coalesce(sum(seen / rank) FILTER (rel = 1), 0) AS ps FROM j2 GROUP BY ALL),
pq AS (SELECT q.query_id, coalesce(n_rel, 0) AS n_rel, CASE WHEN n_rel > 0 THEN h1 / n_rel ELSE 0 END AS recall_1, CASE WHEN n_rel > 0 THEN h5 / n_rel ELSE 0 END AS recall_5, CASE WHEN n_rel > 0 THEN h10 / n_rel ELSE 0 END AS recall_10, CASE WHEN n_rel > 0 THEN dcg / {_IDCG.format(n='least(n_rel, 10)')} ELSE 0 END AS ndcg_10, rr, CASE WHEN n_rel > 0 THEN ps / n_rel ELSE 0 END AS ap FROM q LEFT JOIN m USING (query_id) LEFT JOIN n USING (query_id))"""
_R6 = ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in ("recall_1", "recall_5", "recall_10", "ndcg_10", "rr", "ap"))


def _per_query(spark, sf) -> DataFrame:
    q = claims(spark, sf)
    return metrics.per_query(R.bm25_topk(q, corpus(spark, sf), 50), gold(spark, sf), q, (1, 5, 10), (10,))


@query("a01_retrieval_metrics_per_query", f"WITH {_METRICS} SELECT query_id, n_rel, {_R6} FROM pq")
def _(spark, sf):
    m = _per_query(spark, sf)
    return m.select("query_id", "n_rel", *[F.round(c, 6).alias(c) for c in m.columns if c not in ("query_id", "n_rel")])


@query("a25_ranking_summary", f"WITH {_METRICS} SELECT count(*) AS n_queries, round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map FROM pq")
def _(spark, sf):
    s = metrics.summary(_per_query(spark, sf))
    return s.select("n_queries", *[F.round(c, 6).alias(c) for c in s.columns if c != "n_queries"])


# ---- classification, calibration, audits

_LAB = "lab AS (SELECT l.doc_id, l.quality::INT AS y, CASE WHEN length(d.text) - length(replace(d.text, '!!', '')) > 8 OR d.text LIKE '% | %' THEN 0 ELSE 1 END AS p, (length(d.text) % 101) / 100.0::DOUBLE AS confidence, d.source, d.lang FROM labels l JOIN documents d USING (doc_id))"


def labelled(spark, sf) -> DataFrame:
    """Quality labels, a rule's predictions and a made-up confidence of the labelled documents."""
    d = tab(spark, sf, "labels").join(tab(spark, sf, "documents"), "doc_id")
    marks = F.length("text") - F.length(F.replace("text", F.lit("!!"), F.lit("")))
    p = F.when((marks > 8) | F.contains("text", F.lit(" | ")), 0).otherwise(1)
    return d.select("doc_id", F.col("quality").cast("int").alias("y"), p.alias("p"), ((F.length("text") % 101) / F.lit(100.0)).alias("confidence"), "source", "lang")


_CELLS = f"{_LAB}, cells AS (SELECT y, p, count(*) AS n FROM lab GROUP BY ALL), ls AS (SELECT DISTINCT y AS label FROM lab UNION SELECT DISTINCT p FROM lab), pc AS (SELECT label, coalesce(sum(n) FILTER (y = label AND p = label), 0)::DOUBLE AS tp, coalesce(sum(n) FILTER (y = label), 0)::BIGINT AS support, coalesce(sum(n) FILTER (p = label), 0)::BIGINT AS predicted FROM ls, cells GROUP BY label)"
_F1 = "CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (predicted + support) ELSE 0 END"


@query("a07_accuracy", f"WITH {_LAB} SELECT count(*) AS n, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lab")
def _(spark, sf):
    return metrics.accuracy(labelled(spark, sf)).select("n", F.round("accuracy", 6).alias("accuracy"))


@query("a08_per_class_f1", f"WITH {_CELLS} SELECT label, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6)::DOUBLE AS recall, round({_F1}, 6)::DOUBLE AS f1, support FROM pc")
def _(spark, sf):
    return metrics.per_class(labelled(spark, sf)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("a09_macro_f1", f"WITH {_CELLS} SELECT round(avg({_F1}), 6) AS macro_f1 FROM pc")
def _(spark, sf):
    return metrics.macro_f1(labelled(spark, sf)).select(F.round("macro_f1", 6).alias("macro_f1"))


@query("a10_confusion_matrix", f"WITH {_CELLS} SELECT a.label AS y, b.label AS p, coalesce(n, 0)::BIGINT AS n FROM ls a CROSS JOIN ls b LEFT JOIN cells c ON c.y = a.label AND c.p = b.label")
def _(spark, sf):
    return metrics.confusion(labelled(spark, sf))


_EDGES = "edges(bin, lower, upper) AS (VALUES " + ", ".join(f"({i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, (lo, hi) in enumerate(metrics.bin_edges(10))) + ")"
_BINS = f"{_LAB}, {_EDGES}, bins AS (SELECT e.bin, e.lower, e.upper, count(y) AS n, coalesce(avg(CASE WHEN y = p THEN 1.0::DOUBLE WHEN y IS NOT NULL THEN 0.0 END), 0) AS accuracy, coalesce(avg(l.confidence), 0) AS confidence FROM edges e LEFT JOIN lab l ON l.confidence >= e.lower AND (l.confidence < e.upper OR (e.upper = 1.0 AND l.confidence = 1.0)) GROUP BY ALL)"


@query("a12_expected_calibration_error", f"WITH {_BINS} SELECT round(sum(abs(accuracy - confidence) * n / (SELECT count(*) FROM lab)), 6) AS ece FROM bins")
def _(spark, sf):
    rows = labelled(spark, sf).withColumn("correct", F.col("y") == F.col("p"))
    return metrics.expected_calibration_error(rows).select(F.round("ece", 6).alias("ece"))


@query("a13_calibration_bins", f"WITH {_BINS} SELECT bin, lower, upper, n, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence FROM bins")
def _(spark, sf):
    rows = labelled(spark, sf).withColumn("correct", F.col("y") == F.col("p"))
    return metrics.calibration_bins(rows).select("bin", "lower", "upper", "n", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"))


def _sql_any(x, words):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_CATEGORY = f"CASE WHEN {_sql_any('lower(text)', C.NEGATIONS)} THEN 'negation' WHEN regexp_matches(text, '\\p{{Nd}}') THEN 'numerical' WHEN {_sql_any('lower(text)', C.MONTHS)} THEN 'temporal' WHEN {_sql_any('lower(text)', C.QUESTION_WORDS)} THEN 'entity' WHEN {_sql_any('lower(text)', C.CAUSAL_WORDS)} THEN 'possible multi-hop' ELSE 'entity' END"


@query("a15_claim_category", f"SELECT conv_id, turn, {_CATEGORY} AS category FROM conversations")
def _(spark, sf):
    return tab(spark, sf, "conversations").select("conv_id", "turn", X.claim_category("text").alias("category"))


@query("a16_category_counts", f"SELECT {_CATEGORY} AS category, count(*) AS n FROM conversations GROUP BY ALL")
def _(spark, sf):
    return audit.histogram(tab(spark, sf, "conversations"), X.claim_category("text"), "category")




@query("a17_quality_audit", f"WITH {_FSP} SELECT count(*) AS n, count(*) - count(DISTINCT claim) AS duplicate_claims, count(*) FILTER (evidence = '') AS missing_evidence, round(coalesce(avg(len({sql_words('claim')})) FILTER (claim <> ''), 0), 6) AS average_claim_length, round(coalesce(avg(len({sql_words('evidence')})) FILTER (evidence <> ''), 0), 6) AS average_evidence_length FROM fsp")
def _(spark, sf):
    a = audit.quality_audit(first_sentence_pairs(spark, sf))
    return a.select("n", "duplicate_claims", "missing_evidence", F.round("average_claim_length", 6).alias("average_claim_length"), F.round("average_evidence_length", 6).alias("average_evidence_length"))


@query("a19_grouped_histograms", "SELECT 'source' AS \"column\", source AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY ALL")
def _(spark, sf):
    return audit.group_histograms(tab(spark, sf, "documents"), ["source", "lang"])


@query("a22_zero_filled_histogram", f"WITH {BASE} SELECT v.value, count(lc.label) AS n FROM (VALUES ('SUPPORTED'), ('REFUTED'), ('NOT ENOUGH INFO'), ('OTHER')) v(value) LEFT JOIN lc ON lc.label = v.value GROUP BY ALL")
def _(spark, sf):
    return audit.filled_histogram(labelled_claims(spark, sf), "label", (*C.LABELS, "OTHER"))


_PRED = f"""{BM25}, {sql_topk(5)}, pp AS (SELECT top.query_id, top.rank, q.text AS claim, d.text AS text, {sql_space('q.text')} AS ct, {sql_space('d.text')} AS et FROM top JOIN q USING (query_id) JOIN d USING (ord)),
pv AS (SELECT query_id, rank, claim, text, {sql_overlap('ct', 'et')} AS ov, CASE WHEN list_contains(et, 'not') AND len(list_intersect(ct, et)) > 0 THEN 'REFUTED' WHEN {sql_overlap('ct', 'et')} >= 0.45 THEN 'SUPPORTED' ELSE 'NOT ENOUGH INFO' END AS verdict FROM pp),
pl AS (SELECT *, least(0.99, 0.45 + ov / 2) AS confidence, CASE WHEN verdict = 'SUPPORTED' THEN 0.7 ELSE 0.1 END::DOUBLE AS s, CASE WHEN verdict = 'REFUTED' THEN 0.7 ELSE 0.1 END::DOUBLE AS r, CASE WHEN verdict = 'NOT ENOUGH INFO' THEN 0.7 ELSE 0.1 END::DOUBLE AS n FROM pv),
ag AS (SELECT query_id, max(s) AS s, max(r) AS r, max(n) AS n FROM pl GROUP BY ALL),
ve AS (SELECT query_id, s, r, n, CASE WHEN s >= 0.5 AND s > r THEN 'SUPPORTED' WHEN r >= 0.5 AND r > s THEN 'REFUTED' ELSE 'NOT ENOUGH INFO' END AS verdict, CASE WHEN s >= 0.5 AND s > r THEN s WHEN r >= 0.5 AND r > s THEN r ELSE greatest(n, 1 - greatest(s, r)) END AS confidence FROM ag)"""


def claim_passages(spark, sf, k: int = 5) -> DataFrame:
    q, d = claims(spark, sf), corpus(spark, sf)
    return api.evidence_for(q, d, k).join(q.withColumnRenamed("text", "claim"), "query_id")


def predictions(spark, sf) -> DataFrame:
    """(query_id, y, p, confidence) of the rule verifier over the top five passages."""
    got = verify.aggregate_claims(verify.verify_passages(claim_passages(spark, sf)))
    return labelled_claims(spark, sf).select("query_id", F.col("label").alias("y")).join(got.select("query_id", F.col("verdict").alias("p"), "confidence"), "query_id")


@query("a29_verifier_evaluation", f"WITH {_PRED}, e AS (SELECT lc.label AS y, ve.verdict AS p, confidence FROM lc JOIN ve USING (query_id)) SELECT y, p, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM e GROUP BY ALL")
def _(spark, sf):
    return predictions(spark, sf).groupBy("y", "p").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("a30_nei_false_positive_rate", f"WITH {_PRED} SELECT round(coalesce(count(*) FILTER (label = 'NOT ENOUGH INFO' AND verdict <> 'NOT ENOUGH INFO')::DOUBLE / nullif(count(*) FILTER (label = 'NOT ENOUGH INFO'), 0), 0), 6) AS nei_fpr FROM lc JOIN ve USING (query_id)")
def _(spark, sf):
    return metrics.nei_false_positive_rate(predictions(spark, sf)).select(F.round("nei_fpr", 6).alias("nei_fpr"))


@query("a33_outcome_contingency", f"WITH {_LAB}, f AS (SELECT y = p AS a_ok, confidence >= 0.5 AS b_ok FROM lab) SELECT g.a_ok, g.b_ok, count(f.a_ok) AS n, round(count(f.a_ok)::DOUBLE / (SELECT count(*) FROM f), 6) AS rate FROM (VALUES (true, true), (true, false), (false, true), (false, false)) g(a_ok, b_ok) LEFT JOIN f ON f.a_ok = g.a_ok AND f.b_ok = g.b_ok GROUP BY ALL")
def _(spark, sf):
    rows = labelled(spark, sf).select((F.col("y") == F.col("p")).alias("a_ok"), (F.col("confidence") >= 0.5).alias("b_ok"))
    return metrics.contingency(rows, "a_ok", "b_ok").withColumn("rate", F.round("rate", 6))


@query("a36_per_dataset_accuracy", f"WITH {_LAB} SELECT source, count(*) AS n, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lab GROUP BY source")
def _(spark, sf):
    return metrics.accuracy(labelled(spark, sf), ("source",)).withColumn("accuracy", F.round("accuracy", 6))


@query("a37_overall_and_per_source", f"WITH {_LAB} SELECT source, grouping(source) = 1 AS overall, count(*) AS n, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lab GROUP BY ROLLUP (source)")
def _(spark, sf):
    return audit.overall_and_by(labelled(spark, sf), "source", [F.count("*").alias("n"), F.round(F.avg((F.col("y") == F.col("p")).cast("double")), 6).alias("accuracy")])


@query("a44_class_weights", "SELECT quality, count(*) AS n, round((SELECT count(*) FROM labels)::DOUBLE / (2 * count(*)), 6) AS weight FROM labels GROUP BY quality")
def _(spark, sf):
    return metrics.class_weights(tab(spark, sf, "labels"), "quality", 2).withColumn("weight", F.round("weight", 6))


_POINTS = "pts AS (SELECT 'm' || p_partkey AS model, p_retailprice / 2500.0::DOUBLE AS macro_f1, p_size::DOUBLE AS latency_ms, (p_partkey % 97)::DOUBLE AS memory_mb, greatest(0, 1 - p_size / 1000.0::DOUBLE - (p_partkey % 97) / 500.0::DOUBLE) AS deployment_feasibility FROM part)"


def points(spark, sf) -> DataFrame:
    p = tab(spark, sf, "part")
    latency, memory = F.col("p_size").cast("double"), (F.col("p_partkey") % 97).cast("double")
    return p.select(F.concat(F.lit("m"), F.col("p_partkey")).alias("model"), (F.col("p_retailprice") / F.lit(2500.0)).alias("macro_f1"), latency.alias("latency_ms"), memory.alias("memory_mb"), grids.feasibility(latency, memory).alias("deployment_feasibility"))


_DOMINATED = "EXISTS (SELECT 1 FROM pts o WHERE o.macro_f1 >= p.macro_f1 AND o.latency_ms <= p.latency_ms AND o.memory_mb <= p.memory_mb AND o.deployment_feasibility >= p.deployment_feasibility AND (o.macro_f1 > p.macro_f1 OR o.latency_ms < p.latency_ms OR o.memory_mb < p.memory_mb OR o.deployment_feasibility > p.deployment_feasibility))"


@query("a46_pareto_frontier", f"WITH {_POINTS} SELECT model, macro_f1, latency_ms, memory_mb FROM pts p WHERE NOT {_DOMINATED}")
def _(spark, sf):
    return grids.pareto_frontier(points(spark, sf)).select("model", "macro_f1", "latency_ms", "memory_mb")


@query("a45_pareto_report", f"WITH {_POINTS} SELECT model, NOT {_DOMINATED} AS frontier, row_number() OVER (ORDER BY macro_f1 DESC, latency_ms, memory_mb, model) AS place FROM pts p")
def _(spark, sf):
    return grids.pareto_report(points(spark, sf)).select("model", "frontier", "place")


@query("a48_feasibility", f"WITH {_POINTS} SELECT model, round(deployment_feasibility, 6) AS feasibility FROM pts")
def _(spark, sf):
    return points(spark, sf).select("model", F.round("deployment_feasibility", 6).alias("feasibility"))


@query("a49_paired_bootstrap", """WITH s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, quality::DOUBLE AS a, toxic::DOUBLE AS b FROM labels), n AS (SELECT count(*) AS n FROM s),
dr AS (SELECT i // n AS it, ('0x' || substr(md5('42|' || i), 1, 8))::BIGINT % n AS place FROM n, (SELECT unnest(range((SELECT n FROM n) * 200)) AS i)),
d AS (SELECT it, sum(b) / (SELECT n FROM n) - sum(a) / (SELECT n FROM n) AS d FROM dr JOIN s USING (place) GROUP BY it), r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM d)
SELECT round((SELECT avg(a) FROM s), 6) AS mean_a, round((SELECT avg(b) FROM s), 6) AS mean_b, round((SELECT avg(b) - avg(a) FROM s), 6) AS delta, round(max(d) FILTER (i = 5), 6) AS ci_low, round(max(d) FILTER (i = 194), 6) AS ci_high FROM r""")
def _(spark, sf):
    pairs = tab(spark, sf, "labels").select(F.col("doc_id").alias("ord"), F.col("quality").cast("double").alias("a"), F.col("toxic").cast("double").alias("b"))
    out = sampling.bootstrap(pairs, 200)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("a50_nearest_rank_percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) FILTER (i = round_even(0.5 * (n - 1), 0)::INT) AS p50, max(value) FILTER (i = round_even(0.95 * (n - 1), 0)::INT) AS p95 FROM r GROUP BY event_type")
def _(spark, sf):
    return metrics.nearest_rank_percentiles(tab(spark, sf, "events"), "value", (50.0, 95.0), ("event_type",))


_LOG = "rl AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NOT ENOUGH INFO' END AS verdict, (event_id % 100) / 100.0::DOUBLE AS confidence, event_id % 7 = 0 AS fallback_used, value AS latency_ms, event_type AS backend_used, event_id % 5 <> 0 AS citation_valid FROM events)"


def request_log(spark, sf) -> DataFrame:
    """The events read as a log of verification requests."""
    e, i = tab(spark, sf, "events"), F.col("event_id")
    return e.select("event_id", "ts", F.when(i % 3 == 0, C.SUPPORTED).when(i % 3 == 1, C.REFUTED).otherwise(C.NEI).alias("verdict"), ((i % 100) / F.lit(100.0)).alias("confidence"), (i % 7 == 0).alias("fallback_used"), F.col("value").alias("latency_ms"), F.col("event_type").alias("backend_used"), (i % 5 != 0).alias("citation_valid"))


_REQ = "count(*) AS n_requests, round(avg(CASE WHEN fallback_used THEN 1.0 ELSE 0.0 END), 6) AS fallback_rate, round(avg(CASE WHEN citation_valid THEN 1.0 ELSE 0.0 END), 6) AS citation_valid_rate, round(avg(confidence), 6) AS mean_confidence, round(avg(latency_ms), 6) AS mean_latency_ms, count(*) FILTER (verdict = 'SUPPORTED') AS n_supported, count(*) FILTER (verdict = 'REFUTED') AS n_refuted, count(*) FILTER (verdict = 'NOT ENOUGH INFO') AS n_not_enough_info"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


@query("a51_request_metrics", f"WITH {_LOG} SELECT backend_used, {_REQ} FROM rl GROUP BY backend_used")
def _(spark, sf):
    return _rounded(audit.request_metrics(request_log(spark, sf), ("backend_used",)), "backend_used")


_PROFILE = f"WITH {_LAB}, pr AS (SELECT min(doc_id) AS ord, source AS profile, avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy, avg(confidence) AS confidence FROM lab GROUP BY source), b AS (SELECT * FROM pr WHERE profile = 'src0')"


@query("a56_profile_deltas", f"{_PROFILE} SELECT pr.ord, pr.profile, round(pr.accuracy, 6) AS accuracy, round(pr.confidence, 6) AS confidence, round(pr.accuracy - b.accuracy, 6) AS delta_accuracy, round(pr.confidence - b.confidence, 6) AS delta_confidence, row_number() OVER (ORDER BY round(pr.accuracy, 9) DESC, pr.ord) = 1 AS best FROM pr, b")
def _(spark, sf):
    pr = labelled(spark, sf).groupBy(F.col("source").alias("profile")).agg(F.min("doc_id").alias("ord"), F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"))
    return _rounded(grids.deltas(pr, "src0", ["accuracy", "confidence"]), "ord", "profile")


@query("a57_long_report", f"WITH {_LAB}, pr AS (SELECT source, count(*)::DOUBLE AS n, avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy FROM lab GROUP BY source) SELECT 'quality' AS report, source || '.n' AS path, n AS value FROM pr UNION ALL SELECT 'quality', source || '.accuracy', round(accuracy, 6) FROM pr")
def _(spark, sf):
    return audit.long_report(_rounded(metrics.accuracy(labelled(spark, sf), ("source",)), "source"), "quality", ["source"])


@query("a59_first_errors", f"WITH {_LAB} SELECT doc_id, y, p FROM lab WHERE y <> p ORDER BY doc_id LIMIT 20")
def _(spark, sf):
    return labelled(spark, sf).where("y <> p").orderBy("doc_id").limit(20).select("doc_id", "y", "p")


@query("a60_variant_gap", f"WITH {_LAB}, v AS (SELECT y, unnest([{{'v': 'rule', 'p': p}}, {{'v': 'constant', 'p': 1}}]) AS u FROM lab) SELECT u.v AS variant, count(*) AS n, round(avg(CASE WHEN y = u.p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM v GROUP BY ALL")
def _(spark, sf):
    each = F.explode(F.array(F.struct(F.lit("rule").alias("variant"), F.col("p").alias("p")), F.struct(F.lit("constant").alias("variant"), F.lit(1).alias("p"))))
    long = labelled(spark, sf).select("y", each.alias("e")).select("y", "e.*")
    return metrics.accuracy(long, ("variant",)).withColumn("accuracy", F.round("accuracy", 6))


# ---- windows, sampling, de-duplication


@query("w05_keep_first", "SELECT min(doc_id) AS ord, md5(text) AS text_md5 FROM documents GROUP BY text")
def _(spark, sf):
    return dedupe.keep_first(corpus(spark, sf), ["text"], ["ord"]).select("ord", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("w06_split_priority", "SELECT doc_id AS ord, CASE doc_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM documents QUALIFY row_number() OVER (PARTITION BY text, lang, source ORDER BY CASE doc_id % 3 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END, doc_id) = 1")
def _(spark, sf):
    d = corpus(spark, sf).select("ord", F.col("text").alias("claim"), F.col("lang").alias("evidence"), F.col("source").alias("label"), F.when(F.col("ord") % 3 == 0, "test").when(F.col("ord") % 3 == 1, "val").otherwise("train").alias("split"))
    return dedupe.drop_across_splits(d, ["train", "val", "test"]).select("ord", "split")


@query("w07_round_robin", "WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER w AS rn, min(o_orderkey) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS first FROM orders WINDOW w AS (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey)) SELECT o_orderkey AS ord, row_number() OVER (ORDER BY rn, first) AS turn FROM r ORDER BY rn, first LIMIT 100")
def _(spark, sf):
    o = tab(spark, sf, "orders").withColumnRenamed("o_orderkey", "ord")
    return sampling.round_robin(o, ["o_orderstatus", "o_orderpriority"], 100).select("ord", "turn")


@query("w08_cyclic_assignment", "SELECT item_id AS query_id, " + sql_list(C.REJECTIONS) + "[(row_number() OVER (ORDER BY item_id) - 1) % 7 + 1] AS rejection_type FROM benchmark")
def _(spark, sf):
    return numbered_by(claims(spark, sf), "query_id").select("query_id", sampling.cyclic(list(C.REJECTIONS), F.col("rn") - 1).alias("rejection_type"))


@query("w13_seeded_sample", "SELECT doc_id FROM documents ORDER BY sha256('42|' || doc_id), doc_id LIMIT 100")
def _(spark, sf):
    return sampling.sample(corpus(spark, sf), 100, "doc_id").select("doc_id")


@query("w14_seeded_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('7|' || doc_id), doc_id) <= 150 THEN 'val' ELSE 'train' END AS split FROM documents")
def _(spark, sf):
    return sampling.split(corpus(spark, sf), 150, "doc_id", 7).select("doc_id", "split")


@query("d03_near_duplicates", f"""WITH s AS (SELECT min(doc_id) AS rep, toks FROM (SELECT doc_id, list_sort({sql_space('text')}) AS toks FROM documents) GROUP BY toks), f AS (SELECT rep, len(toks) AS n, unnest(toks) AS tok FROM s),
i AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared, max(a.n) AS na, max(b.n) AS nb FROM f a JOIN f b ON a.tok = b.tok AND a.rep < b.rep AND least(a.n, b.n) >= greatest(a.n, b.n) * 0.9 - 1e-9 GROUP BY ALL)
SELECT a, b, round(shared::DOUBLE / (na + nb - shared), 6) AS similarity FROM i WHERE shared::DOUBLE / (na + nb - shared) >= 0.9""")
def _(spark, sf):
    return dedupe.near_duplicate_pairs(corpus(spark, sf), 0.9).withColumn("similarity", F.round("similarity", 6))


@query("d03_membership", f"SELECT doc_id AS ord, min(doc_id) OVER (PARTITION BY list_sort({sql_space('text')})) AS rep FROM documents")
def _(spark, sf):
    return dedupe.membership(corpus(spark, sf))


@query("d05_assemble_corpus", "WITH u AS (SELECT 0 AS s, item_id AS ord, CAST(item_id AS VARCHAR) AS doc_id, text FROM benchmark UNION ALL SELECT 1, doc_id, CAST(doc_id AS VARCHAR), text FROM documents) SELECT doc_id, ord, md5(text) AS text_md5 FROM u WHERE trim(text, E' \\t\\n\\r') <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s, ord) = 1")
def _(spark, sf):
    a = R.corpus_of(tab(spark, sf, "benchmark").withColumnRenamed("item_id", "ord"))
    b = R.corpus_of(tab(spark, sf, "documents").withColumnRenamed("doc_id", "ord"))
    return dedupe.assemble_corpus([a, b]).select("doc_id", "ord", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_LINES = "ln AS (SELECT doc_id, b, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), LATERAL (SELECT " + "trim(regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '" + C.MARKERS + "', ''))" + " AS b) WHERE b <> ''), cb AS (SELECT doc_id, lower(b) AS k, arg_min(b, i) AS b FROM ln GROUP BY ALL)"


@query("d09_canonical_blocks", f"WITH {_LINES} SELECT d.doc_id, count(cb.k)::INT AS n_blocks, md5(coalesce(string_agg(cb.b, chr(10) ORDER BY cb.k), '')) AS blocks_md5 FROM documents d LEFT JOIN cb ON cb.doc_id = d.doc_id GROUP BY d.doc_id")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", X.canonical_blocks(X.evidence_blocks("text")).alias("b")).select("doc_id", F.size("b").alias("n_blocks"), F.md5(F.array_join("b", "\n").cast("binary")).alias("blocks_md5"))


# ---- functions


@query("f01_chunks", f"WITH w AS (SELECT doc_id, {sql_words('text')} AS k FROM documents), s AS (SELECT doc_id, k, unnest(range(0, greatest(len(k) - 33, 0)::BIGINT + 1, 224)) AS st FROM w WHERE len(k) > 0) SELECT doc_id, (st // 224)::INT AS chunk, md5(array_to_string(k[st + 1 : st + 256], ' ')) AS chunk_md5 FROM s")
def _(spark, sf):
    c = corpus(spark, sf).select("doc_id", F.posexplode(X.chunks("text")).alias("chunk", "t"))
    return c.select("doc_id", "chunk", F.md5(F.col("t").cast("binary")).alias("chunk_md5"))


@query("f03_sentences", "SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda x: trim(x, E' \\t\\n\\r')), lambda x: x <> '') AS s FROM documents)")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", X.sentences("text").alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("sentences_md5"))


_CTX1 = "SELECT ord AS key, 1 AS id, evidence AS text FROM fsp WHERE evidence <> ''"
_TOLD8 = "SELECT ord AS key, '[1] ' || claim || CASE WHEN ord % 2 = 0 THEN ' [7] And more.' ELSE '; [1] so it is.' END AS told FROM fsp WHERE evidence <> ''"


@query("f08_citation_check", f"WITH {_FSP}, {B.checked(_TOLD8, _CTX1)} SELECT key AS ord, round(precision, 6) AS citation_precision, round(rate, 6) AS unsupported_sentence_rate, precision >= 0.5 AND rate <= 0.5 AS verdict_consistency, valid, array_to_string(missing, ',') AS missing FROM ck")
def _(spark, sf):
    p = first_sentence_pairs(spark, sf).where("evidence <> ''")
    ctx = F.array(F.struct(F.lit(1).alias("citation_id"), F.lit(None).cast("string").alias("title"), F.col("evidence").alias("text")))
    told = F.concat(F.lit("[1] "), F.col("claim"), F.when(F.col("ord") % 2 == 0, " [7] And more.").otherwise("; [1] so it is."))
    return p.select("ord", Q.check_citations(told, ctx).alias("c")).select("ord", F.round("c.citation_precision", 6).alias("citation_precision"), F.round("c.unsupported_sentence_rate", 6).alias("unsupported_sentence_rate"), "c.verdict_consistency", "c.valid", F.array_join("c.missing_citations", ",").alias("missing"))


_MARK = r"(?i)^(?:(?:\[(?:E?\d+)\]|passage\s+\d+\s*:|evidence\s+[a-z]\s*:)\s*|[-*•]\s+)+"


def _sql_clean(x: str) -> str:
    return f"trim(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '{_MARK}', ''))"


@query("f09_clean_block", f"SELECT item_id, {_sql_clean(chr(39) + ' - [E2]  Passage 3 : ' + chr(39) + ' || text')} AS cleaned FROM benchmark")
def _(spark, sf):
    return tab(spark, sf, "benchmark").select("item_id", X.clean_block(F.concat(F.lit(" - [E2]  Passage 3 : "), F.col("text"))).alias("cleaned"))


@query("f11_sanitize", f"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_sql_clean('x')}), lambda x: x <> ''), chr(10))) AS sanitized_md5 FROM documents")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", F.md5(X.sanitize("text").cast("binary")).alias("sanitized_md5"))


@query("f12_verifier_text", f"WITH {_FSP}, ln AS (SELECT ord, b, i FROM (SELECT ord, unnest(string_split(evidence, chr(10))) AS raw, generate_subscripts(string_split(evidence, chr(10)), 1) AS i FROM fsp), LATERAL (SELECT {_sql_clean('raw')} AS b) WHERE b <> ''), cb AS (SELECT ord, lower(b) AS k, arg_min(b, i) AS b FROM ln GROUP BY ALL) SELECT f.ord, md5('Claim: ' || any_value(f.claim) || chr(10) || 'Evidence: ' || coalesce(string_agg(cb.b, chr(10) ORDER BY cb.k), '')) AS input_md5 FROM fsp f LEFT JOIN cb ON cb.ord = f.ord GROUP BY f.ord")
def _(spark, sf):
    return first_sentence_pairs(spark, sf).select("ord", F.md5(X.verifier_text("claim", "evidence").cast("binary")).alias("input_md5"))


@query("f15_evidence_style", "SELECT item_id, ['plain', 'passage', 'evidence_letter', 'bullet', 'bracket'][(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c)))::BIGINT % 5 + 1)::INT] AS style FROM benchmark")
def _(spark, sf):
    return tab(spark, sf, "benchmark").select("item_id", X.evidence_style("text").alias("style"))


_RENDER = f"""{BM25}, {sql_topk(5)}, rb AS (SELECT query_id, rank, {B.clean("d.text")} AS x, {B.clean("coalesce(d.source, '')")} AS t FROM top JOIN d USING (ord)),
rk AS (SELECT * FROM rb WHERE x <> '' QUALIFY row_number() OVER (PARTITION BY query_id, lower(t), lower(x) ORDER BY rank) = 1), rn AS (SELECT query_id, CASE WHEN t <> '' THEN t || ': ' ELSE '' END || x AS body, row_number() OVER (PARTITION BY query_id ORDER BY lower(t), lower(x), rank) AS i FROM rk)"""


@query("f13_rendered_evidence", f"WITH {_RENDER} SELECT query_id, style, md5(string_agg({B.styled('style', 'i', 'body')}, chr(10) ORDER BY i)) AS rendered_md5 FROM rn, (SELECT unnest({sql_list(C.STYLES)}) AS style) GROUP BY ALL")
def _(spark, sf):
    p = claim_passages(spark, sf).groupBy("query_id", "claim").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "text"))).alias("l"))
    p = p.withColumn("passages", F.transform("l", lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text"))))
    each = F.explode(F.array(*map(F.lit, C.STYLES)))
    return p.withColumn("style", each).select("query_id", "style", F.md5(X.render_evidence(F.col("passages"), F.col("style"), canonicalize=True).cast("binary")).alias("rendered_md5"))


def _sql_content(x):
    return f"list_filter(list_distinct(list_filter(regexp_extract_all(lower({x}), '[\\pL\\pN_]+'), lambda t: regexp_full_match(t, '[a-z]{{3,}}'))), lambda t: NOT list_contains({sql_list(dict.fromkeys(C.GATE_STOPWORDS))}, t))"


@query("f16_gate_overlap", f"WITH {_FSP}, c AS (SELECT ord, {_sql_content('claim')} AS a, {_sql_content('evidence')} AS b FROM fsp) SELECT ord, round({sql_overlap('a', 'b')}, 6) AS overlap FROM c")
def _(spark, sf):
    return first_sentence_pairs(spark, sf).select("ord", F.round(X.gate_overlap("claim", "evidence"), 6).alias("overlap"))


def _sql_pair_words(x):
    return f"list_filter(list_distinct({sql_tokens(x)}), lambda t: length(t) > 2 AND NOT list_contains({sql_list(C.PAIR_STOPWORDS)}, t))"


@query("f17_pair_overlap", f"WITH {_FSP}, c AS (SELECT ord, {_sql_pair_words('claim')} AS a, {_sql_pair_words('evidence')} AS b FROM fsp) SELECT ord, round_even({sql_overlap('a', 'b')}, 4) AS overlap FROM c")
def _(spark, sf):
    return first_sentence_pairs(spark, sf).select("ord", X.pair_overlap("claim", "evidence").alias("overlap"))


@query("f18_negative_types", f"WITH {_PRED.replace(sql_topk(5), sql_topk(5))}, c AS (SELECT t.query_id, t.ord, t.rank, {_sql_pair_words('q.text')} AS a, {_sql_pair_words('d.text')} AS b FROM top t JOIN q USING (query_id) JOIN d USING (ord)) SELECT query_id, ord, CASE WHEN round_even({sql_overlap('a', 'b')}, 4) >= 0.5 THEN 'same_topic_missing_fact' WHEN rank <= 2 THEN 'near_miss' ELSE 'irrelevant' END AS negative_type FROM c")
def _(spark, sf):
    return claim_passages(spark, sf).select("query_id", "ord", X.negative_type(F.col("title"), F.array().cast("array<string>"), F.lit(C.NEI), X.pair_overlap("claim", "text"), F.col("rank")).alias("negative_type"))


@query("f20_negation", f"WITH {_FSP}, c AS (SELECT ord, {sql_space('claim')} AS a, {sql_space('text')} AS b FROM fsp) SELECT ord, list_contains(b, 'not') OR list_contains(b, 'nicht') AND false AS has_not, list_contains(b, 'not') AND len(list_intersect(a, b)) > 0 AS negates FROM c")
def _(spark, sf):
    return first_sentence_pairs(spark, sf).select("ord", F.array_contains(X.space_tokens("text"), "not").alias("has_not"), verify.negates("claim", "text").alias("negates"))


@query("f22_grounded_explanation", "SELECT item_id, '[1] ' || regexp_replace(text, '[.!?]+$', '') || ' and therefore ' || CASE item_id % 3 WHEN 0 THEN 'supports the claim' WHEN 1 THEN 'contradicts the claim' ELSE 'does not establish the claim' END || '.' AS explanation FROM benchmark")
def _(spark, sf):
    v = F.when(F.col("item_id") % 3 == 0, C.SUPPORTED).when(F.col("item_id") % 3 == 1, C.REFUTED).otherwise(C.NEI)
    return tab(spark, sf, "benchmark").select("item_id", T.grounded_explanation(v, F.col("text")).alias("explanation"))


@query("f24_json_objects", "SELECT event_id, json_valid(props) AND starts_with(trim(props), '{') AS is_object FROM events")
def _(spark, sf):
    return tab(spark, sf, "events").select("event_id", F.coalesce(T.json_object(F.coalesce("props", F.lit(""))).isNotNull(), F.lit(False)).alias("is_object"))


@query("f30_context_blocks", f"WITH {BM25}, {sql_topk(3)} SELECT query_id, md5(string_agg('[' || rank || '] ' || d.source || ': ' || d.text, chr(10) ORDER BY rank)) AS block_md5 FROM top JOIN d USING (ord) GROUP BY query_id")
def _(spark, sf):
    c = verify.contexts(api.evidence_for(claims(spark, sf), corpus(spark, sf), 3), 3)
    return c.select("query_id", F.md5(Q.context_block(F.col("context")).cast("binary")).alias("block_md5"))


_PROMPT = "'" + C.PROMPT_HEAD.replace("\n", "' || chr(10) || '") + "Claim:' || chr(10) || trim(claim) || chr(10) || chr(10) || 'Verifier label:' || chr(10) || label || chr(10) || chr(10) || 'Evidence:' || chr(10) || CASE WHEN trim(evidence, E' \\t\\n\\r') = '' THEN '(no evidence provided)' ELSE '[E1] ' || trim(evidence, E' \\t\\n\\r') END || chr(10) || chr(10) || '" + C.PROMPT_TAIL + "'"
_LEAD = "regexp_replace(trim(evidence, E' \\t\\n\\r'), '[.!?]+$', '')"
_SAID = f"CASE WHEN trim(evidence, E' \\t\\n\\r') = '' THEN CASE WHEN label = 'NOT_ENOUGH_INFO' THEN 'The provided evidence does not establish the claim.' ELSE 'The claim cannot be grounded because no evidence passages were provided.' END WHEN label = 'SUPPORTED' THEN {_LEAD} || ' therefore the claim is supported.' WHEN label = 'REFUTED' THEN {_LEAD} || ' therefore the claim is refuted.' ELSE {_LEAD} || ' does not establish the claim, so the correct decision is not enough info.' END"
_CITED = "CASE WHEN trim(evidence, E' \\t\\n\\r') = '' THEN '[]' ELSE '[\"E1\"]' END"
_SFT = f"{_FSP}, sft AS (SELECT ord, label, {_PROMPT} AS prompt, 'Decision: ' || label || chr(10) || 'Explanation: ' || {_SAID} || chr(10) || 'Citations: ' || {_CITED} AS completion, {_CITED} AS cited FROM (SELECT *, CASE ord % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NOT_ENOUGH_INFO' END AS label FROM fsp))"


def sft_rows(spark, sf) -> DataFrame:
    label = F.when(F.col("ord") % 3 == 0, "SUPPORTS").when(F.col("ord") % 3 == 1, "refutes").otherwise("unknown")
    return first_sentence_pairs(spark, sf).select("ord", F.col("ord").alias("claim_id"), "claim", "evidence", label.alias("label"), "source", F.lit("gold").alias("evidence_type"))


@query("f33_sft_records", f"WITH {_SFT} SELECT CAST(ord AS VARCHAR) AS claim_id, label AS verifier_label, md5(prompt) AS prompt_md5, md5(completion) AS completion_md5 FROM sft")
def _(spark, sf):
    r = builders.sft_records(sft_rows(spark, sf), "train")
    return r.select("claim_id", "verifier_label", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.md5(F.col("completion").cast("binary")).alias("completion_md5"))


@query("p17_sft_violations", f"WITH {_SFT} SELECT CAST(ord AS VARCHAR) AS claim_id, 0::BIGINT AS n_violations FROM sft")
def _(spark, sf):
    return builders.sft_records(sft_rows(spark, sf), "train").select("claim_id", F.size(builders.sft_violations(F.col("prompt"))).cast("long").alias("n_violations"))


_REJ = "CASE k " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(C.REJECTION_TEXTS[r] for r in C.REJECTIONS)) + " END"


@query("f34_dpo_pairs", f"WITH {_SFT}, n AS (SELECT *, (row_number() OVER (ORDER BY CAST(ord AS VARCHAR)) - 1) % 7 AS k FROM sft) SELECT CAST(ord AS VARCHAR) AS claim_id, {sql_list(C.REJECTIONS)}[k + 1] AS rejection_type, md5(completion) AS chosen_md5, md5('Decision: ' || CASE WHEN k = 0 THEN CASE label WHEN 'NOT_ENOUGH_INFO' THEN 'SUPPORTED' WHEN 'SUPPORTED' THEN 'REFUTED' ELSE 'NOT_ENOUGH_INFO' END WHEN k = 6 THEN 'NOT_ENOUGH_INFO' ELSE label END || chr(10) || 'Explanation: ' || {_REJ} || chr(10) || 'Citations: ' || CASE k WHEN 1 THEN '[]' WHEN 2 THEN '[\"E99\"]' WHEN 4 THEN '[\"E999\"]' ELSE '[\"E1\"]' END) AS rejected_md5 FROM n")
def _(spark, sf):
    p = builders.dpo_pairs(builders.sft_records(sft_rows(spark, sf), "train"))
    return p.select("claim_id", "rejection_type", F.md5(F.col("chosen").cast("binary")).alias("chosen_md5"), F.md5(F.col("rejected").cast("binary")).alias("rejected_md5"))


@query("a23_dpo_stats", f"WITH {_SFT}, n AS (SELECT *, (row_number() OVER (ORDER BY CAST(ord AS VARCHAR)) - 1) % 7 AS k FROM sft) SELECT {sql_list(C.REJECTIONS)}[k + 1] AS rejection_type, label AS verifier_label, count(*) AS n FROM n GROUP BY ALL")
def _(spark, sf):
    return builders.dpo_pairs(builders.sft_records(sft_rows(spark, sf), "train")).groupBy("rejection_type", "verifier_label").agg(F.count("*").alias("n"))


_SHOW = "CASE label WHEN 'NOT_ENOUGH_INFO' THEN 'NOT ENOUGH INFO' ELSE label END"
_TOLD = f"CASE WHEN evidence = '' THEN 'Verdict: ' || {_SHOW} || '. No evidence was retrieved, so the claim cannot be grounded.' ELSE '[1] ' || regexp_replace(evidence, '[.!?]+$', '') || ' and therefore ' || CASE label WHEN 'SUPPORTED' THEN 'supports the claim' WHEN 'REFUTED' THEN 'contradicts the claim' ELSE 'does not establish the claim' END || '.' END"


@query("f38_chat_examples", f"WITH {_FSP}, r AS (SELECT *, CASE ord % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NOT_ENOUGH_INFO' END AS label FROM fsp) SELECT ord, md5('Claim: ' || claim || chr(10) || 'Evidence: ' || CASE WHEN evidence = '' THEN '(no evidence provided)' ELSE '[1] ' || evidence END || chr(10) || '{C.CHAT_TASK}') AS user_md5, md5('Verdict: ' || {_SHOW} || chr(10) || 'Explanation: ' || {_TOLD} || chr(10) || 'Citation: ' || CASE WHEN evidence = '' THEN '(none)' ELSE '[1]' END) AS assistant_md5 FROM r")
def _(spark, sf):
    rows = sft_rows(spark, sf).withColumn("label", L.artifact_label("label"))
    m = builders.chat_examples(rows)
    md5 = lambda i: F.md5(F.get("messages", F.lit(i))["content"].cast("binary"))
    return m.select("ord", md5(1).alias("user_md5"), md5(2).alias("assistant_md5"))


@query("f39_json_chat_examples", f"WITH {_FSP}, r AS (SELECT *, CASE ord % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NOT_ENOUGH_INFO' END AS label FROM fsp) SELECT ord, '{{\"verdict\":' || to_json({_SHOW}) || ',\"explanation\":' || to_json({_TOLD}) || ',\"citations\":' || CASE WHEN evidence = '' THEN '[]' ELSE '[1]' END || '}}' AS assistant FROM r")
def _(spark, sf):
    rows = sft_rows(spark, sf).withColumn("label", L.artifact_label("label"))
    return builders.chat_examples(rows, as_json=True).select("ord", F.get("messages", F.lit(2))["content"].alias("assistant"))


@query("f40_preference_pairs", f"""WITH {_FSP}, r AS (SELECT *, CASE ord % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NOT_ENOUGH_INFO' END AS label FROM fsp WHERE {B.trim("evidence")} <> ''), v AS (SELECT ord, claim, evidence, {_SHOW} AS v, {_TOLD} AS told FROM r),
{B.checked("SELECT ord AS key, told FROM v", "SELECT ord AS key, 1 AS id, evidence AS text FROM v")}, k AS (SELECT v.*, (row_number() OVER (ORDER BY ord) - 1) % 3 AS kind, CASE v WHEN 'SUPPORTED' THEN 'REFUTED' ELSE 'SUPPORTED' END AS w, regexp_replace(evidence, '[.!?]+$', '') AS lead FROM v JOIN ck ON ck.key = v.ord WHERE valid)
SELECT ord, v AS gold_label, {sql_list(C.PREFERENCE_FAULTS)}[kind + 1] AS rejection_type, md5('Verdict: ' || v || chr(10) || 'Explanation: ' || told || chr(10) || 'Citation: [1]') AS chosen_md5,
  md5('Verdict: ' || CASE kind WHEN 0 THEN w ELSE v END || chr(10) || 'Explanation: ' || CASE kind WHEN 0 THEN '[1] ' || lead || ' and therefore ' || CASE w WHEN 'SUPPORTED' THEN 'supports the claim' ELSE 'contradicts the claim' END || '.' WHEN 1 THEN '[2] ' || lead || ' therefore the claim is ' || lower(v) || '.' ELSE 'The claim is ' || lower(v) || ' based on general background knowledge.' END || chr(10) || 'Citation: ' || CASE kind WHEN 0 THEN '[1]' WHEN 1 THEN '[2]' ELSE '(none)' END) AS rejected_md5 FROM k""")
def _(spark, sf):
    rows = sft_rows(spark, sf).withColumn("label", L.artifact_label("label"))
    p = builders.preference_pairs(rows)
    return p.select("ord", "gold_label", "rejection_type", F.md5(F.col("chosen").cast("binary")).alias("chosen_md5"), F.md5(F.col("rejected").cast("binary")).alias("rejected_md5"))


@query("f48_confidence_bucket", f"WITH {_LAB} SELECT doc_id, CASE WHEN confidence >= 0.7 THEN 'High' WHEN confidence >= 0.55 THEN 'Borderline' ELSE 'Review' END AS bucket FROM lab")
def _(spark, sf):
    return labelled(spark, sf).select("doc_id", L.confidence_bucket("confidence").alias("bucket"))


@query("f49_grounding_bucket", f"WITH {BM25}, {sql_topk(1)} SELECT query_id, CASE WHEN score >= 3 THEN 'Strong' WHEN score >= 1.5 THEN 'Moderate' ELSE 'Weak' END AS grounding FROM top")
def _(spark, sf):
    return R.bm25_topk(claims(spark, sf), corpus(spark, sf), 1).select("query_id", L.grounding_bucket("score").alias("grounding"))


@query("f50_display_verdict", f"WITH {_PRED} SELECT query_id, CASE WHEN verdict IN ('SUPPORTED', 'REFUTED') THEN verdict ELSE 'Inconclusive' END AS shown FROM ve")
def _(spark, sf):
    return predictions(spark, sf).select("query_id", L.display_verdict("p").alias("shown"))


_RAW = "raw AS (SELECT doc_id, ['SUPPORTS', 'support', ' refutes ', 'CONTRADICT', 'NEI', 'not_enough_info', 'Mixed Label', 'contradicts'][doc_id % 8 + 1] AS label FROM documents)"


@query("l01_dataset_label", f"WITH {_RAW}, u AS (SELECT doc_id, upper(trim(label)) AS u FROM raw) SELECT doc_id, CASE WHEN u IN ('SUPPORTS', 'SUPPORT') THEN 'SUPPORTED' WHEN u IN ('REFUTES', 'CONTRADICT', 'CONTRADICTS') THEN 'REFUTED' WHEN u IN ('NOT ENOUGH INFO', 'NOT_ENOUGH_INFO', 'NEI', 'UNKNOWN') THEN 'NOT_ENOUGH_INFO' ELSE replace(u, ' ', '_') END AS label FROM u")
def _(spark, sf):
    return raw_labels(spark, sf).select("doc_id", L.dataset_label("label").alias("label"))


def raw_labels(spark, sf) -> DataFrame:
    given = ["SUPPORTS", "support", " refutes ", "CONTRADICT", "NEI", "not_enough_info", "Mixed Label", "contradicts"]
    return corpus(spark, sf).select("doc_id", F.element_at(F.array(*map(F.lit, given)), (F.col("doc_id") % 8 + 1).cast("int")).alias("label"))


@query("l02_artifact_label", f"WITH {_RAW}, u AS (SELECT doc_id, replace(replace(upper(trim(label)), '-', '_'), ' ', '_') AS u FROM raw) SELECT doc_id, CASE WHEN u IN ('SUPPORTS', 'SUPPORTED') THEN 'SUPPORTED' WHEN u IN ('REFUTED', 'REFUTES', 'CONTRADICT', 'CONTRADICTS') THEN 'REFUTED' ELSE 'NOT_ENOUGH_INFO' END AS label FROM u")
def _(spark, sf):
    return raw_labels(spark, sf).select("doc_id", L.artifact_label("label").alias("label"))


# ---- verification


@query("v01_rule_verdicts", f"WITH {_PRED} SELECT query_id, rank, verdict, round(confidence, 6) AS confidence, s AS supported, r AS refuted, n AS nei FROM pl")
def _(spark, sf):
    v = verify.verify_passages(claim_passages(spark, sf))
    return v.select("query_id", "rank", "result.verdict", F.round("result.confidence", 6).alias("confidence"), "result.supported", "result.refuted", "result.nei")


@query("v03_bundle_verdicts", f"WITH {_PRED}, b AS (SELECT query_id, {sql_space('any_value(claim)')} AS ct, {sql_space('string_agg(text, chr(10) ORDER BY rank)')} AS et FROM pl GROUP BY query_id) SELECT query_id, CASE WHEN list_contains(et, 'not') AND len(list_intersect(ct, et)) > 0 THEN 'REFUTED' WHEN {sql_overlap('ct', 'et')} >= 0.45 THEN 'SUPPORTED' ELSE 'NOT ENOUGH INFO' END AS verdict, round(least(0.99, 0.45 + {sql_overlap('ct', 'et')} / 2), 6) AS confidence FROM b")
def _(spark, sf):
    return verify.verify_bundle(claim_passages(spark, sf)).select("query_id", "verdict", F.round("confidence", 6).alias("confidence"))


@query("v04_aggregated_verdicts", f"WITH {_PRED} SELECT ve.query_id, verdict, round(confidence, 6) AS confidence, (SELECT min(rank) FROM pl WHERE pl.query_id = ve.query_id AND CASE ve.verdict WHEN 'SUPPORTED' THEN pl.s = ve.s WHEN 'REFUTED' THEN pl.r = ve.r ELSE pl.n = ve.n END) AS winning_rank FROM ve")
def _(spark, sf):
    v = verify.aggregate_claims(verify.verify_passages(claim_passages(spark, sf)))
    return v.select("query_id", "verdict", F.round("confidence", 6).alias("confidence"), "winning_rank")


_GATED = _PRED.replace("pl AS (", f"g0 AS (SELECT query_id, rank, {_sql_content('claim')} AS a, {_sql_content('text')} AS b FROM pp), gt AS (SELECT query_id, rank, {sql_overlap('a', 'b')} AS go FROM g0), pl0 AS (").replace("ag AS (", "pl AS (SELECT query_id, rank, CASE WHEN go < 0.5 THEN 0 ELSE s END AS s, CASE WHEN go < 0.5 THEN 0 ELSE r END AS r, CASE WHEN go < 0.5 THEN 1 ELSE n END AS n FROM pl0 JOIN gt USING (query_id, rank)),\nag AS (")


@query("v05_gated_verdicts", f"WITH {_GATED} SELECT query_id, verdict, round(confidence, 6)::DOUBLE AS confidence FROM ve")
def _(spark, sf):
    v = verify.aggregate_claims(verify.verify_passages(claim_passages(spark, sf), 0.5))
    return v.select("query_id", "verdict", F.round("confidence", 6).alias("confidence"))


_SCORED = "sg AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NOT ENOUGH INFO' END AS y, (length(text) % 11) / 10.0::DOUBLE AS s, (length(text) % 7) / 10.0::DOUBLE AS r FROM documents)"
_GRID = "g AS (SELECT row_number() OVER (ORDER BY m, s, r) - 1 AS grid_ord, s AS st, r AS rt, m FROM (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS s), (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS r), (SELECT unnest([0.0, 0.1, 0.2])::DOUBLE AS m))"


def _sql_grid(decide: str) -> str:
    f1 = " + ".join(f"CASE WHEN sum(CASE WHEN y = '{v}' AND p = '{v}' THEN 1 ELSE 0 END) > 0 THEN 2.0::DOUBLE * sum(CASE WHEN y = '{v}' AND p = '{v}' THEN 1 ELSE 0 END) / (sum(CASE WHEN y = '{v}' THEN 1 ELSE 0 END) + sum(CASE WHEN p = '{v}' THEN 1 ELSE 0 END)) ELSE 0.0 END" for v in C.LABELS)
    return f"WITH {_SCORED}, {_GRID}, e AS (SELECT grid_ord, st, rt, m, y, {decide} AS p FROM sg, g), ev AS (SELECT grid_ord, st AS support_threshold, rt AS refute_threshold, m AS margin, avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy, ({f1}) / 3 AS macro_f1, avg(CASE WHEN p = 'REFUTED' THEN 1.0::DOUBLE ELSE 0.0 END) AS refuted_rate FROM e GROUP BY ALL)"


_MARGIN = "CASE WHEN s >= st AND s - r >= m THEN 'SUPPORTED' WHEN r >= rt AND r - s >= m THEN 'REFUTED' ELSE 'NOT ENOUGH INFO' END"


def _evaluated(spark, sf) -> DataFrame:
    d = corpus(spark, sf)
    y = F.when(F.col("ord") % 3 == 0, C.SUPPORTED).when(F.col("ord") % 3 == 1, C.REFUTED).otherwise(C.NEI)
    scored = d.select(y.alias("y"), ((F.length("text") % 11) / F.lit(10.0)).alias("supported"), ((F.length("text") % 7) / F.lit(10.0)).alias("refuted"))
    steps = grids.float_range(30, 70, 10)
    return grids.evaluate_grid(scored, grids.threshold_grid(spark, steps, steps, [0.0, 0.1, 0.2]), with_margin=True)


@query("a38_threshold_grid", f"{_sql_grid(_MARGIN)} SELECT grid_ord::INT AS grid_ord, support_threshold, refute_threshold, margin, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(refuted_rate, 6) AS refuted_rate FROM ev")
def _(spark, sf):
    return _rounded(_evaluated(spark, sf), "grid_ord", "support_threshold", "refute_threshold", "margin")


@query("a39_grid_argmax", f"{_sql_grid(_MARGIN)} SELECT grid_ord::INT AS grid_ord, round(macro_f1, 6) AS macro_f1 FROM ev ORDER BY round(macro_f1, 9) DESC, grid_ord LIMIT 1")
def _(spark, sf):
    return grids.best_row(_evaluated(spark, sf)).select("grid_ord", F.round("macro_f1", 6).alias("macro_f1"))


@query("a40_grid_top10", f"{_sql_grid(_MARGIN)} SELECT grid_ord::INT AS grid_ord, round(macro_f1, 6) AS macro_f1 FROM ev ORDER BY round(macro_f1, 9) DESC, round(accuracy, 9) DESC, grid_ord LIMIT 10")
def _(spark, sf):
    return grids.top_rows(_evaluated(spark, sf)).select("grid_ord", F.round("macro_f1", 6).alias("macro_f1"))


@query("j16_gate_grid", "WITH s AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES' ELSE 'NEI' END AS y, CASE length(text) % 2 WHEN 0 THEN 'SUPPORTS' ELSE 'REFUTES' END AS p, (length(text) % 13) / 13.0::DOUBLE AS ov FROM documents), e AS (SELECT t, y, CASE WHEN ov < t THEN 'NEI' ELSE p END AS p FROM s, (SELECT unnest([0.2, 0.4, 0.6])::DOUBLE AS t)) SELECT t AS threshold, round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM e GROUP BY t")
def _(spark, sf):
    d, n = corpus(spark, sf), F.length("text")
    pairs = d.select(F.when(F.col("ord") % 3 == 0, "SUPPORTS").when(F.col("ord") % 3 == 1, "REFUTES").otherwise("NEI").alias("y"), F.when(n % 2 == 0, "SUPPORTS").otherwise("REFUTES").alias("p"), ((n % 13) / F.lit(13.0)).alias("overlap"))
    return grids.evaluate_gates(pairs, [0.2, 0.4, 0.6]).select("threshold", F.round("accuracy", 6).alias("accuracy"))


# ---- builders


def _mining(spark, sf) -> tuple[DataFrame, DataFrame]:
    q, d, g = claims(spark, sf), corpus(spark, sf), R.once(gold(spark, sf))
    positive = R.broadcast_if_small(g.groupBy("query_id").agg(F.min("ord").alias("ord"))).join(d.select("ord", F.col("text").alias("positive")), "ord").drop("ord")
    rows = labelled_claims(spark, sf).join(positive, "query_id").select("query_id", F.col("text").alias("claim"), "positive", "label")
    bm25, dense = R.bm25_topk(q, d, 8), R.dense_topk(R.with_embedding(q), R.with_embedding(d), 24)
    return rows, builders.mine_negatives(rows, d, bm25, dense)


_MINE = f"""WITH {BM25}, {sql_topk(8)}, {_HASH}, {sql_dense(24)},
ps AS (SELECT g.query_id, d.text AS positive FROM (SELECT query_id, min(ord) AS ord FROM gold GROUP BY query_id) g JOIN d USING (ord)), mc AS (SELECT lc.query_id, lc.text AS claim, positive, label FROM lc JOIN ps USING (query_id)),
m1 AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY r, text) AS place FROM (SELECT t.query_id, d.text, min(t.rank) AS r FROM top t JOIN d USING (ord) JOIN ps USING (query_id) WHERE d.text <> positive GROUP BY ALL) QUALIFY place <= 2),
m2 AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY r, text) AS place FROM (SELECT t.query_id, d.text, min(t.rank) AS r FROM dense t JOIN d USING (ord) JOIN ps USING (query_id) WHERE d.text <> positive GROUP BY ALL) x WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.query_id = x.query_id AND m1.text = x.text) QUALIFY place <= 2),
hv AS (SELECT query_id, text, 'bm25_hard_negative' AS negative_type, place FROM m1 UNION ALL SELECT query_id, text, 'dense_hard_negative', place FROM m2),
pl AS (SELECT text, row_number() OVER (ORDER BY sha256('42|' || text)) - 1 AS place, count(*) OVER () AS size FROM (SELECT DISTINCT text FROM d)),
dw AS (SELECT ps.query_id, ps.positive, pl.text, k AS rank FROM ps, (SELECT unnest(range(10)) AS k) JOIN pl ON pl.place = (('0x' || substr(sha256('42|' || ps.query_id), 1, 8))::BIGINT + k) % pl.size WHERE k < pl.size),
m3 AS (SELECT w.query_id, w.text, row_number() OVER (PARTITION BY w.query_id ORDER BY w.rank, w.text) AS place, greatest(1, 5 - (SELECT count(*) FROM hv WHERE hv.query_id = w.query_id)) AS need FROM dw w WHERE w.text <> w.positive AND NOT EXISTS (SELECT 1 FROM hv WHERE hv.query_id = w.query_id AND hv.text = w.text) QUALIFY place <= need),
ng AS (SELECT * FROM hv UNION ALL SELECT query_id, text, 'random_negative', place FROM m3),
nl AS (SELECT query_id, list(text ORDER BY CASE negative_type WHEN 'bm25_hard_negative' THEN 1 WHEN 'dense_hard_negative' THEN 2 ELSE 3 END, place, text) AS l FROM ng GROUP BY query_id)"""


@query("b04_hard_negatives", f"{_MINE} SELECT query_id, negative_type, place::INT AS place, md5(text) AS text_md5 FROM ng")
def _(spark, sf):
    _, negatives = _mining(spark, sf)
    return negatives.select("query_id", "negative_type", "place", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("b08_training_pairs", f"{_MINE} SELECT query_id, 1 AS relevance, 'gold' AS negative_type, label, md5(positive) AS evidence_md5 FROM mc UNION ALL SELECT ng.query_id, 0, negative_type, label, md5(text) FROM ng JOIN mc USING (query_id)")
def _(spark, sf):
    _, pairs = builders.training_pairs(*_mining(spark, sf))
    return pairs.select("query_id", "relevance", "negative_type", "label", F.md5(F.col("evidence").cast("binary")).alias("evidence_md5"))


@query("p13_spread_negatives", f"{_MINE} SELECT query_id, md5(claim) AS anchor, md5(positive) AS positive, md5(l[1]) AS negative_1, md5(l[2]) AS negative_2, md5(l[3]) AS negative_3 FROM mc JOIN nl USING (query_id) WHERE len(l) >= 3")
def _(spark, sf):
    retriever, _ = builders.training_pairs(*_mining(spark, sf))
    return builders.spread_negatives(retriever, 3).select("query_id", *[F.md5(F.col(c).cast("binary")).alias(c) for c in ("anchor", "positive", "negative_1", "negative_2", "negative_3")])


_VER = f"{BASE}, r AS (SELECT lc.query_id AS ord, CAST(lc.query_id AS VARCHAR) AS claim_id, lc.text AS claim, replace(lc.label, ' ', '_') AS label, (SELECT any_value(d.source) FROM gold JOIN d USING (ord) WHERE gold.query_id = lc.query_id AND gold.ord = (SELECT min(x.ord) FROM gold x WHERE x.query_id = lc.query_id)) AS gold FROM lc), pool AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS place, gold FROM r WHERE label <> 'NOT_ENOUGH_INFO' AND gold IS NOT NULL), nn AS (SELECT *, ('0x' || substr(sha256('coin42|' || claim_id), 1, 8))::BIGINT % 2 = 0 AS coin, ('0x' || substr(sha256('pick42|' || claim_id), 1, 8))::BIGINT % (SELECT count(*) FROM pool) AS place FROM r WHERE label = 'NOT_ENOUGH_INFO')"


@query("b03_verifier_examples", f"WITH {_VER} SELECT ord, claim_id, label, gold AS evidence, 'gold' AS evidence_type FROM r WHERE label <> 'NOT_ENOUGH_INFO' AND gold IS NOT NULL UNION ALL SELECT nn.ord, claim_id, label, CASE WHEN coin THEN pool.gold ELSE '' END, CASE WHEN coin THEN 'retrieved_negative' ELSE 'no_evidence' END FROM nn LEFT JOIN pool USING (place)")
def _(spark, sf):
    d = corpus(spark, sf)
    first = gold(spark, sf).groupBy("query_id").agg(F.min("ord").alias("ord")).join(d.select("ord", F.col("source").alias("gold")), "ord").drop("ord")
    records = labelled_claims(spark, sf).join(first, "query_id", "left").select(F.col("query_id").alias("ord"), F.col("query_id").cast("string").alias("claim_id"), F.col("text").alias("claim"), "label", "gold", F.lit("benchmark").alias("source"))
    return builders.verifier_examples(records).select("ord", "claim_id", "label", "evidence", "evidence_type")


def _passage_pairs(spark, sf) -> DataFrame:
    q, d, g = labelled_claims(spark, sf), corpus(spark, sf), gold(spark, sf)
    texts = g.join(d.select("ord", "text", "title"), "ord")
    gold_text = texts.groupBy("query_id").agg(builders.gold_text(F.array_sort(F.collect_list(F.struct("ord", "text")))).alias("gold_text"))
    rows = q.join(gold_text, "query_id", "left").select("query_id", F.col("text").alias("claim"), "label", "gold_text")
    return builders.passage_pairs(rows, api.evidence_for(claims(spark, sf), d, 5), texts.select("query_id", "ord", "title"))


@query("b09_passage_pairs", f"""WITH {BM25}, {sql_topk(5)}, gt AS (SELECT query_id, string_agg(trim(d.text, E' \\t\\n\\r'), ' ' ORDER BY d.ord) AS t, list(DISTINCT d.source) AS titles FROM gold JOIN d USING (ord) GROUP BY query_id),
o AS (SELECT lc.query_id, NULL::BIGINT AS ord, NULL::INT AS rank, lc.label, lc.text AS claim, gt.t AS p, true AS is_gold, NULL AS title, gt.titles FROM lc JOIN gt USING (query_id)),
f AS (SELECT top.query_id, top.ord, top.rank::INT AS rank, lc.label, lc.text AS claim, d.text AS p, EXISTS (SELECT 1 FROM gold g WHERE g.query_id = top.query_id AND g.ord = top.ord) AS is_gold, d.source AS title, gt.titles FROM top JOIN lc USING (query_id) JOIN d ON d.ord = top.ord LEFT JOIN gt ON gt.query_id = top.query_id),
a AS (SELECT * FROM o UNION ALL SELECT * FROM f), w AS (SELECT *, {_sql_pair_words('claim')} AS cw, {_sql_pair_words('p')} AS pw FROM a), v AS (SELECT *, round_even({sql_overlap('cw', 'pw')}, 4) AS ov FROM w)
SELECT query_id, ord, rank, CASE WHEN is_gold THEN CASE label WHEN 'SUPPORTED' THEN 'SUPPORTS' WHEN 'REFUTED' THEN 'REFUTES' ELSE 'NEI' END ELSE 'NEI' END AS pair_label, ov AS lexical_overlap, CASE WHEN ord IS NULL THEN 'oracle' WHEN is_gold THEN 'gold_retrieved' WHEN label <> 'NOT ENOUGH INFO' AND list_contains(titles, title) THEN 'same_entity_insufficient' WHEN ov >= 0.5 THEN 'same_topic_missing_fact' WHEN rank <= 2 THEN 'near_miss' ELSE 'irrelevant' END AS pair_type FROM v""")
def _(spark, sf):
    return _passage_pairs(spark, sf).select("query_id", "ord", "rank", "pair_label", "lexical_overlap", "pair_type")


@query("a20_pair_stats", ORACLES["b09_passage_pairs"].replace("SELECT query_id, ord, rank, CASE WHEN is_gold", "SELECT pair_type, pair_label, count(*) AS n FROM (SELECT CASE WHEN is_gold") + ") GROUP BY ALL")
def _(spark, sf):
    return _passage_pairs(spark, sf).groupBy("pair_type", "pair_label").agg(F.count("*").alias("n"))


@query("b10_robust_union", ORACLES["b09_passage_pairs"].replace("SELECT query_id, ord, rank, CASE WHEN is_gold", "SELECT label, evidence_type, count(*) AS n FROM (SELECT CASE pair_label WHEN 'SUPPORTS' THEN 'SUPPORTED' WHEN 'REFUTES' THEN 'REFUTED' ELSE 'NOT_ENOUGH_INFO' END AS label, pair_type AS evidence_type FROM (SELECT ord, CASE WHEN is_gold") + ") WHERE ord IS NOT NULL UNION ALL SELECT CASE doc_id % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NOT_ENOUGH_INFO' END, 'gold' FROM documents) GROUP BY ALL")
def _(spark, sf):
    d = corpus(spark, sf).select("ord", F.col("text").alias("passage_text"))
    pairs = _passage_pairs(spark, sf).where("ord is not null").join(d, "ord").join(claims(spark, sf).withColumnRenamed("text", "claim"), "query_id").select(F.col("query_id").cast("string").alias("claim_id"), "claim", "passage_text", "pair_label", F.lit("benchmark").alias("source"), "pair_type")
    oracle = sft_rows(spark, sf).select(F.col("claim_id").cast("string").alias("claim_id"), "claim", "evidence", L.artifact_label("label").alias("label"), "source", "evidence_type")
    return builders.robust_union(oracle, pairs).groupBy("label", "evidence_type").agg(F.count("*").alias("n"))


_AUG = f"""{_PAIRS}, ah AS (SELECT query_id, ord, text, {_HEUR} AS s FROM pr), ar AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, CAST(ord AS VARCHAR)) AS rank FROM ah QUALIFY rank <= 5),
ab AS (SELECT k, ar.query_id, lc.text || ':top' || k AS seed, {B.clean("ar.text")} AS x, rank FROM ar JOIN lc USING (query_id), (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k),
ai AS (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY rank) - 1 AS i FROM ab WHERE x <> ''), ao AS (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY sha256(seed || '|' || i)) AS n, {B.style_of("seed")} AS style FROM ai),
ax AS (SELECT query_id, k, string_agg({B.styled("style", "n", "x")}, chr(10) ORDER BY n) AS r FROM ao GROUP BY ALL), aw AS (SELECT query_id, max(r) FILTER (k = 1) AS r1, max(r) FILTER (k = 3) AS r3, max(r) FILTER (k = 5) AS r5 FROM ax GROUP BY query_id)"""


@query("b11_topk_augmented", f"{_AUG} SELECT lc.query_id AS ord, label, CASE WHEN row_number() OVER (ORDER BY lc.query_id) % 2 = 1 THEN 'gold' ELSE 'retrieved_top3' END AS mixed_source, md5(coalesce(r1, '')) AS top1_evidence, md5(coalesce(r3, '')) AS top3_evidence, md5(coalesce(r5, '')) AS top5_evidence, md5(CASE WHEN row_number() OVER (ORDER BY lc.query_id) % 2 = 1 THEN lc.text ELSE coalesce(r3, '') END) AS mixed_evidence FROM lc LEFT JOIN aw USING (query_id)")
def _(spark, sf):
    p = ranking.rerank(_bm25_with_text(spark, sf), ranking.heuristic_score("claim", "text"), 5)
    rows = labelled_claims(spark, sf).select(F.col("query_id").alias("ord"), F.col("text").alias("claim"), "label", F.col("text").alias("evidence"))
    out = builders.topk_augmented(rows, p.select(F.col("query_id").alias("ord"), F.col("rerank_rank").alias("rank"), "title", "text"))
    return out.select("ord", "label", "mixed_source", *[F.md5(F.col(c).cast("binary")).alias(c) for c in ("top1_evidence", "top3_evidence", "top5_evidence", "mixed_evidence")])


# ---- the whole pipeline

_OUT = f"""WITH {_PRED}, w AS (SELECT ve.query_id, ve.verdict, ve.confidence, (SELECT min(rank) FROM pl WHERE pl.query_id = ve.query_id AND CASE ve.verdict WHEN 'SUPPORTED' THEN pl.s = ve.s WHEN 'REFUTED' THEN pl.r = ve.r ELSE pl.n = ve.n END) AS wr FROM ve)
SELECT query_id, verdict, round(confidence, 6) AS confidence FROM w"""


_OUTCOME = f"""WITH {_PRED}, {B.checked("SELECT ve.query_id AS key, '[1] ' || regexp_replace(pp.text, '[.!?]+$', '') || ' and therefore ' || CASE ve.verdict WHEN 'SUPPORTED' THEN 'supports the claim' WHEN 'REFUTED' THEN 'contradicts the claim' ELSE 'does not establish the claim' END || '.' AS told FROM ve JOIN pp ON pp.query_id = ve.query_id AND pp.rank = 1", "SELECT query_id AS key, rank::INT AS id, text FROM pp")},
oc AS (SELECT ve.query_id, ve.verdict, ve.confidence, ck.valid, ck.precision, ck.rate, ve.confidence < 0.55 AS low FROM ve JOIN ck ON ck.key = ve.query_id)"""


@query("u08_verify_claims", f"{_OUTCOME} SELECT query_id, verdict, round(confidence, 6)::DOUBLE AS confidence, CASE WHEN NOT low AND valid THEN 'final' ELSE 'abstain' END AS decision, NOT low AND valid AS citation_valid, CASE WHEN low OR valid THEN 0 ELSE 2 END AS retries_used, round(CASE WHEN low THEN 0.0 ELSE precision END, 6)::DOUBLE AS citation_precision, round(CASE WHEN low THEN 0.0 ELSE rate END, 6)::DOUBLE AS unsupported_sentence_rate FROM oc")
def _(spark, sf):
    out = api.verify(claims(spark, sf), corpus(spark, sf))
    return out.select("query_id", "verdict", F.round("confidence", 6).alias("confidence"), "decision", "citation_valid", "retries_used", F.round("citation_precision", 6).alias("citation_precision"), F.round("unsupported_sentence_rate", 6).alias("unsupported_sentence_rate"))


@query("api_verdicts", _OUT)
def _(spark, sf):
    return api.verify(claims(spark, sf), corpus(spark, sf)).select("query_id", "verdict", F.round("confidence", 6).alias("confidence"))


@query("api_pipeline", f"{_OUTCOME} SELECT query_id, verdict, 5 AS n_evidence, valid FROM oc")
def _(spark, sf):
    return api.pipeline(claims(spark, sf), corpus(spark, sf)).select("query_id", "verdict", F.size("evidence").alias("n_evidence"), "check.valid")


# ---- state and streams


@query("t01_live_entries", "WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, value, epoch_us(ts + INTERVAL 1 DAY) AS expires_us FROM l WHERE ts + INTERVAL 1 DAY >= (SELECT max(ts) FROM events)")
def _(spark, sf):
    from claimloom.streaming import state

    e = tab(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    live = state.live_entries(e.crossJoin(F.broadcast(now)), 86_400, F.col("now"))
    return live.select("user_id", "value", F.unix_micros(F.col("expires_at").cast("timestamp")).alias("expires_us"))


@query("t02_windowed_metrics", f"WITH {_LOG} SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, verdict, count(*) AS n, round(avg(latency_ms), 6) AS mean_latency_ms, round(avg(CASE WHEN fallback_used THEN 1.0 ELSE 0.0 END), 6) AS fallback_rate FROM rl GROUP BY ALL")
def _(spark, sf):
    from claimloom.streaming import state

    m = state.windowed_metrics(request_log(spark, sf), "1 hour")
    return m.select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_us"), "verdict", "n", F.round("mean_latency_ms", 6).alias("mean_latency_ms"), F.round("fallback_rate", 6).alias("fallback_rate"))


@query("t04_keep_first_users", "SELECT user_id, count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id")
def _(spark, sf):
    from claimloom.streaming import state

    return state.keep_first_stream(tab(spark, sf, "events"), ["user_id", "event_type"]).groupBy("user_id").agg(F.count("*").alias("n_types"))


# ---- evaluators and models


def _evidences(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, d = claims(spark, sf), corpus(spark, sf)
    # ranked before the texts come in, so that these stay where they lie
    ranked = gold(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ord")))
    oracle = R.broadcast_if_small(ranked).join(d.select("ord", "text"), "ord")
    return q, oracle.select("query_id", "rank", "text"), api.evidence_for(q, d, 5).select("query_id", "rank", "text")


@query("a64_retrieval_by_strategy", f"""WITH {_CHANNELS}, {B.bm25("t", 10, docs="td")}, {B.rrf("h1", _BASIC, 10)}, {B.rrf("h2", [*_BASIC, "SELECT query_id.q, ord, rank, query_id.n + 2 FROM etop"], 10)}, {B.rrf("h3", [*_BASIC, "SELECT query_id, ord, rank, 2 FROM ttop"], 10)},
ra AS (SELECT 'bm25_only' AS strategy, query_id, ord, rank FROM btop UNION ALL SELECT 'dense_only', query_id, ord, rank FROM dense UNION ALL SELECT 'hybrid_bm25_dense', query_id, ord, rank FROM h1 UNION ALL SELECT 'hybrid_with_query_expansion', query_id, ord, rank FROM h2 UNION ALL SELECT 'hybrid_with_titles', query_id, ord, rank FROM h3), {B.per_strategy("ra", 10)} SELECT * FROM me""")
def _(spark, sf):
    from claimloom.plans import evaluate

    return _rounded(evaluate.retrieval_by_strategy(claims(spark, sf), corpus(spark, sf), gold(spark, sf)), "strategy")


_BOTH = f"""{BM25}, {sql_topk(5)}, ev AS (SELECT 'retrieved' AS src, top.query_id, top.rank, q.text AS claim, d.text FROM top JOIN q USING (query_id) JOIN d USING (ord) UNION ALL SELECT 'oracle', g.query_id, row_number() OVER (PARTITION BY g.query_id ORDER BY g.ord), q.text, d.text FROM (SELECT DISTINCT * FROM gold) g JOIN q USING (query_id) JOIN d USING (ord)),
e0 AS (SELECT src, 'per_passage_max' AS mode, query_id, claim, text FROM ev UNION ALL SELECT src, 'bundle', query_id, any_value(claim), string_agg(text, chr(10) ORDER BY rank) FROM ev GROUP BY src, query_id),
e1 AS (SELECT src, mode, query_id, {sql_space("claim")} AS ct, {sql_space("text")} AS et FROM e0),
e2 AS (SELECT src, mode, query_id, least(0.99, 0.45 + {sql_overlap("ct", "et")} / 2) AS cf, CASE WHEN list_contains(et, 'not') AND len(list_intersect(ct, et)) > 0 THEN 'REFUTED' WHEN {sql_overlap("ct", "et")} >= 0.45 THEN 'SUPPORTED' ELSE 'NOT ENOUGH INFO' END AS v FROM e1),
e3 AS (SELECT src, mode, query_id, count(*) AS n, any_value(v) AS v1, any_value(cf) AS c1, max(CASE WHEN v = 'SUPPORTED' THEN 0.7::DOUBLE ELSE 0.1 END) AS s, max(CASE WHEN v = 'REFUTED' THEN 0.7::DOUBLE ELSE 0.1 END) AS r, max(CASE WHEN v = 'NOT ENOUGH INFO' THEN 0.7::DOUBLE ELSE 0.1 END) AS x FROM e2 GROUP BY ALL),
e4 AS (SELECT src, mode, query_id, CASE WHEN n = 1 THEN v1 WHEN s >= 0.5 AND s > r THEN 'SUPPORTED' WHEN r >= 0.5 AND r > s THEN 'REFUTED' ELSE 'NOT ENOUGH INFO' END AS p, CASE WHEN n = 1 THEN c1 WHEN s >= 0.5 AND s > r THEN s WHEN r >= 0.5 AND r > s THEN r ELSE greatest(x, 1 - greatest(s, r)) END AS confidence FROM e3),
pb AS (SELECT m.src AS evidence_source, m.mode, lc.query_id, lc.label AS y, coalesce(p, 'NOT ENOUGH INFO') AS p, coalesce(confidence, 0.34)::DOUBLE AS confidence FROM lc CROSS JOIN (SELECT DISTINCT src, mode FROM (SELECT unnest(['oracle', 'retrieved']) AS src), (SELECT unnest(['per_passage_max', 'bundle']) AS mode)) m LEFT JOIN e4 ON e4.src = m.src AND e4.mode = m.mode AND e4.query_id = lc.query_id),
pf1 AS (SELECT evidence_source, mode, l.label, CASE WHEN count(*) FILTER (y = l.label AND p = l.label) > 0 THEN 2.0::DOUBLE * count(*) FILTER (y = l.label AND p = l.label) / (count(*) FILTER (y = l.label) + count(*) FILTER (p = l.label)) ELSE 0.0 END AS f1, count(*) FILTER (y = l.label OR p = l.label) AS seen FROM pb, (SELECT unnest({sql_list(C.LABELS)}) AS label) l GROUP BY ALL),
pe AS (SELECT a.*, f.macro_f1 FROM (SELECT evidence_source, mode, count(*) AS n, avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy, coalesce(count(*) FILTER (y = 'NOT ENOUGH INFO' AND p <> y)::DOUBLE / nullif(count(*) FILTER (y = 'NOT ENOUGH INFO'), 0), 0.0) AS nei_fpr, avg(confidence) AS mean_confidence FROM pb GROUP BY ALL) a JOIN (SELECT evidence_source, mode, avg(f1) AS macro_f1 FROM pf1 WHERE seen > 0 GROUP BY ALL) f USING (evidence_source, mode))"""


@query("a67_oracle_vs_retrieved", f"WITH {_BOTH} SELECT evidence_source, mode, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(nei_fpr, 6) AS nei_fpr, round(mean_confidence, 6) AS mean_confidence FROM pe")
def _(spark, sf):
    from claimloom.plans import evaluate

    p = evaluate.oracle_and_retrieved(*_evidences(spark, sf))
    return _rounded(evaluate.evaluate_predictions(p, labelled_claims(spark, sf)), "evidence_source", "mode")


_ORACLE_SIDE = f"""{BM25}, {sql_topk(5)}, ev AS (SELECT 'retrieved' AS src, top.query_id, top.rank, q.text AS claim, d.text FROM top JOIN q USING (query_id) JOIN d USING (ord) UNION ALL SELECT 'oracle', g.query_id, row_number() OVER (PARTITION BY g.query_id ORDER BY g.ord), q.text, d.text FROM (SELECT DISTINCT * FROM gold) g JOIN q USING (query_id) JOIN d USING (ord)),
e1 AS (SELECT src, query_id, rank, {sql_space('claim')} AS ct, {sql_space('text')} AS et, count(*) OVER (PARTITION BY src, query_id) AS cnt FROM ev),
e2 AS (SELECT src, query_id, cnt, {sql_overlap('ct', 'et')} AS ov, CASE WHEN list_contains(et, 'not') AND len(list_intersect(ct, et)) > 0 THEN 'REFUTED' WHEN {sql_overlap('ct', 'et')} >= 0.45 THEN 'SUPPORTED' ELSE 'NOT ENOUGH INFO' END AS v FROM e1),
e3 AS (SELECT src, query_id, max(CASE WHEN v = 'SUPPORTED' THEN 0.7 ELSE 0.1 END) AS s, max(CASE WHEN v = 'REFUTED' THEN 0.7 ELSE 0.1 END) AS r, any_value(v) AS only_v, max(cnt) AS cnt FROM e2 GROUP BY ALL),
e4 AS (SELECT src, query_id, CASE WHEN cnt = 1 THEN only_v WHEN s >= 0.5 AND s > r THEN 'SUPPORTED' WHEN r >= 0.5 AND r > s THEN 'REFUTED' ELSE 'NOT ENOUGH INFO' END AS verdict FROM e3),
e5 AS (SELECT lc.query_id, lc.label, coalesce(o.verdict, 'NOT ENOUGH INFO') = lc.label AS oracle_ok, coalesce(t.verdict, 'NOT ENOUGH INFO') = lc.label AS retrieved_ok FROM lc LEFT JOIN e4 o ON o.src = 'oracle' AND o.query_id = lc.query_id LEFT JOIN e4 t ON t.src = 'retrieved' AND t.query_id = lc.query_id)"""


@query("a33_oracle_retrieved_breakdown", f"WITH {_ORACLE_SIDE} SELECT g.oracle_ok, g.retrieved_ok, count(e5.query_id) AS n, round(count(e5.query_id)::DOUBLE / (SELECT count(*) FROM e5), 6) AS rate FROM (VALUES (true, true), (true, false), (false, true), (false, false)) g(oracle_ok, retrieved_ok) LEFT JOIN e5 ON e5.oracle_ok = g.oracle_ok AND e5.retrieved_ok = g.retrieved_ok GROUP BY ALL")
def _(spark, sf):
    from claimloom.plans import evaluate

    p = evaluate.oracle_and_retrieved(*_evidences(spark, sf))
    return evaluate.error_breakdown(p, labelled_claims(spark, sf)).withColumn("rate", F.round("rate", 6))


@query("a32_mode_deltas", f"WITH {_BOTH} SELECT mode, round(max(accuracy) FILTER (evidence_source = 'oracle') - max(accuracy) FILTER (evidence_source = 'retrieved'), 6) AS delta_accuracy, round(max(macro_f1) FILTER (evidence_source = 'oracle') - max(macro_f1) FILTER (evidence_source = 'retrieved'), 6) AS delta_macro_f1 FROM pe GROUP BY mode")
def _(spark, sf):
    from claimloom.plans import evaluate

    p = evaluate.oracle_and_retrieved(*_evidences(spark, sf))
    return _rounded(evaluate.mode_deltas(evaluate.evaluate_predictions(p, labelled_claims(spark, sf))), "mode")


@query("a34_subset_accuracy", f"WITH {_BOTH}, {B.bm25('s', 50)}, sf AS (SELECT t.query_id, min(t.rank) AS first FROM stop t JOIN gold g ON g.query_id = t.query_id AND g.ord = t.ord GROUP BY ALL) SELECT k, coalesce(first <= k, false) AS hit, count(*) AS n, round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM pb LEFT JOIN sf USING (query_id), (SELECT unnest([10, 50]) AS k) WHERE evidence_source = 'retrieved' AND mode = 'per_passage_max' GROUP BY ALL")
def _(spark, sf):
    from claimloom.plans import evaluate

    q, d = claims(spark, sf), corpus(spark, sf)
    p = evaluate.oracle_and_retrieved(*_evidences(spark, sf))
    return evaluate.subset_accuracy(p, labelled_claims(spark, sf), R.bm25_topk(q, d, 50), gold(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@query("b16_failure_examples", f"WITH {_BOTH}, wr AS (SELECT query_id AS ord, y AS label, p AS verdict, row_number() OVER (PARTITION BY y, p ORDER BY query_id) AS rn, min(query_id) OVER (PARTITION BY y, p) AS first FROM pb WHERE evidence_source = 'retrieved' AND mode = 'per_passage_max' AND y <> p) SELECT ord, label, verdict, row_number() OVER (ORDER BY rn, first)::INT AS turn FROM wr ORDER BY rn, first LIMIT 20")
def _(spark, sf):
    from claimloom.plans import evaluate

    p = evaluate.oracle_and_retrieved(*_evidences(spark, sf))
    return evaluate.failure_examples(p, labelled_claims(spark, sf)).select("ord", "label", "verdict", "turn")


_TOLD52 = "SELECT ord AS key, '[1] ' || regexp_replace(evidence, '[.!?]+$', '') || ' and therefore supports the claim.' AS told FROM fsp WHERE evidence <> ''"


@query("a52_faithfulness", f"WITH {_FSP}, {B.checked(_TOLD52, _CTX1)} SELECT count(*) AS n, round_even(avg(CASE WHEN valid THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS citation_valid, round_even(avg(precision), 4) AS citation_precision, round_even(avg(rate), 4) AS unsupported_sentence_rate, round_even(avg(CASE WHEN precision >= 0.5 AND rate <= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS verdict_consistency FROM ck")
def _(spark, sf):
    from claimloom.plans import evaluate

    p = first_sentence_pairs(spark, sf).where("evidence <> ''")
    ctx = F.array(F.struct(F.lit(1).alias("citation_id"), F.lit(None).cast("string").alias("title"), F.col("evidence").alias("text")))
    told = T.grounded_explanation(F.lit(C.SUPPORTED), F.col("evidence"))
    return evaluate.faithfulness(p, told, ctx)


@query("a53_explanation_metrics", f"""WITH {_FSP}, l AS (SELECT *, CASE ord % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NOT_ENOUGH_INFO' END AS label FROM fsp), sd AS (SELECT ord, label, {B.trim("evidence")} AS ev, {B.trim(_SAID)} AS said FROM l), {B.checked("SELECT ord AS key, said AS told FROM sd", "SELECT ord AS key, 1 AS id, ev AS text FROM sd WHERE ev <> ''")}
SELECT label AS verifier_label, count(*) AS n, 1.0::DOUBLE AS format_correctness, 1.0::DOUBLE AS decision_consistency, round_even(avg(CASE WHEN ev <> '' THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS citation_presence, round_even(avg(CASE WHEN ev <> '' THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS citation_precision, round_even(avg(rate), 4) AS unsupported_rate, round_even(avg(len({B.words("said")})::DOUBLE), 4) AS average_length FROM sd JOIN ck ON ck.key = sd.ord GROUP BY label""")
def _(spark, sf):
    from claimloom.plans import evaluate

    r = builders.sft_records(sft_rows(spark, sf), "train")
    ctx = F.transform("evidence_passages", lambda e: F.struct(F.lit(1).alias("citation_id"), e["title"].alias("title"), e["text"].alias("text")))
    return evaluate.explanation_metrics(r.select("verifier_label", F.col("completion").alias("answer"), ctx.alias("context")), ("verifier_label",))


@query("v12_text_classifier")
def _(spark, sf):
    from claimloom.operators import models

    d = labelled(spark, sf).select("doc_id", F.when(F.col("y") == 1, "good").otherwise("bad").alias("label")).join(tab(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    model = models.train_text_classifier(d, iterations=20)
    return models.classify(model, d.select("doc_id", "text", "label")).select("doc_id", "label", "predicted", F.round("confidence", 2).alias("confidence"))


@query("v15_verifier_inputs", f"""WITH {BM25}, {sql_topk(5)}, b0 AS (SELECT query_id, rank, q.text AS claim, unnest(string_split(d.text, chr(10))) AS raw, generate_subscripts(string_split(d.text, chr(10)), 1) AS i FROM top JOIN q USING (query_id) JOIN d USING (ord)), b1 AS (SELECT *, {B.clean("raw")} AS b FROM b0),
b2 AS (SELECT query_id, lower(b) AS k, arg_min(b, {{'r': rank, 'i': i}}) AS b FROM b1 WHERE b <> '' GROUP BY ALL) SELECT q.query_id, md5('Claim: ' || any_value(q.text) || chr(10) || 'Evidence: ' || coalesce(string_agg(b2.b, chr(10) ORDER BY b2.k), '')) AS input_md5 FROM q LEFT JOIN b2 ON b2.query_id = q.query_id GROUP BY q.query_id""")
def _(spark, sf):
    from claimloom.operators import models

    return models.verifier_inputs(claim_passages(spark, sf)).select("query_id", F.md5(F.col("input").cast("binary")).alias("input_md5"))


@query("u03_embedding_model", "SELECT doc_id, round(sqrt(length(text)::DOUBLE * length(text) + (length(text) - length(replace(text, ' ', '')))::DOUBLE * (length(text) - length(replace(text, ' ', '')))), 4) AS norm FROM documents")
def _(spark, sf):
    from claimloom.operators import models

    def load():
        return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]

    return models.embed(corpus(spark, sf), load).select("doc_id", F.round(V.norm("vector"), 4).alias("norm"))


@query("k02_model_rerank", f"{_PAIRS}, h AS (SELECT query_id, ord, len(list_intersect({sql_space('claim')}, {sql_space('text')}))::DOUBLE AS s FROM pr) SELECT query_id, ord, s AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, CAST(ord AS VARCHAR)) AS rerank_rank, 'cross_encoder' AS rerank_backend FROM h QUALIFY rerank_rank <= 5")
def _(spark, sf):
    from claimloom.operators import models

    def load():
        return lambda a, b: [float(len(set(x.lower().split()) & set(y.lower().split()))) for x, y in zip(a, b, strict=True)]

    return models.reranked(_bm25_with_text(spark, sf), "cross_encoder", load, 5).select("query_id", "ord", "rerank_score", "rerank_rank", "rerank_backend")


@query("j05_cross_scores", "WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), c AS (SELECT label, pos, avg(x) AS m FROM v GROUP BY ALL) SELECT c.label AS query_id, count(DISTINCT v.vec_id) AS n, round(sum(x * m) / count(DISTINCT v.vec_id), 6) AS mean_score FROM v JOIN c USING (pos) GROUP BY c.label")
def _(spark, sf):
    e = tab(spark, sf, "embeddings")
    q = _centroids(e).select(F.col("label").alias("query_id"), F.col("vector").alias("q"))
    s = e.select("embedding").crossJoin(R.broadcast_if_small(q)).select("query_id", V.dot("q", "embedding").alias("s"))
    return s.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean_score"))


@query("j12_gold_flags", f"WITH {BM25}, {sql_topk(10)} SELECT t.query_id, t.ord, EXISTS (SELECT 1 FROM gold g WHERE g.query_id = t.query_id AND g.ord = t.ord) AS by_id, EXISTS (SELECT 1 FROM gold g JOIN d x ON x.ord = g.ord JOIN d y ON y.ord = t.ord WHERE g.query_id = t.query_id AND x.source = y.source) AS by_title FROM top t")
def _(spark, sf):
    d, g = corpus(spark, sf), gold(spark, sf).distinct()
    found = R.bm25_topk(claims(spark, sf), d, 10).join(d.select("ord", "title"), "ord")
    ids = g.withColumn("by_id", F.lit(True))
    titles = g.join(d.select("ord", "title"), "ord").select("query_id", "title").distinct().withColumn("by_title", F.lit(True))
    out = found.join(ids, ["query_id", "ord"], "left").join(titles, ["query_id", "title"], "left")
    return out.select("query_id", "ord", F.coalesce("by_id", F.lit(False)).alias("by_id"), F.coalesce("by_title", F.lit(False)).alias("by_title"))


@query("a44_label_balance", "SELECT lang, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang")
def _(spark, sf):
    d = corpus(spark, sf)
    total = d.agg(F.count("*").alias("t"))
    return audit.histogram(d, "lang", "lang").crossJoin(F.broadcast(total)).select("lang", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("d02_dedupe_records", "SELECT min(conv_id) AS ord, md5(text) AS claim_md5 FROM (SELECT conv_id, text FROM conversations WHERE turn = 0) GROUP BY text")
def _(spark, sf):
    c = tab(spark, sf, "conversations")
    rest = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    records = rest.select(F.col("conv_id").alias("ord"), F.get("l", F.lit(0))["text"].alias("claim"), F.transform("l", lambda x: F.struct(x["turn"].alias("doc_id"), x["text"].alias("text"))).alias("evidence"))
    return dedupe.dedupe_records(records).select("ord", F.md5(F.col("claim").cast("binary")).alias("claim_md5"))


@query("d08_citation_sets", "WITH c AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text || ' [' || item_id % 4 || '] [2] [2]', '\\[(\\d+)\\]', 1), lambda x: x::INT)) AS ids FROM benchmark) SELECT item_id, array_to_string(list_sort(list_filter(ids, lambda x: x NOT IN (1, 2))), ',') AS missing, len(list_filter(ids, lambda x: x IN (1, 2))) AS n_cited FROM c")
def _(spark, sf):
    t = F.concat("text", F.lit(" ["), (F.col("item_id") % 4).cast("string"), F.lit("] [2] [2]"))
    known = F.array(F.lit(1), F.lit(2))
    b = tab(spark, sf, "benchmark").select("item_id", Q.cited_ids(t).alias("ids"))
    return b.select("item_id", F.array_join(F.array_sort(F.array_except("ids", known)), ",").alias("missing"), F.size(F.array_intersect("ids", known)).cast("long").alias("n_cited"))


@query("w04_running_hits", f"WITH {_METRICS} SELECT query_id, rank, seen::BIGINT AS seen FROM j2")
def _(spark, sf):
    j = metrics.judged(R.bm25_topk(claims(spark, sf), corpus(spark, sf), 50), gold(spark, sf))
    return j.select("query_id", "rank", F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("seen"))


@query("f21_verifier_explanation", f"WITH {_PRED} SELECT query_id, rank, md5('Verdict: ' || verdict || '. Claim: ' || claim || '. Evidence: ' || text || '. This evidence ' || CASE verdict WHEN 'SUPPORTED' THEN 'supports the claim' WHEN 'REFUTED' THEN 'contradicts the claim' ELSE 'does not establish the claim' END || '.') AS explanation_md5 FROM pl")
def _(spark, sf):
    v = verify.verify_passages(claim_passages(spark, sf))
    return v.select("query_id", "rank", F.md5(T.verifier_explanation(F.col("claim"), F.col("text"), F.col("result.verdict")).cast("binary")).alias("explanation_md5"))


@query("l04_verifier_data_label", f"WITH {_RAW}, u AS (SELECT doc_id, replace(upper(trim(label)), '_', ' ') AS u FROM raw) SELECT doc_id, CASE WHEN u IN ('SUPPORTED', 'SUPPORTS', 'SUPPORT') THEN 'SUPPORTED' WHEN u IN ('REFUTED', 'REFUTES', 'CONTRADICT', 'CONTRADICTS') THEN 'REFUTED' ELSE 'NOT_ENOUGH_INFO' END AS label FROM u")
def _(spark, sf):
    return raw_labels(spark, sf).select("doc_id", L.verifier_data_label("label").alias("label"))


@query("l05_evaluation_label", f"WITH {_RAW}, u AS (SELECT doc_id, replace(upper(trim(label)), '_', ' ') AS u FROM raw) SELECT doc_id, CASE WHEN u IN ('SUPPORTED', 'SUPPORTS', 'SUPPORT') THEN 'SUPPORTED' WHEN u IN ('REFUTED', 'REFUTES', 'CONTRADICT', 'CONTRADICTS') THEN 'REFUTED' ELSE 'NOT ENOUGH INFO' END AS label FROM u")
def _(spark, sf):
    return raw_labels(spark, sf).select("doc_id", L.evaluation_label("label").alias("label"))


@query("f26_listed_citations", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN '1,2' WHEN 1 THEN '' ELSE '3' END AS cited FROM benchmark")
def _(spark, sf):
    reply = F.when(F.col("item_id") % 3 == 0, F.lit('ok {"citations": [2, "1", "x", 2]} done')).when(F.col("item_id") % 3 == 1, F.lit('{"citations": "1"}')).otherwise(F.lit('{"citations": ["3"]}'))
    return tab(spark, sf, "benchmark").select("item_id", F.array_join(T.listed_citations(T.json_object(reply)), ",").alias("cited"))


@query("f27_answer_fields", f"WITH {_SFT} SELECT ord, label AS decision, CASE WHEN cited = '[]' THEN 0 ELSE 1 END AS n_citations FROM sft")
def _(spark, sf):
    label = L.artifact_label("label")
    rows = sft_rows(spark, sf).withColumn("v", label).withColumn("p", T.evidence_passages("evidence"))
    f = rows.select("ord", T.answer_fields(T.sft_completion(F.col("v"), F.col("p"))).alias("f"))
    return f.select("ord", "f.decision", F.size("f.citations").alias("n_citations"))


@query("k08_date_tokens", r"SELECT doc_id, len(list_distinct(list_concat(list_filter(regexp_extract_all(lower(text), '[\pL\pN_]+'), lambda t: regexp_full_match(t, '[0-9]{4}')), list_filter(regexp_extract_all(lower(text), '[\pL\pN_]+'), lambda t: regexp_full_match(t, '(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*'))))) AS n_dates FROM documents")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", F.size(X.date_tokens("text")).cast("long").alias("n_dates"))


# ---- ranks and sizes are 32-bit here and 64-bit in DuckDB; the SQL narrows them

_NARROW = {
    "n_tokens": ("r01_tokenize",), "rank": ("r04_bm25_okapi_topk", "r05_bm25_topk", "r13_dense_topk", "r17_vector_store_ip", "k13_ranking_strategies", "v01_rule_verdicts", "w04_running_hits", "f21_verifier_explanation"),
    "fused_rank": ("r14_rrf", "r15_hybrid_topk"), "rerank_rank": ("k01_heuristic_rerank", "k02_model_rerank"), "turn": ("w07_round_robin",), "n_sentences": ("f03_sentences",), "winning_rank": ("v04_aggregated_verdicts",),
}
for _column, _names in _NARROW.items():
    for _name in _names:
        ORACLES[_name] = f"SELECT * REPLACE (CAST({_column} AS INTEGER) AS {_column}) FROM ({ORACLES[_name]})"
