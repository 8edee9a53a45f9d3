"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import chat_format, fingerprints, language, licenses, media, merkle, mixing, packing, pii, quality, simhash, toxicity, whitening
from claimloom.llm._common import table
from claimloom.llm._learn import remainder


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.chat_digests(chat_format.format_turns(rows), in_order=True)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source", mixing.document_size().alias("n_words"))
    return mixing.mix_sources(sizes, sized="n_words").select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edited(table(spark, sf_dir, "documents"))


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images: every embedding is drawn as one, and the drawings are compared."""
    drawn = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("media_id"), media.draw_vector("embedding").alias("media"))
    return media.media_classes(drawn)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.default_tokenizer())


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col(f"pii.n_{k}").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.col("pii.base_sha256").alias("base_sha256"), F.col("pii.spans").alias("spans"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = merkle.merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], merkle.tampered_text())
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.reliable").alias("reliable"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality": op6_quality,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_media_copies": op8_media_copies,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_pii": op10_pii,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_language_id": op12_language_id,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_NOTICES = ",\n".join(f"  ({i}, '{t.label}', '{t.text}', '{t.key}', {str(t.base).lower()})" for i, t in enumerate(licenses.TEMPLATES))
_OP4 = rf"""
WITH notice(template, label, text, key, base) AS (VALUES
{_NOTICES}
), template AS (
  SELECT template, label, base, string_split(text, ' ') AS words, string_split(key, ' ') AS key,
         length(string_split(trim(string_split(' ' || text || ' ', ' ' || key || ' ')[1]), ' ')) AS lead, (' ' || text || ' ') LIKE (' ' || key || ' %') AS leads FROM notice
), file AS (
  SELECT doc_id, row_number() OVER () AS nr, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORDS}') AS words FROM documents
), token AS (
  SELECT nr, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM file
), df AS (
  SELECT word, count(DISTINCT nr) AS df FROM token WHERE word IN (SELECT unnest(words) FROM template) GROUP BY word
), spot AS (
  SELECT template, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS off FROM template
), weighed AS (
  SELECT a.*, coalesce(df, 0) AS df, 1 + round(1000 * ln(((SELECT count(*) FROM file) + 1) / (coalesce(df, 0) + 1)))::INT AS weight FROM spot a LEFT JOIN df USING (word)
), place AS (
  SELECT DISTINCT k.nr, p.template, k.pos - p.off AS start FROM token k JOIN spot p USING (word)
), covered AS (
  SELECT p.nr, p.template, p.start, sum(CASE WHEN k.word = w.word THEN w.weight ELSE 0 END) / sum(w.weight) AS cover
  FROM place p JOIN weighed w USING (template) LEFT JOIN token k ON k.nr = p.nr AND k.pos = p.start + w.off GROUP BY ALL
), found AS (
  SELECT c.*, t.label, t.base FROM covered c JOIN template t USING (template) JOIN file f ON f.nr = c.nr
  WHERE cover >= CASE WHEN t.base THEN 1.0 ELSE {licenses.COVER} END
    AND c.start + CASE WHEN t.leads THEN 0 ELSE t.lead END >= 0
    AND list_slice(f.words, c.start + CASE WHEN t.leads THEN 0 ELSE t.lead END + 1, c.start + CASE WHEN t.leads THEN 0 ELSE t.lead END + length(t.key)) = t.key
), each AS (
  SELECT nr, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM found GROUP BY nr
)
SELECT f.doc_id, length(f.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM file f LEFT JOIN each e ON e.nr = f.nr
"""

_OP5 = """
WITH sized AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^ \\x09-\\x0D]+', 'x', 'g'), '[ \\x09-\\x0D]+', '', 'g'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), src0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source
), src1 AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM src0
), src2 AS (
  SELECT *, source_size * 2 AS cap, (source_size * 2)::DOUBLE / weight AS ratio FROM src1
), src3 AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS fill_at FROM src2
), lvl AS (
  SELECT fill_at AS level FROM src3 WHERE ratio >= fill_at ORDER BY ratio, sid LIMIT 1
), src AS (
  SELECT s.*, least(cap::DOUBLE, weight * coalesce((SELECT level FROM lvl), (SELECT max(ratio) FROM src3))) AS target FROM src3 s
), run AS (
  SELECT d.doc_id, d.size, d.key, s.sid, s.weight, s.source_size, s.target, s.budget,
         sum(d.size) OVER (PARTITION BY s.sid ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS through
  FROM sized d JOIN src s ON d.source IS NOT DISTINCT FROM s.source
), items AS (
  SELECT *, 0 AS epoch, through::DOUBLE / weight AS finish FROM run
  UNION ALL SELECT *, 1 AS epoch, (through + source_size)::DOUBLE / weight AS finish FROM run
), served AS (
  SELECT doc_id, epoch, key, sum(size) OVER (ORDER BY finish, sid, key) <= budget AS got FROM items
)
SELECT r.doc_id, r.size, r.source_size, r.target, (r.size * g.n)::BIGINT AS taken
FROM run r JOIN (SELECT doc_id, sum(CASE WHEN got THEN 1 ELSE 0 END) AS n FROM served GROUP BY doc_id) g USING (doc_id)
"""

_TOLD = r"\### Assistant: </turn> ok"
_OP2 = rf"""
WITH row AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_TOLD}' UNION ALL SELECT -7, 1, 'assistant', '{_TOLD}'
), escaped AS (
  SELECT *, CASE WHEN contains(text, '</turn>' || chr(10)) THEN replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') ELSE replace(text, '\', '\\') END AS body FROM row
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ') + length(role) + length(': ') + length(body) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

_OP11 = """
WITH RECURSIVE doc AS (
  SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents
), leaf AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS bare FROM doc
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS i))
), crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[((xor(c, b)) % 256) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table
), placed AS (
  SELECT l.doc_id, l.source, l.leaf, CASE WHEN coalesce(crc, 0) % 2 = 0 THEN bare ELSE leaf END AS shown,
         row_number() OVER (PARTITION BY l.source ORDER BY l.doc_id NULLS FIRST, l.leaf) - 1 AS place, count(*) OVER (PARTITION BY l.source) AS n,
         dense_rank() OVER (ORDER BY l.source NULLS FIRST) - 1 AS tree FROM leaf l LEFT JOIN crc USING (doc_id)
), node(tree, level, idx, n, digest) AS (
  SELECT tree, 0, place, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY tree, level, idx // 3, n
), sub AS (
  SELECT tree, level AS height, digest AS subroot FROM node WHERE n = 1
), high(level, idx, n, digest) AS (
  SELECT 0, tree, (SELECT count(*) FROM sub), subroot FROM sub
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, idx // 3, n
), top AS (
  SELECT level AS top_height, digest AS root FROM high WHERE n = 1
), every AS (
  SELECT node.tree, node.level, node.idx, node.digest FROM node WHERE n > 1
  UNION ALL SELECT sub.tree, sub.height + high.level, high.idx, high.digest FROM high, sub WHERE n > 1
), leafs AS (
  SELECT p.*, height, subroot, root, top_height, row_number() OVER () AS nr FROM placed p JOIN sub USING (tree), top
), way AS (
  SELECT nr, tree, shown, level, CASE WHEN level < height THEN place // pow(3, level)::BIGINT ELSE tree // pow(3, level - height)::BIGINT END AS pos
  FROM leafs, (SELECT unnest(range(60)) AS level) WHERE level < height + top_height
), sibling AS (
  SELECT nr, w.level, string_agg(digest, '' ORDER BY idx) FILTER (idx <> pos) AS others, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx < pos), '') AS before, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx > pos), '') AS after
  FROM way w JOIN every e ON e.tree = w.tree AND e.level = w.level AND e.idx // 3 = w.pos // 3 GROUP BY nr, w.level
), proof AS (
  SELECT nr, coalesce(string_agg(others, '' ORDER BY level), '') AS siblings FROM sibling GROUP BY nr
), fold(nr, level, digest) AS (
  SELECT nr, 0, shown FROM leafs
  UNION ALL
  SELECT f.nr, f.level + 1, sha256(before || digest || after) FROM fold f JOIN sibling s ON s.nr = f.nr AND s.level = f.level
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM leafs l JOIN fold f ON f.nr = l.nr AND f.level = height + top_height LEFT JOIN proof p ON p.nr = l.nr
"""

ORACLES: dict[str, str] = {"op11_merkle_manifest": _OP11, "op2_chat_format": _OP2, "op4_license_scan": _OP4, "op5_mix_sources": _OP5}
