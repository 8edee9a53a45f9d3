"""Normalisers of raw claim sets to records (claim_id, claim, label, split, evidence, metadata)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.labels import dataset_label
from claimloom.functions.text import sentences, unescape_title
from claimloom.operators.dedupe import keep_first
from claimloom.operators.numbering import numbered_by

ANNOTATED = "id bigint, claim string, label string, verifiable string, split string, evidence array<array<array<string>>>"
GROUPED = "id bigint, claim string, split string, evidence map<string,array<struct<sentences:array<int>,label:string>>>, cited_doc_ids array<bigint>"
ABSTRACTS = "doc_id bigint, title string, abstract array<string>, structured boolean"


def page_cache(rows: DataFrame) -> DataFrame:
    """(title, extract): the last row of each title in a cache (ord, title, extract) that is only appended to."""
    return keep_first(rows, ["title"], [F.col("ord").desc()]).select("title", "extract")


def uncached(titles: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct non-empty titles that the cache lacks."""
    return titles.select("title").where("title <> ''").distinct().join(cache.select("title"), "title", "left_anti")


def sentence_of(extract: Column, number: Column, title: Column) -> Column:
    """Sentence by number, else the first, else the title with spaces."""
    s = sentences(F.coalesce(extract, F.lit("")))
    return F.coalesce(F.when(number >= 0, F.get(s, number)), F.get(s, F.lit(0)), F.replace(title, F.lit("_"), F.lit(" ")))


def flat_texts(rows: DataFrame, source: str = "fever") -> DataFrame:
    """Records of rows whose evidence is a list of texts; ids are places."""
    spans = F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda t, i: F.struct(i.cast("string").alias("doc_id"), t.alias("text"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("double").alias("score"), F.create_map(F.lit("source"), F.lit(source)).alias("metadata")))
    return rows.select(F.col("id").cast("string").alias("claim_id"), "claim", dataset_label("label").alias("label"), "split", spans.alias("evidence"), F.create_map(F.lit("source"), F.lit(source)).alias("metadata"))


def structured_texts(rows: DataFrame, source: str = "scifact") -> DataFrame:
    """Records of rows whose evidence is a list of structs doc_id, text, title."""
    spans = F.transform(F.coalesce("evidence", F.array().cast("array<struct<doc_id:string,text:string,title:string>>")), lambda e, i: F.struct(F.coalesce(e["doc_id"], i.cast("string")).alias("doc_id"), F.coalesce(e["text"], F.lit("")).alias("text"), e["title"].alias("title"), F.lit(None).cast("double").alias("score"), F.create_map(F.lit("source"), F.lit(source)).alias("metadata")))
    return rows.select(F.col("id").cast("string").alias("claim_id"), "claim", dataset_label("label").alias("label"), "split", spans.alias("evidence"), F.create_map(F.lit("source"), F.lit(source)).alias("metadata"))


def annotated_groups(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Records of rows whose evidence is groups of (annotation, evidence id, page, sentence) with page texts from the cache.

    A span's id is page:sentence:group:item; a missing sentence number is -1.
    """
    flat = rows.select("id", F.posexplode("evidence").alias("g", "group")).select("id", "g", F.posexplode("group").alias("i", "item"))
    page, number = F.coalesce(F.get("item", F.lit(2)), F.lit("")), F.coalesce(F.try_to_number(F.get("item", F.lit(3)), F.lit("999999999")).cast("int"), F.lit(-1))
    flat = flat.select("id", "g", "i", page.alias("page"), number.alias("n"), F.get("item", F.lit(0)).alias("a"), F.get("item", F.lit(1)).alias("e"), unescape_title(F.replace(page, F.lit("_"), F.lit(" "))).alias("title"))
    found = flat.join(cache, "title", "left")
    text = F.when(F.col("page") == "", "").otherwise(sentence_of(F.col("extract"), F.col("n"), F.col("page")))
    meta = F.map_filter(F.create_map(F.lit("source"), F.lit("fever"), F.lit("evidence_annotation_id"), F.col("a"), F.lit("evidence_id"), F.col("e")), lambda _, v: v.isNotNull())
    span = F.struct(F.concat_ws(":", "page", F.col("n").cast("string"), F.col("g").cast("string"), F.col("i").cast("string")).alias("doc_id"), text.alias("text"), F.col("page").alias("title"), F.lit(None).cast("double").alias("score"), meta.alias("metadata"))
    spans = found.groupBy("id").agg(F.collect_list(F.struct("g", "i", span.alias("s"))).alias("l"))
    ordered = F.transform(F.array_sort("l", lambda x, y: F.when(x["g"] < y["g"], -1).when(x["g"] > y["g"], 1).when(x["i"] < y["i"], -1).when(x["i"] > y["i"], 1).otherwise(0)), lambda x: x["s"])
    out = rows.join(spans.select("id", ordered.alias("spans")), "id", "left")
    none = F.array().cast("array<struct<doc_id:string,text:string,title:string,score:double,metadata:map<string,string>>>")
    meta = F.map_filter(F.create_map(F.lit("source"), F.lit("fever"), F.lit("verifiable"), F.col("verifiable")), lambda _, v: v.isNotNull())
    return out.select(F.col("id").cast("string").alias("claim_id"), "claim", dataset_label(F.coalesce("label", F.lit("NOT ENOUGH INFO"))).alias("label"), F.nullif("split", F.lit("")).alias("split"), F.coalesce("spans", none).alias("evidence"), meta.alias("metadata"))


def abstracts(rows: DataFrame) -> DataFrame:
    """Passages (ord, doc_id, text, title) of a corpus of sentence lists."""
    text = F.array_join(F.filter(F.coalesce("abstract", F.array().cast("array<string>")), lambda s: s != ""), " ")
    if "ord" not in rows.columns:
        rows = numbered_by(rows, "doc_id", "__place").withColumn("ord", F.col("__place") - 1)
    return rows.select("ord", F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"), F.coalesce("title", F.lit("")).alias("title"))


def grouped_label(evidence: Column) -> Column:
    """Supported if any group supports, else refuted if any contradicts, else not enough information."""
    labels = F.transform(F.flatten(F.map_values(F.coalesce(evidence, F.create_map().cast("map<string,array<struct<sentences:array<int>,label:string>>>")))), lambda g: F.upper(F.coalesce(g["label"], F.lit(""))))
    any_ = lambda p: F.exists(labels, lambda x: F.startswith(x, F.lit(p)))
    return F.when(any_("SUPPORT"), "SUPPORTED").when(any_("CONTRADICT") | any_("REFUTE"), "REFUTED").otherwise("NOT_ENOUGH_INFO")


def picked_sentences(text: Column, ids: Column) -> Column:
    """Sentences by number joined by spaces; the whole text if none is there."""
    s = sentences(text)
    got = F.filter(F.transform(ids, lambda i: F.when(i >= 0, F.get(s, i))), lambda x: x.isNotNull())
    return F.when(F.size(got) > 0, F.array_join(got, " ")).otherwise(text)


def grouped_sentences(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Records of rows whose evidence maps passage ids to sentence groups; passages that the corpus lacks go."""
    flat = rows.select("id", F.explode("evidence").alias("doc_id", "groups")).select("id", "doc_id", F.posexplode("groups").alias("g", "group"))
    found = flat.join(corpus.select("doc_id", "text", "title"), "doc_id")
    meta = F.map_filter(F.create_map(F.lit("source"), F.lit("scifact"), F.lit("evidence_label"), F.col("group.label"), F.lit("sentences"), F.to_json("group.sentences"), F.lit("group_index"), F.col("g").cast("string")), lambda _, v: v.isNotNull())
    span = F.struct("doc_id", picked_sentences(F.col("text"), F.coalesce("group.sentences", F.array().cast("array<int>"))).alias("text"), "title", F.lit(None).cast("double").alias("score"), meta.alias("metadata"))
    order = lambda x, y: F.when(x["doc_id"] < y["doc_id"], -1).when(x["doc_id"] > y["doc_id"], 1).when(x["g"] < y["g"], -1).when(x["g"] > y["g"], 1).otherwise(0)
    spans = found.groupBy("id").agg(F.collect_list(F.struct("doc_id", "g", span.alias("s"))).alias("l")).select("id", F.transform(F.array_sort("l", order), lambda x: x["s"]).alias("spans"))
    none = F.array().cast("array<struct<doc_id:string,text:string,title:string,score:double,metadata:map<string,string>>>")
    meta = F.create_map(F.lit("source"), F.lit("scifact"), F.lit("cited_doc_ids"), F.coalesce(F.to_json("cited_doc_ids"), F.lit("[]")))
    return rows.join(spans, "id", "left").select(F.col("id").cast("string").alias("claim_id"), "claim", grouped_label(F.col("evidence")).alias("label"), F.nullif("split", F.lit("")).alias("split"), F.coalesce("spans", none).alias("evidence"), meta.alias("metadata"))


def tar_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(value): the non-blank lines of one member of gzipped tar archives; each archive is one task."""
    import io
    import tarfile

    import pandas as pd

    def lines(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                    if member in tar.getnames() and (f := tar.extractfile(member)) is not None:
                        found = [x for x in f.read().decode("utf-8").splitlines() if x.strip()]
                        yield pd.DataFrame({"value": found})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string")
