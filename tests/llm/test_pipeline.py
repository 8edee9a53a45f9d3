import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_on_a_small_table(spark, sf, sample_docs):
    docs, names = sample_docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == sample_docs.columns
        docs = spark.read.parquet(corpus_pipeline.write_shared(after))
        names.append((name, docs.count()))
    counts = dict(names)
    assert counts["toxicity"] <= sample_docs.count() and counts["toxicity"] > 0.75 * sample_docs.count()
    assert counts["near_dedup"] == counts["pii"] <= counts["toxicity"]
    ids = docs.groupBy("doc_id").count().collect()
    assert max(r["count"] for r in ids) <= 2
    packed = corpus_pipeline.pack(spark, docs, sf)
    assert packed.groupBy("sequence_id").sum("length").selectExpr("max(`sum(length)`)").first()[0] <= 2048


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).where("piece = 0").count() > 0


def test_near_dedup_keeps_one_of_each_text(spark, sample_docs):
    kept = corpus_pipeline.near_dedup(spark, sample_docs.unionByName(sample_docs), "")
    assert kept.count() == kept.select("text").distinct().count() == kept.select("doc_id").distinct().count()


def test_stages_on_odd_rows(spark, sf, odd_docs, no_docs):
    """Nulls, empty and long texts, repeated rows and clashing names; what every stage but the last gives back has the columns it was given."""
    clash = {name: F.lit("clash") for name in ("score", "id", "text2", "__h", "taken", "language")}
    docs = odd_docs.withColumns(clash)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        none = stage(spark, no_docs.withColumns(clash), sf)
        assert none.count() == 0, name
        if name == "packing":
            assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in docs.collect()}
            continue
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert {r["score"] for r in rows} <= {"clash"}, name
        if name == "near_dedup":
            # null and empty texts are copies of each other
            assert sum(not r["text"] for r in rows) == 1 and sum(r["doc_id"] in (1, 2) for r in rows) == 1
        elif name == "pii":
            assert len(rows) == docs.count() and sum(r["text"] is None for r in rows) == 1
        elif name == "mixing":
            most = {tuple(r): 0 for r in rows}
            for r in rows:
                most[tuple(r)] += 1
            assert set(most) <= {tuple(r) for r in docs.collect()} and max(most.values(), default=0) <= 4  # a repeated row twice each
        else:
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}


def test_bounds_of_batches_come_back(spark):
    from claimloom.llm._common import batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(KeyError), batches(spark, 7, 1 << 20):
        assert spark.conf.get(key) == str(1 << 20)
        raise KeyError
    assert spark.conf.get(key) == before
