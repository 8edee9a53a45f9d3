import hashlib

import numpy as np
import pytest

from claimloom.llm import fingerprints as P


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_plain_python(spark, sf, sample_docs):
    from claimloom.llm.queries import op7_document_fingerprints

    rows = sorted(((r["doc_id"], r["text"] or "") for r in sample_docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in op7_document_fingerprints(spark, sf).collect()}
    assert len(got) == len(rows)
    errors = []
    for i, (d, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 2
        edited = text[: len(text) - cut] + following[:cut]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == P.to_text(P.sketch(text))
        errors.append(abs(r["near_edited"] - jaccard(shingles(text), shingles(edited))))
        assert abs(r["near_next"] - jaccard(shingles(text), shingles(following))) < 0.15
        a, b = shingles(text), shingles(edited)
        assert abs(r["n_shingles"] - len(a)) <= 0.3 * len(a)
        assert abs(r["contained"] - (len(a & b) / len(a) if a else 1.0)) < 0.3
    assert np.mean(errors) < 0.03 and max(errors) < 0.15


def test_merging_parts():
    words = [f"w{i}" for i in range(3000)]
    whole = P.sketch(" ".join(words))
    parts = [P.sketch(" ".join(words[max(0, i - 4) : i + 1000])) for i in range(0, 3000, 1000)]
    merged = P.merge(P.merge(parts[0], parts[1]), parts[2])
    assert np.array_equal(whole, merged)
    assert P.distinct_count(whole) == pytest.approx(2996, rel=0.2)
    half = P.sketch(" ".join(words[:1500]))
    assert P.containment(half, whole) == pytest.approx(1.0, abs=0.15) and P.resemblance(half, whole) == pytest.approx(0.5, abs=0.12)
    assert np.array_equal(P.from_text(P.to_text(whole)), whole)


def test_repeats_do_not_crowd_out():
    assert len(P.bottom_k(np.array([1] * 100_000 + list(range(2, 900)), np.uint64))) == P.K


def test_short_texts():
    assert P.to_text(P.sketch("")) == "" and P.resemblance(P.sketch(""), P.sketch(" ")) == 1.0
    assert P.resemblance(P.sketch("a b"), P.sketch("a b")) == 1.0 and P.resemblance(P.sketch("a"), P.sketch("")) == 0.0
    assert P.distinct_count(P.sketch("a b c d e f")) == 2.0


def test_odd_rows(odd_docs, no_docs):
    rows = P.compare_with_edited(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert P.compare_with_edited(no_docs).count() == 0
    one = P.compare_with_edited(odd_docs.where("doc_id = 7")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"onone"[:0] + b"on" + b"o").hexdigest()
    kept = P.sketch_documents(odd_docs.withColumnRenamed("lang", "fingerprint"))
    assert kept.where("doc_id = 4").select("fingerprint").distinct().collect()[0][0] == ""


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, __sketch int, Fingerprint int, rng int")
    r = P.sketch_documents(df).first()
    assert r["__sketch"] == 5 and r["fingerprint"] == P.to_text(P.sketch("a b")) and r["rng"] == 7 and "Fingerprint" not in r.asDict()
    assert P.compare_with_edited(df).first()["near_edited"] == P.resemblance(P.sketch("a b"), P.sketch("a a"))
