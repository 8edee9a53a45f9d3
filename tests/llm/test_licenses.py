import random
import re

from claimloom.llm import licenses


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for t in licenses.TEMPLATES:
        if t.base:
            p = t.text.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(t.label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, cover=licenses.COVER):
    """(labels, score) of every text: every template at every place, no index."""
    files = [words_of(t) for t in texts]
    n, out = len(files), []
    df = {}
    for f in files:
        for w in set(f):
            df[w] = df.get(w, 0) + 1
    for f in files:
        labels, score = set(), 0.0
        for t in licenses.TEMPLATES:
            words, key = t.text.split(), t.key.split()
            weights = [licenses.idf(n, df.get(w, 0)) for w in words]
            key_at = next(k for k in range(len(words)) if words[k : k + len(key)] == key)
            for start in range(-len(words) + 1, len(f)):
                if start + key_at < 0 or f[start + key_at : start + key_at + len(key)] != key:
                    continue
                share = sum(x for k, (w, x) in enumerate(zip(words, weights, strict=True)) if 0 <= start + k < len(f) and f[start + k] == w) / sum(weights)
                if share >= (1.0 if t.base else cover):
                    labels.add(t.label)
                    score = max(score, share)
        out.append((",".join(sorted(labels)), score))
    return out


def test_labels_against_every_place(spark):
    """Notices with words replaced, the rarest too, among texts that share their words."""
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        for t in licenses.TEMPLATES:
            words = t.text.split()
            for k in rng.sample(range(len(words)), rng.randint(0, max(1, len(words) // 4))):
                words[k] = rng.choice(["word", "the", "software", "x9"])
            texts.append(" ".join([*rng.choices(["the", "a", "use", "of", "free", "terms"], k=rng.randint(0, 5)), *words, "end"]))
    texts += [None, "", "license", "the " * 3000, "all rights reserved " * 200]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (labels, score) in enumerate(brute(texts)):
        assert got[i]["labels"] == labels and abs(got[i]["score"] - score) < 1e-12, texts[i]


def test_rarest_words_replaced(spark):
    """17 of 20 words and the key phrase stand; the three that no other text has do not."""
    isc = next(t for t in licenses.TEMPLATES if t.label == "isc").text.split()
    rare = ["fee", "purpose", "granted"]
    texts = [" ".join("zz" if w in rare else w for w in isc), *(" ".join(w for w in isc if w not in rare) for _ in range(3)), *("something else" for _ in range(30))]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in rows} == dict(enumerate(brute(texts)))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "All rights reserved", 5, "f")], "doc_id long, text string, file int, places string")
    assert licenses.scan_licenses(df.withColumnRenamed("file", "at")).first()["labels"] == "proprietary" == licenses.scan_licenses(df).first()["labels"]


def base(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_base_places_against_plain_python(spark):
    rng = random.Random(6)
    bits = ["under", "the", "mit", "license", "MIT", "License,", "apache", "version", "2", "2.0", "cc", "by-nc", "CC BY NC", "Under the MIT License.", "Apache License, Version 2", "é", "K", "\n", "word"]
    rows = [(i, " ".join(rng.choices(bits, k=rng.randint(0, 25)))) for i in range(300)] + [(900, None), (901, "cc by nc " * 500)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert base(got[i]) == plain(text), text
        assert set(filter(None, got[i]["base_labels"].split(","))) <= set(got[i]["labels"].split(","))
        assert 0 <= got[i]["score"] <= 1


def test_notices(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this program and associated documentation files", "All rights reserved", "nothing here"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(4)] == ["gpl-3", "mit", "proprietary", ""]
    assert got[0]["score"] == 1 and 0.8 <= got[1]["score"] < 1 and got[3]["score"] == 0


def test_odd_rows(odd_docs, no_docs):
    rows = licenses.scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count() and len([r for r in rows if r["doc_id"] == 4]) == 2
    assert next(r for r in rows if r["doc_id"] == 9)["n_base"] == 3
    assert licenses.scan_licenses(no_docs).count() == 0


def test_no_python_in_the_plan(odd_docs):
    assert "Python" not in licenses.scan_licenses(odd_docs)._jdf.queryExecution().toString()
