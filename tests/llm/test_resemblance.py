import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from claimloom.llm import resemblance, simhash
from tests.llm.test_simhash import components


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def share(text, shared):
    """Share of the words that stand in a shared shingle."""
    w = text.lower().split()
    inside = {j for i in range(max(1, len(w) - 4)) if tuple(w[i : i + 5]) in shared for j in range(i, min(i + 5, len(w)))}
    return len(inside) / len(w)


def all_links(docs, threshold=0.8, floor=0.6):
    """The similarity of every pair at the threshold, by the definition."""
    sets = {d: shingles(t) for d, t in docs.items()}
    out = {}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = sets[a] & sets[b]
            n = len(sets[a]) + len(sets[b]) - len(shared)
            s = len(shared) / n if n else 1.0
            if n and s >= floor:
                s = max(s, min(share(docs[a], shared), share(docs[b], shared)))
            if s >= threshold:
                out[a, b] = s
    return out


def test_against_all_pairs(spark):
    """Every pair at the threshold is in one component, and no other document goes."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    docs = {r["doc_id"]: r["text"] or "" for r in rows}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    near = all_links(docs)
    links = [tuple(r) for r in resemblance.resemblance_links(df).collect()]
    assert len(near) > 150 and set(links) <= set(near)
    assert components(links, docs) == components(near, docs)
    kept = {r["doc_id"] for r in simhash.simhash_dedup(df, also=resemblance.resemblance_links).collect()}
    has_near = {d for p in near for d in p}
    assert all(d in kept for d in docs if d not in has_near) and not any(a in kept and b in kept for a, b in near)


def test_similarity(sample_docs):
    texts = [r["text"] or "" for r in sample_docs.collect()][:60]
    rng = random.Random(8)
    for t in texts:
        words = t.split()
        for _ in range(len(words) // 30):
            words[rng.randrange(len(words))] = "edited"
        docs = {0: t, 1: " ".join(words)}
        hashes = [resemblance.shingle_hashes(x.lower(), 5) for x in docs.values()]
        want = all_links(docs, 0.0)[0, 1]
        assert abs(resemblance.similarity(*hashes) - want) < 1e-9


def test_hot_groups_give_linear_links(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([f"x{i}", *words])) for i in range(200)] + [(1000 + i, "same text for all of these documents here") for i in range(200)]
    links = resemblance.resemblance_links(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 398 <= links.count() <= 2 * 200 * resemblance.BANDS
    assert {r["doc_id"] for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), also=resemblance.resemblance_links).collect()} == {0, 1000}


def test_odd_rows(odd_docs, no_docs):
    assert resemblance.resemblance_links(no_docs).count() == 0
    pairs = {tuple(r) for r in resemblance.resemblance_links(odd_docs.dropDuplicates(["doc_id"])).collect()}
    assert (1, 2) in pairs and (3, 4) in pairs


def test_clashing_names(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text, 5, "k"), (2, text, 6, "l"), (None, text, 7, "m")], "doc_id long, text string, id int, sketch string")
    assert [tuple(r) for r in resemblance.resemblance_links(df).collect()] == [(1, 2)]


def pair(rng, common, each):
    """Two texts of `common` words and `each` words of their own."""
    word = lambda: f"q{rng.randrange(10**9)}"
    head = [word() for _ in range(common)]
    return [" ".join([*head, *(word() for _ in range(each))]) for _ in range(2)]


def test_exactly_at_the_threshold(spark):
    """400 shared and 100 own words at the end are at 0.8, with one more of its own each below."""
    rng, docs = random.Random(5), {}
    for i in range(60):
        docs[4 * i], docs[4 * i + 1] = pair(rng, 400, 100)
        docs[4 * i + 2], docs[4 * i + 3] = pair(rng, 400, 101)
    assert len(all_links(docs)) == 60
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {tuple(r) for r in resemblance.resemblance_links(df).collect()} == set(all_links(docs))


def test_exactly_at_the_floor(spark):
    """Single words changed far apart: 300 of 400 shingles left is a Jaccard similarity of 0.6, 295 is below."""
    rng, docs = random.Random(15), {}
    for i in range(40):
        for j, edits in enumerate((20, 21)):
            words = [f"q{rng.randrange(10**9)}" for _ in range(404)]
            docs[4 * i + 2 * j] = " ".join(words)
            for k in range(edits):
                words[10 + 18 * k] = "x"
            docs[4 * i + 2 * j + 1] = " ".join(words)
    want = {p: s for p, s in all_links(docs).items()}
    assert set(want) == {(4 * i, 4 * i + 1) for i in range(40)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {tuple(r) for r in resemblance.resemblance_links(df).collect()} == set(want)


def test_pairs_under_a_common_passage(spark):
    """Copies meet though a passage of seven tenths of every text fills the bands."""
    rng, docs = random.Random(6), {}
    passage = " ".join(f"p{i}" for i in range(140))
    for i in range(150):
        for j, own in enumerate(pair(rng, 44, 16)):
            docs[2 * i + j] = f"{passage} {own}"
    assert set(all_links(docs)) == {(2 * i, 2 * i + 1) for i in range(150)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {tuple(r) for r in resemblance.resemblance_links(df).collect()} == {(2 * i, 2 * i + 1) for i in range(150)}


def test_prefixes_meet():
    rng = np.random.default_rng(7)
    for _ in range(300):
        shared, a, b = rng.integers(1, 60), rng.integers(0, 12), rng.integers(0, 12)
        members = rng.permutation(shared + a + b)
        x, y = np.sort(members[: shared + a]), np.sort(np.concatenate([members[:shared], members[shared + a :]]))
        small, large = sorted((x, y), key=len)
        for t in (0.6, 0.8):
            if resemblance.jaccard(x, y) >= t:
                assert set(small[: resemblance.prefixes(len(small), t)[0]]) & set(large[: resemblance.prefixes(len(large), t)[1]])


def test_prefixes_meet_every_similar_pair():
    """Copies with edits, moved and repeated parts, and texts with a common passage: every pair at the threshold shares a shingle of the prefixes."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    passage = draw.choices(words, k=120)
    texts = []
    for _ in range(12):
        base = draw.choices(words, k=draw.choice([6, 40, 150])) + (passage if draw.random() < 0.6 else [])
        base = base * draw.choice([1, 1, 2])
        for every in (10_000, 40, 25, 12):
            texts.append(" ".join(draw.choice(words) if draw.randrange(every) == 0 else w for w in base))
        texts.append(" ".join(base[len(base) // 3 :] + base[: len(base) // 3]))
    counts = np.zeros(resemblance.COUNTERS, np.int32)
    for t in texts:
        np.add.at(counts, (resemblance.shingle_set(t) % np.uint64(resemblance.COUNTERS)).astype(np.int64), 1)
    heads = [resemblance.ordered_prefix(t, counts, 0.8, 0.6) for t in texts]
    near = 0
    for i, (a, (x, short_a, _, n)) in enumerate(zip(texts, heads, strict=True)):
        for b, (y, short_b, _, m) in zip(texts[:i], heads, strict=False):
            value = resemblance.similarity(resemblance.shingle_hashes(a), resemblance.shingle_hashes(b))
            if value >= 0.8:
                near += 1
                small, large = (x[:short_a], y) if n <= m else (y[:short_b], x)
                assert len(np.intersect1d(small, large)), value
    assert near > 40


def test_common_passage_is_no_pair():
    """280 words of which 220 are common to all: similar by the floor, and none of the prefixes holds the passage."""
    draw = random.Random(9)
    passage = [f"p{i}" for i in range(220)]
    texts = [" ".join([*passage, *(f"x{draw.randrange(10**9)}" for _ in range(60))]) for _ in range(50)]
    counts = np.zeros(resemblance.COUNTERS, np.int32)
    for t in texts:
        np.add.at(counts, (resemblance.shingle_set(t) % np.uint64(resemblance.COUNTERS)).astype(np.int64), 1)
    heads = [set(resemblance.ordered_prefix(t, counts, 0.8, 0.6)[0].tolist()) for t in texts]
    assert not set.intersection(*heads[:2]) and len(set.union(*heads)) == sum(map(len, heads))


def test_site_template_grows_with_the_documents(spark):
    """1,200 documents that share most of a page but are no copies, and a few real copies among them."""
    draw = random.Random(10)
    passage = " ".join(f"p{i}" for i in range(220))
    own = [" ".join(f"x{draw.randrange(10**9)}" for _ in range(60)) for _ in range(1_200)]
    rows = [(i, f"{passage} {t}") for i, t in enumerate(own)] + [(5_000 + i, f"{passage} {own[i]} more") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    links = {(r["u"], r["v"]) for r in resemblance.resemblance_links(docs).collect()}
    took = time.perf_counter() - began
    assert links == {(i, 5_000 + i) for i in range(5)}
    assert took < 90, took


def test_pairs_meet_at_their_first_shared_shingle(spark, monkeypatch):
    """Documents that share many of the rarest shingles are proposed about once, not once a shingle, and the links are the same."""
    rng, docs = random.Random(16), {}
    passage = [f"p{i}" for i in range(80)]
    for i in range(100):
        words = passage + [f"q{rng.randrange(10**9)}" for _ in range(22)]
        docs[i] = " ".join(words)
    docs[200] = docs[3] + " more"
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    made, real = [], resemblance.checkpoint
    monkeypatch.setattr(resemblance, "checkpoint", lambda d, *a: (made.append(d) if "before" in d.columns else None) or real(d, *a))

    def flat(width):
        def run(batches):
            for _ in batches:
                pass
            yield pd.DataFrame({"n": [np.zeros(1 << 20, np.int32).tobytes()]})

        return run

    # the passage does not count as common, so it is among the first shingles
    monkeypatch.setattr(resemblance, "_counts", flat)
    want = set(all_links(docs))
    assert {tuple(r) for r in resemblance.resemblance_links(df).collect()} == want
    assert made
    rare = made[0]
    small = rare.where("short").select("key", F.col("id").alias("w"), F.col("before").alias("b"))
    pairs = rare.join(small, "key").where("id < w")
    once, every = pairs.where(~F.arrays_overlap("before", "b")), pairs.count()
    assert once.select("id", "w").distinct().count() == pairs.select("id", "w").distinct().count()
    assert once.count() * 4 < every


def test_far_copies_of_a_large_group_are_not_tried_with_each_member(spark, monkeypatch):
    """Texts whose own shingles leave too few for the floor are dropped where they meet the group, and the links are those of all pairs."""
    rng = random.Random(17)
    base = [f"w{i}" for i in range(150)]

    def edited(places, more=0):
        return " ".join([f"x{rng.randrange(10**9)}" if i in places else w for i, w in enumerate(base)] + [f"y{rng.randrange(10**9)}" for _ in range(more)])

    docs = {0: " ".join(base)} | {i: edited({rng.randrange(5, 145)}) for i in range(1, 81)} | {100 + i: edited(set(range(i % 7, 150, 15)), 3) for i in range(30)} | {300: edited({70}, 1)}
    made, real = [], resemblance.checkpoint
    monkeypatch.setattr(resemblance, "checkpoint", lambda d, *a: (made.append(d.count()) if d.columns == ["u", "v"] and not a else None) or real(d, *a))
    found = {tuple(r) for r in resemblance.resemblance_links(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    want = set(all_links(docs))
    assert found <= want and components(found, docs) == components(want, docs)
    assert made and max(made) < 400, made


def test_shingle_counts_over_tasks(spark):
    """Counters of many tasks, empty ones too, are added up to those of all texts."""
    texts = [" ".join(f"w{(i * j) % 17}" for j in range(i % 9 + 4)) for i in range(60)] + [""]
    want = np.zeros(resemblance.COUNTERS, np.int64)
    for t in texts:
        np.add.at(want, (resemblance.shingle_set(t) % np.uint64(resemblance.COUNTERS)).astype(np.int64), 1)
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert want.max() > 1 and np.array_equal(resemblance.shingle_counts(rows.repartition(70)), want)
    assert not resemblance.shingle_counts(rows.where("1 = 0")).any()
