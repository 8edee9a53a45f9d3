import random

import numpy as np
import xxhash

from claimloom.llm import graph, simhash


def plain_fingerprint(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_is_that_of_the_definition(sample_docs):
    for r in sample_docs.collect():
        assert simhash.fingerprint(r["text"].encode()) % (1 << 64) == plain_fingerprint(r["text"])


def test_spark_hash_agrees(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_every_near_pair_shares_a_home():
    rng = np.random.default_rng(3)
    f = rng.integers(-(2**63), 2**63 - 1, 400)
    for flips in (0, 1, 2):
        g = f.copy()
        for i in range(len(g)):
            for b in rng.choice(64, flips, replace=False):
                g[i] ^= np.array(1 << int(b), dtype=np.uint64).astype(np.int64)
        home, _, _ = simhash.anchors(f, 2)
        _, index, anchor = simhash.anchors(g, 2)
        met = set(zip(index.tolist(), anchor.tolist(), strict=True))
        assert all((i, int(h)) in met for i, h in enumerate(home))


def test_components_against_all_pairs(sample_docs):
    got = {r["doc_id"]: (r["simhash"], r["component_id"]) for r in simhash.simhash_components(sample_docs).collect()}
    prints = {d: f % (1 << 64) for d, (f, _) in got.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = components(links, prints)
    assert len(got) == sample_docs.count() and {d: c for d, (_, c) in got.items()} == want


def test_dense_near_group(spark):
    """Many fingerprints within few bits of one another."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(500)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "f long")).collect()
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert {(r["u"], r["v"]) for r in links} == want


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.simhash_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["component_id"] == by[2][0]["component_id"] == 1
    assert by[3][0]["simhash"] == 0 and by[3][0]["component_id"] == by[4][0]["component_id"] == 3
    assert simhash.simhash_components(no_docs).count() == 0
    kept = simhash.simhash_dedup(odd_docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd_docs.columns and sorted(i for i in ids if i is not None) == [1, 3, 5, 7, 8, 9] and ids.count(None) == 1


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 9), (2, "a b c", 9)], "doc_id long, text string, component_id int")
    assert simhash.simhash_dedup(df).collect()[0][:] == (1, "a b c", 9)


def test_spare_bits_lose_nothing(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(40)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 2}
    df = spark.createDataFrame([(p,) for p in signed], "f long")
    for spare in (5, 17):
        assert {(r["u"], r["v"]) for r in simhash.fingerprint_links(df, spare=spare).collect()} == want
    assert [simhash.spare_bits(n) for n in (0, 10**6, 2**24 - 1, 2**24, 10**10, 10**30)] == [0, 0, 0, 1, 10, 17]


def test_repeated_ids_with_unlike_texts(spark):
    one, two = "alpha beta gamma delta epsilon zeta eta", "quite another text that shares no word with the first"
    rows = [(3, one, 1), (5, one, 1), (5, two, 2), (5, two, 2), (None, two, 3), (9, None, 4), (9, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row_key int")
    kept = simhash.simhash_dedup(df)
    got = sorted(kept.collect(), key=str)
    assert kept.columns == df.columns
    assert sorted((r[0], r[1] or "") for r in got if r[0] is not None) == [(3, one), (5, two), (9, "")] and sum(r[0] is None for r in got) == 1


def test_text_ids(spark):
    rows = [("b", "one two three four"), ("a", "one two three four"), ("c", "something else entirely here"), ("a", "and the a again with more")]
    kept = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted(tuple(r) for r in kept.collect()) == sorted([rows[1], rows[2], rows[3]])


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 450)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = components(edges, {n for e in edges for n in e})
    assert all(got.get(n, n) == c for n, c in want.items())
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_dedup_works_out_components_once(spark, monkeypatch):
    """Links by fingerprints and further ones go into one table of links; copies, near copies and a chain of either come together."""
    texts = ["one two three four five six seven", "one two three four five six seven", "eight nine ten", "", None, "something else of some length altogether", "and a last text that has no copy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs).collect()}
    links = simhash.connected_components(simhash.simhash_links(docs)).collect()
    assert {i: c for i, c in parts.items() if list(parts.values()).count(c) > 1} == {r["node"]: r["component"] for r in links}
    real, calls = simhash.connected_components, []
    monkeypatch.setattr(simhash, "connected_components", lambda e: calls.append(e) or real(e))
    kept = simhash.simhash_dedup(docs, also=lambda d, **_: spark.createDataFrame([(1, 2), (5, 3)], "u long, v long"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 6] and len(calls) == 1
