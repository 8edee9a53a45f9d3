import zlib

import numpy as np
import pandas as pd
import pytest

from claimloom.llm import mixing, packing

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


TOKENIZER = tokenizers.Tokenizer.from_file(PATH)


def plain_tokens(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids + [0]


def check_packing(rows, docs, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in docs.items():
        ids = plain_tokens(text)
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [p["start"] for p in pieces] == list(range(0, len(ids), capacity))
        for p in pieces:
            cut = ids[p["start"] : p["start"] + capacity]
            assert p["length"] == len(cut) and p["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
    for items in by_sequence.values():
        at = 0
        for r in sorted(items, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_over_many_partitions(sample_docs):
    docs = {r["doc_id"]: r["text"] for r in sample_docs.collect()}
    rows = packing.pack_documents(sample_docs.repartition(7, "doc_id"), PATH, fan_in=2).collect()
    n, least = check_packing(rows, docs, 2048)
    assert n <= least * 1.02 + 2


def test_packing_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, PATH).collect()
    assert len([r for r in rows if r["doc_id"] == 4]) == 2 and len([r for r in rows if r["doc_id"] is None]) == 1
    assert {r["length"] for r in rows if r["doc_id"] in (3, 4)} == {1}
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 20_001
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_items_that_never_fit_together(spark):
    df = spark.createDataFrame([(i, "a b c d e f") for i in range(40)], "doc_id long, text string").repartition(5)
    rows = packing.pack_documents(df, PATH, capacity=10).collect()
    assert len({r["sequence_id"] for r in rows}) == 40


def test_word_cache_against_the_tokenizer():
    import random

    rng = random.Random(0)
    words = ["don't", "it's", "naïve", "ÀÉ.", "İstanbul", "x</w>y", "<|endoftext|>", "ﬁ", "Ⅷ", "\t\x1c", "5x.", "é", "ß", "Straße,", "ªº", "µ", "\xa0a", "ñ'S", "²", "ΑΣ", "á", "..,", "Ǆ", "WITH!!", "a***"]
    for _ in range(1500):
        text = "".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 6)))
        assert np.frombuffer(next(packing.token_bytes([text], PATH, 50)), "<u4").tolist() == plain_tokens(text)[:-1], text


def test_best_fit():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 5, 4]), 10)
    assert fills.tolist() == [10, 10] and bins.tolist() == [0, 1, 1, 0] and offsets.tolist() == [0, 0, 5, 6]


def test_what_goes_up_the_tree_is_bounded():
    """Best fit leaves at most one bin that is half full or less, and a group passes up that one and `spare` others."""
    rng = np.random.default_rng(1)
    for sizes in (np.full(5000, 1100), rng.integers(1, 2048, 5000), np.r_[np.full(3000, 1100), np.full(20, 900)], np.full(3001, 1024), np.array([5]), rng.integers(900, 1200, 4000)):
        _, _, fills = packing.best_fit(sizes, 2048)
        up = packing.still_open(fills, 2048, 0.998, 8)
        assert (fills <= 1024).sum() <= 2 - (1024 in fills) + (fills == 1024).sum()
        assert up[fills < 1024].all() and (up & (fills > 1024)).sum() <= 8
        shut = fills[~up & (fills > 1024) & (fills < int(2048 * 0.998))]
        assert not len(shut) or fills[up & (fills > 1024)].max() <= shut.min()


def test_two_sizes_over_many_partitions(spark):
    """Documents of six tenths in every partition, some small ones in one: no task gets them all, and all small ones go in."""
    words = lambda n: " ".join(["a"] * n)
    df = spark.createDataFrame([(i, words(59 if i % 10 else 39)) for i in range(2000)], "doc_id long, text string").repartition(40, "doc_id")
    rows = packing.pack_documents(df, PATH, capacity=100, fan_in=3, spare_bins=4).collect()
    n, _ = check_packing(rows, {r["doc_id"]: r["text"] for r in df.collect()}, 100)
    assert n == 1800  # 1,800 of 60, none of which fit together, take the 200 of 40


def test_clashing_names_and_text_ids(spark):
    df = spark.createDataFrame([("7", "a b", 1, 2), ("8", None, 1, 2)], "doc_id string, text string, leaf int, piece int")
    rows = packing.pack_documents(df, PATH).collect()
    assert sorted(r["doc_id"] for r in rows) == [7, 8] and {r["piece"] for r in rows} == {0}


def plain_mix(rows, weights=(5, 2, 1), share=1.5, epochs=2):
    import hashlib

    sources = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    key = lambda d: hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()
    items = []
    for s in sources:
        total = 0
        for d, n in sorted(((d, n) for d, x, n in rows if x == s), key=lambda r: (key(r[0]), r[0] is not None, r[0] or 0, r[1])):
            total += n
            items += [((total + e * size[s]) / weight[s], sources.index(s), key(d), d, n) for e in range(epochs)]
    items.sort(key=lambda i: i[:3])
    taken, used, i = {}, 0, 0
    while i < len(items):
        j = i
        while j < len(items) and items[j][:3] == items[i][:3]:
            j += 1
        used += sum(x[4] for x in items[i:j])
        if used > share * sum(size.values()):
            break
        for x in items[i:j]:
            taken[x[3]] = taken.get(x[3], 0) + x[4]
        i = j
    return taken


def test_mix_against_plain_python(sample_docs):
    got = mixing.mix_sources(sample_docs).collect()
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in sample_docs.collect()]
    assert {r["doc_id"]: r["size"] for r in got} == {d: n for d, _, n in rows}
    want = plain_mix(rows)
    assert {r["doc_id"]: r["taken"] for r in got} == {d: want.get(d, 0) for d, _, _ in rows}
    by = {}
    for r in got:
        t = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        t[0] += r["taken"]
    assert all(abs(t - target) <= 0.1 * target + 4000 and t <= 2 * size for t, target, size in by.values())
    assert sum(t[1] for t in by.values()) == pytest.approx(1.5 * sum(t[2] for t in by.values()))


def test_mix_odd_rows(odd_docs, no_docs):
    rows = mixing.mix_sources(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix_sources(no_docs).count() == 0
    empty = odd_docs.where("doc_id in (3, 4)")
    assert {r["taken"] for r in mixing.mix_sources(empty).collect()} == {0}
    again = mixing.apply_mix(mixing.mix_sources(odd_docs), odd_docs.columns)
    assert again.columns == odd_docs.columns and again.where("doc_id = 4").count() == 0


def test_mix_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", 99, "x")], "doc_id long, text string, source string, taken int, bucket string")
    r = mixing.mix_sources(df).first()
    assert r["size"] == 2 and r["taken"] in (0, 2, 4) and r["bucket"] == "x"


def test_apply_mix_keeps_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 7), (2, "d e", "t", 7)], "doc_id long, text string, source string, __times int")
    again = mixing.apply_mix(mixing.mix_sources(df), df.columns).collect()
    assert {r["__times"] for r in again} == {7}


def _sequences(groups, fan_in, spare_bins, capacity=2048, near=0.998):
    """How many sequences the tree of groups ends with."""
    closed, rest = 0, []
    for part, sizes in enumerate(groups):
        _, _, fills = packing.best_fit(sizes, capacity)
        up = packing.still_open(fills, capacity, near, spare_bins)
        closed += int((~up).sum())
        rest.append(pd.DataFrame({"leaf": np.nonzero(up)[0] + (part << 32), "size": fills[up], "part": part}))
    rest = pd.concat(rest)
    rest = rest.assign(bin=rest["leaf"], shift=0, fill=rest["size"])
    span = 1
    while span < len(groups):
        span *= fan_in
        merged = pd.concat([packing._round(capacity, near, spare_bins)(g) for _, g in rest.groupby(rest["part"] // span)])
        closed += merged[~merged["open"]]["bin"].nunique()
        rest = merged[merged["open"]].drop(columns="open")
    return closed + rest["bin"].nunique()


@pytest.mark.parametrize("fan_in", [2, 32])
@pytest.mark.parametrize("kind", ["mixed", "large", "small"])
def test_bins_passed_up_lose_no_sequence(fan_in, kind):
    """Passing up the emptiest bins alone ends within one sequence of passing up all that are not nearly full."""
    draw = np.random.default_rng(4)
    of = {"mixed": lambda n: np.minimum(draw.lognormal(6, 1.2, n).astype(int) + 1, 2048), "large": lambda n: draw.integers(700, 2049, n), "small": lambda n: draw.integers(1, 400, n)}[kind]
    groups = [of(int(draw.integers(1, 900))) for _ in range(64)]
    capped, whole = _sequences(groups, fan_in, 128), _sequences(groups, fan_in, 10**9)
    assert abs(capped - whole) <= 1
    assert capped >= -(-sum(int(g.sum()) for g in groups) // 2048)
