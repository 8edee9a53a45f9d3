"""Merkle manifest against a plain tree over sorted lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from claimloom.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encode(value):
    if value is None:
        return "-"
    text = str(value)
    return f"{len(text.encode())}:{text}"


def climb(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, i, arity):
    for nodes in levels[:-1]:
        first = i - i % arity
        yield nodes[first:i], nodes[i + 1 : first + arity]
        i //= arity


def plain(rows, arity=3):
    """Counts of (doc_id, leaf, subroot, root, proof, folded, verified) by lists alone; rows are (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = h(*[encode(v) for v in (doc_id, source, lang, n_chars, text)])
        even = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 2 == 0
        bare = text.replace("\n", "") if text is not None and even else text
        groups.setdefault(source, []).append((doc_id, leaf, h(*[encode(v) for v in (doc_id, source, lang, n_chars, bare)])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [climb([leaf for _, leaf, _ in groups[name]], arity) for name in names]
    top = climb([t[-1][0] for t in trees], arity)
    root, out = top[-1][0], []
    for t, name in enumerate(names):
        for i, (doc_id, leaf, shown) in enumerate(groups[name]):
            steps = [*path(trees[t], i, arity), *path(top, t, arity)]
            proof, node = h(*[x for before, after in steps for x in before + after]), shown
            for before, after in steps:
                node = h(*before, node, *after)
            out.append((doc_id, leaf, trees[t][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def ours(docs, **kw):
    found = merkle.merkle_manifest(docs, COLUMNS, merkle.tampered_text(), **kw)
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_table(sample_docs):
    rows = [tuple(r) for r in sample_docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = ours(sample_docs)
    assert got == plain(rows)
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize(("arity", "part_rows", "fan_in"), [(3, 7, 2), (2, 5, 3), (3, 1, 2)])
def test_many_small_parts(spark, docs_schema, arity, part_rows, fan_in):
    """A hot group over many parts, groups of one row, trees of exactly 3^k leaves, repeated ids and rows, nulls."""
    draw = random.Random(arity * 100 + part_rows)
    rows = [(i, f"line {i}\nand more", "en", "hot", 5) for i in range(81)]
    rows += [(draw.randrange(40), draw.choice(["a\nb", "", None, "ü\n"]), None, f"s{draw.randrange(12)}", None) for _ in range(60)]
    rows += [(None, "x\n", "en", None, 1)] * 5 + [(7, "same\nrow", "de", "s3", 3)] * 4 + [(1, "one", "en", "é", 1)]
    docs = spark.createDataFrame(rows, docs_schema).withColumn("leaf", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("grp", F.lit(2))
    assert ours(docs, arity=arity, part_rows=part_rows, fan_in=fan_in) == plain(rows, arity)


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.collect()]
    assert ours(odd_docs) == plain(rows)
    assert ours(no_docs) == []
    one = odd_docs.where("doc_id = 7")
    ((_, leaf, subroot, root, proof, folded, verified),) = ours(one)
    assert leaf == subroot == root == folded and proof == h() and verified


def test_proofs_fold(sample_docs):
    """The siblings given are those that lead from the leaf to the root."""
    found = merkle.merkle_manifest(sample_docs, COLUMNS, with_proof=True).collect()
    assert all(r["verified"] for r in found)
    assert all(h(*r["proof"]) == r["proof_sha256"] for r in found)


def test_forests_are_a_monoid():
    """Any order and grouping of merges gives the same forest."""
    leaves = [h(str(i)).encode() for i in range(100)]
    want = climb([x.decode() for x in leaves], 3)[-1][0]
    for seed in range(20):
        draw = random.Random(seed)
        cuts = sorted(draw.sample(range(1, 100), 9))
        forests = []
        for a, b in zip([0, *cuts], [*cuts, 100], strict=True):
            forest = merkle.Forest({merkle.TOP: 1, 0: 100})
            for i in range(a, b):
                forest.add(0, 0, i, leaves[i])
            assert sum(1 for _ in forest.items()) <= 4 * 5
            forests.append(forest)
        while len(forests) > 1:
            a, b = draw.sample(range(len(forests)), 2)
            merged = forests[a].merge(forests[b])
            forests = [f for i, f in enumerate(forests) if i not in (a, b)] + [merged]
        assert list(forests[0].items()) == [(merkle.TOP, 0, 0, want.encode())]


def test_missing_column(sample_docs):
    with pytest.raises(ValueError, match="missing"):
        merkle.merkle_manifest(sample_docs.drop("lang"), COLUMNS)
