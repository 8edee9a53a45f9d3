"""SimHash near-duplicate detection by anchor-point covering.

The anchors are the words of a covering code. The first 46 bits of a fingerprint are
cut into two blocks of 23; the binary Golay code covers each block with radius 3, so a
pair of Golay words covers all fingerprints with radius 6. A fingerprint lives at its
nearest anchor ("home") and is replicated to every anchor that some fingerprint within
the threshold may call home, all of them within the covering radius plus the threshold.
Two linked fingerprints therefore always meet at the home of either one, and are
compared there on all 64 bits. Nothing is lost and no bucket is capped. Of the bits
that are left, up to 17 join the anchors (each its own code word, radius 0), as many as
keep the anchors more numerous than the distinct fingerprints, so a home stays small
however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm._common import TEXTS, checkpoint, fresh, require, text_bytes, working
from claimloom.llm.graph import connected_components
from claimloom.operators.numbering import bucket_of, numbered

SEED = 42
BLOCK = 23
#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
#: Shingles whose bits are counted at once; bounds memory on very long texts.
CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash (signed) of the shingles of `width` words, repeats included.

    A-Z are lower-cased; fewer words than `width` make one shingle of them all; no
    word at all gives zero. A bit is set if it is set in more than half the hashes.
    """
    words = text.lower().split()
    if not words:
        return 0
    last = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, last, CHUNK):
        part = words[at : min(at + CHUNK, last) + width - 1]
        runs = zip(*(part[i:] for i in range(width)), strict=False) if len(part) >= width else [part]
        hashes = np.fromiter((digest(b" ".join(run), SEED) for run in runs), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<i8")[0])


def fingerprint_udf(width: int = 3):
    def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with working("simhash"):
            for texts in parts:
                yield pd.Series([fingerprint(t or b"", width) for t in texts], dtype="int64")

    return F.pandas_udf(simhash, "long")


def _remainder(word: int) -> int:
    for i in range(BLOCK - 1, 10, -1):
        if word >> i & 1:
            word ^= GOLAY << (i - 11)
    return word


@lru_cache(maxsize=4)
def _reach(threshold: int) -> list[np.ndarray]:
    """For each e up to the threshold an array [syndrome, k] of the offsets from a block to the anchors that e flips, and no fewer, may lead to; -1 pads."""
    columns = [_remainder(1 << i) for i in range(BLOCK)]
    patterns = [(sum(1 << i for i in c), int(np.bitwise_xor.reduce([columns[i] for i in c] or [0]))) for k in range(4) for c in combinations(range(BLOCK), k)]
    leader = {s: p for p, s in patterns}
    assert len(leader) == 2048  # the code is perfect
    flips = [[(p, s) for p, s in patterns if p.bit_count() == e] for e in range(threshold + 1)]
    by_level: list[list[list[int]]] = [[[] for _ in range(2048)] for _ in flips]
    for syndrome in range(2048):
        known: set[int] = set()
        for e, level in enumerate(flips):
            new = {p ^ leader[syndrome ^ s] for p, s in level} - known
            known |= new
            by_level[e][syndrome] = sorted(new)
    tables = []
    for level in by_level:
        grid = np.full((2048, max(1, max(map(len, level)))), -1, dtype=np.int64)
        for syndrome, offsets in enumerate(level):
            grid[syndrome, : len(offsets)] = offsets
        tables.append(grid)
    return tables


def _syndromes(blocks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(blocks), dtype=np.int64)
    for i in range(BLOCK):
        out ^= (blocks >> i & 1) * _remainder(1 << i)
    return out


def spare_bits(distinct: int) -> int:
    """How many of the bits outside the blocks join the anchors, so that 2^24 and more anchors outnumber the fingerprints."""
    return min(63 - 2 * BLOCK, max(0, distinct.bit_length() - 24))


def anchors(fingerprints: np.ndarray, threshold: int = 2, spare: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchor of each fingerprint, index of the fingerprint, anchor) - the last two for every replica."""
    f = fingerprints.astype(np.int64).view(np.uint64)
    mask = np.uint64((1 << BLOCK) - 1)
    blocks = [(f & mask).astype(np.int64), (f >> np.uint64(BLOCK) & mask).astype(np.int64)]
    tables = _reach(threshold)
    near = [[b[:, None] ^ t[s] for t in tables] for b, s in ((b, _syndromes(b)) for b in blocks)]
    real = [[t[_s] >= 0 for t in tables] for _s in map(_syndromes, blocks)]
    rest = (f >> np.uint64(2 * BLOCK) & np.uint64((1 << spare) - 1)).astype(np.int64) << 2 * BLOCK
    home = near[0][0][:, 0] | near[1][0][:, 0] << BLOCK | rest
    index, out = [], []
    for e3 in range(threshold + 1):
        for flip in (sum(1 << i for i in c) << 2 * BLOCK for c in combinations(range(spare), e3)):
            for e1 in range(threshold + 1 - e3):
                for e2 in range(threshold + 1 - e3 - e1):
                    both = near[0][e1][:, :, None] | near[1][e2][:, None, :] << BLOCK | (rest ^ flip)[:, None, None]
                    keep = real[0][e1][:, :, None] & real[1][e2][:, None, :]
                    index.append(np.nonzero(keep)[0])
                    out.append(both[keep])
    return home, np.concatenate(index), np.concatenate(out)


def _homes(spare: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = pdf["f"].to_numpy()
            yield pd.DataFrame({"anchor": anchors(f, 0, spare)[0], "f": f})

    return run


def _replicas(threshold: int, spare: int):
    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with working("simhash"):
            for pdf in batches:
                f = pdf["f"].to_numpy()
                for at in range(0, len(f), 2000):
                    _, index, anchor = anchors(f[at : at + 2000], threshold, spare)
                    yield pd.DataFrame({"anchor": anchor, "g": f[at : at + 2000][index]})

    return replicate


def fingerprint_links(distinct: DataFrame, threshold: int = 2, spare: int | None = None) -> DataFrame:
    """Pairs u < v of the distinct fingerprints (column f) at most `threshold` (0 to 3) bits apart.

    A fingerprint has at most 2,080 others within two bits, so links grow linearly.
    `spare` bits beside the blocks join the anchors; None takes them from the count.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("threshold must be 0 to 3")
    spare = spare_bits(distinct.count()) if spare is None else spare
    homes = distinct.select("f").mapInPandas(_homes(spare), "anchor long, f long")
    replicas = distinct.select("f").mapInPandas(_replicas(threshold, spare), "anchor long, g long")
    near = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= threshold
    return homes.join(replicas, (homes["anchor"] == replicas["anchor"]) & (F.col("f") != F.col("g")) & near).select(F.least("f", "g").alias("u"), F.greatest("f", "g").alias("v")).distinct()


def _prints(docs: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, f) of every document, and (f, least) of every fingerprint with the smallest id that has it."""
    prints = checkpoint(docs.select(F.col(id_col).alias("id"), fingerprint_udf(width)(text_bytes(text_col)).alias("f")), TEXTS)
    return prints, checkpoint(prints.groupBy("f").agg(F.min("id").alias("least")))


def simhash_links(docs: DataFrame, threshold: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, v) of ids whose components are those of simhash_components(): a fingerprint's smallest id to its other ids and to those of the fingerprints near it.

    For what has further links to add: their components are worked out once, together.
    """
    require(docs, id_col, text_col)
    prints, distinct = _prints(docs, width, id_col, text_col)
    same = prints.join(distinct, "f").where("id <> least").select(F.col("least").alias("u"), F.col("id").alias("v"))
    near = fingerprint_links(distinct, threshold)
    for end in ("u", "v"):
        near = near.join(distinct.select(F.col("f").alias(end), F.col("least").alias(f"{end}_id")), end)
    return same.union(near.select(F.col("u_id").alias("u"), F.col("v_id").alias("v")))


def simhash_components(docs: DataFrame, threshold: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc id, simhash long, component id) - one row per row of `docs`.

    Documents link if their fingerprints differ in at most `threshold` bits; the
    component id is the smallest id reachable. A null text counts as empty and an empty
    text has fingerprint zero, which links like any other. Null ids never name a
    component unless all of its ids are null. Repeated rows and ids give repeated rows.
    Texts of any length are read whole, a chunk of shingles at a time. Ids are of any
    ordered type. Other columns are ignored, whatever their names. An empty table gives
    an empty result.
    """
    require(docs, id_col, text_col)
    prints, distinct = _prints(docs, width, id_col, text_col)
    parts = checkpoint(connected_components(fingerprint_links(distinct, threshold)))
    named = parts.join(distinct, parts["node"] == distinct["f"]).groupBy("component").agg(F.min("least").alias("name"))
    of_print = parts.join(named, "component").select(F.col("node").alias("f"), "name")
    # written down first, so that the join below reads two plain shuffles and a busy fingerprint can be split
    all_prints = checkpoint(distinct.join(of_print, "f", "left").select("f", F.coalesce("name", "least").alias("component_id")))
    return prints.join(all_prints, "f").select(F.col("id").alias(id_col), F.col("f").alias("simhash"), "component_id")


def row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """`docs` and the name of a whole-number column that tells its rows apart by id and text; null where the id is null.

    That is the id itself if it is a whole number and never repeated; else a number
    added here, in the order of id, then of the text's digest.
    """
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"))
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    if whole and ids.groupBy("id").count().where("count > 1").isEmpty():
        return docs, id_col
    digest, key, of, told = (fresh(docs, f"__row_{n}") for n in ("digest", "key", "id", "told"))
    docs = docs.withColumn(digest, F.sha2(text_bytes(text_col), 256))
    pairs = checkpoint(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(of), F.col(digest).alias(told)).distinct())
    numbers = checkpoint(numbered(pairs, bucket_of(pairs, of), [of, told], key))
    keyed = docs.join(numbers, (docs[id_col] == numbers[of]) & (docs[digest] == numbers[told]), "left")
    return keyed.drop(digest, of, told), key


def simhash_dedup(docs: DataFrame, threshold: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text", also: Callable[..., DataFrame] | None = None) -> DataFrame:
    """`docs` with one document of each component: that with the component's smallest id.

    `also` gives further links (u, v): it is called with the documents and the name of
    the column that tells them apart. All columns are kept, whatever their names. Rows
    that repeat id and text are copies, of which any one stays; rows that repeat only
    the id are documents of their own, the lesser by digest first. Rows with a null id
    can't be told apart, so they all stay. Null and empty texts are copies of one
    another. An empty table gives an empty result.
    """
    require(docs, id_col, text_col)
    docs_, key = row_keys(docs, id_col, text_col)
    named, gone = docs_.where(F.col(key).isNotNull()), fresh(docs_, "gone_id")
    if also is None:
        dropped = simhash_components(named, threshold, width, key, text_col).where(F.col(key) != F.col("component_id")).select(F.col(key).alias(gone))
    else:
        links = simhash_links(named, threshold, width, key, text_col).union(also(docs_, id_col=key, text_col=text_col).select("u", "v"))
        dropped = connected_components(links).where("node <> component").select(F.col("node").alias(gone))
    dropped = checkpoint(dropped.distinct())
    kept = docs_.join(dropped, docs_[key] == dropped[gone], "left_anti")
    if key == id_col:
        return kept
    return kept.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.where(F.col(key).isNull())).drop(key)
