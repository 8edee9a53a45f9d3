"""Links between documents whose five-word shingles resemble each other, for the pipeline's near-duplicate stage.

A SimHash at two bits finds copies that hardly differ; edited copies are usually four to
twelve bits apart, which no covering code reaches at a bearable number of replicas. So
the stage adds these links: one-permutation minima of the shingle hashes key bands,
documents that share a band are proposed, a bottom-k sketch drops what is far below, and
the similarity of the whole texts decides.

The similarity of two texts is the Jaccard similarity of their shingle sets or, from a
Jaccard similarity of `FLOOR` on, the share of words that stand in shared shingles (in
the text where it is less) if that is more. An edit of one word spoils five shingles of
either text, so a copy with one word in thirty changed has a Jaccard similarity of about
0.7 though all but a few of its words stand in shared shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm._common import TEXTS, checkpoint, text_of, working
from claimloom.llm.fingerprints import _mix, shingle_hashes
from claimloom.llm.graph import connected_components
from claimloom.operators.retrieval import broadcast_if_small

#: Least Jaccard similarity of a linked pair.
FLOOR = 0.6
#: Bands of two minima each (at FLOOR one pair in 8,000 shares none); entries of a sketch, 32 bits each.
BANDS, ENTRIES = 20, 128
#: How far a sketch may underrate a pair: at FLOOR over four and a half standard deviations.
MARGIN = 0.2
#: All pairs of a band with at most so many documents are proposed; documents of larger ones meet by their rarest shingles.
FEW = 64
#: Counters that tell common shingles from rare ones; they set an order, the links do not depend on it.
COUNTERS = 1 << 20
#: Shingles before one that tell whether two documents have met by then; fewer propose a pair more often, the pairs are the same.
BEFORE = 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """The distinct shingle hashes of the lower-cased text, ascending."""
    return np.unique(shingle_hashes(text.lower(), width))


def sketch_and_bands(text: str, width: int = 5) -> tuple[bytes, list[int]]:
    """The `ENTRIES` smallest shingle hashes (top 32 bits, ascending) and the keys of the bands, of the lower-cased text."""
    return _sketch_and_bands(shingle_set(text, width))


def _sketch_and_bands(h: np.ndarray) -> tuple[bytes, list[int]]:
    low = np.unique((h[: 4 * ENTRIES] >> np.uint64(32)).astype("<u4"))[:ENTRIES].tobytes()
    if not len(h):
        return low, []
    bins = 2 * BANDS
    g = _mix(h ^ _GOLD)
    of = (g % np.uint64(bins)).astype(np.int64)
    order = np.lexsort((g, of))
    used, first = np.unique(of[order], return_index=True)
    least = g[order][first]
    # an empty bin borrows from the next one that has something
    at = np.searchsorted(used, np.arange(bins)) % len(used)
    minima = _mix(least[at] + (used[at] != np.arange(bins)) * _GOLD)
    keys = _mix(minima[0::2] * _GOLD + minima[1::2] + np.arange(BANDS, dtype=np.uint64))
    return low, keys.view(np.int64).tolist()


def alike(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two sketches."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.union1d(x, y)[:ENTRIES]
    return float((np.isin(both, x, assume_unique=True) & np.isin(both, y, assume_unique=True)).sum()) / len(both)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def covered(h: np.ndarray, shared: np.ndarray, width: int = 5) -> float:
    """Share of the words of a text (shingle hashes `h` in order) that stand in a shingle of `shared`."""
    at = np.nonzero(np.isin(h, shared))[0]
    ends = np.bincount(at, minlength=len(h) + width) - np.bincount(at + width, minlength=len(h) + width)[: len(h) + width]
    return float((np.cumsum(ends)[: len(h) + width - 1] > 0).mean())


def similarity(a: np.ndarray, b: np.ndarray, floor: float = FLOOR, width: int = 5) -> float:
    """Of two texts by their shingle hashes in order: see above."""
    x, y = np.unique(a), np.unique(b)
    near = jaccard(x, y)
    if near < floor - 1e-9 or not len(x):
        return near
    shared = np.intersect1d(x, y, assume_unique=True)
    return max(near, min(covered(a, shared, width), covered(b, shared, width)))


def prefixes(n: int, threshold: float) -> tuple[int, int]:
    """How many of a set's n members, in one order for all sets, meet every similar set: (of the smaller set, of the larger).

    At `threshold` the sets share at least 2t / (1 + t) of the smaller and t of the
    larger, so the first member that they share is no later in either.
    """
    if n == 0:
        return 0, 0
    need = lambda part: n - int(np.ceil(part * n - 1e-9)) + 1
    return need(2 * threshold / (1 + threshold)), need(threshold)


def covering_prefix(h: np.ndarray, rank: np.ndarray, share: float, width: int = 5) -> int:
    """How many of the shingles that come first leave the rest with under `share` of the text's words.

    `h` are the shingle hashes in order, `rank` each one's place in the order of the
    distinct. Two texts that have the share of their words in shared shingles share one
    of the first so many of either: else all they share lies in the rest.
    """
    if not len(h):
        return 0
    padded = np.concatenate([np.full(width - 1, -1), rank, np.full(width - 1, -1)])
    # a word is covered by the rest as long as the last of its shingles in the order is not among the first
    last = np.max([padded[i : i + len(h) + width - 1] for i in range(width)], axis=0)
    need = int(np.ceil(share * len(last) - 1e-9))
    return int(np.partition(last, len(last) - need)[len(last) - need]) + 1


def ordered_prefix(text: str, counts: np.ndarray, threshold: float, floor: float, width: int = 5) -> tuple[np.ndarray, int, int, int]:
    """(distinct shingles of a text, rarest first, as far as they have to be compared; how many of them where it is the smaller; where the larger; all).

    Every pair that `similarity` puts at the threshold shares one of these: by its
    Jaccard similarity, or, at the floor, by the words in shared shingles.
    """
    seq = shingle_hashes(text.lower(), width)
    h, at = np.unique(seq, return_inverse=True)
    order = np.lexsort((h, counts[(h % np.uint64(COUNTERS)).astype(np.int64)]))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    cover = covering_prefix(seq, rank[at], threshold, width)
    short, long = (max(high, min(low, cover)) for high, low in zip(prefixes(len(h), threshold), prefixes(len(h), floor), strict=True))
    return h[order[:long]], short, long, len(h)


def _rows(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with working("fingerprints"):
            for pdf in batches:
                sets = [shingle_set(t, width) for t in pdf["text"]]
                found = [_sketch_and_bands(h) for h in sets]
                yield pd.DataFrame({"id": pdf["id"], "whole": [sha256(h.tobytes()).digest()[:16] for h in sets], "sketch": [s for s, _ in found], "keys": [k for _, k in found]})

    return run


def _counts(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with working("fingerprints"):
            n = np.zeros(COUNTERS, np.int32)
            for pdf in batches:
                for t in pdf["text"]:
                    np.add.at(n, (shingle_set(t, width) % np.uint64(COUNTERS)).astype(np.int64), 1)
            yield pd.DataFrame({"n": [n.tobytes()]})

    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n = np.zeros(COUNTERS, np.int32)
    for pdf in batches:
        for more in pdf["n"]:
            n += np.frombuffer(more, np.int32)
    yield pd.DataFrame({"n": [n.tobytes()]})


def shingle_counts(texts: DataFrame, width: int = 5) -> np.ndarray:
    """In how many of the texts (column text) each counter's shingles stand, added up in a tree of tasks.

    The tree's tasks take the Python workers that count: an executor that holds others
    beside them, as for an RDD's functions, needs their memory twice.
    """
    counts = texts.select("text").mapInPandas(_counts(width), "n binary")
    for tasks in (ceil(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5), 1):
        counts = counts.repartition(tasks).mapInPandas(_summed, "n binary")
    return np.frombuffer(counts.first()["n"], np.int32)


def _rare(width: int, threshold: float, floor: float, counts: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with working("fingerprints"):
            for pdf in batches:
                out = []
                for i, c, t in zip(pdf["id"], pdf["comp"], pdf["text"], strict=True):
                    first, short, _, n = ordered_prefix(t, counts, threshold, floor, width)
                    out.append(pd.DataFrame({"id": i, "comp": c, "n": n, "key": first.view(np.int64), "pos": np.arange(len(first), dtype=np.int32), "short": np.arange(len(first)) < short}))
                if out:
                    yield pd.concat(out)

    return run


@F.pandas_udf(T.DoubleType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _exact(width: int, floor: float):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        with working("fingerprints"):
            of = lru_cache(maxsize=256)(lambda t: shingle_hashes(t.lower(), width))
            for a, b in batches:
                yield pd.Series([similarity(of(x), of(y), floor, width) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


def resemblance_links(docs: DataFrame, threshold: float = 0.8, width: int = 5, floor: float = FLOOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, v) of ids whose texts are similar by `threshold` or more; their components are those of all such pairs that share a band.

    Ids are whole numbers that tell rows apart (simhash.row_keys gives them for other
    tables); null ids are left out, of rows that repeat an id any one counts. Equal sets
    of shingles are linked to the smallest id that has one, and only that one goes on;
    so texts without words, null ones too, are linked. A document is tried first
    against the heads of its bands (the first by id and the first by a hash of the id),
    so groups of copies come together by links that grow with the documents. What
    shares a band and is not together by then is tried pair by pair: in bands of few
    documents all pairs, in others the pairs that share one of the rarest shingles,
    which every pair at the floor does. Other columns are ignored, whatever their names;
    an empty table gives no link.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = checkpoint(base.mapInPandas(_rows(width), "id long, whole binary, sketch binary, keys array<long>"), TEXTS)
    first = rows.groupBy("whole").agg(F.min("id").alias("rep"))
    same = rows.select("id", "whole").join(first, "whole").where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    entries = rows.select("id", "keys").join(first.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", F.explode("keys").alias("key"))
    heads = entries.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("i")))["i"].alias("b")).where("a < z").drop("z")
    # most keys are one document's; only the others go on
    entries = checkpoint(entries.join(heads, "key"))
    sketches = checkpoint(rows.select("id", "sketch").join(entries.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]))

    def rated(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sketches.select(F.col("id").alias("u"), F.col("sketch").alias("su")), "u").join(sketches.select(F.col("id").alias("v"), F.col("sketch").alias("sv")), "v")
        return near.withColumn("rate", _alike("su", "sv")).drop("su", "sv").where(F.col("rate") >= floor - MARGIN)

    def decided(pairs: DataFrame) -> DataFrame:
        """The pairs at the threshold; only texts of documents in a pair are moved."""
        pairs = checkpoint(pairs.select("u", "v").distinct())
        ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        text = base.join(broadcast_if_small(ids), "id", "left_semi").dropDuplicates(["id"])
        both = pairs.join(text.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u").join(text.select(F.col("id").alias("v"), F.col("text").alias("tv")), "v")
        return checkpoint(both.where(_exact(width, floor)("tu", "tv") >= threshold - 1e-9).select("u", "v"), TEXTS // 2)

    met = entries.select("id", F.explode(F.array_distinct(F.array("a", "b"))).alias("head")).where("id <> head").select(F.least("id", "head").alias("u"), F.greatest("id", "head").alias("v")).distinct()
    # of its heads, a document is tried against the first that is likely and against the likeliest
    tried = rated(met).groupBy("v").agg(F.min(F.when(F.col("rate") >= floor, F.col("u"))).alias("p"), F.max(F.struct("rate", (-F.col("u")).alias("u")))["u"].alias("q"))
    tried = tried.select(F.explode(F.array_distinct(F.array_compact(F.array("p", -F.col("q"))))).alias("u"), "v")
    links = decided(tried)
    parts = checkpoint(connected_components(links))

    # what shares a band and is not together yet
    placed = entries.select("key", "id").join(parts.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    open_ = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "n")
    placed = checkpoint(placed.join(open_, "key"))
    few = placed.where(F.col("n") <= FEW)
    other = few.select("key", F.col("id").alias("w"), F.col("comp").alias("c"))
    proposed = few.join(other, "key").where((F.col("id") < F.col("w")) & (F.col("comp") != F.col("c"))).select(F.col("id").alias("u"), F.col("w").alias("v"))
    many = checkpoint(placed.where(F.col("n") > FEW).select("id", "comp").distinct())
    if not many.isEmpty():
        text = base.join(broadcast_if_small(many), "id").dropDuplicates(["id"])
        # counted over all of these documents, added up in a tree: a passage that many share comes last whatever its share of them
        counts = shingle_counts(text, width)
        rare = checkpoint(text.mapInPandas(_rare(width, threshold, floor, counts), "id long, comp long, n int, key long, pos int, short boolean"), TEXTS)
        open_ = rare.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        # shingles are in one order for all, so two documents that share one meet there first: where they share one of the last before it, they have met
        before = F.collect_list("key").over(Window.partitionBy("id").orderBy("pos").rowsBetween(-BEFORE, -1))
        rare = checkpoint(rare.join(open_, "key").withColumn("before", before))
        small = rare.where("short").select("key", F.col("id").alias("w"), F.col("comp").alias("c"), F.col("n").alias("m"), F.col("before").alias("b"), F.col("pos").alias("at"))
        # where they meet first, all that they share is still to come in either
        reach = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) >= (F.col("n") + F.col("m")) * (floor / (1 + floor)) - 1e-6
        fits = ~F.arrays_overlap("before", "b") & (F.struct("m", "w") < F.struct("n", "id")) & reach & (F.col("m") >= F.col("n") * floor - 1e-6) & (F.col("comp") != F.col("c"))
        proposed = proposed.union(rare.join(small, "key").where(fits).select(F.least("id", "w").alias("u"), F.greatest("id", "w").alias("v")))
    more = decided(rated(proposed.distinct()))
    return links.union(more).union(same)
