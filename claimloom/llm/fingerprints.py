"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles, so the
sketches of parts merge into the sketch of the whole, and two sketches estimate
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm._common import forgets, fresh, require, text_of, working

WIDTH = 5
K = 256
#: Hashes are cut to so many hex digits when written.
DIGITS = 10
CHUNK = 1 << 17
_TOP = np.uint64((1 << 4 * DIGITS) - 1)


class _WordHashes(dict):
    """Hashes of words, kept between texts; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = value
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


forgets("fingerprints", _word_hashes.cache_clear)


def _mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit multiply-xorshift hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashes of the shingles in order; fewer words than `width` make one shingle, none no shingle."""
    known = _word_hashes()
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(len(h), width)))
    for i in range(min(width, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending, cut to the digits that are kept."""
    h = hashes & _TOP
    if len(h) > 8 * k:
        # enough of the smallest that k distinct ones are among them, unless repeats crowd them out
        few = np.unique(np.partition(h, 4 * k)[: 4 * k])
        if len(few) > k:  # the largest found may be one of several equal ones: harmless, they are equal
            return few[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together, if no shingle spans them."""
    return np.unique(np.concatenate([a, b]))[:k]


def sketch(text: str, k: int = K, width: int = WIDTH) -> np.ndarray:
    return bottom_k(shingle_hashes(text, width), k)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact for sketches that hold all shingles. Two empty ones: 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, shared, assume_unique=True).sum()) / len(both)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    if len(a) < k:
        return float(len(a))
    return (k - 1) / ((float(a[-1]) + 1) / (float(_TOP) + 1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; an empty a is contained."""
    if not len(a):
        return 1.0
    union = distinct_count(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    return "".join([f"{x:0{DIGITS}x}" for x in a.tolist()])


def from_text(text: str) -> np.ndarray:
    return np.array([int(text[i : i + DIGITS], 16) for i in range(0, len(text), DIGITS)], np.uint64)


def sketch_documents(docs: DataFrame, k: int = K, width: int = WIDTH, text_col: str = "text") -> DataFrame:
    """`docs` with columns fingerprint (string) and n_shingles (estimated).

    A null or empty text has the empty fingerprint and no shingle. Texts are sketched
    whole, whatever their length. Repeated rows stay; an empty table gives an empty
    result. Columns of `docs` called fingerprint or n_shingles, in any case, are replaced.
    """
    require(docs, text_col)
    name = fresh(docs, "__sketch")

    @F.pandas_udf("fingerprint string, n_shingles double")
    def udf(texts: pd.Series) -> pd.DataFrame:
        found = [sketch(t, k, width) for t in texts]
        return pd.DataFrame({"fingerprint": [to_text(x) for x in found], "n_shingles": [distinct_count(x, k) for x in found]})

    return docs.withColumn(name, udf(text_of(text_col))).select(*[c for c in docs.columns if c.lower() not in ("fingerprint", "n_shingles")], f"{name}.fingerprint", f"{name}.n_shingles")


def _ranges(docs: DataFrame, id_col: str) -> list[int]:
    """Inner bounds, one fewer than shuffle partitions, of ranges of about equal size over the ids."""
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / n for i in range(1, n)]
    got = docs.agg(F.percentile_approx(id_col, shares, 20 * n).alias("p")).first()["p"] if shares else None
    return sorted(set(got or []))


def _range_of(bounds: list[int]):
    """Number of the range of an id: 0 holds the largest ids, the last also nulls."""
    cuts = np.array(bounds, np.int64)

    @F.pandas_udf(T.IntegerType())
    def number(ids: pd.Series) -> pd.Series:
        null = ids.isna().to_numpy()
        found = len(cuts) - np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(null, len(cuts), found), dtype="int32")

    return number


def with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, rng, copy) in ranges of ids, one partition each, every row followed by its successor by descending id.

    The first row of each range is also sent to the range before it, after that range's
    last row (copy = 1); the very first follows the very last. Ties on the id are
    ordered by text, null ids come last.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    bounds = _ranges(base, "id")
    base = base.withColumn("rng", _range_of(bounds)("id") if bounds else F.lit(0))
    least = F.coalesce("id", F.lit(-(1 << 63)))
    first = base.groupBy("rng").agg(F.max(F.struct(least.alias("o"), F.sha2("text", 256).alias("t"))).alias("m"))
    found = {r["rng"]: r["m"] for r in first.collect()}  # one row per range
    rows = base.withColumn("copy", F.lit(0))
    if found:
        order = sorted(found)
        heads = docs.sparkSession.createDataFrame([(found[b]["o"], found[b]["t"], order[i - 1]) for i, b in enumerate(order)], "o long, t string, to int")
        copies = base.join(F.broadcast(heads), least == F.col("o")).where(F.sha2("text", 256) == F.col("t"))
        rows = rows.unionByName(copies.dropDuplicates(["to"]).select("id", "text", F.col("to").alias("rng"), F.lit(1).alias("copy")))
    placed = rows.repartitionById(len(bounds) + 1, F.col("rng"))
    return placed.sortWithinPartitions("copy", F.col("id").desc_nulls_last(), F.sha2("text", 256).desc())


def _edited(text: str, following: str) -> str:
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def _compare(k: int, width: int):
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for pdf in batches:
            out = []
            for id_, text in zip(pdf["id"], pdf["text"], strict=True):
                now = (id_, text, sketch(text, k, width))
                if before is not None:
                    was, old, mark = before
                    new = _edited(old, text)
                    other = sketch(new, k, width)
                    out.append((was, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), to_text(mark), to_text(other), resemblance(mark, other, k), resemblance(mark, now[2], k), distinct_count(mark, k), containment(mark, other, k)))
                before = now
            if out:
                frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "contained"])
                yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with working("fingerprints"):
            yield from compared(batches)

    return run


def compare_with_edited(docs: DataFrame, k: int = K, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's sketch against that of its edited text and of the next document.

    Edited: the last half of the code points (rounded down) replaced by the first as
    many of the next document by descending id, which for the last is the first; a
    lone document follows itself. n_shingles estimates the text's distinct shingles and
    contained the share of them that the edited text has, too. Null texts count as
    empty and have no shingle; ties on the id are ordered by text, null ids come last;
    ids must be whole numbers or text that reads as such. Texts are sketched whole,
    whatever their length. An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    require(docs, id_col, text_col)
    return with_successor(docs, id_col, text_col).mapInPandas(_compare(k, width), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, contained double").withColumnRenamed("doc_id", id_col)
