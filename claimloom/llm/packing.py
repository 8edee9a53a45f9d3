"""Best-fit packing of token sequences by hierarchical residual packing.

Level 0 runs where the documents lie: each partition tokenizes its documents, cuts the
long ones, best-fits the remainders (largest first) and closes every bin that is nearly
full. What stays underfull goes up a tree: the bins of `fan_in` neighbouring groups meet,
are best-fitted again as items, and nearly full ones are closed, until one group is left.

Best fit leaves a group at most one bin that is half full or less, as the first item of
a second one would have gone into the first. So a bin above half can only take in what
few small bins other groups have, and of those a group passes up just the emptiest
`spare_bins`: what fits into any bin fits into them. A task thus never gets more than
fan_in * (spare_bins + 1) bins, whatever the sizes and however large the table.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm._common import TEXTS, checkpoint, forgets, require, text_of, working

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker keeps; as many again that were used before. Characters of text that are split into words at once.
CACHE, CHARS = 200_000, 1 << 19


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Runs of these are one word to the vocabulary. Apostrophes may start a contraction.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Recent(dict):
    """A dictionary of what was used lately: when full, its entries age, and go if not used again before it is full once more."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def age(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def missing(self, keys: set) -> set:
        """Keys that aren't known; those that have aged come back."""
        new = keys.difference(self)
        back = self.old.keys() & new
        self.update((k, self.old[k]) for k in back)
        return new - back


class _Pieces:
    """White-space-delimited strings to their ids as little-endian bytes, each found once while it is in use.

    In texts of Latin-1 letters the normaliser only lower-cases, and a run of letters is
    one word to the vocabulary whatever stands beside it; it goes to the model as it is.
    """

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.letters, self.marks = _Recent(limit), _Recent(limit), {}
        self.symbols = str.maketrans({chr(b): s for b, s in _byte_symbols().items()})

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, letters: str) -> bytes:
        symbols = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.symbols)
        ids = array("I", [t.id for t in self.model.tokenize(symbols)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _learn(self, new: set[str]) -> None:
        self.letters.age()
        words, known, old, marks = self.words, self.letters, self.letters.old, self.marks
        for word in new:
            core = word.rstrip(_MARKS)
            if not (core.isalpha() and core.islower() and (core.isascii() or _latin(core))):
                words[word] = self.encode(word)
                continue
            ids = known.get(core)
            if ids is None:
                known[core] = ids = old.get(core) or self._word(core)
            if core is not word and (mark := word[len(core) :]):
                if mark not in marks:
                    if len(marks) > 10_000:
                        marks.clear()
                    marks[mark] = self.encode(mark)
                ids += marks[mark]
            words[word] = ids

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; a few texts at a time, so that what is new in them is learnt together."""
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (size < CHARS or not split):
                text = texts[at]
                split.append((text.lower() if _latin(text) else text).replace("\n", " ").split(" "))
                size += len(text)
                at += 1
            self.words.age()
            if new := self.words.missing(set().union(*split)):
                self._learn(new)
            get = self.words.__getitem__
            for words in split:
                yield b"".join(map(get, words))


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def _pieces(path: str, limit: int) -> _Pieces:
    return _Pieces(path, limit)


forgets("packing", _pieces.cache_clear)


def token_bytes(texts: list[str], path: str, cache: int = CACHE) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers.

    The vocabulary drops white space and never joins across it, so texts are encoded
    between spaces and newlines, each distinct string once.
    """
    return _pieces(path, cache).ids(texts)


class BestFit:
    """Open bins of one capacity by their free space; the fullest that still fits takes an item."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.mask, self.fill = capacity, {}, 0, []

    def add(self, size: int) -> tuple[int, int]:
        """(bin, offset) of an item; opens a bin if none has room."""
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = self.free[room]
            bin_ = stack.pop()
            if not stack:
                self.mask &= ~(1 << room)
        else:
            room, bin_ = self.capacity, len(self.fill)
            self.fill.append(0)
        offset = self.fill[bin_]
        self.fill[bin_] = offset + size
        if left := room - size:
            self.free.setdefault(left, []).append(bin_)
            self.mask |= 1 << left
        return bin_, offset


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first, ties in order: each item's bin and offset, and the bins' fills."""
    bins, offsets, packer = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), BestFit(capacity)
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        bins[i], offsets[i] = packer.add(int(sizes[i]))
    return bins, offsets, np.array(packer.fill, np.int64)


def still_open(fills: np.ndarray, capacity: int, near: float, spare_bins: int) -> np.ndarray:
    """Which bins go up: those at most half full, and of those not nearly full the emptiest."""
    large = np.nonzero((fills > capacity // 2) & (fills < int(capacity * near)))[0]
    out = fills <= capacity // 2
    out[large[np.argsort(fills[large], kind="stable")[:spare_bins]]] = True
    return out


_LEVEL0 = "id long, piece int, start long, length long, ids_crc32 long, leaf long, leaf_offset long, open boolean, part int"


def _level0(path: str, capacity: int, near: float, spare_bins: int, cache: int):
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        ids, pieces, starts, lengths, crcs = [], [], [], [], []
        end = np.array([END_ID], "<u4").tobytes()
        for pdf in batches:
            for doc, raw in zip(pdf["id"], token_bytes(pdf["text"].tolist(), path, cache), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[at : at + 4 * capacity]
                    ids.append(doc)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(cut) // 4)
                    crcs.append(zlib.crc32(cut))
        if not ids:
            return
        bins, offsets, fills = best_fit(np.array(lengths), capacity)
        open_ = still_open(fills, capacity, near, spare_bins)
        for at in range(0, len(ids), 50_000):
            now = slice(at, at + 50_000)
            yield pd.DataFrame({"id": pd.array(ids[now], dtype="Int64"), "piece": pieces[now], "start": starts[now], "length": lengths[now], "ids_crc32": crcs[now], "leaf": bins[now] + (part << 32), "leaf_offset": offsets[now], "open": open_[bins[now]], "part": part})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with working("packing"):
            yield from packed(batches)

    return pack


_ROUND = "leaf long, bin long, shift long, size long, fill long, part int, open boolean"


def _round(capacity: int, near: float, spare_bins: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of open leaves; the leaves of a bin move together."""
        pdf = pdf.sort_values(["bin", "shift"], kind="stable")
        first = pdf.drop_duplicates("bin")
        new, offsets, fills = best_fit(first["fill"].to_numpy(), capacity)
        to = pd.DataFrame({"bin": first["bin"].to_numpy(), "new": new, "by": offsets})
        heads = first["bin"].to_numpy()[np.unique(new, return_index=True)[1]]
        open_ = still_open(fills, capacity, near, spare_bins)
        pdf = pdf.merge(to, on="bin")
        return pd.DataFrame({"leaf": pdf["leaf"], "bin": heads[pdf["new"]], "shift": pdf["shift"] + pdf["by"], "size": pdf["size"], "fill": fills[pdf["new"]], "part": pdf["part"], "open": open_[pdf["new"]]})

    return merge


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, near_full: float = 0.998, fan_in: int = 32, spare_bins: int = 128, cache: int = CACHE, rows: int = TEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens.

    One row per piece: the id, piece (from 0), start (the document's ids before it),
    length, ids_crc32, sequence_id and offset. A document is its ids followed by id 0,
    so an empty or null text is one id; only documents longer than the capacity are
    cut, whatever their length. Repeated rows and null ids are packed like others, ids
    must be whole numbers or text that reads as such; an empty table gives an empty
    result; other columns are ignored, whatever their names. Ties of length keep the
    order of rows, so sequence ids depend on how the table is read. A bin counts as
    nearly full from `near_full` of the capacity. `cache` words are kept between texts:
    fewer take less memory and more time, the result is the same; so do fewer `rows`
    that go to a Python worker at a time.
    """
    require(docs, id_col, text_col)
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    pieces = checkpoint(base.mapInPandas(_level0(tokenizer_path, capacity, near_full, spare_bins, cache), _LEVEL0), rows)
    leaves = pieces.where("open").groupBy("leaf").agg(F.sum("length").alias("size"), F.first("part").alias("part"))
    rest = leaves.select("leaf", F.col("leaf").alias("bin"), F.lit(0).cast("long").alias("shift"), "size", F.col("size").alias("fill"), "part")
    parts = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    closed, level = [], 0
    while fan_in**level < parts:
        level += 1
        group = (F.col("part") / fan_in**level).cast("int").alias("grp")
        rest = checkpoint(rest.groupBy(group).applyInPandas(_round(capacity, near_full, spare_bins), _ROUND))
        closed.append(rest.where("not open").select("leaf", "bin", "shift"))
        rest = rest.where("open").drop("open")
    moved = rest.select("leaf", "bin", "shift")
    for more in closed:
        moved = moved.unionByName(more)
    out = ["id", "piece", "start", "length", "ids_crc32"]
    done = pieces.where("not open").select(*out, F.col("leaf").alias("sequence_id"), F.col("leaf_offset").alias("offset"))
    late = pieces.where("open").join(moved.withColumnRenamed("leaf", "of"), F.col("leaf") == F.col("of")).select(*out, F.col("bin").alias("sequence_id"), (F.col("leaf_offset") + F.col("shift")).alias("offset"))
    return done.unionByName(late).withColumnRenamed("id", id_col)


def default_tokenizer() -> str:
    """The public vocabulary of words, where the machine has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
