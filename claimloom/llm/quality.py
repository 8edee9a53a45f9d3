"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; a pair of features interacts by the dot
product of its vectors. The sum over all pairs is taken in linear time as half the
difference between the square of the sum and the sum of the squares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm._common import forgets, fresh, require, text_of, working
from claimloom.llm._learn import FIT_CHARS, labelled_sample, remainder

#: Hash slots of words, bins of each statistic, length of the vectors.
SLOTS, BINS, RANK = 4096, 8, 8
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_CAPS, _EDGED, _BARE, _DIGIT, _TITLE, _LONG = 1, 2, 4, 8, 16, 32
#: Names of the statistics, in the order statistics() gives them; the last two are metadata.
STATISTICS = ("mean_word", "caps", "edged", "symbols", "digits", "title", "long", "repeated_next", "distinct", "top_share", "words_a_line", "repeated_lines", "punctuation", "upper", "stops", "ends", "pairs_distinct", "chars", "lines")


class _Words(dict):
    """Words to hash slot and flags in one number; forgets all when full."""

    def __missing__(self, word: str) -> int:
        bare = _EDGE.sub("", word)
        flags = (_CAPS if len(bare) > 1 and bare.isupper() else 0) | (_EDGED if len(word) - len(bare) > 1 else 0) | (0 if bare else _BARE)
        flags |= (_DIGIT if any(c.isdigit() for c in bare) else 0) | (_TITLE if bare.istitle() else 0) | (_LONG if len(bare) > 20 else 0)
        code = xxhash.xxh32_intdigest(bare.lower().encode("utf-8", "surrogatepass")) % SLOTS << 6 | flags
        if len(word) <= 64:
            if len(self) > 100_000:
                self.clear()
            self[word] = code
        return code


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


forgets("quality", _words.cache_clear)


def statistics(text: str, words: list[str], code: np.ndarray) -> np.ndarray:
    """Structure statistics and metadata; an empty text gives zeros."""
    n = len(words)
    if not n:
        return np.zeros(len(STATISTICS))
    flags, slot = code & 63, code >> 6
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    of = np.bincount(raw, minlength=256)
    size = len(raw)
    lines = text.split("\n")
    counts = np.bincount(slot)
    pairs = slot[:-1] * SLOTS + slot[1:]
    share = lambda flag: np.count_nonzero(flags & flag) / n
    return np.array([
        size / n, share(_CAPS), share(_EDGED), share(_BARE), share(_DIGIT), share(_TITLE), share(_LONG),
        np.count_nonzero(slot[1:] == slot[:-1]) / n, np.count_nonzero(counts) / np.sqrt(n), counts.max() / n, n / len(lines), 1 - len(set(lines)) / len(lines),
        (of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum()) / size, of[65:91].sum() / size, (of[46] + of[33] + of[63]) / n,
        float(text.rstrip()[-1:] in tuple(".!?\"'")), len(np.unique(pairs)) / max(1, n - 1), np.log1p(len(text)), np.log1p(len(lines)),
    ])


def _parts(text: str, known: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash slots that occur, their values, and the statistics."""
    words = text.split()
    code = np.fromiter((known[w] for w in words), np.int64, len(words))
    counts = np.bincount(code >> 6) if len(code) else np.zeros(0)
    slots = np.nonzero(counts)[0]
    values = np.log1p(counts[slots])
    return slots, values / max(1e-9, np.sqrt((values**2).sum())), statistics(text, words, code)


@dataclass
class Machine:
    """Weights and vectors of SLOTS word features and BINS for each statistic."""

    bias: float
    weight: np.ndarray
    vectors: np.ndarray
    cuts: np.ndarray  # [statistic, BINS - 1]

    def row(self, parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        slots, values, stats = parts
        bins = (stats[:, None] > self.cuts).sum(1) + np.arange(len(stats)) * BINS + SLOTS
        return np.concatenate([slots, bins]), np.concatenate([values, np.full(len(bins), 0.5)])

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        """Linear in the number of features: half of (square of the sum less sum of the squares)."""
        vx = self.vectors[index] * value[:, None]
        s = vx.sum(0)
        return float(self.bias + self.weight[index] @ value + 0.5 * ((s * s).sum() - (vx * vx).sum()))

    def score(self, texts: list[str], known: _Words) -> np.ndarray:
        return np.array([1 / (1 + np.exp(-np.clip(self.margin(*self.row(_parts(t, known))), -30, 30))) for t in texts], dtype=float)


def fit_texts(texts: list[str], y: np.ndarray, rounds: int = 120, rate: float = 0.05, l2: float = 2e-4, seed: int = 7) -> Machine:
    """Fit by full-batch Adam on the logistic loss. One class only, or no row: the base rate whatever the text."""
    size = SLOTS + BINS * len(STATISTICS)
    p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    machine = Machine(float(np.log(p / (1 - p))), np.zeros(size), np.zeros((size, RANK)), np.zeros((len(STATISTICS), BINS - 1)))
    if not len(y) or y.min() == y.max():
        return machine
    known = _words()
    parts = [_parts(t, known) for t in texts]
    stats = np.stack([x[2] for x in parts])
    rare = stats[y == (0 if p > 0.5 else 1)]
    quantiles = np.linspace(0, 1, 5)[1:-1]
    # half of the cuts by the rarer class, so that what marks it is resolved too
    machine.cuts = np.concatenate([np.quantile(stats, quantiles, axis=0), np.quantile(rare, np.linspace(0.02, 0.98, BINS - 1 - len(quantiles)), axis=0)]).T
    rows = [machine.row(x) for x in parts]
    del parts
    starts = np.cumsum([0, *[len(i) for i, _ in rows]])[:-1]
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows]).astype(np.float32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) for i, _ in rows])
    del rows
    index = index.astype(np.int32)
    order = np.argsort(index, kind="stable")
    used, firsts = np.unique(index[order], return_index=True)
    rng = np.random.default_rng(seed)
    params = [np.array([machine.bias]), machine.weight, rng.normal(0, 0.05, (size, RANK))]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, rounds + 1):
        bias, w, v = params
        vx = v.astype(np.float32)[index] * value[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        margin = bias[0] + np.add.reduceat(w.astype(np.float32)[index] * value, starts) + 0.5 * ((s * s).sum(1) - squares)
        err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
        gw, gv = np.zeros_like(w), np.zeros_like(v)
        at = err.astype(np.float32)[owner] * value
        gw[used] = np.add.reduceat(at[order], firsts)
        vx = s[owner] - vx
        vx *= at[:, None]
        gv[used] = np.add.reduceat(vx[order], firsts, axis=0)
        for i, g in enumerate((np.array([err.sum()]), gw + l2 * w, gv + l2 * v)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    machine.bias, machine.weight, machine.vectors = float(params[0][0]), params[1], params[2]
    return machine


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 6_000, fit_chars: int = FIT_CHARS) -> Machine:
    """Fit on at most `fit_rows` labelled rows and `fit_chars` code points whose crc32(doc_id) mod 3 is not 1.

    Rows, ids and labels that are null, repeated or missing are treated as labelled_sample()
    says; one class only, or no row, gives a constant score.
    """
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "quality")
    return fit_texts(*labelled_sample(docs, labels, "quality", remainder("doc_id", 3) != 1, fit_rows, fit_chars))


def score_documents(docs: DataFrame, model: Machine, column: str = "score") -> DataFrame:
    """`docs` with the score column: the chance of label 1 from the text alone; null texts score as empty ones.

    Texts are read whole, whatever their length. Equal texts score alike; repeated rows
    and null ids stay; an empty table gives an empty result. A column named as the
    score is replaced, all others stay, whatever their names.
    """
    require(docs, "text")

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with working("quality"):
            known = _words()
            for texts in parts:
                yield pd.Series(model.score(texts.tolist(), known), dtype="float64")

    return docs.withColumn(column, F.pandas_udf(score, "double")(text_of()))


def keep_good(docs: DataFrame, model: Machine, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least the threshold, columns unchanged."""
    name = fresh(docs, "__quality")
    return score_documents(docs, model, name).where(F.col(name) >= threshold).drop(name)
