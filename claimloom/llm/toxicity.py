"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities of a stated and of a learnt lexicon, the nearness of its hits to
second-person words, and rates of capitals, punctuation and obfuscation.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm._common import fresh, require, text_of, working
from claimloom.llm._learn import FIT_CHARS, FIT_ROWS, isotonic, labelled_sample, remainder

# Insults and second-person words of the languages at hand.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb trash garbage scum loser losers pathetic worthless disgusting clown clowns fool fools jerk creep filth vermin ugly hate "
    "dummkopf trottel abschaum versager widerlich arschloch imbécile crétin ordure minable connard salaud imbécil estúpido basura escoria asqueroso payaso".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos tú ti usted ustedes vosotros".split())
#: Learnt lexicon: entries kept, lengths of word beginnings, toxic documents that must hold an entry.
LEXICON, BEGINNINGS, LEAST = 400, (4, 5, 6, 7, 8), 4
NEAR = 5

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MASKED = re.compile(r"[^\W\d_][0-9@$*!#]+[^\W\d_]")
_LONG = re.compile(r"(.)\1\1")
_LEET = str.maketrans("013457@$!", "oieastasi")
_CAPS, _OBFUSCATED, _PERSON, _INSULT, _STRETCHED = 1, 2, 4, 8, 16
FEATURES = 24


def _units(word: str) -> list[str]:
    return [word] + [word[:n] + "-" for n in BEGINNINGS if len(word) > n]


def learn_lexicon(texts: list[str], y: np.ndarray) -> dict[str, float]:
    """Words and word beginnings ("abcd-") that mark toxic documents, with smoothed log odds of a document holding one."""
    toxic: Counter[str] = Counter()
    clean: Counter[str] = Counter()
    for t, label in zip(texts, y, strict=True):
        if label:
            toxic.update({u for w in {_EDGE.sub("", w).lower() for w in t.split()} if w for u in _units(w)})
    toxic = Counter({u: n for u, n in toxic.items() if n >= LEAST})
    for t, label in zip(texts, y, strict=True):
        if not label:
            clean.update({u for w in {_EDGE.sub("", w).lower() for w in t.split()} if w for u in _units(w) if u in toxic})
    n1, n0 = max(1, int(y.sum())), max(1, len(y) - int(y.sum()))
    scored = []
    for u, n in toxic.items():
        odds = float(np.log((n + 0.5) / (n1 + 1)) - np.log((clean[u] + 0.5) / (n0 + 1)))
        # log likelihood ratio of the two shares
        p1, p0, p = n / n1, clean[u] / n0, (n + clean[u]) / (n1 + n0)
        gain = sum(k * np.log(a / p) for k, a in ((n, p1), (clean[u], p0)) if k) + sum((m - k) * np.log((1 - a) / (1 - p)) for k, m, a in ((n, n1, p1), (clean[u], n0, p0)) if m - k > 0)
        if odds > 1.0:
            scored.append((float(gain), u, odds))
    scored.sort(key=lambda x: (-x[0], x[1]))
    return {u: odds for _, u, odds in scored[:LEXICON]}


class _Words(dict):
    """Words as written to lexicon entry and flags in one number; forgets all when full."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.place = {u: i + 1 for i, u in enumerate(lexicon)}
        self.odds = np.array([0.0, *lexicon.values()])

    def __missing__(self, word: str) -> int:
        bare = _EDGE.sub("", word)
        low = bare.lower()
        flags = _CAPS if len(bare) > 1 and bare.isupper() else 0
        if masked := bool(_MASKED.search(bare)):
            flags |= _OBFUSCATED
        if low in SECOND_PERSON:
            flags |= _PERSON
        plain = _LONG.sub(r"\1", low.translate(_LEET)) if masked or _LONG.search(low) else low
        if low in INSULTS or plain in INSULTS:
            flags |= _INSULT
        if _LONG.search(low):
            flags |= _STRETCHED
        found = [self.place[u] for w in {low, plain} for u in _units(w) if u in self.place]
        best = max(found, key=lambda i: self.odds[i], default=0)
        code = best << 5 | flags
        if len(word) <= 64:
            if len(self) > 100_000:
                self.clear()
            self[word] = code
        return code


def features(text: str, known: _Words) -> np.ndarray:
    """The dense features of a text; an empty one gives zeros."""
    out = np.zeros(FEATURES)
    raw = text.split()
    n = len(raw)
    if not n:
        return out
    code = np.fromiter((known[w] for w in raw), np.int64, n)
    flags, entry = code & 31, code >> 5
    odds = known.odds[entry]
    hits = np.nonzero(odds > 0)[0]
    strong = np.nonzero(odds > 2.5)[0]
    insults = np.nonzero(flags & _INSULT)[0]
    marked = np.union1d(insults, strong)
    out[0] = np.log1p(n)
    out[1] = odds.sum() / n
    out[2] = odds.max()
    out[3] = len(hits) / n
    out[4] = len(strong) / n
    out[5] = len(strong)
    out[6] = len(insults) / n
    out[7] = len(insults)
    if len(strong):
        of = np.bincount(entry[strong])
        out[8] = (of > 0).sum()
        out[9] = of.max() / n
        out[10] = np.sort(odds[strong])[::-1][:10].sum()
    person = np.nonzero(flags & _PERSON)[0]
    out[11] = len(person) / n
    if len(person) and len(marked):
        at = np.searchsorted(person, marked)
        left = np.abs(marked - person[np.maximum(at - 1, 0)])
        right = np.abs(person[np.minimum(at, len(person) - 1)] - marked)
        near = np.minimum(left, right) <= NEAR
        out[12] = near.sum() / n
        out[13] = near.mean()
    out[14] = np.count_nonzero(flags & _CAPS) / n
    out[15] = np.count_nonzero(flags & _OBFUSCATED) / n
    out[16] = np.count_nonzero(flags & _STRETCHED) / n
    raw_bytes = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = raw_bytes.sum()
    out[17] = raw_bytes[65:91].sum() / size
    out[18] = raw_bytes[33] / size
    out[19] = raw_bytes[63] / size
    out[20] = (raw_bytes[33:48].sum() + raw_bytes[58:65].sum()) / size
    out[21] = (raw_bytes[42] + raw_bytes[35] + raw_bytes[36] + raw_bytes[37] + raw_bytes[38]) / size
    out[22] = raw_bytes[48:58].sum() / size
    out[23] = len(np.unique(code[marked])) / np.sqrt(n) if len(marked) else 0.0
    return out


@dataclass
class Trees:
    """Gradient-boosted trees on the logistic loss; splits found in histograms."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.12
    bins: int = 32
    l2: float = 2.0
    least: float = 2.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        p = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        cuts = [np.unique(np.concatenate([c, np.quantile(x[x[:, j] > 0, j], np.linspace(0, 1, 9)[:-1]) * (1 - 1e-9)])) if (x[:, j] > 0).any() else c for j, c in enumerate(cuts)]
        width = max(map(len, cuts)) + 1
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        flat = binned + np.arange(m) * width
        margin = np.full(n, self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-margin))
            g, h = prob - y, prob * (1 - prob)
            node = np.zeros(n, np.int64)
            which, where, leaf = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1), np.zeros(2**self.depth)
            for level in range(self.depth):
                k = 2**level
                cells = (node[:, None] * (m * width) + flat).ravel()
                gs = np.bincount(cells, np.repeat(g, m), k * m * width).reshape(k, m, width).cumsum(2)
                hs = np.bincount(cells, np.repeat(h, m), k * m * width).reshape(k, m, width).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                gain[(hs < self.least) | (ht - hs < self.least)] = -1
                best = gain.reshape(k, -1).argmax(1)
                go = np.zeros(n, np.int64)
                for i in range(k):
                    f, b = divmod(int(best[i]), width)
                    if gain[i, f, b] > 1e-6 and b < len(cuts[f]):
                        which[k - 1 + i], where[k - 1 + i] = f, cuts[f][b]
                        inside = node == i
                        go[inside] = binned[inside, f] > b
                node = node * 2 + go
            gl, hl = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            leaf = -self.rate * gl / (hl + self.l2)
            margin += leaf[node]
            self.trees.append((which, where, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for which, where, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                f = which[at]
                node = node * 2 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > where[at]))
            out += leaf[node]
        return out


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def words(self) -> _Words:
        return _Words(self.lexicon)

    def score(self, texts: list[str], known: _Words) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), float(self.values[0]))
        x = np.stack([features(t, known) for t in texts]) if texts else np.zeros((0, FEATURES))
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.values), 0.0, 1.0)


def fit_texts(texts: list[str], y: np.ndarray, folds: int = 4) -> ToxicityModel:
    """Lexicon and trees on all rows; calibration on margins that folds of other rows gave, lexicon learnt anew each time.

    Rows with equal texts share a fold. One class only, or no row: a constant score.
    """
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, None, np.zeros(1), np.array([float(y.mean()) if len(y) else 0.0]))
    fold = np.array([hash_of(t) % folds for t in texts])
    margins = np.zeros(len(y))
    done = np.zeros(len(y), bool)
    for k in range(folds):
        test = fold == k
        if not test.any() or y[~test].sum() in (0, (~test).sum()):
            continue
        lexicon = learn_lexicon([t for t, out in zip(texts, test, strict=True) if not out], y[~test])
        known = _Words(lexicon)
        x = np.stack([features(t, known) for t in texts])
        margins[test] = Trees().fit(x[~test], y[~test]).margin(x[test])
        done |= test
    lexicon = learn_lexicon(texts, y)
    known = _Words(lexicon)
    trees = Trees().fit(np.stack([features(t, known) for t in texts]), y)
    knots, values = isotonic(margins[done], y[done]) if done.any() else isotonic(np.zeros(len(y)), y)
    return ToxicityModel(lexicon, trees, knots, values)


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> ToxicityModel:
    """Fit on at most `fit_rows` labelled rows and `fit_chars` code points whose crc32(doc_id) mod 4 is not 2.

    Rows, ids and labels that are null, repeated or missing are treated as labelled_sample()
    says; one class only, or no row, gives a constant score.
    """
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "toxic")
    return fit_texts(*labelled_sample(docs, labels, "toxic", remainder("doc_id", 4) != 2, fit_rows, fit_chars))


def score_documents(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """`docs` with the score column: the chance of label 1 from the text alone; null texts score as empty ones.

    Texts are read whole, whatever their length. Equal texts score alike; repeated rows
    and null ids stay; an empty table gives an empty result. A column named as the
    score is replaced, all others stay, whatever their names.
    """
    require(docs, "text")

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with working("toxicity"):
            known = model.words()
            for texts in parts:
                yield pd.Series(model.score(texts.tolist(), known), dtype="float64")

    return docs.withColumn(column, F.pandas_udf(score, "double")(text_of()))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, columns unchanged."""
    name = fresh(docs, "__toxicity")
    return score_documents(docs, model, name).where(F.col(name) < threshold).drop(name)
