"""Personal data by a semi-Markov conditional random field.

Around every digit, @, start of a URL or long run of key characters a window of text is
opened and cut into candidate segments. Each segment is scored as a whole for each type (shape, checks such as
Luhn, digits, context words, edges); dynamic programming then chooses boundaries and
types jointly. Weights are learnt by maximum likelihood, exact through the forward and
backward sums over all segmentations, on sentences generated here. The four exact base
kinds are candidates like others and always stay in the result.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm._common import fresh, require, text_of, working

# The base kinds in their order, then the method's own.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "url")
#: No card, phone, account or IP is longer; parts of a long window overlap by as much.
LONGEST = 96

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from every later one.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOT = re.compile(r"[0-9@]")
_OPENS = re.compile(r"[0-9@]|https?://|www\.|(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16}")
#: White space inside a number.
_INSIDE = re.compile(r"\x20(?=[\x20().-]?[0-9(+])|(?<=\x20)\x20(?=[0-9(+])")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: the local part is the whole run before an @, back to the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The exact base kinds: leftmost and non-overlapping within a kind, by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    if _HOT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_is_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 38 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


# What may be a segment of each type, tried at every edge of a window.
_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,5}"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9]){11,18}"),
    "account": re.compile(r"[A-Z]{0,4}[0-9](?:[\x20-]{0,2}[0-9]){7,23}"),
    "phone": re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}"),
    "secret": re.compile(r"[A-Za-z0-9_+/=-]{16,96}"),
    "url": re.compile(r"(?:https?://|www\.)[^\s\"'<>]{4,}"),
}
_KEY = re.compile(r"[A-Za-z0-9_+/=-]")
_KEYS = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
#: Digits of the shortest segment; a shape cut after a digit is one from there on.
_LEAST = {"card": 12, "account": 8, "phone": 7}
_GROUP = re.compile(r"[0-9]+")
_CUES = {
    "email": ("mail", "contact", "write", "from", "to"),
    "ip": ("ip", "host", "address", "server", "login"),
    "card": ("card", "visa", "credit", "pay", "carte", "karte", "tarjeta"),
    "phone": ("call", "phone", "tel", "fax", "mobile", "ring"),
    "account": ("account", "iban", "passport", "ssn", "id", "no", "konto"),
    "secret": ("token", "key", "secret", "password", "pass", "api", "auth"),
    "url": ("see", "visit", "at"),
}
_CASES = re.compile(r"[a-z](?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"(?<=[A-Za-z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9+(])|(?<=[^0-9])(?=[0-9])")


def segment_features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Features of text[start:end] as one entity of a type; each is read off the whole span."""
    span = text[start:end]
    digits = _digits(span)
    n, d = len(span), len(digits)
    before, after = text[start - 1 : start], text[end : end + 1]
    out = [kind, f"{kind}:digits{min(d, 20) // 2}", f"{kind}:length{min(n, 96) // 8}"]
    if before.isalnum() or before in ("_", "@"):
        out.append(f"{kind}:glued_left")
    if after.isalnum() or after in ("_", "@"):
        out.append(f"{kind}:glued_right")
    if before in ("-", ".", "+") and before:
        out.append(f"{kind}:sign_left")
    if after in ("-", ".") and text[end + 1 : end + 2].isalnum():
        out.append(f"{kind}:goes_on")
    if before in ('"', "'") and before == after:
        out.append(f"{kind}:quoted")
    if d == n:
        out.append(f"{kind}:all_digits")
    if d and any(c.isalpha() for c in span):
        out.append(f"{kind}:mixed")
    if kind in ("card", "account") and 12 <= d <= 19:
        out.append(f"{kind}:luhn" if luhn(digits) else f"{kind}:no_luhn")
    if kind == "ip":
        out.append("ip:bytes" if all(int(p) <= 255 for p in span.split(".")) else "ip:no_bytes")
    if kind == "phone":
        out += ["phone:plus"] * (span[0] == "+") + ["phone:paren"] * ("(" in span)
    if kind == "secret":
        hexed = all(c in "0123456789abcdefABCDEF" for c in span)
        out += ["secret:letters"] * (d == 0) + ["secret:cases"] * (len(_CASES.findall(span)) >= 3)
        out += ["secret:hex"] * (hexed and n >= 32) + ["secret:varied"] * (len(set(span)) >= 10)
    if kind in _cued(text, start):
        out.append(f"{kind}:cue")
    return out


def _cued(text: str, start: int) -> frozenset[str]:
    """The kinds that one of the three words before `start` announces."""
    words = {w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])[-3:]}
    return frozenset(k for k in KINDS if not words.isdisjoint(_CUES[k])) if words else frozenset()


def windows(text: str) -> Iterator[tuple[int, int]]:
    """The whole tokens around digits, @, URLs and long keys; long runs come in parts that overlap by LONGEST."""
    at = 0
    while m := _OPENS.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < len(text) and (not text[end].isspace() or _INSIDE.match(text, end)):
            end += 1
        at = end
        while end - start > 4 * LONGEST:
            yield start, start + 4 * LONGEST
            start += 3 * LONGEST
        yield start, end


def candidates(text: str, start: int, end: int, base: list[Span]) -> list[Span]:
    """Segments of a window that some type's shape admits, each at its longest and at its group ends, and the base spans in it."""
    first = {start} if start == 0 or text[start - 1].isspace() else set()
    edges = sorted({*first, *(m.start() for m in _EDGE.finditer(text, max(0, start), end))})
    out = {s for s in base[bisect_left(base, (start,)) : bisect_left(base, (end,))] if s[1] <= end}
    past = start
    for at in edges:
        for kind, shape in _SHAPES.items():
            if kind == "url":
                # a URL may leave the window, and one inside another is part of it
                if at >= past and (m := shape.match(text, at)):
                    past = m.end()
                    out |= {(at, past, kind), (at, at + len(m[0].rstrip(".,;:!?)")), kind)}
            elif kind == "secret":
                # a whole run of key characters, from inside it a bounded part
                if m := shape.match(text, at) if at and _KEY.match(text, at - 1) else _KEYS.match(text, at):
                    out.add((at, m.end(), kind))
            elif m := shape.match(text, at, end):
                out.add((at, m.end(), kind))
                if kind in _LEAST:
                    n = 0
                    for g in _GROUP.finditer(m[0]):
                        n += len(g[0])
                        if n >= _LEAST[kind]:
                            out.add((at, at + g.end(), kind))
    return sorted(out, key=_order)


def decode(text: str, found: list[Span], weights: dict[str, float], forced: frozenset[Span] = frozenset()) -> list[Span]:
    """The best set of disjoint segments; text outside scores zero."""
    ends = sorted({s[1] for s in found})
    by_end: dict[int, list[tuple[float, Span]]] = {}
    cues = {at: _cued(text, at) for at in {s[0] for s in found}}
    # segments that look alike from outside, too, score alike
    known: dict[tuple, float] = {}
    for s in found:
        looks = (text[s[0] : s[1]], s[2], text[max(0, s[0] - 1) : s[0]], text[s[1] : s[1] + 2], s[2] in cues[s[0]])
        if (score := known.get(looks)) is None:
            score = known[looks] = sum(weights.get(f, 0.0) for f in segment_features(text, *s))
        score += 1e6 if s in forced else 0.0
        if score > 0:
            by_end.setdefault(s[1], []).append((score, s))
    best: list[tuple[float, int, Span | None]] = [(0.0, -1, None)]
    places = [-1]
    for end in ends:
        top = (best[-1][0], len(best) - 1, None)
        for score, s in by_end.get(end, ()):
            k = bisect_right(places, s[0]) - 1
            if best[k][0] + score > top[0]:
                top = (best[k][0] + score, k, s)
        best.append(top)
        places.append(end)
    chosen, i = [], len(best) - 1
    while i > 0:
        _, back, s = best[i]
        if s:
            chosen.append(s)
        i = back
    return chosen[::-1]


def find_spans(text: str, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): what the field chooses, less what overlaps a base span, and every base span."""
    base = base_spans(text)
    kept, chosen = frozenset(base), []
    parts = list(windows(text))
    for (start, end), (after, _) in zip(parts, [*parts[1:], (len(text), 0)], strict=False):
        # what starts in an overlap is the next part's, where it is whole
        chosen += [s for s in decode(text, candidates(text, start, end, base), weights, kept) if s[0] < after]
    # base spans by start, and how far those up to each reach: one look tells whether any meets a span
    starts, reach = [b[0] for b in base], list(accumulate((b[1] for b in base), max))
    more = []
    for s in sorted(set(chosen) - kept, key=_order):
        before = bisect_left(starts, s[1])
        if (not before or reach[before - 1] <= s[0]) and (not more or more[-1][1] <= s[0]):
            more.append(s)
    return base, sorted([*base, *more], key=_order)


# ---- learning


def _random_word(rng: random.Random) -> str:
    return "".join(rng.choice(("an", "er", "ion", "the", "al", "que", "ung", "st", "ar", "el")) for _ in range(rng.randint(1, 3)))


def _with_luhn(rng: random.Random, n: int, good: bool) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    check = next(c for c in "0123456789" if luhn(body + c))
    return body + (check if good else str((int(check) + rng.randint(1, 9)) % 10))


def _entity(rng: random.Random, kind: str) -> str:
    if kind == "email":
        return f"{_random_word(rng)}{rng.choice(('.', '', '_'))}{rng.randint(1, 99)}@{_random_word(rng)}.{rng.choice(('com', 'org', 'example.net'))}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "account" and rng.random() < 0.4:
        number = "".join(rng.choice("0123456789") for _ in range(rng.randint(10, 18)))
        cut = rng.choice((2, 4, len(number) - 2))
        return rng.choice(("", "", "DE", "GB")) + number[:cut] + rng.choice(" -") + number[cut:]
    if kind in ("card", "account"):
        digits = _with_luhn(rng, rng.choice((13, 15, 16, 16, 16, 19)), kind == "card")
        if rng.random() < 0.4:
            sep = rng.choice(" -")
            digits = sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        return digits
    if kind == "phone" and rng.random() < 0.4:
        area, rest = rng.randint(20, 999), str(rng.randint(10**5, 10**8 - 1))
        if rng.random() < 0.3:
            cut = rng.randint(1, len(rest) - 1)
            rest = f"{rest[:cut]} {rest[cut:]}"
        return rng.choice(("0{} {}", "(0{}) {}", "0{}-{}", "{}-{}")).format(area, rest)
    if kind == "phone":
        return rng.choice(("+{} ({}) {}-{}", "+{} {} {} {}", "({1}) {2}-{3}")).format(rng.randint(1, 49), rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999))
    if kind == "url" and rng.random() < 0.5:
        path = "/".join(_random_word(rng) for _ in range(rng.choice((1, 2, 3, 12))))
        return f"{rng.choice(('https://', 'http://', 'www.', 'https://www.'))}{_random_word(rng)}.{rng.choice(('com', 'org', 'example.net'))}/{path}"
    if kind == "url":
        return f"https://{_random_word(rng)}.example.com/{_random_word(rng)}?id={rng.randint(1, 999)}"
    alphabet = rng.choice(("0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"))
    return "".join(rng.choice(alphabet) for _ in range(rng.choice((24, 32, 40, 40, 64))))


def _distractor(rng: random.Random) -> str:
    return rng.choice((
        lambda: str(rng.randint(1, 99999)), lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: f"{rng.randint(1, 999)},{rng.randint(100, 999)},{rng.randint(100, 999)}", lambda: f"{rng.randint(1900, 1999)}-{rng.randint(2000, 2030)}",
        lambda: f"{_random_word(rng)}@{_random_word(rng)}", lambda: f"{_random_word(rng)}{rng.randint(1, 99)}", lambda: " ".join(str(rng.randint(1, 99)) for _ in range(rng.randint(2, 6))), lambda: f"{rng.randint(1, 59)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}",
        lambda: "_".join(_random_word(rng) for _ in range(4)) + str(rng.randint(1, 9)),
        lambda: rng.choice("-_/").join(_random_word(rng) for _ in range(rng.randint(3, 8))), lambda: "".join(_random_word(rng) for _ in range(rng.randint(3, 6))), lambda: rng.choice("-=_+") * rng.randint(16, 60),
    ))()


def training_sentences(n: int = 500, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Generated sentences with their true spans; half the entities come with a cue."""
    rng, out = random.Random(seed), []
    for i in range(n):
        text, spans = "", []
        for j in range(rng.randint(1, 4)):
            text += " ".join(_random_word(rng) for _ in range(rng.randint(1, 5))) + " "
            if rng.random() < 0.55:
                kind = KINDS[(i + j) % len(KINDS)]
                if rng.random() < 0.5:
                    text += rng.choice(_CUES[kind]) + rng.choice((" ", ": "))
                quote = kind == "secret" and rng.random() < 0.7
                if kind == "secret" and not quote:
                    text += rng.choice(("password: ", "token ", "key: ", "secret="))
                if quote:
                    text += rng.choice(('token = "', 'key: "', 'secret="'))
                entity = _entity(rng, kind)
                spans.append((len(text), len(text) + len(entity), kind))
                text += entity + ('"' if quote else "") + rng.choice((" ", ". ", ", "))
            else:
                text += _distractor(rng) + " "
        out.append((text, spans))
    return out


def _gradient(text: str, found: list[Span], gold: set[Span], weights: dict[str, float], into: dict[str, float]) -> float:
    """Adds the gradient of the log likelihood of the gold segmentation; returns the log likelihood."""
    feats = [segment_features(text, *s) for s in found]
    score = [sum(weights.get(f, 0.0) for f in x) for x in feats]
    cuts = sorted({p for s in found for p in s[:2]})
    place = {p: i for i, p in enumerate(cuts)}
    arcs = [(place[s[0]], place[s[1]]) for s in found]
    ahead, back = [float("-inf")] * len(cuts), [float("-inf")] * len(cuts)
    ahead[0] = back[-1] = 0.0
    into_, from_ = {}, {}
    for k, (a, b) in enumerate(arcs):
        into_.setdefault(b, []).append(k)
        from_.setdefault(a, []).append(k)
    for i in range(1, len(cuts)):
        ahead[i] = float(np.logaddexp.reduce([ahead[i - 1], *(ahead[arcs[k][0]] + score[k] for k in into_.get(i, ()))]))
    for i in range(len(cuts) - 2, -1, -1):
        back[i] = float(np.logaddexp.reduce([back[i + 1], *(back[arcs[k][1]] + score[k] for k in from_.get(i, ()))]))
    total = ahead[-1]
    for k, (a, b) in enumerate(arcs):
        by = (found[k] in gold) - float(np.exp(ahead[a] + score[k] + back[b] - total))
        for f in feats[k]:
            into[f] = into.get(f, 0.0) + by
    return sum(score[k] for k in range(len(found)) if found[k] in gold) - total


@lru_cache(maxsize=4)
def _learnt(sentences: int, epochs: int, seed: int) -> tuple[tuple[str, float], ...]:
    lattices = []
    for text, spans in training_sentences(sentences, seed):
        base = base_spans(text)
        for start, end in windows(text):
            found = candidates(text, start, end, base)
            if found:
                lattices.append((text, found, {s for s in spans if s in found}))
    weights: dict[str, float] = {}
    square: dict[str, float] = {}
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(lattices)
        for at in range(0, len(lattices), 20):
            grad: dict[str, float] = {}
            for text, found, gold in lattices[at : at + 20]:
                _gradient(text, found, gold, weights, grad)
            for f, g in sorted(grad.items()):
                g -= 0.02 * weights.get(f, 0.0)
                square[f] = square.get(f, 0.0) + g * g
                weights[f] = weights.get(f, 0.0) + 0.5 * g / (square[f] ** 0.5 + 1e-9)
    return tuple(sorted(weights.items()))


def learn(sentences: int = 500, epochs: int = 6, seed: int = 11) -> dict[str, float]:
    """Weights of the features, learnt on generated sentences; the same for the same arguments."""
    return dict(_learnt(sentences, epochs, seed))


# ---- Spark


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, weights: dict[str, float] | None = None, text_col: str = "text", masked: bool = False) -> DataFrame:
    """`docs` with a struct column `pii`: counts of the base kinds, base_sha256, spans (kind:start:end, comma-joined) and, if asked for, the masked text.

    Offsets are code points, ends exclusive. Null and empty texts have no span. Texts
    are read whole, whatever their length. Repeated rows stay; an empty table gives an
    empty result. A column named pii is replaced, all others stay, whatever their names.
    """
    require(docs, text_col)
    weights = learn() if weights is None else weights

    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with working("pii"):
            for texts in parts:
                rows = []
                for t in texts:
                    base, all_ = find_spans(t, weights)
                    kinds = [k for _, _, k in base]
                    rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_), *([mask(t, all_)] if masked else [])))
                yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", *(["masked"] if masked else [])])

    return docs.withColumn("pii", F.pandas_udf(find, _FOUND + (", masked string" if masked else ""))(text_of(text_col)))


def mask_pii(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """`docs` with personal data in `text` masked and n_chars, if there, brought up to date; null texts stay null."""
    name = fresh(docs, "__pii")
    found = find_pii(docs.withColumnRenamed("pii", name) if "pii" in docs.columns else docs, weights, masked=True)
    text = F.when(F.col("text").isNotNull(), F.col("pii.masked"))
    new = {"text": text} | ({"n_chars": F.when(F.col("text").isNotNull(), F.length("pii.masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return found.select(*[new[c].alias(c) if c in new else (F.col(name).alias(c) if c == "pii" else F.col(c)) for c in docs.columns])
