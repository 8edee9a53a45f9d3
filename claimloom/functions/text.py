"""Text expressions: tokens, overlaps, evidence cleaning and rendering, chunks, sentences, query expansion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions import constants as C


#: Bytes as in tokens: letters lower-cased, a blank for whatever is no letter a-z or digit. No byte of a longer UTF-8 character is a letter's.
_TOKEN_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else b | 32 if 65 <= b <= 90 else 32 for b in range(256))


def byte_tokens(text: bytes | None) -> list[bytes]:
    """tokens() of a text in UTF-8, for Python workers; only A-Z are lower-cased, so lower() comes first where other letters may become a-z."""
    return text.translate(_TOKEN_BYTES).split() if text else []


def coded_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """byte_tokens() of an array of texts: how many each has, a code for each token one after another, and the terms that codes stand for."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(bytes(texts.buffers()[2] or b"")[ends[0] : ends[-1]].translate(_TOKEN_BYTES), np.uint8)
    ends -= ends[0]
    is_token = data != 32
    starts, stops = is_token.copy(), is_token.copy()
    starts[1:] &= ~is_token[:-1]
    stops[:-1] &= ~is_token[1:]
    # texts lie one after another: a token ends with its text
    seam = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    starts[seam] |= is_token[seam]
    stops[seam - 1] |= is_token[seam - 1]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    places = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[is_token])).dictionary_encode()
    return np.diff(np.searchsorted(starts, ends)), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def tokens(text: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, repeats included."""
    return find_all(F.lower(col(text)), C.TOKEN)


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def space_tokens(text: Column | str) -> Column:
    """Distinct lower-cased white-space tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(col(text)), r"(?U)\s+"), lambda x: x != ""))


def strip(text: Column | str) -> Column:
    """White space off both ends, Unicode included."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(strip(text), F.lit(""))


def squeeze(text: Column | str) -> Column:
    return strip(F.regexp_replace(col(text), r"(?U)\s+", " "))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def overlap_of(claim_tokens: Column, passage_tokens: Column) -> Column:
    """Share of the claim's distinct tokens that the passage has."""
    return share(F.size(F.array_intersect(claim_tokens, passage_tokens)), F.size(claim_tokens))


def content_words(text: Column | str) -> Column:
    words = F.array_distinct(find_all(F.lower(col(text)), C.CONTENT_WORD))
    return F.array_except(words, F.array(*map(F.lit, dict.fromkeys(C.GATE_STOPWORDS))))


def gate_overlap(claim: Column | str, passage: Column | str) -> Column:
    """Overlap the relevance gate compares with its threshold, unrounded."""
    return overlap_of(content_words(claim), content_words(passage))


def pair_words(text: Column | str) -> Column:
    return F.array_except(F.filter(token_set(text), lambda x: F.length(x) > 2), F.array(*map(F.lit, C.PAIR_STOPWORDS)))


def pair_overlap(claim: Column | str, passage: Column | str) -> Column:
    """Overlap stored with per-passage pairs, rounded half-even to 4 places."""
    return F.bround(overlap_of(pair_words(claim), pair_words(passage)), 4)


def jaccard(left: Column, right: Column) -> Column:
    """0 for two empty sets."""
    return share(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right)))


def clean_block(text: Column | str) -> Column:
    """White space squeezed and leading markers ([E1], Passage 1:, Evidence A:, bullets) off until none is left."""
    return strip(F.regexp_replace(squeeze(text), C.MARKERS, ""))


def evidence_blocks(text: Column | str) -> Column:
    """Cleaned non-empty lines; if none, the cleaned text."""
    lines = F.filter(F.transform(F.split(col(text), r"\R"), clean_block), lambda x: x != "")
    whole = F.filter(F.array(clean_block(text)), lambda x: x != "")
    return F.when(F.size(lines) > 0, lines).otherwise(whole)


def sanitize(text: Column | str) -> Column:
    return F.array_join(evidence_blocks(text), "\n")


def canonical_blocks(blocks: Column) -> Column:
    """Cleaned blocks, the first of each lower-cased text, ordered by that text."""

    def kept(cleaned: Column) -> Column:
        keyed = F.transform(cleaned, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))
        # sorted by key and place: an entry stays unless the one before has its key
        return let(F.array_sort(keyed), lambda s: F.transform(F.filter(F.transform(s, lambda e, i: F.struct(e.alias("e"), F.get(s, i - 1).alias("b"))), lambda p: p["b"].isNull() | (p["b"]["k"] != p["e"]["k"])), lambda p: p["e"]["x"]))

    return let(F.filter(F.transform(blocks, clean_block), lambda x: x != ""), kept)


def verifier_text(claim: Column | str, evidence: Column | str) -> Column:
    return F.concat(F.lit("Claim: "), col(claim), F.lit("\nEvidence: "), F.array_join(canonical_blocks(evidence_blocks(evidence)), "\n"))


def format_block(body: Column, index: Column, style: Column) -> Column:
    """One block in a style; index counts from 1."""
    return (
        F.when(style == "plain", body)
        .when(style == "passage", F.concat(F.lit("Passage "), index.cast("string"), F.lit(": "), body))
        .when(style == "evidence_letter", F.concat(F.lit("Evidence "), F.char(index + 64), F.lit(": "), body))
        .when(style == "bullet", F.concat(F.lit("- "), body))
        .otherwise(F.concat(F.lit("[E"), index.cast("string"), F.lit("] "), body))
    )


def render_evidence(passages: Column, style: Column | str = "plain", include_title: bool = True, canonicalize: bool = False, shuffle_seed: Column | None = None) -> Column:
    """Passages (array of structs with text and title) as numbered lines.

    Empty texts go. `canonicalize` keeps the first of equal lower-cased blocks and
    orders by title and text; else `shuffle_seed` orders by a hash of seed and place.
    """
    style = F.lit(style) if isinstance(style, str) else style
    blocks = F.transform(passages, lambda p: F.struct(clean_block(p["text"]).alias("text"), (F.nullif(clean_block(F.coalesce(p["title"], F.lit(""))), F.lit("")) if include_title else F.lit(None).cast("string")).alias("title")))
    blocks = F.filter(blocks, lambda b: b["text"] != "")
    if canonicalize:
        keyed = F.transform(blocks, lambda b, i: F.struct(F.coalesce(F.lower(b["title"]), F.lit("")).alias("t"), F.lower(b["text"]).alias("x"), i.alias("i"), b.alias("b")))
        names = F.transform(keyed, lambda k: F.struct(k["t"], k["x"]))
        kept = F.filter(keyed, lambda k: F.array_position(names, F.struct(k["t"], k["x"])) == k["i"] + 1)
        blocks = F.transform(F.array_sort(kept), lambda k: k["b"])
    elif shuffle_seed is not None:
        keyed = F.transform(blocks, lambda b, i: F.struct(F.sha2(F.concat_ws("|", shuffle_seed, i.cast("string")), 256).alias("h"), b.alias("b")))
        blocks = F.transform(F.array_sort(keyed), lambda k: k["b"])
    return F.array_join(F.transform(blocks, lambda b, i: format_block(F.concat(F.coalesce(F.concat(b["title"], F.lit(": ")), F.lit("")), b["text"]), i + 1, style)), "\n")


def evidence_style(seed: Column | str) -> Column:
    """Style picked by the sum of code points."""
    total = F.aggregate(F.transform(F.filter(F.split(col(seed), ""), lambda x: x != ""), F.ascii), F.lit(0), lambda a, b: a + b)
    return F.element_at(F.array(*map(F.lit, C.STYLES)), (total % len(C.STYLES) + 1).cast("int"))


def index_text(title: Column | str, text: Column | str, metadata: Column | None = None) -> Column:
    """Title, text and metadata windows, trimmed, the empty ones left out, joined by a space."""
    parts = [blank_to_null(title), blank_to_null(text)]
    if metadata is not None:
        parts += [blank_to_null(metadata[k]) for k in C.INDEX_WINDOWS]
    return F.concat_ws(" ", *parts)


def sentences(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(text), C.SENTENCE_END), strip), lambda x: x != "")


def chunks(text: Column | str, size: int = 256, overlap: int = 32) -> Column:
    """Windows of `size` words that share `overlap`; the last one ends with the text. [] for a blank text."""
    check_chunks(size, overlap)
    words = F.filter(F.split(col(text), r"(?U)\s+"), lambda x: x != "")
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " ")))


def check_chunks(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")


def expand_query(query: Column | str, most: int = 4) -> Column:
    """Up to `most` rewritings: capitalised runs of one to four words, the first six keywords, the last four."""
    empty = F.array().cast("array<string>")

    def expanded(cleaned: Column) -> Column:
        found = F.filter(F.transform(find_all(cleaned, r"(?:[A-Z][a-z0-9'\-]+(?:\s+|$)){1,4}"), squeeze), lambda e: (e != "") & (F.lower(e) != F.lower(cleaned)))
        first = let(found, lambda es: F.filter(es, lambda e, i: F.array_position(F.transform(es, F.lower), F.lower(e)) == i + 1))
        words = F.filter(find_all(cleaned, r"[A-Za-z0-9][A-Za-z0-9'\-]*"), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*C.QUERY_STOPWORDS))
        return let(F.struct(F.slice(first, 1, most).alias("e"), words.alias("w"), F.lower(cleaned).alias("c")), with_keywords)

    def with_keywords(s: Column) -> Column:
        head = F.array_join(F.slice(s["w"], 1, 6), " ")
        tail = F.array_join(F.when(F.size(s["w"]) > 4, F.slice(s["w"], -4, 4)).otherwise(s["w"]), " ")
        new = lambda t: ~F.array_contains(F.transform(s["e"], F.lower), F.lower(t)) & (F.lower(t) != s["c"])
        with_head = (F.size(s["w"]) > 0) & new(head)
        with_tail = (F.size(s["w"]) > 1) & new(tail) & ~(with_head & (F.lower(head) == F.lower(tail)))
        return F.slice(F.concat(s["e"], F.when(with_head, F.array(head)).otherwise(empty), F.when(with_tail, F.array(tail)).otherwise(empty)), 1, most)

    return let(squeeze(query), expanded)


def contains_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def claim_category(claim: Column | str) -> Column:
    """First that holds: negation, numerical, temporal, entity, possible multi-hop; else entity."""
    low = F.lower(col(claim))
    return (
        F.when(contains_any(low, C.NEGATIONS), "negation")
        .when(F.regexp_like(col(claim), F.lit(r"\p{Nd}")), "numerical")
        .when(contains_any(low, C.MONTHS), "temporal")
        .when(contains_any(low, C.QUESTION_WORDS), "entity")
        .when(contains_any(low, C.CAUSAL_WORDS), "possible multi-hop")
        .otherwise("entity")
    )


def negative_type(title: Column, gold_titles: Column, gold_label: Column, overlap: Column, rank: Column) -> Column:
    """Why a passage that isn't gold was retrieved."""
    same = (gold_label != C.NEI) & title.isNotNull() & (title != "") & F.array_contains(gold_titles, title)
    return F.when(same, "same_entity_insufficient").when(overlap >= 0.5, "same_topic_missing_fact").when(rank <= 2, "near_miss").otherwise("irrelevant")


def date_tokens(text: Column | str) -> Column:
    low = F.lower(col(text))
    return F.array_union(find_all(low, C.DATES[0]), find_all(low, C.DATES[1]))


def unescape_title(title: Column | str) -> Column:
    """Underscores to spaces, then wiki escapes: -LRB- ( -RRB- ) -LSB- [ -RSB- ] -COLON- :"""
    out = F.replace(col(title), F.lit("_"), F.lit(" "))
    for a, b in (("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "["), ("-RSB-", "]"), ("-COLON-", ":")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
