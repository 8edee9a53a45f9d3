"""Language of a text by compression.

Every language has a zstandard dictionary of raw content: pieces of its training texts,
as they stand. A text is lower-cased, what lies between its letters becomes one space,
and it is compressed, in pieces of PIECE bytes, with each dictionary in turn. The
language whose dictionary leaves it smallest is its own; if the runner-up comes close,
the answer is marked as not reliable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm._common import fresh, require, text_of, working
from claimloom.llm._learn import remainder

#: A dictionary takes so many bytes, from at most so many documents of its language, of each so many code points.
DICTIONARY_BYTES = 65_536
DOCUMENTS = 512
SNIPPET = 1_024
#: Texts are compressed in pieces: a longer one would learn more from itself than from the dictionary.
PIECE = 4_096
LEVEL = 6
#: Bytes by which a rival has to be larger to count e times less.
TEMPERATURE = 6.0
#: Least lead over the second, in parts of the second's size, and least score of a reliable answer.
MARGIN = 0.01
RELIABLE = 0.75
UNKNOWN = "und"

#: What is not a letter, in Python's sense and in Java's.
_GAPS = re.compile(r"[\W\d_]+")
LETTER = r"\p{L}"


@dataclass(frozen=True)
class Languages:
    """Names, most frequent first (equal sizes go to the first), and the raw content of each one's dictionary."""

    names: tuple[str, ...]
    contents: tuple[bytes, ...]
    level: int = LEVEL


def letters_of(text: str) -> bytes:
    """The whole text lower-cased, every run of anything but letters as one space, in UTF-8."""
    return _GAPS.sub(" ", text.lower()).encode("utf-8", "replace")


def fit(docs: DataFrame, fit_on: Column | None = None, documents: int = DOCUMENTS, size: int = DICTIONARY_BYTES, level: int = LEVEL) -> Languages:
    """Dictionaries of the languages in `lang`, from rows for which `fit_on` holds (default: crc32 of doc_id modulo 4 is not 2).

    At most `documents` rows of a language are looked at, the first in the order of a
    hash of the id and text, and SNIPPET code points of each from a hashed place; equal
    snippets count once. Null languages and texts teach nothing; an empty table gives no
    language. Languages stand in falling order of their training rows, then by name.
    What is collected is bounded by those parameters times the number of languages.
    """
    require(docs, "doc_id", "text", "lang")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fit_on if fit_on is not None else remainder("doc_id", 4) != 2))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("__h")).select("lang", "text", "__h", ((F.col("__h").bitwiseAND(F.lit(2**62 - 1))) / 2.0**62).alias("__u"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return Languages((), (), level)
    # four times as many rows as wanted get past their language's bar, so no window ever meets a whole language
    bars = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 4.0 * documents / r["n"])))])
    begin = F.pmod("__h", F.greatest(F.length("text") - SNIPPET, F.lit(0)) + 1).cast("int")
    near = rows.where(F.col("__u") <= bars[F.col("lang")]).select("lang", "__u", "__h", F.substring(F.col("text"), begin + 1, F.lit(SNIPPET)).alias("__snippet"))
    near = near.groupBy("lang", "__snippet").agg(F.min("__u").alias("__u"))
    order = Window.partitionBy("lang").orderBy("__u", "__snippet")
    got = near.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= documents).orderBy("lang", "__rn").toPandas()
    names, contents = [], []
    for r in counts:
        parts, length = [], 0
        for snippet in got.loc[got["lang"] == r["lang"], "__snippet"]:
            part = letters_of(snippet)
            parts.append(part)
            length += len(part) + 1
            if length >= size:
                break
        names.append(r["lang"])
        contents.append(b" ".join(parts)[:size])
    return Languages(tuple(names), tuple(contents), level)


class _Sizes:
    """Compressed sizes of a text under every dictionary."""

    def __init__(self, languages: Languages) -> None:
        self.with_dictionary = []
        for content in languages.contents:
            # a dictionary of under eight bytes is refused; such a language compresses without one
            kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            if kept is not None:
                kept.precompute_compress(level=languages.level)
            self.with_dictionary.append(zstandard.ZstdCompressor(level=languages.level, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, body: bytes) -> list[int]:
        pieces = [body[i : i + PIECE] for i in range(0, len(body), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.with_dictionary]


def decide(sizes: list[int], margin: float = MARGIN) -> tuple[int, float, float, bool]:
    """Place of the smallest size (the first of equal ones), its score, its lead and whether to rely on it."""
    s = np.asarray(sizes, np.float64)
    best = int(np.argmin(s))
    score = float(1.0 / np.exp(np.maximum(-(s - s[best]) / TEMPERATURE, -700.0)).sum())
    second = float(np.partition(s, 1)[1]) if len(s) > 1 else float(s[best])
    lead = (second - s[best]) / second if second and len(s) > 1 else (1.0 if len(s) == 1 else 0.0)
    return best, score, float(lead), bool(lead >= margin and score >= RELIABLE)


def identify(docs: DataFrame, languages: Languages, out: str = "language", margin: float = MARGIN) -> DataFrame:
    """`docs` with a struct `out`: lang, score (0 to 1), lead and reliable; other columns as they are.

    `lang` is the language of the smallest size. It is `und`, with score 0 and not
    reliable, where the text is null or has no letter, or no language was learnt. A
    narrow answer keeps its language and is marked by `reliable` = false: the lead over
    the second is under `margin`, or the score under RELIABLE. Whole texts are compressed
    whatever their length; repeated rows get equal answers; an empty table stays empty.
    """
    require(docs, "text")
    name = fresh(docs, out)

    @F.pandas_udf("lang string, score double, lead double, reliable boolean")
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with working("language"):
            sizes = _Sizes(languages)
            for batch in texts:
                rows = []
                for text in batch:
                    best, score, lead, sure = decide(sizes(letters_of(text)), margin)
                    rows.append((languages.names[best], score, lead, sure))
                yield pd.DataFrame(rows, columns=["lang", "score", "lead", "reliable"])

    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("lead"), F.lit(False).alias("reliable"))
    if not languages.names:
        return docs.withColumn(name, unknown)
    known = text_of().rlike(LETTER)
    return docs.withColumn(name, F.when(known, measured(F.when(known, F.col("text")).otherwise(""))).otherwise(unknown))
