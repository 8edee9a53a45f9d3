"""License scans by a positional rare-token index, in DataFrame functions only.

Templates are word lists; their postings are (word, template, position). Document
frequencies over all documents weigh the words (IDF). A template is looked up by its
rarest words: as many as make sure that every place with enough of the template's IDF
mass has at least two of them where they must stand. Every occurrence of such a word in
a file gives the places where its templates would start; the postings are intersected by
that relative position, and a place on which enough of them agree counts if the mass
that stands there is enough and the mandatory key phrase stands where it must. All of it
happens in the file's own row, so no file and no word gathers rows in a task.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm._common import require, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's IDF mass that must match, and postings that must agree where a template has as many words.
COVER, AGREE = 0.8, 2
#: A place is one number: the template above so many bits, and the start, moved by SHIFT to be positive, below.
PLACE, SHIFT = 33, 1024


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False


# Base phrases and notices, as words, each with its mandatory key phrase.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    Template("apache-2", "under the terms of the apache license 2 0", "apache license 2"),
    Template("gpl-3", "under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template("lgpl", "under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "under the gnu affero general public license", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd", "use of this source code is governed by a bsd style license", "bsd style license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4"),
    Template("proprietary", "all rights reserved", "all rights reserved"),
)


def words_of(text_col: str = "text") -> Column:
    """A-Z lower-cased, then runs of anything but ASCII other than digits and letters."""
    return F.regexp_extract_all(F.translate(text_of(text_col), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def document_frequencies(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each template word; one row per template word comes to the driver."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    held = F.array_intersect(words_of(text_col), F.array(*map(F.lit, vocabulary)))
    found = docs.select(F.explode(F.array_union(held, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in found}
    return counts.pop("", 0), counts


def idf(n: int, df: int) -> int:
    """Whole thousandths, so that sums don't depend on their order."""
    return 1 + round(1000 * math.log((n + 1) / (df + 1)))


def rare_words(words: list[str], weights: list[int], df: dict[str, int], cover: float, agree: int = AGREE) -> tuple[set[str], int]:
    """(the fewest rarest words of a template, n): wherever `cover` of the mass stands, n of their places or more do; n is `agree` if the template has as many."""
    spare = math.floor(sum(weights) * (1 - cover) + 1e-6)
    rare: set[str] = set()
    sure = 0
    for word in sorted(set(words), key=lambda w: (df.get(w, 0), w)):
        rare.add(word)
        held = sorted((x for w, x in zip(words, weights, strict=True) if w in rare), reverse=True)
        # n - 1 places, be they the heaviest, are too light for what is left of these words' mass
        sure = max((n for n in range(1, len(held) + 1) if sum(held[: n - 1]) < sum(held) - spare), default=0)
        if sure >= agree:
            return rare, agree
    return rare, max(1, sure)


_TEMPLATE = "array<struct<label string, base boolean, words array<string>, weights array<int>, mass int, key array<string>, key_at int, agree int, cover double>>"


def index_of(n: int, df: dict[str, int], templates: tuple[Template, ...] = TEMPLATES, cover: float = COVER) -> tuple[list[dict], dict[str, list[int]]]:
    """(what is known of each template, the postings: each rare word's places as numbers to which a position is added). A base phrase must match whole."""
    known, postings = [], {}
    for i, t in enumerate(templates):
        words = t.text.split()
        weights = [idf(n, df.get(w, 0)) for w in words]
        rare, agree = rare_words(words, weights, df, 1.0 if t.base else cover)
        key = t.key.split()
        key_at = next(k for k in range(len(words)) if words[k : k + len(key)] == key)
        known.append({"label": t.label, "base": t.base, "words": words, "weights": weights, "mass": sum(weights), "key": key, "key_at": key_at, "agree": agree, "cover": 1.0 if t.base else cover})
        for k, w in enumerate(words):
            if w in rare:
                postings.setdefault(w, []).append((i << PLACE) + SHIFT - k)
    return known, postings


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, cover: float = COVER) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base phrases count at every place where all their words stand; first_word and
    last_word are their smallest and largest start, null if there is none. `labels` has
    the base labels and those of templates found, at any place where `cover` of the IDF
    mass and the key phrase stand; `score` is the largest share of a template's IDF mass
    at one place, 0 if nothing is found. Null and empty texts have no words. Texts are
    read whole whatever their length. Rows that repeat id and text give repeated rows,
    null ids stay; an empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    require(docs, id_col, text_col)
    if max(len(t.text.split()) for t in templates) > SHIFT:
        raise ValueError(f"a template has more than {SHIFT} words")
    known, postings = index_of(*document_frequencies(docs, text_col, templates), templates, cover)
    table = F.from_json(F.lit(json.dumps(known)), _TEMPLATE)
    index = F.from_json(F.lit(json.dumps(postings)), "map<string,array<bigint>>")
    files = docs.select(F.col(id_col).alias("id"), words_of(text_col).alias("file"))
    # every occurrence of a rare word, as the places its postings propose
    proposed = F.transform("file", lambda w, i: F.when(w.isin(*postings), F.transform(F.element_at(index, w), lambda at: at + i)))
    files = files.select("id", "file", F.array_sort(F.flatten(F.array_compact(proposed))).alias("at"))
    # places on which enough postings agree stand side by side
    number = lambda place: F.shiftright(place, PLACE).cast("int")
    here = lambda i: F.get("at", i)
    agreed = F.filter(F.sequence(F.lit(0), F.size("at") - 1), lambda i: (here(i) == here(i + F.get(table, number(here(i)))["agree"] - 1)) & ((i == 0) | (here(i) != here(i - 1))))
    files = files.select("id", "file", F.when(F.size("at") > 0, F.transform(agreed, here)).otherwise(F.array().cast("array<bigint>")).alias("places"))

    def weighed(place: Column) -> Column:
        t, start = F.get(table, number(place)), (place.bitwiseAND(F.lit((1 << PLACE) - 1)) - SHIFT).cast("int")
        stands = lambda i: F.get("file", start + i) == F.get(t["words"], i)
        mass = F.aggregate(F.sequence(F.lit(0), F.size(t["words"]) - 1), F.lit(0), lambda sum_, i: sum_ + F.when(stands(i), F.get(t["weights"], i)).otherwise(0))
        key = start + t["key_at"]
        keyed = (key >= 0) & (F.slice("file", F.greatest(key, F.lit(0)) + 1, F.size(t["key"])) == t["key"])
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), start.alias("start"), F.when(keyed, mass / t["mass"]).otherwise(0.0).alias("cover"), t["cover"].alias("least"))

    found = F.filter(F.transform("places", weighed), lambda p: p["cover"] >= p["least"])
    files = files.select("id", F.size("file").cast("long").alias("n_words"), found.alias("found"))
    files = files.select("id", "n_words", "found", F.filter("found", lambda p: p["base"]).alias("based"))
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")
    starts = F.transform("based", lambda p: p["start"].cast("long"))
    return files.select(
        F.col("id").alias(id_col), "n_words", F.size("based").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("based").alias("base_labels"), labels("found").alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda p: p["cover"])), F.lit(0.0)).alias("score"),
    )
