"""License scans by a positional rare-token index, in DataFrame functions alone.

The index holds the postings (template, place) of each word of the license templates. A first pass counts in how many
files each of these words occurs, for its inverse document frequency. The second pass looks up the highest-IDF licence
words that a file itself has: per template, from the rarest one on, until the words looked up and those the file lacks
weigh more than a passing template may miss. So every start that can pass is voted for by at least one word, whichever
of them the file has altered. A word's place less its place in the template votes for a start; at the starts voted for
the mandatory key phrase is verified word by word and the words of the whole template in place are weighed by IDF. All of
it happens inside the file's row, so nothing is shuffled but the counts of template words.

A template counts at each start that passes; its score is the IDF share of its words in place (1 for an exact text).
Defined cases: a null text is empty and has no words; an empty table has no IDF and no rows; repeated rows give repeated
results; ties of IDF go to the alphabetically first word; overlapping places all count; a text may be of any length.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's IDF that must stand in place.
LEAST_SHARE = 0.75


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Words of the key phrase: a slice of ``text`` that must stand exactly. Empty: the whole text.
    key: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> tuple[int, int]:
        """Start and length of the key phrase among the words."""
        key, words = (self.key or self.text).split(), self.words
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key), len(key)


#: Phrases and notices of public licenses, as lower-cased words.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("apache", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    Template("bsd", "bsd license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    Template("isc", "isc license"),
    Template("lgpl", "lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    Template("mpl", "mozilla public license"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "distributed under the license"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copies or substantial portions"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "free and unencumbered software released into the public domain", "unencumbered software"),
)


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def document_frequency(files: DataFrame, text: str = "text", templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of files, and of files with each template word. Their words alone are counted, so the result is as small as the templates."""
    vocabulary = sorted({w for t in templates for w in t.words})
    present = F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, vocabulary)))
    # the blank word stands for every file, so one aggregate gives both
    rows = files.select(F.explode(F.concat(F.array(F.lit("")), present)).alias("w")).groupBy("w").count().collect()
    counts = {r.w: r["count"] for r in rows}
    return counts.pop("", 0), counts


def inverse_frequency(n: int, counts: dict[str, int], templates=TEMPLATES) -> dict[str, float]:
    """ln((n + 1) / (files with the word + 0.5)) of every template word."""
    return {w: math.log((n + 1) / (counts.get(w, 0) + 0.5)) for t in templates for w in t.words}


_INDEX = """array<struct<label: string, base: boolean, key_at: int, key: array<string>, total: double, slack: double,
  posting: array<struct<word: string, place: int, idf: double>>, rare: array<struct<word: string, mass: double>>>>"""


def index_column(idf: dict[str, float], templates=TEMPLATES) -> Column:
    """The index as one constant: per template its words with place and IDF, its distinct words from the rarest on with
    the IDF of all their places, the key phrase, and the IDF a passing start may miss."""
    rows = []
    for t in templates:
        own, (at, size) = t.words, t.key_at
        total = sum(idf[w] for w in own) or 1.0
        rows.append({
            "label": t.label, "base": t.base, "key_at": at, "key": own[at : at + size], "total": total, "slack": (1 - LEAST_SHARE) * total * (1 + 1e-9),
            "posting": [{"word": w, "place": i, "idf": idf[w]} for i, w in enumerate(own)],
            "rare": [{"word": w, "mass": idf[w] * own.count(w)} for w in sorted(set(own), key=lambda w: (-idf[w], w))],
        })
    return F.from_json(F.lit(json.dumps(rows)), _INDEX)


def _looked_up(present: Column, t: Column) -> Column:
    """The file's highest-IDF words of a template. A start where none of them stands misses more than the template's slack."""
    has = lambda x: F.array_contains(present, x["word"])
    lacking = F.aggregate(t["rare"], F.lit(0.0), lambda m, x: m + F.when(has(x), 0.0).otherwise(x["mass"]))
    taken = lambda state, x: F.struct((state["missed"] + x["mass"]).alias("missed"), F.concat(state["chosen"], F.array(x["word"])).alias("chosen"))
    start = F.struct(lacking.alias("missed"), F.array().cast("array<string>").alias("chosen"))
    return F.aggregate(t["rare"], start, lambda state, x: F.when(has(x) & (state["missed"] <= t["slack"]), taken(state, x)).otherwise(state))["chosen"]


def _starts(words: Column, places: Column, chosen: Column, t: Column) -> Column:
    """Starts of a template that a chosen word votes for: the word's place less each of its places in the template."""
    posting = F.filter(t["posting"], lambda x: F.array_contains(chosen, x["word"]))
    voted = F.flatten(F.transform(posting, lambda x: F.transform(F.filter(places, lambda p: p["word"] == x["word"]), lambda p: p["at"] - x["place"])))
    return F.array_distinct(voted)


def _matches(words: Column, places: Column, chosen: Column, t: Column) -> Column:
    """Starts of a template that pass: array of (label, start, share, base)."""
    in_key = lambda s: (s + t["key_at"] >= 0) & (F.slice(words, F.greatest(F.lit(1), s + t["key_at"] + 1), F.size(t["key"])) == t["key"])
    stands = lambda s, x: F.when(F.get(words, s + x["place"]) == x["word"], x["idf"]).otherwise(0.0)
    share = lambda s: F.aggregate(t["posting"], F.lit(0.0), lambda m, x: m + stands(s, x)) / t["total"]
    fits = F.filter(_starts(words, places, chosen, t), in_key)
    weighed = F.transform(fits, lambda s: F.struct(t["label"].alias("label"), s.cast("long").alias("start"), F.least(F.lit(1.0), share(s)).alias("share"), t["base"].alias("base")))
    return F.filter(weighed, lambda x: x["share"] >= LEAST_SHARE)


def scan(files: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per file: key, n_words, n_base, first_word, last_word, base_labels, labels, score, and matches
    (array of label, start, share, base)."""
    idf = inverse_frequency(*document_frequency(files, text, templates), templates)
    vocabulary = sorted({w for t in templates for w in t.words})
    words, places, present = F.col("_words"), F.col("_places"), F.col("_present")
    own = files.select(F.col(key).alias("_key"), words_of(F.col(text)).alias("_words"))
    at = F.transform(words, lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.alias("at"))))
    looked_up = own.withColumn("_places", F.filter(at, lambda p: p.isNotNull()))
    looked_up = looked_up.withColumn("_present", F.array_distinct(F.transform(places, lambda p: p["word"])))
    none = F.array().cast("array<struct<label: string, start: bigint, share: double, base: boolean>>")
    # the words looked up are settled once per template; a template that needs more than the file has goes here
    asked = F.transform(index_column(idf, templates), lambda t: F.struct(t.alias("template"), _looked_up(present, t).alias("chosen")))
    voting = F.filter(asked, lambda x: F.size(x["chosen"]) > 0)
    found = F.flatten(F.transform(voting, lambda x: _matches(words, places, x["chosen"], x["template"])))
    matched = looked_up.select("_key", F.size("_words").cast("long").alias("n_words"), F.when(F.size(present) > 0, found).otherwise(none).alias("matches"))
    base = F.filter("matches", lambda m: m["base"])
    joined = lambda matches: F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return matched.select(
        F.col("_key").alias(key), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"), "matches",
    )

