"""License scans by ordered signature rules, in built-in functions only.

A text is cut into words, and a hash look-up finds which of the rules' gate words it has; most texts end there. The others
become their words, joined by single spaces. Rules are regexes over that; each rule has a keyword, and only rules whose
keyword the text contains are tried. A match is an interval of words with its rule's label and
priority. A match inside another's interval is suppressed where the other has the higher priority, or the same and a longer
interval; the labels of what remains are the result. A place of a base phrase always counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.llm import common
from ratewise.llm.license_signatures import HAND

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Longer signatures written by hand: (label, keyword, regex, priority).
SIGNATURES = (
    ("mit", "hereby granted free", r"permission is hereby granted free of charge to any person obtaining a copy", 90),
    ("isc", "permission to use", r"permission to use copy modify and(?: or)? distribute this software for any purpose", 90),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms", 90),
    ("gpl", "free software", r"free software you can redistribute it and or modify it under the terms of the gnu general public license", 95),
    ("lgpl", "free software", r"free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", 96),
    ("agpl", "free software", r"free software you can redistribute it and or modify it under the terms of the gnu affero general public license", 96),
    ("apache", "licensed under", r"licensed under the apache license(?: version)?(?: 2 0)?", 85),
    ("mit", "licensed under", r"licensed under the mit license", 85),
    ("unlicense", "public domain", r"free and unencumbered software released into the public domain", 90),
    ("public-domain", "public domain", r"(?:dedicated|released|placed) (?:to|into|in) the public domain", 60),
    ("cc", "cc by", r"cc by(?: (?:sa|nd|nc|nc sa|nc nd))?(?: [1-4] [05])?", 70),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 75),
    ("proprietary", "all rights", r"all rights reserved", 40),
    ("spdx", "spdx", r"spdx license identifier(?: [0-9a-z]+){1,3}", 80),
)


#: Words too common to gate a keyword that has another one.
_COMMON = {"the", "do", "what", "under", "any", "of", "in", "with", "as", "along", "provided", "without"}


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, regex, priority), all written by hand."""
    return [*SIGNATURES, *HAND]


def gate_word(keyword: str) -> str:
    """The word of a keyword that a text is asked for first: the longest, common ones last."""
    return max(keyword.split(), key=lambda w: (w not in _COMMON, len(w)))


_HIT = "struct<first:int,last:int,priority:int,label:string>"


def _groups() -> Column:
    by_keyword: dict[str, list] = {}
    for label, keyword, regex, priority in rules():
        by_keyword.setdefault(keyword, []).append(F.struct(F.lit(label).alias("label"), F.lit(rf"(?<= ){regex}(?= )").alias("regex"), F.lit(priority).alias("priority")))
    return F.array(*[F.struct(F.lit(gate_word(k)).alias("gate"), F.lit(k).alias("keyword"), F.array(*v).alias("rules")) for k, v in by_keyword.items()])


def _word_count(piece: Column) -> Column:
    """Words of a stretch that begins or ends with the blank between words."""
    return F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))


def _hits(text: Column, present: Column) -> Column:
    """All matches in a text of words, each with one blank before and after it; present: the gate words that the text has."""
    open_ = lambda g: F.array_contains(present, g["gate"]) & F.contains(text, F.concat(F.lit(" "), g["keyword"], F.lit(" ")))
    tried = F.flatten(F.transform(F.filter(_groups(), open_), lambda g: g["rules"]))

    def of(rule):
        found = F.regexp_extract_all(text, rule["regex"], F.lit(0))
        before = F.split(text, rule["regex"], -1)  # what lies before each match, and the rest
        step = lambda acc, k: F.struct(
            (acc["at"] + _word_count(before[k]) + _word_count(found[k])).cast("int").alias("at"),
            F.array_append(acc["out"], F.struct(
                (acc["at"] + _word_count(before[k]) - 1).cast("int").alias("first"), (acc["at"] + _word_count(before[k]) - 1 + _word_count(found[k])).cast("int").alias("last"),
                rule["priority"].alias("priority"), rule["label"].alias("label"))).alias("out"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_HIT}>").alias("out"))
        return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])).otherwise(F.array().cast(f"array<{_HIT}>"))

    return F.flatten(F.transform(tried, of))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, hits for every row.

    n_base: places where a base phrase's words stand consecutively; first_word, last_word: smallest and largest start among
    them. labels: base labels and those of the matches that no other match suppresses. score: 1 with a base phrase, else
    the highest priority over 100, else 0. hits: the matches left, as word intervals. A null text is empty; repeated
    rows are scanned each; an empty table gives an empty result. Nothing is shuffled.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("t"))
    # lower() finds the same words as A-Z alone: it changes no word's ends, and gate words are all ASCII
    cut = rows.select("doc_id", "t", F.split(F.lower("t"), _GAP, -1).alias("cut"))
    gates = F.array(*[F.lit(w) for w in sorted({gate_word(k) for _, k, _, _ in rules()})])
    n_words = F.size("cut") - (F.get("cut", F.lit(0)) == "").cast("int") - ((F.size("cut") > 1) & (F.element_at("cut", -1) == "")).cast("int")
    gated = cut.select("doc_id", "t", n_words.cast("bigint").alias("n_words"), F.array_intersect("cut", gates).alias("present"))
    joined = F.concat(F.lit(" "), F.trim(F.regexp_replace(common.ascii_lower(F.col("t")), _GAP, " ")), F.lit(" "))
    counted = gated.select("doc_id", "n_words", "present", F.when(F.size("present") > 0, joined).alias("w"))

    none = F.array().cast("array<int>")
    starts = []
    words = F.split(F.trim("w"), " ")
    for phrase, _ in BASE:
        parts = phrase.split(" ")
        places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), _stands(parts))
        starts.append(F.when(F.contains("w", F.lit(f" {phrase} ")), places).otherwise(none))
    based = counted.withColumn("words", F.when(F.rlike("w", F.lit("|".join(f" {p} " for p, _ in BASE))), words))
    based = based.withColumn("places", F.array(*[F.coalesce(s, none) for s in starts])).drop("words")
    matched = based.withColumn("found", F.when(F.col("w").isNotNull(), _hits(F.col("w"), F.col("present")))).drop("w", "present")

    def outranked(x):
        wider = lambda y: (y["first"] <= x["first"]) & (y["last"] >= x["last"])
        longer = lambda y: y["last"] - y["first"] > x["last"] - x["first"]
        return F.exists(F.col("found"), lambda y: wider(y) & ((y["priority"] > x["priority"]) | ((y["priority"] == x["priority"]) & longer(y))))

    hits = F.coalesce(F.filter("found", lambda x: ~outranked(x)), F.array().cast(f"array<{_HIT}>"))
    base = F.filter(F.array(*[F.when(F.size(F.col("places")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    every = F.flatten("places")
    done = matched.select("doc_id", "n_words", every.alias("every"), base.alias("base"), hits.alias("hits"))
    best = F.array_max(F.transform("hits", lambda x: x["priority"])) / 100.0
    return done.select(
        "doc_id", "n_words", F.size("every").cast("bigint").alias("n_base"), F.array_min("every").cast("bigint").alias("first_word"), F.array_max("every").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("hits", lambda x: x["label"])))), ",").alias("labels"),
        F.when(F.size("every") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"), "hits",
    )


def _stands(parts: list[str]):
    def fits(i):
        out = F.get(F.col("words"), i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out = out & (F.coalesce(F.get(F.col("words"), i + k), F.lit("")) == p)
        return out

    return fits
