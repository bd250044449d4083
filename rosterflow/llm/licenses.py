"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line of a document with the LINES - 1 lines after it, as a set of
words, so a notice is found where it wraps too; a block holds all words of the
shorter ones in it. A block matches a template when it holds at least
``threshold`` of the template's words. Words are ordered by how few documents
have them, counted over all documents. A block can only reach the threshold if
it holds one of the template's first |T| - need + 1 words in that order (prefix
filter), has at least ``need`` words of the templates at all (length filter),
and the first word in common leaves enough words behind it on both sides
(positional filter). Candidates come from an index of the templates' prefix
words and are then verified.

The index is as large as the templates, which are constants; documents are
neither shuffled nor exploded. Texts without any prefix word are not cut into
blocks. Only DataFrame expressions are used.

Null text counts as empty: no words, no labels, score 0. Very long texts are
read whole. Rows with equal ids or repeated as a whole get a row each. Extra
columns are ignored, whatever their names. An empty table gives an empty result.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import table

#: Phrases that always count, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Fixed values: (label, notice) pairs to look for.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("reserved", "Copyright. All rights reserved"),
]
THRESHOLD = 0.8
#: Lines of a block.
LINES = 4
#: Everything in ASCII that is neither a digit nor a letter.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Characters beyond ASCII that lower() turns into letters of ASCII.
TO_ASCII = ["\u0130", "\u212a"]


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case; other letters may change, but neither into ASCII nor from it."""
    odd = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in TO_ASCII])
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def template_words(notice: str) -> list[str]:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in notice.lower())
    return list(dict.fromkeys(kept.split()))


def word_order(low: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """The templates' words, those in the fewest documents first; at most as many rows as words reach the driver."""
    vocabulary = sorted({w for _, notice in templates for w in template_words(notice)})
    seen = low.select(F.explode(F.array_intersect(F.lit(vocabulary), F.split("lowered", GAP))).alias("word"))
    counts = {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _places(words: Column, phrase: str) -> Column:
    """array<int>: where ``phrase`` starts in ``words``."""
    first, *rest = phrase.split()

    def at(w, i):
        here = w == first
        for k, word in enumerate(rest, 1):
            here = here & (F.get(words, i + k) == word)
        return F.when(here, i)

    found = F.filter(F.transform(words, at), lambda i: i.isNotNull())
    has = reduce(Column.__and__, [F.array_contains(words, w) for w in dict.fromkeys([first, *rest])])
    return F.when(has, found).otherwise(F.lit([]).cast("array<int>"))


def _seen(order: list[str], phrases: dict[str, str]) -> Column:
    """struct<n_words, some, at0, at1, ...>: what one split of ``lowered`` shows; ``some`` is whether any of ``order`` is there."""

    def of(cut):
        # a gap at either end leaves an empty string there
        n = F.size(cut)
        lead = (F.get(cut, F.lit(0)) == "").cast("int")
        tail = ((n > 1) & (F.get(cut, n - 1) == "")).cast("int")
        places = [F.transform(_places(cut, p), lambda i: i - lead).alias(f"at{k}") for k, p in enumerate(phrases)]
        return F.struct((n - lead - tail).cast("bigint").alias("n_words"), F.arrays_overlap(cut, F.lit(order)).alias("some"), *places)

    # an array of one, so that the text is split once
    return F.get(F.transform(F.array(F.split("lowered", GAP)), of), F.lit(0))


def prefixes(order: list[str], templates: list[tuple[str, str]], threshold: float) -> tuple[list[list[str]], list[int], dict[str, list[tuple[int, int]]]]:
    """(words of each template in the common order, how many a block needs, prefix word -> (template, position))."""
    rank = {w: i for i, w in enumerate(order)}
    words = [sorted(template_words(notice), key=rank.__getitem__) for _, notice in templates]
    need = [math.ceil(threshold * len(w) - 1e-9) for w in words]
    index: dict[str, list[tuple[int, int]]] = {}
    for t, own in enumerate(words):
        for position, word in enumerate(own[: len(own) - need[t] + 1]):
            index.setdefault(word, []).append((t, position))
    return words, need, index


def _matches(order: list[str], templates: list[tuple[str, str]], threshold: float) -> Column:
    """array<struct<label, share>> of the templates that a block of ``lowered`` meets; empty where ``seen.some`` is false."""
    sorted_words, need, index = prefixes(order, templates, threshold)
    lookup = F.create_map(*[x for w, entries in index.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in entries]))])
    needs, sizes = F.lit(need), F.lit([len(w) for w in sorted_words])
    sets, labels = F.array(*[F.lit(w) for w in sorted_words]), F.lit([label for label, _ in templates])

    def candidates(block):
        def fetch(word, j):
            hits = F.coalesce(F.try_element_at(lookup, word), F.array().cast("array<struct<t:int,p:int>>"))

            def enough(e):
                n = F.get(needs, e["t"])
                return (F.size(block) >= n) & (F.least(F.get(sizes, e["t"]) - e["p"], F.size(block) - j) >= n)

            return F.transform(F.filter(hits, enough), lambda e: e["t"])

        return F.array_distinct(F.flatten(F.transform(block, fetch)))

    def verified(block):
        overlap = F.transform(candidates(block), lambda t: F.struct(t.alias("t"), F.size(F.array_intersect(block, F.get(sets, t))).alias("n")))
        met = F.filter(overlap, lambda m: m["n"] >= F.get(needs, m["t"]))
        return F.transform(met, lambda m: F.struct(F.get(labels, m["t"]).alias("label"), (m["n"] / F.get(sizes, m["t"])).alias("share")))

    def block(lines, i):
        # all words of the lines that templates have, in the common order
        return F.array_intersect(F.lit(order), F.flatten(F.slice(lines, i + 1, LINES)))

    def of_lines(lines):
        starts = F.filter(F.transform(lines, lambda line, i: F.when(F.size(line) > 0, i)), lambda i: i.isNotNull())
        return F.array_distinct(F.flatten(F.transform(F.transform(starts, lambda i: block(lines, i)), verified)))

    lines = F.transform(F.split("lowered", "\n"), lambda line: F.array_intersect(F.lit(order), F.split(line, GAP)))
    kind = "array<struct<label:string,share:double>>"
    found = F.get(F.transform(F.array(lines), of_lines), F.lit(0)).cast(kind)
    return F.when(F.col("seen.some"), found).otherwise(F.array().cast(kind))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, places (starts of all phrases), base (labels), matches (label, share) of each row."""
    low = docs.select("doc_id", lowered(F.coalesce("text", F.lit(""))).alias("lowered"))
    order = word_order(low, templates)
    index = prefixes(order, templates, threshold)[2]
    rows = low.withColumn("seen", _seen(sorted(index), phrases)).select("doc_id", "seen", _matches(order, templates, threshold).alias("matches"))
    ats = [F.col(f"seen.at{i}") for i in range(len(phrases))]
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(ats, phrases.values(), strict=True)]))))
    return rows.select("doc_id", "seen.n_words", F.concat(*ats).alias("places"), base.alias("base"), "matches")


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """The license report of every whole document."""
    return report(scan(table(spark, sf_dir, "documents")))


def report(found: DataFrame) -> DataFrame:
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("matches", lambda m: m["label"]))))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def report_sql(templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> str:
    """The report over ``documents`` in DuckDB's SQL: every block against every template."""

    def listed(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    known = []
    for label, notice in templates:
        words = template_words(notice)
        known.append(f"{{'label': '{label}', 'words': {listed(words)}, 'need': {math.ceil(threshold * len(words) - 1e-9)}, 'size': {len(words)}}}")
    places = []
    for phrase in phrases:
        words = phrase.split()
        met = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words, 1))
        places.append(f"list_filter(range(0, greatest(len(w) - {len(words) - 1}, 0)), lambda i: {met})")
    base = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(phrases.values()))
    every = "list_concat(" + ", list_concat(".join(f"p{i}" for i in range(len(phrases) - 1)) + f", p{len(phrases) - 1}" + ")" * (len(phrases) - 1)
    return f"""WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
    cut AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{GAP}'), lambda x: x <> '') AS w,
      str_split(t, chr(10)) AS lines,
      list_transform(range(len(lines)), lambda i: list_distinct(regexp_split_to_array(array_to_string(lines[i + 1 : i + {LINES}], chr(10)), '{GAP}'))) AS blocks FROM low),
    found AS (SELECT doc_id, len(w) AS n, {", ".join(f"{x} AS p{i}" for i, x in enumerate(places))},
      flatten(list_transform(blocks, lambda b: list_filter(list_transform([{", ".join(known)}], lambda k: {{'label': k.label, 'met': len(list_intersect(k.words, b)) >= k.need, 'share': len(list_intersect(k.words, b)) / k.size}}), lambda m: m.met))) AS ms FROM cut),
    gathered AS (SELECT doc_id, n, ms, {every} AS p, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM found)
    SELECT doc_id, n AS n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(base, list_transform(ms, lambda m: m.label)))), ',') AS labels,
      CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(list_max(list_transform(ms, lambda m: m.share)), 0.0)::DOUBLE END AS score FROM gathered"""
