"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of ``BLOCK_WORDS`` words of the whole text, moved on by half:
it runs across lines, as notices do, and every run of up to half its words, more
than any template has, lies whole in a block. A block matches a template if it holds at least ``THRESHOLD`` of the
template's distinct words. Words are ordered by their document frequency in the
whole input, rarest first; a template that must overlap in ``o`` of its ``t``
words shares one of its first ``t - o + 1`` words with the block (prefix
filter), a block of fewer than ``o`` such words cannot match (length filter),
and a shared word at places i and j leaves at most ``min(i, j) + min(t - i,
b - j)`` shared words (positional filter). What is left is verified exactly.
Words of no template never count, so they are left out of the blocks' sets.

Defined cases: null and empty texts have no words, no places and no labels
(empty strings, score 0); repeated rows each get a row; templates that tie give
all their labels; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, words

#: Phrases that count wherever their words stand consecutively.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Common license notices, as words, and their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under the creative commons attribution 4 0 international license", "cc-by-4"),
    ("licensed under the creative commons attribution sharealike 4 0 international license", "cc-by-sa-4"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("licensed under the creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
]
THRESHOLD = 0.85
BLOCK_WORDS = 64
PLACES = "array<struct<start:int,label:string>>"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _needed(size: int, threshold: float) -> int:
    return math.ceil(round(threshold * size, 9))


def _places(w: Column, phrase: list[str], label: str) -> Column:
    k, want = len(phrase), _strings(phrase)
    first = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
    starts = F.filter(first, lambda i: F.slice(w, i, k) == want)
    return F.transform(starts, lambda i: F.struct((i - 1).alias("start"), F.lit(label).alias("label")))


def scan_licenses(
    docs: DataFrame,
    phrases=PHRASES,
    templates=TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of docs: doc_id, n_words, places (start, label), matches (label, first word of the block, containment)."""
    sets = [(sorted(set(t.split())), label) for t, label in templates]
    vocabulary = sorted({w for s, _ in sets for w in s} | {w for p, _ in phrases for w in p.split()})

    d = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        words(F.col(text_col)).alias("w"),
    ).withColumn("held", F.array_distinct(F.filter("w", lambda x: x.isin(vocabulary))))
    whole = lambda ws: F.size(F.array_except(_strings(ws), F.col("held"))) == 0
    can_match = F.lit(False)
    for s, _ in sets:  # a block can't hold more of a template than its text does
        can_match |= F.size(F.array_intersect("held", _strings(s))) >= _needed(len(s), threshold)
    places = F.array().cast(PLACES)
    for phrase, label in phrases:
        own = _places(F.col("w"), phrase.split(), label)
        places = F.concat(places, F.when(whole(sorted(set(phrase.split()))), own).otherwise(F.array().cast(PLACES)))
    scan = materialise(
        d.select(
            "row",
            "doc_id",
            F.size("w").cast("long").alias("n_words"),
            "held",
            F.when(can_match, F.col("w")).alias("w"),
            places.alias("places"),
        ),
        "licenses",
    )

    counts = {r[0]: r[1] for r in scan.select(F.explode("held").alias("x")).groupBy("x").count().collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    by_rank = sorted(vocabulary, key=rank.get)
    ordered = [(sorted(s, key=rank.get), label, _needed(len(s), threshold)) for s, label in sets]
    least = min(o for _, _, o in ordered)
    index = [
        (k, label, len(s), o, w, i + 1) for k, (s, label, o) in enumerate(ordered) for i, w in enumerate(s[: len(s) - o + 1])
    ]
    prefixes = docs.sparkSession.createDataFrame(index, "t int, label string, t_size int, o int, x string, i int")
    full = F.create_map(*[c for k, (s, _, _) in enumerate(ordered) for c in (F.lit(k), _strings(s))])

    half = BLOCK_WORDS // 2
    blocks = (
        scan.filter(F.col("w").isNotNull())
        .select("row", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(half))).alias("at"))
        .filter((F.col("at") == 0) | (F.size("w") - F.col("at") > half))
        .withColumn("b", F.array_intersect(_strings(by_rank), F.slice("w", F.col("at") + 1, BLOCK_WORDS)))
        .select("row", "at", "b", F.size("b").alias("b_size"))
        .filter(F.col("b_size") >= least)
    )
    i, j, t, b = F.col("i"), F.col("j"), F.col("t_size"), F.col("b_size")
    pairs = (
        blocks.select("*", F.posexplode(F.slice("b", 1, b - least + 1)).alias("j", "x"))
        .withColumn("j", F.col("j") + 1)
        .join(F.broadcast(prefixes), "x")
        .filter((b >= F.col("o")) & (F.least(i, j) + F.least(t - i, b - j) >= F.col("o")))
        .dropDuplicates(["row", "at", "t"])
        .withColumn("shared", F.size(F.array_intersect("b", F.element_at(full, F.col("t")))))
        .filter(F.col("shared") >= F.col("o"))
    )
    match = F.struct("label", "at", (F.col("shared") / t).alias("containment"))
    per = pairs.groupBy("row").agg(F.array_sort(F.collect_list(match)).alias("matches"))
    return scan.join(per, "row", "left").select("doc_id", "n_words", "places", "matches")


def op10_query(docs: DataFrame) -> DataFrame:
    out = scan_licenses(docs)
    starts, labels = F.col("places.start"), F.col("places.label")
    more = F.coalesce(F.col("matches.label"), F.array().cast("array<string>"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max("matches.containment"), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def _oracle() -> str:
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = lambda c: f"list_filter(string_split_regex({lower.format(c)}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS start, '{label}' AS label FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {len(p.split()) - 1})) AS i FROM d WHERE len(w) >= {len(p.split())} AND list_contains(w, '{p.split()[0]}')) WHERE array_to_string(w[i : i + {len(p.split()) - 1}], ' ') = '{p}'"
        for p, label in PHRASES
    )
    sets = [(sorted(set(t.split())), label) for t, label in TEMPLATES]
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, {len(s)} AS t, len(list_filter([{', '.join(repr(x) for x in s)}], lambda x: list_contains(b, x))) AS shared, {_needed(len(s), THRESHOLD)} AS o FROM bl"
        for s, label in sets
    )
    half = BLOCK_WORDS // 2
    return f"""
WITH d AS (SELECT doc_id, {split('text')} AS w FROM documents),
places AS ({places}),
bl AS (SELECT doc_id, w[a + 1 : a + {BLOCK_WORDS}] AS b FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, {half})) AS a FROM d WHERE len(w) > 0) WHERE a = 0 OR len(w) - a > {half}),
found AS (SELECT * FROM ({found}) WHERE shared >= o),
p AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM places GROUP BY doc_id),
pl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM found) GROUP BY doc_id),
sc AS (SELECT doc_id, max(CAST(shared AS DOUBLE) / t) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(pl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN pl ON d.doc_id = pl.doc_id LEFT JOIN al ON d.doc_id = al.doc_id LEFT JOIN sc ON d.doc_id = sc.doc_id
"""


ORACLE_SQL = _oracle()
