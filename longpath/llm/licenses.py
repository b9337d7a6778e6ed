"""License scans by diagonal voting.

Licence templates are word lists. All rolling k-grams of a text's words (k = 3; 2 for templates of two words) are hashed; those that
occur in some template are joined by Spark to the positions where they stand in templates. A match at word p of a text
and word t of a template votes for the diagonal p - t, the place where the template would start. Votes are summed by
(text, template, diagonal); diagonals of one template that lie at most ``slack`` words apart are merged, so that words
put in or left out do not break a finding; a merged span is verified by the share of the template's k-grams that
it covers (distinct ones), which has to reach ``least``.

The worker that hashes drops k-grams which no template has, and compares the words of the others with the template's,
so only true matches are voted. The template table is a constant of a few hundred rows, hence broadcast by size.

Phrases are short templates whose diagonal needs all votes: their places are exact. A null or empty text has no words
and no labels. Equal rows give equal results, each its own. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longpath.llm.common import kernel, stored
from longpath.llm.words import Texts, not_alphanumeric, windows

# Phrases with their labels, then well-known sentences of licences (lower case, words as the scan takes them).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def templates() -> list[tuple[int, str, bool, list[str], int]]:
    """(number, label, whether a phrase, words, k) of all templates."""
    rows = [(label, True, text) for text, label in PHRASES.items()] + [(label, False, text) for label, text in TEMPLATES]
    return [(i, label, exact, text.split(), min(3, len(text.split()))) for i, (label, exact, text) in enumerate(rows)]


def gram_words(words: list[str]) -> np.ndarray:
    return Texts(pa.array([" ".join(words)]), not_alphanumeric(), True).h1


def gram_hash(words: list[str], k: int) -> np.ndarray:
    return windows(gram_words(words), k, k)


def gram_rows() -> list[tuple[int, int, str, bool, int, int, int]]:
    """(gram, template, label, exact, place, k, number of grams of the template)."""
    out = []
    for i, label, exact, words, k in templates():
        grams = gram_hash(words, k).astype(np.int64).tolist()
        out += [(g, i, label, exact, place, k, len(grams)) for place, g in enumerate(grams)]
    return out


def hits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row, n_words and hits array<struct<gram,pos>> (k-grams that templates have) of each text."""

    def make():
        separators = not_alphanumeric()
        grams: dict[int, dict[int, list[int]]] = {}
        for _, _, _, words, k in templates():
            single = gram_words(words).tolist()
            for place, g in enumerate(gram_hash(words, k).tolist()):
                grams.setdefault(k, {})[g] = single[place : place + k]
        keys = {k: np.sort(np.array(list(v), np.uint64)) for k, v in grams.items()}

        def f(batch: pa.RecordBatch) -> dict:
            t = Texts(batch.column("text"), separators, True)
            h = t.h1
            text_of = np.repeat(np.arange(batch.num_rows), t.count)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for k, sought in keys.items():
                w = windows(h, k, k)
                at = np.flatnonzero((sought[np.minimum(np.searchsorted(sought, w), len(sought) - 1)] == w) & (text_of[: len(w)] == text_of[k - 1 :][: len(w)]))
                for p in at.tolist():
                    if h[p : p + k].tolist() == grams[k][int(w[p])]:  # word by word
                        i = int(text_of[p])
                        found[i].append({"gram": int(w[p].astype(np.int64)), "pos": p - int(t.first[i])})
            return {id_col: batch.column(id_col), "row": batch.column("row"), "n_words": t.count.tolist(), "hits": found}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return kernel(rows, make, f"`{id_col}` {kind}, row bigint, n_words bigint, hits array<struct<gram:bigint,pos:int>>")


def license_spans(found: DataFrame, slack: int = 3) -> DataFrame:
    """row, template, label, exact, first, last (words, inclusive) and coverage of merged diagonals; exact ones stay single."""
    spark = found.sparkSession
    table = spark.createDataFrame(gram_rows(), "gram long, template int, label string, exact boolean, place int, k int, grams int")
    votes = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.gram", "hit.pos").join(F.broadcast(table), "gram")
    lines = votes.groupBy("row", "template", "label", "exact", "k", "grams", (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("place").alias("places")
    )
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    breaks = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > slack, F.lit(True))
    merged = lines.withColumn("span", F.sum(breaks.cast("int")).over(by)).groupBy("row", "template", "label", "exact", "k", "grams", "span").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n")
    )
    return merged.select("row", "template", "label", "exact", "first", (F.col("last") + F.col("k") - 1).alias("last"), (F.col("n") / F.col("grams")).alias("coverage"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slack: int = 3, least: float = 0.7) -> DataFrame:
    """One row a text: n_words, phrase places (n_base, first_word, last_word, base_labels), labels, spans and score.

    score: the largest coverage of a template or phrase, 0 without any match. spans: verified spans with label and words.
    """
    found = stored(hits(docs, id_col, text_col), "licenses")
    spans = license_spans(found, slack)
    base, good = F.col("exact") & (F.col("coverage") == 1), F.col("coverage") >= F.when(F.col("exact"), 1.0).otherwise(least)
    per_text = spans.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
        F.max("coverage").alias("score"),
        F.sort_array(F.collect_list(F.when(good, F.struct("first", "last", "label", "coverage")))).alias("spans"),
    )
    out = found.select(id_col, "row", "n_words").join(per_text, "row", "left").drop("row")
    return out.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})
