"""License scans: phrase places, and an exact containment join of text blocks with license templates.

Everything is DataFrame functions. The blocks of a template of m words are the windows of 2m words that
begin at every m-th word of a text, so that line ends, indents and comment marks, which hold no words, do
not matter, and every stretch of m + 1 words lies within one block. Tokens are ordered by how many
documents have them, rarest first. A template of n tokens of which a must be met is found through its
n - a + 1 rarest tokens (prefix filter); blocks with fewer than a template tokens (length filter) and
places of a token after which too few remain (positional filter) are left out before the sets are compared.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import keep

#: The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Sentences by which licenses are usually named or begun, with the method's own labels.
TEMPLATES = (
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "This program is licensed under the GNU General Public License, version 2."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("mit-name", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "Copyright. All rights reserved. No part of this publication may be reproduced without permission."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("mit-full", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("mit-warranty", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    ("bsd-name", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law."),
)
#: Templates are a stated set and are broadcast; there may be so many tokens of them.
TEMPLATE_TOKENS = 100_000
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(low: Column) -> Column:
    """Words with two spaces between them and one or more around, so that each has a space of its own on either side."""
    return F.concat(F.lit(" "), F.regexp_replace(low, OTHER, "  "), F.lit(" "))


def word_count(part: Column) -> Column:
    """Words of a spaced text."""
    bare = F.trim(part)
    return F.when(bare == "", F.lit(0)).otherwise((F.length(bare) - F.length(F.replace(bare, F.lit("  "), F.lit("")))) / 2 + 1).cast("long")


def _phrase(phrase: str) -> str:
    return f" {'  '.join(phrase.split())} "


def base(documents: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word and found (labels) of every row."""
    text = F.col("text").cast("string")
    words = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), spaced(lowered(text)).alias("words"))
    count = {}
    for i, (phrase, _) in enumerate(phrases):
        key = _phrase(phrase)
        count[i] = F.when(F.contains("words", F.lit(key)), (F.length("words") - F.length(F.replace("words", F.lit(key), F.lit("")))) / len(key)).otherwise(0).cast("long")
    out = words.select("*", *[c.alias(f"n{i}") for i, c in count.items()], word_count(F.col("words")).alias("n_words"))
    hit = lambda i: F.col(f"n{i}") > 0
    firsts = [F.when(hit(i), word_count(F.substring_index("words", _phrase(p), 1))) for i, (p, _) in enumerate(phrases)]
    lasts = [F.when(hit(i), F.col("n_words") - word_count(F.substring_index("words", _phrase(p), -1)) - len(p.split())) for i, (p, _) in enumerate(phrases)]
    pick = lambda f, xs: f(*xs) if len(xs) > 1 else xs[0]
    found = F.filter(F.array(*[F.when(hit(i), F.lit(label)) for i, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())
    return out.select(
        "doc_id", "text_hash", "n_words", reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in count]).alias("n_base"),
        pick(F.least, firsts).alias("first_word"), pick(F.greatest, lasts).alias("last_word"), found.alias("found"),
    )


def _templates(spark: SparkSession, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """label, tokens (distinct), span (words), n (tokens) and needed of each template."""
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(text).alias("text")) for label, text in templates])
    table = spark.range(1).select(F.explode(rows).alias("t")).select("t.label", F.filter(F.split(lowered(F.col("t.text")), OTHER), lambda w: w != "").alias("words"))
    table = table.select("label", F.array_distinct("words").alias("tokens"), F.size("words").alias("span")).where("span > 0")
    return table.select("*", F.size("tokens").alias("n"), F.ceil(F.size("tokens") * F.lit(threshold) - 1e-9).cast("int").alias("needed"))


def contained(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, text_hash, first, beyond (words from 0), label, containment: every block and template at or above the threshold.

    Containment is the share of the template's distinct tokens that the block has. Around each prefix token of a
    text only the words that its blocks can hold go on, so rows stay small however long the text is.
    """
    told = keep(_templates(documents.sparkSession, templates, threshold))
    vocabulary = sorted(r["token"] for r in told.select(F.explode("tokens").alias("token")).distinct().limit(TEMPLATE_TOKENS + 1).collect())
    if len(vocabulary) > TEMPLATE_TOKENS:
        raise ValueError("too many template tokens for a broadcast")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = F.array(*[F.lit(w) for w in vocabulary])
    words = F.split(lowered(F.col("text")), OTHER)
    # the global order: document frequencies of the templates' tokens over the whole table
    frequency = rows.select(F.explode(F.array_intersect(words, known)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    everywhere = {r["token"]: r["df"] for r in frequency.collect()}
    ranked = F.array(*[F.lit(w) for w in sorted(vocabulary, key=lambda w: (everywhere.get(w, 0), w))])
    # prefix of each template in that order
    tokens = told.select("label", "n", "needed", "span", "tokens", F.array_intersect(ranked, F.col("tokens")).alias("sorted"))
    prefix = tokens.select("label", "n", "needed", "span", "tokens", F.posexplode(F.slice("sorted", F.lit(1), F.col("n") - F.col("needed") + 1)).alias("i", "token"))
    starts = sorted(r["token"] for r in prefix.select("token").distinct().collect())
    longest = told.agg(F.max("span").alias("m")).collect()[0]["m"] or 1
    texts = rows.where(F.arrays_overlap(words, F.array(*[F.lit(w) for w in starts])))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), F.filter(words, lambda w: w != "").alias("words"))

    def around(pos: Column) -> Column:
        begin = F.greatest(pos - 2 * longest, F.lit(0))
        return F.struct(pos.alias("pos"), F.get("words", pos).alias("token"), begin.alias("begin"), F.slice("words", begin + 1, F.lit(4 * longest)).alias("words"))

    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(starts))
    seeds = texts.select("doc_id", "text_hash", F.explode(F.transform(at, around)).alias("s")).select("doc_id", "text_hash", "s.*")
    near = seeds.join(F.broadcast(prefix), "token")
    last = F.floor(F.col("pos") / F.col("span")).cast("int")
    near = near.withColumn("step", F.explode(F.sequence(F.greatest(last - 1, F.lit(0)), last))).withColumn("first", F.col("step") * F.col("span"))
    block = F.slice("words", F.col("first") - F.col("begin") + 1, 2 * F.col("span"))
    near = near.withColumn("have", F.array_intersect(ranked, block)).where(F.size("have") >= F.col("needed"))
    j = F.array_position("have", F.col("token")).cast("int") - 1
    reach = F.least("i", j) + 1 + F.least(F.col("n") - F.col("i") - 1, F.size("have") - j - 1)
    common = F.size(F.array_intersect("have", "tokens"))
    found = near.where(reach >= F.col("needed")).withColumn("common", common).where("common >= needed")
    return found.select("doc_id", "text_hash", "first", (F.col("first") + 2 * F.col("span")).alias("beyond"), "label", (F.col("common") / F.col("n")).alias("containment")).distinct()


def closest(found: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """``found`` without what a closer template explains.

    A template gives way to one of greater containment in an overlapping block if that template holds it at the
    threshold itself: a text of the one is always found for the other too. Labels at other places all stay.
    """
    told = keep(_templates(found.sparkSession, templates, threshold))
    rival = told.select(F.col("label").alias("other"), F.col("tokens").alias("theirs"))
    rivals = told.join(F.broadcast(rival), (F.col("label") != F.col("other")) & (F.size(F.array_intersect("tokens", "theirs")) >= F.col("needed"))).select("label", "other")
    found = keep(found)
    wide = 2 * (told.agg(F.max("span").alias("m")).collect()[0]["m"] or 1)
    cells = F.explode(F.sequence(F.floor(F.col("first") / wide), F.floor((F.col("beyond") - 1) / wide)))
    mine = found.join(F.broadcast(rivals), "label").withColumn("cell", cells)
    theirs = found.select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("label").alias("l"), F.col("first").alias("f"), F.col("beyond").alias("b"), F.col("containment").alias("c"), cells.alias("cell_of")
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("other") == F.col("l")) & (F.col("cell") == F.col("cell_of"))
    better = (F.col("c") > F.col("containment")) & (F.col("f") < F.col("beyond")) & (F.col("first") < F.col("b"))
    lost = mine.join(theirs, same & better, "left_semi").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("label").alias("l"), F.col("first").alias("f"))
    gone = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("label") == F.col("l")) & (F.col("first") == F.col("f"))
    return found.join(lost, gone, "left_anti")


def scan(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, a row for each row of documents.

    The method's own labels are those of ``closest``. score: 1 with a base phrase, else the best containment of a template at or above the threshold,
    else 0. A null or empty text has no words and no labels (empty strings). Repeated rows each give
    a row; a null doc_id is passed on; extra columns are ignored.
    """
    hits = closest(contained(documents, templates, threshold), templates, threshold)
    hits = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))  # at most the templates' labels
    hits = keep(hits).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "own", "best")
    rows = base(documents).join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    join = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    own = F.coalesce("own", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("found")).alias("base_labels"), join(F.concat("found", own)).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
