"""License scans by diagonal voting, in DataFrame operations only.

Every rolling k-gram of a text's words is hashed and joined with the k-grams of a small table of templates. A hit at
word w of the text and place t of a template votes for the diagonal w - t; a passage copied in one piece has all its
votes on one diagonal, an edited one on a few neighbouring ones. Votes are added up per diagonal, diagonals that lie
within ``gap`` of each other are merged, and a merged span counts by the share of the template's k-grams it holds. The
words themselves are compared for every hit, so a hash that collides never votes.

Phrases are short templates of which each place counts only if all its k-grams are there on one diagonal. A text's
score is the best share of any template, 1 for a whole phrase.

Words are runs of characters other than the ASCII ones that are no letter or digit, A-Z lower-cased. NULL texts are
empty; a text without words, or with fewer than a k-gram, has no labels and score 0. Repeated rows are scanned one by
one. Other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidrank.llm.common import ascii_lower, whole_text

K, GAP, SHARE = 3, 4, 0.6
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for a text itself, so that texts without a hit stay in the one stream of rows.
_SELF = -1

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Wording of public licenses and their notices.
NOTICES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), _BREAK), lambda w: w != "")


def _grams(words: Column, k: int) -> Column:
    """(hash) of the k-gram at every place; none in a shorter list."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + n) for n in range(1, k)]))


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES, k: int = K) -> DataFrame:
    """One row per k-gram of every template: template, label, phrase (or notice), n_grams, place, hash and its words.

    The table has as many rows as its texts have words, whatever is scanned.
    """
    rows = [(label, True, text) for text, label in phrases.items()]
    rows += [(label, False, text) for label, texts in notices.items() for text in texts]
    split = [[w for w in re.split(_BREAK, text.lower()) if w] for _, _, text in rows]
    numbered = [(i, label, phrase, words) for i, ((label, phrase, _), words) in enumerate(zip(rows, split))]
    table = spark.createDataFrame(numbered, "template int, label string, phrase boolean, words array<string>")
    listed = table.withColumn("n_grams", F.size("words") - (k - 1))
    listed = listed.select("template", "label", "phrase", "n_grams", "words", F.posexplode(_grams(F.col("words"), k)).alias("place", "hash"))
    return listed.withColumn("gram", F.slice("words", F.col("place") + 1, F.lit(k))).drop("words")


def votes(docs: DataFrame, table: DataFrame, k: int = K) -> DataFrame:
    """Votes per text, template and diagonal; every text also has one row of template -1."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(whole_text()).alias("words"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "words", F.size("words").cast("long").alias("n_words"))
    own = F.array(F.lit(None).cast("long"))
    hits = rows.select("row", "doc_id", "n_words", "words", F.posexplode(F.concat(_grams(F.col("words"), k), own)).alias("at", "hash"))
    # The last, NULL hash of a text meets the row that stands for the text.
    self_row = table.limit(1).select(F.lit(_SELF).alias("template"), F.lit("").alias("label"), F.lit(False).alias("phrase"),
                                     F.lit(1).alias("n_grams"), F.lit(0).alias("place"), F.lit(None).cast("long").alias("hash"),
                                     F.lit(None).cast("array<string>").alias("gram"))
    wanted = F.broadcast(table.unionByName(self_row).withColumnRenamed("hash", "wanted"))
    same = F.col("gram").isNull() | (F.slice("words", F.col("at") + 1, F.lit(k)) == F.col("gram"))
    hits = hits.join(wanted, hits["hash"].eqNullSafe(wanted["wanted"]) & same)
    diagonal = F.when(F.col("template") == _SELF, 0).otherwise(F.col("at") - F.col("place"))
    keys = ["row", "doc_id", "n_words", "template", "label", "phrase", "n_grams"]
    return hits.groupBy(*keys, diagonal.alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"),
        F.collect_set("place").alias("places"),  # at most the places of a template
        F.min(F.col("at")).alias("first_at"),
        F.max(F.col("at")).alias("last_at"),
    )


def spans(voted: DataFrame, gap: int = GAP, k: int = K) -> DataFrame:
    """Diagonals within ``gap`` of each other merged: the span of words, its votes and its share of the template."""
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("phrase"), 0).otherwise(gap)
    group = F.sum(F.when(apart, 1).otherwise(0)).over(along)
    keys = ["row", "doc_id", "n_words", "template", "label", "phrase", "n_grams"]
    merged = voted.withColumn("span", group).groupBy(*keys, "span").agg(
        F.min("diagonal").alias("diagonal"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
        F.min("first_at").alias("start"),
        (F.max("last_at") + k).alias("end"),
    )
    return merged.withColumn("share", F.col("places") / F.col("n_grams"))


def scan(docs: DataFrame, table: DataFrame | None = None, share: float = SHARE, gap: int = GAP, k: int = K) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the number of spans."""
    table = templates(docs.sparkSession, k=k) if table is None else table
    found = spans(votes(docs, table, k), gap, k)
    real = F.col("template") != _SELF
    whole = real & F.col("phrase") & (F.col("places") == F.col("n_grams"))
    labelled = real & ((F.col("phrase") & whole) | (~F.col("phrase") & (F.col("share") >= share)))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    counted = F.when(real & (whole | ~F.col("phrase")), F.col("share")).otherwise(0.0)
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("start"))).cast("long").alias("last_word"),
        joined(whole).alias("base_labels"),
        joined(labelled).alias("labels"),
        F.least(F.max(counted), F.lit(1.0)).alias("score"),
        F.count_if(labelled & ~F.col("phrase")).alias("n_spans"),
    ).drop("row")
