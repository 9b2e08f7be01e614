"""License scanning by diagonal voting (operator 13), in DataFrame operations only.

Templates (phrases and notices) and texts are cut into words; every run of K words is a gram.  All grams of all texts, one row
each, are joined by hash (and, against collisions, by their words) to the grams' places in the templates.  A hit at word i
of a text and word t of a template votes for the diagonal i - t.  A template whose grams all vote for one diagonal stands there
word for word.  Words left out or put in shift the diagonal, so diagonals of one template that are at most `gap` apart are
merged; a merged run is a span, and it is verified by the share of the template's grams that it holds and by its length.

Each text gives one more row, with its number of words, beside its grams; so texts are read once and nothing is joined back.
Rows are kept apart by id and SHA-256 of the text.  Equal rows meet in the first aggregation, which counts them, and are
given back as often as they came.  The templates' grams are broadcast below MOST_GRAMS rows and joined by a shuffle above.

Defined cases: a null text is empty; a text without words has no labels, no places and score 0; a null id is kept; repeated ids
with different texts are rows of their own; equal rows give equal results; a long text is one array in one task while it is
cut, and its grams are rows after that; an empty table gives no rows; extra columns of any name are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a gram, how far apart merged diagonals may be, the share of a template's grams that a span needs, and
#: how much longer than the template it may be.
K, GAP, LEAST, STRETCH = 3, 4, 0.75, 1.5
MOST_GRAMS = 100_000


@dataclass(frozen=True)
class Template:
    """base: a phrase that counts only where it stands word for word."""

    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.translate(str.maketrans(UPPER, UPPER.lower())))


#: The phrases of the base labels, and public license notices.
TEMPLATES = (
    Template("mit", "under the MIT License", base=True),
    Template("apache-2", "Apache License, Version 2", base=True),
    Template("cc-by-nc", "CC BY-NC", base=True),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
)


def grams(spark: SparkSession, templates: Sequence[Template] = TEMPLATES, k: int = K) -> DataFrame:
    """A row (template, at, gram, grams, base, label) for each gram of each template."""
    rows = []
    for t, template in enumerate(templates):
        words = template.words
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {template.text}")
        n = len(words) - k + 1
        rows += [(t, i, " ".join(words[i : i + k]), n, template.base, template.label) for i in range(n)]
    return spark.createDataFrame(rows, "template int, at int, gram string, grams int, base boolean, label string").withColumn("hash", F.xxhash64("gram"))


def spans(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, gap: int = GAP, least: float = LEAST, stretch: float = STRETCH) -> DataFrame:
    """Merged diagonals, a row each: (id, blob, copies, n_words, label, base, start, end, share, verified), in words, end exclusive.

    A text without any gives one row without label.  Phrases (base) are whole or not at all, so their unmerged diagonals are
    judged: each place is a span of its own."""
    table = grams(docs.sparkSession, templates, k)
    if table.count() <= MOST_GRAMS:
        table = F.broadcast(table)
    text = F.coalesce(docs[text_col], F.lit(""))
    words = docs.select(docs[id_col].alias("id"), F.sha2(text, 256).alias("blob"), F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(WORD), F.lit(0)).alias("w"))
    n = F.size("w")
    cut = F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
    # the row before all grams stands for the text itself
    each = words.select("id", "blob", n.alias("n_words"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), cut)).alias("i", "gram"))
    each = each.withColumn("hash", F.xxhash64("gram")).alias("x")
    hits = each.join(table.alias("t"), (F.col("x.hash") == F.col("t.hash")) & (F.col("x.gram") == F.col("t.gram")), "left").where("x.i = 0 or t.template is not null")
    # grams start at row 1; equal rows meet here
    votes = hits.groupBy("id", "blob", "n_words", "template", "grams", "base", "label", "at", (F.col("i") - 1 - F.coalesce("at", F.lit(0))).alias("diagonal")).agg(F.count("*").alias("copies"))
    votes = votes.repartition("id", "blob")
    of = W.partitionBy("id", "blob", "template").orderBy("diagonal", "at")
    step = F.col("diagonal") - F.lag("diagonal").over(of)
    new = F.when(step.isNull() | (step > F.when(F.col("base"), 0).otherwise(gap)), 1).otherwise(0)
    runs = votes.withColumn("new", new).withColumn("run", F.sum("new").over(of))
    place = F.col("diagonal") + F.col("at")
    found = runs.groupBy("id", "blob", "n_words", "template", "grams", "base", "label", "run", "at").agg(F.max("copies").alias("copies"), F.min(place).alias("low"), F.max(place).alias("high"))
    found = found.groupBy("id", "blob", "n_words", "template", "grams", "base", "label", "run").agg(
        F.max("copies").alias("copies"), F.min("low").alias("start"), (F.max("high") + k).alias("end"), (F.count("*") / F.col("grams")).alias("share")
    )
    whole = (F.col("share") >= F.when(F.col("base"), 1.0).otherwise(least)) & (F.col("end") - F.col("start") <= stretch * (F.col("grams") + k - 1))
    return found.select("id", "blob", "copies", "n_words", "label", "base", "start", "end", "share", F.coalesce(whole, F.lit(False)).alias("verified"))


def report(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Rows of spans() by text: (id, n_words, n_base, first_word, last_word, base_labels, labels, score), as often as the text came.

    score: the largest share of a template's grams in one span, verified or not; 0 without any."""
    base = F.col("verified") & F.col("base")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    each = found.groupBy("id", "blob", "n_words").agg(
        F.max(F.when(F.col("label").isNull(), F.col("copies"))).alias("copies"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.col("verified")).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    rows = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
