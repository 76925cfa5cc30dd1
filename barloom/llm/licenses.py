"""License scan by diagonal voting, in DataFrame functions only.

Every text is cut into words; each word opens a k-gram (two words for phrases, three for notices), whose hash is joined to the positions of equal grams in
the templates and checked there word for word.  A hit votes for a diagonal, the word of the text at which the template would begin.  Votes of a diagonal are
one bit mask over the template's grams, so that repeated hits and repeated rows count once and the shuffle carries a row per text, template and diagonal.

A phrase stands where all its grams vote for one diagonal, which is exact.  For a notice, diagonals that lie at most ``SLACK`` words apart are merged, since an
inserted or missing word moves the rest to the next one; the merged span counts if its mask covers ``LEAST`` of the grams and it is at most ``STRETCH`` times
as long as the notice.  The score is the best coverage of any template.

The templates are a fixed, small table, which is what is copied to all tasks.  Each has at most 64 grams, the bits of a mask; longer texts are cut in
several templates of one label.  Rows are told apart by doc_id and a hash of the text; equal rows get equal results.

Defined cases: a null text is empty and has no words; a null doc_id is like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import row_keys

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLACK, LEAST, STRETCH = 3, 0.7, 1.5


@dataclass(frozen=True)
class Template:
    """``exact``: a phrase, all of whose words must stand consecutively."""

    label: str
    text: str
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return "".join(c if c.isalnum() else " " for c in self.text.lower()).split()

    @property
    def k(self) -> int:
        return 2 if self.exact else 3

    @property
    def grams(self) -> int:
        return len(self.words) - self.k + 1


# Phrases and public notices.
PHRASES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
             "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
             "copies of the Software"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
             "Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
             "notice and this permission notice appear in all copies"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by", "licensed under CC BY 4.0"),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0"),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0"),
    Template("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"),
    Template("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
TEMPLATES = PHRASES + NOTICES


def words_of(text: Column) -> Column:
    """The words of a text in order; letters are lower-cased, which moves no word's borders."""
    cut = F.split(F.lower(text), SEPARATORS, -1)
    lead, tail = (F.element_at(cut, i) == "" for i in (1, -1))
    return F.slice(cut, F.when(lead, 2).otherwise(1), F.greatest(F.size(cut) - lead.cast("int") - tail.cast("int"), F.lit(0)))


def template_grams(spark, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """template, tpos, k and the words a, b, c (null for phrases) of every gram, with the hash it is joined by."""
    if any(not 1 <= t.grams <= 64 for t in templates):
        raise ValueError("a template needs 1 to 64 grams; cut longer ones in several of one label")
    rows = [(n, i, *t.words[i:i + 2], None if t.exact else t.words[i + 2]) for n, t in enumerate(templates) for i in range(t.grams)]
    return spark.createDataFrame(rows, "template int, tpos int, ta string, tb string, tc string").withColumn("th", F.xxhash64("ta", "tb"))


def votes(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """_rk_id, _rk_h, template, diagonal, mask (bits of the template's grams found on it), lo, hi (first and last word that opens one)."""
    texts = row_keys(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    cut = texts.select("_rk_id", "_rk_h", words_of(F.col("text")).alias("w")).filter(F.size("w") > 1)
    later = [F.slice("w", i, F.size("w")) for i in (2, 3)]
    opened = cut.select("_rk_id", "_rk_h", F.posexplode(F.arrays_zip(F.col("w").alias("a"), later[0].alias("b"), later[1].alias("c"))).alias("pos", "g"))
    grams = opened.select("_rk_id", "_rk_h", "pos", F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.col("g.c").alias("c"))
    known = F.broadcast(template_grams(docs.sparkSession, templates))  # at most 64 rows for each template of the given list
    same = (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")) & (F.col("tc").isNull() | (F.col("c") == F.col("tc")))
    hits = grams.join(known, (F.xxhash64("a", "b") == F.col("th")) & same)
    return hits.groupBy("_rk_id", "_rk_h", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("mask"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


def spans(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """_rk_id, _rk_h, template, label, exact, start, stop (words, end exclusive), coverage, found: merged diagonals of every template."""
    kind = docs.sparkSession.createDataFrame([(i, t.label, t.exact, t.k, t.grams, len(t.words)) for i, t in enumerate(templates)],
                                             "template int, label string, exact boolean, k int, grams int, length int")
    of = Window.partitionBy("_rk_id", "_rk_h", "template").orderBy("diagonal")
    met = votes(docs, templates).join(F.broadcast(kind), "template")
    new = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(of) > SLACK, F.lit(True))
    merged = met.withColumn("span", F.sum(new.cast("int")).over(of)).groupBy("_rk_id", "_rk_h", "template", "span").agg(
        F.bit_or("mask").alias("mask"), F.min("lo").alias("start"), (F.max("hi") + F.first("k")).alias("stop"),
        *[F.first(n).alias(n) for n in ("label", "exact", "grams", "length")])
    coverage = F.bit_count("mask") / F.col("grams")
    whole = F.when(F.col("exact"), coverage == 1).otherwise((coverage >= LEAST) & (F.col("stop") - F.col("start") <= STRETCH * F.col("length")))
    return merged.select("_rk_id", "_rk_h", "template", "label", "exact", "start", "stop", coverage.alias("coverage"), whole.alias("found"))


def scanned(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word and last_word (starts of phrases), base_labels, labels, score."""
    base = F.col("found") & F.col("exact")

    def joined(which: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")

    found = spans(docs, templates).groupBy("_rk_id", "_rk_h").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"), joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"),
        F.round(F.max("coverage"), 6).alias("score"))
    texts = row_keys(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows = texts.select(F.col("doc_id").cast("long"), "_rk_id", "_rk_h", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = {"n_base": F.lit(0), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return rows.join(found, ["_rk_id", "_rk_h"], "left").select(
        "doc_id", "n_words", *[F.coalesce(n, none[n]).alias(n) if n in none else F.col(n)
                               for n in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])
