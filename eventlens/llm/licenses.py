"""License texts and phrases in documents, found by votes of word k-grams for diagonals."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlens.llm.common import ascii_lower, id_and_text
from eventlens.session import broadcast_within, settle

# What stands between words, once A-Z are lower-cased: ASCII without digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Words in a gram of a text, and in one of a phrase that is shorter than that.
GRAM, SHORT_GRAM = 5, 2
# Diagonals at most this far apart are one passage with words added or left out.
BAND = 8
# Share of a text's words that a passage must hold to be verified.
SHARE = 0.6


@dataclass(frozen=True)
class Template:
    """A license text, or a phrase that counts wherever its words stand together (``base``)."""

    label: str
    text: str
    base: bool = False


# The phrases of the query's base.
PHRASES = [
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
]

# Notices of public licenses, as their publishers word them.
NOTICES = [
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    Template("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details."""),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    Template("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    Template("apache", "Licensed under the Apache License, Version 2.0."),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3."),
    Template("mit", "Released under the MIT License."),
]

TEMPLATES = [*PHRASES, *NOTICES]


def words_of(text: str) -> list[str]:
    """Words of a template, as :func:`word_list` has those of a text."""
    return [w for w in re.split(BETWEEN, text.translate({c: c + 32 for c in range(65, 91)})) if w]


def gram_width(n_words: int, gram: int = GRAM) -> int:
    """Words in a gram of a template: a phrase of fewer than ``gram`` words has short grams."""
    return gram if n_words >= gram else min(SHORT_GRAM, n_words)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def _gram_hashes(words: Column, widths: list[int]) -> Column:
    """Hashes of all grams of each width in turn, first to last; a gram of other width hashes differently."""
    n = F.size(words)

    def of(hashes: Column, width: int) -> Column:
        starts = F.slice(F.sequence(F.lit(0), n), 1, F.greatest(n - (width - 1), F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i + 1, width)))

    # the hashes of single words are a lambda's variable, so that they are made once, not once per gram
    once = F.array(F.transform(words, lambda w: F.xxhash64(w)))
    return F.element_at(F.transform(once, lambda hashes: F.concat(*[of(hashes, w) for w in widths])), 1)


def _templates(spark: SparkSession, templates: list[Template], gram: int) -> DataFrame:
    """One row per gram of a template: ``gram, template, place, said`` (its words)."""
    rows = [(n, gram_width(len(words), gram), words) for n, t in enumerate(templates) if (words := words_of(t.text))]
    listed = spark.createDataFrame(rows, "template int, width int, words array<string>")
    widths = sorted({w for _, w, _ in rows})
    parts = [
        listed.filter(F.col("width") == w).select("template", "words", F.posexplode(_gram_hashes(F.col("words"), [w])).alias("place", "gram"))
        .select("gram", "template", "place", F.slice("words", F.col("place") + 1, w).alias("said"))
        for w in widths
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _votes(docs: DataFrame, templates: list[Template], gram: int, id_col: str, text_col: str) -> DataFrame:
    """``key, doc_id, n_words`` of each row once, and ``key, template, place, start`` of each gram it shares with a template.

    ``key`` numbers the rows. Every gram of every text is joined; what finds no
    template ends in the join, within the task that reads the text. Grams meet by
    hash and are compared as words.
    """
    widths = sorted({gram_width(len(w), gram) for t in templates if (w := words_of(t.text))})
    grams = broadcast_within(_templates(docs.sparkSession, templates, gram))
    listed = id_and_text(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("key"), "doc_id", word_list(F.col("text")).alias("words"),
    )
    hashed = listed.select(
        "key", "doc_id", "words",
        # the first entry stands for the row itself
        F.concat(F.array(F.lit(None).cast("long")), _gram_hashes(F.col("words"), widths)).alias("grams"),
    )
    each = hashed.select("key", "doc_id", "words", F.posexplode("grams").alias("at", "hash"))
    n, at = F.size("words"), F.col("at") - 1
    start, width = at, F.lit(widths[0])
    passed = F.greatest(n - (widths[0] - 1), F.lit(0))
    for w in widths[1:]:
        start, width = F.when(at >= passed, at - passed).otherwise(start), F.when(at >= passed, F.lit(w)).otherwise(width)
        passed = passed + F.greatest(n - (w - 1), F.lit(0))
    met = each.join(grams, F.col("hash") == F.col("gram"), "left")
    same = F.slice("words", start + 1, width) == F.col("said")
    return met.filter((F.col("at") == 0) | same).select(
        "key", "doc_id", F.when(F.col("at") == 0, n).cast("long").alias("n_words"), "template", "place", start.cast("long").alias("start"),
    )


def scan_licenses(
    docs: DataFrame, templates: list[Template] | None = None, gram: int = GRAM, band: int = BAND, share: float = SHARE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Where licenses stand in whole texts: ``doc_id, n_words, spans``, one row per input row.

    Each span is ``(start, end, template, coverage)``: words from 0, end exclusive,
    the template's place in ``templates``, and the share of its words found there.
    A gram that a text and a template have in common votes for a diagonal, the
    difference of its two places. A base phrase is found on a diagonal that has
    all its grams. Of other templates, diagonals at most ``band`` apart are merged, so
    that words may be added, left out or changed; a merged passage is verified
    when its grams cover ``share`` of the template's words within a stretch no longer than the
    template, that share and the band allow.

    A null text is empty and has no words; a null id is kept, and rows that repeat
    an id are scanned each for itself. Without templates, or in an empty table, nothing is found.
    Other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    kind = "array<struct<start:long,end:long,template:int,coverage:double>>"
    if not any(words_of(t.text) for t in templates):
        words = id_and_text(docs, id_col, text_col).select("doc_id", F.size(word_list(F.col("text"))).cast("long").alias("n_words"))
        return words.withColumn("spans", F.array().cast(kind))
    votes = settle(_votes(docs, templates, gram, id_col, text_col), "votes")
    lengths = [len(words_of(t.text)) for t in templates]
    length = F.element_at(F.array(*map(F.lit, lengths)), F.col("template") + 1)
    width = F.element_at(F.array(*[F.lit(gram_width(n, gram)) for n in lengths]), F.col("template") + 1)
    base = F.element_at(F.array(*[F.lit(t.base) for t in templates]), F.col("template") + 1)
    # one shuffle by row serves the diagonals, their bands and the list of spans
    cast = votes.filter("template IS NOT NULL").repartition("key")
    diagonals = cast.groupBy("key", "template", (F.col("start") - F.col("place")).alias("diagonal")).agg(
        F.min("start").alias("first"), F.max("start").alias("last"), F.collect_set("place").alias("places"),
    )
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    opens = F.when(base | gap.isNull() | (gap > band), 1).otherwise(0)
    bands = diagonals.withColumn("opens", opens).withColumn("band", F.sum("opens").over(along))
    passages = bands.groupBy("key", "template", "band").agg(
        F.min("first").alias("start"), (F.max("last") + F.first(width)).alias("end"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + width - 1)))))
    coverage = covered / length
    whole = F.col("end") - F.col("start") <= F.ceil(length / F.lit(share)) + band
    fits = F.when(base, F.size("places") == length - width + 1).otherwise((coverage >= share) & whole)
    found = passages.filter(fits).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "template", coverage.alias("coverage")))).alias("spans"),
    )
    rows = votes.filter("n_words IS NOT NULL").select("key", "doc_id", "n_words")
    return rows.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce(F.col("spans").cast(kind), F.array().cast(kind)).alias("spans"),
    )


def labels_of(spans: Column, templates: list[Template]) -> Column:
    """Distinct labels of ``spans``, sorted and comma-joined."""
    names = F.array(*[F.lit(t.label) for t in templates])
    return F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda s: F.element_at(names, s["template"] + 1)))), ",")
