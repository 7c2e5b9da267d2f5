"""License scan by diagonal voting.

All word k-grams of a text are hashed; those that occur in a template are joined to the template's
positions, and each match votes for the diagonal ``text position - template position``. Votes on
neighbouring diagonals (words put in or left out) are merged, and the span below a merged diagonal
is verified by which of the template's words stand in it at their place: all of them, word for word,
for a phrase; for a template as many as the similarity asks, of the longer of template and span, and
each of its numbers, as versions must agree.

A match is a row of four numbers: no text is shuffled, and a text that repeats a phrase, or a long
template, takes no more than its matches.

Defined results
    null or wordless text: no words, no labels, score 0; texts are scanned whole; a null doc_id is
    kept; repeated rows give repeated rows; spans that overlap, of one licence or of several, all count, and equal
    labels once; an empty table gives no rows; other columns, also of clashing names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import lower_ascii

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    exact: bool = False


# The phrases that the contract names.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

# Texts and openings of well-known licences, matched approximately.
TEMPLATES = (
    Template("mit", "released under the mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer",
    ),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2"),
    Template("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    Template("lgpl-3", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved"),
    # The parts that follow the openings above, each a template of its own, as texts often hold only some.
    Template(
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
    ),
    Template(
        "isc",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable "
        "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software",
    ),
    Template(
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    Template(
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    Template(
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    Template(
        "apache-2",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    Template(
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
    ),
    Template(
        "unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
)


def words_of(text: Column) -> Column:
    """Lower-cased words; a text that starts with a separator yields an empty first item, which is cut."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _gram(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(k)])


def template_grams(like: DataFrame, templates: tuple[Template, ...], k: int) -> DataFrame:
    """``template, label, exact, n, numbers, tpos, gram``: as many rows as the templates have words."""
    rows = []
    for i, t in enumerate(templates):
        words = t.words.split()
        rows.append((i, t.label, t.exact, len(words), [j for j, w in enumerate(words) if w.isdigit()], words))
    base = like.sparkSession.createDataFrame(rows, "template int, label string, exact boolean, n int, numbers array<int>, w array<string>").coalesce(1)
    return base.withColumn("tpos", F.explode(F.sequence(F.lit(0), F.col("n") - k))).withColumn("gram", _gram(F.col("w"), F.col("tpos"), k)).drop("w")


def scan_licenses(
    documents: DataFrame,
    phrases: tuple[Template, ...] = PHRASES,
    templates: tuple[Template, ...] = TEMPLATES,
    k: int = 3,
    slack: int = 2,
    least_votes: float = 0.5,
    least_similarity: float = 0.8,
) -> DataFrame:
    """One row per row of ``doc_id, text``.

    ``n_words``, ``n_base``, ``first_word``, ``last_word``: places of the phrases; ``base_labels``,
    ``labels``: distinct, sorted, comma-joined, the latter with the templates' too; ``score``: the best
    similarity of a verified span, 0 without one; ``spans``: array of ``label, start, length,
    similarity``. ``slack``: diagonals that far apart are merged.

    Grams that no template has are dropped before rows are made of the rest, so what is shuffled
    grows with the matches; a document goes to one task with its matches only.
    """
    grams = template_grams(documents, phrases + templates, k)
    known = sorted({r.gram for r in grams.select("gram").collect()})  # of the fixed templates
    docs = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("w"))
    docs = docs.withColumn("n_words", F.size("w").cast("long"))
    places = F.when(F.size("w") >= k, F.filter(F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.struct(i.alias("pos"), _gram(F.col("w"), i, k).alias("gram"))), lambda p: p["gram"].isin(known)))
    hit = docs.select("row", "doc_id", "n_words", F.explode_outer(places).alias("h")).select("row", "doc_id", "n_words", "h.*")
    kept = ("doc_id", "n_words", "label", "exact", "n", "numbers")
    voted = (
        hit.repartition("row")
        .join(F.broadcast(grams), "gram", "left")
        .groupBy("row", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(*[F.first(c).alias(c) for c in kept], F.collect_set("tpos").alias("at"))
    )
    by = W.partitionBy("row", "template").orderBy("diagonal")
    voted = voted.withColumn("new", F.when(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(by) > slack) | F.lag("diagonal").over(by).isNull(), 1).otherwise(0))
    voted = voted.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    merged = voted.groupBy("row", "template", "run").agg(
        *[F.first(c).alias(c) for c in kept], F.sum(F.size("at")).alias("votes"), F.flatten(F.collect_list("at")).alias("at"),
        F.min(F.col("diagonal") + F.array_min("at")).alias("begins"), (F.max(F.col("diagonal") + F.array_max("at")) + k).alias("ends"),
    )
    held = F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + k - 1))))
    merged = merged.withColumns({"held": held, "begins": F.col("begins").cast("long"), "length": (F.col("ends") - F.col("begins")).cast("long")})
    alike = F.when(F.forall("numbers", lambda i: F.array_contains("held", i)), F.size("held") / F.greatest("n", "length")).otherwise(0.0)
    merged = merged.withColumn("similarity", F.when(F.col("exact"), (F.size("held") == F.col("n")).cast("double")).otherwise(alike))
    verified = F.col("template").isNotNull() & (F.col("votes") >= F.ceil((F.col("n") - k + 1) * F.lit(least_votes))) & (F.col("similarity") >= F.when(F.col("exact"), 1.0).otherwise(least_similarity))
    base = verified & F.col("exact")
    return (
        merged.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count_if(base).cast("long").alias("n_base"),
            F.min(F.when(base, F.col("begins"))).alias("first_word"), F.max(F.when(base, F.col("begins"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(verified, F.col("label")))), ",").alias("labels"),
            F.coalesce(F.max(F.when(verified, F.col("similarity"))), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(verified, F.struct("begins", "length", "label", "similarity")))).alias("spans"),
        )
        .drop("row")
    )
