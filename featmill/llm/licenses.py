"""License scans by diagonal voting (DataFrame functions only).

Every run of three words of every text is hashed and joined with the places of the same run in license templates.
A match of text word p with template word t votes for the diagonal p - t; a template that stands in the text
unchanged gets a vote for each of its runs on one diagonal, an edited one gets its votes on neighbouring diagonals,
which are merged. A span counts if enough of the template's runs are found within a stretch not much longer than the
template, and no better span of another template lies over it: templates that differ in one word find each other's
notices. Hash matches are confirmed on the words themselves, so a vote is never wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featmill.llm.common import text_of

RUN, GAP, SHARE, STRETCH = 3, 4, 0.6, 1.5

# Phrases whose every place counts, and the labels they give (fixed values).
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Notices found also where a few words differ (fixed values: the public wording of the licenses).
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files the software to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
            " granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
    # Whole licenses.
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files the software to deal in the software without restriction including without limitation the"
            " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
            " persons to whom the software is furnished to do so subject to the following conditions the above copyright"
            " notice and this permission notice shall be included in all copies or substantial portions of the software the"
            " software is provided as is without warranty of any kind express or implied including but not limited to the"
            " warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the"
            " authors or copyright holders be liable for any claim damages or other liability whether in an action of"
            " contract tort or otherwise arising from out of or in connection with the software or the use or other dealings"
            " in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
            " granted provided that the above copyright notice and this permission notice appear in all copies the software"
            " is provided as is and the author disclaims all warranties with regard to this software including all implied"
            " warranties of merchantability and fitness in no event shall the author be liable for any special direct"
            " indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether"
            " in an action of contract negligence or other tortious action arising out of or in connection with the use or"
            " performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met 1 redistributions of source code must retain the above copyright notice this"
            " list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above"
            " copyright notice this list of conditions and the following disclaimer in the documentation and or other"
            " materials provided with the distribution this software is provided by the copyright holders and contributors"
            " as is and any express or implied warranties including but not limited to the implied warranties of"
            " merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or"
            " contributors be liable for any direct indirect incidental special exemplary or consequential damages including"
            " but not limited to procurement of substitute goods or services loss of use data or profits or business"
            " interruption however caused and on any theory of liability whether in contract strict liability or tort"
            " including negligence or otherwise arising in any way out of the use of this software even if advised of the"
            " possibility of such damage"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held"
             " liable for any damages arising from the use of this software permission is granted to anyone to use this"
             " software for any purpose including commercial applications and to alter it and redistribute it freely subject"
             " to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that"
             " you wrote the original software if you use this software in a product an acknowledgment in the product"
             " documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such"
             " and must not be misrepresented as being the original software 3 this notice may not be removed or altered from"
             " any source distribution"),
)


def license_words(text: Column) -> Column:
    """Runs of digits, letters and characters above U+007F, with A-Z in lower case.

    ``lower`` also maps other letters; all of them are above U+007F before and count as word characters after, so words
    stay where they are, and templates are plain ASCII.
    """
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_places(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """``(gram, template, label, is_base, runs, t)``: a row for each run of three words of each template."""
    rows = []
    for n, (is_base, label, phrase) in enumerate(
        [(True, *b) for b in base] + [(False, *x) for x in notices]
    ):
        words = phrase.split()
        runs = len(words) - RUN + 1
        if runs < 1:
            raise ValueError(f"a template has at least {RUN} words: {phrase!r}")
        rows += [(" ".join(words[t : t + RUN]), n, label, is_base, runs, t) for t in range(runs)]
    return spark.createDataFrame(
        rows, "gram string, template int, label string, is_base boolean, runs int, t int"
    )


def scan_licenses(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """``(doc_id, n_words, spans)`` for each row of ``docs(doc_id, text)``; a null text is an empty one.

    ``spans`` is an array of ``(first_word, last_word, label, is_base, coverage)`` in order; words count from 0. Base
    phrases appear at every place where all their words stand consecutively, notices where at least 60 % of their runs
    do; of notices that overlap, those of the highest coverage. Rows with equal ids and texts get equal results. Other
    columns are not read.
    """
    key = ["doc_id", "_hash"]
    texts = docs.select("doc_id", text_of("text").alias("text"))
    words = texts.select("doc_id", F.xxhash64("text").alias("_hash"), license_words(F.col("text")).alias("_words"))
    n = F.size("_words")
    runs = F.when(
        n >= RUN,
        F.transform(
            F.sequence(F.lit(0), n - RUN),
            lambda i: F.concat_ws(" ", *[F.get("_words", i + j) for j in range(RUN)]),
        ),
    ).otherwise(F.array().cast("array<string>"))
    # The null element stands for the document itself, so that one pass over the texts is enough.
    grams = words.select(
        *key, n.alias("_n"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), runs)).alias("_p", "_gram")
    )
    # The templates are literals of this module, a few hundred rows.
    places = F.broadcast(template_places(docs.sparkSession, base, notices).withColumn("_t_hash", F.xxhash64("gram")))
    hits = grams.join(
        places, (F.xxhash64("_gram") == F.col("_t_hash")) & (F.col("_gram") == F.col("gram")), "left"
    ).where(F.col("_gram").isNull() | F.col("template").isNotNull())
    votes = hits.groupBy(
        *key, "template", "label", "is_base", "runs", (F.col("_p") - 1 - F.col("t")).alias("_diagonal")
    ).agg(
        F.count("*").alias("_votes"), F.collect_set("t").alias("_runs"), F.min("t").alias("_low"), F.max("t").alias("_high"),
        F.max("_n").alias("_n"),
    )
    per_doc = Window.partitionBy(*key)
    along = Window.partitionBy(*key, "template").orderBy("_diagonal")
    # Rows that repeat have voted together; their number is the number of null elements.
    votes = votes.withColumn("_rows", F.max(F.when(F.col("template").isNull(), F.col("_votes"))).over(per_doc))
    # Places of a base phrase stay apart: only notices merge, and only over less than their own length.
    gap = F.least(F.lit(GAP), F.col("runs") + (RUN - 2))
    apart = F.col("is_base") | F.coalesce(F.col("_diagonal") - F.lag("_diagonal").over(along) > gap, F.lit(True))
    votes = votes.withColumn("_new", apart.cast("int"))
    votes = votes.withColumn("_cluster", F.sum("_new").over(along))
    first, last = F.col("_diagonal") + F.col("_low"), F.col("_diagonal") + F.col("_high") + (RUN - 1)
    spans = votes.groupBy(*key, "template", "_cluster", "label", "is_base", "runs").agg(
        F.max("_rows").alias("_rows"), F.max("_n").alias("_n"), F.min(first).alias("first_word"),
        F.max(last).alias("last_word"), F.size(F.array_distinct(F.flatten(F.collect_list("_runs")))).alias("_found"),
    ).withColumn("_coverage", F.col("_found") / F.col("runs"))
    coverage = F.col("_coverage")
    length = F.col("last_word") - F.col("first_word") + 1
    good = F.when(F.col("is_base"), F.col("_found") == F.col("runs")).otherwise(
        (coverage >= SHARE) & (length <= (F.col("runs") + RUN - 1) * STRETCH)
    )
    # No span is longer than this, so what overlaps starts within it.
    reach = int(STRETCH * max((len(words.split()) for _, words in notices), default=0))
    around = Window.partitionBy(*key).orderBy("first_word").rangeBetween(-reach, reach)
    notice = F.struct("template", "first_word", "last_word", "_coverage")
    spans = spans.withColumn("_good", good).withColumn(
        "_around", F.collect_list(F.when(F.col("_good") & ~F.col("is_base"), notice)).over(around)
    )
    better = F.exists(
        "_around",
        lambda o: (o["template"] != F.col("template")) & (o["first_word"] <= F.col("last_word"))
        & (o["last_word"] >= F.col("first_word")) & (o["_coverage"] > F.col("_coverage")),
    )
    good = F.col("_good") & (F.col("is_base") | ~better)
    span = F.struct(
        F.col("first_word").cast("bigint").alias("first_word"), F.col("last_word").cast("bigint").alias("last_word"),
        "label", "is_base", coverage.alias("coverage"),
    )
    found = spans.groupBy(*key).agg(
        F.max("_rows").alias("_rows"), F.max("_n").cast("bigint").alias("n_words"),
        F.sort_array(F.collect_list(F.when(good, span))).alias("spans"),
    )
    return found.select("doc_id", "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("col")


def license_summary(scanned: DataFrame) -> DataFrame:
    """Counts, places, labels and a score, one row for each of :func:`scan_licenses`."""
    scanned = scanned.withColumn("_base", F.filter("spans", lambda s: s["is_base"]))
    starts = F.transform("_base", lambda s: s["first_word"])

    def labels(spans: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return scanned.select(
        "doc_id", "n_words", F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("_base").alias("base_labels"), labels("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
