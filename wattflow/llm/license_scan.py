"""Licence scan by diagonal voting, with DataFrame operations only.

Every rolling word k-gram of a text is joined by its hash to the positions of
the same k-gram in the licence templates (and compared word by word, so a hash
collision counts for nothing).  A hit at word p of the text and position q of a
template votes for the diagonal p - q; neighbouring diagonals are merged, which
bridges inserted or missing words, and the merged spans are verified against
the share of the template they cover.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattflow.llm.common import NON_WORD_PATTERN, ascii_lower, whole_text

K = 3
# Diagonals at most so far apart belong to one span.
MAX_SHIFT = 2
MIN_COVER = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    base: bool = False  # counts only where its words stand consecutively


# Fixed phrases and their labels.
BASE_TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
# Opening sentences of public licences, found as a whole or with small changes.
FUZZY_TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy"
                    " of this software and associated documentation files"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use"
                         " this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification"
                    " are permitted provided that the following conditions are met"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
)
TEMPLATES = BASE_TEMPLATES + FUZZY_TEMPLATES


def template_positions(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """One row per k-gram of every template; a small fixed table (its size is that of the parameter)."""
    rows = []
    for t, template in enumerate(templates):
        words = template.words.split()
        grams = len(words) - k + 1
        if not 0 < grams <= 63:
            raise ValueError(f"a template needs {k} to {62 + k} words: {template.words!r}")
        rows += [(t, template.label, template.base, grams, q, " ".join(words[q:q + k]))
                 for q in range(grams)]
    return spark.createDataFrame(
        rows, "template int, label string, base boolean, grams int, q int, template_gram string")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
         k: int = K, max_shift: int = MAX_SHIFT, min_cover: float = MIN_COVER) -> DataFrame:
    """One row per document: n_words, places of the base phrases, labels and a score.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the largest share of a template covered by one verified span; 1 for a
    base phrase, 0 for none).  A null text is empty and has no words; rows that
    share id and text are reported once each; a null id is kept; other columns
    are ignored; an empty table gives no rows.
    """
    positions = template_positions(docs.sparkSession, templates, k)
    key = ["doc_id", "text_hash", "n_chars"]
    words = F.filter(F.split(ascii_lower(F.col("t")), NON_WORD_PATTERN), lambda w: w != "")
    gram = F.transform("w", lambda x, i: F.struct(
        i.cast("int").alias("p"), F.when(
            i < F.size("w") - (k - 1),
            F.concat_ws(" ", x, *[F.get("w", i + j) for j in range(1, k)])).alias("gram")))
    # the first element stands for the document itself and carries its word count
    element = F.concat(F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("string").alias("gram"))),
                       gram)
    grams = (docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).alias("t"))
             .select("doc_id", F.xxhash64("t").alias("text_hash"), F.length("t").alias("n_chars"),
                     words.alias("w"))
             .select(*key, F.size("w").alias("n_words"), F.explode(element).alias("e"))
             .select(*key, "n_words", "e.p", "e.gram", F.xxhash64("e.gram").alias("hash")))
    hits = (grams.join(F.broadcast(positions.withColumn("hash", F.xxhash64("template_gram"))),
                       "hash", "left")
            .filter((F.col("p") < 0) | (F.col("gram") == F.col("template_gram")))
            .withColumn("diagonal", F.when(F.col("p") >= 0, F.col("p") - F.col("q"))))
    # sets of template positions as bit masks, so repeated rows vote once
    is_doc = F.col("p") < 0
    voted = (hits.groupBy(*key, "template", "diagonal").agg(
        F.bit_or(F.when(~is_doc, F.expr("shiftleft(1L, q)"))).alias("votes"),
        F.max("grams").alias("grams"), F.max("label").alias("label"), F.max("base").alias("base"),
        F.max("n_words").alias("n_words"), F.count(F.when(is_doc, 1)).alias("copies")))
    by_diagonal = Window.partitionBy(*key, "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > max_shift
    span = F.sum(F.coalesce(far.cast("int"), F.lit(0))).over(by_diagonal)
    exact = F.col("base") & (F.bit_count("votes") == F.col("grams"))
    spans = (voted.withColumn("span", span).groupBy(*key, "template", "span").agg(
        F.max("label").alias("label"), F.max("base").alias("base"),
        F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("diagonal"))).alias("first"),
        F.max(F.when(exact, F.col("diagonal"))).alias("last"),
        (F.bit_count(F.bit_or("votes")) / F.max("grams")).alias("cover"),
        F.max("n_words").alias("n_words"), F.sum("copies").alias("copies")))
    verified = F.when(F.col("base"), F.col("n_base") > 0).otherwise(F.col("cover") >= min_cover)
    documents = spans.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum("n_base").cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("n_base") > 0, F.col("label")))), ",")
        .alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(verified, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(verified, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.sum("copies").cast("int").alias("copies"))
    return documents.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
