"""License scans by diagonal voting.

Templates are the base phrases, phrases of the method's own, and whole wordings of
licenses (:mod:`feedline.llm.license_texts`).  Every rolling k-gram of words is
hashed and joined to the template positions that have it: pairs for phrases, runs of
four words for wordings.  A hit at document word ``i`` and template word ``j`` votes
for the diagonal ``i - j``, and its words are compared.  Votes are the distinct
template positions of a diagonal, however long the template is.

A diagonal with all votes of its template is an exact span.  Other diagonals are
merged along chains of neighbours up to a slack apart, which are one span with words
put in, left out or changed; the merged span is verified by the share of template
positions it holds and by its length.  A phrase's slack is two words, a wording's an
eighth of it; single votes for a wording are chance and do not merge.

Base phrases are found exactly or not at all.  The template table is a constant of
its modules, far below any broadcast limit.  Hits are reduced to one row for each
diagonal before the shuffle, and one pass gives exact and merged spans.

Null and empty texts have no words.  Rows equal in id and text get the same
result (their votes are the same positions); rows that share only an id do not mix.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedline.llm.common import keyed, same_document
from feedline.llm.license_texts import BODIES

# Phrases that count as base places, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Phrases of the method's own.
OWN = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "licensed under the apache license version 2 0": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}
# Words of a seed; share of a template that a merged span must hold; words it may be longer.
PHRASE, WORDING = 2, 4
COVERAGE = {PHRASE: 0.7, WORDING: 0.5}
SLACK = 2

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in which only A-Z are lower-cased."""
    return F.filter(F.split(F.translate(text, _LETTERS, _LETTERS.lower()), _BETWEEN), lambda w: w != "")


def template_words(text: str) -> list[str]:
    """Words of a template, by the rule for documents."""
    lower = text.translate(str.maketrans(_LETTERS, _LETTERS.lower()))
    return [w for w in re.split(_BETWEEN, lower) if w]


def templates(spark) -> DataFrame:
    """One row for each k-gram of each template."""
    held = [(phrase, label, True, PHRASE) for phrase, label in BASE.items()]
    held += [(phrase, label, False, PHRASE) for phrase, label in OWN.items()]
    held += [(body, label, False, WORDING) for label, body in BODIES.items()]
    rows = []
    for text, label, base, k in held:
        words = template_words(text)
        slack = SLACK if k == PHRASE else len(words) // 8
        name = text if k == PHRASE else f"{label}: {' '.join(words[:6])}"
        rows += [(name, label, base, k, len(words), slack, j, words[j : j + k]) for j in range(len(words) - k + 1)]
    shape = "template string, label string, base boolean, k int, n_template int, slack int, j int, gram array<string>"
    table = spark.createDataFrame(rows, shape)
    return table.withColumn("seed", F.xxhash64(F.array_join("gram", " ")))


def license_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text_key``, ``label``, ``template``, ``base``, ``exact``, ``begin``, ``end`` (words) and ``score`` of each span."""
    rows = keyed(docs, doc_id=doc_id, text=text)
    worded = rows.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    at = worded.filter(F.size("words") >= PHRASE).select(
        "doc_id", "text_key", "words", F.explode(F.sequence(F.lit(0), F.size("words") - PHRASE)).alias("i")
    )
    words = [F.get("words", F.col("i") + n) for n in range(WORDING)]
    grams = at.select("doc_id", "text_key", "i", *[w.alias(f"d{n}") for n, w in enumerate(words)])
    pair = F.xxhash64(F.concat_ws(" ", "d0", "d1"))
    run = F.when(F.col("d3").isNotNull(), F.xxhash64(F.concat_ws(" ", "d0", "d1", "d2", "d3")))
    seeds = grams.select("*", F.explode(F.array(pair, run)).alias("seed")).filter("seed IS NOT NULL")
    hits = seeds.join(F.broadcast(templates(docs.sparkSession)), "seed")
    same = (F.col("d0") == F.col("gram")[0]) & (F.col("d1") == F.col("gram")[1])
    rest = (F.col("d2") == F.get("gram", F.lit(2))) & (F.col("d3") == F.get("gram", F.lit(3)))
    hits = hits.filter(same & ((F.col("k") == PHRASE) | rest))
    diagonals = hits.groupBy(
        "doc_id", "text_key", "template", "label", "base", "k", "n_template", "slack", (F.col("i") - F.col("j")).alias("diagonal")
    ).agg(F.collect_set("j").alias("votes"))
    seeds_of = F.col("n_template") - F.col("k") + 1
    diagonals = diagonals.withColumn("exact", F.size("votes") == seeds_of)
    # A base phrase is found exactly or not at all; one vote for a wording is chance.
    of_use = F.col("exact") | (~F.col("base") & ((F.col("k") == PHRASE) | (F.size("votes") > 1)))
    one = Window.partitionBy("doc_id", "text_key", "template", "exact").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(one) > F.col("slack"))
    chained = diagonals.filter(of_use).withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int"))
    chained = chained.withColumn("chain", F.sum("apart").over(one))
    spans = chained.groupBy(
        "doc_id", "text_key", "template", "label", "base", "k", "n_template", "slack", "exact", "chain"
    ).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("held"),
        F.min(F.col("diagonal") + F.array_min("votes")).alias("begin"),
        F.max(F.col("diagonal") + F.array_max("votes") + F.col("k")).alias("end"),
    )
    spans = spans.withColumn("score", F.col("held") / seeds_of)
    least = F.when(F.col("k") == PHRASE, COVERAGE[PHRASE]).otherwise(COVERAGE[WORDING])
    verified = (F.col("score") >= least) & (F.col("end") - F.col("begin") <= F.col("n_template") + F.col("slack"))
    out = ["doc_id", "text_key", "label", "template", "base", "exact", "begin", "end", "score"]
    return spans.filter(F.col("exact") | verified).select(*out)


def license_scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: words, base places, and labels; the label texts are empty where nothing is found."""
    spans = license_spans(docs, doc_id=doc_id, text=text)
    found = spans.groupBy("doc_id", "text_key").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("begin"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("begin"))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("score").alias("score"),
    )
    rows = keyed(docs, doc_id=doc_id, text=text)
    rows = rows.select("doc_id", "text_key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(found, same_document(rows, found), "left").select(
        rows["doc_id"],
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce(F.array_join(F.array_sort("base_labels"), ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort("labels"), ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
