"""Enrichment of short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedline.functions.text import strip

# The default sentiment word lists.
POSITIVE = ("good", "great", "love", "happy", "best", "beautiful", "hope", "joy", "wonderful", "true")
NEGATIVE = ("bad", "worst", "hate", "sad", "evil", "fear", "pain", "wrong", "lost", "false")


# A run without white space, and the part of it from its first to its last
# letter or digit.
_WORD = r"(?U)\S+"
_TOKEN = r"(?U)[\p{L}\p{N}](?:\S*[\p{L}\p{N}])?"


def words(text: Column) -> Column:
    """White-space separated words, punctuation kept."""
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased words without surrounding punctuation."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD)).cast("bigint")


def longest_word(text: Column) -> Column:
    """The longest word; the first of several equally long ones."""
    listed = words(text)
    ranked = F.transform(listed, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("at"), w.alias("w")))
    return F.array_max(ranked)["w"]


def sentiment_score(
    text: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE
) -> Column:
    """Positive minus negative lexicon hits."""
    hits = F.filter(tokens(text), lambda t: t.isin(*positive, *negative))
    scored = F.aggregate(hits, F.lit(0), lambda n, t: n + F.when(t.isin(*positive), 1).otherwise(-1))
    return scored.cast("bigint")


def text_hash(text: Column) -> Column:
    """SHA-256 of the trimmed text, the natural key of a text row."""
    return F.sha2(strip(text), 256)


def enriched(text: Column) -> list[Column]:
    """The derived columns of a text row."""
    return [
        word_count(text).alias("word_count"),
        longest_word(text).alias("longest_word"),
        sentiment_score(text).alias("sentiment_score"),
        text_hash(text).alias("quote_hash"),
    ]
