"""Exact histogram of encoded lengths, and what follows from its suffix sums.

One row for each encoded length that occurs.  From the suffix sums of such a
table every context limit has an exact answer: how many documents reach it, how
many tokens remain if longer documents are cut there, and any quantile.

Null texts count as empty: length 0.  An empty table gives an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedline.llm.bpe import lengths

# Lengths of one block; sums run within blocks in parallel, then over block totals.
BLOCK = 1024


def length_histogram(docs: DataFrame, *, text: str = "text", vocab: str | None = None) -> DataFrame:
    """``n_tokens``, ``n_docs``: partial counts before the shuffle, so no length is hot."""
    return lengths(docs, text=text, vocab=vocab).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The histogram with sums over all documents of at least that length.

    ``docs_from`` and ``tokens_from``: documents and tokens of this length or
    more; ``kept_tokens``: what remains when every document is cut at this
    length; ``docs_share``: the share of documents of at most this length.
    Only block totals, one row for ``block`` lengths, meet in one task.
    """
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / block))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum(tokens).alias("block_tokens"))
    after = Window.partitionBy().orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(every).alias("all_docs"),
        F.sum("block_tokens").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select(
        "block",
        "n_tokens",
        "n_docs",
        F.sum("n_docs").over(inside).alias("docs_in"),
        F.sum(tokens).over(inside).alias("tokens_in"),
    ).join(blocks, "block")
    docs_from, tokens_from = F.col("docs_in") + F.col("later_docs"), F.col("tokens_in") + F.col("later_tokens")
    return sums.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + F.col("n_tokens") * docs_from).alias("kept_tokens"),
        ((F.col("all_docs") - docs_from + F.col("n_docs")) / F.col("all_docs")).alias("docs_share"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``context``, ``docs_over``, ``kept_tokens``, ``lost_tokens`` for each context limit.

    The first length above a limit holds the sums of all longer documents.
    """
    first = [
        F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("n_tokens") > n, F.col("n_tokens"))).alias(f"at{i}")
        for i, n in enumerate(limits)
    ]
    row = sums.agg(F.coalesce(F.max("tokens_from"), F.lit(0)).alias("total"), *first)
    answers = []
    for i, n in enumerate(limits):
        over = F.coalesce(F.col(f"at{i}.docs_from"), F.lit(0))
        lost = F.coalesce(F.col(f"at{i}.tokens_from"), F.lit(0)) - over * n
        answers.append(
            F.struct(
                F.lit(n).cast("long").alias("context"),
                over.alias("docs_over"),
                (F.col("total") - lost).alias("kept_tokens"),
                lost.alias("lost_tokens"),
            )
        )
    return row.select(F.inline(F.array(*answers)))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share``, ``n_tokens``: the smallest length that at least this share of the documents does not pass."""
    columns = [F.min(F.when(F.col("docs_share") >= F.lit(s), F.col("n_tokens"))).alias(str(i)) for i, s in enumerate(shares)]
    row = sums.agg(*columns)
    pairs = [F.struct(F.lit(float(s)).alias("share"), F.col(str(i)).alias("n_tokens")) for i, s in enumerate(shares)]
    return row.select(F.inline(F.array(*pairs)))
