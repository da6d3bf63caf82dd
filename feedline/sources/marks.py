"""High-water marks: one row per source, ``source, mark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedline.functions.text import strip
from feedline.sources import versions

MARK_SCHEMA = "source STRING, mark STRING"


def clean_marks(marks: DataFrame) -> DataFrame:
    """Trimmed marks, blank ones null."""
    return marks.select("source", F.nullif(strip(F.col("mark")), F.lit("")).alias("mark"))


def _stored(spark: SparkSession, content: dict | None) -> DataFrame:
    """The marks of a version; none where there is none."""
    if content is None:
        return spark.createDataFrame([], MARK_SCHEMA)
    return spark.read.schema(MARK_SCHEMA).parquet(content["folder"])


def load_checkpoint(spark: SparkSession, path: str, sources: DataFrame | None = None) -> DataFrame:
    """Marks of the newest complete version; a missing store has none.

    With ``sources`` (a ``source`` column) every source gets a row, with a
    null mark where none is stored.
    """
    marks = clean_marks(_stored(spark, versions.newest(spark, path)[1]))
    return marks if sources is None else marks_for(sources, marks)


def marks_for(sources: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per source with its mark, null where none is stored."""
    return sources.select("source").distinct().join(clean_marks(marks), "source", "left")


def advance_checkpoint(old: DataFrame, new: DataFrame) -> DataFrame:
    """New marks over old ones; a null or empty new mark changes nothing."""
    fresh = new.select("source", F.nullif(F.col("mark"), F.lit("")).alias("_new"))
    return old.join(fresh, "source", "full_outer").select(
        "source", F.coalesce("_new", "mark").alias("mark")
    )


def _written(marks: DataFrame, path: str) -> dict:
    folder = versions.new_folder(path, "marks")
    marks.select("source", "mark").write.parquet(folder)
    return {"folder": folder}


def save_checkpoint(marks: DataFrame, path: str) -> int:
    """Write the marks as the next version, whatever the one before holds, and return its number.

    The version read before stays untouched, so a failed write loses nothing.
    """
    content = _written(marks, path)
    return versions.update(marks.sparkSession, path, lambda _: content)


def commit_checkpoint(new: DataFrame, path: str) -> int:
    """:func:`advance_checkpoint` over the newest stored version, as the next one; returns its number.

    Where another cycle stored its marks in between, the step is done again over
    those, so cycles that ran side by side keep all their marks.
    """
    spark = new.sparkSession

    def step(content: dict | None) -> dict:
        return _written(advance_checkpoint(clean_marks(_stored(spark, content)), new), path)

    return versions.update(spark, path, step)
