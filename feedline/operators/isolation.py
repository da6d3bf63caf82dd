"""Several sources side by side, each as a job of its own.

What fails in one source, when its plan is made or while it runs, ends that source
only: it stores no rows and its outcome says why.  The others are complete.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedline.sources import versions

OUTCOME = "source STRING, state STRING, n_rows BIGINT, reason STRING"
COMPLETE, FAILED = "complete", "failed"
# Sources whose jobs run at the same time.
AT_ONCE = 8


def _folder(path: str, batch_id: str, source: str) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}/source={source}"


def _reason(error: Exception) -> str:
    """The error's condition where Spark names one, else its kind, and the first line of its message."""
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    lines = str(error).strip().splitlines()
    return f"{condition or type(error).__name__}: {lines[0] if lines else ''}"


def run_sources(
    spark: SparkSession,
    jobs: dict[str, Callable[[], DataFrame]],
    path: str,
    batch_id: str,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """Store every source's rows and return one outcome per source: ``source, state, n_rows, reason``.

    A job is a function that returns the source's rows; it is called in the source's
    own thread, so that an error there is the source's own as well.  Each source goes
    to ``batch_id=…/source=…`` below ``path``; a failed one leaves nothing there, also
    not what an earlier run of the batch had stored.  The outcomes are stored beside
    them, last, and are what :func:`stored_rows` goes by.
    """

    def run(source: str) -> tuple[str, str, int, str | None]:
        target = _folder(path, batch_id, source)
        try:
            counted = Observation()
            rows = jobs[source]().observe(counted, F.count(F.lit(1)).alias("n"))
            rows.write.mode("overwrite").parquet(target)
            return source, COMPLETE, counted.get["n"], None
        except Exception as error:  # noqa: BLE001 - whatever it is, it is this source's
            versions.remove(spark, target)
            return source, FAILED, 0, _reason(error)

    with ThreadPoolExecutor(max(1, min(at_once, len(jobs)))) as side_by_side:
        found = list(side_by_side.map(inheritable_thread_target(spark)(run), jobs))
    outcomes = spark.createDataFrame(found, OUTCOME)
    target = f"{path.rstrip('/')}/outcomes/batch_id={batch_id}"
    outcomes.coalesce(1).write.mode("overwrite").parquet(target)
    return spark.read.schema(OUTCOME).parquet(target)


def stored_rows(spark: SparkSession, path: str, batch_id: str) -> DataFrame | None:
    """The rows of a batch's complete sources with their ``source``; None where none is complete."""
    outcomes = spark.read.schema(OUTCOME).parquet(f"{path.rstrip('/')}/outcomes/batch_id={batch_id}")
    # One row for each source.
    complete = [r["source"] for r in outcomes.where(F.col("state") == COMPLETE).collect()]
    union: DataFrame | None = None
    for source in sorted(complete):
        rows = spark.read.parquet(_folder(path, batch_id, source)).withColumn("source", F.lit(source))
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    return union
