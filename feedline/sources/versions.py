"""Numbered versions of a folder, committed one after another by several writers.

A version is a small file named by its number that says which data folder it stands
for.  Data is written first, to a folder of its own; the version is then created
without overwriting, which only one of several writers can do.  A writer that finds
its number taken reads the newer version and does its step again, so no update is
lost; one that dies before it commits leaves a data folder that no version names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

ATTEMPTS = 20
# Seconds a version without content may still be in the making.
PATIENCE = 5.0


def _at(spark: SparkSession, path: str):
    """The path and its file system, of whatever kind Spark can reach."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no folder."""
    folder, files = _at(spark, path)
    if not files.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(folder))


def modified(spark: SparkSession, path: str) -> float:
    """Seconds since 1970 of a file's last change."""
    file, files = _at(spark, path)
    return files.getFileStatus(file).getModificationTime() / 1000


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files in a folder; none where there is no folder."""
    folder, files = _at(spark, path)
    return files.getContentSummary(folder).getLength() if files.exists(folder) else 0


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds; nothing where there is none."""
    folder, files = _at(spark, path)
    files.delete(folder, True)


def new_folder(path: str, label: str = "data") -> str:
    """A folder name below ``path`` that no other writer has."""
    return f"{path.rstrip('/')}/{label}/{uuid.uuid4().hex}"


def _content(spark: SparkSession, path: str) -> dict | None:
    file, files = _at(spark, path)
    stream = files.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text else None


def _file(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/versions/{number:010d}"


def numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n) for n in children(spark, f"{path.rstrip('/')}/versions") if n.isdigit()]


def newest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and content of the newest version; 0 and None where there is none.

    One that stays without content was left by a writer that died in between; it
    counts for its number only.
    """
    known = numbers(spark, path)
    last = max(known, default=0)
    deadline = time.monotonic() + PATIENCE
    for number in sorted(known, reverse=True):
        content = _content(spark, _file(path, number))
        while content is None and number == last and time.monotonic() < deadline:
            time.sleep(0.1)
            content = _content(spark, _file(path, number))
        if content is not None:
            return last, content
    return last, None


def commit(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Create a version; False where another writer has that number."""
    file, files = _at(spark, _file(path, number))
    body = json.dumps(content).encode()
    if files.getScheme() == "file":
        # A local file system's create looks first and writes then; exclusive creation is the system's own.
        files.mkdirs(file.getParent())
        try:
            with open(files.makeQualified(file).toUri().getPath(), "xb") as local:
                local.write(body)
        except FileExistsError:
            return False
        return True
    try:
        stream = files.create(file, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName() or files.exists(file):
            return False
        raise
    try:
        stream.write(bytearray(body))
    finally:
        stream.close()
    return True


def update(spark: SparkSession, path: str, step: Callable[[dict | None], dict | None]) -> int:
    """Commit ``step(newest content)`` as the next version and return its number.

    The step writes its data and returns the new content, or None where there is
    nothing to do.  It is done again on the newer content where another writer
    committed meanwhile.
    """
    for _ in range(ATTEMPTS):
        number, content = newest(spark, path)
        new = step(content)
        if new is None:
            return number
        if commit(spark, path, number + 1, new):
            return number + 1
    raise RuntimeError(f"no version of {path} could be committed in {ATTEMPTS} attempts")


def covered_since(spark: SparkSession, path: str, grace: float) -> dict | None:
    """Content of the newest version that is at least ``grace`` seconds old."""
    for number in sorted(numbers(spark, path), reverse=True):
        content = _content(spark, _file(path, number))
        if content is not None and time.time() - modified(spark, _file(path, number)) >= grace:
            return content
    return None


def since(spark: SparkSession, path: str, grace: float) -> list[dict]:
    """Contents a reader may still use: the versions of the last ``grace`` seconds and the one before them."""
    found = []
    for number in sorted(numbers(spark, path), reverse=True):
        content = _content(spark, _file(path, number))
        if content is not None:
            found.append(content)
            if time.time() - modified(spark, _file(path, number)) >= grace:
                break
    return found
