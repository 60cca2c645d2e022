"""Small text records in a folder of any file system that Spark can reach, each published by one rename.

Record n of a folder is the file ``<n>.json`` of twelve digits. A reader takes the newest one; it never sees a record half
written, and the one before stays until ``forget``. Writers of one folder take turns: the second of two writers of the same
number fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listing(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    _, at, fs = _files(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    _, at, fs = _files(spark, path)
    fs.delete(at, True)


def numbers(spark: SparkSession, folder: str) -> list[int]:
    return [int(n[:-5]) for n in listing(spark, folder) if n.endswith(".json") and n[:-5].isdigit()]


def publish(spark: SparkSession, folder: str, number: int, text: str) -> None:
    """Write record ``number``; it must not be there."""
    jvm, at, fs = _files(spark, f"{folder}/{number:012d}.json")
    if fs.exists(at):
        raise FileExistsError(f"{at} is there already: two writers at once")
    near = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{uuid.uuid4().hex}")
    stream = fs.create(near, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(near, at):
        fs.delete(near, False)
        raise FileExistsError(f"{at} was written meanwhile: two writers at once")


def record(spark: SparkSession, folder: str, number: int) -> str:
    jvm, at, fs = _files(spark, f"{folder}/{number:012d}.json")
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def newest(spark: SparkSession, folder: str) -> tuple[int, str]:
    """Number and text of the newest record."""
    found = numbers(spark, folder)
    if not found:
        raise FileNotFoundError(f"no record in {folder}")
    return max(found), record(spark, folder, max(found))


def forget(spark: SparkSession, folder: str, below: int) -> None:
    """Remove the records before number ``below``."""
    for n in numbers(spark, folder):
        if n < below:
            remove(spark, f"{folder}/{n:012d}.json")
