"""Looking into folders by Spark's own file systems, so that any path that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _located(spark, path)
    return system.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no such folder."""
    system, place = _located(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file from the driver."""
    system, place = _located(spark, path)
    out = system.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file whole."""
    system, place = _located(spark, path)
    opened = system.open(place)
    try:
        return bytes(opened.readAllBytes()).decode()
    finally:
        opened.close()


def rename(spark: SparkSession, path: str, to: str) -> None:
    system, place = _located(spark, path)
    if not system.rename(place, _located(spark, to)[1]):
        raise OSError(f"{path} could not be renamed to {to}")


def remove(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all that it holds."""
    system, place = _located(spark, path)
    system.delete(place, True)
