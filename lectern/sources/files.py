"""File listings and batch selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import extension, stem

# The media types that a batch takes.
MEDIA = (".mp3", ".wav", ".flac", ".m4a", ".aac", ".ogg", ".wma", ".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm")


def listing(spark: SparkSession, folder: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """(path, mtime, size, ext) of the files of a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size")).withColumn("ext", extension(F.col("path")))


def in_order(files: DataFrame) -> DataFrame:
    """A batch in the order of its paths."""
    return files.orderBy("path")


def media(files: DataFrame, kinds: tuple[str, ...] = MEDIA) -> DataFrame:
    return files.filter(F.col("ext").isin(*kinds))


def to_process(inputs: DataFrame, outputs: DataFrame, mode: str = "skip", cutoff: str | Column | None = None, key: str = "stem") -> DataFrame:
    """Inputs without an output; all of them for mode "all"; for "before" also those whose output is
    older than the cutoff date. A cutoff that is no date keeps everything."""
    if mode == "all":
        return inputs
    done = outputs.groupBy(key).agg(F.max("mtime").alias("_done"))
    if mode != "before":
        return inputs.join(done, key, "left_anti")
    limit = F.try_to_timestamp(F.lit(cutoff) if isinstance(cutoff, str) or cutoff is None else cutoff)
    joined = inputs.join(done, key, "left")
    return joined.filter(F.col("_done").isNull() | limit.isNull() | (F.col("_done").cast("timestamp") < limit)).drop("_done")


def with_stem(files: DataFrame) -> DataFrame:
    return files.withColumn("stem", stem(F.col("path")))


def by_extension(files: DataFrame) -> DataFrame:
    """Files and bytes by extension."""
    return files.groupBy("ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def batch_summary(results: DataFrame, status: str = "status") -> DataFrame:
    return results.agg(*(F.count_if(F.col(status) == s).alias(s) for s in ("ok", "failed", "skipped")))
