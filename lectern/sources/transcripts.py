"""Readers and writers of transcripts and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import body, header_source, stem
from ..functions.regexes import strip
from ..operators.paragraphs import paragraphs

SEGMENT = "doc_id long, seg_no int, start double, end double, text string, avg_logprob double, no_speech_prob double"


def read_transcripts(spark: SparkSession, folder: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(path, stem, text, source, body) of whole text files. Bytes that are not UTF-8 are dropped, and with them,
    in such files only, characters that stand for unreadable ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))
    texts = files.select("path", F.regexp_replace(text, "\r\n?", "\n").alias("text"))
    return texts.select("path", stem(F.col("path")).alias("stem"), "text", header_source(F.col("text")).alias("source"), body(F.col("text")).alias("body"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_settings(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON settings; anything unreadable counts as empty."""
    return df.withColumn(column, F.from_json(F.coalesce(column, F.lit("{}")), schema, {"mode": "PERMISSIVE"}))


def domain_terms(df: DataFrame, line: str = "line", source: str = "source_rank", pos: str = "pos", most: int = 100) -> DataFrame:
    """(term): bullets stripped, comments and blanks dropped, each term at its first place, at most most."""
    term = strip(F.regexp_replace(strip(F.col(line)), r"^[-*•]+\s*", ""))
    rows = df.withColumn("term", term).filter((F.col("term") != "") & ~F.startswith(F.col("term"), F.lit("#")))
    first = rows.groupBy("term").agg(F.min(F.struct(source, pos)).alias("at"))
    return first.orderBy("at").limit(most).select("term", "at")


def normalise_results(df: DataFrame, column: str = "result") -> DataFrame:
    """Results as one shape: text, segments without empty ones, language; missing fields are empty."""
    r = F.col(column)
    segments = F.filter(F.coalesce(r["segments"], F.array()), lambda s: strip(F.coalesce(s["text"], F.lit(""))) != "")
    joined = F.array_join(F.transform(segments, lambda s: strip(s["text"])), " ")
    return df.withColumn(column, F.struct(F.coalesce(F.nullif(strip(r["text"]), F.lit("")), joined).alias("text"), segments.alias("segments"), r["language"].alias("language")))


def document_blocks(df: DataFrame, title: Column, subtitle: Column, text: str = "text", key: str = "doc_id", footer: Column | None = None) -> DataFrame:
    """(key, block_no, style, text): a document as a list of styled blocks, the sink of any writer."""
    head = [F.struct(F.lit("title").alias("style"), title.alias("text")), F.struct(F.lit("subtitle").alias("style"), subtitle.alias("text")),
            F.struct(F.lit("heading").alias("style"), F.lit("Transcript:").alias("text"))]
    inner = F.transform(paragraphs(F.col(text)), lambda p: F.struct(F.lit("justified").alias("style"), p.alias("text")))
    tail = F.array(F.struct(F.lit("footer").alias("style"), footer.alias("text"))) if footer is not None else F.expr("cast(array() as array<struct<style: string, text: string>>)")
    return df.select(key, F.posexplode(F.concat(F.array(*head), inner, tail)).alias("block_no", "b")).select(key, "block_no", "b.style", "b.text")


def write_blocks(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("overwrite").parquet(path)


def write_reports(df: DataFrame, path: str, report: str = "report") -> None:
    """One JSON object for each document."""
    df.select(F.to_json(report).alias("value")).write.mode("overwrite").text(path)


def append_rules(rules: DataFrame, path: str) -> None:
    rules.write.mode("append").parquet(path)
