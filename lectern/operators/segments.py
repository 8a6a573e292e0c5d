"""Timed segments: edges, merging, windows, filters, order.

All operators take the columns that name a group, so that a group is a unit of order and of shuffle.
Groups are recordings or users; their segments are ordered by windows over that key. Where a plain
aggregate does (merging into bounds, concatenation), the window's partitioning is used again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_suspicious, is_topic_shift


def merge_intervals(df: DataFrame, group: list[str], gap: float, start: str = "start", end: str = "end") -> DataFrame:
    """(group, start, end, n): a segment joins the ones before if it starts at most gap after the latest end."""
    order = Window.partitionBy(*group).orderBy(start, end)
    latest = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(latest.isNull() | (F.col(start) - latest > gap), 1).otherwise(0))
    numbered = flagged.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def min_duration(df: DataFrame, least: float, start: str = "start", end: str = "end") -> DataFrame:
    return df.filter(F.col(end) - F.col(start) >= least)


def longest(df: DataFrame, group: list[str], k: int, start: str = "start", end: str = "end") -> DataFrame:
    """The k longest segments of each group, ties to the earlier one."""
    order = Window.partitionBy(*group).orderBy((F.col(end) - F.col(start)).desc(), F.col(start), F.col(end))
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def lecture_segments(df: DataFrame, group: list[str], least: float = 0.1, gap: float = 1.0, most: int = 500) -> DataFrame:
    return longest(min_duration(merge_intervals(df, group, gap), least), group, most)


def standard_segments(df: DataFrame, group: list[str], least: float = 0.5, gap: float = 0.3, most: int = 1000, overflow: str = "longest_k") -> DataFrame:
    """Merge, drop short ones, and where more than most remain keep the longest, or (overflow
    "pair_shortest") keep the longest half and pair the rest by rising duration if near in time."""
    merged = min_duration(merge_intervals(df, group, gap), least)
    if overflow == "longest_k":
        return longest(merged, group, most)
    by = Window.partitionBy(*group)
    length = F.col("end") - F.col("start")
    ranked = merged.withColumn("_n", F.count("*").over(by)).withColumn("_r", F.row_number().over(by.orderBy(length, "start", "end")))
    kept = F.least(F.lit(most), F.floor(F.col("_n") / 2))
    ranked = ranked.withColumn("_short", (F.col("_n") > most) & (F.col("_r") <= F.col("_n") - kept))
    rest, short = ranked.filter("not _short").select(*group, "start", "end"), ranked.filter("_short")
    # Greedy pairing along the ranks: in a run of near neighbours the first joins the second, the third the fourth, ...
    chain = Window.partitionBy(*group).orderBy("_r")
    near = F.coalesce(F.col("start") - F.lag("end").over(chain) <= 2 * gap, F.lit(False))
    runs = short.withColumn("_run", F.sum(F.when(near, 0).otherwise(1)).over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    paired = runs.withColumn("_pair", F.floor((F.row_number().over(Window.partitionBy(*group, "_run").orderBy("_r")) - 1) / 2))
    joined = paired.groupBy(*group, "_run", "_pair").agg(F.min_by("start", "_r").alias("start"), F.max("end").alias("end"))
    return rest.unionByName(joined.select(*group, "start", "end"))


def speech_edges(df: DataFrame, group: list[str], frame: str, is_speech: str, frame_ms: int = 30, padding_ms: int = 300) -> DataFrame:
    """(group, start, end) of each run of speech frames, padded on both sides, not before zero. A run ends
    at the next frame's time; one that reaches the end closes there."""
    order = Window.partitionBy(*group).orderBy(frame)
    before = F.coalesce(F.lag(is_speech).over(order), F.lit(False))
    runs = df.withColumn("_run", F.sum(F.when(F.col(is_speech) & ~before, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(is_speech)
    bounds = runs.groupBy(*group, "_run").agg(F.min(frame).alias("first"), F.max(frame).alias("last"))
    begin, close = F.col("first") * frame_ms / F.lit(1000.0), (F.col("last") + 1) * frame_ms / F.lit(1000.0)
    pad = padding_ms / 1000.0
    return bounds.select(*group, F.greatest(F.lit(0.0), begin - pad).alias("start"), (close + pad).alias("end"))


def tumbling(df: DataFrame, duration: str, length: int = 30, keep_rest: bool = False) -> DataFrame:
    """df with start, end of windows over [0, duration). Whole seconds count: a rest below one second
    after the last window is lost unless keep_rest."""
    last = F.ceil(F.col(duration)) if keep_rest else F.floor(F.col(duration))
    starts = F.when(last > 0, F.sequence(F.lit(0).cast("long"), last.cast("long") - 1, F.lit(length).cast("long")))
    return df.withColumn("start", F.explode(starts)).withColumn("start", F.col("start").cast("double")).withColumn("end", F.least(F.col("start") + length, F.col(duration).cast("double")))


def sliding(df: DataFrame, duration: str, length: int = 30, overlap: int = 5) -> DataFrame:
    """df with segment_id, start, end of windows that begin every length - overlap seconds."""
    step = length - overlap
    starts = F.when(F.col(duration) > 0, F.sequence(F.lit(0).cast("long"), (F.ceil(F.col(duration)) - 1).cast("long"), F.lit(step).cast("long")))
    out = df.select("*", F.posexplode(starts).alias("segment_id", "start")).withColumn("start", F.col("start").cast("double"))
    return out.withColumn("end", F.least(F.col("start") + length, F.col(duration).cast("double")))


def order_faults(df: DataFrame, group: list[str], tolerance: float, start: str = "start", end: str = "end", tie: str | None = None) -> DataFrame:
    """Segments that start more than tolerance before the one before them ends."""
    order = Window.partitionBy(*group).orderBy(start, end, *([tie] if tie else []))
    return df.withColumn("previous_end", F.lag(end).over(order)).filter(F.col(start) < F.col("previous_end") - tolerance)


def confident(df: DataFrame, text: str = "text") -> DataFrame:
    """Without empty texts and without suspicious ones of very low confidence; missing figures are 0."""
    low = (F.coalesce("avg_logprob", F.lit(0.0)) < -1.5) & (F.coalesce("no_speech_prob", F.lit(0.0)) > 0.9)
    return df.filter((F.trim(F.coalesce(text, F.lit(""))) != "") & ~(is_suspicious(F.col(text)) & low))


def shift(df: DataFrame, chunks: DataFrame, key: str = "segment_id") -> DataFrame:
    """Local times plus the start of their chunk."""
    return df.join(chunks.select(key, F.col("start_time").alias("_at")), key).withColumn("start", F.col("start") + F.col("_at")).withColumn("end", F.col("end") + F.col("_at")).drop("_at")


def joined_text(df: DataFrame, group: list[str], order: list[str], text: str = "text", joint: str = " ") -> DataFrame:
    """(group, text): non-empty texts in order."""
    rows = F.array_sort(F.collect_list(F.when(F.trim(F.col(text)) != "", F.struct(*order, F.trim(F.col(text)).alias("_t")))))
    return df.groupBy(*group).agg(F.array_join(F.transform(rows, lambda r: r["_t"]), joint).alias("text"))


def first_known(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*group).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def coverage(df: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(group, covered, n): from the first start to the last end."""
    return df.groupBy(*group).agg((F.max(end) - F.min(start)).alias("covered"), F.count("*").alias("n"))


def is_incomplete(covered: Column, duration: Column, share: float = 0.8) -> Column:
    return covered < share * duration


def per_minute(n: Column, duration: Column) -> Column:
    return n / F.greatest(duration / 60, F.lit(1.0))


def merge_by_flags(df: DataFrame, group: list[str], order: str, flag: str, text: str = "text") -> DataFrame:
    """(group, sentence_no, text): texts up to each flagged one are one sentence, closed by a period."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = df.withColumn("sentence_no", F.coalesce(F.sum(F.col(flag).cast("int")).over(before), F.lit(0)))
    rows = F.array_sort(F.collect_list(F.struct(order, F.trim(F.col(text)).alias("_t"))))
    out = numbered.groupBy(*group, "sentence_no").agg(F.array_join(F.transform(rows, lambda r: r["_t"]), " ").alias("text"))
    return out.withColumn("text", F.when(F.col("text").rlike(r"[.!?]$"), F.col("text")).otherwise(F.concat("text", F.lit("."))))


def pitch_boundary(before: Column, after: Column, fallback: Column, drop: float = 0.15) -> Column:
    """Whether the pitch falls by more than drop; by the words where a pitch is unknown."""
    fall = F.when(before > 0, (before - after) / before).otherwise(0.0)
    return F.when(before.isNull() | after.isNull(), fallback).otherwise(fall > drop)


def pitch_frame(time: Column, rate: int = 22050, hop: int = 512) -> Column:
    return F.floor(time * rate / hop).cast("int")


def gap_breaks(df: DataFrame, group: list[str], gap: float, start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """df with para_no: a paragraph begins after a gap, or with a topic starter, or with a capital after
    a closing mark. These rules look at neighbours only; the rule on length is in paragraphs.py."""
    order = Window.partitionBy(*group).orderBy(start, end)
    t, last = F.trim(F.col(text)), F.trim(F.lag(text).over(order))
    begins = (F.col(start) - F.lag(end).over(order) >= gap) | is_topic_shift(t) | (last.rlike(r"[.!?]$") & t.rlike(r"^\p{Lu}"))
    flagged = df.withColumn("_b", F.coalesce(begins, F.lit(False)) & last.isNotNull())
    return flagged.withColumn("para_no", F.sum(F.col("_b").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")
