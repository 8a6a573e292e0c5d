"""Whole cleaning pipelines: compositions of text steps, each a projection over documents.

A step maps a DataFrame with a text column to one; none shuffles, so a pipeline is a single stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spelling
from ..functions import text as T
from ..functions.regexes import strip
from ..operators import paragraphs as P
from ..operators import sentences as S

Step = Callable[[Column], Column]


@dataclass
class Settings:
    """Everything that changes results, as explicit arguments."""

    max_repeats: int = 10
    word_runs: int = 2
    sentence_runs: int = 3
    sentence_cap: int = 4
    loop_window: int = 12
    loop_ratio: float = 0.5
    max_sentence_chars: int = 170
    keep_paragraphs: bool = False
    verbatim: bool = False
    statistics: bool = False
    rules: list[tuple[str, str]] = field(default_factory=list)


def apply(df: DataFrame, steps: list[Step], text: str = "text") -> DataFrame:
    return reduce(lambda d, step: d.withColumn(text, step(F.col(text))), steps, df)


def _cap(df: DataFrame, text: str, cap: int) -> DataFrame:
    capped = S.cap_sentences(df.withColumnRenamed(text, "_t"), "_t", cap)
    return capped.withColumnRenamed("n_dropped", "dropped_sentences").withColumn(text, F.col("capped")).drop("_t", "capped", "n_sentences", "n_unique")


def _loops(df: DataFrame, text: str, s: Settings) -> DataFrame:
    broken = df.withColumn("_l", S.break_loops(F.col(text), s.loop_window, s.loop_ratio))
    return broken.withColumn(text, F.col("_l.text")).withColumn("loop_events", F.col("_l.loop_events")).drop("_l")


def _counted(df: DataFrame, steps: list[Step], s: Settings, text: str, name: str) -> DataFrame:
    """The steps applied; if asked for, with a column of what the removal of artifacts is about to find."""
    for step in steps:
        if s.statistics and step is T.remove_artifacts:
            df = df.withColumn(name, T.artifact_counts(F.col(text)))
        df = df.withColumn(text, step(F.col(text)))
    return df


def _clean(df: DataFrame, before: list[Step], after: list[Step], s: Settings, text: str) -> DataFrame:
    df = _counted(df, before, s, text, "early_artifacts")
    return _counted(_loops(_cap(df, text, s.sentence_cap), text, s), after, s, text, "late_artifacts")


def postprocess(df: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """Repetition, artifacts, spacing, case, sentence caps, loops. Adds dropped_sentences, loop_events;
    with s.statistics also early_artifacts and late_artifacts, maps from patterns to counts."""
    if s.verbatim:
        return df.withColumn("dropped_sentences", F.lit(0)).withColumn("loop_events", F.lit(0))
    return _clean(df, [
        lambda t: S.collapse_repetitions(t, s.max_repeats), lambda t: T.remove_prompt_artifacts(t, s.keep_paragraphs), T.remove_artifacts, T.fix_spacing,
        P.refine_case, lambda t: S.cap_consecutive(t, s.sentence_runs),
    ], [T.remove_artifacts], s, text)


def clean_full(df: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """As postprocess, with word runs, long sentences and missing boundaries; then paragraphs."""
    if s.verbatim:
        return df.withColumn("dropped_sentences", F.lit(0)).withColumn("loop_events", F.lit(0)).withColumn("paragraphs", P.rich_paragraphs(F.col(text)))
    out = _clean(df, [
        lambda t: S.collapse_repetitions(t, s.max_repeats), lambda t: T.remove_prompt_artifacts(t, s.keep_paragraphs), T.remove_artifacts,
        lambda t: S.collapse_word_runs(t, s.word_runs), lambda t: P.split_long_sentences(t, s.max_sentence_chars), T.fix_spacing, P.refine_case,
        lambda t: S.cap_consecutive(t, s.sentence_runs),
    ], [T.remove_artifacts, T.fix_missing_boundaries], s, text)
    return out.withColumn("paragraphs", P.rich_paragraphs(F.col(text)))


def live(segments: DataFrame, group: list[str]) -> DataFrame:
    """Segments to normalised paragraphs: (group, text, paragraphs)."""
    from ..operators.segments import confident

    cleaned = confident(segments.withColumn("text", S.collapse_phrases(F.col("text"))))
    texts = P.segment_paragraphs(cleaned, group)
    return apply(texts, [T.remove_prompt_artifacts, T.remove_hallucinations]).withColumn(
        "paragraphs", F.transform(P.rich_paragraphs(F.col("text")), lambda p: spelling.convert_spelling(T.format_numbers(p)))
    )


def legacy(df: DataFrame, text: str = "text", words=T.FILLERS) -> DataFrame:
    return df.withColumn(text, T.remove_words(F.col(text), words)).withColumn("paragraphs", P.rich_paragraphs(F.col(text)))


def lecture(df: DataFrame, text: str = "text") -> DataFrame:
    return legacy(df, text, T.LECTURE_FILLERS)


def no_vad(df: DataFrame, text: str = "text", words=T.FILLERS) -> DataFrame:
    """A recording decoded as one piece: trimmed, without fillers, as paragraphs."""
    return legacy(df.withColumn(text, strip(F.coalesce(text, F.lit("")))), text, words)


def combine_results(results: DataFrame, group: list[str], order: str = "segment_id") -> DataFrame:
    """(group, text, segments, language): the results of a recording's pieces, in order, as one.

    results: a row per piece with start_time, text, segments (array of start, end, text; relative to the
    piece) and language. Empty texts are left out; segments move by start_time and are sorted by start; the
    first language that is known counts. A group is one recording, so its rows fit one task."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "start_time", "text", "segments", "language")))
    said = F.transform(F.filter("rows", lambda r: F.coalesce(r["text"], F.lit("")) != ""), lambda r: strip(r["text"]))

    def moved(r: Column) -> Column:
        return F.transform(F.coalesce(r["segments"], F.array()), lambda x, i: F.struct(
            (x["start"] + r["start_time"]).alias("start"), r["o"].alias("o"), i.alias("i"), (x["end"] + r["start_time"]).alias("end"), x["text"].alias("text")))

    placed = F.array_sort(F.flatten(F.transform("rows", moved)))
    known = F.filter("rows", lambda r: F.coalesce(r["language"], F.lit("")) != "")
    return results.groupBy(*group).agg(rows.alias("rows")).select(
        *group, strip(F.array_join(said, " ")).alias("text"), F.transform(placed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))).alias("segments"),
        F.get(known, F.lit(0))["language"].alias("language"),
    )


def _spoken(text: Column) -> Column:
    """Nothing, a lone mark or marks only are no speech."""
    return F.when(strip(text).rlike(r"^[-_()\[\]{}\"']?$"), F.lit(T.NO_SPEECH_SHORT)).otherwise(T.punctuation_only(text))


def hybrid(results: DataFrame, group: list[str], order: str = "segment_id", most_chars: int = 500, punctuate: Step = T.basic_punctuation) -> DataFrame:
    """(group, text, paragraphs): texts of pieces joined, speech without words named as such, then punctuated
    by any model, as paragraphs."""
    joined = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda r: r["text"] != ""), lambda r: r["text"]), " ")
    told = apply(results.groupBy(*group).agg(joined.alias("text")), [_spoken, punctuate])
    return told.withColumn("paragraphs", P.rich_paragraphs(F.col("text"), most_chars=most_chars))


def semantic_paragraphs(df: DataFrame, group: list[str], order: str, vector: str, text: str = "text", threshold: float = 0.5, least: int = 150, most: int = 800) -> DataFrame:
    """(group, text): sentences in order, parted where neighbours' vectors differ, lengths then refined."""
    parted = P.semantic_breaks(df, group, order, vector, text, threshold)
    paragraphs = parted.groupBy(*group, "para_no").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("s"))
    lines = paragraphs.select(*group, "para_no", F.array_join(F.col(f"s.{text}"), " ").alias(text))
    whole = S.reassemble(lines.withColumn("g", F.struct(*group)), "g", "para_no", text, "\n\n").select("g.*", "text")
    return whole.withColumn("text", P.refine_paragraphs(F.col("text"), least, most))


def questions(df: DataFrame, group: list[str], order: str, text: str = "text", answer: str = "A", question: Column | None = None) -> DataFrame:
    """(group, text, n_questions): paragraphs in order with questions and the answers after them labelled."""
    labelled = P.label_answers(df, group, order, text, answer, question)
    rows = F.array_sort(F.collect_list(F.struct(order, "labelled")))
    whole = labelled.groupBy(*group).agg(rows.alias("rows"))
    return whole.select(*group, F.array_join(F.col("rows.labelled"), "\n\n").alias("text"), F.size(F.filter("rows", lambda r: F.startswith(r["labelled"], F.lit("Q:")))).alias("n_questions"))


def ultra(df: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    steps: list[Step] = [T.basic_punctuation, lambda t: spelling.substitute(t, s.rules), T.capitalise_sentences, T.capitalise_words, T.lower_contractions,
                         T.grammar_style, T.final_cleanup, T.final_coherence]
    if not s.rules:
        del steps[1]
    done = apply(df.withColumn("_o", F.col(text)), steps, text)
    return done.withColumn(text, T.length_guard(F.col("_o"), F.col(text), 0.4)).drop("_o")


def enhanced(df: DataFrame, text: str = "text") -> DataFrame:
    done = apply(df.withColumn("_o", F.col(text)), [T.enhanced_capitals, T.enhanced_cleanup], text)
    return done.withColumn(text, T.length_guard(F.col("_o"), F.col(text), 0.5)).drop("_o")


def report(df: DataFrame, before: str, after: str, key: str = "doc_id") -> DataFrame:
    """(key, report): quality before and after as one struct, ready for JSON. What the stages counted
    (columns of postprocess with statistics) goes with the quality after."""
    counted = [F.col(c).alias(name) for c, name in (
        ("early_artifacts", "early_artifacts"), ("dropped_sentences", "global_frequency"), ("loop_events", "loop_detection"), ("late_artifacts", "late_artifacts")) if c in df.columns]

    def part(name: str, stage: str, *more: Column) -> Column:
        return F.struct(F.col("total_sentences"), F.col("unique_sentences"), F.col("top_repeated"), F.lit(stage).alias("stage"), *more).alias(name)

    first = S.quality(df, before).withColumn("_before", part("before", "before")).drop("total_sentences", "unique_sentences", "top_repeated")
    both = S.quality(first, after).withColumn("_after", part("after", "after", *counted))
    return both.select(key, F.struct(F.col("_before").alias("before"), F.col("_after").alias("after")).alias("report"))
