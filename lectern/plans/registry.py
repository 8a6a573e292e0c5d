"""Registered queries over the tables, and for each, where SQL can say it, its equivalent for DuckDB.

Tables without a recording's shape stand in: documents for transcripts, users' events for segments
([ts, ts + value seconds]), conversations for question and answer, embeddings for sentence vectors.
What the tables lack (torn numbers, file names) is built from their columns, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import spelling
from ..functions import text as T
from ..functions.regexes import lower
from ..operators import paragraphs as P
from ..operators import segments as G
from ..operators import sentences as S
from ..sources import files, transcripts
from . import pipelines

Query = tuple


def _t(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_documents, _events, _conversations, _labels, _embeddings = map(_t, ("documents", "events", "conversations", "labels", "embeddings"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "text")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, start, end, event_type): seconds since 1970."""
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return _events(spark, sf_dir).select("user_id", "event_id", ts.alias("start"), (ts + F.col("value")).alias("end"), "event_type", "value")


_SEGMENTS = """segments AS (
  SELECT user_id, event_id, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + value AS "end", event_type, value FROM events
)"""
_TRIM = r"regexp_replace(regexp_replace({0}, '^[\s\x0b]+', ''), '[\s\x0b]+$', '')"
#: DuckDB's own word ends know ASCII only, so words are put between two control characters first.
_WORDS = r"regexp_replace({0}, '([\p{{L}}\p{{M}}\p{{N}}_]+)', chr(2) || '\1' || chr(3), 'g')"
_SENTS = rf"""sents AS (
  SELECT doc_id, pos, sent, rtrim(regexp_replace(lower({_TRIM.format('sent')}), '[\s\x0b]+', ' ', 'g'), '.,!?;:') AS norm FROM (
    SELECT doc_id, unnest(parts) AS sent, generate_subscripts(parts, 1) AS pos FROM (
      SELECT doc_id, string_split(regexp_replace({_TRIM.format('text')}, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)))"""
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY pos) AS r FROM sents WHERE norm <> '')"

#: Words and what lies between them, as a list.
_TOKENS = "string_split(replace(" + _WORDS + ", chr(3), chr(2)), chr(2))"
_UPPER_FIRST = "upper({0}[1]) || {0}[2:]"
_SPLIT_WORDS = r"list_filter(regexp_split_to_array({0}, '[\s\x0b]+'), lambda w: w <> '')"


def _sql_between(text: str, mark: str, one: str) -> str:
    """The text with one (of p) applied to what lies between matches of mark."""
    parts = f"string_split(regexp_replace({text}, '({mark})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"array_to_string(list_transform({parts}, lambda p, i: CASE WHEN i % 2 = 0 THEN p ELSE {one} END), '')"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# Sentences ---------------------------------------------------------------------------------------

_register(
    "sentence_cap", lambda s, d: S.cap_sentences(_docs(s, d)).select("doc_id", "capped", "n_sentences", "n_unique", "n_dropped"),
    f"""WITH {_SENTS}, {_RANKED}, kept AS (
      SELECT doc_id, string_agg(sent, ' ' ORDER BY pos) FILTER (r <= 4) AS capped, count(DISTINCT norm) AS n_unique, count(*) FILTER (r > 4) AS n_dropped
      FROM ranked GROUP BY doc_id)
    SELECT n.doc_id, coalesce(capped, '') AS capped, n.n_sentences, coalesce(n_unique, 0)::INT AS n_unique, coalesce(n_dropped, 0)::INT AS n_dropped
    FROM (SELECT doc_id, count(*)::INT AS n_sentences FROM sents GROUP BY doc_id) n LEFT JOIN kept ON n.doc_id = kept.doc_id""",
)
_register(
    "sentence_top_repeats",
    # The outer form: the inner one filters empty arrays first and would make each array twice for that.
    lambda s, d: S.quality(_docs(s, d), top=20).select("doc_id", F.posexplode_outer("top_repeated").alias("rank", "x")).filter("x is not null").select("doc_id", "rank", "x.sentence", "x.n"),
    f"""WITH {_SENTS}, counted AS (SELECT doc_id, norm, count(*) AS n, min(pos) AS first FROM sents WHERE norm <> '' GROUP BY doc_id, norm HAVING count(*) > 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) - 1 AS rank FROM counted)
    SELECT doc_id, rank::INT AS rank, norm AS sentence, n::INT AS n FROM placed WHERE rank < 20""",
)
_register(
    "quality_report", lambda s, d: S.quality(_docs(s, d)).select("doc_id", "total_sentences", "unique_sentences", F.size("top_repeated").alias("n_repeated")),
    f"""WITH {_SENTS}, c AS (SELECT doc_id, norm, count(*) AS n FROM sents WHERE norm <> '' GROUP BY doc_id, norm),
    u AS (SELECT doc_id, count(*)::INT AS unique_sentences, least(25, count(*) FILTER (n > 1))::INT AS n_repeated FROM c GROUP BY doc_id)
    SELECT t.doc_id, t.total_sentences, coalesce(unique_sentences, 0) AS unique_sentences, coalesce(n_repeated, 0) AS n_repeated
    FROM (SELECT doc_id, count(*) FILTER (trim(sent) <> '')::INT AS total_sentences FROM sents GROUP BY doc_id) t LEFT JOIN u ON t.doc_id = u.doc_id""",
)
_register(
    "sentence_frequency",
    lambda s, d: S.explode_sentences(_docs(s, d)).filter("norm <> ''").groupBy("norm").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs")).filter("n > 1"),
    f"WITH {_SENTS} SELECT norm, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM sents WHERE norm <> '' GROUP BY norm HAVING count(*) > 1",
)
_register(
    "consecutive_cap", lambda s, d: _docs(s, d).select("doc_id", S.cap_consecutive(F.col("text"), 1).alias("text")),
    f"""WITH {_SENTS}, flagged AS (SELECT *, lag(sent) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM sents WHERE sent <> '')
    SELECT doc_id, coalesce(string_agg(sent, ' ' ORDER BY pos) FILTER (last IS NULL OR last <> sent), '') AS text FROM flagged GROUP BY doc_id""",
)
_register(
    "loop_break", lambda s, d: _docs(s, d).select("doc_id", S.break_loops(F.col("text")).alias("l")).select("doc_id", "l.*"),
)


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    after = T.format_numbers(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return docs.select("doc_id", "text", after.alias("after")).select("doc_id", *(c.alias(k) for k, c in S.diff_statistics(F.col("text"), F.col("after")).items()))


def _measures(t: str, k: str) -> str:
    return (
        f"length({t}) AS chars_{k}, len(regexp_extract_all({t}, '[.!?]+'))::INT AS sentences_{k}, "
        f"len(list_filter(string_split({t}, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S')))::INT AS paragraphs_{k}, (length({t}) - length(translate({t}, '.!?', ''))) AS marks_{k}"
    )


_register(
    "text_diff_stats", _diff,
    f"""WITH a AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || chr(10)),
      '(\\d+),\\s+(\\d{{3}})', '\\1,\\2', 'g'), '(\\d+)\\s+,(\\d{{3}})', '\\1,\\2', 'g'), '(\\d+)\\s*,\\s*(\\d{{3}})', '\\1,\\2', 'g') AS after FROM documents),
    m AS (SELECT doc_id, {_measures('text', 'before')}, {_measures('after', 'after')} FROM a)
    SELECT *, chars_after - chars_before AS chars_delta, sentences_after - sentences_before AS sentences_delta, paragraphs_after - paragraphs_before AS paragraphs_delta,
      marks_after - marks_before AS marks_delta, CASE WHEN chars_before > 0 THEN chars_after / chars_before ELSE 0.0 END AS length_ratio FROM m""",
)

# Cleaning ----------------------------------------------------------------------------------------

_register(
    "filler_clean", lambda s, d: _documents(s, d).select("doc_id", T.remove_words(F.col("text"), ("the", "of", "and that")).alias("text")),
    rf"""SELECT doc_id, {_TRIM.format(r"regexp_replace(regexp_replace(text, '(?i)\bthe\b|\bof\b|\band that\b', '', 'g'), '\s{2,}', ' ', 'g')")} AS text FROM documents""",
)
_register(
    "number_format", lambda s, d: _documents(s, d).select("doc_id", T.format_numbers(F.concat(F.col("n_chars").cast("string"), F.lit(", 500 and 2 ,"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit(" , 000 in 1990, 200 people "), F.col("text"))).alias("text")),
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(n_chars::VARCHAR || ', 500 and 2 ,' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || ' , 000 in 1990, 200 people ' || text,
      '(\d+),\s+(\d{3})', '\1,\2', 'g'), '(\d+)\s+,(\d{3})', '\1,\2', 'g'), '(\d+)\s*,\s*(\d{3})', '\1,\2', 'g') AS text FROM documents""",
)


def _noisy() -> Column:
    return F.concat(F.lit("Let's go. "), F.col("text"), F.lit(" Oh, oh, oh. Thank you. Maintain capitalization, as written. Copyright 2020 all rights reserved."))


_NOISY = "'Let''s go. ' || text || ' Oh, oh, oh. Thank you. Maintain capitalization, as written. Copyright 2020 all rights reserved.'"


def _sql_removals(expression: str, patterns) -> str:
    """(doc_id, text, n_removed): one pattern after another, each counted in what the one before left."""
    found = f"SELECT doc_id, {expression} AS text, 0 AS n_removed FROM documents"
    for p in patterns:
        p = f"'(?i){p.replace(chr(39), chr(39) * 2)}'"
        found = f"SELECT doc_id, regexp_replace(text, {p}, '', 'g') AS text, n_removed + len(regexp_extract_all(text, {p}))::INT AS n_removed FROM ({found})"
    return found


_register(
    "artifact_clean", lambda s, d: _documents(s, d).select("doc_id", T.remove_artifacts(_noisy()).alias("text"), F.map_values(T.artifact_counts(_noisy())).alias("counts")).select("doc_id", "text", F.aggregate("counts", F.lit(0), lambda a, c: a + c).alias("n_removed")),
    _sql_removals(_NOISY, (*T.INLINE_ARTIFACTS, *T.WATERMARKS)),
)
_register(
    "hallucination_clean", lambda s, d: _documents(s, d).select("doc_id", T.remove_hallucinations(_noisy()).alias("text"), T.count_hallucinations(_noisy()).alias("n_removed")),
)
_register(
    "prompt_clean", lambda s, d: _documents(s, d).select("doc_id", T.remove_prompt_artifacts(_noisy()).alias("text")),
    rf"""WITH a AS (SELECT doc_id, text AS t FROM ({_sql_removals(_NOISY, (*T.PRIMER_FRAGMENTS, *T.PROMPT_PHRASES))}))
    SELECT doc_id, {_TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\s\x0b]+', ' ', 'g'), ',\s*,+', ',', 'g'), '\.\s*\.+', '.', 'g'), '^\s*[,\.]+\s*', '')")} AS text FROM a""",
)
_register(
    "spacing_fix", lambda s, d: _documents(s, d).select("doc_id", T.fix_spacing(F.concat(F.lit("let 's see , they 've . . gone; I 'm "), "text")).alias("text")),
)
_register(
    "spelling", lambda s, d: _documents(s, d).select("doc_id", spelling.convert_spelling(F.concat(F.lit("Color COLOR gray checks "), "text")).alias("text")),
    "WITH s AS (SELECT MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in spelling.BRITISH.items()) + "} AS british), t AS (SELECT doc_id, "
    + _TOKENS.format("'Color COLOR gray checks ' || text") + f""" AS ws FROM documents)
    SELECT doc_id, array_to_string(list_transform(ws, lambda w: CASE WHEN british[lower(w)] IS NULL THEN w WHEN upper(w) = w AND lower(w) <> w THEN upper(british[lower(w)])
      WHEN w[1] <> lower(w[1]) THEN {_UPPER_FIRST.format('british[lower(w)]')} ELSE british[lower(w)] END), '') AS text FROM t, s""",
)
_register(
    "spelling_tokens",
    lambda s, d: _documents(s, d).select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("word")).filter(F.col("word").isin(*spelling.BRITISH)).groupBy("word").agg(F.count("*").alias("n")),
    "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS word FROM documents) WHERE word IN ("
    + ", ".join(f"'{w}'" for w in spelling.BRITISH) + ") GROUP BY word",
)
_register(
    "custom_rules", lambda s, d: _documents(s, d).select("doc_id", spelling.substitute(F.col("text"), [("of the", "for a"), ("the", "that"), ("and", "plus")]).alias("text")),
)
_register(
    "profanity_mute", lambda s, d: _docs(s, d).select("doc_id", T.remove_profanity(F.col("text"), ("the", "and")).alias("text")),
    "SELECT doc_id, replace(replace(text, 'the', '[muted]'), 'and', '[muted]') AS text FROM documents",
)
_register(
    "join_false_breaks", lambda s, d: _documents(s, d).select("doc_id", T.join_false_breaks(F.col("text")).alias("text")),
    rf"""SELECT doc_id, replace(replace(regexp_replace(regexp_replace({_WORDS.format('text')},
      '(?i)\x02(a|an|the|our|as|of|to|in|on|at|by|for|with|from|but|and|or)\x03\.[\s\x0b]+\x02([A-Z][a-z]{{2,}})\x03', '\1 \2', 'g'),
      '\x02(down|over|under|behind|above|below)\x03\.[\s\x0b]+\x02(Behind|Inside|Outside|Above|Below|Over|Under)\x03', '\1 \2', 'g'), chr(2), ''), chr(3), '') AS text
    FROM documents""",
)
_register("word_runs", lambda s, d: _docs(s, d).select("doc_id", S.collapse_word_runs(F.col("text"), 1).alias("text")))
_register("phrase_runs", lambda s, d: _docs(s, d).select("doc_id", S.collapse_phrases(F.concat(F.lit("to go, to go, to go, and and and "), "text")).alias("text")))
_register("repetition_collapse", lambda s, d: _docs(s, d).select("doc_id", S.collapse_repetitions(F.col("text"), 3).alias("text")))
_register("missing_boundaries", lambda s, d: _docs(s, d).select("doc_id", T.fix_missing_boundaries(F.concat(F.lit("bound so its power now the god but "), "text")).alias("text")))
_register(
    "length_guard", lambda s, d: _docs(s, d).select("doc_id", T.length_guard(F.col("text"), F.regexp_replace("text", "[a-m ]", ""), 0.4).alias("text")),
    "SELECT doc_id, CASE WHEN length(p) < 0.4 * length(text) THEN text ELSE p END AS text FROM (SELECT *, regexp_replace(text, '[a-m ]', '', 'g') AS p FROM documents)",
)
_register(
    "suspicious", lambda s, d: _documents(s, d).select("doc_id", T.is_suspicious(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" (C) X"))).otherwise(F.col("text"))).alias("suspicious")),
    """SELECT doc_id, (contains(t, '©') OR contains(t, '(c)') OR contains(t, 'copyright') OR contains(t, 'bf-watch') OR contains(t, 'watch tv') OR contains(t, 'bfwatch')
      OR contains(t, 'all rights reserved') OR contains(t, 'www.') OR contains(t, 'http://') OR contains(t, 'https://')) AS suspicious
    FROM (SELECT doc_id, lower(CASE WHEN doc_id % 7 = 0 THEN text || ' (C) X' ELSE text END) AS t FROM documents)""",
)
_register(
    "no_speech",
    lambda s, d: _documents(s, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(" \n")).when(F.col("doc_id") % 3 == 1, F.lit(". , !")).otherwise(F.col("text")).alias("t")).select("doc_id", T.no_speech(F.col("t")).alias("basic"), T.punctuation_only(F.col("t")).alias("strict")),
    rf"""SELECT doc_id, coalesce(nullif({_TRIM.format('t')}, ''), '{T.NO_SPEECH}') AS basic,
      CASE WHEN {_TRIM.format("translate(t, '.!?,;:', '')")} = '' THEN '{T.NO_SPEECH_SHORT}' ELSE t END AS strict
    FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' || chr(10) WHEN doc_id % 3 = 1 THEN '. , !' ELSE text END AS t FROM documents)""",
)
_register(
    "sentence_end", lambda s, d: S.explode_sentences(_docs(s, d)).select("doc_id", "pos", T.is_sentence_end(F.col("sentence")).alias("ends")),
    rf"""WITH {_SENTS}, t AS (SELECT doc_id, pos, {_TRIM.format('sent')} AS t FROM sents), w AS (
      SELECT *, CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '[\s\x0b]+')) END AS n, {_WORDS.format('t')} AS w FROM t)
    SELECT doc_id, (pos - 1)::INT AS pos, CASE WHEN n < 8 THEN n >= 5 AND regexp_matches(t, '[.!?][\s\x0b]*$') AND NOT regexp_matches(t, '(?i)^(?:{T.FRAGMENTS})')
      WHEN regexp_matches(w, '(?i)\x02(?:{T.GOING_ON})\x03[\s\x0b]*$|[,:.-][\s\x0b]*$') THEN false
      WHEN NOT regexp_matches(w, '(?i)\x02(?:{T.VERBS})\x03') AND n < 15 THEN false
      WHEN n < 20 THEN regexp_matches(w, '(?i)\x02(?:and|but|or)\x03') AND n >= 12 ELSE true END AS ends FROM w""",
)

_register(
    "capital_sentences", lambda s, d: _docs(s, d).select("doc_id", T.capitalise_sentences(lower(F.col("text"))).alias("text")),
    f"""WITH {_SENTS} SELECT doc_id, coalesce(string_agg({_UPPER_FIRST.format('lower(sent)')}, ' ' ORDER BY pos) FILTER (sent <> ''), '') AS text FROM sents GROUP BY doc_id""",
)
_register(
    "capital_words", lambda s, d: _docs(s, d).select("doc_id", T.capitalise_words(F.concat(F.lit("on monday i'm in FRANCE, not i. "), "text")).alias("text")),
    "SELECT doc_id, array_to_string(list_transform(" + _TOKENS.format("'on monday i''m in FRANCE, not i. ' || text")
    + f", lambda w: CASE WHEN lower(w) IN ({', '.join(repr(w) for w in T.PROPER_NOUNS)}) THEN {_UPPER_FIRST.format('lower(w)')} WHEN w = 'i' THEN 'I' ELSE w END), '') AS text FROM documents",
)
_register(
    "final_cleanup", lambda s, d: _docs(s, d).select("doc_id", T.final_cleanup(F.concat(F.lit('he said " so " ,and left ;now '), "text")).alias("text")),
    rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('he said " so " ,and left ;now ' || text, '[\s\x0b]+([,.!?;:])', '\1', 'g'), '([,.!?;:])[\s\x0b]*', '\1 ', 'g'), '[\s\x0b]+', ' ', 'g') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '" +', '"', 'g'), ' +"', ' "', 'g') AS t FROM a),
    c AS (SELECT doc_id, CASE WHEN t <> '' AND NOT regexp_matches(t, '[.!?]$') THEN t || '.' ELSE t END AS t FROM b)
    SELECT doc_id, {_TRIM.format(_UPPER_FIRST.format('t'))} AS text FROM c""",
)
_register(
    "decimal_cleanup", lambda s, d: _docs(s, d).select("doc_id", T.decimal_cleanup(F.concat(F.lit("it is 0. 25 of 1, 000 , or so .  then it ends! we go. "), "text")).alias("text")),
    rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('it is 0. 25 of 1, 000 , or so .  then it ends! we go. ' || text, '(\d)\.[\s\x0b]+(\d)', '\1.\2', 'g'),
      '(\d),[\s\x0b]+(\d{{3}})\b', '\1,\2', 'g'), '[^\S\n]+([,.!?;:])', '\1', 'g') AS t FROM documents),
    p AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?][^\S\n]{{1,8}})([a-z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM a)
    SELECT doc_id, array_to_string(list_transform(ps, lambda x, i: CASE WHEN i > 1 THEN {_UPPER_FIRST.format('x')} ELSE x END), '') AS text FROM p""",
)
_register(
    "capital_split", lambda s, d: _docs(s, d).select("doc_id", F.posexplode(S.split_capital(F.col("text"))).alias("pos", "sentence")),
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\x0b]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents)
    SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INT AS pos, unnest(ps) AS sentence FROM p""",
)
_register(
    "reassemble", lambda s, d: S.reassemble(S.explode_sentences(_docs(s, d)).filter(F.col("pos") % 3 != 1)),
    f"WITH {_SENTS} SELECT doc_id, string_agg(sent, ' ' ORDER BY pos) AS text FROM sents WHERE pos % 3 <> 2 GROUP BY doc_id",
)
_register(
    "abbreviation_end",
    lambda s, d: S.explode_sentences(_docs(s, d)).select("doc_id", "pos", T.is_abbreviation_end(F.concat("sentence", F.element_at(F.array(*(F.lit(x) for x in ("", " Dr.", " B.", "..."))), F.col("pos") % 4 + 1))).alias("open")),
    rf"""WITH {_SENTS}, t AS (SELECT doc_id, (pos - 1)::INT AS pos, {_TRIM.format("(sent || ['', ' Dr.', ' B.', '...'][(pos - 1) % 4 + 1])")} AS t FROM sents),
    w AS (SELECT *, regexp_split_to_array(t, '[\s\x0b]+')[-1] AS w FROM t)
    SELECT doc_id, pos, w IN ({', '.join(repr(a) for a in T.ABBREVIATIONS)}) OR regexp_matches(w, '^[A-Z]\.$') OR ends_with(t, '...') AS open FROM w""",
)
_register(
    "chunk_overlap",
    lambda s, d: _conversations(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c")).select("conv_id", P.drop_overlap(F.col("c.text"), 3).alias("text")),
    r"""WITH w AS (SELECT conv_id, turn, text, regexp_split_to_array(text, '[\s\x0b]+') AS ws, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
    SELECT conv_id, string_agg(CASE WHEN NOT last AND len(ws) > 3 THEN array_to_string(ws[1:len(ws) - 3], ' ') ELSE text END, ' ' ORDER BY turn) AS text FROM w GROUP BY conv_id""",
)
_register(
    "result_shape",
    lambda s, d: transcripts.normalise_results(_conversations(s, d).select("conv_id", "turn", F.struct(
        F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.lit(" ")).alias("text"),
        F.when(F.col("turn") % 5 != 4, F.array(*(F.struct(c.alias("text")) for c in (F.col("text"), F.lit(None).cast("string"), F.concat(F.lit(" "), "role"))))).alias("segments"),
        F.col("role").alias("language")).alias("result"))).select("conv_id", "turn", "result.text", F.size("result.segments").alias("n_segments"), "result.language"),
    rf"""WITH t AS (SELECT *, {_TRIM.format('text')} AS t, turn % 5 <> 4 AS has FROM conversations)
    SELECT conv_id, turn, coalesce(nullif(CASE turn % 3 WHEN 0 THEN t WHEN 1 THEN '' END, ''), CASE WHEN NOT has THEN '' WHEN t = '' THEN role ELSE t || ' ' || role END) AS text,
      CASE WHEN NOT has THEN 0 WHEN t = '' THEN 1 ELSE 2 END::INT AS n_segments, role AS language FROM t""",
)
_register(
    "label_text",
    lambda s, d: _conversations(s, d).select("conv_id", "turn", F.split("text", " ").alias("ws")).select("conv_id", "turn", P.from_labels(F.col("ws"), F.transform("ws", lambda w, i: F.element_at(F.array(*map(F.lit, ("O", "COMMA", "O", "PERIOD"))), i % 4 + 1))).alias("text")),
    r"""SELECT conv_id, turn, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, ' '), lambda w, i: w || ['', ' ,', '', ' .'][(i - 1) % 4 + 1]), ' '),
      '[\s\x0b]+([.,!?])', '\1', 'g'), '([.,!?])([A-Z])', '\1 \2', 'g') AS text FROM conversations""",
)

# Segments ----------------------------------------------------------------------------------------

_MERGED = """flagged AS (
  SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM segments
), islands AS (
  SELECT *, sum(CASE WHEN latest IS NULL OR start - latest > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM flagged
), merged AS (
  SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM islands GROUP BY user_id, island
)"""

_register("interval_merge", lambda s, d: G.merge_intervals(_segments(s, d), ["user_id"], 21600.0), f"WITH {_SEGMENTS}, {_MERGED.format(gap=21600)} SELECT * FROM merged")
_register(
    "lecture_segments", lambda s, d: G.lecture_segments(_segments(s, d), ["user_id"], 10.0, 3600.0, 5),
    f"""WITH {_SEGMENTS}, {_MERGED.format(gap=3600)}, long AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "end" - start DESC, start, "end") AS r FROM merged WHERE "end" - start >= 10)
    SELECT user_id, start, "end", n FROM long WHERE r <= 5""",
)
_register(
    "standard_segments", lambda s, d: G.standard_segments(_segments(s, d), ["user_id"], 0.5, 3600.0, 10, "pair_shortest").select("user_id", "start", "end"),
    f"""WITH {_SEGMENTS}, {_MERGED.format(gap=3600)}, r AS (
      SELECT user_id, start, "end", count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY "end" - start, start, "end") AS r FROM merged WHERE "end" - start >= 0.5
    ), c AS (SELECT *, total > 10 AND r <= total - least(10, total // 2) AS short FROM r),
    n AS (SELECT *, coalesce(start - lag("end") OVER (PARTITION BY user_id ORDER BY r) <= 7200, false) AS near FROM c WHERE short),
    g AS (SELECT *, sum((NOT near)::INT) OVER (PARTITION BY user_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS run FROM n),
    p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY r) - 1) // 2 AS pair FROM g)
    SELECT user_id, start, "end" FROM c WHERE NOT short UNION ALL SELECT user_id, arg_min(start, r), max("end") FROM p GROUP BY user_id, run, pair""",
)
_register(
    "longest_k", lambda s, d: G.longest(_segments(s, d), ["user_id"], 3).select("user_id", "start", "end", "event_id"),
    f"""WITH {_SEGMENTS} SELECT user_id, start, "end", event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "end" - start DESC, start, "end") AS r FROM segments) WHERE r <= 3""",
)
_register(
    "speech_edges",
    lambda s, d: G.speech_edges(_events(s, d).select("user_id", "event_id", (F.col("value") > 50).alias("speech")).withColumn("frame", F.expr("row_number() over (partition by user_id order by event_id) - 1")), ["user_id"], "frame", "speech"),
    """WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, value > 50 AS speech FROM events),
    e AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS run FROM f WHERE speech)
    SELECT user_id, greatest(0.0, min(frame) * 30 / 1000.0 - 0.3) AS start, (max(frame) + 1) * 30 / 1000.0 + 0.3 AS "end" FROM e GROUP BY user_id, run""",
)
_register(
    "tumbling_segments", lambda s, d: G.tumbling(_events(s, d).select("event_id", "value"), "value").select("event_id", "start", "end"),
    """SELECT event_id, g::DOUBLE AS start, least(g + 30, value) AS "end" FROM (SELECT event_id, value, unnest(range(0, floor(value)::BIGINT, 30)) AS g FROM events)""",
)
_register(
    "sliding_chunks", lambda s, d: G.sliding(_events(s, d).select("event_id", "value"), "value").select("event_id", "segment_id", "start", "end"),
    """SELECT event_id, (g // 25)::INT AS segment_id, g::DOUBLE AS start, least(g + 30, value) AS "end" FROM (SELECT event_id, value, unnest(range(0, ceil(value)::BIGINT, 25)) AS g FROM events WHERE value > 0)""",
)
_register(
    "order_check", lambda s, d: G.order_faults(_segments(s, d), ["user_id"], 5.0, tie="event_id").select("user_id", "event_id", "start", "previous_end"),
    f"""WITH {_SEGMENTS}, l AS (SELECT *, lag("end") OVER (PARTITION BY user_id ORDER BY start, "end", event_id) AS previous_end FROM segments)
    SELECT user_id, event_id, start, previous_end FROM l WHERE start < previous_end - 5""",
)
_register(
    "coverage", lambda s, d: G.coverage(_segments(s, d), ["user_id"]).select("user_id", "n", F.round("covered", 3).alias("covered"), F.round(G.per_minute(F.col("n"), F.col("covered")), 6).alias("rate"), G.is_incomplete(F.col("covered"), F.lit(2.5e6)).alias("incomplete")),
    f"""WITH {_SEGMENTS}, c AS (SELECT user_id, count(*) AS n, max("end") - min(start) AS covered FROM segments GROUP BY user_id)
    SELECT user_id, n, round(covered, 3) AS covered, round(n / greatest(covered / 60, 1.0), 6) AS rate, covered < 0.8 * 2.5e6 AS incomplete FROM c""",
)
_register(
    "confidence_filter",
    lambda s, d: G.confident(_documents(s, d).select("doc_id", F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.lit(" www.")).otherwise(F.lit(""))).alias("text"), (-(F.col("doc_id") % 4).cast("double")).alias("avg_logprob"), F.lit(0.95).alias("no_speech_prob"))).select("doc_id"),
    "SELECT doc_id FROM documents WHERE trim(text) <> '' AND NOT (-(doc_id % 4) < -1.5 AND (doc_id % 5 = 0 OR "
    + " OR ".join(f"contains(lower(text), '{m}')" for m in ("©", "(c)", "copyright", *T.SUSPICIOUS_MARKERS)) + "))",
)
_register(
    "segment_text",
    lambda s, d: G.joined_text(_conversations(s, d), ["conv_id"], ["turn"]),
    "SELECT conv_id, coalesce(string_agg(trim(text), ' ' ORDER BY turn) FILTER (trim(text) <> ''), '') AS text FROM conversations GROUP BY conv_id",
)
_register(
    "first_known", lambda s, d: G.first_known(_conversations(s, d).withColumn("language", F.when(F.col("turn") > 0, F.col("role"))), ["conv_id"], "language", "turn"),
    "SELECT conv_id, arg_min(role, turn) FILTER (turn > 0) AS language FROM conversations GROUP BY conv_id",
)
_register(
    "merge_by_flags", lambda s, d: G.merge_by_flags(_conversations(s, d).withColumn("flag", F.col("role") == "assistant"), ["conv_id"], "turn", "flag"),
    """WITH n AS (SELECT *, coalesce(sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence_no FROM conversations),
    j AS (SELECT conv_id, sentence_no, string_agg(trim(text), ' ' ORDER BY turn) AS text FROM n GROUP BY conv_id, sentence_no)
    SELECT conv_id, sentence_no, CASE WHEN regexp_matches(text, '[.!?]$') THEN text ELSE text || '.' END AS text FROM j""",
)
_register(
    "chunk_shift",
    lambda s, d: G.shift(_segments(s, d).select("event_id", (F.col("event_id") % 16).alias("segment_id"), F.col("value").alias("start"), (F.col("value") + 1).alias("end")), s.range(16).select(F.col("id").alias("segment_id"), (F.col("id") * 25.0).alias("start_time"))).select("event_id", "start", "end"),
    """SELECT event_id, value + (event_id % 16) * 25.0 AS start, value + 1 + (event_id % 16) * 25.0 AS "end" FROM events""",
)
_register(
    "pitch_boundaries",
    lambda s, d: _events(s, d).select("event_id", G.pitch_boundary(F.when(F.col("event_id") % 9 != 0, F.col("value")), F.lit(40.0), F.col("event_type") == "error").alias("ends"), G.pitch_frame(F.col("value")).alias("frame")),
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN event_type = 'error' WHEN value > 0 THEN (value - 40.0) / value > 0.15 ELSE false END AS ends, floor(value * 22050 / 512)::INT AS frame FROM events""",
)

# Paragraphs, questions ---------------------------------------------------------------------------


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(P.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n \n")))).alias("para_no", "text"))


_register(
    "paragraph_blocks", _blocks,
    rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS ps FROM documents)
    SELECT doc_id, unnest(ps) AS text, (generate_subscripts(ps, 1) - 1)::INT AS para_no FROM p""",
)
_register("rich_paragraphs", lambda s, d: _docs(s, d).select("doc_id", F.posexplode(P.rich_paragraphs(F.col("text"))).alias("para_no", "text")))
_register("format_paragraphs", lambda s, d: _docs(s, d).select("doc_id", P.refine_paragraphs(P.format_paragraphs(F.col("text"))).alias("text")))
_COMMAS = r"""array_to_string(list_transform(string_split(regexp_replace(p, ',[\s\x0b]+([A-Z][a-z])', ',' || chr(2) || '\1', 'g'), chr(2)),
  lambda x, k: CASE WHEN k = 1 OR regexp_matches(x, '^(?:The|An)(?:[^a-z]|$)') THEN x ELSE lower(x[1]) || x[2:] END), ' ')"""
_LONE = "upper(w[1]) = w[1] AND lower(w[1]) <> w[1] AND lower(w[2:]) = w[2:] AND NOT (upper(w) = w AND length(w) > 1) AND w <> 'I'"
_register(
    "refine_case", lambda s, d: _docs(s, d).select("doc_id", P.refine_case(F.concat(F.lit("we Saw, The Cat, And An Owl at NASA. I Came so. "), "text")).alias("text")),
    "SELECT doc_id, " + _sql_between("'we Saw, The Cat, And An Owl at NASA. I Came so. ' || text", r"[.!?]+[\s\x0b]+", "list_transform([" + _SPLIT_WORDS.format(_COMMAS) + "]," + f"""
      lambda ws: array_to_string(list_transform(ws, lambda w, j: CASE WHEN j = 1 THEN {_UPPER_FIRST.format('w')} WHEN {_LONE} AND NOT regexp_matches(ws[j - 1], '[.!?]$') THEN lower(w[1]) || w[2:] ELSE w END), ' '))[1]""")
    + " AS text FROM documents",
)
_register(
    "lower_within", lambda s, d: _docs(s, d).select("doc_id", P.lower_within(F.concat(F.lit("we Saw NASA in the USA. it IS so! "), "text")).alias("text")),
    "SELECT doc_id, " + _sql_between("'we Saw NASA in the USA. it IS so! ' || text", r"[.!?][\s\x0b]+", "array_to_string(list_transform(" + _SPLIT_WORDS.format("p") + f""",
      lambda w, j: CASE WHEN j = 1 THEN {_UPPER_FIRST.format('lower(w)')} WHEN upper(w) = w AND lower(w) <> w AND length(w) <= 3 THEN w ELSE lower(w) END), ' ')""") + " AS text FROM documents",
)
_register(
    "split_long", lambda s, d: _docs(s, d).select("doc_id", P.split_long_sentences(F.col("text")).alias("text")),
    rf"""WITH {_SENTS}, cut AS (SELECT doc_id, pos, CASE WHEN length(sent) <= 170 THEN sent ELSE array_to_string(list_transform(
      regexp_extract_all(regexp_replace(sent, '[\s\x0b]+', ' ', 'g'), '\S.{{0,169}}(?: |$)|\S+(?: |$)'), lambda x: CASE WHEN regexp_matches(rtrim(x), '[.!?]$') THEN rtrim(x) ELSE rtrim(x) || '.' END), ' ') END AS line
      FROM sents WHERE sent <> '')
    SELECT d.doc_id, coalesce(c.text, '') AS text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, ' ' ORDER BY pos) AS text FROM cut GROUP BY doc_id) c ON d.doc_id = c.doc_id""",
)
_register("segment_paragraphs", lambda s, d: P.segment_paragraphs(_conversations(s, d).withColumn("start", F.col("turn") * 2.0).withColumn("end", F.col("turn") * 2.0 + F.when(F.col("role") == "user", 1.9).otherwise(0.5)), ["conv_id"]))
_register(
    "gap_paragraphs",
    lambda s, d: G.gap_breaks(_conversations(s, d).withColumn("start", F.col("turn") * 2.0).withColumn("end", F.col("turn") * 2.0 + F.when(F.col("role") == "user", 1.9).otherwise(0.5)).withColumn("text", F.lower("text")), ["conv_id"], 1.2).select("conv_id", "turn", "para_no"),
    r"""WITH g AS (SELECT conv_id, turn, turn * 2.0 AS start, turn * 2.0 + CASE WHEN role = 'user' THEN 1.9 ELSE 0.5 END AS "end", ltrim(lower(trim(text)), '"''`“”‘’') AS t FROM conversations),
    l AS (SELECT *, lag("end") OVER w AS last_end FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY start, "end"))
    SELECT conv_id, turn, sum(CASE WHEN last_end IS NOT NULL AND (start - last_end >= 1.2 OR regexp_matches(t, '^(?:now|so|but|however|anyway|well|right now|alright|okay|ok|in summary|in conclusion|to summarise|to summarize)(?: |$)') ) THEN 1 ELSE 0 END)
      OVER (PARTITION BY conv_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS para_no FROM l""",
)
_register(
    "qa_label", lambda s, d: P.label_answers(_conversations(s, d), ["conv_id"], "turn", answer="A", question=F.col("role") == "user").select("conv_id", "turn", "labelled"),
    """WITH l AS (SELECT *, lag(role = 'user' OR starts_with(text, 'Q:')) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations)
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN starts_with(text, 'Q:') THEN text ELSE 'Q: ' || text END
      WHEN after THEN CASE WHEN starts_with(text, 'A:') THEN text ELSE 'A: ' || text END ELSE text END AS labelled FROM l""",
)
_register(
    "question_paragraphs",
    lambda s, d: _conversations(s, d).select("conv_id", "turn", T.is_question(F.concat(F.when(F.col("turn") % 3 == 0, F.lit("Whatever ")).when(F.col("turn") % 3 == 1, F.lit("is it ")).otherwise(F.lit("")), "text", F.when(F.col("conv_id") % 2 == 0, F.lit("? ")).otherwise(F.lit("")))).alias("asks")),
    "SELECT conv_id, turn, (turn % 3 < 2 OR conv_id % 2 = 0 OR regexp_matches(trim(text), '(?i)^(?:can you|could you|what|where|when|why|how|who|is it|are they|do you|does it)|[?]$')) AS asks FROM conversations",
)
_register("question_spans", lambda s, d: _conversations(s, d).select("conv_id", "turn", *(c.alias(k) for k, c in P.question_statistics(F.concat(F.lit("Is it so? "), "text")).items())))
_register(
    "semantic_breaks", lambda s, d: P.semantic_breaks(_embeddings(s, d), ["label"], "vec_id", "embedding", threshold=0.5).select("label", "vec_id", F.round("similarity", 6).alias("similarity"), "para_no"),
    """WITH l AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings),
    c AS (SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], before::DOUBLE[]) AS s FROM l)
    SELECT label, vec_id, round(s, 6) AS similarity, sum(CASE WHEN s < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS para_no FROM c""",
)

# Files, metadata, batches ------------------------------------------------------------------------


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lpad((F.col("doc_id") % 14).cast("string"), 2, "0")
    year = F.when(F.col("doc_id") % 3 == 0, F.lit("1988 MW")).when(F.col("doc_id") % 3 == 1, F.lit("Tapes 84-97")).otherwise(F.lit("misc"))
    name = F.concat(day, F.lpad((F.col("doc_id") % 33).cast("string"), 2, "0"), F.when(F.col("doc_id") % 5 == 0, F.lit(" Lecture 07")).otherwise(F.lit("_Fishes")), F.lit(".txt"))
    return _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("/media/"), year, F.lit("/Temp/"), name).alias("path"))


def _path_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    known = _names(spark, sf_dir).select("doc_id", M.file_name(p).alias("name"), M.year_from_path(F.regexp_replace(p, "/[^/]*$", "")).alias("year"), M.extension(p).alias("ext"))
    n = F.col("name")
    dated = known.select("*", M.date_from_name(n, F.col("year")).alias("date"), M.number_from_name(n).alias("number"), M.title_from_name(n).alias("title"))
    told = dated.select("*", M.subtitle(F.col("date"), F.col("number"), "the author").alias("subtitle"))
    return told.withColumn("date", F.col("date").cast("string"))


_register(
    "path_metadata", _path_metadata,
    r"""WITH n AS (SELECT doc_id, lpad((doc_id % 14)::VARCHAR, 2, '0') || lpad((doc_id % 33)::VARCHAR, 2, '0') || CASE WHEN doc_id % 5 = 0 THEN ' Lecture 07' ELSE '_Fishes' END || '.txt' AS name,
      CASE doc_id % 3 WHEN 0 THEN 1988 WHEN 1 THEN 1984 END AS year, doc_id % 14 AS mm, doc_id % 33 AS dd FROM documents),
    m AS (SELECT *, CASE WHEN year IS NOT NULL THEN try_cast(year::VARCHAR || '-' || left(name, 2) || '-' || substr(name, 3, 2) AS DATE) END AS date,
      CASE WHEN doc_id % 5 = 0 THEN 7 WHEN mm BETWEEN 1 AND 12 AND dd BETWEEN 1 AND 31 THEN dd END::INT AS number, CASE WHEN doc_id % 5 = 0 THEN 'Lecture 07' ELSE 'Fishes' END AS title FROM n)
    SELECT doc_id, name, year, '.txt' AS ext, date::VARCHAR AS date, number, title, CASE
      WHEN date IS NOT NULL AND number IS NOT NULL THEN 'Lecture ' || number || ' given on ' || day(date) || CASE WHEN day(date) IN (1, 21, 31) THEN 'st' WHEN day(date) IN (2, 22) THEN 'nd' WHEN day(date) IN (3, 23) THEN 'rd' ELSE 'th' END
        || ' of ' || monthname(date) || ' ' || year(date) || ' by the author'
      WHEN date IS NOT NULL THEN dayname(date) || ', ' || day(date) || ' ' || monthname(date) || ' ' || year(date) || chr(10) || 'by the author'
      WHEN number IS NOT NULL THEN 'Lecture ' || number || ' by the author' ELSE 'by the author' END AS subtitle FROM m""",
)
_register(
    "duration_format", lambda s, d: _events(s, d).select("event_id", M.format_duration(F.floor(F.col("value") * 97)).alias("long"), M.format_minutes(F.floor(F.col("value") * 97)).alias("minutes"), M.format_clock(F.floor(F.col("value") * 97)).alias("clock")),
    """WITH v AS (SELECT event_id, greatest(0, floor(value * 97))::BIGINT AS s FROM events)
    SELECT event_id, CASE WHEN s >= 3600 THEN s // 3600 || 'h ' ELSE '' END || (s % 3600) // 60 || 'm ' || s % 60 || '.00s' AS long,
      printf('%02d:%02d.00', s // 60, s % 60) AS minutes, printf('%02d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) AS clock FROM v""",
)
_register(
    "size_format", lambda s, d: _documents(s, d).select("doc_id", M.format_size(F.col("n_chars") * 1000 * (F.col("doc_id") % 2000)).alias("size")),
    """WITH b AS (SELECT doc_id, (n_chars * 1000 * (doc_id % 2000))::DOUBLE AS n FROM documents)
    SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576)
      WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824) ELSE printf('%.1f TB', n / 1099511627776) END AS size FROM b""",
)


def _reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _documents(spark, sf_dir).select("doc_id", F.col("doc_id").alias("stem"))
    outputs = _labels(spark, sf_dir).select(F.col("doc_id").alias("stem"), F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(doc_id % 60 as int))").alias("mtime"))
    skip, before = files.to_process(inputs, outputs), files.to_process(inputs, outputs, "before", "2024-01-31")
    return skip.select("doc_id", F.lit("skip").alias("mode")).unionByName(before.select("doc_id", F.lit("before").alias("mode")))


_register(
    "reprocess_plan", _reprocess,
    """SELECT doc_id, 'skip' AS mode FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'before' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 60 >= 30)""",
)
_register(
    "batch_summary", lambda s, d: files.batch_summary(_events(s, d).select(F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 50, "ok").otherwise("skipped").alias("status"))),
    "SELECT count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error' AND value > 50) AS ok, count(*) FILTER (event_type <> 'error' AND NOT value > 50) AS skipped FROM events",
)
_register(
    "extension_summary",
    lambda s, d: files.by_extension(_names(s, d).select(M.extension(F.regexp_replace("path", "txt$", F.when(F.col("doc_id") % 2 == 0, "TXT").otherwise("json"))).alias("ext"), (F.col("doc_id") % 100).alias("size"))),
    "SELECT CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.json' END AS ext, count(*) AS files, sum(doc_id % 100)::BIGINT AS bytes FROM documents GROUP BY 1",
)
_register(
    "header_body",
    lambda s, d: _documents(s, d).select("doc_id", F.concat(F.lit("Source: /a/"), "source", F.lit("\nOutput: x\n\n"), "text").alias("t")).select("doc_id", M.header_source(F.col("t")).alias("source"), M.body(F.col("t")).alias("body")),
    "SELECT doc_id, '/a/' || source AS source, ltrim(text, chr(10)) AS body FROM documents",
)
_register(
    "domain_terms",
    lambda s, d: transcripts.domain_terms(_documents(s, d).select(F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("- ")).otherwise(F.lit("")), F.substring_index("text", " ", 1)).alias("line"), F.lit(0).alias("source_rank"), F.col("doc_id").alias("pos"))).select("term", "at.pos"),
    """SELECT term, min(doc_id) AS pos FROM (SELECT doc_id, split_part(text, ' ', 1) AS term FROM documents) WHERE term <> '' AND NOT starts_with(term, '#') GROUP BY term ORDER BY pos LIMIT 100""",
)
_register(
    "prompt_builder", lambda s, d: _conversations(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_set("text")).alias("terms")).select(
        "conv_id", T.build_prompt(F.col("terms")).alias("prompt"), T.build_prompt(F.col("terms"), 300, "As you know, it is so.", F.when(F.col("conv_id") % 2 == 0, F.lit(" A lecture "))).alias("primed")),
    """WITH j AS (SELECT conv_id, string_agg(text, '; ' ORDER BY text) AS p FROM (SELECT DISTINCT conv_id, text FROM conversations) GROUP BY conv_id),
    k AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'A lecture. ' ELSE '' END || 'As you know, it is so.' || CASE WHEN p = '' THEN '' ELSE ' ' || p END AS q FROM j)
    SELECT conv_id, CASE WHEN length(p) > 600 THEN regexp_replace(left(p, 597), '\\s+$', '') || '...' ELSE p END AS prompt,
      CASE WHEN length(q) > 300 THEN regexp_replace(left(q, 297), '\\s+$', '') || '...' ELSE q END AS primed FROM k""",
)
_register(
    "progress_parse",
    lambda s, d: _events(s, d).select("event_id", T.parse_progress(F.concat(F.lit("PROGRESS:"), F.when(F.col("event_id") % 4 == 0, F.lit("x")).otherwise((F.col("event_id") % 101).cast("string")), F.lit("|"), "event_type", F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit("|4")))).alias("p")).select("event_id", "p.percent", "p.status", "p.threads"),
    """SELECT event_id, CASE WHEN event_id % 4 <> 0 AND event_id % 3 <> 0 THEN (event_id % 101)::DOUBLE END AS percent, CASE WHEN event_id % 4 <> 0 AND event_id % 3 <> 0 THEN event_type END AS status,
      CASE WHEN event_id % 4 <> 0 AND event_id % 3 <> 0 THEN 4 END AS threads FROM events""",
)
_register(
    "log_tail", lambda s, d: _docs(s, d).select("doc_id", T.log_tail(F.col("text")).alias("tail"), T.short_name(F.col("text")).alias("name")),
    f"SELECT doc_id, right({_TRIM.format('text')}, 70) AS tail, CASE WHEN length(text) > 50 THEN '...' || right(text, 47) ELSE text END AS name FROM documents",
)
_register(
    "log_kinds",
    lambda s, d: _events(s, d).select("event_id", F.concat(F.element_at(F.array(*(F.lit(x) for x in ("GPU: ", "done ", "Failed ", "Complete ", "x.wav ", "Loading ", "5 minutes "))), (F.col("event_id") % 7 + 1).cast("int")), "event_type").alias("line")).select("event_id", T.classify_log(F.col("line")).alias("kind"), T.format_log(F.col("line")).alias("shown")),
    """WITH l AS (SELECT event_id, ['config', 'plain', 'error', 'success', 'path', 'model', 'time'][event_id % 7 + 1] AS kind,
      ['GPU: ', 'done ', 'Failed ', 'Complete ', 'x.wav ', 'Loading ', '5 minutes '][event_id % 7 + 1] || event_type AS line FROM events)
    SELECT event_id, kind, CASE kind WHEN 'config' THEN '  ' || line WHEN 'error' THEN chr(10) || '❌ ' || line || chr(10) WHEN 'success' THEN chr(10) || '✅ ' || line
      WHEN 'path' THEN '    ' || line WHEN 'model' THEN '      ' || line WHEN 'time' THEN '    ' || line ELSE line END AS shown FROM l""",
)
_register(
    "document_blocks",
    lambda s, d: transcripts.document_blocks(_documents(s, d).select("doc_id", "source", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")), F.col("source"), F.lit("by the author")).groupBy("style").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")),
    rf"""WITH p AS (SELECT unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '')) AS t FROM documents)
    SELECT 'justified' AS style, count(*) AS n, sum(length(t))::BIGINT AS chars FROM p UNION ALL SELECT 'title', count(*), sum(length(source))::BIGINT FROM documents
    UNION ALL SELECT 'subtitle', count(*), 13 * count(*) FROM documents UNION ALL SELECT 'heading', count(*), 11 * count(*) FROM documents""",
)

# Pipelines ---------------------------------------------------------------------------------------

_register("pipeline_postprocess", lambda s, d: pipelines.postprocess(_docs(s, d)))
_register("pipeline_clean_full", lambda s, d: pipelines.clean_full(_docs(s, d)).select("doc_id", "text", "dropped_sentences", "loop_events", F.size("paragraphs").alias("n_paragraphs")))
_register("pipeline_ultra", lambda s, d: pipelines.ultra(_docs(s, d)))
_register("pipeline_enhanced", lambda s, d: pipelines.enhanced(_docs(s, d)))
_register("pipeline_legacy", lambda s, d: pipelines.legacy(_docs(s, d)).select("doc_id", "text", F.size("paragraphs").alias("n_paragraphs")))
_register(
    "pipeline_live",
    lambda s, d: pipelines.live(_conversations(s, d).select("conv_id", (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 1).alias("end"), "text", F.lit(0.0).alias("avg_logprob"), F.lit(0.0).alias("no_speech_prob")), ["conv_id"]).select("conv_id", "text", F.size("paragraphs").alias("n_paragraphs")),
)
_register("pipeline_lecture", lambda s, d: pipelines.lecture(_docs(s, d)).select("doc_id", "text", F.size("paragraphs").alias("n_paragraphs")))
_register("pipeline_no_vad", lambda s, d: pipelines.no_vad(_docs(s, d)).select("doc_id", "text", F.size("paragraphs").alias("n_paragraphs")))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as results of a recording's pieces, 25 seconds apart."""
    turn, text = F.col("turn"), F.col("text")
    said = F.when(turn % 4 == 1, F.lit("")).when(turn % 4 == 2, F.concat(F.lit(" "), text)).when(turn % 4 == 3, F.lit(". ")).otherwise(text)
    segments = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.col("role").alias("text")) for a, b in ((30.0, 31.0), (2.0, 3.0))))
    return _conversations(spark, sf_dir).select(
        "conv_id", turn.alias("segment_id"), (turn * 25.0).alias("start_time"), said.alias("text"), F.when(turn != 1, segments).alias("segments"), F.when(turn > 1, F.col("role")).alias("language"))


_PIECES = """pieces AS (SELECT conv_id, turn, role, CASE turn % 4 WHEN 1 THEN '' WHEN 2 THEN ' ' || text WHEN 3 THEN '. ' ELSE text END AS said FROM conversations)"""
_register(
    "pipeline_vad_parallel",
    lambda s, d: pipelines.combine_results(_pieces(s, d), ["conv_id"]).select("conv_id", "text", F.to_json("segments").alias("segments"), "language").select(
        "conv_id", "text", F.regexp_replace("segments", r'[{}\[\]"]', "").alias("segments"), "language"),
    rf"""WITH {_PIECES}, t AS (SELECT conv_id, string_agg({_TRIM.format('said')}, ' ' ORDER BY turn) FILTER (said <> '') AS text, arg_min(role, turn) FILTER (turn > 1) AS language FROM pieces GROUP BY conv_id),
    g AS (SELECT conv_id, turn, role, unnest([30.0, 2.0])::DOUBLE + turn * 25.0 AS start, unnest([1, 2]) AS i FROM pieces WHERE turn <> 1),
    j AS (SELECT conv_id, string_agg('start:' || start::DOUBLE || ',end:' || (start + 1)::DOUBLE || ',text:' || role, ',' ORDER BY start, turn, i) AS segments FROM g GROUP BY conv_id)
    SELECT t.conv_id, coalesce({_TRIM.format('t.text')}, '') AS text, coalesce(segments, '') AS segments, language FROM t LEFT JOIN j ON t.conv_id = j.conv_id""",
)
_register("pipeline_hybrid", lambda s, d: pipelines.hybrid(_pieces(s, d), ["conv_id"]).select("conv_id", "text", F.size("paragraphs").alias("n_paragraphs")))
_register(
    "pipeline_semantic",
    lambda s, d: pipelines.semantic_paragraphs(_embeddings(s, d).select((F.floor(F.col("vec_id") / 20)).alias("doc"), "vec_id", "embedding", F.concat(F.lit("This is what was said at place "), F.col("vec_id").cast("string"), F.lit(".")).alias("text")), ["doc"], "vec_id", "embedding"),
)
_register(
    "pipeline_questions", lambda s, d: pipelines.questions(_conversations(s, d), ["conv_id"], "turn", question=F.col("role") == "user"),
    """WITH l AS (SELECT *, lag(role = 'user' OR starts_with(text, 'Q:')) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations),
    m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN starts_with(text, 'Q:') THEN text ELSE 'Q: ' || text END
      WHEN after THEN CASE WHEN starts_with(text, 'A:') THEN text ELSE 'A: ' || text END ELSE text END AS line FROM l)
    SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS text, count(*) FILTER (starts_with(line, 'Q:'))::INT AS n_questions FROM m GROUP BY conv_id""",
)
_register(
    "pipeline_report",
    lambda s, d: pipelines.report(pipelines.postprocess(_docs(s, d).withColumn("before", F.col("text")), pipelines.Settings(statistics=True)), "before", "text").select("doc_id", F.to_json("report").alias("report")),
)
