from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import paragraphs as P
from lectern.plans import pipelines
from lectern.sources import files, transcripts


def _one(spark, texts, of):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", of(F.col("t")).alias("r"))
    return [r.r for r in df.orderBy("i").collect()]


def test_small_letters_within_sentences(spark):
    texts = ["we Saw NASA in the USA. it IS so!  AND on", "", " ", None, "A. b"]
    assert _one(spark, texts, P.lower_within) == ["We saw nasa in the USA. It IS so!  And on", "", "", None, "A. B"]


def test_case_after_commas_and_marks(spark):
    texts = ["x, The Cat,\n Andy, An Owl", "one? Two A. Three", "I am. I, I'm A cat... b", "", None]
    assert _one(spark, texts, P.refine_case) == ["X, the cat, andy, an owl", "One? Two a. Three", "I am. I, i'm a cat... B", "", None]


def test_long_sentences_fill_their_lines(spark):
    got = _one(spark, ["aa bb cc dd. e", "a" * 9 + " b c", "", None], lambda c: P.split_long_sentences(c, 6))
    assert got == ["aa bb. cc dd. e", "a" * 9 + ". b c.", "", None]


def test_prompt_with_primer_and_hint(spark):
    df = spark.createDataFrame([(["a", "b"], " h "), ([], "h"), ([], None)], "t array<string>, h string")
    got = [r[0] for r in df.select(T.build_prompt(F.col("t"), 20, "So it is.", F.col("h"))).collect()]
    assert got == ["h. So it is. a; b", "h. So it is.", "So it is."]
    assert df.select(T.build_prompt(F.col("t"), hint=F.col("h"))).first()[0] == "h. a; b"


def test_results_of_pieces_as_one(spark):
    schema = "r int, segment_id int, start_time double, text string, segments array<struct<start: double, end: double, text: string>>, language string"
    df = spark.createDataFrame([
        (1, 1, 10.0, " b ", [(0.0, 1.0, "b")], "en"), (1, 0, 0.0, "a", [(11.0, 12.0, "late"), (1.0, 2.0, "a")], None), (1, 2, 20.0, None, None, "de"), (2, 0, 0.0, "", None, None),
    ], schema)
    got = {x.r: x for x in pipelines.combine_results(df, ["r"]).collect()}
    assert got[1].text == "a b" and got[1].language == "en" and [s.text for s in got[1].segments] == ["a", "b", "late"] and got[1].segments[1].start == 10.0
    assert got[2].text == "" and got[2].segments == [] and got[2].language is None


def test_marks_alone_are_no_speech(spark):
    df = spark.createDataFrame([(1, 0, "."), (1, 1, ""), (2, 0, None), (3, 0, "-"), (4, 1, "there ."), (4, 0, "hello")], "r int, segment_id int, text string")
    got = {x.r: x.text for x in pipelines.hybrid(df, ["r"], punctuate=lambda t: t).collect()}
    assert got == {1: T.NO_SPEECH_SHORT, 2: T.NO_SPEECH_SHORT, 3: T.NO_SPEECH_SHORT, 4: "hello there ."}


def test_paragraphs_where_vectors_differ(spark):
    rows = [(1, i, f"This is sentence {i}, which is as long as any other one of them all.", [1.0, 0.0] if i < 4 else [0.0, 1.0]) for i in range(8)]
    df = spark.createDataFrame(rows, "d int, i int, text string, v array<double>")
    got = pipelines.semantic_paragraphs(df, ["d"], "i", "v").first().text.split("\n\n")
    assert [p.count("sentence") for p in got] == [4, 4] and got[1].startswith("This is sentence 4")


def test_stage_statistics(spark):
    df = spark.createDataFrame([(1, "as written here. Yes. Yes. No.", "as written here. Yes. Yes. No.")], "doc_id int, text string, before string")
    out = pipelines.postprocess(df, pipelines.Settings(statistics=True))
    row = pipelines.report(out, "before", "text").first().report.after
    assert row.early_artifacts == {"as written": 1} and row.late_artifacts == {} and row.global_frequency == 0 and row.loop_detection == 1
    assert "early_artifacts" not in pipelines.postprocess(df).columns


def test_unreadable_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"Source: /x\n\na\xffb")
    (tmp_path / "a.txt").write_bytes("c�d".encode())
    got = {r.stem: r.body for r in transcripts.read_transcripts(spark, str(tmp_path)).collect()}
    assert got == {"a": "c�d", "b": "ab"}
    assert [r.path[-5:] for r in files.in_order(files.listing(spark, str(tmp_path))).collect()] == ["a.txt", "b.txt"]


def test_questions_and_answers_of_a_group(spark):
    df = spark.createDataFrame([(1, 0, "Why so?"), (1, 1, "Because."), (2, 0, "No.")], "d int, p int, text string")
    got = {r.d: (r.text, r.n_questions) for r in pipelines.questions(df, ["d"], "p").collect()}
    assert got == {1: ("Q: Why so?\n\nA: Because.", 1), 2: ("No.", 0)}
