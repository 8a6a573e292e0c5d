from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.operators import segments as G
from lectern.sources import files
from lectern.streaming import windows


def frame(spark, rows):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in rows], "g int, start double, end double")


def spans(df):
    return [(r.start, r.end) for r in df.orderBy("start", "end").collect()]


def test_merge(spark):
    assert spans(G.merge_intervals(frame(spark, [(0, 1), (1.2, 2), (5, 6)]), ["g"], 0.3)) == [(0, 2), (5, 6)]
    assert spans(G.merge_intervals(frame(spark, [(0, 10), (1, 2), (9, 12)]), ["g"], 0)) == [(0, 12)]


def test_merge_is_idempotent(spark):
    once = G.merge_intervals(frame(spark, [(i * 0.7, i * 0.7 + i % 3) for i in range(50)]), ["g"], 0.2).drop("n")
    assert spans(G.merge_intervals(once, ["g"], 0.2)) == spans(once)


def test_minimum_duration(spark):
    assert spans(G.standard_segments(frame(spark, [(0, 0.4), (1, 2)]), ["g"])) == [(1, 2)]


def test_overflow_pairs_the_shortest(spark):
    got = spans(G.standard_segments(frame(spark, [(0, 1), (10, 12), (20, 23), (30, 34)]), ["g"], 0.5, 5.0, 2, "pair_shortest"))
    assert got == [(0, 12), (20, 23), (30, 34)]


@pytest.mark.parametrize("duration, expected", [(30.5, [(0, 30)]), (0.5, []), (61.0, [(0, 30), (30, 60), (60, 61)])])
def test_tumbling(spark, duration, expected):
    assert spans(G.tumbling(spark.createDataFrame([(duration,)], "d double"), "d")) == expected


def test_sliding(spark):
    assert [a for a, _ in spans(G.sliding(spark.createDataFrame([(60.0,)], "d double"), "d"))] == [0, 25, 50]


def test_edges_are_padded_and_clamped(spark):
    df = spark.range(60).select(F.lit(1).alias("g"), "id", F.col("id").between(4, 29).alias("s"))
    (a, b), = spans(G.speech_edges(df, ["g"], "id", "s"))
    assert a == 0 and b == pytest.approx(1.2)


def test_longest_and_order_faults(spark):
    df = frame(spark, [(0, 1), (2, 9), (3, 4), (20, 30)])
    assert spans(G.longest(df, ["g"], 2)) == [(2, 9), (20, 30)]
    assert spans(G.order_faults(df, ["g"], 5.0)) == [(3, 4)]


def test_merge_by_flags(spark):
    df = spark.createDataFrame([(1, 0, "a", False), (1, 1, "b.", True), (1, 2, "c", False)], "g int, o int, text string, f boolean")
    assert [r.text for r in G.merge_by_flags(df, ["g"], "o", "f").orderBy("sentence_no").collect()] == ["a b.", "c."]


def test_batch_selection(spark):
    inputs = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    outputs = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-03-01")], "stem string, m string").select("stem", F.to_timestamp("m").alias("mtime"))

    def kept(*how):
        return sorted(r.stem for r in files.to_process(inputs, outputs, *how).collect())

    assert kept() == ["c"] and kept("all") == ["a", "b", "c"] and kept("before", "2024-02-01") == ["a", "c"] and kept("before", "soon") == ["a", "b", "c"]


def test_listing(spark, tmp_path):
    for name in ("x.mp3", "y.txt", "sub/z.WAV"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("1")
    found = files.media(files.listing(spark, str(tmp_path)))
    assert sorted(r.ext for r in found.collect()) == [".mp3", ".wav"]


def test_streaming_windows(spark, tmp_path):
    rows = spark.createDataFrame([(1, s) for s in (0, 10, 40, 5000)], "u int, s long").select("u", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, f, n in (("tumbled", windows.tumbling_counts, 3), ("slid", windows.sliding_counts, 4), ("sessions", windows.session_counts, 2)):
        q = f(stream, "ts", ["u"]).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table(name).count() >= n
