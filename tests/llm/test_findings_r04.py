"""What the check of round 3 found in line dedup: shuffle grew faster than the input, each line had many keys and each copy its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.llm import line_dedup
from tests.llm.test_operators import docs, prose


def test_long_lines_have_few_keys_and_copies_none_of_their_own(spark):
    """12 keys for each copy of each line before."""
    found = line_dedup.materialise(line_dedup.lines(docs(spark, [prose(60, k % 5) for k in range(15)])), "lines")
    repeats, classes, once = line_dedup._once(found)
    assert (repeats.count(), classes.count(), once.count()) == (15, 5, 5)
    assert {r.doc_id for r in once.collect()} == set(range(5))
    assert {len(r.met) for r in line_dedup.line_sketches(once, 12).collect()} == {7}


def test_lines_of_both_kinds_of_keys_meet(spark):
    """Lines of up to 14 words meet by threes, those of more than 17 by twos; what lies between meets both."""
    texts = []
    for k in range(20):
        words = prose(23, 300 + k).split()
        texts += [" ".join(words[:n]) for n in (14, 17, 20, 23)]
    assert {r.doc_id for r in line_dedup.duplicate_lines(docs(spark, texts)).collect()} == {d for d in range(80) if d % 4}


def test_meetings_are_the_pairs_of_a_join(spark):
    texts = [f"{prose(8 + k % 3, 400 + k // 6)} {prose(1 + k % 2, 500 + k)}" for k in range(60)]
    sketches = line_dedup.materialise(line_dedup.line_sketches(line_dedup.line_classes(line_dedup.lines(docs(spark, texts))), 12), "sketches")
    keys = line_dedup.shared_keys(sketches, 2)
    for crowd in (3, 64):
        few = keys.filter(F.col("n") <= crowd)
        joined = line_dedup._near(line_dedup._side(few, "a"), line_dedup._side(few, "b"), 64, 0.8).select("a", "b").collect()
        met = [k for j in range(2) for k in line_dedup._meetings(sketches, 0.8, crowd, 64, j, 2).collect()]
        assert sorted((r.a, r.h1) for r in met if r.a is not None) == sorted((r.a, r.b) for r in joined) and joined
        assert sorted((r.key, r.h1) for r in met if r.a is None) == sorted((r.key, r.h1) for r in keys.filter(F.col("n") > crowd).collect())


def test_words_longer_than_six_bits_of_bytes(spark):
    """Lengths count by their lowest six bits; nothing overflows."""
    words = [f"{'a' * (3000 + 63 * k)}{k}" for k in range(40)]
    texts = [" ".join(words[:n]) for n in (12, 14, 38, 40)]
    assert {r.doc_id for r in line_dedup.duplicate_lines(docs(spark, texts)).collect()} == {1, 3}
