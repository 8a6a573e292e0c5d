"""What the first review found missing: each test failed before its finding was settled."""

from __future__ import annotations

import numpy as np
import pytest

from lectern.llm import decontamination, line_dedup
from tests.llm.test_operators import docs, prose


def edited(words, share, rng):
    """The words with a share of them substituted at random places."""
    out = list(words)
    for i in rng.choice(len(out), int(len(out) * share + 1e-9), replace=False):
        out[i] = f"new{rng.integers(1 << 30)}"
    return out


@pytest.mark.parametrize("n", [5, 6, 10, 20, 60, 150])
def test_line_dedup_finds_lines_of_similarity_08(spark, n):
    """Brute force without the SimHash: every pair is similar by its making, no two pairs are."""
    rng = np.random.default_rng(n)
    pairs = [(w := [f"w{n}x{k}x{rng.integers(1 << 30)}" for _ in range(n)], edited(w, 0.2, rng)) for k in range(300)]
    rows = docs(spark, [" ".join(x) for p in pairs for x in p])
    gone = {r.doc_id for r in line_dedup.duplicate_lines(rows).collect()}
    assert all(d % 2 for d in gone) and len(gone) >= 294


def test_decontamination_judges_the_whole_item(spark):
    items = [[f"w{n}x{i}" for i in range(n)] for n in (9, 15, 20, 30, 60)]
    swaps = [(8,), (5, 10), (4, 12, 17), (8, 9, 17, 21, 25, 29), tuple(range(9, 60, 5))]
    texts = [f"a b c {' '.join('other' if i in s else w for i, w in enumerate(x))} d e f" for x, s in zip(items, swaps)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.overlaps(docs(spark, texts), bench).collect()}
    assert {d: (r.item_id, r.matched) for d, r in got.items()} == {k: (k, len(x) - len(s)) for k, (x, s) in enumerate(zip(items, swaps))}
    half = [" ".join(w if i % 2 else "other" for i, w in enumerate(x)) for x in items]
    assert decontamination.overlaps(docs(spark, half), bench).count() == 0
