"""Benchmark decontamination with spaced seeds.

Texts are lower-cased words (runs of letters, marks and digits). A mask such as ``11011011`` hashes
the words under its ones and ignores the others, so a substituted word under a zero does not hide a
copied passage. All windows of all documents are hashed under every mask; a bitmap of fixed size of
the benchmark's hashes, used as a scalar subquery, drops nearly all windows within the scan, and only
the rest joins the benchmark's windows. Hits on one diagonal (document position less item position)
are verified once: on that diagonal the stretch with the highest score (1 for an equal word,
-``penalty`` for a substituted one; of equal scores the longer) is the overlap, or the whole aligned item
if that has more equal words and they are at least ``whole`` of the item's. A document is contaminated by
an item if the overlap has at least ``min_words`` equal words or is such a whole item; a penalty of 4 asks
for a similarity of 0.8.

Benchmark items with equal words are one item, the smallest item_id. Items shorter than the shortest mask
leave no room for substitutions: from five words on they must stand in the document word for word (a mask of
five ones finds them, made only if there are such items), and shorter ones must be all that the document
says. Items without words match nothing. Items shorter than ``min_words`` must be found whole, or, if they
reach a mask, to the share ``whole``.

Defined cases: null texts count as empty and are never contaminated; rows that share doc_id and text
count as one document; null doc_ids can be contaminated; empty tables give an empty result; other
columns are ignored by ``overlaps`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import any_of, bitmap, bitmap_slots, fresh, marked, materialise, small_side

MASKS = ("11011011", "1110010101", "1010011011")
_SHORT = "11111"  # for items shorter than all masks


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(of: Column, at: Column, masks: tuple[str, ...]) -> list[Column]:
    """The hash of the window at a position under each mask; null where the window passes the end."""
    out = []
    for k, mask in enumerate(masks):
        words = [F.get(of, at + i) for i, bit in enumerate(mask) if bit == "1"]
        out.append(F.when(at + len(mask) <= F.size(of), F.xxhash64(F.lit(k), *words)))
    return out


def _starts(of: Column, masks: tuple[str, ...]) -> Column:
    least = min(map(len, masks))
    return F.when(F.size(of) >= least, F.sequence(F.lit(0), F.size(of) - least))


def benchmark_items(benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(item, words): the word hashes of each different item under its smallest id."""
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    return words.groupBy("words").agg(F.min("item_id").alias("item")).select("item", "words")


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", masks: tuple[str, ...] = MASKS, min_words: int = 10, penalty: int = 4, whole: float = 0.8) -> DataFrame:
    """One row per contaminated document and item: doc_id, dk (hash of the text), item_id, and of their
    best overlap doc_start, item_start and n_words in words, matched (equal words), coverage of the item."""
    items = materialise(benchmark_items(benchmark), "items")
    at, reach = F.col("i"), min(map(len, masks))
    if items.filter((F.size("words") >= len(_SHORT)) & (F.size("words") < reach)).head(1):
        masks = (*masks, _SHORT)
    index = items.select("item", "words", F.explode(_starts(F.col("words"), masks)).alias("i"))
    made = [F.when((F.size("words") < reach) | F.lit(mask != _SHORT), w) for w, mask in zip(_windows(F.col("words"), at, masks), masks)]
    index = index.select("item", "i", F.explode(F.array(*made)).alias("h")).filter("h is not null")
    index = materialise(index, "windows")
    slots = bitmap_slots(index.count())
    bits = bitmap(index, slots)

    source = docs.select("doc_id", F.col(text).alias("text")).filter("text is not null").withColumn("dk", F.xxhash64("text"))
    hashed = source.select("doc_id", "dk", word_hashes(F.col("text")).alias("words"))
    placed = hashed.select("doc_id", "dk", "words", F.explode(_starts(F.col("words"), masks)).alias("p"))
    names = [f"h{k}" for k in range(len(masks))]
    windows = placed.select("doc_id", "dk", "p", *(w.alias(n) for w, n in zip(_windows(F.col("words"), F.col("p"), masks), names)))

    likely = windows.filter(any_of([marked(bits, F.col(n), slots) for n in names]))
    hits = likely.select("doc_id", "dk", "p", F.explode(F.array(*names)).alias("h")).join(small_side(index), "h")
    diagonals = hits.select("doc_id", "dk", "item", (F.col("p") - F.col("i")).alias("diagonal")).distinct()
    per_doc = materialise(
        diagonals.groupBy("doc_id", "dk").agg(F.collect_list(F.struct("item", "diagonal")).alias("met")).toDF("m_id", "m_dk", "met"), "met"
    )
    again = source.join(small_side(per_doc, "met"), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("dk") == F.col("m_dk")))
    again = again.select("doc_id", "dk", "met", word_hashes(F.col("text")).alias("words"))
    aligned = again.select("doc_id", "dk", "words", F.explode("met").alias("m")).select("doc_id", "dk", "words", "m.item", "m.diagonal")
    aligned = aligned.join(small_side(items.withColumnRenamed("words", "own"), "own"), "item")
    start = F.greatest(F.lit(0), F.col("diagonal"))
    size = F.least(F.size("words"), F.col("diagonal") + F.size("own")) - start
    same = F.zip_with(F.slice("words", start + 1, size), F.slice("own", start - F.col("diagonal") + 1, size), lambda a, b: a == b)
    found = aligned.select("doc_id", "dk", "item", "diagonal", start.alias("start"), F.size("own").alias("item_words"), same.alias("same"))
    judged = found.withColumn("best", _best_stretch("same", penalty)).withColumn("equal", F.size(F.filter("same", lambda x: x)))
    entire = F.col("equal") >= F.when(F.col("item_words") < reach, F.col("item_words")).otherwise(F.col("item_words") * whole - 1e-9)
    # The whole aligned item, where it holds more than its best stretch does.
    all_of_it = F.struct(F.lit(0).alias("first"), F.size("same").alias("last"), F.col("equal").alias("matched"))
    judged = judged.withColumn("entire", entire).withColumn("best", F.when(entire & (F.col("equal") > F.col("best.matched")), all_of_it).otherwise(F.col("best")))
    scored = judged.select(
        "entire",
        "doc_id", "dk", "item", "item_words", (F.col("start") + F.col("best.first")).alias("doc_start"),
        (F.col("start") + F.col("best.first") - F.col("diagonal")).alias("item_start"), (F.col("best.last") - F.col("best.first")).alias("n_words"),
        F.col("best.matched").alias("matched"),
    )
    leaked = scored.filter(F.col("entire") | (F.col("matched") >= F.least(F.lit(min_words), F.col("item_words"))))
    order = F.struct("matched", -F.col("n_words"), -F.col("doc_start"), -F.col("item_start"))
    best = leaked.groupBy("doc_id", "dk", F.col("item").alias("item_id")).agg(
        *(F.max_by(c, order).alias(c) for c in ("doc_start", "item_start", "n_words", "matched", "item_words"))
    )
    found = best.withColumn("coverage", F.col("matched") / F.col("item_words")).drop("item_words")
    # Documents of a few words that say just what an item says.
    tiny = hashed.filter(F.size("words").between(1, len(_SHORT) - 1)).join(small_side(items.filter(F.size("words") < len(_SHORT))), "words")
    n = F.size("words")
    said = tiny.select("doc_id", "dk", F.col("item").alias("item_id"), F.lit(0).alias("doc_start"), F.lit(0).alias("item_start"), n.alias("n_words"), n.alias("matched"), F.lit(1.0).alias("coverage"))
    return found.unionByName(said.distinct())


def _best_stretch(same: str, penalty: int) -> Column:
    """The stretch of the array of booleans with the highest score: first, last (exclusive), matched."""
    zero = "named_struct('i', 0, 'score', 0, 'since', 0, 'hits', 0, 'top', 0, 'first', 0, 'last', 0, 'matched', 0)"
    gain = f"if(x, 1, -{penalty})"
    begin = "a.score < 0"
    score = f"if({begin}, 0, a.score) + {gain}"
    since = f"if({begin}, a.i, a.since)"
    hits = f"if({begin}, 0, a.hits) + if(x, 1, 0)"
    longer = f"{score} = a.top and {score} > 0 and a.i + 1 - {since} > a.last - a.first"
    better = f"({score} > a.top or ({longer}))"
    step = (
        f"named_struct('i', a.i + 1, 'score', {score}, 'since', {since}, 'hits', {hits}, 'top', greatest(a.top, {score}), "
        f"'first', if({better}, {since}, a.first), 'last', if({better}, a.i + 1, a.last), 'matched', if({better}, {hits}, a.matched))"
    )
    return F.expr(f"aggregate({same}, {zero}, (a, x) -> {step}, a -> named_struct('first', a.first, 'last', a.last, 'matched', a.matched))")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs without contaminated documents."""
    g_id, g_dk = fresh(docs, "leak_id", "leak_dk")
    gone = materialise(overlaps(docs, benchmark, text, **how).select(F.col("doc_id").alias(g_id), F.col("dk").alias(g_dk)).distinct(), "contaminated")
    return docs.join(small_side(gone), F.col("doc_id").eqNullSafe(F.col(g_id)) & (F.xxhash64(text) == F.col(g_dk)), "left_anti")


def query(spark, sf_dir):
    from .common import table

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("dk")
