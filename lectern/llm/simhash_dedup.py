"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: 64 bits over shingles of words; XXH64 (seed 42) of each shingle votes for each bit.
Two fingerprints link when they differ in at most ``max_bits`` bits.

Pigeonring: the 64 bits are m = max_bits + 1 segments on a ring. If at most k bits differ in all,
some segment starts a chain in which, for every length l, the first l segments differ in at most
l * k / m bits. For k = 3, m = 4 the budgets are 0, 1, 2 and 3 bits. A pair is therefore met by
joining on an equal segment together with the next segment, where one bit may differ (one side lists
its 17 variants); the remaining budgets of the chain prune before the full Hamming check.

Documents of equal fingerprint form one class before any join, so copies are never expanded into
pairs. Only fingerprints and ids are shuffled, never texts.

With ``similarity`` texts link, too, if their sets of shingles have that Jaccard similarity. At 0.8 some 10
of 64 bits differ, too many for segments to tell pairs apart, so such pairs meet elsewhere: on one of
``BANDS`` keys, each of ``ROWS`` least values of the shingles' hashes under that many multipliers (0.9996 of
pairs at 0.8 share a key). Pairs that meet pass the Hamming check at ``wide_bits`` bits, then the shingles
themselves are compared. Keys with more than ``crowd`` classes are first linked to one of their own; classes
of such a key that this leaves in different groups meet again where they share a second key (0.996 of pairs
at 0.8), and what is in different groups even then is compared with all others of its key. So a crowd of near
copies does not yield all its pairs, and no pair of different groups is left out.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like
any other; repeated rows share a class; rows with a null doc_id get a fingerprint and the component
of the documents they equal, null if there is none; an empty table gives an empty result; extra
columns are ignored by ``fingerprints`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, materialise, shuffled, small_side
from .components import components

_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 16


BANDS, ROWS = 20, 5
_MULTIPLIERS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, words: int = 3) -> Iterator[np.ndarray]:
    """The XXH64 hashes (seed 42) of all shingles of a whole text, repeats included, in chunks."""
    from xxhash import xxh64_intdigest

    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    tokens = raw.split()  # bytes.split() knows exactly the six ASCII spaces of _SPACE
    if not tokens:
        return
    line = b" ".join(tokens)
    if len(tokens) <= words:
        yield np.array([xxh64_intdigest(line, 42)], "<u8")
        return
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    n = len(tokens) - words + 1
    for at in range(0, n, _CHUNK):  # bounded memory for very long texts
        top = min(n, at + _CHUNK)
        begin = [int(ends[at - 1]) if at else 0, *ends[at:top - 1].tolist()]
        end = (ends[at + words - 1:top + words - 1] - 1).tolist()
        yield np.fromiter((xxh64_intdigest(line[s:e], 42) for s, e in zip(begin, end)), "<u8", top - at)


def sketch(text: str | None, words: int = 3, bands: int = 0) -> tuple[int, list[int]]:
    """The unsigned 64-bit SimHash of a whole text, and its band keys as signed longs."""
    from xxhash import xxh64_intdigest

    votes, n = np.zeros(64, np.int64), 0
    least = np.full(bands * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for h in shingle_hashes(text, words):
        n += len(h)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        for at in range(0, len(h) if bands else 0, 2048):
            least = np.minimum(least, (h[at:at + 2048, None] * _MULTIPLIERS[None, :bands * ROWS]).min(axis=0))
    fp = int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0]) if n else 0
    keys = [xxh64_intdigest(least[i * ROWS:(i + 1) * ROWS].tobytes(), i) for i in range(bands if n else 0)]
    return fp, [k - 2**64 if k >= 2**63 else k for k in keys]


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    return sketch(text, words)[0]


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, bands: int = 0) -> DataFrame:
    """(doc_id, dk, fp, bands): dk is a hash of the text, fp the fingerprint as a signed long."""

    def batches(it):
        for b in it:
            seen = [sketch(t.as_py(), words, bands) for t in b.column(2)]
            fps = np.fromiter((s[0] for s in seen), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fps.view(np.int64)), pa.array([s[1] for s in seen], pa.list_(pa.int64()))], ["doc_id", "dk", "fp", "bands"]
            )

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("dk"), F.col(text).cast("string").alias("text"))
    return bounded_batches(asked).mapInArrow(batches, "doc_id long, dk long, fp long, bands array<long>")


def _segments(k: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of k + 1 segments."""
    m = k + 1
    at = [64 * i // m for i in range(m + 1)]
    return [(at[i], at[i + 1] - at[i]) for i in range(m)]


def _segment(fp: Column, seg: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, seg[0]).bitwiseAND(F.lit((1 << seg[1]) - 1))


def _key(i: int, segs: list, fp: Column, flip: Column | None = None) -> Column:
    """Segment i and the next one of the ring, with one bit of the next flipped, as one number."""
    m = len(segs)
    after = _segment(fp, segs[(i + 1) % m])
    if flip is not None:
        after = after.bitwiseXOR(flip)
    return F.xxhash64(F.lit(i), _segment(fp, segs[i]), after)


def links(classes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b) of different fingerprints in classes (fp) that differ in at most max_bits bits."""
    segs = _segments(max_bits)
    m = len(segs)
    fp = F.col("fp")
    if max_bits == 0:
        return classes.select(fp.alias("a"), fp.alias("b")).limit(0)

    def budget(x: Column, i: int) -> Column:
        """All prefixes of the chain that starts at segment i stay within their budgets."""
        total, ok = F.lit(0), F.lit(True)
        for l in range(1, m + 1):
            total = total + F.bit_count(_segment(x, segs[(i + l - 1) % m]))
            ok = ok & (total <= l * max_bits // m)
        return ok

    # Budgets of chains of two are 0 and 1 for every k >= 1 with m = k + 1 segments; k = 1 has m = 2.
    flips = [F.array(F.lit(0).cast("long"), *(F.lit(1 << j).cast("long") for j in range(segs[(i + 1) % m][1]))) for i in range(m)]
    exact = F.array(*(F.struct(F.lit(i).alias("i"), _key(i, segs, fp).alias("key")) for i in range(m)))

    def variants(i: int) -> Column:
        return F.transform(flips[i], lambda flip: F.struct(F.lit(i).alias("i"), _key(i, segs, fp, flip).alias("key")))

    varied = F.concat(*(variants(i) for i in range(m)))
    left = classes.select(fp.alias("a"), F.explode(exact).alias("e")).select("a", "e.i", "e.key")
    right = classes.select(fp.alias("b"), F.explode(varied).alias("e")).select("b", F.col("e.i").alias("j"), F.col("e.key").alias("other"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(False)
    for i in range(m):
        chain = chain | ((F.col("i") == i) & budget(x, i))
    met = left.join(shuffled(right), (F.col("key") == F.col("other")) & (F.col("i") == F.col("j")) & (F.col("a") < F.col("b")) & chain & (F.bit_count(x) <= max_bits))
    return met.select("a", "b")


def _side(keys: DataFrame, x: str) -> DataFrame:
    return keys.select("key", *(F.col(c).alias(f"{x}_{c}") for c in keys.columns if c != "key"))


def _met(a: DataFrame, b: DataFrame, wide_bits: int, also: Column | None = None) -> DataFrame:
    near = (F.col("a_ck") < F.col("b_ck")) & (F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= wide_bits)
    return _side(a, "a").join(_side(b, "b"), "key").filter(near if also is None else near & also).select(F.col("a_ck").alias("a"), F.col("b_ck").alias("b"))


def _similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose first texts share that part of their shingles."""
    wanted = materialise(pairs.select(F.explode_outer(F.array("a", "b")).alias("ck")).distinct().join(shuffled(classes.select("ck", "first.*")), "ck"), "near-wanted")
    source = docs.select(F.col("doc_id").cast("long").alias("d_id"), F.col(text).cast("string").alias("text")).withColumn("d_dk", F.xxhash64("text"))
    texts = source.join(small_side(wanted), F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_dk") == F.col("dk"))).select("ck", "text")

    def sets(it):
        for b in it:
            found = [np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(t.as_py(), words)])).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["ck", "shingles"])

    # Repeated rows of a first document repeat its class; links are made distinct before they are used.
    shingles = materialise(bounded_batches(texts).mapInArrow(sets, "ck long, shingles binary"), "near-shingles")
    both = pairs
    for x in "ab":
        both = both.join(shuffled(shingles.select(F.col("ck").alias(x), F.col("shingles").alias(f"s_{x}"))), x)

    def judged(it):
        for b in it:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_py(), "<u8") for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "s_a", "s_b").mapInArrow(judged, "a long, b long")


def _wide_links(classes: DataFrame, docs: DataFrame, text: str, words: int, similarity: float, wide_bits: int, crowd: int) -> DataFrame:
    """Pairs (a, b) of classes (ck, fp, bands, first) with similar shingles, enough of them to connect all that are."""
    met = classes.select("ck", "fp", F.explode("bands").alias("key")).withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    keys = materialise(met, "near-keys")
    few, many = keys.filter(F.col("n") <= crowd).drop("n"), keys.filter(F.col("n") > crowd).drop("n")
    centres = many.groupBy("key").agg(F.min(F.struct("ck", "fp")).alias("c")).select("key", "c.*")
    pairs = materialise(_met(few, few, wide_bits).unionByName(_met(centres, many, wide_bits)).distinct(), "near-pairs")
    found = materialise(_similar(pairs, classes, docs, text, words, similarity), "near-links")
    if not many.head(1):
        return found
    for whole in (False, True):
        roots = components(found).withColumnRenamed("node", "ck")
        grouped = materialise(many.join(roots, "ck", "left").select("key", "ck", "fp", F.coalesce("root", "ck").alias("group")), "near-crowds")
        mixed = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("key")
        again = materialise(grouped.join(mixed, "key"), "near-open")
        if not again.head(1):
            break
        if not whole:
            open_ = again.join(keys.select("ck", F.col("key").alias("other")), "ck").filter("key <> other")
            again = open_.select(F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key"), "ck", "fp", "group").distinct()
        between = _met(again, again, wide_bits, F.col("a_group") != F.col("b_group")).distinct().join(pairs, ["a", "b"], "left_anti")
        between = materialise(between, "near-pairs")
        found = materialise(found.unionByName(_similar(between, classes, docs, text, words, similarity)), "near-links")
        pairs = pairs.unionByName(between)
    return found


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 3, max_bits: int = 3, similarity: float | None = None, wide_bits: int = 24, crowd: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    prints = fingerprints(docs, text, words, BANDS if similarity else 0)
    prints = materialise(prints.withColumn("ck", F.xxhash64("fp", "bands") if similarity else F.col("fp")), "fingerprints")
    per = ["ck", "fp", "bands"] if similarity else ["ck", "fp"]
    classes = materialise(prints.groupBy(*per).agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "dk")).alias("first")), "classes")
    near = links(classes.select("fp").distinct() if similarity else classes.select("fp"), max_bits)
    if similarity:
        # Classes of one fingerprint hang on the least of them, which stands for the fingerprint.
        heads = materialise(classes.groupBy("fp").agg(F.min("ck").alias("head")), "heads")
        a, b = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in "ab")
        near = near.join(a, "a").join(b, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
        near = near.unionByName(classes.join(heads, "fp").filter("ck <> head").select(F.col("ck").alias("a"), F.col("head").alias("b")))
        near = near.unionByName(_wide_links(classes, docs, text, words, similarity, wide_bits, crowd))
    roots = components(near)
    # A component's id is its smallest document, so the classes of one root are reduced once more.
    rooted = classes.join(roots.withColumnRenamed("node", "ck"), "ck", "left").select("ck", "least", F.coalesce("root", "ck").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("ck", "component_id")
    return prints.join(named, "ck").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", words: int = 3, max_bits: int = 3, similarity: float | None = None) -> DataFrame:
    """docs without the documents that are not the first of their component.

    Rows that repeat a kept doc_id stay; rows with a null doc_id stay.
    """
    dropped, = fresh(docs, "dropped_id")
    gone = near_duplicates(docs, text, words, max_bits, similarity).filter("doc_id <> component_id").select(F.col("doc_id").alias(dropped)).distinct()
    return docs.join(small_side(materialise(gone, "near-copies")), F.col("doc_id") == F.col(dropped), "left_anti")


def query(spark, sf_dir):
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
