"""Fuzzy line de-duplication: shingles, edit similarity, connected groups.

A line is normalised (lower case, runs of anything but letters, marks and digits become one space). Lines
without any of these take no part. Equal normalised lines form a class, however short. Classes of lines of
at least ``min_words`` words (shorter ones differ by a fifth or more with one word) also link if their words
have an edit similarity (1 - distance / longer length, in words) of at least ``similarity``. For that, each
word is first one of 983,040 letters; pairs that pass are compared word by word if two of their words, told apart by 64 bits, have one letter. Of each
connected group the first line, by document, then by position, stays; all others are removed.

Candidates: n words with at most 0.2 n edits keep a run of at least ceil(0.8 n / (0.2 n + 1)) words, which
is three or more for all lines but those of five words, where the word in the middle may differ. So classes
of up to shingles + 2 words meet on all their shingles of three words, those of five words also on all but the middle
one. Longer lines meet on seven shingles of two words: those of most bytes are taken, equal ones by hash, a choice
that both lines make alike, and of shingles that few other lines have, as long words are rare. Shingles of the common
words grow with the square of the input; these do not. Lines that are longer, but can be similar to a line of shingles
+ 2 words, have their longest shingles of three words too. Of two shingled by two words, pairs share three in seven, and
miss each other with a chance of at most (4 / 7) ** 7 (0.02), less for edits that stand together. Lengths that rule the similarity out are dropped within the join; so are pairs whose words
differ too much, whatever their order: of a bit for each word, turned over for each time it occurs, an edit
changes two at most. Keys with more than ``crowd`` classes are first linked to the shortest of each band of lengths, then to
others of it; what that leaves outside a key's main group is then joined with all the rest of the key, so no link
between groups is lost, and a crowd of near copies does not yield all its pairs.

Only one row of each class is sketched. Keys that two rows share are found from the keys alone; only their rows get anything
else, and of each key a row meets those before it, without a join. With ``slices``
keys are dealt by their lowest bits, and one slice after another is grouped and joined; pairs get their texts in
slices of at most some millions. What a slice has shuffled goes before the next.

Lines are normalised once and written. Their shingles are made once by a step of their own that shuffles nothing,
and go once keys are found. Lines that pairs or crowds need are then written apart and the others go. Texts are
shuffled only for the lines that pairs need; later steps never go back to the documents. Removals are applied by a join that is broadcast only below a checked number of rows.

Defined cases: a null text stays null; a text keeps its empty lines and its line order; a text all of
whose lines go becomes empty; rows that share doc_id and text count as one document and get the same
text; null doc_ids come first in order; an empty table gives an empty result; other columns are kept,
and ``n_chars``, if present, is recomputed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regexes import let
from .common import bitmap, bitmap_slots, discard, fresh, marked, materialise, release, shuffled, small_side
from .components import components

_PAIRS = 4_000_000  # of more, the pairs of a slice
_SLOW = 200  # words of a line whose comparison is first tried with a quarter of its bound
_FEW = 1_000_000  # pairs up to which all get their texts at once
_TEXT_SLICES = 4  # of pairs whose texts are joined at once, if there are more
_PICKS = 2  # classes of each key and band that a crowd meets before all that are still in different groups meet
_WIDE = [f"odd{q}" for q in range(4)]
_PAIRED = 7  # shingles of two words of a line that is too long to meet on all its shingles of three


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}\p{N}]+", " "))


def _odd(hashes: str) -> Column:
    """A bit is 1 if an odd number of the words have it: an edit changes one or, as a substitution, two bits.
    Of a shift the lowest six bits count."""
    return F.expr(f"aggregate({hashes}, 0L, (bits, h) -> bits ^ shiftleft(1L, cast(shiftrightunsigned(h, 34) as int)))")


def _odd_wide(hashes: str) -> list[Column]:
    """As _odd, but of 256 bits, which tells longer lines apart too."""
    one = "bits ^ shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))"
    return [F.expr(f"aggregate({hashes}, 0L, (bits, h) -> if((shiftrightunsigned(h, 56) & 3) = {q}, {one}, bits))").alias(f"odd{q}") for q in range(4)]


def _word(word: Column) -> Column:
    """53 bits of a word's hash below the lowest six bits of its length in bytes, negative: three of these add up without an overflow."""
    return F.bitwise_not(F.shiftleft(F.octet_length(word).bitwiseAND(F.lit(63)).cast("long"), 55).bitwiseOR(F.shiftrightunsigned(F.xxhash64(word), 11)))


def _shingles(most: int, similarity: float) -> Column:
    """Of hs, sums of three words next to each other, at most so many, the longest first, in lines of up to most + 2 words and in those
    that can be similar to one of these; of lines of more than most + 2 words, _PAIRED sums of two as well. Of five words, all but the middle one as well (four words are what a line of five can lose to)."""

    def around(*at: int) -> Column:
        return F.array(F.xxhash64(*(F.get("hs", F.lit(i)) for i in at)))

    # Spark sorts an array of numbers without nulls, rising, at a fraction of the time of any other; zeros are what the end lacks.
    def sums(third: str) -> Column:
        return F.expr(f"sort_array(transform(hs, (x, i) -> coalesce(x + get(hs, i + 1){third}, 0L)))")

    none = F.array().cast("array<bigint>")
    two = F.when(F.size("hs") > most + 2, F.slice(F.array_distinct(sums("")), 1, _PAIRED)).otherwise(none)
    three = F.when(F.size("hs") <= (most + 2) / similarity + 1e-9, F.slice(F.array_distinct(sums(" + get(hs, i + 2)")), 1, most)).otherwise(none)
    split = F.when(F.size("hs") == 5, around(0, 1, 3, 4)).when(F.size("hs") == 4, around(0, 1, 2, 3)).otherwise(none)
    return F.concat(F.array_remove(F.concat(two, three), F.lit(0).cast("long")), split)


def lines(docs: DataFrame, text: str = "text", min_words: int = 5) -> DataFrame:
    """One row per line that takes part: doc_id, dk (hash of the text), pos, h1, h2, norm (of min_words words at least, else null)."""
    norms = docs.select("doc_id", F.col(text).alias("text")).filter("text is not null").select(
        "doc_id", F.xxhash64("text").alias("dk"),
        # Not posexplode: Spark would filter its empty arrays, and make every array twice for that.
        F.posexplode_outer(F.transform(F.split("text", "\n"), normalised)).alias("pos", "norm"),
    ).filter("norm <> ''")
    long = F.substring_index("norm", " ", min_words - 1) != F.col("norm")
    return norms.select("doc_id", "dk", "pos", F.xxhash64("norm").alias("h1"), F.xxhash64("norm", F.lit(1)).alias("h2"), F.when(long, F.col("norm")).alias("norm"))


def line_classes(found: DataFrame) -> DataFrame:
    """(h1, h2, copies, first) of each class, and norm if found has it."""
    norm = [c for c in found.columns if c == "norm"]
    per = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "dk", "pos", *norm)).alias("f"), F.count("*").alias("copies"))
    return per.select("h1", "h2", "copies", F.struct("f.doc_id", "f.dk", "f.pos").alias("first"), *(F.col(f"f.{c}").alias(c) for c in norm))


def line_sketches(found: DataFrame, shingles: int, similarity: float = 0.8) -> DataFrame:
    """(h1, words, met (shingles), odd) of the lines or classes that have a norm."""
    hashed = found.filter("norm is not null").select("h1", F.transform(F.split("norm", " "), _word).alias("hs"))
    return hashed.select("h1", F.size("hs").alias("words"), _shingles(shingles, similarity).alias("met"), _odd("hs").alias("odd"))


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _can_be(bits: Column, similarity: float) -> Column:
    """Whether lines whose words differ in so many bits of _odd can be similar. Of d edits, each changes two bits
    at most, and those that make up the difference in length, one."""
    edits = F.floor(F.greatest("words_a", "words_b") * (1 - similarity) + 1e-9)
    return bits + F.abs(F.col("words_a") - F.col("words_b")) <= 2 * edits


def _by_bits(similarity: float) -> Column:
    """Whether two rows can be similar by their lengths and by what their words differ in."""
    return (F.least("words_a", "words_b") >= F.greatest("words_a", "words_b") * similarity - 1e-9) & _can_be(_differ("odd_a", "odd_b"), similarity)


def _near(a: DataFrame, b: DataFrame, gate_bits: int, similarity: float, also: Column | None = None, ordered: bool = True) -> DataFrame:
    """(a, b, times) of the rows that share a key, differ in at most gate_bits bits of _odd (of 64) and can be similar by their words.
    ordered: of two rows that are on both sides, a is the lesser. Rows that have all their keys meet at the least
    shared one only, with the number of these; rows of _by_length meet in a band of lengths."""
    on = [c for c in ("key", "at") if c in a.columns]
    near = F.col("a") < F.col("b") if ordered else F.col("a") != F.col("b")
    near = near | F.col("main_b") if "main_b" in b.columns else near | (F.col("at") != F.col("band_a")) if "at" in on else near
    near = near if gate_bits >= 64 else near & (_differ("odd_a", "odd_b") <= gate_bits)
    near = near & _by_bits(similarity)
    near = near if also is None else near & also
    times = F.lit(1)
    if "keys_a" in a.columns:
        shared = F.array_intersect("keys_a", "keys_b")
        near, times = near & (F.col("key") == F.array_min(shared)), F.size(shared)
    return a.join(b, on).filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), times.alias("times"))


def _band(similarity: float) -> Column:
    """Lengths that can be similar are in one band or in two next to each other."""
    return F.floor(F.log(F.col("words").cast("double")) / F.log(F.lit(1 / similarity))).cast("int")


def _centres(many: DataFrame, similarity: float) -> DataFrame:
    """Of each key, the shortest class of each band of lengths: what a crowd shares is the greater part of these."""
    return many.groupBy("key", _band(similarity).alias("band")).agg(F.min(F.struct("words", "h1", "odd")).alias("c")).select("key", "c.*")


def _picked(grouped: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Of each key and band of lengths, one class by hash, another one for each turn."""
    columns = [c for c in grouped.columns if c not in ("key", "keys")]
    least = F.min(F.struct(F.xxhash64("h1", F.lit(turn)).alias("order"), *columns)).alias("c")
    return grouped.groupBy("key", _band(similarity).alias("in_band")).agg(least).select("key", *(F.col(f"c.{c}").alias(c) for c in columns))


def _with_main(grouped: DataFrame, moved: DataFrame) -> DataFrame:
    """grouped by the groups of now (moved: those that were joined to another), with main: whether a row's group has most rows of its key; keys of one group only go."""
    grouped = grouped.join(small_side(moved), "group", "left").withColumn("group", F.coalesce("moved", "group")).drop("moved")
    most = grouped.groupBy("key", "group").count().groupBy("key").agg(F.max_by("group", "count").alias("most"), F.count("*").alias("groups")).filter("groups > 1")
    return materialise(grouped.join(shuffled(most), "key").withColumn("main", F.col("group") == F.col("most")).drop("most", "groups"), "line-grouped")


def _by_length(rows: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Two sides for _near: rows at their own band and the one above, and at their own; rows of one band meet in order.
    Of rows with main, those outside their key's main group meet all others, at their own band and both beside it."""
    banded = rows.withColumn("band", _band(similarity))
    if "main" in rows.columns:
        a = banded.filter("not main").withColumn("at", F.explode_outer(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
        return _side(a, "a"), _side(banded.withColumn("at", F.col("band")), "b")
    return _side(banded.withColumn("at", F.explode_outer(F.array("band", F.col("band") + 1))), "a"), _side(banded.withColumn("at", F.col("band")), "b")


def _of_shared_keys(sketches: DataFrame, slice_: int, slices: int) -> tuple[DataFrame, DataFrame]:
    """(h1, words, odd, key) of the keys that two rows share, and of a few others, each once, rows of a key in one place; what that reads."""
    own = F.filter(F.col("met"), lambda k: k.bitwiseAND(F.lit(slices - 1).cast("long")) == slice_) if slices > 1 else F.col("met")
    every = sketches.select("h1", "words", "odd", F.explode_outer(own).alias("key")).filter("key is not null")
    common = materialise(every.groupBy("key").count().filter("count > 1").select("key"), "line-common")
    slots = bitmap_slots(common.count())
    met = every.filter(marked(bitmap(common.select(F.col("key").alias("h")), slots), F.col("key"), slots))
    return met.repartition("key").groupBy("key", "h1").agg(F.first("words").alias("words"), F.first("odd").alias("odd")), common


def shared_keys(sketches: DataFrame, max_bits: int, slice_: int = 0, slices: int = 1) -> DataFrame:
    """(h1, words, odd, key, n) of the keys that n > 1 classes share; of so many slices of the keys, one; written.
    max_bits has no effect: no pair is left to meet by SimHash."""
    met, common = _of_shared_keys(sketches, slice_, slices)
    out = materialise(met.select("h1", "words", "odd", "key", F.count("*").over(Window.partitionBy("key")).alias("n")).filter("n > 1"), "line-keys")
    discard(common)
    return out


def _meetings(sketches: DataFrame, similarity: float, crowd: int, gate_bits: int, slice_: int, slices: int) -> DataFrame:
    """Rows of shared_keys in one pass: those of keys with at most crowd classes become pairs that can be similar (a < h1), those of
    others stay as they are (a is null). A row of a key has the rows before it, so no join is needed; written."""
    met, common = _of_shared_keys(sketches, slice_, slices)
    by = Window.partitionBy("key").orderBy("h1")
    n = F.count("*").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.collect_list(F.struct("h1", "words", "odd")).over(by.rowsBetween(-crowd, -1))
    met = met.select("key", "h1", "words", "odd", n.alias("n"), before.alias("before")).filter("n > 1")
    met = met.withColumn("before", F.explode_outer(F.when(F.col("n") <= crowd, F.col("before"))))
    met = met.select("key", "h1", "words", "odd", "n", *(F.col(f"before.{c}").alias(x) for c, x in (("h1", "a"), ("words", "words_a"), ("odd", "odd_a"))), F.col("words").alias("words_b"), F.col("odd").alias("odd_b"))
    near = F.col("a").isNotNull() & _by_bits(similarity)
    near = near if gate_bits >= 64 else near & (_differ("odd_a", "odd_b") <= gate_bits)
    out = materialise(met.filter((F.col("n") > crowd) | near).select("key", "h1", "words", "odd", "a"), "line-keys")
    discard(common)
    return out


def _side(keys: DataFrame, x: str) -> DataFrame:
    return keys.select("key", *(c for c in keys.columns if c == "at"), F.col("h1").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in keys.columns if c in ("words", "odd", "group", "keys", "band", "main", *_WIDE)))


def _place() -> Column:
    return F.struct("doc_id", "dk", "pos")


def _code(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(0xF0000).cast("long"))


def _letters(norm: Column) -> Column:
    """One letter for each word, of the 983,040 of four bytes whose numbers have five digits."""
    codes = F.transform(F.split(norm, " "), lambda w: F.hex(_code(w) + 0x10000))
    return F.decode(F.unhex(F.concat(F.lit("000"), F.array_join(codes, "000"))), "UTF-32")


def _marks(norm: Column) -> Column:
    """The different words of a line: 44 bits of each one's hash before the 20 of its letter."""
    return F.array_distinct(F.transform(F.split(norm, " "), lambda w: F.xxhash64(w).bitwiseAND(F.lit(~0xFFFFF).cast("long")).bitwiseOR(_code(w).cast("long"))))


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode_outer(F.array("a", "b")).alias("h1"))


def _wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted rows (h1, written) and a few others: nearly all others go before anything is shuffled."""
    slots = bitmap_slots(wanted.count())
    return rows.filter(marked(bitmap(wanted.select(F.col("h1").alias("h")), slots), F.col("h1"), slots))


def _texts(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, first, norm, letters, marks, words) of the classes that are wanted (h1)."""
    wanted = materialise(wanted.distinct(), "line-wanted")
    own = _wanted(found.filter("norm is not null"), wanted).join(small_side(wanted), "h1")
    texts = line_classes(own).select("h1", "first", "norm", _letters(F.col("norm")).alias("letters"), _marks(F.col("norm")).alias("marks"))
    texts = materialise(texts.withColumn("words", F.length("letters")), "line-texts", "zstd")
    discard(wanted)
    return texts


def _crowded(found: DataFrame, many: DataFrame, roots: DataFrame) -> DataFrame:
    """(h1, group, 256 bits of _odd_wide, keys) of the classes that have crowded keys (h1, key); written. Texts become
    bits before anything is shuffled."""
    own = materialise(many.groupBy("h1").agg(F.collect_set("key").alias("keys")), "line-crowded")
    hashed = _wanted(found.filter("norm is not null"), own).select("h1", _place().alias("place"), F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)).alias("hs"))
    wide = hashed.select("h1", "place", *_odd_wide("hs")).groupBy("h1", *_WIDE).agg(F.min("place").alias("first")).join(shuffled(own), "h1")
    groups = wide.join(roots, F.col("first") == F.col("node"), "left").select("h1", F.coalesce("root", "first").alias("group"), *_WIDE, "keys")
    out = materialise(groups.groupBy("h1").agg(F.min("group").alias("group"), *(F.first(c).alias(c) for c in [*_WIDE, "keys"])), "line-crowded")
    discard(own)
    return out


def _once(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of classes that have more than one, and a few others, without norm; the classes of these; and the rows that are
    the first of their class, and a few others: all with no text shuffled. The first two are written."""
    more = materialise(found.groupBy("h1", "h2").count().filter("count > 1").select("h1"), "line-repeated")
    own = materialise(_wanted(found.drop("norm"), more), "line-repeats")
    classes = materialise(line_classes(own), "line-classes")
    slots, first_slots = bitmap_slots(more.count()), bitmap_slots(classes.count())
    repeats = marked(bitmap(more.select(F.col("h1").alias("h")), slots), F.col("h1"), slots)
    # Every row that the first bitmap marks is in own, so its class is in classes and its first row in the second bitmap.
    first = marked(bitmap(classes.select(F.xxhash64("first.doc_id", "first.dk", "first.pos").alias("h")), first_slots), F.xxhash64("doc_id", "dk", "pos"), first_slots)
    return own, classes, found.filter("norm is not null").filter(~repeats | first)


def _spelt(x: str) -> str:
    """The words of norm_x, each one letter that no other word of the pair has."""
    return f"decode(unhex(array_join(transform(split(norm_{x}, ' '), w -> lpad(hex(65535 + array_position(own, w)), 8, '0')), '')), 'UTF-32')"


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, slices: int) -> DataFrame:
    """(first_a, first_b) of the pairs whose words are similar; written, in so many steps or more if there are many pairs."""
    def side(texts: DataFrame, x: str, *columns: str) -> DataFrame:
        return texts.select(F.col("h1").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))

    def allowed(n_a: str, n_b: str) -> str:
        return f"cast(floor(greatest({n_a}, {n_b}) * {1 - similarity!r} + 1e-9) as int)"

    def by_slice(pairs: DataFrame, times: int, *columns: str):
        """One slice of the pairs after another, with both sides; of texts, only the slice's own are shuffled."""
        if times == 1:
            yield pairs.join(side(texts, "a", *columns), "a").join(side(texts, "b", *columns), "b")
            return
        for k in range(times):
            own = pairs.filter(F.pmod("a", F.lit(times)) == k)
            other = materialise(own.select(F.col("b").alias("h1")).distinct(), "line-wanted")
            yield own.join(side(texts.filter(F.pmod("h1", F.lit(times)) == k), "a", *columns), "a").join(side(_wanted(texts, other), "b", *columns), "b")
            discard(other)
            release(pairs.sparkSession)

    n, sure, unsure = pairs.count(), [], []
    most = allowed("words_a", "words_b")
    # The time of a comparison grows with its bound; pairs of long lines that are similar mostly differ by far less than they may.
    near = F.expr(f"(greatest(words_a, words_b) > {_SLOW} and levenshtein(letters_a, letters_b, {most} div 4) >= 0) or levenshtein(letters_a, letters_b, {most}) >= 0")
    # Different words may have one letter, which only makes lines look closer; pairs with such words are spelt exactly.
    apart = F.expr("get(transform(array(array_union(marks_a, marks_b)), own -> size(own) = size(array_distinct(transform(own, m -> m & 1048575L)))), 0)")
    for met in by_slice(pairs, max(slices if n > _FEW else 1, n // _PAIRS + 1), "first", "letters", "marks", "words"):
        # An edit changes two different words at most, as it does bits.
        can_be = _can_be(F.size(F.array_union("marks_a", "marks_b")) * 2 - F.size("marks_a") - F.size("marks_b"), similarity)
        met = materialise(met.filter(can_be).filter(near).select("a", "b", "first_a", "first_b", apart.alias("apart")), "line-sure")
        sure.append(met.filter("apart"))
        unsure.append(met.filter("not apart"))
    most = allowed("size(split(norm_a, ' '))", "size(split(norm_b, ' '))")
    exact = f"get(transform(array(array_distinct(split(concat(norm_a, ' ', norm_b), ' '))), own -> levenshtein({_spelt('a')}, {_spelt('b')}, {most})), 0) >= 0"
    unsure = materialise(reduce(DataFrame.unionByName, unsure).drop("apart"), "line-unsure")
    if unsure.head(1):
        few = _wanted(texts, materialise(_members(unsure).distinct(), "line-wanted"))
        sure.append(unsure.join(side(few, "a", "norm"), "a").join(side(few, "b", "norm"), "b").filter(F.expr(exact)))
    return materialise(reduce(DataFrame.unionByName, [s.select("first_a", "first_b") for s in sure]), "line-sure")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (first_a, first_b): only their groups are gone through again."""
    a, b = (roots.select(F.col("node").alias(f"first_{x}"), F.col("root").alias(f"root_{x}")) for x in "ab")
    tied = links.join(a, "first_a", "left").join(b, "first_b", "left").select(F.coalesce("root_a", "first_a").alias("a"), F.coalesce("root_b", "first_b").alias("b"))
    again = materialise(components(tied).select(F.col("node").alias("group"), F.col("root").alias("new_root")), "line-groups")
    known = roots.join(again, F.col("root") == F.col("group"), "left").select("node", F.coalesce("new_root", "root").alias("root"))
    alone = again.join(roots, F.col("group") == F.col("node"), "left_anti").select(F.col("group").alias("node"), F.col("new_root").alias("root"))
    return known.unionByName(alone)


def duplicate_lines(
    docs: DataFrame, text: str = "text", min_words: int = 5, max_bits: int = 2, similarity: float = 0.8, crowd: int = 64, shingles: int = 12, gate_bits: int = 64,
    slices: int = 1,
) -> DataFrame:
    """(doc_id, dk, gone): the positions of the lines to remove from each document that loses any."""
    found = materialise(lines(docs, text, min_words), "lines", "zstd")
    repeats, classes, once = _once(found)
    release(docs.sparkSession)
    sketches = materialise(line_sketches(once, shingles, similarity), "line-sketches", "zstd")
    met, crowds = [], []
    for k in range(slices):
        keys = _meetings(sketches, similarity, crowd, gate_bits, k, slices)
        release(docs.sparkSession)
        near, many = keys.filter("a is not null").select("a", F.col("h1").alias("b")), keys.filter("a is null").drop("a")
        near = near.unionByName(_near(_side(_centres(many, similarity), "a"), _side(many, "b"), gate_bits, similarity, ordered=False).select("a", "b"))
        met.append(materialise(near.distinct(), "line-met"))
        crowds.append(materialise(many, "line-crowds"))
        discard(keys)
        release(docs.sparkSession)
    discard(sketches)
    pairs = materialise(reduce(DataFrame.unionByName, met).distinct(), "line-pairs") if slices > 1 else met.pop()
    discard(*met)
    many = reduce(DataFrame.unionByName, crowds)
    asked = materialise(_members(pairs).unionByName(many.select("h1")).distinct(), "line-wanted")
    asked_lines = materialise(_wanted(once, asked), "line-asked", "zstd")  # all later steps read no other lines
    discard(asked, found)
    release(docs.sparkSession)
    texts = _texts(asked_lines, _members(pairs))
    release(docs.sparkSession)
    roots = components(_verified(pairs, texts, similarity, _TEXT_SLICES))
    discard(pairs, texts)
    if many.head(1):  # groups grow by one class of each band after another; what is left apart is compared in full
        roots = materialise(roots, "line-groups")
        groups = _crowded(asked_lines, many, roots)
        release(docs.sparkSession)
        wide = reduce(lambda x, y: x + y, (_differ(f"{c}_a", f"{c}_b") for c in _WIDE))
        apart = (F.col("group_a") != F.col("group_b")) & _can_be(wide, similarity)
        held = []
        for picks in (True, False):
            met = []
            for k, own in enumerate(crowds):
                if picks:
                    held.append(materialise(own.join(groups.withColumn("group", F.xxhash64("group")), "h1"), "line-grouped"))
                    release(docs.sparkSession)
                    few = reduce(DataFrame.unionByName, (_picked(held[k], similarity, turn) for turn in range(_PICKS)))
                    near = _near(_side(few, "a"), _side(held[k].drop("keys"), "b"), gate_bits, similarity, apart, ordered=False)
                else:
                    near = _near(*_by_length(_with_main(held[k], moved), similarity), gate_bits, similarity, apart)
                met.append(materialise(near.select("a", "b"), "line-met"))
                release(docs.sparkSession)
            between = materialise(reduce(DataFrame.unionByName, met).distinct(), "line-pairs")
            discard(*met)
            release(docs.sparkSession)
            texts = _texts(asked_lines, _members(between))
            release(docs.sparkSession)
            roots = materialise(_joined(roots, _verified(between, texts, similarity, _TEXT_SLICES)), "line-groups")
            discard(between, texts)
            if picks:
                moved = groups.select("group").distinct().join(roots, F.col("group") == F.col("node")).filter("node != root")
                moved = materialise(moved.select(F.xxhash64("group").alias("group"), F.xxhash64("root").alias("moved")), "line-moved")
        discard(*held)
        discard(*crowds)
    roots = materialise(roots, "line-roots")
    release(docs.sparkSession)
    named = classes.filter("copies > 1").join(roots, F.col("first") == F.col("node"), "left").select("h1", "h2", F.coalesce("root", "first").alias("root"))
    gone = repeats.join(named, ["h1", "h2"]).filter(_place() != F.col("root")).select("doc_id", "dk", "pos")
    gone = gone.unionByName(roots.filter("node != root").select("node.doc_id", "node.dk", "node.pos"))
    return gone.groupBy("doc_id", "dk").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, text: str = "text", min_words: int = 5, max_bits: int = 2, similarity: float = 0.8, count: str | None = None) -> DataFrame:
    """docs with the lines removed that repeat another one; count: name of an added column of their number."""
    g_id, g_dk, g_pos = fresh(docs, "g_id", "g_dk", "g_pos")
    gone = duplicate_lines(docs, text, min_words, max_bits, similarity).toDF(g_id, g_dk, g_pos)
    gone = materialise(gone, "line-removals")
    joined = docs.join(small_side(gone, g_pos), F.col("doc_id").eqNullSafe(F.col(g_id)) & (F.xxhash64(text) == F.col(g_dk)), "left")
    parts = F.split(text, "\n")

    def rest(p: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(g_pos))
        return F.array_join(F.transform(kept, lambda i: F.get(p, i)), "\n")

    changed = F.when(F.col(g_pos).isNull(), F.col(text)).otherwise(let(parts, rest))
    out = joined.withColumn(text, changed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    extra = [F.coalesce(F.size(g_pos), F.lit(0)).alias(count)] if count else []
    return out.select(*docs.columns, *extra)


def query(spark, sf_dir):
    from .common import table

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_removed")
