"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A document is its token ids and one end id. Longer documents are cut into full pieces and a rest.
Packing depends on the lengths only, so the plan is made from the histogram of lengths (at most
``capacity`` numbers, whatever the corpus): fill a sequence greedily with the longest pieces that
fit, then, as long as that helps, replace its smallest piece by two unpacked pieces that fill the
expanded gap more tightly. A filling is used as often as the counts allow, so the plan has a few
thousand fillings at most and its size does not follow the corpus.

Pieces are then numbered within their length. Numbers are given in blocks of hashed pieces, so a
length that a third of all pieces share is numbered by many tasks. Number and plan together give
sequence and offset; no group of pieces is ever collected.

Tokenising goes word by word through a bounded memo, which gives the ids of the whole text: the
tokenizer cuts at white space, and merges within words only. That holds for texts of the scripts in
``_PLAIN``, over all of whose code points a test compares the ids. All other texts, and those with what
might be a special token, are encoded by the tokenizer itself: libraries know different versions of
Unicode. Long texts go in segments that end at white space, either way.

Defined cases: a null text counts as empty and gives one piece, the end id; repeated rows are
packed once each; null doc_ids are kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

CAPACITY = 4096
_MEMO_WORDS = 100_000
_SEGMENT = 1 << 20
#: ASCII and Latin to Cyrillic, punctuation, kana, Han, Hangul, full width; not: separators that only Python
#: calls white space, letters whose lower case depends on their place.
_PLAIN = "\x00-\x1b\x20-\u012f\u0131-\u03a2\u03a4-\u052f\u2000-\u206f\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uffef"
_OTHER = re.compile(f"[^{_PLAIN}]")
_CUT = re.compile(r"[ \n\t\r]")
_MARK = b"\xff"


def _byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else the
    next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return "".join(chr(b) if b in plain else chr(256 + sum(1 for x in range(b) if x not in plain)) for b in range(256))


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, by way of their words.

    The vocabulary is byte pairs with a mark at each word's end. The mark becomes a byte that UTF-8
    never has, and joining it to the last byte the first merge of all; then a byte-pair coder without
    the tokenizer's text pipeline gives the same ids, word by word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]  # all begin with "<|"
        if not all(t.startswith("<|") for t in special):
            raise ValueError(f"special tokens that word-wise coding would miss: {special}")
        spec = json.loads(self.whole.to_str())
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        end = spec["model"]["end_of_word_suffix"]
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        ranks, self.ids = {}, {}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        for t, i in vocabulary.items():
            marked = t.endswith(end) and t != end
            raw = bytes(byte_of[c] for c in (t.removesuffix(end) if marked else t)) + (_MARK if marked else b"")
            # A byte with the mark is merged before all else; single bytes are never merged into.
            rank = len(vocabulary) * (0 if len(raw) == 2 and marked else 2 if len(raw) == 1 else 1) + i
            ranks[raw], self.ids[rank] = rank, i.to_bytes(4, "little")
        ranks.setdefault(_MARK, 3 * len(vocabulary))
        self.merge = Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _odd(self, text: str) -> bool:
        """Words alone may not tell the ids."""
        return "<|" in text or (not text.isascii() and _OTHER.search(text) is not None) or any(c in text for c in "\x1c\x1d\x1e\x1f")

    def _word(self, word: str) -> bytes:
        ids = self.ids
        return b"".join([ids[r] for p in ((word,) if word.isalpha() else self.pieces(word)) for r in self.merge(p.encode() + _MARK)])

    def _segment(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        words = text.lower().split()
        memo = self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            if len(memo) > _MEMO_WORDS:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = self._word(w)
            return b"".join([memo[w] for w in words])

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        one = self._whole if self._odd(text) else self._segment
        if len(text) <= _SEGMENT:
            return one(text)
        out, at = [], 0
        while at < len(text):  # bounded memory: long texts go in segments that end at white space
            cut = _CUT.search(text, at + _SEGMENT)
            end = cut.start() if cut else len(text)
            out.append(one(text[at:end]))
            at = end
        return b"".join(out)


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.encode(t.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for c, v in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, ty) for c, ty in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def _best_pair(free: np.ndarray, gap: int) -> tuple[int, int] | None:
    """The two lengths, each free, with the largest sum of at most gap."""
    lengths = np.flatnonzero(free[: gap + 1])
    if not len(lengths):
        return None
    at = np.searchsorted(lengths, gap - lengths, "right") - 1
    partner = np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
    single = (partner == lengths) & (free[lengths] < 2)  # one piece can't be used twice
    lower = np.searchsorted(lengths, partner[single], "left") - 1
    partner[single] = np.where(lower >= 0, lengths[np.maximum(lower, 0)], 0)
    total = np.where(partner > 0, lengths + partner, 0)
    best = int(total.argmax())
    return (int(lengths[best]), int(partner[best])) if total[best] else None


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces}): how often to fill a sequence with which lengths, all pieces used."""
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    out = []
    lengths = np.flatnonzero(free)
    while len(lengths):
        used: dict[int, int] = {}
        gap = capacity
        at = len(lengths) - 1
        left = free.copy()
        while gap and at >= 0:
            at = int(np.searchsorted(lengths[: at + 1], gap, "right")) - 1
            if at < 0:
                break
            n = int(lengths[at])
            take = min(gap // n, int(left[n]))
            if take:
                used[n] = used.get(n, 0) + take
                left[n] -= take
                gap -= take * n
            at -= 1
        while gap:
            least = min(used)
            pair = _best_pair(left, gap + least)
            if not pair or sum(pair) <= least:
                break
            left[least] += 1
            used[least] -= 1
            if not used[least]:
                del used[least]
            for n in pair:
                used[n] = used.get(n, 0) + 1
                left[n] -= 1
            gap += least - sum(pair)
        times = min(int(free[n]) // k for n, k in used.items())
        for n, k in used.items():
            free[n] -= times * k
        out.append((times, used))
        lengths = lengths[free[lengths] > 0]
    return out


def placements(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first number, pieces per sequence, first sequence, first offset), sorted: the pieces
    of a length, from that number on, go so many to each sequence, side by side."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for times, used in plan:
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            first = given.get(n, 0)
            rows.append((n, first, k, sequence, offset))
            given[n] = first + times * k
            offset += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = 1, block_rows: int = 1_000) -> DataFrame:
    """The pieces of docs with sequence_id and offset (tokens before the piece in its sequence)."""
    found = materialise(pieces(docs, tokenizer, text, capacity, end_id), "pieces")
    lengths = found.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most capacity rows
    counts = {r["length"]: r["n"] for r in lengths}
    table = placements(fillings(counts, capacity))
    spread = max(1, -(-max(counts.values(), default=0) // block_rows))
    key = [F.col("length"), F.col("block")]
    blocked = found.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread)).cast("int"))
    numbered = blocked.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    per = blocked.groupBy(*key).agg(F.count("*").alias("n"))
    before = per.select(*key, (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    ranked = numbered.join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("at"))

    def place(batches):
        keys = (table[:, 0] << 44) | table[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = table[np.searchsorted(keys, (length << 44) | rank, "right") - 1]
            since = rank - row[:, 1]
            seq, off = row[:, 3] + since // row[:, 2], row[:, 4] + since % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir):
    from .common import table

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
