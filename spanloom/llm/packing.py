"""Best-fit packing of tokenised documents into sequences, by large-item matching.

Lengths are integers from 1 to the capacity, so the plan is made on the histogram of piece lengths, which has at
most `capacity` rows however large the corpus is:

1. Pieces above a third of the capacity are matched greedily, longest first, each with the longest partner above a
   third that still fits; so a sequence holds at most two of them.
2. The smaller pieces, longest first, go to the smallest remaining gap that takes them; new sequences open only where no
   gap does.

The plan is a list of runs "ranks a to b of length L lie in sequences s, s+1, ...". Each piece then takes its rank
among the pieces of its length. Ranks come from counts of small salted groups, so a length that very many pieces
share is ranked by many tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep_words_of, settle, text_batches, words_of

CAPACITY, END_ID = 4096, 1
#: Pieces of one length and salt that one task ranks, on average, at most.
RANKED_AT_ONCE = 50_000


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """A word (bytes without ASCII white space) to its ids as little-endian unsigned 32-bit integers.

    The tokenizer composes characters, turns white space into single blanks, lower-cases and splits at blanks, which it drops; so a text's
    ids are those of its words in order. Letters and the marks behind them are tokens apart. So a word whose letters are all in PLAIN, which
    the normaliser leaves letters, with any ASCII marks but an apostrophe behind them, is put together from the two, and all new runs of letters are encoded
    in one call: each ends with an id that ends a word. Every other word is encoded whole. Emptied when it has grown to
    800,000 words; words of over 64 bytes aren't kept. A Python worker keeps one for all its tasks.
    """

    MARKS, MOST = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~', 800_000
    #: Letters of ASCII, Latin-1, Greek and Cyrillic that compose with nothing here and whose lower case is one letter.
    PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿĀ-įıĴ-ňŊ-žΑ-ΡΤ-Ωα-ρτ-ωА-яЀ-џ]+")

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.known = tokenizer, {}
        words = tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def plain(self, core: bytes) -> bool:
        return core.isalpha() or not core.isascii() and self.PLAIN.fullmatch(core.decode("utf-8", "replace")) is not None

    def learn(self, words: list[bytes]) -> None:
        known, made, other = self.known, [], []
        for w in words:
            core = w.rstrip(self.MARKS)
            if core and self.plain(core):
                made.append((w, core.lower() if core.isascii() else core, w[len(core) :]))
            else:
                other.append(w)
        known.update(zip(other, (x.tobytes() for x in self.encode(other)), strict=True))
        new = list({c for _, c, _ in made}.difference(known))
        (ids,) = self.encode([b" ".join(new)])
        ends = np.flatnonzero(self.ends[ids]).tolist()
        if len(ends) == len(new):
            raw, at = ids.tobytes(), 0
            for c, end in zip(new, ends, strict=True):
                known[c] = raw[4 * at : 4 * end + 4]
                at = end + 1
        else:
            known.update(zip(new, (x.tobytes() for x in self.encode(new)), strict=True))
        for w, core, marks in made:
            if marks and marks not in known:
                known[marks] = self.encode([marks])[0].tobytes()
            known[w] = known[core] + known[marks] if marks else known[core]

    def ids(self, text: bytes) -> bytes:
        words = text.split()
        if len(self.known) > self.MOST:
            self.known.clear()
        new = list(set(words).difference(self.known))
        for i in range(0, len(new), 10_000):
            self.learn(new[i : i + 10_000])
        out = b"".join(map(self.known.__getitem__, words))
        for w in new:
            if len(w) > 64:
                del self.known[w]
        return out


_WORDS: dict[str, WordIds] = {}
words_of("packing", lambda: [w.known.clear() for w in _WORDS.values()])


def word_ids(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    if path not in _WORDS:
        _WORDS[path] = WordIds(Tokenizer.from_file(path))
    return _WORDS[path]


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_words_of("packing")
        words, step = word_ids(path), 4 * capacity
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids = (words.ids(text) if text else b"") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class _Gaps:
    """Numbers of sequences by remaining gap, with what each lot of them holds."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.lots: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, n: int) -> None:
        if n and gap:
            if not self.lots.get(gap):
                self.lots[gap] = []
                insort(self.sizes, gap)
            self.lots[gap].append((first, n))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A lot of the smallest gap of at least this: (gap, first sequence, number)."""
        k = bisect_left(self.sizes, least)
        if k == len(self.sizes):
            return None
        gap = self.sizes[k]
        first, n = self.lots[gap].pop()
        if not self.lots[gap]:
            del self.sizes[k]
        return gap, first, n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, number, first sequence, offset, each), sorted by length and rank.

    The piece of rank first + i of a run lies in sequence first_sequence + i // each at offset + (i % each) * length.
    """
    left = {k: n for k, n in counts.items() if n}
    if left and not 1 <= min(left) <= max(left) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    used, runs, sequences, gaps = dict.fromkeys(left, 0), [], 0, _Gaps()

    def put(length: int, n: int, first: int, offset: int, each: int = 1) -> None:
        runs.append((length, used[length], n, first, offset, each))
        used[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    for a in reversed(large):
        while left[a]:
            k = bisect_left(large, capacity - a + 1) - 1
            while k >= 0 and (not left[large[k]] or large[k] == a and left[a] < 2):
                k -= 1
            b = min(large[k], a) if k >= 0 else 0
            if b and large[k] > a:  # longer ones are all placed
                raise AssertionError("a longer piece is left")
            n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, sequences, 0)
            if b:
                put(b, n, sequences, a)
            gaps.add(capacity - a - b, sequences, n)
            sequences += n
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            lot = gaps.take(s)
            if lot is None:
                each = capacity // s
                n = left[s] // each
                if n:
                    put(s, n * each, sequences, 0, each)
                    gaps.add(capacity - each * s, sequences, n)
                else:
                    n, each = 1, left[s]
                    put(s, each, sequences, 0, each)
                    gaps.add(capacity - each * s, sequences, 1)
                sequences += n
                continue
            gap, first, n = lot
            each = min(gap // s, left[s])  # what is left of a gap is smaller than any other that fits: one sequence is filled before the next
            fill = min(n, left[s] // each)
            put(s, fill * each, first, capacity - gap, each)
            gaps.add(gap - each * s, first, fill)
            gaps.add(gap, first + fill, n - fill)
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def _place(runs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = runs.value
        key = t[:, 0] << 48 | t[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = t[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            i = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(r[:, 3] + i // r[:, 5]), pa.array(r[:, 4] + i % r[:, 5] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each whole text and the end id, cut every `capacity` ids."""
    text_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (as tokenised_pieces() makes them) with sequence_id and offset. Each row is one piece, so rows that repeat
    an id are packed as often as they occur. No rows give no rows."""
    spark = pieces.sparkSession
    by = settle(pieces, "pieces")
    n = by.count()
    salts = max(16, -(-n // RANKED_AT_ONCE))
    # ties inside a group are rows alike in every column: whichever comes first, the result is the same
    by = by.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = settle(by.groupBy("length", "salt").count(), "lengths")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    # both sides are dealt by length and salt already or are few rows a task; the starts grow with the pieces, so they aren't broadcast
    ranked = by.withColumn("in", F.row_number().over(inside)).join(starts.hint("merge"), ["length", "salt"])
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("in") - 1).alias("rank")]
    return ranked.select(*cols).mapInArrow(_place(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All documents in as few sequences of at most `capacity` ids as the matching finds.

    A null or empty text is the end id alone; a null doc_id is kept as null; other columns are not looked at.
    """
    return pack(tokenised_pieces(docs, tokenizer or public_tokenizer(), capacity), capacity)
