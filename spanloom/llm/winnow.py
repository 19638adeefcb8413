"""Document fingerprints by winnowing.

Every k-gram of code points has a rolling hash. Of each window of w consecutive hashes the least is chosen, the
rightmost one at a tie, and a position is recorded once. Any run of w + k - 1 code points that two texts share gives
them a common hash; the positions say where it lies. A text of fewer than w k-grams is one window, a text below k code
points is one gram, an empty text has no fingerprint.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, text_batches

K, W = 14, 50
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWEST = -(1 << 63)


class Winnower:
    def __init__(self, k: int = K, w: int = W) -> None:
        if k < 1 or w < 1:
            raise ValueError("k and w must be positive")
        self.k, self.w = k, w
        self.powers(1024)

    def powers(self, n: int) -> None:
        self.up, self.down = (np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)]).cumprod(dtype=_U) for b in (_BASE, _INVERSE))

    def grams(self, text: str) -> np.ndarray:
        """The 32-bit hash of each k-gram, from differences of one running sum; of the whole text where it is shorter."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(_U) + _U(1)
        n = len(c)
        if n > len(self.up):
            self.powers(2 * n)
        k = min(self.k, n)
        total = np.zeros(n + 1, _U)
        np.cumsum(c * self.up[:n], out=total[1:])
        h = (total[k:] - total[: n - k + 1]) * self.down[: n - k + 1]
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h >> _U(32)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Chosen hashes and their positions, in text order."""
        if not text:
            return np.empty(0, np.uint32), np.empty(0, np.int32)
        h = self.grams(text)
        n = len(h)
        least = h << _U(32) | (_U(0xFFFFFFFF) - np.arange(n, dtype=_U))  # a tie goes to the larger position
        w, step = min(self.w, n), 1
        while 2 * step <= w:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < w:
            least = np.minimum(least[: step - w], least[w - step :])
        least = least[np.flatnonzero(np.diff(least, prepend=~least[:1]))]  # consecutive windows that chose the same
        return (least >> _U(32)).astype(np.uint32), (_U(0xFFFFFFFF) - (least & _U(0xFFFFFFFF))).astype(np.int32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct hashes: shared ones to all; 1 where both are empty."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_string(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def _key(at: Column, th: Column) -> Column:
    return F.struct(at.alias("at"), th.alias("th"))


def _bucket(x: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many of the sorted cuts are at most x: first among every m-th cut, then among the m behind it."""
    m = max(1, round(len(cuts) ** 0.5))
    if not cuts:
        return F.lit(0)
    kind = "struct<at:bigint,th:bigint>"
    pair = lambda c: F.struct(F.lit(c[0]).cast("long").alias("at"), F.lit(c[1]).cast("long").alias("th"))
    blocks = [cuts[i : i + m] for i in range(0, len(cuts), m)]
    block = F.size(F.filter(F.array(*[pair(b[0]) for b in blocks]).cast(f"array<{kind}>"), lambda c: c <= x))
    inside = F.element_at(F.array(*[F.array(*map(pair, b)) for b in blocks]).cast(f"array<array<{kind}>>"), F.greatest(block, F.lit(1)))
    return F.when(block == 0, 0).otherwise((block - 1) * m + F.size(F.filter(inside, lambda c: c <= x)))


def _cuts(values: list[int]) -> list[tuple[int, int]]:
    """Cuts (id, hash of the text) from quantiles of ids. An id that several quantiles fall on has as many parts of all rows; it is cut by the hash."""
    return sorted((int(v), _LOWEST + j * (1 << 64) // m) for v, m in Counter(values).items() for j in range(m))


def with_previous(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(at, th, id, text, bucket, context), sorted within partitions so that each row follows the row of the next lower id.

    Ids are cut into ranges by approximate quantiles of the id column alone, and an id that fills several ranges (as nulls may) by a hash of the text;
    the last row of each range is also sent to the following range as context, that of the last range to the first. So each text is shuffled once
    and no task sees more than its range. Ties are ordered by that hash, then by text; a null id counts as the lowest.
    """
    spark = docs.sparkSession
    text_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("at", F.coalesce("id", F.lit(_LOWEST))).withColumn("th", F.xxhash64("text"))
    n = partitions(spark)
    cuts = _cuts(base.select("at").approxQuantile("at", [i / n for i in range(1, n)], 0.25 / n)) if n > 1 else []
    bucket = _bucket(_key(F.col("at"), F.col("th")), cuts).cast("int")
    # the texts are read for their hash only where an id is cut by it
    least = F.col("th") if any(h != _LOWEST for _, h in cuts) else F.lit(_LOWEST)
    ids = base.select("at", least.alias("th"))
    last = {r["b"]: (r["m"]["at"], r["m"]["th"]) for r in ids.groupBy(bucket.alias("b")).agg(F.max(_key(F.col("at"), F.col("th"))).alias("m")).collect()}  # a row a range
    order = sorted(last)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    n_b = len(cuts) + 1
    to = F.lit([after.get(b, -1) for b in range(n_b)]).cast("array<int>")
    top = [F.element_at(F.lit([last.get(b, (_LOWEST, _LOWEST))[k] for b in range(n_b)]).cast("array<long>"), F.col("bucket") + 1) for k in (0, 1)]
    b = base.withColumn("bucket", bucket)
    is_last = (top[0] == F.col("at")) & (top[1] <= F.col("th"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("context"))
    other = F.struct(F.element_at(to, F.col("bucket") + 1).alias("bucket"), F.lit(True).alias("context"))
    rows = b.select("at", "th", "id", "text", F.explode(F.when(is_last, F.array(own, other)).otherwise(F.array(own))).alias("p")).select("at", "th", "id", "text", "p.*")
    return rows.repartitionById(n_b, F.col("bucket")).sortWithinPartitions("bucket", F.desc("context"), "at", "th", "text")


def _rows(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnower(k, w)
        text0, set0 = "", np.empty(0, np.uint32)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
        for b in batches:
            out = []
            with np.errstate(over="ignore"):
                for i, raw, context in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("context").to_pylist(), strict=True):
                    text = raw.decode("utf-8", "replace")
                    hashes, at = winnow(text)
                    own = np.unique(hashes)
                    if not context:
                        half = len(text) // 2
                        edited = text[: len(text) - half] + text0[:half]
                        other = winnow(edited)[0]
                        out.append((i, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), as_string(hashes), as_string(other), likeness(own, np.unique(other)), likeness(own, set0), at))
                    text0, set0 = text, own
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def fingerprints(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its text with the second half taken from the next document's start (descending id;
    after the last the first), and the likeness (Jaccard of the hashes) to both.

    A null text counts as empty; two empty fingerprints are alike by 1. Rows that repeat an id follow each other by
    a hash of the text, then by text; a single row is its own next. Other columns are not looked at. No rows give no rows.
    """
    return with_previous(docs, id_col, text_col).mapInArrow(_rows(k, w), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>")


def guarantee(k: int = K, w: int = W) -> int:
    """Shared runs of at least this many code points are always found."""
    return w + k - 1


def find_run(positions: list[int], at: int) -> int:
    """Index of the last chosen position at or before a code point."""
    return bisect_right(positions, at) - 1
