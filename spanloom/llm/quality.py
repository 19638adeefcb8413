"""Quality classifier from weak labels.

Overlapping heuristic labellers look at a whole document and vote good, bad or abstain. Expectation-maximisation over the
votes of all documents estimates how often each labeller says what of good and of bad documents, and gives each vote pattern a
posterior. The posteriors are the labels on which a linear scorer over hashed words and word shapes is trained; the scorer
judges every document. No true labels are used.

Each text is looked at once: its vote pattern and its features (hashed words and shapes with their numbers, at most 65,536) are written
to the shared folder, and counts, the sample and all scores come from there. With seven labellers there are at most 3**7 = 2,187 vote patterns,
so the estimation runs on the driver. The scorer is fitted on a bounded sample (`sample` documents, by hash); everything
else covers all documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, keep_words_of, settle, text_batches, words_of


BUCKETS = 1 << 16
SAMPLE = 6_000
LABELLERS = ("symbols", "capitals", "bare_marks", "repeated_words", "function_words", "repeated_lines", "line_ends")
_KNOWN = b".,;:!?'\"()-"
_SHAPE = bytes.maketrans(bytes(range(256)), bytes(0x61 if 97 <= c <= 122 or c >= 128 else 0x41 if 65 <= c <= 90 else 0x30 if 48 <= c <= 57 else c for c in range(256)))
_RUN = re.compile(rb"(.)\1+", re.S)
_AGAIN = xxhash.xxh3_64_intdigest(b"again") % BUCKETS
_LOUD, _SYMBOL, _BARE, _SHORT = 1, 2, 4, 8
#: A word that stands among so many before it is a repeated one.
NEAR = 50


def _describe(word: bytes) -> int:
    """Two hashed features (the lower-cased word, its shape with runs folded) and four marks, in one number."""
    raw = word.translate(_SHAPE)
    shape = _RUN.sub(rb"\1", raw)
    core = raw.strip(_KNOWN)
    letters = raw.count(b"a") + raw.count(b"A")
    marks = 0
    if letters > 1 and raw.count(b"A") == letters or core and raw.endswith(b"!!"):
        marks |= _LOUD
    if core.translate(None, b"aA0" + _KNOWN):
        marks |= _SYMBOL
    if not letters and b"0" not in raw:
        marks |= _BARE
    if letters == len(raw) <= 4:
        marks |= _SHORT
    a = xxhash.xxh3_64_intdigest(b"w" + word.lower()) % BUCKETS
    b = xxhash.xxh3_64_intdigest(b"s" + shape) % BUCKETS
    return a | b << 16 | marks << 32


class _Words(dict):
    """Emptied when it has grown to half a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = x = _describe(word)
        return x


_WORDS = _Words()
words_of("quality", _WORDS.clear)


def look(text: bytes | None) -> tuple[np.ndarray, int, np.ndarray]:
    """(votes: 1 good, 0 bad, -1 abstain; number of words; the words' numbers)."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return np.full(len(LABELLERS), -1, np.int8), 0, np.empty(0, np.int64)
    x = np.fromiter(map(_WORDS.__getitem__, words), np.int64, n)
    ids = (x & 0xFFFF).astype(np.uint16)
    order = np.argsort(ids, kind="stable")  # by radix
    near = np.count_nonzero((ids[order[1:]] == ids[order[:-1]]) & (np.diff(order) <= NEAR))
    same = np.flatnonzero(ids[1:] == ids[:-1]) + 1
    x[same] = x[same] & ~np.int64(0xFFFF << 16) | _AGAIN << 16  # a word that follows itself has that as its shape
    m = np.bincount(x >> 32, minlength=16)
    loud, symbol, bare, short = (sum(m[k] for k in range(16) if k & bit) for bit in (_LOUD, _SYMBOL, _BARE, _SHORT))
    lines = [s for s in (s.strip() for s in text.split(b"\n")) if s]
    again = len(lines) - len(set(lines))
    size, ended = sum(map(len, lines)), sum(len(s) for s in lines if s.endswith((b".", b"!", b"?", b":", b'"', b")")))
    vote = lambda good, bad: 1 if good else 0 if bad else -1
    # the last four are shares with some words, lines or bytes of no opinion added, so that few of them give no vote
    near_, short_, again_, ends_ = (near + 4.5) / (n + 10), (short + 2.3) / (n + 20), (again + 0.75) / (len(lines) + 3), (ended + 156) / (size + 240)
    return (
        np.array(
            [
                vote(symbol / n < 0.05, symbol / n > 0.15),
                vote(loud / n < 0.1, loud / n > 0.3),
                vote(bare / n < 0.02, bare / n > 0.1),
                vote(near_ < 0.4, near_ > 0.5),
                vote(short_ > 0.15, short_ < 0.08),
                vote(again_ < 0.1, again_ > 0.4),
                vote(ends_ > 0.8, ends_ < 0.5),
            ],
            np.int8,
        ),
        n,
        x,
    )


def pattern(votes: np.ndarray) -> int:
    return int(((votes.astype(np.int64) + 1) * 3 ** np.arange(len(votes))).sum())


def votes_of(p: np.ndarray, labellers: int = len(LABELLERS)) -> np.ndarray:
    return (p[:, None] // 3 ** np.arange(labellers) % 3).astype(np.int8) - 1


class WeakLabels:
    """Class shares and, for each labeller, the chance that a vote it gives on a document of a class is good; by expectation-maximisation. To
    abstain says nothing, so short documents, on which many abstain, aren't bad for that."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 200, smooth: float = 1.0) -> None:
        v = votes_of(patterns, labellers)
        p = np.choose(np.minimum((v == 0).sum(1), 2), [0.95, 0.4, 0.05])  # starts from the number of bad votes, which say more than good ones
        for _ in range(rounds):
            w = np.stack([(1 - p) * counts, p * counts])  # class, pattern
            self.share = (w.sum(1) + smooth) / (w.sum() + 2 * smooth)
            good, bad = w @ (v == 1), w @ (v == 0)
            self.good, self.given = (good + smooth) / (good + bad + 2 * smooth), good + bad
            new = self.posterior(patterns)
            if np.abs(new - p).max(initial=0.0) < 1e-9:
                break
            p = new

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance of good."""
        v = votes_of(patterns, self.good.shape[1])
        log = np.log(self.share) + (v == 1) @ np.log(self.good).T + (v == 0) @ np.log(1 - self.good).T
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller: the chance that a vote it gives is right."""
        right = self.given[0] * (1 - self.good[0]) + self.given[1] * self.good[1]
        return right / self.given.sum(0)


def fit(ids: np.ndarray, times: np.ndarray, sizes: np.ndarray, target: np.ndarray, epochs: int = 60, rate: float = 0.5, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on shares of hashed features (features() of all rows, one after the other, and their numbers), by full-batch Adagrad; deterministic."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    value = 2 * times / np.bincount(row, times, len(sizes))[row]  # each word has two features
    w, bias, seen, seen_b = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(epochs):
        z = np.bincount(row, value * w[ids], len(sizes)) + bias
        g = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        grad = np.bincount(ids, value * g[row], BUCKETS) / len(sizes) + ridge * w
        seen += grad**2
        w -= rate * grad / np.sqrt(seen)
        b = g.mean()
        seen_b += b * b
        bias -= rate * b / np.sqrt(seen_b)
    return w, bias


def features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text, as 16-bit numbers, and how often each stands in it; at most BUCKETS of them."""
    ids, times = np.unique(np.concatenate([words & 0xFFFF, words >> 16 & 0xFFFF]).astype("<u2"), return_counts=True)
    return ids, times.astype("<u4")


_LOOKED = "struct<pattern:bigint,ids:binary,times:binary>"


def _look(texts: pa.Array) -> pa.Array:
    keep_words_of("quality")
    p, ids, times = [], [], []
    for t in texts.cast(pa.binary()).to_pylist():
        votes, _, words = look(t)
        i, n = features(words)
        p.append(pattern(votes))
        ids.append(i.tobytes())
        times.append(n.tobytes())
    return pa.StructArray.from_arrays([pa.array(p, pa.int64()), pa.array(ids, pa.binary()), pa.array(times, pa.binary())], ["pattern", "ids", "times"])


def looked_at(docs: DataFrame, id_col: str, text_col: str, seen: str, draw: str) -> DataFrame:
    """docs, settled, with what one look at each text gives, and a hash of id and text to draw samples by."""
    text_batches(docs.sparkSession)
    own = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(8))
    out = docs.withColumn(draw, own).withColumn(seen, F.arrow_udf(_look, _LOOKED)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return settle(out, "looked", compression="zstd")


class Scorer:
    """What a fit gives: the weak-label model and the linear scorer."""

    def __init__(self, labels: WeakLabels, weights: np.ndarray, bias: float) -> None:
        self.labels, self.weights, self.bias = labels, weights, bias

    def __call__(self, ids: bytes, times: bytes) -> tuple[float, int]:
        """(score, number of words) of a text's features."""
        n = np.frombuffer(times, "<u4")
        words = int(n.sum(dtype=np.int64)) // 2
        if not words:
            return 0.0, 0
        z = float(self.weights[np.frombuffer(ids, "<u2")] @ n) / words + self.bias
        return 1 / (1 + float(np.exp(-min(50.0, max(-50.0, z))))), words


def train(looked: DataFrame, seen: str, draw: str, sample: int = SAMPLE) -> Scorer:
    """looked: as looked_at() gives it."""
    text = looked.select(f"{seen}.*", F.col(draw).alias("draw"))
    counts = {r["pattern"]: r["count"] for r in text.groupBy("pattern").count().collect()}  # at most 3**7 rows
    labels = WeakLabels(np.array(sorted(counts), np.int64), np.array([counts[k] for k in sorted(counts)], float))
    none = Scorer(labels, np.zeros(BUCKETS), 0.0)
    text = text.filter(F.octet_length("ids") > 0)
    every = max(1, -(-text.agg(F.approx_count_distinct("draw")).first()[0] // sample))
    while True:  # about `sample` documents by hash of id and text, those alike in both once
        got = text.filter(F.pmod("draw", F.lit(every)) == 0).dropDuplicates(["draw"]).toArrow()
        if got.num_rows or every == 1:
            break
        every = every // 2
    if not got.num_rows:
        return none
    order = np.argsort(got.column("draw").to_numpy())  # the arrival order has no say
    ids, times = ([np.frombuffer(x, t) for x in got.column(c).take(order).to_pylist()] for c, t in (("ids", "<u2"), ("times", "<u4")))
    target = labels.posterior(got.column("pattern").to_numpy()[order])
    return Scorer(labels, *fit(np.concatenate(ids), np.concatenate(times).astype(np.int64), np.array([len(x) for x in ids]), target))


def _scores(model):
    def run(ids: pa.Array, times: pa.Array, patterns: pa.Array) -> pa.Array:
        m: Scorer = model.value
        out = [m(i, n) for i, n in zip(ids.to_pylist(), times.to_pylist(), strict=True)]
        post = m.labels.posterior(patterns.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array([r[0] for r in out], pa.float64()), pa.array(post, pa.float64()), pa.array([r[1] for r in out], pa.int64())], ["score", "posterior", "n_words"])

    return run


def _scored(docs: DataFrame, id_col: str, text_col: str, sample: int) -> tuple[DataFrame, str]:
    """docs with a column of score, posterior and n_words."""
    seen, draw, scored = fresh(docs, "seen", "draw", "scored")
    looked = looked_at(docs, id_col, text_col, seen, draw)
    model = docs.sparkSession.sparkContext.broadcast(train(looked, seen, draw, sample))
    score = F.arrow_udf(_scores(model), "struct<score:double,posterior:double,n_words:bigint>")(f"{seen}.ids", f"{seen}.times", f"{seen}.pattern")
    return looked.withColumn(scored, score), scored


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(id_col, score, posterior, n_words, keep): score of the linear model, posterior of the votes, keep = score >= least.

    A null, empty or blank text scores 0 and is rejected. Rows are judged one by one, so repeated rows repeat; a null id stays null.
    Other columns are not looked at. No rows give no rows.
    """
    of, scored = _scored(docs.select(F.col(id_col), F.col(text_col)).withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, sample)
    return of.select(id_col, f"{scored}.*").withColumn("keep", F.col("score") >= least)


def good_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns."""
    of, scored = _scored(docs, id_col, text_col, sample)
    return of.filter(F.col(f"{scored}.score") >= least).select(docs.columns)
