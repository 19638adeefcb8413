"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

1. Every document becomes the set of its word shingles' 64-bit hashes. One permutation splits the hash
   range into bands * rows bins; each bin keeps its least hash, and an empty bin copies the first filled bin
   of its own fixed random sequence (optimal densification).
2. Documents of equal sets form one class before anything else, so copies cost nothing further on.
3. The bins of a band hash to a bucket key. In each bucket one hub is compared with the other members (a
   star): a bucket of m members gives m - 1 pairs.
4. Pairs are confirmed on the full sets, taken from the whole texts, and links become components.
5. A star can miss a link between two members that both differ from the hub. Buckets whose members, without the
   hub, still lie in several components are joined to clusters where they overlap. First the sketches of a cluster's members are
   compared, in blocks of a bounded size, which needs no texts: members that can't reach the similarity with any member of another component
   are done, and what is left falls into smaller clusters. Then the texts of these are compared, also in blocks: each task takes two blocks and returns
   links enough to connect what is linked, never more than it has documents. So every link whose two documents share a bucket is found, and
   buckets inside one component, the usual large ones, are done after their star.

A pair of similarity 0.8 shares none of the 32 buckets of 5 bins with a probability below 4e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_settled, fresh, keep_words_of, semi, settle, text_batches

_M = np.uint64
_C1, _C2, _P = _M(0xBF58476D1CE4E5B9), _M(0x94D049BB133111EB), _M(0x9E3779B97F4A7C15)
BANDS, ROWS, SKETCH = 32, 5, 5
#: Sets below this size are confirmed without a look at the sketch.
SMALL = 64
#: Documents and shingles of a block whose texts are compared, and documents of one whose sketches are, about.
BLOCK_DOCS, BLOCK_SHINGLES, BLOCK_SKETCHES = 256, 300_000, 1024


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(30))) * _C1
    x = (x ^ (x >> _M(27))) * _C2
    return x ^ (x >> _M(31))


class _WordHashes(dict):
    """Word to 64-bit hash; emptied when it has grown to a quarter of a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, k: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the text with A-Z lower-cased; fewer words: one shingle."""
    words = text.lower().split() if text else []  # bytes.lower and bytes.split know ASCII only, as the contract has it
    n = len(words)
    if not n:
        return np.empty(0, _M)
    ids = np.fromiter(map(cache.__getitem__, words), _M, n)
    w = min(n, k)
    h = ids[: n - w + 1].copy()
    for j in range(1, w):
        h = h * _P + ids[j : n - w + 1 + j]
    return np.unique(mix(h + _M(w)))


def _targets(bins: int, attempts: int) -> np.ndarray:
    i = np.arange(attempts * bins, dtype=_M)
    return (mix(i * _P + _M(12345)) % _M(bins)).reshape(attempts, bins).astype(np.int64)


_TABLES: dict[int, np.ndarray] = {}


def minhashes(s: np.ndarray, bins: int) -> np.ndarray:
    """One hash a bin, of a sorted set that isn't empty."""
    where = ((s >> _M(32)) * _M(bins)) >> _M(32)
    first = np.flatnonzero(np.diff(where, prepend=_M(bins)))
    out, filled = np.zeros(bins, _M), np.zeros(bins, bool)
    at = where[first].astype(np.int64)
    out[at], filled[at] = s[first], True
    if len(at) == 1:
        return np.full(bins, s[0], _M)
    empty, j = np.flatnonzero(~filled), 0
    table = _TABLES.setdefault(bins, _targets(bins, 4096)) if bins not in _TABLES else _TABLES[bins]
    while len(empty):
        to = table[j % 4096, empty]
        ok = filled[to]
        out[empty[ok]] = out[to[ok]]
        empty, j = empty[~ok], j + 1
    return out


def _sketches(k: int, bands: int, rows: int):
    bins = bands * rows
    salt = mix(np.arange(1, bins + 1, dtype=_M) * _P)
    band = mix(np.arange(1, bands + 1, dtype=_M) * _C2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_words_of("near duplicates")
        cache = _WordHashes()
        for b in batches:
            n, lo, hi, keys, bits = [], [], [], [], []
            with np.errstate(over="ignore"):
                for text in b.column(2).cast(pa.binary()).to_pylist():
                    s = shingle_set(text, k, cache)
                    n.append(len(s))
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    lo.append(d & (1 << 64) - 1)
                    hi.append(d >> 64)
                    if not len(s):
                        keys.append(np.empty(0, np.int64))
                        bits.append(np.zeros(SKETCH, np.int64))
                        continue
                    m = minhashes(s, bins)
                    h = band.copy()
                    for col in m.reshape(bands, rows).T:
                        h = mix(h * _P + col)
                    keys.append(h.view(np.int64))
                    f = mix(m ^ salt)
                    two = np.concatenate([f & _M(1), (f >> _M(7)) & _M(1)]).astype(np.uint8)
                    bits.append(np.packbits(two[: SKETCH * 64]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(np.array(lo, _M).view(np.int64)), pa.array(np.array(hi, _M).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["id", "th", "n", "lo", "hi", "keys", "bits"],
            )

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_words_of("near duplicates")
        cache, sets = _WordHashes(), {}

        def of(key: tuple[int, int], text: bytes) -> np.ndarray:
            if key not in sets:
                if len(sets) > 64:
                    sets.clear()
                sets[key] = shingle_set(text, k, cache)
            return sets[key]

        for b in batches:
            with np.errstate(over="ignore"):
                ok = []
                for i, h, x, y in zip(*(b.column(c).to_pylist() for c in (0, 1)), *(b.column(c).cast(pa.binary()).to_pylist() for c in (3, 4)), strict=True):
                    s, t = of((i, h), x), shingle_set(y, k, cache)
                    both = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
                    ok.append(100 * both >= percent * (len(s) + len(t) - both) and both > 0)
            yield b.select([0, 2]).filter(pa.array(ok, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """links (a, b), a <> b: -> (node, comp), comp the least node that is reachable.

    Each round every node goes to its least neighbour, and twice on to where that one goes; then the links are drawn between the ends and
    those inside one end are gone. A star is done in one round, a chain shrinks to a quarter or less in each; rounds are settled.
    """
    edges = settle(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels: DataFrame | None = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        to = settle(both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("comp")), "least")
        for _ in range(2):
            near, to = to, settle(to.join(to.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp").select("node", F.col("next").alias("comp")), "least")
            drop_settled(near)
        old, labels = labels, to if labels is None else settle(labels.join(to.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "labels")
        drawn = edges.join(to.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
        links, edges = edges, settle(drawn.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        drop_settled(links, *([old, to] if old is not None else []))
        if edges.isEmpty():
            drop_settled(edges)
            return labels


def _links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Of all pairs of the sets that are linked, enough to connect them: at most one a set. The numbers of shared
    shingles come from products of incidence matrices, so many columns at a time."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    more = times > 1
    keep = more[col]
    row, col = row[keep], (np.cumsum(more) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        i, j = np.searchsorted(col, [c, c + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[i:j], col[i:j] - c] = 1
        both += m @ m.T
    linked = np.triu(100 * both.astype(np.int64) >= percent * (sizes[:, None] + sizes - both.astype(np.int64)), 1)
    root, out = list(range(len(sets))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in np.argwhere(linked).tolist():
        if (a := find(i)) != (b := find(j)):
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _by_cell(names: list[str], close):
    """For batches sorted by cell (the first three columns): close(rows) for each cell of more than one row, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_words_of("near duplicates")
        at, held = None, []

        def batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], pa.int64()) for x in (0, 1)], names=["a", "b"])

        for b in batches:
            out = []
            for *cell, row in zip(*(c.to_pylist() for c in b.columns[:3]), zip(*(b.column(n).to_pylist() for n in names), strict=True), strict=True):
                if cell != at:
                    out += close(held) if len(held) > 1 else []
                    at, held = cell, []
                held.append(row)
            yield batch(out)
        yield batch(close(held) if len(held) > 1 else [])

    return run


def _compare(k: int, percent: int):
    """(id, text): the links of a cell."""
    cache = _WordHashes()

    def close(rows: list[tuple]) -> list[tuple[int, int]]:
        with np.errstate(over="ignore"):
            return [(rows[i][0], rows[j][0]) for i, j in _links([shingle_set(t.encode(), k, cache) for _, t in rows], percent)]

    return _by_cell(["id", "text"], close)


def _most_apart(percent: int, bins: int) -> int:
    """Bits in which sketches of sets of this similarity differ, but once in a few million."""
    p = percent / 100
    return math.ceil(bins * (1 - p) + 5 * math.sqrt(bins * p * (1 - p) + 2 * bins * (1 - p) / 4))


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a symmetric matrix that connect what it connects: at most one a row."""
    new, out = np.ones(len(near), bool), []
    for root in range(len(near)):
        if new[root]:
            new[root], wave = False, np.array([root])
            while len(wave):
                rows = near[wave] & new
                found = np.flatnonzero(rows.any(axis=0))
                out += zip(wave[rows[:, found].argmax(axis=0)].tolist(), found.tolist(), strict=True)
                new[found], wave = False, found
    return out


def _near(percent: int, bins: int):
    """(id, n, star, bits): edges between members of a cell that lie in different components and may be linked."""
    most = _most_apart(percent, bins)

    def close(rows: list[tuple]) -> list[tuple[int, int]]:
        ids, n, star = (np.array([r[x] for r in rows], np.int64) for x in (0, 1, 2))
        bits = np.array([r[3] for r in rows], np.int64).view(_M)
        near = np.empty((len(rows), len(rows)), bool)
        for at in range(0, len(rows), 64):
            part = slice(at, at + 64)
            apart = np.bitwise_count(bits[part, None, :] ^ bits[None]).sum(axis=2, dtype=np.int16)
            low, high = np.minimum(n[part, None], n), np.maximum(n[part, None], n)
            near[part] = (100 * low >= percent * high) & ((low < SMALL) | (apart <= most)) & (star[part, None] != star)
        return [(int(ids[i]), int(ids[j])) for i, j in forest(near)]

    return _by_cell(["id", "n", "star", "bits"], close)


def _cells(nodes: DataFrame, blocks: Column) -> DataFrame:
    """nodes (comp, m, ...) once for each cell (comp, i, j) of two blocks of their cluster of m members, sorted by cell in a task."""
    n = nodes.withColumn("blocks", F.least("m", blocks).cast("int")).withColumn("own", F.pmod(F.xxhash64("id", "th"), F.col("blocks")).cast("int"))
    each = n.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *[c for c in nodes.columns if c not in ("comp", "m", "all")])


def _clustered(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes that the links join, with their cluster comp, its members m and their shingles all; others are left out."""
    of = nodes.join(components(links).withColumnRenamed("node", "id"), "id")
    return of.join(of.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("all")), "comp")


def _in_blocks(buckets: DataFrame, base: DataFrame, once: bool, shingle: int, percent: int, bins: int) -> DataFrame | None:
    """buckets (a, id, th, n, bits, star): members of buckets, of which each has a least member a, with their component so far.
    Links (a, b) that connect what is linked."""
    nodes = settle(buckets.groupBy("id", "th").agg(*[F.first(c).alias(c) for c in ("n", "bits", "star")]), "nodes")
    cells = _cells(_clustered(nodes, buckets.filter("a <> id").select("a", F.col("id").alias("b"))), F.ceil(F.col("m") / BLOCK_SKETCHES))
    dealt = cells.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    near = settle(dealt.select("comp", "i", "j", "id", "n", "star", "bits").mapInArrow(_near(percent, bins), "a long, b long"), "near")
    if near.filter("a <> b").isEmpty():
        drop_settled(nodes, near)
        return None
    left = settle(_clustered(nodes.drop("bits", "star"), near), "left")
    cells = _cells(left, F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("all") / BLOCK_SHINGLES)))
    sent = cells.join(_texts(base, settle(left.select("id", "th"), "left-ids"), once), ["id", "th"]).select("comp", "i", "j", "id", "text")
    out = settle(sent.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_compare(shingle, percent), "a long, b long"), "block-links")
    drop_settled(nodes, near, left)
    return out


def _texts(base: DataFrame, ids: DataFrame, once: bool) -> DataFrame:
    """(id, th, text) of ids (id, th; a settled table). once: no rows are alike in both."""
    found = semi(base, ids, "id", "th")
    return found if once else found.dropDuplicates(["id", "th"])


def _alike(x: str, y: str, percent: int, bins: int) -> Column:
    """Whether two members can reach the similarity: by size, and by sketches that are wrong once in a few million."""
    most = _most_apart(percent, bins)
    apart = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(SKETCH)), F.lit(0))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((F.least(n, m) < SMALL) | (apart <= most))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their shingle sets. component_id is the
    least id that links reach, kept is id_col = component_id. A null or empty text has no shingles and is linked with nothing. A
    null id is linked with nothing: component_id is null and kept is true. Rows that repeat an id are one document: what one of them
    is linked with, all are, but each is returned with the size of its own set, and an empty one with its id. A text is compared as often
    as it is long, not as often as it occurs. Other columns of docs are not looked at. No rows give no rows.
    """
    if bands * rows * 2 < SKETCH * 64:
        raise ValueError("the sketch takes two bits a bin")
    text_batches(docs.sparkSession)
    bins = bands * rows
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    sk = settle(base.mapInArrow(_sketches(shingle, bands, rows), "id long, th long, n long, lo long, hi long, keys array<long>, bits array<long>"), "sketch")
    some = sk.filter("n > 0 and id is not null")
    set_ = F.struct("lo", "hi")
    again = settle(some.groupBy("id").agg(F.count("*").alias("c"), F.min(set_).alias("x"), F.max(set_).alias("y")).filter("c > 1"), "repeated-ids")
    once = again.isEmpty()
    classes = settle(some.groupBy("lo", "hi").agg(F.min(F.struct("id", "th")).alias("rep"), F.min("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")).select("lo", "hi", "rep.*", "n", "keys", "bits"), "classes")
    # a class has a row for each band: only ids are dealt out by key, and the sketch is brought to those that share one
    cells = classes.select(F.explode("keys").alias("key"), "id", "th")
    shared = classes.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1").select("key")
    members = settle(cells.join(shared, "key").join(classes.select("id", "th", "n", "bits"), ["id", "th"]), "members")
    hubs = members.groupBy("key").agg(F.min(F.struct("id", "th", "n", "bits")).alias("h")).select("key", "h.*")
    pairs = members.alias("m").join(hubs.alias("h"), F.expr("m.key = h.key and m.id <> h.id") & _alike("m", "h", percent, bins))
    pairs = settle(pairs.select(F.col("h.id").alias("a"), F.col("h.th").alias("ath"), F.col("m.id").alias("b"), F.col("m.th").alias("bth")).distinct(), "pairs")
    # an id with several sets joins their classes
    same = some.join(again.filter("x <> y").select("id"), "id", "left_semi").join(classes.select("lo", "hi", F.col("id").alias("a")), ["lo", "hi"]).select("a", F.col("id").alias("b")).filter("a <> b")
    same = None if once else settle(same.distinct(), "same-ids")
    comps = None if same is None or same.isEmpty() else components(same)
    if not members.isEmpty():
        ends = settle(pairs.select(F.col("a").alias("id"), F.col("ath").alias("th")).union(pairs.select("b", "bth")).distinct(), "end-ids")
        need = settle(_texts(base, ends, once), "ends")  # apart from the join below, so that a hub with very many pairs is split there
        sets = pairs.join(need.select(F.col("id").alias("a"), F.col("th").alias("ath"), F.col("text").alias("x")), ["a", "ath"]).join(need.select(F.col("id").alias("b"), F.col("th").alias("bth"), F.col("text").alias("y")), ["b", "bth"])
        found = sets.select("a", "ath", "b", "x", "y").mapInArrow(_confirm(shingle, percent), "a long, b long")
        found = settle(found if same is None else found.union(same), "confirmed")
        comps = components(found)
        rest = members.join(hubs.select("key", "id", "th"), ["key", "id", "th"], "left_anti").join(comps.withColumnRenamed("node", "id"), "id", "left")
        rest = settle(rest.select("key", "id", "th", "n", "bits", F.coalesce("comp", "id").alias("star")), "rest")
        unsure = rest.groupBy("key").agg(F.min("star").alias("x"), F.max("star").alias("y"), F.min("id").alias("a")).filter("x <> y").select("key", "a")
        all_, rest = rest, settle(rest.join(unsure, "key").select("a", "id", "th", "n", "bits", "star"), "unsure")
        drop_settled(all_)
        more = None if rest.isEmpty() else _in_blocks(rest, base, once, shingle, percent, bins)
        if more is not None:
            drop_settled(comps)
            comps = components(found.union(more))
            drop_settled(more)
        drop_settled(ends, need, found, rest)
    drop_settled(members, pairs)
    of = classes.select("lo", "hi", "id")
    if comps is not None:
        of = of.join(comps.withColumnRenamed("node", "id"), "id", "left").select("lo", "hi", F.coalesce("comp", "id").alias("comp"))
    else:
        of = of.withColumnRenamed("id", "comp")
    cols = ["id", "n", "lo", "hi"]
    out = sk.filter("n > 0").select(cols).join(of, ["lo", "hi"], "left").select("id", "n", "comp")
    out = out.union(sk.filter("n = 0").select("id", "n", F.col("id").alias("comp")))  # these share one hash: they stay out of the join
    comp = F.when(F.col("id").isNotNull(), F.col("comp"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that near_duplicates() doesn't keep; rows that repeat an id stay or go together."""
    (other,) = fresh(docs, "other")
    drop = near_duplicates(docs, id_col=id_col, **options).filter("not kept").select(F.col(id_col).alias(other)).distinct()
    return docs.join(drop, docs[id_col] == drop[other], "left_anti")


#: near_duplicates() with shingles of four words, in DuckDB, by joining all shingles.
SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w
), c as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), e as (
  select x, y from p join c a on a.doc_id = x join c b on b.doc_id = y where 100 * k >= 80 * (a.n + b.n - k)
), f as (
  select x, y from e union all select y, x from e
), r(d, m) as (
  select doc_id, doc_id from documents union select r.d, f.y from r join f on f.x = r.m
), l as (
  select d, min(m) as m from r group by d
)
select doc_id, coalesce(n, 0) as n_shingles, m as component_id, doc_id = m as kept from documents left join c using (doc_id) join l on l.d = doc_id
"""
