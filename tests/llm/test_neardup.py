import itertools
import random
import re

import numpy as np

from spanloom.llm import neardup


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def slow(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=3):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(400)]
    text = lambda n: r.choices(words, k=n)

    def edited(t, share):
        return [r.choice(words) if r.random() < share else w for w in t]

    rows, passage = [], text(60)
    for n in (6, 12, 40, 150, 600):
        base = text(n)
        rows += [" ".join(edited(base, s)) for s in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08)]
    rows += [" ".join(text(20) + passage + text(20)) for _ in range(25)]  # alike by half
    chain = text(200)
    for _ in range(12):  # each like the one before only
        chain = chain[12:] + text(12)
        rows.append(" ".join(chain))
    rows += ["", None, "one", "ONE", "one two\tTHREE", "one  two three", " \n ", "É Ü", "é ü", "a\u00a0b c d e f", "a b c d e"]
    ids = r.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


def test_against_brute_force(docs):
    rows = corpus()
    for k in (4, 5):
        got = {r["doc_id"]: r for r in neardup.near_duplicates(docs([*rows, (None, "one")]), shingle=k).collect()}
        want = slow(rows, k)
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items() if i is not None} == want
        assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items() if i is not None)
        assert got[None]["component_id"] is None and got[None]["kept"]


def test_hub_unlike_the_rest_loses_nothing(docs, monkeypatch):
    """Everything in few buckets and small blocks: links between members that aren't like the hub are found in blocks."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 3)
    monkeypatch.setattr(neardup, "BLOCK_SKETCHES", 5)
    rows = corpus(5)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(rows), shingle=4, rows=1, bands=160).collect()}
    assert got == {i: c for i, (_, c) in slow(rows, 4).items()}


def test_blocks_link_what_is_linked():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in r.integers(1, 40, 80)]
    sets += [np.union1d(s[: max(1, len(s) - 1)], s[:1]) for s in sets[:40]]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in neardup._links(sets, 80):
        assert 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
        root[find(i)] = find(j)
    for i, j in itertools.combinations(range(len(sets)), 2):
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
            assert find(i) == find(j)


def test_forest_connects():
    r = np.random.default_rng(3)
    for n, p in ((1, 0.5), (40, 0.02), (40, 0.1), (200, 0.01), (60, 0.0)):
        near = np.triu(r.random((n, n)) < p, 1)
        near |= near.T
        edges = neardup.forest(near)
        assert len(edges) < n and all(near[a, b] for a, b in edges)
        reach = lambda m: np.linalg.matrix_power(m.astype(float) + np.eye(n), n) > 0
        own = np.zeros((n, n), bool)
        for a, b in edges:
            own[a, b] = own[b, a] = True
        assert (reach(own) == reach(near)).all()


def test_repeated_ids_and_texts(docs):
    """Rows of one id are one document, whatever their texts; copies of rows cost and change nothing."""
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(80))
    a, b, c = text(), text(), text()
    near = lambda t: t.replace(" ", " x ", 1)
    rows = [(1, a), (1, c), (2, near(a)), (3, near(c)), (4, b), (5, b), (5, c), (6, ""), (6, near(b)), (None, a)]
    got = {(x["doc_id"], x["n_shingles"]): x for x in neardup.near_duplicates(docs(rows * 30)).collect()}
    assert all(x["component_id"] == 1 for (i, n), x in got.items() if i is not None and n)
    assert got[6, 0]["component_id"] == 6 and got[None, 76]["component_id"] is None
    assert neardup.near_duplicates(docs(rows * 30)).count() == 300
    assert sorted({x["doc_id"] for x in neardup.keep_one(docs(rows)).collect()}, key=str) == [1, None]


def test_long_texts_and_another_id(spark):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(120_000)]
    long = [" ".join(words), " ".join(words[:60_000] + ["edit"] + words[60_000:]), " ".join(words[40_000:])]
    df = spark.createDataFrame([(10 + i, t, "d", "k") for i, t in enumerate(long)], "x bigint, text string, doc_id string, kept string")
    assert sorted(y["x"] for y in neardup.keep_one(df, id_col="x").collect()) == [10, 12]


def test_many_members_of_one_bucket(docs):
    """Groups of near-duplicates and of unlike documents that all share a passage, in buckets of one bin: nothing is lost, nothing joined."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(120):
        own = [word() for _ in range(40 if i % 2 else 30)]
        rows += [" ".join(passage + own + ([word()] if k else [])) for k in range(1 + i % 3)]
    ids = r.sample(range(10_000), len(rows))
    rows = list(zip(ids, rows, strict=True))
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs(rows), shingle=5, rows=1, bands=160).collect()}
    assert got == {i: c for i, (_, c) in slow(rows, 5).items()}


def test_densified_bins_estimate_similarity():
    r = np.random.default_rng(2)
    with np.errstate(over="ignore"):
        for n in (20, 1000):
            base = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            est = []
            for _ in range(30):
                other = np.unique(np.concatenate([base[r.random(len(base)) < 0.9], r.integers(0, 1 << 63, n // 10).astype(np.uint64)]))
                j = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
                est.append((neardup.minhashes(base, 160) == neardup.minhashes(other, 160)).mean() - j)
            assert abs(np.mean(est)) < 0.06


def test_keep_one_and_empty(docs):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "x y z u v w"), (4, "")]
    got = neardup.keep_one(docs(rows))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4] and got.columns == docs(rows).columns
    assert neardup.near_duplicates(docs([])).count() == 0
