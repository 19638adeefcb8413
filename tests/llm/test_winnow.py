import hashlib
import random
from collections import Counter

import numpy as np

from spanloom.llm import winnow as W
from test_mixing import spark_hash


def slow(text, k=W.K, w=W.W):
    if not text:
        return []
    h = W.Winnower(k, w).grams(text).tolist()
    out = []
    for i in range(len(h) - min(w, len(h)) + 1):
        win = h[i : i + w]
        p = i + max(j for j, x in enumerate(win) if x == min(win))
        if not out or out[-1][1] != p:
            out.append((min(win), p))
    return out


def test_grams_and_windows():
    r = random.Random(0)
    texts = ["", "a", "short text", "ab" * 200, "".join(r.choices("abc é😀", k=700)), "x" * 5000]
    with np.errstate(over="ignore"):
        for k, w in ((W.K, W.W), (1, 1), (3, 4), (5, 64)):
            f = W.Winnower(k, w)
            for t in texts:
                h, at = f(t)
                assert list(zip(h.tolist(), at.tolist(), strict=True)) == slow(t, k, w)
        g = W.Winnower(5).grams("abcdefgh" * 3)
        assert g[0] == g[8] == g[16] and len(set(g.tolist())) == 8


def test_shared_runs_are_found():
    r = random.Random(1)
    word = lambda n: "".join(r.choices("abcdefghij ", k=n))
    with np.errstate(over="ignore"):
        f = W.Winnower()
        for _ in range(50):
            run = word(W.guarantee())
            a, b = word(r.randint(0, 300)) + run + word(50), word(r.randint(0, 300)) + run + word(80)
            assert set(f(a)[0].tolist()) & set(f(b)[0].tolist())


def test_documents(spark, docs):
    r = random.Random(3)
    texts = [None, "", "é", "ab", "same text " * 20, "same text " * 20, *("".join(r.choices("abcdef gh😀", k=r.randint(0, 900))) for _ in range(70)), "z" * 100_000]
    ids = r.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    got = {g["doc_id"]: g for g in W.fingerprints(docs(rows).repartition(3)).collect()}
    order = sorted(rows, key=lambda x: -x[0])
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    with np.errstate(over="ignore"):
        sets = {t or "": {h for h, _ in slow(t)} for _, t in rows if len(t or "") < 10_000} | {"z" * 100_000: set(W.Winnower()("z" * 100_000)[0].tolist())}
        for k, (i, t) in enumerate(order):
            t, n = t or "", order[(k + 1) % len(order)][1] or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + n[:half]
            g = got[i]
            assert (g["n_chars"], g["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            own = W.Winnower()(t)
            assert g["fingerprint"] == W.as_string(own[0]) and g["positions"] == own[1].tolist()
            e = W.Winnower()(edited)[0]
            assert g["edited_fingerprint"] == W.as_string(e)
            assert abs(g["near_edited"] - like(sets[t], set(e.tolist()))) < 1e-12 and abs(g["near_next"] - like(sets[t], sets[n])) < 1e-12


def test_edges(docs):
    one = W.fingerprints(docs([(1, "abcdef")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    rows = [(1, "aa"), (1, "bb"), (None, "cc"), (2, "dd")]
    got = {(g["doc_id"], g["fingerprint"]) for g in W.fingerprints(docs(rows)).collect()}
    assert len(got) == 4 and W.fingerprints(docs([])).count() == 0


def test_an_id_with_most_rows(docs):
    """Rows without an id and of one id, copies among them: many ranges, in the order of a hash of their texts."""
    r = random.Random(4)
    texts = ["".join(r.choices("abcdef gh", k=r.randint(0, 120))) for _ in range(260)]
    rows = [(None if i < 150 else 7 if i < 220 else 1000 + i, t) for i, t in enumerate(texts)] + [(None, texts[0])] * 5 + [(7, texts[160])] * 3
    d = docs(rows).repartition(3)
    sizes = sorted(x["count"] for x in W.with_previous(d, "doc_id", "text").filter("not context").groupBy("bucket").count().collect())
    assert len(sizes) >= 3 and sizes[-1] < 0.45 * len(rows)
    order = sorted(rows, key=lambda x: (-(1 << 63) if x[0] is None else x[0], spark_hash(x[1]), x[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        edited = t[: len(t) - half] + order[k - 1][1][:half]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((g["doc_id"], g["n_chars"], g["edited_sha256"]) for g in W.fingerprints(d).collect()) == want
