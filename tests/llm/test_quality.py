import math
import random

import numpy as np

from spanloom.llm import quality as Q

TABLE = "/root/testdata/sf0.01"


def test_em_finds_accuracies():
    r = np.random.default_rng(0)
    truth, acc = r.random(20_000) < 0.8, [0.95, 0.9, 0.8, 0.7, 0.9, 0.85, 0.6]
    votes = np.stack([np.where(r.random(20_000) < 0.3, -1, np.where(r.random(20_000) < a, truth, ~truth)) for a in acc], 1).astype(np.int8)
    p, n = np.unique([Q.pattern(v) for v in votes], return_counts=True)
    m = Q.WeakLabels(p, n.astype(float))
    assert np.abs(m.accuracy() - acc).max() < 0.03 and abs(m.share[1] - 0.8) < 0.02
    assert (Q.votes_of(p) == np.array([Q.votes_of(np.array([x]))[0] for x in p])).all()


def slow_votes(text):
    """The labellers' votes by their definition, word by word."""
    words, lines = (text or "").encode().split(), [x for x in (x.strip() for x in (text or "").encode().split(b"\n")) if x]
    n = len(words)
    if not n:
        return [-1] * 7
    known = set(b".,;:!?'\"()-")
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    loud = symbol = bare = short = near = 0
    for i, w in enumerate(words):
        letters, big = sum(map(letter, w)), sum(65 <= c <= 90 for c in w)
        core = bytes(c if c < 128 else 97 for c in w).strip(bytes(known))
        loud += letters > 1 and big == letters or bool(core) and w.endswith(b"!!")
        symbol += any(not letter(c) and not 48 <= c <= 57 and c not in known for c in core)
        bare += not letters and not any(48 <= c <= 57 for c in w)
        short += letters == len(w) <= 4
        near += w.lower() in [x.lower() for x in words[max(0, i - Q.NEAR) : i]]
    vote = lambda good, bad: 1 if good else 0 if bad else -1
    again, ended, size = len(lines) - len(set(lines)), sum(len(x) for x in lines if x[-1:] in (b".", b"!", b"?", b":", b'"', b")")), sum(map(len, lines))
    near, short, again, ends = (near + 4.5) / (n + 10), (short + 2.3) / (n + 20), (again + 0.75) / (len(lines) + 3), (ended + 156) / (size + 240)
    return [vote(symbol / n < 0.05, symbol / n > 0.15), vote(loud / n < 0.1, loud / n > 0.3), vote(bare / n < 0.02, bare / n > 0.1), vote(near < 0.4, near > 0.5), vote(short > 0.15, short < 0.08), vote(again < 0.1, again > 0.4), vote(ends > 0.8, ends < 0.5)]


def slow_posteriors(votes, rounds=200):
    """The chance of good for each row of votes, by expectation-maximisation row by row."""
    p = [[0.95, 0.4, 0.05][min(v.count(0), 2)] for v in votes]
    for _ in range(rounds):
        share = [(sum(x) + 1) / (len(votes) + 2) for x in ([1 - q for q in p], p)]
        good = []
        for w in ([1 - q for q in p], p):
            good.append([(sum(x for x, v in zip(w, votes, strict=True) if v[k] == 1) + 1) / (sum(x for x, v in zip(w, votes, strict=True) if v[k] != -1) + 2) for k in range(7)])
        new = []
        for v in votes:
            bad_, good_ = (share[c] * math.prod(good[c][k] if x == 1 else 1 - good[c][k] for k, x in enumerate(v) if x != -1) for c in (0, 1))
            new.append(good_ / (good_ + bad_))
        if max(abs(a - b) for a, b in zip(new, p, strict=True)) < 1e-9:
            break
        p = new
    return p


def test_against_brute_force(docs):
    """Votes, posteriors, the share of features and the score of each document of a small corpus."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 8)))
    kinds = [lambda w: w, lambda w: w.upper() + "!!", lambda w: w + "%%%", lambda w: "***", lambda w: "same", lambda w: r.choice(["a", "the", "12", "É", "it's"])]
    text = lambda: "\n".join(" ".join(r.choice(kinds[:1] * 6 + [k])(word()) for _ in range(r.randint(0, 15))) + r.choice([".", "", "!"]) for _ in range(r.randint(1, 9)))
    texts = []
    for _ in range(150):
        k = r.choice(kinds)
        texts.append(text())
    texts += [None, "", " \n", "x", "word " * 5000, texts[0]]
    votes = [slow_votes(t) for t in texts]
    assert [Q.look((t or "").encode())[0].tolist() for t in texts] == votes and len({tuple(v) for v in votes}) > 10
    got = sorted(Q.quality(docs(list(enumerate(texts)))).collect(), key=lambda x: x["doc_id"])
    for x, p, t in zip(got, slow_posteriors(votes), texts, strict=True):
        assert abs(x["posterior"] - p) < 1e-6 and x["n_words"] == len((t or "").split())
        assert x["keep"] == (x["score"] >= 0.5) and (x["score"] > 0) == bool((t or "").split())


def test_held_out_labels(spark):
    """No label is used in training, so all of them are held out."""
    got = {r["doc_id"]: r["keep"] for r in Q.quality(spark.read.parquet(f"{TABLE}/documents.parquet")).collect()}
    lab = spark.read.parquet(f"{TABLE}/labels.parquet").collect()
    good = [got[r["doc_id"]] for r in lab if r["quality"]]
    bad = [got[r["doc_id"]] for r in lab if not r["quality"]]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_edges(spark, docs):
    r = random.Random(1)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(60)) + "."
    rows = [(i, text()) for i in range(60)] + [(100 + i, " ".join(w.upper() + "!!" for w in text().split())) for i in range(12)]
    d = docs([*rows, (200, None), (201, ""), (202, " \n"), (None, rows[0][1]), (0, rows[0][1]), (203, "word " * 100_000)])
    got = {r["doc_id"]: r for r in Q.quality(d).collect()}
    assert all(got[i]["keep"] for i in range(60)) and not any(got[100 + i]["keep"] for i in range(12))
    assert not any(got[i]["keep"] for i in (200, 201, 202)) and got[None]["score"] == got[0]["score"]
    kept = Q.good_only(d)
    assert kept.columns == d.columns and kept.count() == sum(r["keep"] for r in Q.quality(d).collect())
    assert Q.quality(docs([])).count() == 0 and Q.good_only(docs([])).count() == 0
