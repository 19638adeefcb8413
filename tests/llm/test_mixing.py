import math
import struct

import xxhash
from pyspark.sql import functions as F

from spanloom.llm import mixing


def rows():
    sizes = {"big": 300, "mid": 60, "small": 12, None: 5}
    out, i = [], 0
    for s, n in sizes.items():
        for k in range(n):
            out.append((i, "w " * (20 + k % 7), s))
            i += 1
    return [*out, (i, None, "blank"), (i + 1, "", "blank")]


def test_weights_meet_the_target(docs):
    src, _ = mixing.weights(docs(rows()), entropy=0.8, repeats=None)
    p = {r["key"]: r for r in src.collect()}
    q = [r["weight"] for r in p.values() if r["tokens"]]
    assert abs(sum(q) - 1) < 1e-9 and abs(-sum(x * math.log(x) for x in q) / math.log(len(q)) - 0.8) < 1e-5
    shares = {k: r["tokens"] / sum(x["tokens"] for x in p.values()) for k, r in p.items()}
    e = [math.log(p[k]["weight"] / p["=big"]["weight"]) / math.log(shares[k] / shares["=big"]) for k in ("=mid", "=small", "null")]
    assert max(e) - min(e) < 1e-9  # one exponent for all
    assert min(r["epochs"] for r in p.values()) == 1.0


def test_repetition_limit_and_schedule(docs):
    got = mixing.schedule(docs(rows()), entropy=0.999, repeats=3.0, block_docs=16)
    n = {(r["source"]): r for r in got.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.max("epoch").alias("e")).collect()}
    assert n["big"]["n"] == n["big"]["d"] == 300 and n[None]["d"] == 5 and n[None]["e"] <= 2 and n["blank"]["n"] == 2
    assert abs(n[None]["n"] - 15) <= 1 and n["mid"]["d"] == 60 and n["mid"]["n"] > 60
    full = got.groupBy("source", "epoch", "block").agg(F.sort_array(F.collect_list("position")).alias("p")).collect()
    assert all(r["p"] == list(range(len(r["p"]))) for r in full)
    orders = [[r["id"] for r in got.filter(f"source = 'mid' and epoch = {e} and block = 0").orderBy("position").collect()] for e in (0, 1)]
    assert set(orders[1]) <= set(orders[0]) and orders[0][: len(orders[1])] != orders[1]


def spark_hash(*values):
    """Spark's xxhash64: each value is hashed with the last hash as the seed; a pair is an int."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def slow_weights(tokens, entropy, repeats):
    """source: weight, by bisection on the exponent for all sources with tokens."""
    t = {k: n for k, n in tokens.items() if n}
    total = sum(t.values())

    def at(e):
        raw = {k: (n / total) ** e for k, n in t.items()}
        z = sum(raw.values())
        return {k: x / z for k, x in raw.items()}

    share = lambda w: -sum(x * math.log(x) for x in w.values()) / math.log(len(w))
    lo, hi = 0.0, 1.0
    if share(at(1.0)) < entropy:
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if share(at(mid)) >= entropy else (lo, mid)
    else:
        lo = 1.0
    ratio = max(t.values()) / min(t.values())
    if repeats is not None and ratio ** (1 - lo) > repeats:
        lo = 1 - math.log(repeats) / math.log(ratio)
    return at(lo)


def slow_schedule(rows, epochs, weights, seed, block_docs):
    """(id, source, epoch, block, position, n_tokens) of every unit, by the definition."""
    units = {(i, s, t or "") for i, t, s in rows}
    out = []
    for src in {s for _, s, _ in units}:
        key = "null" if src is None else f"={src}"
        own = [(i, spark_hash("null" if i is None else str(i), key, t), sum(len(t.split()) for j, t2, s2 in rows if (j, s2, t2 or "") == (i, src, t))) for i, s, t in units if s == src]
        blocks = -(-len(own) // block_docs)
        for e in range(max(math.ceil(epochs[key]), 1)):
            part = min(1.0, epochs[key] - e)
            for b in range(blocks):
                here = sorted((x for x in own if spark_hash((seed,), x[1], "block") % blocks == b), key=lambda x: (spark_hash((seed,), (e,), x[1]), x[1]))
                whole, upto = sum(x[2] for x in here), 0
                for at, (i, _, n) in enumerate(here):
                    upto += n
                    first = upto - n * (1 - spark_hash((seed,), key, (e,), b) % (1 << 30) / (1 << 30))
                    if part >= 1 or n and first < part * whole:
                        out.append((i, src, e, b, at, n))
    return out


def test_against_brute_force(docs):
    """Weights and every row of the schedule, with hot, small and blank sources, a null source, a null id, repeated rows and a very long text."""
    data = [*rows(), (None, "x y z", "mid"), (0, "w " * 20, "big"), (1, "other text", "big"), (900, "long " * 50_000, "small")]
    units = {(i, t or "", s) for i, t, s in data}
    tokens = {}
    for i, t, s in data:
        tokens["null" if s is None else f"={s}"] = tokens.get("null" if s is None else f"={s}", 0) + len((t or "").split())
    for options in ({"entropy": 0.9, "repeats": None}, {"entropy": 0.97, "repeats": 3.0}, {"entropy": 0.9, "repeats": 2.5, "budget": 150_000}):
        src = {r["key"]: r for r in mixing.weights(docs(data), block_docs=16, **options)[0].collect()}
        want = slow_weights(tokens, options["entropy"], options["repeats"])
        assert all(abs(src[k]["weight"] - w) < 1e-6 for k, w in want.items()) and sum(r["docs"] for r in src.values()) == len(units)
        got = mixing.schedule(docs(data), block_docs=16, seed=3, **options).collect()
        slow = slow_schedule(data, {k: r["epochs"] for k, r in src.items()}, want, 3, 16)
        plain = lambda x: sorted(map(tuple, x), key=str)
        assert plain((r["id"], r["source"], r["epoch"], r["block"], r["position"], r["n_tokens"]) for r in got) == plain(slow)


def test_a_budget_beyond_a_limit_goes_to_the_others(docs):
    """Sources that the budget would repeat too often stay at the limit; the rest makes up the budget."""
    data = rows()
    tokens = sum(len((t or "").split()) for _, t, _ in data)
    for budget in (tokens // 2, tokens, int(1.6 * tokens), int(1.9 * tokens)):
        src = [r for r in mixing.weights(docs(data), entropy=0.99, repeats=2.0, budget=budget)[0].collect() if r["tokens"]]
        assert abs(sum(r["epochs"] * r["tokens"] for r in src) - budget) < 1e-4 * budget and max(r["epochs"] for r in src) <= 2.0
        free = [r["epochs"] * r["tokens"] / r["weight"] for r in src if r["epochs"] < 2.0]
        assert max(free) - min(free) < 1e-6 * max(free)
    assert {r["epochs"] for r in mixing.weights(docs(data), repeats=2.0, budget=10 * tokens)[0].collect() if r["tokens"]} == {2.0}


def test_budget(docs):
    got = mixing.schedule(docs(rows()), entropy=0.8, repeats=None, budget=4000, block_docs=16)
    assert abs(got.agg(F.sum("n_tokens")).first()[0] - 4000) < 250


def test_mixed_rows_and_edges(docs):
    d = docs(rows() + [(0, "w " * 20, "big")])
    got = mixing.mixed(d, entropy=0.9, repeats=2.0)
    assert got.columns == d.columns and got.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()
    assert got.filter("doc_id = 0").count() == 2
    assert mixing.schedule(docs([])).count() == 0 and mixing.mixed(docs([])).count() == 0
    assert mixing.schedule(docs([(1, "a b", "one")])).count() == 1
    assert mixing.schedule(docs([(1, "", "one"), (2, None, "two")])).count() == 2
