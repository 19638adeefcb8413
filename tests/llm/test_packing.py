import bisect
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanloom.llm import packing as P

ODD = ["it's DON'T we're ÀÉ 12345 naïve <|endoftext|> İstanbul ΣΑΣ 日本語 a'll'd\x1cb", "", "   ", "Straße, ÇA. don't. foo's! x<|endoftext|> a_b_ ... #é# È! 한국어. ǅ, ﬁx. o're. d'", "a\x01b c \x01 d", "zz\u00a0yy \u2003 qq", "\u0301abc \u0301x e\u0301,", "w" * 300 + ".", None]


def test_ids_are_the_tokenizers():
    t = Tokenizer.from_file(P.public_tokenizer())
    w = P.WordIds(t)
    for _ in range(2):
        for x in ODD:
            want = t.encode(x or "", add_special_tokens=False).ids
            assert np.frombuffer(w.ids((x or "").encode()), "<u4").tolist() == want


def test_ids_of_letters_of_all_scripts():
    """Each letter and combining mark of Unicode, with marks behind it, and all pairs of the letters that are put together."""
    t = Tokenizer.from_file(P.public_tokenizer())
    w = P.WordIds(t)
    letters = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c))[0] in "LM"]
    plain = [c for c in letters if w.plain(c.encode())]
    words = [f"b{c}{m}" for c in letters for m in (".", ",a", "'s", '"-')] + ["হয়,", "क़लम,", "ਲ਼.", "İ."] + [a + b for a in plain for b in plain]
    for i in range(0, len(words), 4000):
        x = " ".join(words[i : i + 4000])
        assert w.ids(x.encode()) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    r = random.Random(1)
    pool = plain + list("abcXYZ.,'!_") + r.sample(letters, 2000)
    for _ in range(1500):
        x = " ".join("".join(r.choices(pool, k=r.randint(1, 6))) + r.choice([".", ",", "!?", "_", ")", "-x", '"', "'s", ""]) for _ in range(8))
        assert np.frombuffer(w.ids(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def check(lengths, runs, capacity):
    seen, bins = Counter(), {}
    for length, first, n, seq, offset, each in runs.tolist():
        for i in range(n):
            seen[length, first + i] += 1
            bins.setdefault(seq + i // each, []).append((offset + i % each * length, length))
    assert dict(seen) == {(k, i): 1 for k, n in Counter(lengths).items() for i in range(n)}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * x > capacity for _, x in b) <= 2
    return len(bins)


@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
@settings(max_examples=300, deadline=None)
def test_plan_is_a_packing(case):
    capacity, lengths = case
    n = check(lengths, P.plan(Counter(lengths), capacity), capacity)
    assert n <= 2 * -(-sum(lengths) // capacity) or not lengths  # any best fit is within this


def item_by_item(lengths, capacity):
    """The number of sequences: the same matching of large items, piece by piece, then each smaller piece to the smallest gap that takes it."""
    large, gaps = sorted(x for x in lengths if 3 * x > capacity), []
    while large:
        a = large.pop()
        k = bisect.bisect_right(large, capacity - a) - 1
        gaps.append(capacity - a - (large.pop(k) if k >= 0 else 0))
    gaps.sort()
    for s in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        k = bisect.bisect_left(gaps, s)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        bisect.insort(gaps, gap - s)
    return gaps


def test_plan_is_best_fit():
    """The gaps that are left are those that best fit leaves, piece by piece."""
    r = random.Random(4)
    cases = [({3096: 10, 300: 15}, 4096), ({252: 13, 2632: 14, 482: 10, 1030: 7, 389: 10}, 4096)]
    for _ in range(3000):
        c = r.choice([7, 30, 100, 4096])
        cases.append(({r.randint(1, c): r.randint(1, 15) for _ in range(r.randint(1, 8))}, c))
    for counts, c in cases:
        lengths = [k for k, n in counts.items() for _ in range(n)]
        runs = P.plan(counts, c)
        used = Counter()
        for length, _, n, seq, _, each in runs.tolist():
            for i in range(n):
                used[seq + i // each] += length
        assert sorted(c - x for x in used.values()) == item_by_item(lengths, c)


def test_plan_is_tight():
    r = random.Random(0)
    lengths = [min(4096, int(r.lognormvariate(6, 1))) + 1 for _ in range(20_000)]
    lengths = [min(x, 4096) for x in lengths]
    assert check(lengths, P.plan(Counter(lengths)), 4096) <= 1.005 * sum(lengths) / 4096 + 1


def test_documents(spark, docs):
    t = Tokenizer.from_file(P.public_tokenizer())
    r = random.Random(2)
    texts = [*ODD, *(" ".join(r.choices(["alpha", "beta", "gamma,"], k=r.randint(0, 400))) for _ in range(60)), "delta " * 9000, "delta " * 4095, "delta " * 4096]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "x")]
    got = P.pack_documents(docs(rows)).collect()
    want = Counter()
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
    by = {}
    for g in got:
        by.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for b in by.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == len(item_by_item([g["length"] for g in got], 4096))
    assert P.pack_documents(docs([])).count() == 0
