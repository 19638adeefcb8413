import hashlib
import random

from pyspark.sql import functions as F

from spanloom.llm import linededup as L


def places(text):
    """Chunks with words in several lines, and the least runs of RUN words from and to each line with a word."""
    lines, out = text.split("\n"), set()
    v = [0, 0, *(int(hashlib.md5(x.encode()).hexdigest()[-6:], 16) for x in lines)]
    at = 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (v[i + 2] + L.BASE * v[i + 1] + L.BASE**2 * v[i]) % L.EVERY == 0:
            if sum(1 for x in lines[at : i + 1] if x.split()) > 1:
                out.add((at, i))
            at = i + 1
    said = [(i, len(x.split())) for i, x in enumerate(lines) if x.split()]
    for k in range(len(said)):
        for way in (said[k:], said[k::-1]):
            n = 0
            for i, w in way:
                n += w
                if n >= L.RUN:
                    out.add((min(i, said[k][0]), max(i, said[k][0])))
                    break
    return sorted(out)


def slow(rows):
    """id: (lines that go, the text that is left)."""
    first, gone, out = {}, {}, {}
    for d in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (d[1] or "").split("\n")
        for s, e in places(d[1] or ""):
            f, at = first.setdefault("\n".join(lines[s : e + 1]), (d, s))
            low = max(s, at + e - s + 1) if f == d else s
            gone.setdefault(d, set()).update(range(low, e + 1))
        out[d[0]] = (len(gone.get(d, ())), "\n".join(x for i, x in enumerate(lines) if i not in gone.get(d, ())))
    return out


def line(r, n, k=5):
    return " ".join("".join(r.choices("abcdefghijk", k=k)) for _ in range(n))


def corpus():
    r = random.Random(4)
    block, passage, short = [line(r, 6) for _ in range(12)], line(r, 60), line(r, 3)
    rows = [(i, "\n".join([line(r, 5) for _ in range(r.randint(0, 6))] + (block if i % 3 == 0 else []) + ([passage] if i % 4 == 0 else []) + [short] + [line(r, 4) for _ in range(3)])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, f"{passage}\n{passage}"), (104, "a\x00b\n\x00\n\x00\n\nc"), (105, "\n\n\n"), (106, "y" * 30_000), (107, "y" * 30_000), (None, rows[3][1])]
    again, small = line(r, 10), [line(r, 1) for _ in range(70)]
    rows += [(200, "\n".join([again] * 40)), (201, "\n".join([line(r, 3), *small])), (202, "\n\n".join([*small, line(r, 2)])), (203, "\n".join([*small[:60], "", line(r, 2)])), (204, " \n" + "a b " * 30 + "\n"), (205, "q\n" + "a b " * 30)]
    return [*rows, (206, "\n".join(["z " * 7] * 3 + ["long " * 40_000] + [line(r, 2) for _ in range(3000)]))]


def test_places(spark):
    texts = [t or "" for _, t in corpus()]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [sorted((p["s"], p["e"]) for p in r["p"]) for r in df.select(L.places(F.col("t")).alias("p")).collect()]
    assert got == [places(t) for t in texts]


def test_against_brute_force(docs):
    rows = corpus()
    want = slow(rows)
    got = L.deduplicated(docs(rows + rows[:5])).collect()
    assert len(got) == len(rows) + 5
    assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in got} == want
    texts = dict(rows)
    assert all(r["removed_chars"] == len(texts[r["doc_id"]] or "") - len(r["text"]) and r["n_lines"] == (texts[r["doc_id"]] or "").count("\n") + 1 for r in got)
    assert sum(w[0] > 0 for w in want.values()) > 20


def test_short_lines_in_other_surroundings(docs):
    """A passage of 3 to 8 short lines goes whole, whatever lines stand around it."""
    r, rows, want = random.Random(9), [], {}
    for p, (n, w) in enumerate([(3, 20), (4, 15), (5, 25), (6, 10), (8, 10), (7, 8)] * 5):
        passage = [line(r, w) for _ in range(n)]
        for k in (0, 1):
            i, a, b = 2 * p + k, [line(r, 7) for _ in range(3)], [line(r, 6) for _ in range(3)]
            rows.append((i, "\n".join(a + passage + b)))
            want[i] = "\n".join(a + (passage if k == 0 else []) + b)
    assert {x["doc_id"]: x["text"] for x in L.without_repeats(docs(rows)).collect()} == want


def test_stage(docs):
    rows = corpus()
    d = docs(rows + rows[:5])
    got = {}
    for x in L.without_repeats(d).collect():
        got.setdefault(x["doc_id"], set()).add((x["text"] or "", x["n_chars"]))
    for i, (gone, text) in slow(rows).items():
        if gone and not text.strip():
            assert i not in got
        else:
            assert {t for t, _ in got[i]} == {text} and {c for _, c in got[i]} <= {len(text), None}
    assert L.without_repeats(d).columns == d.columns
    assert L.deduplicated(docs([])).count() == 0 and L.without_repeats(docs([])).count() == 0


def test_lines_of_one_hash_are_told_apart(docs, monkeypatch):
    """A poor hash makes unlike lines alike; their bytes show it, and another salt is taken."""
    good, salts = L.line_hash, []
    monkeypatch.setattr(L, "line_hash", lambda x, salt: salts.append(salt) or (F.length(x).cast("long") if salt < 2 else good(x, salt)))
    rows = corpus()
    assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in L.deduplicated(docs(rows)).collect()} == slow(rows)
    assert max(salts) == 2


def test_first_of_a_null_id_and_of_one_id(docs):
    """Rows without an id, or with one id and other texts, are documents of their own."""
    r = random.Random(5)
    p = line(r, 60)
    rows = [(None, f"{p}\n{line(r, 9)}"), (None, f"{line(r, 9)}\n{p}"), (7, f"{p}\n{line(r, 8)}"), (7, f"{p}\n{line(r, 3)}")]
    got = [x["text"] for x in L.deduplicated(docs(rows)).collect()]
    assert sum(p in t for t in got) == 1 and len(got) == 4
