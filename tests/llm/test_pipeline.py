"""The pipeline on a small corpus against the operators' brute-force counterparts, stage by stage."""

import random

import corpus_pipeline
from test_neardup import slow as near_slow


def corpus():
    r = random.Random(6)
    words = ["".join(r.choices("abcdefghijkl", k=r.randint(2, 8))) for _ in range(3000)]
    sentence = lambda n: " ".join(r.choices(words, k=n)) + "."
    text = lambda: "\n".join(sentence(r.randint(5, 40)) for _ in range(r.randint(2, 8)))
    rows = [(i, text(), f"s{0 if i % 3 else i % 7}") for i in range(150)]
    passage = sentence(70)
    rows += [(200 + i, text() + "\n" + passage + "\n" + text(), "s1") for i in range(10)]
    near = sentence(300).split(" ")
    rows += [(300 + i, " ".join(near[: 10 * i] + ["edit"] + near[10 * i + 1 :]), "s2") for i in range(6)]
    rows += [(400 + i, " ".join(w.upper() + "!!" for w in text().split()), "s3") for i in range(15)]
    return rows


def test_stages(spark, docs):
    d, out = docs(corpus()), {}
    for name, stage in corpus_pipeline.STAGES:
        before = d
        d = stage(spark, before, None).persist()
        out[name] = d
        if name != corpus_pipeline.STAGES[-1][0]:
            assert d.columns == before.columns
    ids = {n: {r["doc_id"] for r in x.select("doc_id").collect()} for n, x in out.items()}
    q = ids["quality_classifier"]
    assert not q & set(range(400, 415)) and set(range(150)) | set(range(200, 210)) | set(range(300, 306)) <= q
    assert ids["line_dedup"] == q
    texts = {r["doc_id"]: r["text"] for r in out["line_dedup"].collect()}
    passage = corpus()[155][1].split("\n")
    longest = max((x for x in passage), key=len)
    assert sum(longest in texts[200 + i] for i in range(10)) == 1
    near = near_slow(list(texts.items()), 5)
    assert ids["minhash_near_dedup"] == {i for i, (_, c) in near.items() if c == i}
    assert ids["source_mixing"] == ids["minhash_near_dedup"] == ids["best_fit_packing"]
    assert out["source_mixing"].count() > out["minhash_near_dedup"].count()
    assert out["best_fit_packing"].count() == out["source_mixing"].count()


def test_odd_rows_and_clashing_names(spark):
    """Nulls in every column, blank and very long texts, repeated rows, one id with two texts, extra columns with names that stages use."""
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghijkl", k=r.randint(2, 8))) for _ in range(2000)]
    text = lambda n=60: "\n".join(" ".join(r.choices(words, k=r.randint(5, 20))) + "." for _ in range(max(1, n // 12)))
    names = ("score", "posterior", "seen", "draw", "scored", "row_key", "row_id", "gone_lines", "seen_lines", "id", "th", "k", "key", "other", "times", "turn", "plan_key", "plan_id", "kept", "component_id", "n", "length", "salt", "rank")
    keep = text()
    rows = [(i, text(), "en", f"s{i % 3}", 1) for i in range(40)] + [(50, keep, None, None, None)] * 4
    rows += [(None, text(), None, "s1", None), (None, None, None, None, None), (60, "", "en", "s1", 0), (61, " \n ", "en", "s1", 3), (62, text(), "en", "s2", 7), (62, text(), "en", "s2", 7), (63, text(60_000), "en", "s0", 9)]
    d = spark.createDataFrame([(*x, *names) for x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, stage(spark, d, None).persist()
        got = d.collect()
        if name == "best_fit_packing":
            break
        assert d.columns == before.columns and all(tuple(x[n] for n in names) == names for x in got)
        ids = [x["doc_id"] for x in got]
        assert set(range(40)) <= set(ids) and {50, 62, 63} <= set(ids) and not {60, 61} & set(ids) and None in ids
        assert all((x["text"] or "").strip() for x in got)
        if name == "quality_classifier":
            assert ids.count(50) == 4 and ids.count(62) == 2 and len([x for x in got if x["doc_id"] == 63][0]["text"]) > 100_000
        if name == "source_mixing":
            assert ids.count(50) >= 4 and len(got) >= 48
    assert {x["doc_id"] for x in got} == set(ids) and all(x["length"] <= 4096 for x in got)


def test_empty(spark, tmp_path, docs):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_run_leaves_only_its_stages(spark, tmp_path, docs):
    """What stages write for themselves is removed; each stage's result stays."""
    from pathlib import Path

    from spanloom.sources.tables import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    docs(corpus()[:40]).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 40
    left = sorted(p.name.split("-")[1] for p in set(folder.iterdir()) - before)
    assert left == sorted(name for name, _ in corpus_pipeline.STAGES)
