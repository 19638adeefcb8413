import numpy as np

from spanloom.llm import quality as Q


def test_whole_texts_are_seen():
    """The features of a long text cover each of its words: a word that follows itself once in 9,000 words, and a rare one."""
    text = " ".join(f"w{i % 700}" for i in range(9000)).split(" ")
    text[4501:4501] = ["twice", "twice"]
    ids, times = Q.features(Q.look(" ".join(text).encode())[2])
    have = dict(zip(ids.tolist(), times.tolist(), strict=True))
    assert sum(have.values()) == 2 * len(text) and have[Q._AGAIN] == 1 and have[Q._describe(b"twice") & 0xFFFF] == 2
    assert Q.features(Q.look(b"again " * 200_000)[2])[1].max() >= 199_999


def test_fit_takes_shares():
    rows = [Q.features(Q.look((w * n).encode())[2]) for w, n in (("good word. ", 3), ("good word. ", 3000), ("BAD!! ", 4), ("BAD!! ", 4000))]
    w, b = Q.fit(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.int64), np.array([len(r[0]) for r in rows]), np.array([1.0, 1.0, 0.0, 0.0]))
    score = Q.Scorer(None, w, b)
    z = [score(i.tobytes(), n.tobytes())[0] for i, n in rows]
    assert min(z[:2]) > 0.5 > max(z[2:])


def test_null_ids_are_drawn_one_by_one(docs, monkeypatch):
    """Rows without an id don't share a draw: the sample holds about as many as it should, and those alike count once."""
    sizes, fit = [], Q.fit
    monkeypatch.setattr(Q, "fit", lambda ids, times, n, target: sizes.append(len(n)) or fit(ids, times, n, target))
    rows = [(None, f"This is the text of the document number {i}, and it ends here.") for i in range(300)]
    Q.quality(docs(rows + rows[:100]), sample=60)
    Q.quality(docs(rows[:1] * 50), sample=10)
    Q.quality(docs([(i, " ") for i in range(200)] + rows[:1]), sample=2)
    assert 30 < sizes[0] < 100 and sizes[1:] == [1, 1]
