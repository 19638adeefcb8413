import hashlib
import random
import zlib

from pyarrow import fs as pafs

from spanloom.llm import media

TEXTS = [None, "", "a", "a", "x" * 64, "é" * 32 + "y", "long " * 20_000, "x" * 63]


def test_round_trip(docs):
    got = {r["doc_id"]: r for r in media.media_columns(docs(list(enumerate(TEXTS)) + [(None, "z")])).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r["width"], r["height"], r["bit_depth"]) == (64, len(p) // 64, 8)
        m = media.to_png(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest()) and media.from_png(m) == p
    assert got[2][1:] == got[3][1:] and got[0][1:] == got[1][1:]


def slow_feature(p):
    """Sample by sample: bits of 8 x 8 block means above their mean, and shares of 16 ranges of values."""
    rows = [p[i : i + 64] for i in range(0, len(p), 64)]
    n, means = len(rows), []
    for k in range(8):
        block = rows[k * n // 8 : (k + 1) * n // 8] if n >= 8 else [rows[k * n // 8]]
        means += [sum(sum(r[8 * c : 8 * c + 8]) for r in block) / (8 * len(block)) for c in range(8)]
    middle = sum(means) / 64
    bits = sum(1 << (63 - i) for i, m in enumerate(means) if m > middle)
    return f"{bits:016x}-" + "".join(f"{sum(x >> 4 == v for x in p) * 255 // len(p):02x}" for v in range(16))


def test_feature():
    r = random.Random(1)
    for n in (64, 128, 448, 512, 576, 6400, 64 * 77):
        for pool in (b"abc", bytes(range(256))):
            p = bytes(r.choices(pool, k=n))
            assert media.feature(p) == slow_feature(p)
    assert media.feature(bytes(64)) == slow_feature(bytes(64))


def test_shards(spark, docs, tmp_path):
    """Copies share an object, shards are tar archives of a bounded size, metadata needs headers alone."""
    import io
    import tarfile

    rows, folder = media.store(docs([(i, f"text {i % 40} " * 30) for i in range(120)]).coalesce(1), folder=f"file://{tmp_path}/s", shard_bytes=5_000)
    assert rows.select("shard", "offset").distinct().count() == 40 and rows.select("shard").distinct().count() > 1
    meta = {r["digest"]: (r["width"], r["height"]) for r in media.metadata(rows, folder).collect()}
    fs, base = pafs.FileSystem.from_uri(folder)
    for info in fs.get_file_info(pafs.FileSelector(base)):
        with tarfile.open(fileobj=io.BytesIO(fs.open_input_file(info.path).read())) as t:
            for m in t.getmembers():
                payload = media.from_png(t.extractfile(m).read())
                digest = hashlib.sha256(payload).hexdigest()
                assert m.name == f"{digest}.png" and meta[digest] == (64, len(payload) // 64)


def test_empty(docs):
    assert media.media_columns(docs([])).count() == 0
