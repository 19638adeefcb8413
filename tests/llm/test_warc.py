import hashlib
import io

import zstandard as z
from pyarrow import fs as pafs

from spanloom.llm import warc

BIG, OTHER = "<p>" + "same " * 300, "<p>" + "other " * 300
ROWS = [(1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, None, BIG), (2, "http://a/2 x\r\ny", "short"), (4, "http://a/4", "short"), (6, "u", None), (7, "u", ""), (8, "http://é/", OTHER), (9, "u", "é" * 500), (10, "u", "é" * 500), (11, "u", "x" * 999), (12, "u", "x" * 999), (13, "u", "y" * 200_000), (None, "u", OTHER)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id bigint, url string, html string, digest string")
    got = {r["page_id"]: r for r in warc.archive(df).collect()}
    assert len(got) == len(ROWS)
    for i, _, html in ROWS:
        raw = (html or "").encode()
        same = [j for j, _, h in ROWS if (h or "") == (html or "") and j is not None]
        top = max(same, default=None)
        again = len(raw) >= 1000 and len(same) > 1 and i is not None and i != top
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", top) if again else ("response", None))


def test_files_are_warc_with_a_leading_dictionary(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").coalesce(1)
    index, folder = warc.write(df, folder=f"file://{tmp_path}/w")
    fs, base = pafs.FileSystem.from_uri(folder)
    n = 0
    for info in fs.get_file_info(pafs.FileSelector(base)):
        data = fs.open_input_file(info.path).read()
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
        size = int.from_bytes(data[4:8], "little")
        reader = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True)
        text = reader.read()
        n += text.count(b"WARC/1.1\r\n")
        assert b"a/2%20x%0D%0Ay" in text or b"a/2" not in text
    assert n == len(ROWS) == index.count()


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "u", BIG), (2, "u", BIG), (2, "u", BIG)], "page_id bigint, url string, html string")
    assert sorted((r["page_id"], r["record_type"]) for r in warc.archive(df).collect()) == [(1, "revisit"), (2, "response"), (2, "response")]
    assert warc.archive(df.limit(0)).count() == 0
    small = warc.dictionary_of(spark.createDataFrame([(i, "u", f"<html>{i} common header and footer</html>" * 20) for i in range(3000)], "page_id bigint, url string, html string"))
    assert b"common header" in small and len(small) <= warc.DICT_BYTES
    many = [b"<html>%d common header and footer %d</html>" % (i, i) for i in range(3000)]
    assert len(warc.dictionary(many)) <= warc.DICT_BYTES and warc.dictionary([b"x"]) == b"x"


def test_long_payloads_and_clashing_names(spark):
    """A payload of 30 MB, twice; columns with names that the operator uses itself."""
    html = "".join(f"<p>{i} some text" for i in range(1_800_000))
    rows = [(1, "u", html), (2, "u", html), (3, "v", html + "x"), (3, "v", "short")]
    names = ("refers_to", "file", "offset", "length", "id", "n", "draw", "words", "record_type")
    df = spark.createDataFrame([(*r, *names) for r in rows], "page_id bigint, url string, html string, " + ", ".join(f"{n} string" for n in names))
    got = sorted(tuple(r) for r in warc.archive(df).collect())
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == sorted([(1, len(html), sha(html), "revisit", 2), (2, len(html), sha(html), "response", None), (3, len(html) + 1, sha(html + "x"), "response", None), (3, 5, sha("short"), "response", None)], key=lambda r: r[:3])
