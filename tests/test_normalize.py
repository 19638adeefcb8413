import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T

KW = lambda *p: [("KEYWORD_MAPPING", a, b) for a, b in p]
SP = lambda *p: [("SPECIAL_CHAR", a, b) for a, b in p]

CASES = [
    ("upper case", "The ferry leaves soon", [], "THE FERRY LEAVES SOON"),
    ("a word for another", "Fee of Kr. 20 at the pier", KW(("Kr.", "NOK"), ("KR.", "NOK")), "FEE OF NOK 20 AT THE PIER"),
    ("several words, in order", "Fee of Kroner 20 for P/O 7", KW(("Kr.", "NOK"), ("Kroner", "Kr."), ("P/O", "ORDER")), "FEE OF KR. 20 FOR ORDER 7"),
    ("an earlier word's result is replaced too", "Kr. 5", KW(("Kr.", "NOK"), ("NOK", "COIN")), "COIN 5"),
    ("inside of words", "UNPIERED", KW(("pier", "x")), "UNXED"),
    ("a mark between digits", "Due: 03/04/2031", SP(("/", "-")), "DUE: 03-04-2031"),
    ("but not elsewhere", "P/O number", SP(("/", "-")), "P/O NUMBER"),
    ("places don't overlap", "7/8/9", SP(("/", "-")), "7-8/9"),
    ("a mark that goes", "9,876,543.21", SP((",", "")), "9876543.21"),
    ("null", None, [], ""),
    ("empty", "", [], ""),
    ("blanks in rows and at the ends", "  The   long  pier ", [], "THE LONG PIER"),
    ("blanks left by a word", "Fee  Kr.  20  due", KW(("Kr.", "NOK")), "FEE NOK 20 DUE"),
    ("what isn't ASCII is one blank", "pi\u00e9\u00e9r", [], "PI R"),
    ("control characters", "\x01a\t\nb\x02", [], "A B"),
]


@pytest.mark.parametrize(("text", "rules", "expected"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_normalize(spark, text, rules, expected):
    pairs = lambda kind: F.array(*[F.struct(F.lit(a).alias("key"), F.lit(b).alias("value")) for k, a, b in rules if k == kind]).cast("array<struct<key:string,value:string>>")
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(T.normalize(F.col("t"), rules).alias("x"), T.normalize_by(F.col("t"), pairs("KEYWORD_MAPPING"), pairs("SPECIAL_CHAR")).alias("y")).first()
    assert got["x"] == got["y"] == expected


def slow_foreign(t: str) -> bool:
    units = [int.from_bytes(t.encode("utf-16-le", "surrogatepass")[i : i + 2], "little") for i in range(0, 2 * len(t.encode("utf-16-le")) // 2, 2)]
    letters = sum(not 0xD800 <= u <= 0xDFFF and chr(u).isalpha() for u in units)
    return bool(letters) and sum(u > 127 for u in units) / letters > 0.3


@pytest.mark.parametrize("text", ["plain text", "привет", "abcdefgééé", "abcdefgéééé", "12345 !!", "a😀", "abcdefghij😀", "𝒜bc", ""])
def test_language_gate(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(T.non_english(F.col("t")).alias("x"))
    assert df.first()["x"] == slow_foreign(text)


def test_anchor_patterns(spark):
    from spanloom.operators import engine

    texts = ["MELON SOLD ON 03", "FOR NO17", "AT, 1,2 , 3", "ONON ON", "XON", "A.B ON9", ""]
    for token in ("on", "FOR NO", ",", "AT", "."):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = {r["t"]: (r["a"], r["b"]) for r in df.select("t", T.anchor_at(F.col("t"), token).alias("a"), T.anchor_at(F.col("t"), token, matching=True).alias("b")).collect()}
        assert got == {t: (engine.find_anchor(t, token, 0), engine.find_anchor(t, token, 0, matching=True)) for t in texts}
