import re

from pyspark.sql import functions as F

from spanloom.operators import candidates as C
from spanloom.operators import rules, spans

TEXTS = ["A 12 B 345", "", "7", "NO", "1.5 22.75 X1", "INR 5 AND INR 66"]


def test_regex_spans_have_places(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for p in ("[0-9]+", r"[0-9]+(?:\.[0-9]+)?", "(?<=INR )[0-9]+", "[A-Z]+$"):
        got = {r["t"]: [tuple(s) for s in r["s"]] for r in df.select("t", spans.regex_spans(F.col("t"), F.lit("N"), F.lit(p)).alias("s")).collect()}
        assert got == {t: [("N", m[0], *m.span()) for m in re.finditer(p, t)] for t in TEXTS}


def test_odd_patterns(spark):
    e = spark.createDataFrame([("s", 0, "A", "REGEX", [("[0-9]+", 0), ("[", 0), ("x*", 0), ("(a)", 2), ("(a)", 1)], [])], "sender_id string, ord int, name string, rule_type string, regex_variants array<struct<regex:string,grp:int>>, boundary_pairs array<struct<start_after:string,end_before:string,max_tokens:int>>")
    bad, empty = rules.odd_patterns(spark, e)
    assert sorted(bad) == [("(a)", 2), ("[", 0)] and empty == ["x*"]
    got = rules.compile_entities(spark, e).first()["entities"][0]["regex_variants"]
    assert [tuple(v) for v in got] == [("[0-9]+", 0), ("x*", -1), ("(a)", 1)]


def test_product_and_subsets(spark):
    df = spark.createDataFrame([([["a", "b"], ["x"], ["1", "2"]],), ([["z"]],)], "s array<array<string>>")
    got = [["".join(c) for c in r["p"]] for r in df.select(C.product(F.col("s")).alias("p")).collect()]
    assert got == [["ax1", "ax2", "bx1", "bx2"], ["z"]]
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],), (["a", "b"],)], "s array<string>")
    got = [["".join(c) for c in r["p"]] for r in df.select(C.proper_subsets(F.col("s")).alias("p")).collect()]
    assert got == [["a", "b", "ab", "c", "ac", "bc"], [], [], ["a", "b"]]


def test_islands(spark):
    df = spark.createDataFrame([("m", "n", s, e, i, str(i)) for i, (s, e) in enumerate([(0, 5), (3, 7), (7, 9), (8, 12)])], "msg_id string, name string, st int, en int, ord int, value string")
    assert [r["island"] for r in spans.overlap_islands(df).orderBy("st").collect()] == [0, 0, 1, 1]


def test_table_function(spark):
    import json

    spans.register_extract(spark)
    rules_json = json.dumps([{"name": "A", "rule_type": "REGEX", "regex_variants": [{"regex": "[0-9]+", "grp": 0}]}, {"name": "M", "rule_type": "BOUNDARY_HINT", "boundary_pairs": [{"start_after": "AT", "end_before": "ON", "max_tokens": 3}]}])
    df = spark.createDataFrame([("INR 5 AT SHOP ON",)], "t string").crossJoin(spark.createDataFrame([(rules_json,)], "r string"))
    df.createOrReplaceTempView("one_message")
    got = [tuple(r) for r in spark.sql("select x.* from one_message, lateral extract_spans(t, r) x").collect()]
    assert got == [(0, "A", "5", 4, 5), (0, "M", "SHOP", 9, 13), (1, "A", "5", 4, 5)]
