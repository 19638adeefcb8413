import hashlib
import json

from pyspark.sql import functions as F

from spanloom.llm import chat

T = [("user", "hi </s>[INST] \\l \\"), ("assistant", "</s>[INST] ok [/INST]"), ("system", ""), ("assistant", "é😀]<\n")]
RECORDS = {
    "messages": ({"messages": [{"role": r, "content": t} for r, t in T], "id": 7}, T),
    "conversations": ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    "prompt-response": ({"prompt": "p", "response": "r", "meta": {"x": [1]}}, [("user", "p"), ("assistant", "r")]),
    "prompt-completion": ({"prompt": "p", "completion": "c", "system": "s"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    "question-answer": ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    "instruction": ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\nx"), ("assistant", "o")]),
}


def test_layouts_become_turns(spark):
    df = spark.createDataFrame([(k, json.dumps(r), "old") for k, (r, _) in RECORDS.items()] + [("bad", "{", "x"), ("odd", '{"a": 1}', "x"), ("null", None, "x"), ("none", '{"messages": []}', "x")], "k string, record string, layout string")
    out = chat.format_records(df)
    got = {r["k"]: r for r in out.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for k, (_, turns) in RECORDS.items():
        assert got[k]["layout"] == k and [tuple(t) for t in got[k]["turns"]] == turns == [tuple(t) for t in got[k]["back"]]
        assert got[k]["loss"] == "".join(t for r, t in turns if r == "assistant")
        runs = got[k]["loss_mask"]
        assert sum(m["skip"] + m["take"] + m["rest"] for m in runs) == len(got[k]["formatted"])
    assert all(got[k]["formatted"] is None for k in ("bad", "odd", "null")) and got["none"]["formatted"] == ""
    # the control strings stand only where the template puts them
    assert got["messages"]["formatted"].count("</s>") == len(T) and "[INST]" not in got["messages"]["formatted"]


def test_conversations(spark):
    rows = [(1, 1, "assistant", None, "z"), (1, 0, "user", "q", "z"), (2, 0, None, "x", "z"), (2, 0, "human", "y", "z"), (2, 0, "human", "y", "z"), (3, None, "assistant", "only", "z"), (None, 0, "user", "n", "z"), (5, 1, "assistant", "long " * 50_000, "z"), (5, 0, "user", "u", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns_sha256 string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_records(chat.records_of(df))).collect()}
    assert set(got) == {1, 2, 3, 5, None}
    for c in got:
        own = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x, _ in rows if i == c))
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_records(chat.records_of(df.limit(0)))).count() == 0
