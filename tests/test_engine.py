"""Extraction and matching of single messages, in Python and through the joins. All messages are made up here, one for each branch."""

import hashlib
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators import engine
from spanloom.operators.engine import Span


def rx(name, *patterns, grp=0):
    return {"name": name, "rule_type": "REGEX", "regex_variants": [{"regex": p, "grp": grp} for p in patterns], "boundary_pairs": []}


def bh(name, *pairs):
    return {"name": name, "rule_type": "BOUNDARY_HINT", "regex_variants": [], "boundary_pairs": [dict(zip(("start_after", "end_before", "max_tokens"), p, strict=True)) for p in pairs]}


def spans_in(text, *values):
    """Spans of (name, value[, which occurrence])."""
    out = []
    for name, value, *nth in values:
        at = -1
        for _ in range((nth or [0])[0] + 1):
            at = text.index(value, at + 1)
        out.append((name, value, at, at + len(value)))
    return out


TRAM = "TRAM 9 STOPS NEAR OLD HARBOUR BEFORE NOON"
ROOM = "GARDEN SUITE FOR NO17 IS READY"
DIGITS = rx("N", "[0-9]+")
EXTRACT = [
    ("one pattern, one place", "CRATE WEIGHS 12.5 KG TODAY", [rx("W", r"[0-9]+\.[0-9]")], [[("W", "12.5")]]),
    ("a pattern that isn't there", "CRATE IS EMPTY TODAY", [rx("W", r"[0-9]+\.[0-9]")], []),
    ("no rules", TRAM, [], []),
    ("between two literals", TRAM, [bh("P", ("NEAR", "BEFORE", 4))], [[("P", "OLD HARBOUR")]]),
    ("an end that isn't there is no greedy one", TRAM, [bh("P", ("NEAR", "AFTER", 4))], []),
    ("a start that isn't there", TRAM, [bh("P", ("BESIDE", "BEFORE", 4))], []),
    ("an anchor inside a word doesn't count", "LINEAR MOTOR NEAR QUAY BEFORE SIX", [bh("P", ("NEAR", "BEFORE", 4))], [[("P", "QUAY")]]),
    ("words up to a number", "CALL BACK - BLUE HERON CAFE TONIGHT", [bh("C", ("CALL BACK -", "", 2))], [[("C", "BLUE HERON")]]),
    ("from the start, to an anchor with a digit behind", ROOM, [bh("R", ("SOM", "FOR NO", 5))], [[("R", "GARDEN SUITE")]]),
    ("to the end", "TICKET SENT TO NORA VALE", [bh("W", ("SENT TO", "EOM", 9))], [[("W", "NORA VALE")]]),
    ("values in the order of their places", "GATE B4 ROW 22", [rx("ROW", "(?<=ROW )[0-9]+"), rx("GATE", "(?<=GATE )[A-Z][0-9]")], [[("GATE", "B4"), ("ROW", "22")]]),
    ("two variants, two places, one candidate", "LOW 3 AND HIGH 18 TIDE", [rx("T", "(?<=LOW )[0-9]+", "(?<=HIGH )[0-9]+")], [[("T", "3"), ("T", "18")]]),
    ("one start, two rules: alternatives", "BERTH Q77 IS FREE", [rx("A", "(?<=BERTH )Q[0-9]+"), rx("B", "(?<=H )Q[0-9]+")], [[("A", "Q77")], [("B", "Q77")]]),
    ("places that overlap leave nothing", "98765", [rx("A", "987"), rx("B", "765")], []),
    ("equal patterns count once", "DECK 4", [rx("A", "[0-9]"), rx("B", "[0-9]")], [[("A", "4")]]),
    ("a group", "KEY: ZX90 SET", [rx("K", "KEY: ([A-Z]+)([0-9]+)", grp=2)], [[("K", "90")]]),
    ("an invalid pattern, and a group that isn't there", "V 6", [rx("R", "(", "6"), rx("S", "(6)", grp=4)], [[("R", "6")]]),
    ("an anchor that names nothing", "SEND 31", [bh("W", ("{Q}", "EOM", 3))], []),
    ("a claimed place sends the anchor on; equal text counts once", "BY 40 OR BY FERRY TO BY FERRY TO", [DIGITS, bh("M", ("BY", "TO", 3))], [[("N", "40"), ("M", "FERRY")], [("N", "40")]]),
    ("a span across a claimed one sends it on too", "VIA GATE 12 TO YARD VIA LAKE TO SHORE", [DIGITS, bh("M", ("VIA", "TO", 3))], [[("N", "12"), ("M", "LAKE")], [("N", "12")]]),
    ("and fails where there is no later one", "VIA GATE 12 TO YARD", [DIGITS, bh("M", ("VIA", "TO", 3))], [[("N", "12")]]),
    ("nor is one found behind the end mark", "VIA GATE 12 VIA LAKE", [DIGITS, bh("M", ("VIA", "EOM", 3))], [[("N", "12")]]),
    ("the longer anchors come first, so the later place is kept", "AT DOCK AND STORED AT DOCK NOW", [bh("P", ("AT", "", 1), ("STORED AT", "NOW", 2))], [[("P", "DOCK", 1)]]),
    ("of spans from one start the shortest", "NEAR OLD MILL BEFORE SIX", [bh("P", ("NEAR", "BEFORE", 4), ("NEAR", "", 1))], [[("P", "OLD")]]),
    ("each occurrence of an entity that an anchor names", "LOT 5 RED LOT 8 BLUE", [rx("L", "[0-9]"), bh("C", ("{L}", "", 1))], [[("L", "5"), ("C", "RED"), ("L", "8"), ("C", "BLUE")], [("L", "5"), ("C", "RED"), ("L", "8")], [("L", "5"), ("L", "8"), ("C", "BLUE")], [("L", "5"), ("L", "8")]]),
]


@pytest.mark.parametrize(("text", "rules", "expected"), [c[1:] for c in EXTRACT], ids=[c[0] for c in EXTRACT])
def test_extract(text, rules, expected):
    assert [[tuple(s) for s in c] for c in engine.extract(text, rules)] == [spans_in(text, *c) for c in expected]


def test_anchors_that_wait_for_each_other():
    """W waits for V, which waits for the pattern N, whatever the order of the rules."""
    text = "PAID 64 OF MILA SOON"
    rules = [bh("W", ("{V}", "EOM", 3)), bh("V", ("{N}", "SOON", 3)), rx("N", "[0-9]+")]
    all_ = ("N", "64"), ("V", "OF MILA"), ("W", "SOON")
    want = {tuple(spans_in(text, all_[0], *some)) for k in range(3) for some in itertools.combinations(all_[1:], k)}
    for order in itertools.permutations(rules):
        got = [tuple(map(tuple, c)) for c in engine.extract(text, list(order))]
        assert set(got) == want and len(got) == 4 and len(got[0]) == 3 and len(got[-1]) == 1


spans = st.lists(st.tuples(st.integers(0, 20), st.integers(0, 6)).map(lambda t: Span(f"n{t[0] % 3}", f"v{t[0]}-{t[1]}", t[0], t[0] + t[1])), max_size=6)


def all_candidates(slots, places):
    """Every combination, and of these the ones whose neighbours don't overlap."""
    if not slots and not places:
        return []
    variants = list(engine.with_subsets(v for c in itertools.product(*places) for v in engine.apart(list(c)))) if places else [[]]
    rows = (sorted([*v, *c], key=lambda s: s.st) for v in variants for c in itertools.product(*slots))
    return [r for r in rows if r and not any(engine.clashes(a, b) for a, b in itertools.pairwise(r))]


@given(spans, spans)
@settings(max_examples=500, deadline=None)
def test_candidates_against_all_combinations(a, b):
    slots, places = engine.slots_of([[s for s in a if s.en > s.st]]), engine.islands(engine.shortest_by_start([s for s in b if s.en > s.st]))
    assert list(engine.assemble(slots, places)) == all_candidates(slots, places)


@given(spans)
def test_apart_and_subsets(a):
    a = [s for s in a if s.en > s.st]
    for v in engine.apart(a):
        assert all(x.en <= y.st for x, y in itertools.pairwise(v))
    one = engine.shortest_by_start(a)
    assert len(list(engine.with_subsets([one]))) <= 2 ** len(one) + 1


def test_candidates_come_one_by_one():
    """Of 4 ** 40 candidates the first ones come at once; combinations that overlap aren't tried."""
    slots = [[Span("A", str(j), 10 * i, 10 * i + j) for j in range(1, 5)] for i in range(40)]
    assert len(list(itertools.islice(engine.assemble(slots, []), 1000))) == 1000
    slots[20] = [Span("A", "x", 200, 300 + j) for j in range(4)]
    assert list(engine.assemble(slots, [])) == []


def tpl(id_="t", snaps=(), names=("COUNT",), text=None, values=(), active=True, category="METERS"):
    return {"template_id": id_, "category": category, "subcategory": "X", "intent": "I", "confidence": 0.9, "active": active, "snapshots": list(snaps), "static_hash": engine.static_hash(text, values) if text else "-", "seq_hash": engine.sequence_hash(names)}


def snap(name, start, end, most=0, kind="REGEX"):
    return {"name": name, "semantic_type": name.lower(), "rule_type": kind, "start_after": start, "end_before": end, "max_tokens": most}


def values_in(text, *values):
    return [Span(*s) for s in spans_in(text, *values)]


M = "METER 731 READ BY COLE"
CNT = [values_in(M, ("COUNT", "731"))]
HELLO = "THE LIBRARY WISHES YOU A GOOD DAY"
MARKS = "LOG 4; 17:05 SRV/A7/K9 DONE"
MATCH = [
    ("the fixed text", M, CNT, [tpl(text=M, values=["731"])], "t"),
    ("of an inactive template", M, CNT, [tpl(text=M, values=["731"], active=False)], "LOW_CONFIDENCE_TEMPLATE_INACTIVE"),
    ("the sequence and its anchors", M, CNT, [tpl(snaps=[snap("COUNT", "METER", "READ")])], "t"),
    ("anchors that don't hold", M, CNT, [tpl(snaps=[snap("COUNT", "GAUGE", "READ")])], "BOUNDARY_VALIDATION_FAILED"),
    ("only one template holds", M, CNT, [tpl("a", [snap("COUNT", "METER", "READ")]), tpl("b", [snap("COUNT", "METER", "BY")])], "a"),
    ("two of one category", M, CNT, [tpl("a", [snap("COUNT", "METER", "READ")]), tpl("b", [snap("COUNT", "METER", "READ")])], "a"),
    ("two of two categories", M, CNT, [tpl("a", [snap("COUNT", "METER", "READ")]), tpl("b", [snap("COUNT", "METER", "READ")], category="VISITS")], "AMBIGUOUS_TEMPLATE_CONFLICT"),
    ("nothing at all", M, [], [], "NO_EXTRACTION_CANDIDATES"),
    ("no templates", M, CNT, [], "NO_TEMPLATE_MATCH_BOTH_HASHES_MISSED"),
    ("the sequence of an inactive template", M, CNT, [tpl(snaps=[snap("COUNT", "METER", "READ")], active=False)], "LOW_CONFIDENCE_TEMPLATE_INACTIVE"),
    ("a boundary rule", TRAM, [values_in(TRAM, ("P", "OLD HARBOUR"))], [tpl(snaps=[snap("P", "NEAR", "BEFORE", 4, "BOUNDARY_HINT")], names=("P",))], "t"),
    ("fixed text without values", HELLO, [], [tpl(text=HELLO)], "t"),
    ("and without an active template", HELLO, [], [tpl(text=HELLO, active=False)], "LOW_CONFIDENCE_TEMPLATE_INACTIVE"),
    ("anchors of marks", MARKS, [values_in(MARKS, ("TIME", "17:05"))], [tpl(snaps=[snap("TIME", ";", "SRV/A7/")], names=("TIME",))], "t"),
    ("from the start", ROOM, [values_in(ROOM, ("R", "GARDEN SUITE"))], [tpl(snaps=[snap("R", "SOM", "FOR NO", 5, "BOUNDARY_HINT")], names=("R",))], "t"),
    ("the candidate's place beats the kind of its match", M, [CNT[0], values_in(M, ("X", "COLE"))], [tpl("z", [snap("COUNT", "METER", "READ")]), tpl("a", text=M, values=["COLE"], names=("X",))], "z"),
    ("entities that anchors name", M, [values_in(M, ("A", "METER"), ("B", "731"))], [tpl(snaps=[snap("A", "", "{B}"), snap("B", "{A}", "")], names=("A", "B"))], "t"),
    ("the walk, to an anchor that isn't next to a value", M, CNT, [tpl(snaps=[snap("COUNT", "METER", "READ"), snap("COUNT", "BY", "", 2, "BOUNDARY_HINT")])], "t"),
    ("which too many words fail", M, CNT, [tpl(snaps=[snap("COUNT", "METER", "COLE", 2, "BOUNDARY_HINT")])], "BOUNDARY_VALIDATION_FAILED"),
    ("of two reasons the one that says more, from a later candidate", M, [CNT[0], values_in(M, ("X", "COLE"))], [tpl(snaps=[snap("X", "FOR", "")], names=("X",))], "BOUNDARY_VALIDATION_FAILED"),
    ("or an earlier one", M, [values_in(M, ("X", "COLE")), CNT[0], values_in(M, ("Y", "READ"))], [tpl("u", [snap("X", "FOR", "")], names=("X",)), tpl("v", active=False)], "BOUNDARY_VALIDATION_FAILED"),
    ("a conflict says most", M, [CNT[0], values_in(M, ("X", "COLE"))], [tpl("a", [snap("COUNT", "METER", "READ")]), tpl("b", [snap("COUNT", "METER", "READ")], category="VISITS"), tpl("c", [snap("X", "FOR", "")], names=("X",))], "AMBIGUOUS_TEMPLATE_CONFLICT"),
]


@pytest.mark.parametrize(("text", "cands", "templates", "expected"), [c[1:] for c in MATCH], ids=[c[0] for c in MATCH])
def test_match(text, cands, templates, expected):
    got = engine.match(text, iter(cands), templates)
    assert (got if isinstance(got, str) else got[0]["template_id"]) == expected


def test_rules_without_candidates_are_discarded_ones():
    assert engine.match(M, iter(()), [], has_rules=True) == "EXTRACTION_CANDIDATES_DISCARDED"
    assert engine.match(HELLO, iter(()), [tpl(text=HELLO, active=False)], has_rules=True) == "EXTRACTION_CANDIDATES_DISCARDED"
    assert engine.match(HELLO, iter(()), [tpl(text=HELLO)], has_rules=True)[0]["template_id"] == "t"


def test_match_in_plans(spark):
    """The same cases through the joins."""
    from pyspark.sql import functions as F

    from spanloom import schemas
    from spanloom.operators import matching

    msgs, temps = [], []
    for i, (_, text, cands, templates, _) in enumerate(MATCH):
        msgs.append((str(i), f"s{i}", text, [(o, [tuple(s) for s in c], [s.name for s in c]) for o, c in enumerate(cands)]))
        for t in templates:
            snaps = [(s["name"], s["semantic_type"], s["rule_type"], None, 0, s["start_after"], s["end_before"], s["max_tokens"]) for s in t["snapshots"]]
            temps.append((t["template_id"], f"s{i}", t["category"], "X", "I", 0.9, "c", snaps, [], t["static_hash"], t["seq_hash"], t["active"]))
    m = spark.createDataFrame(msgs, f"msg_id string, sender_id string, text string, cands array<{schemas.CANDIDATE}>")
    t = spark.createDataFrame(temps, schemas.TEMPLATES)
    for most in (matching.BROADCAST_BYTES, 0):
        matching.small.__defaults__ = (most,)
        rows = matching.outcomes(matching.explode_candidates(m), t)
        got = {r["msg_id"]: r["x"] for r in matching.reduce_outcomes(rows, ["sender_id", "text"]).select("msg_id", F.coalesce("reason", "win.template_id").alias("x")).collect()}
        assert got == {str(i): c[-1] for i, c in enumerate(MATCH)}
    matching.small.__defaults__ = (matching.BROADCAST_BYTES,)


def test_more_candidates_than_a_row_keeps(spark, monkeypatch):
    """The row says that there are more; the loop that tries all of them finds the one that matches."""
    from spanloom import schemas
    from spanloom.operators import learning, rules, spans as S
    from spanloom.plans import pipeline

    monkeypatch.setattr(S, "KEPT", 3)
    text = "BOX 1 2 3 4 5"
    pats = [("S", i, f"D{i}{j}", "REGEX", [(f"(?<={'BOX'[j:]}{' .' * (i - 1)} ){i}", 0)], []) for i in range(1, 6) for j in range(2)]
    e = spark.createDataFrame(pats, schemas.SENDER_ENTITIES)
    names = [f"D{i}1" for i in range(1, 6)]  # the last of 32 candidates
    t = spark.createDataFrame([("t", "S", "C", "U", "I", 0.9, "c", [], names, "none", engine.sequence_hash(names), True)], schemas.TEMPLATES)
    m = spark.createDataFrame([("m", 0, "S", text)], schemas.MESSAGES)
    hits, misses, _ = pipeline.process(spark, m, spark.createDataFrame([], schemas.NORMALIZATION_RULES), e, t)
    missed = misses.collect()
    assert hits.count() == 0 and len(missed) == 1 and missed[0]["more"]
    found = learning.learn(misses.select("msg_id", "seq", "sender_id", "normalized"), e, t, lambda text, entities: None).filter("kind = 'message'").collect()
    assert [(r["path"], r["template_id"]) for r in found] == [("TEMPLATE_HIT", "t")] and rules.compile_entities(spark, e).count() == 1


def test_hashes():
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert engine.static_hash(M, ["731"]) == sha("METERREADBYCOLE") and engine.static_hash("A 7 B 7", ["7", ""]) == sha("AB")
    assert engine.sequence_hash(["COUNT", "NAME"]) == sha("COUNT:NAME") and engine.sequence_hash([]) == sha("")


def test_typed_values():
    values = [Span("A", "1", 4, 5), Span("A", "2", 10, 11), Span("A", "3", 12, 13)]
    snaps = [snap("A", "TO", "") | {"semantic_type": "second"}, snap("A", "", "") | {"semantic_type": "first"}]
    assert engine.typed_values("PAY 1 TO: 2 3", values, snaps) == {"first": "1", "second": "2", "A": "3"}


def test_one_pass_is_the_joins(spark, monkeypatch):
    """Extraction and matching in one pass say the same as candidates matched by joins, for patterns and texts that Java has to search too; nothing is shuffled by message."""
    from spanloom import schemas
    from spanloom.operators import matching, rules
    from spanloom.plans import pipeline

    texts = ["PAY 12 TO BOB NOW", "PAY 12 TO BOB\rNOW", "PAY 7 TO ÄNN NOW", "PAY TO BOB NOW", "", "HELLO", "PAY 5 TO A B C D NOW"]
    senders = {"a": "(?<=PAY )[0-9]+", "b": "(?<=PAY )[0-9&&[^5]]+", "c": "(?<=PAY )[0-9]+", "d": None}
    m = spark.createDataFrame([(f"{s}{i}", i, s, t, t) for s in senders for i, t in enumerate(texts)], "msg_id string, seq bigint, sender_id string, raw_text string, normalized string")
    e = spark.createDataFrame([(s, 0, "N", "REGEX", [(p, 0)], []) for s, p in senders.items() if p] + [(s, 1, "W", "BOUNDARY_HINT", [], [("TO", "NOW", 3)]) for s in senders if s != "d"], schemas.SENDER_ENTITIES)
    snap = [("N", "n", "REGEX", None, 0, "PAY", "TO", 0), ("W", "w", "BOUNDARY_HINT", None, 0, "TO", "NOW", 3)]
    seq, fixed = engine.sequence_hash(["N", "W"]), engine.static_hash("PAY TO NOW", ())
    t = [("t1", "a", "C", "S", "I", 0.9, "x", snap, ["N", "W"], fixed, "none", True), ("t2", "b", "C", "S", "I", 0.9, "x", snap, ["N", "W"], "none", seq, True), ("t3", "b", "D", "S", "I", 0.9, "y", snap[:1], [], "none", seq, True), ("t4", "c", "C", "S", "I", 0.9, "x", None, [], "none", seq, True), ("t5", "c", "C", "S", "I", 0.2, "x", snap, [], engine.static_hash("HELLO", ()), "none", False), ("t6", "d", "C", "S", "I", 0.9, "x", None, [], engine.static_hash("HELLO", ()), "none", True)]
    t = spark.createDataFrame(t, schemas.TEMPLATES)
    c = rules.compile_entities(spark, e)
    assert {r["sender_id"]: r["javas"] for r in c.collect()} == {"a": False, "b": True, "c": False}
    plain = lambda df: sorted(str(r.asDict(recursive=True)) for r in df.select(*pipeline.MATCHED).collect())
    want = plain(pipeline.matched(pipeline.with_candidates(m, c), t))
    one = pipeline.decided(m, c, t)
    assert plain(one) == want and len(want) == 28 and len({r["reason"] for r in one.collect()}) > 3
    assert "hashpartitioning(msg_id" not in one._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(matching, "CARRIED", 300)  # some senders by joins, then all
    assert plain(pipeline.decided(m, c, t)) == want
    monkeypatch.setattr(matching, "CARRIED", 0)
    assert plain(pipeline.decided(m, c, t)) == want


def test_patterns_that_python_reads_as_java_does():
    from spanloom.operators import rules

    assert all(map(rules.alike, (r"(?<=^INR )[0-9]+(?:\.[0-9]{1,2})?", "[A-Z]+$", r"\d+(a|b)?", "(?!x)[^0-9 ]{2,}?", r"\bXX[0-9-]{4}")))
    assert not any(map(rules.alike, (r"\p{L}+", "[a[bc]]", "[a-z&&[^b]]", "(?i)abc", r"\Aa", r"a\Z", "(a*)*b", "(a)\\1", "a++", "é", "[]a]", r"\Qa.b\E", "(?<=a|bc)d", "(?<n>a)")))
