"""The engine for one message, in plain Python: what the Arrow functions call for each row, and what the per-sender
learning loop runs between two calls of its teacher. Tables of messages go through spans.py, candidates.py and matching.py.

Texts are normalised, hence ASCII: an offset is a code point and a UTF-16 unit alike.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import itemgetter
from typing import NamedTuple

from spanloom.schemas import BOUNDARY_HINT, PRIORITY, REGEX


class Span(NamedTuple):
    name: str
    value: str
    st: int
    en: int


# ---- anchors

def entity_of(anchor: str | None) -> str | None:
    """X of an anchor written {X}."""
    return anchor[1:-1] if anchor and len(anchor) > 2 and anchor[0] == "{" and anchor[-1] == "}" else None


def is_start(anchor: str | None) -> bool:
    return (anchor or "").upper() == "SOM"


def is_end(anchor: str | None) -> bool:
    return (anchor or "").upper() == "EOM"


def anchor_regex(token: str, skip_between_digits: bool) -> str:
    """A pattern that matches (with no width) where the upper-cased token stands as a word: a letter or digit at its start must not follow
    one, a letter or digit at its end must not precede a letter. A token of marks alone stands anywhere, but, if asked for, not between digits."""
    t = token.upper()
    literal = re.escape(t)
    if skip_between_digits and not any(c.isalnum() for c in t):
        return f"(?={literal})(?!(?<=[0-9]){literal}[0-9])"
    before = "(?<![0-9A-Za-z])" if t[:1].isalnum() else ""
    after = "(?![A-Za-z])" if t[-1:].isalnum() else ""
    return f"{before}(?={literal}{after})"


@lru_cache(10_000)
def _anchor(token: str, skip_between_digits: bool) -> re.Pattern:
    return re.compile(anchor_regex(token, skip_between_digits))


def find_anchor(text: str, token: str, at: int, matching: bool = False) -> int:
    """First place from `at` on, or -1. Extraction compares with the text as it is and keeps marks off digits; matching
    upper-cases the text and doesn't."""
    m = _anchor(token, not matching).search(text.upper() if matching else text, at)
    return m.start() if m else -1


def words_end(text: str, at: int, words: int) -> int:
    """Where at most so many blank-separated words from `at` on end; -1 if there is none."""
    m = re.compile(f"(?: *[^ ]+){{1,{words}}}").match(text, at) if words > 0 and at < len(text) else None
    return m.end() if m else -1


def behind(text: str, at: int) -> int:
    return at + 1 if text[at : at + 1] == " " else at


# ---- rules

def java_pattern(pattern: str) -> str:
    """\\Q...\\E, which Python doesn't know, as escapes."""
    return re.sub(r"\\Q(.*?)(?:\\E|$)", lambda m: re.escape(m[1]), pattern, flags=re.S)


@lru_cache(10_000)
def _compiled(pattern: str):
    for module in ("re", "regex"):  # the second knows look-behind of varying width
        try:
            return __import__(module).compile(java_pattern(pattern), re.ASCII if module == "re" else __import__("regex").ASCII)
        except Exception:  # noqa: BLE001  an invalid pattern is skipped, as each module has an error of its own
            continue
    return None


def regex_spans(text: str, name: str, pattern: str | None, group: int) -> list[Span]:
    """All matches, or the given group's; a pattern or a group that isn't valid gives what came before it."""
    return _places(text, name, _compiled(pattern) if pattern else None, group)


def _places(text: str, name: str, p, group: int) -> list[Span]:
    out: list[Span] = []
    if p and group <= 0:
        return [Span(name, m[0], *m.span()) for m in p.finditer(text)]
    for m in p.finditer(text) if p else ():
        if group > p.groups or m.start(group) < 0:
            break
        out.append(Span(name, m[group], *m.span(group)))
    return out


def distinct_rules(entities: list[dict]) -> list[dict]:
    """Of REGEX rules with the same patterns, only the first."""
    seen, out = set(), []
    for e in entities:
        if e["rule_type"] == REGEX:
            mark = "|".join(sorted(v["regex"] or "" for v in e["regex_variants"] or ()))
            if mark and mark in seen:
                continue
            seen.add(mark)
        out.append(e)
    return out


class Rules:
    """A sender's rules, read once for all of its messages: those with patterns, and boundary rules with their pairs in order and the entities that their
    anchors name."""

    def __init__(self, entities: list[dict], distinct: bool = False) -> None:
        rules = entities if distinct else distinct_rules(entities)
        self.any = bool(entities)
        self.regex = [(e["name"], [(_compiled(v["regex"]) if v["regex"] else None, v["grp"] or 0) for v in e["regex_variants"] or ()]) for e in rules if e["rule_type"] == REGEX]
        hints = [(e["name"], [(p, entity_of(p["start_after"])) for p in by_specificity(e["boundary_pairs"] or ())]) for e in rules if e["rule_type"] == BOUNDARY_HINT]
        self.hints = [(n, pairs, [{x for x in (ref, entity_of(p["end_before"])) if x is not None} for p, ref in pairs]) for n, pairs in hints]


def specificity(pair: dict) -> int:
    end = pair["end_before"] or ""
    return len(pair["start_after"] or "") + (0 if is_end(end) else len(end))


def by_specificity(pairs: Iterable[dict]) -> list[dict]:
    return sorted(pairs, key=specificity, reverse=True)  # stable in reverse as well


# ---- spans of boundary rules

class _Message:
    """A text, its claimed (REGEX) spans and the spans that anchors can refer to."""

    def __init__(self, text: str, claimed: list[Span], all_of: dict[str, list[Span]], first: dict[str, Span]) -> None:
        self.text, self.claimed, self.all_of, self.first = text, claimed, all_of, first

    def taken(self, at: int) -> bool:
        return any(s.st <= at < s.en for s in self.claimed)

    def crossed(self, st: int, en: int) -> bool:
        return any(s.st < en and s.en > st for s in self.claimed)

    def starts(self, token: str, at: int) -> Iterator[int]:
        """Where values behind the token can start, from `at` on."""
        i = find_anchor(self.text, token, at)
        while i >= 0:
            yield behind(self.text, i + len(token))
            i = find_anchor(self.text, token, i + 1)

    def boundary(self, name: str, pair: dict, at: int, ref: Span | None = None) -> Span | None:
        """The pair's span from `at` on. ref stands for the entity that start_after names."""
        text, start, end, size = self.text, pair["start_after"], pair["end_before"] or "", len(self.text)
        from_entity, to_entity, known = entity_of(start), entity_of(end), self.first
        if ref is not None:
            known = known | {from_entity: ref}
        if not start or from_entity and from_entity not in known or to_entity and to_entity not in known:
            return None
        if is_start(start):
            if at > 0:
                return None
            st = 0
        elif from_entity:
            st = known[from_entity].en
            while st < size and not text[st].isalnum():
                st += 1
        else:
            st = next((x for x in self.starts(start, at) if not self.taken(x)), -1)
            if st < 0:
                return None
        if is_end(end):
            en = size
        elif not end:
            en = words_end(text, st, pair["max_tokens"] or 0)
        elif to_entity:
            en = known[to_entity].st
        else:
            en = find_anchor(text, end, st)
        if en < 0:
            return None
        if not is_start(start) and self.crossed(st, en):
            if from_entity:
                return None
            later = itertools.islice(itertools.dropwhile(lambda x: x != st, self.starts(start, 0)), 1, None)
            for x in later:
                e = find_anchor(text, end, x) if end else x  # an end that is no literal is looked for as text here
                if not self.taken(x) and e > 0 and not self.crossed(x, e):
                    st, en = x, e
                    break
            else:
                return None
        if en > st and text[en - 1] == " ":
            en -= 1
        value = text[st:en].strip(_BLANK) if en > st else ""
        return Span(name, value, st, en) if value else None

    def groups(self, name: str, pairs: list[tuple[dict, str | None]]) -> list[list[Span]]:
        """The rule's places in the text, each with the spans that compete for it. pairs: by specificity, with the entity that each starts after."""
        found: dict[str, Span] = {}
        for pair, ref in pairs:
            if ref:
                for r in self.all_of.get(ref) or ([self.first[ref]] if ref in self.first else []):
                    if s := self.boundary(name, pair, 0, r):
                        found.setdefault(s.value, s)
            else:
                at = 0
                while s := self.boundary(name, pair, at):
                    found.setdefault(s.value, s)
                    if s.en <= at:
                        break
                    at = s.en
        return islands(shortest_by_start(found.values()))


_BLANK = "".join(map(chr, range(33)))  # what Java's trim takes off


def shortest_by_start(spans: Iterable[Span]) -> list[Span]:
    best: dict[int, Span] = {}
    for s in spans:
        if s.st not in best or s.en < best[s.st].en:
            best[s.st] = s
    return [best[k] for k in sorted(best)]


def islands(spans: list[Span]) -> list[list[Span]]:
    """Sorted spans in runs that overlap."""
    out: list[list[Span]] = []
    reach = -1
    for s in spans:
        if not out or s.st >= reach:
            out.append([])
            reach = s.en
        reach = max(reach, s.en)
        out[-1].append(s)
    return out


# ---- candidates

_start = itemgetter(2)


def clashes(a: Span, b: Span) -> bool:
    return a.en > b.st


def apart(spans: list[Span]) -> list[list[Span]]:
    """Variants without neighbours that overlap: at the first such pair, once without the left and once without the right one."""
    row = sorted(spans, key=_start)
    for i, (a, b) in enumerate(itertools.pairwise(row)):
        if clashes(a, b):
            return apart(row[:i] + row[i + 1 :]) + apart(row[: i + 1] + row[i + 2 :])
    return [row]


def with_subsets(variants: Iterable[list[Span]]) -> Iterator[list[Span]]:
    """The variants, then their proper subsets (by bit mask) whose names and values weren't there yet, then the empty one."""
    mark = lambda v: "|".join(f"{s.name}={s.value}" for s in v)
    first = []
    for v in variants:
        first.append(v)
        yield v
    seen = set(map(mark, first))
    for v in first:
        for mask in range(1, (1 << len(v)) - 1):
            part = [s for i, s in enumerate(v) if mask >> i & 1]
            if (m := mark(part)) not in seen:
                seen.add(m)
                yield part
    yield []


def assemble(slots: list[list[Span]], places: list[list[Span]]) -> Iterator[list[Span]]:
    """Candidates, in order and one by one, of alternatives by slot (REGEX) and by place (boundary rules). A slot's alternatives share their start, and each slot
    has one in a candidate; so an alternative that reaches into the next slot's start is in none, and combinations of the others never overlap."""
    if not slots and not places:
        return
    starts = sorted(x[0].st for x in slots)
    after = dict(itertools.pairwise([*starts, float("inf")]))
    alone = [[s for s in x if s.en <= after[s.st]] for x in slots]
    variants = with_subsets(v for c in itertools.product(*places) for v in apart(list(c))) if places else [[]]
    for v in variants:
        for c in itertools.product(*_beside(v, alone)):
            if row := sorted([*v, *c], key=_start):
                yield row


def _beside(v: list[Span], slots: list[list[Span]]) -> list[list[Span]]:
    """The alternatives of each slot that overlap none of v."""
    if not v:
        return slots
    fit = []
    for x in slots:
        own = []
        for s in x:
            _, _, st, en = s
            for _, _, a, b in v:
                if b > st if a <= st else en > a:
                    break
            else:
                own.append(s)
        fit.append(own)
    return fit


def slots_of(by_rule: Iterable[list[Span]]) -> list[list[Span]]:
    """The spans of all REGEX rules by start, in the order in which starts were first seen."""
    at: dict[int, list[Span]] = {}
    for spans in by_rule:
        for s in spans:
            at.setdefault(s.st, []).append(s)
    return list(at.values())


def extract(text: str, entities: list[dict] | Rules, found: dict[str, list[Span]] | None = None, distinct: bool = False) -> Iterator[list[Span]]:
    """All candidates of a text under a sender's rules, one by one: they multiply, and the first that matches ends the search. found: the spans of REGEX rules by name, where they are known already. distinct: the rules
    have been through distinct_rules()."""
    rules = entities if isinstance(entities, Rules) else Rules(entities or [], distinct)
    if not text or not rules.any:
        return iter(())
    all_of: dict[str, list[Span]] = {}
    spans: list[list[Span]] = []
    for name, variants in rules.regex:
        own = found.get(name, []) if found is not None else [s for p, g in variants for s in _places(text, name, p, g)]
        if len(own) > 1:
            own = list({(s.st, s.value): s for s in reversed(own)}.values())[::-1]
        if own:
            spans.append(own)
            all_of[name] = own
    places: list[list[Span]] = []
    if rules.hints:
        message = _Message(text, [s for own in all_of.values() for s in own], all_of, {own[0].name: own[0] for own in spans})
        waiting, moved = rules.hints, True
        while waiting and moved:
            moved, still = False, []
            for e in waiting:
                name, pairs, needs = e
                if any(n <= message.first.keys() for n in needs):
                    moved = True
                    if got := message.groups(name, pairs):
                        places += got
                        message.first[name] = got[0][0]
                else:
                    still.append(e)
            waiting = still
    return assemble(slots_of(spans), places)


# ---- hashes and matching

def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def static_hash(text: str, values: Iterable[str]) -> str:
    """Of the text without the values, wherever they occur, and without blanks."""
    for v in values:
        if v:
            text = text.replace(v, "")
    return sha256(text.replace(" ", ""))


def sequence_hash(names: Iterable[str]) -> str:
    return sha256(":".join(names))


def holds(text: str, snap: dict, s: Span, values: list[Span]) -> bool:
    """Whether a value stands where the snapshot's anchors say."""
    start, end, upper = snap["start_after"] or "", snap["end_before"] or "", text.upper()
    first = lambda name: next((v for v in values if v.name == name), None)
    if start and not is_start(start):
        if x := entity_of(start):
            if (ref := first(x)) is None or ref.en > s.st:
                return False
        elif not _last_before(upper[: s.st], start.upper()):
            return False
    if end and not is_end(end):
        if x := entity_of(end):
            if (ref := first(x)) is None or ref.st < s.en:
                return False
        elif any(c.isalnum() for c in end):
            i = upper.find(end.upper(), s.en)
            if i < 0 or upper[s.en : i].strip(_BLANK):
                return False
    return True


def _last_before(upper: str, token: str) -> bool:
    i = upper.rfind(token)
    return i >= 0 and not upper[i + len(token) :].strip(_BLANK)


def walk(text: str, template: dict, values: list[Span]) -> list[Span] | None:
    """The template's values read off the text from anchor to anchor, or None."""
    at, out, used = 0, [], {}
    literal = lambda a, special: bool(a) and not special(a) and entity_of(a) is None
    for snap in template["snapshots"] or ():
        start, end, most = snap["start_after"], snap["end_before"], snap["max_tokens"] or 0
        if literal(start, is_start):
            i = find_anchor(text, start, at, matching=True)
            if i < 0:
                return None
            at = behind(text, i + len(start))
        st = at
        if literal(end, is_end):
            en = find_anchor(text, end, st, matching=True)
            if en < 0:
                return None
            at = en + len(end)
        elif most > 0:
            en = at = words_end(text, st, most)
            if en < 0:
                return None
        else:
            k = used.get(snap["name"], 0)
            used[snap["name"]] = k + 1
            own = [v for v in values if v.name == snap["name"]]
            if k < len(own):
                out.append(own[k])
                at = own[k].en
            continue
        value = text[st:en].strip(_BLANK)
        if not value or snap["rule_type"] == BOUNDARY_HINT and most > 0 and len(re.split(r"[ \t\n\x0b\f\r]+", value)) > most:
            return None
        out.append(Span(snap["name"], value, st, en))
    return out or None


class Templates:
    """A sender's templates, by template_id, read once for all of its messages."""

    def __init__(self, templates: list[dict]) -> None:
        self.by_static: dict[str, dict] = {}
        self.by_sequence: dict[str, list[dict]] = {}
        for t in templates:
            if t["static_hash"] is not None:
                self.by_static.setdefault(t["static_hash"], t)
            self.by_sequence.setdefault(t["seq_hash"], []).append(t)


def match(text: str, candidates: Iterable[list[Span]], templates: list[dict] | Templates, has_rules: bool = False) -> tuple[dict, list[Span]] | str:
    """(template, values) or the reason of the failure. templates: the sender's, by template_id. has_rules: the sender has some, so a failure without candidates is
    that they were discarded."""
    t, values, _, reason = outcome(text, candidates, templates if isinstance(templates, Templates) else Templates(templates), has_rules)
    return reason if t is None else (t, values)


def outcome(text: str, candidates: Iterable[list[Span]], templates: Templates, has_rules: bool) -> tuple[dict | None, list[Span], int | None, str | None]:
    """(template, values, place of the candidate that won, None), or the reason in the last place and nothing else."""
    worst = None
    for i, values in enumerate(candidates):
        got = _match_one(text, values, templates)
        if not isinstance(got, str):
            return *got, i, None
        worst = max(worst or "NO_TEMPLATE_MATCH_BOTH_HASHES_MISSED", got, key=lambda r: PRIORITY.get(r, 0))
    if worst:
        return None, [], None, worst
    t = templates.by_static.get(static_hash(text, ()))
    if t is not None and t["active"]:
        return t, [], 0, None
    return None, [], None, "EXTRACTION_CANDIDATES_DISCARDED" if has_rules else "NO_EXTRACTION_CANDIDATES" if t is None else "LOW_CONFIDENCE_TEMPLATE_INACTIVE"


def _match_one(text: str, values: list[Span], templates: Templates) -> tuple[dict, list[Span]] | str:
    t = templates.by_static.get(static_hash(text, map(itemgetter(1), values)))
    if t is not None:
        return (t, values) if t["active"] else "LOW_CONFIDENCE_TEMPLATE_INACTIVE"
    same = templates.by_sequence.get(sequence_hash(map(itemgetter(0), values)), ())
    active = [t for t in same if t["active"]]
    if not active:
        return "LOW_CONFIDENCE_TEMPLATE_INACTIVE" if same else "NO_TEMPLATE_MATCH_BOTH_HASHES_MISSED"
    good = [t for t in active if all(any(v.name == s["name"] and holds(text, s, v, values) for v in values) for s in t["snapshots"] or ())]
    if not good:
        return next(((t, w) for t in active if (w := walk(text, t, values))), "BOUNDARY_VALIDATION_FAILED")
    if any((t["category"], t["subcategory"]) != (good[0]["category"], good[0]["subcategory"]) for t in good):
        return "AMBIGUOUS_TEMPLATE_CONFLICT"
    return good[0], values


def typed_values(text: str, values: list[Span], snapshots: list[dict] | None) -> dict[str, str]:
    """Values by semantic type: the first snapshot of the name whose type is free and whose start anchor, if literal, occurs before the value."""
    out: dict[str, str] = {}
    for v in values:
        fits = (s["semantic_type"] for s in snapshots or () if s["name"] == v.name and s["semantic_type"] not in out and (not s["start_after"] or s["start_after"].startswith("{") or s["start_after"].upper() in text[: v.st].upper()))
        out[next(fits, v.name)] = v.value
    return out
