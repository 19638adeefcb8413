"""Chat formatting by schema fingerprints.

A JSON record's fingerprint is a hash of those known nested field paths that it has; fields that no mapping knows don't
count. A fingerprint selects a declarative mapping, which says where roles and texts lie; so messages, prompts and instructions become
the same canonical turns. The template marks each turn and escapes control characters inside texts reversibly; the loss mask
is kept as runs (skip, take), one a turn, so nothing in it grows faster than the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

OPEN, HEAD_END, CLOSE = "<s>[", "]\n", "</s>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: a list of objects (`items`, `role`, `text`), or one field a turn (`fields`: role and path).

    `paths` are the known paths that make up its fingerprint, one tuple for each variant. `optional` fields may lack a text and then make no turn.
    """

    name: str
    variants: tuple[tuple[str, ...], ...]
    items: str | None = None
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


def _list(name: str, items: str, role: str, text: str, **roles: str) -> Mapping:
    a, r, t = f"$.{items}", f"$.{items}[0].{role}", f"$.{items}[0].{text}"
    return Mapping(name, ((a, r, t), (a,)), items, role, text, (), roles)


MAPPINGS = (
    _list("messages", "messages", "role", "content"),
    _list("conversations", "conversations", "from", "value", human="user", gpt="assistant", bot="assistant"),
    Mapping("prompt-response", (("$.prompt", "$.response"), ("$.prompt", "$.response", "$.system")), fields=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Mapping("prompt-completion", (("$.prompt", "$.completion"), ("$.prompt", "$.completion", "$.system")), fields=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Mapping("question-answer", (("$.question", "$.answer"),), fields=(("user", ("$.question",)), ("assistant", ("$.answer",)))),
    Mapping("instruction", (("$.instruction", "$.output"), ("$.instruction", "$.input", "$.output")), fields=(("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
)


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def known_paths(mappings=MAPPINGS) -> list[str]:
    return sorted({p for m in mappings for v in m.variants for p in v})


@dataclass(frozen=True)
class Reader:
    """How a parsed record is read: whether it has a path, the string at a top field's path, and the (role, text) rows of a mapping's list."""

    has: Callable[[str], Column]
    string: Callable[[str], Column]
    rows: Callable[[Mapping], Column]


def by_variant(record: Column) -> Reader:
    kind = lambda m: f"array<struct<`{m.role}`:string,`{m.text}`:string>>"
    return Reader(lambda p: F.variant_get(record, p, "variant").isNotNull(), lambda p: F.try_variant_get(record, p, "string"), lambda m: F.try_variant_get(record, f"$.{m.items}", kind(m)))


#: A variant's texts have at most 20 million characters, and itself 128 MB; records of so many bytes are read without one, with no limit to a text.
LARGE = 16_000_000
_WHOLE = {"maxStringLen": str(2**31 - 1)}


def parse_large(record: Column, mappings=MAPPINGS) -> Column:
    """The record's top fields as strings (without those of lists), and its lists; null where it isn't a JSON object."""
    names = [m.items for m in mappings if m.items]
    fields = F.transform_values(F.from_json(record, "map<string,string>", _WHOLE), lambda k, x: F.when(~k.isin(names), x))
    lists = F.from_json(record, ", ".join(f"`{x}` array<map<string,string>>" for x in names), _WHOLE)
    return F.when(fields.isNotNull(), F.struct(fields.alias("fields"), lists.alias("lists")))


def by_fields(parsed: Column) -> Reader:
    """Of what parse_large() gives."""

    def has(path: str) -> Column:
        top, _, inner = path.removeprefix("$.").partition("[0].")
        if not inner:
            return F.map_contains_key(parsed["fields"], top)
        return F.coalesce(F.map_contains_key(F.get(parsed["lists"][top], F.lit(0)), inner), F.lit(False))

    pairs = lambda m: F.transform(parsed["lists"][m.items], lambda x: F.struct(x[m.role].alias(m.role), x[m.text].alias(m.text)))
    return Reader(has, lambda p: parsed["fields"][p.removeprefix("$.")], pairs)


def fingerprint(record: Column, mappings=MAPPINGS, reader: Callable[[Column], Reader] = by_variant) -> Column:
    """record: a variant, or what the reader reads. Null where it is null."""
    read = reader(record)
    has = [F.when(read.has(p), F.lit(p)) for p in known_paths(mappings)]
    return F.when(record.isNotNull(), F.substring(F.sha2(F.concat_ws("\n", *has), 256), 1, 16))


def _renamed(role: Column, names: dict[str, str]) -> Column:
    out = role
    for a, b in names.items():
        out = F.when(role == a, b).otherwise(out)
    return out


def turns_of(record: Column, print_: Column, mappings=MAPPINGS, reader: Callable[[Column], Reader] = by_variant) -> Column:
    """The canonical turns; null where no mapping has the fingerprint. Null roles and texts become empty."""
    out, read = F.lit(None).cast(TURNS), reader(record)
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    for m in mappings:
        if m.items:
            rows = F.coalesce(read.rows(m), F.array().cast(f"array<struct<`{m.role}`:string,`{m.text}`:string>>"))
            made = F.transform(rows, lambda x: turn(_renamed(x[m.role], m.roles), x[m.text]))  # noqa: B023  called at once
        else:
            made = F.array(*[turn(F.lit(role), F.concat_ws("\n", *[read.string(p) for p in paths])) for role, paths in m.fields if role != "system"])
            for role, (path,) in ((r, p) for r, p in m.fields if r == "system"):
                has = read.string(path)
                made = F.when(has.isNotNull(), F.concat(F.array(turn(F.lit(role), has)), made)).otherwise(made)
        out = F.when(print_.isin([fingerprint_of(v) for v in m.variants]), made).otherwise(out)
    return out.cast(TURNS)


def escape(text: Column) -> Column:
    """Without "<", "[" and "]", and with each backslash followed by a letter that says what it stands for."""
    for a, b in (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"), ("]", "\\j")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("]", "\\j"), ("[", "\\k"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def render(turns: Column) -> tuple[Column, Column]:
    """(formatted text, loss mask): the mask's i-th run belongs to the i-th turn and counts code points: `skip`, then `take` under the
    mask, then `rest`."""
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(HEAD_END))
    text = F.array_join(F.transform(turns, lambda t: F.concat(head(t), escape(t["text"]), F.lit(CLOSE))), "")

    def run(t: Column) -> Column:
        said, own = F.length(escape(t["text"])), t["role"] == "assistant"
        return F.struct(F.length(head(t)).alias("skip"), F.when(own, said).otherwise(0).alias("take"), (F.when(own, 0).otherwise(said) + len(CLOSE)).alias("rest"))

    return text, F.transform(turns, run)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(formatted, CLOSE, -1)
    inner = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(p: Column) -> Column:
        role = F.substring_index(p, HEAD_END, 1)
        body = F.substr(p, F.length(role) + len(HEAD_END) + 1)
        return F.struct(unescape(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"), unescape(body).alias("text"))

    return F.transform(inner, one)


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    pieces = F.arrays_zip(F.split(formatted, CLOSE, -1).alias("p"), mask.alias("m"))
    return F.array_join(F.transform(pieces, lambda x: F.when(x["m"]["take"] > 0, unescape(F.substr(x["p"], x["m"]["skip"] + 1, x["m"]["take"]))).otherwise("")), "")


def format_records(records: DataFrame, record_col: str = "record", mappings=MAPPINGS) -> DataFrame:
    """records with fingerprint, layout, turns, formatted and loss_mask (columns of these names are replaced).

    A record that isn't JSON or has a fingerprint of no mapping keeps null turns, formatted and loss_mask. An empty list of messages is
    an empty text. No rows give no rows; repeated rows are each formatted. A record may have any size that a string of Spark may have
    (2 GB); from LARGE bytes on it is parsed without a variant, whose limits would make it null. A larger conversation fails the task.
    """
    (parsed,) = fresh(records, "parsed_large")
    is_large = F.octet_length(record_col) >= LARGE
    v = F.when(~is_large, F.try_parse_json(F.col(record_col)))
    out = records.withColumn(parsed, F.when(is_large, parse_large(F.col(record_col), mappings)))
    large = F.col(parsed)
    out = out.withColumn("fingerprint", F.when(large.isNotNull(), fingerprint(large, mappings, by_fields)).otherwise(fingerprint(v, mappings)))
    layout = F.lit(None).cast("string")
    for m in mappings:
        layout = F.when(F.col("fingerprint").isin([fingerprint_of(x) for x in m.variants]), m.name).otherwise(layout)
    out = out.withColumn("layout", layout)
    turns = F.when(large.isNotNull(), turns_of(large, F.col("fingerprint"), mappings, by_fields)).otherwise(turns_of(v, F.col("fingerprint"), mappings))
    out = out.withColumn("turns", turns).drop(parsed)
    text, mask = render(F.col("turns"))
    return out.withColumn("formatted", text).withColumn("loss_mask", mask)


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): a JSON record for each conversation, its rows by turn (then role and text), in one of three layouts: a question
    with its answer, or a list of turns under the one or the other common pair of names. Null roles and texts are empty."""
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    by = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    named = lambda a, b, ts: F.transform(ts, lambda t: F.struct(t["role"].alias(a), t["text"].alias(b)))
    pair = (F.size("ts") == 2) & (F.col("ts")[0]["role"] == "user") & (F.get("ts", F.lit(1))["role"] == "assistant")
    odd = (F.pmod("conv_id", F.lit(2)) == 1) & ~F.exists("ts", lambda t: t["role"].isin("human", "gpt", "bot"))
    record = F.when(pair, F.to_json(F.struct(F.col("ts")[0]["text"].alias("prompt"), F.get("ts", F.lit(1))["text"].alias("response"))))
    record = record.when(odd, F.to_json(F.struct(named("from", "value", F.col("ts")).alias("conversations"))))
    return by.select("conv_id", record.otherwise(F.to_json(F.struct(named("role", "content", F.col("ts")).alias("messages")))).alias("record"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its mask say when read back."""
    back = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: The extra conversation of the query, and the query in DuckDB.
EXTRA = "</s>[INST] ok [/INST]"
_LONG = lambda c: f"length({c}) + length({c}) - length(translate({c}, '\\<[]', ''))"  # noqa: E731  each escaped character takes two places
SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{EXTRA}'), (-7, 1, 'assistant', '{EXTRA}')
), a as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
    coalesce(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text), '') as loss,
    sum({len(OPEN + HEAD_END + CLOSE)} + {_LONG("role")} + {_LONG("text")})::bigint as formatted_chars
  from c group by conv_id
)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from a
"""
