"""Line dedup by content-defined chunks.

A rolling hash over the hashes of the last three lines decides where a chunk ends, so boundaries depend on content alone and move
with it. Chunks of several lines that occur more than once anywhere, also within a document, go, but for their first occurrence. A repeated
passage whose ends lie inside of chunks is found by its runs of whole lines: from each line the fewest lines on, and to each
line the fewest lines back, that have `words` words. These lie in the passage and cover it, whatever stands around it.

What is compared are places (document, first line, last line) with hashes of their lines' hashes. Only hashes are shuffled for the search. The lines
of all places that repeat are then compared byte by byte: of each hash the least and the greatest line must be equal, which is counted
before anything is shuffled, so a line that very many documents share is one row a task. Two unlike lines of one hash have everything done
again with another salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, bound, drop_settled, fresh, semi, settle

#: One line in so many ends a chunk.
EVERY = 3
#: Words of the least run of lines that may go wherever it starts and ends.
RUN = 50
#: The rolling hash's base.
BASE = 31


def line_hash(line: Column, salt: int) -> Column:
    return F.xxhash64(line) if not salt else F.xxhash64(line, F.lit(salt), F.reverse(line))


def _looked_at(text: Column, salt: int) -> Column:
    """Of each line its hash, the number that is rolled on, its words."""
    number = lambda x: F.conv(F.right(F.md5(x), F.lit(6)), 16, 10).cast("long")
    return F.transform(F.split(text, "\n", -1), lambda x: F.struct(line_hash(x, salt).alias("h"), number(x).alias("v"), F.regexp_count(x, F.lit(f"[^{SPACE}]+")).alias("n")))


def _ends(rows: Column, every: int) -> Column:
    """The lines that end a chunk; the last one does."""
    v = lambda i: F.coalesce(F.get(rows, i)["v"], F.lit(0))
    cut = lambda r, i: ((r["v"] + v(i - 1) * BASE + v(i - 2) * BASE**2) % every == 0) | (i == F.size(rows) - 1)
    return F.filter(F.transform(rows, lambda r, i: F.when(cut(r, i), i)), lambda i: i.isNotNull())


def _pack(s: Column, e: Column) -> Column:
    return F.shiftleft(s.cast("long"), 32).bitwiseOR(e.cast("long"))


def places(text: Column, words: int = RUN, every: int = EVERY, salt: int = 0) -> Column:
    """(s, e, a, b): lines s to e and two hashes of their hashes, for chunks that have words in several lines and for runs of `words` words."""

    def reached(near: Column) -> Column:
        """(words, last line) once enough words are reached, of lines in order."""
        return F.aggregate(near, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at")), lambda a, x: F.when(a["n"] >= words, a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), x["at"].alias("at"))))

    def on(said: Column, i: Column, most: int) -> Column:
        return reached(F.slice(said, i + 1, F.lit(most)))

    def back(said: Column, i: Column, most: int) -> Column:
        return reached(F.reverse(F.slice(said, F.greatest(i - most + 2, F.lit(1)), F.least(i + 1, F.lit(most)))))

    def far(some: Column, more: Column) -> Column:
        """Few lines mostly do; a line with a word has one at least, so `words` lines always do where any number does."""
        return bound(some, lambda a: F.when(a["n"] >= words, a).otherwise(more))

    def runs(said: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            a, b = far(on(said, i, 4), on(said, i, words)), far(back(said, i, 4), back(said, i, words))
            return F.array(bound(a, lambda r: F.when(r["n"] >= words, _pack(x["at"], r["at"]))), bound(b, lambda r: F.when(r["n"] >= words, _pack(r["at"], x["at"]))))

        return F.flatten(F.transform(said, lambda x, i: F.when(x["n"] >= words, F.array(_pack(x["at"], x["at"]))).otherwise(one(x, i))))

    def found(rows: Column) -> Column:
        spans = lambda ends: F.transform(ends, lambda e, j: F.struct(F.coalesce(F.get(ends, j - 1) + 1, F.lit(0)).alias("s"), e.alias("e")))
        several = lambda w: (w["e"] > w["s"]) & (F.size(F.filter(F.slice(rows, w["s"] + 1, w["e"] - w["s"] + 1), lambda r: r["n"] > 0)) > 1)
        own = F.transform(F.filter(bound(_ends(rows, every), spans), several), lambda w: _pack(w["s"], w["e"]))
        said = F.filter(F.transform(rows, lambda r, i: F.struct(i.alias("at"), r["n"].alias("n"))), lambda x: x["n"] > 0)
        each = F.array_distinct(F.filter(F.concat(own, bound(said, runs)), lambda w: w.isNotNull()))
        hashes = F.transform(rows, lambda r: r["h"])

        def place(hs: Column, w: Column) -> Column:
            s, e = F.shiftright(w, 32).cast("int"), w.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
            return bound(F.slice(hs, s + 1, e - s + 1), lambda part: F.struct(s.alias("s"), e.alias("e"), F.xxhash64(part).alias("a"), F.xxhash64(F.lit(7), part).alias("b")))

        return bound(hashes, lambda hs: F.transform(each, lambda w: place(hs, w)))

    return bound(_looked_at(text, salt), found)


def _runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, s, e) as runs of lines, each line once."""
    upto = F.max("e").over(Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("s", F.greatest("s", F.coalesce(upto + 1, F.lit(0)))).filter("s <= e")


def _lines_of(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["s"], r["e"])))


def _marked(docs: DataFrame, id_col: str, text_col: str, words: int, every: int, salt: int = 0) -> tuple[DataFrame, str]:
    """docs with the runs of lines that go (null: none). A document is told apart by its id and a hash of its text."""
    id_, key, gone, seen = fresh(docs, "row_id", "row_key", "gone_lines", "seen_lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))
    found = settle(base.select("id", "k", F.inline(places(F.col("text"), words, every, salt))), "places")
    here = F.xxhash64("id", "k", "s")
    again = settle(found.select("a", here.alias("p")).groupBy("a").agg(F.min("p").alias("x"), F.max("p").alias("y")).filter("x <> y").select("a"), "repeats")
    repeated = settle(semi(found, again, "a"), "repeated-places")
    # settled too, so that the join has a shuffle on each side and a place of very many repeats can be split
    first = settle(repeated.groupBy("a", "b").agg(F.min(F.struct("id", "k", "s")).alias("f"), F.count("*").alias("c")).filter("c > 1").drop("c"), "first-places")
    own = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("k") == F.col("f.k"))
    low = F.when(own, F.greatest("s", F.col("f.s") + F.col("e") - F.col("s") + 1)).otherwise(F.col("s"))
    both = repeated.join(first, ["a", "b"]).select("id", "k", "s", "e", low.alias("low"))
    both = both.select("id", "k", F.explode(F.array(F.struct(F.lit(False).alias("goes"), "s", "e"), F.struct(F.lit(True).alias("goes"), F.col("low").alias("s"), "e"))).alias("r")).select("id", "k", "r.*").filter("s <= e")
    of = lambda goes: F.collect_list(F.when(F.col("goes") == goes, F.struct("s", "e")))
    marks = _runs(both, ["id", "k", "goes"]).groupBy(F.col("id").alias(id_), F.col("k").alias(key)).agg(of(True).alias(gone), of(False).alias(seen))
    with_ = docs.join(marks, docs[id_col].eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(key)), "left").drop(id_, key)
    with_ = settle(with_, "marked", compression="zstd")
    drop_settled(found, again, repeated, first)
    lines = with_.filter(F.col(seen).isNotNull()).select(bound(F.split(F.col(text_col), "\n", -1), lambda x: F.transform(_lines_of(F.col(seen)), lambda i: F.get(x, i))).alias("x")).select(F.explode("x").alias("x"))
    unlike = lines.groupBy(line_hash(F.col("x"), salt).alias("h")).agg(F.min("x").alias("least"), F.max("x").alias("most")).filter("least <> most")
    if not unlike.isEmpty():
        drop_settled(with_)
        return _marked(docs, id_col, text_col, words, every, salt + 1)
    return with_.drop(seen).withColumn(gone, F.when(F.size(gone) > 0, F.col(gone))), gone


def _left(text: Column, gone: Column) -> Column:
    """The lines that stay."""
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), _lines_of(gone))
    return bound(F.split(text, "\n", -1), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = RUN, every: int = EVERY) -> DataFrame:
    """(id_col, n_lines, n_removed, removed_chars, text): each row's text without the lines of places that repeat an earlier one.

    Earlier is less by id, then by text's hash and line. A place that overlaps its own first one keeps the overlap, so of each line that goes an earlier copy
    stays. Blank lines around a run stay. A null or empty text is one empty line and stays an empty text. Rows alike in id and text are one
    document, so neither is the other's repeat. Ids that are null come first. Other columns are not looked at. No rows give no rows.
    """
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col))
    with_, gone = _marked(base, id_col, text_col, words, every)
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(_left(F.col(text_col), F.col(gone)))
    n = F.when(F.col(gone).isNull(), 0).otherwise(F.size(_lines_of(F.col(gone))))
    out = with_.select(id_col, F.size(F.split(F.col(text_col), "\n", -1)).cast("long").alias("n_lines"), n.cast("long").alias("n_removed"), F.length(text_col).alias("chars"), text.alias("text_"))
    return out.select(id_col, "n_lines", "n_removed", (F.col("chars") - F.length("text_")).cast("long").alias("removed_chars"), F.col("text_").alias("text"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", words: int = RUN, every: int = EVERY) -> DataFrame:
    """docs, all columns, with texts as deduplicated() leaves them (and their length in chars_col). A row of which nothing is left goes."""
    with_, gone = _marked(docs, id_col, text_col, words, every)
    new = with_.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(_left(F.col(text_col), F.col(gone))))
    new = new.filter(F.col(gone).isNull() | (F.trim(F.col(text_col)) != ""))
    if chars_col in docs.columns:
        new = new.withColumn(chars_col, F.when(F.col(gone).isNull(), F.col(chars_col)).otherwise(F.length(F.col(text_col)).cast(docs.schema[chars_col].dataType)))
    return new.select(docs.columns)


#: The same as deduplicated() in DuckDB, on `documents` whose ids name one text each.
SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
u as (select distinct doc_id, text from d),
l as (select doc_id, x, i - 1 as i, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n, ('0x' || right(md5(x), 6))::bigint as v
  from (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from u)),
r as (select *, sum(n) over w as c, (v + {BASE} * coalesce(lag(v) over w, 0) + {BASE**2} * coalesce(lag(v, 2) over w, 0)) % {EVERY} = 0 as cut from l window w as (partition by doc_id order by i)),
b as (select *, coalesce(sum(cut::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as chunk from r),
q as (select doc_id, i, c, c - n as p from r where n > 0),
p as (
  select doc_id, min(i) as s, max(i) as e from b group by doc_id, chunk having count(*) filter (n > 0) > 1
  union select x.doc_id, x.i, y.i from (select *, p + {RUN} as want from q) x asof join q y on x.doc_id = y.doc_id and x.want <= y.c
  union select x.doc_id, y.i, x.i from (select *, c - {RUN} as want from q) x asof join q y on x.doc_id = y.doc_id and x.want >= y.p
),
t as (select p.*, array_to_string(string_split(text, chr(10))[s + 1:e + 1], chr(10)) as part from p join u using (doc_id)),
f as (select doc_id, s, e, first_value(doc_id) over w as fd, first_value(s) over w as fs from t window w as (partition by part order by doc_id, s)),
g as (select doc_id, case when fd = doc_id then greatest(s, fs + e - s + 1) else s end as lo, e from f where not (fd = doc_id and fs = s)),
z as (select distinct l.doc_id, i from l join g on g.doc_id = l.doc_id and i between lo and e),
o as (select l.doc_id, count(*) as n_lines, count(z.i) as n_removed, coalesce(string_agg(x, chr(10) order by l.i) filter (z.i is null), '') as left_ from l left join z on z.doc_id = l.doc_id and z.i = l.i group by l.doc_id)
select d.doc_id, n_lines, n_removed, length(d.text) - length(left_) as removed_chars, left_ as text from d join o using (doc_id)
"""
