"""Temperature mixing of sources.

A source's share of the tokens is raised to an exponent and normalised: 1 leaves the shares as they are, 0 makes them equal. The
exponent is found by bisection, many points of the bracket at a time, for a target entropy or for a limit on how often a source
is repeated. A source's weight times the budget, over its tokens, is the number of its epochs. Each epoch is a permutation of the source's blocks'
documents; of a last, partial epoch each block takes as much of its permutation as its share of the budget, to the nearest document, so no
running total over a source is needed and a source with a third of all rows is spread over its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, settle, words_count

BLOCK_DOCS, POINTS, ROUNDS = 1024, 64, 5
#: Sources that are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None, low: float = 0.0, high: float = 1.0) -> float:
    """sources (tokens > 0): the largest exponent in [low, high] whose weights have at least this share of the greatest possible entropy,
    then, if that repeats a source more often than `repeats` against the least repeated one, the least exponent that doesn't.

    Entropy falls and repetition falls as the exponent grows. Each round compares POINTS exponents in one aggregate.
    """
    total = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("tokens").alias("a"), F.max("tokens").alias("b")).first()
    if not total["n"] or total["n"] == 1:
        return high
    p = sources.select((F.col("tokens") / F.lit(float(total["t"]))).alias("p"))

    def holds(lo: float, hi: float) -> list[tuple[float, float]]:
        points = [lo + (hi - lo) * i / POINTS for i in range(POINTS + 1)]
        e = p.select("p", F.explode(F.lit(points)).alias("e"))
        w = F.pow("p", F.col("e"))
        got = e.groupBy("e").agg(F.sum(w).alias("z"), F.sum(w * F.col("e") * F.log("p")).alias("s")).collect()  # POINTS + 1 rows
        return sorted((r["e"], (math.log(r["z"]) - r["s"] / r["z"]) / math.log(total["n"])) for r in got)

    found = high
    if entropy is not None:
        lo, hi = low, high
        for _ in range(ROUNDS):
            ok = [e for e, h in holds(lo, hi) if h >= entropy]
            if not ok:
                hi = lo
                break
            lo, hi = max(ok), min(hi, max(ok) + (hi - lo) / POINTS)
        found = lo
    if repeats is not None:  # epochs of the smallest source over those of the largest: (largest / smallest) ** (1 - exponent)
        ratio = total["b"] / total["a"]
        lo, hi = found, high
        if ratio ** (1 - found) > repeats:
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if ratio ** (1 - mid) <= repeats else (mid, hi)
            found = hi
    return found


def scale(sources: DataFrame, budget: float, repeats: float) -> float | None:
    """sources (tokens, raw > 0): the least x, to a part in 64**ROUNDS of the bracket, for which sources of x * raw tokens, each repeated `repeats` times at most, make up the
    budget; so what a source at its limit can't take goes to the others by their weights. None if even all at the limit don't."""
    ends = sources.agg(F.sum("tokens").alias("t"), F.sum("raw").alias("z"), F.max(F.col("tokens") * repeats / F.col("raw")).alias("m")).first()
    if not ends["t"] or budget >= ends["t"] * repeats:
        return None
    lo, hi = budget / ends["z"], max(ends["m"], budget / ends["z"])
    for _ in range(ROUNDS):
        points = [lo + (hi - lo) * i / POINTS for i in range(POINTS + 1)]
        each = sources.select("tokens", "raw", F.explode(F.lit(points)).alias("x")).groupBy("x").agg(F.sum(F.least(F.col("x") * F.col("raw"), F.col("tokens") * repeats)).alias("made")).collect()  # POINTS + 1 rows
        enough = sorted(r["x"] for r in each if r["made"] >= budget * (1 - 1e-12)) or [hi]
        lo, hi = max([p for p in points if p < enough[0]], default=enough[0]), enough[0]
    return hi


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _unit(number: Column) -> Column:
    """A 64-bit hash as a number from 0 to below 1."""
    return F.pmod(number, F.lit(1 << 30)) / F.lit(float(1 << 30))


def weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float | None = 0.98, repeats: float | None = 4.0, budget: int | None = None, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame]:
    """(sources, units). sources: key, docs, tokens, share, weight, epochs, blocks. units: key, k, id, source, tokens, one for
    all rows alike in id, source and text. With no budget the least repeated source gets one epoch, so nothing is left out. A budget
    is made up by the weights; a source that this would repeat more than `repeats` times stays at that, and the others take its part. A budget
    beyond `repeats` times everything is that much."""
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    k = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("null")), _key(F.col("source")), "text")
    # the hash tells texts of one id and source apart
    units = base.select(k.alias("k"), "id", "source", words_count(F.col("text")).cast("long").alias("tokens")).groupBy("k", "id", "source").agg(F.sum("tokens").alias("tokens"))
    units = settle(units.withColumn("key", _key(F.col("source"))), "units")
    sources = settle(units.groupBy("key").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")), "sources")
    e = exponent(sources.filter("tokens > 0"), entropy, repeats)
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"] or 1
    share = F.col("tokens") / F.lit(float(total))
    raw = sources.withColumn("share", share).withColumn("raw", F.when(F.col("tokens") > 0, F.pow("share", F.lit(e))).otherwise(0.0))
    sums = raw.agg(F.sum("raw").alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("raw"))).alias("m")).first()
    z = sums["z"] or 1.0
    if budget is None:
        x = sums["m"] or 0.0
    else:
        x = float(budget) / z if repeats is None else scale(raw.filter("tokens > 0"), float(budget), float(repeats))
    own = F.col("raw") * (x or 0.0) / F.col("tokens") if x is not None else F.lit(float(repeats))
    epochs = F.when(F.col("tokens") > 0, own if repeats is None or budget is None else F.least(own, F.lit(float(repeats)))).otherwise(1.0)
    epochs = F.when(F.abs(epochs - F.round(epochs)) < 1e-9, F.round(epochs)).otherwise(epochs)
    out = raw.withColumn("weight", F.col("raw") / z).withColumn("epochs", epochs).withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("long")).drop("raw")
    return settle(out, "weights"), units


def schedule(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """(id, source, epoch, block, position, n_tokens, weight): each unit once for every epoch that takes it; position counts from 0
    in its block. A null source is a source of its own. A source without tokens gets weight 0 and one epoch. Rows alike in
    id, source and text are one unit. A null text has no tokens. No rows give no rows; other columns are not looked at."""
    return _schedule(*weights(docs, **options), seed).select("id", "source", "epoch", "block", "position", "n_tokens", "weight")


def _schedule(sources: DataFrame, units: DataFrame, seed: int) -> DataFrame:
    s = sources.select("key", "weight", "epochs", "blocks")
    if s.count() <= BROADCAST_SOURCES:
        s = F.broadcast(s)
    u = units.join(s, "key")
    u = u.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "k", F.lit("block")), "blocks"))
    u = u.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs").cast("int"), F.lit(1)) - 1)))
    part = F.least(F.lit(1.0), F.col("epochs") - F.col("epoch"))
    order = Window.partitionBy("key", "epoch", "block").orderBy(F.xxhash64(F.lit(seed), "epoch", "k"), "k", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("key", "epoch", "block")
    u = u.withColumn("position", F.row_number().over(order) - 1).withColumn("upto", F.sum("tokens").over(upto)).withColumn("all", F.sum("tokens").over(whole))
    # a partial epoch ends where the middle of a document passes the block's share; the share is dithered by a document so blocks of one document come out right on average
    first = F.col("upto") - F.col("tokens") * (1 - _unit(F.xxhash64(F.lit(seed), "key", "epoch", "block")))
    taken = F.when(F.col("tokens") == 0, part >= 1).otherwise(first < part * F.col("all"))
    return u.filter((part >= 1) | taken).withColumnRenamed("tokens", "n_tokens")


def mixed(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """docs, all columns, each row as often as the schedule takes it."""
    key, k, id_, times, turn = fresh(docs, "row_key", "plan_key", "plan_id", "times", "turn")
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    plan = _schedule(*weights(docs, **options), seed).groupBy(F.col("k").alias(k), F.col("id").alias(id_)).agg(F.count("*").cast("int").alias(times))
    own = F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit("null")), _key(docs[source_col]), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    with_ = docs.withColumn(key, own).join(plan, F.col(key).eqNullSafe(F.col(k)) & docs[id_col].eqNullSafe(F.col(id_)))
    return with_.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)
