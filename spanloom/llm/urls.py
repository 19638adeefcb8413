"""URL filter by a path-template tree.

Per host, a tree of path segments: digit runs and hashes inside segments become wildcards at once; below each node literal
branches that are many and rare become one wildcard branch, and literal branches whose labelled shares of bad pages don't differ by a
two-proportion test from their parent's merge into one. Each page ends in one template of its host, and a template is rejected if its labelled
pages are bad to at least a limit, after smoothing: towards its host's share, which is smoothed towards that of the same
template over all hosts, which is smoothed towards 1/2; each with a weight of two pages.

Labels are weak and come from the page itself: its html's visible words, and marked words in its host's name; where they say nothing, from
the verdict of the rule that fits the page. A rule also decides its own pages; the tree decides all others.

The tree is grown on distinct (host, path shape) rows with counts, never on pages, so a host that holds a third of all pages is
aggregated before anything is shuffled by host. Each round takes every node to where its paths part, so a round is one parting, not one
segment, and a path of any depth that nothing parts from is one step.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound, drop_settled, settle

#: The rules of the registered query, as (verdict, rule).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Children from which a node's rare ones become a wildcard. Standard errors of the test. Share that rejects. Pages that a smoothing step weighs.
FAN_OUT, SIGMAS, LIMIT, WEIGHT = 24, 2.0, 0.8, 2
#: Labelled pages that a branch needs before it can merge.
LEAST = 10
#: Rules up to which each is a branch of the expression; more are joined by host.
UNROLLED = 200
#: Words in the names of hosts that lists of unwanted sites are kept for: adult, gambling, drugs, advertising, fraud.
SUSPECT = (
    *("adult", "escort", "escorts", "porn", "sex", "xxx"),
    *("bet", "bets", "betting", "casino", "casinos", "gambling", "poker", "slots"),
    *("cialis", "pharmacy", "pill", "pills", "viagra"),
    *("ad", "ads", "adserver", "banner", "banners", "click", "clicks", "pixel", "popup", "track", "tracker", "tracking"),
    *("malware", "phishing", "scam", "scams", "spam", "warez"),
)
#: Shares of a page's words that end in a run of marks: from which it is bad, to which it is good.
BAD_FROM, GOOD_TO = 0.3, 0.1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased; path: then up to "?", "#" or the end. Both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits. A rule "host/path" fits its host and all subdomains if the path starts with its path; the longest wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def with_rules(base: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """base (host, path, ...) with rule and say, as rule_of() has them, for any number of rules."""
    if len(rules) <= UNROLLED:
        rule, say = rule_of(F.col("host"), F.col("path"), rules)
        return base.withColumn("rule", rule).withColumn("say", say)
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], r, say) for say, r in rules]
    table = base.sparkSession.createDataFrame(rows, "suffix string, start string, rule string, say string")
    labels = F.split("host", r"\.", -1)
    suffixes = bound(labels, lambda x: F.transform(x, lambda _, i: F.array_join(F.slice(x, i + 1, F.size(x)), ".")))
    hosts = base.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(table, "suffix")
    by = hosts.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "start", "say"))).alias("rs"))
    fits = F.filter("rs", lambda r: F.col("path").startswith(r["start"]))
    out = base.join(by, "host", "left").withColumn("r", F.try_element_at(fits, F.lit(-1)))
    return out.select(*base.columns, F.col("r.rule").alias("rule"), F.col("r.say").alias("say"))


def evidence(host: Column, html: Column) -> Column:
    """1: bad, 0: good, null: nothing is known. Bad is a page whose host has a suspect word in its name, or of whose visible words many end in a run of marks."""
    named = F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(x) for x in SUSPECT]))
    seen = F.regexp_replace(F.regexp_replace(html, r"(?s)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " "), "&amp;", "&")
    words, marked = F.regexp_count(seen, F.lit(r"[^\s]+")), F.regexp_count(seen, F.lit(r"[!#$%&*+=@^_|~]{2,}(?=[\s.,]|$)"))
    share = bound(F.struct(words.alias("n"), marked.alias("m")), lambda x: F.when(x["n"] > 0, x["m"] / x["n"]))
    return F.when(named, 1).otherwise(bound(share, lambda x: F.when(x >= BAD_FROM, 1).when(x <= GOOD_TO, 0)))


def shape(path: Column) -> Column:
    """The path's segments with digit runs and hexadecimal names generalised."""
    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), lambda s: F.when(s.rlike("^[0-9a-fA-F-]{12,}$"), "{hash}").otherwise(F.regexp_replace(s, "[0-9]+", "{n}")))


def templates(shapes: DataFrame, fan_out: int = FAN_OUT, sigmas: float = SIGMAS) -> DataFrame:
    """shapes (host, shape, n, labelled, bad) with their template: one row each."""
    sums = ("n", "labelled", "bad")
    keep = ["host", "shape", *sums]
    t, done = settle(shapes.select(*keep, F.array().cast("array<string>").alias("node"), F.col("shape").alias("rest")), "tree"), []
    while True:
        done.append(t.filter(F.size("rest") == 0).select(*keep, "node"))
        t = t.filter(F.size("rest") > 0)
        if t.isEmpty():
            break
        ends = t.groupBy("host", "node").agg(F.min("rest").alias("x"), F.max("rest").alias("y"))
        alike = F.transform(F.col("x"), lambda s, i: F.coalesce(F.get("y", i) == s, F.lit(False)))
        ends = ends.select("host", "node", bound(F.array_position(alike, F.lit(False)).cast("int"), lambda p: F.when(p == 0, F.size("x")).otherwise(p - 1)).alias("to"))
        # all paths of a node have their first segments in common: nothing merges there
        at = t.join(ends, ["host", "node"]).withColumn("node", F.concat("node", F.slice("rest", F.lit(1), F.col("to")))).withColumn("rest", F.slice("rest", F.col("to") + 1, F.size("rest"))).drop("to")
        at = settle(at, "tree")
        below = at.filter(F.size("rest") > 0).groupBy("host", "node", F.get("rest", F.lit(0)).alias("seg")).agg(*[F.sum(c).alias(c) for c in sums])
        literal = ~F.contains("seg", F.lit("{"))
        here = below.groupBy("host", "node").agg(F.count(F.when(literal, 1)).alias("kinds"), F.sum("n").alias("all"), F.sum(F.when(literal, F.col("labelled")).otherwise(0)).alias("l"), F.sum(F.when(literal, F.col("bad")).otherwise(0)).alias("b"))
        rare = literal & (F.col("kinds") >= fan_out) & (F.col("n") * fan_out < F.col("all"))
        p = F.col("b") / F.col("l")
        same = literal & (F.col("labelled") >= LEAST) & (F.col("labelled") < F.col("l")) & (F.abs(F.col("bad") / F.col("labelled") - p) <= sigmas * F.sqrt(p * (1 - p) / F.col("labelled")))
        to = F.when(rare, "*").when(F.when(F.col("labelled") > 0, same).otherwise(False), "~").otherwise(F.col("seg"))
        branch = below.join(here, ["host", "node"]).select("host", "node", "seg", to.alias("branch"))
        new = at.withColumn("seg", F.get("rest", F.lit(0))).join(branch, ["host", "node", "seg"], "left")
        step = F.col("branch").isNotNull()
        t = settle(new.select(*keep, F.when(step, F.concat("node", F.array("branch"))).otherwise(F.col("node")).alias("node"), F.when(step, F.slice("rest", F.lit(2), F.size("rest"))).otherwise(F.col("rest")).alias("rest")), "tree")
        drop_settled(at)
    return reduce(DataFrame.union, done).withColumn("template", F.concat_ws("", F.transform("node", lambda s: F.concat(F.lit("/"), s)))).drop("node")


def purity(found: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """(host, template, purity) of templates(): the smoothed share of bad ones among labelled pages."""
    own = found.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    smooth = lambda b, l, to: (b + weight * to) / (l + weight)
    hosts = found.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    alike = found.groupBy("template").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb"))
    of = own.join(hosts, "host").join(alike, "template")
    everywhere = smooth(F.col("tb"), F.col("tl"), F.lit(0.5))
    return of.select("host", "template", smooth(F.col("b"), F.col("l"), smooth(F.col("hb"), F.col("hl"), everywhere)).alias("purity"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", limit: float = LIMIT, **options) -> DataFrame:
    """(id_col, host, path, rule, verdict, template, purity) for each row of pages.

    verdict is the rule's where one fits, else block if the page's template is rejected, else allow. A null url, or one without
    "://", has an empty host and path and no rule. A null html, or no such column, is no evidence. Urls have any length and depth. Repeated rows
    repeat and count as often; a null id stays null. Other columns are not looked at. No rows give no rows.
    """
    host, path = host_and_path(F.col("url"))
    html = F.col(html_col).cast("string") if html_col in pages.columns else F.lit(None).cast("string")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html")).select("id", host.alias("host"), path.alias("path"), "html")
    base = with_rules(base, rules).withColumn("shape", shape(F.col("path")))
    label = F.coalesce(evidence(F.col("host"), F.col("html")), F.when(F.col("say") == "block", 1).when(F.col("say") == "allow", 0))
    shapes = base.select("host", "shape", label.alias("label")).groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    t = settle(templates(shapes, **options), "templates")
    of = t.select("host", "shape", "template").join(purity(t), ["host", "template"])
    out = base.drop("html").join(of, ["host", "shape"], "left")
    verdict = F.coalesce("say", F.when(F.col("purity") >= limit, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
