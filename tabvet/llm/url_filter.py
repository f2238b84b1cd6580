"""URL filter by a path-template tree per host (DataFrame functions only).

1. A url gives its host (after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased) and its path (from
   there up to `?`, `#` or the end). Fixed rules decide first; the longest fitting rule wins.
2. Lexical generalisation: path segments with a digit, very long ones and many-worded ones become `*` (a file ending
   stays). Only the (host, template) totals go on.
3. The tree is built level by level, as deep as the paths go. Totals are regrouped by host and generalised prefix before
   the next level is judged, so branches that became one sum their urls, labels and sub-branches.
   - A branch with fewer than `min_rows` urls, or without a label, becomes `*`.
   - The labelled branches of one parent are ordered by their blocked share, in at most `BANDS` bands, and neighbours
     that do not differ by more than `z` standard errors become one: `*` if it holds the small branches or all labelled
     ones, otherwise `{least|*}`, named by its least segment.
   - A prefix that holds one template only keeps its remaining segments; one below `min_rows` gets `*` for them.
4. Purity: every node's share of labelled urls that are blocked, smoothed towards its parent (host towards all hosts); a
   node that holds all of its parent's labels, or none, takes the parent's purity.
5. Back-off: the same tree is built of the templates pooled over all hosts. A template whose host has no labelled node
   on its path below the host takes the purity of its pooled node, if that has labels below the root; then the host's
   purity, and for a host without labels the prior of all urls.
6. A template whose purity reaches `reject_at` is blocked.

The labels are the urls that the rules decide, so nothing besides the url is read. Hosts are never gathered in one
task: all groupings are sums with partial aggregates, and what meets per parent is at most `BANDS` + 2 rows.

Nulls: a null url, or one without `://`, has empty host and path, fits no rule and belongs to the empty host's tree.
Repeated rows are judged alike, each with its own output row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm.common import read
from tabvet.session import materialize, release

#: Fixed values: (host, path, verdict) of the rules.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
BANDS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """page_id, host, path."""
    whole = F.coalesce(F.col(url).cast("string"), F.lit(""))
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER)
    return pages.select("page_id", host.alias("host"), F.regexp_extract(whole, pattern, 2).alias("path"))


def fitting_rule(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits host and path; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest ends up outermost
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text = F.when(fits, F.lit(host + path)).otherwise(text)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def lexical_template(path: Column) -> Column:
    """Array of the path's segments, the variable ones generalised."""

    def general(s: Column) -> Column:
        ending = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        variable = s.rlike(r"[0-9]") | (F.length(s) > 32) | (F.size(F.split(s, "[-_+%]")) > 3)
        return F.when(variable, F.concat(F.lit("*"), ending)).otherwise(s)

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)


SUMS = ("n", "labelled", "blocked")


def merged_bands(bands: DataFrame, z: float) -> DataFrame:
    """tree, at, band, mark: bands of labelled branches, neighbours that do not differ have one mark.

    bands(tree, at, band, branches, least, n, labelled, blocked); band -1 holds the small branches. The marks are the
    next parts of the prefix: "*", "=" and a segment, or "~" and the least of several segments."""
    item = F.struct((F.col("blocked") / F.col("labelled")).alias("share"), "band", "branches", "least", *SUMS)
    one = "struct<bands:array<int>,branches:bigint,least:string,n:bigint,labelled:bigint,blocked:bigint>"

    def made(bands: Column, branches: Column, least: Column, sums: list[Column]) -> Column:
        return F.struct(bands, branches, least, *sums).cast(one)

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        sums = [last[c] + x[c] for c in SUMS]
        both = sums[2] / sums[1]
        error = F.sqrt(both * (1 - both) * (1 / last["labelled"] + 1 / x["labelled"]))
        alike = F.abs(last["blocked"] / last["labelled"] - x["share"]) <= z * error
        alone = made(F.array(x["band"]), x["branches"], x["least"], [x[c] for c in SUMS])
        joined = made(F.concat(last["bands"], F.array(x["band"])), last["branches"] + x["branches"], F.least(last["least"], x["least"]), sums)
        return F.when(alike, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(alone)))

    listed = bands.where("labelled > 0").groupBy("tree", "at").agg(F.sort_array(F.collect_list(item)).alias("items"))
    first = F.expr("get(items, 0)")
    start = F.array(made(F.array(first["band"]), first["branches"], first["least"], [first[c] for c in SUMS]))
    grouped = listed.select("tree", "at", F.aggregate(F.expr("slice(items, 2, size(items))"), start, step).alias("groups"))
    each = grouped.select("tree", "at", F.size("groups").alias("count"), F.explode("groups").alias("g"))
    small = F.array_contains("g.bands", -1) | ((F.col("count") == 1) & (F.col("g.branches") > 1))
    mark = F.when(small, F.lit("*")).when(F.col("g.branches") == 1, F.concat(F.lit("="), "g.least")).otherwise(F.concat(F.lit("~"), "g.least"))
    return each.select("tree", "at", F.explode("g.bands").alias("band"), mark.alias("mark"))


def shown(at: Column) -> Column:
    name = lambda m: F.when(m.startswith("="), F.substr(m, F.lit(2))).when(m.startswith("~"), F.concat(F.lit("{"), F.substr(m, F.lit(2)), F.lit("|*}"))).otherwise(m)
    return F.concat(F.lit("/"), F.array_join(F.transform(at, name), "/"))


def walked(totals: DataFrame, prior: float, min_rows: int, alpha: float, z: float) -> DataFrame:
    """tree, segments, template, purity, level for each row of totals(tree, segments, n, labelled, blocked).

    level is the depth of the deepest node with labels, -1 where not even the root has any."""
    again = [F.sum(c).alias(c) for c in SUMS]
    root = totals.groupBy("tree").agg(F.sum("labelled").alias("seen"), F.sum("blocked").alias("hits"))
    smooth = lambda hits, seen, parent: (hits + F.lit(alpha) * parent) / (seen + F.lit(alpha))
    root = root.select("tree", "seen", smooth(F.col("hits"), F.col("seen"), F.lit(prior)).alias("purity"), F.when(F.col("seen") > 0, 0).otherwise(-1).alias("level"))
    state = materialize(totals.join(root, "tree").withColumn("at", F.array().cast("array<string>")))
    done, depth = [], 0
    final = ["tree", "segments", "at", "purity", "level"]
    while True:
        ended = F.size("segments") <= depth
        done.append(state.where(ended).select(*final))
        active = state.where(~ended)
        if active.isEmpty():
            break
        depth += 1
        active = active.withColumn("segment", F.element_at("segments", depth))
        branches = active.groupBy("tree", "at", "segment").agg(*again)
        few = (F.col("n") < min_rows) | (F.col("labelled") == 0)
        share = F.asin(F.sqrt(F.col("blocked") / F.col("labelled"))) * (2 / math.pi)
        branches = materialize(branches.withColumn("band", F.when(few, -1).otherwise(F.floor(share * (BANDS - 1)).cast("int"))))
        bands = branches.groupBy("tree", "at", "band").agg(F.count(F.lit(1)).alias("branches"), F.min("segment").alias("least"), *again)
        marks = merged_bands(bands, z)
        marked = branches.join(marks, ["tree", "at", "band"], "left").withColumn("mark", F.coalesce("mark", F.lit("*")))
        names = marked.select("tree", "at", "segment", "mark")
        named = active.join(names, ["tree", "at", "segment"])
        nodes = named.groupBy("tree", "at", "mark").agg(
            F.sum("n").alias("node_n"), F.sum("labelled").alias("node_seen"), F.sum("blocked").alias("node_hits"), F.count(F.lit(1)).alias("templates")
        )
        met = named.join(nodes, ["tree", "at", "mark"])
        own = (F.col("node_seen") > 0) & (F.col("node_seen") < F.col("seen"))
        purity = F.when(own, smooth(F.col("node_hits"), F.col("node_seen"), F.col("purity"))).otherwise(F.col("purity"))
        level = F.when(F.col("node_seen") > 0, depth).otherwise(F.col("level"))
        rest = F.slice("segments", depth + 1, F.greatest(F.size("segments") - depth, F.lit(0)))
        tail = (
            F.when(F.col("node_n") < min_rows, F.transform(rest, lambda s: F.lit("*")))
            .when(F.col("templates") == 1, F.transform(rest, lambda s: F.concat(F.lit("="), s)))
            .otherwise(F.array().cast("array<string>"))
        )
        over = (F.col("node_n") < min_rows) | (F.col("templates") == 1)
        after = met.select(
            "tree", F.when(over, F.slice("segments", 1, depth)).otherwise(F.col("segments")).alias("left"), "segments", *SUMS,
            purity.alias("purity"), level.alias("level"), F.col("node_seen").alias("seen"), F.concat("at", F.array("mark"), tail).alias("at"),
        )
        after = materialize(after)
        done.append(after.where(F.size("left") <= depth).select(*final))
        going = after.where(F.size("left") > depth).drop("left")
        release(branches)
        state = going
        if going.isEmpty():
            break
    out = functools.reduce(DataFrame.unionByName, done)
    return out.select("tree", "segments", shown(F.col("at")).alias("template"), "purity", "level")


def template_tree(rows: DataFrame, min_rows: int = 5, alpha: float = 4.0, z: float = 1.96) -> DataFrame:
    """host, segments, template, purity, level for each (host, lexical template) of rows(host, segments, label).

    label is 1 for blocked, 0 for allowed, null for unlabelled. level says what gave the purity: branch (a node below the
    host), pooled (a template of all hosts), host or prior."""
    sums = [F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")]
    totals = materialize(rows.groupBy("host", "segments").agg(*sums))
    seen, blocked = totals.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    prior = (blocked + 0.5) / (seen + 1.0)
    pooled = totals.groupBy("segments").agg(*[F.sum(c).alias(c) for c in SUMS])
    named = lambda mark, host: F.concat(F.lit(mark), host)
    both = totals.withColumn("tree", named("h", F.col("host"))).drop("host").unionByName(pooled.withColumn("tree", F.lit("p")))
    trees = materialize(walked(both, prior, min_rows, alpha, z))
    every = trees.where("tree = 'p'").select("segments", F.col("purity").alias("every"), F.col("level").alias("depth"))
    own = trees.where("tree <> 'p'").withColumn("host", F.expr("substr(tree, 2)")).join(every, "segments")
    back = (F.col("level") < 1) & (F.col("depth") > 0)
    level = F.when(F.col("level") > 0, "branch").when(back, "pooled").when(F.col("level") == 0, "host").otherwise("prior")
    return own.select("host", "segments", "template", F.when(back, F.col("every")).otherwise(F.col("purity")).alias("purity"), level.alias("level"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, reject_at: float = 0.8, **options) -> DataFrame:
    """The rows of `url_filter` with the level (rule, branch, pooled, host or prior) that decides each."""
    text, says = fitting_rule(rules)
    rows = parsed(pages).select("page_id", "host", "path", text.alias("rule"), says.alias("says"), lexical_template(F.col("path")).alias("segments"))
    label = F.when(F.col("says") == "block", 1).when(F.col("says") == "allow", 0)
    tree = template_tree(rows.select("host", "segments", label.alias("label")), **options)
    verdict = F.coalesce("says", F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow")))
    level = F.when(F.col("says").isNotNull(), "rule").otherwise(F.col("level"))
    met = rows.join(tree, ["host", "segments"])
    return met.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity", level.alias("level"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, reject_at: float = 0.8, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of pages(page_id, url)."""
    return judged(pages, rules, reject_at, **options).drop("level")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))
