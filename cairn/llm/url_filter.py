"""Operator 11, URL filter with rules and path-template trees, in DataFrame functions only.

A rule that fits a URL decides it. The others are judged by templates learned
from all URLs, those that rules decide being the labelled ones:

1. Shapes: a path's segments, digits and long hexadecimal tokens replaced by
   wildcards, counted per host. All later steps work on these counts.
2. Per host a tree of segments, built level by level from the root. Where a node has many
   children, the rare ones become one wildcard branch. Then children that are statistically
   like all siblings together are merged into one branch: their own children are distributed alike
   (chi-square), and so are the shares of labelled and, among these, of blocked URLs (binomial).
3. A branch's purity is its share of blocked among labelled URLs, smoothed by the purity of the branch
   above it, the root's by the share in all hosts. A template is rejected if it has labelled URLs
   and a purity of ``reject`` or more; one without any, wherever it lies, is allowed.

Nothing is gathered by host: counts are added up before they are shuffled, and a host
with a third of all URLs has as few rows here as it has different shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import checked_broadcast, table, write_stage

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
"""Fixed values: (verdict, host and path)."""
DEPTH, CHILDREN, SMOOTHING, REJECT, SIGMAS, TESTED = 8, 24, 4.0, 0.8, 3.0, 12
"""TESTED: URLs of a branch from which on it is compared with its siblings."""
END, REST, ANY, MERGED = "$", "**", "*", "~"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.split(rest, "[/?#]", 2)[0]
    path = F.split(F.substr(rest, F.length(host) + F.lit(1)), "[?#]", 2)[0]
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """The longest of ``rules`` that fits, as struct (rule, verdict); of equally long
    ones the first."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{start}" if "/" in rule else "")
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def shape(path: Column, depth: int = DEPTH) -> Column:
    """Segments of a path with wildcards for digits ({n}) and hexadecimal tokens
    of 8 or more ({x}), closed by ``$``; what is deeper than ``depth`` is one ``**``."""
    cut = F.split(F.substr(path, F.lit(2)), "/")
    general = F.transform(cut, lambda s: F.regexp_replace(F.regexp_replace(
        s, r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9A-Za-z])", "{x}"), "[0-9]+", "{n}"))
    general = F.when(F.size(general) > depth, F.concat(F.slice(general, 1, depth), F.array(F.lit(REST)))).otherwise(general)
    return F.when(path == "", F.array(F.lit(END))).otherwise(F.concat(general, F.array(F.lit(END))))


NODE = ["host", "node"]
COUNTS = ("n", "labelled", "blocked")


def _added(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])


def _likely(part: str, whole: str, all_part: str, all_whole: str, sigmas: float) -> Column:
    """Whether part of whole is as likely as all_part of all_whole, within
    ``sigmas`` standard deviations and the half for rounding."""
    x, n, p, m = (F.col(c).cast("double") for c in (part, whole, all_part, all_whole))
    return F.abs(x * m - n * p) <= sigmas * F.sqrt(n * p * (m - p)) + 0.5 * m


def grow_level(trees: DataFrame, level: int, children: int = CHILDREN, sigmas: float = SIGMAS, smoothing: float = SMOOTHING) -> DataFrame:
    """``trees`` one level deeper. Columns: host, node (the branch reached), segs,
    counts, purity (of the branch), support (its labelled URLs). Shapes that have ended stay as they are."""
    ended = F.size("segs") <= level
    at = trees.filter(~ended).withColumns({"child": F.col("segs")[level], "next": F.coalesce(F.get("segs", F.lit(level + 1)), F.lit(""))})
    steps = write_stage(_added(at, *NODE, "child", "next"), "op11-steps")
    # rare children of a node with many become one
    single = _added(steps, *NODE, "child")
    width = single.groupBy(*NODE).agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("width"))
    rare = (F.col("width") > children) & (F.col("n") * children < F.col("all_n")) & (F.col("child") != END)
    general = single.join(width, NODE).select(*NODE, "child", F.when(rare, ANY).otherwise(F.col("child")).alias("branch"))
    general = write_stage(general, "op11-general")
    # children whose continuations and labels look like those of all siblings together become one; a node has
    # at most 2 * children branches here, so the windows over them are small
    ways = _added(steps.join(general, [*NODE, "child"]).filter(F.col("child") != END), *NODE, "branch", "next")
    ways = write_stage(ways, "op11-ways")
    pooled = ways.groupBy(*NODE, "next").agg(F.sum("n").alias("next_n"))
    sums = ways.groupBy(*NODE).agg(F.sum("n").alias("all_n"), F.sum("labelled").alias("all_l"), F.sum("blocked").alias("all_b"),
                                   F.count_distinct("next").alias("kinds"))
    part = F.col("n").cast("double") * F.col("n") / F.col("next_n")
    fit = ways.join(pooled, [*NODE, "next"]).groupBy(*NODE, "branch").agg(
        F.sum(part).alias("fit"), *[F.sum(c).alias(c) for c in COUNTS])
    fit = fit.join(sums, NODE)
    free = F.col("kinds") - 1
    chi = F.col("fit") * F.col("all_n") / F.col("n") - F.col("n")
    alike = chi <= free + sigmas * F.sqrt(2.0 * free) + 1e-6
    alike = alike & (F.col("n") >= TESTED) & _likely("labelled", "n", "all_l", "all_n", sigmas)
    alike = alike & _likely("blocked", "labelled", "all_b", "all_l", sigmas)
    fit = fit.select(*NODE, "branch", alike.alias("alike"))
    several = F.count_if("alike").over(Window.partitionBy(*NODE)) > 1
    merged = fit.select(*NODE, "branch", F.when(F.col("alike") & several, MERGED).otherwise(F.col("branch")).alias("final"))
    names = general.join(merged, [*NODE, "branch"], "left")
    names = names.select(*NODE, "child", F.concat("node", F.lit("/"), F.coalesce("final", "branch")).alias("to"))
    moved = write_stage(at.drop("next").join(names, [*NODE, "child"]).drop("child"), "op11-moved")
    # purity of the new branches, smoothed by the one above
    new = moved.groupBy("host", "to").agg(F.sum("labelled").alias("support"), F.sum("blocked").alias("bad"), F.min("purity").alias("above"))
    new = new.select("host", "to", "support", ((F.col("bad") + smoothing * F.col("above")) / (F.col("support") + smoothing)).alias("purity"))
    moved = moved.drop("purity", "support").join(new, ["host", "to"]).drop("node").withColumnRenamed("to", "node")
    return write_stage(trees.filter(ended).unionByName(moved), "op11-trees")


def learn_templates(urls: DataFrame, depth: int = DEPTH, smoothing: float = SMOOTHING) -> DataFrame:
    """Templates of ``urls`` (host, path, blocked: true, false or null if not
    labelled): host, shape, template, labelled (its labelled URLs), purity."""
    label = F.col("blocked")
    counted = urls.select("host", shape(F.col("path"), depth).alias("segs"), label)
    counted = counted.groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labelled"), F.count_if("blocked").alias("blocked"))
    trees = write_stage(counted, "op11-shapes")
    bad, known, deepest = trees.agg(F.sum("blocked"), F.sum("labelled"), F.max(F.size("segs"))).first()
    share = ((bad or 0) + 1) / ((known or 0) + 2)
    roots = trees.groupBy("host").agg(F.sum("labelled").alias("support"), F.sum("blocked").alias("bad"))
    roots = roots.select("host", "support", ((F.col("bad") + smoothing * share) / (F.col("support") + smoothing)).alias("purity"))
    trees = trees.join(roots, "host").withColumn("node", F.lit(""))
    for level in range(deepest or 0):  # at most depth + 2
        trees = grow_level(trees, level, smoothing=smoothing)
    return trees.select("host", F.array_join("segs", "/").alias("shape"), F.col("node").alias("template"),
                        F.col("support").alias("labelled"), "purity")


def filter_urls(pages: DataFrame, rules=RULES, reject: float = REJECT) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (the rule that
    decides, else null), verdict (``allow`` or ``block``), template, labelled
    (labelled URLs of the template), purity.

    A null url and one without ``://`` have an empty host and path and a
    template of their own. Repeated rows count as often as they occur. Very long
    paths are read whole, with one wildcard below DEPTH. ``rules``, a list of some hundreds at most, may
    be empty: then nothing is labelled and all is allowed. An empty table gives no rows. Only page_id and url are read.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("told"))
    learned = learn_templates(rows.select("host", "path", (F.col("told") == "block").alias("blocked")))
    learned = write_stage(learned, "op11-templates")
    rows = rows.withColumn("shape", F.array_join(shape(F.col("path")), "/"))
    judged = rows.join(checked_broadcast(learned), ["host", "shape"])
    method = F.when((F.col("labelled") > 0) & (F.col("purity") >= reject), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("told", method).alias("verdict"), "template", "labelled", "purity")


def q_op11(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
