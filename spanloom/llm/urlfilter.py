"""URL filters: explicit rules first, then a path-template tree judged by smoothed labelled purity.

``rules`` name a host and a path prefix; a rule fits the host and all its subdomains, the longest one wins.
What no rule fits is judged by its template.  Per host, paths (as segments, with their number of pages and of
pages that rules block or allow: the labels) are read segment by segment.  At each node of the tree:

* segments that are numbers, or long hexadecimal names, are classes from the start (``{n}``, ``{x}``);
* a child keeps its name only if its share of blocked pages, among all its pages or among its labelled ones,
  differs from its node's by more than ``Z`` standard errors (and one half page): children that are
  statistically alike merge into the wildcard, and so do all below a node whose labels all allow;
* a node with more than ``FAN`` different children is variable: of its children without labels, those with
  at most ``FAN`` pages and less than ``SHARE`` of the node's merge too (a slug is no evidence of its own).

Most templates of a host have no labels of their own.  So the same tree is grown for every host's registrable
name, for its top-level name and for all hosts together; there a host counts once for each of its paths, by the
share of its labelled pages that are blocked, so that no large host decides for the others.  A template's purity is
(blocked + STRENGTH * purity of the path's template one level up) / (labelled + STRENGTH), from ``PRIOR`` at the
top down to the host: a template without evidence has its parent's purity.  It is rejected at ``REJECT``.

All of it is DataFrame operations.  Scale: pages are reduced to distinct (host, segments) with map-side sums
before anything else; every level is aggregates plus equi-joins on (name, prefix), with no window over a
host's paths, so a host with a third of all pages is split like any large join.  A node whose pages are all
blocked or none of them, or that has one path or fewer than ``LEAST`` pages, can't differ from what is below it:
its paths are finished at once.  Below other nodes a step goes to where their paths part (the common beginning of the least and the
greatest), so the steps are as many as the forks on a path, not its segments.  Only whether there are such nodes
reaches the driver.

Defined cases: null urls and urls without ``://`` have empty host and path, and no evidence but the prior; an
empty path fits no rule; repeated rows are judged alike; an empty table gives no rows; extra columns are kept
by ``judge``, but for those named as its own (host, path, rule, verdict, template, purity), which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, without

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
FAN = 16
SHARE = 0.1
Z = 2.0
#: Below so many pages no child can differ by ``Z`` standard errors and a half: of N pages a child with a share p, all blocked, would
#: need N p (1 - p) > Z p sqrt(N (1 - p)) + 1 / 2 at least, which no p in (0, 1) meets for N up to 9.
LEAST = 10
STRENGTH = 4.0
PRIOR = 0.2
REJECT = 0.7


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        out = F.when(fits, rule).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, verdict).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The path's segments as classes or names."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^[0-9]+$"), "{n}").when(s.rlike(r"^[0-9]+\.[A-Za-z]+$"), F.regexp_replace(s, r"^[0-9]+", "{n}")).when(s.rlike(r"^[0-9A-Fa-f-]{16,}$"), "{x}").otherwise(s),
    )


def _levels(host: Column) -> Column:
    """Structs (level, name): the host, its registrable name, its top-level name, and all hosts."""
    last_two, last = F.regexp_extract(host, r"[^.]+\.[^.]+$", 0), F.regexp_extract(host, r"[^.]+$", 0)
    names = [host, F.when((last_two != "") & (last_two != host), last_two), F.when((last != "") & (last != host), last), F.when(host != "", "")]
    levels = F.array(*[F.struct(F.lit(k).alias("level"), n.alias("name")) for k, n in enumerate(names)])
    return F.filter(levels, lambda x: x["name"].isNotNull())


def _common(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def _grow(paths: DataFrame) -> DataFrame:
    """``paths(level, name, key, segs, n, blocked, told)`` with their template: the tree of every (level, name)."""
    node = ["level", "name", "prefix", "at"]
    paths = paths.select("*", F.lit("").alias("prefix"), F.lit(0).alias("at"), (F.size("segs") > 0).alias("open"))
    done, open_ = paths.where("not open"), paths.where("open")
    sums = [F.sum(c).alias(c) for c in ("n", "blocked", "told")]
    kept = ["level", "name", "key", "n", "blocked", "told", "segs"]

    def merged(s: Column) -> Column:
        # A class stays visible in the template whether or not it merged with its siblings.
        return F.when(s.startswith("{"), s).otherwise("*")

    def met(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
        """``left`` with the row of ``right`` of the same ``names``, whose columns are led by ``own_``."""
        right = right.select(*[F.col(c).alias(f"own_{c}") for c in right.columns])
        same = F.lit(True)
        for c in names:
            same &= F.col(c) == F.col(f"own_{c}")
        return left.join(right, same, how)

    step = 0
    while not open_.isEmpty():
        # Of each node what its paths have in common: the first segments of the least and the greatest of them.
        rest = F.slice("segs", F.col("at") + 1, F.size("segs"))
        nodes = open_.groupBy(*node).agg(*sums, F.count("*").alias("rows"), F.min(rest).alias("low"), F.max(rest).alias("high"))
        nodes = nodes.where((F.col("blocked") > 0) & (F.col("blocked") < F.col("n")) & (F.col("rows") > 1) & (F.col("n") >= LEAST)).select(*node, *[F.col(c).alias(f"all_{c}") for c in ("n", "blocked", "told")], _common(F.col("low"), F.col("high")).alias("jump"))
        nodes = cut(nodes, f"nodes{step}")
        # A node without a row here can't differ from what is below it: its paths are finished.
        told = met(open_, nodes, node, "left")
        ends = told.where("own_at is null").select(*kept, F.concat_ws("/", "prefix", F.transform(rest, merged)).alias("prefix"), "at", F.lit(False).alias("open"))
        # Along a chain all have their node's share: it merges in one step, however long it is.
        further = F.col("at") + F.col("own_jump")
        chain = F.transform(F.slice("segs", F.col("at") + 1, F.col("own_jump")), merged)
        jumps = told.where("own_jump > 0").select(*kept, F.concat_ws("/", "prefix", chain).alias("prefix"), further.alias("at"), (F.size("segs") > further).alias("open"))
        # Where paths part, a child keeps its name if its share differs.
        forks = nodes.where("jump = 0")
        seg = F.get("segs", F.col("at"))
        kids = open_.join(forks.select(*node), node, "left_semi").groupBy(*node, seg.alias("seg")).agg(*sums)
        fan = kids.groupBy(*node).agg(F.count("*").alias("fan"))
        differs = F.lit(False)
        for n in ("n", "told"):
            rate = F.col("all_blocked") / F.col(f"all_{n}")
            gap = F.abs(F.col("blocked") - F.col(n) * rate)
            differs |= gap > Z * F.sqrt(F.col(n) * rate * (1 - rate)) + 0.5
        named = (F.col("told") > 0) | (F.col("fan") <= FAN) | (F.col("n") > FAN) | (F.col("n") >= SHARE * F.col("all_n"))
        kids = kids.join(forks, node).join(fan, node).select(*node, "seg", (differs & named).alias("keeps"))
        forked = met(open_.withColumn("seg", seg), kids, [*node, "seg"], "inner")
        prefix = F.concat_ws("/", "prefix", F.when(F.col("own_keeps"), F.col("seg")).otherwise(merged(F.col("seg"))))
        parted = forked.select(*kept, prefix.alias("prefix"), (F.col("at") + 1).alias("at"), (F.size("segs") > F.col("at") + 1).alias("open"))
        grown = cut(ends.unionByName(jumps).unionByName(parted), f"step{step}")
        done, open_ = done.unionByName(grown.where("not open")), grown.where("open")
        step += 1
    return done.drop("at").withColumnRenamed("prefix", "template")


def path_key(path: Column) -> Column:
    return F.concat_ws("/", segments(path))


def templates(labelled: DataFrame) -> DataFrame:
    """(host, key, template, purity) for the distinct hosts and path keys of ``labelled(host, path, verdict)``.

    ``verdict`` is block, allow or null (no label).
    """
    counts = [F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count_if(F.col("verdict").isNotNull()).alias("told")]
    paths = labelled.select("host", segments(F.col("path")).alias("segs"), "verdict").groupBy("host", "segs").agg(*counts)
    paths = cut(paths.withColumn("key", F.concat_ws("/", "segs")), "paths")
    leveled = paths.select("*", F.inline(_levels(F.col("host"))))
    # Above the host, a host's path is one unit: what share of its labelled pages is blocked.
    once = F.col("level") > 0
    counted = [
        F.when(once, 1.0).otherwise(F.col("n")).alias("n"),
        F.when(once & (F.col("told") > 0), F.col("blocked") / F.col("told")).otherwise(F.col("blocked")).cast("double").alias("blocked"),
        F.when(once, F.least("told", F.lit(1))).otherwise(F.col("told")).cast("double").alias("told"),
    ]
    units = leveled.select("level", "name", "key", "segs", *counted).groupBy("level", "name", "key", "segs").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "told")])
    trees = _grow(cut(units, "units"))
    pure = trees.groupBy("level", "name", "template").agg(F.sum("blocked").alias("all_blocked"), F.sum("told").alias("all_told"))
    judged = trees.join(pure, ["level", "name", "template"]).select("level", "name", "key", "template", "all_blocked", "all_told")
    steps = leveled.select("host", "key", "level", "name").join(judged, ["level", "name", "key"])
    steps = steps.groupBy("host", "key").agg(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("at"), "template", "all_blocked", "all_told"))).alias("steps"))
    purity = F.aggregate("steps", F.lit(PRIOR), lambda p, x: (x["all_blocked"] + STRENGTH * p) / (x["all_told"] + STRENGTH))
    own = F.element_at("steps", -1)["template"]
    return steps.select("host", "key", F.concat("host", own).alias("template"), purity.alias("purity"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and the template and purity of what no rule fits."""
    pages = without(pages, "host", "path", "rule", "verdict", "template", "purity")
    host, path = host_and_path(F.col("url"))
    told = pages.withColumns({"host": host, "path": path}).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    told = told.withColumn("verdict", verdict_of(F.col("rule"), rules))
    tree = templates(told.select("host", "path", "verdict"))
    tree = tree.select(F.col("host").alias("_tree_host"), F.col("key").alias("_tree_key"), "template", "purity")
    open_ = told.where("rule is null").drop("verdict")
    open_ = open_.join(tree, (F.col("host") == F.col("_tree_host")) & (path_key(F.col("path")) == F.col("_tree_key")))
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    columns = [*pages.columns, "host", "path", "rule", "verdict", "template", "purity"]
    open_ = open_.withColumn("verdict", method).select(columns)
    fixed = told.where("rule is not null").withColumns({"template": F.lit(None).cast("string"), "purity": F.lit(None).cast("double")})
    return fixed.select(columns).union(open_)


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")
