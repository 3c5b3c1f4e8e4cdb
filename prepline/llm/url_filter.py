"""Operator 5, URL filters: path-template tree, native.

Every url is parsed into host and path, and given rules decide it where one fits. The urls a
rule decides are the labelled ones; all others are judged by a tree of path templates per
host. Segments become wildcards by kind (digits, digits with an ending, long hexadecimal
strings) and, level by level, by count: below one parent, a segment stays literal if it has
at least ``LITERAL_SHARE`` of the parent's urls, else it becomes ``*``. From the deepest level
up, sibling templates whose labelled block rates do not differ (two-proportion z test against
the rest of the parent's urls) are merged into one branch. A branch's purity is its labelled
share of allowed urls, smoothed towards its parent's, up to the host's and the global share;
a url is blocked if its branch's smoothed purity is below ``MIN_PURITY``. A host without a
labelled url takes the global share, which blocks only if most labelled urls are blocked.

Pages are first summed up by host and kind template, so a host with a third of all pages is
a few rows from then on; the levels work on these rows. The tree is as deep as its branches: the
first ``LEVELS`` levels are one plan, each further one a step of its own, until every deeper
path is alone under its node. The rest of such a path has no siblings, so all its segments
are literal and merge into ``~``: it is put on, and its purity computed, in one step.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and
is judged as the host ``''``; repeated rows count and are returned each; an empty table gives
no rows; the longest fitting rule (host and path together) wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepline.llm.common import HEAVY_SHARE, ascii_lower, cut

#: (host, path, verdict); a rule is written as host + path
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LEVELS = 4
LITERAL_SHARE = 0.05
Z_MERGE = 1.96
PRIOR = 5.0
MIN_PURITY = 0.5


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, F.lit(h + p)).otherwise(name if name is not None else F.lit(None).cast("string"))
        verdict = F.when(fits, F.lit(v)).otherwise(verdict if verdict is not None else F.lit(None).cast("string"))
    return name, verdict


def kinds(path: Column) -> Column:
    """The path's segments with variable ones replaced by their kind."""

    def kind(s: Column) -> Column:
        return (
            F.when(s.rlike(r"\A[0-9]+\z"), F.lit("{n}"))
            .when(s.rlike(r"\A[0-9]+\.[A-Za-z]+\z"), F.concat(F.lit("{n}."), F.substring_index(s, ".", -1)))
            .when(s.rlike(r"\A[0-9a-fA-F-]{12,}\z"), F.lit("{h}"))
            .otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))
        )

    return F.transform(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), kind)


def template_tree(pages: DataFrame) -> DataFrame:
    """pages (host, segs, n, bad, good) -> host, segs, purity: the smoothed purity of the branch that
    each kind template ends in."""
    t = cut(
        pages.groupBy("host", "segs").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumn("depth", F.size("segs"))
    )
    # downwards: literal or wildcard, by the parent's count
    def down(node: DataFrame, level: int) -> DataFrame:
        there = node.withColumn("seg", F.get("segs", F.lit(level)))
        parent = there.where("seg is not null").groupBy("host", "node").agg(F.sum("n").alias("pn"))
        child = there.where("seg is not null").groupBy("host", "node", "seg").agg(F.sum("n").alias("cn"))
        literal = child.join(parent, ["host", "node"]).where(F.col("cn") >= LITERAL_SHARE * F.col("pn")).select("host", "node", "seg", F.lit(True).alias("lit"))
        there = there.join(literal, ["host", "node", "seg"], "left")
        step = F.when(F.col("seg").isNull(), F.col("node")).otherwise(F.concat("node", F.array(F.when(F.col("lit"), F.col("seg")).otherwise(F.lit("*")))))
        return there.withColumn("node", step).drop("seg", "lit")

    deepest = t.agg(F.max("depth")).first()[0] or 0
    top = min(LEVELS, deepest)  # levels that are not put on in one step
    node = t.withColumn("node", F.array().cast("array<string>"))
    for level in range(top):
        node = down(node, level)
    node = cut(node)
    ended = []
    while deepest > top:
        # a path alone under its node has no siblings any more
        at = node.where(F.col("depth") > top)
        ended.append(node.where(F.col("depth") <= top).withColumn("fork", F.lit(top)))
        at = cut(at.join(at.groupBy("host", "node").agg(F.count(F.lit(1)).alias("rows")), ["host", "node"]))
        rest = F.slice("segs", F.lit(top + 1), F.size("segs"))
        ended.append(at.where("rows = 1").drop("rows").withColumns({"node": F.concat("node", rest), "fork": F.lit(top)}))
        at = at.where("rows > 1").drop("rows")
        if at.isEmpty():
            break
        node = cut(down(at, top))
        top += 1
    else:
        ended.append(node.withColumn("fork", F.lit(top)))
    node = ended[0]
    for e in ended[1:]:
        node = node.unionByName(e)
    node = cut(node)
    # upwards: siblings that do not differ become one branch
    leaf = node.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("bad", "good")], F.max("fork").alias("fork"))
    tail = F.array_repeat(F.lit("~"), F.greatest(F.lit(0), F.size("node") - F.col("fork")))
    branch = leaf.withColumn("branch", F.concat(F.slice("node", F.lit(1), F.col("fork")), tail)).drop("fork")
    for level in range(top, 0, -1):
        if level % LEVELS == 0 and level < top:
            branch = cut(branch)
        parent = F.slice("branch", 1, level - 1)
        sums = branch.where(F.size("branch") >= level).withColumns({"parent": parent, "seg": F.get("branch", F.lit(level - 1))})
        child = sums.groupBy("host", "parent", "seg").agg(F.sum("bad").alias("cb"), F.sum(F.col("bad") + F.col("good")).alias("cn"))
        whole = child.groupBy("host", "parent").agg(F.sum("cb").alias("pb"), F.sum("cn").alias("pn"))
        c = child.join(whole, ["host", "parent"])
        rest_n, rest_b = F.col("pn") - F.col("cn"), F.col("pb") - F.col("cb")
        pooled = F.col("pb") / F.col("pn")
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("cn") + 1 / rest_n))
        differs = (F.col("cn") > 0) & (rest_n > 0) & (spread > 0) & (F.abs(F.try_divide("cb", "cn") - F.try_divide(rest_b, rest_n)) > Z_MERGE * spread)
        apart = c.where(differs).select("host", "parent", "seg", F.lit(True).alias("own"))
        joined = branch.withColumns({"parent": parent, "seg": F.get("branch", F.lit(level - 1))}).join(apart, ["host", "parent", "seg"], "left")
        merged = F.concat("parent", F.array(F.when(F.col("own"), F.col("seg")).otherwise(F.lit("~"))), F.slice("branch", F.lit(level + 1), F.size("branch")))
        branch = joined.withColumn("branch", F.when(F.col("seg").isNull(), F.col("branch")).otherwise(merged)).drop("parent", "seg", "own")
    branch = cut(branch)
    # purity, smoothed from the global share down to the branch
    total = branch.agg(F.sum("good"), F.sum("bad")).first()
    good, bad = total[0] or 0, total[1] or 0
    share = (good + 1) / (good + bad + 2) if good + bad else 1.0
    host = branch.groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    state = host.select("host", F.array().cast("array<string>").alias("up"), ((F.col("g") + PRIOR * share) / (F.col("g") + F.col("b") + PRIOR)).alias("purity"))
    out = None
    for level in range(1, top + 1):
        if level % LEVELS == 0 and level < top:
            state = cut(state)
        deep = branch.where(F.size("branch") >= level).groupBy("host", F.slice("branch", 1, level - 1).alias("up"), F.slice("branch", 1, level).alias("here"))
        deep = deep.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).join(state, ["host", "up"])
        out = state if out is None else out.unionByName(state)
        state = deep.select("host", F.col("here").alias("up"), ((F.col("g") + PRIOR * F.col("purity")) / (F.col("g") + F.col("b") + PRIOR)).alias("purity"))
    out = state if out is None else out.unionByName(state)
    # below the top all is "~": the purities of a chain of one node each, from its counts by depth
    ends = branch.where(F.size("branch") > top).groupBy("host", F.slice("branch", 1, top).alias("up"), F.size("branch").alias("depth")).agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    chain = ends.groupBy("host", "up").agg(F.collect_list(F.struct("depth", "g", "b")).alias("ends")).join(state, ["host", "up"])
    chain = chain.select("host", "up", "ends", "purity", F.explode("ends.depth").alias("depth"))

    def smoothed(purity: Column, level: Column) -> Column:
        deep = F.filter("ends", lambda e: e.depth >= level)
        good = F.aggregate(deep, F.lit(0).cast("long"), lambda a, e: a + e.g)
        bad = F.aggregate(deep, F.lit(0).cast("long"), lambda a, e: a + e.b)
        return (good + PRIOR * purity) / (good + bad + PRIOR)

    purity = F.aggregate(F.sequence(F.lit(top + 1), F.col("depth")), F.col("purity"), smoothed)
    out = out.unionByName(chain.select("host", F.concat("up", F.array_repeat(F.lit("~"), F.col("depth") - top)).alias("up"), purity.alias("purity")))
    judged = branch.select("host", "node", F.col("branch").alias("up")).join(out, ["host", "up"]).select("host", "node", "up", "purity")
    return cut(node.select("host", "segs", "node").join(judged, ["host", "node"]).select("host", "segs", F.col("up").alias("branch"), "purity"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, branch, purity."""
    host, path = parse(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), kinds(F.col("path")).alias("segs"))
    counts = cut(
        p.groupBy("host", "segs").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("given") == "block").alias("bad"), F.count_if(F.col("given") == "allow").alias("good")
        )
    )
    tree = template_tree(counts)
    # the pages of a template with at least 1/HEAVY_SHARE of all pages meet a broadcast row
    rows = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HEAVY_SHARE >= rows).select("host", "segs")
    key = ["host", "segs"]
    hot_tree = tree.join(hot, key, "left_semi")
    judged = p.join(F.broadcast(hot_tree), key, "left")
    cold = judged.where("purity is null").drop("purity", "branch").join(tree.join(hot, key, "left_anti"), key)
    judged = judged.where("purity is not null").unionByName(cold)
    own = F.when(F.col("purity") >= MIN_PURITY, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), F.concat(F.lit("/"), F.array_join("branch", "/")).alias("branch"), "purity"
    )


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    from prepline.llm.common import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
