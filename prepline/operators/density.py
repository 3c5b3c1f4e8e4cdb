"""DBSCAN (T9), exact, for low-dimensional points (d <= 4), as DataFrame jobs.

Plan:
  1. duplicate points collapse into one weighted row (a hot point is one row);
  2. points fall into grid cells of side eps / sqrt(d): any two points of one cell are within
     eps, so a cell holding >= min_samples points makes all of them core with no pair test,
     and all core points of one cell belong to one cluster;
  3. what is left to test is a point of a *sparse* cell (fewer than min_samples points) against
     a cell around it, and two neighbouring cells of core points against each other. Both go
     down the cells' trees of sub-boxes (halved in every dimension, until a box has at most
     LEAF points): two boxes are accepted as a whole if even their farthest corners are within
     eps, rejected if their nearest ones are not, and only the rest is split further. So two
     dense cells meet in a few boxes, never in all pairs of their points;
  4. clusters = connected components of the cell graph by iterative min-label propagation,
     with a reliable checkpoint every round; cluster id = smallest key of a core point;
  5. a border point joins the cluster of the lowest-key core point within eps; noise = -1.
Core means >= min_samples points within eps including the point itself. Box distances use the
points' own extremes and the same arithmetic as point distances, so results are exact. A vector
that is NULL or has a NULL or NaN component is noise and near nothing.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepline.session import cut_lineage, cut_round


def _offsets(d: int) -> list[list[int]]:
    r = math.ceil(math.sqrt(d))
    out = []
    for o in itertools.product(range(-r, r + 1), repeat=d):
        gap = sum(max(abs(v) - 1, 0) ** 2 for v in o)  # min distance^2 between cells, in cell units
        if gap <= d:  # (cell side)^2 * gap <= eps^2  <=>  gap <= d
            out.append(list(o))
    return out


def _dist2(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


LEAF = 32
#: sub-boxes are halved at most so often; beyond, points are closer than 2 ** -45 of a cell
MAX_LEVEL = 45
SALTS = 8


def _bounds(d: int, lo: str, hi: str):
    """Aggregates of the tight box around arrays of ``d`` numbers."""
    return F.array(*[F.min(F.get(lo, F.lit(i))) for i in range(d)]), F.array(*[F.max(F.get(hi, F.lit(i))) for i in range(d)])


def _sum2(parts):
    return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v * v)


def _gap2(alo, ahi, blo, bhi):
    """Squared distance between the nearest points of two boxes."""
    return _sum2(F.zip_with(F.zip_with(blo, ahi, lambda x, y: x - y), F.zip_with(alo, bhi, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))))


def _reach2(alo, ahi, blo, bhi):
    """Squared distance between the farthest points of two boxes."""
    return _sum2(F.zip_with(F.zip_with(bhi, alo, lambda x, y: x - y), F.zip_with(ahi, blo, lambda x, y: x - y), lambda x, y: F.greatest(x, y)))


def _sorted(df: DataFrame) -> DataFrame:
    """``df`` for a sort-merge join. The planner counts an exploded row once and a list as one element, so
    from small files it would broadcast the 21 cells around every point, or lists of points, from the driver."""
    return df.hint("merge")


def _tree(points: DataFrame, d: int, side: float) -> tuple[DataFrame, int]:
    """(cell, level, q, parent, n, w, lo, hi, pid, pts) of every sub-box of points (cell, x, w, pid), and the
    deepest level. Leaves hold their points, at most LEAF; inner boxes are put together from their
    halves, at most 2 ** d, so no group grows with the data."""
    rest, leaves, level = points, [], 0
    while True:
        rest = rest.withColumn("q", F.transform("x", lambda v: F.floor(v / side * F.lit(float(2**level)))))
        rest = rest.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)))
        heavy = rest.groupBy("cell", "q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (LEAF if level < MAX_LEVEL else 2**62))
        heavy = cut_lineage(heavy.select("cell", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")))
        light = rest.join(_sorted(heavy), ["cell", "q", "salt"], "left_anti").withColumn("y", F.col("x"))
        lo, hi = _bounds(d, "x", "x")
        leaves.append(
            light.groupBy("cell", "q").agg(
                F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), lo.alias("lo"), hi.alias("hi"), F.min("pid").alias("pid"),
                F.collect_list(F.struct("pid", "y", "w")).alias("pts"),
            )
        )
        if heavy.limit(1).count() == 0:
            break
        rest = cut_lineage(rest.join(_sorted(heavy), ["cell", "q", "salt"], "left_semi").select("cell", "x", "w", "pid"))
        level += 1
    half = F.transform("q", lambda v: F.shiftright(v, 1))
    nodes = leaves[level]
    levels = [nodes.withColumn("level", F.lit(level)).withColumn("parent", half if level else F.col("q"))]
    for k in range(level - 1, -1, -1):
        lo, hi = _bounds(d, "lo", "hi")
        up = nodes.groupBy("cell", half.alias("q")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), lo.alias("lo"), hi.alias("hi"), F.min("pid").alias("pid"))
        nodes = cut_lineage(up.withColumn("pts", F.lit(None).cast(leaves[k].schema["pts"].dataType)).unionByName(leaves[k]))
        levels.append(nodes.withColumn("level", F.lit(k)).withColumn("parent", half if k else F.col("q")))
    tree = levels[0]
    for x in levels[1:]:
        tree = tree.unionByName(x)
    return cut_lineage(tree), level


def _within(probes: DataFrame, tree: DataFrame, depth: int, eps2: float) -> DataFrame:
    """probes (x, cell) -> (x, cell, w, pid): the points of that cell within eps of x, boxes that lie
    within as a whole as one row of their weight and smallest pid."""
    items, out = probes.select("x", "cell", F.lit(0).alias("level"), F.col("cell").alias("parent")), None
    for _ in range(depth + 1):
        j = items.join(_sorted(tree), ["cell", "level", "parent"])
        far, near = _reach2(F.col("x"), F.col("x"), F.col("lo"), F.col("hi")), _gap2(F.col("x"), F.col("x"), F.col("lo"), F.col("hi"))
        part = j.where((far > eps2) & (near <= eps2))
        hits = F.filter("pts", lambda p: _dist2(F.col("x"), p["y"]) <= eps2)
        found = j.where(far <= eps2).select("x", "cell", "w", "pid").unionByName(
            part.where(F.col("pts").isNotNull()).select("x", "cell", F.explode(hits).alias("p")).select("x", "cell", "p.w", "p.pid")
        )
        out = found if out is None else out.unionByName(found)
        items = part.where(F.col("pts").isNull()).select("x", "cell", (F.col("level") + 1).alias("level"), F.col("q").alias("parent"))
    return out


def _touching(pairs: DataFrame, tree: DataFrame, eps2: float) -> DataFrame:
    """pairs (cell, ncell) -> those with a point of one within eps of a point of the other."""
    node = F.struct("level", "q", "n", "lo", "hi", "pts")
    of = {s: tree.select(F.col("cell").alias(c), F.col("level").alias("l"), F.col("parent").alias("p"), node.alias(s)) for s, c in (("a", "cell"), ("b", "ncell"))}
    first = {s: t.where("l = 0").drop("l", "p") for s, t in of.items()}
    live = cut_lineage(pairs.join(_sorted(first["a"]), "cell").join(_sorted(first["b"]), "ncell"))
    edges = None
    while True:
        box = [F.col(f"{s}.{e}") for s in ("a", "b") for e in ("lo", "hi")]
        both = F.col("a.pts").isNotNull() & F.col("b.pts").isNotNull()
        near = F.exists("a.pts", lambda p: F.exists("b.pts", lambda r: _dist2(p["y"], r["y"]) <= eps2))
        yes = (_reach2(*box) <= eps2) | (both & F.coalesce(near, F.lit(False)))
        judged = cut_lineage(live.where(_gap2(*box) <= eps2).withColumn("yes", yes).withColumn("both", both))
        found = judged.where("yes").select("cell", "ncell").distinct()
        edges = found if edges is None else edges.unionByName(found)
        live = judged.where("not yes and not both").join(_sorted(found), ["cell", "ncell"], "left_anti").drop("yes", "both")
        # the box with more points is split, a leaf never
        left = F.col("a.pts").isNull() & (F.col("b.pts").isNotNull() | (F.col("a.n") >= F.col("b.n")))
        halves = None
        for s, other, c, side in (("a", "b", "cell", live.where(left)), ("b", "a", "ncell", live.where(~left))):
            step = side.select("cell", "ncell", other, (F.col(f"{s}.level") + 1).alias("l"), F.col(f"{s}.q").alias("p")).join(_sorted(of[s]), [c, "l", "p"])
            step = step.select("cell", "ncell", "a", "b")
            halves = step if halves is None else halves.unionByName(step)
        live = cut_lineage(halves)
        if live.limit(1).count() == 0:
            return edges


def dbscan(df: DataFrame, key: str, vector_col: str, eps: float, min_samples: int) -> DataFrame:
    """Return (key, cluster, is_core); cluster -1 is noise."""
    first = df.where(F.col(vector_col).isNotNull()).select(F.size(vector_col).alias("d")).first()
    if first is None:
        return df.select(key, F.lit(-1).cast("long").alias("cluster"), F.lit(False).alias("is_core"))
    d = int(first["d"])
    if d > 4:
        raise ValueError("grid DBSCAN is exact and bounded only for d <= 4; reduce dimensions first (e.g. PCA)")
    side = eps / math.sqrt(d)
    eps2 = eps * eps
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    pts = df.select(F.col(key).alias("k"), F.when(sound, F.transform(x, lambda v: v + 0.0)).alias("x"))  # no -0.0
    # 1. distinct points with weights; pid = smallest key holding the point
    dist = pts.where(F.col("x").isNotNull()).groupBy("x").agg(F.min("k").alias("pid"), F.count(F.lit(1)).alias("w"))
    dist = dist.withColumn("cell", F.transform("x", lambda v: F.floor(v / side)))
    dist = cut_lineage(dist)
    cells = dist.groupBy("cell").agg(F.sum("w").alias("cw"), F.count(F.lit(1)).alias("cn"))
    offs = F.array(*[F.array(*[F.lit(v) for v in o]) for o in _offsets(d)])

    def around(df_, cell_col="cell"):
        return df_.select("*", F.explode(offs).alias("__o")).withColumn(
            "ncell", F.zip_with(F.col(cell_col), F.col("__o"), lambda a, b: a + b)
        ).drop("__o")

    # 2-3. neighbour weight of points in sparse cells (dense cells: all core)
    tree, depth = _tree(dist.select("cell", "x", "w", "pid"), d, side)
    sparse_pts = dist.join(_sorted(cells.where(F.col("cw") < min_samples).select("cell")), "cell")
    near = _within(around(sparse_pts.select("x", "cell")).select("x", F.col("ncell").alias("cell")), tree, depth, eps2)
    nw = near.groupBy("x").agg(F.sum("w").alias("nw"))  # points are identified by their coordinates
    core_flag = (
        dist.join(_sorted(cells.select("cell", "cw")), "cell")
        .join(_sorted(nw), "x", "left")
        .withColumn("is_core", (F.col("cw") >= min_samples) | (F.coalesce(F.col("nw"), F.lit(0)) >= min_samples))
    )
    core_flag = cut_lineage(core_flag)
    core = core_flag.where("is_core")
    # 4. cell graph over cells with core points
    node = core.groupBy("cell").agg(F.min("pid").alias("label"), F.count(F.lit(1)).alias("ncore"))
    nb = around(node.select("cell")).join(_sorted(node.select(F.col("cell").alias("ncell"))), "ncell").where(F.col("cell") != F.col("ncell"))
    tree, depth = _tree(core.select("cell", "x", "w", "pid"), d, side)
    one_way = cut_lineage(_touching(nb.where(F.col("cell") < F.col("ncell")).select("cell", "ncell"), tree, eps2))
    edges = cut_round(one_way.unionByName(one_way.select(F.col("ncell").alias("cell"), F.col("cell").alias("ncell"))))
    # every round takes the smallest label around, then the label that the cell of that label has
    # by now (pointer jumping); it ends when nothing changes
    labels = cut_round(node.select("cell", "label"))
    own = labels.select("cell", F.col("label").alias("own"))
    while True:
        incoming = edges.join(_sorted(labels.select(F.col("cell").alias("ncell"), F.col("label").alias("nl"))), "ncell").groupBy("cell").agg(
            F.min("nl").alias("nl")
        )
        new = labels.join(_sorted(incoming), "cell", "left").select("cell", F.least("label", F.coalesce("nl", "label")).alias("label"), F.col("label").alias("old"))
        new = cut_lineage(new)
        jump = new.join(_sorted(own), "cell").select(F.col("own").alias("label"), F.col("label").alias("further"))
        new = cut_round(new.join(_sorted(jump), "label").select("cell", F.least("label", "further").alias("label"), "old"))
        changed = new.where(F.col("label") != F.col("old")).limit(1).count()
        labels = new.drop("old")
        if changed == 0:
            break
    # cluster id = smallest core key in the component (labels carry min core pid)
    core_cluster = core.join(_sorted(labels), "cell").select("pid", "x", "cell", F.col("label").alias("cluster"))
    # 5. border points: lowest-key core point within eps
    border = core_flag.where(~F.col("is_core")).select("x", "cell")
    bc = _within(around(border).select("x", F.col("ncell").alias("cell")), tree, depth, eps2).join(_sorted(labels), "cell")
    bc = bc.groupBy("x").agg(F.min_by("label", "pid").alias("bcl"))
    per_point = (
        core_flag.select("x", "is_core")
        .join(_sorted(core_cluster.select("x", F.col("cluster").alias("cc"))), "x", "left")
        .join(_sorted(bc), "x", "left")
        .select("x", "is_core", F.coalesce("cc", "bcl", F.lit(-1)).cast("long").alias("cluster"))
    )
    found = pts.join(_sorted(per_point), "x", "left")
    return found.select(F.col("k").alias(key), F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
