"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepline.session import cut_lineage

#: Words, as everywhere in this subpackage: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A key is heavy if it has at least 1/HEAVY_SHARE of all rows, so there are at most
#: HEAVY_SHARE heavy keys, whatever the input; only those are ever broadcast.
HEAVY_SHARE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session (never a local one)."""
    return cut_lineage(df)


#: rows of narrow tables (edges, labels) that one task takes
NARROW_ROWS = 50_000


def cut_narrow(df: DataFrame) -> DataFrame:
    """``cut`` for tables of few narrow columns, in as many partitions as their rows ask for: an
    iterative operator shuffles them again and again, and every task of a shuffle leaves files."""
    out = cut(df)
    return out.coalesce(max(1, ceil_div(out.count(), NARROW_ROWS)))


#: rows of whole texts that go to a Python worker at a time, at most
TEXT_ROWS = 1_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside send at most ``TEXT_ROWS`` rows to Python at a time: a batch of whole texts lies
    in the executor as rows, as Arrow and as bytes to send, and in the worker as Arrow and as Python text.
    Only for work that is done when the block ends (``cut``)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(TEXT_ROWS, int(before)) if int(before) > 0 else TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, other letters untouched."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """left join right on ``key`` where right has one narrow row per key and left may have a
    third of its rows under one key.

    ``heavy`` holds the keys with at least 1/HEAVY_SHARE of left's rows (at most HEAVY_SHARE
    rows, so it may be broadcast). Rows under heavy keys meet right's heavy rows through that
    broadcast; all others meet in a shuffle that has no hot key left. ``key`` is not null.
    """
    hot = F.broadcast(heavy.select(key).distinct())
    right_hot = F.broadcast(right.join(hot, key, "left_semi"))
    return (
        left.join(hot, key, "left_semi")
        .join(right_hot, key, how)
        .unionByName(left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key, how))
    )


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Connected components of an undirected edge list (src, dst): rows (node, component),
    component being the smallest node reachable. Nodes without an edge do not appear.

    Alternating large-star and small-star steps: every step keeps the components and at most
    the number of edges, and the rounds grow with the logarithm of the longest path. Each
    round is checkpointed; only a count comes to the driver.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def star(e: DataFrame, large: bool, tasks: int) -> DataFrame:
        # the minimum of a node's neighbourhood by a partial aggregate, then every
        # neighbour (larger ones: large star; smaller ones and itself: small star) linked to it
        b = both(e) if large else e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = b.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        j = b.join(low, "src")
        if large:
            out = j.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        else:
            out = j.select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(
                low.select("src", F.col("low").alias("dst"))
            )
        return out.where("src <> dst").coalesce(tasks).distinct().coalesce(tasks)

    e = cut_narrow(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = None
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        tasks = max(1, ceil_div(e.count(), NARROW_ROWS))
        e = cut(star(star(e, True, tasks), False, tasks))
        rounds += 1
        # stable when a round leaves the edges as they were: then every node points at one root
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.sum(F.hash("src", "dst").cast("long"))).first()
        if before == now:
            break
        before = now
    roots = e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
