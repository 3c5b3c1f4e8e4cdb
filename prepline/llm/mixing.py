"""Operator 4, mixing sources to target weights: weighted fair queueing, native.

Every source is a queue served at the rate of its target. The documents of a source stand in
shuffled order (a hash of the id), up to ``max_epochs`` times one after the other; a
document's virtual finish time is the source's cumulative words up to and including it,
divided by the source's target. All queues together are range-sorted by virtual finish time
and the order is truncated where its words reach the total budget: documents whose service
has not begun by then are left out, the one in service at a source's target is cut there.
Any prefix of the order therefore has the sources in proportion to their targets.

Targets: weights share the budget; no target exceeds ``max_epochs`` times its source's size,
and the excess is reshared by weight until none is above (water filling, in closed form over
the sources sorted by the ratio of limit and weight).

No queue is held by one task: a source is dealt into buckets of equal hash width, the global
order into buckets of equal virtual time, and running sums go through the bucket totals.

Defined results: a null text has size 0; documents of size 0 take no part (taken 0) but keep
their row; null sources form one source, last in order; sources without words have target 0;
repeated rows are separate documents; an empty table gives no rows; other columns are kept
out of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepline.llm.common import WORD, ceil_div, cut

ROWS_PER_BUCKET = 20_000
#: bound of the bucket tables, which are windowed as a whole: rows per source and in total
MAX_BUCKETS = 16_384


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of the id's md5: a shuffle that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def default_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, by the source's place in code point order."""
    return ((rank - 1) % 3 + 1).cast("long")


def targets(sources: DataFrame, weight, max_epochs: int, budget: int | None = None) -> DataFrame:
    """sources (source, source_size) -> and weight, target. One row per source throughout."""
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sources.withColumn("weight", weight(F.row_number().over(by_code))).withColumn(
        "room", F.col("source_size") * F.lit(max_epochs)
    )
    every = Window.partitionBy()
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.lit(budget).cast("long") if budget is not None else F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("room").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest).cast("double")
    lev = w.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("room"))
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return lev.withColumn("final", final).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("full") | F.col("final").isNull(), F.col("room").cast("double"))
        .otherwise(F.least(F.col("final") * F.col("weight"), F.col("room").cast("double")))
        .alias("target"),
    )


def mix(docs: DataFrame, weight=default_weight, max_epochs: int = 3, budget: int | None = None) -> DataFrame:
    """docs (doc_id, source, size) -> the served pieces: rows (source, bucket, rn, doc_id, size,
    source_size, target, epoch, take, finish, mix_start). ``take`` words of the document are
    served in that epoch, from place ``mix_start`` of the mix; (source, bucket, rn) identifies
    a document's row. Every document has a row for epoch 0, with take 0 if it is left out."""
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), "size", shuffle_key(F.col("doc_id")).alias("h"))
    per_source = cut(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    head = per_source.agg(F.max("n"), F.sum("n"), F.count(F.lit(1)), F.sum("source_size")).first()
    most, rows, n_sources = head[0] or 0, head[1] or 0, head[2] or 1
    k = max(1, min(MAX_BUCKETS, ceil_div(most, ROWS_PER_BUCKET)))
    width = (1 << 60) // k + 1
    base = base.withColumn("bucket", F.floor(F.col("h") / F.lit(width)).cast("int"))

    goal = targets(per_source.select("source", "source_size"), weight, max_epochs, budget).withColumn(
        "quota", F.ceil("target").cast("long")
    )
    totals = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    starts = starts.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target", "quota"
    )
    place = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    queued = (
        base.withColumn("rn", F.row_number().over(place))
        .withColumn("upto", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("c0", F.col("before") + F.col("upto") - F.col("size"))
    )

    def served(e: Column) -> Column:
        start = F.col("c0") + e * F.col("source_size")
        take = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - start)).cast("long")
        done = F.when(take > 0, (start + take).cast("double") / F.col("target"))
        return F.struct(e.cast("int").alias("epoch"), take.alias("take"), done.alias("finish"))

    epochs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), served), lambda x: (x.take > 0) | (x.epoch == 0))
    items = queued.select(
        "source", "bucket", "rn", "doc_id", "size", "source_size", "target", F.inline(epochs)
    )
    # the global order: equal steps of virtual time hold equal numbers of words
    kv = max(1, min(MAX_BUCKETS, ceil_div(rows, ROWS_PER_BUCKET)))
    items = cut(items.withColumn("step", F.coalesce(F.least(F.floor(F.col("finish") * kv), F.lit(kv)), F.lit(kv + 1)).cast("int")))
    total = budget if budget is not None else head[3] or 0
    steps = items.where("take > 0").groupBy("step").agg(F.sum("take").alias("w"))
    steps = steps.select(
        F.col("step").alias("st"),
        F.coalesce(F.sum("w").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
    )
    in_step = Window.partitionBy("step").orderBy("finish", F.col("source").isNull(), "source", "epoch", "bucket", "rn")
    run = (
        items.where("take > 0")
        .withColumn("to", F.sum("take").over(in_step.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(steps), F.col("step") == F.col("st"))  # at most MAX_BUCKETS + 1 rows
        .withColumn("mix_start", F.col("ahead") + F.col("to") - F.col("take"))
        .withColumn("take", F.greatest(F.lit(0), F.least(F.col("take"), F.lit(total) - F.col("mix_start"))))
    )
    cols = ["source", "bucket", "rn", "doc_id", "size", "source_size", "target", "epoch", "take", "finish", "mix_start"]
    out = items.where("take = 0").withColumn("mix_start", F.lit(None).cast("long"))
    return run.select(*cols).unionByName(out.select(*cols))


def taken(mixed: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source."""
    g = mixed.groupBy("source", "bucket", "rn", "doc_id", "size", "source_size", "target").agg(F.sum("take").alias("taken"))
    return g.select("doc_id", "size", "source_size", "target", "taken", "source")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    from prepline.llm.common import table

    return taken(mix(cut(sized(table(spark, sf_dir, "documents")))))


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, source_size * 3 AS room FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY room::DOUBLE / weight, weight, source IS NULL, source)),
f AS (SELECT max(level) AS final FROM l WHERE level * weight < room),
g AS (
  SELECT source, source_size, CASE WHEN level * weight >= room OR final IS NULL THEN room::DOUBLE
    ELSE least(final * weight, room::DOUBLE) END AS target FROM l, f),
q AS (
  SELECT d.*, g.source_size, g.target,
    (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS c0,
    row_number() OVER (PARTITION BY d.source ORDER BY h, doc_id, size) AS rn
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
i AS (
  SELECT q.*, e, c0 + e * source_size AS st, greatest(0, least(size, ceil(target)::BIGINT - (c0 + e * source_size))) AS take
  FROM q, (VALUES (0), (1), (2)) AS x(e)),
r AS (
  SELECT *, (sum(take) OVER (ORDER BY (st + take)::DOUBLE / target, source IS NULL, source, e, rn ROWS UNBOUNDED PRECEDING))::BIGINT - take AS begun
  FROM i WHERE take > 0),
k AS (
  SELECT source, rn, sum(greatest(0, least(take, (SELECT sum(source_size) FROM s) - begun)))::BIGINT AS t FROM r GROUP BY ALL)
SELECT doc_id, size, source_size, target, coalesce(t, 0)::BIGINT AS taken, q.source
FROM q LEFT JOIN k ON q.source IS NOT DISTINCT FROM k.source AND q.rn = k.rn
"""
