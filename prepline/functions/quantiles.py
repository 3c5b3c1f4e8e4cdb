"""Exact quantiles and bounded top-k without ever holding a whole group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer, so
a per-column median over a 100 TB table would put a whole column into one task. Here ranks are
selected by running sums over a global order instead:

1. The caller supplies a *weighted* table ``(keys..., value, weight)`` (distinct values with
   multiplicities, built with a map-side-combined ``groupBy``), so a hot value costs one row.
2. :func:`ranged_values` range-partitions it by (keys, value): a key with most of the values is
   dealt over many partitions, and is written once to the checkpoint folder.
3. Each partition's weight per key (one row per partition and key) gives, by prefix sums, the
   ranks that every partition holds, and so the one partition where a wanted rank lies.
4. Only there, values are sorted within (partition, key), and a running sum finds the rank.

No value is shuffled by its key alone: exchanges on the keys carry the sums of step 3. Keys may be
NULL; a NULL key is a key of its own. Interpolation follows ``quantile_cont`` / pandas ``linear``:
h = (n-1)p, q = x[floor h] + (h - floor h)(x[ceil h] - x[floor h]).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepline.session import cut_lineage

def weighted_values(long_df: DataFrame, keys: Sequence[str], value: str, out: str = "v") -> DataFrame:
    """(keys, v, w): distinct non-null values with their multiplicity (partial agg map-side)."""
    return (
        long_df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias(out))
        .agg(F.count(F.lit(1)).alias("w"))
    )


def ranged_values(weighted: DataFrame, keys: Sequence[str], value: str = "v", weight: str = "w") -> DataFrame:
    """(keys, v, w) range-partitioned by (keys, v), with its partition id ``_pid``; checkpointed, so
    that every later use and a lost executor see the same partitions."""
    rows = weighted.select(*keys, F.col(value).cast("double").alias("v"), F.col(weight).cast("long").alias("w"))
    return cut_lineage(rows.repartitionByRange(*keys, "v").withColumn("_pid", F.spark_partition_id()))


def _located(ranged: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """(targets, located): each key's wanted ranks, and the values (_k, r, x) at those ranks."""
    rows = ranged.select(F.struct(*keys).alias("_k"), "v", "w", "_pid")  # structs compare NULL keys as equal
    part = rows.groupBy("_pid", "_k").agg(F.sum("w").alias("t"))
    # one row per partition, so this window is as small as the list of partitions
    offsets = part.groupBy("_pid").agg(F.sum("t").alias("_n"))
    offsets = offsets.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    in_part = F.sum("t").over(Window.partitionBy("_pid").orderBy("_k")) - F.col("t")
    part = part.withColumn("start", in_part).join(offsets, "_pid").withColumn("start", F.col("start") + F.col("_off")).drop("_off")
    stats = part.groupBy("_k").agg(F.sum("t").alias("n"), F.min("start").alias("first"))
    targets = (
        stats.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("h", (F.col("n") - 1) * F.col("p"))
        .withColumn("r0", F.floor("h").cast("long"))
        .withColumn("r1", F.ceil("h").cast("long"))
        .withColumn("frac", F.col("h") - F.col("r0"))
    )
    wanted = targets.select("_k", "first", F.explode(F.array("r0", "r1")).alias("r")).withColumn("at", F.col("first") + F.col("r"))
    wanted = part.join(wanted, "_k").where("at >= start and at < start + t")
    wanted = wanted.groupBy("_pid", "_k").agg(F.collect_set(F.struct((F.col("at") - F.col("start")).alias("at"), "r")).alias("wanted"))
    before = F.sum("w").over(Window.partitionBy("_pid", "_k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    hit = rows.join(wanted, ["_pid", "_k"]).withColumn("before", before)
    inside = F.filter("wanted", lambda e: (e["at"] >= F.col("before")) & (e["at"] < F.col("before") + F.col("w")))
    return targets, hit.select("_k", "v", F.explode(inside).alias("e")).select("_k", F.col("e.r").alias("r"), F.col("v").alias("x"))


def exact_quantiles(weighted: DataFrame, keys: Sequence[str], probs: Sequence[float], value: str = "v", weight: str = "w", ranged: DataFrame | None = None) -> DataFrame:
    """Return (keys..., p double, q double): exact continuous quantiles per key.

    Rows may repeat a value. ``ranged`` is a table of :func:`ranged_values` that the caller has
    already. Eager: the result (keys x probs rows) is checkpointed."""
    keys = list(keys)
    if ranged is None:
        ranged = ranged_values(weighted, keys, value, weight)
    targets, located = _located(ranged, keys, probs)
    x0 = located.withColumnRenamed("r", "r0").withColumnRenamed("x", "x0")
    x1 = located.withColumnRenamed("r", "r1").withColumnRenamed("x", "x1")
    out = targets.join(x0, ["_k", "r0"], "left").join(x1, ["_k", "r1"], "left")
    return cut_lineage(out.select("_k.*", "p", (F.col("x0") + F.col("frac") * (F.col("x1") - F.col("x0"))).alias("q")))


def quantiles_wide(q: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Pivot (keys, p, q) to one column per probability (no shuffle beyond the small agg)."""
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(n) for p, n in zip(probs, names, strict=True)]
    return q.groupBy(*keys).agg(*aggs)


def smallest_k(
    df: DataFrame, key: str, order_cols: Sequence[str], k: int, keep: Sequence[str] = (), distinct: bool = False
) -> DataFrame:
    """The k smallest rows per key, by ``order_cols`` ascending (nulls last), plus ``_rk``.

    Each task streams its Arrow batches and keeps only its own k smallest per key
    (mapInArrow; nullable integers stay exact), so the final sort per key sees at most
    k x (number of partitions) rows, however large a group is. Memory per task is one batch
    plus k rows per key.
    """
    import pyarrow as pa

    order_cols = list(order_cols)
    cols = [key, *order_cols, *[c for c in keep if c not in order_cols and c != key]]
    slim = df.select(*cols)
    schema = slim.schema
    sort_by = [key, *order_cols]

    def to_pd(batch):
        return batch.to_pandas(types_mapper=lambda t: pd.Int64Dtype() if pa.types.is_integer(t) else None)

    def trim(pdf: pd.DataFrame) -> pd.DataFrame:
        if distinct:
            pdf = pdf.drop_duplicates(subset=cols)
        pdf = pdf.sort_values(sort_by, na_position="last", kind="mergesort")
        return pdf.groupby(key, sort=False, dropna=False).head(k)

    def per_task(batches):
        kept = None
        arrow_schema = None
        for b in batches:
            arrow_schema = b.schema
            if not b.num_rows:
                continue
            pdf = to_pd(b)
            kept = trim(pdf if kept is None else pd.concat([kept, pdf], ignore_index=True))
        if kept is not None and len(kept):
            yield pa.RecordBatch.from_pandas(kept, schema=arrow_schema, preserve_index=False)

    partial = slim.mapInArrow(per_task, schema)
    if distinct:
        partial = partial.dropDuplicates(cols)
    win = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order_cols])
    return partial.withColumn("_rk", F.row_number().over(win)).where(F.col("_rk") <= k)


def collect_sorted(df: DataFrame, key: str, rank: str, value: str, out: str, sep: str = "|") -> DataFrame:
    """Join a bounded (<= k per key) ranked table into one ``sep``-separated string per key."""
    return df.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(value)))), lambda s: s[value]),
            sep,
        ).alias(out)
    )


__all__ = ["weighted_values", "ranged_values", "exact_quantiles", "quantiles_wide", "smallest_k", "collect_sorted"]
