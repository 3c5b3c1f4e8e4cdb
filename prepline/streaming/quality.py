"""Streaming quality monitoring (Y1) and drift (Y2).

Y1 runs as Structured Streaming: parquet file source -> watermark -> tumbling-window
aggregates in update mode -> foreachBatch appends each micro-batch's updated windows to a
Parquet folder (idempotent per batch id: a replayed batch overwrites its own folder). The
final value of a window is its row from the latest batch that touched it.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepline.functions.exprs import attach_one_row


def window_quality_agg(events: DataFrame, ts: str, value: str, window: str) -> DataFrame:
    """Per tumbling window: rows, missing values, mean / min / max of the value column."""
    v = F.col(value).cast("double")
    miss = F.col(value).isNull() | F.isnan(F.col(value))
    clean = F.when(~miss, v)
    return events.groupBy(F.window(F.col(ts), window).alias("w")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(miss).alias("n_missing"),
        F.avg(clean).alias("mean"),
        F.min(clean).alias("min"),
        F.max(clean).alias("max"),
    )


def stream_quality(
    spark: SparkSession,
    source_dir: str,
    schema,
    out_dir: str,
    checkpoint: str,
    ts: str = "ts",
    value: str = "value",
    window: str = "1 day",
    watermark: str = "1 hour",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Run the stream to completion (availableNow) and return the final window table
    (window_start, window_end, n_rows, n_missing, mean, min, max)."""
    return run_quality_stream(spark, source_dir, schema, out_dir, checkpoint, ts, value, window, watermark, max_files_per_trigger)[0]


def run_quality_stream(
    spark: SparkSession,
    source_dir: str,
    schema,
    out_dir: str,
    checkpoint: str,
    ts: str = "ts",
    value: str = "value",
    window: str = "1 day",
    watermark: str = "1 hour",
    max_files_per_trigger: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Y1 with its late rows: the window table, and one row per micro-batch that read anything (batch_id,
    n_read, n_on_time, n_late). Rows read come from the query's progress, written beside each
    batch's windows; a row is on time if it reached its window, so on-time and late rows add up to
    the rows read. Running again with the same folders goes on where the last run ended, with its
    watermark."""
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)
    # watermarks need TIMESTAMP (not timestamp_ntz): the wall clock is read as UTC, whatever
    # the session zone, so daily windows start at wall-clock midnight
    tz = spark.conf.get("spark.sql.session.timeZone")
    if isinstance(schema[ts].dataType, T.TimestampNTZType):
        stream = stream.withColumn(ts, F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(ts)).cast("timestamp"))
    stream = stream.withWatermark(ts, watermark)
    agg = window_quality_agg(stream, ts, value, window)
    windows, progress = os.path.join(out_dir, "windows"), os.path.join(out_dir, "progress")
    read: dict[int, int] = {}

    def note(query) -> None:
        """The last progress reports are kept by the query; each batch takes over what is there."""
        for p in query.recentProgress:
            read[p["batchId"]] = max(p["numInputRows"], read.get(p["batchId"], 0))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(os.path.join(windows, f"batch={batch_id}"))
        if started:
            note(started[0])

    started: list = []
    q = agg.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.append(q)
    q.awaitTermination()
    note(q)
    rows = [(b, n) for b, n in sorted(read.items()) if n]
    if rows:
        # one file per run, named by its first batch: a repeated run writes the same one
        spark.createDataFrame(rows, "batch_id long, n_read long").coalesce(1).write.mode("overwrite").parquet(os.path.join(progress, f"from={rows[0][0]}"))
    updates = spark.read.schema(f"w struct<start:timestamp,end:timestamp>, {_STATS}, batch_id long").parquet(os.path.join(windows, "batch=*"))
    reads = spark.read.schema("batch_id long, n_read long").parquet(os.path.join(progress, "from=*"))
    # a window's rows are cumulative: a batch brought what its update has beyond the one before
    before = F.lag("n_rows", 1, 0).over(Window.partitionBy("w").orderBy("batch_id"))
    on_time = updates.withColumn("new", F.col("n_rows") - before).groupBy("batch_id").agg(F.sum("new").alias("n"))
    batches = reads.groupBy("batch_id").agg(F.max("n_read").alias("n_read")).join(on_time, "batch_id", "left")
    batches = batches.select("batch_id", "n_read", F.coalesce("n", F.lit(0)).alias("n_on_time"), (F.col("n_read") - F.coalesce("n", F.lit(0))).alias("n_late"))
    return final_windows(updates), batches


_STATS = "n_rows long, n_missing long, mean double, min double, max double"


def final_windows(updates: DataFrame) -> DataFrame:
    """Latest version of every window; window bounds back to UTC wall clock (timestamp_ntz)."""
    tz = updates.sparkSession.conf.get("spark.sql.session.timeZone")
    latest = updates.groupBy("w").agg(F.max_by(F.struct("n_rows", "n_missing", "mean", "min", "max"), F.col("batch_id")).alias("s"))
    return latest.select(
        F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col("w.start").cast("timestamp_ntz")).alias("window_start"),
        F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col("w.end").cast("timestamp_ntz")).alias("window_end"),
        "s.n_rows",
        "s.n_missing",
        "s.mean",
        "s.min",
        "s.max",
    )


def drift_psi(reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Y2: population stability index per column: bins = exact reference quantile edges
    (k / bins), PSI = sum over bins (c - r) ln(c / r), shares floored at ``floor``."""
    from prepline.operators.features import column_quantiles

    probs = [k / bins for k in range(1, bins)]
    names = [f"e{k}" for k in range(1, bins)]
    edges = column_quantiles(reference, columns, probs, names)  # one row per column
    out = None
    for i, c in enumerate(columns):
        e = edges.where(F.col("position") == i).select(*names)

        def binned(df: DataFrame, tag: str) -> DataFrame:
            v = F.col(c).cast("double")
            b = sum((F.when(v >= F.col(n), 1).otherwise(0) for n in names[1:]), F.when(v >= F.col(names[0]), 1).otherwise(0))
            j = attach_one_row(df.where(v.isNotNull() & ~F.isnan(v)).select(c), e)
            counts = j.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias(f"n_{tag}"))
            tot = counts.agg(F.sum(f"n_{tag}").alias(f"t_{tag}"))
            return attach_one_row(counts, tot)

        r, cu = binned(reference, "r"), binned(current, "c")
        grid = reference.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        j = grid.join(r.drop(f"t_r"), "bin", "left").join(cu.drop("t_c"), "bin", "left")
        j = attach_one_row(attach_one_row(j, r.select("t_r").limit(1)), cu.select("t_c").limit(1))
        rs = F.greatest(F.coalesce(F.col("n_r"), F.lit(0)) / F.col("t_r"), F.lit(floor))
        cs = F.greatest(F.coalesce(F.col("n_c"), F.lit(0)) / F.col("t_c"), F.lit(floor))
        psi = j.agg(F.sum((cs - rs) * F.log(cs / rs)).alias("psi")).select(F.lit(c).alias("column_name"), "psi")
        out = psi if out is None else out.unionByName(psi)
    return out
