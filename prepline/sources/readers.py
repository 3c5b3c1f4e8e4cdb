"""Readers and sinks (S1-S10): thin choices among Spark's own data sources.

Everything is a distributed scan; no RDDs.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepline.functions.exprs import attach_one_row
from pyspark.sql import types as T

from prepline.session import checkpoint_dir

# ---- fixed values: extension -> format, separator candidates ----
EXTENSION_FORMATS = {
    ".csv": "csv",
    ".tsv": "csv",
    ".txt": "csv",
    ".json": "json",
    ".jsonl": "json",
    ".parquet": "parquet",
    ".feather": "feather",
    ".arrow": "feather",
}
SEPARATOR_CANDIDATES = [",", ";", "\t", "|"]
# ---- end of fixed values ----


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A folder under the shared checkpoint folder (never machine-local on a cluster)."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:") :]
    return os.path.join(base, "prepline-io", *parts)


# ------------------------------------------------------------------ S1 CSV

def read_csv(
    spark: SparkSession,
    path: str,
    separator: str = ",",
    header_row: int = 0,
    encoding: str = "utf-8",
    infer_schema: bool = True,
    schema: T.StructType | str | None = None,
    quoted_breaks: bool = True,
    escape: str = '"',
) -> DataFrame:
    """CSV whose header is line ``header_row`` (0-based) of every file; earlier lines are
    dropped. Rows are always parsed by Spark's CSV reader; with ``quoted_breaks`` a line break
    inside quotes belongs to its field, and a file is then one split. Where no field has one,
    ``quoted_breaks=False`` lets large files be split. A quote inside quotes is doubled; files that
    Spark wrote with its defaults have ``escape="\\\\"``.

    For ``header_row`` > 0 the names come from that line of the first file. Each task then counts
    the records at the start of the files it reads, as they stream by, and drops those up to and
    with the first among ``header_row`` + 1 that equals the header (all of them if none does), so
    no file is sorted, shuffled or numbered as a whole. Types are inferred over the whole column
    (every non-null value must cast). A file's start is its first split."""
    opts = {"sep": separator, "encoding": encoding, "escape": escape, "multiLine": str(quoted_breaks).lower()}
    if header_row <= 0:
        reader = spark.read.options(header="true", inferSchema=str(infer_schema and schema is None).lower(), **opts)
        return (reader if schema is None else reader.schema(schema)).csv(path)
    import csv
    import io

    files = sorted(spark.read.options(**opts).text(path).inputFiles())
    head = [r["value"] for r in spark.read.option("encoding", encoding).text(files[0]).limit(header_row + 1).collect()] if files else []
    if len(head) <= header_row:
        raise ValueError(f"no line {header_row} in {path}")
    names = next(csv.reader(io.StringIO(head[header_row]), delimiter=separator))  # one line: the header
    fields = [f"c{i}" for i in range(len(names))]
    rows = spark.read.options(header="false", **opts).schema(", ".join(f"{c} string" for c in fields)).csv(path)
    rows = rows.select(*fields, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    body = rows.mapInArrow(_skip_header([n or None for n in names], header_row + 1), ", ".join(f"{c} string" for c in fields))
    body = body.toDF(*names)
    if schema is not None:
        st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        return body.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in st.fields])
    if not infer_schema:
        return body
    return infer_types(body)


def _skip_header(header: list[str | None], most: int):
    """Drops the records of each file's first split up to its header, ``most`` at most; records of
    one split follow each other in one task."""

    def run(batches):
        import numpy as np

        done: set[str] = set()
        seen: dict[str, int] = {}
        for b in batches:
            files = b.column("file").dictionary_encode()
            code, start = files.indices.to_numpy(zero_copy_only=False), b.column("start").to_numpy(zero_copy_only=False)
            keep = np.ones(b.num_rows, dtype=bool)
            for k, file in enumerate(files.dictionary.to_pylist()):
                if file in done:
                    continue
                for i in np.flatnonzero((code == k) & (start == 0)).tolist():
                    keep[i] = False
                    seen[file] = seen.get(file, 0) + 1
                    if seen[file] >= most or [b.column(c)[i].as_py() for c in range(len(header))] == header:
                        done.add(file)
                        break
            out = b.select(list(range(len(header))))
            yield out if keep.all() else out.filter(pa.array(keep))

    return run


_INFER_ORDER = ["int", "bigint", "double", "timestamp", "boolean"]


def infer_types(df: DataFrame) -> DataFrame:
    """Cast each string column to the first of int, bigint, double, timestamp, boolean that
    every non-null value casts to (one aggregation over the whole table)."""
    aggs = []
    for i, c in enumerate(df.columns):
        ref = F.col(f"`{c}`")
        aggs.append(F.count(ref).alias(f"n{i}"))
        for t in _INFER_ORDER:
            aggs.append(F.count(ref.try_cast(t)).alias(f"{t}{i}"))
    row = df.agg(*aggs).first()  # (1 + 5) numbers per column: schema-sized
    out = []
    for i, c in enumerate(df.columns):
        target = next((t for t in _INFER_ORDER if row[f"n{i}"] > 0 and row[f"{t}{i}"] == row[f"n{i}"]), None)
        out.append(F.col(f"`{c}`").try_cast(target).alias(c) if target else F.col(f"`{c}`"))
    return df.select(*out)


# ------------------------------------------------------------------ S2 separator sniffing

def sniff_separator(spark: SparkSession, path: str, candidates: Sequence[str] = SEPARATOR_CANDIDATES) -> DataFrame:
    """For each candidate, the field count per non-empty line over the whole file; the
    chosen separator gives the most columns on every line (ties: list order). One pass."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    aggs = []
    for i, sep in enumerate(candidates):
        n = F.size(F.split(F.col("value"), _regex_escape(sep)))
        aggs += [F.min(n).alias(f"lo{i}"), F.max(n).alias(f"hi{i}")]
    wide = lines.agg(*aggs)
    stack = ", ".join(f"{i}, '{_sql_escape(sep)}', lo{i}, hi{i}" for i, sep in enumerate(candidates))
    per = wide.selectExpr(f"stack({len(candidates)}, {stack}) AS (rank, separator, min_fields, max_fields)")
    per = per.withColumn("consistent", (F.col("min_fields") == F.col("max_fields")) & (F.col("min_fields") > 1))
    score = F.when(F.col("consistent"), F.col("min_fields")).otherwise(F.lit(0))
    best = per.agg(F.max_by(F.col("rank"), F.struct(score, -F.col("rank"))).alias("best"))
    return attach_one_row(per, best).select(
        "rank",
        "separator",
        F.col("min_fields").cast("int").alias("min_fields"),
        F.col("max_fields").cast("int").alias("max_fields"),
        "consistent",
        (F.col("rank") == F.col("best")).alias("chosen"),
    )


def _regex_escape(s: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in s)


def _sql_escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'").replace("\t", "\\t")


# ------------------------------------------------------------------ S3 encoding detection

def detect_encoding(spark: SparkSession, path_glob: str) -> DataFrame:
    """S3: one row per file -- (path, encoding, has_bom, n_bytes). BOM first, else strict
    UTF-8 over the whole file, else latin-1. One task per file batch (binaryFile)."""
    files = spark.read.format("binaryFile").load(path_glob).select("path", "content")
    schema = "path string, encoding string, has_bom boolean, n_bytes bigint"

    def detect(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                b = bytes(content)
                if b.startswith(b"\xef\xbb\xbf"):
                    enc, bom = "utf-8-sig", True
                elif b.startswith(b"\xff\xfe") or b.startswith(b"\xfe\xff"):
                    enc, bom = "utf-16", True
                else:
                    bom = False
                    try:
                        b.decode("utf-8", errors="strict")
                        enc = "utf-8"
                    except UnicodeDecodeError:
                        enc = "latin-1"
                out.append((p, enc, bom, len(b)))
            yield pd.DataFrame(out, columns=["path", "encoding", "has_bom", "n_bytes"])

    return files.mapInPandas(detect, schema)


# ------------------------------------------------------------------ S4, S5, S6

def read_json(spark: SparkSession, path: str, encoding: str = "utf-8", multiline: bool | None = None) -> DataFrame:
    """An array of records (multiLine) or JSON Lines; detected from the first line."""
    if multiline is None:
        first = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.trim("value").alias("v")).first()
        multiline = bool(first and first["v"].startswith("["))
    return spark.read.options(multiLine=str(multiline).lower(), encoding=encoding).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with pushdown; row caps go through S8 (an order is required)."""
    return spark.read.parquet(path)


def read_feather(spark: SparkSession, path_glob: str) -> DataFrame:
    """Arrow IPC files, decoded one file per row inside tasks (mapInArrow). The schema is
    read from one file's footer on the driver (metadata only)."""
    files = spark.read.format("binaryFile").load(path_glob).select("path", "content")
    first = files.select("content").first()
    if first is None:
        raise FileNotFoundError(path_glob)
    arrow_schema = ipc.open_file(pa.BufferReader(bytes(first["content"]))).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    spark_schema = from_arrow_schema(arrow_schema)

    def decode(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                reader = ipc.open_file(pa.BufferReader(content))
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)

    return files.mapInArrow(decode, spark_schema)


def write_feather(df: DataFrame, path: str) -> DataFrame:
    """Sink: one Arrow IPC file per partition, written by the tasks; returns (file, n_rows).
    The file name is the partition id and is renamed into place when complete, so a retried
    task overwrites instead of duplicating."""

    def write(batches):
        from pyspark import TaskContext

        os.makedirs(path, exist_ok=True)
        pid = TaskContext.get().partitionId()
        target = os.path.join(path, f"part-{pid:05d}.feather")
        tmp = target + f".attempt-{TaskContext.get().attemptNumber()}"
        writer = None
        n = 0
        for b in batches:
            if writer is None:
                writer = ipc.new_file(tmp, b.schema)
            writer.write_batch(b)
            n += b.num_rows
        if writer is not None:
            writer.close()
            os.replace(tmp, target)
            yield pa.RecordBatch.from_pydict({"file": [target], "n_rows": [n]})

    return df.mapInArrow(write, "file string, n_rows bigint")


# ------------------------------------------------------------------ S7, S8, S9, S10

def format_of(path: str, format_hint: str = "auto") -> str:
    """S7 dispatch rule: the extension wins over the hint; unknown extensions read as CSV."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in EXTENSION_FORMATS:
        return EXTENSION_FORMATS[ext]
    if format_hint and format_hint != "auto":
        return format_hint
    return "csv"


def read_auto(spark: SparkSession, path: str, format_hint: str = "auto", **options) -> DataFrame:
    fmt = format_of(path, format_hint)
    if fmt == "csv":
        return read_csv(spark, path, **options)
    if fmt == "json":
        return read_json(spark, path, **options)
    if fmt == "parquet":
        return read_parquet(spark, path)
    if fmt == "feather":
        return read_feather(spark, path if any(ch in path for ch in "*?") else os.path.join(path, "*") if os.path.isdir(path) else path)
    raise ValueError(f"unsupported format {fmt!r}")


def row_cap(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first n rows by an explicit order (TakeOrderedAndProject: a per-task top-n,
    then n rows per task merged; never a full sort)."""
    if not order_by:
        raise ValueError("row_cap needs order_by: a distributed table has no file order")
    return df.orderBy(*order_by).limit(n)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """(row_no, record JSON, n_rows, n_cols, dtypes JSON) for the first n rows by order."""
    from prepline.operators.profile import columns_table

    head = row_cap(df, n, order_by)
    w = F.row_number().over(Window.orderBy(*order_by))  # over <= n rows
    recs = head.select(w.alias("row_no"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("record"))
    shape = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
    dtypes = columns_table(df).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column_name", "dtype"))))).alias("dtypes")
    )
    return attach_one_row(attach_one_row(recs, shape), dtypes)


def persist_dataset(df: DataFrame, source_path: str, root: str) -> DataFrame:
    """Write the table as Parquet under ``root``/<id>, id = first 16 hex of sha256(path).
    Returns (data_id, location, n_rows) read back from the written files."""
    import hashlib

    data_id = hashlib.sha256(source_path.encode()).hexdigest()[:16]
    location = os.path.join(root, data_id)
    df.write.mode("overwrite").parquet(location)
    back = df.sparkSession.read.parquet(location)
    return back.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(data_id).alias("data_id"), F.lit(location).alias("location"), "n_rows")
