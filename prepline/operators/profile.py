"""Data profile (A1-A16): one row per column, built from one wide aggregation pass plus one
map-side-combined distinct-value table. Every output is a DataFrame; only schema-sized
scalars (a maximum distinct count) ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepline.functions.exprs import attach_one_row
from pyspark.sql import types as T

from prepline.functions.exprs import (
    as_double,
    canonical_string,
    guarded_corr,
    is_complex,
    is_fractional,
    is_numeric,
    missing,
    pandas_dtype,
)
from prepline.functions.quantiles import collect_sorted, exact_quantiles, quantiles_wide, ranged_values, smallest_k, weighted_values

SAMPLE_K = 5
SAMPLE_SEP = "|"


def qcol(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def columns_table(df: DataFrame) -> DataFrame:
    """(position, column_name, dtype, spark_type): metadata only, one row per column."""
    spark = df.sparkSession
    rows = [(i, f.name, pandas_dtype(f.dataType), f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column_name string, dtype string, spark_type string")


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- A1-A3, A5 (one pass)

def _wide_pass(df: DataFrame, stats: bool) -> DataFrame:
    """(n_rows, position, n_missing[, mean, std, min, max]) in one aggregation, reshaped by stack."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(fields):
        c = qcol(f.name)
        aggs.append(F.count_if(missing(c, f.dataType)).alias(f"m{i}"))
        if stats and is_numeric(f.dataType):
            d = as_double(c, f.dataType)
            aggs += [
                F.avg(d).alias(f"a{i}"),
                F.stddev_samp(d).alias(f"s{i}"),
                F.min(d).alias(f"lo{i}"),
                F.max(d).alias(f"hi{i}"),
            ]
    wide = df.agg(*aggs)
    null = "CAST(NULL AS DOUBLE)"
    parts = []
    for i, f in enumerate(fields):
        parts += [f"{i}", f"m{i}"]
        if stats:
            if is_numeric(f.dataType):
                parts += [f"a{i}", f"s{i}", f"lo{i}", f"hi{i}"]
            else:
                parts += [null] * 4
    names = "position, n_missing" + (", mean, std, min, max" if stats else "")
    return wide.selectExpr("__n AS n_rows", f"stack({len(fields)}, {', '.join(parts)}) AS ({names})")


def missing_by_column(df: DataFrame) -> DataFrame:
    """A1: (position, column_name, n_rows, n_missing, missing_percentage)."""
    if not df.columns:
        return _empty(df.sparkSession, "position int, column_name string, n_rows bigint, n_missing bigint, missing_percentage double")
    w = _wide_pass(df, stats=False)
    return w.join(F.broadcast(columns_table(df).select("position", "column_name")), "position").select(
        "position",
        "column_name",
        "n_rows",
        "n_missing",
        F.round(F.try_divide(F.col("n_missing") * 100.0, F.col("n_rows")), 2).alias("missing_percentage"),
    )


def missing_total(df: DataFrame) -> DataFrame:
    """A2: one row (n_rows, n_cols, total_cells, total_missing, missing_percentage)."""
    n_cols = len(df.columns)
    if n_cols == 0:
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            "n_rows",
            F.lit(0).alias("n_cols"),
            F.lit(0).cast("long").alias("total_cells"),
            F.lit(0).cast("long").alias("total_missing"),
            F.lit(None).cast("double").alias("missing_percentage"),
        )
    total = None
    for f in df.schema.fields:
        t = F.count_if(missing(qcol(f.name), f.dataType))
        total = t if total is None else total + t
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("total_missing")).select(
        "n_rows",
        F.lit(n_cols).alias("n_cols"),
        (F.col("n_rows") * n_cols).alias("total_cells"),
        "total_missing",
        F.round(F.try_divide(F.col("total_missing") * 100.0, F.col("n_rows") * n_cols), 6).alias("missing_percentage"),
    )


def columns_with_missing(df: DataFrame) -> DataFrame:
    """A3: (position, column_name) of columns with at least one missing cell."""
    return missing_by_column(df).where(F.col("n_missing") > 0).select("position", "column_name")


# ---------------------------------------------------------------- distinct-value table (A4, A5 median, A8)

def distinct_values(df: DataFrame) -> DataFrame:
    """(position, l, d, s, w): each distinct non-missing value of each scalar column.

    Integral columns are keyed by their exact ``l`` (bigint), floating columns by ``d``
    (double, NaN dropped, -0.0 folded into 0.0), everything else by an injective string ``s``
    (decimals also carry ``d`` for statistics). No number is formatted as text here; strings
    are made later for the few sample values only. One explode + a partially aggregated
    groupBy: a hot value costs one shuffled row per task, not one per occurrence.
    """
    elems = []
    null_l, null_d, null_s = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    for i, f in enumerate(df.schema.fields):
        if is_complex(f.dataType):
            continue
        c = qcol(f.name)
        dt = f.dataType
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            l, d, s = c.cast("long"), null_d, null_s
        elif is_fractional(dt):
            v = as_double(c, dt)
            l, d, s = null_l, F.when(v == 0, F.lit(0.0)).otherwise(v), null_s
        elif is_numeric(dt):
            l, d, s = null_l, as_double(c, dt), canonical_string(c, dt)
        else:
            l, d, s = null_l, null_d, canonical_string(c, dt)
        elems.append({"position": F.lit(i), "l": l, "d": d, "s": s})
    if not elems:
        return _empty(df.sparkSession, "position int, l bigint, d double, s string, w bigint")
    # stack (a codegen'd generator) instead of explode(array(struct)): no per-row array
    args = []
    for e in elems:
        args += [e["position"], e["l"], e["d"], e["s"]]
    stacked = df.select(F.stack(F.lit(len(elems)), *args).alias("position", "l", "d", "s"))
    present = F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull()
    return stacked.where(present).groupBy("position", "l", "d", "s").agg(F.count(F.lit(1)).alias("w"))


def _sample_text(df: DataFrame):
    """String form of a distinct-value row, through the column's own type (5 rows per column)."""
    out = F.col("s")
    for i, f in enumerate(df.schema.fields):
        dt = f.dataType
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out = F.when(F.col("position") == i, F.col("l").cast(dt).cast("string")).otherwise(out)
        elif is_fractional(dt):
            out = F.when(F.col("position") == i, F.col("d").cast(dt).cast("string")).otherwise(out)
    return out


def _samples(df: DataFrame, vals: DataFrame, k: int) -> DataFrame:
    top = smallest_k(vals, "position", ["l", "d", "s"], k)
    return collect_sorted(top.withColumn("__txt", _sample_text(df)), "position", "_rk", "__txt", "sample_values", SAMPLE_SEP)


def unique_values(df: DataFrame, exact: bool = True) -> DataFrame:
    """A4: (position, column_name, unique_values); NULL for complex columns."""
    cols = columns_table(df)
    if exact:
        counts = distinct_values(df).groupBy("position").agg(F.count(F.lit(1)).alias("unique_values"))
    else:
        aggs = [
            F.approx_count_distinct(canonical_string(qcol(f.name), f.dataType)).alias(f"u{i}")
            for i, f in enumerate(df.schema.fields)
            if not is_complex(f.dataType)
        ]
        idx = [i for i, f in enumerate(df.schema.fields) if not is_complex(f.dataType)]
        if not idx:
            counts = _empty(df.sparkSession, "position int, unique_values bigint")
        else:
            counts = df.agg(*aggs).selectExpr(
                f"stack({len(idx)}, {', '.join(f'{i}, u{i}' for i in idx)}) AS (position, unique_values)"
            )
    scalar = [i for i, f in enumerate(df.schema.fields) if not is_complex(f.dataType)]
    return (
        cols.join(counts, "position", "left")
        .select(
            "position",
            "column_name",
            F.when(F.col("position").isin(scalar), F.coalesce(F.col("unique_values"), F.lit(0)))
            .cast("long")
            .alias("unique_values"),
        )
    )


def _medians(vals: DataFrame) -> DataFrame:
    v = F.coalesce(F.col("d"), F.col("l").cast("double"))
    # one of l / d is set per numeric column, so (position, v) is already distinct; repeated v
    # would still be handled (ranks sum weights over equal values)
    num = vals.where(v.isNotNull()).select("position", v.alias("v"), "w")
    q = exact_quantiles(num, ["position"], [0.5])
    return q.select("position", F.col("q").alias("median"))


def numeric_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """A5: (position, column_name, mean, std, min, max, median) for numeric columns."""
    cols = columns_table(df)
    num_idx = [i for i, f in enumerate(df.schema.fields) if is_numeric(f.dataType)]
    if not num_idx:
        return _empty(df.sparkSession, "position int, column_name string, mean double, std double, min double, max double, median double")
    w = _wide_pass(df, stats=True).where(F.col("position").isin(num_idx))
    if exact:
        num = [(i, f) for i, f in enumerate(df.schema.fields) if is_numeric(f.dataType)]
        long = df.select(
            F.explode(F.array(*[F.struct(F.lit(i).alias("position"), as_double(qcol(f.name), f.dataType).alias("v")) for i, f in num])).alias("e")
        ).select("e.*")
        weighted = weighted_values(long, ["position"], "v")
        med = exact_quantiles(weighted, ["position"], [0.5]).select("position", F.col("q").alias("median"))
    else:
        aggs = [F.percentile_approx(as_double(qcol(f.name), f.dataType), 0.5, 10000).alias(f"q{i}") for i, f in enumerate(df.schema.fields) if i in num_idx]
        med = df.agg(*aggs).selectExpr(
            f"stack({len(num_idx)}, {', '.join(f'{i}, CAST(q{i} AS DOUBLE)' for i in num_idx)}) AS (position, median)"
        )
    return (
        w.join(med, "position", "left")
        .join(F.broadcast(cols.select("position", "column_name")), "position")
        .select("position", "column_name", "mean", "std", "min", "max", "median")
    )


# ---------------------------------------------------------------- A6, A8, A9

def semantic_type(dtype_col, ratio_col):
    """A6 rule over (pandas dtype string, unique/rows ratio): boolean first (pandas would call
    a bool column numeric, which makes its boolean branch unreachable)."""
    return (
        F.when(dtype_col == "bool", "boolean")
        .when(dtype_col.startswith("int") | dtype_col.startswith("float"), "numeric")
        .when(dtype_col.startswith("datetime"), "datetime")
        .when(dtype_col == "object", F.when(ratio_col < 0.5, "categorical").otherwise("text"))
        .otherwise("mixed")
    )


def column_role(name_col, dtype_col):
    """First hit wins -- target words, identifier words, datetime, else feature."""
    from prepline.operators.rules import role_expr

    return role_expr(name_col, dtype_col)


def sample_values(df: DataFrame, k: int = SAMPLE_K, vals: DataFrame | None = None) -> DataFrame:
    """The k smallest distinct non-missing values per column, '|'-joined (numeric order for
    numbers, string order otherwise)."""
    cols = columns_table(df)
    if vals is None:
        vals = distinct_values(df)
    joined = _samples(df, vals, k)
    return cols.join(joined, "position", "left").select("position", "column_name", "sample_values")


def infer_semantic_type(df: DataFrame) -> DataFrame:
    """(position, column_name, dtype, data_type). Only string columns need their distinct values; the
    other types follow from the schema."""
    cols = columns_table(df)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if strings:
        narrow = df.select(*[qcol(c) for c in strings])
        counts = attach_one_row(unique_values(narrow), narrow.agg(F.count(F.lit(1)).alias("n"))).select("column_name", F.try_divide(F.col("unique_values").cast("double"), "n").alias("ratio"))
        cols = cols.join(F.broadcast(counts), "column_name", "left")  # one row per column
    else:
        cols = cols.withColumn("ratio", F.lit(None).cast("double"))
    return cols.select("position", "column_name", "dtype", semantic_type(F.col("dtype"), F.col("ratio")).alias("data_type"))


PROFILE_SCHEMA = (
    "position int, column_name string, dtype string, data_type string, potential_role string, n_rows bigint, "
    "n_missing bigint, missing_percentage double, unique_values bigint, sample_values string, mean double, "
    "std double, min double, max double, median double"
)


def column_profile(df: DataFrame, exact: bool = True, k: int = SAMPLE_K) -> DataFrame:
    """One row per column -- A1 + A4 + A5 + A6 + A8 + R4.

    Plan: (1) one wide aggregate for missing counts and moments; (2) one distinct-value
    table (stack + partial aggregate), persisted because three consumers read it
    (distinct counts, exact medians, samples). Everything joined afterwards has one row per
    column, so those joins are broadcast-sized by construction. Eager: the result is
    checkpointed and the cache released.
    """
    spark = df.sparkSession
    if not df.columns:
        return _empty(spark, PROFILE_SCHEMA)
    cols = columns_table(df)
    wide = _wide_pass(df, stats=True)
    vals = distinct_values(df).persist(StorageLevel.MEMORY_AND_DISK)
    uniq = vals.groupBy("position").agg(F.count(F.lit(1)).alias("unique_values"))
    if exact:
        med = _medians(vals)
    else:
        num_idx = [i for i, f in enumerate(df.schema.fields) if is_numeric(f.dataType)]
        if num_idx:
            aggs = [F.percentile_approx(as_double(qcol(f.name), f.dataType), 0.5, 10000).alias(f"q{i}") for i, f in enumerate(df.schema.fields) if i in num_idx]
            med = df.agg(*aggs).selectExpr(
                f"stack({len(num_idx)}, {', '.join(f'{i}, CAST(q{i} AS DOUBLE)' for i in num_idx)}) AS (position, median)"
            )
        else:
            med = _empty(spark, "position int, median double")
    samples = _samples(df, vals, k)
    scalar = [i for i, f in enumerate(df.schema.fields) if not is_complex(f.dataType)]
    numeric = [i for i, f in enumerate(df.schema.fields) if is_numeric(f.dataType)]
    prof = (
        cols.join(wide, "position")
        .join(uniq, "position", "left")
        .join(med, "position", "left")
        .join(samples, "position", "left")
    )
    uv = F.when(F.col("position").isin(scalar), F.coalesce(F.col("unique_values"), F.lit(0))).cast("long")
    ratio = F.try_divide(uv.cast("double"), F.col("n_rows").cast("double"))
    is_num = F.col("position").isin(numeric)
    out = prof.select(
        "position",
        "column_name",
        "dtype",
        semantic_type(F.col("dtype"), ratio).alias("data_type"),
        column_role(F.col("column_name"), F.col("dtype")).alias("potential_role"),
        "n_rows",
        "n_missing",
        F.round(F.try_divide(F.col("n_missing") * 100.0, F.col("n_rows")), 2).alias("missing_percentage"),
        uv.alias("unique_values"),
        "sample_values",
        F.when(is_num, F.col("mean")).alias("mean"),
        F.when(is_num, F.col("std")).alias("std"),
        F.when(is_num, F.col("min")).alias("min"),
        F.when(is_num, F.col("max")).alias("max"),
        F.when(is_num, F.col("median")).alias("median"),
    )
    # one row per column: materialise it to reliable storage and release the cached
    # distinct-value table, so every consumer of the profile reads this small table
    from prepline.session import cut_lineage

    out = cut_lineage(out)
    vals.unpersist()
    return out


# ---------------------------------------------------------------- A7

def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy (nulls equal, NaN equal, -0.0 = 0.0): one groupBy on all
    columns with map-side combine, so a row repeated a billion times is one row per task."""
    if not df.columns:
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            "n_rows", F.lit(0).cast("long").alias("duplicate_rows"), F.lit(None).cast("double").alias("duplicate_percentage")
        )
    grouped = df.groupBy(*[qcol(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__c"))
    return grouped.agg(F.sum("__c").alias("n_rows"), F.sum(F.col("__c") - 1).alias("duplicate_rows")).select(
        F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce(F.col("duplicate_rows"), F.lit(0)).cast("long").alias("duplicate_rows"),
        F.round(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("n_rows")), 6).alias("duplicate_percentage"),
    )


# ---------------------------------------------------------------- A11 outliers

OUTLIER_METHODS = ("iqr", "zscore", "modified_z")


def _numeric_long(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(position, v) for every numeric cell (v NULL for missing) via ``stack`` (a codegen'd
    generator: no per-row array is built)."""
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if is_numeric(f.dataType) and (columns is None or f.name in columns)]
    cols = columns_table(df).where(F.col("position").isin([i for i, _ in fields]))
    args = [x for i, f in fields for x in (F.lit(i), as_double(qcol(f.name), f.dataType))]
    long = df.select(F.stack(F.lit(len(fields)), *args).alias("position", "v"))
    return long, cols


def outlier_bounds(df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None, weighted: DataFrame | None = None) -> DataFrame:
    """(position, column_name, lower, upper, center, scale) per numeric column. ``weighted`` is the
    distinct-value table of ``ranged_values``, if there is one already.

    iqr: Q1 - 1.5 IQR, Q3 + 1.5 IQR. zscore: mean -+ 3 sample std. modified_z: median -+
    3.5 MAD / 0.6745 (MAD = 0 gives NULL bounds).
    """
    long, cols = _numeric_long(df, columns)
    if method == "zscore":
        b = long.groupBy("position").agg(F.avg("v").alias("center"), F.stddev_samp("v").alias("scale"))
        b = b.select("position", "center", "scale", (F.col("center") - 3 * F.col("scale")).alias("lower"), (F.col("center") + 3 * F.col("scale")).alias("upper"))
    else:
        if weighted is None:
            weighted = ranged_values(weighted_values(long, ["position"], "v"), ["position"])
        if method == "iqr":
            q = quantiles_wide(exact_quantiles(weighted, ["position"], [0.25, 0.75], ranged=weighted), ["position"], [0.25, 0.75], ["q1", "q3"])
            iqr = F.col("q3") - F.col("q1")
            b = q.select(
                "position",
                F.lit(None).cast("double").alias("center"),
                iqr.alias("scale"),
                (F.col("q1") - 1.5 * iqr).alias("lower"),
                (F.col("q3") + 1.5 * iqr).alias("upper"),
            )
        elif method == "modified_z":
            med = exact_quantiles(weighted, ["position"], [0.5], ranged=weighted).select("position", F.col("q").alias("center"))
            dev = weighted.join(F.broadcast(med), "position").select(
                "position", F.abs(F.col("v") - F.col("center")).alias("v"), "w"
            ).groupBy("position", "v").agg(F.sum("w").alias("w"))
            mad = exact_quantiles(dev, ["position"], [0.5]).select("position", F.col("q").alias("scale"))
            k = 3.5 * 1 / 0.6745
            b = med.join(mad, "position").select(
                "position",
                "center",
                "scale",
                F.when(F.col("scale") > 0, F.col("center") - k * F.col("scale")).alias("lower"),
                F.when(F.col("scale") > 0, F.col("center") + k * F.col("scale")).alias("upper"),
            )
        else:
            raise ValueError(f"unknown outlier method {method!r}")
    return cols.select("position", "column_name").join(b, "position", "left")


def outlier_flags(df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None) -> DataFrame:
    """Row-level outlier test per (row, column) in long form: (position, v, is_outlier)."""
    long, _ = _numeric_long(df, columns)
    bounds = outlier_bounds(df, method, columns)
    return long.join(F.broadcast(bounds), "position").select(
        "position", "column_name", "v", ((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))).alias("is_outlier")
    )


def outlier_counts(df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None) -> DataFrame:
    """(position, column_name, method, n_outliers, lower, upper).

    iqr / modified_z: one explode builds the weighted distinct-value table (position, v, w);
    range-partitioned once, it feeds both the exact quantiles and the count (sum of w outside
    the bounds), so the table is scanned once. zscore: moments and the count over the long
    form. The bounds table has one row per column, so broadcasting it is safe at any data size.
    Eager: the result (one row per column) is checkpointed."""
    from prepline.session import cut_lineage

    long, _ = _numeric_long(df, columns)
    if method == "zscore":
        bounds = outlier_bounds(df, method, columns)
        test = F.abs((F.col("v") - F.col("center")) / F.col("scale")) > 3
        counts = long.join(F.broadcast(bounds.select("position", "center", "scale")), "position").groupBy("position").agg(
            F.count_if(F.coalesce(test, F.lit(False))).alias("n_outliers")
        )
    else:
        weighted = ranged_values(weighted_values(long, ["position"], "v"), ["position"])
        bounds = outlier_bounds(df, method, columns, weighted=weighted)
        if method == "modified_z":
            # modified z = 0.6745 (x - median) / MAD  > 3.5
            test = F.abs(F.lit(0.6745) * (F.col("v") - F.col("center")) / F.col("scale")) > 3.5
        else:
            test = (F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))
        counts = weighted.join(F.broadcast(bounds.select("position", "center", "scale", "lower", "upper")), "position").groupBy("position").agg(
            F.sum(F.when(F.coalesce(test, F.lit(False)), F.col("w")).otherwise(0)).alias("n_outliers")
        )
    out = bounds.join(counts, "position", "left").select(
        "position",
        "column_name",
        F.lit(method).alias("method"),
        F.coalesce(F.col("n_outliers"), F.lit(0)).cast("long").alias("n_outliers"),
        F.round("lower", 6).alias("lower"),
        F.round("upper", 6).alias("upper"),
    )
    return cut_lineage(out)


# ---------------------------------------------------------------- A12 type consistency

DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy")


def types_consistent(df: DataFrame) -> DataFrame:
    """For each string column, share of non-null values castable to a number and to a date;
    inconsistent when either share lies strictly between 0 and 1."""
    strs = [(i, f) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    if not strs:
        return _empty(df.sparkSession, "position int, column_name string, n_values bigint, numeric_share double, date_share double, consistent boolean")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), qcol(f.name).alias("s")) for i, f in strs])).alias("e")).select("e.*")
    long = long.where(F.col("s").isNotNull())
    parsed_date = F.coalesce(*[F.try_to_timestamp(F.col("s"), F.lit(fmt)) for fmt in DATE_FORMATS])
    agg = long.groupBy("position").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(F.trim(F.col("s")).try_cast("double").isNotNull()).alias("n_num"),
        F.count_if(parsed_date.isNotNull()).alias("n_date"),
    )
    cols = columns_table(df).where(F.col("position").isin([i for i, _ in strs]))
    out = cols.join(agg, "position", "left").select(
        "position",
        "column_name",
        F.coalesce(F.col("n_values"), F.lit(0)).cast("long").alias("n_values"),
        F.round(F.try_divide(F.col("n_num").cast("double"), F.col("n_values")), 6).alias("numeric_share"),
        F.round(F.try_divide(F.col("n_date").cast("double"), F.col("n_values")), 6).alias("date_share"),
    )
    mixed = lambda c: (c > 0) & (c < 1)
    return out.withColumn("consistent", ~F.coalesce(mixed(F.col("numeric_share")) | mixed(F.col("date_share")), F.lit(False)))


# ---------------------------------------------------------------- A13, A14, A15

def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """A13 (part): (class_value, n, share) of a target column; missing excluded."""
    f = df.schema[target]
    c = qcol(target)
    base = df.where(~missing(c, f.dataType)).select(canonical_string(c, f.dataType).alias("class_value"))
    counts = base.groupBy("class_value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__tot"))  # one row, attached (no single-partition window)
    return attach_one_row(counts, total).select("class_value", "n", F.round(F.col("n") / F.col("__tot"), 6).alias("share"))


def target_analysis(df: DataFrame, target: str, problem_type: str | None = None) -> DataFrame:
    """One row -- target, missing %, n_classes, min/max class share, is_balanced
    (smallest class / largest class >= 0.5), numeric statistics, recommended metrics code."""
    f = df.schema[target]
    c = qcol(target)
    miss = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(missing(c, f.dataType)).alias("n_missing"),
        *(
            [F.avg(as_double(c, f.dataType)).alias("mean"), F.stddev_samp(as_double(c, f.dataType)).alias("std")]
            if is_numeric(f.dataType)
            else [F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std")]
        ),
    )
    classes = (
        df.where(~missing(c, f.dataType))
        .groupBy(canonical_string(c, f.dataType).alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.sum("n").alias("tot"))
    )
    kind = problem_type or ""
    metrics = "accuracy,precision,recall,f1" if "classification" in kind else ("mse,rmse,mae,r2" if "regression" in kind else None)
    return attach_one_row(miss, classes).select(
        F.lit(target).alias("target"),
        F.round(F.try_divide(F.col("n_missing") * 100.0, F.col("n_rows")), 2).alias("missing_percentage"),
        F.col("n_classes").cast("long").alias("n_classes"),
        F.round(F.try_divide(F.col("min_n").cast("double"), F.col("tot")), 6).alias("min_class_share"),
        F.round(F.try_divide(F.col("max_n").cast("double"), F.col("tot")), 6).alias("max_class_share"),
        (F.try_divide(F.col("min_n").cast("double"), F.col("max_n")) >= 0.5).alias("is_balanced"),
        F.round("mean", 6).alias("mean"),
        F.round("std", 6).alias("std"),
        F.lit(metrics).cast("string").alias("recommended_metrics"),
    )


def correlation_with_target(df: DataFrame, target: str, threshold: float = 0.7) -> DataFrame:
    """Pearson r of each numeric column with a numeric target (pairwise-complete rows),
    NULL for constant columns; ``high`` when |r| > threshold. One aggregation pass."""
    tf = df.schema[target]
    if not is_numeric(tf.dataType):
        return _empty(df.sparkSession, "column_name string, corr double, high boolean")
    y = as_double(qcol(target), tf.dataType)
    others = [f for f in df.schema.fields if is_numeric(f.dataType) and f.name != target]
    if not others:
        return _empty(df.sparkSession, "column_name string, corr double, high boolean")
    aggs = []
    for i, f in enumerate(others):
        x = as_double(qcol(f.name), f.dataType)
        both = x.isNotNull() & y.isNotNull()
        aggs.append(guarded_corr(F.when(both, x), F.when(both, y)).alias(f"r{i}"))
    names = ", ".join(f"'{f.name.replace(chr(39), chr(39) * 2)}', r{i}" for i, f in enumerate(others))
    out = df.agg(*aggs).selectExpr(f"stack({len(others)}, {names}) AS (column_name, corr)")
    return out.select("column_name", F.round("corr", 6).alias("corr"), (F.abs("corr") > threshold).alias("high"))


def _numeric_fields(df: DataFrame, columns: Sequence[str] | None = None):
    return [f for f in df.schema.fields if is_numeric(f.dataType) and (columns is None or f.name in columns)]


#: tables of partial sums per column that meet before the last sum, so no group grows with the partitions
CORR_SALTS = 64
#: cells of a batch multiplied at once
CORR_CELLS = 4_000_000


def correlation_matrix(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None) -> DataFrame:
    """Long form (col_a, col_b, r) for every pair a < b (by position), pairwise-complete.

    Two scans: (1) means; (2) sums of products of mean-centred values as blocked outer products: each
    task multiplies its batches as matrices (values and their presence), so a pair counts the rows
    where both are known, and adds them up. The tasks' sums leave as one row per column and are added
    in two steps (by column and salt, then by column), so neither plan nor groups grow with the
    number of pairs or partitions: thousands of columns plan like two. r is NULL for a constant
    column. Spearman: each column is first replaced by its average rank (distributed ranks).
    """
    import numpy as np
    import pandas as pd

    fields = _numeric_fields(df, columns)
    if method == "spearman":
        df = rank_transform(df, [f.name for f in fields])
        fields = [T.StructField(f.name, T.DoubleType()) for f in fields]
    names = [f.name for f in fields]
    c = len(names)
    if c < 2:
        return _empty(df.sparkSession, "col_a string, col_b string, r double")
    values = df.select(*[as_double(qcol(f.name), f.dataType).alias(f"v{i}") for i, f in enumerate(fields)])
    means = values.agg(*[F.avg(f"v{i}").alias(f"m{i}") for i in range(c)]).first()  # one number per column
    mu = np.array([m if m is not None else 0.0 for m in means])

    def multiply(batches):
        both, total, square, cross = (np.zeros((c, c)) for _ in range(4))
        step = max(1, CORR_CELLS // c)
        for b in batches:
            for lo in range(0, len(b), step):
                x = b.iloc[lo : lo + step].to_numpy(dtype=float) - mu
                known = ~np.isnan(x)
                x = np.where(known, x, 0.0)
                known = known.astype(float)
                both += known.T @ known
                total += x.T @ known  # [i, j]: sum of column i over rows where j is known
                square += (x * x).T @ known
                cross += x.T @ x
        for i in range(c - 1):
            j = slice(i + 1, c)
            sums = np.vstack([both[i, j], total[i, j], total[j, i], square[i, j], square[j, i], cross[i, j]])
            yield pd.DataFrame({"i": [i], "sums": [sums.tobytes()]})

    def added(rows: pd.DataFrame):
        return sum(np.frombuffer(s) for s in rows["sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": rows["i"].iloc[:1], "sums": [added(rows).tobytes()]})

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        i = int(rows["i"].iloc[0])
        n, sa, sb, qa, qb, x = added(rows).reshape(6, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            va, vb = qa - sa * sa / n, qb - sb * sb / n
            r = np.clip((x - sa * sb / n) / np.sqrt(va * vb), -1.0, 1.0)
        r = np.where((va > 0) & (vb > 0) & (n > 1), r, np.nan)
        return pd.DataFrame({"col_a": names[i], "col_b": names[i + 1 :], "r": r})

    parts = values.mapInPandas(multiply, "i int, sums binary").withColumn("salt", F.spark_partition_id() % CORR_SALTS)
    parts = parts.groupBy("i", "salt").applyInPandas(add, "i int, sums binary")
    out = parts.groupBy("i").applyInPandas(finish, "col_a string, col_b string, r double")
    return out.withColumn("r", F.round(F.when(~F.isnan("r"), F.col("r")), 6))


def rank_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each listed numeric column by its average rank (ties share the mean rank, as
    pandas ``rank(method='average')``). Ranks come from a distributed running count over the
    column's distinct values (no single-task window); a hot value is one row there."""
    from prepline.functions.ordering import average_ranks

    out = df
    for name in columns:
        f = df.schema[name]
        vals = df.select(as_double(qcol(name), f.dataType).alias("__v"))
        ranks = average_ranks(vals, [], "__v", "__rank").select("__v", "__rank")
        out = (
            out.join(ranks, as_double(qcol(name), f.dataType) == F.col("__v"), "left")
            .drop("__v")
            .withColumn(name, F.col("__rank"))
            .drop("__rank")
        )
    return out


# ---------------------------------------------------------------- A10, A16

def dataset_summary(df: DataFrame) -> DataFrame:
    """A10: one row -- shape, missing totals, type lists, duplicate count, issue codes (R2)."""
    from prepline.operators.rules import issue_codes

    # counts of missing cells in one pass; the type lists follow from the schema
    prof = missing_by_column(df).join(F.broadcast(columns_table(df).select("position", "dtype")), "position")
    dup = duplicate_rows(df)
    agg = prof.agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_cols"),
        F.sum("n_missing").alias("total_missing"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("n_missing") > 0, F.col("column_name")))), ",").alias("columns_with_missing"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("dtype").startswith("int") | F.col("dtype").startswith("float"), F.col("column_name")))), ",").alias("numerical_columns"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("dtype") == "object", F.col("column_name")))), ",").alias("categorical_columns"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("dtype").startswith("datetime"), F.col("column_name")))), ",").alias("datetime_columns"),
    )
    out = attach_one_row(agg, dup.select("duplicate_rows")).select(
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
        F.col("n_cols").cast("long").alias("n_cols"),
        F.coalesce("total_missing", F.lit(0)).cast("long").alias("total_missing"),
        F.round(F.try_divide(F.col("total_missing") * 100.0, F.col("n_rows") * F.col("n_cols")), 6).alias("missing_percentage"),
        "columns_with_missing",
        "numerical_columns",
        "categorical_columns",
        "datetime_columns",
        "duplicate_rows",
    )
    return out.withColumn("potential_issues", issue_codes(F.col("n_rows"), F.col("n_cols"), F.col("missing_percentage"), F.col("duplicate_rows")))


def data_quality_report(df: DataFrame, outlier_method: str = "iqr") -> DataFrame:
    """One row -- missing, duplicates, total outliers, type consistency, recommendation codes
    (HIGH_MISSING_GT_30, SMALL_LT_1000)."""
    tot = missing_total(df)
    dup = duplicate_rows(df).select("duplicate_rows", "duplicate_percentage")
    outl = outlier_counts(df, outlier_method).agg(F.coalesce(F.sum("n_outliers"), F.lit(0)).cast("long").alias("outliers_detected"))
    cons = types_consistent(df).agg(F.coalesce(F.bool_and("consistent"), F.lit(True)).alias("data_types_consistent"))
    out = attach_one_row(attach_one_row(attach_one_row(tot, dup), outl), cons)
    recs = F.concat_ws(
        ",",
        F.when(F.col("missing_percentage") > 30, F.lit("HIGH_MISSING_GT_30")),
        F.when(F.col("n_rows") < 1000, F.lit("SMALL_LT_1000")),
    )
    return out.select(
        "n_rows",
        "n_cols",
        F.col("total_missing").alias("total_missing_values"),
        "missing_percentage",
        "duplicate_rows",
        "duplicate_percentage",
        "outliers_detected",
        "data_types_consistent",
        recs.alias("recommendations"),
    )


__all__ = [n for n in dir() if not n.startswith("_")]
