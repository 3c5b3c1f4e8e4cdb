"""Column-expression helpers shared by every operator (JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FRACTIONAL + (T.DecimalType,)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)

# Lehmer step (Park-Miller minimal standard): portable integer mixing that DuckDB can
# evaluate identically and that never overflows a bigint for non-negative keys.
LEHMER_MOD = 2147483647
LEHMER_MUL = 48271


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC)


def is_fractional(dt: T.DataType) -> bool:
    return isinstance(dt, FRACTIONAL)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME)


def is_complex(dt: T.DataType) -> bool:
    return isinstance(dt, COMPLEX)


def pandas_dtype(dt: T.DataType) -> str:
    """The dtype name a pandas reader would give the column (rules match substrings of it)."""
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, T.ByteType):
        return "int8"
    if isinstance(dt, T.ShortType):
        return "int16"
    if isinstance(dt, T.IntegerType):
        return "int32"
    if isinstance(dt, T.LongType):
        return "int64"
    if isinstance(dt, T.FloatType):
        return "float32"
    if isinstance(dt, (T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(dt, DATETIME):
        return "datetime64[ns]"
    if isinstance(dt, T.StringType):
        return "object"
    return dt.simpleString()


def missing(c: Column, dt: T.DataType) -> Column:
    """Missing = NULL, plus NaN for floating columns (pandas isnull semantics)."""
    if is_fractional(dt):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def as_double(c: Column, dt: T.DataType) -> Column:
    """Numeric value as double with NaN normalised to NULL (Spark's avg/max would keep NaN)."""
    d = c.cast("double")
    if is_fractional(dt):
        return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(d)
    return d


def canonical_string(c: Column, dt: T.DataType) -> Column:
    """Injective string form of a scalar value; -0.0 folds into 0.0, NaN into NULL."""
    if is_fractional(dt):
        c = F.when(F.isnan(c), F.lit(None)).when(c == 0, F.lit(0).cast(dt)).otherwise(c)
    return c.cast("string")


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson r that is NULL (not an error) for constant or empty inputs.

    Both inputs must already be NULL where the other is NULL (pairwise deletion).
    """
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def lower_contains_count(c: Column, words: Iterable[str]) -> Column:
    """Number of words that occur as a case-insensitive substring of ``c``."""
    low = F.lower(c)
    terms = [F.when(F.instr(low, w.lower()) > 0, 1).otherwise(0) for w in words]
    if not terms:
        return F.lit(0)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def lower_contains_any(c: Column, words: Iterable[str]) -> Column:
    low = F.lower(c)
    conds = [F.instr(low, w.lower()) > 0 for w in words]
    out = F.lit(False)
    for cond in conds:
        out = out | cond
    return out


def lehmer(key: Column) -> Column:
    """One Lehmer step of an integer key (a negative one by its non-negative remainder); same
    value in DuckDB SQL."""
    return (F.pmod(key, F.lit(LEHMER_MOD)) * F.lit(LEHMER_MUL)) % F.lit(LEHMER_MOD)


def lehmer_sql(key: str) -> str:
    return f"(((({key}) % {LEHMER_MOD} + {LEHMER_MOD}) % {LEHMER_MOD}) * {LEHMER_MUL}) % {LEHMER_MOD}"



def null_safe_join(left, right, keys, how: str = "inner"):
    """Equi-join on ``keys`` where NULL matches NULL; the keys of ``left`` are kept."""
    other = {k: f"__right_{i}" for i, k in enumerate(keys)}
    cond = F.lit(True)
    for k, r in other.items():
        cond = cond & F.col(k).eqNullSafe(F.col(r))
    return left.join(right.withColumnsRenamed(other), cond, how).drop(*other.values())


def attach_one_row(df, one_row):
    """Append the columns of a single-row aggregate to every row of ``df``.

    ``one_row`` is a global aggregate (exactly one row by construction), so the broadcast
    side has a proven size of one row and the output has as many rows as ``df``.
    """
    return df.join(F.broadcast(one_row), how="inner")


def epoch_micros(c: Column, dt: T.DataType) -> Column:
    """Microseconds since 1970-01-01 00:00 of a time value, independent of the session time
    zone for wall-clock types: a timestamp_ntz (or date) is read as the UTC wall clock it
    shows, from its parts; a TIMESTAMP is an instant already."""
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dt, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") * F.lit(86_400_000_000)
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    secs = F.hour(c) * 3600 + F.minute(c) * 60
    micros = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")  # seconds with fraction
    return days * F.lit(86_400_000_000) + secs.cast("long") * F.lit(1_000_000) + micros
