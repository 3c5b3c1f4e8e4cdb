"""Column operators (P1-P7): names, datetime coercion, type selection, missing and duplicate
removal, nested flattening. Decisions that depend on data (P2, column drops) come from one
aggregation pass whose result is schema-sized."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepline.functions.exprs import is_datetime, is_fractional, is_numeric, missing

# ---- fixed values: datetime formats tried, in order ----
DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy"]
# ---- end of fixed values ----


def q(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def clean_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def standardize_names(df: DataFrame) -> DataFrame:
    """Strip, lower, space and '-' to '_'; later collisions get suffixes _2, _3, ..."""
    seen: dict[str, int] = {}
    taken = set()
    out = []
    for name in df.columns:
        base = clean_name(name)
        cand = base
        if cand in taken:
            k = seen.get(base, 1)
            while True:
                k += 1
                cand = f"{base}_{k}"
                if cand not in taken:
                    break
            seen[base] = k
        taken.add(cand)
        out.append(cand)
    return df.toDF(*out)


def parse_datetime(c, formats: Sequence[str] = DATETIME_FORMATS):
    """Try each explicit format (never the format-free parser, which accepts '2020' and
    bare times); the result is a wall-clock timestamp_ntz."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def coerce_datetimes(df: DataFrame, formats: Sequence[str] = DATETIME_FORMATS, min_share: float = 1.0) -> DataFrame:
    """A string column becomes timestamp_ntz when at least ``min_share`` of its non-null
    values parse (default: all) and at least one is non-null; failures become NULL.
    The decision is one aggregation over the whole column (no head sample)."""
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strs:
        return df
    aggs = []
    for i, n in enumerate(strs):
        aggs += [F.count(q(n)).alias(f"n{i}"), F.count(parse_datetime(q(n), formats)).alias(f"p{i}")]
    row = df.agg(*aggs).first()  # 2 numbers per string column: schema-sized
    convert = {n for i, n in enumerate(strs) if row[f"n{i}"] > 0 and row[f"p{i}"] >= min_share * row[f"n{i}"]}
    return df.select(*[parse_datetime(q(c), formats).alias(c) if c in convert else q(c) for c in df.columns])


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    """Numeric (booleans excluded) / object (strings) / datetime columns."""
    if kind == "numeric":
        keep = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    elif kind == "object":
        keep = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    elif kind == "datetime":
        keep = [f.name for f in df.schema.fields if is_datetime(f.dataType)]
    else:
        raise ValueError(kind)
    return df.select(*[q(c) for c in keep])


def select_features(df: DataFrame, approved: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Keep approved (plus e.g. key/label) columns in table order, drop the rest."""
    wanted = set(approved) | set(keep)
    return df.select(*[q(c) for c in df.columns if c in wanted])


def drop_missing_rows(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None, thresh: int | None = None) -> DataFrame:
    """P5 (rows): Spark's na.drop counts NULL and NaN as missing, like pandas."""
    return df.na.drop(how=how, thresh=thresh, subset=list(subset) if subset else None)


def drop_missing_columns(df: DataFrame, max_missing_pct: float) -> DataFrame:
    """P5 (columns): drop columns whose missing share exceeds ``max_missing_pct`` percent."""
    fields = df.schema.fields
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(missing(q(f.name), f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)]).first()
    n = row["__n"] or 0
    keep = [f.name for i, f in enumerate(fields) if n == 0 or 100.0 * row[f"m{i}"] / n <= max_missing_pct]
    return df.select(*[q(c) for c in keep])


def flatten_nested(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct fields become top-level columns ``parent_child``, recursively."""

    def walk(dt: T.StructType, prefix: list[str]):
        cols = []
        for f in dt.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType):
                cols += walk(f.dataType, path)
            else:
                ref = F.col(".".join("`" + p.replace("`", "``") + "`" for p in path))
                cols.append(ref.alias(sep.join(path)))
        return cols

    return df.select(*walk(df.schema, []))


def parse_json_column(df: DataFrame, column: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parse a JSON string column into a struct (schema inferred over every value by the JSON
    source when not given), then flatten it with the other columns."""
    if schema is None:
        schema = df.sparkSession.read.json(df.select(q(column)).where(q(column).isNotNull()).rdd.map(lambda r: r[0])).schema
    parsed = df.withColumn(column, F.from_json(q(column), schema))
    return flatten_nested(parsed)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Keep one copy of each whole-row duplicate (map-side combined aggregate)."""
    return df.dropDuplicates()


def normalise_floats(df: DataFrame) -> DataFrame:
    """NaN -> NULL in floating columns (helper for operators that treat NaN as missing)."""
    return df.select(
        *[F.when(~F.isnan(q(f.name)), q(f.name)).alias(f.name) if is_fractional(f.dataType) else q(f.name) for f in df.schema.fields]
    )
