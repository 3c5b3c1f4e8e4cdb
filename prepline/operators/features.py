"""Preprocessing operators (F1-F23). Each is DataFrame -> DataFrame.

Statistics are gathered in one aggregation (a single row) and attached with a one-row
broadcast; quantiles come from the exact distributed quantile helper; per-level tables
(encoders, rare-level grouping) are joined normally, so their size is never assumed small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepline.functions.exprs import as_double, attach_one_row, is_numeric, lehmer, null_safe_join
from prepline.functions.quantiles import exact_quantiles, quantiles_wide
from prepline.session import cut_lineage


def q(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def _missing(df: DataFrame, c: str):
    from prepline.functions.exprs import missing

    return missing(q(c), df.schema[c].dataType)


def _dbl(df: DataFrame, c: str):
    return as_double(q(c), df.schema[c].dataType)


def _long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(position, v, w) distinct non-missing values with counts, for exact quantiles."""
    args = [x for i, c in enumerate(columns) for x in (F.lit(i), _dbl(df, c))]
    long = df.select(F.stack(F.lit(len(columns)), *args).alias("position", "v"))
    return long.where(F.col("v").isNotNull()).groupBy("position", "v").agg(F.count(F.lit(1)).alias("w"))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row per listed column position with one column per probability."""
    qs = exact_quantiles(_long_values(df, columns), ["position"], probs)
    return quantiles_wide(qs, ["position"], probs, names)


def _one_row(wide: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Pivot a per-position stats table into one row: <name>_<i>."""
    aggs = []
    for i, _ in enumerate(columns):
        for n in names:
            aggs.append(F.max(F.when(F.col("position") == i, F.col(n))).alias(f"__{n}_{i}"))
    return wide.agg(*aggs)


# ------------------------------------------------------------------ F3, F4, F5 missing values

def impute(df: DataFrame, columns: Sequence[str], strategy: str = "mean", fill_value=None) -> DataFrame:
    """replace NULL/NaN by the column mean, median, mode (ties to the smallest value) or a
    constant. Statistics: one aggregation (mean), exact quantiles (median), or a per-value
    count table reduced with max_by (mode) -- never one task per column of raw rows."""
    if strategy == "constant":
        return df.select(*[F.coalesce(_dbl(df, c), F.lit(fill_value)).alias(c) if c in columns else q(c) for c in df.columns])
    if strategy == "mean":
        stats = df.agg(*[F.avg(_dbl(df, c)).alias(f"__fill_{i}") for i, c in enumerate(columns)])
    elif strategy == "median":
        stats = _one_row(column_quantiles(df, columns, [0.5], ["med"]), columns, ["med"]).select(
            *[F.col(f"__med_{i}").alias(f"__fill_{i}") for i in range(len(columns))]
        )
    elif strategy == "mode":
        parts = []
        for i, c in enumerate(columns):
            counts = df.where(~_missing(df, c)).groupBy(q(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            # highest count, ties to the smallest value
            parts.append(counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(f"__fill_{i}")))
        stats = parts[0]
        for p in parts[1:]:
            stats = attach_one_row(stats, p)
    else:
        raise ValueError(strategy)
    joined = attach_one_row(df, stats)
    out = []
    for c in df.columns:
        if c in columns:
            i = list(columns).index(c)
            v = _dbl(df, c) if strategy != "mode" or is_numeric(df.schema[c].dataType) else q(c)
            out.append(F.coalesce(v, F.col(f"__fill_{i}")).alias(c))
        else:
            out.append(q(c))
    return joined.select(*out)


def missing_indicator(df: DataFrame, columns: Sequence[str], suffix: str = "_missing") -> DataFrame:
    """0/1 column per listed column (NULL or NaN)."""
    from prepline.functions.exprs import missing

    return df.select("*", *[missing(q(c), df.schema[c].dataType).cast("int").alias(c + suffix) for c in columns])


def impute_time(df: DataFrame, ts: str, y: str, by: Sequence[str] = (), method: str = "ffill") -> DataFrame:
    """series imputation ordered by ``ts`` within ``by``. ffill = last non-null before;
    linear = interpolate on epoch microseconds between the previous and next non-null values.
    Uses partition-carried fills (no window holding a whole series)."""
    from prepline.functions.ordering import last_non_null

    if method == "ffill":
        return last_non_null(df, by, ts, y, "__f").withColumn(y, F.col("__f")).drop("__f")
    from prepline.functions.exprs import epoch_micros

    t = epoch_micros(F.col(ts), df.schema[ts].dataType).cast("double")
    base = df.withColumn("__t", t).withColumn("__negt", -F.col("__t"))
    prev = last_non_null(base, by, "__t", y, "__pv", "__pt")
    nxt = last_non_null(prev, by, "__negt", y, "__nv", "__nnt").withColumn("__nt", -F.col("__nnt"))
    interp = F.col("__pv") + (F.col("__nv") - F.col("__pv")) * F.try_divide(F.col("__t") - F.col("__pt"), F.col("__nt") - F.col("__pt"))
    filled = F.when(q(y).isNotNull(), q(y)).when(F.col("__nt") == F.col("__pt"), F.col("__pv")).otherwise(interp)
    return nxt.withColumn(y, filled).drop("__t", "__negt", "__pv", "__pt", "__nv", "__nnt", "__nt")


# ------------------------------------------------------------------ F6, F7, F8 scaling

def scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """standard (population std, as scikit-learn), minmax, maxabs, robust (median/IQR).
    A zero spread leaves the centred value 0 (scikit-learn's convention)."""
    if method == "robust":
        qs = column_quantiles(df, columns, [0.25, 0.5, 0.75], ["q1", "med", "q3"])
        stats = _one_row(qs, columns, ["q1", "med", "q3"])
    else:
        aggs = []
        for i, c in enumerate(columns):
            v = _dbl(df, c)
            aggs += [F.avg(v).alias(f"__mean_{i}"), F.stddev_pop(v).alias(f"__sd_{i}"), F.min(v).alias(f"__min_{i}"), F.max(v).alias(f"__max_{i}"), F.max(F.abs(v)).alias(f"__abs_{i}")]
        stats = df.agg(*aggs)
    joined = attach_one_row(df, stats)
    out = []
    for c in df.columns:
        if c not in columns:
            out.append(q(c))
            continue
        i = list(columns).index(c)
        v = _dbl(df, c)
        if method == "standard":
            center, spread = F.col(f"__mean_{i}"), F.col(f"__sd_{i}")
        elif method == "minmax":
            center, spread = F.col(f"__min_{i}"), F.col(f"__max_{i}") - F.col(f"__min_{i}")
        elif method == "maxabs":
            center, spread = F.lit(0.0), F.col(f"__abs_{i}")
        elif method == "robust":
            center, spread = F.col(f"__med_{i}"), F.col(f"__q3_{i}") - F.col(f"__q1_{i}")
        else:
            raise ValueError(method)
        out.append(F.when(spread == 0, F.when(v.isNotNull(), F.lit(0.0))).otherwise((v - center) / spread).alias(c))
    return joined.select(*out)


def normalize_rows(df: DataFrame, columns: Sequence[str], norm: str = "l2") -> DataFrame:
    """divide each listed value by the row's l1 / l2 / max norm (zero rows stay zero)."""
    vals = [F.coalesce(_dbl(df, c), F.lit(0.0)) for c in columns]
    if norm == "l1":
        n = sum((F.abs(v) for v in vals[1:]), F.abs(vals[0]))
    elif norm == "l2":
        n = F.sqrt(sum((v * v for v in vals[1:]), vals[0] * vals[0]))
    elif norm == "max":
        n = F.greatest(*[F.abs(v) for v in vals]) if len(vals) > 1 else F.abs(vals[0])
    else:
        raise ValueError(norm)
    return df.select(*[F.when(n == 0, _dbl(df, c)).otherwise(_dbl(df, c) / n).alias(c) if c in columns else q(c) for c in df.columns])


def transform(df: DataFrame, columns: Sequence[str], fn: str = "log1p") -> DataFrame:
    """F8: log1p, sqrt (NULL for negatives), or rank (average rank / n, distributed)."""
    if fn == "rank":
        from prepline.operators.profile import rank_transform

        n = df.agg(F.count(F.lit(1)).alias("__n"))
        ranked = attach_one_row(rank_transform(df, columns), n)
        return ranked.select(*[(F.col(c) / F.col("__n")).alias(c) if c in columns else q(c) for c in df.columns])
    f = {"log1p": lambda v: F.when(v > -1, F.log1p(v)), "sqrt": lambda v: F.when(v >= 0, F.sqrt(v))}[fn]
    return df.select(*[f(_dbl(df, c)).alias(c) if c in columns else q(c) for c in df.columns])


# ------------------------------------------------------------------ F9-F13 encoders

def encode_ordinal(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """dense 0-based code by sorted distinct value (NULL stays NULL). Codes come from the
    distinct-value table with a distributed running count."""
    from prepline.functions.ordering import running_before

    levels = df.where(q(column).isNotNull()).select(q(column).alias("__lvl")).distinct().withColumn("__one", F.lit(1))
    codes = running_before(levels, [], "__lvl", "__one", out="__code").select("__lvl", "__code")
    return df.join(codes, q(column) == F.col("__lvl"), "left").drop("__lvl").withColumnRenamed("__code", out or f"{column}_code")


def encode_frequency(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """share of rows holding the level (NULL is its own level)."""
    counts = df.groupBy(q(column).alias("__lvl")).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__tot"))
    freq = attach_one_row(counts, total).select("__lvl", (F.col("__n") / F.col("__tot")).alias(out or f"{column}_freq"))
    return df.join(freq, q(column).eqNullSafe(F.col("__lvl")), "left").drop("__lvl")


def encode_one_hot(df: DataFrame, column: str, levels: Sequence[str] | None = None, prefix: str | None = None, max_levels: int = 1000) -> DataFrame:
    """one 0/1 column per level, none dropped. The levels become column names, so they
    are listed first -- at most ``max_levels`` + 1 are fetched, and more levels than that is an
    error: :func:`encode_one_hot_sparse` takes any number of levels."""
    if levels is None:
        got = [r[0] for r in df.where(q(column).isNotNull()).select(q(column)).distinct().orderBy(q(column)).limit(max_levels + 1).collect()]
        if len(got) > max_levels:
            raise ValueError(f"{column} has more than {max_levels} levels; encode_one_hot_sparse has no such limit")
        levels = got
    pre = prefix or column
    return df.select("*", *[(q(column) == F.lit(lv)).cast("int").alias(f"{pre}_{lv}") for lv in levels])


def encode_one_hot_sparse(df: DataFrame, key: str, column: str) -> DataFrame:
    """F10 for any number of levels: the ones of the indicator matrix as rows (key, level_index, level),
    levels numbered from 0 in sorted order; a NULL level has none. Levels stay a distributed
    table, numbered by a running count; a level with a third of the rows is joined by AQE's skew split."""
    codes = encode_ordinal(df.where(q(column).isNotNull()).select(q(key), q(column).alias("level")), "level", "level_index")
    return codes.select(q(key), "level_index", "level")


def encode_target(df: DataFrame, column: str, target: str, smoothing: float = 10.0, folds: int | None = None, key: str | None = None) -> DataFrame:
    """smoothed mean of the target per level: (sum + m * prior) / (n + m). With ``folds``
    (and an integer ``key``) each row is encoded from the other folds only."""
    y = _dbl(df, target)
    if not folds:
        stats = df.groupBy(q(column).alias("__lvl")).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
        prior = df.agg(F.avg(y).alias("__prior"))
        enc = attach_one_row(stats, prior).select(
            "__lvl", ((F.col("__s") + smoothing * F.col("__prior")) / (F.col("__n") + smoothing)).alias(f"{column}_te")
        )
        return df.join(enc, q(column).eqNullSafe(F.col("__lvl")), "left").drop("__lvl")
    d = df.withColumn("__fold", lehmer(q(key)) % folds).withColumn("__lvl", q(column))
    per = d.groupBy("__lvl", "__fold").agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    tot = per.groupBy("__lvl").agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn"))
    fold_tot = d.groupBy("__fold").agg(F.sum(y).alias("__fs"), F.count(y).alias("__fn"))  # `folds` rows
    grand = d.agg(F.sum(y).alias("__gs"), F.count(y).alias("__gn"))
    enc = attach_one_row(null_safe_join(null_safe_join(per, tot, ["__lvl"]), fold_tot, ["__fold"]), grand).select(
        "__lvl",
        "__fold",
        (
            (F.col("__ts") - F.col("__s") + smoothing * ((F.col("__gs") - F.col("__fs")) / (F.col("__gn") - F.col("__fn"))))
            / (F.col("__tn") - F.col("__n") + smoothing)
        ).alias(f"{column}_te"),
    )
    return null_safe_join(d, enc, ["__lvl", "__fold"], "left").drop("__lvl", "__fold")


def bin_width(df: DataFrame, column: str, bins: int, out: str | None = None) -> DataFrame:
    """equal-width bins over [min, max]; the maximum falls in the last bin (0-based)."""
    v = _dbl(df, column)
    mm = df.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((v - F.col("__lo")) / width), F.lit(bins - 1)))
    return attach_one_row(df, mm).withColumn(out or f"{column}_bin", b.cast("int")).drop("__lo", "__hi")


def bin_quantile(df: DataFrame, column: str, bins: int, out: str | None = None) -> DataFrame:
    """bin = number of interior exact quantile edges (k/bins) the value is >= ... i.e.
    the value's bucket among equal-frequency edges; edges from exact quantiles."""
    probs = [k / bins for k in range(1, bins)]
    names = [f"e{k}" for k in range(1, bins)]
    edges = _one_row(column_quantiles(df, [column], probs, names), [column], names)
    v = _dbl(df, column)
    b = sum((F.when(v >= F.col(f"__{n}_0"), 1).otherwise(0) for n in names[1:]), F.when(v >= F.col(f"__{names[0]}_0"), 1).otherwise(0))
    return attach_one_row(df, edges).withColumn(out or f"{column}_bin", F.when(v.isNotNull(), b)).drop(*[f"__{n}_0" for n in names])


def bin_custom(df: DataFrame, column: str, edges: Sequence[float], out: str | None = None) -> DataFrame:
    """bin = number of given edges <= value (so edges split the line into len+1 bins)."""
    v = _dbl(df, column)
    b = sum((F.when(v >= F.lit(e), 1).otherwise(0) for e in edges[1:]), F.when(v >= F.lit(edges[0]), 1).otherwise(0))
    return df.withColumn(out or f"{column}_bin", F.when(v.isNotNull(), b))


def group_rare(df: DataFrame, column: str, threshold: float, other: str = "other") -> DataFrame:
    """levels holding less than ``threshold`` of the rows become ``other``."""
    counts = df.groupBy(q(column).alias("__lvl")).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__tot"))
    rare = attach_one_row(counts, total).where(F.col("__n") < threshold * F.col("__tot")).select("__lvl", F.lit(True).alias("__rare"))
    j = df.join(rare, q(column) == F.col("__lvl"), "left")
    return j.withColumn(column, F.when(F.col("__rare"), F.lit(other)).otherwise(q(column))).drop("__lvl", "__rare")


# ------------------------------------------------------------------ F14-F16 dates and text

def date_features(df: DataFrame, column: str) -> DataFrame:
    """year, month, day, weekday (0 = Monday), hour, quarter, is_weekend."""
    c = q(column)
    return df.select(
        "*",
        F.year(c).alias(f"{column}_year"),
        F.month(c).alias(f"{column}_month"),
        F.dayofmonth(c).alias(f"{column}_day"),
        F.weekday(c).alias(f"{column}_weekday"),
        F.hour(c).alias(f"{column}_hour"),
        F.quarter(c).alias(f"{column}_quarter"),
        (F.weekday(c) >= 5).alias(f"{column}_is_weekend"),
    )


def date_format(df: DataFrame, column: str, fmt: str = "yyyy-MM-dd", out: str | None = None) -> DataFrame:
    """format a timestamp as text."""
    return df.withColumn(out or f"{column}_text", F.date_format(q(column), fmt))


def convert_tz(df: DataFrame, column: str, source_tz: str, target_tz: str, out: str | None = None) -> DataFrame:
    """reinterpret a wall-clock timestamp from one zone to another."""
    return df.withColumn(out or f"{column}_{target_tz.replace('/', '_')}", F.convert_timezone(F.lit(source_tz), F.lit(target_tz), q(column).cast("timestamp_ntz")))


TOKEN_PATTERN = "[^\\p{L}\\p{N}_]+"


def tokenize(df: DataFrame, column: str, out: str = "tokens") -> DataFrame:
    """F16: lower-case, split on runs of non-word characters, drop empty tokens."""
    toks = F.split(F.lower(q(column)), TOKEN_PATTERN)
    return df.withColumn(out, F.filter(toks, lambda t: t != ""))


#: repeated keys, or terms, up to this many are broadcast (their number is checked); more are shuffled
BROADCAST_ROWS = 200_000


def _by_repeats(df: DataFrame, key: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows whose key no other row has, rows whose key is repeated); None: no such part to look at. Where more
    than ``BROADCAST_ROWS`` keys are repeated, all rows count as such."""
    again = df.groupBy(q(key).alias("__k")).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").select("__k")
    n = again.limit(BROADCAST_ROWS + 1).count()
    if n == 0:
        return df, None
    if n > BROADCAST_ROWS:
        return None, df
    some, same = F.broadcast(again), q(key).eqNullSafe(F.col("__k"))
    return df.join(some, same, "left_anti"), df.join(some, same, "left_semi")


def _counts_of_rows(toks: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) of rows (key, __t) with a key of their own: each row's tokens are sorted and the lengths
    of the runs of equal ones taken, so no pair is shuffled. The outer generator keeps Spark from making the
    array once more for a filter on its size."""
    runs = toks.select(q(key), F.sort_array("__t").alias("__s"))
    runs = runs.select("*", F.transform("__s", lambda x, i: F.when((i == 0) | (F.get("__s", i - 1) != x), i)).alias("__at"))
    runs = runs.select(q(key), "__s", F.filter("__at", lambda i: i.isNotNull()).alias("__at"))
    pairs = F.transform(
        "__at", lambda i, j: F.struct(F.get("__s", i).alias("term"), (F.coalesce(F.get("__at", j + 1), F.size("__s")) - i).cast("long").alias("tf"))
    )
    return runs.select(q(key), F.inline_outer(pairs)).where("term is not null")


def _counts_of_keys(toks: DataFrame, key: str) -> DataFrame:
    rows = toks.select(q(key), F.explode_outer("__t").alias("term")).where("term is not null")
    return rows.groupBy(q(key), "term").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(df: DataFrame, key: str, column: str) -> DataFrame:
    """F17 (counts): long form (key, term, tf). Rows that share their key with another meet in a groupBy with
    map-side combine, all others are counted by themselves."""
    return _term_counts(*_by_repeats(df.select(q(key), q(column)), key), key, column)


def _term_counts(once: DataFrame | None, again: DataFrame | None, key: str, column: str) -> DataFrame:
    parts = [count(tokenize(d, column, "__t"), key) for d, count in ((once, _counts_of_rows), (again, _counts_of_keys)) if d is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def tfidf(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, term, tf, df, idf, tfidf) with smooth idf = ln((1 + n) / (1 + df)) + 1.
    Document frequency is a groupBy over the distinct terms of each key -- a hot term is one row per task; it
    is made first, and meets the counts by a broadcast as long as it has at most ``BROADCAST_ROWS`` terms."""
    once, again = _by_repeats(df.select(q(key), q(column)), key)
    seen = []
    if once is not None:
        seen.append(tokenize(once, column, "__t").select(F.explode_outer(F.array_distinct("__t")).alias("term")).where("term is not null"))
    if again is not None:
        seen.append(_counts_of_keys(tokenize(again, column, "__t"), key).select("term"))
    terms = seen[0] if len(seen) == 1 else seen[0].unionByName(seen[1])
    n_docs = df.agg(F.count(F.lit(1)).alias("__n"))
    dfreq = cut_lineage(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = attach_one_row(dfreq, n_docs).select("term", "df", (F.log((1 + F.col("__n")) / (1 + F.col("df"))) + 1).alias("idf"))
    if dfreq.count() <= BROADCAST_ROWS:
        idf = F.broadcast(idf)
    return _term_counts(once, again, key, column).join(idf, "term").select(q(key), "term", "tf", "df", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


# ------------------------------------------------------------------ F18-F23

def treat_outliers(df: DataFrame, columns: Sequence[str], action: str = "clip", method: str = "iqr", lower_p: float = 0.01, upper_p: float = 0.99) -> DataFrame:
    """IQR fences or percentile bounds; clip to bounds, set outliers NULL, or drop rows."""
    if method == "iqr":
        qs = column_quantiles(df, columns, [0.25, 0.75], ["q1", "q3"])
        b = qs.select("position", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi"))
    else:
        b = column_quantiles(df, columns, [lower_p, upper_p], ["lo", "hi"])
    bounds = _one_row(b, columns, ["lo", "hi"])
    j = attach_one_row(df, bounds)
    cond = None
    out = []
    for c in df.columns:
        if c not in columns:
            out.append(q(c))
            continue
        i = list(columns).index(c)
        v, lo, hi = _dbl(df, c), F.col(f"__lo_{i}"), F.col(f"__hi_{i}")
        bad = (v < lo) | (v > hi)
        cond = bad if cond is None else (cond | bad)
        if action == "clip":
            out.append(F.least(F.greatest(v, lo), hi).alias(c))
        elif action == "null":
            out.append(F.when(bad, F.lit(None)).otherwise(v).alias(c))
        else:
            out.append(q(c))
    if action == "drop":
        j = j.where(~F.coalesce(cond, F.lit(False)))
    return j.select(*out)


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """product columns a_x_b."""
    return df.select("*", *[(_dbl(df, a) * _dbl(df, b)).alias(f"{a}_x_{b}") for a, b in pairs])


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """all monomials of total degree 2..degree over the listed columns."""
    from itertools import combinations_with_replacement

    extra = []
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(columns, d):
            e = _dbl(df, combo[0])
            for c in combo[1:]:
                e = e * _dbl(df, c)
            extra.append(e.alias("_".join(combo) + f"_p{d}"))
    return df.select("*", *extra)


def collinear_drops(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """F21 (decision): (column_name, partner, r) -- for each pair with |r| > threshold the later
    column (by position) is dropped."""
    from prepline.operators.profile import correlation_matrix

    cm = correlation_matrix(df, "pearson", columns)
    return cm.where(F.abs("r") > threshold).groupBy(F.col("col_b").alias("column_name")).agg(
        F.min_by("col_a", F.abs("r")).alias("partner"), F.max(F.abs("r")).alias("abs_r")
    )


def drop_collinear(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """drop the later column of every highly correlated pair (names collected: schema-sized)."""
    drops = {r["column_name"] for r in collinear_drops(df, columns, threshold).select("column_name").collect()}
    return df.select(*[q(c) for c in df.columns if c not in drops])


def select_by_variance(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """keep listed columns whose sample variance exceeds ``threshold`` (others untouched)."""
    row = df.agg(*[F.var_samp(_dbl(df, c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    drop = {c for i, c in enumerate(columns) if row[f"v{i}"] is None or row[f"v{i}"] <= threshold}
    return df.select(*[q(c) for c in df.columns if c not in drop])


def univariate_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """|Pearson r| of each feature with the target, ranked (model-free selection)."""
    from prepline.operators.profile import correlation_with_target

    sub = df.select(*[q(c) for c in list(columns) + [target]])
    r = correlation_with_target(sub, target, 0.7)
    w = Window.orderBy(F.desc(F.abs("corr")), "column_name")  # one row per column: schema-sized
    return r.select("column_name", "corr", F.row_number().over(w).alias("rank"))


def train_test_split(df: DataFrame, key: str, test_fraction: float = 0.2, buckets: int = 1000) -> DataFrame:
    """deterministic split by a portable hash of an integer key: test when
    lehmer(key) % buckets < fraction * buckets."""
    cut = int(round(test_fraction * buckets))
    return df.withColumn("split", F.when(lehmer(q(key)) % buckets < cut, F.lit("test")).otherwise(F.lit("train")))


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = 0.2, buckets: int = 1000) -> DataFrame:
    """F23 (stratified): within each class, rows are ordered by the portable hash of the key
    and the first round(fraction * class size) become test. The order is a distributed
    running count per class over (hash, key), never a window holding a whole class."""
    from prepline.functions.ordering import running_before

    h = df.withColumn("__h", lehmer(q(key))).withColumn("__one", F.lit(1))
    sizes = df.groupBy(q(label).alias("__lbl")).agg(F.count(F.lit(1)).alias("__size"))
    ordered = h.withColumn("__ord", F.struct("__h", q(key)))
    ranked = running_before(ordered.withColumn("__lbl", q(label)), ["__lbl"], "__ord", "__one", out="__pos")
    j = null_safe_join(ranked, sizes, ["__lbl"])
    out = j.withColumn("split", F.when(F.col("__pos") < F.round(F.col("__size") * test_fraction), "test").otherwise("train"))
    return out.drop("__h", "__one", "__ord", "__lbl", "__pos", "__size")
