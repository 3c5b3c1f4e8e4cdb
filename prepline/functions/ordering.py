"""Running sums over a global order without a single-partition window.

``Window.orderBy(x)`` with no partition moves every row into one task. Here the rows are
range-partitioned instead; each partition's total is a tiny table whose prefix sums give
the offset of every partition, and the final window runs inside one partition at a time.
The range-partitioned frame is checkpointed (reliable storage) so both uses see the same
partitioning even after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepline.functions.exprs import null_safe_join
from prepline.session import cut_lineage


def running_before(df: DataFrame, keys: Sequence[str], order: str, weight: str, out: str = "before") -> DataFrame:
    """Add ``out`` = sum of ``weight`` over rows of the same ``keys`` with a smaller ``order``.

    Rows should be distinct on (keys, order) -- aggregate duplicates into ``weight`` first,
    so a hot value is a single row. Ties therefore never straddle partitions.
    """
    keys = list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], F.col(order)).withColumn("_pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    totals = ranged.groupBy("_pid", *keys).agg(F.sum(weight).alias("_t"))  # <= partitions + keys rows
    w_part = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(w_part), F.lit(0))).drop("_t")
    w_row = Window.partitionBy("_pid", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        null_safe_join(ranged, offsets, ["_pid", *keys])
        .withColumn(out, F.col("_off") + F.coalesce(F.sum(weight).over(w_row), F.lit(0)))
        .drop("_pid", "_off")
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """(keys, value, n, rank): average 1-based rank of each distinct value (pandas 'average')."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_before(counts, keys, value, "n")
    return ranked.select(*keys, value, "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias(out))


def _ranged(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(parts, *[F.col(k) for k in keys], F.col(order)).withColumn("_pid", F.spark_partition_id())
    return cut_lineage(r)


def previous_values(df: DataFrame, keys: Sequence[str], order: str, value: str, k: int, out: str = "prev") -> DataFrame:
    """Add ``out`` = array of up to k previous values of ``value`` in the same ``keys``, by
    ``order`` (oldest first; the last element is lag 1).

    A hot series is split across range partitions; each partition computes its own lags and
    receives the last k values of the series from earlier partitions through a small
    (partition x key) tail table, so no task ever holds more than one partition.
    """
    keys = list(keys)
    r = _ranged(df, keys, order)
    w = Window.partitionBy("_pid", *keys).orderBy(order)
    # collect structs, not values: collect_list skips NULLs, which would shift the lags
    inpart = r.withColumn("_in", F.transform(F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(-k, -1)), lambda e: e["v"]))
    w_desc = Window.partitionBy("_pid", *keys).orderBy(F.col(order).desc())
    tails = (
        r.withColumn("_rd", F.row_number().over(w_desc))
        .where(F.col("_rd") <= k)
        .groupBy("_pid", *keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"]).alias("_tail"))
    )
    w_key = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.withColumn("_carry", F.flatten(F.collect_list("_tail").over(w_key))).select("_pid", *keys, "_carry")
    carry = carry.withColumn("_carry", F.when(F.size("_carry") > k, F.slice("_carry", -k, k)).otherwise(F.col("_carry")))
    j = null_safe_join(inpart, carry, ["_pid", *keys], "left")
    full = F.concat(F.coalesce(F.col("_carry"), F.array().cast(j.schema["_in"].dataType)), F.col("_in"))
    return j.withColumn(out, F.when(F.size(full) > k, F.slice(full, -k, k)).otherwise(full)).drop("_pid", "_in", "_carry")


def next_values(df: DataFrame, keys: Sequence[str], order: str, value: str, k: int, out: str = "next") -> DataFrame:
    """Like :func:`previous_values` but the following k values (nearest first)."""
    dt = df.schema[order].dataType
    from prepline.functions.exprs import epoch_micros

    key = epoch_micros(F.col(order), dt) if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(order)
    neg = df.withColumn("_neg_order", -key.cast("double"))
    res = previous_values(neg, keys, "_neg_order", value, k, out="_nx")
    return res.withColumn(out, F.reverse("_nx")).drop("_nx", "_neg_order")


#: passes at most that bring composed states to those of single steps
POLISH = 8


def _scan(A, c, first):
    """Inclusive prefix products of affine maps s -> A s + c within segments (``first`` marks their first
    rows): doubling steps over whole arrays."""
    import numpy as np

    A, c, whole = A.copy(), c.copy(), first.copy()
    whole[:1] = True
    step = 1
    while not whole.all():
        at = np.flatnonzero(~whole)
        before = at - step
        c_new = np.einsum("nij,nj->ni", A[at], c[before]) + c[at]
        A_new, whole_new = A[at] @ A[before], whole[before]
        A[at], c[at], whole[at] = A_new, c_new, whole_new
        step *= 2
    return A, c


def affine_scan(df: DataFrame, keys: Sequence[str], order: str, value: str, step, gain, missing_step, init, state_names: Sequence[str]) -> DataFrame:
    """Run a per-series linear recurrence s_t = ``step`` s_(t-1) + ``gain`` y_t over a global order;
    where y is missing (NULL or NaN), s_t = ``missing_step`` s_(t-1).

    ``init(y1, y2)`` gives the state before the series' first known value from its first two
    (y2 None if there is one only); rows before it have no state (NULL). Rows are range-partitioned by
    series and ``order`` (ties by value); tasks stream over Arrow batches and compose all maps of a batch at
    once in numpy. Only the first and the last series of a partition can go on in another one: their
    composed maps, at most two rows per partition, are chained on the driver, and a second pass
    replays each partition from its exact entry states. A NULL key is a series of its own. Output adds,
    per state name, the state after the row and ``prior_<name>`` before it, and ``is_first`` for the
    first known row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    keys, names = list(keys), list(state_names)
    d = len(names)
    M, g, N, eye = np.array(step, float).reshape(d, d), np.array(gain, float).reshape(d), np.array(missing_step, float).reshape(d, d), np.eye(d)
    said = [F.when(F.col(k).isNull(), "-").otherwise(F.concat(F.octet_length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string"))) for k in keys]
    src = df.select(*keys, order, F.col(value).cast("double").alias(value)).withColumn("_series", F.concat(*said) if said else F.lit(""))
    sort = ["_series", order, value]
    r = cut_lineage(src.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_pid", F.spark_partition_id()))

    def maps(b, last_series):
        """Per row: first of its series (within the partition), known, and its map."""
        series, y = b.column("_series"), b.column(value)
        first = np.ones(b.num_rows, bool)
        if b.num_rows > 1:
            first[1:] = pc.not_equal(series.slice(1), series.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        first[0] = series[0].as_py() != last_series
        y = pc.fill_null(y, float("nan")).to_numpy(zero_copy_only=False)
        known = ~np.isnan(y)
        A = np.where(known[:, None, None], M, N)
        c = np.where(known[:, None], np.nan_to_num(y)[:, None] * g, 0.0)
        return first, known, y, A, c

    def begun(first, known, before):
        """Whether a known value of the series is at or before each row, given it for the row before the batch."""
        n = len(first)
        start = np.maximum.accumulate(np.where(first, np.arange(n), -1))
        seen = np.maximum.accumulate(np.where(known, np.arange(n), -1))
        return (seen >= np.maximum(start, 0)) | ((start < 0) & before)

    # pass 1: the composed maps of each partition's first and last series, if the series had begun
    # before the partition (all rows) and if not (from its first known value on)
    def summarize(batches):
        done, cur = [], None  # cur: series, map if begun, map if not, known values (two at most)
        pid = None
        for b in batches:
            if not b.num_rows:
                continue
            pid = b.column("_pid")[0].as_py()
            first, known, y, A, c = maps(b, cur["series"] if cur else None)
            start = begun(first, known, bool(cur and cur["known"]))
            Aa, ca = _scan(A, c, first)
            An, cn = _scan(np.where(start[:, None, None], A, eye), np.where(start[:, None], c, 0.0), first)
            ends = np.flatnonzero(np.append(first[1:], True))
            starts = np.concatenate([[0], ends[:-1] + 1])
            # in between, only the runs at the batch's ends can matter
            for s, e in zip(starts, ends, strict=True):
                if first[s] and cur is not None:
                    done = done[:1] + [cur] if done else [cur]
                if first[s]:
                    cur = {"series": b.column("_series")[int(s)].as_py(), "all": (eye, np.zeros(d)), "new": (eye, np.zeros(d)), "known": []}
                for name, (P, q) in (("all", (Aa[e], ca[e])), ("new", (An[e], cn[e]))):
                    P0, q0 = cur[name]
                    cur[name] = (P @ P0, P @ q0 + q)
                if len(cur["known"]) < 2:
                    cur["known"] += y[s : e + 1][known[s : e + 1]][:2].tolist()
        if cur is not None:
            done = done[:1] + [cur] if done else [cur]
            rows = [(pid, k, x["series"], *(v.ravel().tolist() for n in ("all", "new") for v in x[n]), x["known"][:2]) for k, x in enumerate(done)]
            yield pa.RecordBatch.from_pylist([dict(zip(fields, row, strict=True)) for row in rows], schema)

    fields = ["pid", "k", "series", "A", "c", "A_new", "c_new", "known"]
    floats = pa.list_(pa.float64())
    schema = pa.schema([("pid", pa.int32()), ("k", pa.int32()), ("series", pa.string()), *((f, floats) for f in fields[3:])])
    ddl = "pid int, k int, series string, " + ", ".join(f"{f} array<double>" for f in fields[3:])
    ends = sorted(r.select("_series", value, "_pid").mapInArrow(summarize, ddl).collect(), key=lambda x: (x["pid"], x["k"]))  # two rows per partition

    # pass 2: chain them; an entry is (begun before?, state there) by partition and run
    entry: dict[tuple[int, int], tuple[bool, list[float]]] = {}
    i = 0
    while i < len(ends):
        j = i
        while j < len(ends) and ends[j]["series"] == ends[i]["series"]:
            j += 1
        values = [v for x in ends[i:j] for v in x["known"]][:2]
        state, on = np.array(init(values[0], values[1] if len(values) > 1 else None), float) if values else np.zeros(d), False
        for x in ends[i:j]:
            entry[x["pid"], x["k"]] = (on, state.tolist())
            A, c = (x["A"], x["c"]) if on else (x["A_new"], x["c_new"])
            state, on = np.array(A).reshape(d, d) @ state + np.array(c), on or bool(x["known"])
        i = j
    n_runs = {pid: k + 1 for pid, k in entry}

    # pass 3: replay; the series between a partition's first and last begin and end in it
    kept = [*keys, order, value]

    def replay(batches):
        last, run_no, before, state = None, -1, False, np.zeros(d)
        held: list = []  # of a series whose second known value may come in a later batch

        def emit(b, last, run_no, before, state):
            first, known, y, A, c = maps(b, last)
            n = b.num_rows
            pid = b.column("_pid")[0].as_py()
            # entry states of the series that begin in this batch, put in front of their first row
            heads = np.flatnonzero(first)
            ends_at = np.append(heads[1:], n)[: len(heads)]
            s0, on = np.zeros((n, d)), np.zeros(n, bool)
            for s, e in zip(heads.tolist(), ends_at.tolist(), strict=True):
                run_no += 1
                at_end = run_no and e == n and is_last_run(b, s, pid)
                if run_no == 0 or at_end:
                    on[s], s0[s] = entry[pid, 0 if run_no == 0 else 1]
                else:
                    vals = y[s:e][known[s:e]][:2].tolist()
                    if vals:
                        s0[s] = init(vals[0], vals[1] if len(vals) > 1 else None)
            start = begun(first, known, before)
            # a series that had begun earlier has begun on all its rows
            carried = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            start |= np.where(np.maximum.accumulate(first), on[carried], before)
            A = np.where(start[:, None, None], A, eye)
            c = np.where(start[:, None], c, 0.0)
            P, q = _scan(A, c, first)
            origin = np.where(np.maximum.accumulate(first)[:, None], s0[carried], state[None, :])
            after = np.einsum("nij,nj->ni", P, origin) + q
            # composed maps round differently from step after step; taking each step once more from the
            # states found shrinks that difference, until nothing changes
            for _ in range(POLISH):
                prior = np.vstack([state[None, :], after[:-1]])
                prior[first] = s0[first]
                stepped = np.einsum("nij,nj->ni", A, prior) + c
                if np.array_equal(stepped, after):
                    break
                after = stepped
            begun_before = np.concatenate([[before], start[:-1]])
            begun_before[first] = on[first]
            is_first = known & ~begun_before
            out = [b.column(k) for k in kept] + [pa.array(is_first)]
            for k in range(d):
                out += [pa.array(after[:, k], mask=~start), pa.array(prior[:, k], mask=~start)]
            return pa.RecordBatch.from_arrays(out, names=out_names), b.column("_series")[n - 1].as_py(), run_no, bool(start[-1]), after[-1]

        def is_last_run(b, s, pid):
            return n_runs[pid] > 1 and b.column("_series")[s].as_py() == last_series[pid]

        for b in batches:
            if not b.num_rows:
                continue
            # a batch is cut in front of its last series, which waits for the next batch, unless it is the partition's first or last one
            if held:
                b = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
                held = []
            pid, tail = b.column("_pid")[0].as_py(), b.column("_series")[b.num_rows - 1].as_py()
            if tail not in (first_series[pid], last_series[pid]):
                at = pc.index(b.column("_series"), tail).as_py()
                held, b = [b.slice(at)], b.slice(0, at)
            if b.num_rows:
                out, last, run_no, before, state = emit(b, last, run_no, before, state)
                yield out
        for b in held:
            yield emit(b, last, run_no, before, state)[0]

    first_series = {x["pid"]: x["series"] for x in reversed(ends)}
    last_series = {x["pid"]: x["series"] for x in ends}
    out_schema = T.StructType([*(r.schema[k] for k in kept)]).add("is_first", T.BooleanType())
    for n in names:
        out_schema = out_schema.add(n, T.DoubleType()).add(f"prior_{n}", T.DoubleType())
    out_names = [f.name for f in out_schema.fields]
    return r.mapInArrow(replay, out_schema)


def last_non_null(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, out_order: str | None = None) -> DataFrame:
    """Add ``out`` = the last non-null ``value`` at or before each row within ``keys`` by
    ``order`` (and optionally ``out_order`` = that row's order value). Within a range
    partition a window finds it; a row whose series had no value yet in this partition takes
    the last non-null of the series from earlier partitions (a tail table with one row per
    (partition, key)), so no task holds a whole series."""
    keys = list(keys)
    r = _ranged(df, keys, order)
    w = Window.partitionBy("_pid", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known_o = F.when(F.col(value).isNotNull(), F.col(order))
    inpart = r.withColumn("_lv", F.last(value, ignorenulls=True).over(w)).withColumn("_lo", F.last(known_o, ignorenulls=True).over(w))
    # one row per (partition, key) present -- also where all its values are NULL, so a carry
    # can pass through such a partition -- holding its last non-null (value, order) if any
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(order).alias("o")))
    tails = r.groupBy("_pid", *keys).agg(F.max_by(known, F.when(F.col(value).isNotNull(), F.col(order))).alias("_t"))
    w_key = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.withColumn("_c", F.last("_t", ignorenulls=True).over(w_key)).select("_pid", *keys, "_c")
    j = null_safe_join(inpart, carry, ["_pid", *keys], "left")
    j = j.withColumn(out, F.coalesce(F.col("_lv"), F.col("_c.v")))
    if out_order:
        j = j.withColumn(out_order, F.coalesce(F.col("_lo"), F.col("_c.o")))
    return j.drop("_pid", "_lv", "_lo", "_c")
