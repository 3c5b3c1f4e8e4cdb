"""DuckDB SQL text for the oracle side of the registered queries.

The oracle must compute the same answer independently of Spark, so the SQL below is
written per operator from the same rules; this module only repeats the per-column parts
over a fixed list of the driver tables' columns.
"""

from __future__ import annotations

from prepline.operators.rules import (
    CATEGORY_NAME_WORDS,
    ROLE_ID_WORDS,
    ROLE_TARGET_WORDS,
    ROLE_TIME_WORDS,
)

# column lists of the driver tables: (name, kind), kind in int32/int64/double/string/timestamp/array
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "int32"), ("r_name", "string")],
    "nation": [("n_nationkey", "int32"), ("n_name", "string"), ("n_regionkey", "int32")],
    "customer": [("c_custkey", "int64"), ("c_name", "string"), ("c_nationkey", "int32"), ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "int64"), ("s_name", "string"), ("s_nationkey", "int32"), ("s_acctbal", "double")],
    "part": [("p_partkey", "int64"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int32"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "int64"), ("o_custkey", "int64"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")],
    "lineitem": [
        ("l_orderkey", "int64"), ("l_partkey", "int64"), ("l_suppkey", "int64"), ("l_linenumber", "int32"), ("l_quantity", "double"),
        ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
        ("l_shipdate", "timestamp"),
    ],
    "events": [("event_id", "int64"), ("ts", "timestamp"), ("user_id", "int64"), ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "int64"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "int64")],
    "embeddings": [("vec_id", "int64"), ("embedding", "array"), ("label", "int32")],
    "pages": [("page_id", "int64"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "int64"), ("text", "string")],
    "labels": [("doc_id", "int64"), ("quality", "int32"), ("toxic", "int32")],
    "conversations": [("conv_id", "int64"), ("turn", "int64"), ("role", "string"), ("text", "string")],
}

DTYPE = {"int32": "int32", "int64": "int64", "double": "float64", "string": "object", "timestamp": "datetime64[ns]", "array": "array<float>"}
NUMERIC = {"int32", "int64", "double"}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ident(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


def contains_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), {lit(w)})" for w in words) + ")"


def contains_count(expr: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({expr}), {lit(w)}) AS INTEGER)" for w in words) + ")"


def meta_values(table: str, columns: list[tuple[str, str]] | None = None) -> str:
    """VALUES (position, column_name, dtype) for a table's columns."""
    cols = columns or SCHEMAS[table]
    rows = ", ".join(f"({i}, {lit(n)}, {lit(DTYPE[k])})" for i, (n, k) in enumerate(cols))
    return f"(SELECT * FROM (VALUES {rows}) AS m(position, column_name, dtype))"


def role_sql(name: str = "column_name", dtype: str = "dtype") -> str:
    return (
        f"CASE WHEN {contains_any(name, ROLE_TARGET_WORDS)} THEN 'potential_target' "
        f"WHEN {contains_any(name, ROLE_ID_WORDS)} THEN 'identifier' "
        f"WHEN contains({dtype}, 'datetime') OR {contains_any(name, ROLE_TIME_WORDS)} THEN 'datetime' ELSE 'feature' END"
    )


def name_type_sql(name: str = "column_name", dtype: str = "dtype") -> str:
    return (
        f"CASE WHEN contains({dtype}, 'int') OR contains({dtype}, 'float') THEN 'numeric' "
        f"WHEN contains({dtype}, 'datetime') OR contains(lower({name}), 'date') THEN 'datetime' "
        f"WHEN contains({dtype}, 'bool') THEN 'boolean' "
        f"WHEN contains({dtype}, 'object') THEN CASE WHEN {contains_any(name, CATEGORY_NAME_WORDS)} THEN 'categorical' ELSE 'text' END "
        f"ELSE 'mixed' END"
    )


def clean(col: str, kind: str) -> str:
    """NaN -> NULL for doubles, -0.0 -> 0.0."""
    c = ident(col)
    if kind == "double":
        return f"(CASE WHEN isnan({c}) THEN NULL WHEN {c} = 0 THEN 0.0 ELSE {c} END)"
    return c


def profile_sql(source: str, columns: list[tuple[str, str]], k: int = 5, places: int = 6) -> str:
    """One row per column, same columns as ``column_profile`` with doubles rounded."""
    parts = []
    for i, (name, kind) in enumerate(columns):
        c = clean(name, kind)
        dtype = DTYPE[kind]
        if kind == "array":
            uniq = "CAST(NULL AS BIGINT)"
            sample = "CAST(NULL AS VARCHAR)"
            missing = f"count(*) - count({ident(name)})"
        else:
            uniq = f"CAST(count(DISTINCT {c}) AS BIGINT)"
            missing = f"count(*) - count({c})"
            order = "o" if kind in NUMERIC else "s"
            sample = (
                f"(SELECT string_agg(s, '|' ORDER BY {order}) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS s, {c} AS o "
                f"FROM {source} WHERE {c} IS NOT NULL ORDER BY {order} LIMIT {k}))"
            )
        if kind == "string":
            data_type = f"CASE WHEN count(DISTINCT {c}) / count(*) < 0.5 THEN 'categorical' ELSE 'text' END"
        elif kind in NUMERIC:
            data_type = "'numeric'"
        elif kind == "timestamp":
            data_type = "'datetime'"
        else:
            data_type = "'mixed'"
        if kind in NUMERIC:
            stats = (
                f"round(avg({c}), {places}) AS mean, round(stddev_samp({c}), {places}) AS std, "
                f"round(CAST(min({c}) AS DOUBLE), {places}) AS min, round(CAST(max({c}) AS DOUBLE), {places}) AS max, "
                f"round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), {places}) AS median"
            )
        else:
            stats = "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS median"
        parts.append(
            f"SELECT {i} AS position, {lit(name)} AS column_name, {lit(dtype)} AS dtype, {data_type} AS data_type, "
            f"{role_sql(lit(name), lit(dtype))} AS potential_role, CAST(count(*) AS BIGINT) AS n_rows, "
            f"CAST({missing} AS BIGINT) AS n_missing, round(100.0 * ({missing}) / count(*), 2) AS missing_percentage, "
            f"{uniq} AS unique_values, {sample} AS sample_values, {stats} FROM {source}"
        )
    return "\nUNION ALL\n".join(parts)
