"""Registered source/sink and column-operator queries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from prepline.catalog import register
from prepline.catalog.sqlgen import SCHEMAS
from prepline.operators import clean as C
from prepline.sources import readers as S
from prepline.sources.tables import ORDERS_DUP_SQL, ORDERS_MISSING_SQL, load, orders_dup, orders_missing, orders_text_dates

ORDERS = "SELECT * FROM orders"


def _out(spark, name):
    return S.scratch_path(spark, name)


@register("s1_read_csv_roundtrip", ORDERS)
def s1(spark, sf):
    path = _out(spark, "orders_csv")
    load(spark, sf, "orders").write.mode("overwrite").option("header", "true").csv(path)
    back = S.read_csv(spark, path)
    return back.select(*[F.col(c).cast(t) for c, t in load(spark, sf, "orders").dtypes])


@register("s1_read_csv_header_row", ORDERS)
def s1h(spark, sf):
    """Every file starts with two junk lines and the header: the header is line 2."""
    import pandas as pd

    orders = load(spark, sf, "orders")
    path = _out(spark, "orders_csv_junk")
    body = orders.select(
        F.concat_ws(",", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss") if t.startswith("timestamp") else F.col(c).cast("string") for c, t in orders.dtypes]).alias("value")
    )
    preamble = ["exported by some tool", "second junk line", ",".join(orders.columns)]

    def with_preamble(batches):
        yield pd.DataFrame({"value": preamble})  # once per partition = once per written file
        yield from batches

    body.mapInPandas(with_preamble, "value string").write.mode("overwrite").text(path)
    back = S.read_csv(spark, path, header_row=2, quoted_breaks=False)  # one record a line, as written: files are split
    return back.select(*[F.col(c).cast(t) for c, t in orders.dtypes])


@register("s2_sniff_separator", """SELECT * FROM (VALUES (0, ',', 1, 1, false, false), (1, ';', 6, 6, true, true), (2, '\t', 1, 1, false, false), (3, '|', 1, 1, false, false))
AS t(rank, separator, min_fields, max_fields, consistent, chosen) WHERE (SELECT count(*) FROM orders) > 0""")
def s2(spark, sf):
    path = _out(spark, "orders_semicolon")
    load(spark, sf, "orders").write.mode("overwrite").option("sep", ";").csv(path)
    return S.sniff_separator(spark, path)


@register("s3_detect_encoding", None)
def s3(spark, sf):
    path = _out(spark, "orders_text")
    load(spark, sf, "orders").select(F.concat_ws(";", "o_orderkey", "o_orderpriority").alias("value")).write.mode("overwrite").text(path)
    return S.detect_encoding(spark, os.path.join(path, "part-*")).select(F.col("encoding"), F.col("has_bom"), F.col("n_bytes") > 0)


@register("s4_read_json_lines", ORDERS)
def s4(spark, sf):
    path = _out(spark, "orders_json")
    orders = load(spark, sf, "orders")
    orders.write.mode("overwrite").json(path)
    return S.read_json(spark, path).select(*[F.col(c).cast(t) for c, t in orders.dtypes])


@register("s5_read_parquet_lineitem", "SELECT * FROM lineitem")
def s5(spark, sf):
    return S.read_parquet(spark, f"{sf}/lineitem.parquet")


@register("s6_read_feather_roundtrip", ORDERS)
def s6(spark, sf):
    path = _out(spark, "orders_feather")
    orders = load(spark, sf, "orders")
    written = S.write_feather(orders, path)
    written.count()  # action: the sink
    return S.read_feather(spark, os.path.join(path, "part-*.feather"))


@register("s7_read_auto_parquet", "SELECT * FROM customer")
def s7(spark, sf):
    return S.read_auto(spark, f"{sf}/customer.parquet", format_hint="csv")


@register("s8_row_cap", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def s8(spark, sf):
    return S.row_cap(load(spark, sf, "orders"), 10, [F.col("o_totalprice").desc(), "o_orderkey"])


@register(
    "s9_preview",
    """SELECT row_no, n_rows, n_cols FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS row_no FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5)),
  (SELECT CAST(count(*) AS BIGINT) AS n_rows, 6 AS n_cols FROM orders)""",
)
def s9(spark, sf):
    return S.preview(load(spark, sf, "orders"), ["o_orderkey"], 5).select("row_no", "n_rows", "n_cols")


@register("s10_persist_dataset", "SELECT CAST(count(*) AS BIGINT) AS n_rows FROM part")
def s10(spark, sf):
    root = _out(spark, "datasets")
    return S.persist_dataset(load(spark, sf, "part"), f"{sf}/part.parquet", root).select("n_rows")


# ------------------------------------------------------------------ P1-P7

@register(
    "p1_standardize_names",
    "SELECT o_orderkey AS order_key, o_custkey AS order_key_2, o_totalprice AS order_key_3, o_orderstatus AS o_orderstatus, o_orderdate, o_orderpriority FROM orders",
)
def p1(spark, sf):
    o = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias(" Order Key"),
        F.col("o_custkey").alias("order-key"),
        F.col("o_totalprice").alias("ORDER KEY"),
        F.col("o_orderstatus").alias("O_OrderStatus "),
        "o_orderdate",
        "o_orderpriority",
    )
    return C.standardize_names(o)


@register("p2_coerce_datetimes", ORDERS)
def p2(spark, sf):
    return C.coerce_datetimes(orders_text_dates(spark, sf))


@register(
    "p2_coerce_datetimes_mixed",
    "SELECT * REPLACE (CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate) FROM orders",
)
def p2m(spark, sf):
    return C.coerce_datetimes(orders_text_dates(spark, sf, mixed=True), min_share=0.9)


@register("p3_select_by_type_numeric", "SELECT " + ", ".join(n for n, k in SCHEMAS["lineitem"] if k in ("int32", "int64", "double")) + " FROM lineitem")
def p3(spark, sf):
    return C.select_by_type(load(spark, sf, "lineitem"), "numeric")


@register("p4_select_features", "SELECT o_orderstatus, o_totalprice, o_orderdate FROM orders")
def p4(spark, sf):
    from prepline.catalog.q_rules import light_profile
    from prepline.operators.rules import recommend_features

    orders = load(spark, sf, "orders")
    keep = recommend_features(light_profile(orders), "supervised_classification").where("decision = 'keep'")
    approved = [r["column_name"] for r in keep.select("column_name").collect()]  # column names only
    return C.select_features(orders, approved)


@register(
    "p5_drop_missing_rows",
    f"SELECT * FROM {ORDERS_MISSING_SQL} WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice) AND o_orderpriority IS NOT NULL",
)
def p5(spark, sf):
    return C.drop_missing_rows(orders_missing(spark, sf), how="any")


@register("p5_drop_missing_columns", f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM {ORDERS_MISSING_SQL}")
def p5c(spark, sf):
    return C.drop_missing_columns(orders_missing(spark, sf), max_missing_pct=10.0)


@register("p6_flatten_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def p6(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "props")
    return C.parse_json_column(ev, "props")


@register("p7_drop_duplicate_rows", f"SELECT DISTINCT * FROM {ORDERS_DUP_SQL}")
def p7(spark, sf):
    return C.drop_duplicate_rows(orders_dup(spark, sf))
