"""Registered queries for checks and suites.

Each query takes (spark, sf_dir) and returns a DataFrame; its DuckDB twin
is in ``ORACLE`` under the same key with the same column names.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.plans.suite import NO_PREVIOUS, Suite
from vouch.sources.tables import Tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SUITE_COLUMNS = ["suite", "test_id", "seq", "status", "points"]


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def check_rows(suite: Suite) -> DataFrame:
    """The per-check view: (test_id, violations, passed), dependencies not applied."""
    raw = suite.raw_results()
    return raw.select("test_id", "violations", F.col("raw_passed").alias("passed"))


# ---------------------------------------------------------------------------
# Flagship: a suite over orders and lineitem (E1, E2, E6, E8, E9, E15, E16)
# ---------------------------------------------------------------------------


def orders_contract(spark: SparkSession, sf_dir: str) -> Suite:
    t = Tables(spark, sf_dir)
    orders, lineitem = t.orders, t.lineitem
    s = Suite("orders_contract", spark)
    s.expect(lineitem, F.col("l_discount").between(0, 0.1), "Discounts lie in [0, 0.1]",
             test_id="discount_range", points=2)
    s.expect_equals(orders, F.count(F.lit(1)), F.count("o_orderkey"), "Every order has a key",
                    test_id="keys_present")
    s.expect_equals(orders, F.count_distinct("o_custkey"), F.count(F.lit(1)), "One order per customer",
                    test_id="one_order_per_customer", points=3, hint="Found [[ACTUAL_VALUE]] customers")
    s.expect_not_null(orders, "o_orderdate", "Order dates are present", test_id="dates_present")
    s.expect_in(orders, "o_orderstatus", ["F", "O", "P"], "Known order status", test_id="status_known",
                depends_on=["keys_present"], points=2)
    s.expect_in(lineitem, "l_returnflag", ["A", "N", "R"], "Known return flag", test_id="flag_known",
                depends_on="discount_range")
    s.expect_columns(lineitem, ["l_orderkey", "l_comment"], "has_comment", depends_on="flag_known")
    s.expect(lineitem, "length(l_comment) < 50", "Comments are short", test_id="comment_short",
             depends_on="has_comment")
    s.fail("Reviewed by a person", test_id="manual_review", depends_on="keys_present")
    s.expect_close(lineitem, F.col("l_extendedprice") * (1 - F.col("l_discount")),
                   F.col("l_extendedprice") - F.col("l_extendedprice") * F.col("l_discount"),
                   "Discounted price recomputes", test_id="price_recomputes", depends_on="discount_range", points=2)
    return s


@query("suite_results", """
WITH RECURSIVE raw(test_id, seq, pts, ok) AS (
  SELECT 'orders_contract-discount_range', 1, 2,
         (SELECT count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.1, false)) = 0 FROM lineitem)
  UNION ALL SELECT 'orders_contract-keys_present', 2, 1, (SELECT count(*) = count(o_orderkey) FROM orders)
  UNION ALL SELECT 'orders_contract-one_order_per_customer', 3, 3,
         (SELECT count(DISTINCT o_custkey) = count(*) FROM orders)
  UNION ALL SELECT 'orders_contract-dates_present', 4, 1,
         (SELECT count(*) FILTER (WHERE o_orderdate IS NULL) = 0 FROM orders)
  UNION ALL SELECT 'orders_contract-status_known', 5, 2,
         (SELECT count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('F', 'O', 'P'), false)) = 0 FROM orders)
  UNION ALL SELECT 'orders_contract-flag_known', 6, 1,
         (SELECT count(*) FILTER (WHERE NOT coalesce(l_returnflag IN ('A', 'N', 'R'), false)) = 0 FROM lineitem)
  UNION ALL SELECT 'orders_contract-has_comment', 7, 1, false
  UNION ALL SELECT 'orders_contract-comment_short', 8, 1, false
  UNION ALL SELECT 'orders_contract-manual_review', 9, 1, false
  UNION ALL SELECT 'orders_contract-price_recomputes', 10, 2,
         (SELECT count(*) FILTER (WHERE NOT coalesce(
            abs(l_extendedprice * (1 - l_discount) - (l_extendedprice - l_extendedprice * l_discount)) <= 0.01,
            false)) = 0 FROM lineitem)
),
deps(t, d) AS (VALUES
  ('orders_contract-keys_present', 'orders_contract-discount_range'),
  ('orders_contract-one_order_per_customer', 'orders_contract-keys_present'),
  ('orders_contract-dates_present', 'orders_contract-one_order_per_customer'),
  ('orders_contract-status_known', 'orders_contract-keys_present'),
  ('orders_contract-flag_known', 'orders_contract-discount_range'),
  ('orders_contract-has_comment', 'orders_contract-flag_known'),
  ('orders_contract-comment_short', 'orders_contract-has_comment'),
  ('orders_contract-manual_review', 'orders_contract-keys_present'),
  ('orders_contract-price_recomputes', 'orders_contract-discount_range')
),
back AS (
  SELECT deps.t, deps.d FROM deps JOIN raw rt ON rt.test_id = deps.t JOIN raw rd ON rd.test_id = deps.d
  WHERE rd.seq < rt.seq
),
skipped(id) AS (
  SELECT back.t FROM back JOIN raw ON raw.test_id = back.d WHERE NOT raw.ok
  UNION
  SELECT back.t FROM back JOIN skipped ON back.d = skipped.id
)
SELECT 'orders_contract' AS suite, test_id, seq,
       CASE WHEN test_id IN (SELECT id FROM skipped) THEN 'skipped' WHEN ok THEN 'passed' ELSE 'failed' END AS status,
       CASE WHEN test_id NOT IN (SELECT id FROM skipped) AND ok THEN pts ELSE 0 END AS points
FROM raw
""")
def suite_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_contract(spark, sf_dir).results().select(*SUITE_COLUMNS)


# ---------------------------------------------------------------------------
# E1 - E17: one query per check family, output (test_id, violations, passed)
# ---------------------------------------------------------------------------


@query("expect_custom", """
SELECT 'custom-discount_range' AS test_id,
       count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.1, false)) AS violations,
       count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.1, false)) = 0 AS passed FROM lineitem
UNION ALL
SELECT 'custom-tax_below_7pct',
       count(*) FILTER (WHERE NOT coalesce(l_tax < 0.07, false)),
       count(*) FILTER (WHERE NOT coalesce(l_tax < 0.07, false)) = 0 FROM lineitem
UNION ALL
SELECT 'custom-amounts_non_negative',
       count(*) FILTER (WHERE NOT coalesce(l_quantity * l_extendedprice >= 0, false)),
       count(*) FILTER (WHERE NOT coalesce(l_quantity * l_extendedprice >= 0, false)) = 0 FROM lineitem
""")
def expect_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Tables(spark, sf_dir).lineitem
    s = Suite("custom", spark)
    s.expect(li, F.col("l_discount").between(0, 0.1), "Discount range", test_id="discount_range")
    s.expect(li, "l_tax < 0.07", "Tax below 7%", test_id="tax_below_7pct")
    s.expect(li, F.col("l_quantity") * F.col("l_extendedprice") >= 0, "Non-negative amounts", test_id="amounts_non_negative")
    return check_rows(s)


@query("expect_equals", """
SELECT 'equals-keys_present' AS test_id, CASE WHEN count(*) = count(o_orderkey) THEN 0 ELSE 1 END AS violations,
       count(*) = count(o_orderkey) AS passed FROM orders
UNION ALL
SELECT 'equals-one_order_per_customer', CASE WHEN count(DISTINCT o_custkey) = count(*) THEN 0 ELSE 1 END,
       count(DISTINCT o_custkey) = count(*) FROM orders
UNION ALL
SELECT 'equals-quantity_total', CASE WHEN sum(l_quantity) = sum(l_quantity * 1.0) THEN 0 ELSE 1 END,
       sum(l_quantity) = sum(l_quantity * 1.0) FROM lineitem
UNION ALL
SELECT 'equals-flag_is_n', count(*) FILTER (WHERE l_returnflag IS DISTINCT FROM 'N'),
       count(*) FILTER (WHERE l_returnflag IS DISTINCT FROM 'N') = 0 FROM lineitem
UNION ALL
SELECT 'equals-text_is_not_number', count(*), count(*) = 0 FROM orders
""")
def expect_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    orders, li = t.orders, t.lineitem
    s = Suite("equals", spark)
    s.expect_equals(orders, F.count(F.lit(1)), F.count("o_orderkey"), "Keys present", test_id="keys_present")
    s.expect_equals(orders, F.count_distinct("o_custkey"), F.count(F.lit(1)), "One order per customer",
                    test_id="one_order_per_customer")
    s.expect_equals(li, F.sum("l_quantity"), F.sum(F.col("l_quantity") * 1.0), "Quantity total", test_id="quantity_total")
    s.expect_equals(li, "l_returnflag", "N", "Return flag is N", per_row=True, test_id="flag_is_n")
    # '1' == 1 is false: a text column never equals a number
    s.expect_equals(orders, "o_orderstatus", 1, "Status equals 1", per_row=True, test_id="text_is_not_number")
    return check_rows(s)


@query("expect_true", """
SELECT 'true-price_positive' AS test_id, count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false)) AS violations,
       count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false)) = 0 AS passed FROM orders
UNION ALL
SELECT 'true-price_over_1000', count(*) FILTER (WHERE NOT coalesce(o_totalprice > 1000, false)),
       count(*) FILTER (WHERE NOT coalesce(o_totalprice > 1000, false)) = 0 FROM orders
UNION ALL
SELECT 'true-number_is_not_true', count(*), count(*) = 0 FROM orders
""")
def expect_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir).orders
    s = Suite("true", spark)
    s.expect_true(orders, F.col("o_totalprice") > 0, "Price positive", test_id="price_positive")
    s.expect_true(orders, F.col("o_totalprice") > 1000, "Price over 1000", test_id="price_over_1000")
    # identity test: 1 is not True
    s.expect_true(orders, F.lit(1), "One is not True", test_id="number_is_not_true")
    return check_rows(s)


@query("expect_false", """
SELECT 'false-price_negative' AS test_id, count(*) FILTER (WHERE NOT coalesce(NOT (o_totalprice < 0), false)) AS violations,
       count(*) FILTER (WHERE NOT coalesce(NOT (o_totalprice < 0), false)) = 0 AS passed FROM orders
UNION ALL
SELECT 'false-status_open', count(*) FILTER (WHERE NOT coalesce(NOT (o_orderstatus = 'O'), false)),
       count(*) FILTER (WHERE NOT coalesce(NOT (o_orderstatus = 'O'), false)) = 0 FROM orders
""")
def expect_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir).orders
    s = Suite("false", spark)
    s.expect_false(orders, F.col("o_totalprice") < 0, "No negative price", test_id="price_negative")
    s.expect_false(orders, F.col("o_orderstatus") == "O", "No open order", test_id="status_open")
    return check_rows(s)


@query("expect_null", """
WITH keys AS (SELECT DISTINCT l_orderkey FROM lineitem),
j AS (SELECT o.*, k.l_orderkey FROM orders o LEFT JOIN keys k ON o.o_orderkey = k.l_orderkey)
SELECT 'null-no_lineitems' AS test_id, count(*) FILTER (WHERE l_orderkey IS NOT NULL) AS violations,
       count(*) FILTER (WHERE l_orderkey IS NOT NULL) = 0 AS passed FROM j
UNION ALL
SELECT 'null-no_negative_price',
       CASE WHEN max(CASE WHEN o_totalprice < 0 THEN 1 END) IS NULL THEN 0 ELSE 1 END,
       max(CASE WHEN o_totalprice < 0 THEN 1 END) IS NULL FROM orders
""")
def expect_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    orders = t.orders
    keys = t.lineitem.select("l_orderkey").distinct()
    joined = orders.join(keys, orders["o_orderkey"] == keys["l_orderkey"], "left")
    s = Suite("null", spark)
    s.expect_null(joined, "l_orderkey", "Orders without line items", test_id="no_lineitems")
    s.expect_null(orders, F.max(F.when(F.col("o_totalprice") < 0, F.lit(1))), "No negative price",
                  per_row=False, test_id="no_negative_price")
    return check_rows(s)


_CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("expect_not_null", "\nUNION ALL\n".join(
    f"SELECT 'not_null-{c}' AS test_id, count(*) FILTER (WHERE {c} IS NULL) AS violations, "
    f"count(*) FILTER (WHERE {c} IS NULL) = 0 AS passed FROM customer" for c in _CUSTOMER_COLUMNS))
def expect_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = Tables(spark, sf_dir).customer
    s = Suite("not_null", spark)
    for c in _CUSTOMER_COLUMNS:
        s.expect_not_null(customer, c, f"{c} is present", test_id=c)
    return check_rows(s)


@query("expect_length", """
SELECT 'length-embedding_dim' AS test_id, count(*) FILTER (WHERE NOT coalesce(len(embedding) = 64, false)) AS violations,
       count(*) FILTER (WHERE NOT coalesce(len(embedding) = 64, false)) = 0 AS passed FROM embeddings
UNION ALL
SELECT 'length-name_18', count(*) FILTER (WHERE NOT coalesce(length(c_name) = 18, false)),
       count(*) FILTER (WHERE NOT coalesce(length(c_name) = 18, false)) = 0 FROM customer
UNION ALL
SELECT 'length-segment_10', count(*) FILTER (WHERE NOT coalesce(length(c_mktsegment) = 10, false)),
       count(*) FILTER (WHERE NOT coalesce(length(c_mktsegment) = 10, false)) = 0 FROM customer
UNION ALL
SELECT 'length-number_has_no_length', count(*), count(*) = 0 FROM customer
""")
def expect_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    s = Suite("length", spark)
    s.expect_length(t.embeddings, "embedding", 64, "Embedding dimension", test_id="embedding_dim")
    customer = t.customer
    s.expect_length(customer, "c_name", 18, "Name length", test_id="name_18")
    s.expect_length(customer, "c_mktsegment", 10, "Segment length", test_id="segment_10")
    s.expect_length(customer, "c_acctbal", 1, "A number has no length", test_id="number_has_no_length")
    return check_rows(s)


@query("expect_close", """
SELECT 'close-row_recompute' AS test_id,
       count(*) FILTER (WHERE NOT coalesce(abs(l_extendedprice * (1 - l_discount)
              - (l_extendedprice - l_extendedprice * l_discount)) <= 0.01, false)) AS violations,
       count(*) FILTER (WHERE NOT coalesce(abs(l_extendedprice * (1 - l_discount)
              - (l_extendedprice - l_extendedprice * l_discount)) <= 0.01, false)) = 0 AS passed FROM lineitem
UNION ALL
SELECT 'close-sum_recompute',
       CASE WHEN abs(sum(l_extendedprice * (1 - l_discount)) - (sum(l_extendedprice) - sum(l_extendedprice * l_discount))) <= 0.01
            THEN 0 ELSE 1 END,
       abs(sum(l_extendedprice * (1 - l_discount)) - (sum(l_extendedprice) - sum(l_extendedprice * l_discount))) <= 0.01
FROM lineitem
UNION ALL
SELECT 'close-sum_off_by_one',
       CASE WHEN abs(sum(l_quantity) - (sum(l_quantity) + 1)) <= 0.01 THEN 0 ELSE 1 END,
       abs(sum(l_quantity) - (sum(l_quantity) + 1)) <= 0.01 FROM lineitem
UNION ALL
SELECT 'close-text_unparsable', count(*) FILTER (WHERE NOT coalesce(abs(TRY_CAST(o_orderpriority AS DOUBLE) - 1.0) <= 0.01, false)),
       count(*) FILTER (WHERE NOT coalesce(abs(TRY_CAST(o_orderpriority AS DOUBLE) - 1.0) <= 0.01, false)) = 0 FROM orders
""")
def expect_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    li = t.lineitem
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    s = Suite("close", spark)
    s.expect_close(li, price * (1 - disc), price - price * disc, "Row recompute", test_id="row_recompute")
    s.expect_close(li, F.sum(price * (1 - disc)), F.sum(price) - F.sum(price * disc), "Sum recompute",
                   per_row=False, test_id="sum_recompute")
    s.expect_close(li, F.sum("l_quantity"), F.sum("l_quantity") + 1, "Sum off by one", per_row=False,
                   test_id="sum_off_by_one")
    s.expect_close(t.orders, "o_orderpriority", 1.0, "Text does not parse", test_id="text_unparsable")
    return check_rows(s)


@query("expect_in_set", """
SELECT 'in_set-status_known' AS test_id,
       count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('F', 'O', 'P'), false)) AS violations,
       count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('F', 'O', 'P'), false)) = 0 AS passed FROM orders
UNION ALL
SELECT 'in_set-region_known', count(*), count(*) = 0
FROM nation n WHERE NOT EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey = n.n_regionkey)
UNION ALL
SELECT 'in_set-flag_a_or_n', count(*) FILTER (WHERE NOT coalesce(l_returnflag IN ('A', 'N'), false)),
       count(*) FILTER (WHERE NOT coalesce(l_returnflag IN ('A', 'N'), false)) = 0 FROM lineitem
UNION ALL
SELECT 'in_set-supplier_known', count(*), count(*) = 0
FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey)
""")
def expect_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    s = Suite("in_set", spark)
    s.expect_in(t.orders, "o_orderstatus", ["F", "O", "P"], "Known status", test_id="status_known")
    s.expect_in(t.nation, "n_regionkey", t.region, "Region exists", allowed_column="r_regionkey", test_id="region_known")
    s.expect_in(t.lineitem, "l_returnflag", ["A", "N"], "Flag A or N", test_id="flag_a_or_n")
    s.expect_in(t.lineitem, "l_suppkey", t.supplier, "Supplier exists", allowed_column="s_suppkey",
                test_id="supplier_known")
    return check_rows(s)


def _orders_changed(orders: DataFrame) -> DataFrame:
    """Orders with the status of the first order changed and columns reversed."""
    first = orders.agg(F.min("o_orderkey")).scalar()
    changed = orders.withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") == first, F.lit("X")).otherwise(F.col("o_orderstatus"))
    )
    return changed.select(*reversed(orders.columns))


_ORDERS_CHANGED_SQL = """b AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         o_totalprice, o_orderdate, o_orderpriority FROM orders)"""


@query("expect_row", f"""
WITH {_ORDERS_CHANGED_SQL}
SELECT 'row-reordered_columns' AS test_id, 0::BIGINT AS violations, true AS passed
UNION ALL
SELECT 'row-one_status_changed', count(*), count(*) = 0
FROM orders a JOIN b USING (o_orderkey)
WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_custkey IS DISTINCT FROM b.o_custkey
   OR a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_orderdate IS DISTINCT FROM b.o_orderdate
   OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority
""")
def expect_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir).orders
    s = Suite("row", spark)
    s.expect_rows_equal(orders, orders.select(*reversed(orders.columns)), ["o_orderkey"], "Same rows, other column order",
                        test_id="reordered_columns")
    s.expect_rows_equal(orders, _orders_changed(orders), ["o_orderkey"], "One status changed", test_id="one_status_changed")
    return check_rows(s)


@query("expect_tables_equal_bag", f"""
WITH {_ORDERS_CHANGED_SQL}
SELECT 'actual_only' AS side, (SELECT count(*) FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM b)) AS rows_differing
UNION ALL
SELECT 'expected_only', (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM orders))
""")
def expect_tables_equal_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vouch.operators.compare import bag_difference

    orders = Tables(spark, sf_dir).orders
    return bag_difference(orders, _orders_changed(orders))


_ORDER_ALL = "o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice"


@query("expect_tables_equal_ordered", f"""
WITH {_ORDERS_CHANGED_SQL},
pa AS (SELECT *, row_number() OVER (ORDER BY {_ORDER_ALL}) AS rn FROM orders),
pb AS (SELECT *, row_number() OVER (ORDER BY {_ORDER_ALL}) AS rn FROM b),
j AS (SELECT pa.rn AS ra, pb.rn AS rb,
             (pa.o_orderkey IS NOT DISTINCT FROM pb.o_orderkey AND pa.o_custkey IS NOT DISTINCT FROM pb.o_custkey
              AND pa.o_orderstatus IS NOT DISTINCT FROM pb.o_orderstatus AND pa.o_totalprice IS NOT DISTINCT FROM pb.o_totalprice
              AND pa.o_orderdate IS NOT DISTINCT FROM pb.o_orderdate
              AND pa.o_orderpriority IS NOT DISTINCT FROM pb.o_orderpriority) AS same
      FROM pa FULL OUTER JOIN pb ON pa.rn = pb.rn)
SELECT 'actual_only' AS side, count(*) FILTER (WHERE rb IS NULL) AS rows_differing FROM j
UNION ALL SELECT 'expected_only', count(*) FILTER (WHERE ra IS NULL) FROM j
UNION ALL SELECT 'changed', count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL AND NOT same) FROM j
""")
def expect_tables_equal_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vouch.operators.compare import ordered_difference

    orders = Tables(spark, sf_dir).orders
    return ordered_difference(orders, _orders_changed(orders), ["o_orderkey"])


@query("expect_sequence_ordered", """
SELECT 'seq_ordered-already_sorted' AS test_id,
       count(*) FILTER (WHERE NOT (embedding IS NOT DISTINCT FROM list_sort(embedding))) AS violations,
       count(*) FILTER (WHERE NOT (embedding IS NOT DISTINCT FROM list_sort(embedding))) = 0 AS passed FROM embeddings
UNION ALL
SELECT 'seq_ordered-self', count(*) FILTER (WHERE NOT (embedding IS NOT DISTINCT FROM embedding)),
       count(*) FILTER (WHERE NOT (embedding IS NOT DISTINCT FROM embedding)) = 0 FROM embeddings
""")
def expect_sequence_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = Tables(spark, sf_dir).embeddings
    s = Suite("seq_ordered", spark)
    s.expect_sequence(emb, "embedding", F.array_sort("embedding"), True, "Already sorted", test_id="already_sorted")
    s.expect_sequence(emb, "embedding", F.col("embedding"), True, "Equal to itself", test_id="self")
    return check_rows(s)


@query("expect_sequence_unordered", """
SELECT 'seq_unordered-sorted' AS test_id,
       count(*) FILTER (WHERE NOT (len(embedding) = len(list_sort(embedding)) AND list_has_all(embedding, list_sort(embedding))
                                   AND list_has_all(list_sort(embedding), embedding))) AS violations,
       count(*) FILTER (WHERE NOT (len(embedding) = len(list_sort(embedding)) AND list_has_all(embedding, list_sort(embedding))
                                   AND list_has_all(list_sort(embedding), embedding))) = 0 AS passed FROM embeddings
UNION ALL
SELECT 'seq_unordered-reversed',
       count(*) FILTER (WHERE NOT (len(embedding) = len(list_reverse(embedding)) AND list_has_all(embedding, list_reverse(embedding))
                                   AND list_has_all(list_reverse(embedding), embedding))),
       count(*) FILTER (WHERE NOT (len(embedding) = len(list_reverse(embedding)) AND list_has_all(embedding, list_reverse(embedding))
                                   AND list_has_all(list_reverse(embedding), embedding))) = 0 FROM embeddings
UNION ALL
SELECT 'seq_unordered-tail_only',
       count(*) FILTER (WHERE NOT (len(embedding) = len(embedding[2:]) AND list_has_all(embedding, embedding[2:])
                                   AND list_has_all(embedding[2:], embedding))),
       count(*) FILTER (WHERE NOT (len(embedding) = len(embedding[2:]) AND list_has_all(embedding, embedding[2:])
                                   AND list_has_all(embedding[2:], embedding))) = 0 FROM embeddings
""")
def expect_sequence_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = Tables(spark, sf_dir).embeddings
    e = F.col("embedding")
    s = Suite("seq_unordered", spark)
    s.expect_sequence(emb, e, F.array_sort(e), False, "Same values as sorted", test_id="sorted")
    s.expect_sequence(emb, e, F.reverse(e), False, "Same values as reversed", test_id="reversed")
    s.expect_sequence(emb, e, F.slice(e, 2, 1 << 30), False, "Tail is shorter", test_id="tail_only")
    return check_rows(s)


# ---------------------------------------------------------------------------
# E13 / E14: schemas as tables
# ---------------------------------------------------------------------------

# The declared contract - (table, field, Spark type class, nullable or None).
SCHEMA_CONTRACT = [
    ("region", "r_regionkey", "IntegerType", None), ("region", "r_name", "StringType", None),
    ("nation", "n_nationkey", "IntegerType", None), ("nation", "n_name", "StringType", None),
    ("nation", "n_regionkey", "IntegerType", None),
    ("customer", "c_custkey", "LongType", False), ("customer", "c_name", "StringType", True),
    ("customer", "c_nationkey", "IntegerType", None), ("customer", "c_acctbal", "DoubleType", None),
    ("customer", "c_mktsegment", "StringType", None),
    ("supplier", "s_suppkey", "LongType", None), ("supplier", "s_acctbal", "DoubleType", None),
    ("part", "p_partkey", "LongType", None), ("part", "p_size", "IntegerType", None),
    ("part", "p_retailprice", "DecimalType", None),
    ("orders", "o_orderkey", "LongType", None), ("orders", "o_orderdate", "TimestampType", None),
    ("orders", "o_totalprice", "DoubleType", True),
    ("lineitem", "l_orderkey", "LongType", None), ("lineitem", "l_shipdate", "TimestampNTZType", None),
    ("lineitem", "l_quantity", "DoubleType", None), ("lineitem", "l_comment", "StringType", None),
    ("events", "event_id", "LongType", None), ("events", "ts", "TimestampNTZType", True),
    ("events", "props", "StringType", None),
    ("documents", "doc_id", "LongType", None), ("documents", "text", "StringType", None),
    ("documents", "n_chars", "LongType", None),
    ("embeddings", "embedding", "ArrayType", None), ("embeddings", "label", "IntegerType", None),
    ("pages", "url", "StringType", None), ("pages", "html", "StringType", None),
    ("benchmark", "item_id", "LongType", None), ("labels", "quality", "IntegerType", None),
    ("conversations", "turn", "LongType", None), ("conversations", "role", "StringType", None),
]

# DuckDB type names and the Spark type class each reads as.
_DUCK_TO_SPARK = [
    ("BIGINT", "LongType"), ("INTEGER", "IntegerType"), ("VARCHAR", "StringType"), ("DOUBLE", "DoubleType"),
    ("TIMESTAMP", "TimestampNTZType"), ("FLOAT[]", "ArrayType"), ("FLOAT", "FloatType"), ("BOOLEAN", "BooleanType"),
]


def _sql_bool(v):
    return "NULL::BOOLEAN" if v is None else ("true" if v else "false")


_CONTRACT_VALUES = ",\n  ".join(f"('{t}', '{n}', '{ty}', {_sql_bool(nl)})" for t, n, ty, nl in SCHEMA_CONTRACT)
_TYPE_CASE = " ".join(f"WHEN '{d}' THEN '{s}'" for d, s in _DUCK_TO_SPARK)


@query("expect_field", f"""
WITH expected(tbl, name, type_class, nullable) AS (VALUES
  {_CONTRACT_VALUES}),
actual AS (
  SELECT table_name AS tbl, column_name AS name, CASE data_type {_TYPE_CASE} ELSE data_type END AS type_class,
         is_nullable = 'YES' AS nullable
  FROM information_schema.columns),
checked AS (
  SELECT e.tbl, e.name,
         coalesce(a.type_class = e.type_class AND (e.nullable IS NULL OR a.nullable = e.nullable), false) AS ok
  FROM expected e LEFT JOIN actual a ON a.tbl = e.tbl AND a.name = e.name)
SELECT 'schema-' || tbl || '.' || name AS test_id, CASE WHEN ok THEN 0 ELSE 1 END::BIGINT AS violations, ok AS passed
FROM checked
""")
def expect_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    schemas = {name: getattr(t, name).schema for name in sorted({c[0] for c in SCHEMA_CONTRACT})}
    s = Suite("schema", spark)
    for table, name, type_class, nullable in SCHEMA_CONTRACT:
        s.expect_field(schemas[table], name, type_class, nullable, test_id=f"{table}.{name}")
    return check_rows(s)


@query("compare_schemas", """
WITH a AS (SELECT ordinal_position AS pos, column_name AS name,
                  data_type AS ty FROM information_schema.columns WHERE table_name = 'customer'),
b AS (SELECT (SELECT count(*) FROM a) + 1 - pos AS pos, name,
             CASE WHEN name = 'c_acctbal' THEN 'VARCHAR' ELSE ty END AS ty FROM a),
o AS (SELECT a.pos AS pa, b.pos AS pb, (a.name = b.name AND a.ty = b.ty) AS same FROM a FULL OUTER JOIN b ON a.pos = b.pos)
SELECT 'ordered' AS mode, 'actual_only' AS side, count(*) FILTER (WHERE pb IS NULL) AS rows_differing FROM o
UNION ALL SELECT 'ordered', 'expected_only', count(*) FILTER (WHERE pa IS NULL) FROM o
UNION ALL SELECT 'ordered', 'changed', count(*) FILTER (WHERE pa IS NOT NULL AND pb IS NOT NULL AND NOT same) FROM o
UNION ALL SELECT 'unordered', 'actual_only', count(*) FROM (SELECT name, ty FROM a EXCEPT SELECT name, ty FROM b)
UNION ALL SELECT 'unordered', 'expected_only', count(*) FROM (SELECT name, ty FROM b EXCEPT SELECT name, ty FROM a)
""")
def compare_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vouch.operators.compare import field_table, schema_difference

    customer = Tables(spark, sf_dir).customer
    other = customer.withColumn("c_acctbal", F.col("c_acctbal").cast("string")).select(*reversed(customer.columns))
    fa = field_table(spark, {"customer": customer.schema})
    fb = field_table(spark, {"customer_reversed": other.schema})
    ordered = schema_difference(fa, fb, ordered=True).select(F.lit("ordered").alias("mode"), "side", "rows_differing")
    unordered = schema_difference(fa, fb, ordered=False).select(F.lit("unordered").alias("mode"), "side", "rows_differing")
    return ordered.unionByName(unordered)


# ---------------------------------------------------------------------------
# E17: registered checks
# ---------------------------------------------------------------------------


def event_name_valid(df: DataFrame, column: str):
    """A name is present and at least three characters long."""
    c = F.col(column)
    return c.isNotNull() & (F.length(c) >= 3)


def value_between(df: DataFrame, column: str, low: float, high: float):
    return F.col(column).between(low, high)


@query("expect_registered", """
SELECT 'registered-event_name' AS test_id,
       count(*) FILTER (WHERE NOT coalesce(event_type IS NOT NULL AND length(event_type) >= 3, false)) AS violations,
       count(*) FILTER (WHERE NOT coalesce(event_type IS NOT NULL AND length(event_type) >= 3, false)) = 0 AS passed
FROM events
UNION ALL
SELECT 'registered-value_range', count(*) FILTER (WHERE NOT coalesce(value BETWEEN 0 AND 400, false)),
       count(*) FILTER (WHERE NOT coalesce(value BETWEEN 0 AND 400, false)) = 0 FROM events
""")
def expect_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vouch.operators.checks import register_check

    register_check(event_name_valid)
    register_check(value_between)
    events = Tables(spark, sf_dir).events
    s = Suite("registered", spark)
    s.expect_registered("event_name_valid", events, "event_type", test_id="event_name")
    s.expect_registered("value_between", events, "value", 0, 400, test_id="value_range")
    return check_rows(s)


# ---------------------------------------------------------------------------
# S1 - S10 over check tables derived from the data
# ---------------------------------------------------------------------------


@query("suite_duplicate_ids", """
SELECT 'lineitem-' || l_orderkey || '-' || l_linenumber AS test_id, count(*) AS n
FROM lineitem GROUP BY 1 HAVING count(*) > 1
""")
def suite_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vouch.plans.suite import duplicate_ids

    li = Tables(spark, sf_dir).lineitem
    ids = li.select(F.concat_ws("-", F.lit("lineitem"), "l_orderkey", "l_linenumber").alias("test_id"))
    return duplicate_ids(ids)


def order_checks(orders: DataFrame) -> DataFrame:
    """One check per order in a suite per customer, in order-key order:
    passes unless the order is pending; worth its priority digit in points."""
    return orders.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("suite"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("test_id"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderstatus") != "P").alias("raw_passed"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("check_points"),
    )


_ORDER_CHECKS_SQL = """oc AS (
  SELECT 'c' || o_custkey AS suite, 'c' || o_custkey || '-' || o_orderkey AS test_id, o_orderkey AS seq,
         o_orderstatus <> 'P' AS ok, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS pts FROM orders),
chain AS (
  SELECT *, coalesce(max(CASE WHEN NOT ok THEN 1 ELSE 0 END) OVER (
              PARTITION BY suite ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skipped
  FROM oc),
chain_status AS (
  SELECT suite, test_id, seq,
         CASE WHEN skipped THEN 'skipped' WHEN ok THEN 'passed' ELSE 'failed' END AS status,
         CASE WHEN NOT skipped AND ok THEN pts ELSE 0 END AS points, pts AS max_points FROM chain)"""


def chain_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vouch.operators.graph import skip_by_chain, status_columns

    raw = order_checks(Tables(spark, sf_dir).orders)
    j = skip_by_chain(raw)
    return j.select("suite", "test_id", "seq", *status_columns(F.col("raw_passed"), F.col("skipped"), F.col("check_points")))


@query("suite_skip_chain", f"""
WITH {_ORDER_CHECKS_SQL}
SELECT suite, test_id, seq, status, points FROM chain_status
""")
def suite_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_results(spark, sf_dir).select(*SUITE_COLUMNS)


@query("suite_score", f"""
WITH {_ORDER_CHECKS_SQL},
agg AS (SELECT suite, sum(points)::BIGINT AS score, sum(max_points)::BIGINT AS max_score FROM chain_status GROUP BY suite)
SELECT suite, score, max_score,
       CASE WHEN max_score = 0 THEN 0 ELSE CAST(trunc(CAST(score AS DOUBLE) * 100.0 / max_score) AS BIGINT) END AS percentage,
       CASE WHEN max_score = 0 THEN false ELSE CAST(trunc(CAST(score AS DOUBLE) * 100.0 / max_score) AS BIGINT) = 100 END AS passed
FROM agg
""")
def suite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vouch.plans.scoring import suite_score as score

    return score(chain_results(spark, sf_dir))


@query("suite_skip_dag", """
WITH RECURSIVE nodes AS (
  SELECT 'orders-' || o_orderkey AS test_id, o_orderkey AS seq, o_totalprice < 490000 AND o_orderkey <> 2 AS ok,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS pts FROM orders),
edges AS (
  SELECT 'orders-' || o_orderkey AS t, 'orders-' || (o_orderkey // 2) AS d FROM orders
  UNION SELECT 'orders-' || o_orderkey, 'orders-' || (o_orderkey // 3) FROM orders
  UNION SELECT 'orders-' || o_orderkey, 'orders-' || (o_orderkey - 1) FROM orders WHERE o_orderkey <= 150
  UNION SELECT 'orders-' || o_orderkey, 'orders-140' FROM orders WHERE o_custkey % 3 = 0),
back AS (
  SELECT e.t, e.d FROM edges e JOIN nodes nt ON nt.test_id = e.t JOIN nodes nd ON nd.test_id = e.d WHERE nd.seq < nt.seq),
skipped(id) AS (
  SELECT b.t FROM back b JOIN nodes n ON n.test_id = b.d WHERE NOT n.ok
  UNION
  SELECT b.t FROM back b JOIN skipped s ON b.d = s.id)
SELECT 'orders' AS suite, test_id, seq,
       CASE WHEN test_id IN (SELECT id FROM skipped) THEN 'skipped' WHEN ok THEN 'passed' ELSE 'failed' END AS status,
       CASE WHEN test_id NOT IN (SELECT id FROM skipped) AND ok THEN pts ELSE 0 END AS points
FROM nodes
""")
def suite_skip_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One suite over all orders; each order's check depends on the checks of
    orders key//2 and key//3 (a DAG with many paths), the first 150 also on the
    one before (a long chain, whose second check fails), and a third of all on
    one shared check."""
    from vouch.operators.graph import skip_by_graph, status_columns

    orders = Tables(spark, sf_dir).orders
    oid = lambda c: F.concat(F.lit("orders-"), c.cast("string"))
    raw = orders.select(
        F.lit("orders").alias("suite"),
        oid(F.col("o_orderkey")).alias("test_id"),
        F.col("o_orderkey").alias("seq"),
        ((F.col("o_totalprice") < 490000) & (F.col("o_orderkey") != 2)).alias("raw_passed"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("check_points"),
        F.array(oid(F.floor(F.col("o_orderkey") / 2)), oid(F.floor(F.col("o_orderkey") / 3)),
                F.when(F.col("o_orderkey") <= 150, oid(F.col("o_orderkey") - 1)),
                F.when(F.col("o_custkey") % 3 == 0, F.lit("orders-140"))).alias("depends_on"),
    )
    j = skip_by_graph(raw, depends_on="depends_on")
    return j.select("suite", "test_id", "seq", *status_columns(F.col("raw_passed"), F.col("skipped"), F.col("check_points"))).select(*SUITE_COLUMNS)


_EVENT_RESULTS_SQL = """hist AS (
  SELECT 'u' || user_id AS test_id, event_id, ts,
         CASE WHEN value >= 10 THEN 'passed' ELSE 'failed' END AS status,
         CASE WHEN value >= 10 THEN 1 + CAST(floor(value / 100) AS INTEGER) ELSE 0 END AS points,
         1 + CAST(floor(value / 100) AS INTEGER) AS max_points FROM events),
latest AS (
  SELECT test_id, event_id, status, points, max_points FROM (
    SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY ts DESC, event_id DESC) AS rn FROM hist) WHERE rn = 1)"""


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results history: one result per event, the check being the user."""
    ev = Tables(spark, sf_dir).events
    ok = F.col("value") >= 10
    maxp = (F.lit(1) + F.floor(F.col("value") / 100).cast("int")).cast("int")
    return ev.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("test_id"),
        "event_id", F.col("ts").alias("run_ts"),
        F.when(ok, F.lit("passed")).otherwise(F.lit("failed")).alias("status"),
        F.when(ok, maxp).otherwise(F.lit(0)).alias("points"),
        maxp.alias("max_points"),
    )


def latest_event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vouch.plans.scoring import latest_results

    return latest_results(event_results(spark, sf_dir), ["run_ts", "event_id"]).select(
        "test_id", "event_id", "status", "points", "max_points")


@query("results_latest", f"WITH {_EVENT_RESULTS_SQL}\nSELECT * FROM latest")
def results_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_event_results(spark, sf_dir)


@query("results_latest_merged", f"WITH {_EVENT_RESULTS_SQL}\nSELECT * FROM latest")
def results_latest_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from three runs, which arrive out of order and are merged one by one."""
    from vouch.plans.scoring import LatestTable
    from vouch.session import work_path

    history = event_results(spark, sf_dir)
    table = LatestTable(spark, work_path(spark, "latest"), ["run_ts", "event_id"])
    for part in (1, 0, 2):
        table.merge(history.where(F.pmod(F.col("event_id"), F.lit(3)) == part))
    return table.read().select("test_id", "event_id", "status", "points", "max_points")


@query("results_rollup", f"""
WITH {_EVENT_RESULTS_SQL},
agg AS (SELECT coalesce(sum(points), 0)::BIGINT AS score, coalesce(sum(max_points), 0)::BIGINT AS max_score FROM latest)
SELECT score, max_score,
       CASE WHEN max_score = 0 THEN 0 ELSE CAST(trunc(CAST(score AS DOUBLE) * 100.0 / max_score) AS BIGINT) END AS percentage,
       CASE WHEN max_score = 0 THEN false ELSE CAST(trunc(CAST(score AS DOUBLE) * 100.0 / max_score) AS BIGINT) = 100 END AS passed
FROM agg
""")
def results_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vouch.plans.scoring import rollup

    return rollup(latest_event_results(spark, sf_dir))


@query("results_summary", f"""
WITH {_EVENT_RESULTS_SQL},
agg AS (SELECT coalesce(sum(points), 0)::BIGINT AS score, coalesce(sum(max_points), 0)::BIGINT AS max_score FROM latest)
SELECT score AS passing, max_score - score AS failing,
       CASE WHEN max_score = 0 THEN 0 ELSE CAST(trunc(CAST(score AS DOUBLE) * 100.0 / max_score) AS BIGINT) END AS percentage
FROM agg
""")
def results_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vouch.plans.scoring import summary

    return summary(latest_event_results(spark, sf_dir))


@query("suite_report", f"""
SELECT sr.suite, sr.test_id, sr.seq, sr.points, m.description, sr.status,
       CASE WHEN sr.status = 'failed' THEN m.hint END AS hint,
       CASE WHEN sr.status <> 'skipped' AND length(m.message) > 0 THEN m.message END AS message
FROM ({ORACLE['suite_results']}) sr
JOIN (VALUES
  ('orders_contract-discount_range', 'Discounts lie in [0, 0.1]', NULL, ''),
  ('orders_contract-keys_present', 'Every order has a key', NULL, ''),
  ('orders_contract-one_order_per_customer', 'One order per customer',
   'Found ' || (SELECT count(DISTINCT o_custkey) FROM orders) || ' customers', ''),
  ('orders_contract-dates_present', 'Order dates are present', NULL, ''),
  ('orders_contract-status_known', 'Known order status', NULL, ''),
  ('orders_contract-flag_known', 'Known return flag', NULL, ''),
  ('orders_contract-has_comment', 'Execute prerequisites. missing columns: l_comment', NULL, 'missing columns: l_comment'),
  ('orders_contract-comment_short', 'Comments are short', NULL, ''),
  ('orders_contract-manual_review', 'Reviewed by a person', NULL, ''),
  ('orders_contract-price_recomputes', 'Discounted price recomputes', NULL, '')
) AS m(test_id, description, hint, message) ON m.test_id = sr.test_id
""")
def suite_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vouch.plans.scoring import report

    return report(orders_contract(spark, sf_dir).results())


_ESCAPE_SQL = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("render_hints", f"""
WITH wanted AS (SELECT doc_id FROM documents UNION ALL SELECT -1 - item_id FROM benchmark)
SELECT w.doc_id,
       replace(replace(CASE WHEN l.toxic = 1 THEN 'Flagged text: [[ACTUAL_VALUE]]'
                            ELSE 'Text of [[LEN_ACTUAL_VALUE]] characters: [[ACTUAL_VALUE]]' END,
                       '[[ACTUAL_VALUE]]', {_ESCAPE_SQL.format(x="coalesce(d.text, 'None')")}),
               '[[LEN_ACTUAL_VALUE]]',
               coalesce(CAST(length(d.text) AS VARCHAR), {_ESCAPE_SQL.format(x="coalesce(d.text, 'None')")})) AS hint
FROM wanted w LEFT JOIN labels l ON l.doc_id = w.doc_id LEFT JOIN documents d ON d.doc_id = w.doc_id
""")
def render_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints of per-document checks filled with the whole document text, for
    all documents and an absent one for each benchmark item."""
    from vouch.functions.text import render_hint

    t = Tables(spark, sf_dir)
    docs = t.documents.select("doc_id", "text")
    wanted = t.documents.select("doc_id").unionByName(t.benchmark.select((-1 - F.col("item_id")).alias("doc_id")))
    j = wanted.join(t.labels.select("doc_id", "toxic"), "doc_id", "left").join(docs, "doc_id", "left")
    template = F.when(F.col("toxic") == 1, F.lit("Flagged text: [[ACTUAL_VALUE]]")).otherwise(
        F.lit("Text of [[LEN_ACTUAL_VALUE]] characters: [[ACTUAL_VALUE]]"))
    return j.select("doc_id", render_hint(template, F.col("text"), F.length("text")).alias("hint"))


@query("suite_computed_once", f"""
SELECT status, count(*) AS checks, sum(points)::BIGINT AS points FROM ({ORACLE['suite_results']}) GROUP BY status
""")
def suite_computed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11: the suite runs once, is kept, and is then read for what is asked of it."""
    suite = orders_contract(spark, sf_dir)
    kept = suite.materialise()
    assert suite.results() is kept
    return kept.groupBy("status").agg(F.count(F.lit(1)).alias("checks"), F.sum("points").cast("bigint").alias("points"))


@query("expect_custom_errors", """
SELECT 'errors' AS suite, 'errors-' || id AS test_id, seq, CASE WHEN ok THEN 'passed' WHEN skip THEN 'skipped' ELSE 'failed' END AS status,
       CASE WHEN ok THEN 1 ELSE 0 END AS points
FROM (VALUES ('price', 1, (SELECT count(*) FILTER (o_totalprice <= 0) = 0 FROM orders), false), ('cast', 2, false, false),
             ('division', 3, false, false), ('after_cast', 4, false, true),
             ('status', 5, (SELECT count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) = 0 FROM orders), false)) AS v(id, seq, ok, skip)
""")
def expect_custom_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that raise while data is read fail alone, beside checks that pass."""
    orders = Tables(spark, sf_dir).orders
    s, none = Suite("errors", spark), [NO_PREVIOUS]
    s.expect(orders, F.col("o_totalprice") > 0, "price", test_id="price", depends_on=none)
    s.expect(orders, F.col("o_orderpriority").cast("int") > 0, "text as number", test_id="cast", depends_on=none)
    s.expect(orders, F.lit(1) / (F.col("o_custkey") - F.col("o_custkey")) > 0, "division", test_id="division", depends_on=none)
    s.expect(orders, F.col("o_orderstatus").cast("int") > 0, "never run", test_id="after_cast", depends_on=["cast"])
    s.expect_in(orders, "o_orderstatus", ["F", "O", "P"], "status", test_id="status", depends_on=none)
    return s.materialise().select(*SUITE_COLUMNS)


@query("expect_equals_exact", """
WITH n AS (SELECT count(*) > 0 AS filled FROM lineitem)
SELECT 'exact' AS suite, 'exact-' || id AS test_id, seq, CASE WHEN ok AND filled THEN 'passed' ELSE 'failed' END AS status,
       CASE WHEN ok AND filled THEN 1 ELSE 0 END AS points
FROM (VALUES ('cent', 1, false), ('same', 2, true), ('long_double', 3, false), ('decimal_long', 4, true), ('text', 5, false),
             ('decimal_double', 6, false), ('decimal_double_same', 7, true), ('tenth', 8, false), ('array_kind', 9, false)) AS v(id, seq, ok), n
""")
def expect_equals_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that differ by a cent, 2^53 + 1 against 2^53 as a double, a decimal
    count and a count as text."""
    li = Tables(spark, sf_dir).lineitem
    total = F.sum(F.col("l_extendedprice").cast("decimal(20,2)")) + F.lit(Decimal("12345678901234567890.00"))
    s, none = Suite("exact", spark), [NO_PREVIOUS]
    s.expect_equals(li, total, total + F.lit(Decimal("0.01")), "a cent more", test_id="cent", depends_on=none)
    s.expect_equals(li, total, total + F.lit(Decimal("0.00")), "the same", test_id="same", depends_on=none)
    s.expect_equals(li, F.max(F.lit(2 ** 53 + 1)), F.max(F.lit(float(2 ** 53))), "long and double", test_id="long_double", depends_on=none)
    s.expect_equals(li, F.count(F.lit(1)), F.sum(F.lit(Decimal("1.00"))), "count as decimal", test_id="decimal_long", depends_on=none)
    s.expect_equals(li, F.count(F.lit(1)), F.count(F.lit(1)).cast("string"), "count as text", test_id="text", depends_on=none)
    big = F.max(F.lit(Decimal(2 ** 53 + 1)))
    s.expect_equals(li, big, F.max(F.lit(float(2 ** 53))), "decimal and double", test_id="decimal_double", depends_on=none)
    s.expect_equals(li, big - F.lit(Decimal(1)), F.max(F.lit(float(2 ** 53))), "the same number", test_id="decimal_double_same", depends_on=none)
    s.expect_equals(li, F.max(F.lit(Decimal("0.1"))), F.max(F.lit(0.1)), "a tenth is no double", test_id="tenth", depends_on=none)
    s.expect_equals(li, F.array(F.max("l_linenumber")), F.array(F.max("l_linenumber").cast("string")), "numbers and texts", test_id="array_kind", depends_on=none)
    return s.results().select(*SUITE_COLUMNS)


_REPEATED_SQL = """a AS (SELECT NULLIF(l_orderkey, 1) AS k, l_returnflag AS f, l_linestatus AS s FROM lineitem),
b AS (SELECT k, CASE WHEN f = 'R' THEN 'A' ELSE f END AS f, s FROM a WHERE s <> 'F' OR f <> 'N'),
r AS (SELECT k, f, s, sum(x) AS x, sum(y) AS y FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY k, f, s),
g AS (SELECT k, sum(x - least(x, y)) AS x, sum(y - least(x, y)) AS y FROM r GROUP BY k)"""


@query("expect_rows_repeated", f"""
WITH {_REPEATED_SQL}
SELECT 'actual_only' AS side, coalesce(sum(x - least(x, y)), 0)::BIGINT AS rows_differing FROM g
UNION ALL SELECT 'expected_only', coalesce(sum(y - least(x, y)), 0)::BIGINT FROM g
UNION ALL SELECT 'changed', coalesce(sum(least(x, y)), 0)::BIGINT FROM g
""")
def expect_rows_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a key that repeats and may be NULL: changed, lost and equal rows."""
    from vouch.operators.compare import keyed_difference

    key = F.when(F.col("l_orderkey") != 1, F.col("l_orderkey")).alias("k")
    a = Tables(spark, sf_dir).lineitem.select(key, F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"))
    b = a.where((F.col("s") != "F") | (F.col("f") != "N")).withColumn("f", F.when(F.col("f") == "R", F.lit("A")).otherwise(F.col("f")))
    return keyed_difference(a, b, ["k"])


_NESTED = {  # case: the column as it is, the other column, whether rows differ by it
    "array_of_text": ("array(l_linenumber)", "array(cast(l_linenumber as string))", "true"),
    "struct_of_text": ("named_struct('k', l_linenumber)", "named_struct('k', cast(l_linenumber as string))", "true"),
    "map_of_text": ("map('k', array(l_linenumber))", "map('k', array(cast(l_linenumber as string)))", "true"),
    "array_of_double": ("array(l_orderkey + 9007199254740993L)", "array(cast(l_orderkey + 9007199254740993L as double))", "true"),
    "wider": ("array(l_linenumber)", "array(cast(l_linenumber as bigint))", "false"),
    "map_order": ("map('a', l_linenumber, 'b', 0)", "map('b', 0, 'a', l_linenumber)", "false"),
    "one_changed": ("map('k', named_struct('n', l_linenumber))", "map('k', named_struct('n', if(l_linenumber = 3, -3, l_linenumber)))", "l_linenumber = 3"),
}


@query("expect_nested_exact", "\nUNION ALL\n".join(
    f"SELECT '{case}' AS \"case\", count(*) FILTER ({differs}) AS actual_only, count(*) FILTER ({differs}) AS expected_only FROM lineitem"
    for case, (_a, _b, differs) in _NESTED.items()))
def expect_nested_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose nested column differs in kind or in value somewhere inside."""
    from vouch.operators.compare import bag_difference

    li = Tables(spark, sf_dir).lineitem
    out = None
    for case, (left, right, _differs) in _NESTED.items():
        sides = bag_difference(*[li.select("*", F.expr(v).alias("nested")) for v in (left, right)])
        row = sides.groupBy().pivot("side", ["actual_only", "expected_only"]).agg(F.first("rows_differing")).select(F.lit(case).alias("case"), "actual_only", "expected_only")
        out = row if out is None else out.unionByName(row)
    return out
