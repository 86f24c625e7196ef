"""Registered queries for namespace data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.functions import naming as N
from vouch.functions import text as TX
from vouch.functions.values import parse_count
from vouch.operators import namespaces as NS
from vouch.sources.tables import Tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

CFG = N.NamingConfig(course_code="demo", product="lab", schema_tag="ws", lesson="Intro 1",
                     catalog_mode=N.MODE_PER_USER)


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


# SQL spellings of the naming rules (same configuration as CFG).
def _clean(x: str) -> str:
    return f"regexp_replace({x}, '[^a-zA-Z0-9]+', '_', 'g')"


def _schema_prefix(u: str) -> str:
    return f"lower({_clean(f'concat_ws(' + chr(39) + '-' + chr(39) + f', {chr(39)}ws{chr(39)}, split_part({u}, {chr(39)}@{chr(39)}, 1), substr(md5({u}), 1, 4), {chr(39)}demo{chr(39)})')})"


def _schema_name(u: str) -> str:
    return f"({_schema_prefix(u)} || '_intro_1')"


def _unique_name(u: str) -> str:
    return f"lower(concat_ws('-', split_part({u}, '@', 1), substr(md5({u}), 1, 4), 'lab', 'demo'))"


def customer_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).customer
    return c.select("c_custkey", NS.user_column_from(F.col("c_name")).alias("username"))


@query("clean_names", f"""
SELECT 'pages' AS source, page_id AS id, {_clean('url')} AS cleaned FROM pages
UNION ALL
SELECT 'part', p_partkey, {_clean('p_name')} FROM part
""")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    pages = t.pages.select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), TX.clean_string("url").alias("cleaned"))
    parts = t.part.select(F.lit("part").alias("source"), F.col("p_partkey").alias("id"), TX.clean_string("p_name").alias("cleaned"))
    return pages.unionByName(parts)


@query("derive_namespaces", f"""
WITH u AS (SELECT c_name || '@example.com' AS username FROM customer)
SELECT username,
       {_unique_name('username')} AS unique_name,
       lower({_clean(_unique_name('username'))}) AS catalog_prefix,
       'spark_catalog' AS catalog_plain,
       'hive_metastore' AS catalog_shared,
       lower({_clean("concat_ws('-', lower(" + _clean(_unique_name('username')) + "), 'intro_1')")}) AS catalog_name,
       {_schema_prefix('username')} AS schema_prefix,
       {_schema_name('username')} AS schema_name
FROM u
""")
def derive_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    users = customer_users(spark, sf_dir)
    out = NS.derive_namespaces(users, CFG)
    plain = N.catalog_name(F.col("username"), replace(CFG, catalog_mode=N.MODE_PLAIN)).alias("catalog_plain")
    shared = N.catalog_name(F.col("username"), replace(CFG, catalog_mode=N.MODE_SHARED)).alias("catalog_shared")
    return out.select("*", plain, shared)


@query("assign_bucket", """
SELECT page_id, CAST(('0x' || substr(md5(url), 1, 8)) AS BIGINT) % 10000 AS bucket FROM pages
""")
def assign_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = Tables(spark, sf_dir).pages
    return pages.select("page_id", N.lesson_bucket("url").alias("bucket"))


@query("parse_counts", """
WITH per_user AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
raw AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'about ' ELSE ' ' END || regexp_extract(props, ':([^}]*)', 1) AS raw FROM events)
SELECT raw.event_id,
       greatest(CASE WHEN regexp_full_match(trim(raw.raw), '[0-9]+') THEN CAST(trim(raw.raw) AS BIGINT) ELSE 0 END,
                per_user.n) AS student_count
FROM raw JOIN per_user USING (user_id)
""")
def parse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested counts are text (the JSON value after the colon; with a word
    before it for clicks, which is no number); the count used is at least the
    number of events of that user."""
    ev = Tables(spark, sf_dir).events
    per_user = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    lead = F.when(F.col("event_type") == "click", F.lit("about ")).otherwise(F.lit(" "))
    raw = ev.select("event_id", "user_id", F.concat(lead, F.regexp_extract("props", ":([^}]*)", 1)).alias("raw"))
    j = raw.join(per_user, "user_id")
    return j.select("event_id", parse_count(F.col("raw"), F.col("n")).alias("student_count"))


def order_users(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.concat(F.lit("user"), F.col(key).cast("string"), F.lit("@example.com")).alias("username"))


@query("users_missing", f"""
WITH u AS (SELECT DISTINCT 'user' || o_orderkey || '@example.com' AS username FROM orders),
existing AS (SELECT DISTINCT {_schema_name("'user' || l_orderkey || '@example.com'")} AS schema_name FROM lineitem)
SELECT username FROM u WHERE {_schema_name('username')} NOT IN (SELECT schema_name FROM existing)
""")
def users_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users (one per order) whose per-user schema is not in the inventory
    (the schemas of users that have line items)."""
    t = Tables(spark, sf_dir)
    users = order_users(t.orders, "o_orderkey")
    # de-duplicate the keys before deriving names (md5 and regex once per user, not per line item)
    existing = order_users(t.lineitem.select("l_orderkey").distinct(), "l_orderkey").select(
        N.schema_name(F.col("username"), CFG).alias("schema_name"))
    return NS.select_users(users, existing, CFG, NS.MISSING_USERS)


@query("schema_exists", f"""
WITH inv AS (SELECT 'db_' || lower({_clean('n.n_name')}) AS schema_name FROM nation n JOIN (
               SELECT DISTINCT c_nationkey FROM customer
               UNION ALL SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9900) c ON n.n_nationkey = c.c_nationkey),
probes AS (SELECT n_name, 'db_' || lower({_clean('n_name')}) AS schema_name FROM nation)
SELECT p.n_name, p.schema_name, (SELECT count(*) FROM inv WHERE inv.schema_name = p.schema_name) = 1 AS exists
FROM probes p
""")
def schema_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory: a schema per nation of all customers, listed twice for the
    nations of the highest balances (a name found twice does not count as one
    schema); probes: every nation."""
    t = Tables(spark, sf_dir)
    name = lambda c: F.concat(F.lit("db_"), F.lower(TX.clean_string(c)))
    nations = t.customer.select(F.col("c_nationkey").alias("n_nationkey"))
    rich = t.customer.where(F.col("c_acctbal") > 9900).select(F.col("c_nationkey").alias("n_nationkey"))
    listed = nations.distinct().unionByName(rich.distinct())
    inv = listed.join(t.nation, "n_nationkey").select(name(F.col("n_name")).alias("schema_name"))
    probes = t.nation.select("n_name", name(F.col("n_name")).alias("schema_name"))
    return NS.schema_exists(inv, probes)


@query("schemas_listed", f"""
SELECT DISTINCT schema_name FROM (
  SELECT {_schema_name("c_name || '@example.com'")} AS schema_name FROM customer
  UNION ALL SELECT 'default' UNION ALL SELECT 'information_schema')
WHERE schema_name <> 'information_schema'
""")
def schemas_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = customer_users(spark, sf_dir)
    inv = users.select(N.schema_name(F.col("username"), CFG).alias("schema_name"))
    builtin = spark.createDataFrame([(N.DEFAULT_SCHEMA,), (N.INFORMATION_SCHEMA,)], "schema_name string")
    return NS.list_schemas(inv.unionByName(builtin))


@query("table_inventory", f"""
WITH schemas AS (SELECT 'nation_' || lower({_clean('n_name')}) AS schema_name, n_nationkey FROM nation),
tabs AS (SELECT c_nationkey, 'cust_' || c_custkey AS table_name, NOT (c_acctbal > 9900) AS is_temporary FROM customer)
SELECT s.schema_name, coalesce(t.table_name, '-none-') AS table_name
FROM schemas s LEFT JOIN (SELECT * FROM tabs WHERE NOT is_temporary) t ON t.c_nationkey = s.n_nationkey
""")
def table_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema per nation; a table per customer, temporary unless the
    balance is over 9900 - so some schemas have no permanent table."""
    t = Tables(spark, sf_dir)
    schemas = t.nation.select(F.concat(F.lit("nation_"), F.lower(TX.clean_string("n_name"))).alias("schema_name"), "n_nationkey")
    tables = t.customer.select(
        F.col("c_nationkey").alias("n_nationkey"),
        F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("table_name"),
        (~(F.col("c_acctbal") > 9900)).alias("is_temporary"),
    ).join(schemas, "n_nationkey")
    return NS.table_inventory(schemas, tables)


@query("stale_namespaces", f"""
WITH users AS (SELECT c_custkey, c_name || '@example.com' AS username FROM customer),
pref AS (SELECT username, {_schema_prefix('username')} AS prefix FROM users),
inv AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'spark_catalog' WHEN 'O' THEN 'hive_metastore' ELSE 'other_catalog' END AS catalog,
         {_schema_prefix("u.username")} || '_' || lower({_clean('o_orderpriority')}) AS schema_name
  FROM orders o JOIN users u ON u.c_custkey = o.o_custkey
  UNION ALL SELECT 'spark_catalog', 'default')
SELECT DISTINCT p.username, i.catalog, i.schema_name
FROM inv i JOIN pref p ON starts_with(i.schema_name, p.prefix || '_') OR i.schema_name = p.prefix
WHERE i.catalog IN ('spark_catalog', 'hive_metastore') AND i.schema_name <> 'default'
""")
def stale_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory: a schema per order named after its customer's prefix and
    the order priority, in a catalog chosen by status."""
    t = Tables(spark, sf_dir)
    users = customer_users(spark, sf_dir)
    cat = F.when(F.col("o_orderstatus") == "F", F.lit(N.CATALOG_SPARK_DEFAULT)).when(
        F.col("o_orderstatus") == "O", F.lit(N.CATALOG_SHARED_DEFAULT)).otherwise(F.lit("other_catalog"))
    inv = t.orders.join(users.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select(
        cat.alias("catalog"),
        F.concat(N.schema_prefix(F.col("username"), CFG), F.lit("_"), F.lower(TX.clean_string("o_orderpriority"))).alias("schema_name"),
    )
    inv = inv.unionByName(spark.createDataFrame([(N.CATALOG_SPARK_DEFAULT, N.DEFAULT_SCHEMA)], "catalog string, schema_name string"))
    return NS.stale_namespaces(users, inv, CFG).distinct()


@query("classify_paths", """
WITH p AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
SELECT page_id, path,
       CASE WHEN url LIKE '%/' THEN 'path' ELSE 'file' END AS kind,
       regexp_extract(regexp_replace(path, '/+$', ''), '[^/]*$') AS base_name,
       regexp_replace(url, '^https:/+', '/mnt/https/') AS rewritten
FROM p
""")
def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = Tables(spark, sf_dir).pages
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return pages.select(
        "page_id", path.alias("path"), TX.path_kind("url").alias("kind"), TX.base_name(path).alias("base_name"),
        TX.rewrite_scheme("url", "https", "/mnt/https").alias("rewritten"),
    )


@query("parameterised_query", """
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'
""")
def parameterised_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parameters from a published settings map (values are bound)."""
    params = NS.publish_settings(spark, "vouch", {"min_price": "400000", "status": "F", "catalog_name": None})
    orders = Tables(spark, sf_dir).orders
    return NS.with_params(
        spark,
        "SELECT o_orderkey, o_totalprice, o_orderstatus FROM {orders} "
        "WHERE o_totalprice > CAST(:min_price AS DOUBLE) AND o_orderstatus = :status",
        {"min_price": params["min_price"], "status": params["status"]},
        orders=orders,
    )
