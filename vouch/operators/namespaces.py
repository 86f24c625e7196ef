"""Namespaces as data: users, schemas and tables are DataFrames.

Per-user names come from one projection over a users table; "which users
lack a schema", "which schemas are stale" and "does this schema exist" are
joins against an inventory table - never loops over names on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.functions import naming as N

ALL_USERS, MISSING_USERS, CURRENT_USER = "all", "missing", "current"
# Fixed value: the table name listed for a schema without permanent tables.
NO_TABLES = "-none-"


def derive_namespaces(users: DataFrame, cfg: N.NamingConfig, user: str = "username") -> DataFrame:
    return users.select(F.col(user).alias("username"), *N.namespace_columns(F.col(user), cfg))


def select_users(users: DataFrame, existing_schemas: DataFrame, cfg: N.NamingConfig, mode: str,
                 current: str | None = None, user: str = "username", schema: str = "schema_name") -> DataFrame:
    """Users to configure: all, only those whose derived schema is missing
    (a hash anti join against the inventory), or the current user; sorted."""
    u = users.select(F.col(user).alias("username")).distinct()
    if mode == ALL_USERS:
        out = u
    elif mode == MISSING_USERS:
        derived = u.select("username", N.schema_name(F.col("username"), cfg).alias("schema_name"))
        have = existing_schemas.select(F.col(schema).alias("schema_name")).distinct()
        out = derived.join(have, "schema_name", "left_anti").select("username")
    elif mode == CURRENT_USER:
        if current is None:
            raise ValueError("current user mode needs the current user name")
        out = u.where(F.col("username") == F.lit(current))
    else:
        raise ValueError(f"unknown user selection {mode!r}")
    return out.orderBy("username")


def schema_exists(inventory: DataFrame, probes: DataFrame, name: str = "schema_name") -> DataFrame:
    """For each probe name, ``exists`` iff the inventory has it exactly once."""
    counts = inventory.groupBy(F.col(name).alias(name)).agg(F.count(F.lit(1)).alias("_n"))
    j = probes.join(counts, name, "left")
    return j.select(*probes.columns, (F.coalesce(F.col("_n"), F.lit(0)) == 1).alias("exists"))


def list_schemas(inventory: DataFrame, name: str = "schema_name", hide: list[str] | None = None) -> DataFrame:
    hide = [N.INFORMATION_SCHEMA] if hide is None else hide
    return inventory.select(F.col(name).alias("schema_name")).distinct().where(~F.col("schema_name").isin(hide))


def table_inventory(schemas: DataFrame, tables: DataFrame) -> DataFrame:
    """(schema_name, table_name) of permanent tables; a schema without any
    keeps one row with ``-none-`` (left join)."""
    perm = tables.where(~F.coalesce(F.col("is_temporary"), F.lit(False))).select("schema_name", "table_name")
    j = schemas.select("schema_name").distinct().join(perm, "schema_name", "left")
    return j.select("schema_name", F.coalesce(F.col("table_name"), F.lit(NO_TABLES)).alias("table_name"))


def stale_namespaces(users: DataFrame, inventory: DataFrame, cfg: N.NamingConfig, user: str = "username",
                     catalogs: list[str] | None = None) -> DataFrame:
    """Schemas left by users: a prefix of the schema's name equals a user's
    derived prefix (an equi-join on the possible prefixes, not a prefix scan),
    the schema is not ``default``, and it lives in one of the default catalogs."""
    catalogs = catalogs or [N.CATALOG_SPARK_DEFAULT, N.CATALOG_SHARED_DEFAULT]
    prefixes = users.select(F.col(user).alias("username"), N.schema_prefix(F.col(user), cfg).alias("_prefix"))
    inv = inventory.where(F.col("catalog").isin(catalogs) & (F.col("schema_name") != N.DEFAULT_SCHEMA)).select(
        "catalog", "schema_name", F.explode(N.schema_prefixes_of(F.col("schema_name"), cfg)).alias("_prefix"))
    return prefixes.join(inv, "_prefix").select("username", "catalog", "schema_name").distinct()


#: Schemas that the session catalog is asked for one by one.
MOST_SCHEMAS = 1000


def catalog_inventory(spark: SparkSession, information: DataFrame | None = None) -> DataFrame:
    """The session catalog as an inventory: (catalog, schema_name, table_name,
    is_temporary).

    ``information`` is the catalog's own table of tables (table_catalog,
    table_schema, table_name, table_type; ``information_schema.tables`` or an
    export of it), which is read as any table.  Without one each schema of the
    session's catalog is asked for its tables, on the driver: metadata only, and
    for ``MOST_SCHEMAS`` schemas at most (it raises beyond).
    """
    if information is not None:
        kind = F.upper(F.coalesce(F.col("table_type"), F.lit("")))
        return information.select(F.col("table_catalog").alias("catalog"), F.col("table_schema").alias("schema_name"), "table_name",
                                  kind.contains("TEMPORARY").alias("is_temporary"))
    databases = spark.catalog.listDatabases()
    if len(databases) > MOST_SCHEMAS:
        raise ValueError(f"{len(databases)} schemas: pass the catalog's table of tables")
    catalog = spark.catalog.currentCatalog()
    rows = [(catalog, db.name, t.name, bool(t.isTemporary)) for db in databases for t in spark.catalog.listTables(db.name)]
    return spark.createDataFrame(rows, "catalog string, schema_name string, table_name string, is_temporary boolean")


def publish_settings(spark: SparkSession, prefix: str, values: dict[str, str | None]) -> dict[str, str]:
    """Session settings readable from SQL text (``${prefix.name}``); a
    missing value becomes ''.  Returns the map for named parameters."""
    out = {k: ("" if v is None else str(v)) for k, v in values.items()}
    for k, v in out.items():
        spark.conf.set(f"{prefix}.{k}", v)
    return out


def with_params(spark: SparkSession, sql: str, params: dict, **frames: DataFrame) -> DataFrame:
    """Named-parameter SQL (values bound, never spliced into the text)."""
    return spark.sql(sql, args=params, **frames)


def user_column_from(name: Column, domain: str = "example.com") -> Column:
    return F.concat(name, F.lit("@" + domain))
