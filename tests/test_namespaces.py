"""Users and namespaces (FIXTURES section 2: users, inventory)."""

import hashlib
import re

from pyspark.sql import functions as F

from vouch.functions import naming as N
from vouch.operators import namespaces as NS

CFG = N.NamingConfig(course_code="ex-1", product="lab", schema_tag="ws", lesson="Lesson 2", catalog_mode=N.MODE_PER_USER)


def py_clean(v):
    v = re.sub(r"[^a-zA-Z0-9]", "_", v)
    while "__" in v:
        v = v.replace("__", "_")
    return v


def py_names(u):
    local = u.split("@")[0]
    h = hashlib.md5(u.encode()).hexdigest()[:4]
    unique = f"{local}-{h}-lab-ex-1".lower()
    cat_prefix = py_clean(unique).lower()
    schema_prefix = py_clean(f"ws-{local}-{h}-ex-1").lower()
    return unique, cat_prefix, py_clean(f"{cat_prefix}-lesson_2").lower(), schema_prefix, f"{schema_prefix}_lesson_2"


def test_derived_names(spark):
    users = ["mickey.mouse@example.com", "NoAt", "Donald..Duck!!@x.org", "a@b@c"]
    df = spark.createDataFrame([(u,) for u in users], "username string")
    got = {r.username: (r.unique_name, r.catalog_prefix, r.catalog_name, r.schema_prefix, r.schema_name)
           for r in NS.derive_namespaces(df, CFG).collect()}
    assert got == {u: py_names(u) for u in users}


def test_missing_and_stale(spark):
    users = spark.createDataFrame([("ann@x.com",), ("bob@x.com",), ("cy@x.com",)], "username string")
    existing = users.where(F.col("username") != "bob@x.com").select(N.schema_name(F.col("username"), CFG).alias("schema_name"))
    missing = [r.username for r in NS.select_users(users, existing, CFG, NS.MISSING_USERS).collect()]
    assert missing == ["bob@x.com"]
    assert [r.username for r in NS.select_users(users, existing, CFG, NS.CURRENT_USER, current="cy@x.com").collect()] == ["cy@x.com"]
    prefix = py_names("ann@x.com")[3]
    inv = spark.createDataFrame([
        ("spark_catalog", prefix), ("spark_catalog", prefix + "_old_lesson"), ("hive_metastore", prefix + "_x"),
        ("other", prefix + "_y"), ("spark_catalog", "default"), ("spark_catalog", prefix + "zz"),
    ], "catalog string, schema_name string")
    got = {(r.catalog, r.schema_name) for r in NS.stale_namespaces(users, inv, CFG).collect()}
    assert got == {("spark_catalog", prefix), ("spark_catalog", prefix + "_old_lesson"), ("hive_metastore", prefix + "_x")}


def test_inventory_helpers(spark):
    schemas = spark.createDataFrame([("s1",), ("s2",), ("information_schema",)], "schema_name string")
    tables = spark.createDataFrame([("s1", "t1", False), ("s1", "tmp", True), ("s2", "tmp2", True)],
                                   "schema_name string, table_name string, is_temporary boolean")
    got = {(r.schema_name, r.table_name) for r in NS.table_inventory(schemas, tables).collect()}
    assert got == {("s1", "t1"), ("s2", "-none-"), ("information_schema", "-none-")}
    assert {r.schema_name for r in NS.list_schemas(schemas).collect()} == {"s1", "s2"}
    dup = schemas.unionByName(spark.createDataFrame([("s1",)], "schema_name string"))
    probes = spark.createDataFrame([("s1",), ("s2",), ("s9",)], "schema_name string")
    assert {r.schema_name: r.exists for r in NS.schema_exists(dup, probes).collect()} == {"s1": False, "s2": True, "s9": False}


def test_bucket_matches_md5_rule(spark):
    vals = ["/Repos/a/lesson-1", "x", ""]
    df = spark.createDataFrame([(v,) for v in vals], "p string")
    got = [r.b for r in df.select(N.lesson_bucket("p").alias("b")).collect()]
    assert got == [int(hashlib.md5(v.encode()).hexdigest()[:8], 16) % 10000 for v in vals]


def test_catalog_inventory_marks_temporary_views(spark):
    spark.range(3).createOrReplaceTempView("vouch_tmp_view")
    inv = NS.catalog_inventory(spark)
    rows = {(r.table_name, r.is_temporary) for r in inv.collect()}
    assert ("vouch_tmp_view", True) in rows
    perm = NS.table_inventory(inv.select("schema_name").distinct(), inv)
    assert "vouch_tmp_view" not in {r.table_name for r in perm.collect()}


def test_prefixes_equal_a_plain_scan_of_every_end(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from vouch.functions.naming import NamingConfig, clean_text, schema_prefixes_of

    rng = random.Random(3)
    for cfg in (NamingConfig(), NamingConfig(course_code="two-words", schema_tag="w_s", hash_length=3)):
        tag, course = clean_text(cfg.schema_tag).lower(), clean_text(cfg.course_code).lower()
        bits = [tag, course, *course.split("_"), "ab12", "0f3", "abc", "x", "", "bob", "lesson"]
        names = ["_".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(400)] + [f"{tag}__abcd_{course}", f"{tag}_bob_ab12_{course}_ab12_{course}"]
        names += [f"{tag}_{n}" for n in names]
        got = {r.s: r.f for r in spark.createDataFrame([(n,) for n in set(names)], "s string").select("s", schema_prefixes_of(F.col("s"), cfg).alias("f")).collect()}
        for n in set(names):
            want = [n[:i] for i in range(1, len(n) + 1) if (i == len(n) or n[i] == "_") and re.search(f"^{tag}_.+_[0-9a-f]{{{cfg.hash_length}}}_{course}$", n[:i])]
            assert got[n] == want, n


def test_inventory_from_the_catalogs_own_table(spark):
    from vouch.operators import namespaces as NS

    info = spark.createDataFrame([("main", "s", "t", "MANAGED"), ("main", "s", "v", "LOCAL TEMPORARY"), ("main", "s", "n", None)],
                                 "table_catalog string, table_schema string, table_name string, table_type string")
    got = {(r.catalog, r.schema_name, r.table_name, r.is_temporary) for r in NS.catalog_inventory(spark, info).collect()}
    assert got == {("main", "s", "t", False), ("main", "s", "v", True), ("main", "s", "n", False)}
