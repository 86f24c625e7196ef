"""Listing, manifest diff, verdict, repair (FIXTURES section 2: manifest)."""

import os
import tempfile

from pyspark.sql import functions as F

from vouch.sources import datasets as D
from vouch.sources.files import list_files


def test_listing_relative_with_dirs_and_hidden(spark):
    root = tempfile.mkdtemp(prefix="vouch-list-")
    os.makedirs(f"{root}/a/b")
    for rel in ["top.txt", "a/one.txt", "a/b/two.txt", "_hidden.txt", ".dot", "a/_meta"]:
        with open(f"{root}/{rel}", "w") as f:
            f.write("x" * 3)
    got = {(r.path, r.is_dir) for r in list_files(spark, root).collect()}
    assert got == {("top.txt", False), ("a/one.txt", False), ("a/b/two.txt", False), ("a/", True), ("a/b/", True)}
    assert list_files(spark, root + "/missing").count() == 0


def test_manifest_diff_reports_everything(spark):
    local = spark.createDataFrame([("a/",), ("a/x",), ("extra.txt",), ("b/",)], "path string")
    remote = spark.createDataFrame([("a/",), ("a/x",), ("a/y",), ("c/",)], "path string")
    got = {(r.diff, r.kind, r.path) for r in D.manifest_diff(local, remote).collect()}
    assert got == {("extra", "file", "extra.txt"), ("extra", "path", "b/"), ("missing", "file", "a/y"), ("missing", "path", "c/")}
    v = D.validate(local, remote).first()
    assert (v.valid, v.extra, v.missing) == (False, 2, 2)
    same = D.validate(local, local).first()
    assert same.valid


def test_length_option(spark):
    a = spark.createDataFrame([("f", False, 3)], "path string, is_dir boolean, length long")
    b = spark.createDataFrame([("f", False, 4)], "path string, is_dir boolean, length long")
    assert D.validate(a, b).first().valid
    v = D.validate(a, b, compare_length=True).first()
    assert not v.valid and v.changed == 1


def test_repair_restores_source_with_repeated_keys_and_rows(spark):
    from vouch.operators.compare import bag_difference
    from vouch.session import work_path

    src = spark.range(0, 200).select((F.col("id") % 50).alias("k"), (F.col("id") % 100).alias("v"), F.lit(None).cast("string").alias("s"))
    changed = src.withColumn("v", F.when(F.col("k") == 3, F.lit(-1).cast("long")).otherwise(F.col("v")))
    damaged = changed.where(F.col("k") < 40).unionByName(src.where(F.col("k") == 7)).unionByName(
        spark.createDataFrame([(999, 0, "x")], "k long, v long, s string"))
    fixed = D.repair_table(src, damaged, ["k"], work_path(spark, "t-repair"))
    assert {r.side: r.rows_differing for r in bag_difference(src, fixed).collect()} == {"actual_only": 0, "expected_only": 0}
    assert fixed.count() == 200


def test_install_makes_any_copy_right(spark):
    from vouch.session import path_exists, work_path

    source, target = work_path(spark, "t-src"), work_path(spark, "t-dst")
    spark.range(100).write.parquet(source)
    for damaged in (spark.range(90), spark.range(120), spark.range(100).union(spark.range(5)), spark.range(3).selectExpr("cast(id as string) x")):
        damaged.write.mode("overwrite").parquet(target)
        assert sorted(r.id for r in D.install_table(spark, source, target).collect()) == list(range(100))
    half = work_path(spark, "t-half")
    spark.range(100).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(half)
    assert not path_exists(spark, half + "/_SUCCESS") and not D.is_complete(spark, half)
    assert D.install_table(spark, source, half).count() == 100 and D.is_complete(spark, half)


def test_listing_errors_are_raised(spark):
    import pytest

    from vouch.sources.files import list_tree

    with pytest.raises(Exception):
        list_tree(spark.createDataFrame([("nosuchscheme://bucket/x",)], "root string")).collect()


def test_staged_choice(spark):
    from vouch.session import work_path

    staged = work_path(spark, "t-staged")
    spark.range(0).write.parquet(staged)
    assert D.choose_source(spark, staged, "remote") == "remote"
    spark.range(3).write.mode("overwrite").parquet(staged)
    assert D.choose_source(spark, staged, "remote") == staged
    assert D.choose_source(spark, staged + "-missing", "remote") == "remote"


def test_readme_line_counts(spark):
    root = tempfile.mkdtemp(prefix="vouch-readme-")
    os.makedirs(f"{root}/ds1")
    os.makedirs(f"{root}/ds2")
    with open(f"{root}/ds1/README.md", "w") as f:
        f.write("line1\nline2\n")
    with open(f"{root}/ds2/NOTES.txt", "w") as f:
        f.write("only")
    names = spark.createDataFrame([("ds1",), ("ds2",), ("ds3",)], "name string")
    got = {r.name: (r.n_lines, r.found) for r in D.readme_line_counts(spark, names, root, mapping={"ds2": "NOTES.txt"}).collect()}
    assert got == {"ds1": (len("line1\nline2\n".split("\n")) + 1, True), "ds2": (2, True), "ds3": (None, False)}


def test_tree_listing_includes_hidden(spark):
    from vouch.sources.files import list_tree

    root = tempfile.mkdtemp(prefix="vouch-tree-")
    os.makedirs(f"{root}/ds/_delta_log")
    for rel in ["ds/a.parquet", "ds/_delta_log/0.json", "ds/.crc"]:
        with open(f"{root}/{rel}", "w") as f:
            f.write("xy")
    roots = spark.createDataFrame([(f"{root}/ds",), (f"{root}/missing",)], "root string")
    got = {(r.path, r.is_dir, r.length) for r in list_tree(roots).collect()}
    assert got == {("a.parquet", False, 2), ("_delta_log/", True, None), ("_delta_log/0.json", False, 2), (".crc", False, 2)}


def copy_of(spark, n=20_000):
    from vouch.session import work_path

    rows = spark.range(n).select("id", (F.col("id") % 7).alias("g"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id"))).alias("s"))
    rows = rows.unionByName(rows.where("id = 3").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(n // 2)))).drop("x"))  # one row is a third of all
    source = work_path(spark, "t-copy-src")
    rows.write.parquet(source)
    rows = spark.read.parquet(source)
    copy = D.TableCopy(spark, work_path(spark, "t-copy"))
    copy.install(rows, 100)
    return rows, copy


def equal(spark, a, b):
    from vouch.operators.compare import bag_difference

    return {r.rows_differing for r in bag_difference(a, b).collect()} == {0}


def names_of(copy):
    return {f for names in copy.log.latest()[1]["files"].values() for f, _n in names}


def test_repair_writes_only_damaged_buckets(spark):
    rows, copy = copy_of(spark)
    before, path = names_of(copy), copy.path.replace("file:", "")
    assert equal(spark, rows, copy.read()) and copy.damaged(rows) == []
    entry = copy.log.latest()[1]
    (lost, _n), (altered, _m), (cut, _k) = (entry["files"][str(b)][0] for b in (10, 20, 30))
    os.remove(f"{path}/{lost}")
    other = spark.read.parquet(f"{path}/{altered}").withColumn("g", F.col("g") + 1).coalesce(1)
    scratch = tempfile.mkdtemp(prefix="vouch-alter-")
    other.write.mode("overwrite").parquet(scratch)
    part = [f for f in os.listdir(scratch) if f.endswith(".parquet")][0]
    with open(f"{scratch}/{part}", "rb") as f, open(f"{path}/{altered}", "wb") as g:
        g.write(f.read())
    with open(f"{path}/{cut}", "r+b") as f:
        f.truncate(50)
    for name in (lost, altered, cut):  # checksum files of the local file system
        crc = os.path.join(path, os.path.dirname(name), f".{os.path.basename(name)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert copy.damaged(rows) == [10, 20, 30]
    report = copy.repair(rows)
    after = names_of(copy)
    assert equal(spark, rows, copy.read())
    assert report["buckets_written"] == 3 and report["buckets_kept"] == 97
    assert len(before - after) <= 6 and len(before & after) >= 97  # untouched files keep their names
    assert report["rows_kept"] + report["rows_added"] == rows.count() and report["rows_added"] > 0 and report["rows_dropped"] > 0
    assert copy.repair(rows)["buckets_written"] == 0 and names_of(copy) == after
    assert copy.vacuum() == 0  # the first data folder still holds 97 buckets


def test_a_lost_writer_and_a_second_writer(spark):
    import pytest

    from vouch.sources.versions import ConcurrentChange

    rows, copy = copy_of(spark, 300)
    number, entry = copy.log.latest()
    copy._write(rows, {0: 1}, 100)  # data of a writer that was lost before its commit
    assert copy.log.latest() == (number, entry) and equal(spark, rows, copy.read())
    assert copy.log.commit(number, entry) == number + 1
    with pytest.raises(ConcurrentChange):
        copy.log.commit(number, entry)
    assert copy.vacuum(keep=1) == 1 and copy.log.numbers() == [number + 1] and equal(spark, rows, copy.read())


def test_repair_of_rows_in_the_wrong_bucket_and_of_an_empty_source(spark):
    rows, copy = copy_of(spark, 200)
    number, entry = copy.log.latest()
    moved = dict(entry["files"])
    a, b = [k for k in moved][:2]
    copy.log.commit(number, entry | {"files": {k: v for k, v in moved.items() if k not in (a, b)}})  # a version that lost two buckets
    assert copy.damaged(rows) == sorted((int(a), int(b)))
    copy.repair(rows)
    assert equal(spark, rows, copy.read())
    none = rows.limit(0)
    report = copy.repair(none)
    assert report["rows_dropped"] == rows.count() and copy.read().count() == 0
    copy.repair(rows)
    assert equal(spark, rows, copy.read())


def test_repair_table_takes_good_buckets_from_the_copy(spark):
    from vouch.session import work_path

    src = spark.range(3000).selectExpr("id AS k", "id % 10 AS v")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    read = src.mapInArrow(count, src.schema)  # counts the rows of the source that are read
    damaged = src.withColumn("v", F.when(F.col("k") == 5, F.lit(-1).cast("long")).otherwise(F.col("v")))
    out = D.repair_table(read, damaged, ["k"], work_path(spark, "t-good"), buckets=64)
    assert equal(spark, src, out)
    changes = D.row_changes(src, damaged)
    assert changes == {"rows_kept": 2999, "rows_added": 1, "rows_dropped": 1}


def test_contents_are_compared_by_bytes_and_repaired(spark):
    import pytest

    from vouch.sources import content as C

    source, copy = tempfile.mkdtemp(prefix="vouch-c-src-"), tempfile.mkdtemp(prefix="vouch-c-dst-")
    for rel, size in [("a/x.bin", 3000), ("a/y.bin", 10), ("b/c/z.bin", 0), ("top.bin", 1025), ("b/same.bin", 2048)]:
        for root in (source, copy):
            os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
            with open(f"{root}/{rel}", "wb") as f:
                f.write(bytes(i * 7 % 251 for i in range(size)))
    both = [C.file_digests(spark, root, chunk=512) for root in (source, copy)]
    assert C.content_differences(*both).count() == 0
    assert C.differing_folders(*[C.digest_tree(x) for x in both]).count() == 0
    with open(f"{copy}/a/x.bin", "r+b") as f:  # one byte, the length stays
        f.seek(1700)
        f.write(b"\xff")
    os.remove(f"{copy}/b/c/z.bin")
    with open(f"{copy}/b/more.bin", "wb") as f:
        f.write(b"more")
    both = [C.file_digests(spark, root, chunk=512) for root in (source, copy)]
    got = {(r.path, r.diff) for r in C.content_differences(*both).collect()}
    assert got == {("a/x.bin", "changed"), ("b/c/z.bin", "missing"), ("b/more.bin", "extra")}
    assert {r.folder for r in C.differing_folders(*[C.digest_tree(x) for x in both]).collect()} == {"", "a/", "b/", "b/c/"}
    with pytest.raises(C.InvalidDataset, match="a/x.bin"):
        C.validate_folders(spark, {"d": (source, copy)}, fail_fast=True)
    only = C.validate_folders(spark, {"d": (source, copy)}, repair=False)
    assert {(r.path, r.repaired) for r in only.collect()} == {("a/x.bin", False), ("b/c/z.bin", False), ("b/more.bin", False)}
    done = C.validate_folders(spark, {"d": (source, copy), "gone": (source, copy + "-new")})
    assert done.where("dataset = 'd' AND repaired").count() == 3 and done.where("dataset = 'gone' AND diff = 'missing'").count() == 5
    assert C.validate_folders(spark, {"d": (source, copy), "gone": (source, copy + "-new")}, fail_fast=True).count() == 0


def test_a_bucket_of_many_rows_is_written_by_several_tasks(spark, monkeypatch):
    """With more rows a copy is written by more tasks, none of which gets a whole large bucket."""
    from vouch.session import work_path

    monkeypatch.setattr(D, "_TASK_ROWS", 1000)
    rows = spark.range(40_000).selectExpr("id", "id % 7 AS k")
    copy = D.TableCopy(spark, work_path(spark, "t-large"))
    copy.install(rows, buckets=4)
    _number, entry = copy.log.latest()
    sizes = [spark.read.parquet(f"{copy.path}/{n}").count() for names in entry["files"].values() for n, _length in names]
    assert sum(sizes) == 40_000 and max(sizes) <= 5000, sizes  # pieces can meet in a task; before: 4 files of 10,000 rows
    assert sorted(r.id for r in copy.read().select("id").collect()) == list(range(40_000))


def test_changes_of_mostly_equal_tables(spark):
    a = spark.range(5000).selectExpr("id % 1200 AS k", "id % 3 AS v")
    b = a.where("k <> 5").unionByName(a.where("k = 9"))
    assert D.row_changes(a, b, mostly_equal=True) == D.row_changes(a, b)
    assert D.row_changes(a, a, mostly_equal=True) == {"rows_kept": 5000, "rows_added": 0, "rows_dropped": 0}


def test_files_are_hashed_by_chunks_and_never_held_whole(spark, tmp_path):
    import hashlib

    from vouch.sources import content as C

    raw = bytes(i * 7 % 251 for i in range(10_000))
    os.makedirs(tmp_path / "k=a b%")
    for rel in ("top.bin", "k=a b%/x.bin", "_hidden.bin"):
        (tmp_path / rel).write_bytes(raw)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # a file that is loaded whole raises
    try:
        got = {(r.path, r.length, r.digest) for r in C.file_digests(spark, str(tmp_path), chunk=512).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    hashes = [hashlib.sha256(raw[i:i + 512]).hexdigest() for i in range(0, len(raw), 512)]
    digest = hashlib.sha256("".join(hashes).encode()).hexdigest()
    assert got == {(rel, 10_000, digest) for rel in ("top.bin", "k=a b%/x.bin")}


def test_contents_of_more_orders_are_more_files_and_not_larger_ones(spark, monkeypatch):
    """Every file of the damaged statuses is found and repaired, however many there are."""
    from conftest import SMALL_SF
    from vouch.queries import datasets as Q
    from vouch.session import work_path

    base, seen = work_path(spark, "t-contents"), []
    validate = Q.C.validate_folders
    monkeypatch.setattr(Q, "FILE_ROWS", 200, raising=False)
    monkeypatch.setattr(Q, "work_path", lambda *_: base)
    monkeypatch.setattr(Q.C, "validate_folders", lambda *a, **k: seen.append(validate(*a, **k)) or seen[0])
    rows = {tuple(r) for r in Q.validate_contents(spark, SMALL_SF).collect()}
    assert rows == {("orders", "o_orderstatus=F/", "changed", True, 0), ("orders", "o_orderstatus=P/", "missing", True, 0),
                    ("orders", "extra/", "extra", True, 0)}
    source = spark.read.parquet(f"{base}/source")
    sizes = {tuple(r)[:2]: r["count"] for r in source.groupBy("o_orderstatus", F.input_file_name()).count().collect()}
    assert sum(sizes.values()) == spark.read.parquet(f"{SMALL_SF}/orders.parquet").count() and max(sizes.values()) < 200
    by_status = {s: sum(x == s for x, _ in sizes) for s in "FP"}
    assert min(by_status.values()) > 1
    assert {r["diff"]: r["count"] for r in seen[0].groupBy("diff").count().collect()} == {"changed": by_status["F"], "missing": by_status["P"], "extra": 1}


def test_contents_of_orders_without_the_damaged_statuses(spark, tmp_path):
    from conftest import SMALL_SF
    from vouch.queries import datasets as Q

    orders = spark.read.parquet(f"{SMALL_SF}/orders.parquet")
    kept = {"none": orders.where("false"), "open": orders.where("o_orderstatus = 'O'").unionByName(orders.limit(3).withColumn("o_orderstatus", F.lit(None).cast("string")))}
    for name, rows in kept.items():
        rows.write.parquet(f"{tmp_path}/{name}/orders.parquet")
        assert [tuple(r) for r in Q.validate_contents(spark, f"{tmp_path}/{name}").collect()] == [("orders", "extra/", "extra", True, 0)], name
