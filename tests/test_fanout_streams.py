"""Per-user tables and stream progress."""

from pyspark.sql import functions as F

from vouch.operators import fanout as FO
from vouch.session import work_path
from vouch.streaming import progress as P


def counts(table):
    return {r.u: r.n for r in table.read().groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_user_table_modes(spark):
    rows = spark.createDataFrame([(u, i) for u in range(6) for i in range(u + 1)], "u bigint, i int")
    t = FO.UserTable(spark, work_path(spark, "t-users"), "u", buckets=4)
    first = {r.u: r.action for r in t.create(rows.where(F.col("u") < 3).where(F.col("i") == 0), drop_existing=False).collect()}
    assert first == {0: "created", 1: "created", 2: "created"}
    skip = {r.u: r.action for r in t.create(rows, drop_existing=False).collect()}
    assert skip == {0: "skipped", 1: "skipped", 2: "skipped", 3: "created", 4: "created", 5: "created"}
    assert counts(t) == {0: 1, 1: 1, 2: 1, 3: 4, 4: 5, 5: 6}
    rep = {r.u: r.action for r in t.create(rows.where(F.col("u") < 2), drop_existing=True).collect()}
    assert rep == {0: "replaced", 1: "replaced"}
    assert counts(t) == {0: 1, 1: 2, 2: 1, 3: 4, 4: 5, 5: 6}
    dropped = {r.u: r.action for r in t.drop(spark.createDataFrame([(u,) for u in range(4, 9)], "u bigint")).collect()}
    assert dropped == {4: "dropped", 5: "dropped", 6: "skipped", 7: "skipped", 8: "skipped"}
    assert counts(t) == {0: 1, 1: 2, 2: 1, 3: 4}
    # drop everyone: emptied buckets are removed too
    t.drop(spark.range(0, 10).select(F.col("id").alias("u")))
    assert t.read().count() == 0


def test_per_user_pandas_path(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 1.0)], "u long, v double")

    def spread(pdf):
        return pdf.groupby("u", as_index=False).agg(lo=("v", "min"), hi=("v", "max"))

    got = {r.u: (r.lo, r.hi) for r in FO.apply_per_user(df, "u", spread, "u long, lo double, hi double").collect()}
    assert got == {1: (2.0, 4.0), 2: (1.0, 1.0)}


def test_batch_writer_is_idempotent(spark):
    base = work_path(spark, "t-stream")
    w = P.batch_writer(f"{base}/sink", f"{base}/progress")
    batch = spark.range(10).withColumnRenamed("id", "event_id")
    w(batch, 0)
    w(batch, 0)  # replay of the same batch
    w(spark.range(10, 15).withColumnRenamed("id", "event_id"), 1)
    tot = P.sink_totals(spark, f"{base}/sink", "event_id").first()
    assert (tot.total_rows, tot.distinct_keys) == (15, 15)
    assert P.batches_done(spark, f"{base}/progress") == 2


def test_stream_wait_by_name(spark):
    from conftest import SMALL_SF

    base = work_path(spark, "t-stream2")
    events = spark.read.parquet(f"{SMALL_SF}/events.parquet")
    src = P.stage_files(events, f"{base}/landing", 3, "ts")
    from vouch import Suite

    def per_batch(batch):
        s = Suite("batch", spark)
        s.expect(batch, F.col("value") >= 0, "non-negative values", test_id="value")
        s.expect_not_null(batch, "event_id", "ids present", test_id="ids")
        return s

    q = P.start_file_stream(spark, src, events.schema, f"{base}/sink", f"{base}/progress", f"{base}/ckpt",
                            name="t_stream_wait", checks=per_batch)
    try:
        seen = P.wait_until_ready(spark, "t_stream_wait", f"{base}/progress", min_batches=2, stall=300)
        q.awaitTermination(300)
    finally:
        P.stop_queries([q])
    assert seen >= 2
    assert P.sink_totals(spark, f"{base}/sink", "event_id").first().total_rows == events.count()
    checks = spark.read.parquet(f"{base}/progress_checks")
    assert checks.select("batch_id").distinct().count() == 3
    assert {r.status for r in checks.collect()} == {"passed"}


def test_combine_per_user_matches_single_pass(spark):
    rows = [(1, float(i)) for i in range(3000)] + [(2, 5.0), (2, 7.0), (3, -1.0)]
    df = spark.createDataFrame(rows, "u long, v double").repartition(4)

    def partial(pdf):
        g = pdf.groupby("u", as_index=False).agg(n=("v", "size"), s=("v", "sum"), hi=("v", "max"))
        return g

    def merge(pdf):
        return pdf.groupby("u", as_index=False).agg(n=("n", "sum"), s=("s", "sum"), hi=("hi", "max"))

    got = {r.u: (r.n, r.s, r.hi) for r in FO.combine_per_user(
        df, "u", partial, "u long, n long, s double, hi double", merge, "u long, n long, s double, hi double",
        salts=8).collect()}
    assert got == {1: (3000, float(sum(range(3000))), 2999.0), 2: (2, 12.0, 7.0), 3: (1, -1.0, -1.0)}


def test_new_columns_and_other_types_are_refused(spark):
    import pytest

    from vouch.operators.fanout import UserTable
    from vouch.session import work_path

    t = UserTable(spark, work_path(spark, "t-users"), "u")
    assert t.drop(spark.createDataFrame([("x",)], "u string")).first().action == "skipped"
    t.create(spark.createDataFrame([("a", 1)], "u string, v int"), False)
    for bad in (spark.createDataFrame([("b", 1, 2)], "u string, v int, w int"), spark.createDataFrame([("b", "1")], "u string, v string"),
                spark.createDataFrame([(1, 1)], "u bigint, v int")):
        with pytest.raises(ValueError):
            t.create(bad, False)
    t.create(spark.createDataFrame([("b", 2)], "u string, v int"), False)
    assert sorted((r.u, r.v) for r in t.read().collect()) == [("a", 1), ("b", 2)]


def test_a_failed_stream_raises(spark):
    import pytest
    from pyspark.sql import functions as F

    from vouch.session import work_path
    from vouch.streaming import progress as P

    base = work_path(spark, "t-fail")
    src = P.stage_files(spark.range(20).withColumn("s", F.lit("x")), f"{base}/landing", 2, "id")
    q = P.start_file_stream(spark, src, spark.read.parquet(src).schema, f"{base}/sink", f"{base}/progress", f"{base}/ckpt",
                            transform=lambda d: d.select(F.col("s").cast("int").alias("n")))
    with pytest.raises(Exception):
        P.wait_until_ended(q)


def test_null_users_are_created_replaced_and_dropped(spark):
    t = FO.UserTable(spark, work_path(spark, "t-null-users"), "u", buckets=4)
    rows = spark.createDataFrame([(None, 1), (1, 2)], "u bigint, i int")
    t.create(rows, drop_existing=False)
    again = {r.u: r.action for r in t.create(rows.withColumn("i", F.col("i") + 10), drop_existing=True).collect()}
    assert again == {None: "replaced", 1: "replaced"}
    assert sorted((r.u, r.i) for r in t.read().collect() if r.u) == [(1, 12)] and t.read().where("u IS NULL").first().i == 11
    skip = {r.u: r.action for r in t.create(rows, drop_existing=False).collect()}
    assert skip == {None: "skipped", 1: "skipped"} and t.read().count() == 2
    assert [r.i for r in t.read_user(None).collect()] == [11] and [r.i for r in t.read_user(1).collect()] == [12]
    gone = {r.u: r.action for r in t.drop(spark.createDataFrame([(None,), (5,)], "u bigint")).collect()}
    assert gone == {None: "dropped", 5: "skipped"} and [r.u for r in t.read().collect()] == [1]
    t.create(spark.createDataFrame([(None, 7)], "u bigint, i int"), drop_existing=False)  # after a drop it is new
    assert sorted((r.u is None, r.i) for r in t.read().collect()) == [(False, 12), (True, 7)]


def test_a_drop_writes_tombstones_only_and_a_change_is_seen_whole(spark, monkeypatch):
    from vouch.sources.versions import ConcurrentChange, VersionLog, list_lengths

    t = FO.UserTable(spark, work_path(spark, "t-users-log"), "u", buckets=8)
    rows = spark.range(20_000).selectExpr("IF(id % 3 = 0, 0, id % 500) AS u", "id", "concat('payload ', id) AS p")  # user 0 has a third
    t.create(rows, drop_existing=False)
    before = list_lengths(spark, t.path)
    t.drop(spark.createDataFrame([(u,) for u in (0, 1, 2)], "u bigint"))
    after = list_lengths(spark, t.path)
    assert before.items() <= after.items()  # no file was changed
    assert sum(v for k, v in after.items() if k not in before and k.endswith(".parquet")) < 20_000
    want = {r.u: r.n for r in rows.where("u > 2").groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts(t) == want
    # A writer that is lost after its data, before its commit, changes nothing.
    monkeypatch.setattr(VersionLog, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    for change in (lambda: t.create(rows.where("u < 9"), drop_existing=True), lambda: t.drop(rows.select("u"))):
        try:
            change()
        except RuntimeError as e:
            assert str(e) == "lost"
        assert counts(t) == want
    monkeypatch.undo()
    # Two writers from one version: the second is refused.
    number, entry = t.log.latest()
    t.log.commit(number, entry)
    import pytest

    with pytest.raises(ConcurrentChange):
        t.log.commit(number, entry)
    t.compact()
    assert t.vacuum() > 0 and counts(t) == want and not t.log.latest()[1]["drops"]


def test_a_lost_stream_gives_each_row_once(spark):
    import pytest

    from vouch.streaming.sink import CommittedSink, start_committed_stream

    base = work_path(spark, "t-recover")
    rows = spark.range(400).selectExpr("id", "id % 7 AS v")
    src = P.stage_files(rows, f"{base}/landing", 4, "id")
    sink = CommittedSink(spark, f"{base}/sink", spark.read.parquet(src).schema)
    losses = [("written", 0), ("written", 2), ("committed", 2), ("committed", 3)]

    def watch(step, batch):
        if losses and losses[0] == (step, batch):
            losses.pop(0)
            raise RuntimeError("lost")

    for _ in range(4):
        q = start_committed_stream(spark, src, sink.schema, sink, f"{base}/ckpt", watch=watch)
        with pytest.raises(Exception):
            P.wait_until_ended(q)
        got = [r.id for r in sink.read().collect()]
        assert len(got) == len(set(got)) == (sink.commits().agg(F.sum("rows").alias("n")).first().n or 0)  # rows and progress agree at any time
    P.wait_until_ended(start_committed_stream(spark, src, sink.schema, sink, f"{base}/ckpt", watch=watch))
    assert sorted(r.id for r in sink.read().collect()) == list(range(400))
    assert {r.batch_id: r.attempts for r in sink.attempts().collect()} == {0: 2, 1: 1, 2: 2, 3: 1}


def test_many_users_are_few_calls(spark):
    """Frames of many users go to one call (before: a call for each user and slice)."""
    calls = spark.sparkContext.accumulator(0)
    rows = [(2 ** 53 + i % 400 if i % 7 else None, "ab"[i % 2], float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows + [(5, None, None)] * 3 + [(9, "c", None)] * 20_000, "u long, k string, v double").repartition(4)

    def partial(pdf):
        calls.add(1)
        return pdf.groupby(["u", "k"], as_index=False, dropna=False).agg(n=("v", "size"), hi=("v", "max"))

    def merge(pdf):
        calls.add(1)
        return pdf.groupby("u", as_index=False, dropna=False).agg(n=("n", "sum"), hi=("hi", "max"), k=("k", "nunique"))

    out = FO.combine_users(df, "u", partial, "u long, k string, n long, hi double", merge, "u long, n long, hi double, k long")
    got = {r.u: (r.n, r.hi, r.k) for r in out.collect()}
    want = {r.u: (r.n, r.hi, r.k) for r in df.groupBy("u").agg(
        F.count(F.lit(1)).alias("n"), F.max("v").alias("hi"), F.count_distinct("k").alias("k")).collect()}
    assert got == want
    assert calls.value < 60


def test_per_user_pandas_calls_no_function_for_each_user(spark):
    from conftest import SMALL_SF
    from vouch.queries import all_queries

    plan = all_queries()["per_user_pandas"](spark, SMALL_SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
