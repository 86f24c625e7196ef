import hashlib
import random

import edge
from vouch.llm import line_runs as L

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_docs):
    found = {}
    for i, (_, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            found.setdefault(k, set()).add(i)
    common = {k for k, docs in found.items() if k and len(docs) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(out):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()), key=repr)


def test_batches_and_compaction_equal_brute_force(spark):
    rng = random.Random(3)
    lines = ["Licensed", " licensed\t", "", "  ", "É lan", "é lan", "x", "\x0bTail"] + [f"line {i}" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(200)] + [(5, "x\nx"), (5, "x\nx"), (None, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    batches = [spark.createDataFrame(rows[i::7], docs.schema) for i in range(7)]
    for fan_in in (2, 3):
        assert digest(L.drop_common_lines(batches, docs, min_docs=10, fan_in=fan_in)) == brute(rows, 10)


def test_levels_hold_fewer_runs_than_the_fan_in(spark):
    runs = L.LineRuns(spark, 2, fan_in=2)
    for i in range(6):
        runs.add(spark.createDataFrame([(i, f"shared\nown {i}")], "doc_id bigint, text string"))
    assert [len(level) for level in runs.levels] == [0, 1, 1]
    assert runs.common().distinct().count() == 1
    assert runs.known().distinct().count() == 1  # counted no more since a run has shown it
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs._name)]


def test_edge_rows_and_empty_tables(spark):
    docs = edge.documents(spark)
    assert digest(L.drop_common_lines([docs], docs, min_docs=3)) == brute([(r[0], r[1]) for r in edge.ROWS], 3)
    assert L.drop_common_lines([], edge.empty(spark)).count() == 0


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hash")


def test_runs_merge_and_meet_batches_without_an_exchange(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('line ', id % 150, '\nshared ', id % 3) AS text")
    runs = L.LineRuns(spark, 10, fan_in=8, buckets=8)
    for i in range(3):
        runs.add(docs.filter(f"doc_id % 3 = {i}"))
    assert len(runs.runs()) == 3
    assert exchanges(runs._sums(runs.runs())) == 0  # buckets are summed where they lie
    counts = L.batch_counts(docs, 1)
    met = counts.join(spark.table(runs.runs()[0]).hint("merge"), ["h1", "h2"], "left_anti")
    assert exchanges(met) == 1  # that of the batch's own count
    runs.close()


def test_tables_of_one_file_and_of_many_make_batches(spark):
    from vouch.session import work_path

    docs = spark.range(300).selectExpr("id AS doc_id", "concat('a\nb ', id) AS text")
    for files in (1, 20):
        path = work_path(spark, "t-batches")
        docs.repartition(files).write.parquet(path)
        batches = L.file_batches(spark, path)
        assert len(batches) == 8
        ids = [r["doc_id"] for b in batches for r in b.select("doc_id").collect()]
        assert sorted(ids) == list(range(300)) and all(b.count() for b in batches)
    assert len(L.file_batches(spark, path, batch_bytes=max(1, L.path_bytes(spark, path) // 15))) in (15, 16)
