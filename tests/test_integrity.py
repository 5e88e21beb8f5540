import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathomgrid.operators.changes import ProcessedLedger, changed_keys, since_last_run
from fathomgrid.operators.orphans import ForeignKey, Parent, direct_orphans, orphan_cascade, orphan_report
from fathomgrid.operators.graph import reachable
from fathomgrid.plans.durable import materialize, release
from fathomgrid.plans.skew import hot_keys, lookup_join, positions

T = lambda d: dt.datetime(2024, 1, d)


def _tables(spark):
    a = spark.createDataFrame([("a1", T(1), None), ("a2", T(5), None), ("a3", T(1), T(2))], "id string, created_at timestamp, deleted_at timestamp")
    b = spark.createDataFrame([(1, "b1", "a1", T(3)), (2, "b2", "gone", T(3)), (3, "b3", "a2", T(3)), (4, "b4", "a3", T(3)), (5, "b5", None, T(3)), (6, "b6", "a2", None), (6, "b6", "a2", None)], "no long, id string, a string, created_at timestamp")
    c = spark.createDataFrame([(1, "b2", "c9"), (2, "b1", None), (3, None, None), (4, "nope", None), (5, "b5", None)], "no long, b string, up string")
    return a, b, c


@pytest.mark.parametrize("share", [0.002, 0.0])
def test_direct_orphans(spark, share):
    a, b, _ = _tables(spark)
    got = direct_orphans(b, ForeignKey("b", "a", "no", ("a",), "created_at"), [Parent(a, "id", deleted="deleted_at")], share or 1e-9)
    assert {(r["row_no"], r["status"]) for r in got.collect()} == {(2, "missing"), (3, "late"), (4, "deleted")}
    assert direct_orphans(b.where("false"), ForeignKey("b", "a", "no", ("a",)), [Parent(a, "id")]).count() == 0
    assert direct_orphans(b, ForeignKey("b", "a", "no", ("a",)), [Parent(a.where("false"), "id")]).count() == 6


def test_cascade_and_cycles(spark):
    a, b, c = _tables(spark)
    tables = {"a": Parent(a, "id", deleted="deleted_at"), "b": Parent(b, "id"), "c": Parent(c, "b", created=None)}
    keys = [ForeignKey("b", "a", "no", ("a",), "created_at"), ForeignKey("c", "b", "no", ("b",))]
    got = orphan_cascade(tables, keys)
    rows = {(r["tbl"], r["row_no"], r["kind"], r["depth"]) for r in got.collect()}
    assert rows == {("b", 2, "direct", 0), ("b", 3, "direct", 0), ("b", 4, "direct", 0), ("c", 4, "direct", 0), ("c", 1, "inherited", 1)}
    assert {(r["tbl"], r["month"], r["n"]) for r in orphan_report(got).where("kind = 'direct'").groupBy("tbl", "month").agg(F.sum("n").alias("n")).collect()} == {("b", "2024-01", 3), ("c", "unknown", 1)}
    tree = spark.createDataFrame([(1, "x", "lost"), (2, "y", "x"), (3, "z", "y"), (4, "p", "q"), (5, "q", "p")], "no long, id string, up string")
    found = orphan_cascade({"t": Parent(tree, "id", created=None)}, [ForeignKey("t", "up", "no", ("t",))])
    assert {(r["row_no"], r["kind"], r["depth"]) for r in found.collect()} == {(1, "direct", 0), (2, "inherited", 1), (3, "inherited", 2)}


def test_chains_of_any_length(spark):
    """Neither orphans nor reached nodes end at a number of rounds."""
    line = spark.createDataFrame([(i, f"n{i}", f"n{i - 1}") for i in range(1, 13)], "no long, id string, up string")
    found = orphan_cascade({"t": Parent(line, "id", created=None)}, [ForeignKey("t", "up", "no", ("t",))])
    assert found.count() == 12 and found.agg(F.max("depth")).first()[0] == 11
    assert reachable(line.select(F.col("up").alias("source"), F.col("id").alias("target")), line.where("no = 1").select("id")).count() == 12


def test_changed_keys(spark):
    rows = [
        (1, "r", "same", "h1", T(1), 1), (2, "r", "same", "h1", T(9), 2), (3, "r", "new", "h1", T(8), 2), (4, "r", "back", "a", T(1), 1), (5, "r", "back", "b", T(2), 1), (6, "r", "back", "a", T(9), 2),
        (7, "r", "old", "x", T(1), 1), (8, "r", "nohash", None, T(9), 2), (9, None, "k", "h", T(3), 9), (10, "r", "tie", "p", T(9), 2), (11, "r", "tie", "q", T(9), 2), (12, "s", "done", "h", T(4), 1),
    ]
    df = spark.createDataFrame(rows, "obs_no long, repo string, path string, hash string, at timestamp, run_id long")
    runs = spark.createDataFrame([(1, "success"), (2, "failed"), (2, "failed")], "run_id long, status string")
    got = changed_keys(df, runs, "repo", ["repo", "path"], "hash", "at", "obs_no")
    assert {r["obs_no"] for r in got.collect()} == {3, 6, 9, 11}
    assert changed_keys(df.where("false"), runs, "repo", ["repo", "path"], "hash", "at", "obs_no").count() == 0
    assert changed_keys(df, runs.where("false"), "repo", ["repo", "path"], "hash", "at", "obs_no").count() == 7


def test_since_last_run(spark):
    docs = spark.createDataFrame([(1, "a", T(5), None), (2, "a", T(3), T(4)), (3, "a", None, None), (4, "b", None, None), (5, None, T(1), T(1)), (6, "a", T(4), T(4))], "doc_id long, c string, m timestamp, r timestamp")
    runs = spark.createDataFrame([("a", T(4), "success"), ("a", T(9), "failed"), ("a", T(2), "success"), ("b", T(1), "aborted")], "c string, started_at timestamp, status string")
    assert {r["doc_id"] for r in since_last_run(docs, runs, "c", ["m", "r"]).collect()} == {1, 2, 4, 5, 6}


def test_ledger_survives_failures(spark, tmp_path):
    ledger = ProcessedLedger(spark, str(tmp_path / "ledger"), ["k"], "v")
    rows = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "1"), (None, "1")], "k string, v string")

    def fail(df, folder):
        df.limit(1).write.mode("overwrite").parquet(folder)
        raise RuntimeError("lost")

    write = lambda df, folder: df.write.mode("overwrite").parquet(folder)
    with pytest.raises(RuntimeError):
        ledger.process(rows, "b1", fail)
    assert ledger.pending(rows).count() == 3
    ledger.process(rows, "b1", write)
    assert ledger.pending(rows).count() == 0
    more = rows.unionByName(spark.createDataFrame([("a", "2"), ("c", "1")], "k string, v string"))
    assert {tuple(r) for r in ledger.pending(more).collect()} == {("a", "2"), ("c", "1")}
    ledger.process(more, "b2", write)
    out = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "ledger/out"))
    assert out.count() == 5 == out.distinct().count()

    # a batch that is called again after its mark changes nothing
    ledger.process(more, "b2", fail)
    ledger.process(rows, "b1", write)
    assert ledger.pending(more).count() == 0
    out = spark.read.option("recursiveFileLookup", "true").parquet(*ledger.outputs())
    assert out.count() == 5 == out.distinct().count()
    # pairs whose folder was not written to its end do not count, and the batch is done anew
    last = spark.createDataFrame([("z", "1")], "k string, v string")
    ledger.process(last, "b3", write)
    (tmp_path / "ledger/pairs/part=b3/_SUCCESS").unlink()
    assert ledger.pending(last).count() == 1 and len(ledger.outputs()) == 2
    ledger.process(last, "b3", write)
    assert ledger.pending(last).count() == 0 and len(ledger.outputs()) == 3


def test_skew_plans(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "i long, k string")
    assert hot_keys(df, "k", 0.1, 10) == ["hot"]
    few = spark.createDataFrame([("a",)] * 60 + [(f"k{i}",) for i in range(10000)], "k string")
    assert hot_keys(few, "k", 0.1, 50) == [] and hot_keys(few, "k", 0.005, 50) == ["a"]
    right = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, w int")
    both = [sorted(map(str, lookup_join(df, right, "k", h, how).collect())) for h in ([], ["hot"]) for how in ("left", "left_semi")]
    assert both[0] == both[2] and both[1] == both[3]
    for hot in (50, 1_000_000):
        got = {(r["k"], r["i"]): r["pos"] for r in positions(df, "k", [F.col("i")], hot_rows=hot, parts=4).collect()}
        want = {}
        for i, k in sorted(df.collect()):
            want.setdefault(k, []).append(i)
        assert got == {(k, i): n + 1 for k, v in want.items() for n, i in enumerate(v)}
    table = materialize(df)
    assert table.count() == 301
    release(spark, table)
