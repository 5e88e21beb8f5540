from pyspark.sql import functions as F

from fathomgrid.operators import coupling, lexical
from fathomgrid.operators.indexing import empty_graph, reindex
from fathomgrid.operators.parsing import graph_of

A, B = "def top(x):\n    return low(x)\n", "def low(x):\n    return x\n"


def _files(spark, **texts):
    return spark.createDataFrame([(f"lib/{k}.py", v) for k, v in texts.items()], "file_path string, content string")


def _edges(df):
    return sorted({(r["rel_type"], r["source"], r["target"], r["line"]) for r in df.collect()}, key=str)


def test_reindex_gives_what_a_whole_run_gives(spark):
    first = _files(spark, a=A, b=B, c="def idle():\n    return 1\n")
    one = reindex(empty_graph(first), first, {"commit_sha": "1"})
    nodes, edges = graph_of(first)
    assert {r["id"] for r in one.nodes.collect()} == {r["id"] for r in nodes.collect()} and _edges(one.edges) == _edges(edges)
    same = reindex(one, first, {"commit_sha": "2"})
    assert {r["change"] for r in same.changes.collect()} == {"unchanged"} and _edges(same.edges) == _edges(edges) and {r["commit_sha"] for r in same.nodes.collect()} == {"1"}
    # b moves its function to d, a stays as it is: its call is resolved anew
    second = _files(spark, a=A, b="def other(y):\n    return top(y)\n", d=B)
    two = reindex(one, second, {"commit_sha": "2"})
    nodes, edges = graph_of(second)
    assert {r["id"] for r in two.nodes.collect()} == {r["id"] for r in nodes.collect()} and _edges(two.edges) == _edges(edges)
    assert {(r["file_path"], r["change"]) for r in two.changes.collect()} == {("lib/a.py", "unchanged"), ("lib/b.py", "updated"), ("lib/c.py", "gone"), ("lib/d.py", "new")}
    third = reindex(two, _files(spark, a=A), None)
    assert {r["target"] for r in third.edges.where("rel_type = 'calls'").collect()} == {None}


def test_text_index_scores_as_a_scan_does(spark, tmp_path):
    texts = ["cache cache store", "Cache, of something else", "nothing", None, "", "store " * 50 + "cache"]
    rows = spark.createDataFrame([(i, t, f"t{i} cache" if i == 2 else None, 1) for i, t in enumerate(texts)], "doc_id long, text string, title string, term int")
    fields, weights = {"body": F.col("text"), "title": F.col("title")}, {"body": 1.0, "title": 3.0}
    index = lexical.TextIndex(str(tmp_path / "i"), "doc_id", buckets=4).build(rows, fields)
    for query, every in (("cache", True), ("cache store", True), ("cache store absent", False), ("absent", True), ("", True)):
        want = {r["doc_id"]: (round(r["raw"], 9), r["n_terms"]) for r in lexical.bm25(rows, "doc_id", fields, weights, query, every).collect()}
        assert {r["doc_id"]: (round(r["raw"], 9), r["n_terms"]) for r in index.search(spark, weights, query, every).collect()} == want
    plan = index.search(spark, weights, "cache")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:80]


def test_change_coupling_of_a_log(spark):
    log = spark.createDataFrame([(c, "x", f) for c in ("1", "2") for f in ("a.ts", "b.ts", "note.md")], "commit string, author string, file string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    couplings, histories, top = coupling.detect_change_coupling(log, ("ts",))
    assert [(r["file_a"], r["file_b"], r["together"]) for r in couplings.collect()] == [("a.ts", "b.ts", 2)] and histories.count() == 2 and top.count() == 2
    assert all(df.count() == 0 for df in coupling.detect_change_coupling(log.where("false"), ("ts",)))
