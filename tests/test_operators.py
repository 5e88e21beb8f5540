import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomgrid.functions import query as Q
from fathomgrid.functions import text as T
from fathomgrid.operators import catalog, chunking, coupling, evaluate, expansion, graph, lexical, parsing, ranking
from fathomgrid.sources import files, formats
from fathomgrid.sources.store import Store
from fathomgrid.streaming import ingest


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("expr", "value", "want"), [
    (lambda c: T.slug_path(c), "My___Notes/Über uns (1).MD", "my/notes/über-uns-1.md"), (lambda c: T.slug_path(c), "a/$.ts", "a/$.ts"), (lambda c: T.slug_path(c), "a/!!.md", None), (lambda c: T.normalize_docid(c), " '#ABC123' ", "abc123"),
    (lambda c: T.is_docid(c), "#abc12", False), (lambda c: T.language(c), "x/y.rs", "rust"), (lambda c: T.language(c), "x/Makefile", None), (lambda c: F.array_join(T.camel_parts(c), "|"), "parseHTMLDoc", "parse|HTML|Doc"),
    (lambda c: F.array_join(T.normalize_identifiers(c), "|"), "getUser_name", "get|user|name"), (lambda c: T.truncate_lines(c, 1), "a\nb\nc", "a\n[... truncated 2 more lines]"), (lambda c: T.escape_csv(c), 'a"b', '"a""b"'),
    (lambda c: T.uri_path(c), "a b/c+d", "a%20b/c%2Bd"), (lambda c: T.virtual_parts(c)["path"], "doc://notes/a/b.md", "a/b.md"), (lambda c: T.virtual_parts(c), "a/b.md", None), (lambda c: T.is_test_path(c), "a/foo_test.go", True), (lambda c: T.is_test_path(c), "a/latest.go", False),
    (lambda c: Q.intent(c), "fetchUser", "exact_symbol"), (lambda c: Q.intent(c), "who calls it", "usage"), (lambda c: Q.intent(c), "src/a/b.ts please", "navigation"), (lambda c: Q.intent(c), "plain words", "hybrid"),
    (lambda c: Q.kind(c)["kind"], "hybridSearch", "exact_identifier"), (lambda c: Q.kind(c)["kind"], "timeout in pool", "bug_error"), (lambda c: Q.kind(c)["kind"], "how does it rank", "semantic"), (lambda c: Q.kind(c)["kind"], "api", "unknown"),
    (lambda c: F.array_join(Q.expanded_terms(c), " "), "retry a-b", "retry backoff exponential timeout reattempt resilience a-b"),
])
def test_scalars(spark, expr, value, want):
    assert one(spark, value, expr) == want
    one(spark, None, expr)  # a null never fails


def test_snippet_and_title(spark):
    got = one(spark, "a\nb cache\nc\nd\ne", lambda c: T.snippet(c, ["cache"]))
    assert (got["line"], got["text"], got["header"]) == (2, "a\nb cache\nc\nd", "@@ -1,4 @@ (0 before, 1 after)")
    assert one(spark, "# Notes\n\n## Real\n", lambda c: T.title(c, F.lit("x/y.md"))) == "Real" and one(spark, "text", lambda c: T.title(c, F.lit("x/y.md"))) == "y"


def test_cosine_and_knn(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 2.0]), (5, [1.0])], "k long, v array<float>")
    got = {r["k"]: r["similarity"] for r in ranking.knn(v, "k", "v", [1.0, 0.0], 10).collect()}
    assert got == {1: 1.0, 2: 0.0, 4: pytest.approx(math.sqrt(0.5)), 5: 0.0}
    assert ranking.knn(v.where("false"), "k", "v", [1.0], 3).count() == 0


def test_bm25_against_brute_force(spark):
    texts = {1: "cache cache store", 2: "Cache, of something else", 3: "nothing", 4: None, 5: ""}
    rows = spark.createDataFrame([(k, v, "x", 0) for k, v in texts.items()], "doc_id long, text string, title string, N int")
    got = {r["doc_id"]: r["raw"] for r in lexical.bm25(rows, "doc_id", {"body": F.col("text")}, {"body": 1.0}, "cache", every=False).collect()}
    toks = {k: [w for w in "".join(c if c.isalnum() else " " for c in (v or "").lower()).split()] for k, v in texts.items()}
    mean, n = sum(map(len, toks.values())) / 5, sum("cache" in t for t in toks.values())
    idf = math.log((5 - n + 0.5) / (n + 0.5))
    for k, t in toks.items():
        f = t.count("cache")
        if f:
            assert got[k] == pytest.approx(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / mean)))
    assert set(got) == {1, 2}
    assert lexical.bm25(rows, "doc_id", {"body": F.col("text")}, {"body": 1.0}, "cach", prefix=True).count() == 2
    assert lexical.bm25(rows, "doc_id", {"body": F.col("text")}, {"body": 1.0}, " ").count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0)], "id string, s double")
    b = spark.createDataFrame([("y", 9.0), ("z", 1.0)], "id string, s double")
    got = {r["id"]: r["score"] for r in ranking.fuse([(a, "s"), (b, "s")], "id", [2.0, 1.0]).collect()}
    assert got["y"] == pytest.approx(2 / 62 + 1 / 61 + 0.05) and got["z"] == pytest.approx(1 / 62 + 0.02)
    model = ranking.blend(a.withColumn("r", F.when(F.col("id") == "x", 50.0)), "s", "r", model=True)
    assert {r["id"]: round(r["final"], 6) for r in model.collect()} == {"x": 1.0, "y": 0.7}


NODES = "id string, label string, name string, file_path string, is_exported int, is_entry_point int"
EDGES = "rel_type string, source string, target string, confidence double"


def test_graph(spark):
    nodes = spark.createDataFrame([("m", "function", "main", "a.py", 0, 0), ("f", "function", "f", "a.py", 0, 0), ("g", "function", "g", "a.py", 0, 0), ("d", "function", "d", "a.py", 0, 0), ("P", "class", "P", "a.py", 0, 0), ("C", "class", "C", "b.py", 0, 0), ("P.r", "method", "r", "a.py", 0, 0), ("C.r", "method", "r", "b.py", 0, 0)], NODES)
    edges = spark.createDataFrame([("calls", "m", "f", 0.5), ("calls", "f", "g", None), ("calls", "g", "f", 1.0), ("calls", "m", "P.r", 1.0), ("calls", "m", "f", 0.9), ("calls", "d", None, None), ("extends", "C", "P", None), ("member_of", "C.r", "C", None), ("member_of", "P.r", "P", None), ("imports", "m", "d", None)], EDGES)
    calls = edges.where("rel_type = 'calls'")
    hit = {(r["id"], r["depth"]) for r in graph.traverse(calls, spark.createDataFrame([("m",)], "start string"), 9).collect()}
    assert hit == {("f", 1), ("P.r", 1), ("g", 2)}
    assert {r["id"] for r in graph.dead_code(nodes, edges).collect()} == {"d"}
    assert {(r["of"], r["id"], r["confidence"]) for r in graph.neighbours(edges, nodes, "calls", "callers").collect()} == {("f", "m", 0.9), ("f", "g", 1.0), ("g", "f", 1.0), ("P.r", "m", 1.0)}
    assert {(r["id"], r["effect"]) for r in graph.impact(calls, spark.createDataFrame([("g",)], "start string"), 1).collect()} == {("f", "will break"), ("m", "may break")}
    assert {r["id"] for r in graph.entry_points(nodes, edges).collect()} == {"m", "d", "C.r"}
    assert graph.traverse(calls, spark.createDataFrame([], "start string")).count() == 0


def test_traverse_keeps_no_pairs_on_disk(spark):
    from pathlib import Path

    from fathomgrid.plans.durable import run_dir

    calls = spark.createDataFrame([(f"n{a}", f"n{b}") for a in range(40) for b in range(40) if a != b], "source string, target string")
    at = Path(run_dir(spark).removeprefix("file:"))
    before = {x.name for x in at.iterdir()} if at.exists() else set()
    hit = graph.traverse(calls, calls.selectExpr("source as start"), 3)
    assert hit.count() == 40 * 39 and {x.name for x in at.iterdir()} <= before


@pytest.mark.parametrize("side", ["callees", "callers", "both"])
def test_traverse_follows_as_it_joins(spark, monkeypatch, side):
    import random

    rng = random.Random(5)
    made = [(f"n{rng.randrange(400)}", f"n{min(rng.randrange(400), rng.randrange(400))}") for _ in range(700)] + [("é", "n1"), ("n2", None), (None, "n3"), ("n4", "")]
    edges = spark.createDataFrame(made, "source string, target string")
    starts = spark.createDataFrame([(f"n{x}",) for x in range(0, 400, 2)] * 2 + [("é",), ("",), ("none",), (None,)], "start string")
    rows = lambda df: sorted((r["start"], r["id"], r["depth"]) for r in df.collect())
    next_to: dict = {}
    for a, b in made:
        for x, y in [(a, b)] * (side != "callers") + [(b, a)] * (side != "callees"):
            if a is not None and b is not None:
                next_to.setdefault(x, set()).add(y)
    want = []
    for start in {f"n{x}" for x in range(0, 400, 2)} | {"é", ""}:
        seen, last = {start}, {start}
        for depth in range(1, 6):
            last = {y for x in last for y in next_to.get(x, ())} - seen
            seen |= last
            want += [(start, x, depth) for x in last]
    monkeypatch.setattr(graph, "PAIRS", 7)
    assert rows(graph.traverse(edges, starts, 5, side)) == sorted(want)
    monkeypatch.setattr(graph, "MOST_CHARS", 10)
    assert rows(graph.traverse(edges, starts, 5, side)) == sorted(want)
    assert graph.traverse(edges.where("false"), starts, 5, side).count() == graph.traverse(edges, starts, 0, side).count() == 0


def test_traverse_of_numbers_in_blocks(spark):
    line = spark.range(300).selectExpr("id as source", "id + 1 as target")
    hit = graph.traverse(line, line.selectExpr("source as start"), 10)
    assert dict(hit.dtypes) == {"start": "bigint", "id": "bigint", "depth": "int"} and hit.where("id - start <> depth").count() == 0
    assert hit.count() == sum(min(10, 300 - x) for x in range(300))


def test_communities_and_modularity(spark):
    links = [(a, b, 1.0) for g in ("abcd", "wxyz") for a in g for b in g if a != b] + [("a", "w", 0.1), ("w", "a", 0.1)]
    df = spark.createDataFrame(links, "a string, b string, w double")
    labels = graph.communities(df)
    got = {r["id"]: r["community"] for r in labels.collect()}
    assert len({got[c] for c in "abcd"}) == 1 and len({got[c] for c in "wxyz"}) == 1 and got["a"] != got["w"]
    k, m2 = {}, sum(w for *_, w in links)
    for a, _, w in links:
        k[a] = k.get(a, 0) + w
    w = {(a, b): x for a, b, x in links}
    want = sum((w.get((i, j), 0) - k[i] * k[j] / m2) / m2 for i in k for j in k if i < j and got[i] == got[j])
    assert graph.modularity(df, labels).first()[0] == pytest.approx(want)
    assert {(r["members"], round(r["cohesion"], 4)) for r in graph.cohesion(df, labels).collect()} == {(4, round(12 / 12.1, 4))}


def test_communities_run_to_their_end(spark):
    line = [f"n{i:02}" for i in range(30)]
    weight = {(a, b): 1.0 + 2 * (30 - i) for i, (a, b) in enumerate(zip(line, line[1:]))}
    links = spark.createDataFrame([(x, y, w) for (a, b), w in weight.items() for x, y in ((a, b), (b, a))] + [("p", "p", 1.0)], "a string, b string, w double")
    got = graph.communities(links).collect()
    assert {(r["community"], r["settled"]) for r in got} == {("n00", True)} and len(got) == 30


def test_processes(spark):
    fn = lambda names: spark.createDataFrame([(n, "function", n, "a.py", 0, 0) for n in names], NODES)
    line = lambda *names: [("calls", a, b, None) for a, b in zip(names, names[1:])]
    chain = [f"n{i:02}" for i in range(13)]
    got = graph.processes(fn(chain), spark.createDataFrame(line(*chain), EDGES)).collect()
    assert [r["depth"] for r in sorted(got, key=lambda r: r["position"])] == list(range(11))
    # a takes b, which is longer; c meets b only after that, takes d, and the last of equals stays
    steps = [(n, k, x, k) for n, ids in (("a", "st"), ("b", "tuv"), ("c", "vw"), ("d", "wx")) for k, x in enumerate(ids)]
    flows = spark.createDataFrame(steps, "entry string, position int, id string, depth int")
    assert {r["entry"] for r in graph.merge_overlapping(flows).collect()} == {"b", "d"}


def test_coupling(spark):
    rows = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "b"), (3, "c")]
    df = spark.createDataFrame([(c, f, "me", None) for c, f in rows], "commit long, file string, author string, at timestamp")
    for most in (1000, 2):
        got = coupling.change_coupling(df, 2, most).collect()
        assert [(r["file_a"], r["file_b"], r["together"], r["strength"]) for r in got] == [("a", "b", 2, 1.0)]


def test_chunks_cover_the_text():
    text = "".join(f"# H{i}\n\n" + "word " * (i * 37 % 90) + "\n```\n" + "code\n" * (i % 7) + "```\n- x\n" for i in range(60))
    for size, overlap, window in ((500, 75, 120), (3600, 540, 800), (50, 60, 20)):
        parts = chunking.chunks(text, size, overlap, window)
        end = 0
        for at, piece in parts:
            assert at <= end and text[at : at + len(piece)] == piece and len(piece) <= size
            end = max(end, at + len(piece))
        assert end == len(text)
    assert chunking.chunks("short") == [(0, "short")] and chunking.chunks("") == [(0, "")]
    assert all(len(p) <= 300 for _, p in chunking.chunk_by_tokens(text, len, 300, 30))


def test_parsers():
    py = parsing.parse_file("a/b.py", "import os\nclass A:\n    def m(self):\n        return f(1)\ndef f(x):\n    return x\n")
    assert [(s[1], s[2], s[6]) for s in py.symbols] == [("class", "A", None), ("method", "m", "A"), ("function", "f", None)] and py.imports == [("os", 1)]
    assert ("method:a/b.py:m", "f", 4, 0.5) in py.calls
    ts = parsing.parse_file("x.ts", "import { a } from './a';\nexport function f(x: number) {\n  if (x) { return g(x); }\n}\ninterface I {\n  a: string;\n}\n")
    assert [(s[1], s[2], s[3], s[4], s[5]) for s in ts.symbols] == [("function", "f", 2, 4, True), ("interface", "I", 5, 7, False)] and ts.calls[0][:2] == ("function:x.ts:f", "g")
    rb = parsing.parse_file("x.rb", "require 'set'\nclass A\n  def m(x)\n    if x\n      g(x)\n    end\n  end\nend\n")
    assert [(s[1], s[2], s[3], s[4]) for s in rb.symbols] == [("class", "A", 2, 8), ("method", "m", 3, 7)]
    assert parsing.parse_file("x.py", "def (").errors and parsing.parse_file("x.txt", "a").symbols == [] and parsing.parse_file("x.go", None).symbols == []


def test_resolve_imports(spark):
    texts = {
        "r/a/one.ts": "import { x } from './Two2';\nimport { y } from '../b';\nimport z from 'lib/three';\nimport './gone';\n",
        "r/a/Two2.tsx": "", "r/a/Two2.js": "", "r/b/index.js": "const q = require('../a/./one');\n", "r/c/my_three.ts": "", "r/c/all.py": "import three\n", "r/c/x.rb": "require_relative '../nothing'\n",
    }
    files = spark.createDataFrame(list(texts.items()), "file_path string, content string")
    got = parsing.resolve_imports(parsing.parse_files(files).where("what = 'import'"), files.select("file_path")).collect()
    assert {(r["file_path"], r["module"], r["resolved"]) for r in got} == {("r/a/one.ts", "./Two2", "r/a/Two2.tsx"), ("r/a/one.ts", "../b", "r/b/index.js"), ("r/a/one.ts", "lib/three", "r/c/my_three.ts"), ("r/a/one.ts", "./gone", None), ("r/b/index.js", "../a/./one", "r/a/one.ts"), ("r/c/all.py", "three", "r/c/my_three.ts"), ("r/c/x.rb", "../nothing", None)}
    apart = files.withColumn("repo_id", F.when(F.col("file_path").contains("three"), "other").otherwise("r"))
    got = parsing.resolve_imports(parsing.parse_files(files).where("what = 'import'"), apart).collect()
    assert {r["module"] for r in got if r["resolved"]} == {"./Two2", "../b", "../a/./one"}


def test_graph_of_files(spark):
    texts = {
        "r/a.ts": "import { B } from './b';\nexport class A extends B<Map<string, K>> implements I, J<string> {\n  run(x: K, y: Promise<Mode>): void {\n  }\n}\nexport function f(a: I[], b: Array<K>,\n  d?: string) {\n  const e: Mode = g(a, { k: A });\n}\n",
        "r/b.ts": "export class B {\n}\nexport interface I {\n}\nexport interface J {\n}\nexport type K = string;\nexport enum Mode {\n}\n",
    }
    _, edges = parsing.graph_of(spark.createDataFrame(list(texts.items()), "file_path string, content string"))
    got = {(r["rel_type"], r["source"], r["target"]) for r in edges.where("rel_type in ('imports', 'extends', 'implements', 'uses_type')").collect()}
    a, f = "class:r/a.ts:A", "function:r/a.ts:f"
    assert got == {("imports", "file:r/a.ts:a.ts", "file:r/b.ts:b.ts"), ("extends", a, "class:r/b.ts:B"), ("implements", a, "interface:r/b.ts:I"), ("implements", a, "interface:r/b.ts:J")} | {("uses_type", s, t) for s, t in ((a, "type_alias:r/b.ts:K"), (a, "enum:r/b.ts:Mode"), (f, "interface:r/b.ts:I"), (f, "type_alias:r/b.ts:K"), (f, "enum:r/b.ts:Mode"))}


def test_expansion_scores(spark):
    cases = [
        ("React hooks guide", "lex: react hooks\nlex: hooks tutorial react\nvec: how do hooks work in react components\nvec: learning state with react hooks step by step", "Excellent"),
        ("a", "nonsense", "Failed"), ("q", "lex: q\nvec: q q q", None), ("find API docs /only:lex", "lex: API reference docs\nlex: docs index for API", "Excellent"), ("x /only:vec", "lex: a", "Failed"), ("", "", None), ("foo", "lex: a<|im_start|>", "Failed"),
    ]
    got = {r["query"]: r for r in expansion.score(spark.createDataFrame([c[:2] for c in cases], "query string, text string")).collect()}
    assert all(got[q]["rating"] == want for q, _, want in cases if want) and got["q"]["share"] <= 50 and got["x /only:vec"]["reason"] == "no vec" and got["foo"]["reason"] == "chat marks"
    assert tuple(got["React hooks guide"])[2:4] == (30, 28)
    assert set(one(spark, "the React API of node.js", expansion.entities)) == {"react", "api", "node.js"} and one(spark, None, expansion.entities) is None
    assert [one(spark, x, expansion.is_generic) for x in ("find information about", "what is it", "guide to renal care")] == [True, True, False]
    assert one(spark, "ring ring ring ring of the the the the", expansion.repetition) == 4
    row = spark.createDataFrame([("q", ["one two three four five", "q", "x"], ["q", "v"])], "q string, lex array<string>, vec array<string>")
    assert row.select(expansion.transform_expansion(F.col("q"), F.col("lex"), F.col("vec"))).first()[0] == [["lex", "one two three"], ["lex", "x"], ["vec", "v"]]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "q long, i string, rank int")
    judged = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "y", 1), (3, "z", 0)], "q long, i string, relevance int")
    got = {r["q"]: (r["recall"], r["mrr"]) for r in evaluate.retrieval_metrics(ranked, judged, "q", "i").collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.0)} and evaluate.hit_rate(ranked, judged, "q", "i", 3).first()[0] == 0.5
    vals = spark.createDataFrame([(float(x),) for x in range(10)] + [(None,)], "v double")
    assert {r["share"]: r["value"] for r in evaluate.index_percentiles(vals, "v").collect()} == {0.1: 1.0, 0.5: 5.0, 0.9: 9.0}


def test_catalog(spark):
    old = spark.createDataFrame([("c", "a", "t", "h1", 1), ("c", "b", "t", None, 1), ("c", "x", "t", "h", 1)], "collection string, path string, title string, hash string, active int")
    new = spark.createDataFrame([("c", "a", "t", "h2"), ("c", "b", "t", None), ("c", "n", "t", "h")], "collection string, path string, title string, hash string")
    got = {r["path"]: r["change"] for r in catalog.difference(old, new, ["collection", "path"], ["hash", "title"]).collect()}
    assert got == {"a": "updated", "b": "unchanged", "n": "new", "x": "gone"}
    assert {r["path"]: r["active"] for r in catalog.deactivate_unseen(old, new, ["collection", "path"]).collect()} == {"a": 1, "b": 1, "x": 0}
    assert {r["hash"] for r in catalog.unreferenced(old, "hash", new, "hash").collect()} == {"h1", None}


def test_files_and_ignore_rules(spark, tmp_path):
    for name, text in {"a.md": "# A", "sub/b.md": "B", "node_modules/c.md": "C", ".hidden/d.md": "D", "blank.md": "  ", "keep/x.md": "X", "sub/skip.md": "S", "e.txt": "E"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rules = files.parse_ignore("# c\n\nskip.md\n/keep/\n!keep/x.md\n")
    assert {r["path"] for r in files.scan(spark, str(tmp_path), "*.md", rules).collect()} == {"a.md", "sub/b.md", "keep/x.md"}
    assert files.ignore_globs(rules) == ["**/skip.md", "keep/**"]
    assert files.git_log(spark, str(tmp_path)).count() == 0
    assert list(files.parse_log("\x00h|me|2024-01-01\na.py\n\n\x00g|you|x\nb.py\n")) == [("h", "me", "2024-01-01", "a.py"), ("g", "you", "x", "b.py")]


def test_configuration(tmp_path):
    path = str(tmp_path / "c.json")
    c = files.add_collection(files.read_config(path), "notes", "/n")
    c = files.set_context(files.set_context(c, "notes", "a/b", "deep"), "notes", "a", "top")
    files.write_config(path, files.rename_collection(c, "notes", "memos"))
    assert files.context_rows(files.read_config(path)) == [("memos", "a/b", "deep"), ("memos", "a", "top")]
    assert files.remove_collection(c, "notes")["collections"] == {} and files.context_rows(files.set_context(c, "notes", "a", None)) == [("notes", "a/b", "deep")]
    with pytest.raises(ValueError):
        files.add_collection(c, "bad name", "/x")


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.save("graph_nodes", spark.createDataFrame([("a",)], "id string"))
    s.save("graph_nodes", s.load("graph_nodes").unionByName(spark.createDataFrame([("b", None, None)], "id string, branch string, commit_sha string")))
    assert s.load("graph_nodes").count() == 2 and "commit_sha" in s.load("graph_nodes").columns and s.tables() == ["graph_nodes"]
    s.compact("graph_nodes")
    assert s.load("graph_nodes").count() == 2
    spark.createDataFrame([("z",)], "id string").write.parquet(str(tmp_path / "store/graph_nodes/half"))  # a save that ended before its pointer
    assert s.load("graph_nodes").count() == 2
    s.drop("graph_nodes")
    with pytest.raises(KeyError):
        s.load("graph_nodes")


def test_formats(spark):
    row = spark.createDataFrame([("abcdef12", 0.456, "a,b.md", 'T "x"', None, 3, "a < b")], "hash string, score double, path string, title string, context string, line int, snippet string")
    got = {f: formats.render(row, f).first()[0] for f in formats.FORMATS}
    assert got["json"] == '{"docid":"#abcdef","score":0.46,"file":"a,b.md","title":"T \\"x\\"","snippet":"a < b"}' and got["csv"] == '#abcdef,0.4560,"a,b.md","T ""x""",,3,a < b'
    assert got["files"] == "#abcdef,0.46,a,b.md" and "a &lt; b" in got["xml"] and got["md"].startswith('---\n# T "x"')
    with pytest.raises(ValueError):
        formats.render(row, "pdf")


def test_streams(spark, tiny, tmp_path):
    out = ingest.drain(ingest.event_windows(ingest.read(spark, tiny, "events")), spark)
    events = spark.read.parquet(f"{tiny}/events.parquet")
    assert out.agg(F.sum("n")).first()[0] == events.count()
    got = ingest.drain(ingest.sessions(ingest.read(spark, tiny, "events"), 30), spark, "append")
    assert got.columns[:4] == ["user_id", "n", "first", "last"] and got.agg(F.min("n")).first()[0] >= 1
    key, order, path = ["user_id"], ["ts", "event_id"], str(tmp_path / "newest")
    users = events.select("user_id").distinct().count()
    for _ in range(2):  # the second run repeats the batches of the first
        stream = ingest.read(spark, tiny, "events").select("user_id", "ts", "event_id")
        q = ingest.keep_newest(stream, path, key, order).option("checkpointLocation", str(tmp_path / f"cp{_}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert ingest.newest(spark, path, key, order).count() == users
    want = {tuple(r) for r in ingest.newest(spark, path, key, order).collect()}
    ingest.compact(spark, path, key, order)
    assert {tuple(r) for r in ingest.newest(spark, path, key, order).collect()} == want and spark.read.parquet(path).count() == users


def test_common_prefix_name():
    assert graph.common_prefix_name(pd.Series(["render_a", "render_b"])) == "render_*" and graph.common_prefix_name(pd.Series([], dtype=object)) == ""
