"""Queries on the shapes of results, outputs of models and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomgrid.operators import chunking as C
from fathomgrid.operators import results as R
from fathomgrid.registry.base import Named
from fathomgrid.sources.files import glob_regex
from fathomgrid.sources.tables import table

N = Named()


@N.query("strong_symbol_identity", "SELECT id, coalesce(id <> '', false) OR (coalesce(name <> '', false) AND coalesce(file_path <> '', false) AND start_line IS NOT NULL) AS strong FROM graph_nodes")
def strong_symbol_identity(spark, root):
    return table(spark, root, "graph_nodes").select("id", R.strong_identity(*[F.col(c) for c in ("id", "name", "file_path", "start_line", "label")]).alias("strong"))


@N.query("to_rerank_input", "SELECT id, name AS symbol, coalesce(signature, '') AS signature, coalesce(class_name, '') AS class_name, coalesce(signature, name, '') AS content FROM graph_nodes")
def to_rerank_input(spark, root):
    none = F.lit("")
    return table(spark, root, "graph_nodes").select("id", F.col("name").alias("symbol"), F.coalesce("signature", none).alias("signature"), F.coalesce("class_name", none).alias("class_name"), F.coalesce("signature", "name", none).alias("content"))


@N.query("node_to_result", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM documents")
def node_to_result(spark, root):
    return table(spark, root, "documents").select("doc_id", R.short(F.col("text")).alias("snippet"))


@N.query("denormalize", "SELECT result_id, coalesce(CASE WHEN isfinite(rerank_score) THEN rerank_score END, CASE WHEN isfinite(rrf_score) THEN rrf_score END, CASE WHEN isfinite(raw_score) THEN raw_score END) AS score FROM search_results")
def denormalize(spark, root):
    finite = lambda c: F.when(~F.isnan(c), F.col(c))
    return table(spark, root, "search_results").select("result_id", F.coalesce(*[finite(c) for c in ("rerank_score", "rrf_score", "raw_score")]).alias("score"))


@N.query("glob_match", "SELECT doc_id FROM documents WHERE regexp_matches(path, '^util/[^/]*-a[^/]\\.md$')")
def glob_match(spark, root):
    return table(spark, root, "documents").where(F.col("path").rlike(glob_regex("util/*-a?.md"))).select("doc_id")


@N.query("docs_by_file", "SELECT file_path, count(*) AS n FROM graph_nodes WHERE label <> 'file' GROUP BY 1")
def docs_by_file(spark, root):
    return table(spark, root, "graph_nodes").where("label <> 'file'").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


@N.query("docs_by_symbol", "SELECT r.result_id, n.start_line FROM search_results r JOIN graph_nodes n ON n.id = r.node_id WHERE r.source = 'retrieval'")
def docs_by_symbol(spark, root):
    n = table(spark, root, "graph_nodes").select(F.col("id").alias("node_id"), "start_line")
    return table(spark, root, "search_results").where("source = 'retrieval'").select("result_id", "node_id").join(n, "node_id").select("result_id", "start_line")


@N.query("symbol_by_name", "SELECT name, count(*) AS n, min(id) AS first FROM graph_nodes WHERE label <> 'file' GROUP BY 1")
def symbol_by_name(spark, root):
    return table(spark, root, "graph_nodes").where("label <> 'file'").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@N.query("file_imports", "SELECT n.file_path, count(*) AS n FROM graph_relationships r JOIN graph_nodes n ON n.id = r.source WHERE rel_type = 'imports' GROUP BY 1")
def file_imports(spark, root):
    n = table(spark, root, "graph_nodes").select(F.col("id").alias("source"), "file_path")
    return table(spark, root, "graph_relationships").where("rel_type = 'imports'").select("source").join(n, "source").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


@N.query("clean_model_output", "SELECT record_id, trim(regexp_replace(replace('<think>' || q || chr(10) || '</think>' || chr(10) || 'lex: ' || q || '<|im_end|>', '<|im_end|>', ''), '(?s)<think>.*?</think>', '', 'g'), ' ' || chr(10)) AS cleaned FROM (SELECT record_id, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS q FROM qmd_expansion_locations WHERE query IS NOT NULL)")
def clean_model_output(spark, root):
    q = F.trim(F.regexp_replace("query", r"\s+", " "))
    raw = F.concat(F.lit("<think>"), q, F.lit("\n</think>\nlex: "), q, F.lit("<|im_end|>"))
    cleaned = F.trim(F.regexp_replace(F.replace(raw, F.lit("<|im_end|>"), F.lit("")), "(?s)<think>.*?</think>", ""), F.lit(" \n"))
    return table(spark, root, "qmd_expansion_locations").where("query is not null").select("record_id", cleaned.alias("cleaned"))


@N.query("detect_only_mode", "SELECT record_id, regexp_extract(lower(query || ' /only:lex'), '\\s+/only:(lex|vec|hyde)\\s*$', 1) AS only_kind FROM qmd_expansion_locations WHERE query IS NOT NULL")
def detect_only_mode(spark, root):
    asked = F.lower(F.concat("query", F.lit(" /only:lex")))
    return table(spark, root, "qmd_expansion_locations").where("query is not null").select("record_id", F.regexp_extract(asked, r"\s+/only:(lex|vec|hyde)\s*$", 1).alias("only_kind"))


@N.query("normalize_output_items", "SELECT record_id, len(list_filter(output, lambda i: len(i) = 2 AND i[1] IN ('lex', 'vec', 'hyde') AND coalesce(trim(i[2]), '') <> '')) AS kept FROM qmd_expansion_locations WHERE output IS NOT NULL")
def normalize_output_items(spark, root):
    good = F.filter("output", lambda i: (F.size(i) == 2) & F.get(i, F.lit(0)).isin("lex", "vec", "hyde") & (F.coalesce(F.trim(F.get(i, F.lit(1))), F.lit("")) != ""))
    return table(spark, root, "qmd_expansion_locations").where("output is not null").select("record_id", F.size(good).cast("long").alias("kept"))


@N.query("export_graph_json", "SELECT id, label, name FROM graph_nodes")
def export_graph_json(spark, root):
    """Nodes to JSON and back."""
    rows = table(spark, root, "graph_nodes").select(F.to_json(F.struct("id", "label", "name")).alias("j"))
    return rows.select(F.from_json("j", "id string, label string, name string").alias("n")).select("n.*")


@N.query("format_training")
def format_training(spark, root):
    """Pairs as chats of one question and one answer."""
    lines = F.array_join(F.transform("output", lambda i: F.concat_ws(": ", F.get(i, F.lit(0)), F.get(i, F.lit(1)))), "\n")
    say = lambda who, c: F.struct(F.lit(who).alias("role"), c.alias("content"))
    return table(spark, root, "qmd_expansion_locations").where("query is not null and size(output) > 0").select("record_id", F.to_json(F.struct(F.array(say("user", F.col("query")), say("assistant", lines)).alias("messages"))).alias("chat"))


@N.query("best_chunk_by_terms")
def best_chunk_by_terms(spark, root):
    """The piece of each document that holds most of the terms, the first of equals."""
    words = ["cache", "snapshot", "index"]
    pieces = C.chunk_documents(table(spark, root, "documents"))
    score = sum((F.lower("piece").contains(w).cast("int") for w in words), F.lit(0))
    return pieces.groupBy("doc_id").agg(F.max_by(F.struct("seq", "pos"), F.struct(score, -F.col("seq"))).alias("b"), F.max(score).alias("hits")).select("doc_id", "b.seq", "b.pos", "hits")


@N.query("fnv_hash_embed")
def fnv_hash_embed(spark, root):
    nodes = table(spark, root, "graph_nodes").select("id", F.concat_ws(" ", "name", "signature").alias("text"))
    return R.embedded(nodes, "text", lambda texts: [R.hash_embed(t) for t in texts]).select("id", F.size("vector").alias("dims"), F.size(F.filter("vector", lambda x: x != 0)).alias("used"))


@N.query("rerank_model")
def rerank_model(spark, root):
    """Candidates scored by an injected model, here the share of the query's letters in a name."""
    nodes = table(spark, root, "graph_nodes").select("id", "name")
    return R.reranked(nodes, "id", "name", "cache", lambda q, texts: [len(set(q) & set(t.lower())) / len(set(q)) for t in texts])


@N.query("display_path", "WITH p AS (SELECT DISTINCT collection || '/' || path AS p FROM documents), s AS (SELECT p, string_split(p, '/') AS a FROM p), u AS (SELECT p, a, unnest(range(2, len(a) + 1)) AS n FROM s), x AS (SELECT p, n, array_to_string(a[len(a) - n + 1:], '/') AS tail FROM u), c AS (SELECT tail, count(DISTINCT p) AS many FROM x GROUP BY 1) SELECT p AS path, coalesce(min_by(x.tail, n) FILTER (many = 1), p) AS shown FROM x JOIN c ON c.tail = x.tail GROUP BY p")
def display_path(spark, root):
    """The shortest end of a path, of two parts or more, that no other path has."""
    p = table(spark, root, "documents").select(F.concat_ws("/", "collection", "path").alias("path")).distinct()
    a = F.split("path", "/")
    x = p.select("path", F.explode(F.transform(F.sequence(F.lit(2), F.size(a)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(a, F.size(a) - n + 1, n), "/").alias("tail")))).alias("t")).select("path", "t.n", "t.tail")
    c = x.groupBy("tail").agg(F.count(F.lit(1)).alias("many"))
    return x.join(c, "tail").groupBy("path").agg(F.coalesce(F.min_by(F.when(F.col("many") == 1, F.col("tail")), F.when(F.col("many") == 1, F.col("n"))), F.col("path")).alias("shown"))


@N.query("apply_graph_expansion", """WITH r AS (SELECT query_id, node_id, max(rrf_score) AS score FROM search_results WHERE rrf_score IS NOT NULL AND NOT isnan(rrf_score) GROUP BY ALL), t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 10),
e AS (SELECT DISTINCT source, target FROM graph_relationships WHERE rel_type = 'calls' AND target IS NOT NULL), f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY target) <= 5),
n AS (SELECT DISTINCT query_id, target AS node_id FROM t JOIN f ON source = node_id) SELECT * FROM r UNION ALL SELECT query_id, node_id, 0.3::DOUBLE FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = n.query_id AND r.node_id = n.node_id)""")
def apply_graph_expansion(spark, root):
    """The ten best symbols of each query, and up to five callees each of them that the query has not yet, at a score of 0.3."""
    r = table(spark, root, "search_results").where("rrf_score is not null and not isnan(rrf_score)").groupBy("query_id", "node_id").agg(F.max("rrf_score").alias("score"))
    top = r.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))).where("n <= 10").drop("n")
    e = table(spark, root, "graph_relationships").where("rel_type = 'calls' and target is not null").select("source", "target").distinct()
    five = e.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("target"))).where("n <= 5").drop("n")
    new = top.join(five, F.col("node_id") == F.col("source")).select("query_id", F.col("target").alias("node_id")).distinct().join(r.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    return r.unionByName(new.withColumn("score", F.lit(0.3)))


QUERIES, SQL = N.QUERIES, N.SQL
