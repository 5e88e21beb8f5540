"""Queries that cut, parse and describe texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomgrid.operators import chunking as C
from fathomgrid.operators import expansion as X
from fathomgrid.operators import parsing as P
from fathomgrid.registry.base import Named
from fathomgrid.sources.tables import table

N = Named()


@N.query("chunk_document")
def chunk_document(spark, root):
    return C.chunk_documents(table(spark, root, "documents"))


@N.query("embed_work_list")
def embed_work_list(spark, root):
    """The pieces of every distinct active body with the text that goes to an embedder."""
    one = table(spark, root, "documents").where("active = 1 and hash is not null").groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.min_by("title", "doc_id").alias("title"), F.min_by("text", "doc_id").alias("text"))
    pieces = C.chunk_documents(one)
    return pieces.join(one.select("doc_id", "hash", "title"), "doc_id").select("hash", "seq", "pos", F.concat(F.lit("title: "), F.coalesce(F.nullif("title", F.lit("")), F.lit("none")), F.lit(" | text: "), "piece").alias("prompt"))


def _symbols(spark, root):
    files = table(spark, root, "parse_results").select("file_path", "content")
    n = table(spark, root, "graph_nodes").where("label <> 'file'").select("id", "file_path", "start_line", "end_line")
    part = F.slice(F.split("content", "\n"), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    return n.join(files, "file_path").select("id", "start_line", F.array_join(part, "\n").alias("content"))


_SYM = "s AS (SELECT id, start_line, array_to_string(string_split(content, chr(10))[start_line:end_line], chr(10)) AS content FROM graph_nodes JOIN parse_results USING (file_path) WHERE label <> 'file')"


@N.query("extract_lines", f"WITH {_SYM} SELECT id, content FROM s")
def extract_lines(spark, root):
    return _symbols(spark, root).select("id", "content")


@N.query("chunk_symbols", f"WITH {_SYM}, n AS (SELECT *, string_split(content, chr(10)) AS l, greatest(1.0, ceil(length(content) / 4.0) / len(string_split(content, chr(10))))::DOUBLE AS per FROM s), k AS (SELECT *, len(l) AS n, greatest(1, ceil(64 / per))::INT AS step FROM n), b AS (SELECT *, least(greatest(0, ceil(8 / per)), step - 1)::INT AS back, least(5, n) AS head FROM k), p AS (SELECT *, CASE WHEN ceil(length(content) / 4.0) <= 64 THEN [[0, n]] ELSE list_concat([[0, head]], list_transform(range(head, n, step), lambda i: [greatest(0, i - back), least(n, i + step)])) END AS parts FROM b), u AS (SELECT id, start_line, l, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS chunk FROM p) SELECT id, chunk, start_line + p[1] AS first, start_line + p[2] - 1 AS last, array_to_string(l[p[1] + 1:p[2]], chr(10)) AS content FROM u")
def chunk_symbols(spark, root):
    return C.symbol_chunks(_symbols(spark, root), 64, 8)


@N.query("callsite_chunks", "WITH c AS (SELECT * FROM graph_relationships WHERE rel_type = 'calls' AND target IS NOT NULL AND line IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target ORDER BY rel_no) <= 10), j AS (SELECT c.target, c.rel_no, n.name AS caller, c.line, string_split(p.content, chr(10)) AS l FROM c JOIN graph_nodes n ON n.id = c.source JOIN parse_results p USING (file_path)) SELECT target, rel_no, caller, greatest(1, line - 20) AS first, least(len(l), line + 20) AS last, array_to_string(l[greatest(1, line - 20):least(len(l), line + 20)], chr(10)) AS content FROM j WHERE line <= len(l)")
def callsite_chunks(spark, root):
    return C.callsites(table(spark, root, "graph_relationships"), table(spark, root, "graph_nodes"), table(spark, root, "parse_results"))


_REL = "SELECT a AS of, string_agg(name, ', ' ORDER BY n) AS names FROM (SELECT a, name, row_number() OVER (PARTITION BY a ORDER BY name, b) AS n FROM (SELECT DISTINCT {0} AS a, {1} AS b FROM graph_relationships WHERE rel_type = '{2}' AND {0} IS NOT NULL AND {1} IS NOT NULL) JOIN graph_nodes ON id = b) WHERE n <= 10 GROUP BY 1".replace(" AS of", ' AS "of"')


@N.query("node_text", f"""WITH c AS ({_REL.format("source", "target", "calls")}), b AS ({_REL.format("target", "source", "calls")}), u AS ({_REL.format("source", "target", "uses_type")}), m AS ({_REL.format("target", "source", "member_of")})
SELECT id, concat_ws('. ', upper(label[1]) || label[2:] || ' ' || CASE WHEN class_name IS NOT NULL AND label = 'method' THEN class_name || '.' || name ELSE name END, 'with signature ' || signature, 'calls: ' || c.names, 'called by: ' || b.names, 'uses types: ' || u.names, 'members: ' || m.names, 'Location: ' || file_path, 'line ' || start_line) AS text
FROM graph_nodes LEFT JOIN c ON c.of = id LEFT JOIN b ON b.of = id LEFT JOIN u ON u.of = id LEFT JOIN m ON m.of = id""".replace(".of = id", '."of" = id'))
def node_text(spark, root):
    return C.node_text(table(spark, root, "graph_nodes"), table(spark, root, "graph_relationships"))


@N.query("parse_files")
def parse_files(spark, root):
    return P.parse_files(table(spark, root, "parse_results"))


@N.query("ingest_pipeline")
def ingest_pipeline(spark, root):
    """Files to a graph: symbols, and edges by type."""
    nodes, edges = P.graph_of(table(spark, root, "parse_results"))
    count = lambda df, what, c: df.groupBy(F.lit(what).alias("what"), c.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return count(nodes, "node", F.col("label")).unionByName(count(edges, "edge", F.col("rel_type")))


@N.query("file_context_chunks")
def file_context_chunks(spark, root):
    """The imports of each file as one piece."""
    rows = P.parse_files(table(spark, root, "parse_results")).where("what = 'import'")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("first"), "name")))
    return rows.groupBy("file_path").agg(F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("import "), x["name"])), "\n").alias("content"))


@N.query("score_expansion")
def score_expansion(spark, root):
    return X.scored(table(spark, root, "qmd_expansion_locations"))


@N.query("dataset_scores")
def dataset_scores(spark, root):
    s = X.scored(table(spark, root, "qmd_expansion_locations"))
    return s.groupBy("rating").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("share"), 3).alias("mean"), F.min("share").alias("least"), F.max("share").alias("most"))


@N.query("detect_term_issue", "SELECT DISTINCT record_id, term, wrong FROM (SELECT record_id, unnest(string_split_regex(lower(query), '\\s+')) AS term, lower(array_to_string(list_transform(output, lambda i: coalesce(i[2], '')), chr(10))) AS text FROM qmd_expansion_locations WHERE query IS NOT NULL AND output IS NOT NULL) JOIN (VALUES ('tower', 'bus'), ('market', 'tram'), ('bridge', 'ferry')) t(term, wrong) USING (term) WHERE contains(text, wrong)")
def detect_term_issue(spark, root):
    return X.term_issues(table(spark, root, "qmd_expansion_locations"), spark.createDataFrame([("tower", "bus"), ("market", "tram"), ("bridge", "ferry")], "term string, wrong string"))


QUERIES, SQL = N.QUERIES, N.SQL
