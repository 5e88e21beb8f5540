"""Queries on references and on changes: p5_ and p7_."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.operators import changes, orphans
from fathomgrid.operators.orphans import ForeignKey, Parent
from fathomgrid.sources.tables import table

NODES = ("graph_nodes", "shared_symbols")
EDGE_KEYS = [ForeignKey("graph_relationships", c, "rel_no", NODES, "created_at") for c in ("source", "target")]
HASH_KEY = ForeignKey("documents", "hash", "doc_id", ("content_store",), "modified_at")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    tables = {
        "graph_nodes": Parent(table(spark, root, "graph_nodes"), "id", deleted="deleted_at"),
        "shared_symbols": Parent(table(spark, root, "shared_symbols"), "id"),
        "content_store": Parent(table(spark, root, "content_store"), "hash", deleted="deleted_at"),
        "graph_relationships": Parent(table(spark, root, "graph_relationships"), "rel_no"),
        "documents": Parent(table(spark, root, "documents"), "doc_id"),
    }
    return orphans.orphan_cascade(tables, [*EDGE_KEYS, HASH_KEY]).select("tbl", "ref_column", "row_no", "status")


def p5_cascade(spark: SparkSession, root: str) -> DataFrame:
    """Direct and inherited orphans from source files down to nodes, edges, vectors, search candidates and judgments."""
    t = lambda n: table(spark, root, n)
    judged = F.to_json(F.struct("query_id", "node_id"))  # rows without a number of their own
    tables = {
        "parse_results": Parent(t("parse_results"), "file_path", created="parsed_at"),
        "graph_nodes": Parent(t("graph_nodes"), "id", deleted="deleted_at"),
        "shared_symbols": Parent(t("shared_symbols"), "id"),
        "content_store": Parent(t("content_store"), "hash", deleted="deleted_at"),
        "graph_relationships": Parent(t("graph_relationships"), "rel_no"),
        "documents": Parent(t("documents"), "doc_id"),
        "node_embeddings_raw": Parent(t("node_embeddings_raw").select("node_id", "created_at"), "node_id"),
        "search_results": Parent(t("search_results"), "result_id", created=None),
        "search_judgments": Parent(t("search_judgments").withColumn("row_no", judged), "row_no", created=None),
    }
    keys = [
        ForeignKey("graph_nodes", "file_path", "id", ("parse_results",)), *EDGE_KEYS, HASH_KEY,
        ForeignKey("node_embeddings_raw", "node_id", "node_id", ("graph_nodes",), "created_at"),
        ForeignKey("search_results", "node_id", "result_id", ("graph_nodes",)), ForeignKey("search_judgments", "node_id", "row_no", ("graph_nodes",)),
    ]
    return orphans.orphan_cascade(tables, keys).groupBy("tbl", "ref_column", "status", "kind", "depth").agg(F.count(F.lit(1)).alias("n"))


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphans per table, month, column and status."""
    tables = {"graph_relationships": table(spark, root, "graph_relationships"), "documents": table(spark, root, "documents")}
    nodes = [Parent(table(spark, root, "graph_nodes"), "id", deleted="deleted_at"), Parent(table(spark, root, "shared_symbols"), "id")]
    store = [Parent(table(spark, root, "content_store"), "hash", deleted="deleted_at")]
    found = orphans.direct_orphans(tables["graph_relationships"], EDGE_KEYS, nodes).unionByName(orphans.direct_orphans(tables["documents"], HASH_KEY, store))
    return orphans.orphan_report(found.withColumn("kind", F.lit("direct"))).drop("kind")


FILE_KEY = ["repo_id", "branch", "file_path"]


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    runs = table(spark, root, "index_runs")
    files = changes.changed_keys(table(spark, root, "file_hashes"), runs, "repo_id", FILE_KEY, "hash", "scanned_at", "obs_no")
    scopes = runs.where("scope_kind = 'collection'").select(F.col("scope_key").alias("collection"), "started_at", "status")
    docs = changes.since_last_run(table(spark, root, "documents").select("doc_id", "collection", "modified_at", "arrived_at"), scopes, "collection", ["modified_at", "arrived_at"])
    return files.select(F.lit("file_hashes").alias("tbl"), F.col("obs_no").alias("row_no")).unionByName(docs.select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_no")))


_P5 = """WITH k AS (SELECT id AS key, deleted_at, created_at FROM graph_nodes UNION ALL SELECT id, NULL, created_at FROM shared_symbols),
r AS (SELECT 'graph_relationships' AS tbl, 'source' AS ref_column, rel_no AS row_no, source AS key, created_at AS ref_at FROM graph_relationships
 UNION ALL SELECT 'graph_relationships', 'target', rel_no, target, created_at FROM graph_relationships),
o AS (SELECT tbl, ref_column, row_no, ref_at, CASE WHEN k.key IS NULL THEN 'missing' WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN k.created_at > ref_at THEN 'late' END AS status FROM r LEFT JOIN k ON r.key = k.key WHERE r.key IS NOT NULL
 UNION ALL SELECT 'documents', 'hash', doc_id, modified_at AS ref_at, CASE WHEN c.hash IS NULL THEN 'missing' WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN c.created_at > modified_at THEN 'late' END
 FROM documents d LEFT JOIN content_store c ON d.hash = c.hash WHERE d.hash IS NOT NULL) """

_CASCADE = """WITH bad AS (SELECT id FROM graph_nodes g WHERE file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM parse_results p WHERE p.file_path = g.file_path)),
s AS (SELECT id, created_at FROM shared_symbols),
r AS (SELECT 'graph_relationships' AS tbl, 'source' AS ref_column, rel_no::VARCHAR AS row_no, source AS key, created_at AS ref_at, true AS shared FROM graph_relationships
 UNION ALL SELECT 'graph_relationships', 'target', rel_no::VARCHAR, target, created_at, true FROM graph_relationships
 UNION ALL SELECT 'node_embeddings_raw', 'node_id', node_id, node_id, created_at, false FROM node_embeddings_raw
 UNION ALL SELECT 'search_results', 'node_id', result_id::VARCHAR, node_id, NULL, false FROM search_results
 UNION ALL SELECT 'search_judgments', 'node_id', query_id || ':' || coalesce(node_id, ''), node_id, NULL, false FROM search_judgments),
d AS (SELECT tbl, ref_column, row_no, r.key, CASE WHEN n.id IS NOT NULL AND n.deleted_at IS NOT NULL THEN 'deleted' WHEN n.id IS NOT NULL AND n.created_at > ref_at THEN 'late' WHEN n.id IS NULL AND shared AND s.id IS NOT NULL AND s.created_at > ref_at THEN 'late' WHEN n.id IS NULL AND (NOT shared OR s.id IS NULL) THEN 'missing' END AS status
 FROM r LEFT JOIN graph_nodes n ON n.id = r.key LEFT JOIN s ON s.id = r.key WHERE r.key IS NOT NULL),
x AS (SELECT tbl, ref_column, status, 'direct' AS kind, 0 AS depth FROM d WHERE status IS NOT NULL
 UNION ALL SELECT 'graph_nodes', 'file_path', 'missing', 'direct', 0 FROM bad
 UNION ALL SELECT 'documents', 'hash', CASE WHEN c.hash IS NULL THEN 'missing' WHEN deleted_at IS NOT NULL THEN 'deleted' ELSE 'late' END, 'direct', 0 FROM documents d LEFT JOIN content_store c ON d.hash = c.hash WHERE d.hash IS NOT NULL AND (c.hash IS NULL OR deleted_at IS NOT NULL OR c.created_at > modified_at)
 UNION ALL SELECT tbl, ref_column, 'inherited', 'inherited', 1 FROM (SELECT DISTINCT tbl, ref_column, row_no FROM d JOIN bad ON bad.id = d.key WHERE (tbl, ref_column, row_no) NOT IN (SELECT (tbl, ref_column, row_no) FROM d WHERE status IS NOT NULL)))
SELECT tbl, ref_column, status, kind, depth, count(*) AS n FROM x GROUP BY ALL"""

QUERIES = {"p5_found": p5_found, "p5_cascade": p5_cascade, "p5_report": p5_report, "p7_found": p7_found}
SQL = {
    "p5_cascade": _CASCADE,
    "p5_found": _P5 + "SELECT tbl, ref_column, row_no, status FROM o WHERE status IS NOT NULL",
    "p5_report": _P5 + "SELECT tbl, coalesce(strftime(ref_at, '%Y-%m'), 'unknown') AS month, ref_column, status, count(*) AS n FROM o WHERE status IS NOT NULL GROUP BY ALL",
    "p7_found": """WITH f AS (SELECT h.*, coalesce(r.status = 'success', false) AS done FROM file_hashes h LEFT JOIN index_runs r USING (run_id) WHERE hash IS NOT NULL),
n AS (SELECT repo_id, branch, file_path, max_by(obs_no, (scanned_at, obs_no)) AS obs_no, max_by(hash, (scanned_at, obs_no)) AS hash FROM f GROUP BY ALL),
b AS (SELECT repo_id, branch, file_path, max_by(hash, (scanned_at, obs_no)) AS base FROM f WHERE done GROUP BY ALL),
l AS (SELECT scope_key, max(started_at) AS s FROM index_runs WHERE scope_kind = 'collection' AND status = 'success' GROUP BY 1)
SELECT 'file_hashes' AS tbl, obs_no AS row_no FROM n LEFT JOIN b ON n.repo_id IS NOT DISTINCT FROM b.repo_id AND n.branch IS NOT DISTINCT FROM b.branch AND n.file_path IS NOT DISTINCT FROM b.file_path WHERE base IS NULL OR base <> hash
UNION ALL SELECT 'documents', doc_id FROM documents LEFT JOIN l ON collection = scope_key WHERE s IS NULL OR modified_at >= s OR arrived_at >= s""",
}
