"""Queries of the document catalog and its upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomgrid.operators import catalog as C
from fathomgrid.registry.base import Named
from fathomgrid.sources.tables import table

N = Named()
CATALOG = ["collection", "path", "title", "hash", "created_at", "modified_at", "active"]
#: The catalog's rows by collection and path, the newest of each.
_CAT = "cat AS (SELECT collection, path, title, hash, created_at, modified_at, active FROM documents QUALIFY row_number() OVER (PARTITION BY collection, path ORDER BY modified_at DESC NULLS LAST, doc_id) = 1)"


def _docs(spark, root):
    return table(spark, root, "documents")


def _catalog(spark, root):
    return C.keep_latest(_docs(spark, root), ["collection", "path"], [F.col("modified_at").desc_nulls_last(), F.col("doc_id")]).select(*CATALOG)


@N.query("filter_active", "SELECT doc_id, collection, path FROM documents WHERE active = 1")
def filter_active(spark, root):
    return _docs(spark, root).where("active = 1").select("doc_id", "collection", "path")


@N.query("filter_collection", "SELECT doc_id, title FROM documents WHERE active = 1 AND collection = 'handbook'")
def filter_collection(spark, root):
    return _docs(spark, root).where("active = 1 and collection = 'handbook'").select("doc_id", "title")


@N.query("filter_repo_branch_commit_prefix", "SELECT id FROM graph_nodes WHERE repo_id = 'quillgraph' AND branch = 'main' AND file_path ILIKE 'quillgraph/s%'")
def filter_repo(spark, root):
    return table(spark, root, "graph_nodes").where((F.col("repo_id") == "quillgraph") & (F.col("branch") == "main") & F.col("file_path").ilike("quillgraph/s%")).select("id")


@N.query("find_active_document", "SELECT collection, path, min(doc_id) AS doc_id FROM documents WHERE active = 1 GROUP BY ALL")
def find_active_document(spark, root):
    return _docs(spark, root).where("active = 1").groupBy("collection", "path").agg(F.min("doc_id").alias("doc_id"))


@N.query("list_files", "SELECT collection, path, length(text) AS size FROM documents WHERE active = 1 AND path ILIKE 'util/%'")
def list_files(spark, root):
    return _docs(spark, root).where((F.col("active") == 1) & F.col("path").ilike("util/%")).select("collection", "path", F.length("text").cast("long").alias("size")).orderBy("path")


@N.query("join_doc_content", "SELECT doc_id, doc_bytes FROM documents JOIN content_store USING (hash)")
def join_doc_content(spark, root):
    return _docs(spark, root).select("doc_id", "hash").join(table(spark, root, "content_store").select("hash", "doc_bytes"), "hash").select("doc_id", "doc_bytes")


@N.query("insert_content", "SELECT hash, max(from_store) AS from_store FROM (SELECT hash, 1 AS from_store FROM content_store WHERE deleted_at IS NULL UNION ALL SELECT sha256(text), 0 FROM documents WHERE sha256(text) NOT IN (SELECT hash FROM content_store WHERE deleted_at IS NULL)) GROUP BY 1")
def insert_content(spark, root):
    old = table(spark, root, "content_store").where("deleted_at is null").select("hash", F.lit(1).alias("from_store"))
    return C.insert_new(old, _docs(spark, root).select(F.sha2("text", 256).alias("hash"), F.lit(0).alias("from_store")), ["hash"])


@N.query("upsert_document", f"""WITH {_CAT}, o AS (SELECT * FROM cat WHERE modified_at < TIMESTAMP '2024-10-01'), n AS (SELECT collection, path, upper(title) AS title, hash, created_at, TIMESTAMP '2025-06-01' AS modified_at FROM cat WHERE active = 0 OR modified_at >= TIMESTAMP '2024-08-01')
SELECT coalesce(n.collection, o.collection) AS collection, coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN n.path IS NOT NULL THEN n.hash ELSE o.hash END AS hash,
coalesce(o.created_at, n.created_at) AS created_at, CASE WHEN n.path IS NOT NULL THEN n.modified_at ELSE o.modified_at END AS modified_at, CASE WHEN n.path IS NOT NULL THEN 1 ELSE o.active END AS active FROM o FULL JOIN n ON o.collection = n.collection AND o.path = n.path""")
def upsert_document(spark, root):
    cat = _catalog(spark, root)
    new = cat.where("active = 0 or modified_at >= timestamp '2024-08-01'").withColumn("title", F.upper("title")).withColumn("modified_at", F.lit("2025-06-01").cast("timestamp_ntz"))
    return C.merge_documents(cat.where("modified_at < timestamp '2024-10-01'"), new)


@N.query("index_diff", f"""WITH {_CAT}, o AS (SELECT * FROM cat WHERE active = 1), n AS (SELECT collection, path, CASE WHEN length(title) % 3 = 0 THEN title || '!' ELSE title END AS title, hash FROM cat WHERE length(path) % 5 <> 0)
SELECT coalesce(n.collection, o.collection) AS collection, coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'gone' WHEN o.hash IS NOT DISTINCT FROM n.hash AND o.title IS NOT DISTINCT FROM n.title THEN 'unchanged' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.collection = n.collection AND o.path = n.path""")
def index_diff(spark, root):
    cat = _catalog(spark, root)
    new = cat.where("length(path) % 5 <> 0").withColumn("title", F.when(F.length("title") % 3 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return C.difference(cat.where("active = 1"), new, ["collection", "path"], ["hash", "title"])


@N.query("deactivate_document", f"WITH {_CAT} SELECT collection, path, CASE WHEN length(path) % 5 = 0 THEN 0 ELSE active END AS active FROM cat")
def deactivate_document(spark, root):
    cat = _catalog(spark, root)
    return C.deactivate_unseen(cat, cat.where("length(path) % 5 <> 0"), ["collection", "path"]).select("collection", "path", "active")


@N.query("delete_inactive", "SELECT collection, count(*) AS n FROM documents WHERE active = 1 GROUP BY 1")
def delete_inactive(spark, root):
    return _docs(spark, root).where("active = 1").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@N.query("cleanup_orphaned_content", "SELECT hash FROM content_store c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.hash = c.hash AND active = 1)")
def cleanup_orphaned_content(spark, root):
    return C.unreferenced(table(spark, root, "content_store"), "hash", _docs(spark, root).where("active = 1"), "hash").select("hash")


@N.query("cleanup_orphaned_vectors", "SELECT node_id FROM node_embeddings_raw v WHERE NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE n.id = v.node_id AND n.deleted_at IS NULL)")
def cleanup_orphaned_vectors(spark, root):
    return C.unreferenced(table(spark, root, "node_embeddings_raw"), "node_id", table(spark, root, "graph_nodes").where("deleted_at is null"), "id").select("node_id")


@N.query("remove_collection", "SELECT hash FROM content_store WHERE hash NOT IN (SELECT hash FROM documents WHERE collection <> 'handbook' AND active = 1 AND hash IS NOT NULL)")
def remove_collection(spark, root):
    left = _docs(spark, root).where("collection <> 'handbook' and active = 1")
    return C.unreferenced(table(spark, root, "content_store"), "hash", left, "hash").select("hash")


@N.query("rename_collection", "SELECT CASE WHEN collection = 'notes' THEN 'memos' ELSE collection END AS collection, count(*) AS n FROM documents GROUP BY 1")
def rename_collection(spark, root):
    renamed = _docs(spark, root).select(F.when(F.col("collection") == "notes", "memos").otherwise(F.col("collection")).alias("collection"))
    return renamed.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@N.query("cache_evict", "SELECT query_id, node_id FROM (SELECT query_id, node_id, result_id FROM search_results ORDER BY result_id DESC, node_id LIMIT 1000)")
def cache_evict(spark, root):
    return C.newest(table(spark, root, "search_results").select("query_id", "node_id", "result_id"), "result_id", "node_id").select("query_id", "node_id")


@N.query("cache_key", "SELECT DISTINCT query_id, sha256('rerank' || '{\"q\":\"' || query || '\"}') AS key FROM search_results")
def cache_key(spark, root):
    return table(spark, root, "search_results").select("query_id", F.sha2(F.concat(F.lit('rerank{"q":"'), "query", F.lit('"}')), 256).alias("key")).distinct()


@N.query("rerank_cache_join", "SELECT r.result_id, coalesce(c.score, 0) AS score, c.score IS NULL AS missed FROM search_results r LEFT JOIN (SELECT query_id, node_id, max(rerank_score) AS score FROM search_results WHERE rerank_score < 1e3 GROUP BY ALL) c USING (query_id, node_id)")
def rerank_cache_join(spark, root):
    r = table(spark, root, "search_results")
    cache = r.where("rerank_score < 1e3 and not isnan(rerank_score)").groupBy("query_id", "node_id").agg(F.max("rerank_score").alias("score"))
    return r.select("result_id", "query_id", "node_id").join(cache, ["query_id", "node_id"], "left").select("result_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("score").isNull().alias("missed"))


_FILES = "f AS (SELECT repo_id, branch, file_path, hash, last_modified, indexed_at FROM file_hashes QUALIFY row_number() OVER (PARTITION BY repo_id, branch, file_path ORDER BY scanned_at DESC, obs_no DESC) = 1)"


def _newest_files(spark, root):
    return C.keep_latest(table(spark, root, "file_hashes"), ["repo_id", "branch", "file_path"], [F.desc("scanned_at"), F.desc("obs_no")])


@N.query("indexed_files", f"WITH {_FILES} SELECT file_path, hash, last_modified FROM f WHERE repo_id = 'quillgraph' AND branch = 'main'")
def indexed_files(spark, root):
    return _newest_files(spark, root).where("repo_id = 'quillgraph' and branch = 'main'").select("file_path", "hash", "last_modified")


@N.query("detect_file_changes", f"""WITH {_FILES}, o AS (SELECT repo_id, branch, file_path, hash FROM file_hashes h JOIN index_runs r USING (run_id) WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY repo_id, branch, file_path ORDER BY scanned_at DESC, obs_no DESC) = 1)
SELECT coalesce(f.repo_id, o.repo_id) AS repo_id, coalesce(f.branch, o.branch) AS branch, coalesce(f.file_path, o.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'new' WHEN f.file_path IS NULL THEN 'gone' WHEN o.hash IS NOT DISTINCT FROM f.hash THEN 'unchanged' ELSE 'updated' END AS change
FROM o FULL JOIN f ON o.repo_id = f.repo_id AND o.branch = f.branch AND o.file_path = f.file_path""")
def detect_file_changes(spark, root):
    key = ["repo_id", "branch", "file_path"]
    done = table(spark, root, "index_runs").where("status = 'success'").select("run_id")
    old = C.keep_latest(table(spark, root, "file_hashes").join(done, "run_id", "left_semi"), key, [F.desc("scanned_at"), F.desc("obs_no")])
    return C.difference(old.select(*key, "hash"), _newest_files(spark, root).select(*key, "hash"), key, ["hash"])


_GONE = "g AS (SELECT DISTINCT file_path FROM graph_nodes WHERE deleted_at IS NOT NULL), d AS (SELECT id FROM graph_nodes WHERE file_path IN (SELECT file_path FROM g))"


@N.query("remove_nodes_by_file", f"WITH {_GONE} SELECT rel_no FROM graph_relationships WHERE source NOT IN (SELECT id FROM d) AND (target IS NULL OR target NOT IN (SELECT id FROM d))")
def remove_nodes_by_file(spark, root):
    nodes = table(spark, root, "graph_nodes")
    return C.without_file(nodes, table(spark, root, "graph_relationships"), nodes.where("deleted_at is not null"))[1].select("rel_no")


@N.query("apply_tombstone", f"WITH {_GONE} SELECT 'node' AS kind, count(*) AS n FROM graph_nodes WHERE file_path NOT IN (SELECT file_path FROM g) UNION ALL SELECT 'vector', count(*) FROM node_embeddings_raw WHERE node_id NOT IN (SELECT id FROM d) UNION ALL SELECT 'hash', count(*) FROM file_hashes WHERE file_path NOT IN (SELECT file_path FROM g)")
def apply_tombstone(spark, root):
    nodes = table(spark, root, "graph_nodes")
    gone = nodes.where("deleted_at is not null").select("file_path").distinct()
    doomed = nodes.join(gone, "file_path", "left_semi").select(F.col("id").alias("node_id"))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    vectors = table(spark, root, "node_embeddings_raw").select("node_id").join(doomed, "node_id", "left_anti")
    return count(nodes.join(gone, "file_path", "left_anti"), "node").unionByName(count(vectors, "vector")).unionByName(count(table(spark, root, "file_hashes").join(gone, "file_path", "left_anti"), "hash"))


@N.query("clear_file_from_graph", "SELECT label, count(*) AS n FROM graph_nodes WHERE file_path NOT LIKE '%/config/%' GROUP BY 1")
def clear_file_from_graph(spark, root):
    return table(spark, root, "graph_nodes").where("file_path not like '%/config/%'").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@N.query("apply_repo_context", "SELECT id, CASE WHEN repo_id = 'willowcache' THEN 'release' ELSE branch END AS branch, CASE WHEN repo_id = 'willowcache' THEN 'feed' ELSE commit_sha END AS commit_sha FROM graph_nodes")
def apply_repo_context(spark, root):
    ours = F.col("repo_id") == "willowcache"
    return table(spark, root, "graph_nodes").select("id", F.when(ours, "release").otherwise(F.col("branch")).alias("branch"), F.when(ours, "feed").otherwise(F.col("commit_sha")).alias("commit_sha"))


@N.query("sink_upsert_nodes", "SELECT id, name, updated_at FROM (SELECT id, upper(name) AS name, updated_at FROM graph_nodes WHERE repo_id = 'tidemark' UNION ALL SELECT id, name, updated_at FROM graph_nodes WHERE repo_id <> 'tidemark')")
def sink_upsert_nodes(spark, root):
    old = table(spark, root, "graph_nodes").select("id", "name", "updated_at", "repo_id")
    return C.upsert(old, old.where("repo_id = 'tidemark'").withColumn("name", F.upper("name")), ["id"]).select("id", "name", "updated_at")


@N.query("sink_upsert_edges", "SELECT id, rel_no, confidence FROM graph_relationships QUALIFY row_number() OVER (PARTITION BY id ORDER BY rel_no DESC) = 1")
def sink_upsert_edges(spark, root):
    return C.keep_latest(table(spark, root, "graph_relationships"), ["id"], [F.desc("rel_no")]).select("id", "rel_no", "confidence")


@N.query("add_relationships", "SELECT id, rel_no FROM graph_relationships QUALIFY row_number() OVER (PARTITION BY id ORDER BY rel_no) = 1")
def add_relationships(spark, root):
    return C.keep_latest(table(spark, root, "graph_relationships"), ["id"], [F.col("rel_no")]).select("id", "rel_no")


@N.query("sink_embeddings", "SELECT node_id, len(embedding) AS dims FROM node_embeddings_raw WHERE len(embedding) = 768")
def sink_embeddings(spark, root):
    return table(spark, root, "node_embeddings_raw").where("size(embedding) = 768").select("node_id", F.size("embedding").cast("long").alias("dims"))


@N.query("get_embedding", "SELECT vec_id, label, len(embedding) AS dims, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id = 7")
def get_embedding(spark, root):
    return table(spark, root, "embeddings").where("vec_id = 7").select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@N.query("index_health", "SELECT count(DISTINCT hash) FILTER (active = 1 AND hash NOT IN (SELECT hash FROM content_store)) AS needs, count(*) FILTER (active = 1) AS n_active, date_diff('day', max(modified_at), TIMESTAMP '2026-01-01') AS days FROM documents")
def index_health(spark, root):
    store = table(spark, root, "content_store").select("hash").withColumn("there", F.lit(1))
    d = _docs(spark, root).select("hash", "active", "modified_at").join(store, "hash", "left")
    return d.agg(F.countDistinct(F.when((F.col("active") == 1) & F.col("there").isNull(), F.col("hash"))).alias("needs"), F.count_if(F.col("active") == 1).alias("n_active"), F.datediff(F.lit("2026-01-01").cast("date"), F.max("modified_at")).cast("long").alias("days"))


@N.query("anti_needs_embedding", "SELECT count(DISTINCT hash) AS n FROM documents d WHERE active = 1 AND hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM content_store c WHERE c.hash = d.hash AND c.deleted_at IS NULL)")
def anti_needs_embedding(spark, root):
    have = table(spark, root, "content_store").where("deleted_at is null").select("hash")
    return _docs(spark, root).where("active = 1 and hash is not null").join(have, "hash", "left_anti").agg(F.countDistinct("hash").alias("n"))


@N.query("hashes_for_embedding", "SELECT hash, min(path) AS path FROM documents WHERE active = 1 AND hash IS NOT NULL AND hash NOT IN (SELECT hash FROM content_store WHERE deleted_at IS NULL AND hash IS NOT NULL) GROUP BY 1")
def hashes_for_embedding(spark, root):
    have = table(spark, root, "content_store").where("deleted_at is null").select("hash")
    return _docs(spark, root).where("active = 1 and hash is not null").join(have, "hash", "left_anti").groupBy("hash").agg(F.min("path").alias("path"))


@N.query("collection_stats", "SELECT s.scope_key AS collection, count(doc_id) AS n, coalesce(sum(CASE WHEN active = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS n_active, max(modified_at) AS last FROM (SELECT DISTINCT scope_key FROM index_runs WHERE scope_kind = 'collection' UNION SELECT 'empty one') s LEFT JOIN documents d ON d.collection = s.scope_key GROUP BY 1")
def collection_stats(spark, root):
    names = table(spark, root, "index_runs").where("scope_kind = 'collection'").select(F.col("scope_key").alias("collection")).distinct()
    return C.collection_stats(names.unionByName(spark.createDataFrame([("empty one",)], "collection string")), _docs(spark, root))


@N.query("index_status", "SELECT collection, count(*) FILTER (active = 1) AS n_active, max(modified_at) AS last, row_number() OVER (ORDER BY max(modified_at) DESC NULLS LAST, collection) AS place FROM documents GROUP BY 1")
def index_status(spark, root):
    per = _docs(spark, root).groupBy("collection").agg(F.count_if(F.col("active") == 1).alias("n_active"), F.max("modified_at").alias("last"))
    from pyspark.sql import Window

    return per.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc_nulls_last("last"), "collection")))  # a row per collection


@N.query("top_level_paths_without_context", "SELECT DISTINCT collection, string_split(path, '/')[1] AS top FROM documents WHERE active = 1 AND string_split(path, '/')[1] NOT IN ('util', 'core')")
def top_level_paths(spark, root):
    tops = _docs(spark, root).where("active = 1").select("collection", F.get(F.split("path", "/"), F.lit(0)).alias("top")).distinct()
    return tops.join(F.broadcast(spark.createDataFrame([("util",), ("core",)], "top string")), "top", "left_anti").select("collection", "top")


_CTX = [("handbook", "", "All of the handbook."), ("handbook", "util", "Tools."), ("handbook", "util/p", "Planning."), ("notes", "", "Notes."), ("notes", "core/", "Core notes.")]
_CTX_SQL = "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _CTX) + ") t(collection, prefix, context))"


@N.query("context_prefix_join", f"WITH {_CTX_SQL} SELECT doc_id, string_agg(context, chr(10) || chr(10) ORDER BY length(prefix), prefix) AS context FROM documents JOIN c USING (collection) WHERE starts_with(path, prefix) GROUP BY 1")
def context_prefix_join(spark, root):
    return C.prefix_contexts(_docs(spark, root).select("doc_id", "collection", "path"), spark.createDataFrame(_CTX, "collection string, prefix string, context string"))


@N.query("context_longest_prefix", f"WITH {_CTX_SQL} SELECT doc_id, coalesce(max_by(context, (length(prefix), prefix)), 'Everything.') AS context FROM documents d LEFT JOIN c ON d.collection = c.collection AND starts_with(path, prefix) GROUP BY 1")
def context_longest_prefix(spark, root):
    return C.longest_prefix(_docs(spark, root).select("doc_id", "collection", "path"), spark.createDataFrame(_CTX, "collection string, prefix string, context string"), "Everything.")


@N.query("collection_for_path", "SELECT id, max_by(r, length(r)) AS root FROM graph_nodes JOIN (SELECT unnest(['quillgraph/', 'quillgraph/s', 'pinwheel-ui/', 'mossbridge/app/']) AS r) ON starts_with(file_path, r) GROUP BY 1")
def collection_for_path(spark, root):
    roots = spark.createDataFrame([("quillgraph/",), ("quillgraph/s",), ("pinwheel-ui/",), ("mossbridge/app/",)], "r string")
    nodes = table(spark, root, "graph_nodes").select("id", "file_path")
    return nodes.join(F.broadcast(roots), F.col("file_path").startswith(F.col("r"))).groupBy("id").agg(F.max_by("r", F.length("r")).alias("root"))


@N.query("find_document", "SELECT doc_id, 'docid' AS how FROM documents WHERE starts_with(hash, '1f73') UNION ALL SELECT doc_id, 'suffix' FROM documents WHERE path LIKE '%builder-a0.md'")
def find_document(spark, root):
    d = _docs(spark, root).select("doc_id", "hash", "path")
    return d.where(F.col("hash").startswith("1f73")).select("doc_id", F.lit("docid").alias("how")).unionByName(d.where(F.col("path").endswith("builder-a0.md")).select("doc_id", F.lit("suffix").alias("how")))


@N.query("find_documents", "SELECT doc_id, path, CASE WHEN length(text) > 10240 THEN 'too large' ELSE 'ok' END AS state FROM documents WHERE active = 1 AND regexp_matches(path, '^util/[^/]*\\.md$')")
def find_documents(spark, root):
    d = _docs(spark, root).where(F.col("active") == 1).where(F.col("path").rlike(glob_regex("util/*.md")))
    return d.select("doc_id", "path", F.when(F.length("text") > 10240, "too large").otherwise("ok").alias("state"))


def glob_regex(glob: str) -> str:
    """A glob with *, ** and ? as a regular expression."""
    import re

    out = ""
    for part in re.split(r"(\*\*/?|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


@N.query("similar_files", "SELECT path, min(levenshtein(lower(path), 'util/planner-task-bilder-a1.md')) AS distance FROM documents WHERE levenshtein(lower(path), 'util/planner-task-bilder-a1.md') <= 12 GROUP BY 1")
def similar_files(spark, root):
    d = F.levenshtein(F.lower("path"), F.lit("util/planner-task-bilder-a1.md"))
    return _docs(spark, root).select("path", d.alias("distance")).where("distance <= 12").groupBy("path").agg(F.min("distance").alias("distance"))


@N.query("sink_files", "SELECT doc_id, '#' || hash[1:6] || ',' || printf('%.2f', 0.5) || ',' || collection || '/' || path AS row FROM documents WHERE hash IS NOT NULL")
def sink_files(spark, root):
    from fathomgrid.sources.formats import files_row

    return _docs(spark, root).where("hash is not null").select("doc_id", files_row(F.col("hash"), F.lit(0.5), F.concat_ws("/", "collection", "path"), F.lit(None).cast("string")).alias("row"))


@N.query("sink_csv", """SELECT doc_id, '#' || hash[1:6] || ',0.5000,' || path || ',' || CASE WHEN regexp_matches(title, '[,"\n]') THEN '"' || replace(title, '"', '""') || '"' ELSE title END || ',' || '' || ',1,' || CASE WHEN regexp_matches(text, '[,"\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS row FROM documents WHERE hash IS NOT NULL""")
def sink_csv(spark, root):
    from fathomgrid.sources.formats import csv_row

    return _docs(spark, root).where("hash is not null").select("doc_id", csv_row(F.col("hash"), F.lit(0.5), F.col("path"), F.col("title"), F.lit(""), F.lit(1), F.col("text")).alias("row"))


QUERIES, SQL = N.QUERIES, N.SQL
