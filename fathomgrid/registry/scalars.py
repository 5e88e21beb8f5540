"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomgrid.functions import query as Q
from fathomgrid.functions import text as T
from fathomgrid.registry.base import Named
from fathomgrid.sources.tables import table

N = Named()


def _docs(spark, root):
    return table(spark, root, "documents")


@N.query("content_hash", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def content_hash(spark, root):
    return _docs(spark, root).select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


@N.query("docid", "SELECT doc_id, hash[1:6] AS docid, lower(hash[1:6]) AS normal, hash IS NOT NULL AS is_docid FROM documents")
def docid(spark, root):
    short = F.concat(F.lit("#"), T.docid(F.col("hash")))
    return _docs(spark, root).select("doc_id", T.docid(F.col("hash")).alias("docid"), T.normalize_docid(short).alias("normal"), F.coalesce(T.is_docid(short), F.lit(False)).alias("is_docid"))


@N.query("extract_title", """SELECT doc_id, CASE WHEN lower(path) LIKE '%.md' AND h <> '' THEN h ELSE regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '') END AS found FROM (
SELECT doc_id, path, CASE WHEN a IN ('Notes', '📝 Notes') AND b <> '' THEN b ELSE a END AS h FROM (SELECT doc_id, path, trim(regexp_extract(text, '(?m)^##?[ \\t]+(.+)$', 1)) AS a, trim(regexp_extract(text, '(?m)^##[ \\t]+(.+)$', 1)) AS b FROM documents))""")
def extract_title(spark, root):
    return _docs(spark, root).select("doc_id", T.title(F.col("text"), F.col("path")).alias("found"))


@N.query("slug_path", """SELECT doc_id, array_to_string(list_filter(list_concat(list_transform(s[:-2], lambda x: regexp_replace(regexp_replace(x, '[^\\p{L}\\p{N}$]+', '-', 'g'), '^-+|-+$', '', 'g')),
[regexp_replace(regexp_replace(left(s[-1], length(s[-1]) - length(e)), '[^\\p{L}\\p{N}$]+', '-', 'g'), '^-+|-+$', '', 'g') || e]), lambda x: x <> ''), '/') AS slug
FROM (SELECT doc_id, s, regexp_extract(s[-1], '(\\.[a-z0-9]+)$', 1) AS e FROM (SELECT doc_id, string_split(lower(replace(title || '/' || path, '___', '/')), '/') AS s FROM documents))""")
def slug_path(spark, root):
    return _docs(spark, root).select("doc_id", T.slug_path(F.concat_ws("/", "title", "path")).alias("slug"))


@N.query("virtual_path", "SELECT doc_id, 'doc://' || collection || '/' || path AS vpath, collection AS back_collection, path AS back_path FROM documents")
def virtual_path(spark, root):
    v = _docs(spark, root).select("doc_id", T.virtual_path("doc", F.col("collection"), F.col("path")).alias("vpath"))
    parts = T.virtual_parts(F.col("vpath"))
    return v.select("doc_id", "vpath", parts["collection"].alias("back_collection"), parts["path"].alias("back_path"))


@N.query("node_id", "SELECT id, label || ':' || file_path || ':' || name AS made, string_split(id, ':')[1] AS l, array_to_string(string_split(id, ':')[2:-2], ':') AS p, string_split(id, ':')[-1] AS n FROM graph_nodes")
def node_id(spark, root):
    parts = T.node_parts(F.col("id"))
    return table(spark, root, "graph_nodes").select("id", T.node_id(F.col("label"), F.col("file_path"), F.col("name")).alias("made"), parts["label"].alias("l"), parts["path"].alias("p"), parts["name"].alias("n"))


@N.query("relationship_id", "SELECT rel_no, rel_type || ':' || source || ':' || coalesce(target, '') AS made FROM graph_relationships")
def relationship_id(spark, root):
    return table(spark, root, "graph_relationships").select("rel_no", F.concat("rel_type", F.lit(":"), "source", F.lit(":"), F.coalesce("target", F.lit(""))).alias("made"))


@N.query("infer_language", "SELECT id, CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust' WHEN 'php' THEN 'php' WHEN 'rb' THEN 'ruby' END AS lang, regexp_matches(file_path, '\\.(ts|js|py|go|java|rs|php|rb)$') AS code FROM graph_nodes")
def infer_language(spark, root):
    return table(spark, root, "graph_nodes").select("id", T.language(F.col("file_path")).alias("lang"), T.is_code_file(F.col("file_path")).alias("code"))


@N.query("test_path_predicate", "SELECT id, lower(file_path) LIKE '%/test/%' OR lower(file_path) LIKE '%/tests/%' OR contains(lower(file_path), '__tests__') OR contains(lower(file_path), '.test.') OR contains(lower(file_path), '.spec.') OR regexp_matches(lower(file_path), '(^|[\\\\/._-])(test|spec)([\\\\/._-]|$)') AS is_test FROM graph_nodes")
def test_path_predicate(spark, root):
    return table(spark, root, "graph_nodes").select("id", T.is_test_path(F.col("file_path")).alias("is_test"))


@N.query("token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, root):
    return _docs(spark, root).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@N.query("chunk_id", "SELECT id, 'symbol:' || file_path || ':' || name AS chunk, 'sub_chunk:' || file_path || ':' || name || ':1' AS sub FROM graph_nodes")
def chunk_id(spark, root):
    return table(spark, root, "graph_nodes").select("id", F.concat_ws(":", F.lit("symbol"), "file_path", "name").alias("chunk"), F.concat_ws(":", F.lit("sub_chunk"), "file_path", "name", F.lit("1")).alias("sub"))


@N.query("split_identifiers", """SELECT id, array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '\\s+'), lambda x: x <> ''), '|') AS camel,
array_to_string(list_filter(string_split(name, '_'), lambda x: x <> ''), '|') AS snake, array_to_string(list_filter(string_split(name, '-'), lambda x: x <> ''), '|') AS kebab FROM graph_nodes""")
def split_identifiers(spark, root):
    n = F.col("name")
    return table(spark, root, "graph_nodes").select("id", F.array_join(T.camel_parts(n), "|").alias("camel"), F.array_join(T.snake_parts(n), "|").alias("snake"), F.array_join(T.kebab_parts(n), "|").alias("kebab"))


@N.query("normalize_identifiers", """SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(string_split_regex(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '\\s+'), lambda x: string_split(x, '_'))), lambda x: lower(x)), lambda x: length(x) > 1 AND x <> lower(name)))), '|') AS parts FROM graph_nodes""")
def normalize_identifiers(spark, root):
    return table(spark, root, "graph_nodes").select("id", F.array_join(F.array_sort(T.normalize_identifiers(F.col("name"))), "|").alias("parts"))


@N.query("body_line_slice", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents")
def body_line_slice(spark, root):
    return _docs(spark, root).select("doc_id", T.lines(F.col("text"), 2, 3).alias("part"))


@N.query("add_line_numbers", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i::VARCHAR || ': ' || x), chr(10)) AS numbered FROM documents")
def add_line_numbers(spark, root):
    return _docs(spark, root).select("doc_id", T.number_lines(F.col("text")).alias("numbered"))


@N.query("truncate_lines", "SELECT doc_id, CASE WHEN len(l) > 5 THEN array_to_string(l[1:5], chr(10)) || chr(10) || '[... truncated ' || (len(l) - 5)::VARCHAR || ' more lines]' ELSE text END AS cut FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)")
def truncate_lines(spark, root):
    return _docs(spark, root).select("doc_id", T.truncate_lines(F.col("text"), 5).alias("cut"))


SNIPPET_TERMS = ["index", "cache", "snapshot"]


@N.query("extract_snippet", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
s AS (SELECT doc_id, l, list_transform(l, lambda x: contains(lower(x), 'index')::INT + contains(lower(x), 'cache')::INT + contains(lower(x), 'snapshot')::INT) AS s FROM l),
b AS (SELECT doc_id, l, list_position(s, list_max(s)) AS b FROM s), w AS (SELECT doc_id, l, b, greatest(b - 1, 1) AS f, least(len(l), b + 2) AS t FROM b)
SELECT doc_id, b::INT AS line, '@@ -' || f || ',' || (t - f + 1) || ' @@ (' || (f - 1) || ' before, ' || (len(l) - t) || ' after)' AS header, CASE WHEN length(array_to_string(l[f:t], chr(10))) > 500 THEN left(array_to_string(l[f:t], chr(10)), 497) || '...' ELSE array_to_string(l[f:t], chr(10)) END AS body FROM w""")
def extract_snippet(spark, root):
    s = _docs(spark, root).select("doc_id", T.snippet(F.col("text"), SNIPPET_TERMS).alias("s"))
    return s.select("doc_id", "s.line", "s.header", F.col("s.text").alias("body"))


@N.query("highlight_terms", "SELECT doc_id, regexp_replace(regexp_replace(title, '(cache)', '**\\1**', 'gi'), '(index)', '**\\1**', 'gi') AS marked FROM documents")
def highlight_terms(spark, root):
    return _docs(spark, root).select("doc_id", T.highlight(F.col("title"), ["cache", "index", "a"]).alias("marked"))


@N.query("escape_csv_xml", """SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END AS csv,
replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM documents""")
def escape_csv_xml(spark, root):
    return _docs(spark, root).select("doc_id", T.escape_csv(F.col("text")).alias("csv"), T.escape_xml(F.col("text")).alias("xml"))


@N.query("format_units", """SELECT hash, CASE WHEN doc_bytes < 1024 THEN doc_bytes || ' B' WHEN doc_bytes < 1048576 THEN printf('%.1f KB', round(doc_bytes / 1024.0, 1)) ELSE printf('%.1f MB', round(doc_bytes / 1048576.0, 1)) END AS bytes,
CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago FROM (SELECT hash, doc_bytes, CAST(epoch(TIMESTAMP '2026-01-01') - floor(epoch(created_at)) AS BIGINT) AS s FROM content_store)""")
def format_units(spark, root):
    return table(spark, root, "content_store").select("hash", T.format_bytes(F.col("doc_bytes")).alias("bytes"), T.time_ago(F.col("created_at"), F.lit("2026-01-01").cast("timestamp")).alias("ago"))


@N.query("format_score", "SELECT rel_no, lpad(CAST(round(confidence * 100) AS INT)::VARCHAR, 3, ' ') || '%' AS shown FROM graph_relationships WHERE confidence IS NOT NULL")
def format_score(spark, root):
    return table(spark, root, "graph_relationships").where("confidence is not null").select("rel_no", T.format_score(F.col("confidence")).alias("shown"))


@N.query("uri_encode_path", "SELECT doc_id, array_to_string(list_transform(string_split(path, '/'), lambda x: url_encode(x)), '/') AS uri FROM documents")
def uri_encode_path(spark, root):
    return _docs(spark, root).select("doc_id", T.uri_path(F.col("path")).alias("uri"))


@N.query("embed_prompts", "SELECT doc_id, 'task: search result | query: ' || title AS for_query, 'title: ' || coalesce(nullif(title, ''), 'none') || ' | text: ' || text AS for_doc FROM documents")
def embed_prompts(spark, root):
    named = F.coalesce(F.nullif("title", F.lit("")), F.lit("none"))
    return _docs(spark, root).select("doc_id", F.concat(F.lit("task: search result | query: "), "title").alias("for_query"), F.concat(F.lit("title: "), named, F.lit(" | text: "), "text").alias("for_doc"))


def _queries(spark, root):
    return table(spark, root, "search_results").select("query_id", "query").distinct()


@N.query("fts_sanitize", "SELECT DISTINCT query_id, query, array_to_string(list_transform(list_filter(list_transform(string_split_regex(lower(query), '\\s+'), lambda t: regexp_replace(t, '[^\\p{L}\\p{N}'']', '', 'g')), lambda t: t <> ''), lambda t: '\"' || t || '\"*'), ' AND ') AS fts FROM search_results")
def fts_sanitize(spark, root):
    quoted = F.transform(T.full_text_terms(F.col("query")), lambda t: F.concat(F.lit('"'), t, F.lit('"*')))
    return _queries(spark, root).withColumn("fts", F.array_join(quoted, " AND "))


_ID_SQL = "list_distinct(list_concat({}))".format(", ".join(f"regexp_extract_all(name, '{p}')" for p in Q.IDENTIFIERS))


@N.query("extract_identifiers", f"SELECT id, array_to_string(list_sort({_ID_SQL}), '|') AS found FROM graph_nodes")
def extract_identifiers(spark, root):
    return table(spark, root, "graph_nodes").select("id", F.array_join(F.array_sort(Q.identifiers(F.col("name"))), "|").alias("found"))


@N.query("process_query")
def process_query(spark, root):
    q = F.col("query")
    k = Q.kind(q)
    return _queries(spark, root).select("query_id", "query", Q.identifiers(q).alias("identifiers"), Q.paths(q).alias("paths"), Q.expanded_terms(q).alias("terms"), Q.intent(q).alias("intent"), k["kind"].alias("kind"), k["confidence"].alias("confidence"), Q.rerank_method(k["kind"]).alias("rerank"))


_INTENT_SQL = "CASE WHEN list_has_any(string_split_regex(lower(trim(query)), '\\s+'), [{}]) THEN 'definition' {} ELSE 'hybrid' END".format(
    ", ".join(f"'{w}'" for w in Q.DEFINITION), " ".join("WHEN " + " OR ".join(f"contains(lower(query), '{p}')" for p in ps) + f" THEN '{k}'" for k, ps in Q.INTENTS.items())
).replace("ELSE 'hybrid'", "WHEN regexp_matches(query, '(^|\\s)[a-zA-Z0-9_\\-./]+/[a-zA-Z0-9_\\-./]+(\\s|$)') OR regexp_matches(query, '[a-zA-Z0-9_\\-]+/[a-zA-Z0-9_\\-./]+') THEN 'navigation' ELSE 'hybrid'")


@N.query("detect_intent", f"SELECT DISTINCT record_id, CASE WHEN regexp_matches(trim(query), '^\\S+$') THEN 'one word' ELSE {_INTENT_SQL} END AS intent FROM qmd_expansion_locations WHERE query IS NOT NULL")
def detect_intent(spark, root):
    q = F.col("query")
    rows = table(spark, root, "qmd_expansion_locations").where("query is not null")
    return rows.select("record_id", F.when(F.trim(q).rlike(r"^\S+$"), "one word").otherwise(Q.intent(q)).alias("intent")).distinct()


@N.query("routing_hints", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in Q.BOOSTS.items()) + ") t(intent, fts, vector, graph)")
def routing_hints(spark, root):
    return spark.createDataFrame([(k, *v) for k, v in Q.BOOSTS.items()], "intent string, fts double, vector double, graph double")


@N.query("path_prior", """SELECT id, round(least(greatest((CASE WHEN lower(file_path) LIKE '%/test/%' OR lower(file_path) LIKE '%/tests/%' OR contains(lower(file_path), '__tests__') OR contains(lower(file_path), '.test.') OR contains(lower(file_path), '.spec.') OR regexp_matches(lower(file_path), '(^|[\\\\/._-])(test|spec)([\\\\/._-]|$)') THEN 0.82 ELSE 1.0 END)
* (CASE WHEN contains(lower(file_path), 'factory') THEN 1.15 ELSE 1.0 END) * (CASE WHEN contains(lower(file_path), 'manager') THEN 1.15 ELSE 1.0 END) * (CASE WHEN contains(lower(file_path), 'registry') THEN 1.15 ELSE 1.0 END) * (CASE WHEN contains(lower(file_path), 'builder') THEN 1.25 ELSE 1.0 END), 0.65), 1.35)::DOUBLE, 6) AS prior FROM graph_nodes""")
def path_prior(spark, root):
    return table(spark, root, "graph_nodes").select("id", F.round(Q.path_prior(F.col("file_path"), F.lit("query builder")), 6).alias("prior"))


@N.query("levenshtein", "SELECT id, levenshtein(lower(name), 'rendergroup') AS distance FROM graph_nodes")
def levenshtein(spark, root):
    return table(spark, root, "graph_nodes").select("id", F.levenshtein(F.lower("name"), F.lit("rendergroup")).alias("distance"))


@N.query("md5_hash", "SELECT file_id, md5(content) AS md5 FROM parse_results")
def md5_hash(spark, root):
    return table(spark, root, "parse_results").select("file_id", F.md5("content").alias("md5"))


@N.query("format_eta", "SELECT hash, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' END AS eta FROM (SELECT hash, doc_bytes AS s FROM content_store)")
def format_eta(spark, root):
    """Sizes stand for seconds."""
    return table(spark, root, "content_store").select("hash", T.format_eta(F.col("doc_bytes")).alias("eta"))


@N.query("symbol_kind_to_label", "SELECT kind, label FROM (VALUES ('class', 'class'), ('interface', 'interface'), ('type_alias', 'type_alias'), ('enum', 'enum'), ('method', 'method'), ('function', 'function'), ('constant', 'function'), ('variable', 'function'), ('other', 'function')) t(kind, label)")
def symbol_kind_to_label(spark, root):
    kinds = spark.createDataFrame([(k,) for k in ("class", "interface", "type_alias", "enum", "method", "function", "constant", "variable", "other")], "kind string")
    return kinds.select("kind", T.label_of_kind(F.col("kind")).alias("label"))


_PATHS = "regexp_replace(file_path, '^[^/]*/', '')"


@N.query("relative_from_prefix", f"SELECT file_id, {_PATHS} AS inside, starts_with(file_path, '/') AS absolute FROM parse_results")
def relative_from_prefix(spark, root):
    p = F.col("file_path")
    return table(spark, root, "parse_results").select("file_id", T.relative_to(p, F.substring_index("repo_id", "/", 1)).alias("inside"), T.is_absolute(p).alias("absolute"))


@N.query("resolve_path", "SELECT file_id, '/' || file_path AS path FROM parse_results")
def resolve_path(spark, root):
    """A path that goes up and down again comes out as it was."""
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    return table(spark, root, "parse_results").select("file_id", T.resolve(F.concat(F.lit("/"), folder, F.lit("/x/..")), F.concat(F.lit("./"), F.regexp_extract("file_path", "([^/]*)$", 1))).alias("path"))


QUERIES, SQL = N.QUERIES, N.SQL
