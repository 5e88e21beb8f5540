"""Queries on the graph of symbols and on files that change together."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomgrid.functions.text import SYMBOLS
from fathomgrid.operators import coupling as K
from fathomgrid.operators import graph as G
from fathomgrid.operators import parsing as P
from fathomgrid.registry.base import Named
from fathomgrid.sources.tables import table

N = Named()


def _nodes(spark, root):
    return table(spark, root, "graph_nodes")


def _edges(spark, root):
    return table(spark, root, "graph_relationships")


_E = "e AS (SELECT DISTINCT source, target FROM graph_relationships WHERE rel_type = 'calls' AND target IS NOT NULL)"


def _calls(spark, root):
    return _edges(spark, root).where("rel_type = 'calls' and target is not null").select("source", "target").distinct()


@N.query("point_lookup_nodes", "SELECT id, label FROM graph_nodes WHERE id IN (SELECT DISTINCT node_id FROM search_judgments WHERE relevance = 3)")
def point_lookup_nodes(spark, root):
    ids = table(spark, root, "search_judgments").where("relevance = 3").select(F.col("node_id").alias("id")).distinct()
    return _nodes(spark, root).join(ids, "id", "left_semi").select("id", "label")


@N.query("nodes_by_label", "SELECT id, name FROM graph_nodes WHERE label = 'class'")
def nodes_by_label(spark, root):
    return _nodes(spark, root).where("label = 'class'").select("id", "name")


@N.query("edges_by_type", "SELECT rel_no, source, target FROM graph_relationships WHERE rel_type = 'extends'")
def edges_by_type(spark, root):
    return _edges(spark, root).where("rel_type = 'extends'").select("rel_no", "source", "target")


@N.query("all_symbols", "SELECT id FROM graph_nodes WHERE label IN ('function', 'class', 'method', 'interface', 'type_alias', 'enum')")
def all_symbols(spark, root):
    return _nodes(spark, root).where(F.col("label").isin(*SYMBOLS)).select("id")


@N.query("exact_name_search", "SELECT id, CASE WHEN file_path ILIKE '%test%' OR file_path ILIKE '%spec%' THEN 0.8 ELSE 1.0 END::DOUBLE AS score FROM graph_nodes WHERE name = 'fuseCounter' ORDER BY score DESC, name, id LIMIT 20")
def exact_name_search(spark, root):
    p = F.col("file_path")
    score = F.when(p.ilike("%test%") | p.ilike("%spec%"), 0.8).otherwise(1.0)
    return _nodes(spark, root).where("name = 'fuseCounter'").select("id", score.alias("score")).orderBy(F.desc("score"), "name", "id").limit(20)


@N.query("search_symbols", "SELECT id FROM graph_nodes WHERE (name ILIKE '%cache%' OR signature ILIKE '%cache%') AND label = 'function' AND language = 'typescript'")
def search_symbols(spark, root):
    return _nodes(spark, root).where((F.col("name").ilike("%cache%") | F.col("signature").ilike("%cache%")) & (F.col("label") == "function") & (F.col("language") == "typescript")).select("id").orderBy("id")


@N.query("fuzzy_symbol_search", "WITH f AS (SELECT id, name, levenshtein(lower(name), 'token') AS d FROM graph_nodes WHERE name ILIKE '%token%' OR signature ILIKE '%token%' ORDER BY id LIMIT 40) SELECT id, round(greatest(0, 1 - d / greatest(length(name), 5)::DOUBLE - 0.3 * d / 10), 6) AS score FROM f ORDER BY score DESC, id LIMIT 20")
def fuzzy_symbol_search(spark, root):
    """The first 2 x 20 symbols that hold the query in name or content, ranked by their distance to that query."""
    query = "token"
    d = F.levenshtein(F.lower("name"), F.lit(query))
    score = F.greatest(F.lit(0.0), 1 - d / F.greatest(F.length("name"), F.lit(len(query))) - 0.3 * d / 10)
    some = _nodes(spark, root).where(F.col("name").ilike(f"%{query}%") | F.col("signature").ilike(f"%{query}%")).orderBy("id").limit(40)
    return some.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


def _adjacent(name, rel_type, side):
    of, other = ("target", "source") if side == "callers" else ("source", "target")
    sql = f"SELECT {of} AS of, {other} AS id, max(n.name) AS name, max(coalesce(confidence, 1.0)) AS confidence FROM graph_relationships r JOIN graph_nodes n ON n.id = r.{other} WHERE rel_type = '{rel_type}' AND {of} IS NOT NULL GROUP BY 1, 2"
    N.query(name, sql.replace(" AS of", ' AS "of"'))(lambda spark, root: G.neighbours(_edges(spark, root), _nodes(spark, root), rel_type, side))


for _name, _type, _side in (("callers_with_confidence", "calls", "callers"), ("callees_with_confidence", "calls", "callees"), ("type_refs", "uses_type", "callers"), ("parent_class", "extends", "callees"), ("child_classes", "extends", "callers"), ("implemented_interfaces", "implements", "callees"), ("imported_nodes", "imports", "callees")):
    _adjacent(_name, _type, _side)


@N.query("callers", "SELECT target AS of, count(DISTINCT source) AS n FROM graph_relationships WHERE rel_type = 'calls' AND target IS NOT NULL GROUP BY 1".replace(" AS of", ' AS "of"'))
def callers(spark, root):
    return _edges(spark, root).where("rel_type = 'calls' and target is not null").groupBy(F.col("target").alias("of")).agg(F.countDistinct("source").alias("n"))


@N.query("inheritance_chain", "SELECT DISTINCT source AS id, target AS up, rel_type AS via FROM graph_relationships WHERE rel_type IN ('extends', 'implements') AND target IS NOT NULL")
def inheritance_chain(spark, root):
    e = _edges(spark, root).where("target is not null")
    pick = lambda t: e.where(F.col("rel_type") == t).select(F.col("source").alias("id"), F.col("target").alias("up"), F.lit(t).alias("via"))
    return pick("extends").unionByName(pick("implements")).distinct()


@N.query("same_file_nodes", "SELECT id, other FROM (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS n FROM graph_nodes a JOIN graph_nodes b ON a.file_path = b.file_path AND a.id <> b.id) WHERE n <= 5")
def same_file_nodes(spark, root):
    n = _nodes(spark, root).select("file_path", "id")
    first = n.withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy("id"))).where("n <= 6")  # the five others of any node are among its file's first six
    firsts = first.groupBy("file_path").agg(F.array_sort(F.collect_list("id")).alias("firsts"))
    others = n.join(firsts, "file_path").select("id", F.slice(F.array_remove("firsts", F.col("id")), 1, 5).alias("others"))
    return others.select("id", F.explode("others").alias("other"))


@N.query("one_hop_neighbors", f"WITH {_E}, b AS (SELECT source AS id, target AS other, 'out' AS way FROM e UNION ALL SELECT target, source, 'in' FROM e) SELECT id, other, way FROM b QUALIFY row_number() OVER (PARTITION BY id, way ORDER BY other) <= 5")
def one_hop_neighbors(spark, root):
    e = _calls(spark, root)
    both = e.select(F.col("source").alias("id"), F.col("target").alias("other"), F.lit("out").alias("way")).unionByName(e.select(F.col("target").alias("id"), F.col("source").alias("other"), F.lit("in").alias("way")))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("id", "way").orderBy("other"))).where("n <= 5").drop("n")


@N.query("resolve_call", """WITH c AS (SELECT id, file_path, name FROM graph_nodes WHERE label IN ('function', 'method')), q AS (SELECT DISTINCT n.file_path, s.name FROM graph_relationships r JOIN graph_nodes n ON n.id = r.source JOIN graph_nodes s ON s.id = r.target WHERE rel_type = 'calls'),
l AS (SELECT q.file_path, q.name, min(c.id) AS id FROM q JOIN c ON c.file_path = q.file_path AND c.name = q.name GROUP BY ALL), g AS (SELECT name, min(id) AS id FROM c GROUP BY 1)
SELECT q.file_path, q.name, coalesce(l.id, g.id) AS resolved, CASE WHEN l.id IS NOT NULL THEN 1.0 WHEN g.id IS NOT NULL THEN 0.5 END::DOUBLE AS confidence FROM q LEFT JOIN l ON l.file_path = q.file_path AND l.name = q.name LEFT JOIN g ON g.name = q.name""")
def resolve_call(spark, root):
    n = _nodes(spark, root)
    c = n.where(F.col("label").isin("function", "method")).select("id", "file_path", "name")
    q = _calls(spark, root).join(n.select(F.col("id").alias("source"), "file_path"), "source").join(n.select(F.col("id").alias("target"), "name"), "target").select("file_path", "name").distinct()
    local = c.groupBy("file_path", "name").agg(F.min("id").alias("l"))
    far = c.groupBy("name").agg(F.min("id").alias("g"))
    both = q.join(local, ["file_path", "name"], "left").join(far, "name", "left")
    return both.select("file_path", "name", F.coalesce("l", "g").alias("resolved"), F.when(F.col("l").isNotNull(), 1.0).when(F.col("g").isNotNull(), 0.5).alias("confidence"))


# names of types as an edge of source files gives them: the last part of its target.
def _type_names(spark, root, *kinds):
    e = _edges(spark, root).where(F.col("rel_type").isin(*kinds) & F.col("target").isNotNull())
    return e.select(F.col("rel_type").alias("what"), F.col("source").alias("id"), F.regexp_extract("target", "([^:]*)$", 1).alias("name"), F.col("line").alias("first")).distinct()


def _types_sql(kinds: str, labels: list[str]) -> str:
    rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(labels))
    return f"""WITH w AS (SELECT DISTINCT rel_type, source, regexp_extract(target, '([^:]*)$', 1) AS name, line FROM graph_relationships WHERE rel_type IN ({kinds}) AND target IS NOT NULL),
t AS (SELECT name, min_by(id, (CASE label {rank} END, id)) AS target FROM graph_nodes WHERE label IN ({", ".join(f"'{x}'" for x in labels)}) GROUP BY 1)
SELECT rel_type, source, target, line FROM w JOIN t USING (name)"""


@N.query("resolve_heritage", _types_sql("'extends', 'implements'", ["class", "interface"]))
def resolve_heritage(spark, root):
    """Each base by name: the first class of that name, else the first interface."""
    return P.resolve_types(_type_names(spark, root, "extends", "implements"), _nodes(spark, root))


@N.query("resolve_type_usage", _types_sql("'uses_type'", ["class", "interface", "type_alias", "enum"]))
def resolve_type_usage(spark, root):
    return P.resolve_types(_type_names(spark, root, "uses_type"), _nodes(spark, root))


@N.query("resolve_import")
def resolve_import(spark, root):
    """Every import of every file with the file it means; an import that isn't met has null."""
    p = table(spark, root, "parse_results")
    return P.resolve_imports(P.parse_files(p).where("what = 'import'"), p.select("file_path", "repo_id"))


@N.query("resolve_import_symbol")
def resolve_import_symbol(spark, root):
    """The first exported symbol of the file that each import means."""
    return P.resolve_import_symbols(resolve_import(spark, root), _nodes(spark, root))


@N.query("enclosing_symbol", "WITH p AS (SELECT DISTINCT n.file_path, r.line FROM graph_relationships r JOIN graph_nodes n ON n.id = r.source WHERE r.line IS NOT NULL) SELECT p.file_path, p.line, min_by(s.id, (end_line - start_line, s.id)) AS symbol FROM p LEFT JOIN (SELECT * FROM graph_nodes WHERE label <> 'file') s ON s.file_path = p.file_path AND p.line BETWEEN start_line AND end_line GROUP BY ALL")
def enclosing_symbol(spark, root):
    n = _nodes(spark, root)
    points = _edges(spark, root).where("line is not null").join(n.select(F.col("id").alias("source"), "file_path"), "source").select("file_path", "line").distinct()
    return G.enclosing_symbol(points, n.where("label <> 'file'"))


_STARTS = "s AS (SELECT id AS start FROM graph_nodes WHERE label = 'function')"


def _starts(spark, root):
    return _nodes(spark, root).where("label = 'function'").select(F.col("id").alias("start"))


@N.query("traverse", f"WITH RECURSIVE {_E}, {_STARTS}, t AS (SELECT start, start AS id, 0 AS depth FROM s UNION SELECT t.start, e.target, t.depth + 1 FROM t JOIN e ON e.source = t.id WHERE t.depth < 10) SELECT start, id, min(depth) AS depth FROM t WHERE id <> start GROUP BY ALL")
def traverse(spark, root):
    """What every function reaches by calls."""
    return G.traverse(_calls(spark, root), _starts(spark, root))


@N.query("impact", f"WITH RECURSIVE {_E}, {_STARTS}, t AS (SELECT start, start AS id, 0 AS depth FROM s UNION SELECT t.start, e.source, t.depth + 1 FROM t JOIN e ON e.target = t.id WHERE t.depth < 4), m AS (SELECT start, id, min(depth) AS depth FROM t WHERE id <> start GROUP BY ALL) SELECT start, id, depth, CASE depth WHEN 1 THEN 'will break' WHEN 2 THEN 'may break' ELSE 'review' END AS effect FROM m")
def impact(spark, root):
    """What a change of any function may break."""
    return G.impact(_calls(spark, root), _starts(spark, root))


_ROOTS = """r AS (SELECT id FROM graph_nodes WHERE (label IN ('function', 'method') AND (is_exported = 1 OR name IN ('main', '__main__', 'constructor') OR regexp_matches(name, '^__.*__$') OR starts_with(name, 'test_') OR starts_with(name, 'it_') OR starts_with(name, 'describe_')
 OR contains(file_path, '/test/') OR contains(file_path, '/tests/') OR contains(file_path, '/__tests__/') OR regexp_matches(file_path, '\\.(test|spec)\\.(ts|js)$'))) OR (label = 'class' AND (starts_with(name, 'Test') OR regexp_matches(name, 'Tests?$') OR contains(file_path, '/test/') OR contains(file_path, '/tests/'))))"""


@N.query("dead_code", f"""WITH RECURSIVE {_E}, {_ROOTS}, a AS (SELECT id FROM r UNION SELECT e.target FROM a JOIN e ON e.source = a.id),
k AS (SELECT DISTINCT source AS child, target AS parent FROM graph_relationships WHERE rel_type IN ('extends', 'implements') AND target IS NOT NULL), m AS (SELECT DISTINCT r.source AS member, r.target AS owner, n.name, n.label FROM graph_relationships r JOIN graph_nodes n ON n.id = r.source WHERE rel_type = 'member_of' AND target IS NOT NULL),
spared AS (SELECT m.member FROM m JOIN k ON k.child = m.owner JOIN m p ON p.owner = k.parent AND p.name = m.name WHERE m.label = 'method' AND p.member IN (SELECT id FROM a))
SELECT id, name, file_path FROM graph_nodes WHERE label IN ('function', 'method') AND id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT member FROM spared)""")
def dead_code(spark, root):
    return G.dead_code(_nodes(spark, root), _edges(spark, root))


@N.query("method_override_join", "WITH k AS (SELECT DISTINCT source AS child, target AS parent FROM graph_relationships WHERE rel_type IN ('extends', 'implements') AND target IS NOT NULL), m AS (SELECT DISTINCT r.source AS member, r.target AS owner, n.label FROM graph_relationships r JOIN graph_nodes n ON n.id = r.source WHERE rel_type = 'member_of' AND target IS NOT NULL) SELECT m.member AS id, count(DISTINCT parent) AS parents FROM m JOIN k ON k.child = m.owner GROUP BY 1")
def method_override_join(spark, root):
    e = _edges(spark, root).where("target is not null")
    kin = e.where("rel_type in ('extends', 'implements')").select(F.col("source").alias("child"), F.col("target").alias("parent")).distinct()
    member = e.where("rel_type = 'member_of'").select(F.col("source").alias("id"), F.col("target").alias("child")).distinct()
    return member.join(_nodes(spark, root).select("id"), "id", "left_semi").join(kin, "child").groupBy("id").agg(F.countDistinct("parent").alias("parents"))


@N.query("entry_points", f"WITH {_E} SELECT id FROM graph_nodes WHERE label IN ('function', 'method') AND (is_exported = 1 OR is_entry_point = 1 OR id NOT IN (SELECT target FROM e))")
def entry_points(spark, root):
    return G.entry_points(_nodes(spark, root), _edges(spark, root)).select("id")


_LINKS = "l AS (SELECT a, b, sum(w) AS w FROM (SELECT source AS a, target AS b, w FROM x UNION ALL SELECT target, source, w FROM x) GROUP BY 1, 2), x AS (SELECT source, target, CASE rel_type WHEN 'calls' THEN 1.0 WHEN 'imports' THEN 0.5 WHEN 'member_of' THEN 1.5 ELSE 2.0 END::DOUBLE AS w FROM graph_relationships WHERE rel_type IN ('calls', 'imports', 'extends', 'implements', 'member_of') AND target IS NOT NULL), c AS (SELECT DISTINCT a AS id, string_split(string_split(a, ':')[2], '/')[1] AS community FROM l)"
_LINKS = "x AS" + _LINKS.split("), x AS")[1].split("), c AS")[0] + "), " + _LINKS.split(", x AS")[0] + ", c AS" + _LINKS.split(", c AS")[1]


def _by_repo(links):
    return links.select(F.col("a").alias("id")).distinct().withColumn("community", F.get(F.split(F.get(F.split("id", ":"), F.lit(1)), "/"), F.lit(0)))


@N.query("modularity", f"WITH {_LINKS}, d AS (SELECT a, sum(w) AS k FROM l GROUP BY 1), m AS (SELECT sum(w) AS m2 FROM l), p AS (SELECT community, sum(k) AS s, sum(k * k) AS q FROM d JOIN c ON c.id = d.a GROUP BY 1), i AS (SELECT ca.community, sum(w) AS w FROM l JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE a < b AND ca.community = cb.community GROUP BY 1) SELECT round(sum((coalesce(i.w, 0) - (s * s - q) / 2 / m2) / m2), 6) AS modularity FROM p LEFT JOIN i USING (community), m")
def modularity(spark, root):
    links = G.weighted_links(_edges(spark, root))
    return G.modularity(links, _by_repo(links)).select(F.round("modularity", 6).alias("modularity"))


@N.query("cohesion", f"WITH {_LINKS}, o AS (SELECT ca.community, a, sum(CASE WHEN ca.community = cb.community THEN w ELSE 0 END) AS inside, sum(w) AS total FROM l JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b GROUP BY ALL) SELECT community, count(*) AS members, round(CASE WHEN count(*) < 2 THEN 1 ELSE sum(inside) / sum(total) END, 6) AS cohesion, min_by(a, (-inside, a)) AS hub FROM o GROUP BY 1")
def cohesion(spark, root):
    links = G.weighted_links(_edges(spark, root))
    return G.cohesion(links, _by_repo(links)).select("community", "members", F.round("cohesion", 6).alias("cohesion"), "hub")


@N.query("communities")
def communities(spark, root):
    return G.communities(G.weighted_links(_edges(spark, root)))


@N.query("processes")
def processes(spark, root):
    return G.processes(_nodes(spark, root), _edges(spark, root))


@N.query("build_structure", "WITH p AS (SELECT DISTINCT string_split(file_path, '/') AS s FROM parse_results), u AS (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM p) SELECT DISTINCT array_to_string(s[1:n], '/') AS target, array_to_string(s[1:n-1], '/') AS source FROM u WHERE n > 1")
def build_structure(spark, root):
    return G.structure(table(spark, root, "parse_results").select("file_path"))[1]


@N.query("graph_stats", "SELECT 'label' AS kind, label AS name, count(*) AS n FROM graph_nodes GROUP BY 2 UNION ALL SELECT 'type', rel_type, count(*) FROM graph_relationships GROUP BY 2 UNION ALL SELECT 'embeddings', 'all', count(*) FROM node_embeddings_raw")
def graph_stats(spark, root):
    count = lambda df, kind, c: df.groupBy(F.lit(kind).alias("kind"), c.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return count(_nodes(spark, root), "label", F.col("label")).unionByName(count(_edges(spark, root), "type", F.col("rel_type"))).unionByName(count(table(spark, root, "node_embeddings_raw").select("node_id"), "embeddings", F.lit("all")))


@N.query("legacy_graph_stats", "SELECT (SELECT count(*) FROM graph_nodes WHERE label <> 'file') AS symbols, (SELECT count(*) FROM graph_relationships) AS edges, (SELECT count(*) FROM graph_relationships WHERE rel_type = 'imports') AS imports, (SELECT count(DISTINCT file_path) FROM graph_nodes) AS files")
def legacy_graph_stats(spark, root):
    n = _nodes(spark, root).agg(F.count_if(F.col("label") != "file").alias("symbols"), F.countDistinct("file_path").alias("files"))
    e = _edges(spark, root).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("rel_type") == "imports").alias("imports"))
    return n.join(F.broadcast(e)).select("symbols", "edges", "imports", "files")  # one row each


@N.query("indexed_file_paths", "SELECT DISTINCT file_path FROM graph_nodes WHERE file_path <> ''")
def indexed_file_paths(spark, root):
    return _nodes(spark, root).where("file_path <> ''").select("file_path").distinct()


@N.query("graph_coverage", f"WITH {_E}, o AS (SELECT source AS id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT target AS id, count(*) AS n FROM e GROUP BY 1), c AS (SELECT label, count(*) AS nodes, count(o.n) AS with_out, count(i.n) AS with_in, round(avg(o.n), 6) AS avg_out, round(avg(i.n), 6) AS avg_in FROM graph_nodes g LEFT JOIN o ON o.id = g.id LEFT JOIN i ON i.id = g.id GROUP BY 1) SELECT * FROM c")
def graph_coverage(spark, root):
    e = _calls(spark, root)
    o, i = e.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("o")), e.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    g = _nodes(spark, root).select("id", "label").join(o, "id", "left").join(i, "id", "left")
    return g.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.count("o").alias("with_out"), F.count("i").alias("with_in"), F.round(F.avg("o"), 6).alias("avg_out"), F.round(F.avg("i"), 6).alias("avg_in"))


@N.query("repo_index_report", "SELECT CASE WHEN confidence IS NULL THEN 'none' WHEN confidence = 1 THEN '1.0' WHEN confidence >= 0.8 THEN '0.8-0.99' WHEN confidence >= 0.5 THEN '0.5-0.79' ELSE '<0.5' END AS bucket, rel_type, count(*) AS n, count(*) FILTER (target IS NULL) AS unresolved FROM graph_relationships GROUP BY ALL")
def repo_index_report(spark, root):
    c = F.col("confidence")
    bucket = F.when(c.isNull(), "none").when(c == 1, "1.0").when(c >= 0.8, "0.8-0.99").when(c >= 0.5, "0.5-0.79").otherwise("<0.5")
    return _edges(spark, root).groupBy(bucket.alias("bucket"), "rel_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target").isNull()).alias("unresolved"))


@N.query("class_method_index", "SELECT file_path || ':' || class_name AS class, string_agg(name, ',' ORDER BY name) AS methods FROM graph_nodes WHERE label = 'method' AND class_name IS NOT NULL GROUP BY 1")
def class_method_index(spark, root):
    m = _nodes(spark, root).where("label = 'method' and class_name is not null")
    return m.groupBy(F.concat_ws(":", "file_path", "class_name").alias("class")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("methods"))


@N.query("callsites_by_target", "SELECT target, rel_no FROM graph_relationships WHERE rel_type = 'calls' AND target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target ORDER BY rel_no) <= 10")
def callsites_by_target(spark, root):
    e = _edges(spark, root).where("rel_type = 'calls' and target is not null").select("target", "rel_no")
    return e.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("rel_no"))).where("n <= 10").drop("n")


#: Orders stand for commits, parts for files, customers for authors.
_CH = "ch AS (SELECT DISTINCT l_orderkey AS commit_no, l_partkey AS f FROM lineitem)"


def _changes(spark, root):
    o = table(spark, root, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at"))
    return table(spark, root, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")).join(o, "commit")


_CO = f"{_CH}, n AS (SELECT f, count(*) AS n FROM ch GROUP BY 1), p AS (SELECT a.f AS file_a, b.f AS file_b, count(*) AS together FROM ch a JOIN ch b ON a.commit_no = b.commit_no AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 2), k AS (SELECT file_a, file_b, together, a.n AS n_a, b.n AS n_b, (together / least(a.n, b.n) + together / sqrt(a.n * b.n)) / 2 AS strength FROM p JOIN n a ON a.f = file_a JOIN n b ON b.f = file_b)"


@N.query("change_coupling", f"WITH {_CO} SELECT file_a, file_b, together, n_a, n_b, round(strength, 6) AS strength FROM k")
def change_coupling(spark, root):
    return K.change_coupling(_changes(spark, root)).withColumn("strength", F.round("strength", 6))


@N.query("file_history", "SELECT l_partkey AS file, count(DISTINCT o_orderkey) AS commits, max(o_orderdate) AS last, count(DISTINCT o_custkey) AS authors FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def file_history(spark, root):
    return K.file_history(_changes(spark, root))


@N.query("top_coupled_files", f"WITH {_CO}, b AS (SELECT file_a AS file, file_b AS partner, strength FROM k UNION ALL SELECT file_b, file_a, strength FROM k) SELECT file, partner, row_number() OVER (PARTITION BY file ORDER BY round(strength, 9) DESC, partner) AS rank FROM b QUALIFY rank <= 5")
def top_coupled_files(spark, root):
    return K.top_partners(K.change_coupling(_changes(spark, root)))


@N.query("change_prediction", f"WITH {_CO}, b AS (SELECT file_a AS file, file_b AS partner, strength FROM k UNION ALL SELECT file_b, file_a, strength FROM k) SELECT partner AS file, round(max(strength), 6) AS strength FROM b WHERE strength >= 0.05 AND file % 50 = 0 AND partner % 50 <> 0 GROUP BY 1")
def change_prediction(spark, root):
    changed = table(spark, root, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("file"))
    return K.change_prediction(K.change_coupling(_changes(spark, root)), changed, 0.05).withColumn("strength", F.round("strength", 6))


QUERIES, SQL = N.QUERIES, N.SQL
