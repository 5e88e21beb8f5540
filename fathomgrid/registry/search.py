"""Queries of retrieval: full text, vectors, fusion, reranking, pipelines and their quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomgrid.operators import evaluate as E
from fathomgrid.operators import lexical as L
from fathomgrid.operators import ranking as R
from fathomgrid.plans.durable import run_dir
from fathomgrid.registry.base import Named
from fathomgrid.sources.tables import table

N = Named()
QUERY = "cache snapshot"


def _docs(spark, root):
    return table(spark, root, "documents")


def _doc_fields():
    return {"path": F.concat_ws("/", "collection", "path"), "title": F.col("title"), "body": F.col("text")}


_TERMS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def bm25_sql(src: str, key: str, fields: dict[str, str], weights: dict[str, float], words: list[str], every: bool = True) -> str:
    """CTEs up to m(key, raw, n_terms)."""
    size = " + ".join(f"coalesce(len({_TERMS.format(c)}), 0)" for c in fields.values())
    tf = lambda w: " + ".join(f"{weights[n]} * coalesce(len(list_filter({_TERMS.format(c)}, lambda t: t = '{w}')), 0)" for n, c in fields.items())
    have = " + ".join(f"(f{i} > 0)::INT" for i in range(len(words)))
    idf = lambda i: f"CASE WHEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(words)))
    return (
        f"t AS (SELECT {key}, {size} AS size, {', '.join(f'({tf(w)})::DOUBLE AS f{i}' for i, w in enumerate(words))} FROM {src}), "
        f"s AS (SELECT count(*) AS N, avg(size) AS mean, {', '.join(f'count(*) FILTER (f{i} > 0) AS n{i}' for i in range(len(words)))} FROM t), "
        f"m AS (SELECT {key}, {score} AS raw, {have} AS n_terms FROM t, s WHERE {have} {'= ' + str(len(words)) if every else '> 0'})"
    )


_DW = {"path": 10.0, "title": 1.0, "body": 1.0}
_DF = {"path": "collection || '/' || path", "title": "title", "body": "text"}
_BM = bm25_sql("documents", "doc_id", _DF, _DW, QUERY.split())


def _bm25_docs(spark, root):
    return L.bm25(_docs(spark, root), "doc_id", _doc_fields(), _DW, QUERY)


@N.query("bm25_documents", f"WITH {_BM} SELECT doc_id, round(raw / (2 + raw), 6) AS score FROM m JOIN documents USING (doc_id) WHERE active = 1")
def bm25_documents(spark, root):
    active = _docs(spark, root).where("active = 1").select("doc_id")
    return _bm25_docs(spark, root).join(active, "doc_id", "left_semi").select("doc_id", F.round(L.unit_score(F.col("raw")), 6).alias("score"))


_INDEXES: dict[str, L.TextIndex] = {}


def text_index(spark, root) -> L.TextIndex:
    """The index of the documents of a folder, built at its first use in this process."""
    if root not in _INDEXES:
        _INDEXES[root] = L.TextIndex(f"{run_dir(spark)}/text-{len(_INDEXES)}", "doc_id").build(_docs(spark, root), _doc_fields())
    return _INDEXES[root]


@N.query("bm25_indexed", f"WITH {_BM} SELECT doc_id, n_terms, round(raw, 6) AS raw FROM m")
def bm25_indexed(spark, root):
    """The same scores from the persisted index."""
    return text_index(spark, root).search(spark, _DW, QUERY).select("doc_id", "n_terms", F.round("raw", 6).alias("raw"))


@N.query("topk_fts", f"WITH {_BM} SELECT doc_id, round(raw / (2 + raw), 6) AS score FROM m ORDER BY round(raw, 9) DESC, doc_id LIMIT 20")
def topk_fts(spark, root):
    return L.top(_bm25_docs(spark, root), "raw", "doc_id", 20).select("doc_id", F.round(L.unit_score(F.col("raw")), 6).alias("score"))


@N.query("bm25_chunks", "WITH " + bm25_sql("documents", "doc_id", {"body": "text"}, {"body": 1.0}, QUERY.split(), False) + " SELECT doc_id, n_terms, round(raw / (1 + raw), 6) AS score FROM m")
def bm25_chunks(spark, root):
    rows = L.bm25(_docs(spark, root), "doc_id", {"body": F.col("text")}, {"body": 1.0}, QUERY, every=False)
    return rows.select("doc_id", "n_terms", F.round(L.unit_score(F.col("raw"), 1.0), 6).alias("score"))


_SF = {"name": "regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ', 'g')", "sig": "signature", "path": "file_path"}
_SW = dict.fromkeys(_SF, 1.0)
_SQ = ["cache", "store"]


def _bm25_symbols(spark, root):
    n = table(spark, root, "graph_nodes")
    fields = {"name": F.regexp_replace(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2"), "_", " "), "sig": F.col("signature"), "path": F.col("file_path")}
    rows = L.minmax_score(L.bm25(n, "id", fields, _SW, " ".join(_SQ), every=False))
    return L.symbol_score(rows.join(n.select("id", "name", "file_path", "label", "signature"), "id"), _SQ)


_TXT = "lower(concat_ws(' ', name, file_path, signature))"
_SYM = (
    "WITH " + bm25_sql("graph_nodes", "id", _SF, _SW, _SQ, False) + ", r AS (SELECT min(raw) AS lo, max(raw) AS hi FROM m), "
    f"c AS (SELECT id, name, file_path, label, signature, class_name, CASE WHEN hi = lo THEN 0.5 ELSE 0.1 + 0.9 * (raw - lo) / (hi - lo) END AS base, (contains({_TXT}, 'cache')::INT + contains({_TXT}, 'store')::INT) / 2 AS cover, (contains(lower(name), 'cache')::INT + contains(lower(name), 'store')::INT) / 2 AS named, contains(lower(file_path), 'cache')::INT + contains(lower(file_path), 'store')::INT AS in_path FROM m JOIN graph_nodes USING (id), r), "
    f"y AS (SELECT *, least(1.0, base * (0.7 + 0.6 * cover) * (CASE WHEN named = 0 THEN 0.55 WHEN named < 1 THEN 0.65 ELSE 1.8 END) * (CASE WHEN contains({_TXT}, 'cache store') THEN 1.15 ELSE 1.0 END) * (CASE WHEN in_path >= 2 THEN 1.1 ELSE 1.0 END) * (CASE WHEN contains(file_path, 'test') OR contains(file_path, 'spec') THEN 0.5 ELSE 1.0 END) * (CASE WHEN label IN ('function', 'class') AND (cover >= 0.5 OR named > 0) THEN 1.2 ELSE 1.0 END))::DOUBLE AS score FROM c)"
)


@N.query("bm25_symbols", f"{_SYM} SELECT id, round(score, 6) AS score FROM y")
def bm25_symbols(spark, root):
    return _bm25_symbols(spark, root).select("id", F.round("score", 6).alias("score"))


@N.query("minmax_normalise", "SELECT result_id, round(CASE WHEN hi = lo THEN 0.5 ELSE 0.1 + 0.9 * (rrf_score - lo) / (hi - lo) END, 6) AS score FROM search_results, (SELECT min(rrf_score) AS lo, max(rrf_score) AS hi FROM search_results WHERE isfinite(rrf_score)) WHERE isfinite(rrf_score)")
def minmax_normalise(spark, root):
    rows = table(spark, root, "search_results").where("rrf_score is not null and not isnan(rrf_score)").select("result_id", F.col("rrf_score").alias("raw"))
    return L.minmax_score(rows).select("result_id", F.round("score", 6).alias("score"))


@N.query("bm25_sigmoid", "SELECT result_id, round(1 / (1 + exp(-(abs(raw_score) - 5) / 3)), 6) AS score FROM search_results WHERE isfinite(raw_score)")
def bm25_sigmoid(spark, root):
    x = F.abs("raw_score")
    return table(spark, root, "search_results").where("raw_score is not null and not isnan(raw_score)").select("result_id", F.round(1 / (1 + F.exp(-(x - 5) / 3)), 6).alias("score"))


def _vector(spark, root, i):
    return table(spark, root, "embeddings").where(F.col("vec_id") == i).select("embedding").first()[0]  # one row


_Q1 = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1)"


@N.query("vector_knn_documents", f"WITH {_Q1} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q), 9) DESC, vec_id LIMIT 60")
def vector_knn_documents(spark, root):
    return R.knn(table(spark, root, "embeddings"), "vec_id", "embedding", _vector(spark, root, 1), 60).withColumn("similarity", F.round("similarity", 6))


@N.query("topk_knn", f"WITH {_Q1}, n AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 60) SELECT vec_id, round(s, 6) AS similarity FROM n WHERE label < 5 ORDER BY s DESC, vec_id LIMIT 20")
def topk_knn(spark, root):
    e = table(spark, root, "embeddings")
    return R.knn_filtered_after(e, "vec_id", "embedding", _vector(spark, root, 1), 20, e.where("label < 5")).withColumn("similarity", F.round("similarity", 6))


@N.query("vector_bruteforce", f"WITH {_Q1} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q WHERE label < 5 ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q), 9) DESC, vec_id LIMIT 20")
def vector_bruteforce(spark, root):
    return R.knn(table(spark, root, "embeddings").where("label < 5"), "vec_id", "embedding", _vector(spark, root, 1), 20).withColumn("similarity", F.round("similarity", 6))


@N.query("multi_query_vector", "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (1, 2, 3)) SELECT vec_id, round(max(list_cosine_similarity(embedding::DOUBLE[], q)), 6) AS similarity FROM embeddings, q GROUP BY 1 HAVING max(list_cosine_similarity(embedding::DOUBLE[], q)) >= 0.3 ORDER BY round(max(list_cosine_similarity(embedding::DOUBLE[], q)), 9) DESC, vec_id LIMIT 10")
def multi_query_vector(spark, root):
    qs = [list(_vector(spark, root, i)) for i in (1, 2, 3)]
    return R.multi_query(table(spark, root, "embeddings"), "vec_id", "embedding", qs, 0.3, 10).withColumn("similarity", F.round("similarity", 6))


@N.query("vector_dedupe_best", "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1) SELECT label, round(max(list_cosine_similarity(embedding::DOUBLE[], q)), 6) AS best FROM embeddings, q WHERE vec_id <> 1 GROUP BY 1")
def vector_dedupe_best(spark, root):
    from fathomgrid.functions.text import cosine

    q = F.array(*[F.lit(float(x)) for x in _vector(spark, root, 1)])
    return table(spark, root, "embeddings").where("vec_id <> 1").groupBy("label").agg(F.round(F.max(cosine(F.col("embedding"), q)), 6).alias("best"))


#: Two ranked lists per query in the table of candidates, by full text and by vector.
_LISTS = "l AS (SELECT query_id, 'fts' AS list, 2.0 AS weight, node_id, min(fts_rank) - 1 AS rank FROM search_results WHERE fts_rank IS NOT NULL GROUP BY query_id, node_id UNION ALL SELECT query_id, 'vec', 1.0, node_id, min(vector_rank) - 1 FROM search_results WHERE vector_rank IS NOT NULL GROUP BY query_id, node_id)"


def _lists(spark, root):
    r = table(spark, root, "search_results")
    one = lambda c, name, w: r.where(F.col(c).isNotNull()).groupBy("query_id", "node_id").agg((F.min(c) - 1).alias("rank")).select("query_id", F.lit(name).alias("list"), F.lit(w).alias("weight"), "node_id", "rank")
    return one("fts_rank", "fts", 2.0).unionByName(one("vector_rank", "vec", 1.0))


@N.query("rrf_documents", f"WITH {_LISTS} SELECT query_id, node_id, round(sum(weight / (60 + rank + 1)) + CASE WHEN min(rank) = 0 THEN 0.05 WHEN min(rank) <= 2 THEN 0.02 ELSE 0 END, 6)::DOUBLE AS score, min(rank) AS top_rank FROM l GROUP BY ALL")
def rrf_documents(spark, root):
    return R.rrf(_lists(spark, root), "node_id", group=["query_id"]).withColumn("score", F.round("score", 6))


@N.query("rrf_symbols", f"WITH {_LISTS} SELECT query_id, node_id, round(sum(weight / (60 + rank + 1)), 6)::DOUBLE AS score FROM l GROUP BY ALL")
def rrf_symbols(spark, root):
    return R.rrf(_lists(spark, root), "node_id", bonus=False, group=["query_id"]).select("query_id", "node_id", F.round("score", 6).alias("score"))


@N.query("rank_in_list", "SELECT result_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC NULLS LAST, result_id) - 1 AS rank FROM search_results WHERE rrf_score IS NOT NULL AND NOT isnan(rrf_score)")
def rank_in_list(spark, root):
    rows = table(spark, root, "search_results").where("rrf_score is not null and not isnan(rrf_score)").select("result_id", "query_id", "rrf_score")
    return R.ranked(rows, "result_id", "rrf_score", ["query_id"]).select("result_id", "rank")


@N.query("top_rank", f"WITH {_LISTS} SELECT query_id, node_id, min(rank) AS top_rank FROM l GROUP BY ALL")
def top_rank(spark, root):
    return _lists(spark, root).groupBy("query_id", "node_id").agg(F.min("rank").alias("top_rank"))


@N.query("percentile_rank", "SELECT result_id, round((count(*) OVER (PARTITION BY query_id) - row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, result_id) + 1) / (count(*) OVER (PARTITION BY query_id))::DOUBLE, 6) AS share FROM search_results WHERE isfinite(rerank_score)")
def percentile_rank(spark, root):
    rows = table(spark, root, "search_results").where("rerank_score is not null and not isnan(rerank_score)")
    n, at = F.count(F.lit(1)).over(Window.partitionBy("query_id")), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "result_id"))
    return rows.select("result_id", F.round((n - at + 1) / n, 6).alias("share"))


@N.query("blend_scores", "SELECT result_id, round(0.7 * least(greatest(coalesce(rrf_score, 0), 0), 1) + 0.3 * least(greatest(coalesce(CASE WHEN isfinite(rerank_score) THEN rerank_score END, 0), 0), 1), 9) AS final FROM search_results WHERE rrf_score IS NULL OR isfinite(rrf_score)")
def blend_scores(spark, root):
    r = table(spark, root, "search_results").where("rrf_score is null or not isnan(rrf_score)").withColumn("rerank_score", F.when(~F.isnan("rerank_score"), F.col("rerank_score")))
    return R.blend(r, "rrf_score", "rerank_score").select("result_id", F.round("final", 9).alias("final"))


@N.query("position_blend", "SELECT result_id, round(CASE WHEN fts_rank <= 3 THEN 0.75 / fts_rank + 0.25 * s WHEN fts_rank <= 10 THEN 0.6 / fts_rank + 0.4 * s ELSE 0.4 / fts_rank + 0.6 * s END, 9) AS score FROM (SELECT result_id, fts_rank, coalesce(CASE WHEN isfinite(rrf_score) THEN rrf_score END, 0) AS s FROM search_results WHERE fts_rank IS NOT NULL)")
def position_blend(spark, root):
    r = table(spark, root, "search_results").where("fts_rank is not null").withColumn("s", F.coalesce(F.when(~F.isnan("rrf_score"), F.col("rrf_score")), F.lit(0.0)))
    return R.position_blend(r, "fts_rank", "s").select("result_id", F.round("score", 9).alias("score"))


def _heur(words, q):
    sh = lambda c: "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + f") / {len(words)}"
    cnt = " + ".join(f"least((length({{}}) - length(replace({{}}, '{w}', ''))) / {len(w)}, 5)" for w in words)
    n, p, s, c = "lower(name)", "lower(file_path)", "lower(coalesce(signature, ''))", "lower(coalesce(class_name, ''))"
    text = cnt.replace("{}", s)
    return f"0.30 * (CASE WHEN {n} = '{q}' THEN 1.0 WHEN contains({n}, '{q}') THEN 0.8 ELSE {sh(n)} * 0.5 END) + 0.25 * (CASE WHEN contains({s}, '{q}') THEN 0.7 ELSE 0 END) + 0.20 * (CASE WHEN contains({p}, '{q}') THEN 0.8 ELSE {sh(p)} * 0.4 END) + 0.15 * (CASE WHEN {c} <> '' AND {c} = '{q}' THEN 0.9 WHEN contains({c}, '{q}') THEN 0.6 ELSE 0 END) + 0.10 * least(({text}) / {3 * len(words)}, 1)"


@N.query("rerank_heuristic", f"SELECT id, round(({_heur(['cache', 'items'], 'cache items')})::DOUBLE, 6) AS heuristic FROM graph_nodes")
def rerank_heuristic(spark, root):
    n = table(spark, root, "graph_nodes").withColumn("content", F.col("signature"))
    return R.heuristic_rerank(n, "cache items").select("id", F.round("heuristic", 6).alias("heuristic"))


@N.query("required_field_filter", "SELECT result_id FROM search_results WHERE node_id IS NOT NULL AND file_path IS NOT NULL AND isfinite(rrf_score) AND source IN ('graph', 'retrieval')")
def required_field_filter(spark, root):
    return table(spark, root, "search_results").where("node_id is not null and file_path is not null and rrf_score is not null and not isnan(rrf_score) and source in ('graph', 'retrieval')").select("result_id")


@N.query("normalize_results", "SELECT result_id, source, greatest(coalesce(CASE WHEN isfinite(rrf_score) THEN rrf_score END, 0), 0) AS score, left(name, 200) AS snippet FROM search_results WHERE node_id IS NOT NULL")
def normalize_results(spark, root):
    score = F.greatest(F.coalesce(F.when(~F.isnan("rrf_score"), F.col("rrf_score")), F.lit(0.0)), F.lit(0.0))
    r = table(spark, root, "search_results").where("node_id is not null")
    one = lambda s: r.where(F.col("source") == s).select("result_id", "source", score.alias("score"), F.left("name", F.lit(200)).alias("snippet"))
    return one("graph").unionByName(one("retrieval"))


@N.query("first_wins_dedup", "SELECT query_id, node_id, min(result_id) AS result_id FROM search_results GROUP BY ALL")
def first_wins_dedup(spark, root):
    return table(spark, root, "search_results").groupBy("query_id", "node_id").agg(F.min("result_id").alias("result_id"))


@N.query("filter_min_score", "SELECT result_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, result_id) AS n FROM search_results WHERE isfinite(rrf_score) AND rrf_score >= 0.01) WHERE n <= 10")
def filter_min_score(spark, root):
    rows = table(spark, root, "search_results").where("rrf_score is not null and not isnan(rrf_score) and rrf_score >= 0.01")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "result_id"))).where("n <= 10").select("result_id")


@N.query("per_source_limit", "SELECT result_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY result_id) AS n FROM search_results) WHERE n <= 3")
def per_source_limit(spark, root):
    return table(spark, root, "search_results").withColumn("n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("result_id"))).where("n <= 3").select("result_id")


@N.query("strong_signal", f"WITH {_BM}, o AS (SELECT raw / (2 + raw) AS score, row_number() OVER (ORDER BY raw / (2 + raw) DESC, doc_id) AS n FROM m) SELECT max(score) FILTER (n = 1) >= 0.7 AND max(score) FILTER (n = 1) - coalesce(max(score) FILTER (n = 2), 0) >= 0.2 AS strong FROM o")
def strong_signal(spark, root):
    return L.strong_signal(_bm25_docs(spark, root).withColumn("score", L.unit_score(F.col("raw"))), "score", "doc_id")


@N.query("node_passes_filters", "SELECT result_id FROM search_results WHERE node_id IN (SELECT id FROM graph_nodes WHERE repo_id = 'quillgraph' AND branch = 'main')")
def node_passes_filters(spark, root):
    keep = table(spark, root, "graph_nodes").where("repo_id = 'quillgraph' and branch = 'main'").select(F.col("id").alias("node_id"))
    return table(spark, root, "search_results").join(keep, "node_id", "left_semi").select("result_id")


def _symbol_seeds(spark, root):
    return L.top(_bm25_symbols(spark, root), "score", "id", 10).select("id", "score")


_SEEDS = f"{_SYM}, z AS (SELECT id, score FROM y ORDER BY round(score, 9) DESC, id LIMIT 10), e AS (SELECT DISTINCT source, target FROM graph_relationships WHERE rel_type = 'calls' AND target IS NOT NULL), x AS (SELECT other, score FROM (SELECT z.id, target AS other, score, row_number() OVER (PARTITION BY z.id ORDER BY target) AS n FROM z JOIN e ON e.source = z.id UNION ALL SELECT z.id, source, score, row_number() OVER (PARTITION BY z.id ORDER BY source) FROM z JOIN e ON e.target = z.id) WHERE n <= 5)"


@N.query("graph_neighbor_expand", f"{_SEEDS} SELECT other AS id, round(max(score * 0.5), 6) AS score FROM x WHERE other NOT IN (SELECT id FROM z) GROUP BY 1")
def graph_neighbor_expand(spark, root):
    return R.expand(_symbol_seeds(spark, root), table(spark, root, "graph_relationships")).withColumn("score", F.round("score", 6))


@N.query("graph_boost", f"{_SEEDS} SELECT other AS id, round(least(1.0, count(*) FILTER (score > 0.5) * 0.1)::DOUBLE, 6) AS boost FROM x GROUP BY 1")
def graph_boost(spark, root):
    e = table(spark, root, "graph_relationships").where("rel_type = 'calls' and target is not null").select("source", "target").distinct()
    seeds = _symbol_seeds(spark, root)
    way = lambda a, b: seeds.join(e, F.col("id") == F.col(a)).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(b))).where("n <= 5").select(F.col(b).alias("other"), "score")
    both = way("source", "target").unionByName(way("target", "source"))
    return both.groupBy(F.col("other").alias("id")).agg(F.round(F.least(F.lit(1.0), F.count_if(F.col("score") > 0.5) * 0.1), 6).alias("boost"))


def _node_vectors(spark, root):
    """Vectors of 768 finite values that are not all zero."""
    v = F.col("embedding")
    whole = (F.size(v) == 768) & (F.size(F.array_compact(v)) == 768) & ~F.isnan(F.array_max(v)) & ((F.array_max(v) != 0) | (F.array_min(v) != 0))
    return table(spark, root, "node_embeddings_raw").where(whole).select(F.col("node_id").alias("id"), "embedding")


def _asked(spark, root):
    return list(_node_vectors(spark, root).orderBy("id").limit(1).first()["embedding"])  # one row


_NV = "nv AS (SELECT node_id AS id, embedding::DOUBLE[] AS e FROM node_embeddings_raw WHERE len(embedding) = 768 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))), nq AS (SELECT e AS q FROM nv ORDER BY id LIMIT 1), ns AS (SELECT id, list_cosine_similarity(e, q) AS s FROM nv, nq)"


def _places(src: str, score: str, limit: int) -> str:
    return f"SELECT id, row_number() OVER (ORDER BY round({score}, 9) DESC, id) - 1 AS rank FROM {src} ORDER BY rank LIMIT {limit}"


@N.query("vector_knn_symbols", f"WITH {_NV}, n AS (SELECT id, s FROM ns ORDER BY round(s, 9) DESC, id LIMIT 60) SELECT id, round(s, 6) AS similarity FROM n WHERE id IN (SELECT id FROM graph_nodes WHERE repo_id = 'quillgraph' AND branch = 'main') ORDER BY round(s, 9) DESC, id LIMIT 20")
def vector_knn_symbols(spark, root):
    """Nearest symbols of a query vector, of which those of one repository and branch stay."""
    keep = table(spark, root, "graph_nodes").where("repo_id = 'quillgraph' and branch = 'main'").select("id")
    return R.knn_filtered_after(_node_vectors(spark, root), "id", "embedding", _asked(spark, root), 20, keep).withColumn("similarity", F.round("similarity", 6))


@N.query("hybrid_search_symbols", f"""{_SYM}, {_NV}, a AS ({_places("y", "score", 40)}), b AS ({_places("ns", "s", 40)}),
f AS (SELECT id, sum(1.0 / (61 + rank)) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1), o AS (SELECT id, rrf, row_number() OVER (ORDER BY round(rrf, 9) DESC, id) AS n FROM f),
h AS (SELECT o.id, rrf, CASE WHEN n <= 50 THEN {_heur(_SQ, " ".join(_SQ))} ELSE 0 END AS heur FROM o JOIN graph_nodes g ON g.id = o.id)
SELECT id, round((0.7 * least(rrf, 1) + 0.3 * least(heur, 1))::DOUBLE, 6) AS final FROM h ORDER BY round((0.7 * least(rrf, 1) + 0.3 * least(heur, 1))::DOUBLE, 9) DESC, id LIMIT 20""")
def hybrid_search_symbols(spark, root):
    """Full text and vectors, fused, the best 50 reranked, and blended."""
    n = table(spark, root, "graph_nodes")
    fts = L.top(_bm25_symbols(spark, root), "score", "id", 40).select("id", "score")
    near = R.knn(_node_vectors(spark, root), "id", "embedding", _asked(spark, root), 40)
    return R.hybrid([(fts, "score"), (near, "similarity")], n.withColumn("content", F.col("signature")), " ".join(_SQ), 20).select("id", F.round("final", 6).alias("final"))


#: Four ranked lists per query in the table of candidates: symbols and chunks, each by full text and by vector. Methods stand for call sites.
_FOUR = "l AS (SELECT query_id, node_id, source, label, min(fts_rank) - 1 AS rank, 'fts' AS kind FROM search_results WHERE fts_rank IS NOT NULL GROUP BY ALL UNION ALL SELECT query_id, node_id, source, label, min(vector_rank) - 1, 'vector' FROM search_results WHERE vector_rank IS NOT NULL GROUP BY ALL)"


def _four(spark, root):
    r = table(spark, root, "search_results")
    one = lambda c, kind: r.where(F.col(c).isNotNull()).groupBy("query_id", "node_id", "source", "label").agg((F.min(c) - 1).alias("rank")).withColumn("kind", F.lit(kind))
    return one("fts_rank", "fts").unionByName(one("vector_rank", "vector"))


@N.query("rrf_unified", f"WITH {_FOUR} SELECT query_id, node_id, round(sum(CASE WHEN source = 'retrieval' AND label = 'method' THEN 1.5 ELSE 1.0 END / (61 + rank)), 6)::DOUBLE AS score, min(rank) FILTER (kind = 'fts') + 1 AS fts_rank, min(rank) FILTER (kind = 'vector') + 1 AS vector_rank FROM l GROUP BY ALL")
def rrf_unified(spark, root):
    boosted = (F.col("source") == "retrieval") & (F.col("label") == "method")
    lists = _four(spark, root).withColumns({"weight": F.lit(1.0), "boosted": F.coalesce(boosted, F.lit(False))})
    return R.rrf_unified(lists, "node_id", group=["query_id"]).withColumn("score", F.round("score", 6))


@N.query("rrf_chunks", "WITH r AS (SELECT query_id, node_id, fts_rank - 1 AS rank, CASE WHEN isfinite(raw_score) THEN abs(raw_score) / (1 + abs(raw_score)) ELSE 0 END AS rel, 'fts' AS kind FROM search_results WHERE source = 'retrieval' AND fts_rank IS NOT NULL UNION ALL SELECT query_id, node_id, vector_rank - 1, CASE WHEN isfinite(rerank_score) THEN rerank_score ELSE 0 END, 'vector' FROM search_results WHERE source = 'retrieval' AND vector_rank IS NOT NULL), "
"l AS (SELECT query_id, node_id, kind, min(rank) AS rank, max(rel) AS rel FROM r GROUP BY ALL) SELECT query_id, node_id, round(sum(1.0 / (61 + rank)), 6)::DOUBLE AS rrf_score, round(max(rel), 6)::DOUBLE AS score, min(rank) FILTER (kind = 'fts') + 1 AS fts_rank, min(rank) FILTER (kind = 'vector') + 1 AS vector_rank FROM l GROUP BY 1, 2")
def rrf_chunks(spark, root):
    r = table(spark, root, "search_results").where("source = 'retrieval'")
    finite = lambda c, x: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), x).otherwise(0.0)
    one = lambda c, rel, kind: r.where(F.col(c).isNotNull()).groupBy("query_id", "node_id").agg((F.min(c) - 1).alias("rank"), F.max(rel).alias("relevance")).withColumns({"kind": F.lit(kind), "weight": F.lit(1.0)})
    lists = one("fts_rank", finite("raw_score", F.abs("raw_score") / (1 + F.abs("raw_score"))), "fts").unionByName(one("vector_rank", finite("rerank_score", F.col("rerank_score")), "vector"))
    return R.rrf_chunks(lists, "node_id", group=["query_id"]).withColumns({c: F.round(c, 6) for c in ("rrf_score", "score")})


# documents stand for chunks; those of code comments for call sites. The vectors of `embeddings` are theirs.
@N.query("unified_search", f"""{_SYM}, {_BM.replace("t AS (", "td AS (").replace("s AS (SELECT count", "sd AS (SELECT count").replace("m AS (SELECT doc_id", "md AS (SELECT doc_id").replace("FROM t)", "FROM td)").replace("FROM t, s ", "FROM td, sd ")}, {_NV}, {_Q1},
ds AS (SELECT 'doc:' || vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q), dm AS (SELECT 'doc:' || doc_id AS id, raw FROM md),
u AS (SELECT *, 'fts' AS kind FROM ({_places("y", "score", 90)}) UNION ALL SELECT *, 'vector' FROM ({_places("ns", "s", 90)}) UNION ALL SELECT *, 'fts' FROM ({_places("dm", "raw", 90)}) UNION ALL SELECT *, 'vector' FROM ({_places("ds", "s", 90)})),
cs AS (SELECT DISTINCT 'doc:' || doc_id AS id FROM documents WHERE source = 'code_comment')
SELECT id, round(sum((CASE WHEN id IN (SELECT id FROM cs) THEN 1.5 ELSE 1.0 END) / (61 + rank)), 6)::DOUBLE AS score, min(rank) FILTER (kind = 'fts') + 1 AS fts_rank, min(rank) FILTER (kind = 'vector') + 1 AS vector_rank FROM u GROUP BY 1 ORDER BY round(sum((CASE WHEN id IN (SELECT id FROM cs) THEN 1.5 ELSE 1.0 END) / (61 + rank))::DOUBLE, 9) DESC, id LIMIT 30""")
def unified_search(spark, root):
    """Symbols and chunks, each by full text and by vector, in one fused list in which call sites weigh more."""
    d, doc = _docs(spark, root), lambda c: F.concat(F.lit("doc:"), F.col(c).cast("string"))
    e = table(spark, root, "embeddings")
    sites = d.where("source = 'code_comment'").select(doc("doc_id").alias("id")).distinct().withColumn("boosted", F.lit(True))
    legs = [
        (L.top(_bm25_symbols(spark, root), "score", "id", 90).select("id", "score"), "score", "fts"), (R.knn(_node_vectors(spark, root), "id", "embedding", _asked(spark, root), 90), "similarity", "vector"),
        (_bm25_docs(spark, root).select(doc("doc_id").alias("id"), "raw").orderBy(F.desc(F.round("raw", 9)), "id").limit(90), "raw", "fts"),
        (e.select(doc("vec_id").alias("id"), F.col("embedding")).transform(lambda v: R.knn(v, "id", "embedding", _vector(spark, root, 1), 90)), "similarity", "vector"),
    ]
    lists = [R.as_list(df, "id", score, 1.0, i).withColumn("kind", F.lit(kind)) for i, (df, score, kind) in enumerate(legs)]
    every = reduce(lambda a, b: a.unionByName(b), lists).join(sites, "id", "left").withColumn("boosted", F.coalesce("boosted", F.lit(False)))
    return L.top(R.rrf_unified(every, "id"), "score", "id", 30).select("id", F.round("score", 6).alias("score"), "fts_rank", "vector_rank")


@N.query("hybrid_query_documents")
def hybrid_query_documents(spark, root):
    """The document query: the query by full text and by vector, which weigh double, and two fixed expansions by full text; fusion, reranking by the terms of the text, blend by position, one row per file."""
    d, index = _docs(spark, root), text_index(spark, root)
    active = d.where("active = 1").select("doc_id")
    text = lambda q: (L.top(index.search(spark, _DW, q, every=False).join(active, "doc_id", "left_semi"), "raw", "doc_id", 50), "raw")
    e = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    near = (R.knn_filtered_after(e, "doc_id", "embedding", _vector(spark, root, 1), 50, active), "similarity")
    fused = L.top(R.fuse([text(QUERY), near, text("index snapshot"), text("hash cache")], "doc_id", [2.0, 2.0, 1.0, 1.0]), "score", "doc_id", 40)
    rows = R.ranked(fused, "doc_id", "score").withColumn("rank", F.col("rank") + 1).drop("score").join(d.select("doc_id", "path", "collection", "text", "hash"), "doc_id")
    words = QUERY.split()
    hits = sum((F.least((F.length("text") - F.length(F.replace(F.lower("text"), F.lit(w), F.lit("")))) / len(w), F.lit(5.0)) for w in words), F.lit(0.0))
    out = R.position_blend(rows.withColumn("rerank", F.least(hits / (3 * len(words)), F.lit(1.0))), "rank", "rerank")
    best = out.groupBy("collection", "path").agg(F.max(F.struct("score", -F.col("doc_id"))).alias("b"))
    return best.select("collection", "path", F.round("b.score", 6).alias("score"), (-F.col("b.col2")).alias("doc_id")).orderBy(F.desc("score"), "doc_id").limit(20)


_MET = """WITH r AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, node_id) AS rank FROM (SELECT query_id, node_id, max(CASE WHEN isfinite(rrf_score) THEN round(rrf_score, 9) END) AS s FROM search_results GROUP BY ALL)),
g AS (SELECT query_id, node_id, max(relevance) AS rel FROM search_judgments WHERE relevance > 0 GROUP BY ALL) """


def _fused(spark, root):
    r = table(spark, root, "search_results").groupBy("query_id", "node_id").agg(F.max(F.when(~F.isnan("rrf_score"), F.round("rrf_score", 9))).alias("s"))
    return r.select("query_id", "node_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("s"), "node_id")).alias("rank"))


@N.query("retrieval_metrics", _MET + """, n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1), i AS (SELECT query_id, sum((power(2.0, rel) - 1) / log2(p + 1)) AS ideal FROM (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, node_id) AS p FROM g) WHERE p <= 10 GROUP BY 1),
h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum((power(2.0, rel) - 1) / log2(rank + 1)) AS dcg FROM r JOIN g USING (query_id, node_id) WHERE rank <= 10 GROUP BY 1)
SELECT query_id, round(coalesce(hits / least(n, 10), 0), 4)::DOUBLE AS recall, round(coalesce(1 / first, 0), 4)::DOUBLE AS mrr, round(coalesce(dcg / ideal, 0), 4)::DOUBLE AS ndcg FROM n JOIN i USING (query_id) LEFT JOIN h USING (query_id)""")
def retrieval_metrics(spark, root):
    return E.retrieval_metrics(_fused(spark, root), table(spark, root, "search_judgments"), "query_id", "node_id")


@N.query("hit_rate", _MET + "SELECT round(avg(hit), 6) AS rate FROM (SELECT query_id, max((rank <= 3)::INT) AS hit FROM g LEFT JOIN r USING (query_id, node_id) GROUP BY 1)")
def hit_rate(spark, root):
    return E.hit_rate(_fused(spark, root), table(spark, root, "search_judgments"), "query_id", "node_id", 3)


@N.query("usage_failure_diagnosis", _MET + """, j AS (SELECT query_id, count(*) AS wanted, count(*) FILTER (rank <= 20) AS found, count(*) FILTER (rank <= 10) AS near, bool_or(rank <= 20 AND (contains(node_id, 'login') OR contains(node_id, 'UserRepository') OR contains(node_id, 'fetchData'))) AS marked FROM g LEFT JOIN r USING (query_id, node_id) GROUP BY 1)
SELECT CASE WHEN found = 0 THEN 'not_indexed' WHEN found < wanted AND NOT coalesce(marked, false) THEN 'missing_callsite' ELSE 'ranking' END AS kind, count(*) AS n, round(avg(near / wanted), 6) AS recall FROM j GROUP BY 1""")
def usage_failure_diagnosis(spark, root):
    return E.failure_kinds(_fused(spark, root), table(spark, root, "search_judgments"), "query_id", "node_id")


@N.query("score_percentiles", "WITH o AS (SELECT rrf_score AS v, row_number() OVER (ORDER BY rrf_score) AS n, count(*) OVER () AS c FROM search_results WHERE isfinite(rrf_score)) SELECT s AS share, min(v) FILTER (n = floor(c * s) + 1) AS value FROM o, (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS s) GROUP BY 1")
def score_percentiles(spark, root):
    return E.index_percentiles(table(spark, root, "search_results").where("rrf_score is not null and not isnan(rrf_score)"), "rrf_score")


@N.query("dataset_stats", "SELECT count(*) AS n, count(*) FILTER (w <= 2) AS short, count(*) FILTER (w > 2 AND w <= 5) AS middle, count(*) FILTER (w > 5) AS long, count(*) FILTER (list_contains(k, 'lex')) AS with_lex, count(*) FILTER (list_contains(k, 'vec')) AS with_vec, count(*) FILTER (list_contains(k, 'hyde')) AS with_hyde, count(*) FILTER (big) AS long_hyde, count(query) - count(DISTINCT lower(query)) AS repeated FROM (SELECT query, len(list_filter(string_split_regex(trim(query), '\\s+'), lambda x: x <> '')) AS w, list_transform(output, lambda i: i[1]) AS k, coalesce(list_bool_or(list_transform(output, lambda i: i[1] = 'hyde' AND length(i[2]) > 200)), false) AS big FROM qmd_expansion_locations)")
def dataset_stats(spark, root):
    return E.expansion_statistics(table(spark, root, "qmd_expansion_locations"))


@N.query("validate_schema", "SELECT count(*) FILTER (coalesce(trim(query), '') = '') AS no_query, count(*) FILTER (output IS NULL OR len(output) = 0) AS no_output, count(*) FILTER (list_bool_or(list_transform(output, lambda i: len(i) <> 2 OR i[1] NOT IN ('lex', 'vec', 'hyde')))) AS bad_item, count(*) FILTER (list_bool_or(list_transform(output, lambda i: coalesce(trim(i[2]), '') = ''))) AS blank_item FROM qmd_expansion_locations")
def validate_schema(spark, root):
    return E.schema_faults(table(spark, root, "qmd_expansion_locations"))


@N.query("items_to_text", "SELECT record_id, array_to_string(list_transform(list_filter(output, lambda i: coalesce(trim(i[2]), '') <> ''), lambda i: i[1] || ': ' || trim(i[2])), chr(10)) AS lines FROM qmd_expansion_locations WHERE output IS NOT NULL")
def items_to_text(spark, root):
    kept = F.filter("output", lambda i: F.coalesce(F.trim(F.get(i, F.lit(1))), F.lit("")) != "")
    return table(spark, root, "qmd_expansion_locations").where("output is not null").select("record_id", F.array_join(F.transform(kept, lambda i: F.concat(F.get(i, F.lit(0)), F.lit(": "), F.trim(F.get(i, F.lit(1))))), "\n").alias("lines"))


_SOME = lambda words: " OR ".join(f"contains(q, '{w}')" for w in words)


@N.query("categorize_query", f"SELECT record_id, CASE WHEN len(list_filter(string_split_regex(query, '[\\s\\x{{a0}}]+'), lambda x: x <> '')) <= 2 THEN 'short_keyword' WHEN {_SOME(E.TEMPORAL)} THEN 'temporal' WHEN starts_with(q, 'how ') THEN 'how_to' WHEN starts_with(q, 'what ') THEN 'what_is' WHEN {_SOME(E.COMPARISON)} THEN 'comparison' WHEN {_SOME(E.PERSONAL)} THEN 'personal' ELSE 'other' END AS kind FROM (SELECT record_id, query, lower(query) AS q FROM qmd_expansion_locations WHERE query IS NOT NULL)")
def categorize_query(spark, root):
    return table(spark, root, "qmd_expansion_locations").where("query is not null").select("record_id", E.query_category(F.col("query")).alias("kind"))


@N.query("classify_hyde_query", f"SELECT record_id, CASE WHEN {_SOME(E.HOW)} THEN 'how_to' WHEN {_SOME(E.WHAT)} THEN 'what_is' WHEN {_SOME(E.CONFIG)} THEN 'config' WHEN {_SOME(E.ERROR)} THEN 'error' ELSE 'general' END AS kind FROM (SELECT record_id, lower(query) AS q FROM qmd_expansion_locations WHERE query IS NOT NULL)")
def classify_hyde_query(spark, root):
    return table(spark, root, "qmd_expansion_locations").where("query is not null").select("record_id", E.hyde_kind(F.col("query")).alias("kind"))


@N.query("extract_topic", "SELECT record_id, CASE " + " ".join(f"WHEN starts_with(lower(query), '{p}') THEN regexp_replace(query[{len(p) + 1}:], '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')" for p in E.TOPIC_PREFIXES) + " ELSE query END AS topic FROM qmd_expansion_locations WHERE query IS NOT NULL")
def extract_topic(spark, root):
    return table(spark, root, "qmd_expansion_locations").where("query is not null").select("record_id", E.topic(F.col("query")).alias("topic"))


@N.query("jsonl_split_sink")
def jsonl_split_sink(spark, root):
    return E.split(table(spark, root, "qmd_expansion_locations"), "record_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


QUERIES, SQL = N.QUERIES, N.SQL
