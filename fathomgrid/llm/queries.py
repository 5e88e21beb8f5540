"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from fathomgrid.llm import duplicates, encoding, fusion, leakage, neighbours, packing, pairs, sourcefiles
from fathomgrid.sources.tables import table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return duplicates.duplicate_groups(table(spark, root, "qmd_expansion_locations"))[1]


def p4_groups(spark: SparkSession, root: str) -> DataFrame:
    """One record of each kind with the number of its copies."""
    return duplicates.duplicate_groups(table(spark, root, "qmd_expansion_locations"))[0]


def p2_ranking(spark: SparkSession, root: str) -> DataFrame:
    ranked = fusion.leximin_rank(table(spark, root, "search_results"), "query_id", "node_id")
    return ranked.select("query_id", "node_id", F.round("weakest", 6).alias("weakest"), "rank")


def p2_quality(spark: SparkSession, root: str) -> DataFrame:
    """nDCG at 10 of the combined ranking per query."""
    return fusion.ranking_quality(fusion.leximin_rank(table(spark, root, "search_results"), "query_id", "node_id"), table(spark, root, "search_judgments"), "query_id", "node_id")


def p3_nearest(spark: SparkSession, root: str) -> DataFrame:
    """The 10 nodes of greatest cosine similarity of every usable node."""
    found = neighbours.nearest(table(spark, root, "node_embeddings_raw"), "node_id", "embedding")
    return found.select(F.col("id").alias("node_id"), F.col("neighbour").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"), "rank")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of at least 0.95 among the 10 nearest; a pair that either side finds counts."""
    found = neighbours.nearest(table(spark, root, "node_embeddings_raw"), "node_id", "embedding").where("similarity >= 0.95 - 1e-7")
    return found.select(F.least("id", "neighbour").alias("node_id_1"), F.greatest("id", "neighbour").alias("node_id_2")).distinct()


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, root, "documents")))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_items(spark: SparkSession, root: str) -> DataFrame:
    """The leaked items with their kind and the number of documents that hold them."""
    items = table(spark, root, "eval_items")
    found = leakage.leaked(table(spark, root, "documents"), items)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents")).join(items.select("item_id", "kind"), "item_id").select("item_id", "kind", "n_documents")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return encoding.repair(table(spark, root, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, root: str) -> DataFrame:
    """The affected documents with their restored text."""
    return encoding.repair(table(spark, root, "documents"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return pairs.defects(table(spark, root, "qmd_expansion_locations")).select("record_id", "defect")


def p6_rates(spark: SparkSession, root: str) -> DataFrame:
    """Number of defective pairs by defect."""
    return pairs.defects(table(spark, root, "qmd_expansion_locations")).groupBy("defect").agg(F.count(F.lit(1)).alias("n"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return sourcefiles.parsed(table(spark, root, "parse_results")).where(~F.col("valid")).select("file_id")


def p1_rates(spark: SparkSession, root: str) -> DataFrame:
    return sourcefiles.fault_rates(table(spark, root, "parse_results"), table(spark, root, "graph_nodes"))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p6_found": p6_found, "p6_rates": p6_rates, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_restored": p10_restored, "p8_containers": p8_containers, "p8_fill": p8_fill, "p2_ranking": p2_ranking, "p2_quality": p2_quality, "p3_found": p3_found, "p3_nearest": p3_nearest, "p4_found": p4_found, "p4_groups": p4_groups}
_SCORES = """WITH c AS (SELECT query_id, node_id, CASE WHEN isfinite(raw_score) THEN -raw_score END AS raw, CASE WHEN isfinite(rrf_score) THEN rrf_score END AS rrf, -fts_rank AS fts, -vector_rank AS vec, CASE WHEN isfinite(rerank_score) THEN rerank_score END AS rer FROM search_results),
b AS (SELECT query_id, node_id, max(raw) AS raw, max(rrf) AS rrf, max(fts) AS fts, max(vec) AS vec, max(rer) AS rer FROM c GROUP BY ALL),
p AS (SELECT query_id, node_id, {cols} FROM b),
e AS (SELECT query_id, node_id, p_rrf, CASE WHEN p_raw IS NULL THEN p_fts WHEN p_fts IS NULL THEN p_raw ELSE (p_raw + p_fts) / 2 END AS lex, p_vec AS vec, p_rer AS rer FROM p),
f AS (SELECT *, coalesce(list_avg(list_filter([lex, vec, rer], lambda x: x IS NOT NULL)), 0.5) AS own FROM e),
v AS (SELECT query_id, node_id, p_rrf, list_sort([round(coalesce(lex, own), 9), round(coalesce(vec, own), 9), round(coalesce(rer, own), 9)]) AS w FROM f),
r AS (SELECT query_id, node_id, w, row_number() OVER (PARTITION BY query_id ORDER BY w[1] DESC, w[2] DESC, w[3] DESC, round(p_rrf, 9) DESC NULLS LAST, node_id) AS rank FROM v) """.format(
    cols=", ".join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY query_id ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY query_id, {c}) - 1) / 2.0 - 0.5) / count({c}) OVER (PARTITION BY query_id) END AS p_{c}" for c in ("raw", "rrf", "fts", "vec", "rer"))
)
_LETTERS = "regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_COPIES = f"""WITH c AS (SELECT record_id, list_filter(list_transform(string_split_regex(query, '[;|]'), lambda p: {_LETTERS.format("p")}), lambda p: length(p) > 0) AS parts,
 list_bool_and(list_transform(list_filter(string_split_regex(query, '[;|]'), lambda p: length({_LETTERS.format("p")}) > 0), lambda p: regexp_matches(p, '^[^:]*[\\p{{L}}\\p{{N}}][^:]*:(?s:.*)[\\p{{L}}\\p{{N}}]'))) AS named,
 {_LETTERS.format("query")} AS plain, {_LETTERS.format("category")} AS cat, list_sort(list_transform(output, lambda i: {_LETTERS.format("i[1]")} || '~' || coalesce({_LETTERS.format("i[2]")}, ''))) AS items FROM qmd_expansion_locations),
k AS (SELECT record_id, CASE WHEN len(parts) >= 2 AND named THEN '~' || array_to_string(list_sort(parts), '~') ELSE plain END AS q, cat, items FROM c),
g AS (SELECT record_id, min(record_id) OVER w AS first, count(*) OVER w AS copies FROM k WINDOW w AS (PARTITION BY q, cat, items)) """

SQL = {
    "p2_ranking": _SCORES + "SELECT query_id, node_id, round(w[1], 6) AS weakest, rank FROM r",
    "p2_quality": _SCORES
    + """, j AS (SELECT query_id, node_id, max(relevance) AS relevance FROM search_judgments WHERE relevance IS NOT NULL GROUP BY ALL),
a AS (SELECT query_id, power(2.0, relevance) - 1 AS gain, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, node_id) AS ideal FROM r JOIN j USING (query_id, node_id)),
s AS (SELECT query_id, sum(CASE WHEN pos <= 10 THEN gain / log2(pos + 1) END) AS d, sum(CASE WHEN ideal <= 10 THEN gain / log2(ideal + 1) END) AS i FROM a GROUP BY 1)
SELECT query_id, round(d / i, 6) AS ndcg FROM s WHERE i > 0""",
    "p3_found": """WITH v AS (SELECT node_id, embedding::DOUBLE[] AS e FROM node_embeddings_raw WHERE len(embedding) = 768 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))
SELECT a.node_id AS node_id_1, b.node_id AS node_id_2 FROM v a JOIN v b ON a.node_id < b.node_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95""",
    "p4_found": _COPIES + "SELECT first AS record_id_1, record_id AS record_id_2 FROM g WHERE record_id > first",
    "p4_groups": _COPIES + "SELECT record_id, copies FROM g WHERE record_id = first",
}
