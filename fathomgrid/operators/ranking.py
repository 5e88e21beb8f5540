"""Vector search, rank fusion, reranking, blending and expansion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.functions.query import path_prior
from fathomgrid.functions.text import cosine


def knn(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(key, similarity): the k rows most similar to one query vector; null vectors are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sims = vectors.where(F.col(vector).isNotNull()).select(key, cosine(F.col(vector), q).alias("similarity"))
    return sims.orderBy(F.desc(F.round("similarity", 9)), key).limit(k)


def knn_filtered_after(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int, keep: DataFrame) -> DataFrame:
    """As knn over all rows with three times the limit, of which those in keep (key) stay, at most limit: a filtered search may find fewer."""
    near = knn(vectors, key, vector, query, 3 * limit).join(keep.select(key).distinct(), key, "left_semi")
    return near.orderBy(F.desc(F.round("similarity", 9)), key).limit(limit)


def multi_query(vectors: DataFrame, key: str, vector: str, queries: list[list[float]], least: float, limit: int) -> DataFrame:
    """Best similarity over several query vectors, at least `least`."""
    best = F.greatest(*[cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in q])) for q in queries]) if len(queries) > 1 else cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in queries[0]]))
    rows = vectors.where(F.col(vector).isNotNull()).select(key, best.alias("similarity")).where(F.col("similarity") >= least)
    return rows.groupBy(key).agg(F.max("similarity").alias("similarity")).orderBy(F.desc(F.round("similarity", 9)), key).limit(limit)


def ranked(rows: DataFrame, key: str, score: str, group: list[str] | None = None) -> DataFrame:
    """Add the 0-based rank by score."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*(group or [])).orderBy(F.desc(F.round(score, 9)), key)) - 1)


def rrf(lists: DataFrame, key: str, k: int = 60, bonus: bool = True, group: list[str] | None = None) -> DataFrame:
    """(group, key, score, top_rank) of lists (group, list, weight, key, rank): the sum of weight / (k + rank + 1); with the bonus, 0.05 for a first place in any list, else 0.02 for a second or third."""
    by = [*(group or []), key]
    one = lists.groupBy(*by).agg(F.sum(F.col("weight") / (k + F.col("rank") + 1)).alias("score"), F.min("rank").alias("top_rank"))
    extra = F.when(F.col("top_rank") == 0, 0.05).when(F.col("top_rank") <= 2, 0.02).otherwise(0.0) if bonus else F.lit(0.0)
    return one.withColumn("score", F.col("score") + extra)


def as_list(rows: DataFrame, key: str, score: str, weight: float, number: int) -> DataFrame:
    return ranked(rows, key, score).select(F.lit(number).alias("list"), F.lit(weight).alias("weight"), key, "rank")


def fuse(lists: list[tuple[DataFrame, str]], key: str, weights: list[float], k: int = 60, bonus: bool = True) -> DataFrame:
    """rrf of score tables."""
    return rrf(reduce(DataFrame.unionByName, [as_list(df, key, score, w, i) for i, ((df, score), w) in enumerate(zip(lists, weights))]), key, k, bonus)


def _ranks() -> list:
    """1-based places by full text and by vector; null where a list of the kind doesn't have the row."""
    at = lambda kind: (F.min(F.when(F.col("kind") == kind, F.col("rank"))) + 1).alias(f"{kind}_rank")
    return [at("fts"), at("vector")]


def rrf_unified(lists: DataFrame, key: str, k: int = 60, site_factor: float = 1.5, group: list[str] | None = None) -> DataFrame:
    """(group, key, score, fts_rank, vector_rank) of lists (group, kind 'fts' or 'vector', weight, key, rank, boosted) of symbols and chunks; call sites (boosted) weigh site_factor times as much."""
    weight = F.col("weight") * F.when(F.col("boosted"), site_factor).otherwise(1.0)
    return lists.groupBy(*(group or []), key).agg(F.sum(weight / (k + F.col("rank") + 1)).alias("score"), *_ranks())


def rrf_chunks(lists: DataFrame, key: str, k: int = 60, group: list[str] | None = None) -> DataFrame:
    """(group, key, rrf_score, score, fts_rank, vector_rank) of lists (group, kind, weight, key, rank, relevance): the fused score beside the best relevance of any list."""
    return lists.groupBy(*(group or []), key).agg(F.sum(F.col("weight") / (k + F.col("rank") + 1)).alias("rrf_score"), F.max("relevance").alias("score"), *_ranks())


def hybrid(lists: list[tuple[DataFrame, str]], rows: DataFrame, query: str, limit: int, rerank: int = 50) -> DataFrame:
    """(id, final) of score tables (id, score): fused with equal weights, the best `rerank` reranked by rules over their rows, blended, at most limit. Those behind keep their fused part alone."""
    fused = ranked(fuse(lists, "id", [1.0] * len(lists), bonus=False), "id", "score")  # at most the lists' lengths
    found = heuristic_rerank(fused.join(rows, "id"), query).withColumn("heuristic", F.when(F.col("rank") < rerank, F.col("heuristic")))
    return blend(found, "score", "heuristic").orderBy(F.desc(F.round("final", 9)), "id").limit(limit)


def position_blend(rows: DataFrame, rank: str, rerank: str) -> DataFrame:
    """Blend 1 / rank (1-based) with a reranker's score; the better the rank, the more it counts."""
    w = F.when(F.col(rank) <= 3, 0.75).when(F.col(rank) <= 10, 0.60).otherwise(0.40)
    return rows.withColumn("score", w / F.col(rank) + (1 - w) * F.col(rerank))


def blend(rows: DataFrame, rrf_score: str, rerank: str, model: bool = False, group: list[str] | None = None, key: str = "id") -> DataFrame:
    """0.7 of the fused and 0.3 of the reranker's score, both clamped to [0, 1]; a model's scores are first turned into shares of rank."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    r = F.coalesce(F.col(rerank), F.lit(0.0))
    if model:
        by = Window.partitionBy(*(group or []))
        n = F.count(rerank).over(by)
        at = F.row_number().over(by.orderBy(F.desc_nulls_last(rerank), key))
        rows = rows.withColumn("_share", F.when(F.col(rerank).isNotNull(), (n - at + 1) / n))
        r = F.coalesce("_share", F.lit(0.0))
    out = rows.withColumn("final", 0.7 * unit(F.coalesce(F.col(rrf_score), F.lit(0.0))) + 0.3 * unit(r))
    return out.drop("_share") if model else out


def heuristic_rerank(rows: DataFrame, query: str) -> DataFrame:
    """rows (id, name, file_path, signature, class_name, content) with `heuristic`: weighted matches of the query in name, signature, path, class and content."""
    q = query.lower()
    words = [w for w in q.split() if w]
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    share = lambda c: sum((c.contains(w).cast("int") for w in words), F.lit(0)) / max(len(words), 1)
    name, path, sig, cls, text = (low(c) for c in ("name", "file_path", "signature", "class_name", "content"))
    by_name = F.when(name == q, 1.0).when(name.contains(q), 0.8).otherwise(share(name) * 0.5)
    by_path = F.when(path.contains(q), 0.8).otherwise(share(path) * 0.4)
    by_sig = F.when(sig.contains(q), 0.7).otherwise(0.0)
    by_class = F.when((cls != "") & (cls == q), 0.9).when(cls.contains(q), 0.6).otherwise(0.0)
    count = lambda w: (F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)
    by_text = F.least(sum((F.least(count(w), F.lit(5.0)) for w in words), F.lit(0.0)) / max(3 * len(words), 1), F.lit(1.0))
    return rows.withColumn("heuristic", 0.30 * by_name + 0.25 * by_sig + 0.20 * by_path + 0.15 * by_class + 0.10 * by_text)


def with_prior(rows: DataFrame, score: str, query: str, path: str = "file_path") -> DataFrame:
    return rows.withColumn(score, F.col(score) * path_prior(F.col(path), F.lit(query)))


def expand(seeds: DataFrame, edges: DataFrame, most: int = 5, damp: float = 0.5) -> DataFrame:
    """(id, score) of nodes one call away from the seeds (id, score), at most `most` per seed and direction, with their best damped score; seeds are left out."""
    e = edges.where("rel_type = 'calls' and target is not null").select("source", "target").distinct()
    way = lambda a, b: seeds.join(e, F.col("id") == F.col(a)).select(F.col("id").alias("seed"), F.col(b).alias("other"), "score")
    top = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("other"))).where(F.col("n") <= most)
    both = top(way("source", "target")).unionByName(top(way("target", "source")))
    best = both.groupBy(F.col("other").alias("id")).agg(F.max(F.col("score") * damp).alias("score"))
    return best.join(seeds.select("id"), "id", "left_anti")
