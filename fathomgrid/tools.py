"""The tools of a search service as functions that give tables: search, vector_search, deep_search, get, multi_get and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.functions import text as T
from fathomgrid.operators import lexical as L
from fathomgrid.operators import ranking as R
from fathomgrid.sources.files import glob_regex

WEIGHTS = {"path": 10.0, "title": 1.0, "body": 1.0}
MOST_CHARS = 10 * 1024


def _fields() -> dict:
    return {"path": F.concat_ws("/", "collection", "path"), "title": F.col("title"), "body": F.col("text")}


def search(documents: DataFrame, query: str, limit: int = 20, least: float = 0.0, collection: str | None = None) -> DataFrame:
    """(doc_id, collection, path, title, score, line, header, text) by full text; all terms must be there."""
    active = documents.where("active = 1") if collection is None else documents.where((F.col("active") == 1) & (F.col("collection") == collection))
    hits = L.bm25(documents, "doc_id", _fields(), WEIGHTS, query).withColumn("score", L.unit_score(F.col("raw")))
    best = L.top(hits.join(active.select("doc_id"), "doc_id", "left_semi").where(F.col("score") >= least), "score", "doc_id", limit)
    shown = best.join(active, "doc_id").select("doc_id", "collection", "path", "title", "score", T.snippet(F.col("text"), [w for w in query.lower().split() if w]).alias("s"))
    return shown.select("doc_id", "collection", "path", "title", F.round("score", 4).alias("score"), "s.line", "s.header", "s.text").orderBy(F.desc("score"), "doc_id")


def vector_search(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int = 10, least: float = 0.3) -> DataFrame:
    return R.knn(vectors, key, vector, query, limit).where(F.col("similarity") >= least)


def deep_search(documents: DataFrame, query: str, expansions: list[str] = (), limit: int = 10) -> DataFrame:
    """Fused full-text lists of the query and its expansions, where the first two lists weigh double."""
    active = documents.where("active = 1")
    lists = [(L.top(L.bm25(active, "doc_id", _fields(), WEIGHTS, q, every=False), "raw", "doc_id", 40), "raw") for q in (query, *expansions)]
    fused = R.fuse(lists, "doc_id", [2.0 if i < 2 else 1.0 for i in range(len(lists))])
    return L.top(fused, "score", "doc_id", limit).join(active.select("doc_id", "collection", "path", "title"), "doc_id").orderBy(F.desc("score"), "doc_id")


def get(documents: DataFrame, name: str, start: int = 1, count: int | None = None) -> DataFrame:
    """(doc_id, path, body) of one document by docid, path, end of a path or `path:line`; best match first, at most one row."""
    line = name.rsplit(":", 1) if name.rpartition(":")[2].isdigit() else None
    name, start = (line[0], int(line[1])) if line else (name, start)
    bare = name.strip().strip("'\"").lstrip("#")
    full = F.concat_ws("/", "collection", "path")
    how = F.when(F.lower("hash").startswith(bare.lower()) & F.lit(len(bare) >= 6), 0).when((full == bare) | (F.col("path") == bare), 1).when(full.endswith(bare), 2)
    hit = documents.where("active = 1").withColumn("how", how).where("how is not null").orderBy("how", "doc_id").limit(1)
    body = F.col("text") if start == 1 and count is None else F.array_join(F.slice(F.split("text", "\n"), start, count or 1_000_000_000), "\n")
    return hit.select("doc_id", "path", body.alias("body"))


def multi_get(documents: DataFrame, names: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """(doc_id, path, body, skipped) of documents by a comma-separated list or a glob; a long one has a reason instead of a body."""
    full = F.concat_ws("/", "collection", "path")
    some = F.lit(False)
    for n in (x.strip() for x in names.split(",")):
        some = some | (full.rlike(glob_regex(n)) | F.col("path").rlike(glob_regex(n)) if any(c in n for c in "*?") else full.endswith(n))
    long_ = F.length("text") > most_chars
    return documents.where(some & (F.col("active") == 1)).select("doc_id", "path", F.when(~long_, F.col("text")).alias("body"), F.when(long_, F.format_string("file has %d characters, the limit is %d", F.length("text"), F.lit(most_chars))).alias("skipped"))


def similar_names(documents: DataFrame, name: str, most: int = 5, distance: int = 5) -> DataFrame:
    d = F.levenshtein(F.lower("path"), F.lit(name.lower()), distance)
    return documents.where("active = 1").select("path", d.alias("distance")).where("distance >= 0").distinct().orderBy("distance", "path").limit(most)


def status(documents: DataFrame) -> DataFrame:
    """(collection, n, last) of the active documents, newest first."""
    return documents.where("active = 1").groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.max("modified_at").alias("last")).orderBy(F.desc_nulls_last("last"), "collection")
