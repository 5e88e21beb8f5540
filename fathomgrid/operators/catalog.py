"""The document catalog: merge, difference, soft deletion, orphans, cache, contexts and status, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by `order`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace rows of old with the same key. Null keys match null keys. A key repeated in new must be made unique before."""
    same = [old[k].eqNullSafe(new[k]) for k in key]
    return old.join(new, same, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new are added unless their key is there; of a key repeated in new, one row is added."""
    same = [new[k].eqNullSafe(old[k]) for k in key]
    return old.unionByName(new.join(old, same, "left_anti").dropDuplicates(key))


def merge_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """(collection, path, title, hash, created_at, modified_at, active): on the same collection and path, title, hash and modification are taken from new, the creation is kept and the row is active again."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, (F.col("o.collection") == F.col("n.collection")) & (F.col("o.path") == F.col("n.path")), "full_outer")
    pick = lambda c: F.when(F.col("n.path").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return joined.select(
        F.coalesce("n.collection", "o.collection").alias("collection"), F.coalesce("n.path", "o.path").alias("path"), pick("title"), pick("hash"),
        F.coalesce("o.created_at", "n.created_at").alias("created_at"), pick("modified_at"), F.when(F.col("n.path").isNotNull(), 1).otherwise(F.col("o.active")).alias("active"),
    )


def difference(old: DataFrame, new: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """(key, change): new, updated, unchanged or gone."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in [*key, *compare]], F.lit(1).alias("o_there"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in [*key, *compare]], F.lit(1).alias("n_there"))
    both = o.join(n, [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in key], "full_outer")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    change = F.when(F.col("o_there").isNull(), "new").when(F.col("n_there").isNull(), "gone").when(same, "unchanged").otherwise("updated")
    return both.select(*[F.coalesce(f"n_{k}", f"o_{k}").alias(k) for k in key], change.alias("change"))


def deactivate_unseen(catalog: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    there = seen.select(*[F.col(k).alias(f"_{k}") for k in key], F.lit(1).alias("_seen")).distinct()
    joined = catalog.join(there, [catalog[k].eqNullSafe(F.col(f"_{k}")) for k in key], "left")
    return joined.withColumn("active", F.when(F.col("_seen").isNull(), 0).otherwise(F.col("active"))).select(*catalog.columns)


def unreferenced(rows: DataFrame, key: str, references: DataFrame, column: str) -> DataFrame:
    """Rows whose key no reference holds. A row without a key counts as unreferenced."""
    used = references.where(F.col(column).isNotNull()).select(F.col(column).alias("_used")).distinct()
    return rows.join(used, F.col(key) == F.col("_used"), "left_anti")


def without_file(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the files, where an edge goes with either of its ends."""
    doomed = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("_gone"))
    kept = edges.join(doomed, F.col("source") == F.col("_gone"), "left_anti").join(doomed, F.col("target") == F.col("_gone"), "left_anti")
    return nodes.join(files.select("file_path").distinct(), "file_path", "left_anti"), kept


def newest(cache: DataFrame, at: str, tie: str, keep: int = 1000) -> DataFrame:
    """What stays of a cache: its `keep` newest entries."""
    return cache.orderBy(F.desc(at), tie).limit(keep)


def collection_stats(names: DataFrame, documents: DataFrame) -> DataFrame:
    """(collection, n, n_active, last): every collection, also an empty one."""
    counts = documents.groupBy("collection").agg(F.count("doc_id").alias("n"), F.sum(F.when(F.col("active") == 1, 1).otherwise(0)).alias("n_active"), F.max("modified_at").alias("last"))
    return names.join(counts, "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_active", F.lit(0)).alias("n_active"), "last")


def prefix_contexts(paths: DataFrame, contexts: DataFrame, path: str = "path") -> DataFrame:
    """The contexts of each path: all whose prefix it begins with, the shortest first, joined by an empty line. contexts (collection, prefix, context) are configuration, a row per folder, and are broadcast."""
    hits = paths.join(F.broadcast(contexts), "collection").where(F.col(path).startswith(F.col("prefix")))
    ordered = F.array_sort(F.collect_list(F.struct(F.length("prefix").alias("n"), "prefix", "context")))
    return hits.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["context"]), "\n\n").alias("context"))


def longest_prefix(paths: DataFrame, contexts: DataFrame, default: str, path: str = "path") -> DataFrame:
    """(doc_id, context): the context of the longest prefix, else the default."""
    hits = paths.join(F.broadcast(contexts), "collection").where(F.col(path).startswith(F.col("prefix")))
    best = hits.groupBy("doc_id").agg(F.max_by("context", F.struct(F.length("prefix"), "prefix")).alias("context"))
    return paths.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("context", F.lit(default)).alias("context"))
