"""Runs that index only the files that changed since the last one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.operators.catalog import difference
from fathomgrid.operators.parsing import edges_of, nodes_of, parse_files
from fathomgrid.plans.durable import materialize


@dataclass(frozen=True)
class Indexed:
    """The graph after a run, the hashes to start the next one from, and per file what was done (change: new, updated, gone or unchanged)."""

    nodes: DataFrame
    edges: DataFrame
    hashes: DataFrame
    changes: DataFrame


def empty_graph(files: DataFrame) -> Indexed:
    """What a first run starts from."""
    rows = parse_files(files.where("false"))
    nodes = nodes_of(rows)
    return Indexed(nodes, edges_of(rows, nodes, files.where("false")), files.where("false").select("file_path", F.md5("content").alias("hash")), files.where("false").select("file_path", F.lit("").alias("change")))


def _of_file(node: str):
    """The file in an identifier label:path:name."""
    return F.split(node, ":")[1]


def reindex(before: Indexed, files: DataFrame, stamp: dict[str, str] | None = None) -> Indexed:
    """Bring a graph to the present files (file_path unique, content; repo_id if there is one).

    Files are told by the hash of their content. Nodes of files that changed
    or are gone are dropped, changed and new files alone are parsed, and
    their edges are resolved against all nodes. Of the edges that other files
    keep, those whose target went are resolved anew by name, where the last
    identifier of that name counts; a call that isn't met keeps a null
    target, any other edge is dropped. New nodes get the columns of `stamp`
    (repository, branch, commit). A null content is an empty file. A run
    that is repeated finds nothing changed.
    """
    now = files.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("hash", F.md5("content"))
    changes = materialize(difference(before.hashes, now, ["file_path"], ["hash"]), "changes")
    dirty = changes.where("change in ('new', 'updated')").select("file_path")
    touched = changes.where("change <> 'unchanged'").select("file_path")
    rows = materialize(parse_files(now.join(dirty, "file_path", "left_semi")), "parsed")
    fresh = nodes_of(rows)
    for c, v in (stamp or {}).items():
        fresh = fresh.withColumn(c, F.lit(v))
    nodes = materialize(before.nodes.join(touched, "file_path", "left_anti").unionByName(fresh, allowMissingColumns=True), "nodes")
    kept = before.edges.join(touched.select(F.col("file_path").alias("_file")), _of_file("source") == F.col("_file"), "left_anti")
    there = nodes.select(F.col("id").alias("target"), F.lit(True).alias("_there"))
    lost = kept.where(F.col("target").isNotNull() & ~F.col("target").startswith("file:")).join(there, "target", "left_anti")
    named = nodes.groupBy("name").agg(F.max("id").alias("_new"))
    again = lost.withColumn("name", F.regexp_extract("target", "([^:]*)$", 1)).join(named, "name", "left")
    again = again.withColumns({"target": F.col("_new"), "confidence": F.when(F.col("_new").isNotNull(), F.least(F.col("confidence"), F.lit(0.5)))}).where("target is not null or rel_type = 'calls'")
    gone = changes.where("change = 'gone'").select(F.concat_ws(":", F.lit("file"), "file_path", F.element_at(F.split("file_path", "/"), -1)).alias("target"))
    stay = kept.where("target is null").unionByName(kept.where("target like 'file:%'").join(gone, "target", "left_anti")).unionByName(kept.join(there.select("target"), "target", "left_semi").where("target not like 'file:%'"))
    columns = before.edges.columns
    edges = stay.select(columns).unionByName(again.select(columns)).unionByName(edges_of(rows, nodes, now).select(columns))
    return Indexed(nodes, materialize(edges, "edges"), now.select("file_path", "hash"), changes)
