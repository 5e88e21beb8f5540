"""Source files that do not parse: all faults and their first cause per file, and rates per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm.syntax import parse

_ERRORS = pa.list_(pa.struct([("line", pa.int32()), ("cause", pa.string())]))


def parsed(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, file_path, language, valid, first_cause, first_line, errors) of every file.

    The language is that of the path's extension; what the table says of
    language and errors isn't read. A null or empty file is valid. A file of
    an unknown extension, or without a path, has language and valid null. A
    row delivered twice comes out twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(p, c) for p, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            errors = [[{"line": n, "cause": c} for n, c in g.errors] for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), b.column(2), pa.array([g.language for g in got], pa.string()),
                    pa.array([g.valid if g.language else None for g in got], pa.bool_()), pa.array([e[0]["cause"] if e else None for e in errors], pa.string()),
                    pa.array([e[0]["line"] if e else None for e in errors], pa.int32()), pa.array(errors, _ERRORS),
                ],
                names=["file_id", "repo_id", "file_path", "language", "valid", "first_cause", "first_line", "errors"],
            )

    some = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("repo_id").cast("string").alias("repo_id"), "file_path", "content")
    return some.mapInArrow(run, "file_id long, repo_id string, file_path string, language string, valid boolean, first_cause string, first_line int, errors array<struct<line: int, cause: string>>")


def fault_rates(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, language, n_files, n_faulty, n_nodes, rate): per repository and language, the files, those that don't parse, and the graph nodes that stem from the latter."""
    flags = parsed(files).where("language is not null").select("repo_id", "language", "file_path", "valid")
    counts = flags.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_faulty"))
    per_file = nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    tied = flags.where(~F.col("valid")).join(per_file, "file_path").groupBy("repo_id", "language").agg(F.sum("n").alias("n_nodes"))
    same = [counts.repo_id.eqNullSafe(tied.repo_id), counts.language == tied.language]
    return counts.join(tied, same, "left").select(counts.repo_id, counts.language, "n_files", "n_faulty", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.round(F.col("n_faulty") / F.col("n_files"), 6).alias("rate"))
