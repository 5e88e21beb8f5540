"""Items of unlike length into containers of fixed capacity: minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.plans.durable import materialize
from fathomgrid.plans.skew import positions

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary of that file cuts a text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """(id_col, n_tokens) of whole texts; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], names=[id_col, "n_tokens"])

    return documents.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, n_tokens long")


def pieces(counts: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, n_tokens): one piece per item, or, above the capacity, full pieces and the rest. An item without tokens has none."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(capacity).cast("long")))
    cut = counts.where("n_tokens > 0").withColumn("start", start)
    return cut.select(id_col, (F.col("start") / capacity).cast("int").alias("piece"), "start", F.least(F.col("n_tokens") - F.col("start"), F.lit(capacity)).alias("n_tokens"))


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """The combination of available lengths with the greatest sum of at most `room`: subset sums as bits of one number, longer lengths first, multiplicities in powers of two."""
    reach, layers, full = 1, [], 1 << room
    keep = (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, step = min(int(counts[length]), room // length), 1
        while left:
            times = min(step, left)
            grown = (reach | (reach << (times * length))) & keep
            if grown != reach:
                layers.append((length, times, reach))
                reach = grown
                if reach & full:
                    break
            left, step = left - times, step * 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + times
            at -= times * length
    return used


def minimum_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Containers as (lengths with their multiplicity, number of such containers).

    Each container takes the longest item left and the fullest feasible
    combination for the rest of its room. As only lengths matter, a
    combination is repeated as long as all its lengths last, so there are at
    most about two solves per length, however many items there are.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = []
    while (left := np.flatnonzero(counts)).size:
        longest = int(left[-1])
        counts[longest] -= 1
        used = fullest(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(int(counts[length]) // m for length, m in used.items())
        for length, m in used.items():
            counts[length] -= m * times
        plan.append((used, times))
    return plan


def pack(documents: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, hot_rows: int = 1_000_000) -> DataFrame:
    """(container, id, piece, start, n_tokens): every item in a container, none above the capacity.

    Only a text longer than the capacity is divided, at multiples of it. A
    null or empty text takes no room and comes out once, with container null.
    The driver sees only the histogram of lengths (at most `capacity`
    numbers). Items of one length are numbered by identifier and piece, and
    the number's range in the plan tells the container; a length that
    hot_rows rows or more share is numbered over many tasks.
    """
    spark: SparkSession = documents.sparkSession
    counts = materialize(token_counts(documents, id_col, text_col, path), "tokens")
    items = pieces(counts, capacity, id_col)
    plan = minimum_slack({int(n): int(c) for n, c in items.groupBy("n_tokens").count().collect()}, capacity)
    base, taken, runs = 0, {}, []
    for used, times in plan:
        for length, m in used.items():
            runs.append((length, taken.get(length, 0), base, m))
            taken[length] = taken.get(length, 0) + m * times
        base += times
    runs = np.array(sorted(runs), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((runs[:, 0] << 44 | runs[:, 1], runs))  # a few rows per length, at most

    @F.pandas_udf("long")
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        keys, table = shared.value
        r = rank.to_numpy() - 1
        row = table[np.searchsorted(keys, length.to_numpy() << 44 | r, side="right") - 1]
        return pd.Series(row[:, 2] + (r - row[:, 1]) // row[:, 3])

    ranked = positions(items, "n_tokens", [F.col(id_col), F.col("piece")], "_rank", hot_rows)
    placed = ranked.select(container("n_tokens", "_rank").alias("container"), id_col, "piece", "start", "n_tokens")
    none = counts.where("n_tokens = 0").select(F.lit(None).cast("long").alias("container"), id_col, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "n_tokens")
    return placed.unionByName(none)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the least number that could do, and the share of room that is used."""
    one = packed.where("container is not null").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return one.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("used"))
