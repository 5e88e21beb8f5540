"""Joins, aggregations and positions that stay distributed when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.plans.durable import materialize

#: A key is hot from this share of all rows on. At most 1/HOT_SHARE keys can be hot, so a table of hot keys is bounded.
HOT_SHARE = 0.002
#: A key with fewer rows than this is never hot, whatever its share.
HOT_ROWS = 50_000


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_ROWS) -> list:
    """Values of `key` that hold at least `share` of all of df's rows and `least` rows.

    Exact counts with map-side partial counts. The list has at most 1/share
    entries, whatever df's size. Null is never hot, but its rows count among all.
    """
    bound = max(least, share * df.count())
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.where(F.col("n") >= bound).orderBy(F.desc("n"), key).limit(int(1 / share)).select(key).collect()]


def lookup_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "left") -> DataFrame:
    """Join left to right, whose `key` is unique, with left's hot keys kept where they are.

    Rows of left with a hot key meet the few rows of right with a hot key in
    a broadcast join (at most len(hot) rows); all others are shuffled by key.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    spread = left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how)
    return spread.unionByName(left.where(~is_hot).join(right, key, how))


def positions(df: DataFrame, group: str, order: list[Column], name: str = "pos", hot_rows: int = 1_000_000, parts: int = 64) -> DataFrame:
    """Add the 1-based position of each row within its group.

    Groups of fewer than hot_rows rows are numbered by one window. Each
    larger one is range-partitioned over `parts` tasks, sorted there, and
    numbered by partition offsets, so that no task ever holds a whole group.
    Null is a group of its own. `order` should be total; equal rows get
    different positions in any order.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_rows)
    hot = [r[0] for r in sizes.select(group).collect()]  # at most rows/hot_rows values
    window = Window.partitionBy(group).orderBy(*order)
    if not hot:
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    is_hot = reduce(lambda a, b: a | b, [F.col(group).eqNullSafe(F.lit(h)) for h in hot])
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.where(is_hot).repartitionByRange(parts, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    fixed = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", low), "positions")
    starts = fixed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first", before.alias("_before"))
    numbered = fixed.join(F.broadcast(starts), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))  # parts rows per hot group
    numbered = numbered.withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long")).select(*df.columns, name)
    return numbered.unionByName(df.where(~is_hot).withColumn(name, F.row_number().over(window).cast("long")))
