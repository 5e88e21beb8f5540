"""One ranking from several scores of unlike scale: leximin over percentiles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.plans.skew import lookup_join, positions


@dataclass(frozen=True)
class Evidence:
    """Columns that say the same thing in different units, each with its sense (1: more is better, -1: less is better). Their percentiles are averaged, so that a thing said twice doesn't count twice."""

    name: str
    columns: tuple[tuple[str, int], ...]


#: A full-text score and its rank are one evidence; the fused score only repeats the two ranks, so it settles ties.
SEARCH_EVIDENCE = (Evidence("lexical", (("raw_score", -1), ("fts_rank", -1))), Evidence("vector", (("vector_rank", -1),)), Evidence("rerank", (("rerank_score", 1),)))
SEARCH_TIES = (("rrf_score", 1),)


def _finite(c: str, sense: int) -> Column:
    x = F.col(c).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x * sense)


def percentiles(df: DataFrame, group: str, columns: list[str], hot_rows: int = 1_000_000) -> DataFrame:
    """Replace each column by its percentile in the group: (mid rank of its ties - 1/2) / number of values. Nulls stay null and don't count.

    Groups of hot_rows rows or more are ranked by range partitions instead of one window.
    """
    hot = [r[0] for r in df.groupBy(group).count().where(F.col("count") >= hot_rows).select(group).collect()]  # at most rows/hot_rows values
    is_hot = reduce(lambda a, b: a | b, [F.col(group).eqNullSafe(F.lit(h)) for h in hot], F.lit(False))
    cold = df.where(~is_hot)
    for c in columns:
        by, tied = Window.partitionBy(group), Window.partitionBy(group, c)
        mid = F.rank().over(by.orderBy(F.col(c).asc_nulls_last())) + (F.count(F.lit(1)).over(tied) - 1) / 2
        cold = cold.withColumn(c, F.when(F.col(c).isNotNull(), (mid - 0.5) / F.count(c).over(by)))
    if not hot:
        return cold
    warm = df.where(is_hot)
    for c in columns:
        at = positions(warm.where(F.col(c).isNotNull()).select(group, c), group, [F.col(c)], "_pos", hot_rows)
        many = warm.groupBy(F.col(group).alias("_g")).agg(F.count(c).alias("_n"))
        mids = at.groupBy(group, c).agg(F.avg("_pos").alias("_mid")).join(F.broadcast(many), F.col(group).eqNullSafe(F.col("_g")))  # a row per hot group
        key = F.to_json(F.struct(F.col(group).cast("string").alias("g"), F.col(c).cast("string").alias("c")))
        mids = mids.select(key.alias("_key"), ((F.col("_mid") - 0.5) / F.col("_n")).alias("_p"))
        keyed = warm.withColumn("_key", F.when(F.col(c).isNotNull(), key))
        big = keyed.groupBy("_key").count().where(F.col("count") >= hot_rows).where("_key is not null")
        ties = [r[0] for r in big.select("_key").collect()]
        warm = lookup_join(keyed, mids, "_key", ties).drop(c, "_key").withColumnRenamed("_p", c)
    return cold.unionByName(warm.select(*cold.columns))


def leximin_rank(candidates: DataFrame, group: str, item: str, evidence: tuple[Evidence, ...] = SEARCH_EVIDENCE, ties: tuple = SEARCH_TIES, hot_rows: int = 1_000_000, gap: str = "own") -> DataFrame:
    """(group, item, weakest, worst_to_best, rank): one row per item and group, best first.

    Scores become percentiles within the group, each item's own vector of
    evidence is sorted ascending, and vectors are compared from their weakest
    place on, so that no strong score hides a weak one and no range counts.
    An item found several times keeps its best value of each column. Null,
    NaN and infinite values are gaps; a gap is filled with the mean of the
    item's own evidence (gap 'own'), with 1/2 ('half') or with 0 ('last', so
    that no one strong score hides what is missing); an item without any
    evidence counts as middling (1/2), or as last.
    Further ties go by `ties`, then by item.
    """
    senses = {c: s for e in evidence for c, s in e.columns} | dict(ties)
    best = candidates.groupBy(group, item).agg(*[F.max(_finite(c, s)).alias(c) for c, s in senses.items()])
    p = percentiles(best, group, list(senses), hot_rows)

    def mean(cs: list[Column]) -> Column:
        there = F.filter(F.array(*cs), lambda x: x.isNotNull())
        return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))

    p = p.withColumns({f"_{e.name}": mean([F.col(c) for c, _ in e.columns]) for e in evidence})
    own = [F.col(f"_{e.name}") for e in evidence]
    fill = {"own": F.coalesce(mean(own), F.lit(0.5)), "half": F.lit(0.5), "last": F.lit(0.0)}[gap]
    p = p.withColumn("worst_to_best", F.array_sort(F.array(*[F.round(F.coalesce(c, fill), 9) for c in own])))
    order = [F.get("worst_to_best", F.lit(i)).desc() for i in range(len(evidence))] + [F.round(c, 9).desc_nulls_last() for c, _ in ((F.col(t), s) for t, s in ties)] + [F.col(item)]
    ranked = positions(p.select(group, item, "worst_to_best", *[c for c, _ in ties]), group, order, "rank", hot_rows)
    return ranked.select(group, item, F.get("worst_to_best", F.lit(0)).alias("weakest"), "worst_to_best", "rank")


def ranking_quality(ranked: DataFrame, judged: DataFrame, group: str, item: str, k: int = 10) -> DataFrame:
    """nDCG at k per group over the judged items, with gain 2^relevance - 1; groups without a relevant item are left out."""
    rel = judged.where("relevance is not null").groupBy(group, item).agg(F.max("relevance").alias("relevance"))
    both = ranked.join(rel, [group, item])
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    at = lambda order: F.row_number().over(Window.partitionBy(group).orderBy(*order))
    both = both.withColumn("_at", at([F.col("rank")])).withColumn("_ideal", at([F.desc("relevance"), F.col(item)]))
    dcg = lambda c: F.sum(F.when(F.col(c) <= k, gain / F.log2(F.col(c) + 1)))
    return both.groupBy(group).agg(dcg("_at").alias("dcg"), dcg("_ideal").alias("ideal")).where("ideal > 0").select(group, F.round(F.col("dcg") / F.col("ideal"), 6).alias("ndcg"))
