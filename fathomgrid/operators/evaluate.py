"""Quality of retrieval, and statistics of data sets of training pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, judged: DataFrame, group: str, item: str, k: int = 10) -> DataFrame:
    """(group, recall, mrr, ndcg) at k of ranked (group, item, rank, 1-based) against judged (group, item, relevance); a relevance above 0 is relevant. Groups without a relevant item are left out."""
    rel = judged.where("relevance > 0").groupBy(group, item).agg(F.max("relevance").alias("rel"))
    total = rel.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    best = rel.withColumn("at", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("rel"), item))).where(F.col("at") <= k)
    ideal = best.groupBy(group).agg(F.sum((F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("at") + 1)).alias("ideal"))
    hit = ranked.where(F.col("rank") <= k).join(rel, [group, item])
    got = hit.groupBy(group).agg(F.countDistinct(item).alias("hits"), F.min("rank").alias("first"), F.sum((F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("rank") + 1)).alias("dcg"))
    every = total.join(ideal, group).join(got, group, "left")
    four = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return every.select(group, four(F.col("hits") / F.least("n", F.lit(k))).alias("recall"), four(1 / F.col("first")).alias("mrr"), four(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def hit_rate(ranked: DataFrame, judged: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """One row: share of groups with a relevant item among the first k."""
    rel = judged.where("relevance > 0").select(group, item).distinct()
    hit = ranked.where(F.col("rank") <= k).join(rel, [group, item], "left_semi").select(group).distinct().withColumn("hit", F.lit(1))
    return rel.select(group).distinct().join(hit, group, "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("rate"))


#: Names of symbols whose callers count as ranked too low rather than as missing.
RANKED_LOW = ("login", "UserRepository", "fetchData")
#: Signs of the kinds of queries.
TEMPORAL = ("latest", "recent", "new", "update", "changelog", "changed", "version", "release", "news", "2024", "2025")
COMPARISON = ("difference", "vs", "versus", "compare")
PERSONAL = ("meeting", "notes", "journal", "ideas", "thoughts")
HOW = ("how to", "how do", "setup", "install", "configure", "create")
WHAT = ("what is", "what are", "definition", "meaning")
CONFIG = ("config", "setting", "option")
ERROR = ("error", "issue", "problem", "fix", "debug")
TOPIC_PREFIXES = ("how to ", "how do i ", "what is ", "what are ", "configure ", "setup ")


def _holds(text: Column, signs: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(s) for s in signs])


def query_category(query: Column) -> Column:
    """short_keyword (at most two words), temporal, how_to, what_is, comparison, personal or other. Names are looked for in lower case, so that named_entity never comes out."""
    q = F.lower(query)
    n = F.size(F.filter(F.split(query, r"(?U)\s+"), lambda w: w != ""))
    return F.when(n <= 2, "short_keyword").when(_holds(q, TEMPORAL), "temporal").when(q.startswith("how "), "how_to").when(q.startswith("what "), "what_is").when(_holds(q, COMPARISON), "comparison").when(_holds(q, PERSONAL), "personal").otherwise("other")


def hyde_kind(query: Column) -> Column:
    """The kind of passage that a query asks for."""
    q = F.lower(query)
    return F.when(_holds(q, HOW), "how_to").when(_holds(q, WHAT), "what_is").when(_holds(q, CONFIG), "config").when(_holds(q, ERROR), "error").otherwise("general")


def topic(query: Column) -> Column:
    """The query without what it begins with, if that is a common phrase."""
    out = query
    for p in reversed(TOPIC_PREFIXES):
        out = F.when(F.lower(query).startswith(p), F.regexp_replace(F.substr(query, F.lit(len(p) + 1)), r"(?U)^\s+|\s+$", "")).otherwise(out)
    return out


def failure_kinds(ranked: DataFrame, judged: DataFrame, group: str, item: str, retrieved: int = 20, k: int = 10) -> DataFrame:
    """(kind, n, recall): groups by what kept their relevant items from the first places, with their mean recall at k. 'not_indexed': none among the first `retrieved`; 'missing_callsite': some; 'ranking': all, or some of which one is known to rank low."""
    rel = judged.where("relevance > 0").select(group, item).distinct()
    both = rel.join(ranked.select(group, item, "rank"), [group, item], "left")
    low = (F.col("rank") <= retrieved) & _holds(F.col(item), RANKED_LOW)
    per = both.groupBy(group).agg(F.count(F.lit(1)).alias("wanted"), F.count_if(F.col("rank") <= retrieved).alias("found"), F.count_if(F.col("rank") <= k).alias("near"), F.coalesce(F.bool_or(low), F.lit(False)).alias("low"))
    kind = F.when(F.col("found") == 0, "not_indexed").when((F.col("found") < F.col("wanted")) & ~F.col("low"), "missing_callsite").otherwise("ranking")
    return per.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("near") / F.col("wanted")), 6).alias("recall"))


def index_percentiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(share, value): the value at place floor(n * share) of the ascending order, from counts of distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    below = counts.withColumn("upto", F.sum("c").over(Window.partitionBy().orderBy(value)))  # a row per distinct value
    n = counts.agg(F.sum("c").alias("n"))
    at = below.join(F.broadcast(n)).select(value, F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"), "upto", "n")
    return at.where(F.col("upto") > F.floor(F.col("n") * F.col("share"))).groupBy("share").agg(F.min(value).alias("value"))


def expansion_statistics(records: DataFrame) -> DataFrame:
    """One row over training pairs (query, category, output): how many, how long, how many of each kind, and repeated queries."""
    words = F.size(F.filter(F.split(F.trim("query"), r"\s+"), lambda w: w != ""))
    has = lambda k: F.exists(F.coalesce("output", F.array().cast("array<array<string>>")), lambda i: F.get(i, F.lit(0)) == k)
    long_ = F.exists(F.coalesce("output", F.array().cast("array<array<string>>")), lambda i: (F.get(i, F.lit(0)) == "hyde") & (F.length(F.get(i, F.lit(1))) > 200))
    some = F.col("query").isNotNull()
    return records.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(some & (words <= 2)).alias("short"), F.count_if(some & (words > 2) & (words <= 5)).alias("middle"), F.count_if(some & (words > 5)).alias("long"),
        F.count_if(has("lex")).alias("with_lex"), F.count_if(has("vec")).alias("with_vec"), F.count_if(has("hyde")).alias("with_hyde"), F.count_if(long_).alias("long_hyde"),
        (F.count("query") - F.countDistinct(F.lower("query"))).alias("repeated"),
    )


def schema_faults(records: DataFrame) -> DataFrame:
    """One row: records by what is wrong with them."""
    out = F.col("output")
    bad = F.exists(out, lambda i: (F.size(i) != 2) | ~F.get(i, F.lit(0)).isin("lex", "vec", "hyde"))
    blank = F.exists(out, lambda i: F.coalesce(F.trim(F.get(i, F.lit(1))), F.lit("")) == "")
    return records.agg(F.count_if(F.coalesce(F.trim("query"), F.lit("")) == "").alias("no_query"), F.count_if(out.isNull() | (F.size(out) == 0)).alias("no_output"), F.count_if(F.coalesce(bad, F.lit(False))).alias("bad_item"), F.count_if(F.coalesce(blank, F.lit(False))).alias("blank_item"))


def split(records: DataFrame, key: str, seed: int = 42, share: float = 0.1) -> DataFrame:
    """Add `part`: valid for about `share` of the keys, by a seeded hash, so that it holds at any size and on any cluster; else train."""
    at = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return records.withColumn("part", F.when(at < share, "valid").otherwise("train"))
