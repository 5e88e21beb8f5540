"""Files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_history(changes: DataFrame) -> DataFrame:
    """(file, commits, last, authors) of changes (commit, file, author, at)."""
    return changes.groupBy("file").agg(F.countDistinct("commit").alias("commits"), F.max("at").alias("last"), F.countDistinct("author").alias("authors"))


def change_coupling(changes: DataFrame, least: int = 2, most_files: int = 1000) -> DataFrame:
    """(file_a, file_b, together, n_a, n_b, strength) of files that changed together in `least` commits or more.

    strength is the mean of together / min(n_a, n_b) and together / root(n_a
    n_b). The pairs of a commit are the result that is asked for; they are
    formed by a join on the commit in which each file meets only greater
    ones and are counted partially before the shuffle. A commit of more than
    most_files files (a mass change, which couples nothing) is cut into
    slices of the file's name, so that no task holds all its pairs.
    """
    one = changes.select("commit", "file").distinct()
    size = one.groupBy("commit").agg(F.count(F.lit(1)).alias("files"))
    slices = F.ceil(F.col("files") / most_files).cast("int")
    sized = one.join(size, "commit").withColumn("slices", slices)
    left = sized.select("commit", F.col("file").alias("file_a"), F.pmod(F.xxhash64("file"), F.col("slices").cast("long")).alias("slice"))
    right = sized.select("commit", F.col("file").alias("file_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1)).alias("slice"))
    pairs = left.join(right, ["commit", "slice"]).where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= least)
    n = one.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    with_n = pairs.join(n.select(F.col("file").alias("file_a"), F.col("n").alias("n_a")), "file_a").join(n.select(F.col("file").alias("file_b"), F.col("n").alias("n_b")), "file_b")
    strength = (F.col("together") / F.least("n_a", "n_b") + F.col("together") / F.sqrt(F.col("n_a") * F.col("n_b"))) / 2
    return with_n.select("file_a", "file_b", "together", "n_a", "n_b", strength.alias("strength"))


def detect_change_coupling(log: DataFrame, extensions: tuple[str, ...], least: int = 2, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(couplings, histories, top partners) of the source files in a version history (commit, author, at, file); a history without rows, as of a folder that isn't a repository, gives empty tables."""
    some = log.where(F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).isin(*extensions))
    couplings = change_coupling(some, least)
    return couplings, file_history(some), top_partners(couplings, k)


def partners(couplings: DataFrame) -> DataFrame:
    """(file, partner, strength) in both directions."""
    return couplings.select(F.col("file_a").alias("file"), F.col("file_b").alias("partner"), "strength").unionByName(couplings.select(F.col("file_b").alias("file"), F.col("file_a").alias("partner"), "strength"))


def top_partners(couplings: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("file").orderBy(F.desc(F.round("strength", 9)), "partner")
    return partners(couplings).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("file", "partner", "rank")


def change_prediction(couplings: DataFrame, changed: DataFrame, least: float = 0.3) -> DataFrame:
    """(file, strength): unchanged files by their strongest tie to a changed one (file)."""
    c = changed.select(F.col("file").alias("changed")).distinct()
    hit = partners(couplings).where(F.col("strength") >= least).join(c, F.col("file") == F.col("changed"), "left_semi")
    best = hit.groupBy(F.col("partner").alias("other")).agg(F.max("strength").alias("strength"))
    return best.join(c, F.col("other") == F.col("changed"), "left_anti").select(F.col("other").alias("file"), "strength")
