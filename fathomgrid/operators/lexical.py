"""Full-text ranking over postings: BM25 with weighted fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomgrid.functions.text import terms
from fathomgrid.plans.durable import materialize

K1, B = 1.2, 0.75


def postings(rows: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, size, field, term, tf): one row per term of a field, counted; size counts the terms of all fields of the row."""
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(terms(c), F.array().cast("array<string>")).alias("terms")) for n, c in fields.items()])
    wide = rows.select(key, each.alias("fs")).withColumn("size", F.aggregate("fs", F.lit(0), lambda n, f: n + F.size(f["terms"])))
    flat = wide.select(key, "size", F.explode("fs").alias("f")).select(key, "size", "f.field", F.explode("f.terms").alias("term"))
    return flat.groupBy(key, "size", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


@dataclass(frozen=True)
class TextIndex:
    """Postings in a folder, by bucket of the term, sorted by term; a query reads the files of its own terms' buckets and, of these, the row groups that may hold the terms. spread: files of a bucket, so that a term that most rows hold is written by several tasks."""

    path: str
    key: str
    buckets: int = 64
    spread: int = 4

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def build(self, rows: DataFrame, fields: dict[str, Column]) -> TextIndex:
        """Write the index of rows (with a unique key); a row without a term counts in the corpus only."""
        p = postings(rows, self.key, fields).withColumn("bucket", self._bucket(F.col("term")))
        p = p.repartition(self.buckets * self.spread, "bucket", F.pmod(F.xxhash64(self.key), F.lit(self.spread))).sortWithinPartitions("bucket", "term")
        p.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        size = sum((F.greatest(F.coalesce(F.size(terms(c)), F.lit(0)), F.lit(0)) for c in fields.values()), F.lit(0))
        rows.select(size.alias("_size")).agg(F.count(F.lit(1)).alias("_all"), F.avg("_size").alias("_mean")).write.mode("overwrite").parquet(f"{self.path}/corpus")
        return self

    def search(self, spark: SparkSession, weights: dict[str, float], query: str, every: bool = True) -> DataFrame:
        """(key, raw, n_terms) as bm25 gives them."""
        words = list(dict.fromkeys(w for w in query.lower().split() if w))
        rows = spark.read.parquet(f"{self.path}/postings")
        if not words:
            return rows.select(self.key, F.lit(0.0).alias("raw"), F.lit(0).alias("n_terms")).where("false")
        asked = spark.createDataFrame([(w,) for w in words], "term string").select(self._bucket(F.col("term")).alias("b"))
        mine = rows.where(F.col("bucket").isin([r[0] for r in asked.collect()]) & F.col("term").isin(words))  # a row per word of the query
        weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("field"))
        found = mine.groupBy(self.key, F.col("size").alias("_size")).agg(*[F.sum(F.when(F.col("term") == w, weight * F.col("tf")).otherwise(0.0)).alias(f"_f{i}") for i, w in enumerate(words)])
        return _scored(found, spark.read.parquet(f"{self.path}/corpus"), self.key, words, every)


def matches(rows: DataFrame, key: str, fields: dict[str, Column], weights: dict[str, float], words: list[str], prefix: bool = False) -> DataFrame:
    """(key, _size, _f0, _f1, ...): tokens of each row and the weighted frequency of each query term, with every field split once."""
    hit = lambda w: (lambda t: t.startswith(w)) if prefix else (lambda t: t == w)
    # a lambda's argument is computed once, however often it is used
    each = {n: F.get(F.transform(F.array(terms(c)), lambda t: F.struct(F.size(t).alias("n"), *[F.size(F.filter(t, hit(w))).alias(f"f{i}") for i, w in enumerate(words)])), F.lit(0)) for n, c in fields.items()}
    wide = rows.select(key, *[x.alias(f"_x_{n}") for n, x in each.items()])
    of = lambda n, part: F.greatest(F.coalesce(F.col(f"_x_{n}.{part}"), F.lit(0)), F.lit(0))
    size = sum((of(n, "n") for n in fields), F.lit(0)).alias("_size")
    return wide.select(key, size, *[sum((weights[n] * of(n, f"f{i}") for n in fields), F.lit(0.0)).alias(f"_f{i}") for i in range(len(words))])


def bm25(rows: DataFrame, key: str, fields: dict[str, Column], weights: dict[str, float], query: str, every: bool = True, prefix: bool = False) -> DataFrame:
    """(key, raw, n_terms): BM25 of the rows that hold all (or, with every=False, some) of the query's terms.

    idf = ln((N - n + 1/2) / (n + 1/2)), at least 1e-6, over all rows; the
    frequency is the weighted sum over fields. With prefix=True a term stands
    for all that begin with it. The texts are read and split once; what is
    kept of them, a few numbers per row, is written to the shared folder and
    gives the corpus' counts and then the scores. Nothing is shuffled.
    """
    words = list(dict.fromkeys(w for w in query.lower().split() if w))
    if not words:
        return rows.select(key, F.lit(0.0).alias("raw"), F.lit(0).alias("n_terms")).where("false")
    found = materialize(matches(rows, key, fields, weights, words, prefix), "matches")
    whole = found.agg(F.count(F.lit(1)).alias("_all"), F.avg("_size").alias("_mean"))
    return _scored(found, whole, key, words, every)


def _scored(found: DataFrame, whole: DataFrame, key: str, words: list[str], every: bool) -> DataFrame:
    """Scores of rows (key, _size, _f0, ...) against a corpus of one row (_all, _mean)."""
    some = [F.col(f"_f{i}") > 0 for i in range(len(words))]
    whole = whole.join(F.broadcast(found.agg(*[F.count_if(c).alias(f"_n{i}") for i, c in enumerate(some)])))  # one row each
    match = sum((c.cast("int") for c in some), F.lit(0))
    kept = found.withColumn("n_terms", match).where(match == len(words) if every else match > 0)
    joined = kept.join(F.broadcast(whole))  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log((F.col("_all") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        f = F.col(f"_f{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_size") / F.col("_mean")))
    return joined.select(key, score.alias("raw"), "n_terms")


def unit_score(raw: Column, half: float = 2.0) -> Column:
    """raw / (half + raw): half is 2 for documents and 1 for chunks."""
    return raw / (half + raw)


def minmax_score(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Scores of a candidate list in [0.1, 1]; 0.5 where all are equal."""
    ends = rows.agg(F.min(raw).alias("_lo"), F.max(raw).alias("_hi"))
    scaled = 0.1 + 0.9 * (F.col(raw) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return rows.join(F.broadcast(ends)).withColumn("score", F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise(scaled)).drop("_lo", "_hi")  # one row


def symbol_score(rows: DataFrame, words: list[str]) -> DataFrame:
    """Candidates (id, name, file_path, label, signature, score) with the score adjusted by how much of the query they cover, at most 1."""
    text = F.lower(F.concat_ws(" ", "name", "file_path", "signature"))
    name, path = F.lower("name"), F.col("file_path")
    share = lambda c: sum((c.contains(w).cast("int") for w in words), F.lit(0)) / len(words)
    cover, named, in_path = share(text), share(name), sum((F.lower(path).contains(w).cast("int") for w in words), F.lit(0))
    factor = 0.7 + 0.6 * cover
    if len(words) > 1:
        factor = factor * F.when(named == 0, 0.55).when(named < 1, 0.65).otherwise(1.8)
    phrase = " ".join(words)
    if len(phrase) >= 4:
        factor = factor * F.when(text.contains(phrase), 1.15).otherwise(1.0)
    factor = factor * F.when(in_path >= 2, 1.1).otherwise(1.0) * F.when(path.contains("test") | path.contains("spec"), 0.5).otherwise(1.0)
    factor = factor * F.when(F.col("label").isin("function", "class") & ((cover >= 0.5) | (named > 0)), 1.2).otherwise(1.0)
    return rows.withColumn("score", F.least(F.lit(1.0), F.col("score") * factor))


def top(rows: DataFrame, score: str, key: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(F.round(score, 9)), key).limit(limit)


def strong_signal(rows: DataFrame, score: str, key: str, least: float = 0.70, gap: float = 0.20) -> DataFrame:
    """One row: whether the best score is high and well ahead of the second."""
    w = Window.partitionBy().orderBy(F.desc(score), key)
    two = top(rows, score, key, 2).withColumn("next", F.lead(score).over(w)).withColumn("n", F.row_number().over(w)).where("n = 1")  # two rows
    return two.select(((F.col(score) >= least) & (F.col(score) - F.coalesce("next", F.lit(0.0)) >= gap)).alias("strong"))
