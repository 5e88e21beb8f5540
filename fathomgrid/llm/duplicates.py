"""Records that differ only in white space, letter case, punctuation or the order of their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.plans.durable import materialize
from fathomgrid.plans.skew import hot_keys

#: Letters whose capital form is two letters, so that upper-casing a text can't tell it from another.
SPELLED = {"ß": "ss"}


def same_letters(text: Column) -> Column:
    """The letters and digits of a text, in order, in one case. Null stays null."""
    low = F.lower(text)
    for one, two in SPELLED.items():
        low = F.replace(low, F.lit(one), F.lit(two))
    return F.regexp_replace(low, r"[^\p{L}\p{N}]+", "")


def _null_safe(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c), F.lit("0"))


def canonical_fields(text: Column) -> Column:
    """Canonical form of a text that may consist of `name: value` parts, parted by ; or |.

    Two or more such parts, and nothing else, are put in order, each reduced
    to the letters and digits of its name and value; parts without a letter
    or digit (a closing separator) don't count. Any other text is reduced as
    a whole. Null stays null.
    """
    parts = F.filter(F.split(text, "[;|]"), lambda p: F.length(same_letters(p)) > 0)
    named = lambda p: p.rlike(r"^[^:]*[\p{L}\p{N}][^:]*:(?s:.*)[\p{L}\p{N}]")
    many = (F.size(parts) >= 2) & F.forall(parts, named)
    each = F.transform(parts, same_letters)
    return F.when(many, F.concat(F.lit("~"), F.array_join(F.array_sort(each), "~"))).otherwise(same_letters(text))


def canonical_items(items: Column) -> Column:
    """Canonical form of an array of [kind, text]: the reduced items in order of value, so that their order doesn't matter but their number does.

    A null text and an empty one are the same (neither has a letter or digit); a null array
    is not an empty one.
    """
    one = F.transform(items, lambda i: F.concat_ws("~", F.lit("i"), *[F.coalesce(same_letters(F.get(i, F.lit(n))), F.lit("")) for n in (0, 1)]))
    return F.array_join(F.array_sort(one), "|")


def canonical_key(query: Column, category: Column, output: Column) -> Column:
    """128 bits of a record's canonical form. The separators occur in no reduced text, so unlike records never share a form."""
    form = F.concat_ws("\n", _null_safe(canonical_fields(query)), _null_safe(same_letters(category)), _null_safe(canonical_items(output)))
    return F.unhex(F.md5(form))


def collapse(keyed: DataFrame, hot: list, salts: int = 64) -> DataFrame:
    """(key, record_id, copies): the least identifier and the number of rows per key.

    Hot keys are spread over `salts` partial groups by identifier and then
    combined; the rest is grouped once.
    """
    least, many = F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("copies")
    if not hot:
        return keyed.groupBy("key").agg(least, many)
    is_hot = F.col("key").isin(hot)
    first = keyed.where(is_hot).groupBy("key", F.pmod(F.xxhash64("record_id"), F.lit(salts)).alias("salt")).agg(least, many)
    two = first.groupBy("key").agg(least, F.sum("copies").alias("copies"))
    return two.unionByName(keyed.where(~is_hot).groupBy("key").agg(least, many))


def canonical_records(records: DataFrame) -> DataFrame:
    """(record_id, key), written once to the shared folder."""
    return materialize(records.select("record_id", canonical_key(F.col("query"), F.col("category"), F.col("output")).alias("key")), "canonical")


def duplicate_groups(records: DataFrame, hot_share: float = 0.002, hot_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(groups, members): one row (record_id, copies) for each kind of record, and (record_id_1, record_id_2) for each further copy.

    An empty table gives empty results. A record delivered twice under one
    identifier counts as two copies but is never a member of itself.
    """
    keyed = canonical_records(records)
    hot = hot_keys(keyed, "key", hot_share, hot_rows)
    groups = collapse(keyed, hot)
    many = groups.where("copies > 1").select("key", F.col("record_id").alias("record_id_1"))
    if hot:
        is_hot = F.col("key").isin(hot)
        met = keyed.where(is_hot).join(F.broadcast(many.where(is_hot)), "key").unionByName(keyed.where(~is_hot).join(many.where(~is_hot), "key"))  # at most 1/hot_share rows are broadcast
    else:
        met = keyed.join(many, "key")
    members = met.where("record_id > record_id_1").select("record_id_1", F.col("record_id").alias("record_id_2")).distinct()
    return groups.select("record_id", "copies"), members
