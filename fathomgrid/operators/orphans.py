"""References to records that do not exist: direct orphans and a fixpoint cascade down the foreign keys."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.plans.durable import materialize
from fathomgrid.plans.skew import hot_keys, lookup_join


@dataclass(frozen=True)
class ForeignKey:
    """child.column refers to the key of the parent tables. row_no identifies a child row; at is the time of the reference (null: unknown)."""

    child: str
    column: str
    row_no: str
    parents: tuple[str, ...]
    at: str | None = None


@dataclass(frozen=True)
class Parent:
    """A referenced table: its rows, their key and, where it has them, the columns of creation and deletion time."""

    rows: DataFrame
    key: str
    created: str | None = "created_at"
    deleted: str | None = None


def _keys(parents: list[Parent]) -> DataFrame:
    """One row per key over all parents: a row that lives beats a deleted one, then the earliest counts."""

    def one(p: Parent) -> DataFrame:
        time = lambda c: F.col(c).cast("timestamp_ntz") if c else F.lit(None).cast("timestamp_ntz")
        return p.rows.where(F.col(p.key).isNotNull()).select(F.col(p.key).cast("string").alias("_key"), time(p.created).alias("_born"), time(p.deleted).alias("_gone"))

    every = reduce(DataFrame.unionByName, map(one, parents))
    best = F.min(F.struct(F.col("_gone").isNotNull().alias("dead"), F.col("_born").alias("born")))
    return every.groupBy("_key").agg(best.alias("_best")).select("_key", F.lit(True).alias("_there"), F.col("_best.dead").alias("_dead"), F.col("_best.born").alias("_born"))


def _status() -> Column:
    return F.when(F.col("_there").isNull(), "missing").when(F.col("_dead"), "deleted").when(F.col("_born") > F.col("_at"), "late")


def direct_orphans(rows: DataFrame, key: ForeignKey | list[ForeignKey], parents: list[Parent], hot_share: float = 0.002, row_type: str = "long") -> DataFrame:
    """Rows (tbl, ref_column, row_no, at, status) of the references in `rows` whose parent is missing, deleted or younger.

    Several foreign keys of one table with the same parents are checked in
    one pass. A null reference is no reference; a null time is never late;
    a repeated row yields a repeated result. Keys that hold a large share of
    the references are joined by broadcast of their (bounded) own rows.
    """
    keys = key if isinstance(key, list) else [key]
    at = lambda k: F.col(k.at).cast("timestamp_ntz") if k.at else F.lit(None).cast("timestamp_ntz")
    each = F.array(*[F.struct(F.lit(k.column).alias("c"), F.col(k.column).cast("string").alias("k"), at(k).alias("t")) for k in keys])
    refs = rows.select(F.col(keys[0].row_no).cast(row_type).alias("row_no"), F.explode(each).alias("_r"))
    refs = refs.select("row_no", F.col("_r.c").alias("ref_column"), F.col("_r.k").alias("_key"), F.col("_r.t").alias("_at")).where("_key is not null")
    joined = lookup_join(refs, _keys(parents), "_key", hot_keys(refs, "_key", hot_share))
    return joined.withColumn("status", _status()).where("status is not null").select(F.lit(keys[0].child).alias("tbl"), "ref_column", "row_no", F.col("_at").alias("at"), "status")


def _row_type(tables: dict[str, Parent], keys: list[ForeignKey]) -> str:
    """Row numbers are long where all tables have whole numbers, else strings, so that rows are told apart by their own key."""
    whole = {"tinyint", "smallint", "int", "bigint"}
    return "long" if all(tables[k.child].rows.schema[k.row_no].dataType.simpleString() in whole for k in keys) else "string"


def orphan_cascade(tables: dict[str, Parent], foreign_keys: list[ForeignKey], hot_share: float = 0.002) -> DataFrame:
    """All orphans: (tbl, ref_column, row_no, at, status, kind, depth).

    kind 'direct' (depth 0): the reference itself is missing, deleted or
    late. kind 'inherited': the referenced row exists but is itself an orphan
    (status 'inherited'); depth is the length of the chain. Rounds of
    semi-joins go down the foreign-key graph until one finds nothing new, however
    long the chains are; self references and cycles end too. Only a foreign key whose parent
    table is itself a child takes part in a round; each round is written to
    the shared folder. A row that is orphaned through several columns is
    reported once per column, at its least depth.
    """
    by_child: dict[tuple, list[ForeignKey]] = {}
    for k in foreign_keys:
        by_child.setdefault((k.child, k.parents, k.row_no), []).append(k)
    kind = _row_type(tables, foreign_keys)
    rounds = [direct_orphans(tables[child].rows, ks, [tables[p] for p in parents], hot_share, kind) for (child, parents, _), ks in by_child.items()]
    found = reduce(DataFrame.unionByName, rounds).withColumns({"kind": F.lit("direct"), "depth": F.lit(0)})
    children = {k.child: k for k in foreign_keys}
    down = [k for k in foreign_keys if any(p in children for p in k.parents)]
    if not down:
        return found
    found = materialize(found, "orphans")
    new, depth = found, 0
    hot: dict[ForeignKey, list] = {}
    while True:  # every round finds references not found before, so that it ends
        depth += 1
        steps = []
        for k in down:
            for p in (p for p in k.parents if p in children):
                bad = new.where(F.col("tbl") == p).select("row_no").distinct()
                lost = tables[p].rows.select(F.col(children[p].row_no).cast(kind).alias("row_no"), F.col(tables[p].key).cast("string").alias("_key")).join(bad, "row_no", "left_semi").select("_key").distinct()
                at = F.col(k.at).cast("timestamp_ntz") if k.at else F.lit(None).cast("timestamp_ntz")
                refs = tables[k.child].rows.select(F.col(k.row_no).cast(kind).alias("row_no"), F.col(k.column).cast("string").alias("_key"), at.alias("at")).where("_key is not null")
                if k not in hot:
                    hot[k] = hot_keys(refs, "_key", hot_share)
                hit = lookup_join(refs, lost, "_key", hot[k], "left_semi")
                steps.append(hit.select(F.lit(k.child).alias("tbl"), F.lit(k.column).alias("ref_column"), "row_no", "at", F.lit("inherited").alias("status"), F.lit("inherited").alias("kind"), F.lit(depth).alias("depth")))
        step = reduce(DataFrame.unionByName, steps).join(found.select("tbl", "ref_column", "row_no").distinct(), ["tbl", "ref_column", "row_no"], "left_anti")
        new = materialize(step.dropDuplicates(["tbl", "ref_column", "row_no"]).select(*found.columns), "orphans")
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, month of the reference ('unknown' where it has no time), column, kind and status."""
    month = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown"))
    return orphans.groupBy("tbl", month.alias("month"), "ref_column", "kind", "status").agg(F.count(F.lit(1)).alias("n"))
