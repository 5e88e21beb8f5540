"""Every registered query against its SQL on the smallest tables."""

import importlib

import duckdb
import pytest

from fathomgrid import registry, tools
from fathomgrid.sources.tables import table

QUERIES, SQL = registry.queries(), registry.sql()


@pytest.fixture(scope="module")
def con(tiny):
    from pathlib import Path

    c = duckdb.connect()
    for f in Path(tiny).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def _text(v):
    if isinstance(v, float):
        return "None" if v != v else repr(round(v, 6))
    return str([_text(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, con, name):
    df = QUERIES[name](spark, tiny)
    rows, cols = df.collect(), df.columns
    if name not in SQL:  # its operator has tests of its own; here: rows, and the same ones however they are spread
        assert rows
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            again = QUERIES[name](spark, tiny).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert sorted("|".join(_text(r[c]) for c in cols) for r in again) == sorted("|".join(_text(r[c]) for c in cols) for r in rows)
        return
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == sorted(cols)
    order = sorted(cols)
    mine = sorted("|".join(_text(r[c]) for c in order) for r in rows)
    at = [rel.columns.index(c) for c in order]
    assert mine == sorted("|".join(_text(r[i]) for i in at) for r in rel.fetchall())


def test_tools(spark, tiny):
    docs = table(spark, tiny, "documents")
    first = docs.where("active = 1").orderBy("doc_id").first()
    assert tools.get(docs, first["path"]).first()["doc_id"] is not None and tools.get(docs, "nothing at all").count() == 0
    assert tools.multi_get(docs, "*/*.md", 10).where("skipped is not null and body is not null").count() == 0
    assert tools.search(docs, "cache", 5).count() <= 5 and tools.status(docs).count() > 0 and tools.deep_search(docs, "cache", ["index"], 5).count() <= 5
    assert tools.similar_names(docs, first["path"]).first()["distance"] == 0


def test_entry_without_the_optional_part():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert importlib.import_module("fathomgrid.registry")
