"""Every registered query of the library against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from jobloom.plans import queries as library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, oracle, name):
    df = library.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = oracle.execute(library.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    wanted = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert _plain(tuple(r[c] for c in columns) for r in df.collect()) == _plain(wanted)


def test_recipe_reads_the_links_of_the_navigation(spark, sf_dir):
    rows = library.html_recipe(spark, sf_dir).collect()
    assert rows and all(r["title"] and r["url"].startswith("http") for r in rows)


def test_smoke_query_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(library.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
