"""Queries give their SQL's rows over the smallest tables, and functions, rules and connectors the stated results of
stated cases. The driver of each round compares the queries over larger tables."""

import duckdb
import pytest

from eventloom.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def same(spark, duck, query, sql, reads=False):
    df = query(spark, SMALL)
    assert not reads or df.inputFiles()
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert shown([tuple(r) for r in df.collect()], df.columns) == shown(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(registry.stated()))
def test_stated_cases(spark, duck, name):
    same(spark, duck, *registry.stated()[name])


MODULES = ("feeds", "gates", "listing", "page_queries", "texts")
NAMES = ("carry_forward", "connectors", "dedupe", "fuzzy", "parse_", "title_token_pairs")


def names():
    found = registry.queries()
    return sorted(n for n in registry.oracle_sql() if found[n].__module__.rpartition(".")[2] in MODULES or n.startswith(NAMES))


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, duck, name):
    same(spark, duck, registry.queries()[name], registry.oracle_sql()[name], reads=True)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(names())))
def test_query_reads_files(spark, name):
    """None runs on rows that are made up."""
    assert registry.queries()[name](spark, SMALL).inputFiles()
