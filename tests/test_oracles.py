"""Every registered timeline query against its DuckDB oracle on the smallest tables."""

import math
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from loomline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return ("float", "nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def results(spark):
    """Columns and rows of every query, several at a time."""

    def run(name):
        df = catalogue.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        return columns, sorted((tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)

    with ThreadPoolExecutor(8) as pool:
        yield {name: pool.submit(run, name) for name in catalogue.QUERIES}


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_matches_oracle(results, con, name):
    columns, got = results[name].result()
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    asked = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in asked.fetchall()), key=repr)
    assert got == want
