"""Registered queries of the engine's operators against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from ensemblespark.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((repr([value(x) for x in row]) for row in rows))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.SQL])
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    cursor = duck.execute(registry.SQL[name])
    found = [c[0] for c in cursor.description]
    assert sorted(found) == names
    want = [[row[found.index(c)] for c in names] for row in cursor.fetchall()]
    assert canonical([[row[c] for c in names] for row in got.collect()]) == canonical(want)
