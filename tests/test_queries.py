"""Every registered query of the grid engine against its oracle, on the smallest tables."""

import os

import pytest

from gridwright.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("GRIDWRIGHT_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_plan():
    """Queries of the whole plan share one."""
    from gridwright.queries import sizing

    own, built = sizing._plan, {}
    sizing._plan = lambda v: built.setdefault("plan", None) or built.update(plan=own(v)) or built["plan"]
    yield
    sizing._plan = own


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(plain(v) for v in r)) for r in got.select(*cols).collect())
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())


def test_same_sample_twice(spark):
    a, b = (sorted(map(tuple, QUERIES["stratified_sample"](spark, FOLDER).collect())) for _ in range(2))
    assert a == b


def test_percentages_are_kept(spark):
    rows = QUERIES["bulk_capacity_percentage"](spark, FOLDER).groupBy("kva").count().collect()
    got, total = {r["kva"]: r["count"] for r in rows}, sum(r["count"] for r in rows)
    assert got.get(250, 0) == total * 30 // 100
    assert got.get(630, 0) == total * 25 // 100


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "flagship_plz_peak_transformer" in entry.queries()


def test_cluster_counts_and_density_take_the_whole_range(spark):
    found = QUERIES["cluster_counts"](spark, FOLDER).select("algorithm", "k").collect()
    assert sorted(map(tuple, found)) == [(a, k) for a in ("gmm_diag", "gmm_full", "gmm_sph", "gmm_tied", "kmeans") for k in range(3, 8)]
    assert QUERIES["density_curve"](spark, FOLDER).select("i").distinct().count() == 200
