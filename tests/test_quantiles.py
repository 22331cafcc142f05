import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import metrics
from gridwright.operators.quantiles import quantiles, rank_counts, running


@pytest.fixture(scope="module")
def rows(spark):
    """One group of most rows over many partitions, ties, a null group, nulls, and a group of nulls only."""
    rng = random.Random(4)
    out = [("a", rng.randint(-50, 400), 1) for _ in range(3000)] + [(None, 7, 2), (None, 9, 1), ("b", 5, 3), ("c", None, 1), ("a", None, 1)] + [(f"g{i % 40}", i % 7, 1) for i in range(300)]
    return out, spark.createDataFrame(out, "k string, v int, n int").repartition(16)


def by_group(rows):
    out = {}
    for k, v, n in rows:
        if v is not None:
            out.setdefault(k, []).extend([v] * n)
    return {k: np.sort(v) for k, v in out.items()}


def test_ranks_match_sorting(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rank_counts(rows[1], ["k"], "v", "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(k, int(x)): (int((v == x).sum()), int((v < x).sum()), int((v <= x).sum())) for k, v in by_group(rows[0]).items() for x in np.unique(v)}
    assert len(got) == len(want) and {(r["k"], r["v"]): (r["n"], r["below"], r["upto"]) for r in got} == want


def test_running_has_the_next_value_over_all_borders(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per = rows[1].where("v is not null").groupBy("k", "v").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
        got = {(r["k"], r["v"]): (r["n_upto"], r["m_upto"], r["next"]) for r in running(per, ["k"], "v", ["n", "m"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, v in by_group(rows[0]).items():
        x = np.unique(v).tolist()
        assert [got[k, a][2] for a in x] == [*x[1:], None]
        assert [got[k, a][0] for a in x] == [int((v <= a).sum()) for a in x]


def test_quantiles_match_numpy(rows):
    shares = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "x": 0.37, "hi": 1.0}
    got = {r["k"]: r for r in quantiles(rows[1], ["k"], "v", shares, "n").collect()}
    want = by_group(rows[0])
    assert set(got) == set(want)
    for k, v in want.items():
        for name, share in shares.items():
            assert got[k][name] == pytest.approx(np.quantile(v, share), abs=1e-9)


def test_quantiles_without_groups_and_without_rows(rows):
    v = np.concatenate(list(by_group(rows[0]).values()))
    assert quantiles(rows[1], [], "v", {"q": 0.25}, "n").first()["q"] == pytest.approx(np.quantile(v, 0.25))
    assert quantiles(rows[1].limit(0), ["k"], "v", {"q": 0.25}).count() == 0


def test_wasserstein_of_a_large_group(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, 900), rng.integers(50, 400, 500)
    df = spark.createDataFrame([("m", float(x), "A") for x in a] + [("m", float(x), "B") for x in b] + [("one", 1.0, "A"), ("m", float("nan"), "A"), ("m", None, "B"), ("m", 7.0, "C")], "k string, v double, s string").repartition(9)
    got = {r["k"]: r for r in metrics.wasserstein(df, ["k"], "v", "s", "A", "B").collect()}
    at = np.unique(np.concatenate([a, b, [7]]))
    gap = np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b))
    distance, pooled = float((gap[:-1] * np.diff(at)).sum()), np.concatenate([a, b])
    iqr = np.quantile(pooled, 0.75) - np.quantile(pooled, 0.25)
    assert got["m"]["wasserstein_distance"] == pytest.approx(distance) and got["m"]["pooled_iqr"] == pytest.approx(iqr)
    assert got["m"]["normalized_wasserstein"] == pytest.approx(distance / iqr) and (got["m"]["n_one"], got["m"]["n_other"]) == (900, 500)
    assert got["one"]["wasserstein_distance"] is None
