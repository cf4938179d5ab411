"""Order statistics: exact, whole and balanced, also with one dominant value."""

import random

import pytest
from pyspark.sql import functions as F

from carrierlab.functions import order
from carrierlab.functions import ranks as R
from tests.conftest import collect


def frame(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")


@pytest.mark.parametrize("kind", ["distinct", "half_equal", "all_equal", "two_values", "short"])
def test_rank_and_tiles(spark, kind):
    rng = random.Random(3)
    values = {
        "distinct": [rng.random() for _ in range(1003)],
        "half_equal": [rng.random() if rng.random() < 0.5 else 0.25 for _ in range(1003)],
        "all_equal": [1.0] * 500,
        "two_values": [float(i % 2) for i in range(301)],
        "short": [3.0, 1.0, 2.0],
    }[kind]
    got = {r["id"]: r for r in R.global_rank(frame(spark, values), "v", "id").collect()}
    by_value = sorted(range(len(values)), key=lambda i: (values[i], i))
    assert [got[i]["rank"] for i in by_value] == list(range(1, len(values) + 1))
    assert {r["n_total"] for r in got.values()} == {len(values)}
    tiled = R.with_tiles(frame(spark, values), "v", "id", {"t": 7}).collect()
    sizes = {}
    for r in tiled:
        sizes[r["t"]] = sizes.get(r["t"], 0) + 1
    assert len(tiled) == len(values) and max(sizes.values()) - min(sizes.values()) <= 1
    assert sizes == {k: len([r for r in tiled if r["t"] == k]) for k in range(1, min(7, len(values)) + 1)}


def test_a_dominant_value_is_split_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS_A_RANGE", 250)
    df = frame(spark, [5.0] * 4000 + list(range(200)))
    parts = order.in_ranges(df, [], ["v", "id"]).where("v = 5").groupBy("_part").count().collect()
    assert len(parts) > 8 and max(r["count"] for r in parts) < 1500
    got = {r["id"]: r["rank"] for r in R.global_rank(df, "v", "id").collect()}
    values = [5.0] * 4000 + list(range(200))
    want = sorted(range(len(values)), key=lambda i: (values[i], i))
    assert [got[i] for i in want] == list(range(1, len(values) + 1))


def test_no_window_without_partition_over_rows(spark):
    """Only the table with one row per range may be ordered in one task."""
    plan = R.global_rank(frame(spark, range(5000)), "v", "id")._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "_place" in line and "Window" in line:
            assert "windowspecdefinition(_part" in line


def test_running_sums_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS_A_RANGE", 40)
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(10**9), rng.randrange(9)) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, v long, w int").repartition(3)
    got = order.running(order.in_ranges(df, ["g"], ["v"]), ["g"], {"s": F.col("w")}, {"s": "all"})
    assert got.select("_part").distinct().count() > 10
    for r in got.collect():
        same = [x for x in rows if x[0] == r.g]
        assert r.s == sum(w for _, v, w in same if v <= r.v) and r["all"] == sum(w for *_, w in same)


def test_survival_in_continuous_time(spark, monkeypatch):
    from carrierlab.operators.survival import kaplan_meier

    monkeypatch.setattr(order, "ROWS_A_RANGE", 60)
    rng = random.Random(4)
    rows = [("x" if i % 3 else None, rng.random() * 1e4, int(rng.random() < 0.4)) for i in range(500)]
    got = {(r.g, r.t): r for r in kaplan_meier(spark.createDataFrame(rows, "g string, t double, e int"), ["g"], "t", "e").collect()}
    assert len(got) == 500
    for g in ("x", None):
        s, mine = 1.0, sorted(x for x in rows if x[0] == g) if g else sorted((x[1:] for x in rows if x[0] is None))
        mine = [x[-2:] for x in mine]
        for k, (t, e) in enumerate(mine):
            n = len(mine) - k
            s *= 1 - e / n
            assert got[g, t].n_risk == n and got[g, t].survival == pytest.approx(s, rel=1e-9)


def test_cdf_and_quantiles(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 4.0)] + [(None, 7.0), ("b", None)], "g string, v double")
    assert collect(R.empirical_cdf(df, ["g"], "v"), "g", "v") == [(None, 7.0, 1.0), ("a", 1.0, 0.25), ("a", 2.0, 0.75), ("a", 4.0, 1.0)]
    got = collect(R.group_quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "top": 1.0}), "g")
    assert got == [(None, 1, 7.0, 7.0, 7.0), ("a", 4, 1.75, 2.0, 4.0)]


def test_quantiles_match_builtin(spark, folder):
    o = spark.read.parquet(f"{folder}/orders.parquet")
    got = collect(R.group_quantiles(o, ["o_orderstatus"], "o_totalprice", {"q": 0.1}).select("o_orderstatus", F.round("q", 6)), "o_orderstatus")
    want = collect(o.groupBy("o_orderstatus").agg(F.round(F.percentile("o_totalprice", F.lit(0.1)), 6)), "o_orderstatus")
    assert got == want
