"""Arithmetic against published numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions.stats import exact_interval, log_gamma, normal_two_sided_p, t_half_width, t_two_sided_p
from carrierlab.operators.counts import carrier_count_by_condition
from carrierlab.functions.ranks import with_tiles
from carrierlab.operators.submissions import submitter_ranking
from plain_stats import beta_cdf, beta_quantile, t_quantile, t_two_sided_p as student_p


@pytest.mark.parametrize("k,n,low,high", [
    (17, 55, 0.1914, 0.4481), (850, 19131, 0.04155, 0.04745), (0, 7, 0.0, 0.4096), (1, 7, 0.0036, 0.5787),
    (7, 7, 0.5904, 1.0),
])
def test_exact_interval(spark, k, n, low, high):
    row = spark.createDataFrame([(k, n)], "k int, n int").select(exact_interval("k", "n").alias("c")).first()["c"]
    assert row["low"] == pytest.approx(low, abs=6e-5)
    assert row["high"] == pytest.approx(high, abs=6e-5)


def test_exact_interval_undefined(spark):
    df = spark.createDataFrame([(0, 0), (None, 5), (0, 5)], "k int, n int")
    got = [tuple(r["c"]) for r in df.select(exact_interval("k", "n").alias("c")).collect()]
    assert got[0] == (None, None) and got[1] == (None, None) and got[2][0] == 0.0
    strict = df.select(exact_interval("k", "n", null_when_zero=True).alias("c")).collect()
    assert tuple(strict[2]["c"]) == (None, None)


@pytest.mark.parametrize("n,mean,sd,low,high", [
    (55, 198.396116379221, 75.1776169875277, 178.072759676203, 218.719473082239),
    (18, 329.400381746032, 91.3086664074502, 283.993650187902, 374.807113304161),
    (5, 54.8155998, 10.8319919813394, 41.365905327939, 68.265294272061),
])
def test_t_interval(spark, n, mean, sd, low, high):
    half = spark.createDataFrame([(n, sd)], "n int, sd double").select(t_half_width("n", "sd")).first()[0]
    assert mean - half == pytest.approx(low, abs=1e-9)
    assert mean + half == pytest.approx(high, abs=1e-9)


def test_t_interval_of_one_row_is_null(spark):
    df = spark.createDataFrame([(1, 2.0)], "n int, sd double")
    assert df.select(t_half_width("n", "sd")).first()[0] is None


def test_quantiles_invert_the_distribution():
    x = np.array([0.01, 0.3, 0.6, 0.77])
    p = beta_cdf(x, 3.5, 8.0)
    assert np.allclose(beta_quantile(p, 3.5, 8.0), x, atol=1e-9)
    assert t_quantile(0.975, 1e6) == pytest.approx(1.959966, abs=1e-5)
    assert student_p(t_quantile(0.975, 7.0), 7.0) == pytest.approx(0.05, abs=1e-9)


def test_intervals_of_very_large_counts(spark):
    k, n = 30_000_000, 1_000_000_000
    half = 1.959964 * np.sqrt(k / n * (1 - k / n) / n)
    row = spark.createDataFrame([(k, n)], "k long, n long").select(
        exact_interval("k", "n").alias("c"), t_half_width("n", F.sqrt("n")).alias("t")).first()
    assert row.c.low == pytest.approx(k / n - half, abs=3e-9)
    assert row.c.high == pytest.approx(k / n + half, abs=3e-9)
    assert row.t == pytest.approx(1.959964, abs=1e-6)


def test_interval_columns_against_numpy(spark):
    """Counts of all sizes, at several levels; a plan without Python."""
    pairs = [(k, n) for n in (1, 2, 3, 10, 97, 1000, 48611, 10**6, 10**9)
             for k in sorted({0, 1, 2, n // 1000, n // 7, n // 2, n - 2, n - 1, n}) if 0 <= k <= n]
    frame = spark.createDataFrame(pairs, "k long, n long")
    for conf in (0.8, 0.95, 0.999):
        out = frame.select("k", "n", exact_interval("k", "n", conf).alias("c"),
                           t_half_width("n", F.sqrt("n"), conf).alias("t"))
        assert "Python" not in out._jdf.queryExecution().toString()
        tail = (1 - conf) / 2
        for r in out.collect():
            if r.n > 10**6:
                continue
            low = beta_quantile(tail, r.k, r.n - r.k + 1) if r.k else 0
            high = beta_quantile(1 - tail, r.k + 1, r.n - r.k) if r.k < r.n else 1
            assert r.c.low == pytest.approx(float(low), rel=1e-9) and r.c.high == pytest.approx(float(high), rel=1e-9)
            assert (r.t is None) == (r.n < 2)
            if r.n > 1:
                assert r.t == pytest.approx(float(t_quantile(1 - tail, r.n - 1)), rel=1e-8)


def test_two_sided_probabilities(spark):
    pairs = [(t, df) for t in (0.0, 0.01, 0.7, 1.0, 1.3, 4.2, 30.0, -2.0) for df in (1, 2, 5, 40, 300)]
    for r in spark.createDataFrame(pairs, "t double, df long").select(
            "t", "df", t_two_sided_p(F.col("t"), F.col("df").cast("double")).alias("p"),
            normal_two_sided_p(F.col("t")).alias("q")).collect():
        assert r.p == pytest.approx(float(student_p(r.t, r.df)), rel=1e-9, abs=1e-300)
        assert r.q == pytest.approx(math.erfc(abs(r.t) / math.sqrt(2)), rel=1e-10)


def test_log_gamma(spark):
    x = [0.5, 1.0, 1.5, 2.0, 10.0, 171.5, 1e6, 1e9]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect()
    for r in got:
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-13, abs=1e-13)


def test_percent_carriers(spark):
    # 126 carriers of 38,618 and 90 of 38,566 subjects
    pheno = spark.range(38618).select(F.lit("AMP").alias("cohort")).unionAll(
        spark.range(38566).select(F.lit("UKB").alias("cohort")))
    carriers = spark.range(126).select(F.lit("AMP").alias("cohort"), F.col("id").alias("subject")).unionAll(
        spark.range(90).select(F.lit("UKB"), F.col("id"))
    ).select("*", F.lit("High LDL").alias("trait"), F.lit("LDLR").alias("gene"), F.lit("v").alias("variant"))
    got = {r["cohort"]: r["percent_carriers"] for r in carrier_count_by_condition(pheno, carriers).collect()}
    assert got["AMP"] == pytest.approx(0.32627272256460715, abs=1e-12)
    assert got["UKB"] == pytest.approx(0.23336617746201319, abs=1e-12)


def test_tile_sizes_match_published_counts(spark):
    # 18,030 rows in 100 tiles: 30 tiles of 181, then 70 of 180
    df = spark.range(18030).select("id", (F.col("id") * 7 % 18030).cast("double").alias("s"))
    sizes = [r["count"] for r in with_tiles(df, "s", "id", {"p": 100}).groupBy("p").count().orderBy("p").collect()]
    assert sizes == [181] * 30 + [180] * 70


def test_submitter_ranking_threshold(spark):
    rows = [("big", 20, "2019-01-01"), ("stale", 30, "2016-05-05"), ("small", 3, "2019-01-01"), ("bigger", 25, "2017-01-01")]
    df = spark.createDataFrame(rows, "submitter string, n int, d string").select(
        "submitter", F.col("d").cast("date").alias("date"), F.explode(F.sequence(F.lit(1), F.col("n"))))
    got = [(r[0], r[1]) for r in submitter_ranking(df, min_submissions=10).collect()]
    assert got == [("bigger", 25), ("big", 20)]


def test_settings_tables():
    rows = S.outcome_settings()
    assert len(rows) == 22 and len(S.outcome_settings(False)) == 14
    assert len(S.mean_settings()) == 14 and len(S.score_settings()) == 8
    labels = [r.condition for r in rows]
    assert len(set(labels)) == 22
    for label in ("MODY extended (T2D and pre-diabetes)", "Low LDL ADJ (<80 mg/dl) no lipid meds",
                  "High triglycerides (>200 mg/dl)", "Monogenic obesity (BMI >30)", "Neonatal diabetes (T2D)"):
        assert label in labels
    assert {r.condition_simple for r in rows if r.trait == "High triglycerides"} == {"High TG"}
    assert sum(s.in_percentile_table for s in S.score_settings()) == 5
    assert len(S.GENE_SET) == 28 and len(S.LOF_GENE_SET) == 16 and len(S.TISSUES) == 38
