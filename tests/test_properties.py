"""Properties that hold for any input, and skewed or streaming input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carrierlab.operators import genotypes as G
from carrierlab.operators import penetrance as P
from carrierlab.operators import submissions as B
from carrierlab.plans import views as V
from plain_stats import beta_cdf, beta_quantile


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 200), st.integers(0, 200))
def test_interval_contains_the_share(k, extra):
    n = k + extra
    if n == 0:
        return
    low = 0.0 if k == 0 else float(beta_quantile(0.025, k, n - k + 1))
    high = 1.0 if k == n else float(beta_quantile(0.975, k + 1, n - k))
    assert 0 <= low <= k / n <= high <= 1


@settings(max_examples=60, deadline=None)
@given(st.floats(0.5, 50), st.floats(0.5, 50), st.floats(0.01, 0.99))
def test_beta_distribution_symmetry(a, b, x):
    assert np.isclose(beta_cdf(x, a, b), 1 - beta_cdf(1 - x, b, a), atol=1e-10)


def test_penetrance_table_is_consistent(spark, folder):
    rows = P.penetrance_table(V.prepared_phenotypes(spark, folder), V.carriers(spark, folder), V.gene_traits(spark, folder)).collect()
    assert rows
    shown = P.ordered_by_setting(spark.createDataFrame(rows)).collect()
    assert [r["setting"] for r in shown] == sorted(r["setting"] for r in rows)
    assert [r["carrier"] for r in shown][:2] == ["Non Carrier", "Carrier"]
    for r in rows:
        assert 0 <= r["count"] <= r["total"] and r["low"] <= r["prop"] <= r["high"]
    # arms of one setting and cohort cover the same subjects whatever the levels
    benign = P.penetrance_counts(V.prepared_phenotypes(spark, folder), V.carriers(spark, folder), V.gene_traits(spark, folder),
                                 levels=("benign",))
    def totals(table):
        return {(r["condition"], r["cohort"]): (r["t"], r["c"]) for r in table.groupBy("condition", "cohort").agg(
            F.sum("total").alias("t"), F.sum("count").alias("c")).collect()}
    assert totals(benign) == totals(spark.createDataFrame(rows).select("condition", "cohort", "total", "count"))


def test_variant_counts_are_consistent(spark, folder):
    for r in G.variant_qc(G.mask_genotypes(V.genotypes(spark, folder)), ["partkey"]).collect():
        assert r["ac"] <= r["an"] == 2 * r["n_called"] and r["n_non_ref"] == r["n_het"] + r["n_hom"]


def test_one_variant_with_a_third_of_all_submissions(spark):
    hot = spark.range(30000).select(F.lit(7).cast("long").alias("variation_id"), "id")
    rest = spark.range(60000).select((F.col("id") % 5000 + 100).alias("variation_id"), "id")
    claims = hot.unionAll(rest).select(
        "variation_id", F.when(F.col("id") % 1000 == 3, "Pathogenic").otherwise("Benign").alias("significance"),
        F.lit("GeneDx").alias("submitter"), F.lit("2018-01-01").cast("date").alias("date"), F.lit("clinical testing").alias("method"),
        F.lit("No Information").alias("clarification"), F.lit(True).alias("correct_phenotype"), F.lit("p").alias("phenotype"))
    kept = B.keep_groups_with(claims, ["variation_id"], F.col("significance") == "Pathogenic")
    assert kept.where("variation_id = 7").count() == 30000
    counts = B.submission_counts(claims).where("variation_id = 7").first()
    assert (counts["n_all"], counts["path_all"]) == (30000, 30)
    flag = B.high_confidence_flags(claims).where("variation_id = 7").first()
    assert flag["n_submissions"] == 30000 and flag["high_confidence_significance"].count("Pathogenic") == 30
    assert flag["high_confidence_significance"].count("Benign") == 29970


def test_row_operators_accept_a_stream(spark, folder, tmp_path):
    V.genotypes(spark, folder).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = G.mask_genotypes(stream).writeStream.format("memory").queryName("masked_calls").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = G.mask_genotypes(V.genotypes(spark, folder)).where("gt is not null").count()
    assert spark.table("masked_calls").where("gt is not null").count() == want
