"""Contract with the driver, and the shape of the physical plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from carrierlab.plans import views as V
from carrierlab.operators import penetrance as P

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["condition", "phenotype", "lipidmeds", "cohort", "carrier", "count", "total", "prop"]
    assert got.count() > 0


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 70


@pytest.mark.parametrize("name", [
    "penetrance_by_cohort", "penetrance_by_gene", "lowest_af_per_carrier", "score_percentile_means", "gene_submission_summary", "split_multi",
])
def test_matches_sql_on_the_smallest_tables(spark, folder, db, name):
    got = entry.queries()[name](spark, folder)
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    left = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    right = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    assert left == right


def test_penetrance_plan_stays_in_the_jvm_without_products(spark, folder):
    plan = executed(P.penetrance_counts(V.prepared_phenotypes(spark, folder), V.carriers(spark, folder), V.gene_traits(spark, folder)))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Window"):
        assert word not in plan
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_penetrance_scans_only_the_needed_columns(spark, folder):
    plan = executed(P.penetrance_counts(V.prepared_phenotypes(spark, folder), V.carriers(spark, folder), V.gene_traits(spark, folder)))
    lines = [x for x in plan.splitlines() if "l_orderkey" in x and "ReadSchema" in x]
    assert lines and all("l_extendedprice" not in x.split("ReadSchema")[1] for x in lines)


@pytest.mark.parametrize("name", ["interval_filter", "block_remap", "reported_submissions", "hc_lab_flags", "variant_count_both", "score_z"])
def test_no_nested_loop_join(spark, folder, name):
    plan = executed(entry.queries()[name](spark, folder))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
