"""Unknown values: the rules that differ between the study and plain SQL."""

import pytest
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions import columns as K
from carrierlab.operators import carriers as C
from carrierlab.operators import cohort as H
from carrierlab.operators import genotypes as G
from carrierlab.operators import penetrance as P
from carrierlab.operators.ascertainment import shared_variants
from carrierlab.operators.survival import kaplan_meier
from tests.conftest import collect

GENO = "contig string, pos int, alleles array<string>, sample string, gt array<int>, ad array<int>, dp int, gq int"


@pytest.mark.parametrize("gt,ad,dp,gq,kept", [
    ([0, 0], [30, 0], 30, None, False),   # quality unknown
    ([0, 1], [0, 0], 30, 30, True),       # no reads: balance undefined
    ([1, 1], [30, 1], 30, 30, True),      # balance applies to het only
    ([0, 1], [30, 5], 35, 30, False),     # unbalanced
    ([0, 1], [15, 15], 30, 30, True),
    ([0, 1], None, 30, 30, False),        # depth per allele unknown
    ([0, 0], None, 30, 30, True),         # ... does not matter without het
    ([0, 0], [5, 0], 5, 30, False),
    (None, [5, 0], 50, 30, False),
])
def test_genotype_mask(spark, gt, ad, dp, gq, kept):
    df = spark.createDataFrame([("1", 1, ["A", "C"], "s", gt, ad, dp, gq)], GENO)
    assert (G.mask_genotypes(df).first()["gt"] is not None) == kept


def test_negated_membership_keeps_null(spark):
    df = spark.createDataFrame([(None,), ("LDL_High",), ("x",)], "p string")
    assert df.where(~K.member("p", S.ASCERTAINED_PHENOTYPES)).count() == 2


def test_medication_rules(spark):
    df = spark.createDataFrame([(None, 70.0), (0, 70.0), (1, 70.0)], "lipidmeds int, ldl_mgdl double")
    got = [r[0] for r in df.select(K.treatment_adjusted("ldl_mgdl", "lipidmeds", 0.7)).collect()]
    assert got[:2] == [70.0, 70.0] and got[2] == pytest.approx(100.0)


def test_diagnosis_flag_ignores_unknown_labs(spark):
    df = spark.createDataFrame(
        [(0, None, None, 6.0), (None, None, None, None), (0, 6.0, None, None), (0, None, None, 6.6)],
        "t2d_2_plus_or_2hg_11_1 int, fast_glu_mmoll double, h_glu double, hba1c double")
    got = [(r["t2d"], r["t2d_with_pre"]) for r in H.diagnosis_flags(df).collect()]
    assert got == [(0, 1), (None, None), (0, 1), (1, 1)]


def _carriers(spark, rows):
    return spark.createDataFrame(
        rows, "subject string, cohort string, variant string, gene string, trait string, level string, evidence string, af double, ac int")


def _genes(spark):
    return spark.createDataFrame([("LDLR", "High LDL"), ("APOB", "High LDL")], "gene string, trait string")


def _pheno(spark, rows):
    return spark.createDataFrame(rows, "subject string, cohort string, ldl_mgdl double, lipidmeds int")


def test_collapse_keeps_lowest_known_frequency(spark):
    rows = [("a", "A", v, "LDLR", "High LDL", "Pathogenic", "LOF", af, 1) for v, af in (("v1", None), ("v2", 0.01), ("v3", 0.001))]
    rows += [("b", "A", v, "LDLR", "High LDL", "Pathogenic", "LOF", None, None) for v in ("w2", "w1")]
    pheno = _pheno(spark, [("a", "A", 1.0, 0), ("b", "A", 1.0, 0), ("c", "A", None, None)])
    status = C.carrier_status(_carriers(spark, rows), _genes(spark), ["High LDL"])
    assert {r["subject"]: r["variant"] for r in status.collect()} == {"a": "v3", "b": "w1"}
    out = C.annotate_carriers(pheno, _carriers(spark, rows), _genes(spark), "High LDL")
    assert out.count() == 3
    assert {r["subject"]: r["carrier"] for r in out.collect()} == {"a": "Carrier", "b": "Carrier", "c": "Non Carrier"}


def test_lowest_frequency_competes_over_all_levels_unless_asked(spark):
    rows = [("a", "A", "v1", "LDLR", "High LDL", "Pathogenic", "LOF", 0.01, 1),
            ("a", "A", "v2", "APOB", "High LDL", "VUS", "LOF", 0.001, 1)]
    carriers, pheno = _carriers(spark, rows), _pheno(spark, [("a", "A", 1.0, 0)])
    assert C.annotate_carriers(pheno, carriers, _genes(spark), "High LDL", by_gene=True).first()["gene"] == "APOB"
    assert C.annotate_carriers(
        pheno, carriers, _genes(spark), "High LDL", by_gene=True, prefer_levels=True).first()["gene"] == "LDLR"


@pytest.mark.parametrize("types,merged", [
    (["ClinVar", "LOF"], "ClinVar and LOF"), (["Review", "LOF"], "LOF and Review"), (["Review", "ClinVar"], "ClinVar, Review"),
])
def test_evidence_names(spark, types, merged):
    rows = [("a", "A", "v", "LDLR", "High LDL", "LOF", t, 0.1, 1) for t in types]
    out = C.annotate_carriers(_pheno(spark, [("a", "A", 1.0, 0)]), _carriers(spark, rows), _genes(spark), "High LDL")
    assert out.first()["evidence"] == merged
    assert H.collapse_evidence(_carriers(spark, rows)).first()["evidence"] == merged


def test_vus_options(spark):
    rows = [("a", "A", "v", "LDLR", "High LDL", "VUS", "LOF", 0.00001, 3), ("b", "A", "v", "LDLR", "High LDL", "VUS", "LOF", 0.0, 0),
            ("b", "A", "w", "LDLR", "High LDL", "lof", "LOF", 0.5, 9)]
    pheno = _pheno(spark, [("a", "A", 1.0, 0), ("b", "A", 1.0, 0)])
    carriers, genes = _carriers(spark, rows), _genes(spark)

    def labels(vus):
        return {r["subject"]: r["carrier"] for r in C.annotate_carriers(pheno, carriers, genes, "High LDL", vus=vus).collect()}

    assert labels("ignore") == {"a": "Non Carrier", "b": "Carrier"}
    assert labels("remove") == {"a": None, "b": "Carrier"}
    assert labels("stratify") == {"a": "VUS <1/10000", "b": "Carrier"}
    with pytest.raises(ValueError):
        labels("both")


def test_penetrance_denominator(spark):
    pheno = _pheno(spark, [("a", "A", 200.0, 0), ("b", "A", None, 0), ("c", "A", 100.0, None), ("d", "A", 190.0, 1), ("e", "A", 191.0, 0)])
    carriers = _carriers(spark, [("a", "A", "v", "LDLR", "High LDL", "Pathogenic", "LOF", 0.1, 1),
                                 ("b", "A", "v", "LDLR", "High LDL", "Pathogenic", "LOF", 0.1, 1)])
    settings = [s for s in S.outcome_settings() if s.trait == "High LDL" and s.phenotype == "ldl_mgdl"]
    got = collect(P.penetrance_counts(pheno, carriers, _genes(spark), settings).select(
        "lipidmeds", "carrier", "count", "total"), "lipidmeds", "carrier")
    # unknown value leaves the denominator; 190 is not above 190; unknown
    # medication leaves the restricted rows
    assert got == [(False, "Carrier", 1, 1), (False, "Non Carrier", 1, 3), (True, "Carrier", 1, 1), (True, "Non Carrier", 1, 1)]


def test_group_without_positives_is_kept(spark):
    pheno = _pheno(spark, [("a", "A", 50.0, 0), ("b", "B", 500.0, 0)])
    settings = [s for s in S.outcome_settings() if s.trait == "High LDL" and s.phenotype == "ldl_mgdl" and not s.no_meds]
    got = P.penetrance_table(pheno, _carriers(spark, []), _genes(spark), settings=settings).orderBy("cohort").collect()
    assert [(r["count"], r["total"], r["low"]) for r in got] == [(0, 1, 0.0), (1, 1, pytest.approx(0.025))]


def test_carrier_of_another_cohort_is_not_matched(spark):
    pheno = _pheno(spark, [("a", "A", 1.0, 0), ("a", "B", 1.0, 0)])
    carriers = _carriers(spark, [("a", "A", "v", "LDLR", "High LDL", "LOF", "LOF", 0.1, 1)])
    got = collect(C.annotate_carriers(pheno, carriers, _genes(spark), "High LDL").select("cohort", "carrier"), "cohort")
    assert got == [("A", "Carrier"), ("B", "Non Carrier")]


def test_gene_must_be_listed_for_the_trait(spark):
    carriers = _carriers(spark, [("a", "A", "v", "MC4R", "High LDL", "LOF", "LOF", 0.1, 1)])
    out = C.annotate_carriers(_pheno(spark, [("a", "A", 1.0, 0)]), carriers, _genes(spark), "High LDL")
    assert out.first()["carrier"] == "Non Carrier"


def test_any_flag(spark):
    df = spark.createDataFrame([("a", None), ("a", False), ("b", True), ("b", None), ("c", False)], "g string, x boolean")
    assert collect(df.groupBy("g").agg(K.any_or_null(F.col("x")).alias("x")), "g") == [("a", None), ("b", True), ("c", False)]


def test_empty_text_aggregate(spark):
    df = spark.createDataFrame([("a", None), ("b", "y"), ("b", "x"), ("b", "x")], "g string, t string")
    assert collect(df.groupBy("g").agg(K.distinct_sorted_text("t").alias("t")), "g") == [("a", ""), ("b", "x, y")]


def test_frequency_bands(spark):
    df = spark.createDataFrame(
        [(0.5, 0), (0.5, None), (0.00009, 1), (0.0001, 1), (0.00099, 1), (0.001, 1), (None, 5)], "af double, ac int")
    got = [r[0] for r in df.select(K.frequency_band("af", "ac")).collect()]
    assert got == ["Novel", "Novel", "<1/10000", "<1/1000", "<1/1000", ">=1/1000", None]


def test_kaplan_meier(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 2, 0), ("g", 3, 1), ("g", 3, 1), ("g", None, 1), ("g", 4, None)], "g string, t int, e int")
    got = collect(kaplan_meier(df, ["g"], "t", "e"), "t")
    assert [r[2:5] for r in got] == [(4, 1, 0), (3, 0, 1), (2, 2, 0)]
    assert [r[5] for r in got] == [pytest.approx(0.75), pytest.approx(0.75), 0.0]


def test_shared_variants(spark):
    df = spark.createDataFrame([("v", True), ("v", False), ("w", True), ("x", False)], "variant string, ascertained boolean")
    assert {r["variant"] for r in shared_variants(df).collect()} == {"v"}


def test_dates_and_texts(spark):
    df = spark.createDataFrame([("Jan 01, 2017", "[12,3]"), ("-", "x"), ("Dec 9, 2018", "[1]")], "d string, ac string")
    got = df.select(K.parse_us_date("d").cast("string"), K.alt_count("ac")).collect()
    assert [tuple(r) for r in got] == [("2017-01-01", 3), (None, None), ("2018-12-09", None)]


@pytest.mark.parametrize("x,text", [
    (0.191446, "0.191"), (1.0, "1"), (1234.5, "1.23e+03"), (0.0000123, "1.23e-05"), (0.0, "0"), (-2.5, "-2.5"),
    (999.6, "1e+03"), (0.00036, "0.00036"), (None, None),
])
def test_significant_digits(spark, x, text):
    assert spark.createDataFrame([(x,)], "x double").select(K.significant_digits("x")).first()[0] == text


def test_interval_text(spark):
    contig, start, end = K.parse_interval("t", 100)
    got = spark.createDataFrame([("chr1:50-300",)], "t string").select(contig, start, end).first()
    assert tuple(got) == ("chr1", 1, 400)
