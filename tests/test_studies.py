"""The whole cohort and submission studies on small made-up files."""

import random

import pytest
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.plans import cohort_study as CS
from carrierlab.plans import submission_study as SS
from carrierlab.sources import readers as R
from tests.conftest import collect


def write(path, header, rows, sep="\t", end="\n"):
    lines = [sep.join(header)] if header else []
    lines += [sep.join("NA" if v is None else str(v) for v in r) for r in rows]
    path.write_bytes((end.join(lines) + end).encode())
    return str(path)


GENES = [("LDLR", "High LDL", 1), ("PCSK9", "Low LDL", 1), ("GCK", "MODY", 1), ("HNF1A", "MODY", 1), ("GCK", "MODY Extended", 0)]


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    d = tmp_path_factory.mktemp("study")
    rng = random.Random(5)
    genes = write(d / "genes.txt", ["Gene_name", "Trait", "a", "b", "LoF", "c"],
                  [(g, t, "Yes", 0.1, lof, "TRUE") for g, t, lof in GENES], end="\r")
    labels = ["none", "LDL_High", "LDL_Low", None]
    first = [(f"p{i}", f"i{i}", "C1", labels[i % 4], rng.choice(["ea", "eu", "hs", "other"]), 1 + i % 2, 30 + i % 50,
              20 + rng.random() * 20, 60 + rng.random() * 180, 30 + rng.random() * 60, 80 + rng.random() * 200,
              4 + rng.random() * 4, 5 + rng.random() * 4, 4 + rng.random() * 3, rng.choice([0, 1, None]), rng.choice([0, 1]), None)
             for i in range(240)]
    pheno1 = write(d / "pheno1.txt", list(CS.CASE_CONTROL), first)
    unrelated = write(d / "unrelated.txt", ["IID"] + [f"C{i}" for i in range(1, 11)],
                      [[f"p{i}"] + [rng.random() for _ in range(10)] for i in range(240) if i != 7])
    second = [(f"{1000 + i}", f"{1000 + i}", rng.choice(["Male", "Female"]), 12 * (35 + i % 40), 20 + rng.random() * 20,
               60 + rng.random() * 180, 30 + rng.random() * 60, 80 + rng.random() * 200, 0 if i == 3 else 1, "UKBB", 5.5,
               rng.choice([0, 1, None]), i % 2, i % 2, 50 if i % 2 else None, None, None, *[rng.random() for _ in range(10)])
              for i in range(300)]
    pheno2 = write(d / "pheno2.txt", list(CS.BIOBANK), second)
    exome = write(d / "exome.txt", None, [(1000 + i,) for i in range(290)])

    def carrier_paths(prefix, ids, chrom):
        subset = {"LDLR": "a", "PCSK9": "b", "GCK": "c", "HNF1A": "d"}
        variants = {g: [f"{chrom}-{k}{i}-A-C" for i in range(3)] for g, k in zip(subset, (1, 2, 3, 4))}
        rows = [(s, rng.choice(variants[g]), g) for s in ids for g in rng.sample(list(variants), 2)]
        head = ["SubjectID", "Variant", "Gene", "ClinVarOrLOF"]
        levels = ["LOF", "Likely_LOF", "VUS"]
        curated = [(v, levels[i], f"note {g}") for g, vs in variants.items() for i, v in enumerate(vs)]
        traits = {"LDLR": "High LDL", "PCSK9": "Low LDL", "GCK": "MODY, MODY Extended", "HNF1A": "MODY"}
        archive = [(v, "Pathogenic" if i < 2 else "Benign", "n", traits[g], 7, 8, "Jan 01, 2018", "Pathogenic")
                   for g, vs in variants.items() for i, v in enumerate(vs)]
        freq = [(v.rsplit("-", 2)[0].replace("-", ":"), '["A","C"]', None if i == 0 else 0.0005 * i, i)
                for vs in variants.values() for i, v in enumerate(vs)]
        return CS.CarrierPaths(
            lof=write(d / f"{prefix}lof.txt", head, [(*r, "LOF") for r in rows]),
            lof_curated=write(d / f"{prefix}lofc.txt", ["Variant", "Level", "Notes"], curated, end="\r"),
            clinvar=write(d / f"{prefix}cv.txt", head, [(*r, "ClinVar") for r in rows[::2]]),
            clinvar_curated=write(d / f"{prefix}cvc.txt", ["Variant", "Level", "Notes", "Traits", "VariationID", "AlleleID",
                                  "LastEvaluated", "high_confidence_lab_2017_clinical_significance"], archive),
            review=write(d / f"{prefix}rv.txt", head, [(*r, "Review") for r in rows[::5]]),
            review_curated=write(d / f"{prefix}rvc.txt", ["Variant", "Level", "Notes"], curated, end="\r"),
            frequencies=write(d / f"{prefix}af.txt", ["locus", "alleles", "gnomad_exomes_popmax_AF", "gnomad_exomes_AC"], freq),
        )

    return CS.StudyPaths(
        genes, pheno1, unrelated, carrier_paths("a", [f"p{i}" for i in range(0, 240, 3)], "19"),
        pheno2, exome, carrier_paths("b", [str(1000 + i) for i in range(0, 300, 2)], "chr19"),
    ), d


def test_cohort_study(spark, paths):
    study_paths, d = paths
    study, genes = CS.load(spark, study_paths, 40)
    study.pheno.persist(), study.carriers.persist()
    by_cohort = {r["cohort"]: r["count"] for r in study.pheno.groupBy("cohort").count().collect()}
    # age, relatedness, ascertainment and sequencing filters
    assert by_cohort == {
        CS.CASE_CONTROL_NAME: sum(30 + i % 50 >= 40 and i != 7 and i % 4 in (0, 3) for i in range(240)),
        CS.BIOBANK_NAME: sum(35 + i % 40 >= 40 and i != 3 for i in range(290)),
    }
    kept = {r[0] for r in study.carriers.select("subject").distinct().collect()}
    assert kept <= {r[0] for r in study.pheno.select("subject").collect()}
    # loss-of-function lists only take genes with that mechanism; archive rows take their own traits
    extended = study.carriers.where("trait = 'MODY Extended'").select("evidence").distinct()
    assert {r[0] for r in extended.collect()} == {"ClinVar", "Review"}
    assert study.carriers.where("evidence = 'LOF' and variation_id is not null").count() > 0
    assert study.carriers.where("af is null").count() == 0

    tables = CS.count_tables(study)
    people = {r["rowname"]: r for r in tables["participants"].collect()}
    assert sum(people[x]["UKB"] for x in ("Male", "Female")) == by_cohort[CS.BIOBANK_NAME]
    assert people["European"]["UKB"] == by_cohort[CS.BIOBANK_NAME] and people["Hispanic"]["UKB"] is None
    counts = {r["cohort"]: r for r in tables["variant_counts"].collect()}
    assert counts["Both"]["total curated"] >= counts[CS.BIOBANK_NAME]["total curated"]
    assert counts["Both"]["total pathogenic"] <= counts["Both"]["total curated"]
    assert tables["variants"].count() > 0 and tables["carrier_counts"].count() > 0

    shares = {}
    for r in tables["carrier_ancestry"].collect():
        key = (r["trait"], r["evidence"])
        shares[key] = shares.get(key, 0) + r["frequency"]
    assert shares and all(v == pytest.approx(100) for v in shares.values())

    out = CS.diagnosis_curves(study.pheno, study.carriers, genes).collect()
    assert out and all(0 <= r["survival"] <= 1 for r in out)
    CS.write_tables({"variant_counts": tables["variant_counts"]}, str(d / "out"))
    assert spark.read.csv(str(d / "out/variant_counts"), sep="\t", header=True).count() == 3


def test_penetrance_layout(spark, paths):
    study_paths, d = paths
    study, genes = CS.load(spark, study_paths, 40)
    head = ["Condition", "Trait", "Gene", "type", "subset", "additional_covariates", "PVALUE", "BETA", "SEBETA"]
    rows = [("High_LDL", "high_ldl", None, "pathogenic", "All", "covart2d", 0.000123456, 1.5, 0.25),
            ("High_LDL", "ldl_mgdl", None, "pathogenic", "All", "covart2d", 0.5, 10.0, 2.0),
            ("High_LDL", "high_ldl", None, "non_pathogenic_no_vus", "All", "covart2d", 0.9, 0.0, 1.0)]
    path = write(d / "assoc.txt", head, rows)
    results = R.read_associations(spark, {CS.BIOBANK_NAME: path})
    tables = CS.penetrance_tables(study, genes, results, results)
    assert set(tables) == {"penetrance_path_combined", "penetrance_path_gene", "penetrance_benign_combined", "penetrance_benign_gene"}
    rows = {r["condition"]: r for r in tables["penetrance_path_combined"].collect()}
    assert len(rows) == 22
    r = rows["High LDL (>190 mg/dl)"]
    assert r["p_text_UKBB"] == "0.000123" and r["or_text_UKBB"] == "4.48 (3.49-5.75)"
    assert r["beta_text_UKBB_cont"] == "10 (2)" and r["p_text_AMP-T2D-GENES"] is None
    assert r["count_Carrier_UKBB"] <= r["total_Carrier_UKBB"] and r["mean_ci_Carrier_UKBB"].count("(") == 1
    assert rows["High LDL ADJ (>190 mg/dl) no lipid meds"]["restricted"] == "Yes"


def test_scores_and_ascertainment(spark, paths):
    study_paths, d = paths
    study, genes = CS.load(spark, study_paths, 40)
    rng = random.Random(9)
    score = write(d / "score.txt", ["FID", "IID", "SCORE"], [(i, 1000 + i, rng.gauss(0, 1)) for i in range(300)], sep="  ")
    scores = {p: R.read_scores(spark, score) for p in ("ldl_mgdl", "t2d")}
    tables = CS.score_tables(study, genes, scores, 60, {}, [S.score_settings()[2]])
    everyone = tables["score_interaction"].collect()
    assert [r["variable"] for r in everyone][:3] == ["(Intercept)", "carrierCarrier", "prs"] and len(everyone) == 16
    assert all(r["statistic"] == pytest.approx(r["estimate"] / r["std_error"]) for r in everyone)
    assert tables["score_in_carriers"].count() == 14
    contrast = tables["score_contrasts"].first()
    assert contrast["condition"] == "High LDL" and 0 <= contrast["Carriers vs top 1% pval"] <= 1
    sizes = [r["n"] for r in tables["score_percentiles"].where("color <> 'Carrier'").collect()]
    assert max(sizes) - min(sizes) <= 1

    whole, _ = CS.load(spark, study_paths, 40, keep_ascertained=True)
    rows = CS.ascertainment_table(
        whole.path_carrier_pheno.where(F.col("cohort") == CS.CASE_CONTROL_NAME), CS.covariates(spark, study_paths.unrelated)
    ).collect()
    assert {r["condition"] for r in rows} == {
        "High LDL", "Low LDL", "High LDL - Restricted to shared variants", "Low LDL - Restricted to shared variants"}
    for r in rows:
        assert r["lci_LDL_ascertained"] < r["mn_LDL_ascertained"] < r["uci_LDL_ascertained"]


def test_submission_study(spark, tmp_path):
    genes = write(tmp_path / "g.txt", ["Gene_name", "Trait", "a", "b", "LoF", "c"],
                  [("LDLR", "High LDL", "Y", 0.1, 1, "TRUE"), ("LMNA", "Lipodystrophy", "Y", 0.1, 0, "TRUE")], end="\r")
    summary = write(tmp_path / "v.txt", ["AlleleID", "Type", "Name", "GeneSymbol", "HGNC_ID", "ClinSigSimple", "LastEvaluated",
                                         "PhenotypeList", "Assembly", "NumberSubmitters", "VariationID"],
                    [(100 + i, "snv", "n", g, "H", c, "Jan 01, 2018", "p", a, 2, i)
                     for i, g, c, a in ((1, "LDLR", 1, "GRCh37"), (2, "LDLR", 1, "GRCh37"), (3, "LMNA", 1, "GRCh37"),
                                        (4, "OTHER", 1, "GRCh37"), (5, "LDLR", 0, "GRCh37"), (1, "LDLR", 1, "GRCh38"))])
    clin, lit = "clinical testing", "literature only"
    claims = [(1, "Pathogenic", clin), (1, "Benign", clin), (1, "Likely pathogenic", lit), (1, "Benign", None),
              (2, "Pathogenic", lit), (2, "Benign", clin), (3, "pathogenic", lit), (4, "Pathogenic", clin), (5, "Pathogenic", clin)]
    body = [(v, s, "Mar 03, 2018", "-", "-", f"C:{s}", "-", m, "-", "GeneDx", "S", "-", "-") for v, s, m in claims]
    submissions = write(tmp_path / "s.txt", ["#VariationID", *"abcdefghijkl"], body)
    sites = tmp_path / "sites.vcf"
    sites.write_text("##x\n" + "".join(f"19\t{i}00\t{i}\tA\tG\t.\t.\tALLELEID=10{i};X=1\n" for i in (1, 2, 3, 4, 5)))
    observed = write(tmp_path / "f.txt", ["locus", "alleles", "variant", "n_called", "n_not_called", "AC", "AF", "n_non_ref", "n_het"],
                     [(f"chr19:{i}00", '["A","G"]', f"chr19:{i}00:A:G", 9, 1, f"[{18 - ac},{ac}]", "[1,0]", ac, ac)
                      for i, ac in ((1, 2), (2, 0), (3, 1))])
    inputs = SS.read_inputs(spark, genes, summary, submissions, str(sites), observed)
    got = {r["gene"]: r for r in SS.gene_summary(inputs, "GRCh37").collect()}
    ldlr = got["LDLR"]
    assert (ldlr["submissions_all"], ldlr["submissions_clinic"], ldlr["submissions_no_clinic"]) == (6, 2, 2)
    assert (ldlr["variants_all"], ldlr["variants_clinic"], ldlr["variants_no_clinic"]) == (2, 1, 2)
    assert (ldlr["path_submissions_all"], ldlr["path_submissions_clinic"], ldlr["path_submissions_no_clinic"]) == (3, 1, 2)
    assert ldlr["clinical_path_phenotypes"] == "C:Pathogenic"
    assert got["LMNA"]["submissions_clinic"] is None and got["LMNA"]["clinical_path_phenotypes"] is None
    assert set(got) == {"LDLR", "LMNA"}

    variants, rows = SS.reported(inputs, "GRCh37")
    # variant 2 has no clinical path claim (and is unobserved); LMNA is exempt from the clinical rule
    assert {r["variation_id"]: r["ac"] for r in variants.collect()} == {1: 2, 3: 1}
    assert collect(rows.groupBy("variation_id").count(), "variation_id") == [(1, 2), (3, 1)]
    assert SS.high_volume_submitters(inputs).count() == 0

    header = list(SS.ANNOTATED)
    base = dict(AlleleID=101, Type="snv", Name="n", GeneSymbol="LDLR", LastEvaluated="x", PhenotypeList="p", NumberSubmitters=2,
                chr="chr19", REF="A", ALT="G", Traits="High LDL", n_called=9, n_not_called=1, AC=2, n_het=2)
    recs = [
        dict(base, VariationID=1, pos=100, submitter="GeneDx", submitter_date_last_evaluated='"Mar 03, 2018"',
             submitter_clinical_significance="Pathogenic", submitter_collection_method=clin, Correct_phenotype="TRUE",
             clarification_unspecified_reported_phenotype="No Information"),
        dict(base, VariationID=1, pos=100, submitter="Other", submitter_date_last_evaluated=None,
             submitter_clinical_significance="Benign", submitter_collection_method=clin, Correct_phenotype="TRUE",
             clarification_unspecified_reported_phenotype=None),
        dict(base, VariationID=3, pos=300, submitter="Invitae", submitter_date_last_evaluated=None,
             submitter_clinical_significance="Pathogenic", submitter_collection_method=clin, Correct_phenotype="TRUE",
             clarification_unspecified_reported_phenotype=None),
        dict(base, VariationID=2, pos=200, submitter="GeneDx", submitter_date_last_evaluated='"Mar 03, 2018"',
             submitter_clinical_significance="Pathogenic", submitter_collection_method=clin, Correct_phenotype="FALSE",
             clarification_unspecified_reported_phenotype=None),
    ]
    path = write(tmp_path / "annotated.csv", header, [[r.get(h) for h in header] for r in recs], sep=",")
    out = {r["variation_id"]: r for r in SS.refilter(SS.read_annotated(spark, path), inputs.observed).collect()}
    assert set(out) == {1, 3}
    assert out[1]["flag_hc_lab_unspecified_phenotype"] is True and out[1]["high_confidence_any"] is True
    assert out[1]["high_confidence_significance"] == "Pathogenic" and out[1]["variant"] == "chr19-100-A-G"
    # listed laboratory without a date: unknown
    assert out[3]["high_confidence_any"] is None and out[3]["flag_hc_lab_unspecified_phenotype"] is False
    written = SS.write_all(inputs, "GRCh37", str(tmp_path / "out"))
    assert R.read_named_columns(spark, written["gene_summary"], {"gene": "string", "variants_all": "int"}, sep=",").count() == 2


def test_sample_study(spark, tmp_path):
    from carrierlab.plans import sample_study
    from carrierlab.sources import schemas

    pheno = write(tmp_path / "p.csv", ["combined_id", "id_55k", "COHORT", "other"], [
        ("A::1", "i1", "C1", "x"), ("A::2", "i2", "SEARCH", "x"), ("A::3", "i3", "C1", "x"),
        ("A::4", "i4", None, 5), ("A::5", None, "C1", "x"), ("A::6", "i6", "C1", "x")], sep=",")
    banned = write(tmp_path / "f.txt", ["Individual.ID"], [("i3",)])
    exome = write(tmp_path / "e.txt", ["s"], [(f"A::{i}",) for i in (1, 2, 3, 4, 5)] + [("B::9::z",)])
    out = sample_study.prepare(spark, pheno, banned, exome, str(tmp_path / "out"))
    # unknown cohort and unknown id are kept
    assert collect(out["phenotypes"].select("combined_id", "other"), "combined_id") == [("A::1", "x"), ("A::4", "5"), ("A::5", "x")]
    flags = collect(R.read_delimited(spark, str(tmp_path / "out/samples_to_keep"), schemas.SAMPLE_FLAGS), "s")
    assert flags == [("A::1", "A", "1", False), ("A::2", "A", "2", True), ("A::3", "A", "3", True),
                     ("A::4", "A", "4", False), ("A::5", "A", "5", False), ("B::9::z", "B", "9", True)]
    assert collect(out["overlap_before"]) == [(6, 6, 5)] and collect(out["overlap_after"]) == [(4, 6, 3)]
