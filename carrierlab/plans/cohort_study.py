"""Cohorts from files, and every result table of the study."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions.columns import level_in
from carrierlab.operators import associations as A
from carrierlab.operators import cohort as H
from carrierlab.operators import counts as N
from carrierlab.operators import penetrance as P
from carrierlab.operators.ascertainment import ascertainment_table
from carrierlab.operators.models import COEFFICIENTS
from carrierlab.operators.scores import all_score_models, percentile_means, score_frames
from carrierlab.operators.survival import diagnosis_curves
from carrierlab.session import checkpointed
from carrierlab.sources import readers as R
from carrierlab.sources.sinks import write_tsv

MEASURES = {m: "double" for m in ("age", "bmi", "ldl_mgdl", "hdl_mgdl", "tg_mgdl")}
CASE_CONTROL = {
    "combined_id": "string", "id_55k": "string", "COHORT": "string", "esp_phenotype": "string", "race3": "string",
    "sex": "int", **MEASURES, "hba1c": "double", "h_glu": "double", "fast_glu_mmoll": "double", "lipidmeds": "int",
    "t2d_2_plus_or_2hg_11_1": "int", "aod": "int",
}
BIOBANK = {
    "FLOREZ_FID": "string", "FLOREZ_IID": "string", "SEX": "string", **MEASURES, "unrelated": "int",
    "cov_GENO_ARRAY": "string", "hba1c.30750.NGSP.max": "double", "lipidmeds": "int", "t2d": "int",
    "t2d_with_pre": "int", **{f"Age_diabetes_diagnosed_{i}": "int" for i in range(3)},
    **{f"PC{i}": "double" for i in range(1, 11)},
}
CASE_CONTROL_NAME, BIOBANK_NAME = "AMP-T2D-GENES", "UKBB"
COHORTS = (CASE_CONTROL_NAME, BIOBANK_NAME)


@dataclass(frozen=True)
class CarrierPaths:
    """Carrier lists and curated variants of one cohort."""

    lof: str
    lof_curated: str
    clinvar: str
    clinvar_curated: str
    review: str
    review_curated: str
    frequencies: str
    frequency_count: str = "gnomad_exomes_AC"


@dataclass(frozen=True)
class StudyPaths:
    gene_traits: str
    case_control_pheno: str
    unrelated: str
    case_control: CarrierPaths
    biobank_pheno: str
    biobank_exome_ids: str
    biobank: CarrierPaths


def _carriers(spark: SparkSession, paths: CarrierPaths, genes: DataFrame, pheno: DataFrame, name: str) -> DataFrame:
    return H.build_carrier_list(
        R.read_carriers(spark, paths.lof), R.read_curated(spark, paths.lof_curated),
        R.read_carriers(spark, paths.clinvar), R.read_clinvar_curated(spark, paths.clinvar_curated),
        R.read_carriers(spark, paths.review), R.read_curated(spark, paths.review_curated),
        genes, pheno, R.read_frequencies(spark, paths.frequencies, paths.frequency_count), name,
    )


def covariates(spark: SparkSession, path: str) -> DataFrame:
    return R.read_named_columns(
        spark, path, {"IID": "string", **{f"C{i}": "double" for i in range(1, 11)}})


def load(
    spark: SparkSession, paths: StudyPaths, age_cutoff: float, keep_ascertained: bool = False
) -> tuple[H.Cohort, DataFrame]:
    """(both cohorts stacked, gene-trait table)."""
    genes = R.read_gene_traits(spark, paths.gene_traits)
    first = H.prepare_case_control(
        R.read_named_columns(spark, paths.case_control_pheno, CASE_CONTROL), covariates(spark, paths.unrelated),
        age_cutoff, keep_ascertained, CASE_CONTROL_NAME)
    second = H.prepare_biobank(
        R.read_named_columns(spark, paths.biobank_pheno, BIOBANK), R.read_id_list(spark, paths.biobank_exome_ids),
        age_cutoff, BIOBANK_NAME,
    ).withColumnsRenamed({f"PC{i}": f"pc{i}" for i in range(1, 11)})
    cohorts = [
        H.make_cohort(pheno, _carriers(spark, p, genes, pheno, name))
        for pheno, p, name in ((first, paths.case_control, CASE_CONTROL_NAME), (second, paths.biobank, BIOBANK_NAME))
    ]
    return H.stack_cohorts(*cohorts), genes


def with_adjusted_lipids(pheno: DataFrame) -> DataFrame:
    """Treatment-adjusted values in place of the measured ones."""
    return pheno.withColumns({"ldl_mgdl": F.col("ldl_mgdl_adj"), "tg_mgdl": F.col("tg_mgdl_adj")})


def count_tables(study: H.Cohort, assessments: DataFrame | None = None) -> dict[str, DataFrame]:
    path = study.carriers.where(level_in("level", S.PATH_LEVELS))
    groups = ["AMP-T2D case", "AMP-T2D control", "UKB"]
    ancestry = F.when(F.col("cohort") == BIOBANK_NAME, "European").otherwise(F.col("ancestry"))
    return {
        "participants": N.participant_characteristics(
            study.pheno, N.participant_group(BIOBANK_NAME), groups, ancestry, S.ANCESTRY_ORDER).orderBy("row"),
        "carrier_counts": N.in_trait_order(N.cohorts_side_by_side(
            N.carrier_count_by_condition(study.pheno, path), COHORTS)),
        "variant_counts": N.curated_and_path_counts(study.carriers),
        "variants": N.in_table_order(N.final_variant_table(
            study.carriers, COHORTS, assessments, BIOBANK_NAME, H.CLINVAR_COLUMNS)),
        "variants_per_condition": N.variants_per_condition(study.carrier_pheno),
        "carrier_ancestry": N.carrier_ancestry(study.path_carrier_pheno),
        "cohort_ancestry": N.cohort_ancestry(study.pheno),
    }


def penetrance_tables(
    study: H.Cohort, genes: DataFrame, results: DataFrame, gene_results: DataFrame
) -> dict[str, DataFrame]:
    """Published penetrance tables: path and benign carriers, combined and by gene."""
    out = {}
    for name, levels, kind in (
        ("path", S.PATH_LEVELS, "pathogenic"), ("benign", S.BENIGN_LEVELS, "non_pathogenic_no_vus"),
    ):
        for suffix, by_gene, used in (("combined", False, results), ("gene", True, gene_results)):
            used = used.where(F.col("subset") == "All")
            table = P.penetrance_table(study.pheno, study.carriers, genes, levels=levels, by_gene=by_gene)
            means = P.carrier_means(study.pheno, study.carriers, genes, levels=levels, by_gene=by_gene)
            binary = A.format_penetrance(table, used, COHORTS, by_gene, kind)
            continuous = A.format_means(means, used, COHORTS, by_gene, kind).drop(
                "setting", "trait", "phenotype", "lipidmeds")
            keys = ["condition", "gene"] if by_gene else ["condition"]
            continuous = continuous.withColumnsRenamed(
                {c: f"{c}_cont" for c in continuous.columns if c not in keys and c in binary.columns})
            out[f"penetrance_{name}_{suffix}"] = binary.join(continuous, keys, "left").orderBy("setting", *keys[1:])
    return out


def _effect(models: DataFrame, model: str, variable: str, name: str) -> DataFrame:
    return models.where((F.col("model") == model) & (F.col("variable") == variable)).select(
        "condition", "restrict_lipid_meds", F.coalesce("gene", F.lit("")).alias("gene"),
        F.col("estimate").alias(f"{name} estimate"), F.col("p_value").alias(f"{name} pval"))


def score_contrasts(models: DataFrame) -> DataFrame:
    """Top percentile against the middle half, and against carriers; ``gene`` where its carriers alone were fitted."""
    keys = ["condition", "restrict_lipid_meds", "gene"]
    return _effect(models, "interquartile_vs_top", "groupingtop_1", "Top 1% vs interquartile").join(
        _effect(models, "top_vs_carrier", "carrierNon Carrier", "Carriers vs top 1%"), keys
    ).withColumn("gene", F.nullif(F.col("gene"), F.lit(""))).select(
        *keys[:2], "Top 1% vs interquartile estimate", "Top 1% vs interquartile pval", "Carriers vs top 1% estimate",
        "Carriers vs top 1% pval", "gene")


def score_tables(
    study: H.Cohort, genes: DataFrame, scores: Mapping[str, DataFrame], age_cutoff: float | None = 60,
    genes_alone: Mapping[str, tuple[str, ...]] | None = None,
    settings: Sequence[S.ScoreSetting] | None = None,
) -> dict[str, DataFrame]:
    """Percentile means, model tables and contrasts over all score settings.

    ``genes_alone`` names, per trait, genes whose contrasts are also fitted
    with carriers of that gene only.
    """
    genes_alone = {"MODY": ("GCK", "HNF1A")} if genes_alone is None else genes_alone
    pheno = with_adjusted_lipids(study.pheno)
    settings = list(settings or S.score_settings())
    long = None
    for phenotype in dict.fromkeys(s.phenotype for s in settings):
        part = scores[phenotype].select("subject", F.lit(phenotype).alias("phenotype"), "score")
        long = part if long is None else long.unionByName(part)
    frames = checkpointed(score_frames(pheno, long, study.carriers, genes, settings, age_cutoff))
    models = all_score_models(
        frames, models=("top_vs_carrier", "interquartile_vs_top", "carriers"), genes_alone=genes_alone)
    everyone = frames if age_cutoff is None else checkpointed(
        score_frames(pheno, long, study.carriers, genes, settings, None))
    columns = ["model", "condition", "restrict_lipid_meds", *COEFFICIENTS]
    tables = {
        "score_in_carriers": models.where("model = 'carriers' AND gene IS NULL").select(*columns),
        "score_contrasts": score_contrasts(models),
        "score_interaction": all_score_models(everyone, models=("interaction",)).select(*columns),
    }
    for number, setting in enumerate(settings):
        if setting.in_percentile_table:
            table = percentile_means(frames.where(F.col("setting") == number)).withColumn(
                "condition", F.lit(setting.trait))
            tables["score_percentiles"] = table if "score_percentiles" not in tables else tables[
                "score_percentiles"].unionByName(table)
    return tables


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        write_tsv(table, f"{folder}/{name}")


def all_tables(
    spark: SparkSession, paths: StudyPaths, association_paths: Mapping[str, Mapping[str, str]],
    score_paths: Mapping[str, str], age_cutoff: float = 40, assessments: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every result table of the study, by name.

    Phenotypes and carriers are read by every table, so they are kept in
    executor memory and disk after the first use.
    """
    study, genes = load(spark, paths, age_cutoff)
    study = replace(study, pheno=study.pheno.persist(), carriers=study.carriers.persist())
    results = R.read_associations(spark, association_paths["combined"])
    gene_results = R.read_associations(spark, association_paths["gene"])
    scores = {name: R.read_scores(spark, path) for name, path in score_paths.items()}
    ascertained, _ = load(spark, paths, age_cutoff, keep_ascertained=True)
    case_control = ascertained.path_carrier_pheno.where(F.col("cohort") == CASE_CONTROL_NAME)
    return {
        **count_tables(study, assessments),
        **penetrance_tables(study, genes, results, gene_results),
        **score_tables(study, genes, scores),
        "diagnosis_curves": diagnosis_curves(study.pheno, study.carriers, genes),
        "ascertainment": ascertainment_table(case_control, covariates(spark, paths.unrelated)),
    }
