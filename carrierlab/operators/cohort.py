"""Cohort loading and harmonisation.

Canonical names: a phenotype table has ``subject, cohort, age, sex, ancestry,
lipidmeds`` and measures; a carrier table has ``subject, cohort, variant,
variant_b37, gene, trait, level, evidence, notes, af, ac``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions.columns import (
    distinct_sorted_text, flag_where, level_in, locus_allele_key, member, recode, rename_evidence,
    split_part_or_null, treatment_adjusted,
)


# --- usable samples --------------------------------------------------------

def usable_phenotypes(
    pheno: DataFrame, forbidden: DataFrame, exome: DataFrame, subject: str = "combined_id",
    cohort: str = "COHORT", forbidden_key: str = "id_55k", forbidden_id: str = "Individual.ID",
    exome_id: str = "s", removed_cohorts: Iterable[str] = S.EXCLUDED_COHORTS,
) -> DataFrame:
    """Phenotype rows that may be used and have exome data.

    Rows with a null cohort or null id are kept by the negated tests.
    """
    ids = forbidden.select(F.col(f"`{forbidden_id}`").alias(forbidden_key)).distinct()
    sequenced = exome.select(F.col(exome_id).alias(subject)).distinct()
    return (
        pheno.where(~member(cohort, removed_cohorts))
        .join(ids, forbidden_key, "left_anti")
        .join(sequenced, subject, "left_semi")
    )


def sample_flags(exome: DataFrame, usable: DataFrame, sample_id: str = "s", subject: str = "combined_id"):
    """Exome samples split into project and sample, flagged when not usable."""
    known = usable.select(F.col(subject).alias(sample_id), F.lit(True).alias("_usable")).distinct()
    return exome.join(known, sample_id, "left").select(
        sample_id,
        split_part_or_null(sample_id, "::", 1).alias("project"),
        split_part_or_null(sample_id, "::", 2).alias("sample"),
        F.col("_usable").isNull().alias("is_forbidden"),
    )


def overlap_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows on each side and distinct keys on both, as one row."""
    sides = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    per_key = sides.groupBy(key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    return per_key.agg(
        F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"),
        F.count(F.when((F.col("_l") > 0) & (F.col("_r") > 0), 1)).alias("n_both"),
    )


# --- phenotype harmonisation -----------------------------------------------

def diagnosis_flags(
    pheno: DataFrame, base: str = "t2d_2_plus_or_2hg_11_1", fasting: str = "fast_glu_mmoll",
    two_hour: str = "h_glu", hba1c: str = "hba1c",
) -> DataFrame:
    """``t2d`` and ``t2d_with_pre`` from a base flag and laboratory values."""
    return pheno.withColumns({
        "t2d_with_pre": flag_where(
            base, F.col(fasting) * 18 >= 100, F.col(two_hour) * 18 >= 140, F.col(hba1c) >= 5.7
        ),
        "t2d": flag_where(base, F.col(hba1c) >= 6.5),
    })


def adjust_for_treatment(pheno: DataFrame, meds: str = "lipidmeds") -> DataFrame:
    return pheno.withColumns({
        "ldl_mgdl_adj": treatment_adjusted("ldl_mgdl", meds, 0.7),
        "tg_mgdl_adj": treatment_adjusted("tg_mgdl", meds, 0.85),
    })


def prepare_case_control(
    pheno: DataFrame, unrelated: DataFrame, age_cutoff: float, keep_ascertained: bool = False,
    cohort: str = "AMP-T2D-GENES",
) -> DataFrame:
    """First cohort: laboratory-based diagnosis, ancestry names, unrelated only."""
    ids = unrelated.select(F.col("IID").alias("combined_id")).distinct()
    out = diagnosis_flags(pheno).withColumn("ancestry", recode("race3", S.ANCESTRY_CODES)).join(
        ids, "combined_id", "left_semi"
    )
    if not keep_ascertained:
        out = out.where(~member("esp_phenotype", S.ASCERTAINED_PHENOTYPES))
    out = out.withColumn("fast_glu", F.col("fast_glu_mmoll")).where(F.col("age") >= age_cutoff)
    return adjust_for_treatment(out).withColumns(
        {"subject": F.col("combined_id").cast("string"), "cohort": F.lit(cohort)}
    )


def prepare_biobank(
    pheno: DataFrame, exome_ids: DataFrame, age_cutoff: float, cohort: str = "UKBB"
) -> DataFrame:
    """Second cohort: sequenced, unrelated, codes to numbers, months to years."""
    ids = exome_ids.select(F.col("id").alias("FLOREZ_FID")).distinct()
    out = (
        pheno.join(ids, "FLOREZ_FID", "left_semi").where(F.col("unrelated") == 1)
        .withColumns({
            "sex": recode("SEX", {"Male": 1, "Female": 2}, F.lit(None)),
            "age": F.col("age") / 12,
            "cov_GENO_ARRAY": recode("cov_GENO_ARRAY", {"UKBB": 1, "UKBL": 2}, F.lit(None)),
            "hba1c": F.col("`hba1c.30750.NGSP.max`"),
            "subject": F.col("FLOREZ_IID").cast("string"),
            "cohort": F.lit(cohort),
        })
        .where(F.col("age") >= age_cutoff)
    )
    return adjust_for_treatment(out)


def age_at_onset(
    known_ages: Sequence[str], disease: str = "t2d", age: str = "age"
):
    """First known age at diagnosis, else the current age of the unaffected."""
    return F.coalesce(
        *[F.col(c).cast("int") for c in known_ages],
        F.when(F.col(disease) == 0, F.col(age).cast("int")),
    )


# --- carrier lists ---------------------------------------------------------

def frequency_table(raw: DataFrame, ac: str) -> DataFrame:
    """Variant key, population frequency (missing is 0) and allele count."""
    return raw.select(
        locus_allele_key("locus", "alleles").alias("variant"),
        F.coalesce(F.col("gnomad_exomes_popmax_AF"), F.lit(0.0)).alias("af"),
        F.col(ac).alias("ac"),
    )


def _curated(carriers: DataFrame, curated: DataFrame) -> DataFrame:
    """Carrier rows of curated variants with level and notes."""
    extra = [c for c in curated.columns if c == "variant" or c not in carriers.columns]
    return carriers.join(curated.select(*extra), "variant")


CLINVAR_COLUMNS = ("variation_id", "allele_id", "last_evaluated", "high_confidence_significance")


def build_carrier_list(
    lof: DataFrame, lof_curated: DataFrame, clinvar: DataFrame, clinvar_curated: DataFrame,
    review: DataFrame, review_curated: DataFrame, gene_traits: DataFrame, pheno: DataFrame,
    frequency: DataFrame, cohort: str,
) -> DataFrame:
    """All carriers of curated variants in one cohort.

    Loss-of-function and reviewed variants take every trait of their gene
    (loss-of-function only where that is the gene's mechanism); archive
    variants take the traits written beside them. The first two are annotated
    with archive fields by (variant, trait).
    """
    columns = ["subject", "gene", "level", "variant", "evidence", "trait", "variant_b37", "notes"]

    def b37(df: DataFrame) -> DataFrame:
        return df if "variant_b37" in df.columns else df.withColumn("variant_b37", F.col("variant"))

    archive = (
        b37(_curated(clinvar, clinvar_curated))
        .withColumn("trait", F.explode(F.split("traits", ", ")))
        .select(*columns, *CLINVAR_COLUMNS)
    )
    annotation = archive.select("variant", "trait", *CLINVAR_COLUMNS).distinct()
    traits = gene_traits.select("gene", "trait", "lof")

    def other(carriers: DataFrame, curated: DataFrame, used: DataFrame) -> DataFrame:
        return (
            b37(_curated(carriers, curated)).join(used.select("gene", "trait"), "gene")
            .select(*columns).join(annotation, ["variant", "trait"], "left")
        )

    stacked = archive.unionByName(
        other(lof, lof_curated, traits.where(F.col("lof") == 1))
    ).unionByName(other(review, review_curated, traits))
    return (
        stacked.join(pheno.select("subject").distinct(), "subject", "left_semi")
        .join(frequency, "variant", "left").withColumn("cohort", F.lit(cohort))
    )


def collapse_evidence(carriers: DataFrame, levels: Iterable[str] | None = None) -> DataFrame:
    """One row per (subject, variant, trait, gene) with merged evidence types."""
    used = carriers if levels is None else carriers.where(level_in("level", levels))
    keys = [c for c in ("subject", "cohort", "variant", "trait", "gene", "af", "ac") if c in carriers.columns]
    return used.groupBy(*keys).agg(rename_evidence(distinct_sorted_text("evidence")).alias("evidence"))


def variant_list(carriers: DataFrame) -> DataFrame:
    """Distinct variants per evidence type with their number of carriers.

    The count is over (variant, evidence, gene, trait, level, frequency), as
    distinct (subject, b37 key) pairs; the b37 key is listed beside it.
    """
    keys = [c for c in ("cohort", "evidence", "variant", "gene", "trait", "level", "af", "ac")
            if c in carriers.columns]
    totals = carriers.select("subject", "variant_b37", *keys).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("carrier_count"),
        # bounded: spellings of one variant on the other build
        F.collect_set(F.coalesce("variant_b37", F.lit("NA"))).alias("_b37"),
    )
    return totals.withColumn("variant_b37", F.explode("_b37")).drop("_b37").withColumn(
        "variant_b37", F.nullif("variant_b37", F.lit("NA"))
    )


def phenotypes_of_carriers(
    pheno: DataFrame, carriers: DataFrame, levels: Iterable[str] | None = None
) -> DataFrame:
    """Phenotype joined to every carrier row (several rows per subject)."""
    used = carriers if levels is None else carriers.where(level_in("level", levels))
    keys = [k for k in ("subject", "cohort") if k in carriers.columns and k in pheno.columns]
    return pheno.join(used, keys)


@dataclass
class Cohort:
    """The tables of one cohort, or of several stacked ones."""

    pheno: DataFrame
    carriers: DataFrame
    variants: DataFrame
    carriers_collapsed: DataFrame
    path_carriers_collapsed: DataFrame
    carrier_pheno: DataFrame
    path_carrier_pheno: DataFrame


def make_cohort(pheno: DataFrame, carriers: DataFrame) -> Cohort:
    return Cohort(
        pheno=pheno,
        carriers=carriers,
        variants=variant_list(carriers),
        carriers_collapsed=collapse_evidence(carriers),
        path_carriers_collapsed=collapse_evidence(carriers, S.PATH_LEVELS),
        carrier_pheno=phenotypes_of_carriers(pheno, carriers),
        path_carrier_pheno=phenotypes_of_carriers(pheno, carriers, S.PATH_LEVELS),
    )


def stack(first: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION ALL by column name; columns missing on one side become null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def stack_cohorts(*cohorts: Cohort) -> Cohort:
    return Cohort(*[
        stack(*[getattr(c, f.name) for c in cohorts]) for f in fields(Cohort)
    ])
