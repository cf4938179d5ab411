"""Submission analysis from files to files.

A person annotates the submissions between :func:`reported` and
:func:`refilter`; that hand-over stays a file with a fixed schema.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierlab.functions.columns import parse_us_date
from carrierlab.operators import submissions as B
from carrierlab.sources import readers as R
from carrierlab.sources.sinks import in_order, write_csv_run, write_tsv

ANNOTATED = {
    "VariationID": "int", "AlleleID": "int", "Type": "string", "Name": "string", "GeneSymbol": "string",
    "LastEvaluated": "string", "PhenotypeList": "string", "NumberSubmitters": "int", "chr": "string",
    "pos": "int", "REF": "string", "ALT": "string", "Traits": "string", "n_called": "int",
    "n_not_called": "int", "AC": "int", "n_het": "int", "submitter": "string",
    "submitter_date_last_evaluated": "string", "submitter_clinical_significance": "string",
    "submitter_collection_method": "string", "Correct_phenotype": "boolean",
    "clarification_unspecified_reported_phenotype": "string",
}
_CANONICAL = {
    "VariationID": "variation_id", "AlleleID": "allele_id", "Type": "type", "Name": "name", "GeneSymbol": "gene",
    "LastEvaluated": "last_evaluated", "PhenotypeList": "phenotype_list", "NumberSubmitters": "number_submitters",
    "REF": "ref", "ALT": "alt", "Traits": "traits", "AC": "ac", "submitter_date_last_evaluated": "date",
    "submitter_clinical_significance": "significance", "submitter_collection_method": "method",
    "Correct_phenotype": "correct_phenotype", "clarification_unspecified_reported_phenotype": "clarification",
}


@dataclass
class SubmissionInputs:
    gene_traits: DataFrame
    summary: DataFrame
    submissions: DataFrame
    sites: DataFrame | None = None
    observed: DataFrame | None = None


def read_inputs(
    spark: SparkSession, gene_traits: str, summary: str, submissions: str, sites: str | None = None,
    filtered_variants: str | None = None, partitions: int | None = None,
) -> SubmissionInputs:
    return SubmissionInputs(
        R.read_gene_traits(spark, gene_traits),
        R.read_variant_summary(spark, summary, partitions),
        R.read_submissions(spark, submissions, partitions),
        B.site_positions(R.read_sites(spark, sites)) if sites else None,
        B.observed_counts(R.read_filtered_variants(spark, filtered_variants)) if filtered_variants else None,
    )


def gene_summary(inputs: SubmissionInputs, assembly: str) -> DataFrame:
    """Submissions and variants per gene of interest."""
    genes = inputs.gene_traits.select("gene").distinct()
    variants = inputs.summary.where(
        (F.col("ClinSigSimple") == 1) & (F.col("assembly") == assembly)
    ).join(genes, "gene", "left_semi")
    return B.gene_submission_summary(variants, inputs.submissions)


def high_volume_submitters(inputs: SubmissionInputs, leave_out: Sequence[str] = ()) -> DataFrame:
    """Ranked laboratories; some are left out later for conflicting data."""
    dated = inputs.submissions.where(B.is_clinical("method")).withColumn("date", parse_us_date("date"))
    ranked = B.submitter_ranking(dated)
    return ranked.where(~F.col("submitter").isin(list(leave_out))) if leave_out else ranked


def reported(inputs: SubmissionInputs, assembly: str) -> tuple[DataFrame, DataFrame]:
    """(variants, submissions) that are observed and reportedly pathogenic."""
    rows = B.reported_submissions(
        inputs.summary, inputs.sites.drop("allele_id"), inputs.submissions, inputs.observed,
        inputs.gene_traits, assembly)
    return B.reported_variants(rows), rows.withColumn("last_evaluated", parse_us_date("LastEvaluated"))


def read_annotated(spark: SparkSession, path) -> DataFrame:
    return R.read_named_columns(spark, path, ANNOTATED, sep=",").withColumnsRenamed(_CANONICAL)


def refilter(annotated: DataFrame, observed: DataFrame, allele_link: str | None = None) -> DataFrame:
    return B.annotated_pathogenic(annotated, observed, allele_link=allele_link)


def write_refiltered(annotated: DataFrame, observed: DataFrame, folder: str, allele_link: str | None = None,
                     **options) -> dict[str, str]:
    """Write the curated variants, and their submissions in order of variant and place.

    ``options`` are those of :func:`submission_report`.
    """
    report = B.submission_report(annotated, **options)
    variants = B.annotated_pathogenic(annotated, observed, allele_link=allele_link, **options)
    return {
        "variants": write_csv_run(variants, f"{folder}/pathogenic_pheno_"),
        "submissions": write_csv_run(in_order(report, "variation_id", "place"), f"{folder}/submissions_pheno_"),
    }


def write_all(inputs: SubmissionInputs, assembly: str, folder: str) -> dict[str, str]:
    """Write the gene summary, the laboratory list and the reported tables."""
    write_tsv(high_volume_submitters(inputs), f"{folder}/list_of_HC_labs")
    variants, rows = reported(inputs, assembly)
    return {
        "gene_summary": write_csv_run(gene_summary(inputs, assembly), f"{folder}/gene_summary_{assembly}_"),
        "variants": write_csv_run(variants, f"{folder}/reported_pathogenics_"),
        "submissions": write_csv_run(rows, f"{folder}/submissions_"),
    }


