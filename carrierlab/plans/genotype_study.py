"""From genotypes to annotated loss-of-function variants, step by step.

Each step is a DataFrame function and can be skipped. Most steps stay lazy, so
Spark prunes columns and pushes filters across them; only the two that cut the
data down, after genotype QC and after the loss-of-function filter, are worth
writing out, and ``folder`` turns that on.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.operators import genotypes as G
from carrierlab.sources.sinks import persist_table, write_tsv
from carrierlab.sources.vcf import write_vcf

STEPS = (
    "filter_samples", "filter_intervals", "split", "genotype_filter", "variant_qc",
    "filter_consequences", "filter_lof", "expression", "lift",
)


@dataclass
class GenotypeInputs:
    genotypes: DataFrame
    sample_flags: DataFrame | None = None
    intervals: DataFrame | None = None
    consequences: DataFrame | None = None
    expression: DataFrame | None = None
    gene_maximum: DataFrame | None = None
    blocks: DataFrame | None = None


@dataclass
class GenotypeResult:
    genotypes: DataFrame
    variants: DataFrame
    filtered: DataFrame | None = None
    lof: DataFrame | None = None
    skipped: set[str] = field(default_factory=set)


def run(
    inputs: GenotypeInputs, skip: Iterable[str] = (), genes: Sequence[str] = S.GENE_SET,
    lof_genes: Sequence[str] = S.LOF_GENE_SET, severity: Sequence[str] = S.CODING_SEVERITY,
    dropped_tissues: Sequence[str] = (), folder: str | None = None, overwrite: bool = True,
) -> GenotypeResult:
    """Run the steps. Steps without their input count as skipped.

    Sources without quality fields must skip ``genotype_filter``. Each gene of
    ``genes`` (the study's genes by default) must have an interval, if
    intervals are given. With ``folder`` the quality-controlled calls are
    exported there as call text, before consequences are looked at, and the
    table of worst consequences after them.
    """
    skipped = set(skip)
    unknown = skipped - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    for step, needed in (
        ("filter_samples", inputs.sample_flags), ("filter_intervals", inputs.intervals),
        ("filter_consequences", inputs.consequences), ("filter_lof", inputs.consequences),
        ("expression", inputs.expression), ("lift", inputs.blocks),
    ):
        if needed is None:
            skipped.add(step)
    data = inputs.genotypes

    if "filter_samples" not in skipped:
        data = G.drop_flagged_samples(data, inputs.sample_flags)
    if "filter_intervals" not in skipped:
        data = G.filter_to_intervals(data, G.gene_intervals(inputs.intervals, genes))
    if "split" not in skipped:
        data = G.split_multiallelic(data)
    if "genotype_filter" not in skipped:
        missing = {"gq", "dp", "ad"} - set(data.columns)
        if missing:
            raise ValueError(f"genotype_filter needs {sorted(missing)}; skip it for this source")
        data = G.mask_genotypes(data)
    if folder:
        data = persist_table(data, f"{folder}/genotypes", overwrite, ["contig"]).withColumn(
            "contig", F.col("contig").cast("string"))

    variants = G.observed_variants(G.variant_qc(data))
    result = GenotypeResult(data, variants, skipped=skipped)
    if folder:
        export_qc_calls(result, f"{folder}/qc_calls", overwrite)
    if "filter_consequences" in skipped:
        return result
    result.filtered = G.keep_consequences(
        variants.join(inputs.consequences, list(G.VARIANT)), genes)
    if "filter_lof" in skipped:
        return result
    lof = G.keep_consequences(result.filtered, lof_genes, out="lof_consequences", lof="HC")
    if folder:
        lof = persist_table(lof, f"{folder}/lof_variants", overwrite)
    if "expression" not in skipped:
        parts = lof.select(*G.VARIANT, F.explode("consequences").alias("t")).select(
            *G.VARIANT, F.col("t.gene_symbol").alias("gene"), F.col("t.transcript_id").alias("transcript"),
            F.explode("t.consequence_terms").alias("csq"),
            F.array_join("t.lof_flags", ",").alias("lof_flag"),
        ).where(F.col("gene").isin(list(lof_genes)))
        worst = G.expression_proportion(
            parts, inputs.expression, inputs.gene_maximum, severity, dropped_tissues, listed_only=True)
        if folder:
            export_worst(worst, f"{folder}/worst_consequences", overwrite)
        lof = lof.join(worst.select(
            *G.VARIANT, F.col("mean_proportion").alias("worst_csq_mean_proportion"),
            G.tissue_text("by_tissue").alias("worst_csq_pext"), "lof_flag",
        ), list(G.VARIANT), "left")
    if "lift" not in skipped:
        lof = G.lift_variants(lof, inputs.blocks)
    result.lof = lof
    return result


QC_INFO = {
    "AC": ("1", "Integer", "Copies of the alternate allele"), "AN": ("1", "Integer", "Alleles called"),
    "AF": ("1", "Float", "Share of the alternate allele"), "n_hom": ("1", "Integer", "Samples with two copies"),
}


def export_qc_calls(result: GenotypeResult, path: str, overwrite: bool = False) -> None:
    """Call text of all observed variants after genotype and variant QC, in order."""
    calls = result.genotypes.join(result.variants.select(*G.VARIANT), list(G.VARIANT), "left_semi")
    write_vcf(calls, result.variants, path, {k: F.col(k.lower()) for k in QC_INFO}, QC_INFO, overwrite,
              likelihoods="pl" in calls.columns)


def export_worst(worst: DataFrame, path: str, overwrite: bool = False) -> None:
    """Table of each variant's most severe consequence and its expression by tissue."""
    write_tsv(worst.select(
        F.concat_ws(":", "contig", F.col("pos").cast("string"), F.array_join("alleles", ":")).alias("variant"),
        "gene", "csq", "severity_rank", "lof_flag", "mean_proportion", G.tissue_text("by_tissue").alias("by_tissue"),
    ), path, overwrite=overwrite)


def export_filtered(filtered: DataFrame, path: str, overwrite: bool = False) -> None:
    """Gzip table of variants with a consequence on a gene of interest."""
    table = filtered.select(
        F.concat_ws(":", "contig", F.col("pos").cast("string")).alias("locus"),
        F.to_json("alleles").alias("alleles"),
        F.concat_ws(":", "contig", F.col("pos").cast("string"), F.array_join("alleles", ":")).alias("variant"),
        "n_called", "n_not_called",
        F.array(F.col("an") - F.col("ac"), F.col("ac")).alias("AC"),
        F.array(1 - F.col("af"), F.col("af")).alias("AF"),
        "n_non_ref", "n_het",
    )
    write_tsv(table, path, compression="gzip", overwrite=overwrite)


def lof_info(variants: DataFrame) -> dict[str, Column]:
    """INFO fields of the loss-of-function export, those the table has."""
    wanted = {
        "AC": "ac", "AN": "an", "AF": "af", "n_called": "n_called", "n_not_called": "n_not_called",
        "n_non_ref": "n_non_ref", "n_het": "n_het", "n_hom": "n_hom", "CSQ": "csq_text",
        "liftover_37": "lifted_key", "worst_csq_pext": "worst_csq_pext",
        "worst_csq_mean_proportion": "worst_csq_mean_proportion", "lof_flag": "lof_flag",
    }
    return {k: F.col(c) for k, c in wanted.items() if c in variants.columns}


def export_lof_vcf(result: GenotypeResult, path: str, csq_description: str = "Consequence annotations",
                   overwrite: bool = False) -> None:
    calls = result.genotypes.join(result.lof.select(*G.VARIANT), list(G.VARIANT), "left_semi")
    write_vcf(calls, result.lof, path, lof_info(result.lof),
              {"CSQ": (".", "String", csq_description)}, overwrite)
