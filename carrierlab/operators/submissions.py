"""Clinical submissions: which variants do laboratories call pathogenic.

A few variants collect a large share of all submissions. Submissions are
therefore always reduced to one row per variant *before* they meet another
table, and group-level rules are applied by a semi-join against the reduced
ids rather than by a window that would sort a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions.columns import (
    alt_count, any_or_null, as_col, info_field, is_true, level_in, member, parse_us_date,
    variant_key,
)
from carrierlab.functions.order import row_numbers

CLINICAL = "clinical testing"


def is_clinical(method: str | Column = "submitter_collection_method") -> Column:
    return as_col(method).contains(CLINICAL)


def keep_groups_with(df: DataFrame, keys: Sequence[str], cond: Column) -> DataFrame:
    """Every row of a group in which any row meets the condition."""
    matching = df.where(cond).select(*keys).distinct()
    return df.join(matching, list(keys), "left_semi")


def gene_trait_text(gene_traits: DataFrame, gene: str = "gene", trait: str = "trait") -> DataFrame:
    """One row per gene with its traits joined in sorted order."""
    return gene_traits.groupBy(gene).agg(
        F.concat_ws(", ", F.sort_array(F.collect_list(trait))).alias("traits")
    )


def submitter_ranking(
    submissions: DataFrame, submitter: str = "submitter", date: str = "date",
    min_submissions: int = S.HIGH_VOLUME_MIN_SUBMISSIONS, since: str = S.HIGH_VOLUME_SINCE,
    ordered: bool = True,
) -> DataFrame:
    """Submitters with many submissions and a recent one, largest first."""
    ranked = (
        submissions.groupBy(submitter)
        .agg(F.count(F.lit(1)).alias("n_submissions"), F.max(date).alias("last_evaluated"))
        .where((F.col("n_submissions") > min_submissions)
               & (F.col("last_evaluated") >= F.lit(since).cast("date")))
    )
    return ranked.orderBy(F.desc("n_submissions"), submitter) if ordered else ranked


def submission_counts(
    submissions: DataFrame, variation: str = "variation_id", significance: str = "significance",
    method: str = "method", levels: Iterable[str] = S.CLINVAR_PATH_LEVELS,
) -> DataFrame:
    """Per variant: submissions and path submissions in total and by method.

    A null method belongs to neither side, so the sides need not add up.
    """
    path, clinic = level_in(significance, levels), is_clinical(method)

    def number(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return submissions.groupBy(variation).agg(
        F.count(F.lit(1)).alias("n_all"),
        number(clinic).alias("n_clinic"),
        number(~clinic).alias("n_no_clinic"),
        number(path).alias("path_all"),
        number(path & clinic).alias("path_clinic"),
        number(path & ~clinic).alias("path_no_clinic"),
    )


def gene_submission_summary(
    variants: DataFrame, submissions: DataFrame, variation: str = "variation_id",
    gene: str = "gene", significance: str = "significance", method: str = "method",
    phenotype: str = "phenotype", levels: Iterable[str] = S.CLINVAR_PATH_LEVELS,
) -> DataFrame:
    """Submissions, variants and path submissions per gene and kind of method.

    ``variants`` holds the rows of the wanted genes, assembly and significance.
    The rule "keep variants with a path submission" is re-applied inside each
    kind. A gene absent from a kind gets null, not 0.
    """
    counts = submission_counts(submissions, variation, significance, method, levels)
    joined = variants.select(variation, gene).join(
        counts.where(F.col("path_all") > 0), variation
    )

    def total(value: str, path: str) -> Column:
        return F.nullif(F.sum(F.when(F.col(path) > 0, F.col(value)).otherwise(0)), F.lit(0))

    def distinct_variants(path: str) -> Column:
        return F.nullif(
            F.count_distinct(F.when(F.col(path) > 0, F.col(variation))), F.lit(0)
        )

    kinds = ("all", "clinic", "no_clinic")
    per_gene = joined.groupBy(gene).agg(
        *[total(f"n_{k}", f"path_{k}").alias(f"submissions_{k}") for k in kinds],
        *[distinct_variants(f"path_{k}").alias(f"variants_{k}") for k in kinds],
        *[total(f"path_{k}", f"path_{k}").alias(f"path_submissions_{k}") for k in kinds],
    )
    wanted = is_true(level_in(significance, levels) & is_clinical(method))
    reported = (
        submissions.where(wanted).select(variation, phenotype).distinct()
        .join(variants.select(variation, gene).distinct(), variation)
        .groupBy(gene)
        .agg(F.concat_ws(", ", F.array_sort(F.collect_set(phenotype))).alias("clinical_path_phenotypes"))
    )
    return per_gene.join(reported, gene, "left")


def site_positions(sites: DataFrame) -> DataFrame:
    """Site rows of a variant archive: contig with prefix, ids, alleles."""
    return sites.select(
        F.concat(F.lit("chr"), "CHROM").alias("chr"),
        F.col("POS").alias("pos"), F.col("ID").alias("variation_id"),
        F.col("REF").alias("ref"), F.col("ALT").alias("alt"),
        info_field("INFO", "ALLELEID").alias("allele_id"),
    )


def observed_counts(filtered_variants: DataFrame) -> DataFrame:
    """Call counts of the study's own variants, alternate count as integer."""
    return filtered_variants.select(
        "variant", "n_called", "n_not_called", alt_count("AC").alias("ac"), "AF", "n_het"
    )


def reported_submissions(
    summary: DataFrame, sites: DataFrame, submissions: DataFrame, observed: DataFrame,
    gene_traits: DataFrame, assembly: str, keep_traits: Sequence[str] = ("Lipodystrophy", "Neonatal Diabetes"),
    levels: Iterable[str] = S.CLINVAR_PATH_LEVELS,
) -> DataFrame:
    """Submissions of observed, reportedly pathogenic variants in listed genes.

    Clinical submissions are kept, and all submissions of genes whose traits
    include one of ``keep_traits``; the rule "variant has a path submission"
    holds before and after that choice. Both rules are read off one count per
    variant, so submissions are joined once.
    """
    traits = gene_trait_text(gene_traits)
    variants = (
        summary.where((F.col("ClinSigSimple") == 1) & (F.col("assembly") == assembly))
        .join(sites, "variation_id")
        .withColumn("variant_str", variant_key("chr", "pos", "ref", "alt", sep=":"))
        .join(traits, "gene")
    )
    exempt = F.lit(False)
    for trait in keep_traits:
        exempt = exempt | F.col("traits").contains(trait)
    counts = submission_counts(submissions, levels=levels).where(F.col("path_all") > 0)
    kept = (
        variants.join(counts.select("variation_id", "path_clinic"), "variation_id")
        .where(exempt | (F.col("path_clinic") > 0)).drop("path_clinic")
        .join(
            observed.where(F.col("ac") > 0).select(
                F.col("variant").alias("variant_str"), "n_called", "n_not_called", "ac", "AF", "n_het"
            ),
            "variant_str",
        )
    )
    return submissions.join(kept, "variation_id").where(is_true(is_clinical("method")) | exempt)


def reported_variants(reported: DataFrame) -> DataFrame:
    """The distinct variants behind :func:`reported_submissions`."""
    return reported.select(
        "variation_id", "gene", "chr", "pos", "ref", "alt", "HGNC_ID", "traits",
        "variant_str", "n_called", "n_not_called", "ac", "AF", "n_het",
    ).distinct()


def recent_high_confidence(
    submitter: str | Column = "submitter", date: str | Column = "date",
    labs: Iterable[str] = S.HIGH_CONFIDENCE_LABS, since: str = S.HIGH_VOLUME_SINCE,
) -> Column:
    """Listed laboratory and recent; null when listed but undated."""
    return member(submitter, labs) & (as_col(date) >= F.lit(since).cast("date"))


def high_confidence_flags(
    submissions: DataFrame, labs: Iterable[str] = S.HIGH_CONFIDENCE_LABS,
    since: str = S.HIGH_VOLUME_SINCE, levels: Iterable[str] = S.CLINVAR_PATH_LEVELS,
    variation: str = "variation_id",
) -> DataFrame:
    """Per variant: high-confidence flags over annotated clinical submissions.

    ``submissions``: variation id, submitter, date, significance,
    clarification, correct_phenotype. Only variants with a correct-phenotype
    path submission remain. Equal significances are counted before they are
    joined to text, so a variant with very many submissions moves few rows.
    """
    recent = recent_high_confidence("submitter", "date", labs, since)
    marked = submissions.select(
        variation, "significance", "correct_phenotype",
        recent.alias("_recent"),
        is_true(recent & (F.col("clarification") == "No Information")).alias("_unspecified"),
        level_in("significance", levels).alias("_path"),
    )
    right = F.col("correct_phenotype") == F.lit(True)
    counted = marked.groupBy(variation, "significance").agg(
        F.bool_or("_unspecified").alias("_unspecified"),
        F.count(F.when(right, 1)).alias("_n"),
        F.bool_or(F.when(right, F.col("_path"))).alias("_path"),
        F.bool_or(F.when(right, F.col("_recent"))).alias("_any_recent"),
        F.count(F.when(right & F.col("_recent").isNull(), 1)).alias("_unknown"),
        F.count(F.when(right & F.col("_recent"), 1)).cast("int").alias("_n_recent"),
    )
    kept = F.sort_array(F.collect_list(
        F.when((F.col("_n_recent") > 0) & F.col("significance").isNotNull(),
               F.struct("significance", "_n_recent"))
    ))
    return (
        counted.groupBy(variation).agg(
            F.bool_or("_unspecified").alias("flag_hc_lab_unspecified_phenotype"),
            F.sum("_n").alias("n_submissions"),
            F.bool_or("_path").alias("_has_path"),
            F.when(F.bool_or("_any_recent"), F.lit(True))
            .when(F.sum("_unknown") > 0, F.lit(None).cast("boolean"))
            .otherwise(F.lit(False)).alias("high_confidence_any"),
            F.concat_ws(", ", F.flatten(F.transform(
                kept, lambda e: F.array_repeat(e["significance"], e["_n_recent"])
            ))).alias("high_confidence_significance"),
        )
        .where(is_true(F.col("_has_path")))
        .drop("_has_path")
    )


def submission_report(
    submissions: DataFrame, labs: Iterable[str] = S.HIGH_CONFIDENCE_LABS, since: str = S.HIGH_VOLUME_SINCE,
    levels: Iterable[str] = S.CLINVAR_PATH_LEVELS, variation: str = "variation_id",
) -> DataFrame:
    """Annotated clinical submissions of the curated variants, newest first inside a variant.

    Takes what :func:`annotated_pathogenic` takes and keeps the submissions
    with the right phenotype of variants that have a path one among them. Adds
    ``high_confidence`` (this row is from a listed laboratory and recent; null
    when listed but undated), the variant's flags, and ``place``: 1, 2, ...
    inside the variant by falling date, undated ones last; rows of one date are
    ordered by their other columns. A variant with very many submissions is
    ordered in several tasks.
    """
    clinical = submissions.where(is_true(is_clinical("method"))).withColumn("date", parse_us_date("date"))
    flags = high_confidence_flags(clinical, labs, since, levels, variation)
    rows = clinical.where(F.col("correct_phenotype") == F.lit(True)).withColumn(
        "high_confidence", recent_high_confidence("submitter", "date", labs, since))
    rest = [c for c in submissions.columns if c not in (variation, "date")]
    ordered = row_numbers(
        rows.join(flags.select(variation).distinct(), variation, "left_semi"), [variation],
        [F.desc_nulls_last("date"), *rest], "place")
    return ordered.join(flags, variation)


def annotated_pathogenic(
    submissions: DataFrame, observed: DataFrame, labs: Iterable[str] = S.HIGH_CONFIDENCE_LABS,
    since: str = S.HIGH_VOLUME_SINCE, levels: Iterable[str] = S.CLINVAR_PATH_LEVELS,
    allele_link: str | None = None,
) -> DataFrame:
    """Re-filter manually annotated submissions to one row per curated variant.

    ``submissions`` adds the variant columns (allele_id, type, name, gene,
    last_evaluated, phenotype_list, number_submitters, chr, pos, ref, alt,
    traits, n_called, n_not_called, ac, n_het) and a collection ``method``.
    With ``allele_link``, a prefix, there is a second link of that name: the
    prefix followed by the variant's key.
    """
    clinical = submissions.where(is_true(is_clinical("method"))).withColumn(
        "date", parse_us_date("date")
    )
    flags = high_confidence_flags(clinical, labs, since, levels)
    columns = [
        "variation_id", "allele_id", "type", "name", "gene", "last_evaluated", "phenotype_list",
        "number_submitters", "chr", "pos", "ref", "alt", "traits", "n_called", "n_not_called",
        "ac", "n_het",
    ]
    variants = clinical.where(F.col("correct_phenotype") == F.lit(True)).select(*columns).distinct()
    key = variant_key("chr", "pos", "ref", "alt")
    out = (
        variants.join(flags.drop("n_submissions"), "variation_id")
        .withColumn("variant_str", variant_key("chr", "pos", "ref", "alt", sep=":"))
        .withColumn("variant", key)
        .withColumn("clinvar_link", F.concat(
            F.lit("https://www.ncbi.nlm.nih.gov/clinvar/variation/"), F.col("variation_id").cast("string")))
        .join(observed.select(F.col("variant").alias("variant_str")).distinct(), "variant_str", "left_semi")
    )
    return out if allele_link is None else out.withColumn("allele_link", F.concat(F.lit(allele_link), "variant"))


def flag_any(df: DataFrame, keys: Sequence[str], cond: Column, out: str) -> DataFrame:
    """Per group: true, null (no true but an unknown) or false."""
    return df.groupBy(*keys).agg(any_or_null(cond).alias(out))
