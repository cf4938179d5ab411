"""Readers for the study's text formats.

``NA`` is null everywhere. Files with bare carriage-return line ends are read
with ``line_sep="\\r"``. Compression follows the file extension; a gzip file is
one split, so readers of possibly large files take ``partitions`` to spread
rows right after the scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierlab.sources import schemas


def _spread(df: DataFrame, partitions: int | None) -> DataFrame:
    return df.repartition(partitions) if partitions else df


def read_delimited(
    spark: SparkSession, path, schema: str, sep: str = "\t", header: bool = True,
    line_sep: str | None = None, comment: str | None = None, quote: str = '"',
    partitions: int | None = None, glob: str | None = None,
) -> DataFrame:
    """Delimited text with a fixed schema; columns are matched by position."""
    reader = spark.read.schema(schema).options(
        sep=sep, header=str(header).lower(), nullValue="NA", quote=quote, escape=quote or "\\",
        enforceSchema="true",
    )
    for name, value in (("lineSep", line_sep), ("comment", comment), ("pathGlobFilter", glob)):
        if value is not None:
            reader = reader.option(name, value)
    return _spread(reader.csv(path), partitions)


def read_named_columns(
    spark: SparkSession, path, columns: Mapping[str, str], sep: str = "\t",
    line_sep: str | None = None, quote: str = '"', partitions: int | None = None,
) -> DataFrame:
    """Delimited text with a header: the listed columns by name, typed.

    Columns the file lacks become null; the header alone is read to find out.
    Nothing else of the file is inferred.
    """
    reader = spark.read.options(
        sep=sep, header="true", nullValue="NA", quote=quote, escape=quote or "\\", inferSchema="false"
    )
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    raw = reader.csv(path)
    picked = [
        (F.trim(F.col(f"`{name}`")).try_cast(kind) if name in raw.columns else F.lit(None).cast(kind))
        .alias(name)
        for name, kind in columns.items()
    ]
    return _spread(raw.select(*picked), partitions)


def read_gene_traits(spark: SparkSession, path, line_sep: str = "\r") -> DataFrame:
    raw = read_delimited(spark, path, schemas.GENE_TRAIT, line_sep=line_sep)
    return raw.select(
        F.col("Gene_name").alias("gene"), F.col("Trait").alias("trait"), F.col("LoF").alias("lof"),
        F.col("pLI").alias("pli"), "has_clinical_submissions",
    )


def read_gene_phenotypes(spark: SparkSession, path, line_sep: str = "\r") -> DataFrame:
    return read_delimited(spark, path, schemas.GENE_PHENOTYPE, line_sep=line_sep)


def read_submissions(spark: SparkSession, path, partitions: int | None = None) -> DataFrame:
    """Submission archive: no header row, leading explanation lines.

    Explanation lines have no integer in the first column, whatever they start
    with, so they are told apart by that. Text is taken as is, without quotes.
    """
    raw = read_delimited(spark, path, schemas.SUBMISSIONS, header=False, quote="", partitions=partitions)
    return raw.withColumn("VariationID", F.col("VariationID").try_cast("int")).where(
        F.col("VariationID").isNotNull()
    ).select(
        F.col("VariationID").alias("variation_id"),
        F.col("submitter_clinical_significance").alias("significance"),
        F.col("submitter_date_last_evaluated").alias("date"),
        F.col("submitter_description").alias("description"),
        F.col("submitted_phenotype_info").alias("submitted_phenotype"),
        F.col("reported_phenotype_info").alias("phenotype"),
        F.col("submitter_review_status").alias("review_status"),
        F.col("submitter_collection_method").alias("method"),
        F.col("submitter_origin_counts").alias("origin_counts"),
        "submitter", F.col("submitterSCV").alias("scv"),
        F.col("submitted_gene_symbol").alias("submitted_gene"),
        F.col("ExplanationOfInterpretation").alias("explanation"),
    )


def read_variant_summary(spark: SparkSession, path, partitions: int | None = None) -> DataFrame:
    raw = read_named_columns(spark, path, schemas.VARIANT_SUMMARY_COLUMNS, quote="", partitions=partitions)
    return raw.withColumnsRenamed({
        "VariationID": "variation_id", "GeneSymbol": "gene", "Assembly": "assembly"})


def read_sites(spark: SparkSession, path) -> DataFrame:
    """Site-only variant archive: ``#`` lines are skipped."""
    return read_delimited(spark, path, schemas.SITES, header=False, comment="#", quote="")


def read_filtered_variants(spark: SparkSession, path) -> DataFrame:
    return read_delimited(spark, path, schemas.FILTERED_VARIANTS, quote="")


def read_gene_intervals(spark: SparkSession, path) -> DataFrame:
    """JSON object gene -> {interval: "chrom:start-end"} to (gene, interval)."""
    raw = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,struct<interval:string>>")
    return raw.select(F.explode(parsed).alias("gene", "_v")).select("gene", "_v.interval")


def read_scores(spark: SparkSession, path, id_column: str = "IID", score_column: str = "SCORE") -> DataFrame:
    """Whitespace-delimited score file with a header line.

    The header names are read from the first line; header lines of further
    files fall out because their score is not a number.
    """
    lines = spark.read.text(path)
    header = spark.read.text(path).where(F.trim("value") != "").first()["value"].split()
    fields = F.split(F.trim("value"), r"\s+")
    at = {name: i + 1 for i, name in enumerate(header)}
    return lines.select(
        F.try_element_at(fields, F.lit(at[id_column])).alias("subject"),
        F.try_element_at(fields, F.lit(at[score_column])).try_cast("double").alias("score"),
    ).where(F.col("score").isNotNull())


def read_id_list(spark: SparkSession, path, name: str = "id", glob: str | None = None) -> DataFrame:
    """Headerless single-column list; with ``glob`` all matching files of a folder."""
    return read_delimited(spark, path, f"{name} string", header=False, glob=glob)


def read_associations(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Association results of several cohorts, tagged and stacked."""
    from carrierlab.operators.associations import tag_and_stack

    return tag_and_stack({
        name: read_named_columns(spark, path, {
            c.split(" ")[0]: c.split(" ")[1] for c in schemas.ASSOCIATIONS.split(", ")
        })
        for name, path in paths.items()
    })


def read_carriers(spark: SparkSession, path) -> DataFrame:
    raw = read_named_columns(spark, path, {
        "SubjectID": "string", "Variant": "string", "Gene": "string", "ClinVarOrLOF": "string"})
    return raw.toDF("subject", "variant", "gene", "evidence")


def read_curated(spark: SparkSession, path, line_sep: str = "\r") -> DataFrame:
    """Curated variants: key on both builds where present, level, notes."""
    raw = read_named_columns(spark, path, schemas.LOF_CURATED_COLUMNS, line_sep=line_sep)
    out = raw.toDF("variant", "variant_b37", "gene", "level", "notes").drop("gene")
    return out.withColumn("variant_b37", F.coalesce("variant_b37", "variant"))


def read_clinvar_curated(spark: SparkSession, path, line_sep: str | None = None) -> DataFrame:
    raw = read_named_columns(spark, path, {
        "Variant": "string", "Variant_b37": "string", "Level": "string", "Notes": "string",
        "Traits": "string", "VariationID": "int", "AlleleID": "int", "LastEvaluated": "string",
        "high_confidence_lab_2017_clinical_significance": "string",
    }, line_sep=line_sep)
    return raw.toDF(
        "variant", "variant_b37", "level", "notes", "traits", "variation_id", "allele_id",
        "last_evaluated", "high_confidence_significance",
    ).withColumn("variant_b37", F.coalesce("variant_b37", "variant"))


def read_frequencies(spark: SparkSession, path, ac: str = "gnomad_exomes_AC") -> DataFrame:
    from carrierlab.operators.cohort import frequency_table

    return frequency_table(read_named_columns(spark, path, schemas.FREQUENCIES_COLUMNS, quote=""), ac)
