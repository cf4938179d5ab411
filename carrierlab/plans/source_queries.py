"""Queries: files written and read back.

Each query renders given tables to a file format in the shared folder, a folder
for each run, reads the files back and returns what they hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carrierlab.functions.columns import info_field
from carrierlab.functions.order import numbered_lines
from carrierlab.operators import genotypes as G
from carrierlab.operators import submissions as B
from carrierlab.plans import genotype_study as study
from carrierlab.plans import submission_study
from carrierlab.plans import views as V
from carrierlab.plans.registry import query, rounded
from carrierlab.plans.variant_queries import FLAGS_SQL, LABS, LAB_SQL
from carrierlab.session import shared_folder
from carrierlab.sources.vcf import read_genotypes


def _new_folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4()}"


_CALLS_SQL = """WITH called_sites AS (
      SELECT contig, pos, count(called) AS n, count(*) FILTER (WHERE called = 1) AS het, count(*) FILTER (WHERE called = 2) AS hom
      FROM qc_calls GROUP BY contig, pos),
    kept AS (SELECT *, row_number() OVER (ORDER BY CASE contig WHEN 'chrX' THEN 1000 ELSE CAST(substr(contig, 4) AS INTEGER) END, pos) AS line
      FROM called_sites WHERE het + hom > 0)"""


@query(_CALLS_SQL + """
    SELECT line, contig, pos, CAST(het + 2 * hom AS INTEGER) AS ac, CAST(2 * n AS INTEGER) AS an,
      round((het + 2 * hom) / (2 * n)::DOUBLE, 6) AS af, CAST(hom AS INTEGER) AS n_hom,
      (SELECT count(DISTINCT sample) FROM call_sheet) AS n_columns FROM kept""")
def qc_call_export(spark, d):
    """Lines of the call text exported after QC, with their place over all files."""
    folder = _new_folder(spark)
    study.run(study.GenotypeInputs(V.call_sheet(spark, d)), folder=folder)
    parts = F.split("value", "\t")
    lines = numbered_lines(spark, f"{folder}/qc_calls/data").select("line", parts.alias("f"))
    info = F.get("f", F.lit(7))
    return lines.select(
        "line", F.get("f", F.lit(0)).alias("contig"), F.get("f", F.lit(1)).cast("int").alias("pos"),
        info_field(info, "AC").cast("int").alias("ac"), info_field(info, "AN").cast("int").alias("an"),
        rounded(info_field(info, "AF"), name="af"), info_field(info, "n_hom").cast("int").alias("n_hom"),
        (F.size("f") - 9).cast("long").alias("n_columns"))


@query(_CALLS_SQL + """
    SELECT contig, pos, sample, CASE called WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' END AS call,
      ref_reads, alt_reads, dp, quality AS gq, array_to_string(pl, ',') AS pl
    FROM qc_calls JOIN kept USING (contig, pos)""")
def qc_calls_read_back(spark, d):
    """Every call of the export, read back by this library's own reader; samples without a call left out."""
    folder = _new_folder(spark)
    study.run(study.GenotypeInputs(V.call_sheet(spark, d)), folder=folder)
    calls = read_genotypes(spark, [f"{folder}/qc_calls/header", f"{folder}/qc_calls/data"])
    return calls.where("dp IS NOT NULL").select(
        "contig", "pos", "sample", F.array_join(F.transform("gt", lambda a: a.cast("string")), "/").alias("call"),
        F.get("ad", F.lit(0)).alias("ref_reads"), F.get("ad", F.lit(1)).alias("alt_reads"), "dp", "gq",
        F.array_join(F.transform("pl", lambda a: a.cast("string")), ",").alias("pl"))


_CLINICAL = "WHERE method LIKE '%clinical testing%'"
_REPORT_SQL = f"""WITH flags AS ({FLAGS_SQL.replace("__WHERE__", _CLINICAL)}),
    rows AS (SELECT *, CASE WHEN NOT {LAB_SQL} THEN false ELSE date >= DATE '1997-01-01' END AS high_confidence
      FROM submissions {_CLINICAL} AND correct_phenotype AND variation_id IN (SELECT variation_id FROM flags)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY variation_id ORDER BY date DESC NULLS LAST, lab_id NULLS FIRST,
      submitter NULLS FIRST, significance NULLS FIRST, method NULLS FIRST, phenotype NULLS FIRST,
      clarification NULLS FIRST) AS place FROM rows)"""


def _annotated(spark, d):
    return V.submissions(spark, d).withColumn("date", F.date_format("date", "MMM dd, yyyy"))


@query(_REPORT_SQL + """ SELECT variation_id, place, date, submitter, significance, phenotype, high_confidence,
      flag_hc_lab_unspecified_phenotype, high_confidence_any, high_confidence_significance
    FROM placed JOIN flags USING (variation_id)""")
def submission_report(spark, d):
    """Submissions of the curated variants, newest first, with their place in the variant."""
    return B.submission_report(_annotated(spark, d), LABS, "1997-01-01").select(
        "variation_id", "place", "date", "submitter", "significance", "phenotype", "high_confidence",
        "flag_hc_lab_unspecified_phenotype", "high_confidence_any", "high_confidence_significance")


@query(_REPORT_SQL + """ SELECT row_number() OVER (ORDER BY variation_id, place) AS line, CAST(variation_id AS VARCHAR) AS variation,
      CAST(place AS VARCHAR) AS place, submitter, coalesce(CAST(high_confidence AS VARCHAR), 'NA') AS high_confidence FROM placed""")
def submission_report_written(spark, d):
    """The submission file as written: its lines, in their order over all part files."""
    sites = B.site_positions(V.archive_sites(spark, d))
    fixed = {c: F.lit(None).cast("string") for c in (
        "type", "name", "gene", "last_evaluated", "phenotype_list", "traits")} | {
        c: F.lit(1) for c in ("number_submitters", "n_called", "n_not_called", "ac", "n_het")}
    annotated = _annotated(spark, d).join(sites, "variation_id").withColumns(fixed)
    observed = B.observed_counts(V.observed_variants(spark, d))
    files = submission_study.write_refiltered(
        annotated, observed, _new_folder(spark), "https://example.org/variant/", labs=LABS, since="1997-01-01")
    found = spark.read.csv(files["submissions"], header=True)
    names = [c.lstrip("\ufeff") for c in found.columns]
    written = numbered_lines(spark, files["submissions"])
    lines = written.where(~F.col("value").contains("variation_id"))
    at = {c: names.index(c) for c in ("variation_id", "place", "submitter", "high_confidence")}
    parts = F.split("value", ",")
    # Every part file begins with a header line, which counts in the line numbers.
    heads = written.where(F.col("value").contains("variation_id")).select(
        "file", F.row_number().over(Window.orderBy("line")).alias("heads"))  # a row for each file
    return lines.join(heads, "file").select(
        (F.col("line") - F.col("heads")).alias("line"), F.get(parts, F.lit(at["variation_id"])).alias("variation"),
        F.get(parts, F.lit(at["place"])).alias("place"), F.get(parts, F.lit(at["submitter"])).alias("submitter"),
        F.get(parts, F.lit(at["high_confidence"])).alias("high_confidence"))
