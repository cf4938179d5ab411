"""Which samples may be used: from raw lists to the two prepared files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carrierlab.operators import cohort as H
from carrierlab.sources.sinks import write_tsv


def _strings(spark: SparkSession, path, sep: str) -> DataFrame:
    """All columns as text, so that every column is passed on unchanged."""
    return spark.read.options(sep=sep, header="true", nullValue="NA", inferSchema="false").csv(path)


def prepare(
    spark: SparkSession, phenotypes: str, forbidden: str, exome: str, folder: str | None = None
) -> dict[str, DataFrame]:
    """Usable phenotype rows, flagged exome samples, and overlaps before and after.

    ``phenotypes`` is the unfiltered comma-separated file with ``combined_id,
    id_55k, COHORT``; ``forbidden`` has ``Individual.ID``; ``exome`` has ``s``.
    With ``folder`` the two tables are written as tab-separated text.
    """
    raw, samples = _strings(spark, phenotypes, ","), _strings(spark, exome, "\t").select("s")
    banned = _strings(spark, forbidden, "\t")
    ids = samples.withColumnRenamed("s", "combined_id")
    # usable and sequenced; the second report counts usable rows before the latter
    allowed = H.usable_phenotypes(raw, banned, raw.select("combined_id"), exome_id="combined_id")
    usable = H.usable_phenotypes(raw, banned, samples)
    out = {
        "phenotypes": usable.select(*raw.columns),
        "samples": H.sample_flags(samples, usable),
        "overlap_before": H.overlap_report(raw, ids, "combined_id"),
        "overlap_after": H.overlap_report(allowed, ids, "combined_id"),
    }
    if folder:
        write_tsv(out["phenotypes"], f"{folder}/phenotypes")
        write_tsv(out["samples"], f"{folder}/samples_to_keep")
    return out
