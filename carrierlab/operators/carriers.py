"""Who is a carrier: the step under every penetrance and mean table.

Carrier rows are first reduced to one row per (subject, cohort, trait); that
reduction combines partially, so neither a trait nor a subject with very many
rows lands in one task. The reduced rows then become one small array per
subject (one entry per trait), and phenotypes are joined once for all traits.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions.columns import (
    distinct_sorted_text, frequency_band, is_true, level_in, rename_evidence,
)

SUBJECT = ("subject", "cohort")
CARRIER, NON_CARRIER, VUS = "Carrier", "Non Carrier", "VUS"


def _relevant(carriers: DataFrame, gene_traits: DataFrame | None, traits: Sequence[str]) -> DataFrame:
    """Carrier rows of wanted traits on genes listed for that trait."""
    rows = carriers.where(F.col("trait").isin(list(traits)))
    if gene_traits is None:
        return rows
    return rows.join(gene_traits.select("gene", "trait").distinct(), ["gene", "trait"], "left_semi")


def carrier_status(
    carriers: DataFrame, gene_traits: DataFrame | None, traits: Sequence[str],
    levels: Iterable[str] = S.PATH_LEVELS, by_gene: bool = True, with_evidence: bool = False,
    prefer_levels: bool = False,
) -> DataFrame:
    """One row per (subject, cohort, trait) that has any carrier row.

    ``is_carrier`` and ``has_vus`` look at levels. With ``by_gene`` the row
    with the lowest allele frequency (unknown last; ties by variant, level,
    evidence) gives ``gene, variant, level, af, ac``; all levels compete
    unless ``prefer_levels`` puts the carrier levels first. ``evidence`` merges
    the types seen for that variant.
    """
    rows = _relevant(carriers, gene_traits, traits)
    keys = [*SUBJECT, "trait"]
    is_path = level_in("level", levels)
    flags = [
        F.bool_or(is_path).alias("is_carrier"),
        F.bool_or(level_in("level", ["vus"])).alias("has_vus"),
    ]
    if not by_gene and not with_evidence:
        return rows.groupBy(*keys).agg(*flags)

    if with_evidence:
        # Evidence types per variant first: the vocabulary has a few values.
        per_variant = rows.groupBy(*keys, "variant").agg(
            *flags,
            rename_evidence(distinct_sorted_text("evidence")).alias("evidence"),
            F.min(_best_row(is_path, prefer_levels)).alias("_best"),
        )
        flags = [F.bool_or("is_carrier").alias("is_carrier"), F.bool_or("has_vus").alias("has_vus")]
        best = F.min(F.struct("_best", "evidence"))
        return per_variant.groupBy(*keys).agg(*flags, best.alias("_pick")).select(
            *keys, "is_carrier", "has_vus", "_pick._best.gene", "_pick._best.variant",
            "_pick._best.level", "_pick._best.af", "_pick._best.ac", "_pick.evidence",
        )
    return rows.groupBy(*keys).agg(*flags, F.min(_best_row(is_path, prefer_levels)).alias("_best")).select(
        *keys, "is_carrier", "has_vus", "_best.gene", "_best.variant", "_best.level",
        "_best.af", "_best.ac",
    )


def _best_row(is_path: Column, prefer_levels: bool) -> Column:
    """Struct whose minimum is the row to keep."""
    first = [(~is_path).alias("_other")] if prefer_levels else []
    return F.struct(
        *first, F.col("af").isNull().alias("_no_af"), "af", "variant", "level", "evidence", "gene", "ac"
    )


def carrier_label(
    is_carrier: Column, has_vus: Column, vus: str = "ignore"
) -> Column:
    """Carrier text; non-carriers with an uncertain variant by ``vus``.

    ``ignore`` labels them Non Carrier, ``remove`` null, ``stratify`` VUS.
    """
    if vus not in ("ignore", "remove", "stratify"):
        raise ValueError(f"vus must be ignore, remove or stratify, not {vus!r}")
    label = F.when(is_true(is_carrier), F.lit(CARRIER))
    if vus != "ignore":
        label = label.when(is_true(has_vus), F.lit(VUS if vus == "stratify" else None))
    return label.otherwise(F.lit(NON_CARRIER))


def annotate_carriers(
    pheno: DataFrame, carriers: DataFrame, gene_traits: DataFrame | None, trait: str,
    levels: Iterable[str] = S.PATH_LEVELS, vus: str = "ignore", by_gene: bool = False,
    prefer_levels: bool = False,
) -> DataFrame:
    """Phenotype rows with carrier label, evidence and frequency for one trait.

    One row per (subject, cohort). With ``by_gene`` carriers also get the gene
    of their lowest-frequency variant. With ``vus="stratify"`` the VUS label
    carries its frequency band and ``carrier_simple`` keeps the plain label.
    """
    status = carrier_status(
        carriers, gene_traits, [trait], levels, with_evidence=True, prefer_levels=prefer_levels
    ).drop("trait", "variant", "level")
    label = carrier_label(F.col("is_carrier"), F.col("has_vus"), vus)
    out = pheno.join(status, list(SUBJECT), "left").withColumn("carrier", label)
    if by_gene:
        out = out.withColumn(
            "gene", F.when(F.col("carrier") == NON_CARRIER, NON_CARRIER).otherwise(F.col("gene"))
        )
    else:
        out = out.drop("gene")
    out = out.withColumn("evidence", F.coalesce("evidence", F.lit(""))).drop("is_carrier", "has_vus")
    if vus == "stratify":
        out = (
            out.withColumn("af_group", frequency_band("af", "ac"))
            .withColumn("carrier_simple", F.col("carrier"))
            .withColumn("carrier", F.when(
                F.col("carrier") == VUS, F.concat_ws(" ", "carrier", "af_group")
            ).otherwise(F.col("carrier")))
        )
    return out.withColumn("trait", F.lit(trait))


def annotate_every_variant(
    pheno: DataFrame, carriers: DataFrame, gene_traits: DataFrame | None, trait: str,
    levels: Iterable[str] = S.PATH_LEVELS, vus: str = "ignore",
) -> DataFrame:
    """As :func:`annotate_carriers`, but every carrier row is kept (no collapse)."""
    rows = _relevant(carriers, gene_traits, [trait]).drop("trait")
    status = carrier_status(carriers, gene_traits, [trait], levels, by_gene=False).drop("trait")
    labelled = (
        pheno.join(status, list(SUBJECT), "left")
        .withColumn("carrier", carrier_label(F.col("is_carrier"), F.col("has_vus"), vus))
    )
    # Subjects with and without rows apart: an inner join can be split on
    # either side when one subject holds very many rows, a left join cannot.
    seen = F.col("is_carrier").isNotNull()
    with_rows = labelled.where(seen).drop("is_carrier", "has_vus").join(rows, list(SUBJECT))
    without = labelled.where(~seen).drop("is_carrier", "has_vus")
    return with_rows.unionByName(without, allowMissingColumns=True).withColumn("trait", F.lit(trait))


def with_status_by_trait(
    pheno: DataFrame, carriers: DataFrame, gene_traits: DataFrame | None, traits: Sequence[str],
    levels: Iterable[str] = S.PATH_LEVELS, by_gene: bool = False,
) -> DataFrame:
    """Phenotypes with ``_status``: trait -> (is_carrier, has_vus, gene, af, ac).

    One map per subject, at most one entry per wanted trait.
    """
    status = carrier_status(carriers, gene_traits, traits, levels, by_gene=True) if by_gene else (
        carrier_status(carriers, gene_traits, traits, levels, by_gene=False)
    )
    fields = ["is_carrier", "has_vus"] + (["gene", "af", "ac"] if by_gene else [])
    per_subject = status.groupBy(*SUBJECT).agg(
        F.map_from_entries(F.collect_list(F.struct("trait", F.struct(*fields)))).alias("_status")
    )
    return pheno.join(per_subject, list(SUBJECT), "left")


def status_of(trait: str | Column) -> Column:
    """Status entry of a trait, null when the subject has no carrier row."""
    return F.try_element_at("_status", F.lit(trait) if isinstance(trait, str) else trait)
