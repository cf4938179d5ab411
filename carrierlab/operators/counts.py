"""Count tables over carriers, variants and participants."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions.columns import (
    distinct_sorted_text, level_in, level_rank, member, recode,
)
from carrierlab.operators.penetrance import spread, transpose

REVIEWED = "ClinVar and Reviews"


def core_genes_of_extended(genes: Iterable[str] = S.CORE_MODY_GENES) -> Column:
    """True for rows listed under the extended trait only because of core genes."""
    return (F.col("trait") == "MODY Extended") & F.col("gene").isin(list(genes))


def merged_reviews(col: str = "evidence") -> Column:
    return F.when(F.col(col).isin("Review", "ClinVar"), REVIEWED).otherwise(F.col(col))


def variant_count_table(
    carriers: DataFrame, types: Sequence[str] = (REVIEWED, "LOF"), variant: str = "variant_b37"
) -> DataFrame:
    """Distinct variants per cohort and evidence type, with totals.

    Distinct variants cannot be added up across groups. Each variant is
    reduced to the cells it occurs in, once per cohort and once over both, and
    the cells are counted; two partial aggregations, no repeated scan.
    """
    seen = carriers.select("cohort", merged_reviews().alias("evidence"), variant)
    flags = [F.bool_or(F.col("evidence") == t).alias(f"_t{i}") for i, t in enumerate(types)]
    per_cohort = seen.groupBy(variant, "cohort").agg(*flags)
    both = per_cohort.groupBy(variant).agg(
        *[F.bool_or(f"_t{i}").alias(f"_t{i}") for i in range(len(types))]
    ).withColumn("cohort", F.lit("Both"))
    return per_cohort.unionByName(both).groupBy("cohort").agg(
        *[F.nullif(F.count(F.when(F.col(f"_t{i}"), 1)), F.lit(0)).alias(t) for i, t in enumerate(types)],
        F.count(F.lit(1)).alias("total"),
    )


def curated_and_path_counts(carriers: DataFrame, types: Sequence[str] = (REVIEWED, "LOF")) -> DataFrame:
    """Variant counts of all curated and of path-level variants side by side."""
    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select("cohort", *[F.col(c).alias(f"{c} {suffix}") for c in df.columns[1:]])

    curated = renamed(variant_count_table(carriers, types), "curated")
    path = renamed(
        variant_count_table(carriers.where(level_in("level", S.PATH_LEVELS)), types), "pathogenic"
    )
    return curated.join(path, "cohort", "left")


def carrier_count_by_condition(
    pheno: DataFrame, carriers: DataFrame, traits: Sequence[str] = S.TRAIT_ORDER
) -> DataFrame:
    """Distinct variants and carriers per cohort and trait, as share of the cohort."""
    sizes = pheno.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_cohort"))
    used = carriers.where(~F.coalesce(core_genes_of_extended(), F.lit(False)) & member("trait", traits))
    counts = used.groupBy("cohort", "trait").agg(
        F.count_distinct("variant").alias("number_variants"),
        F.count_distinct("subject").alias("number_carriers"),
    )
    return counts.join(sizes, "cohort", "left").select(
        "cohort", "trait", "number_variants", "number_carriers",
        (F.col("number_carriers") / F.col("n_cohort") * 100).alias("percent_carriers"),
    )


def in_trait_order(table: DataFrame, traits: Sequence[str] = S.TRAIT_ORDER) -> DataFrame:
    return table.orderBy(level_rank("trait", traits), *[c for c in table.columns if c == "cohort"])


def cohorts_side_by_side(table: DataFrame, cohorts: Sequence[str]) -> DataFrame:
    return spread(
        table, ["trait"], "cohort", cohorts,
        ["number_variants", "number_carriers", "percent_carriers"],
    )


def final_variant_table(
    carriers: DataFrame, cohorts: Sequence[str], assessments: DataFrame | None = None,
    key_cohort: str | None = None, annotations: Sequence[str] = (),
) -> DataFrame:
    """One row per variant, trait, evidence and level with rows per cohort.

    Notes of all cohorts are merged, distinct and sorted. ``key_cohort`` adds
    that cohort's own variant key.
    """
    keys = ["variant_b37", "trait", "evidence", "gene", *annotations, "level"]
    rows = carriers.withColumn("level", F.lower("level")).withColumn(
        "level", F.when(F.col("level").isin(list(S.ALL_LEVELS)), F.col("level"))
    ).where(~F.coalesce(core_genes_of_extended() | (F.col("trait") == "MonogenicDM_all"), F.lit(False)))
    # Equal notes are folded before the texts of a variant come together.
    per_note = rows.groupBy(*keys, "notes").agg(
        *[F.count(F.when(F.col("cohort") == c, 1)).alias(f"_n{i}") for i, c in enumerate(cohorts)]
    )
    table = per_note.groupBy(*keys).agg(
        distinct_sorted_text("notes").alias("notes"),
        *[F.nullif(F.sum(f"_n{i}"), F.lit(0)).alias(c) for i, c in enumerate(cohorts)],
    ).withColumnRenamed("evidence", "variant_type")
    if assessments is not None:
        table = table.join(assessments, ["variant_b37", "variant_type"], "left")
    if key_cohort is not None:
        own = carriers.where(F.col("cohort") == key_cohort).select("variant_b37", "variant").distinct()
        table = table.join(own, "variant_b37", "left")
    return table


def in_table_order(table: DataFrame) -> DataFrame:
    return table.orderBy("trait", "gene", level_rank("level", S.ALL_LEVELS), "variant_b37")


def variants_per_condition(carrier_pheno: DataFrame) -> DataFrame:
    """Distinct variants per condition, split by evidence and path / excluded."""
    keep = carrier_pheno.where(~F.coalesce(core_genes_of_extended(), F.lit(False)))
    return (
        keep.select("evidence", "variant", "gene", "level", "trait", "cohort").distinct()
        .select(
            recode("trait", S.TRAIT_DISPLAY).alias("trait"), "cohort",
            F.concat_ws(
                " ",
                F.when(level_in("level", S.PATH_LEVELS), "Pathogenic").otherwise("Excluded"),
                merged_reviews(),
            ).alias("category"),
        )
        .where(F.col("trait").isin(list(S.DISEASE_ORDER)))
        .groupBy("trait", "category", "cohort").agg(F.count(F.lit(1)).alias("count"))
    )


def share_within(counts: DataFrame, parent: Sequence[str], count: str = "n", out: str = "frequency"):
    """Percentage of each row's count within its parent group."""
    if not parent:
        return counts.withColumn(
            out, F.col(count) / counts.agg(F.sum(count)).scalar() * 100)
    totals = counts.groupBy(*parent).agg(F.sum(count).alias("_parent"))
    return counts.join(totals, list(parent)).withColumn(
        out, F.col(count) / F.col("_parent") * 100
    ).drop("_parent")


def carrier_ancestry(path_carrier_pheno: DataFrame) -> DataFrame:
    """Ancestry mix of carriers per condition and evidence type, in percent."""
    counts = (
        path_carrier_pheno.where(~F.coalesce(core_genes_of_extended(), F.lit(False)))
        .select("subject", "variant", recode("trait", S.TRAIT_DISPLAY).alias("trait"), "ancestry",
                merged_reviews().alias("evidence"))
        .where(F.col("trait").isin(list(S.DISEASE_ORDER)))
        .distinct()
        .groupBy("trait", "ancestry", "evidence").agg(F.count(F.lit(1)).alias("n"))
    )
    return share_within(counts, ["trait", "evidence"])


def cohort_ancestry(pheno: DataFrame) -> DataFrame:
    """Ancestry mix of all subjects, in percent."""
    counts = pheno.select("subject", "ancestry").distinct().groupBy("ancestry").agg(
        F.count(F.lit(1)).alias("n")
    )
    return share_within(counts, [])


MEASURES = ("age", "bmi", "ldl_mgdl", "ldl_mgdl_adj", "hdl_mgdl", "tg_mgdl", "tg_mgdl_adj")


def participant_group(biobank: str = "UKBB") -> Column:
    return (
        F.when(F.col("cohort") == biobank, "UKB")
        .when(F.col("t2d") == 0, "AMP-T2D control").when(F.col("t2d") == 1, "AMP-T2D case")
    )


def participant_characteristics(
    pheno: DataFrame, group: Column, groups: Sequence[str], ancestry: Column,
    ancestries: Sequence[str], measures: Sequence[str] = MEASURES,
) -> DataFrame:
    """Counts by sex and ancestry, mean and sd of measures; one column per group.

    A single aggregation computes every cell for every group; the small result
    is then turned so that characteristics are rows.
    """
    base = pheno.select(
        group.alias("_group"), F.when(F.col("sex") == 1, "Male").when(F.col("sex").isNotNull(), "Female")
        .alias("_sex"), ancestry.alias("_ancestry"), *measures,
    )
    cells = {"Female": F.count(F.when(F.col("_sex") == "Female", 1)),
             "Male": F.count(F.when(F.col("_sex") == "Male", 1))}
    for m in measures:
        cells[f"{m}_mean"] = F.avg(m)
        cells[f"{m}_sd"] = F.stddev_samp(m)
    for a in ancestries:
        cells[a] = F.nullif(F.count(F.when(F.col("_ancestry") == a, 1)), F.lit(0))
    wide = base.groupBy("_group").agg(*[c.alias(name) for name, c in cells.items()])
    return transpose(wide, "_group", groups, list(cells))
