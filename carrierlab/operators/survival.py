"""Kaplan-Meier curves by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions.order import in_ranges, running
from carrierlab.operators.carriers import annotate_carriers
from carrierlab.operators.cohort import age_at_onset
from carrierlab.session import checkpointed


def kaplan_meier(df: DataFrame, groups: Sequence[str], time: str, event: str) -> DataFrame:
    """Survival after each time: at risk, events, product of (1 - d/n).

    Subjects are counted per (group, time) first. Times may be as many as
    subjects: they are dealt to ranges, and products inside the ranges meet the
    products of the ranges before, so no task holds the times of a group. Rows
    with an unknown time or event are left out.
    """
    per_time = checkpointed(
        df.where(F.col(time).isNotNull() & F.col(event).isNotNull())
        .groupBy(*groups, time)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(event).cast("long")).alias("n_event")))
    counted = running(in_ranges(per_time, groups, [time]), groups, {"_up_to": F.col("_n")}, {"_up_to": "_all"})
    at_risk = counted.withColumn("n_risk", F.col("_all") - F.col("_up_to") + F.col("_n"))
    # The last step may reach 0, whose logarithm does not exist.
    factor = 1 - F.col("n_event") / F.col("n_risk")
    survived = running(at_risk, groups, {
        "_log": F.when(factor > 0, F.ln(factor)).otherwise(0.0), "_zeros": F.when(factor <= 0, 1).otherwise(0)})
    return survived.select(
        *groups, time, "n_risk", "n_event", (F.col("_n") - F.col("n_event")).alias("n_censor"),
        F.when(F.col("_zeros") > 0, 0.0).otherwise(F.exp("_log")).alias("survival"),
    )


def diagnosis_curves(
    pheno: DataFrame, carriers: DataFrame, gene_traits: DataFrame | None, trait: str = "MODY",
    genes: Sequence[str] = ("GCK", "HNF1A", "Non Carrier"),
    known_ages: Sequence[str] = (
        "aod", "Age_diabetes_diagnosed_0", "Age_diabetes_diagnosed_1", "Age_diabetes_diagnosed_2"),
    event: str = "t2d",
) -> DataFrame:
    """Age-at-diagnosis curves per cohort and gene of the carried variant."""
    frame = annotate_carriers(
        pheno.select("subject", "cohort", "age", event, *known_ages), carriers, gene_traits, trait,
        S.PATH_LEVELS, by_gene=True,
    ).where(F.col("gene").isin(list(genes)))
    frame = frame.withColumn("time", age_at_onset(known_ages, event))
    return kaplan_meier(frame, ["cohort", "gene"], "time", event)
