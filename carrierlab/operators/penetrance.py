"""Penetrance: how often carriers show the condition, for every setting at once.

The settings become one array per phenotype row, exploded after the single
join with carrier status; partial aggregation then folds the exploded rows
into (setting, cohort, carrier) groups before anything is shuffled. There is
one plan for all settings, not one plan per setting.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions.columns import frequency_band, level_rank
from carrierlab.functions.stats import exact_interval, t_half_width
from carrierlab.operators.carriers import (
    CARRIER, NON_CARRIER, VUS, annotate_carriers, carrier_label, status_of, with_status_by_trait,
)


def _with_label(exploded: DataFrame, vus: str, by_gene: bool) -> DataFrame:
    """Carrier label (and gene) of an exploded row, from its trait's status."""
    status = status_of(F.col("trait"))
    looked_up = exploded.withColumn("_s", status).drop("_status")
    label = carrier_label(F.col("_s.is_carrier"), F.col("_s.has_vus"), vus)
    if vus == "stratify":
        label = F.when(
            label == VUS, F.concat_ws(" ", F.lit(VUS), frequency_band("_s.af", "_s.ac"))
        ).otherwise(label)
    out = looked_up.withColumn("carrier", label)
    if by_gene:
        out = out.withColumn(
            "gene", F.when(F.col("carrier") == NON_CARRIER, NON_CARRIER).otherwise(F.col("_s.gene")))
    return out.drop("_s")


def _literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"


def _record(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _unmedicated(no_meds: bool, value: str) -> str:
    """Restricting to unmedicated drops unknown medication as well."""
    return f"CASE WHEN lipidmeds = 0 THEN {value} END" if no_meds else value


def _exploded(frame: DataFrame, records: Sequence[dict[str, str]]) -> DataFrame:
    """One row per setting; only the trait's status is looked up afterwards."""
    array = "array(" + ", ".join(_record(r) for r in records) + ")"
    return frame.select("cohort", "_status", F.expr(f"inline({array})"))


def _described(table: DataFrame, descriptions: Sequence[dict[str, object]]) -> DataFrame:
    """Replace the setting number's meaning by its descriptive columns."""
    array = "array(" + ", ".join(
        _record({k: _literal(v) for k, v in d.items()}) for d in descriptions) + ")"
    return table.withColumn("_d", F.expr(f"element_at({array}, setting + 1)")).select(
        "setting", "_d.*", *[c for c in table.columns if c != "setting"])


def penetrance_counts(
    pheno: DataFrame, carriers: DataFrame, gene_traits: DataFrame | None,
    settings: Sequence[S.OutcomeSetting] | None = None, levels: Iterable[str] = S.PATH_LEVELS,
    by_gene: bool = False, vus: str = "ignore",
) -> DataFrame:
    """Rows with the outcome and rows with a known outcome per setting and group.

    Groups without a known outcome give no row; a group without positives
    gives count 0.
    """
    settings = settings or S.outcome_settings()
    traits = sorted({s.trait for s in settings})
    measures = sorted({s.phenotype for s in settings} | {"lipidmeds"})
    frame = with_status_by_trait(
        pheno.select("subject", "cohort", *measures), carriers, gene_traits, traits, levels,
        by_gene or vus == "stratify",
    )
    records = [
        {
            "setting": str(i), "trait": _literal(s.trait),
            "outcome": _unmedicated(s.no_meds, f"`{s.phenotype}` {s.rule} {_literal(float(s.threshold))}"),
        }
        for i, s in enumerate(settings)
    ]
    group = ["setting", "cohort", "carrier"] + (["gene"] if by_gene else [])
    counted = (
        _with_label(_exploded(frame, records).where(F.col("outcome").isNotNull()), vus, by_gene)
        .where(F.col("carrier").isNotNull())
        .groupBy(*group)
        .agg(F.count(F.when(F.col("outcome"), 1)).alias("count"), F.count("outcome").alias("total"))
    )
    return _described(counted, [
        {"condition": s.condition, "condition_simple": s.condition_simple,
         "phenotype": s.phenotype, "lipidmeds": s.no_meds}
        for s in settings
    ]).withColumn("prop", F.col("count") / F.col("total"))


def penetrance_table(pheno, carriers, gene_traits, conf: float = 0.95, **options) -> DataFrame:
    """Penetrance counts with exact binomial intervals.

    Options are those of :func:`penetrance_counts`.
    """
    counts = penetrance_counts(pheno, carriers, gene_traits, **options)
    interval = exact_interval("count", "total", conf)
    return counts.withColumn("_ci", interval).select(
        *counts.columns,
        F.when(F.col("phenotype") == "t2d", "T2D")
        .when(F.col("phenotype") == "t2d_with_pre", "T2D and pre-diabetes").alias("diabetes_definition"),
        F.col("_ci.low").alias("low"), F.col("_ci.high").alias("high"),
    )


def ordered_by_setting(table: DataFrame) -> DataFrame:
    """Presentation order: setting, cohort, then carrier in vocabulary order."""
    return table.orderBy("setting", "cohort", level_rank("carrier", S.CARRIER_ORDER))


# --- grouped means ---------------------------------------------------------

def mean_summary(
    df: DataFrame, groups: Sequence[str], value: str, conf: float | None = 0.95
) -> DataFrame:
    """n, mean, sd, se and (with ``conf``) the Student-t interval per group."""
    known = F.col(value).cast("double")
    out = df.groupBy(*groups).agg(
        F.count(known).alias("n"), F.avg(known).alias("mean"), F.stddev_samp(known).alias("sd")
    ).withColumn("se", F.col("sd") / F.sqrt(F.nullif(F.col("n"), F.lit(0))))
    if conf is None:
        return out
    return (
        out.withColumn("ci", t_half_width("n", "sd", conf))
        .withColumn("low", F.col("mean") - F.col("ci"))
        .withColumn("high", F.col("mean") + F.col("ci"))
    )


def binary_summary(
    df: DataFrame, groups: Sequence[str], value: str, conf: float = 0.95
) -> DataFrame:
    """As :func:`mean_summary` for a 0/1 value: exact interval, null without positives."""
    known = F.col(value).cast("double")
    out = df.groupBy(*groups).agg(
        F.count(known).alias("n"), F.count(F.when(known == 1, 1)).alias("x"),
        F.avg(known).alias("mean"), F.stddev_samp(known).alias("sd"),
    ).withColumn("se", F.col("sd") / F.sqrt(F.nullif(F.col("n"), F.lit(0))))
    return out.withColumn("_ci", exact_interval("x", "n", conf, null_when_zero=True)).select(
        *out.columns, F.col("_ci.low").alias("low"), F.col("_ci.high").alias("high")
    )


def carrier_means(
    pheno: DataFrame, carriers: DataFrame, gene_traits: DataFrame | None,
    settings: Sequence[S.MeanSetting] | None = None, levels: Iterable[str] = S.PATH_LEVELS,
    by_gene: bool = False, subset: str | None = None, conf: float | None = 0.95,
) -> DataFrame:
    """Mean of each setting's phenotype by carrier status (and gene, subset)."""
    settings = settings or S.mean_settings()
    traits = sorted({s.trait for s in settings})
    measures = sorted({s.phenotype for s in settings} | {"lipidmeds"} | ({subset} if subset else set()))
    frame = with_status_by_trait(
        pheno.select("subject", "cohort", *measures), carriers, gene_traits, traits, levels, by_gene
    )
    records = [
        {
            "setting": str(i), "trait": _literal(s.trait), **({"subset": f"`{subset}`"} if subset else {}),
            "value": _unmedicated(s.no_meds, f"CAST(`{s.phenotype}` AS DOUBLE)"),
        }
        for i, s in enumerate(settings)
    ]
    group = ["setting", "cohort", "carrier"] + (["gene"] if by_gene else []) + (["subset"] if subset else [])
    rows = _with_label(_exploded(frame, records), "ignore", by_gene)
    means = mean_summary(rows, group, "value", conf)
    return _described(means, [
        {"condition": s.label, "trait": s.trait, "phenotype": s.association_trait, "lipidmeds": s.no_meds}
        for s in settings
    ])


def condition_points(
    pheno: DataFrame, carriers: DataFrame, gene_traits: DataFrame | None, trait: str, phenotype: str,
    no_meds: bool = False, vus: str = "ignore", results: DataFrame | None = None,
    levels: Iterable[str] = S.PATH_LEVELS,
) -> DataFrame:
    """One row per subject for one condition: value, arm and evidence.

    ``arm`` is NC or C (other labels as they are); non-carriers show no
    evidence type. ``results`` (cohort, p_value) is looked up by cohort. With
    ``vus="stratify"`` only arms and novel uncertain variants remain.
    """
    columns = dict.fromkeys(["subject", "cohort", phenotype, "age", "lipidmeds"])
    frame = annotate_carriers(pheno.select(*columns), carriers, gene_traits, trait, levels, vus=vus)
    if no_meds:
        frame = frame.where(F.col("lipidmeds") == 0)
    frame = frame.where(F.col("carrier").isNotNull())
    if vus == "stratify":
        frame = frame.where(F.col("carrier").isin(CARRIER, NON_CARRIER, f"{VUS} Novel"))
    frame = frame.withColumns({
        "evidence": F.when(F.col("carrier") == NON_CARRIER, NON_CARRIER).otherwise(F.col("evidence")),
        "arm": F.when(F.col("carrier") == NON_CARRIER, "NC").when(F.col("carrier") == CARRIER, "C")
        .otherwise(F.col("carrier")),
    })
    return frame if results is None else frame.join(results.select("cohort", "p_value"), "cohort", "left")


# --- reshaping -------------------------------------------------------------

def spread(
    df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], measures: Sequence[str],
    measure_first: bool = False,
) -> DataFrame:
    """Pivot with the values given: one conditional aggregation, one shuffle.

    Output columns are ``measure_value``; missing combinations are null. Keys
    may be null.
    """
    aggregates = []
    pairs = (
        [(m, v) for m in measures for v in values] if measure_first
        else [(m, v) for v in values for m in measures]
    )
    for measure, value in pairs:
        aggregates.append(
            F.max(F.when(F.col(column) == value, F.col(measure))).alias(f"{measure}_{value}")
        )
    return df.groupBy(*keys).agg(*aggregates)


def transpose(df: DataFrame, key: str, key_values: Sequence[str], rows: Sequence[str]) -> DataFrame:
    """Columns of a small result become rows (numbered, named), one column per key value."""
    long = df.select(
        key, F.inline(F.array(*[
            F.struct(F.lit(i).alias("row"), F.lit(r).alias("rowname"), F.col(f"`{r}`").cast("double").alias("value"))
            for i, r in enumerate(rows)
        ]))
    )
    return long.groupBy("row", "rowname").agg(*[
        F.max(F.when(F.col(key) == v, F.col("value"))).alias(v) for v in key_values
    ])
