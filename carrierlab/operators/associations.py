"""Association results: selecting, naming and joining them to tables.

The tests themselves are run elsewhere; their result rows have ``Condition,
Trait, Gene, type, subset, additional_covariates, PVALUE, BETA, SEBETA,
data_source``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierlab.functions.columns import estimate_interval_text, member, significant_digits
from carrierlab.operators.penetrance import spread

# Covariate sets of the association runs.
PLAIN_COVARIATES = ("", "covart2d")
MEDICATION_COVARIATES = "covart2d,covarlipidmeds"
# Names of binary outcomes in the association results.
BINARY_OUTCOMES = {
    ("Low LDL", "ldl_mgdl_adj"): "low_ldl_adj",
    ("High LDL", "ldl_mgdl_adj"): "high_ldl_adj",
    ("High TG", "tg_mgdl_adj"): "high_tg_adj",
    ("Low LDL", None): "low_ldl",
    ("High LDL", None): "high_ldl",
    ("High HDL", None): "high_hdl",
    ("High TG", None): "high_tg",
    ("Monogenic obesity", None): "Obese",
}
CONDITION_NAMES = {
    "High triglycerides": "High TG",
    "High triglycerides ADJ": "High TG ADJ",
    "Obesity": "Monogenic obesity",
}


def tag_and_stack(tables: dict[str, DataFrame], column: str = "data_source") -> DataFrame:
    """Stack result tables, each tagged with its cohort name."""
    stacked = None
    for name, table in tables.items():
        tagged = table.withColumn(column, F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return stacked


def odds_ratio(beta: str = "BETA", se: str = "SEBETA") -> list[Column]:
    """exp of the coefficient and of the coefficient plus/minus one SE."""
    b, s = F.col(beta), F.col(se)
    return [F.exp(b).alias("or_"), F.exp(b - s).alias("or_low"), F.exp(b + s).alias("or_high")]


def select_results(
    results: DataFrame, carrier_type: str = "pathogenic", trait: str | None = None,
    phenotype: str | None = None, log_axis: bool = False, no_meds: bool = False,
) -> DataFrame:
    """Result rows for one analysis, or all rows usable in a table.

    Adds ``lipidmeds`` (adjusted for medication) and the odds ratio.
    """
    used = results.where(F.col("type") == carrier_type)
    covariates = F.col("additional_covariates")
    if trait is not None and phenotype is not None:
        used = used.where(
            (F.col("Condition") == trait.replace(" ", "_"))
            & (F.col("Trait") == phenotype + ("_ln" if log_axis else ""))
            & (covariates == (MEDICATION_COVARIATES if no_meds else "covart2d"))
        )
    else:
        used = used.where(
            covariates.isNull() | covariates.isin(*PLAIN_COVARIATES, MEDICATION_COVARIATES)
        )
    plain = covariates.isNull() | member(covariates, PLAIN_COVARIATES)
    return used.select("*", (~plain).alias("lipidmeds"), *odds_ratio())


def result_texts(results: DataFrame) -> DataFrame:
    """Three-digit texts of p value, coefficient and odds ratio."""
    g = significant_digits
    return results.withColumns({
        "p_text": g("PVALUE"),
        "beta_text": F.concat(g("BETA"), F.lit(" ("), g("SEBETA"), F.lit(")")),
        "or_text": F.concat(g("or_"), F.lit(" ("), g("or_low"), F.lit("-"), g("or_high"), F.lit(")")),
    })


def condition_name(col: str | Column = "Condition") -> Column:
    """Underscores to spaces, then the short names used in penetrance tables."""
    col = F.col(col) if isinstance(col, str) else col
    name = F.replace(col, F.lit("_"), F.lit(" "))
    return F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in CONDITION_NAMES.items() for x in kv]), name), name
    )


def binary_outcome_name(condition: str = "condition_simple", phenotype: str = "phenotype") -> Column:
    expr = F
    for (cond, measure), name in BINARY_OUTCOMES.items():
        hit = F.col(condition) == cond
        if measure is not None:
            hit = hit & (F.col(phenotype) == measure)
        expr = expr.when(hit, name)
    return expr.otherwise(F.col(phenotype))


RESULT_COLUMNS = ["PVALUE", "BETA", "SEBETA", "or_", "or_low", "or_high"]


def format_penetrance(
    penetrance: DataFrame, results: DataFrame, cohorts: Sequence[str], by_gene: bool = False,
    carrier_type: str = "pathogenic",
) -> DataFrame:
    """Penetrance rows with association results, cohorts side by side.

    One row per setting (and gene). Every condition keeps its label, also the
    adjusted ones restricted to unmedicated subjects.
    """
    keys = ["condition_simple", "phenotype", "cohort", "lipidmeds"] + (["gene"] if by_gene else [])
    used = result_texts(select_results(results, carrier_type)).select(
        condition_name().alias("condition_simple"), F.col("Trait").alias("phenotype"),
        F.col("data_source").alias("cohort"), "lipidmeds",
        *([F.col("Gene").alias("gene")] if by_gene else []), "p_text", "beta_text", "or_text",
    )
    prop = F.concat(
        significant_digits("prop"), F.lit(" ("), significant_digits("low"), F.lit("-"),
        significant_digits("high"), F.lit(")"),
    )
    table = penetrance.withColumn("phenotype", binary_outcome_name()).withColumn("prop", prop)
    measures = ["count", "total", "prop"]
    base = ["setting", "condition", "condition_simple", "phenotype", "lipidmeds"]
    if by_gene:
        wide, values = table, measures
    else:
        wide = spread(table, [*base, "cohort"], "carrier", ["Non Carrier", "Carrier"], measures, True)
        values = [f"{m}_{c}" for m in measures for c in ("Non Carrier", "Carrier")]
    joined = wide.join(used, keys, "left")
    out = spread(
        joined, [*base, *(["gene"] if by_gene else [])], "cohort", cohorts,
        [*values, "beta_text", "p_text", "or_text"], True,
    )
    return out.withColumn("restricted", F.when(F.col("lipidmeds"), "Yes").otherwise(""))


def format_means(
    means: DataFrame, results: DataFrame, cohorts: Sequence[str], by_gene: bool = False,
    carrier_type: str = "pathogenic", subset: bool = False,
) -> DataFrame:
    """Mean table with association results, arms and cohorts side by side."""
    extra = (["gene"] if by_gene else []) + (["subset"] if subset else [])
    used = result_texts(select_results(results, carrier_type)).select(
        F.replace(F.col("Condition"), F.lit("_"), F.lit(" ")).alias("trait"),
        F.col("Trait").alias("phenotype"), F.col("data_source").alias("cohort"), "lipidmeds",
        *([F.col("Gene").alias("gene")] if by_gene else []),
        *(["subset"] if subset else []), "p_text", "beta_text",
    )
    text = means.withColumn("mean_ci", estimate_interval_text("mean", "low", "high", 2, "   "))
    base = ["setting", "condition", "trait", "phenotype", "lipidmeds", *extra]
    if by_gene:
        wide, values = text, ["mean_ci"]
    else:
        wide = spread(text, [*base, "cohort"], "carrier", ["Carrier", "Non Carrier"], ["mean_ci"])
        values = ["mean_ci_Carrier", "mean_ci_Non Carrier"]
    joined = wide.join(used, ["trait", "phenotype", "cohort", "lipidmeds", *extra], "left")
    return spread(joined, base, "cohort", cohorts, [*values, "p_text", "beta_text"], True)
