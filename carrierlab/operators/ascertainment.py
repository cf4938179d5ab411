"""Were extreme carriers recruited for being extreme?

Compares carriers ascertained on a phenotype with the other carriers, over all
variants and over the variants both arms share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions.columns import member
from carrierlab.operators.models import fit_glm
from carrierlab.operators.penetrance import mean_summary, spread

ARMS = ("not_LDL_ascertained", "LDL_ascertained")


def arm_frame(
    path_carrier_pheno: DataFrame, trait: str, label: str, label_column: str = "esp_phenotype",
    value: str = "ldl_mgdl", other_labels: Sequence[str] | None = None,
) -> DataFrame:
    """Carriers of a trait with their arm; other ascertained labels leave.

    An unknown label counts as not ascertained and stays.
    """
    others = [x for x in (other_labels or S.ASCERTAINED_PHENOTYPES) if x != label]
    return path_carrier_pheno.where(
        (F.col("trait") == trait) & F.col(value).isNotNull() & ~member(label_column, others)
    ).withColumn("ascertained", member(label_column, [label]))


def shared_variants(frame: DataFrame, variant: str = "variant", arm: str = "ascertained") -> DataFrame:
    """Rows whose variant occurs in both arms."""
    both = frame.groupBy(variant).agg(
        F.bool_or(arm).alias("_in"), F.bool_or(~F.col(arm)).alias("_out")
    ).where(F.col("_in") & F.col("_out")).select(variant)
    return frame.join(both, variant, "left_semi")


def arm_statistics(
    frame: DataFrame, value: str, columns: Sequence[str], groups: Sequence[str] = (),
    conf: float | None = 0.95,
) -> DataFrame:
    """n, mean, sd, se and interval per arm over distinct rows of ``columns``."""
    keep = list(dict.fromkeys([*groups, "ascertained", value, *columns]))
    return mean_summary(frame.select(*keep).distinct(), [*groups, "ascertained"], value, conf)


def ascertainment_row(
    frame: DataFrame, condition: str, columns: Sequence[str], covariates: Sequence[str],
    value: str = "ldl_mgdl_adj",
) -> DataFrame:
    """One wide row: statistics of both arms and the p value of the arm."""
    stats = arm_statistics(frame, value, columns).withColumn(
        "arm", F.when(F.col("ascertained"), ARMS[1]).otherwise(ARMS[0])
    ).select(F.lit(condition).alias("condition"), "arm", F.col("mean").alias("mn"), "n", "sd", "se",
             F.col("low").alias("lci"), F.col("high").alias("uci"))
    wide = spread(stats, ["condition"], "arm", ARMS, ["mn", "n", "sd", "se", "lci", "uci"], True)
    used = frame.select(*dict.fromkeys(["ascertained", value, *columns, *covariates])).distinct()
    fitted = fit_glm(used.withColumn("arm", F.col("ascertained").cast("double")), value,
                     ["arm", *covariates])
    p = fitted.where(F.col("variable") == "arm").select(
        F.lit(condition).alias("condition"), F.col("p_value").alias("pvalue"))
    return wide.join(p, "condition", "left")


def ascertainment_table(
    path_carrier_pheno: DataFrame, covariates: DataFrame, labels: dict[str, str] | None = None,
    components: int = 10, shared_components: int = 5,
) -> DataFrame:
    """Four rows: both conditions, over all and over shared variants."""
    labels = labels or {"High LDL": "LDL_High", "Low LDL": "LDL_Low"}
    names = [f"C{i}" for i in range(1, components + 1)]
    joined = path_carrier_pheno.join(
        covariates.select(F.col("IID").alias("subject"), *names), "subject")
    base = ["age", "sex", *names, "subject", "trait", "ldl_mgdl", "ldl_mgdl_adj", "bmi",
            "esp_phenotype", "lipidmeds"]
    rows = None
    for restrict in (False, True):
        for trait, label in labels.items():
            frame = arm_frame(joined, trait, label)
            columns, used = base, ["age", "sex", *names]
            name = trait
            if restrict:
                frame, columns = shared_variants(frame), [*base, "variant"]
                used = ["age", "sex", *names[:shared_components]]
                name = f"{trait} - Restricted to shared variants"
            row = ascertainment_row(frame, name, columns, used)
            rows = row if rows is None else rows.union(row)
    return rows.distinct()


def non_carriers(
    pheno: DataFrame, carriers: DataFrame, label_column: str = "esp_phenotype",
    labels: Sequence[str] = S.ASCERTAINED_PHENOTYPES,
) -> DataFrame:
    """Subjects outside the carrier set and not ascertained."""
    return pheno.where(~member(label_column, labels)).join(
        carriers.select("subject").distinct(), "subject", "left_anti")
