"""Polygenic-score analysis: percentiles, distributions and models."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions.columns import compare
from carrierlab.functions.order import row_numbers
from carrierlab.functions.ranks import empirical_cdf, with_tiles
from carrierlab.operators.carriers import (
    CARRIER, NON_CARRIER, annotate_carriers, carrier_label, status_of, with_status_by_trait,
)
from carrierlab.operators.models import (
    fit_glm, fit_groups, odds_ratio_interval, treatment_coded, with_interaction,
)
from carrierlab.operators.penetrance import binary_summary, mean_summary
from carrierlab.session import checkpointed

TILES = {"quantile": 4, "decile": 10, "forty": 40, "percentile": 100}


def standardised(df: DataFrame, value: str, out: str) -> DataFrame:
    """z-score over the whole table; the two moments are one scalar subquery."""
    moments = df.agg(
        F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).alias("moments")
    ).scalar()
    return df.withColumn(
        out, F.try_divide(F.col(value) - moments["mean"], moments["sd"])
    )


def scored_phenotypes(
    pheno: DataFrame, scores: DataFrame, setting: S.ScoreSetting, score: str = "score"
) -> DataFrame:
    """Phenotypes with standardised score, value and outcome for one setting.

    The score is standardised over everyone, before the medication filter, and
    its sign is turned when low values are the condition.
    """
    out = standardised(pheno.join(scores, "subject", "left"), score, "prs")
    if setting.no_meds:
        out = out.where(F.col("lipidmeds") == 0)
    if setting.lower_is_worse:
        out = out.withColumn("prs", -F.col("prs"))
    return (
        out.withColumn("phenotype_value", F.col(setting.phenotype).cast("double"))
        .where(F.col("phenotype_value").isNotNull() & F.col("prs").isNotNull())
        .withColumn("by_threshold", compare("phenotype_value", setting.rule, setting.threshold))
    )


def score_frame(
    pheno: DataFrame, scores: DataFrame, carriers: DataFrame, gene_traits: DataFrame | None,
    setting: S.ScoreSetting, age_cutoff: float | None = None, by_gene: bool = False,
    tie: Column | None = None, covariates: Sequence[str] = S.COVARIATES,
    levels: Iterable[str] = S.PATH_LEVELS,
) -> DataFrame:
    """The analysis table of one setting: carrier label and score tiles.

    Carriers are exempt from the age filter. Tiles are taken after it, over
    all cohorts together. The joined table is written to the checkpoint folder
    once, because ranking reads it several times.
    """
    scored = scored_phenotypes(pheno, scores, setting)
    keep = ["subject", "cohort", "phenotype_value", "prs", "by_threshold", *covariates]
    frame = annotate_carriers(
        scored.select(*dict.fromkeys(keep)), carriers, gene_traits, setting.trait, levels,
        by_gene=by_gene,
    ).drop("evidence", "af", "ac")
    if age_cutoff is not None:
        frame = frame.where((F.col("age") >= age_cutoff) | (F.col("carrier") == CARRIER))
    frame = frame.withColumn("_tie", F.xxhash64("cohort", "subject") if tie is None else tie)
    return with_tiles(checkpointed(frame), "prs", "_tie", TILES).drop("_tie")


def with_group_tiles(df: DataFrame, groups: Sequence[str], value: str, tie: str, tiles: dict[str, int]) -> DataFrame:
    """Tiles of equal size inside each group by value, then tie: as ntile, for groups of any size."""
    placed = row_numbers(df, groups, [value, tie], "_at")
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    out = placed.join(sizes, list(groups))
    for name, k in tiles.items():
        least, more = F.expr(f"_n div {k}"), F.col("_n") % k  # the first ``more`` tiles have a row more
        large = more * (least + 1)
        out = out.withColumn(name, F.when(F.col("_at") <= large, F.ceil(F.col("_at") / (least + 1))).otherwise(
            more + F.ceil(F.try_divide(F.col("_at") - large, least))).cast("int"))
    return out.drop("_at", "_n")


SETTING = ["setting", "condition", "restrict_lipid_meds"]


def score_frames(
    pheno: DataFrame, scores: DataFrame, carriers: DataFrame, gene_traits: DataFrame | None,
    settings: Sequence[S.ScoreSetting] | None = None, age_cutoff: float | None = None, tie: Column | None = None,
    covariates: Sequence[str] = S.COVARIATES, levels: Iterable[str] = S.PATH_LEVELS,
) -> DataFrame:
    """The analysis table of all settings at once: as :func:`score_frame`, with columns SETTING in front.

    ``scores`` has subject, score and, if they differ, phenotype. Phenotypes,
    scores and carriers are joined once; settings are an array that is exploded
    afterwards. Carriers have the gene of their variant of least frequency. A
    row a subject is written to the checkpoint folder, first without and then
    with its tiles; ranking moves no more than the score and a row number.
    """
    settings = list(settings or S.score_settings())
    keyed = "phenotype" in scores.columns
    measures = sorted({s.phenotype for s in settings})
    if keyed:
        wide = scores.groupBy("subject").pivot("phenotype", measures).agg(F.first("score"))
        wide = wide.select("subject", *[F.col(m).alias(f"_score_{m}") for m in measures])
    else:
        wide = scores.select("subject", F.col("score").alias("_score"))
    scored = {m: f"_score_{m}" if keyed else "_score" for m in measures}
    keep = ["subject", "cohort", *dict.fromkeys(["age", *covariates])]
    joined = pheno.select("subject", "cohort", *dict.fromkeys([*measures, "lipidmeds", "age", *covariates])).join(
        wide, "subject", "left")
    moments = joined.agg(F.struct(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias(
        "sd")).alias(c) for c in dict.fromkeys(scored.values())])).scalar()
    frame = with_status_by_trait(joined, carriers, gene_traits, sorted({s.trait for s in settings}), levels, True)
    frame = frame.withColumns({c: F.try_divide(F.col(c) - moments[c]["mean"], moments[c]["sd"]) for c in dict.fromkeys(
        scored.values())}).withColumn("_status", F.transform_values("_status", lambda _, v: F.struct(
            v["is_carrier"].alias("is_carrier"), v["has_vus"].alias("has_vus"), v["gene"].alias("gene"))))
    frame = checkpointed(frame).withColumn("_row", F.monotonically_increasing_id())
    records = []
    for i, s in enumerate(settings):
        z, value = F.col(scored[s.phenotype]), F.col(s.phenotype).cast("double")
        records.append(F.struct(
            F.lit(i).alias("setting"), F.lit(s.trait).alias("condition"), F.lit(s.no_meds).alias("restrict_lipid_meds"),
            F.lit(s.binary).alias("binary"), (F.when(F.col("lipidmeds") == 0, value) if s.no_meds else value).alias(
                "phenotype_value"), (-z if s.lower_is_worse else z).alias("prs"),
            compare(F.col(s.phenotype), s.rule, s.threshold).alias("by_threshold")))

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_s", status_of(F.col("condition"))).withColumn(
            "carrier", carrier_label(F.col("_s.is_carrier"), F.col("_s.has_vus"))).withColumn(
            "gene", F.when(F.col("carrier") == NON_CARRIER, NON_CARRIER).otherwise(F.col("_s.gene"))).drop("_s", "_status")

    rows = labelled(frame.select("_row", *keep, "_status", F.inline(F.array(*records))).where(
        F.col("phenotype_value").isNotNull() & F.col("prs").isNotNull()))
    if age_cutoff is not None:
        rows = rows.where((F.col("age") >= age_cutoff) | (F.col("carrier") == CARRIER))
    placed = rows.select("_row", "setting", "prs", (F.xxhash64("cohort", "subject") if tie is None else tie).alias("_tie"))
    tiles = with_group_tiles(placed, ["setting"], "prs", "_tie", TILES).groupBy("_row").agg(
        F.collect_list(F.struct("setting", *TILES)).alias("_tiles"))
    whole = checkpointed(frame.join(tiles, "_row").drop("_row"))
    out = whole.withColumn("_records", F.array(*records)).select(*keep, "_status", "_records", F.inline("_tiles")).withColumn(
        "_record", F.get("_records", F.col("setting"))).select(
        *keep, "_status", "setting", *[F.col(f"_record.{c}").alias(c) for c in (
            "condition", "restrict_lipid_meds", "binary", "phenotype_value", "prs", "by_threshold")], *TILES)
    return labelled(out).select(
        *keep, *SETTING, "binary", "phenotype_value", "prs", "by_threshold", "carrier", "gene", *TILES)


MODELS = ("top_vs_carrier", "interquartile_vs_top", "carriers", "interaction")


def all_score_models(
    frames: DataFrame, covariates: Sequence[str] = S.COVARIATES, models: Sequence[str] = MODELS,
    genes_alone: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Coefficients of the models of :func:`score_models` for all settings, in the same passes.

    ``genes_alone`` names, per trait, genes with which the models are fitted
    again, with carriers of that gene only; column ``gene`` tells them apart
    (null: all carriers). Models without rows are left out.
    """
    carrying = (F.col("carrier") == CARRIER).cast("double")
    shared = [F.col(f"`{c}`").cast("double") for c in covariates]
    top = F.when(F.col("percentile") == 100, 1.0).when(F.col("quantile").isin(2, 3), 0.0)
    binary, width = F.col("binary"), len(covariates) + 3
    terms = {
        "top_vs_carrier": (binary, ["carrierNon Carrier", *covariates], F.when(
            (F.col("percentile") == 100) | (F.col("carrier") == CARRIER), F.array(1 - carrying, *shared))),
        "interquartile_vs_top": (binary, ["groupingtop_1", *covariates], F.when(
            (F.col("carrier") != CARRIER) & top.isNotNull(), F.array(top, *shared))),
        "carriers": (F.lit(False), ["prs", *covariates], F.when(
            F.col("carrier") == CARRIER, F.array(F.col("prs"), *shared))),
        "interaction": (F.lit(False), ["carrierCarrier", "prs", *covariates, "carrierCarrier:prs"], F.when(
            ~binary, F.array(carrying, F.col("prs"), *shared, carrying * F.col("prs")))),
    }
    records = []
    alone = [(trait, gene) for trait, genes in (genes_alone or {}).items() for gene in genes]
    for trait, gene in [(None, None), *alone]:
        kept = F.lit(True) if gene is None else (F.col("condition") == trait) & F.col("gene").isin(gene, NON_CARRIER)
        for name in models:
            logit, names, x = terms[name]
            padding = F.array_repeat(F.lit(0.0), width - len(names))
            records.append(F.struct(
                F.lit(name).alias("model"), F.lit(gene).cast("string").alias("only_gene"), logit.alias("logit"),
                F.lit(names).alias("variables"), F.when(kept, F.concat(x, padding)).alias("x")))
    keys = ["model", *SETTING, "only_gene"]
    rows = frames.select(*SETTING, F.col("phenotype_value").alias("y"), F.inline(F.array(*records))).where(
        F.col("x").isNotNull())
    found = fit_groups(rows, ["model", "setting", "condition", "restrict_lipid_meds", "only_gene"],
                       rows.select(*keys, "logit", "variables").distinct())
    return found.withColumnRenamed("only_gene", "gene")


def percentile_means(
    frame: DataFrame, tile: str = "percentile", value: str = "phenotype_value", binary: bool = False,
    by_gene: bool = False, genes: Iterable[str] | None = None, conf: float | None = 0.95,
) -> DataFrame:
    """Summary per score tile, and one row for carriers (or one per gene)."""
    def summary(df: DataFrame, group: str) -> DataFrame:
        table = binary_summary(df, [group], value) if binary else mean_summary(df, [group], value, conf)
        return table.withColumn(tile, F.col(group).cast("string"))

    tiles = summary(frame, tile).withColumn("color", F.lit("gePS percentile"))
    carriers = frame.where(F.col("carrier") == CARRIER)
    if by_gene:
        if genes is not None:
            carriers = carriers.where(F.col("gene").isin(list(genes)))
        rows = summary(carriers, "gene").drop("gene")
    else:
        rows = summary(carriers, "carrier").drop("carrier").withColumn(tile, F.lit("C"))
    return tiles.unionByName(rows.withColumn("color", F.lit("Carrier")))


def quartile_distributions(frame: DataFrame, value: str = "phenotype_value") -> DataFrame:
    """Empirical distribution of the value by carrier label, bottom and top quartile."""
    ends = frame.where(F.col("quantile").isin(1, 4))
    return empirical_cdf(ends, ["carrier", "quantile"], value)


def score_groups(frame: DataFrame) -> DataFrame:
    """Non-carriers of the middle half and of the top percentile."""
    return frame.where(F.col("carrier") != CARRIER).withColumn(
        "grouping",
        F.when(F.col("percentile") == 100, "top_1").when(F.col("quantile").isin(2, 3), "interquartile"),
    ).where(F.col("grouping").isNotNull())


def _tagged(table: DataFrame, setting: S.ScoreSetting, model: str) -> DataFrame:
    return table.select(
        F.lit(model).alias("model"), F.lit(setting.trait).alias("condition"),
        F.lit(setting.no_meds).alias("restrict_lipid_meds"), *table.columns,
    )


def score_models(
    frame: DataFrame, setting: S.ScoreSetting, covariates: Sequence[str] = S.COVARIATES,
    models: Sequence[str] = ("top_vs_carrier", "interquartile_vs_top", "carriers", "interaction"),
) -> dict[str, DataFrame]:
    """Coefficient tables of one setting.

    ``top_vs_carrier``: non-carriers of the top percentile against carriers
    (carriers are the baseline); ``interquartile_vs_top``: middle half is the
    baseline; ``carriers``: value on score among carriers; ``interaction``:
    carrier label times score among all, non-carriers the baseline.
    """
    family = "binomial" if setting.binary else "gaussian"
    value, out = "phenotype_value", {}
    if "top_vs_carrier" in models:
        top = treatment_coded(
            frame.where((F.col("percentile") == 100) | (F.col("carrier") == CARRIER)),
            "carrier", CARRIER, NON_CARRIER, "carrierNon Carrier",
        )
        out["top_vs_carrier"] = fit_glm(top, value, ["carrierNon Carrier", *covariates], family)
    if "interquartile_vs_top" in models:
        groups = treatment_coded(
            score_groups(frame), "grouping", "interquartile", "top_1", "groupingtop_1")
        out["interquartile_vs_top"] = fit_glm(groups, value, ["groupingtop_1", *covariates], family)
    if "carriers" in models:
        out["carriers"] = fit_glm(
            frame.where(F.col("carrier") == CARRIER), value, ["prs", *covariates])
    if "interaction" in models and not setting.binary:
        coded = with_interaction(
            treatment_coded(frame, "carrier", NON_CARRIER, CARRIER, "carrierCarrier"),
            "carrierCarrier", "prs", "carrierCarrier:prs",
        )
        out["interaction"] = fit_glm(
            coded, value, ["carrierCarrier", "prs", *covariates, "carrierCarrier:prs"])
    return {name: _tagged(t, setting, name) for name, t in out.items()}


def odds_ratio_vs_first(
    frame: DataFrame, group: int, outcome: str = "by_threshold", tile: str = "percentile",
    covariates: Sequence[str] = S.COVARIATES,
) -> DataFrame:
    """Odds ratio of one tile against the first, adjusted for covariates."""
    if group == 1:
        return frame.sparkSession.range(1).select(
            F.lit(1).alias("group"), *[F.lit(1.0).alias(c) for c in ("odds_ratio", "low", "high")]
        )
    coded = frame.withColumn(
        "in_group", F.when(F.col(tile) == 1, 0.0).when(F.col(tile) == group, 1.0))
    fitted = fit_glm(coded, outcome, ["in_group", *covariates], "binomial")
    return odds_ratio_interval(fitted.where(F.col("variable") == "in_group")).select(
        F.lit(group).alias("group"), "odds_ratio", "low", "high")
