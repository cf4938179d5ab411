"""Queries: penetrance, carrier annotation, counts and means."""

from __future__ import annotations

from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions.columns import rename_evidence
from carrierlab.functions.ranks import group_quantiles
from carrierlab.operators import associations as A
from carrierlab.operators import carriers as C
from carrierlab.operators import cohort as H
from carrierlab.operators import counts as N
from carrierlab.operators import penetrance as P
from carrierlab.operators.ascertainment import arm_frame, arm_statistics, non_carriers, shared_variants
from carrierlab.plans import views as V
from carrierlab.plans.oracle_tables import PATH, exact_intervals, quoted, t_multipliers
from carrierlab.plans.registry import query, rounded

_CORE = quoted(S.CORE_MODY_GENES)
_EXTENDED = f"(trait = 'MODY Extended' AND gene IN ({_CORE}))"
_REVIEWED = "CASE WHEN evidence IN ('Review', 'ClinVar') THEN 'ClinVar and Reviews' ELSE evidence END"
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _study(spark, d):
    return V.prepared_phenotypes(spark, d), V.carriers(spark, d), V.gene_traits(spark, d)


_OUTCOME = """CASE rule WHEN '>' THEN v > threshold WHEN '<' THEN v < threshold ELSE v = threshold END"""


def _penetrance_sql(carrier: str, extra: str = "", join: str = "") -> str:
    gene = f", {extra} AS gene" if extra else ""
    return f"""
    WITH labelled AS (
      SELECT s.condition, s.phenotype, s.no_meds AS lipidmeds, p.cohort, {carrier} AS carrier{gene},
        {_OUTCOME} AS outcome
      FROM long_pheno p JOIN outcome_settings s ON s.phenotype = p.phenotype
      LEFT JOIN status t ON t.subject = p.subject AND t.cohort = p.cohort AND t.trait = s.trait {join}
      WHERE NOT s.no_meds OR p.lipidmeds = 0)
    SELECT condition, phenotype, lipidmeds, cohort, carrier{', gene' if extra else ''},
      count(*) FILTER (WHERE outcome) AS count, count(*) AS total,
      round(count(*) FILTER (WHERE outcome) / count(*)::DOUBLE, 6) AS prop
    FROM labelled WHERE outcome IS NOT NULL GROUP BY ALL"""


_LABEL = "CASE WHEN t.is_carrier THEN 'Carrier' ELSE 'Non Carrier' END"
_LOWEST = "LEFT JOIN lowest w ON w.subject = p.subject AND w.cohort = p.cohort AND w.trait = s.trait"
_BAND = """CASE WHEN w.ac = 0 OR w.ac IS NULL THEN 'Novel' WHEN w.af < 0.0001::DOUBLE THEN '<1/10000'
  WHEN w.af < 0.001::DOUBLE THEN '<1/1000' WHEN w.af >= 0.001::DOUBLE THEN '>=1/1000' END"""
_PENETRANCE = ["condition", "phenotype", "lipidmeds", "cohort", "carrier"]


@query(_penetrance_sql(_LABEL))
def penetrance_by_cohort(spark, d):
    table = P.penetrance_counts(*_study(spark, d))
    return table.select(*_PENETRANCE, "count", "total", rounded("prop"))


@query(_penetrance_sql(_LABEL, "CASE WHEN t.is_carrier THEN w.gene ELSE 'Non Carrier' END", _LOWEST))
def penetrance_by_gene(spark, d):
    table = P.penetrance_counts(*_study(spark, d), by_gene=True)
    return table.select(*_PENETRANCE, "gene", "count", "total", rounded("prop"))


@query(_penetrance_sql(
    f"CASE WHEN t.is_carrier THEN 'Carrier' WHEN t.has_vus THEN 'VUS ' || {_BAND} ELSE 'Non Carrier' END",
    "", _LOWEST))
def penetrance_with_vus_bands(spark, d):
    table = P.penetrance_counts(*_study(spark, d), vus="stratify")
    return table.select(*_PENETRANCE, "count", "total", rounded("prop"))


@query(_penetrance_sql(_LABEL).replace("FROM labelled", "FROM labelled").replace(
    "LEFT JOIN status t", f"""LEFT JOIN (SELECT subject, cohort, trait, bool_or(lower(level) IN ({quoted(S.BENIGN_LEVELS)})) AS is_carrier
      FROM relevant GROUP BY ALL) t"""))
def penetrance_of_benign_carriers(spark, d):
    table = P.penetrance_counts(*_study(spark, d), levels=S.BENIGN_LEVELS)
    return table.select(*_PENETRANCE, "count", "total", rounded("prop"))


@query(f"""WITH RECURSIVE pen AS ({_penetrance_sql(_LABEL)}), {exact_intervals("pen")}
    SELECT condition, phenotype, lipidmeds, cohort, carrier, count, total, prop,
      CASE phenotype WHEN 't2d' THEN 'T2D' WHEN 't2d_with_pre' THEN 'T2D and pre-diabetes' END AS diabetes_definition,
      round(low, 6) AS low, round(high, 6) AS high
    FROM pen JOIN exact_ci ON k = count AND n = total""")
def penetrance_exact_ci(spark, d):
    """Full table with exact intervals."""
    table = P.penetrance_table(*_study(spark, d))
    return table.select(*_PENETRANCE, "diabetes_definition", "count", "total",
                        rounded("prop"), rounded("low"), rounded("high"))


@query(f"""SELECT subject, cohort, variant, gene, trait, round(af, 8) AS af, ac,
    CASE e WHEN 'ClinVar, LOF' THEN 'ClinVar and LOF' WHEN 'LOF, Review' THEN 'LOF and Review' ELSE e END AS evidence
    FROM (SELECT subject, cohort, variant, gene, trait, af, ac,
      string_agg(DISTINCT evidence, ', ' ORDER BY evidence) AS e FROM carriers
      WHERE lower(level) IN ({PATH}) GROUP BY subject, cohort, variant, gene, trait, af, ac)""")
def collapse_evidence(spark, d):
    out = H.collapse_evidence(V.carriers(spark, d), S.PATH_LEVELS)
    return out.select("subject", "cohort", "variant", "gene", "trait", rounded("af", 8), "ac", "evidence")


@query("""
    SELECT p.subject, p.cohort, CASE WHEN t.is_carrier THEN 'Carrier' ELSE 'Non Carrier' END AS carrier,
      CASE WHEN t.is_carrier THEN w.gene ELSE 'Non Carrier' END AS gene, round(w.af, 8) AS af, w.ac AS ac,
      coalesce(m.evidence, '') AS evidence, round(p.hdl_mgdl, 6) AS hdl_mgdl
    FROM pheno p LEFT JOIN (FROM status WHERE trait = 'High HDL') t ON t.subject = p.subject AND t.cohort = p.cohort
    LEFT JOIN (FROM lowest WHERE trait = 'High HDL') w ON w.subject = p.subject AND w.cohort = p.cohort
    LEFT JOIN merged_evidence m ON m.subject = w.subject AND m.cohort = w.cohort AND m.trait = w.trait
      AND m.variant = w.variant""")
def lowest_af_per_carrier(spark, d):
    pheno, carriers, genes = _study(spark, d)
    out = C.annotate_carriers(pheno.select("subject", "cohort", "hdl_mgdl"), carriers, genes, "High HDL", by_gene=True)
    return out.select("subject", "cohort", "carrier", "gene", rounded("af", 8), "ac", "evidence", rounded("hdl_mgdl"))


@query(f"""
    SELECT p.cohort, CASE WHEN t.is_carrier THEN 'Carrier' WHEN t.has_vus THEN 'VUS ' || {_BAND} ELSE 'Non Carrier' END AS carrier,
      CASE WHEN t.is_carrier THEN 'Carrier' WHEN t.has_vus THEN 'VUS' ELSE 'Non Carrier' END AS carrier_simple,
      count(*) AS n, count(p.hdl_mgdl) AS n_value
    FROM pheno p LEFT JOIN (FROM status WHERE trait = 'High HDL') t ON t.subject = p.subject AND t.cohort = p.cohort
    LEFT JOIN (FROM lowest WHERE trait = 'High HDL') w ON w.subject = p.subject AND w.cohort = p.cohort
    GROUP BY ALL""")
def vus_bands(spark, d):
    pheno, carriers, genes = _study(spark, d)
    out = C.annotate_carriers(pheno.select("subject", "cohort", "hdl_mgdl"), carriers, genes, "High HDL", vus="stratify")
    return out.groupBy("cohort", "carrier", "carrier_simple").agg(
        F.count(F.lit(1)).alias("n"), F.count("hdl_mgdl").alias("n_value"))


@query("""
    SELECT p.cohort, CASE WHEN t.is_carrier THEN 'Carrier' WHEN t.has_vus THEN NULL ELSE 'Non Carrier' END AS carrier,
      count(*) AS n, count(r.variant) AS n_variant_rows
    FROM pheno p LEFT JOIN (FROM status WHERE trait = 'Obesity') t ON t.subject = p.subject AND t.cohort = p.cohort
    LEFT JOIN (FROM relevant WHERE trait = 'Obesity') r ON r.subject = p.subject AND r.cohort = p.cohort GROUP BY ALL""")
def every_variant_without_vus(spark, d):
    """Uncollapsed annotation: one row per carried variant, VUS carriers unlabelled."""
    pheno, carriers, genes = _study(spark, d)
    out = C.annotate_every_variant(pheno.select("subject", "cohort"), carriers, genes, "Obesity", vus="remove")
    return out.groupBy("cohort", "carrier").agg(
        F.count(F.lit(1)).alias("n"), F.count("variant").alias("n_variant_rows"))


@query(f"""
    SELECT c.cohort, trait, count(DISTINCT variant) AS number_variants, count(DISTINCT subject) AS number_carriers,
      round(count(DISTINCT subject) / any_value(n)::DOUBLE * 100, 6) AS percent_carriers
    FROM carriers c JOIN (SELECT cohort, count(*) AS n FROM pheno GROUP BY cohort) s ON s.cohort = c.cohort
    WHERE NOT {_EXTENDED} AND lower(level) IN ({PATH}) GROUP BY c.cohort, trait""")
def carrier_count_by_condition(spark, d):
    pheno, carriers, _ = _study(spark, d)
    path = carriers.where(F.lower("level").isin(list(S.PATH_LEVELS)))
    out = N.carrier_count_by_condition(pheno, path)
    return out.select("cohort", "trait", "number_variants", "number_carriers", rounded("percent_carriers"))


def _side_by_side(cells: dict[str, str]) -> str:
    """SQL: a column for each cell and cohort."""
    return ", ".join(f"max({expr}) FILTER (WHERE cohort = '{c}') AS \"{name}_{c}\"" for c in _SEGMENTS for name, expr in cells.items())


@query(f"""
    WITH counted AS (
      SELECT c.cohort, trait, count(DISTINCT variant) AS v, count(DISTINCT subject) AS s,
        round(count(DISTINCT subject) / any_value(n)::DOUBLE * 100, 6) AS p
      FROM carriers c JOIN (SELECT cohort, count(*) AS n FROM pheno GROUP BY cohort) q ON q.cohort = c.cohort
      WHERE NOT {_EXTENDED} GROUP BY c.cohort, trait)
    SELECT trait, {_side_by_side({"number_variants": "v", "number_carriers": "s", "percent_carriers": "p"})}
    FROM counted GROUP BY trait""")
def conditions_side_by_side(spark, d):
    pheno, carriers, _ = _study(spark, d)
    out = N.cohorts_side_by_side(N.carrier_count_by_condition(pheno, carriers), list(_SEGMENTS))
    return out.withColumns({c: rounded(f"percent_carriers_{x}") for x in _SEGMENTS for c in [f"percent_carriers_{x}"]})


@query(f"""
    WITH seen AS (SELECT DISTINCT cohort, {_REVIEWED} AS e, variant_b37 FROM carriers),
    cells AS (SELECT coalesce(cohort, 'Both') AS cohort, e, grouping(e) AS ge, count(DISTINCT variant_b37) AS n
      FROM seen GROUP BY GROUPING SETS ((cohort, e), (cohort), (e), ()))
    SELECT cohort, max(n) FILTER (WHERE e = 'ClinVar and Reviews') AS "ClinVar and Reviews",
      max(n) FILTER (WHERE e = 'LOF') AS "LOF", max(n) FILTER (WHERE ge = 1) AS total FROM cells GROUP BY cohort""")
def variant_count_both(spark, d):
    return N.variant_count_table(V.carriers(spark, d))


@query(f"""
    WITH seen AS (SELECT DISTINCT cohort, {_REVIEWED} AS e, variant_b37, lower(level) IN ({PATH}) AS p FROM carriers),
    twice AS (SELECT cohort, e, variant_b37, p FROM seen UNION ALL SELECT 'Both', e, variant_b37, p FROM seen)
    SELECT cohort,
      count(DISTINCT variant_b37) FILTER (WHERE e = 'ClinVar and Reviews') AS "ClinVar and Reviews curated",
      count(DISTINCT variant_b37) FILTER (WHERE e = 'LOF') AS "LOF curated",
      count(DISTINCT variant_b37) AS "total curated",
      count(DISTINCT variant_b37) FILTER (WHERE p AND e = 'ClinVar and Reviews') AS "ClinVar and Reviews pathogenic",
      count(DISTINCT variant_b37) FILTER (WHERE p AND e = 'LOF') AS "LOF pathogenic",
      count(DISTINCT variant_b37) FILTER (WHERE p) AS "total pathogenic"
    FROM twice GROUP BY cohort""")
def curated_and_path_variant_counts(spark, d):
    return N.curated_and_path_counts(V.carriers(spark, d))


@query("""
    SELECT cohort, evidence, variant, variant_b37, gene, trait, level, round(af, 8) AS af, ac, count(*) AS carrier_count
    FROM (SELECT DISTINCT cohort, subject, evidence, variant, variant_b37, gene, trait, level, af, ac FROM carriers)
    GROUP BY ALL""")
def variant_list_counts(spark, d):
    out = H.variant_list(V.carriers(spark, d))
    return out.select("cohort", "evidence", "variant", "variant_b37", "gene", "trait", "level",
                      rounded("af", 8), "ac", "carrier_count")


@query(f"""
    SELECT variant_b37, trait, evidence AS variant_type, gene, lower(level) AS level,
      coalesce(string_agg(DISTINCT notes, ', ' ORDER BY notes), '') AS notes,
      {", ".join(f"nullif(count(*) FILTER (WHERE cohort = '{c}'), 0) AS \"{c}\"" for c in _SEGMENTS)},
      any_value(p_name) AS assessment
    FROM carriers JOIN part ON p_partkey = CAST(variant AS BIGINT)
    WHERE NOT {_EXTENDED} GROUP BY variant_b37, trait, evidence, gene, lower(level)""")
def final_variant_table(spark, d):
    carriers = V.carriers(spark, d)
    evidence = F.explode(F.array(F.lit("Review"), F.lit("LOF"), F.lit("ClinVar")))
    assessments = V.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("variant_b37"), evidence.alias("variant_type"),
        F.col("p_name").alias("assessment"))
    return N.final_variant_table(carriers, list(_SEGMENTS), assessments)


@query("""SELECT c.cohort, c.trait, count(*) AS n FROM carriers c
    JOIN (SELECT CAST(p_partkey AS VARCHAR) AS variant, p_size > 25 AS failed FROM part) q ON q.variant = c.variant
    WHERE NOT failed GROUP BY ALL""")
def carrier_quality_filter(spark, d):
    from carrierlab.operators.genotypes import quality_filter

    quality = V.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("variant"), (F.col("p_size") > 25).alias("failed"))
    kept = quality_filter(V.carriers(spark, d), quality, ["variant"])
    return kept.groupBy("cohort", "trait").agg(F.count(F.lit(1)).alias("n"))


_DISPLAY = "CASE trait WHEN 'Obesity' THEN 'Monogenic obesity' WHEN 'MODY Extended' THEN 'MODY extended' ELSE trait END"


@query(f"""
    SELECT {_DISPLAY} AS trait,
      CASE WHEN lower(level) IN ({PATH}) THEN 'Pathogenic' ELSE 'Excluded' END || ' ' || {_REVIEWED} AS category,
      cohort, count(*) AS count
    FROM (SELECT DISTINCT evidence, variant, gene, level, trait, cohort FROM carriers WHERE NOT {_EXTENDED}) GROUP BY ALL""")
def variants_per_condition(spark, d):
    pheno, carriers, _ = _study(spark, d)
    return N.variants_per_condition(H.phenotypes_of_carriers(pheno.select("subject", "cohort"), carriers))


@query(f"""
    WITH cells AS (
      SELECT trait, ancestry, evidence, count(*) AS n FROM (
        SELECT DISTINCT c.subject, variant, {_DISPLAY} AS trait, ancestry, {_REVIEWED} AS evidence
        FROM carriers c JOIN pheno p ON p.subject = c.subject AND p.cohort = c.cohort
        WHERE NOT {_EXTENDED} AND lower(level) IN ({PATH})) GROUP BY ALL)
    SELECT trait, ancestry, evidence, n,
      round(n / sum(n) OVER (PARTITION BY trait, evidence)::DOUBLE * 100, 6) AS frequency FROM cells""")
def ancestry_share(spark, d):
    pheno, carriers, _ = _study(spark, d)
    joined = H.phenotypes_of_carriers(pheno.select("subject", "cohort", "ancestry"), carriers, S.PATH_LEVELS)
    return N.carrier_ancestry(joined).select("trait", "ancestry", "evidence", "n", rounded("frequency"))


@query("""SELECT ancestry, count(*) AS n, round(count(*) / (SELECT count(*) FROM pheno)::DOUBLE * 100, 6) AS frequency
    FROM pheno GROUP BY ancestry""")
def cohort_ancestry(spark, d):
    out = N.cohort_ancestry(V.prepared_phenotypes(spark, d))
    return out.select("ancestry", "n", rounded("frequency"))


_CELLS = [m for x in N.MEASURES for m in (f"{x}_mean", f"{x}_sd")]
_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _characteristics_sql() -> str:
    groups = ("UKB", "AMP-T2D control", "AMP-T2D case")
    cells = {"Female": "count(*) FILTER (WHERE sex <> 1)", "Male": "count(*) FILTER (WHERE sex = 1)"}
    for m in N.MEASURES:
        cells[f"{m}_mean"] = f"avg({m})"
        cells[f"{m}_sd"] = f"stddev_samp({m})"
    for r in _REGIONS:
        cells[r] = f"nullif(count(*) FILTER (WHERE a = '{r}'), 0)"
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS rowname, g, round(CAST({expr} AS DOUBLE), 4) AS v FROM base GROUP BY g"
        for name, expr in cells.items())
    picks = ", ".join(f"max(v) FILTER (WHERE g = '{g}') AS \"{g}\"" for g in groups)
    return f"""WITH base AS (
      SELECT *, CASE WHEN cohort = 'BUILDING' THEN 'UKB' WHEN t2d = 0 THEN 'AMP-T2D control'
        WHEN t2d = 1 THEN 'AMP-T2D case' END AS g,
        CASE WHEN cohort = 'BUILDING' THEN 'EUROPE' ELSE ancestry END AS a FROM pheno),
      cells AS ({rows})
      SELECT rowname, {picks} FROM cells GROUP BY rowname"""


@query(_characteristics_sql())
def participant_characteristics(spark, d):
    ancestry = F.when(F.col("cohort") == "BUILDING", "EUROPE").otherwise(F.col("ancestry"))
    groups = ["UKB", "AMP-T2D control", "AMP-T2D case"]
    out = N.participant_characteristics(
        V.prepared_phenotypes(spark, d), N.participant_group("BUILDING"), groups, ancestry, _REGIONS)
    return out.select("rowname", *[rounded(F.col(f"`{g}`"), 4, g) for g in groups])


# --- means -----------------------------------------------------------------

def _means_sql(gene: str = "") -> str:
    cols = f", {gene} AS gene" if gene else ""
    return f"""
    SELECT s.condition, s.association_trait AS phenotype, s.no_meds AS lipidmeds, p.cohort, {_LABEL} AS carrier{cols},
      count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd,
      round(stddev_samp(v) / sqrt(count(v)), 4) AS se
    FROM long_pheno p JOIN mean_settings s ON s.phenotype = p.phenotype
    LEFT JOIN status t ON t.subject = p.subject AND t.cohort = p.cohort AND t.trait = s.trait {_LOWEST if gene else ''}
    WHERE NOT s.no_meds OR p.lipidmeds = 0 GROUP BY ALL HAVING count(v) > 0"""


_MEAN_COLUMNS = ["condition", "phenotype", "lipidmeds", "cohort", "carrier"]


@query(_means_sql())
def mean_sd_se(spark, d):
    out = P.carrier_means(*_study(spark, d), conf=None).where(F.col("n") > 0)
    return out.select(*_MEAN_COLUMNS, "n", rounded("mean", 4), rounded("sd", 4), rounded("se", 4))


@query(_means_sql("CASE WHEN t.is_carrier THEN w.gene ELSE 'Non Carrier' END"))
def mean_by_gene(spark, d):
    out = P.carrier_means(*_study(spark, d), conf=None, by_gene=True).where(F.col("n") > 0)
    return out.select(*_MEAN_COLUMNS, "gene", "n", rounded("mean", 4), rounded("sd", 4), rounded("se", 4))


@query(f"""
    WITH m AS ({_means_sql()})
    SELECT condition, cohort, max(n) FILTER (WHERE carrier = 'Carrier') AS "n_Carrier",
      max(mean) FILTER (WHERE carrier = 'Carrier') AS "mean_Carrier",
      max(n) FILTER (WHERE carrier = 'Non Carrier') AS "n_Non Carrier",
      max(mean) FILTER (WHERE carrier = 'Non Carrier') AS "mean_Non Carrier"
    FROM m GROUP BY condition, cohort""")
def pivot_mean(spark, d):
    means = P.carrier_means(*_study(spark, d), conf=None).where(F.col("n") > 0)
    wide = P.spread(means, ["condition", "cohort"], "carrier", ["Carrier", "Non Carrier"], ["n", "mean"])
    return wide.select("condition", "cohort", "n_Carrier", rounded("mean_Carrier", 4),
                       "n_Non Carrier", rounded(F.col("`mean_Non Carrier`"), 4, "mean_Non Carrier"))


@query(_means_sql().replace("p.cohort, CASE", "p.cohort, y.ancestry AS subset, CASE").replace(
    "WHERE NOT s.no_meds", "JOIN pheno0 y ON y.subject = p.subject WHERE NOT s.no_meds"))
def mean_by_subset(spark, d):
    out = P.carrier_means(*_study(spark, d), conf=None, subset="ancestry").where(F.col("n") > 0)
    return out.select(*_MEAN_COLUMNS, "subset", "n", rounded("mean", 4), rounded("sd", 4), rounded("se", 4))


@query("""
    SELECT p.cohort, CASE WHEN t.is_carrier THEN 'C' ELSE 'NC' END AS arm,
      CASE WHEN t.is_carrier THEN m.evidence ELSE 'Non Carrier' END AS evidence, count(*) AS n,
      round(avg(p.tg_mgdl), 4) AS mean, any_value(r.p_value) AS p_value
    FROM pheno p LEFT JOIN (FROM status WHERE trait = 'High triglycerides') t ON t.subject = p.subject AND t.cohort = p.cohort
    LEFT JOIN (FROM lowest WHERE trait = 'High triglycerides') w ON w.subject = p.subject AND w.cohort = p.cohort
    LEFT JOIN merged_evidence m ON m.subject = w.subject AND m.cohort = w.cohort AND m.trait = w.trait AND m.variant = w.variant
    LEFT JOIN (SELECT c_mktsegment AS cohort, count(*)::DOUBLE AS p_value FROM customer GROUP BY 1) r ON r.cohort = p.cohort
    WHERE p.lipidmeds = 0 GROUP BY ALL""")
def condition_points(spark, d):
    pheno, carriers, genes = _study(spark, d)
    results = V.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("cohort")).agg(
        F.count(F.lit(1)).cast("double").alias("p_value"))
    points = P.condition_points(pheno, carriers, genes, "High triglycerides", "tg_mgdl", True, results=results)
    return points.groupBy("cohort", "arm", "evidence").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("tg_mgdl"), 4, "mean"), F.max("p_value").alias("p_value"))


@query(f"""
    WITH x AS (SELECT p.cohort, p.bmi, CASE WHEN t.is_carrier THEN 'C' WHEN t.has_vus THEN 'VUS ' || {_BAND} ELSE 'NC' END AS arm
      FROM pheno p LEFT JOIN (FROM status WHERE trait = 'Obesity') t ON t.subject = p.subject AND t.cohort = p.cohort
      LEFT JOIN (FROM lowest WHERE trait = 'Obesity') w ON w.subject = p.subject AND w.cohort = p.cohort)
    SELECT cohort, arm, count(*) AS n, round(avg(bmi), 4) AS mean FROM x WHERE arm IN ('C', 'NC', 'VUS Novel') GROUP BY ALL""")
def condition_points_with_novel_vus(spark, d):
    points = P.condition_points(*_study(spark, d), "Obesity", "bmi", vus="stratify")
    return points.groupBy("cohort", "arm").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("bmi"), 4, "mean"))


@query(f"""WITH RECURSIVE m AS ({_means_sql().replace("round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd", "avg(v) AS mean, stddev_samp(v) AS sd").replace("round(stddev_samp(v) / sqrt(count(v)), 4) AS se", "stddev_samp(v) / sqrt(count(v)) AS se")}),
    {t_multipliers("m")}
    SELECT condition, phenotype, lipidmeds, cohort, carrier, n, round(mean, 4) AS mean, round(mean - t * se, 4) AS low,
      round(mean + t * se, 4) AS high FROM m LEFT JOIN t_value ON v = n - 1""")
def mean_t_ci(spark, d):
    """Means with Student-t intervals."""
    out = P.carrier_means(*_study(spark, d)).where(F.col("n") > 0)
    return out.select(*_MEAN_COLUMNS, "n", rounded("mean", 4), rounded("low", 4), rounded("high", 4))


@query("""
    SELECT p.cohort, CASE WHEN t.is_carrier THEN 'Carrier' ELSE 'Non Carrier' END AS carrier, count(ldl_mgdl) AS n,
      round(quantile_cont(ldl_mgdl, 0.25), 6) AS q1, round(quantile_cont(ldl_mgdl, 0.5), 6) AS median,
      round(quantile_cont(ldl_mgdl, 0.75), 6) AS q3
    FROM pheno p LEFT JOIN (FROM status WHERE trait = 'High LDL') t ON t.subject = p.subject AND t.cohort = p.cohort
    GROUP BY ALL""")
def box_quartiles(spark, d):
    pheno, carriers, genes = _study(spark, d)
    frame = C.annotate_carriers(pheno.select("subject", "cohort", "ldl_mgdl"), carriers, genes, "High LDL")
    out = group_quantiles(frame, ["cohort", "carrier"], "ldl_mgdl", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return out.select("cohort", "carrier", "n", rounded("q1"), rounded("median"), rounded("q3"))


# --- associations ----------------------------------------------------------

_RESULTS_SQL = """
    SELECT replace(trait, ' ', '_') AS Condition, phenotype AS Trait, gene, cohort AS data_source,
      CASE WHEN ancestry = 'ASIA' THEN 'non_pathogenic_no_vus' ELSE 'pathogenic' END AS type,
      CASE ancestry WHEN 'AFRICA' THEN 'covart2d' WHEN 'AMERICA' THEN 'covart2d,covarlipidmeds'
        WHEN 'EUROPE' THEN NULL WHEN 'MIDDLE EAST' THEN 'other' ELSE '' END AS additional_covariates,
      beta, se
    FROM (SELECT c.trait, c.gene, p.cohort, p.ancestry, 'bmi' AS phenotype,
        avg(p.bmi) / 100 AS beta, count(p.bmi) / 10000.0::DOUBLE AS se
      FROM carriers c JOIN pheno p ON p.subject = c.subject GROUP BY c.trait, c.gene, p.cohort, p.ancestry)"""


def _results(spark, d, by_gene=True):
    """Association-like rows: one per trait, (gene,) cohort and ancestry."""
    pheno, carriers, _ = _study(spark, d)
    cells = carriers.select("subject", "trait", "gene").join(
        pheno.select("subject", "cohort", "ancestry", "bmi"), "subject"
    ).withColumn("gene", F.col("gene") if by_gene else F.lit(None).cast("string")).groupBy(
        "trait", "gene", "cohort", "ancestry"
    ).agg(
        (F.avg("bmi") / 100).alias("BETA"), (F.count("bmi") / 10000).alias("SEBETA"))
    return cells.select(
        F.replace(F.col("trait"), F.lit(" "), F.lit("_")).alias("Condition"), F.lit("bmi").alias("Trait"),
        F.col("gene").alias("Gene"), F.lit("All").alias("subset"), F.col("cohort").alias("data_source"),
        F.when(F.col("ancestry") == "ASIA", "non_pathogenic_no_vus").otherwise("pathogenic").alias("type"),
        F.when(F.col("ancestry") == "AFRICA", "covart2d").when(F.col("ancestry") == "AMERICA", "covart2d,covarlipidmeds")
        .when(F.col("ancestry") == "EUROPE", None).when(F.col("ancestry") == "MIDDLE EAST", "other").otherwise("")
        .alias("additional_covariates"),
        "BETA", "SEBETA", F.lit(0.01).alias("PVALUE"),
    )


@query(f"""
    WITH res AS ({_RESULTS_SQL})
    SELECT CASE replace(Condition, '_', ' ') WHEN 'High triglycerides' THEN 'High TG' WHEN 'Obesity' THEN 'Monogenic obesity'
        ELSE replace(Condition, '_', ' ') END AS condition, gene, data_source AS cohort,
      coalesce(additional_covariates, '') NOT IN ('', 'covart2d') AS lipidmeds,
      count(*) AS n, round(sum(exp(beta)), 6) AS or_, round(sum(exp(beta - se)), 6) AS or_low,
      round(sum(exp(beta + se)), 6) AS or_high
    FROM res WHERE type = 'pathogenic' AND (additional_covariates IS NULL
      OR additional_covariates IN ('', 'covart2d', 'covart2d,covarlipidmeds')) GROUP BY ALL""")
def assoc_select_or(spark, d):
    used = A.select_results(_results(spark, d))
    return used.groupBy(
        A.condition_name().alias("condition"), F.col("Gene").alias("gene"),
        F.col("data_source").alias("cohort"), "lipidmeds",
    ).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("or_"), name="or_"),
          rounded(F.sum("or_low"), name="or_low"), rounded(F.sum("or_high"), name="or_high"))


@query(f"""
    WITH res AS ({_RESULTS_SQL}),
    pen AS (SELECT p.*, condition_simple FROM ({_penetrance_sql(_LABEL, "CASE WHEN t.is_carrier THEN w.gene ELSE 'Non Carrier' END", _LOWEST)}) p
      JOIN (SELECT DISTINCT condition, condition_simple FROM outcome_settings) s ON s.condition = p.condition),
    used AS (SELECT *, coalesce(additional_covariates, '') NOT IN ('', 'covart2d') AS lipidmeds,
        CASE replace(Condition, '_', ' ') WHEN 'High triglycerides' THEN 'High TG' WHEN 'Obesity' THEN 'Monogenic obesity'
          ELSE replace(Condition, '_', ' ') END AS name
      FROM res WHERE type = 'pathogenic' AND (additional_covariates IS NULL
        OR additional_covariates IN ('', 'covart2d', 'covart2d,covarlipidmeds'))),
    joined AS (SELECT pen.*, round(u.beta, 6) AS beta FROM pen LEFT JOIN used u ON u.gene = pen.gene AND u.data_source = pen.cohort
        AND u.name = pen.condition_simple AND u.lipidmeds = pen.lipidmeds)
    SELECT condition, lipidmeds, gene, {_side_by_side({"total": "total", "beta": "beta"})}
    FROM joined GROUP BY condition, lipidmeds, gene""")
def assoc_joined_to_penetrance(spark, d):
    """Association results beside the penetrance of all settings, by gene, all cohorts."""
    table = P.penetrance_counts(*_study(spark, d), by_gene=True)
    used = A.select_results(_results(spark, d)).select(
        A.condition_name().alias("condition_simple"), F.col("Gene").alias("gene"), F.col("data_source").alias("cohort"),
        "lipidmeds", rounded("BETA", name="beta"))
    joined = table.join(used, ["condition_simple", "gene", "cohort", "lipidmeds"], "left")
    return P.spread(joined, ["condition", "lipidmeds", "gene"], "cohort", list(_SEGMENTS), ["total", "beta"])


def _three_digits(x: str) -> str:
    """SQL: three significant digits of a number that is not negative, as C's %.3g, halves rounded up."""
    strip = "regexp_replace(regexp_replace({}, '0+$', ''), '\\.$', '')"
    sci = strip.format("CAST(CAST(q[2] / 100 AS DECIMAL(18, 2)) AS VARCHAR)")
    fixed = strip.format("CAST(CAST(q[2] * pow(10, q[1] - 2) AS DECIMAL(18, 6)) AS VARCHAR)")
    rounded_ = "round(v / pow(10, floor(log10(v)) - 2))"
    parts = (f"CASE WHEN {rounded_} >= 1000 THEN [floor(log10(v)) + 1, 100] ELSE [floor(log10(v)), {rounded_}] END")
    exponent = "(CASE WHEN q[1] < 0 THEN 'e-' ELSE 'e+' END || lpad(CAST(CAST(abs(q[1]) AS INTEGER) AS VARCHAR), 2, '0'))"
    text = f"CASE WHEN q[1] < -4 OR q[1] >= 3 THEN {sci} || {exponent} ELSE {fixed} END"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN '0' ELSE list_transform(list_transform([{x}], "
            f"lambda v: {parts}), lambda q: {text})[1] END")


_RAW_MEANS = _means_sql().replace(
    "round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd", "avg(v) AS mean, stddev_samp(v) AS sd").replace(
    "round(stddev_samp(v) / sqrt(count(v)), 4) AS se", "stddev_samp(v) / sqrt(count(v)) AS se")


def _arms_wide(source: str, cells: dict[str, str]) -> str:
    picks = ", ".join(f"max({expr}) FILTER (WHERE carrier = '{arm}' AND cohort = '{c}') AS \"{name}_{arm}_{c}\""
                      for c in _SEGMENTS for arm in ("Carrier", "Non Carrier") for name, expr in cells.items())
    return f"SELECT condition, {picks} FROM {source} GROUP BY condition"


@query(f"""WITH RECURSIVE pen AS ({_penetrance_sql(_LABEL)}), {exact_intervals("pen")},
    m AS ({_RAW_MEANS}), {t_multipliers("m")},
    pen_text AS (SELECT pen.*, {_three_digits("count / total::DOUBLE")} || ' (' || {_three_digits("low")} || '-' || {_three_digits("high")} || ')' AS text
      FROM pen JOIN exact_ci ON k = count AND n = total),
    mean_text AS (SELECT m.*, CASE WHEN t IS NOT NULL THEN printf('%.2f', mean) || '   (' || printf('%.2f', mean - t * se) || '-'
        || printf('%.2f', mean + t * se) || ')' END AS text FROM m LEFT JOIN t_value ON v = n - 1),
    results AS (SELECT trait, cohort, {_three_digits("beta")} || ' (' || {_three_digits("se")} || ')' AS text FROM (
      SELECT c.trait, p.cohort, avg(p.bmi) / 100 AS beta, count(p.bmi) / 10000.0::DOUBLE AS se
      FROM carriers c JOIN pheno p ON p.subject = c.subject WHERE p.ancestry = 'AFRICA' GROUP BY c.trait, p.cohort)),
    wide AS ({_arms_wide("pen_text", {"count": "count", "total": "total", "prop": "text"})}),
    wide_means AS ({_arms_wide("mean_text", {"mean_ci": "text"})}),
    settings AS (SELECT DISTINCT condition, no_meds FROM outcome_settings),
    betas AS (SELECT s.condition, {", ".join(f"max(text) FILTER (WHERE cohort = '{c}') AS \"beta_text_{c}\"" for c in _SEGMENTS)}
      FROM mean_settings s JOIN results r ON r.trait = s.trait WHERE s.association_trait = 'bmi' AND NOT s.no_meds GROUP BY s.condition)
    SELECT wide.*, CASE WHEN no_meds THEN 'Yes' ELSE '' END AS restricted, wide_means.* EXCLUDE (condition), betas.* EXCLUDE (condition)
    FROM wide JOIN settings USING (condition) LEFT JOIN wide_means ON wide_means.condition = wide.condition
    LEFT JOIN betas ON betas.condition = wide.condition""")
def penetrance_published_layout(spark, d):
    """Penetrance and means with association texts, arms and cohorts side by side."""
    pheno, carriers, genes = _study(spark, d)
    results = _results(spark, d, by_gene=False).where(F.col("additional_covariates") == "covart2d")
    table = A.format_penetrance(P.penetrance_table(pheno, carriers, genes), results, _SEGMENTS)
    means = A.format_means(P.carrier_means(pheno, carriers, genes), results, _SEGMENTS)
    arms = [f"{arm}_{c}" for c in _SEGMENTS for arm in ("Carrier", "Non Carrier")]
    return table.alias("b").join(means.alias("m"), "condition", "left").select(
        "condition", "b.restricted", *[F.col(f"b.`{x}_{a}`") for x in ("count", "total", "prop") for a in arms],
        *[F.col(f"m.`mean_ci_{a}`") for a in arms], *[F.col(f"m.`beta_text_{c}`") for c in _SEGMENTS])


# --- cohorts ---------------------------------------------------------------

@query("""
    SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('FURNITURE', 'BUILDING')
      AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 495000)
      AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def usable_samples(spark, d):
    orders = V.table(spark, d, "orders")
    return H.usable_phenotypes(
        V.table(spark, d, "customer"), orders.where(F.col("o_totalprice") > 495000),
        orders.where(F.col("o_orderpriority") == "1-URGENT"), subject="c_custkey", cohort="c_mktsegment",
        forbidden_key="c_custkey", forbidden_id="o_custkey", exome_id="o_custkey",
        removed_cohorts=("FURNITURE", "BUILDING"),
    ).select("c_custkey", "c_mktsegment")


@query("""
    SELECT c_mktsegment || '::' || c_name AS s, c_mktsegment AS project, c_name AS sample,
      c_mktsegment || '::' || c_name NOT IN (SELECT c_mktsegment || '::' || c_name FROM customer WHERE c_acctbal > 0) AS is_forbidden
    FROM customer""")
def sample_flags(spark, d):
    ids = V.table(spark, d, "customer").withColumn("s", F.concat_ws("::", "c_mktsegment", "c_name"))
    return H.sample_flags(ids.select("s"), ids.where(F.col("c_acctbal") > 0), subject="s")


@query("""
    SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_left,
      (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS n_right,
      (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT
        SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) AS n_both""")
def sample_overlap(spark, d):
    orders = V.table(spark, d, "orders")
    return H.overlap_report(orders.where(F.col("o_orderstatus") == "F"),
                            orders.where(F.col("o_orderpriority") == "1-URGENT"), "o_custkey")


@query("""SELECT subject, cohort, round(ldl_mgdl, 6) AS ldl_mgdl, round(ldl_mgdl_adj, 6) AS ldl_mgdl_adj,
    round(tg_mgdl_adj, 6) AS tg_mgdl_adj FROM pheno WHERE ldl_mgdl IS NOT NULL""")
def treatment_adjusted(spark, d):
    out = H.adjust_for_treatment(V.phenotypes(spark, d)).where(F.col("ldl_mgdl").isNotNull())
    return out.select("subject", "cohort", rounded("ldl_mgdl"), rounded("ldl_mgdl_adj"), rounded("tg_mgdl_adj"))


@query("""SELECT cohort, ancestry, t2d, t2d_with_pre, count(*) AS n FROM pheno GROUP BY ALL""")
def diagnosis_flags(spark, d):
    out = H.diagnosis_flags(V.phenotypes(spark, d), base="t2d_base")
    return out.groupBy("cohort", "ancestry", "t2d", "t2d_with_pre").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT subject, coalesce(aod, diagnosed_0, CASE WHEN t2d = 0 THEN age END) AS onset FROM pheno""")
def first_non_null_age(spark, d):
    pheno = V.prepared_phenotypes(spark, d)
    return pheno.select("subject", H.age_at_onset(["aod", "diagnosed_0"]).alias("onset"))


@query("""
    SELECT 'customer' AS cohort, CAST(c_custkey AS VARCHAR) AS subject, c_nationkey AS nation, round(c_acctbal, 2) AS value,
      c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_nationkey, round(s_acctbal, 2), NULL FROM supplier""")
def two_cohort_union(spark, d):
    first = V.table(spark, d, "customer").select(
        F.lit("customer").alias("cohort"), F.col("c_custkey").cast("string").alias("subject"),
        F.col("c_nationkey").alias("nation"), rounded("c_acctbal", 2, "value"), F.col("c_mktsegment").alias("segment"))
    second = V.table(spark, d, "supplier").select(
        F.lit("supplier").alias("cohort"), F.col("s_suppkey").cast("string").alias("subject"),
        F.col("s_nationkey").alias("nation"), rounded("s_acctbal", 2, "value"))
    return H.stack(first, second)


# --- ascertainment ---------------------------------------------------------

_LABELS = {"High LDL": "LDL_High", "Low LDL": "LDL_Low"}
_ARMS = f"""SELECT c.subject, c.cohort, c.trait, c.variant, p.ldl_mgdl, p.ldl_mgdl_adj, p.age, p.sex,
      coalesce(p.esp_phenotype = l.label, false) AS ascertained
    FROM carriers c JOIN (VALUES {", ".join(f"('{t}', '{x}')" for t, x in _LABELS.items())}) l(trait, label) ON l.trait = c.trait
    JOIN pheno p ON p.subject = c.subject AND p.cohort = c.cohort
    WHERE lower(level) IN ({PATH}) AND p.ldl_mgdl IS NOT NULL
      AND NOT coalesce(p.esp_phenotype IN ({quoted(S.ASCERTAINED_PHENOTYPES)}) AND p.esp_phenotype <> l.label, false)"""
_SHARED = """shared AS (SELECT * FROM arms SEMI JOIN (SELECT trait, variant FROM arms GROUP BY trait, variant
      HAVING bool_or(ascertained) AND bool_or(NOT ascertained)) v USING (trait, variant))"""
_ARM_COLUMNS = "subject, cohort, trait, ldl_mgdl, ldl_mgdl_adj, age, sex, ascertained"


def _arm_stats_sql(source: str, columns: str) -> str:
    return f"""SELECT trait, ascertained, count(*) AS n, round(avg(ldl_mgdl_adj), 4) AS mean,
      round(stddev_samp(ldl_mgdl_adj), 4) AS sd, round(stddev_samp(ldl_mgdl_adj) / sqrt(count(*)), 4) AS se
    FROM (SELECT DISTINCT {columns} FROM {source}) GROUP BY trait, ascertained"""


def _arms(spark, d, shared=False):
    """Arms of both conditions."""
    pheno, carriers, _ = _study(spark, d)
    joined = H.phenotypes_of_carriers(
        pheno.select("subject", "cohort", "ldl_mgdl", "ldl_mgdl_adj", "age", "sex", "esp_phenotype"),
        carriers, S.PATH_LEVELS)
    frames = [arm_frame(joined, trait, label) for trait, label in _LABELS.items()]
    frames = [shared_variants(f) for f in frames] if shared else frames
    return frames[0].unionByName(frames[1])


def _stats(frame, columns):
    out = arm_statistics(frame, "ldl_mgdl_adj", columns, ["trait"], conf=None)
    return out.select("trait", "ascertained", "n", rounded("mean", 4), rounded("sd", 4), rounded("se", 4))


@query("WITH arms AS (" + _ARMS + ") " + _arm_stats_sql("arms", _ARM_COLUMNS))
def ascertainment_arms(spark, d):
    return _stats(_arms(spark, d), ["subject", "cohort", "trait", "ldl_mgdl", "age", "sex"])


@query("WITH arms AS (" + _ARMS + "), " + _SHARED + " " + _arm_stats_sql("shared", _ARM_COLUMNS + ", variant"))
def shared_variant_stats(spark, d):
    return _stats(_arms(spark, d, True), ["subject", "cohort", "trait", "variant", "ldl_mgdl", "age", "sex"])


@query(" UNION ALL ".join(f"""SELECT '{trait}' AS trait, cohort, count(*) AS n, round(avg(ldl_mgdl), 4) AS mean FROM pheno
    WHERE subject NOT IN (SELECT subject FROM carriers WHERE lower(level) IN ({PATH}) AND trait = '{trait}')
      AND coalesce(esp_phenotype NOT IN ({quoted(S.ASCERTAINED_PHENOTYPES)}), true) GROUP BY cohort""" for trait in _LABELS))
def non_carrier_arm(spark, d):
    pheno, carriers, _ = _study(spark, d)
    out = None
    for trait in _LABELS:
        path = carriers.where(F.lower("level").isin(list(S.PATH_LEVELS)) & (F.col("trait") == trait))
        part = non_carriers(pheno, path).groupBy(F.lit(trait).alias("trait"), "cohort").agg(
            F.count(F.lit(1)).alias("n"), rounded(F.avg("ldl_mgdl"), 4, "mean"))
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH arms AS (" + _ARMS + "), stats AS (" + _arm_stats_sql("arms", _ARM_COLUMNS) + "), " + _SHARED
       + ", shared_stats AS (" + _arm_stats_sql("shared", _ARM_COLUMNS + ", variant")
       + ") SELECT * FROM stats UNION SELECT * FROM shared_stats")
def union_distinct_stats(spark, d):
    """Statistics rows of both selections stacked as a set."""
    all_rows = _stats(_arms(spark, d), ["subject", "cohort", "trait", "ldl_mgdl", "age", "sex"])
    shared = _stats(_arms(spark, d, True), ["subject", "cohort", "trait", "variant", "ldl_mgdl", "age", "sex"])
    return all_rows.union(shared).distinct()


@query("""SELECT CASE e WHEN 'ClinVar, LOF' THEN 'ClinVar and LOF' WHEN 'LOF, Review' THEN 'LOF and Review' ELSE e END AS evidence,
      count(*) AS n FROM (SELECT string_agg(DISTINCT evidence, ', ' ORDER BY evidence) AS e FROM carriers GROUP BY subject, trait) GROUP BY 1""")
def evidence_combinations(spark, d):
    per = V.carriers(spark, d).groupBy("subject", "trait").agg(
        F.concat_ws(", ", F.sort_array(F.collect_set("evidence"))).alias("e"))
    return per.groupBy(rename_evidence("e").alias("evidence")).agg(F.count(F.lit(1)).alias("n"))
