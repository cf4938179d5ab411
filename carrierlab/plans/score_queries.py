"""Queries: scores, regression and survival."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions.ranks import with_tiles
from carrierlab.operators import models as M
from carrierlab.operators import scores as R
from carrierlab.operators.carriers import annotate_carriers
from carrierlab.operators.survival import diagnosis_curves as curves_by_gene
from carrierlab.operators.survival import kaplan_meier as km
from carrierlab.plans import views as V
from carrierlab.plans.registry import query, rounded

_HIGH_LDL = replace(S.score_settings()[2])
_LOW_LDL_UNMEDICATED = replace(S.score_settings()[1])
_MODY = replace(S.score_settings()[-1])

# Frame of one score analysis: carriers are exempt from the age filter, tiles
# are over everybody left.
_FRAME_SQL = """
    scored AS (SELECT *, (score - avg(score) OVER ()) / stddev_samp(score) OVER () AS z FROM pheno),
    frame AS (
      SELECT p.subject, p.cohort, p.age, p.sex, CAST({value} AS DOUBLE) AS phenotype_value, {sign} * z AS prs,
        CASE WHEN t.is_carrier THEN 'Carrier' ELSE 'Non Carrier' END AS carrier
      FROM scored p LEFT JOIN (FROM status WHERE trait = '{trait}') t ON t.subject = p.subject AND t.cohort = p.cohort
      WHERE {value} IS NOT NULL {meds} AND (p.age >= 40 OR t.is_carrier)),
    tiled AS (SELECT *, CAST(ntile(4) OVER w AS INTEGER) AS quantile, ntile(10) OVER w AS decile, ntile(40) OVER w AS forty,
      ntile(100) OVER w AS percentile FROM frame WINDOW w AS (ORDER BY prs, subject))"""
_HIGH_FRAME = _FRAME_SQL.format(value="ldl_mgdl", sign=1, trait="High LDL", meds="")
_LOW_FRAME = _FRAME_SQL.format(value="ldl_mgdl", sign=-1, trait="Low LDL", meds="AND p.lipidmeds = 0")
_MODY_FRAME = _FRAME_SQL.format(value="t2d", sign=1, trait="MODY", meds="")


def _frame(spark, d, setting, by_gene=False):
    pheno = V.prepared_phenotypes(spark, d)
    scores = pheno.select("subject", "score")
    return R.score_frame(
        pheno.drop("score"), scores, V.carriers(spark, d), V.gene_traits(spark, d), setting,
        age_cutoff=40, by_gene=by_gene, tie=F.col("subject"), covariates=("age", "sex"))


@query("""SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS z FROM orders""")
def score_z(spark, d):
    return R.standardised(V.table(spark, d, "orders"), "o_totalprice", "z").select("o_orderkey", rounded("z"))


@query("""SELECT o_orderkey, CAST(ntile(4) OVER w AS INTEGER) AS quantile, CAST(ntile(40) OVER w AS INTEGER) AS forty,
      CAST(ntile(100) OVER w AS INTEGER) AS percentile
    FROM orders WINDOW w AS (ORDER BY o_totalprice, o_orderkey)""")
def score_tiles(spark, d):
    tiles = {"quantile": 4, "forty": 40, "percentile": 100}
    return with_tiles(V.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", tiles).select(
        "o_orderkey", *tiles)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, decile FROM (
      SELECT *, CAST(ntile(10) OVER (ORDER BY l_quantity, (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey) AS INTEGER) AS decile
      FROM lineitem)""")
def heavily_tied_tiles(spark, d):
    """Tiles over a value with 50 distinct levels; rows equal in all four columns may swap tiles."""
    lines = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    tie = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + F.col("l_partkey")
    return with_tiles(lines.withColumn("_tie", tie), "l_quantity", "_tie", {"decile": 10}).drop("_tie")


_SUMMARY = """count(*) AS n, round(avg(phenotype_value), 4) AS mean, round(stddev_samp(phenotype_value), 4) AS sd,
      round(stddev_samp(phenotype_value) / sqrt(count(*)), 4) AS se"""


@query(f"""WITH {_HIGH_FRAME}
    SELECT CAST(percentile AS VARCHAR) AS percentile, 'gePS percentile' AS color, {_SUMMARY} FROM tiled GROUP BY percentile
    UNION ALL SELECT 'C', 'Carrier', {_SUMMARY} FROM tiled WHERE carrier = 'Carrier' HAVING count(*) > 0""")
def score_percentile_means(spark, d):
    out = R.percentile_means(_frame(spark, d, _HIGH_LDL), conf=None)
    return out.select("percentile", "color", "n", rounded("mean", 4), rounded("sd", 4), rounded("se", 4))


@query(f"""WITH {_HIGH_FRAME}
    SELECT CAST(decile AS VARCHAR) AS decile, 'gePS percentile' AS color, {_SUMMARY} FROM tiled GROUP BY decile
    UNION ALL SELECT gene, 'Carrier', {_SUMMARY} FROM tiled x JOIN (FROM lowest WHERE trait = 'High LDL') w
      ON w.subject = x.subject AND w.cohort = x.cohort WHERE carrier = 'Carrier' GROUP BY gene""")
def score_means_by_carried_gene(spark, d):
    out = R.percentile_means(_frame(spark, d, _HIGH_LDL, by_gene=True), tile="decile", by_gene=True, conf=None)
    return out.select("decile", "color", "n", rounded("mean", 4), rounded("sd", 4), rounded("se", 4))


@query(f"""WITH {_MODY_FRAME}
    SELECT CAST(forty AS VARCHAR) AS forty, count(*) AS n, count(*) FILTER (WHERE phenotype_value = 1) AS x,
      round(avg(phenotype_value), 4) AS mean FROM tiled GROUP BY forty
    UNION ALL SELECT 'C', count(*), count(*) FILTER (WHERE phenotype_value = 1), round(avg(phenotype_value), 4) FROM tiled
      WHERE carrier = 'Carrier' HAVING count(*) > 0""")
def score_forty_proportions(spark, d):
    out = R.percentile_means(_frame(spark, d, _MODY), tile="forty", binary=True)
    return out.select("forty", "n", "x", rounded("mean", 4))


@query(f"""WITH {_HIGH_FRAME}
    SELECT DISTINCT carrier, quantile, round(phenotype_value, 6) AS phenotype_value,
      round(cume_dist() OVER (PARTITION BY carrier, quantile ORDER BY phenotype_value), 6) AS ecdf
    FROM tiled WHERE quantile IN (1, 4)""")
def ecdf_quartiles(spark, d):
    out = R.quartile_distributions(_frame(spark, d, _HIGH_LDL))
    return out.select("carrier", "quantile", rounded("phenotype_value"), rounded("ecdf"))


@query(f"""WITH {_LOW_FRAME}
    SELECT grouping, {_SUMMARY} FROM (SELECT *, CASE WHEN percentile = 100 THEN 'top_1' WHEN quantile IN (2, 3) THEN 'interquartile' END AS grouping
      FROM tiled WHERE carrier <> 'Carrier') WHERE grouping IS NOT NULL GROUP BY grouping""")
def interquartile_vs_top1(spark, d):
    from carrierlab.operators.penetrance import mean_summary

    groups = R.score_groups(_frame(spark, d, _LOW_LDL_UNMEDICATED))
    out = mean_summary(groups, ["grouping"], "phenotype_value", conf=None)
    return out.select("grouping", "n", rounded("mean", 4), rounded("sd", 4), rounded("se", 4))


# --- models ----------------------------------------------------------------

def _coefficients(table):
    return table.select("variable", rounded("estimate", 4), rounded("std_error", 4), rounded("statistic", 3))


@query("""
    WITH m AS (SELECT regr_slope(ldl_mgdl, age) AS b, regr_intercept(ldl_mgdl, age) AS a, regr_sxx(ldl_mgdl, age) AS sxx,
        regr_syy(ldl_mgdl, age) AS syy, regr_sxy(ldl_mgdl, age) AS sxy, regr_avgx(ldl_mgdl, age) AS mx, regr_count(ldl_mgdl, age) AS n FROM pheno),
    e AS (SELECT *, sqrt((syy - b * sxy) / (n - 2) / sxx) AS sb FROM m),
    f AS (SELECT *, sqrt((syy - b * sxy) / (n - 2) * (1.0::DOUBLE / n + mx * mx / sxx)) AS sa FROM e)
    SELECT '(Intercept)' AS variable, round(a, 4) AS estimate, round(sa, 4) AS std_error, round(a / sa, 3) AS statistic FROM f
    UNION ALL SELECT 'age', round(b, 4), round(sb, 4), round(b / sb, 3) FROM f""")
def ols_coefficients(spark, d):
    return _coefficients(M.fit_glm(V.prepared_phenotypes(spark, d), "ldl_mgdl", ["age"]))


_TWO_BY_TWO = """SELECT count(*) FILTER (WHERE c AND y = 1)::DOUBLE AS n11, count(*) FILTER (WHERE c AND y = 0)::DOUBLE AS n10,
      count(*) FILTER (WHERE NOT c AND y = 1)::DOUBLE AS n01, count(*) FILTER (WHERE NOT c AND y = 0)::DOUBLE AS n00
    FROM (SELECT coalesce(t.is_carrier, false) AS c, t2d AS y FROM pheno p
      LEFT JOIN (FROM status WHERE trait = 'MODY') t ON t.subject = p.subject AND t.cohort = p.cohort WHERE t2d IS NOT NULL)"""


def _mody_frame(spark, d):
    frame = annotate_carriers(
        V.prepared_phenotypes(spark, d).select("subject", "cohort", "t2d"), V.carriers(spark, d), V.gene_traits(spark, d), "MODY")
    return M.treatment_coded(frame, "carrier", "Non Carrier", "Carrier", "carrierCarrier")


@query(f"""WITH m AS ({_TWO_BY_TWO}), f AS (SELECT ln(n01 / n00) AS a, sqrt(1 / n01 + 1 / n00) AS sa,
      ln(n11 * n00 / (n10 * n01)) AS b, sqrt(1 / n11 + 1 / n10 + 1 / n01 + 1 / n00) AS sb FROM m)
    SELECT '(Intercept)' AS variable, round(a, 4) AS estimate, round(sa, 4) AS std_error, round(a / sa, 3) AS statistic FROM f
    UNION ALL SELECT 'carrierCarrier', round(b, 4), round(sb, 4), round(b / sb, 3) FROM f""")
def logit_coefficients(spark, d):
    return _coefficients(M.fit_glm(_mody_frame(spark, d), "t2d", ["carrierCarrier"], "binomial"))


@query(f"""WITH m AS ({_TWO_BY_TWO}), f AS (SELECT ln(n11 * n00 / (n10 * n01)) AS b, sqrt(1 / n11 + 1 / n10 + 1 / n01 + 1 / n00) AS s FROM m)
    SELECT round(exp(b), 4) AS odds_ratio, round(exp(b - 1.959963984540054::DOUBLE * s), 4) AS low,
      round(exp(b + 1.959963984540054::DOUBLE * s), 4) AS high FROM f""")
def odds_ratio_wald(spark, d):
    fitted = M.fit_glm(_mody_frame(spark, d), "t2d", ["carrierCarrier"], "binomial")
    out = M.odds_ratio_interval(fitted.where(F.col("variable") == "carrierCarrier"))
    return out.select(rounded("odds_ratio", 4), rounded("low", 4), rounded("high", 4))


@query(f"""WITH {_HIGH_FRAME},
    g AS (SELECT carrier, regr_slope(phenotype_value, prs) AS b, regr_intercept(phenotype_value, prs) AS a, regr_sxx(phenotype_value, prs) AS sxx,
      regr_syy(phenotype_value, prs) - regr_slope(phenotype_value, prs) * regr_sxy(phenotype_value, prs) AS sse,
      avg(prs) AS mx, count(*) AS n FROM tiled GROUP BY carrier),
    s AS (SELECT sum(sse) / (sum(n) - 4) AS v FROM g),
    c AS (FROM g WHERE carrier = 'Carrier'), nc AS (FROM g WHERE carrier = 'Non Carrier'),
    t AS (SELECT '(Intercept)' AS variable, nc.a AS estimate, sqrt(v * (1.0::DOUBLE / nc.n + nc.mx * nc.mx / nc.sxx)) AS se FROM nc, s
      UNION ALL SELECT 'carrierCarrier', c.a - nc.a, sqrt(v * (1.0::DOUBLE / nc.n + nc.mx * nc.mx / nc.sxx + 1.0::DOUBLE / c.n + c.mx * c.mx / c.sxx)) FROM c, nc, s
      UNION ALL SELECT 'prs', nc.b, sqrt(v / nc.sxx) FROM nc, s
      UNION ALL SELECT 'carrierCarrier:prs', c.b - nc.b, sqrt(v * (1 / nc.sxx + 1 / c.sxx)) FROM c, nc, s)
    SELECT variable, round(estimate, 4) AS estimate, round(se, 4) AS std_error, round(estimate / se, 3) AS statistic FROM t""")
def interaction_model(spark, d):
    frame = _frame(spark, d, _HIGH_LDL)
    return _coefficients(R.score_models(frame, _HIGH_LDL, (), ["interaction"])["interaction"])


# Ten made-up components besides age and sex, so that models have twelve covariates.
_PCS = {f"pc{i}": p for i, p in enumerate((7, 11, 13, 17, 19, 23, 29, 31, 37, 41), 1)}
_P = 16  # terms of the widest model, the intercept included


def _solved(source: str, weight: str, z: str, columns: str) -> str:
    """Normal equations of each group of ``source``, inverted: rows [.., coefficient, inverse] in one matrix."""
    rows = []
    for i in range(1, _P + 1):
        cells = [f"sum({weight} * x[{i}] * x[{k}])" for k in range(1, _P + 1)]
        cells[i - 1] = f"CASE WHEN {cells[i - 1]} = 0 THEN 1 ELSE {cells[i - 1]} END"  # a padded term
        unit = ["1" if k == i else "0" for k in range(1, _P + 1)]
        rows.append("[" + ", ".join(f"({c})::DOUBLE" for c in [*cells, f"sum({weight} * x[{i}] * {z})", *unit]) + "]")
    k = "CAST(e[1][1] AS INTEGER)"
    step = (f"list_transform(a, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / r[{k}]) "
            f"ELSE list_transform(r, lambda v, j: v - r[{k}] * a[{k}][j] / a[{k}][{k}]) END)")
    return (f"SELECT {columns}, list_reduce([m] || list_transform(range(1, {_P + 1}), lambda k: [[k::DOUBLE]]), "
            f"lambda a, e: {step}) AS s, n, rest, used FROM (SELECT {columns}, [{', '.join(rows)}] AS m, count(*) AS n, "
            f"sum({weight} * {z} * {z}) AS rest, "
            + " + ".join(f"CAST(sum(abs(x[{i}])) > 0 AS INTEGER)" for i in range(1, _P + 1))
            + f" AS used FROM {source} GROUP BY ALL)")


def _models_sql() -> str:
    values = ", ".join(
        f"({i}, '{s.trait}', '{s.phenotype}', {str(s.no_meds).lower()}, {str(s.lower_is_worse).lower()}, {str(s.binary).lower()})"
        for i, s in enumerate(S.score_settings()))
    covariates = ", ".join(["age", "sex", *(f"subject * {p} % 97 / 48.0::DOUBLE - 1" for p in _PCS.values())])
    names = ["age", "sex", *_PCS]

    def model(name: str, variables: list[str], first: str, last: str, where: str) -> str:
        x = ", ".join(["1", first, covariates, *([last] if last else []), *["0"] * (_P - 1 - len(variables))])
        listed = ", ".join(f"'{v}'" for v in ["(Intercept)", *variables])
        return (f"SELECT '{name}' AS model, setting, trait, no_meds, {'is_binary' if name in R.MODELS[:2] else 'false'} AS logit, "
                f"[{listed}] AS names, y, [{x}]::DOUBLE[] AS x FROM tiled WHERE {where} AND age IS NOT NULL AND sex IS NOT NULL")

    c = "CAST(c AS INTEGER)"
    columns = "model, setting, trait, no_meds, names"
    beta = "list_dot_product(x, list_transform(s, lambda r: r[17]))"
    mean = f"(1 / (1 + exp(-({beta}))))"
    again = _solved(
        f"(SELECT rounds.it + 1 AS it, rows.model, rows.setting, rows.trait, rows.no_meds, rows.names, x, "
        f"{mean} * (1 - {mean}) AS w, {beta} + (y - {mean}) / ({mean} * (1 - {mean})) AS z "
        f"FROM rows JOIN rounds USING (model, setting) WHERE logit AND rounds.it < 25)", "w", "z", "it, " + columns)
    zero = "[" + ", ".join("[" + ", ".join(["0::DOUBLE"] * (2 * _P + 1)) + "]" for _ in range(_P)) + "]"
    inside = ("CASE WHEN v % 2 = 1 THEN 2 / pi() * (m + sin(m) * coalesce(list_sum(list_transform(range(0, (v - 1) // 2), "
              "lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(m), 2 * j + 1))), 0)) "
              "ELSE sin(m) * coalesce(list_sum(list_transform(range(0, v // 2), "
              "lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(m), 2 * j))), 0) END")
    return f"""WITH RECURSIVE settings AS (SELECT * FROM (VALUES {values}) t(setting, trait, phenotype, no_meds, lower, is_binary)),
    scored AS (SELECT *, (score - avg(score) OVER ()) / stddev_samp(score) OVER () AS z FROM pheno),
    frame AS (SELECT s.*, p.subject, p.age, p.sex, l.v AS y, CASE WHEN lower THEN -z ELSE z END AS prs, coalesce(t.is_carrier, false) AS c
      FROM settings s JOIN long_pheno l ON l.phenotype = s.phenotype JOIN scored p ON p.subject = l.subject
      LEFT JOIN status t ON t.subject = p.subject AND t.cohort = p.cohort AND t.trait = s.trait
      WHERE l.v IS NOT NULL AND z IS NOT NULL AND (NOT no_meds OR p.lipidmeds = 0) AND (p.age >= 40 OR t.is_carrier)),
    tiled AS (SELECT *, ntile(4) OVER w AS quantile, ntile(100) OVER w AS percentile FROM frame
      WINDOW w AS (PARTITION BY setting ORDER BY prs, subject)),
    rows AS ({" UNION ALL ".join([
        model("top_vs_carrier", ["carrierNon Carrier", *names], f"1 - {c}", "", "(percentile = 100 OR c)"),
        model("interquartile_vs_top", ["groupingtop_1", *names], "CAST(percentile = 100 AS INTEGER)", "",
              "NOT c AND (percentile = 100 OR quantile IN (2, 3))"),
        model("carriers", ["prs", *names], "prs", "", "c"),
        model("interaction", ["carrierCarrier", "prs", *names, "carrierCarrier:prs"], f"{c}, prs", f"{c} * prs", "NOT is_binary"),
    ])}),
    linear AS ({_solved("(FROM rows WHERE NOT logit)", "1", "y", columns)}),
    rounds AS (
      SELECT DISTINCT 0 AS it, {columns}, {zero} AS s, CAST(0 AS BIGINT) AS n, 0::DOUBLE AS rest, 0 AS used FROM rows WHERE logit
      UNION ALL
      {again}
    ),
    fitted AS (SELECT {columns}, s, n, used, false AS logit, rest FROM linear
      UNION ALL SELECT {columns}, s, n, used, true, rest FROM rounds WHERE it = 25),
    spread AS (SELECT f.*, r.ss FROM fitted f LEFT JOIN (SELECT r.model, r.setting, sum(pow(y - list_dot_product(x, list_transform(s, lambda q: q[17])), 2)) AS ss
        FROM rows r JOIN linear l ON l.model = r.model AND l.setting = r.setting GROUP BY ALL) r USING (model, setting) WHERE n > used),
    terms AS (SELECT model, setting, trait, no_meds, names[i] AS variable, s[i][17] AS estimate,
        sqrt(s[i][17 + i] * CASE WHEN logit THEN 1 ELSE ss / (n - used) END) AS std_error, logit, n, n - used AS v
      FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM spread))
    SELECT model, trait AS condition, no_meds AS restrict_lipid_meds, variable, round(estimate, 4) AS estimate,
      round(std_error, 4) AS std_error, round(estimate / std_error, 3) AS statistic,
      CASE WHEN NOT logit THEN round(1 - {inside}, 4) END AS p_value, n
    FROM (SELECT *, atan(abs(estimate / std_error) / sqrt(v)) AS m FROM terms)"""


@query(_models_sql())
def score_models(spark, d):
    """All models of all eight settings, with twelve covariates, over all cohorts, in the same passes."""
    pheno = V.prepared_phenotypes(spark, d).withColumns({
        name: F.col("subject") * p % 97 / 48.0 - 1 for name, p in _PCS.items()})
    frames = R.score_frames(
        pheno.drop("score"), pheno.select("subject", "score"), V.carriers(spark, d), V.gene_traits(spark, d),
        age_cutoff=40, tie=F.col("subject"))
    out = R.all_score_models(frames).where("converged")
    logit = (F.col("condition") == "MODY") & F.col("model").isin("top_vs_carrier", "interquartile_vs_top")
    return out.select("model", "condition", "restrict_lipid_meds", "variable", rounded("estimate", 4),
                      rounded("std_error", 4), rounded("statistic", 3),
                      rounded(F.when(~logit, F.col("p_value")), 4, "p_value"), "n")


@query(f"""WITH {_MODY_FRAME}, m AS (SELECT count(*) FILTER (WHERE decile = 10 AND phenotype_value = 1)::DOUBLE AS a,
      count(*) FILTER (WHERE decile = 10 AND phenotype_value = 0)::DOUBLE AS b, count(*) FILTER (WHERE decile = 1 AND phenotype_value = 1)::DOUBLE AS c,
      count(*) FILTER (WHERE decile = 1 AND phenotype_value = 0)::DOUBLE AS d FROM tiled)
    SELECT 10 AS "group", round(a * d / (b * c), 4) AS odds_ratio,
      round(exp(ln(a * d / (b * c)) - 1.959963984540054::DOUBLE * sqrt(1/a + 1/b + 1/c + 1/d)), 4) AS low,
      round(exp(ln(a * d / (b * c)) + 1.959963984540054::DOUBLE * sqrt(1/a + 1/b + 1/c + 1/d)), 4) AS high FROM m""")
def odds_ratio_vs_first_decile(spark, d):
    out = R.odds_ratio_vs_first(_frame(spark, d, _MODY), 10, tile="decile", covariates=())
    return out.select("group", rounded("odds_ratio", 4), rounded("low", 4), rounded("high", 4))


@query("""SELECT cohort, CAST(regr_count(ldl_mgdl, age) AS BIGINT) AS n, round(regr_slope(ldl_mgdl, age), 5) AS slope,
    round(regr_intercept(ldl_mgdl, age), 4) AS intercept FROM pheno GROUP BY cohort""")
def simple_slope(spark, d):
    out = M.simple_slope(V.prepared_phenotypes(spark, d), ["cohort"], "ldl_mgdl", "age")
    return out.select("cohort", "n", rounded("slope", 5), rounded("intercept", 4))


# --- survival --------------------------------------------------------------

_KM_SQL = """
    , n AS (SELECT {g}, time, count(*) AS k, CAST(sum(event) AS BIGINT) AS n_event FROM subjects
      WHERE time IS NOT NULL AND event IS NOT NULL GROUP BY {g}, time),
    r AS (SELECT *, CAST(sum(k) OVER (PARTITION BY {g} ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS n_risk FROM n)
    SELECT {g}, time, n_risk, n_event, k - n_event AS n_censor,
      round(product(1 - n_event / n_risk::DOUBLE) OVER (PARTITION BY {g} ORDER BY time ROWS UNBOUNDED PRECEDING), 6) AS survival
    FROM r"""


@query("""WITH subjects AS (
      SELECT user_id, CASE WHEN max(value) > 200 THEN 'high' ELSE 'low' END AS grp,
        CAST(coalesce(date_diff('day', DATE '2024-01-01', CAST(min(ts) FILTER (WHERE event_type = 'error' AND value > 20) AS DATE)),
          date_diff('day', DATE '2024-01-01', CAST(max(ts) AS DATE))) AS INTEGER) AS time,
        CAST(bool_or(event_type = 'error' AND value > 20) AS INTEGER) AS event FROM events GROUP BY user_id)""" + _KM_SQL.format(g="grp"))
def kaplan_meier(spark, d):
    start = F.lit("2024-01-01").cast("date")
    failed = (F.col("event_type") == "error") & (F.col("value") > 20)
    subjects = V.table(spark, d, "events").groupBy("user_id").agg(
        F.when(F.max("value") > 200, "high").otherwise("low").alias("grp"),
        F.coalesce(F.datediff(F.min(F.when(failed, F.col("ts"))), start), F.datediff(F.max("ts"), start)).alias("time"),
        F.bool_or(failed).cast("int").alias("event"))
    out = km(subjects, ["grp"], "time", "event")
    return out.select("grp", "time", "n_risk", "n_event", "n_censor", rounded("survival"))


@query("""WITH subjects AS (SELECT o_orderpriority AS grp, o_totalprice AS time, CAST(o_orderstatus = 'F' AS INTEGER) AS event
      FROM orders)""" + _KM_SQL.format(g="grp"))
def survival_continuous(spark, d):
    """Curves over a time with about as many values as rows."""
    subjects = V.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("time"),
        (F.col("o_orderstatus") == "F").cast("int").alias("event"))
    return km(subjects, ["grp"], "time", "event").select("grp", "time", "n_risk", "n_event", "n_censor", rounded("survival"))


@query("""WITH subjects AS (
      SELECT p.cohort, CASE WHEN t.is_carrier THEN w.gene ELSE 'Non Carrier' END AS gene,
        coalesce(aod, diagnosed_0, CASE WHEN t2d = 0 THEN age END) AS time, t2d AS event
      FROM pheno p LEFT JOIN (FROM status WHERE trait = 'MODY') t ON t.subject = p.subject AND t.cohort = p.cohort
      LEFT JOIN (FROM lowest WHERE trait = 'MODY') w ON w.subject = p.subject AND w.cohort = p.cohort
      WHERE CASE WHEN t.is_carrier THEN w.gene ELSE 'Non Carrier' END IN ('GCK', 'HNF1A', 'Non Carrier'))""" + _KM_SQL.format(g="cohort, gene"))
def diagnosis_curves(spark, d):
    out = curves_by_gene(
        V.prepared_phenotypes(spark, d), V.carriers(spark, d), V.gene_traits(spark, d), known_ages=("aod", "diagnosed_0"))
    return out.select("cohort", "gene", "time", "n_risk", "n_event", "n_censor", rounded("survival"))
