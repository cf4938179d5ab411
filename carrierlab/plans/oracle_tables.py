"""The study tables of :mod:`carrierlab.plans.views` as SQL, for checking only.

Each entry is a common table expression; :func:`sql` puts the needed ones in
front of a query.
"""

from __future__ import annotations

import re

from carrierlab import settings as S
from carrierlab.plans.views import GENE_NAMES, TRAIT_NAMES


def _case(column: str, names: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items())
    return f"CASE {column} {whens} ELSE {column} END"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


PATH = quoted(S.PATH_LEVELS)

CTES: dict[str, str] = {}

CTES["order_facts"] = """
SELECT o_custkey AS subject,
  max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
  max(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH') AS high,
  max(o_totalprice) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS medium,
  max(o_totalprice) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS other,
  max(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS low,
  min(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS low_min,
  min(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH') AS high_min,
  min(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent_min,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
  min(o_totalprice) AS score
FROM orders GROUP BY o_custkey"""

CTES["pheno0"] = """
SELECT subject, c_mktsegment AS cohort, r_name AS ancestry,
  CASE WHEN c_nationkey < 12 THEN 1 ELSE 2 END AS sex,
  CAST(floor((c_acctbal + 1000) / 200) + 20 AS INTEGER) AS age,
  CASE WHEN n_p = 0 THEN NULL WHEN n_p >= 4 THEN 1 ELSE 0 END AS lipidmeds,
  urgent / 1999 AS ldl_mgdl, high / 4999 AS hdl_mgdl, medium / 1499 AS tg_mgdl,
  other / 9999 AS bmi, low / 59999 AS hba1c, low_min / 39999 AS fast_glu_mmoll,
  high_min / 39999 AS h_glu,
  CASE WHEN n_f = 0 THEN NULL WHEN n_f >= 5 THEN 1 ELSE 0 END AS t2d_base,
  CASE WHEN urgent > 480000 THEN 'LDL_High' WHEN urgent_min < 20000 THEN 'LDL_Low'
       WHEN other > 490000 THEN 'BMI_High' WHEN n_o = 0 THEN NULL ELSE 'none' END AS esp_phenotype,
  CASE WHEN n_f >= 5 THEN CAST(floor(low_min / 4999) AS INTEGER) END AS aod,
  CASE WHEN n_f >= 5 THEN CAST(floor(high_min / 4999) AS INTEGER) END AS diagnosed_0,
  score
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN order_facts ON subject = c_custkey"""

CTES["pheno"] = """
SELECT *,
  CASE WHEN fast_glu_mmoll * 18 >= 100 OR h_glu * 18 >= 140 OR hba1c >= 5.7 THEN 1 ELSE t2d_base END AS t2d_with_pre,
  CASE WHEN hba1c >= 6.5 THEN 1 ELSE t2d_base END AS t2d,
  CASE WHEN lipidmeds <> 0 THEN ldl_mgdl / 0.7::DOUBLE ELSE ldl_mgdl END AS ldl_mgdl_adj,
  CASE WHEN lipidmeds <> 0 THEN tg_mgdl / 0.85::DOUBLE ELSE tg_mgdl END AS tg_mgdl_adj
FROM pheno0"""

CTES["variants"] = f"""
SELECT p_partkey AS partkey, {_case('p_brand', GENE_NAMES)} AS gene,
  CASE WHEN p_type = 'ECONOMY' AND p_size > 30 THEN 'MODY Extended'
       ELSE {_case('p_type', TRAIT_NAMES)} END AS trait,
  CASE WHEN p_size <= 45 THEN p_size / 20000::DOUBLE END AS af,
  CASE WHEN p_name LIKE '%ring' THEN 0 WHEN p_size <= 45 THEN p_size END AS ac
FROM part"""

CTES["gene_traits"] = "SELECT DISTINCT gene, trait FROM variants WHERE af >= 0.0002::DOUBLE"

CTES["carriers"] = """
SELECT o_custkey AS subject, c_mktsegment AS cohort, CAST(partkey AS VARCHAR) AS variant,
  CAST(partkey AS VARCHAR) AS variant_b37, gene, trait,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 46 THEN 'Pathogenic'
       WHEN l_returnflag = 'R' AND l_quantity > 43 THEN 'Likely_LOF' WHEN l_returnflag = 'R' THEN 'Benign'
       WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 'VUS' WHEN l_returnflag = 'A' THEN 'Likely benign'
       ELSE 'Not_LOF' END AS level,
  CASE WHEN l_tax > 0.065 THEN 'Review' WHEN l_linestatus = 'F' THEN 'LOF' ELSE 'ClinVar' END AS evidence,
  CASE WHEN l_discount > 0 THEN 'note ' || l_linenumber END AS notes, af, ac
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN variants ON l_partkey = partkey"""

CTES["relevant"] = "SELECT c.* FROM carriers c SEMI JOIN gene_traits g ON c.gene = g.gene AND c.trait = g.trait"

CTES["status"] = f"""
SELECT subject, cohort, trait, bool_or(lower(level) IN ({PATH})) AS is_carrier,
  bool_or(lower(level) = 'vus') AS has_vus
FROM relevant GROUP BY subject, cohort, trait"""

CTES["lowest"] = """
SELECT subject, cohort, trait, gene, variant, af, ac FROM relevant
QUALIFY row_number() OVER (PARTITION BY subject, cohort, trait
  ORDER BY af IS NULL, af, variant, level, evidence) = 1"""

CTES["merged_evidence"] = """
SELECT subject, cohort, trait, variant,
  CASE string_agg(DISTINCT evidence, ', ' ORDER BY evidence)
    WHEN 'ClinVar, LOF' THEN 'ClinVar and LOF' WHEN 'LOF, Review' THEN 'LOF and Review'
    ELSE string_agg(DISTINCT evidence, ', ' ORDER BY evidence) END AS evidence
FROM relevant GROUP BY subject, cohort, trait, variant"""

CTES["outcome_settings"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, '{s.condition}', '{s.condition_simple}', '{s.trait}', '{s.phenotype}', '{s.rule}', "
        f"{s.threshold}::DOUBLE, {str(s.no_meds).lower()})"
        for i, s in enumerate(S.outcome_settings())
    )
    + ") t(setting, condition, condition_simple, trait, phenotype, rule, threshold, no_meds)"
)

CTES["mean_settings"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, '{s.label}', '{s.trait}', '{s.phenotype}', '{s.association_trait}', {str(s.no_meds).lower()})"
        for i, s in enumerate(S.mean_settings())
    )
    + ") t(setting, condition, trait, phenotype, association_trait, no_meds)"
)

_MEASURES = ("t2d", "t2d_with_pre", "bmi", "hdl_mgdl", "ldl_mgdl", "ldl_mgdl_adj", "tg_mgdl", "tg_mgdl_adj")
CTES["long_pheno"] = " UNION ALL ".join(
    f"SELECT subject, cohort, lipidmeds, '{m}' AS phenotype, CAST({m} AS DOUBLE) AS v FROM pheno" for m in _MEASURES
)

CTES["calls"] = """
SELECT l_partkey AS partkey, l_orderkey AS sample,
  CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS copies,
  CASE WHEN l_linenumber <> 7 THEN CAST(round(l_tax * 100) AS INTEGER) END AS ref_reads,
  CASE WHEN l_linenumber <> 7 THEN CAST(round(l_discount * 100) AS INTEGER) END AS alt_reads,
  l_linenumber * 5 AS dp, nullif(l_quantity, 25) AS gq
FROM lineitem"""

CTES["masked"] = """
SELECT partkey, sample,
  CASE WHEN NOT (gq < 20 OR dp < 10 OR (copies = 1 AND
    CASE WHEN ref_reads + alt_reads = 0 THEN false
         ELSE alt_reads < (ref_reads + alt_reads) * 0.25::DOUBLE END)) THEN copies END AS copies
FROM calls"""

CTES["submissions"] = """
SELECT l_partkey AS variation_id, l_suppkey AS lab_id, n_name AS submitter,
  CASE WHEN l_returnflag = 'R' AND l_quantity >= 48 THEN 'Pathogenic'
       WHEN l_returnflag = 'A' AND l_quantity >= 49 THEN 'Likely pathogenic'
       WHEN l_returnflag = 'R' THEN 'Uncertain significance' ELSE 'Benign' END AS significance,
  CASE WHEN l_linestatus = 'F' THEN 'clinical testing' WHEN l_discount > 0.02::DOUBLE THEN 'literature only' END AS method,
  CASE WHEN l_tax > 0 THEN CAST(l_shipdate AS DATE) END AS date, 'P' || l_linenumber AS phenotype,
  CASE WHEN l_linenumber > 3 THEN 'No Information' ELSE 'Specified' END AS clarification,
  l_discount > 0.015 AS correct_phenotype
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""

CTES["summary"] = """
SELECT p_partkey AS variation_id, p_brand AS gene, CAST(p_size > 10 AS INTEGER) AS clin_sig,
  CASE WHEN p_retailprice < 960 THEN 'GRCh37' ELSE 'GRCh38' END AS assembly, 'HGNC:' || p_size AS hgnc_id
FROM part"""

CTES["sites"] = """
SELECT p_partkey AS variation_id, 'chr' || replace(p_brand, 'Brand#', '') AS chr,
  CAST(p_size * 1000 + p_partkey AS BIGINT) AS pos, left(p_type, 1) AS ref, upper(left(p_name, 1)) AS alt,
  CAST(p_partkey + 15000 AS VARCHAR) AS allele_id,
  'chr' || replace(p_brand, 'Brand#', '') || ':' || (p_size * 1000 + p_partkey) || ':' || left(p_type, 1)
    || ':' || upper(left(p_name, 1)) AS variant_str
FROM part"""

CTES["observed"] = """
SELECT variant_str, count(*) AS n_called, count(*) FILTER (WHERE l_returnflag = 'R') AS n_het,
  count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 40) AS ac
FROM lineitem JOIN sites ON l_partkey = variation_id GROUP BY variant_str, variation_id"""


CTES["call_sheet"] = """
SELECT contig, pos, sample, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE CASE WHEN q > 5 THEN 0 END END AS copies,
  ref_reads, alt_reads, dp, q AS gq,
  CASE l_returnflag WHEN 'R' THEN [q, 0, q + 9] WHEN 'A' THEN [q + 40, q - 10, 3] END AS pl
FROM (SELECT 'chr' || CASE WHEN p_size > 46 THEN 'X' ELSE CAST(p_size % 23 AS VARCHAR) END AS contig,
    CAST(p_partkey * 10 AS INTEGER) AS pos, n_name AS sample, l_returnflag, CAST(l_quantity AS INTEGER) AS q,
    CAST(round(l_tax * 100) AS INTEGER) AS ref_reads, CAST(round(l_discount * 100) AS INTEGER) AS alt_reads,
    l_linenumber * 5 AS dp,
    row_number() OVER (PARTITION BY l_partkey, n_name ORDER BY l_orderkey, l_linenumber) AS k
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey) WHERE k = 1"""

CTES["qc_calls"] = """
SELECT *, CASE WHEN NOT (quality < 20 OR dp < 10 OR (copies = 1 AND CASE WHEN ref_reads + alt_reads = 0 THEN false
    ELSE alt_reads < (ref_reads + alt_reads) * 0.25::DOUBLE END)) THEN copies END AS called
FROM (SELECT *, CASE WHEN pl IS NULL THEN gq
    ELSE list_sort(pl || [99, 99])[2] - list_sort(pl || [99, 99])[1] END AS quality FROM call_sheet)"""


def exact_intervals(source: str, conf: float = 0.95, steps: int = 48) -> str:
    """Recursive tables that end in exact_ci (k, n, low, high) for the count and total of ``source``.

    Both bounds are bisected on sums of binomial probabilities.
    """
    def tail(p: str, first: str, last: str) -> str:
        return (f"list_sum(list_transform(range({first}, {last} + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) "
                f"- lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))")

    share = f"{(1 - conf) / 2!r}::DOUBLE"
    return f"""
    exact_steps AS (
      SELECT DISTINCT count AS k, total AS n, 0 AS i, 0::DOUBLE AS l1, count / total::DOUBLE AS h1,
        count / total::DOUBLE AS l2, 1::DOUBLE AS h2 FROM {source} WHERE total > 0
      UNION ALL
      SELECT k, n, i + 1, CASE WHEN above < {share} THEN m1 ELSE l1 END, CASE WHEN above < {share} THEN h1 ELSE m1 END,
        CASE WHEN below > {share} THEN m2 ELSE l2 END, CASE WHEN below > {share} THEN h2 ELSE m2 END
      FROM (SELECT *, CASE WHEN k > 0 THEN {tail('m1', 'k', 'n')} ELSE 1 END AS above,
          CASE WHEN k < n THEN {tail('m2', '0', 'k')} ELSE 1 END AS below
        FROM (SELECT *, (l1 + h1) / 2 AS m1, (l2 + h2) / 2 AS m2 FROM exact_steps WHERE i < {steps}))
    ),
    exact_ci AS (SELECT k, n, CASE WHEN k = 0 THEN 0 ELSE (l1 + h1) / 2 END AS low,
      CASE WHEN k = n THEN 1 ELSE (l2 + h2) / 2 END AS high FROM exact_steps WHERE i = {steps})"""


def t_multipliers(source: str, conf: float = 0.95, steps: int = 56) -> str:
    """Recursive tables that end in t_value (v, t) for the n - 1 of ``source``.

    The angle whose tangent is t / sqrt(v) is bisected on the finite sum that
    the two-sided probability has for whole degrees of freedom.
    """
    def terms(upto: str, coefficient: str, power: str) -> str:
        return f"coalesce(list_sum(list_transform(range(0, {upto}), lambda j: exp({coefficient}) * pow(cos(m), {power}))), 0)"

    odd = terms("(v - 1) // 2", "lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)", "2 * j + 1")
    even = terms("v // 2", "lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)", "2 * j")
    return f"""
    t_steps AS (
      SELECT DISTINCT n - 1 AS v, 0 AS i, 0::DOUBLE AS l, pi() / 2 AS h FROM {source} WHERE n > 1
      UNION ALL
      SELECT v, i + 1, CASE WHEN inside < {conf!r}::DOUBLE THEN m ELSE l END, CASE WHEN inside < {conf!r}::DOUBLE THEN h ELSE m END
      FROM (SELECT *, CASE WHEN v % 2 = 1 THEN 2 / pi() * (m + sin(m) * {odd}) ELSE sin(m) * {even} END AS inside
        FROM (SELECT *, (l + h) / 2 AS m FROM t_steps WHERE i < {steps}))
    ),
    t_value AS (SELECT v, sqrt(v) * tan((l + h) / 2) AS t FROM t_steps WHERE i = {steps})"""


def sql(body: str) -> str:
    """Query text with the tables it (indirectly) uses in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    own = body.strip()
    heads = [f"{n} AS ({CTES[n].strip()})" for n in needed]
    for start in ("WITH RECURSIVE ", "WITH "):
        if own.upper().startswith(start):
            return start + ",\n".join([*heads, own[len(start):]])
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + own
