"""Queries: genotypes, ranges, consequences and submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from carrierlab.functions.columns import (
    alt_count, info_field, level_in, locus_allele_key, parse_interval, parse_us_date,
)
from carrierlab.operators import genotypes as G
from carrierlab.operators import ranges as R
from carrierlab.operators import submissions as B
from carrierlab.plans import views as V
from carrierlab.plans.registry import query, rounded

_QC = """count(copies) AS n_called, count(*) - count(copies) AS n_not_called,
  count(*) FILTER (WHERE copies = 1) AS n_het, count(*) FILTER (WHERE copies = 2) AS n_hom"""


# --- genotypes -------------------------------------------------------------

@query("SELECT partkey, sample, copies, count(*) AS n FROM masked GROUP BY ALL")
def genotype_mask(spark, d):
    masked = G.mask_genotypes(V.genotypes(spark, d))
    copies = F.aggregate("gt", F.lit(0), lambda x, y: x + y)
    return masked.groupBy("partkey", "sample", copies.alias("copies")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT partkey, n_het + 2 * n_hom AS ac, 2 * n_called AS an,
    round((n_het + 2 * n_hom) / (2 * n_called)::DOUBLE, 6) AS af, n_called, n_not_called, n_het, n_hom, n_het + n_hom AS n_non_ref
    FROM (SELECT partkey, {_QC} FROM masked GROUP BY partkey) WHERE n_het + n_hom > 0""")
def variant_qc(spark, d):
    out = G.observed_variants(G.variant_qc(G.mask_genotypes(V.genotypes(spark, d)), ["partkey"]))
    return out.select("partkey", "ac", "an", rounded("af"), "n_called", "n_not_called", "n_het", "n_hom", "n_non_ref")


@query("""SELECT count(DISTINCT partkey) AS variants, count(DISTINCT sample) AS samples FROM calls
    WHERE sample IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def sample_filter_counts(spark, d):
    flags = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("s"), (F.col("o_orderstatus") == "F").alias("is_forbidden"))
    kept = G.drop_flagged_samples(V.genotypes(spark, d), flags)
    return G.matrix_counts(kept, ["partkey"])


@query("""SELECT c_custkey, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer
    WHERE EXISTS (FROM supplier WHERE s_nationkey = c_nationkey AND c_acctbal >= greatest(0, s_acctbal - 100)
      AND c_acctbal < s_acctbal + 100)""")
def interval_filter(spark, d):
    intervals = V.table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("contig"), F.greatest(F.lit(0.0), F.col("s_acctbal") - 100).alias("start"),
        (F.col("s_acctbal") + 100).alias("end"))
    kept = R.within_any_interval(V.table(spark, d, "customer"), intervals, "c_nationkey", "c_acctbal", bin_size=500.0)
    return kept.select("c_custkey", "c_nationkey", rounded("c_acctbal", 2))


@query("""SELECT p_partkey, 'chr' || p_size AS contig, greatest(1, CAST(p_partkey * 40 - 5000 AS BIGINT)) AS start,
    CAST(p_partkey * 41 + 5000 AS BIGINT) AS "end" FROM part""")
def interval_text(spark, d):
    text = F.concat(F.lit("chr"), F.col("p_size").cast("string"), F.lit(":"), (F.col("p_partkey") * 40).cast("string"),
                    F.lit("-"), (F.col("p_partkey") * 41).cast("string"))
    contig, start, end = parse_interval("_t", 5000)
    return V.table(spark, d, "part").withColumn("_t", text).select(
        "p_partkey", contig.alias("contig"), start.alias("start"), end.alias("end"))


_SPLIT_SQL = """
    WITH sites0 AS (SELECT l_partkey, p_brand AS contig, p_size * 100 AS pos, p_type || 'X' AS ref,
        [p_type, p_type || 'YX', 'Z'] AS alts,
        CASE WHEN l_quantity = 25 THEN NULL WHEN l_returnflag = 'R' THEN [0, 1] WHEN l_returnflag = 'A' THEN [1, 2]
          ELSE [2, 3] END AS gt,
        [CAST(round(l_tax * 100) AS INTEGER), CAST(round(l_discount * 100) AS INTEGER), l_linenumber, 1] AS ad
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    exploded AS (SELECT *, unnest([1, 2, 3]) AS i FROM sites0),
    alleles AS (SELECT *, alts[i] AS alt FROM exploded),
    tailed AS (SELECT *, CAST(coalesce(len(list_filter(range(1, least(length(ref), length(alt))),
        lambda k: right(ref, k) = right(alt, k))), 0) AS INTEGER) AS tail FROM alleles),
    cut AS (SELECT *, left(ref, length(ref) - tail) AS r1, left(alt, length(alt) - tail) AS a1 FROM tailed),
    headed AS (SELECT *, CAST(coalesce(len(list_filter(range(1, least(length(r1), length(a1))),
        lambda k: left(r1, k) = left(a1, k))), 0) AS INTEGER) AS head FROM cut)
    SELECT contig, pos + head AS pos, substr(r1, head + 1) AS ref, substr(a1, head + 1) AS alt, i AS a_index,
      count(gt) AS n_called, count(*) FILTER (WHERE (gt[1] = i) <> (gt[2] = i)) AS n_het,
      count(*) FILTER (WHERE gt[1] = i AND gt[2] = i) AS n_hom, CAST(sum(ad[i + 1]) AS BIGINT) AS alt_reads,
      CAST(sum(list_sum(ad)) - sum(ad[i + 1]) AS BIGINT) AS other_reads
    FROM headed GROUP BY ALL"""


@query(_SPLIT_SQL)
def split_multi(spark, d):
    part = V.table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("contig"), (F.col("p_size") * 100).alias("pos"),
        F.array(F.concat("p_type", F.lit("X")), F.col("p_type"), F.concat("p_type", F.lit("YX")), F.lit("Z")).alias("alleles"))
    pair = F.when(F.col("l_quantity") == 25, None).when(F.col("l_returnflag") == "R", F.array(F.lit(0), F.lit(1))).when(
        F.col("l_returnflag") == "A", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3)))
    calls = V.table(spark, d, "lineitem").select(
        "l_partkey", pair.alias("gt"),
        F.array(F.round(F.col("l_tax") * 100).cast("int"), F.round(F.col("l_discount") * 100).cast("int"),
                F.col("l_linenumber"), F.lit(1)).alias("ad"))
    split = G.split_multiallelic(
        calls.join(part, F.col("l_partkey") == F.col("p_partkey")).select("contig", "pos", "alleles", "gt", "ad"))
    copies = F.aggregate("gt", F.lit(0), lambda x, y: x + y)
    return split.groupBy(
        "contig", "pos", F.element_at("alleles", 1).alias("ref"), F.element_at("alleles", 2).alias("alt"), "a_index"
    ).agg(
        F.count("gt").alias("n_called"), F.count(F.when(copies == 1, 1)).alias("n_het"),
        F.count(F.when(copies == 2, 1)).alias("n_hom"), F.sum(F.col("ad")[1]).alias("alt_reads"),
        F.sum(F.col("ad")[0]).alias("other_reads"))


_CONSEQUENCES_SQL = """SELECT p_partkey, [{'gene': p_brand, 'lof': CASE WHEN p_size > 25 THEN 'HC' ELSE 'LC' END},
    {'gene': 'Brand#1', 'lof': 'HC'}, {'gene': p_type, 'lof': NULL}] AS t FROM part"""
_WANTED = "'Brand#1', 'Brand#2', 'Brand#3', 'SMALL'"


@query(f"""
    WITH kept AS (SELECT p_partkey, list_filter(t, lambda x: x.gene IN ({_WANTED})) AS k FROM ({_CONSEQUENCES_SQL})),
    lof AS (SELECT *, list_filter(k, lambda x: x.lof = 'HC' AND x.gene IN ('Brand#2', 'Brand#3')) AS h FROM kept)
    SELECT p_partkey, CAST(len(k) AS INTEGER) AS n_kept, array_to_string(list_transform(k, lambda x: x.gene), ',') AS genes,
      CAST(len(h) AS INTEGER) AS n_high FROM lof WHERE len(k) >= 1 AND len(h) >= 1""")
def consequence_filter(spark, d):
    def effect(gene, lof):
        return F.struct(gene.alias("gene_symbol"), lof.cast("string").alias("lof"))

    part = V.table(spark, d, "part").select("p_partkey", F.array(
        effect(F.col("p_brand"), F.when(F.col("p_size") > 25, "HC").otherwise("LC")),
        effect(F.lit("Brand#1"), F.lit("HC")), effect(F.col("p_type"), F.lit(None)),
    ).alias("consequences"))
    kept = G.keep_consequences(part, ["Brand#1", "Brand#2", "Brand#3", "SMALL"])
    lof = G.keep_consequences(kept, ["Brand#2", "Brand#3"], out="high", lof="HC")
    return lof.select("p_partkey", F.size("consequences").alias("n_kept"),
                      F.array_join(F.transform("consequences", lambda t: t["gene_symbol"]), ",").alias("genes"),
                      F.size("high").alias("n_high"))


@query("""SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 5) AS first, CAST(len(embedding) AS INTEGER) AS n,
    CAST(len(list_filter(embedding, lambda x: x > 0.1)) AS INTEGER) AS n_high, len(list_filter(embedding, lambda x: x > 0.3)) >= 1 AS any_high,
    round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings""")
def array_functions(spark, d):
    e = F.col("embedding")
    return V.table(spark, d, "embeddings").select(
        "vec_id", rounded(F.element_at(e, 1), 5, "first"), F.size(e).alias("n"),
        F.size(F.filter(e, lambda x: x > F.lit(0.1).cast("float"))).alias("n_high"),
        F.exists(e, lambda x: x > F.lit(0.3).cast("float")).alias("any_high"),
        rounded(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double")), 4, "total"))


@query("""
    WITH genes AS (SELECT p_brand AS gene, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS traits FROM part GROUP BY p_brand)
    SELECT p.p_brand AS gene, t.trait, count(*) AS n FROM part p
    JOIN (SELECT gene, unnest(string_split(traits, ', ')) AS trait FROM genes) t ON t.gene = p.p_brand GROUP BY ALL""")
def split_traits(spark, d):
    part = V.table(spark, d, "part").withColumnsRenamed({"p_brand": "gene", "p_type": "trait"})
    texts = B.gene_trait_text(part.select("gene", "trait").distinct())
    rows = texts.select("gene", F.explode(F.split("traits", ", ")).alias("trait"))
    return part.select("gene").join(rows, "gene").groupBy("gene", "trait").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, key, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(v AS BIGINT)) AS BIGINT) AS total FROM (
      SELECT user_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS v FROM events) GROUP BY ALL""")
def json_lookup(spark, d):
    rows = V.table(spark, d, "events").select(
        "user_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "v"))
    return rows.groupBy("user_id", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


_BLOCKS_SQL = """SELECT s_nationkey AS src_contig, CAST(floor(s_acctbal / 1000) AS BIGINT) * 100000 AS src_start,
    CAST(floor(s_acctbal / 1000) AS BIGINT) * 100000 + 80000 AS src_end, s_nationkey + 100 AS dst_contig,
    CAST(min(s_suppkey) * 1000000 AS BIGINT) AS dst_start, CASE WHEN count(*) % 2 = 0 THEN '-' ELSE '+' END AS strand
    FROM supplier GROUP BY s_nationkey, floor(s_acctbal / 1000)"""


@query(f"""
    SELECT c_custkey, dst_contig AS new_contig,
      CASE strand WHEN '-' THEN dst_start + (src_end - 1 - pos) WHEN '+' THEN dst_start + (pos - src_start) END AS new_pos,
      strand = '-' AS is_negative_strand
    FROM (SELECT c_custkey, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS pos FROM customer)
    LEFT JOIN ({_BLOCKS_SQL}) ON c_nationkey = src_contig AND pos >= src_start AND pos < src_end""")
def block_remap(spark, d):
    cell = F.floor(F.col("s_acctbal") / 1000)
    blocks = V.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("src_contig"), cell.alias("_cell")).agg(
        F.min("s_suppkey").alias("_first"), F.count(F.lit(1)).alias("_n"),
    ).select(
        "src_contig", (F.col("_cell") * 100000).alias("src_start"), (F.col("_cell") * 100000 + 80000).alias("src_end"),
        (F.col("src_contig") + 100).alias("dst_contig"), (F.col("_first") * 1000000).alias("dst_start"),
        F.when(F.col("_n") % 2 == 0, "-").otherwise("+").alias("strand"))
    loci = V.table(spark, d, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("contig"), F.round(F.col("c_acctbal") * 100).cast("long").alias("pos"))
    return R.remap_blocks(loci, blocks, bin_size=100000).select("c_custkey", "new_contig", "new_pos", "is_negative_strand")


@query("""
    WITH lines AS (SELECT l_partkey AS variant, p_brand AS gene, p_type AS transcript, l_returnflag AS csq, l_linestatus AS lof_flag,
        'T' || l_linenumber AS tissue, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey),
    expr AS (SELECT gene, transcript, tissue, max(q) AS value FROM lines WHERE tissue <> 'T7' GROUP BY ALL),
    gmax AS (SELECT gene, tissue, sum(value) AS max_value FROM expr GROUP BY ALL),
    cons AS (SELECT DISTINCT variant, gene, transcript, csq, lof_flag FROM lines),
    per_tissue AS (SELECT variant, gene, csq, lof_flag, tissue, sum(value) AS expressed FROM cons JOIN expr USING (gene, transcript) GROUP BY ALL),
    per_csq AS (SELECT variant, gene, csq, lof_flag, avg(expressed / max_value) AS m FROM per_tissue JOIN gmax USING (gene, tissue) GROUP BY ALL)
    SELECT variant, gene, csq, lof_flag, round(m, 6) AS mean_proportion FROM per_csq
    QUALIFY row_number() OVER (PARTITION BY variant ORDER BY CASE csq WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, round(m, 9) DESC, gene, lof_flag) = 1""")
def expression_proportion(spark, d):
    lines = V.table(spark, d, "lineitem").join(
        V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select(
        F.col("l_partkey").alias("variant"), F.col("p_brand").alias("gene"), F.col("p_type").alias("transcript"),
        F.col("l_returnflag").alias("csq"), F.col("l_linestatus").alias("lof_flag"),
        F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("tissue"), "l_quantity")
    expression = lines.groupBy("gene", "transcript", "tissue").agg(F.max("l_quantity").alias("value"))
    kept = expression.where(F.col("tissue") != "T7")
    maximum = kept.groupBy("gene", "tissue").agg(F.sum("value").alias("max_value"))
    effects = lines.select("variant", "gene", "transcript", "csq", "lof_flag").distinct()
    out = G.expression_proportion(effects, expression, maximum, ["R", "A"], ["T7"], ["variant"])
    return out.select("variant", "gene", "csq", "lof_flag", rounded("mean_proportion"))


@query("""
    WITH lines AS (SELECT l_partkey AS variant, p_brand AS gene, p_type AS transcript,
        CASE l_returnflag WHEN 'R' THEN 'stop_gained' WHEN 'A' THEN 'missense_variant' ELSE 'intron_variant' END AS csq,
        l_linestatus AS lof_flag, 'T' || l_linenumber AS tissue, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey),
    expr AS (SELECT gene, transcript, tissue, max(q) AS value FROM lines GROUP BY ALL),
    gmax AS (SELECT gene, tissue, sum(value) AS max_value FROM expr GROUP BY ALL),
    cons AS (SELECT DISTINCT variant, gene, transcript, csq, lof_flag FROM lines WHERE csq <> 'intron_variant'),
    per_tissue AS (SELECT variant, gene, csq, lof_flag, tissue, sum(value) / any_value(max_value) AS p
      FROM cons JOIN expr USING (gene, transcript) JOIN gmax USING (gene, tissue) GROUP BY ALL),
    per_csq AS (SELECT variant, gene, csq, lof_flag, avg(p) AS m,
      string_agg(tissue || ':' || round(p, 4), ',' ORDER BY tissue) AS tissues FROM per_tissue GROUP BY ALL)
    SELECT variant, gene, csq, CASE csq WHEN 'stop_gained' THEN 4 ELSE 11 END AS severity_rank, lof_flag,
      round(m, 6) AS mean_proportion, tissues FROM per_csq
    QUALIFY row_number() OVER (PARTITION BY variant ORDER BY severity_rank, round(m, 9) DESC, gene, lof_flag) = 1""")
def worst_consequences(spark, d):
    """Most severe coding consequence of each variant, its rank and its share of expression by tissue."""
    lines = V.table(spark, d, "lineitem").join(
        V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select(
        F.col("l_partkey").alias("variant"), F.col("p_brand").alias("gene"), F.col("p_type").alias("transcript"),
        F.when(F.col("l_returnflag") == "R", "stop_gained").when(F.col("l_returnflag") == "A", "missense_variant")
        .otherwise("intron_variant").alias("csq"), F.col("l_linestatus").alias("lof_flag"),
        F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("tissue"), "l_quantity")
    expression = lines.groupBy("gene", "transcript", "tissue").agg(F.max("l_quantity").alias("value"))
    maximum = expression.groupBy("gene", "tissue").agg(F.sum("value").alias("max_value"))
    effects = lines.select("variant", "gene", "transcript", "csq", "lof_flag").distinct()
    out = G.expression_proportion(effects, expression, maximum, variant=["variant"], listed_only=True)
    text = F.concat_ws(",", F.transform(F.map_entries("by_tissue"), lambda e: F.concat(
        e["key"], F.lit(":"), F.round(e["value"], 4).cast("string"))))
    return out.select("variant", "gene", "csq", "severity_rank", "lof_flag", rounded("mean_proportion"), text.alias("tissues"))


@query("""SELECT gene, copies, count(*) AS n_rows, count(DISTINCT sample) AS n_samples FROM calls
    JOIN variants USING (partkey) WHERE copies > 0 GROUP BY ALL""")
def carrier_list(spark, d):
    out = G.carrier_list(V.genotypes(spark, d), V.parts(spark, d), ["partkey"])
    copies = F.aggregate("gt", F.lit(0), lambda x, y: x + y)
    return out.groupBy("gene", copies.alias("copies")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sample").alias("n_samples"))


# --- text keys and dates ---------------------------------------------------

@query("""SELECT variation_id, chr || '-' || pos || '-' || ref || '-' || alt AS key, allele_id,
    chr || '-' || pos || '-' || ref || '-' || alt AS from_locus, CAST(variation_id AS INTEGER) AS alt FROM sites""")
def variant_keys(spark, d):
    sites = B.site_positions(V.archive_sites(spark, d))
    locus = F.concat_ws(":", "chr", F.col("pos").cast("string"))
    alleles = F.concat(F.lit('["'), F.col("ref"), F.lit('","'), F.col("alt"), F.lit('"]'))
    counts = F.concat(F.lit("[1,"), F.col("variation_id").cast("string"), F.lit("]"))
    return sites.select(
        "variation_id", F.concat_ws("-", "chr", F.col("pos").cast("string"), "ref", "alt").alias("key"), "allele_id",
        locus_allele_key(locus, alleles).alias("from_locus"), alt_count(counts).alias("alt"))


@query("""SELECT p_partkey, CASE WHEN p_size > 20 THEN CAST(p_partkey AS VARCHAR) END AS allele_id FROM part""")
def info_fields(spark, d):
    info = F.when(F.col("p_size") > 20, F.concat(F.lit("A=1;ALLELEID="), F.col("p_partkey").cast("string"), F.lit(";Z"))).otherwise("A=1;XALLELEID=7")
    return V.table(spark, d, "part").select("p_partkey", info_field(info, "ALLELEID").alias("allele_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def date_parse(spark, d):
    text = F.when(F.col("o_orderstatus") == "F", "not a date").otherwise(F.date_format("o_orderdate", "MMM dd, yyyy"))
    return V.table(spark, d, "orders").withColumn("_t", text).select("o_orderkey", parse_us_date("_t").alias("day"))


# --- submissions -----------------------------------------------------------

_P = "lower(significance) IN ('pathogenic', 'likely pathogenic')"


@query(f"""SELECT variation_id, significance, method, count(*) AS n, max(date) AS last_date FROM submissions
    WHERE variation_id IN (SELECT variation_id FROM submissions WHERE {_P}) GROUP BY ALL""")
def any_path_group_filter(spark, d):
    rows = B.keep_groups_with(V.submissions(spark, d), ["variation_id"], level_in("significance", ["pathogenic", "likely pathogenic"]))
    return rows.groupBy("variation_id", "significance", "method").agg(
        F.count(F.lit(1)).alias("n"), F.max("date").alias("last_date"))


@query("""SELECT lab_id, count(*) AS n_submissions, max(date) AS last_evaluated FROM submissions
    WHERE method LIKE '%clinical testing%' GROUP BY lab_id HAVING count(*) > 290 AND max(date) >= DATE '2001-06-01'""")
def submitter_ranking(spark, d):
    clinical = V.submissions(spark, d).where(B.is_clinical("method"))
    return B.submitter_ranking(clinical, "lab_id", min_submissions=290, since="2001-06-01")


@query(f"""
    WITH v AS (FROM summary WHERE clin_sig = 1 AND assembly = 'GRCh37'),
    j AS (SELECT s.*, v.gene, {_P} AS p, method LIKE '%clinical testing%' AS c FROM submissions s JOIN v USING (variation_id)),
    f AS (SELECT *, bool_or(p) OVER (PARTITION BY variation_id) AS pa,
        bool_or(p AND c) OVER (PARTITION BY variation_id) AS pc, bool_or(p AND NOT c) OVER (PARTITION BY variation_id) AS pn FROM j)
    SELECT gene, nullif(count(*) FILTER (WHERE pa), 0) AS submissions_all,
      nullif(count(*) FILTER (WHERE c AND pc), 0) AS submissions_clinic,
      nullif(count(*) FILTER (WHERE NOT c AND pn), 0) AS submissions_no_clinic,
      nullif(count(DISTINCT variation_id) FILTER (WHERE pa), 0) AS variants_all,
      nullif(count(DISTINCT variation_id) FILTER (WHERE pc), 0) AS variants_clinic,
      nullif(count(DISTINCT variation_id) FILTER (WHERE pn), 0) AS variants_no_clinic,
      nullif(count(*) FILTER (WHERE p), 0) AS path_submissions_all,
      nullif(count(*) FILTER (WHERE p AND c), 0) AS path_submissions_clinic,
      nullif(count(*) FILTER (WHERE p AND NOT c), 0) AS path_submissions_no_clinic,
      string_agg(DISTINCT phenotype, ', ' ORDER BY phenotype) FILTER (WHERE p AND c) AS clinical_path_phenotypes
    FROM f WHERE pa GROUP BY gene""")
def gene_submission_summary(spark, d):
    variants = V.variant_summary(spark, d).where((F.col("ClinSigSimple") == 1) & (F.col("assembly") == "GRCh37"))
    return B.gene_submission_summary(variants, V.submissions(spark, d))


LABS = ("NATION_1", "NATION_4", "NATION_7", "NATION_11", "NATION_15")
LAB_SQL = "submitter IN ('NATION_1', 'NATION_4', 'NATION_7', 'NATION_11', 'NATION_15')"
FLAGS_SQL = f"""
    WITH s AS (SELECT *, CASE WHEN NOT {LAB_SQL} THEN false ELSE date >= DATE '1997-01-01' END AS recent, {_P} AS p FROM submissions __WHERE__)
    SELECT variation_id, coalesce(bool_or(recent AND clarification = 'No Information'), false) AS flag_hc_lab_unspecified_phenotype,
      count(*) FILTER (WHERE correct_phenotype) AS n_submissions,
      CASE WHEN bool_or(recent) FILTER (WHERE correct_phenotype) THEN true
           WHEN count(*) FILTER (WHERE correct_phenotype AND recent IS NULL) > 0 THEN NULL ELSE false END AS high_confidence_any,
      coalesce(string_agg(significance, ', ' ORDER BY significance) FILTER (WHERE correct_phenotype AND recent), '') AS high_confidence_significance
    FROM s GROUP BY variation_id HAVING bool_or(p) FILTER (WHERE correct_phenotype)"""


@query(FLAGS_SQL.replace("__WHERE__", ""))
def hc_lab_flags(spark, d):
    return B.high_confidence_flags(V.submissions(spark, d), LABS, "1997-01-01")


@query(f"""
    WITH flags AS ({FLAGS_SQL.replace("__WHERE__", "WHERE method LIKE '%clinical testing%'")}),
    v AS (SELECT DISTINCT variation_id FROM submissions WHERE method LIKE '%clinical testing%' AND correct_phenotype)
    SELECT x.variant_str, replace(x.variant_str, ':', '-') AS variant, variation_id, flag_hc_lab_unspecified_phenotype,
      high_confidence_any, high_confidence_significance,
      'https://www.ncbi.nlm.nih.gov/clinvar/variation/' || variation_id AS clinvar_link,
      'https://example.org/variant/' || replace(x.variant_str, ':', '-') AS allele_link
    FROM flags JOIN v USING (variation_id) JOIN sites x USING (variation_id)
    WHERE x.variant_str IN (SELECT variant_str FROM observed WHERE ac > 0)""")
def annotated_pathogenic(spark, d):
    sites = B.site_positions(V.archive_sites(spark, d))
    fixed = {
        "type": F.lit("single nucleotide variant"), "name": F.lit("n"), "gene": F.lit("g"), "last_evaluated": F.lit(None).cast("string"),
        "phenotype_list": F.lit("p"), "number_submitters": F.lit(1), "traits": F.lit("t"), "n_called": F.lit(1),
        "n_not_called": F.lit(0), "ac": F.lit(1), "n_het": F.lit(1),
    }
    annotated = V.submissions(spark, d).withColumn("date", F.date_format("date", "MMM dd, yyyy")).join(
        sites, "variation_id").withColumns(fixed)
    observed = B.observed_counts(V.observed_variants(spark, d).withColumn("n_not_called", F.lit(0)))
    out = B.annotated_pathogenic(annotated, observed.where(F.col("ac") > 0), LABS, "1997-01-01",
                                 allele_link="https://example.org/variant/")
    return out.select("variant_str", "variant", "variation_id", "flag_hc_lab_unspecified_phenotype",
                      "high_confidence_any", "high_confidence_significance", "clinvar_link", "allele_link")


_REPORTED_SQL = f"""
    genes AS (SELECT p_brand AS gene, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS traits FROM part WHERE p_size < 12 AND (p_type <> 'MEDIUM' OR p_brand < 'Brand#2') GROUP BY p_brand),
    v AS (SELECT s.variation_id, s.gene, s.hgnc_id, chr, pos, ref, alt, variant_str, traits FROM summary s JOIN sites USING (variation_id)
      JOIN genes USING (gene) WHERE clin_sig = 1 AND assembly = 'GRCh37'
      AND variant_str IN (SELECT variant_str FROM observed)),
    a AS (SELECT v.*, x.significance, x.method FROM v JOIN submissions x USING (variation_id)
      WHERE variation_id IN (SELECT variation_id FROM submissions WHERE {_P})),
    b AS (FROM a WHERE method LIKE '%clinical testing%' OR traits LIKE '%MEDIUM%'),
    c AS (FROM b WHERE variation_id IN (SELECT variation_id FROM b WHERE {_P})),
    reported AS (SELECT c.*, n_called, n_het, ac FROM c JOIN observed USING (variant_str) WHERE ac > 0)"""


def _reported(spark, d):
    listed = (F.col("p_size") < 12) & ((F.col("p_type") != "MEDIUM") | (F.col("p_brand") < "Brand#2"))
    part = V.table(spark, d, "part").where(listed).select(
        F.col("p_brand").alias("gene"), F.col("p_type").alias("trait")).distinct()
    return B.reported_submissions(
        V.variant_summary(spark, d), B.site_positions(V.archive_sites(spark, d)), V.submissions(spark, d),
        B.observed_counts(V.observed_variants(spark, d)), part, "GRCh37",
        keep_traits=("MEDIUM",))


@query(f"WITH {_REPORTED_SQL} SELECT gene, variation_id, significance, method, n_called, CAST(ac AS INTEGER) AS ac, count(*) AS n FROM reported GROUP BY ALL")
def reported_submissions(spark, d):
    return _reported(spark, d).groupBy("gene", "variation_id", "significance", "method", "n_called", "ac").agg(
        F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_REPORTED_SQL} SELECT DISTINCT variation_id, gene, chr, pos, ref, alt, hgnc_id AS "HGNC_ID", traits, variant_str,
    n_called, CAST(ac AS INTEGER) AS ac, n_het FROM reported""")
def reported_pathogenic(spark, d):
    return B.reported_variants(_reported(spark, d)).drop("n_not_called", "AF")


@query(f"""SELECT variation_id, CASE WHEN bool_or(c) THEN true WHEN count(*) FILTER (WHERE c IS NULL) > 0 THEN NULL ELSE false END AS any_recent
    FROM (SELECT variation_id, date >= DATE '2001-07-01' AS c FROM submissions) GROUP BY variation_id""")
def any_flag_with_unknowns(spark, d):
    return B.flag_any(V.submissions(spark, d), ["variation_id"], F.col("date") >= F.lit("2001-07-01").cast("date"), "any_recent")
