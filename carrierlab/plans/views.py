"""Study tables derived from the generic order/part test tables.

The test data has no genotypes or phenotypes. Every study table here is
computed by Spark from whole input tables: orders give measurements, order
lines give observed variants and submissions, parts give genes and traits.
Missing values arise from missing orders or particular field values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GENE_NAMES = {
    "Brand#1": "GCK", "Brand#2": "HNF1A", "Brand#3": "HNF1B", "Brand#4": "PDX1", "Brand#5": "HNF4A",
}
TRAIT_NAMES = {
    "MEDIUM": "High HDL", "STANDARD": "High LDL", "LARGE": "Low LDL", "PROMO": "Obesity",
    "SMALL": "High triglycerides", "ECONOMY": "MODY",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _names(col: str, names: dict[str, str]) -> Column:
    expr = F
    for old, new in names.items():
        expr = expr.when(F.col(col) == old, new)
    return expr.otherwise(F.col(col))


def phenotypes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer: age, sex, ancestry, medication and measurements."""
    price, priority, status = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")

    def top(p: str) -> Column:
        return F.max(F.when(priority == p, price))

    def least(p: str) -> Column:
        return F.min(F.when(priority == p, price))

    def count(s: str) -> Column:
        return F.count(F.when(status == s, 1))

    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(
        top("1-URGENT").alias("_urgent"), top("2-HIGH").alias("_high"),
        top("3-MEDIUM").alias("_medium"), top("4-NOT SPECIFIED").alias("_other"),
        top("5-LOW").alias("_low"), least("5-LOW").alias("_low_min"),
        least("2-HIGH").alias("_high_min"), least("1-URGENT").alias("_urgent_min"),
        count("F").alias("_n_f"), count("P").alias("_n_p"), count("O").alias("_n_o"),
        F.min("o_totalprice").alias("score"),
    )
    customers = table(spark, folder, "customer")
    places = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("ancestry"))
    base = F.when(F.col("_n_f") == 0, None).when(F.col("_n_f") >= 5, 1).otherwise(0)
    return (
        customers.join(places, "c_nationkey")
        .join(orders, F.col("c_custkey") == F.col("subject"))
        .select(
            "subject", F.col("c_mktsegment").alias("cohort"), "ancestry",
            F.when(F.col("c_nationkey") < 12, 1).otherwise(2).alias("sex"),
            (F.floor((F.col("c_acctbal") + 1000) / 200) + 20).cast("int").alias("age"),
            F.when(F.col("_n_p") == 0, None).when(F.col("_n_p") >= 4, 1).otherwise(0).alias("lipidmeds"),
            (F.col("_urgent") / 1999).alias("ldl_mgdl"), (F.col("_high") / 4999).alias("hdl_mgdl"),
            (F.col("_medium") / 1499).alias("tg_mgdl"), (F.col("_other") / 9999).alias("bmi"),
            (F.col("_low") / 59999).alias("hba1c"), (F.col("_low_min") / 39999).alias("fast_glu_mmoll"),
            (F.col("_high_min") / 39999).alias("h_glu"), base.alias("t2d_base"),
            F.when(F.col("_urgent") > 480000, "LDL_High").when(F.col("_urgent_min") < 20000, "LDL_Low")
            .when(F.col("_other") > 490000, "BMI_High").when(F.col("_n_o") == 0, None).otherwise("none")
            .alias("esp_phenotype"),
            F.when(base == 1, F.floor(F.col("_low_min") / 4999)).cast("int").alias("aod"),
            F.when(base == 1, F.floor(F.col("_high_min") / 4999)).cast("int").alias("diagnosed_0"),
            "score",
        )
    )


def prepared_phenotypes(spark: SparkSession, folder: str) -> DataFrame:
    """Phenotypes with diagnosis flags and treatment-adjusted measures."""
    from carrierlab.operators.cohort import adjust_for_treatment, diagnosis_flags

    return adjust_for_treatment(diagnosis_flags(phenotypes(spark, folder), base="t2d_base"))


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Variants: gene, trait, population frequency and count."""
    trait = F.when((F.col("p_type") == "ECONOMY") & (F.col("p_size") > 30), "MODY Extended").otherwise(
        _names("p_type", TRAIT_NAMES))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("partkey"), _names("p_brand", GENE_NAMES).alias("gene"),
        trait.alias("trait"),
        F.when(F.col("p_size") <= 45, F.col("p_size") / 20000).alias("af"),
        F.when(F.col("p_name").endswith("ring"), 0).when(F.col("p_size") <= 45, F.col("p_size")).alias("ac"),
    )


def gene_traits(spark: SparkSession, folder: str) -> DataFrame:
    return parts(spark, folder).where(F.col("af") >= 0.0002).select("gene", "trait").distinct()


def carriers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line: a customer seen with a variant."""
    quantity, flag = F.col("l_quantity"), F.col("l_returnflag")
    level = (
        F.when((flag == "R") & (quantity > 46), "Pathogenic").when((flag == "R") & (quantity > 43), "Likely_LOF")
        .when(flag == "R", "Benign").when((flag == "A") & (quantity > 40), "VUS")
        .when(flag == "A", "Likely benign").otherwise("Not_LOF")
    )
    evidence = F.when(F.col("l_tax") > 0.065, "Review").when(F.col("l_linestatus") == "F", "LOF").otherwise("ClinVar")
    owners = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", F.col("o_custkey").alias("subject"), F.col("c_mktsegment").alias("cohort"))
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("partkey"), level.alias("level"), evidence.alias("evidence"),
        F.when(F.col("l_discount") > 0, F.concat(F.lit("note "), F.col("l_linenumber").cast("string"))).alias("notes"),
    )
    return (
        lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts(spark, folder), "partkey")
        .select("subject", "cohort", F.col("partkey").cast("string").alias("variant"),
                F.col("partkey").cast("string").alias("variant_b37"), "gene", "trait", "level",
                "evidence", "notes", "af", "ac")
    )


def genotypes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line: biallelic call, reads, depth and quality."""
    flag = F.col("l_returnflag")
    gt = F.when(flag == "R", F.array(F.lit(0), F.lit(1))).when(flag == "A", F.array(F.lit(1), F.lit(1))).otherwise(
        F.array(F.lit(0), F.lit(0)))
    reads = F.array(F.round(F.col("l_tax") * 100).cast("int"), F.round(F.col("l_discount") * 100).cast("int"))
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("partkey"), F.col("l_orderkey").alias("sample"),
        gt.alias("gt"), F.when(F.col("l_linenumber") != 7, reads).alias("ad"),
        (F.col("l_linenumber") * 5).alias("dp"), F.nullif(F.col("l_quantity"), F.lit(25.0)).alias("gq"),
    )


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line: a laboratory's claim about a variant."""
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
    labs = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("submitter"))
    return table(spark, folder, "lineitem").join(labs, "l_suppkey").select(
        F.col("l_partkey").alias("variation_id"), F.col("l_suppkey").alias("lab_id"), "submitter",
        F.when((flag == "R") & (quantity >= 48), "Pathogenic").when((flag == "A") & (quantity >= 49), "Likely pathogenic")
        .when(flag == "R", "Uncertain significance").otherwise("Benign").alias("significance"),
        F.when(F.col("l_linestatus") == "F", "clinical testing").when(F.col("l_discount") > 0.02, "literature only")
        .alias("method"),
        F.when(F.col("l_tax") > 0, F.col("l_shipdate").cast("date")).alias("date"),
        F.concat(F.lit("P"), F.col("l_linenumber").cast("string")).alias("phenotype"),
        F.when(F.col("l_linenumber") > 3, "No Information").otherwise("Specified").alias("clarification"),
        (F.col("l_discount") > 0.015).alias("correct_phenotype"),
    )


def variant_summary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("variation_id"), F.col("p_brand").alias("gene"),
        (F.col("p_size") > 10).cast("int").alias("ClinSigSimple"),
        F.when(F.col("p_retailprice") < 960, "GRCh37").otherwise("GRCh38").alias("assembly"),
        F.concat(F.lit("HGNC:"), F.col("p_size").cast("string")).alias("HGNC_ID"),
    )


def archive_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Site rows in the archive's own layout."""
    return table(spark, folder, "part").select(
        F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).alias("CHROM"),
        (F.col("p_size") * 1000 + F.col("p_partkey")).cast("long").alias("POS"), F.col("p_partkey").alias("ID"),
        F.left("p_type", F.lit(1)).alias("REF"), F.upper(F.left("p_name", F.lit(1))).alias("ALT"),
        F.concat(F.lit("AF=0.1;ALLELEID="), (F.col("p_partkey") + 15000).cast("string"), F.lit(";CLNSIG=x"))
        .alias("INFO"),
    )


def observed_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The study's own variants, counts as an array-like text."""
    from carrierlab.operators.submissions import site_positions

    counted = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("variation_id")).agg(
        F.count(F.lit(1)).alias("n_called"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_het"),
        F.count(F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40), 1)).alias("_alt"),
    )
    return site_positions(archive_sites(spark, folder)).join(counted, "variation_id").select(
        F.concat_ws(":", "chr", F.col("pos").cast("string"), "ref", "alt").alias("variant"),
        "n_called", F.lit(0).alias("n_not_called"),
        F.concat(F.lit("["), F.col("n_called").cast("string"), F.lit(","), F.col("_alt").cast("string"), F.lit("]")).alias("AC"),
        F.lit("[1,0]").alias("AF"), "n_het",
    )


def call_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of every part in the samples named after nations, with likelihoods, as a call file holds them.

    A part is a variant; of a nation's suppliers the first line of the part is its call.
    """
    labs = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("sample"))
    first = table(spark, folder, "lineitem").join(labs, "l_suppkey").groupBy("l_partkey", "sample").agg(
        F.min(F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_tax", "l_discount")).alias("x"))
    site = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat(F.lit("chr"), F.when(F.col("p_size") > 46, "X").otherwise((F.col("p_size") % 23).cast("string"))).alias("contig"),
        (F.col("p_partkey") * 10).cast("int").alias("pos"), F.array(F.lit("A"), F.lit("C")).alias("alleles"))
    flag, quantity = F.col("x.l_returnflag"), F.col("x.l_quantity").cast("int")
    gt = F.when(flag == "R", F.array(F.lit(0), F.lit(1))).when(flag == "A", F.array(F.lit(1), F.lit(1))).when(
        quantity > 5, F.array(F.lit(0), F.lit(0)))
    likelihoods = F.when(flag == "R", F.array(quantity, F.lit(0), quantity + 9)).when(
        flag == "A", F.array(quantity + 40, quantity - 10, F.lit(3)))
    return first.join(site, "l_partkey").select(
        "contig", "pos", "alleles", "sample", gt.alias("gt"),
        F.array(F.round(F.col("x.l_tax") * 100).cast("int"), F.round(F.col("x.l_discount") * 100).cast("int")).alias("ad"),
        (F.col("x.l_linenumber") * 5).cast("int").alias("dp"), quantity.alias("gq"), likelihoods.alias("pl"))
