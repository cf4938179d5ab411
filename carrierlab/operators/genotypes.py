"""Genotype quality control and variant filtering.

Genotypes are kept in long form, one row per (variant, sample):
``contig, pos, alleles, sample, gt, ad, dp, gq`` with ``gt`` an array of two
allele indexes (null for a missing call) and ``ad`` the read depth per allele;
``pl``, where a source has it, is the scaled likelihood per unordered genotype.
Everything per genotype is a map-side expression; the only shuffle is the
per-variant aggregation, which combines partially before it moves rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierlab import settings as S
from carrierlab.functions.columns import as_col, parse_interval
from carrierlab.operators.ranges import remap_blocks, within_any_interval

VARIANT = ("contig", "pos", "alleles")


# --- samples and regions ---------------------------------------------------

def drop_flagged_samples(
    genotypes: DataFrame, samples: DataFrame, sample: str = "sample", key: str = "s",
    flag: str = "is_forbidden",
) -> DataFrame:
    """Remove samples whose looked-up flag is true; unlisted samples go too.

    A sample without an entry has an unknown flag, and a filter keeps a row
    only when its condition is known.
    """
    allowed = samples.where(F.col(flag) == F.lit(False)).select(F.col(key).alias(sample)).distinct()
    return genotypes.join(allowed, sample, "left_semi")


def genes_without_interval(intervals: DataFrame, genes: Iterable[str]) -> list[str]:
    """The listed genes that have no readable interval, sorted."""
    genes = list(genes)
    known = F.col("gene").isin(genes)
    for part in parse_interval("interval"):
        known = known & part.isNotNull()
    found = {r["gene"] for r in intervals.where(known).select("gene").distinct().collect()}  # listed genes at most
    return sorted(set(genes) - found)


def gene_intervals(
    intervals: DataFrame, genes: Iterable[str] = S.GENE_SET, buffer: int = S.INTERVAL_BUFFER
) -> DataFrame:
    """(gene, interval text) to contig/start/end rows with a buffer.

    A listed gene without an interval is an error. The check runs a Spark job
    while the plan is built.
    """
    genes = list(genes)
    missing = genes_without_interval(intervals, genes)
    if missing:
        raise ValueError(f"no interval for genes: {missing}")
    contig, start, end = parse_interval("interval", buffer)
    return intervals.where(F.col("gene").isin(genes)).select(
        "gene", contig.alias("contig"), start.alias("start"), end.alias("end")
    )


def filter_to_intervals(df: DataFrame, intervals: DataFrame) -> DataFrame:
    return within_any_interval(df, intervals)


# --- multi-allelic split ---------------------------------------------------

def _shared(ref: Column, alt: Column, at_end: bool) -> Column:
    """Number of bases ref and alt share at one side, leaving one base each.

    A back-reference finds the longest common start in one pass; single-base
    variants, by far the most, never reach it.
    """
    room = F.least(F.length(ref), F.length(alt)) - 1
    if at_end:
        parts = [F.reverse(F.right(ref, room)), F.reverse(F.right(alt, room))]
    else:
        parts = [F.left(ref, room), F.left(alt, room)]
    common = F.regexp_extract(F.concat_ws("|", *parts), r"^([^|]*)[^|]*\|\1", 1)
    return F.when(room > 0, F.length(common)).otherwise(F.lit(0))


def with_minimal_alleles(df: DataFrame, pos: str, ref: str, alt: str) -> DataFrame:
    """Shortest spelling of a variant: shared trailing, then leading bases go.

    Done in named steps, so that each count is evaluated once per row.
    """
    tail = _shared(F.col(ref), F.col(alt), True)
    cut = df.withColumn("_tail", tail).withColumns({
        ref: F.left(ref, F.length(ref) - F.col("_tail")),
        alt: F.left(alt, F.length(alt) - F.col("_tail")),
    })
    head = _shared(F.col(ref), F.col(alt), False)
    return cut.withColumn("_head", head).withColumns({
        pos: F.col(pos) + F.col("_head"),
        ref: F.substring(F.col(ref), F.col("_head") + 1, F.length(ref)),
        alt: F.substring(F.col(alt), F.col("_head") + 1, F.length(alt)),
    }).drop("_tail", "_head")


def _downcoded(likelihoods: str, this: Column) -> Column:
    """Least likelihood with 0, 1 and 2 copies of allele ``this``; null where they can't be told.

    Genotype j/k (j <= k) has the place k(k+1)/2 + j, so a list has n(n+1)/2
    values for n alleles. A list of another length is no diploid one.
    """
    n = F.size("alleles")
    copies = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform(
        F.sequence(F.lit(0), k), lambda j: (j == this).cast("int") + (k == this).cast("int"))))
    pl = F.col(likelihoods)

    def least_of(i: int) -> Column:
        return F.array_min(F.zip_with(pl, copies, lambda x, c: F.when(c == i, x)))

    least = F.array(*[least_of(i) for i in range(3)])
    whole = (F.size(pl) * 2 == n * (n + 1)) & ~F.exists(pl, lambda x: x.isNull())
    return F.when(whole, F.when(n == 2, pl).otherwise(least))


def quality_of_likelihoods(pl: Column) -> Column:
    """Second least likelihood less the least, both at most 99."""
    ordered = F.sort_array(F.concat(pl, F.array(F.lit(99), F.lit(99))))
    return F.get(ordered, 1) - F.get(ordered, 0)


def split_multiallelic(genotypes: DataFrame, minimise: bool = True) -> DataFrame:
    """One row per alternate allele, genotypes and depths coded against it.

    Other alternates count as reference: ``gt`` becomes 0/1 per haplotype and
    ``ad`` becomes [all other reads, reads of this allele]. If there is a
    column ``pl``, it becomes the least likelihood with 0, 1 and 2 copies of
    this allele, and ``gq``, if there, is taken from it, at sites of one
    alternate too; without likelihoods the reported ``gq`` stays.
    Spanning-deletion alleles (``*``) give no row.
    """
    alts = F.slice(F.col("alleles"), 2, F.greatest(F.size("alleles") - 1, F.lit(0)))
    rows = genotypes.select(
        "*", F.posexplode(alts).alias("_i", "_alt"),
    ).where(F.col("_alt") != "*")
    this = F.col("_i") + 1
    gt = F.when(
        F.col("gt").isNotNull(),
        F.sort_array(F.transform("gt", lambda a: F.when(a == this, 1).otherwise(0))),
    )
    mine = F.try_element_at("ad", this + 1)
    ad = F.when(
        F.col("ad").isNotNull(),
        F.array(F.aggregate("ad", F.lit(0), lambda x, y: x + y) - mine, mine),
    )
    if "pl" in genotypes.columns:
        rows = rows.withColumn("pl", _downcoded("pl", this))
        if "gq" in genotypes.columns:
            rows = rows.withColumn("gq", F.coalesce(quality_of_likelihoods(F.col("pl")), F.col("gq")))
    out = rows.select(
        *[c for c in genotypes.columns if c not in ("alleles", "gt", "ad")],
        F.element_at("alleles", 1).alias("_ref"), "_alt", gt.alias("gt"), ad.alias("ad"),
        this.alias("a_index"), (F.size("alleles") > 2).alias("was_split"),
    )
    if minimise:
        out = with_minimal_alleles(out, "pos", "_ref", "_alt")
    return out.withColumn("alleles", F.array("_ref", "_alt")).select(
        *genotypes.columns, "a_index", "was_split")


# --- genotype mask ---------------------------------------------------------

def low_quality(
    het: Column, ref_reads: Column, alt_reads: Column, depth: Column, quality: Column
) -> Column:
    """True or null where a genotype must be masked.

    Null means that a needed value is missing and no other test decides; the
    caller masks on null as well. Zero reads leave the allele balance
    undefined, which does not mask.
    """
    reads = ref_reads + alt_reads
    unbalanced = F.when(reads == 0, F.lit(False)).otherwise(
        alt_reads < reads * F.lit(S.MIN_ALLELE_BALANCE)
    )
    return (quality < S.MIN_GQ) | (depth < S.MIN_DP) | (het & unbalanced)


def mask_genotypes(genotypes: DataFrame) -> DataFrame:
    """Set ``gt`` to null for low-quality biallelic genotypes."""
    bad = low_quality(
        F.element_at("gt", 1) != F.element_at("gt", 2),
        F.element_at("ad", 1), F.element_at("ad", 2), F.col("dp"), F.col("gq"),
    )
    return genotypes.withColumn("gt", F.when(F.coalesce(~bad, F.lit(False)), F.col("gt")))


# --- variant statistics ----------------------------------------------------

def variant_qc(
    genotypes: DataFrame, by: Sequence[str] = VARIANT, alt_copies: str | Column | None = None
) -> DataFrame:
    """Per-variant counts over biallelic genotypes (missing calls excluded).

    ``alt_copies`` is the number of alternate alleles (0, 1, 2 or null); by
    default it is taken from ``gt``.
    """
    copies = (
        F.aggregate("gt", F.lit(0), lambda x, y: x + y) if alt_copies is None else as_col(alt_copies)
    )
    counted = genotypes.select(*by, copies.alias("_copies")).groupBy(*by).agg(
        F.count("_copies").alias("n_called"),
        F.count(F.when(F.col("_copies").isNull(), 1)).alias("n_not_called"),
        F.count(F.when(F.col("_copies") == 1, 1)).alias("n_het"),
        F.count(F.when(F.col("_copies") == 2, 1)).alias("n_hom"),
    )
    an = F.col("n_called") * 2
    ac = F.col("n_het") + F.col("n_hom") * 2
    return counted.select(
        *by, ac.alias("ac"), an.alias("an"), F.try_divide(ac, an).alias("af"),
        "n_called", "n_not_called", "n_het", "n_hom",
        (F.col("n_het") + F.col("n_hom")).alias("n_non_ref"),
    )


def observed_variants(variants: DataFrame) -> DataFrame:
    """Variants with at least one alternate allele called."""
    return variants.where(F.col("ac") > 0)


def matrix_counts(genotypes: DataFrame, by: Sequence[str] = VARIANT, sample: str = "sample"):
    """Number of distinct variants and of distinct samples, as one row."""
    return genotypes.agg(
        F.count_distinct(F.struct(*by)).alias("variants"),
        F.count_distinct(F.col(sample)).alias("samples"),
    )


# --- consequences ----------------------------------------------------------

def keep_consequences(
    variants: DataFrame, genes: Iterable[str], column: str = "consequences",
    out: str | None = None, lof: str | None = None,
) -> DataFrame:
    """Keep the consequences on listed genes, and variants that have any.

    With ``lof`` given (e.g. ``"HC"``) a consequence must carry it as well.
    """
    listed = F.array(*[F.lit(g) for g in genes])

    def wanted(t: Column) -> Column:
        hit = F.array_contains(listed, t["gene_symbol"])
        return hit & (t["lof"] == lof) if lof is not None else hit

    out = out or column
    return variants.withColumn(out, F.filter(column, wanted)).where(F.size(out) >= 1)


def expression_proportion(
    consequences: DataFrame, expression: DataFrame, gene_maximum: DataFrame,
    severity: Sequence[str] = S.CODING_SEVERITY, dropped_tissues: Iterable[str] = (),
    variant: Sequence[str] = VARIANT, listed_only: bool = False,
) -> DataFrame:
    """Share of a gene's expression on transcripts that carry a consequence.

    ``consequences``: variant columns, gene, transcript, csq, lof_flag;
    ``expression``: gene, transcript, tissue, value; ``gene_maximum``: gene,
    tissue, max_value. Per (variant, gene, consequence, tissue) the expression
    of the carrying transcripts is summed and divided by the gene's maximum;
    the mean runs over tissues with a positive maximum. One row per variant
    remains: the most severe consequence, then the largest proportion; its
    ``severity_rank`` is the place in ``severity`` (behind it for others).
    With ``listed_only`` consequences outside the list are left out, before
    transcripts are joined.
    """
    variant = list(variant)
    if listed_only:
        consequences = consequences.where(F.col("csq").isin(list(severity)))
    used = expression.where(~F.col("tissue").isin(list(dropped_tissues))) if dropped_tissues else expression
    group = [*variant, "gene", "csq", "lof_flag"]
    per_tissue = (
        consequences.join(used, ["gene", "transcript"])
        .groupBy(*group, "tissue").agg(F.sum("value").alias("expressed"))
        .join(gene_maximum, ["gene", "tissue"])
        .withColumn("proportion",
                    F.when(F.col("max_value") > 0, F.col("expressed") / F.col("max_value")))
    )
    tissue_place = F.coalesce(F.nullif(
        F.array_position(F.array(*[F.lit(t) for t in S.TISSUES]), F.col("tissue")), F.lit(0)), F.lit(len(S.TISSUES) + 1))
    per_csq = per_tissue.groupBy(*group).agg(
        F.avg("proportion").alias("mean_proportion"),
        # bounded: one entry per tissue, in the fixed order, others behind
        F.map_from_entries(F.transform(
            F.sort_array(F.collect_list(F.struct(tissue_place.alias("place"), "tissue", "proportion"))),
            lambda x: F.struct(x["tissue"], x["proportion"])))
        .alias("by_tissue"),
    )
    order = F.array_position(F.array(*[F.lit(s) for s in severity]), F.col("csq"))
    rank = F.when(order > 0, order).otherwise(len(severity) + 1)
    # Rank and proportion in one number, whose minimum a hash aggregate keeps;
    # only rows that reach it are told apart by their texts. The proportion is
    # rounded, so that summation order cannot decide between equal means.
    share = F.least(F.round((F.coalesce(F.col("mean_proportion"), F.lit(-1.0)) + 1) * 1e9).cast("long"),
                    F.lit((1 << 44) - 1))
    ranked = per_csq.withColumn("severity_rank", rank.cast("int")).withColumn(
        "_key", F.shiftleft(F.col("severity_rank").cast("long"), 44) - share)
    least = ranked.groupBy(*variant).agg(F.min("_key").alias("_least"))
    reached = ranked.join(least, variant).where("_key = _least")
    best = F.min_by(F.struct("gene", "csq", "severity_rank", "lof_flag", "mean_proportion", "by_tissue"),
                    F.struct("gene", "lof_flag"))
    return reached.groupBy(*variant).agg(best.alias("_worst")).select(*variant, "_worst.*")


def tissue_text(by_tissue: str | Column) -> Column:
    """``tissue:value`` list of a map, values in scientific notation."""
    return F.concat_ws(",", F.transform(
        F.map_entries(as_col(by_tissue)),
        lambda e: F.concat(e["key"], F.lit(":"), F.when(
            e["value"].isNotNull(), F.format_string("%.5e", e["value"])).otherwise("NA")),
    ))


# --- build conversion ------------------------------------------------------

def lift_variants(variants: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add the position on the other build and the key with original alleles."""
    moved = remap_blocks(variants, blocks)
    return moved.withColumn(
        "lifted_key",
        F.when(F.col("new_pos").isNotNull(),
               F.concat_ws(":", "new_contig", F.col("new_pos").cast("string"),
                           F.concat_ws(":", "alleles"))),
    )


# --- carriers --------------------------------------------------------------

def carrier_list(genotypes: DataFrame, variants: DataFrame, by: Sequence[str] = VARIANT) -> DataFrame:
    """(sample, variant annotations) for every call with an alternate allele.

    The filter on calls runs before the join, so reference calls, nearly all
    of a genotype table, never reach the shuffle.
    """
    carrying = genotypes.where(F.exists("gt", lambda a: a > 0)).select(*by, "sample", "gt")
    return carrying.join(variants, list(by))


def quality_filter(
    carriers: DataFrame, quality: DataFrame, keys: Sequence[str] = ("variant", "subject"),
    flag: str = "failed",
) -> DataFrame:
    """Carrier rows whose looked-up quality flag is false (an unlisted row has none)."""
    return carriers.join(quality.where(F.col(flag) == F.lit(False)), list(keys))
