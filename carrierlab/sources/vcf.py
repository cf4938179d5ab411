"""Variant call text: ingest to long form, and ordered export.

A data line holds every sample of one variant, so lines are split and exploded
inside tasks, in the JVM. The lines are scanned once; each file's header is read
by a data source of its own, which stops at the header's last line.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping
from urllib.parse import unquote, urlparse

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from carrierlab.operators.ranges import within_any_interval

# Executors get the source itself and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")
# Headers up to this size in all go to every task; larger ones are joined.
HEADER_BYTES = 64 << 20


class CallHeaders(DataSource):
    """(file, samples) of each listed call file; samples are null where a file has no header.

    Files are opened by the tasks, a file each, and read as far as the first
    line that is no comment. ``.gz`` and ``.bgz`` files are unpacked.
    """

    @classmethod
    def name(cls):
        return "call_headers"

    def schema(self):
        return "file string, samples array<string>"

    def reader(self, schema):
        return _HeaderReader(self.options["files"].split("\n"))


class _HeaderReader(DataSourceReader):
    def __init__(self, files):
        self.files = files

    def partitions(self):
        return [InputPartition(f) for f in self.files]

    def read(self, partition):
        samples = None
        with _opened(partition.value) as lines:
            for line in lines:
                if not line.startswith(b"#"):
                    break
                if line.startswith(b"#CHROM"):
                    samples = line.decode().rstrip("\r\n").split("\t")[len(FIXED):]
                    break
        yield partition.value, samples


def _opened(url: str):
    import gzip
    import io

    scheme = urlparse(url).scheme
    if scheme in ("", "file"):
        raw = open(unquote(urlparse(url).path), "rb")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(url)
        raw = io.BufferedReader(store.open_input_file(path))
    return gzip.open(raw) if url.endswith((".gz", ".bgz")) else raw


def _file_key(file: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def headers(spark: SparkSession, path) -> DataFrame:
    """(file, samples): the sample names of each call file under ``path``.

    A file without a header, as a part file that was written apart from it,
    takes the header of the others, which must then have one only.
    """
    files = spark.read.text(path).inputFiles()
    spark.dataSource.register(CallHeaders)
    found = spark.read.format("call_headers").option("files", "\n".join(files)).load().select(
        _file_key(F.col("file")).alias("file"), "samples")
    least, most = found.select(F.min("samples")).scalar(), found.select(F.max("samples")).scalar()
    return found.withColumn("samples", F.coalesce("samples", F.when(least == most, least).otherwise(F.raise_error(
        F.lit("call files have different sample headers, and a file has none")).cast("array<string>"))))


def _field(call: Column, keys: Column, name: str) -> Column:
    at = F.array_position(keys, name).cast("int")
    value = F.when(at > 0, F.try_element_at(call, at))
    return F.when((value != ".") & (value != ""), value)


def read_genotypes(
    spark: SparkSession, path, partitions: int | None = None, samples: DataFrame | None = None,
    intervals: DataFrame | None = None,
) -> DataFrame:
    """Long genotypes: contig, pos, alleles, sample, gt, ad, dp, gq, pl.

    A call with any missing allele is null; phasing is not kept. A list of
    depths or likelihoods with any missing value is null. Files may have
    different samples. ``samples`` (column ``sample``) and ``intervals``
    (contig, start, end) leave out samples and lines before a call becomes a
    row. Pass ``partitions`` for inputs that cannot be split by the scan.
    """
    lines = spark.read.text(path).select("value", _file_key(F.col("_metadata.file_path")).alias("file")).where(
        ~F.col("value").startswith("#"))
    if partitions:
        lines = lines.repartition(partitions)
    site = lines.select("file", F.split("value", "\t", len(FIXED) + 1).alias("f")).select(
        "file", F.get("f", F.lit(0)).alias("contig"), F.get("f", F.lit(1)).cast("int").alias("pos"),
        F.concat(F.array(F.get("f", F.lit(3))), F.split(F.get("f", F.lit(4)), ",")).alias("alleles"),
        F.split(F.get("f", F.lit(8)), ":").alias("_keys"), F.get("f", F.lit(len(FIXED))).alias("_rest"))
    if intervals is not None:
        site = within_any_interval(site, intervals)

    names = headers(spark, path)
    kept = names.select("file", F.transform(
        "samples", lambda name, i: F.struct(i.alias("at"), name.alias("sample"))).alias("kept"))
    if samples is not None:
        kept = kept.select("file", F.inline("kept")).join(
            samples.select("sample").distinct(), "sample", "left_semi").groupBy("file").agg(
            F.array_sort(F.collect_list(F.struct("at", "sample"))).alias("kept"))
    size = names.agg(F.sum(F.aggregate("samples", F.lit(0).cast("long"), lambda n, x: n + F.length(x) + 24))).first()[0]
    if (size or 0) <= HEADER_BYTES:
        kept = F.broadcast(kept)
    called = site.join(kept, "file").withColumn("_all", F.split("_rest", "\t")).select(
        "contig", "pos", "alleles", "_keys", F.inline(F.transform("kept", lambda k: F.struct(
            k["sample"].alias("sample"), F.get("_all", k["at"]).alias("_text")))),
    ).withColumn("_call", F.split("_text", ":"))
    gt_text = F.split(_field(F.col("_call"), F.col("_keys"), "GT"), r"[/|]")
    gt = F.transform(gt_text, lambda a: a.try_cast("int"))

    def numbers(name: str) -> Column:
        found = F.transform(
            F.split(_field(F.col("_call"), F.col("_keys"), name), ","), lambda a: a.try_cast("int"))
        return F.when(~F.exists(found, lambda a: a.isNull()), found)

    def number(name: str) -> Column:
        return _field(F.col("_call"), F.col("_keys"), name).try_cast("int")

    return called.select(
        "contig", "pos", "alleles", "sample",
        F.when(~F.exists(gt, lambda a: a.isNull()), gt).alias("gt"),
        numbers("AD").alias("ad"), number("DP").alias("dp"), number("GQ").alias("gq"), numbers("PL").alias("pl"))


def info_text(fields: Mapping[str, Column]) -> Column:
    """``k=v;k=v`` over the present fields; ``.`` when none is."""
    parts = [
        F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), value.cast("string")))
        for key, value in fields.items()
    ]
    text = F.concat_ws(";", *parts)
    return F.when(text == "", ".").otherwise(text)


def _or_dot(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("."))


def call_text(likelihoods: bool = False) -> Column:
    """``GT:AD:DP:GQ`` (and ``:PL``) of one genotype row."""
    def listed(name: str, separator: str, missing: str) -> Column:
        return F.coalesce(F.array_join(F.transform(name, lambda a: a.cast("string")), separator), F.lit(missing))

    parts = [listed("gt", "/", "./."), listed("ad", ",", "."), _or_dot(F.col("dp")), _or_dot(F.col("gq").cast("int"))]
    return F.concat_ws(":", *parts, *([listed("pl", ",", ".")] if likelihoods else []))


def contig_rank(contig: str | Column = "contig") -> Column:
    """Order of contigs: numbered ones by number, then X, Y, M, then others (by name)."""
    contig = F.col(contig) if isinstance(contig, str) else contig
    bare = F.regexp_replace(contig, "^chr", "")
    return F.coalesce(bare.try_cast("int"), F.when(bare == "X", 1000).when(bare == "Y", 1001).when(
        bare.isin("M", "MT"), 1002), F.lit(1003))


def _without_gaps(calls: Column, n_samples: Column, missing_call: str) -> Column:
    """Call texts in sample order, with a missing call where a sample has no row."""
    def missing(count: Column) -> Column:
        return F.array_repeat(F.lit(missing_call), count.cast("int"))

    filled = F.flatten(F.transform(calls, lambda c, i: F.concat(
        missing(c["_idx"] - F.coalesce(F.get(calls, i - 1)["_idx"], F.lit(-1)) - 1), F.array(c["call"]))))
    return F.concat(filled, missing(n_samples - 1 - F.get(calls, F.size(calls) - 1)["_idx"]))


def write_vcf(
    genotypes: DataFrame, variants: DataFrame, path: str, info: Mapping[str, Column],
    descriptions: Mapping[str, tuple[str, str, str]] | None = None, overwrite: bool = False,
    likelihoods: bool = False,
) -> None:
    """Write biallelic genotypes with an INFO column as text part files.

    ``info`` gives INFO fields as expressions over ``variants`` (one row per
    contig, pos, alleles); ``descriptions`` their (Number, Type, Description).
    Variants without calls and calls without a variant are left out. One line
    has all samples of a variant, which is the format's own unit. Lines are in
    order of contig (:func:`contig_rank`), position and alleles over all files:
    ``path/header`` has the header file and ``path/data`` the numbered data
    files, to be concatenated in that order. Calls are moved once, into ranges
    of that order.
    """
    ids = ["contig", "pos", "alleles"]
    keys = "GT:AD:DP:GQ" + (":PL" if likelihoods else "")
    # The sorted sample list is the header line itself: one row by definition.
    header_names = genotypes.select("sample").distinct().agg(
        F.array_sort(F.collect_list("sample")).alias("_names"))
    index = header_names.select(F.posexplode("_names").alias("_idx", "sample"))
    n_samples = header_names.select(F.size("_names")).scalar()
    calls = genotypes.join(index, "sample").select(*ids, "_idx", call_text(likelihoods).alias("call"))
    # A variant's own row comes first among its calls.
    rows = calls.unionByName(variants.select(*ids, F.lit(-1).alias("_idx"), info_text(info).alias("call")))
    order = ["_rank", *ids]
    grouped = rows.withColumn("_rank", contig_rank()).repartitionByRange(*order).groupBy(*order).agg(
        F.array_sort(F.collect_list(F.struct("_idx", "call"))).alias("_all"))
    lines = grouped.where((F.get("_all", F.lit(0))["_idx"] == -1) & (F.size("_all") > 1)).sortWithinPartitions(
        *order).select(F.concat_ws(
            "\t", "contig", F.col("pos").cast("string"), F.lit("."), F.get("alleles", F.lit(0)),
            F.array_join(F.slice("alleles", 2, F.greatest(F.size("alleles") - 1, F.lit(1))), ","),
            F.lit("."), F.lit("."), F.get("_all", F.lit(0))["call"], F.lit(keys),
            F.array_join(_without_gaps(F.slice("_all", 2, F.size("_all") - 1), n_samples,
                                       "./." + ":." * keys.count(":")), "\t"),
        ).alias("value"))
    meta = ["##fileformat=VCFv4.2"]
    for key in info:
        number, kind, text = (descriptions or {}).get(key, ("1", "String", key))
        meta.append(f'##INFO=<ID={key},Number={number},Type={kind},Description="{text}">')
    for key, kind, number, text in (
        ("GT", "String", "1", "Genotype"), ("AD", "Integer", "R", "Allele depth"),
        ("DP", "Integer", "1", "Depth"), ("GQ", "Integer", "1", "Genotype quality"),
        *([("PL", "Integer", "G", "Scaled genotype likelihoods")] if likelihoods else []),
    ):
        meta.append(f'##FORMAT=<ID={key},Number={number},Type={kind},Description="{text}">')
    header = header_names.select(F.concat(
        F.lit("\n".join(meta) + "\n#" + "\t".join(FIXED) + "\t"), F.array_join("_names", "\t")
    ).alias("value"))
    mode = "overwrite" if overwrite else "errorifexists"
    header.coalesce(1).write.mode(mode).text(f"{path}/header")
    lines.write.mode(mode).text(f"{path}/data")
