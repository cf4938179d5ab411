"""Command line for the genotype steps."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from carrierlab import settings as S
from carrierlab.plans import genotype_study as study
from carrierlab.session import configure
from carrierlab.sources import readers, schemas
from carrierlab.sources.vcf import read_genotypes


def arguments(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="carrierlab")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("genotypes", help="from call text to annotated loss-of-function variants")
    run.add_argument("--calls", required=True, help="call text file(s)")
    run.add_argument("--output", required=True, help="folder for results and intermediates")
    run.add_argument("--samples", help="sample flags (s, project, sample, is_forbidden)")
    run.add_argument("--intervals", help="JSON of gene intervals")
    run.add_argument("--consequences", help="Parquet: contig, pos, alleles, consequences")
    run.add_argument("--expression", help="Parquet: gene, transcript, tissue, value")
    run.add_argument("--gene-maximum", help="Parquet: gene, tissue, max_value")
    run.add_argument("--blocks", help="tab-separated alignment blocks to the other build")
    run.add_argument("--severity", default="", help="consequence terms, most severe first, comma-separated")
    run.add_argument("--dropped-tissues", default="", help="tissues to leave out, comma-separated")
    run.add_argument("--partitions", type=int, help="spread unsplittable input")
    run.add_argument("-o", "--overwrite", action="store_true")
    for step in study.STEPS:
        run.add_argument(f"--skip_{step}", action="store_true")
    return parser.parse_args(argv)


def main(argv=None) -> None:
    args = arguments(argv)
    spark = configure(SparkSession.builder.appName("carrierlab").getOrCreate())

    def parquet(path):
        return spark.read.parquet(path) if path else None

    inputs = study.GenotypeInputs(
        genotypes=read_genotypes(spark, args.calls, args.partitions),
        sample_flags=readers.read_delimited(spark, args.samples, schemas.SAMPLE_FLAGS) if args.samples else None,
        intervals=readers.read_gene_intervals(spark, args.intervals) if args.intervals else None,
        consequences=parquet(args.consequences), expression=parquet(args.expression),
        gene_maximum=parquet(args.gene_maximum),
        blocks=readers.read_delimited(spark, args.blocks, schemas.ALIGNMENT_BLOCKS) if args.blocks else None,
    )
    result = study.run(
        inputs, [s for s in study.STEPS if getattr(args, f"skip_{s}")], S.GENE_SET, S.LOF_GENE_SET,
        [x for x in args.severity.split(",") if x], [x for x in args.dropped_tissues.split(",") if x],
        f"{args.output}/work", args.overwrite,
    )
    result.variants.write.mode("overwrite" if args.overwrite else "errorifexists").parquet(f"{args.output}/variants")
    if result.filtered is not None:
        study.export_filtered(result.filtered, f"{args.output}/filtered_variants", args.overwrite)
    if result.lof is not None:
        study.export_lof_vcf(result, f"{args.output}/lof_vcf", overwrite=args.overwrite)


if __name__ == "__main__":
    main()
