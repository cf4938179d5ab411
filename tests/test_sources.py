"""Readers, writers and call text, on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from carrierlab.operators import genotypes as G
from carrierlab import settings as S
from carrierlab.plans import genotype_study as study
from carrierlab.sources import readers as R
from carrierlab.sources import sinks as W
from carrierlab.sources import vcf
from tests.conftest import collect


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_carriage_return_lines_and_quotes(spark, tmp_path):
    text = 'Gene_name\tTrait\tLoF in gene?\tpLI\tLoF\tHas\rLDLR\tHigh LDL\t"yes, mostly"\t0.5\t1\tTRUE\rAPOB\tLow LDL\tNA\tNA\t0\tFALSE\r'
    got = collect(R.read_gene_traits(spark, put(tmp_path / "g.txt", text)), "gene")
    assert got == [("APOB", "Low LDL", 0, None, False), ("LDLR", "High LDL", 1, 0.5, True)]


def test_curated_columns_by_name(spark, tmp_path):
    text = 'Variant\tExtra\tLevel\tNotes\rv1\tx\tLOF\t"a\tb"\rv2\ty\tNA\tNA\r'
    got = collect(R.read_curated(spark, put(tmp_path / "c.txt", text)), "variant")
    assert got == [("v1", "v1", "LOF", "a\tb"), ("v2", "v2", None, None)]


def test_gene_phenotypes(spark, tmp_path):
    text = "Gene_name\tDisease\tphenotype\tStratify\tTransform\rLPL\tHigh TG\ttg_mgdl\tNA\tln\r"
    got = collect(R.read_gene_phenotypes(spark, put(tmp_path / "m.txt", text)))
    assert got == [("LPL", "High TG", "tg_mgdl", None, "ln")]


def test_byte_order_mark(spark, tmp_path):
    path = put(tmp_path / "b.csv", "﻿VariationID,AF\n7,\"[0.9,0.1]\"\n")
    assert collect(R.read_named_columns(spark, path, {"VariationID": "int", "AF": "string"}, sep=",")) == [(7, "[0.9,0.1]")]


def test_submissions_skip_explanations(spark, tmp_path):
    row = ["5", "Pathogenic", "Jan 02, 2018", "-", "-", 'C1:"x', "-", "clinical testing", "-", "Lab, A", "S1", "LDLR", "-"]
    path = put(tmp_path / "s.txt", "##explanation\n# more\nVariationID header\n" + "\t".join(row) + "\n")
    got = R.read_submissions(spark, path).collect()
    assert len(got) == 1 and got[0]["variation_id"] == 5
    assert got[0]["submitter"] == "Lab, A" and got[0]["phenotype"] == 'C1:"x'


def test_sites_and_compressed_input(spark, tmp_path):
    path = str(tmp_path / "sites.vcf.gz")
    with gzip.open(path, "wt") as f:
        f.write("##x\n#CHROM\tPOS\n1\t100\t9\tA\tG\t.\t.\tALLELEID=77;B=1\n")
    from carrierlab.operators.submissions import site_positions

    assert collect(site_positions(R.read_sites(spark, path))) == [("chr1", 100, 9, "A", "G", "77")]


def test_json_intervals(spark, tmp_path):
    path = put(tmp_path / "i.json", json.dumps({"LDLR": {"interval": "19:150-300"}, "XYZ": {"interval": "1:1-2"}}, indent=1))
    got = G.gene_intervals(R.read_gene_intervals(spark, path), ["LDLR"], buffer=100).collect()
    assert [tuple(r) for r in got] == [("LDLR", "19", 50, 400)]


def test_scores_and_id_lists(spark, tmp_path):
    path = put(tmp_path / "p.profile", "  FID   IID  CNT SCORE\n  1  a   5  0.25\n  2  b   5  -1e-3\n")
    assert collect(R.read_scores(spark, path), "subject") == [("a", 0.25), ("b", -0.001)]
    put(tmp_path / "x.mds.exclude", "s1\ns2\n")
    put(tmp_path / "y.mds.exclude", "s3\n")
    put(tmp_path / "other.txt", "s4\n")
    ids = R.read_id_list(spark, str(tmp_path), "combined_id", glob="*.mds.exclude")
    assert collect(ids, "combined_id") == [("s1",), ("s2",), ("s3",)]


def test_associations_are_tagged(spark, tmp_path):
    head = "Condition\tTrait\tGene\ttype\tsubset\tadditional_covariates\tPVALUE\tBETA\tSEBETA\n"
    a = put(tmp_path / "a.txt", head + "High_LDL\tldl_mgdl\tNA\tpathogenic\tAll\tNA\t0.01\t1.5\t0.5\n")
    b = put(tmp_path / "b.txt", head + "High_LDL\tldl_mgdl\tNA\tpathogenic\tAll\tcovart2d\t0.02\t1\t0.5\n")
    got = R.read_associations(spark, {"A": a, "B": b}).orderBy("data_source").collect()
    assert [(r["data_source"], r["additional_covariates"], r["BETA"]) for r in got] == [("A", None, 1.5), ("B", "covart2d", 1.0)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a b", None, ["x", "y"]), ("c", 2, None)], "k string, n int, l array<string>")
    W.write_tsv(df.coalesce(1).orderBy("k"), str(tmp_path / "t"))
    lines = [x.value for x in spark.read.text(str(tmp_path / "t")).collect()]
    assert lines == ["k\tn\tl", 'a b\tNA\t["x","y"]', "c\t2\tNA"]
    path = W.write_csv_run(df.select("k", "n").coalesce(1), str(tmp_path / "run_"))
    assert collect(R.read_named_columns(spark, path, {"k": "string", "n": "int"}, sep=","), "k") == [("a b", None), ("c", 2)]
    raw = next((tmp_path / path.split("/")[-1]).glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfk,n")
    back = W.persist_table(df, str(tmp_path / "pq"), partition_by=["k"])
    assert back.count() == 2


VCF = (
    "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\n"
    "chr1\t100\t.\tA\tC\t.\t.\t.\tGT:AD:DP:GQ\t0/1:15,15:30:99\t0/0:30,0:30:60\t1|1:0,20:20:50\n"
    "chr1\t200\t.\tAT\tA,GT,*\t.\t.\t.\tGT:AD:DP:GQ\t1/2:0,10,12,0:22:99\t./.:.:.:.\t0/2:14,0,13,1:28:40\n"
    "chr2\t300\t.\tG\tT\t.\t.\t.\tGT:DP\t0/1:9\t0/0:30\t0/0\n"
)


@pytest.fixture
def genotypes(spark, tmp_path):
    return vcf.read_genotypes(spark, put(tmp_path / "in.vcf", VCF))


def test_call_text_ingest(genotypes):
    rows = {(r["pos"], r["sample"]): r for r in genotypes.collect()}
    assert len(rows) == 9
    assert rows[100, "s3"]["gt"] == [1, 1] and rows[100, "s1"]["ad"] == [15, 15]
    assert rows[200, "s2"]["gt"] is None and rows[200, "s2"]["ad"] is None and rows[200, "s2"]["dp"] is None
    assert rows[200, "s1"]["alleles"] == ["AT", "A", "GT", "*"]
    assert rows[300, "s1"]["dp"] == 9 and rows[300, "s1"]["gq"] is None and rows[300, "s3"]["dp"] is None


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "in put").mkdir()
    a = put(tmp_path / "in put" / "a+%.vcf", VCF)
    b = put(tmp_path / "b.vcf", VCF.replace("s1\ts2\ts3", "s9\ts1\ts3").replace("chr", "1"))
    calls = vcf.read_genotypes(spark, [str(tmp_path / "in put"), b])
    # One scan of the lines.
    assert calls._jdf.queryExecution().sparkPlan().toString().count("FileScan text") == 1
    rows = {(r["contig"], r["pos"], r["sample"]): r["gt"] for r in calls.collect()}
    assert len(rows) == 18
    assert rows["chr1", 100, "s1"] == rows["11", 100, "s9"] == [0, 1] and rows["11", 100, "s1"] == [0, 0]
    some = vcf.read_genotypes(spark, [a, b], samples=spark.createDataFrame([("s1",), ("s9",), ("none",)], "sample string"),
                              intervals=spark.createDataFrame([("chr1", 150, 900), ("12", 1, 301)], "contig string, start long, end long"))
    assert collect(some.select("contig", "pos", "sample"), "contig", "pos", "sample") == [
        ("12", 300, "s1"), ("12", 300, "s9"), ("chr1", 200, "s1")]


def test_file_without_header(spark, tmp_path):
    a = put(tmp_path / "a.vcf", VCF)
    body = put(tmp_path / "c.vcf", "\n".join(VCF.split("\n")[2:]).replace("chr1", "chr4").replace("chr2", "chr5"))
    assert vcf.read_genotypes(spark, [a, body]).count() == 18
    b = put(tmp_path / "b.vcf", VCF.replace("s1\ts2\ts3", "s2\ts1\ts3"))
    with pytest.raises(Exception, match="different sample headers"):
        vcf.read_genotypes(spark, [a, b, body]).collect()


def test_split_codes_against_each_allele(genotypes):
    rows = {(r["pos"], tuple(r["alleles"]), r["sample"]): r for r in G.split_multiallelic(genotypes).collect()}
    first, second = rows[200, ("AT", "A"), "s1"], rows[200, ("A", "G"), "s1"]
    assert first["gt"] == [0, 1] and first["ad"] == [12, 10] and first["a_index"] == 1 and first["was_split"]
    assert second["gt"] == [0, 1] and second["ad"] == [10, 12] and second["a_index"] == 2
    assert rows[200, ("A", "G"), "s3"]["gt"] == [0, 1] and rows[200, ("AT", "A"), "s3"]["gt"] == [0, 0]
    assert rows[200, ("AT", "A"), "s2"]["gt"] is None
    assert not any("*" in key[1] for key in rows)
    assert not rows[100, ("A", "C"), "s1"]["was_split"]


@pytest.mark.parametrize("pos,ref,alt,want", [
    (10, "A", "C", (10, "A", "C")), (10, "AT", "GT", (10, "A", "G")), (10, "CAT", "CGT", (11, "A", "G")),
    (10, "GCC", "GC", (10, "GC", "G")), (10, "AAA", "AAAT", (12, "A", "AT")), (10, "ACGT", "TCGT", (10, "A", "T")),
])
def test_minimal_alleles(spark, pos, ref, alt, want):
    df = spark.createDataFrame([(pos, ref, alt)], "pos int, ref string, alt string")
    assert tuple(G.with_minimal_alleles(df, "pos", "ref", "alt").first()) == want


def test_interval_and_lift(spark):
    loci = spark.createDataFrame([("1", 99), ("1", 100), ("1", 199), ("1", 200), ("2", 150)], "contig string, pos long")
    spans = spark.createDataFrame([("1", 100, 200), ("1", 150, 5_000_000)], "contig string, start long, end long")
    assert collect(G.filter_to_intervals(loci, spans), "pos") == [("1", 100), ("1", 199), ("1", 200)]
    blocks = spark.createDataFrame(
        [("1", 100, 200, "7", 1000, "+"), ("2", 100, 200, "8", 500, "-")],
        "src_contig string, src_start long, src_end long, dst_contig string, dst_start long, strand string")
    got = collect(G.lift_variants(loci.withColumn("alleles", F.array(F.lit("A"), F.lit("T"))), blocks).select(
        "contig", "pos", "lifted_key", "is_negative_strand"), "contig", "pos")
    assert got == [("1", 99, None, None), ("1", 100, "7:1000:A:T", False), ("1", 199, "7:1099:A:T", False),
                   ("1", 200, None, None), ("2", 150, "8:549:A:T", True)]


def test_genotype_study_end_to_end(spark, tmp_path, genotypes):
    flags = spark.createDataFrame([("s1", False), ("s2", False), ("s3", True)], "s string, is_forbidden boolean")
    spans = [("LDLR", "chr1:50-250"), *((g, "chr9:1-5") for g in S.GENE_SET if g != "LDLR")]
    spans = spark.createDataFrame(spans, "gene string, interval string")
    effects = spark.createDataFrame([
        ("chr1", 100, ["A", "C"], [("LDLR", "t1", ["stop_gained"], "HC", [])]),
        ("chr1", 200, ["AT", "A"], [("LDLR", "t1", ["frameshift_variant"], "LC", []), ("ZZZ", "t9", ["x"], "HC", [])]),
    ], "contig string, pos int, alleles array<string>, consequences array<struct<gene_symbol:string,transcript_id:string,"
       "consequence_terms:array<string>,lof:string,lof_flags:array<string>>>")
    expression = spark.createDataFrame(
        [("LDLR", "t1", "Liver", 4.0), ("LDLR", "t1", "Lung", 1.0), ("LDLR", "t2", "Liver", 4.0), ("LDLR", "t1", "Testis", 9.0)],
        "gene string, transcript string, tissue string, value double")
    maximum = spark.createDataFrame([("LDLR", "Liver", 8.0), ("LDLR", "Lung", 0.0), ("LDLR", "Testis", 9.0)],
                                    "gene string, tissue string, max_value double")
    blocks = spark.createDataFrame([("chr1", 1, 1000, "1", 501, "+")],
                                   "src_contig string, src_start long, src_end long, dst_contig string, dst_start long, strand string")
    inputs = study.GenotypeInputs(genotypes, flags, spans, effects, expression, maximum, blocks)
    out = study.run(inputs, severity=["stop_gained", "frameshift_variant"], dropped_tissues=["Testis"], folder=str(tmp_path / "work"))
    assert {r["sample"] for r in out.genotypes.collect()} == {"s1", "s2"}
    assert collect(out.variants.select("pos", "alleles", "ac", "an", "n_not_called"), "pos", "alleles") == [
        (100, ["A", "C"], 1, 4, 0), (200, ["A", "G"], 1, 2, 1), (200, ["AT", "A"], 1, 2, 1)]
    lof = out.lof.collect()
    assert len(lof) == 1 and lof[0]["lifted_key"] == "1:600:A:C"
    assert lof[0]["worst_csq_mean_proportion"] == pytest.approx(0.5)
    assert lof[0]["worst_csq_pext"] == "Liver:5.00000e-01,Lung:NA"
    study.export_filtered(out.filtered, str(tmp_path / "filtered"))
    table = R.read_filtered_variants(spark, str(tmp_path / "filtered")).orderBy("variant").collect()
    assert [(r["variant"], r["AC"], r["n_het"]) for r in table] == [("chr1:100:A:C", "[3,1]", 1), ("chr1:200:AT:A", "[1,1]", 1)]
    study.export_lof_vcf(out, str(tmp_path / "lof"))
    text = [r.value for r in spark.read.text([str(tmp_path / "lof/header"), str(tmp_path / "lof/data")]).collect()]
    line = next(x for x in text if x.startswith("chr1"))
    assert line.split("\t")[:5] == ["chr1", "100", ".", "A", "C"] and line.endswith("0/1:15,15:30:99\t0/0:30,0:30:60")
    assert "AC=1;AN=4;AF=0.25" in line and "liftover_37=1:600:A:C" in line
    assert any(x.startswith("#CHROM") and x.endswith("s1\ts2") for x in text)


def test_skipped_steps(spark, genotypes):
    out = study.run(study.GenotypeInputs(genotypes.drop("gq")), skip=["genotype_filter"])
    assert "lift" in out.skipped and out.lof is None and out.variants.count() == 4
    with pytest.raises(ValueError):
        study.run(study.GenotypeInputs(genotypes.drop("gq")))
    with pytest.raises(ValueError):
        study.run(study.GenotypeInputs(genotypes), skip=["nothing"])


def test_split_takes_quality_from_likelihoods(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\ts4\n"
    lines = ("1\t10\t.\tA\tC,G\t.\t.\t.\tGT:AD:DP:GQ:PL\t1/2:0,15,15:30:99:90,80,70,60,0,12\t"
             "0/1:15,15,0:30:5:50,0,200,180,150,300\t0/2:15,0,15:30:40:.\t0/1:15,15,0:30:.:9,0,20\n"
             "1\t20\t.\tA\tC\t.\t.\t.\tGT:AD:DP:GQ:PL\t0/1:15,15:30:99:10,0,300\t0/0:30,0:30:10:0,200,300\t"
             "0/0:30,0:30:33:0,.,9\t0/0:30,0:30:44\n")
    calls = vcf.read_genotypes(spark, put(tmp_path / "pl.vcf", head + lines))
    rows = {(r["pos"], r["alleles"][1], r["sample"]): r for r in G.split_multiallelic(calls).collect()}
    pl = (90, 80, 70, 60, 0, 12)  # of 0/0, 0/1, 1/1, 0/2, 1/2, 2/2
    for allele in (1, 2):
        least = [min(pl[k * (k + 1) // 2 + j] for k in range(3) for j in range(k + 1) if (j == allele) + (k == allele) == c)
                 for c in range(3)]
        got = rows[10, "-CG"[allele], "s1"]
        assert got["pl"] == least and got["gq"] == sorted(least)[1] - min(least)
    assert rows[10, "C", "s1"]["gq"] == 12 and rows[10, "G", "s1"]["gq"] == 12
    assert rows[10, "C", "s2"]["pl"] == [50, 0, 200] and rows[10, "C", "s2"]["gq"] == 50
    assert rows[10, "G", "s2"]["pl"] == [0, 150, 300] and rows[10, "G", "s2"]["gq"] == 99
    assert rows[10, "C", "s3"]["gq"] == 40 and rows[10, "C", "s3"]["pl"] is None
    assert rows[10, "C", "s4"]["gq"] is None and rows[10, "C", "s4"]["pl"] is None
    assert [rows[20, "C", f"s{i}"]["gq"] for i in (1, 2, 3, 4)] == [10, 99, 33, 44]
    masked = {(r["pos"], r["alleles"][1], r["sample"]): r["gt"] for r in G.mask_genotypes(G.split_multiallelic(calls)).collect()}
    assert masked[10, "C", "s1"] is None and masked[10, "C", "s2"] == [0, 1] and masked[20, "C", "s1"] is None


def test_gene_without_interval_is_refused(spark, genotypes):
    spans = spark.createDataFrame([("LDLR", "chr1:50-250"), ("GCK", None)], "gene string, interval string")
    with pytest.raises(ValueError, match="GCK.*PCSK9"):
        G.gene_intervals(spans, ["LDLR", "PCSK9", "GCK"])
    inputs = study.GenotypeInputs(genotypes, intervals=spans)
    with pytest.raises(ValueError, match="PCSK9"):
        study.run(inputs, genes=["LDLR", "PCSK9"])
    assert study.run(inputs, genes=["LDLR"]).variants.count() == 3
    with pytest.raises(ValueError, match="PCSK9"):
        study.run(inputs)


def test_export_fills_missing_calls(spark, tmp_path):
    calls = spark.createDataFrame(
        [("1", 5, ["A", "C"], "b", [0, 1], [1, 2], 3, 40), ("1", 5, ["A", "C"], "d", [1, 1], None, None, None),
         ("1", 9, ["G", "T"], "a", None, None, None, None), ("1", 9, ["G", "T"], "c", [0, 0], [9, 0], 9, 50)],
        "contig string, pos int, alleles array<string>, sample string, gt array<int>, ad array<int>, dp int, gq int")
    variants = calls.select("contig", "pos", "alleles").distinct()
    vcf.write_vcf(calls, variants, str(tmp_path / "v"), {"X": F.lit(None).cast("string")})
    data = sorted(r.value for r in spark.read.text(str(tmp_path / "v/data")).collect())
    assert data[0].split("\t")[7:] == [".", "GT:AD:DP:GQ", "./.:.:.:.", "0/1:1,2:3:40", "./.:.:.:.", "1/1:.:.:."]
    assert data[1].split("\t")[9:] == ["./.:.:.:.", "./.:.:.:.", "0/0:9,0:9:50", "./.:.:.:."]
    back = vcf.read_genotypes(spark, [str(tmp_path / "v/header"), str(tmp_path / "v/data")])
    assert back.count() == 8 and back.where("gt is not null").count() == 3


def test_command_line(spark, tmp_path):
    from carrierlab.__main__ import main

    calls = put(tmp_path / "in.vcf", VCF)
    flags = put(tmp_path / "s.txt", "s\tproject\tsample\tis_forbidden\ns1\tp\ta\tfalse\ns2\tp\tb\tfalse\ns3\tp\tc\ttrue\n")
    main(["genotypes", "--calls", calls, "--samples", flags, "--output", str(tmp_path / "out"), "--overwrite"])
    rows = spark.read.parquet(str(tmp_path / "out/variants"))
    assert collect(rows.where("pos = 100").select("ac", "an")) == [(1, 4)]
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "out/work/genotypes")).select("sample").distinct().collect()} == {"s1", "s2"}
