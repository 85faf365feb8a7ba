"""Formats written by hand, read, and written again."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from locusframe import engine
from locusframe.functions import values as V
from locusframe.model import role, to_intervals
from locusframe.operators import genes as G
from locusframe.operators import rows as W
from locusframe.sources import annotation as A
from locusframe.sources import binary, files, signal, sinks


def put(tmp_path, name, *rows):
    path = tmp_path / name
    path.write_text("".join(r + "\n" for r in rows))
    return str(path)


def test_bed(spark, tmp_path):
    path = put(tmp_path, "a.bed", "track name=x", "chr1\t0\t10\tn1\t5\t+", "chr1\t0\t10\tn2\t.\t-", "chr2\t7\t9\t.\t1\t.")
    rows = A.bed(spark, path).orderBy("_row").collect()
    assert [(r["seq_id"], r["start"], r["end"], r["strand"], r["name"], r["score"], r["id"]) for r in rows] == [("chr1", 1, 10, 1, "n1", 5.0, "chr1:0-10"), ("chr1", 1, 10, -1, "n2", None, "chr1:0-10.1"), ("chr2", 8, 9, 0, None, 1.0, "chr2:7-9")]


def test_narrow_peak(spark, tmp_path):
    path = put(tmp_path, "a.narrowPeak", "chr1\t100\t201\tp\t5\t.\t1.5\t2\t3\t40")
    r = A.bed(spark, path).first()
    assert (r["type"], r["peak"], r["qValue"]) == ("peak", 141, "3")


def test_bed12_parts(spark, tmp_path):
    path = put(tmp_path, "a.bed12", "chr1\t100\t400\tt\t0\t-\t150\t350\t0\t2\t100,100,\t0,200,")
    found = sorted((r["type"], r["start"], r["end"]) for r in A.bed_blocks(A.bed(spark, path)).collect())
    assert found == [("CDS", 151, 200), ("CDS", 301, 350), ("exon", 101, 200), ("exon", 301, 400), ("five_prime_UTR", 351, 400), ("three_prime_UTR", 101, 150)]


def test_gff3(spark, tmp_path):
    path = put(
        tmp_path, "a.gff3", "##gff-version 3", "##sequence-region c1 1 900",
        "c1\ts\tgene\t10\t90\t.\t+\t.\tID=g1;Name=a%20b", "c1\ts\tmRNA\t10\t90\t.\t+\t.\tID=t1;Parent=g1", "c1\ts\tmRNA\t10\t80\t.\t+\t.\tID=t2;Parent=g1",
        "c1\ts\texon\t10\t40\t.\t+\t.\tParent=t1,t2", "c1\ts\tCDS\t20\t40\t.\t+\t0\tParent=t9", "c1\ts\tdata\t20\t20\t.5\t.\t.\tName=x", "##FASTA", ">c1", "ACGT",
    )
    f = A.gff(spark, path)
    assert f.count() == 6 and f.filter("id = 'g1'").first()["name"] == "a b"
    assert A.links(f).count() == 5
    assert [r["parent_id"] for r in A.orphans(f).collect()] == ["t9"]
    assert [tuple(r) for r in A.gff_lengths(spark, path).collect()] == [("c1", 900)]
    assert A.gff(spark, path, "exon|cds").count() == 2
    assert engine.find(f, name="a b").first()["id"] == "g1"
    assert [r["type"] for r in engine.datasets(f).collect()] == ["data"]
    line = f.filter("id = 'g1'").select(sinks.gff3_line().alias("l")).first()["l"]
    assert line == "c1\ts\tgene\t10\t90\t.\t+\t.\tID=g1;Name=a%20b"


def test_gtf_makes_what_is_missing(spark, tmp_path):
    tags = 'gene_id "g"; transcript_id "t"; gene_name "n";'
    path = put(tmp_path, "a.gtf", f"c1\ts\texon\t10\t40\t.\t-\t.\t{tags}", f"c1\ts\texon\t60\t90\t.\t-\t.\t{tags}", f"c1\ts\tCDS\t20\t40\t.\t-\t0\t{tags}")
    genes, tx, parts = A.gene_tables(A.gff(spark, path))
    assert [(r["gene_id"], r["start"], r["end"], r["name"]) for r in genes.collect()] == [("g", 10, 90, "n")]
    assert [(r["transcript_id"], r["start"], r["end"]) for r in tx.collect()] == [("t", 10, 90)]
    assert parts.count() == 3
    ex = G.exons(parts)
    assert [(r["start"], r["end"]) for r in G.introns(ex).collect()] == [(41, 59)]
    assert sorted((r["start"], r["end"], r["type"]) for r in G.utrs(ex, parts).collect()) == [(10, 19, "three_prime_utr"), (60, 90, "five_prime_utr")]


def test_gene_tables(spark, tmp_path):
    row = "{}\tchr1\t+\t{}\t{}\t{}\t{}\t2\t{},\t{},"
    path = put(tmp_path, "a.txt", "g\t" + row.format("t1", 0, 100, 20, 90, "0,50", "30,100"), "g\t" + row.format("t2", 60, 200, 200, 200, "60,150", "90,200"), "g\t" + row.format("t3", 500, 600, 600, 600, "500,550", "520,600"))
    assert files.taste(files.head(spark, path), path) == ("ucsc", "refFlat")
    t = A.ucsc_genes(A.ucsc(spark, path))
    assert {r["transcript_id"]: r["gene_id"] for r in t.collect()} == {"t1": "g", "t2": "g", "t3": "g.1"}
    assert {r["transcript_id"]: r["type"] for r in t.collect()} == {"t1": "mRNA", "t2": "ncRNA", "t3": "ncRNA"}
    assert A.ucsc_parts(t).filter("type = 'CDS'").count() == 2
    side = spark.createDataFrame([(0, "t1", "a"), (1, "t1", "b")], "_row long, key string, value string")
    assert A.with_side_table(t, side, "status").filter("transcript_id = 't1'").first()["status"] == "a"


def test_vcf(spark, tmp_path):
    path = put(tmp_path, "a.vcf", "##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1", "c1\t5\trs1\tA\tACC\t30\tPASS\tDP=4;DB\tGT:DP\t0/1:7")
    r = A.vcf(spark, path).first()
    assert (r["start"], r["end"], r["info"], r["sample_S1"]) == (5, 7, {"DP": "4", "DB": "1"}, {"GT": "0/1", "DP": "7"})


def test_plain_tables(spark, tmp_path):
    path = put(tmp_path, "a.txt", "# Program x", "# Column_2 name=Score;method=mean", "Name\tScore", "a\t1", "b\t.", "c")
    t = files.load(spark, path)
    assert t.df.columns == ["_row", "Name", "Score"] and t.meta.program == "x" and t.meta.columns["Score"]["method"] == "mean"
    assert [(r["Name"], r["Score"]) for r in t.df.orderBy("_row").collect()] == [("a", "1"), ("b", None), ("c", None)]
    assert t.feature_type == "unknown" and files.existing(spark, path[:-4]) == path
    with pytest.raises(FileNotFoundError):
        files.existing(spark, path + "x")
    wide = put(tmp_path, "b.txt", "a\tb", "1\t2", "1\t2\t3")
    with pytest.raises(Exception, match="too many columns"):
        files.load(spark, wide).df.collect()
    engine.write(t, str(tmp_path / "out"))
    again = files.load(spark, str(tmp_path / "out"))
    assert sorted((r["Name"], r["Score"]) for r in again.df.fillna(".").collect()) == [("a", "1"), ("b", "."), ("c", ".")]


def test_wig(spark, tmp_path):
    path = put(tmp_path, "a.wig", "track type=wiggle_0", "fixedStep chrom=c1 start=11 step=5 span=2", "1", "2", "variableStep chrom=c2 span=3", "7 4.5", "fixedStep chrom=c1 start=100 step=1", "9", "c3\t4\t6\t8")
    found = [(r["seq_id"], r["start"], r["end"], r["score"]) for r in signal.wig(spark, path).collect()]
    assert sorted(found) == sorted([("c1", 11, 12, 1.0), ("c1", 16, 17, 2.0), ("c2", 7, 9, 4.5), ("c1", 100, 100, 9.0), ("c3", 5, 6, 8.0)])


def test_wig_over_several_parts(spark, tmp_path):
    path = put(tmp_path, "b.wig", "fixedStep chrom=c1 start=1 step=1", *[str(k) for k in range(1, 400)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = signal.wig(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["start"], r["score"]) for r in rows) == [(k, float(k)) for k in range(1, 400)]


@pytest.mark.parametrize("kind", ["fixed", "variable"])
def test_wig_of_several_files_in_pieces(spark, tmp_path, kind):
    head, line = {"fixed": ("fixedStep chrom={} start=1 step=1", "{}"), "variable": ("variableStep chrom={}", "{0} {0}")}[kind]
    for c in ("c1", "c2", "c3"):
        put(tmp_path, f"{c}.wig", head.format(c), *[line.format(k) for k in range(1, 400)])
    # a file without a declaration goes on from the one before
    put(tmp_path, "c4.wig", *[line.format(k) for k in range(400, 500)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = signal.wig(spark, f"{tmp_path}/*.wig").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    last = {"c1": 400, "c2": 400, "c3": 500}
    assert sorted((r["seq_id"], r["start"], r["score"]) for r in rows) == sorted((c, k, float(k)) for c, n in last.items() for k in range(1, n))


def test_sam_and_fasta(spark, tmp_path):
    path = put(tmp_path, "a.sam", "@HD\tVN:1", "@SQ\tSN:c1\tLN:500", "q\t16\tc1\t10\t30\t5M2N3M\t=\t0\t0\t*\t*\tNH:i:2")
    r = signal.sam(spark, path).first()
    assert (r["pos"], r["end"], r["mate_seq_id"], r["nh"]) == (9, 19, "c1", 2)
    assert [tuple(x) for x in signal.sam_lengths(spark, path).collect()] == [("c1", 500)]
    fa = put(tmp_path, "a.fa", ">s1 words", "ACGTACG", "TTT", ">s2", "GG")
    chunks = signal.fasta(spark, fa, 4)
    assert sorted(tuple(x) for x in chunks.collect()) == [("s1", 0, "ACGT"), ("s1", 1, "ACGT"), ("s1", 2, "TT"), ("s2", 0, "GG")]
    assert {x[0]: x[1] for x in signal.sequence_lengths(chunks).collect()} == {"s1": 10, "s2": 2}
    place = spark.createDataFrame([(1, "s1", 3, 9, -1), (2, "s1", 4, 4, 1)], "_row long, seq_id string, start long, end long, strand int")
    assert {x[0]: x[1] for x in G.sequence(place, chunks, 4).collect()} == {1: "AACGTAC", 2: "T"}


def bam_bytes():
    header = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 500)
    name, ops, tags = b"q1\0", struct.pack("<2I", 5 << 4 | 0, 3 << 4 | 3), b"ASc\x07NHC\x02"
    body = struct.pack("<iiBBHHHiiii", 0, 9, len(name), 30, 0, 2, 16, 0, -1, -1, 0) + name + ops + tags
    c = zlib.compressobj(wbits=31)
    return c.compress(header + struct.pack("<i", len(body)) + body) + c.flush()


def big_wig_bytes():
    block = struct.pack("<IIIIIBBH", 0, 0, 20, 0, 0, 1, 0, 2) + struct.pack("<IIfIIf", 0, 5, 1.5, 10, 20, 2.0)
    packed = zlib.compress(block)
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 1, 2, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + b"c1" + struct.pack("<II", 0, 500)
    at_tree, at_data = 64, 64 + len(tree)
    at_index = at_data + len(packed)
    index = b"\0" * 48 + struct.pack("<BBH", 1, 0, 1) + struct.pack("<IIIIQQ", 0, 0, 0, 20, at_data, len(packed))
    return struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, at_tree, at_data, at_index, 0, 0, 0, 0, 1000, 0) + tree + packed + index


def test_binary(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(bam_bytes())
    assert tuple(binary.bam(spark, str(tmp_path / "a.bam")).first()) == ("q1", 16, "c1", 9, 17, 30, "5M3N", None, 0, 2)
    (tmp_path / "a.bw").write_bytes(big_wig_bytes())
    found = [(r["seq_id"], r["start"], r["end"], r["score"]) for r in engine.open_signal(spark, str(tmp_path / "a.bw")).collect()]
    assert found == [("c1", 1, 5, 1.5), ("c1", 11, 20, 2.0)]
    assert [tuple(r) for r in binary.big_lengths(spark, str(tmp_path / "a.bw")).collect()] == [("c1", 500)]
    with pytest.raises(ValueError):
        engine.open_signal(spark, "a.cram")


def test_signal_sets(spark, tmp_path):
    put(tmp_path, "x_f.bdg", "c1\t0\t5\t1")
    put(tmp_path, "x_r.bdg", "c1\t0\t5\t2")
    both = signal.signal_set(spark, str(tmp_path), "[x_f.bdg]\ntype = t\nname = x\n[x_r.bdg]\ntype = t\nname = x\nstrand = -1\n")
    assert [r["score"] for r in signal.choose_signal(both, "t", "x", -1).collect()] == [2.0]
    assert engine.open_signal(spark, f"{tmp_path}/x_f.bdg&{tmp_path}/x_r.bdg").count() == 2
    names = engine.Registry()
    names.add("f", f"{tmp_path}/x_f.bdg")
    assert engine.Registry(names.text()).open(spark, "f").count() == 1


def test_names(spark):
    assert role(["Chromosome", "Start0", "End"], "start") == "Start0" and role(["x"], "start") is None
    assert V.parse_list("1,2,5-7") == [1, 2, 5, 6, 7]
    assert [V.column_letters(k) for k in (1, 26, 27)] == ["a", "z", "aa"] and V.column_index("aa") == 27
    assert V.simple_name("/a/b.sort.bw&c.bam") == "b&c"
    assert W.sane_order(["chrX", "chr10", "chr2", "chrM", "scaffold_2", "scaffold_10", "chr1"]) == ["chr1", "chr2", "chr10", "chrX", "chrM", "scaffold_2", "scaffold_10"]
    assert W.sane_order(["chrIX", "chrV", "chrX", "chrI", "chrMito"]) == ["chrI", "chrV", "chrIX", "chrX", "chrMito"]
    df = spark.createDataFrame([("c", "0", "5", "-")], "chrom string, Start0 string, End string, strand string")
    r = to_intervals(df).first()
    assert (r["seq_id"], r["start"], r["end"], r["strand"]) == ("c", 1, 5, -1)


def test_sinks(spark, tmp_path):
    bed = spark.createDataFrame([(0, "c", 11, 20, -1, None, 3.0)], "_row long, seq_id string, start long, end long, strand int, name string, score double")
    table = engine.FeatureTable(bed)
    assert engine.as_bed(table).first()["line"] == "c\t10\t20\tFeature_1\t3.0\t-"
    assert engine.as_gff(table, "s", "peak").first()["line"].startswith("c\ts\tpeak\t11\t20\t3.0\t-\t.\t")
    lines = [r["line"] for r in engine.as_wig(table).orderBy("seq_id", "start", "part").collect()]
    assert lines == ["variableStep chrom=c span=1", "11 3.0"]
    sinks.write_lines(spark.createDataFrame([("b",), ("a",)], "line string"), str(tmp_path / "o"), ["line"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["a", "b"]
    chunks = spark.createDataFrame([("c", 0, "ACGT" * 10)], "seq_id string, chunk long, text string")
    named = engine.FeatureTable(bed.fillna("f"))
    assert engine.as_fasta(named, chunks, 1000).first()["line"] == ">f\nACGTACGTAC"
