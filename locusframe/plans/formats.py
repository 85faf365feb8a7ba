"""Queries that write text of a format from the driver's tables and read it again, and lookups among what is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import engine
from ..functions import values as V
from ..operators import collect as C
from ..operators import columns as K
from ..operators import genes as G
from ..operators import pileup as P
from ..operators import rows as W
from ..sources import annotation as A
from ..sources import files, signal as SG, sinks as S
from .data import AL, EX, RG, alignments, gene_model, r6, r6_sql, read, regions, shared_folder, signal

Q: dict[str, tuple] = {}


def written(spark, lines: DataFrame, name: str, compression: str = "none") -> str:
    """The path of a folder of text files of the column line."""
    path = f"{shared_folder(spark)}/{name}"
    S.write_lines(lines, path, compression=compression)
    return path


def tabs(*parts):
    return F.concat_ws("\t", *[p.cast("string") if not isinstance(p, str) else p for p in parts]).alias("line")


def none():
    return F.lit(None).cast("string")

# ---- intervals -----------------------------------------------------------------------------------


def bed3(spark, d):
    path = written(spark, regions(spark, d).select(S.bed_line(3).alias("line")), "x.bed")
    return A.bed(spark, path).select("seq_id", "start", "end", "strand", "id")


Q["read_bed3"] = (bed3, f"with {RG} select seq as seq_id, s as start, e as \"end\", cast(0 as integer) as strand, seq || ':' || (s-1) || '-' || e as id from r")


def zipped(codec: str, end: str):
    def run(spark, d):
        path = written(spark, regions(spark, d).withColumn("score", F.col("_row") % 7).select(S.bed_line(6).alias("line")), f"x{end}", codec)
        return A.bed(spark, path).select("seq_id", "start", "end", "strand", "name", "score")

    return run


for codec, end in (("gzip", ".bed.gz"), ("bzip2", ".bed.bz2")):
    Q[f"read_bed_{codec}"] = (zipped(codec, end), f"with {RG} select seq as seq_id, s as start, e as \"end\", cast(st as integer) as strand, 'r' || rid as name, cast(rid%7 as double) as score from r")


def bedgraph(spark, d):
    rows = regions(spark, d).select("seq_id", (F.col("start") - 1).alias("lo"), (F.col("end") - 1).alias("hi"), (F.col("_row") % 9 / 2).alias("value"))
    return SG.open_signal(spark, written(spark, rows.select(S.bedgraph_line().alias("line")), "x.bdg")).select("seq_id", "start", "end", "score")


Q["read_bedgraph"] = (bedgraph, f"with {RG} select seq as seq_id, s as start, e as \"end\", (rid%9)/2.0 as score from r")


def peaks(spark, d):
    k = F.col("_row")
    lines = regions(spark, d).select(tabs("seq_id", F.col("start") - 1, F.col("end"), "name", k % 1000, F.lit("."), k % 10 / 2, F.lit(2), k % 3, k % 50))
    return A.bed(spark, written(spark, lines, "x.narrowPeak")).select("name", "type", "start", "end", "score", "peak", F.col("signalValue").cast("double").alias("signal"), F.col("qValue").cast("double").alias("q"))


Q["read_narrow_peak"] = (peaks, f"with {RG} select 'r' || rid as name, 'peak' as type, s as start, e as \"end\", cast(rid%1000 as double) as score, s+rid%50 as peak, rid%10/2.0 as signal, cast(rid%3 as double) as q from r")


def gapped(spark, d):
    k = F.col("_row")
    lines = regions(spark, d).select(tabs("seq_id", F.col("start") - 1, F.col("end"), "name", k % 1000, F.lit("+"), F.col("start") - 1, F.col("end"), F.lit("0"), F.lit(2), F.lit("10,20"), F.lit("0,80"), F.lit(1), F.lit(2), F.lit(3)))
    found = A.bed_blocks(A.bed(spark, written(spark, lines, "x.gappedPeak")))
    return found.filter("type = 'exon'").select("seq_id", "start", "end")


Q["read_gapped_peak"] = (gapped, f"with {RG} select seq as seq_id, s as start, s+9 as \"end\" from r union all select seq, s+80, s+99 from r")

# ---- gene models ---------------------------------------------------------------------------------


def listed(spark, d):
    tx, parts = gene_model(spark, d)
    return S.exon_lists(tx, G.exons(parts)).join(G.cds_bounds(parts).select("transcript_id", "cds_start", "cds_stop"), "transcript_id", "left").withColumn("gene_name", F.col("gene_id").cast("string"))


PIECES = "select tid as transcript_id, 'exon' as type, s as start, e as \"end\" from ex union all select tid, 'CDS', s, e from cds"


def bed12(spark, d):
    lines = listed(spark, d).select(S.bed12_line().alias("line"))
    named = A.bed(spark, written(spark, lines, "x.bed12"))
    found = A.bed_blocks(named).join(named.select(F.col("id").alias("transcript_id"), "name"), "transcript_id")
    return found.filter("type in ('exon', 'CDS')").select(F.col("name").alias("transcript_id"), "type", "start", "end")


Q["read_bed12"] = (bed12, f"with {EX} {PIECES}")


def gff3_path(spark, d):
    tx, parts = gene_model(spark, d)
    text = lambda c: F.col(c).cast("string")
    empty = F.create_map().cast("map<string,string>")
    place = ["seq_id", "start", "end", "strand"]
    rna = tx.select(*place, F.lit("mRNA").alias("type"), F.col("transcript_id").alias("id"), F.concat(F.lit("n "), "transcript_id").alias("name"), F.array(text("gene_id")).alias("parents"))
    own = parts.select(*place, "type", none().alias("id"), none().alias("name"), F.array("transcript_id").alias("parents"))
    rows = rna.unionByName(own).withColumns({"source": F.lit("made"), "score": none(), "phase": none(), "attributes": empty})
    return written(spark, rows.select(S.gff3_line().alias("line")), "x.gff3")


def gff3_transcripts(spark, d):
    _, tx, _ = A.gene_tables(A.gff(spark, gff3_path(spark, d)))
    return tx.select("transcript_id", "gene_id", "name", "start", "end", "strand")


def gff3_parts(spark, d):
    _, _, parts = A.gene_tables(A.gff(spark, gff3_path(spark, d)))
    return parts.select("transcript_id", "type", "start", "end")


def gff3_genes(spark, d):
    genes, _, _ = A.gene_tables(A.gff(spark, gff3_path(spark, d)))
    return genes.select("gene_id", "start", "end")


Q["read_gff3_transcripts"] = (gff3_transcripts, f"with {EX} select tid as transcript_id, cast(gid as varchar) as gene_id, 'n ' || tid as name, s as start, e as \"end\", cast(st as integer) as strand from tx")
Q["read_gff3_parts"] = (gff3_parts, f"with {EX} {PIECES}")
Q["read_gff3_genes"] = (gff3_genes, f"with {EX} select cast(gid as varchar) as gene_id, min(s) as start, max(e) as \"end\" from tx group by gid")
Q["gff_types"] = (lambda s, d: A.gff(s, gff3_path(s, d), "mrna|cds").groupBy("type").agg(F.count("*").alias("n")), f"with {EX} select 'mRNA' as type, count(*) as n from tx union all select 'CDS', count(*) from cds")
Q["list_types"] = (lambda s, d: engine.types(A.gff(s, gff3_path(s, d))).select("source", F.array_join("types", ",").alias("types")), "select 'made' as source, 'CDS,exon,mRNA' as types")
Q["feature_list"] = (lambda s, d: engine.feature_list(A.gff(s, gff3_path(s, d)), ["mRNA"]), f"with {EX} select tid as Primary_ID, 'n ' || tid as Name, 'mRNA' as Type from tx")
Q["find_feature"] = (lambda s, d: engine.find(A.gff(s, gff3_path(s, d)), name="n 1.A").select("id", "start", "end"), f"with {EX} select tid as id, s as start, e as \"end\" from tx where tid = '1.A'")
Q["parent_links"] = (lambda s, d: A.links(A.gff(s, gff3_path(s, d))).groupBy("parent_id").agg(F.count("*").alias("n")), f"with {EX}, a as (select cast(gid as varchar) as p from tx union all select tid from ex union all select tid from cds) select p as parent_id, count(*) as n from a group by p")


def gtf(spark, d):
    tx, parts = gene_model(spark, d)
    rows = parts.join(tx.select("transcript_id", "gene_id"), "transcript_id").withColumns({"source": F.lit("s"), "score": none(), "phase": none(), "gene_id": F.col("gene_id").cast("string")})
    return A.gene_tables(A.gff(spark, written(spark, rows.select(S.gtf_line().alias("line")), "x.gtf")))


Q["read_gtf_genes"] = (lambda s, d: gtf(s, d)[0].select("gene_id", "start", "end"), f"with {EX} select cast(gid as varchar) as gene_id, min(s) as start, max(e) as \"end\" from tx group by gid")
Q["read_gtf_transcripts"] = (lambda s, d: gtf(s, d)[1].select("transcript_id", "gene_id", "start", "end"), f"with {EX} select tid as transcript_id, cast(gid as varchar) as gene_id, s as start, e as \"end\" from tx")
Q["read_gtf_introns"] = (lambda s, d: G.introns(G.exons(gtf(s, d)[2])).select("transcript_id", "start", "end"), f"with {EX}, i as (select tid, e+1 as a, lead(s) over (partition by tid order by s)-1 as b from ex) select tid as transcript_id, a as start, b as \"end\" from i where b>=a")


def gene_table(spark, d):
    return A.ucsc(spark, written(spark, listed(spark, d).select(S.ref_flat_line().alias("line")), "x.refFlat"))


Q["read_ref_flat"] = (lambda s, d: gene_table(s, d).select("transcript_id", "gene_name", "start", "end", "strand", "type"), f"with {EX} select tid as transcript_id, cast(gid as varchar) as gene_name, s as start, e as \"end\", cast(st as integer) as strand, case when tid in (select tid from cds) then 'mRNA' else 'ncRNA' end as type from tx")
Q["read_ref_flat_parts"] = (lambda s, d: A.ucsc_parts(gene_table(s, d)).filter("type in ('exon', 'CDS')").select("transcript_id", "type", "start", "end"), f"with {EX} {PIECES}")
Q["ucsc_genes"] = (
    lambda s, d: A.ucsc_genes(gene_table(s, d)).select("transcript_id", "gene_id"),
    f"with {EX}, a as (select *, case when s > coalesce(max(e) over (partition by gid, st order by s, e, tid rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as o from tx), k as (select *, sum(o) over (partition by gid, st order by s, e, tid rows unbounded preceding) as k from a), i as (select gid, st, k, min(s) as s0 from k group by all), n as (select *, row_number() over (partition by gid order by s0, st)-1 as n from i) select tid as transcript_id, case when n=0 then cast(gid as varchar) else gid || '.' || n end as gene_id from k join n using (gid, st, k)",
)
Q["side_table"] = (
    lambda s, d: A.with_side_table(gene_table(s, d), read(s, d, "orders").select(F.col("o_orderkey").alias("_row"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".A")).alias("key"), F.col("o_orderstatus").alias("value")), "status").select("transcript_id", "status"),
    f"with {EX} select tid as transcript_id, o_orderstatus as status from tx left join orders on tid = o_orderkey || '.A'",
)
Q["transcript_types"] = (lambda s, d: G.by_biotype(gene_table(s, d).withColumnRenamed("type", "biotype"), "^mrna").select("transcript_id"), f"with {EX} select distinct tid as transcript_id from cds")

# ---- variants, signals, alignments, sequences ----------------------------------------------------


def variants(spark, d):
    k = F.col("p_partkey")
    ident = F.when(k % 3 == 0, ".").otherwise(F.concat(F.lit("rs"), k.cast("string")))
    rows = read(spark, d, "part").select(tabs(F.regexp_replace("p_brand", "#", ""), k + 1, ident, F.lit("A"), F.expr("repeat('C', cast(p_size % 5 + 1 as int))"), F.col("p_size"), F.lit("PASS"), F.concat(F.lit("DP="), k.cast("string"), F.lit(";DB"))))
    found = A.vcf(spark, written(spark, rows, "x.vcf"))
    return found.select("seq_id", "start", "end", "name", "score", F.col("info.DP").alias("depth"), F.col("info.DB").alias("db"))


Q["read_vcf"] = (variants, "select replace(p_brand, '#', '') as seq_id, p_partkey+1 as start, p_partkey+1+p_size%5 as \"end\", case when p_partkey%3=0 then replace(p_brand, '#', '') || ':' || (p_partkey+1) else 'rs' || p_partkey end as name, cast(p_size as double) as score, cast(p_partkey as varchar) as depth, '1' as db from part")


def wiggle(kind: str):
    def run(spark, d):
        rows = regions(spark, d).select("seq_id", "start", (F.col("_row") % 8 / 4).alias("score"))
        lines = S.wig_lines(rows, kind, 10, span=10)
        path = f"{shared_folder(spark)}/x.wig"
        # a file for each sequence, in order
        lines.repartition(F.col("seq_id")).sortWithinPartitions("seq_id", "start", "part").select("seq_id", "line").write.partitionBy("seq_id").text(path)
        return SG.wig(spark, f"{path}/seq_id=*").select("seq_id", "start", "end", "score")

    return run


for kind in ("fixed", "variable"):
    Q[f"read_wig_{kind}"] = (wiggle(kind), f"with {RG} select seq as seq_id, s as start, s+9 as \"end\", rid%8/4.0 as score from r")


def sam(spark, d):
    c = F.col
    lines = alignments(spark, d).select(tabs("qname", c("flag"), "seq_id", c("pos") + 1, c("mapq"), "cigar", F.lit("="), F.lit(0), c("isize"), F.lit("*"), F.lit("*"), F.concat(F.lit("NH:i:"), c("nh").cast("string"))))
    return written(spark, lines, "x.sam")


Q["read_sam"] = (lambda s, d: SG.sam(s, sam(s, d)).select("qname", "flag", "seq_id", "pos", "end", "mapq", "mate_seq_id", "isize", "nh"), f"with {AL} select qname, cast(flag as integer) as flag, seq as seq_id, p as pos, c as \"end\", cast(mapq as integer) as mapq, seq as mate_seq_id, cast(isize as integer) as isize, cast(nh as integer) as nh from a")
Q["sam_signal"] = (lambda s, d: SG.open_signal(s, sam(s, d)).select("seq_id", "start", "end", "strand", "name"), f"with {AL} select seq as seq_id, p+1 as start, c as \"end\", cast(case when rev then -1 else 1 end as integer) as strand, qname as name from a")
Q["largest_gap"] = (
    lambda s, d: alignments(s, d).withColumn("cigar", F.concat(F.lit("5M"), F.col("mapq").cast("string"), F.lit("N3M"), F.col("isize").cast("string"), F.lit("N2M"))).select("qname", "pos", W.largest_gap().alias("gap")).filter("gap <= 200"),
    f"with {AL} select qname, p as pos, cast(greatest(mapq, isize) as bigint) as gap from a where greatest(mapq, isize) <= 200",
)
Q["proper_fragments"] = (
    lambda s, d: W.proper_fragments(alignments(s, d).withColumns({"flag": F.when(F.col("isize") % 2 == 0, 0x23).otherwise(0x13), "mate_seq_id": F.when(F.col("nh") == 1, F.lit("x")).otherwise(F.col("seq_id"))}), 50, 200).select("qname", "pos"),
    f"with {AL} select qname, p as pos from a where isize%2=0 and nh<>1 and isize between 50 and 200",
)


def paired(spark, d):
    """A read pair for each order: 20 bases from either end of its fragment."""
    k = F.col("o_orderkey")
    size, pos = k % 700, k * 3
    end = lambda flag, at, insert: read(spark, d, "orders").select(k.cast("string").alias("qname"), F.col("o_orderstatus").alias("seq_id"), at.alias("pos"), (at + 20).alias("end"), F.lit("20M").alias("cigar"), F.lit(flag).alias("flag"), insert.cast("int").alias("isize"), (k % 3 + 1).cast("int").alias("nh"))
    return end(0x63, pos, size).unionByName(end(0x93, pos + size - 20, -size).filter("qname % 4 <> 0"))


PAIR = "p as (select o_orderkey as k, o_orderstatus as seq, o_orderkey*3 as a, o_orderkey*3+o_orderkey%700-20 as b from orders where o_orderkey%4<>0 and o_orderkey%700 between 30 and 600 and o_orderkey%700>=20)"
Q["mate_pairs"] = (lambda s, d: P.mates(paired(s, d)).select("qname", "seq_id", "pos", "m_pos", "nh"), f"with {PAIR} select cast(k as varchar) as qname, seq as seq_id, a as pos, b as m_pos, cast(k%3+1 as integer) as nh from p")
Q["smart_pairs"] = (lambda s, d: P.smart_pairs(P.mates(paired(s, d))).select("qname", "start", "end"), f"with {PAIR} select cast(k as varchar) as qname, a as start, b+19 as \"end\" from p where b<=a+20 union all select cast(k as varchar), a, a+19 from p where b>a+20 union all select cast(k as varchar), b, b+19 from p where b>a+20")


def sequences(spark, d):
    rows = read(spark, d, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("name"), F.translate("p_type", " ", "").alias("sequence"))
    return SG.fasta(spark, written(spark, rows.select(S.fasta_record(width=5).alias("line")), "x.fa"), 4)


Q["read_fasta"] = (lambda s, d: sequences(s, d), "with t as (select 's' || p_partkey as n, replace(p_type, ' ', '') as q from part), c as (select n, q, unnest(range(0, (len(q)-1)//4+1)) as k from t) select n as seq_id, k as chunk, substr(q, k*4+1, 4) as text from c")
Q["sequence_lengths"] = (lambda s, d: SG.sequence_lengths(sequences(s, d), "s.*7$"), "select 's' || p_partkey as seq_id, cast(len(replace(p_type, ' ', '')) as bigint) as length from part where p_partkey%10<>7")
Q["sequence_of_region"] = (
    lambda s, d: G.sequence(read(s, d, "part").select(F.col("p_partkey").alias("_row"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("seq_id"), F.lit(3).alias("start"), F.lit(6).alias("end"), F.lit(1).alias("strand")), sequences(s, d), 4),
    "select p_partkey as _row, substr(replace(p_type, ' ', ''), 3, 4) as sequence from part",
)

# ---- tables and lookups --------------------------------------------------------------------------


def table(spark, d):
    from ..model import FeatureTable

    path = f"{shared_folder(spark)}/x"
    engine.write(FeatureTable(read(spark, d, "part").select(F.col("p_partkey").alias("Name"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("Score"), F.col("p_brand").alias("Type"))), path)
    return files.load(spark, path, header=None).df


Q["load_table"] = (lambda s, d: table(s, d).filter("Name <> 'Name'").select(F.col("Name").cast("long").alias("name"), F.coalesce("Score", F.lit("none")).alias("score"), F.col("Type").alias("type")), "select p_partkey as name, case when p_size%3>0 then cast(p_size as varchar) else 'none' end as score, p_brand as type from part")
Q["convert_to_bed"] = (
    lambda s, d: engine.as_bed(engine.FeatureTable(regions(s, d).withColumn("score", F.lit(2)))).select("line"),
    f"with {RG} select seq || chr(9) || (s-1) || chr(9) || e || chr(9) || 'r' || rid || chr(9) || '2.0' || chr(9) || case when st<0 then '-' else '+' end as line from r",
)
Q["convert_to_gff"] = (lambda s, d: engine.as_gff(engine.FeatureTable(regions(s, d)), "src", "peak").select("line"), f"with {RG} select concat_ws(chr(9), seq, 'src', 'peak', s, e, '.', case when st<0 then '-' else '+' end, '.', 'Name=r' || rid) as line from r")
Q["convert_to_wig"] = (lambda s, d: engine.as_wig(engine.FeatureTable(regions(s, d).withColumn("score", F.col("_row") % 5))).filter("part = 1").select("seq_id", "line"), f"with {RG} select seq as seq_id, s || ' ' || (rid%5) || '.0' as line from r")
Q["midpoint_length"] = (lambda s, d: regions(s, d).select(F.col("_row").alias("rid"), V.midpoint("start", "end").alias("mid"), V.length("start", "end").alias("length")), f"with {RG} select rid, (s+e)//2 as mid, e-s+1 as length from r")
Q["mean_order"] = (
    lambda s, d: K.number(read(s, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("price")), [*W.mean_order(["p_size", "price"]), F.col("p_partkey").asc()], "n").select("p_partkey", "n"),
    "select p_partkey, row_number() over (order by (p_size+p_retailprice)/2 desc, p_partkey) as n from part",
)


def exon_signal(spark, d):
    tx, parts = gene_model(spark, d)
    own = parts.filter("type = 'exon'").withColumnRenamed("transcript_id", "parent_id")
    marks = tx.select("seq_id", (F.col("start") + 5).alias("start"), (F.col("start") + 5).alias("end"), "strand", F.col("end").cast("double").alias("score"), F.col("transcript_id").alias("name"))
    found = C.subfeature_score(own, tx.select(F.col("transcript_id").alias("id")), marks, "count", width=256)
    return found.select(F.col("id").alias("transcript_id"), F.col("count").alias("value"))


Q["subfeature_count"] = (exon_signal, f"with {EX}, m as (select s+5 as p, count(*) as n from tx group by 1), c as (select tid, sum(n) as n from ex join m on p between s and e group by tid) select tx.tid as transcript_id, cast(coalesce(n, 0) as bigint) as value from tx left join c using (tid)")


def long_bins(spark, d):
    found = C.binned_long(regions(spark, d), signal(spark, d), "count", 4, width=128)
    return found.select(F.col("_row").alias("rid"), "bin", "value")


Q["binned_long"] = (
    long_bins,
    f"with {RG}, b as (select rid, seq, unnest(range(0,4)) as bin, s as s0, e as e0, st from r), w as (select rid, seq, bin, case when st>=0 then s0+cast(round_even(bin*0.25*(e0-s0+1),0) as bigint) else e0-cast(round_even((bin+1)*0.25*(e0-s0+1),0) as bigint)+1 end as a, case when st>=0 then s0+cast(round_even((bin+1)*0.25*(e0-s0+1),0) as bigint)-1 else e0-cast(round_even(bin*0.25*(e0-s0+1),0) as bigint) end as z from b) select rid, bin, count(g.s) as value from w left join g on g.seq=w.seq and g.s<=z and a<=g.e group by all",
)
Q["score_attribute"] = (
    lambda s, d: read(s, d, "part").select(F.col("p_partkey").alias("id"), r6(F.try_element_at(V.attributes(F.concat(F.lit("fold="), F.col("p_size") / 4, F.lit(";Name=x"))), F.lit("fold")).try_cast("double")).alias("v")),
    f"select p_partkey as id, {r6_sql('p_size/4.0')} as v from part",
)
