"""The driver's tables as intervals, signals, genes and alignments, in Spark and in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or a temporary one where a single machine runs all."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="shared-")
    return f"{top}/{uuid.uuid4().hex}"


def r6(c: Column | str) -> Column:
    """Six decimals, so that the order of a sum doesn't show; written alike in SQL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") * 1e6 + 0.5) / 1e6


def r6_sql(x: str) -> str:
    return f"floor(cast({x} as double) * 1e6 + 0.5) / 1e6"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("_row"), F.col("o_orderstatus").alias("seq_id"), (k * 10 + 1).alias("start"), (k * 10 + 100).alias("end"), F.when(k % 2 == 0, 1).otherwise(-1).alias("strand"), F.concat(F.lit("r"), k.cast("string")).alias("name"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    strand = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    return read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("seq_id"), s.alias("start"), (s + F.col("l_quantity").cast("long") - 1).alias("end"), strand.alias("strand"), F.col("l_extendedprice").alias("score"), F.col("l_partkey").cast("string").alias("name"))


RG = """r as (select o_orderkey as rid, o_orderstatus as seq, o_orderkey*10+1 as s, o_orderkey*10+100 as e, case when o_orderkey%2=0 then 1 else -1 end as st from orders),
g as (select l_linestatus as seq, l_orderkey*10+l_linenumber as s, l_orderkey*10+l_linenumber+cast(l_quantity as bigint)-1 as e, case l_returnflag when 'A' then 1 when 'R' then -1 else 0 end as st, l_extendedprice as sc, cast(l_partkey as varchar) as nm from lineitem)"""


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_partkey") * 500
    return read(spark, sf_dir, "part").select(F.lit("O").alias("seq_id"), s.alias("start"), (s + F.col("p_size")).alias("end"), F.lit(0).alias("strand"), F.col("p_partkey").cast("string").alias("name"))


BLACK = "x as (select 'O' as seq, p_partkey*500 as s, p_partkey*500+p_size as e from part)"


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).groupBy("seq_id").agg(F.max("end").alias("length"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber") - 1
    size = F.col("l_quantity").cast("long")
    flag = F.when(F.col("l_returnflag") == "R", 0x10).otherwise(0) + F.when(F.col("l_linenumber") % 2 == 0, 0x400).otherwise(0)
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("seq_id"), pos.alias("pos"), (pos + size).alias("end"), flag.alias("flag"), (F.col("l_linenumber") * 8).alias("mapq"),
        F.col("l_partkey").cast("string").alias("qname"), F.concat(size.cast("string"), F.lit("M")).alias("cigar"), (F.col("l_suppkey") % 300 + 20).cast("int").alias("isize"), F.col("l_linestatus").alias("mate_seq_id"), (F.col("l_linenumber") % 3 + 1).alias("nh"),
    )


AL = """a as (select l_linestatus as seq, l_orderkey*10+l_linenumber-1 as p, l_orderkey*10+l_linenumber-1+cast(l_quantity as bigint) as c, (case when l_returnflag='R' then 16 else 0 end) + (case when l_linenumber%2=0 then 1024 else 0 end) as flag,
l_linenumber*8 as mapq, cast(l_partkey as varchar) as qname, l_suppkey%300+20 as isize, l_linenumber%3+1 as nh, l_returnflag='R' as rev from lineitem)"""


def gene_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(transcripts, parts): an order is a gene, its lines by return flag are transcripts, a line is an exon."""
    k = F.col("l_orderkey")
    tid = F.concat_ws(".", k.cast("string"), "l_returnflag")
    s = F.col("l_partkey") % 200 * 40 + 1
    ex = read(spark, sf_dir, "lineitem").select(tid.alias("transcript_id"), k.alias("gene_id"), F.lit("c1").alias("seq_id"), s.alias("start"), (s + F.col("l_quantity").cast("long")).alias("end"), F.when(k % 2 == 0, 1).otherwise(-1).alias("strand")).distinct()
    # exons of a transcript don't overlap: equal starts keep the longest, others that overlap are 40 apart at least or joined
    from ..operators.ranges import islands

    ex = islands(ex, ["transcript_id", "gene_id", "seq_id", "strand"]).drop("n")
    tx = ex.groupBy("transcript_id", "gene_id", "seq_id", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    tx = tx.withColumns({"type": F.lit("transcript"), "tsl": F.when(F.col("transcript_id").endswith("A"), "1").when(F.col("transcript_id").endswith("N"), "2"), "biotype": F.lit(None).cast("string")})
    cds = tx.filter("end - start >= 100").select("transcript_id", (F.col("start") + 30).alias("_a"), (F.col("end") - 30).alias("_b"))
    parts = ex.select("transcript_id", F.lit("exon").alias("type"), "seq_id", "start", "end", "strand")
    coded = ex.join(cds, "transcript_id").withColumns({"start": F.greatest("start", "_a"), "end": F.least("end", "_b")}).filter("start <= end")
    return tx, parts.unionByName(coded.select("transcript_id", F.lit("CDS").alias("type"), "seq_id", "start", "end", "strand"))


EX = """raw as (select distinct cast(l_orderkey as varchar) || '.' || l_returnflag as tid, l_orderkey as gid, case when l_orderkey%2=0 then 1 else -1 end as st, l_partkey%200*40+1 as s, l_partkey%200*40+1+cast(l_quantity as bigint) as e from lineitem),
raw2 as (select *, case when s > coalesce(max(e) over (partition by tid order by s, e rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as o from raw),
raw3 as (select *, sum(o) over (partition by tid order by s, e rows between unbounded preceding and current row) as k from raw2),
ex as (select tid, gid, st, min(s) as s, max(e) as e from raw3 group by tid, gid, st, k),
tx as (select tid, gid, st, min(s) as s, max(e) as e from ex group by tid, gid, st),
cb as (select tid, s+30 as a, e-30 as b from tx where e-s >= 100),
cds as (select ex.tid, gid, st, greatest(s, a) as s, least(e, b) as e from ex join cb using (tid) where greatest(s, a) <= least(e, b))"""
