"""Queries over gene models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collect as C
from ..operators import genes as G
from ..sources import sinks as S
from .data import EX, gene_model, r6, r6_sql

Q: dict[str, tuple] = {}
EXONS = "select tid as transcript_id, s as start, e as \"end\""
INTRON = f"{EX}, i0 as (select tid, gid, st, e+1 as s, lead(s) over (partition by tid order by s)-1 as e from ex), it as (select * from i0 where e>=s)"


def parts_of(build):
    def run(spark, d):
        tx, parts = gene_model(spark, d)
        return build(tx, parts)

    return run


def place(df, *more):
    return df.select("transcript_id", "start", "end", *more)


Q["exons"] = (parts_of(lambda tx, p: place(G.exons(p))), f"with {EX} {EXONS} from ex")
Q["introns"] = (parts_of(lambda tx, p: place(G.introns(G.exons(p)), "name")), f"with {INTRON} {EXONS}, tid || '.intron' || (row_number() over (partition by tid order by case when st>=0 then s else -e end)-1) as name from it")
Q["collapsed"] = (
    parts_of(lambda tx, p: G.collapse(G.exons(p), tx).select("gene_id", "start", "end")),
    f"with {EX}, a as (select gid, s, e, case when s > coalesce(max(e) over (partition by gid, st order by s, e rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as o from ex), b as (select *, sum(o) over (partition by gid order by s, e, o desc rows between unbounded preceding and current row) as k from a) select gid as gene_id, min(s) as start, max(e) as \"end\" from b group by gid, k",
)
Q["collapsed_length"] = (
    parts_of(lambda tx, p: G.collapsed_length(G.collapse(G.exons(p), tx))),
    f"with {EX}, a as (select gid, s, e, case when s > coalesce(max(e) over (partition by gid order by s, e rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as o from ex), b as (select *, sum(o) over (partition by gid order by s, e, o desc rows between unbounded preceding and current row) as k from a), c as (select gid, min(s) as s, max(e) as e from b group by gid, k) select gid as gene_id, count(*) as n_exons, cast(sum(e-s+1) as bigint) as length from c group by gid",
)
for which, agg in (("first", "min"), ("last", "max")):
    Q[f"{which}_exon"] = (parts_of(lambda tx, p, w=which: place(G.regions(f"{w}_exon", tx, p))), f"with {EX} select tid as transcript_id, arg_{agg}(s, case when st>=0 then s else -e end) as start, arg_{agg}(e, case when st>=0 then s else -e end) as \"end\" from ex group by tid")
    Q[f"{which}_intron"] = (parts_of(lambda tx, p, w=which: place(G.regions(f"{w}_intron", tx, p))), f"with {INTRON} select tid as transcript_id, arg_{agg}(s, case when st>=0 then s else -e end) as start, arg_{agg}(e, case when st>=0 then s else -e end) as \"end\" from it group by tid")
SHARED = "n as (select gid, count(distinct tid) as t from tx group by gid), k as (select gid, s, e, count(distinct tid) as n from {} group by all) select gid as gene_id, s as start, e as \"end\", n, case when n=t then 'common' when n=1 then 'alternate' else 'uncommon' end as kind from k join n using (gid)"
Q["alt_common_uncommon"] = (parts_of(lambda tx, p: G.shared(G.exons(p), tx).select("gene_id", "start", "end", "n", "kind")), f"with {EX}, " + SHARED.format("ex"))
Q["alt_common_introns"] = (parts_of(lambda tx, p: G.shared(G.introns(G.exons(p)), tx).select("gene_id", "start", "end", "n", "kind")), f"with {INTRON}, " + SHARED.format("it"))
UTR = f"{EX}, c as (select tid, min(s) as a, max(e) as b from cds group by tid), u as (select tid, st, s, least(e, a-1) as e, 1 as lf from ex join c using (tid) where s<a union all select tid, st, greatest(s, b+1), e, 0 from ex join c using (tid) where e>b)"
Q["utrs"] = (parts_of(lambda tx, p: place(G.utrs(G.exons(p), p), "type")), f"with {UTR} {EXONS}, case when (lf=1)=(st>=0) then 'five_prime_utr' else 'three_prime_utr' end as type from u")
Q["utr5"] = (parts_of(lambda tx, p: place(G.regions("utr5", tx, p))), f"with {UTR} {EXONS} from u where (lf=1)=(st>=0)")
Q["cds_bounds"] = (parts_of(lambda tx, p: G.cds_bounds(p).select("transcript_id", "cds_start", "cds_stop", "cds_length")), f"with {EX} select tid as transcript_id, min(s) as cds_start, max(e) as cds_stop, cast(sum(e-s+1) as bigint) as cds_length from cds group by tid")
Q["cds_phase"] = (parts_of(lambda tx, p: place(G.phases(p.filter("type = 'CDS'")), "phase")), f"with {EX} {EXONS}, cast(((-coalesce(sum(e-s+1) over (partition by tid order by case when st>=0 then s else -e end rows between unbounded preceding and 1 preceding),0))%3+3)%3 as integer) as phase from cds")
Q["codons"] = (
    parts_of(lambda tx, p: place(G.codons(p), "type")),
    f"with {EX}, c as (select tid, st, min(s) as a, max(e) as b from cds group by all) select tid as transcript_id, case when st>=0 then a else b-2 end as start, case when st>=0 then a+2 else b end as \"end\", 'start_codon' as type from c union all select tid, case when st>=0 then b-2 else a end, case when st>=0 then b else a+2 end, 'stop_codon' from c",
)
for kind, x in (("tss", "case when st>=0 then s else e end"), ("tts", "case when st>=0 then e else s end")):
    Q[kind] = (parts_of(lambda tx, p, k=kind: place(G.regions(k, tx, p))), f"with {EX} select tid as transcript_id, {x} as start, {x} as \"end\" from tx")
Q["splice_sites"] = (parts_of(lambda tx, p: place(G.regions("splice", tx, p))), f"with {INTRON}, a as (select tid, unnest([s, e]) as x from it) select tid as transcript_id, x as start, x as \"end\" from a")
Q["transcript_length"] = (parts_of(lambda tx, p: G.transcript_length(G.exons(p))), f"with {EX} select tid as transcript_id, cast(sum(e-s+1) as bigint) as length from ex group by tid")
Q["gene_length"] = (parts_of(lambda tx, p: G.gene_length(G.exons(p), tx)), f"with {EX}, l as (select tid, gid, sum(e-s+1) as n from ex group by all) select gid as gene_id, cast(max(n) as bigint) as length from l group by gid")
Q["coding"] = (parts_of(lambda tx, p: G.coding(tx, p).select("transcript_id", "is_coding")), f"with {EX} select tid as transcript_id, tid in (select tid from cds) as is_coding from tx")
Q["tsl_best"] = (parts_of(lambda tx, p: G.best_support(tx).select("transcript_id")), f"with {EX}, l as (select tid, gid, case right(tid,1) when 'A' then 1 when 'N' then 2 else 9 end as n from tx), b as (select *, min(n) over (partition by gid) as m from l) select tid as transcript_id from b where n=m")
Q["gene_adjust"] = (parts_of(lambda tx, p: place(G.adjust(tx, "53", -20, 30))), f"with {EX}, m as (select tid, case when st>=0 then s-20 else e+20 end as a, case when st>=0 then e+30 else s-30 end as b from tx) select tid as transcript_id, greatest(least(a,b),1) as start, greatest(greatest(a,b),1) as \"end\" from m")
Q["unique_regions"] = (parts_of(lambda tx, p: G.unique_regions(tx.select("gene_id", "seq_id", "strand", F.col("start"), F.col("start").alias("end"))).select("gene_id", "start")), f"with {EX} select distinct gid as gene_id, s as start from tx")
Q["spliced_offsets"] = (parts_of(lambda tx, p: place(G.spliced_offsets(G.exons(p)), "spliced")), f"with {EX} {EXONS}, cast(coalesce(sum(e-s+1) over (partition by tid order by case when st>=0 then s else -e end rows between unbounded preceding and 1 preceding),0) as bigint) as spliced from ex")


def spliced(spark, d):
    _, parts = gene_model(spark, d)
    own = parts.filter("type = 'exon'").withColumn("n", F.col("end") - F.col("start"))
    scores = own.select("seq_id", F.col("start"), F.col("end"), F.col("strand"), F.col("n").cast("double").alias("score"), F.col("transcript_id").alias("name"))
    found = C.spliced_positions(G.spliced_offsets(G.exons(parts)), scores, width=64)
    return found.select("transcript_id", "pos", r6("score").alias("score"))


Q["spliced_positions"] = (
    spliced,
    f"with {EX}, x as (select *, coalesce(sum(e-s+1) over (partition by tid order by case when st>=0 then s else -e end rows between unbounded preceding and 1 preceding),0) as sp from ex), y as (select cast(floor((s+e)/2.0) as bigint) as p, sum(e-s) as n, count(*) as k from ex group by 1), z as (select tid, cast(sp+case when st>=0 then p-s else e-p end as bigint) as pos, n, k from x join y on p between s and e) select tid as transcript_id, pos, {r6_sql('sum(n)/sum(k)')} as score from z group by all",
)


def listed(tx, p):
    bounds = G.cds_bounds(p).select("transcript_id", "cds_start", "cds_stop")
    return S.exon_lists(tx, G.exons(p)).join(bounds, "transcript_id", "left").withColumn("gene_name", F.col("gene_id").cast("string"))


LIST = f"{EX}, c as (select tid, min(s) as a, max(e) as b from cds group by tid), l as (select tid, gid, st, min(s) as s, max(e) as e, count(*) as n, string_agg(s-1, ',' order by s) || ',' as ss, string_agg(e, ',' order by s) || ',' as es, string_agg(e-s+1, ',' order by s) as sz from ex group by all), f as (select *, string_agg(ex.s-l.s, ',' order by ex.s) as rel from l join ex using (tid) group by all)"
Q["ref_flat_string"] = (parts_of(lambda tx, p: listed(tx, p).select(S.ref_flat_line().alias("line"))), f"with {LIST} select concat_ws(chr(9), gid, tid, 'c1', case when st<0 then '-' else '+' end, s-1, e, coalesce(a-1, e), coalesce(b, e), n, ss, es) as line from l left join c using (tid)")
Q["bed12_string"] = (
    parts_of(lambda tx, p: listed(tx, p).select(S.bed12_line().alias("line"))),
    f"with {EX}, c as (select tid, min(s) as a, max(e) as b from cds group by tid), l as (select ex.tid, tx.st, tx.s, tx.e, count(*) as n, string_agg(ex.e-ex.s+1, ',' order by ex.s) as sz, string_agg(ex.s-tx.s, ',' order by ex.s) as rel from ex join tx on ex.tid=tx.tid group by all) select concat_ws(chr(9), 'c1', s-1, e, l.tid, 1000, case when st<0 then '-' else '+' end, coalesce(a-1, e), coalesce(b, e), '0,0,0', n, sz, rel) as line from l left join c on l.tid=c.tid",
)
Q["gtf_string"] = (
    parts_of(lambda tx, p: p.join(tx.select("transcript_id", "gene_id"), "transcript_id").withColumns({"source": F.lit("s"), "score": F.lit(None).cast("string"), "phase": F.lit(None).cast("string")}).withColumn("gene_id", F.col("gene_id").cast("string")).select(S.gtf_line().alias("line"))),
    f"with {EX}, a as (select tid, gid, st, s, e, 'exon' as t from ex union all select tid, gid, st, s, e, 'CDS' from cds) select concat_ws(chr(9), 'c1', 's', t, s, e, '.', case when st<0 then '-' else '+' end, '.', 'gene_id \"' || gid || '\"; transcript_id \"' || tid || '\";') as line from a",
)
