"""Queries over alignments: coverage, counts and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate as R
from ..operators import pileup as P
from .data import AL, RG, alignments, r6, r6_sql, read, signal

Q: dict[str, tuple] = {}


def depth(spark, d):
    frags = P.single_fragments(alignments(spark, d), "span")
    return P.depth_runs(frags, region=20_000)


RUNS = f"{AL}, ev as (select seq, p as pt, 1 as d from a union all select seq, c, -1 from a), es as (select seq, pt, sum(d) as d from ev group by seq, pt having sum(d)<>0), cs as (select seq, pt, sum(d) over (partition by seq order by pt) as v, lead(pt) over (partition by seq order by pt) as nx from es), runs as (select seq, pt as lo, nx-1 as hi, v from cs where nx is not null and v<>0)"
Q["coverage_runs"] = (lambda s, d: depth(s, d).select("seq_id", "lo", "hi", F.col("value").cast("long").alias("value")), f"with {RUNS} select seq as seq_id, lo, hi, cast(v as bigint) as value from runs")
Q["bin_mean"] = (lambda s, d: P.bin_mean(depth(s, d), 10).select("seq_id", "bin", r6("value").alias("value")), f"with {RUNS}, b as (select seq, v, lo, hi, unnest(range(lo//10, hi//10+1)) as bin from runs) select seq as seq_id, bin, {r6_sql('sum(v*(least(hi, bin*10+9)-greatest(lo, bin*10)+1))/10.0')} as value from b group by all")
M = "cast(floor((p+c-1)/2.0) as bigint)"
MODES = {
    "start": ("case when rev then c-1 else p end", "case when rev then c-1 else p end"),
    "mid": (M, M),
    "span": ("p", "c-1"),
    "extend": ("case when rev then greatest(c-30,0) else p end", "case when rev then c-1 else p+29 end"),
    "cspan": (f"greatest({M}-15+1,0)", f"{M}+15"),
}
for mode, (lo, hi) in MODES.items():
    size = 1 if mode in ("start", "mid") else 10
    Q[f"{mode}_counts"] = (
        lambda s, d, m=mode, z=size: P.bin_counts(P.single_fragments(alignments(s, d), m, extension=30, bin_size=z)).select("seq_id", "bin", F.col("value").cast("long").alias("value")),
        f"with {AL}, f as (select seq, {lo} as lo, {hi} as hi from a), b as (select seq, unnest(range(lo//{size}, hi//{size}+1)) as bin from f) select seq as seq_id, bin, count(*) as value from b group by all",
    )
Q["start_counts_stranded"] = (
    lambda s, d: P.bin_counts(P.single_fragments(alignments(s, d), "start", shift=7), ("seq_id", "strand")).select("seq_id", "strand", "bin", F.col("value").cast("long").alias("value")),
    f"with {AL} select seq as seq_id, cast(case when rev then -1 else 1 end as integer) as strand, case when rev then c-1-7 else p+7 end as bin, count(*) as value from a where (case when rev then c-1-7 else p+7 end)>=0 group by all",
)
PAIR = {"start": ("p+isize",) * 2, "mid": ("p+isize//2",) * 2, "span": ("p", "p+isize"), "cspan": ("greatest(p+isize//2-15,0)", "p+isize//2+15")}
for mode, (lo, hi) in PAIR.items():
    Q[f"paired_{mode}_counts"] = (
        lambda s, d, m=mode: P.bin_counts(P.paired_fragments(alignments(s, d).filter("flag % 32 = 0"), m, 30, 10)).select("seq_id", "bin", F.col("value").cast("long").alias("value")),
        f"with {AL}, f as (select seq, {lo} as lo, {hi} as hi from a where not rev), b as (select seq, unnest(range(lo//10, hi//10+1)) as bin from f) select seq as seq_id, bin, count(*) as value from b group by all",
    )
Q["paired_ends_counts"] = (
    lambda s, d: P.bin_counts(P.paired_fragments(alignments(s, d).filter("flag % 32 = 0"), "ends"), ("seq_id", "strand")).select("seq_id", "strand", "bin", F.col("value").cast("long").alias("value")),
    f"with {AL}, f as (select seq, cast(-1 as integer) as st, p as bin from a where not rev union all select seq, 1, p+isize from a where not rev) select seq as seq_id, st as strand, bin, count(*) as value from f group by all",
)
Q["multi_hit_counts"] = (
    lambda s, d: P.bin_counts(P.single_fragments(alignments(s, d), "mid", bin_size=50), score=P.multi_hit(F.lit(1.0))).select("seq_id", "bin", r6("value").alias("value")),
    f"with {AL} select seq as seq_id, {M}//50 as bin, {r6_sql('sum(1.0/nh)')} as value from a group by all",
)
Q["spliced_blocks"] = (
    lambda s, d: P.blocks(alignments(s, d).select("qname", "seq_id", "pos", F.concat(F.lit("5M"), F.col("isize"), F.lit("N2S7M3D1I2M")).alias("cigar"), F.lit(1.0).alias("score")), True).select("qname", "pos", "end", "score"),
    f"with {AL} select qname, p as pos, p+5 as \"end\", 0.5::double as score from a union all select qname, p+5+isize, p+5+isize+12, 0.5::double from a",
)
Q["total_reads"] = (lambda s, d: P.total_reads(alignments(s, d), 16), f"with {AL} select count(*) as total from a where flag & 1024 = 0 and mapq>=16")
Q["rpm_scale"] = (
    lambda s, d: P.scale(P.bin_counts(P.single_fragments(alignments(s, d), "mid", bin_size=100)), P.rpm(alignments(s, d).count()), "^F", 2.0).select("seq_id", "bin", r6("value").alias("value")),
    f"with {AL}, c as (select seq, {M}//100 as bin, count(*) as v from a group by all) select seq as seq_id, bin, {r6_sql('v*(1e6/(select count(*) from a)*case when seq=chr(70) then 2 else 1 end)')} as value from c",
)


def replicates(spark, d):
    a = alignments(spark, d).withColumn("replicate", (F.col("mapq") / 8 % 2).cast("int"))
    counts = P.bin_counts(P.single_fragments(a, "mid", bin_size=100), ("seq_id", "replicate"))
    return P.replicate_mean(counts, 2).select("seq_id", "bin", r6("value").alias("value"))


Q["replicate_mean"] = (replicates, f"with {AL} select seq as seq_id, {M}//100 as bin, {r6_sql('count(*)/2.0')} as value from a group by all")
W = "(e-s+1)"
Q["wig_stats"] = (
    lambda s, d: P.signal_stats(signal(s, d)).select("bases", *[r6(c).alias(c) for c in ("mean", "min", "max")], r6(F.col("stddev") / 1000).alias("sd")),
    f"with {RG} select cast(sum({W}) as bigint) as bases, {r6_sql(f'sum({W}*sc)/sum({W})')} as mean, {r6_sql('min(sc)')} as min, {r6_sql('max(sc)')} as max, {r6_sql(f'sqrt((sum({W}*sc*sc)-sum({W}*sc)*sum({W}*sc)/sum({W}))/(sum({W})-1))/1000')} as sd from g",
)
Q["score_chain"] = (
    lambda s, d: signal(s, d).select("name", "start", r6(P.score_chain(F.col("score") - 20000, absolute=True, multiply=0.01, add=1, log=2, low=3, high=7)).alias("v")),
    f"with {RG} select nm as name, s as start, {r6_sql('least(greatest(ln(abs(sc-20000)*0.01+1)/ln(2.0), 3.0), 7.0)')} as v from g",
)
Q["high_regions"] = (
    lambda s, d: P.high_regions(P.bin_counts(P.single_fragments(alignments(s, d), "mid", bin_size=100)), 0.5, 10).select("seq_id", "bin", F.col("value").cast("long").alias("value")),
    f"with {AL}, c as (select seq, {M}//100 as bin, count(*) as v from a group by all), m as (select avg(v) as m, stddev_pop(v) as q from c) select seq as seq_id, bin, v as value from c, m where (v-m)/q between 0.5 and 10",
)


def pairs(spark, d):
    """Two signals along orders' lines: by order, places with prices and quantities."""
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("_row"), (F.col("l_partkey") % 40).alias("pos"), F.col("l_extendedprice").alias("a"), F.col("l_quantity").alias("b"))
    return rows.groupBy("_row", "pos").agg(F.max("a").alias("ref"), F.max("b").alias("test"))


PR = "pr as (select l_orderkey%500 as k, l_partkey%40 as pos, max(l_extendedprice) as ref, max(l_quantity) as test from lineitem group by all)"
Q["pearson"] = (lambda s, d: R.pearson(pairs(s, d)).select("_row", "n", r6("r").alias("r")), f"with {PR} select k as _row, count(*) as n, {r6_sql('case when stddev_pop(ref)<>0 and stddev_pop(test)<>0 then corr(ref,test) end')} as r from pr group by k")
RK = f"{PR}, t as (select k, pos, rank() over (partition by k order by ref)+(count(*) over (partition by k, ref)-1)/2.0 as ref, rank() over (partition by k order by test)+(count(*) over (partition by k, test)-1)/2.0 as test from pr)"
Q["spearman"] = (lambda s, d: R.spearman(pairs(s, d)).select("_row", r6("r").alias("r")), f"with {RK} select k as _row, {r6_sql('case when stddev_pop(ref)<>0 and stddev_pop(test)<>0 then corr(ref,test) end')} as r from t group by k")
Q["sum_normal"] = (lambda s, d: R.sum_normal(pairs(s, d), ["ref", "test"]).select("_row", "pos", r6("ref").alias("ref"), r6("test").alias("test")), f"with {PR} select k as _row, pos, {r6_sql('ref*100/sum(abs(ref)) over (partition by k)')} as ref, {r6_sql('test*100/sum(abs(test)) over (partition by k)')} as test from pr")
Q["median_normal"] = (lambda s, d: R.median_normal(pairs(s, d), ["ref"]).select("_row", "pos", r6("ref").alias("ref")), f"with {PR}, m as (select k, quantile_cont(ref,0.5) as m from pr group by k) select k as _row, pos, {r6_sql('ref*100/m')} as ref from pr join m using (k)")
Q["optimal_shift"] = (
    lambda s, d: R.optimal_shift(pairs(s, d), 3, least=0.1).select("_row", F.col("shift").cast("long").alias("shift"), r6("r").alias("r")),
    f"with {PR}, h as (select unnest(range(-3,4)) as h), j as (select a.k, h, a.ref, b.test from pr a cross join h join pr b on a.k=b.k and a.pos=b.pos-h), c as (select k, h, case when stddev_pop(ref)<>0 and stddev_pop(test)<>0 then corr(ref,test) end as r from j group by all), b as (select *, row_number() over (partition by k order by floor(r*1e9+0.5) desc, abs(h), h) as n from c where r>0.1) select k as _row, h as shift, {r6_sql('r')} as r from b where n=1",
)
Q["anova_f"] = (lambda s, d: R.anova(pairs(s, d)).select("_row", F.col("df").cast("long").alias("df"), r6("f").alias("f")), f"with {PR} select k as _row, count(*)-1 as df, {r6_sql('case when var_samp(ref-test)<>0 then count(*)*avg(ref-test)*avg(ref-test)/var_samp(ref-test) end')} as f from pr group by k")
Q["anova"] = (
    lambda s, d: R.p_values(R.anova(pairs(s, d))).select("_row", r6("p").alias("p")),
    # the power series of the incomplete beta function, where Spark has its continued fraction
    f"""with {PR}, t as (select k, (count(*)-1)/2.0 as a, case when var_samp(ref-test)<>0 then count(*)*avg(ref-test)*avg(ref-test)/var_samp(ref-test) end as f from pr group by k),
u as (select k, a, f, 2*a/(2*a+f) as x, f/(2*a+f) as y, lgamma(a+0.5)-lgamma(a)-lgamma(0.5) as g from t where a>0 and f>0),
v as (select k, case when x < (a+1)/(a+2.5) then exp(a*ln(x)+0.5*ln(y)+g)/a*list_sum(list_transform(range(0,400), lambda n: exp(lgamma(a+0.5+n)-lgamma(a+0.5)-lgamma(a+1+n)+lgamma(a+1))*pow(x,n)))
else 1-exp(a*ln(x)+0.5*ln(y)+g)/0.5*list_sum(list_transform(range(0,400), lambda n: exp(lgamma(a+0.5+n)-lgamma(a+0.5)-lgamma(1.5+n)+lgamma(1.5))*pow(y,n))) end as p from u)
select t.k as _row, {r6_sql("case when f is null or a<=0 then null when f<=0 then 0.0 else -log10(greatest(p,1e-300)) end")} as p from t left join v using (k)""",
)
Q["shift_profile"] = (lambda s, d: R.shift_profile(pairs(s, d), 5).select("pos", r6("ref").alias("ref"), r6("test").alias("test")), f"with {PR} select pos//5*5 as pos, {r6_sql('avg(ref)')} as ref, {r6_sql('avg(test)')} as test from pr group by 1")
Q["correlation_summary"] = (lambda s, d: R.summary(R.pearson(pairs(s, d))).select("n", r6("mean").alias("mean"), r6("median").alias("median")), f"with {PR}, c as (select case when stddev_pop(ref)<>0 and stddev_pop(test)<>0 then corr(ref,test) end as r from pr group by k) select count(r) as n, {r6_sql('avg(r)')} as mean, {r6_sql('quantile_cont(r,0.5)')} as median from c")
Q["cross_strand"] = (
    lambda s, d: P.cross_strand(P.bin_counts(P.single_fragments(alignments(s, d), "start", bin_size=10), ("seq_id", "strand")), 6, 2).select(F.col("shift").cast("long").alias("shift"), "n", r6("r").alias("r")),
    f"with {AL}, c as (select seq, rev, (case when rev then c-1 else p end)//10 as b, count(*) as v from a group by all), h as (select unnest([0,2,4,6]) as h) select cast(h as bigint) as shift, count(*) as n, {r6_sql('corr(x.v, y.v)')} as r from c x join h on not x.rev join c y on y.rev and x.seq=y.seq and x.b=y.b-h group by h",
)
