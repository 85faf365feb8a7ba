"""Queries over regions and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collect as C
from ..operators import ranges as R
from ..operators.methods import METHODS
from .data import BLACK, RG, blacklist, lengths, r6, r6_sql, regions, signal

Q: dict[str, tuple] = {}
WIDTH = 128
MEET = "r.seq=g.seq and r.s<=g.e and g.s<=r.e"
SQL_METHOD = {
    "mean": r6_sql("avg(sc)"), "sum": r6_sql("coalesce(sum(sc),0)"), "median": r6_sql("quantile_cont(sc,0.5)"), "min": r6_sql("min(sc)"), "max": r6_sql("max(sc)"),
    "count": "count(sc)", "pcount": "count(case when r.s<=g.s and g.e<=r.e then 1 end)", "ncount": "count(distinct nm)", "range": r6_sql("max(sc)-min(sc)"), "stddev": r6_sql("stddev_pop(sc)"),
}


def value(method: str):
    return F.col("value").cast("long") if method.endswith("count") else r6("value")


def scored(method: str, strand: str = "all", change=None, sig=signal):
    def run(spark, d):
        own = regions(spark, d)
        found = C.region_score(change(own) if change else own, sig(spark, d), method, strand=strand, width=WIDTH, column="value")
        return found.select(F.col("_row").alias("rid"), value(method).alias("value"))

    return run


def score_sql(method: str, extra: str = "", r: str = "r", g: str = "g") -> str:
    return f"with {RG}, r2 as (select * from {r}), g2 as (select * from {g}) select r.rid, {SQL_METHOD[method]} as value from r2 r left join g2 g on {MEET} {extra} group by r.rid"


for m in METHODS:
    Q[f"region_{m}"] = (scored(m), score_sql(m))
Q["region_sense_count"] = (scored("count", "sense"), score_sql("count", "and (g.st=0 or g.st=r.st)"))
Q["region_antisense_count"] = (scored("count", "antisense"), score_sql("count", "and g.st<>r.st"))
Q["region_sense_mean"] = (scored("mean", "sense"), score_sql("mean", "and (g.st=0 or g.st=r.st)"))
Q["region_extend"] = (scored("count", change=lambda r: C.extend(r, 75)), score_sql("count", r="(select rid, seq, greatest(s-75,1) as s, e+75 as e, st from r)"))


def moved_sql(a: str, b: str) -> str:
    return f"(select rid, seq, st, greatest(least({a},{b}),1) as s, greatest(greatest({a},{b}),1) as e from r)"


def by_strand(f: str, r: str) -> str:
    return f"case when st>=0 then {f} else {r} end"


MID = "cast(floor((s+e)/2.0) as bigint)"
for pos, (a, b, c, d) in {"5": ("s-40", "s+60", "e-60", "e+40"), "3": ("e-40", "e+60", "s-60", "s+40"), "4": (f"{MID}-40", f"{MID}+60", f"{MID}-60", f"{MID}+40"), "53": ("s-40", "e+60", "s+40", "e-60")}.items():
    Q[f"region_adjust_{pos}"] = (scored("count", change=lambda r, p=pos: C.sub_region(r, p, -40, 60)), score_sql("count", r=moved_sql(by_strand(a, c), by_strand(b, d))))
N = "(e-s+1)"
Q["region_fraction"] = (
    scored("count", change=lambda r: C.fraction(r, 0.25, 0.5, 10)),
    score_sql("count", r=moved_sql(by_strand(f"s+cast(floor({N}*0.25+0.5) as bigint)", f"e-cast(floor({N}*0.5+0.5) as bigint)"), by_strand(f"s+cast(floor({N}*0.5+0.5) as bigint)", f"e-cast(floor({N}*0.25+0.5) as bigint)"))),
)
Q["multi_dataset_union"] = (
    scored("count", sig=lambda s, d: C.union_of(signal(s, d).filter("strand = 1"), signal(s, d).filter("strand = -1"))),
    score_sql("count", g="(select * from g where st=1 union all select * from g where st=-1)"),
)


def positions(spark, d):
    found = C.position_scores(regions(spark, d), signal(spark, d), width=WIDTH)
    return found.select(F.col("_row").alias("rid"), "pos", r6("score").alias("score"))


Q["position_scores"] = (positions, f"with {RG} select rid, cast(floor((g.s+g.e)/2.0) as bigint) as pos, {r6_sql('avg(sc)')} as score from r join g on {MEET} where floor((g.s+g.e)/2.0) between r.s and r.e group by all")


def avoided(spark, d):
    own = regions(spark, d)
    found = C.avoid(C.position_scores(own, signal(spark, d), width=WIDTH), own, own, width=WIDTH)
    return found.select(F.col("_row").alias("rid"), "pos")


Q["avoid_neighbours"] = (avoided, f"with {RG}, p as (select distinct rid, r.seq, cast(floor((g.s+g.e)/2.0) as bigint) as pos from r join g on {MEET} where floor((g.s+g.e)/2.0) between r.s and r.e), h as (select distinct p.rid, p.pos from p join r o on o.seq=p.seq and p.pos between o.s and o.e where o.rid<>p.rid) select rid, pos from p where (rid, pos) not in (select rid, pos from h)")


def base_positions(spark, d):
    found = C.position_scores(regions(spark, d), signal(spark, d), width=WIDTH, place="base")
    return found.select(F.col("_row").alias("rid"), "pos", r6("score").alias("score"))


Q["base_scores"] = (base_positions, f"with {RG}, p as (select rid, sc, unnest(range(greatest(r.s,g.s), least(r.e,g.e)+1)) as pos from r join g on {MEET}) select rid, pos, {r6_sql('avg(sc)')} as score from p group by all")

# ---- windows -------------------------------------------------------------------------------------

Q["genome_tiles"] = (lambda s, d: C.genome_windows(lengths(s, d), 500), f"with {RG}, n as (select seq, max(e) as n from g group by seq), w as (select seq, n, unnest(range(1, n+1, 500)) as s from n) select seq as seq_id, s as start, least(s+499, n) as \"end\" from w")
Q["genome_tiles_sliding"] = (lambda s, d: C.genome_windows(lengths(s, d), 500, 250), f"with {RG}, n as (select seq, max(e) as n from g group by seq), w as (select seq, n, unnest(range(1, n+1, 250)) as s from n) select seq as seq_id, s as start, least(s+499, n) as \"end\" from w")
Q["genome_tiles_excluded"] = (
    lambda s, d: C.genome_windows(lengths(s, d), 500, None, blacklist(s, d)),
    f"with {RG}, {BLACK}, n as (select seq, max(e) as n from g group by seq), w as (select seq, n, unnest(range(1, n+1, 500)) as s from n), t as (select seq, s, least(s+499, n) as e from w) select seq as seq_id, s as start, e as \"end\" from t where not exists (select 1 from x where x.seq=t.seq and x.s<=t.e and t.s<=x.e)",
)
REL = f"""{RG}, rr as (select *, case when st>=0 then s else e end as f from r), o as (select rid, sc, nm, case when rr.st>=0 then floor((g.s+g.e)/2.0)-f else f-floor((g.s+g.e)/2.0) end as o from rr join g on rr.seq=g.seq and greatest(f-100,1)<=g.e and g.s<=f+100),
w as (select rid, sc, cast(case when o<0 then -ceil(-o/25.0)*25 when o>0 then floor((o-1)/25.0)*25+1 end as bigint) as win_start from o), p as (select rid, win_start, avg(sc) as value from w where win_start between -100 and 76 group by all)"""


def relative(spark, d, method: str = "mean"):
    return C.relative_profile(regions(spark, d), signal(spark, d), method, size=25, up=4, down=4, width=WIDTH)


Q["relative_profile"] = (lambda s, d: relative(s, d).select(F.col("_row").alias("rid"), "win_start", r6("value").alias("value")), f"with {REL} select rid, win_start, {r6_sql('value')} as value from p")


def relative_long(spark, d):
    windows = C.relative_windows(regions(spark, d), 50, 1, 1).withColumn("_row", F.concat_ws(":", "_row", "win_start"))
    found = C.region_score(windows, signal(spark, d), "count", width=WIDTH, column="value")
    return found.select(F.split("_row", ":")[0].cast("long").alias("rid"), "win_start", F.col("value").cast("long").alias("value"))


Q["relative_long"] = (
    relative_long,
    f"with {RG}, k as (select unnest([-50, 1]) as w), rw as (select rid, seq, w, case when st>=0 then s+w else e-w-49 end as s, case when st>=0 then s+w+49 else e-w end as e from r cross join k) select rw.rid, cast(w as bigint) as win_start, count(g.s) as value from (select rid, seq, w, greatest(s,1) as s, e from rw where e>=1) rw left join g on rw.seq=g.seq and rw.s<=g.e and g.s<=rw.e group by rw.rid, w",
)
BIN = f"""{RG}, o as (select rid, sc, r.e-r.s+1 as n, case when r.st>=0 then floor((g.s+g.e)/2.0)-r.s else r.e-floor((g.s+g.e)/2.0) end as o from r join g on r.seq=g.seq and greatest(r.s-20,1)<=g.e and g.s<=r.e+20), b as (select unnest(range(-2, 12)) as bin),
p as (select rid, bin, avg(sc) as value from o join b on o between round_even(bin*0.1*n+1, 0) and round_even((bin+1)*0.1*n, 0) group by all)"""


def binned(spark, d):
    found = C.binned_profile(regions(spark, d), signal(spark, d), bins=10, extra=2, width=WIDTH)
    return found.select(F.col("_row").alias("rid"), F.col("bin").cast("long").alias("bin"), r6("value").alias("value"))


Q["binned_profile"] = (binned, f"with {BIN} select rid, cast(bin as bigint) as bin, {r6_sql('value')} as value from p")
for how, x in {"mean": "avg(value)", "median": "quantile_cont(value, 0.5)"}.items():
    Q[f"profile_summary_{how}"] = (lambda s, d, h=how: C.profile_summary(relative(s, d), h).select("win_start", F.col("n").alias("n"), r6("value").alias("value")), f"with {REL} select win_start, count(value) as n, {r6_sql(x)} as value from p group by win_start")
Q["profile_summary_trimmean"] = (
    lambda s, d: C.profile_summary(relative(s, d), "trimmean").select("win_start", "n", r6("value").alias("value")),
    f"with {REL}, k as (select win_start, value, row_number() over (partition by win_start order by value) - 1 as i, count(*) over (partition by win_start) as n from p), t as (select *, cast(round_even(n/100.0, 0) as bigint) as x from k) select win_start, max(n) as n, {r6_sql('case when max(n)<100 then avg(value) else sum(case when i between x and n-x then value end)/(max(n)-2*max(x)) end')} as value from t group by win_start",
)


def wide(spark, d):
    found = C.wide_profile(regions(spark, d), relative(spark, d, "count"), [-100, -75, -50, -25, 1, 26, 51, 76], empty=0)
    names = [c for c in found.columns if c.startswith("w_")]
    return found.select(F.col("_row").alias("rid"), *[F.col(c).cast("long").alias(c) for c in names])


Q["profile_matrix"] = (wide, f"with {REL}, c as (select rid, win_start, count(*) as v from w group by all) select r.rid, " + ", ".join(f"coalesce(cast(max(case when win_start={w} then v end) as bigint),0) as w_{str(w).replace('-', 'm')}" for w in (-100, -75, -50, -25, 1, 26, 51, 76)) + " from r left join c using (rid) group by r.rid")

# ---- intersections -------------------------------------------------------------------------------


def best(kind: str):
    def run(spark, d):
        found = R.best_overlap(regions(spark, d), signal(spark, d), width=WIDTH, kind=kind)
        return found.select(F.col("_row").alias("rid"), "n_targets", "target", F.col("target_strand").cast("double").alias("target_strand"), F.col("distance").cast("double").alias("distance"), F.col("overlap").cast("long").alias("overlap"))

    return run


DIST = {"start": "((case when g.st>=0 then g.s else g.e end)-(case when r.st>=0 then r.s else r.e end))*(case when r.st>=0 then 1 else -1 end)", "mid": "cast(floor((g.s+g.e)/2.0-(r.s+r.e)/2.0+0.5) as bigint)"}
for kind, x in DIST.items():
    Q[f"intersect_{'best' if kind == 'start' else 'distance_mid'}"] = (
        best(kind),
        f"with {RG}, j as (select rid, nm, g.st, {x} as dist, least(r.e,g.e)-greatest(r.s,g.s)+1 as ov, g.s as gs from r join g on {MEET}), k as (select *, row_number() over (partition by rid order by ov desc, gs, nm, st, dist) as n, count(*) over (partition by rid) as t from j) select r.rid, coalesce(t,0) as n_targets, nm as target, cast(k.st as double) as target_strand, cast(dist as double) as distance, coalesce(ov,0) as overlap from r left join k on r.rid=k.rid and n=1",
    )


def classes(spark, d):
    found = R.best_overlap(regions(spark, d), signal(spark, d), width=WIDTH)
    kind = F.when(F.col("n_targets") == 0, "none").when(F.col("n_targets") == 1, "one").otherwise("multiple")
    return found.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


Q["intersect_summary"] = (classes, f"with {RG}, c as (select r.rid, count(g.s) as n from r left join g on {MEET} group by r.rid) select case when n=0 then 'none' when n=1 then 'one' else 'multiple' end as kind, count(*) as n from c group by 1")
Q["exclusion_antijoin"] = (
    lambda s, d: R.exclude_overlapping(regions(s, d), blacklist(s, d), width=WIDTH).select(F.col("_row").alias("rid")),
    f"with {RG}, {BLACK} select rid from r where not exists (select 1 from x where x.seq=r.seq and x.s<=r.e and r.s<=x.e)",
)


def algebra(what: str):
    def run(spark, d):
        both = R.overlap_join(regions(spark, d), blacklist(spark, d), width=WIDTH)
        a0, a1, b0, b1 = (F.col(c) for c in ("start", "end", "r_start", "r_end"))
        if what == "subtract":
            both = both.withColumn("x", F.explode(R.subtract(a0, a1, b0, b1)))
        else:
            both = both.withColumn("x", {"intersection": R.intersection, "union": R.union}[what](a0, a1, b0, b1))
        return both.select(F.col("_row").alias("rid"), F.col("r_name").alias("other"), F.col("x.start").alias("s"), F.col("x.end").alias("e"))

    return run


XJ = f"{RG}, x as (select cast(p_partkey as varchar) as nm, 'O' as seq, p_partkey*500 as s, p_partkey*500+p_size as e from part), j as (select rid, nm, r.s as a, r.e as b, x.s as c, x.e as d from r join x on r.seq=x.seq and r.s<=x.e and x.s<=r.e)"
Q["range_algebra_intersection"] = (algebra("intersection"), f"with {XJ} select rid, nm as other, greatest(a,c) as s, least(b,d) as e from j")
Q["range_algebra_union"] = (algebra("union"), f"with {XJ} select rid, nm as other, least(a,c) as s, greatest(b,d) as e from j")
Q["range_algebra_subtract"] = (algebra("subtract"), f"with {XJ} select rid, nm as other, a as s, c-1 as e from j where a<=c-1 union all select rid, nm, d+1, b from j where d+1<=b")
Q["interval_islands"] = (
    lambda s, d: R.islands(signal(s, d), ["seq_id"], region=10_000).select("seq_id", "start", F.col("end"), "n"),
    f"with {RG}, a as (select seq, s, e, case when s > coalesce(max(e) over (partition by seq order by s, e rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as o from g), b as (select *, sum(o) over (partition by seq order by s, e, o desc rows between unbounded preceding and current row) as k from a) select seq as seq_id, min(s) as start, max(e) as \"end\", count(*) as n from b group by seq, k",
)

# ---- counts --------------------------------------------------------------------------------------


def counted(spark, d):
    return C.region_score(regions(spark, d), signal(spark, d), "count", width=WIDTH)


CNT = f"{RG}, c as (select r.rid, r.e-r.s+1 as n, count(g.s) as k from r left join g on {MEET} group by all)"
Q["fpkm"] = (lambda s, d: C.fpkm(counted(s, d)).select(F.col("_row").alias("rid"), r6("fpkm").alias("fpkm")), f"with {CNT} select rid, {r6_sql('k*1e9/(n*(select sum(k) from c))')} as fpkm from c")
Q["tpm"] = (lambda s, d: C.tpm(counted(s, d)).select(F.col("_row").alias("rid"), r6("tpm").alias("tpm")), f"with {CNT} select rid, {r6_sql('(k/(n/1000.0))/((select sum(k/(n/1000.0)) from c)/1e6)')} as tpm from c")
Q["discard_low"] = (lambda s, d: C.discard_low(counted(s, d), ["count"], 8).select(F.col("_row").alias("rid"), F.col("count").alias("n_scores")), f"with {CNT} select rid, k as n_scores from c where k>=8")

# ---- by base and by read -------------------------------------------------------------------------

OV = "(least(r.e,g.e)-greatest(r.s,g.s)+1)"
for how, x in {"mean": f"sum({OV}*sc)/sum({OV})", "sum": f"coalesce(sum({OV}*sc),0)", "max": "max(sc)"}.items():
    Q[f"weighted_{how}"] = (
        lambda s, d, h=how: C.weighted_score(regions(s, d), signal(s, d), h, width=WIDTH).select(F.col("_row").alias("rid"), r6(h).alias("value")),
        f"with {RG} select r.rid, {r6_sql(x)} as value from r left join g on {MEET} group by r.rid",
    )
for how, x in {"count": "count(g.s)", "ncount": "count(distinct nm)"}.items():
    Q[f"alignment_{how}"] = (
        lambda s, d, h=how: C.alignment_count(regions(s, d), signal(s, d), method=h, width=WIDTH).select(F.col("_row").alias("rid"), F.col(h).alias("value")),
        f"with {RG} select r.rid, {x} as value from r left join g on {MEET} and (g.s between r.s and r.e or g.e between r.s and r.e) group by r.rid",
    )
Q["alignment_pcount"] = (
    lambda s, d: C.alignment_count(regions(s, d), signal(s, d), method="pcount", width=WIDTH).select(F.col("_row").alias("rid"), F.col("pcount").alias("value")),
    f"with {RG} select r.rid, count(g.s) as value from r left join g on {MEET} and g.s between r.s and r.e and g.e between r.s and r.e group by r.rid",
)


def span_of(rid, pairs):
    return [(rid, pairs["r_end"].max() - pairs["r_start"].min() + 1)]


Q["each_region"] = (
    lambda s, d: C.each_region(regions(s, d), signal(s, d), span_of, "rid long, value long", width=WIDTH, columns=["r_start", "r_end"]),
    f"with {RG} select rid, max(g.e)-min(g.s)+1 as value from r join g on {MEET} group by rid",
)
