"""Queries on columns and rows of tables, merges, text and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import collect as C
from ..operators import columns as K
from ..operators import merge as M
from ..operators import rows as W
from ..sources import sinks as S
from .data import RG, alignments, r6, r6_sql, read, regions, shared_folder, signal

Q: dict[str, tuple] = {}


def part(spark, d):
    """part with text columns that hold nulls, dots and odd numbers."""
    t = read(spark, d, "part")
    k = F.col("p_partkey")
    odd = F.when(k % 10 == 0, ".").when(k % 10 == 1, "n/a").when(k % 10 == 2, None).when(k % 10 == 3, "1d").when(k % 10 == 4, "1e2").otherwise(F.col("p_size").cast("string"))
    return t.withColumns({"odd": odd, "half": F.when(k % 3 != 0, F.col("p_size") - 25), "price": F.col("p_retailprice")})


PART = """p as (select *, case p_partkey%10 when 0 then '.' when 1 then 'n/a' when 2 then null when 3 then '1d' when 4 then '1e2' else cast(p_size as varchar) end as odd,
case when p_partkey%3<>0 then p_size-25 end as half, p_retailprice as price, case when p_partkey%10<4 then null when p_partkey%10=4 then 100.0 else cast(p_size as double) end as num from part)"""


def key():
    return F.col("p_partkey").alias("id")


def one(build, sql: str):
    """A query of one computed column v beside the part's key."""
    return (lambda s, d: build(part(s, d)).select(key(), "v"), f"with {PART} select p_partkey as id, {sql} as v from p")


def column(c, sql: str):
    return one(lambda t: t.withColumn("v", c()), sql)


Q["absolute"] = column(lambda: V.absolute("half"), "cast(abs(half) as double)")
Q["minimum"] = column(lambda: V.minimum("odd", 10), "case when num<10 then 10.0 else num end")
Q["maximum"] = column(lambda: V.maximum("odd", 30), "case when num>30 then 30.0 else num end")
Q["log2"] = column(lambda: r6(V.log("half", 2)), r6_sql("case when half>0 then ln(half)/ln(2.0) end"))
Q["log10"] = column(lambda: r6(V.log("price", 10)), r6_sql("case when price>0 then ln(price)/ln(10.0) end"))
Q["delog"] = column(lambda: r6(V.delog(F.col("p_size") / 10)), r6_sql("pow(2.0, p_size/10.0)"))
Q["format"] = column(lambda: V.fixed(F.col("p_size") / 2, 0), "cast(cast(round_even(p_size/2.0, 0) as bigint) as varchar)")
Q["format_decimals"] = column(lambda: V.fixed(F.col("p_size") / 4, 2), "printf('%.2f', p_size/4.0)")
Q["is_number"] = column(lambda: V.num("odd"), "num")
Q["is_null"] = column(lambda: V.is_null("odd"), "odd is null or odd in ('.', 'n/a')")
Q["cnull"] = column(lambda: V.convert_null("odd", "0"), "case when odd is null or odd in ('.', 'n/a') then '0' else odd end")
Q["cnull_zeros"] = column(lambda: V.convert_null(F.col("p_size") % 5, -1, True).cast("long"), "cast(case when p_size%5=0 then -1 else p_size%5 end as bigint)")
Q["ratio"] = column(lambda: r6(V.ratio("price", "half")), r6_sql("case when half<>0 then price/half end"))
Q["log_ratio"] = column(lambda: r6(V.ratio("price", "half", True)), r6_sql("price-half"))
Q["difference"] = column(lambda: V.difference("odd", "p_size"), "num-p_size")
Q["concat"] = one(lambda t: t.withColumn("v", K.concatenate(["p_brand", "odd", "p_type"])), "p_brand || '_' || case when odd is null or odd in ('.', 'n/a') then '.' else odd end || '_' || p_type")
Q["coordinate"] = column(lambda: V.coordinate("p_brand", "p_partkey", "p_size"), "p_brand || ':' || p_partkey || '-' || p_size")
Q["parse_coordinate"] = column(lambda: F.concat_ws("/", *[V.parse_coordinate(F.concat("p_brand", F.lit(":1,000.."), (F.col("p_size") + 1000).cast("string"), F.lit(":-")))[x].cast("string") for x in ("seq_id", "start", "end", "strand")]), "p_brand || '/1000/' || (p_size+1000) || '/-1'")
Q["new"] = column(lambda: F.lit("."), "'.'")
Q["with_commas"] = column(lambda: V.with_commas(F.col("p_partkey") * 12345 - 1000000), "case when p_partkey*12345-1000000<0 then '-' else '' end || format('{:,}', abs(p_partkey*12345-1000000))")
Q["strand"] = column(lambda: V.strand(F.element_at(F.array(*[F.lit(x) for x in ("+", "-", ".", "1", "-1", "2", "*")]), (F.col("p_partkey") % 7 + 1).cast("int"))), "cast(case p_partkey%7 when 0 then 1 when 1 then -1 when 3 then 1 when 4 then -1 when 5 then -1 else 0 end as integer)")
for how, x in {"mean": "avg(v)", "median": "quantile_cont(v,0.5)", "min": "min(v)", "max": "max(v)", "sum": "coalesce(sum(v),0)", "stdev": "stddev_pop(v)"}.items():
    Q[f"combine_{how}"] = (
        lambda s, d, h=how: part(s, d).select(key(), r6(K.combine(["odd", "half", "p_size"], h)).alias("v")),
        f"with {PART}, u as (select p_partkey, unnest([num, cast(half as double), cast(p_size as double)]) as v from p) select p_partkey as id, {r6_sql(x)} as v from u group by p_partkey",
    )
for sign, x in {"add": "price+m", "subtract": "price-m", "multiply": "price*m", "divide": "price/m"}.items():
    Q[f"math_{sign}"] = (lambda s, d, o=sign: K.math(part(s, d), "price", o, "mean", "v").select(key(), r6("v").alias("v")), f"with {PART}, t as (select avg(price) as m from p) select p_partkey as id, {r6_sql(x)} as v from p, t")
Q["math_number"] = (lambda s, d: K.math(part(s, d), "price", "divide", 4, "v").select(key(), "v"), f"with {PART} select p_partkey as id, price/4.0 as v from p")
Q["percentile_rank"] = (lambda s, d: K.percentile_rank(part(s, d), "half", "v").select(key(), r6("v").alias("v")), f"with {PART}, k as (select p_partkey, cume_dist() over (order by half) as v from p where half is not null) select p.p_partkey as id, {r6_sql('v')} as v from p left join k using (p_partkey)")
Q["zscore"] = (lambda s, d: K.zscore(part(s, d), "price", "v").select(key(), r6("v").alias("v")), f"with {PART}, t as (select avg(price) as m, stddev_pop(price) as q from p) select p_partkey as id, {r6_sql('(price-m)/q')} as v from p, t")
Q["median_scale"] = (lambda s, d: K.median_scale(part(s, d), "half", 100, "v").select(key(), r6("v").alias("v")), f"with {PART}, t as (select quantile_cont(cast(half as double),0.5) as m from p where half<>0) select p_partkey as id, {r6_sql('half*(100.0/m)')} as v from p, t")
Q["row_center"] = (
    lambda s, d: K.row_center(part(s, d).withColumn("third", F.col("p_partkey") % 17), ["half", "p_size", "third"]).select(key(), r6("half").alias("a"), r6("p_size").alias("b"), r6("third").alias("c")),
    f"with {PART}, u as (select p_partkey, unnest([cast(half as double), cast(p_size as double), cast(p_partkey%17 as double)]) as v from p), m as (select p_partkey, quantile_cont(v,0.5) as m from u group by p_partkey) select p_partkey as id, {r6_sql('half-m')} as a, {r6_sql('p_size-m')} as b, {r6_sql('p_partkey%17-m')} as c from p join m using (p_partkey)",
)


def stats(spark, d):
    found = K.statistics(part(spark, d), ["odd", "half", "price"])
    return found.select("column", F.col("count"), *[r6(c).alias(c) for c in ("mean", "median", "stddev", "min", "max", "sum", "mode")])


STATS = ", ".join(f"{r6_sql(x)} as {n}" for n, x in (("mean", "avg(v)"), ("median", "quantile_cont(v,0.5)"), ("stddev", "stddev_pop(v)"), ("min", "min(v)"), ("max", "max(v)"), ("sum", "sum(v)")))
Q["column_stats"] = (stats, f"with {PART}, u as (select 'odd' as c, num as v from p union all select 'half', half from p union all select 'price', price from p), n as (select c, v, count(*) as k from u where v is not null group by all), m as (select c, v as mode, row_number() over (partition by c order by k desc, v) as i from n) select u.c as \"column\", count(v) as count, {STATS}, {r6_sql('max(mode)')} as mode from u join m on u.c=m.c and i=1 group by u.c")
Q["length_stats"] = (
    lambda s, d: K.statistics(part(s, d).withColumn("length", F.col("p_size") + 10), ["length"]).select(F.col("count"), r6("mean").alias("mean"), r6("median").alias("median"), r6("mode").alias("mode")),
    f"select count(*) as count, {r6_sql('avg(p_size+10)')} as mean, {r6_sql('quantile_cont(p_size+10.0,0.5)')} as median, {r6_sql('(select p_size+10 from part group by p_size order by count(*) desc, p_size limit 1)')} as mode from part",
)


def matrix(spark, d):
    t = read(spark, d, "part")
    k, v = F.col("p_partkey"), F.col("p_size")
    return t.select(key(), v.cast("double").alias("c1"), F.when(k % 2 == 0, v * 2.0).alias("c2"), F.when(k % 3 == 0, v * 3.0).alias("c3"), F.when(k % 5 != 0, v * 5.0).alias("c4"), F.when(k % 7 != 0, v * 1.0).alias("c5"))


MATRIX = "m as (select p_partkey as id, unnest(range(1,6)) as i, unnest([cast(p_size as double), case when p_partkey%2=0 then p_size*2.0 end, case when p_partkey%3=0 then p_size*3.0 end, case when p_partkey%5<>0 then p_size*5.0 end, case when p_partkey%7<>0 then p_size*1.0 end]) as v from part)"
Q["interpolate"] = (
    lambda s, d: (lambda t: t.select("id", *C.interpolate(["c1", "c2", "c3", "c4", "c5"])).select("id", *[r6(f"c{k}").alias(f"c{k}") for k in range(1, 6)]))(matrix(s, d)),
    f"with {MATRIX}, n as (select *, last_value(case when v is not null then i end ignore nulls) over w1 as a, first_value(case when v is not null then i end ignore nulls) over w2 as b, last_value(v ignore nulls) over w1 as va, first_value(v ignore nulls) over w2 as vb from m window w1 as (partition by id order by i rows between unbounded preceding and 1 preceding), w2 as (partition by id order by i rows between 1 following and unbounded following)), f as (select id, i, coalesce(v, case when i not in (1,5) then va+(vb-va)/(b-a)*(i-a) end) as v from n) select id, " + ", ".join(f"{r6_sql(f'max(case when i={k} then v end)')} as c{k}" for k in range(1, 6)) + " from f group by id",
)

# ---- structure of columns ------------------------------------------------------------------------

Q["split"] = (
    lambda s, d: K.split(read(s, d, "part").select(key(), "p_name"), "p_name", "[ _#]", 3),
    "select p_partkey as id, p_name, " + ", ".join(f"nullif(regexp_split_to_array(p_name, '[ _#]')[{k}], '') as p_name_{k}" for k in (1, 2, 3)) + " from part",
)
Q["number"] = (lambda s, d: K.number(read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").distinct(), ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"], "n").select("l_orderkey", "l_partkey", "n"), "select l_orderkey, l_partkey, row_number() over (order by l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) as n from (select distinct l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice from lineitem)")
Q["addname"] = (lambda s, d: K.unique_names(read(s, d, "orders"), ["o_orderkey"], "S_").select("o_orderkey", "Name"), "select o_orderkey, 'S_' || row_number() over (order by o_orderkey) as Name from orders")
Q["reorder"] = (lambda s, d: K.reorder(read(s, d, "nation"), ["n_name", "n_nationkey", "n_name"]), "select n_name, n_nationkey, n_name as n_name_2 from nation")
Q["delete"] = (lambda s, d: read(s, d, "nation").drop("n_name"), "select n_nationkey, n_regionkey from nation")
Q["rename"] = (lambda s, d: K.rename(read(s, d, "nation"), {"n_name": "label"}), "select n_nationkey, n_name as label, n_regionkey from nation")
Q["copy_column"] = (lambda s, d: read(s, d, "nation").withColumn("again", F.col("n_name")), "select *, n_name as again from nation")
Q["add_values"] = (lambda s, d: K.add_values(read(s, d, "nation").withColumnRenamed("n_nationkey", "_row"), "x", read(s, d, "nation").select(F.col("n_nationkey").alias("_row"), (F.col("n_regionkey") * 2).alias("x"))), "select n_nationkey as _row, n_name, n_regionkey, n_regionkey*2 as x from nation")

# ---- rows ----------------------------------------------------------------------------------------

pick = lambda f: lambda s, d: f(part(s, d)).select(key())
Q["toss_null"] = (pick(lambda t: W.toss_null(t, ["odd", "half"])), f"with {PART} select p_partkey as id from p where not (odd is null or odd in ('.','n/a') or half is null)")
Q["toss_null_zeros"] = (pick(lambda t: W.toss_null(t, ["half"], True)), f"with {PART} select p_partkey as id from p where half is not null and half<>0")
Q["toss_duplicate"] = (pick(lambda t: W.toss_duplicates(t, ["p_brand", "p_size"], ["p_partkey"])), "select min(p_partkey) as id from part group by p_brand, p_size")
Q["above"] = (pick(lambda t: W.toss_above(t, ["odd", "half"], 20)), f"with {PART} select p_partkey as id from p where not (coalesce(num>20,false) or coalesce(half>20,false))")
Q["below"] = (pick(lambda t: W.toss_below(t, ["odd", "half"], 5)), f"with {PART} select p_partkey as id from p where not (coalesce(num<5,false) or coalesce(half<5,false))")
Q["specific"] = (pick(lambda t: W.toss_values(t, ["p_brand"], ["Brand#1", "Brand#2", "Brand#11"])), "select p_partkey as id from part where not p_brand in ('Brand#1','Brand#2','Brand#11')")
Q["keep"] = (pick(lambda t: W.keep_values(t, ["odd"], ["1d", "."])), f"with {PART} select p_partkey as id from p where odd in ('1d','.')")
Q["drop_rows"] = (pick(lambda t: W.drop_rows(t, [1, 2, 3], "p_partkey")), "select p_partkey as id from part where p_partkey not in (1,2,3)")
Q["length_filter"] = (lambda s, d: W.by_length(read(s, d, "part").withColumns({"start": F.col("p_partkey"), "end": F.col("p_partkey") + F.col("p_size") - 1}), 10, 20).select(key()), "select p_partkey as id from part where p_size between 10 and 20")
Q["skip_sequences"] = (lambda s, d: W.skip_sequences(regions(s, d), "^[FX]").select(F.col("_row").alias("rid")), f"with {RG} select rid from r where not regexp_matches(seq, '^[FX]')")
Q["sort_value"] = (
    lambda s, d: K.number(part(s, d).select(key(), "odd"), [*W.value_order("odd"), F.col("id").asc()], "n").select("id", "n"),
    f"with {PART} select p_partkey as id, row_number() over (order by num is null, num, try_cast(nullif(regexp_extract(odd,'^([0-9]+)',1),'') as bigint) nulls last, regexp_extract(odd,'^[0-9]*([^0-9]*)',1) nulls last, odd nulls last, p_partkey) as n from p",
)
Q["gsort"] = (lambda s, d: K.number(regions(s, d), W.genomic_order(["F", "O", "P"]), "n").select(F.col("_row").alias("rid"), "n"), f"with {RG} select rid, row_number() over (order by seq, s, e) as n from r")
Q["unique_names"] = (lambda s, d: W.numbered_names(read(s, d, "part").select(key(), "p_brand"), "p_brand", ["id"]), "with n as (select p_partkey as id, p_brand, row_number() over (partition by p_brand order by p_partkey)-1 as k from part) select id, case when k=0 then p_brand else p_brand || '.' || k end as p_brand from n")
Q["split_parts"] = (lambda s, d: W.split_parts(read(s, d, "part").select(key(), "p_brand"), "p_brand", ["id"], 7).groupBy("p_brand", "part").agg(F.count("*").alias("n")), "with n as (select p_brand, ceil(row_number() over (partition by p_brand order by p_partkey)/7.0) as part from part) select p_brand, cast(part as integer) as part, count(*) as n from n group by all")
Q["split_rows"] = (lambda s, d: W.split_rows(K.number(read(s, d, "part"), ["p_partkey"], "_row"), 3).groupBy("part").agg(F.count("*").alias("n")), "with n as (select row_number() over (order by p_partkey) as k, count(*) over () as t from part) select cast(least((k-1)//(t//3)+1, 3) as integer) as part, count(*) as n from n group by 1")
Q["split_stats"] = (lambda s, d: read(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")), "select p_brand, count(*) as n from part group by p_brand")
Q["join_rows"] = (lambda s, d: W.concatenate(read(s, d, "nation").select("n_nationkey", "n_name"), read(s, d, "region").select("r_regionkey", "r_name")), "select n_nationkey, n_name from nation union all select r_regionkey, r_name from region")
Q["flag_filter"] = (lambda s, d: (lambda t: W.by_flags(t, 0x400, 16).select("qname", "pos"))(alignments(s, d)), "select cast(l_partkey as varchar) as qname, l_orderkey*10+l_linenumber-1 as pos from lineitem where l_linenumber%2=1 and l_linenumber*8>=16")
Q["attribute_filter"] = (
    lambda s, d: W.by_attribute(read(s, d, "part").withColumn("attributes", F.create_map(F.lit("brand"), "p_brand")), "brand", "BRAND#1").select(key()),
    "select p_partkey as id from part where regexp_matches(p_brand, '(?i)BRAND#1')",
)

# ---- merges --------------------------------------------------------------------------------------

Q["merge_lookup"] = (lambda s, d: M.merge_lookup(read(s, d, "customer").select("c_custkey", "c_nationkey"), read(s, d, "nation").filter("n_nationkey % 4 <> 0"), "c_nationkey", "n_nationkey", ["n_name"], ["n_nationkey"]), "select c_custkey, c_nationkey, n_name from customer left join nation on c_nationkey=n_nationkey and n_nationkey%4<>0")
Q["merge_first_match"] = (
    lambda s, d: M.merge_lookup(read(s, d, "nation"), read(s, d, "supplier"), "n_nationkey", "s_nationkey", ["s_name", "s_acctbal"], ["s_suppkey"]),
    "with f as (select *, row_number() over (partition by s_nationkey order by s_suppkey) as k from supplier) select n_nationkey, n_name, n_regionkey, s_name, s_acctbal from nation left join f on n_nationkey=s_nationkey and k=1",
)


def by_coordinate(spark, d):
    left = read(spark, d, "part").select(key(), F.col("p_brand").alias("seq_id"), (F.col("p_size") + F.col("p_partkey") % 2).cast("long").alias("start"))
    right = read(spark, d, "part").select(F.col("p_partkey").alias("at"), F.col("p_brand").alias("seq_id"), F.col("p_size").cast("long").alias("start"), "p_name")
    return M.merge_coordinate(left, right, ["p_name"], ["at"]).select("id", "p_name")


Q["merge_coordinate"] = (by_coordinate, "with l as (select p_partkey as id, p_brand as seq, p_size+p_partkey%2 as s from part), f as (select p_brand as seq, p_size as s, p_name, row_number() over (partition by p_brand, p_size order by p_partkey) as k from part), g as (select * from f where k=1) select id, coalesce(a.p_name, b.p_name) as p_name from l left join g a on a.seq=l.seq and a.s=l.s left join g b on b.seq=l.seq and b.s=l.s-1")
Q["merge_positional"] = (lambda s, d: M.merge_positional(K.number(read(s, d, "region"), ["r_regionkey"], "_row"), K.number(read(s, d, "nation").filter("n_nationkey < 5"), ["n_nationkey"], "_row")), "select row_number() over (order by r_regionkey) as _row, r_regionkey, r_name, n_nationkey, n_name, n_regionkey from region join (select *, row_number() over (order by n_nationkey) as k from nation where n_nationkey<5) n on n.k=r_regionkey+1")
Q["merge_nway"] = (
    lambda s, d: M.merge_all([read(s, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), read(s, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_name"), read(s, d, "customer").select(F.col("c_nationkey").alias("k"), "c_name")], "k", [[], ["s_name"], ["c_name"]]),
    "select n_nationkey as k, n_name, s_name, c_name from nation left join (select s_nationkey, min(s_name) as s_name from supplier group by 1) on s_nationkey=n_nationkey left join (select c_nationkey, min(c_name) as c_name from customer group by 1) on c_nationkey=n_nationkey",
)


def wanted(spark, d):
    t = read(spark, d, "part").filter("p_size < 10").select(F.col("p_size").alias("k"), F.col("p_partkey").alias("_pos"), F.col("p_brand").alias("grp"))
    return t


Q["pull_list_order"] = (lambda s, d: M.pull(read(s, d, "nation"), wanted(s, d), "n_nationkey", "k").select("n_nationkey", "n_name", F.col("_pos").alias("pos")), "select n_nationkey, n_name, p_partkey as pos from nation join part on n_nationkey=p_size where p_size<10")
Q["pull_data_order"] = (lambda s, d: M.pull(read(s, d, "nation"), wanted(s, d), "n_nationkey", "k", "data"), "select * from nation where n_nationkey in (select p_size from part where p_size<10)")
Q["pull_groups"] = (lambda s, d: M.pull_groups(read(s, d, "nation"), wanted(s, d), "n_nationkey", "k", "grp").select("n_nationkey", "grp"), "with w as (select p_size, p_brand, row_number() over (partition by p_size order by p_partkey desc) as k from part where p_size<10) select n_nationkey, p_brand as grp from nation join w on n_nationkey=p_size and k=1")
Q["attach_features"] = (lambda s, d: M.attach(read(s, d, "customer").select(F.col("c_nationkey").alias("Primary_ID"), "c_name"), read(s, d, "nation").select(F.col("n_nationkey").alias("Primary_ID"), "n_name")).select("c_name", "n_name"), "select c_name, n_name from customer join nation on c_nationkey=n_nationkey")

# ---- text ----------------------------------------------------------------------------------------

Q["revcomp"] = (lambda s, d: read(s, d, "documents").select("doc_id", V.reverse_complement(F.translate("text", "\n", " ")).alias("v")), "select doc_id, reverse(translate(translate(text, chr(10), ' '), 'gatcGATC', 'ctagCTAG')) as v from documents where reverse('é') is not null")
Q["fasta_wrap"] = (lambda s, d: read(s, d, "part").select(key(), S.fasta_record("p_name", "p_type", 4).alias("v")), "select p_partkey as id, '>' || p_name || chr(10) || regexp_replace(regexp_replace(p_type, '(.{4})', '\\1' || chr(10), 'g'), chr(10) || '$', '') as v from part")
Q["url_encode"] = (lambda s, d: read(s, d, "part").select(key(), V.url_encode(F.concat("p_type", F.lit("; a=1,2&3%"))).alias("v")), "select p_partkey as id, replace(p_type, ' ', '%20') || '%3B%20a%3D1%2C2%263%25' as v from part")
Q["url_decode"] = (lambda s, d: read(s, d, "part").select(key(), V.url_decode(F.concat(F.lit("%41+%3B"), "p_size")).alias("v")), "select p_partkey as id, 'A ;' || p_size as v from part")
Q["gff_attributes"] = (
    lambda s, d: read(s, d, "part").select(key(), V.write_attributes(V.attributes(F.concat(F.lit(" size="), "p_size", F.lit("; Name=n1 ;ID=x"), "p_partkey", F.lit(";;size="), F.col("p_size") + 1))).alias("v")),
    "select p_partkey as id, 'ID=x' || p_partkey || ';Name=n1;size=' || (p_size+1) as v from part",
)
Q["props_map"] = (
    lambda s, d: read(s, d, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(V.attributes(F.concat(F.lit("k"), F.col("event_id") % 3, F.lit("=1;z=2;k"), F.col("event_id") % 2, F.lit("=3"))))), ",").alias("v")),
    "select event_id, case when event_id%3=event_id%2 then 'k' || (event_id%2) || ',z' else 'k' || least(event_id%3, event_id%2) || ',k' || greatest(event_id%3, event_id%2) || ',z' end as v from events",
)
Q["bed6_string"] = (lambda s, d: regions(s, d).withColumn("score", F.col("_row") % 1000).select(S.bed_line(6).alias("line")), f"with {RG} select seq || chr(9) || (s-1) || chr(9) || e || chr(9) || 'r' || rid || chr(9) || rid%1000 || chr(9) || case when st<0 then '-' else '+' end as line from r")
Q["gff3_string"] = (
    lambda s, d: regions(s, d).withColumns({"source": F.lit("src"), "type": F.lit("region"), "score": F.lit(None).cast("string"), "phase": F.lit(None).cast("string"), "id": F.concat(F.lit("a;"), F.col("_row")), "parents": F.array(F.lit("p1"), F.lit("p,2")), "attributes": F.create_map(F.lit("note"), F.lit("x y"))}).select(S.gff3_line().alias("line")),
    f"with {RG} select concat_ws(chr(9), seq, 'src', 'region', s, e, '.', case when st<0 then '-' else '+' end, '.', 'ID=a%3B' || rid || ';Name=r' || rid || ';Parent=p1,p%2C2;note=x%20y') as line from r",
)
Q["bedgraph_string"] = (lambda s, d: regions(s, d).select(F.col("seq_id"), F.col("start").alias("lo"), F.col("end").alias("hi"), F.lit(3).alias("value")).select(S.bedgraph_line().alias("line")), f"with {RG} select concat_ws(chr(9), seq, s, e+1, 3) as line from r")
Q["wig_lines"] = (
    lambda s, d: S.wig_lines(regions(s, d).select("seq_id", "start", F.lit(1).alias("score")), "fixed", 10).groupBy("part").agg(F.count("*").alias("n")),
    f"with {RG}, l as (select case when s=lag(s) over (partition by seq order by s)+10 then 0 else 1 end as o from r) select cast(0 as integer) as part, cast(sum(o) as bigint) as n from l union all select 1, count(*) from l",
)
Q["same_position"] = (lambda s, d: S.combined(signal(s, d), "max").select("seq_id", "start", "end", "score"), f"with {RG} select seq as seq_id, s as start, max(e) as \"end\", max(sc) as score from g group by seq, s")


def written_bed(spark, d):
    """A BED file written and read again."""
    from ..sources.annotation import bed

    folder = shared_folder(spark) + "/x.bed"
    S.write_lines(regions(spark, d).withColumn("score", F.lit(5)).select(S.bed_line(6).alias("line")), folder)
    return bed(spark, folder).select("seq_id", "start", "end", "strand", "name")


Q["write_bed"] = (written_bed, f"with {RG} select seq as seq_id, s as start, e as \"end\", cast(st as integer) as strand, 'r' || rid as name from r")
