import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import columns as K
from locusframe.operators import correlate as R
from locusframe.operators import genes as G
from locusframe.operators import merge as M
from locusframe.operators import methods
from locusframe.operators import pileup as P
from locusframe.operators import rows as W
from locusframe.streaming import intervals as S


@pytest.fixture(scope="module")
def level(spark):
    """Rows of two regions; in the first, test is 50 everywhere, in parts whose mean isn't exactly 50 once they are merged."""
    rng = random.Random(5)
    n = next(k for k in range(2, 200) if 50.0 / k * k != 50.0)
    part = lambda k: [(1, 7 * n * k + p, float(rng.randint(1, 999)), 50.0) for p in range(n)] + [(2, 7 * n * k + p, float(p), -float(p)) for p in range(n)]
    rows = spark.sparkContext.parallelize(range(4), 4).flatMap({k: part(k) for k in range(4)}.get)
    return spark.createDataFrame(rows, "_row long, pos long, ref double, test double")


def test_pearson_of_a_level_signal(level):
    assert {r["_row"]: r["r"] for r in R.pearson(level).collect()} == {1: None, 2: pytest.approx(-1)}


def test_shift_of_a_level_signal(spark):
    rng = random.Random(6)
    rows = [(k, p, float(rng.randint(1, 999)), 50.0) for k in range(30) for p in range(150 + k)] + [(99, p, float(p), float(p)) for p in range(40)]
    level = spark.createDataFrame(rows, "_row long, pos long, ref double, test double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small parts stay apart, as large ones do
    try:
        found = R.optimal_shift(level, 3, least=-2).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [(r["_row"], r["shift"]) for r in found] == [(99, 0)]


def test_summary_without_level_signals(level):
    found = R.summary(R.pearson(level)).first()
    assert (found["n"], found["mean"], found["median"]) == (1, pytest.approx(-1), pytest.approx(-1))


def test_depth_is_what_counting_gives(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), (lo := rng.randint(0, 90)), lo + rng.randint(0, 15)) for _ in range(60)]
    df = spark.createDataFrame(rows, "seq_id string, lo long, hi long")
    for region in (7, 1000):
        got = {}
        for r in P.depth_runs(df, region=region).collect():
            got |= {(r["seq_id"], k): r["value"] for k in range(r["lo"], r["hi"] + 1)}
        want = {}
        for s, lo, hi in rows:
            for k in range(lo, hi + 1):
                want[s, k] = want.get((s, k), 0) + 1
        assert got == want


def test_mates_and_their_bases(spark):
    schema = "qname string, seq_id string, pos long, end long, cigar string, flag int, isize int, nh int"
    rows = [("a", "c", 10, 20, "10M", 0x63, 40, 2), ("a", "c", 15, 50, "5M20N10M", 0x93, -40, 1), ("b", "c", 5, 9, "4M", 0x63, 40, 1)]
    pairs = P.mates(spark.createDataFrame(rows, schema))
    assert [(r["qname"], r["nh"]) for r in pairs.collect()] == [("a", 1)]
    assert sorted((r["start"], r["end"]) for r in P.smart_pairs(pairs).collect()) == [(10, 19), (40, 49)]


def test_split_pieces(spark):
    df = spark.createDataFrame([(0, "a_b_c"), (1, "x_"), (2, None)], "_row long, c string")
    assert [tuple(r)[2:] for r in K.split(df, "c", "_").orderBy("_row").collect()] == [("a", "b", "c"), ("x", None, None), (None, None, None)]


@pytest.mark.parametrize("adaptive", [True, False])
def test_numbers_go_on_over_partitions(spark, adaptive):
    """Exactly 1 to n and every row, whatever partitions the sort makes."""
    rows, old = 300_000, {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", str(adaptive).lower())
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.range(rows).select((F.col("id") * 7919 % rows).alias("k"), F.expr("repeat(cast(id as string), 20)").alias("wide"), (F.col("id") % 3).alias("c"))
        found = K.number(df, ["k"], "n")
        assert found.filter("n <> k + 1").count() == 0 and found.agg(F.count("*"), F.count_distinct("n")).first() == (rows, rows)
        # one key has half of all rows
        hot = df.withColumn("g", F.when(F.col("k") % 2 == 0, "hot").when(F.col("k") % 7 > 0, (F.col("k") % 50).cast("string")))
        own = K.number_within(hot, "g", ["k"], "n")
        got = own.groupBy("g").agg(F.count("*").alias("rows"), F.count_distinct("n").alias("numbers"), F.max("n").alias("last"), F.min("n").alias("first"))
        assert got.filter("rows <> numbers or last <> rows or first <> 1").count() == 0 and got.agg(F.sum("rows")).first()[0] == rows
        assert got.filter("g is null").count() == 1
        ranks = K.percentile_rank(df, "c", "r").groupBy("c").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count("*").alias("n")).orderBy("c").collect()
        assert [(round(r["a"], 9), round(r["b"], 9), r["n"]) for r in ranks] == [(round((k + 1) / 3, 9),) * 2 + (rows // 3,) for k in range(3)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_sorts_by_several_keys(spark):
    df = spark.createDataFrame([("b", 5, 9), ("a", 5, 7), ("a", 5, 9), ("c", 1, 2), ("a", 1, 3)], "seq_id string, start long, end long")
    got = [tuple(r)[:3] for r in K.number(df, W.genomic_order(["b", "a"]), "n").orderBy("n").collect()]
    assert got == [("c", 1, 2), ("b", 5, 9), ("a", 1, 3), ("a", 5, 7), ("a", 5, 9)]


@pytest.mark.parametrize("region", [None, 7, 1000])
def test_islands_are_what_joining_gives(spark, region):
    from locusframe.operators.ranges import islands

    rng = random.Random(4)
    rows = [(rng.choice("ab"), (lo := rng.randint(0, 300)), lo + rng.randint(0, rng.choice((3, 60)))) for _ in range(120)]
    rows += rows[:20]
    for gap in (0, 3):
        want = []
        for s in "ab":
            for a, b in sorted((a, b) for q, a, b in rows if q == s):
                if want and want[-1][0] == s and a <= want[-1][2] + gap:
                    want[-1][2:] = [max(want[-1][2], b), want[-1][3] + 1]
                else:
                    want.append([s, a, b, 1])
        df = spark.createDataFrame(rows, "seq_id string, start long, end long")
        assert sorted(list(r) for r in islands(df, ["seq_id"], gap, region=region).collect()) == want


def test_trimmed_mean_of_ties(spark):
    from locusframe.operators.collect import profile_summary

    rng = random.Random(6)
    values = [float(rng.choice((1, 1, 1, 2, 5, 40))) for _ in range(730)]
    a, n = sorted(values), len(values)
    x = round(n / 100)
    df = spark.createDataFrame([(3, v) for v in values] + [(9, 4.0), (9, None)], "win_start int, value double")
    got = {r["win_start"]: (r["n"], r["value"]) for r in profile_summary(df, "trimmean").collect()}
    assert got[3][0] == n and abs(got[3][1] - sum(a[x : n - x + 1]) / (n - 2 * x)) < 1e-9 and got[9] == (1, 4.0)


def test_wig_blocks_go_on_over_regions(spark):
    from locusframe.sources.sinks import wig_lines

    rows = [("a", s, 1.5) for s in (1, 11, 21, 41, 51, 2_000_001)] + [("b", 10, 2.0)]
    df = spark.createDataFrame(rows, "seq_id string, start long, score double")
    for region in (15, 1_000_000):
        got = [r["line"] for r in wig_lines(df, "fixed", 10, region=region).filter("part = 0").orderBy("seq_id", "start").collect()]
        assert [x.split("start=")[1].split()[0] for x in got] == ["1", "41", "2000001", "10"]


def test_slop_keeps_neighbours_of_those_gone(spark):
    df = spark.createDataFrame([("g", "c", 1, s, s) for s in (10, 13, 16, 40)], "gene_id string, seq_id string, strand int, start long, end long")
    assert sorted(r["start"] for r in G.unique_regions(df, slop=4).collect()) == [10, 16, 40]


def test_support_levels(spark):
    df = spark.createDataFrame([("t1", "g", "1"), ("t2", "g", "3"), ("t3", "h", "NA"), ("t4", "h", "2 (x)")], "transcript_id string, gene_id string, tsl string")
    ids = lambda level: sorted(r["transcript_id"] for r in G.best_support(df, level).collect())
    assert ids("best") == ["t1", "t4"] and ids("best2") == ["t1", "t4"] and ids("3") == ["t2"] and ids("NA") == ["t3"]


def test_methods_refuse_what_is_gone():
    with pytest.raises(ValueError):
        methods.reduce("rpm", F.lit(1), F.lit(True), F.lit("a"))


def test_anova_probability(spark):
    tests = spark.createDataFrame([(1, 4.0, 10), (2, 0.0, 5), (3, None, 5)], "_row long, f double, df long")
    p = {r["_row"]: r["p"] for r in R.p_values(tests).collect()}
    assert abs(10 ** -p[1] - 0.07338803) < 1e-6 and p[2] == 0 and (p[3] is None or p[3] != p[3])


def test_lookup_columns():
    assert M.lookup_column(["x", "Gene_ID", "Name"]) == "Name"
    assert M.new_columns(["Name", "a"], ["Name", "A", "Score", "b"], "Name", "t") == {"Score": "t_Score", "b": "b"}


def test_missing_feature_is_an_error(spark):
    df, f = spark.createDataFrame([("a",), ("b",)], "Primary_ID string"), spark.createDataFrame([("a", 1)], "Primary_ID string, v int")
    with pytest.raises(Exception, match="no feature for b"):
        M.attach(df, f).collect()


def test_union_needs_as_many_columns(spark):
    with pytest.raises(ValueError):
        W.concatenate(spark.range(1), spark.range(1).withColumn("x", F.lit(1)))


def test_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k:02d}:00", "a") for k in range(0, 40, 10)]
    df = spark.createDataFrame(rows, "event_id long, t string, kind string").select("event_id", F.col("t").cast("timestamp").alias("ts"), "kind")
    df.write.parquet(str(tmp_path / "in"))
    stream = S.files(spark, str(tmp_path / "in"), df.schema)
    S.write(S.tumbling(stream, "15 minutes", ["kind"], [F.count("*").alias("n")]), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((str(r["start"]), r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [("2024-01-01 00:00:00", 2), ("2024-01-01 00:15:00", 1)]
    assert S.tumbling(df, "20 minutes", ["kind"], [F.count("*").alias("n")], "10 minutes").count() == 5
