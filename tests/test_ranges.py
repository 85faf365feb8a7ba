import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import collect as C
from locusframe.operators import methods
from locusframe.operators import ranges as R

SCHEMA = "_row long, seq_id string, start long, end long, strand int, name string, score double"


def made(spark, n, seed, longest=300):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        s = rng.randint(1, 2000)
        rows.append((k, rng.choice(["chr1", "1", "2"]), s, s + rng.randint(0, longest), rng.choice([-1, 0, 1]), f"n{k % 20}", float(rng.randint(0, 9))))
    return spark.createDataFrame(rows, SCHEMA), rows


def meet(a, b):
    key = lambda s: s.removeprefix("chr")
    return key(a[1]) == key(b[1]) and a[2] <= b[3] and b[2] <= a[3]


@pytest.mark.parametrize("width", [1, 7, 64, 5000])
def test_bins_find_what_comparing_all_finds(spark, width):
    (a, x), (b, y) = made(spark, 60, 1), made(spark, 80, 2, 40)
    found = sorted((r["_row"], r["r__row"]) for r in R.overlap_join(a, b, width).collect())
    assert found == sorted((p[0], q[0]) for p in x for q in y if meet(p, q))


def test_strands(spark):
    (a, x), (b, y) = made(spark, 40, 3), made(spark, 40, 4)
    for within, ok in (("sense", lambda p, q: q[4] == 0 or p[4] == q[4]), ("antisense", lambda p, q: p[4] != q[4])):
        assert R.overlap_join(a, b, 64, within).count() == sum(meet(p, q) and ok(p, q) for p in x for q in y)
    with pytest.raises(ValueError):
        R.strand_rule("other")


def test_width_comes_from_the_lengths(spark):
    a, _ = made(spark, 50, 5)
    assert 64 <= R.bin_width(a) <= 1_000_000
    assert R.bin_width(a.limit(0)) == 64
    assert R.overlap_join(a, a).count() > 0


def test_islands_and_ties(spark):
    rows = [("c", 1, 5), ("c", 5, 9), ("c", 10, 12), ("c", 10, 12), ("d", 3, 4)]
    df = spark.createDataFrame(rows, "seq_id string, start long, end long")
    assert sorted(tuple(r) for r in R.islands(df, ["seq_id"]).collect()) == [("c", 1, 9, 2), ("c", 10, 12, 2), ("d", 3, 4, 1)]
    assert sorted(tuple(r) for r in R.islands(df, ["seq_id"], gap=1).collect()) == [("c", 1, 12, 4), ("d", 3, 4, 1)]


def test_genome_windows(spark):
    n = spark.createDataFrame([("chrI", 230208)], "seq_id string, length long")
    found = C.genome_windows(n).orderBy("start").collect()
    assert len(found) == 461 and (found[-1]["start"], found[-1]["end"]) == (230001, 230208)
    black = spark.createDataFrame([("chrI", 450, 620)], "seq_id string, start long, end long")
    assert C.genome_windows(n, 500, None, black).count() == 459


def test_window_starts(spark):
    df = spark.createDataFrame([(o,) for o in (-51, -50, -1, 0, 1, 50, 51)], "o long")
    assert [r[0] for r in df.select(C.window_start(F.col("o"), 50)).collect()] == [-100, -50, -50, None, 1, 1, 51]


def test_region_without_scores(spark):
    a, _ = made(spark, 1, 7)
    empty = a.limit(0)
    for method, value in (("mean", None), ("sum", 0), ("count", 0), ("max", None)):
        assert C.region_score(a, empty, method, width=64).first()[method] == value


def test_subfeatures_count_twice_but_names_once(spark):
    parts = spark.createDataFrame([("t", "c", 1, 10, 1), ("t", "c", 21, 30, 1)], "parent_id string, seq_id string, start long, end long, strand int")
    parents = spark.createDataFrame([("t",), ("u",)], "id string")
    signal = spark.createDataFrame([("c", 5, 25, 0, 2.0, "x")], "seq_id string, start long, end long, strand int, score double, name string")
    count = lambda m: {r["id"]: r[m] for r in C.subfeature_score(parts, parents, signal, m, width=64).collect()}
    assert count("count") == {"t": 2, "u": 0} and count("ncount") == {"t": 1, "u": 0}


def test_subfeatures_where_many_rows_have_one_place(spark):
    rng = random.Random(4)
    spans = [("c", a := rng.randint(1, 60), a + rng.randint(0, 9), rng.choice([-1, 0, 1])) for _ in range(8)]
    rows = [(*rng.choice(spans), rng.choice([None, 0.0, 1.5, 2.0, 7.0]), rng.choice("xyz")) for _ in range(200)]
    signal = spark.createDataFrame(rows, "seq_id string, start long, end long, strand int, score double, name string")
    parts = spark.createDataFrame([(f"t{k % 5}", "c", a := rng.randint(1, 60), a + rng.randint(0, 20), rng.choice([-1, 1])) for k in range(12)], "parent_id string, seq_id string, start long, end long, strand int")
    parents = spark.createDataFrame([(f"t{k}",) for k in range(6)], "id string")
    for strand in R.STRANDS:
        pairs = R.overlap_join(parts, signal, 64, strand).withColumnRenamed("parent_id", "id")
        inside = R.contains(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
        for m in methods.METHODS:
            want = parents.join(pairs.groupBy("id").agg(methods.reduce(m, F.col("r_score"), inside, F.col("r_name")).alias(m)), "id", "left").withColumn(m, methods.filled(m, F.col(m)))
            got = C.subfeature_score(parts, parents, signal, m, strand=strand, width=64)
            assert got.schema[m].dataType == want.schema[m].dataType
            assert {r["id"]: r[m] for r in got.collect()} == pytest.approx({r["id"]: r[m] for r in want.collect()}), m
    with pytest.raises(ValueError, match="method"):
        C.subfeature_score(parts, parents, signal, "rpm")
    # rows of one place meet the parts once
    merged, _ = C.merged_rows(signal, "count")
    assert merged.count() == len(set(r[:4] for r in rows))


def test_each_region_is_whole_where_batches_end(spark):
    (a, _), (b, _) = made(spark, 40, 9), made(spark, 40, 10)
    pairs = [(r["_row"], r["r_start"]) for r in R.overlap_join(a, b, 64).collect()]
    want = {k: sorted(s for j, s in pairs if j == k) for k, _ in pairs}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        starts = C.each_region(a, b, lambda k, p: [(k, s) for s in p["r_start"]], "id long, s long", width=64, columns=["r_start"])
        found = starts.collect()
        calls = C.each_region(a, b, lambda k, p: [(k, len(p["r_end"]))], "id long, n long", width=64).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: sorted(r["s"] for r in found if r["id"] == k) for k in want} == want and max(map(len, want.values())) > 3
    assert sorted((r["id"], r["n"]) for r in calls) == sorted((k, len(v)) for k, v in want.items())
    # regions go to Python many at a time
    assert "MapInArrow" in starts._jdf.queryExecution().executedPlan().toString()


def test_plan_is_an_equi_join(spark):
    a, _ = made(spark, 5, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.overlap_join(a, a, 64)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan
