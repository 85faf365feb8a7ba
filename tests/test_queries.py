"""Every query against its SQL on the smallest tables."""

import math
import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    show = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in entry.OWN.items() if sql))
def test_query_and_sql_agree(spark, db, name):
    found, wanted = entry.queries()[name](spark, DATA).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_shifts_among_level_regions_agree(spark, tmp_path):
    """As large tables have them: quantities of most orders are level, and parts of a region are merged from several tasks."""
    rng = random.Random(7)
    lines = [(k, p, float(rng.randint(1, 999)), float(rng.randint(1, 50) if k % 10 == 0 else k % 50)) for k in range(500) for p in range(40)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small parts stay apart, as large ones do
    try:
        found = entry.queries()["optimal_shift"](spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert set(found["_row"] % 10) == {0}
    assert rows(found) == rows(con.execute(entry.oracle_sql()["optimal_shift"]).df())


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """Overlapping regions and signals of a few orders, in a folder of their own."""
    from locusframe.plans import data

    top = str(tmp_path_factory.mktemp("few"))
    for t in ("orders", "lineitem"):
        key = "o_orderkey" if t == "orders" else "l_orderkey"
        spark.read.parquet(f"{DATA}/{t}.parquet").filter(f"{key} <= 120").write.parquet(f"{top}/{t}.parquet")
    own = [tuple(r) for r in data.regions(spark, top).select("_row", "seq_id", "start", "end").collect()]
    sig = [tuple(r) for r in data.signal(spark, top).select("seq_id", "start", "end", "score").collect()]
    return top, own, [(k, s, a, b, c, d, float(v)) for k, s, a, b in own for q, c, d, v in sig if q == s and c <= b and a <= d]


def test_bases_of_all_regions_are_scored(spark, few):
    top, _, pairs = few
    want = {}
    for k, _, a, b, c, d, v in pairs:
        for pos in range(max(a, c), min(b, d) + 1):
            want.setdefault((k, pos), []).append(v)
    got = {(r["rid"], r["pos"]): r["score"] for r in entry.queries()["base_scores"](spark, top).collect()}
    assert got.keys() == want.keys() and any(k % 10 for k, _ in got)
    assert all(abs(got[k] - sum(v) / len(v)) < 1e-5 for k, v in want.items())


def test_positions_avoid_all_neighbours(spark, few):
    top, own, pairs = few
    points = {(k, s, (c + d) // 2) for k, s, a, b, c, d, _ in pairs if a <= (c + d) // 2 <= b}
    want = {(k, pos) for k, s, pos in points if not any(q == s and o != k and a <= pos <= b for o, q, a, b in own)}
    assert {(r["rid"], r["pos"]) for r in entry.queries()["avoid_neighbours"](spark, top).collect()} == want and want


def test_each_region_is_met(spark, few):
    top, _, pairs = few
    want = {}
    for k, _, _, _, c, d, _ in pairs:
        lo, hi = want.get(k, (c, d))
        want[k] = (min(lo, c), max(hi, d))
    got = {r["rid"]: r["value"] for r in entry.queries()["each_region"](spark, top).collect()}
    assert got == {k: hi - lo + 1 for k, (lo, hi) in want.items()} and any(k % 50 for k in got)


def test_all_transcripts_are_spliced(spark, few):
    from locusframe.plans import data

    own = {}
    for r in data.gene_model(spark, few[0])[1].filter("type = 'exon'").collect():
        own.setdefault(r["transcript_id"], []).append((r["start"], r["end"], r["strand"]))
    marks = [((a + b) // 2, b - a) for exons in own.values() for a, b, _ in exons]
    want = {}
    for tid, exons in own.items():
        before = 0
        for a, b, st in sorted(exons, key=lambda x: x[0] if x[2] >= 0 else -x[1]):
            for p, n in marks:
                if a <= p <= b:
                    want.setdefault((tid, before + (p - a if st >= 0 else b - p)), []).append(n)
            before += b - a + 1
    got = {(r["transcript_id"], r["pos"]): r["score"] for r in entry.queries()["spliced_positions"](spark, few[0]).collect()}
    assert got.keys() == want.keys() and {tid[-1] for tid, _ in got} == set("ANR")
    assert all(abs(got[k] - sum(v) / len(v)) < 1e-5 for k, v in want.items())


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
