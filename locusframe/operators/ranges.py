"""Intervals: closed, 1-based, in columns seq_id, start, end and strand.

The join of overlapping intervals is an equi-join on bins of the sequence, so that Spark shuffles it
like any other join, whatever the number of sequences; a pair that shares several bins is kept in
the one that holds the larger of the two starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRANDS = ("all", "sense", "antisense")


def seq_key(c: str | Column) -> Column:
    """A sequence's name without the prefix that some sources leave out."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "^chr", "")


def bin_width(*frames: DataFrame, share: float = 0.9) -> int:
    """A width that most intervals fit: a quantile of the lengths, between 64 and a million."""
    found = [f.agg(F.approx_percentile(F.col("end") - F.col("start") + 1, share)).first()[0] for f in frames]
    return int(min(max([64, *(x for x in found if x)]), 1_000_000))


def binned(df: DataFrame, width: int, start: Column, end: Column) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))


def overlap_join(left: DataFrame, right: DataFrame, width: int | None = None, within: str = "all", gap: int = 0) -> DataFrame:
    """Pairs of overlapping rows: left's columns, and right's with r_ in front.

    within: all pairs, those of the same strand (or with a right row of none), or of another strand.
    gap: rows this far apart count as overlapping too.
    """
    width = width or bin_width(left, right)
    right = right.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns])
    a = binned(left.filter("end >= start"), width, F.col("start") - gap, F.col("end") + gap).withColumn("_seq", seq_key("seq_id"))
    b = binned(right.filter("r_end >= r_start"), width, F.col("r_start"), F.col("r_end")).withColumn("_seq", seq_key("r_seq_id"))
    near = (F.col("start") - gap <= F.col("r_end")) & (F.col("r_start") <= F.col("end") + gap)
    owner = F.col("_bin") == F.floor(F.greatest(F.col("start") - gap, F.col("r_start")) / width)
    return a.join(b, ["_seq", "_bin"]).filter(near & owner & strand_rule(within)).drop("_seq", "_bin")


def strand_rule(within: str, own: str = "strand", other: str = "r_strand") -> Column:
    if within not in STRANDS:
        raise ValueError(f"strands: one of {', '.join(STRANDS)}")
    a, b = F.col(own), F.col(other)
    return F.lit(True) if within == "all" else (b == 0) | (a == b) if within == "sense" else a != b


def exclude_overlapping(df: DataFrame, others: DataFrame, key: str = "_row", width: int | None = None) -> DataFrame:
    """Rows of df that overlap none of the others."""
    hit = overlap_join(df.select(key, "seq_id", "start", "end"), others.select("seq_id", "start", "end"), width).select(key).distinct()
    return df.join(hit, key, "left_anti")


def intersection(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """struct(start, end), null where the two don't meet."""
    low, high = F.greatest(a0, b0), F.least(a1, b1)
    return F.when(low <= high, F.struct(low.alias("start"), high.alias("end")))


def union(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """struct(start, end) of the span of both, null where they don't meet."""
    return F.when((a0 <= b1) & (b0 <= a1), F.struct(F.least(a0, b0).alias("start"), F.greatest(a1, b1).alias("end")))


def subtract(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The nought to two pieces of the first that the second leaves."""
    apart = (a0 > b1) | (b0 > a1)
    piece = lambda lo, hi: F.struct(lo.alias("start"), hi.alias("end"))
    pieces = F.filter(F.array(piece(a0, b0 - 1), piece(b1 + 1, a1)), lambda p: p["start"] <= p["end"])
    return F.when(apart, F.array(piece(a0, a1))).otherwise(pieces)


def contains(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b0) & (b1 <= a1)


def islands(df: DataFrame, by: list[str], gap: int = 0, start: str = "start", end: str = "end", region: int | None = None) -> DataFrame:
    """Overlapping intervals merged: by, start, end and how many went in. Those next to each other stay apart; gap joins such, and farther ones.

    With a region, a group is cut into pieces of that length, each with the farthest end and the last opening that come
    in from the left, so a long sequence isn't one task. Without, a group is one: for groups that are small.
    """
    own = [*by, "_r"] if region else by
    rows = df.withColumn("_r", F.floor(F.col(start) / region)) if region else df
    w = Window.partitionBy(*own).orderBy(start, end)

    def carried(frame: DataFrame, value: Column) -> DataFrame:
        """The largest value of all regions before each; a row for each region."""
        before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        return frame.groupBy(*own).agg(value.alias("_m")).withColumn("_carried", F.max("_m").over(before)).drop("_m")

    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if region:
        rows = rows.join(carried(rows, F.max(end)), own).withColumn("_before", F.greatest(before, F.col("_carried"))).drop("_carried")
    else:
        rows = rows.withColumn("_before", before)
    opens = F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before") + gap), F.col(start))
    rows = rows.withColumn("_opens", opens)
    # an island is known by where it opens; of equal rows any may be the one that opens it
    island = F.max("_opens").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    if region:
        rows = rows.join(carried(rows, F.max("_opens")), own).withColumn("_island", F.coalesce(island, "_carried"))
    else:
        rows = rows.withColumn("_island", island)
    return rows.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def distance(kind: str = "start") -> Column:
    """From a row's interval to that of a pair: of the strand-aware starts, or of the middles."""
    if kind == "mid":
        return F.floor((F.col("r_start") + F.col("r_end")) / 2 - (F.col("start") + F.col("end")) / 2 + 0.5).cast("long")
    five = lambda s, e, st: F.when(F.col(st) >= 0, F.col(s)).otherwise(F.col(e))
    return (five("r_start", "r_end", "r_strand") - five("start", "end", "strand")) * F.when(F.col("strand") >= 0, 1).otherwise(-1)


def best_overlap(df: DataFrame, targets: DataFrame, key: str = "_row", width: int | None = None, kind: str = "start", mode: str = "overlap") -> DataFrame:
    """Each row with how many targets it meets and the best of them: r_name, r_strand, distance and overlap.

    Best is the largest overlap (mode "span": the largest span of both), then the smaller start and name. One
    aggregate finds it, so no row's pairs are sorted.
    """
    pairs = overlap_join(df.select(key, "seq_id", "start", "end", "strand"), targets.select("seq_id", "start", "end", "strand", "name"), width)
    shared = F.least("end", "r_end") - F.greatest("start", "r_start") + 1
    span = F.greatest("end", "r_end") - F.least("start", "r_start") + 1
    best = F.struct((shared if mode == "overlap" else span).alias("overlap"), (-F.col("r_start")).alias("low"), F.col("r_strand"), distance(kind).alias("distance"))
    rows = pairs.select(key, best.alias("best"), F.col("r_name").alias("name"))
    # the largest by (overlap, -start), then the smallest name
    top = rows.groupBy(key).agg(F.count("*").alias("n_targets"), F.max(F.struct("best.overlap", "best.low")).alias("top"))
    one = rows.join(top.select(key, F.col("top.overlap").alias("o"), F.col("top.low").alias("l")), key).filter("best.overlap = o and best.low = l").groupBy(key).agg(F.min_by(F.struct("best", "name"), F.struct("name", "best.r_strand", "best.distance")).alias("b"))
    found = top.select(key, "n_targets").join(one, key)
    return df.join(found, key, "left").select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("n_targets", F.lit(0)).alias("n_targets"), F.col("b.name").alias("target"), F.col("b.best.r_strand").alias("target_strand"), F.col("b.best.distance").alias("distance"), F.coalesce("b.best.overlap", F.lit(0)).alias("overlap"))


def tiles(lengths: DataFrame, window: int = 500, step: int | None = None) -> DataFrame:
    """Windows over sequences (seq_id, length), the last of each cut off at its end."""
    step = step or window
    starts = F.explode(F.sequence(F.lit(1).cast("long"), F.col("length").cast("long"), F.lit(step).cast("long")))
    return lengths.filter("length >= 1").select("seq_id", "length", starts.alias("start")).select("seq_id", "start", F.least(F.col("start") + window - 1, F.col("length")).alias("end"))
