"""Scores of a signal over regions: whole, in windows around a point, in bins of the length."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .methods import filled, reduce
from .ranges import contains, exclude_overlapping, overlap_join, tiles

INTERVAL = ("seq_id", "start", "end", "strand")


# ---- where to look -------------------------------------------------------------------------------


def _moved(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Turned round where start is behind end, and cut off at 1."""
    low, high = F.least(start, end), F.greatest(start, end)
    return df.withColumns({"start": F.greatest(low, F.lit(1).cast("long")), "end": F.greatest(high, F.lit(1).cast("long"))})


def extend(df: DataFrame, by: int) -> DataFrame:
    return _moved(df, F.col("start") - by, F.col("end") + by)


def sub_region(df: DataFrame, position: str, begin: int, end: int) -> DataFrame:
    """A part of each region: from its 5 or 3 prime end, its middle (4), its peak (10), or both ends (53)."""
    forward = F.col("strand") >= 0
    s, e = F.col("start"), F.col("end")
    middle = F.col("peak") if position == "10" else F.floor((s + e) / 2)
    ways = {
        "5": (s + begin, s + end, e - end, e - begin),
        "3": (e + begin, e + end, s - end, s - begin),
        "4": (middle + begin, middle + end, middle - end, middle - begin),
        "10": (middle + begin, middle + end, middle - end, middle - begin),
        "53": (s + begin, e + end, s - begin, e - end),
    }
    a, b, c, d = ways[position]
    return _moved(df, F.when(forward, a).otherwise(c), F.when(forward, b).otherwise(d))


def fraction(df: DataFrame, begin: float, end: float, limit: int = 0, position: str = "5") -> DataFrame:
    """The part of each region between two shares of its length; shorter ones than limit stay whole."""
    s, e = F.col("start"), F.col("end")
    size = e - s + 1
    a, b = F.floor(size * begin + 0.5).cast("long"), F.floor(size * end + 0.5).cast("long")
    forward = F.col("strand") >= 0
    if position == "3":  # from the far end on
        start, stop = F.when(forward, e + a).otherwise(s - b), F.when(forward, e + b).otherwise(s - a)
    else:
        start, stop = F.when(forward, s + a).otherwise(e - b), F.when(forward, s + b).otherwise(e - a)
    short = size < limit
    return _moved(df, F.when(short, s).otherwise(start), F.when(short, e).otherwise(stop))


def reference_point(position: str = "5") -> Column:
    forward = F.col("strand") >= 0
    s, e = F.col("start"), F.col("end")
    return {
        "5": F.when(forward, s).otherwise(e),
        "3": F.when(forward, e).otherwise(s),
        "4": F.floor((s + e) / 2),
        "10": F.col("peak") if position == "10" else s,
    }[position].cast("long")


def offset(point: Column, reference: Column, strand: Column) -> Column:
    return F.when(strand >= 0, point - reference).otherwise(reference - point)


# ---- what is there -------------------------------------------------------------------------------


def union_of(*signals: DataFrame) -> DataFrame:
    return fold(lambda a, b: a.unionByName(b), signals)


def pairs_of(regions: DataFrame, signal: DataFrame, key: str, strand: str, width: int | None) -> DataFrame:
    return overlap_join(regions.select(key, *INTERVAL), signal.select(*INTERVAL, "score", "name"), width, strand)


def region_score(regions: DataFrame, signal: DataFrame, method: str = "mean", key: str = "_row", strand: str = "all", width: int | None = None, column: str | None = None) -> DataFrame:
    """regions with one column more, named by the method."""
    pairs = pairs_of(regions, signal, key, strand, width)
    inside = contains(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    column = column or method
    found = pairs.groupBy(key).agg(reduce(method, F.col("r_score"), inside, F.col("r_name")).alias(column))
    out = regions.join(found, key, "left")
    return out.withColumn(column, filled(method, F.col(column)))


def merged_rows(signal: DataFrame, method: str) -> tuple[DataFrame, Column]:
    """Signal rows of one interval (and score or name, where these matter) as one row, and what reduces them by pairs; rows pile up at few places."""
    scores, inside = F.col("r_score"), contains(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    if method == "stddev":  # sums of squares would lose digits
        return signal.select(*INTERVAL, "score"), reduce(method, scores, inside, F.lit(None))
    if method == "ncount":
        return signal.select(*INTERVAL, "name").distinct(), reduce(method, F.lit(None), inside, F.col("r_name"))
    if method == "median":
        counts = signal.filter("score is not null").groupBy(*INTERVAL, "score").agg(F.count("*").alias("n"))
        return counts, F.percentile(scores, 0.5, F.col("r_n"))
    ways = {
        "mean": ({"score": F.sum("score"), "n": F.count("score")}, F.try_divide(F.sum(scores), F.sum("r_n"))),
        "sum": ({"score": F.sum("score")}, F.sum(scores)),
        "min": ({"score": F.min("score")}, F.min(scores)),
        "max": ({"score": F.max("score")}, F.max(scores)),
        "count": ({"n": F.count("score")}, F.sum("r_n")),
        "pcount": ({"n": F.count("*")}, F.sum(F.when(inside, F.col("r_n")).otherwise(0))),
        "range": ({"low": F.min("score"), "high": F.max("score")}, F.max("r_high") - F.min("r_low")),
    }
    if method not in ways:
        reduce(method, scores, inside, F.lit(None))  # says which there are
    columns, value = ways[method]
    return signal.groupBy(*INTERVAL).agg(*[v.alias(c) for c, v in columns.items()]), value


def subfeature_score(parts: DataFrame, parents: DataFrame, signal: DataFrame, method: str = "mean", parent: str = "parent_id", key: str = "id", strand: str = "all", width: int | None = None) -> DataFrame:
    """One reduction over the scores of all parts of a parent; what meets two parts counts twice, but once by name."""
    rows, value = merged_rows(signal, method)
    pairs = overlap_join(parts.select(parent, *INTERVAL), rows, width, strand)
    found = pairs.groupBy(F.col(parent).alias(key)).agg(value.alias(method))
    return parents.join(found, key, "left").withColumn(method, filled(method, F.col(method)))


def position_scores(regions: DataFrame, signal: DataFrame, key: str = "_row", strand: str = "all", width: int | None = None, place: str = "mid", method: str = "mean") -> DataFrame:
    """(key, pos, score): scores at middles inside the region, or at every base that a signal row covers; several at one place are combined."""
    pairs = pairs_of(regions, signal, key, strand, width)
    if place == "mid":
        pairs = pairs.withColumn("pos", F.floor((F.col("r_start") + F.col("r_end")) / 2).cast("long")).filter("pos between start and end")
    else:
        pairs = pairs.withColumn("pos", F.explode(F.sequence(F.greatest("start", "r_start"), F.least("end", "r_end"))))
    return pairs.groupBy(key, "pos").agg(reduce(method, F.col("r_score"), F.lit(True), F.col("r_name")).alias("score"))


def weighted_score(regions: DataFrame, signal: DataFrame, method: str = "mean", key: str = "_row", width: int | None = None) -> DataFrame:
    """Per-base mean, min, max, sum or stddev (of all) of a signal over regions, without spelling out bases: each row weighs as much of it as lies inside."""
    pairs = pairs_of(regions, signal, key, "all", width)
    w = F.least("end", "r_end") - F.greatest("start", "r_start") + 1
    v = F.col("r_score")
    n, mean = F.sum(w), F.sum(w * v) / F.sum(w)
    value = {"mean": mean, "min": F.min(v), "max": F.max(v), "sum": F.sum(w * v), "stddev": F.sqrt(F.greatest(F.sum(w * v * v) / n - mean * mean, F.lit(0.0)))}[method]
    found = pairs.groupBy(key).agg(value.alias(method))
    out = regions.join(found, key, "left")
    return out.withColumn(method, filled(method, F.col(method)))


def alignment_count(regions: DataFrame, alignments: DataFrame, key: str = "_row", strand: str = "all", method: str = "count", width: int | None = None) -> DataFrame:
    """Alignments (as a signal) by region: those of which one end at least is inside; one that spans the region isn't counted.

    pcount: both ends; ncount: distinct names.
    """
    pairs = pairs_of(regions, alignments, key, strand, width)
    first, last = F.col("r_start").between(F.col("start"), F.col("end")), F.col("r_end").between(F.col("start"), F.col("end"))
    own = pairs.filter(first & last if method == "pcount" else first | last)
    found = own.groupBy(key).agg((F.count_distinct("r_name") if method == "ncount" else F.count("*")).alias(method))
    return regions.join(found, key, "left").withColumn(method, F.coalesce(method, F.lit(0)))


def spliced_positions(ex: DataFrame, signal: DataFrame, width: int | None = None) -> DataFrame:
    """(transcript_id, pos, score): middles of a signal on exons (with their spliced offset), counted from the 5 prime end without introns."""
    point = F.floor((F.col("start") + F.col("end")) / 2).cast("long")
    # rows of one middle are added up first: they fall on the same exons
    points = signal.filter("end >= start").groupBy("seq_id", point.alias("start")).agg(F.sum("score").alias("total"), F.count("score").alias("n")).withColumns({"end": F.col("start"), "strand": F.lit(0)})
    inside = overlap_join(ex.select("transcript_id", "spliced", *INTERVAL), points.select(*INTERVAL, "total", "n"), width)
    place = F.col("spliced") + F.when(F.col("strand") >= 0, F.col("r_start") - F.col("start")).otherwise(F.col("end") - F.col("r_start"))
    return inside.groupBy("transcript_id", place.alias("pos")).agg(F.try_divide(F.sum("r_total"), F.sum("r_n")).alias("score"))


class Pairs:
    """The pairs of one region: arrays by the names of their columns."""

    __slots__ = ("columns", "low", "high")

    def __init__(self, columns: dict, low: int, high: int) -> None:
        self.columns, self.low, self.high = columns, low, high

    def __getitem__(self, name: str):
        return self.columns[name][self.low : self.high]


def whole_regions(batches: Iterator) -> Iterator:
    """Arrow tables of whole regions from batches sorted by the first column; the last region of a batch waits for the next."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        cut = run_starts(keys)[-1]
        if cut == 0 and held and held[-1].column(0)[-1] == keys[0]:
            held.append(batch)
            continue
        ready = [*held, batch.slice(0, cut)] if cut else held
        if ready:
            yield pa.Table.from_batches(ready)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def run_starts(keys) -> list[int]:
    """Where each run of equal keys begins."""
    import numpy as np
    import pyarrow.compute as pc

    changes = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(changes) + 1).tolist()]


def each_region(regions: DataFrame, signal: DataFrame, function, schema: str, key: str = "_row", width: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A function of one region's pairs, for what no expression says: from the key and the pairs to rows of the schema.

    It reads the columns given, or all. A task sorts its pairs by region and calls the function for each region of an
    Arrow batch. A region's pairs are in memory together.
    """
    pairs = pairs_of(regions, signal, key, "all", width)
    names = columns or [c for c in pairs.columns if c != key]
    types = to_arrow_schema(StructType.fromDDL(schema))

    def called(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for table in whole_regions(batches):
            table = table.combine_chunks()
            keys = table.column(0).combine_chunks()
            starts, own = run_starts(keys), {c: table.column(c).to_numpy() for c in names}
            found = [r for k, a, b in zip(keys.take(pa.array(starts)).to_pylist(), starts, [*starts[1:], len(keys)]) for r in function(k, Pairs(own, a, b))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), types.types)], schema=types)

    return pairs.select(key, *names).repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(called, schema)


def avoid(positions: DataFrame, regions: DataFrame, others: DataFrame, key: str = "_row", width: int | None = None) -> DataFrame:
    """Positions that no other feature than the region itself covers; features are told apart by name."""
    points = positions.join(regions.select(key, "seq_id", F.col("name").alias("own")), key).withColumns({"start": F.col("pos"), "end": F.col("pos"), "strand": F.lit(0)})
    hit = overlap_join(points, others.select("seq_id", "start", "end", "name"), width).filter("r_name <> own").select(key, "pos").distinct()
    return positions.join(hit, [key, "pos"], "left_anti")


def window_start(o: Column, size: int) -> Column:
    """The start of the window an offset is in; the reference base itself is in none."""
    return F.when(o < 0, -F.ceil(-o / size) * size).when(o > 0, F.floor((o - 1) / size) * size + 1).cast("long")


def relative_profile(regions: DataFrame, signal: DataFrame, method: str = "mean", size: int = 50, up: int = 20, down: int = 20, position: str = "5", key: str = "_row", strand: str = "all", width: int | None = None) -> DataFrame:
    """(key, win_start, value) for each window that has scores, around the reference point."""
    reference = reference_point(position)
    reach = size * max(up, down)
    wide = regions.withColumn("_ref", reference).select(key, "_ref", "seq_id", "strand", F.greatest(F.col("_ref") - reach, F.lit(1)).alias("start"), (F.col("_ref") + reach).alias("end"))
    pairs = overlap_join(wide, signal.select(*INTERVAL, "score", "name"), width, strand)
    point = F.floor((F.col("r_start") + F.col("r_end")) / 2)
    placed = pairs.withColumn("win_start", window_start(offset(point, F.col("_ref"), F.col("strand")), size))
    placed = placed.filter(F.col("win_start").between(-size * up, size * (down - 1) + 1))
    return placed.groupBy(key, "win_start").agg(reduce(method, F.col("r_score"), F.lit(True), F.col("r_name")).alias("value"))


def relative_windows(regions: DataFrame, size: int = 50, up: int = 20, down: int = 20, position: str = "5") -> DataFrame:
    """The windows themselves as intervals with win_start, for region_score where windows are long."""
    ref = reference_point(position)
    starts = F.array(*[F.lit(-size * k).cast("long") for k in range(up, 0, -1)], *[F.lit(size * (k - 1) + 1).cast("long") for k in range(1, down + 1)])
    out = regions.withColumn("_ref", ref).withColumn("win_start", F.explode(starts))
    a, b = F.col("win_start"), F.col("win_start") + size - 1
    forward = F.col("strand") >= 0
    out = out.withColumns({"start": F.when(forward, F.col("_ref") + a).otherwise(F.col("_ref") - b), "end": F.when(forward, F.col("_ref") + b).otherwise(F.col("_ref") - a)})
    return out.filter("end >= 1").withColumn("start", F.greatest("start", F.lit(1).cast("long"))).drop("_ref")


def bin_edges(size: Column, i: Column, bins: int) -> tuple[Column, Column]:
    """First and last offset of bin i; i below 0 or from bins on lies beside the region."""
    share = 100.0 / bins * 0.01
    return F.rint(i * share * size + 1), F.rint((i + 1) * share * size)


def binned_profile(regions: DataFrame, signal: DataFrame, method: str = "mean", bins: int = 10, extra: int = 0, extra_size: int | None = None, key: str = "_row", strand: str = "all", width: int | None = None, least: int = 0) -> DataFrame:
    """(key, bin, value) for each bin that has scores: bins of the length, and extra ones beside it, in shares or in base pairs.

    The 5-prime-most base has offset 0 and is in the bin before the first. Regions shorter than least are left out.
    """
    size = F.col("end") - F.col("start") + 1
    reach = F.lit(extra * extra_size) if extra_size else F.floor(extra * (100.0 / bins) * 0.01 * size + 0.5)
    own = regions.withColumns({"_len": size, "_five": reference_point("5"), "_reach": reach.cast("long")}).filter(F.col("_len") >= least)
    wide = own.select(key, "_len", "_five", "seq_id", "strand", F.greatest(F.col("start") - F.col("_reach"), F.lit(1)).alias("start"), (F.col("end") + F.col("_reach")).alias("end"))
    pairs = overlap_join(wide, signal.select(*INTERVAL, "score", "name"), width, strand)
    point = F.floor((F.col("r_start") + F.col("r_end")) / 2)
    placed = pairs.withColumn("_o", offset(point, F.col("_five"), F.col("strand")))

    def holds(i: Column) -> Column:
        a, b = bin_edges(F.col("_len"), i, bins)
        if extra_size:
            a = F.when(i < 0, i * extra_size).when(i >= bins, F.col("_len") + (i - bins) * extra_size).otherwise(a)
            b = F.when(i < 0, (i + 1) * extra_size).when(i >= bins, F.col("_len") + (i - bins + 1) * extra_size).otherwise(b)
        return F.col("_o").between(a, b)

    # edges are rounded: beside the bin that the offset falls into by division, its neighbours may hold it
    o, n = F.col("_o"), F.col("_len")
    near = [F.floor(o * bins / n)]
    if extra_size:
        near += [F.floor(o / extra_size), F.floor((o - n) / extra_size) + bins]
    tried = F.array_distinct(F.array(*[(k + d).cast("int") for k in near for d in (-1, 0, 1)]))
    placed = placed.withColumn("bin", F.explode(F.filter(tried, lambda i: i.between(-extra, bins + extra - 1) & holds(i))))
    return placed.groupBy(key, "bin").agg(reduce(method, F.col("r_score"), F.lit(True), F.col("r_name")).alias("value"))


def bin_windows(regions: DataFrame, bins: int = 10) -> DataFrame:
    """The bins of each region as intervals with their number, from the 5 prime end on."""
    size = F.col("end") - F.col("start") + 1
    out = regions.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    a, b = (F.rint((F.col("bin") + k) * (100.0 / bins * 0.01) * size).cast("long") for k in (0, 1))
    forward = F.col("strand") >= 0
    first = F.when(forward, F.col("start") + a).otherwise(F.col("end") - b + 1)
    last = F.when(forward, F.col("start") + b - 1).otherwise(F.col("end") - a)
    return out.withColumns({"_a": first, "_b": last}).withColumns({"start": F.col("_a"), "end": F.col("_b")}).drop("_a", "_b")


def binned_long(regions: DataFrame, signal: DataFrame, method: str = "mean", bins: int = 10, key: str = "_row", strand: str = "all", width: int | None = None) -> DataFrame:
    """(key, bin, value) for every bin of the length: rows of a signal count in each bin that they overlap, not only where their middle is."""
    windows = bin_windows(regions.select(key, *INTERVAL), bins).withColumn("_bin_key", F.struct(F.col(key), F.col("bin")))
    found = region_score(windows, signal, method, "_bin_key", strand, width, "value")
    return found.select(key, "bin", "value")


def wide_profile(regions: DataFrame, profile: DataFrame, places: list[int], key: str = "_row", at: str = "win_start", prefix: str = "w", empty=None) -> DataFrame:
    """A column for each of the given windows or bins."""
    table = profile.groupBy(key).pivot(at, places).agg(F.first("value"))
    names = {str(p): f"{prefix}_{str(p).replace('-', 'm')}" for p in places}
    out = regions.join(table, key, "left")
    for p, name in names.items():
        out = out.withColumnRenamed(p, name)
        if empty is not None:
            out = out.withColumn(name, F.coalesce(name, F.lit(empty)))
    return out


def profile_summary(profile: DataFrame, how: str = "mean", at: str = "win_start", logged: bool = False) -> DataFrame:
    """(at, n, value) over all regions: mean, median, or the mean without the hundredth at either end.

    The trimmed sum has the values from place x to n - x, one more than it is divided by, as the tables this
    follows have it. logged: averages of powers of two, as a logarithm.
    """
    v = F.pow(F.lit(2.0), "value") if logged else F.col("value")
    if how == "trimmean":
        # by distinct values, so that no window's values are brought together in one array
        counts = profile.select(at, v.alias("v")).filter("v is not null").groupBy(at, "v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(at).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        rows = counts.withColumn("upto", upto).join(counts.groupBy(at).agg(F.sum("c").alias("n")), at)
        x = F.rint(F.col("n") / 100).cast("long")
        inside = F.greatest(F.least("upto", F.col("n") - x + 1) - F.greatest(F.col("upto") - F.col("c"), x), F.lit(0))
        trimmed = F.sum(F.col("v") * inside) / (F.first("n") - 2 * F.first(x))
        found = rows.groupBy(at).agg(F.first("n").alias("n"), F.when(F.first("n") < 100, F.sum(F.col("v") * F.col("c")) / F.first("n")).otherwise(trimmed).alias("value"))
    else:
        found = profile.groupBy(at).agg(F.count("value").alias("n"), {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5)}[how](v).alias("value"))
    return found.withColumn("value", F.log2("value")) if logged else found


def interpolate(columns: list[str]) -> list[Column]:
    """Columns with runs of nulls filled on a line between their neighbours; the first and last stay."""
    out = []
    for i, c in enumerate(columns):
        if i in (0, len(columns) - 1):
            out.append(F.col(c))
            continue
        before = F.array(*[F.when(F.col(x).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(x).cast("double").alias("v"))) for k, x in enumerate(columns[:i])])
        after = F.array(*[F.when(F.col(x).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(x).cast("double").alias("v"))) for k, x in enumerate(columns) if k > i])
        a, b = F.try_element_at(F.array_compact(before), F.lit(-1)), F.try_element_at(F.array_compact(after), F.lit(1))
        line = a["v"] + (b["v"] - a["v"]) / (b["k"] - a["k"]) * (F.lit(i) - a["k"])
        out.append(F.coalesce(F.col(c).cast("double"), line).alias(c))
    return out


# ---- counts made comparable ----------------------------------------------------------------------


def fpkm(df: DataFrame, count: str = "count", size: Column | None = None, total: float | None = None) -> DataFrame:
    """Counts by thousand bases and million of the total: all counts of the table, or a given number."""
    size = size if size is not None else F.col("end") - F.col("start") + 1
    sums = df.agg(F.sum(count).alias("_total")) if total is None else None
    out = df.join(F.broadcast(sums)) if sums is not None else df.withColumn("_total", F.lit(float(total)))
    return out.withColumn("fpkm", F.try_divide(F.col(count) * 1e9, size * F.col("_total"))).drop("_total")


def tpm(df: DataFrame, count: str = "count", size: Column | None = None) -> DataFrame:
    size = size if size is not None else F.col("end") - F.col("start") + 1
    rate = F.col(count) / (size / 1000)
    sums = df.agg((F.sum(rate) / 1e6).alias("_total"))  # one row
    return df.join(F.broadcast(sums)).withColumn("tpm", F.try_divide(rate, F.col("_total"))).drop("_total")


def discard_low(df: DataFrame, columns: list[str], least: float) -> DataFrame:
    total = fold(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])
    return df.filter(total >= least)


def genome_windows(lengths: DataFrame, window: int = 500, step: int | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """Windows over all sequences without those that overlap the blacklist."""
    found = tiles(lengths, window, step)
    if blacklist is None:
        return found
    named = found.withColumn("_row", F.concat_ws(":", "seq_id", "start"))
    return exclude_overlapping(named, blacklist, "_row", width=max(64, window)).drop("_row")
