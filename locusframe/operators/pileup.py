"""Coverage of alignments: fragments, depth as runs, binned counts, normalisation.

Alignments: seq_id, pos (from 0), end (exclusive), strand flag bits, mapq, qname, cigar, isize,
mate_seq_id, nh. A fragment is a range of bins lo..hi with a score. Depth comes from +score at lo and
-score behind hi, summed along the sequence, so no base is spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .correlate import corr

SINGLE = ("start", "mid", "span", "cspan", "extend")
PAIRED = ("start", "mid", "span", "cspan", "ends")


def half(n: int) -> int:
    return n // 2


def single_fragments(df: DataFrame, mode: str = "start", shift: int = 0, extension: int = 0, bin_size: int = 1) -> DataFrame:
    """df with lo and hi (bins) of each read."""
    p, c, reverse = F.col("pos"), F.col("end"), F.col("flag").bitwiseAND(F.lit(0x10)) != 0
    turn = F.when(reverse, -shift).otherwise(shift)
    mid = F.floor((p + c - 1) / 2) + turn
    zero = lambda x: F.greatest(x, F.lit(0))
    h = half(extension)
    lo, hi = {
        "start": (F.when(reverse, c - 1).otherwise(p) + turn,) * 2,
        "mid": (mid, mid),
        "span": (zero(p + turn), c - 1 + turn),
        "cspan": (zero(mid - h + 1), mid + h),
        "extend": (F.when(reverse, zero(c - extension + turn)).otherwise(p + turn), F.when(reverse, c - 1 + turn).otherwise(p + turn + extension - 1)),
    }[mode]
    return _bins(df, lo, hi, bin_size, F.when(reverse, -1).otherwise(1))


def paired_fragments(df: DataFrame, mode: str = "span", extension: int = 0, bin_size: int = 1) -> DataFrame:
    """df (forward reads of proper pairs) with lo and hi of each fragment; the strand is that of the first mate."""
    p, i = F.col("pos"), F.abs("isize")
    first = F.col("flag").bitwiseAND(F.lit(0x40)) != 0
    center, h = p + F.floor(i / 2), half(extension)
    if mode == "ends":
        own, other = F.when(first, 1).otherwise(-1), F.when(first, -1).otherwise(1)
        both = df.withColumn("_e", F.explode(F.array(F.struct(p.cast("long").alias("at"), own.alias("st")), F.struct((p + i).cast("long").alias("at"), other.alias("st")))))
        return _bins(both, F.col("_e.at"), F.col("_e.at"), bin_size, F.col("_e.st")).drop("_e")
    lo, hi = {
        "start": (F.when(first, p).otherwise(p + i),) * 2,
        "mid": (center, center),
        "span": (p, p + i),
        "cspan": (F.greatest(center - h, F.lit(0)), center + h),
    }[mode]
    return _bins(df, lo, hi, bin_size, F.when(first, 1).otherwise(-1))


def _bins(df: DataFrame, lo: Column, hi: Column, size: int, strand: Column) -> DataFrame:
    out = df.withColumns({"lo": lo.cast("long"), "hi": hi.cast("long"), "strand": strand}).filter("hi >= 0 and lo >= 0 and hi >= lo")
    return out.withColumns({"lo": F.floor(F.col("lo") / size), "hi": F.floor(F.col("hi") / size)})


def blocks(df: DataFrame, share: bool = False) -> DataFrame:
    """The pieces of spliced reads (seq_id, pos, end of each); with share the score is dealt over them."""
    ops = F.regexp_extract_all(F.col("cigar"), F.lit(r"([0-9]+[MIDNSHP=X])"), 1)
    start = F.struct(F.col("pos").cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("done"), F.col("pos").cast("long").alias("open"))

    def step(acc: Column, op: Column) -> Column:
        n, kind = F.regexp_extract(op, "^([0-9]+)", 1).cast("long"), F.right(op, F.lit(1))
        moved = acc["at"] + F.when(kind.isin("M", "D", "N", "=", "X"), n).otherwise(F.lit(0).cast("long"))
        closed = F.concat(acc["done"], F.array(F.struct(acc["open"].alias("s"), acc["at"].alias("e"))))
        return F.struct(moved.alias("at"), F.when(kind == "N", closed).otherwise(acc["done"]).alias("done"), F.when(kind == "N", moved).otherwise(acc["open"]).alias("open"))

    found = F.aggregate(ops, start, step, lambda a: F.concat(a["done"], F.array(F.struct(a["open"].alias("s"), a["at"].alias("e")))))
    out = df.withColumn("_b", found).withColumn("_n", F.size("_b")).withColumn("_p", F.explode("_b")).filter("_p.e > _p.s")
    out = out.withColumns({"pos": F.col("_p.s"), "end": F.col("_p.e")})
    if share:
        out = out.withColumn("score", F.coalesce(F.col("score"), F.lit(1.0)) / F.col("_n"))
    return out.drop("_b", "_n", "_p")


def mates(df: DataFrame, least: int = 30, most: int = 600) -> DataFrame:
    """Forward reads with their reverse mates behind them, by name; reads without one go. nh is the lower of the two."""
    flag = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    ok = df.filter(flag(0x2) & F.abs("isize").between(least, most))
    forward = ok.filter(~flag(0x10))
    back = ok.filter(flag(0x10)).select("qname", F.col("seq_id").alias("_seq"), F.col("pos").alias("m_pos"), F.col("end").alias("m_end"), F.col("cigar").alias("m_cigar"), F.col("nh").alias("m_nh"))
    found = forward.join(back, "qname").filter("seq_id = _seq and pos <= m_pos").drop("_seq")
    return found.withColumn("nh", F.least("nh", "m_nh"))


def smart_pairs(pairs: DataFrame) -> DataFrame:
    """The bases that either mate's pieces cover, once each, as intervals by name."""
    from .ranges import islands

    one = blocks(pairs.select("qname", "seq_id", "pos", "end", "cigar", "flag"))
    two = blocks(pairs.select("qname", "seq_id", F.col("m_pos").alias("pos"), F.col("m_end").alias("end"), F.col("m_cigar").alias("cigar"), "flag"))
    rows = one.unionByName(two).select("qname", "seq_id", F.col("pos").alias("start"), (F.col("end") - 1).alias("end"))
    return islands(rows, ["qname", "seq_id"], gap=1).drop("n")


def multi_hit(score: Column, hits: str = "nh") -> Column:
    return score / F.greatest(F.coalesce(F.col(hits), F.lit(1)), F.lit(1))


def depth_runs(fragments: DataFrame, by: tuple[str, ...] = ("seq_id",), score: Column | None = None, keep_zero: bool = False, region: int | None = 1_000_000) -> DataFrame:
    """(by, lo, hi, value): maximal runs of bins of one depth.

    With a region, sequences are cut into pieces of so many bins, each with the depth that comes in from the left, so
    one long sequence isn't one task; runs that go on across a cut are put together at the end.
    """
    s = score if score is not None else F.lit(1)
    rows = fragments.select(*by, "lo", "hi", s.alias("_s"))
    cut = region or (1 << 62)
    ends = F.array(F.struct(F.col("lo").alias("at"), F.col("_s").alias("d")), F.struct((F.col("hi") + 1).alias("at"), (-F.col("_s")).alias("d")))
    events = rows.withColumn("_e", F.explode(ends)).groupBy(*by, F.col("_e.at").alias("at")).agg(F.sum("_e.d").alias("d"))
    events = events.withColumn("_r", F.floor(F.col("at") / cut))
    sums = events.groupBy(*by, "_r").agg(F.sum("d").alias("t"))  # a row for each region
    w = Window.partitionBy(*by).orderBy("_r")
    carried = sums.withColumn("_before", F.sum("t").over(w) - F.col("t")).select(*by, "_r", "_before")
    inner = Window.partitionBy(*by, "_r").orderBy("at")
    steps = events.join(carried, [*by, "_r"]).withColumn("value", F.col("_before") + F.sum("d").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    # only changes of depth open a run: an event of sum 0 doesn't
    steps = steps.filter("d <> 0").select(*by, "_r", F.col("at").alias("lo"), "value")
    firsts = steps.groupBy(*by, "_r").agg(F.min("lo").alias("_first"))
    after = firsts.withColumn("_after", F.lead("_first").over(w)).select(*by, "_r", "_after")
    within = Window.partitionBy(*by, "_r").orderBy("lo")
    runs = steps.withColumn("_n", F.lead("lo").over(within)).join(after, [*by, "_r"]).withColumn("hi", F.coalesce("_n", "_after") - 1)
    runs = runs.filter("hi >= lo").select(*by, "lo", "hi", "value")
    return runs if keep_zero else runs.filter("value <> 0")


def bin_counts(fragments: DataFrame, by: tuple[str, ...] = ("seq_id",), score: Column | None = None) -> DataFrame:
    """(by, bin, value) of fragments that are short: their bins one by one."""
    s = score if score is not None else F.lit(1)
    return fragments.withColumn("bin", F.explode(F.sequence("lo", "hi"))).groupBy(*by, "bin").agg(F.sum(s).alias("value"))


def bin_mean(runs: DataFrame, size: int, by: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """Mean depth of bins of a size from runs of single bases; bins without any are left out."""
    own = runs.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    shared = F.least("hi", (F.col("bin") + 1) * size - 1) - F.greatest("lo", F.col("bin") * size) + 1
    return own.groupBy(*by, "bin").agg((F.sum(F.col("value") * shared) / size).alias("value"))


def rpm(total: int, files: int = 1, totals: int | None = None) -> float:
    """The factor to a million reads; of several files from the sum of their totals."""
    return 1e6 / total if files == 1 else 1e6 / ((totals or total) * files)


def scale(df: DataFrame, factor: float, by_sequence: str | None = None, sequence_factor: float = 1.0) -> DataFrame:
    f = F.lit(float(factor))
    if by_sequence:
        f = f * F.when(F.col("seq_id").rlike(by_sequence), F.lit(float(sequence_factor))).otherwise(1.0)
    return df.withColumn("value", F.col("value") * f)


def replicate_mean(counts: DataFrame, replicates: int, factors: DataFrame | None = None, by: tuple[str, ...] = ("seq_id", "bin")) -> DataFrame:
    """Mean over replicates (column replicate), each times its factor; a bin that one doesn't have counts 0 there."""
    rows = counts.join(F.broadcast(factors), "replicate") if factors is not None else counts.withColumn("factor", F.lit(1.0))
    return rows.groupBy(*by).agg((F.sum(F.col("value") * F.col("factor")) / replicates).alias("value"))


def total_reads(df: DataFrame, least_mapq: int = 0) -> DataFrame:
    """One row: reads without the flags 0xF04; the two reads of a proper pair count once."""
    flag = F.col("flag")
    ok = (flag.bitwiseAND(F.lit(0xF04)) == 0) & (F.col("mapq") >= least_mapq)
    once = (flag.bitwiseAND(F.lit(0x2)) == 0) | (flag.bitwiseAND(F.lit(0x10)) == 0)
    return df.filter(ok & once).agg(F.count("*").alias("total"))


def signal_stats(runs: DataFrame) -> DataFrame:
    """Bases, mean, min, max and sample deviation of a signal (start, end, score), each base counting once."""
    w = F.col("end") - F.col("start") + 1
    found = runs.agg(F.sum(w).alias("bases"), F.sum(w * F.col("score")).alias("s"), F.sum(w * F.col("score") * F.col("score")).alias("q"), F.min("score").alias("min"), F.max("score").alias("max"))
    n = F.col("bases")
    deviation = F.sqrt(F.greatest(F.try_divide(F.col("q") - F.col("s") * F.col("s") / n, n - 1), F.lit(0.0)))
    return found.select("bases", F.try_divide("s", n).alias("mean"), "min", "max", deviation.alias("stddev"))


def score_chain(score: Column, null: bool = False, delog: float | None = None, absolute: bool = False, multiply: float | None = None, add: float | None = None, log: float | None = None, low: float | None = None, high: float | None = None, digits: int | None = None) -> Column:
    """Changes to a signal's score in a fixed order; the logarithm of 0 is 0."""
    v = score.cast("double")
    if null:
        v = F.coalesce(v, F.lit(0.0))
    if delog:
        v = F.pow(F.lit(float(delog)), v)
    if absolute:
        v = F.abs(v)
    if multiply is not None:
        v = v * multiply
    if add is not None:
        v = v + add
    if log:
        v = F.when(v == 0, 0.0).when(v > 0, F.ln(v) / F.ln(F.lit(float(log))))
    if low is not None:
        v = F.greatest(v, F.lit(float(low)))
    if high is not None:
        v = F.least(v, F.lit(float(high)))
    return v if digits is None else F.rint(v) if digits == 0 else F.bround(v, digits)


def cross_strand(counts: DataFrame, most: int = 500, step: int = 10) -> DataFrame:
    """(shift, r): how forward counts (seq_id, bin, strand, value) correlate with reverse ones so many bins on."""
    f = counts.filter("strand > 0").select("seq_id", "bin", F.col("value").alias("a"))
    r = counts.filter("strand < 0").withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(most), F.lit(step)))).select("seq_id", "shift", (F.col("bin") - F.col("shift")).alias("bin"), F.col("value").alias("b"))
    return f.join(r, ["seq_id", "bin"]).groupBy("shift").agg(corr("a", "b").alias("r"), F.count("*").alias("n"))


def high_regions(counts: DataFrame, low: float = 3, high: float = 10) -> DataFrame:
    """Bins whose value is some deviations above the mean, but not beyond all measure."""
    s = counts.agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))  # one row
    z = (F.col("value") - F.col("_m")) / F.col("_s")
    return counts.join(F.broadcast(s)).filter((F.col("_s") > 0) & z.between(low, high)).drop("_m", "_s")
