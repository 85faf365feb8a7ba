"""How two signals go together along regions. Rows: (key, pos, ref, test); a group is one region and bounded by its length."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corr(a: str, b: str) -> Column:
    """Pearson's r, null where one of the two doesn't vary: by its extremes, as a deviation merged from parts of equal values may be a little over 0."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    varies = lambda c: F.min(F.when(both, F.col(c))) < F.max(F.when(both, F.col(c)))
    return F.when(varies(a) & varies(b), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def pearson(rows: DataFrame, key: str = "_row") -> DataFrame:
    """r by region; null where one of the two doesn't vary."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), corr("ref", "test").alias("r"))


def ranks(rows: DataFrame, names: list[str], key: str = "_row") -> DataFrame:
    """Values by their rank in the region, ties by their mean rank."""
    out = rows
    for c in names:
        ties = F.count("*").over(Window.partitionBy(key, c))
        out = out.withColumn(f"_{c}", F.rank().over(Window.partitionBy(key).orderBy(c)) + (ties - 1) / 2)
    return out.drop(*names).withColumnsRenamed({f"_{c}": c for c in names})


def spearman(rows: DataFrame, key: str = "_row") -> DataFrame:
    return pearson(ranks(rows, ["ref", "test"], key), key)


def sum_normal(rows: DataFrame, names: list[str], key: str = "_row", total: float = 100) -> DataFrame:
    """Values as shares of their absolute sum in the region."""
    w = Window.partitionBy(key)
    return rows.withColumns({c: F.try_divide(F.col(c) * total, F.sum(F.abs(c)).over(w)) for c in names})


def median_normal(rows: DataFrame, names: list[str], key: str = "_row", target: float = 100) -> DataFrame:
    found = rows.groupBy(key).agg(*[F.percentile(c, 0.5).alias(f"_m_{c}") for c in names])
    return rows.join(found, key).withColumns({c: F.try_divide(F.col(c) * target, F.col(f"_m_{c}")) for c in names}).drop(*[f"_m_{c}" for c in names])


def optimal_shift(rows: DataFrame, radius: int, key: str = "_row", least: float = 0.5, low: int | None = None, high: int | None = None) -> DataFrame:
    """(key, shift, r): the shift of test within the radius with the largest r above least; then the smallest one."""
    shifts = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    moved = rows.select(key, "pos", "test").withColumn("shift", shifts).select(key, (F.col("pos") - F.col("shift")).alias("pos"), "shift", "test")
    both = rows.select(key, "pos", "ref").join(moved, [key, "pos"])
    found = both.groupBy(key, "shift").agg(corr("ref", "test").alias("r")).filter(F.col("r") > least)
    rounded = F.floor(F.col("r") * 1e9 + 0.5) / 1e9  # equal but for the order of a sum
    return found.groupBy(key).agg(F.min_by(F.struct("shift", "r"), F.struct(-rounded, F.abs("shift"), "shift")).alias("b")).select(key, "b.shift", "b.r")


def anova(rows: DataFrame, key: str = "_row") -> DataFrame:
    """(key, f, df): repeated measures of two treatments at each place; p() gives the probability.

    Sums of squares come from one aggregate: with d = ref - test, F = n mean(d)^2 / var(d).
    """
    d = F.col("ref") - F.col("test")
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.var_samp(d).alias("v"))
    return found.select(key, (F.col("n") - 1).alias("df"), F.try_divide(F.col("n") * F.col("m") * F.col("m"), F.col("v")).alias("f"))


def _fraction(a: Column, b: Column, x: Column, steps: int = 300) -> Column:
    """The continued fraction of the incomplete beta function, two of its levels a step; it has settled after some tens."""
    away = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def level(s: Column, n: Column) -> Column:
        d, c = 1 / away(1 + n * s["d"]), away(1 + n / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def step(s: Column, k: Column) -> Column:
        m = k.cast("double")
        one = level(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        return level(one, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

    d = 1 / away(1 - (a + b) * x / (a + 1))
    first = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step, lambda s: s["h"])


def p_values(tests: DataFrame, key: str = "_row") -> DataFrame:
    """(key, p): -log10 of the probability of an F (f) of 1 and df degrees of freedom, df being whole; 0 without any F."""
    df = F.col("df").cast("double")
    x, y = df / (df + F.col("f")), F.col("f") / (df + F.col("f"))
    a, b = df / 2, F.lit(0.5)
    # 1 / B(df / 2, 1 / 2): 1 / pi or 1 / 2, times (k + 1) / k for every second k below df
    least = 2 - F.col("df").cast("long") % 2
    rises = F.when(F.col("df") >= least + 2, F.sequence(least, F.col("df").cast("long") - 2, F.lit(2).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    front = F.aggregate(rises, F.when(least == 1, F.lit(-math.log(math.pi))).otherwise(math.log(0.5)), lambda s, k: s + F.log((k + 1) / k.cast("double")))
    front = F.exp(front + a * F.log(x) + b * F.log(y))
    value = F.when(x < (a + 1) / (a + b + 2), front / a * _fraction(a, b, x)).otherwise(1 - front / b * _fraction(b, a, y))
    p = F.when(F.col("f").isNull() | F.isnan("f") | (df < 1), None).when(F.col("f") <= 0, 0.0).otherwise(-F.log10(F.greatest(value, F.lit(1e-300))))
    return tests.select(key, p.cast("double").alias("p"))


def summary(found: DataFrame, column: str = "r") -> DataFrame:
    return found.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.percentile(column, 0.5).alias("median"), F.stddev_pop(column).alias("stddev"))


def shift_profile(rows: DataFrame, size: int = 1) -> DataFrame:
    """Mean of either signal by place around the centre."""
    return rows.groupBy((F.floor(F.col("pos") / size) * size).alias("pos")).agg(F.avg("ref").alias("ref"), F.avg("test").alias("test"))
