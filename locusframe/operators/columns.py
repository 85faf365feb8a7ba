"""Operators on the columns of a table: choice and order, text, statistics over rows and over columns."""

from __future__ import annotations

import re
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import convert_null, is_null, num, shown
from .shared import before_parts, checkpointed, ranged


def find_column(columns: list[str], pattern: str) -> str | None:
    """The first name that matches, whatever its case and with or without a leading #."""
    return next((c for c in columns if re.search(rf"^#?(?:{pattern})$", c, re.I)), None)


def reorder(df: DataFrame, names: list[str]) -> DataFrame:
    """These columns in this order; one named twice gets a number, those not named go."""
    seen: dict[str, int] = {}
    out = []
    for c in names:
        k = seen[c] = seen.get(c, 0) + 1
        out.append(F.col(f"`{c}`") if k == 1 else F.col(f"`{c}`").alias(f"{c}_{k}"))
    return df.select(*out)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def add_values(df: DataFrame, name: str, values: DataFrame, key: str = "_row") -> DataFrame:
    """A column from (key, name) of another table of as many rows."""
    return df.join(values.select(key, name), key)


def number(df: DataFrame, order: list[str | Column], name: str = "Number", first: int = 1) -> DataFrame:
    """Rows numbered in an order, by names of columns or sort expressions.

    No task gets all rows: a range partition sorts them, each partition is counted, and rows add the counts of those before.
    """
    rows = ranged(df, order)
    before = before_parts(rows.groupBy("_part").agg(F.count("*").alias("_n")), "_n")
    # a row for each partition
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in") + first).drop("_part", "_in", "_before")


def number_within(df: DataFrame, by: str, order: list[str], name: str = "Number", first: int = 1) -> DataFrame:
    """Rows of each key numbered in an order; null is a key too.

    A key with very many rows is dealt over the partitions of a sort: there its rows are neighbours, so their place in
    the partition says their number once it is known where the key begins and how many of it came before.
    """
    rows = ranged(df, [by, *order])
    sizes = rows.groupBy("_part", F.col(by).alias("_key")).agg(F.count("*").alias("_n"), F.min("_in").alias("_least"))
    earlier = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_n")
    before = sizes.withColumn("_before", earlier).withColumnRenamed("_part", "_p")
    found = rows.join(before, (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_key")))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_in") - F.col("_least") + first).alias(name))


def unique_names(df: DataFrame, order: list[str], prefix: str, name: str = "Name") -> DataFrame:
    """Names of a prefix and a number, in place of a Name column if there is one."""
    return number(df.drop(name), order, "_n").withColumn(name, F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")


def concatenate(names: list[str], glue: str = "_") -> Column:
    joined = "_".join(names)
    return F.concat_ws(glue, *[shown(c) for c in names]).alias(joined if len(joined) <= 30 else "cat_" + ",".join(str(i + 1) for i in range(len(names))))


def split(df: DataFrame, name: str, glue: str, parts: int | None = None) -> DataFrame:
    """name_1, name_2, ... from the pieces between matches of a pattern; trailing empty ones go, missing ones are null.

    Without a number of parts the largest in the table is taken, which needs a pass over it.
    """
    pieces = F.regexp_replace(F.col(name), rf"(?:{glue})+$", "")
    array = F.split(pieces, glue)
    if parts is None:
        parts = df.agg(F.max(F.size(array))).first()[0] or 1
    return df.withColumns({f"{name}_{k + 1}": F.get(array, k) for k in range(parts)})


def statistics(df: DataFrame, names: list[str], zeros: bool = True) -> DataFrame:
    """A row for each column: count, mean, median, stddev (of all), min, max, mode (the least of several) and sum of its numbers."""
    def one(c: str) -> DataFrame:
        v = num(F.regexp_replace(F.col(c).cast("string"), "[, ]", ""))
        v = v if zeros else F.when(v != 0, v)
        return df.select(F.lit(c).alias("column"), v.alias("v"))

    rows = fold(lambda a, b: a.union(b), [one(c) for c in names]).filter("v is not null")
    counts = rows.groupBy("column", "v").agg(F.count("*").alias("n"))
    mode = counts.groupBy("column").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode"))
    found = rows.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.stddev_pop("v").alias("stddev"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum"))
    return found.join(mode, "column")


def combine(names: list[str], how: str = "mean") -> Column:
    """A statistic over the numbers of several columns of a row; null without any, but 0 for sum."""
    a = F.array_compact(F.array(*[num(c) for c in names]))
    n = F.size(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = F.try_divide(total, n)
    if how == "sum":
        return total
    if how == "mean":
        return mean
    if how == "median":
        s = F.array_sort(a)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
    if how == "stdev":
        return F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)), n))
    return {"min": F.array_min, "max": F.array_max}[how](a)


def _one_row(df: DataFrame, found: DataFrame) -> DataFrame:
    """A row of statistics beside every row."""
    return df.join(F.broadcast(found))


def percentile_rank(df: DataFrame, name: str, out: str = "rank") -> DataFrame:
    """The share of numbers that are not larger; ties take the highest rank.

    Counts by distinct value, summed over ranges of values, so no task gets all rows.
    """
    v = num(name)
    counts = df.select(v.alias("_v")).filter("_v is not null").groupBy("_v").agg(F.count("*").alias("_c"))
    rows = ranged(counts, ["_v"])
    sizes = before_parts(rows.groupBy("_part").agg(F.sum("_c").alias("_n")), "_n")
    total = rows.agg(F.sum("_c").alias("_all"))  # one row
    upto = F.sum("_c").over(Window.partitionBy("_part").orderBy("_in").rowsBetween(Window.unboundedPreceding, 0))
    ranks = rows.withColumn("_upto", upto).join(F.broadcast(sizes), "_part").join(F.broadcast(total))
    ranks = ranks.select("_v", ((F.col("_upto") + F.col("_before")) / F.col("_all")).alias(out))
    return df.withColumn("_v", v).join(ranks, "_v", "left").drop("_v")


def zscore(df: DataFrame, name: str, out: str = "zscore") -> DataFrame:
    found = df.agg(F.avg(num(name)).alias("_m"), F.stddev_pop(num(name)).alias("_s"))
    return _one_row(df, found).withColumn(out, F.try_divide(num(name) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def median_scale(df: DataFrame, name: str, target: float, out: str = "scaled") -> DataFrame:
    """All numbers times what brings the median of those that aren't zero to the target."""
    v = num(name)
    found = df.agg(F.percentile(F.when(v != 0, v), 0.5).alias("_m"))
    return _one_row(df, found).withColumn(out, v * F.try_divide(F.lit(float(target)), F.col("_m"))).drop("_m")


def row_center(df: DataFrame, names: list[str]) -> DataFrame:
    """Each of the columns less their median in the row."""
    marked = df.withColumn("_m", combine(names, "median"))
    return marked.withColumns({c: num(c) - F.col("_m") for c in names}).drop("_m")


def math(df: DataFrame, name: str, sign: str, by: float | str, out: str | None = None) -> DataFrame:
    """add, subtract, multiply or divide by a number or by the column's own mean, median or sum."""
    v = num(name)
    stats = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "sum": F.sum}
    if by in stats:
        df = _one_row(df, df.agg(stats[by](v).alias("_by")))
    else:
        df = df.withColumn("_by", F.lit(float(by)))
    b = F.col("_by")
    value = {"add": v + b, "subtract": v - b, "multiply": v * b, "divide": F.try_divide(v, b)}[sign]
    return df.withColumn(out or name, value).drop("_by")


def null_columns(df: DataFrame, names: list[str], to, zeros: bool = False) -> DataFrame:
    return df.withColumns({c: convert_null(c, to, zeros) for c in names})


__all__ = ["add_values", "combine", "concatenate", "find_column", "is_null", "math", "median_scale", "null_columns", "number", "number_within", "percentile_rank", "rename", "reorder", "row_center", "split", "statistics", "unique_names", "zscore"]
