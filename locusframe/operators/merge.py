"""Tables put together by lookup, by position and by lists."""

from __future__ import annotations

import re
from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of lookup columns, the best first.
KEYS = ("name", "primary_id", "gene.?id", "transcript.?id", "gene", "transcript")


def lookup_column(columns: list[str]) -> str | None:
    return next((c for k in KEYS for c in columns if re.fullmatch(k, c, re.I)), None)


def first_match(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregate."""
    rows = df.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return rows.filter("_k is not null").select("_r.*")


def merge_lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str, take: list[str], order: list[str]) -> DataFrame:
    """left with columns of the first row of right that has its key, null where none has."""
    one = first_match(right.select(*dict.fromkeys([right_key, *take, *order])), right_key, order)
    one = one.select(F.col(right_key).alias("_key"), *[F.col(c).alias(f"{c}_2" if c in left.columns else c) for c in take if c != right_key])
    return left.join(one, F.col(left_key) == F.col("_key"), "left").drop("_key")


def merge_positional(left: DataFrame, right: DataFrame, key: str = "_row") -> DataFrame:
    """Rows of the same number side by side."""
    names = [F.col(c).alias(f"{c}_2" if c in left.columns else c) for c in right.columns if c != key]
    return left.join(right.select(key, *names), key)


def merge_coordinate(left: DataFrame, right: DataFrame, take: list[str], order: list[str]) -> DataFrame:
    """By the key sequence:start, or else by that of a start that counts from 0."""
    key = lambda s: F.concat_ws(":", "seq_id", s.cast("string"))
    one = first_match(right.withColumn("_key", key(F.col("start"))), "_key", order)
    first, second = (one.select(F.col("_key").alias(f"_k{n}"), F.struct(*take).alias(f"_v{n}")) for n in (1, 2))
    out = left.withColumns({"_a": key(F.col("start")), "_b": key(F.col("start") - 1)})
    out = out.join(first, F.col("_a") == F.col("_k1"), "left").join(second, F.col("_b") == F.col("_k2"), "left")
    found = F.coalesce("_v1", "_v2")
    return out.select(*left.columns, *[found[c].alias(f"{c}_2" if c in left.columns else c) for c in take])


def merge_all(frames: list[DataFrame], key: str, order: list[list[str]]) -> DataFrame:
    """Several tables by one key, the first one's rows."""
    return fold(lambda a, b: merge_lookup(a, b[0], key, key, [c for c in b[0].columns if c != key], b[1]), zip(frames[1:], order[1:]), frames[0])


def new_columns(left: list[str], right: list[str], key: str, base: str) -> dict[str, str]:
    """Columns of right to take and their names: none that left has, but scores always, named by their table."""
    have = {c.lower() for c in left}
    return {c: f"{base}_Score" if c.lower() == "score" else c for c in right if c != key and (c.lower() == "score" or c.lower() not in have)}


def pull(data: DataFrame, wanted: DataFrame, data_key: str, list_key: str, order: str = "list") -> DataFrame:
    """Rows of data whose key is in a list.

    In the list's order a row comes once for each time it is listed; in that of the data, once.
    """
    if order == "data":
        return data.join(wanted.select(F.col(list_key).alias("_k")), F.col(data_key) == F.col("_k"), "left_semi")
    listed = wanted.select(F.col(list_key).alias("_k"), F.col("_pos"))
    return data.join(listed, F.col(data_key) == F.col("_k")).drop("_k")


def pull_groups(data: DataFrame, wanted: DataFrame, data_key: str, list_key: str, group: str) -> DataFrame:
    """As pull, with the group of the list; a key in several groups is in the last."""
    last = wanted.groupBy(F.col(list_key).alias("_k")).agg(F.max_by(group, "_pos").alias(group))
    return data.join(last, F.col(data_key) == F.col("_k")).drop("_k")


def attach(df: DataFrame, features: DataFrame, key: str = "Primary_ID") -> DataFrame:
    """Features beside the rows that name them; a row without one is an error when the table is read."""
    found = df.join(features.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no feature for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.withColumn("_there", F.when(F.col("_there").isNull(), missing.cast("boolean")).otherwise(F.col("_there"))).filter("_there").drop("_there")
