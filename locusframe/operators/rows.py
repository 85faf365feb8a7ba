"""Operators on the rows of a table: filters, sorts, unions and splits."""

from __future__ import annotations

import re
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_null, num


def any_of(tests: list[Column]) -> Column:
    return fold(lambda a, b: a | b, tests)


def drop_rows(df: DataFrame, rows: list[int], key: str = "_row") -> DataFrame:
    return df.filter(~F.col(key).isin(rows))


def toss_null(df: DataFrame, names: list[str], zeros: bool = False) -> DataFrame:
    """Rows without a null (or a zero) in any of the columns."""
    return df.filter(~any_of([is_null(c) | (F.coalesce(num(c) == 0, F.lit(False)) if zeros else F.lit(False)) for c in names]))


def toss_duplicates(df: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    """The first row in order of each combination of values. An aggregate, so a value that most rows have doesn't gather them in one task."""
    keys = [F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(names)]
    rows = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("_r"))
    return rows.select("_r.*")


def toss_above(df: DataFrame, names: list[str], limit: float) -> DataFrame:
    return df.filter(~any_of([F.coalesce(num(c) > limit, F.lit(False)) for c in names]))


def toss_below(df: DataFrame, names: list[str], limit: float) -> DataFrame:
    return df.filter(~any_of([F.coalesce(num(c) < limit, F.lit(False)) for c in names]))


def has_value(names: list[str], values: list[str]) -> Column:
    return any_of([F.coalesce(F.col(f"`{c}`").cast("string").isin(values), F.lit(False)) for c in names])


def toss_values(df: DataFrame, names: list[str], values: list[str]) -> DataFrame:
    return df.filter(~has_value(names, values))


def keep_values(df: DataFrame, names: list[str], values: list[str]) -> DataFrame:
    return df.filter(has_value(names, values))


def by_length(df: DataFrame, least: int, most: int) -> DataFrame:
    return df.filter((F.col("end") - F.col("start") + 1).between(least, most))


def skip_sequences(df: DataFrame, pattern: str) -> DataFrame:
    return df.filter(~F.col("seq_id").rlike(pattern))


def by_attribute(df: DataFrame, tag: str, pattern: str, keep: bool = True) -> DataFrame:
    """Rows whose attribute matches, whatever the case; a row without it doesn't match."""
    hit = F.coalesce(F.try_element_at("attributes", F.lit(tag)).rlike(f"(?i){pattern}"), F.lit(False))
    return df.filter(hit if keep else ~hit)


def by_flags(df: DataFrame, mask: int = 0xF00, least_mapq: int = 0) -> DataFrame:
    """Alignments with none of the flag bits and a mapping quality of at least this."""
    return df.filter((F.col("flag").bitwiseAND(F.lit(mask)) == 0) & (F.col("mapq") >= least_mapq))


def proper_fragments(df: DataFrame, least: int = 30, most: int = 600) -> DataFrame:
    """Forward reads of proper pairs on one sequence, of an insert size within bounds."""
    flag = F.col("flag")
    ok = (flag.bitwiseAND(F.lit(0x2)) != 0) & (flag.bitwiseAND(F.lit(0x10)) == 0) & (flag.bitwiseAND(F.lit(0x20)) != 0)
    return df.filter(ok & (F.col("mate_seq_id") == F.col("seq_id")) & F.abs("isize").between(least, most))


def largest_gap(cigar: str = "cigar") -> Column:
    gaps = F.transform(F.regexp_extract_all(F.col(cigar), F.lit(r"([0-9]+)N"), 1), lambda x: x.cast("long"))
    return F.coalesce(F.array_max(gaps), F.lit(0))


def value_order(name: str, descending: bool = False) -> list[Column]:
    """Sort keys: numbers first, by value; then other text by leading number, letters and trailing number."""
    c = F.col(name).cast("string")
    lead = F.regexp_extract(c, r"^([0-9]+)", 1).try_cast("long")
    text, tail = F.regexp_extract(c, r"^[0-9]*([^0-9]*)", 1), F.regexp_extract(c, r"([0-9]+)$", 1).try_cast("long")
    turn = lambda x: x.desc_nulls_last() if descending else x.asc_nulls_last()
    return [num(name).isNull().asc(), turn(num(name)), turn(lead), turn(text), turn(tail), turn(c)]


def sort_value(df: DataFrame, name: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*value_order(name, descending))


def mean_order(names: list[str], how: str = "mean", descending: bool = True) -> list[Column]:
    """Sort keys: a statistic over several columns of a row."""
    from .columns import combine

    value = combine(names, how)
    return [value.desc_nulls_last() if descending else value.asc_nulls_last()]


def sort_mean(df: DataFrame, names: list[str], how: str = "mean", descending: bool = True) -> DataFrame:
    return df.orderBy(*mean_order(names, how, descending))


#: Sex and mitochondrial sequences, in order.
NAMED = ("x", "y", "z", "w", "m", "mt", "mito", "mitochondrion")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def roman(text: str) -> int | None:
    low = text.lower()
    if not low or any(c not in ROMAN for c in low):
        return None
    values = [ROMAN[c] for c in low]
    return sum(-v if any(w > v for w in values[k + 1 : k + 2]) else v for k, v in enumerate(values))


def sane_order(names: list[str]) -> list[str]:
    """Sequences by number (with arms), then sex, mitochondrial, numbered contigs and the rest by name.

    Roman numbers count as numbers unless there are others.
    """
    bare = {n: re.sub(r"(?i)^chr(omosome)?_?", "", n) for n in names}
    numeric = any(re.fullmatch(r"[0-9]+[a-zA-Z]?", b) for b in bare.values())

    def key(n: str) -> tuple:
        b = bare[n]
        if m := re.fullmatch(r"([0-9]+)([a-zA-Z]*)", b):
            return (0, int(m[1]), m[2], 0, n)
        if not numeric and (r := roman(b)) is not None:
            return (0, r, "", 0, n)
        if b.lower() in NAMED:
            return (1 + (NAMED.index(b.lower()) > 3), NAMED.index(b.lower()), "", 0, n)
        if m := re.fullmatch(r"(.*?)([0-9]+)(\D*)", b):
            return (4, 0, m[1], int(m[2]), n)
        return (5, 0, b, 0, n)

    return sorted(names, key=key)


def genomic_order(order: list[str], gff: bool = False) -> list[Column]:
    """Sort keys: sequences as they are listed (others first), start and end (in GFF the longer first)."""
    ranks = F.create_map(*[F.lit(x) for k, n in enumerate(order) for x in (n, k)]) if order else None
    rank = F.try_element_at(ranks, F.col("seq_id")) if order else F.lit(0)
    return [rank.asc(), F.col("start").asc(), F.desc("end") if gff else F.asc("end")]


def genomic_sort(df: DataFrame, order: list[str] | None = None, gff: bool = False) -> DataFrame:
    """By sequence in sane order, start and end. The names of sequences are few; without an order they are looked up."""
    if order is None:
        order = sane_order([r[0] for r in df.select("seq_id").distinct().filter("seq_id is not null").collect()])
    return df.orderBy(*genomic_order(order, gff))


def concatenate(*frames: DataFrame) -> DataFrame:
    """Rows of tables with as many columns, by position; names are those of the first."""
    if len({len(f.columns) for f in frames}) != 1:
        raise ValueError("tables to join need the same number of columns")
    return fold(lambda a, b: a.union(b.toDF(*a.columns)), frames)


def split_parts(df: DataFrame, name: str, order: list[str], most: int) -> DataFrame:
    """The part of its value's group that each row is in, of at most so many rows."""
    from .columns import number_within

    return number_within(df, name, order, "_at").withColumn("part", F.ceil(F.col("_at") / most).cast("int")).drop("_at")


def split_rows(df: DataFrame, parts: int, number: str = "_row", rows: int | None = None) -> DataFrame:
    """Parts of as many rows in order of a number from 1 on, the rest in the last."""
    rows = rows if rows is not None else df.count()
    each = max(1, rows // parts)
    return df.withColumn("part", F.least(F.floor((F.col(number) - 1) / each) + 1, F.lit(parts)).cast("int"))


def numbered_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Names that repeat get .1, .2 from the second on, in order."""
    from .columns import number_within

    rows = number_within(df, name, order, "_at", 0)
    return rows.withColumn(name, F.when((F.col("_at") == 0) | F.col(name).isNull(), F.col(name)).otherwise(F.concat_ws(".", name, F.col("_at").cast("string")))).drop("_at")
