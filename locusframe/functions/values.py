"""Nulls, numbers and text of tables whose columns may all be strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean null.
NULL_TEXTS = ("", ".", "na", "n/a", "nan", "inf", "-inf", "undef")
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def is_null(c: str | Column) -> Column:
    c = col(c)
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*NULL_TEXTS)


def num(c: str | Column) -> Column:
    """A number, or null for any other text; Spark alone would also read 1d or NaN."""
    c = col(c)
    return F.when(c.cast("string").rlike(NUMBER), F.trim(c.cast("string")).try_cast("double"))


def shown(c: str | Column) -> Column:
    """As text, a dot for null."""
    return F.when(is_null(c), ".").otherwise(col(c).cast("string"))


def convert_null(c: str | Column, to, zeros: bool = False) -> Column:
    """The value, or `to` for nulls and, with zeros, for numbers that are zero."""
    c = col(c)
    hit = is_null(c) | (F.coalesce(num(c) == 0, F.lit(False)) if zeros else F.lit(False))
    return F.when(hit, F.lit(to)).otherwise(c)


def absolute(c) -> Column:
    return F.abs(num(c))


def minimum(c, low) -> Column:
    """Numbers below low become low."""
    return F.when(num(c) < low, F.lit(float(low))).otherwise(num(c))


def maximum(c, high) -> Column:
    return F.when(num(c) > high, F.lit(float(high))).otherwise(num(c))


def log(c, base: float = 2, zero=None) -> Column:
    """Null (or zero=...) for 0 and for negative numbers."""
    v = num(c)
    return F.when(v > 0, F.ln(v) / F.ln(F.lit(float(base)))).when(v == 0, F.lit(zero).cast("double"))


def delog(c, base: float = 2) -> Column:
    return F.pow(F.lit(float(base)), num(c))


def fixed(c, digits: int) -> Column:
    """Rounded to digits, halves to even, as text with all digits."""
    v = F.rint(num(c)) if digits == 0 else F.bround(num(c), digits)
    return F.format_string(f"%.{digits}f", v)


def ratio(a, b, logged: bool = False) -> Column:
    """a / b, or the difference of logarithms; null if either is null or b is zero."""
    return num(a) - num(b) if logged else F.try_divide(num(a), num(b))


def difference(a, b) -> Column:
    return num(a) - num(b)


def strand(c: str | Column) -> Column:
    """-1, 0 or 1 from signs, numbers and the codes 2 and *."""
    s = F.trim(col(c).cast("string"))
    return F.when(s.isin("-", "-1", "2"), -1).when(s.isin("+", "1", "+1"), 1).otherwise(0)


def strand_sign(c: str | Column, none: str = ".") -> Column:
    s = col(c)
    return F.when(s > 0, "+").when(s < 0, "-").otherwise(none)


def midpoint(start, end) -> Column:
    return F.floor((col(start) + col(end)) / 2).cast("long")


def length(start, end) -> Column:
    return col(end) - col(start) + 1


def peak(start, end, summit) -> Column:
    """1-based place of a summit that counts from the start, or the midpoint where there is none."""
    return F.when(col(summit) >= 0, col(start) + col(summit)).otherwise(midpoint(start, end)).cast("long")


def coordinate(seq, start, end) -> Column:
    return F.concat(col(seq), F.lit(":"), col(start).cast("string"), F.lit("-"), col(end).cast("string"))


def parse_coordinate(c) -> Column:
    """struct(seq_id, start, end, strand) of chr:start-end, chr:start..end, with commas and a strand if any."""
    text = F.regexp_replace(col(c), ",", "")
    part = lambda k: F.regexp_extract(text, r"^(\S+):([0-9]+)(?:-|\.\.)([0-9]+)(?::([+\-.]))?$", k)
    return F.struct(F.nullif(part(1), F.lit("")).alias("seq_id"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end"), strand(part(4)).alias("strand"))


def reverse_complement(c) -> Column:
    return F.reverse(F.translate(col(c), "gatcGATC", "ctagCTAG"))


def url_encode(c) -> Column:
    """Percent codes for the characters that attribute columns keep for themselves."""
    out = F.regexp_replace(col(c), "%", "%25")
    for mark, code in (("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"), ("&", "%26"), ("=", "%3D"), (";", "%3B"), (",", "%2C"), (" ", "%20")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def url_decode(c) -> Column:
    return F.try_url_decode(col(c))


def attributes(c, pair: str = ";", key: str = "=") -> Column:
    """A map of k=v; attributes, the last of repeated keys; surrounding blanks and empty pieces go."""
    pieces = F.filter(F.transform(F.split(col(c), pair), lambda p: F.trim(p)), lambda p: p.contains(key) if key != " " else p.contains(" "))
    cut = lambda p: F.struct(F.trim(F.substring_index(p, key, 1)).alias("key"), F.trim(F.regexp_replace(p, rf"^[^{key}]*{key}", "")).alias("value"))
    pairs = F.transform(pieces, cut)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def write_attributes(c: Column) -> Column:
    """k=v;... of a map: ID and Name first, the others in order."""
    rank = lambda e: F.when(e["key"] == "ID", "0").when(e["key"] == "Name", "1").otherwise(F.concat(F.lit("2"), e["key"]))
    rows = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(rank(e).alias("r"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.array_join(F.transform(rows, lambda e: F.concat(e["key"], F.lit("="), url_encode(e["value"]))), ";")


def with_commas(c) -> Column:
    """Thousands set apart, sign and decimals as they are."""
    text = col(c).cast("string")
    whole = F.regexp_extract(text, r"^(-?[0-9]+)", 1)
    out = F.reverse(F.regexp_replace(F.reverse(whole), r"([0-9]{3})(?=[0-9])", "$1,"))
    return F.concat(out, F.substring(text, F.length(whole) + 1, F.length(text)))


# ---- on the driver -------------------------------------------------------------------------------


def parse_list(text: str) -> list[int]:
    """1,2,5-7 as numbers."""
    out: list[int] = []
    for piece in filter(None, (p.strip() for p in text.split(","))):
        low, dash, high = piece.partition("-")
        out.extend(range(int(low), int(high) + 1) if dash else [int(low)])
    return out


def column_letters(index: int) -> str:
    """1 is a, 27 is aa."""
    out = ""
    while index > 0:
        index, rest = divmod(index - 1, 26)
        out = chr(97 + rest) + out
    return out


def column_index(letters: str) -> int:
    out = 0
    for c in letters.lower():
        out = out * 26 + ord(c) - 96
    return out


def simple_name(path: str) -> str:
    """A data set's name without folders, known extensions and processing suffixes; each of several joined by &."""
    import re

    if "&" in path:
        return "&".join(simple_name(p) for p in path.split("&"))
    name = path.rpartition("/")[2].removeprefix("file:")
    name = re.sub(r"(?i)\.gz$", "", name)
    name = re.sub(r"(?i)\.(bw|bigwig|bb|bigbed|bam|cram|sam|bdg|bedgraph|bed|wig|gff3?|gtf|useq|txt|tsv|csv|narrowpeak|broadpeak|parquet)$", "", name)
    while (shorter := re.sub(r"(?i)[._](sort(ed)?|dedup|rmdup|mark(ed)?dup|bw|uni(que)?|filt(ered)?)$", "", name)) != name:
        name = shorter
    return name
