"""Tab-delimited files: what they are, and their rows as strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import SCHEMAS, FeatureTable, TableMeta

#: Lines looked at to tell what a file is.
TASTE = 40
EXTENSIONS = r"\.(txt|tsv|bed|bed\d+|bdg|bedgraph|narrowpeak|broadpeak|gappedpeak|gff3?|gtf|vcf|sgr|refflat|genepred|ucsc|sam|wig)(\.(gz|bz2))?$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(_row, value) of the lines of text files, compressed or not, numbered in the order of reading."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("_row"), "value")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _at, _row, value): lines with the number of their file by name, and the byte at which their piece of it begins.

    In a piece, lines go by _row. Pieces go by _file and _at: they are read by size, so the last of a file may come after other files.
    """
    name = F.col("_metadata.file_path").alias("_path")
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_row"), name, F.col("_metadata.file_block_start").alias("_at"))
    # a row for each file
    found = spark.read.text(path).select(name).distinct().select("_path", F.row_number().over(Window.orderBy("_path")).alias("_file"))
    return rows.join(F.broadcast(found), "_path").select("_file", "_at", "_row", "value")


def head(spark: SparkSession, path: str, n: int = TASTE) -> list[str]:
    return [r[0] for r in spark.read.text(path).limit(n).collect()]


def existing(spark: SparkSession, path: str) -> str:
    """The path, or the first of those with an extension added that is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for extra in ("", ".gz", ".txt", ".txt.gz", ".bed", ".bed.gz"):
        at = hadoop(path + extra)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return path + extra
    raise FileNotFoundError(path)


def taste(sample: list[str], path: str = "") -> tuple[str, str] | None:
    """(flavour, format) of a file from its name and first lines: gff, bed, ucsc, vcf, sam, wig, fasta; None for plain text."""
    name = re.sub(r"\.(gz|bz2)$", "", path.lower())
    first = next((s for s in sample if s.strip()), "")
    if first.startswith("##gff-version") or re.search(r"\.gff3?$|\.gtf$", name):
        attribute = next((s.split("\t")[8] for s in sample if s.count("\t") == 8 and not s.startswith("#")), "")
        return "gff", "gtf" if name.endswith("gtf") or re.match(r'\s*\w+ "', attribute) else "gff3" if "=" in attribute or not attribute else "gff2"
    if first.startswith("##fileformat=VCF") or name.endswith(".vcf"):
        return "vcf", "vcf"
    if re.match(r"@(HD|SQ|RG|PG|CO)\t", first) or name.endswith(".sam"):
        return "sam", "sam"
    if first.startswith(">"):
        return "fasta", "fasta"
    if any(re.match(r"(fixedStep|variableStep)\b", s) for s in sample) or name.endswith(".wig"):
        return "wig", "wig"
    rows = [s.split("\t") for s in sample if s.strip() and not re.match(r"#|track|browser", s)][:10]
    if not rows:
        return None
    n = len(rows[0])
    if any(len(r) != n for r in rows):
        return None
    whole = lambda r, *at: all(re.fullmatch(r"-?\d+", r[k]) for k in at)
    track = next((s for s in sample if s.startswith("track")), "")
    for kind, columns in (("narrowPeak", 10), ("broadPeak", 9), ("gappedPeak", 15)):
        if (name.endswith(kind.lower()) or f"type={kind}" in track) and n == columns:
            return "bed", kind
    if n == 9 and all(whole(r, 3, 4) and r[6] in "+-.?" and r[7] in ("0", "1", "2", ".") for r in rows):
        return "gff", "gff2"
    listed = r"[\d,]+"
    for kind, columns, at, strand in (("genePredExt16", 16, (4, 5, 6, 7, 8), 3), ("genePredExt15", 15, (3, 4, 5, 6, 7), 2), ("knownGene", 12, (3, 4, 5, 6, 7), 2), ("refFlat", 11, (4, 5, 6, 7, 8), 3), ("genePred", 10, (3, 4, 5, 6, 7), 2)):
        if n == columns and all(whole(r, *at) and r[strand] in "+-." and re.fullmatch(listed, r[at[-1] + 1]) for r in rows):
            return "ucsc", kind
    if n == 10 and all(whole(r, 1, 2, 4, 5) for r in rows):
        return "bed", "bedpe"
    if n == 4 and all(whole(r, 1, 2) and re.fullmatch(r"-?[\d.eE+-]+", r[3]) for r in rows) and (re.search(r"bdg|bedgraph", name) or "bedGraph" in track):
        return "bed", "bdg"
    if n in (3, 4, 5, 6, 12) and all(whole(r, 1, 2) and (n < 6 or r[5] in "+-.") for r in rows):
        return "bed", f"bed{n}"
    if n == 3 and name.endswith(".sgr"):
        return "sgr", "sgr"
    return None


def fields(df: DataFrame, names: tuple[str, ...] | list[str]) -> DataFrame:
    """Columns from the tab-separated line; missing ones are null, more than the names an error when read, dots null."""
    cut = F.split("value", "\t", -1)
    extra = F.raise_error(F.concat(F.lit("too many columns: "), F.col("value"))).cast("string")

    def piece(k: int) -> Column:
        return F.nullif(F.nullif(F.get(cut, k), F.lit(".")), F.lit(""))

    columns = [piece(k).alias(c) for k, c in enumerate(names)]
    columns[0] = F.when(F.size(cut) > len(names), extra).otherwise(piece(0)).alias(names[0])
    return df.select("_row", *columns)


def data_lines(df: DataFrame) -> DataFrame:
    return df.filter("trim(value) <> '' and not startswith(value, '#') and not value rlike '^(track|browser)\\\\b'")


def column_notes(sample: list[str]) -> dict[str, dict[str, str]]:
    """What comment lines like `# Column_3 name=Score;method=mean` say of columns."""
    out = {}
    for s in sample:
        if m := re.match(r"# Column_?(\d+)[: ]+(.*)", s):
            pairs = dict(p.split("=", 1) for p in m[2].split(";") if "=" in p)
            out[pairs.get("name", m[1])] = pairs
    return out


def load(spark: SparkSession, path: str, header: bool | None = None, fmt: str | None = None) -> FeatureTable:
    """Any tab-delimited file as a table of strings with fixed columns where its format has them.

    Other files have their column names in the first line that is no comment (or in the last comment, if it has as many).
    """
    path = existing(spark, path)
    sample = head(spark, path)
    found = ("given", fmt) if fmt else taste(sample, path)
    kind = found[1] if found else None
    if kind in ("gff3", "gff2", "gtf"):
        kind = "gff"
    body = data_lines(lines(spark, path))
    notes = [s[1:].strip() for s in sample if s.startswith("#")]
    meta = TableMeta(format=found[1] if found else None, path=path, comments=notes, columns=column_notes(sample))
    for s in sample:
        if m := re.match(r"# (Program|Feature|Database)[: ]+(.*)", s):
            setattr(meta, m[1].lower(), m[2].strip())
    if kind in SCHEMAS:
        meta.headers, meta.interbase = False, any(c.endswith("0") for c in SCHEMAS[kind])
        return FeatureTable(fields(body, SCHEMAS[kind]), meta)
    if kind == "vcf":
        names = next((s.lstrip("#").split("\t") for s in sample if s.startswith("#CHROM")), None)
        return FeatureTable(fields(body, names or ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]), meta)
    rows = [s for s in sample if s.strip() and not re.match(r"#|track|browser", s)]
    first = rows[0].split("\t") if rows else [""]
    if header is False:
        names = [f"Column{k + 1}" for k in range(len(first))]
    else:
        comment = next((s.lstrip("# ").split("\t") for s in reversed(sample) if s.startswith("#") and s.count("\t") == len(first) - 1 and len(first) > 1), None)
        names = comment or first
        if len(rows) > 1 and rows[1].count("\t") == len(names) and not comment:  # row names without a heading
            names = ["Row", *names]
        if names is not comment:
            top = body.agg(F.min("_row")).first()[0]
            body = body.filter(F.col("_row") > (-1 if top is None else top))
    names = [n if names.index(n) == k else f"{n}_{k + 1}" for k, n in enumerate(names)]
    meta.headers, meta.interbase = header is not False, any(re.fullmatch(r"(?i).*start0", n) for n in names)
    return FeatureTable(fields(body, names), meta)


def stream(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Files of one form as they come into a folder; the same column functions work on it."""
    rows = spark.readStream.text(folder).select(F.lit(None).cast("long").alias("_row"), "value")
    return fields(data_lines(rows), names)
