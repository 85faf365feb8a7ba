"""Signals, alignments and sequences: (seq_id, start, end, strand, score, name) counting from 1."""

from __future__ import annotations

import re
from configparser import ConfigParser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .annotation import bed, gff
from .binary import bam, big
from .files import data_lines, lines, load, placed_lines


def from_features(features: DataFrame) -> DataFrame:
    return features.select("seq_id", "start", "end", "strand", "score", "name")


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    t = load(spark, path, fmt="bdg").df
    return t.select(F.col("Chromosome").alias("seq_id"), (F.col("Start0").try_cast("long") + 1).alias("start"), F.col("End").try_cast("long").alias("end"), F.lit(0).alias("strand"), F.col("Score").try_cast("double").alias("score"), F.lit(None).cast("string").alias("name"))


def wig(spark: SparkSession, path: str) -> DataFrame:
    """fixedStep, variableStep and bedGraph lines of wiggle files, one at least of the first line of a file.

    Each line takes the declaration before it in its file, or else in the files before by name. A piece of a file that
    Spark reads is gone through on its own; what pieces before it leave open are a row each, brought together.
    """
    rows = placed_lines(spark, path).filter("trim(value) <> '' and not startswith(value, '#') and not value rlike '^(track|browser)\\\\b'")
    piece = ["_file", "_at"]
    get = lambda k: F.regexp_extract("value", rf"\b{k}=(\S+)", 1)
    number = lambda k, d: F.coalesce(get(k).try_cast("long"), F.lit(d))
    marked = rows.withColumns({"_decl": F.when(F.col("value").rlike("^(fixed|variable)Step"), F.struct(F.substring_index("value", " ", 1).alias("kind"), get("chrom").alias("chrom"), number("start", 1).alias("start"), number("step", 1).alias("step"), number("span", 1).alias("span"), F.col("_row").alias("row")))})
    w = Window.partitionBy(*piece).orderBy("_row")
    within = marked.withColumn("d", F.last("_decl", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.count(F.when(F.col("_decl").isNull(), 1)).over(w))
    # what a part of a file takes over from the parts before: a row for each part
    lasts = within.groupBy(*piece).agg(F.max_by("_decl", F.when(F.col("_decl").isNotNull(), F.col("_row"))).alias("l"), F.count(F.when(F.col("_decl").isNull(), 1)).alias("n"), F.max(F.when(F.col("_decl").isNotNull(), F.col("_k"))).alias("kd"))
    o = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("n").over(o), F.lit(0))
    over = lasts.withColumns({"before": total}).withColumn("at", F.when(F.col("l").isNotNull(), F.col("before") + F.col("kd")))
    over = over.select(*piece, "before", F.last("l", True).over(o).alias("carried"), F.last("at", True).over(o).alias("carried_at"))
    full = within.join(F.broadcast(over), piece)
    own_at = F.last(F.when(F.col("_decl").isNotNull(), F.col("before") + F.col("_k")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    full = full.withColumn("at", own_at).withColumns({"decl": F.coalesce("d", "carried"), "at": F.coalesce("at", "carried_at")}).filter("_decl is null")
    cut = F.split(F.trim("value"), r"\s+")
    n = F.size(cut)
    nth = F.col("before") + F.col("_k") - F.col("at") - 1
    fixed = F.col("decl.start") + nth * F.col("decl.step")
    start = F.when(n == 1, fixed).when(n == 2, cut[0].try_cast("long")).otherwise(F.get(cut, 1).try_cast("long") + 1)
    end = F.when(n <= 2, start + F.col("decl.span") - 1).otherwise(F.get(cut, 2).try_cast("long"))
    seq = F.when(n <= 2, F.col("decl.chrom")).otherwise(cut[0])
    return full.select(seq.alias("seq_id"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(0).alias("strand"), F.element_at(cut, -1).try_cast("double").alias("score"), F.lit(None).cast("string").alias("name"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text."""
    rows = lines(spark, path).filter("value <> '' and not startswith(value, '@')")
    cut = F.split("value", "\t")
    size = F.aggregate(F.transform(F.regexp_extract_all(F.get(cut, 5), F.lit("([0-9]+)[MDN=X]"), 1), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    pos = F.get(cut, 3).try_cast("long") - 1
    nh = F.regexp_extract("value", r"\tNH:i:([0-9]+)", 1).try_cast("int")
    mate = F.get(cut, 6)
    return rows.select(F.get(cut, 0).alias("qname"), F.get(cut, 1).try_cast("int").alias("flag"), F.get(cut, 2).alias("seq_id"), pos.alias("pos"), (pos + size).alias("end"), F.get(cut, 4).try_cast("int").alias("mapq"), F.get(cut, 5).alias("cigar"), F.when(mate == "=", F.get(cut, 2)).otherwise(mate).alias("mate_seq_id"), F.get(cut, 8).try_cast("int").alias("isize"), nh.alias("nh"))


def sam_lengths(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """(seq_id, length) of @SQ lines."""
    get = lambda k: F.regexp_extract("value", rf"\t{k}:([^\t]+)", 1)
    found = lines(spark, path).filter("startswith(value, '@SQ')").select(get("SN").alias("seq_id"), get("LN").try_cast("long").alias("length"))
    return found.filter(~F.col("seq_id").rlike(exclude)) if exclude else found


def alignments_as_signal(df: DataFrame) -> DataFrame:
    """Alignments as intervals that count from 1; paired reads have the strand of the first mate."""
    flag = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    reverse = F.when(flag(0x1), F.when(flag(0x40), flag(0x10)).otherwise(~flag(0x10))).otherwise(flag(0x10))
    return df.select("seq_id", (F.col("pos") + 1).alias("start"), "end", F.when(reverse, -1).otherwise(1).alias("strand"), F.lit(1.0).alias("score"), F.col("qname").alias("name"))


def signal_set(spark: SparkSession, folder: str, metadata: str) -> DataFrame:
    """A folder of signal files with a metadata text: stanzas [file] of type, name and strand, which become columns."""
    notes = ConfigParser()
    notes.optionxform = str
    notes.read_string(metadata)
    out = None
    for name in notes.sections():
        own = dict(notes[name])
        code = own.get("strand") or ("1" if re.search(r"[._](f|for|forward|plus)\.", name) else "-1" if re.search(r"[._](r|rev|reverse|minus)\.", name) else "0")
        one = open_signal(spark, f"{folder}/{name}").withColumns({"strand": F.lit(int(code)), "type": F.lit(own.get("type")), "set_name": F.lit(own.get("name") or own.get("display_name"))})
        out = one if out is None else out.unionByName(one)
    return out


def choose_signal(signals: DataFrame, kind: str | None = None, name: str | None = None, strand: int | None = None) -> DataFrame:
    test: Column = F.lit(True)
    if kind:
        test = test & (F.col("type") == kind)
    if name:
        test = test & (F.col("set_name") == name)
    if strand is not None:
        test = test & F.col("strand").isin(0, strand)
    return signals.filter(test)


def open_signal(spark: SparkSession, path: str) -> DataFrame:
    """Any signal by its name; several joined by & are put together."""
    if "&" in path:
        first, *rest = (open_signal(spark, p) for p in path.split("&"))
        for other in rest:
            first = first.unionByName(other)
        return first
    name = re.sub(r"\.(gz|bz2)$", "", path.lower())
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith((".bdg", ".bedgraph")):
        return bedgraph(spark, path)
    if name.endswith(".wig"):
        return wig(spark, path)
    if name.endswith(".sam"):
        return alignments_as_signal(sam(spark, path))
    if name.endswith((".gff", ".gff3", ".gtf")):
        return from_features(gff(spark, path))
    if name.endswith(".bam"):
        return alignments_as_signal(bam(spark, path))
    if name.endswith((".bw", ".bigwig", ".bb", ".bigbed")):
        return big(spark, path)
    if name.endswith((".cram", ".useq", ".wib")):
        raise ValueError(f"{path}: binary signals are read after conversion to parquet, SAM, bedGraph or BED")
    return from_features(bed(spark, path))


def fasta(spark: SparkSession, path: str, size: int = 10_000) -> DataFrame:
    """(seq_id, chunk, text): sequences cut into chunks of a size, numbered from 0.

    Records are read by their > as the separator, so each is whole; a record is then cut up.
    """
    records = spark.read.option("lineSep", ">").text(path).filter("trim(value) <> ''")
    name, body = F.regexp_extract("value", r"^(\S+)", 1), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    rows = records.select(name.alias("seq_id"), body.alias("body"))
    return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("body") - 1, F.lit(0)) / size)))).select("seq_id", "chunk", F.expr(f"substring(body, cast(chunk * {size} + 1 as int), {size})").alias("text"))


def sequence_lengths(chunks: DataFrame, exclude: str | None = None) -> DataFrame:
    found = chunks.groupBy("seq_id").agg(F.sum(F.length("text")).alias("length"))
    return found.filter(~F.col("seq_id").rlike(exclude)) if exclude else found


__all__ = ["alignments_as_signal", "bedgraph", "choose_signal", "data_lines", "fasta", "from_features", "open_signal", "sam", "sam_lengths", "sequence_lengths", "signal_set", "wig"]
