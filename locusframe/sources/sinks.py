"""Features, signals and sequences as lines of text, and files of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import strand_sign, url_encode, write_attributes
from ..model import FeatureTable


def write_lines(df: DataFrame, path: str, order: list[str] | None = None, compression: str = "none", header: list[str] | None = None) -> None:
    """A folder of text files of the column line, in order if one is given."""
    rows = df.orderBy(*order).select("line") if order else df.select("line")
    rows.write.mode("overwrite").option("compression", compression).text(path)
    if header:
        df.sparkSession.createDataFrame([(h,) for h in header], "line string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".header")


def write_table(table: FeatureTable, path: str, simple: bool = False, compression: str = "none", sep: str = "\t") -> None:
    """Columns as text with a heading; dots (simple: nothing) for nulls. What the table says of itself goes in a folder beside it."""
    names = [c for c in table.df.columns if c != "_row"]
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("" if simple else ".")).alias(c) for c in names]
    table.df.select(*columns).write.mode("overwrite").option("sep", sep).option("header", table.meta.headers).option("compression", compression).option("quote", "").csv(path)
    if not simple:
        m = table.meta
        notes = [f"# {k.capitalize()} {v}" for k, v in (("program", m.program), ("feature", m.feature), ("database", m.database)) if v]
        notes += [f"# Column_{i + 1} " + ";".join(f"{k}={v}" for k, v in {"name": c, **m.columns.get(c, {})}.items()) for i, c in enumerate(names) if c in m.columns]
        if notes:
            table.df.sparkSession.createDataFrame([(n,) for n in notes], "line string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".meta")


def bed_line(columns: int = 6, name: Column | None = None, score: Column | None = None) -> Column:
    """A BED line of 3 to 6 columns; a start behind its end means the reverse strand."""
    low, high = F.least("start", "end"), F.greatest("start", "end")
    st = F.when(F.col("start") > F.col("end"), -1).otherwise(F.col("strand"))
    parts = [F.col("seq_id"), (low - 1).cast("string"), high.cast("string"), F.coalesce(name if name is not None else F.col("name"), F.lit(".")), F.coalesce((score if score is not None else F.col("score")).cast("string"), F.lit("1")), strand_sign(st, "+")]
    return F.concat_ws("\t", *parts[:columns])


def gff3_line() -> Column:
    """A GFF3 line of features with source, phase and an attributes map; id and name lead, parents are merged."""
    given = F.map_filter("attributes", lambda k, v: ~k.isin("ID", "Name", "Parent"))
    pairs = F.array_compact(F.array(F.when(F.col("id").isNotNull(), F.concat(F.lit("ID="), url_encode("id"))), F.when(F.col("name").isNotNull(), F.concat(F.lit("Name="), url_encode("name"))), F.when(F.size("parents") > 0, F.concat(F.lit("Parent="), F.array_join(F.transform("parents", url_encode), ",")))))
    rest = write_attributes(given)
    text = lambda c, none=".": F.coalesce(F.col(c).cast("string"), F.lit(none))
    return F.concat_ws("\t", "seq_id", text("source"), text("type"), text("start"), text("end"), text("score"), strand_sign("strand"), text("phase"), F.concat_ws(";", F.array_join(pairs, ";"), F.when(rest != "", rest)))


def merged_children(features: DataFrame) -> DataFrame:
    """Each part once, with all the parents that share it: rows of (transcript_id, type, seq_id, start, end, strand, phase)."""
    return features.groupBy("type", "seq_id", "start", "end", "strand", "phase").agg(F.array_sort(F.collect_set("transcript_id")).alias("parents"))


def gtf_line(gene: str = "gene_id", transcript: str = "transcript_id") -> Column:
    """A GTF line of an exon, CDS or codon."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return F.concat_ws("\t", "seq_id", text("source"), "type", text("start"), text("end"), text("score"), strand_sign("strand"), text("phase"), F.format_string('gene_id "%s"; transcript_id "%s";', gene, transcript))


def exon_lists(transcripts: DataFrame, ex: DataFrame) -> DataFrame:
    """Transcripts with their exons from the left, an array of (start, end)."""
    lists = ex.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))
    return transcripts.join(lists, "transcript_id")


def ref_flat_line() -> Column:
    """A refFlat line of a transcript with gene_name, exons and coding bounds; without any, both are the end."""
    cs = F.coalesce(F.col("cds_start") - 1, F.col("end"))
    many = lambda f: F.concat(F.array_join(F.transform("exons", f), ","), F.lit(","))
    return F.concat_ws("\t", "gene_name", "transcript_id", "seq_id", strand_sign("strand", "+"), (F.col("start") - 1).cast("string"), F.col("end").cast("string"), cs.cast("string"), F.coalesce("cds_stop", "end").cast("string"), F.size("exons").cast("string"), many(lambda e: (e["start"] - 1).cast("string")), many(lambda e: e["end"].cast("string")))


def bed12_line(score: int = 1000, color: str = "0,0,0") -> Column:
    cs = F.coalesce(F.col("cds_start") - 1, F.col("end"))
    many = lambda f: F.array_join(F.transform("exons", f), ",")
    return F.concat_ws("\t", "seq_id", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), "transcript_id", F.lit(str(score)), strand_sign("strand", "+"), cs.cast("string"), F.coalesce("cds_stop", "end").cast("string"), F.lit(color), F.size("exons").cast("string"), many(lambda e: (e["end"] - e["start"] + 1).cast("string")), many(lambda e: (e["start"] - F.col("start")).cast("string")))


def bedgraph_line() -> Column:
    """Of runs (seq_id, lo, hi, value) in bins or bases from 0."""
    return F.concat_ws("\t", "seq_id", F.col("lo").cast("string"), (F.col("hi") + 1).cast("string"), F.col("value").cast("string"))


def combined(signal: DataFrame, how: str = "mean") -> DataFrame:
    """Scores at the same place as one: mean, median, sum or max."""
    way = {"mean": F.avg, "sum": F.sum, "max": F.max, "median": lambda c: F.percentile(c, 0.5)}[how]
    return signal.groupBy("seq_id", "start").agg(F.max("end").alias("end"), way("score").alias("score"))


def wig_lines(signal: DataFrame, kind: str = "variable", step: int = 1, span: int = 1, zeros: bool = True, region: int = 1_000_000) -> DataFrame:
    """(seq_id, start, part, line) of a wiggle file: order by the first three. A declaration stands before each block.

    fixed: a block goes on as long as starts are a step apart. variable: a block is a sequence. The start before a row
    is looked up in its region, and before the first of a region in the last start of those before.
    """
    rows = (signal if zeros else signal.filter("score <> 0")).withColumn("_r", F.floor(F.col("start") / region))
    w = Window.partitionBy("seq_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("seq_id", "_r").agg(F.max("start").alias("_m")).withColumn("_carried", F.max("_m").over(w)).drop("_m")
    inner = Window.partitionBy("seq_id", "_r").orderBy("start")
    before = F.coalesce(F.lag("start").over(inner), F.col("_carried"))
    rows = rows.join(ends, ["seq_id", "_r"]).withColumn("_before", before)
    opens = F.col("_before").isNull() | (F.col("start") != F.col("_before") + step) if kind == "fixed" else F.col("_before").isNull()
    text = F.format_string("fixedStep chrom=%s start=%d step=%d span=%d", "seq_id", "start", F.lit(step), F.lit(span)) if kind == "fixed" else F.format_string("variableStep chrom=%s span=%d", "seq_id", F.lit(span))
    value = F.col("score").cast("string") if kind == "fixed" else F.concat_ws(" ", F.col("start").cast("string"), F.col("score").cast("string"))
    both = F.array_compact(F.array(F.when(opens, F.struct(F.lit(0).alias("part"), text.alias("line"))), F.struct(F.lit(1).alias("part"), value.alias("line"))))
    return rows.select("seq_id", "start", both.alias("_b")).select("seq_id", "start", F.explode("_b").alias("_l")).select("seq_id", "start", "_l.part", "_l.line")


def wrapped(c: str | Column, width: int = 60) -> Column:
    """Text in lines of a width."""
    return F.regexp_replace(F.regexp_replace(c, rf"(.{{{width}}})", "$1\n"), r"\n$", "")


def fasta_record(name: str = "name", sequence: str = "sequence", width: int = 60) -> Column:
    return F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped(F.col(sequence), width))


def fasta_joined(df: DataFrame, by: str, order: list[str], pad: int = 0, sequence: str = "sequence") -> DataFrame:
    """(by, sequence): the sequences of a group as one, with Ns between."""
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, sequence))).alias("p"))
    return rows.select(by, F.array_join(F.transform("p", lambda x: x[sequence]), "N" * pad).alias("sequence"))


def chromosome_lines(lengths: DataFrame) -> DataFrame:
    return lengths.select(F.concat_ws("\t", "seq_id", F.col("length").cast("string")).alias("line"))


def write_groups(df: DataFrame, groups: dict[str, str], path: str) -> None:
    """A file that says which data set each column of a table is from: names and groups, for what draws them together."""
    rows = [(f"{c}\t{groups[c]}",) for c in df.columns if c in groups]
    df.sparkSession.createDataFrame([("Name\tDataset",), *rows], "line string").coalesce(1).write.mode("overwrite").text(path)
