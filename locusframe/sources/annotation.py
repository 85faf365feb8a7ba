"""Features from BED, GFF, GTF, gene tables and VCF, as intervals that count from 1."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import attributes, strand
from ..operators.rows import numbered_names
from .files import data_lines, head, lines, load, taste


def parse(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    """Features of any of the formats; with a feature only types that match it."""
    kind = (taste(head(spark, path), path) or ("", ""))[1]
    if kind.startswith(("bed", "narrow", "broad", "gapped")) or kind == "bdg":
        found = bed(spark, path)
    elif kind in ("gff3", "gff2", "gtf"):
        found = gff(spark, path)
    elif kind == "vcf":
        found = vcf(spark, path)
    else:
        found = ucsc_parts(ucsc(spark, path))
    return found.filter(F.col("type").rlike(f"(?i){feature}")) if feature else found


def _long(c: str) -> Column:
    return F.col(c).try_cast("long")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """BED of 3 to 12 columns, bedGraph and peaks. id: chr:start0-end, with a number from the second on; peak: summit from 1."""
    t = load(spark, path)
    have = t.df.columns
    start = _long("Start0") + 1
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    place = F.concat("Chromosome", F.lit(":"), "Start0", F.lit("-"), "End")
    kind = {"narrowPeak": "peak", "broadPeak": "peak", "gappedPeak": "gappedPeak"}.get(t.meta.format, "region")
    summit = F.when(text("peak").try_cast("long") >= 0, start + text("peak").try_cast("long")) if "peak" in have else F.lit(None).cast("long")
    out = t.df.select(
        "_row", F.col("Chromosome").alias("seq_id"), start.alias("start"), _long("End").alias("end"), (strand("Strand") if "Strand" in have else F.lit(0)).alias("strand"),
        text("Name").alias("name"), place.alias("id"), F.lit(kind).alias("type"), text("Score").try_cast("double").alias("score"), summit.alias("peak"),
        *[F.col(c) for c in have if c in ("thickStart0", "thickEnd", "blockSizes", "blockStarts0", "signalValue", "pValue", "qValue")],
    )
    return numbered_names(out, "id", ["_row"])


def numbers(c: str) -> Column:
    return F.transform(F.filter(F.split(F.col(c), ","), lambda x: F.trim(x) != ""), lambda x: x.try_cast("long"))


def bed_blocks(features: DataFrame) -> DataFrame:
    """Exons of BED12 rows, with CDS and UTRs from the thick part."""
    at = F.arrays_zip(numbers("blockStarts0").alias("s"), numbers("blockSizes").alias("n"))
    ex = features.withColumn("_b", F.explode(at)).select(F.col("id").alias("transcript_id"), "seq_id", "strand", (F.col("start") + F.col("_b.s")).alias("start"), (F.col("start") + F.col("_b.s") + F.col("_b.n") - 1).alias("end"), (_long("thickStart0") + 1).alias("_cs"), _long("thickEnd").alias("_ce"))
    return _with_cds(ex)


def _with_cds(ex: DataFrame) -> DataFrame:
    """exon, CDS and UTR rows of exons with coding bounds _cs.._ce (none where _cs > _ce)."""
    s, e, a, b, st = F.col("start"), F.col("end"), F.col("_cs"), F.col("_ce"), F.col("strand")
    coding = a <= b
    piece = lambda t, lo, hi, ok: F.when(ok & (lo <= hi), F.struct(t.alias("type"), lo.alias("start"), hi.alias("end")))
    left = F.when(st >= 0, "five_prime_UTR").otherwise("three_prime_UTR")
    right = F.when(st >= 0, "three_prime_UTR").otherwise("five_prime_UTR")
    pieces = F.array_compact(F.array(piece(F.lit("exon"), s, e, F.lit(True)), piece(F.lit("CDS"), F.greatest(s, a), F.least(e, b), coding), piece(left, s, F.least(e, a - 1), coding), piece(right, F.greatest(s, b + 1), e, coding)))
    return ex.withColumn("_p", F.explode(pieces)).select("transcript_id", "seq_id", "strand", F.col("_p.type").alias("type"), F.col("_p.start").alias("start"), F.col("_p.end").alias("end"))


def gff(spark: SparkSession, path: str, types: str | None = None) -> DataFrame:
    """Rows of GFF3, GFF2 or GTF with an attributes map, id, name and parents; a FASTA section at the end is left out.

    types: a pattern of feature types to keep, tested before attributes are read.
    """
    kind = (taste(head(spark, path), path) or ("gff", "gff3"))[1]
    df = load(spark, path, fmt="gff").df.filter("Start is not null")
    if types:
        df = df.filter(F.col("Type").rlike(f"(?i)^({types})$"))
    raw = F.coalesce("Group", F.lit(""))
    if kind == "gff3":
        found = attributes(raw)
        found = F.transform_values(F.transform_keys(found, lambda k, v: F.try_url_decode(k)), lambda k, v: F.coalesce(F.try_url_decode(v), v))
    else:
        found = F.transform_values(attributes(raw, ";", " "), lambda k, v: F.regexp_replace(v, '^"|"$', ""))
    out = df.select("_row", F.col("Chromosome").alias("seq_id"), F.col("Source").alias("source"), F.col("Type").alias("type"), _long("Start").alias("start"), _long("Stop").alias("end"), F.col("Score").try_cast("double").alias("score"), strand("Strand").alias("strand"), F.col("Phase").try_cast("int").alias("phase"), found.alias("attributes"))
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    if kind == "gtf":
        own = F.lower("type")
        ident = F.when(own == "gene", get("gene_id")).when(own.isin("transcript", "mrna"), get("transcript_id")).otherwise(F.concat_ws(".", get("transcript_id"), own, "start"))
        parent = F.when(own.isin("transcript", "mrna"), F.array(get("gene_id"))).when(own != "gene", F.array(F.coalesce(get("transcript_id"), get("gene_id"))))
        name = F.when(own == "gene", get("gene_name")).otherwise(get("transcript_name"))
    else:
        ident = F.coalesce(get("ID"), get("exon_id"), F.concat_ws(".", "type", F.col("_row").cast("string")))
        parent = F.transform(F.split(get("Parent"), ","), lambda p: F.trim(p))
        name = get("Name")
    return out.withColumns({"id": ident, "name": name, "parents": F.coalesce(parent, F.array().cast("array<string>"))})


def gff_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, length) of ##sequence-region lines."""
    m = lambda k: F.regexp_extract("value", r"^##sequence-region\s+(\S+)\s+(\d+)\s+(\d+)", k)
    return lines(spark, path).filter("startswith(value, '##sequence-region')").select(m(1).alias("seq_id"), m(3).try_cast("long").alias("length"))


def links(features: DataFrame) -> DataFrame:
    """(parent_id, child): a row for each parent that a feature names."""
    return features.withColumn("parent_id", F.explode("parents"))


def orphans(features: DataFrame) -> DataFrame:
    """Features that name a parent that isn't there."""
    return links(features).join(features.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_anti")


def gene_tables(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """genes, transcripts and parts of GFF or GTF features; genes and transcripts that only their parts name are made, with bounds of those."""
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    low = F.lower("type")
    is_gene = low.rlike("gene$")
    is_part = low.rlike("^(exon|cds|.*utr.*|start_codon|stop_codon)$")
    parts = links(features.filter(is_part)).select(F.col("parent_id").alias("transcript_id"), "type", "seq_id", "start", "end", "strand", "phase", get("gene_id").alias("_gene"), get("gene_name").alias("_name"))
    biotype = F.coalesce(get("transcript_biotype"), get("transcript_type"), get("biotype"))
    given = links(features.filter(low.rlike("rna$|^transcript$"))).select(F.col("id").alias("transcript_id"), F.col("parent_id").alias("gene_id"), "name", "seq_id", "start", "end", "strand", "type", biotype.alias("biotype"), get("transcript_support_level").alias("tsl"), F.split(F.coalesce(get("tag"), F.lit("")), ",").alias("tags"))
    bounds = (F.min("start").alias("start"), F.max("end").alias("end"))
    made = parts.join(given.select("transcript_id"), "transcript_id", "left_anti").groupBy("transcript_id", "seq_id", "strand").agg(F.coalesce(F.first("_gene", True), F.col("transcript_id")).alias("gene_id"), F.first("_name", True).alias("name"), *bounds)
    transcripts = given.unionByName(made.withColumn("type", F.lit("transcript")), allowMissingColumns=True)
    genes = features.filter(is_gene).select(F.col("id").alias("gene_id"), "name", "seq_id", "start", "end", "strand")
    more = transcripts.join(genes.select("gene_id"), "gene_id", "left_anti").groupBy("gene_id", "seq_id", "strand").agg(F.first("name", True).alias("name"), *bounds)
    return genes.unionByName(more), transcripts, parts.drop("_gene", "_name")


def ucsc(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of a gene table: name, gene name, bounds, coding bounds, exon starts and ends, and a type."""
    t = load(spark, path).df
    have = t.columns
    gene = F.col("name2") if "name2" in have else F.col("name")
    cs, ce = _long("cdsStart0") + 1, _long("cdsEnd")
    low = F.lower(gene)
    kind = F.when(cs <= ce, "mRNA").when(low.rlike("^mir"), "miRNA").when(low.rlike("^snor"), "snoRNA").when(low.rlike("^sn|^u\\d"), "snRNA").otherwise("ncRNA")
    return t.select("_row", F.col("name").alias("transcript_id"), gene.alias("gene_name"), F.col("chrom").alias("seq_id"), strand("strand").alias("strand"), (_long("txStart0") + 1).alias("start"), _long("txEnd").alias("end"), cs.alias("cds_start"), ce.alias("cds_stop"), numbers("exonStarts0").alias("exon_starts0"), numbers("exonEnds").alias("exon_ends"), kind.alias("type"))


def ucsc_genes(transcripts: DataFrame) -> DataFrame:
    """Transcripts with a gene_id: those of one name, sequence and strand that overlap are one gene; the next is name.1."""
    from pyspark.sql import Window

    w = Window.partitionBy("gene_name", "seq_id", "strand").orderBy("start", "end", "transcript_id")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = transcripts.withColumn("_o", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    named = opens.withColumn("_k", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = named.groupBy("gene_name", "seq_id", "strand", "_k").agg(F.min("start").alias("_s"))
    at = F.row_number().over(Window.partitionBy("gene_name").orderBy("seq_id", "_s", "strand")) - 1
    ids = islands.withColumn("gene_id", F.when(at == 0, F.col("gene_name")).otherwise(F.concat_ws(".", "gene_name", at.cast("string")))).drop("_s")
    return named.join(ids, ["gene_name", "seq_id", "strand", "_k"]).drop("_o", "_k")


def ucsc_parts(transcripts: DataFrame) -> DataFrame:
    """exon, CDS and UTR rows of the transcripts of a gene table."""
    at = F.arrays_zip(F.col("exon_starts0").alias("s"), F.col("exon_ends").alias("e"))
    ex = transcripts.withColumn("_b", F.explode(at)).select("transcript_id", "seq_id", "strand", (F.col("_b.s") + 1).alias("start"), F.col("_b.e").alias("end"), F.col("cds_start").alias("_cs"), F.col("cds_stop").alias("_ce"))
    return _with_cds(ex)


def with_side_table(transcripts: DataFrame, side: DataFrame, column: str, key: str = "transcript_id") -> DataFrame:
    """A column from a table (key, value) beside the genes, its first row of each key."""
    one = side.groupBy(F.col("key").alias(key)).agg(F.min_by("value", "_row").alias(column))
    return transcripts.join(one, key, "left")


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants: as long as their alternative, with an INFO map and a map for each sample."""
    t = load(spark, path).df
    samples = [c for c in t.columns[t.columns.index("INFO") + 1 :] if c != "FORMAT"] if "INFO" in t.columns else []
    start = _long("POS")
    info = F.map_from_entries(F.array_distinct(F.transform(F.filter(F.split(F.coalesce("INFO", F.lit("")), ";"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("1").alias("value")))))
    of = lambda c: F.map_from_entries(F.transform(F.arrays_zip(F.split("FORMAT", ":").alias("k"), F.split(F.col(f"`{c}`"), ":").alias("v")), lambda z: F.struct(z["k"].alias("key"), z["v"].alias("value"))))
    size = F.length(F.substring_index("ALT", ",", 1))
    out = [F.col("CHROM").alias("seq_id"), start.alias("start"), (start + F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)) - 1).alias("end"), F.lit(0).alias("strand"), F.coalesce("ID", F.concat_ws(":", "CHROM", "POS")).alias("name"), F.col("ID").alias("id"), F.lit("variant").alias("type"), F.col("QUAL").try_cast("double").alias("score"), "REF", "ALT", info.alias("info")]
    return t.select("_row", *out, *[of(c).alias(f"sample_{re.sub(r'\\W', '_', c)}") for c in samples])


__all__ = ["bed", "bed_blocks", "data_lines", "gene_tables", "gff", "gff_lengths", "links", "orphans", "parse", "ucsc", "ucsc_genes", "ucsc_parts", "vcf", "with_side_table"]
