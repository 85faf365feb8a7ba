"""The way in: tables, features and signals by path, and lookups among features."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import length, midpoint
from .model import FeatureTable, TableMeta
from .operators import genes as G
from .sources import annotation, files, signal, sinks


def load(spark: SparkSession, path: str, header: bool | None = None) -> FeatureTable:
    return files.load(spark, path, header)


def parse(spark: SparkSession, path: str, feature: str | None = None) -> FeatureTable:
    """Features of an annotation file as Primary_ID, Name and the rest, of types that match."""
    df = annotation.parse(spark, path, feature)
    if "id" in df.columns:
        df = df.withColumnsRenamed({"id": "Primary_ID", "name": "Name"})
    return FeatureTable(df, TableMeta(feature=feature, database=f"Parsed:{path}", path=path))


def new(spark: SparkSession, columns: list[str], feature: str | None = None) -> FeatureTable:
    """An empty table."""
    return FeatureTable(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns) or "Name string"), TableMeta(feature=feature))


def new_bed(spark: SparkSession) -> FeatureTable:
    from .model import SCHEMAS

    return new(spark, list(SCHEMAS["bed6"]))


def open_signal(spark: SparkSession, path: str) -> DataFrame:
    return signal.open_signal(spark, path)


def write(table: FeatureTable, path: str, **options) -> None:
    sinks.write_table(table, path, **options)


def save_features(features: DataFrame, path: str) -> None:
    """Features as parquet by sequence and start, so that regions read little of it."""
    features.repartitionByRange("seq_id", "start").sortWithinPartitions("seq_id", "start").write.mode("overwrite").parquet(path)


def save_signal(df: DataFrame, path: str) -> None:
    df.repartitionByRange("seq_id", "start").sortWithinPartitions("seq_id", "start").write.mode("overwrite").partitionBy("seq_id").parquet(path)


class Registry:
    """Names of data sets and their paths, as JSON text."""

    def __init__(self, text: str = "{}") -> None:
        self.paths: dict[str, str] = json.loads(text)

    def add(self, name: str, path: str) -> None:
        self.paths[name] = path

    def open(self, spark: SparkSession, name: str) -> DataFrame:
        return signal.open_signal(spark, "&".join(self.paths.get(n, n) for n in name.split("&")))

    def text(self) -> str:
        return json.dumps(self.paths, sort_keys=True)


# ---- among features ------------------------------------------------------------------------------


def types(features: DataFrame) -> DataFrame:
    """(source, types)."""
    return features.groupBy("source").agg(F.array_sort(F.collect_set("type")).alias("types"))


def feature_list(features: DataFrame, kinds: list[str]) -> DataFrame:
    return features.filter(F.col("type").isin(kinds)).select(F.col("id").alias("Primary_ID"), F.col("name").alias("Name"), F.col("type").alias("Type"))


def find(features: DataFrame, ident: str | None = None, name: str | None = None, kind: str | None = None) -> DataFrame:
    """One feature: by id, or else by name, then by an alias, then by the first piece of a name with signs in it."""
    own = features.filter(F.col("type") == kind) if kind else features
    alias = F.try_element_at("attributes", F.lit("Alias")) if "attributes" in features.columns else F.lit(None).cast("string")
    tests: list[Column] = []
    if ident:
        tests.append(F.col("id") == ident)
    if name:
        piece = name.split("|")[0].split(";")[0].split(",")[0].strip()
        tests += [F.col("name") == name, F.array_contains(F.split(alias, ","), name), F.col("name") == piece]
    if not tests:
        return own.limit(0)
    rank = F.coalesce(*[F.when(t, F.lit(k)) for k, t in enumerate(tests)])
    return own.withColumn("_rank", rank).filter("_rank is not null").orderBy("_rank", "seq_id", "start").limit(1).drop("_rank")


def datasets(features: DataFrame) -> DataFrame:
    """Types that have scores."""
    return features.filter("score is not null").select("type").distinct()


def info(features: DataFrame, transcripts: DataFrame, parts: DataFrame, names: list[str]) -> DataFrame:
    """Features (with gene_id) and what is asked of them; any other name is a tag of the attributes."""
    counts = transcripts.groupBy("gene_id").agg(F.count("*").alias("_rna"))
    lengths = G.gene_length(G.exons(parts), transcripts).withColumnRenamed("length", "_tx")
    exons = G.exons(parts).join(transcripts.select("transcript_id", "gene_id"), "transcript_id").groupBy("gene_id").agg(F.count("*").alias("_ex"))
    df = features
    for other, want in ((counts, "rna_count"), (lengths, "transcript_length"), (exons, "exon_count")):
        if want in names:
            df = df.join(other, "gene_id", "left")
    known = {
        "chromosome": lambda: F.col("seq_id"), "start": lambda: F.col("start"), "stop": lambda: F.col("end"), "midpoint": lambda: midpoint("start", "end"), "length": lambda: length("start", "end"), "gene_length": lambda: length("start", "end"),
        "strand": lambda: F.col("strand"), "score": lambda: F.col("score"), "phase": lambda: F.col("phase"), "source": lambda: F.col("source"), "type": lambda: F.concat_ws(":", "type", "source"), "primary_tag": lambda: F.col("type"),
        "name": lambda: F.col("name"), "primary_id": lambda: F.col("id"), "parent": lambda: F.array_join("parents", ","),
        "rna_count": lambda: F.coalesce("_rna", F.lit(0)), "transcript_length": lambda: F.coalesce("_tx", length("start", "end")), "exon_count": lambda: F.coalesce("_ex", F.lit(0)),
    }
    return df.select("id", *[(known[n]() if n in known else F.try_element_at("attributes", F.lit(n))).alias(f"info_{n}") for n in names])


# ---- tables as other formats ---------------------------------------------------------------------


def as_bed(table: FeatureTable, columns: int = 6, base: str = "Feature") -> DataFrame:
    """(seq_id, start, line); rows without a name get the base and their number."""
    own = table.intervals()
    number = (F.col("_row") + 1 if "_row" in own.columns else F.monotonically_increasing_id() + 1).cast("string")
    return own.select("seq_id", "start", sinks.bed_line(columns, name=F.coalesce("name", F.concat_ws("_", F.lit(base), number))).alias("line"))


def as_gff(table: FeatureTable, source: str = ".", kind: str | None = None, unique: bool = False) -> DataFrame:
    from .operators.rows import numbered_names

    own = table.intervals()
    if unique:
        own = numbered_names(own, "name", ["seq_id", "start", "end"])
    none = F.lit(None).cast("string")
    own = own.withColumns({"source": F.lit(source), "type": F.coalesce(F.lit(kind).cast("string"), F.col("type"), F.lit("region")), "phase": none, "parents": F.array().cast("array<string>"), "attributes": F.create_map().cast("map<string,string>")})
    return own.select("seq_id", "start", sinks.gff3_line().alias("line"))


def as_wig(table: FeatureTable, kind: str = "variable", how: str = "mean", **options) -> DataFrame:
    return sinks.wig_lines(sinks.combined(table.intervals(), how), kind, **options)


def as_fasta(table: FeatureTable, chunks: DataFrame, size: int, joined: bool = False, pad: int = 0) -> DataFrame:
    """(name, line): a record for each row, or one for each sequence."""
    own = table.intervals()
    own = own if "_row" in own.columns else own.withColumn("_row", F.monotonically_increasing_id())
    found = own.join(G.sequence(own, chunks, size), "_row")
    if joined:
        found = sinks.fasta_joined(found, "seq_id", ["start"], pad).withColumnRenamed("seq_id", "name")
    return found.select("name", sinks.fasta_record().alias("line"))
