"""Tables of features: fixed schemas, what a column is for, and the plain view as intervals."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.values import col, strand

#: Fixed column names of formats; a trailing 0 marks a start that counts from 0.
SCHEMAS: dict[str, tuple[str, ...]] = {
    "gff": ("Chromosome", "Source", "Type", "Start", "Stop", "Score", "Strand", "Phase", "Group"),
    "bed12": ("Chromosome", "Start0", "End", "Name", "Score", "Strand", "thickStart0", "thickEnd", "itemRGB", "blockCount", "blockSizes", "blockStarts0"),
    "bed6": ("Chromosome", "Start0", "End", "Name", "Score", "Strand"),
    "bed5": ("Chromosome", "Start0", "End", "Name", "Score"),
    "bed4": ("Chromosome", "Start0", "End", "Name"),
    "bed3": ("Chromosome", "Start0", "End"),
    "bdg": ("Chromosome", "Start0", "End", "Score"),
    "narrowPeak": ("Chromosome", "Start0", "End", "Name", "Score", "Strand", "signalValue", "pValue", "qValue", "peak"),
    "broadPeak": ("Chromosome", "Start0", "End", "Name", "Score", "Strand", "signalValue", "pValue", "qValue"),
    "gappedPeak": ("Chromosome", "Start0", "End", "Name", "Score", "Strand", "thickStart0", "thickEnd", "itemRGB", "blockCount", "blockSizes", "blockStarts0", "signalValue", "pValue", "qValue"),
    "sgr": ("Chromosome", "Start", "Score"),
    "bedpe": ("Chromosome1", "Start1_0", "End1", "Chromosome2", "Start2_0", "End2", "Name", "Score", "Strand1", "Strand2"),
    "genePredExt16": ("bin", "name", "chrom", "strand", "txStart0", "txEnd", "cdsStart0", "cdsEnd", "exonCount", "exonStarts0", "exonEnds", "score", "name2", "cdsStartStat", "cdsEndStat", "exonFrames"),
    "genePredExt15": ("name", "chrom", "strand", "txStart0", "txEnd", "cdsStart0", "cdsEnd", "exonCount", "exonStarts0", "exonEnds", "score", "name2", "cdsStartStat", "cdsEndStat", "exonFrames"),
    "knownGene": ("name", "chrom", "strand", "txStart0", "txEnd", "cdsStart0", "cdsEnd", "exonCount", "exonStarts0", "exonEnds", "proteinID", "alignID"),
    "refFlat": ("name2", "name", "chrom", "strand", "txStart0", "txEnd", "cdsStart0", "cdsEnd", "exonCount", "exonStarts0", "exonEnds"),
    "genePred": ("name", "chrom", "strand", "txStart0", "txEnd", "cdsStart0", "cdsEnd", "exonCount", "exonStarts0", "exonEnds"),
    "sam": ("qname", "flag", "seq_id", "pos1", "mapq", "cigar", "mate_seq_id", "mate_pos1", "isize", "seq", "qual"),
}

#: Patterns for what a column is for, the strictest first.
ROLES: dict[str, tuple[str, ...]] = {
    "seq_id": (r"chromosome\d?|chrom?|seq_?id|seqname|refseq|ref_seq|sequence", r"chr.*"),
    "start": (r"start\d?_?0?|begin|position|pos|tx_?start0?", r".*start0?"),
    "end": (r"end\d?|stop|tx_?end", r".*(end|stop)"),
    "strand": (r"strand\d?", r".*strand.*"),
    "name": (r"name|gene_?name|display_?name", r".*name|gene"),
    "id": (r"primary_?id|id|gene_?id|transcript_?id", r".*_id"),
    "type": (r"type|class|primary_?tag", r".*type"),
    "score": (r"score|value|signal_?value", r".*score"),
}


def role(columns: list[str], what: str) -> str | None:
    """The column for a purpose, by patterns that get looser."""
    return next((c for pattern in ROLES[what] for c in columns if re.fullmatch(rf"#?(?:{pattern})", c, re.I)), None)


@dataclass
class TableMeta:
    """What a table says of itself beside its columns."""

    program: str | None = None
    feature: str | None = None
    database: str | None = None
    format: str | None = None
    path: str | None = None
    headers: bool = True
    interbase: bool = False
    comments: list[str] = field(default_factory=list)
    columns: dict[str, dict[str, str]] = field(default_factory=dict)


@dataclass
class FeatureTable:
    df: DataFrame
    meta: TableMeta = field(default_factory=TableMeta)

    @property
    def feature_type(self) -> str:
        c = self.df.columns
        if role(c, "seq_id") and role(c, "start"):
            return "coordinate"
        return "named" if role(c, "id") or (role(c, "name") and role(c, "type")) else "unknown"

    def intervals(self) -> DataFrame:
        return to_intervals(self.df, self.meta.interbase)

    def select(self, *names: str) -> FeatureTable:
        return FeatureTable(self.df.select(*names), self.meta)

    def with_df(self, df: DataFrame) -> FeatureTable:
        return FeatureTable(df, self.meta)


def to_intervals(df: DataFrame, interbase: bool | None = None) -> DataFrame:
    """_row if there is one, seq_id, start (from 1), end, strand, name, id, type and score of any table of features."""
    own = df.columns
    at = {w: role(own, w) for w in ROLES}
    if at["id"] == at["seq_id"]:  # the name of a sequence is no feature's
        at["id"] = None
    start = at["start"]
    zero = interbase if interbase is not None else bool(start and start.endswith("0"))
    s = col(start).cast("string").try_cast("long") + (1 if zero else 0) if start else F.lit(None).cast("long")
    end = col(at["end"]).cast("string").try_cast("long") if at["end"] else s
    text = lambda w: col(at[w]).cast("string") if at[w] else F.lit(None).cast("string")
    columns = [F.col("_row")] if "_row" in own else []
    columns += [text("seq_id").alias("seq_id"), s.alias("start"), end.alias("end"), (strand(at["strand"]) if at["strand"] else F.lit(0)).alias("strand")]
    columns += [text(w).alias(w) for w in ("name", "id", "type")]
    return df.select(*columns, text("score").try_cast("double").alias("score"))
