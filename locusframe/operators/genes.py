"""Gene models as flat tables.

genes (gene_id, name, seq_id, start, end, strand), transcripts (transcript_id, gene_id, seq_id, start,
end, strand, type, biotype, tsl, tags) and parts (transcript_id, type, seq_id, start, end, strand,
phase), parts being exons, CDS, UTRs and codons. Every operator is a window or an aggregate by
transcript or gene, so genes are dealt over tasks and none holds more than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import islands, subtract

PLACE = ("seq_id", "strand")


def ordered(by: str = "transcript_id", five_first: bool = True) -> Window:
    """From the 5 prime end (or the left) on."""
    return Window.partitionBy(by).orderBy(F.when(F.col("strand") >= 0, F.col("start")).otherwise(-F.col("end")) if five_first else F.col("start"))


def exons(parts: DataFrame) -> DataFrame:
    """Exons; of transcripts without any, CDS and UTR put together where they touch."""
    own = parts.filter(F.col("type") == "exon").select("transcript_id", *PLACE, "start", "end")
    rest = parts.filter(F.col("type").rlike("(?i)^(cds|.*utr.*)$")).join(own.select("transcript_id").distinct(), "transcript_id", "left_anti")
    made = islands(rest, ["transcript_id", *PLACE], gap=1).drop("n")
    return own.unionByName(made.select(*own.columns))


def introns(ex: DataFrame) -> DataFrame:
    """Gaps between exons, numbered from the 5 prime end."""
    w = Window.partitionBy("transcript_id").orderBy("start")
    gaps = ex.withColumns({"a": F.col("end") + 1, "b": F.lead("start").over(w) - 1}).filter("b >= a")
    gaps = gaps.select("transcript_id", *PLACE, F.col("a").alias("start"), F.col("b").alias("end"))
    k = F.row_number().over(ordered())
    return gaps.withColumn("name", F.concat(F.col("transcript_id").cast("string"), F.lit(".intron"), (k - 1).cast("string")))


def shared(pieces: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Distinct exons (or introns) of a gene with how many transcripts have them: alternate (one), common (all) or uncommon."""
    counts = transcripts.groupBy("gene_id").agg(F.count_distinct("transcript_id").alias("n_transcripts"))
    found = pieces.join(transcripts.select("transcript_id", "gene_id"), "transcript_id").groupBy("gene_id", *PLACE, "start", "end").agg(F.count_distinct("transcript_id").alias("n"))
    kind = F.when(F.col("n") == F.col("n_transcripts"), "common").when(F.col("n") == 1, "alternate").otherwise("uncommon")
    return found.join(counts, "gene_id").withColumn("kind", kind)


def collapse(ex: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The exons of all transcripts of a gene as one; exons side by side stay apart."""
    return islands(ex.join(transcripts.select("transcript_id", "gene_id"), "transcript_id"), ["gene_id", *PLACE]).drop("n")


def collapsed_length(collapsed: DataFrame) -> DataFrame:
    return collapsed.groupBy("gene_id").agg(F.count("*").alias("n_exons"), F.sum(F.col("end") - F.col("start") + 1).alias("length"))


def transcript_length(ex: DataFrame) -> DataFrame:
    return ex.groupBy("transcript_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("length"))


def gene_length(ex: DataFrame, transcripts: DataFrame) -> DataFrame:
    """That of the longest transcript."""
    return transcript_length(ex).join(transcripts.select("transcript_id", "gene_id"), "transcript_id").groupBy("gene_id").agg(F.max("length").alias("length"))


def coding(transcripts: DataFrame, parts: DataFrame) -> DataFrame:
    """Whether a transcript is coding: by its type, then its biotype, then whether it has a CDS."""
    has = parts.filter(F.lower("type") == "cds").select("transcript_id").distinct().withColumn("_cds", F.lit(True))
    marked = transcripts.join(has, "transcript_id", "left")
    test = F.when(F.lower("type") == "mrna", True).when(F.col("biotype").isNotNull(), F.col("biotype").rlike("(?i)protein_?coding")).otherwise(F.coalesce("_cds", F.lit(False)))
    return marked.withColumn("is_coding", test).drop("_cds")


def cds_bounds(parts: DataFrame, with_stop: bool = False) -> DataFrame:
    """(transcript_id, cds_start, cds_stop, cds_length): from the left; a stop codon counts on demand."""
    kinds = ("cds", "stop_codon") if with_stop else ("cds",)
    own = parts.filter(F.lower("type").isin(*kinds))
    length = F.sum(F.when(F.lower("type") == "cds", F.col("end") - F.col("start") + 1))
    return own.groupBy("transcript_id", *PLACE).agg(F.min("start").alias("cds_start"), F.max("end").alias("cds_stop"), length.alias("cds_length"))


def codons(parts: DataFrame) -> DataFrame:
    """start_codon and stop_codon of each coding transcript: those given, or else three bases at either end of the CDS."""
    given = parts.filter(F.lower("type").isin("start_codon", "stop_codon")).select("transcript_id", F.lower("type").alias("type"), *PLACE, "start", "end")
    bounds = cds_bounds(parts)
    left = F.struct(F.col("cds_start").alias("start"), (F.col("cds_start") + 2).alias("end"))
    right = F.struct((F.col("cds_stop") - 2).alias("start"), F.col("cds_stop").alias("end"))
    forward = F.col("strand") >= 0
    both = F.array(F.struct(F.lit("start_codon").alias("type"), F.when(forward, left).otherwise(right).alias("at")), F.struct(F.lit("stop_codon").alias("type"), F.when(forward, right).otherwise(left).alias("at")))
    made = bounds.withColumn("c", F.explode(both)).select("transcript_id", "c.type", *PLACE, "c.at.start", "c.at.end")
    return given.unionByName(made.join(given, ["transcript_id", "type"], "left_anti").select(*given.columns))


def utrs(ex: DataFrame, parts: DataFrame) -> DataFrame:
    """Untranslated pieces of coding transcripts: those given, or exons less the CDS; five_prime_utr or three_prime_utr."""
    given = parts.filter(F.lower("type").rlike("utr")).select("transcript_id", *PLACE, "start", "end", F.lower("type").alias("type"))
    bounds = cds_bounds(parts, with_stop=True).select("transcript_id", "cds_start", "cds_stop")
    made = ex.join(bounds, "transcript_id").join(given.select("transcript_id").distinct(), "transcript_id", "left_anti")
    made = made.withColumn("p", F.explode(subtract(F.col("start"), F.col("end"), F.col("cds_start"), F.col("cds_stop"))))
    left = F.col("p.end") < F.col("cds_start")
    kind = F.when(left == (F.col("strand") >= 0), "five_prime_utr").otherwise("three_prime_utr")
    return given.unionByName(made.select("transcript_id", *PLACE, "p.start", "p.end", kind.alias("type")))


def phases(cds: DataFrame) -> DataFrame:
    """The phase of each CDS piece: bases to the next codon, counted from the 5 prime end."""
    w = ordered().rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(w), F.lit(0))
    return cds.withColumn("phase", F.pmod(-before, F.lit(3)).cast("int"))


def regions(kind: str, transcripts: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts of genes by name: tss, tts, exon, first_exon, last_exon, intron, first_intron, last_intron, alternate_exon,
    common_exon, uncommon_exon and so for introns, collapsed, splice, cds_start, cds_stop, utr, utr5, utr3, cds."""
    ex = exons(parts)
    place = ["transcript_id", "seq_id", "strand", "start", "end"]
    forward = F.col("strand") >= 0

    def point(at: Column) -> tuple[Column, Column]:
        return at.alias("start"), at.alias("end")

    if kind in ("tss", "tts"):
        at = F.when(forward == F.lit(kind == "tss"), F.col("start")).otherwise(F.col("end"))
        return transcripts.select("transcript_id", "seq_id", "strand", *point(at))
    if kind == "collapsed":
        return collapse(ex, transcripts)
    if kind in ("exon", "cds"):
        return ex.select(*place) if kind == "exon" else parts.filter(F.lower("type") == "cds").select(*place)
    if kind == "intron":
        return introns(ex).select(*place, "name")
    which, _, what = kind.partition("_")
    if what in ("exon", "intron"):
        own = ex if what == "exon" else introns(ex)
        if which in ("first", "last"):
            # the outermost by an aggregate: no sort
            rank = F.when(forward, F.col("start")).otherwise(-F.col("end"))
            pick = F.min_by if which == "first" else F.max_by
            return own.groupBy("transcript_id", "seq_id", "strand").agg(pick(F.struct("start", "end"), rank).alias("p")).select("transcript_id", "seq_id", "strand", "p.start", "p.end")
        return shared(own, transcripts).filter(F.col("kind") == which).select("gene_id", "seq_id", "strand", "start", "end")
    if kind == "splice":
        both = introns(ex).withColumn("at", F.explode(F.array("start", "end")))
        return both.select("transcript_id", "seq_id", "strand", *point(F.col("at")))
    if kind in ("cds_start", "cds_stop"):
        found = cds_bounds(parts)
        at = F.when(forward == F.lit(kind == "cds_start"), F.col("cds_start")).otherwise(F.col("cds_stop"))
        return found.select("transcript_id", "seq_id", "strand", *point(at))
    if kind in ("utr", "utr5", "utr3"):
        found = utrs(ex, parts)
        return found if kind == "utr" else found.filter(F.col("type").startswith({"utr5": "five", "utr3": "three"}[kind]))
    raise ValueError(f"no such gene region: {kind}")


def unique_regions(df: DataFrame, by: str = "gene_id", slop: int = 0) -> DataFrame:
    """Regions of a gene that aren't there yet: the same start and end, or with slop starts and ends not farther off.

    With slop, regions are taken in order of start and end, and one near the last one taken goes.
    """
    if slop == 0:
        return df.dropDuplicates([by, "seq_id", "start", "end"])
    near = lambda last, r: (F.abs(r["start"] - last["start"]) <= slop) & (F.abs(r["end"] - last["end"]) <= slop)
    rows = df.groupBy(by, "seq_id", "strand").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("r"))
    kept = F.aggregate("r", F.slice("r", 1, 1), lambda out, r: F.when(F.exists(out, lambda o: near(o, r)), out).otherwise(F.concat(out, F.array(r))))
    return rows.withColumn("p", F.explode(kept)).select(by, "seq_id", "strand", "p.start", "p.end")


def best_support(transcripts: DataFrame, level: str = "best") -> DataFrame:
    """Transcripts of a support level: a number, NA, the best that the gene has, or of bestN at most N."""
    tsl = F.regexp_extract(F.col("tsl"), "([1-5])", 1).try_cast("int")
    if level.upper() == "NA":
        return transcripts.filter(tsl.isNull())
    if level.isdigit():
        return transcripts.filter(tsl == int(level))
    most = int(level.removeprefix("best") or 5)
    best = F.min(tsl).over(Window.partitionBy("gene_id"))
    own = F.coalesce(tsl, F.lit(9))
    return transcripts.withColumn("_best", F.coalesce(best, F.lit(9))).filter((own == F.col("_best")) if level == "best" else (own <= most)).drop("_best")


def gencode_basic(transcripts: DataFrame) -> DataFrame:
    return transcripts.filter(F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "basic"))


def by_biotype(transcripts: DataFrame, pattern: str) -> DataFrame:
    return transcripts.filter(F.col("biotype").rlike(f"(?i){pattern}"))


def adjust(df: DataFrame, position: str, begin: int, end: int) -> DataFrame:
    """Bounds moved from the 5 (5) or 3 prime end (3), the middle (m) or both ends (53), turned round where needed and cut off at 1."""
    forward = F.col("strand") >= 0
    s, e, m = F.col("start"), F.col("end"), F.floor((F.col("start") + F.col("end")) / 2)
    ways = {"5": (s, s, e, e), "3": (e, e, s, s), "m": (m, m, m, m), "53": (s, e, e, s)}
    a, b, c, d = ways[position]
    one, two = F.when(forward, a + begin).otherwise(c - begin), F.when(forward, b + end).otherwise(d - end)
    return df.withColumns({"start": F.greatest(F.least(one, two), F.lit(1)).cast("long"), "end": F.greatest(F.greatest(one, two), F.lit(1)).cast("long")})


def spliced_offsets(ex: DataFrame) -> DataFrame:
    """Exons with the offset of their 5-prime-most base in the spliced transcript."""
    w = ordered().rowsBetween(Window.unboundedPreceding, -1)
    return ex.withColumn("spliced", F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(w), F.lit(0)))


def sequence(df: DataFrame, chunks: DataFrame, size: int, key: str = "_row") -> DataFrame:
    """(key, sequence) of intervals from sequences in chunks (seq_id, chunk, text) of a size, chunk from 0; turned round on the reverse strand."""
    own = df.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("start") - 1) / size), F.floor((F.col("end") - 1) / size))))
    low = F.greatest(F.col("start") - 1 - F.col("chunk") * size, F.lit(0))
    high = F.least(F.col("end") - F.col("chunk") * size, F.lit(size))
    got = own.join(chunks, ["seq_id", "chunk"]).withColumn("piece", F.substring(F.col("text"), (low + 1).cast("int"), (high - low).cast("int")))
    rows = got.groupBy(key, "strand").agg(F.array_sort(F.collect_list(F.struct("chunk", "piece"))).alias("p"))
    from ..functions.values import reverse_complement

    text = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return rows.withColumn("sequence", F.when(F.col("strand") < 0, reverse_complement(text)).otherwise(text)).select(key, "sequence")
