"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items.

A text is read once: the automaton runs over the normalised words, and the words it hits are mapped
back to code points of the original text.

Cases: null, empty and wordless texts hit nothing; an item without words has no window; items that
share a window all count; repeated document rows each get a row; an item id that is null is left
out; an empty benchmark leaves every document clean, an empty table gives no rows; texts of any length are
read whole; other columns of the documents, of any names, pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import annotate, octets, table

WINDOW = 10
#: Bytes of benchmark text behind one automaton (about 100 times as much memory); a larger benchmark is dealt over several scans.
SHARD_BYTES = 2_000_000

#: A-Z to lower case, other ASCII but digits and letters to a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])), False),
        T.StructField("items", T.ArrayType(T.StringType()), False),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), False),
    ]
)


def windows(text: bytes, width: int = WINDOW) -> set[bytes]:
    """The windows of an item: of consecutive normalised words, or all of fewer words."""
    words = text.translate(NORMAL).split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shards(items: DataFrame, id_col: str, text_col: str) -> Iterator[dict[bytes, list[str]]]:
    """From each window to the items that have it, of at most SHARD_BYTES of text (one item at least) at a time."""
    found: dict[bytes, list[str]] = {}
    size = 0
    rows = items.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("binary")).filter(F.col(f"`{id_col}`").isNotNull())
    for name, text in rows.toLocalIterator():
        if size and size + len(text or b"") > SHARD_BYTES:
            yield found
            found, size = {}, 0
        size += len(text or b"")
        for w in windows(bytes(text or b"")):
            found.setdefault(w, []).append(name)
    yield found


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (row, out): out has n_words, runs (of hit words), items (sorted ids) and spans (code points, end exclusive)."""
    spark = docs.sparkSession
    at = docs
    for k, shard in enumerate(shards(items, item_col, item_text)):
        given = spark.sparkContext.broadcast(shard)

        def make(given=given, k=k):
            automaton = ahocorasick.Automaton()
            for window, names in given.value.items():
                key = f" {window.decode('latin-1')} "
                automaton.add_word(key, (len(key), names))
            if len(automaton):
                automaton.make_automaton()

            def work(column, before=None):
                raw, old = octets(column), before.to_pylist() if before is not None else None
                n_words, runs, items, spans = [], [], [], []
                for i, data in enumerate(raw):
                    words = data.translate(NORMAL).split()
                    n_words.append(len(words))
                    hits = [(x["first"], x["end"]) for x in old[i]["runs"]] if old else []
                    names = set(old[i]["items"]) if old else set()
                    if words and len(automaton):
                        line = f" {b' '.join(words).decode('latin-1')} "
                        if got := list(automaton.iter(line)):
                            gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
                            ends = np.array([e for e, _ in got])
                            starts = ends + 1 - np.array([v[0] for _, v in got])
                            hits += zip(np.searchsorted(gaps, starts).tolist(), np.searchsorted(gaps, ends).tolist())
                            for _, (_, own) in got:
                                names.update(own)
                    hits = merged(hits)
                    where = []
                    if hits:
                        places = [m.span() for m in WORD.finditer(data.decode())]
                        where = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in hits]
                    runs.append([{"first": a, "end": b} for a, b in hits])
                    items.append(sorted(names))
                    spans.append(where)
                return n_words, runs, items, spans

            return work

        if k == 0:
            at = annotate(docs, [text_col], make, FIELDS)
        else:  # the next shard of a large benchmark: add to what the others have found
            one = at.select("row", "out", F.col("row").getField(text_col).alias("text"))
            at = annotate(one, ["text", "out"], make, FIELDS).select(F.col("row.row").alias("row"), "out")
    return at


def n_hit(out: str = "out") -> Column:
    return F.aggregate(F.col(f"{out}.runs"), F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without a word of a benchmark window, with all their columns."""
    return contamination(docs, items, text_col).filter(F.size("out.runs") == 0).select("row.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside windows of the benchmark. Every row has a row; see the module for odd texts and items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("out.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("out.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "out.items"), 256).alias("items_sha256"),
        (F.size("out.runs") > 0).alias("contaminated"),
    )


SQL = {
    "op1_decontaminate": """
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
bw as (select distinct item_id, least(len(ws), 10) as k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') as win from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0)),
ks as (select distinct k from bw),
dw as (select doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w) cross join ks where i + k - 1 <= len(ws)),
hit as (select distinct doc_id, i, dw.k, item_id from dw join bw on dw.win = bw.win and dw.k = bw.k),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join pos using (doc_id) left join its using (doc_id)
""",
}
