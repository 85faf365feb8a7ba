"""Common words of a corpus, of a proven number, and a deal of the rest into buckets."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, tidy

#: A word is common if it makes up 1 / SHARE of all; so there are at most SHARE common words.
SHARE = 500_000
#: Bytes of the longest word that may be common: words go to every task.
LONGEST = 64
#: Words counted together in a task before their counts are given out.
BLOCK = 8_000_000


def common_words(df: DataFrame, column: str, split: Callable[[str], list[str]], share: int = SHARE) -> DataFrame:
    """(word, n): at most share words of at most LONGEST bytes, each of at least 1 / share of all words of the column.

    A word with that share has it in some block of the words too, so each task gives out only words
    that have it there: n is a lower bound of a word's count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = Counter(), 0

        def out() -> pa.RecordBatch:
            least = total / share
            own = {w: n for w, n in counts.items() if n >= least and n > 1 and len(w.encode()) <= LONGEST} | {"": total}
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = split(text or "")
                counts.update(own)
                total += len(own)
                if total >= BLOCK:
                    yield out()
                    counts, total = Counter(), 0
        if total:
            yield out()

    found = checkpointed(df.select(F.col(f"`{column}`")).mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = found.filter(F.col("word") == "").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return found.filter((F.col("word") != "") & (F.col("n") >= max(total / share, 1)))


def bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets
