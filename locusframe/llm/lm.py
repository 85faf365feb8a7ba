"""Language-model scores by a subword lattice.

A token is a path through a lattice from its first character to its last. Its arcs are the pieces of
an existing vocabulary, the bytes of a character (a way around pieces that are not there) and, over
the whole of it, the word as the corpus has it. The forward recursion in log space sums over all
paths and gives the token's marginal probability; those of a text's tokens and of its end multiply
to that of the text.

Weights are log probabilities. The vocabulary's file has ranks of merges instead, so those of pieces
are learned: their shares of the vocabulary's own segmentation of the distinct training words. A
whole-word arc has (1 - u) c / N, all other paths together u, the share of words seen once (what the
corpus says of how much is new). So the probabilities of all words and of the end sum to one at most.

Common words, at most SHARE of them and none longer than LONGEST bytes, are weighed once and their
scores sent to where the texts are; the others come together with their counts in a join on the word,
so nothing that grows with the corpus is sent to every task.

Cases: null and empty texts are the end alone; held-out documents teach nothing; a text without white
space is one word, of any length; repeated rows each get a row and each count; without training
documents every token is unknown; an empty table gives no rows; other columns may have any names. The
documents have to be a table or a checkpoint, which give the same rows in the same order each time:
rows are told apart by their place.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_list, checkpointed, octets, remainder, table

VOCABULARY = "piece_bpe_32k.model"
ALPHA = 0.1
#: Added to the count of each piece.
SMOOTH = 0.5
#: The end of a text among words: no word holds a space.
END = b" "
#: A word of this share of all is common; so there are at most as many common words as its inverse.
SHARE = 1_000_000
#: Bytes of the longest word that is sent to every task.
LONGEST = 64
#: Words of a task that are counted together.
WORDS = 400_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LOG10 = math.log(10)


def vocabulary_file(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokens(text: bytes) -> list[bytes]:
    """The lower-cased words of a text, without the end."""
    return text.translate(LOWER).split()


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def added(a: float, b: float) -> float:
    """The logarithm of a sum, from logarithms."""
    high, low = (a, b) if a > b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


class Lattice:
    """Log probabilities of words from the weights of pieces."""

    def __init__(self, pieces: dict[str, float], octets_: list[float], stop: float) -> None:
        """Natural logs: of pieces (a word starts with the mark ▁), of single bytes, and of a word's end."""
        self.pieces, self.octets, self.stop = pieces, octets_, stop
        self.begins = {p[:k] for p in pieces for k in range(1, len(p) + 1)}

    def log(self, word: str, whole: float = -math.inf, share: float = 0.0) -> float:
        """The sum over all paths. whole: the weight of the arc over the whole word; share: that of all other paths together."""
        text = "▁" + word
        n = len(text)
        pieces, begins = self.pieces, self.begins
        low = -math.inf
        forward = [low] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            here = forward[i]
            if here == low:
                continue
            j = i + 1
            part = text[i:j]
            ways = [(j, sum([self.octets[b] for b in part.encode()]))]
            while part in begins:
                w = pieces.get(part)
                if w is not None:
                    ways.append((j, w))
                j += 1
                if j > n:
                    break
                part = text[i:j]
            for j, w in ways:
                w += here
                old = forward[j]
                if old == low:
                    forward[j] = w
                elif old > w:
                    forward[j] = old + math.log1p(math.exp(w - old))
                else:
                    forward[j] = w + math.log1p(math.exp(old - w))
        return added(whole, share + forward[n] + self.stop)


def lattice_weights(counts: dict[int, float], path: str) -> tuple[dict[str, float], list[float], float]:
    """What a Lattice is made of, from how often each piece of the vocabulary segments the training words."""
    model = load(path)
    size = model.vocab_size()
    plain = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    # pieces with a mark inside can't be part of a word
    plain = [k for k in plain if "▁" not in model.id_to_piece(k)[1:]]
    single = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    words = counts.get(-1, 0.0) + SMOOTH
    weight = {k: counts.get(k, 0.0) + SMOOTH for k in (*plain, *single)}
    total = math.log(sum(weight.values()) + words)
    return {model.id_to_piece(k): math.log(weight[k]) - total for k in plain}, [math.log(weight[k]) - total for k in single], math.log(words) - total


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word binary, c) over all texts, the end of each among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in octets(batch.column(0)):
                counts.update(tokens(text))
                counts[END] += 1
                if len(counts) > WORDS:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(words: DataFrame, path: str) -> dict[int, float]:
    """How often each piece of the vocabulary is in the segmentation of the distinct words; -1: the words.

    A distinct word counts once, as the lattice stands for words that are new. As many rows as pieces at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = load(path), Counter()
        for batch in batches:
            words_ = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            for ids in model.encode(words_, num_threads=1):
                counts.update(ids)
            counts[-1] += len(words_)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["piece", "n"])

    found = words.filter(F.col("word") != F.lit(END)).mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r["piece"]: float(r["n"]) for r in found.collect()}


class Model:
    """log10 probabilities of a token under the base and under the model, from its count and the lattice."""

    def __init__(self, tokens_: int, distinct: int, once: int) -> None:
        self.n = tokens_
        self.denominator = tokens_ + ALPHA * (distinct + 1)
        self.unseen = min(0.5, max(once, 1) / tokens_) if tokens_ else 0.5

    def base(self, c: int) -> float:
        return math.log10((c + ALPHA) / self.denominator)

    def log10(self, word: bytes, c: int, lattice: Lattice) -> float:
        whole = math.log((1 - self.unseen) * c / self.n) if c else -math.inf
        if word == END:  # no piece spells it
            return (whole if c else math.log(0.5 / (self.n + 1))) / LOG10
        return lattice.log(word.decode("utf-8", "replace"), whole, math.log(self.unseen)) / LOG10


def score_texts(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(row, n_tokens, n_known, train_tokens, base_score, score) for each document; row: its id."""
    path = path or vocabulary_file()
    sc = docs.sparkSession.sparkContext
    known = checkpointed(word_counts(train, text_col))
    n, distinct, once = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    model = Model(n, distinct, once)
    lattice = sc.broadcast(lattice_weights(piece_counts(known, path), path))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(*lattice.value)
        for batch in batches:
            names, counts = batch.column(0).to_pylist(), [c or 0 for c in batch.column(1).to_pylist()]
            scores = [model.log10(w, c, own) for w, c in zip(names, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array([model.base(c) for c in counts], pa.float64()), pa.array(scores, pa.float64())], names=["word", "c", "base", "score"])

    weighed = "word binary, c long, base double, score double"
    # at most SHARE words make up 1 / SHARE of all each
    head = known.filter((F.col("c") >= max(2.0, n / SHARE)) & (F.octet_length("word") <= LONGEST)).mapInArrow(weigh, weighed).toArrow()
    common = sc.broadcast((dict(zip(head.column("word").to_pylist(), range(len(head)))), *(head.column(c).to_numpy() for c in ("base", "score"))))
    end = (model.base(0), model.log10(END, 0, Lattice({}, [], 0.0)))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("id", kind), T.StructField("word", T.BinaryType()), T.StructField("tf", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with the sums over a document's common words, and one for each other word."""
        index, base, score = common.value
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for name, text in zip(batch.column(0).to_pylist(), octets(batch.column(1))):
                words = tokens(text)
                words.append(END)
                ids = list(map(index.get, words))
                own = [k for k in ids if k is not None]
                rest = Counter([w for w, k in zip(words, ids) if k is None]) if len(own) < len(words) else {}
                rows = [(rid, name, b" %d" % rid, 0, len(own), float(base[own].sum()), float(score[own].sum()))]
                if END in rest:  # no training documents
                    del rest[END]
                    rows.append((rid, name, b" %d" % rid, 0, 0, *end))
                total = len(words)
                rows[0] = (rid, name, b" %d" % rid, total, *rows[0][4:])
                rows += [(rid, None, w, tf, None, None, None) for w, tf in rest.items()]
                for column, values in zip(out, zip(*rows)):
                    column.extend(values)
                rid += 1
                if len(out[0]) > 200_000:
                    yield pa.RecordBatch.from_arrays([arrow_list(c, f.dataType) for c, f in zip(out, schema)], names=schema.names)
                    out = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([arrow_list(c, f.dataType) for c, f in zip(out, schema)], names=schema.names)

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(split, schema)
    joined = rows.join(known.select("word", "c"), "word", "left").select("rid", "id", "word", "tf", "known", "base", "score", F.coalesce("c", F.lit(0)).alias("c"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of the words; one that stands next to itself is weighed once."""
        own = Lattice(*lattice.value)
        last, value, floor = None, 0.0, 0.0
        for batch in batches:
            known_, base_, score_, n_ = [], [], [], []
            columns = (batch.column(k).to_pylist() for k in (2, 3, 4, 5, 6, 7))
            for w, tf, k, b, s, c in zip(*columns):
                if k is not None:
                    known_.append(k)
                    base_.append(b)
                    score_.append(s)
                    n_.append(tf)
                    continue
                if w != last:
                    last, value, floor = w, model.log10(w, c, own), model.base(c)
                known_.append(tf if c else 0)
                base_.append(tf * floor)
                score_.append(tf * value)
                n_.append(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in ((n_, pa.int64()), (known_, pa.int64()), (base_, pa.float64()), (score_, pa.float64())))], names=["rid", "id", "n", "known", "base", "score"])

    weighed_rows = joined.sortWithinPartitions("word").mapInArrow(add, T.StructType([schema["rid"], schema["id"], T.StructField("n", T.LongType()), *schema.fields[4:]]))
    totals = weighed_rows.groupBy("rid").agg(F.first("id", ignorenulls=True).alias("id"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return totals.select(F.struct(F.col("id").alias(id_col)).alias("row"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out. Every row has a row; see the module for odd texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_texts(docs, docs.filter(remainder(F.col("doc_id"), 10) != 0))
    doc_id = F.col("row.doc_id")
    return found.select(doc_id.alias("doc_id"), (remainder(doc_id, 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
