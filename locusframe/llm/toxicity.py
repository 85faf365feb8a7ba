"""Toxicity with noisy-channel deobfuscation.

Words that look disguised (digits and signs for letters, drawn-out letters, letters set apart) become
lattices of what they may stand for, themselves among it; a Viterbi search under a character language
model picks the likeliest. If the model finds it likelier than noise, it takes the word's place. The
restored text is then scored: an automaton finds the words and beginnings of words that a logistic
regression has weights for, above and below zero.

Learning: labels of all documents with crc32(doc_id as text) mod 3 other than 1, one of each group of
near copies among them. Words and their beginnings count once in a document. A feature is kept if its
share of toxic documents is beyond chance over all features counted; what is kept is weighed together,
on restored texts, toxic and other documents counting alike in sum. The character model has the words
of all these documents. Counts are shuffled; a step of the regression is a pass over the features of
all documents, of which only its slope comes to the driver.

Cases: null and empty texts get the score of a text without any sign; documents without labels are
scored like others; a document with several labels counts as toxic if any is, one with several texts
teaches by one of them; without both kinds of labels no sign is known and every score is the base
rate; features of equal weight don't displace each other; texts of any length are read whole; repeated
rows each get a row; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ROWS, annotate, checkpointed, remainder, small_batches, squeeze, table, texts, tidy, unsqueeze
from .simhash import SENT, shingles, signed

THRESHOLD = 0.7
#: Precision of the prior of a weight; chosen on a fifth of the documents that may be learned from.
PRIOR = 0.3
#: Lengths of the word beginnings that are features beside whole words, and letters of the longest word that teaches spelling.
STEMS, LONGEST = range(3, 9), 30
ORDER = 4
#: Features or pieces of words that a task counts before it gives them out, tasks of a pass of the regression, and passes at most.
HELD, TASKS, PASSES = 400_000, 16, 200
#: Least hashes in a band of a sketch, and what makes three bands of hashes of one: a band is shared with the similarity to the power of BAND.
BAND = 4
MIXED = np.random.default_rng(3).integers(0, 1 << 63, 3 * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
#: Log probability of a letter in noise: a restored word has to be likelier.
NOISE = -math.log(30)

#: What a sign or digit may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "tl", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}

#: To a space: ASCII that is no letter.
PLAIN = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Signs of a disguise: a stand-in between or before letters, a letter three times, a letter and two more or digits set apart.
SIGN = re.compile(r"[^\W\d_][0-9@$!|+(€£¡]+[^\W\d_]|(?<!\S)[0-9@$!|+(€£¡]{1,3}[^\W\d_]{2}|([^\W\d_])\1\1|(?<![^\W_])[^\W\d_](?:[ ._*\-][^\W_](?![^\W_])){2}")
TOKEN_EDGE = re.compile(r"\s")
APART = re.compile(r"(?<![^\W_])[^\W_](?:[ ._*\-]+[^\W_@$!|]){2,}(?![^\W_])")
#: Marks around a token that are no part of it.
EDGES = ".,;:?\"'()[]{}<>*#%&_-"


def grams(word: str, n: float, into: Counter) -> None:
    """Adds the pieces of a word that the character model counts: up to ORDER characters, and contexts, which end with a mark of their own."""
    text = "^" * (ORDER - 1) + word + "$"
    for i in range(ORDER - 1, len(text)):
        for k in range(ORDER):
            into[text[i - k : i + 1]] += n
            into[text[i - k : i] + "\0"] += n


class CharModel:
    """Log probabilities of characters after the ORDER - 1 before, interpolated over shorter contexts."""

    def __init__(self, counts: dict[str, float]) -> None:
        self.counts = counts
        self.cache: dict[tuple[str, str], float] = {}

    @classmethod
    def of(cls, words: dict[str, float]) -> CharModel:
        counts: Counter = Counter()
        for word, n in words.items():
            grams(word, n, counts)
        return cls(counts)

    def log(self, context: str, char: str) -> float:
        found = self.cache.get((context, char))
        if found is None:
            if len(self.cache) > 50_000:
                self.cache.clear()
            p = 1 / 400
            for k in range(ORDER):
                c = context[len(context) - k :]
                p = (self.counts.get(c + char, 0.0) + 2 * p) / (self.counts.get(c + "\0", 0.0) + 2)
            found = self.cache[(context, char)] = math.log(p)
        return found


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character of a disguised token, the texts it may stand for and their channel costs; itself costs nothing."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        char, n = m[1], len(m[0])
        choices = [(m[0], 0.0)]
        if char.isalpha():
            choices += [(char * k, -0.7) for k in (1, 2) if k < n]
        elif char in LEET:
            choices += [(c * k, -0.3 - 0.7 * (k != min(n, 2))) for c in LEET[char] for k in ((1,) if n == 1 else (1, 2))]
            choices.append(("", -2.5 * min(n, 3)))
        else:
            choices.append(("", -0.3))
        out.append(choices)
    return out


def restore(token: str, model: CharModel) -> str | None:
    """The likeliest plain word behind a token, by Viterbi over the lattice with the last characters as states; None if it is no likelier than noise."""
    start = "^" * (ORDER - 1)
    states: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
    for choices in lattice(token):
        nxt: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, path) in states.items():
            for text, cost in choices:
                s, total, way = state, score + cost, path
                for c in text:
                    total += model.log(s, c) - NOISE
                    s = (s + c)[1 - ORDER :]
                    way = (c, way)
                if s not in nxt or total > nxt[s][0]:
                    nxt[s] = (total, way)
        states = nxt
    gain, way = max(((score + model.log(state, "$") - NOISE, way) for state, (score, way) in states.items()), key=lambda x: x[0])
    if gain <= 0:
        return None
    out = []
    while way:
        out.append(way[0])
        way = way[1]
    return "".join(reversed(out))


def disguised(text: str) -> Iterator[tuple[int, int, str]]:
    """(from, to, token) of tokens of a lower-case text that look disguised; letters that were set apart are put together."""
    at = 0
    while m := SIGN.search(text, at):
        if (apart := APART.match(text, m.start())) and apart.end() > m.start() + 4:
            yield apart.start(), apart.end(), re.sub(r"[ ._*\-]+", "", apart[0])
            at = apart.end()
            continue
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        space = TOKEN_EDGE.search(text, m.end())
        end = space.start() if space else len(text)
        token = text[start:end]
        bare = token.strip(EDGES)
        if bare:
            start += len(token) - len(token.lstrip(EDGES))
            yield start, start + len(bare), bare
        at = max(end, m.end())


def restored(text: str, plain) -> tuple[str, list[str]]:
    """A lower-case text with its disguised tokens restored, and the words that took their place. plain: restore() of a token."""
    out, words, at = [], [], 0
    for start, end, token in disguised(text):
        word = plain(token)
        if word is not None and word != text[start:end]:
            out += (text[at:start], word)
            words.append(word)
            at = end
    return ("".join([*out, text[at:]]), words) if words else (text, words)


def line(text: str) -> str:
    """The words of a lower-case text between single spaces, one character for each byte."""
    return f" {b' '.join(text.encode().translate(PLAIN).split()).decode('latin-1')} "


def sketch(text: str) -> list[int]:
    """A hash of each band of least hashes over the shingles of a text: near copies have one in common, most likely, and texts with some shingles in common none."""
    own = shingles(text.encode()) or [b""]
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    least = np.array([(h * m).min() for m in MIXED])
    return [signed(xxhash.xxh64_intdigest(least[k : k + BAND].tobytes())) for k in range(0, len(least), BAND)]


def sent(rows: DataFrame) -> DataFrame:
    """rows, to be joined by a broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic as 0 or 1): all labelled documents outside the held-out ones, one of each group of near copies.

    Copies of one toxic document would make signs of all its words. docs is a table or a checkpoint, whose rows have the same numbers each time.
    """
    toxic = F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    marks = checkpointed(labels.filter("toxic is not null").filter(remainder(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(toxic))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(list(map(sketch, texts(batch.column(0)))), pa.list_(pa.int64()))], names=["row", "doc_id", "toxic", "h", "bands"])

    known = small_batches(rows).join(sent(marks), "doc_id").select("text", "row", "doc_id", "toxic", F.xxhash64("text").alias("h"))
    sketched = known.mapInArrow(tidy(run), T.StructType([*known.schema.fields[1:], T.StructField("bands", T.ArrayType(T.LongType()))]))
    # ids may repeat: one text of each
    one = sketched.groupBy("doc_id").agg(F.min(F.struct("h", "row", "bands")).alias("m"), F.max("toxic").alias("toxic"))
    least = F.min(F.struct(F.col("doc_id").cast("string"), "row", "toxic")).alias("m")
    firsts = one.select("doc_id", "m.row", "toxic", F.posexplode("m.bands").alias("band", "hash")).groupBy("band", "hash").agg(least)
    kept = checkpointed(firsts.groupBy("m.row", "m.toxic").count().filter(F.col("count") == len(MIXED) // BAND).select("row", "toxic"))  # the first by each band
    return rows.join(sent(kept), "row").select("text", "toxic")


def counted(rows: DataFrame) -> DataFrame:
    """(feature, n, toxic): documents that have a feature, and the toxic ones among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, len(b), ROWS)):
            tally.add(texts(batch.column(0)), batch.column(1).to_numpy())
            if len(tally.names) > HELD:
                yield tally.out()
                tally = Tally()
        yield tally.out()

    return small_batches(rows).mapInArrow(tidy(count), "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


class Tally:
    """Counts the documents that have each feature: words of the lower-case text, marked by a space at both ends, and their beginnings, by one in front.

    What the features of a word are is worked out once.
    """

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.of = np.zeros((0, len(STEMS) + 1), np.int64)  # by word: numbers of its features, or -1
        self.n, self.toxic = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, column: list[str], toxic: np.ndarray) -> None:
        words, names, known = self.words, self.names, len(self.words)
        found = [[words.setdefault(w, len(words)) for w in set(low.encode().translate(PLAIN).decode().split())] for low in map(str.lower, column)]
        new = [[names.setdefault(f, len(names)) for f in (f" {w} ", *(f" {w[:k]}" for k in STEMS if len(w) >= k))] for w in islice(words, known, None)]
        self.of = np.concatenate([self.of, np.array([f + [-1] * (len(STEMS) + 1 - len(f)) for f in new], np.int64).reshape(-1, len(STEMS) + 1)])
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        feature = self.of[np.fromiter((w for f in found for w in f), np.int64, len(row))]
        pairs = np.unique((feature * len(found) + row[:, None])[feature >= 0])  # beginnings are shared by the words of a document
        feature, row = pairs // max(1, len(found)), pairs % max(1, len(found))
        for name, values in (("n", np.bincount(feature, minlength=len(names))), ("toxic", np.bincount(feature[toxic[row] > 0], minlength=len(names)))):
            values[: len(getattr(self, name))] += getattr(self, name)
            setattr(self, name, values)

    def out(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(self.names), pa.string()), pa.array(self.n, pa.int64()), pa.array(self.toxic, pa.int64())], names=["feature", "n", "toxic"])


def spelling(counts: DataFrame) -> dict[str, float]:
    """Counts of the character model over the words among the features, each as often as documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], names=["gram", "n"])

        found: Counter = Counter()
        for batch in batches:
            for feature, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams(feature.strip(), float(n), found)
                if len(found) > HELD:
                    yield out(found)
                    found = Counter()
        yield out(found)

    words = counts.filter(F.col("feature").endswith(" ") & (F.length("feature") <= LONGEST + 2)).select("feature", "n")
    return {r["gram"]: r["n"] for r in words.mapInArrow(tidy(run), "gram string, n double").groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def weighed(known: DataFrame, size: int, heavier: float) -> np.ndarray:
    """Weights of the features and a bias: the likeliest under normal priors, by L-BFGS whose slopes are added up over all rows.

    known: rows (toxic, counts, found) of packed documents; heavier: how much a toxic one counts.
    """
    known = known.coalesce(TASKS)
    precision = np.array([PRIOR] * size + [1e-6])

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, slope and the diagonal of the curvature."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope, bend = 0.0, np.zeros(size + 1), np.zeros(size + 1)
            for batch in batches:
                for line in zip(*(c.to_pylist() for c in batch.columns)):
                    y, n, column = (np.frombuffer(unsqueeze(x), "<i4") for x in line)
                    row = np.repeat(np.arange(len(y)), n)
                    z = np.bincount(row, weights=w[column], minlength=len(y)) + w[-1]
                    weight = np.where(y > 0, heavier, 1.0)
                    loss += float(weight @ np.logaddexp(0, np.where(y > 0, -z, z)))
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    for total, value in ((slope, weight * (p - (y > 0))), (bend, weight * p * (1 - p))):
                        total[:-1] += np.bincount(column, weights=value[row], minlength=size)
                        total[-1] += value.sum()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([loss]), pa.array([slope.tobytes()], pa.binary()), pa.array([bend.tobytes()], pa.binary())], names=["task", "loss", "slope", "bend"])

        # always added up in the same order
        found = sorted(known.mapInArrow(tidy(run), "task int, loss double, slope binary, bend binary").collect(), key=lambda r: r["task"])
        loss = sum(r["loss"] for r in found) + 0.5 * float(precision @ w**2)
        slope, bend = (sum((np.frombuffer(r[k]) for r in found), np.zeros(size + 1)) for k in ("slope", "bend"))
        return loss, slope + precision * w, bend + precision

    return descended(at, np.zeros(size + 1))


def descended(at: Callable, w: np.ndarray, memory: int = 10) -> np.ndarray:
    """Where a convex loss is least, by L-BFGS. at(w): loss, slope and the diagonal of the curvature, of which the first serves as a scale."""
    loss, slope, scale = at(w)
    begin, steps = float(slope @ (slope / scale)), []
    for _ in range(PASSES):
        if float(slope @ (slope / scale)) <= 1e-10 * begin:
            break
        way, used = slope.copy(), []
        for s, y, r in reversed(steps):
            a = r * (s @ way)
            used.append(a)
            way -= a * y
        way *= (1.0 if not steps else (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ (steps[-1][1] / scale))) / scale
        for (s, y, r), a in zip(steps, reversed(used)):
            way += (a - r * (y @ way)) * s
        size, down = 1.0, float(slope @ way)
        for _ in range(20):
            then = at(w - size * way)
            if then[0] <= loss - 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        s, y = -size * way, then[1] - slope
        if s @ y > 0:
            steps = [*steps, (s, y, 1 / float(s @ y))][-memory:]
        w, loss, slope = w + s, then[0], then[1]
    return w


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """Weights of features, their bias, and the counts of the character model, of all labelled documents that aren't held out."""
    rows = checkpointed(learnable(docs, labels))
    total, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = (n_toxic + 0.5) / (total + 1)
    none = {"weights": {}, "grams": {}, "bias": math.log(base / (1 - base))}
    if not 0 < n_toxic < total:
        return none
    counts = checkpointed(counted(rows))
    p = F.col("toxic") / F.col("n")
    gain = F.col("n") * (F.when(p > 0, p * F.log(p / F.lit(base))).otherwise(0.0) + F.when(p < 1, (1 - p) * F.log((1 - p) / F.lit(1 - base))).otherwise(0.0))
    strong = sorted(r["feature"] for r in counts.filter(gain > math.log(max(1, counts.count()))).select("feature").collect())
    if not strong:
        return none
    spelled = spelling(counts)
    given = docs.sparkSession.sparkContext.broadcast((dict(zip(strong, range(len(strong)))), spelled))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*given.value)
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, len(b), ROWS)):
            found = [sorted(reader.weights[f] for f in reader.signs(reader.restored(text.lower())[0])) for text in texts(batch.column(0))]
            values = batch.column(1).to_numpy(), [len(x) for x in found], [k for x in found for k in x]
            yield pa.RecordBatch.from_arrays([pa.array([squeeze(np.array(v, "<i4").tobytes())], pa.binary()) for v in values], names=["toxic", "counts", "found"])

    known = checkpointed(small_batches(rows).mapInArrow(tidy(present), "toxic binary, counts binary, found binary"))
    w = weighed(known, len(strong), (total - n_toxic) / n_toxic)
    return {"weights": dict(zip(strong, w[:-1].tolist())), "grams": spelled, "bias": float(w[-1])}


class Reader:
    """Restores texts and finds the features that have weights."""

    def __init__(self, weights: dict[str, float], counts: dict[str, float]) -> None:
        model = CharModel(counts)
        self.plain = lru_cache(20_000)(lambda token: restore(token, model))
        self.automaton = ahocorasick.Automaton()
        for f in weights:
            self.automaton.add_word(f.encode().decode("latin-1"), f)
        if weights:
            self.automaton.make_automaton()
        self.weights = weights

    def restored(self, low: str) -> tuple[str, list[str]]:
        return restored(low, self.plain) if self.weights else (low, [])

    def signs(self, low: str) -> set[str]:
        return {f for _, f in self.automaton.iter(line(low))} if self.weights else set()


FIELDS = T.StructType([T.StructField("score", T.DoubleType(), False), T.StructField("signs", T.ArrayType(T.StringType()), False), T.StructField("restored", T.ArrayType(T.StringType()), False)])


def score_toxicity(docs: DataFrame, known: dict, text_col: str = "text") -> DataFrame:
    """Rows (row, out): out has score, the signs found (features of weight above zero) and the words that were restored."""
    given = docs.sparkSession.sparkContext.broadcast(known)

    def make():
        weights, bias = given.value["weights"], given.value["bias"]
        reader = Reader(weights, given.value["grams"])

        def work(column):
            scores, found, back = [], [], []
            for text in texts(column):
                low, words = reader.restored(text.lower())
                own = reader.signs(low)
                total = bias + sum(weights[f] for f in sorted(own))
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, total)))))
                found.append(sorted({f.strip() for f in own if weights[f] > 0}))
                back.append(words)
            return scores, found, back

        return work

    return annotate(docs, [text_col], make, FIELDS)


def reject_toxic(docs: DataFrame, known: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    return score_toxicity(docs, known).filter(F.col("out.score") < threshold).select("row.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by what labels outside the held-out ones teach. Every row has a row; see the module for odd texts and labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        (remainder(F.col("row.doc_id"), 3) == 1).alias("held_out"),
        F.col("out.score").alias("score"),
        (F.col("out.score") >= THRESHOLD).cast("int").alias("predicted"),
    )
