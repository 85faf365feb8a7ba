"""Byte-level BPE by a distinct-word table.

Texts are split into words that merges never cross. Each distinct word is encoded once: common
words (at most _words.SHARE of them) on the driver, to be sent to every task; the rest in the bucket
of the word's hash. The ids of the rest come back to the batches that asked for them and are put at
the words' positions. Decoding looks up the bytes of each id in the table of pieces and joins them.

Cases: null and empty texts have no ids and decode to an empty text; special tokens in a text are
encoded as the tokenizers library does by default; texts of any length are read whole; repeated rows
each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_list, pack, parts, squeeze, table, tidy, unpack, unsqueeze
from ._words import bucket, common_words

TOKENIZER = "byte_bpe_50k.json"

#: Words that are encoded together.
JOINED = 200
#: Text of a batch: the larger, the fewer times a rare word is asked for.
BATCH = 10_000_000
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space that stands alone, where text on both sides is no white space. Every word of the tokenizer's own pattern ends before it.
ALONE = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")

def split(text: str) -> list[str]:
    """The words of a text: cut before each space that stands alone, the space being part of the word.

    Merges never cross such a cut, nor does a special token hold a space. As all words but the first start with a
    space, it is left out; the first has one in front instead. spoken() undoes that.
    """
    pieces = text.split(" ")
    if not all(pieces) or list(map(str.strip, pieces)) != pieces:  # white space beside some space
        pieces = ALONE.split(text)
    pieces[0] = " " + pieces[0]
    return pieces if text else []


def spoken(word: str) -> str:
    return word[1:] if word[0] == " " else " " + word


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """What the file of a byte-level tokenizer says: ids of words, pieces of ids, special tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        with open(path) as file:
            spec = json.load(file)
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.pieces: list[bytes] = [b""] * (1 + max([*spec["model"]["vocab"].values(), *self.specials.values()]))
        for piece, k in spec["model"]["vocab"].items():
            self.pieces[k] = bytes(letters[c] for c in piece)
        for piece, k in self.specials.items():
            self.pieces[k] = piece.encode()
        # the table of pieces as one array, to be looked up for many ids at once
        self.sizes = np.array([len(p) for p in self.pieces])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers.

        Words that start with a space that stands alone are encoded many at a time, as one text that is cut before
        each of them; the bytes of the pieces tell whose they are.
        """
        out: list[bytes] = [b""] * len(words)
        plain = [k for k, w in enumerate(words) if len(w) > 1 and w[0] == " " and not w[1].isspace() and not w[-1].isspace()]
        for lo in range(0, len(plain), JOINED):
            part = plain[lo : lo + JOINED]
            ids = np.array(self.encoder.encode("".join([words[k] for k in part]), add_special_tokens=False).ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(words[k].encode()) for k in part])) + 1
            line = ids.tobytes()
            for k, a, b in zip(part, [0, *(4 * ends[:-1]).tolist()], (4 * ends).tolist()):
                out[k] = line[a:b]
        rest = sorted(set(range(len(words))) - set(plain))
        for k, e in zip(rest, self.encoder.encode_batch([words[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def decoded(self, ids: bytes) -> bytes:
        """The UTF-8 of the text; what is none shows as replacement characters."""
        found, out = np.frombuffer(ids, "<u4"), []
        for lo in range(0, len(found), 1_000_000):
            part = found[lo : lo + 1_000_000]
            n = self.sizes[part]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.starts[part] - (ends - n), n) + np.arange(ends[-1])].tobytes())
        raw = b"".join(out)
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return raw

    def decode(self, ids: bytes) -> str:
        return self.decoded(ids).decode()


def vocabulary(path: str) -> Vocabulary:
    """Kept by the process: code that is sent with a plan has module variables of its own."""
    kept = vars(sys).setdefault("_byte_bpe_vocabularies", {})
    if path not in kept:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        kept[path] = Vocabulary(path)
    return kept[path]


#: What tokenize() can return of a text.
COLUMNS = {
    "ids": (T.BinaryType(), lambda ids, text: ids),
    "decoded": (T.StringType(), lambda ids, text: text.decode()),
    "ids_sha256": (T.StringType(), lambda ids, text: hashlib.sha256(ids).hexdigest()),
    "decoded_sha256": (T.StringType(), lambda ids, text: hashlib.sha256(text).hexdigest()),
}


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, columns: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """The id, n_tokens and columns of each text; ids are little-endian unsigned 32-bit integers."""
    path = path or tokenizer_file()
    sc = docs.sparkSession.sparkContext
    n_buckets = max(64, 4 * parts(docs))

    names = sorted(r["word"] for r in common_words(docs, text_col, split).select("word").collect())
    common = sc.broadcast(dict(zip(names, vocabulary(path).encode(list(map(spoken, names))))))
    packed = pack(docs, id_col, text_col, BATCH)

    def rare(data: list[bytes]) -> dict[int, list[str]]:
        """By bucket, the distinct words of a batch that aren't common, in order."""
        found: set[str] = set()
        for text in data:
            found.update(split(text.decode()))
        out: dict[int, list[str]] = defaultdict(list)
        for w in sorted(found - common.value.keys()):
            out[bucket(w.encode(), n_buckets)].append(w)
        return out

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, sizes, blob in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                own = rare(unpack(sizes, blob))
                # a word may hold any character but its own length tells where it ends
                blobs = [squeeze(np.array([len(w.encode()) for w in ws], "<u4").tobytes() + "".join(ws).encode()) for ws in own.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([number] * len(own), pa.int64()), pa.array([len(ws) for ws in own.values()], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "batch", "n", "words"])

    def answer(asked: pa.Table) -> pa.Table:
        """The ids of the words of one bucket, each distinct word encoded once."""
        lists = []
        for n, blob in zip(asked.column("n").to_pylist(), asked.column("words").to_pylist()):
            data = unsqueeze(blob)
            ends = 4 * n + np.cumsum([0, *np.frombuffer(data, "<u4", n)])
            lists.append([data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())])
        distinct = sorted({w for ws in lists for w in ws})
        ids: dict[bytes, bytes] = {}
        for lo in range(0, len(distinct), 10_000):
            part = distinct[lo : lo + 10_000]
            ids.update(zip(part, vocabulary(path).encode([spoken(w.decode()) for w in part])))
        blobs = []
        for ws in lists:
            own = [ids[w] for w in ws]
            sizes = np.array([len(x) // 4 for x in own], "<u4")
            values = np.frombuffer(b"".join(own), "<u4")
            small = values.astype("<u2") if not len(values) or values.max() < 1 << 16 else values
            blobs.append(squeeze(bytes([small.itemsize]) + sizes.tobytes() + small.tobytes()))
        return pa.table({"batch": asked.column("batch"), "bucket": asked.column("bucket"), "n": asked.column("n"), "ids": pa.array(blobs, pa.binary())})

    asked = packed.mapInArrow(tidy(ask), "bucket int, batch long, n int, words binary")
    answers = asked.groupBy("bucket").applyInArrow(tidy(answer), "batch long, bucket int, n int, ids binary")

    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, COLUMNS[c][0]) for c in columns)]
    makers = [COLUMNS[c][1] for c in columns]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ids of a batch's texts: common words' from the table, the rest from the answers."""
        voc = vocabulary(path)
        got = {b: (n, x) for b, n, x in zip(*(right.column(c).to_pylist() for c in ("bucket", "n", "ids")))}
        out: list[list] = [[] for _ in fields]
        for names, sizes, blob in zip(*(left.column(c).to_pylist() for c in ("ids", "sizes", "blob"))):
            data = unpack(sizes, blob)
            ids: dict[str, bytes] = {}
            for b, ws in rare(data).items():
                n, x = got[b]
                raw = unsqueeze(x)
                counts = np.frombuffer(raw, "<u4", n, 1)
                values = np.frombuffer(raw, f"<u{raw[0]}", -1, 1 + 4 * n).astype("<u4").tobytes()
                ends = 4 * np.cumsum([0, *counts])
                ids.update(zip(ws, (values[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist()))))
            first, rest = common.value.get, ids
            for name, text in zip(names, data):
                line = b"".join([first(w) or rest[w] for w in split(text.decode())])
                text = voc.decoded(line)
                for column, value in zip(out, (name, len(line) // 4, *(make(line, text) for make in makers))):
                    column.append(value)
        return pa.Table.from_arrays([arrow_list(c, f.dataType) for c, f in zip(out, fields)], names=[f.name for f in fields])

    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(tidy(join), T.StructType(fields))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all texts and of what they decode to. Every row has a row; see the module for odd texts."""
    return tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=("ids_sha256", "decoded_sha256"))
