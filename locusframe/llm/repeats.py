"""Repeated passages by the common-prefix interval tree of an enhanced suffix array.

A suffix array of a whole corpus doesn't fit one task, so strings of WIDTH bytes first find each
other by an anchor: the GRAM-byte piece in them with the least hash. Equal strings have equal
anchors at equal places. Step by step, all in compressed rows between batches of documents and
buckets of hashes:

1. A batch sends each bucket the hashes of its anchors; a bucket answers which of them stand in more
   than one document, and which in more than HOT.
2. For those, a batch sends the contexts: an anchor with all bytes of the strings it is the anchor
   of, and the smallest document id that has it. A hot anchor's strings go one by one to the buckets
   of their own hashes, so that no bucket gets all of them. A bucket builds a suffix array over the contexts of
   each anchor, and a stack scan of its common prefixes gives the tree of intervals; intervals of at
   least WIDTH bytes whose occurrences differ to the left are the maximal repeats, with all
   occurrences. The answer: by context, the smallest document id of each string in it.
3. A batch marks the bytes of strings with an answer below its own document's id.

Cases: null and empty texts, and those of fewer than WIDTH bytes, lose nothing; a document with a
null id never counts as smaller and loses what any document with an id has; rows with the same id
take nothing from each other; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_list, checkpointed, give_back, pack, parts, squeeze, table, unsqueeze

WIDTH, GRAM = 50, 16
#: Documents with an anchor beyond which its strings are dealt by their own hashes.
HOT = 2_000
#: Window starts that are worked on together: their hashes stay in a core's cache.
CHUNK = 1 << 15
#: Bytes of text whose anchors share a bucket, about; more text has more buckets, not larger ones.
BUCKET_BYTES = 16_000_000
#: Bytes of a context, at most: a string for each place of its anchor.
CONTEXT = 2 * WIDTH - GRAM
NO_ID = np.iinfo(np.int64).max
HASH_BITS = 48

_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling."""
    h, power = x.astype(np.uint64) + np.uint64(1), 0x100000001B3
    size = 1
    while size < GRAM:
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, place, first start, last start, document) of each anchor of a batch and the strings it serves."""
    x = np.frombuffer(data, np.uint8)
    ends = np.cumsum(sizes)
    out: list[tuple[np.ndarray, ...]] = []
    per = WIDTH - GRAM + 1  # grams in a string
    n = max(0, len(x) - WIDTH + 1)
    inside = np.ones(len(x), bool)  # starts of strings that end in their document
    inside[np.maximum(np.repeat(ends - sizes, WIDTH - 1), (ends[:, None] - np.arange(1, WIDTH)).reshape(-1))[np.repeat(sizes > 0, WIDTH - 1)]] = False
    number = np.arange(min(CHUNK, n) + per, dtype=np.uint64)
    for lo in range(0, n, CHUNK):
        hi = min(lo + CHUNK, n)  # starts lo .. hi - 1
        start = np.flatnonzero(inside[lo:hi])
        if not len(start):
            continue
        h = gram_hashes(x[lo : hi + WIDTH - 1])
        key = (h >> np.uint64(23) << np.uint64(23)) | number[: len(h)]  # least hash, leftmost
        least, size = key, 1
        while 2 * size <= per:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: hi - lo], least[per - size : per - size + hi - lo])
        place = (least[start] & np.uint64((1 << 23) - 1)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
        last = np.r_[new[1:] - 1, len(start) - 1]
        first, place = start[new], place[new]
        out.append((h[place], place + lo, first + lo, start[last] + lo, np.searchsorted(ends, first + lo, "right")))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


def planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers by significance of their bytes, which compresses better."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(data: bytes, n: int, width: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view("<u8")


class Batch:
    """The anchors of a packed batch; ids that are null are larger than all others."""

    def __init__(self, ids: list, sizes: list[int], blob: bytes, buckets: int) -> None:
        self.data = unsqueeze(blob)
        self.sizes = np.array(sizes, np.int64)
        self.ids = np.array([NO_ID if x is None else x for x in ids], np.int64)
        self.hash, self.place, self.first, self.last, self.doc = anchors(self.data, self.sizes)
        self.buckets = np.uint64(buckets)
        self.hash = (self.hash ^ (self.hash >> np.uint64(31))) * _MIX  # the least of many hashes are uneven
        self.bucket = ((self.hash >> np.uint64(40)) % self.buckets).astype(np.int32)
        short = self.hash & np.uint64((1 << HASH_BITS) - 1)
        key = short | self.bucket.astype(np.uint64) << np.uint64(HASH_BITS)
        self.order = np.argsort(key)
        key = key[self.order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        self.head = np.flatnonzero(new)  # distinct hashes, by bucket and hash
        self.group = np.cumsum(new) - 1
        # only where a hash repeats do documents have to be in order
        again = np.flatnonzero(~new | ~np.r_[new[1:], True]) if len(key) else self.head
        self.order[again] = self.order[again][np.lexsort((self.doc[self.order[again]], self.group[again]))]
        b, s, d = self.bucket[self.order], short[self.order], self.doc[self.order]
        other = new | np.r_[True, d[1:] != d[:-1]] if len(b) else new
        self.docs = np.minimum(np.add.reduceat(other.astype(np.int64), self.head), 255) if len(b) else self.head
        self.short, self.of = s[self.head], b[self.head]

    def runs(self, buckets_of: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of an array that is sorted by bucket."""
        cut = np.flatnonzero(np.r_[True, buckets_of[1:] != buckets_of[:-1]]) if len(buckets_of) else np.zeros(0, np.int64)
        return [(int(buckets_of[a]), int(a), int(b)) for a, b in zip(cut, np.r_[cut[1:], len(buckets_of)])]

    def contexts(self, answers: dict[int, bytes]) -> tuple[np.ndarray, ...]:
        """Distinct contexts of the anchors that stand in several documents.

        (rows sorted by bucket: bucket, CONTEXT bytes, size and place of the anchor; then of each
        occurrence its start, its document and the number of its row).
        """
        alive, hot = np.zeros(len(self.head), bool), np.zeros(len(self.head), bool)
        for b, a, e in self.runs(self.of):
            both = np.unpackbits(np.frombuffer(answers[b], np.uint8).reshape(2, -1), axis=1, count=e - a)
            alive[a:e], hot[a:e] = both.astype(bool)
        own = self.order[alive[self.group]]
        many = self.order[hot[self.group]]
        # a hot anchor's strings each are a context
        n = self.last[many] - self.first[many] + 1
        alone = np.repeat(many, n)
        starts = np.r_[self.first[own], self.first[alone] + np.arange(len(alone)) - np.repeat(np.cumsum(n) - n, n)]
        size = np.r_[self.last[own] + WIDTH - self.first[own], np.full(len(alone), WIDTH)]
        anchor = np.r_[own, alone]
        x = np.r_[np.frombuffer(self.data, np.uint8), np.zeros(CONTEXT, np.uint8)]
        rows = np.zeros((len(anchor), CONTEXT + 7), np.uint8)
        if len(anchor):
            text = np.lib.stride_tricks.sliding_window_view(x, CONTEXT)[starts]
            text[np.arange(CONTEXT) >= size[:, None]] = 0
            rows[:, 3 : 3 + CONTEXT] = text
            coefficients = np.random.default_rng(7).integers(1, 1 << 63, WIDTH, np.uint64) | np.uint64(1)
            spread = np.zeros(len(alone), np.uint64)
            for k in range(WIDTH):
                spread += (text[len(own) :, k].astype(np.uint64) + np.uint64(1)) * coefficients[k]
            bucket = np.r_[self.bucket[own], ((spread >> np.uint64(40)) % self.buckets).astype(np.int32)]
            rows[:, :3] = bucket.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
        rows[:, 3 + CONTEXT] = size
        rows[:, 4 + CONTEXT] = self.place[anchor] - starts
        rows[:, 6 + CONTEXT] = 1  # no zero at the end
        distinct, which = np.unique(rows.reshape(-1).view(f"S{CONTEXT + 7}"), return_inverse=True)
        return distinct.view(np.uint8).reshape(-1, CONTEXT + 7), starts, self.doc[anchor], which


def least_by(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, NO_ID, np.int64)
    np.minimum.at(out, group, values)
    return out


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: int = WIDTH) -> list[tuple[int, int, int]]:
    """(length, from, to) of the intervals of a suffix array whose common prefix has at least `least` bytes
    and whose occurrences differ to the left.

    lcp[k]: common prefix of the suffixes at k - 1 and k. left[k]: the byte before the suffix at k, or a
    number of its own where there is none. Intervals nest; a stack holds those that are open, each with
    the byte to the left of all its occurrences, or None once they differ.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[list] = []  # [common prefix, from, byte to the left or None]
    lefts = left.tolist()
    values = [*lcp.tolist()[1:], 0]
    for k, value in enumerate(values):  # value: between k and k + 1
        begin, byte = k, lefts[k]
        while stack and stack[-1][0] > value:
            length, begin, own = stack.pop()
            own = own if own == byte else None
            if own is None:
                out.append((length, begin, k + 1))
            byte = own
        if value >= least:
            if stack and stack[-1][0] == value:
                if stack[-1][2] != byte:
                    stack[-1][2] = None
            else:
                stack.append([value, begin, byte])
        elif stack:
            stack.clear()
    return out


def smallest_ids(contexts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each string (by place in its context) the smallest id that has it, NO_ID where there is no string.

    contexts: distinct rows as Batch.contexts gives them, without the bucket; ids: the smallest of each.
    """
    n = len(contexts)
    size, place = contexts[:, CONTEXT].astype(np.int64), contexts[:, CONTEXT + 1].astype(np.int64)
    wide = CONTEXT - WIDTH + 1
    out = np.where(np.arange(wide) <= (size - WIDTH)[:, None], ids[:, None], NO_ID)
    if not n:
        return out
    gram = contexts[np.arange(n)[:, None], place[:, None] + np.arange(GRAM)]
    gram = np.ascontiguousarray(np.c_[gram, np.ones(n, np.uint8)]).view(f"S{GRAM + 1}").reshape(-1)
    _, group, members = np.unique(gram, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(members[group] > 1)
    shared = shared[np.argsort(group[shared], kind="stable")]
    counts = size[shared] - WIDTH + 1
    # by groups of whole anchors, about 200,000 suffixes at a time
    steps = np.cumsum(counts)
    lo = 0
    while lo < len(shared):
        hi = max(lo + 1, int(np.searchsorted(steps, (steps[lo - 1] if lo else 0) + 200_000, "right")))
        while hi < len(shared) and group[shared[hi]] == group[shared[hi - 1]]:
            hi += 1
        own = shared[lo:hi]
        part = out[own]
        _settle(contexts[own], ids[own], size[own], part)
        out[own] = part
        lo = hi
    return out


def _settle(contexts: np.ndarray, ids: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
    """Suffix array of the strings of these contexts, its interval tree, and what its maximal repeats say."""
    counts = size - WIDTH + 1
    which = np.repeat(np.arange(len(contexts)), counts)
    at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    rest = size[which] - at
    wide = np.zeros((len(contexts), 2 * CONTEXT), np.uint8)
    wide[:, :CONTEXT] = np.where(np.arange(CONTEXT) < size[:, None], contexts[:, :CONTEXT], 0)
    text = np.lib.stride_tricks.sliding_window_view(wide, CONTEXT, axis=1)[which, at]
    # a string that ends sorts before one that goes on with zero bytes
    ended = np.c_[text, rest.astype(np.uint8)[:, None]]
    sa = np.argsort(np.ascontiguousarray(ended).view(f"S{CONTEXT + 1}").reshape(-1), kind="stable")
    text, which, at, rest = text[sa], which[sa], at[sa], rest[sa]
    differ = text[1:] != text[:-1]
    common = np.where(differ.any(1), differ.argmax(1), CONTEXT)
    lcp = np.r_[0, np.minimum(common, np.minimum(rest[1:], rest[:-1]))]
    left = np.where(at > 0, contexts[which, np.maximum(at - 1, 0)], 1000 + np.arange(len(at)))
    # only runs of suffixes with WIDTH bytes in common matter to the scan
    near = np.r_[lcp[1:] >= WIDTH, False] | (lcp >= WIDTH)
    keep = np.flatnonzero(near)
    if not len(keep):
        return
    found = maximal_repeats(lcp[keep], left[keep])
    if not found:
        return
    length, a, b = (np.array(c, np.int64) for c in zip(*found))
    which, at = which[keep], at[keep]
    id_of = ids[which]
    occurrences = b - a
    member = np.repeat(a, occurrences) + np.arange(occurrences.sum()) - np.repeat(np.cumsum(occurrences) - occurrences, occurrences)
    repeat = np.repeat(np.arange(len(a)), occurrences)
    best = least_by(repeat, id_of[member], len(a))
    # the strings that an occurrence of a repeat covers: as many as its length allows
    strings = (length - WIDTH + 1)[repeat]
    for lo in range(0, len(member), 500_000):
        n = strings[lo : lo + 500_000]
        m, r = np.repeat(member[lo : lo + 500_000], n), np.repeat(repeat[lo : lo + 500_000], n)
        step = np.arange(len(m)) - np.repeat(np.cumsum(n) - n, n)
        np.minimum.at(out, (which[m], at[m] + step), best[r])


def buckets(docs: DataFrame, text_col: str) -> int:
    """So many that a bucket has the anchors of BUCKET_BYTES of text: input partitions stop growing in number before they stop growing."""
    n = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long")).alias("n")).first()["n"] or 0
    return min(1 << 64 - HASH_BITS, max(64, 4 * parts(docs), -(-n // BUCKET_BYTES)))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, n_bytes, spans): the bytes of each document that strings of earlier documents cover.

    With digests, n_removed, n_spans and kept_sha256 stand for the spans.
    """
    n_buckets = buckets(docs, text_col)
    packed = pack(docs, id_col, text_col)
    columns = ("batch", "ids", "sizes", "blob")
    kind = docs.schema[id_col].dataType

    def batches_of(rows) -> Iterator[tuple[int, list, Batch]]:
        for number, ids, sizes, blob in zip(*(rows.column(c).to_pylist() for c in columns)):
            yield number, ids, Batch(ids, sizes, blob, n_buckets)

    def ask_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, _, own in batches_of(rows):
                runs = own.runs(own.of)
                blobs = [squeeze(planes(np.diff(own.short[a:e], prepend=np.uint64(0)), HASH_BITS // 8) + own.docs[a:e].astype(np.uint8).tobytes()) for _, a, e in runs]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in runs], pa.int32()), pa.array([number] * len(runs), pa.int64()), pa.array([e - a for _, a, e in runs], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "batch", "n", "blob"])

    def answer_hashes(asked: pa.Table) -> pa.Table:
        hashes, docs = [], []
        for n, blob in zip(asked.column("n").to_pylist(), asked.column("blob").to_pylist()):
            data = unsqueeze(blob)
            hashes.append(np.cumsum(unplanes(data, n, HASH_BITS // 8)))
            docs.append(np.frombuffer(data, np.uint8, n, n * HASH_BITS // 8))
        _, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(which, np.concatenate(docs))[which]
        bits = np.split(np.array([(total > 1) & (total <= HOT), total > HOT]), np.cumsum([len(h) for h in hashes])[:-1], axis=1)
        return pa.table({"batch": asked.column("batch"), "bucket": asked.column("bucket"), "kind": pa.array([0] * len(bits), pa.int32()), "blob": pa.array([np.packbits(b, axis=1).tobytes() for b in bits], pa.binary())})

    answer_schema = "batch long, bucket int, kind int, blob binary"
    asked = packed.mapInArrow(ask_hashes, "bucket int, batch long, n int, blob binary")
    alive = checkpointed(asked.groupBy("bucket").applyInArrow(answer_hashes, answer_schema))

    def ask_contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist()))
        out: list[list] = [[], [], [], []]
        for number, _, own in batches_of(left):
            rows, _, docs_of, which = own.contexts(answers)
            least = least_by(which, own.ids[docs_of], len(rows))
            b = rows[:, :3].astype(np.int64) @ np.array([65536, 256, 1])
            for k, lo, hi in own.runs(b):
                part = rows[lo:hi, 3 : 5 + CONTEXT]
                text = part[:, :CONTEXT][np.arange(CONTEXT) < part[:, CONTEXT][:, None]]
                blob = squeeze(part[:, CONTEXT].tobytes() + part[:, CONTEXT + 1].tobytes() + planes(least[lo:hi].astype(np.uint64), 8) + text.tobytes())
                for column, value in zip(out, (k, number, hi - lo, blob)):
                    column.append(value)
        give_back()
        return pa.table({"bucket": pa.array(out[0], pa.int32()), "batch": pa.array(out[1], pa.int64()), "n": pa.array(out[2], pa.int32()), "blob": pa.array(out[3], pa.binary())})

    def answer_contexts(asked: pa.Table) -> pa.Table:
        rows, ids, sizes = [], [], asked.column("n").to_pylist()
        for n, blob in zip(sizes, asked.column("blob").to_pylist()):
            data = unsqueeze(blob)
            size, place = np.frombuffer(data, np.uint8, n), np.frombuffer(data, np.uint8, n, n)
            ids.append(unplanes(data, n, 8, 2 * n).astype(np.int64))
            row = np.zeros((n, CONTEXT + 3), np.uint8)
            inside = np.arange(CONTEXT) < size[:, None]
            row[:, :CONTEXT][inside] = np.frombuffer(data, np.uint8, -1, 10 * n)
            row[:, CONTEXT], row[:, CONTEXT + 1], row[:, CONTEXT + 2] = size, place, 1
            rows.append(row)
        flat = np.concatenate(rows).reshape(-1).view(f"S{CONTEXT + 3}")
        distinct, which = np.unique(flat, return_inverse=True)
        ids_all = np.concatenate(ids)
        least = least_by(which, ids_all, len(distinct))
        found = smallest_ids(distinct.view(np.uint8).reshape(-1, CONTEXT + 3), least)
        blobs, at = [], 0
        for n in sizes:
            own = found[which[at : at + n]]
            # runs of strings with the same smallest id
            new = np.c_[np.ones(n, bool), own[:, 1:] != own[:, :-1]]
            r, lo = np.nonzero(new)
            value = own[r, lo]
            hi = np.r_[np.where(r[1:] == r[:-1], lo[1:], own.shape[1]), own.shape[1]][: len(r)]
            real = value != NO_ID
            r, lo, hi, value = r[real], lo[real], hi[real], value[real]
            blobs.append(squeeze(len(r).to_bytes(8, "little") + planes(r.astype(np.uint64), 4) + lo.astype(np.uint8).tobytes() + hi.astype(np.uint8).tobytes() + planes(value.astype(np.uint64), 8)))
            at += n
        give_back()
        return pa.table({"batch": asked.column("batch"), "bucket": asked.column("bucket"), "kind": pa.array([1] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    asked = packed.groupBy("batch").cogroup(alive.groupBy("batch")).applyInArrow(ask_contexts, "bucket int, batch long, n int, blob binary")
    settled = asked.groupBy("bucket").applyInArrow(answer_contexts, answer_schema)

    fields = [T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType())]
    if digests:
        fields += [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    else:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        answers: list[dict[int, bytes]] = [{}, {}]
        for b, k, blob in zip(*(right.column(c).to_pylist() for c in ("bucket", "kind", "blob"))):
            answers[k][b] = blob
        out: list[list] = [[] for _ in fields]
        for _, names, own in batches_of(left):
            rows, starts, docs_of, which = own.contexts(answers[0])
            smallest = np.full((len(rows), CONTEXT - WIDTH + 1), NO_ID, np.int64)
            b = rows[:, :3].astype(np.int64) @ np.array([65536, 256, 1])
            for k, first, _ in own.runs(b):
                data = unsqueeze(answers[1][k])
                n = int.from_bytes(data[:8], "little")
                r, value = unplanes(data, n, 4, 8).astype(np.int64), unplanes(data, n, 8, 8 + 6 * n).astype(np.int64)
                lo, hi = np.frombuffer(data, np.uint8, n, 8 + 4 * n).astype(np.int64), np.frombuffer(data, np.uint8, n, 8 + 5 * n).astype(np.int64)
                reps = hi - lo
                column = np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                smallest[first + np.repeat(r, reps), column] = np.repeat(value, reps)
            change = np.zeros(len(own.data) + 1, np.int32)
            for lo in range(0, len(which), 200_000):
                part = slice(lo, lo + 200_000)
                hit, column = np.nonzero(smallest[which[part]] < own.ids[docs_of[part]][:, None])
                start = starts[part][hit] + column
                np.add.at(change, start, 1)
                np.add.at(change, start + WIDTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            ends = np.cumsum(own.sizes)
            begin = ends - own.sizes
            first, last = gone.copy(), gone.copy()  # of the runs, which end with their document
            inner = begin[own.sizes > 0]
            first[1:] &= ~gone[:-1]
            first[inner] = gone[inner]
            last[:-1] &= ~gone[1:]
            last[inner[1:] - 1] = gone[inner[1:] - 1]
            first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
            at = np.searchsorted(first, np.r_[begin, len(gone)]).tolist()
            lo, hi = first.tolist(), last.tolist()
            for k, (name, a, e) in enumerate(zip(names, begin.tolist(), ends.tolist())):
                runs = list(zip(lo[at[k] : at[k + 1]], hi[at[k] : at[k + 1]]))
                if digests:
                    kept = b"".join([own.data[x:y] for x, y in zip([a, *(y for _, y in runs)], [*(x for x, _ in runs), e])])
                    row = (name, e - a, e - a - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                else:
                    row = (name, e - a, [{"start": x - a, "end": y - a} for x, y in runs])
                for c, v in zip(out, row):
                    c.append(v)
        give_back()
        return pa.Table.from_arrays([arrow_list(c, f.dataType) for c, f in zip(out, fields)], names=[f.name for f in fields])

    answers = alive.unionByName(settled)
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(mark, T.StructType(fields))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that 50-byte strings of documents with smaller ids cover. Every row has a row; see the module for odd texts and ids."""
    return repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


SQL = {
    "op7_repeats": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, md5_number(substr(h, 2*i+1, 100)) as s from (select doc_id, h, unnest(range(0, greatest(len(h)//2-49, 0))) as i from d)),
f as (select s, min(doc_id) as m from w group by s),
hit as (select doc_id, i from w join f using (s) where m < doc_id group by all),
o as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as o from hit),
k as (select doc_id, i, sum(o) over (partition by doc_id order by i rows unbounded preceding) as k from o),
r as (select doc_id, k, min(i) as a, max(i)+50 as b from k group by all),
g as (select r.doc_id, a, b, substr(h, 2*coalesce(lag(b) over (partition by r.doc_id order by a), 0)+1, 2*(a-coalesce(lag(b) over (partition by r.doc_id order by a), 0))) as before from r join d using (doc_id)),
t as (select doc_id, sum(b-a) as n_removed, count(*) as n_spans, max(b) as last, string_agg(before, '' order by a) as kept from g group by doc_id)
select d.doc_id, len(h)//2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2*coalesce(last, 0)+1))) as kept_sha256
from d left join t using (doc_id)
""",
}
