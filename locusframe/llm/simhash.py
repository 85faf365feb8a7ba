"""SimHash near-duplicates with BK-trees.

A document's fingerprint has a bit set if more than half of its 3-word shingles' hashes have it.
Fingerprints that differ in at most RADIUS bits are linked. Only distinct fingerprints are compared,
so exact copies cost one row. Five blocks of bits make ten keys of two blocks; two fingerprints
within three bits share two whole blocks, so every link lies inside one key. A key with many
fingerprints is dealt on by blocks of its other bits, by the same argument. In each key a BK-tree
(children by their distance to the parent) is grown and searched within the radius.

Trees belong to the shard of a key and are grown where the shard is: sending all of them to every
executor, or fingerprints to the driver, would grow with the corpus.

near_copies() has another rule: a Jaccard similarity over 5-word shingles of 0.8 at least. Fingerprints
of such pairs differ in about ten bits and often in more, so no keys of blocks find them. There the
shards of the trees are the shingles that similar sets must share (prefixes), the radius is wide, and
what the trees find is compared exactly. Pairs that may be similar leave no rows: a task gives links that
join them, and the sets that are joined so are compared in one place.

Cases: null and wordless texts have fingerprint zero and are linked like any other; repeated rows
each get a row; a null id takes part in links, but is no component's id unless nothing else is; texts
of any length are read whole; an empty table gives no rows; columns of docs may have any names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import annotate, checkpointed, octets, small_batches, table, tidy

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Words of a shingle and least similarity (as a fraction) of near copies.
WORDS, SIMILAR = 5, (4, 5)
#: Bits in which fingerprints of similar sets may differ, by size. At 0.8 they differ in 10 on average (12 for small sets), with a
#: deviation of 3: one pair in a million is beyond.
SMALL, RADII = 125, (30, 24)
#: Documents sampled for common shingles, how many of them have one, and how many shingles that may be.
SAMPLE, OFTEN, COMMON = 2_000, 4, 500_000
#: A common shingle's documents are dealt to so many parts.
SALTS = 64
#: Parities kept of a set of shingles, at most.
BITS = 4_096
#: Sets that are compared in one task, and shingles of the texts that are; more are dealt over pairs of such blocks.
BLOCK, HELD = 4_000, 500_000
#: Rows of a broadcast, of about 100 bytes each, and links that one task joins.
SENT, FEW = 300_000, 300_000
#: First bit and length of the five blocks of a fingerprint.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: A key with more distinct fingerprints than this is dealt on by its other bits.
LARGE = 256

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    """The shingles of the lower-cased words, repeats included; of fewer words, all of them as one."""
    words = text.translate(LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    return [line[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes (unsigned) have."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big") if len(hashes) else 0


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    own = shingles(text, size)
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), np.uint64, len(own)))


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Rows (row, out): out.fingerprint as a signed long."""
    return annotate(docs, [text_col], lambda: lambda column: ([signed(fingerprint(x, size)) for x in octets(column)],), T.StructType([T.StructField("fingerprint", T.LongType(), False)]))


class BKTree:
    """Children are keyed by their distance to the parent; a search follows only edges within the radius."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> list[int]:
        """Positions of the values within the radius of this one."""
        found: list[int] = []
        values, children = self.values, self.children
        todo = [0] if values else []
        while todo:
            k = todo.pop()
            d = (values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            for edge, child in children[k].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found

    def add(self, value: int) -> None:
        """A value that is in the tree stays there once."""
        values, children = self.values, self.children
        k, new = 0, len(values)
        while new:
            d = (values[k] ^ value).bit_count()
            if d == 0:
                return
            nxt = children[k].get(d)
            if nxt is None:
                children[k][d] = new
                break
            k = nxt
        values.append(value)
        children.append({})

    def search_and_add(self, value: int, radius: int) -> list[int]:
        found = self.search(value, radius)
        self.add(value)
        return found


def links_within(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join all values (unsigned) of each component: (value, root), root the smallest."""
    tree = BKTree()
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for v in values:
        up.setdefault(v, v)
        for k in tree.search_and_add(v, radius):
            a, b = root(v), root(tree.values[k])
            if a != b:
                up[max(a, b)] = min(a, b)
    return [(v, r) for v in up if (r := root(v)) != v]


def _bits(value, lo: int, n: int):
    return F.shiftrightunsigned(value, lo).bitwiseAND(F.lit((1 << n) - 1))


def keyed(prints: DataFrame) -> DataFrame:
    """(fp, key): each distinct fingerprint under every key that a link may share."""
    fp = F.col("fp")
    pairs = [(i, j) for i in range(5) for j in range(i)]
    first = F.array(*[F.shiftleft(F.lit(p).cast("long"), 26) + F.shiftleft(_bits(fp, *BLOCKS[i]), 13) + _bits(fp, *BLOCKS[j]) for p, (i, j) in enumerate(pairs)])
    rows = prints.select("fp", F.explode(first).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    rows = rows.join(sizes, "key")
    # the bits outside the two blocks of each pair, in four runs
    finer = []
    for i, j in pairs:
        rest = [(lo, n) for k, (lo, n) in enumerate(BLOCKS) if k not in (i, j)]
        (a, x), (b, y), (c, z) = rest
        runs = [(a, x), (b, y), (c, z // 2), (c + z // 2, z - z // 2)]
        finer.append(F.array(*[F.concat_ws(":", F.col("key"), F.lit(k), _bits(fp, *r)) for k, r in enumerate(runs)]))
    pair = F.shiftrightunsigned(F.col("key"), 26)
    fine = F.element_at(F.array(*finer), (pair + 1).cast("int"))
    key = F.when(F.col("size") <= LARGE, F.array(F.col("key").cast("string"))).otherwise(fine)
    return rows.select("fp", F.explode(key).alias("key"))


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a > b: links over the distinct values of column fp that join whatever is within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []

        def close():
            return [(signed(a), signed(b)) for a, b in links_within(own, radius)] if len(own) > 1 else []

        found: list[tuple[int, int]] = []
        for batch in batches:
            for k, v in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                if k != key:
                    found += close()
                    key, own = k, []
                own.append(v % (1 << 64))  # signs would spoil the distances
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
                found = []
        found += close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    rows = keyed(prints)
    near = rows.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(tidy(run), "a long, b long")
    return near.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): the smallest node it can reach; large and small stars in turn."""
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        edges = checkpointed(small.filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(now)


def joined(links: DataFrame) -> DataFrame:
    """components() of links, a checkpoint. Few links are joined in one task: rounds of stars would cost far more, most of it in small files."""
    if links.count() > FEW:
        return components(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        found = [(x, r) for x in up if (r := root(x)) != x]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["node", "root"])

    return checkpointed(links.select("a", "b").coalesce(1).mapInArrow(tidy(run), "node long, root long"))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, text): what tells rows apart even where ids repeat."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def join_hot(rows: DataFrame, named: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the one row of named that has their key. Keys that a thousandth of all rows share go by a broadcast (there are a thousand of them at most), the rest by a shuffle."""
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= max(total / 1_000, 10_000)).select(key)
    hot = checkpointed(named.join(hot, key, "left_semi"))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(named, key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def grouped_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) from rows with fp and the roots (node, root) of linked fps."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    grouped = checkpointed(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    total, several = grouped.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    names = join_hot(grouped.select("fp", "root"), least, "root", several)
    return join_hot(rows.select("doc_id", "text_hash", "fp"), names, "fp", total)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for each document; root names its group, component_id is the smallest id in it."""
    found = fingerprints(identified(docs, id_col, text_col), "text", size)
    prints = checkpointed(found.select("row.doc_id", "row.text_hash", F.col("out.fingerprint").alias("fp")))
    return grouped_rows(prints, components(fingerprint_links(prints.select("fp").distinct())))


def hash_set(text: bytes, size: int) -> np.ndarray:
    """Distinct hashes of the shingles, in order."""
    own = shingles(text, size)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), np.uint64, len(own)).view(np.int64))


def parities(own: np.ndarray) -> bytes:
    """Whether an odd number of members falls into each of 2 len(own) places or more, up to BITS."""
    n = min(BITS, max(64, 1 << (2 * len(own) - 1).bit_length() if len(own) else 64))
    return np.packbits(np.bincount(own & (n - 1), minlength=n) & 1).tobytes()


def within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are known; np.isin would sort all the known ones each time."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def is_similar(common: int, a: int, b: int) -> bool:
    """Whether sets of a and b members, common ones among them, have a Jaccard similarity of SIMILAR at least."""
    p, q = SIMILAR
    return q * common >= p * (a + b - common)


def prefix(n: int) -> int:
    """Of two similar sets in one order, one's first so many members hold one of the other's."""
    p, q = SIMILAR
    return n - (p * n + q - 1) // q + 1 if n else 0


def radius_of(n: int) -> int:
    return RADII[n >= SMALL]


def may_be_similar(x: int, a: int, y: int, b: int) -> bool:
    """Never false for similar sets of a and b members: parities x and y (of as many places) differ in no more places than the sets in members."""
    p, q = SIMILAR
    return q * min(a, b) >= p * max(a, b) and (p + q) * (x ^ y).bit_count() <= (q - p) * (a + b)


def folded(bits: int, wide: int, to: int) -> int:
    """Parities over fewer places: places that fall together are added up."""
    while wide > to:
        wide //= 2
        bits = bits >> wide ^ bits & ((1 << wide) - 1)
    return bits


def common_hashes(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes of shingles that many of a sample of documents have. Which they are decides the work to do, not what is found."""
    share = min(1.0, SAMPLE / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in octets(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(hash_set(text, size), pa.int64())], names=["h"])

    found = docs.select("text").sample(share, 5).mapInArrow(tidy(run), "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    rows = found.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64))


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, fp, n, sim, bits, rare, often) of rows (doc_id, text_hash, text).

    fp: a hash of the set of shingles; n: its size; sim: its SimHash; bits: its parities. rare and often: the prefix of
    the set in an order that has common shingles last, which similar sets can't both miss; null where the task has given
    that of an equal set before.
    """
    given = docs.sparkSession.sparkContext.broadcast(common_hashes(docs, size))

    def make():
        seen: set[int] = set()

        def work(column):
            out: list[list] = [[] for _ in range(6)]
            for text in octets(column):
                own = hash_set(text, size)
                fp = signed(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                rare = often = None
                if fp not in seen:
                    last = within(own, given.value)
                    k, first = prefix(len(own)), own[~last]
                    rare, often = first[:k], own[last][: max(0, k - len(first))]
                    if len(seen) < 500_000:
                        seen.add(fp)
                for c, v in zip(out, (fp, len(own), signed(majority(own.view(np.uint64))), parities(own), rare, often)):
                    c.append(v)
            return [*out[:4], *map(int64_lists, out[4:])]

        return work

    longs = T.ArrayType(T.LongType())
    fields = T.StructType([T.StructField("fp", T.LongType(), False), T.StructField("n", T.IntegerType(), False), T.StructField("sim", T.LongType(), False), T.StructField("bits", T.BinaryType(), False), T.StructField("rare", longs), T.StructField("often", longs)])
    return annotate(docs, ["text"], make, fields).select("row.doc_id", "row.text_hash", "out.*")


def int64_lists(rows: list) -> pa.Array:
    """Lists of numbers, or null."""
    ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)], dtype=np.int32)
    values = np.concatenate([np.zeros(0, np.int64), *(r for r in rows if r is not None)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()), mask=pa.array([r is None for r in rows], pa.bool_()))


def meetings(keys: DataFrame) -> DataFrame:
    """(h, salt, fp, m) of rows (h, salt, fp): sets of a shard beside its least. A shard with one set has no row, unless it is one of several of its shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # shingle, salt and least of the shard that goes on
        for batch in batches:
            h, salt, fp = (batch.column(k).to_numpy() for k in range(3))
            if not len(h):
                continue
            new = np.r_[last is None or (h[0], salt[0]) != last[:2], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]
            head = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            m = np.where(head < 0, last[2] if last else 0, fp[head])
            own = (fp != m) | (new & (salt > 0))
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (h, salt, fp, m)], names=["h", "salt", "fp", "m"])
            last = (h[-1], salt[-1], m[-1])

    rows = keys.repartition(F.col("h"), F.col("salt")).sortWithinPartitions("h", "salt", "fp")
    return rows.mapInArrow(tidy(run), "h long, salt int, fp long, m long")


def unlike(n: int, wide: int, x: int, m: int, its_wide: int, y: int) -> bool:
    """Whether sets of n and m members, with parities x and y of so many places, can't be similar."""
    w = min(wide, its_wide)
    return not may_be_similar(folded(x, wide, w), n, folded(y, its_wide, w), m)


def close_links(members: list[tuple], up: dict[int, int]) -> list[tuple[int, int]]:
    """Links (a, b), a > b, of labels, that join whatever may be similar of the sets (label, n, sim, bits) of a shard; found by a BK-tree of their SimHashes.

    up has the links of other shards and gets these. However many pairs a shard has, its links are fewer than its labels.
    A label's sets are looked for among those of others, the most frequent label's not at all.
    """

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    groups: dict[int, list[tuple]] = defaultdict(list)
    for label, n, sim, bits in members:
        groups[root(label)].append((n, sim, 8 * len(bits), int.from_bytes(bits, "big")))
    tree, places = BKTree(), {}
    held: list[list[tuple]] = []
    out: list[tuple[int, int]] = []
    for label, own in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
        for n, sim, wide, x in own if places else ():
            here = root(label)
            for k in tree.search(sim, radius_of(n)):
                for other, *its in held[k]:
                    if (there := root(other)) != here and not unlike(n, wide, x, *its):
                        here, there = min(here, there), max(here, there)
                        up[there] = here
                        out.append((there, here))
                        if len(out) == len(groups) - 1:
                            return out
        for n, sim, wide, x in own:
            if sim not in places:
                places[sim] = len(held)
                held.append([])
                tree.add(sim)
            held[places[sim]].append((label, n, wide, x))
    return out


def in_pairs(rows: DataFrame, key: str, many) -> DataFrame:
    """rows with _i and _j, a place for each two blocks of a key's sets (fp), so that any two sets meet; many, an aggregate, is how many blocks a key has."""
    dealt = rows.join(rows.groupBy(key).agg(many.cast("int").alias("_blocks")), key)
    other = F.sequence(F.lit(0), F.col("_blocks") - 1)
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(other)).filter("_own <> _other or _blocks = 1")
    return dealt.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_blocks", "_own", "_other")


def shard_pairs(rows: DataFrame) -> DataFrame:
    """(a, b), a > b: links of labels that join whatever may be similar of rows (h, fp, label, n, sim, bits) of shards h."""
    dealt = in_pairs(rows, "h", F.ceil(F.count("*") / BLOCK)).select("h", "_i", "_j", "fp", "label", "n", "sim", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        up: dict[int, int] = {}
        for _, shard in groupby(rows, lambda r: r[:3]):
            if found := close_links([(label, n, sim % (1 << 64), bits) for *_, label, n, sim, bits in shard], up):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    place = ["h", "_i", "_j"]
    return small_batches(dealt.repartition(*place).sortWithinPartitions(*place, "fp")).mapInArrow(tidy(run), "a long, b long").distinct()


def similar_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of positions that join all of each component of similar sets (as of hash_set): every two sets of different components are compared, unless one's prefix rules it out."""
    size = np.array([len(own) for own in sets])
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(often, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[code]  # rare shingles have small numbers
    ends, starts = np.cumsum(size), np.r_[0, np.cumsum(often[order])]
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
    having = lambda some: np.concatenate([holders[starts[v] : starts[v + 1]] for v in some])
    group = np.arange(len(sets))
    out = []
    for i in range(len(sets)):
        own = np.sort(code[ends[i] - size[i] : ends[i]])
        if not len(own) or (group[having(own[: prefix(len(own))])] == group[i]).all():
            continue
        common = np.bincount(having(own), minlength=len(sets))
        for j in np.flatnonzero(is_similar(common, size[i], size) & (group != group[i])).tolist():
            if group[j] != group[i]:
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def joined_sets(docs: DataFrame, rows: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(a, b): links that join all similar sets of one block, of rows (block, fp, n), a checkpoint. The sets are made again from the texts, one text of each."""
    key = (F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text_hash").alias("_hash"))
    one = checkpointed(rows.join(members, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct(*key)).alias("k")).select("fp", "k.*"))
    # texts stay where they are unless very many of them are wanted
    one = F.broadcast(one) if one.count() <= SENT else one
    texts_ = docs.select(*key, "text").join(one, ["_none", "_id", "_hash"]).select("fp", "text").dropDuplicates(["fp"])
    dealt = in_pairs(members, "block", F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / HELD))).join(texts_, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns[:4]), octets(batch.column(4))))
        for _, block in groupby(rows, lambda r: r[:3]):
            names, sets = zip(*((fp, hash_set(text, size)) for *_, fp, text in block))
            if found := [(names[i], names[j]) for i, j in similar_links(sets)]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    place = ["block", "_i", "_j"]
    return small_batches(dealt.select(*place, "fp", "text").repartition(*place).sortWithinPartitions(*place, "fp")).mapInArrow(tidy(run), "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for each document: groups by links of a Jaccard similarity of SIMILAR at least, over the sets of shingles.

    Similar sets share a shingle of their prefixes, whatever order the shingles have; so each shingle of prefixes is a
    shard. First each set is held against the least of its shards, which joins most of a group of copies without any
    pairs of it. Shards whose sets aren't all joined that way have their BK-trees searched; shards of the same sets count
    once. All this joins what may be similar, into blocks; similar sets are always in one. Within blocks sets are compared
    exactly.
    """
    own = identified(docs, id_col, text_col)
    rows = checkpointed(sketched(own, size))
    sets = rows.groupBy("fp").agg(F.min("n").alias("n"), F.min("sim").alias("sim"), F.any_value("bits").alias("bits"))
    dealt = F.concat(F.transform("rare", lambda h: F.struct(h.alias("h"), F.lit(0).alias("salt"))), F.transform("often", lambda h: F.struct(h.alias("h"), (F.pmod(F.xxhash64("fp"), F.lit(SALTS)) + 1).cast("int").alias("salt"))))
    met = checkpointed(meetings(rows.filter("rare is not null").select("fp", F.explode(dealt).alias("k")).select("k.h", "k.salt", "fp")))

    # each set and the least of its shard, and the leasts of a common shingle's shards
    firsts = met.filter("salt > 0").groupBy("h").agg(F.min("m").alias("a"))
    stars = met.select(F.col("m").alias("a"), F.col("fp").alias("b")).union(met.filter("salt > 0").select("h", "m").join(firsts, "h").select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
    of = lambda side: sets.select(F.col("fp").alias(side), F.struct("n", "sim", "bits").alias(f"{side}_"))
    beside = stars.join(of("a"), "a").join(of("b"), "b")
    p, q = SIMILAR
    reach = F.when(F.col("b_.n") < SMALL, RADII[0]).otherwise(RADII[1])
    near = (q * F.least("a_.n", "b_.n") >= p * F.greatest("a_.n", "b_.n")) & (F.bit_count(F.col("a_.sim").bitwiseXOR(F.col("b_.sim"))) <= reach)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, x, m, y = (c.to_pylist() for c in batch.columns)
            rows = [(i, j) for i, j, c, v, d, w in zip(a, b, n, x, m, y) if not unlike(c, 8 * len(v), int.from_bytes(v, "big"), d, 8 * len(w), int.from_bytes(w, "big"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), ()))], names=["a", "b"])

    tried = checkpointed(small_batches(beside.filter(near).select("a", "b", "a_.n", "a_.bits", F.col("b_.n").alias("m"), F.col("b_.bits").alias("y"))).mapInArrow(tidy(likely), "a long, b long"))

    # sets that are joined already have one label, whatever shard joined them
    roots = joined(tried)
    members = met.select("h", "fp").union(met.select("h", "m")).distinct()
    labelled = members.join(roots, members["fp"] == roots["node"], "left").select("h", "fp", F.coalesce("root", "fp").alias("label"))
    same = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.sum(F.xxhash64("fp", F.lit(1)).cast("decimal(38,0)")).alias("s"))
    open_ = labelled.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *same).filter("lo < hi").groupBy("n", "x", "s").agg(F.min("h").alias("h")).select("h")
    shards = labelled.join(open_, "h").join(sets, "fp").select("h", "fp", "label", "n", "sim", "bits")
    blocks = joined(checkpointed(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(shard_pairs(shards))))
    blocks = blocks.union(blocks.select("root", "root")).distinct().toDF("fp", "block")
    members = checkpointed(blocks.join(sets.select("fp", "n"), "fp").select("block", "fp", "n"))
    return grouped_rows(rows, joined(checkpointed(joined_sets(own, rows, members, size))))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates) -> DataFrame:
    """One row of each group that find gives, with all its columns.

    It is the row of the smallest id, of several with that id the one whose text has the smallest hash; ids that are null
    come last. Of rows that agree in both, one stays. Ids may repeat and columns may have any names: rows are told apart
    by id and text. Null and empty texts are a group.
    """
    key = (F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    kept = find(docs, id_col, text_col).groupBy("root").agg(F.min(F.struct(*key)).alias("k"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kept = kept.select("k.none", text(F.col("k.id")).alias("id"), "k.hash").distinct()
    ident = F.col(f"`{id_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ident.isNull().alias("none"), text(ident).alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"))
    names = ["none", "id", "hash"]
    return rows.join(kept, names, "left_semi").dropDuplicates(names).select("row.*")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the whole table by 3-word fingerprints within 3 bits. Every row has a row; see the module for odd texts and ids."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
