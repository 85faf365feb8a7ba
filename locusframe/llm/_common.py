"""What the operators of this subpackage share: row-wise Arrow maps, packed batches, checkpoints."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of a batch on its way to Python, and rows that are worked on together: what bounds a worker's memory.
ARROW_BYTES, ROWS = 8_000_000, 1_000
#: Bytes of text in a packed batch; a longer document is a batch of its own.
BATCH_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends batches of at most ARROW_BYTES to Python from now on."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(filter(str.isdigit, conf.get(key, str(1 << 26))))) > ARROW_BYTES:
        conf.set(key, ARROW_BYTES)
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder that all executors share, without its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def parts(df: DataFrame) -> int:
    """Input partitions of df; a measure of its size that needs no job."""
    return max(1, df.rdd.getNumPartitions())


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def arrow_list(values, kind: T.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=to_arrow_type(kind))


def give_back() -> None:
    """Memory that is free again goes back to the machine: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """run, a function of a task or a group; what it held is given back once it is done."""
    if inspect.isgeneratorfunction(run):

        @wraps(run)
        def tidied(batches):
            yield from run(batches)
            give_back()
    elif run.__code__.co_argcount == 1:  # Spark counts the arguments

        @wraps(run)
        def tidied(table):
            out = run(table)
            give_back()
            return out
    else:

        @wraps(run)
        def tidied(left, right):
            out = run(left, right)
            give_back()
            return out

    return tidied


def annotate(df: DataFrame, inputs: list[str], make: Callable, fields: T.StructType) -> DataFrame:
    """Columns ``row`` (all of df's columns) and ``out`` (a struct of fields), one row for each of df.

    make() is called once in a task and gives a function from the Arrow arrays of the input columns
    to one list of values for each field. df's own columns may have any names: both structs keep
    them apart. Rows pass through as Arrow data, untouched.
    """
    rows = small_batches(df).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    at = [df.columns.index(c) for c in inputs]
    schema = T.StructType([rows.schema["row"], T.StructField("out", fields, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, len(b), ROWS)):
            row = batch.column(0)
            found = work(*[row.field(i) for i in at])
            arrays = [arrow_list(v, f.dataType) for v, f in zip(found, fields, strict=True)]
            out = pa.StructArray.from_arrays(arrays, names=fields.names)
            yield pa.RecordBatch.from_arrays([row, out], names=["row", "out"])
        give_back()

    return rows.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Null texts are empty."""
    return [x or "" for x in column.to_pylist()]


def octets(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null texts are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def pack(df: DataFrame, id_col: str, text_col: str, size: int = BATCH_BYTES) -> DataFrame:
    """Rows (batch, ids, sizes, blob): documents in compressed batches of about size bytes of text.

    The number of a batch holds the number of the input partition, so a repeated task makes the same
    batches again: df has to be a table or a checkpoint, which give the same rows in the same order each
    time. A null text is empty; ids keep their type and may be null.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("blob", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        data: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            columns = [[number], [ids], [[len(x) for x in data]], [squeeze(b"".join(data))]]
            return pa.RecordBatch.from_arrays([arrow_list(c, f.dataType) for c, f in zip(columns, schema, strict=True)], names=schema.names)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), octets(batch.column(1))):
                if data and held + len(text) > size:
                    yield out()
                    number, ids, data, held = number + 1, [], [], 0
                ids.append(name)
                data.append(text)
                held += len(text)
        if data:
            yield out()

    return small_batches(df).select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(tidy(run), schema)


def unpack(sizes: list[int], blob: bytes) -> list[bytes]:
    data, ends = unsqueeze(blob), np.cumsum([0, *sizes]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def logistic(row: np.ndarray, column: np.ndarray, positive: np.ndarray, negative: np.ndarray, mean: np.ndarray, precision: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression under normal priors, by Newton steps that conjugate gradients solve.

    (row, column): where a row has a feature; positive and negative: how much each row counts for either answer.
    """
    n, total = len(positive), positive + negative
    times = lambda w: np.bincount(row, weights=w[column], minlength=n)
    back = lambda v: np.bincount(column, weights=v[row], minlength=len(mean))

    def loss(w: np.ndarray) -> float:
        z = times(w)
        return float(positive @ np.logaddexp(0, -z) + negative @ np.logaddexp(0, z) + 0.5 * precision @ (w - mean) ** 2)

    w, now = mean.astype(float), loss(mean)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -500, 500)))
        slope = back(positive - total * p) - precision * (w - mean)
        h = total * p * (1 - p)
        scale = np.bincount(column, weights=h[row], minlength=len(mean)) + precision
        step, rest = np.zeros_like(w), slope.copy()
        way = rest / scale
        size = rest @ way
        for _ in range(100):
            if size < 1e-12:
                break
            bent = back(h * times(way)) + precision * way
            a = size / (way @ bent)
            step, rest = step + a * way, rest - a * bent
            new = rest @ (rest / scale)
            way, size = rest / scale + new / size * way, new
        for _ in range(20):
            if (then := loss(w + step)) < now:
                break
            step /= 2
        else:
            break
        w, done = w + step, now - then < 1e-9 * (1 + abs(now))
        now = then
        if done:
            break
    return w
