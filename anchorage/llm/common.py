"""Helpers the corpus operators share: reading, lineage cuts and vectorised word hashing.

A *word* is a maximal run of bytes of the UTF-8 text outside ``\\x20`` and
``\\x09-\\x0D``.  Words are hashed to 64 bits with numpy, whole documents at a
time, eight bytes after the other, each mixed before the next one is added; a
word of up to eight bytes shares its hash with none of its length.  Sequences of words are
hashed by composing word hashes, mixed at every step.  Nothing in them is
linear in the bytes, so no pattern makes different texts alike; two sequences
share a hash with a probability near 2**-64.  Where hashes of all documents
meet each other, two independent ones are compared.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of a text, for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest Arrow batch handed to Python, so that memory follows the batch and not the row count.
BATCH_BYTES = 2 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data folder with Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, because documents differ in length by orders of magnitude.

    The setting stays, as results are read when the caller likes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The session's folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset, a temporary folder is used if everything runs in one
    process, as in tests; on a cluster this raises RuntimeError.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Frees the shuffle files of a query when it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What the innermost ``scratch`` has to delete.
_held: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)


def stash(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder; this cuts its lineage.

    Its shuffle files are freed once it is written.  The Parquet goes with
    ``discard``, at the end of a ``scratch``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    delete_at_exit(spark, path)
    if (held := _held.get()) is not None:
        held.append(out)
    return out


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver's process ends."""
    place, files = _place(spark, path)
    files.deleteOnExit(place)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that was to go at the end."""
    place, files = _place(spark, path)
    files.delete(place, True)
    files.cancelDeleteOnExit(place)


def discard(*stashed: DataFrame) -> None:
    """Delete what ``stash`` wrote, once nothing that is still to run reads it."""
    for one in stashed:
        delete(one.sparkSession, one.stash_path)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end all that was stashed inside; what is to stay has been written elsewhere by then."""
    token = _held.set([])
    try:
        yield
    finally:
        discard(*(_held.get() or []))
        _held.reset(token)


def utf8(column: Column | str) -> Column:
    """The UTF-8 bytes of a text column, empty for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit("")).cast("binary")


def map_batches(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with one call of ``function(batch) -> RecordBatch | None`` per batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def binary_values(array: pa.Array) -> Iterator[memoryview]:
    """Views of a binary column's values, without copies; empty for null."""
    offsets = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4)
    data = array.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield view[start:end]


def list_column(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


# ---------------------------------------------------------------- hashing

_GIANT = 256  # longer words are hashed on their own
#: Mask of the first bytes of a little-endian 64-bit word, by their number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Multipliers of independent hashes of sequences.
_FAMILY = (U64(0x9DDFEA08EB382D69), U64(0xD6E8FEB86659FD93))


_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _tables:
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        _tables["space"] = space
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        _tables["lower"] = lower
    return _tables[name]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (in place)."""
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def byte_array(text: memoryview | bytes, lower: bool = False) -> np.ndarray:
    """The bytes of a text as a numpy array, A-Z lower-cased on request."""
    data = np.frombuffer(text, np.uint8)
    return _table("lower")[data] if lower else data


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    inside = np.zeros(len(data) + 2, np.int8)
    np.logical_not(_table("space")[data], out=inside[1:-1].view(bool))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, whatever stands around it."""
    if not len(starts):
        return np.empty(0, U64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    lengths = ends - starts
    out = mix64(eight[starts] & _FIRST[np.minimum(lengths, 8)] ^ lengths.astype(U64) * U64(0x9E3779B97F4A7C15))
    at, done = np.flatnonzero((lengths > 8) & (lengths <= _GIANT)), 8
    while len(at):
        more = eight[starts[at] + done] & _FIRST[np.minimum(lengths[at] - done, 8)]
        out[at] = mix64((out[at] ^ more) + U64(done))
        done += 8
        at = at[lengths[at] > done]
    for i in np.flatnonzero(lengths > _GIANT):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=7)
    return out


def hashed_words(text: memoryview | bytes, lower: bool = False) -> np.ndarray:
    """Word hashes of a text."""
    data = byte_array(text, lower)
    return word_hashes(data, *word_bounds(data))


def gram_hashes(words: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` words, one for each start; those of the two families (0 and 1) are independent."""
    if len(words) < k:
        return np.empty(0, U64)
    return _grams(words, k, _FAMILY[family])


def _grams(words: np.ndarray, k: int, multiplier: np.uint64) -> np.ndarray:
    if k == 1:
        return words
    half = 1 << (k.bit_length() - 1)
    half = half // 2 if half == k else half
    left = _grams(words, half, multiplier)
    right = left if k - half == half else _grams(words, k - half, multiplier)
    n = len(words) - k + 1
    return mix64(left[:n] * multiplier + right[half : half + n] + U64(k))


def sequence_key(words: np.ndarray) -> bytes:
    """A 128-bit key of a whole sequence of words."""
    return xxhash.xxh3_128_digest(words.tobytes(), seed=len(words))
