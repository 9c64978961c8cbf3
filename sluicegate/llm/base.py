"""What the training-data operators share: inputs, written intermediates, packed arrays."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.session import work_folder

#: The bytes that separate words.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later reads survive a lost executor."""
    spark = df.sparkSession
    path = f"{work_folder(spark, label)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, UPPER.lower())


def crc_mod(column: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def id_key(column: Column) -> Column:
    """An id as a join key that is never null."""
    return F.coalesce(column.cast("string"), F.lit(""))


def free_name(columns: list[str], wanted: str) -> str:
    while wanted in columns:
        wanted += "_"
    return wanted


def restricted(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in kept, all columns."""
    key = free_name(docs.columns, "kept_key")
    ids = kept.select(id_key(F.col("doc_id")).alias(key)).distinct()
    stay = docs.withColumn(key, id_key(F.col("doc_id"))).join(ids, key, "left_semi")
    return stay.select(*[f"`{c}`" for c in docs.columns])


def values(column: pa.Array) -> list[bytes]:
    """Cells of a text or binary column as bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pack(array: np.ndarray) -> bytes:
    """An integer array, its bytes by significance (high bytes of small numbers shrink to nothing)."""
    a = np.ascontiguousarray(array)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else a
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(array: np.ndarray) -> bytes:
    """A sorted unsigned array as gaps."""
    a = array.astype(np.uint64)
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on whole arrays."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ROOT = 0x9E3779B97F4A7C15
#: A random number for each byte value.
BYTE_CODES = mix((np.arange(1, 257, dtype=np.uint64) * np.uint64(_ROOT)))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of them."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = _ROOT | 1
        have = tuple(
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
            for b in (base, pow(base, -1, 1 << 64)))
        _POWERS[0] = have
    return have


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums that give the hash of any substring: ``(sums, inverse powers)``.

    The hash of ``data[a:b]`` is ``mix((sums[b] - sums[a]) * inverse[a])``.
    """
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * power[:len(data)], out=sums[1:])
    return sums, inverse


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are no white space."""
    solid = np.ones(256, bool)
    solid[list(SPACES)] = False
    inside = np.concatenate([[False], solid[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ASCII-lower-cased words of all texts, and how many each text has."""
    data = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    start, end = word_spans(data)
    sums, inverse = prefix_hashes(data)
    hashes = mix((sums[end] - sums[start]) * inverse[start])
    size = np.array([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, np.cumsum(size))
    return hashes, np.diff(upto, prepend=0)


def slices(texts: list[bytes], most: int):
    """Ranges of consecutive texts of about ``most`` bytes together (one text may be longer)."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def release_memory() -> None:
    """Give freed memory back: a worker goes on to other stages, beside those of other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it wants
        pass


def releasing(work):
    """A function over batches that releases memory when its task has no more of them."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            release_memory()

    return run
