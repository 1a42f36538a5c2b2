"""Shared helpers of the corpus operators: staging, Arrow text access, vectorised byte and word scans.

Conventions that every operator keeps:

* a null text is an empty text; null keys are allowed and stay null;
* rows are never merged by key: two equal rows give two result rows;
* extra columns are ignored unless an operator says otherwise;
* an operator that must identify rows uses ``with_row_id``; its input must be re-readable in the same
  order (files, or a table staged by ``stage``).
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.shipping import ship

U64 = np.uint64
#: Odd base of the polynomial hashes over bytes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text that the vectorised scans take at once (a longer text is a block of its own).
BLOCK_BYTES = 1 << 19


#: Rows of an Arrow batch, where the session has Spark's default: texts are long, and a batch is held in both processes.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _TRIM = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode, where it is unset, a temporary one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "setloom-checkpoints")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    small_batches(spark)
    path = f"{shared_dir(spark)}/setloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """An eager ``checkpoint()`` into the shared folder, for small tables of loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_row_id(df: DataFrame, name: str = "_sl_row") -> DataFrame:
    ship(df.sparkSession)
    return df.withColumn(name, F.monotonically_increasing_id())


def packed_rows(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[Column]]:
    """The text beside one struct of all other columns, whose names then clash with nothing; and the columns that undo it."""
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(F.lit(0).alias("_sl_none"), *others).alias("_sl_doc"), text)
    return packed, [F.col(text) if c == text else F.col("_sl_doc").getField(c).alias(c) for c in docs.columns]


def id_text(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).cast("string")


def bucket_of(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text modulo n; null for a null id."""
    return F.crc32(id_text(doc_id).cast("binary")) % F.lit(n)


def ascii_lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = ascii_lower_table()


def separators(chars: bytes | range | list[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACE_SEP = separators([0x20, *range(0x09, 0x0E)])
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after A-Z are lower-cased).
ALNUM_SEP = separators([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, without copying, and the n + 1 offsets of its rows."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    elif pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    else:
        return text_buffers(col.cast(pa.string()))
    n = len(col)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, kind, n + 1 + col.offset)[col.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if col.null_count:
        # A null slot may cover bytes in theory; rewrite so that it is empty.
        size = np.where(np.asarray(col.is_valid()), np.diff(offsets), 0)
        if (size != np.diff(offsets)).any():
            raw = np.concatenate([raw[offsets[i] : offsets[i] + size[i]] for i in range(n)] or [raw[:0]])
            offsets = np.concatenate([[0], np.cumsum(size)])
    return raw, offsets


def text_blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (first, last + 1) with their bytes and offsets from 0, of about ``limit`` bytes each."""
    raw, offsets = text_buffers(col)
    n, at = len(col), 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of each byte position."""
    return np.searchsorted(offsets, starts, side="right") - 1


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a byte-wise array over each row."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:], dtype=np.int64)
    return c[offsets[1:]] - c[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes (in place on a copy)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least, modulo 2**64."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _powers:
        up, down = np.empty(size, U64), np.empty(size, U64)
        for out, base in ((up, BASE), (down, BASE_INV)):
            out[:] = U64(base)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
        _powers.clear()
        _powers[size] = (up, down)
    return _powers[size]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of byte * BASE**i; a substring's hash is (P[e] - P[s]) * BASE**-s."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, *, hashes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Byte starts and ends of all words of a block, the number of words before each row (n + 1), and 64-bit word hashes."""
    n = len(data)
    inside = ~sep[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= sep[data[:-1]] | edge[1:n]
    last = inside.copy()
    last[:-1] &= sep[data[1:]] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.searchsorted(starts, offsets)
    if not hashes:
        return starts, ends, counts, None
    p = prefix_hash(data)
    _, down = powers(n + 1)
    h = (p[ends] - p[starts]) * down[starts]
    return starts, ends, counts, mix64(h)


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes (empty when there are fewer)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = h[:m].copy()
    for j in range(1, k):
        out *= U64(BASE)
        out += h[j : j + m]
    return mix64(out)


def str_array(values: list) -> pa.Array:
    return pa.array(values, pa.string())
