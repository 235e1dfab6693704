"""Shared helpers: shared-folder tables, Arrow text batches, vectorised hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import materialize  # noqa: F401  (written tables, for all operators)

#: The characters that separate words: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of the Arrow batches between the JVM and Python (see ``small_batches``).
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by ``BATCH_BYTES`` (a longer text is a
    batch of its own). Both ends hold whole batches beside the JVM's heap, and
    Spark's own bounds, 10 000 rows or 64 MB, are tens of megabytes of texts for
    each of them. A smaller bound of the session's stays."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_KEY))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def give_back() -> None:
    """Freed memory that Arrow's pool and the allocator kept goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` over a task's batches, after which the worker gives back what it
    freed: workers are used again and idle ones live on beside busy ones."""
    def task(batches):
        yield from run(batches)
        give_back()
    return task


def text_of(docs: DataFrame, text_col: str):
    """The text as a string, null as the empty string."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``max_bytes`` of text (a longer
    text is a run of its own): yields (first row, end row, bytes, offsets)."""
    col = batch.column(column)
    if pa.types.is_large_string(col.type):
        width = np.int64
    else:
        col, width = col.cast(pa.string()), np.int32
    n = len(col)
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], dtype=width)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _rule_table(seed: int, n: int) -> np.ndarray:
    """n 64-bit values from the splitmix64 rule."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, vectorised (uint64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _rule_table(17, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[32, 9, 10, 11, 12, 13]] = True
_POW: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, 0 .. n - 1."""
    if len(_POW["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _ODD), ("down", _ODD_INV)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _POW[key] = np.cumprod(run, dtype=np.uint64)
    return _POW["up"][:n], _POW["down"][:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and row of every word; words never cross rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_IS_SEP[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a row begins here
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


#: Bytes hashed at once: bounds the temporary arrays of very long texts.
STRIDE = 1 << 22


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word (A-Z lower-cased on demand)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRIDE, side="right")))
            a, b = int(starts[i]), int(ends[j - 1])
            up, down = powers(b - a + 1)
            run = np.zeros(b - a + 1, np.uint64)
            np.cumsum((_BYTE_LOWER if lower else _BYTE)[data[a:b]] * up[:-1], out=run[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (len(words) - k + 1)."""
    with np.errstate(over="ignore"):
        n = len(words) - k + 1
        out = np.zeros(max(n, 0), np.uint64)
        for i in range(k if n > 0 else 0):
            out = out * _ODD + words[i:i + n]
        return mix(out + np.uint64(k))


def map_texts(docs: DataFrame, keep: dict, text_col: str, schema: str, fn) -> DataFrame:
    """``keep`` columns (all kept in place) and, for every row, the columns of
    ``schema`` that ``fn`` makes of a list of texts (null as ""): it returns one
    list of values per column. Arrow batches, one pass over the rows."""
    base = docs.select(*[c.alias(k) for k, c in keep.items()], text_of(docs, text_col).alias("__text"))
    shape = base.drop("__text").schema
    extra = base.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    names = [f.name for f in extra]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        types = [to_arrow_type(f.dataType) for f in extra]
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            cols = fn(texts)
            rest = [batch.column(k) for k in shape.names]
            yield pa.RecordBatch.from_arrays([*rest, *[pa.array(c, t) for c, t in zip(cols, types)]], [*shape.names, *names])

    from pyspark.sql.types import StructType
    return base.mapInArrow(lean(run), StructType([*shape.fields, *extra.fields]))


def span_digest(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
