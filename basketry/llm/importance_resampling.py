"""Importance resampling towards a target distribution, on hashed n-grams.

Texts are lower-cased (A-Z), cut into words and encoded by Arrow kernels:
``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode``. Shifted dictionary indices form the bigrams and
trigrams, which are dictionary-encoded again, so a CRC is taken once per
distinct n-gram of a batch (from the CRCs of its words) and never per
occurrence. The gains of a document's n-grams are taken by index and summed
over its segment.

Two passes: bucket counts of both tables (a fixed number of buckets: the only
thing the tasks are sent), then every document's weight. Documents are drawn by
their highest weight plus seeded Gumbel noise, ranked by score ranges.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from basketry.llm.common import materialize, text_of

#: What separates words: every ASCII character but digits and letters (texts are lower-cased first).
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text encoded at once; a longer text is cut after a separator.
PIECE = 1 << 22


# ------------------------------------------------------------------ CRC-32 of joined strings
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_BYTES = _byte_table()


def _shift_tables() -> list[np.ndarray]:
    """For every power of two, four byte tables that carry a CRC over that many
    further zero bytes."""
    out, image = [], np.uint32(1) << np.arange(32, dtype=np.uint32)
    image = _BYTES[image & 255] ^ (image >> np.uint32(8))
    for _ in range(31):
        tables = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            tables[bit >> 3] ^= np.where((np.arange(256) >> (bit & 7)) & 1, image[bit], np.uint32(0)).astype(np.uint32)
        out.append(tables)
        image = _carried(image, tables)
    return out


def _carried(crc: np.ndarray, t: np.ndarray) -> np.ndarray:
    return t[0][crc & 255] ^ t[1][(crc >> np.uint32(8)) & 255] ^ t[2][(crc >> np.uint32(16)) & 255] ^ t[3][crc >> np.uint32(24)]


_SHIFT = _shift_tables()


def joined_crc(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of ``first + b" " + second``, from the CRCs of both."""
    reg = first ^ np.uint32(0xFFFFFFFF)
    crc = (_BYTES[(reg ^ np.uint32(32)) & 255] ^ (reg >> np.uint32(8))) ^ np.uint32(0xFFFFFFFF)
    for i in range(int(second_bytes.max(initial=0)).bit_length()):
        hit = np.flatnonzero((second_bytes >> i) & 1)
        crc[hit] = _carried(crc[hit], _SHIFT[i])
    return crc ^ second


# ------------------------------------------------------------------ words and n-grams of a batch
def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and the row of each."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATOR)
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    return flat.filter(real), row.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(texts: pa.Array):
    """Runs of rows of at most ``PIECE`` bytes, in order: (first row, words, row
    of each word, words carried over). A longer text comes in several runs, each
    led by the last two words before it."""
    texts = texts.cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo, n = 0, len(texts)
    while lo < n:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + PIECE, side="right")))
        if ends[hi - 1] - done <= PIECE:
            words, row = _words(texts.slice(lo, hi - lo))
            yield lo, words, row, 0
        else:
            text, at, carry = texts[lo].as_py(), 0, pa.array([], pa.large_string())
            while at < len(text):
                end = min(len(text), at + PIECE // 4)
                while end < len(text) and (ord(text[end]) > 127 or (text[end].isalnum())):
                    end += 1
                words, _ = _words(pa.array([text[at:end]], pa.large_string()))
                words = pa.concat_arrays([carry, words])
                yield lo, words, np.zeros(len(words), np.int64), len(carry)
                carry, at = words.slice(max(0, len(words) - 2)), end
        lo = hi


def _features(words: pa.Array, row: np.ndarray, carried: int, longest: int):
    """For n-grams of 1 .. ``longest`` words that end behind the carried words:
    (CRC of each distinct one, index of each occurrence, row of each)."""
    enc = words.dictionary_encode()
    index = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    raw = [w.encode() for w in enc.dictionary.to_pylist()]
    crc = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    yield crc, index[carried:], row[carried:]
    run, runs_crc = index, crc
    for n in range(2, longest + 1):
        if len(index) < n:
            return
        same = row[n - 1:] == row[:len(row) - n + 1]
        code = (run[:len(index) - n + 1] * len(raw) + index[n - 1:])
        gram = pa.array(code).dictionary_encode()
        pairs = gram.dictionary.to_numpy(zero_copy_only=False)
        first, last = pairs // len(raw), pairs % len(raw)
        runs_crc = joined_crc(runs_crc[first], crc[last], size[last])
        run = gram.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        skip = max(0, carried - n + 1)
        hit = same.copy()
        hit[:skip] = False
        yield runs_crc, run[hit], row[n - 1:][hit]


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = 3, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket; buckets
    without any are left out. A null text has no words."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, words, row, carried in _runs(batch.column(0)):
                for crc, index, _ in _features(words, row, carried, longest):
                    total += np.bincount((crc % np.uint32(buckets))[index], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    return docs.select(text_of(docs, text_col)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """The gain of every bucket, from the counts of both tables: as many numbers
    as buckets, whatever the tables' size."""
    spark = source.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    ratio = ((d["t"] + 1) * (d["all_s"] + buckets)) / ((d["s"] + 1) * (d["all_t"] + buckets))
    rows = both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def weights(docs: DataFrame, gains: np.ndarray, keep: dict[str, Column], text_col: str = "text", longest: int = 3) -> DataFrame:
    """``keep`` columns, n_words, n_features and weight (the sum of the gains of
    all n-grams) of every row."""
    base = docs.select(*[c.alias(k) for k, c in keep.items()], text_of(docs, text_col).alias("__text"))
    names, buckets = list(keep), np.uint32(len(gains))

    def run(batches):
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, words, row, carried in _runs(batch.column("__text")):
                rows = int(row[-1]) + 1 if len(row) else 0
                n_words[lo:lo + rows] += np.bincount(row[carried:], minlength=rows)
                for crc, index, at in _features(words, row, carried, longest):
                    gain = gains[crc % buckets].take(index)
                    # the occurrences of a row lie together: sums by segment
                    sums, edge = np.concatenate(([0], np.cumsum(gain))), np.searchsorted(at, np.arange(rows + 1))
                    weight[lo:lo + rows] += sums[edge[1:]] - sums[edge[:-1]]
                    n_features[lo:lo + rows] += np.diff(edge)
            rest = [batch.column(k) for k in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words), pa.array(n_features), pa.array(weight)], [*names, "n_words", "n_features", "weight"])

    shape = base.drop("__text").schema
    return base.mapInArrow(run, shape.add("n_words", "long").add("n_features", "long").add("weight", "long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = 10_000, longest: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of every row of ``docs``:
    of those with ``min_words`` words, ``percent`` in a hundred (rounded down)
    are drawn by the highest score and ranked from 1; the others' rank is null.

    Null and empty texts have no words (weight 0, never drawn). Noise depends on
    the seed and the id alone; a null id counts as the empty string and loses
    ties. Rows that repeat an id are separate rows; wholly equal rows are
    interchangeable. Very long texts are encoded in pieces with the same result.
    An empty table gives no rows, an empty target a constant numerator. Further
    columns of either table, whatever their names, play no part.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, text_col, longest, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = materialize(weights(docs, gains, {"doc_id": F.col(id_col)}, text_col, longest).withColumn("score", F.col("weight") + noise)
                          .withColumn("_in", F.col("n_words") >= min_words), "weights")
    order = [F.desc("_in"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("n_words")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(weighed.repartitionByRange(parts, *order).withColumn("_b", F.spark_partition_id()), "score-ranges")
    sizes = ranged.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.count_if("_in").alias("ok"))
    earlier = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"), F.floor(F.sum("ok").over(W.partitionBy()) * percent / 100).alias("_drawn"))
    placed = ranged.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(*order))).join(F.broadcast(offsets), "_b")  # one row per range
    rank = F.col("_r") + F.col("_before")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(rank <= F.col("_drawn"), rank).cast("long").alias("rank"), "n_words")
