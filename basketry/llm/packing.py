"""Best-fit packing with several permitted sequence lengths.

Pieces are placed longest first into the open bin they fill best. When none has
room, a new bin is opened in the size that promises the least cost per token:
for each permitted size the rest of the block is laid in greedily, and the
size's cost (a fixed part, the tokens, and attention's square) is divided by
what it would hold. In the end every bin is cut down
to the smallest permitted size that holds its contents.

Pieces are dealt into blocks by a hash; a block holds about ``block_rows``
pieces and is packed by one task, so bins never span blocks and at most a few
bins of a block stay part-filled.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from basketry.llm.common import lean, materialize, text_of
from basketry.llm.token_counts import FEW_MISSES, counter, counts_by_digest

SIZES = (512, 1024, 2048, 4096)


def greedy_fill(counts: np.ndarray, top: int, room: int) -> int:
    """Tokens that the longest fitting pieces put into ``room``; ``counts`` is
    the number of unplaced pieces by length, none longer than ``top``."""
    held, used = 0, {}
    size = min(top, room)
    while room > 0 and size > 0:
        size = min(size, room)
        while size > 0 and counts[size] - used.get(size, 0) <= 0:
            size -= 1
        if size <= 0:
            break
        n = min(int(counts[size]) - used.get(size, 0), room // size)
        used[size] = used.get(size, 0) + n
        held += n * size
        room -= n * size
        if room < size:
            size = room
    return held


def cost(size: int, bin_cost: float, attention: float) -> float:
    return bin_cost + size + size * size / attention


def pack_block(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, bin_cost: float = 32.0, attention: float = 8192.0):
    """(bin, offset, final size of the bin) of every piece, given longest first."""
    n = len(lengths)
    counts = np.bincount(lengths, minlength=max(sizes) + 1)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rooms: list[tuple[int, int]] = []  # (room left, bin), sorted
    filled: list[int] = []
    choice: dict[tuple[int, int], int] = {}
    since = 0
    for i in range(n):
        x = int(lengths[i])
        counts[x] -= 1
        at = bisect.bisect_left(rooms, (x, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            # pieces of one length that open bins in a row see nearly the same
            # rest: look ahead anew for every 64th of them
            key = (x, since // 64)
            if key not in choice:
                best = []
                for size in sizes:
                    if size >= x:
                        held = x + greedy_fill(counts, x, size - x)
                        fit = min((s for s in sizes if s >= held), default=size)
                        best.append((cost(min(size, fit), bin_cost, attention) / max(held, 1), size))
                choice[key] = min(best)[1]
            since += 1
            room, b = choice[key], len(filled)
            filled.append(0)
        where[i], offset[i] = b, filled[b]
        filled[b] += x
        if room > x:
            bisect.insort(rooms, (room - x, b))
    final = np.array(sizes)[np.searchsorted(sizes, filled)] if filled else np.zeros(0, np.int64)
    return where, offset, final[where] if n else where


def _pack(sizes: tuple[int, ...], bin_cost: float, attention: float):
    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["piece"].to_numpy(), t["rid"].to_numpy(), -t["length"].to_numpy()))
        t = t.take(pa.array(order))
        where, offset, final = pack_block(t["length"].to_numpy().astype(np.int64), sizes, bin_cost, attention)
        return t.append_column("bin", pa.array(where)).append_column("bin_offset", pa.array(offset)).append_column("bin_size", pa.array(final.astype(np.int64)))
    return run


def pack(docs: DataFrame, length: Column, sizes: tuple[int, ...] = SIZES, bin_cost: float = 32.0, attention: float = 8192.0, block_rows: int = 20_000, id_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, block, bin, bin_offset,
    bin_size (bins are numbered within a block).

    A document longer than the largest size is cut into pieces of that size and
    a rest; the pieces cover it without gap or overlap. Length 0 or null (a null
    text) gives one empty piece. Rows that repeat an id are separate documents.
    A row's block is a hash of its place in the table, so no id or length makes
    a block hot; the number of blocks grows with the table. Ties in length are
    placed in row order. An empty table gives no rows; further columns, whatever
    their names, play no part.
    """
    one = docs.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("total"))
    rows = materialize(one.withColumn("rid", F.monotonically_increasing_id()), "lengths")
    return _packed(rows, [], sizes, bin_cost, attention, block_rows)


def _packed(rows: DataFrame, extra: list[tuple[str, Column]], sizes: tuple[int, ...], bin_cost: float, attention: float, block_rows: int) -> DataFrame:
    """``pack`` over a written table (rid, doc_id, total, ...), with further
    columns of each piece."""
    sizes = tuple(sorted({int(s) for s in sizes}))
    if not sizes or sizes[0] <= 0:
        raise ValueError("sizes must be positive")
    top = sizes[-1]
    last = F.greatest(F.floor((F.col("total") - 1) / top).cast("int"), F.lit(0))
    n = rows.agg(F.sum(last + 1)).first()[0] or 0
    blocks = max(1, -(-int(n) // block_rows))
    start = F.col("piece").cast("long") * top
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        F.pmod(F.xxhash64("rid", "piece"), F.lit(blocks)).alias("block"), "rid", "doc_id", "piece", start.alias("start"), F.least(F.lit(top).cast("long"), F.col("total") - start).alias("length"),
        *[c.alias(name) for name, c in extra])
    shape = StructType([*pieces.schema.fields, *[StructField(c, LongType()) for c in ("bin", "bin_offset", "bin_size")]])
    return pieces.groupBy("block").applyInArrow(_pack(sizes, bin_cost, attention), shape).drop("rid")


def _long_cuts(tokenizer_path: str, top: int):
    def run(batches):
        for b in batches:
            text, c = b.column("text"), counter(tokenizer_path)
            found = [c.cuts(text[i].as_py(), top) for i in range(len(text))]  # one text at a time in Python
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(found, pa.list_(pa.int64()))], ["digest", "cuts"])
    return run


def pack_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, sizes: tuple[int, ...] = SIZES, bin_cost: float = 32.0, attention: float = 8192.0, block_rows: int = 20_000,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack`` by tokens: lengths come from the token cache, and every piece has
    its range of the text's UTF-8 bytes (byte_start, byte_end). Texts of more
    tokens than the largest size are encoded to find where their pieces begin; a
    piece's bytes are those of its tokens, so a character of several tokens may
    be parted. What holds of nulls, empty and long texts and repeated ids in
    ``pack`` holds here."""
    top = max(sizes)
    text = text_of(docs, text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    found = materialize(base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    counts = counts_by_digest(found.select("digest"), base.select("digest", "text"), tokenizer_path, cache_path)
    long = materialize(counts.filter(F.col("n_tokens") > top).select("digest"), "long")
    parted = base.select("digest", "text").join(F.broadcast(long) if long.count() <= FEW_MISSES else long, "digest", "left_semi").dropDuplicates(["digest"])
    cuts = materialize(parted.mapInArrow(lean(_long_cuts(tokenizer_path, top)), "digest string, cuts array<bigint>"), "cuts")
    rows = materialize(found.join(counts, "digest").join(cuts, "digest", "left").withColumnRenamed("n_tokens", "total").drop("digest"), "lengths")
    begin = F.when(F.col("piece") == 0, F.lit(0).cast("long")).otherwise(F.try_element_at("cuts", F.col("piece")))
    end = F.coalesce(F.try_element_at("cuts", F.col("piece") + 1), F.col("n_bytes"))
    return _packed(rows, [("byte_start", begin), ("byte_end", end)], sizes, bin_cost, attention, block_rows)


def pack_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``pack`` by the number of words of each whole text."""
    words = F.size(F.array_remove(F.split(text_of(docs, text_col), r"[\x20\x09-\x0D]+", -1), ""))
    return pack(docs, words, id_col=id_col, **options)
