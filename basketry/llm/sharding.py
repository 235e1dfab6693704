"""Sharding: proportional stratified interleaving.

Rows of every source are shuffled by a seeded hash and ranked; sorting all rows
by their fractional rank (rank + 1/2) / (rows of the source) interleaves the
sources in proportion, and cutting that order evenly makes every shard match
the mixture. DataFrame functions only.

A rank is never a window over a source or over the table: a hash range of a
source (or a range of fractional ranks) is one window group, and the offset of
each range comes from an aggregate of at most ``buckets`` rows per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

#: Hash ranges per source, and fractional-rank ranges, at least; and the rows of
#: one on average at most. Each is one window group, so ranges grow with the table.
RANGES, RANGE_ROWS = 1024, 20_000


def _offsets(counts: DataFrame, by: list[str], key: str, total: str, offset: str) -> DataFrame:
    """Adds the running count before each range and the total, per ``by``."""
    w = W.partitionBy(*by)
    run = w.orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.withColumn(offset, F.sum("n").over(run) - F.col("n")).withColumn(total, F.sum("n").over(w))


def interleave(docs: DataFrame, shards: int, stratum: Column, order_key: Column, ties: list[Column], keep: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """``keep`` columns plus shard and slot of every row of ``docs``.

    ``order_key`` is the seeded shuffle key, a lower-case hex string (such as
    ``md5``) of which ranges are even; ``ties`` break equal keys (rows equal in
    all of them are interchangeable). A null stratum is a stratum of its own.
    ``buckets`` is the number of ranges (as many as ``RANGE_ROWS`` asks for
    unless given). Counts of shards differ by at most one. An empty table gives
    no rows.
    """
    buckets = buckets or max(RANGES, -(-docs.count() // RANGE_ROWS))
    hexes = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    base = docs.select(
        F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit("")).alias("_s"), order_key.alias("_h"),
        F.struct(*[c.alias(f"t{i}") for i, c in enumerate(ties)]).alias("_t"), F.struct(*[c.alias(k) for k, c in keep.items()]).alias("_k"),
    ).withColumn("_b", (hexes * F.lit(buckets) / F.lit(1 << 32)).cast("int"))
    ranges = _offsets(base.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("n")), ["_s"], "_b", "_of", "_before")
    in_range = F.row_number().over(W.partitionBy("_s", "_b").orderBy("_h", "_t"))
    ranked = base.join(ranges.drop("n"), ["_s", "_b"]).withColumn("_r", F.col("_before") + in_range - 1)
    # exact: compared as fractions of integers well below 2^53, one division
    frac = (2 * F.col("_r") + 1).cast("double") / (2 * F.col("_of")).cast("double")
    placed = ranked.select("_s", "_r", "_k", frac.alias("_f")).withColumn("_c", F.floor(F.col("_f") * buckets).cast("int"))
    cells = _offsets(placed.groupBy("_c").agg(F.count(F.lit(1)).alias("n")), [], "_c", "_all", "_before")
    in_cell = F.row_number().over(W.partitionBy("_c").orderBy("_f", "_s", "_r"))
    pos = placed.join(cells.drop("n"), "_c").withColumn("_p", F.col("_before") + in_cell - 1)
    shard = F.expr(f"_p * {int(shards)} div _all")
    first = F.expr(f"(_g * _all + {int(shards) - 1}) div {int(shards)}")
    return pos.withColumn("_g", shard).select("_k.*", F.col("_g").cast("int").alias("shard"), (F.col("_p") - first).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: str = "0", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shard counts differ by at most one. Size is the UTF-8
    bytes of the text plus 8; a null text counts as empty, a null id or source
    is ordinary. Rows that repeat an id are separate rows, ordered by size and
    checksum; wholly equal rows are interchangeable. The shuffle key is hashed
    from id and checksum, so rows that share an id (or have none) spread over the
    ranges. Texts of any length are only measured; an empty table gives no rows;
    further columns, whatever their names, play no part.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size, crc = F.octet_length(text).cast("long") + 8, F.crc32(text.cast("binary"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), crc.cast("string")).cast("binary"))
    out = interleave(docs, shards, F.col(source_col), key, [F.col(id_col), size, crc], {"doc_id": F.col(id_col), "size": size, "text_crc32": crc}, buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
