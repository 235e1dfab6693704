"""Removal of repeated byte strings by column-wise BWT construction.

Every byte covered by a ``length``-byte string that also starts earlier in the
corpus is removed. Suffixes are sorted the multi-document way: documents are
inserted in step, one symbol of each a round, right to left; a round's sorted
symbols (the collection's Burrows-Wheeler segment) decide by a stable counting
step where the longer suffixes go, and the common prefixes of neighbours are
carried along. Suffixes that share ``length`` symbols are repeats.

To do this over a corpus, only places that can repeat are inserted, in
collections of bounded size:

1. equal texts become one document, and texts go to a table bucketed by key;
2. of each ``length``-byte window the least hash of its ``gram``-byte strings is
   its anchor. Equal windows have equal anchors at the same offset, so windows
   of anchors that occur once are done;
3. around each anchor that occurs again, the bytes of its windows are cut out;
   all cuts of one anchor, aligned at it, form a collection. An anchor with
   more than ``block`` occurrences is salted into several collections;
4. each collection is inserted column by column. Windows of salted anchors
   that are first in their collection meet once more, by digest, over all
   collections of the corpus;
5. the removed ranges join their texts, bucket by bucket.

The sequential files of the construction are Spark's sorted shuffle partitions,
read as a stream; one segment of a bounded collection is held at a time.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import STRIDE, _BYTE, materialize, mix, powers, text_of, text_slices
from basketry.session import scratch_path

LENGTH = 100
GRAM = 24
#: Occurrences of an anchor from which on it is salted, and rows inserted together.
BLOCK = 2000
#: Text bytes of a bucket of the table of texts.
BUCKET_BYTES = 16 << 20
ROWS = 20_000


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of consecutive windows with one anchor: (row, first window, number
    of windows, anchor - first window, hash), offsets within the row. ``data``
    is at least as long as one window only if a row has one."""
    wide = length - gram + 1  # grams of a window
    z = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return z, z, z, z, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = powers(len(data) + 1)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=run[1:])
        grams = len(data) - gram + 1
        h = mix((run[gram:gram + grams] - run[:grams]) * down[:grams])
    # leftmost minimum of every ``wide`` grams: block-wise suffix and prefix minima
    blocks = -(-grams // wide) + 1
    low = np.uint64((1 << wide.bit_length()) - 1)
    key = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
    key[:grams] = h & ~low
    key = key.reshape(blocks, wide) | np.arange(wide, dtype=np.uint64)
    pre = np.minimum.accumulate(key, axis=1).ravel()
    suf = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    s = np.arange(n)
    a, b = suf[:n], pre[wide - 1:wide - 1 + n]
    left = (a & ~low) <= (b & ~low)
    base = s // wide * wide
    spot = np.where(left, base + (a & low).astype(np.int64), (s + wide - 1) // wide * wide + (b & low).astype(np.int64))
    row = np.searchsorted(offsets, s, side="right") - 1
    ok = s + length <= offsets[row + 1]
    new = ok.copy()
    new[1:] &= (spot[1:] != spot[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
    at = np.flatnonzero(new)
    valid = np.cumsum(ok)
    count = np.diff(np.append(valid[at] - 1, valid[-1]))  # valid windows up to the next run
    r = row[at]
    return r, at - offsets[r], count, spot[at] - at, h[spot[at]]


def _runs(batch: pa.RecordBatch, length: int, gram: int):
    """``anchors`` of a batch, slice by slice; a very long text is gone through
    in overlapping pieces (a run that a border cuts is two runs)."""
    for lo, hi, data, offsets in text_slices(batch, "text"):
        for p in range(0, len(data) if hi - lo == 1 else 1, STRIDE):
            piece = data[p:p + STRIDE + length - 1] if hi - lo == 1 else data
            r, first, count, off, h = anchors(piece, np.array([0, len(piece)]) if hi - lo == 1 else offsets, length, gram)
            yield lo, r, first + p, count, off, h


def _anchor_rows(length: int, gram: int):
    """A window run is packed: first window << 14 | (windows - 1) << 7 | anchor offset."""
    def run(batches):
        for b in batches:
            tid = b.column("tid").to_numpy()
            for lo, r, first, count, off, h in _runs(b, length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tid[lo + r]), pa.array((first << 14) | (count - 1 << 7) | off)], ["h", "tid", "at"])
    return run


_CUT = "h long, salt int, id long, dk long, sub long, first long, windows int, off int, bytes binary, last long"


def _cut(length: int):
    """Cuts the windows' bytes out of the texts. Equal cuts of a batch travel
    once: the later ones are repeats already (rows without bytes)."""
    def run(batches):
        names = [x.split()[0] for x in _CUT.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
        for b in batches:
            out, seen, n = [], {}, 0
            docs = sorted(zip(b.column("id").to_pylist(), b.column("dk").to_pylist(), b.column("sub").to_pylist(), range(b.num_rows)))
            texts, lists = b.column("text"), b.column("runs")
            for doc, dk, sub, i in docs:
                t = texts[i].as_py().encode()
                hs, salts, ats = (lists[i].values.field(x).to_pylist() for x in ("h", "salt", "at"))
                for at, h, salt in sorted(zip(ats, hs, salts)):
                    first, count, off = at >> 14, (at >> 7 & 127) + 1, at & 127
                    cut = t[first:first + count - 1 + length]
                    key = (h, off, cut)
                    if key in seen:
                        out.append((dk ^ first, 0, doc, dk, sub, first, 0, 0, None, first + count - 1))
                    else:
                        seen[key] = True
                        n += len(cut)
                        out.append((h, salt, doc, dk, sub, first, count, off, cut, None))
                if len(out) >= ROWS or n > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out), types)], names)
                    out, seen, n = [], {}, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out), types)], names)
    return run


class Collection:
    """Suffix order of aligned strings, grown by one column a round.

    ``order`` lists the strings by group and current suffix, ``lcp`` has the
    common prefix (up to ``cap`` symbols) of each with the one before it.
    Symbol 0 is the end of a string: it equals nothing.
    """

    def __init__(self, groups: np.ndarray, cap: int):
        self.order = np.argsort(groups, kind="stable")
        self.groups, self.cap = groups, cap
        self.lcp = np.zeros(len(groups), np.uint8)

    def insert(self, column: np.ndarray) -> None:
        """Puts one symbol before every suffix."""
        bwt = column[self.order].astype(np.int64)  # in the order of the suffixes it precedes
        key = self.groups[self.order] * 257 + bwt
        move = np.argsort(key, kind="stable")  # equal symbols keep their suffixes' order
        key = key[move]
        gap = np.diff(move)
        same = np.flatnonzero((key[1:] == key[:-1]) & (bwt[move[1:]] > 0))
        lcp = np.zeros(len(move), np.uint8)
        if len(same):
            gaps = gap[same]
            least = self.lcp[move[same] + 1].copy()  # right for gaps of 1
            level, span, table = 1, 1, self.lcp
            while True:
                if span > 1:
                    pick = (gaps >= span) & (gaps < 2 * span)
                    p, q = move[same[pick]] + 1, move[same[pick] + 1] - span + 1
                    least[pick] = np.minimum(table[p], table[q])
                if 2 * span > gaps.max():
                    break
                table = np.minimum(table[:len(table) - span], table[span:])
                span *= 2
            lcp[same + 1] = np.minimum(least.astype(np.int64) + 1, self.cap)
        self.order, self.lcp = self.order[move], lcp


def _block(t: pa.Table, length: int, gram: int):
    """Inserts the collections of ``t``: (dk, sub, first, last) of repeated
    windows, and for salted groups (digest, id, dk, sub, window) of the first."""
    n = t.num_rows
    col = {c: t[c].to_numpy() for c in ("h", "salt", "id", "dk", "sub", "first", "windows", "off")}
    left = length - gram
    buf = t["bytes"].combine_chunks()
    lens = np.asarray(pa.compute.binary_length(buf).to_numpy(zero_copy_only=False), np.int64)
    joined = np.frombuffer(b"".join(buf.to_pylist()), np.uint8)
    width = left + length
    m = np.zeros((width, n), np.uint16)
    rows = np.repeat(np.arange(n), lens)
    at = np.arange(len(joined)) - np.repeat(np.cumsum(lens) - lens, lens)
    m[at + np.repeat(left - col["off"].astype(np.int64), lens), rows] = joined.astype(np.uint16) + 1
    _, groups = np.unique(np.stack([col["h"], col["salt"].astype(np.int64)], 1), axis=0, return_inverse=True)
    groups = groups.ravel().astype(np.int64)
    salted = col["salt"] >= 0
    anchor = col["first"] + col["off"]
    rank = np.empty(n, np.int64)
    rank[np.lexsort((anchor, col["sub"], col["dk"], col["id"]))] = np.arange(n)
    repeat = np.zeros((left + 1, n), bool)
    single = np.zeros((left + 1, n), bool)
    c = Collection(groups, length)
    for j in range(width - 1, -1, -1):
        c.insert(m[j])
        if j > left:
            continue
        owned = (j >= left - col["off"]) & (j < left - col["off"] + col["windows"])
        begin = np.flatnonzero(c.lcp < length)
        r = rank[c.order]
        best = np.repeat(np.minimum.reduceat(r, begin), np.diff(np.append(begin, n)))
        repeat[j, c.order] = r > best
        repeat[j] &= owned
        single[j, c.order] = r == best
        single[j] &= owned & salted
    # runs of repeated windows, row by row
    flat = np.pad(repeat.T, ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(flat, axis=1)
    r0, a = np.nonzero(step == 1)
    r1, b = np.nonzero(step == -1)
    ranges = (col["dk"][r0], col["sub"][r0], anchor[r0] - left + a, anchor[r0] - left + b - 1)
    w, who = np.nonzero(single)
    digests = []
    start = np.cumsum(lens) - lens
    for j, i in zip(w.tolist(), who.tolist()):
        p = int(start[i]) + j - (left - int(col["off"][i]))
        digests.append(hashlib.blake2b(joined[p:p + length].tobytes(), digest_size=16).digest())
    firsts = (digests, col["id"][who], col["dk"][who], col["sub"][who], anchor[who] - left + w)
    return ranges, firsts


_FOUND = "digest binary, id long, dk long, sub long, first long, last long"


def _insert(length: int, gram: int):
    """Streams a sorted partition: whole groups, about ROWS rows at a time."""
    def emit(t):
        (dk, sub, a, b), (digest, i, dk2, sub2, s) = _block(t, length, gram)
        x, y = len(dk), len(digest)
        null = pa.nulls
        yield pa.RecordBatch.from_arrays([null(x, pa.binary()), null(x, pa.int64()), pa.array(dk), pa.array(sub), pa.array(a), pa.array(b)], ["digest", "id", "dk", "sub", "first", "last"])
        if y:
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(i), pa.array(dk2), pa.array(sub2), pa.array(s), pa.array(s)], ["digest", "id", "dk", "sub", "first", "last"])

    def run(batches):
        wait, held = [], 0
        for b in batches:
            known = b.filter(pa.compute.is_valid(b.column("last")))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(known.num_rows, pa.binary()), pa.nulls(known.num_rows, pa.int64()), *[known.column(c) for c in ("dk", "sub", "first", "last")]],
                                                 ["digest", "id", "dk", "sub", "first", "last"])
            b = b.filter(pa.compute.is_null(b.column("last")))
            if b.num_rows == 0:
                continue
            wait.append(b)
            held += b.num_rows
            if held >= ROWS:
                t = pa.Table.from_batches(wait)
                h, s = t["h"].to_numpy(), t["salt"].to_numpy()
                change = np.flatnonzero((h[1:] != h[:-1]) | (s[1:] != s[:-1]))
                if len(change):
                    cut = int(change[-1]) + 1
                    yield from emit(t.slice(0, cut))
                    wait = t.slice(cut).combine_chunks().to_batches()
                    held = t.num_rows - cut
        if held:
            yield from emit(pa.Table.from_batches(wait))
    return run


def _strip(length: int):
    def run(batches):
        for b in batches:
            out = []
            for t, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                t = t.encode()
                spans, kept, pos = [], hashlib.sha256(), 0
                for a, z in sorted((x["first"], x["last"] + length) for x in runs):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], z)
                    else:
                        spans.append([a, z])
                for a, z in spans:
                    kept.update(t[pos:a])
                    pos = z
                kept.update(t[pos:])
                out.append((sum(z - a for a, z in spans), len(spans), kept.hexdigest(), [{"start": a, "end": z} for a, z in spans]))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("dk"), b.column("sub"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                                              pa.array(cols[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["dk", "sub", "n_removed", "n_spans", "kept_sha256", "spans"])
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, spans (removed byte ranges, start and end).

    Texts are UTF-8 bytes, null as empty; "earlier" is a smaller id, then a
    smaller start. A null id comes after all others. Rows that repeat an id
    with other text are ordered by the text's hash; rows equal in id and text
    are one document listed twice and get the same result.
    ``gram`` < ``length`` <= 127 + gram. Very long texts are worked whole, in
    strides; an empty table gives no rows; further columns, whatever their
    names, play no part.
    """
    if not 0 < gram < length or length - gram > 126:
        raise ValueError("0 < gram < length <= gram + 126")
    spark = docs.sparkSession
    text = text_of(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    keyed = rows.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("dk", F.xxhash64("text")).withColumn("sub", F.xxhash64("text", F.lit("sub")))
    n_bytes = F.octet_length("text").cast("long")
    kept_all = F.sha2(F.col("text").cast("binary"), 256)
    heads = keyed.select("doc_id", "id", "dk", "sub", n_bytes.alias("n_bytes"), kept_all.alias("whole"))

    # one row per text, bucketed as the joins below need it
    buckets = max(8, -(-int(heads.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET_BYTES))
    name, path = f"texts_{uuid.uuid4().hex}", scratch_path(spark, "texts")
    (keyed.filter(n_bytes >= length).groupBy("dk", "sub").agg(F.min("id").alias("id"), F.any_value("text").alias("text"))
     .withColumn("tid", F.monotonically_increasing_id()).write.bucketBy(buckets, "dk", "sub").option("path", path).saveAsTable(name))
    texts = spark.table(name)

    found = texts.select("tid", "text").mapInArrow(_anchor_rows(length, gram), "h long, tid long, at long")
    # a text has one run from a window on, so rows of one anchor are its places; found and shuffled once
    again = materialize(found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h"))).filter("n > 1").drop("n"), "anchors")
    # as a table of its own, so that the join below can split a hot anchor
    hot = materialize(again.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("h", F.ceil(F.col("n") / block).cast("int").alias("parts")), "hot")
    salted = again.join(hot, "h", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("tid", "at"), F.col("parts")).cast("int"), F.lit(-1)))
    per_text = salted.groupBy("tid").agg(F.collect_list(F.struct("h", "salt", "at")).alias("runs"))  # bounded by the text
    placed = per_text.join(texts.select("tid", "dk", "sub"), "tid").select("dk", "sub", "runs")
    cuts = texts.select("dk", "sub", "id", "text").join(placed, ["dk", "sub"]).mapInArrow(_cut(length), _CUT)
    results = materialize(cuts.repartition(buckets, "h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_insert(length, gram), _FOUND), "repeats")

    # salted anchors: the first of each collection against those of the others
    firsts = results.filter("digest is not null").select("digest", "id", "dk", "sub", "first")
    best = firsts.groupBy("digest").agg(F.min(F.struct("id", "dk", "sub", "first")).alias("best"))
    late = firsts.join(best, "digest").filter(F.struct("id", "dk", "sub", "first") != F.col("best")).select("dk", "sub", "first", F.col("first").alias("last"))
    ranges = results.filter("digest is null").select("dk", "sub", "first", "last").unionByName(late)
    runs = ranges.groupBy("dk", "sub").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # bounded by the text
    done = texts.select("dk", "sub", "id", "text").join(runs, ["dk", "sub"]).drop("id").mapInArrow(
        _strip(length), "dk long, sub long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")
    owners = texts.select("dk", "sub", F.col("id").alias("first_id"))
    # one row per text, as a table: the join can split a text that many rows share
    per_class = materialize(owners.join(done, ["dk", "sub"], "left"), "stripped")
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # the entry; all that follows reads written results
    out = heads.join(per_class, ["dk", "sub"], "left")
    copy = F.col("first_id").isNotNull() & (F.col("id") != F.col("first_id"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.expr("cast(array() as array<struct<start: long, end: long>>)")
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"))
