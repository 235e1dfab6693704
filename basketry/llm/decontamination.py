"""Benchmark decontamination by spaced-seed hashing, without loss.

A mask is a few token positions; the positions between them are ignored, so a
replaced token there does not matter. Windows of benchmark items and of
documents whose tokens agree under a mask are hits. Each item is searched by a
family of masks chosen for its length such that no set of replaced tokens which
the rules of an overlap allow can spoil every window of every mask (``least_to_block`` proves it). A hit fixes how item and document are aligned; the
aligned tokens are counted, then compared, and an overlap is reported if enough
of them agree.

Items of fewer than ``SHORT`` tokens say too little to be found inside a
sentence: they overlap a line that consists of exactly their tokens.

The benchmark's hashes are a stated query set: they are sent to the tasks in
blocks of bounded items and bytes, every block against all documents.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from basketry.llm.common import lean, mix, text_of, text_slices, word_bounds, word_hashes

#: Families of masks, the most selective first. All but the last two ignore
#: positions; those serve items of two tokens and of one, which leave no room.
MASKS = (
    ((0, 1, 2, 3, 6), (0, 1, 3, 5, 6)),
    ((0, 2, 3, 4),),
    ((0, 1, 3), (0, 2, 3)),
    ((0, 1, 3),),
    ((0, 2),),
    ((0, 1),),
    ((0,),),
)
#: Items of fewer tokens overlap whole lines only.
SHORT = 4
#: Hits, and aligned tokens, that are held at once.
AT_ONCE = 1 << 20
_TOKEN = np.zeros(256, np.uint8)
_TOKEN[48:58] = np.arange(48, 58)
_TOKEN[65:91] = np.arange(97, 123)
_TOKEN[97:123] = np.arange(97, 123)
_TOKEN[128:] = np.arange(128, 256)


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Hash, row and byte range of every token: a run of letters and digits
    (A-Z in lower case, bytes beyond ASCII as letters); the rest separates."""
    plain = _TOKEN[data]
    plain[plain == 0] = 32
    starts, ends, rows = word_bounds(plain, offsets)
    return word_hashes(plain, starts, ends, lower=False), rows, starts, ends


def masked(h: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Hash of every window under a mask."""
    n = len(h) - mask[-1]
    out = np.full(max(n, 0), number + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in mask if n > 0 else ():
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    return out


def gains(share: float) -> tuple[int, int]:
    """What an agreeing token adds to a run, and another one takes away: a run
    in which ``share`` agree does not fall below 0."""
    return round((1 - share) * 1000), round(share * 1000)


def needed(size: int, min_tokens: int, cover: float) -> int:
    """The agreeing tokens of an overlap with an item of ``size`` tokens."""
    return max(1, min_tokens if size * cover >= min_tokens else math.ceil(cover * size))


@functools.cache
def least_to_block(family: tuple[tuple[int, ...], ...], length: int) -> int:
    """The least number of tokens to replace in a run of ``length`` so that no
    mask of the family finds its positions unchanged anywhere: the cheapest path
    over the last few tokens' states."""
    shapes = [sum(1 << (m[-1] - j) for j in m) for m in family]
    recent = (1 << max(m[-1] for m in family)) - 1
    best = {0: 0}  # which of the last tokens are unchanged -> tokens replaced
    for _ in range(length):
        after: dict[int, int] = {}
        for state, n in best.items():
            for same in (0, 1):
                window = state << 1 | same
                if not same or all(window & p != p for p in shapes):
                    key, cost = window & recent, n + 1 - same
                    if cost < after.get(key, length + 1):
                        after[key] = cost
        best = after
    return min(best.values())


def most_replaced(length: int, size: int, min_tokens: int, share: float, cover: float) -> int:
    """The most replaced tokens an overlap of ``length`` aligned tokens may
    have; -1 if there is none of that length."""
    up, down = gains(share)
    least = needed(size, min_tokens, cover)
    return max((e for e in range(length - least + 1) if e * down <= (length - e) * up), default=-1)


@functools.cache
def family(size: int, min_tokens: int, share: float, cover: float) -> int | None:
    """The first family of ``MASKS`` that every overlap with an item of ``size``
    tokens hits, whatever is replaced; None if there can be no overlap. Runs of
    up to 100 tokens are tried: longer ones are made of such runs, one of which
    has no larger part replaced."""
    lengths = [n for n in range(1, min(size, 100) + 1) if most_replaced(n, size, min_tokens, share, cover) >= 0]
    if not lengths and size <= 100:
        return None
    for k, masks in enumerate(MASKS):
        if all(least_to_block(masks, n) > most_replaced(n, size, min_tokens, share, cover) for n in lengths):
            return k
    return len(MASKS) - 1  # single tokens: every overlap has one


class Seeds:
    """The masked windows of a block of benchmark items, of each item under its
    length's family."""

    def __init__(self, items: list[tuple[int, str]], min_tokens: int, share: float, cover: float):
        self.ids = [i for i, _ in items]
        self.toks = []
        keys, where, used = [], [], set()
        for n, (_, text) in enumerate(items):
            data = np.frombuffer((text or "").encode(), np.uint8)
            h = tokens(data, np.array([0, len(data)]))[0]
            self.toks.append(h)
            k = family(len(h), min_tokens, share, cover) if len(h) else None
            for i, mask in enumerate(MASKS[k] if k is not None else ()):
                found = masked(h, mask, 16 * k + i)
                used.add((k, i))
                keys.append(found)
                where.append(np.column_stack([np.full(len(found), n), np.arange(len(found))]))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.where = key[order], (np.concatenate(where) if where else np.zeros((0, 2), np.int64))[order]
        self.used = sorted(used)
        self.size = np.array([len(h) for h in self.toks], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([*self.toks, np.zeros(0, np.uint64)])
        self.needed = np.array([needed(int(z), min_tokens, cover) for z in self.size], np.int64)
        # one bit for the low 20 bits of every key: most windows end here
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, k: np.ndarray):
        """Pairs (position in k, entry) of equal hashes, some at a time."""
        near = np.flatnonzero(self.bits[(k & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.key, k[near], "left"), np.searchsorted(self.key, k[near], "right")
        near, lo, n = near[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        part = np.cumsum(n) // AT_ONCE
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(n)]
        for x, y in zip(cuts, cuts[1:]):
            m = n[x:y]
            yield np.repeat(near[x:y], m), np.repeat(lo[x:y], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)

    def aligned(self, h: np.ndarray, rows: np.ndarray, cut: np.ndarray, first: np.ndarray, last: np.ndarray):
        """The alignments with a hit and, in all, as many agreeing tokens as an
        overlap needs, some at a time: (row, item, shift, agreeing tokens).
        ``first`` and ``last`` mark the tokens at the ends of lines."""
        span = len(h) + int(self.size.max(initial=0)) + 1
        for k, i in self.used:
            for at, entry in self.hits(masked(h, MASKS[k][i], 16 * k + i)):
                n, p = self.where[entry, 0], self.where[entry, 1]
                key = np.unique((rows[at] * len(self.ids) + n) * span + at - p + int(self.size.max()))
                rn, shift = key // span, key % span - int(self.size.max())
                r, n = rn // len(self.ids), rn % len(self.ids)
                shift -= cut[r]
                a = np.maximum(0, -shift)
                size = np.minimum(self.size[n], cut[r + 1] - cut[r] - shift) - a
                keep = size >= self.needed[n]
                short = np.flatnonzero(keep & (self.size[n] < SHORT))
                begin = cut[r[short]] + shift[short]
                keep[short] = first[begin] & last[begin + self.size[n[short]] - 1] & (size[short] == self.size[n[short]])
                r, n, shift, a, size = r[keep], n[keep], shift[keep], a[keep], size[keep]
                part = np.cumsum(size) // AT_ONCE
                cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(size)]
                for x, y in zip(cuts, cuts[1:]):
                    if x == y:
                        continue
                    c = size[x:y]
                    begin = np.cumsum(c) - c
                    j = np.arange(c.sum()) - np.repeat(begin, c)
                    same = self.flat[j + np.repeat(self.first[n[x:y]] + a[x:y], c)] == h[j + np.repeat(cut[r[x:y]] + a[x:y] + shift[x:y], c)]
                    agree = np.add.reduceat(same.astype(np.int64), begin)
                    ok = agree >= np.where(self.size[n[x:y]] < SHORT, self.size[n[x:y]], self.needed[n[x:y]])
                    yield r[x:y][ok], n[x:y][ok], shift[x:y][ok], agree[ok]


def best_overlap(item: np.ndarray, doc: np.ndarray, shift: int, share: float) -> tuple[int, int, int]:
    """Of the aligned tokens (item p with document p + shift), the run with the
    most agreeing tokens among runs where at least ``share`` agree: (matches,
    first, end) in item positions, trimmed to agreements at both ends."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    same = item[a:b] == doc[a + shift:b + shift]
    up, down = gains(share)
    gain = np.concatenate(([0], np.cumsum(np.where(same, up, -down))))
    count = np.concatenate(([0], np.cumsum(same)))
    # for every end, the first start from which enough agree
    start = np.searchsorted(-np.minimum.accumulate(gain), -gain)
    m = count - count[start]
    end = int(np.argmax(m))
    run = np.flatnonzero(same[start[end]:end]) + int(start[end])
    return (len(run), a + int(run[0]), a + int(run[-1]) + 1) if len(run) else (0, a, a)


def overlaps(batch: pa.RecordBatch, column: str, s: Seeds, share: float):
    """(row, item_id, item_tokens, matches, span_tokens, byte_start, byte_end)
    of every overlap in a batch, the best run of each row and item."""
    out = []
    for lo, hi, data, offsets in text_slices(batch, column):
        h, rows, starts, ends = tokens(data, offsets)
        cut = np.searchsorted(rows, np.arange(hi - lo + 1))
        line = np.searchsorted(np.flatnonzero(data == 10), starts) + rows
        edge = np.concatenate(([True], line[1:] != line[:-1], [True])) if len(line) else np.ones(1, bool)
        best: dict = {}  # the best run of each row and item so far, never all their alignments
        for r, n, shift, agree in s.aligned(h, rows, cut, edge[:-1], edge[1:]):
            whole = agree == s.size[n]
            order = np.lexsort((shift, n, r, ~whole))
            r, n, shift, agree, whole = r[order], n[order], shift[order], agree[order], whole[order]
            pair = r * len(s.ids) + n
            keep = ~whole
            keep[np.unique(pair[whole], return_index=True)[1]] = True  # of whole copies, the earliest
            keep &= whole | ~np.isin(pair, pair[whole])
            for r1, n1, shift1, agree1 in zip(r[keep].tolist(), n[keep].tolist(), shift[keep].tolist(), agree[keep].tolist()):
                old = best.get((r1, n1))
                if old is not None and agree1 < old[0]:
                    continue
                m, first, end = best_overlap(s.toks[n1], h[cut[r1]:cut[r1 + 1]], shift1, share)
                if m >= s.needed[n1]:
                    got = (m, -(first + shift1), first, end, shift1)
                    best[r1, n1] = got if old is None else max(old, got)
        for (r, n), (m, _, first, end, shift) in sorted(best.items()):
            x, y = int(cut[r]) + first + shift, int(cut[r]) + end + shift - 1
            out.append((lo + r, s.ids[n], len(s.toks[n]), m, end - first, int(starts[x] - offsets[r]), int(ends[y] - offsets[r])))
    return out


def _search(items: list[tuple[int, str]], min_tokens: int, share: float, cover: float, names: list[str]):
    def run(batches):
        s = Seeds(items, min_tokens, share, cover)
        for b in batches:
            found = overlaps(b, "__text", s, share)
            cols = list(zip(*found)) if found else [[]] * 7
            take = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in names], *[pa.array(c, pa.int64()) for c in cols[1:]]],
                                             [*names, "item_id", "item_tokens", "matches", "span_tokens", "byte_start", "byte_end"])
    return run


def _without(items: list[tuple[int, str]], min_tokens: int, share: float, cover: float, text_col: str):
    def run(batches):
        s = Seeds(items, min_tokens, share, cover)
        for b in batches:
            plain = pa.RecordBatch.from_arrays([pa.compute.fill_null(b.column(text_col).cast(pa.string()), "")], ["t"])
            keep = np.ones(b.num_rows, bool)
            keep[[x[0] for x in overlaps(plain, "t", s, share)]] = False
            yield b.filter(pa.array(keep))
    return run


#: Bytes of item texts sent to the tasks at once.
BLOCK_BYTES = 16 << 20


def item_blocks(benchmark: DataFrame, item_col: str, item_text: str, block_items: int):
    """The distinct items (id, text) in blocks of at most ``block_items`` items
    and about ``BLOCK_BYTES`` of text (a longer item is a block of its own), at
    least one block (perhaps empty)."""
    items = (benchmark.select(F.col(item_col).cast("long").alias("i"), text_of(benchmark, item_text).alias("t")).filter("i is not null and t <> ''")
             .distinct().orderBy("i", "t"))
    after, sent = items, False
    while True:
        # how many of the next items fit is known before any text is fetched
        sizes = [r[0] for r in after.select(F.octet_length("t")).limit(block_items).collect()]
        fit = max(1, int(np.searchsorted(np.cumsum(sizes), BLOCK_BYTES, side="right"))) if sizes else 0
        part = after.limit(fit).collect() if fit else []
        if part or not sent:
            yield [tuple(r) for r in part]
        sent = True
        if len(part) == len(sizes) < block_items:
            return
        i, t = part[-1]
        after = items.filter((F.col("i") > i) | (F.col("i") == i) & (F.col("t") > t))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                       min_tokens: int = 13, share: float = 0.8, cover: float = 0.8, block_items: int = 50_000) -> DataFrame:
    """One row per document row and benchmark item that overlap: doc_id,
    item_id, item_tokens, matches, span_tokens, byte_start, byte_end, similarity.

    An overlap is an aligned run in which at least ``share`` of the tokens
    agree, with ``min_tokens`` agreeing tokens, or for shorter items ``cover``
    of the item; an item of fewer than ``SHORT`` tokens overlaps a line that has
    its tokens and no others (its rows show item_tokens). The best run of each pair is given (ties: the earliest),
    its place as UTF-8 bytes of the text. Null and empty texts and items
    overlap nothing; items with equal text are separate items, an item whose id
    is null is left out; rows that repeat an id are separate rows. Very long
    texts are searched whole, alignments some at a time. Results of all blocks
    of items are united. Empty tables give no rows; further columns, whatever
    their names, play no part.
    """
    cols = {"doc_id": F.col(id_col)}
    base = docs.select(*[c.alias(k) for k, c in cols.items()], text_of(docs, text_col).alias("__text"))
    extra = [StructField(n, LongType()) for n in ("item_id", "item_tokens", "matches", "span_tokens", "byte_start", "byte_end")]
    shape = StructType([*base.drop("__text").schema.fields, *extra])
    parts = [base.mapInArrow(lean(_search(b, min_tokens, share, cover, list(cols))), shape) for b in item_blocks(benchmark, item_col, item_text, block_items)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("similarity", F.col("matches") / F.col("span_tokens"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                    min_tokens: int = 13, share: float = 0.8, cover: float = 0.8, block_items: int = 50_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose text overlaps no benchmark item
    (as ``find_contamination`` has it). Every row is judged by its own text;
    null and empty texts stay, repeated rows all go or all stay. One pass over
    the rows for each block of items, without a shuffle."""
    out = docs
    for block in item_blocks(benchmark, item_col, item_text, block_items):
        out = out.mapInArrow(lean(_without(block, min_tokens, share, cover, text_col)), docs.schema)
    return out
