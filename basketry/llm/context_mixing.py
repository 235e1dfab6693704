"""Language-model scoring by online logistic context mixing.

A text is coded as its UTF-8 bytes and an end. Each byte is a few binary
decisions along a prefix code fitted to the byte before it (about three a byte
where plain bits would be eight). Several hashed contexts predict every
decision: the byte before, the three and the five bytes before, the word so
far, and that word with the one before it. A context's predictor is the log
odds of what followed it in the training documents, so what is gathered from
the corpus is one count per (hashed context, byte) and grows with it. The log
odds are combined by weights that a gate selects (which of the long contexts
were ever seen) and that are refined after every decision by the gradient of
the coding cost; each ``LANE`` decisions of a text start from the same weights, so a
text's score depends on the text and on the counts alone.

As Spark jobs: texts are packed into blocks of bounded size and written once. A
block asks for its distinct (context, byte) pairs, dealt by hash into buckets;
a bucket adds up the counts of all blocks and answers every block in the order
it asked; a block's texts and answers meet again by block and are scored, a few
thousand lanes in step. Nothing grows on the driver but two totals and a
257 x 257 table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from basketry.llm.common import _BYTE_LOWER, _IS_SEP, materialize, mix, powers, text_of, text_slices

END = START = 256
#: Text bytes of a block and of a piece of a long text.
BLOCK, PIECE = 1 << 22, 1 << 21
#: Decisions between two starts of the weights.
LANE = 4096
#: Hashed contexts looked up beside the byte before.
CONTEXTS = ("bytes", "word")
#: Bytes before that the first of them covers; positions worked through at once.
REACH, CACHED = 4, 1 << 17
#: Added to both counts of a decision; steps a log odd is rounded to; first weight of each predictor; learning rate.
PRIOR, STEPS, FIRST, RATE = 0.05, 16.0, 0.4, 0.001
#: Weight sets (one for each subset of the hashed contexts that were seen); bound of the mixed log odds.
GATES, LIMIT = 4, np.float32(12)
#: Decisions of each lane fetched at once; where an event holds the hashed contexts' log odds.
AHEAD = 16
_SECOND, _THIRD = np.array([[0, -1, 0, 0], [0, 0, -1, 0]], np.int8).view(np.uint32).ravel()

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# ------------------------------------------------------------------ the prefix code
class Code:
    """For every byte before (256: none) a prefix code of the 257 symbols:
    ``start`` and ``size`` of a pair's path in the flat ``node`` and ``bit``
    arrays, ``sign`` (+1 for a set bit) and ``odds``, the log odds of each path's
    decisions under that byte alone."""

    def __init__(self, counts: np.ndarray):
        starts, sizes, nodes, bits, odds = [], [], [], [], []
        at, shared = 0, None
        for prev in range(257):
            n = counts[prev]
            seen = bool(n.any())
            if not seen and shared is not None:  # one code for all bytes never seen
                starts.append(shared[0])
                sizes.append(shared[1])
                continue
            path = _huffman(n * 64 + 1)
            size = np.array([len(p) for p in path])
            node = np.array([x for p in path for x, _ in p], np.int64)
            bit = np.array([b for p in path for _, b in p], np.uint8)
            weight = np.repeat(n, size).astype(np.float64)
            ones = np.bincount(node, weight * bit, 256)
            zeros = np.bincount(node, weight * (1 - bit), 256)
            first = at + np.concatenate(([0], np.cumsum(size)[:-1]))
            starts.append(first)
            sizes.append(size)
            nodes.append(node)
            bits.append(bit)
            odds.append(log_odds(ones, zeros)[node])
            at += len(node)
            if not seen:
                shared = (first, size)
        self.start, self.size = np.array(starts, np.int32), np.array(sizes, np.uint8)
        self.node, self.bit = np.concatenate(nodes).astype(np.uint8), np.concatenate(bits)
        self.sign = self.bit.astype(np.int8) * 2 - 1
        self.odds = np.concatenate(odds) * self.sign


def _huffman(weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """(inner node, bit) along the way to each symbol; nodes are numbered from
    the root, ties broken by age."""
    heap = [(int(w), i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    n, up = len(heap), {}
    k = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[2]], up[b[2]] = (k, 0), (k, 1)
        heapq.heappush(heap, (a[0] + b[0], k, k))
        k += 1
    paths = []
    for s in range(n):
        path, x = [], s
        while x in up:
            x, bit = up[x]
            path.append((2 * n - 2 - x, bit))
        paths.append(path[::-1])
    return paths


def log_odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Log odds in steps, as 8-bit integers; 0 where nothing was seen."""
    return np.clip(np.rint(np.log((ones + PRIOR) / (zeros + PRIOR)) * STEPS), -127, 127).astype(np.int8)


# ------------------------------------------------------------------ a block's symbols and contexts
def symbols(data: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces with an end behind each last one, and where each
    piece begins (with the total at the end)."""
    edge = np.concatenate(([0], np.cumsum(sizes)))
    ends = edge[1:][last]
    return np.insert(data.astype(np.uint16), ends, END), np.concatenate(([0], np.cumsum(sizes + last)))


def contexts(sym: np.ndarray, edge: np.ndarray):
    """(the byte before, {context: 64-bit pair keys}, positions that end a word,
    hashes of those words) of all positions. A key is 46 bits of the context's
    hash, the byte before and the symbol; contexts never reach beyond the piece.
    Worked through in runs of pieces that fit a processor's cache."""
    n, runs, lo = len(sym), [], 0
    prev = np.empty(n, np.uint16)
    keys = {name: np.empty(n, np.uint64) for name in CONTEXTS}
    while lo < len(edge) - 1:
        hi = min(len(edge) - 1, max(lo + 1, int(np.searchsorted(edge, edge[lo] + CACHED, side="right")) - 1))
        a, b = int(edge[lo]), int(edge[hi])
        stop, words = _run_contexts(sym[a:b], edge[lo:hi + 1] - a, prev[a:b], {name: k[a:b] for name, k in keys.items()})
        runs.append((stop + a, words))
        lo = hi
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    stops, words = zip(*runs) if runs else ([none[0]], [none[1]])
    return prev, keys, np.concatenate(stops), np.concatenate(words)


def _run_contexts(sym: np.ndarray, edge: np.ndarray, prev: np.ndarray, keys: dict) -> tuple[np.ndarray, np.ndarray]:
    n = len(sym)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    heads, room = edge[:-1][np.diff(edge) > 0], np.diff(edge)[np.diff(edge) > 0]
    prev[0] = START
    prev[1:] = sym[:-1]
    prev[heads] = START
    low = (prev.astype(np.uint64) << np.uint64(9)) | sym
    with np.errstate(over="ignore"):
        wide, h, c = sym.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64), np.uint64(1)
        for j in range(1, REACH + 1):
            c = c * _M1 + np.uint64(2)
            h[j:] += (wide * c)[:max(n - j, 0)]
            for r in range(j):  # positions with fewer than j bytes before them in the piece
                p = (heads + r)[room > r]
                p = p[p >= j]
                h[p] -= wide[p - j] * c
        byte = np.minimum(sym, 255).astype(np.uint8)
        end = sym == END
        sep = _IS_SEP[byte] | end
        fresh = np.empty(n, bool)
        fresh[1:] = sep[:-1]
        fresh[heads] = True
        at = np.arange(n, dtype=np.int32)
        begin = np.maximum.accumulate(np.where(fresh, at, np.int32(0)))  # where the word so far begins
        up, down = powers(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_LOWER[byte] * up[:-1], out=run[1:])
        word = (run[:-1] - run[begin]) * down[begin]
        top = ~np.uint64((1 << 18) - 1)
        for i, (name, hashed) in enumerate(zip(CONTEXTS, (h, word))):
            key = hashed * _M1 + np.uint64(i + 1)
            key ^= key >> np.uint64(29)
            key *= _M2
            key ^= key >> np.uint64(32)
            key *= _M1
            key &= top
            np.bitwise_or(key, low, out=keys[name])
        stop = np.flatnonzero(sep & ~fresh)
        return stop, mix(word[stop] + (stop - begin[stop]).astype(np.uint64))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, index of every position)."""
    index, key = pd.factorize(keys)
    by = np.argsort(key)
    rank = np.empty(len(by), np.int32)
    rank[by] = np.arange(len(by), dtype=np.int32)
    return key[by], rank[index]


def counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, how many positions of each are learnt from)."""
    def runs(x):
        return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    every, some = np.sort(keys), np.sort(keys[learn])
    key, first = every[runs(every)], runs(some)
    total = np.zeros(len(key), np.int64)
    total[np.searchsorted(key, some[first])] = np.diff(np.append(first, len(some)))
    return key, total


# ------------------------------------------------------------------ compact arrays
def pressed(a: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(a).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpressed(b: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if n == 0:
        return np.zeros(0, dtype)
    raw = pa.decompress(b[8:], n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(dtype).ravel()


# ------------------------------------------------------------------ a bucket's answers
def answers(keys: np.ndarray, counts: np.ndarray, code: Code):
    """From all blocks' (sorted) keys and counts: (distinct keys, start of each
    one's log odds, log odds along every path)."""
    order = np.argsort(keys, kind="stable")
    key = keys[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
    key = key[first]
    prev, sym = ((key >> np.uint64(9)) & np.uint64(511)).astype(np.int64), (key & np.uint64(511)).astype(np.int64)
    size = code.size[prev, sym].astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(size)))
    where = np.repeat(code.start[prev, sym] - starts[:-1], size) + np.arange(starts[-1])
    context = np.cumsum(np.concatenate(([0], (key[1:] >> np.uint64(9)) != (key[:-1] >> np.uint64(9)))) if len(key) else np.zeros(0, np.int64))
    node = (np.repeat(context, size) << 8) | code.node[where]
    by = np.argsort(node, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], node[by][1:] != node[by][:-1]))) if len(by) else np.zeros(0, np.int64)
    n, bit = np.repeat(total, size)[by], code.bit[where][by]
    if len(edge):
        ones, both = np.add.reduceat(n * bit, edge), np.add.reduceat(n, edge)
    else:
        ones = both = np.zeros(0, np.int64)
    odds = np.empty(len(node), np.int8)
    odds[by] = np.repeat(log_odds(ones, both - ones), np.diff(np.concatenate((edge, [len(by)]))))
    return key, starts, odds * code.sign[where]


def picked(starts: np.ndarray, values: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of a ragged array, one after the other."""
    size = starts[which + 1] - starts[which]
    out = np.concatenate(([0], np.cumsum(size)))
    return values[np.repeat(starts[which] - out[:-1], size) + np.arange(out[-1])]


# ------------------------------------------------------------------ mixing
def mixed(events: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Natural log of the probability each lane's decisions get.

    An event is four 8-bit inputs in one 32-bit word: the log odds of what came
    by each predictor, and a constant; its gate says which of the hashed
    contexts' log odds are not 0. ``lane`` is where each lane begins, with the
    total at the end. All lanes go one decision at a time, the longest first.
    """
    size = np.diff(lane)
    order = np.argsort(-size, kind="stable")
    begin, size = lane[:-1][order], size[order]
    alive = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), side="right")
    weights = np.tile(np.array([FIRST, FIRST, FIRST, 0], np.float32) / np.float32(STEPS), (len(size) * GATES, 1)).view(np.complex128).ravel()  # four floats moved as one
    slot, total, rate = np.arange(len(size)) * GATES, np.zeros(len(size)), np.float32(RATE / STEPS)
    paid = np.ones((AHEAD, len(size)), np.float32)
    for t, a in enumerate(alive):
        if t % AHEAD == 0:  # the next events of all lanes, by decision
            at = begin[:a, None] + np.arange(t, t + AHEAD)
            words = np.ascontiguousarray(events.take(at, mode="clip").T)
            seen = ((words & _SECOND) != 0).view(np.int8) | ((words & _THIRD) != 0).view(np.int8) << 1
        cell = slot[:a] + seen[t % AHEAD, :a]
        row = words[t % AHEAD, :a].view(np.int8).reshape(a, 4).astype(np.float32)
        weight = weights.take(cell, mode="wrap").view(np.float32).reshape(a, 4)
        part = row * weight
        odds = part[:, 0] + part[:, 1]
        odds += part[:, 2]
        odds += part[:, 3]
        np.maximum(odds, -LIMIT, out=odds)
        np.minimum(odds, LIMIT, out=odds)
        wrong = np.exp(np.negative(odds, out=odds), out=odds)
        inverse = wrong + np.float32(1)  # 1 / probability of what came
        wrong /= inverse
        wrong *= rate
        paid[t % AHEAD, :a] = inverse
        if t % AHEAD == AHEAD - 1 or t == len(alive) - 1:  # the cost of what was fetched together
            b = alive[t - t % AHEAD]
            total[:b] -= np.log(paid[:, :b]).sum(axis=0, dtype=np.float64)
            paid[:, :b] = 1
        row *= wrong.repeat(4).reshape(a, 4)
        weight += row
        weights[cell] = weight.view(np.complex128).ravel()
    out = np.zeros(len(size))
    out[order] = total
    return out


def block_scores(sym: np.ndarray, edge: np.ndarray, code: Code, prev: np.ndarray, look: dict, replies: dict) -> np.ndarray:
    """Natural log probability of every piece. ``look`` says where in the
    replies the path of each position's pair begins."""
    pair = prev * np.int32(code.size.shape[1]) + sym
    size, base = code.size.ravel().take(pair), code.start.ravel().take(pair)
    at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    events = np.empty((int(at[-1]), 4), np.int8)
    for a in range(0, len(sym), CACHED):
        b = min(len(sym), a + CACHED)
        lo, hi, rep = int(at[a]), int(at[b]), size[a:b].astype(np.intp)
        first, span = (at[a:b] - lo).astype(np.int32), np.arange(hi - lo, dtype=np.int32)
        path = np.repeat(base[a:b] - first, rep)
        path += span
        events[lo:hi, 0] = code.odds.take(path)
        events[lo:hi, 3] = code.sign.take(path) * np.int8(STEPS)
        for i, name in enumerate(CONTEXTS):
            where = np.repeat(look[name][a:b] - first, rep)
            where += span
            events[lo:hi, i + 1] = replies[name].take(where)
    head = lanes(at, edge)
    cost = mixed(events.view(np.uint32).ravel(), np.append(at[head], at[-1]))
    return np.bincount(np.searchsorted(edge, head, side="right") - 1, cost, len(edge) - 1)


def lanes(at: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Positions at which a lane begins: the first of each piece, and within a
    piece the first behind each ``LANE`` decisions. ``at``: decisions before
    each position."""
    piece = np.repeat(at[edge[:-1]], np.diff(edge))
    number = (at[:-1] - piece) // LANE
    new = np.ones(len(number), bool)
    new[1:] = number[1:] != number[:-1]
    new[edge[:-1][np.diff(edge) > 0]] = True
    return np.flatnonzero(new)


def looked_up(keys: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, where each position's path begins in their answers)."""
    index, key = pd.factorize(keys)
    by = np.argsort(key)
    key = key[by]
    length = code.size[((key >> np.uint64(9)) & np.uint64(511)).astype(np.int64), (key & np.uint64(511)).astype(np.int64)]
    start = np.empty(len(key), np.int32)
    start[by] = np.cumsum(length, dtype=np.int64) - length
    return key, start[index]


# ------------------------------------------------------------------ Spark jobs
def _cut(data: np.ndarray, offsets: np.ndarray):
    """(row, from, to, last) of the pieces of a run of texts: a text longer than
    ``PIECE`` is cut behind the next separator, so no word is parted."""
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        while b - a > PIECE:
            to = a + PIECE
            while to < b:
                hit = np.flatnonzero(_IS_SEP[data[to:min(b, to + CACHED)]])
                if len(hit):
                    to += int(hit[0]) + 1
                    break
                to = min(b, to + CACHED)
            if to >= b:
                break
            yield row, a, to, False
            a = to
        yield row, a, b, True


_PACKED = "block long, row array<long>, id array<{id}>, held array<boolean>, size array<int>, last array<boolean>, payload binary, pair array<int>, n array<long>"


def _pack(rows: DataFrame) -> DataFrame:
    """Blocks of about ``BLOCK`` text bytes, with the counts of (byte before,
    symbol) in their training texts."""
    id_kind = pa.list_(to_arrow_type(rows.schema["id"].dataType))

    def run(batches):
        task, made, count = TaskContext.get().partitionId() << 40, 0, 0
        row, name, held, size, last, parts, room = [], [], [], [], [], [], 0
        kind = pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32())

        def block():
            data, sizes, ends = np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.array(size, np.int64), np.array(last, bool)
            sym, edge = symbols(data, sizes, ends)
            prev = np.full(len(sym), START, np.int64)
            prev[1:] = sym[:-1]
            prev[edge[:-1][np.diff(edge) > 0]] = START
            learn = np.repeat(~np.array(held, bool), np.diff(edge))
            counts = np.bincount((prev * 257 + sym)[learn], minlength=257 * 257)
            hit = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([
                pa.array([task + made], pa.int64()), pa.array([row], kind[0]), pa.array([name], id_kind), pa.array([held], kind[1]), pa.array([size], kind[2]), pa.array([last], kind[1]),
                pa.array([pressed(data)], pa.binary()), pa.array([hit], kind[2]), pa.array([counts[hit]], kind[0])], ["block", "row", "id", "held", "size", "last", "payload", "pair", "n"])

        for batch in batches:
            ids, out = batch.column("id").to_pylist(), batch.column("held").to_pylist()
            for first, _, data, offsets in text_slices(batch, "text"):
                for r, a, b, end in _cut(data, offsets):
                    row.append(task + count + first + r)
                    name.append(ids[first + r])
                    held.append(out[first + r])
                    size.append(b - a)
                    last.append(end)
                    parts.append(data[a:b].copy())
                    room += b - a + 64
                    if room >= BLOCK:
                        yield block()
                        made, room = made + 1, 0
                        row, name, held, size, last, parts = [], [], [], [], [], []
            count += batch.num_rows
        if row:
            yield block()

    return rows.mapInArrow(run, _PACKED.format(id=rows.schema["id"].dataType.simpleString()))


def _opened(sizes, held, last, payload):
    """(symbols, edges, learn) of one block."""
    sym, edge = symbols(unpressed(payload, np.uint8), np.array(sizes, np.int64), np.array(last, bool))
    return sym, edge, np.repeat(~np.array(held, bool), np.diff(edge))


def _deal(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in sorted keys (by their top 16 + 16 bits)."""
    edges = (np.arange(1, buckets, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets) << np.uint64(32)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _ask(packed: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, block, keys, counts): the distinct pairs (and words, kind
    -1) of each block, sorted, with their training counts."""

    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                sym, edge, learn = _opened(b["size"], b["held"], b["last"], b["payload"])
                _, keys, stop, words = contexts(sym, edge)
                ends = edge[1:][np.array(b["last"], bool)] - 1
                asked = [(i, keys.pop(name), learn) for i, name in enumerate(CONTEXTS)]
                asked.append((-1, np.concatenate((words, np.full(len(ends), ENDED))), np.concatenate((learn[stop], learn[ends]))))
                for kind, k, weight in asked:
                    key, total = counted(k, weight)
                    edges = _deal(key, buckets)
                    used = np.flatnonzero(np.diff(edges))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([kind] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array([b["block"]] * len(used), pa.int64()),
                        pa.array([pressed(np.diff(key[edges[u]:edges[u + 1]], prepend=np.uint64(0))) for u in used], pa.binary()),
                        pa.array([pressed(total[edges[u]:edges[u + 1]]) for u in used], pa.binary())], ["kind", "bucket", "block", "keys", "counts"])

    return packed.select("block", "held", "size", "last", "payload").mapInArrow(run, "kind int, bucket int, block long, keys binary, counts binary")


#: The word hash that stands for the end token.
ENDED = np.uint64(0x5851F42D4C957F2D)
_ANSWER = "kind int, bucket int, block long, answer binary, tokens long, vocabulary long"


def _answer(asked: DataFrame, code: Code) -> DataFrame:
    """Every block's answers from one bucket, in the order it asked: log odds
    along the paths of its pairs, or the counts of its words (whose totals stand
    in one more row without a block)."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("block")
        kind, blocks = t["kind"][0].as_py(), t["block"].to_pylist()
        with np.errstate(over="ignore"):
            keys = [np.cumsum(unpressed(k, np.uint64), dtype=np.uint64) for k in t["keys"].to_pylist()]
        every, counts = np.concatenate(keys), np.concatenate([unpressed(c, np.int64) for c in t["counts"].to_pylist()])
        facts = []
        if kind < 0:
            key = np.unique(every)
            at = np.searchsorted(key, every)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, counts)
            out = [pressed(total[np.searchsorted(key, k)]) for k in keys]
            facts = [(None, None, int(total.sum()), int((total > 0).sum()))]
        else:
            key, starts, odds = answers(every, counts, code)
            out = [pressed(picked(starts, odds, np.searchsorted(key, k))) for k in keys]
        rows = [(b, o, None, None) for b, o in zip(blocks, out)] + facts
        n, bucket = len(rows), t["bucket"][0].as_py()
        return pa.table([pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), *[pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.int64()))]],
                        names=["kind", "bucket", "block", "answer", "tokens", "vocabulary"])

    return asked.groupBy("kind", "bucket").applyInArrow(run, _ANSWER)


_SCORED = "row long, id {id}, held boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"


def _scored(packed: DataFrame, answered: DataFrame, code: Code, tokens: int, vocabulary: int) -> DataFrame:
    """Sums of each piece, from its block and the block's answers."""

    id_type = packed.schema["id"].dataType.elementType
    names = ["row", "id", "held", "n_bytes", "n_tokens", "n_known", "base_score", "score"]
    kinds_out = [pa.int64(), to_arrow_type(id_type), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        replies = right.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds, blobs = replies["kind"].to_numpy(), replies["answer"]
        for b in left.to_pylist():
            sym, edge, _ = _opened(b["size"], b["held"], b["last"], b["payload"])
            prev, keys, stop, words = contexts(sym, edge)
            last = np.array(b["last"], bool)
            ends = edge[1:][last] - 1
            index = grouped(np.concatenate((words, np.full(len(ends), ENDED))))[1]
            said = {k: [blobs[int(i)].as_py() for i in np.flatnonzero(kinds == k)] for k in np.unique(kinds)}
            counts = np.concatenate([unpressed(x, np.int64) for x in said.get(-1, [])] or [np.zeros(0, np.int64)])[index]
            where = np.searchsorted(edge, np.concatenate((stop, ends)), side="right") - 1
            cost = np.log10((counts + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
            look = {name: looked_up(keys.pop(name), code)[1] for name in CONTEXTS}
            reply = {name: np.concatenate([unpressed(x, np.int8) for x in said.get(i, [])] or [np.zeros(0, np.int8)]) for i, name in enumerate(CONTEXTS)}
            n = len(last)
            score = block_scores(sym, edge, code, prev, look, reply) / np.log(10)
            columns = (b["row"], b["id"], b["held"], b["size"], np.bincount(where, minlength=n), np.bincount(where, counts > 0, n).astype(np.int64), np.bincount(where, cost, n), score)
            parts.append(pa.table([pa.array(c, t) for c, t in zip(columns, kinds_out)], names=names))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in kinds_out], names=names)

    return packed.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, _SCORED.format(id=id_type.simpleString()))


def score_texts(docs: DataFrame, folds: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes, bits_per_byte of every row.

    Rows whose crc32 of the id (as text) leaves ``held`` modulo ``folds`` are
    held out: scored, never learnt from. Tokens are the words of the text, A-Z
    lower-cased, and one end; ``base_score`` is their log10 probability by
    smoothed single counts. ``score`` is the log10 probability of the text's
    UTF-8 bytes and its end by the mixed model, ``bits_per_byte`` its cost over
    the bytes (null without any).

    A null text counts as empty: one token, the end. A null id counts as the
    empty string (never held out at 5 and 1). Repeated ids are separate rows;
    equal texts get equal scores. A text beyond ``PIECE`` bytes is cut behind a
    separator: its pieces' scores add up, its contexts start anew. Where nothing
    was learnt from, every byte is coded by the prior code. An empty table gives
    no rows. Further columns, whatever their names, play no part.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.crc32(key.cast("binary")) % folds == held).alias("held"), text_of(docs, text_col).alias("text"))
    packed = materialize(_pack(rows), "blocks")
    pairs = packed.select(F.explode(F.arrays_zip("pair", "n")).alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("n")).collect()  # 257 x 257 at most
    first = np.zeros(257 * 257, np.int64)
    for r in pairs:
        first[r["pair"]] = r["n"]
    code = Code(first.reshape(257, 257))
    blocks = packed.count()
    answered = materialize(_answer(_ask(packed, max(1, blocks // 2)), code), "answers")
    total = answered.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("vocabulary"), F.lit(0)).alias("v")).first()
    pieces = _scored(packed.drop("pair", "n"), answered.filter("block IS NOT NULL").select("block", "kind", "bucket", "answer"), code, int(total["n"]), int(total["v"]))
    out = pieces.groupBy("row").agg(F.first("id").alias("doc_id"), F.first("held").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_bytes", "n_tokens", "n_known", "base_score", "score")])
    bits = F.try_divide(F.col("score") * float(-1 / np.log10(2)), F.col("n_bytes"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total["n"])).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))
