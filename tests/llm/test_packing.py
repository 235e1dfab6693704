from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from basketry.llm import packing as P


def check(rows, sizes):
    bins = defaultdict(list)
    for r in rows:
        bins[r.block, r.bin].append(r)
    for v in bins.values():
        pos = 0
        for r in sorted(v, key=lambda r: (r.bin_offset, r.length)):
            assert r.bin_offset == pos
            pos += r.length
        assert {r.bin_size for r in v} == {min(s for s in sizes if s >= pos)}  # cut down to its contents
    return bins


def test_every_word_is_packed_once(docs, texts):
    rows = P.pack_words(docs, block_rows=64).collect()
    check(rows, P.SIZES)
    per = defaultdict(list)
    for r in rows:
        per[r.doc_id].append((r.piece, r.start, r.length))
    for i, t in texts.items():
        pos = 0
        for piece, start, length in sorted(per[i]):
            assert start == pos and length <= P.SIZES[-1]
            pos += length
        assert pos == len(t.replace("\x85", "x").split(None)) or pos == len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w])


def test_odd_rows(odd, empty):
    rows = P.pack_words(odd).collect()
    check(rows, P.SIZES)
    assert P.pack_words(empty).collect() == []
    assert sum(r.length == 0 for r in rows) == 4  # two nulls, one empty, one blank
    assert sorted(r.length for r in rows if r.doc_id == 5) == [40_000 % 4096] + [4096] * (40_000 // 4096)


def test_best_fit_beats_one_size():
    r = np.random.default_rng(3)
    lengths = np.sort(r.integers(1, 1200, 3000))[::-1].copy()
    where, offset, final = P.pack_block(lengths)
    held = np.bincount(where, weights=lengths)
    size = np.zeros(len(held), int)
    size[where] = final
    assert held.max() <= 4096 and (held <= size).all()
    assert held.sum() / size.sum() > 0.97
    total = sum(P.cost(s, 32, 8192) for s in size)
    for one in P.SIZES[2:]:
        w, _, f = P.pack_block(lengths, (one,))
        s = np.zeros(w.max() + 1, int)
        s[w] = f
        assert total <= sum(P.cost(x, 32, 8192) for x in s)


def test_sizes_are_chosen_by_cost():
    # nothing else to lay beside it: the smallest size that holds the piece
    for x, want in ((1, 512), (512, 512), (513, 1024), (4096, 4096)):
        assert P.pack_block(np.array([x]))[2].tolist() == [want]


def test_lengths_may_be_any_column(spark):
    df = spark.createDataFrame([(1, 5000), (2, None), (3, -4), (4, 0), (4, 100)], "doc_id long, tokens long")
    rows = P.pack(df, F.col("tokens"), sizes=(1000, 100)).collect()
    check(rows, (100, 1000))
    assert sorted((r.doc_id, r.length) for r in rows) == [(1, 1000)] * 5 + [(2, 0), (3, 0), (4, 0), (4, 100)]


def brute(lengths, sizes, bin_cost=32.0, attention=8192.0):
    """Best fit over plain lists: every open bin is looked at, and the size of a
    new one is tried out on all that is left."""
    rest, bins, out, choice, opened = list(lengths), [], [], {}, 0
    for x in lengths:
        rest.remove(x)
        fits = [(size - used, b) for b, (size, used) in enumerate(bins) if size - used >= max(x, 1)]  # a full bin is closed
        if fits:
            b = min(fits)[1]
        else:
            if (x, opened // 64) not in choice:
                tried = []
                for size in sorted(sizes):
                    if size >= x:
                        room, held = size - x, x
                        for y in sorted((y for y in rest if y > 0), reverse=True):
                            if y <= room:
                                room, held = room - y, held + y
                        cut = min([s for s in sizes if s >= held], default=size)
                        s = min(size, cut)
                        tried.append(((bin_cost + s + s * s / attention) / max(held, 1), size))
                choice[x, opened // 64] = min(tried)[1]
            bins.append([choice[x, opened // 64], 0])
            opened += 1
            b = len(bins) - 1
        out.append((b, bins[b][1]))
        bins[b][1] += x
    return [(b, o, min(s for s in sizes if s >= bins[b][1])) for b, o in out]


def test_blocks_equal_brute_force():
    r = np.random.default_rng(4)
    for sizes, n, top in (((512, 1024, 2048, 4096), 300, 4096), ((512, 1024, 2048, 4096), 400, 700), ((10, 25, 40), 250, 40), ((7,), 60, 7), ((3, 100), 200, 9)):
        for low in (0, 1):
            lengths = np.sort(r.integers(low, top + 1, n))[::-1].copy()
            got = list(zip(*[x.tolist() for x in P.pack_block(lengths, sizes)]))
            assert got == brute(lengths.tolist(), sizes)


def test_pieces_by_tokens_have_their_bytes(spark, docs, texts, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    from basketry.session import scratch_path
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, cache = Tokenizer.from_file(path), scratch_path(spark, "cache")
    rows = P.pack_tokens(docs, path, cache, sizes=(64, 128)).collect()
    check(rows, (64, 128))
    per = defaultdict(list)
    for x in rows:
        per[x.doc_id].append(x)
    for i, t in texts.items():
        mine, b = sorted(per[i], key=lambda x: x.piece), t.encode()
        assert sum(x.length for x in mine) == len(lib.encode(t, add_special_tokens=False).ids)
        assert b"".join(b[x.byte_start:x.byte_end] for x in mine) == b
        assert all(x.length == 128 for x in mine[:-1])
    rows = P.pack_tokens(odd, path, cache).collect()
    check(rows, P.SIZES)
    assert len({(x.doc_id, x.piece, x.byte_start) for x in rows}) <= len(rows) and sum(x.length == 0 for x in rows) == 3
    assert P.pack_tokens(empty, path, cache).collect() == []


def test_cuts_of_every_tokenizer_kind():
    import public_tokenizers
    from basketry.llm.token_counts import Counter
    text = "Über die Brücke <|endoftext|> went 12 sheep, then \U0001F600 more. " * 5
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        c = Counter(public_tokenizers.path(name))
        cuts = c.cuts(text, 16)
        assert len(cuts) == (c.count(text) - 1) // 16 and cuts == sorted(cuts) and cuts[-1] < len(text.encode())
    fast, slow = (Counter(public_tokenizers.path("byte_bpe_50k.json"), f) for f in (True, False))
    plain = "one two three, four five six. " * 20
    lead = [plain.encode()[b:b + 1] for b in fast.cuts(plain, 7)]
    assert [b + (x == b" ") for b, x in zip(fast.cuts(plain, 7), lead)] == [b + (plain.encode()[b:b + 1] == b" ") for b in slow.cuts(plain, 7)]
