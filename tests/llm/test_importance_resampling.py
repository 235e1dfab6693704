import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from basketry.llm import importance_resampling as I

LOWER = {i: i + 32 for i in range(65, 91)}


def features(text, longest=3):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, percent=5, min_words=20, seed=42, buckets=10_000):
    """rows: (id, text); in the order (id, features, weight, score, rank, words)."""
    d = [(i, *features(t)) for i, t in rows]
    bucket = {f: zlib.crc32(f.encode()) % buckets for _, _, fs in d for f in fs}
    s = Counter(bucket[f] for _, _, fs in d for f in fs)
    t = Counter(zlib.crc32(f.encode()) % buckets for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, fs in d:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket[f]] for f in fs)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[5]))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r) for r in out]


def key(r):
    return tuple((v is not None, v or 0) for v in r)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


@pytest.mark.parametrize("percent,min_words,buckets", [(5, 20, 10_000), (50, 0, 97), (100, 1, 10_000)])
def test_matches_brute_force(docs, benchmark, percent, min_words, buckets):
    rows, target = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in benchmark.collect()]
    got = I.resample(docs, benchmark, percent=percent, min_words=min_words, buckets=buckets).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, target, percent, min_words, buckets=buckets), key=key)


def test_odd_rows_and_pieces(odd, empty, benchmark, monkeypatch):
    rows, target = [(r.doc_id, r.text) for r in odd.collect()], [r.text for r in benchmark.collect()]
    want = sorted(brute(rows, target, 50, 1), key=key)
    assert sorted(map(tuple, I.resample(odd, benchmark, percent=50, min_words=1).collect()), key=key) == want
    assert I.resample(empty, benchmark).collect() == []
    none = I.resample(odd, empty, percent=50, min_words=1).collect()  # an empty target
    assert sorted(map(tuple, none), key=key) == sorted(brute(rows, [], 50, 1), key=key)


def test_long_texts_in_pieces_give_the_same_features():
    import pyarrow as pa
    text = " ".join(f"w{i % 37}x" if i % 5 else "ÄÖ日" for i in range(400)) + " ---- end"
    old, I.PIECE = I.PIECE, 64
    try:
        got = Counter()
        for _, words, row, carried in I._runs(pa.array(["a b c", text, "", "d"])):
            for crc, index, at in I._features(words, row, carried, 3):
                got.update(crc[index].tolist())
    finally:
        I.PIECE = old
    assert got == Counter(zlib.crc32(f.encode()) for t in ("a b c", text, "", "d") for f in features(t)[1])


def test_crc_of_joined_strings():
    pairs = [(b"", b"a"), (b"abc", b""), (b"x" * 300, "日本語".encode() * 100), (b"one two", b"three")]
    first, second = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    got = I.joined_crc(first, second, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b" " + b) for a, b in pairs]
