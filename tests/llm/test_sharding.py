import hashlib
import zlib
from collections import Counter, defaultdict

from basketry.llm import sharding as S


def brute(rows, shards):
    """rows: (id, text, source)."""
    by = defaultdict(list)
    for i, t, s in rows:
        b = (t or "").encode()
        key = hashlib.md5(f"0:{'' if i is None else i}:{zlib.crc32(b)}".encode()).hexdigest()
        by["" if s is None else "=" + s].append((key, (i is not None, i or 0), len(b) + 8, zlib.crc32(b), i))
    order = []
    for s, v in by.items():
        for r, x in enumerate(sorted(v)):
            order.append(((2 * r + 1) / (2 * len(v)), s, r, x))
    order.sort(key=lambda x: x[:3])
    n, first, out = len(order), {}, []
    for p, (_, _, _, x) in enumerate(order):
        g = p * shards // n
        first.setdefault(g, p)
        out.append((x[4], x[2], x[3], "rows", g, p - first[g], None))
    return out


def key(x):
    return tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in x)


def test_matches_brute_force(docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for shards, buckets in ((24, None), (24, 1024), (7, 3), (1, 1)):
        got = [tuple(r) for r in S.shard_documents(docs, shards, buckets=buckets).collect()]
        assert sorted(got, key=key) == sorted(brute(rows, shards), key=key)


def test_every_shard_has_the_mixture(docs):
    rows = S.shard_documents(docs, 4).join(docs.select("doc_id", "source"), "doc_id").collect()
    total = Counter(r.source for r in rows)
    for s in range(4):
        mine = Counter(r.source for r in rows if r.shard == s)
        assert all(abs(mine[k] - n / 4) <= 1 for k, n in total.items())


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    got = [tuple(r) for r in S.shard_documents(odd).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 24), key=key)
    assert S.shard_documents(empty).collect() == []


def test_rows_that_share_an_id_spread(spark):
    """A third of all rows without an id: no window group holds them all."""
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, f"text {i}", "a") for i in range(3000)], "doc_id long, text string, source string")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = [tuple(r) for r in S.shard_documents(docs, 24, buckets=30).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 24), key=key)
    hashes = [hashlib.md5(f"0::{zlib.crc32(t.encode())}".encode()).hexdigest() for i, t, _ in rows if i is None]
    assert max(Counter(int(h[:8], 16) * 30 >> 32 for h in hashes).values()) < 100
