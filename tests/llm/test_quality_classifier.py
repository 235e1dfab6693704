import zlib

import numpy as np
from pyspark.sql import functions as F

from basketry.llm import quality_classifier as C


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r.doc_id: r for r in C.score_quality(docs, labels).collect()}
    assert len(rows) == docs.count()
    truth = [(r.quality, rows[r.doc_id]) for r in labels.collect()]
    assert all(x.held_out == held_out(x.doc_id) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for _, x in truth)
    test = [(y, x) for y, x in truth if x.held_out]
    assert np.mean([y == x.predicted for y, x in test]) > 0.95
    good, bad = [x.score for y, x in test if y == 1], [x.score for y, x in test if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_held_out_labels_are_not_learnt(spark, docs, labels):
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in C.score_quality(docs, labels).collect()}
    b = {r.doc_id: r.score for r in C.score_quality(docs, flipped).collect()}
    assert a == b


def test_pairwise_loss_recovers_the_order():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3))
    latent = x @ np.array([2.0, -1.0, 0.0])
    y = (latent > 0.3).astype(int)
    w = C.bradley_terry(x[y == 1], x[y == 0])
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * abs(w[1])
    s = x @ w
    assert C.quantile_cut(s, y) > s[y == 0].max() - 0.5
    assert C.quantile_cut(np.array([1.0, 1.0, 2.0]), np.array([0, 0, 1])) == 1.5


def test_odd_rows_and_missing_classes(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (9, 0), (9, 1), (None, 0), (5, None), (77, 1)], "doc_id long, quality int")
    rows = C.score_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in C.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert C.score_quality(empty, labels).collect() == []


def test_features_do_not_cross_rows():
    texts = ["a b a b", "", "a b", "ÄÖ !! ||", "x\nx\nx"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    all_at_once = C.slice_features(np.frombuffer(data, np.uint8), offsets)
    for i, t in enumerate(texts):
        one = C.slice_features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert np.allclose(all_at_once[i], one[0])


def plain_features(text):
    """The 18 measures in plain Python, from the text's bytes and words."""
    import re
    b = text.encode()
    if not b:
        return [0.0] * 18
    upper = len(re.findall(rb"[A-Z]|\xc3(?=[\x80-\x9e])", b))
    letters = max(1, len(re.findall(rb"[A-Za-z\xc0-\xff]", b)))
    chars = max(1, sum(not 128 <= x < 192 for x in b))
    share = lambda chars_of: (sum(x in chars_of for x in b) / chars) ** 0.5
    other = sum(x < 128 and not (65 <= x <= 90 or 97 <= x <= 122 or 48 <= x <= 57 or x in b"!|#*$%&<>.,;:?'\"()-\n \t\x0b\x0c\r") for x in b)
    words = re.split(rb"[\x20\x09-\x0d]+", b)
    words = [w for w in words if w]
    w1 = max(1, len(words))
    low = [w.lower() for w in words]

    def repeats(items):
        return (len(items) - len(set(items))) / max(1, len(items))

    def up(w):
        return len(re.findall(rb"[A-Z]|\xc3(?=[\x80-\x9e])", w))
    lines = [x for x in b.split(b"\n") if x]
    grams = lambda k: [tuple(low[i:i + k]) for i in range(len(low) - k + 1)]
    return [np.log1p(len(words)), np.log1p(sum(map(len, words)) / w1), (upper / letters) ** 0.5, share(b"0123456789"), share(b"!"), share(b"|"), share(b"#*$%&<>"),
            share(b".,;:?'\"()-"), (other / chars) ** 0.5, share(b"\n"), (sum(len(w) > 25 for w in words) / w1) ** 0.5, repeats(low), repeats(grams(2)), repeats(grams(3)),
            (sum(x == y for x, y in zip(low, low[1:])) / w1) ** 0.5, repeats([x.lower() for x in lines]), sum(up(w) * 2 > len(w) > 1 for w in words) / w1,
            sum(any(x in b"!|#*$%&<>" for x in w) for w in words) / w1]


def test_features_equal_plain_python(texts):
    sample = [*list(texts.values())[:80], "", " ", "A b A b A b\nA b", "!!! ||| ### x1 22 ÄÖÜ äöü", "x" * 30 + "\n" + "x" * 30]
    data = "".join(sample).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in sample])
    got = C.slice_features(np.frombuffer(data, np.uint8), offsets)
    for row, t in zip(got, sample):
        assert np.allclose(row, plain_features(t)), (t[:60], dict(zip(C.FEATURES, zip(row, plain_features(t)))))


def test_newton_equals_plain_gradient_descent():
    r = np.random.default_rng(5)
    good, bad = r.normal(0.5, 1, (60, 4)), r.normal(-0.2, 1, (45, 4))
    rng = np.random.default_rng(7)  # the pairs that are drawn
    n = 60 * 8
    d = good[rng.permutation(n) % 60] - bad[rng.permutation(n) % 45]
    w = np.zeros(4)
    for _ in range(20_000):
        w -= 0.5 * (1e-2 * w - d.T @ (1 / (1 + np.exp(d @ w))) / n)
    assert np.allclose(C.bradley_terry(good, bad), w, atol=1e-6)


def test_cut_equals_trying_every_threshold():
    r = np.random.default_rng(6)
    for _ in range(30):
        s, y = np.round(r.normal(size=25), 1), r.integers(0, 2, 25)
        cut = C.quantile_cut(s, y)
        errors = lambda c: int(((s > c) != (y == 1)).sum())
        assert errors(cut) == min(errors(c) for c in [s.min() - 1, *(s + 1e-9)])
