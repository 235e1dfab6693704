import math
import re
from collections import Counter

from pyspark.sql import functions as F

from basketry.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(t):
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def got(df):
    return df.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_measures_match_brute_force(docs, texts):
    for r in Q.measured(docs, keep={"doc_id": F.col("doc_id")}).collect():
        assert tuple(r)[1:] == expected(texts[r.doc_id])


def test_odd_rows(odd, labels):
    rows = Q.quality_rules(odd, labels).collect()
    want = sorted(expected(r.text or "") for r in odd.select("text").collect())
    assert sorted(tuple(r)[1:7] for r in rows) == want
    assert all(not r.kept for r in rows if r.base_failed)


def test_hash_ties_fall_back_to_words(spark):
    # the text path gives what the packed path gives
    df = spark.createDataFrame([("a b c d a b c x a b c",), ("a a a a a",), ("a b c",), ("a b c a b",)], "t string")
    slow = Q._COVERED.replace("size(p.eq) = 0", "false").replace("forall(p.eq, i ->", "forall(array(0), i -> false and")
    fast = df.selectExpr("split(t, ' ') as ws").selectExpr(f"{Q._COVERED} as c").collect()
    text = df.selectExpr("split(t, ' ') as ws").selectExpr(f"{slow} as c").collect()
    assert [r.c for r in fast] == [r.c for r in text] == [9, 5, 0, 0]


def test_binomial_tail_is_exact(spark):
    cases = [(0, 300), (3, 500), (20, 2500), (100, 20_000), (480, 100_000), (0, 1), (9, 1000), (7, 50)]
    rows = spark.createDataFrame(cases, "k long, n long").withColumn("p", Q.binomial_tail("k", "n", 0.01)).collect()
    for r in rows:
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(.01) + (r.n - i) * math.log(.99)) for i in range(r.k + 1))
        assert abs(r.p - (want if r.k < r.n * .01 else 1)) < 1e-8


def test_cutoffs_limit_false_rejections(spark):
    n = 4000
    rows = [("s", 1, 100, 100 * 5, i % 1000 == 0 and 30 or 0, 0, 0, False) for i in range(n)] + [("t", 1, 100, 500, 90, 0, 0, False)] * 5
    df = spark.createDataFrame(rows, "_s string, y int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    cut = {r["_s"]: r for r in Q.choose_cutoffs(df, F.col("y") == 1, "_s").collect()}
    assert cut["s"].symbol_share == 0.05  # 4 of 4000 rejected at the strictest cutoff
    assert cut["t"].symbol_share is None  # five rows certify nothing
    assert cut["s"].long_words == 8.0 and cut["s"].short_words == -5.0


def test_empty_tables(empty, labels, odd):
    assert Q.quality_rules(empty, labels).collect() == []
    none = labels.limit(0)
    rows = Q.quality_rules(odd, none).collect()
    assert all(r.kept == (not r.base_failed) for r in rows)
