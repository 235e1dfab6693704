import hashlib
import random

import numpy as np
import pytest

from basketry.llm import suffix_dedup as S

from corpus_rows import words


def brute(rows, length=100):
    """rows: (id, text) in corpus order."""
    seen, out = set(), []
    for _, t in rows:
        b = (t or "").encode()
        rm = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                rm[s:s + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, x in enumerate(rm) if x and (i == 0 or not rm[i - 1]))
        out.append((len(b), sum(rm), spans, hashlib.sha256(bytes(c for c, x in zip(b, rm) if not x)).hexdigest()))
    return out


@pytest.mark.parametrize("block", [2000, 2])
def test_matches_brute_force(docs, texts, block):
    rows = sorted(texts.items())
    want = dict(zip((i for i, _ in rows), brute(rows)))
    for r in S.remove_repeats(docs, block=block).collect():
        assert tuple(r)[1:5] == want[r.doc_id]


def test_periodic_and_shared_passages(spark):
    passage = words(9, 40)
    rows = [(i, f"{words(i, 30)} {passage} {words(100 + i, 30)}") for i in range(30)]
    rows += [(50, "ab" * 400), (51, "x" * 1500), (52, "x" * 99), (53, "x" * 100), (54, words(3, 30)), (55, words(3, 30) + "!"), (56, "é" * 120)]
    got = {r.doc_id: tuple(r)[1:5] for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block=7).collect()}
    assert got == dict(zip((i for i, _ in rows), brute(rows)))


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert S.remove_repeats(empty).collect() == []
    got = S.remove_repeats(odd).collect()
    assert len(got) == len(rows)
    # rows equal in id and text share a result, so the brute force sees them once
    order = sorted({(i is None, i or 0, t or "") for i, t in rows if (i, t) not in ((7, words(3, 90)),)})
    want = dict(zip(((None if a else b, t) for a, b, t in order), brute([(b, t) for _, b, t in order])))
    for key in ((1, rows[0][1]), (12, rows[15][1]), (-5, rows[17][1]), (0, rows[16][1]), (9, rows[12][1]), (None, rows[9][1])):
        assert any(tuple(r)[1:5] == want[key] for r in got if r.doc_id == key[0])
    assert sum(r.n_bytes for r in got) == sum(len((t or "").encode()) for _, t in rows)


def test_columns_sort_suffixes():
    r = random.Random(5)
    strings = ["".join(r.choice("ab") for _ in range(r.randrange(1, 14))) for _ in range(200)]
    groups = np.array([r.randrange(5) for _ in strings])
    m = np.zeros((14, len(strings)), np.uint16)
    for i, s in enumerate(strings):
        m[:len(s), i] = [ord(c) for c in s]
    c = S.Collection(groups, 100)
    for j in range(13, -1, -1):
        c.insert(m[j])
        key = [(groups[i], strings[i][j:]) for i in c.order]
        assert key == sorted(key)
        for i in range(1, len(key)):
            if key[i][0] == key[i - 1][0]:
                a, b = key[i][1], key[i - 1][1]
                n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
                assert c.lcp[i] == n


def test_no_table_stays_in_the_catalogue(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    S.remove_repeats(docs).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_windows_are_hashed_and_shuffled_once(spark, monkeypatch):
    """The rows of anchors that occur again come from one pass over the texts."""
    from basketry.llm import suffix_dedup as S
    plans, write = {}, S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and write(df, name))
    text = "0123456789abcdefghijklmnopqrstuvwxyz" * 3
    docs = spark.createDataFrame([(1, text), (2, "x" + text), (3, "other")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed > 0 for r in S.remove_repeats(docs).collect()} == {1: False, 2: True, 3: False}
    assert plans["anchors"].count("MapInArrow") == 1 and "Join" not in plans["anchors"]
