import random

from basketry.llm import decontamination as D

from corpus_rows import words


def item(n, size):
    return words(1000 + n, size, vocab=5000)


def spoiled(text, every, seed=0):
    r = random.Random(seed)
    return " ".join(f"zz{r.randrange(10**6)}" if i % every == every // 2 else w for i, w in enumerate(text.split()))


def frame(spark):
    items = [(n, item(n, 40)) for n in range(20)] + [(90, "short item here"), (91, ""), (92, None), (None, item(3, 40))]
    rows = []
    for n in range(20):
        body = words(n, 200, vocab=3000)
        rows.append((n, body))  # clean
        rows.append((100 + n, f"{body} {item(n, 40)} {body[:300]}"))
        rows.append((200 + n, f"{body[:200]}\n{spoiled(item(n, 40), 8).upper()}, {body}"))
        rows.append((300 + n, f"{body} {' '.join(item(n, 40).split()[:8])} {body}"))  # too little of it
    rows += [(400, "first line\n SHORT item, here!\nlast"), (401, "a short item here"), (402, None), (403, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_passages_with_and_without_substitutions(spark):
    docs, items = frame(spark)
    found = {(r.doc_id, r.item_id): r for r in D.find_contamination(docs, items, block_items=7).collect()}
    assert set(found) == {(100 + n, n) for n in range(20)} | {(200 + n, n) for n in range(20)} | {(400, 90)}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for n in range(20):
        r = found[100 + n, n]
        assert (r.matches, r.similarity) == (40, 1.0)
        assert texts[100 + n].encode()[r.byte_start:r.byte_end].decode() == item(n, 40)
        assert found[200 + n, n].matches == 35 and found[200 + n, n].similarity >= 0.8
    kept = {r.doc_id for r in D.clean_documents(docs, items, block_items=7).collect()}
    assert kept == set(texts) - {d for d, _ in found}


def test_masks_ignore_positions_and_none_is_lossy():
    for masks in D.MASKS[:-2]:
        assert any(b - a > 1 for m in masks for a, b in zip(m, m[1:]))
    rules = (13, 0.8, 0.8)
    assert [D.family(n, *rules) for n in (1, 2, 3)] == [6, 5, 4]
    for size in range(3, 400):  # every length of three tokens or more is searched with gaps
        k = D.family(size, *rules)
        assert k < 5 and (size < 16 or k == 0)
        for n in range(1, min(size, 100) + 1):
            assert D.least_to_block(D.MASKS[k], n) > D.most_replaced(n, size, *rules)
    # beyond 100 tokens a run is made of shorter ones: blocking each 20 takes 5
    assert D.least_to_block(D.MASKS[0], 20) >= 5


def test_least_to_block_equals_trying_all():
    from itertools import combinations
    for masks in D.MASKS:
        for n in range(1, 13):
            def whole(gone):
                return any(all(s + j not in gone for j in m) for m in masks for s in range(n - m[-1]))
            want = next(e for e in range(n + 1) for gone in combinations(range(n), e) if not whole(gone))
            assert D.least_to_block(masks, n) == want


def test_short_items_match_whole_lines_only():
    docs = ["well yes indeed", "Yes!", "a\n yes \nb", "the cat\nand the", "and the", "yes yes", ""]
    assert {k for k in found([(1, "yes"), (2, "and the")], docs)} == {(1, 1), (2, 1), (3, 2), (4, 2)}


def test_a_word_repeated_a_hundred_thousand_times():
    docs = ["the " * 100_000, "the"]
    got = found([(1, "the the the the the"), (2, "the"), (3, " ".join(["the"] * 40))], docs)
    assert got == {(0, 1): 5, (1, 2): 1, (0, 3): 40}


def test_items_are_sent_in_blocks_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 100)
    items = spark.createDataFrame([(n, item(n, 3 + 10 * (n % 4))) for n in range(15)], "item_id long, text string")
    blocks = list(D.item_blocks(items, "item_id", "text", 4))
    assert sorted(x for b in blocks for x in b) == sorted((r.item_id, r.text) for r in items.collect())
    assert all(len(b) <= 4 and (len(b) == 1 or sum(len(t.encode()) for _, t in b) <= 100) for b in blocks)


def test_whole_items_are_found_in_the_tables(spark, docs, texts):
    import re
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    tok = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) + " "
    want = {(i, r.item_id) for r in bench.collect() for i, t in texts.items() if tok(r.text) in tok(t)}
    got = {(r.doc_id, r.item_id) for r in D.find_contamination(docs, bench).collect()}
    assert want <= got and len(got) <= len(want) + 2


def test_odd_rows(odd, empty, spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, words(2, 120))], "item_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.item_id) for r in D.find_contamination(odd, items).collect())
    assert got == [(False, 1, 1), (False, 7, 2), (False, 7, 2), (False, 11, 2), (False, 12, 1), (True, None, 2)]
    assert D.find_contamination(empty, items).collect() == [] and D.find_contamination(odd, items.limit(0)).collect() == []
    clean = D.clean_documents(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 6


def brute(item, doc):
    """The most agreeing tokens of any accepted aligned run, 0 if none is."""
    if len(item) < D.SHORT:
        return len(item) if item == doc else 0
    best = 0
    for shift in range(1 - len(item), len(doc)):
        same = [0 <= p + shift < len(doc) and x == doc[p + shift] for p, x in enumerate(item)]
        inside = [0 <= p + shift < len(doc) for p in range(len(item))]
        for a in range(len(item)):
            for b in range(a + 1, len(item) + 1):
                m = sum(same[a:b])
                if all(inside[a:b]) and 10 * m >= 8 * (b - a) and (m >= 13 if len(item) >= 17 else 10 * m >= 8 * len(item)):
                    best = max(best, m)
    return best


def found(items, docs, **rules):
    import pyarrow as pa
    rules = {"min_tokens": 13, "share": 0.8, "cover": 0.8} | rules
    s = D.Seeds(items, **rules)
    return {(r, i): m for r, i, _, m, *_ in D.overlaps(pa.RecordBatch.from_arrays([pa.array(docs, pa.string())], ["t"]), "t", s, rules["share"])}


def test_no_set_of_substitutions_hides_an_item():
    from itertools import combinations
    for size in range(1, 21):
        w = [f"t{j}" for j in range(size)]
        docs, want = [], {}
        for e in range(min(size, 4) + 1):
            for gone in combinations(range(size), e):
                doc = ["before"] + [f"x{j}" if j in gone else x for j, x in enumerate(w)] + ["after"]
                if size < D.SHORT:
                    doc = doc[1:-1]
                if size < 12 or len(docs) % 97 == 0:
                    m = brute(w, doc)
                    want |= {(len(docs), 1): m} if m else {}
                elif size - e >= (13 if size >= 17 else 0.8 * size) and 10 * (size - e) >= 8 * size:
                    want[len(docs), 1] = None
                docs.append(" ".join(doc))
        got = found([(1, " ".join(w))], docs)
        assert all(k in got and m in (None, got[k]) for k, m in want.items()), size
        assert all(k in want for k in got if size < 12), size


def test_overlaps_equal_brute_force_on_few_words():
    r = random.Random(5)
    items = [(n, " ".join(r.choice("abc") for _ in range(r.randrange(1, 24)))) for n in range(25)]
    docs = [" ".join(r.choice("abc") for _ in range(r.randrange(0, 30))) for _ in range(25)]
    want = {(d, n): m for d, x in enumerate(docs) for n, t in items if (m := brute(t.split(), x.split()))}
    assert found(items, docs) == want and want
    for share, cover in ((1.0, 1.0), (0.5, 0.5), (0.0, 0.3), (0.9, 1.1)):  # no rule fails
        found(items, docs, share=share, cover=cover)
