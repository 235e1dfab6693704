import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketry.llm import minhash as M
from basketry.llm.components import connected_components

from corpus_rows import odd_rows, words

SEP = " \t\n\x0b\x0c\r"


def shingles(t, k):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in SEP:
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    return set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, k, percent):
    """Smallest reachable key by key, and the number of links."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    inverse, root, links = defaultdict(list), {i: i for i in sets}, 0
    for i in sorted(sets):
        for s in sets[i]:
            inverse[s].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in sets:
        for j, n in Counter(j for s in sets[i] for j in inverse[s] if j < i).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                links += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}, links


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_tables_match_brute_force(docs, texts, k, percent):
    comp, n, _ = brute(texts, k, percent)
    rows = M.near_duplicates(docs, k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (n[i], comp[i], comp[i] == i) for i in texts}
    assert sum(r.chosen for r in rows) == len(set(comp.values()))


def edited(text, share, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(max(1, round(len(w) * share))):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_chains_hubs_and_templates(spark):
    texts = {}
    base = words(50, 300, 3000)
    texts |= {i: edited(base, 0.015, i) for i in range(0, 60)}  # a hub of near copies, not all linked to each other
    chain = base = words(51, 200, 3000)
    for i in range(100, 115):  # a chain: only neighbours are linked
        chain = edited(chain, 0.015, i)
        texts[i] = chain
    form = words(52, 120, 3000)
    texts |= {200 + i: form + " " + words(600 + i, 60, 3000) for i in range(50)}  # a template: similar, never linked
    texts |= {300 + i: form + " " + words(600 + i, 60, 3000) for i in range(0, 50, 7)}  # but for its copies
    texts |= {400 + i: " ".join(f"t{j}" for j in range(i, i + 8)) for i in range(6)}
    comp, n, links = brute(texts, 3, 85)
    rows = M.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in rows} == comp and links > 100
    assert {r.doc_id: r.n_shingles for r in rows} == n


def test_odd_rows(odd, empty):
    rows = M.near_duplicates(odd, keep=("text", "lang")).collect()
    data = odd_rows()
    assert len(rows) == len(data)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert {r.component_id for r in by[12]} == {1} and not by[12][0].kept
    assert {r.component_id for r in by[11]} == {7} and [r.chosen for r in by[11]] == [False]
    assert sorted(r.chosen for r in by[7]) == [False, True, True]  # one of the equal rows, and the other text
    assert by[0][0].component_id == -5 and by[-5][0].kept
    for i in (2, 3, 4):
        assert (by[i][0].component_id, by[i][0].n_shingles, by[i][0].kept, by[i][0].chosen) == (i, 0, True, True)
    assert sorted((r.component_id, r.kept, r.chosen) for r in by[None] if r.n_shingles) == [(7, False, False)]
    assert [(r.component_id, r.kept, r.chosen) for r in by[None] if not r.n_shingles] == [(None, False, True)]
    assert M.near_duplicates(empty).collect() == []


def test_registers_estimate_similarity():
    r = np.random.default_rng(2)
    for j in (0.3, 0.6, 0.9):
        got = []
        for _ in range(20):
            n = 3000
            common = int(2 * n * j / (1 + j))
            x = r.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
            a, b = M.registers(np.unique(x[:n])), M.registers(np.unique(x[n - common:]))
            got.append(((a == b) & (a > 0)).mean())
        assert abs(np.mean(got) - j) < 0.03
    # leading zeros and mantissa of a known value: bucket 5, 0...01xxxxxxxxxx
    s = np.array([(5 << 56) | (0b11000000001 << 40)], np.uint64)
    reg = M.registers(s)
    assert reg[5] == ((53 - 48 + 1) << 10) + 0b1000000001 and (reg > 0).sum() == 1


def test_components_of_paths_cycles_and_hubs(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)] + [(3000 + i, 3000 + (i + 1) % 17) for i in range(17)] + [(5, 5), (7, 6)]
    edges += [(r.randrange(4000, 4100), r.randrange(4000, 4100)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_bands_follow_from_the_threshold():
    assert M.banding(85) == (7, 36) and M.banding(80) == (6, 42)
    for percent in range(20, 101):
        rows, bands = M.banding(percent)
        assert rows * bands <= M.REGISTERS and M.missed(percent, rows) <= M.MISS
    assert M.banding(0) == (1, 256)


def test_isolated_pairs_at_the_threshold_share_a_band():
    # three of these pairs share none of 36 bands of 7 registers
    r = np.random.default_rng(3)
    rows, bands = M.banding(80)
    a = r.integers(1, 1 << 15, (20_000, M.REGISTERS)).astype(np.uint16)
    b = np.where(r.random(a.shape) < 0.8, a, a + 1).astype(np.uint16)
    alike = (a == b)[:, :rows * bands].reshape(-1, bands, rows).all(axis=2).any(axis=1)
    for i in range(0, 20_000, 100):
        assert (M.band_keys(a[i], rows, bands) == M.band_keys(b[i], rows, bands)).any() == alike[i]
    assert alike.all()


def test_linked_sets_share_a_prefix_shingle(spark):
    r = random.Random(8)
    base = [r.randrange(10**6) for _ in range(60)]
    rows = []
    for i in range(120):
        kept = [x for x in base if r.random() < r.choice((0.8, 0.95, 1.0))]
        rows.append((i, i, sorted({*kept, *(r.randrange(10**6) for _ in range(r.randrange(0, 8)))})))
    for percent in (50, 80, 85, 100):
        got = defaultdict(set)
        for x in M.prefixes(spark.createDataFrame(rows, "cid long, comp long, items array<bigint>"), percent).collect():
            got[x.cid].add(x.item)
        linked = 0
        for i, _, a in rows:
            assert len(got[i]) <= len(a) - -(-len(a) * percent // 100) + 1
            for j, _, b in rows[:i]:
                both = len(set(a) & set(b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    linked += 1
                    assert got[i] & got[j]
        assert linked or percent == 100


def test_texts_of_one_template_are_done_without_comparing_them(spark):
    """Similar to each other at about 0.6 and never linked: no two of them meet."""
    form = [f"f{i}" for i in range(150)]
    rows = [(i, i, [hash_of(x) for x in form + [f"own{i}-{j}" for j in range(45)]]) for i in range(1000)]
    assert M.prefixes(spark.createDataFrame(rows, "cid long, comp long, items array<bigint>"), 85).count() == 0


def hash_of(x):
    import zlib
    return zlib.crc32(x.encode())
