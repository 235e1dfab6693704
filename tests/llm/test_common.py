import numpy as np
import pyarrow as pa

from basketry.llm import common as C
from basketry.llm import suffix_dedup as S


def test_words_by_bytes_and_rows():
    texts = ["a bb\tccc", "", " \x0b", "dé e\x85f", "Zz"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    s, e, r = C.word_bounds(data, offsets)
    got = [(int(k), data[a:b].tobytes().decode()) for a, b, k in zip(s, e, r)]
    assert got == [(0, "a"), (0, "bb"), (0, "ccc"), (3, "dé e\x85f"), (4, "Zz")]
    low = C.word_hashes(np.frombuffer(b"ZZ zz", np.uint8), np.array([0, 3]), np.array([2, 5]))
    assert low[0] == low[1]
    raw = C.word_hashes(np.frombuffer(b"ZZ zz", np.uint8), np.array([0, 3]), np.array([2, 5]), lower=False)
    assert raw[0] != raw[1]


def test_slices_cover_every_row():
    texts = ["x" * n for n in (0, 5, 3000, 0, 1, 900, 200, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(["skip", *texts]).slice(1)], ["t"])
    rows = []
    for lo, hi, data, offsets in C.text_slices(batch, "t", max_bytes=1000):
        assert len(offsets) == hi - lo + 1 and offsets[-1] == len(data)
        rows += [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
    assert rows == texts


def test_long_texts_hash_in_strides(monkeypatch):
    rng = np.random.default_rng(0)
    data = np.frombuffer(("".join(rng.choice(list("ab cd\n"), 3000)) + "x" * 500 + " tail").encode(), np.uint8)
    s, e, _ = C.word_bounds(data, np.array([0, 100, 1700, len(data)]))
    whole = C.word_hashes(data, s, e)
    monkeypatch.setattr(C, "STRIDE", 64)
    assert (C.word_hashes(data, s, e) == whole).all()


def test_long_texts_anchor_in_pieces(monkeypatch):
    text = "".join(np.random.default_rng(1).choice(list("abcdefgh "), 9000))
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])

    def owners():
        return {int(f + w): (int(f + off), int(h)) for _, _, first, count, offs, hs in S._runs(batch, 100, 24)
                for f, n, off, h in zip(first, count, offs, hs) for w in range(n)}
    whole = owners()
    monkeypatch.setattr(S, "STRIDE", 700)
    assert owners() == whole and len(whole) == len(text) - 99


def test_lean_tasks_give_back_after_their_last_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(C, "give_back", lambda: calls.append(len(seen)))
    seen = []
    for b in C.lean(lambda batches: (2 * b for b in batches))(iter([1, 2, 3])):
        assert calls == []
        seen.append(b)
    assert seen == [2, 4, 6] and calls == [3]
