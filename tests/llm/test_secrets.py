import hashlib
import re

import pytest

from basketry.llm import secrets as S

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(t):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32])


def want(t):
    b = base(t)
    return (*[sum(x[1] == k for x in b) for k in range(3)], hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, k, e in b).encode()).hexdigest())


def test_matches_brute_force(docs, texts):
    for r in S.scan_secrets(docs).collect():
        assert tuple(r)[1:5] == want(texts[r.doc_id])
        assert {f"{k}:{a}:{e}" for a, _, k, e in base(texts[r.doc_id])} <= set(r.spans.split(","))


def test_odd_rows(odd, empty):
    rows = S.scan_secrets(odd).collect()
    assert sorted(tuple(r)[1:5] for r in rows) == sorted(want(r.text or "") for r in odd.select("text").collect())
    assert S.scan_secrets(empty).collect() == []


KEY = "AKIA" + "QZ7XW2MN4KLP8RTV"


@pytest.fixture(scope="module")
def leaked(spark):
    example = "token = abcdefgh12345678zyxw"
    rows = [(i, f"é {example} in use", f"src{i % 5}") for i in range(40)] + [(100, f"key {KEY} here", "src1"), (100, f"key {KEY} here", "src1"), (101, "PASSWORD: aaaaaaaaaaaa", "src2"), (102, "passwd=short", "src2"), (103, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_ownership_separates_examples_from_live(leaked):
    rows = S.scan_secrets(leaked).collect()
    assert len(rows) == 45
    for r in rows:
        if r.doc_id < 100:
            assert (r.n_live, r.n_example) == (0, 1) and r.spans == "assign:2:30,example:10:30"
        elif r.doc_id == 100:  # both copies, of one owner
            assert (r.n_live, r.n_example) == (1, 0) and r.verdicts[0].n_owners == 1 and r.verdicts[0].n_repos == 1
        elif r.doc_id == 101:  # one owner, but no randomness
            assert (r.n_live, r.n_example, r.n_assign) == (0, 0, 1)
        else:
            assert r.spans == ""


def test_redaction(leaked):
    out = {(r.doc_id, r.text) for r in S.redacted(leaked, keep=("doc_id", "text", "source")).collect()}
    assert (100, "key [SECRET] here") in out and (101, "PASSWORD: [SECRET]") in out and (0, "é token = abcdefgh12345678zyxw in use") in out and (103, None) in out
    assert S.redact("abcdef", [(1, 3), (2, 4)]) == "a[SECRET]ef"
