import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from basketry.llm import token_counts as T
from basketry.session import scratch_path

PATH = P.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
HARD = ["", " ", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext|> x", "<|endoftext", "'s I'll  \n\n\tx", "日本語 \U0001F600é", "x" * 20_000, " " * 200_000, "\n" * 3000 + "a", "a 　 b c", "½²³٣४", "ﬁ ǅ é", " \u0085 x", "aaa " * 5000]


def test_fast_counts_are_the_librarys():
    c = T.Counter(PATH)
    assert c.ranks is not None
    for t in HARD:
        assert c.count(t) == len(LIB.encode(t, add_special_tokens=False).ids), t[:20]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name, texts):
    c = T.Counter(P.path(name))
    few = list(texts.values())[:5]
    if name.endswith(".json"):
        lib = Tokenizer.from_file(P.path(name))
        assert [c.count(t) for t in few] == [len(lib.encode(t, add_special_tokens=False).ids) for t in few]
    else:
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        assert [c.count(t) for t in few] == [len(lib.encode(t)) for t in few]


def test_counts_and_cache(spark, docs, texts, odd, empty):
    cache = scratch_path(spark, "cache")
    first = {r.doc_id: r for r in T.token_counts(docs, PATH, cache).collect()}
    for i, t in texts.items():
        n = len(LIB.encode(t, add_special_tokens=False).ids)
        assert tuple(first[i]) == (i, len(t.encode()), n, n > 1024)
    stored = spark.read.parquet(cache)
    assert stored.count() == len(set(texts.values())) == stored.select("digest").distinct().count()
    # nothing is encoded twice; another table adds its misses only
    again = T.token_counts(docs, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == stored.count() and len(again) == len(first)
    rows = T.token_counts(odd, PATH, cache).collect()
    want = sorted(len(LIB.encode(r.text or "", add_special_tokens=False).ids) for r in odd.select("text").collect())
    assert sorted(r.n_tokens for r in rows) == want
    new = {r.text or "" for r in odd.select("text").collect()} - set(texts.values())
    spark.catalog.refreshByPath(cache)
    assert spark.read.parquet(cache).count() == stored.count() + len(new)
    assert T.token_counts(empty, PATH, cache).collect() == []
    # an entry that two runs appended counts once
    spark.read.parquet(cache).limit(5).coalesce(1).write.mode("append").partitionBy("version").parquet(cache)
    assert len(T.token_counts(docs, PATH, cache).collect()) == len(first)


def test_many_misses_give_the_same(spark, docs, monkeypatch):
    want = sorted(map(tuple, T.token_counts(docs, PATH, scratch_path(spark, "cache")).collect()))
    monkeypatch.setattr(T, "FEW_MISSES", 0)
    assert sorted(map(tuple, T.token_counts(docs, PATH, scratch_path(spark, "cache")).collect())) == want


def test_a_second_run_of_the_query_encodes_nothing(spark, monkeypatch):
    from basketry.llm import queries as Q
    first = sorted(map(tuple, Q.op7_token_counts(spark, "/root/testdata/sf0.001").collect()))

    def refuse(*_):
        raise AssertionError("something was encoded")
    monkeypatch.setattr(T, "_encode", refuse)
    assert sorted(map(tuple, Q.op7_token_counts(spark, "/root/testdata/sf0.001/").collect())) == first


def test_the_version_follows_everything_counts_come_from(tmp_path, monkeypatch):
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        (tmp_path / name).write_bytes(open(P.path(name), "rb").read())
    path = str(tmp_path / "byte_bpe_50k.json")
    seen = {T.tokenizer_version(path)}
    (tmp_path / "byte_bpe_50k.tiktoken").write_bytes(b"")
    seen.add(T.tokenizer_version(path))
    monkeypatch.setattr(P, "PATTERN", "x")
    seen.add(T.tokenizer_version(path))
    assert len(seen) == 3
