"""Token counts behind a digest cache.

The cache is a Parquet table (digest, n_tokens) in a shared folder, partitioned
by version: the digest is the SHA-256 of the normalised content, the version that of everything
counts come from (the tokenizer's files and splitting pattern). Counting joins
the documents' distinct digests to the cache; texts are fetched for the misses
alone, each is encoded once, and the counts are appended.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import lean, materialize

CACHE = "digest string, n_tokens long, version string"
_LOADED: dict = {}


#: Digests of misses that are broadcast to the texts at most (64 bytes each).
FEW_MISSES = 20_000


def _ranks_path(path: str) -> str | None:
    beside = path[:-len(".json")] + ".tiktoken"
    return beside if path.endswith(".json") and os.path.exists(beside) else None


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and, where texts are counted by the ranks
    beside it, of those and of the pattern that splits texts for them."""
    h = hashlib.sha256()
    for p in (path, _ranks_path(path)):
        if p:
            with open(p, "rb") as f:
                h.update(hashlib.sha256(f.read()).digest())
    if _ranks_path(path):
        import public_tokenizers
        h.update(public_tokenizers.PATTERN.encode())
    return h.hexdigest()


class Counter:
    """Counts tokens as the file's own library does (no added tokens, no
    truncation, special strings as by default). For a byte-level BPE .json that
    has its ranks beside it (.tiktoken), texts are counted with the ranks, about
    five times faster for the same counts; what that encoder can't take (such as
    huge runs of white space) goes to the library itself."""

    def __init__(self, path: str, fast: bool = True):
        self.path, self.ranks, self.lib, self.specials = path, None, None, []
        beside = _ranks_path(path)
        if fast and beside:
            with open(path, "rb") as f:
                spec = json.load(f)
            added = spec["added_tokens"]
            plain = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added) and len(added) <= 1
            if spec["normalizer"] is None and plain:
                import public_tokenizers
                import tiktoken
                with open(beside, "rb") as f:
                    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
                self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
                self.specials = [t["content"] for t in added]

    def library(self):
        """The file's own library, loaded when a text needs it."""
        if self.lib is None:
            if self.path.endswith(".model"):
                import sentencepiece
                self.lib = sentencepiece.SentencePieceProcessor(model_file=self.path)
            else:
                from tokenizers import Tokenizer
                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                self.lib = Tokenizer.from_file(self.path)
                self.lib.no_padding()
                self.lib.no_truncation()
        return self.lib

    def slow(self, text: str) -> int:
        lib = self.library()
        if self.path.endswith(".model"):
            return len(lib.encode(text, num_threads=1))
        return len(lib.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if self.ranks is None:
            return self.slow(text)
        try:
            if self.specials and self.specials[0] in text:
                parts = text.split(self.specials[0])
                return len(parts) - 1 + sum(len(self.ranks.encode_ordinary(p)) for p in parts)
            return len(self.ranks.encode_ordinary(text))
        except BaseException as e:
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):  # what the encoder itself gives up on
                raise
            return self.slow(text)


    def cuts(self, text: str, every: int) -> list[int]:
        """The UTF-8 byte at which each ``every``-th token begins, the first
        left out: where a text is parted into pieces of so many tokens."""
        if self.ranks is not None:
            try:
                special = self.specials[0] if self.specials else None
                parts = text.split(special) if special and special in text else [text]
                size = []
                for i, part in enumerate(parts):
                    size += [len(special.encode())] if i else []
                    size += [len(self.ranks.decode_single_token_bytes(t)) for t in self.ranks.encode_ordinary(part)]
                ends = list(itertools.accumulate(size))
                return [ends[k - 1] for k in range(every, len(size), every)]
            except BaseException as e:
                if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                    raise
        lib = self.library()
        if self.path.endswith(".model"):
            starts = [p.begin for p in lib.encode(text, return_type="proto").pieces]  # bytes
            return [starts[k] for k in range(every, len(starts), every)]
        starts = [a for a, _ in lib.encode(text, add_special_tokens=False).offsets]  # characters
        return [len(text[:starts[k]].encode()) for k in range(every, len(starts), every)]


def counter(path: str, fast: bool = True) -> Counter:
    """One per worker process."""
    key = (path, fast)
    if key not in _LOADED:
        _LOADED[key] = Counter(path, fast)
    return _LOADED[key]


def _encode(path: str, version: str):
    def run(batches):
        c = counter(path)
        for b in batches:
            text = b.column("text")
            n = [c.count(text[i].as_py()) for i in range(len(text))]  # one text at a time in Python
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64()), pa.array([version] * len(n), pa.string())], ["digest", "n_tokens", "version"])
    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty; rows that repeat an id stay separate rows;
    equal texts are encoded once. ``cache_path`` is a folder all executors
    share; a missing one is an empty cache. An append becomes visible only when
    its job has committed, and a digest that two runs appended is read once.
    Normalised content is the text in UTF-8, null as empty: what the tokenizer
    counts, so equal digests have equal counts. Texts of any length are encoded
    whole, one at a time. An empty table gives no rows; further columns, whatever
    their names, play no part.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    rows = materialize(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    counts = counts_by_digest(rows.select("digest"), keyed.select("digest", "text"), tokenizer_path, cache_path)
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def counts_by_digest(digests: DataFrame, texts: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """(digest, n_tokens), a row each, of all ``digests``: from the cache, which
    first gets what it lacks from ``texts`` (digest, text)."""
    spark = digests.sparkSession
    version = tokenizer_version(tokenizer_path)
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("version").parquet(cache_path)

    def stored():
        spark.catalog.refreshByPath(cache_path)
        return spark.read.schema(CACHE).parquet(cache_path).filter(F.col("version") == version).select("digest", "n_tokens")

    misses = materialize(digests.distinct().join(stored(), "digest", "left_anti"), "misses")
    n = misses.count()
    if n:
        if n <= FEW_MISSES:  # texts of hits stay where they are
            texts = texts.join(F.broadcast(misses), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            texts = texts.dropDuplicates(["digest"]).join(misses, "digest", "left_semi")
        texts.mapInArrow(lean(_encode(tokenizer_path, version)), CACHE).write.mode("append").partitionBy("version").parquet(cache_path)
    # one row per digest, as a table: a join to it can then split a hot digest
    return materialize(stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
