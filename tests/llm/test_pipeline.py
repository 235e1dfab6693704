import contextlib
import re

from pyspark.sql import functions as F

import corpus_pipeline as C
from basketry.llm.common import materialize, small_batches
from test_minhash import brute

SF = "/root/testdata/sf0.001"


def count(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    lib = count.__dict__.setdefault("lib", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return len(lib.encode(text, add_special_tokens=False).ids)


def test_stages_keep_what_their_operators_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        rows = docs.collect()
        if name != "pack":
            assert docs.columns == list(C.COLUMNS)
        after = {r.doc_id: r.text for r in rows} if name != "pack" else {r.doc_id: None for r in rows}
        assert set(after) <= set(before)
        if name == "quality":
            gone = set(before) - set(after)
            known = [labels[i].quality for i in gone if i in labels]
            assert known and sum(known) <= 0.02 * len(labels) and sum(1 for i in after if i in labels and labels[i].quality == 0) <= 2
        elif name == "near_duplicates":
            comp, _, _ = brute(before, 5, 80)
            assert set(after) == {i for i in comp if comp[i] == i}
        elif name == "decontaminate":
            tok = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) + " "
            items = [tok(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hit = {i for i, t in before.items() if any(x in tok(t) for x in items)}
            assert set(before) - set(after) >= hit and len(set(before) - set(after)) <= len(hit) + 2
        elif name == "redact_secrets":
            assert set(after) == set(before)
            for r in rows:
                assert r.n_chars == len(r.text) and (r.text == before[r.doc_id] or "[SECRET]" in r.text)
        else:
            assert set(after) == set(before)
            for i, t in before.items():
                mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
                assert sum(r.length for r in mine) == count(t)
                assert [r.byte_start for r in mine] == [0, *[r.byte_end for r in mine[:-1]]] and mine[-1].byte_end == len(t.encode())
        before = after


def test_run_and_odd_rows(spark, odd, empty):
    assert C.run(spark, SF).count() > 0
    for frame in (odd, empty):
        docs = frame.select(*C.COLUMNS, "rid", "h").withColumn("score", F.lit(1)).withColumn("kept", F.lit(False))
        for name, stage in C.STAGES:
            docs = materialize(stage(spark, docs, SF), f"odd-{name}")
        assert (docs.count() > 0) == (frame is odd)


def test_stages_bound_batches_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for name, stage in C.STAGES:
            spark.conf.set(key, "64MB")
            with contextlib.suppress(AttributeError):  # stops at the missing table
                stage(spark, None, SF)
            wide = spark.range(6000).repartition(1).select(F.expr("repeat('x', 2000)").alias("t")) if name == "quality" else None
            assert int(spark.conf.get(key).rstrip("b")) == 4 << 20, name
            if wide is not None:
                def size(batches):
                    import pyarrow as pa
                    for b in batches:
                        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])
                got = wide.mapInArrow(size, "n long, size long").collect()
                assert sum(r.n for r in got) == 6000 and max(r.size for r in got) < 5 << 20
        spark.conf.set(key, "1MB")
        small_batches(spark)
        assert spark.conf.get(key) == "1MB"
    finally:
        spark.conf.set(key, before)
