"""Secret scans with corpus-wide ownership frequency.

Candidate secrets are found in every text; the digests of their values are
counted over the corpus by distinct owners and distinct repositories. A value
that many owners carry is a copied example; one that a single owner carries,
and that looks random enough, is reported as live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import lean, map_texts, materialize, span_digest

KINDS = ("assign", "access", "hex")
ALL_KINDS = KINDS + ("live", "example")
_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")


def entropy(value: str) -> float:
    """Bits per character of a value's own character counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def detect(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind index, end, value start, value end) of the base kinds."""
    out = []
    for m in _ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 8:
            out.append((m.start(), 0, m.end(), m.start(1), m.end(1)))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _scan(texts: list[str]) -> list[list]:
    found, digests = [], []
    for t in texts:
        spans = detect(t)
        found.append([(a, k, b, x, y, hashlib.sha256(t[x:y].encode()).hexdigest()[:32], entropy(t[x:y])) for a, k, b, x, y in spans])
        digests.append(hashlib.sha256(span_digest([s[:3] for s in spans], KINDS).encode()).hexdigest())
    return [[[dict(zip(("start", "kind", "end", "value_start", "value_end", "digest", "entropy"), s)) for s in f] for f in found], digests]


_SPANS = "array<struct<start: long, kind: int, end: long, value_start: long, value_end: long, digest: string, entropy: double>>"


def ownership(found: DataFrame) -> DataFrame:
    """digest, n_owners, n_repos of rows (digest, owner, repo). Three partial
    aggregations: a digest that a third of all rows carry is reduced before
    every shuffle. A repository belongs to its owner, so counts add up."""
    pairs = found.groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
                 example_owners: int = 3, min_entropy: float = 3.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_live, n_example, verdicts (per span: start, kind,
    end, value_start, value_end, digest, n_owners, n_repos, verdict), and the
    columns of ``docs`` named in ``keep`` under ``keep_<name>``.

    A value that ``example_owners`` or more distinct owners carry is an
    ``example``; a value of one owner with at least ``min_entropy`` bits a
    character is ``live``; the rest is ``unclear``. The ``live`` and
    ``example`` spans cover the value. Whole texts are scanned (null as empty);
    a null owner or repository counts as one like any other; rows that repeat
    an id stay separate rows (in one repository if it is the id).
    """
    cols = {"rid": F.monotonically_increasing_id(), "doc_id": F.col(id_col), "owner": F.col(owner_col).cast("string"), "repo": F.col(repo_col).cast("string")}
    cols |= {f"keep_{c}": F.col(c) for c in keep}
    scanned = materialize(map_texts(docs, cols, text_col, f"found {_SPANS}, base_sha256 string", _scan), "secrets")
    one = scanned.filter(F.size("found") > 0).select("rid", "owner", "repo", F.explode("found").alias("s"))
    hits = one.select("rid", "owner", "repo", "s", F.col("s.digest").alias("digest"))
    owned = materialize(ownership(hits.select("digest", "owner", "repo")), "ownership")  # the join can split a hot digest
    judged = hits.select("rid", "s", "digest").join(owned, "digest")
    verdict = (F.when(F.col("n_owners") >= example_owners, "example")
               .when((F.col("n_owners") == 1) & (F.col("s.entropy") >= min_entropy), "live").otherwise("unclear"))
    per_row = judged.select("rid", F.struct("s.start", "s.kind", "s.end", "s.value_start", "s.value_end", "digest", "n_owners", "n_repos", verdict.alias("verdict")).alias("v"))
    # spans of one row only: bounded by its text
    gathered = per_row.groupBy("rid").agg(F.sort_array(F.collect_list("v")).alias("verdicts"))
    none = F.expr("cast(array() as array<struct<start: long, kind: int, end: long, value_start: long, value_end: long, digest: string, n_owners: long, n_repos: long, verdict: string>>)")
    # only rows with spans are joined; the rest stays where it is
    out = scanned.filter(F.size("found") > 0).join(gathered, "rid").unionByName(scanned.filter(F.size("found") == 0).withColumn("verdicts", none))
    counts = [F.expr(f"size(filter(verdicts, v -> v.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    marks = [F.expr(f"size(filter(verdicts, v -> v.verdict = '{name}'))").cast("long").alias(f"n_{name}") for name in ("live", "example")]
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    all_spans = F.sort_array(F.concat(
        F.transform("verdicts", lambda v: F.struct(v["start"].alias("a"), v["kind"].alias("k"), v["end"].alias("b"))),
        F.transform(F.filter("verdicts", lambda v: v["verdict"].isin("live", "example")),
                    lambda v: F.struct(v["value_start"].alias("a"), F.when(v["verdict"] == "live", 3).otherwise(4).alias("k"), v["value_end"].alias("b")))))
    spans = F.concat_ws(",", F.transform(F.array_distinct(all_spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["a"].cast("string"), x["b"].cast("string"))))
    return out.select("doc_id", *counts, "base_sha256", spans.alias("spans"), *marks, "verdicts", *[f"keep_{c}" for c in keep])


def redact(text, spans) -> str:
    """The text with its (start, end) ranges replaced by a marker; overlapping
    and touching ranges share one."""
    out, pos = [], 0
    for a, b in sorted(spans):
        if a > pos or not out:
            out += [text[pos:a], "[SECRET]"]
        pos = max(pos, b)
    return "".join(out) + text[pos:]


def redacted(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), chars_col: str = "n_chars", **options) -> DataFrame:
    """The ``keep`` columns (the text among them) of every row, the values of
    secrets that are not widely copied examples replaced by a marker, and
    ``chars_col``, if kept, brought up to date where a text changed."""
    found = scan_secrets(docs, text_col=text_col, keep=keep, **options)
    ranges = F.expr("transform(filter(verdicts, v -> v.verdict <> 'example'), v -> struct(v.value_start as a, v.value_end as b))")
    base = found.select(*[F.col(f"keep_{c}").alias(c) for c in keep], ranges.alias("__ranges"))
    names, shape = list(keep), base.drop("__ranges").schema

    def run(batches):
        for b in batches:
            texts, chars = b.column(text_col).to_pylist(), b.column(chars_col).to_pylist() if chars_col in names else None
            for i, r in enumerate(b.column("__ranges").to_pylist()):
                if r:
                    texts[i] = redact(texts[i], [(x["a"], x["b"]) for x in r])
                    if chars is not None:
                        chars[i] = len(texts[i])
            new = {text_col: pa.array(texts, b.column(text_col).type)} | ({chars_col: pa.array(chars, b.column(chars_col).type)} if chars is not None else {})
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], names)

    return base.mapInArrow(lean(run), shape)
