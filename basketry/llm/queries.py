"""Registered queries opN_<name> and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import centroid_clustering, context_mixing, decontamination, importance_resampling, minhash, packing, pii, quality_classifier, quality_rules, secrets, sharding, suffix_dedup, token_counts
from basketry.llm.common import table
from basketry.session import ensure_checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"


def tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def token_cache(spark: SparkSession, sf_dir: str) -> str:
    """One cache for each place of the tables: a second run there encodes what is new."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-cache-{hashlib.md5(sf_dir.rstrip('/').encode()).hexdigest()}"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("verdicts")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(table(spark, sf_dir, "documents"), tokenizer(), token_cache(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer(), token_cache(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("chosen")


def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_texts(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_secret_scans, op3_suffix_dedup, op4_pii, op5_decontamination, op6_packing, op7_token_counts, op8_quality_classifier, op9_sharding, op10_minhash,
    op11_context_mixing, op12_importance_resampling, op13_centroid_clustering)}
_RULES = ", ".join(f"{{'rule': '{name}', 'j': {j}, 'c': {float(c)!r}, 'v': {expr}}}" for name, (expr, grid) in quality_rules.RULES.items() for j, c in enumerate(grid))

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || lang, '') AS s FROM documents),
x AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
wd AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM x),
tri AS (SELECT doc_id, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o] AS g FROM wd WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri WHERE g[3] IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o.k) AS n FROM rep CROSS JOIN range(3) o(k) GROUP BY doc_id),
m0 AS (SELECT x.doc_id, s, CAST(len(ws) AS DOUBLE) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS DOUBLE) AS word_chars,
  length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM x LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m0),
truth AS (SELECT doc_id, min(quality) AS y FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
good AS (SELECT m.* FROM m JOIN truth USING (doc_id) WHERE y = 1 AND NOT base_failed),
tests AS (SELECT s, r.rule, r.j, r.c, count(*) AS n, count(*) FILTER (WHERE r.v > r.c) AS k FROM (SELECT s, unnest([{_RULES}]) AS r FROM good) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k < n * 0.01 THEN list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) ELSE 1 END AS p, 0.1 / ((SELECT count(DISTINCT s) FROM good) * {len(quality_rules.RULES)}) AS level FROM tests),
cut AS (SELECT s, rule, arg_max(c, j) AS c FROM p WHERE j < (SELECT coalesce(min(q.j), 1000) FROM p q WHERE q.s = p.s AND q.rule = p.rule AND q.p > q.level) GROUP BY s, rule),
over AS (SELECT doc_id, string_agg(a.rule, ',' ORDER BY a.rule) AS failed_rules FROM
  (SELECT DISTINCT doc_id, s, r.rule, r.v FROM (SELECT doc_id, s, unnest([{_RULES}]) AS r FROM m WHERE n_words > 0)) a JOIN cut ON cut.s = a.s AND cut.rule = a.rule WHERE a.v > cut.c GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules FROM m LEFT JOIN over USING (doc_id)"""

OP9_SQL = """
WITH tbl AS (SELECT list(list_reduce(range(0, 8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), n) ORDER BY n) AS t FROM range(256) r(n)),
d AS (SELECT doc_id, '=' || source AS src, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, coalesce(src, '') AS s, hex(encode(t)) AS x, octet_length(encode(t)) + 8 AS size FROM d),
b AS (SELECT doc_id, s, size, list_transform(range(0, size - 8), lambda i: CAST(('0x' || x[2 * i + 1:2 * i + 2]) AS BIGINT)) AS bytes FROM u),
k AS (SELECT doc_id, s, size, xor(4294967295, list_reduce(bytes, lambda a, v: xor(a >> 8, tbl.t[(xor(a, v) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS crc FROM b CROSS JOIN tbl),
c AS (SELECT *, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(crc AS VARCHAR)) AS h FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id NULLS FIRST, size, crc) - 1 AS r, count(*) OVER (PARTITION BY s) AS n FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * r + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), s, r) - 1 AS p, count(*) OVER () AS total FROM r)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(p * 24 // total AS INT) AS shard,
  row_number() OVER (PARTITION BY p * 24 // total ORDER BY p) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM o"""

_CRC_TABLE = "SELECT list(list_reduce(range(0, 8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), n) ORDER BY n) AS t FROM range(256) r(n)"
_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAMS = "unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))"

OP12_SQL = f"""
WITH tbl AS ({_CRC_TABLE}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWER_WORDS} AS ws FROM documents),
df AS (SELECT rid, f, count(*) AS n FROM (SELECT rid, {_GRAMS} AS f FROM d) GROUP BY ALL),
bf AS (SELECT f, count(*) AS n FROM (SELECT {_GRAMS} AS f FROM (SELECT {_LOWER_WORDS} AS ws FROM benchmark)) GROUP BY ALL),
u AS (SELECT f, hex(encode(f)) AS x, octet_length(encode(f)) AS size FROM (SELECT f FROM df UNION SELECT f FROM bf)),
c AS (SELECT f, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, size), lambda i: CAST(('0x' || x[2 * i + 1:2 * i + 2]) AS BIGINT))),
  lambda a, v: xor(a >> 8, tbl.t[(xor(a, v) & 255) + 1]))) % 10000 AS bucket FROM u CROSS JOIN tbl),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN c USING (f) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM bf JOIN c USING (f) GROUP BY bucket),
g AS (SELECT k.bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM s) + 10000 AS DOUBLE))
  / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM range(10000) k(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT rid, sum(n) AS nf, sum(n * gain) AS weight FROM df JOIN c USING (f) JOIN g USING (bucket) GROUP BY rid),
p AS (SELECT rid, doc_id, len(ws) AS n_words, CAST(coalesce(nf, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS noise FROM d LEFT JOIN w USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features, n_words) AS r, count(*) OVER () AS n FROM p WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank, n_words FROM p LEFT JOIN r USING (rid)"""


def _op13_sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    def assigned(i):
        return f"""a{i} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT rid, c, d, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS r FROM
  (SELECT rid, c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.v[i] - m.v[i]) * (v.v[i] - m.v[i]))) AS d FROM v CROSS JOIN m{i} m)) WHERE r = 1)"""

    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = {dims})""",
             f"""m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT {k}))""", assigned(0)]
    for i in range(1, rounds + 1):
        parts += [f"""m{i} AS MATERIALIZED (SELECT m.c, coalesce(q.v, m.v) AS v FROM m{i - 1} m LEFT JOIN (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM
  (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS i FROM a{i - 1} JOIN v USING (rid)) GROUP BY c, i) GROUP BY c) q ON q.c = m.c)""", assigned(i)]
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (rid) JOIN m{rounds} m ON m.c = a.c"""


#: The others rest on detectors, training, sketches, tokenizers or packing that
#: SQL does not express; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op9_sharding": OP9_SQL, "op12_importance_resampling": OP12_SQL, "op13_centroid_clustering": _op13_sql()}
