"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Every rule compares one measure of a text with a cutoff. Cutoffs are chosen
from labelled documents: for each stratum and rule a fixed sequence of cutoffs,
lenient to strict, is tested against H0 "more than ``alpha`` of the good
documents are rejected" by the exact binomial tail P(X <= rejected | n, alpha).
Testing stops at the first cutoff that is not certified, so one sequence spends
one level; the level ``delta`` is divided by the number of sequences (strata x
rules, Bonferroni). With probability 1 - delta every chosen cutoff falsely
rejects at most ``alpha`` of the good documents of its stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: measure (an expression over the base columns), and its cutoffs from lenient
#: to strict; a document is rejected above its cutoff.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbol_share": ("n_symbols / n_words", [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]),
    "repeat_share": ("n_repeat_words / n_words", [0.48, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "dup_lines_share": ("n_dup_lines / n_words", [0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02]),
    "long_words": ("word_chars / n_words", [30.0, 20.0, 16.0, 14.0, 12.0, 10.0, 9.0, 8.0]),
    "short_words": ("-1.0 * word_chars / n_words", [-1.5, -2.0, -2.5, -3.0, -3.5, -4.0, -4.5, -5.0]),
}

# Words of 3-word windows that occur twice: every window's hash and start share
# one long (hash bits above ``b`` position bits), so a primitive sort brings
# equal windows together. Neighbours of one hash are compared word by word; if
# all agree, the runs are exact. Should any differ, the windows are sorted as
# text instead.
_PACKED = """
transform(array(struct(ws, cast(ceil(log2(size(ws) + 1)) as int) as b)), s ->
  transform(array(sort_array(transform(sequence(0, size(s.ws) - 3),
      i -> shiftleft(xxhash64(s.ws[i], s.ws[i + 1], s.ws[i + 2]), s.b) | i))), v ->
    struct(s.ws as ws, s.b as b, v as v,
      filter(sequence(1, size(v) - 1), i -> shiftrightunsigned(v[i] ^ v[i - 1], s.b) = 0) as eq)
  )[0])[0]
"""
_TEXT_PAIRS = """
transform(array(sort_array(transform(sequence(0, size(p.ws) - 3),
    i -> concat(p.ws[i], ' ', p.ws[i + 1], ' ', p.ws[i + 2], '\\t', i)))), t ->
  flatten(transform(filter(sequence(1, size(t) - 1),
      j -> substring_index(t[j], '\\t', 1) = substring_index(t[j - 1], '\\t', 1)),
    j -> array(cast(substring_index(t[j], '\\t', -1) as bigint), cast(substring_index(t[j - 1], '\\t', -1) as bigint)))))[0]
"""
_POSITIONS = f"""
transform(array({_PACKED}), p -> case
  when size(p.eq) = 0 then array()
  when forall(p.eq, i ->
      p.ws[cast(p.v[i] & (shiftleft(1L, p.b) - 1) as int)] = p.ws[cast(p.v[i - 1] & (shiftleft(1L, p.b) - 1) as int)]
      and p.ws[cast((p.v[i] & (shiftleft(1L, p.b) - 1)) + 1 as int)] = p.ws[cast((p.v[i - 1] & (shiftleft(1L, p.b) - 1)) + 1 as int)]
      and p.ws[cast((p.v[i] & (shiftleft(1L, p.b) - 1)) + 2 as int)] = p.ws[cast((p.v[i - 1] & (shiftleft(1L, p.b) - 1)) + 2 as int)])
  then flatten(transform(p.eq, i -> array(p.v[i - 1] & (shiftleft(1L, p.b) - 1), p.v[i] & (shiftleft(1L, p.b) - 1))))
  else {_TEXT_PAIRS} end)[0]
"""
_COVERED = f"""
case when size(ws) < 4 then 0L else
  transform(array(sort_array(array_distinct({_POSITIONS}))), p -> if(size(p) = 0, 0L,
    aggregate(sequence(1, size(p)), 0L, (a, i) -> a + case when i = size(p) then 3L when p[i] - p[i - 1] < 3 then p[i] - p[i - 1] else 3L end)))[0]
end
"""
_REPEATS = f"transform(array(array_remove(split(_t, r'{SPACE}', -1), '')), ws -> struct(cast(size(ws) as bigint) as n_words, {_COVERED} as n_repeat_words))[0]"


def measures(text: Column) -> list[Column]:
    """The base measures of a text column named ``_t`` (not null)."""
    bare = F.translate(F.col("_t"), " \t\n\x0b\f\r", "")
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    return [F.length(bare).cast("long").alias("word_chars"), (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a)))[0].cast("long").alias("n_dup_lines")]


def measured(docs: DataFrame, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed of every text (null: no words)."""
    keep = keep or {}
    base = docs.select(*[c.alias(k) for k, c in keep.items()], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    full = base.select(*keep, *measures(F.col("_t")), F.expr(_REPEATS).alias("_w"))
    n, rep = F.col("_w.n_words"), F.col("_w.n_repeat_words")
    return full.select(*keep, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", rep.alias("n_repeat_words"),
                       ((n < 50) | (100 * rep > 50 * n)).alias("base_failed"))


def log_factorial(x: str) -> str:
    """SQL for ln(x!) of a non-negative whole x: Stirling's series at x + 10,
    taken back by the product of the ten factors (error below 1e-13)."""
    z = f"({x} + 10D)"
    back = " + ".join(f"ln({x} + {i}D)" for i in range(1, 11))
    return f"({z} * ln({z}) - {z} + 0.5D * ln(2 * pi() * {z}) + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - ({back}))"


def binomial_tail(k: str, n: str, alpha: float) -> Column:
    """Exact P(X <= k) for X ~ Bin(n, alpha), for k < n * alpha, else 1 (nothing
    can be certified there). The sum runs down from k; terms beyond 40 standard
    deviations are below the resolution of a double."""
    pmf = f"exp({log_factorial(n)} - {log_factorial(k)} - {log_factorial(f'({n} - {k})')} + {k} * ln({alpha}D) + ({n} - {k}) * log1p(-{alpha}D))"
    ratio = f"(cast(i as double) * {1 - alpha!r}D / (({n} - i + 1) * {alpha}D))"
    terms = f"aggregate(sequence({k}, greatest({k} - cast(100 + 40 * sqrt({n}) as bigint), 0L), -1L), struct(1D as t, 0D as s), (a, i) -> struct(a.t * {ratio} as t, a.s + a.t as s), a -> a.s)"
    return F.expr(f"case when {k} < {n} * {alpha}D then least({pmf} * {terms}, 1D) else 1D end")


def choose_cutoffs(labelled: DataFrame, good: Column, stratum: str, alpha: float = 0.01, delta: float = 0.1, rules: dict = RULES) -> DataFrame:
    """One row per stratum of ``labelled`` (measured documents): the stratum,
    n_good and a cutoff per rule (null where none is certified)."""
    ok = labelled.filter(good & ~F.col("base_failed"))
    aggs = [F.count(F.lit(1)).alias("n_good")]
    for name, (expr, grid) in rules.items():
        for j, c in enumerate(grid):
            aggs.append(F.sum(F.when(F.expr(expr) > F.lit(float(c)), 1).otherwise(0)).cast("long").alias(f"{name}_{j}"))
    counts = ok.groupBy(stratum).agg(*aggs)
    rows = ", ".join(f"named_struct('rule', '{name}', 'j', {j}, 'cutoff', {float(c)!r}D, 'k', {name}_{j})" for name, (_, grid) in rules.items() for j, c in enumerate(grid))
    tests = counts.select(stratum, "n_good", F.expr(f"inline(array({rows}))")).withColumn("p", binomial_tail("k", "n_good", alpha))
    level = counts.agg((F.lit(delta) / (F.count(F.lit(1)) * len(rules))).alias("level"))
    failed = (tests.join(level, how="inner").groupBy(stratum, "n_good", "rule")
              .agg(F.sort_array(F.collect_list(F.struct("j", "cutoff", (F.col("p") <= F.col("level")).alias("ok")))).alias("seq")))
    upto = F.expr("aggregate(seq, named_struct('c', cast(null as double), 'open', true), (a, x) -> named_struct('c', if(a.open and x.ok, x.cutoff, a.c), 'open', a.open and x.ok), a -> a.c)")
    return failed.withColumn("c", upto).groupBy(stratum, "n_good").pivot("rule", sorted(rules)).agg(F.first("c"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.1, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang", label_col: str = "quality", rules: dict = RULES, max_strata: int = 10_000) -> DataFrame:
    """Base measures and the verdict of the certified rules for every row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, failed_rules. ``kept`` is false for base failures and for
    documents above a certified cutoff of their stratum. A null text has no
    words (base failure). A null stratum is a stratum of its own. Without
    labels, or with too few to certify anything, only base failures go. An id
    labelled several times counts as good if its smallest label is 1; rows that
    repeat an id are measured and judged one by one, as holdouts too. Labels
    with a null id or null label are ignored. The table of cutoffs is broadcast
    only if it holds at most ``max_strata`` strata.
    """
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit(""))
    all_rows = materialize(measured(docs, text_col, {"doc_id": F.col(id_col), "_s": stratum}), "measures")
    truth = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).filter("_id is not null and _y is not null")
             .groupBy("_id").agg(F.min("_y").alias("_y")))
    chosen = choose_cutoffs(all_rows.join(truth, all_rows["doc_id"] == truth["_id"]), F.col("_y") == 1, "_s", alpha, delta, rules)
    few = chosen.limit(max_strata + 1).collect()
    cut = F.broadcast(docs.sparkSession.createDataFrame(few, chosen.schema)) if len(few) <= max_strata else chosen
    over = F.array_compact(F.array(*[F.when(F.col(r).isNotNull() & F.expr(f"n_words > 0 and {rules[r][0]} > {r}"), F.lit(r)) for r in sorted(rules)]))
    return (all_rows.join(cut, "_s", "left").withColumn("failed_rules", F.concat_ws(",", over))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules"))
