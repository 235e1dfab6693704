"""Encoders fitted on one frame and applied to others.

One-hot encoding has two forms. The sparse one keeps the vocabulary as an
indexed table that is joined to the rows and gives sparse vectors: no column per
value, no list of values on the driver. The wide one (a 0/1 column per value) is
for vocabularies short enough to be a frame's schema. Scalers are a handful of
moments inlined as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from basketry.operators.lookup import LOOKUP_BOUND, bounded_rows, checked_broadcast
from basketry.operators.ranking import row_number_in_group
from basketry.session import materialize

#: Most columns a wide one-hot frame may get.
WIDE_BOUND = 20_000


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def _pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The distinct (c, v): column name and non-null value, in one pass."""
    return (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("p"))
            .where(F.col("p.v").isNotNull()).select("p.c", "p.v").distinct())


def fit_vocabulary(df: DataFrame, cols: Sequence[str]) -> dict:
    """{column: sorted distinct non-null values} for the wide form, one pass for
    all columns; more values than a schema should have are an error."""
    if not cols:
        return {}
    rows = bounded_rows(_pairs(df, cols), WIDE_BOUND)
    if rows is None:
        raise ValueError(f"more than {WIDE_BOUND} one-hot columns: use fit_vocabulary_table and the sparse form")
    vocab = {c: [] for c in cols}
    for r in rows:
        vocab[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in vocab.items()}


def fit_vocabulary_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(c, v, idx): every distinct non-null value of each column with its
    position in (column, value) order from 0, as a table of any length."""
    pairs = materialize(_pairs(df, cols), "vocabulary") if cols else df.sparkSession.createDataFrame([], "c string, v string")
    if pairs.limit(LOOKUP_BOUND + 1).count() <= LOOKUP_BOUND:  # short: one task numbers it
        numbered = pairs.withColumn("idx", F.row_number().over(Window.orderBy("c", "v")) - 1)
    else:
        numbered = row_number_in_group(pairs.withColumn("_all", F.lit(0)), ["_all"], ["c", "v"], "idx").withColumn("idx", F.col("idx") - 1)
    return materialize(numbered.select("c", "v", F.col("idx").cast("int").alias("idx")), "vocabulary-index")


def indexed(df: DataFrame, vocab: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """``df`` and ``_hot``: per row the (idx, c, v) of its values that are in the
    vocabulary, by idx; null and unseen values have none. A vocabulary within
    the lookup bound is broadcast, a join per column and no shuffle; a longer
    one is joined once to the folded (column, value) pairs of all rows, which
    ``key`` identifies."""
    small = checked_broadcast(vocab)
    if getattr(small, "_is_small", False):
        out = df
        for i, c in enumerate(cols):
            one = F.broadcast(small.where(F.col("c") == c).select(F.col("v").alias(f"_v{i}"), F.col("idx").alias(f"_i{i}")))
            out = out.join(one, F.col(c).cast("string") == F.col(f"_v{i}"), "left")
        hits = [F.when(F.col(f"_i{i}").isNotNull(), F.struct(F.col(f"_i{i}").alias("idx"), F.lit(c).alias("c"), F.col(f"_v{i}").alias("v"))) for i, c in enumerate(cols)]
        hot = F.array_sort(F.filter(F.array(*hits), lambda x: x.isNotNull())) if hits else F.array().cast("array<struct<idx:int,c:string,v:string>>")
        return out.select(*df.columns, hot.alias("_hot"))
    folded = df.select(F.col(key).alias("_k"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("p")).select("_k", "p.c", "p.v")
    found = folded.join(vocab, ["c", "v"]).groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("idx", "c", "v"))).alias("_found"))
    empty = F.array().cast("array<struct<idx:int,c:string,v:string>>")
    return df.join(found, df[key] == found["_k"], "left").select(*[df[c] for c in df.columns], F.coalesce("_found", empty).alias("_hot"))


def sparse_vectors(hot: DataFrame, numeric: Sequence[str], size: int, keep: Sequence[str], path: str) -> DataFrame:
    """keep + ``features``, written to ``path``: a sparse vector of the numeric
    columns (missing: 0) followed by the indicators of an ``indexed`` frame."""
    m = len(numeric)
    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric]) if m else F.array().cast("array<double>")
    indices = F.concat(F.array(*[F.lit(i) for i in range(m)]) if m else F.array().cast("array<int>"), F.transform("_hot", lambda x: x["idx"] + m))
    values = F.concat(numbers, F.transform("_hot", lambda x: F.lit(1.0)))
    vec = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(m + size).alias("size"), indices.alias("indices"), values.alias("values"))
    hot.select(*keep, vec.alias("features")).write.parquet(path)
    return read_sparse(hot.sparkSession, path)


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """The stored form of ``sparse_vectors``, read back as vectors."""
    stored = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in stored])).parquet(path)


def hot_names(hot: DataFrame, keep: Sequence[str], sep: str = "_") -> DataFrame:
    """(keep..., onehot): the name of every indicator that is set."""
    return hot.select(*keep, F.explode("_hot").alias("_h")).select(*keep, F.concat("_h.c", F.lit(sep), "_h.v").alias("onehot"))


def sql_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_hot_apply(df: DataFrame, vocab: dict, sep: str = "_") -> DataFrame:
    """Replace each vocabulary column by 0/1 ``col_value`` columns; null and
    values outside the vocabulary give all zeros. (Hundreds of indicator
    expressions are passed as SQL text: one parse instead of many calls.)"""
    keep = [sql_ident(c) for c in df.columns if c not in vocab]
    ind = [f"CAST(coalesce(CAST({sql_ident(c)} AS STRING) = {sql_str(v)}, false) AS INT) AS {sql_ident(c + sep + v)}"
           for c, vals in vocab.items() for v in vals]
    return df.selectExpr(*keep, *ind)


def drop_for_model(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def label_encode_with(df: DataFrame, larger: dict) -> DataFrame:
    """Two-valued text columns -> 1 for the larger value, 0 for the other (a
    column of one value, given as None, is 0)."""
    return df.withColumns({c: (F.col(c) == F.lit(v)).cast("int") if v is not None else F.when(F.col(c).isNotNull(), 0) for c, v in larger.items()}) if larger else df


def encode_train_test(train: DataFrame, test: DataFrame | None, drop_cols: Sequence[str],
                      keep: Sequence[str] = ()):
    """Drop ``drop_cols``; one-hot every string column with the train
    vocabulary (no level dropped); the test frame gets exactly the train
    columns. ``keep`` columns (keys) pass through un-encoded."""
    tr = train.drop(*[c for c in drop_cols if c in train.columns])
    cats = categorical_columns(tr, exclude=keep)
    vocab = fit_vocabulary(tr, cats)
    tr_enc = one_hot_apply(tr, vocab)
    if test is None:
        return tr_enc, None, vocab
    te = test.drop(*[c for c in drop_cols if c in test.columns])
    te_enc = one_hot_apply(te, vocab)
    have = set(te_enc.columns)
    te_enc = te_enc.select(*[F.col(c) if c in have else F.lit(0).alias(c) for c in tr_enc.columns])
    return tr_enc, te_enc, vocab


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Two-valued text columns -> 0/1 in alphabetical order of the values."""
    vocab = fit_vocabulary(df, cols)
    wide = [c for c, v in vocab.items() if len(v) > 2]
    if wide:
        raise ValueError(f"more than two values in {wide}")
    repl = {}
    for c, vals in vocab.items():
        expr = None
        for i, v in enumerate(vals):
            cond = F.col(c) == F.lit(v)
            expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
        repl[c] = expr if expr is not None else F.lit(None).cast("int")
    return df.withColumns(repl)


def split_by_cardinality(df: DataFrame, cols: Sequence[str]):
    """(binary columns, multi-value columns) by non-null distinct count."""
    from basketry.operators.stats import distinct_count
    counts = {r["feature"]: r["n_distinct"] for r in distinct_count(df, cols).collect()}
    return ([c for c in cols if counts.get(c, 0) <= 2], [c for c in cols if counts.get(c, 0) > 2])


def one_hot_full(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Binary text columns label-encoded, multi-value ones one-hot (whole frame)."""
    binary, multi = split_by_cardinality(df, cols)
    out = label_encode(df, binary) if binary else df
    return one_hot_apply(out, fit_vocabulary(out, multi)) if multi else out


def fit_standardizer(train: DataFrame, cols: Sequence[str], ddof: int = 0) -> dict:
    """{col: (mean, scale)}; scale is the std (ddof 0 by default), 1 when 0."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[sd(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        s = row[f"s{i}"]
        out[c] = (row[f"m{i}"], 1.0 if (s is None or s == 0) else s)
    return out


def standardize_apply(df: DataFrame, scaler: dict, suffix: str = "") -> DataFrame:
    return df.withColumns({c + suffix: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                           for c, (m, s) in scaler.items()})


def standardize(train: DataFrame, test: DataFrame | None, cols: Sequence[str], ddof: int = 0):
    scaler = fit_standardizer(train, cols, ddof)
    return (standardize_apply(train, scaler),
            None if test is None else standardize_apply(test, scaler), scaler)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = n_total / (n_classes * n_label)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).first()
    return c.withColumn("weight", F.lit(float(tot["t"])) / (F.lit(tot["k"]) * F.col("n")))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Per-row balanced weight column (for ``weightCol``); the weight table has
    one row per class and is inlined as literals."""
    w = {r[label]: r["weight"] for r in class_weights(df, label).collect()}
    expr = None
    for k, v in w.items():
        cond = F.col(label).isNull() if k is None else (F.col(label) == F.lit(k))
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return df.withColumn(out, expr)
