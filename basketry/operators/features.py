"""Feature operators: row-wise derivations and data-dependent encodings.

Row-wise features are one projection (whole-stage codegen). Data-dependent
ones (quartile edges, top-k values, frequent-value sets, group statistics) are
fitted by one aggregate each, and the fitted result is proven small before it
is inlined as literals or broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, NumericType, StringType, StructField, StructType

from basketry.functions import constants as K
from basketry.functions.exprs import (climate_group, concat_text, cut, lookup, target_code,
                                      yes_flag)
from basketry.operators.lookup import LOOKUP_BOUND, checked_broadcast, lookup_join
from basketry.operators.quantiles import column_quantiles
from basketry.session import materialize

AMOUNT = "PURCHASE_AMOUNT_USD"


# --------------------------------------------------------------------------- row-wise
def encode_target(df: DataFrame, col: str = "SUBSCRIPTION_STATUS", out: str = "TEMP_TARGET") -> DataFrame:
    """Yes -> 1, No -> 0, other -> null; 0 when the label column is absent."""
    if col not in df.columns:
        return df.withColumn(out, F.lit(0))
    return df.withColumn(out, target_code(col))


def derive_spend(df: DataFrame, amount: str = AMOUNT) -> DataFrame:
    a, pp = F.col(amount), F.col("PREVIOUS_PURCHASES")
    return df.withColumns({
        "TOTAL_SPEND_WEIGHTED_NEW": pp * a,
        "SPEND_PER_PURCHASE_NEW": F.try_divide(a, pp + 1),
        "SPEND_RATING_NEW": a * F.col("REVIEW_RATING"),
    })


def map_frequency(df: DataFrame) -> DataFrame:
    return df.withColumn("FREQUENCY_VALUE_NEW",
                         lookup("FREQUENCY_OF_PURCHASES", K.FREQUENCY_PER_YEAR))


def map_payment_type(df: DataFrame) -> DataFrame:
    return df.withColumn("PAYMENT_TYPE_NEW", lookup("PAYMENT_METHOD", K.PAYMENT_TYPE))


def bin_age(df: DataFrame) -> DataFrame:
    return df.withColumn("AGE_NEW", cut("AGE", K.AGE_EDGES, K.AGE_LABELS))


def bin_loyalty(df: DataFrame) -> DataFrame:
    return df.withColumn("LOYALTY_LEVEL_NEW",
                         cut("PREVIOUS_PURCHASES", K.LOYALTY_EDGES, K.LOYALTY_LABELS,
                             include_lowest=True))


def flag_columns(df: DataFrame, target: str = "TEMP_TARGET") -> DataFrame:
    t = F.col(target)
    return df.withColumns({
        "PROMO_NO_SUB_NEW": F.coalesce((F.col("PROMO_CODE_USED") == "Yes") & (t == 0),
                                       F.lit(False)).cast("int"),
        "HIGH_REVIEW_RATING_NEW": F.coalesce(F.col("REVIEW_RATING") >= 4, F.lit(False)).cast("int"),
        "SUBSCRIPTION": yes_flag("SUBSCRIPTION_STATUS"),
        "PROMO_USED_VAL": yes_flag("PROMO_CODE_USED"),
    })


def concat_crosses(df: DataFrame, target: str = "TEMP_TARGET", variant: str = "a") -> DataFrame:
    cols = {
        "SUB_FREQ_NEW": concat_text(target, "FREQUENCY_OF_PURCHASES"),
        "SHIP_SUB_NEW": concat_text("SHIPPING_TYPE", target),
        "SEASON_CATEGORY_NEW": concat_text("SEASON", "CATEGORY"),
        "SEASON_COLOR_NEW": concat_text("SEASON", "COLOR"),
        "ITEM_CATEGORY_NEW": concat_text("CATEGORY", "ITEM_PURCHASED"),
    }
    if variant == "b":
        cols["CLIMATE_LOYALTY_NEW"] = concat_text("CLIMATE_GROUP_NEW", "LOYALTY_LEVEL_NEW")
    return df.withColumns(cols)


def add_climate_group(df: DataFrame, col: str = "LOCATION") -> DataFrame:
    return df.withColumn("CLIMATE_GROUP_NEW", climate_group(col))


def interaction_features(df: DataFrame) -> DataFrame:
    promo = yes_flag("PROMO_CODE_USED")
    return df.withColumns({
        "PROMO_X_LOYALTY": promo * F.col("LOYALTY_SCORE_NEW"),
        "PROMO_X_FREQ": promo * F.col("FREQUENCY_VALUE_NEW"),
    })


# --------------------------------------------------------------------------- data-dependent
def _checked_edges(edges, col: str) -> list[float]:
    if edges is None or any(e is None for e in edges):
        raise ValueError(f"no values in {col}")
    if len(set(edges)) != len(edges):
        raise ValueError(f"duplicate bin edges for {col}: {edges}")
    return list(edges)


def quantile_edges(df: DataFrame, cols: Sequence[str], q: int = 4, approx: bool = False) -> dict:
    """{column: edges of ``q`` equal-frequency bins (min, interior quantiles,
    max)}, all columns in one search."""
    got = column_quantiles(df, cols, [i / q for i in range(q + 1)], approx)
    return {c: _checked_edges(got[c], c) for c in cols}


def qcut(df: DataFrame, col: str, q: int, labels: Sequence, out: str,
         edges: Sequence[float] | None = None, approx: bool = False) -> DataFrame:
    """Equal-frequency bins, right-closed, lowest edge included (null -> null);
    with ``approx`` the inner edges are those of a sketch."""
    edges = list(edges) if edges is not None else quantile_edges(df, [col], q, approx)[col]
    return df.withColumn(out, cut(col, edges, labels, include_lowest=True))


def top_values(df: DataFrame, col: str, k: int) -> list:
    """The ``k`` most frequent non-null values (ties by value)."""
    rows = (df.where(F.col(col).isNotNull()).groupBy(col).count()
            .orderBy(F.desc("count"), F.asc(col)).limit(k).collect())
    return [r[col] for r in rows]


def topk_group(df: DataFrame, col: str = "LOCATION", k: int = K.TOP_LOCATIONS,
               out: str = "LOCATION_GROUPED_NEW", other: str = K.OTHER_LABEL,
               keep: Sequence | None = None) -> DataFrame:
    """Keep the k most frequent values, everything else (and null) -> ``other``.
    The kept list has at most k entries, so it is inlined as a literal set."""
    keep = list(keep) if keep is not None else top_values(df, col, k)
    c = F.col(col)
    return df.withColumn(out, F.when(c.isin(keep), c).otherwise(F.lit(other)))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def frequent_values(df: DataFrame, cols: Sequence[str], min_share: float) -> dict:
    """Per column, the values whose share of all rows (nulls included in the
    denominator) is at least ``min_share``. At most 1/min_share values per
    column can qualify, so the result is bounded whatever the cardinality.
    One pass for all columns: (column, value) pairs, partially aggregated."""
    n = df.count()
    if n == 0 or not cols:
        return {c: [] for c in cols}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols
    ])).alias("p")).where(F.col("p.v").isNotNull())
    counts = pairs.groupBy(F.col("p.c").alias("c"), F.col("p.v").alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    rows = counts.where(F.col("n") / F.lit(float(n)) >= F.lit(min_share)).collect()
    out = {c: [] for c in cols}
    for r in rows:
        out[r["c"]].append(r["v"])
    return out


def rare_encode(df: DataFrame, min_share: float = K.RARE_SHARE,
                cols: Sequence[str] | None = None, label: str = K.RARE_LABEL) -> DataFrame:
    """String values with share < ``min_share`` -> ``Rare``; nulls stay null."""
    cols = list(cols) if cols is not None else string_columns(df)
    keep = frequent_values(df, cols, min_share)
    repl = {}
    for c in cols:
        x = F.col(c)
        repl[c] = F.when(x.isNull(), x).when(x.isin(keep[c]), x).otherwise(F.lit(label))
    return df.withColumns(repl) if repl else df


def coerce_features(df: DataFrame) -> DataFrame:
    from basketry.sources.files import coerce_numeric
    return coerce_numeric(df, [AMOUNT, "PREVIOUS_PURCHASES", "AGE", "REVIEW_RATING"])


def clean_shoppers(df: DataFrame, min_share: float = K.RARE_SHARE, limit: float = K.ASSOCIATION_LIMIT) -> DataFrame:
    """The cleaning in front of the features, in order: numbers that came as
    text are read, rare values of every text column but identifiers -> ``Rare``
    (a rare state ends in climate ``Unknown``), then the discount column goes
    if it says the same as the promo column."""
    from basketry.operators.stats import drop_if_associated
    df = coerce_features(df)
    text = [c for c in string_columns(df) if c not in ("ROW_ID", "CUSTOMER_ID")]
    return drop_if_associated(rare_encode(df, min_share, text), limit=limit)[0]


def derive_features(df: DataFrame, variant: str = "a", amount_edges=None, loyalty_edges=None,
                    top_locations=None) -> DataFrame:
    """The full feature pipeline on a shop frame (one row per shopper)."""
    out = coerce_features(df)
    if amount_edges is None or loyalty_edges is None:
        qs = quantile_edges(out, [AMOUNT, "PREVIOUS_PURCHASES"])
        amount_edges = amount_edges or qs[AMOUNT]
        loyalty_edges = loyalty_edges or qs["PREVIOUS_PURCHASES"]
    out = encode_target(out)
    out = derive_spend(out)
    out = map_frequency(out)
    out = map_payment_type(out)
    out = bin_age(out)
    out = qcut(out, AMOUNT, 4, K.AMOUNT_QUARTILE_LABELS, AMOUNT + "_NEW", amount_edges)
    out = bin_loyalty(out)
    out = flag_columns(out)
    out = add_climate_group(out)
    out = concat_crosses(out, variant=variant)
    out = topk_group(out, keep=top_locations)
    if variant == "b":
        out = topk_group(out, out="TOP_LOCATION_NEW", keep=top_locations)
    out = qcut(out, "PREVIOUS_PURCHASES", 4, K.LOYALTY_SCORE_LABELS, "LOYALTY_SCORE_NEW", loyalty_edges)
    out = interaction_features(out)
    return out.drop("TEMP_TARGET")


# --------------------------------------------------------------------------- fitted lookups
def _pair_counts(train: DataFrame, group: str, cats: Sequence[str]) -> DataFrame:
    """(k, group, cat, n) of several category columns in one pass: rows are
    folded to (column, group, category) and counted."""
    items = [F.struct(F.lit(i).alias("k"), F.col(c).cast("string").alias("c")) for i, c in enumerate(cats)]
    long = (train.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.explode(F.array(*items)).alias("s"))
            .where(F.col("s.c").isNotNull()))
    return long.groupBy(F.col("s.k").alias("k"), "g", F.col("s.c").alias("c")).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class ConditionalProbs:
    """Smoothed P(cat | group): observed pairs, what an unseen pair of a seen
    group gets, and the seen categories. Three small tables instead of their
    product; each is broadcast where its checked size allows."""
    pairs: DataFrame   # g, c, prob
    groups: DataFrame  # g, unseen
    cats: DataFrame    # c


def fit_conditional_probs_many(train: DataFrame, group: str, cats: Sequence[str], smoothing: float = 1.0) -> dict:
    """{column: ConditionalProbs} of several category columns, all counted in
    one pass whose result is written once: P = (n_gc + s) / (n_g + s K)."""
    counts = materialize(_pair_counts(train, group, cats), "pair-counts")
    s_ = F.lit(float(smoothing))
    out = {}
    for i, c in enumerate(cats):
        mine = counts.where(F.col("k") == i).select("g", F.col("c").cast(train.schema[c].dataType).alias("c"), "n")
        size = mine.agg(F.count_distinct("c").alias("kk")).first()["kk"]
        groups = mine.groupBy("g").agg(F.sum("n").alias("n_g")).withColumn("_total", F.col("n_g") + s_ * size)
        pairs = mine.join(checked_broadcast(groups), "g").select("g", "c", ((F.col("n") + s_) / F.col("_total")).alias("prob"))
        out[c] = ConditionalProbs(checked_broadcast(pairs), checked_broadcast(groups.select("g", (s_ / F.col("_total")).alias("unseen"))),
                                  checked_broadcast(mine.select("c").distinct()))
    return out


def fit_conditional_probs(train: DataFrame, group: str, cat: str, smoothing: float = 1.0) -> DataFrame:
    """(group, cat, prob) for every seen group and every seen category, spelled
    out: the observed pairs, and for each group the categories it lacks."""
    fit = fit_group_probs(train, group, [cat], smoothing)
    if isinstance(fit, GroupProbs):
        return fit.table.select(group, F.explode("_p0").alias(cat, "prob")).withColumn(cat, F.col(cat).cast(train.schema[cat].dataType))
    fit = fit.fits[cat]  # the result is the product by definition, spread over the groups' tasks
    return (fit.groups.join(fit.cats).join(fit.pairs, ["g", "c"], "left")
            .select(F.col("g").alias(group), F.col("c").alias(cat), F.coalesce("prob", "unseen").alias("prob")))


def map_conditional_probs(df: DataFrame, fit, group: str, cat: str, out: str) -> DataFrame:
    """Attach P(cat | group); groups or categories never seen give null.
    ``fit`` is a ``ConditionalProbs`` or a (group, cat, prob) table."""
    if isinstance(fit, DataFrame):
        return lookup_join(df, fit.select(group, cat, F.col("prob").alias(out)), [group, cat])
    seen = (df.join(fit.pairs.select(F.col("g").alias(group), F.col("c").alias(cat), F.col("prob").alias("_p")), [group, cat], "left")
            .join(fit.groups.select(F.col("g").alias(group), F.col("unseen").alias("_u")), group, "left")
            .join(fit.cats.select(F.col("c").alias(cat), F.lit(True).alias("_seen")), cat, "left"))
    cols = [c for c in df.columns if c != out]
    return seen.select(*cols, F.coalesce("_p", F.when(F.col("_seen"), F.col("_u"))).alias(out))


def _prob_name(cat: str) -> str:
    return f"P_{cat}_given_CLIMATE_NEW"


@dataclass
class GroupProbs:
    """Smoothed P(cat | group) of several category columns, one row per group: a
    map from every seen category to its probability for each column. One lookup
    join attaches them all. ``means``: the mean over the training rows."""
    group: str
    cats: list
    table: DataFrame  # group, _p0, _p1, ...: map<string, double>
    means: list

    def attach(self, df: DataFrame, outs: Sequence[str]) -> DataFrame:
        """Unknown groups and categories give null."""
        looked = df.join(checked_broadcast(self.table), self.group, "left")
        cols = [F.try_element_at(F.col(f"_p{i}"), F.col(c).cast("string")).alias(o) for i, (c, o) in enumerate(zip(self.cats, outs))]
        return looked.select(*[c for c in df.columns if c not in outs], *cols)


@dataclass
class PairProbs:
    """The same for tables beyond the bound of a lookup: each column's pairs,
    groups and categories stay tables of their own, joined one by one."""
    group: str
    cats: list
    fits: dict
    means: list

    def attach(self, df: DataFrame, outs: Sequence[str]) -> DataFrame:
        for c, o in zip(self.cats, outs):
            df = map_conditional_probs(df, self.fits[c], self.group, c, o)
        return df


def fit_group_probs(train: DataFrame, group: str, cats: Sequence[str], smoothing: float = 1.0, bound: int = LOOKUP_BOUND):
    """P = (n_gc + s) / (n_g + s K) of several category columns, counted in one
    pass: ``GroupProbs`` where groups x categories are at most ``bound``,
    ``PairProbs`` beyond it."""
    counts = materialize(_pair_counts(train, group, cats), "pair-counts")
    size = {r["k"]: (r["g"], r["c"]) for r in counts.groupBy("k").agg(F.count_distinct("g").alias("g"), F.count_distinct("c").alias("c")).collect()}  # one row per column
    if sum(g * c for g, c in size.values()) > bound:
        fits = fit_conditional_probs_many(train, group, list(cats), smoothing)
        means = []
        for i, c in enumerate(cats):
            mine = counts.where(F.col("k") == i).select("g", F.col("c").cast(train.schema[c].dataType).alias("c"), "n").join(fits[c].pairs, ["g", "c"])
            means.append(mine.agg(F.sum(F.col("n") * F.col("prob")) / F.sum("n")).first()[0])
        return PairProbs(group, list(cats), fits, means)
    rows = counts.collect()  # at most ``bound``
    seen = [sorted({r["c"] for r in rows if r["k"] == i}) for i in range(len(cats))]
    n = {(r["k"], r["g"], r["c"]): r["n"] for r in rows}
    groups, table, means = sorted({r["g"] for r in rows}), [], []
    for g in groups:
        maps = []
        for i, known in enumerate(seen):
            n_g = sum(n.get((i, g, c), 0) for c in known)
            maps.append({c: (n.get((i, g, c), 0) + smoothing) / (n_g + smoothing * len(known)) for c in known} if n_g else None)
        table.append((g, *maps))
    for i in range(len(cats)):
        mine = [(k, v) for k, v in n.items() if k[0] == i]
        probs = {g: maps[i] for g, *maps in table}
        means.append(sum(v * probs[g][c] for (_, g, c), v in mine) / sum(v for _, v in mine) if mine else None)
    schema = StructType([train.schema[group], *[StructField(f"_p{i}", MapType(StringType(), DoubleType())) for i in range(len(cats))]])
    return GroupProbs(group, list(cats), checked_broadcast(train.sparkSession.createDataFrame(table, schema)), means)


FIT_SCORE = "CLIMATE_ITEM_FIT_SCORE_NEW"


def attach_probs(df: DataFrame, fit, fill: Column | None = None) -> DataFrame:
    """``df`` with every P(cat | group) and the fit score, their product. Rows
    where ``fill`` holds take the training mean for a missing one."""
    outs = [_prob_name(c) for c in fit.cats]
    out = fit.attach(df, outs)
    if fill is not None:
        out = out.withColumns({o: F.when(fill, F.coalesce(F.col(o), F.lit(m))).otherwise(F.col(o)) for o, m in zip(outs, fit.means)})
    score = F.col(outs[0])
    for o in outs[1:]:
        score = score * F.col(o)
    return out.withColumn(FIT_SCORE, score)


def conditional_prob_features(train: DataFrame, test: DataFrame | None = None,
                              group: str = "CLIMATE_GROUP_NEW",
                              cats: Sequence[str] = ("CATEGORY", "SIZE", "SEASON"),
                              smoothing: float = 1.0):
    """P_<cat>_given_CLIMATE_NEW for each cat and the fit score (product).
    Probabilities are fitted on ``train``; test nulls take the train mean."""
    fit = fit_group_probs(train, group, cats, smoothing)
    return attach_probs(train, fit), None if test is None else attach_probs(test, fit, F.lit(True))


# --------------------------------------------------------------------------- group means
def group_means(df: DataFrame, group: str, value: str, out: str = "_mean") -> DataFrame:
    return df.groupBy(group).agg(F.avg(F.col(value).cast("double")).alias(out))


def group_mean_ratio(train: DataFrame, test: DataFrame | None, group: str, value: str, out: str,
                     fallback: str = "global_mean"):
    """ratio = value / mean(value | group) with means fitted on ``train``.
    Test rows of unseen (or null) groups: value / global train mean, or the
    mean train ratio when ``fallback`` is not ``global_mean``."""
    means = checked_broadcast(group_means(train, group, value, "_gm"))  # fitted once, reused
    v = F.col(value).cast("double")
    train_out = train.join(means, [group], "left").withColumn(out, F.try_divide(v, F.col("_gm"))).drop("_gm")
    if test is None:
        return train_out, None
    test_out = test.join(means, [group], "left").withColumn(out, F.try_divide(v, F.col("_gm"))).drop("_gm")
    if fallback == "global_mean":
        gm = train.agg(F.avg(v)).first()[0]
        fill = v / F.lit(gm)
    else:
        fill = F.lit(train_out.agg(F.avg(out)).first()[0])
    return train_out, test_out.withColumn(out, F.coalesce(F.col(out), fill))


def group_transform_mean(df: DataFrame, group: str, value: str, out: str,
                         ratio: str | None = None) -> DataFrame:
    """Per-group mean on every row (and optionally value / mean).

    Written as aggregate + lookup join rather than a window: a window over a
    low-cardinality key would put the whole table in a handful of tasks."""
    means = group_means(df, group, value, out)
    res = lookup_join(df, means, [group])
    if ratio:
        res = res.withColumn(ratio, F.try_divide(F.col(value), F.col(out)))
    return res


# --------------------------------------------------------------------------- column housekeeping
def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def drop_leakage(df: DataFrame, names: Sequence[str] = K.LEAKAGE_COLUMNS,
                 mode: str = "prefix") -> DataFrame:
    """Drop columns starting with (``prefix``) or containing (``substring``) a name."""
    if mode == "prefix":
        hit = [c for c in df.columns if any(c.startswith(n) for n in names)]
    else:
        hit = [c for c in df.columns if any(n in c for n in names)]
    return df.drop(*hit)


def fill_missing(df: DataFrame, value=None, cols: Sequence[str] | None = None,
                 means_from: DataFrame | None = None) -> DataFrame:
    """Constant fill, or fill with column means fitted on ``means_from``."""
    cols = list(cols) if cols is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if means_from is not None:
        row = means_from.agg(*[F.avg(c).alias(c) for c in cols]).first()
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(row[c])) for c in cols})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in cols})


def relabel(df: DataFrame, col: str, mapping: dict, out: str, default=None) -> DataFrame:
    expr = lookup(col, mapping)
    if default is not None:
        expr = F.coalesce(expr, F.lit(default))
    return df.withColumn(out, expr)


def align_schema(df: DataFrame, columns: Sequence[str], fill=0) -> DataFrame:
    """Exactly ``columns`` in order; absent ones are the constant ``fill``."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in columns])


def fit_group_means(train: DataFrame, specs: Sequence[tuple[str, str]]) -> list:
    """Means of several (group, value) pairs in one pass: [(per-group table
    (group, _gm), broadcast where its checked size allows, global mean)] in spec
    order. Rows of all specs are folded into (spec, group value, value) and
    aggregated with grouping sets (per group and per spec); the result is
    written once."""
    items = [F.struct(F.lit(i).alias("k"), F.col(g).cast("string").alias("gv"),
                      F.col(v).cast("double").alias("x")) for i, (g, v) in enumerate(specs)]
    long = train.select(F.explode(F.array(*items)).alias("s")).select("s.*")
    agg = (long.rollup("k", "gv").agg(F.avg("x").alias("m"), F.grouping_id().alias("gid"))
           .where(F.col("k").isNotNull()))
    agg = materialize(agg, "group-means")
    glob = {r["k"]: r["m"] for r in agg.where("gid = 1").collect()}  # one row per spec
    dtypes = dict(train.dtypes)
    return [(checked_broadcast(agg.where((F.col("k") == i) & (F.col("gid") == 0) & F.col("gv").isNotNull())
                               .select(F.col("gv").cast(dtypes[g]).alias(g), F.col("m").alias("_gm"))), glob.get(i))
            for i, (g, _v) in enumerate(specs)]


@dataclass
class GroupMeans:
    """Fitted means of several (group, value, name) specs: one table per group
    column with every mean that column needs, and the overall means."""
    specs: list
    tables: dict   # group column -> (group column, _m<spec>, ...)
    overall: list

    def attach(self, df: DataFrame, fill: Column | None = None) -> DataFrame:
        """value / group mean of every spec, one join per group column; where
        ``fill`` holds, a row without one takes value / overall mean."""
        names = [o for _, _, o in self.specs]
        out = df
        for g, table in self.tables.items():
            out = out.join(checked_broadcast(table), g, "left")
        cols = []
        for i, (g, v, o) in enumerate(self.specs):
            x = F.col(v).cast("double")
            ratio = F.try_divide(x, F.col(f"_m{i}"))
            if fill is not None:
                ratio = F.coalesce(ratio, F.when(fill, F.try_divide(x, F.lit(self.overall[i]))))
            cols.append(ratio.alias(o))
        return out.select(*[c for c in df.columns if c not in names], *cols)


def fit_group_mean_tables(train: DataFrame, specs: Sequence[tuple[str, str, str]]) -> GroupMeans:
    """All specs fitted in one pass over ``train``."""
    fitted = fit_group_means(train, [(g, v) for g, v, _ in specs])
    tables = {}
    for i, ((g, _, _), (table, _)) in enumerate(zip(specs, fitted)):
        mine = table.withColumnRenamed("_gm", f"_m{i}")
        tables[g] = mine if g not in tables else tables[g].join(mine, g, "full")
    return GroupMeans([tuple(x) for x in specs], {g: checked_broadcast(t) for g, t in tables.items()}, [gm for _, gm in fitted])


def group_mean_ratios(train: DataFrame, test: DataFrame | None, specs: Sequence[tuple[str, str, str]]):
    """Several ``group_mean_ratio`` columns (global-mean fallback on test)
    fitted together in one pass over ``train``."""
    fit = fit_group_mean_tables(train, specs)
    return fit.attach(train), None if test is None else fit.attach(test, F.lit(True))
