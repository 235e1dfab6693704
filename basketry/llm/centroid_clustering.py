"""Centroid clustering of integer vectors by a bounded nearest-centroid search.

Every vector remembers its nearest and second-nearest centroid with an upper
bound of the distance to the first and a lower bound of the distance to all
others. When the centroids move, the bounds move with them; a vector whose
bounds still part the two is not looked at. Otherwise the search starts from
the closer of the two remembered centroids, walks that one's neighbours by
their distance from it and stops where the next neighbour lies outside the
ball that the two best distances so far allow, a ball that shrinks with every
better centroid. Survivors are compared by exact integer squares, so ties go to
the smaller number whatever the bounds' rounding.

A round is one pass over the table of vectors: it assigns, and sends one exact
partial sum per task and centroid. Between rounds the table is written to the
shared folder; the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketry.llm.common import materialize

#: Largest component: squares of differences of 2^9 such components fit 64 bits.
LARGEST = 1 << 26
#: Relative slack of the floating-point bounds.
SLACK = 1e-9


def quantised(vectors: DataFrame, vector_col: str, dims: int, factor: int) -> Column:
    """floor(factor * x) of every component as an array of longs; null where the
    vector is null, has not exactly ``dims`` components or a null or non-finite
    one."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    good = v.isNotNull() & (F.size(v) == dims) & ~bad
    return F.when(good, F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(factor)))))


class Centroids:
    """The k centroids of a round, each one's neighbours by distance, and how
    far each moved since the round before."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points = points
        k = len(points)
        gap = np.sqrt(squares(points[:, None, :], points[None, :, :]).astype(np.float64)) if k else np.zeros((0, 0))
        self.order = np.argsort(gap, axis=1, kind="stable")  # the first is the centroid itself or an equal one
        for c in range(k):
            self.order[c] = np.concatenate(([c], self.order[c][self.order[c] != c]))
        self.gap = np.take_along_axis(gap, self.order, axis=1)
        self.moved = np.zeros(k) if before is None else np.sqrt(squares(points, before).astype(np.float64))

    def farthest_other(self) -> np.ndarray:
        """For each centroid, how far any of the others moved at most."""
        k = len(self.moved)
        return np.array([np.delete(self.moved, c).max(initial=0.0) for c in range(k)])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def search(x: np.ndarray, cen: Centroids, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """New (near, second, upper, lower, rows searched) of the vectors ``x``."""
    k = len(cen.points)
    near, second = near.copy(), second.copy()
    upper = (upper + cen.moved[near]) * (1 + SLACK)
    lower = np.maximum(lower - cen.farthest_other()[near], 0.0) * (1 - SLACK)
    open_ = np.flatnonzero(~(upper < lower)) if k > 1 else np.zeros(0, np.int64)
    if len(open_):  # the exact distance to the first may be enough
        upper[open_] = np.sqrt(squares(x[open_], cen.points[near[open_]]).astype(np.float64))
        open_ = open_[~(upper[open_] * (1 + SLACK) < lower[open_])]
    if len(open_):
        v, a, b = x[open_], near[open_], second[open_]
        da, db = squares(v, cen.points[a]), squares(v, cen.points[b])
        swap = (db < da) | ((db == da) & (b < a))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        da, db = np.where(swap, db, da), np.where(swap, da, db)
        # neighbours of the closer one, by distance from it
        base, first = a.copy(), da.copy()
        live = np.arange(len(open_))
        for j in range(1, k):
            # c can be nearer than the second only if |base c| <= |x base| + |x second|
            ball = (np.sqrt(first[live].astype(np.float64)) + np.sqrt(db[live].astype(np.float64))) * (1 + SLACK)
            live = live[cen.gap[base[live], j] <= ball]
            if not len(live):
                break
            c = cen.order[base[live], j]
            known = (c == a[live]) | (c == b[live])
            rows, c = live[~known], c[~known]
            if not len(rows):
                continue
            d = squares(v[rows], cen.points[c])
            best = (d < da[rows]) | ((d == da[rows]) & (c < a[rows]))
            better = ~best & ((d < db[rows]) | ((d == db[rows]) & (c < b[rows])))
            r = rows[best]
            b[r], db[r] = a[r], da[r]
            a[r], da[r] = c[best], d[best]
            r = rows[better]
            b[r], db[r] = c[better], d[better]
        near[open_], second[open_] = a, b
        upper[open_], lower[open_] = np.sqrt(da.astype(np.float64)), np.sqrt(db.astype(np.float64))
    return near, second, upper, lower, len(open_)


_STATE = "near int, second int, upper double, lower double"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _assign(state: DataFrame, cen: Centroids, dims: int) -> DataFrame:
    names = state.columns

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("_v"), dims)
            old = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("near", "second", "upper", "lower")]
            new = dict(zip(("near", "second", "upper", "lower"), search(x, cen, *old)[:4]))
            kinds = {"near": pa.int32(), "second": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(new[c], kinds.get(c, pa.float64())) if c in new else batch.column(c) for c in names], names)

    return state.mapInArrow(run, state.schema)


def _moved(state: DataFrame, points: np.ndarray, dims: int) -> np.ndarray:
    """The componentwise floor(sum / count) of each centroid's vectors; an empty
    centroid stays. Sums are exact: 64 bits within a batch, decimals across."""
    k = len(points)

    def sums(batches):
        for batch in batches:
            x, near = _matrix(batch.column("_v"), dims), batch.column("near").to_numpy(zero_copy_only=False)
            for c in np.unique(near):
                mine = x[near == c]
                yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int32()), pa.array([len(mine)], pa.int64()), pa.array([mine.sum(axis=0)], pa.list_(pa.int64()))], ["c", "n", "s"])

    rows = (state.select("_v", "near").mapInArrow(sums, "c int, n long, s array<long>").select("c", "n", F.posexplode("s").alias("i", "s"))
            .groupBy("c", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())  # k x dims
    out = points.copy()
    for r in rows:
        out[r["c"], r["i"]] = int(r["s"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, factor: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256 of every kept vector.

    Vectors that are null, have not exactly ``dims`` components or a null or
    non-finite one are left out. Centroids start as the ``k`` vectors whose ids
    have the smallest seeded hash (all of them where there are fewer), equal
    hashes in the order of their components; a null id counts as the empty
    string. Ties go to the smaller number. Rows that repeat an id are separate
    rows. No kept vector, no rows. Further columns, whatever their names, play
    no part. A component beyond 2^26 after quantising raises an error: squares
    of such distances do not fit a long.
    """
    kept = vectors.select(F.col(id_col).alias("vec_id"), quantised(vectors, vector_col, dims, factor).alias("_v")).filter(F.col("_v").isNotNull())
    largest = F.array_max(F.transform("_v", F.abs))
    state = materialize(kept.withColumn("_v", F.when(largest <= LARGEST, F.col("_v")).otherwise(
        F.raise_error(F.lit(f"a component exceeds {LARGEST} after quantising"))))
        .select("vec_id", "_v", *[F.lit(v).cast(t).alias(c) for c, t, v in (("near", "int", 0), ("second", "int", 1), ("upper", "double", float("inf")), ("lower", "double", 0.0))]), "vectors")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    points = np.array([r["_v"] for r in state.orderBy(h, "_v").limit(k).collect()], np.int64).reshape(-1, dims)
    cen = Centroids(points)
    for _ in range(rounds):
        if not len(points):
            break
        state = materialize(_assign(state, cen, dims), "assigned")
        moved = _moved(state, points, dims)
        cen, points = Centroids(moved, points), moved
    if len(points):
        state = _assign(state, cen, dims)
    return _report(state, points, dims)


def _report(state: DataFrame, points: np.ndarray, dims: int) -> DataFrame:
    names = ["vec_id", "cluster", "distance"]
    shape = StructType(state.select("vec_id").schema.fields).add("cluster", "integer").add("distance", "long")

    def run(batches):
        for batch in batches:
            near = batch.column("near").to_numpy(zero_copy_only=False)
            d = squares(_matrix(batch.column("_v"), dims), points[near]) if len(points) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near, pa.int32()), pa.array(d, pa.int64())], names)

    rows = materialize(state.mapInArrow(run, shape), "clusters")
    per = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    facts = [(c, int(per[c]), hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(points.tolist()) if c in per]
    total = int(sum(per.values(), Decimal(0)))
    table = state.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
