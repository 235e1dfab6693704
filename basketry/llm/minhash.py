"""Near duplicates by HyperMinHash.

A document's shingles are spread over ``REGISTERS`` buckets; of each bucket's
smallest hash a register keeps the count of leading zeros and the ``MANTISSA``
bits after the first one (16 bits in all). Runs of registers are banded;
documents that share a band become candidates, the collision-corrected Jaccard
estimate of the registers drops hopeless ones, and the rest is confirmed on the
full shingle sets.

Documents with equal sets are one class from the start. Within a band, pairs
are not listed: its members are compared with the most central one, the text
that shares most bands with others, and links merge components. Members of
bands that still hold several components meet in clusters (documents connected
by such bands) and are compared exactly, block by block, so no link of a band
is lost; only a spanning forest of those links is written.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from basketry.llm.common import lean, materialize, mix, shingle_hashes, text_of, text_slices, word_bounds, word_hashes
from basketry.llm.components import connected_components

REGISTERS = 256
MANTISSA = 10
#: The most often that bands may miss a pair at the threshold.
MISS = 5e-6
#: Documents, and shingles, of a cluster's block (a task compares two blocks).
BLOCK, BLOCK_ITEMS = 512, 1 << 21
_SHIFT = np.uint64(56)


def document_sets(batch: pa.RecordBatch, column: str, k: int):
    """Per row, the sorted distinct hashes of its k-word shingles (A-Z in lower
    case); of fewer words, the one hash of the whole sequence; of none, empty."""
    for _, _, data, offsets in text_slices(batch, column):
        starts, ends, rows = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        cut = np.searchsorted(rows, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            w = words[cut[i]:cut[i + 1]]
            yield np.unique(shingle_hashes(w, min(k, len(w)))) if len(w) else w


def registers(s: np.ndarray) -> np.ndarray:
    """The registers of one sorted set (uint16; 0 for an empty bucket)."""
    bucket = (s >> _SHIFT).astype(np.int64)  # the sorted order is by bucket first
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = (s[first] & np.uint64((1 << 56) - 1)) >> np.uint64(3)  # 53 bits
    frac, exp = np.frexp(rest.astype(np.float64))
    zeros = 53 - exp  # frexp(0) has exponent 0
    mantissa = ((frac * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    mantissa[rest == 0] = 0
    out = np.zeros(REGISTERS, np.uint16)
    out[bucket[first]] = ((zeros + 1) << MANTISSA) + mantissa
    return out


#: For every register, the order in which the others stand in for it.
_STAND_IN = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(99)).reshape(REGISTERS, REGISTERS), axis=1).astype(np.int64)


def densified(r: np.ndarray) -> np.ndarray:
    """Every empty register takes the value of the first full one in its own
    fixed random order, so that registers of short documents agree as often,
    and as independently, as those of long ones."""
    full = r > 0
    out = r.astype(np.uint64)
    todo = np.flatnonzero(~full)
    lo, step = 0, 8
    while len(todo):
        order = _STAND_IN[todo, lo:lo + step]
        hit = full[order]
        some = hit.any(axis=1)
        out[todo[some]] = r[order[some, hit[some].argmax(axis=1)]]
        todo, lo, step = todo[~some], lo + step, step * 4
    return out


def missed(percent: float, rows: int) -> float:
    """How often a pair of this similarity shares no band of ``rows`` registers."""
    return (1 - (percent / 100) ** rows) ** (REGISTERS // rows)


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands): the longest bands that miss a pair at the threshold no
    more often than ``MISS``; single registers if none do."""
    rows = next((r for r in range(REGISTERS, 1, -1) if missed(percent, r) <= MISS), 1)
    return rows, REGISTERS // rows


def band_keys(r: np.ndarray, rows: int, bands: int) -> np.ndarray:
    return mix(shingle_hashes_of_rows(densified(r)[:bands * rows].reshape(bands, rows)) + np.arange(bands, dtype=np.uint64))


def shingle_hashes_of_rows(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(x.shape[1]):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x[:, j] + np.uint64(1))
    return out


def _sketches(k: int, names: list[str], shape: tuple[int, int]):
    def run(batches):
        for b in batches:
            n, digest, regs, bands = [], [], [], []
            for s in document_sets(b, "__text", k):
                n.append(len(s))
                if len(s):
                    r = registers(s)
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    regs.append(r.tobytes())
                    bands.append(band_keys(r, *shape).view(np.int64))
                else:
                    digest.append(None), regs.append(None), bands.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary()),
                                              pa.array(bands, pa.list_(pa.int64()))], [*names, "n", "digest", "regs", "bands"])
    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            sets = [s.view(np.int64) for s in document_sets(b, "__text", k)]
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(sets, pa.list_(pa.int64()))], ["cid", "items"])
    return run


def estimate(batches, percent: int, slack: float = 5.0):
    """Drops pairs whose corrected estimate is ``slack`` standard errors below
    the threshold. Expected random matches: the paper's large-set bound
    0.17 * registers / 2^mantissa * 4q / (1 + q)^2, q the ratio of sizes."""
    for b in batches:
        if b.num_rows == 0:
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"])
            continue
        a = np.frombuffer(b"".join(b.column("ru").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        c = np.frombuffer(b"".join(b.column("rv").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        na, nc = (np.asarray(b.column(x).to_numpy(zero_copy_only=False), float) for x in ("nu", "nv"))
        used = np.maximum(((a > 0) | (c > 0)).sum(1), 1)
        q = na / nc
        chance = 0.169919487 * REGISTERS / (1 << MANTISSA) * 4 * q / (1 + q) ** 2 * used / REGISTERS
        j = (((a == c) & (a > 0)).sum(1) - chance) / used
        t = percent / 100
        ok = j >= t - slack * np.sqrt(t * (1 - t) / used)
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(ok))


def _confirmed(pairs: DataFrame, rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are linked, by estimate and then by full sets."""
    est = (pairs.join(rows.select(F.col("rid").alias("u"), F.col("regs").alias("ru"), F.col("n").alias("nu")), "u")
           .join(rows.select(F.col("rid").alias("v"), F.col("regs").alias("rv"), F.col("n").alias("nv")), "v")
           .mapInArrow(lean(lambda bs: estimate(bs, percent)), "u long, v long"))
    full = (est.join(sets.select(F.col("cid").alias("u"), F.col("items").alias("iu")), "u")
            .join(sets.select(F.col("cid").alias("v"), F.col("items").alias("iv")), "v"))
    both = F.size(F.array_intersect("iu", "iv"))
    return full.select("u", "v", both.alias("both"), (F.size("iu") + F.size("iv") - both).alias("either")).filter(F.col("both") * 100 >= F.col("either") * percent).select("u", "v")


def linked_blocks(percent: int):
    """Links between members of one (pair of blocks of a) cluster: exact
    intersections of all of them at once, as a product of 0/1 matrices over the
    shingles that at least two members have, a slice of shingles at a time.
    Yields a spanning forest of the links, never their list."""
    def run(t: pa.Table) -> pa.Table:
        cid, comp = t["cid"].to_numpy(), t["comp"].to_numpy()
        m = len(cid)
        items = t["items"].combine_chunks()
        size = np.diff(items.offsets.to_numpy()).astype(np.int64)
        value, column = np.unique(items.values.to_numpy()[items.offsets[0].as_py():], return_inverse=True)
        row = np.repeat(np.arange(m), size)
        shared = np.bincount(column, minlength=len(value)) > 1
        number = np.cumsum(shared) - 1
        keep = shared[column]
        row, column = row[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((m, m), np.float32)
        for lo in range(0, int(shared.sum()), 2048):
            a, b = np.searchsorted(column, (lo, lo + 2048))
            x = np.zeros((m, 2048), np.float32)
            x[row[a:b], column[a:b] - lo] = 1
            both += x @ x.T
        i, j = np.nonzero((both * 100 >= percent * (size[:, None] + size[None, :] - both)) & (comp[:, None] != comp[None, :]))
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c
        out = []
        for p, q in zip(i.tolist(), j.tolist()):
            u, v = find(int(comp[p])), find(int(comp[q]))
            if u != v:
                root[u] = v
                out.append((int(cid[p]), int(cid[q])))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([x for _, x in out], pa.int64())})
    return run


def prefixes(items: DataFrame, percent: int) -> DataFrame:
    """(item, cid, comp): of every set (cid, comp, items) the rarest shingles
    that a linked partner must share one of.

    With all shingles in one order (how many sets have them, then their value),
    two sets of a similarity of at least ``percent`` / 100 have a common one
    among the first n - ceil(n * percent / 100) + 1 of each. Shingles of a single
    set stand first and can't be common: only the others are kept."""
    rows = items.select("cid", "comp", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = materialize(rows.groupBy("item").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "shared-shingles")
    per = rows.join(often, "item").groupBy("cid", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("f", "item"))).alias("s"))  # bounded by the set
    room = F.col("n") - F.ceil(F.col("n") * int(percent) / 100) + 1 - (F.col("n") - F.size("s"))
    return per.filter(room > 0).select("cid", "comp", F.explode(F.slice("s", F.lit(1), room.cast("int"))).alias("x")).select("x.item", "cid", "comp")


def _within_clusters(cluster: DataFrame, docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between different components inside every cluster. A
    cluster of more than ``BLOCK`` documents or ``BLOCK_ITEMS`` shingles is cut
    into blocks, and every two blocks meet in a task of their own."""
    sized = cluster.join(sets.select(F.col("cid").alias("node"), F.size("items").alias("n")), "node")
    size = materialize(sized.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_ITEMS)).alias("blocks")), "cluster-sizes")
    placed = cluster.join(size, "component").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")))
    met = placed.select("component", F.col("node").alias("cid"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    keyed = met.select("cid", "component", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    full = keyed.join(docs, "cid").join(sets, "cid").select("component", "i", "j", "cid", "comp", "items")
    return full.groupBy("component", "i", "j").applyInArrow(linked_blocks(percent), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept,
    ``chosen`` and the columns named in ``keep`` under ``keep_<name>``.

    Documents whose sets of k-word shingles have a Jaccard similarity of at
    least ``percent`` / 100 are linked; a component's id is the smallest id of
    its rows. Texts without words (null, empty) link with nothing: their
    component is their own id. ``kept`` marks doc_id = component_id; ``chosen``
    one row of every component, the first of those kept, so rows that repeat an
    id still leave one. A null id never names a component unless all are null
    (then component_id is null and kept false).
    """
    cols = {"rid": F.monotonically_increasing_id(), "doc_id": F.col(id_col), "th": F.xxhash64(text_of(docs, text_col))} | {f"keep_{c}": F.col(c) for c in keep}
    base = docs.select(*[c.alias(x) for x, c in cols.items()], text_of(docs, text_col).alias("__text"))
    shape = StructType([*base.drop("__text").schema.fields, StructField("n", LongType()), StructField("digest", BinaryType()),
                        StructField("regs", BinaryType()), StructField("bands", ArrayType(LongType()))])
    rows = materialize(base.mapInArrow(lean(_sketches(k, list(cols), banding(percent))), shape), "sketches")
    known = rows.filter("n > 0")
    classes = materialize(known.groupBy("digest").agg(F.min("rid").alias("cid")), "classes")
    reps = known.select(F.col("rid").alias("cid"), "n", "bands").join(classes.select("cid"), "cid", "left_semi")
    banded = reps.select("cid", "n", F.explode("bands").alias("band"))
    crowded = materialize(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "crowded")
    shared = materialize(banded.join(crowded, "band"), "bands")
    # centrality: how many neighbours a document's bands have. The text that a
    # group's copies were made from shares more bands than any of them
    central = shared.groupBy("cid").agg(F.sum("size").alias("score"))
    members = materialize(shared.join(central, "cid"), "members")

    # full sets of the candidates only, from their texts
    cand = members.select("cid").distinct()
    named = rows.select(F.col("rid").alias("cid"), "th", F.col("doc_id").alias("_id")).join(cand, "cid", "left_semi")
    texts = docs.select(F.xxhash64(text_of(docs, text_col)).alias("th"), F.col(id_col).alias("_id"), text_of(docs, text_col).alias("__text"))
    found = texts.join(named, texts["th"].eqNullSafe(named["th"]) & texts["_id"].eqNullSafe(named["_id"])).select("cid", "__text")
    sets = materialize(found.mapInArrow(lean(_sets(k)), "cid long, items array<bigint>").dropDuplicates(["cid"]), "sets")

    # aggregates joined back are tables of their own, so that the joins can
    # split a band or component that holds a third of all rows
    hub = materialize(members.groupBy("band").agg(F.max(F.struct("score", (-F.col("cid")).alias("c"), F.col("n").alias("m"))).alias("hub")), "hubs")
    pairs = (members.join(hub, "band").filter(f"cid <> -hub.c and least(n, hub.m) * 100 >= greatest(n, hub.m) * {int(percent)}")
             .select(F.expr("least(cid, -hub.c)").alias("u"), F.expr("greatest(cid, -hub.c)").alias("v")).distinct())
    pairs = materialize(pairs, "pairs")
    links = materialize(_confirmed(pairs, rows, sets, percent), "links")
    label = materialize(connected_components(links), "labels")

    # bands that still hold several components: their members can only be linked
    # where they share one of their rarest shingles. Texts of one template that
    # are similar, but not enough, share none and are done here, at a cost linear
    # in their sets; the others are compared exactly, cluster by cluster
    named = members.select("band", "cid", "n").join(label, F.col("cid") == F.col("node"), "left").select("band", "cid", F.coalesce("component", "cid").alias("comp"))
    still = materialize(named.groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("band"), "still")
    left = materialize(named.join(still, "band").select("cid", "comp").distinct(), "open")
    rare = materialize(prefixes(left.join(sets, "cid"), percent), "prefixes")
    meet = materialize(rare.groupBy("item").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("cid").alias("first")).filter("a <> b").select("item", "first"), "meeting-shingles")
    cluster = materialize(connected_components(rare.join(meet, "item").select(F.col("first").alias("u"), F.col("cid").alias("v"))), "clusters")
    more = materialize(_within_clusters(cluster, left, sets, percent), "more-links")
    label = materialize(connected_components(links.unionByName(more)), "labels")

    cls = known.select("rid", "doc_id", "digest").join(classes, "digest").join(label, F.col("cid") == label["node"], "left")
    placed = cls.select("rid", "doc_id", F.coalesce("component", "cid").alias("comp"))
    named = materialize(placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")), "names")
    full = placed.select("rid", "comp").join(named, "comp").select("rid", "component_id", (F.col("rid") == F.col("first.rid")).alias("chosen"))
    out = rows.join(full, "rid", "left")
    comp = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"),
                      F.coalesce("chosen", F.lit(True)).alias("chosen"), *[f"keep_{c}" for c in keep])
