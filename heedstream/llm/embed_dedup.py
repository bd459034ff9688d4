"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors with a label are normalised; each of a number of tables quantises
random projections (floor((a.v + b) / width)) into one bucket key. Vectors
meet where label and key agree, and every pair that meets is checked
exactly: cosine in double precision. A pair that meets in several tables is
counted only in the first. Equal vectors of one label are first joined into
a class whose size counts in the links.

The number of projections follows from the size of the largest label, so that
unrelated vectors meet in numbers that grow with the label and not with its
square, and the number of tables from the projections and ``MISS``, the
probability that a pair at the threshold never meets.

Buckets are cut into blocks of ``BLOCK`` vectors and block meets block, so
no task holds more than two blocks however large a bucket is; small buckets
are checked many at a time. A task returns link counts by vector and, for the
components, stars of the groups that its links join instead of the links.

Null vectors and vectors that are zero or hold null or non-finite parts, or
have no label, link with nothing. All others are scaled by their largest part
first, so that very small and very large ones keep their direction. Repeated
ids are rows of their own with equal results where vectors agree; rows
without an id have results too, a component without any id has none, and
``kept`` is null where ``vec_id`` is. Vectors of different length never link.
An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedstream.llm._common import components, lean, mix, stage_table

#: Quantisation width, seed of the projections, probability that a pair at the threshold is missed.
WIDTH, SEED, MISS = 1.2, 17, 2e-5
BLOCK = 1024
#: Rows of buckets that are checked together, and from how many on a bucket is multiplied as matrices.
CHECK_ROWS, LARGE = 8192, 128


def collision_probability(distance: float, width: float = WIDTH, hashes: int = 1) -> float:
    """Chance that one table puts two vectors at this distance into one bucket."""
    r = width / distance
    one = 1 - 2 * (0.5 * math.erfc(r / math.sqrt(2))) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    return one**hashes


def plan(rows: int, threshold: float, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """(tables, projections) for a label of so many vectors.

    Vectors at right angles share a bucket with a probability of about one in
    ``rows``; the tables make up for what that costs pairs at the threshold.
    """
    hashes = max(6, math.ceil(math.log(max(rows, 2)) / -math.log(collision_probability(math.sqrt(2), width))))
    near = collision_probability(math.sqrt(2 * (1 - threshold)), width, hashes)
    return math.ceil(math.log(miss) / math.log1p(-near)), hashes


@functools.lru_cache(maxsize=8)
def _projections(d: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The random projections of a process, drawn once for each dimension."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((d, tables * hashes)), rng.uniform(0, width, tables * hashes)


def bucket_keys(unit: np.ndarray, tables: int, hashes: int, width: float, seed: int = SEED) -> np.ndarray:
    """(rows, tables) bucket keys as signed 64-bit values."""
    a, b = _projections(unit.shape[1], tables, hashes, width, seed)
    cell = np.floor((unit @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, hashes)
    key = np.zeros((len(unit), tables), dtype=np.uint64) + np.arange(1, tables + 1, dtype=np.uint64)
    for k in range(hashes):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, k])
    return key.view(np.int64)


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _units(column: pa.Array) -> np.ndarray:
    m = _matrix(column, np.float64)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _near(unit: np.ndarray, start: np.ndarray, end: np.ndarray, i: np.ndarray, j: np.ndarray, block: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group (rows start..end) that are near; groups of two blocks pair across them only."""
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        for at in range(0, len(x), 1 << 15):
            p, q = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
            good = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
            xs.append(p[good])
            ys.append(q[good])

    size = end - start
    for g in np.flatnonzero(size > LARGE).tolist():
        rows = np.arange(start[g], end[g])
        own = block[rows]
        left, right = rows[own == i[g]], rows[own == j[g]]
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            near = unit[some] @ unit[right].T >= threshold - 1e-9
            if i[g] == j[g]:
                near &= some[:, None] < right[None, :]
            x, y = np.nonzero(near)
            keep(some[x], right[y])
    group = np.repeat(np.arange(len(size)), size)
    small = np.flatnonzero((size <= LARGE)[group])
    last = (end - 1)[group]
    lag = 0
    while len(small):
        lag += 1
        small = small[small + lag <= last[small]]
        far = small + lag
        fits = (i[group[small]] == j[group[small]]) | (block[small] != block[far])
        keep(small[fits], far[fits])
    return np.concatenate(xs), np.concatenate(ys)


def _least_of_groups(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the pairs (x, y) join it with."""
    top = np.arange(n)
    while True:
        low = np.minimum(top[x], top[y])
        new = top.copy()
        for to in (x, y, top[x], top[y]):
            np.minimum.at(new, to, low)
        new = new[new]
        if np.array_equal(new, top):
            return top
        top = new


def _checked(threshold: float):  # noqa: ANN202
    """Rows sorted by group to link counts (b null) and edges (links null)."""
    key = ["t", "key", "label", "d", "i", "j"]

    def groups(table: pa.Table) -> np.ndarray:
        """Where a group begins."""
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for c in key:
            v = table.column(c).combine_chunks()
            v = v.dictionary_encode().indices.to_numpy() if pa.types.is_string(v.type) or pa.types.is_binary(v.type) else v.to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def check(table: pa.Table, start: np.ndarray) -> pa.RecordBatch:
        end = np.append(start, table.num_rows)[1:]
        d = table.column("d").to_numpy()
        i, j, block, t = (table.column(c).to_numpy() for c in ("i", "j", "block", "t"))
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        xs, ys = [], []
        for size in np.unique(d):
            # groups hold vectors of one length
            rows = np.flatnonzero(d == size)
            mine = np.flatnonzero(d[start] == size)
            part = table.take(pa.array(rows)) if len(rows) < table.num_rows else table
            unit = _units(part.column("v").combine_chunks())
            own = np.searchsorted(rows, start[mine])
            x, y = _near(unit, own, own + (end - start)[mine], i[start[mine]], j[start[mine]], block[rows], threshold)
            keys = _matrix(part.column("keys").combine_chunks(), np.int64)
            before = np.arange(keys.shape[1]) < t[rows][x][:, None]
            new = ~((keys[x] == keys[y]) & before).any(axis=1)
            xs.append(rows[x[new]])
            ys.append(rows[y[new]])
        x, y = np.concatenate(xs), np.concatenate(ys)
        links = np.bincount(x, copies[y], table.num_rows).astype(np.int64) + np.bincount(y, copies[x], table.num_rows).astype(np.int64)
        has = np.flatnonzero(links)
        top = _least_of_groups(table.num_rows, x, y)
        leaf = np.flatnonzero(top != np.arange(len(top)))
        nothing = lambda n: pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([node[has], node[leaf]])), pa.concat_arrays([nothing(len(has)), pa.array(node[top[leaf]])]), pa.concat_arrays([pa.array(links[has]), nothing(len(leaf))]),
        ], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows < CHECK_ROWS:
                continue
            start = groups(held)
            if len(start) > 1:
                yield check(held.slice(0, int(start[-1])).combine_chunks(), start[:-1])
                held = held.slice(int(start[-1]))
        if held is not None and held.num_rows:
            yield check(held.combine_chunks(), groups(held))

    return run


def dedup(vectors: DataFrame, threshold: float = 0.98, tables: int | None = None, hashes: int | None = None, width: float = WIDTH) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each vector; tables and projections follow from the largest label unless given."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    fine = F.col("v").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    largest = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("ok", F.coalesce(fine & (largest > 0), F.lit(False)))
    rows = rows.withColumn("sha", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: (x + 0.0).cast("string"))), 256)))
    rows = rows.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x / largest)))
    rows = stage_table(rows.select("vec_id", "v", "label", "ok", "sha"), "vectors")
    classes = stage_table(rows.where("ok").groupBy("sha").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label")).withColumn("node", F.monotonically_increasing_id()), "classes")
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    planned = plan(most, threshold, width)
    tables, hashes = tables or planned[0], hashes or planned[1]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("v").value_lengths())
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                keys = bucket_keys(_units(part.column("v")), tables, hashes, width)
                ends = pa.array(np.arange(len(part) + 1) * tables, pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "copies", "label", "v")), pa.array(np.full(len(part), int(d), np.int32)), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], ["node", "copies", "label", "v", "d", "keys"])

    label_type = dict(classes.dtypes)["label"]
    keyed = stage_table(classes.select("node", "copies", "label", "v").mapInArrow(lean(hashed), f"node long, copies long, label {label_type}, v array<double>, d int, keys array<long>"), "keys")
    meets = keyed.select("node", "copies", "label", "d", F.posexplode("keys").alias("t", "key"))
    at = ["t", "key", "label", "d"]
    sizes = meets.groupBy(*at).agg(F.count("*").alias("m")).where("m > 1").select(*at, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    # a table of its own, so that the join may split the rows of a bucket that very many vectors share
    live = meets.join(stage_table(sizes, "buckets"), at)
    live = live.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    live = live.select(*at, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies")
    live = live.join(keyed.select("node", "v", "keys"), "node")
    ordered = live.repartition(*at, "i", "j").sortWithinPartitions(*at, "i", "j")
    found = stage_table(ordered.mapInArrow(lean(_checked(threshold)), "a long, b long, links long"), "links", [keyed])
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("more"))
    parts = components(found.where("b is not null"), name="part")
    joined = stage_table(classes.select("node", "sha", "rep", "copies").join(links, "node", "left").join(parts.withColumnRenamed("id", "node"), "node", "left"), "groups")
    least = joined.where("part is not null").groupBy("part").agg(F.min("rep").alias("least"))
    reps = joined.join(least, "part", "left").select("sha", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.when(F.col("part").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    out = rows.select("vec_id", "sha").join(reps, "sha", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
