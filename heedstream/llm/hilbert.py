"""Sharding along a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to ``bits`` bits each; the curve index of
the resulting cell orders the rows, so that neighbours on the curve are near
in every dimension, and the order is cut into runs of equal row counts (law
``rows``: counts at most one apart). Files written by run have narrow value
ranges in all dimensions at once and can be pruned by any of them.

No row order is ever built in one task: rows are counted by (curve index,
hash slice), the small table of counts gives every slice its first
position, and rows are numbered inside their slice only, in the same
partitioning that brings the first positions to them. A cell that holds
a third of all rows is spread over ``SLICES`` hash slices, or more in a table
of more than ``SLICE_ROWS`` rows for each.

Null dimensions take cell 0. Repeated rows and ties are ordered by hash,
key and size; equal rows are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heedstream.llm._common import stage_table

#: Least hash slices of one curve cell, rows of a table for each slice, and the most curve bits.
SLICES, SLICE_ROWS, MOST_BITS = 256, 1_000_000, 18


def quantise_log(c: Column, bits: int) -> Column:
    """Steps of half a power of two from 0; null is 0."""
    step = F.floor(2 * F.log2(F.greatest(c.cast("double"), F.lit(0.0)) + 1))
    return F.coalesce(F.least(step, F.lit((1 << bits) - 1)), F.lit(0)).cast("long")


def quantise_name(c: Column, bits: int) -> Column:
    """A hash cell of a name; null is 0."""
    return F.when(c.isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << bits))).cast("long")


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point given by integer columns of ``bits`` bits."""
    n = len(dims)
    top = 1 << (bits - 1)

    def turn(x: Column, q: Column, i: Column) -> Column:
        low, first, own = q - 1, x[0], F.element_at(x, (i + 1).cast("int"))
        swap = (first.bitwiseXOR(own)).bitwiseAND(low)
        on = own.bitwiseAND(q) != 0
        return F.transform(x, lambda v, j: F.when(on & (j == 0), v.bitwiseXOR(low)).when(~on & ((j == 0) | (j == i)) & (i != 0), v.bitwiseXOR(swap)).otherwise(v))

    steps = F.array(*[F.struct(F.lit(top >> k).cast("long").alias("q"), F.lit(i).cast("long").alias("i")) for k in range(bits - 1) for i in range(n)]) if bits > 1 else F.array().cast("array<struct<q:bigint,i:bigint>>")
    x = F.aggregate(steps, F.array(*[d.cast("long") for d in dims]), lambda acc, s: turn(acc, s["q"], s["i"]))
    gray = F.transform(x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), (j + 1).cast("int")), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))
    return F.transform(F.array(gray), lambda g: _interleave(g, n, bits))[0]


def _interleave(g: Column, n: int, bits: int) -> Column:
    last = g[n - 1]
    flip = reduce(lambda a, b: a.bitwiseXOR(b), [F.when(last.bitwiseAND(F.lit(1 << k)) != 0, F.lit((1 << k) - 1)).otherwise(F.lit(0)).cast("long") for k in range(1, bits)], F.lit(0).cast("long"))
    out = F.lit(0).cast("long")
    for k in range(bits):
        for i in range(n):
            bit = F.shiftright(g[i].bitwiseXOR(flip), k).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, k * n + (n - 1 - i)))
    return out


def shard(rows: DataFrame, dims: list[Column], bits: int, shards: int, order: list[str]) -> DataFrame:
    """``rows`` with curve_index, shard and slot (gapless from 0 in each shard).

    ``order`` names columns that settle the order inside a cell. Columns of
    ``rows`` that are called curve_index, shard or slot are replaced, those
    that begin with an underscore are the operator's own and not allowed.
    """
    if own := [c for c in rows.columns if c.startswith("_")]:
        raise ValueError(f"columns {own} begin with an underscore")
    rows = rows.drop("curve_index", "shard", "slot")
    if bits * len(dims) > MOST_BITS:
        raise ValueError(f"at most {MOST_BITS} curve bits")
    at = rows.withColumns({"curve_index": hilbert_index(dims, bits), "_rank": F.xxhash64(*order)})
    # written once: the curve is computed once for each row, though counts and rows both read it
    at = stage_table(at, "curve")
    # slices follow the rows, so that a cell that holds most of a large table still comes apart
    slices = max(SLICES, 1 << max(0, -(-at.count() // SLICE_ROWS) - 1).bit_length())
    at = at.withColumns({"_slice": F.shiftright("_rank", 65 - slices.bit_length()).cast("int") + slices // 2, "_cell": F.col("curve_index")})
    counts = at.groupBy("_cell", "_slice").agg(F.count("*").alias("n"))
    cells = counts.groupBy("_cell").agg(F.sum("n").alias("m"))
    line = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("_cell", (F.sum("m").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))).alias("before"), F.sum("m").over(line).alias("total"))
    inside = Window.partitionBy("_cell").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(cells), "_cell").select("_cell", "_slice", (F.coalesce("before", F.lit(0)) + F.col("within")).alias("_first"), "total")
    numbered = at.join(first, ["_cell", "_slice"]).withColumn("_n", F.row_number().over(Window.partitionBy("_cell", "_slice").orderBy("_rank", *order)) - 1)
    place = numbered.withColumn("_at", F.col("_first") + F.col("_n"))
    # whole-number arithmetic: shard s takes positions from ceil(s * total / shards)
    put = place.withColumn("shard", F.expr(f"cast((_at * {shards}) div total as int)"))
    slot = F.expr(f"_at - ((cast(shard as long) * total + {shards - 1}) div {shards})")
    return put.withColumn("slot", slot).drop("_cell", "_slice", "_rank", "_first", "_n", "_at", "total")


def write_shards(sharded: DataFrame, path: str, rows_a_file: int = 1_000_000) -> None:
    """One folder for each shard with files of about ``rows_a_file`` rows, each a stretch of the curve.

    Splitters are sampled over (shard, slot), so a large shard is written by
    several tasks; the value ranges in the files' footers let a filter on any
    dimension skip files.
    """
    files = -(-sharded.count() // rows_a_file)
    ranged = sharded.repartitionByRange(max(1, files), "shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.partitionBy("shard").option("maxRecordsPerFile", rows_a_file).parquet(path)
