"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session of one process (master ``local``, as in tests) names none,
    a temporary folder becomes the checkpoint folder; a cluster must name one.
    """
    own = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str, spent: Iterable[DataFrame] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table cuts the lineage: a lost executor never has to repeat what
    led to it. ``spent`` are staged tables that were needed for this one
    only; their files are deleted once it is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    for table in spent:
        drop_table(spark, table.staged_at)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Hadoop's names of stores that pyarrow knows under another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_store(path: str):  # noqa: ANN201
    """(file system, root) of a folder for Python tasks, by pyarrow under the scheme that Hadoop names."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{mark}{rest}")


def lean(run):  # noqa: ANN001, ANN201
    """A task's generator that gives freed memory back to the system at its end, as its worker goes on to other tasks."""

    @functools.wraps(run)
    def wrapped(batches):  # noqa: ANN001, ANN202
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of about ``limit`` bytes of text.

    Yields (first row, end row, bytes, offsets); offsets has one entry more
    than there are rows and starts at 0. Nulls come as empty texts. A text
    longer than ``limit`` makes a chunk of its own, whole.
    """
    texts = batch.column(column)
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


#: Constants of the splitmix64 finaliser.
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
#: Longer tables of powers are made anew for the text that needs them and not kept.
_KEPT_POWERS = 1 << 20


def _table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out, out=out)
        if len(have) <= _KEPT_POWERS:
            _powers[name] = have
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``range_hash`` makes the hash of any range."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table("up", _BASE, len(data)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of the byte ranges [start, end)."""
    down = _table("down", _INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * down[start])


ROUNDS = 60


def components(edges: DataFrame, left: str = "a", right: str = "b", name: str = "component") -> DataFrame:
    """Connected components of an edge list: rows (id, ``name``).

    ``name`` is the smallest id of the component; ids without an edge to
    another id have no row. Each round hooks every node to its least
    neighbour, by id in even rounds (stars around a first member collapse at
    once) and by another hash in each odd round (so that chains shrink too),
    contracts the edges and writes them to the shared folder. No node's
    neighbours are gathered: every step is an aggregation or an equi-join
    with a unique right side. Null ids and loops are left out. The number of
    rounds grows with the logarithm of the longest path; work that isn't
    finished after ``ROUNDS`` of them raises an error.
    """
    spark = edges.sparkSession
    clean = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).where("a <> b")
    nodes = None
    current = stage_table(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for step in range(ROUNDS + 1):
        if current.isEmpty():
            break
        if step == ROUNDS:
            raise RuntimeError(f"components aren't settled after {ROUNDS} rounds")
        both = current.union(current.select("b", "a"))
        order = lambda c: F.struct((F.xxhash64(c, F.lit(step)) if step % 2 else c).alias("h"), c.alias("v"))  # noqa: B023, E731
        hook = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        hook = hook.select(F.col("a").alias("id"), F.least(F.col("m"), order(F.col("a"))).getField("v").alias("up"))
        hook = stage_table(_jump(hook), "hooks")
        first = nodes is None
        nodes = hook if first else stage_table(
            nodes.join(hook.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left").select("id", F.coalesce("top", "up").alias("up")), "nodes", [nodes])
        up_a = hook.select(F.col("id").alias("a"), F.col("up").alias("x"))
        up_b = hook.select(F.col("id").alias("b"), F.col("up").alias("y"))
        moved = current.join(up_a, "a").join(up_b, "b").where("x <> y")
        current = stage_table(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", [current] if first else [current, hook])
    if nodes is None:
        return current.select(F.col("a").alias("id"), F.col("b").alias(name)).limit(0)
    least = nodes.groupBy("up").agg(F.min("id").alias(name))
    return nodes.join(least, "up").select("id", name)


def _jump(hook: DataFrame) -> DataFrame:
    """One pointer jump: hook to the hook of the hook."""
    above = hook.select(F.col("id").alias("up"), F.col("up").alias("top"))
    return hook.join(above, "up").select("id", F.col("top").alias("up"))
