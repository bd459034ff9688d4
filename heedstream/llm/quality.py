"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a set of hashed features: its lower-cased words and its byte
trigrams, each part scaled by the root of its count over the root of the
text's length. One weight for each feature, shared by all grades, gives a
score, and ordered thresholds turn the score into P(grade > j) =
sigmoid(score - threshold_j). The expected grade and the tail probability
of the top grade decide the selection.

The fit uses a documented bounded sample: ``SAMPLE`` rated documents by the
hash of their id, their texts whole. Scoring reads all documents whole.

Null and empty texts have no features: they
have score 0 and are judged by the thresholds alone. Ratings with null
parts are left out, of several ratings of an id the lowest grade counts.
Where no two grades are rated there is nothing to fit: all are kept and
the probabilities are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from heedstream.llm._common import lean, text_chunks
from heedstream.llm.shingles import words

#: Rated documents in the fit, feature bits, passes.
SAMPLE, BITS, PASSES = 6000, 17, 12
GRADES = ("toxic", "junk", "good")


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature indices, where each text's begin and end) of the words, then of the trigrams that lie within one text."""
    word, _, _, first = words(data, offsets)
    half = 1 << (BITS - 1)
    yield (word & np.uint64(half - 1)).astype(np.int32), first[:-1], first[1:]
    d = data.astype(np.uint32)
    if len(d) >= 3:
        tri = (d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(2654435761)
        tri = (tri >> np.uint32(33 - BITS)).astype(np.int32) + half
    else:
        tri = np.zeros(0, np.int32)
    begin = np.minimum(offsets[:-1], len(tri))
    yield tri, begin, np.maximum(begin, offsets[1:] - 2)


def _sums(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of x over [begin, end), each from its own values alone, so that a text's score doesn't hang on its neighbours."""
    out = np.zeros(len(begin))
    some = np.flatnonzero(end > begin)
    if len(some):
        edges = np.column_stack([begin[some], end[some]]).ravel()
        out[some] = np.add.reduceat(np.append(x, x.dtype.type(0)), edges, dtype=np.float64)[::2]
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each text, for the fit."""
    parts = list(_features(data, offsets))
    for k in range(len(offsets) - 1):
        index, value = [], []
        for x, begin, end in parts:
            own = x[begin[k] : end[k]]
            if len(own):
                i, n = np.unique(own, return_counts=True)
                index.append(i)
                value.append(n / np.sqrt(len(own)))
        yield (np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32)) if index else (np.zeros(0, np.int32), np.zeros(0, np.float32))


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    for x, begin, end in _features(data, offsets):
        out += _sums(weights[x], begin, end) / np.sqrt(np.maximum(end - begin, 1))
    return out


class Ordinal:
    """Shared weights and ordered thresholds, fitted by AdaGrad."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, grades: int, passes: int = PASSES, rate: float = 0.3, decay: float = 1e-5, seed: int = 5) -> Ordinal:
        rng = np.random.default_rng(seed)
        w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
        # thresholds: the first and the logarithms of the gaps, so that their order holds
        t, t2 = np.array([-0.5, *[0.0] * (grades - 2)]), np.full(grades - 1, 1e-3)
        count = np.bincount(grade, minlength=grades)
        weight = (len(grade) / np.maximum(count, 1) / max(1, (count > 0).sum())) ** 0.5
        for _ in range(passes):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 32):
                some = order[at : at + 32]
                index = np.concatenate([rows[k][0] for k in some])
                value = np.concatenate([rows[k][1] for k in some])
                owner = np.repeat(np.arange(len(some)), [len(rows[k][0]) for k in some])
                s = np.bincount(owner, w[index] * value, len(some))
                theta = np.cumsum([t[0], *np.exp(t[1:])])
                low = np.concatenate([[-np.inf], theta])[grade[some]]
                high = np.concatenate([theta, [np.inf]])[grade[some]]
                a, b = _sigmoid(high - s), _sigmoid(low - s)
                p = np.maximum(a - b, 1e-9)
                da, db = a * (1 - a) / p, b * (1 - b) / p
                c = weight[grade[some]] / len(some)
                ds = (da - db) * c  # of the loss by the score
                dt = np.zeros(grades - 1)
                np.add.at(dt, np.minimum(grade[some], grades - 2), np.where(grade[some] < grades - 1, -da * c, 0))
                np.add.at(dt, np.maximum(grade[some] - 1, 0), np.where(grade[some] > 0, db * c, 0))
                gt = np.array([dt[k:].sum() * (1 if k == 0 else np.exp(t[k])) for k in range(grades - 1)])
                t2 += gt * gt
                t -= rate * gt / np.sqrt(t2)
                hit, place = np.unique(index, return_inverse=True)
                gw = np.bincount(place, ds[owner] * value) + decay * w[hit]
                g2[hit] += gw * gw
                w[hit] -= rate * gw / np.sqrt(g2[hit])
        return Ordinal(w.astype(np.float32), np.cumsum([t[0], *np.exp(t[1:])]))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): P(grade > j)."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxic marks: 0 toxic, 1 junk, 2 good."""
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, grades: int = len(GRADES)) -> Ordinal | None:
    """Fit on at most ``sample`` rated documents; only their sparse features reach the driver.

    Ids are chosen by their hashes; where documents repeat a chosen id, the
    rows themselves are cut to ``sample`` in the same order, by task first.
    """
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch, "text"):
                pairs = list(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:end], batch.column("grade")[first:end], pa.array([i.tobytes() for i, _ in pairs], pa.binary()), pa.array([v.tobytes() for _, v in pairs], pa.binary())], ["doc_id", "grade", "i", "v"])

    made = texts.mapInArrow(lean(run), "doc_id long, grade int, i binary, v binary")
    found = sorted(made.orderBy(F.xxhash64("doc_id"), "doc_id", "i").limit(sample).collect(), key=lambda r: (r["doc_id"], bytes(r["i"])))
    grade = np.array([r["grade"] for r in found], dtype=np.int64)
    if len(np.unique(grade)) < 2:
        return None
    return Ordinal.fit([(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float32)) for r in found], grade, grades)


def classify(docs: DataFrame, model: Ordinal | None, select: float = 0.5) -> DataFrame:
    """Rows (carried, score, expected_grade, tail_probability, selected), one for each row of docs.

    ``carried`` is a struct of all columns of docs, whatever their names.
    """
    names = ["score", "expected_grade", "tail_probability"]
    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    carried = F.struct(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]).alias("carried")
    if model is None:
        return own.select(carried, *[F.lit(None).cast("double").alias(n) for n in names], F.lit(True).alias("selected"))
    text = f"c{docs.columns.index('text')}"
    added = [StructField(n, DoubleType()) for n in names] + [StructField("selected", BooleanType())]
    schema = StructType([*own.schema.fields, *added])
    weights, thresholds = model.weights, model.thresholds
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [scores(data, offsets, shared.value) for _, _, data, offsets in text_chunks(batch, text)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            tails = Ordinal(shared.value, thresholds).tails(score)
            more = [pa.array(score), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= select)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names, "selected"])

    return own.mapInArrow(lean(run), schema).select(carried, *names, "selected")
