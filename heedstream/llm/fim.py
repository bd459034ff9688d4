"""Fill-in-the-middle examples assembled by a secondary sort.

Every text is cut into units (lines with their ends, the last one with or
without) and its units into prefix, middle and suffix, drawn from a hash of
the document's id. Tasks emit pieces, chunks of whole units of about
``CHUNK`` bytes (a longer unit in several), under the key (row, position in
the output). ``repartitionAndSortWithinPartitions`` brings the pieces of a
row together in output order, and they stream into an incremental digest. To
restore the text the assembled output is scanned for the sentinels again and
what stands between them is sorted anew by its place in the text: same
partitioner, so that this sort shuffles nothing.

A null text is empty and gives a plain example; a null id is drawn as the
empty string. Rows with equal ids are examples of their own, as rows are the
key. A text may be of any length: no task holds more than a chunk of it
besides what the sort holds, which spills. An empty table gives no rows.
Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a piece, and of the texts whose pieces meet in one partition of the sort.
CHUNK, PARTITION_BYTES = 32 << 10, 16 << 20
_SEQ = 40
#: Parts of a text by their place in it, and each form's parts with their sentinels in output order.
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)), "plain": ((None, 0),)}


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from the hash of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def plan(doc_id: int | None, data: bytes, seed: int = 7, rate: int = 100, spm: int = 50) -> tuple[int, str, int, int, np.ndarray]:
    """(units, form, end of the prefix, end of the middle, ends of units), in bytes."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    n = len(ends)
    a, b, c, d = draws(doc_id, seed)
    if not data or c % 100 >= rate or any(s.encode() in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", len(data), len(data), ends
    low, high = sorted((a % (n + 1), b % (n + 1)))
    place = lambda k: int(ends[k - 1]) if k else 0
    return n, "spm" if d % 100 < spm else "psm", place(low), place(high), ends


def code_points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def chunks(data: bytes, first: int, last: int, ends: np.ndarray, size: int) -> Iterator[bytes]:
    """The bytes [first, last) as runs of whole units of at most ``size`` bytes; a longer unit is cut."""
    while first < last:
        k = int(np.searchsorted(ends, first + size, side="right")) - 1
        stop = int(ends[k]) if k >= 0 and ends[k] > first else first + size
        yield data[first : min(stop, last)]
        first = stop


class Restorer:
    """Takes an output in chunks of any size and gives (part of the text, bytes) as the sentinels tell them."""

    def __init__(self, form: str) -> None:
        self.steps = list(FORMS[form])
        self.part, self.held = None, b""
        if self.steps[0][0] is None:
            self.part = self.steps.pop(0)[1]

    def feed(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        data, self.held = self.held + data, b""
        while self.steps:
            mark = self.steps[0][0].encode()
            at = data.find(mark)
            if at < 0:
                keep = min(len(data), len(mark) - 1)
                data, self.held = data[: len(data) - keep], data[len(data) - keep :]
                break
            if at:
                yield self._own(data[:at])
            self.part, data = self.steps.pop(0)[1], data[at + len(mark) :]
        if data:
            yield self._own(data)

    def _own(self, data: bytes) -> tuple[int, bytes]:
        if self.part is None:
            raise ValueError("the output doesn't begin with its sentinel")
        return self.part, data

    def rest(self) -> Iterator[tuple[int, bytes]]:
        if self.steps:
            raise ValueError("the output lacks a sentinel")
        if self.held:
            yield self._own(self.held)


def _home(key: tuple[int, int]) -> int:
    """Partition of a row's pieces."""
    return (key[0] * 0x9E3779B97F4A7C15 >> 29) & 0x7FFFFFFF


def _cut(seed: int, rate: int, spm: int, size: int):  # noqa: ANN202
    """Rows to pieces ((row, position), payload), in the order of the text; position 0 has what belongs to the row."""

    def run(partition: int, rows) -> Iterator[tuple]:  # noqa: ANN001
        for k, (doc_id, text) in enumerate(rows):
            row, data = (partition << 33) + k, (text or "").encode("utf-8", "replace")
            n, form, low, high, ends = plan(doc_id, data, seed, rate, spm)
            plain = form == "plain"
            yield (row, 0), (doc_id, n, form, None if plain else code_points(data[:low]), None if plain else code_points(data[low:high]))
            ranges = {0: (0, low), 1: (low, high), 2: (high, len(data))}
            places = {part: (rank, mark) for rank, (mark, part) in enumerate(FORMS[form], 1)}
            for part in sorted(places):
                rank, mark = places[part]
                if mark:
                    yield (row, rank << _SEQ), mark.encode()
                for seq, piece in enumerate(chunks(data, *ranges[part], ends, size), 1):
                    yield (row, (rank << _SEQ) + seq), piece

    return run


def _assemble(keep_text: bool):  # noqa: ANN202
    """Pieces in output order to their digest and, from the output alone, to pieces by place in the text."""

    def run(pieces) -> Iterator[tuple]:  # noqa: ANN001
        row, about, digest, restorer, held, seq = None, None, None, None, [], 0

        def close() -> Iterator[tuple]:
            nonlocal seq
            for part, data in restorer.rest():
                yield (row, (part + 1 << _SEQ) + seq), data
            yield (row, 0), (*about, digest.hexdigest(), *([b"".join(held).decode("utf-8", "replace")] if keep_text else []))

        for (own, position), payload in pieces:
            if position == 0:
                if about is not None:
                    yield from close()
                row, about, digest, restorer, held, seq = own, payload, hashlib.sha256(), Restorer(payload[2]), [], 0
                continue
            digest.update(payload)
            if keep_text:
                held.append(payload)
            for part, data in restorer.feed(payload):
                yield (row, (part + 1 << _SEQ) + seq), data
                seq += 1
        if about is not None:
            yield from close()

    return run


def _restore(keep_text: bool):  # noqa: ANN202
    """Pieces in the order of the text to one row for each example."""

    def out(about: tuple, digest) -> tuple:  # noqa: ANN001
        return (*about[:6], digest.hexdigest(), *about[6:])

    def run(pieces) -> Iterator[tuple]:  # noqa: ANN001
        about, digest = None, None
        for (_, position), payload in pieces:
            if position == 0:
                if about is not None:
                    yield out(about, digest)
                about, digest = payload, hashlib.sha256()
            else:
                digest.update(payload)
        if about is not None:
            yield out(about, digest)

    return run


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, chunk: int = CHUNK, keep_text: bool = True) -> DataFrame:
    """documents (doc_id, text) to examples: units, form, lengths of prefix and middle, digests of the output and of the text restored from it[, output].

    ``rate`` percent of the documents become examples, of these ``spm``
    percent with the suffix first; the others, and texts that hold a sentinel, stay plain.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = -(-total // PARTITION_BYTES) or 1
    pieces = rows.rdd.mapPartitionsWithIndex(_cut(seed, rate, spm, chunk)).repartitionAndSortWithinPartitions(parts, _home)
    again = pieces.mapPartitions(_assemble(keep_text), preservesPartitioning=True).repartitionAndSortWithinPartitions(pieces.getNumPartitions(), _home)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * keep_text
    return docs.sparkSession.createDataFrame(again.mapPartitions(_restore(keep_text)), schema, verifySchema=False)
