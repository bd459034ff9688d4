"""License scans: MinHash bands over overlapping text windows, then exact containment.

Letters are lower-cased (A-Z), every other ASCII character that is no digit
separates words, and a text is its sequence of ``width``-word shingles. A
template of s shingles is looked for in windows of 2s shingles that start
every s shingles, so any s shingles in a row lie in one window whole. If at
least ``least`` of the template's shingles stand together there, the
Jaccard similarity of window and template is at least least / (3 - least),
as both together have at most 2s + s - least * s shingles; the number of
one-row bands is set from that bound so that a window that holds the template
is missed with a probability under ``miss``. Only windows with as many known
shingles (of any template) as the smallest template of the size needs are
banded; no other window can hold one. Retrieved windows are verified by the
exact share of the template's shingles that they hold.

Templates with fewer words than ``width`` have their whole word sequence as
one shingle of that length. Null and empty texts and templates match
nothing. A template id may have several texts; repeated documents give a
row each id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedstream.llm._common import lean, mix, text_chunks
from heedstream.llm.shingles import shingle_hashes, words

#: Short notices of widely used licenses.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

#: Templates that one pass holds; more take more passes.
BLOCK_TEMPLATES = 10_000
_BLANK = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalnum():
        _BLANK[_c] = 32


def bands_for(least: float, miss: float) -> int:
    """One-row bands so that a window of 2s shingles with ``least`` * s of a template's s is missed with probability under ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - least / (3 - least)))


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    word, _, _, first = words(_BLANK[np.frombuffer(b"".join(raw), np.uint8)], offsets)
    return word, first


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], width: int, least: float, miss: float) -> None:
        word, first = _words([t for _, t in templates])
        self.least, self.bands = least, bands_for(least, miss)
        self.seeds = mix(np.arange(1, self.bands + 1, dtype=np.uint64))
        self.kinds: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
        for k, (name, _) in enumerate(templates):
            own = word[first[k] : first[k + 1]]
            if len(own):
                n = min(width, len(own))
                s = np.unique(shingle_hashes(own, n))
                self.kinds.setdefault((n, len(own) - n + 1), []).append((name, s))
        self.index = {kind: self._index(found) for kind, found in self.kinds.items()}
        self.known = {n: np.unique(np.concatenate([s for (m, _), found in self.kinds.items() if m == n for _, s in found])) for n, _ in self.kinds}

    def _index(self, found: list[tuple[str, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for seed in self.seeds:
            least = np.array([mix(s ^ seed).min() for _, s in found])
            order = np.argsort(least, kind="stable")
            out.append((least[order], order))
        return out

    def _shingles(self, word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of a chunk, which of them lie in one text, and running counts of those known from templates."""
        every = shingle_hashes(word, n)
        # shingles that reach over the end of a text hold no window's place: they are made unlike any other
        alive = np.ones(len(every), dtype=bool)
        for k in range(1, n):
            cut = first[1:-1] - k
            alive[cut[(cut >= 0) & (cut < len(every))]] = False
        known = self.known[n]
        met = alive & (known[np.minimum(np.searchsorted(known, every), len(known) - 1)] == every)
        return every, alive, np.concatenate([[0], np.cumsum(met)])

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, int, int, float]]:
        """(text, license, start byte, end byte, containment) of verified windows of a chunk."""
        word, start, end, first = words(_BLANK[data], offsets)
        out: list[tuple[int, str, int, int, float]] = []
        made = {n: self._shingles(word, first, n) for n in self.known}
        most = np.iinfo(np.uint64).max
        for (n, s), found in self.kinds.items():
            every, alive, upto = made[n]
            if not len(every):
                continue
            begin = np.arange(0, len(every), s)
            some = upto[np.minimum(begin + 2 * s, len(every))] - upto[begin]
            wins = np.flatnonzero(some >= self.least * min(len(own) for _, own in found))
            candidates: set[tuple[int, int]] = set()
            step = max(1, (1 << 20) // (2 * s))
            for part in (wins[at : at + step] for at in range(0, len(wins), step)):
                place = part[:, None] * s + np.arange(2 * s)
                inside = place < len(every)
                place = np.minimum(place, len(every) - 1)
                inside &= alive[place]
                held = every[place]
                for seed, (values, order) in zip(self.seeds, self.index[n, s], strict=True):
                    window = np.where(inside, mix(held ^ seed), most).min(axis=1)
                    a = np.searchsorted(values, window, "left")
                    hit = np.flatnonzero((a < len(values)) & (values[np.minimum(a, len(values) - 1)] == window))
                    for w in hit.tolist():
                        b = int(a[w])
                        while b < len(values) and values[b] == window[w]:
                            candidates.add((int(part[w]), int(order[b])))
                            b += 1
            for w, t in candidates:
                name, own = found[t]
                place = np.flatnonzero(np.isin(every[w * s : (w + 2) * s], own) & alive[w * s : (w + 2) * s]) + w * s
                if not len(place):
                    continue
                text = np.searchsorted(first, place, "right") - 1
                for d in np.unique(text):
                    p = place[text == d]
                    share = len(np.unique(every[p])) / len(own)
                    if share >= self.least:
                        out.append((int(d), name, int(start[p[0]] - offsets[d]), int(end[p[-1] + n - 1] - offsets[d]), share))
        return out


def scan(docs: DataFrame, templates: DataFrame | list[tuple[str, str]] = TEMPLATES, width: int = 5, least: float = 0.8, miss: float = 1e-5) -> DataFrame:
    """Rows (doc_id, license, n_windows, first_byte, end_byte, containment), one for each document and license."""
    blocks = [templates] if isinstance(templates, list) else _blocks(templates)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    out = None
    for block in blocks:
        part = source.mapInArrow(lean(_run(block, width, least, miss)), "doc_id long, license string, first_byte long, end_byte long, containment double")
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "license").agg(F.count_distinct("first_byte", "end_byte").alias("n_windows"), F.min("first_byte").alias("first_byte"), F.max("end_byte").alias("end_byte"), F.max("containment").alias("containment"))


def _blocks(templates: DataFrame) -> Iterator[list[tuple[str, str]]]:
    rows = templates.select("license", "text").where("text is not null")
    n = max(1, math.ceil(rows.count() / BLOCK_TEMPLATES))
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("license", "text"), F.lit(n)) == k).collect()]


def _run(templates: list[tuple[str, str]], width: int, least: float, miss: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, width, least, miss)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
        for batch in batches:
            ids = batch.column("doc_id")
            for first, _, data, offsets in text_chunks(batch, "text"):
                rows = [(ids[first + d].as_py(), *rest) for d, *rest in scanner.scan(data, offsets)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license", "first_byte", "end_byte", "containment"])

    return run
