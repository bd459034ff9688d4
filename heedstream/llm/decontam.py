"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and every run of ASCII characters
other than letters and digits becomes one space; other characters stay. An item of n characters has an
error budget e = floor(rate * n) and is split into e + 1 pieces: if some
stretch of a text is within e edits of the item, at least one piece occurs
in it unchanged. An automaton finds all piece hits in whole texts. A hit is
verified with Myers' bit-parallel edit distance, first together with its
neighbour pieces and then in ever larger parts of the item: j pieces with at
most j - 1 edits always have a half of which the same holds, so a hit whose
surroundings fail on the way up belongs to no match. The whole item's
distance decides.

Null and empty texts match nothing, as do items without letters or digits
and items without an id. An item of fewer than ten characters has no budget
and is found inside other words too; ``least_chars`` leaves out items of
fewer characters (none by default). Items with equal ids are reported under
their id with the least distance, documents with equal ids (or none) once
under their id; the size of the blocks changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedstream.llm._common import lean

#: Share of an item's characters that may be edited.
RATE = 0.1
#: Characters of items that one pass holds in memory; more items take more passes.
BLOCK_CHARS = 4_000_000


_BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalise(text: str | None) -> str:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split()).decode("utf-8", "surrogatepass") if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Pattern:
    """Myers' algorithm for one item: the least distance to any stretch of a text."""

    def __init__(self, item: str) -> None:
        self.n, self.top, self.full = len(item), 1 << (len(item) - 1), (1 << len(item)) - 1
        self.at: dict[str, int] = {}
        for i, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def least(self, text: str, enough: int = 0) -> int:
        up, down, score, best, full, top, at = self.full, 0, self.n, self.n, self.full, self.top, self.at
        for c in text:
            eq = at.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            hp = down | ~(xh | up) & full
            hn = up & xh
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
                if score < best:
                    best = score
                    if best <= enough:
                        return best
            hp = hp << 1 & full
            hn = hn << 1 & full
            up = hn | ~(xv | hp) & full
            down = hp & xv
        return best


def climb(first: int, end: int) -> dict[int, list[tuple[int, int]]]:
    """For each piece the runs of pieces that hold it, from the smallest up to [first, end)."""
    if end - first == 1:
        return {first: []}
    middle = (first + end) // 2
    return {k: [*runs, (first, end)] for half in (climb(first, middle), climb(middle, end)) for k, runs in half.items()}


class Item:
    """A test item: its pieces, its budget and the parts that a hit is verified with."""

    def __init__(self, item_id: int, text: str, rate: float) -> None:
        self.item_id, self.text = item_id, text
        self.budget = math.floor(rate * len(text))
        self.pieces = pieces(text, self.budget)
        self.whole = Pattern(text)
        self.parts: dict[tuple[int, int], Pattern] = {}
        ends = [*(offset for offset, _ in self.pieces), len(text)]
        self.ways = {k: [(ends[a], ends[b], b - a - 1, (a, b)) for a, b in runs[:-1]] for k, runs in climb(0, len(self.pieces)).items()}
        # what surrounds a piece in its smallest part has at most the part's edits: one of so many and one stretches is unchanged
        self.near = {k: [x for lo, hi in ((way[0][0], ends[k]), (ends[k + 1], way[0][1])) if hi > lo for _, x in pieces(text[lo:hi], way[0][2])] for k, way in self.ways.items() if way}

    def part(self, key: tuple[int, int], a: int, b: int) -> Pattern:
        if key not in self.parts:
            self.parts[key] = Pattern(self.text[a:b])
        return self.parts[key]

    def passes(self, text: str, start: int, k: int) -> bool:
        """Whether the parts around piece k, hit where the item would begin at ``start``, keep to their budgets."""
        if way := self.ways[k]:
            a, b, budget, _ = way[0]
            stretch = text[max(0, start + a - budget) : start + b + budget]
            for x in self.near[k]:
                if x in stretch:
                    break
            else:
                return False
        for a, b, budget, key in self.ways[k]:
            if self.part(key, a, b).least(text[max(0, start + a - budget) : start + b + budget], budget) > budget:
                return False
        return True


class Matcher:
    def __init__(self, items: list[tuple[int, str | None]], rate: float) -> None:
        import ahocorasick

        self.items: list[Item] = []
        found: dict[str, list[tuple[int, int, int]]] = {}
        for item_id, raw in items:
            if form := normalise(raw):
                item = Item(item_id, form, rate)
                for k, (offset, piece) in enumerate(item.pieces):
                    found.setdefault(piece, []).append((len(self.items), offset, k))
                self.items.append(item)
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def match(self, text: str | None) -> dict[int, tuple[int, int]]:
        """item id -> (least distance, budget) within one normalised text."""
        out: dict[int, tuple[int, int]] = {}
        if self.empty or not text:
            return out
        seen: dict[int, list[int]] = {}
        best: dict[int, int] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for n, offset, k in owners:
                if best.get(n) == 0:
                    continue
                item, start = self.items[n], end + 1 - size - offset
                budget = item.budget
                if any(-budget <= start - s <= budget for s in seen.get(n, ())):
                    continue
                if text.startswith(item.text, start) if start >= 0 else False:
                    best[n] = 0
                    continue
                if not item.passes(text, start, k):
                    continue
                # wide enough for every hit within the budget of this one
                seen.setdefault(n, []).append(start)
                distance = item.whole.least(text[max(0, start - 2 * budget) : start + len(item.text) + 2 * budget])
                if distance <= budget:
                    best[n] = min(distance, best.get(n, distance))
        for n, distance in best.items():
            item = self.items[n]
            if distance < out.get(item.item_id, (distance + 1, 0))[0]:
                out[item.item_id] = (distance, item.budget)
        return out


def _blocks(benchmark: DataFrame, block_chars: int, least_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_chars`` characters; each block travels with the tasks of its own pass."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    for block in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect() if len(normalise(r[1])) >= least_chars]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, least_chars: int = 1) -> DataFrame:
    """Rows (doc_id, item_id, distance, budget) of texts that hold an item within its budget, one for each pair of ids."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    out = None
    for own in _blocks(benchmark, block_chars, least_chars):
        part = source.mapInArrow(lean(_scan(own, rate)), "doc_id long, item_id long, distance int, budget int")
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "budget")).alias("m")).select("doc_id", "item_id", "m.*")


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for x in batch.column("text"):
        yield normalise(x.as_py())


def _scan(items: list[tuple[int, str]], rate: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in batches:
            rows = [(d, i, *found) for d, t in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True) for i, found in matcher.match(t).items()]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "budget"])

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, least_chars: int = 1) -> DataFrame:
    """The documents that hold no item within its budget, whole and with all their columns; nothing is shuffled."""
    out = docs
    for own in _blocks(benchmark, block_chars, least_chars):
        out = out.mapInArrow(lean(_clean(own, rate)), docs.schema)
    return out


def _clean(items: list[tuple[int, str]], rate: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.match(t) for t in _texts(batch)], pa.bool_()))

    return run
