"""Suffix-array dedup: remove every byte of a string of ``WIDTH`` bytes that also starts earlier.

Texts are UTF-8 bytes. A window is a string of ``WIDTH`` bytes inside one
text; it repeats if an equal window starts earlier (smaller id, or the same
text and an earlier start). All bytes of repeating windows are removed;
windows are judged on the input.

Sorting the suffix at every byte would shuffle a hundred times the text, so
suffixes are anchored. The anchor of a window is the least hashed gram of
``GRAM`` bytes inside it, leftmost first, which depends on nothing but the
window: equal windows have equal anchors at equal distances. Windows that
follow each other and share an anchor make one segment.

1. Segments are range-partitioned (Spark samples the splitters) and sorted
   by anchor gram and content digest. A gram that occurs once ends here:
   none of its windows repeats. Of segments with equal content all but the
   earliest repeat whole; content is equal where the 64-bit hash of the gram
   and a 64-bit digest of the bytes, their number and the anchor's place agree.
2. The earliest segments of grams with several contents are the suffixes
   that remain. They are range-partitioned by the leading tokens of the
   suffix at their anchor, again with sampled splitters; a gram of more than
   ``HOT_GRAM`` segments is first split into parts by id, so that it is
   spread over buckets. Each bucket sorts its windows by multikey quicksort
   over 8-byte tokens and compares neighbours byte for byte.
3. Only the parts of a split gram go on in other buckets: what is left of
   their windows is compared across the boundaries by its bytes.

Null and empty texts have no bytes and lose none. Rows that repeat an id
with another text are ordered by a hash of the text; rows equal in both are
one document and have the same result. Rows without an id are documents of
their own, even where their texts are equal, and come after all others in the
order of a number that they are given. Long texts are taken whole, their
windows in stretches of ``STRETCH`` starts; a segment that a stretch cuts is
two segments. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedstream.llm._common import lean, mix, prefix_sums, range_hash, stage_table, text_chunks

WIDTH, GRAM = 100, 32
#: Rows, and windows, that a task works on at a time.
SCAN_ROWS, SORT_WINDOWS = 200_000, 100_000
#: Segments of one gram from which on it is split; up to so many such grams are broadcast, more are joined.
HOT_GRAM, HOT_LIST = 20_000, 100_000
#: Starts of windows that are anchored at a time, and the bits that hold a place among them.
STRETCH, PLACE_BITS = 1 << 19, 21
#: Stands for the id of rows that have none; their ``tx`` tells them from a row of this id.
LAST = (1 << 63) - 1


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, in three passes."""
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a chunk that is one long text into (first byte, bytes, offsets) that overlap by all but one byte of a window."""
    if len(offsets) > 2 or len(data) < STRETCH + width:
        yield 0, data, offsets
        return
    for at in range(0, len(data) - width + 1, STRETCH):
        own = data[at : at + STRETCH + width - 1]
        yield at, own, np.array([0, len(own)])


def segments(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of a chunk: (text, start in the text, windows, anchor's distance, gram hash, content digest)."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none, none, none
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    hashes = range_hash(sums, at, at + gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    anchor = (sliding_min((hashes & ~low) | at.astype(np.uint64), width - gram + 1) & low).astype(np.int64)
    size = np.diff(offsets)
    # windows that reach over the end of their text
    cross = np.zeros(len(data) + 1, dtype=np.int32)
    tail = np.minimum(size, width - 1)
    np.add.at(cross, offsets[1:] - tail, 1)
    np.add.at(cross, offsets[1:], -1)
    inside = np.cumsum(cross[: len(anchor)]) == 0
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new)
    if not len(start):
        return none, none, none, none, none, none
    last = inside.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    count = np.flatnonzero(last) - start + 1
    own = anchor[start]
    text = np.searchsorted(offsets, start, side="right") - 1
    digest = range_hash(sums, start, start + count + (width - 1)) + mix((count * 4096 + own - start).astype(np.uint64))
    return text, start - offsets[text], count, own - start, hashes[own].view(np.int64), mix(digest).view(np.int64)


def multikey_sort(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of 8-byte tokens, and where a row equals the one before it.

    Rows are ordered by their first token; only rows that still tie are
    ordered by the next one, group by group. Ties of whole rows keep their order.
    """
    n, width = tokens.shape
    order = np.argsort(tokens[:, 0], kind="stable")
    same = np.zeros(n, dtype=bool)
    same[1:] = tokens[order[1:], 0] == tokens[order[:-1], 0]
    for k in range(1, width):
        active = same.copy()
        active[:-1] |= same[1:]
        place = np.flatnonzero(active)
        if not len(place):
            break
        group = np.cumsum(~same[place])
        rows = order[place]
        value = tokens[rows, k]
        inner = np.lexsort((value, group))
        rows, value = rows[inner], value[inner]
        order[place] = rows
        still = same[place]
        still[1:] &= value[1:] == value[:-1]
        same[place] = still
    return order, same


def _sorted_chunks(batches: Iterator[pa.RecordBatch], key: list[str], limit: int, weight: Callable[[pa.Table], int], edges: bool = True) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Chunks of a sorted partition, cut between keys where that is possible.

    With each chunk: whether its first and its last key may go on elsewhere;
    with ``edges`` those at the partition's ends may.
    """
    held: pa.Table | None = None
    first = edges
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if weight(held) < limit:
            continue
        held = held.combine_chunks()
        columns = [held.column(c).to_numpy() for c in key]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        if len(change):
            cut = int(change[-1]) + 1
            yield held.slice(0, cut), first, False
            held, first = held.slice(cut), False
        elif weight(held) >= 4 * limit:
            yield held, True, True
            held, first = None, True
    if held is not None and held.num_rows:
        yield held.combine_chunks(), first, edges


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by (gram, digest, place) to those that repeat whole (kind 0) and those to be sorted as suffixes (kind 1)."""
    for chunk, open_first, open_last in _sorted_chunks(batches, ["h"], SCAN_ROWS, lambda t: t.num_rows):
        h, g = chunk.column("h").to_numpy(), chunk.column("g").to_numpy()
        new_h = np.ones(len(h), dtype=bool)
        new_h[1:] = h[1:] != h[:-1]
        new_g = new_h.copy()
        new_g[1:] |= g[1:] != g[:-1]
        group = np.cumsum(new_h) - 1
        contents = np.bincount(group, new_g)
        wide = contents > 1
        wide[0] |= open_first
        wide[-1] |= open_last
        kind = np.where(new_g, np.where(wide[group], 1, -1), 0)
        keep = kind >= 0
        out = chunk.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*(out.column(c).combine_chunks() for c in ("doc_id", "tx", "s", "n", "o", "h")), pa.array(kind[keep].astype(np.int32))], ["doc_id", "tx", "s", "n", "o", "h", "kind"])


def _runs(doc: np.ndarray, tx: np.ndarray, p: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Byte ranges (doc, tx, start, end) of window starts, neighbours joined."""
    order = np.lexsort((p, tx, doc))
    doc, tx, p = doc[order], tx[order], p[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tx[1:] != tx[:-1]) | (p[1:] > p[:-1] + width)
    at = np.flatnonzero(new)
    end = np.append(at, len(p))[1:] - 1
    return doc[at], tx[at], p[at], p[end] + width


def _sort_windows(width: int):  # noqa: ANN202
    """Buckets of segments sorted by leading tokens to the repeating ranges of a text (w null) and windows to be compared across boundaries."""
    names = ["doc_id", "tx", "ranges", "lo", "w"]
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, open_first, open_last in _sorted_chunks(batches, ["t0", "t1", "h", "part"], SORT_WINDOWS, lambda t: int(np.sum(t.column("n").to_numpy())), edges=False):
            n = chunk.column("n").to_numpy().astype(np.int64)
            keys = [chunk.column(c).to_numpy() for c in ("t0", "t1", "h", "part")]
            opened = keys[3] >= 0  # a part of a split gram
            if open_first:
                opened |= np.logical_and.reduce([k == k[0] for k in keys])
            if open_last:
                opened |= np.logical_and.reduce([k == k[-1] for k in keys])
            segment = chunk.column("segment").combine_chunks()
            offsets = np.frombuffer(segment.buffers()[1], np.int32)[segment.offset : segment.offset + len(segment) + 1].astype(np.int64)
            flat = np.concatenate([np.frombuffer(segment.buffers()[2], np.uint8), np.zeros(8, np.uint8)])
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            doc = chunk.column("doc_id").to_numpy()[row]
            tx = chunk.column("tx").to_numpy()[row]
            p = chunk.column("s").to_numpy()[row].astype(np.int64) + step
            place = np.lexsort((p, tx, doc))
            row, step, doc, tx, p = row[place], step[place], doc[place], tx[place], p[place]
            words = -(-width // 8)
            grid = np.lib.stride_tricks.sliding_window_view(flat, words * 8)[offsets[row] + step]
            grid[:, width:] = 0
            order, same = multikey_sort(np.ascontiguousarray(grid).view(">u8").astype(np.uint64))
            repeats = order[same]
            d, t, lo, hi = _runs(doc[repeats], tx[repeats], p[repeats], width)
            # one row for each text of the chunk
            new = np.ones(len(d), dtype=bool)
            new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
            at = np.flatnonzero(new)
            ranges = pa.ListArray.from_arrays(pa.array(np.append(at, len(d)), pa.int32()), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"]))
            yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(t[at]), ranges.cast(kind), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())], names)
            left = order[~same]
            left = left[opened[row[left]]]
            if len(left):
                w = pa.array([x.tobytes() for x in grid[left, :width]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc[left]), pa.array(tx[left]), pa.nulls(len(left), kind), pa.array(p[left]), w], names)

    return run


def _cut_segments(width: int):  # noqa: ANN202
    """Texts with their places of segments to rows of segments with the leading tokens of the suffix at the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a batch out for each text: its segments are about as long as the text
            for doc, tx, text, places in zip(*(batch.column(c) for c in ("doc_id", "tx", "text", "places")), strict=True):
                data = text.as_py().encode()
                flat = places.values
                s, n, o, h, part = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                lead = np.array([list(data[a : a + 16].ljust(16, b"\0")) for a in (s + o).tolist()], dtype=np.uint8).reshape(-1, 16).view(">u8").astype(np.uint64)
                lead ^= np.uint64(1 << 63)  # signed order is byte order
                cut = pa.array([data[a : a + k] for a, k in zip(s.tolist(), (n + (width - 1)).tolist(), strict=True)], pa.binary())
                m = len(s)
                yield pa.RecordBatch.from_arrays([
                    pa.array(lead[:, 0].view(np.int64)), pa.array(lead[:, 1].view(np.int64)), pa.array(h), pa.array(part), pa.array(np.full(m, doc.as_py(), np.int64)), pa.array(np.full(m, tx.as_py(), np.int64)),
                    pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), cut,
                ], ["t0", "t1", "h", "part", "doc_id", "tx", "s", "n", "segment"])

    return run


def repeated_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Rows (doc_id, tx, ranges): byte ranges (lo, hi) of repeating windows; they may overlap, and a text may have several rows. ``docs`` has doc_id, tx, text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, txs = batch.column("doc_id"), batch.column("tx")
            for first, at, text, s, n, o, h, g in ((first, at, *segments(part, ends, width, gram)) for first, _, data, offsets in text_chunks(batch, "text") for at, part, ends in stretches(data, offsets, width)):
                rows, s = pa.array(text + first), s + at
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), ids.take(rows), txs.take(rows), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(o.astype(np.int16))], ["h", "g", "doc_id", "tx", "s", "n", "o"])

    anchored = stage_table(docs.mapInArrow(lean(cut), "h long, g long, doc_id long, tx long, s int, n short, o short"), "segments")
    ordered = anchored.repartitionByRange("h", "g", "doc_id", "tx", "s").sortWithinPartitions("h", "g", "doc_id", "tx", "s")
    decided = stage_table(ordered.mapInArrow(lean(_collapse), "doc_id long, tx long, s int, n short, o short, h long, kind int"), "decided", [anchored])
    span = lambda lo, hi: F.array(F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))).alias("ranges")
    whole = decided.where("kind = 0").select("doc_id", "tx", span(F.col("s"), F.col("s") + F.col("n") + (width - 1)))

    left = decided.where("kind = 1")
    hot = stage_table(left.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > HOT_GRAM), "hot")
    hot = F.broadcast(hot) if hot.count() <= HOT_LIST else hot
    # -1: the gram is whole in one bucket
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("m") / HOT_GRAM)), F.lit(-1)).cast("int").alias("part")
    left = left.join(hot, "h", "left").select("doc_id", "tx", "s", "n", "o", "h", part)
    places = left.groupBy("doc_id", "tx").agg(F.collect_list(F.struct("s", "n", "o", "h", "part")).alias("places"))
    rest = stage_table(docs.join(places, ["doc_id", "tx"]).select("doc_id", "tx", "text", "places").mapInArrow(lean(_cut_segments(width)), "t0 long, t1 long, h long, part int, doc_id long, tx long, s int, n int, segment binary"), "suffixes")
    key = ["t0", "t1", "h", "part"]
    ordered = rest.repartitionByRange(*key).sortWithinPartitions(*key, "doc_id", "tx", "s")
    compared = stage_table(ordered.mapInArrow(lean(_sort_windows(width)), "doc_id long, tx long, ranges array<struct<lo:bigint,hi:bigint>>, lo long, w binary"), "compared", [rest])
    inside = compared.where("w is null").select("doc_id", "tx", "ranges")
    across = compared.where("w is not null")
    first = across.groupBy("w").agg(F.min(F.struct("doc_id", "tx", "lo")).alias("first"), F.count("*").alias("times")).where("times > 1")
    over = across.join(first.select("w", "first"), "w").where(F.struct("doc_id", "tx", "lo") != F.col("first")).select("doc_id", "tx", span(F.col("lo"), F.col("lo") + width))
    return whole.unionByName(inside).unionByName(over)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the ranges of each text."""
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        rows = []
        for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
            data = (text.as_py() or "").encode()
            spans: list[list[int]] = []
            if ranges.is_valid:
                flat = ranges.values
                lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                order = np.argsort(lo, kind="stable")
                for a, b in zip(lo[order].tolist(), hi[order].tolist(), strict=True):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
            at, kept = 0, []
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            left = b"".join(kept)
            # a range can begin or end inside a character: characters that lost a byte are left out of the text
            clean = b"".join(k.decode("utf-8", "ignore").encode() for k in kept) if spans else left
            rows.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"lo": a, "hi": b} for a, b in spans], clean.decode() if text.is_valid else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.string())
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "tx", "carried")), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "tx", "carried", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"])


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Rows (doc_id, tx, carried, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_text), one for each row of docs.

    ``carried`` is a struct of the other columns of docs, whatever their
    names. Spans are bytes, from 0, end exclusive. ``tx`` is 0, or a hash of the
    text where an id occurs in several rows, or the number of a row without id.
    """
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))).alias("carried"))
    odd = full.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    twice, nameless = (bool(x) for x in odd.agg(F.max(F.expr("doc_id is not null")), F.max(F.expr("doc_id is null"))).first())
    named = (full.where("doc_id is not null") if nameless else full).select("doc_id", (F.xxhash64("text") if twice or nameless else F.lit(0)).cast("long").alias("tx"), "text", "carried")
    own = named.select("doc_id", "tx", "text").where("text is not null")
    own = own.dropDuplicates(["doc_id", "tx"]) if twice else own
    parts = [named]
    if nameless:
        # written once, so that the numbers stay
        parts.append(stage_table(full.where("doc_id is null").select(F.lit(LAST).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("tx"), "text", "carried"), "nameless"))
        own = own.unionByName(parts[1].select("doc_id", "tx", "text").where("text is not null"))
    ranges = repeated_ranges(own, width, gram).groupBy("doc_id", "tx").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    schema = f"doc_id long, tx long, carried {full.schema['carried'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:bigint,hi:bigint>>, kept_text string"
    out = [part.join(ranges, ["doc_id", "tx"], "left").select("doc_id", "tx", "text", "ranges", "carried").mapInArrow(lean(_apply), schema) for part in parts]
    return out[0].unionByName(out[1].withColumn("doc_id", F.lit(None).cast("long"))) if nameless else out[0]
