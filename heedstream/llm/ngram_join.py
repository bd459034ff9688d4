"""N-gram Jaccard join: which texts share enough of their word shingles.

Texts are lower-cased (A-Z); words are runs without white space; a text's
set is its distinct five-word shingles (with fewer words the whole sequence
is the only one). Texts link when 100 * |A & B| >= percent * |A | B|.

1. Texts with equal sets form one class, represented by its smallest id.
2. Each class meets the first class of the tiles of its eight least shingle
   hashes; the met pair is compared exactly. Links join classes, so that a
   group of copies that all resemble its first member is settled in a number
   of comparisons that grows with its size and not with its square.
3. Nothing may be missed: two sets that link share one of the first
   n - ceil(percent * n / 100) + 1 shingles of each, in any order that all
   sets have in common. The order puts shingles that very many documents have
   last: a table of fixed size holds, by the hash's place, how common its
   shingles are (``PLACES`` levels, counted over all documents). It needn't be
   exact, since any common order is right, and keeps the lines and passages
   that a corpus repeats out of the tiles. Tiles of these prefixes that hold classes not yet joined are ordered by set size, which bands
   them: a class meets only classes of a size that can link. A signature
   has a bit for each of its places, flipped by every shingle hashed there;
   the bits in which two signatures differ are at most the shingles of one
   set alone, so their count bounds the overlap from above. Tiles carry
   1024 bits; large sets have longer signatures (at least a bit for two
   shingles) that are compared next, folded to one length. What may still
   link is compared exactly, by intersecting the sorted hash arrays of the
   whole texts.

Sets are kept as 64-bit hashes of their shingles. Null or empty texts have
empty sets, link with nothing and are their own component. An empty table
gives no rows.

The nodes of the graph are rows. Where every id is there once, the id is the
row's key; where ids are null or repeated, it is a 64-bit hash of id and text.
Rows that repeat an id with another text are judged by their own text. A
component is named after its smallest id, and is null if none of its rows has
an id. ``keep_first`` keeps of each component one row, that of the smallest id
(null ids are last; of rows of one id the one of the smallest key, of rows equal
in id and text any one), and every row without shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedstream.llm._common import components, lean, mix, stage_table, text_chunks
from heedstream.llm.shingles import shingle_hashes, shingle_sets, words

#: Words of a shingle, least similarity in percent, bits of a tile's signature, hashes of the first meeting.
WIDTH, PERCENT, BITS, HEAD = 5, 80, 1024, 8
#: Places of the table of common shingles; its size is fixed, one byte for each.
PLACES = 1 << 22
#: Rows of a tile that are compared in one task; larger tiles are cut into blocks, and block meets block.
TILE_ROWS = 16_384


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def describe(data: np.ndarray, offsets: np.ndarray, width: int, percent: int, levels: np.ndarray) -> tuple:
    """For each text: set size, two set keys, least hashes and prefix (values, offsets each), signature bytes, longer signature or None."""
    value, ends = shingle_sets(data, offsets, width)
    n = np.diff(ends)
    some = np.flatnonzero(n)
    keys = np.zeros((2, len(n)), dtype=np.uint64)
    if len(some):
        begin = ends[:-1][some]
        for k in range(2):
            keys[k, some] = np.add.reduceat(mix(value ^ np.uint64(0xABCD0001 + k)), begin)
    owner = np.repeat(np.arange(len(n)), n)
    small = _parities(value, owner, np.full(len(n), BITS))
    bits = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) >> 1)
    large = _parities(value, owner, bits)
    ranked = value[np.argsort(owner * 256 + levels[(value & np.uint64(PLACES - 1)).astype(np.int64)], kind="stable")]
    head, prefix = _firsts(value, ends, np.minimum(n, HEAD)), _firsts(ranked, ends, np.where(n > 0, prefix_length(n, percent), 0))
    return n, keys, head, prefix, small, [x if b > BITS else None for x, b in zip(large, bits.tolist(), strict=True)]


def _firsts(value: np.ndarray, ends: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``take`` values of each owner: (values, offsets)."""
    upto = np.concatenate([[0], np.cumsum(take)])
    return value[np.arange(upto[-1]) - np.repeat(upto[:-1] - ends[:-1], take)], upto


def _common(docs: DataFrame, width: int) -> np.ndarray:
    """How common the shingles of each place are: 0, or the binary order of their number over all documents.

    A task hands on the places at which it meets clearly more shingles than
    chance puts there; sums by place, at most ``PLACES`` of them, reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PLACES, dtype=np.int64)
        total = 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch, "text"):
                every = shingle_hashes(words(data, offsets)[0], width)
                np.add.at(counts, (every & np.uint64(PLACES - 1)).astype(np.int64), 1)
                total += len(every)
        mean = total / PLACES
        at = np.flatnonzero(counts > 8 + mean + 8 * mean**0.5)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["place", "n"])

    found = docs.select("text").mapInArrow(lean(run), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    levels = np.zeros(PLACES, dtype=np.uint8)
    levels[found["place"].to_numpy(np.int64)] = np.ceil(np.log2(found["n"].to_numpy(np.float64)))
    return levels


def _parities(value: np.ndarray, owner: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """Parity bitmaps of each owner's values; ``bits`` are powers of two."""
    begin = np.concatenate([[0], np.cumsum(bits)])
    place = begin[owner] + (value & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(begin[-1])) & 1).astype(np.uint8), bitorder="little")
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two signatures differ, the longer one folded to the shorter one's length."""
    short, full = (a, b) if len(a) <= len(b) else (b, a)
    x, size = int.from_bytes(full, "little"), len(full) * 8
    while size > len(short) * 8:
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ int.from_bytes(short, "little")).bit_count()


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    levels = docs.sparkSession.sparkContext.broadcast(_common(docs, width))
    hashes = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch, "text"):
                n, keys, head, prefix, small, large = describe(data, offsets, width, percent, levels.value)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[first:end], pa.array(n, pa.int32()), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                    hashes(*head), hashes(*prefix), pa.array(small, pa.binary()), pa.array(large, pa.binary()),
                ], ["doc_id", "n", "k1", "k2", "head", "prefix", "signature", "long_signature"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(lean(run), "doc_id long, n int, k1 long, k2 long, head array<long>, prefix array<long>, signature binary, long_signature binary")


def _ends(pairs: DataFrame, name: str) -> DataFrame:
    """The distinct ids of pairs (a, b); each side is made distinct before the two are put together."""
    return pairs.select(F.col("a").alias(name)).distinct().union(pairs.select("b").distinct()).distinct()


def _may_link(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and full signatures allow."""
    side = sets.select("doc_id", "n", F.coalesce("long_signature", "signature").alias("s")).join(_ends(pairs, "doc_id"), "doc_id", "left_semi")
    left = pairs.select("a", "b").join(side.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
    both = left.join(side.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b").where(f"{percent} * greatest(na, nb) <= 100 * least(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (100 - percent) * (batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()) // (100 + percent)
            keep = [differing_bits(x.as_py(), y.as_py()) <= m for x, y, m in zip(batch.column("sa"), batch.column("sb"), most.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(run), "a long, b long").distinct()


def _linked(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose whole texts link."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(_ends(pairs, "id"), "id", "left_semi")
    left = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                sides = []
                for c, i in (("x", "a"), ("y", "b")):
                    # a first member meets many others: its set is made once for each slice
                    ids, place = np.unique(batch.column(i).to_numpy(), return_index=True)
                    part = batch.take(pa.array(place))
                    sets = [value[ends[k] : ends[k + 1]] for _, _, data, offsets in text_chunks(part, c) for value, ends in [shingle_sets(data, offsets, width)] for k in range(len(ends) - 1)]
                    sides.append([sets[k] for k in np.searchsorted(ids, batch.column(i).to_numpy())])
                keep = []
                for p, q in zip(*sides, strict=True):
                    place = np.searchsorted(q, p)
                    place[place == len(q)] = 0
                    common = int((q[place] == p).sum()) if len(q) else 0
                    keep.append(common > 0 and 100 * common >= percent * (len(p) + len(q) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(lean(run), "a long, b long").distinct()


_POPULATION = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def _tile_pairs(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of row pairs of one tile each that may link; rows ordered by tile and size."""
    tok, i, j, own = (table.column(c).to_numpy() for c in ("tok", "i", "j", "block"))
    n, label, rank = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "label", "rank"))
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint16).reshape(len(n), -1)
    out_a, out_b = [], []
    live = np.arange(len(n))
    lag = 0
    while len(live):
        lag += 1
        live = live[live + lag < len(n)]
        far = live + lag
        same = (tok[live] == tok[far]) & (i[live] == i[far]) & (j[live] == j[far]) & (percent * n[far] <= 100 * n[live])
        live = live[same]
        far = live + lag
        # symmetric difference that two linked sets of these sizes have at most
        most = (100 - percent) * (n[live] + n[far]) // (100 + percent)
        may = (label[live] != label[far]) & (rank[live] + rank[far] <= most) & np.where(i[live] == j[live], True, own[live] != own[far])
        a, b, most = live[may], far[may], most[may]
        for at in range(0, len(a), 1 << 15):
            p, q = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
            differ = _POPULATION[signature[p] ^ signature[q]].sum(axis=1, dtype=np.int64)
            good = differ <= most[at : at + (1 << 15)]
            out_a.append(p[good])
            out_b.append(q[good])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


class _Recent:
    """Pairs of a task without most of the repeats: two arrays of fixed size hold those met last, by a hash's place."""

    def __init__(self, places: int = 1 << 19) -> None:
        self.a, self.b = np.full(places, -1, np.int64), np.full(places, -1, np.int64)

    def new(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((b, a))
        a, b = a[order].astype(np.int64), b[order].astype(np.int64)
        first = np.ones(len(a), dtype=bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        place = (mix(a.view(np.uint64) * np.uint64(31) + b.view(np.uint64)) & np.uint64(len(self.a) - 1)).astype(np.int64)
        first &= (self.a[place] != a) | (self.b[place] != b)
        a, b, place = a[first], b[first], place[first]
        # of pairs that share a place the last one stays there, both halves of it
        last = len(place) - 1 - np.unique(place[::-1], return_index=True)[1]
        self.a[place[last]], self.b[place[last]] = a[last], b[last]
        return a, b


def _candidates(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the sizes, ranks and signatures allow, from rows sorted by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        recent = _Recent()

        def pairs(part: pa.Table) -> pa.RecordBatch:
            a, b = _tile_pairs(part, percent)
            rep = part.column("rep").to_numpy()
            a, b = recent.new(np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b]))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            part = pa.table(batch) if not isinstance(batch, pa.RecordBatch) else pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows < 4096:
                continue
            key = [held.column(c).to_numpy() for c in ("tok", "i", "j")]
            last = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key]))
            if len(last):
                cut = int(last[-1]) + 1
                yield pairs(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield pairs(held.combine_chunks())

    return tiles.mapInArrow(lean(run), "a long, b long").distinct()


def _first_meeting(heads: DataFrame) -> DataFrame:
    """For each class the class of another label that it meets in most tiles, as first or last of the tile."""
    ends = heads.groupBy("tok").agg(F.min(F.struct("label", "rep")).alias("lo"), F.max(F.struct("label", "rep")).alias("hi")).where("lo.label <> hi.label")
    met = heads.join(ends, "tok")
    met = met.select("rep", F.when(F.col("lo.label") != F.col("label"), F.col("lo.rep")).otherwise(F.col("hi.rep")).alias("other"))
    most = met.groupBy("rep", "other").agg(F.count("*").alias("times")).groupBy("rep").agg(F.max(F.struct("times", (-F.col("other")).alias("other"))).alias("m"))
    return most.select(F.least("rep", -F.col("m.other")).alias("a"), F.greatest("rep", -F.col("m.other")).alias("b")).distinct()


def _keyed(docs: DataFrame) -> DataFrame | None:
    """Rows (row, doc_id, text, carried) with a key for each id and text, or None if ids are unique and not null."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[docs[c] for c in docs.columns]).alias("carried"))
    if own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return None
    return own.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text", "carried")


def _first_rows(rows: DataFrame, width: int, percent: int, rounds: int = 1) -> DataFrame:
    """Rows (row, n_shingles, first), one for each key; ``first`` has the id and key of its component's first row."""
    unique = stage_table(rows.select("row", "doc_id", "text").dropDuplicates(["row"]), "rows")
    found = stage_table(_components(unique.select(F.col("row").alias("doc_id"), "text"), width, percent, rounds).withColumnRenamed("doc_id", "row"), "found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    first = unique.select("row", "doc_id").join(found, "row").groupBy("component_id").agg(F.min(order).alias("first"))
    return found.join(first, "component_id").select("row", "n_shingles", "first")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, rounds: int = 1) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each document."""
    rows = _keyed(docs)
    if rows is None:
        return _components(docs, width, percent, rounds)
    return rows.select("row", "doc_id").join(_first_rows(rows, width, percent, rounds), "row").select("doc_id", "n_shingles", F.col("first.id").alias("component_id"))


def _components(docs: DataFrame, width: int, percent: int, rounds: int) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of documents whose ids are unique and not null."""
    sets = stage_table(_sets(docs, width, percent), "sets")
    thin = sets.select("doc_id", "n", "k1", "k2")
    classes = thin.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"))
    member = stage_table(thin.join(classes, ["k1", "k2", "n"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")), "members")
    reps = member.where("doc_id = rep and n_shingles > 0").select("rep").distinct()
    links = None

    def labels() -> DataFrame:
        if links is None:
            return reps.withColumn("label", F.col("rep"))
        found = components(links, name="label").withColumnRenamed("id", "rep")
        return stage_table(reps.join(found, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label")), "labels")

    for _ in range(rounds):
        own = labels()
        heads = sets.select(F.col("doc_id").alias("rep"), "head").join(own, "rep").select("rep", "label", F.explode("head").alias("tok"))
        met = stage_table(_may_link(_first_meeting(heads), sets, percent), "met")
        new = stage_table(_linked(met, docs, width, percent), "links", [met])
        links = new if links is None else links.union(new)

    own = labels()
    each = sets.select(F.col("doc_id").alias("rep"), "n", "prefix").join(own, "rep").select("rep", "label", "n", F.posexplode("prefix").alias("rank", "tok"))
    open_tiles = each.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    # a table of its own, so that the join may split the rows of a token that very many classes have
    open_tiles = stage_table(open_tiles.select("tok", F.ceil(F.col("m") / TILE_ROWS).cast("int").alias("blocks")), "open")
    rows = each.join(open_tiles, "tok")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("tok", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "label", "n", "rank")
    rows = stage_table(rows, "tiles", [open_tiles])
    tiles = rows.join(sets.select(F.col("doc_id").alias("rep"), "signature"), "rep")
    tiles = tiles.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j", "n")
    candidates = stage_table(_candidates(tiles, percent), "candidates", [rows])
    near = stage_table(_may_link(candidates, sets, percent), "met", [candidates, sets])
    last = stage_table(_linked(near, docs, width, percent), "links", [near])
    found = components(links.union(last), name="component").withColumnRenamed("id", "rep")
    return member.join(found, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The first document of each component and all without shingles, with all their columns; see the module's text for null and repeated ids."""
    rows = _keyed(docs)
    if rows is None:
        kept = _components(docs, width, percent, 1).where("doc_id = component_id").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi")
    kept = rows.join(_first_rows(rows, width, percent).where("row = first.row").select("row", "n_shingles"), "row")
    one = kept.where("n_shingles > 0").dropDuplicates(["row"])
    return kept.where("n_shingles = 0").unionByName(one).select("carried.*")
