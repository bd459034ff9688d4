"""Token ids as files of fixed-width bit fields.

Texts are dealt by range of their ids into tasks, which encode them and write
files. A file (``.tok``) is, little-endian:

- the head: magic, version, bits an id, documents, ids, ids a block, blocks
- the documents: ids (int64), which of them are null (uint8), first id after each (uint64)
- the offsets of the blocks (uint64, one more than blocks), from the first block on
- the blocks: every id takes the minimum of bits for the vocabulary, the least
  significant bit first; a block begins at a byte, so that any block can be read
  alone from its offset and be unpacked by array operations

The files are in ascending order of document ids, null ones first, and so are the
documents of a file; equal ids are ordered by hashes of their texts. A
manifest that only successful tasks add to names the files of a collection.
Null and empty texts hold the end id alone. Rows with equal ids are separate
documents, many of them are dealt over several files. A document of any length is written whole, in
blocks. An empty table writes no files. Other columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heedstream.llm._common import fresh_path, lean, open_store, prefix_sums, range_hash, stage_table, text_chunks

MAGIC, VERSION = b"HSTOKENS", 1
HEAD = struct.Struct("<8sIIQQII")
#: Ids of a block, bytes of ids in one file, files in a group of the running sums, files a task reads.
BLOCK_IDS, FILE_BYTES, GROUP, FILES_A_TASK = 1 << 16, 16 << 20, 1024, 2
#: Ids that are unpacked at once when files are read.
WINDOW = 1 << 21
#: Bytes of texts that are dealt to a task, and that are encoded at once.
TASK_BYTES, CHUNK = 32 << 20, 2 << 20
#: Words a task keeps the ids of; words of more ids go first.
KEPT_WORDS, KEPT_IDS = 1_500_000, 24
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def width(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as fields of ``bits`` bits, the least significant first."""
    if not len(ids):
        return b""
    if int(ids.max()) >> bits:
        raise ValueError(f"an id doesn't fit into {bits} bits")
    return np.packbits(np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little").ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int, first: int = 0) -> np.ndarray:
    """``count`` ids from the field ``first`` on: eight bytes around each field are gathered, shifted and masked."""
    place = np.arange(first, first + count, dtype=np.int64) * bits
    padded = np.frombuffer(bytes(data) + bytes(8), np.uint8)
    around = np.lib.stride_tricks.as_strided(padded, (max(len(padded) - 7, 0), 8), (1, 1))
    words = np.ascontiguousarray(around[place >> 3]).view("<u8").ravel()
    return ((words >> (place & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Words:
    """Ids of texts from the tokenizers library, which sees a word once while it is kept.

    A text is cut before every blank or line end that doesn't follow white
    space. The vocabulary's pre-tokenizer never joins what stands on both sides
    of such a place, as blanks and line ends only begin its pieces, so the ids of
    the parts are the ids of the whole. Words are told apart by 64-bit hashes of their bytes; a
    sorted table holds the ids of those seen so far, of which the older half
    goes when there are more than ``KEPT_WORDS``. Texts that hold a special
    token's string go to the library whole, as does the first of every chunk, to be compared.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        table = {v: k for k, v in self.library.get_vocab().items()}
        # in a byte-level vocabulary each character of a piece stands for one byte
        self.bytes_of = np.array([len(table.get(i, "")) for i in range(max(table) + 1)], dtype=np.int64)
        self.chunk = 0
        self._keep(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _keep(self, hashes: np.ndarray, first: np.ndarray, count: np.ndarray, used: np.ndarray, ids: np.ndarray) -> None:
        self.hashes, self.first, self.count, self.used, self.ids = hashes, first, count, used, ids

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many are each word's) of words: those that begin with a blank or a line end are encoded as one text and cut by their pieces' bytes."""
        # a word that ends in white space could be drawn together with the next one, one without a blank with the last
        joined = [w[:1] in (b" ", b"\n") and not w[-3:].decode("utf-8", "replace")[-1:].isspace() for w in new]
        alone = iter(self.whole([w.decode("utf-8", "replace") for w, j in zip(new, joined, strict=True) if not j]))
        some = [w for w, j in zip(new, joined, strict=True) if j]
        pieces, cuts = np.zeros(0, np.uint32), []
        if some:
            pieces = self.whole([b"".join(some).decode("utf-8", "replace")])[0]
            ends, sizes = np.cumsum(self.bytes_of[pieces]), np.cumsum(list(map(len, some)))
            at = np.searchsorted(ends, sizes)
            if ends[-1] != sizes[-1] or (ends[at] != sizes).any():
                raise ValueError("a piece goes over the end of a word")
            cuts = np.concatenate([[0], at + 1])
        if len(some) == len(new):
            return pieces, np.diff(cuts) if some else np.zeros(0, np.int64)
        parts = iter(np.split(pieces, cuts[1:-1])) if some else iter(())
        out = [next(parts) if j else next(alone) for j in joined]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words begin: at texts and at blanks and line ends that follow anything but white space (or what could end a longer code for it)."""
        before = np.zeros(len(data), bool)
        before[1:] = _SPACE[data[:-1]]
        before[2:] |= (data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0))
        before[3:] |= (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3) & (data[2:-1] >= 0x80) & (data[2:-1] <= 0xAF)
        begin = ((data == 32) | (data == 10)) & ~before
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(begin)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a chunk, how many are each one's); texts are byte ranges of ``data``."""
        self.chunk += 1
        raw = data.tobytes()
        odd = {k for s in self.special if s in raw for k in range(len(offsets) - 1) if s in raw[offsets[k] : offsets[k + 1]]}
        start = self.cut(data, offsets) if len(data) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(data))
        text = np.searchsorted(offsets, start, side="right") - 1
        hashes = range_hash(prefix_sums(data), start, end)
        unique, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), bool)
        inside = spot < len(self.hashes)
        known[inside] = self.hashes[spot[inside]] == unique[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            ids, count = self.learn([raw[a:b] for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
            first = len(self.ids) + np.cumsum(count) - count
            add = lambda old, values: np.insert(old, spot[new], values)
            self._keep(add(self.hashes, unique[new]), add(self.first, first), add(self.count, count), add(self.used, self.chunk), np.concatenate([self.ids, ids]))
            spot = np.searchsorted(self.hashes, unique)
        self.used[spot] = self.chunk
        count = self.count[spot][which]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        out = self.ids[np.repeat(self.first[spot][which] - (upto - count), count) + np.arange(total)]
        each = np.bincount(text, count, minlength=len(offsets) - 1).astype(np.int64) if len(text) else np.zeros(len(offsets) - 1, np.int64)
        if len(self.hashes) > KEPT_WORDS:
            self._forget()
        if odd:
            parts = np.split(out, np.cumsum(each)[:-1])
            for k in odd:
                parts[k] = self.whole([raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace")])[0]
            out, each = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        if len(each) and not np.array_equal(self.whole([raw[: offsets[1]].decode("utf-8", "replace")])[0], out[: each[0]]):
            raise ValueError(f"ids of a text of {offsets[1]} bytes differ from the library's")
        return out, each

    def _forget(self) -> None:
        """Drop the half of the words that were used least recently, and long ones first of all."""
        keep = np.zeros(len(self.hashes), bool)
        keep[np.argsort(-self.used + (self.count > KEPT_IDS) * self.chunk, kind="stable")[: KEPT_WORDS // 2]] = True
        count, first = self.count[keep], self.first[keep]
        begin = np.cumsum(count) - count
        ids = self.ids[np.repeat(first - begin, count) + np.arange(int(count.sum()))]
        self._keep(self.hashes[keep], begin, count, self.used[keep], ids)


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _words:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _words[path] = Words(path)
    return _words[path]


def with_end(ids: np.ndarray, each: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts with the end id after each text."""
    if end_id is None:
        return ids, each
    return np.insert(ids, np.cumsum(each), end_id), each + 1


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> Iterator[bytes]:
    """A file's bytes in parts; ``ids`` has the ids of all its documents, in runs of any length."""
    n, total = len(doc_ids), int(np.sum(counts))
    blocks = -(-total // block)
    sizes = np.full(blocks, -(-block * bits // 8), dtype="<u8")
    if total % block:
        sizes[-1] = -(-(total % block) * bits // 8)
    yield HEAD.pack(MAGIC, VERSION, bits, n, total, block, blocks)
    yield np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
    yield np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
    yield np.cumsum(np.asarray(counts, dtype="<u8"), dtype="<u8").tobytes()
    yield np.concatenate([np.zeros(1, "<u8"), np.cumsum(sizes, dtype="<u8")]).tobytes()
    rest = np.zeros(0, np.uint32)
    for run in ids:
        flat = np.concatenate([rest, run]) if len(rest) else run
        whole = len(flat) - len(flat) % block
        for first in range(0, whole, block):
            yield pack(flat[first : first + block], bits)
        rest = flat[whole:]
    if len(rest):
        yield pack(rest, bits)


class TokenFile:
    """Random access to an open file: documents and ranges of ids, read block by block."""

    def __init__(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        magic, version, self.bits, n, self.total, self.block, blocks = HEAD.unpack(self._at(0, HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of token ids")
        at = HEAD.size
        ids, null, ends, offsets = (self._at(at + a, b) for a, b in ((0, 8 * n), (8 * n, n), (9 * n, 8 * n), (17 * n, 8 * blocks + 8)))
        self.doc_ids, self.null = np.frombuffer(ids, "<i8"), np.frombuffer(null, np.uint8).astype(bool)
        self.ends, self.offsets = np.frombuffer(ends, "<u8").astype(np.int64), np.frombuffer(offsets, "<u8").astype(np.int64)
        self.data = at + 17 * n + 8 * blocks + 8

    def _at(self, place: int, size: int) -> bytes:
        self.handle.seek(place)
        data = self.handle.read(size)
        if len(data) != size:
            raise ValueError("the file ends early")
        return data

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids [first, last) of the file; only the blocks that hold them are read."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block
        data = self._at(self.data + int(self.offsets[a]), int(self.offsets[b + 1] - self.offsets[a]))
        out = []
        for k in range(a, b + 1):
            own = data[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]]
            start = max(first - k * self.block, 0)
            out.append(unpack(own, self.bits, min(last - k * self.block, self.block) - start, start))
        return np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, path: str | None = None, size: int = FILE_BYTES, block: int = BLOCK_IDS, task_bytes: int = TASK_BYTES) -> str:
    """Encode whole texts and write files under ``path`` (a fresh folder in the shared one if None); returns the folder.

    Texts are dealt by range of their ids into tasks of about ``task_bytes``
    each; equal ids are told apart by their texts' hashes and their places in the input, so that
    many of them are dealt over several tasks too.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    bits = width(max(words(tokenizer_path).size, (end_id or 0) + 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    order = [F.col(c) for c in ("doc_id", "_hash", "_row")]
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    dealt = rows.repartitionByRange(max(1, -(-total // task_bytes)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, own = TaskContext.get(), words(tokenizer_path)
        store, root = open_store(path)
        store.create_dir(root, recursive=True)
        names, counts, ids, have, done = [], [], [], 0, []

        def flush() -> None:
            nonlocal names, counts, ids, have
            name = f"ids-{task.partitionId():06d}-{len(done):05d}-{task.taskAttemptId():09d}.tok"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for data in file_bytes(names, np.concatenate(counts), ids, bits, block):
                    out.write(data)
            done.append((task.partitionId(), len(done), name, len(names), have))
            names, counts, ids, have = [], [], [], 0

        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for first, end, data, offsets in text_chunks(batch, "text", CHUNK):
                flat, each = with_end(*own.texts(data, offsets), end_id)
                names += numbers[first:end]
                counts.append(each)
                ids.append(flat)
                have += len(flat)
                if have * bits >= 8 * size:
                    flush()
        if names:
            flush()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate(kinds)], ["partition", "part", "name", "docs", "ids"])

    dealt.select("doc_id", "text").mapInArrow(lean(run), MANIFEST).write.parquet(f"{path}/manifest")
    return path


MANIFEST = "partition long, part long, name string, docs long, ids long"


def manifest(spark, path: str) -> DataFrame:  # noqa: ANN001
    """The files of a collection in order, each with the ids of all before it: running sums in groups of ``GROUP`` partitions, then over the groups."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn("_g", F.expr(f"partition div {GROUP}"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = files.groupBy("_g").agg(F.sum("ids").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before.orderBy("_g")), F.lit(0)))
    inside = F.coalesce(F.sum("ids").over(before.partitionBy("_g").orderBy("partition", "part")), F.lit(0))
    return files.withColumn("_in", inside).join(groups.select("_g", "_base"), "_g").select("name", "docs", "ids", (F.col("_base") + F.col("_in")).alias("base"))


def read(spark, path: str, keep_ids: bool = True) -> DataFrame:  # noqa: ANN001
    """Rows of all files: doc_id, start, n_tokens, ids_crc32[, token_ids]."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        for name, docs, base in (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("name", "docs", "base")), strict=True)):
            with store.open_input_file(f"{root}/{name}") as handle:
                file = TokenFile(handle)
                if len(file.ends) != docs:
                    raise ValueError(f"{name} holds {len(file.ends)} documents, the manifest says {docs}")
                starts = np.concatenate([np.zeros(1, np.int64), file.ends[:-1]])
                k = 0
                while k < docs:
                    last = max(k + 1, int(np.searchsorted(file.ends, starts[k] + WINDOW, side="right")))
                    sums, own = [], []
                    if last > k + 1 or file.ends[k] - starts[k] <= WINDOW:
                        ids = file.ids(int(starts[k]), int(file.ends[last - 1])).astype("<u4")
                        own = [ids[a - starts[k] : b - starts[k]] for a, b in zip(starts[k:last], file.ends[k:last], strict=True)]
                        sums = [zlib.crc32(x) for x in own]
                    else:
                        crc = 0
                        for a in range(int(starts[k]), int(file.ends[k]), WINDOW):
                            ids = file.ids(a, min(a + WINDOW, int(file.ends[k]))).astype("<u4")
                            crc = zlib.crc32(ids, crc)
                            if keep_ids:
                                own.append(ids)
                        sums, own = [crc], [np.concatenate(own)] if keep_ids else []
                    columns = [pa.array(file.doc_ids[k:last], mask=file.null[k:last]), pa.array(starts[k:last] + base), pa.array(file.ends[k:last] - starts[k:last]), pa.array(sums, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                        names.append("token_ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
                    k = last

    files = stage_table(manifest(spark, path), "files")
    tasks = max(1, -(-files.count() // FILES_A_TASK))
    return files.repartition(tasks, "name").mapInArrow(lean(run), schema)
