"""Dictionary-compressed WARC archives (.warc.zst), written and read by Spark tasks.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a
Zstandard dictionary built from the archive's own records; every record
follows as one frame of its own, compressed with that dictionary, so that
any record can be read alone from its offset. Archives go to a folder that
all machines share, under names that hold the task's attempt; a manifest, a
table beside them that only successful tasks add to, lists the archives of
which the collection consists. What a lost or a superfluous attempt left
behind isn't in the manifest and is never read.

A record's payload is the page's html in UTF-8; null is empty. Among equal
payloads of at least ``min_bytes`` bytes the smallest page id is the
response and the others revisit it. Rows with equal ids are separate
records. Empty tables write no archives. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedstream.llm._common import fresh_path, open_store, stage_table

SKIPPABLE, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
#: Raw bytes of records in one archive, and of the dictionary.
ARCHIVE_BYTES, DICT_BYTES = 8 << 20, 16 << 10
LEVEL = 3
#: The table of archives in a collection's folder, and how many archives a task reads.
MANIFEST, ARCHIVES_A_TASK = "manifest", 4
FIXED_DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """The bytes of one WARC/1.1 record; a revisit carries no payload."""
    revisit = refers_to is not None
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n".encode()
    block = head + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {FIXED_DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(url: str | None) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def parse(raw: bytes) -> dict[str, str | bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    out: dict[str, str | bytes] = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        out[name.lower()] = value
    out["block"] = rest[: int(out["content-length"])]
    return out


def build_dictionary(records: list[bytes], size: int = DICT_BYTES):  # noqa: ANN201
    """A dictionary trained on an archive's records, or raw content where there are too few to train."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, records, k=256, d=8)
    except zstandard.ZstdError:
        content = b"".join(records)[-size:]
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None


def archive(records: list[bytes]) -> bytes:
    import zstandard

    trained = build_dictionary(records)
    packed = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes()) if trained else b""
    write = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True).compress
    return b"".join([struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(write, records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive in order, frame by frame."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't start with a dictionary frame")
    packed, at = data[8 : 8 + size], 8 + size
    own = None
    if packed:
        raw = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == ZSTD_MAGIC else packed
        own = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor()
    while at < len(data):
        raw, at = _frame(reader.decompressobj(), data, at)
        yield raw


def _frame(frame, data: bytes, at: int) -> tuple[bytes, int]:  # noqa: ANN001
    """One frame and where it ends; fed in steps, so that what follows isn't copied for every record."""
    out, view, step = [], memoryview(data), 1 << 14
    while not frame.eof:
        if at >= len(data):
            raise ValueError("the archive ends inside a record")
        out.append(frame.decompress(view[at : at + step]))
        at = min(at + step, len(data))
    return b"".join(out), at - len(frame.unused_data)


def first_of_payloads(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages (page_id, url, payload) with refers_to; only digests and ids are shuffled by payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("_sha", F.sha1("payload"))
    seen = rows.where(F.length("payload") >= min_bytes).groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    # a table of its own, so that Spark may split a payload that many pages share
    again = stage_table(seen.where("_n > 1").select("_sha", "_first"), "payloads")
    return rows.join(again, "_sha", "left").select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("_first"), F.col("_first")).alias("refers_to"))


def write(pages: DataFrame, path: str | None = None, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write archives under ``path`` (a fresh folder in the shared one if None); returns the folder."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = open_store(path)
        store.create_dir(root, recursive=True)
        held, size, part, done = [], 0, 0, []

        def flush() -> None:
            nonlocal held, size, part
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId():09d}-{part:05d}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(archive(held))
            done.append((name, len(held)))
            held, size, part = [], 0, part + 1

        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                body = payload.as_py()
                held.append(record(page_id.as_py(), url.as_py(), body, digest(body), refers.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["name", "records"])

    first_of_payloads(pages, min_bytes).mapInArrow(run, "name string, records long").write.parquet(f"{path}/{MANIFEST}")
    return path


def read(spark, path: str) -> DataFrame:  # noqa: ANN001
    """Rows of all archives of the manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    number = lambda x: int(x[10:-1]) if x[10:-1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        for name, records in (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("name", "records")), strict=True)):
            with store.open_input_file(f"{root}/{name}") as file:
                data = file.read()
            rows = []
            for raw in read_archive(data):
                r = parse(raw)
                body = r["block"].partition(b"\r\n\r\n")[2]
                kind = r["warc-type"]
                if kind == "response" and digest(body) != r["warc-payload-digest"][5:]:
                    raise ValueError(f"a payload of {r['warc-record-id']} doesn't have its digest")
                rows.append((number(r["warc-record-id"]), r["warc-target-uri"], int(r["x-payload-length"]), r["warc-payload-digest"][5:], kind, number(r["warc-refers-to"]) if kind == "revisit" else None, body if kind == "response" else None))
            if len(rows) != records:
                raise ValueError(f"{name} holds {len(rows)} records, the manifest says {records}")
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    manifest = spark.read.schema("name string, records long").parquet(f"{path}/{MANIFEST}")
    tasks = -(-manifest.count() // ARCHIVES_A_TASK)
    return manifest.repartition(max(1, tasks), "name").mapInArrow(run, schema)
