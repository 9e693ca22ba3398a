"""WARC archives: a deterministic sharded writer, and a reader of what it wrote."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

#: Cuts of a range of keys at a time; their sums, of at most so many heavy ranges, are all that the driver gets.
CUTS = 4096
MOST_SHARDS = 1 << 15
MANIFEST = "manifest long, shard long, file string, records long, bytes long, payload_bytes long, sha256 string, first long, last long"


def digest32(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _head(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """A response with its HTTP head and payload, or (payload None) a revisit that has the head alone."""
    name = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'plexus:page:{n}')}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        lines.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else "%20" for c in url)))
    if page_id is not None:
        lines.append(("X-Page-Id", str(page_id)))
    lines += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if payload is None:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Truncated", "length")]
        if refers_to is not None:
            lines += [("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    else:
        block += payload
    lines += [("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(lines) + block + b"\r\n\r\n"


class _Roll:
    """The file being written: under a temporary name until it's whole, and one rename makes it final."""

    def __init__(self, folder: str, shard: int, number: int, level: int):
        self.fs, self.folder = _open(folder)
        self.shard, self.level = shard, level
        self.name = f"shard-{shard:06d}-{number:05d}.warc.gz"
        self.temporary = f"{self.folder}/_temporary-{uuid.uuid4().hex}-{self.name}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.sum, self.records, self.bytes, self.payload, self.ids = hashlib.sha256(), 0, 0, 0, []
        self._add(_head([("WARC-Type", "warcinfo"), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")]) + b"\r\n\r\n")

    def _add(self, data: bytes) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)  # each record is a gzip member without a time or name
        packed = packer.compress(data) + packer.flush()
        self.out.write(packed)
        self.sum.update(packed)
        self.bytes += len(packed)

    def add(self, data: bytes, page_id: int | None, size: int) -> None:
        self._add(data)
        self.records += 1
        self.payload += size
        if page_id is not None:
            self.ids = [min([page_id, *self.ids[:1]]), max([page_id, *self.ids[1:]])]

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")  # another attempt has the same bytes
        first, last = self.ids or (None, None)
        return {"manifest": 1, "shard": self.shard, "file": self.name, "records": self.records, "bytes": self.bytes, "payload_bytes": self.payload, "sha256": self.sum.hexdigest(), "first": first, "last": last}


def _limits(rows: DataFrame, shard_bytes: int, least_shards: int) -> tuple[list[int], list[int], int]:
    """(first keys of all ranges but the first, shards of each range, shards of null keys).

    ``rows``: id, weight. Ranges are put together from cuts, and a cut that weighs more than a shard is cut again, all such
    cuts in one pass, until each is light or a single key: that one is a range of its own with as many shards as its weight
    asks for. There are MOST_SHARDS at most, or few more; a larger table has larger ones.
    """
    low, high, total, null = rows.agg(F.min("id"), F.max("id"), F.sum("weight"), F.sum(F.when(F.col("id").isNull(), F.col("weight")))).first()
    share = max(1, (total or 0) // MOST_SHARDS, min(shard_bytes, (total or 0) // least_shards))
    longs = lambda some: F.array(*[F.lit(x) for x in some]).cast("array<bigint>")
    cuts: list[tuple[int, int]] = []  # first key and weight
    heavy = [] if low is None else [(low, high - low + 1)]
    while heavy:
        # All heavy cuts of a pass are as long but for the first pass, where there is one.
        width = max(1, -(-heavy[0][1] // CUTS))
        place = F.size(F.filter(longs([f for f, _ in heavy]), lambda f: f <= F.col("id")))
        sized = rows.where("id is not null").select("id", "weight", F.get(longs([None, *[f for f, _ in heavy]]), place).alias("first"))
        cut = F.floor((F.col("id") - F.col("first")) / width)
        found = sized.where(F.col("id") - F.col("first") < heavy[0][1]).groupBy("first", cut.alias("cut")).agg(F.sum("weight").alias("weight")).collect()
        made = [(r["first"] + r["cut"] * width, r["weight"]) for r in found]
        cuts += [(f, w) for f, w in made if w <= share or width == 1]
        heavy = sorted((f, width) for f, w in made if w > share and width > 1)
    limits, counts, used = [], [1], None
    for first, weight in sorted(cuts):
        if used is not None and used + weight > share:
            limits.append(first), counts.append(1)
            used = None
        used = (used or 0) + weight
        counts[-1] = max(1, -(-used // share))
    return limits, counts, max(1, -(-(null or 0) // share))


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_payload: int = 0, file_bytes: int = 64 << 20, shard_bytes: int = 256 << 20, least_shards: int = 64, level: int = 1, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Write a record for each page to ``folder`` and return the manifest: a row a file, kept as Parquet in folder/manifest.

    Records are dealt by ranges of the key, in its order, a range a task; the limits come from exact sums of bytes over even cuts of
    its range, and over cuts of each cut that is too heavy, however keys crowd: so the same table makes the same
    files, byte for byte, on any cluster. A single key that is too heavy, and null, is dealt by payload. A file is closed when its
    compressed size reaches ``file_bytes``. Of records with equal payloads of at least ``least_payload`` bytes the one with
    the smallest key is the response; the others are revisits of it and have no payload.

    A file appears by one rename; a task that is lost or runs twice makes the same file again. The manifest is written last: files
    that it doesn't name don't count. The html goes through one shuffle; what equal payloads share is found on digests.
    Null payloads are empty ones. Records of a null key come last, name no id, and are responses if nothing smaller
    has their payload. Of rows equal in key and payload the first is the response. No rows make no files.
    """
    spark = pages.sparkSession
    last = F.lit((1 << 63) - 1)
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), text_or_empty(payload).alias("body"))
    rows = rows.withColumn("size", F.octet_length("body").cast("long")).withColumn("sum", F.sha1(F.col("body").cast("binary")))
    limits, counts, null_shards = _limits(rows.select("id", (F.col("size") + 500).alias("weight")), shard_bytes, least_shards)
    starts = [sum(counts[:i]) for i in range(len(counts) + 1)]
    longs = lambda some: F.array(*[F.lit(x) for x in some]).cast("array<bigint>")
    at = F.size(F.filter(longs(limits), lambda c: c <= F.col("id")))
    # A key, or null, that alone weighs more than a shard has several of them, dealt by payload: equal payloads stay together.
    by_sum = F.conv(F.substring("sum", 1, 8), 16, 10).cast("long")
    shard_of = F.when(F.col("id").isNull(), starts[-1] + by_sum % null_shards).otherwise(F.get(longs(starts), at) + by_sum % F.get(longs(counts), at)).cast("long")
    shards = starts[-1] + null_shards

    # What equal payloads share, found on narrow rows: the smallest key of each digest, joined back by digest.
    narrow = rows.select("id", "sum", "size").where(F.col("size") >= least_payload)
    first = narrow.groupBy(F.col("sum").alias("same")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = narrow.select("id", "sum").distinct().join(first, F.col("sum") == F.col("same")).select("id", "sum", "first")
    notes = shared.select(shard_of.alias("shard"), "id", F.lit(0).alias("part"), "sum", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("body"), F.lit(0).cast("long").alias("size"), "first")
    wide = rows.select(shard_of.alias("shard"), "id", F.lit(1).alias("part"), "sum", "url", "body", "size", F.lit(None).cast("long").alias("first"))
    # A note stands right before the pages that it's about: so pages need no join, and are shuffled once.
    sorted_ = notes.unionByName(wide).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", F.coalesce("id", last), "id", "sum", "part", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("manifest", pa.int64()), ("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("payload_bytes", pa.int64()), ("sha256", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
        file, note, number, seen = None, None, 0, None
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                shard, page_id, part, digest, address, body, size, first_id = (c[i].as_py() for c in batch.columns)
                if part == 0:
                    note = (page_id, digest, first_id)
                    continue
                if file and (file.shard != shard or file.bytes >= file_bytes):
                    number = number + 1 if file.shard == shard else 0
                    done.append(file.close())
                    file = None
                elif not file:
                    number = 0
                file = file or _Roll(folder, shard, number, level)
                noted = note is not None and note[:2] == (page_id, digest)
                # The first row of the smallest key is the response; a row just like it revisits it.
                again = noted and (note[2] != page_id or seen == (page_id, digest))
                seen = (page_id, digest)
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                file.add(record(page_id, address, None if again else body.encode(), name, size, note[2] if again else None, date), page_id, size)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if file:
            yield pa.RecordBatch.from_pylist([file.close()], schema)

    filesystem, path = _open(folder)
    filesystem.create_dir(path, recursive=True)
    sorted_.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records_of(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of an archive that comes in chunks."""
    tool, held = zlib.decompressobj(31), io.BytesIO()
    for chunk in data:
        while chunk:
            held.write(tool.decompress(chunk))
            chunk = tool.unused_data
            if tool.eof:
                whole = held.getvalue()
                head, _, rest = whole.partition(b"\r\n\r\n")
                headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                size = int(headers["Content-Length"])
                if rest[size:] != b"\r\n\r\n":
                    raise ValueError(f"a record of {size} bytes has {len(rest) - 4}")
                yield headers, rest[:size]
                tool, held = zlib.decompressobj(31), io.BytesIO()
    if held.tell():
        raise ValueError("an archive ends within a record")


def read_archives(spark: SparkSession, folder: str, texts: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if ``texts``) of all files that the manifest names.

    Digests of blocks and payloads are worked out anew and must agree with the headers; revisits have what their headers say.
    """
    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * texts
    names = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = _open(folder)
        columns: list[list] = [[] for _ in range(6 + texts)]
        fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * texts
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * texts
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with filesystem.open_input_stream(f"{path}/{name}") as stream:
                    for headers, block in records_of(iter(lambda: stream.read(1 << 20), b"")):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        if headers["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
                            raise ValueError(f"{name}: a block doesn't have its digest")
                        digest, payload = headers["WARC-Payload-Digest"].removeprefix("sha1:"), None
                        size = int(headers["X-Payload-Length"])
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if digest32(payload) != digest or len(payload) != size:
                                raise ValueError(f"{name}: a payload doesn't have its digest or length")
                        ids = [int(x) if (x := headers.get(k)) is not None else None for k in ("X-Page-Id", "X-Refers-To-Page")]
                        for column, value in zip(columns, [ids[0], headers.get("WARC-Target-URI"), size, digest, kind, ids[1], payload], strict=False):
                            column.append(value)
                        if len(columns[0]) >= 5000:
                            yield out()
                            for column in columns:
                                column.clear()
        if columns[0]:
            yield out()

    return names.repartition(max(1, min(names.count(), 4096))).mapInArrow(run, shape)
