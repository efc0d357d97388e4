"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one
frame for each record.

The writer trains a dictionary on the first records of an archive (SAMPLE_BYTES of them at most; too
few records give none). Pages with equal payloads of at least `least` bytes are written once, as the
response with the largest key; the others are revisits that refer to it. An archive is one file of
one task attempt; the manifest lists the files of the attempts that Spark committed, and a reader
takes those only, so that lost tasks leave nothing behind that counts.

The reader checks frames, headers, lengths and digests of every record; `problem` says what is
wrong, or is null.

Defined results: a null payload is empty; a null key is written as an empty one, read as null, and
is a response only if no equal payload has a key; rows with one key and one payload are equal
records; a null address is left out; an empty table gives an empty manifest and no records; columns
not named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pipekit.llm.arrays import chosen, qualified
from pipekit.session import saved

# Fixed values of the format.
SKIPPABLE, DICTIONARY = range(0x184D2A50, 0x184D2A60), 0x184D2A5D
FRAME = bytes.fromhex("28b52ffd")
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST = 1000
SAMPLE_BYTES, DICTIONARY_BYTES = 2 * 1024 * 1024, 64 * 1024
ARCHIVE_BYTES = 1024**3  # of records, after which a task begins its next archive
READ_BYTES = 1024 * 1024
DATE = "2024-01-01T00:00:00Z"


def _identity(key: str) -> str:
    return f"<urn:page:{quote(key, safe='')}>"


def build_record(key: str, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One record; a revisit has the head of the response without its payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _identity(key)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F))))))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _identity(refers_to)), ("WARC-Profile", PROFILE)]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record, and what is wrong with it."""
    out: dict = dict.fromkeys(("key", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"))
    out["problem"] = None
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name:
            return out | {"problem": "a header line without a name"}
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not first.startswith(b"WARC/1.") or not gap:
        return out | {"problem": "no WARC header"}
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            return out | {"problem": f"no {name}"}
    size = fields["content-length"]
    if not (size.isascii() and size.isdigit()) or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"problem": "a length that does not fit the frame"}

    def key(name: str) -> str | None:
        return unquote(fields[name].removeprefix("<urn:page:").removesuffix(">")) or None if name in fields else None

    out |= {"key": key("warc-record-id"), "record_type": fields["warc-type"], "refers_to": key("warc-refers-to")}
    out["url"] = unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    stated = [v for n, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if n.lower() == b"content-length"]
    if not gap or len(stated) != 1 or not stated[0].strip().isdigit():
        return out | {"problem": "no HTTP head with a length"}
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    try:
        digest = base64.b32decode(digest).hex()
    except ValueError:
        digest = ""
    if algorithm != "sha1" or len(digest) != 40:
        return out | {"problem": "no SHA-1 payload digest"}
    out |= {"payload_bytes": int(stated[0]), "payload_digest": digest}
    if out["record_type"] == "response":
        out["payload"] = payload
        if len(payload) != out["payload_bytes"]:
            out["problem"] = "a payload of another length"
        elif hashlib.sha1(payload).hexdigest() != digest:
            out["problem"] = "a payload of another digest"
    elif out["record_type"] == "revisit" and (payload or "warc-refers-to" not in fields):
        out["problem"] = "a revisit with a payload or without a reference"
    return out


def trained(records: list[bytes]) -> bytes | None:
    """A dictionary for records like these."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, records)) // 8), records).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


class ArchiveWriter:
    """Records to one stream, held back until there are enough to train a dictionary."""

    def __init__(self, stream):
        self.stream, self.held, self.size, self.compress = stream, [], 0, None

    def add(self, record: bytes) -> None:
        self.size += len(record)
        if self.compress:
            self.stream.write(self.compress(record))
        else:
            self.held.append(record)
            if self.size >= SAMPLE_BYTES:
                self.begin()

    def begin(self) -> None:
        dictionary = trained(self.held)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if dictionary:
            self.stream.write(DICTIONARY.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True).compress
        for record in self.held:
            self.stream.write(self.compress(record))
        self.held = []

    def close(self) -> None:
        if not self.compress:
            self.begin()
        self.stream.close()


def frames(stream) -> Iterator[tuple[bytes | None, str | None]]:
    """The content of each frame of an archive, or what is wrong with the rest of it."""
    data, context, first = b"", zstandard.ZstdDecompressor(), True

    def more(n: int) -> bytes:
        nonlocal data
        while len(data) < n and (read := stream.read(READ_BYTES)):
            data += read
        return data[:n]

    while start := more(4):
        if int.from_bytes(start, "little") in SKIPPABLE and len(more(8)) == 8:
            size = int.from_bytes(data[4:8], "little")
            content = more(8 + size)[8:]
            if len(content) < size:
                yield None, "a cut skippable frame"
                return
            if first and int.from_bytes(start, "little") == DICTIONARY:
                if content[:4] == FRAME:  # a dictionary may be compressed itself
                    content = zstandard.ZstdDecompressor().decompress(content)
                context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            data, first = data[8 + size :], False
            continue
        if start != FRAME:
            yield None, "bytes that are no frame"
            return
        first, decoder, parts = False, context.decompressobj(), []
        try:
            while not decoder.eof:
                if not data and not more(1):
                    yield None, "a cut frame"
                    return
                parts.append(decoder.decompress(data))
                data = decoder.unused_data if decoder.eof else b""
        except zstandard.ZstdError as broken:
            yield None, f"a broken frame: {broken}"
            return
        yield b"".join(parts), None


def with_revisits(df: DataFrame, key: str, payload: str, url: str, least: int = LEAST) -> DataFrame:
    """`key`, `url`, `payload` (binary) and `refers_to`, the key of the response of a revisit."""
    rows = chosen(df, key=key, url=url, payload=payload)
    rows = rows.withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    # A payload that may be revisited goes by its hash; the others are spread and meet nothing.
    long = F.octet_length("payload") >= least
    alone = F.concat(F.lit("-"), F.xxhash64("key", "payload").cast("string"))
    rows = rows.withColumn("same", F.when(long, F.sha2("payload", 256)).otherwise(alone))
    first = rows.where(long).groupBy("same").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(first.where("n > 1").select("same", "first"), "same", "left")
    other = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return rows.select("key", "url", "payload", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(df: DataFrame, path: str, key: str, payload: str, url: str, least: int = LEAST) -> DataFrame:
    """Write all rows below `path`; the manifest has `file` and `n_records`."""
    path = qualified(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pafs.FileSystem.from_uri(path)
        task = TaskContext.get()
        files.create_dir(folder, recursive=True)
        writer, name, count = None, "", 0
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.zst"
                    writer, count = ArchiveWriter(files.open_output_stream(f"{folder}/{name}")), 0
                writer.add(build_record(row["key"] or "", row["url"], row["payload"], row["refers_to"]))
                count += 1
                if writer.size >= ARCHIVE_BYTES:
                    writer.close()
                    writer = None
                    yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "n_records": [count]})
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "n_records": [count]})

    rows = with_revisits(df, key, payload, url, least)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("key", "url", "refers_to")})
    return saved(rows.mapInArrow(run, "file string, n_records long"), "manifest")


RECORD = {
    "key": pa.string(),
    "url": pa.string(),
    "record_type": pa.string(),
    "refers_to": pa.string(),
    "payload": pa.binary(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "problem": pa.string(),
}


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that the column `file` names, each archive in one task."""
    names = [name for name in RECORD if payloads or name != "payload"]
    schema = pa.schema([(name, RECORD[name]) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                files, name = pafs.FileSystem.from_uri(file)
                rows, size = [], 0
                with files.open_input_stream(name) as stream:
                    for content, problem in frames(stream):
                        row = parse_record(content) if content is not None else {"problem": problem}
                        rows.append({n: row.get(n) for n in names})
                        size += len(content or b"") if payloads else 1000
                        if size >= 4 * READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = {"string": "string", "binary": "binary", "int64": "long"}
    n = max(1, manifest.count())
    return manifest.select("file").repartition(n).mapInArrow(run, ", ".join(f"{f.name} {ddl[str(f.type)]}" for f in schema))


__all__ = ["ArchiveWriter", "build_record", "frames", "parse_record", "read_archives", "write_archives"]
