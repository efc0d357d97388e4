"""Token sequences in training order, as binary shards of records of one size.

Each text is tokenised and cut into sequences of `length` tokens, the last one padded. Sequences are
numbered densely from the files they were written to, and a keyed Feistel network over the smallest
even number of bits, walked until it falls below the number of sequences, gives each its slot.
Shard s holds slots s * slots to (s + 1) * slots, record after record, so that a reader finds slot x
at byte (x - first) * stride and can go on from anywhere.

A shard is one file of one task attempt; the manifest lists the files of the attempts that Spark
committed. On the way to their shard, many records of a task travel as one compressed block.

Defined results: a null or empty text has no sequences; a null key is kept; equal rows have
sequences of their own; an empty table gives an empty manifest; other columns are ignored. Token ids
are unsigned 16-bit numbers; larger ones are an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pipekit.llm.arrays import chosen, qualified, resident, sized_batches
from pipekit.session import fresh_path, saved

LENGTH, SLOTS = 256, 32_768
ROUNDS = 6
NO_KEY = np.int64(-(2**63))
READ_RECORDS = 4096
DEALT = 65_536  # records that a task deals out to the shards at once
# What lies on disk beside the shards costs more than the time to pack it; large pages pack better.
LEVEL = 9
PACKED = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": LEVEL,
    "parquet.page.size": 8 * 1024 * 1024,
    "parquet.page.row.count.limit": 1_000_000,
    "parquet.enable.dictionary": "false",
}


def record_type(length: int) -> np.dtype:
    return np.dtype([("key", "<i8"), ("part", "<u4"), ("n", "<u2"), ("tokens", "<u2", (length,))])


def _round(half: np.ndarray, key: int) -> np.ndarray:
    x = half + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The keyed permutation of 0 to n - 1, at `index`."""
    bits = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64(2**bits - 1)
    keys = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, ROUNDS, np.uint64).tolist()
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(bits), out[walking] & mask
        for key in keys:
            left, right = right, left ^ (_round(right, key) & mask)
        out[walking] = left << np.uint64(bits) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def sequences(df: DataFrame, tokenizer: Callable, key: str, text: str, length: int) -> DataFrame:
    """`key`, `part`, `n` (tokens that count) and `tokens` (bytes) of each sequence, written once.

    `tokenizer()` gives a function from a list of texts to a list of lists of ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = tokenizer()
        for batch in sized_batches(batches, "text"):
            ids = to_ids([t or "" for t in batch.column("text").to_pylist()])
            sizes = np.array([len(x) for x in ids], np.int64)
            if max(map(max, filter(len, ids)), default=0) > 0xFFFF:
                raise ValueError("a token id needs more than 16 bits")
            parts = -(-sizes // length)
            of = np.repeat(np.arange(len(ids)), parts)
            part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            tokens = np.zeros((len(of), length), "<u2")
            row = 0
            for x, n in zip(ids, parts.tolist()):
                tokens[row : row + n].reshape(-1)[: len(x)] = x
                row += n
            columns = {
                "key": batch.column("key").take(pa.array(of)),
                "part": pa.array(part.astype(np.int32)),
                "n": pa.array(np.minimum(sizes[of] - part * length, length).astype(np.int32)),
                "tokens": pa.array([t.tobytes() for t in tokens], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    rows = chosen(df, key=key, text=text)
    cut = rows.withColumn("key", F.col("key").cast("long")).mapInArrow(run, "key long, part int, n int, tokens binary")
    path = fresh_path(df.sparkSession, "sequences")
    cut.write.options(**PACKED).parquet(path)
    return df.sparkSession.read.schema(cut.schema).parquet(path)


def write_shards(
    df: DataFrame,
    path: str,
    tokenizer: Callable,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    per_shard: int = SLOTS,
    seed: int = 0,
) -> DataFrame:
    """Write all sequences below `path`; the manifest has `shard`, `file`, `first` slot and `n` slots."""
    kind, path = record_type(length), qualified(df.sparkSession, path)
    cut = sequences(df, tokenizer, key, text, length)
    cut = cut.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # One row for each written file: where its sequences begin.
    sizes = cut.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
    before = F.sum("n_rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("file", F.coalesce(before, F.lit(0)).alias("begin"))
    n = sizes.agg(F.sum("n_rows")).first()[0] or 0
    shards = -(-n // per_shard)
    placed = cut.join(F.broadcast(begins), "file").withColumn("index", F.col("begin") + F.col("row"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] * (batch.num_rows > 0)
            if sum(b.num_rows for b in held) >= DEALT:
                yield pa.concat_batches(held)
                held = []
        if held:
            yield pa.concat_batches(held)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in gathered(batches):
            records = np.zeros(batch.num_rows, kind)
            records["key"] = batch.column("key").fill_null(int(NO_KEY))
            records["part"], records["n"] = batch.column("part"), batch.column("n")
            flat = b"".join(batch.column("tokens").to_pylist())
            records["tokens"] = np.frombuffer(flat, "<u2").reshape(-1, length)
            slot = slots(np.asarray(batch.column("index")), n, seed)
            order = np.argsort(slot)
            slot, records = slot[order], records[order]
            cuts = np.flatnonzero(np.diff(slot // per_shard)) + 1
            starts = [0, *cuts.tolist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array((slot[starts] // per_shard).astype(np.int32)),
                    "slots": pa.array([s.tobytes() for s in np.split(slot, cuts)], pa.binary()),
                    "records": pa.array([pack.compress(r.tobytes()) for r in np.split(records, cuts)], pa.binary()),
                }
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pafs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        unpack = zstandard.ZstdDecompressor()
        held: dict = {"shard": None}

        def close() -> Iterator[pa.RecordBatch]:
            if held["shard"] is None:
                return
            if held["left"]:
                raise ValueError(f"shard {held['shard']} lacks {held['left']} records")
            name = f"shard-{held['shard']:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.bin"
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(held["records"].tobytes())
            row = {"shard": [held["shard"]], "file": [f"{path}/{name}"], "first": [held["first"]], "n": [len(held["records"])]}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "shard" else None) for k, v in row.items()})

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != held["shard"]:
                    yield from close()
                    first = row["shard"] * per_shard
                    size = min(per_shard, n - first)
                    held = {"shard": row["shard"], "first": first, "left": size, "records": np.zeros(size, kind)}
                at = np.frombuffer(row["slots"], np.int64) - held["first"]
                held["records"][at] = np.frombuffer(unpack.decompress(row["records"]), kind)
                held["left"] -= len(at)
        yield from close()

    blocks = placed.select("key", "part", "n", "tokens", "index").mapInArrow(deal, "shard int, slots binary, records binary")
    ranges = blocks.repartitionById(max(1, shards), "shard")
    return saved(ranges.mapInArrow(write, "shard int, file string, first long, n long"), "manifest")


def read_shards(manifest: DataFrame, length: int = LENGTH, start: int = 0, packed: bool = False) -> DataFrame:
    """`slot`, `shard`, `key`, `part`, `n` and `tokens` of all records from slot `start` on, each
    shard read from its first wanted record to its end by one task. With `packed`, tokens are the
    bytes of the record, two for each token, the low one first."""
    kind = record_type(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, name = pafs.FileSystem.from_uri(row["file"])
                with files.open_input_file(name) as stream:
                    if stream.size() != row["n"] * kind.itemsize:
                        raise ValueError(f"{row['file']} has {stream.size()} bytes")
                    slot = max(row["first"], start)
                    stream.seek((slot - row["first"]) * kind.itemsize)
                    while data := stream.read(READ_RECORDS * kind.itemsize):
                        records = np.frombuffer(data, kind)
                        keys = np.ascontiguousarray(records["key"])
                        offsets = np.concatenate([[0], np.cumsum(records["n"], dtype=np.int64)]).astype(np.int32)
                        tokens = records["tokens"][np.arange(length) < records["n"][:, None]]
                        if packed:
                            buffers = [None, pa.py_buffer(2 * offsets), pa.py_buffer(tokens)]
                            tokens = pa.Array.from_buffers(pa.binary(), len(records), buffers)
                        else:
                            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.astype(np.int32)))
                        columns = {
                            "slot": pa.array(slot + np.arange(len(records))),
                            "shard": pa.array(np.full(len(records), row["shard"], np.int32)),
                            "key": pa.array(keys, mask=keys == NO_KEY),
                            "part": pa.array(records["part"].astype(np.int32)),
                            "n": pa.array(records["n"].astype(np.int32)),
                            "tokens": tokens,
                        }
                        yield pa.RecordBatch.from_pydict(columns)
                        slot += len(records)

    wanted = manifest.where(F.col("first") + F.col("n") > start).select("shard", "file", "first", "n")
    ddl = "slot long, shard int, key long, part int, n int, tokens " + ("binary" if packed else "array<int>")
    return wanted.repartition(max(1, wanted.count())).mapInArrow(run, ddl)


def tiktoken_ids(path: str, pattern: str) -> Callable:
    """A tokenizer for `sequences` from a rank file, by the library that reads it."""

    def tokenizer() -> Callable:
        def make():
            import base64

            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        encoding = resident(f"tiktoken {path}", make)
        return lambda texts: [encoding.encode_ordinary(t) for t in texts]

    return tokenizer


__all__ = ["read_shards", "sequences", "slots", "tiktoken_ids", "write_shards"]
