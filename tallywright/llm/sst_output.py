"""Token ids as sorted-string-table shards, looked up by document id with binary search.

A shard holds blocks, a sparse index, a Bloom filter and a footer:

    block   entries in key order: shared, unshared and value lengths (varints), the key's unshared bytes, the value.
            Every RESTART-th entry shares nothing; behind the entries come those entries' places and their number (four
            bytes each), so a search in a block is binary as well. A block closes at BLOCK bytes.
    index   for each block: last key, offset and length (varints)
    bloom   number of hashes (one byte), then the bits
    footer  FOOTER: offsets and lengths of index and bloom, documents, ids, bytes of an id, magic

Key: one byte (0 for a null id) and the id as eight big-endian bytes with its sign bit turned, so byte order is id order.
Value: little-endian ids of two or four bytes.

Edge cases: a null text is empty and holds the end id only; rows that repeat an id stay in a row, as separate entries,
ordered by text, so ties have one order; a null id sorts first; a very long text is one entry of a block of its own size;
other columns are left out; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_folder, bounded, pieces, removed, written
from .encode import encoder

BLOCK, RESTART, SHARD = 32 << 10, 16, 64 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQI4s")
MAGIC = b"TWST"
MANIFEST = "shard string, first long, last long, n_docs long, n_ids long, n_bytes long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def bloom_hashes(key: bytes, bits: int, count: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(count)]


class Writer:
    """One shard, written as it grows; only the open block, the index and the keys' hashes are held."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.in_block = bytearray(), b"", 0
        self.restarts: list[int] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.n_ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.in_block % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.in_block = key, self.in_block + 1
        self.keys.append(key)
        self.n_ids += len(value) // self.width
        if len(self.block) >= BLOCK:
            self.close_block()

    def close_block(self) -> None:
        if self.block:
            self.block += np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
            self.out.write(bytes(self.block))
            self.index.append((self.last, self.at, len(self.block)))
            self.at += len(self.block)
            self.block, self.in_block, self.restarts = bytearray(), 0, []

    def close(self) -> int:
        self.close_block()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index)
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for h in bloom_hashes(key, bits, BLOOM_HASHES):
                bloom[h >> 3] |= 1 << (h & 7)
        bloom = bytes([BLOOM_HASHES]) + bytes(bloom)
        self.out.write(index + bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.n_ids, self.width, MAGIC))
        return self.at + len(index) + len(bloom) + FOOTER.size


class Reader:
    """A shard by random access: footer, index and filter are read once, blocks one at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        at, n, bloom_at, bloom_n, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        source.seek(at)
        data, i, self.index = source.read(n), 0, []
        while i < len(data):
            k, i = read_varint(data, i)
            key, i = data[i : i + k], i + k
            offset, i = read_varint(data, i)
            length, i = read_varint(data, i)
            self.index.append((key, offset, length))
        source.seek(bloom_at)
        self.bloom = source.read(bloom_n)

    def read(self, offset: int, length: int) -> tuple[memoryview, np.ndarray]:
        """The entries of a block and the places of those that share nothing."""
        self.source.seek(offset)
        data = memoryview(self.source.read(length))
        count = int.from_bytes(data[-4:], "little")
        return data[: length - 4 - 4 * count], np.frombuffer(data[length - 4 - 4 * count : length - 4], "<u4")

    def entries(self, data: memoryview, at: int = 0) -> Iterator[tuple[bytes, memoryview]]:
        key = b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + bytes(data[at : at + rest])
            yield key, data[at + rest : at + rest + n]
            at += rest + n

    def __iter__(self):
        for _, offset, length in self.index:
            yield from self.entries(self.read(offset, length)[0])

    def ids(self, value) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def may_hold(self, key: bytes) -> bool:
        bits = (len(self.bloom) - 1) * 8
        return all(self.bloom[1 + (h >> 3)] >> (h & 7) & 1 for h in bloom_hashes(key, bits, self.bloom[0]))

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every entry with this id: filter, binary search in the index, then in its block (or a run of them)."""
        key, out = key_of(doc_id), []
        if not self.may_hold(key):
            return out
        i = bisect_left(self.index, key, key=lambda x: x[0])
        while i < len(self.index):
            data, restarts = self.read(*self.index[i][1:])
            # the last restart whose key is smaller; the id may stand before the next one
            j = max(0, bisect_left(restarts, key, key=lambda at: next(self.entries(data, int(at)))[0]) - 1)
            for k, value in self.entries(data, int(restarts[j])):
                if k == key:
                    out.append(self.ids(value))
                elif k > key:
                    return out
            i += 1
        return out


def opened(path: str, write: bool = False):
    """A file of any store that Arrow's file systems reach, for writing or by random access."""
    store, inside = fs.FileSystem.from_uri(path)
    if write:
        store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(inside)
    return store.open_input_file(inside)


def moved(old: str, new: str) -> None:
    store, inside = fs.FileSystem.from_uri(old)
    store.move(inside, fs.FileSystem.from_uri(new)[1])


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards in ascending id order below this folder, which all executors share; returns the manifest.

    A task writes under a name of its own and then renames, so a task that is run again leaves the same shards.
    """
    base = arrow_folder(docs.sparkSession, folder)

    def write(batches):
        task = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        shard = None

        def finish():
            writer, out, draft, name, first = shard
            size = writer.close()
            out.close()
            moved(draft, f"{base}/shards/{name}")
            return pa.RecordBatch.from_pylist(
                [{"shard": name, "first": first, "last": id_of(writer.last), "n_docs": len(writer.keys), "n_ids": writer.n_ids, "n_bytes": size}],
                pa.schema([("shard", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]),
            )

        rolls = 0
        for batch in batches:
            for part, texts in pieces(batch):
                flat, sizes = enc.encode(texts)
                ends, flat = np.cumsum(sizes), flat.astype(f"<u{width}")
                for doc_id, end, n in zip(part.column(0).to_pylist(), ends.tolist(), sizes.tolist()):
                    if shard is None:
                        name = f"{task:06d}-{rolls:04d}.sst"
                        draft = f"{base}/drafts/{name}.{uuid.uuid4().hex}"
                        shard = (Writer(out := opened(draft, True), width), out, draft, name, doc_id)
                    shard[0].add(key_of(doc_id), flat[end - n : end].tobytes() + end_id.to_bytes(width, "little"))
                    if shard[0].at >= SHARD:
                        yield finish()
                        shard, rolls = None, rolls + 1
        if shard is not None:
            yield finish()

    store, inside = fs.FileSystem.from_uri(f"{base}/shards")
    store.create_dir(inside, recursive=True)
    bounded(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = written(rows.mapInArrow(write, MANIFEST), f"{folder}/manifest")
    removed(docs.sparkSession, f"{folder}/drafts")  # of tasks that failed
    return manifest


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry, from the shards that the manifest names."""
    base = arrow_folder(spark, folder)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def read(batches):
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(f"{base}/shards/{name}") as source:
                    rows, reader = [], Reader(source)
                    for key, value in reader:
                        ids = reader.ids(value)
                        rows.append((id_of(key), before, len(ids), zlib.crc32(ids.astype("<u4"))))
                        before += len(ids)
                        if len(rows) == 4096:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    # one row for each shard: where its ids start among those of all shards; names are in id order, and begin with the task
    manifest = manifest.withColumn("task", F.substring("shard", 1, 6))
    tasks = manifest.groupBy("task").agg(F.sum("n_ids").alias("n")).select("task", F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)).alias("of_tasks"))
    own = F.sum("n_ids").over(W.partitionBy("task").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    starts = manifest.join(tasks, "task").select("shard", (F.coalesce("of_tasks", F.lit(0)) + F.coalesce(own, F.lit(0))).alias("earlier"))
    # a task for each shard: the number is given, so that small rows of names aren't put together
    return starts.repartition(max(1, manifest.count()), "shard").mapInArrow(read, RESULT)


def lookup(ids: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, ids) of every entry with an id of `ids`: each task opens the shards that may hold its ids.

    The manifest has a row for each shard (SHARD bytes), which tasks read themselves. Ids without an entry give no row; an
    id that is asked for more than once is looked up once.
    """
    base = arrow_folder(ids.sparkSession, folder)

    def find_shards(batches):
        from pyarrow import dataset

        store, inside = fs.FileSystem.from_uri(f"{base}/manifest")
        held = dataset.dataset(inside, filesystem=store, format="parquet").to_table(columns=["shard", "first", "last"]).to_pylist()
        held.sort(key=lambda x: x["shard"])
        firsts, lasts = ([key_of(x[c]) for x in held] for c in ("first", "last"))
        for batch in batches:
            rows = []
            for doc_id in batch.column(0).to_pylist():
                key = key_of(doc_id)
                rows += [(held[i]["shard"], doc_id) for i in range(bisect_left(lasts, key), bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["shard", "doc_id"])

    def find_ids(batches):
        for batch in batches:
            rows, reader, name, source = [], None, None, None
            for shard, doc_id in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                if shard != name:
                    if source:
                        source.close()
                    source = opened(f"{base}/shards/{shard}")
                    name, reader = shard, Reader(source)
                for x in reader.find(doc_id):
                    rows.append((doc_id, len(x), zlib.crc32(x.astype("<u4")), x.astype(np.int64)))
            if source:
                source.close()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["doc_id", "n_tokens", "ids_crc32", "ids"])

    wanted = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct().mapInArrow(find_shards, "shard string, doc_id long")
    wanted = wanted.repartition("shard").sortWithinPartitions("shard", "doc_id")
    return wanted.mapInArrow(find_ids, "doc_id long, n_tokens long, ids_crc32 long, ids array<long>")
