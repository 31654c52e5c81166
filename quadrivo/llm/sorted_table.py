"""Sorted-string-table shards of token ids.

A shard holds the documents of one key range in ascending order:

    blocks   entries of (shared, unshared, value bytes, key suffix, value), then the block's CRC-32
    bloom    bits of a Bloom filter over the keys
    index    for each block: first key, place, length, entries, ids before it
    footer   places and lengths of bloom and index, counts, format version, magic

Lengths are LEB128 numbers. A key is 9 bytes that sort as the identifiers do, null first; all but the first
key of a block are stored without the prefix they share with their predecessor. A value is the ids as
little-endian unsigned numbers of 2 or 4 bytes. A lookup asks the Bloom filter, searches the index by
bisection and reads the one block (more where a key repeats).
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_bpe
from .shared import arrow_map, batch_of, column_type, new_path, open_path

MAGIC, VERSION = b"QSSTABLE", 1
FOOTER = struct.Struct("<QQQQQQBB6x8s")
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 1 << 16, 10, 7


def encode_key(key: int | None) -> bytes:
    return b"\0" * 9 if key is None else b"\1" + struct.pack(">Q", (key + (1 << 63)) & (1 << 64) - 1)


def decode_key(raw: bytes) -> int | None:
    return None if raw[0] == 0 else struct.unpack(">Q", raw[1:])[0] - (1 << 63)


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_number(raw: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = raw[at]
        n |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes entries, given in ascending order of their keys, to an open stream. Holds one block, the keys' hashes and the index."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.block, self.index, self.last, self.first = bytearray(), [], b"", b""
        self.place = self.entries = self.in_block = self.ids = self.ids_before = 0
        self.hashes = array("Q")

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.ids_before = key, self.ids
        self.block += _number(shared) + _number(len(key) - shared) + _number(len(value)) + key[shared:] + value
        if key != self.last or not self.hashes:
            self.hashes.append(xxhash.xxh64_intdigest(key))
        self.last, self.in_block, self.entries, self.ids = key, self.in_block + 1, self.entries + 1, self.ids + len(value) // self.width
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            raw = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.out.write(raw)
            self.index.append((self.first, self.place, len(raw), self.in_block, self.ids_before))
            self.place += len(raw)
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.hashes))
        marks = np.zeros(bits, bool)
        h = np.frombuffer(self.hashes, np.uint64)
        for i in range(BLOOM_HASHES):  # as in _bloom_places; the sum stays below 2**36
            marks[((h & np.uint64(0xFFFFFFFF)) + np.uint64(i) * (h >> np.uint64(32) | np.uint64(1))) % np.uint64(bits)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(marks).tobytes()
        index = b"".join(k + struct.pack("<QQQQ", *rest) for k, *rest in self.index)
        self.out.write(bloom + index + FOOTER.pack(self.place, len(bloom), self.place + len(bloom), len(index), self.entries, self.ids, VERSION, self.width, MAGIC))


class ShardReader:
    """Reads a shard: get() by key, scan() in order, a block at a time."""

    def __init__(self, source):
        self.source, size = source, source.size()
        bloom_at, bloom_n, index_at, index_n, self.entries, self.ids, version, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        bloom, raw = self._read(bloom_at, bloom_n), self._read(index_at, index_n)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]
        self.blocks = [(raw[i : i + 9], *struct.unpack("<QQQQ", raw[i + 9 : i + 41])) for i in range(0, index_n, 41)]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def may_hold(self, key: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(encode_key(key), self.bits))

    def _entries(self, block: tuple) -> Iterator[tuple[bytes, int, memoryview]]:
        """Key, ids before it in the shard, and value bytes."""
        _, place, n, entries, before = block
        raw = self._read(place, n)
        if zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged block")
        view, at, last = memoryview(raw), 0, b""
        for _ in range(entries):
            shared, at = _read_number(view, at)
            own, at = _read_number(view, at)
            size, at = _read_number(view, at)
            last = last[:shared] + bytes(view[at : at + own])
            value = view[at + own : at + own + size]
            yield last, before, value
            before += size // self.width
            at += own + size

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for block in self.blocks:
            for key, before, value in self._entries(block):
                yield decode_key(key), before, np.frombuffer(value, f"<u{self.width}")

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each entry with this key, in order."""
        if not self.may_hold(key):
            return []
        want, found = encode_key(key), []
        at = max(0, bisect.bisect_left(self.blocks, want, key=lambda b: b[0]) - 1)
        for block in self.blocks[at:]:
            if block[0] > want:
                break
            found += [np.frombuffer(v, f"<u{self.width}") for k, _, v in self._entries(block) if k == want]
        return found


def write_sorted_table(df: DataFrame, tokenizer: str, path: str, text: str = "text", key: str = "doc_id", end_id: int = 0, block_bytes: int = BLOCK_BYTES) -> list[dict]:
    """Encodes text, appends end_id, and writes shards in ascending key order to the folder path, which all executors must reach.

    Returns the manifest in key order: a dict for each shard (path, entries, ids, bytes, first and last key, and start: ids in all shards before it).
    key must be an integer column (else TypeError). Equal keys are ordered by a hash of their text and then dealt at random, so that a hot key, even of equal texts,
    spreads over shards. A null text counts as empty; a null key sorts first; an empty table gives no shards. Each attempt of a task writes a file of
    its own name, and the manifest names those of the attempts that succeeded; what a killed or late attempt leaves is no part of the table.
    """
    if not isinstance(column_type(df, key), T.IntegralType):
        raise TypeError(f"{key} must be an integer column")
    schema = T._parse_datatype_string("shard int, path string, entries long, ids long, bytes long, first long, last long")

    def run(batches):
        bpe, task = byte_bpe(tokenizer), TaskContext.get()
        width, end, writer, store = bpe.dtype.itemsize, np.array([end_id], bpe.dtype), None, None
        name = f"shard-{task.partitionId():06d}-{uuid.uuid4().hex}.sst"
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if writer is None:
                    first = k
                    store, folder = open_path(path)
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}")
                    writer = ShardWriter(out, width, block_bytes)
                writer.add(encode_key(k), np.concatenate([bpe.ids(t), end]).tobytes())
        if writer:
            writer.close()
            out.close()
            yield batch_of([[task.partitionId()], [f"{path}/{name}"], [writer.entries], [writer.ids], [store.get_file_info(f"{folder}/{name}").size], [first], [decode_key(writer.last)]], schema)

    # The random number makes no difference to the result: rows that it parts are equal in key and text.
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"), F.rand(1).alias("deal"))
    order = ["key", "hash", "deal"]
    shards = sorted(arrow_map(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text"), run, schema).collect(), key=lambda s: s.shard)
    manifest, start = [], 0
    for s in shards:
        manifest.append(s.asDict() | {"start": start})
        start += s.ids
    return manifest


def read_sorted_table(spark: SparkSession, manifest: list[dict], key: str = "doc_id", key_type: T.DataType | None = None) -> DataFrame:
    """The table read back from its shards: key, start (ids of all entries before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers)."""
    schema = T.StructType([T.StructField(key, key_type or T.LongType()), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])

    def run(batches):
        for b in batches:
            for at in b.column(0).to_pylist():
                store, place = open_path(manifest[at]["path"])
                with store.open_input_file(place) as source:
                    rows = []
                    for k, before, ids in ShardReader(source).scan():
                        rows.append((k, manifest[at]["start"] + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield batch_of(list(zip(*rows)), schema)
                            rows = []
                    if rows:
                        yield batch_of(list(zip(*rows)), schema)

    n = len(manifest)
    return arrow_map(spark.range(0, n, 1, max(1, n)), run, schema)


def look_up(manifest: list[dict], key: int | None) -> list[np.ndarray]:
    """The ids of each entry with this key: bisection of the manifest, and of the index of the one shard that may hold it (or of the few over which a repeated key spreads), by its Bloom filter if it does at all."""
    found, want = [], encode_key(key)
    at = bisect.bisect_left(manifest, want, key=lambda s: encode_key(s["last"]))
    for shard in manifest[at:]:
        if encode_key(shard["first"]) > want:
            break
        store, place = open_path(shard["path"])
        with store.open_input_file(place) as source:
            found += ShardReader(source).get(key)
    return found


def sorted_table(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 0) -> DataFrame:
    """Writes df as shards in the shared folder and reads them back (see write_sorted_table, read_sorted_table)."""
    spark = df.sparkSession
    manifest = write_sorted_table(df, tokenizer, new_path(spark, "sorted-table"), text, key, end_id)
    return read_sorted_table(spark, manifest, key, column_type(df, key))
