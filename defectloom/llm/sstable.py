"""Token ids in sorted-string-table shards, one file per key range.

File: data blocks, block index, Bloom filter, footer.

* A block holds records in key order: varint shared and own key length, varint
  value length, the key's own bytes, the value; every 16th record restarts with a
  whole key, and the block ends with its restart offsets, their number and a
  crc32. Values are ids as little-endian unsigned 16-bit integers if all fit,
  else 32-bit ones, after one byte that says which.
* The index has first key, offset and length of every block; it is the only
  thing a lookup needs besides the Bloom filter and one block.
* The footer has the places of index and filter, numbers of records and of
  tokens, the index's crc32 and a magic number.

Keys are ids as 8 bytes big-endian with the sign bit flipped, after one byte:
0 for null, 1 else. Files are written under a name of the task attempt and then
renamed, so that a lost or repeated task leaves whole files only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectloom.llm import bpe
from defectloom.llm.common import new_folder

FOOTER = struct.Struct("<QQQQQQI8s")
MAGIC = b"DLSSTAB1"
BLOCK_BYTES, RESTART_EVERY, BLOOM_BITS, BLOOM_HASHES = 64 * 1024, 16, 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        n |= (x & 127) << shift
        at, shift = at + 1, shift + 7
        if x < 128:
            return n, at


def pack_ids(ids: bytes) -> bytes:
    a = np.frombuffer(ids, dtype="<u4")
    return b"\2" + a.astype("<u2").tobytes() if not a.size or a.max() < 65_536 else b"\4" + ids


def unpack_ids(value: bytes) -> bytes:
    return value[1:] if value[0] == 4 else np.frombuffer(value, dtype="<u2", offset=1).astype("<u4").tobytes()


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class TableWriter:
    """Writes records, given in key order, to a file object; memory holds one block, the index and the filter's keys."""

    def __init__(self, file):
        self.file, self.at, self.index, self.keys = file, 0, [], []
        self.records = self.tokens = 0
        self._start()

    def _start(self) -> None:
        self.block, self.restarts, self.last, self.n = bytearray(), [], b"", 0

    def add(self, key: bytes, ids: bytes) -> None:
        if not self.n:
            self.first = key
        shared = 0
        if self.n % RESTART_EVERY:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        value = pack_ids(ids)
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        self.keys.append(key)
        self.records, self.tokens = self.records + 1, self.tokens + len(ids) // 4
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        body += struct.pack("<I", zlib.crc32(body))
        self.index.append((self.first, self.at, len(body)))
        self.file.write(body)
        self.at += len(body)
        self._start()

    def close(self) -> None:
        if self.n:
            self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", at, size) for k, at, size in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys)) + 7 & ~7
        bloom = np.zeros(bits, dtype=bool)
        for k in self.keys:
            bloom[_bloom_places(k, bits)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.file.write(index + packed)
        self.file.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.records, self.tokens, zlib.crc32(index), MAGIC))


class TableReader:
    """Reads one shard through a random-access file; raises ValueError where a checksum fails."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        f = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if f[7] != MAGIC:
            raise ValueError("not a table of this format")
        self.records, self.tokens = f[4], f[5]
        raw = self._at(f[0], f[1])
        if zlib.crc32(raw) != f[6]:
            raise ValueError("index checksum differs")
        self._bloom_at = f[2], f[3]
        self._bloom: bytes | None = None
        self.first_keys: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        at = 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.first_keys.append(raw[at : at + n])
            self.blocks.append(struct.unpack_from("<QQ", raw, at + n))
            at += n + 16

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        body = self._at(*self.blocks[i])
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("block checksum differs")
        (n,) = struct.unpack_from("<I", body, len(body) - 8)
        end = len(body) - 8 - 4 * n
        return body[:end], list(struct.unpack_from(f"<{n}I", body, end))

    @staticmethod
    def _records(body: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            own, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + own]
            at += own + size
            yield key, body[at - size : at]

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self._records(self._block(i)[0], 0)

    def get(self, key: bytes) -> list[bytes]:
        """Ids of all records with the key: Bloom filter, binary search of index and restarts, short scan."""
        if self._bloom is None:
            self._bloom = self._at(*self._bloom_at)
        if any(not self._bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, 8 * len(self._bloom))):
            return []
        found: list[bytes] = []
        i = max(0, bisect_right(self.first_keys, key) - 1)
        while i and self.first_keys[i] == key:
            i -= 1
        while i < len(self.blocks) and self.first_keys[i] <= key:
            body, restarts = self._block(i)
            lo, hi = 0, len(restarts) - 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if next(self._records(body, restarts[mid]))[0] < key:
                    lo = mid
                else:
                    hi = mid - 1
            for k, v in self._records(body, restarts[lo]):
                if k > key:
                    return found
                if k == key:
                    found.append(unpack_ids(v))
            i += 1
        return found


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path)
    return fs, at


def write_tables(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text: str = "text", cache_entries: int = 1_000_000) -> list[tuple[str, int, int]]:
    """Writes the shards under ``folder`` and returns (file, records, tokens) of each, in key order.

    Texts are dealt by ranges of id and text hash and sorted before they are
    encoded, so ids are never shuffled and an id of very many rows, such as
    null, takes several shards (equal texts of one id lie in one). Null texts
    are empty, null ids come first, rows of equal id are in the order of their
    texts' hashes. The list has one entry per shard.
    """
    path = tokenizer or bpe.default_tokenizer()
    folder = folder.rstrip("/")
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(path, cache_entries)
        end = end_id.to_bytes(4, "little")
        task = TaskContext.get()
        shard = task.partitionId()
        fs, at = _open(folder)
        part = f"{at}/.part-{shard:06d}-{uuid.uuid4().hex}"
        writer = None
        with fs.open_output_stream(part) as file:
            writer = TableWriter(file)
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    rows = batch.slice(i, 512)
                    for doc, ids in zip(rows.column(0).to_pylist(), encode.encode_many([t or "" for t in rows.column(1).to_pylist()])):
                        writer.add(key_of(doc), ids + end)
            writer.close()
        name = f"shard-{shard:06d}.sst"
        fs.move(part, f"{at}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int64()), (name, pa.string()), (writer.records, pa.int64()), (writer.tokens, pa.int64()))], ["shard", "file", "records", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    dealt = rows.repartitionByRange("id", "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h")
    shards = dealt.select("id", "t").mapInArrow(run, "shard long, file string, records long, tokens long").collect()  # one row per shard
    return [(r["file"], r["records"], r["tokens"]) for r in sorted(shards, key=lambda r: r["shard"])]


def read_tables(spark, folder: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of all records, from the files; one task per shard."""
    folder, starts, total = folder.rstrip("/"), [], 0
    for name, _, tokens in shards:
        starts.append((name, total))
        total += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in (starts[i] for i in batch.column(0).to_pylist()):
                fs, at = _open(folder)
                with fs.open_input_file(f"{at}/{name}") as file:
                    reader, out = TableReader(file), []
                    for key, value in reader.scan():
                        ids = unpack_ids(value)
                        out.append((id_of(key), start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(out) == 8192:
                            yield _batch(out)
                            out = []
                    yield _batch(out)

    return spark.range(0, len(starts), 1, max(1, len(starts))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(folder: str, shards: list[tuple[str, int, int]], doc_id: int | None) -> list[bytes]:
    """Ids of the documents with this id: binary search over the shards' first keys, then in the shards that may hold it."""
    key, found = key_of(doc_id), []
    fs, at = _open(folder.rstrip("/"))
    lo, hi = 0, len(shards) - 1

    def reader(i: int) -> TableReader:
        return TableReader(fs.open_input_file(f"{at}/{shards[i][0]}"))

    while lo < hi:
        mid = (lo + hi + 1) // 2
        first = next((reader(j).first_keys[0] for j in range(mid, hi + 1) if shards[j][1]), None)
        if first is not None and first < key:  # a key may begin in the shard before one that it fills
            lo = mid
        else:
            hi = mid - 1
    for i in range(lo, len(shards)):
        if shards[i][1]:
            r = reader(i)
            if i > lo and r.first_keys[0] > key:
                break
            found += r.get(key)
    return found


def token_tables(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes ``docs`` to shards in ``folder`` (by default a new one in the shared folder) and reads them back.

    Returns (doc_id, start, n_tokens, ids_crc32): ``start`` counts the ids of
    all documents before, ``n_tokens`` has the end id in it. Every row is one
    record, repeated rows too; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "sst")
    return read_tables(spark, folder, write_tables(docs, folder, tokenizer, end_id, id_col, text))
