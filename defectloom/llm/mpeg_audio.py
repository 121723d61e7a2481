"""MPEG audio (versions 1, 2 and 2.5, layers I to III): a reader for binary columns, and a carrier of bytes.

The reader resynchronises on frame headers, parses ID3v2 and ID3v1 tags and
Xing/Info/VBRI tables, verifies frame checksums of all layers, and gives exact
durations in samples and the byte offset of every frame. Frames of free format,
whose size no header states, are passed over like other bytes between frames.

The carrier stores any payload losslessly as the main data of variable-bitrate
MPEG-1 layer III frames (48 kHz, two channels, with checksums), between an ID3v2
tag with a Xing table and an ID3v1 tag, so that no byte of a payload stands
where a reader looks for tags.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the standard: kbit/s by bitrate index, Hz by rate index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


def _crc_table() -> np.ndarray:
    """CRC-16 of the standard: polynomial 0x8005, most significant bit first."""
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x8005, table << 1) & 0xFFFF
    return table


_CRC = _crc_table()
_CRC_LIST = _CRC.tolist()


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for b in data:
        crc = crc << 8 & 0xFFFF ^ _CRC_LIST[crc >> 8 ^ b]
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """The same over the first ``bits`` bits of the data."""
    crc = crc16(data[: bits >> 3])
    for i in range(bits & ~7, bits):
        top = crc >> 15 ^ data[i >> 3] >> (7 - (i & 7)) & 1
        crc = crc << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return crc


# Fixed values of the standard: bits of a subband's allocation in layer II, by table.
ALLOCATION_BITS = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def allocation_table(version: float, rate: int, kbit_per_channel: int) -> tuple[int, ...]:
    """The layer II table that a header calls for."""
    if version != 1:
        return ALLOCATION_BITS["low"]
    if kbit_per_channel <= 48:
        return ALLOCATION_BITS["d" if rate == 32000 else "c"]
    return ALLOCATION_BITS["a" if rate == 48000 or kbit_per_channel <= 80 else "b"]


def protected_bits(b: bytes, at: int, h: Header) -> int:
    """Bits after the checksum of a layer I or II frame that it covers: allocations, and in layer II the scale factor selections."""
    bound = (b[at + 3] >> 4 & 3) * 4 + 4 if h.mode == 1 else 32
    if h.layer == 1:
        return 4 * (bound * h.channels + 32 - bound) if h.channels == 2 else 128
    value, left = int.from_bytes(b[at + 6 : at + 6 + 64].ljust(64, b"\0"), "big"), 512
    chosen = 0
    for subband, n in enumerate(allocation_table(h.version, h.rate, h.bitrate // h.channels)):
        shared = h.channels == 2 and subband >= bound
        for _ in range(1 if shared else h.channels):
            left -= n
            if value >> left & (1 << n) - 1:
                chosen += 2 if shared else 1
    return 512 - left + 2 * chosen


class Header:
    """One frame header; ``parse`` gives None where the four bytes are none."""

    __slots__ = ("bitrate", "channels", "crc", "layer", "mode", "rate", "samples", "side", "size", "version")

    @staticmethod
    def parse(b: bytes, at: int) -> Header | None:
        if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
            return None
        v, layer = b[at + 1] >> 3 & 3, 4 - (b[at + 1] >> 1 & 3)
        bits, rate = b[at + 2] >> 4, b[at + 2] >> 2 & 3
        if v == 1 or layer == 4 or bits in (0, 15) or rate == 3:
            return None
        h = Header()
        h.version, h.layer, h.crc = {0: 2.5, 2: 2, 3: 1}[v], layer, not b[at + 1] & 1
        h.bitrate, h.rate = BITRATES[1 if h.version == 1 else 2, layer][bits], RATES[h.version][rate]
        h.mode = b[at + 3] >> 6
        h.channels = 1 if h.mode == 3 else 2
        pad = b[at + 2] >> 1 & 1
        h.samples = 384 if layer == 1 else 1152 if layer == 2 or h.version == 1 else 576
        if layer == 1:
            h.size = (12000 * h.bitrate // h.rate + pad) * 4
        else:
            h.size = h.samples // 8 * 1000 * h.bitrate // h.rate + pad
        h.side = ((32, 17) if h.version == 1 else (17, 9))[h.channels == 1] if layer == 3 else 0
        return h

    def alike(self, o: Header) -> bool:
        return (self.version, self.layer, self.rate) == (o.version, o.layer, o.rate)


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _unsync(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def _text(b: bytes) -> str:
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0], "latin-1") if b else "latin-1"
    return b[1:].decode(kind, "replace")


def parse_tags(b: bytes) -> tuple[dict[str, str], int, int, bool | None]:
    """Tags, where audio begins and ends, and whether the tag's own CRC-32 holds (None: it has none)."""
    tags: dict[str, str] = {}
    begin, end, holds = 0, len(b), None
    if b[:3] == b"ID3" and len(b) >= 10 and b[3] in (2, 3, 4):
        size = _syncsafe(b[6:10])
        begin = min(len(b), 10 + size + (10 if b[5] & 0x10 else 0))
        at, stop = 10, min(len(b), 10 + size)
        if b[5] & 0x40 and b[3] == 3 and at + 10 <= stop:
            n, flags, pad = struct.unpack_from(">IHI", b, at)
            if flags & 0x8000 and at + 14 <= stop:
                holds = zlib.crc32(b[at + 4 + n : stop - pad]) == struct.unpack_from(">I", b, at + 10)[0]
            at += 4 + n
        elif b[5] & 0x40 and b[3] == 4 and at + 4 <= stop:
            at += _syncsafe(b[at : at + 4])
        head = 6 if b[3] == 2 else 10
        while at + head <= stop and b[at]:
            name = b[at : at + (3 if head == 6 else 4)].decode("latin-1")
            n = int.from_bytes(b[at + 3 : at + 6], "big") if head == 6 else _syncsafe(b[at + 4 : at + 8]) if b[3] == 4 else int.from_bytes(b[at + 4 : at + 8], "big")
            body = b[at + head : min(stop, at + head + n)]
            if name[0] == "T":
                value = _text(body).rstrip("\0")
                if name[:3] == "TXX":
                    label, _, value = value.partition("\0")
                    name = f"{name}:{label}"
                tags[name] = value
            at += head + n
    if len(b) - begin >= 128 and b[-128:-125] == b"TAG":
        end = len(b) - 128
        for name, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := b[end + lo : end + hi].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(f"ID3v1:{name}", value)
    return tags, begin, end, holds


def parse(b: bytes | None) -> dict:
    """All that is known of one recording; null or bytes without frames give zero frames.

    A frame counts where the one before it ended, if it is like the first.
    Elsewhere the reader moves on byte by byte (``resyncs`` counts such gaps,
    ``skipped`` the bytes) to a frame that another like it, or the end, follows.
    """
    b = b or b""
    tags, at, end, tag_crc = parse_tags(b)
    out = {"n_frames": 0, "samples": 0, "rate": 0, "duration_us": 0, "channels": 0, "version": 0.0, "layer": 0, "vbr": False, "table": None, "table_frames": None, "table_bytes": None, "crc_frames": 0, "crc_bad": 0, "resyncs": 0, "skipped": 0, "tag_crc_ok": tag_crc, "tags": tags, "offsets": []}
    first: Header | None = None
    rates: set[int] = set()
    checks: list[tuple[int, Header]] = []
    gap, in_step = False, False
    while at + 4 <= end:
        h = Header.parse(b, at)
        if h and (first is None or h.alike(first)) and at + h.size <= end:
            n = Header.parse(b, at + h.size)
            if in_step or at + h.size + 4 > end or (n and n.alike(h)):
                in_step = True
                if gap:
                    out["resyncs"] += 1
                    gap = False
                if first is None:
                    first = h
                    out |= {"rate": h.rate, "channels": h.channels, "version": float(h.version), "layer": h.layer}
                    if table := _table(b, at, h):
                        out["table"], out["table_frames"], out["table_bytes"] = table
                        at += h.size
                        continue
                out["offsets"].append(at)
                rates.add(h.bitrate)
                out["samples"] += h.samples
                if h.crc:
                    checks.append((at, h))
                at += h.size
                continue
        gap, in_step = True, False
        sync = b.find(b"\xff", at + 1, end)
        out["skipped"] += (sync if sync >= 0 else end) - at
        at = sync if sync >= 0 else end
    out["n_frames"] = len(out["offsets"])
    out["vbr"] = len(rates) > 1
    if first:
        out["duration_us"] = out["samples"] * 1_000_000 // out["rate"]
        out["crc_frames"] = len(checks)
        for side in {h.side for _, h in checks if h.layer == 3}:
            out["crc_bad"] += _bad(b, np.array([at for at, h in checks if h.layer == 3 and h.side == side], dtype=np.int64), side)
        for at, h in checks:
            if h.layer < 3:
                bits = protected_bits(b, at, h)
                out["crc_bad"] += crc16_bits(b[at + 2 : at + 4] + b[at + 6 : at + 6 + (bits + 7 >> 3)].ljust(bits + 7 >> 3, b"\0"), 16 + bits) != int.from_bytes(b[at + 4 : at + 6], "big")
    return out


def _bad(b: bytes, at: np.ndarray, side: int) -> int:
    """Layer III frames whose checksum over the last two header bytes and the side information of ``side`` bytes fails, all at once."""
    if not at.size:
        return 0
    data = np.frombuffer(b, dtype=np.uint8).astype(np.uint32)
    crc = np.full(at.size, 0xFFFF, dtype=np.uint32)
    for i in (2, 3, *range(6, 6 + side)):
        crc = crc << 8 & 0xFFFF ^ _CRC[crc >> 8 ^ data[at + i]]
    return int((crc != (data[at + 4] << 8 | data[at + 5])).sum())


def _table(b: bytes, at: int, h: Header) -> tuple[str, int | None, int | None] | None:
    """The variable-bitrate table in the first frame: kind, frames, bytes."""
    x = at + 4 + 2 * h.crc + h.side
    for x in (x, at + 4 + h.side):
        if b[x : x + 4] in (b"Xing", b"Info"):
            flags, y = int.from_bytes(b[x + 4 : x + 8], "big"), x + 8
            frames = int.from_bytes(b[y : y + 4], "big") if flags & 1 else None
            y += 4 * (flags & 1)
            return b[x : x + 4].decode(), frames, int.from_bytes(b[y : y + 4], "big") if flags & 2 else None
    if b[at + 36 : at + 40] == b"VBRI":
        return "VBRI", int.from_bytes(b[at + 50 : at + 54], "big"), int.from_bytes(b[at + 46 : at + 50], "big")
    return None


# The carrier's frames: MPEG-1 layer III at 48 kHz, so a frame has 3 bytes for each kbit/s.
_INDEX = {kbit: i for i, kbit in enumerate(BITRATES[1, 3])}
_HEAD = 4 + 2 + 32


def _frame(kbit: int, body: bytes) -> bytes:
    head = bytes((0xFF, 0xFA, _INDEX[kbit] << 4 | 1 << 2, 0))
    side = bytes(32)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side + body + bytes(3 * kbit - _HEAD - len(body))


_HEADS = {k: _frame(k, b"")[:_HEAD] for k in BITRATES[1, 3][1:]}
_LARGEST = 3 * 320 - _HEAD
#: The tag at the end of a carrier, without any field.
_ID3V1 = b"TAG" + bytes(124) + b"\xff"


def encode_payload(payload: bytes) -> bytes:
    """A recording that carries ``payload``, the same for equal payloads."""
    frames = [_HEADS[320] + payload[at : at + _LARGEST] for at in range(0, len(payload) - _LARGEST + 1, _LARGEST)]
    if rest := payload[len(frames) * _LARGEST :]:
        kbit = next(k for k in BITRATES[1, 3][1:] if 3 * k - _HEAD >= len(rest))
        frames.append(_HEADS[kbit] + rest + bytes(3 * kbit - _HEAD - len(rest)))
    audio = b"".join(frames)
    total, step = len(audio), max(1, len(frames))
    toc = bytes(min(255, min(i * step // 100 * 960, total) * 256 // max(1, total)) for i in range(100))
    xing = _frame(128, b"Xing" + struct.pack(">III", 7, len(frames), total + 384) + toc)
    body = b"\0payload-bytes\0" + str(len(payload)).encode() + b"\0"
    body2 = b"\0payload-crc32\0" + str(zlib.crc32(payload)).encode() + b"\0"
    tag = b"".join(b"TXXX" + len(x).to_bytes(4, "big") + b"\0\0" + x for x in (body, body2))
    extended = struct.pack(">IHII", 10, 0x8000, 0, zlib.crc32(tag))
    return b"ID3\3\0\x40" + _unsync(len(extended + tag)) + extended + tag + xing + audio + _ID3V1


def decode_payload(media: bytes, found: dict | None = None) -> bytes:
    """The payload, read from the frames that :func:`parse` finds; raises ValueError where a check fails."""
    found = found or parse(media)
    if found["crc_bad"] or not found["tag_crc_ok"] or found["table_frames"] != found["n_frames"]:
        raise ValueError("a checksum or the frame table does not hold")
    at = found["offsets"]
    ends = [*at[1:], *(a + Header.parse(media, a).size for a in at[-1:])]
    payload = b"".join(media[a + _HEAD : e] for a, e in zip(at, ends))[: int(found["tags"]["TXXX:payload-bytes"])]
    if zlib.crc32(payload) != int(found["tags"]["TXXX:payload-crc32"]):
        raise ValueError("the payload differs")
    return payload


_FOUND = pa.struct(
    [("n_frames", pa.int64()), ("samples", pa.int64()), ("rate", pa.int32()), ("duration_us", pa.int64()), ("channels", pa.int32()), ("version", pa.float64()), ("layer", pa.int32()), ("vbr", pa.bool_()), ("table", pa.string()), ("table_frames", pa.int64()), ("table_bytes", pa.int64()), ("crc_frames", pa.int64()), ("crc_bad", pa.int64()), ("resyncs", pa.int64()), ("skipped", pa.int64()), ("tag_crc_ok", pa.bool_()), ("tags", pa.map_(pa.string(), pa.string())), ("offsets", pa.list_(pa.int64()))]
)
FOUND_DDL = "struct<n_frames:long,samples:long,rate:int,duration_us:long,channels:int,version:double,layer:int,vbr:boolean,table:string,table_frames:long,table_bytes:long,crc_frames:long,crc_bad:long,resyncs:long,skipped:long,tag_crc_ok:boolean,tags:map<string,string>,offsets:array<long>>"


def with_audio(df: DataFrame, id_col: str, media: str) -> DataFrame:
    """Rows (id, audio): what :func:`parse` finds in the binary column ``media``, for every row; null media have no frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [parse(m.as_py()) for m in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([x | {"tags": list(x["tags"].items())} for x in found], _FOUND)], ["id", "audio"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media).cast("binary").alias("m")).mapInArrow(run, f"id long, audio {FOUND_DDL}")


def carried_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores every whole text as a recording, reads it back and describes what was read.

    The payload is the text as UTF-8 (null: empty) and bytes 0 up to a positive
    multiple of 64. Returns doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32 (of the last 64 payload bytes), media_bytes, media_sha256,
    feature, n_frames, duration_us and, with ``keep_media``, media and offsets.
    Every row counts; equal texts give equal values.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_us"]
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_us long"
    if keep_media:
        names, types, ddl = [*names, "media", "offsets"], [*types, pa.binary(), pa.list_(pa.int64())], ddl + ", media binary, offsets array<long>"

    def one(doc, raw: bytes) -> tuple:
        media = encode_payload(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
        found = parse(media)
        try:
            payload = decode_payload(media, found)
        except ValueError as e:
            raise ValueError(f"{id_col} {doc}: {e}") from e
        shown = (found["n_frames"], found["samples"], found["rate"], found["channels"], "vbr" if found["vbr"] else "cbr", found["crc_frames"] - found["crc_bad"], found["resyncs"], found["offsets"][0], found["offsets"][-1])
        feature = "frames={} samples={} rate={} channels={} {} crc_ok={} resyncs={} first={} last={}".format(*shown)
        row = (doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, found["n_frames"], found["duration_us"])
        return (*row, media, found["offsets"]) if keep_media else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [one(d, r or b"") for d, r in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text), "UTF-8").alias("raw")).mapInArrow(run, ddl)
