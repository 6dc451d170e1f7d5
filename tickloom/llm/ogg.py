"""Ogg media columns: writing and reading back multiplexed streams.

A page is a 27-byte header, up to 255 lacing values and a body; a packet is a
run of lacing values up to the first one below 255 and may go on over pages.
The reader verifies every page's checksum and sequence number, reassembles
packets, keeps logical streams apart by serial number, and dates packets from
granule positions.

A text is stored as 8-bit samples (the public OggPCM layout: a header packet,
then packets of samples whose granule position counts samples) beside a second
logical stream whose only packet after its header holds the text's byte length.

Defined cases: a null text counts as empty; the payload is padded with bytes 0 to
a positive multiple of 64, so an empty text is stored as 64 bytes.  Equal texts
give equal bytes.  Damaged media raise ValueError (`demultiplex`).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, utf8

HEAD = struct.Struct("<4sBBqIIIB")
RATE = 8000
UNIT = 64
#: Samples to a packet, and segments to a page.
PACKET = 4096
SEGMENTS = 255
CONTINUED, FIRST, LAST = 1, 2, 4
PCM = struct.Struct(">8sHHIIBBHI")
PCM_ID, LENGTH_ID = b"PCM     ", b"LENGTH  "
SAMPLES_SERIAL, LENGTH_SERIAL = 1, 2

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """The Ogg page checksum: the usual CRC-32 polynomial, high bit first, with no
    inversions; zlib's mirrored form of it on mirrored bytes."""
    mirrored = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    bare = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return bare[:22] + checksum(bare).to_bytes(4, "little") + bare[26:]


def paged(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream.  packets: data and the granule position at its
    end; the first, a header, gets a page of its own."""
    out: list[bytes] = []
    for group in (packets[:1], packets[1:]):
        lacing, body, granule, flags = bytearray(), bytearray(), -1, 0 if out else FIRST
        for data, end in group:
            at, full = 0, len(data) // 255
            left = full + 1
            while left:
                take = min(left, SEGMENTS - len(lacing))
                if not take:
                    out.append(page(serial, len(out), flags, granule, bytes(lacing), bytes(body)))
                    lacing, body, granule, flags = bytearray(), bytearray(), -1, CONTINUED if at else 0
                    continue
                left -= take
                stop = len(data) if not left else at + 255 * take
                lacing += b"\xff" * (take if left else take - 1)
                if not left:
                    lacing.append(len(data) % 255)
                    granule = end
                body += data[at:stop]
                at = stop
        if lacing:
            out.append(page(serial, len(out), flags, granule, bytes(lacing), bytes(body)))
    head = bytearray(out[-1])
    head[5] |= LAST
    head[22:26] = b"\0\0\0\0"
    out[-1] = bytes(head[:22]) + checksum(bytes(head)).to_bytes(4, "little") + bytes(head[26:])
    return out


def multiplexed(streams: list[list[bytes]]) -> bytes:
    """First pages first, then the other pages in turn."""
    rest = [s[1:] for s in streams]
    turns = max(map(len, rest), default=0)
    return b"".join([s[0] for s in streams] + [s[k] for k in range(turns) for s in rest if k < len(s)])


@dataclass
class Stream:
    """One logical stream: whole packets, and for each the granule position of the page
    on which it ends if it is the last to end there, else None."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    partial: list[bytes] | None = None


def demultiplex(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number."""
    streams: dict[int, Stream] = {}
    at, size = 0, len(data)
    while at < size:
        if size - at < HEAD.size:
            raise ValueError("a page header is cut off")
        magic, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = data[at + HEAD.size : at + HEAD.size + n]
        body = at + HEAD.size + n
        end = body + sum(lacing)
        if len(lacing) < n or end > size:
            raise ValueError("a page is cut off")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise ValueError(f"stream {serial} begins twice")
            streams[serial] = Stream()
        own = streams.get(serial)
        if own is None or own.ended or number != own.pages:
            raise ValueError(f"stream {serial}: page {number} is out of sequence")
        if bool(flags & CONTINUED) != (own.partial is not None):
            raise ValueError(f"stream {serial}: page {number} doesn't continue its packet")
        own.pages += 1
        ended, length, from_ = 0, 0, body
        for lace in lacing:
            length += lace
            if lace < 255:
                part = data[from_ : from_ + length]
                own.packets.append(part if own.partial is None else b"".join([*own.partial, part]))
                own.granules.append(None)
                own.partial, from_, length, ended = None, from_ + length, 0, ended + 1
        if lacing and lacing[-1] == 255:
            own.partial = [*(own.partial or []), data[from_:end]]
        if (granule == -1) != (not ended):
            raise ValueError(f"stream {serial}: page {number} is dated though no packet ends on it, or not though one does")
        if ended:
            own.granules[-1] = granule
        own.ended = bool(flags & LAST)
        at = end
    for serial, own in streams.items():
        if own.partial is not None or not own.ended:
            raise ValueError(f"stream {serial} is cut off")
    return streams


def store(text: bytes, rate: int = RATE) -> bytes:
    """A text's padded bytes as an Ogg file."""
    payload = text + bytes(-len(text) % UNIT or (0 if text else UNIT))
    head = PCM.pack(PCM_ID, 0, 0, 1, rate, 8, 1, PACKET, 0)
    samples = [(head, 0)] + [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    length = [(LENGTH_ID, 0), (struct.pack(">Q", len(text)), len(payload))]
    return multiplexed([paged(SAMPLES_SERIAL, samples), paged(LENGTH_SERIAL, length)])


@dataclass
class Media:
    payload: bytes
    n_bytes: int
    rate: int
    seconds: list[float]
    feature: str


def load(data: bytes) -> Media:
    """The samples, the times at which dated packets end, and a feature of the signal."""
    streams = demultiplex(data)
    by_id = {s.packets[0][:8]: s for s in streams.values()}
    samples, length = by_id[PCM_ID], by_id[LENGTH_ID]
    rate = PCM.unpack(samples.packets[0])[4]
    payload = b"".join(samples.packets[1:])
    dated = [g for g in samples.granules[1:] if g is not None]
    if dated[-1] != len(payload):
        raise ValueError("the last granule position isn't the number of samples")
    x = np.frombuffer(payload, np.uint8)
    total = int(x.sum(dtype=np.int64))
    square = int(np.dot(x.astype(np.float64), x))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    pages = sum(s.pages for s in streams.values())
    feature = f"streams={len(streams)} pages={pages} us={dated[-1] * 1_000_000 // rate} sum={total} square={square} crossings={crossings}"
    return Media(payload, struct.unpack(">Q", length.packets[1])[0], rate, [g / rate for g in dated], feature)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = utf8(batch.column(1))
        for i, j in slices(bounds):
            media = [store(data[bounds[k] : bounds[k + 1]].tobytes()) for k in range(i, j)]
            back = [load(m) for m in media]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array(media, pa.binary()),
                    pa.array([m.payload for m in back], pa.binary()),
                    pa.array([m.n_bytes for m in back], pa.int64()),
                    pa.array([m.seconds for m in back], pa.list_(pa.float64())),
                    pa.array([m.feature for m in back], pa.string()),
                ],
                ["doc_id", "media", "payload", "n_bytes", "seconds", "feature"],
            )


def media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, media (the Ogg file), and what is read back from it: payload, n_bytes,
    seconds (the time at which each dated packet ends) and feature."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_stored, f"doc_id {kind}, media binary, payload binary, n_bytes long, seconds array<double>, feature string")


def digests(docs: DataFrame) -> DataFrame:
    """The digests of each document's media and read-back payload."""
    return media(docs).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.expr("crc32(substring(payload, -64))").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.coalesce(F.element_at("seconds", -1), F.lit(0.0)).alias("seconds"),
    )
