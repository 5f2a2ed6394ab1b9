"""Ogg media columns: writing, page checks, packets, logical streams and timestamps.

A media column holds whole Ogg physical streams as bytes. The writer multiplexes two logical streams: samples
(unsigned 8-bit PCM behind a header packet) and notes (a header packet and one packet of key=value lines). The reader
knows nothing of that layout: it verifies each page's checksum, joins lacing values to packets over page ends,
separates the streams by serial number, and gives each packet the time that its page's granule position implies.

Damage is reported, not raised: pages with a wrong checksum count in ``bad_pages``, missing pages and packets without
an end in ``gaps``, and the packets that they cut are dropped. A null medium has no pages. Repeated rows give equal
rows; an empty table gives an empty table; further columns, whatever their names, are ignored. A text or medium of any
length is handled whole, one at a time: a task holds a few times the longest one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from kinweave.llm.shared import map_batches

HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
PCM_HEAD, NOTE_HEAD = b"\x01pcmu8", b"\x01notes"
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """CRC-32 of polynomial 04C11DB7, most significant bit first, start and end 0.

    zlib's is the same register mirrored, so mirrored bytes go in and a mirrored sum comes out.
    """
    mirrored = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(REVERSED), "big")


@dataclass
class StreamWriter:
    """Pages of one logical stream. ``pages`` fills as packets go in."""

    serial: int
    page_segments: int = 255
    pages: list[bytes] = field(default_factory=list)
    laces: list[int] = field(default_factory=list)
    data: list[bytes] = field(default_factory=list)
    granule: int = -1
    continued: bool = False

    def put(self, packet: bytes, granule: int, flush: bool = False, last: bool = False) -> None:
        at = 0
        for lace in [255] * (len(packet) // 255) + [len(packet) % 255]:
            if len(self.laces) == self.page_segments:
                self.emit(goes_on=at > 0)
            self.laces.append(lace)
            self.data.append(packet[at : at + lace])
            at += lace
        self.granule = granule
        if flush or last:
            self.emit(last=last)

    def emit(self, goes_on: bool = False, last: bool = False) -> None:
        flags = CONTINUED * self.continued | FIRST * (not self.pages) | LAST * last
        body = bytes(self.laces) + b"".join(self.data)
        head = HEADER.pack(b"OggS", 0, flags, self.granule, self.serial, len(self.pages), 0, len(self.laces))
        self.pages.append(head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body)
        self.laces, self.data, self.granule, self.continued = [], [], -1, goes_on


def write_samples(payload: bytes, rate: int = 8000, packet_samples: int = 4000, notes: dict[str, str] | None = None) -> bytes:
    """An Ogg physical stream with ``payload`` as unsigned 8-bit samples. Equal payloads give equal bytes."""
    seed = zlib.crc32(payload)
    pcm, note = StreamWriter(seed), StreamWriter(seed ^ 1)
    pcm.put(PCM_HEAD + struct.pack("<I", rate), 0, flush=True)
    note.put(NOTE_HEAD, 0, flush=True)
    note.put("\n".join(f"{k}={v}" for k, v in (notes or {}).items()).encode(), len(payload), last=True)
    for at in range(0, max(len(payload), 1), packet_samples):
        pcm.put(payload[at : at + packet_samples], min(at + packet_samples, len(payload)), last=at + packet_samples >= len(payload))
    # all first pages lead; then pages of the streams take turns
    rest = [p for k in range(1, max(len(pcm.pages), len(note.pages))) for s in (pcm, note) for p in s.pages[k : k + 1]]
    return b"".join([pcm.pages[0], note.pages[0], *rest])


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at each packet's end; -1 where no page states it.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    open: bytearray | None = None
    following: int = 0


@dataclass
class Physical:
    streams: dict[int, LogicalStream] = field(default_factory=dict)
    pages: int = 0
    bad_pages: int = 0


def demultiplex(media: bytes | None) -> Physical:
    """Logical streams of a physical stream, in the order in which they begin."""
    found, at = Physical(), 0
    while media:
        at = media.find(b"OggS", at)
        if at < 0 or at + HEADER.size > len(media):
            break
        _, version, flags, granule, serial, number, crc, segments = HEADER.unpack_from(media, at)
        table = media[at + HEADER.size : at + HEADER.size + segments]
        start = at + HEADER.size + segments
        end = start + sum(table)
        page = media[at:end]
        if version or len(table) < segments or end > len(media) or checksum(page[:22] + bytes(4) + page[26:]) != crc:
            found.bad_pages += 1
            at += 4  # look for the next page behind this capture pattern
            continue
        at = end
        found.pages += 1
        stream = found.streams.setdefault(serial, LogicalStream(serial))
        if number != stream.following:
            stream.gaps += 1
            stream.open = None
        elif stream.open and not flags & CONTINUED:
            stream.gaps += 1  # the packet that the page before left open has no end
        stream.following = number + 1
        stream.pages += 1
        stream.ended |= bool(flags & LAST)
        if not flags & CONTINUED:
            stream.open = bytearray()
        done, usable = 0, stream.open is not None
        buffer = stream.open if usable else bytearray()
        for lace in table:
            buffer += media[start : start + lace]
            start += lace
            if lace < 255:
                if usable:
                    stream.packets.append(bytes(buffer))
                    stream.granules.append(-1)
                    done += 1
                buffer, usable = bytearray(), True
        if done:
            stream.granules[-1] = granule
        stream.open = buffer if usable else None
    for stream in found.streams.values():
        stream.gaps += bool(stream.open)
    return found


@dataclass
class Samples:
    payload: bytes
    rate: int
    notes: dict[str, str]
    #: Seconds at each sample packet's end, from granule positions; packets between two known ones by their sizes.
    times: list[float]


def read_samples(found: Physical) -> Samples | None:
    """The sample stream of a physical stream, None if it has none."""
    pcm = next((s for s in found.streams.values() if s.packets and s.packets[0].startswith(PCM_HEAD)), None)
    if pcm is None:
        return None
    note = next((s for s in found.streams.values() if s.packets and s.packets[0].startswith(NOTE_HEAD)), None)
    lines = note.packets[1].decode().split("\n") if note and len(note.packets) > 1 else []
    rate = struct.unpack_from("<I", pcm.packets[0], len(PCM_HEAD))[0]
    sizes = np.cumsum([len(p) for p in pcm.packets[1:]], dtype=np.int64)
    known = np.array(pcm.granules[1:], np.int64)
    times = np.zeros(len(sizes))
    after = None
    for k in range(len(sizes) - 1, -1, -1):  # a page states the position of its last packet's end
        after = (known[k], sizes[k]) if known[k] >= 0 else after
        times[k] = (after[0] - (after[1] - sizes[k]) if after else sizes[k]) / max(rate, 1)
    return Samples(b"".join(pcm.packets[1:]), rate, dict(line.split("=", 1) for line in lines if "=" in line), times.tolist())


def padded(text: str | None, unit: int = 64) -> bytes:
    """UTF-8 and bytes 0 up to a positive multiple of ``unit``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % unit or (0 if data else unit))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``media``: each whole text as an Ogg physical stream, its unpadded length among the notes."""

    def run(keys: list, texts: list) -> dict:
        return {id_col: keys, "media": [write_samples(padded(t), notes={"n_bytes": str(len((t or "").encode("utf-8", "surrogatepass")))}) for t in texts]}

    return map_batches(docs, [id_col, text_col], run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, media binary")


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long, bad_pages long, gaps long, n_streams long, n_packets long, seconds double"


def probe(table: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Features of each medium, computed from the bytes that it holds."""

    def of(media: bytes | None) -> tuple:
        found = demultiplex(media)
        samples = read_samples(found)
        payload = samples.payload if samples else b""
        levels = np.frombuffer(payload, np.uint8)
        mean = float(levels.mean()) if len(levels) else 0.0
        peak = int(levels.max()) if len(levels) else 0
        streams = found.streams.values()
        packets, seconds = sum(len(s.packets) for s in streams), samples.times[-1] if samples and samples.times else 0.0
        feature = f"streams={len(streams)};packets={packets};seconds={seconds:.6f};mean={mean:.4f};peak={peak}"
        return (
            int(samples.notes.get("n_bytes", len(payload))) if samples else None, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media or b""),
            hashlib.sha256(media or b"").hexdigest(), feature, found.pages, found.bad_pages, sum(s.gaps for s in streams), len(streams), packets, seconds,
        )

    names = [part.split()[0] for part in FEATURES.split(", ")]

    def run(keys: list, media: list) -> dict:
        rows = [of(m) for m in media]
        return {id_col: keys} | {name: [r[i] for r in rows] for i, name in enumerate(names)}

    return map_batches(table, [id_col, media_col], run, f"`{id_col}` {dict(table.dtypes)[id_col]}, {FEATURES}")
