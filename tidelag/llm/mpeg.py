"""MPEG-1 layer III streams: framing, tags, variable-bitrate table, checksums, seek offsets.

A payload is carried in the ancillary bytes of silent mono frames at 32 kHz: the side
information is all zero, so both granules hold no coded samples, and what follows the side
information up to the next header is free. Every frame has a CRC-16.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# Fixed values of the format: bit rates in kbit/s and sample rates in Hz of MPEG-1 layer III.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
OWNER = b"payload-bytes\x00"
RATE_INDEX = 2


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ 0x8005 if value & 0x8000 else value << 1
        table.append(value & 0xFFFF)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    value = 0xFFFF
    for byte in data:
        value = ((value << 8) & 0xFF00) ^ _CRC[(value >> 8) ^ byte]
    return value


@dataclass(frozen=True)
class Header:
    """What the four header bytes say."""

    length: int
    rate: int
    kbps: int
    mono: bool
    protected: bool

    @property
    def side(self) -> int:
        return 17 if self.mono else 32

    @property
    def body(self) -> int:
        """Bytes in front of the main data."""
        return 4 + 2 * self.protected + self.side


_HEADERS: dict[bytes, Header | None] = {}


def read_header(raw: bytes) -> Header | None:
    """None unless ``raw`` is a header of an MPEG-1 layer III frame with a known length."""
    if raw in _HEADERS:
        return _HEADERS[raw]
    header = None
    if len(raw) == 4 and raw[0] == 0xFF and raw[1] & 0xFE == 0xFA:
        kbps_index, rate_index = raw[2] >> 4, raw[2] >> 2 & 3
        if 0 < kbps_index < 15 and rate_index < 3:
            kbps, rate = BITRATES[kbps_index], RATES[rate_index]
            header = Header(144000 * kbps // rate + (raw[2] >> 1 & 1), rate, kbps, raw[3] >> 6 == 3, not raw[1] & 1)
    if len(_HEADERS) < 4096:
        _HEADERS[raw] = header
    return header


def _frame_starts() -> list[tuple[int, bytes]]:
    """(room for payload, header with CRC and silent side information) for each bit rate."""
    found = []
    for index in range(1, 15):
        raw = bytes((0xFF, 0xFA, index << 4 | RATE_INDEX << 2, 0xC0))
        header = read_header(raw)
        side = bytes(header.side)
        found.append((header.length - header.body, raw + struct.pack(">H", crc16(raw[2:] + side)) + side))
    return found


_STARTS = _frame_starts()


def _synchsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def write_stream(payload: bytes) -> bytes:
    """A tagged variable-bitrate stream that carries ``payload``; empty payloads are allowed."""
    room, start = _STARTS[-1]
    frames = [start + payload[i : i + room] for i in range(0, len(payload) - len(payload) % room, room)]
    rest = payload[len(frames) * room :]
    if rest:
        fit, head = next(x for x in _STARTS if x[0] >= len(rest))
        frames.append(head + rest + bytes(fit - len(rest)))
    sizes = [len(f) for f in frames]
    total = sum(sizes)
    info_room, info_start = next(x for x in _STARTS if x[0] >= 120)
    whole = total + info_room + len(info_start)
    ends, at = [], 0
    for size in sizes:
        ends.append(at)
        at += size
    toc = bytes(min(255, 256 * (whole - total + ends[k * len(ends) // 100]) // whole) if ends else 0 for k in range(100))
    info = b"Xing" + struct.pack(">III", 7, len(frames), whole) + toc
    private = OWNER + struct.pack(">Q", len(payload))
    tag = b"PRIV" + struct.pack(">IH", len(private), 0) + private
    return b"".join((b"ID3\x03\x00\x00", _synchsafe(len(tag)), tag, info_start, info, bytes(info_room - len(info)), *frames))


@dataclass
class Stream:
    """What a stream holds. ``offsets`` are those of the audio frames, for seeking."""

    tags: dict[str, bytes] = field(default_factory=dict)
    declared_frames: int | None = None
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)
    kbps_total: int = 0
    samples: int = 0
    rate: int = 0
    bad_crc: int = 0
    skipped: int = 0
    payload: bytes = b""

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _read_tag(data: bytes, out: Stream) -> int:
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    at, end = 10, min(10 + size, len(data))
    while at + 10 <= end and data[at] and data[at : at + 4].isalnum():
        (length,) = struct.unpack_from(">I", data, at + 4)
        out.tags[data[at : at + 4].decode("latin-1")] = data[at + 10 : min(at + 10 + length, end)]
        at += 10 + length
    return 10 + size


def read_stream(data: bytes) -> Stream:
    """Parse a stream; bytes that are no frame are skipped up to the next pair of headers that fit.

    A frame that follows the last one at once and has a sound checksum needs no header behind it.
    Frames whose checksum fails are counted, keep their place in time, and give no payload.
    """
    out, parts = Stream(), []
    at, end, first = _read_tag(data, out), len(data), True
    if data[-128:-125] == b"TAG" and end >= 128:
        end -= 128
    checked: dict[bytes, bool] = {}
    expected = at
    while at + 4 <= end:
        header = read_header(data[at : at + 4])
        stop = at + header.length if header else 0
        body, sound = at + (header.body if header else 0), True
        if header and header.protected and stop <= end:
            covered = data[at + 2 : body]
            if (sound := checked.get(covered)) is None:
                sound = crc16(covered[:2] + covered[4:]) == covered[2] << 8 | covered[3]
                if len(checked) < 256:
                    checked[covered] = sound
        led_on = stop + 4 > end or read_header(data[stop : stop + 4]) is not None
        in_sync = at == expected and header is not None and header.protected and sound
        if header is None or stop > end or not (led_on or in_sync):
            further = data.find(b"\xff", at + 1, end)
            further = end if further < 0 else further
            out.skipped += further - at
            at = further
            continue
        if first and data[body : body + 4] in (b"Xing", b"Info"):
            flags, where = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8
            if flags & 1:
                out.declared_frames = int.from_bytes(data[where : where + 4], "big")
                where += 4
            where += 4 * (flags >> 1 & 1)
            if flags & 4:
                out.toc = data[where : where + 100]
        else:
            out.offsets.append(at)
            out.samples += SAMPLES
            out.kbps_total += header.kbps
            out.rate = header.rate
            if sound:
                parts.append(data[body:stop])
            else:
                out.bad_crc += 1
        first = False
        at = expected = stop
    out.skipped += end - at
    out.payload = b"".join(parts)
    owned = out.tags.get("PRIV", b"")
    if owned.startswith(OWNER):
        out.payload = out.payload[: int.from_bytes(owned[len(OWNER) :], "big")]
    return out
