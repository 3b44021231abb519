"""MPEG audio columns: build streams that carry bytes, and parse streams of any origin.

``pack`` writes an ID3v2 tag, a Xing table and MPEG-1 layer III frames with checksums; the
bytes carried stand in the main data of the frames as ancillary data, so that a player plays
silence. ``parse`` reads MPEG-1, 2 and 2.5 of all layers, free-format streams too: it reads tags
of both versions, resynchronises on two consistent frame headers, verifies the checksums of all
layers, reads Xing, Info and VBRI tables with their seek points, and gives exact sample counts
and the offset of every frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import sliced

# Fixed values of the format: kbit/s by (MPEG-1, layer) and index, Hz by version bits and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}

#: Fixed values of the format: bits of the allocation of layer II by subband, as runs of (subbands, bits).
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}

#: Size of header, checksum and side information of the frames that ``pack`` writes.
HEAD = 38


@lru_cache(None)
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return tuple(out)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The checksum of the format: polynomial 0x8005, first value 0xFFFF."""
    c, table = 0xFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ table[(c >> 8) ^ b]
    return c


def crc16_bits(data: bytes, first: int, n: int, c: int = 0xFFFF) -> int:
    """The checksum over ``n`` bits from bit ``first`` on, begun with ``c``; for parts that end inside a byte."""
    for i in range(first, first + n):
        bit = data[i >> 3] >> (7 - (i & 7)) & 1
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


class Header:
    """A parsed frame header; ``size`` is the length of the whole frame in bytes, or 0 in a free-format stream."""

    __slots__ = ("bound", "channels", "kbps", "layer", "pad", "protected", "rate", "samples", "side", "size", "version")

    def __init__(self, version: int, layer: int, kbps: int, rate: int, pad: int, protected: bool, mode: int, extension: int):
        one = version == 3
        self.version, self.layer, self.kbps, self.rate, self.protected, self.channels = VERSIONS[version], layer, kbps, rate, protected, 1 if mode == 3 else 2
        self.samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
        self.pad = pad * (4 if layer == 1 else 1)
        self.size = (((12000 * kbps // rate) * 4 if layer == 1 else self.samples // 8 * 1000 * kbps // rate) + self.pad) if kbps else 0
        self.side = 0 if layer < 3 else (17 if self.channels == 1 else 32) if one else (9 if self.channels == 1 else 17)
        self.bound = 4 * (extension + 1) if mode == 1 else 32  # from this subband on both channels share their allocation

    def kind(self) -> tuple:
        """What the frames of one stream have in common."""
        return self.version, self.layer, self.rate, self.kbps == 0

    def allocation(self) -> list[int]:
        """Bits of the allocation of each subband of layer II."""
        if self.version != "1":
            runs = ALLOCATIONS["low"]
        else:
            each = self.kbps // self.channels
            low = 0 < each <= 48
            runs = ALLOCATIONS[("d" if self.rate == 32000 else "c") if low else "a" if self.rate == 48000 or 0 < each <= 80 else "b"]
        return [bits for n, bits in runs for _ in range(n)]


@lru_cache(4096)
def header(raw: bytes) -> Header | None:
    """The header in four bytes; None if they are none."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, index = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 2 & 3, raw[2] >> 4
    if version == 1 or layer == 4 or rate == 3 or index == 15 or raw[3] & 3 == 2:
        return None
    return Header(version, layer, BITRATES[version == 3, layer][index], RATES[version][rate], raw[2] >> 1 & 1, not raw[1] & 1, raw[3] >> 6, raw[3] >> 4 & 3)


def checksum_holds(frame: bytes, h: Header) -> bool:
    """Whether the checksum of a protected frame fits: it covers the second half of the header and the side
    information of layer III, the allocation of layer I, or that and the scale factor selection of layer II."""
    want = int.from_bytes(frame[4:6], "big")
    if h.layer == 3:
        return crc16(frame[2:4] + frame[6 : 6 + h.side]) == want
    data, bits = frame[6:], 0
    if h.layer == 1:
        bits = 4 * (min(h.bound, 32) * h.channels + 32 - min(h.bound, 32))
    else:
        at = chosen = 0
        for band, width in enumerate(h.allocation()):
            for _ in range(h.channels if band < h.bound else 1):
                if at + width > len(data) * 8:
                    return False
                value = int.from_bytes(data[at >> 3 : (at >> 3) + 2].ljust(2, b"\0"), "big") >> (16 - (at & 7) - width) & ((1 << width) - 1)
                chosen += (1 if band < h.bound else h.channels) * (value > 0)
                at += width
        bits = at + 2 * chosen
    return bits <= len(data) * 8 and crc16_bits(data, 0, bits, crc16(frame[2:4])) == want


def free_size(data: bytes, at: int, end: int, h: Header) -> int:
    """Bytes of a frame of a free-format stream without padding: up to the next header like it; 0 if there is none."""
    i = data.find(b"\xff", at + 4 + 2 * h.protected + h.side, end)
    while i >= 0:
        n = header(data[i : i + 4])
        if n and n.kind() == h.kind() and n.protected == h.protected:
            return i - at - h.pad
        i = data.find(b"\xff", i + 1, end)
    return 0


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _frame_head(index: int) -> bytes:
    """Header, checksum and empty side information of a 44 100 Hz stereo layer III frame."""
    raw = bytes((0xFF, 0xFA, index << 4, 0))
    return raw + crc16(raw[2:] + bytes(32)).to_bytes(2, "big") + bytes(32)


def _sizes() -> list[tuple[int, int]]:
    return [(header(bytes((0xFF, 0xFA, i << 4, 0))).size - HEAD, i) for i in range(1, 15)]


def pack(payload: bytes, note: str = "") -> bytes:
    """A stream that carries ``payload``; ``note`` goes into the tag beside its length."""
    sizes = _sizes()
    room, index = sizes[-1]
    full = len(payload) // room
    frames = [_frame_head(index) + payload[i * room : (i + 1) * room] for i in range(full)]
    rest = payload[full * room :]
    if rest or not frames:
        room, index = next(s for s in sizes if s[0] >= len(rest))
        frames.append(_frame_head(index) + rest.ljust(room, b"\0"))
    text = f"payload\0{len(payload)};{note}".encode("latin-1", "replace")
    frame = b"TXXX" + struct.pack(">IH", len(text) + 1, 0) + b"\0" + text
    tag = b"ID3\3\0\0" + _syncsafe(len(frame)) + frame
    size, index = next(s for s in sizes if s[0] >= 8 + 4 + 4 + 100)
    total = HEAD + size + sum(map(len, frames))
    ends, at = [], HEAD + size
    for f in frames:
        ends.append(at)
        at += len(f)
    toc = bytes(min(255, ends[i * len(frames) // 100] * 256 // total) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return b"".join((tag, _frame_head(index) + xing.ljust(size, b"\0"), *frames))


def _seven(raw: bytes) -> int:
    """A number in bytes of seven bits."""
    n = 0
    for b in raw:
        n = n << 7 | b & 0x7F
    return n


def _text(body: bytes) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
    return body[1:].decode(code, "replace").rstrip("\0")


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of leading ID3v2 tags of any version, and where they end."""
    tags: dict[str, str] = {}
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        major, flags = data[at + 3], data[at + 5]
        size = _seven(data[at + 6 : at + 10])
        body = data[at + 10 : at + 10 + size]
        if flags & 0x80 and major < 4:  # zeros were put after 0xFF, so that nothing looks like a frame
            body = body.replace(b"\xff\0", b"\xff")
        i, name_size, head = 0, (3, 6) if major < 3 else (4, 10), 0
        if flags & 0x40 and major >= 3:  # an extended header, whose size counts itself from version 4 on
            i = _seven(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
        letters, head = name_size
        while i + head <= len(body) and body[i]:
            raw = body[i + letters : i + 2 * letters]
            n = _seven(raw) if major == 4 else int.from_bytes(raw, "big")
            name, value = body[i : i + letters].decode("latin-1"), body[i + head : i + head + n]
            if major == 4 and body[i + 9] & 2:
                value = value.replace(b"\xff\0", b"\xff")
            if name[0] == "T" and value:
                text = _text(value)
                key, _, rest = text.partition("\0")
                tags.update({f"TXXX:{key}": rest} if name in ("TXXX", "TXX") else {name: text})
            i += head + n
        at += 10 + size + (10 if flags & 0x10 else 0)
    return tags, min(at, len(data))


def _last_tag(data: bytes) -> dict[str, str]:
    """The fields of a tag of the first version in the last 128 bytes."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return {}
    raw, out = data[-125:], {}
    for name, n in (("title", 30), ("artist", 30), ("album", 30), ("year", 4), ("comment", 30)):
        out[f"v1:{name}"], raw = raw[:n].split(b"\0")[0].decode("latin-1").rstrip(), raw[n:]
    comment = data[-31:-1]
    if not comment[28] and comment[29]:
        out["v1:track"] = str(comment[29])
    return {k: v for k, v in out.items() if v} | {"v1:genre": str(data[-1])}


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """The Xing, Info or VBRI table in the frame at ``at``, if it has one.

    ``seek`` are byte offsets from the frame's start: of each hundredth of the time, or of each
    entry of a VBRI table; ``delay`` and ``padding`` are samples that are not part of the sound."""
    i = at + 4 + 2 * h.protected + h.side
    kind = data[i : i + 4]
    word = lambda j, n: int.from_bytes(data[j : j + n], "big")
    out: dict = {"kind": kind.decode("latin-1"), "frames": None, "bytes": None, "quality": None, "seek": [], "delay": 0, "padding": 0}
    if kind in (b"Xing", b"Info"):
        flags, j, toc = word(i + 4, 4), i + 8, b""
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = word(j, 4)
                j += 4
        if flags & 4:
            toc, j = data[j : j + 100], j + 100
        if flags & 8:
            out["quality"], j = word(j, 4), j + 4
        out["seek"] = [x * (out["bytes"] or 0) // 256 for x in toc]
        if data[j : j + 4] in (b"LAME", b"Lavc", b"Lavf"):
            out["delay"], out["padding"] = word(j + 21, 3) >> 12, word(j + 21, 3) & 0xFFF
        return out
    i = at + 36
    if data[i : i + 4] == b"VBRI":
        entries, scale, width = word(i + 18, 2), word(i + 20, 2), word(i + 22, 2)
        ends, total = [], 0
        for k in range(entries if 1 <= width <= 4 else 0):
            total += word(i + 26 + k * width, width) * scale
            ends.append(total)
        return out | {"kind": "VBRI", "bytes": word(i + 10, 4), "frames": word(i + 14, 4), "quality": word(i + 8, 2), "seek": ends}
    return None


def parse(data: bytes) -> dict:
    """Everything known of a stream; damaged parts are skipped and counted, never fatal.

    ``body`` holds what the frames carry after header, checksum and side information.
    """
    tags, at = _tags(data)
    last = _last_tag(data)
    end = len(data) - 128 if last else len(data)
    out = {"tags": tags | last, "offsets": [], "samples": 0, "rate": 0, "channels": 0, "version": "", "layer": 0, "crc_good": 0, "crc_bad": 0, "skipped": 0, "resyncs": 0, "table": None}
    body, locked, first, free, kind = [], False, True, 0, None
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and not h.size:
            if not free or not locked:
                free = free_size(data, at, end, h) or free
            size = free + h.pad if free else 0
        else:
            size = h.size if h else 0
        if h and size and at + size <= end and not locked:
            # two headers in a row, or the end of the stream, make a sync
            n = at + size
            after = header(data[n : n + 4])
            if n != end and not (after and after.kind() == h.kind()):
                h = None
        if h and locked and h.kind() != kind:
            h = None
        if not h or not size or at + size > end:
            n = data.find(b"\xff", at + 1, end)
            n = end if n < 0 else n
            out["resyncs"] += locked or (first and not out["skipped"])
            out["skipped"] += n - at
            at, locked = n, False
            continue
        if h.protected:
            out["crc_good" if checksum_holds(data[at : at + size], h) else "crc_bad"] += 1
        table = _table(data, at, h) if first and h.layer == 3 else None
        if first:
            out.update(rate=h.rate, layer=h.layer, version=h.version, channels=h.channels)
        first, locked, kind = False, True, h.kind()
        if table:
            out["table"] = table
        else:
            out["offsets"].append(at)
            out["samples"] += h.samples
            body.append(data[at + 4 + 2 * h.protected + h.side : at + size])
        at += size
    out["skipped"] += max(0, end - at)
    out["body"] = b"".join(body)
    return out


def carried(info: dict) -> bytes:
    """The bytes that ``pack`` put into a stream, by the length in its tag."""
    return info["body"][: int(info["tags"]["TXXX:payload"].partition(";")[0])]


def pad64(data: bytes) -> bytes:
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def text_to_audio(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with a binary column ``media``: a stream that carries the UTF-8 bytes of the text.

    The bytes are padded with zeros to a positive multiple of 64; a null text counts as
    empty. Equal texts give equal streams. A column of ``df`` named like ``media`` is replaced.
    """
    df = df.drop(media)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in sliced(batches, text):
            raw = [(x or "").encode() for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            made = pa.array([pack(pad64(x), str(len(x))) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, media])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(media, T.BinaryType())]))


INFO = (
    "version string, layer int, rate int, channels int, frames long, samples long, duration_us long, crc_good long, crc_bad long, skipped long, "
    "resyncs long, table string, table_frames long, seek array<long>, quality long, play_samples long, tags map<string,string>, offsets array<long>, body binary"
)


def read_audio(df: DataFrame, media: str = "media", info: str = "info") -> DataFrame:
    """``df`` with a struct ``info`` of each stream in place of its bytes (see ``INFO``).

    ``samples`` / ``rate`` is the exact duration, ``duration_us`` the same in whole
    microseconds; ``play_samples`` leaves out the delay and padding that a table names.
    ``offsets`` are the byte offsets of all audio frames, ``seek`` the points of the table.
    Null media give a null struct; bytes without a frame give zero counts, with all skipped.
    """
    kept = [f for f in df.schema.fields if f.name not in (media, info)]
    kind = T.StructType.fromDDL(INFO)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        for b in sliced(batches, media):
            rows = []
            for raw in b.column(b.schema.get_field_index(media)).to_pylist():
                if raw is None:
                    rows.append(None)
                    continue
                x = parse(raw)
                table = x["table"] or {"kind": None, "frames": None, "seek": [], "quality": None, "delay": 0, "padding": 0}
                rows.append({
                    "version": x["version"], "layer": x["layer"], "rate": x["rate"], "channels": x["channels"], "frames": len(x["offsets"]),
                    "samples": x["samples"], "duration_us": x["samples"] * 1_000_000 // x["rate"] if x["rate"] else 0, "crc_good": x["crc_good"],
                    "crc_bad": x["crc_bad"], "skipped": x["skipped"], "resyncs": x["resyncs"], "table": table["kind"], "table_frames": table["frames"],
                    "seek": table["seek"], "quality": table["quality"], "play_samples": max(0, x["samples"] - table["delay"] - table["padding"]),
                    "tags": [*x["tags"].items()], "offsets": x["offsets"], "body": x["body"],
                })
            columns = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, arrow)], names=[*(f.name for f in kept), info])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(info, kind)]))
