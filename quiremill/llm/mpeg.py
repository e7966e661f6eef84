"""Media columns: MPEG audio streams as binary columns, written and read frame by frame.

The writer makes MPEG-1 layer III: an ID3v2.4 tag, a variable-bitrate header frame and silent mono frames which carry the
payload as ancillary bytes, with checksums. The reader takes versions 1, 2 and 2.5 and layers I to III. It resynchronises on damage,
parses tags (ID3v2.2 to 2.4, ID3v1, skips APE) and variable-bitrate tables (Xing, Info, VBRI, encoder delay), compares
the tables' counts with the frames it walks, verifies checksums (layers I and III) and gives the exact duration and the offset of every frame.
Not read: free-format streams (bitrate index 0), and checksums of layer II.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format. kbit/s by index: MPEG-1 layers I, II, III; MPEG-2 and 2.5 layer I, and layers II and III.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448, 0),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 0),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256, 0),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0),
}
# Version bits: 2.5, reserved, 2, 1; Hz by index of MPEG-1 (halved for 2, and again for 2.5).
VERSIONS = ("2.5", None, "2", "1")
RATES = (44100, 48000, 32000, 0)
RATE_SHIFT = {"1": 0, "2": 1, "2.5": 2}
# Bytes of a layer III frame's side information: (version 1 or not, mono or not).
SIDE_BYTES = {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}
# ID3v2.2 names of the common frames, as later versions name them.
OLD_NAMES = {"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB", "TYE": "TYER", "TRK": "TRCK", "TCO": "TCON", "TLE": "TLEN", "TEN": "TENC", "TXX": "TXXX", "COM": "COMM"}

RATE_INDEX = 2  # 32 kHz: every bitrate gives whole frames without padding slots
LEAD = 4 + 2 + SIDE_BYTES[True, True]
OUT_BYTES = 8 << 20


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        x = i << 8
        for _ in range(8):
            x = ((x << 1) ^ 0x8005) & 0xFFFF if x & 0x8000 else (x << 1) & 0xFFFF
        table.append(x)
    return table


_CRC = _crc_table()
_crc_memo: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """The frame checksum: header's last two bytes and the side information."""
    got = _crc_memo.get(data)
    if got is None:
        x = 0xFFFF
        for b in data:
            x = ((x << 8) & 0xFFFF) ^ _CRC[(x >> 8) ^ b]
        if len(_crc_memo) > 10_000:
            _crc_memo.clear()
        got = _crc_memo[data] = x
    return got


@dataclass
class Frame:
    size: int
    rate: int
    bitrate: int
    mono: bool
    checked: bool
    version: str = "1"
    layer: int = 3
    samples: int = 1152
    side: int = 0
    #: Bytes after the checksum that it covers; None: not verified.
    covered: int | None = None

    def like(self, other: Frame) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


def parse_header(b: bytes, at: int = 0) -> Frame | None:
    """The MPEG audio header at `at`, if there is a valid one."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS[b[at + 1] >> 3 & 3], 4 - (b[at + 1] >> 1 & 3)
    if version is None or layer == 4 or b[at + 3] & 3 == 2:
        return None
    first = version == "1"
    rate, kbps = RATES[b[at + 2] >> 2 & 3] >> RATE_SHIFT[version], BITRATES[1 if first else 2, layer][b[at + 2] >> 4]
    if not rate or not kbps:
        return None
    pad, mode, mono = b[at + 2] >> 1 & 1, b[at + 3] >> 6, b[at + 3] >> 6 == 3
    if layer == 1:
        size, samples, side = (12_000 * kbps // rate + pad) * 4, 384, 0
        # A bit allocation of four bits for each subband and channel; joint stereo shares those above a bound.
        bound = 0 if mono else 4 * ((b[at + 3] >> 4 & 3) + 1) if mode == 1 else 32
        covered = (32 + bound) // 2
    else:
        samples = 1152 if first or layer == 2 else 576
        size = samples // 8 * 1000 * kbps // rate + pad
        side = SIDE_BYTES[first, mono] if layer == 3 else 0
        covered = side if layer == 3 else None
    return Frame(size, rate, kbps, mono, not b[at + 1] & 1, version, layer, samples, side, covered)


def _lead(index: int) -> bytes:
    """Header, checksum and empty side information of a frame of our streams."""
    head = bytes([0xFF, 0xFA, index << 4 | RATE_INDEX << 2, 0xC0])
    side = bytes(SIDE_BYTES[True, True])
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


_SIZES = [144_000 * k // RATES[RATE_INDEX] for k in BITRATES[1, 3]]
_LEADS = {i: _lead(i) for i in range(1, 15)}
_LARGEST = 14
ROOM = _SIZES[_LARGEST] - LEAD


def _syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def _tag(fields: dict[str, str]) -> bytes:
    body = b""
    for name, value in fields.items():
        text = b"\x03" + name.encode() + b"\0" + value.encode()
        body += b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _syncsafe(len(body)) + body


def write_stream(payload: bytes, fields: dict[str, str] | None = None) -> bytes:
    """A stream that carries payload; its length and `fields` stand in the tag."""
    frames = []
    for at in range(0, len(payload), ROOM):
        part = payload[at : at + ROOM]
        index = next(i for i in range(1, 15) if _SIZES[i] - LEAD >= len(part))
        frames.append(_LEADS[index] + part + bytes(_SIZES[index] - LEAD - len(part)))
    first = 7  # 112 kbit/s: room for the table
    total = _SIZES[first] + sum(map(len, frames))
    ends, x = [], _SIZES[first]
    for f in frames:
        ends.append(x)
        x += len(f)
    toc = bytes(min(255, 256 * ends[len(ends) * i // 100] // total) if ends else 0 for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    head = _LEADS[first] + table
    return _tag({"payload": str(len(payload))} | (fields or {})) + head.ljust(_SIZES[first], b"\0") + b"".join(frames)


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    offsets: list[int] = field(default_factory=list)
    n_samples: int = 0
    rate: int = 0
    version: str = ""
    layer: int = 0
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    encoder: str = ""
    delay: int = 0
    padding: int = 0
    counts_match: bool | None = None
    bad_checksums: int = 0
    resyncs: int = 0
    #: Seconds of the frames walked, each at its own rate.
    seconds: Fraction = Fraction(0)

    @property
    def duration_us(self) -> int:
        """Microseconds of sound: the frames' samples without what the encoder says it added at both ends."""
        if not self.rate:
            return 0
        return int(max(Fraction(0), self.seconds - Fraction(self.delay + self.padding, self.rate)) * 1_000_000)


def _unsafe(b: bytes) -> int:
    """A syncsafe number: seven bits of each byte."""
    n = 0
    for x in b:
        n = n << 7 | x & 127
    return n


def _decoded(kind: int, raw: bytes) -> list[str]:
    """The strings of a text frame, by its encoding byte; they end at a zero character."""
    name = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(kind, "latin-1")
    if kind == 1 and raw[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        name = "utf-16-le"
    parts = [x.removeprefix("\ufeff") for x in raw.decode(name, "replace").split("\0")]
    while len(parts) > 1 and not parts[-1]:
        parts.pop()
    return parts


def _read_frames(b: bytes, version: int, whole_unsync: bool, s: Stream) -> None:
    head = 6 if version == 2 else 10
    at = 0
    while at + head <= len(b) and b[at]:
        if version == 2:
            name, size, flags = b[at : at + 3], int.from_bytes(b[at + 3 : at + 6], "big"), 0
        else:
            size = _unsafe(b[at + 4 : at + 8]) if version == 4 else int.from_bytes(b[at + 4 : at + 8], "big")
            name, flags = b[at : at + 4], b[at + 9]
        raw = b[at + head : at + head + size]
        at += head + size
        if version == 4:
            skip = (flags >> 6 & 1) + 4 * (flags & 1)
            locked, unsync = flags & 0x0C, whole_unsync or flags & 2
        else:
            skip, locked, unsync = (flags >> 5 & 1), flags & 0xC0, False
        if locked:  # compressed or encrypted
            continue
        raw = raw[skip:].replace(b"\xff\0", b"\xff") if unsync else raw[skip:]
        name = name.decode("latin-1")
        name = OLD_NAMES.get(name, name)
        if not raw or not (name[0] == "T" or name == "COMM"):
            continue
        if name == "TXXX":
            key, *values = _decoded(raw[0], raw[1:])
            s.tags[key] = " / ".join(values)
        elif name == "COMM":
            s.tags.setdefault("COMM", " / ".join(_decoded(raw[0], raw[4:])[1:]))
        else:
            s.tags.setdefault(name, " / ".join(_decoded(raw[0], raw[1:])))


def _read_tag(b: bytes, at: int, s: Stream) -> int:
    """Read the ID3v2 tag at `at`; what follows it, or `at` where there is none."""
    if b[at : at + 3] != b"ID3" or len(b) < at + 10 or any(x & 128 for x in b[at + 6 : at + 10]):
        return at
    version, flags = b[at + 3], b[at + 5]
    end = at + 10 + _unsafe(b[at + 6 : at + 10])
    body = b[at + 10 : end]
    if version == 3 or version == 2:
        body = body.replace(b"\xff\0", b"\xff") if flags & 0x80 else body
    if version in (3, 4) and flags & 0x40:  # an extended header comes first
        body = body[_unsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big") :]
    if version in (2, 3, 4) and not (version == 2 and flags & 0x40):
        _read_frames(body, version, bool(version == 4 and flags & 0x80), s)
    return end + (10 if version == 4 and flags & 0x10 else 0)


def _read_end(b: bytes, s: Stream) -> int:
    """Read the ID3v1 tag at the end, skip an APE tag before it; where the frames end."""
    end = len(b)
    if end >= 128 and b[end - 128 : end - 125] == b"TAG":
        end -= 128
        old = b[end : end + 128]
        comment = old[97:127]
        if comment[28] == 0 and comment[29]:
            s.tags.setdefault("TRCK", str(comment[29]))
            comment = comment[:28]
        for name, raw in (("TIT2", old[3:33]), ("TPE1", old[33:63]), ("TALB", old[63:93]), ("TYER", old[93:97]), ("COMM", comment)):
            text = raw.split(b"\0")[0].decode("latin-1").strip()
            if text:
                s.tags.setdefault(name, text)
    if end >= 32 and b[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I", b[end - 20 : end - 16])[0], struct.unpack("<I", b[end - 12 : end - 8])[0]
        end = max(0, end - size - (32 if flags >> 31 else 0))
    return end


def _number(b: bytes, at: int, size: int = 4) -> int:
    return int.from_bytes(b[at : at + size], "big")


def _read_table(b: bytes, at: int, f: Frame, s: Stream) -> bool:
    """Read a variable-bitrate table in the layer III frame at `at`; whether it holds one."""
    stop = at + f.size
    for body in (at + 4 + f.side, at + 6 + f.side):
        if b[body : body + 4] in (b"Xing", b"Info") and body + 8 <= stop:
            flags, here = _number(b, body + 4), body + 8
            if flags & 1:
                s.vbr_frames, here = _number(b, here), here + 4
            if flags & 2:
                s.vbr_bytes, here = _number(b, here), here + 4
            if flags & 4:
                s.toc, here = b[here : here + 100], here + 100
            here += 4 * (flags >> 3 & 1)
            if b[here : here + 4] in (b"LAME", b"Lavf", b"Lavc", b"GOGO") and here + 24 <= stop:
                s.encoder = b[here : here + 9].split(b"\0")[0].decode("latin-1").strip()
                s.delay, s.padding = _number(b, here + 21, 3) >> 12, _number(b, here + 21, 3) & 0xFFF
            return True
    body = at + 36
    if b[body : body + 4] == b"VBRI" and body + 26 <= stop:
        s.delay, s.vbr_bytes, s.vbr_frames = _number(b, body + 6, 2), _number(b, body + 10), _number(b, body + 14)
        size = _number(b, body + 18, 2) * _number(b, body + 22, 2)
        s.toc = b[body + 26 : min(stop, body + 26 + size)]
        return True
    return False


def read_stream(b: bytes | None) -> Stream:
    """Walk a stream. Damage costs the frames it touches: the walk resumes at the next header that a like one follows."""
    s = Stream()
    b = b or b""
    at, parts, found, table_at = 0, [], 0, None
    while (after := _read_tag(b, at, s)) > at:
        at = after
    end = _read_end(b, s)
    while at < end:
        f = parse_header(b, at)
        after = at + f.size if f else 0
        if f is None or after > end:
            after = _read_tag(b, at, s)
            if after > at:  # a tag between frames
                at = after
                continue
            nxt = at + 1
            while 0 <= (nxt := b.find(b"\xff", nxt, end)):
                g = parse_header(b, nxt)
                if g and nxt + g.size <= end and (nxt + g.size == end or ((h := parse_header(b, nxt + g.size)) and g.like(h))):
                    break
                nxt += 1
            s.resyncs += 1
            if nxt < 0:
                break
            at = nxt
            continue
        lead = at + 4 + 2 * f.checked
        if f.checked and f.covered is not None and crc16(b[at + 2 : at + 4] + b[lead : lead + f.covered]) != _number(b, at + 4, 2):
            s.bad_checksums += 1
        if not found and f.layer == 3 and _read_table(b, at, f, s):
            table_at = at
        else:
            s.offsets.append(at)
            s.n_samples += f.samples
            s.seconds += Fraction(f.samples, f.rate)
            parts.append(b[lead + f.side : after])
        if not found:
            s.rate, s.version, s.layer = f.rate, f.version, f.layer
        found += 1
        at = after
    if s.vbr_frames is not None or s.vbr_bytes is not None:
        # Some encoders count the table's own frame.
        s.counts_match = (s.vbr_frames is None or s.vbr_frames in (len(s.offsets), len(s.offsets) + 1)) and (s.vbr_bytes is None or s.vbr_bytes == at - table_at)
    s.payload = b"".join(parts)
    size = s.tags.get("payload", "")
    if size.isdecimal():
        s.payload = s.payload[: int(size)]
    return s


def _slices(batch: pa.RecordBatch):
    """Parts of a batch of some MB, so a batch of long texts doesn't grow."""
    rows = max(1, int(batch.num_rows * OUT_BYTES / max(OUT_BYTES, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def padded(text: Column, unit: int = 64) -> Column:
    """UTF-8 of text (null: empty) with bytes 0 up to a positive multiple of `unit`, as binary."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.greatest(F.lit(unit), F.ceil(F.octet_length(raw) / unit).cast("int") * unit)
    return F.rpad(raw, size, F.lit(b"\0"))


def to_audio(rows: DataFrame) -> DataFrame:
    """rows (doc_id, payload binary) as doc_id, media binary. Null payload: a stream of no frame. Other columns are left out."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write_stream(x or b"") for x in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "payload").mapInArrow(run, f"doc_id {kind}, media binary")


READ = "media binary, payload binary, n_frames long, n_samples long, rate int, duration_us long, offsets array<long>, vbr_frames long, vbr_bytes long, bad_checksums int, resyncs int, tags map<string,string>, version string, layer int, encoder string, counts_match boolean"


def read_audio(media: DataFrame) -> DataFrame:
    """The streams of media (doc_id, media) read back: payload, exact duration, seek offsets, tags, damage, and whether the
    variable-bitrate table's counts are those of the frames (null: no table).

    A null or foreign stream gives an empty payload and no frame; each row gives one row.
    """
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.string(), pa.bool_()]
    names = ["doc_id", *(f.split()[0] for f in READ.split(", "))]

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                raw = part.column(1).to_pylist()
                cols: list[list] = [[] for _ in kinds]
                for b in raw:
                    s = read_stream(b)
                    for c, x in zip(cols, (b, s.payload, len(s.offsets), s.n_samples, s.rate, s.duration_us, s.offsets, s.vbr_frames, s.vbr_bytes, s.bad_checksums, s.resyncs, list(s.tags.items()), s.version, s.layer, s.encoder, s.counts_match), strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, {READ}")
