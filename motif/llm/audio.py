"""MPEG audio columns: a parser for stored streams, and a writer that keeps any bytes in one without loss.

parse() reads an MPEG-1, 2 or 2.5 layer I, II or III stream: leading ID3v2 tags, a trailing ID3v1 tag, then frames. A
frame counts only if its header is valid and another valid header of the same version, layer and rate, or the end of the
audio, follows where its length says; otherwise the search goes on at the next byte, so junk between frames and false
syncs in data are passed over. Xing, Info and VBRI tables are read from the first frame. The CRC-16 of protected layer III
frames is verified. Durations are exact: samples and rate are both integers. Every frame has its byte offset, which
is what a seek needs.

write() makes a layer III stream of silent frames (all-zero side information) in whose main-data bytes, which no granule
claims, the payload lies. Its length stands in an ID3v2 tag, and a Xing table leads the frames. An empty ID3v1 tag ends the
stream, so that no payload stands where one is looked for.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

# Fixed values of the format: kbit/s by (version 1?, layer), sample rates and samples a frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by version bits
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, (out << 1) ^ 0x8005, out << 1) & 0xFFFF
    return out


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The format's CRC-16 (polynomial 0x8005, initially all ones) of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, dtype=np.uint32)
    for c in range(rows.shape[1]):
        crc = ((crc << 8) & 0xFFFF) ^ CRC[(crc >> 8) ^ rows[:, c]]
    return crc


@dataclass(frozen=True)
class Header:
    size: int
    samples: int
    rate: int
    kind: tuple  # version bits, layer, rate: alike in all frames of a stream
    protected: bool
    side: int  # bytes of side information, layer III only
    kbps: int


def read_header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None if they are none (free-format streams have no length and count as none)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 2 & 3
    index, pad = four[2] >> 4, four[2] >> 1 & 1
    if version == 1 or layer == 4 or rate == 3 or index in (0, 15) or four[3] & 3 == 2:
        return None
    first = version == 3
    kbps, hertz, samples = BITRATES[first, layer][index], RATES[version][rate], SAMPLES[first, layer]
    size = (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    mono = four[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return Header(size, samples, hertz, (version, layer, hertz), not four[1] & 1, side, kbps)


def _synchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)  # of audio frames, without the table's frame
    headers: list[Header] = field(default_factory=list)
    rate: int = 0
    samples: int = 0
    table: dict | None = None  # kind, frames, bytes, and toc of a variable-bitrate table
    checked: int = 0
    failed: int = 0
    skipped: int = 0  # bytes that belong to no tag or frame

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads a tag at the beginning; returns where it ends."""
    if len(data) < 10 or data[:3] != b"ID3" or any(b & 0x80 for b in data[6:10]):
        return 0
    end = min(len(data), 10 + _synchsafe(data[6:10]) + (10 if data[5] & 0x10 else 0))
    at = 10
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        name, size = data[at : at + 4].decode("latin-1"), _synchsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(end, at + 10 + size)]
        if name.startswith("T") and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value.rstrip("\0")
        at += 10 + size
    return end


def _table(frame: bytes, h: Header) -> dict | None:
    at = 4 + 2 * h.protected + h.side
    for at in (at, 4 + h.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[key], p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 4:
                out["toc"] = list(frame[p : p + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, n, scale, width = struct.unpack(">IIHHH", frame[46:60])
        body = frame[62 : 62 + n * width]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": [int.from_bytes(body[i : i + width], "big") * scale for i in range(0, len(body), max(width, 1))]}
    return None


def parse(data: bytes) -> Audio:
    """What a stored stream holds; an empty or foreign stream gives no frames."""
    out, n, at = Audio(), len(data), 0
    while end := _id3v2(data[at:], out.tags):
        at += end
    if n - at >= 128 and data[-128:-125] == b"TAG":
        n -= 128
        for key, i, j in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[n + i : n + j].split(b"\0")[0].decode("latin-1").rstrip():
                out.tags.setdefault(key, text)
    known: dict[bytes, Header | None] = {}

    def header(i: int) -> Header | None:
        four = data[i : i + 4]
        if four not in known:
            known[four] = read_header(four)
        return known[four]

    kind, synced = None, False
    while at + 4 <= n:
        h = header(at)
        good = h is not None and kind in (None, h.kind) and at + h.size <= n
        if good and not synced:  # out of step, one header is not enough
            end = at + h.size
            follows = header(end) if end + 4 <= n else None
            good = end == n or (follows is not None and follows.kind == h.kind)
        if not good:
            found = data.find(b"\xff", at + 1, n)
            found = n if found < 0 else found
            out.skipped += found - at
            at, synced = found, False
            continue
        if kind is None:
            kind, out.rate = h.kind, h.rate
            out.table = _table(data[at : at + h.size], h)
        if out.table is None or out.headers or "at" in out.table:
            out.offsets.append(at)
            out.headers.append(h)
            out.samples += h.samples
        else:
            out.table["at"] = at  # the table's frame holds no audio
        at, synced = at + h.size, True
    out.skipped += max(0, n - at)
    _verify(data, out)
    return out


def _verify(data: bytes, out: Audio) -> None:
    """The checksums of protected layer III frames, all of the same shape at once."""
    raw = np.frombuffer(data, dtype=np.uint8)
    shapes: dict[int, list[int]] = {}
    for i, h in zip(out.offsets, out.headers):
        if h.protected and h.side:
            shapes.setdefault(h.side, []).append(i)
    for side, at in shapes.items():
        at = np.array(at)
        rows = raw[at[:, None] + np.r_[2, 3, 6 : 6 + side]]
        stored = raw[at + 4].astype(np.uint32) << 8 | raw[at + 5]
        out.checked += len(at)
        out.failed += int((crc16(rows) != stored).sum())


# The writer's frames: MPEG-1 layer III, 48 kHz, mono, protected: 3 bytes a frame for each kbit/s, without padding.
HEAD, SIDE = 6, 17
KBPS = BITRATES[True, 3][1:]
ROOM = [3 * k - HEAD - SIDE for k in KBPS]


def _frame_head(index: int) -> bytes:
    head = bytes([0xFF, 0xFA, (index + 1) << 4 | 1 << 2, 0xC0])
    crc = int(crc16(np.frombuffer(head[2:] + bytes(SIDE), dtype=np.uint8)[None, :])[0])
    return head + crc.to_bytes(2, "big") + bytes(SIDE)


END = b"TAG".ljust(127, b"\0") + b"\xff"  # an ID3v1 tag without a genre
HEADS = [_frame_head(i) for i in range(len(KBPS))]


def _text_frame(key: str, value: str) -> bytes:
    body = b"\x03" + f"{key}\0{value}".encode()
    return b"TXXX" + _pack_synchsafe(len(body)) + b"\0\0" + body


def _pack_synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write(payload: bytes) -> bytes:
    """A stream that holds the payload (any bytes); the last frame takes the least bitrate that has room for its rest."""
    full, rest = divmod(len(payload), ROOM[-1])
    big = np.zeros((full, 3 * KBPS[-1]), dtype=np.uint8)
    big[:, : HEAD + SIDE] = np.frombuffer(HEADS[-1], dtype=np.uint8)
    big[:, HEAD + SIDE :] = np.frombuffer(payload, dtype=np.uint8)[: full * ROOM[-1]].reshape(full, ROOM[-1])
    audio = big.tobytes()
    if rest:
        i = next(i for i, room in enumerate(ROOM) if room >= rest)
        audio += (HEADS[i] + payload[full * ROOM[-1] :]).ljust(3 * KBPS[i], b"\0")
    frames, size = full + bool(rest), 3 * KBPS[3]
    table = HEADS[3] + b"Xing" + struct.pack(">III", 7, frames, size + len(audio))
    sizes = [3 * KBPS[-1]] * full + ([len(audio) - full * 3 * KBPS[-1]] if rest else [])
    starts = np.r_[0, np.cumsum(sizes)] + size
    at = (np.arange(100) * frames) // 100
    table += bytes(np.minimum(255, starts[at] * 256 // (size + len(audio))).astype(np.uint8)) if frames else bytes(100)
    tag = _text_frame("payload_bytes", str(len(payload)))
    return b"ID3\x04\0\0" + _pack_synchsafe(len(tag)) + tag + table.ljust(size, b"\0") + audio + END


def read(data: bytes, audio: Audio | None = None) -> bytes:
    """The payload that write() stored."""
    audio = audio or parse(data)
    if audio.failed or "payload_bytes" not in audio.tags:
        raise ValueError("the stream is damaged")
    total = int(audio.tags["payload_bytes"])
    raw = np.frombuffer(data, dtype=np.uint8)
    big = [i for i, h in zip(audio.offsets, audio.headers) if h.kbps == KBPS[-1]]
    out = raw[np.array(big, dtype=np.int64)[:, None] + np.arange(HEAD + SIDE, 3 * KBPS[-1])].tobytes() if big else b""
    if len(big) < len(audio.offsets):
        i, h = audio.offsets[-1], audio.headers[-1]
        out += data[i + HEAD + SIDE : i + h.size]
    if len(out) < total:
        raise ValueError("the stream is damaged")
    return out[:total]


def summary(audio: Audio) -> str:
    """What is stored of a stream besides its bytes, as one short text: exact duration, frames, table, checks, seek offsets."""
    offsets = np.array(audio.offsets, dtype="<u8")
    steps = [b - a for a, b in pairwise(audio.offsets)]
    return (
        f"samples={audio.samples};rate={audio.rate};frames={len(audio.offsets)};first={audio.offsets[0] if len(offsets) else -1};"
        f"steps={min(steps, default=0)}..{max(steps, default=0)};table={(audio.table or {}).get('kind', '-')}:{(audio.table or {}).get('frames', 0)};"
        f"checked={audio.checked};failed={audio.failed};skipped={audio.skipped};seek_crc32={zlib.crc32(offsets.tobytes()):08x}"
    )


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def media_column(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep, media (the stored stream), samples, sample_rate, seek_offsets of every text, padded to 64 bytes."""

    def run(texts: list) -> dict:
        media = [write(padded(t)[0]) for t in texts]
        audio = [parse(m) for m in media]
        return {"media": media, "samples": [a.samples for a in audio], "sample_rate": [a.rate for a in audio], "seek_offsets": [a.offsets for a in audio]}

    return map_texts(docs, text, keep if keep is not None else ["doc_id"], lambda: run, "media binary, samples long, sample_rate long, seek_offsets array<long>")


def media_features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Digests and features of every text's stream, computed from the payload that is read back from the stored bytes, with its
    exact duration (samples at sample_rate) and the offset of every frame.

    A null text is empty: 64 zero bytes. Equal texts give equal values; repeated rows stay; an empty table gives none.
    """

    def make() -> Callable[[list], dict]:
        def run(texts: list) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "sample_rate", "seek_offsets")}
            for t in texts:
                payload, n = padded(t)
                stored = write(payload)
                audio = parse(stored)
                back = read(stored, audio)
                digests = n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), summary(audio)
                for k, v in zip(out, (*digests, audio.samples, audio.rate, audio.offsets)):
                    out[k].append(v)
            return out

        return run

    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sample_rate long, seek_offsets array<long>"
    return map_texts(docs, text, keep if keep is not None else ["doc_id"], make, fields)
